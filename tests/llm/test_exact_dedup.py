import hashlib
import random
import re

from conftest_llm import ODD, frame
from normlake.llm.exact_dedup import drop_copies, exact_dedup, squashed


def brute(rows):
    body = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t, *_ in rows]
    groups = {}
    for (doc_id, *_), text in zip(rows, body):
        groups.setdefault(text, []).append(doc_id)
    out = []
    for (doc_id, *_), text in zip(rows, body):
        ids = groups[text]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(odd):
    assert sorted(map(tuple, exact_dedup(odd).collect()), key=str) == brute(ODD)


def test_names_of_blocks_are_free_of_collisions(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ab ") for _ in range(r.randint(0, 14))), "en", "s") for i in range(300)]
    assert sorted(map(tuple, exact_dedup(frame(spark, rows), block_bytes=2).collect()), key=str) == brute(rows)


def test_empty_table(nothing):
    assert exact_dedup(nothing).collect() == []
    assert drop_copies(nothing).columns == nothing.columns


def test_drop_copies_keeps_columns(odd):
    kept = drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [-7, 1, 1, 2, 4, 5]


def test_squashed():
    assert squashed(b" a \t\n b ") == b" a b " and squashed(b"\n\n") == b" " and squashed(b"") == b""
