import random

from conftest_llm import ODD, frame
from normlake.llm.substring_dedup import levels, substring_dedup


def brute(rows, window):
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    low = {}
    for doc_id, w in split:
        for at in range(len(w) - window + 1):
            run = tuple(w[at : at + window])
            low[run] = min(low.get(run, float("inf")), float("inf") if doc_id is None else doc_id)
    out = []
    for doc_id, w in split:
        gone = {p for at in range(len(w) - window + 1) if low[tuple(w[at : at + window])] < (float("inf") if doc_id is None else doc_id) for p in range(at, at + window)}
        out.append((doc_id, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def test_odd_rows(odd):
    assert sorted(map(tuple, substring_dedup(odd).collect()), key=str) == brute(ODD, 13)


def test_against_brute_force(spark):
    r = random.Random(11)
    for window in (1, 2, 3, 4, 13):
        shared = [[r.choice("abcdefgh") for _ in range(30)] for _ in range(4)]
        rows = []
        for i in range(60):
            w = [r.choice("abcdefgh") + (str(r.randint(0, 9)) if window > 3 else "") for _ in range(r.randint(0, 25))]
            if r.random() < 0.6:
                piece, at = r.choice(shared), r.randint(0, 10)
                w = w[:5] + piece[at : at + r.randint(3, 20)] + w[5:]
            rows.append((i, r.choice([" ", "\n", "\t "]).join(w), "en", "s"))
        assert sorted(map(tuple, substring_dedup(frame(spark, rows), window).collect()), key=str) == brute(rows, window), window


def test_empty_table(nothing):
    assert substring_dedup(nothing).collect() == []


def test_levels_double():
    assert levels(13) == [7, 13] and levels(1) == [1] and all(lengths[-1] == w <= 2 * lengths[0] for w, lengths in ((w, levels(w)) for w in range(2, 60)))
