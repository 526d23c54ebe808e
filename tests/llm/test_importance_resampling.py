import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from conftest_llm import ODD, frame

from normlake.llm.importance_resampling import DEPTH, bucket_counts, crc32_spans, draw, features, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(rows, target, percent=25, least=20, buckets=10_000):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in runs(t)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts([r[1] for r in rows]), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text, *_ in rows:
        w, f = runs(text)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = place
    return sorted(map(tuple, out), key=str)


def target(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string")


def test_crc_of_spans():
    r = random.Random(3)
    data = np.frombuffer(r.randbytes(40_000), dtype=np.uint8)
    lengths = [0, 1, 2, 3, 4, DEPTH - 1, DEPTH, DEPTH + 1, 2 * DEPTH, 2 * DEPTH + 1, 20_000] + [r.randint(0, 400) for _ in range(500)]
    first = np.array([r.randint(0, len(data) - n) for n in lengths])
    last = first + np.array(lengths)
    assert crc32_spans(data, first, last).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(first, last)]


def test_features_stay_inside_their_text():
    found, words = features(pa.chunked_array([["Ab, cd", None, "", "ef"], ["gh-ij kl"]]), 3, 1 << 31)
    assert words.tolist() == [2, 0, 0, 1, 3]
    expected = [["ab", "cd", "ef", "gh", "ij", "kl"], ["ab cd", "gh ij", "ij kl"], ["gh ij kl"]]
    assert [b.tolist() for b, _ in found] == [[zlib.crc32(f.encode()) % (1 << 31) for f in e] for e in expected]
    assert [t.tolist() for _, t in found] == [[0, 0, 3, 4, 4, 4], [0, 4, 4], [4]]


def test_odd_rows(spark, odd):
    items = ["w1 w2 w3 one two", None, ""]
    assert sorted(map(tuple, resample(odd, target(spark, items), percent=50).collect()), key=str) == brute(ODD, items, 50)


def test_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["日本語" * 40, "Ünï", "x" * 300]
    rows = [(i if i % 9 else r.randint(0, 3) * 9, " ".join(r.choice(words) for _ in range(r.randint(0, 60))), "en", "s") for i in range(150)]
    rows += [(1000 + i, rows[5][1], "en", "s") for i in range(200)]  # a large group of copies
    items = [" ".join(r.choice(words[:20]) for _ in range(30)) for _ in range(5)]
    got = sorted(map(tuple, resample(frame(spark, rows), target(spark, items)).collect()), key=str)
    assert [g[:5] for g in got] == [b[:5] for b in brute(rows, items)]
    assert sorted((g[4], g[5]) for g in got if g[5]) == sorted((b[4], b[5]) for b in brute(rows, items) if b[5])


def test_drawn_rows_prefer_the_target(spark):
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{(i * k) % 13}" for k in range(1, 40)), "en", "s") for i in range(200)]
    items = target(spark, [" ".join(f"good{k % 13}" for k in range(3000))])
    drawn = draw(frame(spark, rows), items)
    ranked = {r["doc_id"] for r in resample(frame(spark, rows), items).collect() if r["rank"]}
    assert {r["doc_id"] for r in drawn.collect()} == ranked and len(ranked) == 50
    assert sum(i % 2 for i in ranked) >= 45


def test_empty_tables(spark, nothing, odd):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert resample(nothing, none).collect() == [] and draw(nothing, none).collect() == []
    assert bucket_counts(none).sum() == 0
    assert len(resample(odd, none).collect()) == len(ODD)
