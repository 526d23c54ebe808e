import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from conftest_llm import ODD, frame
from normlake.llm.common import pack_sorted, planes
from normlake.llm.kneser_ney import _answer, _stored, discounts, read_share, score, squeezed, unsqueezed
from pyspark.sql import functions as F


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0D]+", low) if w] + [None]


def brute(rows, trained):
    seen, pairs = Counter(), Counter()
    for i, t, *_ in rows:
        if trained(i):
            seen.update(tokens(t))
            pairs.update(zip(["^", *tokens(t)], tokens(t)))
    n, v, kinds = sum(seen.values()), len(seen), len(pairs)
    context, follows, after = Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for (u, w), c in pairs.items():
        context[u] += c
        follows[w] += 1
        after[u][min(c, 3) - 1] += 1
    off, low = (discounts(*(sum(x == k for x in d.values()) for k in (1, 2, 3, 4))) for d in (pairs, follows))

    def p(u, w):
        below = 1 / (v + 1) if not kinds else (follows[w] - low[min(follows[w], 3)]) / kinds + sum(low[min(x, 3)] for x in follows.values()) / kinds / (v + 1)
        if not context[u]:
            return below
        return (pairs[u, w] - off[min(pairs[u, w], 3)]) / context[u] + sum(off[k + 1] * after[u][k] for k in range(3)) / context[u] * below

    return [(i, len(tokens(t)), sum(w in seen for w in tokens(t)), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t)), sum(math.log10(p(u, w)) for u, w in zip(["^", *tokens(t)], tokens(t)))) for i, t, *_ in rows]


def same(got, expected):
    got, expected = sorted(got, key=str), sorted(expected, key=str)
    return len(got) == len(expected) and all(a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 and abs(a[5] - b[5]) < 1e-6 for a, b in zip(got, expected))


def rows_of(df):
    return [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()]


def test_odd_rows(odd):
    assert same(rows_of(score(odd, F.col("doc_id") != 6)), brute(ODD, lambda i: i is not None and i != 6))


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 40))), "en", "s") for i in range(80)]
    assert same(rows_of(score(frame(spark, rows), F.col("doc_id") % 7 != 2)), brute(rows, lambda i: i % 7 != 2))


def test_probabilities_of_a_context_add_up(spark):
    rows = [(0, "a b a c a b", "", ""), (1, "b a", "", "")]
    asked = [(10 + k, t, "", "") for k, t in enumerate(["a", "b", "c", "zz"])]
    got = {r.doc_id: r for r in score(frame(spark, rows + asked), F.col("doc_id") < 10).collect()}
    assert all(got[i].score < 0 for i in got) and got[13].n_known == 1


def test_without_training_rows_or_rows(odd, nothing):
    assert all(r.train_tokens == 0 and abs(r.score) < 1e-12 for r in score(odd, F.lit(False)).collect())
    assert score(nothing, F.lit(True)).collect() == []


def test_a_stored_share_comes_back(tmp_path):
    r = np.random.default_rng(3)
    for n, low in ((0, 0), (1, 2**63 + 5), (2000, 2**62)):
        hashes = np.unique(r.integers(low, low + 2**40 + 1, n, dtype=np.uint64))
        counts = np.stack([np.ones(len(hashes)), r.integers(0, 300, len(hashes)), r.integers(0, 2**20, len(hashes))], axis=1).astype(np.uint32)
        mapped = _stored(str(tmp_path), f"share-{n}", hashes, counts)
        again, columns = read_share(str(tmp_path / f"share-{n}"))
        assert np.array_equal(again, hashes) and all(np.array_equal(c, m) for c, m in zip(counts.T, columns)) and len(mapped) == 3
        assert n < 2000 or (tmp_path / f"share-{n}").stat().st_size < len(hashes) * (5 + 1 + 2 + 4) + 100


def test_who_speaks_for_a_bigram_does_not_depend_on_the_order_of_blocks(tmp_path):
    hashes = [np.array([3, 5, 9], dtype=np.uint64), np.array([5, 9, 11], dtype=np.uint64)]
    rows = [{"share": 0, "chunk": c, "hashes": pack_sorted(h), "counts": planes(np.array([1, 2, 1], dtype=np.uint32))} for c, h in zip((4, 2), hashes)]
    told = []
    for order in (rows, rows[::-1]):
        table = pa.Table.from_pylist(order, schema=pa.schema([("share", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]))
        told.append(sorted((r["chunk"], r["own"]) for r in _answer(1, 1, str(tmp_path))((pa.scalar(0),), table).to_pylist()))
    assert told[0] == told[1]


def test_arrays_cost_what_they_hold(tmp_path):
    r = np.random.default_rng(5)
    hashes = np.unique(r.integers(0, 2**57, 100_000, dtype=np.uint64))
    counts = np.ones((len(hashes), 1), dtype=np.uint32)
    counts[::5000] = 70_000
    _stored(str(tmp_path), "share", hashes, counts)
    again, columns = read_share(str(tmp_path / "share"))
    assert np.array_equal(again, hashes) and np.array_equal(columns[0], counts[:, 0]) and columns[0][np.array([4999, 5000, 0])].tolist() == [1, 70_000, 70_000]
    # gaps of some 40 bits and a byte for the count: a few large counts and gaps do not widen the others
    assert (tmp_path / "share").stat().st_size < 6.4 * len(hashes)
    block = planes(counts[:, 0])
    assert unsqueezed(squeezed(block)) == block and len(squeezed(block)) < len(hashes) / 20 and unsqueezed(squeezed(b"")) == b""
