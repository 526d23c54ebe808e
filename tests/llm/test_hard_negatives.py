import math
import random

import numpy as np
import pytest
from conftest_llm import CLASHING

from normlake.llm.hard_negatives import LOW, _packed, hilbert_key, matrix, mine, read_blocks


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in (*CLASHING, "place", "vector", "win", "n") if c != "label"])


def brute(rows, every=100, positives=5, negatives=5, least=80):
    use = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows
           if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for anchor, label, a in sorted({(i, n, tuple(v)) for i, n, v in use if i % every == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i, n) for i, n, v in use if i != anchor)
        for minus, positive, _ in [s for s in scored if s[2] == label][:positives]:
            hits = [s for s in scored if s[2] != label and least * -minus <= 100 * -s[0] <= 100 * -minus][:negatives]
            out += [(anchor, positive, rank, i, -minus, -s) for rank, (s, i, _) in enumerate(hits, 1)]
    return sorted(out)


def near(r, centre, width):
    return [float(np.float32(c + r.gauss(0, width))) for c in centre]


def test_hilbert_key_walks_by_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        key = hilbert_key(cells, bits)
        order = sorted(range(len(cells)), key=lambda n: key[n].tobytes())
        steps = np.abs(np.diff(cells[order], axis=0)).sum(axis=1)
        assert len({k.tobytes() for k in key}) == len(cells) and (steps == 1).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(6)] for _ in range(5)]
    rows = [(i, i % 3, near(r, centres[r.randrange(5)], 0.05)) for i in range(1500)]
    copy = rows[7][2]
    rows += [(2000 + i, i % 2, copy) for i in range(700)]  # a large group of equal vectors: ties go to smaller ids
    assert sorted(map(tuple, mine(table(spark, rows)).collect())) == brute(rows)


def test_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, i % 2, near(r, [0.5, -0.2, 0.1], 0.1)) for i in range(40)]
    rows += [(None, 0, [0.5, 0.1, 0.1]), (100, None, [0.5, 0.1, 0.1]), (101, 1, None), (102, 1, [0.5, None, 0.1]), (103, 0, [float("nan"), 0.0, 0.0]), (104, 1, [float("inf"), 0.0, 0.0]),
             (200, 0, [0.6]), (201, 1, []), (300, 7, [0.5, 0.5, 0.5]), (0, 0, [0.1, 0.1, 0.1]), (0, 0, [0.1, 0.1, 0.1]), (400, 1, [-0.5, 0.2, -0.1]), (500, 0, []), (-100, 1, [3e4, 1e3, 0.0])]
    assert sorted(map(tuple, mine(table(spark, rows)).collect())) == brute(rows)


def test_other_limits(spark):
    r = random.Random(4)
    rows = [(i, i % 4, near(r, [0.5, -0.2, 0.1, 0.0], 0.1)) for i in range(300)]
    assert sorted(map(tuple, mine(table(spark, rows), every=7, positives=2, negatives=3, least_percent=95).collect())) == brute(rows, 7, 2, 3, 95)


def test_empty_table(spark):
    assert mine(table(spark, [])).collect() == []


def test_bounds_spare_blocks_that_hold_no_row():
    r = np.random.default_rng(5)
    blocks, rows = [], []
    for n in range(40):
        values = np.rint(r.normal(0, 60, 8) + r.normal(0, 4, (200, 8))).astype(np.int64)
        ids = np.arange(200, dtype=np.int64) + 1000 * n
        rows.append((ids, values))
        blocks.append({"label": 1, "ids": ids.tobytes(), "vectors": _packed(values), "low": values.min(axis=0).tobytes(), "high": values.max(axis=0).tobytes()})
    anchors = np.stack([rows[n][1][0] for n in range(10)])
    windows = np.array([[5000, 1 << 40]] * 10, dtype=np.int64)
    pack = {"ids": np.stack([np.arange(10), np.full(10, -1), np.zeros(10, dtype=np.int64)]).astype(np.int64).tobytes(), "vectors": _packed(anchors), "low": windows.tobytes()}
    found, read = read_blocks(blocks, pack, 8, False, 5)
    every = [sorted((-int(s), int(i)) for ids, v in rows for i, s in zip(ids, v @ a) if s >= 5000)[:5] for a in anchors]
    got = [sorted((-s, i) for n, i, s in zip(*(found.column(c).to_pylist() for c in ("anchor", "other_id", "score"))) if n == a) for a in range(10)]
    assert got == every and read < 10 * 40 / 4 and LOW < 0


def test_matrix_fills_up_and_cuts():
    import pyarrow as pa

    assert matrix(pa.array([[0.5, -0.001], [], [1e30]], pa.list_(pa.float64())), 2).tolist() == [[128, -1], [0, 0], [1 << 27, 0]]
