import itertools
import random

import pytest
from conftest_llm import ODD, frame
from normlake.llm.components import components
from normlake.llm.jaccard_join import chunks_for, drop_near_copies, jaccard_join


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    label = [i for i, *_ in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2)
             if label[a] is not None and label[b] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(((r[0], len(s), c) for r, s, c in zip(rows, sets, label)), key=str)


def answers(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_odd_rows(odd):
    assert answers(jaccard_join(odd)) == brute(ODD)


@pytest.mark.parametrize("local_shingles", [2_000_000, 60])
def test_against_brute_force(spark, local_shingles):
    r = random.Random(2)
    base = [[r.choice("abcdefghij") + str(r.randint(0, 30)) for _ in range(r.randint(20, 60))] for _ in range(6)]
    rows = [(0, "x y", "en", "s"), (1, "X  y", "en", "s")]
    for i in range(2, 120):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = "m" + str(r.randint(0, 40))
        rows.append((i, " ".join(w + (r.choice(base)[: r.randint(1, 30)] if r.random() < 0.2 else [])), "en", "s"))
    assert answers(jaccard_join(frame(spark, rows), local_shingles=local_shingles)) == brute(rows)


def test_empty_table(nothing):
    assert jaccard_join(nothing).collect() == []
    assert drop_near_copies(nothing).columns == nothing.columns


def test_drop_near_copies(odd):
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["-7", "1", "1", "2", "3", "4", "5", "None", "None"])


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert set(got[i] for i in range(41)) == {0} and set(got[i] for i in range(100, 130)) == {100}


def test_chunks_follow_the_bytes_of_small_files(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i // 2) * 7 + k}" for k in range(12)), "en", "s") for i in range(40)]
    frame(spark, rows).write.parquet(f"{tmp_path}/few")
    docs = spark.read.parquet(f"{tmp_path}/few")
    assert chunks_for(docs, 211) == 1 and chunks_for(frame(spark, rows), 211) == 422
    assert answers(jaccard_join(docs)) == brute(rows)
