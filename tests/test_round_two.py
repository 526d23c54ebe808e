"""Rules that once held only for small or friendly input, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from normlake.functions.quantity import digits_value
from normlake.operators import platform as pf
from normlake.operators import relate as rl
from normlake.operators import routing as ro
from normlake.operators import versions as vs
from normlake.operators import workflow as wf
from normlake.operators.documents import CHUNK, TAIL_MIN, cut_points
from normlake.operators.retrieval import _profile
from normlake.session import checkpoint_dir


def test_closure_of_a_long_chain_and_a_cycle(spark):
    edges = [(f"p{i}", f"p{i + 1}") for i in range(6)] + [("a", "b"), ("b", "c"), ("c", "a")]
    packs = sorted({x for e in edges for x in e})
    got = ro.include_closure(spark.createDataFrame(edges, "pack_id string, included string"), spark.createDataFrame([(p,) for p in packs], "pack_id string"))
    reach = {p: {p} for p in packs}
    for _ in packs:
        for a, b in edges:
            for p in packs:
                reach[p] |= {b} if a in reach[p] else set()
    assert sorted(map(tuple, got.collect())) == sorted((p, m) for p in packs for m in reach[p])


def test_fingerprint_of_a_large_group(spark):
    rows = spark.range(200_000).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("content"))
    one = vs.multiset_fingerprint(rows, ["g"], F.col("content")).collect()
    other = vs.multiset_fingerprint(rows.orderBy(F.desc("content")), ["g"], F.col("content")).collect()
    assert one == other and one[0].members == 200_000
    assert pf.manifest(rows, ["g"], F.col("content")).first().records == 200_000


def test_canonical_rows_differ(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("~", None), (None, "~"), ("\\", "|"), ("\\|", ""), (None, None), ("\\~", "x")]
    got = spark.createDataFrame(rows, "a string, b string").select(wf.canonical(F.col("a"), F.col("b")).alias("k")).collect()
    assert len({r.k for r in got}) == len(rows)


def deadline_verdict(duty, given):
    duty, given = sorted(duty), sorted(given)
    n, verdicts = min(len(duty), len(given)), set()
    for shift in ("best", "worst"):
        if len(given) < len(duty):
            d, g = (duty[-n:] if shift == "best" else duty[:n]), given
        else:
            d, g = duty, (given[:n] if shift == "best" else given[-n:])
        if any(b > a for a, b in zip(d, g)):
            verdicts.add(shift)
    return "LATER" if "best" in verdicts else "UNRESOLVED" if verdicts else "NOT_LATER"


def test_deadlines_of_unequal_counts(spark):
    r = random.Random(8)
    cases = [([1, 7, 10], [8, 9]), ([5, 6, 7], [5, 6])] + [([r.randint(1, 9) for _ in range(r.randint(1, 4))], [r.randint(1, 9) for _ in range(r.randint(1, 4))]) for _ in range(150)]
    side = lambda k: spark.createDataFrame([(i, float(x)) for i, c in enumerate(cases) for x in c[k]], "case int, days double")
    got = {x.case: x.verdict for x in rl.later_deadlines(side(0), side(1), ["case"], "days").collect()}
    assert {i: deadline_verdict(*c) for i, c in enumerate(cases)} == got
    assert got[0] == "LATER" and got[1] == "NOT_LATER"


def test_a_cycle_beside_the_root_is_no_chain(spark):
    rows = [("x", "A", None), ("x", "B", "C"), ("x", "C", "B"), ("y", "A", None), ("y", "B", "A"), ("y", "C", "B"), ("z", "A", "A")]
    got = {r.reg: r.one_chain for r in vs.chain_problems(spark.createDataFrame(rows, "reg string, version_id string, previous_version_id string"), "reg").collect()}
    assert got == {"x": False, "y": True, "z": False}
    long = [("l", str(i), str(i - 1) if i else None) for i in range(100)]
    assert vs.chain_problems(spark.createDataFrame(long, "reg string, version_id string, previous_version_id string"), "reg").first().one_chain


def test_scrub_keeps_delimiters(spark):
    prose = "word " * 45
    texts = [prose, f'"{prose}"', f"a\t{prose}\n[x]{{y}}=z\r", "short", f"«{prose}» and “{prose}”"]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(pf.scrub(F.col("t")).alias("s")).collect()]
    assert got[0] == f"[redacted {len(prose)} chars]" and got[1] == f'"[redacted {len(prose)} chars]"' and got[3] == "short"
    assert got[2].endswith("\n[x]{y}=z\r") and got[4].count("redacted") == 2


def test_cut_points_of_random_texts():
    r = random.Random(1)
    for _ in range(60):
        text = "".join(r.choice(["word ", "x", ". ", "\n", "long" * 30]) for _ in range(r.randint(0, 1500)))
        cuts = cut_points(text)
        assert "".join(text[a:b] for a, b in cuts) == text and all(a < b for a, b in cuts)
        assert all(b - a <= CHUNK for a, b in cuts[:-1]) and all(b - a <= CHUNK + TAIL_MIN for a, b in cuts[-1:])


def test_profile_has_unit_length():
    assert _profile("") == {}
    found = _profile(" abab ")
    assert abs(sum(w * w for w in found.values()) - 1) < 1e-12 and found[" ab"] > 0 and "abab " in found


@pytest.mark.parametrize("digits,value", [("15.000", 15000), ("15.000,50", 15000.5), ("2,5", 2.5), ("1.5", 1.5), ("7.", 7)])
def test_digits(spark, digits, value):
    assert spark.range(1).select(digits_value(F.lit(digits)).alias("v")).first().v == value


def test_a_cluster_must_name_its_shared_folder(spark):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        checkpoint_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert checkpoint_dir(Session)
