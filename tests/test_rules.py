"""Truth tables and fixtures written by hand from the rules."""

import itertools
from datetime import date

import pytest
from pyspark.sql import functions as F

from normlake.functions import quantity as qt
from normlake.operators import coverage as cv
from normlake.operators import documents as dc
from normlake.operators import extraction as ex
from normlake.operators import relate as rl
from normlake.operators import routing as ro
from normlake.operators import versions as vs
from normlake.operators import workflow as wf
from normlake.sources.html import head_of, paragraphs_of


@pytest.mark.parametrize("values,complete,ceiling,want", [
    (["A"], False, None, "YES"), (["B"], True, None, "NO"), (["B"], False, None, "UNKNOWN"), (None, False, None, "UNKNOWN"),
    (None, True, None, "NO"), ([], True, None, "NO"), (["B"], False, ["B"], "NO"), (["B"], False, ["A", "B"], "UNKNOWN")])
def test_list_fact(spark, values, complete, ceiling, want):
    df = spark.createDataFrame([(values, complete, ["A"], ceiling)], "v array<string>, c boolean, r array<string>, t array<string>")
    assert df.select(ro.word(ro.list_fact(F.col("v"), F.col("c"), F.col("r"), F.col("t")))).first()[0] == want


def test_decide_truth_table(spark):
    facts = [True, False, None]
    rows = [(a, b, u) for a, b in itertools.product(facts, facts) for u in (True, False)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, unclear boolean")
    got = ro.decide(df, [ro.gate("ENTITY", F.col("a"), F.lit(True)), ro.gate("ACTIVITY", F.col("b"), F.lit(True))], F.col("unclear"), F.lit(True))
    for r in got.collect():
        facts = (r.a, r.b)
        want = "UNKNOWN" if r.unclear else "DOES_NOT_APPLY" if False in facts else "UNKNOWN" if None in facts else "APPLIES"
        assert r.status == want, r


def test_unconstrained_scope_applies(spark):
    df = spark.createDataFrame([(None,)], "a boolean")
    r = ro.decide(df, [ro.gate("ENTITY", F.col("a"), F.lit(False))], F.lit(False), F.lit(False)).first()
    assert (r.status, r.reasons) == ("APPLIES", "NO_CONSTRAINT; GUIDANCE_ONLY")


@pytest.mark.parametrize("relations,want", [
    (["SUPPORTS", "CONFLICTS"], "CONFLICT"), (["SUPPORTS", "UNCLEAR"], "UNKNOWN"), (["SUPPORTS", "PARTIAL", "UNCLEAR"], "COVERS_TEXT"),
    (["PARTIAL"], "PARTIAL"), (["UNCLEAR"], "UNKNOWN"), (["UNRELATED"], "NO_EVIDENCE")])
def test_counted_coverage(spark, relations, want):
    df = spark.createDataFrame([(1, r, False) for r in relations], "d bigint, relation string, is_control boolean")
    assert cv.counted_coverage(df, ["d"]).first().coverage == want


def test_control_rows_never_cover_text(spark):
    df = spark.createDataFrame([(1, "SUPPORTS", True)], "d bigint, relation string, is_control boolean")
    r = cv.counted_coverage(df, ["d"]).first()
    assert (r.coverage, r.control_coverage) == ("NO_EVIDENCE", "SUPPORTS")


@pytest.mark.parametrize("digits,want", [("15.000", 15000.0), ("15.000,50", 15000.5), ("2,5", 2.5), ("15,000", 15000.0), ("1.5", 1.5)])
def test_digits(spark, digits, want):
    assert spark.createDataFrame([(digits,)], "d string").select(qt.digits_value(F.col("d"))).first()[0] == want


@pytest.mark.parametrize("duty,statement,way,want", [
    ("within 10 days", "within 5 days", "max", "STRICTER"), ("keep 8 years", "keep 10 years", "min", "STRICTER"), ("keep 8 years", "keep 5 years", "min", "WEAKER"),
    ("10 working days", "14 days", "max", "SAME"), ("GBP 100", "EUR 100", "cap", "INCOMPARABLE"), ("5%", "7%", "cap", "WEAKER"), ("5%", "5 days", "cap", "INCOMPARABLE")])
def test_compare(spark, duty, statement, way, want):
    df = spark.createDataFrame([(duty, statement)], "a string, b string")
    q = lambda c: F.get(qt.quantities(F.col(c)), F.lit(0))
    assert df.select(qt.compare(q("a"), q("b"), F.lit(way))).first()[0] == want


def test_equal_numbers_are_decided_by_the_comparator(spark):
    df = spark.createDataFrame([("GBP 100",)], "a string")
    q = F.get(qt.quantities(F.col("a")), F.lit(0))
    assert df.select(qt.compare(q, q, F.lit("floor"), F.lit(None), F.lit(">"))).first()[0] == "WEAKER"


def test_read_duties(spark):
    rows = [("If asked, a firm must not sell, unless exempt.",), ("We must act.",), ("Nothing here.",), ("A loss may be large.",)]
    got = [r.d for r in ex.read_duties(spark.createDataFrame(rows, "text string")).collect()]
    assert [d.status for d in got] == ["EXTRACTED", "INSUFFICIENT_EVIDENCE", "NO_EXPLICIT_OBLIGATION", "INSUFFICIENT_EVIDENCE"]
    assert (got[0].subject, got[0].modality, got[0].exception) == ("a firm", "MUST_NOT", "unless exempt")


@pytest.mark.parametrize("old,new,want", [
    ("within 10 days", "within 12 days", "DEADLINE_CHANGED"), ("GBP 5", "GBP 6 unless", "THRESHOLD_CHANGED; EXEMPTION_CHANGED"), ("a", "b", "TEXT_CHANGED"), ("a", "a", None),
    ("a  b", "a b", None), (None, "a", "TEXT_CHANGED"), ("an exceptional case", "a case", "TEXT_CHANGED"), ("keep it five years", "keep it six years", "DEADLINE_CHANGED"),
    ("5 EUR", "6 EUR", "THRESHOLD_CHANGED"), ("£10,000.", "£10,000 or more", "TEXT_CHANGED"), ("sekiz yıl saklar", "beş yıl saklar", "DEADLINE_CHANGED"), ("5 ayrı işlem", "6 ayrı işlem", "TEXT_CHANGED"),
    ("30 gün içinde", "30 günlük süre içinde", "TEXT_CHANGED"), ("A bank must act", "An insurer must act", "ENTITY_SCOPE_CHANGED"), ("A firm must act", "The firms must act", "TEXT_CHANGED"),
    ("yabancı dernekler", "yabancı vakıflar", "TEXT_CHANGED"), ("istisnası", "muafiyeti", "EXEMPTION_CHANGED"), ("on iş günü", "onay verir", "DEADLINE_CHANGED")])
def test_change_kinds(spark, old, new, want):
    df = spark.createDataFrame([(old, new)], "o string, n string")
    assert df.select(vs.change_kinds(F.col("o"), F.col("n"))).first()[0] == want


def test_claims_are_taken_in_order(spark):
    import random

    rng = random.Random(11)
    pairs, want = [], set()
    for case in range(6):
        taken = set()
        size = 25 if case == 0 else 4                               # one case holds most of the rows
        for e in range(size):
            liked = rng.sample(range(size), rng.randrange(1, size + 1))
            pairs += [(case, e, p, rank) for rank, p in enumerate(liked, 1)]
            free = [p for p in liked if p not in taken]
            if free:
                taken.add(free[0])
                want.add((case, e, free[0]))
    df = spark.createDataFrame(pairs, "case_id bigint, expectation bigint, prediction bigint, preference bigint")
    assert {(r.case_id, r.expectation, r.prediction) for r in rl.claim_in_order(df).collect()} == want


def test_ledger_has_a_line_for_every_row(spark):
    rows = [(1, "P1", "r", "f", False), (2, "P2", "r", "f", False), (3, "P2", "r", "g", False), (4, "P1", "s", "h", True)]
    exported, ledger = wf.export_rows(spark.createDataFrame(rows, "seq bigint, pack string, row_id string, fingerprint string, covered_auto boolean"))
    assert {r.seq: r.outcome for r in ledger.collect()} == {
        1: "EXPORTED", 2: "MERGED_SAME_DUTY_AND_TARGET", 3: "EXPORTED_PACKS_DISAGREE", 4: "EXCLUDED_COVERED_AUTO"}
    assert {(r.export_id, r.packs) for r in exported.collect()} == {("r", "P1; P2"), ("r:P2", "P2")}


def test_stale_approvals_are_refused(spark):
    export = spark.createDataFrame([("a", "f", "f"), ("b", "f", "edited"), ("c", "f", "f")], "row_id string, fingerprint string, recomputed string")
    entries = spark.createDataFrame(
        [("a", "f", "APPROVED", "x", 1), ("a", "f", "REJECTED", "x", 2), ("b", "f", "APPROVED", "x", 1), ("c", "old", "APPROVED", "x", 1), ("k", "f", "APPROVED", "x", 1),
         ("z", "f", "APPROVED", "x", 1)], "row_id string, fingerprint string, decision string, approver string, decided_at bigint")
    children = spark.createDataFrame([("k", "TASK:1")], "row_id string, task_id string")
    rows, problems = wf.apply_approvals(export, entries, children)
    assert {(r.row_id, r.status, r.earlier) for r in rows.collect()} == {("a", "REJECTED", 1), ("b", "PENDING", 0), ("c", "PENDING", 0)}
    assert {(r.row_id, r.problem) for r in problems.collect()} == {
        ("b", "EXPORT_MODIFIED"), ("c", "STALE_APPROVAL"), ("k", "APPROVE_THE_TASK"), ("z", "UNKNOWN_ROW")}


def test_html_paragraphs():
    html = ("<html><title>T</title><body><nav><p>menu</p></nav><main><h1>One</h1><p>first <b>bold</b></p><script>x</script>"
            "<ul><li>item <p>inside</p></li></ul><h2 id='s2'>Two</h2><p id='p'>a</p><p id='p'>b</p></main></body></html>")
    rows, problem = paragraphs_of(html)
    assert problem is None
    assert [(s, a, t) for s, a, _, t in rows] == [("One", None, "first bold"), ("One", None, "item inside"), ("s2", "p", "a"), ("s2", "p", "b")]
    assert paragraphs_of("<title>Just a moment</title><main><p>x</p></main>")[1] == "ACCESS_CHALLENGE"
    assert paragraphs_of("<p>x</p>")[1] == "NO_TITLE" and paragraphs_of("<title>T</title><mainline><p>x</p></mainline>")[1] == "NO_MAIN_CONTENT"
    assert paragraphs_of("<title>T</title><main></main>")[1] == "NO_PARAGRAPHS"


def test_html_containers_hidden_parts_and_dates():
    of = lambda body: [t for *_, t in paragraphs_of(f"<title>T</title>{body}")[0]]
    assert of("<article><p>a</p></article><div role='main'><p>b</p></div>") == ["b"] and of("<div role=main><p>b</p></div><main><p>c</p></main>") == ["c"]
    assert of("<main><p>c</p></main><article data-history-node-id='5'><p>d</p></article>") == ["d"]
    assert of("<main><div aria-hidden='true'><p>x</p><div><p>y</p></div></div><p aria-hidden='false'>z</p><aside><p>w</p></aside></main><p>v</p>") == ["z"]
    assert of("<main><p>a<p>b</p>c</main>") == ["a b c"] and of("<main></b><p>a</i>b<br/>c</p></main>") == ["a b c"] and of("<main><table><tr><td>1</td><td>2</td></tr></table></main>") == ["1 2"]
    meta = "<meta name='date' content='2020-01-02'><meta property='article:published_time' content='x 2021-03-04T1'><meta name='effective-date' content='2022-02-30'>"
    assert head_of(f"<title>T</title>{meta}<main><h1>Real <i>title</i></h1></main>")[:4] == ("Real title", date(2021, 3, 4), None, None)
    assert head_of("")[3] == "NO_TITLE"


def test_cut_points_cover_the_text():
    text = "Sentence number one is here. " * 300
    cuts = dc.cut_points(text)
    assert [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]] and cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(b - a <= dc.CHUNK + dc.TAIL_MIN for a, b in cuts)


def test_a_reference_without_its_semicolon_is_text():
    html = "<html><body><article><h1>a&amp;b and&amp</h1><p>x &lt y&lt;z &copy &#38; &#38</p></article></body></html>"
    assert head_of(html)[0] == "a&b and&amp"
    rows, problem = paragraphs_of(html)
    assert problem is None and [(r[0], r[3]) for r in rows] == [("a&b and&amp", "x &lt y<z &copy & &#38")]
