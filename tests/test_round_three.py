"""Findings of the third round: what they said, on small tables."""

import random
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import functions as F

from normlake.functions import vocabulary as vc
from normlake.operators import documents as dc
from normlake.operators import entities as en
from normlake.operators import extraction as ex
from normlake.operators import routing as ro
from normlake.operators import versions as vs
from normlake.operators import workflow as wf
from normlake.operators.alignment import clause_changes, likeness
from normlake.plans import details


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_clauses_travel_once(spark):
    rows = spark.createDataFrame([("v", n, f"clause {n}") for n in range(20)], "v string, number bigint, text string")
    assert exchanges(clause_changes(rows, rows.where("number % 3 > 0"), ["v"])) == 1


def test_likeness_is_the_ratio_of_difflib():
    r = random.Random(3)
    for n in range(3000):
        letters = "ab" if n % 3 == 0 else "abc " if n % 3 == 1 else "etaoin shrdlu"
        old = "".join(r.choice(letters) for _ in range(r.randrange(30)))
        new = "".join(c for c in old if r.random() < 0.8) + old[: r.randrange(8)] if n % 2 else "".join(r.choice(letters) for _ in range(r.randrange(30)))
        want, floor = SequenceMatcher(None, old, new, autojunk=False).ratio(), r.choice((0.0, 0.6, 0.8))
        assert likeness(old, new, floor) == (want if want >= floor else None)
        assert likeness(old, new, want) == want


def test_articles_by_nan_and_null(spark):
    nan = float("nan")
    old = spark.createDataFrame([(nan, 1, "one"), (nan, 2, "two"), (None, 1, "one"), (0.5, 1, "one")], "v double, number bigint, text string")
    new = spark.createDataFrame([(nan, 1, "one"), (None, 1, "one"), (None, 2, "three"), (0.5, 1, "one")], "v double, number bigint, text string")
    got = clause_changes(old, new, ["v"]).collect()
    assert sorted((str(g.v), g.kind, g.old_text, g.new_text) for g in got) == [("None", "ADDED", None, "three"), ("nan", "REMOVED", "two", None)]


def readings(df):
    """How often the words for an insurer are looked for in a plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("insurers?")


def test_a_text_is_read_for_its_kinds_once(spark):
    texts = spark.createDataFrame([("Any insurer must report.", "Insurers in 5 days must report.")], "old_text string, new_text string")
    assert readings(texts.select(vs.change_kinds(F.col("old_text"), F.col("new_text")).alias("kinds"))) == 1
    assert readings(en.required_parties(texts, "old_text", "new_text")) == 1


def test_words_looked_for_first_stand_in_every_match():
    assert vc.needed(r"\be-?money|\bvak[ıi]f") == ["money", "vak"] and vc.needed(r"\bcompan(?:y|ies)\b") == ["compan"] and vc.needed(r"\b[a-z]+\b") is None
    for table in (vc.COUNTERPARTIES, vc.OBLIGED, en.COMPANY_KINDS, en.CUSTOMER_FAMILIES):
        for _, pattern in table:
            words = vc.needed(pattern)
            assert words and all(any(w in sample for w in words) for sample in samples(pattern))


def samples(pattern):
    """A text for each way through a pattern of words, groups, classes and absent letters."""
    import re._parser as parser

    def ways(parts):
        out = [""]
        for kind, value in parts:
            if str(kind) == "LITERAL":
                out = [o + chr(value) for o in out]
            elif str(kind) == "IN":
                out = [o + chr(v) for o in out for _, v in value]
            elif str(kind) == "BRANCH":
                out = [o + w for o in out for branch in value[1] for w in ways(branch)]
            elif str(kind) == "SUBPATTERN":
                out = [o + w for o in out for w in ways(value[3])]
            elif str(kind) == "MAX_REPEAT":
                out = [o + w for o in out for w in ("", *ways(value[2]))]
        return out

    return ways(parser.parse(pattern))


def test_texts_are_not_taken_apart_for_short_needles(spark):
    needles = [(1, "b c d"), (2, "x"), (3, "z b"), (4, ""), (5, "d e"), (6, None)]
    texts = [(i, "a b  c d e f") for i in range(4)] + [(9, "c d x"), (10, "zz b c dd"), (11, None), (12, "x"), (13, "")]
    found = dc.containing(spark.createDataFrame(needles, "nid bigint, needle string"), spark.createDataFrame(texts, "tid bigint, text string"), "nid", "tid")
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
    flat = lambda s: " ".join((s or "").split())
    assert {tuple(r) for r in found.collect()} == {(i, j) for i, a in needles for j, b in texts if flat(a) and flat(a) in flat(b)}


def test_citations_are_resolved_without_a_join(spark):
    from normlake.plans import load_all
    from normlake.plans.registry import REGISTRY

    load_all()
    plan = REGISTRY["jon04_implied_books"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    cited = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), (None, 1), ("c", None)], "book string, number bigint")
    there = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), (None, 1), ("c", None), ("z", 9)], "book string, number bigint")
    got = {tuple(r) for r in dc.resolve_counted(cited, there, ["book", "number"]).collect()}
    assert got == {("a", 1, 2, "RESOLVED"), ("a", 2, 1, "AMBIGUOUS"), ("b", 1, 1, "MISSING"), (None, 1, 1, "MISSING"), ("c", None, 1, "MISSING")}


def test_a_log_is_judged_before_its_rows_are_numbered(spark):
    from normlake.plans import load_all
    from normlake.plans.registry import REGISTRY

    load_all()
    lines = REGISTRY["win09_chain_breaks"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = lines[: next(n for n, line in enumerate(lines) if "row_number" in line)]
    assert not [line for line in above if "sha2(" in line]


def test_a_groups_documents_meet_its_entities_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ro, "BLOCK_IDS", 3)
    r = random.Random(16)
    classes = [None, [], ["SELL"], ["IMPORT"]]
    docs = [(d if d else None, r.choice(("GROUP", "GROUP", "LEGAL_ENTITY")), r.choice((1, 2, None)), r.random() < 0.8, r.choice(([], ["SELL"]))) for d in range(40)]
    targets = [(t if t else None, r.choice((1, 2, None)), r.choice(classes), r.random() < 0.5) for t in range(30)]
    want = []
    for doc, level, owner, inherits, limited in docs:
        for target, group, acts, complete in targets:
            if owner is not None and (owner == group and inherits if level == "GROUP" else owner == target):
                want.append((target, doc, level, "YES" if not limited or "SELL" in (acts or []) else "NO" if complete else "UNKNOWN"))
    got = ro.documents_in_force(spark.createDataFrame(docs, "document_id bigint, owner_level string, owner_id bigint, inherits boolean, limited_to array<string>"),
                                spark.createDataFrame(targets, "target_id bigint, group_id bigint, activity_classes array<string>, activities_complete boolean"))
    assert sorted(map(str, want)) == sorted(str(tuple(g)) for g in got.collect())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") == 2  # activities are compared before ids are paired


def test_equal_sentences_of_a_batch_are_read_once(monkeypatch):
    read, seen = ex._read, []
    monkeypatch.setattr(ex, "_read", lambda text, stands: seen.append(text) or read(text, stands))
    got = ex._reader(("modality", "exception"))(pa.array(["A firm must pay, unless exempt.", None, "A firm must pay, unless exempt."])).to_pylist()
    duty = {"modality": "MUST", "exception": "unless exempt"}
    assert got == [duty, {"modality": None, "exception": None}, duty] and len(seen) == 2


def test_only_the_named_parts_of_a_duty_come_back(spark):
    units = spark.createDataFrame([("A firm must pay.",), ("",), (None,)], "text string")
    assert ex.read_duties(units, "status", "subject").schema["d"].dataType.names == ["status", "subject"]
    assert [tuple(r.d) for r in ex.read_duties(units, "status", "subject").collect()] == [("EXTRACTED", "A firm")] + [("NO_EXPLICIT_OBLIGATION", None)] * 2


def test_ledger_rows_travel_once(spark):
    rows = spark.createDataFrame([(1, "P1", "r", "f", False), (1, "P2", "r", "f", False), (2, "P2", "r", "g", False), (3, "P1", "s", "h", True), (4, "P1", "s", "h", False),
                                  (0, "P1", "t", "f", None), (5, "P3", "t", "f", False), (6, "P1", None, "f", False), (7, "P1", "u", "f", None)],
                                 "seq bigint, pack string, row_id string, fingerprint string, covered_auto boolean")
    ledger = wf.export_rows(rows)[1]
    assert exchanges(ledger) == 1
    # of two equal rows one is exported, as one of them is numbered first
    assert sorted((r.seq, r.outcome) for r in ledger.collect()) == [
        (0, "MERGED_SAME_DUTY_AND_TARGET"), (1, "EXPORTED"), (1, "MERGED_SAME_DUTY_AND_TARGET"), (2, "EXPORTED_PACKS_DISAGREE"), (3, "EXCLUDED_COVERED_AUTO"),
        (4, "EXPORTED"), (5, "EXPORTED"), (6, "EXPORTED_PACKS_DISAGREE"), (7, "EXPORTED_PACKS_DISAGREE")]


def test_clauses_of_the_anchor_audit_are_read_and_travel_once(spark):
    audit = details.fun27_anchor_audit(spark, "/root/testdata/sf0.001")
    assert exchanges(audit) == 1 and audit._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_pieces_leave_by_letters(spark, monkeypatch):
    monkeypatch.setattr(dc, "SLICE_LETTERS", 5000)
    docs = spark.createDataFrame([(n, "A line of it. " * 150) for n in range(40)] + [(40, ""), (41, None)], "doc_id bigint, text string").coalesce(1)
    got = dc.pieces(docs, "doc_id")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    joined = {}
    for r in sorted(got.collect(), key=lambda r: (r.doc_id, r.seq)):
        joined[r.doc_id] = joined.get(r.doc_id, "") + r.text
    assert joined == {n: "A line of it. " * 150 for n in range(40)}
