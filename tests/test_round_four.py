"""Findings of the fourth round: notes of an article read in one pass, markers and sentences read where they can be, ids paired by the block."""

from __future__ import annotations

from datetime import date

from normlake.functions import duties as du
from normlake.functions import segmentation as sg
from normlake.functions.amendments import clause_notes
from normlake.operators import amendments as am
from normlake.operators import readers as rd
from normlake.operators import routing as ro
from normlake.plans import statutes as st

ARTICLE = ("(Yeniden düzenleme: 24/5/2013-6487/2 md.)\n(1) (Değişik:RG-3/4/2011-28769) A firm must keep it. A bank may sell. (Ek cümle:5/6/2012-7584/2 md.) Ek hüküm uygulanır.\n"
           "(2) Firms must keep:\na) the first copy,\nb) (Değişik bent: 7/8/2014-1 md.) the second copy; and\nat all times.")


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clause_notes_are_read_in_one_pass(spark):
    articles = spark.createDataFrame([(7, ARTICLE, "art. 7"), (8, "(1) Firms must.", "art. 8"), (None, ARTICLE, "art. 9")], "version_id bigint, text string, label string")
    notes = am.clause_notes(articles)
    plan = _plan(notes)
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("MapInArrow") == 1
    got = sorted(tuple(r) for r in notes.collect())
    assert {r[0] for r in got} == {7}  # no note, no row; no key, no row
    article = [("art. 7/f.1/c.1", 0), ("art. 7/f.1/c.2", 0), ("art. 7/f.1/c.3", 0), ("art. 7/f.2/b.a", 0), ("art. 7/f.2/b.b", 0)]
    assert [(r[1], r[2]) for r in got if r[-1] == "ARTICLE"] == article
    rest = [tuple(r[1:]) for r in got if r[-1] != "ARTICLE"]
    assert rest == [("art. 7/f.1/c.1", 1, "CHANGED", "UNSPECIFIED", date(2011, 4, 3), "28769", "OWN"), ("art. 7/f.1/c.2", 1, "CHANGED", "UNSPECIFIED", date(2011, 4, 3), "28769", "PARAGRAPH"),
                    ("art. 7/f.1/c.3", 1, "CHANGED", "UNSPECIFIED", date(2011, 4, 3), "28769", "PARAGRAPH"), ("art. 7/f.1/c.3", 2, "ADDED", "SENTENCE", date(2012, 6, 5), "7584/2 md", "OWN"),
                    ("art. 7/f.2/b.b", 3, "CHANGED", "BENT", date(2014, 8, 7), "1 md", "OWN")]


def test_clause_notes_of_odd_texts():
    assert clause_notes(None) == clause_notes("") == clause_notes("(1) Firms must.", "L") == []
    assert clause_notes("(Ek:1/2/2010-5/1 md.)", "L") == []  # no clause to hold for
    assert [(n.ref, n.level) for n in clause_notes("A firm must keep it.\n(Ek:1/2/2010-5/1 md.)", None)] == []  # nothing behind it


def test_articles_travel_as_keys(spark, tmp_path):
    rows = [(1, 5, 2, 1, 3.0), (1, 6, 3, 2, 4.0), (2, 7, 4, 1, 5.0)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = st.noted_articles(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(l_orderkey" in plan  # wording is put together behind it
    assert "REPARTITION_BY_NUM" in plan  # and not in fewer tasks because keys are few bytes


def test_latest_notes_sort_one_value(spark):
    rows = [(1, "a", 0, "CHANGED", date(2010, 1, 1), "OWN"), (1, "a", 1, "ADDED", date(2011, 1, 1), "PARAGRAPH"), (1, "a", 2, "REPEALED", date(2011, 1, 1), "OWN"), (1, "b", 3, "ADDED", None, "OWN")]
    latest = am.latest_notes(spark.createDataFrame(rows, "version_id bigint, ref string, note_seq int, action string, dated date, level string"))
    assert latest.columns == ["version_id", "ref", "notes", "own", "action", "level", "dated"] and "max_by" not in _plan(latest)
    assert sorted(map(tuple, latest.collect())) == [(1, "a", 3, 2, "ADDED", "PARAGRAPH", date(2011, 1, 1)), (1, "b", 1, 1, "ADDED", "OWN", None)]


def test_readers_hand_on_what_is_asked_for(spark):
    df = spark.createDataFrame([(1, "A firm must keep it. It may sell."), (2, "A firm must keep it. It may sell."), (3, "Nothing.")], "id int, text string")
    for again in (True, False):
        got = rd.laterally(df, "duty_markers", "text", keep=("id",), give=("mode",), again=again)
        assert got.columns == ["id", "mode"] and sorted(map(tuple, got.collect())) == [(1, "MAY"), (1, "MUST"), (2, "MAY"), (2, "MUST")]
    assert sorted(r[0] for r in rd.laterally(df, "duty_markers", "text", keep=("id",), give=()).collect()) == [1, 1, 2, 2]


def test_words_that_cannot_be_markers_are_not_read(monkeypatch):
    read = []
    whole = du._turkish_marker
    monkeypatch.setattr(du, "_turkish_marker", lambda words, n, text: read.append(words[n].group()) or whole(words, n, text))
    assert [m.word for m in du.markers("The other customer must transfer it after their year, per number.")] == ["must"]
    assert read == ["their"]
    assert [m.word for m in du.markers("Bankalar yıllık raporu saklar. Dernekler mümkün olan hallerde sunmakla yükümlüdür.")] == ["saklar", "yükümlüdür"]


def test_sentences_without_a_stop_are_not_walked(monkeypatch):
    class Signs:
        def finditer(self, *_):
            raise AssertionError("walked")

    monkeypatch.setattr(sg, "_SIGNS", Signs())
    text = "(1) A firm must keep it, for 5 years (see Art. 5 no. 3). "
    assert sg.sentence_spans(text) == [(0, len(text) - 1)] and sg.sentence_spans(" (Ek:1/2/2010-5 md.)") == []


def test_a_pair_of_blocks_gives_few_rows(spark):
    rows = spark.range(4000).selectExpr("7L AS owner_id", "id AS document_id")
    blocks, n = ro._blocks(rows, ["owner_id"], "document_id")
    sizes = [len(r["_document_ids"]) for r in blocks.collect()]
    assert len(sizes) == n and sum(sizes) == 4000 and max(sizes) ** 2 < 65_536
    docs = rows.selectExpr("document_id", "'GROUP' AS owner_level", "owner_id", "true AS inherits", "CASE WHEN document_id % 2 = 0 THEN array('SELL') ELSE array() END AS limited_to").where("document_id < 700")
    targets = spark.range(600).selectExpr("id AS target_id", "7L AS group_id", "array('SELL') AS activity_classes", "true AS activities_complete")
    got = ro.documents_in_force(docs, targets)
    assert (got.count(), got.distinct().count(), got.where("covers <> 'YES'").count()) == (420_000, 420_000, 0)
