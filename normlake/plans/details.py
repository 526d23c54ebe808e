"""Smaller operators with a query of their own: views, ladders, audits, parsed cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import ratio4
from ..operators import documents as dc
from ..operators import extraction as ex
from ..operators import relate as rl
from ..operators import retrieval as rt
from ..operators import scoring as sc
from ..sources.tables import table
from . import adapters as ad
from . import sqltext as sq
from .analysis import RELATE_SQL, REPLAY_SQL, related
from .reading import DUTIES_SQL, duties
from .registry import query
from .scoring import RUN_METRICS_SQL, run_metrics


@query("src03_rulebook_cards", "SRC03", sql=f"""
WITH {sq.provisions('p')}, c AS (SELECT version_id, section, number, l_suppkey % 13 = 0 AS deleted, l_partkey % 17 = 0 AS other_chapter FROM p),
d AS (SELECT version_id, section, number, count(*) AS n FROM c WHERE NOT deleted AND NOT other_chapter GROUP BY ALL)
SELECT version_id, count(*) FILTER (NOT deleted AND NOT other_chapter AND n = 1)::BIGINT AS provisions, count(*) FILTER (deleted)::BIGINT AS deleted, count(*) FILTER (NOT deleted AND other_chapter)::BIGINT AS other_chapter,
  count(*) FILTER (NOT deleted AND NOT other_chapter AND n > 1)::BIGINT AS duplicate_locators FROM c LEFT JOIN d USING (version_id, section, number) GROUP BY version_id""")
def src03_rulebook_cards(spark, sf):
    cards = ad.provisions(spark, sf).select(
        "version_id", "section", "number", (F.col("l_suppkey") % 13 == 0).alias("deleted"), (F.col("l_partkey") % 17 == 0).alias("other"))
    usable = ~F.col("deleted") & ~F.col("other")
    # counted per locator first, so a locator repeated many times is one row
    per = cards.groupBy("version_id", "section", "number").agg(
        F.count_if(usable).alias("n"), F.count_if("deleted").alias("gone"), F.count_if(~F.col("deleted") & F.col("other")).alias("elsewhere"))
    return per.groupBy("version_id").agg(
        F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("provisions"), F.sum("gone").alias("deleted"), F.sum("elsewhere").alias("other_chapter"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_locators"))


@query("src18_last_records", "SRC18", sql=f"WITH {REPLAY_SQL} SELECT key, r.answer AS answer, r.quote AS quote, r.missing AS missing FROM lst")
def src18_last_records(spark, sf):
    doc = F.col("doc_id")
    rec = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.sha2("text", 256).alias("key"), doc.alias("seq"), F.when(doc % 9 == 0, F.lit(None)).when(F.col("quality") == 1, "STATES_DUTY").otherwise("OTHER").alias("answer"),
        F.when(doc % 4 == 0, F.concat(F.substring("text", 1, 20), F.lit("@"))).otherwise(F.substring("text", 5, 30)).alias("quote"),
        F.when(F.col("toxic") == 1, "x").otherwise("").alias("missing"))
    return rec.groupBy("key").agg(F.max_by(F.struct("answer", "quote", "missing"), "seq").alias("r")).select("key", "r.*")


@query("src19_questionnaire_answers", "SRC19", sql="""
WITH l AS (SELECT user_id AS question, event_type AS value, CASE event_id % 5 WHEN 0 THEN 'E' WHEN 1 THEN 'H' WHEN 2 THEN '' WHEN 3 THEN 'X' ELSE 'E' END AS answer FROM events),
k AS (SELECT question, value, min(answer) FILTER (answer IN ('E', 'H')) AS lo, max(answer) FILTER (answer IN ('E', 'H')) AS hi, count(*) FILTER (answer = '') AS blank, count(*) FILTER (answer = 'X') AS unknown FROM l GROUP BY ALL)
SELECT question, coalesce(string_agg(value, '; ' ORDER BY value) FILTER (lo = 'E' AND hi = 'E'), '') AS present, count(*) FILTER (lo <> hi)::BIGINT AS contradicted, sum(blank)::BIGINT AS blanks, sum(unknown)::BIGINT AS unknown_values,
  bool_and(lo IS NOT NULL AND lo = hi) AS list_complete FROM k GROUP BY question""")
def src19_questionnaire_answers(spark, sf):
    rest = F.col("event_id") % 5
    answer = F.when(rest.isin(0, 4), "E").when(rest == 1, "H").when(rest == 2, "").otherwise("X")
    lines = table(spark, sf, "events").select(F.col("user_id").alias("question"), F.col("event_type").alias("value"), answer.alias("answer"))
    valid = F.when(F.col("answer").isin("E", "H"), F.col("answer"))
    per = lines.groupBy("question", "value").agg(
        F.min(valid).alias("lo"), F.max(valid).alias("hi"), F.count_if(F.col("answer") == "").alias("blank"), F.count_if(F.col("answer") == "X").alias("unknown"))
    yes = (F.col("lo") == "E") & (F.col("hi") == "E")
    return per.groupBy("question").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(yes, F.col("value")))), "; ").alias("present"), F.count_if(F.col("lo") != F.col("hi")).alias("contradicted"),
        F.sum("blank").alias("blanks"), F.sum("unknown").alias("unknown_values"),
        F.bool_and(F.col("lo").isNotNull() & F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))).alias("list_complete"))


@query("src22_two_leg_comparison", "SRC22", sql=f"""WITH {RUN_METRICS_SQL},
w AS (SELECT metric, max(value) FILTER (side = 'base') AS a, max(value) FILTER (side = 'run') AS b FROM metrics GROUP BY metric)
SELECT metric, a, b, CASE WHEN a IS NULL OR b IS NULL THEN 'NOT_MEASURED' WHEN a = b THEN 'EQUAL' WHEN (b > a) = (metric IN ('accuracy')) THEN 'B' ELSE 'A' END AS better,
  CASE WHEN metric = 'wall_seconds' THEN 'relative' ELSE 'points' END AS delta_kind FROM w""")
def src22_two_leg_comparison(spark, sf):
    wide = run_metrics(spark, sf).groupBy("metric").pivot("side", ["base", "run"]).agg(F.max("value")).select(
        "metric", F.col("base").alias("a"), F.col("run").alias("b"))
    a, b = F.col("a"), F.col("b")
    better = (
        F.when(a.isNull() | b.isNull(), "NOT_MEASURED").when(a == b, "EQUAL").when((b > a) == F.col("metric").isin("accuracy"), "B").otherwise("A"))
    return wide.select("metric", "a", "b", better.alias("better"), F.when(F.col("metric") == "wall_seconds", "relative").otherwise("points").alias("delta_kind"))


@query("fun21_conflict_gate", "FUN21", sql=f"""
WITH {RELATE_SQL}, gt AS (SELECT version_id, number, ov >= 0.5 AS obj, split_part(dt, ' ', 2) = split_part(pt, ' ', 2) AS act, (dm = 'MUST_NOT') <> (pm = 'MUST_NOT') OR coalesce(pd > dd, false) OR coalesce(pl > dl, false) AS opp, ok FROM m)
SELECT CASE WHEN NOT obj THEN 'OBJECT' WHEN NOT act THEN 'ACTOR' WHEN NOT opp THEN 'EFFECT' WHEN NOT ok THEN 'SCOPE' END AS stage, count(*)::BIGINT AS pairs FROM gt GROUP BY 1""")
def fun21_conflict_gate(spark, sf):
    second = lambda c: F.get(F.split(c, " "), F.lit(1))
    opposed = (
        ((F.col("duty_modality") == "MUST_NOT") != (F.col("statement_modality") == "MUST_NOT"))
        | F.coalesce(F.col("statement_days") > F.col("duty_days"), F.lit(False)) | F.coalesce(F.col("statement_limit") > F.col("duty_limit"), F.lit(False)))
    stage = rl.conflict_gate(tx.containment(F.col("wanted"), F.col("offered")) >= 0.5, second("duty") == second("statement"), opposed, F.col("compatible"))
    return related(spark, sf).groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("pairs"))


@query("fun27_anchor_audit", "FUN27", sql=f"""
WITH {DUTIES_SQL}, e AS (SELECT * FROM duty WHERE status = 'EXTRACTED'), one AS (SELECT version_id, number, min(subject) AS s, min(modality) AS m, min(split_part(action, ' ', 1)) AS a, min(exc) AS x, min(section) AS sec FROM e GROUP BY ALL HAVING count(*) = 1),
j AS (SELECT l.version_id, l.number, l.s AS s1, r.s AS s2, l.m AS m1, r.m AS m2, l.a AS a1, r.a AS a2, l.x AS x1, r.x AS x2 FROM one l JOIN one r ON l.version_id = r.version_id AND r.number = l.number + 1)
SELECT version_id, number, concat_ws('; ', CASE WHEN s1 <> s2 THEN 'ACTOR' END, CASE WHEN m1 <> m2 THEN 'EFFECT' END, CASE WHEN x1 <> x2 THEN 'EXCEPTION' END) AS mismatches,
  CASE WHEN s1 <> s2 OR m1 <> m2 OR coalesce(x1 <> x2, false) THEN 'MISMATCH' WHEN a1 = a2 THEN 'MATCH' ELSE 'UNRESOLVED' END AS overall FROM j""")
def fun27_anchor_audit(spark, sf):
    read = duties(spark, sf, "status", "subject", "modality", "action", "exception").filter("d.status = 'EXTRACTED' AND version_id IS NOT NULL AND number IS NOT NULL")
    facts = read.select("version_id", "number", F.col("d.subject").alias("s"), F.col("d.modality").alias("m"), F.substring_index("d.action", " ", 1).alias("a"), F.col("d.exception").alias("x"))
    # the articles of a version travel and are sorted once; the next one is the row behind
    alone = facts.repartition("version_id").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("version_id", "number"))).filter("n = 1").drop("n")
    after = F.lead(F.struct("number", *"smax")).over(Window.partitionBy("version_id").orderBy("number"))
    both = alone.withColumn("after", after).filter("after.number = number + 1").select("*", *[F.col(f"after.{c}").alias(c + "2") for c in "smax"])
    pair = lambda c: (F.col(c), F.col(c + "2"))
    audit = rl.anchor_audit({"ACTOR": pair("s"), "EFFECT": pair("m"), "EXCEPTION": pair("x")}, F.col("a") == F.col("a2"))
    return both.withColumn("v", audit).select("version_id", "number", "v.mismatches", "v.overall")


@query("fun31_scoped_duties", "FUN31", sql=f"""
WITH {DUTIES_SQL}, sc AS (SELECT version_id, string_agg(DISTINCT section, ',' ORDER BY section) AS scope_article FROM duty WHERE number = 1 GROUP BY ALL),
x AS (SELECT DISTINCT d.version_id, d.number, d.subject, CASE WHEN l_suppkey % 3 = 0 THEN section END AS own, scope_article FROM duty d LEFT JOIN sc USING (version_id) WHERE status = 'EXTRACTED')
SELECT version_id, number, coalesce(own, scope_article, 'UNCLEAR') AS scope, CASE WHEN own IS NOT NULL THEN 'CLAUSE' WHEN scope_article IS NOT NULL THEN 'SCOPE_ARTICLE' ELSE 'NONE' END AS basis,
  sha256(version_id || '|' || number || '|' || subject || '|' || coalesce(own, scope_article, 'UNCLEAR')) AS obligation_id FROM x""")
def fun31_scoped_duties(spark, sf):
    from ..operators.workflow import fingerprint

    d = duties(spark, sf, "status", "subject")
    # of the first articles only the section counts, which is there unread
    article = ad.provisions(spark, sf).filter("number = 1").groupBy("version_id").agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("scope_article"))
    x = d.filter("d.status = 'EXTRACTED'").select(
        "version_id", "number", "d.subject", F.when(F.col("l_suppkey") % 3 == 0, F.col("section")).alias("own")).join(article, "version_id", "left").distinct()
    scope = F.coalesce("own", "scope_article", F.lit("UNCLEAR"))
    basis = F.when(F.col("own").isNotNull(), "CLAUSE").when(F.col("scope_article").isNotNull(), "SCOPE_ARTICLE").otherwise("NONE")
    return x.select("version_id", "number", scope.alias("scope"), basis.alias("basis"),
                    fingerprint(F.col("version_id"), F.col("number"), F.col("subject"), scope).alias("obligation_id"))


@query("fun35_stable_keys", "FUN35", sql=f"""
WITH {sq.provisions('p')}
SELECT version_id || '/art.' || number || '/' || section AS base, sha256(array_to_string(list_sort({sq.stems('text')}), ':')) AS fingerprint, count(*)::BIGINT AS n FROM p GROUP BY ALL""")
def fun35_stable_keys(spark, sf):
    key = F.concat(F.col("version_id"), F.lit("/art."), F.col("number"), F.lit("/"), F.col("section"))
    mark = F.sha2(F.array_join(F.array_sort(tx.stems(F.col("text"))), ":"), 256)
    return ad.provisions(spark, sf).groupBy(key.alias("base"), mark.alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


@query("fun39_parsed_decisions", "FUN39", sql="""
WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'coverage: PARTIAL -> COVERS_TEXT' WHEN 1 THEN 'applicability: APPLIES->UNKNOWN (see note)' WHEN 2 THEN 'ok' ELSE 'conflict = false -> true' END AS cell FROM labels)
SELECT doc_id, nullif(regexp_extract(cell, '^([a-z]+) *[:=] *([A-Za-z_]+) *-> *([A-Za-z_]+)', 1), '') AS field, nullif(regexp_extract(cell, '^([a-z]+) *[:=] *([A-Za-z_]+) *-> *([A-Za-z_]+)', 2), '') AS from_value,
  nullif(regexp_extract(cell, '^([a-z]+) *[:=] *([A-Za-z_]+) *-> *([A-Za-z_]+)', 3), '') AS to_value, CASE WHEN regexp_matches(cell, '->') THEN 'CHANGE' ELSE 'NOTE' END AS kind FROM c""")
def fun39_parsed_decisions(spark, sf):
    rest = F.col("doc_id") % 4
    cell = (
        F.when(rest == 0, "coverage: PARTIAL -> COVERS_TEXT").when(rest == 1, "applicability: APPLIES->UNKNOWN (see note)").when(rest == 2, "ok")
        .otherwise("conflict = false -> true"))
    pattern = "^([a-z]+) *[:=] *([A-Za-z_]+) *-> *([A-Za-z_]+)"
    part = lambda i: F.nullif(F.regexp_extract("cell", pattern, i), F.lit(""))
    return table(spark, sf, "labels").withColumn("cell", cell).select(
        "doc_id", part(1).alias("field"), part(2).alias("from_value"), part(3).alias("to_value"),
        F.when(F.col("cell").contains("->"), "CHANGE").otherwise("NOTE").alias("kind"))


@query("fun45_materialized_answers", "FUN45", sql="""
WITH r AS (SELECT event_id, event_type, CASE WHEN event_id % 10 = 0 THEN '{broken' ELSE props END AS raw FROM events), j AS (SELECT event_id, event_type, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.k')::BIGINT END AS k FROM r)
SELECT event_type, CASE WHEN k IS NULL THEN 'REJECTED' WHEN k > 90 THEN 'OUT_OF_RANGE' ELSE 'OK' END AS state, count(*)::BIGINT AS n, sum(k)::BIGINT AS total FROM j GROUP BY ALL""")
def fun45_materialized_answers(spark, sf):
    raw = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props"))
    k = F.from_json(raw, "k bigint")["k"]
    rows = table(spark, sf, "events").select("event_type", k.alias("k"))
    state = F.when(F.col("k").isNull(), "REJECTED").when(F.col("k") > 90, "OUT_OF_RANGE").otherwise("OK")
    return rows.groupBy("event_type", state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


TAXONOMY = (("status <> 'OK'", "MODEL_FAILURE"), ("expected = 'UNKNOWN' AND predicted <> 'UNKNOWN'", "LABEL_DISPUTED"), ("predicted = 'UNKNOWN'", "FACT_MISSING"),
            ("expected = 'APPLIES'", "FALSE_EXCLUSION"), ("predicted = 'APPLIES'", "FALSE_INCLUSION"))


@query("agg22_error_taxonomy", "AGG22", sql=f"""
WITH {sq.SCORED}, {sq.CALLS}, j AS (SELECT scored.doc_id, expected, predicted, coalesce(calls.status, 'OK') AS status, calls.model FROM scored LEFT JOIN calls ON call_id = doc_id WHERE expected <> predicted),
k AS (SELECT model, CASE {" ".join(f"WHEN {c} THEN '{n}'" for c, n in TAXONOMY)} ELSE 'OTHER' END AS category FROM j) SELECT model, category, count(*)::BIGINT AS n FROM k GROUP BY ALL""")
def agg22_error_taxonomy(spark, sf):
    traces = ad.calls(spark, sf).select(F.col("call_id").alias("doc_id"), "status", "model")
    wrong = ad.scored(spark, sf).filter("expected <> predicted").join(traces, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("OK")))
    primary, _ = sc.first_rule(*[(F.expr(c), n) for c, n in TAXONOMY])
    return wrong.groupBy("model", F.coalesce(primary, F.lit("OTHER")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("agg28_reader_agreement", "AGG28", sql=f"""
WITH {sq.READINGS}, o AS (SELECT duty_id, strong, CASE WHEN relation = 'CONFLICTS' THEN 0 WHEN relation = 'UNRELATED' THEN 1 WHEN relation = 'UNCLEAR' THEN 2 WHEN relation = 'PARTIAL' THEN 3 ELSE 4 END AS k FROM readings),
w AS (SELECT duty_id, min(k) FILTER (strong) AS a, min(k) FILTER (NOT strong) AS b FROM o GROUP BY ALL)
SELECT CASE WHEN a IS NULL OR b IS NULL THEN 'ONE_READER' WHEN a = b THEN 'AGREE' WHEN a = 0 OR b = 0 THEN 'CONFLICT_DISPUTED' ELSE 'DIFFER' END AS agreement, count(*)::BIGINT AS clauses FROM w GROUP BY 1""")
def agg28_reader_agreement(spark, sf):
    words = ("CONFLICTS", "UNRELATED", "UNCLEAR", "PARTIAL", "SUPPORTS")           # a conflict decides, then the weakest word
    order = F.array_position(F.array(*[F.lit(w) for w in words]), F.col("relation"))
    w = ad.readings(spark, sf).groupBy("duty_id").agg(F.min(F.when(F.col("strong"), order)).alias("a"), F.min(F.when(~F.col("strong"), order)).alias("b"))
    a, b = F.col("a"), F.col("b")
    agreement = (
        F.when(a.isNull() | b.isNull(), "ONE_READER").when(a == b, "AGREE").when((a == 1) | (b == 1), "CONFLICT_DISPUTED").otherwise("DIFFER"))
    return w.groupBy(agreement.alias("agreement")).agg(F.count(F.lit(1)).alias("clauses"))


@query("jon28_grounded_spans", "JON28", "JON47", sql="""
WITH s AS (SELECT doc_id, text, CASE WHEN doc_id % 15 = 0 THEN sha256('z' || text) ELSE sha256(text) END AS h, (doc_id % 40)::BIGINT AS a, (doc_id % 40 + 25)::BIGINT AS b FROM documents),
q AS (SELECT *, CASE WHEN doc_id % 6 = 0 THEN substring(text, a + 2, b - a) ELSE substring(text, a + 1, b - a) END AS quote FROM s),
m AS (SELECT q.doc_id, a, b, quote, h, CASE WHEN q.doc_id % 21 = 0 THEN NULL ELSE text END AS text FROM q)
SELECT doc_id, CASE WHEN text IS NULL THEN 'SOURCE_NOT_STORED' WHEN sha256(text) <> h THEN 'SOURCE_CHANGED' WHEN substring(text, a + 1, b - a) IS DISTINCT FROM quote THEN 'QUOTE_NOT_AT_OFFSETS' END AS problem FROM m""")
def jon28_grounded_spans(spark, sf):
    docs, doc = table(spark, sf, "documents"), F.col("doc_id")
    spans = docs.select(
        "doc_id", F.when(doc % 15 == 0, F.sha2(F.concat(F.lit("z"), "text"), 256)).otherwise(F.sha2("text", 256)).alias("h"),
        (doc % 40).cast("int").alias("a"), (doc % 40 + 25).cast("int").alias("b"),
        F.when(doc % 6 == 0, F.col("text").substr((doc % 40 + 2).cast("int"), F.lit(25))).otherwise(
            F.col("text").substr((doc % 40 + 1).cast("int"), F.lit(25))).alias("quote"))
    stored = docs.filter(doc % 21 != 0).select("doc_id", "text")
    return spans.join(stored, "doc_id", "left").select(
        "doc_id", dc.span_problem(F.col("text"), F.col("a"), F.col("b"), F.col("quote"), F.col("h")).alias("problem"))


QUESTION = "which thing is the one with that and onesen erblest"


@query("top01_question_items", "TOP01", sql=f"""
WITH RECURSIVE it AS (SELECT 'p' || doc_id AS source_id, text FROM documents UNION ALL SELECT 'r' || item_id, text FROM benchmark UNION ALL SELECT 'a' || conv_id || ':' || turn, text FROM conversations),
qt AS (SELECT {sq.lexical_terms(f"'{QUESTION}'")} AS terms), sco AS (SELECT source_id, length(text)::BIGINT AS chars, len(list_intersect({sq.lexical_terms('text')}, terms))::BIGINT AS lexical FROM it, qt),
o AS (SELECT *, row_number() OVER (ORDER BY lexical DESC, source_id) AS k FROM sco),
st AS (SELECT 0::BIGINT AS k, 0::BIGINT AS n, 0::BIGINT AS used, NULL::VARCHAR AS source_id, NULL::BIGINT AS lexical, NULL::BIGINT AS chars
  UNION ALL SELECT nx.k, st.n + 1, st.used + nx.chars, nx.source_id, nx.lexical, nx.chars FROM st JOIN LATERAL (SELECT min(o.k) AS k FROM o WHERE o.k > st.k AND st.used + o.chars <= 7000) m ON true JOIN o nx ON nx.k = m.k WHERE st.n < 10)
SELECT source_id, lexical, chars FROM st WHERE source_id IS NOT NULL""")
def top01_question_items(spark, sf):
    items = table(spark, sf, "documents").select(F.concat(F.lit("p"), "doc_id").alias("source_id"), "text").unionByName(
        ad.duties(spark, sf).select(F.concat(F.lit("r"), "item_id").alias("source_id"), "text")).unionByName(
        table(spark, sf, "conversations").select(F.concat(F.lit("a"), "conv_id", F.lit(":"), "turn").alias("source_id"), "text"))
    scored = items.select(
        "source_id", F.length("text").cast("bigint").alias("chars"),
        tx.shared(tx.lexical_terms(F.col("text")), tx.lexical_terms(F.lit(QUESTION))).cast("bigint").alias("lexical")).withColumn("_order", -F.col("lexical"))
    return dc.greedy_within_budget(scored, ["_order", "source_id"], "chars", 10, 7000).select("source_id", "lexical", "chars")


@query("fil16_skipped_units", "FIL16", sql=f"""
WITH {sq.provisions('p')}, k AS (SELECT version_id, CASE WHEN regexp_matches(text, '(?i)(must|shall) not') THEN 'PROHIBITION' WHEN regexp_matches(text, '(?i)(^|[^a-z])(must|shall)([^a-z]|$)') THEN 'OBLIGATION' ELSE 'PERMISSION' END AS kind FROM p)
SELECT version_id, CASE WHEN kind = 'PERMISSION' THEN 'CLASSIFIED_PERMISSION' ELSE 'EXTRACTED' END AS outcome, count(*)::BIGINT AS units FROM k GROUP BY ALL""")
def fil16_skipped_units(spark, sf):
    kind = dc.classify(F.col("text"))["kind"]
    rows = ad.provisions(spark, sf).select("version_id", kind.alias("kind"))
    outcome = F.when(F.col("kind").isin(*dc.NOT_EXTRACTED), F.concat(F.lit("CLASSIFIED_"), "kind")).otherwise("EXTRACTED")
    return rows.groupBy("version_id", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("units"))


@query("fil14_institutions", "FIL14", sql="""
WITH u AS (SELECT page_id, regexp_extract(url, '([a-z0-9-]+[.][a-z]+)(?:[/?#]|$)', 1) AS domain, starts_with(url, 'https://') AS secure FROM pages), allow(domain, institution, authority) AS (VALUES ('example.org', 'REGULATOR', 'BINDING'), ('example.com', 'GAZETTE', 'OFFICIAL'))
SELECT coalesce(institution, 'NOT_ALLOWED') AS institution, authority, count(*)::BIGINT AS pages, count(*) FILTER (secure)::BIGINT AS secure FROM u LEFT JOIN allow USING (domain) GROUP BY ALL""")
def fil14_institutions(spark, sf):
    allow = spark.createDataFrame(
        [("example.org", "REGULATOR", "BINDING"), ("example.com", "GAZETTE", "OFFICIAL")], "domain string, institution string, authority string")
    pages = table(spark, sf, "pages").select(
        F.substring_index(F.expr("parse_url(url, 'HOST')"), ".", -2).alias("domain"), F.col("url").startswith("https://").alias("secure"))
    return pages.join(F.broadcast(allow), "domain", "left").groupBy(F.coalesce("institution", F.lit("NOT_ALLOWED")).alias("institution"), "authority").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("secure").alias("secure"))


@query("fun36_error_layers", "FUN36", sql=f"""
WITH {sq.CALLS} SELECT run_id, CASE WHEN status <> 'OK' THEN 'MODEL' WHEN retry_count > 2 THEN 'GROUNDING' WHEN output_tokens < 3 THEN 'VALIDATOR' WHEN cache_hit THEN 'RETRIEVAL' ELSE 'RULE' END AS layer, count(*)::BIGINT AS n FROM calls GROUP BY ALL""")
def fun36_error_layers(spark, sf):
    layer = (
        F.when(F.col("status") != "OK", "MODEL").when(F.col("retry_count") > 2, "GROUNDING").when(F.col("output_tokens") < 3, "VALIDATOR")
        .when(F.col("cache_hit"), "RETRIEVAL").otherwise("RULE"))
    return ad.calls(spark, sf).groupBy("run_id", layer.alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query("jon42_engines", "JON42", sql=f"""
WITH {sq.PRODUCTS} SELECT pack_id, scope_id, count(*)::BIGINT AS decisions, count(*) FILTER (status = 'APPLIES')::BIGINT AS applies, count(*) FILTER (status = 'UNKNOWN')::BIGINT AS unknown
FROM pdecisions JOIN pscopes USING (scope_id) GROUP BY ALL""")
def jon42_engines(spark, sf):
    from .routing import product_decisions

    # one plan over all packs, the pack is a column
    return product_decisions(spark, sf).groupBy("pack_id", "scope_id").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("status") == "APPLIES").alias("applies"), F.count_if(F.col("status") == "UNKNOWN").alias("unknown"))


@query("agg38_operator_packet", "AGG38", sql=f"""
WITH {sq.provisions('old_p')}, {sq.provisions('new_p', later=True)}, o AS (SELECT version_id, number, min(text) AS was FROM old_p GROUP BY ALL), n AS (SELECT version_id, number, min(text) AS now, bool_or(l_suppkey % 3 = 0) AS quoted, bool_and(l_linestatus = 'F') AS fields FROM new_p GROUP BY ALL)
SELECT CASE WHEN NOT fields THEN 'FIELDS_OPEN' WHEN NOT quoted THEN 'QUOTE_MISSING' ELSE 'READY' END AS status, CASE WHEN was IS NULL THEN 'NO_BASELINE' WHEN was = now THEN 'UNCHANGED' ELSE 'SOURCE_CHANGED' END AS change, count(*)::BIGINT AS packets FROM n LEFT JOIN o USING (version_id, number) GROUP BY ALL""")
def agg38_operator_packet(spark, sf):
    old = ad.provisions(spark, sf).groupBy("version_id", "number").agg(F.min("text").alias("was"))
    new = ad.provisions(spark, sf, later=True).groupBy("version_id", "number").agg(
        F.min("text").alias("now"), F.bool_or(F.col("l_suppkey") % 3 == 0).alias("quoted"), F.bool_and(F.col("l_linestatus") == "F").alias("fields"))
    status = F.when(~F.col("fields"), "FIELDS_OPEN").when(~F.col("quoted"), "QUOTE_MISSING").otherwise("READY")
    change = F.when(F.col("was").isNull(), "NO_BASELINE").when(F.col("was") == F.col("now"), "UNCHANGED").otherwise("SOURCE_CHANGED")
    return new.join(old, ["version_id", "number"], "left").groupBy(status.alias("status"), change.alias("change")).agg(F.count(F.lit(1)).alias("packets"))


@query("src31_rewritten_catalogue", "SRC31", sql=f"""
WITH {sq.CAPTURES}, h AS (SELECT regulation_id, arg_max(content_hash, (fetched_at, capture_id)) AS hash, max(fetched_at)::DATE AS effective, count(*)::BIGINT AS versions FROM captures GROUP BY ALL)
SELECT c_custkey AS regulation_id, CASE WHEN h.hash IS NULL THEN 'UNVERIFIED' WHEN c_custkey % 6 = 0 THEN 'TITLE_DIFFERS' ELSE 'VERIFIED' END AS status, hash, effective::VARCHAR AS effective, coalesce(versions, 0) AS versions FROM customer LEFT JOIN h ON regulation_id = c_custkey""")
def src31_rewritten_catalogue(spark, sf):
    heads = ad.captures(spark, sf).groupBy("regulation_id").agg(
        F.max_by("content_hash", F.struct("fetched_at", "capture_id")).alias("hash"), F.to_date(F.max("fetched_at")).cast("string").alias("effective"),
        F.count(F.lit(1)).alias("versions"))
    entries = table(spark, sf, "customer").select(F.col("c_custkey").alias("regulation_id"))
    status = F.when(F.col("hash").isNull(), "UNVERIFIED").when(F.col("regulation_id") % 6 == 0, "TITLE_DIFFERS").otherwise("VERIFIED")
    return entries.join(heads, "regulation_id", "left").select(
        "regulation_id", status.alias("status"), "hash", "effective", F.coalesce("versions", F.lit(0)).cast("bigint").alias("versions"))


@query("src28_prediction_rows", "SRC28", sql=f"""
WITH {sq.READINGS}, d AS (SELECT DISTINCT duty_id, number, passage_id FROM readings) SELECT duty_id, number::BIGINT AS rank, count(*)::BIGINT AS passages, min(passage_id) AS first_passage FROM d GROUP BY ALL""")
def src28_prediction_rows(spark, sf):
    distinct = ad.readings(spark, sf).select("duty_id", "number", "passage_id").distinct()
    return distinct.groupBy("duty_id", F.col("number").cast("bigint").alias("rank")).agg(F.count(F.lit(1)).alias("passages"), F.min("passage_id").alias("first_passage"))
