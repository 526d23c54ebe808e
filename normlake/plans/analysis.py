"""Relations of statements to duties, replayed readings, pairing of expectations with predictions, error rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import ratio4
from ..operators import coverage as cv
from ..operators import documents as dc
from ..operators import relate as rl
from ..operators import retrieval as rt
from ..operators import scoring as sc
from ..operators import workflow as wf
from ..sources.tables import table
from . import adapters as ad
from . import sqltext as sq
from .registry import query

MOD_SQL = """CASE WHEN regexp_matches({0}, '(?i)(must|shall) not') THEN 'MUST_NOT' WHEN regexp_matches({0}, '(?i)(^|[^a-z])(must|shall)([^a-z]|$)') THEN 'MUST' WHEN regexp_matches({0}, '(?i)(^|[^a-z])may([^a-z]|$)') THEN 'MAY' END"""

RELATE_SQL = f"""{sq.provisions('old_p')}, {sq.provisions('new_p', later=True)},
du AS (SELECT DISTINCT version_id, number, text AS dt, section AS ds, l_partkey % 3 AS dc FROM old_p WHERE section <> 'R'), st AS (SELECT DISTINCT version_id, number, text AS pt, section AS ps, l_partkey % 3 AS pc FROM new_p),
pr AS (SELECT *, {sq.stems('dt')} AS w, {sq.stems('pt')} AS o, {MOD_SQL.format('dt')} AS dm, {MOD_SQL.format('pt')} AS pm,
  CASE WHEN ds = 'N' THEN regexp_extract(dt, '([0-9]+)%', 1)::DOUBLE END AS dl, CASE WHEN ps = 'N' THEN regexp_extract(pt, '([0-9]+)%', 1)::DOUBLE END AS pl,
  CASE WHEN ds = 'A' THEN regexp_extract(dt, '([0-9]+) days', 1)::DOUBLE END AS dd, CASE WHEN ps = 'A' THEN regexp_extract(pt, '([0-9]+) days', 1)::DOUBLE END AS pd,
  pc = 0 OR dc = pc AS ok FROM du JOIN st USING (version_id, number)),
m AS (SELECT *, len(list_intersect(w, o)) AS c, len(list_intersect(w, o))::DOUBLE / len(w) AS ov, dl IS NOT NULL AND pl IS NOT NULL AS bo FROM pr),
g AS (SELECT *, concat_ws('; ', CASE WHEN dm <> 'MUST_NOT' AND pm = 'MAY' THEN 'POLICY_OPTIONAL' END, CASE WHEN dl IS NOT NULL AND pl IS NULL THEN 'LIMIT_MISSING' END, CASE WHEN ov < 0.6 AND NOT bo THEN 'WORDING_PARTLY_MATCHED' END,
   CASE WHEN dd IS NOT NULL AND pd IS NULL THEN 'DEADLINE_MISSING' END) AS gaps,
  bo OR CASE WHEN len(w) < 2 THEN false WHEN len(w) = 2 THEN c = 2 WHEN len(w) <= 4 THEN ov >= 0.75 ELSE ov >= 0.5 AND c >= 2 END OR (ov >= 0.75 AND c >= 3) AS relevant FROM m),
v AS (SELECT *, CASE WHEN NOT ok THEN 'UNRELATED|OTHER_PRODUCT' WHEN bo AND pl > dl THEN 'CONFLICTS|LIMIT_WEAKER' WHEN dm = 'MUST_NOT' AND pm <> 'MUST_NOT' AND ov >= 0.6 AND c >= 3 THEN 'CONFLICTS|POLICY_PERMITS_PROHIBITED_ACT'
   WHEN dm = 'MUST_NOT' AND pm <> 'MUST_NOT' THEN 'UNRELATED|OTHER_CIRCUMSTANCE' WHEN dm <> 'MUST_NOT' AND pm = 'MUST_NOT' AND NOT bo AND ov >= 0.6 AND c >= 3 THEN 'CONFLICTS|POLICY_NEGATES_DUTY'
   WHEN dm <> 'MUST_NOT' AND pm = 'MUST_NOT' AND NOT bo THEN 'UNRELATED|OTHER_SUBJECT' WHEN coalesce(pd > dd, false) AND dm <> 'MUST_NOT' AND pm = 'MUST' AND c >= 2 AND ov >= 0.5 THEN 'CONFLICTS|DEADLINE_LATER'
   WHEN NOT relevant THEN 'UNRELATED|OTHER_SUBJECT' WHEN gaps <> '' THEN 'PARTIAL|' || gaps WHEN bo THEN 'SUPPORTS|LIMIT_SAME_OR_STRICTER' ELSE 'SUPPORTS|ACT_AND_POLARITY_MATCH' END AS r FROM g)"""


def related(spark, sf):
    """Duties of the stored text against the statements of the next one with the same number."""
    old, new = ad.provisions(spark, sf), ad.provisions(spark, sf, later=True)
    part, text, key = F.col("_part"), F.col("text"), ["version_id", "number"]
    number_in = lambda section, pattern: F.when(F.col("section") == section, F.regexp_extract("text", pattern, 1).cast("double"))
    classes = lambda when_any: F.when(when_any, F.array().cast("array<string>")).otherwise(F.array(part.cast("string")))
    # equal duties and equal statements are related once; rows travel once, dealt as they will meet, and only then are their texts read
    once = lambda df: df.select(*key, "section", "text", (F.col("l_partkey") % 3).alias("_part")).repartition(*key).distinct()
    duty = once(old.filter("section <> 'R'")).select(
        *key, text.alias("duty"), F.array(part.cast("string")).alias("duty_classes"), tx.stems(text).alias("wanted"),
        dc.modality(text).alias("duty_modality"), number_in("N", "([0-9]+)%").alias("duty_limit"), number_in("A", "([0-9]+) days").alias("duty_days"))
    statement = once(new).select(
        *key, text.alias("statement"), classes(part == 0).alias("statement_classes"), tx.stems(text).alias("offered"),
        dc.modality(text).alias("statement_modality"), number_in("N", "([0-9]+)%").alias("statement_limit"),
        number_in("A", "([0-9]+) days").alias("statement_days"))
    pairs = duty.join(statement, key).withColumn("cap", F.lit(True)).withColumn(
        "similarity", F.lit(None).cast("double")).withColumn("compatible", rl.products_compatible(F.col("duty_classes"), F.col("statement_classes")))
    return rl.relate(pairs)


@query("jon14_relations", "JON14", "JON15", "FUN44", sql=f"""
WITH {RELATE_SQL} SELECT version_id, number, dt AS duty, pt AS statement, split_part(r, '|', 1) AS relation, split_part(r, '|', 2) AS reasons, count(*)::BIGINT AS n FROM v GROUP BY ALL""")
def jon14_relations(spark, sf):
    return related(spark, sf).groupBy("version_id", "number", "duty", "statement", "relation", "reasons").agg(F.count(F.lit(1)).alias("n"))


@query("jon14_strongest", "JON14", "TOP03", sql=f"""
WITH {RELATE_SQL}, x AS (SELECT version_id, number, dt, split_part(r, '|', 1) AS relation, split_part(r, '|', 2) AS reasons, list_position(['UNRELATED', 'UNCLEAR', 'PARTIAL', 'SUPPORTS', 'CONFLICTS'], split_part(r, '|', 1)) AS k FROM v)
SELECT version_id, number, dt AS duty, arg_max(relation, (k, reasons)) AS relation, arg_max(reasons, (k, reasons)) AS reasons FROM x GROUP BY ALL""")
def jon14_strongest(spark, sf):
    return rl.strongest(related(spark, sf), ["version_id", "number", "duty"])


DEADLINES_SQL = f"""{sq.provisions('p')},
d AS (SELECT version_id, list_sort(list(floor(l_quantity)::DOUBLE)) AS ds FROM p WHERE section = 'A' GROUP BY ALL), o AS (SELECT version_id, list_sort(list(floor(l_quantity)::DOUBLE)) AS gs FROM p WHERE section = 'R' GROUP BY ALL)"""


@query("jon39_deadlines", "JON39", sql=f"""
WITH {DEADLINES_SQL},
n AS (SELECT *, least(len(ds), len(gs)) AS n FROM d JOIN o USING (version_id))
SELECT version_id, CASE WHEN len(list_filter(list_zip(ds[len(ds) - n + 1:], gs[:n]), lambda x: x[2] > x[1])) > 0 THEN 'LATER'
  WHEN len(list_filter(list_zip(ds[:n], gs[len(gs) - n + 1:]), lambda x: x[2] > x[1])) > 0 THEN 'UNRESOLVED' ELSE 'NOT_LATER' END AS verdict FROM n""")
def jon39_deadlines(spark, sf):
    p = ad.provisions(spark, sf)
    days = lambda section: p.filter(F.col("section") == section).select("version_id", F.floor("l_quantity").cast("double").alias("days"))
    return rl.later_deadlines(days("A"), days("R"), ["version_id"], "days")


REPLAY_SQL = """rec AS (SELECT sha256(text) AS key, doc_id AS seq, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN quality = 1 THEN 'STATES_DUTY' ELSE 'OTHER' END AS answer,
   CASE WHEN doc_id % 4 = 0 THEN substring(text, 1, 20) || '@' ELSE substring(text, 5, 30) END AS quote, CASE WHEN toxic = 1 THEN 'x' ELSE '' END AS missing FROM documents JOIN labels USING (doc_id)),
lst AS (SELECT key, arg_max({'answer': answer, 'quote': quote, 'missing': missing}, seq) AS r FROM rec GROUP BY key)"""


def replayed(spark, sf):
    docs = table(spark, sf, "documents").withColumn("key", F.sha2("text", 256))
    doc = F.col("doc_id")
    records = docs.join(table(spark, sf, "labels"), "doc_id").select(
        "key", doc.alias("seq"), F.when(doc % 9 == 0, F.lit(None)).when(F.col("quality") == 1, "STATES_DUTY").otherwise("OTHER").alias("answer"),
        F.when(doc % 4 == 0, F.concat(F.substring("text", 1, 20), F.lit("@"))).otherwise(F.substring("text", 5, 30)).alias("quote"),
        F.when(F.col("toxic") == 1, "x").otherwise("").alias("missing"))
    return rl.replay(docs.select("doc_id", "lang", "key", "text"), records, "key")


@query("jon40_replayed_judgements", "JON40", "SRC18", "UDF03", sql=f"""
WITH {REPLAY_SQL}
SELECT doc_id, CASE WHEN r IS NULL THEN 'NOT_READ' WHEN r.answer IS NULL OR NOT contains({sq.squash('text')}, {sq.squash('r.quote')}) THEN 'UNCLEAR' WHEN r.answer = 'STATES_DUTY' AND r.missing <> '' THEN 'STATES_PART' ELSE r.answer END AS relation
FROM documents LEFT JOIN lst ON key = sha256(text)""")
def jon40_replayed_judgements(spark, sf):
    return replayed(spark, sf).select("doc_id", "relation")


@query("agg09_assessment_statistics", "AGG09", "AGG28", sql=f"""
WITH {REPLAY_SQL},
x AS (SELECT lang, CASE WHEN r IS NULL THEN 'NOT_READ' WHEN r.answer IS NULL OR NOT contains({sq.squash('text')}, {sq.squash('r.quote')}) THEN 'UNCLEAR' WHEN r.answer = 'STATES_DUTY' AND r.missing <> '' THEN 'STATES_PART' ELSE r.answer END AS relation, key IS NULL AS unread, sha256(text) AS k
      FROM documents LEFT JOIN lst ON key = sha256(text))
SELECT lang, relation, count(*)::BIGINT AS n, count(DISTINCT k)::BIGINT AS distinct_texts FROM x GROUP BY ROLLUP (lang, relation)""")
def agg09_assessment_statistics(spark, sf):
    return replayed(spark, sf).rollup("lang", "relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("distinct_texts"))


@query("fun19_structural_signals", "FUN19", sql=f"""
WITH {sq.provisions('p')}, a AS (SELECT version_id, min(text) AS duty FROM p WHERE section = 'A' GROUP BY ALL),
x AS (SELECT DISTINCT p.version_id, p.number, duty, text FROM p JOIN a USING (version_id))
SELECT version_id, number, text, concat_ws('; ', CASE WHEN regexp_matches(text, '(?i)(must not|prohibited|forbidden)') AND NOT regexp_matches(duty, '(?i)(must not|prohibited|forbidden)') THEN 'PROHIBITION:strong' END,
  CASE WHEN regexp_matches(text, '(?i)(^|[^a-z])(may|should)([^a-z]|$)') AND NOT regexp_matches(duty, '(?i)(^|[^a-z])(may|should)([^a-z]|$)') THEN 'WEAKER_MODALITY:weak' END) AS signals FROM x""")
def fun19_structural_signals(spark, sf):
    p = ad.provisions(spark, sf)
    duty = p.filter("section = 'A'").groupBy("version_id").agg(F.min("text").alias("duty"))
    rows = p.select("version_id", "number", "text").distinct().join(duty, "version_id")
    return rows.select("version_id", "number", "text", F.array_join(rl.structural_signals(F.col("duty"), F.col("text")), "; ").alias("signals"))


@query("fun22_settled_relations", "FUN22", "FUN43", sql=f"""
WITH {sq.READINGS},
e AS (SELECT duty_id, passage_id, relation, CASE WHEN relation = 'CONFLICTS' THEN 'FAST_CONFLICT' WHEN l_suppkey % 3 = 0 AND l_discount * 10 >= 0.25 THEN 'STRUCTURAL_SIGNAL' WHEN relation = 'UNCLEAR' AND l_discount * 10 >= 0.4 THEN 'UNCLEAR_ON_TOPIC'
   WHEN l_suppkey % 4 = 0 AND l_discount * 10 >= 0.5 THEN 'PROHIBITION_ON_TOPIC' WHEN number <= 3 AND relation = 'UNRELATED' AND l_discount * 10 >= 0.5 THEN 'TOP_RANK_UNRELATED' END AS escalated,
   CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'CONFLICTS' WHEN 2 THEN 'SUPPORTS' WHEN 3 THEN 'PARTIAL' ELSE 'UNRELATED' END AS verifier, passage_id % 2 = 0 AS quoted FROM readings)
SELECT escalated, CASE WHEN escalated IS NULL THEN relation WHEN verifier IS NULL THEN CASE WHEN relation = 'CONFLICTS' THEN 'UNCLEAR' ELSE relation END WHEN verifier = 'CONFLICTS' AND NOT quoted THEN 'UNCLEAR' ELSE verifier END AS final, count(*)::BIGINT AS n FROM e GROUP BY ALL""")
def fun22_settled_relations(spark, sf):
    r, supp = ad.readings(spark, sf), F.col("l_suppkey")
    escalated = rl.escalation(F.col("relation"), supp % 3 == 0, F.col("l_discount") * 10, F.col("number"), supp % 4 == 0)
    verifier = F.when(supp % 5 == 1, "CONFLICTS").when(supp % 5 == 2, "SUPPORTS").when(supp % 5 == 3, "PARTIAL").when(supp % 5 == 4, "UNRELATED")
    rows = r.withColumn("escalated", escalated).withColumn("final", rl.settle(F.col("relation"), F.col("escalated"), verifier, F.col("passage_id") % 2 == 0))
    return rows.groupBy("escalated", "final").agg(F.count(F.lit(1)).alias("n"))


CHAIN_SQL = """ch AS (SELECT o_orderkey AS duty_id, c_acctbal < -500 AS incomplete, CASE WHEN c_mktsegment = 'BUILDING' THEN 'MISMATCH' ELSE 'MATCH' END AS entity, CASE WHEN o_orderstatus = 'P' THEN 'MISMATCH' ELSE 'MATCH' END AS subj, o_orderkey % 2 = 0 AS sc,
   CASE WHEN o_orderpriority = '1-URGENT' THEN 'MISMATCH' WHEN o_orderpriority = '5-LOW' THEN 'NOT_RESTRICTED' ELSE 'MATCH' END AS addr, o_orderkey % 3 = 0 AS ac, CASE WHEN c_nationkey < 5 THEN 'MISMATCH' ELSE 'MATCH' END AS jur,
   CASE WHEN c_nationkey % 2 = 0 THEN 'NOT_RESTRICTED' ELSE 'UNKNOWN' END AS cust, CASE WHEN o_totalprice > 400000 THEN 'EXEMPT' ELSE 'NONE' END AS ex FROM orders JOIN customer ON o_custkey = c_custkey),
chain AS (SELECT duty_id, CASE WHEN incomplete THEN 'UNKNOWN' WHEN entity = 'MISMATCH' OR (subj = 'MISMATCH' AND sc) OR (addr = 'MISMATCH' AND ac) OR ex = 'EXEMPT' THEN 'DOES_NOT_APPLY' ELSE 'OPEN' END AS state,
   CASE WHEN incomplete THEN 'PROFILE_INCOMPLETE' WHEN entity = 'MISMATCH' THEN 'ENTITY_GATE' WHEN subj = 'MISMATCH' AND sc THEN 'SUBJECT_GATE' WHEN addr = 'MISMATCH' AND ac THEN 'ADDRESSEE_GATE' WHEN ex = 'EXEMPT' THEN 'EXEMPTION' ELSE 'NONE' END AS decided_by,
   subj = 'MATCH' AND sc AND addr IN ('MATCH', 'NOT_RESTRICTED') AND jur = 'MATCH' AND cust IN ('MATCH', 'NOT_RESTRICTED') AND ex = 'NONE' AS clear_match FROM ch)"""


def gates(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    state = rl.rule_chain(
        F.col("c_acctbal") < -500, F.when(F.col("c_mktsegment") == "BUILDING", "MISMATCH").otherwise("MATCH"),
        F.when(F.col("o_orderstatus") == "P", "MISMATCH").otherwise("MATCH"), key % 2 == 0,
        F.when(priority == "1-URGENT", "MISMATCH").when(priority == "5-LOW", "NOT_RESTRICTED").otherwise("MATCH"), key % 3 == 0,
        F.when(F.col("c_nationkey") < 5, "MISMATCH").otherwise("MATCH"), F.when(F.col("c_nationkey") % 2 == 0, "NOT_RESTRICTED").otherwise("UNKNOWN"),
        F.when(F.col("o_totalprice") > 400000, "EXEMPT").otherwise("NONE"))
    return o.select(key.alias("duty_id"), state.alias("g")).select("duty_id", "g.*")


@query("fun23_rule_chain", "FUN23", sql=f"WITH {CHAIN_SQL} SELECT * FROM chain")
def fun23_rule_chain(spark, sf):
    return gates(spark, sf)


@query("jon46_proposals", "JON46", "FUN32", sql=f"""
WITH {CHAIN_SQL}, {sq.READINGS},
c AS (SELECT duty_id, count(*) FILTER (relation = 'CONFLICTS') AS cf, count(*) FILTER (relation = 'SUPPORTS' AND NOT is_control) AS su, count(*) FILTER (relation = 'PARTIAL' AND NOT is_control) AS pa, count(*) FILTER (relation = 'UNCLEAR') AS un FROM readings GROUP BY ALL),
v AS (SELECT chain.duty_id, state, CASE WHEN state = 'DOES_NOT_APPLY' THEN NULL WHEN cf > 0 THEN 'CONFLICT' WHEN su > 0 AND su + pa > un THEN 'COVERS_TEXT' WHEN pa > 0 AND su + pa > un THEN 'PARTIAL' WHEN un > 0 THEN 'UNKNOWN' ELSE 'NO_EVIDENCE' END AS coverage FROM chain LEFT JOIN c USING (duty_id))
SELECT duty_id, state, coverage, CASE coverage WHEN 'CONFLICT' THEN 'RESOLVE_CONFLICT' WHEN 'NO_EVIDENCE' THEN 'ADD_POLICY' WHEN 'PARTIAL' THEN 'AMEND_POLICY' WHEN 'UNKNOWN' THEN 'MANUAL_REVIEW' END AS type,
  CASE WHEN coverage IS NULL OR coverage = 'COVERS_TEXT' THEN NULL WHEN coverage = 'CONFLICT' OR duty_id % 17 = 0 THEN 'HIGH' WHEN coverage = 'NO_EVIDENCE' THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM v""")
def jon46_proposals(spark, sf):
    # gates first: readings of duties that are ruled out are never counted
    g = gates(spark, sf).select("duty_id", "state")
    open_duties = g.filter("state <> 'DOES_NOT_APPLY'").select("duty_id")
    counted = cv.counted_coverage(ad.readings(spark, sf).join(open_duties, "duty_id", "left_semi"), ["duty_id"]).select("duty_id", "coverage")
    rows = g.join(counted, "duty_id", "left").withColumn("coverage", F.when(
        F.col("state") != "DOES_NOT_APPLY", F.coalesce("coverage", F.lit("NO_EVIDENCE"))))
    fix = wf.remediation(F.col("state"), F.col("coverage"), F.col("duty_id") % 17 == 0)
    return rows.withColumn("r", fix).select("duty_id", "state", "coverage", "r.type", "r.priority")


@query("agg27_obliged_verdicts", "AGG27", "FUN24", sql="""
WITH req AS (SELECT l_orderkey AS clause, l_suppkey AS member_id, l_returnflag AS kind, l_linenumber % 3 = 0 AS qualifier FROM lineitem),
mem AS (SELECT s_suppkey AS member_id, k AS kind, CASE WHEN (s_suppkey + length(k) + ascii(k)) % 3 = 0 THEN true WHEN (s_suppkey + length(k) + ascii(k)) % 3 = 1 THEN false END AS member FROM supplier, (VALUES ('A'), ('N'), ('R')) AS t(k)),
t AS (SELECT clause, count(*) FILTER (qualifier AND member = false) AS qn, count(*) FILTER (qualifier AND member IS NULL) AS qo, count(*) FILTER (NOT qualifier AND member) AS ye, count(*) FILTER (NOT qualifier AND member IS NULL) AS op, count(*) FILTER (NOT qualifier) AS ki
      FROM req LEFT JOIN mem USING (member_id, kind) GROUP BY clause)
SELECT clause, CASE WHEN qn > 0 OR (ki > 0 AND ye = 0 AND op = 0) THEN 'MISMATCH' WHEN qo > 0 OR (ki > 0 AND ye = 0) THEN 'UNDETERMINED' ELSE 'MATCH' END AS verdict FROM t""")
def agg27_obliged_verdicts(spark, sf):
    required = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("clause"), F.col("l_suppkey").alias("member_id"), F.col("l_returnflag").alias("kind"), (F.col("l_linenumber") % 3 == 0).alias("qualifier"))
    kinds = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("member_id"), F.explode(F.array(*[F.lit(k) for k in "ANR"])).alias("kind"))
    rest = (F.col("member_id") + 1 + F.ascii("kind")) % 3
    membership = kinds.withColumn("member", F.when(rest == 0, F.lit(True)).when(rest == 1, F.lit(False)))
    return rl.obliged_verdict(required, membership, ["clause"])


PAIRS_SQL = f"""ex AS (SELECT conv_id AS case_id, turn AS expectation, {sq.stems('text')} AS label FROM conversations WHERE role = 'user'),
pd AS (SELECT conv_id AS case_id, turn AS prediction, {sq.stems('text')} AS own FROM conversations WHERE role = 'assistant'),
pp AS (SELECT case_id, expectation, prediction, len(list_intersect(label, own)) AS found, len(label) AS n FROM ex JOIN pd USING (case_id)),
el AS (SELECT *, row_number() OVER (PARTITION BY case_id, expectation ORDER BY found DESC, prediction) AS preference FROM pp WHERE found >= n * 0.2 AND found > 0)"""


def pairing(spark, sf):
    """Claims of expectations (user turns) on predictions (assistant turns) of a conversation."""
    c = table(spark, sf, "conversations")
    # the case is part of every term, so only texts of one case can meet
    keyed = lambda role, ident: c.filter(F.col("role") == role).select(
        F.struct("conv_id", "turn").alias(ident), F.transform(tx.stems(F.col("text")), lambda s: F.concat_ws(":", F.col("conv_id"), s)).alias("terms"))
    eligible = rt.containment_pairs(keyed("user", "e"), keyed("assistant", "p"), "e", "p", 0.2)
    best = Window.partitionBy("e").orderBy(F.desc("shared"), "p.turn")
    pairs = eligible.filter("shared > 0").select(
        F.col("e.conv_id").alias("case_id"), F.col("e.turn").alias("expectation"), F.col("p.turn").alias("prediction"), F.row_number().over(best).alias("preference"))
    return rl.claim_in_order(pairs)


@query("jon20_pair_predictions", "JON20", sql=f"""
WITH RECURSIVE {PAIRS_SQL},
o AS (SELECT case_id, expectation, row_number() OVER (PARTITION BY case_id ORDER BY expectation) AS k FROM (SELECT DISTINCT case_id, expectation FROM el)),
st AS (SELECT case_id, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS expectation, NULL::BIGINT AS prediction FROM (SELECT DISTINCT case_id FROM o)
  UNION ALL
  SELECT s.case_id, o.k, CASE WHEN c.prediction IS NULL THEN s.taken ELSE list_append(s.taken, c.prediction) END, o.expectation, c.prediction
  FROM st s JOIN o ON o.case_id = s.case_id AND o.k = s.k + 1
  LEFT JOIN LATERAL (SELECT arg_min(el.prediction, el.preference) AS prediction FROM el WHERE el.case_id = s.case_id AND el.expectation = o.expectation AND NOT list_contains(s.taken, el.prediction)) c ON true)
SELECT case_id, expectation, prediction FROM st WHERE prediction IS NOT NULL""")
def jon20_pair_predictions(spark, sf):
    return pairing(spark, sf).select("case_id", "expectation", "prediction")


SPAN_SQL = f"""found AS (SELECT item_id, doc_id, instr({sq.squash('documents.text')}, {sq.squash('benchmark.text')}) AS s, length({sq.squash('benchmark.text')}) AS n, {sq.squash('documents.text')} AS body FROM benchmark JOIN documents ON contains({sq.squash('documents.text')}, {sq.squash('benchmark.text')})),
parts AS (SELECT item_id, doc_id, s - 1 AS a, s - 1 + n AS b, regexp_extract_all(body, '[^.!?]*[.!?]+|[^.!?]+') AS ps FROM found),
sen AS (SELECT item_id, doc_id, a, b, generate_subscripts(ps, 1) AS seq, unnest(ps) AS sentence FROM parts),
pos AS (SELECT *, coalesce(sum(length(sentence)) OVER (PARTITION BY item_id, doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM sen)"""


@query("jon21_source_span_overlap", "JON21", "JON43", "JON47", sql=f"""
WITH {SPAN_SQL} SELECT item_id, doc_id, a::BIGINT AS start, count(*)::BIGINT AS sentences, min(seq)::BIGINT AS first_sentence FROM pos WHERE st < b AND a < st + length(sentence) GROUP BY ALL""")
def jon21_source_span_overlap(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    needles = ad.duties(spark, sf).select("item_id", F.col("text").alias("needle"))
    pairs = dc.containing(needles, docs, "item_id", "doc_id").join(needles, "item_id").join(docs, "doc_id")
    body, needle = tx.squash(F.col("text")), tx.squash(F.col("needle"))
    spans = pairs.select("item_id", "doc_id", (F.instr(body, needle) - 1).alias("a"), F.length(needle).alias("n"), body.alias("body")).withColumn(
        "b", F.col("a") + F.col("n"))
    located = spans.select("item_id", "doc_id", "a", "b", F.posexplode(dc.sentences(F.col("body"))).alias("seq", "s"))
    overlap = (F.col("s.start") < F.col("b")) & (F.col("a") < F.col("s.start") + F.length("s.sentence"))
    return located.filter(overlap).groupBy("item_id", "doc_id", F.col("a").cast("bigint").alias("start")).agg(
        F.count(F.lit(1)).alias("sentences"), (F.min("seq") + 1).cast("bigint").alias("first_sentence"))


@query("jon22_missing_reasons", "JON22", sql=f"""
WITH {sq.READINGS}, u AS (SELECT duty_id, CASE relation WHEN 'UNRELATED' THEN 'NO_MODAL' WHEN 'UNCLEAR' THEN 'QUOTE_NOT_FOUND' ELSE 'CLAUSE_MISMATCH' END AS detail FROM readings),
k AS (SELECT duty_id, detail, CASE detail WHEN 'CLAUSE_MISMATCH' THEN 'MATCHING_FAILED' WHEN 'QUOTE_NOT_FOUND' THEN 'GROUNDING_REJECTED' ELSE 'EXTRACTION_MISSED' END AS reason FROM u),
m AS (SELECT o_orderkey AS duty_id, coalesce(arg_min(reason, (list_position(['MATCHING_FAILED', 'GROUNDING_REJECTED', 'EXTRACTION_MISSED'], reason), detail)), 'EXTRACTION_MISSED') AS reason,
   coalesce(arg_min(detail, (list_position(['MATCHING_FAILED', 'GROUNDING_REJECTED', 'EXTRACTION_MISSED'], reason), detail)), 'NOT_ANALYSED') AS detail FROM orders LEFT JOIN k ON duty_id = o_orderkey GROUP BY ALL)
SELECT reason, detail, count(*)::BIGINT AS n FROM m GROUP BY ALL""")
def jon22_missing_reasons(spark, sf):
    relation = F.col("relation")
    detail = F.when(relation == "UNRELATED", "NO_MODAL").when(relation == "UNCLEAR", "QUOTE_NOT_FOUND").otherwise("CLAUSE_MISMATCH")
    stage = F.when(relation == "UNRELATED", 3).when(relation == "UNCLEAR", 2).otherwise(1)
    reason = F.when(relation == "UNRELATED", "EXTRACTION_MISSED").when(relation == "UNCLEAR", "GROUNDING_REJECTED").otherwise("MATCHING_FAILED")
    furthest = ad.readings(spark, sf).groupBy("duty_id").agg(F.min_by(F.struct(reason.alias("reason"), detail.alias("detail")), F.struct(stage, detail)).alias("u"))
    expected = table(spark, sf, "orders").select(F.col("o_orderkey").alias("duty_id"))
    rows = expected.join(furthest, "duty_id", "left").select(
        F.coalesce("u.reason", F.lit("EXTRACTION_MISSED")).alias("reason"), F.coalesce("u.detail", F.lit("NOT_ANALYSED")).alias("detail"))
    return rows.groupBy("reason", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("jon38_error_rows", "JON38", "FUN36", sql=f"""
WITH {sq.SCORED}, {sq.CALLS}, {sq.PASSAGES},
e AS (SELECT * FROM scored WHERE expected <> predicted), l AS (SELECT doc_id, count(*)::BIGINT AS passages, count(*) FILTER (length(text) < 40)::BIGINT AS filtered FROM passages GROUP BY ALL)
SELECT e.doc_id, expected, predicted, passages, filtered, calls.task, calls.status, CASE WHEN calls.status <> 'OK' THEN 'MODEL' WHEN predicted = 'UNREAD' THEN 'GROUNDING' WHEN filtered > 0 THEN 'VALIDATOR' WHEN passages > 10 THEN 'RETRIEVAL' ELSE 'RULE' END AS layer
FROM e LEFT JOIN l USING (doc_id) LEFT JOIN calls ON call_id = e.doc_id""")
def jon38_error_rows(spark, sf):
    wrong = ad.scored(spark, sf).filter(F.col("expected") != F.col("predicted")).select("doc_id", "expected", "predicted")
    lines = ad.passages(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("passages"), F.count_if(F.length("text") < 40).alias("filtered"))
    calls = ad.calls(spark, sf).select(F.col("call_id").alias("doc_id"), "task", "status")
    layer = (
        F.when(F.col("status") != "OK", "MODEL").when(F.col("predicted") == "UNREAD", "GROUNDING").when(F.col("filtered") > 0, "VALIDATOR")
        .when(F.col("passages") > 10, "RETRIEVAL").otherwise("RULE"))
    return wrong.join(lines, "doc_id", "left").join(calls, "doc_id", "left").withColumn("layer", layer)


@query("jon29_quotes_to_passages", "JON29", sql=f"""
WITH {sq.PASSAGES}, q AS (SELECT item_id, {sq.squash("string_split(text, chr(10))[1]")} AS quote FROM benchmark), t AS (SELECT doc_id || ':' || line_no AS passage_id, {sq.squash('text')} AS body FROM passages)
SELECT item_id, count(*)::BIGINT AS passages, min(passage_id) AS first_passage FROM q JOIN t ON contains(body, quote) WHERE quote <> '' GROUP BY item_id""")
def jon29_quotes_to_passages(spark, sf):
    quotes = ad.duties(spark, sf).select("item_id", F.get(F.split("text", "\n"), F.lit(0)).alias("needle"))
    texts = ad.passages(spark, sf).select(F.concat_ws(":", "doc_id", "line_no").alias("passage_id"), "text")
    return dc.containing(quotes, texts, "item_id", "passage_id").groupBy("item_id").agg(
        F.count(F.lit(1)).alias("passages"), F.min("passage_id").alias("first_passage"))


@query("jon41_clause_verdicts", "JON41", sql=f"""
WITH {sq.provisions('p')}, x AS (SELECT version_id, number, section, CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_suppkey % 4 = 1 THEN 'PERMISSION' ELSE 'OBLIGATION' END AS model,
  CASE section WHEN 'A' THEN 'OBLIGATION' WHEN 'N' THEN 'PROHIBITION' ELSE 'PERMISSION' END AS rule, concat_ws('; ', CASE WHEN text LIKE '%unless%' THEN 'EXCEPTION' END, CASE WHEN text LIKE '%article%' THEN 'CROSS_REFERENCE' END, CASE WHEN l_quantity > 40 THEN 'LONG' END) AS why FROM p)
SELECT rule, why, CASE WHEN model IS NULL THEN 'NOT_READ' WHEN model = rule THEN 'AGREE' ELSE 'REVIEW' END AS verdict, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def jon41_clause_verdicts(spark, sf):
    s, supp = F.col("section"), F.col("l_suppkey") % 4
    rule = F.when(s == "A", "OBLIGATION").when(s == "N", "PROHIBITION").otherwise("PERMISSION")
    model = F.when(supp == 1, "PERMISSION").when(supp != 0, "OBLIGATION")
    why = F.array_join(F.array_compact(F.array(
        F.when(F.col("text").contains("unless"), F.lit("EXCEPTION")), F.when(F.col("text").contains("article"), F.lit("CROSS_REFERENCE")),
        F.when(F.col("l_quantity") > 40, F.lit("LONG")))), "; ")
    verdict = F.when(model.isNull(), "NOT_READ").when(model == rule, "AGREE").otherwise("REVIEW")
    return ad.provisions(spark, sf).groupBy(rule.alias("rule"), why.alias("why"), verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("jon45_confirmations", "JON45", sql=f"""
WITH {sq.READINGS},
f AS (SELECT duty_id, passage_id, relation, number, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY duty_id ORDER BY CASE relation WHEN 'SUPPORTS' THEN 0 ELSE 1 END, number, passage_id, l_suppkey, l_extendedprice) AS k FROM readings WHERE NOT is_control AND relation IN ('SUPPORTS', 'PARTIAL') AND NOT strong)
SELECT duty_id, k::BIGINT AS k, passage_id, CASE relation WHEN 'SUPPORTS' THEN 'CONFIRM_COVERS' ELSE 'CONFIRM_PARTIAL' END AS question, CASE WHEN l_suppkey % 3 = 0 THEN 'CONFIRMED' WHEN l_suppkey % 3 = 1 THEN 'REJECTED' ELSE 'NOT_RECORDED' END AS answer FROM f WHERE k <= 2""")
def jon45_confirmations(spark, sf):
    favourable = ad.readings(spark, sf).filter("NOT is_control AND relation IN ('SUPPORTS', 'PARTIAL') AND NOT strong")
    order = Window.partitionBy("duty_id").orderBy(
        F.when(F.col("relation") == "SUPPORTS", 0).otherwise(1), "number", "passage_id", "l_suppkey", "l_extendedprice")
    asked = favourable.withColumn("k", F.row_number().over(order).cast("bigint")).filter("k <= 2")
    recorded = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, "CONFIRMED").when(
        F.col("s_suppkey") % 3 == 1, "REJECTED").alias("said"))
    return asked.join(recorded, "l_suppkey", "left").select(
        "duty_id", "k", "passage_id", F.when(F.col("relation") == "SUPPORTS", "CONFIRM_COVERS").otherwise("CONFIRM_PARTIAL").alias("question"),
        F.coalesce("said", F.lit("NOT_RECORDED")).alias("answer"))


@query("agg36_rescored_subset", "AGG36", "SRC28", sql=f"""
WITH {sq.SCORED}, s AS (SELECT scored.* FROM scored WHERE EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id))
SELECT lang, count(*)::BIGINT AS n, {sq.ratio4('count(*) FILTER (expected = predicted)', 'count(*)')} AS accuracy FROM s GROUP BY lang""")
def agg36_rescored_subset(spark, sf):
    wanted = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    n = F.count(F.lit(1))
    return ad.scored(spark, sf).join(wanted, "doc_id", "left_semi").groupBy("lang").agg(
        n.alias("n"), ratio4(F.count_if(F.col("expected") == F.col("predicted")), n).alias("accuracy"))


@query("agg32_interleaved_sample", "AGG32", sql=f"""
WITH {sq.PASSAGES}, t AS (SELECT doc_id, line_no, length(text)::BIGINT AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS turn FROM passages)
SELECT turn, doc_id, line_no, chars FROM t ORDER BY turn, doc_id LIMIT 200""")
def agg32_interleaved_sample(spark, sf):
    rows = rl.interleaved(ad.passages(spark, sf), "doc_id", [F.col("line_no")], 200)
    return rows.select(F.col("turn").cast("bigint").alias("turn"), "doc_id", "line_no", F.length("text").cast("bigint").alias("chars"))


@query("agg32_measurement", "AGG32", sql=f"""
WITH {sq.provisions('p')}, m AS (SELECT section AS legal_type, CASE WHEN l_suppkey % 5 = 0 THEN 'NO_MODAL' WHEN l_suppkey % 5 = 1 THEN 'QUOTE_NOT_FOUND' ELSE 'EXTRACTED' END AS reason,
  CASE WHEN l_suppkey % 5 > 1 AND section <> 'R' THEN 'IDENTICAL' WHEN l_suppkey % 5 > 1 THEN 'MODEL_ONLY' WHEN section <> 'R' THEN 'BASELINE_ONLY' ELSE 'BOTH_ABSTAINED' END AS agreement FROM p)
SELECT legal_type, reason, count(*)::BIGINT AS n, count(*) FILTER (agreement = 'IDENTICAL')::BIGINT AS identical, count(*) FILTER (agreement = 'BOTH_ABSTAINED')::BIGINT AS both_abstained FROM m GROUP BY ROLLUP (legal_type, reason)""")
def agg32_measurement(spark, sf):
    s = F.col("l_suppkey") % 5
    model, baseline = s > 1, F.col("section") != "R"
    rows = ad.provisions(spark, sf).select(
        F.col("section").alias("legal_type"), F.when(s == 0, "NO_MODAL").when(s == 1, "QUOTE_NOT_FOUND").otherwise("EXTRACTED").alias("reason"),
        (model & baseline).alias("same"), (~model & ~baseline).alias("none"))
    return rows.rollup("legal_type", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("same").alias("identical"), F.count_if("none").alias("both_abstained"))


@query("agg34_release_gate", "AGG34", sql="""
WITH g AS (SELECT text, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS doc_id FROM documents GROUP BY text),
v AS (SELECT CASE WHEN n > 1 AND sources > 1 THEN 'EXPOSED_TWICE' WHEN n > 1 THEN 'DUPLICATE_ITEM' WHEN length(text) < 100 THEN 'TOO_SHORT' ELSE 'OK' END AS state, n FROM g)
SELECT state, count(*)::BIGINT AS groups, sum(n)::BIGINT AS items, count(*) >= 100 AS enough_groups FROM v GROUP BY state""")
def agg34_release_gate(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.min(F.length("text")).alias("chars"))
    state = F.when((F.col("n") > 1) & (F.col("sources") > 1), "EXPOSED_TWICE").when(F.col("n") > 1, "DUPLICATE_ITEM").when(F.col("chars") < 100, "TOO_SHORT").otherwise("OK")
    return g.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("items"), (F.count(F.lit(1)) >= 100).alias("enough_groups"))


@query("agg39_duty_truncation", "AGG39", sql=f"""
WITH t AS (SELECT conv_id, turn, list_distinct({sq.words('text')}) AS ws, list_distinct({sq.words('substring(text, 1, 60)')}) AS kept FROM conversations)
SELECT conv_id, turn, {sq.ratio4('len(list_intersect(kept, ws))', 'len(ws)')} AS kept_share, CASE WHEN len(ws) = 0 THEN 'EMPTY' WHEN len(list_intersect(kept, ws)) = len(ws) THEN 'WHOLE' WHEN len(list_intersect(kept, ws)) * 2 >= len(ws) THEN 'MOST' ELSE 'CUT' END AS state FROM t""")
def agg39_duty_truncation(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_distinct(tx.words(F.col("text"))).alias("ws"), F.array_distinct(tx.words(F.substring("text", 1, 60))).alias("kept"))
    shared, n = tx.shared(F.col("kept"), F.col("ws")), F.size("ws")
    state = F.when(n == 0, "EMPTY").when(shared == n, "WHOLE").when(shared * 2 >= n, "MOST").otherwise("CUT")
    return rows.select("conv_id", "turn", ratio4(shared, n).alias("kept_share"), state.alias("state"))


@query("agg41_tasks_by_split", "AGG41", sql=f"""
WITH {sq.SCORED}, u AS (SELECT 'APPLICABILITY' AS task, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'HOLDOUT' ELSE 'DEV' END AS split, expected = predicted AS ok FROM scored
  UNION ALL SELECT 'COVERAGE', CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'HOLDOUT' ELSE 'DEV' END, (quality = 1) = (n_chars > 1500) FROM scored)
SELECT task, split, count(*)::BIGINT AS n, count(*) FILTER (NOT ok)::BIGINT AS wrong, {sq.ratio4('count(*) FILTER (ok)', 'count(*)')} AS accuracy FROM u GROUP BY ALL""")
def agg41_tasks_by_split(spark, sf):
    s = ad.scored(spark, sf).withColumn("split", F.when(F.col("source").isin("src0", "src1", "src2", "src3"), "HOLDOUT").otherwise("DEV"))
    tasks = F.array(
        F.struct(F.lit("APPLICABILITY").alias("task"), (F.col("expected") == F.col("predicted")).alias("ok")),
        F.struct(F.lit("COVERAGE").alias("task"), ((F.col("quality") == 1) == (F.col("n_chars") > 1500)).alias("ok")))
    rows = s.select("split", F.explode(tasks).alias("t")).select("split", "t.*")
    n = F.count(F.lit(1))
    return rows.groupBy("task", "split").agg(n.alias("n"), F.count_if(~F.col("ok")).alias("wrong"), ratio4(F.count_if("ok"), n).alias("accuracy"))


@query("src20_review_sheet", "SRC20", "FUN39", sql=f"""
WITH {sq.SCORED}, c AS (SELECT doc_id, predicted FROM scored WHERE predicted <> 'UNREAD'), e AS (SELECT doc_id, expected FROM scored WHERE lang <> 'es')
SELECT doc_id, expected, predicted, CASE WHEN predicted IS NULL THEN 'NOT_EXTRACTED' WHEN expected IS NULL THEN 'UNEXPECTED' ELSE 'PAIRED' END AS row_kind FROM e FULL JOIN c USING (doc_id)""")
def src20_review_sheet(spark, sf):
    s = ad.scored(spark, sf)
    expected = s.filter("lang <> 'es'").select("doc_id", "expected")
    predicted = s.filter("predicted <> 'UNREAD'").select("doc_id", "predicted")
    kind = F.when(F.col("predicted").isNull(), "NOT_EXTRACTED").when(F.col("expected").isNull(), "UNEXPECTED").otherwise("PAIRED")
    return expected.join(predicted, "doc_id", "full_outer").withColumn("row_kind", kind)
