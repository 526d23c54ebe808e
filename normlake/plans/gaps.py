"""Coverage, mapping, export and approval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ratio4
from ..operators import coverage as cv
from ..operators import workflow as wf
from ..sources.tables import table
from . import adapters as ad
from . import sqltext as sq
from .registry import query

COVERAGE_SQL = f"""{sq.READINGS},
c AS (SELECT duty_id, count(*) AS n_read, count(*) FILTER (relation = 'CONFLICTS') AS conflicts, count(*) FILTER (relation = 'SUPPORTS' AND NOT is_control) AS supports,
  count(*) FILTER (relation = 'PARTIAL' AND NOT is_control) AS partial, count(*) FILTER (relation = 'UNCLEAR') AS unclear, count(*) FILTER (is_control) AS controls,
  count(*) FILTER (relation = 'CONFLICTS' AND is_control) AS control_conflicts, count(*) FILTER (relation = 'SUPPORTS' AND is_control) AS control_supports,
  count(*) FILTER (relation = 'PARTIAL' AND is_control) AS control_partial FROM readings GROUP BY duty_id),
coverage AS (SELECT *, CASE WHEN conflicts > 0 THEN 'CONFLICT' WHEN supports > 0 AND supports + partial > unclear THEN 'COVERS_TEXT' WHEN partial > 0 AND supports + partial > unclear THEN 'PARTIAL'
    WHEN unclear > 0 THEN 'UNKNOWN' ELSE 'NO_EVIDENCE' END AS coverage,
  CASE WHEN control_conflicts > 0 THEN 'CONFLICT' WHEN control_supports > 0 THEN 'SUPPORTS' WHEN control_partial > 0 THEN 'PARTIAL' WHEN controls > 0 THEN 'NONE' ELSE 'NOT_READ' END AS control_coverage FROM c)"""


@query("agg01_counted_coverage", "AGG01", "UDAF01", sql=f"WITH {COVERAGE_SQL} SELECT duty_id, n_read, conflicts, supports, partial, unclear, coverage, control_coverage FROM coverage")
def agg01_counted_coverage(spark, sf):
    return cv.counted_coverage(ad.readings(spark, sf), ["duty_id"]).select(
        "duty_id", "n_read", "conflicts", "supports", "partial", "unclear", "coverage", "control_coverage")


@query("agg02_element_coverage", "AGG02", sql=f"""
WITH {sq.READINGS},
r AS (SELECT *, NOT is_control AND relation IN ('SUPPORTS', 'PARTIAL') AS fav, l_partkey & 7 AS cm, 7 - (l_partkey & 7) AS mm, CASE WHEN number_met THEN 2 ELSE 0 END AS nm
      FROM (SELECT *, passage_id AS l_partkey FROM readings)),
d AS (SELECT o_orderkey AS duty_id, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 7 END::BIGINT AS crit, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS num FROM orders),
a AS (SELECT d.duty_id, crit, num, count(relation) AS n_read, count(*) FILTER (relation = 'CONFLICTS') AS conflicts, count(*) FILTER (relation = 'UNCLEAR' AND uncertainty = 'strong') AS openc,
   count(*) FILTER (relation = 'UNCLEAR' AND uncertainty <> 'strong') AS weak, count(*) FILTER (fav) AS nfav, count(*) FILTER (NOT is_control AND rejected) AS rej, count(*) FILTER (failed) AS fail,
   coalesce(bit_or(cm) FILTER (fav), 0) | coalesce(bit_or(nm) FILTER (fav), 0) AS fast, coalesce(bit_or(cm) FILTER (fav AND strong), 0) | coalesce(bit_or(nm) FILTER (fav), 0) AS uni,
   coalesce(bit_or(nm) FILTER (fav), 0) AS met, coalesce(bit_or(mm) FILTER (fav), 0) AS miss, coalesce(bool_or(strong) FILTER (fav), false) AS anys
   FROM d LEFT JOIN r USING (duty_id) GROUP BY ALL),
b AS (SELECT a.duty_id, coalesce(bool_or((mm & crit & ~fast) = 0) FILTER (fav AND relation = 'SUPPORTS'), false) AS cov_fast, coalesce(bool_or((mm & crit & ~uni) = 0) FILTER (fav AND relation = 'SUPPORTS'), false) AS cov_uni,
   coalesce(bool_or(strong) FILTER (fav AND relation = 'SUPPORTS'), false) AS sup_strong FROM a LEFT JOIN r USING (duty_id) GROUP BY ALL),
e AS (SELECT a.*, b.* EXCLUDE (duty_id), (num & ~met) = 0 AS nok, nfav > 1 AND (crit & ~fast) = 0 AND (miss & crit & ~fast) = 0 AS joint_fast, nfav > 1 AND (crit & ~uni) = 0 AND (miss & crit & ~uni) = 0 AS joint_uni FROM a JOIN b USING (duty_id)),
f AS (SELECT *, (cov_fast OR joint_fast) AND nok AND NOT CASE WHEN cov_fast THEN sup_strong ELSE anys END AS unconf, (cov_uni OR joint_uni) AND nok AS stands, nfav > 0 AND NOT anys AS unread FROM e)
SELECT duty_id, CASE WHEN n_read = 0 THEN 'NO_EVIDENCE' WHEN conflicts > 0 THEN 'CONFLICT' WHEN openc > 0 THEN 'UNKNOWN' WHEN unread AND rej > 0 AND fail = 0 THEN 'NO_EVIDENCE' WHEN unread AND unconf AND fail > 0 THEN 'UNKNOWN'
  WHEN stands AND NOT unconf THEN 'COVERS_TEXT' WHEN nfav > 0 THEN 'PARTIAL' WHEN weak > 0 THEN 'UNKNOWN' ELSE 'NO_EVIDENCE' END AS coverage,
  concat_ws('; ', CASE WHEN openc > 0 THEN 'POSSIBLE_CONFLICT_UNRESOLVED' END, CASE WHEN conflicts = 0 AND openc = 0 AND n_read > 0 AND unconf THEN 'COVERS_UNCONFIRMED' END,
    CASE WHEN conflicts = 0 AND openc = 0 AND n_read > 0 AND unread AND NOT unconf THEN 'PARTIAL_UNCONFIRMED' END, CASE WHEN conflicts = 0 AND openc = 0 AND n_read > 0 AND unread AND unconf AND fail > 0 THEN 'VERIFIER_FAILED' END) AS flags FROM f""")
def agg02_element_coverage(spark, sf):
    key, strings = F.col("o_orderkey"), lambda *names: F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    duties = table(spark, sf, "orders").select(
        key.alias("duty_id"), F.when(key % 4 == 0, strings("act_1")).otherwise(strings("act_1", "deadline_1", "item_1")).alias("critical"),
        F.when(key % 2 == 0, strings("deadline_1")).otherwise(strings()).alias("numbers"))
    return cv.element_coverage(ad.readings(spark, sf), duties, "duty_id")


@query("agg03_document_coverage", "AGG03", sql=f"""
WITH {sq.READINGS}, o AS (SELECT duty_id, min(CASE relation WHEN 'CONFLICTS' THEN 1 WHEN 'SUPPORTS' THEN 2 WHEN 'PARTIAL' THEN 3 WHEN 'UNCLEAR' THEN 4 ELSE 5 END) AS k FROM readings GROUP BY ALL)
SELECT o.duty_id, ['CONFLICT', 'COVERS_TEXT', 'PARTIAL', 'UNKNOWN', 'NO_EVIDENCE'][k] AS coverage,
  CASE k WHEN 2 THEN 'SUPPORTING_STATEMENT' WHEN 5 THEN 'NO_RELATED_STATEMENT' ELSE string_agg(DISTINCT reason, '; ' ORDER BY reason) FILTER (relation = ['CONFLICTS', '', 'PARTIAL', 'UNCLEAR', ''][k]) END AS reasons
FROM o JOIN readings USING (duty_id) GROUP BY o.duty_id, k""")
def agg03_document_coverage(spark, sf):
    return cv.document_coverage(ad.readings(spark, sf), ["duty_id"]).withColumn("reasons", F.array_join("reasons", "; "))


MAPPING_SQL = f"""{COVERAGE_SQL},
m AS (SELECT duty_id, coverage, controls > 0 AS control_mapped, control_supports > 0 AS evidence FROM coverage),
mapping AS (SELECT *, CASE WHEN coverage = 'CONFLICT' THEN 'CONTRADICTED' WHEN coverage = 'NO_EVIDENCE' THEN 'NOT_COVERED' WHEN coverage = 'PARTIAL' THEN 'PARTIALLY_COVERED'
   WHEN coverage = 'COVERS_TEXT' AND control_mapped AND evidence THEN 'COVERED' WHEN coverage = 'COVERS_TEXT' THEN 'PARTIALLY_COVERED' ELSE 'UNKNOWN' END AS status,
  CASE WHEN coverage = 'CONFLICT' THEN 'POLICY_CONFLICT' WHEN coverage = 'NO_EVIDENCE' THEN 'NO_POLICY_EVIDENCE' WHEN coverage = 'PARTIAL' THEN 'PARTIAL_POLICY' WHEN coverage = 'COVERS_TEXT' AND control_mapped AND evidence THEN 'POLICY_COVERS; CONTROL_MAPPED; EVIDENCE_PRESENT'
   WHEN coverage = 'COVERS_TEXT' AND control_mapped THEN 'POLICY_COVERS; EVIDENCE_MISSING' WHEN coverage = 'COVERS_TEXT' THEN 'POLICY_COVERS; CONTROL_MISSING' ELSE 'COVERAGE_UNKNOWN' END AS reasons FROM m)"""


def mapping(spark, sf):
    c = cv.counted_coverage(ad.readings(spark, sf), ["duty_id"])
    coverage, mapped, evidence = F.col("coverage"), F.col("controls") > 0, F.col("control_supports") > 0
    return c.select("duty_id", "coverage", cv.mapping_status(coverage, mapped, evidence).alias("status"),
                    cv.mapping_reason(coverage, mapped, evidence).alias("reasons"))


@query("jon17_mapping_rows", "JON17", "AGG03", sql=f"WITH {MAPPING_SQL} SELECT duty_id, coverage, status, reasons FROM mapping")
def jon17_mapping_rows(spark, sf):
    return mapping(spark, sf)


@query("agg04_combined_coverage", "AGG04", sql=f"""
WITH {COVERAGE_SQL},
rule AS (SELECT duty_id, coverage AS rule, CASE WHEN duty_id % 3 = 0 THEN ['LIMIT_MISSING'] WHEN duty_id % 3 = 1 THEN ['TIME_WINDOW_WIDER', 'X'] ELSE ['WORDING_PARTLY_MATCHED'] END AS reasons,
   CASE duty_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'CONFLICT' WHEN 2 THEN 'COVERS_TEXT' WHEN 3 THEN 'PARTIAL' WHEN 4 THEN 'UNKNOWN' WHEN 5 THEN 'NO_EVIDENCE' ELSE 'PARTIAL' END AS model, duty_id % 2 = 0 AS adj FROM coverage),
x AS (SELECT *, list_has_any(reasons, ['LIMIT_MISSING', 'TIME_WINDOW_WIDER']) AS gap FROM rule)
SELECT duty_id, CASE WHEN rule = 'CONFLICT' THEN 'CONFLICT' ELSE rule END AS coverage,
  CASE WHEN model IS NULL THEN 'RULE_ONLY' WHEN rule = 'CONFLICT' THEN CASE WHEN model = 'CONFLICT' THEN 'BOTH_READINGS' ELSE 'RULE_ELEMENT_CHECK' END WHEN model = 'CONFLICT' THEN 'MODEL_CONFLICT_UNCONFIRMED'
    WHEN rule = 'PARTIAL' AND gap THEN CASE WHEN model = 'PARTIAL' THEN 'BOTH_READINGS' ELSE 'RULE_ELEMENT_CHECK' END
    WHEN rule = 'COVERS_TEXT' THEN CASE model WHEN 'PARTIAL' THEN 'MODEL_SEES_GAP' WHEN 'COVERS_TEXT' THEN 'BOTH_READINGS' ELSE 'RULE_WORDING_MATCH' END
    WHEN model = 'COVERS_TEXT' THEN CASE WHEN adj THEN 'MODEL_PROPOSES_COVERED' ELSE 'MODEL_PARAPHRASE_UNCONFIRMED' END
    WHEN model = 'PARTIAL' AND adj AND rule = 'NO_EVIDENCE' THEN 'MODEL_PROPOSES_PARTIAL' WHEN model = 'PARTIAL' THEN CASE WHEN rule = 'PARTIAL' THEN 'BOTH_READINGS' ELSE 'MODEL_PARTIAL_UNCONFIRMED' END
    WHEN rule = 'UNKNOWN' OR model = 'UNKNOWN' THEN 'RULE_ONLY' WHEN rule = model THEN 'BOTH_READINGS' ELSE 'RULE_ONLY' END AS basis,
  CASE WHEN model IS NULL THEN rule IN ('CONFLICT', 'UNKNOWN') WHEN rule = 'CONFLICT' OR model = 'CONFLICT' THEN true WHEN rule = 'PARTIAL' AND gap THEN false WHEN rule = 'COVERS_TEXT' THEN model = 'PARTIAL'
    WHEN model = 'COVERS_TEXT' THEN true WHEN model = 'PARTIAL' THEN rule <> 'PARTIAL' WHEN rule = 'UNKNOWN' OR model = 'UNKNOWN' THEN true ELSE false END AS review FROM x""")
def agg04_combined_coverage(spark, sf):
    duty = F.col("duty_id")
    words = {1: "CONFLICT", 2: "COVERS_TEXT", 3: "PARTIAL", 4: "UNKNOWN", 5: "NO_EVIDENCE", 6: "PARTIAL"}
    model = F.lit(None).cast("string")
    for rest, name in words.items():
        model = F.when(duty % 7 == rest, name).otherwise(model)
    reasons = (
        F.when(duty % 3 == 0, F.array(F.lit("LIMIT_MISSING"))).when(duty % 3 == 1, F.array(F.lit("TIME_WINDOW_WIDER"), F.lit("X")))
        .otherwise(F.array(F.lit("WORDING_PARTLY_MATCHED"))))
    rows = cv.counted_coverage(ad.readings(spark, sf), ["duty_id"]).select(
        "duty_id", F.col("coverage").alias("rule"), reasons.alias("why"), model.alias("model"), (duty % 2 == 0).alias("adjudicated"))
    combined = cv.combine(F.col("rule"), F.col("why"), F.col("model"), F.col("adjudicated"))
    return rows.withColumn("c", combined).select("duty_id", "c.coverage", "c.basis", "c.review")


@query("fun32_actions", "FUN32", sql=f"""
WITH {MAPPING_SQL},
lists AS (SELECT duty_id, list(DISTINCT passage_id::VARCHAR) FILTER (relation = 'CONFLICTS') AS cs, list(DISTINCT passage_id::VARCHAR) FILTER (relation = 'PARTIAL' AND NOT is_control) AS ps,
   list(DISTINCT l_suppkey::VARCHAR) FILTER (is_control) AS ks FROM readings GROUP BY duty_id),
a AS (SELECT duty_id, CASE WHEN status = 'CONTRADICTED' THEN 'UPDATE_DOCUMENT' WHEN status = 'NOT_COVERED' THEN 'ADD_POLICY_STATEMENT' WHEN status = 'PARTIALLY_COVERED' AND reasons LIKE '%PARTIAL_POLICY%' THEN 'COMPLETE_STATEMENT'
   WHEN status = 'PARTIALLY_COVERED' AND reasons LIKE '%CONTROL_MISSING%' THEN 'ADD_CONTROL' WHEN status = 'PARTIALLY_COVERED' THEN 'COLLECT_EVIDENCE' WHEN status = 'UNKNOWN' THEN 'REVIEW' END AS action, cs, ps, ks FROM mapping JOIN lists USING (duty_id))
SELECT duty_id, action, unnest(CASE action WHEN 'UPDATE_DOCUMENT' THEN cs WHEN 'COMPLETE_STATEMENT' THEN ps WHEN 'COLLECT_EVIDENCE' THEN ks ELSE [NULL::VARCHAR] END) AS target, 'DEPT_' || (duty_id % 4) AS department
FROM a WHERE action IS NOT NULL""")
def fun32_actions(spark, sf):
    r = ad.readings(spark, sf)
    m = mapping(spark, sf)
    # the passages an action is about are joined as rows, never gathered into one list per duty
    about = r.select(
        "duty_id", F.when(F.col("relation") == "CONFLICTS", F.lit("UPDATE_DOCUMENT")).alias("a"), F.col("passage_id").cast("string").alias("target")).unionByName(
        r.filter("relation = 'PARTIAL' AND NOT is_control").select("duty_id", F.lit("COMPLETE_STATEMENT").alias("a"), F.col("passage_id").cast("string").alias("target"))).unionByName(
        r.filter("is_control").select("duty_id", F.lit("COLLECT_EVIDENCE").alias("a"), F.col("l_suppkey").cast("string").alias("target"))).filter("a IS NOT NULL").distinct()
    action = wf.action_of(F.col("status"), F.col("reasons"))
    rows = m.withColumn("action", action).filter("action IS NOT NULL")
    listed = F.col("action").isin("UPDATE_DOCUMENT", "COMPLETE_STATEMENT", "COLLECT_EVIDENCE")
    single = rows.filter(~listed).select("duty_id", "action", F.lit(None).cast("string").alias("target"))
    many = rows.filter(listed).join(about.withColumnRenamed("a", "action"), ["duty_id", "action"]).select("duty_id", "action", "target")
    return single.unionByName(many).withColumn("department", F.concat(F.lit("DEPT_"), F.col("duty_id") % 4))


EXPORT_SQL = """rows_in AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq, 'PACK_' || l_linestatus AS pack, l_orderkey || ':' || l_linenumber AS row_id,
   sha256(l_orderkey || '|' || l_linenumber || '|' || l_returnflag) AS fingerprint, l_returnflag = 'N' AND l_linestatus = 'F' AS covered_auto FROM lineitem),
kept AS (SELECT * FROM rows_in WHERE NOT covered_auto),
merged AS (SELECT row_id, fingerprint, arg_min(pack, seq) AS first_pack, min(seq) AS first_seq, string_agg(DISTINCT pack, '; ' ORDER BY pack) AS packs FROM kept GROUP BY ALL),
firsts AS (SELECT row_id, arg_min(fingerprint, seq) AS first_fp FROM kept GROUP BY ALL),
named AS (SELECT * FROM merged JOIN firsts USING (row_id))"""


def _export(spark, sf, mark=wf.fingerprint):
    x = table(spark, sf, "lineitem")
    # reading order as a sortable value, so no global numbering is needed
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = x.select(
        seq.alias("seq"), F.concat(F.lit("PACK_"), "l_linestatus").alias("pack"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("row_id"),
        mark(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")).alias("fingerprint"),
        ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")).alias("covered_auto"))
    return wf.export_rows(rows)


@query("jon34_export_rows", "JON34", sql=f"""
WITH {EXPORT_SQL} SELECT CASE WHEN fingerprint = first_fp THEN row_id ELSE row_id || ':' || first_pack END AS export_id, row_id, fingerprint, packs FROM named""")
def jon34_export_rows(spark, sf):
    return _export(spark, sf)[0]


@query("jon34_export_ledger", "JON34", "AGG08", sql=f"""
WITH {EXPORT_SQL},
l AS (SELECT pack, CASE WHEN covered_auto THEN 'EXCLUDED_COVERED_AUTO' WHEN seq <> first_seq THEN 'MERGED_SAME_DUTY_AND_TARGET' WHEN fingerprint = first_fp THEN 'EXPORTED' ELSE 'EXPORTED_PACKS_DISAGREE' END AS outcome
      FROM rows_in LEFT JOIN named USING (row_id, fingerprint))
SELECT pack, outcome, count(*)::BIGINT AS n FROM l GROUP BY GROUPING SETS ((), (pack), (outcome), (pack, outcome))""")
def jon34_export_ledger(spark, sf):
    # the ledger asks whether fingerprints are equal, as the shorter strings are that they are made of
    ledger = _export(spark, sf, wf.canonical)[1].groupBy("pack", "outcome").agg(F.count(F.lit(1)).alias("n"))
    return ledger.groupingSets([[], ["pack"], ["outcome"], ["pack", "outcome"]], "pack", "outcome").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


TASKS_SQL = f"""{sq.ENTITIES},
items AS (SELECT scope_id || ':' || target_id AS row_id, CASE WHEN unclear THEN 'CLARIFY_REGULATORY_SCOPE' ELSE 'COMPLETE_PROFILE_FACT' END AS review_type,
   CASE WHEN unclear THEN 'SOURCE_NO_ADDRESSEE' ELSE 'COMPANY_FACT_MISSING' END AS cause, CASE WHEN unclear THEN 'LEGAL' ELSE 'COMPLIANCE' END AS department,
   CASE WHEN unclear THEN split_part(scope_id, '/', 1) ELSE 'E:' || group_id END AS subject, scope_id AS clause, group_id AS entity, target_id AS target,
   sha256(scope_id || '|' || target_id || '|' || reasons) AS fingerprint FROM decisions WHERE status = 'UNKNOWN')"""


def review_items(spark, sf):
    from .routing import decisions

    d = decisions(spark, sf).filter("status = 'UNKNOWN'")
    unclear = F.col("unclear")
    return d.select(
        F.concat_ws(":", "scope_id", "target_id").alias("row_id"),
        F.when(unclear, "CLARIFY_REGULATORY_SCOPE").otherwise("COMPLETE_PROFILE_FACT").alias("review_type"),
        F.when(unclear, "SOURCE_NO_ADDRESSEE").otherwise("COMPANY_FACT_MISSING").alias("cause"),
        F.when(unclear, "LEGAL").otherwise("COMPLIANCE").alias("department"),
        F.when(unclear, F.split("scope_id", "/")[0]).otherwise(F.concat(F.lit("E:"), "group_id")).alias("subject"),
        F.col("scope_id").alias("clause"), F.col("group_id").alias("entity"), F.col("target_id").alias("target"),
        wf.fingerprint(F.col("scope_id"), F.col("target_id"), F.col("reasons")).alias("fingerprint"))


@query("agg06_review_tasks", "AGG06", sql=f"""
WITH {TASKS_SQL},
g AS (SELECT review_type, cause, department, subject, count(*)::BIGINT AS children, count(DISTINCT clause)::BIGINT AS clauses, count(DISTINCT entity)::BIGINT AS entities, count(DISTINCT target)::BIGINT AS targets,
   sum(('0x' || substring(fingerprint, 1, 12))::BIGINT) AS a, sum(('0x' || substring(fingerprint, 13, 12))::BIGINT) AS b FROM items GROUP BY ALL)
SELECT 'TASK:' || substring(sha256(review_type || '|' || cause || '|' || department || '|' || subject), 1, 16) AS task_id, * EXCLUDE (a, b), sha256(children || ':' || a || ':' || b) AS fingerprint FROM g""")
def agg06_review_tasks(spark, sf):
    return wf.group_reviews(review_items(spark, sf))


@query("agg35_unknown_causes", "AGG35", sql=f"""
WITH {TASKS_SQL}
SELECT cause, split_part(clause, '/', 1) AS regulation, review_type, count(*)::BIGINT AS n, count(DISTINCT clause)::BIGINT AS clauses, count(DISTINCT target)::BIGINT AS targets
FROM items GROUP BY CUBE (cause, split_part(clause, '/', 1), review_type)""")
def agg35_unknown_causes(spark, sf):
    items = review_items(spark, sf).withColumn("regulation", F.split("clause", "/")[0])
    return items.cube("cause", "regulation", "review_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("clause").alias("clauses"), F.count_distinct("target").alias("targets"))


@query("agg08_summary", "AGG08", "AGG25", sql=f"""
WITH {MAPPING_SQL}
SELECT status, coverage, count(*)::BIGINT AS n FROM mapping GROUP BY GROUPING SETS ((), (status), (coverage))""")
def agg08_summary(spark, sf):
    return mapping(spark, sf).groupingSets([[], ["status"], ["coverage"]], "status", "coverage").agg(F.count(F.lit(1)).alias("n"))


@query("agg25_dashboard", "AGG25", sql=f"""
WITH {MAPPING_SQL}
SELECT count(*)::BIGINT AS candidates, count(*) FILTER (coverage = 'COVERS_TEXT')::BIGINT AS covered, count(*) FILTER (status = 'COVERED')::BIGINT AS control_covered,
  count(*) FILTER (coverage = 'CONFLICT')::BIGINT AS conflicts, count(*) FILTER (status = 'UNKNOWN')::BIGINT AS pending_review,
  {sq.ratio4("count(*) FILTER (coverage = 'COVERS_TEXT')", 'count(*)')} AS covered_share FROM mapping""")
def agg25_dashboard(spark, sf):
    n, is_ = F.count(F.lit(1)), lambda c, v: F.count_if(F.col(c) == v)
    return mapping(spark, sf).agg(
        n.alias("candidates"), is_("coverage", "COVERS_TEXT").alias("covered"), is_("status", "COVERED").alias("control_covered"),
        is_("coverage", "CONFLICT").alias("conflicts"), is_("status", "UNKNOWN").alias("pending_review"),
        ratio4(is_("coverage", "COVERS_TEXT"), n).alias("covered_share"))


APPROVALS_SQL = """ex AS (SELECT o_orderkey::VARCHAR AS row_id, sha256(o_orderkey || '|' || o_orderstatus) AS fp, CASE WHEN o_orderkey % 41 = 0 THEN sha256('edited' || o_orderkey) ELSE sha256(o_orderkey || '|' || o_orderstatus) END AS re FROM orders),
ch AS (SELECT 'C' || o_orderkey AS row_id, 'TASK:' || o_custkey AS task_id FROM orders WHERE o_orderkey % 10 = 0),
en AS (SELECT CASE WHEN l_partkey % 53 = 0 THEN 'C' || (l_orderkey - l_orderkey % 10) WHEN l_partkey % 59 = 0 THEN 'X' || l_orderkey ELSE l_orderkey::VARCHAR END AS row_id,
  CASE WHEN l_suppkey % 31 = 0 THEN sha256('seen' || l_orderkey) ELSE sha256(l_orderkey || '|' || o_orderstatus) END AS fp,
  CASE l_returnflag WHEN 'A' THEN 'APPROVED' WHEN 'R' THEN 'REJECTED' ELSE 'RETURNED' END AS decision, 'user' || (l_linenumber % 3) AS approver, l_shipdate AS decided_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'),
ck AS (SELECT en.*, CASE WHEN ex.row_id IS NULL AND ch.task_id IS NOT NULL THEN 'APPROVE_THE_TASK' WHEN ex.row_id IS NULL THEN 'UNKNOWN_ROW' WHEN ex.re <> ex.fp THEN 'EXPORT_MODIFIED' WHEN en.fp <> ex.fp THEN 'STALE_APPROVAL' END AS problem
  FROM en LEFT JOIN ex USING (row_id) LEFT JOIN ch USING (row_id)),
good AS (SELECT DISTINCT row_id, decision, approver, decided_at FROM ck WHERE problem IS NULL),
nw AS (SELECT *, rank() OVER (PARTITION BY row_id ORDER BY decided_at DESC) AS rk, count(*) OVER (PARTITION BY row_id) AS decisions FROM good),
top AS (SELECT row_id, count(*) AS at_once, min(decision) AS decision, min(decisions) AS decisions FROM nw WHERE rk = 1 GROUP BY row_id)"""


def _approvals(spark, sf):
    o = table(spark, sf, "orders")
    real = wf.fingerprint(F.col("o_orderkey"), F.col("o_orderstatus"))
    export = o.select(
        F.col("o_orderkey").cast("string").alias("row_id"), real.alias("fingerprint"),
        F.when(F.col("o_orderkey") % 41 == 0, F.sha2(F.concat(F.lit("edited"), "o_orderkey"), 256)).otherwise(real).alias("recomputed"))
    children = o.filter("o_orderkey % 10 = 0").select(F.concat(F.lit("C"), "o_orderkey").alias("row_id"), F.concat(F.lit("TASK:"), "o_custkey").alias("task_id"))
    x = table(spark, sf, "lineitem").filter("l_linestatus = 'F'").join(o.select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    row_id = (
        F.when(F.col("l_partkey") % 53 == 0, F.concat(F.lit("C"), F.col("l_orderkey") - F.col("l_orderkey") % 10))
        .when(F.col("l_partkey") % 59 == 0, F.concat(F.lit("X"), "l_orderkey")).otherwise(F.col("l_orderkey").cast("string")))
    entries = x.select(
        row_id.alias("row_id"),
        F.when(F.col("l_suppkey") % 31 == 0, F.sha2(F.concat(F.lit("seen"), "l_orderkey"), 256)).otherwise(real).alias("fingerprint"),
        F.when(F.col("l_returnflag") == "A", "APPROVED").when(F.col("l_returnflag") == "R", "REJECTED").otherwise("RETURNED").alias("decision"),
        F.concat(F.lit("user"), F.col("l_linenumber") % 3).alias("approver"), F.col("l_shipdate").alias("decided_at"))
    return wf.apply_approvals(export, entries, children)


@query("jon31_apply_approvals", "JON31", "WIN14", sql=f"""
WITH {APPROVALS_SQL}
SELECT ex.row_id, CASE WHEN at_once = 1 THEN decision ELSE 'PENDING' END AS status, CASE WHEN at_once = 1 AND decision = 'APPROVED' THEN 'READY' WHEN at_once = 1 AND decision = 'REJECTED' THEN 'CANCELLED' ELSE 'DRAFT' END AS action_state,
  CASE WHEN at_once = 1 THEN decisions - 1 ELSE 0 END::BIGINT AS earlier FROM ex LEFT JOIN top USING (row_id)""")
def jon31_apply_approvals(spark, sf):
    return _approvals(spark, sf)[0]


@query("jon31_approval_problems", "JON31", sql=f"""
WITH {APPROVALS_SQL},
p AS (SELECT row_id, problem FROM ck WHERE problem IS NOT NULL AND problem <> 'EXPORT_MODIFIED' UNION ALL SELECT row_id, 'EXPORT_MODIFIED' FROM ex WHERE re <> fp UNION ALL SELECT row_id, 'DECIDED_TWICE' FROM top WHERE at_once > 1)
SELECT row_id, problem, count(*)::BIGINT AS n FROM p GROUP BY ALL""")
def jon31_approval_problems(spark, sf):
    return _approvals(spark, sf)[1].groupBy("row_id", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("jon32_reviewed_labels", "JON32", sql="""
WITH lab AS (SELECT doc_id % 350 AS target, CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS label FROM labels),
t AS (SELECT target, count(*) AS n, min(label) AS now FROM lab GROUP BY ALL),
e AS (SELECT item_id * 7 AS target, item_id % 5 <> 0 AS accepted, CASE WHEN item_id % 2 = 0 THEN 'GOOD' ELSE 'BAD' END AS from_label, 'DISPUTED' AS to_label FROM benchmark),
j AS (SELECT e.*, n, now, CASE WHEN NOT accepted THEN 'NOT_ACCEPTED' WHEN n IS NULL THEN 'NO_TARGET' WHEN n > 1 THEN 'AMBIGUOUS_TARGET' WHEN now IS DISTINCT FROM from_label THEN 'LABEL_CHANGED_SINCE' ELSE 'APPLIED' END AS outcome FROM e LEFT JOIN t USING (target))
SELECT target, outcome, CASE WHEN outcome = 'APPLIED' THEN to_label ELSE now END AS label FROM j""")
def jon32_reviewed_labels(spark, sf):
    labels = table(spark, sf, "labels").select((F.col("doc_id") % 350).alias("target"), F.when(F.col("quality") == 1, "GOOD").otherwise("BAD").alias("label"))
    item = F.col("item_id")
    entries = table(spark, sf, "benchmark").select(
        (item * 7).alias("target"), (item % 5 != 0).alias("accepted"), F.when(item % 2 == 0, "GOOD").otherwise("BAD").alias("from_label"),
        F.lit("DISPUTED").alias("to_label"))
    return wf.overlay_labels(labels, entries, "target").select("target", "outcome", "label")


AUDIT_SQL = """lg AS (SELECT user_id, event_id, ts, sha256(event_id || '|' || event_type || '|' || props) AS h, event_id || '|' || event_type || '|' || props AS content,
   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
ln AS (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM lg),
st AS (SELECT user_id, event_id, ts, content, place, CASE WHEN event_id % 103 = 0 THEN sha256('x' || event_id) ELSE h END AS entry_hash,
   CASE WHEN event_id % 101 = 0 THEN sha256('y' || event_id) ELSE before END AS previous_hash, CASE WHEN event_id % 107 = 0 THEN place + 1 ELSE place END AS seq FROM ln),
vf AS (SELECT *, lag(entry_hash) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS actual FROM st)"""


def audit_log(spark, sf):
    """Events as an audit log per user, with some entries, links and numbers tampered."""
    from ..functions import scan

    e = table(spark, sf, "events").withColumn("content", F.concat_ws("|", "event_id", "event_type", "props")).withColumn(
        "hash", F.sha2("content", 256)).withColumn("hour", F.date_trunc("hour", "ts"))
    order = [F.col("ts"), F.col("event_id")]
    linked = scan.row_number(scan.previous(e, ["user_id"], "hour", order, "hash", "before"), ["user_id"], "hour", order, "place")
    tampered = lambda mark, modulus, original: F.when(
        F.col("event_id") % modulus == 0, F.sha2(F.concat(F.lit(mark), "event_id"), 256)).otherwise(F.col(original))
    return linked.select(
        "user_id", "event_id", "ts", "hour", "content", tampered("x", 103, "hash").alias("entry_hash"), tampered("y", 101, "before").alias("previous_hash"),
        F.when(F.col("event_id") % 107 == 0, F.col("place") + 1).otherwise(F.col("place")).alias("seq"))


@query("win09_chain_breaks", "WIN09", sql=f"""
WITH {AUDIT_SQL}
SELECT user_id, event_id, CASE WHEN sha256(content) <> entry_hash THEN 'CONTENT_CHANGED' WHEN previous_hash IS DISTINCT FROM actual THEN 'LINK_BROKEN' WHEN seq <> place THEN 'SEQUENCE_GAP' END AS problem FROM vf
WHERE sha256(content) <> entry_hash OR previous_hash IS DISTINCT FROM actual OR seq <> place""")
def win09_chain_breaks(spark, sf):
    return wf.chain_breaks(audit_log(spark, sf), "user_id", "hour", [F.col("ts"), F.col("event_id")], F.col("content")).select("user_id", "event_id", "problem")


@query("win13_ledger_lifecycle", "WIN13", sql="""
WITH ev AS (SELECT conv_id, turn, CASE WHEN turn = 0 AND role = 'user' THEN 'PROPOSED' WHEN role = 'assistant' AND turn >= 3 THEN 'ACCEPTED' WHEN role = 'assistant' THEN 'COMMENTED' ELSE 'PROPOSED' END AS event FROM conversations),
l AS (SELECT conv_id, arg_min(event, turn) AS first_event, arg_max(event, turn) AS last_event, count(*) FILTER (event = 'PROPOSED')::BIGINT AS proposed, count(*) FILTER (event IN ('ACCEPTED', 'REJECTED'))::BIGINT AS terminal FROM ev GROUP BY conv_id)
SELECT *, CASE WHEN first_event <> 'PROPOSED' THEN 'NOT_PROPOSED_FIRST' WHEN proposed > 1 THEN 'PROPOSED_TWICE' WHEN terminal > 1 THEN 'DECIDED_TWICE' WHEN terminal = 1 AND last_event NOT IN ('ACCEPTED', 'REJECTED') THEN 'EVENT_AFTER_DECISION' END AS problem FROM l""")
def win13_ledger_lifecycle(spark, sf):
    assistant = F.col("role") == "assistant"
    event = (
        F.when((F.col("turn") == 0) & (F.col("role") == "user"), "PROPOSED").when(assistant & (F.col("turn") >= 3), "ACCEPTED")
        .when(assistant, "COMMENTED").otherwise("PROPOSED"))
    return wf.ledger_problems(table(spark, sf, "conversations").select("conv_id", "turn", event.alias("event")), "conv_id", F.col("turn"))


@query("win14_latest_decisions", "WIN14", sql="""
SELECT l_orderkey, arg_max(l_returnflag, (l_shipdate, l_linenumber, l_returnflag)) AS decision, count(*)::BIGINT AS decisions, max(l_shipdate)::DATE::VARCHAR AS decided_on FROM lineitem GROUP BY l_orderkey""")
def win14_latest_decisions(spark, sf):
    entries = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("decision"), F.col("l_shipdate").alias("decided_at"), "l_linenumber")
    latest = wf.latest_decisions(entries, "l_orderkey", [F.col("decided_at"), F.col("l_linenumber"), F.col("decision")])
    return latest.select("l_orderkey", "decision", "decisions", F.to_date("decided_at").cast("string").alias("decided_on"))


@query("fil18_autonomous_gate", "FIL18", sql=f"""
WITH {sq.READINGS}
SELECT CASE WHEN l_discount = 0 THEN 'MODEL_UNAVAILABLE' WHEN number = 7 THEN 'REVIEW_FLAG' WHEN relation = 'UNRELATED' THEN 'UNKNOWN' WHEN l_quantity > 48 THEN 'POSSIBLY' WHEN l_suppkey % 9 = 0 THEN 'NO_FACT_OR_QUOTE' WHEN relation = 'UNCLEAR' THEN 'UNCLEAR_CHECK' END AS escalation_reason,
  count(*)::BIGINT AS n FROM readings GROUP BY 1""")
def fil18_autonomous_gate(spark, sf):
    reason = wf.autonomous_gate(
        F.col("l_discount") == 0, (F.col("number") == 7).cast("int"), F.when(F.col("relation") == "UNRELATED", "UNKNOWN").otherwise("APPLIES"),
        F.col("l_quantity") > 48, F.col("l_suppkey") % 9 != 0, F.col("relation") == "UNCLEAR")
    return ad.readings(spark, sf).groupBy(reason.alias("escalation_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("fun08_canonical_hash", "FUN08", sql="""
WITH x AS (SELECT *, replace(c_name, '#', CASE c_custkey % 3 WHEN 0 THEN '|' WHEN 1 THEN '~' ELSE chr(92) END) AS name FROM customer)
SELECT c_custkey, sha256(c_custkey || '|' || replace(replace(replace(name, chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), '~', chr(92) || '~') || '|' || c_nationkey || '|' ||
  CASE WHEN c_acctbal < 0 THEN '~' ELSE c_mktsegment END) AS fingerprint FROM x""")
def fun08_canonical_hash(spark, sf):
    segment = F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    sign = F.when(F.col("c_custkey") % 3 == 0, "|").when(F.col("c_custkey") % 3 == 1, "~").otherwise("\\")
    return table(spark, sf, "customer").select(
        "c_custkey", wf.fingerprint(F.col("c_custkey"), F.replace(F.col("c_name"), F.lit("#"), sign), F.col("c_nationkey"), segment).alias("fingerprint"))


@query("fun46_evidence_numbers", "FUN46", sql="""
SELECT l_quantity::VARCHAR AS q, l_discount::VARCHAR AS d, regexp_replace(regexp_replace(printf('%.6f', l_quantity), '0+$', ''), '[.]$', '') AS quantity,
  regexp_replace(regexp_replace(printf('%.6f', l_discount), '0+$', ''), '[.]$', '') AS discount, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""")
def fun46_evidence_numbers(spark, sf):
    x = table(spark, sf, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count(F.lit(1)).alias("n"))
    return x.select(
        F.col("l_quantity").cast("string").alias("q"), F.col("l_discount").cast("string").alias("d"),
        wf.evidence_number(F.col("l_quantity")).alias("quantity"), wf.evidence_number(F.col("l_discount")).alias("discount"), "n")


@query("src16_action_lines", "SRC16", sql=f"""
WITH {MAPPING_SQL}
SELECT duty_id, status, concat_ws('; ', coverage, status, reasons) AS line, CASE WHEN status = 'COVERED' THEN NULL ELSE 'ACTION_' || status END AS action FROM mapping""")
def src16_action_lines(spark, sf):
    m = mapping(spark, sf)
    listed = F.when(F.col("status") != "COVERED", F.array(F.concat(F.lit("ACTION_"), "status")))
    return m.select("duty_id", "status", F.concat_ws("; ", "coverage", "status", "reasons").alias("line"), F.explode_outer(listed).alias("action"))


@query("src29_approval_template", "SRC29", sql="""
SELECT o_orderkey::VARCHAR AS row_id, sha256(o_orderkey || '|' || o_orderstatus) AS fingerprint, 'PENDING' AS decision, NULL::VARCHAR AS approver FROM orders""")
def src29_approval_template(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("row_id"), wf.fingerprint(F.col("o_orderkey"), F.col("o_orderstatus")).alias("fingerprint"),
        F.lit("PENDING").alias("decision"), F.lit(None).cast("string").alias("approver"))


@query("fun33_review_status", "FUN33", "AGG38", sql=f"""
WITH {sq.READINGS}, d AS (SELECT duty_id, count(*) AS candidates, count(*) FILTER (relation IN ('SUPPORTS', 'PARTIAL', 'CONFLICTS')) AS decided, count(*) FILTER (relation = 'CONFLICTS') AS rejected,
  count(*) FILTER (l_quantity > 49) AS changed FROM readings GROUP BY ALL)
SELECT duty_id, CASE WHEN decided < candidates THEN 'INCOMPLETE' WHEN rejected > 0 THEN 'REJECTED' WHEN changed > 0 THEN 'CORRECTED' ELSE 'APPROVED' END AS status FROM d""")
def fun33_review_status(spark, sf):
    decided = F.col("relation").isin("SUPPORTS", "PARTIAL", "CONFLICTS")
    d = ad.readings(spark, sf).groupBy("duty_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(decided).alias("decided"), F.count_if(F.col("relation") == "CONFLICTS").alias("rejected"),
        F.count_if(F.col("l_quantity") > 49).alias("changed"))
    status = (
        F.when(F.col("decided") < F.col("candidates"), "INCOMPLETE").when(F.col("rejected") > 0, "REJECTED").when(F.col("changed") > 0, "CORRECTED")
        .otherwise("APPROVED"))
    return d.select("duty_id", status.alias("status"))
