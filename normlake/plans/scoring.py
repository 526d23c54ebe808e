"""Scoring queries: how good and how costly a run was."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ratio4
from ..operators import scoring as sc
from . import adapters as ad
from . import sqltext as sq
from .registry import query

LABELS_SQL = "(VALUES ('APPLIES'), ('DOES_NOT_APPLY'), ('UNKNOWN')) AS l(label)"

CLASSES_SQL = f"""{sq.SCORED},
t AS (SELECT label, count(*) FILTER (expected = label AND predicted = label) AS tp,
             count(*) FILTER (expected <> label AND predicted = label) AS fp,
             count(*) FILTER (expected = label AND predicted <> label) AS fn, count(*) AS total FROM scored, {LABELS_SQL} GROUP BY label),
u AS (SELECT *, {sq.ratio4('tp', 'tp + fp')} AS precision, {sq.ratio4('tp', 'tp + fn')} AS recall FROM t),
classes AS (SELECT label, tp, fp, fn, precision, recall, {sq.f1('precision', 'recall')} AS f1, (tp + fn)::BIGINT AS support, total FROM u)"""


@query("agg10_confusion", "AGG10", sql=f"""
WITH {sq.SCORED}
SELECT expected, CASE WHEN predicted IN ('APPLIES', 'DOES_NOT_APPLY', 'UNKNOWN') THEN predicted ELSE 'OTHER' END AS predicted,
       count(*)::BIGINT AS n FROM scored GROUP BY 1, 2""")
def agg10_confusion(spark, sf):
    return sc.confusion(ad.scored(spark, sf), sc.APPLICABILITY)


@query("agg10_classification", "AGG10", sql=f"""
WITH {CLASSES_SQL} SELECT label, tp, fp, fn, precision, recall, f1, support FROM classes""")
def agg10_classification(spark, sf):
    return sc.per_class(sc.confusion(ad.scored(spark, sf), sc.APPLICABILITY), sc.APPLICABILITY)


@query("agg10_macro", "AGG10", sql=f"""
WITH {CLASSES_SQL}
SELECT sum(support)::BIGINT AS n, {sq.ratio4('sum(tp)', 'sum(support)')} AS accuracy,
  round_even((sum(coalesce(precision, 0)) FILTER (support > 0)) / (count(*) FILTER (support > 0)), 4) AS macro_precision,
  round_even((sum(coalesce(recall, 0)) FILTER (support > 0)) / (count(*) FILTER (support > 0)), 4) AS macro_recall,
  round_even((sum(coalesce(f1, 0)) FILTER (support > 0)) / (count(*) FILTER (support > 0)), 4) AS macro_f1 FROM classes""")
def agg10_macro(spark, sf):
    return sc.macro(sc.per_class(sc.confusion(ad.scored(spark, sf), sc.APPLICABILITY), sc.APPLICABILITY))


BINARY_SQL = f"""WITH {sq.SCORED},
b AS (SELECT lang, toxic = 1 AS e, n_chars < 900 AS p FROM scored),
t AS (SELECT lang, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn,
             count(*) FILTER (NOT e AND NOT p) AS tn FROM b GROUP BY lang),
u AS (SELECT *, {sq.ratio4('tp', 'tp + fp')} AS precision, {sq.ratio4('tp', 'tp + fn')} AS recall FROM t)"""


def _binary(spark, sf):
    return ad.scored(spark, sf).select("lang", (F.col("toxic") == 1).alias("expected"), (F.col("n_chars") < 900).alias("predicted"))


@query("agg11_binary", "AGG11", sql=f"""{BINARY_SQL}
SELECT *, {sq.f1('precision', 'recall')} AS f1, {sq.ratio4('fp', 'fp + tn')} AS false_positive_rate, (tp + fp + fn + tn)::BIGINT AS n FROM u""")
def agg11_binary(spark, sf):
    return sc.binary(_binary(spark, sf), ["lang"])


@query("agg11_exclusion_rates", "AGG11", sql=f"""{BINARY_SQL}
SELECT lang, (tp + fp + fn + tn)::BIGINT AS n, (tp + fn)::BIGINT AS expected_excluded, fp AS false_exclusions, fn AS false_inclusions,
       {sq.ratio4('fp', 'fp + tn')} AS false_exclusion_rate, {sq.ratio4('fn', 'tp + fn')} AS false_inclusion_rate FROM u""")
def agg11_exclusion_rates(spark, sf):
    return sc.exclusion_rates(_binary(spark, sf), ["lang"])


@query("agg13_reliability", "AGG13", sql=f"""
WITH {sq.CALLS}
SELECT run_id, count(*)::BIGINT AS calls, count(*) FILTER (status <> 'OK')::BIGINT AS failures,
  {sq.ratio4("count(*) FILTER (status <> 'OK')", 'count(*)')} AS model_failure_rate,
  count(*) FILTER (status <> 'OK' AND error LIKE '%time limit%')::BIGINT AS timeouts,
  {sq.ratio4("count(*) FILTER (status <> 'OK' AND error LIKE '%time limit%')", 'count(*)')} AS timeout_rate,
  sum(retry_count)::BIGINT AS retries FROM calls GROUP BY run_id""")
def agg13_reliability(spark, sf):
    return sc.reliability(ad.calls(spark, sf), ["run_id"])


@query("agg13_failures_by_code", "AGG13", sql=f"""
WITH {sq.CALLS}
SELECT run_id, coalesce(failure_code, status) AS code, count(*)::BIGINT AS n FROM calls WHERE status <> 'OK' GROUP BY ALL""")
def agg13_failures_by_code(spark, sf):
    return sc.failures_by_code(ad.calls(spark, sf), ["run_id"])


@query("agg14_call_costs", "AGG14", sql=f"""
WITH {sq.CALLS}
SELECT run_id, task, count(*)::BIGINT AS calls, count(*) FILTER (NOT cache_hit)::BIGINT AS live_calls, sum(elapsed_ms)::BIGINT AS model_ms,
  sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  {sq.ratio4('count(*) FILTER (cache_hit)', 'count(*)')} AS cache_hit_ratio, count(*) FILTER (thinking)::BIGINT AS thinking_calls,
  count(*) FILTER (thinking AND NOT cache_hit)::BIGINT AS thinking_calls_live,
  count(*) FILTER (thinking AND task LIKE 'judge.%')::BIGINT AS strong_model_calls FROM calls GROUP BY ROLLUP (run_id, task)""")
def agg14_call_costs(spark, sf):
    calls = ad.calls(spark, sf)
    return sc.call_costs_rollup(calls, "run_id", "task")


@query("top04_slowest_cases", "TOP04", "AGG14", sql="""
SELECT user_id AS case_id, round(sum(round(value * 1000)::BIGINT) / 1000.0::DOUBLE, 1) AS wall_seconds FROM events GROUP BY user_id
ORDER BY sum(round(value * 1000)::BIGINT) DESC, user_id LIMIT 5""")
def top04_slowest_cases(spark, sf):
    wall = ad.calls(spark, sf).groupBy(F.col("user_id").alias("case_id")).agg(F.sum("elapsed_ms").alias("ms"))
    return wall.orderBy(F.desc("ms"), "case_id").limit(5).select("case_id", F.round(F.col("ms") / 1000.0, 1).alias("wall_seconds"))


@query("agg15_runtime", "AGG15", sql=f"""
WITH {sq.CALLS}
SELECT run_id, model, num_ctx, count(*)::BIGINT AS live_calls, sum(elapsed_ms)::BIGINT AS model_ms, count(gpu_fraction)::BIGINT AS observed,
  count(*) FILTER (gpu_fraction >= 0.995)::BIGINT AS full_gpu,
  {sq.ratio4('count(*) FILTER (gpu_fraction >= 0.995)', 'count(gpu_fraction)')} AS full_gpu_share,
  median(tokens_per_second) AS median_rate
FROM calls WHERE NOT cache_hit GROUP BY GROUPING SETS ((run_id, model), (run_id, num_ctx), (run_id, model, num_ctx))""")
def agg15_runtime(spark, sf):
    return sc.runtime_breakdown(ad.calls(spark, sf), "run_id")


@query("agg15_model_switches", "AGG15", sql=f"""
WITH {sq.CALLS},
s AS (SELECT *, lag(model) OVER w AS pm, lag(num_ctx) OVER w AS pc FROM calls WHERE NOT cache_hit AND status NOT IN ('CONTEXT_BUDGET_EXCEEDED', 'CIRCUIT_OPEN')
      WINDOW w AS (PARTITION BY run_id ORDER BY "at", call_id))
SELECT run_id, count(*)::BIGINT AS sent, count(*) FILTER (pm <> model)::BIGINT AS model_switches,
  count(*) FILTER (pm = model AND pc <> num_ctx)::BIGINT AS window_switches, count(*) FILTER (load_duration_ms >= 500)::BIGINT AS model_loads
FROM s GROUP BY run_id""")
def agg15_model_switches(spark, sf):
    return sc.model_switches(ad.calls(spark, sf), "run_id", "hour")


STAGES = ("retrieval", "relevance_screen", "fast_classifier", "thinking_verifier")


@query("agg16_stage_costs", "AGG16", sql=f"""
WITH {sq.CALLS},
p AS (SELECT call_id, unnest([{{'stage': 'retrieval', 'ms': CASE WHEN NOT cache_hit THEN elapsed_ms END}},
                    {{'stage': 'relevance_screen', 'ms': CASE WHEN thinking THEN output_tokens END}},
                    {{'stage': 'fast_classifier', 'ms': prompt_tokens}},
                    {{'stage': 'thinking_verifier', 'ms': CASE WHEN thinking THEN elapsed_ms END}}], recursive := true) FROM calls WHERE status = 'OK')
SELECT stage, count(ms)::BIGINT AS obligations, round_even(avg(coalesce(ms, 0)) / 1000, 2) AS mean_s,
  round_even(median(coalesce(ms, 0)) / 1000, 2) AS median_s, round_even(max(coalesce(ms, 0)) / 1000.0::DOUBLE, 2) AS max_s,
  round_even(sum(coalesce(ms, 0)) / 1000.0::DOUBLE, 1) AS total_s FROM p GROUP BY stage""")
def agg16_stage_costs(spark, sf):
    c = ad.calls(spark, sf)
    named = F.array(
        F.when(~F.col("cache_hit"), F.struct(F.lit(STAGES[0]).alias("k"), F.col("elapsed_ms").alias("v"))),
        F.when(F.col("thinking"), F.struct(F.lit(STAGES[1]).alias("k"), F.col("output_tokens").alias("v"))),
        F.struct(F.lit(STAGES[2]).alias("k"), F.col("prompt_tokens").alias("v")),
        F.when(F.col("thinking"), F.struct(F.lit(STAGES[3]).alias("k"), F.col("elapsed_ms").alias("v"))))
    rows = c.select((F.col("status") == "OK").alias("coverage_assessed"), F.map_from_entries(F.array_compact(named)).alias("timings_ms"))
    return sc.stage_costs(rows, STAGES)


@query("agg17_extraction", "AGG17", sql=f"""
WITH {sq.SCORED},
r AS (SELECT *, predicted <> 'UNREAD' AS matched, quality = 1 AS required,
  CASE WHEN predicted <> 'UNREAD' THEN NULL WHEN n_chars < 100 THEN 'EXTRACTION_MISSED' WHEN lang = 'en' THEN 'GROUNDING_REJECTED' ELSE 'MATCHING_FAILED' END AS reason,
  CASE WHEN predicted <> 'UNREAD' THEN NULL ELSE coalesce(field_source, 'NOT_RECORDED') END AS detail FROM scored)
SELECT reason, detail, count(*)::BIGINT AS missing, count(*) FILTER (required)::BIGINT AS missing_required
FROM r WHERE NOT matched GROUP BY ROLLUP (reason, detail)""")
def agg17_extraction(spark, sf):
    s = ad.scored(spark, sf).filter(F.col("predicted") == "UNREAD")
    rows = s.select(
        F.when(F.col("n_chars") < 100, "EXTRACTION_MISSED").when(F.col("lang") == "en", "GROUNDING_REJECTED")
        .otherwise("MATCHING_FAILED").alias("reason"),
        F.coalesce("field_source", F.lit("NOT_RECORDED")).alias("detail"), (F.col("quality") == 1).alias("required"))
    return rows.rollup("reason", "detail").agg(F.count(F.lit(1)).alias("missing"), F.count_if("required").alias("missing_required"))


@query("agg17_recall", "AGG17", sql=f"""
WITH {sq.SCORED}
SELECT count(*) FILTER (quality = 1)::BIGINT AS expected_required,
  count(*) FILTER (quality = 1 AND predicted <> 'UNREAD')::BIGINT AS found_required,
  {sq.ratio4("count(*) FILTER (quality = 1 AND predicted <> 'UNREAD')", "count(*) FILTER (quality = 1)")} AS recall,
  count(*) FILTER (predicted <> 'UNREAD')::BIGINT AS matched FROM scored""")
def agg17_recall(spark, sf):
    required, found = F.col("quality") == 1, F.col("predicted") != "UNREAD"
    return ad.scored(spark, sf).agg(
        F.count_if(required).alias("expected_required"), F.count_if(required & found).alias("found_required"),
        ratio4(F.count_if(required & found), F.count_if(required)).alias("recall"), F.count_if(found).alias("matched"))


@query("agg18_by_label_source", "AGG18", sql=f"""
WITH {sq.SCORED},
s AS (SELECT coalesce(field_source, row_source, 'RULE_DERIVED') AS label_source, expected = predicted AS ok,
             expected = 'APPLIES' AS e, predicted = 'APPLIES' AS p FROM scored)
SELECT label_source, count(*)::BIGINT AS n, {sq.ratio4('count(*) FILTER (ok)', 'count(*)')} AS accuracy,
  {sq.ratio4('count(*) FILTER (e AND p)', 'count(*) FILTER (p)')} AS precision,
  {sq.ratio4('count(*) FILTER (e AND p)', 'count(*) FILTER (e)')} AS recall
FROM s GROUP BY GROUPING SETS ((), (label_source))""")
def agg18_by_label_source(spark, sf):
    e, p, n = F.col("expected") == "APPLIES", F.col("predicted") == "APPLIES", F.count(F.lit(1))
    rows = ad.scored(spark, sf).withColumn(
        "label_source", sc.label_source(F.col("field_source"), F.col("row_source"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    return rows.groupingSets([[], ["label_source"]], "label_source").agg(
        n.alias("n"), ratio4(F.count_if(F.col("expected") == F.col("predicted")), n).alias("accuracy"),
        ratio4(F.count_if(e & p), F.count_if(p)).alias("precision"), ratio4(F.count_if(e & p), F.count_if(e)).alias("recall"))


@query("agg37_one_vs_rest", "AGG37", sql=f"""
WITH {CLASSES_SQL}
SELECT label, tp, fp, fn, (total - tp - fp - fn)::BIGINT AS tn, {sq.ratio4('fp', 'total - tp - fn')} AS fpr, {sq.ratio4('fn', 'fn + tp')} AS fnr
FROM classes""")
def agg37_one_vs_rest(spark, sf):
    return sc.one_vs_rest(sc.confusion(ad.scored(spark, sf), sc.APPLICABILITY), sc.APPLICABILITY)


@query("agg37_pair_consistency", "AGG37", sql=f"""
WITH {sq.SCORED},
p AS (SELECT source, lang, min(doc_id) AS a, max(doc_id) AS b FROM scored GROUP BY ALL HAVING count(*) > 1),
j AS (SELECT x.expected <> y.expected AS differs, x.predicted <> y.predicted AS detected,
             x.expected = x.predicted AND y.expected = y.predicted AS both_right
      FROM p JOIN scored x ON x.doc_id = a JOIN scored y ON y.doc_id = b)
SELECT count(*)::BIGINT AS pairs, count(*) FILTER (both_right)::BIGINT AS consistent, {sq.ratio4('count(*) FILTER (both_right)', 'count(*)')} AS consistency,
  count(*) FILTER (differs)::BIGINT AS contrasts, count(*) FILTER (differs AND detected)::BIGINT AS detected FROM j""")
def agg37_pair_consistency(spark, sf):
    s = ad.scored(spark, sf)
    pairs = s.groupBy("source", "lang").agg(
        F.min_by(F.struct("expected", "predicted"), "doc_id").alias("x"), F.max_by(F.struct("expected", "predicted"), "doc_id").alias("y"),
        F.count(F.lit(1)).alias("n")).filter("n > 1")
    differs, detected = F.col("x.expected") != F.col("y.expected"), F.col("x.predicted") != F.col("y.predicted")
    right = (F.col("x.expected") == F.col("x.predicted")) & (F.col("y.expected") == F.col("y.predicted"))
    n = F.count(F.lit(1))
    return pairs.agg(
        n.alias("pairs"), F.count_if(right).alias("consistent"), ratio4(F.count_if(right), n).alias("consistency"),
        F.count_if(differs).alias("contrasts"), F.count_if(differs & detected).alias("detected"))


# How much a measure may move before the gate warns or fails.
GATE_LIMITS = (
    ("accuracy", "DROP", 0.05, None), ("macro_f1", "DROP", 0.03, None), ("false_positive_rate", "RISE", 0.0, None),
    ("unknown_rate", "RISE", 0.10, 0.02), ("failure_rate", "CEILING", 0.05, None), ("wall_seconds", "RATIO", 0.50, 0.30),
    ("calls_per_row", "RATIO", None, 0.30), ("not_measured", "DROP", 0.05, None),
)

RUN_METRICS_SQL = f"""{sq.SCORED}, {sq.CALLS},
half AS (SELECT *, CASE WHEN lang = 'en' THEN 'run' ELSE 'base' END AS side FROM scored),
m1 AS (SELECT side, avg((expected = predicted)::INT) AS accuracy, avg((predicted = 'UNKNOWN')::INT) AS unknown_rate,
              count(*) FILTER (expected <> 'APPLIES' AND predicted = 'APPLIES')::DOUBLE / count(*) FILTER (expected <> 'APPLIES') AS false_positive_rate
       FROM half GROUP BY side),
chalf AS (SELECT *, CASE WHEN run_id IN ('run_0', 'run_1') THEN 'run' ELSE 'base' END AS side FROM calls),
m2 AS (SELECT side, avg((status <> 'OK')::INT) AS failure_rate, sum(elapsed_ms) / 1000.0::DOUBLE AS wall_seconds,
              count(*)::DOUBLE / count(DISTINCT user_id) AS calls_per_row FROM chalf GROUP BY side),
metrics AS (
  SELECT side, 'accuracy' AS metric, round_even(accuracy, 4) AS value FROM m1 UNION ALL SELECT side, 'unknown_rate', round_even(unknown_rate, 4) FROM m1
  UNION ALL SELECT side, 'false_positive_rate', round_even(false_positive_rate, 4) FROM m1
  UNION ALL SELECT side, 'failure_rate', round_even(failure_rate, 4) FROM m2 UNION ALL SELECT side, 'wall_seconds', wall_seconds FROM m2
  UNION ALL SELECT side, 'calls_per_row', round_even(calls_per_row, 4) FROM m2),
limits(metric, kind, fail, warn) AS (VALUES ('accuracy', 'DROP', 0.05::DOUBLE, NULL::DOUBLE), ('macro_f1', 'DROP', 0.03, NULL),
  ('false_positive_rate', 'RISE', 0.0, NULL), ('unknown_rate', 'RISE', 0.10, 0.02), ('failure_rate', 'CEILING', 0.05, NULL),
  ('wall_seconds', 'RATIO', 0.50, 0.30), ('calls_per_row', 'RATIO', NULL, 0.30), ('not_measured', 'DROP', 0.05, NULL)),
c AS (SELECT l.*, r.value AS run_value, b.value AS base_value,
        CASE kind WHEN 'DROP' THEN b.value - r.value WHEN 'RISE' THEN r.value - b.value WHEN 'CEILING' THEN r.value
          WHEN 'RATIO' THEN CASE WHEN b.value <> 0 THEN (r.value - b.value) / b.value END END AS change
      FROM limits l LEFT JOIN (SELECT * FROM metrics WHERE side = 'run') r USING (metric) LEFT JOIN (SELECT * FROM metrics WHERE side = 'base') b USING (metric)),
checks AS (SELECT metric, kind, run_value, base_value, round_even(change, 4) AS change,
  CASE WHEN change IS NULL THEN 'SKIP' WHEN change > fail THEN 'FAIL' WHEN change > warn THEN 'WARN' ELSE 'PASS' END AS status FROM c)"""


def run_metrics(spark, sf):
    """(side, metric, value) of two halves of the data, read as a run and its baseline."""
    n = F.count(F.lit(1))
    wrong = F.col("expected") != "APPLIES"
    m1 = ad.scored(spark, sf).groupBy(F.when(F.col("lang") == "en", "run").otherwise("base").alias("side")).agg(
        ratio4(F.count_if(F.col("expected") == F.col("predicted")), n).alias("accuracy"),
        ratio4(F.count_if(F.col("predicted") == "UNKNOWN"), n).alias("unknown_rate"),
        ratio4(F.count_if(wrong & (F.col("predicted") == "APPLIES")), F.count_if(wrong)).alias("false_positive_rate"))
    m2 = ad.calls(spark, sf).groupBy(F.when(F.col("run_id").isin("run_0", "run_1"), "run").otherwise("base").alias("side")).agg(
        ratio4(F.count_if(F.col("status") != "OK"), n).alias("failure_rate"), (F.sum("elapsed_ms") / 1000.0).alias("wall_seconds"),
        ratio4(n, F.count_distinct("user_id")).alias("calls_per_row"))
    long1 = m1.unpivot("side", ["accuracy", "unknown_rate", "false_positive_rate"], "metric", "value")
    return long1.unionByName(m2.unpivot("side", ["failure_rate", "wall_seconds", "calls_per_row"], "metric", "value"))


def _checks(spark, sf):
    metrics = run_metrics(spark, sf)
    limits = spark.createDataFrame(list(GATE_LIMITS), "metric string, kind string, fail double, warn double")
    return sc.gate_checks(metrics.filter("side = 'run'").drop("side"), metrics.filter("side = 'base'").drop("side"), limits)


@query("agg23_gate_checks", "AGG23", sql=f"WITH {RUN_METRICS_SQL} SELECT metric, kind, run_value, base_value, change, status FROM checks")
def agg23_gate_checks(spark, sf):
    return _checks(spark, sf)


@query("agg23_gate_overall", "AGG23", sql=f"""WITH {RUN_METRICS_SQL}
SELECT CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS overall FROM checks""")
def agg23_gate_overall(spark, sf):
    return sc.gate_overall(_checks(spark, sf))


@query("src21_metric_report", "SRC21", "SRC22", sql=f"""WITH {RUN_METRICS_SQL}
SELECT metric, max(value) FILTER (side = 'base') AS base, max(value) FILTER (side = 'run') AS run,
  round_even(max(value) FILTER (side = 'run') - max(value) FILTER (side = 'base'), 4) AS delta FROM metrics GROUP BY metric""")
def src21_metric_report(spark, sf):
    wide = run_metrics(spark, sf).groupBy("metric").pivot("side", ["base", "run"]).agg(F.max("value"))
    return wide.withColumn("delta", F.bround(F.col("run") - F.col("base"), 4))


@query("agg19_selective_pipeline", "AGG19", sql=f"""
WITH {sq.SCORED},
r AS (SELECT lang AS split, n_chars >= 300 AND n_chars < 6000 AS auto, expected, predicted FROM scored)
SELECT split, count(*)::BIGINT AS n, {sq.ratio4('count(*) FILTER (auto AND expected = predicted)', 'count(*) FILTER (auto)')} AS auto_accuracy,
  {sq.ratio4('count(*) FILTER (expected = predicted)', 'count(*)')} AS strict_accuracy, {sq.ratio4('count(*) FILTER (NOT auto)', 'count(*)')} AS review_rate,
  count(*) FILTER (predicted = 'APPLIES' AND expected <> 'APPLIES')::BIGINT AS overclaims,
  {sq.ratio4('count(*) FILTER (NOT auto AND expected <> predicted)', 'count(*) FILTER (expected <> predicted)')} AS errors_escalated
FROM r GROUP BY split""")
def agg19_selective_pipeline(spark, sf):
    auto = (F.col("n_chars") >= 300) & (F.col("n_chars") < 6000)
    right, n = F.col("expected") == F.col("predicted"), F.count(F.lit(1))
    return ad.scored(spark, sf).groupBy(F.col("lang").alias("split")).agg(
        n.alias("n"), ratio4(F.count_if(auto & right), F.count_if(auto)).alias("auto_accuracy"),
        ratio4(F.count_if(right), n).alias("strict_accuracy"), ratio4(F.count_if(~auto), n).alias("review_rate"),
        F.count_if((F.col("predicted") == "APPLIES") & (F.col("expected") != "APPLIES")).alias("overclaims"),
        ratio4(F.count_if(~auto & ~right), F.count_if(~right)).alias("errors_escalated"))


ERROR_RULES = (("expected = 'UNKNOWN'", "LABEL_DISPUTED"), ("predicted = 'UNREAD'", "NOT_READ"), ("n_chars > 6000", "CONTEXT_TOO_LONG"),
               ("lang <> 'en'", "LANGUAGE_RULE"), ("predicted = 'APPLIES'", "OVERCLAIM"), ("predicted <> 'APPLIES'", "UNDERCLAIM"))
_HITS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in ERROR_RULES) + "], lambda x: x IS NOT NULL)"


@query("agg21_error_categories", "AGG21", "AGG22", sql=f"""
WITH {sq.SCORED}, e AS (SELECT doc_id, {_HITS} AS hits, CASE WHEN source = 'src1' THEN 'REVIEWER_NOTE' END AS annotated FROM scored WHERE expected <> predicted)
SELECT doc_id, coalesce(annotated, hits[1]) AS category, array_to_string(hits[2:], '; ') AS secondary FROM e""")
def agg21_error_categories(spark, sf):
    wrong = ad.scored(spark, sf).filter(F.col("expected") != F.col("predicted"))
    primary, secondary = sc.first_rule(*[(F.expr(c), n) for c, n in ERROR_RULES])
    annotated = F.when(F.col("source") == "src1", "REVIEWER_NOTE")
    return wrong.select("doc_id", F.coalesce(annotated, primary).alias("category"), secondary.alias("secondary"))


@query("agg31_transitions", "AGG31", sql=f"""
WITH {sq.SCORED}
SELECT expected || ' -> ' || predicted AS transition, count(*)::BIGINT AS n, count(*) FILTER (n_chars > 2000)::BIGINT AS fixable_by_label
FROM scored WHERE expected <> predicted GROUP BY 1""")
def agg31_transitions(spark, sf):
    wrong = ad.scored(spark, sf).filter(F.col("expected") != F.col("predicted"))
    return wrong.groupBy(F.concat_ws(" -> ", "expected", "predicted").alias("transition")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 2000).alias("fixable_by_label"))


@query("agg20_label_audit", "AGG20", sql="""
WITH votes AS (SELECT l_orderkey, l_linenumber, count(*) AS runs, min(l_returnflag) AS lo, max(l_returnflag) AS hi, min(l_linestatus) AS label
               FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, runs::BIGINT AS runs, lo AS said, label FROM votes WHERE runs >= 2 AND lo = hi AND lo <> label""")
def agg20_label_audit(spark, sf):
    from ..sources.tables import table

    votes = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("runs"), F.min("l_returnflag").alias("said"), F.max("l_returnflag").alias("_hi"), F.min("l_linestatus").alias("label"))
    return votes.filter("runs >= 2 AND said = _hi AND said <> label").select("l_orderkey", "l_linenumber", "runs", "said", "label")


@query("agg26_passage_votes", "AGG26", sql="""
SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS votes, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'UNCLEAR' END AS relation
FROM lineitem GROUP BY ALL""")
def agg26_passage_votes(spark, sf):
    from ..sources.tables import table

    return sc.agreement(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")
