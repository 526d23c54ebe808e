"""Scores of a run. Every function aggregates once to a small table of counts and derives the measures from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio4


def retrieval_metrics(best: DataFrame) -> DataFrame:
    """``best(rank, hit)``, one row per duty: recall at 3/5/10, mean reciprocal rank over all duties, evidence hit rate."""
    n = F.count(F.lit(1))
    at = lambda k: ratio4(F.count_if(F.col("rank") <= k), n)
    return best.agg(
        n.alias("n"), at(3).alias("recall_at_3"), at(5).alias("recall_at_5"), at(10).alias("recall_at_10"),
        ratio4(F.coalesce(F.sum(F.lit(1.0) / F.col("rank")), F.lit(0.0)), n).alias("mrr"),
        ratio4(F.count_if(F.col("hit")), n).alias("evidence_hit_rate"))


# The classes a run is scored over, where a label may come from, when a call is a reload.
APPLICABILITY = ("APPLIES", "DOES_NOT_APPLY", "UNKNOWN")
LABEL_SOURCES = ("HUMAN_REVIEWED", "MANUAL_LEGAL_READING", "SYNTHETIC_CONTROLLED", "RULE_DERIVED")
DEFAULT_LABEL_SOURCE = "RULE_DERIVED"
RELOAD_MS = 500
FULL_GPU = 0.995
NOT_SENT = ("CONTEXT_BUDGET_EXCEEDED", "CIRCUIT_OPEN")
FALLBACK_ACTIONS = ("fallback_large", "fallback_large_after_truncation")


def f1(precision: Column, recall: Column) -> Column:
    """Of the rounded precision and recall; 0 when both are 0, NULL when either is undefined."""
    total = precision + recall
    return F.when(total.isNull(), F.lit(None)).when(total == 0, F.lit(0.0)).otherwise(F.bround(F.lit(2.0) * precision * recall / total, 4))


def confusion(scored: DataFrame, labels, by: list[str] = ()) -> DataFrame:
    """Counts per (expected, predicted); a prediction outside the labels is OTHER, an expectation outside them is dropped."""
    predicted = F.when(F.col("predicted").isin(*labels), F.col("predicted")).otherwise("OTHER")
    return (
        scored.filter(F.col("expected").isin(*labels)).withColumn("predicted", predicted)
        .groupBy(*by, "expected", "predicted").agg(F.count(F.lit(1)).alias("n"))
    )


def per_class(counts: DataFrame, labels, by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every label from a confusion table (one row per label)."""
    spark = counts.sparkSession
    names = spark.createDataFrame([(label,) for label in labels], "label string")
    groups = counts.select(*by).distinct() if by else None
    grid = names if groups is None else groups.join(F.broadcast(names))
    marked = counts.select(*by, "n", F.explode(F.array_distinct(F.array("expected", "predicted"))).alias("label"), "expected", "predicted")
    tallies = marked.groupBy(*by, "label").agg(
        F.sum(F.when((F.col("expected") == F.col("label")) & (F.col("predicted") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("expected") != F.col("label")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("predicted") != F.col("label")), F.col("n")).otherwise(0)).alias("fn"),
    )
    filled = grid.join(tallies, [*by, "label"], "left").fillna(0, ["tp", "fp", "fn"])
    scored = filled.withColumn("precision", ratio4(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", ratio4(F.col("tp"), F.col("tp") + F.col("fn")))
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("support", F.col("tp") + F.col("fn"))


def macro(classes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Averages over the classes that occur; an undefined value counts 0. Accuracy over all rows."""
    present = F.col("support") > 0
    mean = lambda c: F.bround(F.sum(F.when(present, F.coalesce(c, F.lit(0.0)))) / F.count_if(present), 4)
    return classes.groupBy(*by).agg(
        F.sum("support").alias("n"), ratio4(F.sum("tp"), F.sum("support")).alias("accuracy"),
        mean(F.col("precision")).alias("macro_precision"), mean(F.col("recall")).alias("macro_recall"), mean(F.col("f1")).alias("macro_f1"))


def binary(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """``scored(expected BOOLEAN, predicted BOOLEAN)`` -> precision, recall, F1, false positive rate and counts."""
    e, p = F.col("expected"), F.col("predicted")
    counts = scored.groupBy(*by).agg(
        F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn"))
    out = counts.withColumn("precision", ratio4(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", ratio4(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn(
        "false_positive_rate", ratio4(F.col("fp"), F.col("fp") + F.col("tn"))).withColumn(
        "n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))


def exclusion_rates(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """How often the gate ruled out what applies, and let in what it should rule out."""
    e, p = F.col("expected"), F.col("predicted")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(e).alias("expected_excluded"),
        F.count_if(~e & p).alias("false_exclusions"), F.count_if(e & ~p).alias("false_inclusions"),
        ratio4(F.count_if(~e & p), F.count_if(~e)).alias("false_exclusion_rate"),
        ratio4(F.count_if(e & ~p), F.count_if(e)).alias("false_inclusion_rate"))


def label_source(field: Column, row: Column, case: Column, dataset: Column) -> Column:
    """Where an asserted field comes from: the field's own source, the row's, the case's, the dataset's, else rule derived."""
    return F.coalesce(field, row, case, dataset, F.lit(DEFAULT_LABEL_SOURCE))


def is_timeout(call_error: Column) -> Column:
    text = F.lower(F.coalesce(call_error, F.lit("")))
    return text.contains("time limit") | text.contains("timeout")


def reliability(calls: DataFrame, by: list[str] = ()) -> DataFrame:
    failed = F.col("status") != "OK"
    n = F.count(F.lit(1))
    return calls.groupBy(*by).agg(
        n.alias("calls"), F.count_if(failed).alias("failures"), ratio4(F.count_if(failed), n).alias("model_failure_rate"),
        F.count_if(failed & is_timeout(F.col("error"))).alias("timeouts"),
        ratio4(F.count_if(failed & is_timeout(F.col("error"))), n).alias("timeout_rate"),
        F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retries"))


def failures_by_code(calls: DataFrame, by: list[str] = ()) -> DataFrame:
    return (
        calls.filter(F.col("status") != "OK")
        .groupBy(*by, F.coalesce("failure_code", "status", F.lit("UNKNOWN")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    )


def call_costs_rollup(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, model time, tokens, cache hits and reasoning calls, rolled up over ``by``."""
    live, strong = ~F.col("cache_hit"), F.col("thinking") & F.col("task").startswith("judge.")
    n = F.count(F.lit(1))
    return calls.rollup(*by).agg(
        n.alias("calls"), F.count_if(live).alias("live_calls"), F.coalesce(F.sum("elapsed_ms"), F.lit(0)).alias("model_ms"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        ratio4(F.count_if(F.col("cache_hit")), n).alias("cache_hit_ratio"),
        F.count_if(F.col("thinking")).alias("thinking_calls"), F.count_if(F.col("thinking") & live).alias("thinking_calls_live"),
        F.count_if(strong).alias("strong_model_calls"))


def exact_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., median): from the counts of the distinct values, so equal values are one row before they are ordered."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_upto", F.sum("_n").over(ordered)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    at = lambda place: F.min(F.when(F.col("_upto") >= place, F.col(value)))
    low, high = at(F.floor((F.col("_all") + 1) / 2)), at(F.floor(F.col("_all") / 2) + 1)
    return placed.groupBy(*by).agg(((low + high) / 2).alias("median"))


def runtime_breakdown(calls: DataFrame, run: str) -> DataFrame:
    """Live model time by model, by window and by both, with the share of calls that ran fully on the GPU."""
    live = calls.filter(~F.col("cache_hit"))
    view = lambda name, model, ctx: F.struct(
        F.lit(name).alias("_view"), (F.col("model") if model else F.lit("*")).alias("_model"), (F.col("num_ctx") if ctx else F.lit(0)).cast("bigint").alias("_ctx"))
    views = F.array(view("model", True, False), view("window", False, True), view("both", True, True))
    rows = live.select(run, "elapsed_ms", "gpu_fraction", "tokens_per_second", F.explode(views).alias("_v")).select(run, "elapsed_ms", "gpu_fraction", "tokens_per_second", "_v.*")
    by = [run, "_view", "_model", "_ctx"]
    seen = F.col("gpu_fraction").isNotNull()
    totals = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("live_calls"), F.sum("elapsed_ms").alias("model_ms"), F.count_if(seen).alias("observed"),
        F.count_if(F.col("gpu_fraction") >= FULL_GPU).alias("full_gpu"),
        ratio4(F.count_if(F.col("gpu_fraction") >= FULL_GPU), F.count_if(seen)).alias("full_gpu_share"))
    out = totals.join(exact_median(rows, by, "tokens_per_second"), by, "left")
    return out.select(
        run, F.when(F.col("_view") != "window", F.col("_model")).alias("model"), F.when(F.col("_view") != "model", F.col("_ctx")).alias("num_ctx"),
        "live_calls", "model_ms", "observed", "full_gpu", "full_gpu_share", F.col("median").alias("median_rate"))


def model_switches(calls: DataFrame, run: str, block: str) -> DataFrame:
    """Consecutive calls that reached a model with another model, or the same one at another window, in start order."""
    from ..functions import scan

    sent = calls.filter(~F.col("cache_hit") & ~F.col("status").isin(*NOT_SENT)).withColumn("_use", F.struct("model", "num_ctx"))
    ordered = scan.previous(sent, [run], block, [F.col("at"), F.col("call_id")], "_use", "_before")
    model, before = F.col("model"), F.col("_before")
    return ordered.groupBy(run).agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(before["model"] != model).alias("model_switches"),
        F.count_if((before["model"] == model) & (before["num_ctx"] != F.col("num_ctx"))).alias("window_switches"),
        F.count_if(F.col("load_duration_ms") >= RELOAD_MS).alias("model_loads"))


def stage_costs(predictions: DataFrame, stages) -> DataFrame:
    """Mean, median, max and total per stage over the assessed rows; a stage a row did not run counts 0."""
    rows = predictions.filter(F.col("coverage_assessed"))
    each = rows.select(F.explode(F.transform(F.array(*[F.lit(s) for s in stages]), lambda s: F.struct(
        s.alias("stage"), F.coalesce(F.try_element_at("timings_ms", s), F.lit(0)).alias("ms"),
        F.map_contains_key("timings_ms", s).alias("ran")))).alias("e")).select("e.*")
    totals = each.groupBy("stage").agg(
        F.count_if("ran").alias("obligations"), F.bround(F.avg("ms") / 1000, 2).alias("mean_s"),
        F.bround(F.max("ms") / 1000, 2).alias("max_s"), F.bround(F.sum("ms") / 1000, 1).alias("total_s"))
    return totals.join(exact_median(each, ["stage"], "ms"), "stage").select(
        "stage", "obligations", "mean_s", F.bround(F.col("median") / 1000, 2).alias("median_s"), "max_s", "total_s")


def gate_checks(run: DataFrame, baseline: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per limit: PASS / WARN / FAIL / SKIP.

    ``run`` and ``baseline`` are (metric, value); ``limits`` is (metric, kind, fail, warn) with kind DROP, RISE, CEILING or
    RATIO (relative to the baseline).
    """
    joined = limits.join(run.withColumnRenamed("value", "run_value"), "metric", "left").join(
        baseline.withColumnRenamed("value", "base_value"), "metric", "left")
    value, base, fail, warn = F.col("run_value"), F.col("base_value"), F.col("fail"), F.col("warn")
    by = (
        F.when(F.col("kind") == "DROP", base - value)
        .when(F.col("kind") == "RISE", value - base)
        .when(F.col("kind") == "CEILING", value)
        .when((F.col("kind") == "RATIO") & (base != 0), (value - base) / base)
    )
    status = (
        F.when(by.isNull(), "SKIP").when(fail.isNotNull() & (by > fail), "FAIL").when(warn.isNotNull() & (by > warn), "WARN").otherwise("PASS"))
    return joined.select("metric", "kind", "run_value", "base_value", F.bround(by, 4).alias("change"), status.alias("status"))


def gate_overall(checks: DataFrame) -> DataFrame:
    severity = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    return checks.agg(F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), severity + 1).alias("overall"))


def first_rule(*rules: tuple[Column, str]) -> tuple[Column, Column]:
    """(primary, secondary): the ordered rules that hold; the first decides, the rest are kept."""
    hits = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for condition, name in rules]))
    return F.get(hits, F.lit(0)), F.array_join(F.slice(hits, 2, len(rules)), "; ")


def agreement(votes: DataFrame, by: list[str], vote: str) -> DataFrame:
    """Repeated readings of one thing: what all agree on, UNCLEAR where any two differ; never a majority."""
    return votes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("votes"), F.when(F.min(vote) == F.max(vote), F.min(vote)).otherwise("UNCLEAR").alias("relation"))


def one_vs_rest(counts: DataFrame, labels) -> DataFrame:
    """tp / fp / fn / tn with false positive and negative rates of every label from a confusion table."""
    classes = per_class(counts, labels)
    total = counts.agg(F.sum("n").alias("_all"))
    filled = classes.join(F.broadcast(total)).withColumn("tn", F.col("_all") - F.col("tp") - F.col("fp") - F.col("fn"))
    return filled.select(
        "label", "tp", "fp", "fn", "tn", ratio4(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
        ratio4(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"))
