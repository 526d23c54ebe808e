"""Counting coverage from readings; the mapping from coverage to a gap status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _n(relation: str, extra: Column | None = None) -> Column:
    hit = F.col("relation") == relation
    return F.count_if(hit if extra is None else hit & extra)


def counted_coverage(readings: DataFrame, by: list[str]) -> DataFrame:
    """Coverage of each duty counted over its passage relations; ``is_control`` rows are evidence, counted apart."""
    policy, control = ~F.col("is_control"), F.col("is_control")
    counts = readings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_read"),
        _n("CONFLICTS").alias("conflicts"),
        _n("SUPPORTS", policy).alias("supports"),
        _n("PARTIAL", policy).alias("partial"),
        _n("UNCLEAR").alias("unclear"),
        F.count_if(control).alias("controls"),
        _n("CONFLICTS", control).alias("control_conflicts"),
        _n("SUPPORTS", control).alias("control_supports"),
        _n("PARTIAL", control).alias("control_partial"),
    )
    favourable = F.col("supports") + F.col("partial")
    coverage = (
        F.when(F.col("conflicts") > 0, "CONFLICT")
        .when((F.col("supports") > 0) & (favourable > F.col("unclear")), "COVERS_TEXT")
        .when((F.col("partial") > 0) & (favourable > F.col("unclear")), "PARTIAL")
        .when(F.col("unclear") > 0, "UNKNOWN")
        .otherwise("NO_EVIDENCE")
    )
    control_coverage = (
        F.when(F.col("control_conflicts") > 0, "CONFLICT")
        .when(F.col("control_supports") > 0, "SUPPORTS")
        .when(F.col("control_partial") > 0, "PARTIAL")
        .when(F.col("controls") > 0, "NONE")
        .otherwise("NOT_READ")
    )
    return counts.withColumn("coverage", coverage).withColumn("control_coverage", control_coverage)


# Which reading decides the document coverage first.
PRECEDENCE = (("CONFLICTS", "CONFLICT"), ("SUPPORTS", "COVERS_TEXT"), ("PARTIAL", "PARTIAL"), ("UNCLEAR", "UNKNOWN"))


def document_coverage(readings: DataFrame, by: list[str]) -> DataFrame:
    """Strongest relation per duty and the reasons of the readings that carry it."""
    seen = readings.groupBy(*by).agg(
        *[F.count_if(F.col("relation") == r).alias(f"_{r}") for r, _ in PRECEDENCE],
        *[F.collect_set(F.when(F.col("relation") == r, F.col("reason"))).alias(f"_why_{r}") for r, _ in PRECEDENCE],
    )
    coverage, reasons = F.lit("NO_EVIDENCE"), F.array(F.lit("NO_RELATED_STATEMENT"))
    for relation, name in reversed(PRECEDENCE):
        hit = F.col(f"_{relation}") > 0
        coverage = F.when(hit, name).otherwise(coverage)
        why = F.array(F.lit("SUPPORTING_STATEMENT")) if relation == "SUPPORTS" else F.sort_array(f"_why_{relation}")
        reasons = F.when(hit, why).otherwise(reasons)
    return seen.select(*by, coverage.alias("coverage"), reasons.alias("reasons"))


def mapping_status(coverage: Column, control_mapped: Column, evidence_present: Column) -> Column:
    return (
        F.when(coverage == "CONFLICT", "CONTRADICTED")
        .when(coverage == "NO_EVIDENCE", "NOT_COVERED")
        .when(coverage == "PARTIAL", "PARTIALLY_COVERED")
        .when((coverage == "COVERS_TEXT") & control_mapped & evidence_present, "COVERED")
        .when(coverage == "COVERS_TEXT", "PARTIALLY_COVERED")
        .otherwise("UNKNOWN")
    )


def mapping_reason(coverage: Column, control_mapped: Column, evidence_present: Column) -> Column:
    return (
        F.when(coverage == "CONFLICT", "POLICY_CONFLICT")
        .when(coverage == "NO_EVIDENCE", "NO_POLICY_EVIDENCE")
        .when(coverage == "PARTIAL", "PARTIAL_POLICY")
        .when((coverage == "COVERS_TEXT") & control_mapped & evidence_present, "POLICY_COVERS; CONTROL_MAPPED; EVIDENCE_PRESENT")
        .when((coverage == "COVERS_TEXT") & control_mapped, "POLICY_COVERS; EVIDENCE_MISSING")
        .when(coverage == "COVERS_TEXT", "POLICY_COVERS; CONTROL_MISSING")
        .otherwise("COVERAGE_UNKNOWN")
    )


# Gaps the rule comparer names element by element, and reasons under which it decided nothing.
ELEMENT_GAPS = (
    "PLACE_MISSING", "PLACES_MISSING", "LIMIT_MISSING", "PREDICATE_NOT_STATED", "TIME_WINDOW_", "CONDITION_NARROWER",
    "POLICY_ADDS_EXCEPTION", "POLICY_OPTIONAL", "ITEM_MISSING", "ACT_MISSING", "PARTICULAR_MISSING", "DEADLINE_MISSING",
)


def combine(rule: Column, reasons: Column, model: Column, adjudicated: Column) -> Column:
    """struct(coverage, basis, review) from the rule comparer's and a recorded reader's coverage of one duty.

    ``reasons`` is the array of the rule comparer's reasons. Each arm is one line of the decision table, read in order.
    """

    def row(coverage, basis, review) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(as_col(coverage).alias("coverage"), as_col(basis).alias("basis"), as_col(review).alias("review"))

    def agreed(word: str, otherwise: str) -> Column:
        return F.when(model == word, "BOTH_READINGS").otherwise(otherwise)

    element_gap = F.exists(reasons, lambda r: F.array_contains(
        F.transform(F.array(*[F.lit(g) for g in ELEMENT_GAPS]), lambda g: F.startswith(r, g)), True))
    return (
        F.when(model.isNull(), row(rule, "RULE_ONLY", rule.isin("CONFLICT", "UNKNOWN")))
        .when(rule == "CONFLICT", row("CONFLICT", agreed("CONFLICT", "RULE_ELEMENT_CHECK"), True))
        .when(model == "CONFLICT", row(rule, "MODEL_CONFLICT_UNCONFIRMED", True))
        .when((rule == "PARTIAL") & element_gap, row("PARTIAL", agreed("PARTIAL", "RULE_ELEMENT_CHECK"), False))
        .when((rule == "COVERS_TEXT") & (model == "PARTIAL"), row("COVERS_TEXT", "MODEL_SEES_GAP", True))
        .when(rule == "COVERS_TEXT", row("COVERS_TEXT", agreed("COVERS_TEXT", "RULE_WORDING_MATCH"), False))
        .when(model == "COVERS_TEXT",
              row(rule, F.when(adjudicated, "MODEL_PROPOSES_COVERED").otherwise("MODEL_PARAPHRASE_UNCONFIRMED"), True))
        .when((model == "PARTIAL") & adjudicated & (rule == "NO_EVIDENCE"), row(rule, "MODEL_PROPOSES_PARTIAL", True))
        .when(model == "PARTIAL",
              row(rule, F.when(rule == "PARTIAL", "BOTH_READINGS").otherwise("MODEL_PARTIAL_UNCONFIRMED"), rule != "PARTIAL"))
        .when((rule == "UNKNOWN") | (model == "UNKNOWN"), row(rule, "RULE_ONLY", True))
        .otherwise(row(rule, F.when(rule == model, "BOTH_READINGS").otherwise("RULE_ONLY"), False))
    )


def element_coverage(readings: DataFrame, duties: DataFrame, by: str, strong_gate: bool = True) -> DataFrame:
    """Coverage by elements: do the favourable passages, alone or together, state every critical element and number?

    ``readings(<by>, relation, is_control, uncertainty, covered, missing, strong, rejected, failed)`` where ``covered`` and
    ``missing`` are element ids, ``strong`` says a strong reader has read the passage, ``rejected`` that it found a favourable
    one to be about something else and ``failed`` that its confirmation failed. ``duties(<by>, critical, numbers)`` are the
    element ids of a duty (its numbers must be met, the rest stated). A duty has a handful of elements, so the distinct
    readings kept per duty stay few however many passages were read.
    """
    policy = ~F.col("is_control")
    favourable = policy & F.col("relation").isin("SUPPORTS", "PARTIAL")
    distinct_readings = F.collect_set(F.when(favourable, F.struct("relation", "covered", "missing", "strong", "numbers_met")))
    seen = readings.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_read"), F.count_if(F.col("relation") == "CONFLICTS").alias("conflicts"),
        F.count_if((F.col("relation") == "UNCLEAR") & F.col("uncertainty").eqNullSafe("strong")).alias("open_conflicts"),
        F.count_if((F.col("relation") == "UNCLEAR") & ~F.col("uncertainty").eqNullSafe("strong")).alias("weak"),
        F.count_if(favourable).alias("favourable"), F.count_if(policy & F.col("rejected")).alias("rejected"),
        F.count_if(F.col("failed")).alias("failed"), distinct_readings.alias("_r"))
    rows = duties.join(seen, by, "left").fillna(0, ["n_read", "conflicts", "open_conflicts", "weak", "favourable", "rejected", "failed"])
    rows = rows.withColumn("_r", F.coalesce("_r", F.expr("array()").cast(dict(seen.dtypes)["_r"])))
    verified = F.filter("_r", lambda r: r["strong"]) if strong_gate else F.col("_r")
    gather = lambda array, field: F.array_distinct(F.flatten(F.transform(array, lambda r: r[field])))
    met = gather(F.col("_r"), "numbers_met")
    rows = rows.withColumn("_met", met).withColumn("_unmet", F.array_except("numbers", met))
    rows = rows.withColumn("_fast", F.array_union(gather(F.col("_r"), "covered"), F.col("_met"))).withColumn(
        "_union", F.array_union(gather(verified, "covered"), F.col("_met")))

    def covering(union: str) -> Column:
        states_rest = lambda r: F.size(F.array_except(F.array_intersect(r["missing"], F.col("critical")), F.col(union))) == 0
        return F.exists("_r", lambda r: (r["relation"] == "SUPPORTS") & states_rest(r))

    def joint(union: str) -> Column:
        missed = F.array_except(F.array_intersect(gather(F.col("_r"), "missing"), F.col("critical")), F.col(union))
        return (F.col("favourable") > 1) & (F.size("critical") > 0) & (F.size(F.array_except("critical", F.col(union))) == 0) & (F.size(missed) == 0)

    numbers_ok = F.size("_unmet") == 0
    proposed = (covering("_fast") | joint("_fast")) & numbers_ok
    stands = (covering("_union") | joint("_union")) & numbers_ok
    any_strong = F.exists("_r", lambda r: r["strong"])
    decisive_strong = F.when(covering("_fast"), F.exists("_r", lambda r: r["strong"] & (r["relation"] == "SUPPORTS"))).otherwise(any_strong)
    gate_on = F.lit(strong_gate)
    rows = rows.withColumn("_unconfirmed", proposed & gate_on & ~decisive_strong)
    unread = gate_on & (F.col("favourable") > 0) & ~any_strong
    coverage = (
        F.when(F.col("n_read") == 0, "NO_EVIDENCE").when(F.col("conflicts") > 0, "CONFLICT").when(F.col("open_conflicts") > 0, "UNKNOWN")
        .when(unread & (F.col("rejected") > 0) & (F.col("failed") == 0), "NO_EVIDENCE")
        .when(unread & F.col("_unconfirmed") & (F.col("failed") > 0), "UNKNOWN")
        .when(stands & ~F.col("_unconfirmed"), "COVERS_TEXT").when(F.col("favourable") > 0, "PARTIAL")
        .when(F.col("weak") > 0, "UNKNOWN").otherwise("NO_EVIDENCE"))
    settled = (F.col("conflicts") == 0) & (F.col("open_conflicts") == 0) & (F.col("n_read") > 0)
    flags = F.array_compact(F.array(
        F.when(F.col("open_conflicts") > 0, F.lit("POSSIBLE_CONFLICT_UNRESOLVED")),
        F.when(settled & F.col("_unconfirmed"), F.lit("COVERS_UNCONFIRMED")),
        F.when(settled & unread & ~F.col("_unconfirmed"), F.lit("PARTIAL_UNCONFIRMED")),
        F.when(settled & unread & F.col("_unconfirmed") & (F.col("failed") > 0), F.lit("VERIFIER_FAILED"))))
    return rows.select(by, coverage.alias("coverage"), F.array_join(flags, "; ").alias("flags"))
