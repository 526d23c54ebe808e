"""From gaps to approved actions: actions, exports, review tasks, approvals, ledgers, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scan


def canonical(*columns: Column) -> Column:
    """One string per row that two engines agree on: values in the given order, NULL as ``~``.

    A ``\\``, ``|`` or ``~`` inside a value is written behind a ``\\``, so different rows have different strings.
    """
    return F.concat_ws("|", *[F.coalesce(F.regexp_replace(c.cast("string"), r"([\\|~])", r"\\$1"), F.lit("~")) for c in columns])


def fingerprint(*columns: Column) -> Column:
    return F.sha2(canonical(*columns), 256)


def evidence_number(value: Column) -> Column:
    """A number as evidence may hold it: an integer when whole, else a decimal string without trailing zeros."""
    fixed = F.format_string("%.6f", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), "[.]$", "")


# What a mapping status calls for.
def action_of(status: Column, reason: Column) -> Column:
    """The action a mapping row calls for; NULL when it is covered."""
    return (
        F.when(status == "CONTRADICTED", "UPDATE_DOCUMENT").when(status == "NOT_COVERED", "ADD_POLICY_STATEMENT")
        .when((status == "PARTIALLY_COVERED") & reason.contains("PARTIAL_POLICY"), "COMPLETE_STATEMENT")
        .when((status == "PARTIALLY_COVERED") & reason.contains("CONTROL_MISSING"), "ADD_CONTROL")
        .when(status == "PARTIALLY_COVERED", "COLLECT_EVIDENCE").when(status == "UNKNOWN", "REVIEW"))


def remediation(applicability: Column, coverage: Column, criminal: Column) -> Column:
    """struct(type, priority) of the proposal a gap calls for; NULL where there is no gap."""
    kind = (
        F.when(coverage == "CONFLICT", "RESOLVE_CONFLICT").when(coverage == "NO_EVIDENCE", "ADD_POLICY")
        .when(coverage == "PARTIAL", "AMEND_POLICY").when(coverage == "UNKNOWN", "MANUAL_REVIEW"))
    priority = F.when((coverage == "CONFLICT") | criminal, "HIGH").when(coverage == "NO_EVIDENCE", "MEDIUM").otherwise("LOW")
    return F.when((applicability != "DOES_NOT_APPLY") & kind.isNotNull(), F.struct(kind.alias("type"), priority.alias("priority")))


def export_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exported rows, ledger): equal readings of one duty and target by several packs merge, different ones are kept apart.

    ``rows(seq, pack, row_id, fingerprint, covered_auto)`` in reading order; every input row has exactly one ledger line.
    """
    kept = rows.filter("NOT covered_auto")
    merged = kept.groupBy("row_id", "fingerprint").agg(F.min_by("pack", "seq").alias("_first_pack"), F.min("seq").alias("_seq"),
                                                       F.array_join(F.array_sort(F.collect_set("pack")), "; ").alias("packs"))
    firsts = kept.groupBy("row_id").agg(F.min_by("fingerprint", "seq").alias("_first"))
    named = merged.join(firsts, "row_id")
    original = F.col("fingerprint") == F.col("_first")
    exported = named.select(
        F.when(original, F.col("row_id")).otherwise(F.concat_ws(":", "row_id", "_first_pack")).alias("export_id"), "row_id", "fingerprint", "packs")
    # a covered row is told by itself; the others travel once, by their row id, and are sorted once, equal readings in reading order
    alike = Window.partitionBy("row_id", "fingerprint").orderBy(F.col("covered_auto").isNull(), "seq")
    turned = rows.filter("covered_auto IS NOT TRUE").repartition("row_id").withColumn("_turn", F.row_number().over(alike))
    leads = F.when((F.col("_turn") == 1) & ~F.col("covered_auto"), F.col("seq"))
    told = turned.withColumn("_first", F.min_by("fingerprint", leads).over(Window.partitionBy("row_id")))
    outcome = (
        F.when(F.col("row_id").isNull() | F.col("fingerprint").isNull(), "EXPORTED_PACKS_DISAGREE").when(F.col("_turn") > 1, "MERGED_SAME_DUTY_AND_TARGET")
        .when((F.col("fingerprint") == F.col("_first")) & ~F.col("covered_auto"), "EXPORTED").otherwise("EXPORTED_PACKS_DISAGREE"))
    covered = rows.filter("covered_auto").select("seq", "pack", "row_id", F.lit("EXCLUDED_COVERED_AUTO").alias("outcome"))
    ledger = told.select("seq", "pack", "row_id", outcome.alias("outcome")).unionByName(covered)
    return exported, ledger


def group_reviews(items: DataFrame) -> DataFrame:
    """Parent tasks of review records that share type, cause, department and subject.

    ``items(row_id, review_type, cause, department, subject, clause, entity, target, fingerprint)``. The task carries counts
    and an order-independent mark of its children, never the list of them.
    """
    key = ["review_type", "cause", "department", "subject"]
    part = lambda start: F.sum(F.conv(F.substring("fingerprint", start, 12), 16, 10).cast("decimal(38,0)"))
    return items.groupBy(*key).agg(
        F.count(F.lit(1)).alias("children"), F.count_distinct("clause").alias("clauses"), F.count_distinct("entity").alias("entities"),
        F.count_distinct("target").alias("targets"), part(1).alias("_a"), part(13).alias("_b")).select(
        F.concat(F.lit("TASK:"), F.substring(fingerprint(*[F.col(k) for k in key]), 1, 16)).alias("task_id"), *key, "children", "clauses",
        "entities", "targets", F.sha2(F.concat_ws(":", "children", "_a", "_b"), 256).alias("fingerprint"))


# What a decision does to the actions of its row.
ACTION_STATE = {"APPROVED": "READY", "REJECTED": "CANCELLED", "RETURNED": "DRAFT"}


def apply_approvals(export: DataFrame, entries: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their decision, problems).

    ``export(row_id, fingerprint, recomputed)``; ``entries(row_id, fingerprint, decision, approver, decided_at)``;
    ``children(row_id, task_id)`` are records decided through their task. An entry counts only while the row's content still
    gives the exported fingerprint and that is the one the reviewer saw. The latest decision holds; two at one time are none.
    """
    modified = F.col("recomputed") != F.col("row_fingerprint")
    rows = export.select("row_id", F.col("fingerprint").alias("row_fingerprint"), "recomputed")
    joined = entries.join(rows, "row_id", "left").join(children, "row_id", "left")
    problem = (
        F.when(F.col("row_fingerprint").isNull() & F.col("task_id").isNotNull(), "APPROVE_THE_TASK")
        .when(F.col("row_fingerprint").isNull(), "UNKNOWN_ROW").when(modified, "EXPORT_MODIFIED")
        .when(F.col("fingerprint") != F.col("row_fingerprint"), "STALE_APPROVAL"))
    checked = joined.withColumn("problem", problem)
    good = checked.filter("problem IS NULL").select("row_id", "decision", "approver", "decided_at").distinct()
    # several decisions of one row: only the newest moment matters, and it must name one decision by one approver
    newest = good.groupBy("row_id").agg(F.max("decided_at").alias("decided_at"), F.count(F.lit(1)).alias("decisions"))
    at_newest = good.join(newest, ["row_id", "decided_at"]).groupBy("row_id").agg(
        F.count(F.lit(1)).alias("_at_once"), F.min("decision").alias("decision"), F.min("approver").alias("approver"),
        F.min("decided_at").alias("decided_at"), F.min("decisions").alias("decisions"))
    twice = at_newest.filter("_at_once > 1").select("row_id", F.lit("DECIDED_TWICE").alias("problem"))
    decided = at_newest.filter("_at_once = 1")
    state = F.lit("DRAFT")
    for word, value in ACTION_STATE.items():
        state = F.when(F.col("decision") == word, value).otherwise(state)
    out = rows.join(decided, "row_id", "left").select(
        "row_id", F.coalesce("decision", F.lit("PENDING")).alias("status"), state.alias("action_state"),
        (F.coalesce("decisions", F.lit(1)) - 1).cast("bigint").alias("earlier"))
    edited = rows.filter(modified).select("row_id", F.lit("EXPORT_MODIFIED").alias("problem"))
    refused = checked.filter("problem IS NOT NULL AND problem <> 'EXPORT_MODIFIED'").select("row_id", "problem")
    return out, refused.unionByName(edited).unionByName(twice)


def latest_decisions(entries: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Newest decision per row with how many came before and whether the newest moment is shared."""
    return entries.groupBy(key).agg(
        F.max_by("decision", F.struct(*order)).alias("decision"), F.count(F.lit(1)).alias("decisions"), F.max("decided_at").alias("decided_at"))


def chain_breaks(log: DataFrame, key: str, block: str, order: list[Column], content: Column) -> DataFrame:
    """Rows of an append-only log whose link to the row before, own hash or sequence is wrong."""
    linked = scan.previous(log, [key], block, order, "entry_hash", "_before")
    # judged before the rows are numbered, so that content and hashes need not travel with them again
    broken = F.when(F.sha2(content, 256) != F.col("entry_hash"), "CONTENT_CHANGED").when(~F.col("previous_hash").eqNullSafe(F.col("_before")), "LINK_BROKEN")
    numbered = scan.row_number(linked.withColumn("_broken", broken).drop("_before"), [key], block, order, "_place")
    problem = F.coalesce("_broken", F.when(F.col("seq") != F.col("_place"), "SEQUENCE_GAP"))
    return numbered.withColumn("problem", problem).filter("problem IS NOT NULL").drop("_broken", "_place")


def ledger_problems(events: DataFrame, key: str, order: Column) -> DataFrame:
    """Entries whose life is not: PROPOSED once, first; at most one terminal event, last."""
    terminal = F.col("event").isin("ACCEPTED", "REJECTED")
    life = events.groupBy(key).agg(
        F.min_by("event", order).alias("first_event"), F.max_by("event", order).alias("last_event"),
        F.count_if(F.col("event") == "PROPOSED").alias("proposed"), F.count_if(terminal).alias("terminal"))
    problem = (
        F.when(F.col("first_event") != "PROPOSED", "NOT_PROPOSED_FIRST").when(F.col("proposed") > 1, "PROPOSED_TWICE")
        .when(F.col("terminal") > 1, "DECIDED_TWICE")
        .when((F.col("terminal") == 1) & ~F.col("last_event").isin("ACCEPTED", "REJECTED"), "EVENT_AFTER_DECISION"))
    return life.withColumn("problem", problem)


def autonomous_gate(unavailable: Column, flags: Column, status: Column, hedged: Column, grounded: Column, unclear: Column) -> Column:
    """First reason why a proposal may not stand on its own (NULL = decided)."""
    return (
        F.when(unavailable, "MODEL_UNAVAILABLE").when(flags > 0, "REVIEW_FLAG").when(status == "UNKNOWN", "UNKNOWN")
        .when(hedged, "POSSIBLY").when(~grounded, "NO_FACT_OR_QUOTE").when(unclear, "UNCLEAR_CHECK"))


def overlay_labels(labels: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Accepted, audited corrections replace a label only where exactly one target matches and the label is still the one
    the reviewer saw; every entry says what became of it."""
    targets = labels.groupBy(key).agg(F.count(F.lit(1)).alias("_targets"), F.min("label").alias("_now"))
    outcome = (
        F.when(~F.col("accepted"), "NOT_ACCEPTED").when(F.col("_targets").isNull(), "NO_TARGET").when(F.col("_targets") > 1, "AMBIGUOUS_TARGET")
        .when(~F.col("_now").eqNullSafe(F.col("from_label")), "LABEL_CHANGED_SINCE").otherwise("APPLIED"))
    return entries.join(targets, key, "left").withColumn("outcome", outcome).withColumn(
        "label", F.when(F.col("outcome") == "APPLIED", F.col("to_label")).otherwise(F.col("_now"))).drop("_targets", "_now")

