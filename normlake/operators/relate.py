"""How a statement relates to a duty, and what the recorded readings of it come to. Pairs arrive blocked by an equi-key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Which relation of several is the strongest, and the wording shares that relate two texts.
STRENGTH = {"UNRELATED": 0, "UNCLEAR": 1, "PARTIAL": 2, "SUPPORTS": 3, "CONFLICTS": 4}
OPPOSING_SHARE, OPPOSING_WORDS = 0.6, 3
DEADLINE_WORDS, DEADLINE_SHARE, SEMANTIC_RELEVANCE = 2, 0.5, 0.70
LONG_SHARE, MEDIUM_SHARE = 0.5, 0.75


def products_compatible(duty_classes: Column, statement_classes: Column) -> Column:
    """A statement without classes is about every product; else the two must share one."""
    return statement_classes.isNull() | (F.size(statement_classes) == 0) | (F.size(duty_classes) == 0) | F.arrays_overlap(duty_classes, statement_classes)


def carried(wanted: Column, common: Column, overlap: Column) -> Column:
    """Does the statement carry enough of the duty's distinctive words? One word never relates two texts."""
    n = F.size(wanted)
    return (
        F.when(n < 2, F.lit(False)).when(n == 2, common == 2).when(n <= 4, overlap >= MEDIUM_SHARE)
        .otherwise((overlap >= LONG_SHARE) & (common >= 2)))


def relate(pairs: DataFrame) -> DataFrame:
    """Adds ``relation`` and ``reasons`` to every (duty, statement) pair.

    Columns: ``wanted``, ``offered`` (stems), ``duty_modality``, ``statement_modality``, ``compatible``, ``duty_limit``,
    ``statement_limit`` (a number in one unit and direction, NULL when there is none), ``cap`` (TRUE when a smaller limit is
    stricter), ``duty_days``, ``statement_days`` (deadlines), ``similarity`` (recorded, may be NULL).
    """
    common = tx.shared(F.col("wanted"), F.col("offered"))
    rows = pairs.withColumn("_common", common).withColumn(
        "_overlap", F.when(F.size("wanted") > 0, F.col("_common") / F.size("wanted")).otherwise(F.lit(0.0)))
    common, overlap = F.col("_common"), F.col("_overlap")
    both = F.col("duty_limit").isNotNull() & F.col("statement_limit").isNotNull()
    weaker = both & F.when(F.col("cap"), F.col("statement_limit") > F.col("duty_limit")).otherwise(F.col("statement_limit") < F.col("duty_limit"))
    negative, forbids = F.col("duty_modality") == "MUST_NOT", F.col("statement_modality") == "MUST_NOT"
    opposes = (overlap >= OPPOSING_SHARE) & (common >= OPPOSING_WORDS)
    late = F.coalesce(F.col("statement_days") > F.col("duty_days"), F.lit(False)) & ~negative & (F.col("statement_modality") == "MUST")
    basis = (overlap >= DEADLINE_SHARE) | (F.coalesce(F.col("similarity"), F.lit(0.0)) >= SEMANTIC_RELEVANCE)
    relevant = both | carried(F.col("wanted"), common, overlap) | ((overlap >= MEDIUM_SHARE) & (common >= 3))
    gaps = F.array_compact(F.array(
        F.when(~negative & (F.col("statement_modality") == "MAY"), F.lit("POLICY_OPTIONAL")),
        F.when(F.col("duty_limit").isNotNull() & F.col("statement_limit").isNull(), F.lit("LIMIT_MISSING")),
        F.when((overlap < OPPOSING_SHARE) & ~both, F.lit("WORDING_PARTLY_MATCHED")),
        F.when(F.col("duty_days").isNotNull() & F.col("statement_days").isNull(), F.lit("DEADLINE_MISSING"))))

    def arm(relation: str, reason: str | Column) -> Column:
        return F.struct(F.lit(relation).alias("relation"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reasons"))

    verdict = (
        F.when(~F.col("compatible"), arm("UNRELATED", "OTHER_PRODUCT"))
        .when(weaker, arm("CONFLICTS", "LIMIT_WEAKER"))
        .when(F.col("statement_modality").isNull() & (overlap >= 0.5), arm("UNCLEAR", "POLICY_STATEMENT_NOT_NORMATIVE"))
        .when(F.col("statement_modality").isNull(), arm("UNRELATED", "OTHER_SUBJECT"))
        .when(negative & ~forbids & opposes, arm("CONFLICTS", "POLICY_PERMITS_PROHIBITED_ACT"))
        .when(negative & ~forbids, arm("UNRELATED", "OTHER_CIRCUMSTANCE"))
        .when(~negative & forbids & ~both & opposes & (F.size("wanted") >= 3), arm("CONFLICTS", "POLICY_NEGATES_DUTY"))
        .when(~negative & forbids & ~both, arm("UNRELATED", "OTHER_SUBJECT"))
        .when(late & (common >= DEADLINE_WORDS) & basis, arm("CONFLICTS", "DEADLINE_LATER"))
        .when(~relevant, arm("UNRELATED", "OTHER_SUBJECT"))
        .when(F.size(gaps) > 0, arm("PARTIAL", F.array_join(gaps, "; ")))
        .when(both, arm("SUPPORTS", "LIMIT_SAME_OR_STRICTER")).otherwise(arm("SUPPORTS", "ACT_AND_POLARITY_MATCH")))
    return rows.withColumn("_v", verdict).withColumn("relation", F.col("_v.relation")).withColumn("reasons", F.col("_v.reasons")).drop("_v", "_common", "_overlap")


def strongest(readings: DataFrame, by: list[str]) -> DataFrame:
    """The strongest relation any sentence of a statement has, with its reasons (ties: the first reason in order)."""
    order = F.create_map(*[F.lit(x) for pair in STRENGTH.items() for x in pair])[F.col("relation")]
    return readings.groupBy(*by).agg(F.max_by(F.struct("relation", "reasons"), F.struct(order, "reasons")).alias("_b")).select(*by, "_b.*")


def later_deadlines(duty: DataFrame, offered: DataFrame, by: list[str], days: str) -> DataFrame:
    """LATER / NOT_LATER / UNRESOLVED per group from the deadlines of both sides, paired from the shortest.

    With equally many, some pair is later exactly when at some length fewer of the offered deadlines have run out than of the
    duty's. With unequal counts the pairing can be shifted by the difference: LATER where even the shift most favourable to
    the statement leaves a later pair, UNRESOLVED where only the least favourable one does. A shift is a constant added to
    the number that has run out, so deadlines stay counts per length and no list is gathered.
    """
    count = lambda df, name: df.groupBy(*by, days).agg(F.count(F.lit(1)).alias(name))
    both = count(duty, "_d").join(count(offered, "_g"), [*by, days], "full_outer").fillna(0, ["_d", "_g"])
    upto = Window.partitionBy(*by).orderBy(days).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    behind = both.withColumns({"_gone_d": F.sum("_d").over(upto), "_gone_g": F.sum("_g").over(upto), "_nd": F.sum("_d").over(whole), "_ng": F.sum("_g").over(whole)})
    fewer, more = F.greatest(F.col("_nd") - F.col("_ng"), F.lit(0)), F.greatest(F.col("_ng") - F.col("_nd"), F.lit(0))
    late_at_best = F.col("_gone_g") < F.col("_gone_d") - fewer
    late_at_worst = (F.col("_gone_d") > 0) & (F.col("_gone_g") < F.least(F.col("_gone_d"), F.col("_ng")) + more)
    t = behind.filter("_nd > 0 AND _ng > 0").groupBy(*by).agg(F.bool_or(late_at_best).alias("_best"), F.bool_or(late_at_worst).alias("_worst"))
    verdict = F.when(F.col("_best"), "LATER").when(F.col("_worst"), "UNRESOLVED").otherwise("NOT_LATER")
    return t.select(*by, verdict.alias("verdict"))


def replay(statements: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Recorded judgements by content key, the last record wins; what is not recorded is not read, never guessed.

    A quote that is not in its statement is UNCLEAR, as is a statement the record skipped; STATES_DUTY with something missing
    is a part. ``records(<key>, seq, answer, quote, missing)``.
    """
    last = records.groupBy(key).agg(F.max_by(F.struct("answer", "quote", "missing"), "seq").alias("_r"))
    joined = statements.join(last, key, "left")
    r = F.col("_r")
    grounded = F.contains(tx.squash(F.col("text")), tx.squash(r["quote"]))
    relation = (
        F.when(r.isNull(), "NOT_READ").when(r["answer"].isNull(), "UNCLEAR").when(~F.coalesce(grounded, F.lit(False)), "UNCLEAR")
        .when((r["answer"] == "STATES_DUTY") & (r["missing"] != ""), "STATES_PART").otherwise(r["answer"]))
    return joined.withColumn("relation", relation).drop("_r")


def structural_signals(duty: Column, statement: Column) -> Column:
    """Wording of a statement that may go against a duty, strong signals first."""
    strong = (("WAIVER", r"(?i)(waive|waived|waiver)"), ("EXEMPTION", r"(?i)(unless|exempt(ed|ion)?|does not apply)"),
              ("PROHIBITION", r"(?i)(must not|prohibited|forbidden)"), ("NEGATION", r"(?i)(not required|need not|no longer)"))
    weak = (("LIMITER", r"(?i)(only|at most|up to|where possible)"), ("WEAKER_MODALITY", r"(?i)(^|[^a-z])(may|should)([^a-z]|$)"))
    at_duty = lambda pattern: duty.rlike(pattern)
    hits = [F.when(statement.rlike(p) & ~at_duty(p), F.lit(f"{name}:strong")) for name, p in strong]
    hits += [F.when(statement.rlike(p) & ~at_duty(p), F.lit(f"{name}:weak")) for name, p in weak]
    return F.array_compact(F.array(*hits))


def escalation(fast: Column, strong_signal: Column, share: Column, position: Column, prohibition: Column) -> Column:
    """Why a passage is sent to the strong reader (NULL = the fast reading stands)."""
    return (
        F.when(fast == "CONFLICTS", "FAST_CONFLICT").when(strong_signal & (share >= 0.25), "STRUCTURAL_SIGNAL")
        .when((fast == "UNCLEAR") & (share >= 0.4), "UNCLEAR_ON_TOPIC").when(prohibition & (share >= 0.5), "PROHIBITION_ON_TOPIC")
        .when((position <= 3) & (fast == "UNRELATED") & (share >= 0.5), "TOP_RANK_UNRELATED"))


def settle(fast: Column, escalated: Column, verifier: Column, quoted: Column) -> Column:
    """Final relation of a passage from its fast reading and, where it was escalated, the strong reader's recorded answer."""
    return (
        F.when(escalated.isNull(), fast).when(verifier.isNull(), F.when(fast == "CONFLICTS", "UNCLEAR").otherwise(fast))
        .when((verifier == "CONFLICTS") & ~quoted, "UNCLEAR").otherwise(verifier))


def rule_chain(incomplete: Column, entity: Column, subject: Column, subject_clear: Column, addressee: Column, addressee_clear: Column,
               jurisdiction: Column, customer: Column, exemption: Column) -> Column:
    """struct(state, decided_by, clear_match) of the six gates in order; a jurisdiction mismatch alone never decides."""
    row = lambda state, by: F.struct(F.lit(state).alias("state"), F.lit(by).alias("decided_by"))
    open_ok = lambda gate: gate.isin("MATCH", "NOT_RESTRICTED")
    chain = (
        F.when(incomplete, row("UNKNOWN", "PROFILE_INCOMPLETE")).when(entity == "MISMATCH", row("DOES_NOT_APPLY", "ENTITY_GATE"))
        .when((subject == "MISMATCH") & subject_clear, row("DOES_NOT_APPLY", "SUBJECT_GATE"))
        .when((addressee == "MISMATCH") & addressee_clear, row("DOES_NOT_APPLY", "ADDRESSEE_GATE"))
        .when(exemption == "EXEMPT", row("DOES_NOT_APPLY", "EXEMPTION")).otherwise(row("OPEN", "NONE")))
    clear = (
        (subject == "MATCH") & subject_clear & open_ok(addressee) & (jurisdiction == "MATCH") & open_ok(customer) & (exemption == "NONE"))
    return F.struct(chain["state"].alias("state"), chain["decided_by"].alias("decided_by"), clear.alias("clear_match"))


def obliged_verdict(required: DataFrame, membership: DataFrame, by: list[str]) -> DataFrame:
    """Verdict over required kinds: every qualifier must match, kinds are alternatives.

    ``required(<by>, member_id, kind, qualifier BOOLEAN)``; ``membership(member_id, kind, member BOOLEAN)``, unstated = NULL.
    """
    m = required.join(membership, ["member_id", "kind"], "left")
    fact, qualifier = F.col("member"), F.col("qualifier")
    t = m.groupBy(*by).agg(
        F.count_if(qualifier & ~fact).alias("_q_no"), F.count_if(qualifier & fact.isNull()).alias("_q_open"),
        F.count_if(~qualifier & fact).alias("_yes"), F.count_if(~qualifier & fact.isNull()).alias("_open"), F.count_if(~qualifier).alias("_kinds"))
    verdict = (
        F.when(F.col("_q_no") > 0, "MISMATCH").when((F.col("_kinds") > 0) & (F.col("_yes") == 0) & (F.col("_open") == 0), "MISMATCH")
        .when((F.col("_q_open") > 0) | ((F.col("_kinds") > 0) & (F.col("_yes") == 0)), "UNDETERMINED").otherwise("MATCH"))
    return t.select(*by, verdict.alias("verdict"))


def claim_in_order(pairs: DataFrame) -> DataFrame:
    """One-to-one claims: every expectation takes its best candidate nobody before it took.

    ``pairs(case_id, expectation, prediction, preference)`` with ``expectation`` in dataset order and ``preference`` 1 = best.
    Taking turns is the stable matching in which every prediction prefers the earliest expectation, so it is reached by
    rounds of offers: each expectation offers to its best candidate that has not turned it down, each prediction keeps the
    earliest offer. A round is a few joins on (case, key) however large a case is; no case is gathered into one task.
    """
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(pairs.sparkSession)
    left = pairs.checkpoint()
    remaining = left.count()
    while True:
        offers = left.groupBy("case_id", "expectation").agg(F.min_by(F.struct("prediction", "preference"), "preference").alias("_o")).select(
            "case_id", "expectation", "_o.prediction", "_o.preference")
        kept = offers.groupBy("case_id", "prediction").agg(F.min("expectation").alias("_keeper"))
        refused = offers.join(kept, ["case_id", "prediction"]).filter("expectation <> _keeper").select("case_id", "expectation", "prediction")
        smaller = left.join(refused, ["case_id", "expectation", "prediction"], "left_anti").checkpoint()
        before, remaining = remaining, smaller.count()
        if remaining == before:
            return offers
        left = smaller


def interleaved(df: DataFrame, document: str, order: list[Column], limit: int | None = None) -> DataFrame:
    """Rows taken in turn from every document: first rows of all documents, then second rows, and so on."""
    turn = Window.partitionBy(document).orderBy(*order)
    rows = df.withColumn("turn", F.row_number().over(turn))
    return rows if limit is None else rows.orderBy("turn", document).limit(limit)


def conflict_gate(same_object: Column, same_actor: Column, opposed: Column, same_scope: Column) -> Column:
    """First stage at which a claimed conflict fails (NULL = the claim holds): object, actor, effect, scope."""
    return (
        F.when(~same_object, "OBJECT").when(~same_actor, "ACTOR").when(~opposed, "EFFECT").when(~same_scope, "SCOPE"))


def anchor_audit(dimensions: dict[str, tuple[Column, Column]], shared_act: Column) -> Column:
    """struct(mismatches, overall): each dimension MATCH when equal, MISMATCH when both sides state something else.

    Any explicit mismatch decides; a shared act or object alone matches; otherwise the anchor is unresolved.
    """
    differs = F.array_compact(F.array(*[
        F.when(a.isNotNull() & b.isNotNull() & (a != b), F.lit(name)) for name, (a, b) in dimensions.items()]))
    overall = F.when(F.size(differs) > 0, "MISMATCH").when(shared_act, "MATCH").otherwise("UNRESOLVED")
    return F.struct(F.array_join(differs, "; ").alias("mismatches"), overall.alias("overall"))
