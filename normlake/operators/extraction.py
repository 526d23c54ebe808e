"""Reading duties from units of text by rule, checking what was read, and the parts a duty is made of."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Fixed values of the English rule reader.
MARKER = "must not|shall not|should not|may not|must|shall|should|may"
SUBJECT_MAX = 160
AUTHOR = r"(?i)(^|[^a-z])(we|i|our|this publication|this policy statement)([^a-z]|$)"
CONDITION = "(?i)(?:^|[ ,])((?:if|where|when|in accordance with) [^,;.]+)"
EXCEPTION = "(?i)(?:^|[ ,])((?:unless|except) [^,;.]+)"


MARKED = re.compile(f"(?:^|[^A-Za-z])({MARKER}) ")
OPENED = re.compile("^(if|where|when) ", re.I)
VAGUE = re.compile("^([0-9]|be |have |result |cause )", re.I)
WRITTEN = re.compile(AUTHOR)
PUNCTUATED = re.compile("[.;:?!]")
# A tail's pattern, and the words of which one stands in every match; text beyond ASCII folds in other ways and goes to the pattern.
TAILS = tuple((re.compile(p.replace("(?:^|[ ,])", "(?<![^ ,])")), words) for p, words in (
    (CONDITION, ("if ", "where ", "when ", "in accordance with ")), (EXCEPTION, ("unless ", "except "))))
DUTY_TYPE = "status string, subject string, modality string, action string, condition string, exception string"
DUTY_FIELDS = tuple(c.split(" ")[0] for c in DUTY_TYPE.split(", "))


def _read(text: str, stands: dict[str, bool]) -> tuple:
    """``stands`` remembers which subjects may be one."""
    found = MARKED.search(text or "")
    if found is None:
        return ("NO_EXPLICIT_OBLIGATION", None, None, None, None, None)
    before, marker = text[: found.start()].removesuffix(" "), found[1]
    action = text[found.end() :].removesuffix("\n").removesuffix(".").strip()
    subject = (before.rsplit(",", 1)[-1] if OPENED.match(before) else before).strip()
    if subject not in stands:
        stands[subject] = 0 < len(subject) <= SUBJECT_MAX and not PUNCTUATED.search(subject) and not WRITTEN.search(subject)
    if not stands[subject] or not action or marker in ("may", "may not") and VAGUE.match(action):
        return ("INSUFFICIENT_EVIDENCE", None, None, None, None, None)
    folded, tails = text.lower() if text.isascii() else None, []
    for pattern, words in TAILS:
        tail = None
        if folded is None or [w for w in words if w in folded]:
            tail = pattern.search(text)
        tails.append(tail and tail[1])
    return ("EXTRACTED", subject, marker.upper().replace(" ", "_"), action, *tails)


def _reader(fields: tuple[str, ...]):
    places = [DUTY_FIELDS.index(f) for f in fields]

    def read(texts: pa.Array) -> pa.Array:
        coded, stands = texts.dictionary_encode(), {}
        rows = [_read(t, stands) for t in [*coded.dictionary.to_pylist(), None]]
        columns = [pa.array([r[p] for r in rows], pa.string()) for p in places]
        return pa.StructArray.from_arrays(columns, names=list(fields)).take(coded.indices.fill_null(len(rows) - 1))

    return read


def read_duties(units: DataFrame, *fields: str) -> DataFrame:
    """Adds ``d``: struct(status, subject, modality, action, condition, exception), or those ``fields`` of it, read from the sentence in ``text``.

    The subject runs from the start of the sentence (after the last comma when it opens with a condition) to the marker, the
    action from the marker to the end; a subject that is missing, too long, punctuated or the author is no evidence. Batches
    go through Arrow, equal texts of one are read once.
    """
    fields = fields or DUTY_FIELDS
    read = F.arrow_udf(_reader(fields), ", ".join(f"{f} string" for f in fields)).asNondeterministic()  # else a filter on the status reads once more
    return units.withColumn("d", read("text"))


def grounded(duty: Column, sentence: Column) -> Column:
    """First reason why what was read may not stand: every field must be a piece of the unit, the marker must be bound."""
    piece = lambda field: duty[field].isNull() | F.contains(sentence, duty[field])
    return (
        F.when(duty["status"] != "EXTRACTED", duty["status"]).when(~piece("subject"), "SUBJECT_NOT_IN_SOURCE")
        .when(~piece("action"), "ACTION_NOT_IN_SOURCE").when(~piece("condition") | ~piece("exception"), "QUALIFIER_NOT_IN_SOURCE"))


def elements(duty: Column) -> Column:
    """array<struct<id, kind, text, critical>>: the parts of a duty a statement may state or miss."""
    period = F.nullif(F.regexp_extract(duty["action"], "([0-9]+ (?:days|months|years))", 1), F.lit(""))
    bound = F.nullif(F.regexp_extract(duty["action"], "([0-9]+%|GBP [0-9]+)", 1), F.lit(""))
    part = lambda ident, kind, text, critical: F.when(text.isNotNull(), F.struct(
        F.lit(ident).alias("id"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(critical).alias("critical")))
    return F.array_compact(F.array(
        part("subject", "SUBJECT", duty["subject"], False), part("act_1", "ACT", F.nullif(F.substring_index(duty["action"], " ", 1), F.lit("")), True),
        part("deadline_1", "DEADLINE", period, True), part("threshold_1", "THRESHOLD", bound, True),
        part("condition", "CONDITION", duty["condition"], False), part("exception", "EXCEPTION", duty["exception"], False)))


def second_reading(candidates: DataFrame, decisions: DataFrame, on: list[str]) -> DataFrame:
    """Candidates after a recorded second reading: UNSUPPORTED ones leave, UNCERTAIN ones stay with a flag."""
    joined = candidates.join(decisions, on, "left")
    return joined.filter(~F.coalesce(F.col("decision") == "UNSUPPORTED", F.lit(False))).withColumn(
        "flag", F.when(F.col("decision") == "UNCERTAIN", "SECOND_READING_UNCERTAIN"))


def uncovered(units: DataFrame, duties: DataFrame, on: list[str]) -> DataFrame:
    """Units with a duty word and no duty."""
    marked = units.filter(F.col("text").rlike(f"(?:^|[^A-Za-z])({MARKER}) "))
    return marked.join(duties.select(*on).distinct(), on, "left_anti")


def enumeration(text: Column) -> Column:
    """Items of the first list of a text: at least three parts between commas and the last "and"."""
    sentence = F.regexp_extract(text, "^([^.!?:;]*)", 1)
    items = F.filter(F.transform(F.split(F.regexp_replace(sentence, " (and|or|und|et|y) ", ", "), ", *"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(items) >= 3, items).otherwise(F.array().cast("array<string>"))


def missing_items(items: Column, statement: Column) -> Column:
    """Items none of whose content words stands in the statement."""
    return F.filter(items, lambda i: (F.size(tx.words(i, 4)) > 0) & (F.size(F.array_intersect(tx.words(i, 4), tx.words(statement, 4))) == 0))
