"""Readers of wording as table functions: one text in, a row per thing found, with exact spans of the text.

Registered under their names they are used laterally in SQL (``FROM t, LATERAL read_quantities(t.text)``); ``laterally`` gives
the same rows of a DataFrame in Arrow batches, reads equal texts once and is the quicker one. Nothing is gathered. Places count
characters from 0, ends are exclusive. A null text gives no row.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from ..functions import duties as du
from ..functions.amendments import clause_notes, notes_in
from ..functions.grounding import locate, quote_span
from ..functions.limits import read_limits
from ..functions.numerals import read_quantities
from ..functions.segmentation import reading_units, sentence_spans, split_clauses

QUANTITY = ("seq int, quantity string, start int, end int, amount double, unit string, unit_class string, days double, comparator string, lead string, trail string, "
            "parenthetical boolean, phrase_start int, phrase_end int")
SENTENCE = "seq int, start int, end int, sentence string"
CLAUSE = ("seq int, ref string, paragraph int, item string, sentence_no int, start int, end int, clause string, lead_start int, lead_end int, closing_start int, closing_end int")
UNIT = "seq int, ref string, kind string, segments array<struct<start: int, end: int>>, unit string"
MARKER = "seq int, start int, end int, marker string, mode string, binding boolean, turkish boolean, alone boolean"
DUTY = "seq int, status string, subject string, modality string, action string, start int, end int, conditions array<string>, exceptions array<string>"
ELEMENT = "duty int, id string, kind string, element string, critical boolean"
LIMIT = "seq int, limit string, start int, end int, attribute string, value double, unit string, comparator string, role string"
NOTE = "seq int, start int, end int, action string, unit string, dated date, instrument string, on_own_line boolean"
HELD = "ref string, note_seq int, action string, unit string, dated date, instrument string, level string"
FOUND = "start int, end int, rung string, reason string"


class ReadQuantities:
    """Numbers with a unit: durations, money, percentages."""

    def eval(self, text: str):
        for n, quantity in enumerate(read_quantities(text)):
            yield (n, *quantity)


class SplitSentences:
    """Sentences of a text."""

    def eval(self, text: str):
        for n, (start, end) in enumerate(sentence_spans(text or "")):
            yield n, start, end, text[start:end]


class SplitClauses:
    """Paragraphs, items and sentences of an article under a label."""

    def eval(self, text: str, label: str):
        for n, clause in enumerate(split_clauses(text, label)):
            yield (n, *clause)


class ReadingUnits:
    """What of an article is read as one statement."""

    def eval(self, text: str, label: str):
        for n, (ref, kind, segments, unit) in enumerate(reading_units(text, label)):
            yield n, ref, kind, [tuple(s) for s in segments], unit


class DutyMarkers:
    """Markers of duty, net of delegating sentences and of soft markers that state none."""

    def eval(self, text: str):
        for n, (start, end, word, mode, binding, turkish, alone) in enumerate(du.markers(text)):
            yield n, start, end, word, mode, binding, turkish, alone


class ReadDuties:
    """Every duty of a text; one row with the status alone where there is none."""

    def eval(self, text: str):
        status, found = du.read_duties(text)
        for n, duty in enumerate(found):
            yield n, status, *duty
        if not found:
            yield 0, status, None, None, None, None, None, [], []


class DutyElements:
    """The parts of every duty of a text."""

    def eval(self, text: str):
        for n, duty in enumerate(du.read_duties(text)[1]):
            for element in du.elements(text, duty):
                yield n, *element


class MissingQualifiers:
    """Conditions and exceptions of a text that the carried spans lack."""

    def eval(self, text: str, carried: list):
        for n, span in enumerate(du.missing_qualifiers(text, carried)):
            yield n, span


class UncoveredSentences:
    """Sentences with a marker of duty in which no given act stands."""

    def eval(self, text: str, actions: list):
        for n, (start, end) in enumerate(du.uncovered(text, actions)):
            yield n, start, end


class AmendmentNotes:
    """Dated notes of a consolidated text."""

    def eval(self, text: str):
        for n, note in enumerate(notes_in(text)):
            yield n, *note


class ClauseNotes:
    """Dated notes with the clauses of the article they hold for."""

    def eval(self, text: str, label: str):
        yield from clause_notes(text, label)


class ReadLimits:
    """Limits and conditions on a property of a product or place."""

    def eval(self, text: str):
        for n, limit in enumerate(read_limits(text)):
            yield n, *limit


TABLE_FUNCTIONS = {"read_limits": (ReadLimits, LIMIT), "amendment_notes": (AmendmentNotes, NOTE), "clause_notes": (ClauseNotes, HELD), "duty_markers": (DutyMarkers, MARKER), "read_duties": (ReadDuties, DUTY), "duty_elements": (DutyElements, ELEMENT), "missing_qualifiers": (MissingQualifiers, "seq int, span string"),
                   "uncovered_sentences": (UncoveredSentences, "seq int, start int, end int"),
                   "read_quantities": (ReadQuantities, QUANTITY), "split_sentences": (SplitSentences, SENTENCE), "split_clauses": (SplitClauses, CLAUSE), "reading_units": (ReadingUnits, UNIT)}


#: Rows that are read before their results are handed on, and letters of text whose results a task keeps for when they come again.
SLICE, KEPT_LETTERS = 1024, 8_000_000


def _named(values: list, kind) -> list:
    """Parts of a struct by name, as Arrow wants them."""
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return [None if v is None else [dict(zip(kind.elementType.names, part)) for part in v] for v in values]
    return values


def laterally(df: DataFrame, function: str, *columns: str, repeated: bool = False, keep: tuple[str, ...] | None = None, give: tuple[str, ...] | None = None, again: bool = True) -> DataFrame:
    """``df`` with a row for each row the table function gives for its columns; rows without one go.

    ``repeated`` deals the rows by those columns, so that a task meets all copies of a text and reads them once; for clauses,
    whose wording comes again from version to version. ``keep`` names the columns of ``df`` that are handed on (all, if none
    is given): a long text is not to be copied to every row found in it; ``give`` names those of the table function likewise.
    Without ``again`` results are not kept for a text that comes again, for whole articles, which hardly do.
    """
    handler, ddl = TABLE_FUNCTIONS[function]
    fields = [(n, f) for n, f in enumerate(StructType.fromDDL(ddl).fields) if give is None or f.name in give]
    own = df.columns if keep is None else list(keep)
    names = own + [f.name for _, f in fields]
    if len(set(names)) < len(names):
        raise ValueError(f"columns of {function} are there already: {sorted({n for n in names if names.count(n) > 1})}")

    def read(batches):
        reader, kept, letters = handler(), {}, 0
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                batch = whole.slice(first, SLICE)
                at, rows = [], []
                for n, values in enumerate(zip(*(batch.column(c).to_pylist() for c in columns))):
                    key = tuple(tuple(v) if isinstance(v, list) else v for v in values) if again else None
                    found = kept.get(key) if again else None
                    if found is None:
                        found = list(reader.eval(*values))
                    if again and key not in kept:
                        letters += sum(len(v if isinstance(v, str) else str(v)) for v in values)
                        if letters > KEPT_LETTERS:
                            kept, letters = {}, 0
                        kept[key] = found
                    at.extend([n] * len(found))
                    rows.extend(found)
                if rows:
                    taken = batch.select(own).take(pa.array(at, pa.int32()))
                    parts = list(zip(*rows))
                    given = [pa.array(_named(list(parts[n]), f.dataType), to_arrow_type(f.dataType)) for n, f in fields]
                    yield pa.RecordBatch.from_arrays([*taken.columns, *given], names=names)

    if repeated:  # a number of parts is given, or few bytes would be put into few tasks, and reading costs more than moving
        spark = df.sparkSession
        df = df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *columns)
    return df.mapInArrow(read, StructType([*(df.schema[c] for c in own), *(f for _, f in fields)]))


def register(spark: SparkSession) -> None:
    """The table functions under the names SQL calls them by."""
    for name, (handler, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema))


def _spans(read):
    def spans(value: pd.Series, text: pd.Series) -> pd.DataFrame:
        found = [read(v, t) for v, t in zip(value, text)]
        out = pd.DataFrame(found, columns=["start", "end", "rung", "reason"], index=value.index)
        return out.astype({"start": "Int32", "end": "Int32"})

    return spans


def grounded(value: Column, text: Column) -> Column:
    """Struct of the span of a value in its source, the rung that found it, or the reason why none did."""
    return F.pandas_udf(_spans(locate), FOUND)(value, text)


def quoted(quote: Column, text: Column) -> Column:
    """Struct of the span a quote names in a text, how it was found, or the reason why it is refused."""
    return F.pandas_udf(_spans(quote_span), FOUND)(quote, text)


def direction(comparator: Column, lead: Column) -> Column:
    """Which way a stated number binds: a least amount or keeping time (min), a most (max), an amount from which a rule holds (floor)."""
    return (
        F.when(comparator == "<=", "max").when(lead.isin("within", "no later than", "not later than", "en geç", "içinde", "içerisinde", "zarfında"), "max")
        .when(comparator == ">=", "min").when(comparator == ">", "floor").when(comparator == "<", "cap").when(lead.isNotNull(), "min"))
