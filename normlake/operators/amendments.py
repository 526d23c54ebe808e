"""Which notes hold for which clause: a note's own clause, and what clauses inherit from their item, paragraph and article.

An article is read in one pass, its clauses and its notes together, so nothing of it travels but what is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import readers as rd


def clause_notes(articles: DataFrame, key: str = "version_id", text: str = "text", label: str = "label") -> DataFrame:
    """(key, ref, note_seq, action, unit, dated, instrument, level): every note with every clause it holds for.

    ``level`` is OWN where the note stands in or before the clause itself, else how it is inherited: ITEM, LIST (from the
    list's lead-in), PARAGRAPH, ARTICLE. Articles without clauses or notes give no row. ``articles`` has one row per key; a null key is none.
    """
    known = articles.where(F.col(key).isNotNull()).select(key, F.col(text).alias("_text"), F.col(label).alias("_label"))
    return rd.laterally(known, "clause_notes", "_text", "_label", keep=(key,), again=False)


def latest_notes(notes: DataFrame, key: str = "version_id") -> DataFrame:
    """The last note of each clause by date (the first of equal dates), and how many it has of its own and in all."""
    last = F.max(F.struct("dated", -F.col("note_seq"), "action", "level"))
    counted = notes.groupBy(key, "ref").agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("level") == "OWN").alias("own"), last.alias("n"))
    return counted.select(key, "ref", "notes", "own", "n.action", "n.level", "n.dated")


def changes_since(notes: DataFrame, duties: DataFrame, since: str, key: str = "version_id") -> DataFrame:
    """Clauses an instrument added, changed or reenacted since a date, by the last such note, with what it means for their duties.

    ``duties(key, ref)`` names the clauses that state one. The old wording is unknown, so a changed duty may be new or changed.
    """
    recent = notes.where((F.col("dated") >= F.lit(since).cast("date")) & F.col("action").isin("ADDED", "CHANGED", "REENACTED"))
    last = recent.groupBy(key, "ref").agg(F.max(F.struct("dated", -F.col("note_seq"), "action", "instrument")).alias("n"))
    kind = F.when(F.col("n.action") == "ADDED", "ADDED").otherwise("MODIFIED")
    stated = last.join(duties.select(key, "ref", F.lit(True).alias("_duty")).distinct(), [key, "ref"], "left")
    impact = F.when(F.col("_duty").isNull(), "NO_DUTY_AFFECTED").when(kind == "ADDED", "NEW_DUTY").otherwise("DUTY_CHANGED_OLD_WORDING_UNKNOWN")
    return stated.select(key, "ref", kind.alias("kind"), F.col("n.dated").alias("dated"), F.col("n.instrument").alias("instrument"), impact.alias("impact"))
