"""Text columns: folding, squashing, tokens, stems, overlap. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# dotted/dotless capitals that a plain lower() would turn into another letter or two code points.
FOLD_FROM, FOLD_TO = "İI", "iı"
# The letters of a word after folding.
LETTERS = "a-zß-öø-ÿœğışâîû"
BLANKS = r"[ \t\n\r\f]+"
# Words that say nothing about what a duty is about.
LEXICAL_STOPWORDS = (
    "the", "and", "must", "firm", "with", "should",
    "ile", "için", "veya", "olan", "ilişkin", "gibi", "dair", "olarak", "tarafından", "üzere", "ise", "yapılan", "bir", "her",
)
LEXICAL_MIN_LETTERS = 3
STEM_LETTERS = 5
STEM_MIN_LETTERS = 4


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once per row; a column that is named twice is otherwise worked out twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(text: Column) -> Column:
    """Locale-aware lower case with equal length, so offsets into the folded text index the original."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def squash(text: Column) -> Column:
    """One blank between words, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def words(text: Column, minimum: int = 1) -> Column:
    """Folded runs of at least ``minimum`` letters in order, with repeats."""
    runs = lambda folded, kind: F.regexp_extract_all(folded, F.lit(f"[{kind}]{{{minimum},}}"), F.lit(0))
    # most texts are ASCII without a capital that folds otherwise: plain lower case and the short class give the same there, in less than half the time
    plain = (F.octet_length(text) == F.char_length(text)) & ~F.contains(text, F.lit("I"))
    return F.when(plain, runs(F.lower(text), "a-z")).otherwise(runs(fold(text), LETTERS))


def _without(found: Column, stopwords) -> Column:
    return F.array_except(found, F.array(*[F.lit(w) for w in stopwords]))


def lexical_terms(text: Column, stopwords=LEXICAL_STOPWORDS) -> Column:
    """Distinct words of three letters or more that are not function words."""
    return _without(words(text, LEXICAL_MIN_LETTERS), stopwords)


def stems(text: Column, stopwords=LEXICAL_STOPWORDS) -> Column:
    """Distinct content stems: the first five letters of words of four letters or more."""
    content = _without(words(text, STEM_MIN_LETTERS), stopwords)
    return F.array_distinct(F.transform(content, lambda w: F.substring(w, 1, STEM_LETTERS)))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def containment(a: Column, b: Column) -> Column:
    """Share of the (distinct) terms of ``a`` that occur in ``b``; 0 for an empty ``a``."""
    return F.when(F.size(a) > 0, shared(a, b) / F.size(a)).otherwise(F.lit(0.0))


def word_count(text: Column) -> Column:
    return F.when(squash(text) == "", F.lit(0)).otherwise(F.size(F.split(squash(text), " ")))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def visible(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANKS, ""))


def ratio4(numerator: Column, denominator: Column) -> Column:
    """Quotient to four places, half to even; NULL where there is nothing to divide by."""
    return F.when(denominator != 0, F.bround(numerator.cast("double") / denominator, 4))
