"""License scan: ordered signature rules behind a keyword prefilter. DataFrame functions only.

A rule is a label, a priority, a keyword and a regex over the words of a text. The rules are a list of licenses, each with
its names written as word regexes, put through a few sentence forms (bare name, name with version, grant, identifier tag),
a list of SPDX identifiers (after the tag, and after another identifier with 'or' or 'and'), and a list of single phrases from license bodies. A text is searched only if it holds words that some rule needs (read off the
rules), and a rule is tried only on texts that hold its keyword. Overlaps are settled by interval containment: a detection goes
when one of at least its priority covers its whole interval (of equal intervals the earlier rule stays).

Words are set between blanks of their own (``" mit  license "``), so a regex made of whole words needs no look-around and
a place in words is half the number of blanks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases that count as base places, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label: names. A name is words; a word may be a regex for one word, ``?`` after a word makes it optional.
LICENSES = {
    "mit": ("mit licen[cs]e", "mit expat licen[cs]e", "x11 mit licen[cs]e"),
    "mit-0": ("mit no attribution licen[cs]e?", "mit 0 licen[cs]e"),
    "x11": ("x11 licen[cs]e",),
    "apache": ("apache software? licen[cs]e", "asl 2 0?"),
    "gpl": ("gnu? general public licen[cs]e", "gpl v?[0-9]+", "gplv1", "gplv2", "gplv3", "gpl1", "gpl2", "gpl3"),
    "lgpl": ("gnu? lesser general public licen[cs]e", "gnu? library general public licen[cs]e", "lgpl v?[0-9]+", "lgplv2", "lgplv3", "lgpl2", "lgpl3"),
    "agpl": ("gnu? affero general public licen[cs]e", "agpl v?[0-9]+", "agplv1", "agplv3", "agpl3"),
    "gfdl": ("gnu? free documentation licen[cs]e",),
    "bsd": ("bsd licen[cs]e", "bsd style licen[cs]e", "berkeley software distribution licen[cs]e"),
    "bsd-2": ("bsd 2 clause licen[cs]e?", "simplified bsd licen[cs]e", "two clause bsd licen[cs]e?", "freebsd licen[cs]e"),
    "bsd-3": ("bsd 3 clause licen[cs]e?", "new bsd licen[cs]e", "modified bsd licen[cs]e", "revised bsd licen[cs]e"),
    "bsd-4": ("bsd 4 clause licen[cs]e?", "original bsd licen[cs]e", "old bsd licen[cs]e"),
    "isc": ("isc licen[cs]e",),
    "zlib": ("zlib licen[cs]e", "zlib libpng licen[cs]e"),
    "mpl": ("mozilla public licen[cs]e",),
    "epl": ("eclipse public licen[cs]e",),
    "edl": ("eclipse distribution licen[cs]e",),
    "cpl": ("common public licen[cs]e",),
    "cddl": ("common development and distribution licen[cs]e",),
    "eupl": ("european union public licen[cs]e",),
    "cecill": ("cecill [abc]? licen[cs]e",),
    "artistic": ("artistic licen[cs]e",),
    "boost": ("boost software licen[cs]e",),
    "psf": ("python software foundation licen[cs]e", "psf licen[cs]e agreement?"),
    "ruby": ("ruby licen[cs]e",),
    "php": ("php licen[cs]e",),
    "openssl": ("openssl licen[cs]e",),
    "unlicense": ("unlicense",),
    "wtfpl": ("wtfpl",),
    "zero-bsd": ("0bsd",),
    "ms-pl": ("microsoft public licen[cs]e",),
    "ms-rl": ("microsoft reciprocal licen[cs]e",),
    "ofl": ("sil? open font licen[cs]e",),
    "odbl": ("open database licen[cs]e",),
    "odc-by": ("open data commons attribution licen[cs]e",),
    "ncsa": ("university of illinois ncsa open source licen[cs]e", "ncsa open source licen[cs]e"),
    "upl": ("universal permissive licen[cs]e",),
    "osl": ("open software licen[cs]e",),
    "afl": ("academic free licen[cs]e",),
    "bsl": ("business source licen[cs]e",),
    "sspl": ("server side public licen[cs]e",),
    "elastic": ("elastic licen[cs]e",),
    "llama": ("llama [0-9]? community licen[cs]e agreement?",),
    "rail": ("open? rail m? licen[cs]e", "bigscience rail licen[cs]e"),
    "cc0": ("cc0", "cc zero"),
    "cc-by": ("cc by", "creative commons attribution"),
    "cc-by-sa": ("cc by sa",),
    "cc-by-nc": ("cc by nc",),
    "cc-by-nd": ("cc by nd",),
    "cc-by-nc-sa": ("cc by nc sa",),
    "cc-by-nc-nd": ("cc by nc nd",),
    "cc-share-alike": ("creative commons attribution share alike", "creative commons attribution sharealike"),
    "cc-noncommercial": ("creative commons attribution non commercial", "creative commons attribution noncommercial"),
}
#: (form, priority): ``{}`` is the name. A longer form covers the shorter ones inside it.
FORMS = (
    ("spdx licen[cs]e identifier {} [0-9]*", 5),
    ("(?: licensed | released | distributed | available | provided | published | covered ) under (?: the )? (?: terms of the | terms of )? {} (?: version )? v?[0-9]+ [0-9]?", 4),
    ("(?: licensed | released | distributed | available | provided | published | covered ) under (?: the )? (?: terms of the | terms of )? {}", 4),
    ("{} version v?[0-9]+ [0-9]?", 3),
    ("{}", 2),
)
#: (label, identifier as words): SPDX identifiers as they stand in a tag, without the word license.
IDENTIFIERS = (
    ("mit", "mit"), ("mit-0", "mit 0"), ("mit", "mit modern variant"), ("mit", "mit cmu"), ("x11", "x11"), ("isc", "isc"), ("zero-bsd", "0bsd"),
    ("apache", "apache [12] [0-9]"), ("apache", "asl [12] [0-9]"),
    ("gpl", "gpl [1-3] 0? (?: only | or later | plus )?"), ("gpl", "gpl 2 0 with classpath exception"), ("gpl", "gplv1"), ("gpl", "gplv2"), ("gpl", "gplv3"),
    ("lgpl", "lgpl [23] [01]? (?: only | or later | plus )?"), ("lgpl", "lgpllr"), ("lgpl", "lgplv2 1?"), ("lgpl", "lgplv3"),
    ("agpl", "agpl [13] 0? (?: only | or later | plus )?"), ("agpl", "agplv3"), ("gfdl", "gfdl 1 [1-3] (?: no invariants | invariants )? (?: only | or later )?"),
    ("bsd", "bsd"), ("bsd", "bsd source code"), ("bsd-2", "bsd 2 clause (?: patent | views | freebsd | netbsd )?"), ("bsd-3", "bsd 3 clause (?: clear | lbnl | attribution | modification | open mpi )?"),
    ("bsd-4", "bsd 4 clause uc?"), ("bsd", "bsd 1 clause"), ("zlib", "zlib"), ("zlib", "zlib acknowledgement"), ("zlib", "libpng 2 0"),
    ("mpl", "mpl [12] [01] (?: no copyleft exception )?"), ("epl", "epl [12] 0"), ("cpl", "cpl 1 0"), ("cddl", "cddl 1 [01]"), ("eupl", "eupl 1 [0-2]"),
    ("cecill", "cecill [12] [01]"), ("cecill", "cecill [bc]"), ("artistic", "artistic [12] 0 (?: perl | cl8 )?"), ("boost", "bsl 1 0"), ("bsl", "busl 1 1"),
    ("psf", "psf 2 0"), ("psf", "python 2 0 1?"), ("ruby", "ruby"), ("php", "php 3 0?1?"), ("openssl", "openssl"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"),
    ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("ofl", "ofl 1 [01] (?: rfn | no rfn )?"), ("odbl", "odbl 1 0"), ("odc-by", "odc by 1 0"), ("ncsa", "ncsa"), ("upl", "upl 1 0"),
    ("osl", "osl [123] [01]"), ("afl", "afl [123] [012]"), ("sspl", "sspl 1 0"), ("elastic", "elastic 2 0"), ("cc0", "cc0 1 0"),
    ("cc-by", "cc by [1-4] [05]"), ("cc-by-sa", "cc by sa [1-4] [05]"), ("cc-by-nc", "cc by nc [1-4] [05]"), ("cc-by-nd", "cc by nd [1-4] [05]"),
    ("cc-by-nc-sa", "cc by nc sa [1-4] [05]"), ("cc-by-nc-nd", "cc by nc nd [1-4] [05]"),
)
#: What may stand before a further identifier of an expression ('MIT OR Apache-2.0'): the first word of one, its rest, an exception.
_BEFORE = ("(?: " + " | ".join(sorted({words.split()[0] for _, words in IDENTIFIERS}))
           + " )" + " (?: [0-9]+ | 0? clause | only | or later | plus | by | sa | nc | nd | pl | rl )?" * 5 + " (?: with [a-z]+ [a-z]+? [a-z]+? [0-9]+? [0-9]+? )?")
#: (form, priority) of an identifier: the tag's first one, and a further one of an expression. A rule of ``IDENTIFIERS`` needs no more words.
IDENTIFIER_FORMS = (("spdx licen[cs]e identifier {}", 5), (_BEFORE + " or {}", 5), (_BEFORE + " and {}", 5))
#: (label, phrase, priority): sentences of license bodies and notices.
PHRASES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 4),
    ("isc", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted", 4),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 4),
    ("zlib", "the origin of this software must not be misrepresented", 4),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 4),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e", 5),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 5),
    ("unlicense", "this is free and unencumbered software released into the public domain", 4),
    ("public-domain", "(?: released | dedicated | placed ) (?: into | to | in ) the public domain", 3),
    ("mpl", "this source code form is subject to the terms of the mozilla public licen[cs]e", 4),
    ("apache", "you may not use this file except in compliance with the licen[cs]e", 3),
    ("warranty-disclaimer", "(?: as is )? without warranty of any kind", 1),
    ("warranty-disclaimer", "warranties of merchantability", 1),
    ("all-rights-reserved", "all rights reserved", 1),
    ("proprietary", "proprietary and confidential", 2),
    ("copyright-notice", "copyright (?: c )? [12][0-9][0-9][0-9]", 1),
)
PRIORITIES = 5


def word_regex(phrase: str) -> str:
    """A phrase as a regex in which every word stands between its own blanks; ``(?: a | b c )`` is kept as alternatives."""
    out = []
    for word in phrase.split():
        if word in ("(?:", "|", ")", ")?"):
            out.append(word)
        elif word.endswith("?") and not word.startswith("v?"):
            out.append(f"(?: {word[:-1]} )?")
        else:
            out.append(f" {word} " if not word.endswith("*") else f"(?: {word[:-1]}+ )*")
    return "".join(out)


def _run_of(phrase: str) -> list[str]:
    """The longest run of words that every match of a phrase holds side by side."""
    runs, depth = [[]], 0
    for word in phrase.split():
        depth += (word == "(?:") - word.startswith(")")
        if not depth and word.isalnum():
            runs[-1].append(word)
        else:
            runs.append([])
    return max(runs, key=lambda run: len(" ".join(run)))


def keyword_of(phrase: str) -> str:
    """The longest run of words of a phrase, as it stands between the blanks of a searched text."""
    return "  ".join(_run_of(phrase))


def stem_of(phrase: str) -> str:
    """Words that every match of a phrase holds side by side: 'license' in either spelling, or else the longest such run."""
    if "licen[cs]e" in phrase.split():
        return "licen[cs]e"
    return " ".join(_run_of(phrase))


def _made() -> list[tuple[str, int, str, bool]]:
    """(label, priority, phrase, base) in order; the base phrases come first."""
    made = [(label, 2, phrase, True) for phrase, label in BASE]
    made += [(label, priority, form.format(name), False) for form, priority in FORMS for label, names in LICENSES.items() for name in names]
    made += [(label, priority, form.format(words), False) for form, priority in IDENTIFIER_FORMS for label, words in IDENTIFIERS]
    return made + [(label, priority, phrase, False) for label, phrase, priority in PHRASES]


def _stems() -> tuple[str, ...]:
    """One regex of a text as it stands that every rule needs: the stems of all names (every form holds its name) and phrases,
    without those that hold another one, and the joint of an expression. A tag holds 'license'."""
    phrases = [phrase for phrase, _ in BASE] + [name for names in LICENSES.values() for name in names] + [phrase for _, phrase, _ in PHRASES]
    least: list[str] = []
    for stem in sorted({stem_of(phrase) for phrase in phrases}, key=lambda stem: (len(stem.split()), stem)):
        if not any(f" {other} " in f" {stem} " for other in least):
            least.append(stem)
    further = sorted({words.split()[0] for _, words in IDENTIFIERS})
    least.append(f"(?:or|and) (?:{'|'.join(further)})")
    return (rf"(?:^|{_BETWEEN})(?:{'|'.join(stem.replace(' ', _BETWEEN) for stem in least)})(?:{_BETWEEN}|$)",)


def rules() -> list[tuple[int, str, int, str, str, bool]]:
    """(number, label, priority, keyword, regex, base) in order; the base phrases come first."""
    return [(number, label, priority, keyword_of(phrase), word_regex(phrase), base) for number, (label, priority, phrase, base) in enumerate(_made())]


#: Every rule needs this in the text as it stands (any case); read off the rules.
STEMS = _stems()


def _rule_array() -> Column:
    return F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(k).alias("keyword"), F.lit(x).alias("regex"), F.lit(b).alias("base"))
                     for n, label, p, k, x, b in rules()])


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per detection, and one without a rule for a text that has none: row (of the input), doc_id, n_words, rule,
    label, priority, base, first, last (words, end exclusive), stays (not suppressed)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    n_words = F.regexp_count("text", F.lit(_ANY_CASE_WORD)).cast("bigint")
    gate = F.col("text").rlike("(?i)" + "|".join(STEMS))
    body = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)), "  "), F.lit(" "))
    # a generated column is computed once per row; a projected one would be put into the filter below and computed per rule
    gated = read.select("row", "doc_id", F.explode(F.array(F.struct(n_words.alias("n_words"), F.when(gate, body).alias("body")))).alias("read")).select("row", "doc_id", "read.*")
    tried = F.filter(_rule_array(), lambda r: F.contains(F.col("body"), r["keyword"]))
    paired = gated.select("*", F.explode_outer(F.when(F.col("body").isNotNull(), tried)).alias("r"))
    found = paired.select("row", "doc_id", "n_words", "r", F.regexp_extract_all("body", F.col("r.regex"), F.lit(0)).alias("hits"), F.split("body", F.col("r.regex"), -1).alias("gaps"))
    places = F.transform("hits", lambda hit, i: F.struct(i.alias("i"), _blanks(F.get("gaps", i)).alias("before"), _blanks(hit).alias("size")))
    each = found.select("row", "doc_id", "n_words", "r.rule", "r.label", "r.priority", "r.base", F.explode_outer(places).alias("p"))
    upto = Window.partitionBy("row", "rule").orderBy("p.i").rowsBetween(Window.unboundedPreceding, 0)
    last = (F.sum(F.col("p.before") + F.col("p.size")).over(upto) / 2).cast("bigint")
    spans = each.withColumn("last", last).withColumn("first", F.col("last") - (F.col("p.size") / 2).cast("bigint")).drop("p")
    order = Window.partitionBy("row").orderBy(F.col("first"), F.col("last").desc(), F.col("priority").desc(), F.col("rule")).rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for p in range(1, PRIORITIES + 1):
        reach = F.max(F.when(F.col("priority") >= p, F.col("last"))).over(order)
        covered = covered | ((F.col("priority") == p) & F.coalesce(reach >= F.col("last"), F.lit(False)))
    return spans.withColumn("stays", ~covered & F.col("last").isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    ``n_base`` counts all places of base phrases, suppressed or not; ``first_word`` and ``last_word`` are their smallest and
    largest start. ``labels`` holds the labels of the detections that stay and all base labels. ``score`` is the highest
    priority that stays over the number of priorities, 0 without any. A null text is empty and has no detections. Repeated
    rows are answered one by one; other columns are not read.
    """
    base = F.col("base") & F.col("last").isNotNull()
    grouped = detections(docs, id_col, text_col).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count_if(base).cast("bigint").alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(base | F.col("stays"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("stays"), F.col("priority"))) / F.lit(float(PRIORITIES)), F.lit(0.0)).alias("score"))
    return grouped.drop("row")
