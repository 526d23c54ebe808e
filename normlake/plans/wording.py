"""Queries on what a text says: quantities, quotes and their sources. The SQL states by hand what each part of a clause holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantity as qt
from ..operators import amendments as am
from ..operators import entities as en
from ..operators import readers as rd
from ..sources.tables import table
from . import statutes as st
from .registry import query

#: What the parts of a clause state: part, quantity as written, whole phrase, amount, unit, class, days, comparator, lead, trail.
FACTS = (
    (" within 10 business days", "10 business days", "within 10 business days", 10, "iş günü", "duration", 14, None, "within", None),
    (" within five working days of the event", "five working days", "within five working days", 5, "iş günü", "duration", 7, None, "within", None),
    (" no later than 3 months after the request", "3 months", "no later than 3 months", 3, "ay", "duration", 90, None, "no later than", None),
    (" for at least eight years", "eight years", "for at least eight years", 8, "yıl", "duration", 2920, ">=", "for", None),
    (" within twenty-four hours", "twenty-four hours", "within twenty-four hours", 24, "saat", "duration", 1, None, "within", None),
    (" every two years", "two years", "two years", 2, "yıl", "duration", 730, None, None, None),
    (" for 5 years and six months", "5 years", "for 5 years", 5, "yıl", "duration", 1825, None, "for", None),
    (" for 5 years and six months", "six months", "six months", 6, "ay", "duration", 180, None, None, None),
    (" not later than thirty-one days before the transfer", "thirty-one days", "not later than thirty-one days", 31, "gün", "duration", 31, None, "not later than", None),
    (" for transfers of EUR 15,000 or more", "EUR 15,000", "EUR 15,000 or more", 15000, "EUR", "money", None, ">=", None, None),
    (" where the amount is at least GBP 1,000.50", "GBP 1,000.50", "at least GBP 1,000.50", 1000.5, "GBP", "money", None, ">=", None, None),
    (" up to 2.5%", "2.5%", "up to 2.5%", 2.5, "%", "percent", None, "<=", None, None),
    (" for payments exceeding two million TL", "two million TL", "exceeding two million TL", 2000000, "TL", "money", None, ">", None, None),
    (" in excess of $250 thousand", "$250 thousand", "in excess of $250 thousand", 250000, "USD", "money", None, ">", None, None),
    (" of less than 150 euros", "150 euros", "less than 150 euros", 150, "EUR", "money", None, "<", None, None),
    (" at a rate of seven percent", "seven percent", "seven percent", 7, "%", "percent", None, None, None, None),
    (" above 185.000 TL", "185.000 TL", "above 185.000 TL", 185000, "TL", "money", None, ">", None, None),
    (" The records must be kept for 7 years.", "7 years", "for 7 years", 7, "yıl", "duration", 2555, None, "for", None),
    ("yüzseksenbeşbin TL ve üzerindeki işlemleri", "yüzseksenbeşbin TL", "yüzseksenbeşbin TL ve üzerindeki", 185000, "TL", "money", None, ">=", None, None),
    ("15.000 TL'yi aşan ödemeleri", "15.000 TL'yi", "15.000 TL'yi aşan", 15000, "TL", "money", None, ">", None, None),
    (" on iş günü içinde", "on iş günü", "on iş günü içinde", 10, "iş günü", "duration", 14, None, "içinde", "içinde"),
    (" en geç beş gün içinde", "beş gün", "en geç beş gün içinde", 5, "gün", "duration", 5, None, "en geç", "içinde"),
    (" sekiz yıl süre ile", "sekiz yıl", "sekiz yıl süre ile", 8, "yıl", "duration", 2920, None, "süre ile", "süre ile"),
    (" en az iki buçuk yıl", "iki buçuk yıl", "en az iki buçuk yıl", 2.5, "yıl", "duration", 912.5, ">=", None, None),
    (" üç ayda bir", "üç ayda", "üç ayda", 3, "ay", "duration", 90, None, None, None),
)


def _cell(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


FACTS_SQL = "facts(part, quantity, phrase, amount, unit, unit_class, days, comparator, lead, trail) AS (VALUES " + ", ".join("(" + ", ".join(map(_cell, f)) + ")" for f in FACTS) + ")"


def _stated(name: str, source: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT c.*, f.*, (instr(text, part) + instr(part, quantity) - 2)::INTEGER AS start,
    row_number() OVER (PARTITION BY c.version_id, c.number, c.copy ORDER BY instr(text, part) + instr(part, quantity)) - 1 AS seq
  FROM (SELECT *, row_number() OVER () AS copy FROM {source}) c JOIN facts f ON contains(c.text, f.part))"""


@query("fun09_quantities", "FUN09", "UDTF02", sql=f"""
WITH {FACTS_SQL}, {st.clauses_sql('c')}, {_stated('q', 'c')}
SELECT version_id, number, seq::INTEGER AS seq, quantity, start, (start + length(quantity))::INTEGER AS "end", amount::DOUBLE AS amount, unit, unit_class, days::DOUBLE AS days, comparator, lead, trail FROM q""")
def fun09_quantities(spark, sf):
    return rd.laterally(st.clauses(spark, sf), "read_quantities", "text", repeated=True, keep=("version_id", "number")).select(
        "version_id", "number", "seq", "quantity", "start", "end", "amount", "unit", "unit_class", "days", "comparator", "lead", "trail")


DIRECTION_SQL = """CASE WHEN comparator = '<=' THEN 'max' WHEN lead IN ('within', 'no later than', 'not later than', 'en geç', 'içinde') THEN 'max' WHEN comparator = '>=' THEN 'min'
  WHEN comparator = '>' THEN 'floor' WHEN comparator = '<' THEN 'cap' WHEN lead IS NOT NULL THEN 'min' END"""


@query("fun10_compare_quantities", "FUN10", "JON39", sql=f"""
WITH {FACTS_SQL}, {st.clauses_sql('c')}, {st.clauses_sql('d', later=True)}, {_stated('q', 'c')}, {_stated('r', 'd')},
x AS (SELECT DISTINCT version_id, number, quantity, unit, unit_class, amount, days, comparator, {DIRECTION_SQL} AS way FROM q),
y AS (SELECT DISTINCT version_id, number, quantity, unit, unit_class, amount, days, comparator FROM r),
e AS (SELECT x.version_id, x.number, x.quantity AS was, y.quantity AS now, way, CASE WHEN x.unit_class <> y.unit_class OR way IS NULL THEN NULL WHEN x.unit_class = 'duration' THEN x.days WHEN x.unit = y.unit THEN x.amount END AS a,
      CASE WHEN y.unit_class = 'duration' THEN y.days ELSE y.amount END AS b, (x.comparator = '>')::INT - (x.comparator = '<')::INT AS ea, (y.comparator = '>')::INT - (y.comparator = '<')::INT AS eb
      FROM x JOIN y ON x.version_id = y.version_id AND x.number = y.number),
v AS (SELECT *, CASE WHEN a IS NULL THEN NULL WHEN a = b THEN sign(coalesce(eb, 0) - coalesce(ea, 0)) ELSE sign(b - a) END AS higher FROM e)
SELECT version_id, number, was, now, way, CASE WHEN higher IS NULL THEN 'INCOMPARABLE' WHEN higher = 0 THEN 'SAME' WHEN (higher > 0) = (way = 'min') THEN 'STRICTER' ELSE 'WEAKER' END AS verdict FROM v""")
def fun10_compare_quantities(spark, sf):
    """Each number of a clause against each one of the clause of the same number in the next snapshot."""
    fields = ["version_id", "number", "quantity", "unit", "unit_class", "amount", "days", "comparator"]
    was = rd.laterally(st.clauses(spark, sf), "read_quantities", "text", repeated=True, keep=("version_id", "number")).select(*fields, rd.direction(F.col("comparator"), F.col("lead")).alias("way")).distinct()
    now = rd.laterally(st.clauses(spark, sf, later=True), "read_quantities", "text", repeated=True, keep=("version_id", "number")).select(*fields).distinct()
    number = lambda: F.struct(*fields[2:])
    both = was.select("version_id", "number", "way", number().alias("a")).join(now.select("version_id", "number", number().alias("b")), ["version_id", "number"])
    verdict = qt.compare(F.col("a"), F.col("b"), F.col("way"), F.col("a.comparator"), F.col("b.comparator"))
    return both.select("version_id", "number", F.col("a.quantity").alias("was"), F.col("b.quantity").alias("now"), "way", verdict.alias("verdict"))


# Quotes are the first words of a document's first sentence, copied with one kind of slip each: the key chooses the slip, the
# words are the document's. A copy with one slip is found by the rung made for it, or it is refused for a known reason.
QUOTES_SQL = """
s AS (SELECT doc_id, text, regexp_extract(text, '^([A-Za-z, ]*)[.]', 1) AS head FROM documents),
w AS (SELECT *, regexp_extract_all(head, '[A-Za-z]+') AS w FROM s),
k AS (SELECT *, len(w) >= 8 AND length(w[6]) >= 6 AND right(w[6], 1) <> 'q' AND lower(w[6]) <> lower(w[7]) AND lower(w[7]) <> lower(w[8]) AS long,
      starts_with(text, array_to_string(w[:8], ' ')) AS bare FROM w WHERE len(w) >= 3)"""


def _first_words(spark, sf):
    docs = table(spark, sf, "documents").withColumn("head", F.regexp_extract("text", "^([A-Za-z, ]*)[.]", 1))
    w = docs.withColumn("w", F.regexp_extract_all("head", F.lit("[A-Za-z]+"), F.lit(0))).where(F.size("w") >= 3)
    sixth = F.get("w", F.lit(5))
    differ = lambda a, b: F.lower(F.get("w", F.lit(a))) != F.lower(F.get("w", F.lit(b)))
    long = (F.size("w") >= 8) & (F.length(sixth) >= 6) & (F.substring(sixth, -1, 1) != "q") & differ(5, 6) & differ(6, 7)
    bare = F.col("text").startswith(F.array_join(F.slice("w", 1, 8), " "))
    return w.withColumns({"long": F.coalesce(long, F.lit(False)), "bare": bare})


@query("fun15_grounding_ladder", "FUN15", sql=f"""
WITH {QUOTES_SQL},
t AS (SELECT *, CASE WHEN long THEN doc_id % 8 ELSE doc_id % 3 END AS slip FROM k),
o AS (SELECT *, regexp_extract(text, '^' || array_to_string(w[:CASE WHEN slip < 3 THEN 3 ELSE 8 END], '[, ]+')) AS own FROM t)
SELECT doc_id, CASE WHEN slip < 6 THEN 0 END::INTEGER AS start, CASE WHEN slip < 6 THEN length(own) END::INTEGER AS "end",
  CASE WHEN slip = 1 AND upper(own) = own AND NOT contains(own, ' ') THEN 'EXACT' WHEN slip < 6 THEN ['EXACT', 'FOLD', 'WORDS', 'OVERLAP', 'COMPACT', 'ONE_LETTER'][slip + 1] END AS rung,
  CASE slip WHEN 6 THEN 'SEMANTIC_ONLY' WHEN 7 THEN 'NO_SOURCE_SPAN' END AS reason FROM o""")
def fun15_grounding_ladder(spark, sf):
    t = _first_words(spark, sf).withColumn("slip", F.when(F.col("long"), F.col("doc_id") % 8).otherwise(F.col("doc_id") % 3))
    own = F.regexp_substr("text", F.concat(F.lit("^"), F.array_join(F.slice("w", 1, 3), "[, ]+")))
    part = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    slip, sixth = F.col("slip"), F.get("w", F.lit(5))
    quote = (
        F.when(slip == 0, own).when(slip == 1, F.upper(F.regexp_replace(own, " ", "  "))).when(slip == 2, F.concat(F.array_join(F.slice("w", 1, 3), "; "), F.lit(" ")))
        .when(slip == 3, F.concat_ws(" ", part(1, 5), part(7, 2))).when(slip == 4, F.concat(part(1, 4), part(5, 4)))
        .when(slip == 5, F.concat_ws(" ", part(1, 5), F.concat(sixth.substr(F.lit(1), F.length(sixth) - 1), F.lit("q")), part(7, 2)))
        .when(slip == 6, F.concat_ws(" ", F.lit("Qqqq"), part(2, 6), F.lit("qqqq"))).otherwise(F.concat(F.lit("Qqqq qqqq qqqqq qqqqqq "), part(1, 3))))
    return t.select("doc_id", rd.grounded(quote, F.col("text")).alias("f")).select("doc_id", "f.*")


@query("fun14_source_spans", "FUN14", "JON28", sql=f"""
WITH {QUOTES_SQL},
o AS (SELECT *, CASE WHEN long AND bare THEN doc_id % 6 WHEN bare THEN 0 ELSE 5 END AS slip, array_to_string(w[:8], ' ') AS own FROM k)
SELECT doc_id, CASE WHEN slip < 5 THEN 0 END::INTEGER AS start, CASE slip WHEN 5 THEN NULL WHEN 2 THEN length(array_to_string(w[:6], ' ')) ELSE length(own) END::INTEGER AS "end",
  ['EXACT', 'FRAGMENTS', 'SKIPPED_OPENING', 'NORMALISED', 'COMPACT', NULL][slip + 1] AS rung, CASE WHEN slip = 5 THEN 'QUOTE_NOT_IN_SOURCE' END AS reason FROM o""")
def fun14_source_spans(spark, sf):
    slip = F.when(F.col("long") & F.col("bare"), F.col("doc_id") % 6).when(F.col("bare"), 0).otherwise(5)
    t = _first_words(spark, sf).withColumn("slip", slip)
    part = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    slip = F.col("slip")
    quote = (
        F.when(slip == 0, F.array_join(F.slice("w", 1, 8), "\n ")).when(slip == 1, F.concat(part(1, 3), F.lit(" ... "), part(6, 3))).when(slip == 2, F.concat_ws(" ", part(7, 1), part(1, 6)))
        .when(slip == 3, F.upper(part(1, 8))).when(slip == 4, F.concat(part(1, 4), part(5, 4))).otherwise(F.concat(part(1, 2), F.lit(" qqqq qqqq qqqqq "), part(3, 1))))
    return t.select("doc_id", rd.quoted(quote, F.col("text")).alias("f")).select("doc_id", "f.*")


@query("fun13_sentences", "FUN13", "UDTF01", sql=f"""
WITH {st.clauses_sql('c')}, {st.sentences_sql('s', 'c')}
SELECT version_id, number, (i - 1)::INTEGER AS seq, a::INTEGER AS start, b::INTEGER AS "end", substring(text, a + 1, b - a) AS sentence FROM s""")
def fun13_sentences(spark, sf):
    return rd.laterally(st.clauses(spark, sf), "split_sentences", "text", repeated=True, keep=("version_id", "number")).select("version_id", "number", "seq", "start", "end", "sentence")


ITEM_STARTS = [sum(len(i) + 1 for i in st.ITEMS[:n]) for n in range(len(st.ITEMS) + 1)]
CLAUSES_SQL = f"""{st.clauses_sql('c')}, {st.lines_sql('l', 'c')}, {st.sentences_sql('s', 'l')},
p AS (SELECT *, pos + CASE WHEN i = 1 THEN 0 ELSE mark + a END AS sa, pos + mark + b AS sb, pos + mark + length(text) + 1 AS list_at FROM s),
e AS (SELECT version_id, number, substring(text, a + 1, b - a) AS said, sa AS x, sb AS y, NULL AS item, CASE WHEN n > 1 THEN i END AS k, NULL AS la, NULL AS lb, NULL AS ca, NULL AS cb FROM p WHERE NOT (opened AND i = n)
  UNION ALL SELECT version_id, number, substring(text, a + 1, b - a), list_at + it.o, list_at + it.o + it.n, it.m, NULL, sa, sb, list_at + {ITEM_STARTS[-1]}, list_at + {ITEM_STARTS[-1] + len(st.CLOSING)}
    FROM p, (VALUES {', '.join(f"('{t[0]}', {o}, {len(t)})" for t, o in zip(st.ITEMS, ITEM_STARTS))}) it(m, o, n) WHERE opened AND i = p.n),
r AS (SELECT *, 'art. ' || version_id || '/f.' || number || coalesce('/b.' || item, '') || coalesce('/c.' || k, '') AS bare FROM e),
cl AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER w = 1 THEN bare ELSE bare || '(' || row_number() OVER w || ')' END AS ref FROM r WINDOW w AS (PARTITION BY version_id, bare ORDER BY x))"""


@query("win07_clauses", "WIN07", "UDTF01", sql=f"""
WITH {CLAUSES_SQL}
SELECT version_id, ref, number::INTEGER AS paragraph, item, k::INTEGER AS sentence_no, x::INTEGER AS start, y::INTEGER AS "end", la::INTEGER AS lead_start, lb::INTEGER AS lead_end,
  ca::INTEGER AS closing_start, cb::INTEGER AS closing_end FROM cl""")
def win07_clauses(spark, sf):
    labelled = st.articles(spark, sf).withColumn("label", F.concat(F.lit("art. "), "version_id"))
    return rd.laterally(labelled, "split_clauses", "text", "label", keep=("version_id",)).select(
        "version_id", "ref", "paragraph", "item", "sentence_no", "start", "end", "lead_start", "lead_end", "closing_start", "closing_end")


@query("src27_reading_units", "SRC27", sql=f"""
WITH {CLAUSES_SQL}
SELECT version_id, ref, CASE WHEN item IS NULL THEN 'SENTENCE' ELSE 'ITEM' END AS kind, CASE WHEN item IS NULL THEN 1 ELSE 3 END AS segments,
  said || CASE item WHEN 'a' THEN ' {st.ITEMS[0][3:]} {st.CLOSING}' WHEN 'b' THEN ' {st.ITEMS[1][3:]} {st.CLOSING}' ELSE '' END AS unit FROM cl""")
def src27_reading_units(spark, sf):
    units = rd.laterally(st.articles(spark, sf).withColumn("label", F.concat(F.lit("art. "), "version_id")), "reading_units", "text", "label")
    return units.select("version_id", "ref", "kind", F.size("segments").alias("segments"), "unit")


def _starting(column: str, words) -> str:
    """The longest of the words that a text begins with."""
    return "CASE " + " ".join(f"WHEN starts_with({column}, '{w} ') THEN '{w}'" for w in sorted(words, key=len, reverse=True)) + " END"


def _tails(pattern: str) -> str:
    """From each match of the pattern to the end of the text."""
    cut, hit = f"string_split_regex(text, '(?i){pattern}')", f"regexp_extract_all(text, '(?i){pattern}')"
    return (f"list_transform(range(1, len({hit}) + 1), lambda k: substring(text, 1 + list_sum(list_transform({cut}[:k], lambda x: length(x)))::BIGINT"
            f" + coalesce(list_sum(list_transform({hit}[:k - 1], lambda x: length(x))), 0)::BIGINT))")


TR_ACTS_SQL = "bildirmek zorundadır|saklar|ibraz eder|başkasına veremez|Başkanlığa sunmakla yükümlüdür"
#: What the parts say: an English clause has one marker, its last sentence perhaps two more of which one is a bare power; a Turkish
#: one ends in an act whose verb counts where it closes the sentence.
DUTIES_SQL = rf"""{st.clauses_sql('c')},
en AS (SELECT *, {_starting('text', st.ACTORS)} AS subject FROM (SELECT *, row_number() OVER () AS copy FROM c) WHERE lang = 'en'),
em AS (SELECT *, {_starting('substring(text, length(subject) + 2)', st.MODALS)} AS modal FROM en),
ea AS (SELECT *, substring(text, length(subject) + length(modal) + 3) AS rest FROM em),
tm AS (SELECT *, regexp_extract(text, '^(.*? )({TR_ACTS_SQL})', 1) AS head, regexp_extract(text, '^(.*? )({TR_ACTS_SQL})', 2) AS act FROM (SELECT *, -row_number() OVER () AS copy FROM c) WHERE lang = 'tr'),
ta AS (SELECT *, regexp_extract(text, '^[^ ]+') AS subject, substring(text, length(head) + length(act) + 1, 1) AS after, string_split(act, ' ')[-1] AS verb FROM tm),
tb AS (SELECT *, act IN ('saklar', 'ibraz eder') AND after NOT IN ('.', ';') AS none FROM ta),
du AS MATERIALIZED (
  SELECT version_id, number, copy, text, lang, contains(text, ' The records must be kept') AS insufficient, false AS none, subject,
    CASE modal WHEN 'must' THEN 'MUST' WHEN 'shall' THEN 'MUST' WHEN 'is required to' THEN 'MUST' WHEN 'must not' THEN 'MUST_NOT' WHEN 'may' THEN 'MAY' WHEN 'may not' THEN 'MAY_NOT' ELSE 'SHOULD' END AS modality, modal AS marker,
    coalesce(nullif(regexp_extract(rest, '^(.*?[.;!?])\s+[A-Z]', 1), ''), rest) AS action,
    {_tails(r'\b(?:if|where|when|provided\s+that|subject\s+to)\b')} AS conditions,
    {_tails(r'\b(?:unless|except(?:\s+where)?|other\s+than|save\s+where|without|does\s+not\s+apply|do\s+not\s+apply)\b')} AS exceptions FROM ea
  UNION ALL
  SELECT version_id, number, copy, text, lang, false, none, subject, CASE WHEN verb = 'veremez' THEN 'MUST_NOT' ELSE 'MUST' END, verb,
    substring(head, length(subject) + 2) || CASE WHEN verb IN ('zorundadır', 'yükümlüdür') THEN string_split(act, ' ' || verb)[1] ELSE act END,
    [], list_filter([CASE WHEN contains(text, 'gerçek kişiler hariç') THEN 'gerçek kişiler hariç' END, CASE WHEN contains(text, 'istisnalar saklıdır') THEN 'istisnalar saklıdır' END,
      CASE WHEN contains(text, 'uygulanmaz') THEN 'Bu hüküm muaf olanlara uygulanmaz' END], lambda x: x IS NOT NULL) FROM tb)"""


@query("fun29_extract_duties", "FUN29", "FUN45", sql=f"""
WITH {DUTIES_SQL}
SELECT version_id, number, CASE WHEN insufficient THEN 'INSUFFICIENT_EVIDENCE' WHEN none THEN 'NO_EXPLICIT_OBLIGATION' ELSE 'EXTRACTED' END AS status,
  CASE WHEN NOT insufficient AND NOT none THEN subject END AS subject, CASE WHEN NOT insufficient AND NOT none THEN modality END AS modality, CASE WHEN NOT insufficient AND NOT none THEN action END AS action,
  CASE WHEN insufficient OR none THEN '' ELSE array_to_string(conditions, ' | ') END AS conditions, CASE WHEN insufficient OR none THEN '' ELSE array_to_string(exceptions, ' | ') END AS exceptions FROM du""")
def fun29_extract_duties(spark, sf):
    return rd.laterally(st.clauses(spark, sf), "read_duties", "text", repeated=True, keep=("version_id", "number")).select(
        "version_id", "number", "status", "subject", "modality", "action", F.array_join("conditions", " | ").alias("conditions"), F.array_join("exceptions", " | ").alias("exceptions"))


@query("fun28_duty_elements", "FUN28", sql=f"""
WITH {FACTS_SQL}, {DUTIES_SQL},
ok AS (SELECT *, instr(text, action) + length(action) AS until FROM du WHERE NOT insufficient AND NOT none),
n AS (SELECT version_id, number, copy, CASE WHEN unit_class = 'duration' THEN 'DEADLINE' ELSE 'THRESHOLD' END AS kind, phrase, instr(text, part) + instr(part, phrase) AS at_char FROM ok JOIN facts ON contains(text, part) WHERE instr(text, part) < until),
e AS (SELECT version_id, number, 'subject' AS id, 'SUBJECT' AS kind, subject AS element, false AS critical FROM ok UNION ALL SELECT version_id, number, 'modal', 'MODAL', modality, false FROM ok UNION ALL SELECT version_id, number, 'act', 'ACT', action, true FROM ok
  UNION ALL SELECT version_id, number, lower(kind) || '_' || row_number() OVER (PARTITION BY copy, kind ORDER BY at_char), kind, phrase, true FROM n
  UNION ALL SELECT version_id, number, 'condition_' || i, 'CONDITION', conditions[i], false FROM (SELECT *, unnest(range(1, len(conditions) + 1)) AS i FROM ok)
  UNION ALL SELECT version_id, number, 'exception_' || i, 'EXCEPTION', exceptions[i], false FROM (SELECT *, unnest(range(1, len(exceptions) + 1)) AS i FROM ok))
SELECT version_id, number, id, kind, element, critical FROM e""")
def fun28_duty_elements(spark, sf):
    return rd.laterally(st.clauses(spark, sf), "duty_elements", "text", repeated=True, keep=("version_id", "number")).select("version_id", "number", "id", "kind", "element", "critical")


@query("fil02_duty_markers", "FIL02", "UDTF02", sql=f"""
WITH {DUTIES_SQL},
m AS (SELECT version_id, number, marker, modality AS mode, lang, text, none, instr(text, CASE WHEN lang = 'en' THEN subject || ' ' || marker ELSE marker END) - 1 + CASE WHEN lang = 'en' THEN length(subject) + 1 ELSE 0 END AS start FROM du WHERE NOT none
  UNION ALL SELECT version_id, number, 'must', 'MUST', lang, text, none, instr(text, ' must be kept') FROM du WHERE insufficient
  UNION ALL SELECT version_id, number, 'may', 'MAY', lang, text, none, instr(text, ' may be given') FROM du WHERE insufficient)
SELECT version_id, number, start::INTEGER AS start, marker, mode, marker NOT IN ('saklar', 'eder') AS binding FROM m""")
def fil02_duty_markers(spark, sf):
    return rd.laterally(st.clauses(spark, sf), "duty_markers", "text", repeated=True, keep=("version_id", "number")).select("version_id", "number", "start", "marker", "mode", "binding")


@query("fun40_missing_qualifiers", "FUN40", sql=f"""
WITH {DUTIES_SQL},
k AS (SELECT *, CASE WHEN number % 2 = 0 AND NOT insufficient AND NOT none THEN exceptions ELSE [] END AS carried FROM du),
q AS (SELECT version_id, number, carried, unnest(list_concat(conditions, exceptions)) AS span FROM k)
SELECT version_id, number, span FROM q WHERE len(list_filter(carried, lambda c: contains(c, span))) = 0""")
def fun40_missing_qualifiers(spark, sf):
    """Of every second clause the exceptions were carried; what else a clause says is missing."""
    read = rd.laterally(st.clauses(spark, sf), "read_duties", "text", repeated=True).where("seq = 0")
    carried = F.when(F.col("number") % 2 == 0, F.col("exceptions")).otherwise(F.array().cast("array<string>"))
    return rd.laterally(read.select("version_id", "number", "text", carried.alias("carried")), "missing_qualifiers", "text", "carried").select("version_id", "number", "span")


@query("fun41_uncovered_sentences", "FUN41", sql=f"""
WITH {DUTIES_SQL},
n AS (SELECT version_id, number, CASE WHEN none OR (number % 3 = 0 AND NOT insufficient) THEN 0 ELSE 1 END + CASE WHEN insufficient THEN 2 ELSE 0 END AS sentences FROM du)
SELECT version_id, number, sum(sentences)::BIGINT AS sentences FROM n GROUP BY ALL HAVING sum(sentences) > 0""")
def fun41_uncovered_sentences(spark, sf):
    """Of every third clause the first act was kept; the sentences with a marker of duty and no act kept."""
    read = rd.laterally(st.clauses(spark, sf), "read_duties", "text", repeated=True).where("seq = 0")
    actions = F.when(F.col("number") % 3 == 0, F.array("action")).otherwise(F.array().cast("array<string>"))
    open_ones = rd.laterally(read.select("version_id", "number", "text", F.array_compact(actions).alias("actions")), "uncovered_sentences", "text", "actions")
    return open_ones.groupBy("version_id", "number").agg(F.count(F.lit(1)).alias("sentences"))


#: Where the notes of an article lead: to the article, to a paragraph from its head, to the sentence they precede, or to the items of
#: the list whose lead-in holds them. An added sentence joins the one before where a figure ends that.
NOTES_SQL = f"""{st.clauses_sql('c')}, {st.lines_sql('l', 'c')}, {st.sentences_sql('s', 'l')},
g AS MATERIALIZED (SELECT version_id, number, copy, pos, opened, (version_id + number) % 3 = 1 AS lead, number % 4 = 2 AS added, make_date({st.DATES[2]}, {st.DATES[1]}, {st.DATES[0]}) AS dated,
    max(n) + CASE WHEN number % 4 = 2 AND NOT regexp_matches(any_value(text), '[0-9][.]$') THEN 1 ELSE 0 END AS n FROM s GROUP BY version_id, number, copy, pos, opened),
e AS (SELECT *, NULL AS item, i AS ord FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM g) WHERE NOT (opened AND i = n)
  UNION ALL SELECT w.*, it AS item, 1000 AS ord FROM (SELECT *, NULL AS i FROM g WHERE opened) w, (VALUES ('a'), ('b')) v(it)),
r AS (SELECT *, 'art. ' || version_id || '/f.' || number || coalesce('/b.' || item, '') || CASE WHEN item IS NULL AND n > 1 THEN '/c.' || i ELSE '' END AS bare FROM e),
cl AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER w = 1 THEN bare ELSE bare || '(' || row_number() OVER w || ')' END AS ref FROM r WINDOW w AS (PARTITION BY version_id, bare ORDER BY pos, ord)),
nt AS (SELECT version_id, ref, 'REENACTED' AS action, 'UNSPECIFIED' AS unit, DATE '2013-05-24' AS dated, '6487/2 md' AS instrument, 'ARTICLE' AS level, -1 AS note_at FROM cl WHERE version_id % 4 = 0
  UNION ALL SELECT t.version_id, t.ref, 'CHANGED', 'UNSPECIFIED', o.dated, '28769', CASE WHEN o.opened AND o.n = 1 THEN 'LIST' WHEN t.copy = o.copy AND t.i = 1 THEN 'OWN' ELSE 'PARAGRAPH' END, o.pos * 2
    FROM g o JOIN cl t ON o.version_id = t.version_id AND o.number = t.number AND (t.copy = o.copy OR NOT (o.opened AND o.n = 1)) WHERE o.lead
  UNION ALL SELECT t.version_id, t.ref, 'ADDED', 'SENTENCE', o.dated, '7584/2 md', CASE WHEN o.opened THEN 'LIST' ELSE 'OWN' END, o.pos * 2 + 1
    FROM g o JOIN cl t ON o.copy = t.copy AND CASE WHEN o.opened THEN t.item IS NOT NULL ELSE t.i = o.n END WHERE o.added)"""


@query("win10_clause_notes", "WIN10", sql=f"WITH {NOTES_SQL} SELECT version_id, ref, action, unit, dated::VARCHAR AS dated, instrument, level FROM nt")
def win10_clause_notes(spark, sf):
    return am.clause_notes(st.noted_articles(spark, sf)).select("version_id", "ref", "action", "unit", F.col("dated").cast("string").alias("dated"), "instrument", "level")


@query("win10_latest_notes", "WIN10", sql=f"""
WITH {NOTES_SQL}
SELECT version_id, ref, count(*)::BIGINT AS notes, count(*) FILTER (level = 'OWN') AS own, arg_max(action, {{d: dated, p: -note_at}}) AS action, arg_max(level, {{d: dated, p: -note_at}}) AS level, max(dated)::VARCHAR AS dated FROM nt GROUP BY ALL""")
def win10_latest_notes(spark, sf):
    return am.latest_notes(am.clause_notes(st.noted_articles(spark, sf))).withColumn("dated", F.col("dated").cast("string"))


@query("win11_changes_since", "WIN11", sql=rf"""
WITH {NOTES_SQL},
f AS (SELECT copy, i, regexp_matches(substring(text, a + 1, b - a), '\b(must|shall|may|should|is required to)\b')
    OR (lang = 'tr' AND i = 1 AND NOT regexp_matches(text, '(saklar|ibraz eder),')) AS duty FROM s
  UNION ALL SELECT copy, n, true FROM g WHERE added),
k AS (SELECT copy, i, bool_or(duty) AS duty FROM f GROUP BY ALL),
d AS (SELECT cl.version_id, cl.ref FROM cl JOIN k ON cl.copy = k.copy AND k.i = CASE WHEN cl.item IS NULL THEN cl.i ELSE cl.n END WHERE k.duty),
t AS (SELECT version_id, ref, arg_max({{a: action, d: dated, i: instrument}}, {{d: dated, p: -note_at}}) AS x FROM nt WHERE dated >= DATE '2012-01-01' GROUP BY ALL)
SELECT version_id, ref, CASE WHEN x.a = 'ADDED' THEN 'ADDED' ELSE 'MODIFIED' END AS kind, x.d::VARCHAR AS dated, x.i AS instrument,
  CASE WHEN d.ref IS NULL THEN 'NO_DUTY_AFFECTED' WHEN x.a = 'ADDED' THEN 'NEW_DUTY' ELSE 'DUTY_CHANGED_OLD_WORDING_UNKNOWN' END AS impact FROM t LEFT JOIN d USING (version_id, ref)""")
def win11_changes_since(spark, sf):
    articles = st.noted_articles(spark, sf)
    units = rd.laterally(articles, "reading_units", "text", "label", keep=("version_id",), give=("ref", "unit"), again=False)
    stated = rd.laterally(units, "duty_markers", "unit", keep=("version_id", "ref"), give=())
    return am.changes_since(am.clause_notes(articles), stated, "2012-01-01").withColumn("dated", F.col("dated").cast("string"))


def _named(text: str, kinds) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{p}') THEN '{k}' END" for k, p in kinds) + "], lambda x: x IS NOT NULL)"


#: Kinds by the words of the parts, written for RE2 over blank-padded lower case.
OBLIGED_KINDS = (("BANK", " banks? | bankalar "), ("PAYMENT_INSTITUTION", "payment institution|ödeme kuruluş"), ("EMONEY_INSTITUTION", "e-?money institution"), ("INSURANCE", " insurers? |sigorta şirket"),
                 ("BROKER", " investment firms? "), ("FINANCIAL_GENERIC", "financial institution|finansal kuruluş"))
PARTY_KINDS = (("ASSOCIATION", " dernek"), ("FOUNDATION", " vak[ıi]f"), ("NON_RESIDENT", " non-resident"), ("INDIVIDUAL", " retail client| consumers?[ .,;]| gerçek kişi"), ("LEGAL_ENTITY", " compan(?:y|ies)[ .,;]| şirketler| şirketin"))
SELF_KINDS = (("BANK", " bank "), ("BROKER", "investment firm"), ("PAYMENT_INSTITUTION", "ödeme kuruluş|sanal pos"), ("EMONEY_INSTITUTION", " e-?money"), ("INSURANCE", " insur"), ("PRECIOUS_METALS", "jewel"))
FAMILY_KINDS = (("ANY", " all customers"), ("INDIVIDUAL", " retail| consumer| individual"), ("BUSINESS", " smes? | merchant| corporate"), ("LEGAL_ENTITY_GENERIC", " legal entit"), ("ASSOCIATION", " dernek"),
                ("FOUNDATION", " vak[ıi]f"), ("NON_RESIDENT", " non-resident"), ("CORRESPONDENT", " financial institution"))
_LOW = lambda t: f"(' ' || regexp_replace(lower(translate({t}, 'İI', 'iı')), '\\s+', ' ', 'g') || ' ')"
_PICK = lambda values, n: "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[({n}) % {len(values)} + 1]"
GATE_PARTIES_SQL = rf"""
h AS (SELECT version_id, number, subject, CASE WHEN regexp_matches(text, '(?s)^(.{{0,220}}?)(?:[;:]|kimlik tespitinde|kimlik tespiti|\bmust\b|\bshall\b|zorundadır|yükümlüdür|$)')
    THEN regexp_extract(text, '(?s)^(.{{0,220}}?)(?:[;:]|kimlik tespitinde|kimlik tespiti|\bmust\b|\bshall\b|zorundadır|yükümlüdür|$)', 1) ELSE left(text, 220) END AS head FROM du),
rq AS (SELECT version_id, number, subject, {_named(_LOW('subject'), OBLIGED_KINDS)} AS obliged, {_named(_LOW("CASE WHEN subject = 'Any person' THEN head ELSE subject || ' ' || head END"), PARTY_KINDS)} AS parties FROM h),
cp AS (SELECT c_custkey, {_PICK(st.DESCRIPTIONS, 'c_custkey')} AS description, {_PICK(st.CUSTOMERS, 'c_custkey + floor(c_custkey / 9)::BIGINT')} AS customers FROM customer),
pf AS (SELECT c_custkey, {_named(_LOW('description'), SELF_KINDS)} AS kinds, {_named(_LOW('customers'), FAMILY_KINDS)} AS families, customers <> '' AS stated FROM cp)"""


@query("fun24_entity_gate", "FUN24", sql=f"""
WITH {DUTIES_SQL}, {GATE_PARTIES_SQL},
j AS (SELECT rq.*, c_custkey, kinds, families,
    list_transform(obliged, lambda k: CASE WHEN k = 'FINANCIAL_GENERIC' THEN CASE WHEN list_has_any(kinds, ['BANK', 'BROKER', 'PAYMENT_INSTITUTION', 'EMONEY_INSTITUTION', 'INSURANCE']) THEN 'MATCH' WHEN kinds = ['PRECIOUS_METALS'] THEN 'MISMATCH' ELSE 'UNDETERMINED' END
      WHEN list_contains(kinds, k) THEN 'MATCH' WHEN len(kinds) > 0 THEN 'MISMATCH' ELSE 'UNDETERMINED' END) AS o,
    list_transform(parties, lambda k: CASE WHEN list_contains(families, 'ANY') OR list_contains(families, k) OR (k = 'LEGAL_ENTITY' AND list_has_any(families, ['BUSINESS', 'LEGAL_ENTITY_GENERIC', 'ASSOCIATION', 'FOUNDATION'])) THEN 'MATCH'
      WHEN k = 'NON_RESIDENT' OR NOT stated THEN 'UNDETERMINED' WHEN k IN ('ASSOCIATION', 'FOUNDATION') AND list_contains(families, 'LEGAL_ENTITY_GENERIC') THEN 'UNDETERMINED'
      WHEN len(list_filter(families, lambda f: f <> 'CORRESPONDENT')) > 0 THEN 'MISMATCH' ELSE 'UNDETERMINED' END) AS c
  FROM rq JOIN orders ON o_orderkey = version_id JOIN pf ON c_custkey = o_custkey),
a AS (SELECT *, CASE WHEN len(o) = 0 THEN NULL WHEN list_unique(o) = 1 AND o[1] = 'MISMATCH' THEN 'MISMATCH' WHEN list_contains(o, 'MATCH') THEN 'MATCH' ELSE 'UNDETERMINED' END AS addressed FROM j)
SELECT version_id, number, c_custkey, array_to_string(obliged, '; ') AS obliged, array_to_string(parties, '; ') AS counterparties,
  CASE WHEN len(o) = 0 AND len(c) = 0 THEN 'NOT_RESTRICTED' WHEN addressed = 'MISMATCH' OR (list_unique(c) = 1 AND c[1] = 'MISMATCH') THEN 'MISMATCH'
       WHEN (list_contains(o, 'MATCH') OR list_contains(c, 'MATCH')) AND coalesce(addressed, 'MATCH') = 'MATCH' AND (len(c) = 0 OR list_contains(c, 'MATCH')) THEN 'MATCH' ELSE 'UNDETERMINED' END AS gate FROM a""")
def fun24_entity_gate(spark, sf):
    """Every clause of an order against the profile of its customer; the subject is the clause's opening party."""
    c = st.clauses(spark, sf)
    english = F.regexp_extract("text", "^(" + "|".join(sorted(st.ACTORS, key=len, reverse=True)) + ") ", 1)
    parties = en.required_parties(c.withColumn("subject", F.when(F.col("lang") == "en", english).otherwise(F.substring_index("text", " ", 1))))
    profiles = en.company_profiles(st.described(spark, sf))
    asked = parties.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("c_custkey")), "version_id").join(profiles, "c_custkey")
    return en.entity_gate(asked).select("version_id", "number", "c_custkey", F.array_join("obliged", "; ").alias("obliged"), F.array_join("counterparties", "; ").alias("counterparties"), "gate")


#: By the number of the sentence: written limit, property, value, unit, comparator, role; N is the row's number.
LIMIT_FACTS = ((0, "N mg/L", "caffeine_mg_per_l", "n", "mg/L", "le", "LIMIT"), (1, "N,5 g/L", "ethanol_g_per_l", "n + 0.5", "g/L", "le", "LIMIT"), (2, "%N", "fruit_percent", "n", "%", "ge", "LIMIT"),
               (3, "N mg/L", "taurine_mg_per_l", "n", "mg/L", "gt", "CONDITION"), (4, "N mg/L", "property:kinin", "n", "mg/L", "le", "LIMIT"), (5, "N metre", "distance_m", "n", "m", "eq", "LIMIT"),
               (6, "% N", "abv_percent", "n", "%", "ge", "CONDITION"), (7, "pH değeri N", "ph", "n", "pH", "le", "LIMIT"), (8, "N mg/L", "inositol_mg_per_l", "n", "mg/L", "le", "LIMIT"),
               (8, "800 mg/L", "taurine_mg_per_l", "800", "mg/L", "le", "LIMIT"), (9, "N mm", None, "n", "mm", "lt", "CONDITION"), (11, "yüz elli metre", "distance_m", "150", "m", "eq", "LIMIT"))


@query("fun12_limits", "FUN12", "UDTF02", sql=f"""
WITH p AS (SELECT p_partkey, p_partkey % {len(st.PROPERTY_RULES)} AS k, (p_partkey // 7) % 900 + 2 AS n FROM part),
f AS ({' UNION ALL '.join(f"SELECT p_partkey, replace('{w}', 'N', n::VARCHAR) AS written, {_cell(a)}::VARCHAR AS attribute, ({v})::DOUBLE AS value, '{u}' AS unit, '{c}' AS comparator, '{r}' AS role FROM p WHERE k = {k}" for k, w, a, v, u, c, r in LIMIT_FACTS)})
SELECT p_partkey, written AS "limit", attribute, value, unit, comparator, role FROM f""")
def fun12_limits(spark, sf):
    return rd.laterally(st.property_rules(spark, sf), "read_limits", "text").select("p_partkey", "limit", "attribute", "value", "unit", "comparator", "role")
