"""Clauses of statutes derived from the given tables: wording that varies row by row, in English and Turkish.

A line item is a clause of an article (its order); its keys and quantities choose the parts of the sentence. The later
snapshot drops, repeats and rewords some. The lists below are all the text there is; Spark and SQL put it together alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread, table

ACTORS = ("A firm", "A bank", "An insurer", "The payment institution", "Investment firms", "An e-money institution", "The competent authority", "Any person",
          "Financial institutions", "A company", "The operator of the facility")
MODALS = ("must", "shall", "must not", "may", "should", "is required to", "may not")
ACTS = ("report suspicious transactions to the authority", "keep the records", "notify the customer", "identify the customer and verify the documents", "submit the annual report",
        "disclose the report", "sell energy drinks in school canteens", "provide information to consumers and to the Board")
TIMES = ("", " within 10 business days", " within five working days of the event", " no later than 3 months after the request", " for at least eight years", " within twenty-four hours",
         " immediately", " every two years", " for 5 years and six months", " not later than thirty-one days before the transfer", " promptly and at the end of each month")
AMOUNTS = ("", " for transfers of EUR 15,000 or more", " where the amount is at least GBP 1,000.50", " up to 2.5%", " for payments exceeding two million TL", " in excess of $250 thousand",
           " of less than 150 euros", " at a rate of seven percent", " above 185.000 TL")
CONDS = ("", ", where the customer is a non-resident", ", unless the risk is low", ", except for consumers", ", in accordance with article 7", " (see Art. 5 No. 3)", ", as defined in \"the Act. Part II\"",
         ", other than exempt companies", ", provided that no complaint is pending")
TAILS = ("", "", "", " This does not apply to retail clients.", " The records must be kept for 7 years. A copy may be given to the customer.", " If the term ends, the duty lapses.",
         " \"Term\" means a calendar month.")
TR_ACTORS = ("Yükümlüler", "Bankalar", "Ödeme kuruluşları", "Sigorta şirketleri", "Finansal kuruluşlar", "Dernekler ve vakıflar")
TR_OBJECTS = ("şüpheli işlemleri", "müşteri kayıtlarını", "yüzseksenbeşbin TL ve üzerindeki işlemleri", "15.000 TL'yi aşan ödemeleri", "bilgi ve belgeleri", "yıllık raporu")
TR_TIMES = (" on iş günü içinde", " en geç beş gün içinde", " sekiz yıl süre ile", " derhal", " en az iki buçuk yıl", " üç ayda bir", "")
TR_ACTS = (" bildirmek zorundadır", " saklar", " ibraz eder", " başkasına veremez", " Başkanlığa sunmakla yükümlüdür")
TR_CONDS = (".", "; istisnalar saklıdır.", ", gerçek kişiler hariç.", ". Bu hüküm muaf olanlara uygulanmaz.")


def _keys(later: bool) -> str:
    """Numbers of the parts, as expressions both engines read."""
    shift = lambda divisor: f"CASE WHEN l_partkey % {divisor} = 0 THEN 1 ELSE 0 END" if later else "0"
    return ", ".join(f"CAST({e} AS BIGINT) AS {name}" for name, e in (
        ("k_lang", "l_suppkey % 4"),
        ("k_actor", f"l_partkey + l_suppkey + {shift(19)}"), ("k_modal", f"l_suppkey + l_linenumber + {shift(23)}"), ("k_act", f"l_partkey + 3 * l_suppkey + {shift(29)}"),
        ("k_time", f"floor(l_quantity) + {shift(7)}"), ("k_amount", f"l_partkey + 7 * l_linenumber + {shift(13)}"), ("k_cond", f"l_suppkey + floor(l_quantity) + {shift(17)}"),
        ("k_tail", f"l_partkey + 2 * l_linenumber + {shift(31)}")))


PARTS = {False: (("k_actor", ACTORS), (None, " "), ("k_modal", MODALS), (None, " "), ("k_act", ACTS), ("k_time", TIMES), ("k_amount", AMOUNTS), ("k_cond", CONDS), (None, "."), ("k_tail", TAILS)),
         True: (("k_actor", TR_ACTORS), (None, " "), ("k_act", TR_OBJECTS), ("k_time", TR_TIMES), ("k_modal", TR_ACTS), ("k_cond", TR_CONDS))}


def _text(turkish: bool) -> Column:
    return F.concat(*[F.lit(p) if k is None else F.element_at(F.array(*map(F.lit, p)), (F.col(k) % len(p) + 1).cast("int")) for k, p in PARTS[turkish]])


def as_clauses(lineitem: DataFrame, later: bool = False) -> DataFrame:
    """(version_id, number, lang, text) of a table shaped like ``lineitem``."""
    x = lineitem
    if later:
        x = x.filter("l_partkey % 10 <> 0").withColumn("l_linenumber", F.explode(F.when(F.col("l_partkey") % 11 == 0, F.array("l_linenumber", F.col("l_linenumber") + 10)).otherwise(F.array("l_linenumber"))))
    turkish = F.col("k_lang") == 3
    return x.select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").cast("bigint").alias("number"), F.expr(f"struct({_keys(later)})").alias("k")).select("version_id", "number", "k.*").select(
        "version_id", "number", F.when(turkish, "tr").otherwise("en").alias("lang"), F.when(turkish, _text(True)).otherwise(_text(False)).alias("text"))


def clauses(spark: SparkSession, sf: str, later: bool = False) -> DataFrame:
    return as_clauses(spread(table(spark, sf, "lineitem")), later)


def clauses_sql(name: str, later: bool = False) -> str:
    """The same rows as a named SQL subquery."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    text = lambda turkish: " || ".join(quoted(p) if k is None else f"([{', '.join(map(quoted, p))}])[{k} % {len(p)} + 1]" for k, p in PARTS[turkish])
    source = "lineitem"
    if later:
        source = ("(SELECT * REPLACE (unnest(CASE WHEN l_partkey % 11 = 0 THEN [l_linenumber, l_linenumber + 10] ELSE [l_linenumber] END) AS l_linenumber) "
                  "FROM lineitem WHERE l_partkey % 10 <> 0)")
    return f"""{name} AS MATERIALIZED (SELECT version_id, number, CASE WHEN k_lang = 3 THEN 'tr' ELSE 'en' END AS lang, CASE WHEN k_lang = 3 THEN {text(True)} ELSE {text(False)} END AS text
  FROM (SELECT l_orderkey AS version_id, l_linenumber::BIGINT AS number, {_keys(later)} FROM {source}))"""


#: Every third clause in English opens a list with these items and this closing line.
ITEMS, CLOSING = ("a) the first copy,", "b) the second copy; and"), "at all times."


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """(version_id, text): the clauses of an order as numbered paragraphs, one under another; a list is as long as an order."""
    opened = (F.col("number") % 3 == 0) & (F.col("lang") == "en")
    lines = F.concat(F.lit("("), "number", F.lit(") "), "text", F.when(opened, F.lit("\n" + "\n".join((*ITEMS, CLOSING)))).otherwise(""))
    listed = F.array_sort(F.collect_list(F.struct("number", "text", lines.alias("lines"))))
    return clauses(spark, sf).groupBy("version_id").agg(F.array_join(F.transform(listed, lambda c: c["lines"]), "\n").alias("text"))


def lines_sql(name: str, source: str) -> str:
    """Where each clause of ``source`` stands in its article: (version_id, number, text, tail, opened, pos), ``pos`` its bracket's place."""
    return f"""{name} AS MATERIALIZED (SELECT *, coalesce(sum(size + 1) OVER (PARTITION BY version_id ORDER BY number, text, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM (SELECT *, number % 3 = 0 AND lang = 'en' AS opened, length(number::VARCHAR) + 3 AS mark, row_number() OVER () AS copy,
          length(number::VARCHAR) + 3 + length(text) + CASE WHEN number % 3 = 0 AND lang = 'en' THEN {sum(map(len, (*ITEMS, CLOSING))) + len(ITEMS) + 1} ELSE 0 END AS size FROM {source}))"""


def sentences_sql(name: str, source: str) -> str:
    """The sentences of a clause's text, from what its parts are known to end: (.., i, n, a, b)."""
    ends = [t for t in TAILS if t] + [TR_CONDS[3]]
    inner = {" The records must be kept for 7 years. A copy may be given to the customer.": " The records must be kept for 7 years."}
    tail = "CASE " + " ".join(f"WHEN ends_with(text, '{t}') THEN {len(t) - (1 if t.startswith('. ') else 0)}" for t in ends) + " ELSE 0 END"
    second = " ".join(f"WHEN ends_with(text, '{t}') THEN length(text) - {len(t) - len(first)}" for t, first in inner.items())
    return f"""{name}_c AS (SELECT *, length(text) - {tail} AS base FROM {source}),
{name}_l AS (SELECT *, list_filter([CASE WHEN base < length(text) AND NOT regexp_matches(left(text, base), '[0-9][.]$') THEN base END, CASE {second} END], lambda x: x IS NOT NULL) AS cuts FROM {name}_c),
{name} AS MATERIALIZED (SELECT *, (CASE WHEN i = 1 THEN 0 ELSE cuts[i - 1] + 1 END)::BIGINT AS a, (CASE WHEN i = n THEN length(text) ELSE cuts[i] END)::BIGINT AS b
  FROM (SELECT *, len(cuts) + 1 AS n, unnest(range(1, len(cuts) + 2)) AS i FROM {name}_l))"""


#: Notes of the consolidated text: one over a whole article, one at the head of a paragraph, one before an added sentence.
ADDED = "Ek hüküm uygulanır."
DATES = ("number % 28 + 1", "version_id % 12 + 1", "2000 + (version_id + number) % 25")


def noted_articles(spark: SparkSession, sf: str) -> DataFrame:
    """``articles`` with amendment notes."""
    # line items are dealt by article before their wording is put together, so keys travel instead of texts, and once; a number of
    # parts is given, or few bytes of keys would be put into few tasks, whose texts do not fit their memory
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    c = as_clauses(table(spark, sf, "lineitem").repartition(parts, "l_orderkey")).withColumns({"day": F.expr(DATES[0]), "month": F.expr(DATES[1]), "year": F.expr(DATES[2])})
    dated = F.concat_ws("/", "day", "month", "year")
    opened = (F.col("number") % 3 == 0) & (F.col("lang") == "en")
    lines = F.concat(F.lit("("), "number", F.lit(") "), F.when((F.col("version_id") + F.col("number")) % 3 == 1, F.concat(F.lit("(Değişik:RG-"), dated, F.lit("-28769) "))).otherwise(""), "text",
                     F.when(F.col("number") % 4 == 2, F.concat(F.lit(" (Ek cümle:"), dated, F.lit("-7584/2 md.) " + ADDED))).otherwise(""), F.when(opened, F.lit("\n" + "\n".join((*ITEMS, CLOSING)))).otherwise(""))
    listed = F.array_sort(F.collect_list(F.struct("number", "text", lines.alias("lines"))))
    joined = c.groupBy("version_id").agg(F.array_join(F.transform(listed, lambda x: x["lines"]), "\n").alias("text"))
    head = F.when(F.col("version_id") % 4 == 0, "(Yeniden düzenleme: 24/5/2013-6487/2 md.)\n").otherwise("")
    return joined.select("version_id", F.concat(head, "text").alias("text"), F.concat(F.lit("art. "), "version_id").alias("label"))


#: What a company's profile says it is, and whom it serves.
DESCRIPTIONS = ("A licensed bank in three countries", "Ödeme kuruluşu ve sanal POS hizmeti", "General insurer", "Goldsmith and jeweller", "An investment firm with two branches", "E-money wallets", "A software house", "",
                "Bank headquartered outside Türkiye")
CUSTOMERS = ("retail consumers and SMEs", "dernek ve vakıflar", "all customers", "legal entities", "corporate customers, merchants", "", "non-resident individuals", "financial institutions")


def described(spark: SparkSession, sf: str) -> DataFrame:
    """(c_custkey, description, customers, jurisdictions_stated) of every customer."""
    pick = lambda values, shift: F.element_at(F.array(*map(F.lit, values)), ((F.col("c_custkey") + shift) % len(values) + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", pick(DESCRIPTIONS, 0).alias("description"), pick(CUSTOMERS, F.floor(F.col("c_custkey") / 9)).alias("customers"), (F.col("c_custkey") % 2 == 0).alias("jurisdictions_stated"))


#: Sentences on properties of products and places; N stands for a number of the row.
PROPERTY_RULES = ("Kafein miktarı en fazla N mg/L olabilir.", "Etil alkol miktarı N,5 g/L den fazla olamaz.", "Meyve oranı en az %N olmalıdır.", "Taurin miktarı N mg/L den fazla olan ürünler etiketlenir.",
                  "Kinin miktarı N mg/L’yi geçemez.", "Okullara N metre mesafeden yakın satış yapılamaz.", "Hacmen % N ve daha fazla alkol içeren içecekler ayrıca işaretlenir.", "pH değeri N’i geçemez.",
                  "-İnositol N mg/L -Taurin 800 mg/L den fazla olamaz.", "Etiket yazısı N mm den azdır.", "Kayıtlar saklanır.", "Okullara yüz elli metre mesafeden yakın satış yapılamaz.")


def property_rules(spark: SparkSession, sf: str) -> DataFrame:
    """(p_partkey, text): what is required of each part."""
    pattern = F.element_at(F.array(*map(F.lit, PROPERTY_RULES)), (F.col("p_partkey") % len(PROPERTY_RULES) + 1).cast("int"))
    return spread(table(spark, sf, "part")).select("p_partkey", F.regexp_replace(pattern, F.lit(r"\bN\b"), (F.floor(F.col("p_partkey") / 7) % 900 + 2).cast("string")).alias("text"))
