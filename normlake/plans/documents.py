"""Document queries: reading, quality, classes, references, definitions, context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quantity as qt
from ..functions import scan
from ..functions import text as tx
from ..operators import documents as dc
from ..sources.html import page_heads, page_paragraphs
from ..sources.tables import table
from . import adapters as ad
from . import sqltext as sq
from .registry import query


@query("src01_corpus_scan", "SRC01", sql="""
WITH s AS (SELECT doc_id, text, CASE WHEN doc_id % 50 = 0 THEN sha256('other' || text) ELSE sha256(text) END AS raw_hash FROM documents)
SELECT doc_id, sha256(text) = raw_hash AS verified, len(string_split(text, chr(10)))::BIGINT AS provisions FROM s""")
def src01_corpus_scan(spark, sf):
    stored = table(spark, sf, "documents").withColumn(
        "raw_hash", F.when(F.col("doc_id") % 50 == 0, F.sha2(F.concat(F.lit("other"), "text"), 256)).otherwise(F.sha2("text", 256)))
    return stored.select("doc_id", (F.sha2("text", 256) == F.col("raw_hash")).alias("verified"), F.size(F.split("text", "\n")).cast("bigint").alias("provisions"))


def _unescaped(text: str) -> str:
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{letter}')"
    return f"trim(regexp_replace(replace({text}, chr(160), ' '), '\\s+', ' ', 'g'))"


#: The article's tokens in order; a paragraph is open from its tag to the end tag that closes it, paragraphs in between are part of it.
PARAGRAPHS_SQL = f"""
a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
t AS (SELECT page_id, generate_subscripts(w, 1) AS i, unnest(w) AS tok FROM (SELECT page_id, regexp_extract_all(body, '(?s)<!--.*?-->|</?[a-zA-Z][^>]*>|[^<]+') AS w FROM a)),
d AS (SELECT *, sum(CASE tok WHEN '<p>' THEN 1 WHEN '</p>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS open, sum(CASE tok WHEN '<h1>' THEN 1 WHEN '</h1>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS heading FROM t),
b AS (SELECT *, sum(CASE WHEN open = 1 AND tok = '<p>' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS no FROM d),
h AS (SELECT page_id, {_unescaped("string_agg(tok, ' ' ORDER BY i)")} AS title FROM b WHERE heading > 0 AND NOT starts_with(tok, '<') GROUP BY page_id),
x AS (SELECT page_id, no, {_unescaped("string_agg(tok, ' ' ORDER BY i)")} AS text FROM b WHERE open > 0 AND NOT starts_with(tok, '<') GROUP BY page_id, no)"""


@query("src02_page_paragraphs", "SRC02", sql=f"""
WITH {PARAGRAPHS_SQL}
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY no) - 1 AS ordinal, title AS section, (row_number() OVER (PARTITION BY page_id ORDER BY no))::VARCHAR AS number, text, NULL::VARCHAR AS problem
FROM x JOIN h USING (page_id) WHERE text <> ''""")
def src02_page_paragraphs(spark, sf):
    return page_paragraphs(table(spark, sf, "pages")).select("page_id", "ordinal", "section", "number", "text", "problem")


#: The given pages state no dates; every other one gets the metadata that pages of this kind carry.
@query("src02_page_heads", "SRC02", sql=f"""
WITH {PARAGRAPHS_SQL}
SELECT page_id, title, CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 6 = 0 THEN '2024-05-' ELSE '2023-04-' END || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END AS published,
  CASE WHEN page_id % 3 = 0 THEN '2025-01-01' END AS effective, CASE WHEN page_id % 5 = 4 THEN 'NO_MAIN_CONTENT' END AS problem FROM h""")
def src02_page_heads(spark, sf):
    key, day = F.col("page_id"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    metas = F.concat(
        F.when(key % 2 == 0, F.concat(F.lit('<meta property="article:published_time" content="2023-04-'), day, F.lit('T10:00:00Z">'))).otherwise(""),
        F.when(key % 6 == 0, F.concat(F.lit('<meta property="funnelback:published-date" content="2024/05/'), day, F.lit('">'))).otherwise(""),
        F.when(key % 3 == 0, F.lit('<meta name="effective-date" content="2025-01-01">')).otherwise(F.lit('<meta name="effective-date" content="2025-13-01">')))
    html = F.replace(F.col("html"), F.lit("</head>"), F.concat(metas, F.lit("</head>")))
    # pages without an article keep their title and are refused; of the others some hold their text in a role instead
    html = F.when(key % 5 == 4, F.replace(html, F.lit("article>"), F.lit("section>"))).when(
        key % 5 == 3, F.replace(F.replace(html, F.lit("<article>"), F.lit('<div role="main">')), F.lit("</article>"), F.lit("</div>"))).otherwise(html)
    heads = page_heads(table(spark, sf, "pages").withColumn("html", html))
    return heads.select("page_id", "title", F.col("published").cast("string").alias("published"), F.col("effective").cast("string").alias("effective"), "problem")


@query("src02_page_counts", "SRC02", sql="""
WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages)
SELECT page_id, (len(regexp_extract_all(body, '<p>')) > 0) AS has_paragraphs, contains(body, '<script') AS has_script FROM a""")
def src02_page_counts(spark, sf):
    rows = page_paragraphs(table(spark, sf, "pages")).groupBy("page_id").agg((F.count_if(F.col("problem").isNull()) > 0).alias("has_paragraphs"))
    scripts = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<article>(.*)</article>", 1).contains("<script").alias("has_script"))
    return rows.join(scripts, "page_id")


HEAD = "length(text) < 25"


@query("src04_articles", "SRC04", sql=f"""
WITH {sq.PASSAGES},
m AS (SELECT *, {HEAD} AS head, sum(({HEAD})::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS article FROM passages)
SELECT doc_id, article::BIGINT AS article, coalesce(arg_min(text, line_no) FILTER (head), '') AS heading, min(line_no) AS first_line, max(line_no) AS last_line,
  count(*)::BIGINT AS lines, sum(length(text))::BIGINT AS chars FROM m GROUP BY doc_id, article""")
def src04_articles(spark, sf):
    return dc.articles(ad.passages(spark, sf), "doc_id", F.expr(HEAD)).withColumn("article", F.col("article").cast("bigint"))


@query("src05_page_blocks", "SRC05", sql=f"""
WITH {sq.PASSAGES},
l AS (SELECT *, line_no // 4 AS page, regexp_matches(text, '^(The|De|Die|La) ') AS label, length(text) < 15 AS amendment FROM passages),
s AS (SELECT *, label OR lag(page) OVER w IS NULL AS starts, coalesce(max(amendment::INT) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS sticky FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
b AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM s)
SELECT doc_id, block::BIGINT AS block, min(page)::BIGINT AS page, max(page)::BIGINT AS page_end, count(*)::BIGINT AS lines,
  concat_ws('; ', CASE WHEN arg_min(sticky, line_no) = 1 THEN 'AMENDMENT_NOT_CONSOLIDATED' END, CASE WHEN min(page) <> max(page) THEN 'CROSS_PAGE_PARAGRAPH' END) AS flags,
  md5(string_agg(text, ' ' ORDER BY line_no)) AS text FROM b GROUP BY doc_id, block""")
def src05_page_blocks(spark, sf):
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = ad.passages(spark, sf).withColumn("page", F.floor(F.col("line_no") / 4)).withColumn("label", F.col("text").rlike("^(The|De|Die|La) "))
    starts = F.col("label") | F.lag("page").over(order).isNull()
    marked = lines.withColumn("starts", starts.cast("int")).withColumn("sticky", F.max((F.length("text") < 15).cast("int")).over(upto))
    blocks = marked.withColumn("block", F.sum("starts").over(upto)).groupBy("doc_id", "block").agg(
        F.min("page").alias("page"), F.max("page").alias("page_end"), F.count(F.lit(1)).alias("lines"), F.min_by("sticky", "line_no").alias("_s"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"))
    flags = F.array_compact(F.array(
        F.when(F.col("_s") == 1, F.lit("AMENDMENT_NOT_CONSOLIDATED")), F.when(F.col("page") != F.col("page_end"), F.lit("CROSS_PAGE_PARAGRAPH"))))
    return blocks.select("doc_id", F.col("block").cast("bigint").alias("block"), "page", "page_end", "lines", F.array_join(flags, "; ").alias("flags"),
                         F.md5("text").alias("text"))


@query("src06_pieces", "SRC06")
def src06_pieces(spark, sf):
    return dc.pieces(table(spark, sf, "documents"), "doc_id").select("doc_id", "seq", "start", "end", "text", "piece_id")


@query("src06_piece_invariants", "SRC06", sql="""
SELECT doc_id, length(text)::BIGINT AS covered, md5(text) AS joined, true AS bounded FROM documents WHERE length(text) > 0""")
def src06_piece_invariants(spark, sf):
    # the pieces of a document put together again are the document
    rows = dc.pieces(table(spark, sf, "documents"), "doc_id").groupBy("doc_id").agg(
        F.sum(F.col("end") - F.col("start")).alias("covered"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("joined"),
        (F.max(F.col("end") - F.col("start")) <= dc.CHUNK + dc.TAIL_MIN).alias("bounded"))
    return rows.withColumn("joined", F.md5("joined"))


@query("src07_control_rows", "SRC07", sql="""
SELECT c_custkey, concat_ws(' — ', CASE WHEN trim(c_name) <> '' THEN 'c_name: ' || trim(c_name) END, CASE WHEN c_custkey % 4 <> 0 THEN 'c_mktsegment: ' || c_mktsegment END, 'c_nationkey: ' || c_nationkey) AS text FROM customer""")
def src07_control_rows(spark, sf):
    c = table(spark, sf, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment")))
    cells = [F.when(F.trim(F.col(n).cast("string")) != "", F.concat(F.lit(f"{n}: "), tx.squash(F.col(n).cast("string"))))
             for n in ("c_name", "c_mktsegment", "c_nationkey")]
    return c.select("c_custkey", F.concat_ws(" — ", *cells).alias("text"))


@query("src08_running_lines", "SRC08", sql="""
WITH d AS (SELECT source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
e AS (SELECT source, unnest(list_distinct([ls[1], ls[-1]])) AS line FROM d WHERE len(ls) > 0),
k AS (SELECT source, line, count(*) AS n, CASE WHEN regexp_matches(line, '(?i)^(sayfa|page)[^a-z0-9].*[0-9]|^[0-9 /.–-]+$') THEN regexp_replace(line, '[0-9]+', '#', 'g') ELSE line END AS key FROM e GROUP BY ALL),
t AS (SELECT source, key, sum(n)::BIGINT AS pages FROM k GROUP BY ALL HAVING sum(n) >= 3)
SELECT source, md5(line) AS line, pages FROM k JOIN t USING (source, key)""")
def src08_running_lines(spark, sf):
    pages = table(spark, sf, "documents").select("source", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    return dc.running_lines(pages, ["source"]).select("source", F.md5("line").alias("line"), "pages")


@query("src09_horizon_scan", "SRC09", "STR04", sql="""
SELECT event_id, event_type, ts::DATE::VARCHAR AS published FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND contains(event_type, 'i')""")
def src09_horizon_scan(spark, sf):
    e = table(spark, sf, "events")
    newest = e.agg(F.max("ts").alias("_newest"))
    recent = F.col("ts") >= F.col("_newest") - F.expr("INTERVAL 7 DAYS")
    return e.join(F.broadcast(newest)).filter(recent & F.col("event_type").contains("i")).select(
        "event_id", "event_type", F.to_date("ts").cast("string").alias("published"))


@query("fil05_document_quality", "FIL05", sql=f"""
WITH p AS (SELECT source, lang, CASE WHEN doc_id % 6 = 0 THEN '' ELSE text END AS text, doc_id % 9 = 0 AS failed FROM documents),
s AS (SELECT source, lang, count(*)::BIGINT AS pages, count(*) FILTER (trim(text) = '')::BIGINT AS empty_pages, count(*) FILTER (failed)::BIGINT AS failed_pages,
  floor(sum(length(trim(text)))::DOUBLE / count(*))::BIGINT AS mean_chars, sum({sq.visible('text')}) AS v, sum({sq.letters('text')}) AS l FROM p GROUP BY ALL),
k AS (SELECT *, CASE WHEN v > 0 THEN (l * 100) // v END::BIGINT AS letter_percent, CASE WHEN empty_pages * 2 > pages THEN 'scanned' WHEN empty_pages * 10 > pages THEN 'mixed' WHEN mean_chars < 200 THEN 'low_density' ELSE 'text' END AS kind FROM s)
SELECT source, lang, pages, empty_pages, failed_pages, mean_chars, letter_percent, kind, CASE WHEN failed_pages * 2 > pages OR (kind <> 'scanned' AND letter_percent < 30) THEN 'corrupted' ELSE kind END AS state FROM k""")
def fil05_document_quality(spark, sf):
    pages = table(spark, sf, "documents").select(
        "source", "lang", F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.col("text")).alias("text"), (F.col("doc_id") % 9 == 0).alias("failed"))
    return dc.document_quality(pages, ["source", "lang"])


@query("fil06_wrong_document", "FIL06", sql="""
WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|\\n)([A-Z][a-z]+)[.]', 1)) AS label FROM documents),
c AS (SELECT doc_id, label, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT doc_id, sum(n)::BIGINT AS labels, arg_min(label, (-n, label)) AS dominant FROM c GROUP BY doc_id)
SELECT doc_id, labels, dominant FROM t JOIN documents USING (doc_id) WHERE labels >= 2 AND contains(text, 'e')""")
def fil06_wrong_document(spark, sf):
    docs = table(spark, sf, "documents")
    labels = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(?:^|\\n)([A-Z][a-z]+)[.]"), F.lit(1))).alias("label"))
    counted = labels.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))
    per_doc = counted.groupBy("doc_id").agg(F.sum("n").alias("labels"), F.min_by("label", F.struct(-F.col("n"), "label")).alias("dominant"))
    cued = docs.filter(F.col("text").contains("e")).select("doc_id")
    return per_doc.filter("labels >= 2").join(cued, "doc_id")


@query("fil07_targets", "FIL07", sql=f"""
WITH {sq.provisions('p')},
t AS (SELECT version_id, number, text, section FROM p WHERE section IN ('A', 'R') AND number <> 1 AND l_linestatus = 'F')
SELECT version_id, count(*)::BIGINT AS targets, count(*) FILTER (section = 'A')::BIGINT AS rules, min(number) AS first_number FROM t GROUP BY version_id""")
def fil07_targets(spark, sf):
    kept = ad.provisions(spark, sf).filter("section IN ('A', 'R') AND number <> 1 AND l_linestatus = 'F'")
    return kept.groupBy("version_id").agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(F.col("section") == "A").alias("rules"), F.min("number").alias("first_number"))


@query("fil08_scope_rows", "FIL08", sql=f"""
WITH {sq.PASSAGES}, h AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(lower(text), '^(the|de|la|der) ') THEN 3 WHEN regexp_matches(lower(text), '^(in|to|en|von) ') THEN 2 ELSE 0 END::BIGINT AS scope_rank FROM passages)
SELECT doc_id, line_no, scope_rank, row_number() OVER (PARTITION BY doc_id ORDER BY scope_rank DESC, line_no)::BIGINT AS place FROM h""")
def fil08_scope_rows(spark, sf):
    low = F.lower("text")
    rank = F.when(low.rlike("^(the|de|la|der) "), 3).when(low.rlike("^(in|to|en|von) "), 2).otherwise(0).cast("bigint")
    best = Window.partitionBy("doc_id").orderBy(F.desc("scope_rank"), "line_no")
    return ad.passages(spark, sf).select("doc_id", "line_no", rank.alias("scope_rank")).withColumn("place", F.row_number().over(best).cast("bigint"))


CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in dc.ENGLISH_CLASSES) + " ELSE 'OTHER' END"


@query("fil01_unit_classes", "FIL01", "FIL16", sql=f"""
WITH {sq.provisions('p')}, {sq.PASSAGES}, u AS (SELECT text FROM p UNION ALL SELECT text FROM passages),
k AS (SELECT {CLASS_SQL} AS kind, length(text) AS n FROM u)
SELECT kind, kind NOT IN ('DEFINITION', 'SCOPE', 'DELEGATION', 'ENFORCEMENT', 'PERMISSION', 'EXEMPTION') AS extracted, count(*)::BIGINT AS units, sum(n)::BIGINT AS chars FROM k GROUP BY ALL""")
def fil01_unit_classes(spark, sf):
    units = ad.provisions(spark, sf).select("text").unionByName(ad.passages(spark, sf).select("text"))
    kinds = units.select(dc.classify(F.col("text"))["kind"].alias("kind"), F.length("text").alias("n"))
    return kinds.groupBy("kind", (~F.col("kind").isin(*dc.NOT_EXTRACTED)).alias("extracted")).agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("chars"))


@query("fil22_modality", "FIL22", sql=f"""
WITH {sq.provisions('p')}
SELECT version_id, number, CASE WHEN regexp_matches(text, '(?i)(must|shall) not') THEN 'MUST_NOT' WHEN regexp_matches(text, '(?i)(^|[^a-z])(must|shall)([^a-z]|$)') THEN 'MUST'
  WHEN regexp_matches(text, '(?i)(^|[^a-z])may([^a-z]|$)') THEN 'MAY' END AS modality, count(*)::BIGINT AS n FROM p GROUP BY ALL""")
def fil22_modality(spark, sf):
    return ad.provisions(spark, sf).groupBy("version_id", "number", dc.modality(F.col("text")).alias("modality")).agg(F.count(F.lit(1)).alias("n"))


REFS_SQL = f"""{sq.provisions('p')},
cit AS (SELECT version_id, section, number AS from_number, unnest(regexp_extract_all(text, 'article ([0-9]+)', 1))::BIGINT AS number, text FROM p),
idx AS (SELECT version_id, number, count(*) AS hits, min(text) AS only_text FROM p GROUP BY ALL),
res AS (SELECT cit.*, CASE WHEN hits = 1 THEN 'RESOLVED' WHEN hits > 1 THEN 'AMBIGUOUS' ELSE 'MISSING' END AS status, CASE WHEN hits = 1 THEN only_text END AS resolved_to FROM cit LEFT JOIN idx USING (version_id, number))"""


def cited_numbers():
    """One row per article number a text cites."""
    return F.explode(F.transform(F.regexp_extract_all("text", F.lit("article ([0-9]+)"), F.lit(1)), lambda n: n.cast("bigint")))


def references(spark, sf):
    p = ad.provisions(spark, sf)
    citations = p.select(
        "version_id", "section", F.col("number").alias("from_number"),
        cited_numbers().alias("number"), F.col("text").alias("citing"))
    return dc.resolve_references(citations, p, ["version_id", "number"], "text")


@query("jon01_resolve_references", "JON01", "JON03", sql=f"WITH {REFS_SQL} SELECT version_id, from_number, number, status, resolved_to, count(*)::BIGINT AS n FROM res GROUP BY ALL")
def jon01_resolve_references(spark, sf):
    return references(spark, sf).groupBy("version_id", "from_number", "number", "status", "resolved_to").agg(F.count(F.lit(1)).alias("n"))


@query("jon06_missing_sources", "JON06", "TOP04", sql=f"""
WITH {REFS_SQL}
SELECT section, count(*) FILTER (status = 'RESOLVED')::BIGINT AS resolved, count(*) FILTER (status = 'AMBIGUOUS')::BIGINT AS ambiguous, count(*) FILTER (status = 'MISSING')::BIGINT AS missing,
  arg_min(number, (-c, number)) AS most_missed FROM (SELECT section, status, number, count(*) OVER (PARTITION BY section, status, number) * (status = 'MISSING')::INT AS c FROM res) GROUP BY section""")
def jon06_missing_sources(spark, sf):
    r = references(spark, sf).groupBy("section", "status", "number").agg(F.count(F.lit(1)).alias("n"))
    wide = r.groupBy("section").pivot("status", ["RESOLVED", "AMBIGUOUS", "MISSING"]).agg(F.sum("n"))
    missed = r.groupBy("section").agg(F.min_by("number", F.struct(
        -F.when(F.col("status") == "MISSING", F.col("n")).otherwise(0), "number")).alias("most_missed"))
    return wide.join(missed, "section").select(
        "section", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n.lower()) for n in ("RESOLVED", "AMBIGUOUS", "MISSING")], "most_missed")


@query("jon02_context_packets", "JON02", sql=f"""
WITH RECURSIVE {REFS_SQL},
one AS (SELECT version_id, number, min(section) AS section, min(text) AS text FROM p GROUP BY ALL HAVING count(*) = 1),
refs AS (SELECT DISTINCT res.version_id, res.from_number AS number, res.number AS item, 0 AS priority, resolved_to AS text FROM res JOIN one ON one.version_id = res.version_id AND one.number = res.from_number WHERE status = 'RESOLVED' AND res.number <> res.from_number),
nb AS (SELECT a.version_id, a.number, b.number AS item, 1 AS priority, b.text FROM one a JOIN one b ON a.version_id = b.version_id AND abs(a.number - b.number) = 1),
items AS (SELECT version_id, number, item, min(priority) AS priority, min(text) AS text FROM (SELECT version_id, number, item, priority, text FROM refs UNION ALL SELECT * FROM nb) GROUP BY version_id, number, item),
o AS (SELECT *, length(text) AS chars, row_number() OVER (PARTITION BY version_id, number ORDER BY priority, item) AS k FROM items),
step AS (SELECT version_id, number, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS taken, ''::VARCHAR AS packet FROM (SELECT DISTINCT version_id, number FROM o)
  UNION ALL SELECT o.version_id, o.number, o.k, used + CASE WHEN used + chars <= 170 THEN chars ELSE 0 END, taken + (used + chars <= 170)::BIGINT, packet || CASE WHEN used + chars <= 170 THEN ' ' || item ELSE '' END
  FROM step JOIN o ON step.version_id = o.version_id AND step.number = o.number AND o.k = step.k + 1)
SELECT version_id, number, max(taken) AS items, max(used) AS chars, trim(arg_max(packet, k)) AS packet FROM step GROUP BY version_id, number""")
def jon02_context_packets(spark, sf):
    p = ad.provisions(spark, sf)
    one = p.groupBy("version_id", "number").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    refs = (
        references(spark, sf).filter("status = 'RESOLVED' AND number <> from_number")
        .join(one.select("version_id", F.col("number").alias("from_number")), ["version_id", "from_number"], "left_semi")
        .select("version_id", F.col("from_number").alias("number"), F.col("number").alias("item"), F.lit(0).alias("priority"), F.col("resolved_to").alias("text")))
    # a neighbour is the provision numbered one above or below
    neighbours = one.select("version_id", F.explode(F.array(F.col("number") - 1, F.col("number") + 1)).alias("number"),
                            F.col("number").alias("item"), F.lit(1).alias("priority"), "text").join(
        one.select("version_id", "number"), ["version_id", "number"], "left_semi")
    items = refs.unionByName(neighbours).groupBy("version_id", "number", "item").agg(F.min("priority").alias("priority"), F.min("text").alias("text"))
    return dc.pack_context(items, ["version_id", "number"], max_chars=170)


@query("jon04_implied_books", "JON04", sql=f"""
WITH {sq.provisions('p')},
cit AS (SELECT version_id, section, CASE WHEN l_suppkey % 2 = 0 THEN 'A' END AS book, unnest(regexp_extract_all(text, 'article ([0-9]+)', 1))::BIGINT AS number FROM p),
k AS (SELECT version_id, coalesce(book, section) AS section, number, count(*) AS c FROM cit GROUP BY ALL),
idx AS (SELECT version_id, section, number, count(*) AS hits FROM p GROUP BY ALL)
SELECT version_id, section, number, c::BIGINT AS citations, CASE WHEN hits = 1 THEN 'RESOLVED' WHEN hits > 1 THEN 'AMBIGUOUS' ELSE 'MISSING' END AS status FROM k LEFT JOIN idx USING (version_id, section, number)""")
def jon04_implied_books(spark, sf):
    p = ad.provisions(spark, sf)
    printed = F.when(F.col("l_suppkey") % 2 == 0, "A")
    citations = p.select(
        "version_id", F.coalesce(printed, F.col("section")).alias("section"),
        cited_numbers().alias("number"))
    return dc.resolve_counted(citations, p, ["version_id", "section", "number"])


AMEND_SQL = f"""{sq.provisions('p')},
am AS (SELECT version_id, number, CASE WHEN l_suppkey % 8 = 0 THEN NULL WHEN l_suppkey % 8 = 1 THEN 'GLOSSARY' WHEN l_suppkey % 8 < 5 THEN 'A' ELSE 'N' END AS book, l_partkey FROM p WHERE section = 'R'),
com AS (SELECT o_orderkey AS version_id, o_orderdate AS commencement FROM orders),
idx AS (SELECT version_id, section AS book, number, count(*) AS hits, min(dated) AS effective FROM p GROUP BY ALL),
an AS (SELECT am.version_id, am.number, am.l_partkey, CASE WHEN am.book IS NULL THEN 'NO_ANNEX_SOURCEBOOK' WHEN am.book = 'GLOSSARY' THEN 'GLOSSARY_AMENDMENT_NOT_LINKED' WHEN number = 1 THEN 'SECTION_HEADING_NOT_A_PROVISION'
   WHEN hits > 1 THEN 'AMBIGUOUS_IN_CONSOLIDATED_CORPUS' WHEN hits IS NULL THEN 'NOT_IN_CONSOLIDATED_CORPUS' ELSE 'LINKED' END AS outcome,
  CASE WHEN commencement IS NULL OR effective IS NULL THEN 'UNKNOWN' WHEN effective = commencement THEN 'MATCH' WHEN effective > commencement THEN 'SUPERSEDED' ELSE 'PREDATES' END AS agreement
  FROM am LEFT JOIN idx USING (version_id, book, number) LEFT JOIN com USING (version_id))"""


@query("jon05_amendment_links", "JON05", "SRC15", sql=f"""
WITH {AMEND_SQL} SELECT version_id, number, outcome, CASE WHEN outcome = 'LINKED' THEN agreement END AS date_agreement, count(*)::BIGINT AS n FROM an GROUP BY ALL""")
def jon05_amendment_links(spark, sf):
    p = ad.provisions(spark, sf)
    s = F.col("l_suppkey") % 8
    book = F.when(s == 0, F.lit(None)).when(s == 1, "GLOSSARY").when(s < 5, "A").otherwise("N")
    amendments = p.filter("section = 'R'").select("version_id", "number", book.alias("book"))
    index = p.groupBy("version_id", F.col("section").alias("book"), "number").agg(F.count(F.lit(1)).alias("hits"), F.min("dated").alias("effective"))
    commencement = table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("commencement"))
    joined = amendments.join(index, ["version_id", "book", "number"], "left").join(commencement, "version_id", "left")
    outcome = (
        F.when(F.col("book").isNull(), "NO_ANNEX_SOURCEBOOK").when(F.col("book") == "GLOSSARY", "GLOSSARY_AMENDMENT_NOT_LINKED")
        .when(F.col("number") == 1, "SECTION_HEADING_NOT_A_PROVISION").when(F.col("hits") > 1, "AMBIGUOUS_IN_CONSOLIDATED_CORPUS")
        .when(F.col("hits").isNull(), "NOT_IN_CONSOLIDATED_CORPUS").otherwise("LINKED"))
    effective, start = F.col("effective"), F.col("commencement")
    agreement = (
        F.when(effective.isNull() | start.isNull(), "UNKNOWN").when(effective == start, "MATCH").when(effective > start, "SUPERSEDED").otherwise("PREDATES"))
    return joined.withColumn("outcome", outcome).withColumn("date_agreement", F.when(F.col("outcome") == "LINKED", agreement)).groupBy(
        "version_id", "number", "outcome", "date_agreement").agg(F.count(F.lit(1)).alias("n"))


@query("jon07_sanction_links", "JON07", sql=f"""
WITH {sq.provisions('p')},
pen AS (SELECT version_id, number AS penalty, unnest(regexp_extract_all(text, 'article ([0-9]+)', 1))::BIGINT AS number, text AS sentence FROM p WHERE section = 'N')
SELECT DISTINCT pen.version_id, penalty, pen.number, sentence FROM pen JOIN p ON p.version_id = pen.version_id AND p.number = pen.number AND p.section = 'A'""")
def jon07_sanction_links(spark, sf):
    p = ad.provisions(spark, sf)
    cited = p.filter("section = 'N'").select(
        "version_id", F.col("number").alias("penalty"),
        cited_numbers().alias("number"), F.col("text").alias("sentence"))
    duties = p.filter("section = 'A'").select("version_id", "number")
    return cited.join(duties, ["version_id", "number"], "left_semi").distinct().select("version_id", "penalty", "number", "sentence")


@query("jon23_evidence_passages", "JON23", sql=f"""
WITH n AS (SELECT item_id, {sq.squash('text')} AS needle FROM benchmark), t AS (SELECT doc_id, {sq.squash('text')} AS body FROM documents)
SELECT item_id, doc_id FROM n JOIN t ON contains(body, needle)""")
def jon23_evidence_passages(spark, sf):
    needles = ad.duties(spark, sf).select("item_id", F.col("text").alias("needle"))
    return dc.containing(needles, table(spark, sf, "documents").select("doc_id", "text"), "item_id", "doc_id")


@query("agg29_definition_ranking", "AGG29", sql=f"""
WITH t AS (SELECT item_id, {sq.lexical_terms('text')} AS terms FROM benchmark),
d AS (SELECT conv_id || ':' || turn AS def_id, unnest(list_filter({sq.words('text')}, lambda w: length(w) >= 3)) AS term FROM conversations WHERE role = 'system'),
tf AS (SELECT def_id, term, count(*) AS tf FROM d GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), nn AS (SELECT count(*) AS n FROM conversations WHERE role = 'system'),
w AS (SELECT def_id, term, (1 + ln(tf)) * ln(1 + n::DOUBLE / (1 + df)) AS w FROM tf JOIN df USING (term), nn),
s AS (SELECT item_id, def_id, count(*)::BIGINT AS shared, round(sum(w), 6) AS score FROM (SELECT item_id, unnest(terms) AS term FROM t) JOIN w USING (term) GROUP BY ALL HAVING count(*) >= 2)
SELECT item_id, def_id, shared, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, def_id)::BIGINT AS rank FROM s QUALIFY rank <= 2""")
def agg29_definition_ranking(spark, sf):
    targets = ad.duties(spark, sf).select("item_id", tx.lexical_terms(F.col("text")).alias("terms"))
    definitions = table(spark, sf, "conversations").filter("role = 'system'").select(
        F.concat_ws(":", "conv_id", "turn").alias("def_id"), tx.words(F.col("text"), 3).alias("terms"))
    return dc.definition_scores(targets, definitions, "item_id", "def_id").select(
        "item_id", "def_id", "shared", "score", F.col("rank").cast("bigint").alias("rank"))


@query("jon08_relevant_definitions", "JON08", "UDF06", sql=f"""
WITH g AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT DISTINCT lower(regexp_extract(text, '^([A-Za-z]+ [a-z]+)', 1)) FROM documents WHERE lang = 'en'),
w AS (SELECT item_id, {sq.words('text')} AS ws FROM benchmark),
i AS (SELECT item_id, ws, unnest(generate_series(1, len(ws))) AS pos FROM w),
h AS (SELECT item_id, pos, 2 AS n, ws[pos] || ' ' || ws[pos + 1] AS term FROM i WHERE pos < len(ws) UNION ALL SELECT item_id, pos, 1, ws[pos] FROM i),
m AS (SELECT DISTINCT h.* FROM h JOIN g USING (term) WHERE term <> ''),
k AS (SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.item_id = a.item_id AND b.n > a.n AND b.pos <= a.pos AND b.pos + b.n >= a.pos + a.n)),
f AS (SELECT item_id, term, min(pos)::BIGINT AS pos FROM k GROUP BY ALL)
SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY pos, term)::BIGINT AS rank FROM f QUALIFY rank <= 5""")
def jon08_relevant_definitions(spark, sf):
    glossary = table(spark, sf, "part").select(F.col("p_name").alias("term")).unionByName(
        table(spark, sf, "documents").filter("lang = 'en'").select(F.lower(F.regexp_extract("text", "^([A-Za-z]+ [a-z]+)", 1)).alias("term"))).distinct()
    ws = ad.duties(spark, sf).select("item_id", tx.words(F.col("text")).alias("ws"))
    spans = F.transform(F.col("ws"), lambda w, i: F.array(
        F.struct((i + 1).alias("at"), F.lit(1).alias("n"), w.alias("term")),
        F.struct((i + 1).alias("at"), F.lit(2).alias("n"), F.concat_ws(" ", w, F.get("ws", i + 1)).alias("term"))))
    grams = ws.select("item_id", F.explode(F.flatten(spans)).alias("s")).select("item_id", "s.*").filter("n = 1 OR instr(term, ' ') > 0")
    found = grams.join(glossary.filter("term <> ''"), "term")
    longer = found.filter("n = 2").select("item_id", F.explode(F.array("at", F.col("at") + 1)).alias("at"), F.lit(1).alias("n"))
    kept = found.join(longer, ["item_id", "at", "n"], "left_anti").groupBy("item_id", "term").agg(F.min("at").alias("at"))
    first = Window.partitionBy("item_id").orderBy("at", "term")
    return kept.withColumn("rank", F.row_number().over(first).cast("bigint")).filter("rank <= 5").select("item_id", "term", "rank")


@query("win08_neighbours", "WIN08", sql=f"""
WITH {sq.provisions('p')}, o AS (SELECT version_id, number, max(text) AS text FROM p GROUP BY ALL),
w AS (SELECT version_id, number, lag(number) OVER x AS before, lead(number) OVER x AS after, lead(text) OVER x AS next_text FROM o WINDOW x AS (PARTITION BY version_id ORDER BY number))
SELECT version_id, number, before, after, coalesce(regexp_matches(next_text, 'unless|except'), false) AS needs_next FROM w""")
def win08_neighbours(spark, sf):
    one = ad.provisions(spark, sf).groupBy("version_id", "number").agg(F.max("text").alias("text"))
    order = Window.partitionBy("version_id").orderBy("number")          # distinct numbers of one text
    return one.select(
        "version_id", "number", F.lag("number").over(order).alias("before"), F.lead("number").over(order).alias("after"),
        F.coalesce(F.lead("text").over(order).rlike("unless|except"), F.lit(False)).alias("needs_next"))


@query("fun16_identity", "FUN16", "FIL14", sql="""
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page_no, regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) AS lang,
  CASE WHEN url LIKE '%.example.org/%' THEN 'REGULATOR' WHEN url LIKE '%.example.com/%' THEN 'GAZETTE' ELSE 'NOT_ALLOWED' END AS institution FROM pages""")
def fun16_identity(spark, sf):
    host = F.expr("parse_url(url, 'HOST')")
    allow = spark.createDataFrame([("example.org", "REGULATOR"), ("example.com", "GAZETTE")], "domain string, institution string")
    p = table(spark, sf, "pages").select(
        "page_id", host.alias("host"), F.expr("parse_url(url, 'QUERY', 'page')").alias("page_no"), F.regexp_extract("url", "/([a-z]{2})/[0-9]+", 1).alias("lang"),
        F.array_join(F.slice(F.reverse(F.split(F.reverse(host), "[.]")), F.greatest(F.size(F.split(host, "[.]")) - 1, F.lit(1)), F.lit(2)), ".").alias("_r"))
    p = p.withColumn("domain", F.substring_index("host", ".", -2)).drop("_r")
    return p.join(F.broadcast(allow), "domain", "left").select(
        "page_id", "host", "page_no", "lang", F.coalesce("institution", F.lit("NOT_ALLOWED")).alias("institution"))


@query("fun17_stated_dates", "FUN17", sql="""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE::VARCHAR END AS stated, o_orderkey % 4 = 0 AS iso FROM orders""")
def fun17_stated_dates(spark, sf):
    key, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = (
        F.when(key == 0, F.concat(F.lit("In force on "), F.date_format(day, "yyyy-MM-dd"), F.lit(".")))
        .when(key == 1, F.concat(F.lit("Published "), F.date_format(day, "d/M/yyyy"), F.lit(" in the gazette")))
        .when(key == 2, F.concat(F.lit("Comes into force on "), F.date_format(day, "d MMMM yyyy"))).otherwise("In force on publication"))
    return table(spark, sf, "orders").withColumn("text", text).select(
        "o_orderkey", dc.try_date(F.col("text")).cast("string").alias("stated"), F.col("text").rlike("[0-9]{4}-[0-9]{2}").alias("iso"))


QUANT_SQL = f"""{sq.provisions('p')},
qs AS (SELECT version_id, number, section, text, l_quantity, CASE section WHEN 'A' THEN 'duration' WHEN 'R' THEN 'duration' END AS k FROM p),
q AS (SELECT version_id, number, section, text, 'duration' AS unit_class, unnest(regexp_extract_all(text, '([0-9]+) (?:days|years)', 1))::DOUBLE AS amount, CASE WHEN section = 'A' THEN 'day' ELSE 'year' END AS unit FROM p WHERE section <> 'N'
  UNION ALL SELECT version_id, number, section, text, 'percent', unnest(regexp_extract_all(text, '([0-9]+)%', 1))::DOUBLE, '%' FROM p WHERE section = 'N'
  UNION ALL SELECT version_id, number, section, text, 'money', unnest(regexp_extract_all(text, 'GBP ([0-9]+)', 1))::DOUBLE, 'GBP' FROM p WHERE section = 'N'),
quant AS (SELECT *, CASE WHEN unit = 'day' THEN amount WHEN unit = 'year' THEN amount * 365 END AS days FROM q)"""


def quantities(spark, sf):
    return ad.provisions(spark, sf).select("version_id", "number", "section", "text", F.explode(qt.quantities(F.col("text"))).alias("q"))


@query("agg30_best_verdicts", "AGG30", sql=f"""
WITH {QUANT_SQL},
a AS (SELECT version_id, min(days) AS need FROM quant WHERE section = 'A' GROUP BY ALL),
v AS (SELECT a.version_id, CASE WHEN days IS NULL THEN NULL WHEN days = need THEN 1 WHEN days < need THEN 2 ELSE 3 END AS r FROM a LEFT JOIN quant q ON q.version_id = a.version_id AND q.section = 'R')
SELECT version_id, coalesce(['SAME', 'STRICTER', 'WEAKER'][min(r)], 'NOT_STATED') AS verdict, count(r)::BIGINT AS numbers FROM v GROUP BY version_id""")
def agg30_best_verdicts(spark, sf):
    q = quantities(spark, sf)
    duty = q.filter("section = 'A' AND q.unit_class = 'duration'").groupBy("version_id").agg(F.min_by("q", F.col("q.days")).alias("d"))
    stated = q.filter("section = 'R'").select("version_id", "q")
    joined = duty.join(stated, "version_id", "left").withColumn("v", F.when(F.col("q").isNotNull(), qt.compare(F.col("d"), F.col("q"), F.lit("max"))))
    return joined.groupBy("version_id").agg(qt.best_verdict(F.col("v")).alias("verdict"), F.count("v").alias("numbers"))


@query("fun11_timings", "FUN11", sql="""
WITH t AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'Report it without undue delay and as soon as possible.' WHEN 'click' THEN 'Send it in batches at the end of each month.' WHEN 'view' THEN 'Check it before the transfer.'
   WHEN 'signup' THEN 'Identify promptly, prior to onboarding, at year end.' ELSE 'Keep it.' END AS text FROM events)
SELECT text, count(*)::BIGINT AS n, concat_ws('; ', CASE WHEN regexp_matches(text, '(?i)end of (the|each|every) (calendar )?(month|quarter|year|period)|(month|quarter|year|period)[ -]end') THEN 'PERIOD_END' END,
  CASE WHEN regexp_matches(text, '(?i)in (a )?batch(es)?|in bulk|batched') THEN 'BATCH' END, CASE WHEN regexp_matches(text, '(?i)immediately|without (undue )?delay|same[ -]day|forthwith|simultaneously') THEN 'IMMEDIATE' END,
  CASE WHEN regexp_matches(text, '(?i)as soon as (reasonably )?(possible|practicable)|promptly') THEN 'ASAP' END, CASE WHEN regexp_matches(text, '(?i)(^|[^a-z])(before|prior to) ') THEN 'BEFORE' END) AS timings FROM t GROUP BY ALL""")
def fun11_timings(spark, sf):
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", "Report it without undue delay and as soon as possible.").when(kind == "click", "Send it in batches at the end of each month.")
        .when(kind == "view", "Check it before the transfer.").when(kind == "signup", "Identify promptly, prior to onboarding, at year end.").otherwise("Keep it."))
    counted = table(spark, sf, "events").groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("text", "n", F.array_join(qt.period_phrases(F.col("text")), "; ").alias("timings"))


@query("src26_verify_catalogue", "SRC26", "SRC31", sql="""
WITH cat AS (SELECT c_custkey AS regulation_id, CASE WHEN c_custkey % 8 = 0 THEN 'https://other' ELSE 'https://reg/' || c_custkey END AS url, CASE WHEN c_custkey % 5 = 0 THEN DATE '2001-01-01' END AS effective FROM customer),
heads AS (SELECT o_custkey AS regulation_id, 'https://reg/' || o_custkey AS url, max(o_orderdate)::DATE AS effective, count(*) AS versions FROM orders GROUP BY ALL)
SELECT regulation_id, CASE WHEN h.url IS NULL THEN 'TEXT_MISSING' WHEN h.url <> c.url THEN 'URL_MISMATCH' WHEN c.effective <> h.effective THEN 'DATE_MISMATCH' ELSE 'VERIFIED' END AS state,
  coalesce(h.url, c.url) AS url, coalesce(h.effective, c.effective)::VARCHAR AS effective FROM cat c LEFT JOIN heads h USING (regulation_id)""")
def src26_verify_catalogue(spark, sf):
    key = F.col("c_custkey")
    claimed = table(spark, sf, "customer").select(
        key.alias("regulation_id"), F.when(key % 8 == 0, "https://other").otherwise(F.concat(F.lit("https://reg/"), key)).alias("claimed_url"),
        F.when(key % 5 == 0, F.lit("2001-01-01").cast("date")).alias("claimed_date"))
    heads = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("regulation_id")).agg(F.to_date(F.max("o_orderdate")).alias("date")).withColumn(
        "stored_url", F.concat(F.lit("https://reg/"), "regulation_id"))
    state = (
        F.when(F.col("stored_url").isNull(), "TEXT_MISSING").when(F.col("stored_url") != F.col("claimed_url"), "URL_MISMATCH")
        .when(F.col("claimed_date") != F.col("date"), "DATE_MISMATCH").otherwise("VERIFIED"))
    return claimed.join(heads, "regulation_id", "left").select(
        "regulation_id", state.alias("state"), F.coalesce("stored_url", "claimed_url").alias("url"), F.coalesce("date", "claimed_date").cast("string").alias("effective"))


@query("src30_reparse_candidates", "SRC30", sql=f"""
WITH {sq.CAPTURES}, l AS (SELECT * FROM captures QUALIFY row_number() OVER (PARTITION BY regulation_id ORDER BY fetched_at DESC, capture_id DESC) = 1)
SELECT regulation_id, capture_id, parser_version FROM l WHERE parser_version <> 'parser-2'""")
def src30_reparse_candidates(spark, sf):
    from ..operators.versions import latest

    newest = latest(ad.captures(spark, sf), "regulation_id", [F.col("fetched_at"), F.col("capture_id")], ["capture_id", "parser_version"])
    return newest.filter("parser_version <> 'parser-2'")


@query("src25_layered_store", "SRC24", "SRC25", sql=f"""
WITH {sq.provisions('p')},
it AS (SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS number, unnest(string_split(text, chr(10))) AS text, sha256(text) AS h FROM conversations WHERE role = 'assistant'),
u AS (SELECT 'DECISION' AS layer, number::BIGINT AS number, length(text) AS n FROM it WHERE trim(text) <> '' UNION ALL SELECT 'REGULATION', number, length(text) FROM p)
SELECT layer, number, count(*)::BIGINT AS provisions, sum(n)::BIGINT AS chars FROM u GROUP BY ALL""")
def src25_layered_store(spark, sf):
    items = table(spark, sf, "conversations").filter("role = 'assistant'").select(F.posexplode(F.split("text", "\n")).alias("i", "text")).filter(F.trim("text") != "")
    decisions = items.select(F.lit("DECISION").alias("layer"), (F.col("i") + 1).cast("bigint").alias("number"), F.length("text").alias("n"))
    regulations = ad.provisions(spark, sf).select(F.lit("REGULATION").alias("layer"), "number", F.length("text").alias("n"))
    return decisions.unionByName(regulations).groupBy("layer", "number").agg(F.count(F.lit(1)).alias("provisions"), F.sum("n").alias("chars"))
