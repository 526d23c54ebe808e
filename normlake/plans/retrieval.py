"""Retrieval queries: which statements answer a duty, in what order, and is the duty covered."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import coverage as cv
from ..operators import retrieval as rt
from ..sources.tables import table
from . import adapters as ad
from . import sqltext as sq
from .registry import query

SUPPORT_SHARE, PARTIAL_SHARE = 0.9, 0.5

LEXICAL_PAIRS_SQL = f"""{sq.PASSAGES},
p AS (SELECT doc_id || ':' || line_no AS passage_id, {sq.lexical_terms('text')} AS terms FROM passages),
d AS (SELECT item_id, {sq.lexical_terms('text')} AS terms FROM benchmark),
dt AS (SELECT item_id, len(terms) AS n, unnest(terms) AS term FROM d),
pt AS (SELECT passage_id, unnest(terms) AS term FROM p),
pairs AS (SELECT item_id, passage_id, count(*) AS shared, max(n) AS n_terms FROM dt JOIN pt USING (term)
          GROUP BY ALL HAVING count(*) >= max(n) * {PARTIAL_SHARE})"""


def lexical_pairs(spark, sf):
    p = ad.passages(spark, sf).select(F.concat_ws(":", "doc_id", "line_no").alias("passage_id"), "text")
    d = ad.duties(spark, sf).select("item_id", tx.lexical_terms(F.col("text")).alias("terms"))
    return rt.containment_pairs(d, p, "item_id", "passage_id", PARTIAL_SHARE, tx.lexical_terms)


@query("duty_coverage", "JON17", "AGG01", "TOP03", sql=f"""
WITH {LEXICAL_PAIRS_SQL},
r AS (SELECT *, CASE WHEN shared >= n_terms * {SUPPORT_SHARE} THEN 'SUPPORTS' ELSE 'PARTIAL' END AS relation,
             row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, passage_id) AS rn FROM pairs),
c AS (SELECT item_id, count(*) FILTER (relation = 'SUPPORTS') AS supports, count(*) FILTER (relation = 'PARTIAL') AS partial,
             string_agg(passage_id, '; ' ORDER BY rn) FILTER (rn <= 3) AS statements FROM r GROUP BY item_id)
SELECT b.item_id, coalesce(supports, 0)::BIGINT AS supports, coalesce(partial, 0)::BIGINT AS partial,
       CASE WHEN supports > 0 THEN 'COVERS_TEXT' WHEN partial > 0 THEN 'PARTIAL' ELSE 'NO_EVIDENCE' END AS coverage,
       coalesce(statements, '') AS statements
FROM benchmark b LEFT JOIN c USING (item_id)""")
def duty_coverage(spark, sf):
    pairs = lexical_pairs(spark, sf)
    readings = pairs.withColumn(
        "relation", F.when(F.col("shared") >= F.col("n_terms") * SUPPORT_SHARE, "SUPPORTS").otherwise("PARTIAL")
    ).withColumn("is_control", F.lit(False))
    counted = cv.counted_coverage(readings, ["item_id"]).select("item_id", "supports", "partial", "coverage")
    best = Window.partitionBy("item_id").orderBy(F.desc("shared"), "passage_id")
    top = (
        pairs.withColumn("rn", F.row_number().over(best)).filter("rn <= 3").groupBy("item_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "passage_id"))), lambda x: x["passage_id"]), "; ")
             .alias("statements"))
    )
    return (
        ad.duties(spark, sf).select("item_id").join(counted, "item_id", "left").join(top, "item_id", "left")
        .select("item_id", F.coalesce("supports", F.lit(0)).cast("bigint").alias("supports"),
                F.coalesce("partial", F.lit(0)).cast("bigint").alias("partial"),
                F.coalesce("coverage", F.lit("NO_EVIDENCE")).alias("coverage"),
                F.coalesce("statements", F.lit("")).alias("statements"))
    )


@query("fun01_fold", "FUN01", sql=f"""
SELECT doc_id, md5({sq.fold('text')}) AS folded, (length({sq.fold('text')}) = length(text)) AS same_length FROM documents""")
def fun01_fold(spark, sf):
    folded = tx.fold(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(folded).alias("folded"), (F.length(folded) == F.length("text")).alias("same_length"))


@query("fun02_squash", "FUN02", sql=f"""
SELECT doc_id, md5({sq.squash('text')}) AS squashed, {sq.word_count('text')}::BIGINT AS n_words FROM documents""")
def fun02_squash(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.squash(F.col("text"))).alias("squashed"), tx.word_count(F.col("text")).cast("bigint").alias("n_words"))


@query("fun03_stems", "FUN03", sql=f"""
SELECT doc_id, len({sq.stems('text')})::BIGINT AS n_stems, md5(array_to_string(list_sort({sq.stems('text')}), ' ')) AS stems
FROM documents""")
def fun03_stems(spark, sf):
    stems = tx.stems(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(stems).cast("bigint").alias("n_stems"), F.md5(F.array_join(F.array_sort(stems), " ")).alias("stems"))


@query("fun04_containment", "FUN04", sql=f"""
WITH t AS (SELECT conv_id, turn, {sq.stems('text')} AS s FROM conversations)
SELECT a.conv_id, a.turn, len(list_intersect(a.s, b.s))::BIGINT AS shared,
       coalesce({sq.ratio4('len(list_intersect(a.s, b.s))', 'len(a.s)')}, 0.0) AS in_answer,
       coalesce({sq.ratio4('len(list_intersect(a.s, b.s))', 'len(b.s)')}, 0.0) AS in_question
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def fun04_containment(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", tx.stems(F.col("text")).alias("s"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("t"))
    a, b = F.col("s"), F.col("t")
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", tx.shared(a, b).cast("bigint").alias("shared"),
        F.bround(tx.containment(a, b), 4).alias("in_answer"), F.bround(tx.containment(b, a), 4).alias("in_question"))


GRAMS_SQL = """
{name}_clean AS (SELECT {key}, ' ' || trim(regexp_replace(lower(translate(text, 'İI', 'iı')), '[^0-9a-zß-öø-ÿœğışâîû%]+', ' ', 'g')) || ' ' AS x
                 FROM {source}),
{name}_raw AS (
  SELECT {key}, substring(x, i, n) AS gram, count(*) AS c
  FROM (SELECT {key}, x, n, unnest(generate_series(1, length(x) - n + 1)) AS i
        FROM {name}_clean, (VALUES (3), (4), (5)) AS g(n) WHERE length(x) >= n) GROUP BY ALL),
{name} AS (SELECT {key}, gram, (1 + ln(c)) / sqrt(sum((1 + ln(c)) * (1 + ln(c))) OVER (PARTITION BY {key})) AS w FROM {name}_raw)"""


@query("fun05_gram_similarity", "FUN05", sql=f"""
WITH {GRAMS_SQL.format(name='a', key='item_id', source='benchmark')},
{GRAMS_SQL.format(name='b', key='turn_id', source="(SELECT conv_id || ':' || turn AS turn_id, text FROM conversations)")}
SELECT item_id, turn_id, round_even(sum(a.w * b.w), 4) AS similarity FROM a JOIN b USING (gram)
GROUP BY ALL HAVING round_even(sum(a.w * b.w), 4) >= {rt.LEXICAL_FLOOR}""")
def fun05_gram_similarity(spark, sf):
    turns = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text")
    return rt.gram_similarity(ad.duties(spark, sf), turns, "item_id", "turn_id", rt.LEXICAL_FLOOR)


@query("fun06_cosine", "FUN06", sql="""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id, round(sqrt(list_dot_product(a.e, a.e)), 4) AS norm,
       round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 4) AS cosine
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def fun06_cosine(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding", rt.unit(F.col("embedding")).alias("u"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("w"))
    return v.join(after, "vec_id").select(
        "vec_id", F.round(F.sqrt(rt.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"),
        F.round(rt.dot(F.col("u"), F.col("w")), 4).alias("cosine"))


GATE_SQL = f"""
WITH {sq.PASSAGES},
g AS (SELECT *, {sq.squash('text')} AS flat, {sq.word_count('text')} AS n FROM passages),
h AS (SELECT *, regexp_matches(flat, '(?i)(^|[^a-z])(must|shall|should|may|required|prohibited|ought)([^a-z]|$)') AS modal,
        substring(flat, 1, 1) AS f FROM g),
r AS (SELECT *, CASE
  WHEN regexp_matches(flat, '^[0-9 ./|:–—-]+$|^(?i:sayfa|page) *[0-9]+( */ *[0-9]+)?$') THEN 'PAGE_CRUMB'
  WHEN n <= 8 AND NOT regexp_matches(flat, '[.!?;:]') AND NOT modal THEN 'HEADING_FRAGMENT'
  WHEN n <= 14 AND NOT regexp_matches(flat, '[.!?;:]["”’)]? *$') AND NOT modal AND f = lower(f) AND f <> upper(f) THEN 'TORN_FRAGMENT'
  END AS reason FROM h)"""


@query("fil03_evidence_gate", "FIL03", sql=GATE_SQL + """
SELECT doc_id, line_no, reason FROM r WHERE reason IS NOT NULL""")
def fil03_evidence_gate(spark, sf):
    reason = rt.evidence_gate(F.col("text"), F.lit(False))
    return ad.passages(spark, sf).select("doc_id", "line_no", reason.alias("reason")).filter("reason IS NOT NULL")


@query("fil04_judgeable", "FIL04", sql=GATE_SQL + """
SELECT source, count(*)::BIGINT AS lines, count(*) FILTER (n >= 3)::BIGINT AS judgeable, count(*) FILTER (n < 3)::BIGINT AS fragments
FROM r GROUP BY source""")
def fil04_judgeable(spark, sf):
    keep = rt.judgeable(F.col("text"), F.lit("document.txt"))
    return ad.passages(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(keep).alias("judgeable"), F.count_if(~keep).alias("fragments"))


@query("win03_shared_ranks", "WIN03", sql="""
SELECT doc_id, lang, rank() OVER (PARTITION BY lang ORDER BY n_chars DESC)::BIGINT AS rank FROM documents""")
def win03_shared_ranks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return rt.shared_rank(docs, ["lang"], "n_chars", "rank").select("doc_id", "lang", "rank")


FUSED_SQL = f"""
q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS e, {sq.lexical_terms('text')} AS terms, label
      FROM benchmark JOIN embeddings ON item_id = vec_id),
p AS (SELECT doc_id AS passage_id, embedding::DOUBLE[] AS e, {sq.lexical_terms('text')} AS terms, label, text, source
      FROM documents JOIN embeddings ON doc_id = vec_id),
s AS (SELECT query_id, passage_id, round(list_dot_product(q.e, p.e), 4) AS similarity,
             len(list_intersect(q.terms, p.terms))::BIGINT AS lexical, q.label = p.label AS gold, length(text)::BIGINT AS chars, source
      FROM q, p),
k AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY similarity DESC) AS semantic_rank,
             rank() OVER (PARTITION BY query_id ORDER BY lexical DESC) AS lexical_rank FROM s),
f AS (SELECT *, 1.0::DOUBLE / (60 + semantic_rank) + CASE WHEN lexical > 0 THEN 1.0::DOUBLE / (60 + lexical_rank) ELSE 0.0 END AS fused FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, similarity DESC, passage_id) AS position FROM f)"""


def fused(spark, sf, top=10):
    return rt.fused_order(
        ad.vector_duties(spark, sf).select("query_id", "vector", "terms"),
        ad.vector_passages(spark, sf).select("passage_id", "vector", "terms"), top)


@query("win04_rank_fusion", "WIN04", "UDF01", sql=f"""
WITH {FUSED_SQL}
SELECT query_id, passage_id, position::BIGINT AS position, similarity, semantic_rank::BIGINT AS semantic_rank, lexical,
       CASE WHEN lexical > 0 THEN lexical_rank END::BIGINT AS lexical_rank, round(fused, 5) AS rrf FROM o WHERE position <= 10""")
def win04_rank_fusion(spark, sf):
    return fused(spark, sf).filter("position <= 10").select(
        "query_id", "passage_id", F.col("position").cast("bigint").alias("position"), "similarity", "semantic_rank", "lexical",
        F.when(F.col("lexical") > 0, F.col("lexical_rank")).alias("lexical_rank"), F.round("fused", 5).alias("rrf"))


@query("win05_budget_selection", "WIN05", sql=f"""
WITH RECURSIVE {FUSED_SQL},
w AS (SELECT query_id, passage_id, position, chars FROM o WHERE position <= 10),
step AS (
  SELECT query_id, 0::BIGINT AS position, 0::BIGINT AS n, 0::BIGINT AS used, false AS shown FROM (SELECT DISTINCT query_id FROM w)
  UNION ALL
  SELECT w.query_id, w.position, n + (n < 6 AND used + chars <= 6500)::BIGINT,
         used + CASE WHEN n < 6 AND used + chars <= 6500 THEN chars ELSE 0 END, n < 6 AND used + chars <= 6500
  FROM step JOIN w ON w.query_id = step.query_id AND w.position = step.position + 1)
SELECT w.query_id, w.passage_id, w.position::BIGINT AS position, step.shown FROM step JOIN w USING (query_id, position)""")
def win05_budget_selection(spark, sf):
    lengths = table(spark, sf, "documents").select(F.col("doc_id").alias("passage_id"), F.length("text").cast("bigint").alias("chars"))
    ranked = fused(spark, sf).join(lengths, "passage_id")
    return rt.select_within_budget(ranked, "query_id", "position", "chars").select(
        "query_id", "passage_id", F.col("position").cast("bigint").alias("position"), "shown")


@query("win06_channel_union", "WIN06", sql=f"""
WITH {FUSED_SQL},
u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, passage_id) AS sr,
             row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, passage_id) AS lr FROM o)
SELECT query_id, passage_id, similarity, lexical FROM u WHERE position <= 6 OR sr <= 10 OR (lr <= 10 AND lexical > 0)""")
def win06_channel_union(spark, sf):
    return rt.channel_union(fused(spark, sf), "query_id", 6).select("query_id", "passage_id", "similarity", "lexical")


@query("agg12_retrieval_metrics", "AGG12", sql=f"""
WITH {FUSED_SQL},
b AS (SELECT query_id, min(position) FILTER (gold AND position <= 10) AS rank, coalesce(bool_or(gold AND position = 1), false) AS hit
      FROM o GROUP BY query_id)
SELECT count(*)::BIGINT AS n,
  {sq.ratio4('count(*) FILTER (rank <= 3)', 'count(*)')} AS recall_at_3, {sq.ratio4('count(*) FILTER (rank <= 5)', 'count(*)')} AS recall_at_5,
  {sq.ratio4('count(*) FILTER (rank <= 10)', 'count(*)')} AS recall_at_10,
  {sq.ratio4('coalesce(sum(1.0::DOUBLE / rank), 0)', 'count(*)')} AS mrr, {sq.ratio4('count(*) FILTER (hit)', 'count(*)')} AS evidence_hit_rate
FROM b""")
def agg12_retrieval_metrics(spark, sf):
    from ..operators.scoring import retrieval_metrics

    q = ad.vector_duties(spark, sf).select("query_id", F.col("label").alias("wanted"))
    p = ad.vector_passages(spark, sf).select("passage_id", "label")
    head = fused(spark, sf).filter("position <= 10").join(p, "passage_id")
    joined = q.join(head, "query_id", "left")
    gold = F.col("wanted") == F.col("label")
    best = joined.groupBy("query_id").agg(
        F.min(F.when(gold, F.col("position"))).alias("rank"),
        F.coalesce(F.bool_or(gold & (F.col("position") == 1)), F.lit(False)).alias("hit"))
    return retrieval_metrics(best)
