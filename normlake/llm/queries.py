"""The operators over the given tables, as registered queries, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.llm import bpe_codec, kneser_ney, license_scan, pii, quality
from normlake.llm.common import table
from normlake.llm.decontaminate import contamination
from normlake.llm.exact_dedup import exact_dedup
from normlake.llm.hard_negatives import mine
from normlake.llm.importance_resampling import resample
from normlake.llm.jaccard_join import jaccard_join
from normlake.llm.sentencepiece_codec import encode
from normlake.llm.substring_dedup import substring_dedup
from normlake.llm.url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


@register("op4_exact_dedup", sql=r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
    FROM t""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@register("op5_decontamination", sql=r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    p AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
    v AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM p),
    s AS (SELECT doc_id, w, unnest((SELECT list(DISTINCT n) FROM v)) AS n FROM d),
    q AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s WHERE len(w) >= n),
    h AS (SELECT DISTINCT q.doc_id, v.item_id, q.n, q.i FROM q JOIN v ON q.n = v.n AND array_to_string(q.w[q.i:q.i + q.n - 1], ' ') = v.phrase),
    hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: The rounds are fixed, so SQL can run them too; scores are compared through the verdict only.
@register("op9_url_filter", sql=r"""
    WITH RECURSIVE p AS (
      SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    r(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
    j AS (SELECT p.*, (SELECT max_by(rule, len(rule)) FROM r WHERE (p.host = split_part(rule, '/', 1) OR ends_with(p.host, '.' || split_part(rule, '/', 1)))
                         AND starts_with(p.path, substr(rule, strpos(rule, '/')))) AS rule FROM p),
    l AS (SELECT src, translate(regexp_extract(link, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
          FROM (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?([a-z][a-z0-9+.-]*://[^"''\s>]+)', 1)) AS link FROM p WHERE host != '')),
    hosts AS (SELECT host FROM p WHERE host != '' UNION SELECT dst FROM l WHERE dst != '' AND dst != src),
    tree AS (SELECT host, array_to_string(string_split(host, '.')[2:], '.') AS up FROM hosts WHERE len(string_split(host, '.')) > 2),
    e AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 1.0::DOUBLE AS w FROM l WHERE dst != '' AND dst != src
          UNION ALL SELECT host, up, 1.0 FROM tree UNION ALL SELECT up, host, 1.0 FROM tree) GROUP BY src, dst),
    s AS (SELECT host, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM j JOIN r USING (rule) WHERE host != '' GROUP BY host),
    seed AS (SELECT 'a' AS kind, host, a / sum(a) OVER () AS v FROM s WHERE a > 0 UNION ALL SELECT 'b', host, b / sum(b) OVER () FROM s WHERE b > 0),
    ways AS (SELECT 'a' AS kind, src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM e
             UNION ALL SELECT 'b', dst, src, w / sum(w) OVER (PARTITION BY dst) FROM e),
    walk AS (SELECT 0 AS n, kind, host, v FROM seed
             UNION ALL SELECT n + 1, kind, host, sum(v) FROM (
               SELECT walk.n, walk.kind, ways.dst AS host, walk.v * ways.share * 0.85 AS v FROM walk JOIN ways ON walk.kind = ways.kind AND walk.host = ways.src WHERE walk.n < 10
               UNION ALL SELECT k.n, seed.kind, seed.host, seed.v * (1 - 0.85) FROM seed JOIN (SELECT DISTINCT n, kind FROM walk WHERE n < 10) k USING (kind)) GROUP BY n, kind, host),
    score AS (SELECT host, coalesce(sum(v) FILTER (kind = 'a'), 0) AS trust, coalesce(sum(v) FILTER (kind = 'b'), 0) AS distrust FROM walk WHERE n = 10 GROUP BY host)
    SELECT page_id, j.host, path, j.rule, coalesce(r.verdict, CASE WHEN distrust > trust * 4 THEN 'block' ELSE 'allow' END) AS verdict
    FROM j LEFT JOIN r ON j.rule = r.rule LEFT JOIN score ON j.host = score.host""")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@register("op3_substring_dedup", sql=r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
    hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY phrase) AS low FROM p) WHERE low < doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM hit),
    lost AS (SELECT doc_id, list(place) AS places, count(*) AS n FROM gone GROUP BY doc_id),
    kept AS (SELECT doc_id, string_agg(w[place], ' ' ORDER BY place) AS body FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS place FROM d)
             ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
    FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    values = ", ".join(f"({n}, '{label}', {p}, '{k}', '{x}', {b})" for n, label, p, k, x, b in license_scan.rules())
    matches = " UNION ALL ".join(f"SELECT row, {n} AS rule, regexp_extract_all(body, '{x}') AS hits, string_split_regex(body, '{x}') AS gaps FROM d WHERE contains(body, '{k}')"
                                 for n, _, _, k, x, _ in license_scan.rules())
    covered = " OR ".join(f"(priority = {p} AND coalesce(max(CASE WHEN priority >= {p} THEN last END) OVER o >= last, false))" for p in range(1, license_scan.PRIORITIES + 1))
    return rf"""
    WITH r(rule, label, priority, keyword, regex, base) AS (VALUES {values}),
    t AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{license_scan.WORD}') AS w,
          regexp_matches(coalesce(text, ''), '(?i){"|".join(license_scan.STEMS)}') AS gate FROM documents),
    d AS MATERIALIZED (SELECT row, ' ' || array_to_string(w, '  ') || ' ' AS body FROM t WHERE gate),
    m AS ({matches}),
    e AS (SELECT row, rule, i, (length(gaps[i]) - length(replace(gaps[i], ' ', '')))::BIGINT AS before, (length(hits[i]) - length(replace(hits[i], ' ', '')))::BIGINT AS size
          FROM (SELECT row, rule, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0)),
    s AS (SELECT row, rule, size, (sum(before + size) OVER (PARTITION BY row, rule ORDER BY i) / 2)::BIGINT AS last FROM e),
    p AS (SELECT s.row, label, priority, base, last, last - (size / 2)::BIGINT AS first, s.rule FROM s JOIN r USING (rule)),
    c AS (SELECT *, NOT ({covered}) AS stays FROM p WINDOW o AS (PARTITION BY row ORDER BY first, last DESC, priority DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT row, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
          string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR stays) AS labels,
          max(priority) FILTER (stays) / {float(license_scan.PRIORITIES)} AS score FROM c GROUP BY row)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM t LEFT JOIN g USING (row)"""


@register("op2_license_scan", sql=_license_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@register("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{kind}" for kind in pii.BASE], F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@register("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=False)
    return judged.select("doc_id", "evidence", "host_share", "path_share", "posterior", "kept")


@register("op10_kneser_ney")
def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    scored = kneser_ney.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register("op6_jaccard_join", sql=r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id != b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
    r(doc_id, low) AS (SELECT x, y FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.low = l.x)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(low) AS low FROM r GROUP BY doc_id) m USING (doc_id)""")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@register("op11_importance_resampling", sql=r"""
    WITH poly AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(n))),
    raw AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
    w AS MATERIALIZED (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw),
    f AS MATERIALIZED (SELECT side, id, feature, count(*) AS n FROM (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM w) GROUP BY ALL),
    x AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)),
    c AS MATERIALIZED (SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM x, poly),
    k AS MATERIALIZED (SELECT side, id, bucket, sum(n)::BIGINT AS n FROM f JOIN c USING (feature) GROUP BY ALL),
    z AS (SELECT coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s_all, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t_all FROM k),
    g AS (SELECT bucket, floor(1000 * ln((t + 1) * (t_s + 10000) / ((s + 1) * (t_t + 10000))))::BIGINT AS gain
          FROM (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM k GROUP BY bucket), (SELECT s_all AS t_s, t_all AS t_t FROM z)),
    m AS (SELECT id, floor(sum(k.n * gain)::DOUBLE / sum(k.n)::DOUBLE)::BIGINT AS weight, sum(k.n)::BIGINT AS n_features FROM k JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
    o AS (SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
          coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
          FROM w LEFT JOIN m USING (id) WHERE side = 'd'),
    q AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER () // 100 AS quota FROM o WHERE n_words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= quota THEN place END AS rank FROM o LEFT JOIN q USING (doc_id)""")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


@register("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe_codec.encode(table(spark, sf_dir, "documents"), path, as_bytes=True, with_text=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op13_hard_negatives", sql=r"""
    WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
          FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY rank <= 5""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", label))
