"""Version queries: captures, chains, differences between snapshots, what a change means for earlier results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import versions as vs
from ..operators.alignment import clause_changes
from ..sources.tables import table
from ..functions import vocabulary as vc
from . import adapters as ad
from . import sqltext as sq
from . import statutes as st
from .registry import query

ORIGIN_SQL = f"""{sq.CAPTURES},
b AS (SELECT *, lag(content_hash) OVER w AS ph, lag(parser_version) OVER w AS pp FROM captures
      WINDOW w AS (PARTITION BY regulation_id ORDER BY fetched_at, capture_id)),
o AS (SELECT *, CASE WHEN ph IS NULL THEN 'INITIAL' WHEN ph = content_hash AND pp = parser_version THEN 'UNCHANGED'
        WHEN ph = content_hash THEN 'PARSER_REPROCESSING' WHEN pp = parser_version THEN 'SOURCE_CHANGE' ELSE 'SOURCE_AND_PARSER_CHANGE' END AS change_origin FROM b),
v AS (SELECT *, sum((change_origin <> 'UNCHANGED')::INT) OVER (PARTITION BY regulation_id ORDER BY fetched_at, capture_id
        ROWS UNBOUNDED PRECEDING)::BIGINT AS version_no FROM o)"""


@query("src10_append_versions", "SRC10", sql=f"WITH {ORIGIN_SQL} SELECT regulation_id, capture_id, change_origin, version_no FROM v")
def src10_append_versions(spark, sf):
    return vs.label_captures(ad.captures(spark, sf), "year").select("regulation_id", "capture_id", "change_origin", "version_no")


@query("src11_corpus_refresh", "SRC11", sql=f"""
WITH {sq.CAPTURES},
head AS (SELECT regulation_id, arg_max(content_hash, (fetched_at, capture_id)) AS h, arg_max(capture_id, (fetched_at, capture_id)) AS v
         FROM captures WHERE fetched_at < TIMESTAMP '2000-01-01' GROUP BY ALL),
inc AS (SELECT regulation_id, arg_max(content_hash, (fetched_at, capture_id)) AS h, arg_max(capture_id, (fetched_at, capture_id)) AS v,
               max(fetched_at) AS t FROM captures WHERE fetched_at >= TIMESTAMP '2000-01-01' GROUP BY ALL)
SELECT inc.regulation_id, CASE WHEN head.h = inc.h THEN 'UNCHANGED' ELSE 'NEW_VERSION' END AS status,
  CASE WHEN head.h = inc.h THEN NULL ELSE strftime(inc.t, '%Y%m%d') || '-' || substring(inc.h, 1, 12) END AS version_id, head.v AS previous_version
FROM inc LEFT JOIN head USING (regulation_id)""")
def src11_corpus_refresh(spark, sf):
    c = ad.captures(spark, sf)
    order = [F.col("fetched_at"), F.col("capture_id")]
    newest = lambda df: vs.latest(df, "regulation_id", order, ["content_hash", "capture_id", "fetched_at"])
    head = newest(c.filter("fetched_at < '2000-01-01'")).select(
        "regulation_id", F.col("content_hash").alias("h"), F.col("capture_id").alias("previous_version"))
    incoming = newest(c.filter("fetched_at >= '2000-01-01'")).join(head, "regulation_id", "left")
    same = F.col("h").eqNullSafe(F.col("content_hash"))
    return incoming.select(
        "regulation_id", F.when(same, "UNCHANGED").otherwise("NEW_VERSION").alias("status"),
        F.when(~same, F.concat_ws("-", F.date_format("fetched_at", "yyyyMMdd"), F.substring("content_hash", 1, 12))).alias("version_id"),
        "previous_version")


@query("src12_latest_versions", "SRC12", sql=f"""
WITH {sq.CAPTURES}
SELECT regulation_id, arg_max(capture_id, (fetched_at, capture_id)) AS capture_id, max(fetched_at)::DATE::VARCHAR AS fetched_on, count(*)::BIGINT AS versions
FROM captures GROUP BY regulation_id ORDER BY regulation_id LIMIT 50 OFFSET 10""")
def src12_latest_versions(spark, sf):
    c = ad.captures(spark, sf).groupBy("regulation_id").agg(
        F.max_by("capture_id", F.struct("fetched_at", "capture_id")).alias("capture_id"),
        F.to_date(F.max("fetched_at")).cast("string").alias("fetched_on"), F.count(F.lit(1)).alias("versions"))
    return c.orderBy("regulation_id").offset(10).limit(50)


@query("src13_comparison_rows", "SRC13", "SRC12", sql=f"""
WITH {ORIGIN_SQL}
SELECT capture_id, change_origin, fetched_at::DATE::VARCHAR AS fetched_on FROM v WHERE change_origin <> 'UNCHANGED'
ORDER BY fetched_at DESC, capture_id LIMIT 100""")
def src13_comparison_rows(spark, sf):
    v = vs.label_captures(ad.captures(spark, sf), "year").filter("change_origin <> 'UNCHANGED'")
    newest = v.orderBy(F.desc("fetched_at"), "capture_id").limit(100)
    return newest.select("capture_id", "change_origin", F.to_date("fetched_at").cast("string").alias("fetched_on"))


@query("win01_latest_version", "WIN01", sql=f"""
WITH {sq.CAPTURES}
SELECT regulation_id, capture_id, content_hash FROM captures
QUALIFY row_number() OVER (PARTITION BY regulation_id ORDER BY fetched_at DESC, capture_id DESC) = 1""")
def win01_latest_version(spark, sf):
    return vs.latest(ad.captures(spark, sf), "regulation_id", [F.col("fetched_at"), F.col("capture_id")], ["capture_id", "content_hash"])


CHAIN_SQL = f"""{sq.CAPTURES},
c AS (SELECT regulation_id, capture_id AS version_id, CASE WHEN capture_id % 97 = 0 THEN capture_id + 1000000000 WHEN capture_id % 89 = 0 THEN NULL
             ELSE lag(capture_id) OVER (PARTITION BY regulation_id ORDER BY fetched_at, capture_id) END AS previous_version_id FROM captures)"""


@query("win02_version_chain", "WIN02", sql=f"""
WITH RECURSIVE {CHAIN_SQL},
w AS (SELECT regulation_id, version_id FROM c WHERE previous_version_id IS NULL UNION SELECT c.regulation_id, c.version_id FROM c JOIN w ON c.regulation_id = w.regulation_id AND c.previous_version_id = w.version_id),
k AS (SELECT regulation_id, count(*) AS reached FROM w GROUP BY ALL),
n AS (SELECT regulation_id, count(*)::BIGINT AS versions, count(*) FILTER (previous_version_id IS NULL)::BIGINT AS roots FROM c GROUP BY ALL),
u AS (SELECT regulation_id, count(*)::BIGINT AS unknown_predecessors FROM c WHERE previous_version_id IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM c d WHERE d.regulation_id = c.regulation_id AND d.version_id = c.previous_version_id) GROUP BY ALL),
t AS (SELECT regulation_id, count(*)::BIGINT AS replaced_twice FROM (SELECT regulation_id, previous_version_id FROM c WHERE previous_version_id IS NOT NULL
      GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)
SELECT regulation_id, versions, roots, coalesce(unknown_predecessors, 0) AS unknown_predecessors, coalesce(replaced_twice, 0) AS replaced_twice,
  roots = 1 AND coalesce(unknown_predecessors, 0) = 0 AND coalesce(replaced_twice, 0) = 0 AND coalesce(reached, 0) = versions AS one_chain
FROM n LEFT JOIN k USING (regulation_id) LEFT JOIN u USING (regulation_id) LEFT JOIN t USING (regulation_id)""")
def win02_version_chain(spark, sf):
    from ..functions import scan

    linked = scan.previous(ad.captures(spark, sf), ["regulation_id"], "year", [F.col("fetched_at"), F.col("capture_id")], "capture_id", "before")
    stated = (
        F.when(F.col("capture_id") % 97 == 0, F.col("capture_id") + 1000000000)
        .when(F.col("capture_id") % 89 == 0, F.lit(None)).otherwise(F.col("before")))
    versions = linked.select("regulation_id", F.col("capture_id").alias("version_id"), stated.alias("previous_version_id"))
    return vs.chain_problems(versions, "regulation_id")


@query("jon27_earlier_with_other_bytes", "JON27", sql=f"""
WITH {sq.CAPTURES}
SELECT a.regulation_id, a.capture_id, (SELECT b.capture_id FROM captures b WHERE b.regulation_id = a.regulation_id
   AND (b.fetched_at, b.capture_id) < (a.fetched_at, a.capture_id) AND b.content_hash <> a.content_hash
   ORDER BY b.fetched_at DESC, b.capture_id DESC LIMIT 1) AS compared_with FROM captures a""")
def jon27_earlier_with_other_bytes(spark, sf):
    return vs.earlier_with_other_bytes(ad.captures(spark, sf), "year").select("regulation_id", "capture_id", "compared_with")


@query("set10_hash_changes", "SET10", sql="""
SELECT l_orderkey AS version_id, l_linenumber::BIGINT AS number, count(*)::BIGINT AS copies, count(DISTINCT sha256(l_returnflag || l_linestatus)) > 1 AS changed
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def set10_hash_changes(spark, sf):
    h = F.sha2(F.concat("l_returnflag", "l_linestatus"), 256)
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").cast("bigint").alias("number")).agg(
        F.count(F.lit(1)).alias("copies"), (F.min(h) != F.max(h)).alias("changed")).filter("copies > 1")


def _blocks_sql(name: str, key: str, sizes: str, matches: str) -> str:
    """Longest equal run first, then the same before and behind it, as SQL rounds over ranges of two sequences.

    ``sizes(key, na, nb)``, ``matches(key, i, j)`` give table ``name(key, i, j, k)``: equal runs of length k.
    """
    return f"""
{name}_d AS (SELECT {key}, i, j, i - row_number() OVER (PARTITION BY {key}, i - j ORDER BY i) AS isle FROM {matches}),
{name}_m AS MATERIALIZED (SELECT {key}, i, j, row_number() OVER (PARTITION BY {key}, i - j, isle ORDER BY i DESC) AS run FROM {name}_d),
{name}_t AS (SELECT {key}, 0::BIGINT AS a0, na AS a1, 0::BIGINT AS b0, nb AS b1, 0::BIGINT AS k FROM {sizes} WHERE na > 0 AND nb > 0
  UNION ALL
  SELECT {key}, r.a0, r.a1, r.b0, r.b1, r.k FROM (
    SELECT {key}, unnest([{{a0: a0, a1: best.i, b0: b0, b1: best.j, k: 0}}, {{a0: best.i + best.k, a1: a1, b0: best.j + best.k, b1: b1, k: 0}},
                          {{a0: best.i, a1: best.i, b0: best.j, b1: best.j, k: best.k}}]) AS r
    FROM (SELECT {key}, a0, a1, b0, b1, arg_min({{i: i, j: j, k: k}}, {{k: -k, i: i, j: j}}) AS best
          FROM (SELECT t.{key}, a0, a1, b0, b1, i, j, least(run, a1 - i, b1 - j) AS k FROM {name}_t t JOIN {name}_m m
                ON t.{key} = m.{key} AND m.i >= a0 AND m.i < a1 AND m.j >= b0 AND m.j < b1 WHERE t.k = 0) GROUP BY {key}, a0, a1, b0, b1))
  WHERE r.k > 0 OR (r.a1 > r.a0 AND r.b1 > r.b0)),
{name} AS MATERIALIZED (SELECT {key}, a0 AS i, b0 AS j, k FROM {name}_t WHERE k > 0)"""


#: An order is an article; its clauses are worded freely, so replaced stretches hold like and unlike ones.
DIFF_SQL = rf"""RECURSIVE {st.clauses_sql('old_p')}, {st.clauses_sql('new_p', later=True)},
side AS MATERIALIZED (SELECT version_id, s, number, text, regexp_replace(text, '^\s*(?:\([0-9]{{1,2}}\)|[a-zçğıöşü]{{1,2}}\)|[0-9]{{1,2}}\))\s+', '') AS body,
    row_number() OVER (PARTITION BY version_id, s ORDER BY number, sha256(text)) - 1 AS p
  FROM (SELECT version_id, 'o' AS s, number, text FROM old_p UNION ALL SELECT version_id, 'n', number, text FROM new_p)),
size AS (SELECT version_id, count(*) FILTER (s = 'o') AS na, count(*) FILTER (s = 'n') AS nb FROM side GROUP BY ALL),
same AS (SELECT o.version_id, o.p AS i, n.p AS j FROM side o JOIN side n ON o.version_id = n.version_id AND o.body = n.body WHERE o.s = 'o' AND n.s = 'n'),
{_blocks_sql('fixed', 'version_id', 'size', 'same')},
kept AS (SELECT version_id, unnest(range(i, i + k)) AS i, unnest(range(j, j + k)) AS j FROM fixed),
lone AS MATERIALIZED (SELECT side.*, (SELECT count(*) FROM kept k WHERE k.version_id = side.version_id AND CASE s WHEN 'o' THEN k.i ELSE k.j END < p) AS stretch
  FROM side WHERE NOT EXISTS (FROM kept k WHERE k.version_id = side.version_id AND CASE s WHEN 'o' THEN k.i ELSE k.j END = p)),
meet AS MATERIALIZED (SELECT o.version_id, o.stretch, o.p AS op, n.p AS np, o.body AS ob, n.body AS nb FROM lone o JOIN lone n USING (version_id, stretch) WHERE o.s = 'o' AND n.s = 'n'),
words AS MATERIALIZED (SELECT row_number() OVER () AS pair, ob, nb FROM (SELECT DISTINCT ob, nb FROM meet)),
wsize AS (SELECT pair, length(ob) AS na, length(nb) AS nb FROM words),
oc AS (SELECT pair, c.p AS i, c.c FROM (SELECT pair, unnest(list_transform(range(length(ob)), lambda x: {{p: x, c: substr(ob, x + 1, 1)}})) AS c FROM words)),
nc AS (SELECT pair, c.p AS j, c.c FROM (SELECT pair, unnest(list_transform(range(length(nb)), lambda x: {{p: x, c: substr(nb, x + 1, 1)}})) AS c FROM words)),
letters AS (SELECT pair, i, j FROM oc JOIN nc USING (pair, c)),
{_blocks_sql('alike', 'pair', 'wsize', 'letters')},
ratio AS MATERIALIZED (SELECT ob, nb, 2.0::DOUBLE * m / (length(ob) + length(nb)) AS similarity FROM (SELECT pair, sum(k)::BIGINT AS m FROM alike GROUP BY pair) JOIN words USING (pair)),
score AS MATERIALIZED (SELECT version_id, stretch, op, np, similarity, dense_rank() OVER (PARTITION BY version_id, stretch ORDER BY np) AS turn FROM meet JOIN ratio USING (ob, nb)
  WHERE similarity >= 0.6),
pick AS (SELECT version_id, stretch, 0::BIGINT AS turn, []::BIGINT[] AS gone, NULL::BIGINT AS op, NULL::BIGINT AS np, NULL::DOUBLE AS similarity FROM (SELECT DISTINCT version_id, stretch FROM score)
  UNION ALL
  SELECT version_id, stretch, turn, CASE WHEN best IS NULL THEN gone ELSE list_append(gone, best.op) END, best.op, best.np, best.similarity FROM (
    SELECT p.version_id, p.stretch, p.turn + 1 AS turn, gone, arg_max({{op: s.op, np: s.np, similarity: s.similarity}}, {{r: s.similarity, op: s.op}})
        FILTER (NOT list_contains(gone, s.op)) AS best
    FROM pick p JOIN score s ON p.version_id = s.version_id AND p.stretch = s.stretch AND s.turn = p.turn + 1 GROUP BY p.version_id, p.stretch, p.turn, gone)),
paired AS MATERIALIZED (SELECT version_id, op, np, similarity FROM pick WHERE op IS NOT NULL),
d AS (SELECT p.version_id, 'MODIFIED' AS kind, o.number AS old_number, n.number AS new_number, o.text AS old_text, n.text AS new_text, similarity
      FROM paired p JOIN lone o ON o.version_id = p.version_id AND o.s = 'o' AND o.p = op JOIN lone n ON n.version_id = p.version_id AND n.s = 'n' AND n.p = np
      UNION ALL SELECT version_id, 'REMOVED', number, NULL, text, NULL, NULL FROM lone o WHERE s = 'o' AND NOT EXISTS (FROM paired p WHERE p.version_id = o.version_id AND op = o.p)
      UNION ALL SELECT version_id, 'ADDED', NULL, number, NULL, text, NULL FROM lone n WHERE s = 'n' AND NOT EXISTS (FROM paired p WHERE p.version_id = n.version_id AND np = n.p))"""


def provision_changes(spark, sf):
    return clause_changes(st.clauses(spark, sf), st.clauses(spark, sf, later=True), ["version_id"])


@query("jon19_provision_changes", "JON19", sql=f"WITH {DIFF_SQL} SELECT version_id, kind, old_number, new_number, old_text, new_text, similarity FROM d")
def jon19_provision_changes(spark, sf):
    return provision_changes(spark, sf)


def _kinds_sql(old: str, new: str) -> str:
    """The five classes written for RE2, which has no look-around: words stand between doubled blanks, units are spelled out."""
    spaced = lambda t: f"(' ' || replace(regexp_replace(lower({t}), '[^a-zçğıöşüâîû0-9.,]+', ' ', 'g'), ' ', '  ') || ' ')"
    amounts = lambda t: rf"list_sort(list_distinct(regexp_extract_all({t}, '(?i)[0-9][0-9.,]*\s*(?:TL|EUR|USD|GBP)|(?:[£€$]|\b(?:TL|EUR|USD|GBP)\b)\s*[0-9](?:[0-9.,]*[0-9])?')))"
    words = "|".join(sorted(vc.CHANGE_NUMBERS, key=len, reverse=True))
    units = "(?:business|working) days?|days?|months?|years?|weeks?|hours?|iş gün|gün|saat|hafta|ay|yıl"
    ends = "(?:ü|ünde|de|a|da|lık|lük)?"
    periods = lambda t: (rf"list_sort(list_distinct(list_transform(regexp_extract_all({spaced(t)}, ' (?:[0-9]+|(?:{words})(?:  (?:{words}))*)  (?:{units.replace(' ', '  ')}){ends}[.,]? '), "
                         rf"lambda x: regexp_replace(trim(x, ' .,'), '(gün|saat|hafta|ay|yıl)(?:ü|ünde|de|a|da|lık|lük)$', '\1'))))")
    kinds = (("FOREIGN_ASSOCIATION_BRANCH", "yabancı (?:dernek|vakıf)"), ("ASSOCIATION", " dernek"), ("FOUNDATION", " vak[ıi]f"), ("UNION", " sendika"), ("NON_RESIDENT", " non-resident"),
             ("INDIVIDUAL", " gerçek kişi| retail client| consumers?[ .,]| individuals?[ .,]"), ("LEGAL_ENTITY", " tüzel kişi| şirketler| şirketin| compan(?:y|ies)[ .,]"),
             ("BANK", " bankalar | banka | banks?[ .,]"), ("PAYMENT_INSTITUTION", "ödeme kuruluş|payment institution"), ("EMONEY_INSTITUTION", "e-?money institution"),
             ("INSURANCE", "sigorta şirket| insurers?[ .,]"), ("BROKER", " investment firms?[ .,]"), ("FINANCIAL_GENERIC", "finansal kuruluş|financial institution"))
    single = lambda t: f"(' ' || regexp_replace(lower({t}), '\\s+', ' ', 'g') || ' ')"
    parties = lambda t: "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({single(t)}, '{p}') THEN '{k}' END" for k, p in kinds) + "], lambda x: x IS NOT NULL))"
    out = "uygulanmaz|hariç|istisna[a-zçğıöşü]*|saklıdır|kapsamaz|muaf[a-zçğıöşü]*|does  not  apply|unless|except|exceptions?|other  than|exempt|exemptions?|exempted|exempts"
    exclusions = lambda t: f"list_sort(list_transform(regexp_extract_all({spaced(t)}, ' (?:{out})[.,]? '), lambda x: trim(x, ' .,')))"
    changed = ", ".join(f"CASE WHEN {f(old)} <> {f(new)} THEN '{k}' END" for k, f in
                        (("THRESHOLD_CHANGED", amounts), ("DEADLINE_CHANGED", periods), ("ENTITY_SCOPE_CHANGED", parties), ("EXEMPTION_CHANGED", exclusions)))
    return f"CASE WHEN {old} = {new} THEN NULL ELSE coalesce(nullif(array_to_string(list_filter([{changed}], lambda x: x IS NOT NULL), '; '), ''), 'TEXT_CHANGED') END"


@query("set02_change_kinds", "SET02", sql=f"""
WITH {DIFF_SQL} SELECT version_id, new_number, old_text, new_text, {_kinds_sql('old_text', 'new_text')} AS kinds FROM d WHERE kind = 'MODIFIED'""")
def set02_change_kinds(spark, sf):
    return provision_changes(spark, sf).filter("kind = 'MODIFIED'").select(
        "version_id", "new_number", "old_text", "new_text", vs.change_kinds(F.col("old_text"), F.col("new_text")).alias("kinds"))


LABELS_SQL = f"""{sq.provisions('old_p')}, {sq.provisions('new_p', later=True)},
o AS (SELECT version_id, number, min(text) AS text, count(*) AS n, max(l_linestatus) AS coverage FROM old_p GROUP BY ALL),
w AS (SELECT version_id, number, min(text) AS text FROM new_p GROUP BY ALL)"""


@query("jon25_impact_summary", "JON25", "SET01", sql=f"""
WITH {LABELS_SQL}
SELECT version_id, number, CASE WHEN w.text IS NULL THEN 'DELETED' WHEN o.text IS NULL THEN 'NEW_IN_SNAPSHOT' WHEN o.n > 1 THEN 'AMBIGUOUS_BASELINE'
   WHEN o.text = w.text THEN 'TEXT_UNCHANGED' ELSE 'TEXT_CHANGED_REVIEW_REQUIRED' END AS status, o.coverage AS earlier_coverage
FROM o FULL JOIN w USING (version_id, number)""")
def jon25_impact_summary(spark, sf):
    old = ad.provisions(spark, sf).groupBy("version_id", "number").agg(
        F.min("text").alias("was"), F.count(F.lit(1)).alias("n"), F.max("l_linestatus").alias("earlier_coverage"))
    new = ad.provisions(spark, sf, later=True).groupBy("version_id", "number").agg(F.min("text").alias("now"))
    status = (
        F.when(F.col("now").isNull(), "DELETED").when(F.col("was").isNull(), "NEW_IN_SNAPSHOT").when(F.col("n") > 1, "AMBIGUOUS_BASELINE")
        .when(F.col("was") == F.col("now"), "TEXT_UNCHANGED").otherwise("TEXT_CHANGED_REVIEW_REQUIRED"))
    return old.join(new, ["version_id", "number"], "full_outer").select("version_id", "number", status.alias("status"), "earlier_coverage")


@query("jon26_carry_forward", "JON26", "STR08", sql=f"""
WITH {LABELS_SQL},
blockers AS (SELECT string_agg(reason, '; ' ORDER BY reason) AS why FROM (
  SELECT 'company profile changed' AS reason WHERE (SELECT sum(c_acctbal < 0) FROM customer) > (SELECT count(*) FROM customer)
  UNION ALL SELECT 'policy package changed' WHERE (SELECT count(*) FROM documents) = 0))
SELECT version_id, CASE WHEN why IS NOT NULL THEN 'BLOCKED' WHEN o.text = w.text THEN 'CARRIED' ELSE 'REANALYSED' END AS fate, count(*)::BIGINT AS provisions
FROM w LEFT JOIN o USING (version_id, number), blockers GROUP BY ALL""")
def jon26_carry_forward(spark, sf):
    old = ad.provisions(spark, sf).groupBy("version_id", "number").agg(F.min("text").alias("was"))
    new = ad.provisions(spark, sf, later=True).groupBy("version_id", "number").agg(F.min("text").alias("now"))
    customers = table(spark, sf, "customer").agg((F.count_if(F.col("c_acctbal") < 0) > F.count(F.lit(1))).alias("company"))
    documents = table(spark, sf, "documents").agg((F.count(F.lit(1)) == 0).alias("policies"))
    blocked = customers.join(documents).select((F.col("company") | F.col("policies")).alias("blocked"))
    fate = F.when(F.col("blocked"), "BLOCKED").when(F.col("was") == F.col("now"), "CARRIED").otherwise("REANALYSED")
    return new.join(old, ["version_id", "number"], "left").join(F.broadcast(blocked)).groupBy("version_id", fate.alias("fate")).agg(
        F.count(F.lit(1)).alias("provisions"))


@query("set07_duty_changes", "SET07", sql=f"""
WITH {sq.provisions('old_p')}, {sq.provisions('new_p', later=True)},
a AS (SELECT version_id, section, text FROM old_p), b AS (SELECT version_id, section, text FROM new_p),
removed AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), added AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a),
n AS (SELECT version_id, 0 AS r, 0 AS d FROM a UNION ALL SELECT version_id, 1, 0 FROM removed UNION ALL SELECT version_id, 0, 1 FROM added)
SELECT version_id, sum(r)::BIGINT AS removed, sum(d)::BIGINT AS added,
  CASE WHEN sum(r) + sum(d) > 0 THEN 'CANDIDATES_CHANGED_REVIEW_REQUIRED' ELSE 'CANDIDATES_UNCHANGED' END AS status
FROM n GROUP BY version_id""")
def set07_duty_changes(spark, sf):
    columns = ["version_id", "section", "text"]
    a, b = ad.provisions(spark, sf).select(columns), ad.provisions(spark, sf, later=True).select(columns)
    # a multiset difference in both directions is one signed count per distinct duty
    signed = a.withColumn("n", F.lit(1)).unionByName(b.withColumn("n", F.lit(-1))).groupBy(columns).agg(F.sum("n").alias("n"))
    out = signed.groupBy("version_id").agg(
        F.sum(F.greatest(F.col("n"), F.lit(0))).alias("removed"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("added"))
    changed = F.col("removed") + F.col("added") > 0
    return out.withColumn("status", F.when(changed, "CANDIDATES_CHANGED_REVIEW_REQUIRED").otherwise("CANDIDATES_UNCHANGED"))


@query("agg24_multiset_fingerprint", "AGG24", "UDAF02", sql=f"""
WITH {sq.provisions('p')},
h AS (SELECT version_id, sha256(number || ':' || text) AS d FROM p),
s AS (SELECT version_id, count(*)::BIGINT AS members, sum(('0x' || substring(d, 1, 12))::BIGINT) AS a, sum(('0x' || substring(d, 13, 12))::BIGINT) AS b FROM h GROUP BY ALL)
SELECT version_id, members, sha256(members || ':' || a || ':' || b) AS fingerprint FROM s""")
def agg24_multiset_fingerprint(spark, sf):
    return vs.multiset_fingerprint(ad.provisions(spark, sf), ["version_id"], F.concat_ws(":", "number", "text"))


@query("agg24_list_fingerprint", "AGG24", sql="""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM l GROUP BY doc_id""")
def agg24_list_fingerprint(spark, sf):
    # one document is one row, so its lines are sorted in the row
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2(F.array_join(F.array_sort(F.split("text", "\n")), "\n"), 256).alias("fingerprint"))


@query("set08_frozen_check", "SET08", sql=f"""
WITH {sq.provisions('old_p')}, {sq.provisions('new_p', later=True)},
a AS (SELECT version_id, section, md5(string_agg(number || text, '|' ORDER BY number, text)) AS v FROM old_p GROUP BY ALL),
b AS (SELECT version_id, section, md5(string_agg(number || text, '|' ORDER BY number, text)) AS v FROM new_p GROUP BY ALL)
SELECT version_id, section, CASE WHEN b.v IS NULL THEN 'MISSING' WHEN a.v IS NULL THEN 'NEW' ELSE 'CHANGED' END AS state
FROM b FULL JOIN a USING (version_id, section) WHERE a.v IS DISTINCT FROM b.v""")
def set08_frozen_check(spark, sf):
    mark = lambda df: vs.multiset_fingerprint(df, ["version_id", "section"], F.concat("number", "text"))
    frozen, current = mark(ad.provisions(spark, sf)), mark(ad.provisions(spark, sf, later=True))
    return vs.manifest_difference(current, frozen, ["version_id", "section"], "fingerprint").select("version_id", "section", "state")


FATES_SQL = """
old_r AS (SELECT l_orderkey AS duty, l_linenumber AS target, min(l_returnflag) AS status FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01' GROUP BY ALL),
new_r AS (SELECT l_orderkey AS duty, l_linenumber AS target, max(l_returnflag) AS status FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY ALL),
dec AS (SELECT l_orderkey AS duty, l_linenumber AS target, CASE WHEN max(l_linestatus) = 'O' THEN 'UNKNOWN' ELSE 'DOES_NOT_APPLY' END AS decision FROM lineitem GROUP BY ALL),
rd AS (SELECT DISTINCT l_orderkey AS duty FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'),
had AS (SELECT DISTINCT duty FROM old_r),
f AS (SELECT duty, target, o.status AS was, n.status AS now, dec.decision,
  CASE WHEN o.status = n.status THEN 'KEPT' WHEN o.status IS NOT NULL AND n.status IS NOT NULL THEN 'KEPT_STATUS_CHANGED'
       WHEN o.status IS NOT NULL AND rd.duty IS NULL THEN 'OBLIGATION_NOT_READ' WHEN o.status IS NOT NULL AND decision = 'UNKNOWN' THEN 'MOVED_TO_REVIEW'
       WHEN o.status IS NOT NULL THEN 'OUT_OF_SCOPE' WHEN had.duty IS NULL THEN 'NEW_OBLIGATION' ELSE 'RE_ENTERED' END AS fate
  FROM old_r o FULL JOIN new_r n USING (duty, target) LEFT JOIN dec USING (duty, target) LEFT JOIN rd USING (duty) LEFT JOIN had USING (duty))"""


def fates(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("duty"), F.col("l_linenumber").alias("target"), "l_returnflag", "l_linestatus", "l_shipdate")
    late = x.filter("l_shipdate >= '1996-01-01'")
    old = x.filter("l_shipdate < '2001-01-01'").groupBy("duty", "target").agg(F.min("l_returnflag").alias("status"))
    new = late.groupBy("duty", "target").agg(F.max("l_returnflag").alias("status"))
    decisions = x.groupBy("duty", "target").agg(F.when(F.max("l_linestatus") == "O", "UNKNOWN").otherwise("DOES_NOT_APPLY").alias("decision"))
    return vs.row_fates(old, new, decisions, late.select("duty"), ["duty", "target"], "duty")


@query("jon35_row_fates", "JON35", sql=f"WITH {FATES_SQL} SELECT duty, target::BIGINT AS target, was, now, fate FROM f")
def jon35_row_fates(spark, sf):
    return fates(spark, sf).select("duty", F.col("target").cast("bigint").alias("target"), "was", "now", "fate")


@query("jon35_reconciliation", "JON35", sql=f"""
WITH {FATES_SQL}, c AS (SELECT count(was) AS old_rows, count(now) AS new_rows, count(*) FILTER (now IS NULL) AS gone, count(*) FILTER (was IS NULL) AS added FROM f)
SELECT old_rows, new_rows, gone, added, old_rows - gone + added = new_rows AS balanced FROM c""")
def jon35_reconciliation(spark, sf):
    n = fates(spark, sf).agg(
        F.count("was").alias("old_rows"), F.count("now").alias("new_rows"), F.count_if(F.col("now").isNull()).alias("gone"),
        F.count_if(F.col("was").isNull()).alias("added"))
    return n.withColumn("balanced", F.col("old_rows") - F.col("gone") + F.col("added") == F.col("new_rows"))


@query("jon36_failure_lists", "JON36", sql="""
WITH a AS (SELECT user_id AS test_id, min(props) AS reason FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-12' GROUP BY ALL),
b AS (SELECT user_id AS test_id, min(props) AS reason FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-18' GROUP BY ALL)
SELECT test_id, CASE WHEN b.reason IS NULL THEN 'FIXED' WHEN a.reason IS NULL THEN 'NEW'
  WHEN regexp_replace(a.reason, '[0-9]+', '#', 'g') <> regexp_replace(b.reason, '[0-9]+', '#', 'g') THEN 'OTHER_REASON' ELSE 'SAME' END AS state
FROM a FULL JOIN b USING (test_id)""")
def jon36_failure_lists(spark, sf):
    failed = table(spark, sf, "events").filter("event_type = 'error'")
    side = lambda df, name: df.groupBy(F.col("user_id").alias("test_id")).agg(F.min("props").alias(name))
    a, b = side(failed.filter("ts < '2024-01-12'"), "before"), side(failed.filter("ts >= '2024-01-18'"), "after")
    same = F.regexp_replace("before", "[0-9]+", "#") == F.regexp_replace("after", "[0-9]+", "#")
    state = F.when(F.col("after").isNull(), "FIXED").when(F.col("before").isNull(), "NEW").when(~same, "OTHER_REASON").otherwise("SAME")
    return a.join(b, "test_id", "full_outer").select("test_id", state.alias("state"))


@query("agg40_idempotent_runs", "AGG40", sql=f"""
WITH {sq.provisions('p')},
h AS (SELECT version_id, sha256(count(*)::BIGINT || ':' || sum(('0x' || substring(sha256(text), 1, 12))::BIGINT) || ':' || sum(('0x' || substring(sha256(text), 13, 12))::BIGINT)) AS input_hash,
        bool_or(l_discount > 0.09) AS failed FROM p GROUP BY ALL),
runs AS (SELECT version_id, input_hash FROM h WHERE version_id % 3 = 0)
SELECT h.version_id, CASE WHEN runs.input_hash IS NOT NULL THEN 'UNCHANGED' WHEN failed THEN 'FAILED' ELSE 'NEW_RUN' END AS status
FROM h LEFT JOIN runs USING (version_id, input_hash)""")
def agg40_idempotent_runs(spark, sf):
    p = ad.provisions(spark, sf)
    marks = vs.multiset_fingerprint(p, ["version_id"], F.col("text")).select("version_id", F.col("fingerprint").alias("input_hash"))
    failed = p.groupBy("version_id").agg(F.bool_or(F.col("l_discount") > 0.09).alias("failed"))
    runs = marks.filter("version_id % 3 = 0").withColumn("_seen", F.lit(True))
    status = F.when(F.col("_seen"), "UNCHANGED").when(F.col("failed"), "FAILED").otherwise("NEW_RUN")
    return marks.join(runs, ["version_id", "input_hash"], "left").join(failed, "version_id").select("version_id", status.alias("status"))


@query("win12_duplicate_locators", "WIN12", sql=f"""
WITH {sq.provisions('p')}, r AS (SELECT version_id, number, text, row_number() OVER (PARTITION BY version_id, number ORDER BY text, l_partkey, l_suppkey) AS rn FROM p)
SELECT version_id, CASE WHEN rn > 1 THEN number || '~' || rn ELSE number::VARCHAR END AS locator, text FROM r""")
def win12_duplicate_locators(spark, sf):
    from ..functions import scan

    p = ad.provisions(spark, sf).withColumn("block", F.col("text"))
    numbered = scan.row_number(p, ["version_id", "number"], "block", [F.col("text"), F.col("l_partkey"), F.col("l_suppkey")], "rn")
    locator = F.when(F.col("rn") > 1, F.concat_ws("~", "number", "rn")).otherwise(F.col("number").cast("string"))
    return numbered.select("version_id", locator.alias("locator"), "text")
