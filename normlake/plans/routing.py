"""Routing queries: which duty reaches which target, in three-valued logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as ro
from ..operators.cycles import cycles
from ..sources.tables import table
from . import adapters as ad
from . import sqltext as sq
from .registry import query


def decisions(spark, sf):
    pairs = ad.entities(spark, sf).join(ad.entity_scopes(spark, sf), "pack_id")
    entity = ro.list_fact(F.col("entity_classes"), F.col("complete"), F.col("needs_entity"))
    activity = ro.list_fact(F.col("activity_classes"), F.col("activities_complete"), F.col("needs_activity"))
    gates = [ro.gate("ENTITY", entity, F.size("needs_entity") > 0), ro.gate("ACTIVITY", activity, F.size("needs_activity") > 0)]
    return ro.decide(pairs, gates, F.col("unclear"), F.col("binding"))


def product_decisions(spark, sf):
    pairs = ad.products(spark, sf).join(ad.product_scopes(spark, sf), "pack_id")
    tag = F.when(F.size("needs_tags") == 0, F.lit(True)).otherwise(ro.list_fact(F.col("tags"), F.col("tags_complete"), F.col("needs_tags")))
    fact = ro.product_fact(
        F.col("product_class") == F.col("needs_class"), F.lit(False), ro.compare_fact(F.col("size"), "ge", F.col("min_size")),
        ro.compare_fact(F.col("price"), "gt", F.col("exempt_price")), tag)
    return pairs.withColumn("status", F.when(fact, "APPLIES").when(fact.isNull(), "UNKNOWN").otherwise("DOES_NOT_APPLY"))


@query("jon09_route_entities", "JON09", sql=f"WITH {sq.ENTITIES} SELECT scope_id, target_id, status, reasons FROM decisions")
def jon09_route_entities(spark, sf):
    return decisions(spark, sf).select("scope_id", "target_id", "status", "reasons")


@query("jon10_route_products", "JON10", "FIL09", sql=f"WITH {sq.PRODUCTS} SELECT scope_id, target_id, status FROM pdecisions")
def jon10_route_products(spark, sf):
    return product_decisions(spark, sf).select("scope_id", "target_id", "status")


@query("fil09_typed_predicates", "FIL09", sql="""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'UNKNOWN' WHEN p_size > 20 THEN 'YES' ELSE 'NO' END AS gt20,
  CASE WHEN p_partkey % 5 = 0 THEN 'UNKNOWN' WHEN p_size = 7 THEN 'YES' ELSE 'NO' END AS eq7,
  CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'YES' ELSE 'NO' END AS in_class FROM part""")
def fil09_typed_predicates(spark, sf):
    p = table(spark, sf, "part")
    size = F.when(F.col("p_partkey") % 5 != 0, F.col("p_size"))
    return p.select(
        "p_partkey", ro.word(ro.compare_fact(size, "gt", F.lit(20))).alias("gt20"), ro.word(ro.compare_fact(size, "eq", F.lit(7))).alias("eq7"),
        ro.word(F.col("p_type").isin("PROMO", "SMALL")).alias("in_class"))


@query("agg05_rollup_groups", "AGG05", sql=f"""
WITH {sq.ENTITIES},
g AS (SELECT scope_id, group_id, count(*) AS n, count(*) FILTER (status = 'APPLIES') AS a, count(*) FILTER (status = 'UNKNOWN') AS u FROM decisions GROUP BY ALL)
SELECT scope_id, group_id, n::BIGINT AS children, CASE WHEN a = n THEN 'APPLIES' WHEN a > 0 THEN 'PARTIAL' WHEN u > 0 THEN 'UNKNOWN' ELSE 'DOES_NOT_APPLY' END AS status FROM g""")
def agg05_rollup_groups(spark, sf):
    d = decisions(spark, sf)
    return ro.combine_children(d, d.select("scope_id", "group_id").distinct(), ["scope_id", "group_id"], F.lit(True))


HOLDINGS_SQL = """holds AS (SELECT DISTINCT o_custkey AS entity_id, l_partkey AS target_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def holdings(spark, sf):
    """Which products an entity handles (bought at least once)."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("entity_id"))
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("target_id")).join(
        o, F.col("l_orderkey") == F.col("o_orderkey")).select("entity_id", "target_id").distinct()


@query("agg05_rollup_products", "AGG05", sql=f"""
WITH {sq.PRODUCTS}, {HOLDINGS_SQL},
g AS (SELECT scope_id, entity_id, count(*) AS n, count(*) FILTER (status = 'APPLIES') AS a, count(*) FILTER (status = 'UNKNOWN') AS u
      FROM holds JOIN pdecisions USING (target_id) GROUP BY ALL)
SELECT scope_id, entity_id, n::BIGINT AS children, CASE WHEN a = n THEN 'APPLIES' WHEN a > 0 THEN 'PARTIAL' WHEN u > 0 THEN 'UNKNOWN' ELSE 'DOES_NOT_APPLY' END AS status FROM g""")
def agg05_rollup_products(spark, sf):
    d = product_decisions(spark, sf).select("scope_id", "target_id", "status").join(holdings(spark, sf), "target_id")
    return ro.combine_children(d, d.select("scope_id", "entity_id").distinct(), ["scope_id", "entity_id"], F.lit(True))


PACKS_SQL = f"""{HOLDINGS_SQL},
prof AS (SELECT n_nationkey AS profile_id, n_nationkey % 3 = 0 AS products_complete FROM nation),
packs AS (SELECT DISTINCT 'PACK_' || p_type AS pack_id FROM part WHERE p_type <> 'STANDARD'),
pp AS (SELECT DISTINCT 'PACK_' || p_type AS pack_id, p_type AS product_class FROM part WHERE p_type <> 'STANDARD'),
pl(pack_id, licence) AS (VALUES ('PACK_PROMO', 'BUILDING'), ('PACK_PROMO', 'MACHINERY'), ('PACK_SMALL', 'MACHINERY'), ('PACK_LARGE', 'FURNITURE')),
prod AS (SELECT DISTINCT c_nationkey AS profile_id, p_type AS product_class FROM holds JOIN customer ON entity_id = c_custkey JOIN part ON target_id = p_partkey WHERE p_size = 50 AND p_retailprice < 1000),
lic AS (SELECT DISTINCT c_nationkey AS profile_id, c_mktsegment AS licence FROM customer WHERE c_acctbal > 9000),
ex AS (SELECT licence, min(pack_id) AS pack_id FROM pl GROUP BY licence HAVING count(DISTINCT pack_id) = 1),
sel AS (SELECT profile_id, pack_id, products_complete, EXISTS (SELECT 1 FROM prod JOIN pp USING (product_class) WHERE prod.profile_id = prof.profile_id AND pp.pack_id = packs.pack_id) AS p,
    EXISTS (SELECT 1 FROM lic JOIN ex USING (licence) WHERE lic.profile_id = prof.profile_id AND ex.pack_id = packs.pack_id) AS l FROM prof, packs),
selections AS (SELECT profile_id, pack_id, CASE WHEN p OR l THEN 'SELECTED' WHEN products_complete THEN 'NOT_SELECTED' ELSE 'UNKNOWN' END AS status,
  CASE WHEN p OR l THEN concat_ws('; ', CASE WHEN p THEN 'PRODUCT_MATCH' END, CASE WHEN l THEN 'LICENSE_MATCH' END) WHEN products_complete THEN 'PRODUCT_MISMATCH' ELSE 'PROFILE_INCOMPLETE' END AS reasons FROM sel)"""


def selections(spark, sf):
    nation, part, customer = table(spark, sf, "nation"), table(spark, sf, "part"), table(spark, sf, "customer")
    profiles = nation.select(F.col("n_nationkey").alias("profile_id"), (F.col("n_nationkey") % 3 == 0).alias("products_complete"))
    pack_products = part.filter("p_type <> 'STANDARD'").select(
        F.concat(F.lit("PACK_"), "p_type").alias("pack_id"), F.col("p_type").alias("product_class")).distinct()
    pack_licences = spark.createDataFrame(
        [("PACK_PROMO", "BUILDING"), ("PACK_PROMO", "MACHINERY"), ("PACK_SMALL", "MACHINERY"), ("PACK_LARGE", "FURNITURE")],
        "pack_id string, licence string")
    products = (
        holdings(spark, sf).join(part.filter("p_size = 50 AND p_retailprice < 1000"), F.col("target_id") == F.col("p_partkey"))
        .join(customer, F.col("entity_id") == F.col("c_custkey"))
        .select(F.col("c_nationkey").alias("profile_id"), F.col("p_type").alias("product_class")).distinct())
    licences = customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("profile_id"), F.col("c_mktsegment").alias("licence")).distinct()
    return ro.select_packs(profiles, pack_products.select("pack_id").distinct(), products, licences, pack_products, pack_licences)


@query("jon11_select_packs", "JON11", "UDF05", sql=f"WITH {PACKS_SQL} SELECT * FROM selections")
def jon11_select_packs(spark, sf):
    return selections(spark, sf)


@query("agg33_resolution", "AGG33", "JON42", sql=f"""
WITH {PACKS_SQL},
sc AS (SELECT DISTINCT p_brand AS scope_id, 'PACK_' || p_type AS pack_id FROM part WHERE p_type <> 'STANDARD'),
r AS (SELECT profile_id, scope_id, string_agg(pack_id, '; ' ORDER BY pack_id) FILTER (status <> 'NOT_SELECTED') AS packs FROM selections JOIN sc USING (pack_id) GROUP BY ALL)
SELECT profile_id, scope_id, coalesce(packs, '') AS packs, CASE WHEN packs IS NULL THEN 'PACK_NOT_SELECTED' ELSE 'ROUTED' END AS state FROM r""")
def agg33_resolution(spark, sf):
    scopes = table(spark, sf, "part").filter("p_type <> 'STANDARD'").select(
        F.col("p_brand").alias("scope_id"), F.concat(F.lit("PACK_"), "p_type").alias("pack_id")).distinct()
    routed = F.collect_set(F.when(F.col("status") != "NOT_SELECTED", F.col("pack_id")))
    out = selections(spark, sf).join(scopes, "pack_id").groupBy("profile_id", "scope_id").agg(F.array_join(F.array_sort(routed), "; ").alias("packs"))
    return out.withColumn("state", F.when(F.col("packs") == "", "PACK_NOT_SELECTED").otherwise("ROUTED"))


@query("jon12_guidance_conflicts", "JON12", sql=f"""
WITH {sq.PRODUCTS}, d AS (SELECT *, split_part(scope_id, '/', 1) AS topic, split_part(scope_id, '/', 2) AS pack FROM pdecisions)
SELECT DISTINCT g.scope_id, g.target_id FROM d g JOIN d b ON b.target_id = g.target_id AND b.pack = g.pack
  AND b.topic = CASE g.topic WHEN 'PROMO' THEN 'SMALL' WHEN 'LARGE' THEN 'MEDIUM' END
WHERE g.status = 'APPLIES' AND b.status = 'DOES_NOT_APPLY'""")
def jon12_guidance_conflicts(spark, sf):
    topic, pack = F.split("scope_id", "/")[0], F.split("scope_id", "/")[1]
    d = product_decisions(spark, sf).select("scope_id", "target_id", "status", (~topic.isin("PROMO", "LARGE")).alias("binding"))
    about = F.when(topic == "PROMO", "SMALL").when(topic == "LARGE", "MEDIUM")
    interprets = ad.product_scopes(spark, sf).select("scope_id", F.concat(about, F.lit("/"), pack).alias("interpreted")).filter("interpreted IS NOT NULL")
    return ro.guidance_conflicts(d, interprets)


INFORCE_SQL = f"""{sq.ENTITIES},
docs AS (SELECT s_suppkey AS document_id, CASE WHEN s_suppkey % 3 = 0 THEN 'LEGAL_ENTITY' ELSE 'GROUP' END AS owner_level,
  CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 7 ELSE s_nationkey END::BIGINT AS owner_id, s_suppkey % 5 <> 0 AS inherits,
  CASE WHEN s_suppkey % 4 = 0 THEN ['SELL', 'STORE'] ELSE []::VARCHAR[] END AS limited_to FROM supplier),
reach AS (SELECT target_id, document_id, owner_level, limited_to, activity_classes, activities_complete FROM docs JOIN entities
  ON (owner_level = 'GROUP' AND inherits AND owner_id = group_id) OR (owner_level = 'LEGAL_ENTITY' AND owner_id = target_id)),
inforce AS (SELECT target_id, document_id, owner_level, CASE WHEN len(limited_to) = 0 OR coalesce(list_has_any(activity_classes, limited_to), false) THEN 'YES'
  WHEN activities_complete THEN 'NO' ELSE 'UNKNOWN' END AS covers FROM reach)"""


def in_force(spark, sf):
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    own = key % 3 == 0
    docs = s.select(
        key.alias("document_id"), F.when(own, "LEGAL_ENTITY").otherwise("GROUP").alias("owner_level"),
        F.when(own, key * 7).otherwise(F.col("s_nationkey").cast("bigint")).alias("owner_id"), (key % 5 != 0).alias("inherits"),
        F.when(key % 4 == 0, F.array(F.lit("SELL"), F.lit("STORE"))).otherwise(F.array().cast("array<string>")).alias("limited_to"))
    return ro.documents_in_force(docs, ad.entities(spark, sf).withColumn("group_id", F.col("group_id").cast("bigint")))


@query("jon13_documents_in_force", "JON13", sql=f"WITH {INFORCE_SQL} SELECT * FROM inforce")
def jon13_documents_in_force(spark, sf):
    return in_force(spark, sf)


@query("jon18_product_findings", "JON18", sql=f"""
WITH {sq.PRODUCTS},
limits(product_class, attribute, comparator, lim) AS (VALUES ('PROMO', 'size', 'le', 30.0::DOUBLE), ('SMALL', 'size', 'ge', 12.0), ('LARGE', 'price', 'lt', 1200.0), ('ECONOMY', 'price', 'eq', 950.0)),
v AS (SELECT target_id, product_class, attribute, comparator, lim, CASE attribute WHEN 'size' THEN size ELSE price END AS stated FROM products JOIN limits USING (product_class) WHERE comparator <> 'eq')
SELECT target_id, attribute, stated, lim AS limit_value, CASE WHEN (comparator IN ('le', 'lt') AND stated <= lim) OR (comparator NOT IN ('le', 'lt') AND stated >= lim) THEN 'WITHIN_LIMIT' ELSE 'EXCEEDS_LIMIT' END AS result
FROM v WHERE stated IS NOT NULL""")
def jon18_product_findings(spark, sf):
    limits = spark.createDataFrame(
        [("PROMO", "size", "le", 30.0), ("SMALL", "size", "ge", 12.0), ("LARGE", "price", "lt", 1200.0), ("ECONOMY", "price", "eq", 950.0)],
        "product_class string, attribute string, comparator string, limit_value double")
    stated = ad.products(spark, sf).select(
        "target_id", "product_class", F.explode(F.map_from_arrays(F.array(F.lit("size"), F.lit("price")), F.array("size", "price")))
        .alias("attribute", "stated")).filter("stated IS NOT NULL")
    cap = F.col("comparator").isin("le", "lt")
    inside = F.when(cap, F.col("stated") <= F.col("limit_value")).otherwise(F.col("stated") >= F.col("limit_value"))
    return stated.join(F.broadcast(limits.filter("comparator <> 'eq'")), ["product_class", "attribute"]).select(
        "target_id", "attribute", "stated", "limit_value", F.when(inside, "WITHIN_LIMIT").otherwise("EXCEEDS_LIMIT").alias("result"))


@query("fun34_applicability_reviews", "FUN34", sql=f"""
WITH {sq.ENTITIES}
SELECT scope_id || ':' || target_id AS review_id, CASE WHEN reasons LIKE '%REGULATORY_SCOPE_UNCLEAR%' THEN 'CLARIFY_REGULATORY_SCOPE' ELSE 'COMPLETE_PROFILE_FACT' END AS review_type,
  concat_ws('; ', CASE WHEN fe IS NULL THEN 'ENTITY' END, CASE WHEN ca AND fa IS NULL THEN 'ACTIVITY' END) AS missing_facts,
  concat_ws('; ', CASE WHEN fe IS NOT NULL THEN 'ENTITY' END, CASE WHEN ca AND fa IS NOT NULL THEN 'ACTIVITY' END) AS known_facts
FROM decisions WHERE status = 'UNKNOWN'""")
def fun34_applicability_reviews(spark, sf):
    names = lambda unknown: F.array_join(F.transform(
        F.filter("gates", lambda g: (g["fact"] == "UNKNOWN") if unknown else (g["fact"] != "UNKNOWN")), lambda g: g["gate"]), "; ")
    return decisions(spark, sf).filter("status = 'UNKNOWN'").select(
        F.concat_ws(":", "scope_id", "target_id").alias("review_id"), ro.review_type(F.col("reasons")).alias("review_type"),
        names(True).alias("missing_facts"), names(False).alias("known_facts"))


@query("agg07_profile_questions", "AGG07", "SRC19", sql=f"""
WITH {sq.ENTITIES},
m AS (SELECT target_id, 'ENTITY' AS gate, scope_id, needs_entity AS required, entity_classes AS stated FROM decisions WHERE status = 'UNKNOWN' AND NOT unclear AND fe IS NULL
  UNION ALL SELECT target_id, 'ACTIVITY', scope_id, needs_activity, activity_classes FROM decisions WHERE status = 'UNKNOWN' AND NOT unclear AND ca AND fa IS NULL),
x AS (SELECT target_id, gate, scope_id, unnest(required) AS v, stated FROM m)
SELECT target_id, gate, count(DISTINCT scope_id)::BIGINT AS blocked_reviews,
  coalesce(string_agg(DISTINCT v, '; ' ORDER BY v) FILTER (NOT list_contains(coalesce(stated, []::VARCHAR[]), v)), '') AS asked FROM x GROUP BY ALL""")
def agg07_profile_questions(spark, sf):
    open_rows = decisions(spark, sf).filter("status = 'UNKNOWN' AND NOT unclear")
    unknown = lambda name: F.exists("gates", lambda g: (g["gate"] == name) & (g["fact"] == "UNKNOWN"))
    side = lambda name, needs, has: open_rows.filter(unknown(name)).select(
        "target_id", F.lit(name).alias("gate"), F.col("scope_id").alias("review_id"), F.col(needs).alias("required"), F.col(has).alias("stated"))
    return ro.profile_questions(
        side("ENTITY", "needs_entity", "entity_classes").unionByName(side("ACTIVITY", "needs_activity", "activity_classes")))


@query("jon24_change_impact", "JON24", sql=f"""
WITH {sq.ENTITIES},
after AS (SELECT scope_id, target_id, CASE WHEN target_id % 6 = 0 THEN NULL WHEN target_id % 5 = 0 AND status = 'UNKNOWN' THEN 'APPLIES' WHEN target_id % 11 = 0 THEN 'DOES_NOT_APPLY' ELSE status END AS now FROM decisions),
j AS (SELECT scope_id, target_id, CASE WHEN target_id % 13 = 0 THEN NULL ELSE d.status END AS was, a.now, binding FROM decisions d JOIN after a USING (scope_id, target_id)),
k AS (SELECT *, coalesce(was IN ('APPLIES', 'PARTIAL'), false) AS b, coalesce(now IN ('APPLIES', 'PARTIAL'), false) AS n, coalesce(now, was) = 'UNKNOWN' AS u FROM j)
SELECT scope_id, target_id, was, now, CASE WHEN n AND NOT b THEN 'NEWLY_APPLIES' WHEN b AND NOT n AND u THEN 'UNKNOWN' WHEN b AND NOT n THEN 'NO_LONGER_APPLIES'
  WHEN b AND n AND NOT binding THEN 'UNCHANGED' WHEN b AND n THEN 'CHANGED_REQUIREMENT' ELSE 'UNKNOWN' END AS delta FROM k WHERE b OR n OR u""")
def jon24_change_impact(spark, sf):
    d = decisions(spark, sf).select("scope_id", "target_id", "status", "binding")
    t = F.col("target_id")
    before = d.filter(t % 13 != 0).select("scope_id", "target_id", F.col("status").alias("was"))
    later = (
        F.when((t % 5 == 0) & (F.col("status") == "UNKNOWN"), "APPLIES").when(t % 11 == 0, "DOES_NOT_APPLY").otherwise(F.col("status")))
    after = d.filter(t % 6 != 0).select("scope_id", "target_id", later.alias("now"))
    kinds = ad.entity_scopes(spark, sf).select("scope_id", (~F.col("binding")).alias("wording_only"))
    joined = before.join(after, ["scope_id", "target_id"], "full_outer").join(kinds, "scope_id")
    delta = ro.impact_delta(F.col("was"), F.col("now"), F.col("wording_only"))
    return joined.withColumn("delta", delta).filter("delta IS NOT NULL").select("scope_id", "target_id", "was", "now", "delta")


@query("jon30_apply_answers", "JON30", sql=f"""
WITH {sq.ENTITIES},
ans AS (SELECT target_id, ['SELL'] AS said FROM entities WHERE target_id % 9 = 0),
n AS (SELECT d.scope_id, d.target_id, d.status AS before, CASE WHEN unclear THEN 'UNKNOWN' WHEN fe = false OR (ca AND NOT list_has_any(list_concat(coalesce(activity_classes, []::VARCHAR[]), said), needs_activity)) THEN 'DOES_NOT_APPLY'
   WHEN fe IS NULL THEN 'UNKNOWN' ELSE 'APPLIES' END AS after FROM decisions d JOIN ans USING (target_id))
SELECT * FROM n""")
def jon30_apply_answers(spark, sf):
    e = ad.entities(spark, sf)
    answers = e.filter("target_id % 9 = 0").select("target_id", F.array(F.lit("SELL")).alias("said"))
    # only the targets an answer changed are routed again
    changed = e.join(answers, "target_id").withColumn(
        "activity_classes", F.array_union(F.coalesce("activity_classes", F.array().cast("array<string>")), F.col("said"))).withColumn(
        "activities_complete", F.lit(True)).drop("said")
    pairs = changed.join(ad.entity_scopes(spark, sf), "pack_id")
    entity = ro.list_fact(F.col("entity_classes"), F.col("complete"), F.col("needs_entity"))
    activity = ro.list_fact(F.col("activity_classes"), F.col("activities_complete"), F.col("needs_activity"))
    gates = [ro.gate("ENTITY", entity, F.size("needs_entity") > 0), ro.gate("ACTIVITY", activity, F.size("needs_activity") > 0)]
    after = ro.decide(pairs, gates, F.col("unclear"), F.col("binding")).select("scope_id", "target_id", F.col("status").alias("after"))
    before = decisions(spark, sf).select("scope_id", "target_id", F.col("status").alias("before"))
    return before.join(after, ["scope_id", "target_id"])


@query("jon33_addressees", "JON33", sql="""
SELECT c_custkey AS target_id, n_nationkey AS decision_id, CASE WHEN c_custkey % 50 = n_nationkey THEN 'APPLIES' ELSE 'DOES_NOT_APPLY' END AS status,
  CASE WHEN c_custkey % 50 = n_nationkey THEN 'NAMED_ADDRESSEE' ELSE 'NOT_ADDRESSED' END AS reason FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def jon33_addressees(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("target_id"), F.col("c_nationkey").alias("decision_id"))
    named = c.filter("target_id % 50 = decision_id").withColumn("_named", F.lit(True))
    hit = F.col("_named").isNotNull()
    return c.join(named, ["target_id", "decision_id"], "left").select(
        "target_id", "decision_id", F.when(hit, "APPLIES").otherwise("DOES_NOT_APPLY").alias("status"),
        F.when(hit, "NAMED_ADDRESSEE").otherwise("NOT_ADDRESSED").alias("reason"))


@query("set04_pack_closure", "SET04", sql="""
WITH RECURSIVE e AS (SELECT n_name AS pack_id, 'NATION_' || (n_nationkey - 3) AS included FROM nation WHERE n_nationkey >= 3),
p AS (SELECT n_name AS pack_id FROM nation),
c(pack_id, member) AS (SELECT pack_id, pack_id FROM p UNION SELECT c.pack_id, e.included FROM c JOIN e ON c.member = e.pack_id)
SELECT pack_id, member, count(DISTINCT c_custkey)::BIGINT AS regulations FROM c JOIN nation ON member = n_name LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def set04_pack_closure(spark, sf):
    n = table(spark, sf, "nation")
    packs = n.select(F.col("n_name").alias("pack_id"))
    includes = n.filter("n_nationkey >= 3").select(F.col("n_name").alias("pack_id"), F.concat(F.lit("NATION_"), F.col("n_nationkey") - 3).alias("included"))
    members = ro.include_closure(includes, packs).join(n, F.col("member") == F.col("n_name"))
    per_nation = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("regulations"))
    return members.join(per_nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        "pack_id", "member", F.coalesce("regulations", F.lit(0)).cast("bigint").alias("regulations"))


@query("set05_registry_checks", "SET05", sql="""
WITH dup AS (SELECT l_orderkey || ':' || l_linenumber AS item, 'DUPLICATE_ID' AS problem FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1),
ref AS (SELECT l_orderkey::VARCHAR AS item, 'UNKNOWN_PART' AS problem FROM lineitem WHERE l_partkey % 13 = 0 AND l_partkey + 1000000 NOT IN (SELECT p_partkey FROM part)),
def AS (SELECT p_name AS item, 'CONFLICTING_DEFINITION' AS problem FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1)
SELECT problem, count(*)::BIGINT AS n, count(DISTINCT item)::BIGINT AS items FROM (SELECT * FROM dup UNION ALL SELECT * FROM ref UNION ALL SELECT * FROM def) GROUP BY problem""")
def set05_registry_checks(spark, sf):
    x, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    broken = x.filter("l_partkey % 13 = 0").select("l_orderkey", (F.col("l_partkey") + 1000000).alias("ref"))
    conflicting = part.groupBy(F.col("p_name").alias("item")).agg(F.count_distinct("p_type").alias("_n")).filter("_n > 1").select(
        "item", F.lit("CONFLICTING_DEFINITION").alias("problem"))
    found = ro.duplicates(x, ["l_orderkey", "l_linenumber"], "DUPLICATE_ID").unionByName(
        ro.unknown_references(broken, "ref", F.col("l_orderkey"), part, "p_partkey", "UNKNOWN_PART")).unionByName(conflicting)
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("items"))


#: Which pack includes which: rings of five, chains, some packs that include themselves, and steps between groups of a block of 25.
INCLUDES = (
    "SELECT c_custkey AS pack_id, CASE WHEN (c_custkey - 1) % 5 = 4 THEN c_custkey - 4 ELSE c_custkey + 1 END AS included FROM customer WHERE CAST(floor((c_custkey - 1) / 5) AS BIGINT) % 3 = 0 "
    "UNION ALL SELECT c_custkey, c_custkey + 1 FROM customer WHERE CAST(floor((c_custkey - 1) / 5) AS BIGINT) % 3 <> 0 AND (c_custkey - 1) % 5 < 4 "
    "UNION ALL SELECT c_custkey, c_custkey FROM customer WHERE c_custkey % 41 = 0 "
    "UNION ALL SELECT c_custkey, c_custkey + 5 FROM customer WHERE c_custkey % 7 = 0 AND (c_custkey - 1) % 25 < 20 "
    "UNION ALL SELECT c_custkey, c_custkey - 5 FROM customer WHERE c_custkey % 6 = 0 AND (c_custkey - 1) % 25 >= 5")


@query("set05_include_cycles", "SET05", sql=f"""
WITH RECURSIVE e AS ({INCLUDES}),
r(a, b) AS (SELECT pack_id, included FROM e UNION SELECT r.a, e.included FROM r JOIN e ON r.b = e.pack_id),
s AS (SELECT x.a AS node, min(x.b) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT node, cycle, count(*) OVER (PARTITION BY cycle) AS size FROM s""")
def set05_include_cycles(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    return cycles(spark.sql(INCLUDES), "pack_id", "included")


@query("set06_profile_graph", "SET06", sql="""
WITH f AS (SELECT s_suppkey AS facility_id, s_suppkey * 13 AS entity_id FROM supplier)
SELECT facility_id::VARCHAR AS item, 'FACILITY_OF_UNKNOWN_ENTITY' AS problem FROM f WHERE entity_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT i.id::VARCHAR, 'ID_USED_TWICE' FROM (SELECT s_suppkey * 13 AS id FROM supplier UNION ALL SELECT c_custkey FROM customer) i GROUP BY i.id HAVING count(*) > 1""")
def set06_profile_graph(spark, sf):
    facilities = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("facility_id"), (F.col("s_suppkey") * 13).alias("entity_id"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    orphans = ro.unknown_references(facilities, "entity_id", F.col("facility_id"), customers, "id", "FACILITY_OF_UNKNOWN_ENTITY")
    ids = facilities.select(F.col("entity_id").alias("id")).unionByName(customers)
    return orphans.unionByName(ro.duplicates(ids, ["id"], "ID_USED_TWICE"))


@query("set09_channel_facts", "SET09", sql="""
WITH e AS (SELECT user_id, list_distinct(list(event_type)) AS used FROM events GROUP BY user_id),
s AS (SELECT user_id, used, CASE WHEN user_id % 2 = 0 THEN ['view', 'click'] ELSE ['view', 'click', 'purchase', 'signup', 'error'] END AS stated, user_id % 4 = 0 AS complete FROM e)
SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(stated, used))), '; ') AS channels,
  CASE WHEN complete THEN array_to_string(list_sort(list_filter(used, lambda u: NOT list_contains(stated, u))), '; ') ELSE '' END AS conflicts FROM s""")
def set09_channel_facts(spark, sf):
    used = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("used"))
    few, every = ["view", "click"], ["view", "click", "purchase", "signup", "error"]
    lits = lambda names: F.array(*[F.lit(n) for n in names])
    stated = F.when(F.col("user_id") % 2 == 0, lits(few)).otherwise(lits(every))
    missing = F.array_join(F.array_sort(F.array_except("used", stated)), "; ")
    return used.select(
        "user_id", F.array_join(F.array_sort(F.array_union(stated, "used")), "; ").alias("channels"),
        F.when(F.col("user_id") % 4 == 0, missing).otherwise("").alias("conflicts"))


@query("fun37_derived_facts", "FUN37", sql=f"""
WITH {sq.PRODUCTS}
SELECT product_class, CASE WHEN size IS NULL AND product_class IN ('SMALL', 'PROMO') THEN 'UNKNOWN' WHEN size >= 25 THEN 'ABOVE_THRESHOLD' WHEN size IS NOT NULL THEN 'BELOW_THRESHOLD' ELSE 'CLASS_DEFAULT' END AS category,
  count(*)::BIGINT AS products FROM products GROUP BY ALL""")
def fun37_derived_facts(spark, sf):
    size = F.col("size")
    category = (
        F.when(size >= 25, "ABOVE_THRESHOLD").when(size.isNotNull(), "BELOW_THRESHOLD")
        .when(F.col("product_class").isin("SMALL", "PROMO"), "UNKNOWN").otherwise("CLASS_DEFAULT"))
    return ad.products(spark, sf).groupBy("product_class", category.alias("category")).agg(F.count(F.lit(1)).alias("products"))
