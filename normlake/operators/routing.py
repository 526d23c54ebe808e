"""Applicability routing in three-valued logic.

A fact is a nullable boolean: TRUE, FALSE or NULL for "the profile does not say". Empty and missing lists stay apart: a
list that is not stated complete leaves a missing value unknown. Scopes meet targets on an equi-key (the pack of the
scope and of the profile), never as a product of the two tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# The reason code each dimension answers with.
CODE_OF = {"entity_classes": "ENTITY", "activity_classes": "ACTIVITY", "sales_channels": "CHANNEL", "license_classes": "LICENSE"}
POSITIVE = ("APPLIES", "PARTIAL")


def list_fact(values: Column, complete: Column, required: Column, ceiling: Column | None = None) -> Column:
    """Does a list of stated classes meet the required ones? Unknown unless it does or the list (or the ceiling, what the
    owner states in full) rules it out."""
    hit = F.coalesce(F.arrays_overlap(values, required), F.lit(False))
    fact = F.when(hit, F.lit(True)).when(F.coalesce(complete, F.lit(False)), F.lit(False))
    if ceiling is not None:
        fact = fact.when(ceiling.isNotNull() & ~F.coalesce(F.arrays_overlap(ceiling, required), F.lit(False)), F.lit(False))
    return fact


def compare_fact(value: Column, op: str, wanted: Column) -> Column:
    """One typed predicate; an unstated value answers NULL."""
    tests = {"gt": value > wanted, "ge": value >= wanted, "lt": value < wanted, "le": value <= wanted, "eq": value == wanted}
    return tests[op]


def word(fact: Column) -> Column:
    return F.when(fact, "YES").when(~fact, "NO").otherwise("UNKNOWN")


def gate(name: str, fact: Column, constrained: Column) -> Column:
    """Gate struct of a dimension, NULL where the scope does not constrain it."""
    code = F.when(fact, f"{name}_MATCH").when(~fact, f"{name}_MISMATCH").otherwise("PROFILE_INCOMPLETE")
    return F.when(constrained, F.struct(F.lit(name).alias("gate"), word(fact).alias("fact"), code.alias("code")))


def decide(pairs: DataFrame, gates: list[Column], unclear: Column, binding: Column, partial: Column | None = None) -> DataFrame:
    """Adds ``gates``, ``status`` and ``reasons`` (joined codes) to every (scope, target) row."""
    has = lambda fact: F.exists("gates", lambda g: g["fact"] == fact)
    codes = lambda fact: F.array_distinct(F.transform(F.filter("gates", lambda g: g["fact"] == fact), lambda g: g["code"]))
    some = F.lit(False) if partial is None else partial
    status = (
        F.when(unclear, "UNKNOWN").when(has("NO"), "DOES_NOT_APPLY").when(has("UNKNOWN"), "UNKNOWN").when(some, "PARTIAL").otherwise("APPLIES"))
    reasons = (
        F.when(unclear, F.array(F.lit("REGULATORY_SCOPE_UNCLEAR"))).when(has("NO"), codes("NO")).when(has("UNKNOWN"), codes("UNKNOWN"))
        .when(some, F.concat(codes("YES"), F.array(F.lit("PARTIAL_PRODUCT_SCOPE"))))
        .when(F.size("gates") == 0, F.array(F.lit("NO_CONSTRAINT"))).otherwise(codes("YES")))
    noted = F.when(binding, reasons).otherwise(F.concat(reasons, F.array(F.lit("GUIDANCE_ONLY"))))
    return (
        pairs.withColumn("gates", F.array_compact(F.array(*gates))).withColumn("status", status)
        .withColumn("reasons", F.array_join(noted, "; ")))


def product_fact(class_ok: Column, excluded: Column, condition: Column, exception: Column, tag: Column) -> Column:
    """Fact of one product against every product dimension; a dimension the scope does not name is passed as TRUE.

    ``exception`` TRUE takes the product out; an exception nobody can decide keeps it in scope.
    """
    facts = [class_ok, ~excluded, condition, ~F.coalesce(exception, F.lit(False)), tag]
    combined = facts[0]
    for fact in facts[1:]:
        combined = combined & fact
    return combined


def combine_children(decisions: DataFrame, parents: DataFrame, by: list[str], complete: Column) -> DataFrame:
    """Rolls child decisions up to their parent: all apply, some apply, some unknown, none.

    ``parents`` keeps a parent without children: DOES_NOT_APPLY when its list is complete, UNKNOWN when it is open.
    """
    counts = decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("children"), F.count_if(F.col("status") == "APPLIES").alias("_all"),
        F.count_if(F.col("status").isin(*POSITIVE)).alias("_some"), F.count_if(F.col("status") == "UNKNOWN").alias("_unknown"))
    joined = parents.join(counts, by, "left").fillna(0, ["children", "_all", "_some", "_unknown"])
    status = (
        F.when((F.col("children") == 0) & complete, "DOES_NOT_APPLY").when(F.col("children") == 0, "UNKNOWN")
        .when(F.col("_all") == F.col("children"), "APPLIES").when(F.col("_some") > 0, "PARTIAL")
        .when(F.col("_unknown") > 0, "UNKNOWN").otherwise("DOES_NOT_APPLY"))
    return joined.withColumn("status", status).select(*by, "children", "status")


def exclusive_licences(pack_licences: DataFrame) -> DataFrame:
    """Licences only one pack claims."""
    return pack_licences.groupBy("licence").agg(F.count_distinct("pack_id").alias("_n"), F.min("pack_id").alias("pack_id")).filter(
        "_n = 1").select("pack_id", "licence")


def select_packs(profiles: DataFrame, packs: DataFrame, products: DataFrame, licences: DataFrame,
                 pack_products: DataFrame, pack_licences: DataFrame) -> DataFrame:
    """Status of every pack for every profile from its products and its exclusive licences.

    ``profiles(profile_id, products_complete)``; ``products(profile_id, product_class)``; ``licences(profile_id, licence)``.
    """
    by_product = products.join(pack_products, "product_class").select("profile_id", "pack_id", F.lit(True).alias("_p")).distinct()
    by_licence = licences.join(exclusive_licences(pack_licences), "licence").select("profile_id", "pack_id", F.lit(True).alias("_l")).distinct()
    # the registry of packs is one small list; every profile states one status for each entry
    registry = packs.agg(F.collect_set("pack_id").alias("_packs"))
    grid = profiles.join(F.broadcast(registry)).withColumn("pack_id", F.explode("_packs")).drop("_packs")
    joined = grid.join(by_product, ["profile_id", "pack_id"], "left").join(by_licence, ["profile_id", "pack_id"], "left")
    hit = F.array_compact(F.array(F.when(F.col("_p"), F.lit("PRODUCT_MATCH")), F.when(F.col("_l"), F.lit("LICENSE_MATCH"))))
    status = F.when(F.size(hit) > 0, "SELECTED").when(F.col("products_complete"), "NOT_SELECTED").otherwise("UNKNOWN")
    reasons = (
        F.when(F.size(hit) > 0, F.array_join(hit, "; ")).when(F.col("products_complete"), "PRODUCT_MISMATCH").otherwise("PROFILE_INCOMPLETE"))
    return joined.select("profile_id", "pack_id", status.alias("status"), reasons.alias("reasons"))


def guidance_conflicts(decisions: DataFrame, interprets: DataFrame) -> DataFrame:
    """Guidance that applies where the binding text it interprets does not, on the same target."""
    guidance = decisions.filter("NOT binding AND status = 'APPLIES'").join(interprets, "scope_id")
    binding = decisions.filter("binding AND status = 'DOES_NOT_APPLY'").select(F.col("scope_id").alias("interpreted"), "target_id")
    return guidance.join(binding, ["interpreted", "target_id"], "left_semi").select("scope_id", "target_id").distinct()


#: Ids that a row of a block holds on average at most. Spark holds all rows that one row gives until they are made, here the
#: square of this: some thousands stay in the cache, a million fill the heap.
BLOCK_IDS = 128


def _blocks(rows: DataFrame, facts: list[str], ident: str) -> tuple[DataFrame, int]:
    """(facts..., _block, _ids) and the number of blocks: rows with equal facts as lists of some BLOCK_IDS ids."""
    most = rows.groupBy(*facts).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    n = -(-most // BLOCK_IDS)
    blocks = rows.withColumn("_block", F.pmod(F.xxhash64(ident), F.lit(n)).cast("int")).groupBy(*facts, "_block")
    return blocks.agg(F.collect_list(F.struct(ident)).alias(f"_{ident}s")), n


def documents_in_force(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, document_id, covers): group documents reach the group's entities when inherited, entity documents their
    entity; a document limited to activities asks whether the target states one of them.

    A group's documents meet all its entities, so the result is a product by nature. Blocks of documents with the same limits
    meet blocks of entities with the same activities: the question is answered once per pair of blocks, and only the ids are
    paired, in as many parts as there are blocks of entities, however few the groups are.
    """
    fact = list_fact(F.col("activity_classes"), F.col("activities_complete"), F.col("limited_to"))
    covers = F.when(F.size("limited_to") == 0, "YES").otherwise(word(fact)).alias("covers")
    states = ["activity_classes", "activities_complete"]
    inherited = documents.filter("owner_level = 'GROUP' AND inherits AND owner_id IS NOT NULL")
    docs, _ = _blocks(inherited, ["owner_id", "owner_level", "limited_to"], "document_id")
    members, n = _blocks(targets.select(F.col("group_id").alias("owner_id"), "target_id", *states).filter("owner_id IS NOT NULL"), ["owner_id", *states], "target_id")
    # parts are named, or few bytes of ids would be put into few tasks, and pairing costs more than moving
    spark = documents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    met = members.repartition(parts, "owner_id", "_block").join(
        docs.drop("_block").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(parts, "owner_id", "_block"), ["owner_id", "_block"])
    group = met.select("owner_level", covers, "_document_ids", F.inline("_target_ids")).select("target_id", "owner_level", "covers", F.inline("_document_ids"))
    entity = documents.filter("owner_level = 'LEGAL_ENTITY'").join(targets.select(F.col("target_id").alias("owner_id"), "target_id", *states), "owner_id")
    columns = ["target_id", "document_id", "owner_level", "covers"]
    return group.select(columns).unionByName(entity.select("target_id", "document_id", "owner_level", covers))


def include_closure(includes: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_id, member): every pack with the packs it includes, directly or through others, each once.

    Joins go on until one finds no pair that is not known yet, so chains of any length and cycles come to an end.
    """
    ensure_checkpoint_dir(packs.sparkSession)
    edges = includes.select(F.col("pack_id").alias("member"), F.col("included").alias("_next"))
    reached = packs.select("pack_id", F.col("pack_id").alias("member"))
    reached = reached.distinct().checkpoint()
    frontier = reached
    while True:
        further = frontier.join(edges, "member").select("pack_id", F.col("_next").alias("member")).distinct()
        frontier = further.join(reached, ["pack_id", "member"], "left_anti").checkpoint()
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier).checkpoint()


def duplicates(df: DataFrame, key: list[str], problem: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        F.concat_ws(":", *key).alias("item"), F.lit(problem).alias("problem"))


def unknown_references(df: DataFrame, column: str, item: Column, known: DataFrame, known_column: str, problem: str) -> DataFrame:
    wanted = df.select(item.cast("string").alias("item"), F.col(column).alias("_ref")).filter("_ref IS NOT NULL")
    return wanted.join(known.select(F.col(known_column).alias("_ref")), "_ref", "left_anti").select("item", F.lit(problem).alias("problem"))


def impact_delta(was: Column, now: Column, wording_only: Column) -> Column:
    """What a changed duty means for one target, from its routed status before and after."""
    before, after = was.isin(*POSITIVE), now.isin(*POSITIVE)
    before, after = F.coalesce(before, F.lit(False)), F.coalesce(after, F.lit(False))
    unknown = F.coalesce(now, was) == "UNKNOWN"
    return (
        F.when(~before & ~after & ~unknown, F.lit(None).cast("string")).when(after & ~before, "NEWLY_APPLIES")
        .when(before & ~after & unknown, "UNKNOWN").when(before & ~after, "NO_LONGER_APPLIES")
        .when(before & after & wording_only, "UNCHANGED").when(before & after, "CHANGED_REQUIREMENT").otherwise("UNKNOWN"))


def review_type(reasons: Column) -> Column:
    return (
        F.when(reasons.contains("GROUNDING_FAILED"), "CHECK_SOURCE_GROUNDING")
        .when(reasons.contains("REGULATORY_SCOPE_UNCLEAR"), "CLARIFY_REGULATORY_SCOPE")
        .when(reasons.contains("_PROFILE_CONFLICT"), "RESOLVE_PROFILE_CONFLICT").otherwise("COMPLETE_PROFILE_FACT"))


def profile_questions(missing: DataFrame) -> DataFrame:
    """One question per (target, gate) that blocks reviews; asks what is required and not stated.

    ``missing(target_id, gate, review_id, required, stated)``: the values are a closed vocabulary, so the sets stay small.
    """
    each = missing.select("target_id", "gate", "review_id", "stated", F.explode_outer("required").alias("_v"))
    asked = F.array_sort(F.array_except(F.collect_set("_v"), F.coalesce(F.first("stated"), F.array().cast("array<string>"))))
    return each.groupBy("target_id", "gate").agg(
        F.count_distinct("review_id").alias("blocked_reviews"), F.array_join(asked, "; ").alias("asked"))

