"""Model tables derived from the given tables (the same derivations as the SQL fragments)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import spread, table


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """One row per non-empty line of a document."""
    docs = spread(table(spark, sf, "documents"))
    lines = docs.select("doc_id", "source", "lang", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "text"))
    return lines.withColumn("line_no", F.col("line_no").cast("bigint")).filter(F.trim("text") != "")


def duties(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", "text")


def vector_duties(spark: SparkSession, sf: str) -> DataFrame:
    """Duties that have a vector: (query_id, vector, terms, text, label)."""
    vectors = table(spark, sf, "embeddings")
    return duties(spark, sf).join(vectors, F.col("item_id") == F.col("vec_id")).select(
        F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"),
        tx.lexical_terms(F.col("text")).alias("terms"), "text", "label")


def vector_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have a vector, as passages: (passage_id, vector, terms, text, label)."""
    vectors = table(spark, sf, "embeddings")
    return table(spark, sf, "documents").join(vectors, F.col("doc_id") == F.col("vec_id")).select(
        F.col("doc_id").alias("passage_id"), F.col("embedding").alias("vector"),
        tx.lexical_terms(F.col("text")).alias("terms"), "text", "label")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Expectations (labels) beside the predictions of a length rule, one row per labelled document."""
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    good, toxic, size = F.col("quality") == 1, F.col("toxic") == 1, F.col("n_chars")
    return joined.select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic",
        F.when(good & ~toxic, "APPLIES").when(~good & ~toxic, "DOES_NOT_APPLY").otherwise("UNKNOWN").alias("expected"),
        F.when(size >= 2000, "APPLIES").when(size >= 900, "DOES_NOT_APPLY").when(size >= 300, "UNKNOWN").otherwise("UNREAD").alias("predicted"),
        F.when(F.col("lang") == "en", "HUMAN_REVIEWED").when(F.col("lang") == "fr", "MANUAL_LEGAL_READING").alias("row_source"),
        F.when(F.col("source") == "src3", "SYNTHETIC_CONTROLLED").alias("field_source"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as a log of model calls."""
    return as_calls(table(spark, sf, "events"))


def as_calls(events: DataFrame) -> DataFrame:
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    k, user = F.col("k"), F.col("user_id")
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("call_id"), F.col("ts").alias("at"), F.concat(F.lit("run_"), user % 5).alias("run_id"),
        F.when(F.col("event_type") == "view", "judge.passage").when(F.col("event_type") == "click", "judge.scope")
        .otherwise(F.col("event_type")).alias("task"),
        F.concat(F.lit("model_"), user % 3).alias("model"), (F.lit(4096) * (user % 2 + 1)).cast("bigint").alias("num_ctx"),
        F.round(F.col("value") * 1000).cast("bigint").alias("elapsed_ms"), (k % 5 == 0).alias("cache_hit"), (k % 3 == 0).alias("thinking"),
        F.when(failed & (k % 7 == 0), "CIRCUIT_OPEN").when(failed, "FAILED").otherwise("OK").alias("status"),
        F.when(failed & (k % 2 == 0), F.concat(F.lit("E_"), (k % 4).cast("string"))).alias("failure_code"),
        F.when(failed & (k % 2 == 0), "time limit reached").when(failed, "bad answer").alias("error"),
        (k % 4).alias("retry_count"), k.alias("prompt_tokens"), (k % 17).alias("output_tokens"), (k * 10).alias("load_duration_ms"),
        F.when(k % 6 != 0, F.when(k % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.8))).alias("gpu_fraction"),
        (k % 23).cast("double").alias("tokens_per_second"),
        F.element_at(F.array(*[F.lit(a) for a in ("fits", "compressed", "fallback_large", "trimmed")]), (k % 4 + 1).cast("int"))
        .alias("window_action"), user.alias("user_id"), F.date_trunc("hour", "ts").alias("hour"))


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """Orders read as captures of official texts: a regulation per customer, content and parser per order."""
    return as_captures(table(spark, sf, "orders"))


def as_captures(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_custkey").alias("regulation_id"), F.col("o_orderkey").alias("capture_id"), F.col("o_orderdate").alias("fetched_at"),
        F.sha2(F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1)), 256).alias("content_hash"),
        F.concat(F.lit("parser-"), F.when(F.col("o_orderdate") >= "1998-06-01", 2).otherwise(1)).alias("parser_version"),
        F.date_trunc("year", "o_orderdate").alias("year"))


def provisions(spark: SparkSession, sf: str, later: bool = False) -> DataFrame:
    """Lineitems rendered as provisions of a version (an order). ``later`` is the next snapshot: some provisions are gone,
    some have another quantity, some are new."""
    return as_provisions(table(spark, sf, "lineitem"), later)


def as_provisions(lineitem: DataFrame, later: bool = False) -> DataFrame:
    x = lineitem.select(
        F.col("l_orderkey").alias("version_id"), F.col("l_returnflag").alias("section"), F.col("l_linenumber").alias("number"),
        "l_partkey", "l_suppkey", "l_linestatus", "l_quantity", "l_discount", "l_extendedprice", "l_shipdate")
    if later:
        x = x.filter(F.col("l_partkey") % 10 != 0).withColumn(
            "l_quantity", F.when(F.col("l_suppkey") % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
        x = x.withColumn("number", F.explode(F.when(F.col("l_partkey") % 11 == 0, F.array("number", F.col("number") + 10))
                                             .otherwise(F.array("number"))))
    quantity, reference = F.floor("l_quantity"), F.col("l_partkey") % 9 + 1
    text = (
        F.when(F.col("section") == "A", F.concat(
            F.lit("A firm must report within "), quantity, F.lit(" days of the event, unless exempted under article "), reference, F.lit(".")))
        .when(F.col("section") == "N", F.concat(
            F.lit("The rate must not exceed "), F.floor(F.col("l_discount") * 100 + 0.5), F.lit("% of GBP "), F.floor("l_extendedprice"),
            F.lit(" where article "), reference, F.lit(" applies.")))
        .otherwise(F.concat(
            F.lit("A firm may keep the record for at least "), quantity, F.lit(" years in accordance with article "), reference, F.lit(".")))
    )
    return x.select("version_id", "section", F.col("number").cast("bigint").alias("number"), text.alias("text"), "l_partkey", "l_suppkey",
                    "l_linestatus", "l_quantity", "l_discount", "l_extendedprice", F.col("l_shipdate").alias("dated"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as legal entities of a group (their nation) with class lists that may be incomplete."""
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    activities = F.array(F.lit("PRODUCE"), F.lit("IMPORT"), F.lit("SELL"), F.lit("STORE"))
    return c.select(
        key.alias("target_id"), F.col("c_nationkey").alias("group_id"), F.col("n_regionkey").alias("pack_id"),
        F.array("c_mktsegment").alias("entity_classes"), (F.col("c_acctbal") > 0).alias("complete"),
        F.when(key % 7 != 0, F.slice(activities, (key % 4 + 1).cast("int"), 1)).alias("activity_classes"),
        (F.col("c_acctbal") > 4000).alias("activities_complete"))


def entity_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """One scope per region and market segment."""
    segments = table(spark, sf, "customer").select("c_mktsegment").distinct()
    s = table(spark, sf, "region").join(segments)
    key = F.col("r_regionkey")
    wanted = (
        F.when(key % 3 == 0, F.array(F.lit("SELL"))).when(key % 3 == 1, F.array(F.lit("IMPORT"), F.lit("STORE")))
        .otherwise(F.array().cast("array<string>")))
    return s.select(
        F.concat_ws("/", "r_name", "c_mktsegment").alias("scope_id"), key.alias("pack_id"), F.array("c_mktsegment").alias("needs_entity"),
        wanted.alias("needs_activity"), (key == 4).alias("unclear"), (key != 2).alias("binding"))


def products(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("target_id"), F.col("p_type").alias("product_class"), F.split("p_name", " ").alias("tags"),
        (F.col("p_size") % 3 != 0).alias("tags_complete"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("double")).alias("size"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("price"),
        (F.substring("p_brand", 7, 5).cast("bigint") % 5).alias("pack_id"))


def product_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """One product scope per product class and pack, with a size condition, a price exception and a tag."""
    types = table(spark, sf, "part").select("p_type").distinct()
    s = types.join(table(spark, sf, "region").select("r_regionkey"))
    key = F.col("r_regionkey").cast("bigint")
    return s.select(
        F.concat_ws("/", "p_type", "r_regionkey").alias("scope_id"), key.alias("pack_id"), F.col("p_type").alias("needs_class"),
        (key * 5 + 5).cast("double").alias("min_size"), F.lit(1500.0).alias("exempt_price"),
        F.when(key == 3, F.array(F.lit("red"), F.lit("blue"), F.lit("green"))).otherwise(F.array().cast("array<string>")).alias("needs_tags"))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitems read as relations between a duty (order) and a passage (part)."""
    x = table(spark, sf, "lineitem")
    flag, status, number = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    relation = (
        F.when((flag == "R") & (status == "O") & (F.col("l_quantity") > 45), "CONFLICTS")
        .when((flag == "A") & (status == "F"), "SUPPORTS").when((flag == "R") & (status == "F"), "SUPPORTS")
        .when((flag == "A") | (flag == "R"), "PARTIAL").when(status == "F", "UNCLEAR").otherwise("UNRELATED"))
    ids = F.array(F.lit("act_1"), F.lit("deadline_1"), F.lit("item_1"))
    part = F.col("l_partkey")
    bit = lambda n: (F.floor(part / n) % 2 == 1)
    pick = lambda on: F.array_compact(F.array(*[F.when(on(n), F.get(ids, F.lit(i))) for i, n in enumerate((1, 2, 4))]))
    return x.select(
        F.col("l_orderkey").alias("duty_id"), part.alias("passage_id"), number.alias("number"), relation.alias("relation"),
        (F.col("l_suppkey") % 5 == 0).alias("is_control"), F.concat(F.lit("R"), number).alias("reason"),
        F.when(F.col("l_suppkey") % 3 == 0, "strong").otherwise("weak").alias("uncertainty"),
        pick(bit).alias("covered"), pick(lambda n: ~bit(n)).alias("missing"),
        F.when(part % 3 == 0, F.array(F.lit("deadline_1"))).otherwise(F.array().cast("array<string>")).alias("numbers_met"),
        (F.col("l_suppkey") % 2 == 0).alias("strong"), ((part % 7 == 0) & (relation == "UNRELATED")).alias("rejected"),
        (part % 11 == 0).alias("failed"), "l_suppkey", "l_quantity", "l_discount", "l_extendedprice", "l_shipdate")


def with_utc(df: DataFrame, column: str) -> DataFrame:
    """The wall-clock column as an instant, which event-time windows and watermarks need (the session zone is UTC)."""
    return df.withColumn(column, F.col(column).cast("timestamp"))
