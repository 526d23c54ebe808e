"""Retention, redaction, tenants, exports of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which fields of a call record may leave at each level.
MINIMAL = ("call_id", "at", "task", "model", "status")
STANDARD = (*MINIMAL, "num_ctx", "thinking", "cache_hit", "elapsed_ms", "prompt_tokens", "output_tokens", "failure_code", "retry_count", "error")
ALLOWED_CALL_FIELDS = {"strict": MINIMAL[:4], "minimal": MINIMAL, "standard": STANDARD}
ERROR_LIMIT = 120
PASSAGE_CHARS, PASSAGE_WORDS = 200, 20
SECRET = r"(?i)(key|token|password|secret)[=: ]+[^ ]+"
SEGMENT = "([\\r\\n\\t\"“”«»\\[\\]{}=])"


def redact_calls(calls: DataFrame, level: str) -> DataFrame:
    """The columns a level allows; an error is masked and cut."""
    kept = [c for c in calls.columns if c in ALLOWED_CALL_FIELDS[level]]
    masked = F.substring(F.regexp_replace("error", SECRET, "$1=[masked]"), 1, ERROR_LIMIT).alias("error")
    return calls.select(*[masked if c == "error" else F.col(c) for c in kept])


def scrub(text: Column) -> Column:
    """Long prose between structural delimiters becomes ``[redacted N chars]``."""
    marked = F.regexp_replace(text, SEGMENT, "\u0001$1\u0001")
    def one(part: Column) -> Column:
        flat = F.trim(F.regexp_replace(part, "[ \t]+", " "))
        n = F.size(F.split(flat, " "))
        prose = (F.length(flat) > PASSAGE_CHARS) & ((n >= PASSAGE_WORDS) | (n == 1))
        return F.when(prose, F.concat(F.lit("[redacted "), F.length(part), F.lit(" chars]"))).otherwise(part)
    return F.array_join(F.transform(F.split(marked, "\u0001"), one), "")


def expired(runs: DataFrame, now: Column, days: int, keep_reviewed: bool = True) -> DataFrame:
    """Runs older than the window; what cannot be dated is not deleted, nor (by choice) what was reviewed."""
    old = F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS")
    return runs.filter(old & (F.col("reviews") == 0)) if keep_reviewed else runs.filter(old)


def delete_runs(runs: DataFrame, requested: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(runs kept, one outcome per requested id)."""
    wanted = requested.select(key).distinct()
    kept = runs.join(wanted, key, "left_anti")
    known = runs.select(key, F.lit(True).alias("_known")).distinct()
    outcome = F.when(F.col("_known"), "DELETED").otherwise("MISSING")
    return kept, wanted.join(known, key, "left").select(key, outcome.alias("outcome"))


def tenant_rows(df: DataFrame, tenant: Column, roles: DataFrame, granted: DataFrame, permission: str) -> DataFrame:
    """Rows of the caller's own tenant, for callers a role of theirs grants the permission.

    ``roles(user_id, tenant_id, role)``; ``granted(role, permission)``.
    """
    allowed = roles.join(F.broadcast(granted.filter(F.col("permission") == permission)), "role").select("user_id", "tenant_id").distinct()
    return df.filter(tenant.isNotNull()).withColumn("tenant_id", tenant).join(allowed, ["user_id", "tenant_id"], "left_semi")


def manifest(df: DataFrame, by: list[str], content: Column) -> DataFrame:
    """Row count, size and order-independent hash per exported part."""
    digest = F.sha2(content, 256)
    part = lambda start: F.sum(F.conv(F.substring(digest, start, 12), 16, 10).cast("decimal(38,0)"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.sum(F.length(content)).alias("chars"), part(1).alias("_a"), part(13).alias("_b")).select(
        *by, "records", "chars", F.sha2(F.concat_ws(":", "records", "_a", "_b"), 256).alias("sha256"))


def unsupported_reasons(status: Column, routed: Column, provision: Column, text: Column, quote: Column, fact: Column) -> Column:
    """Why a conclusion is not supported; an UNKNOWN concludes nothing."""
    own = F.array_compact(F.array(
        F.when(provision.isNull(), F.lit("NO_PROVISION")),
        F.when(text.isNull(), F.lit("SOURCE_NOT_STORED")).when(quote.isNull() | ~F.contains(text, quote), F.lit("QUOTE_NOT_IN_SOURCE")),
        F.when(fact.isNull(), F.lit("FACT_UNRESOLVED")), F.when(fact == "UNKNOWN", F.lit("FACT_UNKNOWN"))))
    none = F.array().cast("array<string>")
    return F.when(status == "UNKNOWN", none).when(routed, F.array(F.lit("NOT_GROUNDED"))).otherwise(own)
