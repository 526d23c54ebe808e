"""PII by candidate gradient boosting. DataFrame functions and Spark ML only.

Base kinds (email, ip, card, phone) are found by their patterns and checks, and always stay. Beside them, high-recall
generators propose further spans, overlapping where they will: anything that looks like an address, a long number, a
separated number, a key or a secret. Boosted trees judge each candidate from its format (length, digits, capitals, variety,
separators) and from its context (words before it, letters around it). They are fitted on distinct candidates, a bounded
number of each kind and label: those a check proves (Luhn, octets, mod 97, a named secret) against those a check refutes. The
cut-off of each kind is calibrated on all its labelled candidates that the trees did not learn from, so that the wanted
precision is met; a kind that never meets it adds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlake.session import ensure_checkpoint_dir

#: Distinct candidates that the trees are fitted on, about this many at most: a sixteenth of it (1,250) per kind and label, so
#: that no kind crowds out another. Cut-offs are calibrated on all labelled candidates.
SAMPLE = 20_000
#: Steps of the score in which cut-offs are counted.
BUCKETS = 10_000
PRECISION = 0.95
CONTEXT = 24
SEED = 7

_LOCAL = "A-Za-z0-9._%+-"
#: Possessive and anchored to the start of a run (or to the end of the match before), so that a long run without a match is
#: read once; what is matched is what the plain pattern matches.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators beyond the base kinds. A span of one kind may overlap one of another. A key or secret is a whole run of any length.
WIDE = {
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?=[A-Z]*+[0-9])(?=[0-9]*+[A-Z])[A-Z0-9]{16,}+(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9])",
}
KINDS = (*BASE, *WIDE)
#: A text without any of these has no candidate of any kind.
GATE = "@|[0-9]"
#: Words that announce a secret or a number (lower case, at the end of the characters before a span).
CUES = ("token", "password", "passwd", "secret", "api key", "apikey", "access key", "account", "iban", "ssn", "social security", "key", "pin", "card")
FEATURES = ("size", "digits", "capitals", "lowers", "variety", "separators", "hex", "turns", "quoted", "letters_before", "digits_before", "prose_before", "kind_no")


def matches(text: Column, pattern: str) -> Column:
    """Array of (i, gap, hit): each match with the length of the text between it and the match before."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit"),
                                                                                            F.right(gap, F.lit(CONTEXT)).alias("before")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per proposed span, and one without a kind for a text that has none: row (of the input), doc_id, kind, first,
    last (code points), hit, before (the characters in front of it, up to CONTEXT)."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(matches(F.col("text"), pattern), lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m.alias("m")))

    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    read = read.select("row", "doc_id", F.when(F.col("text").rlike(GATE), F.col("text")).alias("text"))
    found = F.concat(*[of_kind(kind, pattern) for kind, pattern in (BASE | WIDE).items()])
    each = read.select("row", "doc_id", F.explode_outer(found).alias("c")).select("row", "doc_id", "c.kind", "c.i", "c.m.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum(F.col("gap") + F.char_length("hit")).over(upto).cast("bigint")
    return each.withColumn("last", last).withColumn("first", F.col("last") - F.char_length("hit")).drop("i", "gap")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum: every second digit from the right doubled, digits of it added."""
    def step(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number passes its check: the first four characters last, letters as numbers from 10, rest 1."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(value > 9, (rest * 100 + value) % 97).otherwise((rest * 10 + value) % 97)

    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), step) == 1


def base_holds(kind: Column, hit: Column) -> Column:
    """The checks of the base kinds."""
    digits = _digits(hit)
    parts = F.transform(F.split(hit, r"\."), lambda part: F.regexp_replace(part, "^0+(?=[0-9])", ""))
    octets = F.forall(parts, lambda part: (F.length(part) <= 3) & (F.left(part, F.lit(3)).try_cast("int") <= 255))
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", octets)
            .when(kind == "card", F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False)))
            .when(kind == "phone", F.length(digits).between(8, 15)).otherwise(F.lit(False)))


def kind_number(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def features(spans: DataFrame) -> DataFrame:
    """Adds the format and context features of each candidate, all numbers."""
    hit, before, n = F.col("hit"), F.lower("before"), F.greatest(F.char_length("hit"), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(hit, F.lit(pattern)) / n
    columns = {
        "size": n, "digits": share("[0-9]"), "capitals": share("[A-Z]"), "lowers": share("[a-z]"),
        "variety": F.size(F.array_distinct(F.split(hit, ""))) / n, "separators": share("[^A-Za-z0-9]"), "hex": share("[0-9a-f]"),
        "turns": F.regexp_count(hit, F.lit("(?:[0-9](?=[A-Za-z]))|(?:[A-Za-z](?=[0-9]))")) / n,
        "quoted": before.rlike("[\"']$").cast("double"),
        "letters_before": before.rlike("[a-z]$").cast("double"), "digits_before": before.rlike("[0-9][ .-]?$").cast("double"),
        "prose_before": F.regexp_count(before, F.lit("[a-z]")) / F.lit(float(CONTEXT)),
        "kind_no": kind_number(F.col("kind")),
    }
    return spans.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()})


def proven(spans: DataFrame) -> Column:
    """1 where a check proves a candidate, 0 where one refutes it, null where none can tell."""
    kind, hit, head = F.col("kind"), F.col("hit"), F.rtrim(F.regexp_replace(F.lower("before"), "[^a-z0-9]+", " "))
    announced = reduce(lambda a, b: a | b, [F.endswith(head, F.lit(cue)) for cue in CUES])
    assigned = F.col("before").rlike(r"[=:]\s?[\"']?$")
    return (F.when(kind.isin(*BASE), base_holds(kind, hit)).when(kind == "account", mod97(hit))
            .when(kind == "secret", F.when(announced & assigned, F.lit(True)).when(~hit.rlike("[0-9].*[0-9].*[0-9]"), F.lit(False)))
            .when(kind == "key", F.when(hit.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$"), F.lit(True)).when(hit.rlike("^[A-Z]+[0-9]{1,2}$"), F.lit(False)))
            .when(kind == "national_id", ~hit.rlike("^(000|666|9)|-00-|-0000$"))).cast("double")


def decided(spans: DataFrame) -> Column:
    """What the check alone says of a wide candidate: 1 stays, 0 goes, null is for the trees.

    An account number stands or falls with its check sum, a secret stays where its name and an assignment stand before it, an
    identity number can only be refuted. So a proven span does not depend on what else is in the table.
    """
    return F.when(F.col("kind").isin(*BASE), F.lit(None)).when((F.col("kind") == "national_id") & (proven(spans) == 1), F.lit(None)).otherwise(proven(spans))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def scored_by(model, rows: DataFrame) -> DataFrame:
    """Adds the trees' probability as ``score``."""
    return model.transform(_assembled(rows)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _known(spans: DataFrame) -> DataFrame:
    """The distinct (kind, hit, before) that a check proves or refutes: kind, label, order (a hash of the three), features."""
    distinct = spans.where("kind IS NOT NULL").groupBy("kind", "hit", "before").count()
    judged = distinct.withColumn("label", proven(distinct)).where("label IS NOT NULL")
    return features(judged.withColumn("order", F.xxhash64("kind", "hit", "before"))).select("kind", "label", "order", *FEATURES)


def _learned(sizes: dict[tuple[str, float], int], sample: int) -> Column:
    """Whether the trees learn from a row of ``_known``: three quarters of at most about ``sample`` / 16 rows per kind and label."""
    most, draw = max(sample // (2 * len(KINDS)), 1), F.pmod(F.shiftrightunsigned("order", 2), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = reduce(lambda a, item: a.when((F.col("kind") == item[0][0]) & (F.col("label") == item[0][1]), most / item[1]), sorted(sizes.items()), F.when(F.lit(False), 0.0))
    return (draw < F.coalesce(share, F.lit(0.0))) & (F.pmod("order", F.lit(4)) != 0)


def _bucket(score: Column) -> Column:
    return F.floor(score * BUCKETS)


def fit(spans: DataFrame, sample: int = SAMPLE, precision: float = PRECISION):
    """(model, {kind: cut-off as a bucket of the score}); (None, {}) where the rows to learn from show one class only.

    The trees learn from a bounded share of the distinct labelled candidates, drawn per kind and label: a kind with few of
    them is learned from as it would be in a small table. The cut-off of a kind is counted over all its distinct labelled
    candidates that were not learned from, however many: the lowest score at which those that score as much reach
    ``precision``. Where none of these is proven, all labelled candidates of the kind are counted.
    """
    known = _known(spans).checkpoint()
    sizes = {(r["kind"], r["label"]): r["count"] for r in known.groupBy("kind", "label").count().collect()}
    known = known.withColumn("learned", _learned(sizes, sample))
    learn = known.where("learned")
    if learn.select("label").distinct().count() < 2:
        return None, {}
    model = GBTClassifier(maxIter=12, maxDepth=4, seed=SEED, stepSize=0.3).fit(_assembled(learn))
    counted = scored_by(model, known).withColumn("at", _bucket(F.col("score"))).groupBy("kind", "at").agg(
        F.count("*").alias("n_all"), F.sum("label").alias("good_all"), F.count_if(~F.col("learned")).alias("n_new"), F.sum(F.when(F.col("learned"), 0.0).otherwise(F.col("label"))).alias("good_new"))
    down = Window.partitionBy("kind").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0)

    def lowest(of: str) -> Column:
        return F.min(F.when((F.col(f"n_{of}") > 0) & (F.col(f"reach_{of}") >= precision), F.col("at")))

    reach = {f"reach_{of}": F.try_divide(F.sum(f"good_{of}").over(down), F.sum(f"n_{of}").over(down)) for of in ("all", "new")}
    cut = counted.withColumns(reach).groupBy("kind").agg(F.when(F.sum("good_new") > 0, lowest("new")).otherwise(lowest("all")).alias("cut"))
    return model, {r["kind"]: r["cut"] for r in cut.where("cut IS NOT NULL").collect()}


def judged_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """The candidates with ``base`` (a base span that holds), ``score`` and ``chosen``: base, or clear of base spans and proven by
    its check, or neither proven nor refuted and at its kind's cut-off."""
    ensure_checkpoint_dir(docs.sparkSession)
    spans = candidates(docs, id_col, text_col).checkpoint()
    model, cut = fit(spans, sample, precision)
    rows = features(spans)
    rows = scored_by(model, rows) if model is not None else rows.withColumn("score", F.lit(0.0))
    rows = rows.drop(*FEATURES).withColumn("base", F.coalesce(base_holds(F.col("kind"), F.col("hit")), F.lit(False)))
    order = Window.partitionBy("row").orderBy("first")
    begun = F.max(F.when(F.col("base"), F.col("last"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    to_come = F.min(F.when(F.col("base"), F.col("first"))).over(order.rangeBetween(0, Window.unboundedFollowing))
    clear = F.coalesce(begun <= F.col("first"), F.lit(True)) & F.coalesce(to_come >= F.col("last"), F.lit(True))
    wide = reduce(lambda a, b: a | b, [(F.col("kind") == kind) & (_bucket(F.col("score")) >= F.lit(cut[kind])) for kind in WIDE if kind in cut], F.lit(False))
    said = rows.withColumns({"clear": clear, "said": decided(rows)})
    wide = F.when(F.col("said").isNotNull(), F.col("said") == 1).otherwise(wide)
    return said.withColumn("chosen", F.coalesce(F.col("base") | (wide & F.col("clear")), F.lit(False))).drop("clear", "said")


def _listed(chosen: Column) -> Column:
    """The spans as kind:start:end by kind, then start."""
    held = F.array_sort(F.collect_list(F.when(chosen, F.struct(kind_number(F.col("kind")).alias("kind_no"), "first", "last", "kind"))))
    return F.array_join(F.transform(held, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """doc_id, counts of the base kinds, base_spans, spans for every row of ``docs`` (lists of kind:start:end in code points).

    A null text counts as empty and has no spans. Where the candidates show one class only (few or no rows) no trees are
    fitted and the base spans are the result. Repeated rows are answered one by one; other columns are not read. A row's
    spans are gathered in one value, which its own text bounds.
    """
    rows = judged_spans(docs, id_col, text_col, sample, precision)
    counts = [F.count_if(F.col("base") & (F.col("kind") == kind)).cast("bigint").alias(f"n_{kind}") for kind in BASE]
    return rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *counts, _listed(F.col("base")).alias("base_spans"), _listed(F.col("chosen")).alias("spans")).drop("row")
