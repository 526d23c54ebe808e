"""Quality classifier by hierarchical empirical Bayes.

A document classifier, fitted on labelled rows, gives each document evidence: the log odds of being good. Evidence of all
documents is then gathered by host and by path below the host; a site's posterior share of good documents is a beta
posterior whose prior is the level above (the whole table for hosts, the host for paths), so a site with few documents
keeps close to its prior and a large one speaks for itself. The strength of each prior is estimated from the spread of the
sites (method of moments). A document's verdict adds its path's posterior log odds, against those of the classifier's own
prior, to its evidence.

Sites are only ever sums of counts (map-side combined), so a host with a third of all rows is one row after the shuffle.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.session import ensure_checkpoint_dir

#: Labelled rows that fit the classifier, at most (the smallest by a hash of the id).
SAMPLE = 10_000
#: Words of the lexicon of toxic documents, at most, and the different words a word must follow to be considered.
LEXICON, CONTEXTS = 200, 4
#: A word enters where its log odds of being in a toxic document exceed those of all words by this much, with two standard
#: errors to spare.
LIFT = 1.0
#: A document is kept at this posterior probability of being good.
KEEP = 0.5
#: Fixed bounds of a document's evidence, in log odds.
MOST = 30.0
_WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Runs that ordinary prose has few of: capitals in a row, digits, symbols.
_MARKED = r"[A-ZÀ-Þ]{2,}|[0-9]+|[$%&*#@~^_+=<>/\\\[\]{}]+"
FORMAT = ("log_words", "shouting", "marks", "columns", "doubled", "distinct", "symbols", "digits", "word_size", "listed", "any_listed")


def _words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def fit_lexicon(known: DataFrame, limit: int = LEXICON) -> DataFrame:
    """word, weight: words that toxic documents hold far more often than others.

    Occurrences count once per word before them: a copied passage repeats its neighbours, so copies of one toxic document
    do not make all its words suspect, while a word that is toxic turns up behind many others.
    """
    words = known.select("toxic", _words(F.col("text")).alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.struct(a.alias("before"), b.alias("word")))
    contexts = words.select("toxic", F.explode(pairs).alias("p")).groupBy("p.word", "p.before").agg(F.avg("toxic").alias("toxic"))
    counts = contexts.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("b")).checkpoint()
    total = counts.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    if not total["b"] or total["b"] == total["n"]:
        return counts.limit(0).select("word", F.lit(0.0).alias("weight"))
    lift = F.ln((F.col("b") + 0.5) / (F.col("n") - F.col("b") + 0.5)) - F.lit(math.log(total["b"] / (total["n"] - total["b"])))
    sure = lift - 2 * F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("n") - F.col("b") + 0.5))
    listed = counts.where(F.col("n") >= CONTEXTS).select("word", lift.alias("weight"), sure.alias("sure")).where(F.col("sure") > LIFT)
    return listed.orderBy(F.col("sure").desc(), "word").limit(limit).select("word", "weight")


def with_features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """Adds the FORMAT columns, computed from ``text``: shares of words or characters, and how many listed words occur."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = rows.withColumn("_words", _words(text)).withColumn("_distinct", F.array_distinct("_words"))
    n, chars = F.greatest(F.size("_words"), F.lit(1)).cast("double"), F.greatest(F.length(text), F.lit(1)).cast("double")
    listed = F.size(F.array_intersect("_distinct", F.array(*[F.lit(w) for w in sorted(lexicon)]).cast("array<string>")))

    marked = F.regexp_extract_all(text, F.lit(_MARKED), F.lit(0))
    read = read.withColumn("_marked", marked)
    pairs = F.zip_with("_words", F.slice("_words", F.lit(2), F.greatest(F.size("_words"), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False)))

    def of(sign: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))).cast("double")

    def length_of(first: str) -> Column:
        return F.aggregate(F.filter("_marked", lambda run: run.rlike(first)), F.lit(0), lambda total, run: total + F.length(run)).cast("double")

    columns = {
        "log_words": F.ln(n),
        "shouting": length_of("^[A-ZÀ-Þ]") / chars,
        "marks": (of("!") + of("?")) / n,
        "columns": of("|") / n,
        "doubled": F.size(F.filter(pairs, lambda same: same)) / n,
        "distinct": F.size("_distinct") / n,
        "symbols": length_of("^[^A-ZÀ-Þ0-9]") / chars,
        "digits": length_of("^[0-9]") / chars,
        "word_size": F.least(chars / n, F.lit(50.0)),
        "listed": F.least(listed, F.lit(8)),
        "any_listed": F.least(listed, F.lit(1)),
    }
    return read.withColumns({k: v.cast("double") for k, v in columns.items()}).drop("_words", "_distinct", "_marked")


def _sampled(rows: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """A bounded sample of labelled rows: text, toxic, bad (low quality or toxic)."""
    toxic = F.coalesce("toxic", F.lit(0)) == 1
    bad = (F.coalesce("quality", F.lit(1)) == 0) | toxic
    verdicts = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    chosen = verdicts.agg(F.max(F.when(toxic, 1.0).otherwise(0.0)).alias("toxic"), F.max(F.when(bad, 1.0).otherwise(0.0)).alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "bad")  # at most ``sample`` rows of numbers


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(pipeline model, lexicon) from at most ``sample`` labelled rows; (None, {}) unless both classes are among them."""
    known = _sampled(rows, labels, sample).checkpoint()
    if known.select("bad").distinct().count() < 2:
        return None, {}
    lexicon = {r["word"]: r["weight"] for r in fit_lexicon(known).collect()}  # at most LEXICON words
    learn = with_features(known, lexicon).select((1.0 - F.col("bad")).alias("label"), *FORMAT).checkpoint()
    stages = [VectorAssembler(inputCols=list(FORMAT), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
              LogisticRegression(featuresCol="_scaled", rawPredictionCol="_odds", probabilityCol="_p", predictionCol="_c", maxIter=60, regParam=1e-4)]
    return Pipeline(stages=stages).fit(learn), lexicon


def with_evidence(rows: DataFrame, model, lexicon: dict[str, float]) -> DataFrame:
    """Adds ``evidence``: the classifier's log odds of being good; 0 without a classifier."""
    if model is None:
        return rows.withColumn("evidence", F.lit(0.0))
    scored = model.transform(with_features(rows, lexicon))
    odds = F.greatest(F.least(vector_to_array("_odds")[1], F.lit(MOST)), F.lit(-MOST))
    return scored.withColumn("evidence", odds).drop("_raw", "_scaled", "_odds", "_p", "_c", *FORMAT)


def _strength(sites: DataFrame) -> float:
    """Prior strength (in documents) from how much the sites' shares vary beyond chance; large where they do not."""
    row = sites.where("n >= 2").agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"),
                                     F.sum(F.pow(F.col("good") / F.col("n"), 2) * F.col("n")).alias("square")).first()
    if not row["n"] or row["sites"] < 2:
        return 100.0
    mean = row["good"] / row["n"]
    chance = mean * (1 - mean)
    spread = row["square"] / row["n"] - mean * mean
    beyond = spread - chance * row["sites"] / row["n"]
    return 1e4 if beyond <= 0 or chance <= 0 else min(1e4, max(2.0, chance / beyond - 1))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, share: posterior share of good documents of each path; the share of the whole table)."""
    good = 1 / (1 + F.exp(-F.col("evidence")))
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(good).alias("good")).checkpoint()
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    whole = total[0] / total[1] if total[1] else 0.5
    of_hosts, of_paths = _strength(hosts), _strength(paths)
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("good") + whole * of_hosts) / (F.col("n") + of_hosts)).alias("host_share"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    return joined.select("host", "path", "host_share", ((F.col("good") + F.col("host_share") * of_paths) / (F.col("n") + of_paths)).alias("share")), whole


def _logit(p: Column | float) -> Column:
    p = F.greatest(F.least(p if isinstance(p, Column) else F.lit(p), F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.ln(p / (1 - p))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
          sample: int = SAMPLE, keep: float = KEEP, carry: bool = True) -> DataFrame:
    """original (the whole input row), doc_id, evidence, host_share, path_share, posterior, kept for every row of ``docs``.

    Without ``carry`` the input row is left out (null), and the evidence is kept so that texts are read once; with it they are
    read again for the second use, which costs time but no copy of the texts.

    ``host_col`` and ``path_col`` name the site levels. A null text counts as empty; null hosts or paths are sites of their
    own. Labels without an id or without both verdicts are not used; repeated labels of one id count as bad if one of them
    is. Without labels of both kinds, evidence is 0 and every row is kept. Repeated rows are judged one by one. An empty
    table gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select((F.struct(*docs.columns) if carry else F.lit(None).cast("string")).alias("original"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    model, lexicon = fit(rows, labels, sample)
    scored = with_evidence(rows, model, lexicon).drop("text")
    scored = scored if carry else scored.checkpoint()
    sites, whole = site_posteriors(scored.select("host", "path", "evidence"))
    sites = sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "host_share", F.col("share").alias("path_share"))
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    shift = F.coalesce(_logit(F.col("path_share")) - _logit(whole), F.lit(0.0))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + shift)))
    return joined.select("original", "doc_id", "evidence", "host_share", "path_share", posterior.alias("posterior"), (posterior >= keep).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """``docs`` less the rows the classifier rejects; columns as they were."""
    return judge(docs, labels, **names).where("kept").select("original.*")
