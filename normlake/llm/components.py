"""Connected components of a table of links, as rounds of joins over all links at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlake.session import ensure_checkpoint_dir


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (columns a, b; either direction, repeats allowed).

    A round takes the smallest label among a node and its neighbours, then the label of that label, so the number of rounds
    grows with the logarithm of the longest chain. Labels are cut from their lineage each round by a reliable checkpoint.
    """
    ensure_checkpoint_dir(links.sparkSession)
    both = links.where("a != b").select("a", "b").union(links.where("a != b").select("b", "a")).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")).checkpoint()
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        after = lower.join(jump, lower["label"] == jump["at"], "left").select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")).checkpoint()
        if after.where("label != was").isEmpty():
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")
