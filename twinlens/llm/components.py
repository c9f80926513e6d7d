"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import let_go, reliable


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): the smallest node that can be reached. Each round takes the smallest label
    among neighbours and then the label's own label, so that long chains halve; the driver sees one count a round."""
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    labels = reliable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("higher"))
        new = reliable(
            step.join(up, F.col("next") == F.col("up"), "left")
            .select("node", F.least("next", F.coalesce("higher", "next")).alias("label"), "label")
            .toDF("node", "label", "old")
        )
        changed = new.filter("label <> old").limit(1).count()
        labels = new.drop("old")
        let_go(links.sparkSession)
        if not changed:
            return labels.withColumnRenamed("label", "component")
