"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skypairs.llm.columns import written


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for all nodes of the links (a, b).

    Labels fall to the least one among the neighbours, then to the label of the label, until none changes. Every
    round is written to the shared folder; only the number of changes reaches the driver.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                     .select("node", F.least("node", "b").alias("label")))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = written(lower.join(of, "label").select("node", "old", F.least("label", "next").alias("label")))
        labels = jumped.select("node", "label")
        if not jumped.filter("label < old").limit(1).count():
            return labels
