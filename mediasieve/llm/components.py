"""Connected components of a link table by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasieve.llm.scratch import written


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``links(a, b)``: the smallest vertex that it reaches.

    Each round takes the smallest label among a vertex and its neighbours, then
    the label of that label, so that labels travel along paths that double.
    Rounds are cut by written tables; only the number of changes reaches the
    driver. Minima are taken before shuffling, so vertices with many links do
    no harm.
    """
    both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = stepped.alias("x").join(labels.select(F.col("v").alias("label"), F.col("label").alias("beyond")), "label", "left")
        new = written(jumped.select("v", "old", F.least("label", F.coalesce("beyond", "label")).alias("label")), "labels")
        if not new.where("old <> label").take(1):
            return new.select("v", "label")
        labels = new.select("v", "label")
