"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm._shared import materialize


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, root): for each node of ``edges``, the least node that it reaches.

    Hash-min with pointer jumping; every round is a written table, so a lost executor
    costs a round at most and lineage stays short. Labels never pass through the driver,
    which sees one count a round. Nulls in either column are ignored; self-links make a
    node of its own; repeated links are harmless; no edges give no rows.
    """
    one = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = materialize(one.union(one.select("v", "u")).distinct())
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).select(F.col("u").alias("node"), "root"))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        stepped = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("further"))
        moved = materialize(stepped.join(jump, "next").select("node", F.least("next", "further").alias("root"), (F.least("next", "further") < F.col("root")).alias("moved")))
        labels = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return labels
