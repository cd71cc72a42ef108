"""Connected components of an edge table."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, functions as F


def _cut(df: DataFrame) -> DataFrame:
    """df without its lineage: checkpointed in the folder that the cluster names; an own one will do
    only where all runs on one machine."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="quillframe-")
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, group) of every node, group the least node that can be reached: labels spread to
    neighbours and then jump to the label of the label, until none changes."""
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = _cut(pairs.union(pairs.select("y", "x")).distinct())
    labels = _cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")))
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("best"))
        step = labels.join(near, labels["node"] == near["x"]).select("node", F.least("label", "best").alias("label"), F.col("label").alias("old"))
        up = step.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        jumped = step.join(up, step["label"] == up["n2"], "left").select("node", F.least("label", F.coalesce("l2", "label")).alias("label"), "old")
        jumped = _cut(jumped)
        if jumped.where("label <> old").isEmpty():
            return jumped.select("node", F.col("label").alias("group"))
        labels = jumped.drop("old")
