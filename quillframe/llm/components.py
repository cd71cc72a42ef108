"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import frames


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b), root the least node of its component.

    Large-star and small-star rounds alternate until the edges no longer change; each round's edges
    are a written table, so no lineage grows and lost executors cost one round. The table holds at
    most the edges given. Self loops and repeated edges don't matter; no edges give no rows.
    """
    e = frames.written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        if e.isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        new = frames.written(small.select("x.a", "x.b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        same = new.count() == e.count() and new.exceptAll(e).isEmpty()
        frames.drop_written(e)
        e = new
        if same:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
