"""Connected components by alternating large-star and small-star rounds.

Edges shrink towards stars round by round; every round is two grouped minima and joins over
as many rows as there are edges, written to the shared folder. No component is gathered, and
a node's edges are dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, drop, join_salted, new_path, stored_at


def connected_components(edges: DataFrame, scratch: Scratch | None = None, name: str = "components") -> DataFrame:
    """``node`` and ``root`` (the component's least node) of every node with an edge (a, b). The last
    round's table is the ``scratch``'s, if there is one."""
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = new_path(spark, name)
        got = stored_at(df, path)
        return got, path, tuple(got.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    up = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    now, path, mark = kept(up)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_salted(both, low, "a", "b").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_salted(large, low, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        fresh, fresh_path, fresh_mark = kept(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        drop(spark, path)
        now, path = fresh, fresh_path
        if fresh_mark == mark:
            break
        mark = fresh_mark
    if scratch is not None:
        scratch.paths.append(path)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
