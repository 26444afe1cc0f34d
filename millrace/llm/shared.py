"""Tables in the folder that the driver and all executors share.

An intermediate result that several jobs read is written as Parquet below
``spark.checkpoint.dir``: lost executors cost a reread, not a recomputation, and the
lineage of iterative jobs stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import ship_package
from millrace.tables import drop, fresh, new_path, shared_root, shuffles_released, stored, stored_at  # noqa: F401


class Scratch:
    """Stored tables of a job's steps, which are deleted when a later one holds all that is needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        self.paths.append(new_path(self.spark, name))
        return self.paths[-1]

    def stored(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        return stored_at(df, self.path(name), **options)

    def clear(self) -> None:
        for path in self.paths:
            drop(self.spark, path)
        self.paths = []


def join_skewed(left: DataFrame, right: DataFrame, key: str, count: str, total: int, most: int = 10_000, least: int = 256) -> DataFrame:
    """Inner join on ``key``, of which ``right`` (a stored table) has a row each and, in ``count``, how many
    rows ``left`` (of ``total``) has. Keys with more than one in ``most`` of all rows are ``most`` at most:
    their rows of ``right`` are broadcast, so no task gets all of such a key; the others are shuffled."""
    limit = max(least, total // most)
    if right.filter(F.col(count) > limit).isEmpty():
        return left.join(right, key)
    hot = F.broadcast(right.filter(F.col(count) > limit))
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(right.filter(F.col(count) <= limit), key))


def join_salted(left: DataFrame, right: DataFrame, key: str, by: str, salts: int = 8) -> DataFrame:
    """Inner join on ``key``, of which ``right`` has a row each. A key's rows of ``left`` are dealt to
    ``salts`` tasks by ``by``, each of which gets the row of ``right``."""
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def arrow_rows(spark: SparkSession, rows: int = 256) -> None:
    """Bounds the rows of an Arrow batch, so that batches of long texts stay small, and
    makes sure that Python workers can import this package. The bound is a setting of the
    session and stays until another operator sets its own."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
