"""Nearest vectors by inverted lists: vectors lie in files by the centre they are nearest to, and a search
reads the lists around the query only.

Centres are fitted by spherical k-means on a bounded sample; every vector with a direction is indexed. A
list's radius (its greatest angle to the centre) bounds how near its vectors can come to a query, so a
search may stop with proof, by reading the lists that the bound leaves, or after a number of lists that
``calibrate`` finds to reach a recall on sampled queries. Similarities are always those of whole vectors.

Vectors that are null, of another length, not finite, or zero have no direction and aren't indexed; rows
with equal ids are rows each; an empty table gives an index without lists.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .documents import nearest

LISTS, SAMPLE, PROBES = 64, 50_000, 16


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _directed(vectors: DataFrame) -> DataFrame:
    """The vectors of the commonest length with a direction, and that (``unit``)."""
    own = F.col("embedding")
    finite = vectors.filter(own.isNotNull() & (F.size(own) > 0) & F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    most = finite.groupBy(F.size(own).alias("n")).count().orderBy(F.desc("count"), "n").first()
    same = finite.filter(F.size(own) == (most.n if most else 0)).withColumn("__norm", F.sqrt(_dot(own, own))).filter("__norm > 0")
    return same.withColumn("unit", F.transform(own, lambda x: x.cast("double") / F.col("__norm"))).drop("__norm")


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        # A row for each list: its centre, radius and size.
        rows = spark.read.parquet(f"{self.path}/lists").orderBy("list").collect()
        self.lists = [r.list for r in rows]
        self.centres = np.array([r.centre for r in rows])
        self.radius = np.array([r.radius for r in rows])
        self.sizes = np.array([r.n for r in rows], np.int64)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int = LISTS, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
        """An index of ``vectors`` (vec_id, embedding and any others) below ``path``. Centres see about
        ``sample`` vectors, chosen by a hash of their ids."""
        spark = vectors.sparkSession
        rows = _directed(vectors)
        grain, n = 1 << 30, rows.count()
        share = int(min(1.0, sample / max(1, n)) * grain)
        seen = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(grain)) < share).select(array_to_vector("unit").alias("features"))
        fitted: KMeansModel | None = None
        if n:
            fitted = KMeans(k=max(2, min(lists, n)), seed=seed, distanceMeasure="cosine", maxIter=10).fit(seen)
        centres = [c / max(float(np.linalg.norm(c)), 1e-300) for c in fitted.clusterCenters()] if fitted else []
        told = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, centre array<double>")
        placed = fitted.transform(rows.withColumn("features", array_to_vector("unit"))).withColumnRenamed("prediction", "list").drop("features") if fitted else rows.withColumn("list", F.lit(0))
        # As many rows as there are lists.
        angled = placed.join(F.broadcast(told), "list").withColumn("angle", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _dot(F.col("unit"), F.col("centre"))))))
        angled.drop("centre", "unit").hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/vectors")
        indexed = spark.read.schema("angle double, list int").parquet(f"{path}/vectors") if n else spark.createDataFrame([], "angle double, list int")
        told.join(indexed.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n")), "list").write.parquet(f"{path}/lists")
        angled.drop("centre", "unit", "list").limit(0).write.parquet(f"{path}/schema")
        return cls(spark, path)

    def read(self, lists: list[int]) -> DataFrame:
        """The vectors of some lists; others' files aren't opened."""
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        if not lists:
            return self.spark.createDataFrame([], schema).drop("angle")
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/vectors/list={k}" for k in lists)).drop("angle")

    def _angles(self, query: list[float]) -> np.ndarray:
        q = np.array(query, np.float64)
        if len(self.lists) and len(q) != self.centres.shape[1]:
            raise ValueError(f"the index has vectors of {self.centres.shape[1]} numbers, the query {len(q)}")
        return np.arccos(np.clip(self.centres @ (q / np.linalg.norm(q)), -1, 1)) if len(self.lists) else np.zeros(0)

    def search(self, query: list[float], k: int, where: Column | None = None, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """vec_id and similarity of the ``k`` nearest vectors that fit ``where``, among the ``probes`` lists
        nearest to the query; with ``exact`` also among all others that may hold nearer ones. ``self.read_lists``
        tells how many were read."""
        angles = self._angles(query)
        order = np.argsort(angles, kind="stable")
        first = order[:probes]
        found = nearest(self.read([self.lists[i] for i in first]), query, k, where)
        self.read_lists = len(first)
        if not exact:
            return found
        have = found.collect()  # k rows
        worst = np.arccos(min(1.0, max(-1.0, have[-1].similarity))) if len(have) == k else np.pi
        rest = [i for i in order[probes:] if angles[i] - self.radius[i] <= worst + 1e-9]
        self.read_lists += len(rest)
        more = nearest(self.read([self.lists[i] for i in rest]), query, k, where)
        return found.unionByName(more).orderBy(F.desc("similarity"), "vec_id").limit(k)

    def calibrate(self, queries: DataFrame, k: int = 10, recall: float = 0.95, most: int = 50) -> int:
        """The least number of lists to read that finds ``recall`` of the ``k`` nearest vectors of ``queries``
        (of whose ``embedding`` column at most ``most`` are taken, by a hash of their ids)."""
        asked = [r.embedding for r in queries.orderBy(F.xxhash64("vec_id")).select("embedding").limit(most).collect()]
        ranks = []
        for q in asked:
            place = np.empty(len(self.lists), np.int64)
            place[np.argsort(self._angles(q), kind="stable")] = np.arange(len(self.lists))
            by_list = dict(zip(self.lists, place.tolist(), strict=True))
            schema = self.spark.read.parquet(f"{self.path}/schema").schema.add("list", T.IntegerType())
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/vectors")
            given = F.array(*(F.lit(float(x)) for x in q))
            best = rows.select("list", (_dot(F.col("embedding"), given) / F.sqrt(_dot(F.col("embedding"), F.col("embedding")))).alias("s")).orderBy(F.desc("s")).limit(k).collect()
            ranks += [by_list[r.list] for r in best]
        return int(np.sort(ranks)[max(0, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if ranks else 1
