"""Tables in the folder that the driver and all executors share: intermediate results, row numbers
that no task counts alone, and tables that change in place, bucket by bucket."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """The shared folder. Only an unset one on a plain local master is replaced by our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", root)
    _delete_on_exit(spark, root)
    return root


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    p, system = _file_system(spark, path)
    system.deleteOnExit(p)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    p, system = _file_system(spark, path)
    system.delete(p, True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs in here go when it ends, not when the driver happens to collect garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back with the same schema: lost executors cost a
    reread, not a recomputation."""
    path = new_path(df.sparkSession, name)
    return stored_at(df, path, **options)


def stored_at(df: DataFrame, path: str, **options: str) -> DataFrame:
    with shuffles_released(df.sparkSession):
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


def number_rows(rows: DataFrame, *order: str | Column, by: tuple[str, ...] = (), name: str = "n", first: int = 1) -> DataFrame:
    """``rows`` with their number (a long, from ``first`` on) in the order given, within equal ``by``.

    Rows are dealt to tasks by ranges of (by, order), so one group may be spread over many tasks, and
    a task's rows get places that ascend. What is counted as a whole is a row for each task and
    group. Rows that tie in the order may be numbered either way."""
    at, part, least, size, before, its_part = fresh(rows, "__at", "__part", "__least", "__size", "__before", "__its_part")
    groups = fresh(rows, *(f"__by{i}" for i in range(len(by))))
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    # Places are a task's number and the row's place in it; stored, so that they are given once.
    placed = stored(dealt.withColumn(at, F.monotonically_increasing_id()), "numbered").withColumn(part, F.shiftright(at, 33))
    sizes = placed.groupBy(F.col(part).alias(its_part), *(F.col(c).alias(g) for c, g in zip(by, groups, strict=True))).agg(F.min(at).alias(least), F.count("*").alias(size))
    earlier = Window.partitionBy(*groups).orderBy(its_part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    same = F.col(part) == F.col(its_part)
    for c, g in zip(by, groups, strict=True):
        same &= F.col(c).eqNullSafe(F.col(g))
    number = F.col(before) + F.col(at) - F.col(least) + first
    return placed.join(sizes, same).select(*(c for c in rows.columns if c != name), number.cast("long").alias(name))


class KeyedTable:
    """Rows by key in Parquet, changed by writing anew the buckets that a change touches.

    ``data/change=c/bucket=b`` holds what a change wrote of bucket b; ``manifest/version=n`` tells which
    changes each bucket consists of, and is written last. So a reader sees the old table or the
    new one, whatever happens between, and of two writers of one version the second fails. Only buckets
    that hold changed keys are read or written. The driver gets numbers of buckets, no keys."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64) -> KeyedTable:
        """A new table of ``rows`` (of any number for each key)."""
        table = cls(rows.sparkSession, path, key, buckets)
        change = table.new_change()
        table._commit(1, {b: [change] for b in table._write(change, rows)}, rows.schema)
        return table

    @staticmethod
    def new_change() -> str:
        return uuid.uuid4().hex[:12]

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> tuple[int, dict[int, list[str]], T.StructType]:
        """The newest version, the changes that make up each bucket, and the rows' schema."""
        rows = self.spark.read.schema("bucket int, changes array<string>, schema string, version int").json(f"{self.path}/manifest")
        newest = rows.agg(F.max("version")).scalar()
        own = rows.filter(F.col("version") == newest).collect()
        schema = next(r.schema for r in own if r.bucket == -1)
        return own[0].version, {r.bucket: list(r.changes) for r in own if r.bucket >= 0}, T.StructType.fromJson(json.loads(schema))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        _, held, schema = self.manifest()
        return self._read(held, schema, buckets)

    def _read(self, held: dict[int, list[str]], schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/change={c}/bucket={b}" for b in (sorted(held) if buckets is None else buckets) for c in held.get(b, [])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that keys lie in."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(self.key))).distinct().collect())

    def _write(self, change: str, rows: DataFrame) -> list[int]:
        path = f"{self.path}/data/change={change}"
        rows.withColumn("bucket", self.bucket(F.col(self.key))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        return sorted(int(r[0]) for r in self.spark.read.schema("bucket int").parquet(path).distinct().collect())

    def _commit(self, version: int, held: dict[int, list[str]], schema: T.StructType) -> None:
        rows = [(-1, [], schema.json()), *((b, own, None) for b, own in held.items() if own)]
        self.spark.createDataFrame(rows, "bucket int, changes array<string>, schema string").coalesce(1).write.mode("error").json(f"{self.path}/manifest/version={version}")

    def _rewrite(self, touched: list[int], change) -> None:
        """Replaces the touched buckets by ``change`` of what they hold."""
        version, held, schema = self.manifest()
        name = self.new_change()
        written = self._write(name, change(self._read(held, schema, touched)).select(*schema.names))
        self._commit(version + 1, held | dict.fromkeys(touched, []) | {b: [name] for b in written}, schema)

    def append(self, rows: DataFrame, change: str | None = None) -> None:
        """Adds rows; nothing that is there is written again."""
        version, held, schema = self.manifest()
        name = change or self.new_change()
        written = self._write(name, rows.select(*schema.names))
        self._commit(version + 1, held | {b: [*held.get(b, []), name] for b in written}, schema)

    def insert(self, new: DataFrame, order: str | Column) -> DataFrame:
        """Adds a row for each key that isn't known (of several the first in ``order``) and gives back the
        rows that are refused, of known keys and the later ones of others."""
        _, held, schema = self.manifest()
        known = self._read(held, schema, self.touched(new)).select(self.key).distinct().withColumn("__known", F.lit(True))
        first = Window.partitionBy(self.key).orderBy(order)
        told = stored(new.join(known, self.key, "left").withColumn("__known", F.coalesce("__known", F.row_number().over(first) > 1)), "inserted")
        self.append(told.filter(~F.col("__known")))
        return told.filter("__known").drop("__known").select(*new.columns)

    def upsert(self, new: DataFrame, columns: list[str]) -> None:
        """Inserts unknown keys and replaces ``columns`` of known ones."""
        from millrace.operators.registry import upsert

        self._rewrite(self.touched(new), lambda base: upsert(base, new, self.key, columns))

    def patch(self, changes: DataFrame, columns: list[str], where: Column | None = None) -> None:
        """Takes over the non-null fields of ``changes``."""
        from millrace.operators.registry import patch

        self._rewrite(self.touched(changes), lambda base: patch(base, changes, self.key, columns, where))

    def replace(self, new: DataFrame) -> None:
        """Replaces all rows of the keys in ``new`` by those."""
        from millrace.operators.registry import replace_children

        self._rewrite(self.touched(new), lambda base: replace_children(base, new.select(*base.columns), self.key))

    def delete(self, keys: DataFrame) -> None:
        self._rewrite(self.touched(keys), lambda base: base.join(keys.select(self.key).distinct(), self.key, "left_anti"))


class SeenStore:
    """Keys that were seen, with a Bloom filter for each bucket, so that a batch reads the buckets only
    that may hold one of its keys.

    A bucket's filter is ``pages`` bitmaps of 32,768 bits; a page with 3,000 keys takes a new key for a
    seen one in a hundred cases, which costs a bucket's reading and is never wrong."""

    BITS, PLACES, KEYS_A_PAGE = 1 << 15, 7, 3000

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, pages: int = 16):
        self.table, self.filters = KeyedTable(spark, f"{path}/keys", "key", buckets), f"{path}/filters"
        self.spark, self.pages = spark, pages

    @classmethod
    def create(cls, keys: DataFrame, path: str, buckets: int = 64, expected: int = 1_000_000) -> SeenStore:
        """A store of ``keys`` (their first column), laid out for about ``expected`` of them."""
        store = cls(keys.sparkSession, path, buckets, max(1, -(-expected // (buckets * cls.KEYS_A_PAGE))))
        store.table = KeyedTable.create(keys.sparkSession.createDataFrame([], T.StructType([T.StructField("key", keys.schema[0].dataType)])), f"{path}/keys", "key", buckets)
        store.add(keys)
        return store

    def _placed(self, keys: DataFrame) -> DataFrame:
        places = F.array(*(F.pmod(F.xxhash64(F.col("key"), F.lit(i)), F.lit(self.BITS)) for i in range(self.PLACES)))
        return keys.select("key", self.table.bucket(F.col("key")).alias("bucket"), F.pmod(F.xxhash64("key", F.lit("page")), F.lit(self.pages)).alias("page"), places.alias("places"))

    def add(self, keys: DataFrame) -> None:
        """Adds keys (their first column); their filters are there before they count."""
        own = stored(keys.select(F.col(keys.columns[0]).alias("key")).filter("key is not null").distinct(), "seen-keys")
        change = self.table.new_change()
        bits = self._placed(own).select("bucket", "page", F.explode("places").alias("place")).groupBy("bucket", "page").agg(F.bitmap_construct_agg("place").alias("bits"))
        bits.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.filters}/change={change}")
        self.table.append(own, change)

    def candidates(self, keys: DataFrame) -> DataFrame:
        """key and bucket of those of ``keys`` (distinct) that the filters may know."""
        held = self.table.manifest()[1]
        changes = sorted({c for own in held.values() for c in own})
        reader, none = self.spark.read.schema("page long, bits binary, bucket int"), "page long, bits binary, bucket int"
        bits = reader.option("basePath", self.filters).parquet(*(f"{self.filters}/change={c}" for c in changes)) if changes else self.spark.createDataFrame([], none)
        whole = bits.groupBy("bucket", "page").agg(F.bitmap_or_agg("bits").alias("bits"))
        byte = lambda p: F.conv(F.hex(F.col("bits").substr((F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        is_set = lambda p: F.get(F.array(*(F.shiftright(byte(p), i) for i in range(8))), (p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
        placed = self._placed(keys).join(whole, ["bucket", "page"])
        return placed.filter(F.forall("places", is_set)).select("key", "bucket")

    def known(self, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` (their first column) that were seen."""
        own = keys.select(F.col(keys.columns[0]).alias("key")).filter("key is not null").distinct()
        maybe = stored(self.candidates(own), "seen-candidates")
        buckets = sorted(r[0] for r in maybe.select("bucket").distinct().collect())
        return self.table.read(buckets).join(maybe.select("key"), "key", "left_semi")
