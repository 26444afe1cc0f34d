"""Token-ID output: Parquet list columns in ascending document order.

``write_tokens`` deals documents out by ranges of their id, sorts each range, encodes it and
lets Spark's Parquet writer store the ids: dictionary encoding for the ids while a column
chunk's dictionary fits (bit-packed, about 16 bits a token), delta packing (writer version
2) beyond that and for the metadata columns, row groups and pages of a stated size, and page
indexes. So a reader that wants lengths reads no token page, and one that wants few documents
reads the pages that hold them.

Defined cases: a null text is empty; an empty text has the end id alone; rows with equal ids
are all kept, ordered by id, then the text's xxhash64, then text, null ids first; very long
texts are encoded whole, one at a time; an empty table gives files without rows; other
columns, of whatever name, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, new_path
from .textops import slices, texts_of
from .tokens import default_tokenizer, encoder, with_end

TOKEN_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def parquet_options(row_group_mb: int = 32, page_kb: int = 256) -> dict[str, str]:
    return {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": str(row_group_mb << 20),
        "parquet.page.size": str(page_kb << 10),
        "parquet.page.row.count.limit": "20000",
        "parquet.enable.dictionary": "true",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#n_tokens": "false",
    }


def tokenize(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, n_tokens and ids of each row, in the rows' order."""
    path = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = with_end(*enc.encode(texts_of(part)), end_id)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))],
                    names=["doc_id", "n_tokens", "ids"],
                )

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, TOKEN_SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, row_group_mb: int = 32, page_kb: int = 256) -> None:
    """Writes the ids of all documents; file names and rows follow ascending doc_id."""
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    tokenize(rows, tokenizer, end_id).write.options(**parquet_options(row_group_mb, page_kb)).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids"), low: int | None = None, high: int | None = None) -> DataFrame:
    """Columns and a range of documents; both reach the scan, so other pages aren't read."""
    df = spark.read.schema(TOKEN_SCHEMA).parquet(path)
    if low is not None:
        df = df.filter(F.col("doc_id") >= low)
    if high is not None:
        df = df.filter(F.col("doc_id") <= high)
    return df.select(*columns)


def crc_of_ids(part: pa.RecordBatch, column: str = "ids") -> np.ndarray:
    lists = part.column(column)
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), np.int64, len(lists))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, as the files say.

    A document's start is what the files before hold (one sum a file, of the length column
    alone) and what its own file holds before it, so no task sees more than a file. Files
    follow each other by the numbers in their names: the range's, then the file's in it.
    """
    files = spark.read.schema(TOKEN_SCHEMA).parquet(path)
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.regexp_extract(name, pattern, 1).cast("long")
    marked = files.select("*", number(r"^part-(\d+)").alias("range"), number(r"-c(\d+)\.").alias("file"), F.col("_metadata.row_index").alias("row"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_tokens"), pa.array(crc_of_ids(b)), b.column("range"), b.column("file"), b.column("row")],
                names=["doc_id", "n_tokens", "ids_crc32", "range", "file", "row"],
            )

    rows = marked.mapInArrow(digest, "doc_id long, n_tokens long, ids_crc32 long, range long, file long, row long")
    totals = marked.groupBy("range", "file").agg(F.sum("n_tokens").alias("total"))
    before = totals.selectExpr("range", "file", "sum(total) over (order by range, file rows between unbounded preceding and 1 preceding) as base")
    inside = "sum(n_tokens) over (partition by range, file order by row rows between unbounded preceding and 1 preceding)"
    return rows.join(before, ["range", "file"]).selectExpr("doc_id", f"coalesce(base, 0) + coalesce({inside}, 0) as start", "n_tokens", "ids_crc32")


def tokens_table(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return token_index(spark, path)
