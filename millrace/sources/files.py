"""Bytes of files that Spark's readers reach."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bytes(spark: SparkSession, paths: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """``paths`` with ``content``: the bytes of that file below ``folder``, null if there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.sub("^file:/+", "/", folder).rstrip("/")
    name = F.substring(F.regexp_replace("path", "^file:/+", "/"), len(root) + 2, 1 << 20)
    return paths.join(files.select(name.alias("__name"), "content"), F.col(path) == F.col("__name"), "left").drop("__name")
