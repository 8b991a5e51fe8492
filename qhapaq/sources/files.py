"""Bytes of files through Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qhapaq.shared import ship


def contents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, content) of each file; content is read by the task that uses it. Files of 2 GB or more are refused by Spark."""
    ship(spark)
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")


def decoded(files: DataFrame, decode: Callable[[bytes], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Rows that decode yields for the content of each file, one task per file."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                yield from decode(bytes(content))

    return files.select("content").mapInPandas(run, schema)


def head(spark: SparkSession, path: str, size: int = 200_000) -> bytes:
    """The first bytes of a file; no more are brought to the driver."""
    found = contents(spark, path).orderBy("path").select(F.substring("content", 1, size)).first()
    return bytes(found[0]) if found else b""
