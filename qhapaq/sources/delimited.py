"""Delimited text with a declared encoding that may be wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qhapaq.sources.files import contents, head

BOM = "﻿"
FALLBACK = "ISO-8859-1"


def _strict(raw: bytes, encoding: str) -> bool:
    for cut in range(4):  # the sample may end inside a character
        try:
            raw[: len(raw) - cut].decode(encoding)
            return True
        except UnicodeDecodeError:
            continue
    return False


def encoding_of(spark: SparkSession, path: str, declared: str = "utf-8-sig") -> tuple[str, dict[str, str]]:
    """The encoding to read with, and a note: the declared one if the bytes agree, else the one-byte fallback.

    UTF-8 is checked over whole files on the executors; other encodings over the first 200 kB.
    """
    utf8 = declared.lower().replace("_", "-") in ("utf-8", "utf-8-sig", "utf8")
    if utf8:
        ok = not contents(spark, path).filter(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count()
    else:
        ok = _strict(head(spark, path), declared)
    used = ("UTF-8" if utf8 else declared) if ok else FALLBACK
    return used, {"encoding_usado": declared if ok else FALLBACK, "detalle": "coincide con lo declarado" if ok else f"no se puede leer como {declared}"}


def read_text_table(spark: SparkSession, path: str, sep: str = ";", declared: str = "utf-8-sig") -> tuple[DataFrame, dict[str, str]]:
    """(table of strings, note on the encoding). Leading zeros stay, since nothing is inferred; a byte-order mark goes."""
    encoding, note = encoding_of(spark, path, declared)
    options = {"sep": sep, "header": True, "encoding": encoding, "inferSchema": False, "enforceSchema": True}
    names = [c.removeprefix(BOM) for c in spark.read.options(**options).csv(path).columns]
    return spark.read.options(**options).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path), note


def write_text_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV part files with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def download(df: DataFrame, most: int = 100_000) -> bytes:
    """A small result as one CSV with a byte-order mark, for spreadsheets; more rows than most are refused."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; use write_text_table")
    return (BOM + rows.to_csv(index=False)).encode()


def write_by_department(df: DataFrame, path: str, department: str = "departamento", mode: str = "overwrite") -> None:
    """Parquet in a folder per department, so that readers of one department skip the others."""
    df.write.mode(mode).partitionBy(department).parquet(path)
