"""Small steps through Arrow batches, so that a worker's memory does not follow their size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 512


def named(column: str) -> F.Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def as_row(docs: DataFrame, keep: list[str] | None = None, **needed: str) -> DataFrame:
    """A struct column row of the columns keep (all, if None), and the needed columns under the given names.

    What operators add stands beside row, so no column of docs can clash with it; select("row.*") gives the rows back.
    """
    keep = docs.columns if keep is None else keep
    return docs.select(F.struct(*map(named, keep)).alias("row"), *[named(c).alias(name) for name, c in needed.items()])


def flat(docs: DataFrame, keep: list[str] | None, **needed: str) -> tuple[DataFrame, list[str], int]:
    """docs with the columns keep (all, if None) as c0, c1, ... and the needed ones under their names; keep; the text's place.

    The plain form of as_row, for Arrow: structs of texts cost executors more memory. row_of makes the struct again. A
    needed column named text is left out where keep has it, so that texts travel once.
    """
    keep = docs.columns if keep is None else keep
    text = needed.pop("text")
    at = keep.index(text) if text in keep else len(keep)
    more = {**({} if text in keep else {"text": text}), **needed}
    return docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)], *[named(c).alias(n) for n, c in more.items()]), keep, at


def row_of(keep: list[str]) -> F.Column:
    return F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]).alias("row")


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ROWS rows; at the end freed memory goes back to the system, as workers are kept."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)
    del batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU C library: nothing to do
        return
