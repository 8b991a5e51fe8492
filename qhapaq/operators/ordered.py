"""Running sums over ordered groups without a task for a whole group.

A group is cut into ranges at approximate quantiles of the order. Ranges are summed first; a window inside each range
plus the sum of the ranges before it gives every row's running sum. A group that holds a third of all rows is spread
like all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qhapaq.shared import written

#: Ranges of a group. Their number does not change a result, only how finely a group is spread.
RANGES = 64


def running_sums(rows: DataFrame, groups: Sequence[str], order: str, sums: dict[str, str]) -> DataFrame:
    """rows with a running sum of each column sums[name] as name, from a group's least order up to and with the row.

    order must not be null, and one row at most may have an order in a group (sum ties up before). Null group values
    are groups of their own. rows are read three times (quantiles, sums of ranges, the ranges themselves), so they are written
    to the shared folder first; then they are shuffled once, by group and range.
    """
    keys, rows = list(groups), written(rows, "ordered")
    cuts = [i / RANGES for i in range(1, RANGES)]
    named = [F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)]
    edges = rows.groupBy(*named).agg(F.percentile_approx(order, F.array(*map(F.lit, cuts)), F.lit(10_000)).alias("_edges"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_e{keys.index(k)}"))
    placed = rows.join(edges, same, "left").select(*rows.columns, F.size(F.filter("_edges", lambda e: e < F.col(order))).alias("_range"))
    totals = placed.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"),
                            *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    upto = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumns({f"_s_{n}": F.sum(c).over(upto) for n, c in sums.items()})
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return inside.join(offsets, on).select(*rows.columns, *[(F.col(f"_s_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def averaged_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(column, rank) for each distinct value: ties share the mean of their places, as rank correlation asks."""
    counts = rows.groupBy(column).agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0))
    placed = running_sums(counts, ["_all"], column, {"_upto": "_n"})
    return placed.select(column, (F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"))


def quantiles(rows: DataFrame, groups: Sequence[str], column: str, shares: dict[str, float]) -> DataFrame:
    """The groups with exact quantiles of a column under the names of shares, interpolated linearly between values.

    Nulls don't count. Without groups there is one row, of nulls for an empty table. Values are counted and summed up in
    ranges, so that no task holds a group's values, as the built-in exact percentile does.
    """
    keys = list(groups) or ["_all"]
    live = rows.filter(F.col(column).isNotNull()).withColumn("_all", F.lit(0))
    counts = live.groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_sums(counts, keys, "_v", {"_upto": "_n"})
    totals = placed.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg((F.sum("_n") - 1).alias("_last"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    ranked = placed.join(totals, same)
    picks = {}
    for name, p in shares.items():
        at = F.col("_last") * F.lit(float(p))
        picks |= {f"_lo_{name}": F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v"))), f"_hi_{name}": F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v"))),
                  f"_f_{name}": F.max(at - F.floor(at))}
    found = ranked.groupBy(*groups).agg(*[c.alias(n) for n, c in picks.items()])
    return found.select(*groups, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in shares])


def greatest_rows(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in the order, numbered from 1 in rank. Only those n meet in one task."""
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
