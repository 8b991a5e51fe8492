"""Stratified samples of places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qhapaq.config import SETTINGS
from qhapaq.operators.ordered import greatest_rows


def quotas(rows: DataFrame, most: int = SETTINGS.sample, stratum: str = "ubigeo_distrito") -> DataFrame:
    """(stratum, n, cuota): proportional quotas that add up to most by largest remainders; all rows if they are fewer.

    Equal remainders go to the smaller stratum code. Null strata get no quota.
    """
    sizes = rows.filter(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("_all"))
    share = sizes.crossJoin(F.broadcast(total)).withColumn("_q", F.col("n") * most / F.col("_all"))
    share = share.withColumns({"_base": F.floor("_q"), "_rest": F.round(F.col("_q") - F.floor("_q"), 9)})
    left = share.agg((F.lit(most) - F.sum("_base")).alias("_left"))
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), F.asc(stratum)))  # one row per stratum, not per place
    got = share.withColumn("_place", place).crossJoin(F.broadcast(left))
    quota = F.when(F.col("_all") <= most, F.col("n")).otherwise(F.col("_base") + (F.col("_place") <= F.col("_left")).cast("int"))
    return got.select(stratum, "n", F.least(quota, F.col("n")).cast("long").alias("cuota"))


def sample(rows: DataFrame, code: str, most: int = SETTINGS.sample, stratum: str = "ubigeo_distrito", seed: int = SETTINGS.seed) -> DataFrame:
    """The quotas' rows of each stratum, drawn without replacement by the MD5 of seed:code; en_muestra is true.

    The draw is the same on every run and partitioning. Strata are districts, thousands of them; each is ordered on its own.
    """
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(code).cast("string"))), F.col(code))
    drawn = rows.join(quotas(rows, most, stratum).select(stratum, "cuota"), stratum).withColumn("_i", F.row_number().over(order))
    return drawn.filter(F.col("_i") <= F.col("cuota")).drop("_i", "cuota").withColumn("en_muestra", F.lit(True))


def sample_report(rows: DataFrame, most: int = SETTINGS.sample, stratum: str = "ubigeo_distrito", seed: int = SETTINGS.seed) -> DataFrame:
    q = quotas(rows, most, stratum)
    return q.agg(F.sum("n").alias("n_total"), F.sum("cuota").alias("n_muestra"), F.round(F.least(F.lit(1.0), most / F.sum("n")), 4).alias("fraccion"),
                 F.count("*").alias("n_distritos"), F.count_if(F.col("cuota") <= 0).alias("distritos_sin_muestra"),
                 F.min(F.when(F.col("cuota") > 0, F.col("cuota"))).alias("puntos_por_distrito_min"), F.max("cuota").alias("puntos_por_distrito_max"),
                 F.lit(seed).alias("semilla"))


def few(rows: DataFrame, n: int = 30, code: str = "cod_ccpp", seed: int = SETTINGS.seed) -> DataFrame:
    """n rows by seeded hash, for a quick look."""
    return greatest_rows(rows, n, F.xxhash64(F.lit(seed), F.col(code).cast("string")), F.col(code)).drop("rank")
