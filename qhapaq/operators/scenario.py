"""What if some facilities were raised to resolutive ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qhapaq.config import SETTINGS, Settings


def candidates(facilities: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Facilities that a scenario can raise, with a label for choosing."""
    label = F.concat_ws("  —  ", *[F.initcap(c) for c in ("nombre",) if c in facilities.columns], F.col("categoria_norm"), F.col("cod_ipress").cast("string"))
    return facilities.filter(F.col("categoria_norm").isin(*settings.upgradable)).withColumn("etiqueta", label)


def times(base: DataFrame, matrix: DataFrame, resolutive: DataFrame, raised: DataFrame) -> DataFrame:
    """Each place with the least minutes to resolutive facilities (t_antes) and to those or raised ones (t_despues).

    resolutive and raised hold cod_ipress. One join and one aggregation of the matrix serve both times.
    """
    kinds = resolutive.select("cod_ipress", F.lit(True).alias("_now")).unionByName(raised.select("cod_ipress", F.lit(False).alias("_now")))
    kinds = kinds.groupBy("cod_ipress").agg(F.bool_or("_now").alias("_now"))
    best = matrix.join(kinds, "cod_ipress").groupBy("cod_ccpp").agg(
        F.min(F.when(F.col("_now"), F.col("duration_min"))).alias("t_antes"), F.min("duration_min").alias("t_despues"))
    return base.select("cod_ccpp", "poblacion", "departamento").join(best, "cod_ccpp", "left")


def coverage(simulated: DataFrame, minutes: int = SETTINGS.golden_minutes) -> DataFrame:
    """People covered before and after, and the gain, which counts places that had no route before."""
    part = lambda c: F.coalesce(F.sum(F.when(F.col(c) <= minutes, F.col("poblacion"))), F.lit(0.0))
    out = simulated.agg(F.sum("poblacion").alias("poblacion_total"), part("t_antes").alias("cubierta_antes"), part("t_despues").alias("cubierta_despues"))
    share = lambda c: F.round(100 * F.try_divide(F.col(c), F.col("poblacion_total")), 2)
    return out.withColumn("ganancia", F.col("cubierta_despues") - F.col("cubierta_antes")).withColumns(
        {"pct_antes": share("cubierta_antes"), "pct_despues": share("cubierta_despues")})


def gainers(simulated: DataFrame, minutes: int = SETTINGS.golden_minutes) -> DataFrame:
    """Places by department that come from beyond the minutes to within; those without a route before don't count."""
    gains = (F.col("t_antes") > minutes) & (F.col("t_despues") <= minutes)
    return simulated.filter(F.col("departamento").isNotNull()).groupBy("departamento").agg(F.count_if(gains).alias("centros_poblados_que_ganan"))
