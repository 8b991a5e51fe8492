"""Travel-time matrices: keeping them current, and the nearest facility of each origin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qhapaq.config import SETTINGS, Settings
from qhapaq.operators.ordered import quantiles
from qhapaq.shared import written

KEY = ("cod_ccpp", "cod_ipress", "profile")


def keep_last(rows: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the last in the order (nulls first). Equal keys include null ones."""
    last = Window.partitionBy(*key).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def keep_first(rows: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    first = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """old and new as one table in which a key's newer row counts."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, key, F.col("_gen")).drop("_gen")


def destinations(facilities: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Facilities that are ends of car trips: a matrix category, whether active or not, or a resolutive one."""
    return facilities.filter(F.col("categoria_norm").isin(*settings.matrix_categories) | F.coalesce("resolutiva", F.lit(False)))


def nearest_access(matrix: DataFrame, resolutive: DataFrame | None = None) -> DataFrame:
    """The least duration of each (origin, profile); an origin that reaches nothing is there with routable false.

    By default over all destinations of the matrix; with resolutive (a column cod_ipress) only over those, which is what
    the method's description promises. Equal durations go to the smaller facility code. One aggregation, no join.
    """
    if resolutive is not None:  # a left join, since origins that reach no such facility stay
        matrix = matrix.join(resolutive.select("cod_ipress", F.lit(True).alias("_ok")).distinct(), "cod_ipress", "left")
        matrix = matrix.withColumn("duration_s", F.when(F.col("_ok"), F.col("duration_s")))
    best = F.min(F.when(F.col("duration_s").isNotNull(), F.struct("duration_s", "cod_ipress", "distance_m")))
    return matrix.groupBy("cod_ccpp", "profile").agg(best.alias("b")).select(
        "cod_ccpp", "profile", F.col("b.cod_ipress").alias("cod_destino_cercano"), F.col("b.duration_s").alias("duration_s_min"),
        F.col("b.distance_m").alias("distance_m_min"), (F.col("b.duration_s") / 60).alias("duration_min"),
        (F.col("b.distance_m") / 1000).alias("distance_km"), F.col("b").isNotNull().alias("routable"))


def unroutable(access: DataFrame) -> DataFrame:
    return access.filter(~F.col("routable")).select("cod_ccpp", "profile")


def profile_summary(access: DataFrame) -> DataFrame:
    """Median, 90th percentile and greatest minutes by profile, over routable origins."""
    rows = written(access.filter("routable").select("profile", "duration_min"), "routable")
    sums = rows.groupBy("profile").agg(F.count("*").alias("n"), F.max("duration_min").alias("maximo"))
    return sums.join(quantiles(rows, ["profile"], "duration_min", {"mediana": 0.5, "p90": 0.9}), "profile").select("profile", "n", "mediana", "p90", "maximo")


def mode_comparison(access: DataFrame, one: str = "car", other: str = "foot") -> DataFrame:
    """Share of origins whose nearest facility differs between two profiles, and the median ratio of times."""
    of = lambda p, c: F.max(F.when(F.col("profile") == p, F.col(c)))
    wide = access.filter(F.col("profile").isin(one, other)).groupBy("cod_ccpp").agg(
        of(one, "cod_destino_cercano").alias("a"), of(other, "cod_destino_cercano").alias("b"),
        of(one, "duration_min").alias("x"), of(other, "duration_min").alias("y"))
    wide = written(wide.select((F.col("a") != F.col("b")).cast("int").alias("differs"), F.try_divide("y", F.nullif("x", F.lit(0.0))).alias("ratio")), "modes")
    share = wide.agg(F.round(100 * F.avg("differs"), 1).alias("pct_destino_distinto"))
    middle = quantiles(wide, [], "ratio", {"m": 0.5}).select(F.round("m", 1).alias("razon_mediana"))
    return share.crossJoin(F.broadcast(middle))  # one row each


def detour_factor(access: DataFrame, places: DataFrame, facilities: DataFrame, least_km: float = 0.2) -> DataFrame:
    """Median of road over straight distance of routable car trips longer than least_km."""
    from qhapaq.functions.geo import EARTH_KM, haversine

    ends = (access.filter((F.col("profile") == "car") & F.col("routable"))
            .join(places.select("cod_ccpp", F.col("lon").alias("cx"), F.col("lat").alias("cy")), "cod_ccpp")
            .join(facilities.select(F.col("cod_ipress").alias("cod_destino_cercano"), F.col("lon").alias("fx"), F.col("lat").alias("fy")), "cod_destino_cercano"))
    straight = haversine(F.col("cx"), F.col("cy"), F.col("fx"), F.col("fy"), EARTH_KM)
    kept = ends.withColumn("recta_km", straight).filter((F.col("recta_km") > least_km) & (F.col("distance_km") > 0))
    ratios = written(kept.select((F.col("distance_km") / F.col("recta_km")).alias("ratio")), "detours")
    middle = quantiles(ratios, [], "ratio", {"m": 0.5}).select(F.round("m", 4).alias("factor_rodeo"))
    return middle.crossJoin(F.broadcast(ratios.agg(F.count("*").alias("n"))))  # one row each
