"""Accessibility metrics of populated places: coverage, weighted access, gaps, inequality, contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qhapaq.config import SETTINGS, Settings
from qhapaq.functions import labels
from qhapaq.functions.text import padded
from qhapaq.operators.ordered import averaged_ranks, greatest_rows, quantiles, running_sums
from qhapaq.shared import written

TIME, PEOPLE = "t_min", "poblacion"


def _share(part: Column, whole: Column, places: int = 2) -> Column:
    return F.round(100 * F.try_divide(part, F.nullif(whole, F.lit(0.0))), places)


def _routable_people() -> Column:
    return F.coalesce(F.sum(F.when(F.col(TIME).isNotNull(), F.col(PEOPLE))), F.lit(0.0))


def _weighted_minutes(places: int = 2) -> Column:
    return F.round(F.try_divide(F.sum(F.col(TIME) * F.col(PEOPLE)), F.nullif(_routable_people(), F.lit(0.0))), places)


def base_table(access: DataFrame, demand: DataFrame, people: DataFrame | None = None, settings: Settings = SETTINGS) -> DataFrame:
    """One row per populated place: its attributes, minutes by the main profile (null without a route) and people.

    Without a population table every place weighs 1, so that weighted figures are provisional means.
    """
    main = access.filter(F.col("profile") == settings.main_profile).select(
        "cod_ccpp", F.when(F.col("routable"), F.col("duration_min")).alias(TIME), "distance_km", "routable", "cod_destino_cercano")
    code = padded(F.col("ubigeo_distrito"))
    base = demand.withColumns({"ubigeo_distrito": code, "ubigeo_provincia": F.substring(code, 1, 4), "ubigeo_departamento": F.substring(code, 1, 2)})
    base = base.join(main, "cod_ccpp", "left")
    if people is None:
        base = base.withColumn(PEOPLE, F.lit(1.0))
    else:
        base = base.drop(PEOPLE).join(people.select("cod_ccpp", PEOPLE), "cod_ccpp", "left").withColumn(PEOPLE, F.coalesce(PEOPLE, F.lit(0.0)))
    capital = F.col("capital") if "capital" in base.columns else None
    return base.withColumn("urbano_rural", labels.settlement(F.col(PEOPLE), capital, settings.urban_people))


def coverage_bands(base: DataFrame, bands: Sequence[int] = SETTINGS.bands, group: str | None = None) -> DataFrame:
    """People by band of minutes and their share of the group's people; rows with a null group are left out."""
    keys = [group] if group else []
    rows = base.filter(F.col(group).isNotNull()) if group else base
    sums = rows.groupBy(*keys, labels.band(F.col(TIME), bands).alias("banda")).agg(F.sum(PEOPLE).alias(PEOPLE))
    whole = F.sum(PEOPLE).over(Window.partitionBy(*keys))  # over one row per band, not per place
    if not group:
        return sums.withColumn("share_pct", _share(F.col(PEOPLE), whole))
    return sums.withColumn("poblacion_total_grupo", whole).withColumn("share_pct", _share(F.col(PEOPLE), F.col("poblacion_total_grupo")))


def bands_pivot(coverage: DataFrame, group: str, bands: Sequence[int] = SETTINGS.bands) -> DataFrame:
    """Shares with a column per band, 0 where a group has none."""
    names = labels.band_names(bands)
    wide = coverage.groupBy(group).pivot("banda", names).agg(F.max("share_pct"))
    return wide.fillna(0.0, names)


def weighted_access(base: DataFrame, code: str = "ubigeo_distrito", name: str | None = "nombre_distrito", places: int = 2) -> DataFrame:
    """People, people with a route, share without, mean minutes weighted by people with a route, and places, by area."""
    keys = [c for c in (code, name) if c]
    for k in keys:
        base = base.filter(F.col(k).isNotNull())
    out = base.groupBy(*keys).agg(F.sum(PEOPLE).alias(PEOPLE), _routable_people().alias("poblacion_ruteable"),
                                  _weighted_minutes(places).alias("acceso_min_ponderado"), F.count("*").alias("n_centros_poblados"))
    share = _share(F.col(PEOPLE) - F.col("poblacion_ruteable"), F.col(PEOPLE), places)
    return out.select(*keys, PEOPLE, "poblacion_ruteable", share.alias("pct_sin_ruta"), "acceso_min_ponderado", "n_centros_poblados")


def worst_first(areas: DataFrame) -> DataFrame:
    """Areas without a route first, then by falling minutes."""
    return areas.orderBy(F.col("acceso_min_ponderado").desc_nulls_first())


def critical_gaps(areas: DataFrame, n: int = SETTINGS.gaps, code: str = "ubigeo_distrito") -> DataFrame:
    """The n areas with the worst access, numbered; those without a route come first, ties by code."""
    return greatest_rows(areas, n, F.col("acceso_min_ponderado").desc_nulls_first(), F.col(code).asc())


def district_rollup(base: DataFrame) -> DataFrame:
    """District table of the dashboard: one decimal, with the first department and province."""
    rows = base.filter(F.col("ubigeo_distrito").isNotNull() & F.col("nombre_distrito").isNotNull())
    province = F.min("nombre_provincia") if "nombre_provincia" in base.columns else F.lit("")
    out = rows.groupBy("ubigeo_distrito", "nombre_distrito").agg(
        F.min("departamento").alias("departamento"), province.alias("provincia"), F.sum(PEOPLE).alias(PEOPLE),
        _routable_people().alias("_r"), _weighted_minutes(1).alias("acceso_min_ponderado"))
    return out.withColumn("pct_sin_ruta", _share(F.col(PEOPLE) - F.col("_r"), F.col(PEOPLE), 1)).drop("_r")


def _weighed(base: DataFrame, value: str, weight: str, keys: Sequence[str]) -> DataFrame:
    """Finite values with positive weights; equal values of a group as one row, since ties lie on one line."""
    v, w = F.col(value), F.col(weight)
    rows = base.filter(v.isNotNull() & w.isNotNull() & ~F.isnan(v) & ~F.isnan(w) & (F.abs(v) < float("inf")) & (w < float("inf")) & (w > 0))
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    return rows.groupBy(*keys, v.alias("_v")).agg(F.sum(w).alias("_w"), F.count("*").alias("_n")).withColumn("_vw", F.col("_v") * F.col("_w"))


def gini(base: DataFrame, group: str | None = None, value: str = TIME, weight: str = PEOPLE) -> DataFrame:
    """Weighted Gini of a non-negative value: 0 is equal. Null for fewer than two rows or values that add up to 0."""
    keys = [group] if group else []
    rows = _weighed(base, value, weight, keys)
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    placed = running_sums(rows, keys or ["_all"], "_v", {"_cvw": "_vw"})
    area = F.sum(F.col("_w") * (2 * F.col("_cvw") - F.col("_vw")))
    sums = placed.groupBy(*keys).agg(area.alias("_a"), F.sum("_w").alias("_sw"), F.sum("_vw").alias("_svw"), F.sum("_n").alias("n"))
    value_ = F.when((F.col("n") >= 2) & (F.col("_svw") != 0), F.round(1 - F.try_divide(F.col("_a"), F.col("_sw") * F.col("_svw")), 4))
    return sums.select(*keys, value_.alias("gini"), "n")


def lorenz(base: DataFrame, points: int = 100, value: str = TIME, weight: str = PEOPLE) -> DataFrame:
    """Share of the value that the first x of the weight holds, at equally spaced x, by linear interpolation."""
    rows = _weighed(base, value, weight, []).withColumn("_all", F.lit(0))
    placed = running_sums(rows, ["_all"], "_v", {"_cw": "_w", "_cvw": "_vw"})
    total = placed.agg(F.sum("_w").alias("_sw"), F.sum("_vw").alias("_svw"))
    # each distinct value is a segment that ends at its running sums; it is asked for the points inside it
    ends = placed.crossJoin(F.broadcast(total)).select(
        ((F.col("_cw") - F.col("_w")) / F.col("_sw")).alias("x0"), (F.col("_cw") / F.col("_sw")).alias("x1"),
        F.try_divide(F.col("_cvw") - F.col("_vw"), F.col("_svw")).alias("y0"), F.try_divide(F.col("_cvw"), F.col("_svw")).alias("y1"))
    first, last = F.ceil(F.col("x0") * (points - 1) - 1e-9), F.floor(F.col("x1") * (points - 1) + 1e-9)
    inside = ends.filter(first <= last).withColumn("i", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(points - 1)))))
    x = F.col("i") / F.lit(float(points - 1))
    y = F.col("y0") + (F.col("y1") - F.col("y0")) * F.try_divide(x - F.col("x0"), F.col("x1") - F.col("x0"))
    at = inside.groupBy("i").agg(F.max(y).alias("y"))  # a point on a joint is in two segments, with one value
    x = F.col("i") / F.lit(float(points - 1))
    return at.select(x.alias("pob_acumulada"), F.col("y").alias("tiempo_acumulado"), x.alias("igualdad_perfecta"))


def ecdf(base: DataFrame, group: str, value: str = TIME, weight: str = PEOPLE) -> DataFrame:
    """Share of a group's weight at or below each distinct value."""
    rows = _weighed(base, value, weight, [group])
    placed = running_sums(rows, [group], "_v", {"_cw": "_w"})
    totals = rows.groupBy(group).agg(F.sum("_w").alias("_sw"))
    return placed.join(totals, group).select(group, F.col("_v").alias(value), (F.col("_cw") / F.col("_sw")).alias("acumulado"))


def settlement_contrast(base: DataFrame, bands: Sequence[int] = SETTINGS.bands, department: str = "departamento") -> DataFrame:
    """People, weighted minutes, share within the second band limit (inclusive) and share without a route, by
    department and settlement class."""
    limit = bands[1] if len(bands) > 1 else 60
    rows = base.filter(F.col(department).isNotNull())
    inside = F.coalesce(F.sum(F.when(F.col(TIME) <= limit, F.col(PEOPLE))), F.lit(0.0))
    out = rows.groupBy(department, "urbano_rural").agg(F.sum(PEOPLE).alias(PEOPLE), _weighted_minutes().alias("acceso_min_ponderado"),
                                                       inside.alias("_in"), _routable_people().alias("_r"))
    return out.select(department, "urbano_rural", PEOPLE, "acceso_min_ponderado", _share(F.col("_in"), F.col(PEOPLE)).alias("pct_pob_le_umbral"),
                      _share(F.col(PEOPLE) - F.col("_r"), F.col(PEOPLE)).alias("pct_sin_ruta"))


def altitude_strips(base: DataFrame) -> DataFrame:
    """People, weighted minutes and mean height by strip. A relation found here is correlational, not causal."""
    rows = base.withColumn("franja_altitud", labels.strip(F.col("altitud_m"))).filter(F.col("franja_altitud").isNotNull())
    return rows.groupBy("franja_altitud").agg(F.sum(PEOPLE).alias(PEOPLE), _weighted_minutes().alias("acceso_min_ponderado"),
                                              F.round(F.avg("altitud_m"), 0).alias("altitud_media_m"))


def spearman(base: DataFrame, one: str = TIME, other: str = "altitud_m", places: int = 4) -> DataFrame:
    """Rank correlation over the rows that have both values; ties share their mean rank."""
    rows = written(base.filter(F.col(one).isNotNull() & F.col(other).isNotNull()).select(one, other), "pairs")
    ranks = lambda c, n: averaged_ranks(rows, c).withColumnRenamed("rank", n)
    both = rows.join(ranks(one, "_a"), one).join(ranks(other, "_b"), other)
    return both.agg(F.round(F.corr("_a", "_b"), places).alias("spearman"), F.count("*").alias("n"))


def kpis(base: DataFrame, minutes: int = SETTINGS.golden_minutes) -> DataFrame:
    """Whole population, covered within the minutes, beyond, without a route, and the median minutes."""
    t, p = F.col(TIME), F.col(PEOPLE)
    part = lambda c: F.coalesce(F.sum(F.when(c, p)), F.lit(0.0))
    base = written(base.select(TIME, PEOPLE), "kpis")
    sums = base.agg(F.count("*").alias("n_centros_poblados"), F.sum(p).alias("poblacion_total"), part(t <= minutes).alias("poblacion_cubierta"),
                    part(t > minutes).alias("poblacion_lejos"), part(t.isNull()).alias("poblacion_sin_ruta"))
    sums = sums.crossJoin(F.broadcast(quantiles(base, [], TIME, {"mediana_min": 0.5})))  # one row each
    return sums.withColumns({"pct_cubierta": _share(F.col("poblacion_cubierta"), F.col("poblacion_total")),
                             "pct_sin_ruta": _share(F.col("poblacion_sin_ruta"), F.col("poblacion_total"))})
