"""Cleaning of facility registers and populated places, and the quality report about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qhapaq.config import SETTINGS, Settings
from qhapaq.functions import text
from qhapaq.operators.access import keep_first

#: The coordinate rules in their order, with what each does.
COORDINATE_RULES = (("coordenadas_vacias_o_no_numericas", "eliminado"), ("coordenadas_en_cero", "eliminado"),
                    ("signo_de_hemisferio_invertido", "corregido"), ("coordenadas_lat_lon_intercambiadas", "corregido"),
                    ("coordenadas_fuera_de_peru", "eliminado"))


def _in_box(lat: Column, lon: Column, s: Settings) -> Column:
    return lat.between(s.box.lat_min, s.box.lat_max) & lon.between(s.box.lon_min, s.box.lon_max)


def judged_coordinates(rows: DataFrame, lat: str, lon: str, settings: Settings = SETTINGS) -> DataFrame:
    """rows with _lat, _lon and one boolean per coordinate rule (_r0 to _r4), nothing dropped.

    The rules act in order on what is left: not a number; as good as zero; wrong sign on an axis whose negative is in
    range; swapped axes; outside the box. A pair that is both negated and swapped is outside.
    """
    s = settings

    def signs(p: Column) -> Column:
        y, x = p["y"], p["x"]
        missing = y.isNull() | x.isNull()
        zero = ~missing & ((F.abs(y) < s.zero) | (F.abs(x) < s.zero))
        flip_y = F.coalesce((y > 0) & (-y).between(s.box.lat_min, s.box.lat_max), F.lit(False))
        flip_x = F.coalesce((x > 0) & (-x).between(s.box.lon_min, s.box.lon_max), F.lit(False))
        return F.struct(missing.alias("r0"), zero.alias("r1"), (~missing & ~zero & (flip_y | flip_x)).alias("r2"),
                        F.when(flip_y, -y).otherwise(y).alias("y"), F.when(flip_x, -x).otherwise(x).alias("x"))

    def axes(p: Column) -> Column:
        swap = ~p["r0"] & ~p["r1"] & ~_in_box(p["y"], p["x"], s) & _in_box(p["x"], p["y"], s)
        return F.struct(p["r0"].alias("r0"), p["r1"].alias("r1"), p["r2"].alias("r2"), swap.alias("r3"),
                        F.when(swap, p["x"]).otherwise(p["y"]).alias("y"), F.when(swap, p["y"]).otherwise(p["x"]).alias("x"))

    # each step is a lambda over an array of one, so its input is worked out once however often it is named
    first = F.array(F.struct(text.number(F.col(lat)).alias("y"), text.number(F.col(lon)).alias("x")))
    rows = rows.withColumn("_j", F.transform(F.transform(first, signs), axes)[0])
    live = ~F.col("_j.r0") & ~F.col("_j.r1")
    flags = {f"_r{i}": F.coalesce(F.col(f"_j.r{i}"), F.lit(False)) for i in range(4)}
    outside = F.coalesce(live & ~_in_box(F.col("_j.y"), F.col("_j.x"), s), F.lit(False))
    return rows.withColumns(flags | {"_r4": outside, "_lat": F.col("_j.y"), "_lon": F.col("_j.x")}).drop("_j")


def valid_coordinates(judged: DataFrame) -> DataFrame:
    flags = [f"_r{i}" for i in range(len(COORDINATE_RULES))]
    return judged.filter(~F.col("_r0") & ~F.col("_r1") & ~F.col("_r4")).drop(*flags)


def report(rows: DataFrame, dataset: str, rules: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """(dataset, regla, registros_evaluados, registros_marcados, porcentaje, accion) for named conditions over rows.

    All rules are counted in one pass; the percentage is null for an empty table.
    """
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"c{i}") for i, (_, c, _) in enumerate(rules)])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("regla"), F.col(f"c{i}").alias("k"), F.lit(action).alias("accion"))
                               for i, (name, _, action) in enumerate(rules)])).alias("r")
    share = F.round(100 * F.try_divide(F.col("r.k"), F.col("n")), 2)
    return counts.select("n", each).select(F.lit(dataset).alias("dataset"), "r.regla", F.col("n").alias("registros_evaluados"),
                                           F.col("r.k").alias("registros_marcados"), share.alias("porcentaje"), "r.accion")


def coordinate_report(judged: DataFrame, dataset: str) -> DataFrame:
    return report(judged, dataset, [(name, F.col(f"_r{i}"), action) for i, (name, action) in enumerate(COORDINATE_RULES)])


def repaired_columns(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Column]:
    """rows with the text columns repaired, and the number of cells that a row had changed as an expression over rows
    before (cells, not rows, are what the report counts)."""
    there = [c for c in columns if c in rows.columns]
    changed = sum((text.repaired(F.col(c))["changed"].cast("long") for c in there), F.lit(0).cast("long"))
    return rows.withColumns({c: text.repaired(F.col(c))["value"] for c in there}), changed


def recovered_coordinates(rows: DataFrame, centres: DataFrame, lat: str, lon: str, code: str, settings: Settings = SETTINGS) -> DataFrame:
    """Where a coordinate is missing or zero on either axis, both are set to the centre of the district that the code
    names. centres: ubigeo, lon, lat. Adds coordenada_recuperada and _falta (was missing)."""
    y, x = text.number(F.col(lat)), text.number(F.col(lon))
    lacks = y.isNull() | x.isNull() | (F.abs(y) < settings.zero) | (F.abs(x) < settings.zero)
    centres = centres.select(text.padded(F.col("ubigeo")).alias("_ub"), F.col("lon").alias("_clon"), F.col("lat").alias("_clat"))
    joined = rows.withColumn("_ub", text.padded(F.col(code))).join(centres, "_ub", "left").withColumn("_falta", lacks)
    found = F.col("_falta") & F.col("_clat").isNotNull()
    return (joined.withColumn("coordenada_recuperada", found)
            .withColumns({lat: F.when(F.col("coordenada_recuperada"), F.col("_clat").cast("string")).otherwise(F.col(lat)),
                          lon: F.when(F.col("coordenada_recuperada"), F.col("_clon").cast("string")).otherwise(F.col(lon))})
            .drop("_ub", "_clon", "_clat"))


def valid_points(rows: DataFrame, lon: str = "lon", lat: str = "lat", settings: Settings = SETTINGS) -> DataFrame:
    """Rows with a point inside the box."""
    return rows.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull() & _in_box(F.col(lat), F.col(lon), settings))


def deduplicated(rows: DataFrame, code: str, *order: Column) -> DataFrame:
    """The first row of each code; null codes count as one code."""
    return keep_first(rows, [code], *order)


def facility_status(rows: DataFrame, category: str = "categoria", state: str = "estado", settings: Settings = SETTINGS) -> DataFrame:
    """Normal category and group, normal state, whether active, and whether resolutive (active and of such a category)."""
    rows = rows.withColumns({"categoria_norm": text.normal_category(F.col(category)), "estado_norm": text.normal_state(F.col(state))})
    rows = rows.withColumns({"categoria_grupo": text.category_group(F.col("categoria_norm"), settings),
                             "operativo_activo": F.coalesce(F.col("estado_norm").isin(*[s.upper() for s in settings.active_states]), F.lit(False))})
    return rows.withColumn("resolutiva", F.col("operativo_activo") & (F.col("categoria_grupo") == "resolutiva"))


def in_scope(rows: DataFrame, code: str | None, prefixes: Sequence[str], name: str | None = None, names: Sequence[str] = ()) -> DataFrame:
    """Rows whose padded code starts with one of the two-digit prefixes, or, without a code, whose upper-case name is one."""
    if code:
        return rows.filter(F.substring(text.padded(F.col(code)), 1, 2).isin(*prefixes))
    return rows.filter(F.upper(F.col(name)).isin(*[n.upper() for n in names]))


def supply_summary(facilities: DataFrame, department: str = "departamento") -> DataFrame:
    return facilities.groupBy(department).agg(F.count("*").alias("n"), F.count_if(F.col("resolutiva")).alias("n_resolutivas"))


def clean_facilities(raw: DataFrame, centres: DataFrame | None = None, settings: Settings = SETTINGS, *order: Column) -> tuple[DataFrame, DataFrame]:
    """The register cleaned, in the order of the rules, and its quality report."""
    columns = ["NOMBRE", "DIRECCION", "INSTITUCION", "UNIDAD_EJECUTORA", "DEPARTAMENTO", "PROVINCIA", "DISTRITO"]
    rows, changed = repaired_columns(raw, columns)
    cells = raw.agg(F.count("*").alias("n"), F.coalesce(F.sum(changed), F.lit(0)).alias("k")).select(
        F.lit("renipress").alias("dataset"), F.lit("encoding_texto_utf8_vs_latin1").alias("regla"), F.col("n").alias("registros_evaluados"),
        F.col("k").alias("registros_marcados"), F.round(100 * F.try_divide("k", "n"), 2).alias("porcentaje"), F.lit("corregido").alias("accion"))
    if centres is None:
        rows = rows.withColumns({"coordenada_recuperada": F.lit(False), "_falta": F.lit(False)})
    else:
        rows = recovered_coordinates(rows, centres, "NORTE", "ESTE", "UBIGEO", settings)
    lacking = report(rows.filter("_falta"), "renipress", [("coordenadas_recuperadas_por_ubigeo", F.col("coordenada_recuperada"), "corregido")])
    judged = judged_coordinates(rows, "NORTE", "ESTE", settings)
    valid = valid_coordinates(judged).drop("_falta")
    unique = deduplicated(valid, "COD_IPRESS", *(order or (F.col("_lat"), F.col("_lon"))))
    clean = facility_status(unique, "CATEGORIA", "ESTADO", settings)
    unknown = report(clean, "renipress", [("categoria_no_reconocida", F.col("categoria_grupo") == "desconocida", "conservado con advertencia")])
    repeated = valid.groupBy("COD_IPRESS").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("k")).select(
        F.lit("renipress").alias("dataset"), F.lit("codigos_duplicados").alias("regla"), F.col("n").alias("registros_evaluados"),
        F.col("k").alias("registros_marcados"), F.round(100 * F.try_divide("k", "n"), 2).alias("porcentaje"), F.lit("eliminado").alias("accion"))
    parts = cells.unionByName(lacking).unionByName(coordinate_report(judged, "renipress")).unionByName(repeated).unionByName(unknown)
    return clean, parts
