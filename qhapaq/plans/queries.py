"""Every analysis operator as a query over the star-schema tables, with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qhapaq.functions import geo, roads, text
from qhapaq.operators import access, graph, metrics, paths, sampling, scenario, spatial, validate
from qhapaq.plans.tables import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, sums: str = "", places: int = 2) -> Callable[[Query], Query]:
    """Register a query. The columns named in sums are rounded on both sides, since the last bits of a sum of doubles
    follow the order of the additions."""
    def keep(f: Query) -> Query:
        names = sums.split()
        QUERIES[name] = f if not names else lambda spark, d: f(spark, d).withColumns({c: F.round(c, places) for c in names})
        if sql:
            SQL[name] = sql if not names else f"select * replace ({', '.join(f'round({c}, {places}) as {c}' for c in names)}) from ({sql})"
        return f

    return keep


def _access(spark: SparkSession, d: str) -> DataFrame:
    return access.nearest_access(view(spark, d, "f_matrix"))


def _base(spark: SparkSession, d: str) -> DataFrame:
    demand = view(spark, d, "f_demand")
    return metrics.base_table(_access(spark, d), demand, demand.select("cod_ccpp", "poblacion"))


def _facilities(spark: SparkSession, d: str) -> DataFrame:
    return validate.facility_status(view(spark, d, "f_facility"))


# fixed parts of the SQL
NEAREST = """
n_access as (
  select cod_ccpp, profile, arg_min(cod_ipress, (duration_s, cod_ipress)) filter (where duration_s is not null) as cod_destino_cercano,
    min(duration_s) as duration_s_min, arg_min(distance_m, (duration_s, cod_ipress)) filter (where duration_s is not null) as distance_m_min
  from f_matrix group by cod_ccpp, profile)"""
TABLE = NEAREST + """,
n_base as (
  select d.cod_ccpp, d.ubigeo_distrito, substr(d.ubigeo_distrito, 1, 4) as ubigeo_provincia, substr(d.ubigeo_distrito, 1, 2) as ubigeo_departamento,
    d.nombre_distrito, d.nombre_provincia, d.departamento, d.altitud_m, a.duration_s_min/60 as t_min, a.distance_m_min/1000 as distance_km,
    a.duration_s_min is not null as found, a.profile, a.cod_destino_cercano, coalesce(d.poblacion, 0) as poblacion, d.capital,
    case when coalesce(d.poblacion, 0) >= 2000 or d.capital in ('1','1.0','True','SI','Sí') then 'urbano' else 'rural' end as urbano_rural
  from f_demand d left join (select * from n_access where profile = 'car') a using (cod_ccpp))"""
FACILITY = """
n_fac as (
  select *, case when k in ('','0','NAN','NONE','S/C','SINCATEGORIA','SINCATEGORÍA') then null
      when regexp_matches(k, '^I{1,3}-?[1-4E]$') then regexp_extract(k, '^(I{1,3})', 1) || '-' || right(k, 1) end as categoria_norm
  from (select *, upper(regexp_replace(categoria, '\\s+', '', 'g')) as k, upper(trim(estado)) as estado_norm from f_facility)),
n_status as (
  select cod_ipress, categoria, categoria_norm, estado_norm, institucion, lon, lat,
    case when categoria_norm in ('II-1','II-2','II-E','III-1','III-2','III-E') then 'resolutiva'
      when categoria_norm in ('I-1','I-2','I-3','I-4') then 'no_concluyente' else 'desconocida' end as categoria_grupo,
    estado_norm = 'ACTIVO' as operativo_activo
  from n_fac),
n_facility as (select *, operativo_activo and categoria_grupo = 'resolutiva' as resolutiva from n_status)"""
BAND = "case when t_min is null then 'sin_ruta' when t_min < 30 then '0-30' when t_min < 60 then '30-60' when t_min < 120 then '60-120' else '>120' end"
AVERAGE = "round(sum(t_min*poblacion)/nullif(sum(poblacion) filter (where t_min is not null), 0), 2)"
LOST = "round(100*(sum(poblacion) - coalesce(sum(poblacion) filter (where t_min is not null), 0))/nullif(sum(poblacion), 0), 2)"


def over_base(body: str) -> str:
    return with_views("with " + TABLE + body, "f_demand", "f_matrix")


@query("nearest_access", with_views("with " + NEAREST + """
select cod_ccpp, profile, cod_destino_cercano, duration_s_min, distance_m_min, duration_s_min/60 as duration_min, distance_m_min/1000 as distance_km,
  duration_s_min is not null as routable from n_access""", "f_matrix"))
def nearest_access(spark, d):
    return _access(spark, d)


@query("nearest_access_resolutive", with_views("with " + FACILITY + """
select m.cod_ccpp, m.profile, arg_min(m.cod_ipress, (m.duration_s, m.cod_ipress)) filter (where m.duration_s is not null and f.cod_ipress is not null) as cod_destino_cercano,
  min(m.duration_s) filter (where f.cod_ipress is not null) as duration_s_min,
  arg_min(m.distance_m, (m.duration_s, m.cod_ipress)) filter (where m.duration_s is not null and f.cod_ipress is not null) as distance_m_min,
  (min(m.duration_s) filter (where f.cod_ipress is not null))/60 as duration_min,
  (arg_min(m.distance_m, (m.duration_s, m.cod_ipress)) filter (where m.duration_s is not null and f.cod_ipress is not null))/1000 as distance_km,
  min(m.duration_s) filter (where f.cod_ipress is not null) is not null as routable
from f_matrix m left join (select cod_ipress from n_facility where resolutiva) f using (cod_ipress) group by m.cod_ccpp, m.profile""", "f_matrix", "f_facility"))
def nearest_access_resolutive(spark, d):
    return access.nearest_access(view(spark, d, "f_matrix"), _facilities(spark, d).filter("resolutiva"))


@query("unroutable_origins", with_views("select cod_ccpp, profile from f_matrix group by cod_ccpp, profile having count(duration_s) = 0", "f_matrix"))
def unroutable_origins(spark, d):
    return access.unroutable(_access(spark, d))


@query("profile_summary", with_views("with " + NEAREST + """
select profile, count(*) as n, median(duration_s_min/60) as mediana, quantile_cont(duration_s_min/60, 0.9) as p90, max(duration_s_min/60) as maximo
from n_access where duration_s_min is not null group by profile""", "f_matrix"), sums="mediana p90 maximo", places=6)
def profile_summary(spark, d):
    return access.profile_summary(_access(spark, d))


@query("matrix_upsert_keep_last", with_views("""
select cod_ccpp, cod_ipress, profile, duration_s from (
  select *, row_number() over (partition by cod_ccpp, cod_ipress, profile order by gen desc, seq desc, duration_s desc) as n from f_matrix_gen) where n = 1""", "f_matrix_gen"))
def matrix_upsert_keep_last(spark, d):
    rows = view(spark, d, "f_matrix_gen")
    return access.keep_last(rows, access.KEY, F.col("gen"), F.col("seq"), F.col("duration_s")).drop("gen", "seq")


@query("matrix_upsert", with_views("""
select cod_ccpp, cod_ipress, profile, duration_s from (
  select *, row_number() over (partition by cod_ccpp, cod_ipress, profile order by g desc) as n from (
    select cod_ccpp, cod_ipress, profile, max(duration_s) as duration_s, gen%2 as g from f_matrix_gen group by all)) where n = 1""", "f_matrix_gen"))
def matrix_upsert(spark, d):
    rows = view(spark, d, "f_matrix_gen").groupBy(*access.KEY, (F.col("gen") % 2).alias("g")).agg(F.max("duration_s").alias("duration_s"))
    return access.upsert(rows.filter("g = 0").drop("g"), rows.filter("g = 1").drop("g"))


@query("mode_comparison", with_views("with " + NEAREST + """,
w as (select cod_ccpp, max(cod_destino_cercano) filter (where profile = 'car') as a, max(cod_destino_cercano) filter (where profile = 'foot') as b,
  max(duration_s_min/60) filter (where profile = 'car') as x, max(duration_s_min/60) filter (where profile = 'foot') as y from n_access group by cod_ccpp)
select round(100*avg(case when a <> b then 1 when a = b then 0 end), 1) as pct_destino_distinto, round(median(y/nullif(x, 0)), 1) as razon_mediana from w""", "f_matrix"))
def mode_comparison(spark, d):
    return access.mode_comparison(_access(spark, d))


@query("base_table", over_base("""
select cod_ccpp, ubigeo_distrito, ubigeo_provincia, ubigeo_departamento, nombre_distrito, nombre_provincia, departamento, altitud_m, t_min, distance_km,
  case when profile is not null then found end as routable, cod_destino_cercano, poblacion, urbano_rural, capital from n_base"""))
def base_table(spark, d):
    return _base(spark, d).drop("lon", "lat")


@query("base_table_unweighted", over_base("select cod_ccpp, t_min, 1e0 as poblacion, case when capital = '1' then 'urbano' else 'rural' end as urbano_rural from n_base"))
def base_table_unweighted(spark, d):
    return metrics.base_table(_access(spark, d), view(spark, d, "f_demand")).select("cod_ccpp", "t_min", "poblacion", "urbano_rural")


@query("coverage_bands", over_base(f"""
select banda, poblacion, round(100*poblacion/sum(poblacion) over (), 2) as share_pct from (select {BAND} as banda, sum(poblacion) as poblacion from n_base group by 1)"""), sums="poblacion")
def coverage_bands(spark, d):
    return metrics.coverage_bands(_base(spark, d))


@query("coverage_bands_by_dept", over_base(f"""
select departamento, banda, poblacion, sum(poblacion) over (partition by departamento) as poblacion_total_grupo,
  round(100*poblacion/sum(poblacion) over (partition by departamento), 2) as share_pct
from (select departamento, {BAND} as banda, sum(poblacion) as poblacion from n_base group by 1, 2)"""), sums="poblacion poblacion_total_grupo")
def coverage_bands_by_dept(spark, d):
    return metrics.coverage_bands(_base(spark, d), group="departamento")


@query("bands_pivot", over_base(f""",
c as (select departamento, banda, round(100*poblacion/sum(poblacion) over (partition by departamento), 2) as s
  from (select departamento, {BAND} as banda, sum(poblacion) as poblacion from n_base group by 1, 2))
select departamento, """ + ", ".join(f"""coalesce(max(s) filter (where banda = '{b}'), 0e0) as "{b}" """ for b in ("0-30", "30-60", "60-120", ">120", "sin_ruta")) + " from c group by departamento"))
def bands_pivot(spark, d):
    return metrics.bands_pivot(metrics.coverage_bands(_base(spark, d), group="departamento"), "departamento")


def _weighted_sql(code: str, name: str | None) -> str:
    keys = ", ".join(k for k in (code, name) if k)
    return over_base(f"""
select {keys}, sum(poblacion) as poblacion, coalesce(sum(poblacion) filter (where t_min is not null), 0) as poblacion_ruteable,
  {LOST} as pct_sin_ruta, {AVERAGE} as acceso_min_ponderado, count(*) as n_centros_poblados from n_base group by {keys}""")


@query("weighted_access_district", _weighted_sql("ubigeo_distrito", "nombre_distrito"), sums="poblacion poblacion_ruteable")
def weighted_access_district(spark, d):
    return metrics.weighted_access(_base(spark, d))


@query("weighted_access_province", _weighted_sql("ubigeo_provincia", None), sums="poblacion poblacion_ruteable")
def weighted_access_province(spark, d):
    return metrics.weighted_access(_base(spark, d), "ubigeo_provincia", None)


@query("weighted_access_dept", _weighted_sql("ubigeo_departamento", "departamento"), sums="poblacion poblacion_ruteable")
def weighted_access_dept(spark, d):
    return metrics.weighted_access(_base(spark, d), "ubigeo_departamento", "departamento")


@query("critical_gaps_top20", over_base(f""",
w as (select ubigeo_distrito, nombre_distrito, {AVERAGE} as acceso_min_ponderado from n_base group by 1, 2)
select *, row_number() over (order by acceso_min_ponderado desc nulls first, ubigeo_distrito) as rank from w order by rank limit 20"""))
def critical_gaps_top20(spark, d):
    areas = metrics.weighted_access(_base(spark, d)).select("ubigeo_distrito", "nombre_distrito", "acceso_min_ponderado")
    return metrics.critical_gaps(areas).withColumn("rank", F.col("rank").cast("long"))


@query("district_rollup", over_base("""
select ubigeo_distrito, nombre_distrito, min(departamento) as departamento, min(nombre_provincia) as provincia, sum(poblacion) as poblacion,
  round(sum(t_min*poblacion)/nullif(sum(poblacion) filter (where t_min is not null), 0), 1) as acceso_min_ponderado,
  round(100*(sum(poblacion) - coalesce(sum(poblacion) filter (where t_min is not null), 0))/nullif(sum(poblacion), 0), 1) as pct_sin_ruta
from n_base group by 1, 2"""), sums="poblacion")
def district_rollup(spark, d):
    return metrics.district_rollup(_base(spark, d))


GINI = """,
g as (select {0} as k, t_min as v, poblacion as w, sum(t_min*poblacion) over (partition by {0} order by t_min, cod_ccpp rows unbounded preceding) as c from n_base where t_min is not null and poblacion > 0)
"""


@query("gini_by_dept", over_base(GINI.format("departamento") + """
select k as departamento, case when count(*) >= 2 and sum(v*w) <> 0 then round(1 - sum(w*(2*c - v*w))/(sum(w)*sum(v*w)), 4) end as gini, cast(count(*) as bigint) as n from g group by k"""))
def gini_by_dept(spark, d):
    return metrics.gini(_base(spark, d), "departamento")


@query("gini_all", over_base(GINI.format("1") + """
select case when count(*) >= 2 and sum(v*w) <> 0 then round(1 - sum(w*(2*c - v*w))/(sum(w)*sum(v*w)), 4) end as gini, cast(count(*) as bigint) as n from g"""))
def gini_all(spark, d):
    return metrics.gini(_base(spark, d))


@query("lorenz_curve", over_base(""",
g as (select t_min as v, sum(poblacion) as w from n_base where t_min is not null and poblacion > 0 group by t_min),
c as (select v, w, sum(w) over (order by v) as cw, sum(v*w) over (order by v) as cv, sum(w) over () as sw, sum(v*w) over () as sv from g),
s as (select (cw-w)/sw as x0, cw/sw as x1, (cv-v*w)/sv as y0, cv/sv as y1 from c),
p as (select i/99e0 as x from range(100) t(i))
select x as pob_acumulada, round(max(y0 + (y1-y0)*(x-x0)/(x1-x0)), 6) as tiempo_acumulado, x as igualdad_perfecta
from p join s on x >= x0 - 1e-12 and x <= x1 + 1e-12 group by x"""))
def lorenz_curve(spark, d):
    return metrics.lorenz(_base(spark, d)).withColumn("tiempo_acumulado", F.round("tiempo_acumulado", 6))


@query("access_ecdf", over_base(""",
g as (select departamento, t_min, sum(poblacion) as w from n_base where t_min is not null and poblacion > 0 group by 1, 2)
select departamento, t_min, round(sum(w) over (partition by departamento order by t_min)/sum(w) over (partition by departamento), 8) as acumulado from g"""))
def access_ecdf(spark, d):
    return metrics.ecdf(_base(spark, d), "departamento").withColumn("acumulado", F.round("acumulado", 8))


@query("urban_rural_contrast", over_base(f"""
select departamento, urbano_rural, sum(poblacion) as poblacion, {AVERAGE} as acceso_min_ponderado,
  round(100*coalesce(sum(poblacion) filter (where t_min <= 60), 0)/nullif(sum(poblacion), 0), 2) as pct_pob_le_umbral, {LOST} as pct_sin_ruta
from n_base group by 1, 2"""), sums="poblacion")
def urban_rural_contrast(spark, d):
    return metrics.settlement_contrast(_base(spark, d))


@query("altitude_strips", over_base(f"""
select case when altitud_m < 500 then 'costa <500' when altitud_m < 1500 then 'yungas 500-1500' when altitud_m < 3500 then 'sierra 1500-3500' else 'puna >3500' end as franja_altitud,
  sum(poblacion) as poblacion, {AVERAGE} as acceso_min_ponderado, round(avg(altitud_m), 0) as altitud_media_m
from n_base where altitud_m >= 0 and altitud_m < 9000 group by 1"""), sums="poblacion")
def altitude_strips(spark, d):
    return metrics.altitude_strips(_base(spark, d))


@query("spearman_altitude", over_base(""",
r as (select rank() over (order by t_min) + (count(*) over (partition by t_min) - 1)/2e0 as a, rank() over (order by altitud_m) + (count(*) over (partition by altitud_m) - 1)/2e0 as b
  from n_base where t_min is not null and altitud_m is not null)
select round(corr(a, b), 4) as spearman, count(*) as n from r"""))
def spearman_altitude(spark, d):
    return metrics.spearman(_base(spark, d))


@query("kpi_summary", over_base("""
select count(*) as n_centros_poblados, sum(poblacion) as poblacion_total, coalesce(sum(poblacion) filter (where t_min <= 60), 0) as poblacion_cubierta,
  coalesce(sum(poblacion) filter (where t_min > 60), 0) as poblacion_lejos, coalesce(sum(poblacion) filter (where t_min is null), 0) as poblacion_sin_ruta, median(t_min) as mediana_min,
  round(100*coalesce(sum(poblacion) filter (where t_min <= 60), 0)/sum(poblacion), 2) as pct_cubierta, round(100*coalesce(sum(poblacion) filter (where t_min is null), 0)/sum(poblacion), 2) as pct_sin_ruta
from n_base"""), sums="poblacion_total poblacion_cubierta poblacion_lejos poblacion_sin_ruta mediana_min")
def kpi_summary(spark, d):
    return metrics.kpis(_base(spark, d))


@query("detour_factor", with_views("with " + NEAREST + """,
e as (select a.distance_m_min/1000 as km, 2*6371.0088*asin(sqrt(pow(sin(radians(f.lat-d.lat)/2), 2) + cos(radians(d.lat))*cos(radians(f.lat))*pow(sin(radians(f.lon-d.lon)/2), 2))) as s
  from n_access a join f_demand d using (cod_ccpp) join f_facility f on f.cod_ipress = a.cod_destino_cercano where a.profile = 'car' and a.duration_s_min is not null)
select round(median(km/s), 4) as factor_rodeo, count(*) as n from e where s > 0.2 and km > 0""", "f_matrix", "f_demand", "f_facility"))
def detour_factor(spark, d):
    return access.detour_factor(_access(spark, d), view(spark, d, "f_demand"), view(spark, d, "f_facility"))


SIMULATED = FACILITY + """,
m as (select m.cod_ccpp, min(m.duration_s/60) filter (where f.resolutiva) as t_antes, min(m.duration_s/60) as t_despues
  from f_matrix m join n_facility f using (cod_ipress) where m.profile = 'car' and (f.resolutiva or f.categoria_norm in ('I-3','I-4') and f.cod_ipress%3 = 0) group by 1),
s as (select d.cod_ccpp, d.poblacion, d.departamento, m.t_antes, m.t_despues from f_demand d left join m using (cod_ccpp))
"""


def _simulated(spark: SparkSession, d: str) -> DataFrame:
    facilities = _facilities(spark, d)
    matrix = view(spark, d, "f_matrix").filter("profile = 'car'").withColumn("duration_min", F.col("duration_s") / 60)
    raised = scenario.candidates(facilities).filter(F.col("cod_ipress") % 3 == 0)  # the facilities chosen in the scenario
    return scenario.times(view(spark, d, "f_demand"), matrix, facilities.filter("resolutiva"), raised)


@query("scenario_times", with_views("with " + SIMULATED + "select * from s", "f_matrix", "f_demand", "f_facility"))
def scenario_times(spark, d):
    return _simulated(spark, d)


@query("scenario_upgrade", with_views("with " + SIMULATED + """,
t as (select sum(poblacion) as poblacion_total, coalesce(sum(poblacion) filter (where t_antes <= 60), 0) as cubierta_antes, coalesce(sum(poblacion) filter (where t_despues <= 60), 0) as cubierta_despues from s)
select *, cubierta_despues - cubierta_antes as ganancia, round(100*cubierta_antes/poblacion_total, 2) as pct_antes, round(100*cubierta_despues/poblacion_total, 2) as pct_despues from t""", "f_matrix", "f_demand", "f_facility"), sums="poblacion_total cubierta_antes cubierta_despues ganancia")
def scenario_upgrade(spark, d):
    return scenario.coverage(_simulated(spark, d))


@query("scenario_gainers", with_views("with " + SIMULATED + """
select departamento, count(*) filter (where t_antes > 60 and t_despues <= 60) as centros_poblados_que_ganan from s group by 1""", "f_matrix", "f_demand", "f_facility"))
def scenario_gainers(spark, d):
    return scenario.gainers(_simulated(spark, d))


@query("category_normalise", with_views("with " + FACILITY + "select cod_ipress, categoria, categoria_norm, categoria_grupo from n_facility", "f_facility"))
def category_normalise(spark, d):
    return _facilities(spark, d).select("cod_ipress", "categoria", "categoria_norm", "categoria_grupo")


@query("facility_status", with_views("with " + FACILITY + "select cod_ipress, estado_norm, operativo_activo, resolutiva from n_facility", "f_facility"))
def facility_status(spark, d):
    return _facilities(spark, d).select("cod_ipress", "estado_norm", "operativo_activo", "resolutiva")


@query("matrix_destinations", with_views("with " + FACILITY + "select cod_ipress, categoria_norm, resolutiva from n_facility where categoria_norm in ('II-1','II-2','II-E','III-1','III-2','III-E','I-3','I-4') or resolutiva", "f_facility"))
def matrix_destinations(spark, d):
    return access.destinations(_facilities(spark, d)).select("cod_ipress", "categoria_norm", "resolutiva")


@query("institution_group", with_views("""
select cod_ipress, case when upper(coalesce(institucion, '')) like '%MINSA%' then 'MINSA / Gob. Regional' when institucion like '%ESSALUD%' then 'EsSalud'
  when institucion like '%PRIVAD%' then 'Privado' when institucion like '%SANIDAD%' then 'Sanidad FF. AA. / PNP' else 'Otro' end as grupo_institucion from f_facility""", "f_facility"))
def institution_group(spark, d):
    return view(spark, d, "f_facility").select("cod_ipress", text.institution_group(F.col("institucion")).alias("grupo_institucion"))


SPEED = """
n_speed as (select *, case when trim(lower(maxspeed)) in ('none','','signals','walk','variable') then null
    when maxspeed like '%mph%' then try_cast(trim(replace(maxspeed, 'mph', '')) as double)*1.60934 else try_cast(split_part(trim(lower(maxspeed)), ' ', 1) as double) end as maxspeed_kmh from f_tags),
n_kmh as (select *, case when maxspeed_kmh <> 0 then maxspeed_kmh else case highway when 'motorway' then 90e0 when 'primary' then 60e0 when 'secondary' then 50e0 when 'track' then 20e0 else 30e0 end end as kmh from n_speed)
"""


@query("maxspeed_parse", with_views("with " + SPEED + "select edge_id, maxspeed_kmh from n_speed", "f_tags"))
def maxspeed_parse(spark, d):
    return view(spark, d, "f_tags").select("edge_id", roads.max_speed(F.col("maxspeed")).alias("maxspeed_kmh"))


@query("edge_travel_time", with_views("with " + SPEED + "select edge_id, kmh, length/(kmh*1000/3600) as segundos from n_kmh", "f_tags"))
def edge_travel_time(spark, d):
    tags = view(spark, d, "f_tags")
    rows = tags.select("edge_id", "length", roads.car_speed(F.col("highway"), roads.max_speed(F.col("maxspeed"))).alias("kmh"))
    return rows.select("edge_id", "kmh", roads.travel_seconds(F.col("length"), F.col("kmh")).alias("segundos"))


@query("haversine", with_views("""
select d.cod_ccpp, f.cod_ipress, round(2*6371000e0*asin(sqrt(pow(sin(radians(f.lat-d.lat)/2), 2) + cos(radians(d.lat))*cos(radians(f.lat))*pow(sin(radians(f.lon-d.lon)/2), 2))), 3) as metros
from f_demand d join f_facility f on f.cod_ipress = d.cod_ccpp%100 + 1""", "f_demand", "f_facility"))
def haversine(spark, d):
    a, b = view(spark, d, "f_demand").alias("d"), view(spark, d, "f_facility").alias("f")
    both = a.join(b, F.col("f.cod_ipress") == F.col("d.cod_ccpp") % 100 + 1)
    return both.select("d.cod_ccpp", "f.cod_ipress", F.round(geo.haversine(F.col("d.lon"), F.col("d.lat"), F.col("f.lon"), F.col("f.lat")), 3).alias("metros"))


@query("mojibake_repair", """
with m as (select doc_id, text, case when doc_id%3 = 0 then replace(replace(text, 'ÿ', 'ñ'), 'Ÿ', 'Ñ') else text end as value from documents)
select doc_id, md5(value) as value_md5, coalesce(doc_id%3 = 0 and regexp_matches(text, '[ñÿŸ]') or doc_id%3 = 1 and regexp_matches(text, '[\\x{80}-\\x{FF}]'), false) as changed from m""")
def mojibake_repair(spark, d):
    """Every third text with wrong letters, every third encoded twice: the repair must give back all texts as they were."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    twice = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    broken = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "ñ", "ÿ")).when(F.col("doc_id") % 3 == 1, twice).otherwise(F.col("text"))
    return docs.select("doc_id", text.repaired(broken).alias("r")).select("doc_id", F.md5("r.value").alias("value_md5"), F.col("r.changed").alias("changed"))


JUDGED = """
j0 as (select id, norte, este, ubigeo, try_cast(norte as double) as y, try_cast(este as double) as x from f_dirty),
j1 as (select *, y is null or x is null as r0, coalesce(abs(y) < 1e-6 or abs(x) < 1e-6, false) and y is not null and x is not null as r1 from j0),
j2 as (select *, case when y > 0 and -y between -18.4 and -0.04 then -y else y end as y1, case when x > 0 and -x between -81.4 and -68.6 then -x else x end as x1 from j1),
j3 as (select *, not r0 and not r1 and (y1 <> y or x1 <> x) as r2,
  not r0 and not r1 and not (y1 between -18.4 and -0.04 and x1 between -81.4 and -68.6) and x1 between -18.4 and -0.04 and y1 between -81.4 and -68.6 as r3 from j2),
j4 as (select *, case when r3 then x1 else y1 end as lat_, case when r3 then y1 else x1 end as lon_ from j3),
j5 as (select *, not r0 and not r1 and not (lat_ between -18.4 and -0.04 and lon_ between -81.4 and -68.6) as r4 from j4)
"""


@query("coord_validation", with_views("with " + JUDGED + "select id, lat_ as _lat, lon_ as _lon from j5 where not r0 and not r1 and not r4", "f_dirty"))
def coord_validation(spark, d):
    return validate.valid_coordinates(validate.judged_coordinates(view(spark, d, "f_dirty"), "norte", "este")).select("id", "_lat", "_lon")


@query("quality_report", with_views("with " + JUDGED + "\nunion all\n".join(f"""
select 'dirty' as dataset, '{name}' as regla, count(*) as registros_evaluados, count(*) filter (where r{i}) as registros_marcados,
  round(100e0*count(*) filter (where r{i})/count(*), 2) as porcentaje, '{action}' as accion from j5""" for i, (name, action) in enumerate(validate.COORDINATE_RULES)), "f_dirty"))
def quality_report(spark, d):
    return validate.coordinate_report(validate.judged_coordinates(view(spark, d, "f_dirty"), "norte", "este"), "dirty")


@query("coord_recovery", with_views("""
with r as (select d.id, d.norte, d.este, c.lat, c.lon, (try_cast(norte as double) is null or try_cast(este as double) is null or abs(try_cast(norte as double)) < 1e-6 or abs(try_cast(este as double)) < 1e-6) as falta
  from f_dirty d left join f_centre c using (ubigeo))
select id, falta and lat is not null as coordenada_recuperada, round(case when falta and lat is not null then lat else try_cast(norte as double) end, 6) as lat,
  round(case when falta and lat is not null then lon else try_cast(este as double) end, 6) as lon from r""", "f_dirty", "f_centre"))
def coord_recovery(spark, d):
    rows = validate.recovered_coordinates(view(spark, d, "f_dirty"), view(spark, d, "f_centre"), "norte", "este", "ubigeo")
    return rows.select("id", "coordenada_recuperada", F.round(text.number(F.col("norte")), 6).alias("lat"), F.round(text.number(F.col("este")), 6).alias("lon"))


@query("dedupe_keep_first", with_views("""
select cod_ccpp, gen, seq, duration_s from (select *, row_number() over (partition by cod_ccpp order by gen, seq, duration_s) as n from f_matrix_gen) where n = 1""", "f_matrix_gen"))
def dedupe_keep_first(spark, d):
    rows = view(spark, d, "f_matrix_gen").select("cod_ccpp", "gen", "seq", "duration_s")
    return validate.deduplicated(rows, "cod_ccpp", F.col("gen"), F.col("seq"), F.col("duration_s"))


@query("scope_filter", with_views("select cod_ccpp, ubigeo_distrito from f_demand where substr(ubigeo_distrito, 1, 2) in ('02','04')", "f_demand"))
def scope_filter(spark, d):
    return validate.in_scope(view(spark, d, "f_demand"), "ubigeo_distrito", ["02", "04"]).select("cod_ccpp", "ubigeo_distrito")


@query("scope_filter_by_name", with_views("select cod_ccpp, departamento from f_demand where upper(departamento) in ('ASIA','EUROPE')", "f_demand"))
def scope_filter_by_name(spark, d):
    return validate.in_scope(view(spark, d, "f_demand"), None, [], "departamento", ["Asia", "Europe"]).select("cod_ccpp", "departamento")


@query("supply_summary", with_views("with " + FACILITY + "select categoria_grupo, count(*) as n, count(*) filter (where resolutiva) as n_resolutivas from n_facility group by 1", "f_facility"))
def supply_summary(spark, d):
    return validate.supply_summary(_facilities(spark, d), "categoria_grupo")


@query("stratified_quota", with_views("""
with q as (select ubigeo_distrito, count(*) as n, count(*)*500/(select count(*) from f_demand)::double as q from f_demand group by 1),
b as (select *, floor(q) as base, round(q - floor(q), 9) as rest from q),
p as (select *, row_number() over (order by rest desc, ubigeo_distrito) as place, 500 - sum(base) over () as left_ from b)
select ubigeo_distrito, n, cast(case when (select count(*) from f_demand) <= 500 then n else least(n, base + case when place <= left_ then 1 else 0 end) end as bigint) as cuota from p""", "f_demand"))
def stratified_quota(spark, d):
    return sampling.quotas(view(spark, d, "f_demand"), 500)


@query("stratified_sample", with_views("""
with q as (select ubigeo_distrito, count(*) as n, count(*)*500/(select count(*) from f_demand)::double as q from f_demand group by 1),
b as (select *, floor(q) as base, round(q - floor(q), 9) as rest from q),
p as (select *, row_number() over (order by rest desc, ubigeo_distrito) as place, 500 - sum(base) over () as left_ from b),
c as (select ubigeo_distrito, case when (select count(*) from f_demand) <= 500 then n else least(n, base + case when place <= left_ then 1 else 0 end) end as cuota from p)
select cod_ccpp, ubigeo_distrito, true as en_muestra from (
  select cod_ccpp, d.ubigeo_distrito, cuota, row_number() over (partition by d.ubigeo_distrito order by md5('42:' || cod_ccpp), cod_ccpp) as i from f_demand d join c using (ubigeo_distrito))
where i <= cuota""", "f_demand"))
def stratified_sample(spark, d):
    return sampling.sample(view(spark, d, "f_demand"), "cod_ccpp", 500).select("cod_ccpp", "ubigeo_distrito", "en_muestra")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "f_facility").select(F.col("cod_ipress").alias("node"), "lon", "lat")


SNAPPED = """
k as (select median(lat) as m from f_facility),
c as (select d.cod_ccpp, d.departamento, f.cod_ipress as node, pow((d.lon-f.lon)*cos(radians(m))*111320, 2) + pow((d.lat-f.lat)*110540, 2) as q,
  2*6371000e0*asin(sqrt(pow(sin(radians(f.lat-d.lat)/2), 2) + cos(radians(d.lat))*cos(radians(f.lat))*pow(sin(radians(f.lon-d.lon)/2), 2))) as h from f_demand d, f_facility f, k),
s as (select cod_ccpp, departamento, arg_min(node, q) as node, arg_min(h, q) as h from c group by 1, 2)
"""


@query("snap_nearest", with_views("with " + SNAPPED + "select cod_ccpp, node, round(h, 3) as snap_dist_m, h <= 1500 as snap_ok from s", "f_demand", "f_facility"))
def snap_nearest(spark, d):
    snaps = spatial.snapped(view(spark, d, "f_demand").select("cod_ccpp", "lon", "lat"), _nodes(spark, d), "cod_ccpp")
    return snaps.select("cod_ccpp", "node", F.round("snap_dist_m", 3).alias("snap_dist_m"), "snap_ok")


@query("snap_summary", with_views("with " + SNAPPED + """
select departamento, count(*) as n_puntos, count(*) filter (where h > 1500) as n_snap_fallido, round(avg(h), 1) as snap_dist_media_m,
  round(quantile_cont(h, 0.95), 1) as snap_dist_p95_m, round(max(h), 1) as snap_dist_max_m from s group by 1""", "f_demand", "f_facility"))
def snap_summary(spark, d):
    snaps = spatial.snapped(view(spark, d, "f_demand").select("cod_ccpp", "departamento", "lon", "lat"), _nodes(spark, d), "cod_ccpp")
    return spatial.snap_summary(snaps, "departamento")


def _polygons(spark: SparkSession, d: str) -> DataFrame:
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    return view(spark, d, "f_poly").select("poly_id", F.array(ring).alias("rings"))


@query("point_in_polygon", with_views("select d.cod_ccpp, min(p.poly_id) as poly_id from f_demand d left join f_poly p on d.lon > x0 and d.lon < x1 and d.lat > y0 and d.lat < y1 group by 1", "f_demand", "f_poly"))
def point_in_polygon(spark, d):
    return spatial.within(view(spark, d, "f_demand").select("cod_ccpp", "lon", "lat"), _polygons(spark, d), "cod_ccpp", "poly_id").select("cod_ccpp", "poly_id")


@query("outside_own_district", with_views("""
select d.cod_ccpp, min(p.poly_id) is null or min(p.poly_id)::varchar <> min(d.own) as fuera_de_su_distrito
from (select *, cast(cast(substr(ubigeo_distrito, 5, 2) as int) as varchar) as own from f_demand) d left join f_poly p on d.lon > x0 and d.lon < x1 and d.lat > y0 and d.lat < y1 group by 1""", "f_demand", "f_poly"))
def outside_own_district(spark, d):
    places = view(spark, d, "f_demand").select("cod_ccpp", "lon", "lat", F.substring("ubigeo_distrito", 5, 2).cast("int").cast("string").alias("own"))
    return spatial.outside_own_district(places, _polygons(spark, d), "cod_ccpp", "own", "poly_id").select("cod_ccpp", "fuera_de_su_distrito")


@query("interior_points", with_views("select poly_id, round((x0+x1)/2, 6) as lon, round((y0+y1)/2, 6) as lat from f_poly", "f_poly"))
def interior_points(spark, d):
    return spatial.interior_points(_polygons(spark, d), "poly_id").select("poly_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("buffered_bounds", with_views("""
select round(min(lon) - degrees(20000/6378137e0), 6) as minx, round(degrees(atan(exp(ln(tan(radians(min(lat))/2 + pi()/4)) - 20000/6378137e0))*2 - pi()/2), 6) as miny,
  round(max(lon) + degrees(20000/6378137e0), 6) as maxx, round(degrees(atan(exp(ln(tan(radians(max(lat))/2 + pi()/4)) + 20000/6378137e0))*2 - pi()/2), 6) as maxy from f_demand""", "f_demand"))
def buffered_bounds(spark, d):
    box = spatial.buffered_bounds(view(spark, d, "f_demand"), 20)
    return box.select(*[F.round(c, 6).alias(c) for c in box.columns])


@query("population_voronoi", with_views("""
with k as (select median(lat) as m from f_demand),
c as (select c.cell_id, c.val, d.cod_ccpp, pow((c.cx-d.lon)*cos(radians(m))*111320, 2) + pow((c.cy-d.lat)*110540, 2) as q from f_cells c, f_demand d, k),
n as (select cell_id, any_value(val) as val, arg_min(cod_ccpp, (q, cod_ccpp)) as cod_ccpp from c group by 1),
s as (select cod_ccpp, sum(val) as s from n group by 1)
select d.cod_ccpp, round(coalesce(s.s, 0), 4) as poblacion from f_demand d left join s using (cod_ccpp)""", "f_cells", "f_demand"))
def population_voronoi(spark, d):
    return spatial.people_by_place(view(spark, d, "f_cells"), view(spark, d, "f_demand").select("cod_ccpp", "lon", "lat"), places_after=4)


@query("population_by_department", with_views("""
with c as (select c.cell_id, c.val, p.poly_id as dep from f_cells c join f_poly p on c.cx > x0 and c.cx < x1 and c.cy > y0 and c.cy < y1),
l as (select d.cod_ccpp, d.lon, d.lat, p.poly_id as dep from f_demand d join f_poly p on d.lon > x0 and d.lon < x1 and d.lat > y0 and d.lat < y1),
k as (select dep, median(lat) as m from l group by 1),
n as (select c.cell_id, any_value(c.val) as val, arg_min(l.cod_ccpp, (pow((f.cx-l.lon)*cos(radians(m))*111320, 2) + pow((f.cy-l.lat)*110540, 2), l.cod_ccpp)) as cod_ccpp
  from c join f_cells f using (cell_id) join l on l.dep = c.dep join k on k.dep = c.dep group by 1)
select l.cod_ccpp, round(coalesce(sum(n.val), 0), 4) as poblacion from l left join n using (cod_ccpp) group by 1""", "f_cells", "f_demand", "f_poly"))
def population_by_department(spark, d):
    polygons = _polygons(spark, d).withColumnRenamed("poly_id", "dep")
    places = spatial.within(view(spark, d, "f_demand").select("cod_ccpp", "lon", "lat"), polygons, "cod_ccpp", "dep").filter("dep is not null")
    return spatial.people_by_place(view(spark, d, "f_cells"), places, group="dep", polygons=polygons, places_after=4)


@query("edge_min_parallel", """
select l_suppkey as src, l_partkey%50 as dst, min(l_extendedprice) as w from lineitem group by 1, 2""")
def edge_min_parallel(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), "l_extendedprice")
    return graph.lightest(rows, "l_extendedprice")


def _points(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "f_point")
    first = rows.groupBy("way_id").agg(F.min(F.struct("i", "lon", "lat")).alias("f"))  # every fifth way is a ring
    pts = rows.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("i", "lon", "lat"))).alias("p")).join(first, "way_id")
    pts = pts.withColumn("p", F.when(F.col("way_id") % 5 == 0, F.array_append("p", F.col("f"))).otherwise(F.col("p")))
    pts = pts.select("way_id", F.transform("p", lambda p: F.struct(p["lon"], p["lat"])).alias("pts"))
    return pts.select("way_id", "pts", F.lit("primary").alias("highway"), F.lit("50").alias("maxspeed"),
                      F.when(F.col("way_id") % 4 == 0, "yes").alias("oneway"), F.lit(None).cast("string").alias("junction"))


POINTS = """
p0 as (select way_id, row_number() over (partition by way_id order by i, lon, lat) as i, lon, lat from f_point),
p1 as (select * from p0 union all select way_id, (select max(i) from p0 q where q.way_id = p0.way_id) + 1, lon, lat from p0 where i = 1 and way_id%5 = 0),
p2 as (select *, cast(round(lon*1e7) as bigint) as x, cast(round(lat*1e7) as bigint) as y, count(*) over (partition by way_id) as n from p1),
u as (select x, y, count(*) as uso from p2 where n >= 2 group by 1, 2),
e as (select p2.*, u.uso, last_value((p2.x, p2.y)) over (partition by way_id order by i rows between unbounded preceding and unbounded following) = (p2.x, p2.y) as fin,
  lag(p2.lon) over w as lon0, lag(p2.lat) over w as lat0, lag(p2.x) over w as x0, lag(p2.y) over w as y0 from p2 join u using (x, y) where n >= 2 window w as (partition by way_id order by i)),
f as (select *, case when i > 1 and (uso >= 2 or fin) then 1 else 0 end as stop,
  coalesce(2*6371000e0*asin(sqrt(pow(sin(radians(lat-lat0)/2), 2) + cos(radians(lat0))*cos(radians(lat))*pow(sin(radians(lon-lon0)/2), 2))), 0) as step from e),
g as (select *, coalesce(sum(stop) over (partition by way_id order by i rows between unbounded preceding and 1 preceding), 0) as seg from f),
h as (select way_id, seg, arg_min(x0, i) as from_x, arg_min(y0, i) as from_y, arg_max(x, i) as to_x, arg_max(y, i) as to_y, sum(step) as length, max(stop) as closed from g where i > 1 group by 1, 2),
s as (select * from h where closed = 1 and (from_x <> to_x or from_y <> to_y) and length > 0)
"""


@query("junction_counts", with_views("with " + POINTS + "select x, y, uso from u", "f_point"))
def junction_counts(spark, d):
    points = graph.way_points(graph.relevant_ways(_points(spark, d), "foot"), "foot")
    return graph.junction_counts(points).select("node.x", "node.y", "uso")


@query("segment_lengths", with_views("with " + POINTS + "select way_id, cast(seg as bigint) as seg, from_x, from_y, to_x, to_y, round(length, 4) as length from s", "f_point"))
def segment_lengths(spark, d):
    seg = graph.segments(graph.way_points(graph.relevant_ways(_points(spark, d), "foot"), "foot"))
    return seg.select("way_id", "seg", F.col("a.x").alias("from_x"), F.col("a.y").alias("from_y"), F.col("b.x").alias("to_x"), F.col("b.y").alias("to_y"), F.round("length", 4).alias("length"))


@query("road_graph_car", with_views("with " + POINTS + """,
d as (select way_id, from_x, from_y, to_x, to_y, length from s union all select way_id, to_x, to_y, from_x, from_y, length from s where way_id%4 <> 0)
select from_x, from_y, to_x, to_y, round(length, 4) as length, 50e0 as speed_kph, round(length/(50*1000/3600e0), 4) as travel_time from d""", "f_point"))
def road_graph_car(spark, d):
    e = graph.edges(_points(spark, d), "car")
    return e.select(F.col("src.x").alias("from_x"), F.col("src.y").alias("from_y"), F.col("dst.x").alias("to_x"), F.col("dst.y").alias("to_y"), F.round("length", 4).alias("length"),
                    "speed_kph", F.round("travel_time", 4).alias("travel_time"))


HOPS = """
hops as (select src as node, src, 0 as d, 0 as hop from f_edges union select h.node, e.src, cast(h.d + e.w as int), h.hop + 1 from hops h join f_edges e on e.dst = h.src where h.hop < 12),
best as (select src, node, min(d) as d from hops group by 1, 2)
"""


@query("shortest_path_matrix", with_views("with " + HOPS + "select src, node, cast(d as double) as distance from best where node%6 = 0", "f_edges", recursive=True))
def shortest_path_matrix(spark, d):
    edges = view(spark, d, "f_edges")
    return paths.distances_to(edges, edges.select(F.col("src").alias("node")).filter("node % 6 = 0"))


@query("shortest_path_relaxed", with_views("with " + HOPS + "select src, node, cast(d as double) as distance from best where node%6 = 0", "f_edges", recursive=True))
def shortest_path_relaxed(spark, d):
    edges = view(spark, d, "f_edges")
    return paths.distances_to(edges, edges.select(F.col("src").alias("node")).filter("node % 6 = 0"), broadcast_bytes=0)


@query("nearest_multi_source", with_views("with " + HOPS + "select src, arg_min(node, (d, node)) as node, cast(min(d) as double) as distance from best where node%6 = 0 group by src", "f_edges", recursive=True))
def nearest_multi_source(spark, d):
    edges = view(spark, d, "f_edges")
    return paths.nearest_of(edges, edges.select(F.col("src").alias("node")).filter("node % 6 = 0"))


@query("od_matrix", with_views("with " + HOPS + """
select o.n_nationkey as cod_ccpp, f.n_nationkey as cod_ipress, cast(case when o.n_nationkey%5 <> 0 then b.d end as double) as duration_s, cast(case when o.n_nationkey%5 <> 0 then b.d*10 end as double) as distance_m
from nation o join nation f on f.n_nationkey%6 = 0 left join best b on b.src = o.n_nationkey and b.node = f.n_nationkey""", "f_edges", recursive=True))
def od_matrix(spark, d):
    edges, nation = view(spark, d, "f_edges"), spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("node"))
    origins = nation.select(F.col("node").alias("cod_ccpp"), "node", (F.col("node") % 5 != 0).alias("snap_ok"))
    ends = nation.filter("node % 6 = 0").select(F.col("node").alias("cod_ipress"), "node", F.lit(True).alias("snap_ok"))
    connected = ends.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    far = edges.withColumn("w", F.col("w") * 10)
    return paths.od_matrix(origins, ends, paths.distances_to(edges, connected), paths.distances_to(far, connected))


ROUTES = """
r0 as (select from_x || ':' || from_y as src, to_x || ':' || to_y as dst, length/(50*1000/3600e0) as w from (
  select way_id, from_x, from_y, to_x, to_y, length from s union all select way_id, to_x, to_y, from_x, from_y, length from s where way_id%4 <> 0)),
rg as (select src, dst, min(w) as w from r0 group by 1, 2),
rf as (select distinct cast(round((-80e0 + s_suppkey%40/100e0)*1e7) as bigint) || ':' || cast(round((-10e0 + s_suppkey*7%30/100e0)*1e7) as bigint) as node from supplier),
t(src, node, d) using key (src, node) as (
  select node, node, 0e0 from rf
  union (select rg.src, t.node, min(t.d + rg.w) as d from t join rg on rg.dst = t.src left join recurring.t k on k.src = rg.src and k.node = t.node
    group by rg.src, t.node having min(t.d + rg.w) < coalesce(min(k.d), 'infinity'::double)))
"""


def _junctions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The car graph with junctions as texts, and the facilities, which stand on junctions."""
    e = graph.edges(_points(spark, d), "car")
    edges = e.select(F.concat_ws(":", "src.x", "src.y").alias("src"), F.concat_ws(":", "dst.x", "dst.y").alias("dst"), F.col("travel_time").alias("w"))
    corner = lambda c, base, n: F.round((base + c % n / 100.0) * 1e7).cast("long").cast("string")
    return edges, spark.read.parquet(f"{d}/supplier.parquet").select(F.concat_ws(":", corner(F.col("s_suppkey"), -80.0, 40), corner(F.col("s_suppkey") * 7, -10.0, 30)).alias("node"))


@query("routing_matrix", with_views("with " + POINTS.strip() + "," + ROUTES + "select src, node, round(d, 3) as distance, round(d/60, 4) as minutos from t", "f_point", recursive=True))
def routing_matrix(spark, d):
    """Seconds and minutes from every junction of the car graph to every facility."""
    far = paths.distances_to(*_junctions(spark, d))
    return far.select("src", "node", F.round("distance", 3).alias("distance"), F.round(F.col("distance") / 60, 4).alias("minutos"))


@query("routing_nearest", with_views("with " + POINTS.strip() + "," + ROUTES + "select src, round(min(d), 3) as distance from t group by src", "f_point", recursive=True))
def routing_nearest(spark, d):
    """Seconds from every junction to its nearest facility, from one search; which of equally near ones it is depends on the last bits."""
    return paths.nearest_of(*_junctions(spark, d)).select("src", F.round("distance", 3).alias("distance"))


@query("connected_component", """
with recursive e as (select c_custkey%97 as a, (c_custkey*7)%53 + 100*(c_custkey%2) as b from customer),
u as (select a, b from e union select b, a from e),
r as (select a as x, a as y from u union select r.x, u.b from r join u on u.a = r.y)
select x as node, min(y) as component from r group by x""")
def connected_component(spark, d):
    c = F.col("c_custkey")
    rows = spark.read.parquet(f"{d}/customer.parquet").select((c % 97).alias("a"), ((c * 7) % 53 + 100 * (c % 2)).alias("b"))
    return graph.components(rows)


@query("largest_component_edges", """
with recursive e as (select distinct c_custkey%97 as src, (c_custkey*7)%53 + 100*(c_custkey%2) as dst from customer),
u as (select src as a, dst as b from e union select dst, src from e),
r as (select a as x, a as y from u union select r.x, u.b from r join u on u.a = r.y),
c as (select x as node, min(y) as component from r group by x),
t as (select component from c group by 1 order by count(*) desc, component limit 1)
select src, dst from e where src in (select node from c join t using (component))""")
def largest_component_edges(spark, d):
    c = F.col("c_custkey")
    rows = spark.read.parquet(f"{d}/customer.parquet").select((c % 97).alias("src"), ((c * 7) % 53 + 100 * (c % 2)).alias("dst")).distinct()
    return graph.largest_component(rows)


LINKED = """
e as (select distinct l_orderkey as src, -(l_partkey*1000000000 + l_suppkey) as dst from lineitem),
u as (select src as a, dst as b from e union all select dst, src from e),
c(node, component) using key (node) as (
  select distinct a, a from u
  union (select o.node, min(n.component) from recurring.c o join u on u.a = o.node join c n on n.node = u.b where n.component < o.component group by 1))
"""


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Orders and what they hold of whom: all rows of lineitem, as orders joined by a part of the same supplier."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select(F.col("l_orderkey").alias("src"), (-(F.col("l_partkey") * 1_000_000_000 + F.col("l_suppkey"))).alias("dst")).distinct()


@query("connected_component_orders", "with recursive " + LINKED.strip() + " select node, component from c")
def connected_component_orders(spark, d):
    return graph.components(_linked(spark, d), "src", "dst")


@query("largest_component_edges_orders", "with recursive " + LINKED.strip() + """,
t as (select component from c group by 1 order by count(*) desc, component limit 1)
select src, dst from e where src in (select node from c join t using (component))""")
def largest_component_edges_orders(spark, d):
    return graph.largest_component(_linked(spark, d))


@query("chain_contraction")
def chain_contraction(spark, d):
    """The ways of lineitem as chains of points, contracted: every way's points that no other way meets fall away."""
    edges, _ = _junctions(spark, d)
    return graph.contracted(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w"))
