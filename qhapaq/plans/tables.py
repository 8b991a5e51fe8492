"""Inputs of the analysis derived from the star-schema tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qhapaq.shared import ship

VIEWS = {
    "f_demand": """
select c_custkey as cod_ccpp,
  concat(lpad(cast(n_regionkey+1 as varchar(9)),2,'0'), lpad(cast(n_nationkey%3+1 as varchar(9)),2,'0'), lpad(cast(n_nationkey as varchar(9)),2,'0')) as ubigeo_distrito,
  n_name as nombre_distrito, concat(n_name, ' prov') as nombre_provincia, r_name as departamento,
  case when c_acctbal > 0 then c_acctbal else 0e0 end as poblacion,
  case when c_custkey%50 = 0 then '1' else '0' end as capital,
  cast((c_custkey*37)%9500 as double) as altitud_m,
  -81.4e0 + ((c_custkey*7919)%12800)/1000e0 as lon, -18.4e0 + ((c_custkey*104729)%18360)/1000e0 as lat
from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey""",
    "f_facility": """
select s_suppkey as cod_ipress,
  case s_suppkey%10 when 0 then ' ii - 1 ' when 1 then 'III1' when 2 then 'I-3' when 3 then 'I 4' when 4 then 'II-E' when 5 then '0' when 6 then 'S/C' when 7 then 'i-2' when 8 then 'HOSPITAL' else null end as categoria,
  case when s_suppkey%7 = 0 then ' inactivo' else ' Activo ' end as estado,
  case s_suppkey%5 when 0 then 'MINSA' when 1 then 'ESSALUD' when 2 then 'PRIVADO' when 3 then 'SANIDAD PNP' else null end as institucion,
  -81.4e0 + ((s_suppkey*6007)%12800)/1000e0 as lon, -18.4e0 + ((s_suppkey*3571)%18360)/1000e0 as lat
from supplier""",
    "f_matrix": """
select o_custkey as cod_ccpp, l_suppkey as cod_ipress,
  case l_returnflag when 'A' then 'car' when 'N' then 'bike' else 'foot' end as profile,
  min(case when l_discount = 0 or o_custkey%8 = 0 then null else l_extendedprice/3 end) as duration_s,
  min(case when l_discount = 0 or o_custkey%8 = 0 then null else l_quantity*1000 end) as distance_m
from orders join lineitem on o_orderkey=l_orderkey group by o_custkey, l_suppkey, l_returnflag""",
    "f_matrix_gen": """
select o_custkey as cod_ccpp, l_suppkey as cod_ipress, l_returnflag as profile, l_extendedprice/3 as duration_s, l_orderkey as gen, l_linenumber as seq
from orders join lineitem on o_orderkey=l_orderkey""",
    "f_dirty": """
select c_custkey as id,
  case c_custkey%9 when 0 then null when 1 then '0' when 2 then '12.5' when 3 then '-77.0' when 4 then '40.0' when 5 then '77.0' when 6 then 'x1,5' else concat(cast(-12-(c_custkey%5) as varchar(20)),'.0') end as norte,
  case c_custkey%9 when 0 then '-77.0' when 1 then '0' when 2 then '77.0' when 3 then '-12.0' when 4 then '-3.0' when 5 then '12.0' when 6 then '-75.0' else concat(cast(-75-(c_custkey%4) as varchar(20)),'.0') end as este,
  case when c_nationkey%4 = 0 then '999999' else concat('0', cast(10000+c_nationkey as varchar(9))) end as ubigeo
from customer""",
    "f_centre": """
select concat('0', cast(10000+n_nationkey as varchar(9))) as ubigeo, -75e0 - n_nationkey/10e0 as lon, -12e0 - n_nationkey/20e0 as lat from nation""",
    "f_cells": """
select event_id as cell_id, -81.4e0 + ((event_id*7907)%12800)/1000e0 as cx, -18.4e0 + ((event_id*6101)%18360)/1000e0 as cy, value as val from events where value > 0""",
    "f_poly": """
select n_nationkey as poly_id, -81.4e0 + (n_nationkey%5)*2.56e0 as x0, -81.4e0 + (n_nationkey%5+1)*2.56e0 as x1, -18.4e0 + floor(n_nationkey/5)*3.672e0 as y0, -18.4e0 + (floor(n_nationkey/5)+1)*3.672e0 as y1 from nation""",
    "f_edges": """
select a.n_nationkey as src, b.n_nationkey as dst, cast(1 + (a.n_nationkey*13 + b.n_nationkey*7)%20 as bigint) as w
from nation a join nation b on a.n_nationkey<>b.n_nationkey and a.n_nationkey<>24 and b.n_nationkey<>24
 and (b.n_nationkey = (a.n_nationkey+1)%24 or b.n_nationkey = (a.n_nationkey*5+2)%24)""",
    "f_point": """
select l_orderkey as way_id, l_linenumber as i, -80e0 + (l_suppkey%40)/100e0 as lon, -10e0 + (l_partkey%30)/100e0 as lat from lineitem""",
    "f_tags": """
select l_orderkey*10+l_linenumber as edge_id, l_extendedprice as length,
  case l_linenumber%7 when 0 then 'residential' when 1 then 'primary' when 2 then 'motorway' when 3 then 'track' when 4 then 'footway' when 5 then 'secondary' else null end as highway,
  case l_suppkey%9 when 0 then '50' when 1 then '30 km/h' when 2 then '25 mph' when 3 then 'none' when 4 then null when 5 then ' Signals ' when 6 then '40.5' when 7 then 'fast' else '0' end as maxspeed
from lineitem""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input; only the tables that its SQL names are read, and plans stay lazy."""
    ship(spark)
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f"from {t} " in f"{sql} ".replace("\n", " ") or f"join {t} " in f"{sql} ".replace("\n", " ")}
    marked = sql
    for t in tables:
        for word in ("from", "join"):
            marked = marked.replace(f"{word} {t} ", f"{word} {{{t}}} ").replace(f"{word} {t}\n", f"{word} {{{t}}}\n")
            if marked.endswith(f"{word} {t}"):
                marked = marked[: -len(t)] + f"{{{t}}}"
    return spark.sql(marked, **tables)


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """body behind the named inputs as common table expressions, for DuckDB."""
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(f"{n} as ({VIEWS[n]})" for n in names) + (",\n" if body.lstrip().startswith("with ") else "\n") + (
        body.lstrip()[5:] if body.lstrip().startswith("with ") else body)
