import math

import pytest
from pyspark.sql import functions as F

from qhapaq.operators import access, graph, metrics, ordered, paths, sampling, scenario, spatial, validate


@pytest.fixture(scope="module")
def base(spark):
    rows = [("a", 10.0, 1000.0, "PIURA", "200101", "D1", 50.0, "1"), ("b", 50.0, 100.0, "PIURA", "200101", "D1", 400.0, "0"),
            ("c", 90.0, 10.0, "AYACUCHO", "050101", "D2", 3200.0, "0"), ("d", None, 500.0, "AYACUCHO", "050102", "D3", 3800.0, "0")]
    return spark.createDataFrame(rows, "cod_ccpp string, t_min double, poblacion double, departamento string, ubigeo_distrito string, nombre_distrito string, altitud_m double, capital string")


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_coverage(base):
    got = by(metrics.coverage_bands(base), "banda")
    assert sum(r["share_pct"] for r in got.values()) == pytest.approx(100, abs=0.05)
    assert got["0-30"]["share_pct"] == pytest.approx(100 * 1000 / 1610, abs=0.1)


def test_weighted_access_and_gaps(base):
    areas = metrics.weighted_access(base)
    got = by(areas, "ubigeo_distrito")
    assert got["200101"]["acceso_min_ponderado"] == pytest.approx(13.64, abs=0.05) and got["200101"]["pct_sin_ruta"] == 0
    assert got["050102"]["acceso_min_ponderado"] is None and got["050102"]["pct_sin_ruta"] == 100
    gaps = metrics.critical_gaps(areas, 3).orderBy("rank").collect()
    assert [r["rank"] for r in gaps] == [1, 2, 3] and gaps[0]["ubigeo_distrito"] == "050102"


def weighed(spark, values, weights):
    return spark.createDataFrame(list(zip(map(float, values), map(float, weights))), "t_min double, poblacion double")


def test_gini(spark):
    g = lambda v, w: metrics.gini(weighed(spark, v, w)).first()["gini"]
    assert g([20, 20, 20], [1, 5, 3]) == 0
    assert 0 <= g([10, 12, 11], [1, 1, 1]) < g([1, 1, 100], [1, 1, 1]) <= 1
    assert g([5], [1]) is None and g([0, 0], [1, 1]) is None


def test_gini_follows_formula_over_many_rows(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    v, w = rng.integers(1, 300, 3000).astype(float), rng.random(3000)
    o = np.argsort(v)
    cw, cv = np.r_[0, np.cumsum(w[o]) / w.sum()], np.r_[0, np.cumsum(v[o] * w[o]) / (v * w).sum()]
    assert metrics.gini(weighed(spark, v, w)).first()["gini"] == pytest.approx(1 - 2 * np.trapezoid(cv, cw), abs=1e-4)
    got = sorted(metrics.lorenz(weighed(spark, v, w)).collect())
    assert np.allclose([r[1] for r in got], np.interp([r[0] for r in got], cw, cv), atol=1e-9)


def test_lorenz_ends(spark):
    got = sorted(metrics.lorenz(weighed(spark, [1, 2, 3, 10], [1, 1, 1, 1])).collect())
    assert len(got) == 100 and tuple(got[0])[:2] == (0, 0) and tuple(got[-1])[:2] == (1, pytest.approx(1))


def test_contrast_and_altitude(base):
    full = base.withColumn("urbano_rural", F.when(F.col("capital") == "1", "urbano").otherwise("rural"))
    got = {(r["departamento"], r["urbano_rural"]): r for r in metrics.settlement_contrast(full).collect()}
    assert got["PIURA", "urbano"]["pct_pob_le_umbral"] == 100 and got["AYACUCHO", "rural"]["pct_sin_ruta"] == pytest.approx(100 * 500 / 510, abs=0.01)
    assert set(by(metrics.altitude_strips(base), "franja_altitud")) == {"costa <500", "sierra 1500-3500", "puna >3500"}
    assert metrics.spearman(base).first()["spearman"] == 1


def test_contrast_counts_exactly_sixty(spark):
    rows = spark.createDataFrame([("X", "rural", 60.0, 1.0), ("X", "rural", 61.0, 1.0)], "departamento string, urbano_rural string, t_min double, poblacion double")
    assert metrics.settlement_contrast(rows).first()["pct_pob_le_umbral"] == 50


def test_spearman_with_ties_equals_pandas(spark):
    import pandas as pd
    d = pd.DataFrame({"t_min": [1.0, 2, 2, 3, 5, 5, 5], "altitud_m": [3.0, 1, 4, 4, 9, 2, 6]})
    expect = d.rank()["t_min"].corr(d.rank()["altitud_m"])
    assert metrics.spearman(spark.createDataFrame(d)).first()["spearman"] == pytest.approx(expect, abs=1e-4)


def test_running_sums_with_null_groups_and_one_hot_group(spark):
    rows = [("hot", float(i), 1.0) for i in range(500)] + [(None, float(i), 2.0) for i in range(5)] + [("x", 1.0, 3.0)]
    got = ordered.running_sums(spark.createDataFrame(rows, "g string, o double, w double"), ["g"], "o", {"s": "w"}).collect()
    assert {(r["g"], r["o"]): r["s"] for r in got} == {(g, o): (o + 1) * w if g != "x" else 3.0 for g, o, w in rows}


def test_quantiles_equal_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.integers(0, 50, 997)] + [(None, 3.0), (None, 8.0), ("b", None), ("c", 4.0)]
    got = {r["g"]: (r["m"], r["p"]) for r in ordered.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"m": 0.5, "p": 0.95}).collect()}
    a = [v for g, v in rows if g == "a"]
    assert got["a"] == pytest.approx((np.median(a), np.quantile(a, 0.95))) and got[None] == pytest.approx((5.5, 7.75)) and got["c"] == (4, 4) and "b" not in got
    none = ordered.quantiles(spark.createDataFrame([], "v double"), [], "v", {"m": 0.5}).collect()
    assert [tuple(r) for r in none] == [(None,)]


def test_base_table(spark):
    demand = spark.createDataFrame([("a", "20101", "1"), ("b", "200101", "0")], "cod_ccpp string, ubigeo_distrito string, capital string")
    acc = access.nearest_access(matrix(spark, [("a", "F1", "car", 600.0), ("a", "F1", "foot", 9.0), ("b", "F1", "car", None)]))
    got = by(metrics.base_table(acc, demand), "cod_ccpp")
    assert got["a"]["t_min"] == 10 and got["a"]["ubigeo_departamento"] == "02" and got["a"]["poblacion"] == 1 and got["b"]["t_min"] is None
    people = spark.createDataFrame([("a", 5000.0)], "cod_ccpp string, poblacion double")
    got = by(metrics.base_table(acc, demand, people), "cod_ccpp")
    assert got["a"]["urbano_rural"] == "urbano" and got["b"]["poblacion"] == 0 and got["b"]["urbano_rural"] == "rural"


def matrix(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "cod_ccpp string, cod_ipress string, profile string, duration_s double, distance_m double")


def test_nearest(spark):
    m = matrix(spark, [("O1", "F1", "car", 1200.0), ("O1", "F2", "car", 600.0), ("O2", "F1", "car", None), ("O2", "F2", "car", None), ("O1", "F1", "foot", 9000.0), ("O3", "F9", "car", 5.0), ("O3", "F8", "car", 5.0)])
    got = {(r["cod_ccpp"], r["profile"]): r for r in access.nearest_access(m).collect()}
    assert got["O1", "car"]["cod_destino_cercano"] == "F2" and got["O1", "car"]["duration_min"] == 10 and got["O1", "car"]["routable"]
    assert not got["O2", "car"]["routable"] and got["O2", "car"]["duration_min"] is None and got["O2", "car"]["cod_destino_cercano"] is None
    assert set(got) == {("O1", "car"), ("O1", "foot"), ("O2", "car"), ("O3", "car")} and got["O3", "car"]["cod_destino_cercano"] == "F8"
    only = access.nearest_access(m, spark.createDataFrame([("F1",)], "cod_ipress string"))
    assert {(r["cod_ccpp"], r["profile"]): r["duration_min"] for r in only.collect()}["O1", "car"] == 20


def test_upsert(spark, tmp_path):
    old = matrix(spark, [("O1", "F1", "car", 100.0)])
    new = matrix(spark, [("O1", "F1", "car", 222.0), ("O2", "F1", "car", 300.0)])
    access.upsert(old, new).write.parquet(str(tmp_path / "m"))
    assert {r["cod_ccpp"]: r["duration_s"] for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {"O1": 222, "O2": 300}


def test_sampling(spark):
    strata = [("200101", 5000), ("200102", 8000), ("050301", 4000)]
    rows = spark.createDataFrame([(s, f"{s}-{i}") for s, n in strata for i in range(n)], "ubigeo_distrito string, cod_ccpp string")
    a = sampling.sample(rows, "cod_ccpp", 5000)
    sizes = {r[0]: r[1] for r in a.groupBy("ubigeo_distrito").count().collect()}
    assert sum(sizes.values()) == 5000 and sizes["200102"] > sizes["200101"] > sizes["050301"] and sizes["200102"] == pytest.approx(5000 * 8 / 17, rel=0.05)
    ids = {r[0] for r in a.select("cod_ccpp").collect()}
    assert ids == {r[0] for r in sampling.sample(rows.repartition(7), "cod_ccpp", 5000).select("cod_ccpp").collect()}
    few = rows.limit(100)
    assert sampling.sample(few, "cod_ccpp", 5000).count() == 100 and sampling.sample_report(few).first()["fraccion"] == 1
    tie = sampling.quotas(spark.createDataFrame([("a",), ("b",), ("c",)], "ubigeo_distrito string"), 2)
    assert {r[0]: r["cuota"] for r in tie.collect()} == {"a": 1, "b": 1, "c": 0}


def test_coordinates(spark):
    rows = [(0, "-12", "-77"), (1, None, "-75"), (2, "-8", None), (3, "0", "-79"), (4, "12", "77"), (5, "-77", "-12"), (6, "40", "-3"), (7, "77", "12"), (8, "x", "-75")]
    judged = validate.judged_coordinates(spark.createDataFrame(rows, "id int, lat string, lon string"), "lat", "lon")
    got = {r["id"]: (r["_lat"], r["_lon"]) for r in validate.valid_coordinates(judged).collect()}
    assert got == {0: (-12, -77), 4: (-12, -77), 5: (-12, -77)}
    marks = [r["registros_marcados"] for r in validate.coordinate_report(judged, "t").collect()]
    assert marks == [3, 1, 1, 1, 2]
    none = validate.coordinate_report(judged.filter("false"), "t").first()
    assert none["registros_evaluados"] == 0 and none["porcentaje"] is None


def test_recovery(spark):
    rows = [(1, None, None, "200101"), (2, "-8.4", "-74.5", "200105"), (3, "0", None, "250301"), (4, None, "-74.2", "999999")]
    centres = spark.createDataFrame([("200101", -80.6, -5.2), ("250301", -73.77, -10.73)], "ubigeo string, lon double, lat double")
    got = by(validate.recovered_coordinates(spark.createDataFrame(rows, "id int, NORTE string, ESTE string, UBIGEO string"), centres, "NORTE", "ESTE", "UBIGEO"), "id")
    assert [got[i]["coordenada_recuperada"] for i in (1, 2, 3, 4)] == [True, False, True, False] and got[3]["NORTE"] == "-10.73"
    assert sum(r["_falta"] for r in got.values()) == 3


def test_clean_register(spark):
    columns = "COD_IPRESS string, NOMBRE string, UBIGEO string, NORTE string, ESTE string, CATEGORIA string, ESTADO string"
    rows = [("a", "YÿA", "200101", "-12", "-77", "II-1", "ACTIVO"), ("a", "B", "200101", "-12.5", "-77", "II-1", "ACTIVO"), ("b", "C", "200101", None, None, "0", "CERRADO"), ("c", "D", "1", "50", "50", "I-3", "ACTIVO")]
    centres = spark.createDataFrame([("200101", -80.6, -5.2)], "ubigeo string, lon double, lat double")
    clean, report = validate.clean_facilities(spark.createDataFrame(rows, columns), centres)
    got = by(clean, "COD_IPRESS")
    assert set(got) == {"a", "b"} and got["a"]["resolutiva"] and got["b"]["coordenada_recuperada"] and not got["b"]["resolutiva"]
    marks = {r["regla"]: (r["registros_evaluados"], r["registros_marcados"]) for r in report.collect()}
    assert marks["encoding_texto_utf8_vs_latin1"] == (4, 1) and marks["coordenadas_recuperadas_por_ubigeo"] == (1, 1)
    assert marks["coordenadas_fuera_de_peru"] == (4, 1) and marks["codigos_duplicados"] == (3, 1) and marks["categoria_no_reconocida"] == (2, 1)


def test_keep_first(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4), (None, 5), (None, 6)], "cod string, v int")
    assert sorted((r["cod"] or "", r["v"]) for r in validate.deduplicated(rows, "cod", F.col("v")).collect()) == [("", 5), ("a", 1), ("b", 2), ("c", 4)]


def square(x0, y0, x1, y1):
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


POLYGONS = "ubigeo string, rings array<array<struct<x:double,y:double>>>"


def test_points_in_polygons(spark):
    hole = square(10.0, 0.0, 14.0, 4.0) + square(11.0, 1.0, 13.0, 3.0)
    polygons = spark.createDataFrame([("1", square(0.0, 0.0, 2.0, 2.0)), ("2", square(1.0, 1.0, 3.0, 3.0)), ("3", hole)], POLYGONS)
    points = spark.createDataFrame([("in", 0.5, 0.5, "1"), ("edge", 0.0, 1.0, "1"), ("both", 1.5, 1.5, "2"), ("out", 9.0, 9.0, "1"), ("hole", 12.0, 2.0, "3"), ("ring", 10.5, 2.0, "3"), ("null", None, 1.0, "1")], "id string, lon double, lat double, own string")
    got = {r["id"]: r for r in spatial.outside_own_district(points, polygons, "id", "own").collect()}
    assert {k: r["ubigeo"] for k, r in got.items()} == {"in": "1", "edge": None, "both": "1", "out": None, "hole": None, "ring": "3", "null": None}
    assert {k for k, r in got.items() if not r["fuera_de_su_distrito"]} == {"in", "ring"}
    centre = by(spatial.interior_points(polygons), "ubigeo")["3"]
    assert 10 < centre["lon"] < 11 or 13 < centre["lon"] < 14


def test_nearest_is_exact(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    p, t = rng.normal(0, 50, (300, 2)), np.r_[rng.normal(0, 1, (200, 2)), rng.normal(90, 1, (5, 2))]
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "i long, _x double, _y double")
    targets = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(t)] + [(900, float(t[0][0]), float(t[0][1]))], "j long, _x double, _y double")
    got = {r["i"]: r["j"] for r in spatial.nearest(points, targets, "i", "j").collect()}
    assert got == {i: int(((t - a) ** 2).sum(1).argmin()) for i, a in enumerate(p)}
    assert spatial.nearest(points, targets.filter("false"), "i", "j").count() == 0
    assert spatial.nearest(points.filter("false"), targets, "i", "j").count() == 0


def test_snap(spark):
    nodes = spark.createDataFrame([(1, -77.0, -12.0), (2, -77.1, -12.0)], "node long, lon double, lat double")
    points = spark.createDataFrame([("near", -77.001, -12.0), ("far", -77.0, -12.02)], "id string, lon double, lat double")
    got = by(spatial.snapped(points, nodes, "id"), "id")
    assert got["near"]["snap_ok"] and got["near"]["snap_dist_m"] == pytest.approx(108.8, abs=1) and not got["far"]["snap_ok"]


def test_people(spark):
    cells = spark.createDataFrame([(1, 0.1, 0.1, 5.0), (2, 0.9, 0.9, 7.0), (3, 0.1, 0.2, -1.0), (4, 5.0, 5.0, 9.0), (5, 0.1, 0.1, None)], "cell_id long, cx double, cy double, val double")
    places = spark.createDataFrame([("a", 0.0, 0.0, "g"), ("b", 1.0, 1.0, "g"), ("c", 0.5, 9.0, "h")], "cod_ccpp string, lon double, lat double, g string")
    polygons = spark.createDataFrame([("g", square(-1.0, -1.0, 2.0, 2.0))], POLYGONS.replace("ubigeo", "g"))
    assert {r[0]: r[1] for r in spatial.people_by_place(cells, places, group="g", polygons=polygons).collect()} == {"a": 5, "b": 7, "c": 0}


def test_nearest_of_equal_distances(spark):
    """Two places lie to the left and right of each cell, as far but for rounding: differences are taken before they are scaled."""
    at = [i * 7907 % 12800 for i in range(180)]
    cells = [(i, -81.4 + a / 1000, -18.4 + i * 0.1, 1.0) for i, a in enumerate(at)]
    places = [(2 * i + side, -81.4 + (at[i] + (2 * side - 1) * (i % 40 + 1)) / 1000, y) for i, _, y, _ in cells for side in (0, 1)]
    lats = sorted(y for _, _, y in places)
    scale = math.cos(math.radians((lats[179] + lats[180]) / 2))

    def metres(cell, place):
        dx, dy = (cell[1] - place[1]) * scale * 111320, (cell[2] - place[2]) * 110540
        return dx * dx + dy * dy

    want = {c[0]: min(places, key=lambda p: (metres(c, p), p[0]))[0] for c in cells}
    assert {w - 2 * i for i, w in want.items()} == {0, 1}
    frame = spark.createDataFrame(cells, "cell_id long, cx double, cy double, val double")
    spots = spark.createDataFrame(places, "cod_ccpp long, lon double, lat double")
    got = {r["cod_ccpp"] for r in spatial.people_by_place(frame, spots).filter("poblacion = 1").collect()}
    assert got == set(want.values())
    polygons = spark.createDataFrame([("g", square(-90.0, -20.0, -60.0, 2.0))], POLYGONS.replace("ubigeo", "g"))
    got = {r["cod_ccpp"] for r in spatial.people_by_place(frame, spots.withColumn("g", F.lit("g")), group="g", polygons=polygons).filter("poblacion = 1").collect()}
    assert got == set(want.values())
    snaps = spatial.snapped(frame.select("cell_id", F.col("cx").alias("lon"), F.col("cy").alias("lat")), spots.withColumnRenamed("cod_ccpp", "node"), "cell_id")
    assert {r["cell_id"]: r["node"] for r in snaps.collect()} == want


WAYS = "way_id long, pts array<struct<lon:double,lat:double>>, highway string, maxspeed string, oneway string, junction string, access string"


def test_graph(spark):
    ways = [(1, [(0.0, 0.0), (0.0, 0.001), (0.0, 0.002)], "primary", "50", None, None, None), (2, [(0.0, 0.001), (0.001, 0.001)], "motorway", None, None, None, None),
            (3, [(0.001, 0.001), (0.002, 0.001)], "residential", None, "-1", None, None), (4, [(0.002, 0.001), (0.002, 0.001)], "residential", None, None, None, None),
            (5, [(0.0, 0.002), (0.001, 0.002)], "primary", None, "yes", None, "private"), (6, [(0.5, 0.5), (0.6, 0.5)], "footway", None, None, None, None),
            (7, [(0.002, 0.001), (0.003, 0.001)], "primary", None, None, "roundabout", None)]
    ways = spark.createDataFrame(ways, WAYS)
    ends = lambda e: {((r["src"]["x"], r["src"]["y"]), (r["dst"]["x"], r["dst"]["y"])) for r in e.collect()}
    car = graph.edges(ways, "car")
    a, j, b, c, d, f = (0, 0), (0, 10000), (0, 20000), (10000, 10000), (20000, 10000), (30000, 10000)
    assert ends(car) == {(a, j), (j, a), (j, b), (b, j), (j, c), (c, d), (d, c), (d, f)}
    speeds = {r["highway"]: r["speed_kph"] for r in car.select("highway", "speed_kph").collect()}
    assert speeds == {"primary": 60, "motorway": 90, "residential": 30} or speeds["motorway"] == 90
    foot = graph.edges(ways, "foot")
    assert (j, c) not in ends(foot) and ((5000000, 5000000), (6000000, 5000000)) in ends(foot)
    assert graph.largest_component(car).count() == 8
    assert graph.edges(ways, "car", (0.4, 0.4, 0.7, 0.7)).count() == 0


def test_components_and_contraction(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(path).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    chain = graph.contracted(path.filter("a < 40 and a <> b").withColumn("w", F.lit(2.0))).collect()
    assert [tuple(r) for r in chain] == [(0, 40, 80.0)]


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 9.0), ("a", "c", 5.0), ("c", "a", 1.0), ("x", "y", 1.0), ("a", "q", None)], "src string, dst string, w double")
    ends = spark.createDataFrame([("c",), ("z",)], "node string")
    expect = {("a", "c"): 3, ("b", "c"): 2, ("c", "c"): 0, ("z", "z"): 0}
    for bound in (10_000, 0):
        assert {(r["src"], r["node"]): r["distance"] for r in paths.distances_to(edges, ends, broadcast_bytes=bound).collect()} == expect
        asked = spark.createDataFrame([("a",), ("z",), ("none",)], "node string")
        assert {(r["src"], r["node"]): r["distance"] for r in paths.distances_to(edges, ends, origins=asked, broadcast_bytes=bound).collect()} == {("a", "c"): 3, ("z", "z"): 0}
        sources = spark.createDataFrame([("c",), ("b",), ("y",), ("off",)], "node string")
        near = {r["src"]: (r["node"], r["distance"]) for r in paths.nearest_of(edges, sources, broadcast_bytes=bound).collect()}
        assert near.pop("off") == ("off", 0)
    assert near == {"a": ("b", 1), "b": ("b", 0), "c": ("c", 0), "x": ("y", 1), "y": ("y", 0)}
    origins = spark.createDataFrame([("o1", "a", True), ("o2", "b", False), ("o3", "x", True)], "cod_ccpp string, node string, snap_ok boolean")
    facilities = spark.createDataFrame([("f", "c", True)], "cod_ipress string, node string, snap_ok boolean")
    od = {r["cod_ccpp"]: r["duration_s"] for r in paths.od_matrix(origins, facilities, paths.distances_to(edges, ends)).collect()}
    assert od == {"o1": 3, "o2": None, "o3": None}


def test_searches_agree_with_joins(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 900), rng.integers(0, 45, 900), rng.integers(0, 5, 900))], "src long, dst long, w double")
    ends = spark.createDataFrame([(3,), (44,), (17,)], "node long")
    got = [{(r[0], r[1]): r[2] for r in d.collect()} for d in (paths.distances_to(edges, ends), paths.distances_to(edges, ends, broadcast_bytes=0))]
    assert got[0] == got[1]
    near = [{r[0]: (r[1], r[2]) for r in d.collect()} for d in (paths.nearest_of(edges, ends), paths.nearest_of(edges, ends, broadcast_bytes=0))]
    assert near[0] == near[1] == {s: min((d, n) for (x, n), d in got[0].items() if x == s)[::-1] for s, _ in got[0]}
    nodes, by_number = paths.numbered(edges.filter("src <> dst"))
    assert sorted(r["i"] for r in nodes.collect()) == list(range(nodes.count()))



def test_scenario_counts_places_without_a_route_in_the_gain_only(spark):
    base = spark.createDataFrame([("p", 10.0, "D"), ("q", 20.0, "D"), ("r", 30.0, "D")], "cod_ccpp string, poblacion double, departamento string")
    m = spark.createDataFrame([("p", "R", 90.0), ("p", "C", 30.0), ("q", "R", None), ("q", "C", 40.0), ("r", "R", 10.0)], "cod_ccpp string, cod_ipress string, duration_min double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "cod_ipress string")
    sim = scenario.times(base, m, ids("R"), ids("C"))
    assert scenario.coverage(sim).first()["ganancia"] == 30 and scenario.gainers(sim).first()["centros_poblados_que_ganan"] == 1


def test_mode_comparison(spark):
    acc = access.nearest_access(matrix(spark, [("a", "F1", "car", 60.0), ("a", "F2", "foot", 600.0), ("b", "F1", "car", 60.0), ("b", "F1", "foot", 1200.0), ("c", "F1", "car", 60.0)]))
    assert tuple(access.mode_comparison(acc).first()) == (50.0, 15.0)


def test_empty_tables(base):
    none = base.filter("false")
    assert metrics.coverage_bands(none).count() == 0 and metrics.weighted_access(none).count() == 0 and metrics.lorenz(none).count() == 0
    assert metrics.gini(none).first()["gini"] is None and metrics.kpis(none).first()["poblacion_total"] is None
