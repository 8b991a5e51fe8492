import hashlib
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from qhapaq.config import Settings
from qhapaq.plans import queries, routing, tables
from qhapaq.streaming import nearest

WAYS = "way_id long, pts array<struct<lon:double,lat:double>>, highway string, maxspeed string, oneway string, junction string"


def test_routing_end_to_end(spark):
    line = [(i * 0.001, 0.0) for i in range(5)]
    ways = spark.createDataFrame([(1, line, "primary", "36", None, None), (2, [line[2], (0.002, 0.001)], "footway", None, None, None)], WAYS)
    places = spark.createDataFrame([("a", 0.0, 0.0), ("far", 1.0, 1.0), ("b", 0.004, 0.0)], "cod_ccpp string, lon double, lat double")
    facilities = spark.createDataFrame([("R", 0.004, 0.0, "II-1", True), ("C", 0.0, 0.0, "I-3", False), ("X", 0.0, 0.0, "I-1", False)],
                                       "cod_ipress string, lon double, lat double, categoria_norm string, resolutiva boolean")
    out = routing.routed(places, facilities, ways, ("car", "foot"), settings=Settings())
    got = {(r["cod_ccpp"], r["cod_ipress"], r["profile"]): r for r in out.matrix.collect()}
    metres = 4 * 0.001 * 111_194.9
    assert abs(got["a", "R", "car"]["distance_m"] - metres) < 0.5 and abs(got["a", "R", "car"]["duration_s"] - metres / 10) < 0.1
    assert got["far", "R", "car"]["duration_s"] is None and got["far", None, "foot"]["duration_s"] is None and ("a", "X", "car") not in got
    assert abs(got["a", "R", "foot"]["duration_s"] - metres / 1.25) < 0.5 and got["a", "R", "foot"]["distance_m"] is None
    near = {(r["cod_ccpp"], r["profile"]): r["cod_destino_cercano"] for r in out.access().collect()}
    assert near["a", "car"] == "C" and near["a", "foot"] == "R" and near["far", "car"] is None
    report = {(r["profile"], r["tipo"]): r for r in out.snap_report().collect()}
    assert report["car", "demanda"]["n_puntos"] == 3 and report["car", "demanda"]["n_snap_fallido"] == 1


def test_routing_by_department(spark):
    line = [(i * 0.001, 0.0) for i in range(9)]
    ways = spark.createDataFrame([(1, line, "primary", "36", None, None)], WAYS)
    places = spark.createDataFrame([("a", 0.0, 0.0, "Piura"), ("b", 0.004, 0.0, "UCAYALI"), ("c", 0.0, 0.0, "Loreto")], "cod_ccpp string, lon double, lat double, departamento string")
    facilities = spark.createDataFrame([("P", 0.008, 0.0, "II-1", True, "PIURA"), ("U", 0.001, 0.0, "II-1", True, "Ucayali")],
                                       "cod_ipress string, lon double, lat double, categoria_norm string, resolutiva boolean, departamento string")
    graphs = {}
    out = routing.routed(places, facilities, ways, ("car", "bike", "plane"), departments=("Piura", "Ucayali"), boxes={"Piura": (-1.0, -1.0, 1.0, 1.0)}, graphs=graphs)
    assert set(out.failed) == {("Piura", "plane"), ("Ucayali", "plane")} and len(graphs) == 4
    near = {(r["cod_ccpp"], r["profile"]): r["cod_destino_cercano"] for r in out.access().collect()}
    assert near == {("a", "car"): "P", ("a", "bike"): "P", ("b", "car"): "U", ("b", "bike"): "U"}  # the nearer one is across the border


def test_stream_keeps_the_minimum(spark, tmp_path):
    rows = [[("o", "F1", "car", 50.0, None)], [("o", "F2", "car", 20.0, 7.0), ("p", "F1", "car", None, None)], [("o", "F3", "car", 99.0, None)]]
    for batch in rows:
        spark.createDataFrame(batch, nearest.MATRIX).write.mode("append").parquet(str(tmp_path / "in"))
        nearest.keep_current(nearest.matrix_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["cod_ccpp"]: r for r in nearest.current(spark, str(tmp_path / "out")).collect()}
    assert got["o"]["cod_destino_cercano"] == "F2" and got["o"]["duration_s_min"] == 20 and not got["p"]["routable"]


def test_queries_and_sql_have_the_same_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(queries.SQL) >= len(queries.QUERIES) - 3


def test_components_of_all_orders(spark):
    d = "/root/testdata/sf0.001"
    least, edges = {}, {(r[0], -(r[1] * 1_000_000_000 + r[2])) for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey").collect()}

    def of(n):
        while least.setdefault(n, n) != n:
            n = least[n]
        return n

    for a, b in edges:
        x, y = of(a), of(b)
        least[max(x, y)] = min(x, y)
    labels = {n: of(n) for n in list(least)}
    got = [tuple(r) for r in entry.queries()["connected_component_orders"](spark, d).select("node", "component").collect()]
    assert len(got) == len(labels) and dict(got) == labels and len(set(labels.values())) > 1
    sizes = Counter(labels.values())
    top = min(sizes, key=lambda c: (-sizes[c], c))
    got = [tuple(r) for r in entry.queries()["largest_component_edges_orders"](spark, d).select("src", "dst").collect()]
    assert len(got) == len(set(got)) and set(got) == {e for e in edges if labels[e[0]] == top}


def test_mojibake_repair_returns_every_document(spark, tmp_path):
    """Twice-encoded texts come back decoded, those that cannot be decoded as they are, null as null."""
    raw = {1: "José Ibáñez".encode().decode("latin-1"), 2: "SÃO JOÃO", 3: "AÃ±o", 4: None, 5: "Â\ufffd", 6: None, 7: "plain", 8: "Ãÿ 日", 9: "niño", 10: "São Ãÿ"}
    spark.createDataFrame(list(raw.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def repaired(i, t):
        given = t.replace("ñ", "ÿ") if i % 3 == 0 and t else t
        if given is None:
            return None, False
        out = given.replace("ÿ", "ñ").replace("Ÿ", "Ñ")
        if any(c in out for c in "ÃÂ\ufffd"):
            try:
                out = out.encode("latin-1").decode()
            except UnicodeError:
                pass
        return hashlib.md5(out.encode()).hexdigest(), out != given

    got = queries.QUERIES["mojibake_repair"](spark, str(tmp_path)).collect()
    assert len(got) == len(raw) and {r["doc_id"]: (r["value_md5"], r["changed"]) for r in got} == {i: repaired(i, t) for i, t in raw.items()}


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_scans_read_only_what_they_need(spark):
    plan = tables.view(spark, "/root/testdata/sf0.001", "f_matrix").select(F.col("cod_ccpp"))._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "o_orderdate" not in plan
