import json

import pytest
from pyspark.sql import functions as F

from qhapaq.sources import reports


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("A & B", 1.25, 1234567, -77.0, -12.0), ("C_1", None, None, -76.0, -11.0), ("C_1", 3.0, 5, None, None)], "departamento string, t double, n long, lon double, lat double")


def test_latex(rows):
    tex = reports.latex_table(rows.select("departamento", "t"), "50 %", "tab:x")
    assert r"A \& B & 1.2 \\" in tex and r"C\_1 & -- \\" in tex and r"\begin{tabular}{lr}" in tex and r"\caption{50 \%}" in tex
    assert reports.latex_macros({"giniTotal": 0.69, "peor": "X_1"}) == "\\newcommand{\\giniTotal}{0.7}\n\\newcommand{\\peor}{X\\_1}\n"
    with pytest.raises(ValueError):
        reports.latex_macros({"a1": 1})
    with pytest.raises(ValueError):
        reports.bounded(rows, 2)


def test_labels_and_numbers(rows):
    assert reports.relabelled(rows, {"t": "Minutos"}).columns == ["Departamento", "Minutos", "N", "Lon", "Lat"]
    assert [r[0] for r in rows.select(reports.thousands(F.col("n"))).collect()] == ["1 234 567", "—", "5"]
    assert [r[0] for r in reports.choices(rows, "departamento").collect()] == ["A & B", "C_1"]
    assert reports.display_cap(rows, "t", 0.5).first()[0] == 2.125


def test_geojson_and_maps(spark, rows, tmp_path):
    polygons = spark.createDataFrame([("1", [[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]]), ("2", None)], "u string, rings array<array<struct<x:double,y:double>>>")
    found = {f["properties"]["u"]: f for f in json.loads(reports.geojson(polygons, spark.createDataFrame([("1", 7)], "u string, v int"), "u"))["features"]}
    assert found["1"]["properties"]["v"] == 7 and found["1"]["geometry"]["coordinates"] == [[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]] and found["2"]["geometry"]["coordinates"] == []
    paths = reports.maps_by_department(rows, tmp_path, ["t"])
    assert len(paths) == 2 and "A &amp; B" in paths[0].read_text() and paths[0].read_text().count("<circle") == 1
