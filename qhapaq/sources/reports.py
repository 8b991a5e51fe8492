"""Small results as LaTeX, number macros, GeoJSON and HTML maps.

Each of these brings a bounded result to the driver and refuses a larger one; none is meant for tables of places.
"""

from __future__ import annotations

import html
import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qhapaq.operators.ordered import quantiles

MOST_ROWS = 5_000
ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def bounded(df: DataFrame, most: int = MOST_ROWS) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def relabelled(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns under their display names; those without one have blanks for underscores and a capital."""
    return df.withColumnsRenamed({c: names.get(c, c.replace("_", " ").capitalize()) for c in df.columns})


def thousands(value: Column, places: int = 0) -> Column:
    """Digits in groups of three with blanks; a dash for null."""
    return F.coalesce(F.replace(F.format_number(value, places), F.lit(","), F.lit(" ")), F.lit("—"))


def choices(df: DataFrame, column: str) -> DataFrame:
    """The sorted distinct values that a filter offers."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def display_cap(df: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """The percentile that a colour scale or axis ends at."""
    return quantiles(df, [], column, {"tope": share})


def _shown(value: object, places: int) -> str:
    if value is None or value != value:
        return "--"
    if isinstance(value, float):
        return f"{value:.{places}f}"
    return "".join(ESCAPES.get(c, c) for c in str(value))


def latex_table(df: DataFrame, caption: str, label: str, places: int = 1) -> str:
    """A table environment; numbers are flush right."""
    kinds = "".join("r" if isinstance(f.dataType, T.NumericType) else "l" for f in df.schema)
    lines = [" & ".join(_shown(v, places) for v in row) + r" \\" for row in bounded(df)]
    head = " & ".join(_shown(c, places) for c in df.columns) + r" \\"
    body = "\n".join([r"\toprule", head, r"\midrule", *lines, r"\bottomrule"])
    return f"\\begin{{table}}\n\\caption{{{_shown(caption, places)}}}\n\\label{{{label}}}\n\\begin{{tabular}}{{{kinds}}}\n{body}\n\\end{{tabular}}\n\\end{{table}}\n"


def latex_macros(values: Mapping[str, object], places: int = 1) -> str:
    """A command per value; names must be letters, as LaTeX asks."""
    if bad := [k for k in values if not (k.isascii() and k.isalpha())]:
        raise ValueError(f"not LaTeX names: {bad}")
    return "".join(f"\\newcommand{{\\{k}}}{{{_shown(v, places)}}}\n" for k, v in values.items())


def geojson(polygons: DataFrame, attributes: DataFrame, key: str) -> str:
    """Polygons (key, rings) with the attributes of their key as feature properties; those without any keep the key."""
    rows = bounded(polygons.select(key, "rings").join(attributes, key, "left"))
    features = [{"type": "Feature", "properties": {c: r[c] for c in attributes.columns},
                 "geometry": {"type": "Polygon", "coordinates": [[[p["x"], p["y"]] for p in ring] for ring in r["rings"] or []]}} for r in rows]
    return json.dumps({"type": "FeatureCollection", "features": features}, ensure_ascii=False, default=str)


def html_map(points: DataFrame, title: str, popup: Sequence[str], colour: str | None = None, size: int = 800) -> str:
    """Points (lon, lat) as circles of an SVG page with their attributes as tooltips; nothing is loaded from elsewhere."""
    rows = bounded(points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()))
    xs, ys = [r["lon"] for r in rows] or [0.0], [r["lat"] for r in rows] or [0.0]
    span = max(max(xs) - min(xs), max(ys) - min(ys)) or 1.0
    dots = "".join(
        f'<circle cx="{(r["lon"] - min(xs)) / span * size:.1f}" cy="{(max(ys) - r["lat"]) / span * size:.1f}" r="3" fill="{html.escape(str(r[colour]), True) if colour else "#336"}">'
        f"<title>{html.escape('; '.join(f'{c}: {r[c]}' for c in popup))}</title></circle>" for r in rows)
    return (f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>'
            f'<svg viewBox="-5 -5 {size + 10} {size + 10}" width="{size}">{dots}</svg>')


def maps_by_department(points: DataFrame, folder: str | Path, popup: Sequence[str], department: str = "departamento") -> list[Path]:
    """One page per department that has points."""
    out = []
    for (name,) in bounded(choices(points, department), 1000):
        path = Path(folder) / f"mapa_{str(name).lower().replace(' ', '_')}.html"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(html_map(points.filter(F.col(department) == name), str(name), popup), encoding="utf-8")
        out.append(path)
    return out
