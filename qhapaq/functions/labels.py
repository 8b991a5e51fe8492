"""Classes that times, places and heights fall into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_ROUTE = "sin_ruta"
#: Altitude strips by lower bound, and texts that mark a capital.
STRIPS = ((0, "costa <500"), (500, "yungas 500-1500"), (1500, "sierra 1500-3500"), (3500, "puna >3500"))
TOP_OF_STRIPS = 9000
CAPITAL = ("1", "1.0", "True", "SI", "Sí")


def band_names(bands: Sequence[int]) -> list[str]:
    """In order, the class without a route last."""
    return [f"{a}-{b}" for a, b in zip((0, *bands), bands)] + [f">{bands[-1]}", NO_ROUTE]


def band(minutes: Column, bands: Sequence[int]) -> Column:
    """Half-open from below; null is without a route."""
    names = band_names(bands)
    out = F.when(minutes.isNull() | F.isnan(minutes), NO_ROUTE)
    for limit, name in zip(bands, names):
        out = out.when(minutes < limit, name)
    return out.otherwise(names[-2])


def strip(metres: Column) -> Column:
    """Altitude strip; null outside 0 to 9000."""
    out = F.when(metres.isNull() | (metres < STRIPS[0][0]) | (metres >= TOP_OF_STRIPS), None)
    for (_, name), (top, _) in zip(STRIPS, STRIPS[1:]):
        out = out.when(metres < top, name)
    return out.otherwise(STRIPS[-1][1])


def settlement(people: Column, capital: Column | None, threshold: int) -> Column:
    urban = F.coalesce(people, F.lit(0.0)) >= threshold
    if capital is not None:
        urban = urban | F.coalesce(capital.cast("string").isin(*CAPITAL), F.lit(False))
    return F.when(urban, "urbano").otherwise("rural")
