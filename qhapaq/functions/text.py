"""Cleaning of codes, states, names and numbers that arrive as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from qhapaq.config import SETTINGS, Settings

#: Texts that mean "no category", and characters of known encoding damage.
NO_CATEGORY = ("", "0", "NAN", "NONE", "S/C", "SINCATEGORIA", "SINCATEGORÍA")
WRONG, RIGHT = "ÿŸ", "ñÑ"
TWICE_ENCODED = "[ÃÂ�]"
BLANK = r"(?U)[\s\x1c-\x1f]"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def normal_category(raw: Column) -> Column:
    """' ii 1 ' -> 'II-1'; null for empty, placeholder or unknown forms."""
    squeezed = F.upper(F.regexp_replace(raw.cast("string"), BLANK, ""))
    form = r"^(I{1,3})-?([1-4E])$"
    level, kind = F.regexp_extract(squeezed, form, 1), F.regexp_extract(squeezed, form, 2)
    return F.when(~squeezed.isin(*NO_CATEGORY) & (level != ""), F.concat_ws("-", level, kind))


def category_group(category: Column, settings: Settings = SETTINGS) -> Column:
    return (F.when(category.isin(*settings.resolutive), "resolutiva")
            .when(category.isin(*settings.inconclusive), "no_concluyente").otherwise("desconocida"))


def normal_state(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw.cast("string"), f"^{BLANK}+|{BLANK}+$", ""))


def repaired(raw: Column) -> Column:
    """struct(value, changed): known wrong letters replaced, then texts that were encoded twice decoded once.

    A text that cannot be decoded stays as it is; null stays null and unchanged.
    """
    letters = F.translate(raw, WRONG, RIGHT)
    one_byte = letters.rlike(TWICE_ENCODED) & letters.rlike(r"^[\x00-\xFF]*$")
    again = F.when(one_byte, F.encode(letters, "ISO-8859-1").cast("string"))
    decodes = F.coalesce(F.is_valid_utf8(again), F.lit(False))
    return F.struct(F.when(decodes, again).otherwise(letters).alias("value"),
                    F.coalesce(decodes | (letters != raw), F.lit(False)).alias("changed"))


def number(raw: Column) -> Column:
    """The number a text holds, else null. Suffixes such as 1d, words such as nan, and blanks inside give null."""
    plain = F.trim(raw.cast("string"))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def padded(code: Column, width: int = 6) -> Column:
    """Zero-padded on the left; longer codes stay whole."""
    text = code.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def institution_group(name: Column) -> Column:
    """The first class whose words the name holds."""
    up = F.upper(F.coalesce(name, F.lit("")))
    return (F.when(up.rlike("MINSA|GOBIERNO REGIONAL|REGIÓN|GOB.REG"), "MINSA / Gob. Regional")
            .when(up.rlike("ESSALUD|SEGURO SOCIAL"), "EsSalud").when(up.rlike("PRIVAD"), "Privado")
            .when(up.rlike("SANIDAD|FUERZAS ARMADAS|PNP|POLIC"), "Sanidad FF. AA. / PNP").otherwise("Otro"))


def shortened(text: Column, most: int = 52) -> Column:
    """Cut at the last word boundary that fits, with dots."""
    cut = F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def column_named(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The column whose letters and digits, in any case, equal the first candidate that occurs; of equals the last."""
    key = lambda s: "".join(c for c in str(s).upper() if c.isascii() and c.isalnum())
    known = {key(c): c for c in columns}
    return next((known[key(c)] for c in candidates if key(c) in known), None)
