"""Text folding, title case and readable formats as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import FEET_PER_METRE, METRES_PER_MILE, col, round_half_up

# Spacing accents that count as diacritics although they do not combine.
_SPACING_MARKS = "^`¨¯´·¸"


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Accented letter -> base letter, derived from Unicode decomposition."""
    src, dst = [], []
    for cp in range(0xC0, 0x2000):
        ch = chr(cp)
        parts = unicodedata.normalize("NFD", ch)
        base = [p for p in parts if not unicodedata.combining(p)]
        if len(parts) > 1 and len(base) == 1:
            src.append(ch)
            dst.append(base[0])
    return "".join(src), "".join(dst)


def fold(c) -> Column:
    """Lower case without accents, so a name can be found with the keys at hand."""
    src, dst = _fold_table()
    plain = F.translate(col(c), src + _SPACING_MARKS, dst)
    return F.lower(F.regexp_replace(plain, "[\\u0300-\\u036f]", ""))


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def title_case(c) -> Column:
    """Capitalise every dot-separated part of every word; designations (a digit, or two dots) stay as written."""
    words = F.split(col(c), "\\s+")

    def cap(part):
        low = F.lower(part)
        first, rest = F.substring(low, 1, 1), F.substring(low, 2, sys.maxsize >> 32)
        return F.when(low.rlike("^[a-z]"), F.concat(F.upper(first), rest)).otherwise(low)

    def word(w):
        parts = F.transform(F.split(w, "\\."), cap)
        return F.when(w.rlike("\\d|\\..*\\."), w).otherwise(F.array_join(parts, "."))

    return F.array_join(F.transform(words, word), " ")


def ends_with_word(name: Column, *words: str) -> Column:
    """True when the lower-cased name is one of the words or ends in one of them as a separate word."""
    return F.concat(F.lit(" "), name).rlike(" (?:" + "|".join(w.replace(".", "\\.") for w in words) + ")$")


def starts_with_word(name: Column, *words: str) -> Column:
    return name.rlike("^(?:" + "|".join(w.replace(".", "\\.") for w in words) + ") ")


def fixed(c, places: int) -> Column:
    """Decimal text rounded by the exact binary value (``%f`` would round the shortest decimal instead)."""
    return F.translate(F.format_number(col(c), places), ",", "")


def miles_text(metres) -> Column:
    mi = col(metres) / METRES_PER_MILE
    return F.concat(F.when(mi < 10, fixed(mi, 2)).otherwise(fixed(mi, 1)), F.lit(" mi"))


def distance_text(metres) -> Column:
    """Feet below 1,000 ft, else miles."""
    m = col(metres)
    ft = m * FEET_PER_METRE
    feet = F.concat(F.format_number(round_half_up(ft), 0), F.lit(" ft"))
    return F.when(ft < 1000, feet).otherwise(miles_text(m))


def metric_text(metres) -> Column:
    m = col(metres)
    km = m / 1000.0
    return F.when(km < 1, F.concat(F.format_number(round_half_up(m), 0), F.lit(" m"))).otherwise(
        F.concat(F.when(km < 10, fixed(km, 2)).otherwise(fixed(km, 1)), F.lit(" km"))
    )


def area_text(m2) -> Column:
    acres, sqmi = col(m2) / 4046.8564224, col(m2) / 2589988.110336
    small = F.concat(F.when(acres < 10, fixed(acres, 2)).otherwise(F.format_number(round_half_up(acres), 0)), F.lit(" acres"))
    big = F.concat(F.when(sqmi < 10, fixed(sqmi, 2)).otherwise(fixed(sqmi, 1)), F.lit(" sq mi"))
    return F.when(acres < 640, small).otherwise(big)


def area_metric_text(m2) -> Column:
    km2 = col(m2) / 1e6
    small = F.concat(F.format_number(round_half_up(col(m2)), 0), F.lit(" m²"))
    return F.when(km2 < 1, small).otherwise(
        F.concat(F.when(km2 < 10, fixed(km2, 2)).otherwise(fixed(km2, 1)), F.lit(" km²"))
    )


def duration_text(seconds) -> Column:
    s = round_half_up(seconds)
    m = round_half_up(s / 60.0)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(m < 60, F.concat(m.cast("string"), F.lit(" min")))
        .otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m")))
    )


def bytes_text(n) -> Column:
    n = col(n).cast("double")
    return (
        F.when(n >= 1e9, F.concat(fixed(n / 1e9, 1), F.lit(" GB")))
        .when(n >= 1e6, F.concat(round_half_up(n / 1e6).cast("string"), F.lit(" MB")))
        .otherwise(F.concat(F.greatest(F.lit(1), round_half_up(n / 1e3)).cast("string"), F.lit(" KB")))
    )


def age_text(seconds) -> Column:
    """Age of a pack or backup in words."""
    days = F.floor(col(seconds) / 86400)
    return (
        F.when(days < 1, F.lit("today"))
        .when(days == 1, F.lit("yesterday"))
        .when(days < 60, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 730, F.concat(round_half_up(days / 30).cast("string"), F.lit(" months ago")))
        .otherwise(F.concat(fixed(days / 365, 1), F.lit(" years ago")))
    )
