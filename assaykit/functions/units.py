"""Unit normalisation as JVM-side column expressions.

All functions return ``Column`` objects built from ``lower``/``trim``/
``regexp_*`` and a literal map, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference's conversion tables.
# Base unit -> multiplier to nanomolar (14 entries; "m" is mol/L, not metre).
NANOMOLAR_MULTIPLIER = {
    "m": 1e9,
    "mol/l": 1e9,
    "mm": 1e6,
    "mmol/l": 1e6,
    "um": 1e3,
    "umol/l": 1e3,
    "nm": 1.0,
    "nmol/l": 1.0,
    "pm": 1e-3,
    "pmol/l": 1e-3,
    "fm": 1e-6,
    "nmol/ml": 1e3,
    "pmol/ml": 1.0,
    "umol/ml": 1e6,
}
# Unit -> multiplier to molar, used by the exploration path (6 entries, µm included).
MOLAR_MULTIPLIER = {
    "m": 1.0,
    "mm": 1e-3,
    "um": 1e-6,
    "µm": 1e-6,
    "nm": 1e-9,
    "pm": 1e-12,
}
# Fixed value: power-of-ten prefix forms 10^-9M, x10^-10M, 10'-9M.
EXPONENT_PATTERN = r"(?:x?10\^|10')([+-]?\d+)"
MICRO_SIGNS = "µμ"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literal_map(table: dict[str, float]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in table.items()))


# Whitespace removed from units: the characters of the regex class \s (space, tab, LF, VT, FF, CR).
UNIT_WHITESPACE = " \t\n\x0b\x0c\r"


def normalize_unit(unit: str | Column) -> Column:
    """trim, lower-case, both micro signs and the word 'micro' to 'u', drop all whitespace.

    Literal character work uses ``translate``/``replace`` rather than regexes.
    """
    u = F.lower(F.trim(_col(unit)))
    u = F.translate(u, MICRO_SIGNS, "u" * len(MICRO_SIGNS))
    u = F.replace(u, F.lit("micro"), F.lit("u"))
    return F.translate(u, UNIT_WHITESPACE, "")


def unit_exponent(norm_unit: str | Column) -> Column:
    """Integer power of ten written in the unit, 0 when there is none, NULL when it is beyond any int."""
    e = F.regexp_extract(_col(norm_unit), EXPONENT_PATTERN, 1)
    return F.when(e != "", e.try_cast("int")).otherwise(F.lit(0))


def unit_base(norm_unit: str | Column) -> Column:
    """The unit with its power-of-ten prefix removed."""
    return F.regexp_replace(_col(norm_unit), EXPONENT_PATTERN, "")


def unit_multiplier(base_unit: str | Column) -> Column:
    """Multiplier to nM for a base unit; NULL for unknown units."""
    return F.try_element_at(_literal_map(NANOMOLAR_MULTIPLIER), _col(base_unit))


def nanomolar_factor(unit: str | Column) -> Column:
    """Full factor raw value -> nM: base multiplier times 10^exponent."""
    n = normalize_unit(unit)
    return unit_multiplier(unit_base(n)) * F.pow(F.lit(10.0), unit_exponent(n))


def to_molar(value: str | Column, unit: str | Column) -> Column:
    """Value in molar for the 6 plain units (trimmed, lower-cased); NULL otherwise."""
    u = F.lower(F.trim(_col(unit)))
    return _col(value).cast("double") * F.try_element_at(_literal_map(MOLAR_MULTIPLIER), u)


def neg_log10(x: str | Column) -> Column:
    """-log10(x) (P10); callers keep x > 0 so both engines agree."""
    return -F.log10(_col(x))
