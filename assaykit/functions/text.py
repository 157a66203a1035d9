"""Text key cleaning and fixed formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters Python's str.strip() removes (str.isspace() is true),
# listed in code-point order: ASCII whitespace, the information separators,
# NEL, no-break space and the Unicode space separators.
STRIP_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")


def strip_text(x: str | Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace of any kind (linear btrim)."""
    return F.btrim(_col(x), F.lit(STRIP_CHARS))


def clean_text_key(x: str | Column) -> Column:
    """Stripped text, or NULL when nothing is left."""
    s = strip_text(x)
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def fixed(x: str | Column, places: int, default: str = "None") -> Column:
    """Number with a fixed count of decimals, ``default`` for NULL.

    The binary value is rounded, half to even, as Python's ``:.2f`` does: 0.125
    is 0.12 and 1.005 (a little less than that in binary) is 1.00.
    ``format_string`` would round the printed decimal half up instead.
    """
    c = _col(x).cast("double")
    plain = F.replace(F.format_number(c, places), F.lit(","), F.lit(""))
    return (F.when(c.isNull(), F.lit(default)).when(F.isnan(c), F.lit("nan"))
            .when(c == float("inf"), F.lit("inf")).when(c == float("-inf"), F.lit("-inf")).otherwise(plain))


def yes_no(flag: str | Column) -> Column:
    return F.when(_col(flag), F.lit("yes")).otherwise(F.lit("no"))


def or_default(x: str | Column, default: str) -> Column:
    """Python's ``x or default`` for a string: NULL and '' both fall back."""
    c = _col(x)
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)
