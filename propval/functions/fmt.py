"""Text formatting that matches Python's float formatting.

``format_number`` goes through java.text.DecimalFormat, which rounds the exact
binary value half-even: the same digits as Python's ``f"{x:.nf}"``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from propval.functions.regex import col_of


def fixed(c, digits: int, grouping: bool = False) -> Column:
    """Python ``f"{x:.{digits}f}"`` (``f"{x:,.{digits}f}"`` with grouping)."""
    s = F.format_number(col_of(c), digits)
    return s if grouping else F.regexp_replace(s, ",", "")


def price_egp(c) -> Column:
    """6.25M / 850K / 1,234 style price text."""
    x = col_of(c)
    millions = F.regexp_replace(F.regexp_replace(fixed(x / 1_000_000, 2), "0+$", ""), r"\.$", "")
    return (F.when(x >= 1_000_000, F.concat(millions, F.lit("M")))
            .when(x >= 1_000, F.concat(fixed(x / 1_000, 0), F.lit("K")))
            .otherwise(fixed(x, 0, grouping=True)))
