"""Scalar measures of a daily fund row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

YEAR_DAYS = 365
# Scaled values below _EXACT_BELOW are off by less than 2**-12, so that one further than _TIE from a half is rounded right.
_EXACT_BELOW, _TIE = 2.0**40, 0.001


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def composite_key(*parts: Column | str) -> Column:
    """Paste parts with ``_``; a missing part shows as the text ``NA``."""
    return F.concat_ws("_", *[F.coalesce(col(p).cast("string"), F.lit("NA")) for p in parts])


def joined_text(*parts: Column | str, sep: str = "") -> Column:
    """Paste parts; NULL as soon as one part is NULL."""
    pieces: list[Column] = []
    for i, p in enumerate(parts):
        if i and sep:
            pieces.append(F.lit(sep))
        pieces.append(col(p).cast("string"))
    return F.concat(*pieces)


def net_flow(paid_in: Column | str, paid_out: Column | str, cancelled: Column | str) -> Column:
    return col(paid_in) - col(paid_out) + col(cancelled)


def _guarded_ratio(num: Column, den: Column, neutral: float, shift: float) -> Column:
    # NULL operands stay NULL; only a zero denominator takes the neutral value.
    return F.when(den == 0, F.lit(neutral)).otherwise(num / den - F.lit(shift) if shift else num / den)


def growth_factor(pre_close: Column | str, income: Column | str) -> Column:
    """Value before flows over the same value without the day's income; 1 on a zero base."""
    pre, inc = col(pre_close), col(income)
    return _guarded_ratio(pre, pre - inc, 1.0, 0.0)


def growth_return(pre_close: Column | str, income: Column | str) -> Column:
    """Daily return, i.e. growth factor minus one; 0 on a zero base."""
    pre, inc = col(pre_close), col(income)
    return _guarded_ratio(pre, pre - inc, 0.0, 1.0)


def one_decimal(c: Column | str) -> Column:
    return F.round(col(c), 1)


def round_double(x: Column, digits: int) -> Column:
    """``round(x, digits)`` of a double, to the last bit.

    Spark rounds a double through its decimal text, which costs more than the metric before it. Away from halves
    the nearest whole number of the scaled value is the same, and its quotient by a power of ten as well;
    halves, very large and non-finite values are left to ``round``.
    """
    scaled = x * F.lit(10.0**digits)
    whole = F.floor(scaled + F.lit(0.5)).cast("double")
    plain = (F.abs(scaled) < F.lit(_EXACT_BELOW)) & (F.abs(scaled - whole) < F.lit(0.5 - _TIE))
    return F.when(plain, whole / F.lit(10.0**digits)).otherwise(F.round(x, digits))


def with_rounded(df: DataFrame, names: Sequence[str], digits: int) -> DataFrame:
    """Columns rounded in place, doubles without decimals."""
    double = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns({n: round_double(F.col(n), digits) if n in double else F.round(F.col(n), digits) for n in names})


def annual_percent_to_daily(percent: Column | str) -> Column:
    return F.pow(1 + col(percent) / 100, F.lit(1.0 / YEAR_DAYS))


def clean_number(text: Column | str) -> Column:
    """Digits and dots of a formatted number (a minus sign is dropped as well)."""
    return F.regexp_replace(col(text), r"[^0-9\.]", "").try_cast("double")


def category_code(label: Column | str, codes: Mapping[str, int]) -> Column:
    """Code of a label, NULL when the label is not listed."""
    out: Column | None = None
    for name, code in codes.items():
        hit = col(label) == name
        out = F.when(hit, F.lit(code)) if out is None else out.when(hit, F.lit(code))
    return out if out is not None else F.lit(None).cast("int")


def moved(flow: Column | str) -> Column:
    """Whether the day had a net movement."""
    return col(flow) != 0
