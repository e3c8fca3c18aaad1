"""Column functions. All are Catalyst expressions; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from placewise.constants import METERS_PER_DEGREE, POLE_EPSILON

# Java reads "1d", "2.5F" and "0x1p3" as numbers; a plain number parser does not.
_JAVA_ONLY_NUMBER = r"(?i)([0-9.][df]\s*$|^\s*[+-]?0x)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_double(c) -> Column:
    """Text to double; anything unreadable, and NaN, becomes null."""
    text = _col(c).cast("string")
    number = text.try_cast("double")
    return F.when(~text.rlike(_JAVA_ONLY_NUMBER) & ~F.isnan(number), number)


def lenient_int(c) -> Column:
    """Text to double to bigint, cut toward zero; unreadable, NaN and infinite become null."""
    return lenient_double(c).try_cast("bigint")


def first_tagged(components, tag: str, tag_field: str = "types", value_field: str = "long_name") -> Column:
    """``value_field`` of the first array element whose ``tag_field`` array contains ``tag``."""
    hits = F.filter(_col(components), lambda x: F.array_contains(x[tag_field], tag))
    return F.get(hits, F.lit(0))[value_field]


def prettify(c) -> Column:
    return F.translate(_col(c), "_", " ")


def before_comma(c) -> Column:
    return F.substring_index(_col(c), ",", 1)


def zip5(c) -> Column:
    """First five digits of a postal code; null when it does not start with five."""
    return F.nullif(F.regexp_extract(_col(c), r"^(\d{5})", 1), F.lit(""))


def null_sentinel(c) -> Column:
    """Census columns mark "no value" with a negative number."""
    col = _col(c)
    return F.when(col > 0, col)


def null_sentinels(df, cols):
    return df.withColumns({c: null_sentinel(c) for c in cols})


def log_of(c) -> Column:
    return F.log(_col(c).cast("double"))


def log1p_of(c) -> Column:
    return F.log1p(_col(c).cast("double"))


def round_to(c, digits: int = 3) -> Column:
    return F.round(_col(c), digits)


def per_thousand(count, population, digits: int | None = 3) -> Column:
    """``count / population * 1000``; null for a population of zero or null."""
    value = _col(count).cast("double") / F.nullif(_col(population), F.lit(0)) * F.lit(1000.0)
    return value if digits is None else F.round(value, digits)


def fill(c, value, dtype: str | None = None) -> Column:
    out = F.coalesce(_col(c), F.lit(value))
    return out.cast(dtype) if dtype else out


def display_number(c, digits: int = 0) -> Column:
    """Whole numbers are cut, not rounded, and grouped by thousands; otherwise fixed decimals."""
    if digits == 0:
        return F.format_number(_col(c).cast("bigint"), 0)
    return F.format_string(f"%.{digits}f", _col(c).cast("double"))


def to_json_text(c) -> Column:
    return F.to_json(_col(c))


def first_non_empty(*cols) -> Column:
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols])


def utc_now_seconds() -> Column:
    return F.date_trunc("second", F.current_timestamp())


def meters_to_lat(meters) -> Column:
    return _col(meters) / F.lit(METERS_PER_DEGREE)


def meters_to_lng(meters, lat) -> Column:
    return _col(meters) / (F.lit(METERS_PER_DEGREE) * F.cos(F.radians(_col(lat))) + F.lit(POLE_EPSILON))
