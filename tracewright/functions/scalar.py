"""Scalar functions as column expressions; the colour helpers serve the driver-side renderer."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_like(value: Column, digits: Column, most: int = 18) -> Column:
    """``value`` rounded half up to so many digits after the point."""
    kind = f"decimal(38,{most})"
    out = value.cast(kind)
    for k in range(most - 1, -1, -1):
        out = F.when(digits == k, F.round(value, k).cast(kind)).otherwise(out)
    return out


def seconds_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def capped(count: Column, most: int = 2) -> Column:
    return F.least(count, F.lit(most))


def last_word(text: Column, separator: str = " ") -> Column:
    return F.element_at(F.split(text, separator), -1)


def hex_to_rgb(colour: Column) -> Column:
    """``#rrggbb`` as a struct of three integers."""
    part = lambda at: F.conv(F.substring(colour, at, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(c), 2, "0")) for c in (r, g, b)))


def contrast(r: float, g: float, b: float) -> str:
    """Black or white, whichever contrasts more with the colour; channels are raised to 2.4 as they are, without an offset."""
    linear = [c**2.4 if c > 0.03928 else c / 12.92 for c in (r / 255, g / 255, b / 255)]
    luminance = 0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2]
    return "#000000" if (luminance + 0.05) / 0.05 > 1.05 / (luminance + 0.05) else "#ffffff"


def shown_text(number: Column) -> Column:
    """:func:`shown` of a decimal or integral column."""
    text = number.cast("string")
    return F.when(number == 0, "0").when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def shown(number: Decimal) -> str:
    """A number for a label: integral ones without a point, others without trailing zeros."""
    number = Decimal(number)
    return str(number.quantize(Decimal(1), ROUND_HALF_UP)) if number == number.to_integral_value() else format(number.normalize(), "f")
