"""Columns over pixel and camera values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import EXIF_FIELDS, LUMA_WEIGHTS


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def brightness(r: Column, g: Column, b: Column) -> Column:
    """Weighted channel mean between 0 and 1, two decimals."""
    wr, wg, wb = LUMA_WEIGHTS
    return F.bround((wr * r + wg * g + wb * b) / 255, 2)


def aspect_ratio(width: Column, height: Column) -> Column:
    """Three decimals; null where the height is 0."""
    return F.when(height > 0, F.bround(width / height, 3))


def pixel_count(width: Column, height: Column) -> Column:
    return width.cast("long") * height.cast("long")


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    """Degrees, minutes and seconds to signed decimal degrees, six places."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.bround(F.when(hemisphere.isin("S", "W"), -value).otherwise(value), 6)


def gps_altitude(numerator: Column, denominator: Column, reference: Column) -> Column:
    """Rational altitude, negative below sea level (reference 1), two places."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.bround(F.when(reference == 1, -value).otherwise(value), 2)


def rational(numerator: Column, denominator: Column) -> Column:
    """A pair as a number; a zero denominator leaves the numerator."""
    return F.when(
        denominator != 0, F.try_divide(numerator.cast("double"), denominator.cast("double"))
    ).otherwise(numerator.cast("double"))


def exif_value(text: Column) -> Column:
    """A tag value as text: ``a/b`` pairs are divided, other text loses its NUL padding."""
    top = F.regexp_extract(text, r"^(-?\d+)/(-?\d+)$", 1)
    low = F.regexp_extract(text, r"^(-?\d+)/(-?\d+)$", 2)
    pair = rational(top.try_cast("double"), low.try_cast("double"))
    zero_pair = low.try_cast("double") == 0
    return (
        F.when(zero_pair, top)
        .when(top != "", pair.cast("string"))
        .otherwise(F.regexp_replace(text, "^\\x00+|\\x00+$", ""))
    )


def _degrees(tags: Column, name: str) -> Column:
    """A position tag ``d, m, s`` (numbers or ``a/b`` pairs) in signed decimal degrees."""
    parts = F.transform(
        F.split(F.regexp_replace(F.try_element_at(tags, F.lit(name)), r"[\[\]()\s]", ""), ","),
        lambda p: exif_value(p).try_cast("double"),
    )
    side = F.upper(F.substring(F.trim(F.try_element_at(tags, F.lit(f"{name}Ref"))), 1, 1))
    number = lambda i: F.get(parts, F.lit(i))
    return gps_decimal(number(0), number(1), number(2), side)


def exif_gps(tags: Column) -> Column:
    """``latitude, longitude, altitude`` of the position tags; null without a position."""
    height = exif_value(F.try_element_at(tags, F.lit("GPSAltitude"))).try_cast("double")
    below = F.coalesce(F.try_element_at(tags, F.lit("GPSAltitudeRef")), F.lit("0")).isin("1", "\x01")
    altitude = F.bround(F.when(below, -height).otherwise(height), 2)
    latitude, longitude = _degrees(tags, "GPSLatitude"), _degrees(tags, "GPSLongitude")
    found = F.struct(latitude.alias("latitude"), longitude.alias("longitude"), altitude.alias("altitude"))
    return F.when(latitude.isNotNull() & longitude.isNotNull(), found)


def exif_common(tags: Column) -> Column:
    """The common camera fields of a ``map<tag name, text>`` as one struct, with ``gps``."""
    values = {}
    for tag, field in EXIF_FIELDS.items():
        value = exif_value(F.try_element_at(tags, F.lit(tag)))
        if field == "f_number":
            value = F.concat(F.lit("f/"), value)
        elif field == "focal_length":
            value = F.concat(value, F.lit("mm"))
        values[field] = value
    return F.struct(*[v.alias(name) for name, v in values.items()], exif_gps(tags).alias("gps"))
