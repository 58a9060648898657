"""Column expressions shared by operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper edges of the latitude bands, in degrees.
ZONES = ((23.5, "Tropical"), (35.0, "Subtropical"), (55.0, "Temperate"), (None, "Polar"))
FINE_ZONES = (
    (23.5, "Tropical"),
    (35.0, "Subtropical"),
    (55.0, "Temperate"),
    (66.5, "Boreal"),
    (90.1, "Polar"),
)
UNKNOWN = "Unknown"

# The six US air-quality categories, best to worst.
AIR_QUALITY_LABELS = (
    "Good",
    "Moderate",
    "Unhealthy (Sensitive)",
    "Unhealthy",
    "Very Unhealthy",
    "Hazardous",
)


def band(value: Column, edges: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the first edge that ``value`` does not exceed; null becomes Unknown."""
    out = F.when(value.isNull() | F.isnan(value), F.lit(UNKNOWN))
    for edge, label in edges:
        out = out.when(F.lit(True) if edge is None else value <= edge, F.lit(label))
    return out.otherwise(F.lit(UNKNOWN))


def climate_zone(latitude: Column) -> Column:
    return band(F.abs(latitude), ZONES)


def latitude_band(latitude: Column) -> Column:
    """Five-band variant used where no zone column is available."""
    return band(F.abs(latitude), FINE_ZONES)


def hemisphere(latitude: Column) -> Column:
    return (
        F.when(latitude.isNull(), F.lit(UNKNOWN)).when(latitude < 0, F.lit("S")).otherwise(F.lit("N"))
    )


def hemisphere_zone(latitude: Column) -> Column:
    """Zone qualified by hemisphere, such as ``Temperate-S``."""
    return F.when(latitude.isNull(), F.lit(UNKNOWN)).otherwise(
        F.concat_ws("-", climate_zone(latitude), hemisphere(latitude))
    )


def season(month: Column, latitude: Column) -> Column:
    """Meteorological season; the southern half of the year is shifted by six months."""
    local = F.when(latitude < 0, (month + 5) % 12 + 1).otherwise(month)
    name = (
        F.when(local.isin(12, 1, 2), F.lit("Winter"))
        .when(local.isin(3, 4, 5), F.lit("Spring"))
        .when(local.isin(6, 7, 8), F.lit("Summer"))
        .otherwise(F.lit("Autumn"))
    )
    return F.when(latitude.isNull(), F.lit(UNKNOWN)).otherwise(name)


def sine(value: Column, period: float) -> Column:
    return F.sin(F.lit(2.0 * math.pi) * value.cast("double") / F.lit(float(period)))


def cosine(value: Column, period: float) -> Column:
    return F.cos(F.lit(2.0 * math.pi) * value.cast("double") / F.lit(float(period)))


def air_quality_label(index: Column) -> Column:
    labels = F.array(*[F.lit(x) for x in AIR_QUALITY_LABELS])
    return F.when(index.between(1, 6), F.get(labels, index.cast("int") - 1))


def rounded(value: Column, digits: int) -> Column:
    """To the nearest multiple of ``10 ** -digits``, halves away from zero, computed in doubles.

    ``round`` goes through decimal text, which costs about as much as all else in a row. From a
    thousand million on, where the scaled value has no digits to spare, it is still used.
    """
    scale = F.lit(float(10**digits))
    scaled = value * scale
    nearest = F.rint(scaled)
    half = F.abs(scaled - nearest) == 0.5
    whole = F.when(half, scaled + F.signum(scaled) * 0.5).otherwise(nearest)
    return F.when(F.abs(value) < 1e9, whole / scale).otherwise(F.round(value, digits))


def bucket(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the maximum belongs to the last bin."""
    raw = F.floor((value - low) / (high - low) * bins).cast("int")
    return F.when(high == low, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1)))
