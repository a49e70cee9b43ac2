"""Unit conversions and point-wise hydrology expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, eleven soil texture classes (Clapp and Hornberger 1978).
SOIL_KSAT_CM_PER_HOUR = [63.36, 56.16, 12.49, 2.59, 2.5, 2.27, 0.612, 0.882, 0.781, 0.371, 0.461]
SOIL_POROSITY = [0.395, 0.41, 0.435, 0.485, 0.451, 0.42, 0.477, 0.476, 0.426, 0.492, 0.482]
SOIL_AIR_ENTRY = [121.0, 90.0, 218.0, 786.0, 478.0, 299.0, 356.0, 630.0, 153.0, 490.0, 405.0]
SOIL_EXPONENT = [4.05, 4.38, 4.9, 5.3, 5.39, 7.12, 7.75, 8.52, 10.4, 10.4, 11.4]

INDEX_LIMIT = 3.09
SMDI_LIMIT = 4.0


def kelvin_to_celsius(t: Column) -> Column:
    return t - F.lit(273.15)


def per_hour_to_per_day(rate: Column) -> Column:
    return rate * F.lit(24.0)


def watts_to_megajoules(flux: Column) -> Column:
    """W/m2 to MJ/m2/day."""
    return flux * F.lit(0.0864)


def volumetric(depth_mm: Column, layer_m: Column) -> Column:
    """Millimetres of water in a layer to a volume fraction."""
    return depth_mm / F.nullif(F.lit(1000.0) * layer_m, F.lit(0.0))


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def clip(x: Column, low: float, high: float) -> Column:
    """Bound to [low, high]; unlike bare least/greatest it keeps NULL as NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def clip_index(x: Column) -> Column:
    return clip(x, -INDEX_LIMIT, INDEX_LIMIT)


def soil_class(ksat_mm_per_day: Column) -> Column:
    """Struct of the texture class whose conductivity is closest; the first wins a tie.

    The eleven classes are a literal array, so no join is needed.
    """
    rows = zip(SOIL_KSAT_CM_PER_HOUR, SOIL_POROSITY, SOIL_AIR_ENTRY, SOIL_EXPONENT)
    options = F.array(
        *[
            F.struct(
                F.abs(F.lit(ksat * 240.0) - ksat_mm_per_day).alias("gap"),
                F.lit(i).alias("class_id"),
                F.lit(n).alias("porosity"),
                F.lit(psi).alias("air_entry"),
                F.lit(b).alias("exponent"),
            )
            for i, (ksat, n, psi, b) in enumerate(rows)
        ]
    )
    return F.array_min(options)


def suction_head(theta_mm: Column, depth_mm: Column, soil: Column) -> Column:
    """Natural log of soil suction for a moisture depth in a column of ``depth_mm``."""
    ratio = theta_mm / F.nullif(depth_mm, F.lit(0.0)) / soil["porosity"]
    safe = F.when(ratio > 0, ratio)
    return F.log(soil["air_entry"] * F.pow(safe, -soil["exponent"]))


def soil_line_fields(line: Column, layers: int = 3) -> Column:
    """Mean conductivity and total depth (mm) read by position from a soil parameter line."""
    tokens = F.transform(F.split(F.trim(line), r"\s+"), lambda t: t.try_cast("double"))
    ksat = F.slice(tokens, 10 + layers, 2)
    thickness = F.slice(tokens, 4 * layers + 11, 2)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    return F.struct(
        (total(ksat) / F.lit(2.0)).alias("ksat"),
        (total(thickness) * F.lit(1000.0)).alias("depth_mm"),
    )
