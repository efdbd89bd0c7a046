"""TEOS-10 pressure and depth, closed-form, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The published polynomials of specific volume and dynamic height at standard
#: salinity and temperature, in powers of pressure / 10^4 dbar, lowest power first.
HEIGHT = (9.726613854843870e-4, -2.252956605630465e-5, 2.376909655387404e-6, -1.664294869986011e-7, -5.988108894465758e-9, -2.1078768810e-9, 2.8019291329e-10)
VOLUME = (9.726613854843870e-4, -4.505913211160929e-5, 7.130728965927127e-6, -6.657179479768312e-7, -2.994054447232880e-8, -1.2647261286e-8, 1.9613503930e-9)
GAMMA = 2.26e-7


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = F.lit(c) + x * out
    return out


def _gravity(latitude: Column) -> tuple[Column, Column]:
    s2 = F.pow(F.sin(F.radians(latitude.cast("double"))), F.lit(2.0))
    return s2, F.lit(9.780327) * (F.lit(1.0) + (F.lit(5.2792e-3) + F.lit(2.32e-5) * s2) * s2)


def _height(p: Column) -> Column:
    x = p * 1e-4
    return F.lit(1e8) * x * _poly(x, HEIGHT)


def z_from_p(pressure: Column, latitude: Column) -> Column:
    """Height in m (negative below the surface) at a pressure in dbar."""
    _, g = _gravity(latitude)
    h = _height(pressure.cast("double"))
    return -2.0 * h / (g + F.sqrt(g * g + 2.0 * GAMMA * g * h))


def with_pressure(df: DataFrame, z: Column, latitude: Column, name: str) -> DataFrame:
    """Adds the pressure in dbar at a height in m; NaN above the surface by more than 5 m.

    The steps are columns of their own, so that each is computed once.
    """
    volume = lambda p: _poly(F.col(p) * 1e-4, VOLUME)
    s2, g = _gravity(F.col("__lat10"))
    out = df.withColumn("__z10", z.cast("double")).withColumn("__lat10", latitude.cast("double")).withColumn("__g10", g).withColumn("__c10", 5.25e-3 * s2 + 5.92e-3)
    zz, c = F.col("__z10"), F.col("__c10")
    out = out.withColumn("__p10", F.when(zz <= 5, -2.0 * zz / ((1 - c) + F.sqrt((1 - c) * (1 - c) + 8.84e-6 * zz))))
    out = out.withColumn("__off10", _height(F.col("__p10")) + F.col("__g10") * (zz - 0.5 * GAMMA * zz * zz))
    out = out.withColumn("__mid10", F.col("__p10") - 0.5 * F.col("__off10") / (volume("__p10") * 1e4))
    best = F.col("__p10") - F.col("__off10") / (volume("__mid10") * 1e4)
    return out.withColumn(name, F.coalesce(best, F.lit(float("nan")))).drop("__z10", "__lat10", "__g10", "__c10", "__p10", "__off10", "__mid10")
