"""Sky coordinates as Column expressions.

Angles are radians: ``theta`` is the colatitude in [0, pi], ``phi`` the azimuth in [0, 2 pi).
Every function takes and returns Columns, so it can be used in select, where and groupBy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi
ARCMIN = math.pi / 180.0 / 60.0


def colatitude(dec: Column) -> Column:
    return F.radians(F.lit(90.0) - dec.cast("double"))


def azimuth(ra: Column) -> Column:
    return F.radians(ra.cast("double"))


def unit_vector(theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    return F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi), F.cos(theta)


def radius(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def vector_azimuth(x: Column, y: Column) -> Column:
    return F.pmod(F.atan2(y, x), F.lit(TWO_PI))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def unit_vector_angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(theta, phi) of a vector of length one."""
    return F.acos(clamp(z, -1.0, 1.0)), vector_azimuth(x, y)


def vector_spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(R, theta, phi) of any vector; the angles of the null vector are null."""
    r = radius(x, y, z)
    return r, F.acos(clamp(F.try_divide(z, r), -1.0, 1.0)), F.when(r > 0, vector_azimuth(x, y))


def chord2(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Squared straight-line distance."""
    dx, dy, dz = (p - q for p, q in zip(a, b))
    return dx * dx + dy * dy + dz * dz


def chord(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    dx, dy, dz = (p - q for p, q in zip(a, b))
    return F.hypot(dx, F.hypot(dy, dz))


def arc_from_chord(r: Column) -> Column:
    """Angle in radians subtended by a chord of the unit sphere."""
    return F.lit(2.0) * F.asin(F.least(r / 2.0, F.lit(1.0)))


def arc_arcmin(r: Column) -> Column:
    return F.degrees(arc_from_chord(r)) * 60.0


def tangent_residuals(theta: Column, phi: Column, theta_c: Column, phi_c: Column,
                      scale: float) -> tuple[Column, Column]:
    """Offsets of a point from a centre in the tangent plane, in units of ``scale``.

    The azimuth difference is wrapped to [-pi, pi), so cells across phi=0 are not torn apart.
    """
    dphi = F.pmod(phi - phi_c + math.pi, F.lit(TWO_PI)) - math.pi
    return F.sin((theta + theta_c) / 2.0) * dphi / scale, (theta - theta_c) / scale


def with_angles(df: DataFrame, ra: str = "ra", dec: str = "dec",
                theta: str = "theta", phi: str = "phi") -> DataFrame:
    return df.withColumns({theta: colatitude(F.col(dec)), phi: azimuth(F.col(ra))})


def with_unit_vector(df: DataFrame, theta: str = "theta", phi: str = "phi",
                     names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    return df.withColumns(dict(zip(names, unit_vector(F.col(theta), F.col(phi)))))


def redshift_slice(df: DataFrame, zmin: float, zmax: float, z: str = "z",
                   rsd: str | None = None) -> DataFrame:
    """Rows whose redshift (plus the velocity term ``rsd`` when given) lies in [zmin, zmax]."""
    value = F.col(z) if rsd is None else F.col(z) + F.col(rsd)
    return df.where(value.between(zmin, zmax))


def has_position(ra: str, dec: str) -> Column:
    """True where both angles are numbers: neither null nor NaN nor infinite."""
    def number(c: str) -> Column:
        return F.abs(F.col(c).cast("double")) < F.lit(float("inf"))
    return number(ra) & number(dec)
