"""Viewing geometry and the volumetric and geometric scattering kernels, as columns.

Every function takes and returns Columns and stays inside code generation. Angles are in
radians unless a name ends in _deg.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the kernels: (height/breadth, breadth/radius) of the crowns, and the hot-spot width.
SPARSE_SHAPE = (2.0, 1.0)
DENSE_SHAPE = (2.0, 2.5)
HOT_SPOT = 0.25
TINY = 1e-20


def decode(c: Column, scale: float = 0.01) -> Column:
    """Angles stored as hundredths of degrees."""
    return c * scale


def wrap180(c: Column) -> Column:
    """Degrees in (-180, 180]."""
    x = F.pmod(c, F.lit(360.0))
    return F.when(x > 180, x - 360).otherwise(x)


def relative_azimuth_deg(vaa: Column, saa: Column) -> Column:
    return wrap180(vaa - saa)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def fold(vza: Column, sza: Column, raa: Column) -> tuple[Column, Column, Column]:
    """Negative zeniths become positive ones on the other side."""
    turn = F.when(vza < 0, math.pi).otherwise(0.0) + F.when(sza < 0, math.pi).otherwise(0.0)
    return F.abs(vza), F.abs(sza), raa + turn


def cos_phase(vza: Column, sza: Column, raa: Column) -> Column:
    return clamp(F.cos(vza) * F.cos(sza) + F.sin(vza) * F.sin(sza) * F.cos(raa), -1.0, 1.0)


def phase_angle(vza: Column, sza: Column, raa: Column) -> Column:
    return F.acos(cos_phase(vza, sza, raa))


def ross(vza: Column, sza: Column, raa: Column, thin: bool = False, hot_spot: Column | float | None = None) -> Column:
    """Volumetric kernel of a thick or thin canopy, with an optional hot-spot factor of the given width; True means 0.25, a width of 0 none."""
    c = cos_phase(vza, sza, raa)
    x = F.acos(c)
    body = (math.pi / 2 - x) * c + F.sin(x)
    k = body / (F.cos(vza) * F.cos(sza)) if thin else body / (F.cos(vza) + F.cos(sza))
    if hot_spot is None:
        return k
    width = F.lit(HOT_SPOT) if hot_spot is True else (F.lit(hot_spot) if isinstance(hot_spot, float) else hot_spot)
    return F.when(width > 0, k * (1 + 1 / (1 + F.try_divide(x, width)))).otherwise(k)


@dataclass(frozen=True)
class _Crowns:
    c1: Column
    c2: Column
    cos_phase: Column
    secants: Column
    overlap: Column


def _crowns(vza: Column, sza: Column, raa: Column, shape: tuple[float, float]) -> _Crowns:
    """Geometry of shadows of spheroids, after stretching the zeniths by breadth/radius."""
    hb, br = shape
    phi = F.abs(F.pmod(raa, F.lit(2 * math.pi)))
    v, s = F.atan(F.greatest(br * F.tan(vza), F.lit(0.0))), F.atan(F.greatest(br * F.tan(sza), F.lit(0.0)))
    t1, t2 = F.greatest(br * F.tan(vza), F.lit(0.0)), F.greatest(br * F.tan(sza), F.lit(0.0))
    c1 = F.when(F.cos(v) == 0, TINY).otherwise(F.cos(v))
    c2 = F.when(F.cos(s) == 0, TINY).otherwise(F.cos(s))
    phase = clamp(c1 * c2 + F.sin(v) * F.sin(s) * F.cos(phi), -1.0, 1.0)
    apart2 = F.greatest(t1 * t1 + t2 * t2 - 2 * t1 * t2 * F.cos(phi), F.lit(0.0))
    secants = 1 / c1 + 1 / c2
    cost = clamp(hb * F.sqrt(apart2 + t1 * t1 * t2 * t2 * F.sin(phi) * F.sin(phi)) / secants, -1.0, 1.0)
    t = F.acos(cost)
    overlap = F.greatest((t - F.sin(t) * cost) * secants / math.pi, F.lit(0.0))
    return _Crowns(c1, c2, phase, secants, overlap)


def li_sparse(vza: Column, sza: Column, raa: Column, reciprocal: bool = True, shape: tuple[float, float] = SPARSE_SHAPE) -> Column:
    g = _crowns(vza, sza, raa, shape)
    lit = 0.5 * (1 + g.cos_phase) / g.c1
    return g.overlap - g.secants + (lit / g.c2 if reciprocal else lit)


def li_dense(vza: Column, sza: Column, raa: Column, reciprocal: bool = True, shape: tuple[float, float] = DENSE_SHAPE) -> Column:
    g = _crowns(vza, sza, raa, shape)
    return (1 + g.cos_phase) / ((g.c1 * g.c2 if reciprocal else g.c1) * (g.secants - g.overlap)) - 2


def li_transit(vza: Column, sza: Column, raa: Column, reciprocal: bool = True, shape: tuple[float, float] = SPARSE_SHAPE) -> Column:
    """The sparse form while the visible crown area is at most 2, the dense form above."""
    g = _crowns(vza, sza, raa, shape)
    return F.when(g.secants - g.overlap <= 2, li_sparse(vza, sza, raa, reciprocal, shape)).otherwise(li_dense(vza, sza, raa, reciprocal, shape))


def roujean(vza: Column, sza: Column, raa: Column) -> Column:
    phi = F.abs(F.pmod(raa, F.lit(2 * math.pi)))
    t1, t2 = F.tan(sza), F.tan(vza)
    apart = F.sqrt(F.greatest(t1 * t1 + t2 * t2 - 2 * t1 * t2 * F.cos(phi), F.lit(0.0)))
    return ((math.pi - phi) * F.cos(phi) + F.sin(phi)) * t1 * t2 * (0.5 / math.pi) - (t1 + t2 + apart) / math.pi


def normalised(kernel, vza: Column, sza: Column, raa: Column, nbar_deg: float = 0.0, **options) -> Column:
    """The kernel less its value at nadir view under sun zenith nbar_deg (a constant that Catalyst folds)."""
    at = kernel(F.lit(0.0), F.lit(math.radians(nbar_deg)), F.lit(0.0), **options)
    return kernel(vza, sza, raa, **options) - at


def kernel_pair(vza_deg: Column, sza_deg: Column, raa_deg: Column, hot_spot=None, nbar_deg: float = 0.0, li=li_sparse, **options) -> tuple[Column, Column]:
    """Normalised (volumetric, geometric) kernels from folded degrees."""
    v, s, r = fold(F.radians(vza_deg), F.radians(sza_deg), F.radians(raa_deg))
    return normalised(ross, v, s, r, nbar_deg, hot_spot=hot_spot), normalised(li, v, s, r, nbar_deg, **options)
