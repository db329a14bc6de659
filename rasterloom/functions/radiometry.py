"""Calibration, indices, quality bits, inversion to surface reflectance and output scaling, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quality weight base, fill flags, reflectance scale and stretch of the products.
QA_BASE = 0.618034
QA_FILL = 255
SCALE = 10000
NODATA = -9999
STRETCH = 2.5
#: Cubic envelopes of (top - bottom) of atmosphere reflectance, blue to swir2, highest power first (fixed values).
ENVELOPE_LOW = (
    (0.81793009, -1.55666629, 0.03879234, 0.02664923), (0.50218134, -0.94398654, -0.36284911, 0.02876391),
    (0.61609484, -1.12717424, -0.24037129, 0.0239488), (0.67499803, -1.1988073, -0.18331019, 0.02179141),
    (0.23458873, -0.4048219, -0.56692888, 0.02484466), (0.08220874, -0.13492051, -0.74972003, -0.0331204),
)
ENVELOPE_HIGH = (
    (-0.76916621, 1.8524333, -1.43464388, 0.34984857), (-0.91464915, 1.96174322, -1.38302832, 0.28090987),
    (-0.9199249, 1.9681306, -1.3704881, 0.28924671), (-0.87389258, 1.89261443, -1.30929285, 0.28807412),
    (-0.71647392, 1.34657557, -0.79536697, 0.13551599), (-0.34076349, 0.60544841, -0.34178543, 0.09669959),
)


def present(dn: Column) -> Column:
    """Digital numbers with 0 (no data) and NaN as null."""
    return F.when((dn != 0) & ~F.isnan(dn.cast("double")), dn)


def calibrate(dn: Column, scale: Column, off: Column) -> Column:
    return dn * scale + off


def sun_calibrate(dn: Column, scale: Column, off: Column, sza_deg: Column) -> Column:
    """Scale and offset both divided by the cosine of the sun zenith of the pixel."""
    return (dn * scale + off) / F.cos(F.radians(sza_deg))


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is 0."""
    return F.try_divide(a - b, a + b)


def ndvi(nir: Column, red: Column) -> Column:
    return normalised_difference(nir, red)


def ndsi(green: Column, swir1: Column) -> Column:
    return normalised_difference(green, swir1)


def qa_weight(qa: Column) -> Column:
    return F.when(qa == QA_FILL, 0.0).otherwise(F.pow(F.lit(QA_BASE), qa))


def any_bit(bits: Column, which=(0, 1, 2, 4, 7)) -> Column:
    """True if any of the bits is set. Bit 0 is fill; 1, 2, 4 and 7 mark dilated cloud, cirrus, shadow's pair and water."""
    out = F.lit(False)
    for k in which:
        out = out | (F.getbit(bits, F.lit(k)) == 1)
    return out


def clear_collection1(qa: Column, low: int = 2720, high: int = 2732) -> Column:
    return qa.between(low, high)


def weight_uncertainty(w: Column, base: float = 0.015, floor: float = 1e-4) -> Column:
    return base / F.greatest(w, F.lit(floor))


def kernel_reflectance(f_iso: Column, f_vol: Column, f_geo: Column, vol: Column, geo: Column, scale: float = 0.001) -> Column:
    return scale * (f_iso + f_vol * vol + f_geo * geo)


def surface_reflectance(toa: Column, a: Column, b: Column, c: Column, dn: Column | None = None) -> Column:
    """y = a toa - b; y / (1 + c y); null where the digital number is not positive."""
    y = a * toa - b
    out = y / (1 + c * y)
    return out if dn is None else F.when(dn > 0, out)


def surface_gradient(toa: Column, a: Column, b: Column, c: Column, da: Column, db: Column, dc: Column) -> Column:
    """Derivative of the surface reflectance along one parameter, from those of a, b and c."""
    y = a * toa - b
    return (toa * da - db - y * y * dc) / F.pow(1 + c * y, F.lit(2.0))


def toa_gradient(toa: Column, a: Column, b: Column, c: Column) -> Column:
    return a / F.pow(c * (a * toa - b) + 1, F.lit(2.0))


def reflectance_uncertainty(gradients: list[Column], uncertainties: list[Column], d_toa: Column, toa: Column, toa_share: float = 0.05, ozone_weight: float = 0.0) -> Column:
    """Root of the summed squares; the third (ozone) term has a weight, 0 by default."""
    weights = [1.0, 1.0, ozone_weight]
    total = F.pow(d_toa * toa_share * toa, F.lit(2.0))
    for w, d, u in zip(weights, gradients, uncertainties, strict=False):
        total = total + w * F.pow(d * u, F.lit(2.0))
    return F.sqrt(total)


def quantise(x: Column, scale: int = SCALE, nodata: int = NODATA) -> Column:
    """Scaled short; what is not positive, null or NaN becomes the nodata value."""
    return F.coalesce(F.when((x > 0) & ~F.isnan(x), F.round(x * scale)).cast("short"), F.lit(nodata).cast("short"))


def stretch(x: Column, gain: float = STRETCH) -> Column:
    """Byte value of a colour, truncated."""
    return F.floor(F.least(F.greatest(x * (gain * 255), F.lit(0.0)), F.lit(255.0))).cast("short")


def opaque(*toa: Column) -> Column:
    """255 where every colour has a positive top-of-atmosphere value, else 0."""
    out = F.lit(True)
    for t in toa:
        out = out & F.coalesce(t > 0, F.lit(False))
    return F.when(out, 255).otherwise(0).cast("short")


def elevation(raw: Column, scale: float = 0.001) -> Column:
    return F.coalesce(F.when(~F.isnan(raw), raw * scale), F.lit(0.0))


def horner(x: Column, coefficients) -> Column:
    out = F.lit(0.0)
    for k in coefficients:
        out = out * x + k
    return out


def within_envelope(toa: Column, boa: Column, low, high) -> Column:
    gap = toa - boa
    return (gap >= horner(boa, low)) & (gap <= horner(boa, high))
