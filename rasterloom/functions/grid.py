"""Pixel, map and tile coordinates, block indices and dates, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the sinusoidal grid: sphere radius in metres, 36 x 18 tiles.
RADIUS = 6371007.181
TILE = 2 * math.pi * RADIUS / 36


def sinusoidal(lon_deg: Column, lat_deg: Column) -> tuple[Column, Column]:
    lat = F.radians(lat_deg)
    return RADIUS * F.radians(lon_deg) * F.cos(lat), RADIUS * lat


def tile_id(lon_deg: Column, lat_deg: Column) -> Column:
    """h00v00 name of the tile that holds the point."""
    x, y = sinusoidal(lon_deg, lat_deg)
    h = ((x + math.pi * RADIUS) / TILE).cast("int")
    v = 17 - ((y + math.pi * RADIUS / 2) / TILE).cast("int")
    return F.format_string("h%02dv%02d", h, v)


def to_map(row: Column, col: Column, x0: float, dx: float, y0: float, dy: float) -> tuple[Column, Column]:
    """Map coordinates of a pixel's upper left corner."""
    return x0 + col * dx, y0 + row * dy


def to_pixel(x: Column, y: Column, x0: float, dx: float, y0: float, dy: float) -> tuple[Column, Column]:
    """(row, col) of the pixel that holds the point."""
    return F.floor((y - y0) / dy).cast("int"), F.floor((x - x0) / dx).cast("int")


def block_index(h: Column, full: int, blocks: int) -> Column:
    """Block of a fine index among `blocks` over `full` pixels."""
    return (h / F.lit(float(full)) * blocks).cast("int")


def fine_index(i: Column, coarse: float, fine: float) -> Column:
    """Fine pixel at the upper left of a coarse cell."""
    return F.floor(i * (coarse / fine)).cast("int")


def window_days(day: Column, half: int = 16) -> Column:
    """Array of the days from half before to half after."""
    return F.sequence(F.date_sub(day, half), F.date_add(day, half))


def year_day(day: Column) -> Column:
    return F.date_format(day, "yyyyDDD")


def hours_since_1900(hours: Column) -> Column:
    return F.expr("TIMESTAMP_NTZ'1900-01-01 00:00:00'") + F.make_dt_interval(hours=hours)


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test against ring, array<struct<x,y>> without a repeated end."""
    last = F.element_at(ring, -1)
    step = F.aggregate(ring, F.struct(last.alias("p"), F.lit(False).alias("odd")), lambda s, q: F.struct(
        q.alias("p"),
        F.when(((q["y"] > y) != (s["p"]["y"] > y)) & (x < (s["p"]["x"] - q["x"]) * (y - q["y"]) / (s["p"]["y"] - q["y"]) + q["x"]), ~s["odd"]).otherwise(s["odd"]).alias("odd")))
    return step["odd"]


def rational(line: Column, samp: Column, height: Column, r_line: Column, r_samp: Column, mean: Column, num: Column, den: Column) -> Column:
    """A ten-term over nine-term ratio in line, sample and height; num and den are coefficient arrays."""
    top = [F.lit(1.0), line, samp, height, r_line, line * line, samp * line, samp * samp, r_samp * r_line * r_line, r_line * r_line * r_line]
    bottom = [line, samp, height, r_line, line * line, line * samp, samp * samp, r_samp * r_line * r_line, r_line * r_line * r_line]
    a = sum((F.get(num, F.lit(k)) * t for k, t in enumerate(top)), F.lit(0.0))
    b = sum((F.get(den, F.lit(k)) * t for k, t in enumerate(bottom)), F.lit(1.0))
    return mean + a / b


def vector_angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(zenith, azimuth) in degrees of a vector, made a unit vector first."""
    size = F.sqrt(x * x + y * y + z * z)
    return F.degrees(F.acos(z / size)), F.degrees(F.atan2(x, y))
