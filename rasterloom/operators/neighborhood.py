"""Neighbourhood operators on grids: morphology, point-spread averages, smoothing, smoothness cost, nearest fill.

Row and column passes are range windows over (scene, row) or (scene, column): thousands of
partitions, none larger than a side of the grid. Scattered neighbourhoods explode literal
offsets and join on the shifted key; no plan compares pixels with pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ("scene_id", "r", "c")


def dense(mask: DataFrame, rows: int, cols: int, value: str = "mask") -> DataFrame:
    """Every cell of rows x cols for each scene; cells without a row get null."""
    grid = mask.select("scene_id").distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return grid.join(mask.select(*CELL, value).hint("shuffle_hash"), [*CELL], "left")


def _around(key: str, order: str, n: int):
    return Window.partitionBy("scene_id", key).orderBy(order).rangeBetween(-n, n)


def dilate(grid: DataFrame, n: int, value: str = "mask") -> DataFrame:
    """True within a square of radius n of a true cell, on a dense grid; null counts as false."""
    x = F.coalesce(F.col(value), F.lit(False)).cast("int")
    rows = grid.withColumn("_x", F.max(x).over(_around("r", "c", n)))
    return rows.withColumn(value, F.max("_x").over(_around("c", "r", n)) == 1).drop("_x")


def erode(grid: DataFrame, n: int, value: str = "mask") -> DataFrame:
    """True where the whole square of radius n is true; outside counts as false, and so does null."""
    x = F.coalesce(F.col(value), F.lit(False)).cast("int")
    rows = grid.withColumn("_x", F.sum(x).over(_around("r", "c", n)))
    return rows.withColumn(value, F.sum("_x").over(_around("c", "r", n)) == (2 * n + 1) ** 2).drop("_x")


def bad_zone(grid: DataFrame, resolution: float, value: str = "mask") -> DataFrame:
    """A bad mask with specks removed (erosion 5) and grown by the reach of the point spread."""
    return dilate(erode(grid, 5, value), 30 + int(2 * 1.96 * 340 / resolution), value)


def disk(n: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if a * a + b * b <= n * n]


def _offsets(points: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in points])


def disk_dilate(mask: DataFrame, n: int, value: str = "mask") -> DataFrame:
    """Cells within a disk of a true cell: only true cells are exploded."""
    hit = (
        mask.where(F.col(value)).select("scene_id", "r", "c", F.explode(_offsets(disk(n))).alias("o"))
        .select("scene_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).distinct().withColumn("_hit", F.lit(True))
    )
    return mask.join(hit.hint("shuffle_hash"), [*CELL], "left").withColumn(value, F.col("_hit").isNotNull()).drop("_hit")


def disk_erode(mask: DataFrame, n: int, value: str = "mask") -> DataFrame:
    """Cells whose disk holds no false cell; outside counts as true."""
    inverse = mask.withColumn(value, ~F.coalesce(F.col(value), F.lit(False)))
    return disk_dilate(inverse, n, value).withColumn(value, ~F.col(value))


def open_mask(mask: DataFrame, erosion: int = 2, dilation: int = 3, value: str = "mask") -> DataFrame:
    return disk_dilate(disk_erode(mask, erosion, value), dilation, value)


def gaussian(std_row: float, std_col: float, angle_deg: float = 0.0) -> list[tuple[int, int, float]]:
    """(dr, dc, weight) of a point-spread window of 2 ceil(1.96 std) cells a side from the anchor, unit sum."""
    h, w = 2 * math.ceil(1.96 * std_row), 2 * math.ceil(1.96 * std_col)
    t = math.radians(angle_deg)
    cells = []
    for i in range(h):
        for j in range(w):
            y, x = i - h / 2 + 0.5, j - w / 2 + 0.5
            u, v = x * math.cos(t) - y * math.sin(t), x * math.sin(t) + y * math.cos(t)
            cells.append((i, j, math.exp(-0.5 * ((u / std_col) ** 2 + (v / std_row) ** 2))))
    total = sum(c[2] for c in cells)
    return [(i, j, k / total) for i, j, k in cells]


def gaussian_column(std_row: Column, std_col: Column, angle_deg: Column) -> Column:
    """The same window as an array of (dr, dc, w) built from columns; the weights have no unit sum."""
    h, w = (2 * F.ceil(1.96 * x).cast("int") for x in (std_row, std_col))
    t = F.radians(angle_deg)

    def cell(i: Column, j: Column) -> Column:
        y, x = i - h / 2 + 0.5, j - w / 2 + 0.5
        u, v = x * F.cos(t) - y * F.sin(t), x * F.sin(t) + y * F.cos(t)
        return F.struct(i.alias("dr"), j.alias("dc"), F.exp(-0.5 * (u / std_col * u / std_col + v / std_row * v / std_row)).alias("w"))

    return F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda i: F.transform(F.sequence(F.lit(0), w - 1), lambda j: cell(i, j))))


def psf_weights(resolution: float) -> list[tuple[int, int, float]]:
    """The point spread (std 260 m down the rows, 340 m along them) in cells of the resolution."""
    return gaussian(260 / resolution, 340 / resolution)


def psf_average(points: DataFrame, image: DataFrame, weights: list[tuple[int, int, float]], value: str = "dn", centred: bool = False, shape: tuple[int, int] | None = None) -> DataFrame:
    """Weighted mean of the image around each point(scene_id, r, c), nulls left out.

    With a shape, what lies beyond the image's last row and column counts as 0; without, it is left out too.

    The window starts at the point; centred puts its middle there. Points explode the literal
    window and meet the image on the shifted key.
    """
    h, w = max(a for a, _, _ in weights) + 1, max(b for _, b, _ in weights) + 1
    at = (h // 2, w // 2) if centred else (0, 0)
    kernel = F.array(*[F.struct(F.lit(a - at[0]).alias("dr"), F.lit(b - at[1]).alias("dc"), F.lit(k).alias("w")) for a, b, k in weights])
    spread = points.select(F.col("scene_id"), F.col("r").alias("_r"), F.col("c").alias("_c"), F.explode(kernel).alias("k"))
    spread = spread.select("scene_id", "_r", "_c", (F.col("_r") + F.col("k.dr")).alias("r"), (F.col("_c") + F.col("k.dc")).alias("c"), F.col("k.w").alias("w"))
    seen = image.select(*CELL, F.col(value).alias("v")).where("v is not null")
    if shape is None:
        met = spread.join(seen.hint("shuffle_hash"), [*CELL])
    else:
        beyond = (F.col("r") >= shape[0]) | (F.col("c") >= shape[1])
        met = spread.join(seen.hint("shuffle_hash"), [*CELL], "left").withColumn("v", F.when(beyond, 0.0).otherwise(F.col("v"))).where("v is not null")
    return met.groupBy("scene_id", F.col("_r").alias("r"), F.col("_c").alias("c")).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias(value))


def by_lines(grid: DataFrame, keys: list[str], along: str, across: str, value: str, turn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """grid(keys, r, c, value) with every line turned as a whole: turn(places, values) gets lines of one length, by ascending place, and gives their new values.

    A line is one row for Spark, and a task turns the lines of an Arrow batch together, so the work goes by cells and not by groups. Null is NaN on
    the way in and out.
    """
    lines = grid.select(*keys, across, F.struct(F.col(along).alias("at"), F.col(value).cast("double").alias("x")).alias("_cell"))
    lines = lines.groupBy(*keys, across).agg(F.collect_list("_cell").alias("_line"))
    names = [*keys, across, along, value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            line = b.column(b.schema.get_field_index("_line"))
            n = line.value_lengths().to_numpy(zero_copy_only=False)
            of, at = np.repeat(np.arange(len(n)), n), np.concatenate([[0], np.cumsum(n)])
            place, x = (v.to_numpy(zero_copy_only=False) for v in line.flatten().flatten())
            order = np.lexsort((place, of))
            place, x = place[order], x[order]
            out = np.empty(len(x))
            for size in np.unique(n):
                cells = at[:-1][n == size][:, None] + np.arange(size)
                out[cells] = turn(place[cells], x[cells])
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)).take(pa.array(of)) for k in names[:-2]], pa.array(place), pa.array(out, from_pandas=True)], names=names)

    kinds = ", ".join(f"{k} {grid.schema[k].dataType.simpleString()}" for k in names[:-1])
    return lines.mapInArrow(run, f"{kinds}, {value} double").select(*keys, "r", "c", value)


def smooth(image: DataFrame, std_row: float, std_col: float, rows: int, cols: int, value: str = "dn", reach: float = 4.0) -> DataFrame:
    """Separable Gaussian of a dense image with mirrored edges; a std below 1 leaves that axis alone.

    Each pass sums the truncated kernel of one axis along the lines of a grid. Nulls are left out of the sums.
    """
    def axis(df: DataFrame, name: str, size: int, std: float) -> DataFrame:
        if std < 1:
            return df
        n = math.ceil(reach * std)
        w = np.exp(-0.5 * (np.arange(-n, n + 1) / std) ** 2)
        w /= w.sum()

        def mirrored(k: np.ndarray) -> np.ndarray:
            k = k % (2 * size)
            return np.where(k >= size, 2 * size - 1 - k, k)

        def turn(place: np.ndarray, x: np.ndarray) -> np.ndarray:
            full, near = np.full((len(x), size), np.nan), mirrored(np.arange(-n, size + n))
            row, col = np.nonzero((place >= 0) & (place < size))
            full[row, place[row, col]] = x[row, col]
            known, full = ~np.isnan(full)[:, near], np.nan_to_num(full)[:, near]
            out, hit = np.zeros((len(x), size)), np.zeros((len(x), size), bool)
            for k, v in enumerate(w):
                out += v * full[:, k:k + size]
                hit |= known[:, k:k + size]
            return np.take_along_axis(np.where(hit, out, np.nan), mirrored(place), 1)

        return by_lines(df, ["scene_id"], name, "c" if name == "r" else "r", value, turn)

    return axis(axis(image.select(*CELL, value), "r", rows, std_row), "c", cols, std_col)


def smoothness(blocks: DataFrame, value: str, gamma: float = 1.0) -> DataFrame:
    """Per cell: summed squared differences to its four neighbours over interior centres, and the gradient.

    Interior cells are centres; each difference pulls on both of its ends. blocks(scene_id, bi, bj, value).
    """
    v = F.col(value)
    row, col = Window.partitionBy("scene_id", "bi").orderBy("bj"), Window.partitionBy("scene_id", "bj").orderBy("bi")
    n = blocks.select("scene_id", "bi", "bj", value).withColumns({
        "w": F.lag(value).over(row), "e": F.lead(value).over(row), "n": F.lag(value).over(col), "s": F.lead(value).over(col)})
    sides = ("w", "e", "n", "s")
    inner = v.isNotNull()
    for k in sides:
        inner = inner & F.col(k).isNotNull()
    n = n.withColumn("inner", inner)
    n = n.withColumns({"iw": F.lag("inner").over(row), "ie": F.lead("inner").over(row), "in": F.lag("inner").over(col), "is": F.lead("inner").over(col)})
    cost, pull = F.lit(0.0), F.lit(0.0)
    for k in sides:
        d = v - F.col(k)
        cost = cost + F.when(F.col("inner"), d * d).otherwise(0.0)
        pull = pull + F.when(F.col("inner"), d).otherwise(0.0) + F.when(F.coalesce(F.col("i" + k), F.lit(False)), d).otherwise(0.0)
    return n.select("scene_id", "bi", "bj", (0.5 * gamma * gamma * cost).alias("cost"), (gamma * gamma * pull).alias("gradient"))


#: Rows of a grid that one task reads off together.
LINES = 16


def envelope(centre: list[int], height: list[int], unit: int) -> tuple[list[int], list[int]]:
    """(start, owner): from start[k] up to the next start, owner[k] has the least unit * (x - centre)^2 + height at whole x.

    Centres ascend. The lower envelope of parabolas: each one enters and leaves once, so the pass is linear.
    """
    start: list[int] = []
    owner: list[int] = []
    for j, (c, h) in enumerate(zip(centre, height, strict=True)):
        first = None
        while owner:
            i = owner[-1]
            # The first whole x at which j is below i.
            first = (h + unit * c * c - height[i] - unit * centre[i] ** 2) // (2 * unit * (c - centre[i])) + 1
            if len(owner) == 1 or first > start[-1]:
                break
            start.pop()
            owner.pop()
        start.append(-(1 << 62) if first is None else first)
        owner.append(j)
    return start, owner


def nearest_fill(grid: DataFrame, value: str, max_radius: int | None = None) -> DataFrame:
    """Null cells of a dense grid take the nearest known value (squared distance, then row, then column) at any distance.

    Two separable passes: each cell meets the nearest known cell of its column (last known one above and below, the upper of
    equals), then each row is read off the lower envelope of the parabolas that these stand for, in time linear in its
    width. A task holds single lines of a grid. Scenes without a known value stay null; with a max_radius, so do cells with nothing within it.
    """
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col("r").alias("r"), F.col(value).alias("v")))
    column = Window.partitionBy("scene_id", "c")
    up, down = (F.last(seen, True).over(column.orderBy(o)) for o in (F.col("r").asc(), F.col("r").desc()))
    near = grid.select(*CELL, value, up.alias("up"), down.alias("down"))
    above = F.col("down.r").isNull() | (F.col("r") - F.col("up.r") <= F.col("down.r") - F.col("r"))
    near = near.withColumn("k", F.when(F.col("up.r").isNotNull() & above, F.col("up")).otherwise(F.col("down")))
    near = near.select(*CELL, value, F.col("k.r").alias("at"), F.col("k.v").alias("v"))

    def line(row: int, c: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the candidates (c, at) is nearest to each column x of a row, and its squared distance."""
        width = int(c.max()) + 1
        # Distances come first, then the cell: its number is less than a unit of distance.
        unit = (int(at.max()) + 1) * width
        start, owner = envelope(c.tolist(), [unit * (a - row) ** 2 + a * width + k for a, k in zip(at.tolist(), c.tolist(), strict=True)], unit)
        k = np.array(owner)[np.searchsorted(np.array(start), x, "right") - 1]
        return k, (c[k] - x) ** 2 + (at[k] - row) ** 2

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"]).reset_index(drop=True)
        r, c, v, out = pdf["r"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64), pdf["v"].to_numpy(), pdf[value].to_numpy().copy()
        at, known, open_ = pdf["at"].fillna(-1).to_numpy(np.int64), pdf["at"].notna().to_numpy(), pdf[value].isna().to_numpy()
        edge = np.flatnonzero(np.diff(r, prepend=r[0] - 1, append=r[-1] + 1))
        for begin, end in zip(edge[:-1], edge[1:], strict=True):
            of, to = begin + np.flatnonzero(known[begin:end]), begin + np.flatnonzero(open_[begin:end])
            if len(of) and len(to):
                k, d2 = line(int(r[begin]), c[of], at[of], c[to])
                near_enough = slice(None) if max_radius is None else d2 <= max_radius**2
                out[to[near_enough]] = v[of[k]][near_enough]
        return pdf[[*CELL]].assign(**{value: out})

    kinds = ", ".join(f"{k} {grid.schema[k].dataType.simpleString()}" for k in (*CELL, value))
    return near.groupBy("scene_id", F.floor(F.col("r") / LINES).alias("_lines")).applyInPandas(fill, kinds)
