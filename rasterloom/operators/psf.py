"""Registration search: the shift, width and rotation under which fine and coarse images agree best."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rasterloom.operators import neighborhood as N
from rasterloom.storage import checkpointed

CELL = ("scene_id", "r", "c")


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson's r as an aggregate over rows with both values; null where a side is constant, where corr() fails in ANSI mode."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlations(points: DataFrame, image: DataFrame, shifts: DataFrame, value: str = "dn") -> DataFrame:
    """(scene_id, xs, ys, r, n): correlation of points(scene_id, hx, hy, boa) with the image at each shift.

    shifts is a literal grid. Points meet it first, then the image on the shifted key; the sums of a
    shift are combined before they travel.
    """
    tried = points.join(F.broadcast(shifts), "scene_id") if "scene_id" in shifts.columns else points.crossJoin(F.broadcast(shifts))
    at = tried.select("scene_id", "xs", "ys", "boa", (F.col("hx") + F.col("xs")).alias("r"), (F.col("hy") + F.col("ys")).alias("c"))
    met = at.join(image.select(*CELL, F.col(value).alias("v")).where("v is not null").hint("shuffle_hash"), [*CELL])
    return met.groupBy("scene_id", "xs", "ys").agg(correlation("v", "boa").alias("r"), F.count("*").alias("n"))


def window_correlations(points: DataFrame, image: DataFrame, half: int, value: str = "dn") -> DataFrame:
    """(scene_id, xs, ys, r, n) for every shift in [-half, half).

    A pixel within reach of a point stands for one shift of it, so no shift is exploded: points go to the (at most
    four) tiles of 2 half pixels a side that their window touches, and meet the image tile by tile.
    """
    side = 2 * half
    tile = lambda x: F.floor(x / side).cast("int")
    span = lambda x: F.explode(F.sequence(tile(x - half), tile(x + half - 1)))
    at = points.select("scene_id", "hx", "hy", "boa", span(F.col("hx")).alias("tr")).select("*", span(F.col("hy")).alias("tc"))
    of = image.select(*CELL, F.col(value).alias("v"), tile(F.col("r")).alias("tr"), tile(F.col("c")).alias("tc")).where("v is not null")
    met = at.join(of.hint("merge"), ["scene_id", "tr", "tc"]).select("scene_id", (F.col("r") - F.col("hx")).alias("xs"), (F.col("c") - F.col("hy")).alias("ys"), "v", "boa")
    met = met.where(F.col("xs").between(-half, half - 1) & F.col("ys").between(-half, half - 1))
    return met.groupBy("scene_id", "xs", "ys").agg(correlation("v", "boa").alias("r"), F.count("*").alias("n"))


def window_sums(points: DataFrame, image: DataFrame, half: int, value: str = "dn") -> DataFrame:
    """(scene_id, xs, ys, n, v, vv, b, bb, vb and their rounding bounds e_*): sums over the points that meet a pixel, for every shift in [-half, half).

    The sums of all shifts of a tile of points are cross-correlations with the image around it, taken by Fourier transforms, so their cost
    goes by tiles and not by points times shifts. Values are centred on their scene's means first, which no correlation sees.
    A task holds one tile and its surroundings.
    """
    size = 1 << max(math.ceil(math.log2(4 * half)), 5)
    side = size - 2 * half + 1
    means = image.groupBy("scene_id").agg(F.avg(value).alias("_mv")).join(points.groupBy("scene_id").agg(F.avg("boa").alias("_mb")).hint("merge"), "scene_id")
    means = checkpointed(means, "means").hint("merge")  # a row a scene
    b = F.col("boa") - F.col("_mb")
    of = points.where("boa is not null").join(means, "scene_id").groupBy("scene_id", "hx", "hy").agg(F.count("*").cast("double").alias("n"), F.sum(b).alias("b"), F.sum(b * b).alias("bb"))
    of = of.withColumns({"tr": F.floor(F.col("hx") / side), "tc": F.floor(F.col("hy") / side)})
    near = lambda x: F.explode(F.sequence(F.ceil((F.col(x) - side - half + 2) / side), F.floor((F.col(x) + half) / side)))
    seen = image.where(F.col(value).isNotNull()).join(means, "scene_id").select(*CELL, (F.col(value) - F.col("_mv")).alias("v"))
    seen = seen.select("*", near("r").alias("tr")).select("*", near("c").alias("tc"))
    names = ("v", "vv", "b", "bb", "vb")

    def run(key, left, right):
        scene, tr, tc = (k.as_py() for k in key)
        empty = not left.num_rows or not right.num_rows
        grids = {k: np.zeros((size, size)) for k in ("n", "b", "bb", "i", "v", "vv")}
        if not empty:
            at = left.column("hx").to_numpy() - tr * side, left.column("hy").to_numpy() - tc * side
            for k in ("n", "b", "bb"):
                grids[k][at] = left.column(k).to_numpy()
            at, v = (right.column("r").to_numpy() - tr * side + half, right.column("c").to_numpy() - tc * side + half), right.column("v").to_numpy()
            grids["i"][at], grids["v"][at], grids["vv"][at] = 1.0, v, v * v
        turned = {k: np.fft.rfft2(g) for k, g in grids.items()}
        weight = {k: float(np.sqrt((g * g).sum())) for k, g in grids.items()}
        pairs = {"n": ("n", "i"), "v": ("n", "v"), "vv": ("n", "vv"), "b": ("b", "i"), "bb": ("bb", "i"), "vb": ("b", "v")}
        sums = {k: np.fft.irfft2(np.conj(turned[x]) * turned[y], s=(size, size))[: 2 * half, : 2 * half] for k, (x, y) in pairs.items()}
        n = np.rint(sums["n"])
        xs, ys = np.nonzero(n)
        out = {"scene_id": pa.array([scene] * len(xs), kind), "xs": (xs - half).astype(np.int32), "ys": (ys - half).astype(np.int32), "n": n[xs, ys].astype(np.int64)}
        out |= {k: sums[k][xs, ys] for k in names}
        bound = 8 * np.finfo(float).eps * math.log2(size)
        return pa.table(out | {f"e_{k}": np.full(len(xs), bound * weight[pairs[k][0]] * weight[pairs[k][1]]) for k in names})

    scene = image.schema["scene_id"].dataType
    kind = to_arrow_type(scene)
    columns = ", ".join(f"{e}{k} double" for e in ("", "e_") for k in names)
    key = ["scene_id", "tr", "tc"]
    tiles = of.groupBy(*key).cogroup(seen.toDF(*seen.columns).groupBy(*key)).applyInArrow(run, f"scene_id {scene.simpleString()}, xs int, ys int, n bigint, {columns}")
    return tiles.groupBy("scene_id", "xs", "ys").agg(*[F.sum(c).alias(c) for c in ("n", *names, *[f"e_{k}" for k in names])])


def likely_shifts(sums: DataFrame) -> DataFrame:
    """(scene_id, xs, ys): the shifts of window_sums() that may be the best of their scene, as far as the rounding bounds can tell."""
    c = F.col
    by_n = lambda x: x / c("n")
    vv, bb, vb = c("vv") - by_n(c("v") * c("v")), c("bb") - by_n(c("b") * c("b")), c("vb") - by_n(c("v") * c("b"))
    e_vv, e_bb = (c(f"e_{k}{k}") + by_n(2 * F.abs(k) * c(f"e_{k}")) + by_n(c(f"e_{k}") * c(f"e_{k}")) for k in ("v", "b"))
    e_vb = c("e_vb") + by_n(F.abs("v") * c("e_b") + F.abs("b") * c("e_v"))
    j = sums.where("n > 1").select("scene_id", "xs", "ys", vv.alias("vv"), bb.alias("bb"), vb.alias("vb"), e_vv.alias("e_vv"), e_bb.alias("e_bb"), e_vb.alias("e_vb"))
    known = (c("vv") > 8 * c("e_vv")) & (c("bb") > 8 * c("e_bb"))
    scale = F.sqrt(c("vv") * c("bb"))
    r = c("vb") / scale
    error = 2 * (c("e_vb") / scale + F.abs(r) * (c("e_vv") / c("vv") + c("e_bb") / c("bb"))) + 2e-9
    cost = F.when(known, F.abs(1 - r))
    j = checkpointed(j.select("scene_id", "xs", "ys", cost.alias("cost"), F.when(known, error).alias("error")), "shift-costs")
    best = checkpointed(j.groupBy("scene_id").agg(F.min(c("cost") + c("error")).alias("limit")), "shift-limits")
    met = j.join(best.hint("merge"), "scene_id")
    return met.where("cost is null or limit is null or cost - error <= limit").select("scene_id", "xs", "ys")


def _at_shifts(points: DataFrame, image: DataFrame, shifts: DataFrame, value: str) -> DataFrame:
    """(scene_id, xs, ys, r, n) at some shifts of each scene, joined on the scene, not broadcast."""
    tried = points.join(checkpointed(shifts, "shifts").hint("merge"), "scene_id")
    at = tried.select("scene_id", "xs", "ys", "boa", (F.col("hx") + F.col("xs")).alias("r"), (F.col("hy") + F.col("ys")).alias("c"))
    met = at.join(image.select(*CELL, F.col(value).alias("v")).where("v is not null").hint("merge"), [*CELL])
    return met.groupBy("scene_id", "xs", "ys").agg(correlation("v", "boa").alias("r"), F.count("*").alias("n"))


def best_shift(found: DataFrame, accept: float = 0.6) -> DataFrame:
    """Least |1 - r| (to nine digits), of equals that over most points, then the first in (xs, ys) order; below `accept` the shift is (0, 0). Null correlations do not count."""
    best = found.where("r is not null and not isnan(r)").groupBy("scene_id").agg(
        F.min_by(F.struct("xs", "ys", "r"), F.struct(F.round(F.abs(1 - F.col("r")), 9), -F.col("n"), "xs", "ys")).alias("b"))
    ok = 1 - F.abs(1 - F.col("b.r")) >= accept
    return best.select("scene_id", F.when(ok, F.col("b.xs")).otherwise(0).alias("xs"), F.when(ok, F.col("b.ys")).otherwise(0).alias("ys"), F.col("b.r").alias("r"))


def grid_shifts(spark: SparkSession, half: int, step: int = 1) -> DataFrame:
    """Literal grid of shifts in [-half, half)."""
    one = lambda name: spark.range(-half, half, step).select(F.col("id").cast("int").alias(name))
    return one("xs").crossJoin(F.broadcast(one("ys")))


def search_shift(points: DataFrame, image: DataFrame, half: int = 50, stride: int = 5, exhaustive: bool = True, accept: float = 0.6, value: str = "dn") -> DataFrame:
    """Best shift of each scene over the whole grid: all shifts by tile-wise Fourier transforms, then those that rounding leaves in question exactly.

    Without exhaustive: a coarse grid, then every shift within stride of its best, which misses peaks narrower than the stride."""
    spark = points.sparkSession
    if exhaustive:
        return best_shift(_at_shifts(points, image, likely_shifts(window_sums(points, image, half, value)), value), accept)
    rough = best_shift(correlations(points, image, grid_shifts(spark, half, stride), value), -2.0)
    near = F.sequence(F.lit(-stride + 1), F.lit(stride - 1))
    fine = rough.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).select("scene_id", (F.col("xs") + F.col("dx")).alias("xs"), (F.col("ys") + F.col("dy")).alias("ys"))
    return best_shift(_at_shifts(points, image, fine, value), accept)


#: A prime below 2^31, multipliers of the rounds' hash, and rounds of the permutation.
PRIME = 2_147_483_647
MIX = (1_103_515_245, 69_069, 40_692)
SHUFFLES = 40


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A whole number below PRIME from whole numbers: sums of products modulo the prime, squared in between."""
    out = np.int64(1)
    for p, m in zip(parts, MIX, strict=False):
        out = (out * m + np.fmod(p, PRIME)) % PRIME
        out = (out * out + out + 7) % PRIME
    return out


def places(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """The place of i in a keyed permutation of 0 .. n - 1, from i alone: each round swaps i with its mirror image around a pivot, or not.

    Both partners of a swap see the same coin, so every round is a bijection, and no row needs to know another.
    """
    x = np.asarray(i, np.int64)
    for r in range(1, SHUFFLES + 1):
        other = (_mixed(r, key) % n - x) % n
        x = np.where(_mixed(np.maximum(x, other), r, key) // 1024 % 2 == 1, other, x)
    return x


def permuted(i: Column, n: int, key: int) -> Column:
    """places() of a column."""
    return F.pandas_udf(lambda x: pd.Series(places(x.to_numpy(), n, key)), "long")(i.cast("long"))


def design(df: DataFrame, i: str, n: int, bounds: list[tuple[float, float]], seed: int = 0) -> DataFrame:
    """df with x0, x1, ...: the point that each row's ordinal i (0 .. n - 1) has in a Latin hypercube of n points.

    Every stratum of every dimension is hit once. Nothing is sorted; the rounds run over Arrow batches.
    """
    def run(batches):
        for b in batches:
            ordinal, columns = b.column(b.schema.get_field_index(i)), []
            at, unknown = ordinal.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ordinal.is_null().to_numpy(zero_copy_only=False)
            for k, (low, high) in enumerate(bounds):
                key = seed * 1009 + k + 1
                inside = _mixed(at, key, 3).astype(float) / PRIME
                columns.append(pa.array((places(at, n, key) + inside) / n * (high - low) + low, mask=unknown))
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *[f"x{k}" for k in range(len(bounds))]])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"x{k} double" for k in range(len(bounds))]
    return df.mapInArrow(run, ", ".join(kinds))


def latin_hypercube(spark: SparkSession, n: int, bounds: list[tuple[float, float]], seed: int = 0) -> DataFrame:
    """n points, one in each of n strata of every dimension: (i, x0, x1, ...)."""
    return design(spark.range(n).select(F.col("id").alias("i")), "i", n, bounds, seed)


#: Parameters of a point spread; the last two are whole shifts.
SPREAD = ("std_row", "std_col", "angle", "xs", "ys")
SHIFTS = 2


def search_width(points: DataFrame, image: DataFrame, starts: int = 50, rounds: int = 6, keep: int = 2, seed: int = 0,
                 bounds=((1.0, 6.0), (1.0, 6.0), (-15.0, 15.0), (-5.0, 5.0), (-5.0, 5.0)), value: str = "dn") -> DataFrame:
    """(scene_id, k, std_row, std_col, angle, xs, ys, cost): candidates of each scene with their cost |1 - r|.

    A Latin hypercube of starts, then Newton steps from each scene's best ones. A round is one table of candidates over all scenes and one
    job: the costs a radius to either side of a centre along every parameter give slopes and curvatures, and so the point that the
    next round aims at. A centre moves to the best point tried; one that stays halves its radii. Shifts go by whole steps.
    """
    spark, size = points.sparkSession, len(SPREAD)
    low, high = (F.array(*[F.lit(float(x[k])) for x in bounds]) for k in (0, 1))
    scenes = points.select("scene_id").distinct()
    unit = latin_hypercube(spark, max(starts, 2), [tuple(map(float, x)) for x in bounds], seed)  # a literal design
    tried = scenes.crossJoin(F.broadcast(checkpointed(unit, "design"))).select("scene_id", F.col("i").alias("k"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("j"), F.array(*[f"x{k}" for k in range(size)]).alias("x"))
    tiles = _width_tiles(points, image, bounds, value)
    found = scored = _scored(tiles, tried)
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy("cost", "k"))  # some dozen starts a scene
    radius = F.array(*[F.lit(0.15 * (hi - lo) if k < size - SHIFTS else 1.0) for k, (lo, hi) in enumerate(bounds)])
    state = scored.withColumn("b", rank.cast("long")).where(F.col("b") <= keep).select("scene_id", "b", "x", "cost", radius.alias("h"), F.lit(None).cast("array<double>").alias("aim"))
    for step in range(1, rounds + 1):
        state = checkpointed(state, "width-centres")
        inside = lambda x: F.transform(x, lambda v, k: F.least(F.greatest(v, F.get(low, k)), F.get(high, k)))
        sides = [F.struct(F.lit(2 * i + (sign > 0)).alias("j"), inside(_beside(i, sign)).alias("x")) for i in range(size) for sign in (-1, 1)]
        aimed = F.struct(F.lit(2 * size).alias("j"), inside(F.col("aim")).alias("x"))
        tried = state.select("scene_id", "b", F.explode(F.array_compact(F.array(*sides, F.when(F.col("aim").isNotNull(), aimed)))).alias("c")).select("scene_id", (F.lit(step * 1_000_000) + F.col("b") * 1000 + F.col("c.j")).alias("k"), "b", "c.j", "c.x")
        scored = _scored(tiles, tried)
        found = found.unionByName(scored)
        seen = scored.groupBy("scene_id", "b").agg(F.map_from_entries(F.collect_list(F.struct("j", "cost"))).alias("f"), F.min_by(F.struct("x", "cost"), F.struct("cost", "k")).alias("best"))
        j = state.join(seen.hint("merge"), ["scene_id", "b"], "left")
        at = lambda k: F.try_element_at("f", k.cast("int"))

        def newton(v, k):
            below, above, h = at(2 * k), at(2 * k + 1), F.get("h", k)
            slope, bend = (above - below) / 2, above + below - 2 * F.col("cost")
            by = F.when(bend > 0, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), -slope / bend))).otherwise(-F.signum(slope))
            whole = F.when(F.least(below, above) < F.col("cost"), F.when(below < above, -1.0).otherwise(1.0)).otherwise(0.0)
            return v + F.coalesce(F.when(k < size - SHIFTS, by).otherwise(whole), F.lit(0.0)) * h

        better = F.coalesce(F.col("best.cost") < F.col("cost"), F.lit(False))
        smaller = F.transform("h", lambda h, k: F.when(k < size - SHIFTS, h / 2).otherwise(h))
        state = j.select("scene_id", "b", F.when(better, F.col("best.x")).otherwise(F.col("x")).alias("x"), F.when(better, F.col("best.cost")).otherwise(F.col("cost")).alias("cost"),
                         F.when(better, F.col("h")).otherwise(smaller).alias("h"), F.transform("x", newton).alias("aim"))
    return found.select("scene_id", "k", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(SPREAD)], "cost")


def _beside(i: int, sign: int) -> Column:
    """The centre x moved by its radius h along parameter i."""
    return F.transform("x", lambda v, k: F.when(k == i, v + sign * F.get("h", k)).otherwise(v))


def _scored(tiles: DataFrame, tried: DataFrame) -> DataFrame:
    """tried(scene_id, k, b, j, x) with cost, written; candidates without one stay away."""
    tried = checkpointed(tried, "candidates")
    costs = _width_costs(tiles, tried.select("scene_id", "k", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(SPREAD)]))
    return checkpointed(tried.join(costs.hint("merge"), ["scene_id", "k"]), "widths")


#: Cells on a side of a tile of points.
WIDTH_TILE = 64


def _width_tiles(points: DataFrame, image: DataFrame, bounds, value: str) -> DataFrame:
    """(scene_id, tr, tc, mv, mb, points, pixels): a row a tile, with its points and the image as far around them as any candidate within bounds reaches."""
    side = WIDTH_TILE
    first = [math.floor(low) for low, _ in bounds[-SHIFTS:]]
    last = [math.ceil(high) + 2 * math.ceil(1.96 * std) - 1 for (_, high), (_, std) in zip(bounds[-SHIFTS:], bounds, strict=False)]
    tile = lambda x: F.floor(F.col(x) / side).cast("int")
    near = lambda x, k: F.explode(F.sequence(F.ceil((F.col(x) - last[k] - side + 1) / side).cast("int"), F.floor((F.col(x) - first[k]) / side).cast("int")))
    once = points.groupBy("scene_id", "hx", "hy").agg(F.first("boa").cast("double").alias("boa"))
    at = once.groupBy("scene_id", tile("hx").alias("tr"), tile("hy").alias("tc")).agg(F.collect_list(F.struct("hx", "hy", "boa")).alias("points"), F.sum("boa").alias("sb"), F.count("boa").alias("nb"))
    seen = image.select(*CELL, F.col(value).cast("double").alias("v")).where("v is not null")
    around = seen.select("*", near("r", 0).alias("tr")).select("*", near("c", 1).alias("tc"))
    around = around.groupBy("scene_id", "tr", "tc").agg(F.collect_list(F.struct("r", "c", "v")).alias("pixels"))
    at = checkpointed(at.join(around.hint("merge"), ["scene_id", "tr", "tc"]), "width-tiles")
    # What correlations are centred on; they do not see it.
    means = seen.groupBy("scene_id").agg(F.avg("v").alias("mv")).join(at.groupBy("scene_id").agg(F.try_divide(F.sum("sb"), F.sum("nb")).alias("mb")).hint("merge"), "scene_id")
    return checkpointed(at.drop("sb", "nb").join(checkpointed(means, "means").hint("merge"), "scene_id"), "width-tiles")


def _kernel(std_row: float, std_col: float, angle: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dr, dc, w) as gaussian_column() gives them."""
    h, w = (2 * math.ceil(1.96 * x) for x in (std_row, std_col))
    i, j = (x.ravel() for x in np.mgrid[:h, :w])
    y, x, t = i - h / 2 + 0.5, j - w / 2 + 0.5, math.radians(angle)
    u, v = x * math.cos(t) - y * math.sin(t), x * math.sin(t) + y * math.cos(t)
    return i, j, np.exp(-0.5 * (u / std_col * u / std_col + v / std_row * v / std_row))


def _width_costs(tiles: DataFrame, tried: DataFrame) -> DataFrame:
    """(scene_id, k, cost): each point's weighted average under each candidate's kernel, correlated per scene and candidate.

    A task averages under all candidates of a scene tile by tile and gives one row of sums for each; neither points nor taps travel.
    """
    asked = tried.select("scene_id", F.struct("k", "std_row", "std_col", "angle", F.round("xs").cast("int").alias("dx"), F.round("ys").cast("int").alias("dy")).alias("_c"))
    asked = asked.groupBy("scene_id").agg(F.collect_list("_c").alias("candidates"))
    names = ("v", "b", "vv", "bb", "vb")

    def run(batches):
        for batch in batches:
            out, of = [], []
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            for row in range(batch.num_rows):
                hx, hy, boa = (x.to_numpy(zero_copy_only=False) for x in column("points")[row].values.flatten())
                r, c, v = (x.to_numpy(zero_copy_only=False) for x in column("pixels")[row].values.flatten())
                mv, mb = column("mv")[row].as_py(), column("mb")[row].as_py()
                known = ~np.isnan(boa)
                if mb is None or not known.any():
                    continue
                hx, hy, b = hx[known], hy[known], boa[known] - mb
                r0, c0 = min(r.min(), hx.min()), min(c.min(), hy.min())
                shape = (max(r.max(), hx.max()) - r0 + 1, max(c.max(), hy.max()) - c0 + 1)
                value, seen = np.zeros(shape), np.zeros(shape)
                np.add.at(value, (r - r0, c - c0), v - mv)
                np.add.at(seen, (r - r0, c - c0), 1.0)
                for q in column("candidates")[row].as_py():
                    dr, dc, w = _kernel(q["std_row"], q["std_col"], q["angle"])
                    at = hx[:, None] - r0 + q["dx"] + dr, hy[:, None] - c0 + q["dy"] + dc
                    inside = (at[0] >= 0) & (at[0] < shape[0]) & (at[1] >= 0) & (at[1] < shape[1])
                    at = np.where(inside, at[0], 0), np.where(inside, at[1], 0)
                    weight = seen[at] * inside * w
                    total = weight.sum(1)
                    met = total > 0
                    x, z = (value[at] * inside * w).sum(1)[met] / total[met], b[met]
                    if len(x):
                        of.append(row)
                        out.append((q["k"], len(x), x.sum(), z.sum(), (x * x).sum(), (z * z).sum(), (x * z).sum()))
            columns = list(zip(*out, strict=True)) or [[]] * (2 + len(names))
            yield pa.RecordBatch.from_arrays([column("scene_id").take(pa.array(of, pa.int32())), *[pa.array(x, pa.int64()) for x in columns[:2]], *[pa.array(x, pa.float64()) for x in columns[2:]]], names=["scene_id", "k", "n", *names])

    met = tiles.join(asked.hint("merge"), "scene_id").mapInArrow(run, f"scene_id {tiles.schema['scene_id'].dataType.simpleString()}, k bigint, n bigint, {', '.join(f'{n} double' for n in names)}")
    sums = met.groupBy("scene_id", "k").agg(*[F.sum(n).alias(n) for n in ("n", *names)])
    spread = lambda x: F.col(x + x) - F.col(x) * F.col(x) / F.col("n")
    # A spread that is rounding alone stands for a constant, which has no correlation.
    varies = (spread("v") > 1e-12 * F.col("vv")) & (spread("b") > 1e-12 * F.col("bb"))
    r = (F.col("vb") - F.col("v") * F.col("b") / F.col("n")) / F.sqrt(spread("v") * spread("b"))
    return sums.where(varies).select("scene_id", "k", F.abs(1 - r).alias("cost")).where("not isnan(cost)")


def pearson_cost(a: str | Column, b: str | Column) -> Column:
    """|1 - r| as an aggregate; null where a side is constant."""
    return F.abs(1 - correlation(a, b))
