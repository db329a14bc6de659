"""Time-series operators: windows of daily model parameters, robust smoothing, stability.

A series is at most a window of days (33 by default), so it fits an array; smoothing runs on
Arrow batches of whole series, many at a time. Spark partitions the series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import radiometry as R


def brdf_window(brdf: DataFrame, day: str, half: int = 16) -> DataFrame:
    """Rows of the days around one day (partition pruning on day), with weight; fills become 0."""
    d = F.to_date(F.lit(day))
    near = brdf.where((F.col("day") >= F.date_sub(d, half)) & (F.col("day") <= F.date_add(d, half)))
    clean = {c: F.when(F.col(c) == 32767, 0.0).otherwise(F.col(c)) for c in ("f_iso", "f_vol", "f_geo")}
    return near.withColumns(clean).withColumn("weight", R.qa_weight(F.col("qa")))


def series(df: DataFrame, keys: list[str], day: str, half: int, values: list[str], weight: str = "weight") -> DataFrame:
    """keys, one array for each value and one of weights over the whole window; missing days are 0 with weight 0."""
    start = F.date_sub(F.to_date(F.lit(day)), half)
    at = df.withColumn("_i", F.date_diff("day", start)).where((F.col("_i") >= 0) & (F.col("_i") <= 2 * half))
    # A day that occurs twice counts once: the heavier row.
    row = F.struct(F.col(weight).alias("w"), *values)
    once = at.groupBy(*keys, "_i").agg(F.max(row).alias("x"))
    held = once.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "x"))).alias("m"))
    pick = lambda name: F.transform(F.sequence(F.lit(0), F.lit(2 * half)), lambda i: F.coalesce(F.try_element_at("m", i)[name], F.lit(0.0)))
    return held.select(*keys, *[pick(v).alias(v) for v in values], pick("w").alias(weight))


def solve_tridiagonal(diagonal: np.ndarray, off: float, right: np.ndarray) -> np.ndarray:
    """Rows are systems with the same constant off-diagonal; one sweep down and one up for all together."""
    n = diagonal.shape[1]
    c, x = np.empty_like(right), np.empty_like(right)
    beta = diagonal[:, 0].copy()
    x[:, 0] = right[:, 0] / beta
    for k in range(1, n):
        c[:, k] = off / beta
        beta = diagonal[:, k] - off * c[:, k]
        x[:, k] = (right[:, k] - off * x[:, k - 1]) / beta
    for k in range(n - 2, -1, -1):
        x[:, k] -= c[:, k + 1] * x[:, k + 1]
    return x


def robust_smooth(y: np.ndarray, w: np.ndarray, strength: float = 2.0, rounds: int = 3, keep_qa: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Smooth rows of y under a first-difference penalty with bisquare weights; rows of next to no weight pass as they are.

    The residual scale is the median over days of positive original weight. keep_qa multiplies the original weights in.
    """
    y, w = y.astype(float), w.astype(float)
    out, weights = y.copy(), w.copy()
    live = w.sum(1) > 1e-6
    if not live.any():
        return out, weights
    y0, w0 = y[live], w[live]
    n = y.shape[1]
    penalty = strength * np.where((np.arange(n) == 0) | (np.arange(n) == n - 1), 1.0, 2.0)
    t = np.sqrt(1 + 16 * strength)
    leverage = np.sqrt(1 + t) / np.sqrt(2) / t
    now = w0
    for _ in range(rounds):
        x = solve_tridiagonal(now + penalty, -strength, now * y0)
        r = np.abs(x - y0)
        mad = np.maximum(np.nanmedian(np.where(w0 > 0, r, np.nan), 1, keepdims=True), 1e-5)
        u = r / (1.4826 * mad) / np.sqrt(1 - leverage) / 4.685
        now = np.where(u < 1, (1 - u * u) ** 2, 0.0)
        if keep_qa:
            now = now * w0
    out[live], weights[live] = x, now
    return out, weights


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lists(m: np.ndarray) -> pa.Array:
    at = np.arange(m.shape[0] + 1) * (m.shape[1] if m.ndim > 1 else 0)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(m.ravel()))


def smooth_series(df: DataFrame, values: list[str], weight: str = "weight", strength: float = 2.0, rounds: int = 3, keep_qa: bool = False) -> DataFrame:
    """Each value array smoothed, with its final weights as <value>_w; other columns pass through."""
    rest = [c for c in df.columns if c not in (*values, weight)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = _matrix(b.column(b.schema.get_field_index(weight)))
            out = [b.column(b.schema.get_field_index(c)) for c in rest]
            for v in values:
                x, nw = robust_smooth(_matrix(b.column(b.schema.get_field_index(v))), w, strength, rounds, keep_qa)
                out += [_lists(x), _lists(nw)]
            out.append(_lists(w))
            yield pa.RecordBatch.from_arrays(out, names=[*rest, *[n for v in values for n in (v, v + "_w")], weight])

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in rest]
    kinds += [f"{n} array<double>" for v in values for n in (v, v + "_w")] + [f"{weight} array<double>"]
    return df.select(*rest, *values, weight).mapInArrow(run, ", ".join(kinds))


def stability(x: Column, before: int, after: int) -> Column:
    """Population std over mean of the values from `before` days before the middle to `after` - 1 after it."""
    part = F.slice(x, F.floor(F.size(x) / 2).cast("int") - before + 1, before + after)
    n = F.size(part)
    mean = F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / n
    var = F.aggregate(part, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    return F.try_divide(F.sqrt(var), mean)


def centre_day(smoothed: DataFrame, values: list[str], weight: str = "weight") -> DataFrame:
    """Middle value and weight of each array, and stability; cells that were never seen get weight 1e-5."""
    mid = lambda c: F.get(F.col(c), F.floor(F.size(c) / 2).cast("int"))
    unseen = ~F.exists(weight, lambda w: w > 0)
    rest = [c for c in smoothed.columns if c not in [n for v in values for n in (v, v + "_w")] + [weight]]
    last = F.col(values[-1])
    steady = smoothed.withColumns({"stability": stability(last, 10, 10), "stability_near": stability(last, 4, 4)})
    middle = {n: mid(n) for v in values for n in (v, v + "_w")}
    middle |= {v + "_w": F.when(unseen, 1e-5).otherwise(mid(v + "_w")) for v in values}
    return steady.withColumns(middle).select(*rest, *middle, "stability", "stability_near")


def cosine_basis(n: int) -> np.ndarray:
    """Orthonormal cosine transform matrix."""
    k, i = np.mgrid[:n, :n]
    m = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def _middle(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Median of each row's known values; 0 for rows without one."""
    n = known.sum(1)
    x = np.sort(np.where(known, x, np.inf), 1)
    low, high = (np.take_along_axis(x, np.maximum(k, 0)[:, None], 1)[:, 0] for k in ((n - 1) // 2, np.minimum(n // 2, x.shape[1] - 1)))
    return np.where(n > 0, (low + high) / 2, 0.0)


def spline_smooth_many(y: np.ndarray, w: np.ndarray, s: float | None = None, robust: str | None = "bisquare", rounds: int = 100, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Penalised least squares in the cosine domain for vectors or grids of one shape, the first axis counts them: (smoothed, weights, s).

    Second differences are penalised on each axis. s None is chosen for each by generalised cross-validation. robust is
    bisquare, cauchy, talworth or None. Non-finite values get weight 0. All go through a round together; one that stands still leaves the rounds.
    """
    y = np.asarray(y, float)
    axes, wide = tuple(range(1, y.ndim)), (slice(None), *[None] * (y.ndim - 1))
    finite = np.isfinite(y)
    w = np.where(finite, w, 0.0)
    w = w / np.maximum(w.max(axes), 1e-300)[wide]
    y0, seen = np.where(finite, y, 0.0), np.maximum(finite.sum(axes), 1)
    bases = [cosine_basis(n) for n in y.shape[1:]]
    flat = lambda a: a.reshape(len(a), -1)

    def turn(a: np.ndarray, back: bool = False) -> np.ndarray:
        for axis, m in enumerate(bases, 1):
            a = np.moveaxis(np.moveaxis(a, axis, -1) @ (m if back else m.T), -1, axis)
        return a

    shape = y.shape[1:]
    roughness = sum(np.reshape(2 - 2 * np.cos(np.pi * np.arange(n) / n), [-1 if a == k else 1 for a in range(len(shape))]) for k, n in enumerate(shape)) ** 2
    order = int(np.sum(np.array(shape) > 1))

    def chosen(spectrum: np.ndarray, of: np.ndarray) -> np.ndarray:
        total_of, y_of, known, n = total[of], y0[of], finite[of], seen[of]

        def score(log_s: np.ndarray) -> np.ndarray:
            g = 1 / (1 + (10.0**log_s)[wide] * roughness)
            rss = np.where(known, total_of * (y_of - turn(g * spectrum, True)) ** 2, 0.0).sum(axes)
            kept = g.mean(axes)
            return np.where(kept < 1, rss / n / np.maximum(1 - kept, 1e-300) ** 2, np.inf)

        grid = np.linspace(-6, 8, 29)
        best = grid[np.argmin([score(np.full(len(of), v)) for v in grid], 0)]
        a, b = best - 0.5, best + 0.5
        for _ in range(25):
            c, d = b - 0.618 * (b - a), a + 0.618 * (b - a)
            lower = score(c) < score(d)
            a, b = np.where(lower, a, c), np.where(lower, d, b)
        return 10.0 ** ((a + b) / 2)

    total, z = w, np.where(finite, y0, (y0.sum(axes) / seen)[wide])
    own = np.full(len(y), np.nan if s is None else s)
    for _ in range(3 if robust else 1):
        relax = np.where((total < 1).any(axes), 1.75, 1.0)
        live = np.arange(len(y))
        for it in range(rounds):
            before = z[live]
            spectrum = turn(total[live] * (y0[live] - before) + before)
            if s is None and (it & (it - 1)) == 0:
                own[live] = chosen(spectrum, live)
            r = relax[live][wide]
            fresh = r * turn(spectrum / (1 + own[live][wide] * roughness), True) + (1 - r) * before
            change = np.linalg.norm(flat(fresh - before), axis=1) / np.maximum(np.linalg.norm(flat(fresh), axis=1), 1e-300)
            z[live] = fresh
            live = live[~(change < tol)]
            if not len(live):
                break
        if robust:
            t = np.sqrt(1 + 16 * own)
            h = (np.sqrt(1 + t) / np.sqrt(2) / t) ** order
            gap, known = flat(y0 - z), flat(finite)
            mad = np.maximum(_middle(np.abs(gap - _middle(gap, known)[:, None]), known), 1e-12)
            u = np.abs(y0 - z) / (1.4826 * mad * np.sqrt(1 - h))[wide]
            if robust == "cauchy":
                rw = 1 / (1 + (u / 2.385) ** 2)
            elif robust == "talworth":
                rw = (u < 2.795).astype(float)
            else:
                rw = np.where(u / 4.685 < 1, (1 - (u / 4.685) ** 2) ** 2, 0.0)
            total = w * rw
    return z, total, own


def spline_smooth(y: np.ndarray, w: np.ndarray, s: float | None = None, robust: str | None = "bisquare", rounds: int = 100, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """spline_smooth_many() for a single vector or grid."""
    y = np.atleast_1d(np.asarray(y, float))
    z, total, own = spline_smooth_many(y[None], np.broadcast_to(w, y.shape)[None], s, robust, rounds, tol)
    return z[0], total[0], float(own[0])


#: Series that go through the rounds together.
TOGETHER = 1024


def smooth_splines(df: DataFrame, value: str, weight: str, s: float | None = None, robust: str | None = "bisquare") -> DataFrame:
    """Series arrays smoothed many at a time: <value>, <value>_w and the s used; null and empty arrays stay so."""
    rest = [c for c in df.columns if c not in (value, weight)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, w = (b.column(b.schema.get_field_index(c)) for c in (value, weight))
            n = y.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(n)])
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(float) for x in (y, w)]
            smoothed, weights, used = np.empty(at[-1]), np.empty(at[-1]), np.empty(len(n))
            for size in np.unique(n[n > 0]):
                rows = np.flatnonzero(n == size)
                for of in np.array_split(rows, -(-len(rows) // TOGETHER)):
                    cells = at[of][:, None] + np.arange(size)
                    smoothed[cells], weights[cells], used[of] = spline_smooth_many(flat[0][cells], flat[1][cells], s, robust)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x), mask=y.is_null()) for x in (smoothed, weights)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in rest], *lists, pa.array(used, mask=n == 0)], names=[*rest, value, value + "_w", "s"])

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in rest]
    return df.select(*rest, value, weight).mapInArrow(run, ", ".join([*kinds, f"{value} array<double>", f"{value}_w array<double>", "s double"]))
