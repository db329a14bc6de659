"""Penalised spline smoothing of whole grids in the cosine domain, by row and column passes.

A cosine transform of a grid is one of its rows followed by one of its columns. Each pass deals lines of
scenes to a task, so no task holds a scene; what is chosen or judged for a scene as a whole (the
smoothing parameter, the change of a round, the scale of residuals) comes from sums over its cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.neighborhood import by_lines
from rasterloom.storage import checkpointed, discard

#: log10 of the smoothing parameter: the range that is searched, candidates of a pass, passes.
LOG_RANGE, CANDIDATES, PASSES = (-6.0, 8.0), 29, 6


def _scale(n: int) -> np.ndarray:
    f = np.full(n, np.sqrt(1 / (2 * n)))
    f[0] = np.sqrt(1 / (4 * n))
    return f


def dct(x: np.ndarray) -> np.ndarray:
    """Orthonormal cosine transform of the last axis, by one Fourier transform of its length."""
    n = x.shape[-1]
    v = np.fft.fft(np.concatenate([x[..., ::2], x[..., 1::2][..., ::-1]], -1))
    return 2 * (v * np.exp(-0.5j * np.pi * np.arange(n) / n)).real * _scale(n)


def idct(x: np.ndarray) -> np.ndarray:
    """The inverse of dct()."""
    n = x.shape[-1]
    y = x / _scale(n)
    back = np.concatenate([np.zeros_like(y[..., :1]), y[..., :0:-1]], -1)
    v = np.fft.ifft(0.5 * np.exp(0.5j * np.pi * np.arange(n) / n) * (y - 1j * back)).real
    out = np.empty_like(v)
    half = (n + 1) // 2
    out[..., ::2], out[..., 1::2] = v[..., :half], v[..., half:][..., ::-1]
    return out


def transform(grid: DataFrame, keys: list[str], value: str, inverse: bool = False) -> DataFrame:
    """The two-dimensional cosine transform of each dense grid(keys, r, c, value), or back."""
    for along, across in (("c", "r"), ("r", "c")):
        grid = by_lines(grid, keys, along, across, value, lambda _, x: idct(x) if inverse else dct(x))
    return grid


def _roughness(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    return 2 - 2 * np.cos(np.pi * k / n)


def _scores(spectrum: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, k, rss, trace: for the k-th candidate around a scene's centre, the squared residual and the kept share of the spectrum, summed in Arrow batches first.

    spectrum(keys, r, c, n_r, n_c, centre, step, value).
    """
    steps = np.arange(CANDIDATES) - CANDIDATES // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            rough = (_roughness(pdf["r"], pdf["n_r"]) + _roughness(pdf["c"], pdf["n_c"])).to_numpy() ** 2
            at, names = pd.factorize(pd.MultiIndex.from_frame(pdf[keys]))
            rss, trace = np.zeros((len(names), CANDIDATES)), np.zeros((len(names), CANDIDATES))
            for k, d in enumerate(steps):
                g = 1 / (1 + 10.0 ** (pdf["centre"] + d * pdf["step"]).to_numpy() * rough)
                rss[:, k] = np.bincount(at, ((1 - g) * pdf[value].to_numpy()) ** 2, len(names))
                trace[:, k] = np.bincount(at, g, len(names))
            first = pdf.drop_duplicates(keys)[keys]
            out = first.loc[first.index.repeat(CANDIDATES)].assign(k=np.tile(steps, len(names)).astype(np.int32), rss=rss.ravel(), trace=trace.ravel())
            yield pa.RecordBatch.from_pandas(out, schema, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = spectrum.select(*keys, F.lit(0).alias("k"), F.lit(0.0).alias("rss"), F.lit(0.0).alias("trace")).schema
    schema = to_arrow_schema(shape)
    return spectrum.mapInArrow(run, shape).groupBy(*keys, "k").agg(F.sum("rss").alias("rss"), F.sum("trace").alias("trace"))


def choose_s(spectrum: DataFrame, scenes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, s: the smoothing parameter of each scene by generalised cross-validation over ever finer candidates.

    scenes(keys, n_r, n_c, n_seen) has one row a scene.
    """
    low, high = LOG_RANGE
    state = scenes.withColumns({"centre": F.lit((low + high) / 2), "step": F.lit((high - low) / (CANDIDATES - 1))})
    former: list[DataFrame] = []
    for _ in range(PASSES):
        state = checkpointed(state, "spline-search")
        discard(*former)
        former = [state]
        scored = _scores(spectrum.join(state.drop("n_seen").hint("merge"), keys), keys, value)
        rest = 1 - F.col("trace") / (F.col("n_r") * F.col("n_c"))
        score = F.when(rest > 0, F.col("rss") / F.col("n_seen") / (rest * rest)).otherwise(F.lit(float("inf")))
        best = scored.join(state.hint("merge"), keys).withColumn("score", score).groupBy(*keys).agg(F.min_by("k", F.struct("score", "k")).alias("k"))
        state = state.join(best.hint("merge"), keys).withColumns({"centre": F.col("centre") + F.col("k") * F.col("step"), "step": F.col("step") / (CANDIDATES // 2)}).drop("k")
    return state.select(*keys, F.pow(F.lit(10.0), "centre").alias("s"))


def smooth_grids(df: DataFrame, value: str, keys: list[str], s: float | None = None, rounds: int = 100, tol: float = 1e-3) -> DataFrame:
    """df(keys, r, c, value) smoothed scene by scene under a penalty on second differences; null values are filled by the fit.

    s None is chosen for each scene by generalised cross-validation. A grid without nulls takes one round; with nulls, rounds replace them
    by the fit until the fit moves by less than tol of its norm, at most `rounds`. A scene spans rows and columns from 0 to its
    largest; cells that df lacks count as null and are not returned. A scene without a value stays null.
    """
    df = checkpointed(df.select(*keys, "r", "c", F.when(~F.isnan(value), F.col(value)).cast("double").alias(value)), "grid")
    scenes = df.groupBy(*keys).agg((F.max("r") + 1).alias("n_r"), (F.max("c") + 1).alias("n_c"), F.count(value).alias("n_seen"), F.avg(value).alias("mean")).where("n_seen > 0")
    scenes = checkpointed(scenes, "grids")
    side = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = scenes.select(*keys, "mean", side("n_r").alias("r"), "n_c").select(*keys, "mean", "r", side("n_c").alias("c"))
    cells = cells.join(df.hint("merge"), [*keys, "r", "c"], "left").select(*keys, "r", "c", F.col(value).alias("y"), F.coalesce(value, "mean").alias("z"), F.col("mean").alias("last"))
    cells = checkpointed(cells, "grid-cells")
    done, relax = None, F.when(F.col("n_seen") < F.col("n_r") * F.col("n_c"), 1.75).otherwise(1.0)
    chosen = scenes.select(*keys, F.lit(s).alias("s")) if s is not None else None
    for it in range(rounds):
        spectrum = checkpointed(transform(cells.select(*keys, "r", "c", F.col("z")), keys, "z"), "spectrum")
        if s is None and it & (it - 1) == 0:
            chosen = checkpointed(choose_s(spectrum, scenes.drop("mean"), keys, "z"), "chosen")
        rough = (1 - F.cos(np.pi * F.col("r") / F.col("n_r"))) + (1 - F.cos(np.pi * F.col("c") / F.col("n_c")))
        damped = spectrum.join(scenes.join(chosen.hint("merge"), keys).hint("merge"), keys).select(*keys, "r", "c", (F.col("z") / (1 + F.col("s") * 4 * rough * rough)).alias("z"))
        fit = transform(damped, keys, "z", True).withColumnRenamed("z", "fit")
        moved = cells.join(fit.hint("merge"), [*keys, "r", "c"]).join(scenes.select(*keys, relax.alias("_w")).hint("merge"), keys)
        moved = moved.select(*keys, "r", "c", "y", F.col("last").alias("before"), (F.col("_w") * F.col("fit") + (1 - F.col("_w")) * F.col("last")).alias("last"))
        former, cells = cells, checkpointed(moved, "grid-cells")
        discard(spectrum, *([former] if it == 0 else []))
        change = cells.groupBy(*keys).agg(F.sum(F.pow(F.col("last") - F.col("before"), 2)).alias("d"), F.sum(F.pow("last", 2)).alias("n"), F.count_if(F.col("y").isNull()).alias("open"))
        change = checkpointed(change.select(*keys, ((F.col("open") == 0) | (F.sqrt("d") < tol * F.sqrt("n"))).alias("still")), "grid-change")
        cells = cells.join(change.hint("merge"), keys)
        part = cells.where("still").select(*keys, "r", "c", F.col("last").alias(value))
        done = part if done is None else done.unionByName(part)
        cells = cells.where("not still").select(*keys, "r", "c", "y", F.coalesce("y", "last").alias("z"), "last")
        if not change.where("not still").limit(1).count():
            break
    done = done.unionByName(cells.select(*keys, "r", "c", F.col("last").alias(value)))
    return df.select(*keys, "r", "c").join(done.hint("merge"), [*keys, "r", "c"], "left")
