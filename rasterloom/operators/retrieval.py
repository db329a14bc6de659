"""Atmospheric retrieval per block over many scenes, posterior uncertainty, and surface correction.

The observations are written once, split by block and band; each round of the retrieval reads them where they lie: models at
block level go to them, and come back as 2 x 2 normal sums per block. The coupled system of a scene is cut into tiles of blocks: a task solves
one tile with the blocks around it, which overlap with its neighbours' and carry a change from tile to tile over the rounds; the
costs that steer a scene are sums over its tiles. So no task holds a scene. Rounds are written out, not kept as lineage.

Without smoothness no block knows of another: blocks then go through all their rounds inside a task, many side by side, over observations
that are sent once. Only blocks with more observations than a task should hold take the rounds above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import radiometry as R
from rasterloom.functions.grid import block_index
from rasterloom.operators.emulator import INPUTS, coefficients, forward
from rasterloom.operators.regrid import spline_regrid
from rasterloom.storage import bucketed, checkpointed, discard

BLOCK = ("scene_id", "bi", "bj")
#: Limits of optical thickness and water vapour, weight of the observations, slope of the band weights.
BOUNDS = ((0.001, 2.5), (0.0, 7.0))
OBS_WEIGHT = 0.25
BAND_SLOPE = -1.6


def pyramid(nx: int, ny: int) -> list[tuple[int, int]]:
    """Grid shapes from coarse to fine, halving; the last is the solution's."""
    levels = max(int(math.log2(max(min(nx, ny), 1))), 1)
    return [(max(nx // 2**k, 1), max(ny // 2**k, 1)) for k in range(levels - 1, -1, -1)]


def pyramid_levels(scenes: DataFrame) -> DataFrame:
    """(scene_id, level, ni, nj): the grid shapes of scenes(scene_id, ni, nj) from coarse (level 0) to their own, as pyramid() gives them."""
    least = F.greatest(F.least("ni", "nj"), F.lit(1))
    levels = F.greatest(F.floor(F.log2(least.cast("double")) + 1e-12).cast("int"), F.lit(1))
    at = scenes.withColumn("levels", levels).select("*", F.explode(F.sequence(F.lit(0), F.col("levels") - 1)).alias("level"))
    shrunk = lambda n: F.greatest(F.floor(F.col(n) / F.pow(F.lit(2.0), F.col("levels") - 1 - F.col("level"))), F.lit(1)).cast("long").alias(n)
    return at.select("scene_id", "level", shrunk("ni"), shrunk("nj"))


def band_weights(bands: DataFrame) -> DataFrame:
    """(band, bw): weights falling with wavelength, normalised to sum 1. A band dimension."""
    raw = bands.select("band", F.pow(F.col("wavelength_nm") / 1000, F.lit(BAND_SLOPE)).alias("w"))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("w").alias("t")))).select("band", (F.col("w") / F.col("t")).alias("bw"))


def normal_sums(obs: DataFrame, blocks: DataFrame, weights: DataFrame, bands: list[int], models: dict) -> DataFrame:
    """Per block: h00, h01, h11, g0, g1, cost and n of the weighted residuals of obs(block, band, toa, boa, unc).

    blocks carries the models' inputs; they run once a block and band, not once an observation.
    """
    k = coefficients(blocks, bands, models).select(*BLOCK, "band", *[f"{c}{s}" for c in "abc" for s in ("", "_0", "_1")])
    j = obs.join(k.hint("shuffle_hash"), [*BLOCK, "band"]).join(F.broadcast(weights), "band")
    t, a, b, c = (F.col(x) for x in ("toa", "a", "b", "c"))
    r = R.surface_reflectance(t, a, b, c) - F.col("boa")
    d0, d1 = (R.surface_gradient(t, a, b, c, F.col(f"a_{i}"), F.col(f"b_{i}"), F.col(f"c_{i}")) for i in (0, 1))
    w = OBS_WEIGHT * F.col("bw") / (F.col("unc") * F.col("unc"))
    return j.groupBy(*BLOCK).agg(
        F.sum(w * d0 * d0).alias("h00"), F.sum(w * d0 * d1).alias("h01"), F.sum(w * d1 * d1).alias("h11"), F.sum(w * d0 * r).alias("g0"), F.sum(w * d1 * r).alias("g1"),
        (0.5 * F.sum(w * r * r)).alias("cost"), F.count("*").alias("n"))


#: Blocks on a side of a tile, and blocks around it that are solved along with it.
TILE, HALO = 64, 16


def tiled(blocks: DataFrame, tile: int, reach: int) -> DataFrame:
    """blocks with ti, tj: one row for each tile that a block lies in or within reach of."""
    for k, t in (("bi", "ti"), ("bj", "tj")):
        first, last = (F.floor((F.col(k) + d) / tile).cast("int") for d in (-reach, reach))
        blocks = blocks.withColumn(t, F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return blocks


def _edges(present: np.ndarray) -> list[tuple[np.ndarray, tuple, tuple]]:
    """For rows and columns of grids (tile, r, c): which neighbours both exist, and the slices of the first and the second of them."""
    out = []
    for axis in (-2, -1):
        lead, lag = [slice(None)] * 2, [slice(None)] * 2
        lead[axis], lag[axis] = slice(None, -1), slice(1, None)
        lead, lag = (..., *lead), (..., *lag)
        out.append((present[lead] & present[lag], lead, lag))
    return out


def _laplacian(v: np.ndarray, edges: list) -> np.ndarray:
    """Four-neighbour Laplacian over the edges that exist."""
    out = np.zeros_like(v)
    for both, lead, lag in edges:
        d = np.where(both, v[lag] - v[lead], 0.0)
        out[lead] -= d
        out[lag] += d
    return out


class _Model:
    """Quadratic models g d + d H d / 2 of tiles (2, tile, r, c), where H is a 2 x 2 matrix a block, the prior's pull and the smoothness."""

    def __init__(self, g: np.ndarray, h00: np.ndarray, h01: np.ndarray, h11: np.ndarray, pull: np.ndarray, here: np.ndarray, gamma: float):
        self.parts, self.gamma = (g, h00, h01, h11, pull, here), gamma
        self.g, self.edges = g, _edges(here)
        self.h = np.stack([h00, h11]) + pull
        self.cross = h01
        self.m = self.h + 8 * gamma**2 + 1e-12

    def take(self, k: np.ndarray) -> _Model:
        """The models of some tiles."""
        return _Model(*[v[..., k, :, :] for v in self.parts], self.gamma)

    def apply(self, d: np.ndarray) -> np.ndarray:
        return self.h * d + self.cross * d[::-1] + self.gamma**2 * _laplacian(d, self.edges)

    def solved(self, d: np.ndarray, loose: np.ndarray) -> np.ndarray:
        """d with its loose values at the minimum of the model, the others as they are. A tile that has arrived leaves the iteration."""
        model, d, at = self, d.copy(), np.arange(d.shape[1])
        dot = lambda u, v: (u * v).sum((0, 2, 3))
        x, r = d, -(self.g + self.apply(d)) * loose
        z = r / self.m
        p, rz = z.copy(), dot(r, z)
        for _ in range(400):
            on = rz >= 1e-16
            if not on.all():
                d[:, at] = x
                k = np.flatnonzero(on)
                if not len(k):
                    return d
                model, at, rz = model.take(k), at[k], rz[k]
                x, r, z, p, loose = (v[:, k] for v in (x, r, z, p, loose))
            q = model.apply(p) * loose
            alpha = (rz / np.maximum(dot(p, q), 1e-300))[:, None, None]
            x = x + alpha * p
            r = r - alpha * q
            z = r / model.m
            fresh = dot(r, z)
            p, rz = z + (fresh / rz)[:, None, None] * p, fresh
        d[:, at] = x
        return d


def _tile_steps(pdf: pd.DataFrame, tile: int, reach: int, gamma: float) -> pd.DataFrame:
    """The blocks of some tiles with their Gauss-Newton step (d_aot, d_tcwv) and, in part, the share of each in the scene's cost.

    The step solves a tile and the blocks within reach of it together by preconditioned conjugate gradients; blocks
    farther off keep still. Their values count in the gradient, so the fixed point of the rounds is the scene's own minimum.
    Tiles go through the iterations side by side, each with its own steps and end; cells that a grid lacks are not there for it.
    """
    ti, tj, bi, bj = (pdf[k].to_numpy() for k in ("ti", "tj", "bi", "bj"))
    t = pdf.groupby(["scene_id", "ti", "tj"], sort=False, dropna=False).ngroup().to_numpy()
    own = (bi // tile == ti) & (bj // tile == tj)
    row, col = bi - (ti * tile - reach - 1), bj - (tj * tile - reach - 1)
    row, col = (v - pd.Series(v).groupby(t).transform("min").to_numpy() for v in (row, col))
    at, shape = (t, row, col), (t.max() + 1, row.max() + 1, col.max() + 1)

    def grid(name: str, fill: float = 0.0) -> np.ndarray:
        g = np.full(shape, fill)
        g[at] = pdf[name].fillna(fill)
        return g

    here, free = (np.zeros(shape, bool) for _ in range(2))
    here[at] = True
    free[at] = (bi >= ti * tile - reach) & (bi < (ti + 1) * tile + reach) & (bj >= tj * tile - reach) & (bj < (tj + 1) * tile + reach)
    edges = _edges(here)
    seen = grid("n") > 1
    x = np.stack([grid("aot", 0.1), grid("tcwv", 1.0)])
    prior = np.stack([grid("aot_prior", 0.1), grid("tcwv_prior", 1.0)])
    pull = np.stack([seen / grid(u, 1.0) ** 2 for u in ("aot_unc", "tcwv_unc")])
    h00, h01, h11 = (grid(n) * seen for n in ("h00", "h01", "h11"))
    g = np.stack([grid("g0") * seen, grid("g1") * seen]) + pull * (x - prior) + gamma**2 * _laplacian(x, edges)
    part = grid("cost") * seen + 0.5 * (pull * (x - prior) ** 2).sum(0)
    for both, lead, lag in edges:  # an edge counts where it begins
        part[lead] += 0.5 * gamma**2 * np.where(both, ((x[lag] - x[lead]) ** 2).sum(0), 0.0)

    # The step is the model's minimum within BOUNDS: what would leave them is held at its bound while the rest is solved again, and let go
    # where the model pulls it back inside. Cutting a free step short at the bounds instead may raise the cost.
    low, high = (np.array([b[k] for b in BOUNDS])[:, None, None, None] - x for k in (0, 1))
    step, k = np.zeros_like(g), np.arange(shape[0])
    model, free = _Model(g, h00, h01, h11, pull, here, gamma), np.broadcast_to(free, x.shape)
    loose, d = free.copy(), np.zeros_like(g)
    for _ in range(20):
        d = model.solved(d, loose)
        under, over = loose & (d < low), loose & (d > high)
        d = np.where(under, low, np.where(over, high, d))
        pull_back = model.g + model.apply(d)
        back = free & ~loose & (((d <= low) & (pull_back < -1e-9)) | ((d >= high) & (pull_back > 1e-9)))
        step[:, k] = d
        more = np.flatnonzero((under | over | back).any((0, 2, 3)))
        if not len(more):
            break
        loose = (loose & ~under & ~over) | back
        model, k = model.take(more), k[more]
        d, loose, free, low, high = (v[:, more] for v in (d, loose, free, low, high))
    return pdf.assign(d_aot=step[0][at], d_tcwv=step[1][at], part=part[at])[own]


#: Cells of grids that go through the iterations side by side; a tile's own grid may be larger.
SIDE_BY_SIDE = 16_384


def _batches_of_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole tiles of batches that are sorted by tile: some of about one size at a time, at most SIDE_BY_SIDE cells of the largest of them."""
    keys, rest = ["scene_id", "ti", "tj"], None

    def groups(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        by = pdf.groupby(keys, sort=False, dropna=False)
        t = by.ngroup().to_numpy()
        ends = by.agg(a=("bi", "min"), b=("bi", "max"), c=("bj", "min"), d=("bj", "max")).to_numpy()
        high, wide = ends[:, 1] - ends[:, 0] + 1, ends[:, 3] - ends[:, 2] + 1
        group, n, h, w = np.zeros(len(ends), int), 0, 0, 0
        now = 0
        for k in np.lexsort((wide, high)):
            h, w, n = max(h, high[k]), max(w, wide[k]), n + 1
            if n > 1 and n * h * w > SIDE_BY_SIDE:
                now, h, w, n = now + 1, high[k], wide[k], 1
            group[k] = now
        for k in range(now + 1):
            yield pdf[group[t] == k]

    for pdf in batches:
        if not len(pdf):
            continue
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = rest[keys].iloc[-1]  # its tile may go on in the next batch
        going = ((rest[keys] == last) | (rest[keys].isna() & last.isna())).all(axis=1).to_numpy()
        if not going.all():
            yield from groups(rest[~going])
            rest = rest[going]
    if rest is not None:
        yield from groups(rest)


def _moved(steps: DataFrame, costs: DataFrame) -> DataFrame:
    """Blocks after a round. Where the scene's cost rose, half of the last step is taken back; else the new step is taken, clipped to BOUNDS."""
    j = steps.join(costs.hint("merge"), "scene_id")
    rose = F.col("now") > F.col("last_cost") * (1 + 1e-9)
    out = j.withColumns({f"_{k}": F.greatest(F.lit(low), F.least(F.lit(high), F.col(k) + F.when(rose, -0.5 * F.col(f"step_{k}")).otherwise(F.col(f"d_{k}")))) for k, (low, high) in zip(("aot", "tcwv"), BOUNDS, strict=True)})
    # A step taken back is no sign of having arrived.
    out = out.withColumn("_move", F.when(rose, F.lit(1.0)).otherwise(F.greatest(*[F.abs(F.col(f"_{k}") - F.col(k)) for k in ("aot", "tcwv")])))
    out = out.withColumns({f"step_{k}": F.when(rose, 0.5 * F.col(f"step_{k}")).otherwise(F.col(f"_{k}") - F.col(k)) for k in ("aot", "tcwv")})
    return out.withColumns({"aot": F.col("_aot"), "tcwv": F.col("_tcwv"), "last_cost": F.when(rose, F.col("last_cost")).otherwise(F.col("now"))})


#: Rows of blocks without smoothness that go through the rounds side by side, and the most observations that one of these blocks may have.
AT_ONCE, ALONE = 65_536, 100_000


def _starts(rows: pa.Table, *names: str) -> np.ndarray:
    """Where runs of rows begin that are equal in the named columns; a null equals nothing."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in names:
        v = rows.column(k).combine_chunks()
        new[1:] |= pc.fill_null(pc.not_equal(v[1:], v[:-1]), True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _whole_blocks(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[pa.Table]:
    """Whole runs of one key of batches that are sorted by it, some `least` rows at a time. Of a run with more than `most`
    observations some are left out, but more than `most` remain, and its blocks' own rows."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n < least:
            continue
        rows = pa.Table.from_batches(held)
        last = int(_starts(rows, "key")[-1])  # this run may go on in the next batch
        if last:
            yield rows.slice(0, last)
        rest = rows.slice(last)
        if len(rest) > least:
            own = pc.is_valid(rest.column("own"))
            rest = pa.concat_tables([rest.filter(own), rest.filter(pc.invert(own)).slice(0, most + 1)])
        held, n = rest.to_batches(), len(rest)
    if n:
        yield pa.Table.from_batches(held)


def _bounded_steps(g: np.ndarray, h00: np.ndarray, h01: np.ndarray, h11: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima d (2, block) of g d + d H d / 2 between low and high: the free one, else the best on the four sides."""
    with np.errstate(divide="ignore", invalid="ignore"):
        det = h00 * h11 - h01 * h01
        free = np.stack([h01 * g[1] - h11 * g[0], h01 * g[0] - h00 * g[1]]) / det
        flat = ~(det > 1e-14 * h00 * h11)  # one direction at most is known: the shortest of the steps that are as good
        free = np.where(flat, np.where(h00 + h11 > 0, -g / (h00 + h11), 0.0), free)
        sides = []
        for k, own, other in ((0, h00, h11), (1, h11, h00)):
            for at in (low[k], high[k]):
                across = -(g[1 - k] + h01 * at) / other
                across = np.clip(np.where(other > 0, across, 0.0), low[1 - k], high[1 - k])
                sides.append(np.stack([at, across] if k == 0 else [across, at]))
    sides = np.stack(sides)
    p, q = sides[:, 0], sides[:, 1]
    best = np.argmin(p * g[0] + q * g[1] + (h00 * p * p + 2 * h01 * p * q + h11 * q * q) / 2, axis=0)
    inside = ((free >= low) & (free <= high)).all(0)
    return np.where(inside, free, sides[best, :, np.arange(len(best))].T)


#: What a block itself brings to its rounds.
OWN = (*INPUTS, "aot_prior", "tcwv_prior", "aot_unc", "tcwv_unc")


def _rounds_of_blocks(own: np.ndarray, n: np.ndarray, block: np.ndarray, seen: dict[str, np.ndarray], names: list[int], models: dict, rounds: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(aot, tcwv) of the blocks of own after the rounds, and how far the last round moved each.

    own has a row of OWN for each, n its number of observations. seen holds these: band, toa, boa, weight w, and w_r, the weight of the residual;
    block is the place of their block.
    Every block has its own steps and leaves the rounds when its step falls below tol.
    """
    names = sorted(names)
    # Runs of one block and band, which share the models' coefficients.
    run = block * len(names) + np.searchsorted(names, seen["band"])
    order = np.argsort(run, kind="stable")
    toa, boa, w, w_r = (seen[k][order] for k in ("toa", "boa", "w", "w_r"))
    run, size = np.unique(run, return_counts=True)
    block, band = np.divmod(run, len(names))

    inputs, x = own[:, : len(INPUTS)], own[:, 3:5].T.copy()
    prior, unc = (np.where(np.isnan(v), fill, v).T for v, fill in ((own[:, 7:9], (0.1, 1.0)), (own[:, 9:], 1.0)))
    pull = (n > 1) / unc**2
    low, high = (np.array([b[k] for b in BOUNDS])[:, None] for k in (0, 1))
    step, last, moved = np.zeros_like(x), np.full(x.shape[1], np.inf), np.full(x.shape[1], np.nan)
    live, on = np.arange(x.shape[1]), np.isfinite(x).all(0)
    for _ in range(rounds):
        if not on.all():  # the others leave
            kept = on[block]
            toa, boa, w, w_r = (v[np.repeat(kept, size)] for v in (toa, boa, w, w_r))
            block, band, size, live = (np.cumsum(on) - 1)[block[kept]], band[kept], size[kept], live[on]
        if not len(live):
            break
        now, off, p, many = x[:, live], x[:, live] - prior[:, live], pull[:, live], n[live] > 1
        at = inputs[live]
        at[:, 3:5] = now.T
        terms = np.empty((9, len(names), len(live)))
        for j, coef in enumerate("abc"):
            for i, name in enumerate(names):
                y, slopes = forward(at, models[name, coef], True)
                terms[3 * j, i], terms[3 * j + 1, i], terms[3 * j + 2, i] = y[:, 0], slopes[:, 3], slopes[:, 4]
        a, a0, a1, b, b0, b1, c, c0, c1 = np.repeat(terms[:, band, block], size, axis=1)
        y = a * toa - b
        z = 1 + c * y
        r = y / z - boa
        z *= z
        y *= y
        d0, d1 = (a0 * toa - b0 - y * c0) / z, (a1 * toa - b1 - y * c1) / z
        w0, w1, wr = w * d0, w * d1, w_r * r
        parts = np.stack([w0 * d0, w0 * d1, w1 * d1, wr * d0, wr * d1, wr * r])
        parts = np.add.reduceat(parts, np.cumsum(size) - size, axis=1) if len(size) else np.zeros((6, 0))
        sums = np.stack([np.bincount(block, v, len(live)) for v in parts])
        h00, h01, h11, g0, g1, cost = np.where(np.isnan(sums), 0.0, sums) * many
        cost = 0.5 * cost + 0.5 * (p * off * off).sum(0)
        free = _bounded_steps(np.stack([g0, g1]) + p * off, h00 + p[0], h01, h11 + p[1], low - now, high - now)
        # Where the block's cost rose, half of the last step is taken back, which is no sign of having arrived.
        rose = cost > last[live] * (1 + 1e-9)
        new = np.clip(now + np.where(rose, -0.5 * step[:, live], free), low, high)
        moved[live] = np.where(rose, 1.0, np.abs(new - now).max(0))
        step[:, live] = np.where(rose, 0.5 * step[:, live], new - now)
        last[live] = np.where(rose, last[live], cost)
        x[:, live] = new
        on = ~(moved[live] < tol)
    return x, moved


def _solved_blocks(rows: pa.Table, names: list[int], models: dict, rounds: int, tol: float, alone: int) -> pa.Table:
    """The blocks of rows after their rounds: BLOCK, aot, tcwv, moved, and large where a block was left as it is for its size.

    Rows are a block's own (own, the values of OWN) and its observations' (band, toa, boa, w), in runs of one key, a hash of the block. Nulls count as in
    Spark's sums: the row counts in n.
    """
    at, runs = _starts(rows, "key", *BLOCK), _starts(rows, "key")
    if len(at) > len(runs):  # blocks that share a key
        rows = rows.take(pc.sort_indices(rows, [(k, "ascending") for k in ("key", *BLOCK)]))
        at = _starts(rows, "key", *BLOCK)
    block = np.repeat(np.arange(len(at)), np.diff(at, append=len(rows)))
    mine = pc.is_valid(rows.column("own")).to_numpy()
    first = np.full(len(at), -1)
    first[block[mine][::-1]] = np.flatnonzero(mine)[::-1]
    n = np.bincount(block[~mine], minlength=len(at))
    here = first >= 0
    large = np.repeat(np.add.reduceat(n, np.searchsorted(at, runs)), np.diff(np.searchsorted(at, runs), append=len(at))) > alone
    place = np.cumsum(here) - 1
    kept = ~mine & (here & ~large)[block]
    seen, valid = {"band": rows.column("band").to_numpy()[kept].astype(int)}, {}
    for k in ("toa", "boa", "w"):
        valid[k] = pc.is_valid(rows.column(k)).to_numpy()[kept]
        seen[k] = np.where(valid[k], rows.column(k).to_numpy()[kept], 0.0)
    seen["w"] = np.where(valid["toa"], seen["w"], 0.0)
    seen["w_r"] = np.where(valid["boa"], seen["w"], 0.0)
    first = pa.array(first[here])
    own = rows.column("own").take(first).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(OWN))
    x, moved = _rounds_of_blocks(own, n[here], place[block[kept]], seen, names, models, rounds, tol)
    out = rows.select([*BLOCK]).take(first)
    for k, v in (("aot", x[0]), ("tcwv", x[1]), ("moved", moved), ("large", large[here])):
        out = out.append_column(k, pa.array(v))
    return out


def _retrieve_alone(obs: DataFrame, first: DataFrame, bands: DataFrame, names: list[int], models: dict, rounds: int, tol: float, at_once: int = AT_ONCE, alone: int = ALONE) -> DataFrame:
    """retrieve() without smoothness: first (the prior with aot and tcwv) after the rounds of every block by itself.

    Observations are sent once, to where their block's own row goes. A task takes whole blocks, at_once rows of them side by side; blocks with
    more than alone observations go through the rounds of coupled ones, over sums. Rows are sorted by a hash of the block, one
    number, which Spark sorts without comparing rows; blocks of one hash are told apart in the task.
    """
    weight = OBS_WEIGHT * F.col("bw") / (F.col("unc") * F.col("unc"))
    first = checkpointed(first, "start")
    seen = obs.dropna(subset=[*BLOCK]).join(F.broadcast(band_weights(bands)), "band").select(*BLOCK, "band", *[x.cast("double").alias(k) for k, x in (("toa", F.col("toa")), ("boa", F.col("boa")), ("w", weight))])
    blocks = first.select(*BLOCK, F.array(*[F.col(k).cast("double") for k in OWN]).alias("own"))
    tasks = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as few bytes here are much work
    rows = seen.unionByName(blocks, allowMissingColumns=True).withColumn("key", F.xxhash64(*BLOCK)).repartition(tasks, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_blocks(batches, at_once, alone):
            yield from _solved_blocks(t, names, models, rounds, tol, alone).to_batches()

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in BLOCK)
    solved = checkpointed(rows.mapInArrow(run, f"{kinds}, aot double, tcwv double, moved double, large boolean"), "blocks")
    large = solved.where("large").select(*BLOCK)
    if large.limit(1).count():
        summed = _retrieve_coupled(*[t.join(large.hint("merge"), [*BLOCK], "left_semi") for t in (obs, first)], bands, names, models, 0.0, rounds, tol, TILE, HALO)
        solved = solved.where("NOT large").drop("large").unionByName(summed.select(*BLOCK, "aot", "tcwv", "moved"))
    moves = checkpointed(solved.groupBy("scene_id").agg(F.max("moved").alias("moved")), "moves")
    found = solved.select(*BLOCK, F.col("aot").alias("_aot"), F.col("tcwv").alias("_tcwv"))
    out = first.join(found.hint("merge"), [*BLOCK], "left").withColumns({k: F.coalesce(f"_{k}", k) for k in ("aot", "tcwv")})  # a block with a null in its key keeps its own
    return out.join(moves.hint("merge"), "scene_id").select(*first.columns, "moved", (F.col("moved") < tol).alias("converged"))


#: Fixed value: the largest number of rounds of a level of the pyramid up to the seventh level, and above.
ROUNDS = (60, 20)


def retrieve(obs: DataFrame, prior: DataFrame, bands: DataFrame, models: dict, gamma: float = 10.0, rounds: int = ROUNDS[0], tol: float = 1e-4, start: DataFrame | None = None,
             tile: int = TILE, halo: int = HALO) -> DataFrame:
    """prior with aot, tcwv, moved and converged for every block of all scenes.

    A scene drops out of the rounds when its largest step falls below tol. One that is still moving after the last
    round comes back with converged false.

    prior(block, cos_sza, cos_vza, cos_raa, ele, tco3, aot_prior, tcwv_prior, aot_unc, tcwv_unc). The prior acts on
    blocks with more than one observation; others follow their neighbours, which are the blocks that exist. start(block, aot, tcwv) is the
    first guess, else the prior is. Tiles of tile x tile blocks are solved with the halo blocks around them.
    Where gamma is 0 there are no tiles: every block has its own rounds, and a scene has arrived when all of its blocks have.
    """
    names = [r["band"] for r in bands.select("band").collect()]  # a band dimension
    first = prior.withColumns({"aot": F.col("aot_prior"), "tcwv": F.col("tcwv_prior")})
    if start is not None:
        guess = start.select(*BLOCK, F.col("aot").alias("_aot"), F.col("tcwv").alias("_tcwv"))
        first = first.join(guess.hint("merge"), [*BLOCK], "left").withColumns({"aot": F.coalesce("_aot", "aot"), "tcwv": F.coalesce("_tcwv", "tcwv")}).drop("_aot", "_tcwv")
    if gamma == 0:
        return _retrieve_alone(obs, first, bands, names, models, rounds, tol)
    return _retrieve_coupled(obs, first, bands, names, models, gamma, rounds, tol, tile, halo)


def _retrieve_coupled(obs: DataFrame, first: DataFrame, bands: DataFrame, names: list[int], models: dict, gamma: float, rounds: int, tol: float, tile: int, halo: int) -> DataFrame:
    """The rounds of retrieve() from first, the prior with aot and tcwv."""
    weights, zero = band_weights(bands), F.lit(0.0)
    state = checkpointed(first.withColumns({"step_aot": zero, "step_tcwv": zero, "last_cost": F.lit(float("inf"))}), "start")
    columns, finished = state.columns, None
    tasks = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as few bytes here are much work
    held = bucketed(obs.select(*BLOCK, "band", "toa", "boa", "unc"), [*BLOCK, "band"], "observations")
    for _ in range(rounds):
        sums = normal_sums(held, state, weights, names, models)
        joined = tiled(state.join(sums.hint("merge"), [*BLOCK], "left"), tile, halo + 1)
        kinds = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in columns)
        keep = [*columns, "d_aot", "d_tcwv", "part"]
        sorted_tiles = joined.repartition(tasks, "scene_id", "ti", "tj").sortWithinPartitions("scene_id", "ti", "tj")
        steps = sorted_tiles.mapInPandas(lambda batches: (_tile_steps(pdf, tile, halo, gamma)[keep] for pdf in _batches_of_tiles(batches)), f"{kinds}, d_aot double, d_tcwv double, part double")
        steps = checkpointed(steps, "steps")
        # One row a scene, written: Spark can then split a large scene's side of the joins.
        costs = checkpointed(steps.groupBy("scene_id").agg(F.sum("part").alias("now")), "costs")
        solved = checkpointed(_moved(steps, costs).select(*columns, "_move"), "blocks")
        moves = checkpointed(solved.groupBy("scene_id").agg(F.max("_move").alias("moved")), "moves")
        discard(steps, costs)
        solved = solved.drop("_move").join(moves.hint("merge"), "scene_id")
        done = solved.where(F.col("moved") < tol)
        finished = done if finished is None else finished.unionByName(done)
        rest = solved.where(F.col("moved") >= tol)
        if not moves.where(F.col("moved") >= tol).limit(1).count():
            break
        state = rest.select(*columns)
    discard(held)
    return finished.unionByName(rest).select(*first.columns, "moved", (F.col("moved") < tol).alias("converged"))


def retrieve_pyramid(obs: DataFrame, prior: DataFrame, bands: DataFrame, models: dict, shape: tuple[int, int], gamma: float = 10.0, tol: float = 1e-4) -> DataFrame:
    """retrieve() on grids of blocks from coarse to fine; each level starts from the one before, carried over by splines.

    shape is the finest grid of blocks. Coarse blocks average the prior of their fine ones and take all their observations.
    """
    start, levels = None, pyramid(*shape)
    for k, level in enumerate(levels):
        at = {b: F.floor(F.col(b) * n / full).cast("int") for b, n, full in zip(("bi", "bj"), level, shape, strict=True)}
        own = prior if level == shape else prior.withColumns(at).groupBy(*BLOCK).agg(*[F.avg(c).alias(c) for c in prior.columns if c not in BLOCK])
        seen = obs if level == shape else obs.withColumns(at)
        # A coarse level is only a first guess: it stops at a hundred times the tolerance.
        solved = retrieve(seen, own, bands, models, gamma, ROUNDS[k > 6], tol if level == levels[-1] else 100 * tol, start)
        if level == levels[-1]:
            return solved
        sides = tuple((n, m) for n, m in zip(level, levels[k + 1], strict=True))
        cells = solved.withColumnsRenamed({"bi": "r", "bj": "c"})
        parts = [spline_regrid(cells.select("scene_id", "r", "c", v), *sides, v).withColumnsRenamed({"r": "bi", "c": "bj"}) for v in ("aot", "tcwv")]
        start = checkpointed(parts[0].join(parts[1].hint("merge"), [*BLOCK]), "first-guess")


def chain_uncertainty(diagonal: np.ndarray, gamma: float) -> np.ndarray:
    """Square roots of the diagonal of (diag + gamma^2 (chain Laplacian + 1))^-1 in linear time.

    Forward and backward pivots of a tridiagonal matrix give its inverse's diagonal.
    """
    n = len(diagonal)
    chain = np.full(n, 2.0)
    chain[0] -= 1
    chain[-1] -= 1
    a, off = diagonal + gamma**2 * (chain + 1), -(gamma**2)
    up, down = a.copy(), a.copy()
    for k in range(1, n):
        up[k] = a[k] - off * off / up[k - 1]
    for k in range(n - 2, -1, -1):
        down[k] = a[k] - off * off / down[k + 1]
    return 1 / np.sqrt(up + down - a)


#: Rows of blocks of one range of a scene's chain.
CHAIN_ROWS = 4


def _pivots(a: np.ndarray, off: float, start: np.ndarray) -> np.ndarray:
    """Pivots of the tridiagonal matrix with diagonal a (chain, kind), entered with the pivot start[0] / start[1] of what comes before."""
    out = np.empty_like(a)
    with np.errstate(divide="ignore"):
        last = np.where(start[1] == 0, np.inf, start[0] / np.where(start[1] == 0, 1.0, start[1]))
    for k in range(len(a)):
        last = out[k] = a[k] - off * off / last
    return out


def _product(a: np.ndarray, off: float) -> np.ndarray:
    """The 2 x 2 matrix (rows, columns, kind) that carries a pivot, as a ratio, across the range: the product of (a, -off^2; 1, 0), scaled."""
    m = np.zeros((2, 2, a.shape[1]))
    m[0, 0] = m[1, 1] = 1.0
    for row in a:
        m = np.stack([row * m[0] - off * off * m[1], m[0]])
        m /= np.abs(m).max((0, 1))
    return m


def posterior(blocks: DataFrame, gamma: float = 10.0, chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """aot_unc and tcwv_unc of blocks(block, info_aot, info_tcwv, aot_prior_unc, tcwv_prior_unc): one chain a scene, row-major.

    Forward and backward pivots of the chain's matrix give the diagonal of its inverse. A pivot follows from the one before by a fraction
    whose coefficients are a 2 x 2 matrix, and such steps compose by matrix products: each range of chain_rows rows gives one
    product, the products of a scene are scanned (one row a range), and each range then runs its own pivots from where the scan enters it.
    """
    off, kinds = -(gamma**2), ("aot", "tcwv")
    ends = checkpointed(blocks.groupBy("scene_id").agg(F.min(F.struct("bi", "bj")).alias("first"), F.max(F.struct("bi", "bj")).alias("last")), "chain-ends")
    weight = lambda u: F.when(F.col(u) > 0, 1 / (F.col(u) * F.col(u))).otherwise(0.0)
    links = sum((F.when(F.struct("bi", "bj") == F.col(e), 0).otherwise(1) for e in ("first", "last")), F.lit(1))
    rows = blocks.join(ends.hint("merge"), "scene_id").select(
        *BLOCK, F.floor(F.col("bi") / chain_rows).cast("int").alias("part"),
        *[(F.coalesce(F.nanvl(f"info_{k}", F.lit(0.0)), F.lit(0.0)) + F.coalesce(weight(f"{k}_prior_unc"), F.lit(0.0)) + gamma**2 * links).alias(k) for k in kinds])
    rows = checkpointed(rows, "chain")
    names = [f"{d}{i}{j}_{k}" for d in ("up", "down") for i in (0, 1) for j in (0, 1) for k in kinds]
    scene = f"scene_id {blocks.schema['scene_id'].dataType.simpleString()}"

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.sort_values(["bi", "bj"])[[*kinds]].to_numpy(float)
        return pd.DataFrame([[pdf["scene_id"].iloc[0], pdf["part"].iloc[0], *_product(a, off).ravel(), *_product(a[::-1], off).ravel()]], columns=["scene_id", "part", *names])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        m = pdf[names].to_numpy().reshape(len(pdf), 2, 2, 2, len(kinds))
        into = np.zeros((len(pdf), 2, 2, len(kinds)))
        for d, order in ((0, range(len(pdf))), (1, range(len(pdf) - 1, -1, -1))):
            at = np.zeros((2, len(kinds)))
            at[0] = 1.0  # no pivot before the first: an infinite one
            for k in order:
                into[k, d] = at
                at = (m[k, d] * at[None]).sum(1)
                at /= np.abs(at).max(0)
        return pd.concat([pdf[["scene_id", "part"]].reset_index(drop=True), pd.DataFrame(into.reshape(len(pdf), -1), columns=entries)], axis=1)

    entries = [f"{d}{i}_{k}" for d in ("up", "down") for i in (0, 1) for k in kinds]
    doubles = lambda c: ", ".join(f"{x} double" for x in c)
    products = checkpointed(rows.groupBy("scene_id", "part").applyInPandas(product, f"{scene}, part int, {doubles(names)}"), "chain-products")
    entered = checkpointed(products.groupBy("scene_id").applyInPandas(scan, f"{scene}, part int, {doubles(entries)}"), "chain-entries")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bi", "bj"])
        a = pdf[[*kinds]].to_numpy(float)
        into = pdf[entries].iloc[0].to_numpy(float).reshape(2, 2, len(kinds))
        u = 1 / np.sqrt(_pivots(a, off, into[0]) + _pivots(a[::-1], off, into[1])[::-1] - a)
        return pdf[[*BLOCK]].assign(aot_unc=u[:, 0], tcwv_unc=u[:, 1])

    named = ", ".join(f"{f} {blocks.schema[f].dataType.simpleString()}" for f in BLOCK)
    return rows.join(entered.hint("merge"), ["scene_id", "part"]).groupBy("scene_id", "part").applyInPandas(run, f"{named}, aot_unc double, tcwv_unc double")


def block_information(obs: DataFrame, blocks: DataFrame, weights: DataFrame, bands: list[int], models: dict) -> DataFrame:
    """Mean information on aot and tcwv per block, zeros left out."""
    k = coefficients(blocks, bands, models).select(*BLOCK, "band", *[f"{c}{s}" for c in "abc" for s in ("", "_0", "_1")])
    j = obs.join(k.hint("merge"), [*BLOCK, "band"]).join(F.broadcast(weights), "band")
    d = [R.surface_gradient(F.col("toa"), F.col("a"), F.col("b"), F.col("c"), F.col(f"a_{i}"), F.col(f"b_{i}"), F.col(f"c_{i}")) for i in (0, 1)]
    info = [F.col("bw") * x * x / (F.col("unc") * F.col("unc")) for x in d]
    return j.groupBy(*BLOCK).agg(F.avg(F.nullif(info[0], F.lit(0.0))).alias("info_aot"), F.avg(F.nullif(info[1], F.lit(0.0))).alias("info_tcwv"))


def correct(px: DataFrame, bands: DataFrame, blocks: DataFrame, models: dict, shape: tuple[int, int], n: tuple[int, int], ozone_weight: float = 0.0) -> DataFrame:
    """boa and boa_unc of every pixel and band: models on blocks, coefficients joined to pixels, closed-form inversion.

    blocks carries the models' inputs and aot_unc, tcwv_unc, tco3_unc. One plan over all scenes and bands.
    """
    names = [r["band"] for r in bands.select("band").collect()]
    renamed = {f"{x}{i}": f"k_{x}{i}" for x in "abc" for i in ("", "_0", "_1", "_2")}  # pixels have a column c of their own
    k = coefficients(blocks, names, models).withColumnsRenamed(renamed).select(*BLOCK, "band", *renamed.values(), "aot_unc", "tcwv_unc", "tco3_unc")
    p = px.join(F.broadcast(bands), "band").withColumns({"toa": R.calibrate(F.col("dn"), F.col("scale"), F.col("off")), "bi": block_index(F.col("r"), shape[0], n[0]), "bj": block_index(F.col("c"), shape[1], n[1])})
    j = p.join(k.hint("merge"), [*BLOCK, "band"])
    t, a, b, c = (F.col(x) for x in ("toa", "k_a", "k_b", "k_c"))
    grads = [R.surface_gradient(t, a, b, c, *[F.col(f"k_{x}_{i}") for x in "abc"]) for i in range(3)]
    unc = R.reflectance_uncertainty(grads, [F.col("aot_unc"), F.col("tcwv_unc"), F.col("tco3_unc")], R.toa_gradient(t, a, b, c), t, ozone_weight=ozone_weight)
    return j.select("scene_id", "band", "r", "c", R.surface_reflectance(t, a, b, c, F.col("dn")).alias("boa"), F.when(F.col("dn") > 0, unc).alias("boa_unc"))


def exact_linear(value: float, slopes: tuple[float, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """A network that is exactly value + slopes . x where x is non-negative; for tests and demonstrations."""
    n = len(slopes)
    s = np.array(slopes, float)
    return [(np.eye(n), np.zeros(n)), (np.eye(n), np.zeros(n)), (s[:, None], np.array([value]))]


def linear_models(bands: list[int]) -> dict:
    """Demonstration models: scattering falls with the band number, vapour absorbs more in later bands."""
    out = {}
    for k, band in enumerate(bands):
        out[band, "a"] = exact_linear(1.1, (0, 0, 0, 0.30 / (1 + k), 0.02 * (1 + k), 0, 0))
        out[band, "b"] = exact_linear(0.01, (0, 0, 0, 0.12 / (1 + k), 0, 0, 0))
        out[band, "c"] = exact_linear(0.05, (0, 0, 0, 0.10 / (1 + k), 0, 0, 0))
    return out


def model_inputs(angles: DataFrame) -> dict[str, Column]:
    """Cosines of a block's geometry as the models expect them; azimuths are subtracted before the cosine."""
    return {"cos_sza": F.cos(F.radians("sza")), "cos_vza": F.cos(F.radians("vza")), "cos_raa": F.cos(F.radians(F.col("vaa") - F.col("saa")))}
