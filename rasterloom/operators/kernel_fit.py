"""Kernel-model inversion: least squares per pixel, hot-spot search, step-change detection, integrals, tables.

samples(pixel, doy, vza, sza, raa, refl[, band]) in degrees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import angles as A
from rasterloom.storage import checkpointed


def with_kernels(samples: DataFrame, hot_spot=None, li=A.li_sparse, nbar_deg: float = 0.0) -> DataFrame:
    vol, geo = A.kernel_pair(F.col("vza"), F.col("sza"), F.col("raa"), hot_spot, nbar_deg, li)
    return samples.withColumns({"k_vol": vol, "k_geo": geo})


def _cramer(s: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Solution of the 3 x 3 normal equations from their sums; null where singular."""
    a, b, c, d, e, f = s["n"], s["v"], s["g"], s["vv"], s["vg"], s["gg"]
    det = a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c)
    x, y, z = s["r"], s["rv"], s["rg"]
    p0 = x * (d * f - e * e) - b * (y * f - e * z) + c * (y * e - d * z)
    p1 = a * (y * f - e * z) - x * (b * f - e * c) + c * (b * z - y * c)
    p2 = a * (d * z - y * e) - b * (b * z - y * c) + x * (b * e - d * c)
    return tuple(F.try_divide(p, det) for p in (p0, p1, p2))


def fit(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, f_iso, f_vol, f_geo, rmse, n of samples with kernels: six products, three right sides, one pass.

    The squared error follows from the same sums, so no sample is read twice.
    """
    v, g, r = F.col("k_vol"), F.col("k_geo"), F.col("refl")
    sums = samples.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), F.sum(v).alias("v"), F.sum(g).alias("g"), F.sum(v * v).alias("vv"), F.sum(v * g).alias("vg"), F.sum(g * g).alias("gg"),
        F.sum(r).alias("r"), F.sum(r * v).alias("rv"), F.sum(r * g).alias("rg"), F.sum(r * r).alias("rr"))
    return solved_sums(sums, keys)


def solved_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    p0, p1, p2 = _cramer({k: F.col(k) for k in ("n", "v", "g", "vv", "vg", "gg", "r", "rv", "rg")})
    solved = sums.withColumns({"f_iso": p0, "f_vol": p1, "f_geo": p2})
    sse = F.col("rr") - F.col("f_iso") * F.col("r") - F.col("f_vol") * F.col("rv") - F.col("f_geo") * F.col("rg")
    return solved.select(*keys, "f_iso", "f_vol", "f_geo", F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("n")).alias("rmse"), F.col("n").cast("long").alias("n"))


def hot_spot_grid(spark: SparkSession, n: int = 1000, high_deg: float = 10.0) -> DataFrame:
    """Literal widths to try, from 0 (no hot spot) up to but not including high_deg."""
    return spark.range(n).select((F.col("id") * math.radians(high_deg) / n).alias("xi"))


def hot_spot_search(samples: DataFrame, keys: list[str], grid: DataFrame) -> DataFrame:
    """Best width of each key over a literal grid, by rmse of the kernel fit; the first of equals.

    Samples of one key and geometry are summed first: the widths see them once. Widths meet geometries, in the order of their keys, inside
    Arrow batches, which give one row of sums for each key and width: what is shuffled then grows with the keys of a batch, not with its rows.
    """
    widths = np.sort(np.array([r["xi"] for r in grid.select("xi").collect()], float))  # the literal grid
    refl, angles = F.coalesce(F.col("refl").cast("double"), F.lit(float("nan"))), ("vza", "sza", "raa")
    once = samples.groupBy(*keys, *angles).agg(F.count("*").cast("double").alias("_n"), F.sum(refl).alias("_r"), F.sum(refl * refl).alias("_rr"))
    geometry = A.fold(F.radians("vza"), F.radians("sza"), F.radians("raa"))
    geo = A.kernel_pair(F.col("vza"), F.col("sza"), F.col("raa"), None, 0.0, A.li_sparse)[1]
    rows = once.select(*keys, "_n", "_r", "_rr", A.ross(*geometry).alias("_b"), A.phase_angle(*geometry).alias("_x"), geo.alias("_g")).sortWithinPartitions(*keys)
    fixed, tried = ("n", "g", "gg", "r", "rg", "rr"), ("v", "vv", "vg", "rv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.select(keys)
            group = own.to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            head = np.flatnonzero(np.diff(group[order], prepend=-1))
            n, r, rr, b, x, g = (batch.column(c).to_numpy(zero_copy_only=False)[order].astype(float) for c in ("_n", "_r", "_rr", "_b", "_x", "_g"))
            total = lambda v: np.add.reduceat(v, head, axis=0)
            sums = {"n": total(n), "g": total(n * g), "gg": total(n * g * g), "r": total(r), "rg": total(r * g), "rr": total(rr)}
            for k in range(0, len(widths), 100):
                w = widths[k : k + 100]
                with np.errstate(divide="ignore", invalid="ignore"):
                    v = np.where(w > 0, b[:, None] * (1 + 1 / (1 + x[:, None] / w)) - math.pi / 2, b[:, None] - math.pi / 4)
                nv = v * n[:, None]
                parts = {"v": total(nv), "vv": total(nv * v), "vg": total(nv * g[:, None]), "rv": total(v * r[:, None])}
                m = len(head)
                names = own.take(pa.array(np.tile(order[head], len(w))))
                yield pa.RecordBatch.from_arrays(
                    [*names.columns, pa.array(np.repeat(w, m)), *[pa.array(np.tile(sums[c], len(w))) for c in fixed], *[pa.array(parts[c].T.ravel()) for c in tried]],
                    names=[*keys, "xi", *fixed, *tried])

    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    sums = rows.mapInArrow(run, f"{kinds}, xi double, " + ", ".join(f"{c} double" for c in (*fixed, *tried)))
    fits = solved_sums(sums.groupBy(*keys, "xi").agg(*[F.sum(c).alias(c) for c in (*fixed, *tried)]), [*keys, "xi"])
    best = fits.where("f_iso is not null").groupBy(*keys).agg(F.min_by(F.struct("xi", "f_iso", "f_vol", "f_geo", "rmse"), F.struct("rmse", "xi")).alias("b"))
    return best.select(*keys, "b.*")


TERMS = 7


def step_sums(samples: DataFrame, keys: list[str], days: DataFrame) -> DataFrame:
    """Normal sums of the seven-term model (kernels, cubic in time, step after a day) for each candidate day.

    days(keys without band, dos) holds the candidates. Samples are summed once a day; the terms without the step are totals
    of the record, those with it are sums over the days after the candidate, so that no sample is repeated for a candidate.
    """
    t = F.col("doy").cast("double")
    k = [F.lit(1.0), F.col("k_vol"), F.col("k_geo"), t, t * t, t * t * t]
    last = TERMS - 1
    parts = {f"m{i}_{j}": k[i] * k[j] for i in range(last) for j in range(i, last)} | {f"v{i}": k[i] * F.col("refl") for i in range(last)} | {"rr": F.col("refl") * F.col("refl")}
    daily = samples.groupBy(*keys, "doy").agg(*[F.sum(x).alias(c) for c, x in parts.items()], F.count("*").alias("n"))
    own = samples.select(*keys).distinct()
    tried = own.join(days.hint("merge"), [c for c in days.columns if c != "dos"]) if len(days.columns) > 1 else own.crossJoin(F.broadcast(days))
    rows = daily.unionByName(tried.withColumn("doy", F.col("dos")), allowMissingColumns=True).withColumn("_back", -F.col("doy"))
    record = Window.partitionBy(*keys)
    after = record.orderBy("_back").rangeBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(record), F.lit(0.0))
    later = lambda c: F.coalesce(F.sum(c).over(after), F.lit(0.0))
    sums = rows.select(*keys, "dos", *[total(c).alias(c) for c in parts], F.sum("n").over(record).alias("n"),
                       *[later(f"m0_{i}").alias(f"m{i}_{last}") for i in range(last)], later("v0").alias(f"v{last}")).where("dos is not null")
    m = [F.col(f"m{i}_{j}") if i < last else F.col(f"m0_{last}") for i in range(TERMS) for j in range(i, TERMS)]
    return sums.select(*keys, "dos", F.array(*m).alias("m"), F.array(*[F.col(f"v{i}") for i in range(TERMS)]).alias("v"), "rr", "n")


def solve_steps(sums: DataFrame) -> DataFrame:
    """p array of seven, step_unc and rmse for each row of step_sums; null where singular. Batched solves on Arrow."""
    rest = [c for c in sums.columns if c not in ("m", "v", "rr")]
    upper = np.triu_indices(TERMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_rows = b.num_rows
            m = np.zeros((n_rows, TERMS, TERMS))
            flat = b.column(b.schema.get_field_index("m")).flatten().to_numpy().reshape(n_rows, -1)
            m[:, upper[0], upper[1]] = flat
            m[:, upper[1], upper[0]] = flat
            v = b.column(b.schema.get_field_index("v")).flatten().to_numpy().reshape(n_rows, TERMS)
            # Powers of days differ by many orders: scale to unit diagonal first.
            d = 1 / np.sqrt(np.maximum(np.einsum("kii->ki", m), 1e-300))
            scaled = m * d[:, :, None] * d[:, None, :]
            ok = np.linalg.cond(scaled) < 1e13
            scaled[~ok] = np.eye(TERMS)
            inverse = np.linalg.inv(scaled) * d[:, :, None] * d[:, None, :]
            p = np.einsum("kij,kj->ki", inverse, v)
            n = b.column(b.schema.get_field_index("n")).to_numpy()
            sse = b.column(b.schema.get_field_index("rr")).to_numpy() - (p * v).sum(1)
            hide = lambda x: pa.array(np.where(ok, x, np.nan), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(b.schema.get_field_index(c)) for c in rest], pa.array([x.tolist() if o else None for x, o in zip(p, ok, strict=True)], pa.list_(pa.float64())),
                 hide(np.sqrt(np.abs(inverse[:, 6, 6]))), hide(np.sqrt(np.maximum(sse, 0) / n))], names=[*rest, "p", "step_unc", "rmse"])

    kinds = [f"{c} {sums.schema[c].dataType.simpleString()}" for c in rest]
    return sums.mapInArrow(run, ", ".join([*kinds, "p array<double>", "step_unc double", "rmse double"]))


#: Measurement noise of the seven bands, and the spectral model of burnt ground (nm).
BAND_NOISE = (0.004, 0.015, 0.003, 0.004, 0.013, 0.010, 0.006)
BURN_OFFSET, BURN_LIMIT = 400.0, 2000.0


def candidate_days(samples: DataFrame, buffer: int = 30) -> DataFrame:
    """(pixel, dos): observed days at least `buffer` from both ends of the pixel's record."""
    ends = samples.groupBy("pixel").agg(F.min("doy").alias("d0"), F.max("doy").alias("d1"))
    days = samples.select("pixel", F.col("doy").alias("dos")).distinct().join(ends.hint("merge"), "pixel")
    return days.where((F.col("dos") >= F.col("d0") + buffer) & (F.col("dos") <= F.col("d1") - buffer)).select("pixel", "dos")


def burn_fraction(steps: DataFrame, wavelengths: dict[int, float]) -> DataFrame:
    """Spectral mixture of the step: post - pre = a + b l - f pre over the bands, per (pixel, dos).

    steps has one row a (pixel, dos, band) with pre and post; f is the burnt fraction, a0 and a1 the burnt
    spectrum. Sums of products and a 3 x 3 solve as expressions.
    """
    span = BURN_LIMIT - BURN_OFFSET
    shape = {b: (w - BURN_OFFSET) - (w - BURN_OFFSET) ** 2 / (2 * span) for b, w in wavelengths.items()}
    top = max(shape.values())
    lk = F.element_at(F.create_map(*[x for b, v in shape.items() for x in (F.lit(b), F.lit(v / top))]), F.col("band"))
    g, r = F.col("pre"), F.col("post") - F.col("pre")
    s = steps.withColumn("lk", lk).groupBy("pixel", "dos").agg(
        F.count("*").cast("double").alias("n"), F.sum("lk").alias("v"), F.sum(g).alias("g"), F.sum(F.col("lk") * F.col("lk")).alias("vv"), F.sum(F.col("lk") * g).alias("vg"),
        F.sum(g * g).alias("gg"), F.sum(r).alias("r"), F.sum(r * F.col("lk")).alias("rv"), F.sum(r * g).alias("rg"))
    a, b, c = _cramer({k: F.col(k) for k in ("n", "v", "g", "vv", "vg", "gg", "r", "rv", "rg")})
    return s.select("pixel", "dos", (-c).alias("fcc"), F.try_divide(a, -c).alias("a0"), F.try_divide(b, -c).alias("a1"))


def detect_step(samples: DataFrame, wavelengths: dict[int, float], buffer: int = 30) -> DataFrame:
    """Best step day of each pixel: seven-band records by burnt fraction, four-band ones by rmse.

    A candidate counts if the mixture is physical and the near-infrared and short-wave bands drop (seven bands), or if the
    first two bands drop more than one of the others (four bands).
    """
    bands = sorted(wavelengths)
    noise = BAND_NOISE if len(bands) != 4 else tuple(BAND_NOISE[k] for k in (1, 4, 0, 6))
    # Written: both the bands' comparison and the mixture read the solutions.
    solved = checkpointed(solve_steps(step_sums(samples, ["pixel", "band"], candidate_days(samples, buffer))).where("p is not null"), "steps")
    d = F.col("dos").cast("double")
    p = lambda k: F.get("p", F.lit(k))
    at = lambda t: p(0) + t * p(3) + t * t * p(4) + t * t * t * p(5)
    unit = F.element_at(F.create_map(*[x for b, u in zip(bands, noise, strict=True) for x in (F.lit(b), F.lit(u))]), F.col("band"))
    steps = solved.withColumns({"pre": at(d), "post": at(d + 1) + p(6), "step": p(6), "sig": p(6) / (F.col("step_unc") * unit)})
    per = steps.groupBy("pixel", "dos").agg(
        F.sqrt(F.avg(F.col("rmse") * F.col("rmse"))).alias("rmse"), F.count("*").alias("n_bands"),
        *[F.max(F.when(F.col("band") == b, F.col("sig"))).alias(f"s{k}") for k, b in enumerate(bands)],
        *[F.max(F.when(F.col("band") == b, F.col("step"))).alias(f"d{k}") for k, b in enumerate(bands)]).where(F.col("n_bands") == len(bands))
    if len(bands) == 4:
        low = lambda k: (F.col(f"s{k}") > F.col("s0")) & (F.col(f"s{k}") > F.col("s1"))
        good = per.where((F.col("s0") < 0) & (F.col("s1") < 0) & (low(2) | low(3)))
        best = good.groupBy("pixel").agg(F.min_by(F.struct("dos", "rmse"), F.struct("rmse", "dos")).alias("b"))
        return best.select("pixel", "b.*")
    mixed = per.join(burn_fraction(steps, wavelengths).hint("merge"), ["pixel", "dos"])
    ok = (F.col("a0") >= 0) & (F.col("a1") >= 0) & F.col("fcc").between(0, 1) & (F.col("a0") + F.col("a1") <= 1) & (F.col("d1") < 0) & (F.col("d4") < 0)
    best = mixed.where(ok).groupBy("pixel").agg(F.max_by(F.struct("dos", "rmse", "fcc", "a0", "a1"), F.struct("fcc", -F.col("dos"))).alias("b"))
    return best.select("pixel", "b.*")


def kernel_table(spark: SparkSession, zeniths: tuple[float, ...] = (0.0, -30.0, -60.0), low: int = -89, high: int = 89, hot_spot=None) -> DataFrame:
    """Kernels over view zeniths of the principal plane for some sun zeniths."""
    grid = spark.range(low, high + 1).select(F.col("id").cast("double").alias("vza")).select("vza", F.explode(F.array(*map(F.lit, zeniths))).alias("sza"))
    return with_kernels(grid.withColumn("raa", F.lit(0.0)), hot_spot)


def principal_plane(fits: DataFrame, sza: float = -40.0) -> DataFrame:
    """Modelled reflectance of each fit over view zeniths -70..70."""
    curve = fits.select("*", F.explode(F.sequence(F.lit(-70), F.lit(70))).alias("vza")).withColumns({"vza": F.col("vza").cast("double"), "sza": F.lit(sza), "raa": F.lit(0.0)})
    hot = F.col("xi") if "xi" in fits.columns else None
    return with_kernels(curve, hot).withColumn("modelled", F.col("f_iso") + F.col("f_vol") * F.col("k_vol") + F.col("f_geo") * F.col("k_geo")).drop("k_vol", "k_geo", "raa")


def fit_report(samples: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Each sample with its modelled reflectance."""
    joined = samples.join(fits, keys)
    hot = F.col("xi") if "xi" in fits.columns else None
    return with_kernels(joined, hot).withColumn("modelled", F.col("f_iso") + F.col("f_vol") * F.col("k_vol") + F.col("f_geo") * F.col("k_geo"))


def gauss_nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on [-1, 1]."""
    return np.polynomial.legendre.leggauss(n)


def albedo_integrals(spark: SparkSession, step_deg: int = 1, nodes: int = 24, azimuths: int = 48, zeniths: DataFrame | None = None) -> DataFrame:
    """(sza, bsa_vol, bsa_geo): kernels integrated over the view hemisphere for sun zeniths 0..89, or for zeniths(sza), unnormalised.

    Gauss nodes in the cosine of the view zenith, even steps in azimuth: a literal weights table, one job.
    """
    x, w = gauss_nodes(nodes)
    mu = spark.createDataFrame([(float((a + 1) / 2), float(b / 2)) for a, b in zip(x, w, strict=True)], "mu double, wm double")
    phi = spark.range(azimuths).select(((F.col("id") + 0.5) * (2 * math.pi / azimuths)).alias("phi"))
    suns = zeniths if zeniths is not None else spark.range(0, 90, step_deg).select(F.col("id").cast("int").alias("sza"))
    grid = suns.crossJoin(F.broadcast(mu)).crossJoin(F.broadcast(phi))
    v, s, r = F.acos("mu"), F.radians("sza"), F.col("phi")
    weight = F.col("mu") * F.col("wm") * (2 * math.pi / azimuths) / math.pi
    return grid.groupBy("sza").agg(F.sum(weight * A.ross(v, s, r)).alias("bsa_vol"), F.sum(weight * A.li_sparse(v, s, r)).alias("bsa_geo"))


def white_sky(bsa: DataFrame) -> DataFrame:
    """Integrals of the black-sky values over the sun zenith (Simpson's rule needs an even grid; midpoint weights in angle)."""
    s = F.radians("sza")
    w = 2 * F.cos(s) * F.sin(s)
    return bsa.agg((F.sum(w * F.col("bsa_vol")) / F.sum(w)).alias("wsa_vol"), (F.sum(w * F.col("bsa_geo")) / F.sum(w)).alias("wsa_geo"))


def azimuth_mode(angles: DataFrame, bins: int = 1000) -> DataFrame:
    """Start of the fullest of `bins` azimuth classes, per scene and sign."""
    signed = angles.where("vaa <> 0").withColumn("positive", F.col("vaa") > 0)
    # A row a scene and sign, written, so that Spark can split a large scene's side of the join.
    span = checkpointed(signed.groupBy("scene_id", "positive").agg(F.min("vaa").alias("lo"), F.max("vaa").alias("hi")), "azimuth-spans")
    k = F.least(F.floor(F.try_divide((F.col("vaa") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    counted = signed.join(span.hint("merge"), ["scene_id", "positive"]).withColumn("k", F.coalesce(k, F.lit(0))).groupBy("scene_id", "positive", "lo", "hi", "k").agg(F.count("*").alias("n"))
    best = counted.groupBy("scene_id", "positive", "lo", "hi").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("k"))
    return best.select("scene_id", "positive", (F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / bins).alias("mode"))


def straighten(angles: DataFrame) -> DataFrame:
    """View zenith as scaled distance to the line through the nadir pixels; azimuth as the mean of its sign.

    angles(scene_id, r, c, vza, vaa); zeniths under 0.01 are unknown.
    """
    a = angles.withColumn("vza", F.when(F.col("vza") >= 0.01, F.col("vza")))
    # One row a scene in each of these tables; they are written, so that Spark can split a large scene's side of the joins.
    ends = a.groupBy("scene_id").agg(F.min("vza").alias("v0"), F.max("vza").alias("v1"), F.avg(F.when(F.col("vaa") < 0, F.col("vaa"))).alias("left"), F.avg(F.when(F.col("vaa") > 0, F.col("vaa"))).alias("right"))
    ends = checkpointed(ends, "zenith-ends")
    nadir = a.join(ends.select("scene_id", "v0").hint("merge"), "scene_id").where(F.col("vza") == F.col("v0"))
    line = checkpointed(nadir.groupBy("scene_id").agg(F.regr_slope("r", "c").alias("m"), F.regr_intercept("r", "c").alias("q")).join(ends.hint("merge"), "scene_id"), "nadir-lines")
    d = F.abs(F.col("m") * F.col("c") + F.col("q") - F.col("r")) / F.sqrt(1 + F.col("m") * F.col("m"))
    far = a.join(line.hint("merge"), "scene_id").withColumn("d", F.when(F.col("vza").isNotNull(), d))
    span = checkpointed(far.groupBy("scene_id").agg((F.max("d") - F.min("d")).alias("span")), "line-spans")
    out = far.join(span.hint("merge"), "scene_id")
    azimuth = F.when(F.col("vaa") < 0, F.col("left")).when(F.col("vaa") > 0, F.col("right")).otherwise(F.col("vaa"))
    return out.select("scene_id", "r", "c", (F.col("v0") + F.try_divide(F.col("d"), F.col("span")) * (F.col("v1") - F.col("v0"))).alias("vza"), azimuth.alias("vaa"))
