"""Small ReLU networks over many rows: forward values and input derivatives.

Weights come as a table emulator(sensor, band, coef, layer, w, b): three layers, hidden sizes
of a few dozen, so all models of a sensor are a few hundred rows and travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.trees import Trees, sigmoid, tree_scores
from rasterloom.storage import checkpointed

MAX_MODEL_ROWS = 100_000
INPUTS = ("cos_sza", "cos_vza", "cos_raa", "aot", "tcwv", "tco3", "ele")


def load_models(emulator: DataFrame, sensor: str | None = None) -> dict[tuple[int, str], list[tuple[np.ndarray, np.ndarray]]]:
    """(band, coef) -> [(w, b) of each layer]. Refuses tables beyond MAX_MODEL_ROWS: these are models, not data."""
    rows = emulator if sensor is None else emulator.where(F.col("sensor") == sensor)
    got = rows.select("band", "coef", "layer", "w", "b").limit(MAX_MODEL_ROWS + 1).collect()
    if len(got) > MAX_MODEL_ROWS:
        raise ValueError(f"more than {MAX_MODEL_ROWS} model rows")
    models: dict = {}
    for r in sorted(got, key=lambda r: r["layer"]):
        models.setdefault((r["band"], r["coef"]), []).append((np.array(r["w"], float), np.array(r["b"], float)))
    return models


def forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], jacobian: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Outputs (n x heads) and, on request, the derivative of their sum by each input (n x inputs)."""
    (w1, b1), (w2, b2), (w3, b3) = layers
    a1 = x @ w1 + b1
    a2 = np.maximum(a1, 0) @ w2 + b2
    out = np.maximum(a2, 0) @ w3 + b3
    if not jacobian:
        return out, None
    back = np.broadcast_to(w3.sum(1), a2.shape) * (a2 > 0)
    return out, ((back @ w2.T) * (a1 > 0)) @ w1.T


def evaluate(df: DataFrame, inputs: list[str], layers: list[tuple[np.ndarray, np.ndarray]], output: str = "h") -> DataFrame:
    """df plus output array<double>: one network over whole Arrow batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in inputs])
            y, _ = forward(x, layers)
            at = pa.array(np.arange(len(x) + 1) * y.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, pa.array(y.ravel()))], names=[*b.schema.names, output])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, {output} array<double>")


def coefficients(cells: DataFrame, bands: list[int], models: dict) -> DataFrame:
    """cells x bands with a, b, c and their derivatives by aot, tcwv and tco3 (a_0, a_1, a_2, ...).

    cells carries INPUTS. Rows multiply by the number of bands inside the task, before any shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in INPUTS])
            for band in bands:
                columns, names = list(batch.columns), list(batch.schema.names)
                columns.append(pa.array(np.full(len(x), band, np.int32)))
                names.append("band")
                for coef in "abc":
                    y, j = forward(x, models[band, coef], True)
                    columns += [pa.array(y[:, 0]), *[pa.array(np.ascontiguousarray(j[:, 3 + k])) for k in range(3)]]
                    names += [coef, *[f"{coef}_{k}" for k in range(3)]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields)
    extra = ", ".join(f"{c}{s} double" for c in "abc" for s in ("", "_0", "_1", "_2"))
    return cells.mapInArrow(run, f"{kinds}, band int, {extra}")


def layer(x: Column, w: Column, b: Column, relu: bool = True) -> Column:
    """One layer over array columns: x (n), w (n x m), b (m). The SQL-checkable form."""
    out = F.transform(b, lambda bj, j: bj + F.aggregate(F.zip_with(x, w, lambda xi, wi: xi * F.get(wi, j)), F.lit(0.0), lambda a, v: a + v))
    return F.transform(out, lambda v: F.greatest(v, F.lit(0.0))) if relu else out


def closed_form(n: int, m: int) -> tuple[Column, Column]:
    """Test weights w[i][j] = sin(i + 2 j + 1) / 4, b[j] = cos(j) / 10 as literal arrays."""
    w = F.array(*[F.array(*[F.lit(float(np.sin(i + 2 * j + 1) / 4)) for j in range(m)]) for i in range(n)])
    return w, F.array(*[F.lit(float(np.cos(j) / 10)) for j in range(m)])


def spectral_map(boa: DataFrame, maps: DataFrame) -> DataFrame:
    """Linear mapping of boa(…, band, boa) onto the sensor's band by slope and offset."""
    return boa.join(F.broadcast(maps), "band").withColumn("boa", F.col("slope") * F.col("boa") + F.col("off")).drop("slope", "off")


def tree_predict(df: DataFrame, inputs: list[str], model, output: str, probability: bool = False) -> DataFrame:
    """A model supplied by the user over some columns: trees kept as a table (their score, or with probability its logistic
    function), or a fitted pyspark.ml model (probability of class 1 if it has one)."""
    if isinstance(model, Trees):
        scored = tree_scores(df, inputs, model, output)
        return scored.withColumn(output, sigmoid(F.col(output))) if probability else scored
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assembler = VectorAssembler(inputCols=inputs, outputCol=model.getFeaturesCol(), handleInvalid="keep")
    scored = model.transform(assembler.transform(df))
    value = vector_to_array(F.col("probability"))[1] if "probability" in scored.columns else F.col("prediction")
    return scored.withColumn(output, value).select(*df.columns, output)


def cloud_probability(toa: DataFrame, roles: list[str], model, ratio: int, least: float = 1e-4) -> DataFrame:
    """Mean of the bands on cells `ratio` times larger, then the model; null where a band is invalid.

    Means are taken to nine digits, so that the order of a sum decides no tree's threshold.
    """
    coarse = toa.groupBy("scene_id", "role", F.expr(f"r div {ratio}").alias("r"), F.expr(f"c div {ratio}").alias("c")).agg(F.round(F.avg("toa"), 9).alias("toa"))
    wide = coarse.groupBy("scene_id", "r", "c").agg(*[F.max(F.when(F.col("role") == k, F.col("toa"))).alias(k) for k in roles])
    ok = F.forall(F.array(*roles), lambda x: F.coalesce(x >= least, F.lit(False)))
    scored = tree_predict(wide.fillna(0.0, roles).withColumn("_ok", ok), roles, model, "cloud_prob", True)
    return scored.select("scene_id", "r", "c", F.when(F.col("_ok"), F.col("cloud_prob")).alias("cloud_prob"))


def first_guess_tcwv(df: DataFrame, inputs: list[str], layers, low: float = 0.0, high: float = 8.0) -> DataFrame:
    """Water vapour by network; values out of range take the scene's median."""
    from rasterloom.operators.pixels import replace_by_median

    guess = evaluate(df, inputs, layers).withColumn("tcwv", F.get("h", F.lit(0))).drop("h")
    return replace_by_median(guess, ["scene_id"], "tcwv", (F.col("tcwv") > low) & (F.col("tcwv") < high))


def first_guess_aot(df: DataFrame, inputs: list[str], model, rows: int, cols: int, s: float | None = None) -> DataFrame:
    """exp(-prediction) of a tree regression, trimmed to the scene's 5-95 percentiles, filled from the nearest and smoothed (strength s, or chosen)"""
    from rasterloom.operators.neighborhood import dense, nearest_fill
    from rasterloom.operators.pixels import percentiles
    from rasterloom.operators.spectral import smooth_grids

    guess = tree_predict(df, inputs, model, "_p").withColumn("aot", F.exp(-F.col("_p"))).drop("_p")
    guess = checkpointed(guess, "guess")
    limits = checkpointed(percentiles(guess, ["scene_id"], "aot", (0.05, 0.95)), "limits")
    kept = guess.join(limits.hint("merge"), "scene_id").withColumn("aot", F.when(F.col("aot").between(F.col("p05"), F.col("p95")), F.col("aot")))
    return smooth_grids(nearest_fill(dense(kept, rows, cols, "aot"), "aot"), "aot", ["scene_id"], s)
