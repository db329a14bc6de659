"""Document quality by a regularised quadratic discriminant.

Each class has a mean and a covariance of transformed text statistics. Covariances are
shrunk towards the pooled one and that towards its diagonal; their Cholesky factors are
computed once on the driver (a matrix of a few dozen columns) and cached in the workers.
A score is the logistic of the difference of the classes' log densities.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

CUT = 0.7
FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_sd", "upper", "digit", "symbol", "punctuation", "shout", "space", "distinct_words",
    "top_word", "log_lines", "distinct_lines", "line_length", "entropy", "short_words", "commas", "capital_words", "tail_symbols", "distinct_triples", "url_marks",
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>@^~=+_{}[]\\/"]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?'\"()-"]] = True


def _odds(part: float, whole: float) -> float:
    """A share, at most 1, pulled off 0 and 1 and spread like a normal variable."""
    p = (min(part, whole) + 0.5) / (whole + 1)
    return math.log(p / (1 - p))


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; defined for the empty one too."""
    raw = np.frombuffer(text.encode(), np.uint8)
    count = np.bincount(raw, minlength=256)
    n = len(raw)
    words = text.split()
    k = len(words)
    lengths = np.fromiter(map(len, words), np.float64, k)
    distinct: dict[str, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    shares = count[count > 0] / max(n, 1)
    triples = len(set(zip(words, words[1:], words[2:]))) if k > 2 else 0
    ends = sum(1 for w in words if w[-1] in "#*$%&|<>!")
    return [
        math.log1p(n), math.log1p(k), math.log1p(lengths.mean() if k else 0), math.log1p(lengths.std() if k else 0),
        _odds(count[65:91].sum(), n), _odds(count[48:58].sum(), n), _odds(count[_SYMBOLS].sum(), n), _odds(count[_PUNCTUATION].sum(), n),
        _odds(count[33], n), _odds(count[32], n), _odds(len(distinct), k), _odds(max(distinct.values(), default=0), k),
        math.log1p(len(lines)), _odds(len(set(lines)), len(lines)), math.log1p(n / max(len(lines), 1)),
        float(-(shares * np.log2(shares)).sum()) if n else 0.0, _odds(int((lengths <= 2).sum()), k), _odds(count[44], k),
        _odds(sum(1 for w in words if w[0].isupper()), k), _odds(ends, k), _odds(triples, max(k - 2, 0)), math.log1p(text.count("http") + text.count("www.")),
    ]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, x array<double> of every whole text; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def forward_substitution(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """z with factor @ z = b, for a lower triangular factor: row by row, all columns of b at once."""
    z = np.empty_like(b)
    for i in range(len(factor)):
        z[i] = (b[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class Discriminant:
    """Means, lower Cholesky factors of the shrunk covariances and log weights of both classes."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        log_density = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            z = forward_substitution(factor, (x - mean).T)
            log_density.append(offset - 0.5 * (z * z).sum(0))
        gap = np.clip(log_density[1] - log_density[0], -700, 700)
        return 1 / (1 + np.exp(-gap))


def fit(labelled: DataFrame, to_pooled: float = 0.6, to_diagonal: float = 0.3) -> Discriminant:
    """From labelled(x, label in {0, 1}): counts, sums and products come from one aggregation.

    A class without rows takes the other's moments and half a row's weight; without any labels
    every score is one half.
    """
    d = len(FEATURES)
    rows = labelled.where("label in (0, 1)").select("label", F.posexplode("x").alias("i", "a"), F.col("x").alias("b"))
    sums = [F.sum(F.col("a") * F.get("b", j)).alias(f"p{j}") for j in range(d)]
    got = rows.groupBy("label", "i").agg(F.count("*").alias("n"), F.sum("a").alias("s"), *sums).collect()  # 2 d rows
    n, total, product = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in got:
        n[r["label"]], total[r["label"], r["i"]] = r["n"], r["s"]
        product[r["label"], r["i"]] = [r[f"p{j}"] for j in range(d)]
    if not n.sum():
        return Discriminant([np.zeros(d)] * 2, [np.eye(d)] * 2, [0.0, 0.0])
    means = [total[c] / n[c] if n[c] else total.sum(0) / n.sum() for c in (0, 1)]
    spread = [product[c] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (spread[0] + spread[1]) / n.sum() if n.min() else product.sum(0) / n.sum() - np.outer(means[0], means[0])
    pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d)
    factors, offsets = [], []
    for c in (0, 1):
        # A class of few rows leans more on the pooled covariance.
        own = (1 - to_pooled) * n[c] / (n[c] + d)
        covariance = own * spread[c] / max(n[c], 1) + (1 - own) * pooled
        factor = np.linalg.cholesky((covariance + covariance.T) / 2)
        factors.append(factor)
        offsets.append(math.log(max(n[c], 0.5) / n.sum()) - float(np.log(np.diag(factor)).sum()))
    return Discriminant(means, factors, offsets)


def score(measured: DataFrame, model: Discriminant, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = measured.schema["doc_id"].dataType.simpleString()
    return measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Every row of docs(doc_id, text) scored; labels(doc_id, quality) teach where not held out.

    Null labels and labels of unknown documents teach nothing; of several labels of a document the greatest
    counts. Null and empty texts are scored as texts without words. Repeated rows are scored alike, and each
    teaches once. Texts of any length are measured whole. Other columns are not read. A null doc_id is never
    held out. Empty documents give no rows; without labels every score is one half.
    """
    measured = materialize(measure(docs), "statistics")
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    return score(measured, fit(measured.join(known.hint("merge"), "doc_id")), cut)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
