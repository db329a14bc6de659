"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, exact rerank.

A coarse quantiser sends each vector to an inverted list, and what is left of it is coded by subspaces. A query
probes every list that can hold a vector within the distance that the threshold allows: the plane half way between two
centres bounds that, so the probes are sufficient, not a fixed number. Look-up tables of the query give its distance
to every code of a probed list; the known error of each code turns that into a lower bound, so that only hopeless
pairs fall out. The others are compared by exact cosine in double precision. Codebooks are fitted on a bounded
sample; they decide how much work there is, never which links are found.

Equal vectors are one node with a multiplicity. Neighbouring lists of a label are dealt into blocks of bounded bytes, of which a large list
has many. Only pairs of blocks with a probe between them meet, each once, in a task that returns one count for each
vector and the smallest vector it is joined to, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table
from .minhash import components

LEAST_COSINE = 0.93
#: The codebooks' sample: this many vectors at most, and this many bytes.
FIT_ROWS, FIT_BYTES = 16_384, 1 << 25
SUBSPACES, CODES = 16, 256
#: Bytes of the vectors of one block of lists, and of the coarse centres.
BLOCK_BYTES, CENTRE_BYTES = 1 << 19, 1 << 20
#: Allowance for rounding in bounds; pairs inside it are compared exactly.
SLACK = 1e-6


def clean(e: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, which rows are usable) of a list array; shorter vectors are padded with zeros."""
    ok = np.asarray(e.is_valid()).copy()
    n, flat = len(e), e.flatten()
    size = np.where(ok, np.asarray(e.value_lengths().fill_null(0)), 0)
    row = np.repeat(np.arange(n), size)
    x = np.zeros((n, width))
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    bad = ~np.isfinite(values)
    ok[row[bad]] = False
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.where(bad, 0.0, values)
    top = np.abs(x).max(1, initial=0.0)
    ok &= top > 0
    x /= np.where(ok, top, 1.0)[:, None]  # so that no square over- or underflows
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(ok, norm, 1.0)[:, None], ok


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x from rows of c."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0.0)


def centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k means of x, started from its first rows; an empty one keeps its place."""
    c = x[: max(k, 1)].copy()
    for _ in range(rounds):
        at = squares(x, c).argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Coarse centres, near ones next to each other, and for what is left, codes of each subspace."""

    def __init__(self, sample: np.ndarray, lists: int):
        width = sample.shape[1]
        c = centres(sample, min(lists, max(len(sample) // 16, 1)))
        self.coarse = c[np.argsort(c @ np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0])]
        left = sample - self.coarse[squares(sample, self.coarse).argmin(1)]
        self.spans = np.array_split(np.arange(width), min(SUBSPACES, width))
        self.books = [centres(left[:, s], min(CODES, max(len(left) // 8, 1))) for s in self.spans]
        self.between = np.sqrt(squares(self.coarse, self.coarse))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error of the codes, the part of a distance from the codes that no query changes)."""
        own = squares(x, self.coarse).argmin(1)
        centre = self.coarse[own]
        left = x - centre
        codes = np.stack([squares(left[:, s], b).argmin(1) for s, b in zip(self.spans, self.books, strict=True)], 1)
        held = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return own, codes.astype(np.uint8), np.sqrt(((left - held) ** 2).sum(1)), (held * held + 2 * centre * held).sum(1)

    def probes(self, x: np.ndarray, reach: float) -> np.ndarray:
        """Which lists may hold a vector within reach of each row of x.

        Such a vector lies on its list's side of the plane half way between the two centres, so x is no farther than reach from that plane.
        """
        d = squares(x, self.coarse)
        own = d.argmin(1)
        return d - d[np.arange(len(x)), own][:, None] <= 2 * self.between[own] * (reach + SLACK) + SLACK

    def distances(self, x: np.ndarray, cells: np.ndarray, codes: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Squared distances of the rows of x from coded vectors: look-up tables hold what a query and a code have in common."""
        out = squares(x, self.coarse)[:, cells] + part
        for m, (s, b) in enumerate(zip(self.spans, self.books, strict=True)):
            out -= np.take(2 * x[:, s] @ b.T, codes[:, m], axis=1)
        return out


def usable(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id, label, key (128-bit digest of the vector, null where it links with nothing), vec binary (doubles of unit length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(BLOCK_BYTES * 16 // (8 * width), 1)
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                x, ok = clean(batch.column(2), width)
                ok &= np.asarray(batch.column(1).is_valid())
                raw = [(v + 0.0).tobytes() if y else None for v, y in zip(x, ok, strict=True)]  # -0.0 is 0.0
                keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "key", "vec"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", F.col("embedding").cast(T.ArrayType(T.DoubleType())).alias("e")).mapInArrow(run, f"vec_id bigint, label {label}, key binary, vec binary")


def fit(nodes: DataFrame, n: int, width: int, fit_rows: int = FIT_ROWS) -> Quantiser:
    """Codebooks from at most fit_rows vectors (and FIT_BYTES), those of the smallest hashes of their ids; about sqrt(n) lists."""
    rows = max(min(fit_rows, FIT_BYTES // (8 * width)), 1)
    sample = nodes.select(F.xxhash64("id").alias("h"), "vec").orderBy("h").limit(rows).select("vec").toArrow().column(0).to_pylist()
    lists = 1 << int(round(np.log2(max(n, 1)) / 2))
    return Quantiser(np.stack([np.frombuffer(v) for v in sample]), max(min(lists, CENTRE_BYTES // (8 * width)), 1))


def index(nodes: DataFrame, q: Quantiser) -> DataFrame:
    """label, id, m, vec, cell, code binary, err, part of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                own, codes, error, part = q.encode(matrix(batch.column(3), float))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(part)],
                                                 names=["label", "id", "m", "vec", "cell", "code", "err", "part"])

    label = nodes.schema["label"].dataType.simpleString()
    return nodes.select("label", "id", "m", "vec").mapInArrow(run, f"label {label}, id bigint, m bigint, vec binary, cell int, code binary, err double, part double")


def matrix(column, kind) -> np.ndarray:
    """Rows of a binary column of equal lengths."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def dealt(indexed: DataFrame, rows: int) -> DataFrame:
    """indexed with block: the lists of a label in order, cut into runs of about `rows` vectors; a list's vectors are dealt by a hash."""
    sizes = indexed.groupBy("label", "cell").agg(F.count("*").alias("k"))
    # A row for each list of a label, of which there are at most as many as coarse centres.
    before = F.sum("k").over(Window.partitionBy("label").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    sizes = materialize(sizes.select("label", "cell", "k", F.coalesce(before, F.lit(0)).alias("before")), "list-sizes")
    at = F.col("before") + F.pmod(F.xxhash64("id"), F.col("k"))
    return indexed.join(sizes.hint("merge"), ["label", "cell"]).withColumn("block", F.floor(at / rows)).drop("k", "before")


def block_pairs(blocks: DataFrame, q: Quantiser, reach: float) -> DataFrame:
    """label, a, b: pairs of blocks, a <= b, of which one has a query that probes a list of the other."""

    def run(key, block):
        to = np.flatnonzero(q.probes(matrix(block.column("vec"), float), reach).any(0)).astype(np.int32)
        return pa.table({"label": pa.array([key[0].as_py()] * len(to), block.schema.field("label").type), "block": pa.array([key[1].as_py()] * len(to), pa.int64()), "cell": to})

    label = blocks.schema["label"].dataType.simpleString()
    probes = blocks.select("label", "block", "vec").groupBy("label", "block").applyInArrow(run, f"label {label}, block bigint, cell int")
    probes = materialize(probes, "probes")
    holders = materialize(blocks.select("label", "cell", F.col("block").alias("to")).distinct(), "list-blocks")
    both = probes.join(holders.hint("merge"), ["label", "cell"]).select("label", F.least("block", "to").alias("a"), F.greatest("block", "to").alias("b"))
    return both.distinct()


def linked(q: Quantiser, least: float, reach: float, a: dict, b: dict, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts of a, counts of b, labels of a, labels of b) of two blocks: linked vectors, and the smallest id that the links join each to."""
    x, y = a["vec"], b["vec"]
    counts = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    labels = a["id"].copy(), b["id"].copy()
    # A link is within reach in both directions, so it needs a probe in one of them only.
    ok_cells, near_blocks = q.probes(x, reach), []
    bound = (reach + b["err"] + SLACK) ** 2 + SLACK
    for k in range(0, len(x), 128):
        part = x[k : k + 128]
        maybe = q.distances(part, b["cell"], b["code"], b["part"]) <= bound
        maybe &= ok_cells[k : k + 128][:, b["cell"]]
        rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
        if not len(cols):
            continue
        exact = maybe[np.ix_(rows, cols)] & (part[rows] @ y[cols].T >= least) & (a["id"][k + rows][:, None] != b["id"][cols])
        if exact.any():
            counts[0][k + rows] += exact @ b["m"][cols]
            if not same:
                counts[1][cols] += a["m"][k + rows] @ exact
            near_blocks.append((k + rows, cols, exact))
    # Labels fall to the least of their neighbours until none falls.
    big, moved = np.iinfo(np.int64).max, bool(near_blocks)
    while moved:
        before = [v.copy() for v in labels]
        for rows, cols, exact in near_blocks:
            np.minimum.at(labels[0], rows, np.where(exact, labels[1][cols], big).min(1))
            np.minimum.at(labels[1], cols, np.where(exact.T, labels[0][rows], big).min(1))
        moved = any((u != v).any() for u, v in zip(before, labels, strict=True))
    return *counts, *labels


def block_links(blocks: DataFrame, pairs: DataFrame, q: Quantiser, least: float, reach: float) -> DataFrame:
    """id, n (linked vectors), low (the smallest id joined to it) for each pair of blocks; rows without either stay away."""

    def side(t: pa.Table) -> dict:
        number = {c: t.column(c).to_numpy() for c in ("id", "m", "cell", "err", "part")}
        return number | {"vec": matrix(t.column("vec"), float), "code": matrix(t.column("code"), np.uint8)}

    def run(key, left, right):
        same = key[1] == key[2]
        a = side(left)
        b = a if same else side(right)
        na, nb, la, lb = linked(q, least, reach, a, b, same)
        ids = np.concatenate((a["id"], b["id"]))
        n, low = np.concatenate((na, nb)), np.concatenate((la, lb))
        some = (n > 0) | (low < ids)
        return pa.table({"id": ids[some], "n": n[some], "low": low[some]})

    first = blocks.withColumnRenamed("block", "a").join(pairs.hint("merge"), ["label", "a"])
    second = blocks.withColumnRenamed("block", "b").join(pairs.where("a < b").hint("merge"), ["label", "b"])
    first, second = first.toDF(*first.columns), second.toDF(*second.columns)  # names of their own: both come from one table
    return first.groupBy("label", "a", "b").cogroup(second.groupBy("label", "a", "b")).applyInArrow(run, "id bigint, n bigint, low bigint")


def near_embeddings(vectors: DataFrame, least: float = LEAST_COSINE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label); vec_id is an integer.

    Links are pairs of equal label with cosine >= least in double precision; none is lost. A null label, and a vector that is null,
    empty, all zero or holds a null, NaN or infinity, links with nothing (n_links 0, a component of its own). A shorter vector counts
    as padded with zeros. Equal vectors are linked. Rows that repeat a vec_id are one vector where label and vector agree and come back alike; where these differ,
    each row keeps its own links and shares the id's component. A null vec_id links with nothing. least is above 0. Other columns are not read. An empty table gives no rows.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    width = max(width, 1)
    reach = float(np.sqrt(max(2 - 2 * least, 0.0)))
    rows = materialize(usable(vectors, width), "unit-vectors")
    usables = rows.where("key is not null and vec_id is not null")
    nodes = usables.groupBy("label", "key").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("m"), F.any_value("vec").alias("vec"))
    nodes = materialize(nodes, "distinct-vectors")
    n = nodes.count()
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not n:
        return alone
    q = fit(nodes, n, width, fit_rows)
    indexed = materialize(index(nodes, q), "inverted-lists")
    blocks = materialize(dealt(indexed, max(BLOCK_BYTES // (8 * width), 1)), "blocks")
    pairs = materialize(block_pairs(blocks, q, reach), "block-pairs")
    found = materialize(block_links(blocks, pairs, q, least, reach), "block-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    # A vec_id with several vectors is one node of the components; a class of equal vectors hangs on its smallest id.
    same = usables.join(nodes.where("m > 1").select("label", "key", "id").hint("merge"), ["label", "key"]).select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    edges = found.select(F.col("id").alias("a"), F.col("low").alias("b")).unionByName(same).where("a <> b").distinct()
    labels = components(edges)
    own = nodes.select("label", "key", "id", "m").join(counts.hint("merge"), "id", "left")
    own = materialize(own.select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")), "links")
    out = rows.select("vec_id", "label", "key").join(own.hint("merge"), ["label", "key"], "left")
    out = out.join(labels.select(F.col("v").alias("vec_id"), F.col("label").alias("component")).hint("merge"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    links = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id) JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1) USING (vec_id)"""
