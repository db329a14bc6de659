"""How far the sources of a language differ in their words: exact divergences over a group-term matrix.

The counts of a language form a matrix of groups (its sources) by kept terms, mostly zeros. It is cut into tiles of
GROUPS groups by some thousand terms; for each pair of tiles a task builds a k^2-tree: a quadrant is
split into k x k as long as it holds a count. Pairs of groups walk down together: where both are all zero they stop, as
each such term has one known value, so that the whole quadrant is priced by its width; leaves that hold a
count are evaluated term by term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

MIN_DOCS = 10
TOP_TERMS = 10
#: Probabilities are whole numbers of this; a count is smoothed by ALPHA.
UNIT, ALPHA = 1_000_000_000, 2
#: Groups of a tile, terms of a tile, terms of a leaf, and k.
GROUPS, TERMS, LEAF, K = 64, 2048, 8, 2
#: Entries that a task counts up before it passes them on.
HELD = 400_000
_TERM = np.arange(256, dtype=np.uint8)
_TERM[65:91] += 32
_TERM[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 32
_TERM = _TERM.tobytes()


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; every byte beyond ASCII belongs to such a character."""
    return text.encode().translate(_TERM).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term binary, n (occurrences), d (documents): counted up in tasks, then once more over all."""

    def flush(held: dict) -> pa.RecordBatch:
        # A term is in both counters of a group, though not at the same place.
        columns = [[pa.repeat(lang, len(c)), pa.repeat(source, len(c)), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64()), pa.array(list(map(d.__getitem__, c)), pa.int64())]
                   for (lang, source), (c, d) in held.items() if c]
        held.clear()
        if not columns:
            return pa.RecordBatch.from_pydict({n: pa.array([], k) for n, k in kinds.items()})
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*columns, strict=True)], names=list(kinds))

    kinds = {"lang": pa.string(), "source": pa.string(), "term": pa.binary(), "n": pa.int64(), "d": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            at: dict = {}
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at.setdefault((lang, source), []).append(terms_of(text))
            for g, found in at.items():
                c, d = held.setdefault(g, (Counter(), Counter()))
                c.update(chain.from_iterable(found))
                d.update(chain.from_iterable(map(set, found)))
            if sum(len(c) for c, _ in held.values()) > HELD:
                yield flush(held)
        if held:
            yield flush(held)

    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.mapInArrow(run, "lang string, source string, term binary, n bigint, d bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + ALPHA) / (total + ALPHA * kept)), exact for counts of any size."""
    whole = lambda c: c.cast("decimal(19,0)")
    top = F.lit(UNIT).cast("decimal(10,0)") * (whole(count) + F.lit(ALPHA).cast("decimal(1,0)"))
    return F.lit(1).cast("long") + F.call_function("div", top, whole(total) + F.lit(ALPHA).cast("decimal(1,0)") * whole(kept))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class QuadTree:
    """The k^2-tree of a sparse matrix of shares: by level, which quadrants hold a count; the leaves' cells."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]):
        self.height = 0
        while K**self.height < max(shape[0], -(-shape[1] // LEAF)):
            self.height += 1
        side = K**self.height
        full = np.zeros((side, side), bool)
        full[rows, columns // LEAF] = True
        self.levels = [full]
        while len(self.levels[0]) > 1:
            half = len(self.levels[0]) // K
            self.levels.insert(0, self.levels[0].reshape(half, K, half, K).any((1, 3)))

    def leaves(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, leaf column) in blocks: leaves that hold a count of row a or row b, for a in first and b in second with a < b, both sorted.

        Quadrants in which neither side holds a count, or that have no such rows, are left at their level.
        """
        stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
        step = np.arange(K)
        while stack:
            level, a, b, c = stack.pop()
            here, width = self.levels[level], K ** (self.height - level)
            live = (here[a, c] | here[b, c]) & (a <= b)
            for side, rows in ((a, first), (b, second)):
                live &= np.searchsorted(rows, side * width) < np.searchsorted(rows, (side + 1) * width)
            a, b, c = a[live], b[live], c[live]
            if not len(a):
                continue
            if level == self.height:
                yield a[a < b], b[a < b], c[a < b]
                continue
            # Deep levels go in slices, so that the frontier stays small.
            for k in range(0, len(a), 1 << 14):
                grown = [np.repeat(x[k : k + (1 << 14)], K**3) * K for x in (a, b, c)]
                n = len(grown[0]) // K**3
                stack.append((level + 1, grown[0] + np.tile(np.repeat(step, K * K), n), grown[1] + np.tile(np.repeat(np.tile(step, K), K), n), grown[2] + np.tile(step, K * K * n)))


def tile_sums(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, value, terms) of the pairs of a tile's groups with another's: the sum over the terms of non-zero leaves, and their number.

    left and right have g, p0 (the share of a term that the group lacks), term, weight (a column order: frequent terms first) and p;
    a row without a term stands for the group itself.
    """
    both = left if same else pd.concat([left, right])
    names, rows = np.unique(both["g"].to_numpy(), return_inverse=True)
    p0 = np.zeros(len(names), np.int64)
    p0[rows] = both["p0"]
    cell = both["term"].notna().to_numpy()
    both, rows = both[cell], rows[cell]
    ranks = both[["weight", "term"]].drop_duplicates().sort_values(["weight", "term"], ascending=[False, True])
    columns = ranks.assign(at=np.arange(len(ranks))).set_index("term")["at"].loc[both["term"]].to_numpy()
    n = len(ranks)
    p = np.repeat(p0[:, None], n, 1)
    p[rows, columns] = both["p"].to_numpy(np.int64)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    tree = QuadTree(rows, columns, p.shape)
    mine = lambda part: np.flatnonzero(np.isin(names, part["g"].to_numpy()))
    value, terms = np.zeros((len(names), len(names)), np.int64), np.zeros((len(names), len(names)), np.int64)
    inside = np.arange(LEAF)
    for a, b, c in tree.leaves(mine(left), mine(left if same else right)):
        at = c[:, None] * LEAF + inside
        ok = at < n
        at = np.minimum(at, n - 1)
        x, y = p[a[:, None], at], p[b[:, None], at]
        f = np.where(ok, (x - y) ** 2 // (x + y), 0)
        np.add.at(value, (a, b), f.sum(1))
        np.add.at(terms, (a, b), ok.sum(1))
    i, j = np.nonzero(terms)
    return names[i], names[j], value[i, j], terms[i, j]


def pair_sums(cells: DataFrame) -> DataFrame:
    """lang, a, b (groups, a < b), value, terms over the non-zero leaves of cells(lang, g, p0, block, term, weight, tile, tiles, p)."""

    def run(key, left, right):
        lang, _, x, y = (k.as_py() for k in key)
        if left.num_rows + right.num_rows == 0:
            return pa.table({"lang": [], "a": [], "b": [], "value": [], "terms": []})
        keep = ["g", "p0", "term", "weight", "p"]
        a, b, v, t = tile_sums(left.select(keep).to_pandas(), right.select(keep).to_pandas(), x == y)
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a.astype(np.int64), "b": b.astype(np.int64), "value": v, "terms": t})

    # A tile meets every tile at or after it; of the two sides the left is the earlier. Tiles of few groups are one.
    first = cells.withColumns({"x": F.col("tile"), "y": F.explode(F.sequence("tile", F.col("tiles") - 1))})
    second = cells.withColumns({"x": F.explode(F.sequence(F.lit(0), "tile")), "y": F.col("tile")}).where("x < y")
    key = ["lang", "block", "x", "y"]
    found = first.groupBy(*key).cogroup(second.groupBy(*key)).applyInArrow(run, "lang string, a bigint, b bigint, value bigint, terms bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))


def diverge(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of docs(text, lang, source).

    Part pair: the other sources of the language, all ranks. Part term: the terms that the source uses more than its language, up to
    top_terms. Nulls are empty strings; a lang or source of its own. Every row of docs is a document, repeated ones too.
    Groups without terms stand in the pairs. Ties go by the item's bytes. Languages without a term in min_docs documents have pairs of
    value 0 and no terms; a language of one source has no pairs. Other columns are not read. An empty table gives no rows.
    """
    counts = materialize(term_counts(docs.select("text", "lang", "source")), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("d").alias("d")).where(F.col("d") >= min_docs).drop("d")
    kept = materialize(kept, "kept-terms")
    langs = materialize(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang")), "languages")
    held = materialize(counts.drop("d").join(kept.hint("merge"), ["lang", "term"]), "kept-counts")
    totals = materialize(held.groupBy("lang", "source").agg(F.sum("n").alias("total")), "totals")
    # One row a group from here on: some dozens to thousands a language.
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(totals.hint("merge"), ["lang", "source"], "left").join(langs.hint("merge"), "lang", "left")
    groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumn("groups", F.count("*").over(Window.partitionBy("lang")))
    zero = F.lit(0).cast("long")
    groups = groups.withColumns({"total": F.coalesce("total", zero), "v": F.coalesce("v", zero)})
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("total"), F.col("v"))))
    groups = materialize(groups, "groups")
    cells = held.join(groups.hint("merge"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    cells = materialize(cells, "cells")
    blocks = F.ceil(F.col("v") / TERMS).cast("long")
    tiled = cells.select(
        "lang", "g", "p0", F.pmod(F.xxhash64("term"), blocks).alias("block"), "term", F.col("n_lang").alias("weight"),
        F.floor(F.col("g") / GROUPS).alias("tile"), F.ceil(F.col("groups") / GROUPS).alias("tiles"), "p")
    # A group has a row of its own in every block, whether or not it has a term there.
    tiles = [F.floor(F.col("g") / GROUPS).alias("tile"), F.ceil(F.col("groups") / GROUPS).alias("tiles")]
    named = groups.where("v > 0").select("lang", "g", "p0", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(None).cast("binary").alias("term"), zero.alias("weight"), *tiles, zero.alias("p"))
    sums = materialize(pair_sums(tiled.unionByName(named)), "pair-sums")
    side = lambda n: groups.select("lang", F.col("g").alias(n), F.col("source").alias(f"{n}_source"), F.col("p0").alias(f"{n}_p0"), F.col("v").alias(f"{n}_v"))
    # The result has a row for each pair of sources of a language, so this join is no larger than it.
    pairs = side("a").join(side("b").hint("merge"), "lang").where("a < b").join(sums.hint("merge"), ["lang", "a", "b"], "left")
    rest = (F.col("a_v") - F.coalesce("terms", zero)) * F.coalesce(gap(F.col("a_p0"), F.col("b_p0")), zero)
    pairs = materialize(pairs.select("lang", "a_source", "b_source", (F.coalesce("value", zero) + rest).alias("value")), "pairs")
    both = pairs.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b_source").alias("source"), F.col("a_source").alias("item"), "value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(by)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    q = share(F.col("n_lang"), F.col("total_lang"), F.col("v"))
    over = cells.withColumn("q", q).where("n > 0 and p > q").select("lang", "source", F.col("term").cast("string").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    # Spark keeps the first ranks of every task before it deals the rows.
    top = over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return ranked.unionByName(top)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diverge(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
g AS (SELECT x.lang, x.source, coalesce(total, 0) AS total, v, total_lang FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN totals USING (lang, source) LEFT JOIN l USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total::HUGEINT + 2 * v) AS p,
    1 + 1000000000::HUGEINT * (n_lang + 2) // (total_lang::HUGEINT + 2 * v) AS q
  FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
