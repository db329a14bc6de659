"""Near-duplicate documents by one-permutation MinHash with optimal densification.

One hash of each shingle picks its bin and its value; empty bins copy a bin that a
hash of (bin, attempt) points to. Bands of bins give buckets; each bucket proposes a star
from one centre to its members, never all pairs. Proposed links are confirmed on the full
sets of words, not of hashes. Buckets that still span several components are compared in blocks
inside tasks, so that no link inside a bucket is lost; documents with equal words are one node throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .hashing import slice_hashes

BINS, ROWS = 200, 4
BLOCK_CHARS = 1 << 20
_U = np.uint64
_RNG = np.random.default_rng(20)
_BASE = 0x9E3779B97F4A7C15
_BETWEEN = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words than width is one shingle, one without words none."""
    raw = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    start, end = edge[::2], edge[1::2]
    word = mix(slice_hashes(data, start, end))
    text_end = np.cumsum([len(r) + 1 for r in raw])
    upto = np.concatenate(([0], np.searchsorted(start, text_end)))
    joined = np.zeros(max(len(word) - width + 1, 0), np.uint64)
    for k in range(width):
        joined += word[k : k + len(joined)] * _BETWEEN[k]
    joined = mix(joined)
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            short = (word[a:b] * _BETWEEN[: b - a]).sum(dtype=np.uint64) + _U(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return text.encode().translate(_LOWER.tobytes()).split()


def word_set(text: str, width: int) -> set[tuple[bytes, ...]]:
    """The set that shingle_sets gives hashes of."""
    w = words_of(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return set(zip(*[w[k:] for k in range(width)]))


def _first_hits(bins: int) -> np.ndarray:
    """[j, f]: the attempt at which the hash of (j, attempt) first points to bin f."""
    out = np.full((bins, bins), np.iinfo(np.int32).max, np.int32)
    own, attempt = np.arange(bins), 0
    while (out == np.iinfo(np.int32).max).any():
        attempt += 1
        to = (mix(own.astype(np.uint64) * _U(_BASE) + _U(attempt)) % _U(bins)).astype(np.int64)
        out[own, to] = np.minimum(out[own, to], attempt)
    return out


_HITS: dict[int, np.ndarray] = {}


def sketch(s: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Smallest value of each bin of a non-empty sorted set; each empty bin copies the full one that its hashes reach first."""
    if bins not in _HITS:
        _HITS[bins] = _first_hits(bins)
    at = ((s >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    full = at[first]
    out, empty = np.zeros(bins, np.uint64), np.ones(bins, bool)
    out[full], empty[full] = s[first], False
    empty = np.flatnonzero(empty)
    if len(empty):
        out[empty] = s[first[_HITS[bins][np.ix_(empty, full)].argmin(1)]]
    return out


def band_keys(sk: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each band of rows bins; the band's number is part of it."""
    parts = sk[: len(sk) // rows * rows].reshape(-1, rows)
    return mix((parts * _BETWEEN[:rows]).sum(1, dtype=np.uint64) + np.arange(len(parts), dtype=np.uint64) * _U(_BASE))


def sketches(docs: DataFrame, width: int = 5, bins: int = BINS) -> DataFrame:
    """doc_id, h (hash of the text), n, name binary (128-bit cryptographic digest of the words in order), keys array<bigint>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_blocks(texts):
                sets = shingle_sets(texts[a:b], width)
                keys = [band_keys(sketch(s, bins)).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                names = [hashlib.blake2b(b" ".join(words_of(t)), digest_size=16).digest() for t in texts[a:b]]
                upto = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.concatenate(keys))),
                ], names=["doc_id", "h", "n", "name", "keys"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id bigint, h bigint, n bigint, name binary, keys array<bigint>")


def text_blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS together; a longer text is a block of its own."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > BLOCK_CHARS:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _fits(percent: int):
    """Sizes alone allow a link: the smaller set is at least percent of the larger."""
    return 100 * F.least("n", "n_centre") >= percent * F.greatest("n", "n_centre")


def star_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's smallest document."""
    centres = buckets.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("c"), F.count("*").alias("m")).where("m > 1")
    # Written, so that Spark can split a hot bucket's side of the join.
    centres = materialize(centres.select("key", F.col("c.doc_id").alias("centre"), F.col("c.n").alias("n_centre")), "centres")
    found = buckets.join(centres.hint("merge"), "key").where((F.col("doc_id") != F.col("centre")) & _fits(percent))
    return found.select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct()


def residual_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, hashes binary: the set's hashes, to compare documents with many others in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_blocks(texts):
                sets = [s.tobytes() for s in shingle_sets(texts[a:b], width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=["doc_id", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, hashes binary")


def cross_pairs(buckets: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """(a, b) of one bucket that lie in different components and are a link by their hashes.

    Buckets are cut into blocks of about `block` members; each pair of blocks is one row, compared
    inside a task, so neither a group nor its pairs ever meet in one place. Every pair of fitting sizes is compared on its
    whole sets, unless its two components were joined in the same row before: so only links that join components come out.
    """
    named = labels.select(F.col("v").alias("doc_id"), "label")
    marked = buckets.join(named.hint("merge"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    split = marked.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("m > 2 and l0 < l1")
    split = materialize(split.select("key", "m"), "split-buckets")
    rest = materialize(marked.join(split.hint("merge"), "key"), "residual")
    blocks = F.ceil(F.col("m") / block).cast("int")
    rest = rest.join(sets.hint("merge"), "doc_id").withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).cast("int"))
    grouped = rest.groupBy("key", "blocks", "i").agg(F.collect_list(F.struct("doc_id", "n", "label", "hashes")).alias("x"))
    grouped = materialize(grouped, "residual-blocks")
    many = grouped.where("blocks > 1")
    left = many.select("key", "i", F.col("x").alias("y"), F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j")).where("i < j")
    both = left.join(many.select("key", F.col("i").alias("j"), "x").hint("merge"), ["key", "j"]).select("y", "x")
    own = grouped.select("x", F.lit(None).cast(grouped.schema["x"].dataType).alias("y"))

    def side(c: pa.Array, k: int):
        x = c[k].values
        sets = [np.frombuffer(y, np.uint64) for y in x.field("hashes").to_pylist()]
        return x.field("doc_id").to_numpy(), x.field("n").to_numpy(), x.field("label").to_numpy().copy(), sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                d, n, l, s = side(batch.column(0), k)
                within = not batch.column(1)[k].is_valid
                e, m, r, t = (d, n, l, s) if within else side(batch.column(1), k)
                # Hashes of the other side by number, so that one look-up gives what a set has in common with every one of them.
                names, theirs = np.unique(np.concatenate([*t, np.zeros(0, np.uint64)]), return_inverse=True)
                theirs, begin = theirs.astype(np.int32), np.concatenate(([0], np.cumsum([len(y) for y in t])[:-1])).astype(np.int64)
                mark = np.zeros(len(names), bool)
                out = []
                for q in range(len(d)):
                    ok = (l[q] != r) & (100 * np.minimum(n[q], m) >= percent * np.maximum(n[q], m))
                    if within:
                        ok[: q + 1] = False
                    at = np.flatnonzero(ok)
                    if len(at):
                        own = np.minimum(np.searchsorted(names, s[q]), len(names) - 1)
                        own = own[names[own] == s[q]]
                        mark[own] = True
                        common = np.add.reduceat(mark[theirs], begin, dtype=np.int64)[at]
                        mark[own] = False
                        for z in at[100 * common >= percent * (n[q] + m[at] - common)].tolist():
                            if l[q] == r[z]:  # joined by a link of this row meanwhile
                                continue
                            out.append((max(d[q], e[z]), min(d[q], e[z])))
                            old, new = max(l[q], r[z]), min(l[q], r[z])
                            l[l == old] = new
                            r[r == old] = new
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    return own.unionByName(both).mapInArrow(run, "a bigint, b bigint").distinct()


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets meet percent: 100 * common >= percent * union, word by word.

    docs has a row for each doc_id; a centre of many members is one row that Spark splits its
    members around, and its set is built once for a run of rows.
    """
    texts = docs
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    both = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for k in range(len(a)):
                if b[k] != last:
                    last, centre = b[k], word_set(batch.column(3)[k].as_py() or "", width)
                own = word_set(batch.column(2)[k].as_py() or "", width)
                common = len(own & centre)
                keep.append(100 * common >= percent * (len(own) + len(centre) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


#: Bands that are compared in blocks before the others.
FIRST_BANDS = 5
#: Edges that a task joins into stars before the rounds of components.
EDGES_PER_TASK = 200_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that join the same documents: those of a task become stars around the smallest of each of its components.

    Long chains get short, so that the rounds that follow are few. Edges are dealt by both ends, so a task holds EDGES_PER_TASK or so,
    however many there are and however many meet in one document.
    """
    edges = materialize(edges.select("a", "b"), "given-edges")
    parts = -(-edges.count() // EDGES_PER_TASK)
    dealt = edges.coalesce(1) if parts <= 1 else edges.repartition(parts, "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            root.setdefault(x, x)
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        out = [(x, find(x)) for x in list(root) if root[x] != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """v, label: the smallest document reachable from v, for every end of edges(a, b), which differ.

    Labels fall to the least among neighbours, then to the label of that label, until none
    falls; every round is written out. Edges become stars inside tasks first.
    """
    edges = materialize(contracted(edges), "contracted")  # written: both directions must be of the same stars
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b"), F.col("a")))
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), F.col("label").alias("l")).hint("merge"), "u").groupBy("v").agg(F.min("l").alias("l"))
        fallen = labels.join(near.hint("merge"), "v").select("v", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        now = fallen.join(jump.hint("merge"), "label").select("v", "old", F.least("label", "up").alias("label"))
        now = materialize(now, "labels")
        labels = now.select("v", "label")
        if not now.where("old <> label").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text); doc_id is an integer.

    Null, empty and blank texts have no shingles and are linked with nothing. Of rows that repeat a
    doc_id, equal ones come back alike; where their texts differ, the one of the greatest hash stands
    for the document in links. A null doc_id starts no component: it belongs to that of an equal
    text, if any. Ties fall to the smallest doc_id. Texts are taken whole. Other columns are not read. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = materialize(sketches(docs, width), "sketches")
    known = sk.where("n > 0")
    classes = materialize(known.groupBy("name").agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.join(classes.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    reps = reps.groupBy("doc_id").agg(F.max(F.struct("h", "n", "keys")).alias("r")).select("doc_id", "r.n", "r.keys")
    buckets = reps.select("doc_id", "n", F.posexplode("keys").alias("band", "key"))
    sizes = materialize(buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "shared-keys")
    buckets = materialize(buckets.join(sizes.hint("merge"), "key").select("key", "band", "doc_id", "n"), "buckets")
    # From here on only the texts of documents that share a bucket move.
    texts = docs.join(buckets.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    texts = materialize(texts.groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text")), "proposed")
    first = materialize(confirm(materialize(star_pairs(buckets, percent), "stars"), texts, width, percent), "links")
    labels = components(first)
    # The first bands join most of what the stars left apart, so that the others have little to compare.
    sets = materialize(residual_sets(texts, width), "sets")
    for some in (F.col("band") < FIRST_BANDS, F.col("band") >= FIRST_BANDS):
        more = materialize(cross_pairs(buckets.where(some), labels, sets, percent), "crossing")
        second = materialize(confirm(more, texts, width, percent), "more-links")
        stars = labels.where("v <> label").select(F.col("v").alias("a"), F.col("label").alias("b"))
        labels = components(stars.union(second))
    joined = classes.join(labels.select(F.col("v").alias("rep"), "label").hint("merge"), "rep", "left")
    joined = materialize(joined.select("name", F.coalesce("label", "rep").alias("component_id")), "class-labels")
    own = sk.select("doc_id", "n", "name").join(joined.hint("merge"), "name", "left")
    component = F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), "doc_id")
    return own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS t(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c ON c.doc_id = d.doc_id"""
