"""Removal of passages that an earlier document holds, by two-stage suffix sorting.

Texts move in chunks of about CHUNK bytes. Every window of `width` bytes has one anchor,
its least-hashed k-gram, so equal windows meet under equal anchors:

1. chunks send their distinct anchors, once each with a short hash of each of their contexts, to
   shards, which name those that more than one document has, and mark as hot those with more
   distinct contexts than one task should hold;
2. chunks send the distinct contexts of such anchors (the windows that share the anchor) with
   the least document holding each; the windows of hot anchors go one by one, each to the shard
   of its own bytes. A shard builds the suffix array of its distinct contexts in
   two stages: only suffixes smaller than their successors are sorted, scans of the
   first-byte buckets induce the rest. Adjacent common prefixes of at least `width` bytes give
   the groups of equal windows and so the least document of every window. Contexts that are equal
   byte for byte go in once, and an anchor that has no other needs no sorting;
3. chunks apply what comes back: windows whose least document is smaller are removed.

A passage, however common, costs a shard one entry for each chunk, and there are as many shards as
the text needs at SHARD bytes each. 64-bit hashes only bring together what is then compared by
bytes: two texts with one hash cost time, never a wrong removal.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, partitions, table
from .minhash import mix

WIDTH, GRAM = 50, 16
CHUNK = 1 << 20
BLOCK = 1 << 19
SHARD = 32 << 20
#: Distinct 16-bit context hashes of an anchor (about 45,000 contexts) from which its windows go one by one.
HOT_CONTEXTS = 1 << 15
_U = np.uint64
_BYTE = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_CHUNKS = "chunk bigint, bytes bigint, ids binary, sizes binary, rest binary, z binary"


def _pack(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def chunked(docs: DataFrame) -> DataFrame:
    """Rows of docs in chunks: ids, byte sizes, the other columns and the texts, compressed."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(len(others)).to_pylist()]
            begin = total = 0
            for i, t in enumerate([*texts, None]):
                if t is None or total and total + len(t) > CHUNK:
                    if i > begin:
                        sink = pa.BufferOutputStream()
                        rest = batch.slice(begin, i - begin).select(others)
                        with pa.ipc.new_stream(sink, rest.schema) as writer:
                            writer.write_batch(rest)
                        ids = [-(2**63) if x is None else x for x in batch.column(0).slice(begin, i - begin).to_pylist()]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([number], pa.int64()), pa.array([total], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()]),
                            pa.array([np.array([len(x) for x in texts[begin:i]], np.int64).tobytes()]),
                            pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([pa.compress(b"".join(texts[begin:i]), codec="zstd", asbytes=True)]),
                        ], names=["chunk", "bytes", "ids", "sizes", "rest", "z"])
                        number += 1
                    begin, total = i, 0
                total += len(t or b"")

    return docs.select("doc_id", *[c for c in others if c != "doc_id"], "text").mapInArrow(run, _CHUNKS)


class _Powers:
    """Powers of the base of the prefix hash and of its inverse, grown as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            one = np.ones(1, np.uint64)
            cls.up = np.cumprod(np.concatenate((one, np.full(n, _BASE, np.uint64))), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate((one, np.full(n, pow(_BASE, -1, 2**64), np.uint64))), dtype=np.uint64)
        return cls.up, cls.down


class Anchors:
    """The anchors of a chunk: for each, hash of its k-gram and of its context, first and last window, document."""

    def __init__(self, ids: bytes, sizes: bytes, z: bytes, width: int):
        self.width, self.ids, self.sizes = width, np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        n = int(self.sizes.sum())
        self.data = data = np.frombuffer(pa.decompress(z, decompressed_size=n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
        self.begin = np.cumsum(self.sizes) - self.sizes
        windows = n - width + 1
        if windows <= 0:
            self.fp = self.context = np.zeros(0, np.uint64)
            self.first = self.last = self.doc = np.zeros(0, np.int64)
            return
        up, self.down = _Powers.upto(n + 1)
        self.total = total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        least = mix((total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1])
        span, size = width - GRAM + 1, 1
        while size < span:
            step = min(size, span - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        inside = doc[:windows] == doc[width - 1 :]
        turn = np.ones(windows, bool)
        turn[1:] = (least[1:] != least[:-1]) | (doc[1:windows] != doc[: windows - 1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(turn)
        last = np.append(first[1:], windows) - 1
        ok = inside[first]
        self.first, self.last = first[ok], last[ok]
        self.doc = doc[self.first]
        self.fp = least[self.first]
        self.context = self._hash(self.first, self.last) + (self.last - self.first).astype(np.uint64) * _U(0x9E3779B97F4A7C15)

    def _hash(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the bytes that the windows first to last cover."""
        return (self.total[last + self.width] - self.total[first]) * self.down[first]

    def shards(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (anchor, short context hash) by shard, whether several documents here have the anchor, and where each shard ends."""
        short = (mix(self.context) >> _U(48)).astype(np.uint16)
        order = np.lexsort((short, self.fp))
        fp, short = self.fp[order], short[order]
        new = np.ones(len(fp), bool)
        new[1:] = fp[1:] != fp[:-1]
        own, group = self.ids[self.doc[order]] if len(fp) else np.zeros(0, np.int64), np.flatnonzero(new)
        many = np.minimum.reduceat(own, group) < np.maximum.reduceat(own, group) if len(fp) else np.zeros(0, bool)
        many = np.repeat(many, np.diff(np.append(group, len(fp))))
        new[1:] |= short[1:] != short[:-1]
        fp, short, many = fp[new], short[new], many[new]
        shard = (fp % _U(parts)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return fp[order], short[order], many[order], np.searchsorted(shard[order], np.arange(parts + 1))

    def named(self, parts: int, bits: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which anchors the shards named, and which of them are hot."""
        fp, _, _, end = self.shards(parts)
        flags = np.zeros((2, len(fp)), bool)
        for s, b in bits.items():
            n = end[s + 1] - end[s]
            flags[:, end[s] : end[s + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=2 * n).astype(bool).reshape(2, n)
        out = []
        for flag in flags:
            known = np.sort(fp[flag])
            at = np.minimum(np.searchsorted(known, self.fp), max(len(known) - 1, 0))
            out.append(known[at] == self.fp if len(known) else np.zeros(len(self.fp), bool))
        return out[0], out[1]

    def contexts(self, parts: int, bits: dict[int, bytes]) -> Contexts:
        named, hot = self.named(parts, bits)
        at, wide = np.flatnonzero(named & ~hot), np.flatnonzero(hot)
        first, last, doc, fp, context = self.first[at], self.last[at], self.doc[at], self.fp[at], self.context[at]
        if len(wide):
            n = self.last[wide] - self.first[wide] + 1
            each = _ragged(self.first[wide], n)
            own = mix(self._hash(each, each) + _U(1))
            first, last, doc = np.append(first, each), np.append(last, each), np.append(doc, np.repeat(self.doc[wide], n))
            fp, context = np.append(fp, own), np.append(context, own)
        size = last - first + self.width
        _, one, back = np.unique(context, return_index=True, return_inverse=True)
        twin = np.flatnonzero(one[back] != np.arange(len(first)))
        odd = twin[~equal_slices(self.data, first, size, twin, one[back[twin]])]
        back[odd] = len(one) + np.arange(len(odd))  # the hash of another context, but other bytes
        one = np.append(one, odd)
        shard = (fp[one] % _U(parts)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return Contexts(first, last, doc, fp, context, rank[back], one[order], np.searchsorted(shard[order], np.arange(parts + 1)))


class Contexts(NamedTuple):
    """Contexts of a chunk; number: each one's distinct context; one: an instance of each distinct context, by shard; end: of the shards."""

    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    fp: np.ndarray
    context: np.ndarray
    number: np.ndarray
    one: np.ndarray
    end: np.ndarray


def equal_slices(data: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether data[start:start + size] is the same at a and at b; sizes are positive."""
    same = size[a] == size[b]
    at = np.flatnonzero(same)
    for k in range(0, len(at), 1 << 16):
        part = at[k : k + (1 << 16)]
        n = size[a[part]]
        differ = data[_ragged(start[a[part]], n)] != data[_ragged(start[b[part]], n)]
        same[part] = np.add.reduceat(differ, np.cumsum(n) - n, dtype=np.int64) == 0
    return same


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, then start[1], ..."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def two_stage_order(data: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of data (uint8) in the order of their first `depth` bytes.

    A suffix smaller than its successor is sorted directly. Any other follows its successor:
    scanning the sorted buckets of first bytes upwards meets successors in order, and each
    puts its predecessor at the next place of that one's bucket, before what was sorted directly.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    # Within a run of equal bytes the byte after the run decides; the end counts as smallest.
    change = np.flatnonzero(np.append(data[1:] != data[:-1], True))
    run = np.searchsorted(change, np.arange(n))
    after = np.append(data, 0)[change + 1].astype(np.int16)
    after[-1] = -1
    smaller = (data < after[run])
    direct = np.flatnonzero(smaller)
    padded = np.concatenate((data, np.zeros(depth, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    order = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]
    bucket = np.searchsorted(data[order], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[data[-1]].append(np.array([n - 1]))  # the last suffix has no successor: it comes first in its bucket
    out = []
    for c in np.flatnonzero(np.bincount(data, minlength=256)):
        parts = [np.concatenate(induced[c])] if induced[c] else []
        fresh = parts[0] if parts else np.zeros(0, np.int64)
        while len(fresh):  # runs of c
            fresh = fresh[fresh > 0] - 1
            fresh = fresh[(data[fresh] == c) & ~smaller[fresh]]
            if len(fresh):
                parts.append(fresh)
        parts.append(order[bucket[c] : bucket[c + 1]])
        whole = np.concatenate(parts)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[~smaller[before] & (data[before] > c)]
        first = data[before]
        by = np.argsort(first, kind="stable")
        ends = np.flatnonzero(np.diff(first[by], append=-1 if len(by) == 0 else 256 - int(first[by[-1]]) + int(first[by[-1]])))
        lo = 0
        for e in ends:
            induced[first[by[lo]]].append(before[by[lo : e + 1]])
            lo = e + 1
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Length, up to width, of the prefix that each suffix of order shares with the one before it."""
    padded = np.concatenate((data, np.zeros(width, np.uint8)))
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 16):
        b = min(a + (1 << 16), len(order))
        same = view[order[a:b]] == view[order[a - 1 : b - 1]]
        out[a:b] = np.where(same.all(1), width, same.argmin(1))
    return out


def least_holders(texts: np.ndarray, size: np.ndarray, holder: np.ndarray, width: int) -> np.ndarray:
    """For every window of each context (one after another): the least holder of a context that has it."""
    gap = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    data = np.zeros(int((size + 1).sum()), np.uint8)  # 0 parts contexts; UTF-8 has no byte 255, so + 1 fits
    data[_ragged(gap, size)] = texts + 1
    owner = np.repeat(np.arange(len(size)), size + 1)
    windows = size - width + 1
    start = _ragged(gap, windows)
    is_window = np.zeros(len(data), bool)
    is_window[start] = True
    order = two_stage_order(data, width)
    order = order[is_window[order]]
    group = np.flatnonzero(common_prefixes(data, order, width) < width)
    least = np.minimum.reduceat(holder[owner[order]], group)
    at = np.empty(len(data), np.int64)
    at[order] = np.repeat(least, np.diff(np.append(group, len(order))))
    return at[start]


def _marker(hot_contexts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, chunk, anchors) of whole shards -> (chunk, shard, bits: named ones, then hot ones)."""
        chunk, shard, fps, shorts, leads, flags = [], [], [], [], [], []
        for batch in batches:
            chunk += batch.column(1).to_pylist()
            shard += batch.column(0).to_pylist()
            for blob in batch.column(2).to_pylist():
                fp, short, many = _unpack(blob)
                fps.append(fp)
                shorts.append(short)
                leads.append(np.append(True, fp[1:] != fp[:-1]))  # an anchor counts once for each chunk
                flags.append(many)
        if not chunk:
            return
        fp, short, lead, many = (np.concatenate(x) for x in (fps, shorts, leads, flags))
        order = np.lexsort((short, fp))
        turn = np.append(True, fp[order][1:] != fp[order][:-1])
        fresh = turn | np.append(True, short[order][1:] != short[order][:-1])
        group = np.cumsum(turn) - 1
        # an anchor that two chunks have, or one chunk in several documents, is named in all of them
        holders = np.bincount(group, weights=lead[order]) + np.bincount(group, weights=(lead & many)[order])
        named, hot = np.empty(len(fp), bool), np.empty(len(fp), bool)
        named[order] = (holders > 1)[group]
        hot[order] = ((holders > 1) & (np.bincount(group, weights=fresh) >= hot_contexts))[group]
        ends = np.cumsum([len(x) for x in fps])
        bits = [np.packbits(np.concatenate((named[e - len(x) : e], hot[e - len(x) : e]))).tobytes() for e, x in zip(ends, fps, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(shard, pa.int32()), pa.array(bits, pa.binary())], names=["chunk", "shard", "blob"])

    return run


def _sorter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, chunk, contexts) of whole shards -> (chunk, shard, least holders of the windows)."""
        chunk, shard, fps, names, holders, sizes, texts = [], [], [], [], [], [], []
        for batch in batches:
            chunk += batch.column(1).to_pylist()
            shard += batch.column(0).to_pylist()
            for blob in batch.column(2).to_pylist():
                for into, x in zip((fps, names, holders, sizes, texts), _unpack(blob), strict=True):
                    into.append(x)
        if not chunk:
            return
        upto = np.concatenate(([0], np.cumsum([len(x) for x in fps])))
        fp, name, holder, size, text = (np.concatenate(x) for x in (fps, names, holders, sizes, texts))
        size = size.astype(np.int64)
        at = np.cumsum(size) - size
        fps.clear(), names.clear(), holders.clear(), sizes.clear(), texts.clear()
        # Distinct contexts, those of an anchor together.
        order = np.lexsort((name, fp))
        new = np.append(True, (name[order][1:] != name[order][:-1]) | (fp[order][1:] != fp[order][:-1]))
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        one = order[new]
        least = np.minimum.reduceat(holder[order], np.flatnonzero(new))
        twin = np.flatnonzero(one[which] != np.arange(len(which)))
        odd = twin[~equal_slices(text, at, size, twin, one[which[twin]])]
        if len(odd):  # the hashes of another context, but other bytes: each is a context of its own
            least = np.minimum.reduceat(np.where(np.isin(order, odd), np.iinfo(np.int64).max, holder[order]), np.flatnonzero(new))
            which[odd] = len(one) + np.arange(len(odd))
            one, least = np.append(one, odd), np.append(least, holder[odd])
            by = np.argsort(fp[one], kind="stable")
            back = np.empty(len(by), np.int64)
            back[by] = np.arange(len(by))
            one, least, which = one[by], least[by], back[which]
        windows = size[one] - width + 1
        begin = np.concatenate(([0], np.cumsum(windows)))
        result = np.repeat(least, windows)
        # An anchor with one context is settled; the others are sorted in blocks of whole anchors.
        head = np.flatnonzero(np.append(True, fp[one][1:] != fp[one][:-1]))
        count = np.diff(np.append(head, len(one)))
        several = np.flatnonzero(np.repeat(count > 1, count))
        if len(several):
            block = np.cumsum(size[one][several]) // BLOCK
            edge = np.append(True, fp[one][several][1:] != fp[one][several][:-1])
            block = np.repeat(block[edge], np.diff(np.append(np.flatnonzero(edge), len(several))))
            for part in np.split(several, np.flatnonzero(np.diff(block)) + 1):
                src = one[part]
                found = least_holders(text[_ragged(at[src], size[src])], size[src], least[part], width)
                result[_ragged(begin[part], windows[part])] = found
        for k in range(len(chunk)):
            mine = which[upto[k] : upto[k + 1]]
            value = result[_ragged(begin[mine], windows[mine])]
            cut = np.append(True, value[1:] != value[:-1])
            cut[np.concatenate(([0], np.cumsum(windows[mine])))[:-1]] = True
            runs = np.flatnonzero(cut)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk[k]], pa.int64()), pa.array([shard[k]], pa.int32()), pa.array([_pack(np.diff(np.append(runs, len(value))), value[runs])], pa.binary())],
                names=["chunk", "shard", "blob"])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = True, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256; with_text: and text without the removed bytes.

    Null texts count as empty; a null doc_id comes before all others; rows with the same doc_id never
    remove from each other. Columns that are named like a new one are replaced. A cut inside a character
    drops what is left of it from text, while kept_sha256 covers the exact bytes. Every row comes back.
    Of several documents with a passage the one of the smallest doc_id keeps it. A text is handled whole, in a
    chunk of its own if it is long. Empty tables give no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256")
    chunks = materialize(chunked(docs), "chunks")
    size = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(2 * partitions(spark), -(-size // SHARD))  # a task holds a shard whole

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, sizes, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fp, short, many, end = Anchors(ids, sizes, z, width).shards(parts)
                full = [s for s in range(parts) if end[s + 1] > end[s]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()),
                     pa.array([_pack(fp[end[s] : end[s + 1]], short[end[s] : end[s + 1]], many[end[s] : end[s + 1]]) for s in full], pa.binary())], names=["shard", "chunk", "blob"])

    sent = chunks.select("chunk", "ids", "sizes", "z").mapInArrow(anchors, "shard int, chunk bigint, blob binary")
    bits = materialize(sent.repartition(parts, "shard").mapInArrow(_marker(hot_contexts), "chunk bigint, shard int, blob binary"), "anchor-bits")

    def by_chunk(replies: DataFrame, name: str) -> DataFrame:
        return replies.groupBy("chunk").agg(F.collect_list(F.struct("shard", "blob")).alias(name))

    def as_dict(pairs: list[dict]) -> dict[int, bytes]:
        return {p["shard"]: p["blob"] for p in pairs or ()}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, ids, sizes, z, flags = (x[k].as_py() for x in batch.columns)
                a = Anchors(ids, sizes, z, width)
                c = a.contexts(parts, as_dict(flags))
                least = np.full(len(c.one), np.iinfo(np.int64).max)
                np.minimum.at(least, c.number, a.ids[c.doc])
                for s in range(parts):
                    x = c.one[c.end[s] : c.end[s + 1]]
                    if len(x):
                        size = c.last[x] - c.first[x] + width
                        blob = _pack(c.fp[x], c.context[x], least[c.end[s] : c.end[s + 1]], size.astype(np.int32), a.data[_ragged(c.first[x], size)])
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "chunk", "blob"])

    named = chunks.select("chunk", "ids", "sizes", "z").join(by_chunk(bits, "flags").hint("merge"), "chunk")
    sent = named.mapInArrow(contexts, "shard int, chunk bigint, blob binary")
    holders = materialize(sent.repartition(parts, "shard").mapInArrow(_sorter(width), "chunk bigint, shard int, blob binary"), "holders")

    others = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    measures = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text string" * with_text
    schema = T.StructType([*others.fields, *T._parse_datatype_string(measures).fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, ids, sizes, rest, z, flags, found = (x[k].as_py() for x in batch.columns)
                a = Anchors(ids, sizes, z, width)
                c = a.contexts(parts, as_dict(flags))
                windows = c.last[c.one] - c.first[c.one] + 1
                begin = np.concatenate(([0], np.cumsum(windows)))
                least = np.zeros(begin[-1], np.int64)
                for s, blob in as_dict(found).items():
                    runs, value = _unpack(blob)
                    least[begin[c.end[s]] : begin[c.end[s + 1]]] = np.repeat(value, runs.astype(np.int64))
                n = windows[c.number]
                gone = least[_ragged(begin[c.number], n)] < np.repeat(a.ids[c.doc], n)
                start = _ragged(c.first, n)[gone]
                delta = np.bincount(start, minlength=len(a.data) + 1) - np.bincount(start + width, minlength=len(a.data) + 1)
                lost = np.cumsum(delta)[: len(a.data)] > 0
                out = {"n_bytes": a.sizes.tolist(), "n_removed": [], "n_spans": [], "kept_sha256": [], "text": []}
                for b, size in zip(a.begin.tolist(), a.sizes.tolist(), strict=True):
                    off = lost[b : b + size]
                    kept = a.data[b : b + size][~off].tobytes()
                    out["n_removed"].append(int(off.sum()))
                    out["n_spans"].append(int(off[:1].sum() + (off[1:] & ~off[:-1]).sum()))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["text"].append(kept.decode(errors="ignore") if with_text else None)
                if not with_text:
                    del out["text"]
                with pa.ipc.open_stream(rest) as reader:
                    back = reader.read_next_batch()
                columns = [pa.array(v, pa.string() if c in ("kept_sha256", "text") else pa.int64()) for c, v in out.items()]
                yield pa.RecordBatch.from_arrays([*back.columns, *columns], names=[*back.schema.names, *out])

    both = chunks.join(by_chunk(bits, "flags").hint("merge"), "chunk", "left").join(by_chunk(holders, "found").hint("merge"), "chunk", "left")
    return both.select("chunk", "ids", "sizes", "rest", "z", "flags", "found").mapInArrow(apply, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
