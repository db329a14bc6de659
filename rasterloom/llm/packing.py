"""Best-fit packing of token pieces into sequences by hierarchical residual rounds.

Each partition packs its items best-fit decreasing, emits the bins that are nearly full
and hands the others on as items of the next round, which has fewer partitions, until
one partition is left or a round joins nothing any more. A task holds ITEMS_PER_TASK items
or so, however many there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import blocks, encoder, vocabulary_path
from .common import materialize, table

CAPACITY = 1024
END = 2
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
ITEMS_PER_TASK = 50_000
NEARLY_FULL = 0.995

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_MEMBERS = "array<struct<doc_id:bigint,copy:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: capacity each, the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every whole text of docs(doc_id, text): ids as the tokenizers library gives them, then END.

    Null and empty texts are one piece of END alone. Repeated rows are pieces of their own, as are rows that
    share a doc_id, which is an integer and may be null. Texts of any length are cut whole. Other columns are not read.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                # The special string has an id of its own, between texts that are encoded apart.
                parts = [p for t in texts[a:b] for p in t.split(SPECIAL)]
                n_parts = [t.count(SPECIAL) + 1 for t in texts[a:b]]
                ids, n, _ = enc.encode(parts)
                raw, at, k = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(n))).tolist(), 0
                rows = []
                for key, m in zip(keys[a:b], n_parts, strict=True):
                    between = np.uint32(SPECIAL_ID).tobytes()
                    own = between.join(raw[4 * at[j] : 4 * at[j + 1]] for j in range(k, k + m)) + np.uint32(END).tobytes()
                    k += m
                    rows += [
                        (key, i, s, size, zlib.crc32(own[4 * s : 4 * (s + size)]))
                        for i, (s, size) in enumerate(cut(len(own) // 4, capacity))
                    ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin, by index. Rooms are found by the lowest set bit."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            by_room[left].append(k)
            mask |= 1 << left
    return bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """pieces plus sequence_id and offset.

    Ties and repeated rows are items of their own; no pieces give no rows. Lengths lie
    between 1 and capacity. The rounds end with one partition, or when one of them joins nothing.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    full = pieces.where(F.col("length") >= capacity).select(
        "*", (F.monotonically_increasing_id() + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    member = F.struct("doc_id", F.monotonically_increasing_id().alias("copy"), "piece", "start", "length", "ids_crc32")
    items = pieces.where(F.col("length") < capacity).select(F.col("length").alias("size"), F.array(member).alias("members"))
    left = items.count()
    done = []
    level = 0
    while left:
        parts = max(1, -(-left // items_per_task))

        def run(frames: Iterator[pd.DataFrame], parts=parts) -> Iterator[pd.DataFrame]:
            got = [f for f in frames if len(f)]
            if not got:
                return
            sizes = [int(s) for f in got for s in f["size"]]
            members = [m for f in got for m in f["members"]]
            bins = best_fit(sizes, capacity)
            for k in range(0, len(bins), 5000):
                some = bins[k : k + 5000]
                yield pd.DataFrame({
                    "size": [sum(sizes[i] for i in b) for b in some],
                    "members": [[x for i in b for x in members[i]] for b in some],
                })

        if parts == 1:
            dealt = items.coalesce(1)  # at most items_per_task rows
        else:
            dealt = items.repartition(parts, F.xxhash64(F.lit(level), F.col("members")[0]["doc_id"], F.col("members")[0]["copy"]))
        packed = materialize(dealt.mapInPandas(run, f"size bigint, members {_MEMBERS}"), f"bins-{level}")
        bins = packed.count()
        last = parts == 1 or bins == left
        if last:
            done.append(packed)
            break
        done.append(packed.where(F.col("size") >= NEARLY_FULL * capacity))
        items = packed.where(F.col("size") < NEARLY_FULL * capacity)
        left, level = items.count(), level + 1
    out = full
    for level, bins in enumerate(done):
        numbered = bins.select((F.monotonically_increasing_id() + F.lit(level << 53)).alias("sequence_id"), "members")
        at = F.transform("members", lambda m, i: F.struct(m.alias("m"), F.aggregate(
            F.slice("members", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("offset")))
        rows = numbered.select("sequence_id", F.explode(at).alias("x")).select(
            *[F.col(f"x.m.{c}").alias(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], "sequence_id", F.col("x.offset").alias("offset"))
        out = out.unionByName(rows)
    return out


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents")))
