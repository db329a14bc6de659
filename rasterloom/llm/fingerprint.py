"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the set of its paragraphs: its lines, cut further after every sentence. Each digest is added to
one cell of each of three tables; a cell holds a count and the exclusive-or of its digests and of their
check hashes. Subtracting the cells of two versions leaves those of the differing paragraphs,
which peeling recovers: a cell with one digest left gives it away, and taking it out of its
other cells frees more. Where peeling gets stuck, both versions are sketched again GROWTH times
larger; past the last size the digests themselves are compared, so that an answer is never missing.

Sketches hold only their cells in use, sorted. They are built, subtracted and peeled by sorting
(cell, digest) entries and adding up runs, so a text of n paragraphs costs n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import let, materialize, partitions, table

CELLS, GROWTH, LEVELS = 96, 4, 4
ROUNDS = 24
HASHES = 3
#: Lines end paragraphs, and so do sentences; full-width marks need no space after them. A rule on the text alone, so that what two versions share is cut alike in both.
PARAGRAPH_END = r"\n|(?<=[.!?;]) |(?<=[。！？；])"
#: Stands for a null doc_id, before all others.
NO_ID = -(2**63)


def digests(text: Column) -> Column:
    """Digests of the distinct paragraphs; the empty text has one, that of the empty paragraph."""
    return F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END, -1), lambda p: F.xxhash64(p)))


def _entries(d: Column, check: Column, sign: Column, cells: Column) -> Column:
    """What a digest adds to its cells, one in each table."""
    third = (cells / HASHES).cast("int")
    return F.array(*[
        F.struct((F.pmod(F.xxhash64(d, F.lit(t)), third) + t * third).cast("int").alias("c"), sign.alias("n"), d.alias("k"), check.alias("h"))
        for t in range(HASHES)])


def _cells(entries: Column) -> Column:
    """Entries added up by cell; cells that come to nothing are left out."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("h"))

    def summed(run: Column) -> Column:
        total = F.aggregate(run, zero, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h")))
        return let(total, lambda y: F.struct(run[0]["c"].alias("c"), y["n"].alias("n"), y["k"].alias("k"), y["h"].alias("h")))

    def run_sum(s: Column, i: Column, n: Column) -> Column:
        """Most runs have one or two entries, which need no loop."""
        x, y = F.get(s, i), F.get(s, i + 1)
        two = F.struct(x["c"].alias("c"), (x["n"] + y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))
        return F.when(n == 1, x).when(n == 2, two).otherwise(let(F.slice(s, i + 1, n), summed))

    def by_run(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["c"] != F.get(s, i - 1)["c"]))
        sums = let(heads, lambda at: F.transform(at, lambda i, j: run_sum(s, i, F.coalesce(F.get(at, j + 1), F.size(s)) - i)))
        return F.filter(sums, lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["h"] != 0))

    return let(F.sort_array(entries), lambda s: F.when(F.size(s) == 0, s).otherwise(by_run(s)))


def sketch(ds: Column, cells: Column | int = CELLS) -> Column:
    """Cells of the digests, array<struct<c int, n int, k bigint, h int>> by cell."""
    return _cells(F.flatten(F.transform(ds, lambda d: _entries(d, F.hash(d), F.lit(1), F.lit(cells)))))


def subtract(a: Column, b: Column) -> Column:
    less = F.transform(b, lambda x: F.struct(x["c"].alias("c"), (-x["n"]).alias("n"), x["k"].alias("k"), x["h"].alias("h")))
    return _cells(F.concat(a, less))


def peel(difference: Column, cells: Column | int = CELLS) -> Column:
    """Digests recovered from subtracted cells, array<bigint>; null if some stay hidden."""
    start = F.struct(difference.alias("c"), F.array().cast("array<bigint>").alias("out"), F.lit(False).alias("stuck"))

    def step(state: Column, _: Column) -> Column:
        alone = F.filter(state["c"], lambda x: (F.abs(x["n"]) == 1) & (F.hash(x["k"]) == x["h"]))
        found = F.array_distinct(F.transform(alone, lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"), x["h"].alias("h"))))

        def remove(p: Column) -> Column:
            out = F.flatten(F.transform(p, lambda x: _entries(x["k"], x["h"], -x["n"], F.lit(cells))))
            return F.struct(
                F.when(F.size(p) == 0, state["c"]).otherwise(_cells(F.concat(state["c"], out))).alias("c"),
                F.concat(state["out"], F.transform(p, lambda x: x["k"])).alias("out"), (F.size(p) == 0).alias("stuck"))
        return F.when(state["stuck"] | (F.size(state["c"]) == 0), state).otherwise(let(found, remove))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return let(done, lambda s: F.when(F.size(s["c"]) == 0, s["out"]))


def differing(a: Column, b: Column, sketch_a: Column, sketch_b: Column, levels: int = LEVELS) -> Column:
    """How many digests are in exactly one of the digest sets a and b: peeled, in larger sketches where need be, at last compared one by one."""
    first = F.array_size(peel(subtract(sketch_a, sketch_b)))
    larger = F.array(*[F.lit(CELLS * GROWTH**k) for k in range(1, levels)]).cast("array<int>")
    again = F.aggregate(larger, F.lit(None).cast("int"), lambda got, m: F.when(got.isNotNull(), got).otherwise(
        F.array_size(peel(subtract(sketch(a, m), sketch(b, m)), m))))
    return F.coalesce(first, again, F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)))


def likeness(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Shared paragraphs over all paragraphs of both, from the sizes and the recovered difference."""
    total = F.size(a) + F.size(b)
    return let(differing(a, b, sketch_a, sketch_b), lambda d: (total - d) / (total + d)).cast("double")


def fingerprint(cells: Column) -> Column:
    """The cells in use as text: number, count, digest sum and check sum, the sums in hexadecimal."""
    return F.array_join(F.transform(cells, lambda x: F.concat(x["c"].cast("string"), F.lit(":"), x["n"].cast("string"), F.lit("."), F.lower(F.hex(x["k"])), F.lit("."), F.lower(F.hex(x["h"])))), ",")


def following(ids: DataFrame) -> DataFrame:
    """(k, h, for_k, for_h, need): each document as the one that follows (for_k, for_h) in descending order of k.

    After the last comes the first. Only ids(k, h, n_chars) move: ranges of k are written out, each takes its
    own neighbours, and the first rows of the ranges (one for each) link them up. need is a third of n_chars.
    """
    spark = ids.sparkSession
    down = [F.col("k").desc(), F.col("h").asc()]
    ranged = ids.distinct().repartitionByRange(partitions(spark), *down).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    node = F.struct("k", "h")
    own = Window.partitionBy("part").orderBy(*down)
    # One row for each range.
    heads = ranged.groupBy("part").agg(F.max_by(node, F.struct("k", (-F.col("h").cast("decimal(20,0)")).alias("h"))).alias("head"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    ends = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(ends)).alias("after"))
    linked = ranged.withColumn("next", F.lead(node).over(own)).join(heads.hint("merge"), "part")
    linked = linked.select("k", "h", "n_chars", F.coalesce("next", "after").alias("next"))
    return linked.select(F.col("next.k").alias("k"), F.col("next.h").alias("h"), F.col("k").alias("for_k"), F.col("h").alias("for_h"),
                         F.floor(F.col("n_chars") / 3).cast("int").alias("need"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs(doc_id, text).

    Null texts count as empty. The order is by descending doc_id, then by text hash; rows that repeat
    both are one document and get the same answer. A null doc_id comes last. A lone document follows itself.
    Texts of any length are taken whole; neither likeness is ever null. Other columns are not read. An empty
    table gives no rows. A text of one paragraph shares none with its edited version: likeness 0.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # One exchange of the texts by (k, h) serves both joins: they read the same columns of it.
    base = base.select("text", F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.xxhash64("text").alias("h"))
    asked = following(base.select("k", "h", F.length("text").cast("long").alias("n_chars")))
    supply = (
        base.join(asked.hint("merge"), ["k", "h"])
        .select("for_k", "for_h", F.substring("text", F.lit(1), F.col("need")).alias("head"), digests(F.col("text")).alias("next_d"))
        .dropDuplicates(["for_k", "for_h"]).withColumnsRenamed({"for_k": "k", "for_h": "h"})
    )
    both = base.join(supply.hint("merge"), ["k", "h"])
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    rows = both.select(F.nullif("k", F.lit(NO_ID)).alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), digests(F.col("text")).alias("d"), digests(edited).alias("e"), F.col("next_d").alias("x"))
    # Each sketch is a column of its own, so that none is built twice.
    rows = rows.withColumns({"sd": sketch(F.col("d")), "se": sketch(F.col("e")), "sx": sketch(F.col("x"))})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sd")).alias("fingerprint"), fingerprint(F.col("se")).alias("edited_fingerprint"),
        likeness(F.col("d"), F.col("e"), F.col("sd"), F.col("se")).alias("near_edited"),
        likeness(F.col("d"), F.col("x"), F.col("sd"), F.col("sx")).alias("near_next"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
