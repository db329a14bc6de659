"""Line dedup: ranges of line hashes, sorted by document and position within them.

Lines become small (hash, document, position) records that are range-partitioned by
(hash, document), so that a hot line spreads over several ranges, and sorted; each
run of equal (hash, document) is read once. The answer is a run-length-coded keep
bitmap for each document, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialize, partitions, strip, table

MIN_CHARS, MIN_DOCS = 40, 5


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, t, dropped array<int>, keep_bitmap array<int>: only documents that lose a line.

    keep_bitmap holds run lengths, kept lines first, then dropped, and so on; what follows
    the last run is kept. A line's key is the stripped, A-Z lower-cased line. Keys of at least
    min_chars found in at least min_docs doc_ids lose all lines outside the largest doc_id.
    t is the hash of the text: rows that share a doc_id count as one document, equal rows have one
    bitmap, and rows of another text their own. Null doc_ids count as one document that is smaller
    than all others. Null and empty texts are one empty line. Empty tables give no rows.
    """
    spark = docs.sparkSession
    key = ascii_lower(strip(F.col("line")))
    lines = (
        docs.select("doc_id", text_hash(F.col("text")).alias("t"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .where(F.octet_length("line") >= min_chars).withColumn("key", key).where(F.length("key") >= min_chars)
        .select("doc_id", "t", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
    )
    # Written once: drawing the range bounds would otherwise split all texts a second time.
    lines = materialize(lines, "line-hashes")
    ranged = lines.repartitionByRange(partitions(spark), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "t", "pos")
    held = ranged.groupBy("h1", "h2", "doc_id").agg(F.collect_set(F.struct("t", "pos")).alias("at"))
    held = materialize(held, "line-holders")
    common = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # Written, so that the join has a plain exchange on either side and Spark can split a hot line's rows.
    common = materialize(common, "common-lines")
    lost = held.join(common.hint("merge"), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return (
        lost.select("doc_id", F.explode("at").alias("x")).groupBy("doc_id", F.col("x.t").alias("t")).agg(F.array_sort(F.collect_set("x.pos")).alias("dropped"))
        .select("doc_id", "t", "dropped", runs_of(F.col("dropped")).alias("keep_bitmap"))
    )


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def runs_of(dropped: Column) -> Column:
    """The keep bitmap, as run lengths, of the sorted distinct positions of dropped lines."""
    first = F.filter(dropped, lambda p, i: (i == 0) | (F.get(dropped, i - 1) != p - 1))
    last = F.filter(dropped, lambda p, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != p + 1))
    return let(first, lambda a: let(last, lambda b: F.flatten(F.transform(a, lambda s, i: F.array(
        s - F.when(i == 0, 0).otherwise(F.get(b, i - 1) + 1), F.get(b, i) - s + 1)))))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The text without the dropped lines; a null bitmap keeps all."""
    def rest(lines: Column) -> Column:
        ends = F.aggregate(bitmap, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        whole = let(ends, lambda e: F.flatten(F.concat(
            F.transform(F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i % 2 == 0) & (i < F.size(e) - 1)),
                        lambda i: F.slice(lines, F.get(e, i) + 1, F.get(e, i + 1) - F.get(e, i))),
            F.array(F.slice(lines, F.element_at(e, -1) + 1, F.greatest(F.size(lines) - F.element_at(e, -1), F.lit(0)))))))
        return F.array_join(whole, "\n")
    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(let(lines_of(text), rest))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns of docs, plus keep_bitmap and n_dropped; text itself is left as it is.

    Columns that are named like a new one are replaced, as are _doc, _t and _n.
    """
    found = keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs)
    found = found.select(F.col("doc_id").alias("_doc"), F.col("t").alias("_t"), "keep_bitmap", F.size("dropped").cast("long").alias("_n"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (text_hash(F.col("text")) == F.col("_t"))
    out = docs.drop("keep_bitmap", "n_dropped", "_doc", "_t", "_n").join(found.hint("merge"), same, "left")
    return out.withColumn("n_dropped", F.coalesce("_n", F.lit(0)).cast("long")).drop("_doc", "_t", "_n")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(docs).select(
        "doc_id", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep_bitmap")), 256).alias("kept_sha256"),
    )


SQL_KEPT = r"""
lines AS (SELECT doc_id, i AS pos, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs}), unnest(range(1, len(l) + 1)) AS t(i)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
flagged AS (SELECT k.*, coalesce(k.doc_id <> c.keeper, false) AS gone FROM keyed k LEFT JOIN common c USING (key)),
deduped AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM flagged GROUP BY 1)"""

SQL = "WITH " + SQL_KEPT.format(docs="documents") + " SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped"
