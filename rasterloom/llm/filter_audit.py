"""Audit of how filters interact: what each removes, loses and repeats in every order of applying them.

Each document gets one bit a failed filter. Four come from its own text; the fifth, a copy of an
earlier document's text, from an existential self-join: a left-semi join on the hash, the exact text and a
smaller doc_id. The ids that it marks are united with those of the other failures, and the bits of a
document are put together by one aggregation. From the counts of the 32 combinations
every order follows by arithmetic, so no order is ever run on documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

FILTERS = "ABCDE"
#: Limits of A (words), B (percent of distinct words) and C (percent of capitals); characters of D.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MASKS = 1 << len(FILTERS)
COPY = MASKS // 2


def own_bits(text: str) -> int:
    """The bits of A to D that a text fails; all classes are ASCII, so bytes decide and only code points are counted apart."""
    raw = text.encode()
    words = raw.split()
    out = len(words) < MIN_WORDS
    out |= (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
    out |= (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MAX_CAPITALS * len(text)) << 2
    return out | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, h, g (hashes of the text), bits of A to D for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = pa.array([own_bits(t.as_py() or "") for t in batch.column(4)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], bits], names=["doc_id", "part", "h", "g", "bits"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("h"), F.hash(text).alias("g"), F.col("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, h bigint, g int, bits int")


def copies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The keys (doc_id, part, h, g) of documents whose text a smaller doc_id holds.

    Only texts whose hash occurs under two doc_ids move. The right side has one row for each such text, its smallest
    doc_id, so that a hot text is one row that Spark splits its copies around.
    """
    twice = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h")
    twice = materialize(twice, "shared-hashes")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("h"), F.hash(text).alias("g"), text.alias("text"))
    shared = materialize(keyed.join(twice.hint("merge"), "h", "left_semi"), "shared-texts")
    first = materialize(shared.groupBy("h", "text").agg(F.min("doc_id").alias("first")), "first-texts")
    a, b = shared.alias("a"), first.hint("merge").alias("b")
    same = (F.col("a.h") == F.col("b.h")) & (F.col("a.text") == F.col("b.text")) & (F.col("b.first") < F.col("a.doc_id"))
    return a.join(b, same, "left_semi").select("doc_id", "part", "h", "g")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, n (rows), mask: the failed filters of each document, the copies' bit by union and aggregation."""
    rows = materialize(measured(docs), "own-bits")
    marked = rows.withColumn("n", F.lit(1).cast("long")).unionByName(copies(docs, rows).withColumns({"bits": F.lit(COPY), "n": F.lit(0).cast("long")}))
    return marked.groupBy("doc_id", "part", "h", "g").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("mask")).select("doc_id", "part", "n", "mask")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each combination of failures. A doc_id is good or toxic if any of its labels says so."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Written, so that both sides of the join are plain tables.
    marks, found = materialize(marks, "marks"), materialize(failures(docs), "masks")
    joined = found.join(marks.hint("merge"), "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])


ORDERS = ["".join(p) for p in permutations(FILTERS)]


def bit_at(step: Column) -> Column:
    """The bit of the filter at a step of filter_order."""
    return F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(FILTERS) for x in (f, 1 << k)]), F.substr("filter_order", step, F.lit(1)))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for every part (lang, null as ''), order of the five filters and step, zeros included.

    docs(doc_id, text, lang), labels(doc_id, quality, toxic); other columns are not read. Null and empty texts have no words: they fail A
    alone, and are copies of one another. Every row of docs counts; rows that share a doc_id are never copies of each other,
    and a null doc_id is neither a copy nor makes one. Labels of unknown documents count nowhere. An empty table gives no rows.
    """
    counts = combinations(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic"))
    # At most 32 rows a part meet here.
    named = [("n", "n"), ("good", "good"), ("toxic", "toxic")]
    held = counts.groupBy("part").agg(*[F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(MASKS)]).alias(k) for k, c in named])
    rows = held.select("*", F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    earlier = F.aggregate(F.sequence(F.lit(1), "step"), F.lit(0), lambda a, k: a + F.when(k < F.col("step"), bit_at(k)).otherwise(0))
    rows = rows.withColumns({"bit": bit_at(F.col("step")), "before": earlier})
    before, bit = F.col("before"), F.col("bit")

    def total(values: str, when) -> Column:
        """The sum over the combinations m for which when(m) holds."""
        chosen = F.transform(F.col(values), lambda v, m: F.when(when(m), v).otherwise(F.lit(0).cast("long")))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, v: a + v)

    fails, earlier = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~earlier(m)
    # A filter is the first of the k failed ones of a document in one k-th of all orders.
    n_orders = len(ORDERS)
    share = F.transform("n", lambda v, m: F.when(fails(m), v * F.try_divide(F.lit(n_orders), F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & earlier(m)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, v: a + v).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The SQL applies every order, filter by filter, to the documents' failures.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY 1),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(first < doc_id, false)] AS x
  FROM d JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
combos AS (SELECT part, x, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
o AS (SELECT filter_order, step, [instr('ABCDE', substr(filter_order, i, 1)) for i in range(1, step)] AS before, instr('ABCDE', substr(filter_order, step, 1)) AS own
  FROM (VALUES {orders}) v(filter_order), range(1, 6) s(step)),
applied AS (SELECT part, filter_order, step, own, n, good, toxic, x[own] AS fails, len(list_filter(before, lambda b: x[b])) > 0 AS gone, len(list_filter(x, lambda v: v)) = 1 AS alone
  FROM combos, o),
rows AS (SELECT part, filter_order, step, any_value(own) AS own, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed,
    sum(n) FILTER (fails AND gone) AS redundant, sum(n) FILTER (fails AND alone) AS unique_fails, sum(good) FILTER (fails AND NOT gone) AS good_lost,
    sum(toxic) FILTER (fails AND NOT gone) AS toxic_lost FROM applied GROUP BY 1, 2, 3)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM rows""".replace("{orders}", ", ".join(f"('{p}')" for p in ORDERS))
