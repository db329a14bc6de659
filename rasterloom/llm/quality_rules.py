"""Quality rules: line frequency across the documents of a host, plus two rules within a text.

Normalised lines of every length are hashed and counted once for each document of their host
(documents.source). A line in more than MAX_DOCS documents of a host is boilerplate there and
goes from all of them but the first, which keeps it, so that no text is lost altogether. A
document is depleted, and rejected, when fewer than MIN_WORDS words or less than KEEP_PERCENT
of its words are left. The limit is a count, the same for hosts of every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialize, strip, table, words
from .line_dedup import kept_text, runs_of

MIN_WORDS = 50
REPEAT_PERCENT = 50
MAX_DOCS = 10
KEEP_PERCENT = 30
SYMBOLS = "#*$%&|<>"


def _repeat_words(w: Column) -> Column:
    """Words within 3-word windows that occur at least twice in w."""
    n = F.size(w)
    tri = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def marked(t: Column) -> Column:
        runs = F.array_sort(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(runs, lambda s: F.transform(
            F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))),
            lambda x: x["i"]))
        covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), 0).otherwise(covered)

    return F.when(n < 4, 0).otherwise(let(tri, marked)).cast("long")


def base_measures(docs: DataFrame) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. Null texts count as empty.

    The words are bound inside one expression: a filter that Catalyst moves below must not split the text anew for each word.
    """
    text = F.coalesce("text", F.lit(""))
    of_words = let(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n", -1), lambda s: strip(s) != "")
    measured = docs.withColumns({
        "_m": of_words,
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long"),
    })
    measured = measured.withColumns({n: F.col("_m")[n] for n in ("n_words", "word_chars", "n_repeat_words")}).drop("_m")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, t, lost_words, dropped array<int>: what documents lose by lines over the limit.

    t is the hash of the text, so that rows which share a doc_id but not the text stay apart; for the
    count they are one document. Null doc_ids count as one document, after all others. Of the documents
    with a line the one of the smallest doc_id keeps it.
    """
    text = F.coalesce("text", F.lit(""))
    host = F.coalesce("source", F.lit(""))
    lines = (
        docs.select("doc_id", host.alias("host"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .withColumn("line", strip(F.col("line"))).where(F.length("line") > 0).withColumn("key", ascii_lower(F.col("line")))
        # Of each line only its host's name and its own go on, as one hash of 96 bits, and its place and size in one number.
        .select("doc_id", "t", F.xxhash64("host", "key").alias("h1"), F.hash("key", "host").alias("h2"),
                (F.shiftleft(F.col("pos").cast("long"), 32) + F.size(words(F.col("line")))).alias("at"))
    )
    lines = materialize(lines, "host-lines")
    # One row for each document of a line; the two levels keep a hot line from meeting in one task.
    held = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    over = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper")).where(F.col("n") > max_docs)
    # Written, so that Spark can split a hot line's side of the join.
    over = materialize(over.select("h1", "h2", "keeper"), "frequent-lines")
    lost = lines.join(over.hint("merge"), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    places = lost.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("at")).alias("x"))
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit(2**32 - 1)))
    return places.select("doc_id", "t", total.alias("lost_words"), F.transform("x", lambda x: F.shiftright(x, 32).cast("int")).alias("dropped"))


def _with_losses(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs plus _lost and _dropped of frequent_lines, null for documents without a line over the limit.

    The text's hash is a column before the join, so that the text itself moves only where it is wanted afterwards.
    """
    lost = lost.select(F.col("doc_id").alias("_doc"), F.col("t").alias("_t"), F.col("lost_words").alias("_lost"), F.col("dropped").alias("_dropped"))
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_t"))
    return keyed.join(lost.hint("merge"), same, "left").drop("_doc", "_t", "_key")


def depleted(n_words: Column, lost: Column, keep_percent: int) -> Column:
    return (n_words - lost < MIN_WORDS) | (100 * (n_words - lost) < keep_percent * n_words)


def apply_rules(docs: DataFrame, keep_percent: int = KEEP_PERCENT, max_docs: int = MAX_DOCS) -> DataFrame:
    """docs with the base measures, lost_words, base_failed and kept.

    Texts that are null, empty or of fewer than 50 words fail the base rules. Extra columns
    pass through; those named like a measure are replaced, as are _doc, _t, _key, _m, _lost and _dropped.
    Repeated rows are judged alike and count once. A null source is a host of its own name, the empty one.
    Texts and lines of any length count whole. An empty table gives no rows.
    """
    docs = docs.drop("lost_words", "kept", "_doc", "_t", "_key", "_m", "_lost", "_dropped")
    lost = frequent_lines(docs.select("doc_id", "source", "text"), max_docs)
    found = _with_losses(base_measures(docs), lost)
    found = found.withColumn("lost_words", F.coalesce("_lost", F.lit(0)).cast("long")).drop("_lost", "_dropped")
    return found.withColumn("kept", ~(F.col("base_failed") | depleted(F.col("n_words"), F.col("lost_words"), keep_percent)))


def kept_documents(docs: DataFrame, keep_percent: int = KEEP_PERCENT, max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of docs that apply_rules keeps, with the columns of docs and without the lines over the limit in text.

    Only the verdict is evaluated, once.
    """
    columns = docs.columns
    docs = docs.drop("_doc", "_t", "_key", "_lost", "_dropped")
    joined = _with_losses(docs, frequent_lines(docs.select("doc_id", "source", "text"), max_docs))
    lost = F.coalesce("_lost", F.lit(0))
    kept = let(words(F.col("text")), lambda w: let(F.size(w).cast("long"), lambda n: ~(
        depleted(n, lost, keep_percent) | (100 * _repeat_words(w) > REPEAT_PERCENT * n))))
    bitmap = F.when(F.col("_dropped").isNotNull(), runs_of(F.col("_dropped")))
    return joined.where(kept).withColumn("text", F.when(bitmap.isNull(), F.col("text")).otherwise(kept_text(F.col("text"), bitmap))).select(*columns)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(*COLUMNS)


#: {docs} may be any relation with the columns of documents.
SQL_RULED = r"""
q_text AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM {docs}),
q_words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, host,
  list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM q_text),
q_win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM q_words, unnest(range(1, len(w) - 1)) AS t(i)),
q_two AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM q_win) WHERE n > 1),
q_rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM q_two) GROUP BY 1),
q_base AS (SELECT doc_id, host, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, l FROM q_words LEFT JOIN q_rep USING (doc_id)),
q_lines AS (SELECT doc_id, host, translate(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line
  FROM (SELECT doc_id, host, unnest(l) AS s FROM q_base)),
q_over AS (SELECT host, line, min(doc_id) AS keeper FROM q_lines GROUP BY host, line HAVING count(DISTINCT doc_id) > 10),
q_lost AS (SELECT doc_id, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')))::BIGINT AS lost FROM q_lines JOIN q_over USING (host, line) WHERE doc_id <> keeper GROUP BY 1),
q_ruled AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (100 * n_repeat_words > 50 * n_words OR n_words - coalesce(lost, 0) < 50 OR 100 * (n_words - coalesce(lost, 0)) < 30 * n_words) AS kept
  FROM q_base LEFT JOIN q_lost USING (doc_id))"""

SQL = "WITH " + SQL_RULED.format(docs="documents") + " SELECT * FROM q_ruled"
