"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a local session gets a temporary one; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """Write df below spark.checkpoint.dir and read it back.

    This cuts lineage, so that rounds of an iteration do not pile up in one plan, and survives lost executors. What nothing
    reads any more goes by discard(); the rest goes with the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Like checkpointed(), split by the hash of keys: a join on just these keys then sends only its other side.

    For a table that every round of a loop joins. There are as many buckets as shuffle partitions, one file each.
    """
    spark = df.sparkSession
    n, run = int(spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex
    path, table = f"{shared_dir(spark).rstrip('/')}/{name}-{run}", f"{name}_{run}".replace("-", "_")
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.written_at, out.named = path, table
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that checkpointed() or bucketed() gave, once all that was made from them is written."""
    for t in tables:
        if getattr(t, "named", None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t.named}")
        path = getattr(t, "written_at", None)
        if path:
            where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fingerprint(df: DataFrame, version: str = "") -> str:
    """A key of what df would hold: its schema, its plan, and the length and time of every file that it reads.

    Expression numbers are taken out of the plan's text, so that the same query has the same key in every session. The bodies of
    Python functions are not in a plan: a version says when these change. Literal rows made by the driver count by their text.
    """
    spark = df.sparkSession
    fields = "spark.sql.debug.maxToStringFields"
    usual = spark.conf.get(fields)
    spark.conf.set(fields, 1 << 20)  # else wide plans are cut short in their text
    try:
        text = re.sub(r"#\d+L?|plan_id=\d+", "", df._jdf.queryExecution().optimizedPlan().toString())
    finally:
        spark.conf.set(fields, usual)
    read, at = [_plain(f) for f in df.inputFiles()], {}
    for folder in {f.rsplit("/", 1)[0] for f in read}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        for s in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where):
            at[_plain(s.getPath().toString())] = (s.getLen(), s.getModificationTime())
    held = sorted((f, at.get(f, ())) for f in read)
    return hashlib.sha256(json.dumps([version, df.schema.jsonValue(), text, held]).encode()).hexdigest()[:32]


def _plain(path: str) -> str:
    """One spelling of a local file's address."""
    return re.sub("^file:/+", "file:/", path)


def reused(df: DataFrame, root: str, name: str, version: str = "") -> DataFrame:
    """df as a table below root: the one written before if schema, plan and source files are the same, else a new one.

    A table is written beside its place and moved there when it is whole, so a reader never sees a part of one; of two writers the
    first wins. Tables of former inputs stay until somebody removes them.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    place = f"{root.rstrip('/')}/{name}/{fingerprint(df, version)}"
    path = jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")):
        draft = f"{root.rstrip('/')}/{name}/.draft-{uuid.uuid4().hex}"
        df.write.parquet(draft)
        moved = files.rename(jvm.org.apache.hadoop.fs.Path(draft), path) if not files.exists(path) else False
        if not moved or files.exists(jvm.org.apache.hadoop.fs.Path(f"{place}/{draft.rsplit('/', 1)[1]}")):
            files.delete(jvm.org.apache.hadoop.fs.Path(draft), True)
    return spark.read.schema(df.schema).parquet(place)
