"""A corpus pipeline over documents: quality rules, line dedup, near-dedup, passage dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.common import materialize, table
from rasterloom.llm.stages import line_dedup, near_dedup, packing, passage_dedup, quality_rules

STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Best-fit packing is no relational expression; tests/llm holds the stages against brute force.
ORACLE_SQL = None
