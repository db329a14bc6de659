"""Ensembles of binary trees kept as a table, evaluated over Arrow batches level by level.

trees(tree, node, feature, threshold, low, high, value): an inner node sends x[feature] <= threshold (and null) to low, the rest to high;
a leaf has no feature and a value. Node 0 is the root. A model is a few thousand rows and travels with the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_NODES = 1_000_000


class Trees:
    """Nodes of all trees in one set of arrays; leaves point to themselves."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: (r[0], r[1]))
        at = {(r[0], r[1]): k for k, r in enumerate(rows)}
        self.roots = np.array([k for (_, n), k in at.items() if n == 0], np.int64)
        leaf = np.array([r[2] is None for r in rows])
        self.feature = np.array([0 if r[2] is None else r[2] for r in rows], np.int64)
        self.threshold = np.array([0.0 if r[3] is None else r[3] for r in rows])
        self.low, self.high = (np.array([k if r[2] is None else at[r[0], r[c]] for k, r in enumerate(rows)], np.int64) for c in (4, 5))
        self.value = np.array([0.0 if r[6] is None else r[6] for r in rows])
        self.leaf = leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Sum over the trees of the leaf that each row of x falls into."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            while not self.leaf[at].all():
                v = x[rows, self.feature[at]]
                at = np.where((v <= self.threshold[at]) | np.isnan(v), self.low[at], self.high[at])
            total += self.value[at]
        return total


def load_trees(table: DataFrame) -> Trees:
    """A model from its table; refuses tables beyond MAX_NODES: these are models, not data."""
    rows = table.select("tree", "node", "feature", "threshold", "low", "high", "value").limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes")
    return Trees([tuple(r) for r in rows])


def tree_scores(df: DataFrame, inputs: list[str], model: Trees, output: str) -> DataFrame:
    """df plus output double: the model's score of the input columns; one column on its way through a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in inputs])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], names=[*b.schema.names, output])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, {output} double")


def sigmoid(c):
    return 1 / (1 + F.exp(-c))
