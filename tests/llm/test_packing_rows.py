"""Packing of repeated rows, rows without an id and tables with columns of the same names."""

import random

from rasterloom.llm import packing


def test_repeated_rows_nulls_and_other_columns(spark):
    rows = [(1, "a few words", 5, 9), (1, "a few words", 5, 9), (None, None, 1, 1), (None, "", 1, 1), (2, "words " * 3000, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, piece int, length long")
    got = packing.pack(packing.token_pieces(docs)).collect()
    assert len([p for p in got if p.doc_id == 1]) == 2 and len([p for p in got if p.doc_id is None and p.length == 1]) == 2
    long = sorted((p.piece, p.start, p.length) for p in got if p.doc_id == 2)
    assert len(long) > 2 and all(n == 1024 for _, _, n in long[1:]) and [s for _, s, _ in long] == [0, *[long[0][2] + 1024 * k for k in range(len(long) - 1)]]
    bins = {}
    for p in got:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1024


def test_rounds_go_on_until_nothing_joins(spark):
    r = random.Random(4)
    rows = [(i, 0, 0, r.choice([600, 700, 513, 100, 400]), 0) for i in range(3000)]
    many = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), items_per_task=300).collect()
    assert len(many) == 3000 and len({p.sequence_id for p in many}) <= 1.02 * len(packing.best_fit([x[3] for x in rows], 1024))
