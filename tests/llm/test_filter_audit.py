"""The audit against every order applied to the documents one after the other."""

from itertools import permutations

import pytest

from rasterloom.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, n long, mask string, part string"
LABELS = "doc_id long, quality int, toxic int, text string"


def fails(text, copy):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text).split(" ") if x]
    return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy}


def brute(docs, labels):
    held, parts = [], {}
    for i, text, lang, *_ in docs:
        copy = i is not None and any(j is not None and j < i and (u or "") == (text or "") for j, u, *_ in docs)
        good, toxic = (any(k == i and i is not None and x[c] == 1 for k, *x in labels) for c in (0, 1))
        held.append((lang or "", fails(text or "", copy), good, toxic))
    for part in {h[0] for h in held}:
        mine = [h for h in held if h[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [h for h in left if h[1][f]]
                parts[part, order, step] = [0, len(gone), sum(h[1][f] for h in mine) - len(gone), sum(h[1][f] and sum(h[1].values()) == 1 for h in mine), sum(h[2] for h in gone), sum(h[3] for h in gone)]
                left = [h for h in left if not h[1][f]]
                parts[part, order, step][0] = len(left)
    total = {}
    for (part, order, step), v in parts.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in parts.items())


@pytest.fixture(scope="module")
def docs():
    long = " ".join(f"word{k}" for k in range(250))
    rows = [(1, long, "en"), (2, long, "fr"), (3, long + "\x0b#", "en"), (4, "LOUD " * 300, "en"), (5, "LOUD " * 300, None), (6, "the same " * 150, "en"), (7, "short", "en"), (8, "short ", "en"),
            (9, None, "en"), (10, "", "fr"), (11, " 　" * 500, "en"), (12, "É" * 40 + " é" * 300, "fr"), (13, long, "en"), (13, long, "en"), (13, long + " x", "en"), (None, long, "en"),
            (14, "ab " * 100_000 + long, "de"), (15, " ".join(f"w{k % 100}" for k in range(200)), "de")]
    return [(*r, 7, "m", "p") for r in rows]


LABELLED = [(1, 1, 0, "t"), (2, 1, 1, "t"), (2, 0, 0, "t"), (4, 0, 1, "t"), (13, 1, 1, "t"), (99, 1, 1, "t"), (None, 1, 1, "t"), (7, None, None, "t")]


def test_equals_every_order(spark, docs):
    got = A.audit_filters(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(LABELLED, LABELS))
    assert sorted(map(tuple, got.collect())) == brute(docs, LABELLED)


def test_copies_are_those_of_a_smaller_id(spark, docs):
    df = spark.createDataFrame(docs, DOCS)
    got = A.copies(df, A.measured(df))
    assert sorted(r.doc_id for r in got.select("doc_id").distinct().collect()) == [2, 5, 10, 13]


def test_empty_tables(spark, docs):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert A.audit_filters(none, labels).collect() == []
    got = A.audit_filters(spark.createDataFrame(docs[:1], DOCS), labels).collect()
    assert len(got) == 600 and {r.kept for r in got} == {1} and {r.good_lost for r in got} == {0}


def test_many_copies(spark):
    rows = [(i, "copy " * 300, "en", 0, "", "") for i in range(3000)]
    got = A.audit_filters(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD' and step = 1").collect()
    assert [(r.kept, r.removed) for r in got] == [(1, 2999)]
