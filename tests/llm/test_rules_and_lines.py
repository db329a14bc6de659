"""Line frequency by host, repeated rows, and lines of every length."""

import random

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import line_dedup, quality_rules
from test_llm_operators import prose, words_of

SHORT = "doc_id long, text string, source string"


def brute_rules(rows, max_docs, keep_percent):
    held = {}
    norm = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    for i, t, h in rows:
        for s in (t or "").split("\n"):
            if norm(s):
                held.setdefault((h or "", norm(s)), set()).add(i)
    over = {k: min((x for x in v if x is not None), default=None) for k, v in held.items() if len(v) > max_docs}
    out = []
    for i, t, h in rows:
        n, lost, left = len(words_of(t)), 0, []
        for s in (t or "").split("\n"):
            k = (h or "", norm(s))
            if norm(s) and k in over and over[k] != i:
                lost += len(words_of(s))
            else:
                left.append(s)
        w = words_of(t)
        at = {}
        for k in range(n - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        repeats = len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)})
        failed = n < 50 or 100 * repeats > 50 * n
        out.append((i, lost, failed, not (failed or n - lost < 50 or 100 * (n - lost) < keep_percent * n), "\n".join(left)))
    return out


@pytest.fixture(scope="module")
def hosts():
    """A host with a long notice, a short line on many pages of a large host, a page copied often, and one below the limit."""
    notice = " ".join(f"notice{k}" for k in range(96))
    rows = [(i, f"{notice}\nown {i} text {i * 7}", "a") for i in range(20)]  # 96 words of boilerplate, 4 own
    rows += [(100 + i, prose(90, i) + "\n" + notice, "a") for i in range(20)]  # own text beside it
    rows += [(200 + i, prose(90, 77), "b") for i in range(15)]  # one text, copied
    rows += [(300 + i, "Read MORE here\n" + prose(60, 1000 + i), "b") for i in range(300)]
    rows += [(700 + i, notice, "c") for i in range(10)]
    rows += [(800, None, "a"), (801, "", None), (None, notice, "a"), (None, prose(70, 5), None)]
    rows += [rows[0], rows[25]]  # repeated rows
    return rows


def test_lines_are_counted_by_documents_of_a_host(spark, hosts):
    ruled = quality_rules.apply_rules(spark.createDataFrame([(*r, 7, True) for r in hosts], SHORT + ", lost_words int, kept boolean")).collect()
    got = sorted(((r.doc_id, r.lost_words, r.base_failed, r.kept) for r in ruled), key=repr)
    assert got == sorted((r[:4] for r in brute_rules(hosts, 10, 30)), key=repr)
    rejected = {i for i, _, failed, kept in got if not kept and not failed}
    assert rejected >= {*range(1, 20), *range(201, 215)} and not rejected & {0, 200, *range(100, 120), *range(300, 600), *range(700, 710)}


def test_rejected_and_shortened_texts(spark, hosts):
    want = sorted(((i, t) for i, _, _, kept, t in brute_rules(hosts, 10, 30) if kept), key=repr)
    got = quality_rules.kept_documents(spark.createDataFrame(hosts, SHORT)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == want
    assert sum("Read MORE" in t for _, t in want) == 1 and sum("notice5 " in t for _, t in want) == 12


def test_line_dedup_of_repeated_rows(spark):
    a, b = "A" * 45, "b" * 41
    rows = [(i, f"{a}\nown {i}\n{b}\n{a}") for i in range(6)]
    rows += [rows[1], rows[1], rows[5], (2, f"other text\n{a}"), (None, f"{b}\nx"), (None, f"{b}\nx")]
    rows.append((9, "\n".join(random.Random(1).choices([a, b, "c", ""], k=50_000))))
    top = {a.lower(): 9, b: 9}
    out = line_dedup.dedup_lines(spark.createDataFrame([(*r, 5, "t") for r in rows], "doc_id long, text string, n_dropped int, _t string"))
    got = sorted(((r.doc_id, r.k, r.n_dropped) for r in out.withColumn("k", line_dedup.kept_text(F.col("text"), F.col("keep_bitmap"))).collect()), key=repr)
    want = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [s for s in lines if s.lower() not in top or top[s.lower()] == i]
        want.append((i, "\n".join(kept), len(lines) - len(kept)))
    assert got == sorted(want, key=repr)
