"""Words with like hashes, rows that repeat, and columns that clash."""

from rasterloom.llm import minhash


def test_words_that_share_weak_hashes_are_no_link(spark):
    w = "a"
    while len(w) < 4096:
        w += w.translate(str.maketrans("ab", "ba"))
    rows = [(1, w), (2, w.translate(str.maketrans("ab", "ba"))), (3, "other words")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got)


def test_links_are_confirmed_on_words(spark, monkeypatch):
    """With one hash for every word of a length, only the words themselves tell texts apart."""
    rows = [(1, " ".join(f"a{i:03}" for i in range(40))), (2, " ".join(f"b{i:03}" for i in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(2, 1), (1, 1)], "a long, b long")
    assert [tuple(r) for r in minhash.confirm(pairs, docs, 4, 80).collect()] == [(1, 1)]
    assert minhash.word_set("A b\tB  a", 4) == {(b"a", b"b", b"b", b"a")} and minhash.word_set(" \n", 4) == set() and minhash.word_set("x Y", 4) == {(b"x", b"y")}


def test_repeated_rows_null_ids_and_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text, 1, "x"), (7, text, 2, "y"), (9, text.upper(), 3, "z"), (None, text, 4, "z"), (None, "alone here", 5, "z"), (4, None, 6, "q"), (4, None, 6, "q")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n long, name string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, 4).collect()), key=repr)
    assert got == sorted([(7, 27, 7, True), (7, 27, 7, True), (9, 27, 7, False), (None, 27, 7, False), (None, 1, None, True), (4, 0, 4, True), (4, 0, 4, True)], key=repr)


def test_one_very_long_text(spark):
    long = " ".join(f"w{i % 4999}x{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long.replace("w7x7 ", "", 1)), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 5).collect()}
    assert got == {1: (199_996, 1), 2: (199_995, 1), 3: (1, 3)}
