"""Small fixtures for the training-data operators: brute force, round trips and edge rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import byte_bpe, fingerprint, html_extract, line_dedup, minhash, packing, quality_classifier, quality_rules, suffix_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, label string, key string"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefgé ñ日'") for _ in range(rng.randint(1, 7))).strip() or "x" for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(WORDS))
        if r.random() < 0.06:
            out.append("\n")
    return " ".join(out)


def texts():
    base = [prose(120, s) for s in range(8)]
    near = base[0].replace(base[0].split()[60], "changed", 1)
    long = prose(9000, 99)
    shared = " ".join(WORDS[:40])
    return [*base, base[1], base[1], near, None, "", " \n\t", "one", long, base[2] + "\n" + shared, base[3] + " " + shared + " tail", "aaaa" * 80, "aaaa" * 60,
            "Mixed CASE words here now", "mixed case WORDS here now", "x <|endoftext|> don't 'LL 's  \n\n y"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 5 == 0 else "src0", 1, True, "l", "k") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_near_duplicates(docs, empty):
    def sets(width):
        out = {}
        for i, t in enumerate(texts()):
            w = words_of(lowered(t))
            out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        return out

    for width in (4, 5):
        s = sets(width)
        label = {i: i for i in s}
        for _ in s:
            for a in s:
                for b in s:
                    if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                        label[a] = label[b] = min(label[a], label[b])
        got = {r.doc_id: r for r in minhash.near_duplicates(docs, width).collect()}
        assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s[i]), label[i], label[i] == i) for i in s}
    assert minhash.near_duplicates(empty).count() == 0


def test_chain_and_family(spark):
    """Links that no star proposes, and a family whose members differ from each other."""
    base = [f"w{i}" for i in range(400)]
    chain = [" ".join(base[40 * k : 40 * k + 360]) for k in range(2)]
    steps = []
    cur = list(base)
    for k in range(6):
        cur = list(cur)
        for j in range(8):
            cur[(k * 61 + j * 7) % 400] = f"n{k}_{j}"
        steps.append(" ".join(cur))
    rows = list(enumerate([*steps, *chain]))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    s = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    label = {i: i for i in s}
    for _ in s:
        for a in s:
            for b in s:
                if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_densified_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate((a[4:], r.integers(0, 2**63, 4, dtype=np.uint64))))
    same = (minhash.sketch(a, 2000) == minhash.sketch(b, 2000)).mean()
    assert abs(same - 36 / 44) < 0.1
    assert (minhash.sketch(a[:1]) == a[0]).all()


def test_quality_classifier(spark, docs, empty):
    good = [(i, prose(80, i)) for i in range(200)]
    bad = [(i, " ".join(w.upper() + "!!" for w in prose(80, i).split())) for i in range(200, 400)]
    d = spark.createDataFrame([*good, *bad, (400, None), (401, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, int(i < 200), 0) for i in range(400)], (None, 1, 0), (3, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_classifier.classify(d, labels).collect()}
    assert len(rows) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i].held_out for i in held) and sum(r.held_out for i, r in rows.items() if i < 400) == len(held)
    assert np.mean([rows[i].predicted == (i < 200) for i in held]) > 0.95
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(empty, labels).count() == 0


def test_url_rules_and_reputation(spark):
    urls = ["http://A.Example.org/es/1?x", "https://x.com/fr/2#t", "http://com/de/3", "ftp://b.example.org/en/12", "no url", None, "http://host.net", "http://q.example.net/en/5", "http://h.org", "http://notexample.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, outcome int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, none).collect()}
    assert [got[i].rule for i in range(10)] == ["example.org/es/", "com/fr/", "com/de/", "example.org/en/1", None, None, None, None, None, "org/"]
    assert (got[0].host, got[0].path, got[4].host, got[5].path, got[6].path) == ("a.example.org", "/es/1", "", "", "")
    assert got[1].verdict == "allow" and got[2].verdict == "block"
    many = spark.createDataFrame([(i, f"http://{'good' if i % 2 else 'bad'}{i % 6}.site{i % 2}.net/en/{i}") for i in range(600)], "page_id long, url string")
    seen = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(1, None), (None, 1)], "page_id long, outcome int")
    verdicts = {r.page_id: r.verdict for r in url_filter.filter_urls(many, seen).collect()}
    assert len(verdicts) == 600 and all(verdicts[i] == ("allow" if i % 2 else "block") for i in verdicts)
    assert url_filter.filter_urls(pages.limit(0), none).count() == 0


def test_fingerprints(docs, empty):
    t = {i: x or "" for i, x in enumerate(texts())}
    ids = sorted(t, reverse=True)
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    like = lambda a, b: len(a & b) / len(a | b)
    for k, i in enumerate(ids):
        after = t[ids[(k + 1) % len(ids)]]
        cut = len(t[i]) // 3
        edited = t[i][: len(t[i]) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t[i]), hashlib.sha256(edited.encode()).hexdigest())
        lines = [set(re.split(r"\n|(?<=[a-h][.!?;]) |(?<=[。！？]) ", x)) for x in (t[i], edited, after)]
        assert r.near_edited == pytest.approx(like(lines[0], lines[1])) and r.near_next == pytest.approx(like(lines[0], lines[2]))
    assert got[1].fingerprint == got[8].fingerprint != got[2].fingerprint
    assert fingerprint.fingerprints(empty).count() == 0
    assert fingerprint.fingerprints(docs.where("doc_id = 3")).first().near_next == 1


def test_byte_bpe(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    hard = ["don't 'll's ''s !'s  's\n\n x\t\ty \n", " 　 x", "x\x85y \x1c z", "日本語 １２ ½ ", "'rest'red'd'", "éa'’s", " ' s'", "'l", "'", "\U0001f600'll  \U0001f600"]
    alphabet = "ab  '\n\t1é日.sStld　́r"
    hard += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    enc = byte_bpe.encoder(byte_bpe.vocabulary_path())
    ids, n, offsets = enc.encode(hard)
    at = np.concatenate(([0], np.cumsum(n)))
    for k, t in enumerate(hard):
        mine = ids[at[k] : at[k + 1]].tolist()
        assert mine == own.encode_ordinary(t), repr(t)
        assert enc.decode(ids[at[k] : at[k + 1]]).tobytes() == t.encode()
        starts = offsets[at[k] : at[k + 1]].tolist()
        assert starts == np.concatenate(([0], np.cumsum([len(own.decode_single_token_bytes(i)) for i in mine])))[:-1].astype(int).tolist()
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs).collect()}
    for i, t in enumerate(texts()):
        want = own.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.text).decode() for r in byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts())}
    assert byte_bpe.round_trip(empty).count() == 0


def test_quality_rules(spark, docs, empty):
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    for i, t in enumerate(texts()):
        w = words_of(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        rep = {k + j for k, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)} if len(tri) < 3000 else None
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        if rep is not None:
            assert r.n_repeat_words == len(rep)
            assert r.base_failed == (len(w) < 50 or 2 * len(rep) > len(w))
    assert quality_rules.apply_rules(empty).count() == 0


def test_html_extraction(spark):
    para = "A sentence, with commas, that is long enough to be prose. " * 3
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
      <header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="ad">Buy</div><div class="cookie-notice"><p>{para}</p></div>
      <div id="content"><h2>Head &amp; line</h2><p>{para}<p>Sec<b>ond</b>&nbsp;one &#233;&lt;x&gt;<br>more</div>
      <div class="sidebar"><p>{para}</p></div><section id="comments"><p>{para}</p></section><form><p>{para}</p></form><footer>f</footer></body></html>"""
    text = " ".join(f"Head & line {para} Second one é<x> more".split())
    deep = "<div>" * 5000 + f"<p>{para}</p>"
    rows = [(0, "u", page), (1, None, None), (2, "u", ""), (3, "u", "plain & simple"), (4, "u", "<p>unclosed <b>tag"), (5, "u", deep), (6, "u", "<!-- only -->"), (0, "u", page)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(f'<div class="with-sidebar"><article><p>{para}</p></article><div class="sidebar">x</div></div>'
                                f'<ol class="comments"><li><article class="comment"><p>{para}</p></article></ol>') == para.strip()
    by = {r.page_id: r.text for r in got}
    assert by == {0: text, 1: "", 2: "", 3: "plain & simple", 4: "unclosed tag", 5: para.strip(), 6: ""}


def test_line_dedup(spark, empty):
    long = ["L" * 45 + str(k) for k in range(3)]
    rows = [(i, "\n".join([f"own {i}", "  " + long[0].lower() + "\t", long[1] if i < 4 else "short", long[2], long[2], ""])) for i in range(8)]
    rows += [(20, None), (21, ""), (22, "\n"), (23, long[0])]
    want = {}
    key = lambda s: lowered(s.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            held.setdefault(key(s), set()).add(i)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not (len(key(s)) >= 40 and len(held[key(s)]) >= 5 and i != max(held[key(s)]))]
        want[i] = ("\n".join(kept), len(lines) - len(kept))
    d = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, keep_bitmap array<int>")
    out = line_dedup.dedup_lines(d)
    got = {r.doc_id: (r.kept, r.n_dropped) for r in out.withColumn("kept", line_dedup.kept_text(F.col("text"), F.col("keep_bitmap"))).collect()}
    assert got == want
    assert line_dedup.dedup_lines(empty).count() == 0


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer
    import public_tokenizers as P

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = packing.pack(packing.token_pieces(docs)).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts())}
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == p.length
    for i, own in by.items():
        own.sort(key=lambda p: p.piece)
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist() and sum(p.length for p in own) == len(ids[i])
        assert all(p.length == 1024 for p in own[1:])
    assert set(by) == set(ids)
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append(p)
    for b in bins.values():
        b.sort(key=lambda p: p.offset)
        assert [p.offset for p in b] == np.cumsum([0] + [p.length for p in b])[:-1].tolist() and sum(p.length for p in b) <= 1024
    total = sum(map(len, ids.values()))
    assert len(bins) <= -(-total // 1024) + 2
    assert packing.pack(packing.token_pieces(empty)).count() == 0
    r = random.Random(2)
    rows = [(i, 0, 0, r.choice([1, 3, 500, 513, 700, r.randint(1, 1024)]), 0) for i in range(4000)]
    many = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), items_per_task=400).collect()
    fill = {}
    for p in many:
        fill[p.sequence_id] = fill.get(p.sequence_id, 0) + p.length
    alone = len(packing.best_fit([x[3] for x in rows], 1024))
    assert len(many) == 4000 and max(fill.values()) <= 1024 and len(fill) <= 1.03 * alone


def test_two_stage_order_and_prefixes():
    g = np.random.default_rng(0)
    for n, k in ((0, 3), (1, 2), (50, 1), (400, 2), (2000, 3), (3000, 40)):
        d = g.integers(1, 1 + k, n).astype(np.uint8)
        order, raw = suffix_dedup.two_stage_order(d, 50), d.tobytes()
        assert sorted(order.tolist()) == list(range(n))
        assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in range(n))
        lcp = suffix_dedup.common_prefixes(d, order, 50)
        for j in range(1, min(n, 200)):
            a, b = raw[order[j] :], raw[order[j - 1] :]
            m = next((q for q in range(min(len(a), len(b), 50)) if a[q] != b[q]), min(len(a), len(b), 50))
            assert lcp[j] >= m and (m == 50 or min(len(a), len(b)) <= m or lcp[j] == m)


def brute_repeats(rows, width=50):
    seen, lost = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            seen.setdefault(b[p : p + width], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        off = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] < i:
                off[p : p + width] = True
        spans = int(off[:1].sum() + (off[1:] & ~off[:-1]).sum())
        out.append((i, len(b), int(off.sum()), spans, hashlib.sha256(bytes(c for c, x in zip(b, off) if not x)).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark, docs, empty):
    rows = list(enumerate(texts()))
    got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    twice = [(5, texts()[0]), (5, texts()[0]), (7, "abcde" * 40), (2, "abcde" * 11), (9, "z" * 49)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame([(*r, 1) for r in twice], "doc_id long, text string, n_bytes int"))
    assert sorted(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == brute_repeats(twice)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    base = [prose(150, s) for s in range(6)]
    rows = [(i, t) for i, t in enumerate([*base, base[0], base[1] + " tail", "too short", base[2] + "\n" + base[3], None])]
    d = spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    docs = d
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        after = {r.doc_id: r for r in docs.collect()}
        assert all(r.n_chars == len(r.text or "") for r in after.values())
        if name == "quality_rules":
            assert set(before) - set(after) == {8, 10}
        elif name == "near_dedup":
            assert set(before) - set(after) == {6, 7}
        else:
            assert set(before) == set(after)
        if name == "passage_dedup":
            want = {i: h for i, _, _, _, h in brute_repeats([(i, r.text) for i, r in before.items()])}
            assert all(hashlib.sha256(after[i].text.encode()).hexdigest() == want[i] or "é" in before[i].text or "日" in before[i].text for i in after)
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in docs.collect()}
