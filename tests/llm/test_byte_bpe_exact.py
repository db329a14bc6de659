"""Texts that share weak hashes, very long slices, and rows that repeat."""

import base64
import hashlib
import random
import time

import numpy as np
import pytest

from rasterloom.llm import byte_bpe
from rasterloom.llm.hashing import slice_hashes


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def per_text(enc, texts):
    ids, n, _ = enc.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_no_slice_takes_the_ids_of_another(reference, monkeypatch):
    texts = [*thue_morse(4096), "short", "words"]
    enc = byte_bpe.encoder(byte_bpe.vocabulary_path())
    assert per_text(enc, texts) == [reference.encode_ordinary(t) for t in texts]
    one, other = (np.frombuffer(t.encode(), np.uint8) for t in texts[:2])
    both = np.concatenate((one, other))
    assert len(set(slice_hashes(both, np.array([0, 4096]), np.array([4096, 8192])).tolist())) == 2
    # Even if every slice had the same hash, the bytes decide.
    monkeypatch.setattr(byte_bpe, "slice_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    fresh = byte_bpe.Encoder(byte_bpe.vocabulary_path())
    assert per_text(fresh, texts) == [reference.encode_ordinary(t) for t in texts]


def test_boundaries_by_composed_transitions(reference):
    rng = random.Random(3)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for alphabet in ("'srevltmd x1", "' \n\tl", "aé日 1.　'") for _ in range(400)]
    assert per_text(byte_bpe.encoder(byte_bpe.vocabulary_path()), texts) == [reference.encode_ordinary(t) for t in texts]


def test_a_million_letters(reference):
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    enc = byte_bpe.encoder(byte_bpe.vocabulary_path())
    began = time.time()
    got = per_text(enc, [text, "ab" * 5000])
    assert time.time() - began < 10
    assert got == [reference.encode_ordinary(text), reference.encode_ordinary("ab" * 5000)]


def test_repeated_rows_other_keys_and_columns(spark):
    rows = [("k", "one two", 1, [9]), ("k", "one two", 1, [9]), (None, None, None, None), ("e", "", 2, [])]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_tokens int, ids array<int>")
    got = sorted(map(tuple, byte_bpe.round_trip(docs).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert [r[0] for r in got].count("k") == 2 and {r[3] for r in got} == {sha(b"one two"), sha(b"")}
    assert byte_bpe.encode_documents(docs).count() == 4
