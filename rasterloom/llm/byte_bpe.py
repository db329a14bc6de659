"""Byte-level BPE encoding and decoding, vectorised over blocks of texts.

Boundaries of the pattern are found without a regex. Each code point has a class, which depends
on it and its successor, and each class is a transition function on the states of the slice read
so far. Composition of transition functions is associative: runs of RUN code points are composed
side by side, the composites of the runs are scanned by doubling, and the states they give at the
head of each run yield the boundaries within it. Slices are hashed from prefix sums; each distinct
slice is merged once, all of a block together, and kept in a bounded cache. The ids of a block
are decoded and compared with its bytes, so a slice never takes the ids of another with its hash.
Byte offsets of every token stay with the ids.

Null texts are empty and have no ids; repeated rows and repeated keys are encoded each on its own;
columns other than the key and the text are not read; empty tables give no rows. A text is encoded
whole, however long, in a block of its own; the time grows with its length times its logarithm.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .hashing import slice_hashes

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
BLOCK_CHARS = 1 << 20
CACHE_WORDS = 1 << 20
RUN = 256
LONG_SLICE = 1024
NONE = np.int32(2**31 - 1)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def class_table() -> np.ndarray:
    """Class of every code point."""
    import regex

    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            table[[ord(c) for c in m[0]]] = kind
    return table


# States of the slice read so far: it is closed, a run of one kind, a blank that waits for a run, an
# apostrophe that began it, or the first of two letters of a contraction.
CLOSED, LETTERS, NUMBERS, OTHERS, BLANK, SPACES, QUOTE, HALF = range(8)
# Classes of code points. Letters: plain, one that ends a contraction ('s), one that with its successor does ('re).
# Spaces: followed by space or the end, a last one that is a blank, any other last one.
PLAIN, ENDS_ONE, BEGINS_TWO, DIGIT, MARK, APOSTROPHE, INNER, LAST_BLANK, LAST_SPACE = range(9)
CLASSES, STATES = 9, 8


def _transition(kind: int, state: int) -> tuple[int, bool]:
    """The state after a code point of the class, and whether a slice begins with it."""
    if state == HALF:
        return CLOSED, False
    if state == QUOTE and kind in (ENDS_ONE, BEGINS_TWO):
        return (CLOSED if kind == ENDS_ONE else HALF), False
    if kind in (PLAIN, ENDS_ONE, BEGINS_TWO):
        return LETTERS, state not in (LETTERS, BLANK)
    if kind == DIGIT:
        return NUMBERS, state not in (NUMBERS, BLANK)
    if kind in (MARK, APOSTROPHE):
        if state in (OTHERS, BLANK, QUOTE):
            return OTHERS, False
        return (QUOTE if kind == APOSTROPHE else OTHERS), True
    if kind == INNER:
        return SPACES, state != SPACES
    return (BLANK if kind == LAST_BLANK else CLOSED), True


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next[class * STATES + state] and begins[...]; classes from CLASSES on are those of a text's first code point, which forget the state."""
    pairs = [_transition(k % CLASSES, s if k < CLASSES else CLOSED) for k in range(2 * CLASSES) for s in range(STATES)]
    return np.array([p[0] for p in pairs], np.uint8), np.array([p[1] for p in pairs], bool)


NEXT, BEGINS = _tables()


def classify(cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes of code points; those that begin a text have CLASSES added."""
    n = len(cp)
    after, beyond = np.zeros(n, np.uint32), np.ones(n, bool)  # the successor within the text; whether it is a space or none
    after[:-1] = np.where(first[1:], 0, cp[1:])
    beyond[:-1] = first[1:] | (kind[1:] == SPACE)
    out = np.array([MARK, PLAIN, DIGIT, INNER], np.uint8)[kind]
    out[cp == 39] = APOSTROPHE
    low = (cp >= 100) & (cp <= 118)  # d to v, all the letters of contractions
    out[low & ((cp == 115) | (cp == 116) | (cp == 109) | (cp == 100))] = ENDS_ONE
    out[low & (((cp == 114) & (after == 101)) | ((cp == 118) & (after == 101)) | ((cp == 108) & (after == 108)))] = BEGINS_TWO
    last = (kind == SPACE) & ~beyond
    out[last] = np.where(cp[last] == 32, LAST_BLANK, LAST_SPACE)
    return out + np.uint8(CLASSES) * first


def boundaries(cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Start positions of the slices. first marks the first code point of each text."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    runs = -(-n // RUN)
    steps = np.full(runs * RUN, PLAIN, np.int32)
    steps[:n] = classify(cp, kind, first)
    steps = np.ascontiguousarray(steps.reshape(runs, RUN).T) * STATES
    # The transition function of each whole run: where it leads from every state.
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (runs, 1))
    for k, step in enumerate(steps):
        whole = NEXT[step[:, None] + whole]
        if k % 8 == 7 and whole.shape[1] > 1 and (whole == whole[:, :1]).all():
            whole = whole[:, :1]  # constant from here on: one state stands for all
    whole = np.broadcast_to(whole, (runs, STATES)).copy()
    # Prefixes of the runs' functions, by doubling: each is composed with the one `reach` runs before it.
    reach = 1
    while reach < runs:
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach], 1)
        reach *= 2
    state = np.concatenate((np.array([CLOSED], np.uint8), whole[:-1, CLOSED]))
    begins = np.empty((RUN, runs), bool)
    for k, step in enumerate(steps):
        at = step + state
        begins[k] = BEGINS[at]
        state = NEXT[at]
    return np.flatnonzero(begins.T.reshape(-1)[:n])


class Encoder:
    """Ranks of a vocabulary file, with the merge table and a cache of merged slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)))
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (ranks[t[:k]] << 32 | ranks[t[k:]], rank)
            for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        ]
        self._build(np.array([p for p, _ in pairs], np.uint64), np.array([r for _, r in pairs], np.int32))
        self.kinds = class_table()
        self._forget()

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probes; built from the vocabulary alone."""
        self.bits = 22
        self.slots = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.slots[at[left]] == np.uint64(2**64 - 1)
            _, won = np.unique(np.where(free, at[left], -1 - left), return_index=True)
            won = won[free[won]]
            i = left[won]
            self.slots[at[i]], self.ranks[at[i]] = keys[i], values[i]
            left = np.delete(left, won)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = self._slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        left = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (found != np.uint64(2**64 - 1))]
        return out

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros(0, np.int64)
        self.known_n = np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.int32)

    def merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slices data[start:start + size], one after another, and how many each has."""
        long = np.flatnonzero(size > LONG_SLICE)
        if not len(long):
            return self._merge_short(data, start, size)
        rest = np.flatnonzero(size <= LONG_SLICE)
        ids, count = self._merge_short(data, start[rest], size[rest])
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(start)
        for i, part in zip(rest.tolist(), np.split(ids, np.cumsum(count)[:-1]) if len(rest) else (), strict=True):
            parts[i] = part
        for i in long.tolist():
            parts[i] = self._merge_long(data[start[i] : start[i] + size[i]])
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _merge_long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one long slice: its pairs wait by rank, and all pairs of the least rank merge together."""
        n = len(data)
        ids, pair = self.byte_id[data], np.full(n, NONE, np.int32)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(at: np.ndarray) -> None:
            """Rank the pairs that begin at these places and put them where they wait."""
            at = at[after[at] < n]
            pair[at] = self._rank(ids[at], ids[after[at]])
            at = at[pair[at] != NONE]
            at = at[np.argsort(pair[at], kind="stable")]
            head = np.flatnonzero(np.diff(pair[at], prepend=-1))
            for r, part in zip(pair[at[head]].tolist(), np.split(at, head[1:]), strict=True) if len(at) else ():
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

        wait(np.arange(n - 1))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (pair[at] == r)]
            if not len(at):
                continue
            # In a run such as a a a only every second pair merges.
            run = np.append(True, after[at[:-1]] != at[1:])
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            gone = after[at]
            ids[at], alive[gone], pair[gone], pair[at] = r, False, NONE, NONE
            after[at] = after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            left = before[at]
            left = left[left >= 0]
            pair[left] = NONE
            wait(np.union1d(at, left))
        return ids[alive]

    def _merge_short(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As merge; every round handles all slices, so that their length bounds the rounds."""
        word = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        ids = self.byte_id[data[at]]
        done_word, done_ids = [], []
        live_word, live = word, ids
        while len(live):
            pair = np.full(len(live), NONE, np.int32)
            inside = np.flatnonzero(live_word[1:] == live_word[:-1])
            pair[inside] = self._rank(live[inside], live[inside + 1])
            head = np.flatnonzero(np.concatenate(([True], live_word[1:] != live_word[:-1])))
            best = np.minimum.reduceat(pair, head)
            count = np.diff(np.append(head, len(live)))
            best = np.repeat(best, count)
            over = best == NONE
            if over.any():
                done_word.append(live_word[over])
                done_ids.append(live[over])
                keep = ~over
                live_word, live, pair, best = live_word[keep], live[keep], pair[keep], best[keep]
                if not len(live):
                    break
            hit = np.flatnonzero(pair == best)
            # In a run such as a a a only every second pair merges.
            run = np.concatenate(([True], np.diff(hit) > 1))
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[place % 2 == 0]
            live[hit] = pair[hit]
            live_word, live = np.delete(live_word, hit + 1), np.delete(live, hit + 1)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int32)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(start))

    def _lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each (distinct) slice lie in known_ids, and how many; merges those not cached."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        i = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        miss = self.known[i] != hashes if len(self.known) else np.ones(len(hashes), bool)
        if miss.any():
            ids, count = self.merge(data, start[miss], (end - start)[miss])
            at = len(self.known_ids) + np.cumsum(count) - count
            self.known_ids = np.concatenate((self.known_ids, ids))
            into = np.searchsorted(self.known, hashes[miss])
            self.known = np.insert(self.known, into, hashes[miss])
            self.known_at = np.insert(self.known_at, into, at)
            self.known_n = np.insert(self.known_n, into, count)
            i = np.searchsorted(self.known, hashes)
        return self.known_at[i], self.known_n[i]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the number of ids of each text, and each token's byte offset in its text."""
        chars = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(whole.encode(), np.uint8)
        wide = (cp >= 0x80).astype(np.uint8) + (cp >= 0x800) + (cp >= 0x10000) + 1
        byte_at = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(wide, out=byte_at[1:])
        text_at = np.cumsum(chars) - chars
        first = np.zeros(len(cp), bool)
        first[text_at[chars > 0]] = True
        cut = boundaries(cp, self.kinds[cp], first)
        start = byte_at[cut]
        end = np.append(start[1:], len(data)) if len(start) else start
        hashes, one, back = np.unique(slice_hashes(data, start, end), return_index=True, return_inverse=True)
        at, count = self._lookup(data, start[one], end[one], hashes)
        n = count[back]
        total = np.cumsum(n)
        pick = np.arange(total[-1] if len(n) else 0) + np.repeat(at[back] - (total - n), n)
        ids = self.known_ids[pick]
        if not np.array_equal(self.decode(ids), data):  # two slices share a hash: this block goes without the cache
            self._forget()
            ids = self.merge(data, start, end - start)[0]
        text_byte = byte_at[text_at]
        token_end = np.cumsum(self.length[ids])
        token_start = token_end - self.length[ids]
        # tokens cover all bytes, so a text's ids are those that begin within it
        bounds = np.searchsorted(token_start, np.append(text_byte, len(data)))
        per_text = np.diff(bounds)
        return ids, per_text, token_start - np.repeat(text_byte, per_text)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, as uint8."""
        n = self.length[ids]
        total = np.cumsum(n)
        at = np.arange(total[-1] if len(n) else 0) + np.repeat(self.offset[ids] - (total - n), n)
        return self.blob[at]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together; a longer text is a block of its own."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids array<int>, offsets array<bigint>: token ids and the byte each begins at. Null texts are empty."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                ids, n, offsets = enc.encode(texts[a:b])
                at = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(offsets))],
                    names=[key, "ids", "offsets"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>, offsets array<bigint>")


def decode_documents(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """key, text binary: the bytes of ids."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out = [enc.decode(np.asarray(x or [], np.int64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, text binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts, without shipping the ids."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, of_ids, of_text = [], [], []
            for a, b in blocks(texts):
                ids, n, _ = enc.encode(texts[a:b])
                raw, back = ids.astype("<u4").tobytes(), enc.decode(ids).tobytes()
                upto = np.concatenate(([0], np.cumsum(n)))
                ends = np.concatenate(([0], np.cumsum(enc.length[ids])))[upto]
                for k in range(b - a):
                    of_ids.append(hashlib.sha256(raw[4 * upto[k] : 4 * upto[k + 1]]).hexdigest())
                    of_text.append(hashlib.sha256(back[ends[k] : ends[k + 1]]).hexdigest())
                counts.extend(n.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
