"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

Texts and benchmark items are sequences of words (letters and digits, lower case). An item is found in a document if some
stretch of the document is within edit distance k = floor(0.2 * words) of it, counted in words; items of fewer than six
words must occur exactly.

An item-sized window is embedded by the CGK random walk, each step of which emits the word under the pointer and
moves on if a random bit of (step, word) says so. Edit distance becomes Hamming distance, so windows near an item agree with
it in many symbols. Keys sample ``BITS`` of the first 2n symbols (most walks are over by then); ``WALKS`` walks with ``SAMPLES``
keys each are compared, which finds a pair at distance k with probability above ``RECALL`` (the tests measure it). What collides is verified
by the exact edit distance of the item to any stretch of the text around the window, so nothing false is reported.

Not every window needs embedding: a stretch within k edits of an item of n words keeps a run of at least
(n - k) / (k + 1) of its words, which is 3 or more from six words on. So only windows that line up with a run of three words
of an item (fewer for shorter items) are embedded; this loses nothing. A window that reaches over an edge of the text, by at
most k words, is verified without keys; farther over, the words missing are more than k edits.

The benchmark is passed to tasks in parts of about ``PART_BYTES``, by measured size, one pass over the documents for each; a pass
needs no shuffle. Items are kept by length, from one power of two to the next, so a very long item does not widen the others, and
runs that many items share are followed in slices. Defined results: a null, empty or blank text or item matches nothing; a null item_id is reported as null; repeated
rows and items are reported each; an empty table gives an empty result; ``decontaminate`` keeps all columns and rows with a
null doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_LETTER, Words, chunks, mix, table, with_workers

SHARE = 0.2
EXACT_BELOW = 6
RUN = 3
WALKS, SAMPLES, BITS = 4, 16, 2
RECALL = 0.98
PART_BYTES = 16 << 20
SLICE = 1 << 18  # pairs of a run and an item, or words of windows, at a time
SEED = 4

_U = np.uint64
_PAD, _PAD_ITEM = _U(1), _U(2)


def allowed(n: np.ndarray) -> np.ndarray:
    """Edits allowed for items of ``n`` words."""
    return np.where(n < EXACT_BELOW, 0, np.floor(SHARE * n + 1e-9)).astype(np.int64)


def _grams(h: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(h) - q + 1)
    out = h[:n].copy()
    for k in range(1, q):
        out = mix(out * _U(3) + h[k : k + n])
    return out


def walks(symbols: np.ndarray, length: np.ndarray, steps: int) -> np.ndarray:
    """LSH keys [rows, WALKS * SAMPLES] of word sequences padded to the right.

    Sampled steps lie within the first 2 * length steps of each row's own walk: they are fractions of its length, so a window
    that is compared with an item must have the item's length.
    """
    g = np.random.Generator(np.random.PCG64(SEED))
    rows = np.arange(len(symbols))
    keys = np.zeros((len(symbols), WALKS * SAMPLES), dtype=np.uint64)
    for w in range(WALKS):
        salt = g.integers(1, 2**63, steps + 1, dtype=np.uint64)
        spots = np.floor(g.random((SAMPLES * BITS, 1)) * (2 * length)[None, :]).astype(np.int64)  # past 2n steps most walks are over
        at = np.zeros(len(symbols), dtype=np.int64)
        emitted = np.zeros((steps, len(symbols)), dtype=np.uint64)
        for j in range(steps):
            s = np.where(at < length, symbols[rows, np.minimum(at, symbols.shape[1] - 1)], _PAD)
            emitted[j] = s
            at += (mix(s ^ salt[j]) & _U(1)).astype(np.int64)
        picked = emitted[np.minimum(spots, steps - 1), rows[None, :]].reshape(SAMPLES, BITS, -1)
        for r in range(SAMPLES):
            k = _U(w * SAMPLES + r)
            for b in range(BITS):
                k = mix(picked[r, b] + k * _U(3))
            keys[:, w * SAMPLES + r] = k
    return keys


def fitted_distance(items: np.ndarray, n: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Edit distance of each item (padded) to the nearest stretch of its region (padded)."""
    width = regions.shape[1]
    ramp = np.arange(width + 1, dtype=np.int32)
    row = np.zeros((len(items), width + 1), dtype=np.int32)
    best = np.where(n == 0, 0, 1 << 20).astype(np.int64)
    for i in range(int(n.max(initial=0))):
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (items[:, i, None] != regions), out=new[:, 1:])
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        ends = n == i + 1
        best[ends] = row[ends].min(1)
    return best


class Index:
    """A part of the benchmark, ready to be looked up."""

    def __init__(self, ids: list, texts: list):
        self.ids, sequences = [], []
        for first, raw, at in chunks(pa.array(texts, pa.string())):
            words = Words(raw, at, NO_LETTER, latin=True)
            for i, (a, b) in enumerate(zip(words.at[:-1], words.at[1:], strict=True)):
                if b > a:
                    self.ids.append(ids[first + i])
                    sequences.append(words.hash[a:b])
        self.n = np.array([len(s) for s in sequences], dtype=np.int64)
        self.k = allowed(self.n)
        # items of a length class have one matrix, as wide as the class's longest; ``place`` is an item's row in it
        self.group = np.ceil(np.log2(np.maximum(self.n, 8))).astype(np.int64)
        self.place = np.zeros(len(self.n), dtype=np.int64)
        self.words: dict[int, np.ndarray] = {}
        self.keys: dict[int, np.ndarray] = {}
        for g in np.unique(self.group).tolist():
            own = np.flatnonzero(self.group == g)
            self.place[own] = np.arange(len(own))
            words = np.full((len(own), 1 << g), _PAD_ITEM, dtype=np.uint64)
            for row, i in enumerate(own):
                words[row, : self.n[i]] = sequences[i]
            few = min(4096, max(1, SLICE >> g))
            self.words[g] = words
            self.keys[g] = np.concatenate([walks(words[a : a + few], self.n[own[a : a + few]], 2 << g) for a in range(0, len(own), few)])
        # runs: gram -> (item, offset), for each length of run
        self.runs = {}
        for q in range(1, RUN + 1):
            own = [i for i, s in enumerate(sequences) if min(RUN, len(s)) == q]
            grams = [_grams(sequences[i], q) for i in own]
            if own:
                gram = np.concatenate(grams)
                item = np.repeat(own, [len(g) for g in grams])
                offset = np.concatenate([np.arange(len(g)) for g in grams])
                order = np.argsort(gram, kind="stable")
                sieve = np.zeros(1 << 22, dtype=bool)
                sieve[(gram & _U((1 << 22) - 1)).astype(np.int64)] = True
                self.runs[q] = gram[order], item[order], offset[order], sieve

    def windows(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of (text, item, start) of windows that line up with a run of an item, each once in a slice."""
        owner = np.repeat(np.arange(len(words.at) - 1), np.diff(words.at))
        for q, (gram, item, offset, sieve) in self.runs.items():
            g = _grams(words.hash, q)
            p = np.flatnonzero(sieve[(g & _U((1 << 22) - 1)).astype(np.int64)])
            if not len(p):
                continue
            lo, hi = np.searchsorted(gram, g[p], side="left"), np.searchsorted(gram, g[p], side="right")
            hit = (hi > lo) & (owner[p] == owner[np.minimum(p + q - 1, len(owner) - 1)])
            p, lo, count = p[hit], lo[hit], (hi - lo)[hit]
            ends = np.cumsum(count)
            for a in range(0, int(ends[-1]) if len(ends) else 0, SLICE):  # the a-th to b-th of all (place, item) pairs
                b = min(a + SLICE, int(ends[-1]))
                pair = np.arange(a, b)
                at = np.searchsorted(ends, pair, side="right")
                which = lo[at] + pair - (ends[at] - count[at])
                yield tuple(np.unique(np.stack([owner[p[at]], item[which], p[at] - offset[which]]), axis=1))

    def _take(self, words: Words, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Words start..start+length of the texts; what lies before or after a text is padding, so that the others keep their places."""
        at = start[:, None] + np.arange(int(length.max(initial=1)))[None, :]
        inside = (at >= words.at[text][:, None]) & (at < np.minimum(start + length, words.at[text + 1])[:, None])
        return np.where(inside, words.hash[np.clip(at, 0, len(words.hash) - 1)], _PAD)

    def _meeting(self, words: Words, t: np.ndarray, i: np.ndarray, s: np.ndarray, g: int) -> np.ndarray:
        """(text, item, distance) of the windows of items of class ``g`` that share a key and hold the item."""
        n, k, place = self.n[i], self.k[i], self.place[i]
        over = np.maximum(words.at[t] - s, 0) + np.maximum(s + n - words.at[t + 1], 0)
        meets = (over > 0) & (over <= k)  # each word over an edge is an edit
        inside = np.flatnonzero(over == 0)
        if len(inside):
            window = self._take(words, t[inside], s[inside], n[inside])
            meets[inside] = (walks(window, n[inside], 2 << g) == self.keys[g][place[inside]]).any(1)
        t, i, s, n, k, place = (x[meets] for x in (t, i, s, n, k, place))
        d = fitted_distance(self.words[g][place], n, self._take(words, t, s - k, n + 2 * k)) if len(t) else n
        return np.stack([t, i, d])[:, d <= k]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, distance) of the items found, once for each text and item."""
        out = []
        for text, item, start in self.windows(words):
            for g in np.unique(self.group[item]).tolist():
                own = np.flatnonzero(self.group[item] == g)
                few = min(4096, max(1, SLICE >> g))
                for a in range(0, len(own), few):
                    some = own[a : a + few]
                    found = self._meeting(words, text[some], item[some], start[some], g)
                    if found.shape[1]:
                        out.append(found)
        if not out:
            return (np.zeros(0, np.int64),) * 3
        t, i, d = np.concatenate(out, axis=1)
        order = np.lexsort((d, i, t))
        t, i, d = t[order], i[order], d[order]
        first = np.ones(len(t), dtype=bool)
        first[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1])
        return t[first], i[first], d[first]


def parts(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in parts of bounded size, so that a task never holds more than one."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // PART_BYTES))
    for k in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).select("item_id", "text").collect()  # about PART_BYTES
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        index = Index([r["item_id"] for r in rows], [r["text"] for r in rows])
        if index.ids:
            yield index


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, distance, similarity) for every benchmark item that a document holds."""
    spark = with_workers(docs.sparkSession)
    schema = "doc_id long, item_id long, item_words long, distance long, similarity double"
    out = spark.createDataFrame([], schema)
    for index in parts(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            ids = pa.array(index.ids, pa.int64())
            for batch in batches:
                for first, raw, at in chunks(batch.column("text")):
                    t, i, d = index.find(Words(raw, at, NO_LETTER, latin=True))
                    if len(t):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array(t + first)), ids.take(pa.array(i)), pa.array(index.n[i]), pa.array(d), pa.array(1 - d / index.n[i])],
                            names=["doc_id", "item_id", "item_words", "distance", "similarity"],
                        )

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    spark = with_workers(docs.sparkSession)
    for index in parts(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for first, raw, at in chunks(batch.column("text")):
                    clean[first + shared.value.find(Words(raw, at, NO_LETTER, latin=True))[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
