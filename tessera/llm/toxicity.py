"""Toxicity by cumulative-link ordinal regression.

Grades are ordered: 0 harmless, 1 toxic, 2 severely toxic. The model is the proportional-odds model
P(grade <= k) = sigmoid(theta_k - w.x): one weight vector is shared by both thresholds. x holds, for each hashed word of
the whole text, 1 if it occurs, and for each hashed stem (the first STEM bytes of a longer word) log(1 + percent of the
words that have it), as some vocabularies show by their density only. The result is the expected severity
P(grade >= 1) + P(grade >= 2), from 0 to 2.

Labels say toxic or not only, so grades 1 and 2 are told apart by telling words and stems: those that at least
``TELLING`` times as large a share of toxic as of harmless training texts hold. A toxic text with more of them (by the sum
of their values) than the median toxic text counts as severe.

Training runs on a bounded sample of labelled documents: at most ``SAMPLE`` of each label, those with the smallest hash
of doc_id, so reruns agree. Executors turn them into hashed features; the driver fits the weights with an L1
penalty (accelerated proximal gradient). Scoring is one pass over the documents without a shuffle; what is broadcast is the
list of non-zero weights, at most 2**BITS.

Defined results: of the texts of a repeated id one trains (that with the smallest hash); a null, empty or blank text has no words and severity 0; unlabelled and null-labelled rows train
nothing; a document whose labels disagree counts as toxic; without both labels in the sample all weights are 0 and
severity is 0; repeated rows are scored each; other columns pass through ``score`` (``severity``, ``grade`` and
``toxic`` of the input are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_LETTER, Words, chunks, table, with_workers

BITS = 20
STEM = 6
SAMPLE = 2000
SEED = 11
PENALTY = 0.004
STEPS = 250
TELLING = 6.0
#: A text is toxic from this probability of grade 1 or more.
THRESHOLD = 0.5


def _slots(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(owner, slot) of every word, then of every stem; words have even slots and stems odd ones."""
    owner = np.repeat(np.arange(len(words.at) - 1), np.diff(words.at))
    stems, places = words.stems(STEM, STEM + 2)
    slot = (words.hash >> np.uint64(64 - BITS)).astype(np.int64) & ~1
    stem_slot = (stems >> np.uint64(64 - BITS)).astype(np.int64) | 1
    return np.concatenate([owner, owner[places]]), np.concatenate([slot, stem_slot])


def _values(slot: np.ndarray, count: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.where(slot & 1, np.log1p(100.0 * count / np.maximum(n_words, 1)), 1.0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, values = [], []
        for _, raw, at in chunks(batch.column("text")):
            words = Words(raw, at, NO_LETTER, latin=True)
            n_words = np.diff(words.at)
            owner, slot = _slots(words)
            pairs, count = np.unique((owner << BITS) | slot, return_counts=True)
            owner, slot = pairs >> BITS, pairs & ((1 << BITS) - 1)
            value = _values(slot, count, n_words[owner])
            cuts = np.searchsorted(owner, np.arange(len(at)))
            slot, value = slot.astype(np.int32), value.astype(np.float32)
            found += [slot[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            values += [value[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
            names=["doc_id", "toxic", "slots", "vals"],
        )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def grades(toxic: np.ndarray, slots: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """Grades of training texts from their labels and the weight of telling words and stems."""
    none = [np.zeros(0, np.int64)]
    bad = np.bincount(np.concatenate([s for s, y in zip(slots, toxic, strict=True) if y] or none), minlength=1 << BITS)
    good = np.bincount(np.concatenate([s for s, y in zip(slots, toxic, strict=True) if not y] or none), minlength=1 << BITS)
    telling = ((bad + 0.5) / (toxic.sum() + 1) > TELLING * (good + 0.5) / ((1 - toxic).sum() + 1)) & (bad >= max(3, 0.02 * toxic.sum()))
    share = np.array([v[telling[s]].sum() for s, v in zip(slots, values, strict=True)])
    out = toxic.astype(np.int64)
    if toxic.any():
        out[(toxic == 1) & (share > np.median(share[toxic == 1]))] = 2
    return out


def fit(toxic: np.ndarray, slots: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots with a weight, their weights, the two thresholds)."""
    none = np.zeros(0, np.int64), np.zeros(0), np.array([35.0, 36.0])
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return none
    y = grades(toxic, slots, values)
    df = np.bincount(np.concatenate(slots), minlength=1 << BITS)
    kept = np.flatnonzero(df >= 3)
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    col = [place[s] for s in slots]
    row = np.repeat(np.arange(len(col), dtype=np.int32), [(c >= 0).sum() for c in col])
    val = np.concatenate([v[c >= 0] for c, v in zip(col, values, strict=True)])
    col = np.concatenate([c[c >= 0] for c in col])
    n, m = len(y), len(kept)
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())  # both labels count alike
    w, th = np.zeros(m), np.array([0.5, 1.5])
    v, tv, t = w.copy(), th.copy(), 1.0
    # step: the loss's curvature along the features is at most a quarter of the largest squared row norm seen
    step = 4.0 / max(1.0, np.sqrt(np.bincount(row, minlength=n).max()) * 8)

    def gradient(w: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.bincount(row, weights=w[col] * val, minlength=n)
        p0, p1 = _sigmoid(th[0] - score), _sigmoid(th[1] - score)
        d0, d1 = p0 * (1 - p0), p1 * (1 - p1)
        p = np.select([y == 0, y == 1], [p0, p1 - p0], 1 - p1)
        p = np.maximum(p, 1e-9)
        g0 = np.select([y == 0, y == 1], [d0, -d0], 0.0) / p
        g1 = np.select([y == 0, y == 1], [0.0, d1], -d1) / p
        by_score = weight * (g0 + g1)
        return np.bincount(col, weights=by_score[row] * val, minlength=m), -np.array([(weight * g0).sum(), (weight * g1).sum()])

    for _ in range(STEPS):
        gw, gt = gradient(v, tv)
        new = v - step * gw
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        new_th = np.sort(tv - step * gt)
        new_th[1] = max(new_th[1], new_th[0] + 1e-3)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, tv = new + (t - 1) / t2 * (new - w), new_th + (t - 1) / t2 * (new_th - th)
        tv[1] = max(tv[1], tv[0] + 1e-3)
        w, th, t = new, new_th, t2
    on = np.flatnonzero(w)
    return kept[on], w[on], th


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fits the model on at most ``sample`` documents of each label."""
    with_workers(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picks = [known.where(F.col("toxic") == k).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    picks = F.broadcast(picks[0].unionByName(picks[1]))  # at most 2 * sample rows of two numbers
    texts = docs.select("doc_id", "text").join(picks, "doc_id").groupBy("doc_id").agg(  # an id may be repeated
        F.first(F.col("toxic").cast("int")).alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text")
    )
    rows = texts.mapInArrow(_features, "doc_id long, toxic int, slots array<int>, vals array<float>").toArrow().combine_chunks()
    rows = rows.sort_by([("toxic", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    slots, values = rows["slots"].combine_chunks(), rows["vals"].combine_chunks()
    cuts, flat_s, flat_v = slots.offsets.to_numpy(), slots.values.to_numpy(), values.values.to_numpy()
    parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return fit(rows["toxic"].to_numpy(), [flat_s[p] for p in parts], [flat_v[p] for p in parts])


def severities(texts: pa.Array, dense: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected severity and the probability of grade 1 or more, for each text."""
    score, blank = np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    for first, raw, at in chunks(texts):
        words, n = Words(raw, at, NO_LETTER, latin=True), len(at) - 1
        n_words = np.diff(words.at)
        owner, slot = _slots(words)
        hit = dense[slot] != 0
        pairs, count = np.unique((owner[hit] << BITS) | slot[hit], return_counts=True)
        owner, slot = pairs >> BITS, pairs & ((1 << BITS) - 1)
        score[first : first + n] = np.bincount(owner, weights=dense[slot] * _values(slot, count, n_words[owner]), minlength=n)
        blank[first : first + n] = n_words == 0
    p1, p2 = 1 - _sigmoid(th[0] - score), 1 - _sigmoid(th[1] - score)
    p1[blank], p2[blank] = 0, 0
    return p1 + p2, p1


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], keep_harmless: bool = False, with_text: bool = True) -> DataFrame:
    """``docs`` with severity, grade and toxic; with ``keep_harmless`` only harmless documents, in their own columns."""
    spark = with_workers(docs.sparkSession)
    docs = docs.drop("severity", "grade", "toxic") if not keep_harmless else docs
    out = [c for c in docs.columns if with_text or c != "text"]
    shared = spark.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in out]
    if not keep_harmless:
        fields += [T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, th = shared.value
        dense = np.zeros(1 << BITS)
        dense[slots] = weights
        for batch in batches:
            severity, p = severities(batch.column("text"), dense, th)
            kept = pa.RecordBatch.from_arrays([batch.column(c) for c in out], names=out)
            if keep_harmless:
                yield kept.filter(pa.array(p < THRESHOLD))
            else:
                more = [pa.array(severity), pa.array(np.rint(severity).astype(np.int32)), pa.array(p >= THRESHOLD)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*out, "severity", "grade", "toxic"])

    return docs.mapInArrow(run, T.StructType(fields))


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")), with_text=False)
