"""An index of search documents in immutable segments, with bitmaps of items for each posting.

A segment holds the documents that were indexed together, and for each posting and each block of 32768 ids one bitmap. Indexing a batch
writes one more segment with the batch's documents only, and for each of them the number of that segment: in older ones the document
is no longer alive. Readers join all segments that one entry of the commit log names. ``compact`` rewrites segments as one when deltas have become many or large.

A token is found by the intersection of the bitmaps of all its postings; only items in it are looked up and, for long tokens, verified by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workers import free, stored
from .commits import CommitLog, Entry, retried
from .search import FEW_POSTINGS, PUSHED_POSTINGS, token_postings

SPAN = 1 << 15  # ids of a block, as Spark's bitmap functions have it
#: ``compact`` merges when there are more segments than this, or when deltas hold more than this share of the documents.
MOST_SEGMENTS, MOST_SHARE = 8, 0.2
#: Up to so many items of long tokens are broadcast to the texts that verify them; more are joined by id.
FEW_HITS = 200_000


def bitmaps(docs: DataFrame) -> DataFrame:
    """(posting, block, bits) of search documents, as ``postings`` has them.

    Documents are dealt by block, not their many postings: a task holds one block of at most ``SPAN`` documents and makes all its bitmaps.
    Of words only the first two characters go along."""
    heads = F.array_distinct(F.transform("words", lambda w: F.substring(w, 1, 2)))
    rows = docs.select(F.bitmap_bucket_number("item_id").alias("block"), F.bitmap_bit_position("item_id").cast("int").alias("at"), "title_folded", "keywords_folded", "grams", heads.alias("words"))
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_blocks, "posting string, block long, bits binary")


#: A posting as one number: three characters of 21 bits each (0: none); the first place marks grams and beginnings of words.
_GRAM, _HEAD = 0x1FFFFE, 0x1FFFFF


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, one higher and followed by zeros; where each text begins and ends."""
    texts = [t or "" for t in texts.to_pylist()]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return np.concatenate([points + 1, np.zeros(3, np.int64)]), np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]]), ends


def _code(points: np.ndarray, at: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    code = np.zeros(len(at), np.int64)
    for k in range(n):
        code = code << 21 | np.where(at + k < end, points[np.minimum(at + k, len(points) - 1)], 0)
    return code


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(posting, place in the block) of documents."""
    place, codes, owners = batch.column("at").to_numpy(), [], []
    for name in ("title_folded", "keywords_folded"):
        points, start, end = _points(batch.column(name))
        n = np.maximum(end - start - 2, 1)
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[owner]
        codes.append(_code(points, at, end[owner], 3))
        owners.append(owner)
    for name, mark, sizes in (("grams", _GRAM, (2,)), ("words", _HEAD, (1, 2))):
        lists = batch.column(name)
        points, start, end = _points(lists.flatten())
        for n in sizes:
            codes.append(mark << 42 | _code(points, start, np.minimum(end, start + n), n) << 21 * (2 - n))
            owners.append(np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy()))
    code, owner = np.concatenate(codes), np.concatenate(owners)
    return code, place[owner].astype(np.int16)


def _name(code: int) -> str:
    first, *rest = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
    kind, points = {_GRAM: ("c:", rest), _HEAD: ("p:", rest)}.get(first, ("t:", [first, *rest]))
    return kind + "".join(chr(x - 1) for x in points if x)


def _block(block: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    coded = pa.array(np.concatenate([c for c, _ in pairs])).dictionary_encode()
    names = [_name(c) for c in coded.dictionary.to_pylist()]
    key = np.sort(coded.indices.to_numpy().astype(np.int64) * SPAN + np.concatenate([p for _, p in pairs]))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    size = SPAN // 8
    for a in range(0, len(names), 1024):
        part = key[slice(*np.searchsorted(key, [a * SPAN, (a + 1024) * SPAN]))] - a * SPAN
        n = min(1024, len(names) - a)
        bits = np.bincount(part >> 3, weights=1 << (part & 7), minlength=n * size).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(names[a : a + n]), pa.array(np.full(n, block)), pa.array([bits[k * size : (k + 1) * size] for k in range(n)], pa.binary())], names=["posting", "block", "bits"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, last = [], None
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and blocks[a] != last:
                yield from _block(last, held)
                held = []
            last = int(blocks[a])
            held.append(_pairs(batch.slice(a, b - a)))
    if held:
        yield from _block(last, held)


def members(bits: str, block: str) -> Column:
    """The ids in a bitmap, as an array."""
    octet = "cast(conv(hex(substring({0}, i + 1, 1)), 16, 10) as int)".format(bits)
    at = f"flatten(transform(filter(sequence(0, {SPAN // 8 - 1}), i -> substring({bits}, i + 1, 1) != X'00'), i -> transform(filter(sequence(0, 7), j -> shiftright({octet}, j) % 2 = 1), j -> i * 8 + j)))"
    return F.expr(f"transform({at}, x -> CASE WHEN {block} > 0 THEN ({block} - 1) * {SPAN} + x + 1 ELSE {block} * {SPAN} - x END)")


class SegmentIndex:
    """Search documents (``build_search_docs``) and their postings below a commit log."""

    def __init__(self, log: CommitLog):
        self.log = log

    def add(self, docs: DataFrame) -> Entry:
        """Indexes documents; those with ids that are there already take the place of the old ones."""
        def attempt() -> Entry:
            base = self.log.head()
            return self._commit(base, int(base.notes.get("next segment", 0)), docs, {})

        return retried(attempt)

    def remove(self, ids: DataFrame) -> Entry:
        """Takes items (item_id) out of the index."""
        def attempt() -> Entry:
            base = self.log.head()
            number = int(base.notes.get("next segment", 0))
            gone = self.log.write("gone", ids.select("item_id", F.lit(number).alias("alive_from")).distinct(), str(number))
            return self.log.commit(base, {"gone": gone}, **{"next segment": number + 1})

        return retried(attempt)

    def _commit(self, base: Entry, number: int, docs: DataFrame, drop: dict[str, dict[str, None]]) -> Entry:
        name = str(number)
        stored_docs = docs.withColumn("segment", F.lit(number))
        new_docs = self.log.write("docs", stored_docs, name)
        free(self.log.spark)
        mine = self.log.spark.read.schema(stored_docs.schema).parquet(f"{self.log.path}/{new_docs[name]}")
        index = bitmaps(mine).sortWithinPartitions("posting").withColumn("segment", F.lit(number))
        gone = mine.select("item_id", F.col("segment").alias("alive_from"))
        parts = {"docs": new_docs, "postings": self.log.write("postings", index, name), "gone": {} if drop else self.log.write("gone", gone, name)}
        free(self.log.spark)
        schemas = {"docs": mine.schema, "postings": index.schema, "gone": gone.schema}
        changes = {t: {**drop.get(t, {}), **p} for t, p in parts.items()}
        sizes = {k: v for k, v in dict(base.notes.get("sizes", {})).items() if k not in drop.get("docs", {})} | {name: mine.count()}
        return self.log.commit(base, changes, schemas, **{"next segment": number + 1, "sizes": sizes})

    def _alive(self, rows: DataFrame, at: Entry) -> DataFrame:
        """Of rows (segment, item_id) those that no later segment has replaced or removed."""
        parts = at.tables.get("gone", {})
        if len(at.tables.get("docs", {})) <= 1 and set(parts) <= set(at.tables.get("docs", {})):
            return rows  # one segment, nothing replaced
        newest = self.log.read("gone", at).groupBy("item_id").agg(F.max("alive_from").alias("alive_from"))
        return rows.join(newest, "item_id", "left").where(F.col("segment") >= F.coalesce("alive_from", F.lit(-1))).drop("alive_from")

    def docs(self, at: Entry | None = None) -> DataFrame:
        """All documents, one an item."""
        at = at or self.log.head()
        return self._alive(self.log.read("docs", at), at).drop("segment")

    def hits(self, tokens: DataFrame, at: Entry | None = None) -> DataFrame:
        """(token, item_id) for distinct ``tokens`` (token)."""
        at = at or self.log.head()
        wanted = token_postings(tokens)
        index = self.log.read("postings", at)
        asked = wanted.select("posting").distinct()
        names = [r["posting"] for r in asked.limit(PUSHED_POSTINGS + 1).collect()]
        if 0 < len(names) <= PUSHED_POSTINGS:  # equalities reach the scan, which skips pages of sorted segments
            index = index.where(reduce(lambda a, b: a | b, (F.col("posting") == n for n in names)))
        else:
            index = index.join(F.broadcast(asked) if asked.count() <= FEW_POSTINGS else asked, "posting", "left_semi")
        due = wanted.groupBy("token").agg(F.count("*").alias("due"))
        met = wanted.join(due, "token").join(index, "posting").groupBy("token", "verify", "due", "segment", "block")
        # stored, as Spark would take the few bitmaps' size for that of all the items in them and send these to the driver for a broadcast
        met = stored(met.agg(F.count("*").alias("n"), F.expr("bitmap_and_agg(bits)").alias("bits")).where("n = due and bitmap_count(bits) > 0").select("token", "verify", "segment", "block", "bits"))
        few = (met.where("verify").agg(F.sum(F.bitmap_count("bits"))).first()[0] or 0) <= FEW_HITS
        found = self._alive(met.select("token", "verify", "segment", F.explode(members("bits", "block")).alias("item_id")), at)
        texts = self.log.read("docs", at).select("segment", "item_id", "title_folded", "keywords_folded")
        long = found.where("verify").select("token", "segment", "item_id")
        low = F.lower("token")
        checked = (F.broadcast(long) if few else long.hint("merge")).join(texts, ["segment", "item_id"]).where(F.contains("title_folded", low) | F.contains("keywords_folded", low))
        return checked.select("token", "item_id").unionByName(found.where("not verify").select("token", "item_id"))

    def compact(self, force: bool = False) -> Entry:
        """Rewrites segments as one if deltas have become many or large; readers of older entries keep their segments."""
        def attempt() -> Entry:
            base = self.log.head()
            sizes = dict(base.notes.get("sizes", {}))
            if len(sizes) < 2 or not (force or len(sizes) > MOST_SEGMENTS or sum(sizes.values()) - max(sizes.values()) > MOST_SHARE * max(sizes.values())):
                return base
            drop = {t: dict.fromkeys(parts) for t, parts in base.tables.items()}
            return self._commit(base, int(base.notes["next segment"]), self.docs(base), drop)

        return retried(attempt)
