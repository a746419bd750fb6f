"""Hard-negative mining with an inverted multi-index.

Vectors become whole numbers (``floor(scale * x)``) and are split in two halves. Two codebooks, one a half, are fitted on a bounded sample;
a pair of codewords is a cell, and every vector lies in one. The score of an anchor a with any vector of a cell is at most the sum of two half-scores,
a_h * c_h + |a_h| * radius_h, where the radius is the largest distance of a member from its codeword. The multi-sequence algorithm, a heap over
both halves' sorted bounds, visits cells by falling sums; a search stops when the next sum lies below what it still needs, so its result is certified and
does not depend on codebooks or samples, which only decide how soon it stops.

Rows are range-partitioned by cell and row number into blocks of bounded size, so a hot cell spans many blocks. The task that writes a block finds the best positives
that the block's own anchors have within it: a floor for their search. The heap over all cells (their radii and blocks are a table bounded by the
codebooks) then names the blocks that an anchor must see, and the anchor is sent to those; a task holds one block, with radii of its own, and
takes one anchor after the other. First the best ``positives`` rows of an anchor's label are merged from the blocks. Each one opens a window of
scores, ``low`` to ``high`` percent of its own; in a second round blocks return the best rows of other labels within each window, stopping as soon as every window
is full or above all that is left. Anchors are a stated set of queries against all rows, in blocks; only the few rows that a block can
contribute for an anchor are returned, never pairs.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; components beyond a long, and scores beyond it, count as the nearest long;
only vectors of equal length are compared; a null id comes last in ties and is no anchor; rows that share an id are rows of their own, each other's candidates too;
an empty vector scores 0; a positive with a negative score has an empty window; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, materialise, table, with_workers

CODEWORDS = 32
#: At most so many rows are the sample on which codebooks are fitted, of the so many most frequent lengths of vectors.
SAMPLE, LENGTHS = 16_384, 8
BLOCK = 16_384  # rows of a block, about
STEP = 4_096  # rows that are scored at a time
SEED = 42
_LAST = int(np.iinfo(np.int64).max)


# ---------------------------------------------------------------- codebooks and cells

def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` centres of the rows by Lloyd's algorithm."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(10):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


class Codebooks:
    """A pair of codebooks for each length of vectors; a length without one has the zero vector for its only codeword."""

    def __init__(self, samples: dict[int, np.ndarray], k: int = CODEWORDS):
        self.known = sorted(samples)
        self.pairs = {d: tuple(codebook(h, min(k, len(x))) for h in halves(x)) for d, x in samples.items()}

    def pair(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        return self.pairs.get(dim) or tuple(np.zeros((1, n)) for n in (dim // 2, dim - dim // 2))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first codeword, second codeword, distances from both) of the rows."""
        near = [nearest(h, c) for h, c in zip(halves(x), self.pair(x.shape[1]), strict=True)]
        far = [np.sqrt(((h - c[n]) ** 2).sum(1)) for h, c, n in zip(halves(x), self.pair(x.shape[1]), near, strict=True)]
        return near[0], near[1], far[0], far[1]


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All (first[i] + second[j], i, j) from the largest sum on."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y = [float(first[i]) for i in a], [float(second[j]) for j in b]
    heap = [(-(x[0] + y[0]), 0, 0)] if x and y else []
    while heap:
        negative, p, q = heapq.heappop(heap)
        yield -negative, a[p], b[q]
        if q + 1 < len(y):
            heapq.heappush(heap, (-(x[p] + y[q + 1]), p, q + 1))
        if q == 0 and p + 1 < len(x):  # each place has one predecessor
            heapq.heappush(heap, (-(x[p + 1] + y[0]), p + 1, 0))


def half_bounds(anchor: np.ndarray, books: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Upper bounds of both half-scores for every codeword, a little more than rounding may take."""
    out = []
    for h, c, r in zip((anchor[: len(anchor) // 2], anchor[len(anchor) // 2 :]), books, radii, strict=True):
        middle, span = c @ h, np.sqrt(h @ h) * r
        out.append(middle + span + 1e-9 * (np.abs(middle) + span + np.sqrt(h @ h) * np.sqrt((c * c).sum(1))) + 1e-6)
    return out


# ---------------------------------------------------------------- vectors in transit

def pack(x: np.ndarray) -> list[bytes]:
    """Rows of long integers, two bytes a component where all fit."""
    small = (np.abs(x.astype(np.float64)) < 32_000).all(1)
    return [(v.astype("<i2") if s else v).tobytes() for v, s in zip(x, small, strict=True)]


def unpack(raw: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(raw), dim), dtype=np.int64)
    for size, kind in ((2 * dim, "<i2"), (8 * dim, "<i8")):
        at = [k for k, r in enumerate(raw) if len(r) == size]
        if at and dim:
            out[at] = np.frombuffer(b"".join(raw[k] for k in at), dtype=kind).reshape(len(at), dim)
    return out


class Block:
    """The rows of a block that have one length, in the order of their cells, with radii of their own."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, label: np.ndarray, ids: np.ndarray, books: Codebooks):
        """``rows`` are row numbers; of a row without id ``ids`` has the largest long."""
        self.books = books.pair(x.shape[1])
        f = x.astype(np.float64)
        i, j, far_i, far_j = books.cells(f)
        order = np.lexsort((j, i))
        self.x, self.rows, self.label, self.ids = x[order], rows[order], label[order], ids[order]
        self.f = f[order]
        self.most = float(np.abs(self.f).max(initial=0))
        self.radii = tuple(np.full(len(c), -np.inf) for c in self.books)  # of codewords without rows
        np.maximum.at(self.radii[0], i, far_i)
        np.maximum.at(self.radii[1], j, far_j)
        i, j = i[order], j[order]
        cuts = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        ends = [*cuts[1:].tolist(), len(i)]
        self.where = {(int(i[a]), int(j[a])): (a, b) for a, b in zip(cuts.tolist(), ends, strict=True)}
        self.present = [np.flatnonzero(np.isfinite(r)) for r in self.radii]

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products as longs."""
        if len(anchor) * self.most * float(np.abs(anchor.astype(np.float64)).max(initial=0)) < 2**53:
            return np.rint(self.f[at] @ anchor.astype(np.float64)).astype(np.int64)
        exact = self.x[at].astype(object) @ anchor.astype(object)
        return np.array([min(max(int(v), -_LAST), _LAST) for v in np.atleast_1d(exact)], dtype=np.int64)

    def visit(self, anchor: np.ndarray) -> Iterator[tuple[float, np.ndarray | None]]:
        """(bound of all rows not yet returned, the next rows), from the best cells on, in steps of about ``STEP`` rows."""
        first, second = half_bounds(anchor.astype(np.float64), [c[p] for c, p in zip(self.books, self.present, strict=True)], [r[p] for r, p in zip(self.radii, self.present, strict=True)])
        held, size, top = [], 0, None
        left, right = self.present[0].tolist(), self.present[1].tolist()
        for bound, p, q in multi_sequence(first, second):
            span = self.where.get((left[p], right[q]))
            if span is None:
                continue
            if top is None:
                top = bound
            held.append(np.arange(*span))
            size += span[1] - span[0]
            if size >= STEP:
                yield top, np.concatenate(held)
                held, size, top = [], 0, None
        if held:
            yield top, np.concatenate(held)

    def best_of_label(self, row: int, anchor: np.ndarray, label: int, n: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, places) of the ``n`` best other rows of the label that score ``floor`` or more."""
        best, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for bound, rows in self.visit(anchor):
            if bound < floor:
                break
            rows = rows[(self.label[rows] == label) & (self.rows[rows] != row)]
            score = self.scores(anchor, rows)
            best, at = self._merge(best, at, score[score >= floor], rows[score >= floor], n)
            if len(best) == n:
                floor = max(floor, int(best[-1]))
        return best, at

    def best_in_windows(self, anchor: np.ndarray, label: int, n: int, windows: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, places) of the ``n`` best rows of other labels for each window of scores (both ends within)."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        need = [low for low, _ in windows]
        for bound, rows in self.visit(anchor):
            if bound < min(need):
                break
            rows = rows[self.label[rows] != label]
            score = self.scores(anchor, rows)
            for w, (_, high) in enumerate(windows):
                some = (score >= need[w]) & (score <= high)
                if some.any():
                    found[w] = self._merge(*found[w], score[some], rows[some], n)
                    if len(found[w][0]) == n:
                        need[w] = int(found[w][0][-1])
        return found

    def _merge(self, best: np.ndarray, at: np.ndarray, score: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        best, at = np.concatenate([best, score]), np.concatenate([at, rows])
        if len(best) > 4 * n + 64:  # more than a sort needs to see
            line = np.partition(best, len(best) - n)[len(best) - n]
            best, at = best[best >= line], at[best >= line]
        order = np.lexsort((self.rows[at], self.ids[at], -best))[:n]
        return best[order], at[order]


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores from ``low`` to ``high`` percent of ``score``."""
    return -(-low * score // 100), high * score // 100


# ---------------------------------------------------------------- stages

_ROW = "row long, id long, label long, dim int, x binary"
_INDEXED = f"{_ROW}, asks boolean, first int, second int, far_first double, far_second double, block int, floor double"
_SENT = f"{_ROW}, block int, floor double"
_FOUND = pa.schema([("anchor", pa.int64()), ("of", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])


def _types(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False)


def _packer():
    schema = _types(_ROW + ", asks boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("x").offsets.to_numpy()
            flat = batch.column("x").values.to_numpy(zero_copy_only=False)
            dims, raw = np.diff(at), [b""] * batch.num_rows
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = np.stack([flat[at[r] : at[r + 1]] for r in rows]) if len(rows) else np.zeros((0, dim), np.int64)
                for r, v in zip(rows, pack(x), strict=True):
                    raw[r] = v
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("label"), pa.array(dims.astype(np.int32)), pa.array(raw, pa.binary()), batch.column("asks")], schema=schema)

    return run


def _by_dim(rows: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    dims = rows["dim"].to_numpy()
    for dim in np.unique(dims):
        yield int(dim), rows.filter(pa.array(dims == dim)).combine_chunks()


def _celler(books: Codebooks):
    schema = _types(_ROW + ", asks boolean, first int, second int, far_first double, far_second double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_dim(pa.Table.from_batches([batch])):
                i, j, a, b = books.cells(unpack(rows["x"].to_pylist(), dim).astype(np.float64))
                columns = [*(rows[c].combine_chunks() for c in rows.column_names), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(a), pa.array(b)]
                yield from pa.Table.from_arrays(columns, schema=schema).to_batches()

    return run


def _block(rows: pa.Table, dim: int, books: Codebooks) -> Block:
    return Block(rows["row"].to_numpy(), unpack(rows["x"].to_pylist(), dim), rows["label"].to_numpy(), _ids(rows["id"].combine_chunks()), books)


def _indexer(books: Codebooks, positives: int):
    """The rows of a task are a block; adds its number and the floors of its own anchors."""
    schema = _types(_INDEXED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        number = TaskContext.get().partitionId()
        for dim, rows in _by_dim(pa.Table.from_batches(held)) if held else ():
            block, floors = _block(rows, dim, books), np.full(rows.num_rows, -np.inf)
            x = unpack(rows["x"].to_pylist(), dim)
            for k in np.flatnonzero(rows["asks"].to_numpy()):
                best, _ = block.best_of_label(rows["row"][k].as_py(), x[k], rows["label"][k].as_py(), positives, -np.inf)
                if len(best) == positives:
                    floors[k] = best[-1]
            out = rows.append_column("block", pa.array(np.full(rows.num_rows, number, np.int32))).append_column("floor", pa.array(floors))
            yield from pa.Table.from_arrays([out[c].combine_chunks() for c in schema.names], schema=schema).to_batches(max_chunksize=2000)

    return run


class Cells:
    """Radii of all codewords and the blocks of all cells, for each known length; its size is bounded by the codebooks."""

    def __init__(self, books: Codebooks, rows: list[tuple]):
        """``rows``: (length, or -1 for all unknown ones, first, second, both largest distances, first block, last block)."""
        self.books, self.blocks, self.radii = books, {}, {}
        for dim, i, j, far_i, far_j, start, end in rows:
            self.blocks.setdefault(dim, {})[i, j] = range(start, end + 1)
            if dim >= 0:
                radii = self.radii.setdefault(dim, tuple(np.full(len(c), -np.inf) for c in books.pair(dim)))
                radii[0][i], radii[1][j] = max(radii[0][i], far_i), max(radii[1][j], far_j)

    def route(self, anchor: np.ndarray, floor: float) -> list[int]:
        """The blocks that may hold a row with a score of ``floor`` or more."""
        dim = len(anchor)
        if dim not in self.radii:
            return sorted({b for span in self.blocks.get(-1, {}).values() for b in span})
        out: set[int] = set()
        present = [np.flatnonzero(np.isfinite(r)) for r in self.radii[dim]]
        bounds = half_bounds(anchor.astype(np.float64), [c[p] for c, p in zip(self.books.pair(dim), present, strict=True)], [r[p] for r, p in zip(self.radii[dim], present, strict=True)])
        left, right = present[0].tolist(), present[1].tolist()
        for bound, p, q in multi_sequence(*bounds):
            if bound < floor:
                break
            out.update(self.blocks[dim].get((left[p], right[q]), ()))
        return sorted(out)


def _router(cells: Cells):
    """Sends an anchor to the blocks that it must see."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, at = [], []
            for k, (raw, dim, floor) in enumerate(zip(batch.column("x").to_pylist(), batch.column("dim").to_pylist(), batch.column("floor").to_pylist(), strict=True)):
                blocks = cells.route(unpack([raw], dim)[0], floor)
                to += blocks
                at += [k] * len(blocks)
                if len(to) > 20_000:
                    yield _sent(batch, at, to)
                    to, at = [], []
            if to:
                yield _sent(batch, at, to)

    def _sent(batch: pa.RecordBatch, at: list[int], to: list[int]) -> pa.RecordBatch:
        out = batch.take(pa.array(at, pa.int64()))
        names = [n for n in out.schema.names if n != "block"]
        return pa.RecordBatch.from_arrays([*(out.column(n) for n in names), pa.array(to, pa.int32())], names=[*names, "block"])

    return run


def _searcher(books: Codebooks, ask):
    """Rows of a block, then its anchors; ``ask`` returns (what it is for, scores, places) of an anchor's finds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, blocks, out = None, [], None, []
        for batch in batches:
            numbers, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if numbers[a] != number:
                    number, held, blocks = numbers[a], [], None
                if kinds[a] == 0:
                    held.append(part)
                    continue
                if blocks is None:
                    blocks, held = ({d: _block(rows, d, books) for d, rows in _by_dim(pa.Table.from_batches(held))} if held else {}), []
                for anchor in part.to_pylist():
                    if block := blocks.get(anchor["dim"]):
                        for of, score, at in ask(block, anchor, unpack([anchor["x"]], anchor["dim"])[0]):
                            out += [(anchor["row"], of, int(s), None if block.ids[p] == _LAST else int(block.ids[p]), int(block.rows[p])) for s, p in zip(score, at, strict=True)]
                    if len(out) >= 10_000:
                        yield _found(out)
                        out = []
        yield _found(out)

    def _found(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_FOUND))], schema=_FOUND)

    return run


def _search(index: DataFrame, anchors: DataFrame, cells: Cells, blocks: int, ask) -> DataFrame:
    """What ``ask`` finds in all blocks that the ``anchors`` (with ``floor`` and ``windows``) must see: anchor, of, score, id, row."""
    schema = f"{_ROW}, floor double, windows array<bigint>, block int"
    sent = anchors.select("row", "id", "label", "dim", "x", "floor", "windows").mapInArrow(_router(cells), schema).withColumn("kind", F.lit(1))
    rows = index.select("row", "id", "label", "dim", "x", "block", F.lit(None).cast("double").alias("floor"), F.lit(None).cast("array<bigint>").alias("windows"), F.lit(0).alias("kind"))
    dealt = rows.unionByName(sent).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(_searcher(cells.books, ask), "anchor long, of long, score long, id long, row long")


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column, ident: Column, embedding: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0
) -> DataFrame:
    """For each row where ``anchor`` holds and each of its best rows of the same label: the best rows of other labels whose score lies in its window.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = with_workers(vectors.sparkSession)
    e = embedding.cast("array<double>")
    fine = F.coalesce(label.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    whole = F.transform(e, lambda v: F.floor(v * scale).cast("long"))
    number = label.cast("long") if vectors.select(label).schema[0].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(label)
    narrow = vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), ident.cast("long").alias("id"), number.alias("label"), whole.alias("x"), F.coalesce(anchor & ident.isNotNull(), F.lit(False)).alias("asks"))
    packed = materialise(narrow.mapInArrow(_packer(), _ROW + ", asks boolean"))

    lengths = packed.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    n, samples = packed.count(), {}
    for r in lengths:
        some = packed.where(F.col("dim") == r["dim"]).sample(min(1.0, 2.0 * SAMPLE / LENGTHS / r["n"]), seed=SEED).select("x").limit(SAMPLE // LENGTHS).collect()
        if some:
            samples[r["dim"]] = unpack([bytes(s["x"]) for s in some], r["dim"]).astype(np.float64)
    books = Codebooks(samples)

    blocks = max(1, math.ceil(n / BLOCK), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / 1024)))
    celled = packed.mapInArrow(_celler(books), _ROW + ", asks boolean, first int, second int, far_first double, far_second double")
    known = F.col("dim").isin(books.known)
    group = F.when(known, F.col("dim")).otherwise(-1)
    ordered = celled.repartitionByRange(blocks, group, "first", "second", "row")
    index = materialise(ordered.mapInArrow(_indexer(books, positives), _INDEXED))
    spans = index.groupBy(group.alias("dim"), "first", "second").agg(F.max("far_first"), F.max("far_second"), F.min("block"), F.max("block")).collect()  # bounded by the codebooks
    cells = Cells(books, [tuple(r) for r in spans])

    def ask_positives(block: Block, a: dict, x: np.ndarray):
        return [(0, *block.best_of_label(a["row"], x, a["label"], positives, a["floor"]))]

    def ask_negatives(block: Block, a: dict, x: np.ndarray):
        return zip(a["windows"], *zip(*block.best_in_windows(x, a["label"], negatives, [window(s, low, high) for s in a["windows"]]), strict=True), strict=True)

    anchors = index.where("asks").withColumn("windows", F.lit(None).cast("array<bigint>"))
    last = F.coalesce(F.col("id"), F.lit(_LAST))
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), last, "row")
    found = materialise(_search(index, anchors, cells, blocks, ask_positives))
    chosen = materialise(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    opened = chosen.where("positive_score >= 0").groupBy("anchor").agg(F.collect_set("positive_score").alias("windows"))
    least = F.array_min("windows").cast("double") * low / 100
    floor = least - 1 - F.abs(least) * 1e-9  # no score that a window needs lies below
    asking = index.where("asks").drop("floor").join(opened, F.col("row") == F.col("anchor")).withColumn("floor", floor)
    inside = Window.partitionBy("anchor", "of").orderBy(F.desc("score"), last, "row")
    mined = _search(index, asking, cells, blocks, ask_negatives).withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= negatives)
    names = index.where("asks").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = chosen.join(mined.select("anchor", F.col("of").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "positive_score"])
    out = materialise(out.join(names, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
    forget(packed, index, found, chosen)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, label, F.col("vec_id"), F.col("embedding"))


OP13_SQL = """
WITH rows_ AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.l = b.l AS same, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE a.vec_id % 50 = 0
),
positives AS (
  SELECT anchor, anchor_id, r, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER best)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW best AS (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST)
QUALIFY row_number() OVER best <= 3
"""
