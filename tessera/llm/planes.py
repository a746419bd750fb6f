"""Token ids in a binary file format of bit planes, and its reader.

Writing: documents are range-partitioned and sorted by (id, hash of the text), so a task gets a run of whole documents; it
encodes their whole texts with a public tokenizer, appends the end id and cuts the stream of ids, documents joined,
into blocks of ``BLOCK`` ids (the last of a file is shorter). A block is transposed into planes: ``bit`` planes hold one bit of every id,
``byte`` planes one byte, as many as its largest id needs. Each plane is compressed by itself with zstandard, as high planes are nearly constant.

A file, all numbers little-endian:

* magic ``TPL1``, then the planes of all blocks one after another;
* the chunk index, zstandard: for each block its place in the file, its number of ids, its number of planes, the CRC-32 of its ids; then the sizes of all planes;
* the document index, zstandard: the ids of the documents, whether each is null, and their numbers of ids;
* the tail: sizes of both indexes, numbers of blocks and documents, ids in a full block, bits in a plane (1 or 8), magic.

So a reader finds the block of any token by division, and reads no other. Files are written under temporary names with a random part; the
rows that the successful tasks return are the manifest, in it files stand in the order of their documents. They are renamed (harmless to repeat),
then the manifest is written, and what is left under temporary names is removed. A reader trusts what the manifest lists.

Defined results: a null text is an empty one and has the end id only; a null id comes first; rows with equal ids are documents of their
own in the order of the hashes of their texts; an empty table writes no file; columns but the id and the text are not read, whatever their names.
The longest text bounds the memory of a task, beside one block and the index of its documents. Where a tokenizer keeps words apart, as the default one
does, no token spans two words, or a word and the signs at its end; then each distinct one of a span of texts is encoded once, which gives the same ids
(a probe decides, tests compare).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, materialise, shared_dir, table, with_workers

BLOCK = 1 << 16
END_ID = 1
LEVEL = 3
MAGIC = b"TPL1"
#: Texts that are encoded at a time, in bytes; a longer text is encoded by itself.
SPAN = 4 << 20
_TAIL = struct.Struct("<QQQQII4s")
_CHUNK = np.dtype([("place", "<u8"), ("ids", "<u4"), ("planes", "<u4"), ("crc", "<u4")])
_TEMP = "_temporary_ids"

MANIFEST = "shard int, temp string, file string, documents long, tokens long, bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_MANIFEST = pa.schema([("shard", pa.int32()), ("temp", pa.string()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block, from the lowest on; ``bits`` is 1 or 8."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    width = int(ids.max()).bit_length() if len(ids) else 0
    octets = ids.view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [octets[:, k].tobytes() for k in range(-(-width // 8))]
    return [np.packbits(octets[:, k // 8] >> (k % 8) & 1, bitorder="little").tobytes() for k in range(width)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    octets = np.zeros((n, 4), dtype=np.uint8)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, dtype=np.uint8)
        if bits == 8:
            octets[:, k] = raw
        else:
            octets[:, k // 8] |= np.unpackbits(raw, count=n, bitorder="little") << (k % 8)
    return octets.view("<u4").ravel()


class PlaneWriter:
    """Writes one file: ``add`` takes the ids of the next document."""

    def __init__(self, sink, block: int = BLOCK, bits: int = 1):
        if bits not in (1, 8):
            raise ValueError("a plane holds 1 or 8 bits of an id")
        self.sink, self.block, self.bits = sink, block, bits
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[np.ndarray] = []
        self.waiting = self.tokens = 0
        self.chunks: list[tuple] = []
        self.sizes: list[int] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.size = sink.write(MAGIC) and len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        self.tokens += len(ids)
        if self.waiting >= self.block:
            stream = np.concatenate(self.held)
            whole = len(stream) // self.block * self.block
            for at in range(0, whole, self.block):
                self._write(stream[at : at + self.block])
            self.held, self.waiting = [stream[whole:].copy()], len(stream) - whole

    def _write(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.bits)]
        self.chunks.append((self.size, len(ids), len(planes), zlib.crc32(ids.astype("<u4").tobytes())))
        self.sizes += map(len, planes)
        self.sink.write(b"".join(planes))
        self.size += sum(map(len, planes))

    def close(self) -> None:
        if self.waiting:
            self._write(np.concatenate(self.held))
        index = self.zip.compress(np.array(self.chunks, dtype=_CHUNK).tobytes() + np.array(self.sizes, dtype="<u4").tobytes())
        null = np.array([x is None for x in self.ids], dtype=np.uint8)
        names = np.array([x or 0 for x in self.ids], dtype="<i8")
        documents = self.zip.compress(names.tobytes() + null.tobytes() + np.array(self.lengths, dtype="<u8").tobytes())
        tail = _TAIL.pack(len(index), len(documents), len(self.chunks), len(self.ids), self.block, self.bits, MAGIC)
        self.sink.write(index + documents + tail)
        self.size += len(index) + len(documents) + len(tail)
        self.sink.close()


class PlaneReader:
    """Random access to one file by its chunk index."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.source = store.open_input_file(path)
        self.unzip = zstandard.ZstdDecompressor()
        end = self.source.size()
        index, documents, blocks, n, self.block, self.bits, magic = _TAIL.unpack(self._at(end - _TAIL.size, _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of token planes")
        raw = self.unzip.decompress(self._at(end - _TAIL.size - documents - index, index))
        self.chunks = np.frombuffer(raw, _CHUNK, blocks)
        self.sizes = np.frombuffer(raw, "<u4", offset=blocks * _CHUNK.itemsize)
        self.first = np.concatenate([[0], np.cumsum(self.chunks["planes"])]).astype(np.int64)
        raw = self.unzip.decompress(self._at(end - _TAIL.size - documents, documents))
        names, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n)
        self.doc_ids = [None if gone else int(x) for x, gone in zip(names, null, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u8", n, 9 * n))]).astype(np.int64)

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def chunk(self, k: int) -> np.ndarray:
        """The ids of block ``k``, checked."""
        place, n, _, crc = (int(x) for x in self.chunks[k])
        sizes = self.sizes[self.first[k] : self.first[k + 1]]
        raw = self._at(place, int(sizes.sum()))
        cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ids = from_planes([self.unzip.decompress(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], n, self.bits)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is broken")
        return ids

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the place ``start`` of this file on: only their blocks are read."""
        if n <= 0:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        return np.concatenate([self.chunk(k) for k in range(first, last + 1)])[start - first * self.block :][:n]

    def documents(self) -> Iterator[tuple]:
        """(doc_id, start in this file, number of ids, CRC-32 of the ids); one block is in memory, however long a document is."""
        held, at, k = np.zeros(0, "<u4"), 0, 0
        for doc_id, start, end in zip(self.doc_ids, self.starts[:-1], self.starts[1:], strict=True):
            crc, left = 0, int(end - start)
            while left:
                if at == len(held):
                    held, at, k = self.chunk(k), 0, k + 1
                part = held[at : at + left]
                crc = zlib.crc32(part.tobytes(), crc)
                at, left = at + len(part), left - len(part)
            yield doc_id, int(start), int(end - start), crc


#: ASCII signs that end a word but belong to no mark of a contraction and no special token; and what may stand before them.
_SIGNS = ".,;:!?*&%$#"
_BEFORE = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789\u00e0\u00e1\u00e2\u00e3\u00e4\u00e7\u00e8\u00e9\u00ea\u00eb\u00ed\u00ee\u00ef\u00f1\u00f3\u00f4\u00f6\u00fa\u00fb\u00fc\u00df")
#: Stands between words that are encoded together; a word that holds it is encoded by itself.
_MARK = "\0"


class Encoder:
    """Encodes whole texts. Where the tokenizer allows it (``pieces``), words between ASCII white space, and signs that end a
    word, are encoded by themselves and each distinct one once: most of a corpus are repeated. They are kept, up to ``KEPT`` at a time."""

    KEPT = 600_000

    def __init__(self, path: str, pieces: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces = Tokenizer.from_file(path), pieces
        mark = self.ids([_MARK])[0] if pieces else []
        self.mark = mark[0] if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.length, self.start = {"": 0}, [], [np.zeros(1, np.int64)], 0

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of new words, many of which are encoded as one text."""
        plain = [w for w in words if _MARK not in w] if self.mark is not None else []
        for at in range(0, len(plain), 200):
            part = plain[at : at + 200]
            ids = np.array(self.ids([f" {_MARK} ".join(part)])[0], dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                raise ValueError("this tokenizer does not keep words apart")
            self._add(part, np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
        rest = [w for w in words if _MARK in w] if self.mark is not None else words
        if rest:
            found = self.ids(rest)
            self._add(rest, np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)))

    def _add(self, words: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.flat.append(ids)
        self.length.append(length)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (no nulls)."""
        if not self.pieces:
            yield from (np.array(ids, dtype="<u4") for ids in self.ids(texts.to_pylist()))
            return
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > self.KEPT:
            self._forget()
        cores = [w.rstrip(_SIGNS) for w in words]
        cores = [c if c and c[-1] in _BEFORE else w for c, w in zip(cores, words, strict=True)]
        signs = [w[len(c) :] for c, w in zip(cores, words, strict=True)]
        if new := list(dict.fromkeys(w for w in chain(cores, signs) if w not in self.known)):
            self._learn(new)
            self.flat, self.length = [np.concatenate(self.flat)], [np.concatenate(self.length)]
        length = self.length[0]
        start, every = np.cumsum(length) - length, self.flat[0] if self.flat else np.zeros(0, "<u4")
        pair = np.array([[self.known[w] for w in side] for side in (cores, signs)], dtype=np.int64).reshape(2, -1).T
        index = pair[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        n = length[index]
        end = np.concatenate([[0], np.cumsum(n)])
        ids = every[np.repeat(start[index] - end[:-1], n) + np.arange(end[-1])]
        cuts = end[2 * np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield ids[a:b]


@lru_cache(maxsize=1)
def _encoder(path: str, pieces: bool) -> Encoder:
    """The encoder of a Python worker: the tasks that it runs one after another share what it knows."""
    return Encoder(path, pieces)


def keeps_words_apart(path: str) -> bool:
    """Whether the tokenizer file gives for a text what it gives for its words and the signs at their ends, one after another."""
    encoder = Encoder(path, pieces=False)
    probe = " It's\tone  \x0b3.5% of\r\n\x0c\x0cdon't. \n\n <|endoftext|>x e\u0301 \u0301a\u00a0b \u6f22\u5b57\u3000\U0001f600 \u03a3\u03a3 . ... 's \0 a\0b " + " ".join(f"Word{x} {y}{x}{x}" for x in _SIGNS for y in "a9\u00e9")
    whole, split = encoder.ids([probe, *probe.split(" ")])[0], encoder.ids(probe.split())
    signs = all(encoder.ids([f"{y}{x}{x}"])[0] == [*encoder.ids([y])[0], *encoder.ids([x + x])[0]] for x in _SIGNS for y in sorted(_BEFORE))
    return signs and whole == [x for ids in split for x in ids]


def _spans(texts: pa.Array, span: int) -> Iterator[pa.Array]:
    """Runs of about ``span`` bytes of whole texts."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + span, side="right")))
        yield texts.slice(at, to - at)
        at = to


def _writer(out: str, path: str, pieces: bool, block: int, bits: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        shard, writer, encoder = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if writer is None and batch.num_rows:
                name = f"ids-{shard:06d}.planes"
                temp = f"{_TEMP}/{name}.{uuid4().hex}"
                store.create_dir(f"{root}/{_TEMP}", recursive=True)
                writer, encoder = PlaneWriter(store.open_output_stream(f"{root}/{temp}", compression=None), block, bits), _encoder(path, pieces)
            names = iter(batch.column("doc_id").to_pylist())
            for texts in _spans(batch.column("text").fill_null(""), SPAN):
                for ids in encoder.encode(texts):
                    writer.add(next(names), np.append(ids, np.uint32(end_id)))
        rows = []
        if writer:
            writer.close()
            rows = [(shard, temp, name, len(writer.ids), writer.tokens, writer.size)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_MANIFEST)], schema=_MANIFEST)

    return run


def _renamer(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        for batch in batches:
            for temp, name in zip(batch.column("temp").to_pylist(), batch.column("file").to_pylist(), strict=True):
                if store.get_file_info(f"{root}/{temp}").type != fs.FileType.NotFound:
                    store.move(f"{root}/{temp}", f"{root}/{name}")
            yield batch

    return run


def _dealt(manifest: DataFrame) -> DataFrame:
    """A row a file, in so many partitions that each core has some; AQE does not merge them."""
    files = manifest.count()
    return manifest.repartitionByRange(max(1, min(files, 4 * manifest.sparkSession.sparkContext.defaultParallelism, 100_000)), "shard")


def write_ids(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID, block: int = BLOCK, bits: int = 1) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes the ids below the URI ``out``, which all executors share; returns the manifest."""
    spark = with_workers(docs.sparkSession)
    # the row number deals equal rows to several tasks; which of them comes first does not matter
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    dealt = keyed.repartitionByRange("doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "_row").select("doc_id", "text")
    path = tokenizer or tokenizer_path()
    written = materialise(dealt.mapInArrow(_writer(out, path, keeps_words_apart(path), block, bits, end_id), MANIFEST))
    _dealt(written).mapInArrow(_renamer(out), MANIFEST).write.mode("overwrite").parquet(f"{out}/manifest")
    store, root = fs.FileSystem.from_uri(out)
    if store.get_file_info(f"{root}/{_TEMP}").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/{_TEMP}")
    forget(written)
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """A row for each document of the files below ``out``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    with_workers(spark)
    # a row a file: small, however many documents there are
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest").withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = [(d, start + s, n, crc) for d, s, n, crc in PlaneReader(store, f"{root}/{name}").documents()]
                for at in range(0, len(rows), 5000):
                    part = rows[at : at + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], f.type) for k, f in enumerate(_DOCUMENTS)], schema=_DOCUMENTS)

    return _dealt(manifest).mapInArrow(run, DOCUMENTS)


def op12_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark)
    write_ids(table(spark, sf_dir, "documents"), out)
    return read_ids(spark, out)
