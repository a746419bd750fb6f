"""The Merkle manifest against a plain tree, token files by round trips, hard negatives against all pairs."""

import hashlib
import io
import math
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, merkle, negatives, planes
from tessera.llm.queries import oracle_sql

# ---------------------------------------------------------------- Merkle manifest

DOCS = "text string, doc_id long, _g string, lang string, source string, n_chars long, digest int"


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _tree(digests):
    """The root, and what stands left and right of each leaf's ancestors."""
    paths, groups = [[] for _ in digests], [[k] for k in range(len(digests))]
    while len(digests) > 1:
        above, merged = [], []
        for a in range(0, len(digests), 3):
            run = digests[a : a + 3]
            for j, members in enumerate(groups[a : a + 3]):
                for m in members:
                    paths[m].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(_sha("".join(run)))
            merged.append(sum(groups[a : a + 3], []))
        digests, groups = above, merged
    return digests[0], paths


def _manifest(rows):
    def leaf(*values):
        return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    by_source = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        flat = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        by_source[source].append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, flat)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [_tree([x[1] for x in by_source[s]]) for s in order]
    root, above = _tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(order, trees, above, strict=True):
        for (doc_id, own, changed), path in zip(by_source[s], paths, strict=True):
            path, h = path + top, changed
            for left, right in path:
                h = _sha(left + h + right)
            out.append((doc_id, own, subroot, root, _sha("".join(a + b for a, b in path)), h, h == root))
    return out


def _documents(spark, tmp_path, rows):
    """``rows``: (doc_id, source, lang, n_chars, text), written in another order of columns with columns of the operator's own names."""
    spark.createDataFrame([(r[4], r[0], "own", r[2], r[1], r[3], 7) for r in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


MANIFESTS = {
    "one": [(5, "s", "en", 1, "a\nb")],
    "odd": [
        (None, None, None, None, None), (None, None, None, None, None), (3, "", "en", 0, ""), (3, "", "en", 0, "x\ny"), (-4, "é", None, 9, "é\n"), (9, "z", "de", None, "\n" * 50),
        (10, "=", "de", 1, "-"), (11, "=", "-", 1, None), (12, "=", "fr", 1, "w " * 100_000 + "\n"), (12, "=", "fr", 1, "w " * 100_000 + "\n"), (13, "Z", "fr", 1, "x"),
    ],
    "hot": [(k, "hot" if k % 10 else f"s{k % 370}", "en", k, f"text {k}\n") for k in range(1, 900)],
    "copies": [(7, "s", "en", 1, "same\n")] * 30,
}


@pytest.mark.parametrize("name", MANIFESTS)
def test_manifest(spark, tmp_path, name):
    sf = _documents(spark, tmp_path, MANIFESTS[name])
    got = sorted(map(tuple, merkle.op11_merkle_manifest(spark, sf).collect()), key=repr)
    assert got == sorted(_manifest(MANIFESTS[name]), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    if name != "copies" and name != "odd":  # the SQL tells documents of a source apart by their place, which equal rows share at random
        assert sorted(con.execute(oracle_sql()["op11_merkle_manifest"]).fetchall(), key=repr) == got


def test_manifest_of_nothing(spark, tmp_path):
    assert merkle.op11_merkle_manifest(spark, _documents(spark, tmp_path, [])).count() == 0


def test_layers_and_joins_of_paths(spark, monkeypatch):
    """More than one layer of blocks in documents and in sources, with joins in place of broadcasts; proofs lead to the root."""
    monkeypatch.setattr(merkle, "FEW_ROWS", 0)
    rows = spark.range(1300).select("id", F.concat(F.lit("s"), F.when(F.col("id") < 700, 0).otherwise(F.col("id"))).alias("source"))
    leaf = merkle.leaf(F.col("id"))
    out = merkle.merkle_manifest(rows, F.col("source"), F.col("id"), leaf, id=F.col("id"))
    bad = out.where((merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")) | (F.col("leaf") != leaf))
    assert out.count() == 1300 and bad.count() == 0
    digests = [_sha(f"{len(str(k))}:{k}") for k in range(700)]
    sources = sorted({f"s{0 if k < 700 else k}" for k in range(1300)})
    root, _ = _tree([_tree(digests)[0] if s == "s0" else _sha(f"{len(s) - 1}:{s[1:]}") for s in sources])
    assert {r[0] for r in out.select("root").distinct().collect()} == {root}


# ---------------------------------------------------------------- token ids

class _Kept(io.BytesIO):
    def close(self):
        self.kept = self.getvalue()


class _Store:
    def __init__(self, raw):
        self.raw = raw

    def open_input_file(self, _):
        source = io.BytesIO(self.raw)
        source.size = lambda: len(self.raw)
        return source


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("block", [1, 7, 64])
def test_planes(bits, block):
    rng = np.random.default_rng(block)
    docs = [(k if k % 5 else None, rng.integers(0, [1, 2, 50_000, 2**32][k % 4], size=int(rng.integers(0, 150))).astype("<u4")) for k in range(40)]
    sink = _Kept()
    writer = planes.PlaneWriter(sink, block, bits)
    for doc in docs:
        writer.add(*doc)
    writer.close()
    assert writer.size == len(sink.kept)
    reader, every = planes.PlaneReader(_Store(sink.kept), ""), np.concatenate([ids for _, ids in docs])
    starts = np.concatenate([[0], np.cumsum([len(ids) for _, ids in docs])])
    assert list(reader.documents()) == [(k, int(s), len(ids), zlib.crc32(ids.tobytes())) for (k, ids), s in zip(docs, starts, strict=False)]
    for start, n in [(0, 0), (0, 1), (5, 200), (len(every) - 1, 1), (0, len(every))]:
        assert (reader.tokens(start, n) == every[start : start + n]).all()
    broken = bytearray(sink.kept)
    broken[6] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017 the plane's own format or the block's checksum notices
        list(planes.PlaneReader(_Store(bytes(broken)), "").documents())
    with pytest.raises(ValueError):
        planes.PlaneReader(_Store(sink.kept[:-1] + b"x"), "")


def test_a_range_reads_its_blocks_only():
    sink = _Kept()
    writer = planes.PlaneWriter(sink, 100)
    writer.add(1, np.arange(1000, dtype="<u4"))
    writer.close()
    reader, read = planes.PlaneReader(_Store(sink.kept), ""), []
    chunk, reader.chunk = reader.chunk, lambda k: read.append(k) or chunk(k)
    assert reader.tokens(350, 100).tolist() == list(range(350, 450)) and read == [3, 4]


def test_token_files(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(planes.tokenizer_path())
    rows = [(k, f"Document {k}: " + "word " * (k % 50)) for k in range(300, 0, -1)]
    rows += [(None, None), (None, "no id"), (-5, ""), (7, "again <|endoftext|> é 漢字"), (7, "again <|endoftext|> é 漢字"), (1000, "long " * 100_000)]
    frame = spark.createDataFrame([(t, k, 1, 2) for k, t in rows], "text string, doc_id long, _hash int, _row int").repartition(5)
    out = common.shared_dir(spark)
    manifest = planes.write_ids(frame, out, block=1000)
    got = planes.read_ids(spark, out).orderBy("start").collect()
    want = {}
    for k, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(k, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    assert [r["doc_id"] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert manifest.agg(F.sum("documents"), F.sum("tokens")).first()[:] == (len(rows), sum(n for v in want.values() for n, _ in v))
    again = common.shared_dir(spark)  # rewriting gives the same documents at the same places
    planes.write_ids(frame.repartition(2), again, block=64, bits=8)
    assert [tuple(r) for r in planes.read_ids(spark, again).orderBy("start").collect()] == [tuple(r) for r in got]


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_pieces(name, drops):
    """Encoding word by word gives what encoding whole texts gives, if the tokenizer keeps words apart."""
    path, rng = planes.tokenizer_path(name), np.random.default_rng(1)
    assert planes.keeps_words_apart(path) == drops
    parts = [*"aZ9.'\u0301\u00e9\u03a3\u6f22\U0001f600\x1c\x85\u00a0\u200b\u3000<|>_", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r\n", "'s", "<|endoftext|>", "<|startoftext|>", "word", "don't", "\u2000", "\u0130", "x" * 300, ".", ",", "...", "!?", "\x00", " \x00 ", "'S", "e.", "a'", "%"]
    texts = ["", " ", *("".join(rng.choice(parts, size=int(rng.integers(1, 60)))) for _ in range(3000))]
    encoder, whole = planes.Encoder(path, drops), planes.Encoder(path, False)
    encoder.KEPT = 50
    got = [ids for span in planes._spans(pa.array(texts), 5000) for ids in encoder.encode(span)]
    assert [x.tolist() for x in got] == whole.ids(texts)


def test_token_files_of_nothing(spark):
    out = common.shared_dir(spark)
    assert planes.write_ids(spark.createDataFrame([], "doc_id long, text string"), out).count() == 0
    assert planes.read_ids(spark, out).count() == 0


# ---------------------------------------------------------------- hard negatives

def _mined(rows, positives=5, negatives_=3):
    able = [(k, v, (lab + 1) % 10 if k is not None and k % 7 == 0 else lab) for k, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    able = [(k, [math.floor(256 * float(np.float32(x))) for x in v], lab) for k, v, lab in able]
    last = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for n, (k, v, lab) in enumerate(able):
        if k is None or k % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other == lab) for m, (j, w, other) in enumerate(able) if m != n and len(w) == len(v)]
        for p, j, _ in sorted((x for x in scored if x[2]), key=last)[:positives]:
            inside = sorted((x for x in scored if not x[2] and 50 * p <= 100 * x[0] <= 95 * p), key=last)[:negatives_]
            out += [(k, j, r, x[1], p, x[0]) for r, x in enumerate(inside, 1)]
    return sorted(out, key=repr)


def _embeddings(spark, tmp_path, rows):
    schema = "label int, vec_id long, embedding array<float>, `row` int, x string, block int"
    spark.createDataFrame([(lab, k, v, 1, "own", 2) for k, v, lab in rows], schema).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def _rows(n, dim, seed, spread=0.3, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(k, [float(np.float32(x)) for x in centres[c] + spread * rng.normal(size=dim)], int(c) % labels) for k, c in enumerate(rng.integers(0, 12, n))]


NEGATIVES = {
    "clusters": _rows(700, 16, 1),
    "ties": [(k, [0.5, 0.25] if k % 3 else [0.25, 0.5], k % 2) for k in range(120)],
    "copies": [(k, [0.5, 0.5, 0.1], 1 if k % 2 else 2) for k in range(200)],
    "odd": [
        *_rows(130, 4, 2), (None, [0.5] * 4, 0), (None, [0.4] * 4, 1), (150, None, 1), (200, [0.1, None, 0.2, 0.3], 1), (250, [math.nan] * 4, 1), (300, [math.inf, 0.0, 0.0, 0.0], 1), (350, [1.0] * 4, None),
        (400, [], 0), (401, [], 0), (402, [], 1), (450, [1.0, 2.0, 3.0], 0), (451, [1.0, 2.0, 2.0], 0), (452, [1.0, 1.0, 2.5], 1), (50, [0.9] * 4, 2), (50, [0.9] * 4, 2), (-50, [0.7, 0.1, 0.2, 0.3], 0),
        (500, [0.0] * 4, 0),
    ],
}


@pytest.mark.parametrize("name", NEGATIVES)
def test_hard_negatives(spark, tmp_path, name, monkeypatch):
    monkeypatch.setattr(negatives, "STEP", 16)
    sf = _embeddings(spark, tmp_path, NEGATIVES[name])
    got = sorted(map(tuple, negatives.op13_hard_negatives(spark, sf).collect()), key=repr)
    assert got == _mined(NEGATIVES[name])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(oracle_sql()["op13_hard_negatives"]).fetchall(), key=repr) == got


def test_hard_negatives_of_nothing(spark, tmp_path):
    assert negatives.op13_hard_negatives(spark, _embeddings(spark, tmp_path, [])).count() == 0
    one = tmp_path / "one"
    assert negatives.op13_hard_negatives(spark, _embeddings(spark, one, [(0, [1.0, 2.0], 1)])).count() == 0


def test_huge_components_are_exact(spark, tmp_path):
    rows = [(k, [2.0**21 + k * 1000.0, -(2.0**20), 3.0], k % 2 + 1) for k in range(0, 60)] + [(k, [2.0**20 + k * 1000.0, -(2.0**19), 3.0], 3) for k in range(61, 90)]
    mined = _mined(rows)
    assert max(r[4] for r in mined) > 2**53
    assert sorted(map(tuple, negatives.op13_hard_negatives(spark, _embeddings(spark, tmp_path / "a", rows)).collect()), key=repr) == mined
    big = [(0, [1e30, 1e30], 1), (1, [1e30, 2e30], 1), (2, [1e30, 1e29], 2)]  # all scores are the largest long: none lies in a window
    assert negatives.op13_hard_negatives(spark, _embeddings(spark, tmp_path / "b", big)).count() == 0


def test_multi_sequence():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=9), np.repeat(rng.normal(size=3), 2)
    seen = list(negatives.multi_sequence(a, b))
    assert sorted((i, j) for _, i, j in seen) == [(i, j) for i in range(9) for j in range(6)]
    assert [s for s, _, _ in seen] == sorted((x + y for x in a for y in b), reverse=True)
    assert list(negatives.multi_sequence(a, np.zeros(0))) == []


def test_certified_searches_stop_early():
    """On clustered vectors a search sees a part of the rows, and what it returns is what all rows give."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 32)) * 300
    x = np.floor(centres[rng.integers(0, 20, 4000)] + 20 * rng.normal(size=(4000, 32))).astype(np.int64)
    label, rows = rng.integers(0, 4, 4000), np.arange(4000)
    books = negatives.Codebooks({32: x[:2000].astype(float)})
    block, seen = negatives.Block(rows, x, label, rows.copy(), books), []
    step, scores = negatives.STEP, block.scores
    block.scores = lambda anchor, at: seen.append(len(at)) or scores(anchor, at)
    negatives.STEP = 64
    try:
        for k in range(30):
            dots = x @ x[k]
            best, at = block.best_of_label(k, x[k], label[k], 5, -math.inf)
            want = sorted((-int(dots[r]), r) for r in rows if label[r] == label[k] and r != k)[:5]
            assert list(zip((-best).tolist(), block.rows[at].tolist(), strict=True)) == want
            for (score, where), p in zip(block.best_in_windows(x[k], label[k], 3, [negatives.window(int(b), 50, 95) for b in best]), best.tolist(), strict=True):
                want = sorted((-int(dots[r]), r) for r in rows if label[r] != label[k] and 50 * p <= 100 * dots[r] <= 95 * p)[:3]
                assert list(zip((-score).tolist(), block.rows[where].tolist(), strict=True)) == want
    finally:
        negatives.STEP = step
    assert sum(seen) < 0.25 * 30 * 2 * 4000
    cells = negatives.Cells(books, [(32, i, j, 1.0, 1.0, 3, 5) for i in range(32) for j in range(32)])
    assert cells.route(x[0], -math.inf) == [3, 4, 5] and cells.route(x[0], 1e12) == []
