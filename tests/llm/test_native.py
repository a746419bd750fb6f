"""Sharding and mixing against plain Python."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import mixing as mx
from tessera.llm import sharding as sh
from tessera.llm.queries import oracle_sql

DOCS = "doc_id long, text string, source string, lang string, size string"


def _docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


ODD = [
    (1, "a b c", "s", "en", "x"), (2, None, "s", "en", "x"), (3, "", None, "en", "x"), (3, "", None, "en", "x"), (None, "z z", "s", None, None), (4, "w " * 50_000, "t", "en", "x"), (5, "é\t\x0bé", "", "en", "x"),
]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    steps = sh.walk_length(spark, n, 5)
    assert sorted(r[0] for r in spark.range(n).select(sh.place(F.col("id"), n, steps, 5)).collect()) == list(range(n))


def _hash(seed, *values):
    """Spark's xxhash64 of integers (seed and round have four bytes, halves eight)."""
    h = 42
    for value, size in zip((seed, *values), (4, 4, 8), strict=True):
        h = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), h)
    return h - (h >> 63 << 64)


@pytest.mark.parametrize("n", [1, 5, 29, 1000])
def test_places_against_plain_python(spark, n):
    """The Feistel network and its cycle walking once more, number by number."""
    a = next(k for k in range(1, n + 1) if k * k >= n)
    b = -(-n // a)

    def permute(v):
        left, right = v % a, v // a
        for j in range(sh.ROUNDS):
            if j % 2:
                right = (right + _hash(9, j, left)) % b
            else:
                left = (left + _hash(9, j, right)) % a
        return left + a * right

    def place(v):
        v = permute(v)
        while v >= n:
            v = permute(v)
        return v

    got = spark.range(n).select("id", sh.place(F.col("id"), n, sh.walk_length(spark, n, 9), 9).alias("p")).collect()
    assert {r.id: r.p for r in got} == {v: place(v) for v in range(n)}


def test_sharding(spark):
    out = sh.shard_documents(_docs(spark, ODD))
    rows = out.collect()
    assert len(rows) == len(ODD) and set(out.columns) == {"doc_id", "text", "source", "lang", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    for r in rows:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(len(slots[k]) for k in range(8)) <= 1
    again = sh.shard_documents(_docs(spark, ODD[::-1]).repartition(3))
    key = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.shard, r.slot) for r in df.collect())
    assert key(out) == key(again)
    assert sh.shard_documents(_docs(spark, [])).count() == 0


def _targets(sizes):
    """Sharing by weight with a cap, the excess reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= 2 * sizes[s]}
        if not over:
            goal |= {s: left * w[s] / total for s in open_}
            break
        goal |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return goal


def test_mixing(spark):
    rows = [*ODD, *((100 + k, "w " * (1 + k % 17), f"src{k % 7}" if k % 3 else "hot", "en", None) for k in range(600))]
    labels = spark.createDataFrame([(100 + k, k % 2, 0) for k in range(0, 600, 5)] + [(100, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = mx.mix(_docs(spark, rows), labels).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in out:
        assert r["size"] == len((r.text or "").split()) and r.taken in (0, r["size"], 2 * r["size"])
        sizes[r.source] += r["size"]
    goal, taken, largest = _targets(sizes), Counter(), Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, goal[r.source], rel_tol=1e-9)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes)
    assert sorted(map(str, out)) == sorted(map(str, mx.mix(_docs(spark, rows[::-1]).repartition(5), labels).collect()))
    assert mx.mix(_docs(spark, []), labels).count() == 0
    assert all(r.taken >= r["size"] for r in out if r.epochs >= 1)  # whole epochs come first


@pytest.mark.parametrize("doc_id", [None, 7])
def test_mixing_of_rows_without_own_ids(spark, doc_id):
    """Targets are met within half a document where ids are null or all the same."""
    rows = [(doc_id, f"text {k} " + "w " * (k % 9), "one", "en", None) for k in range(1000)] + [(k, f"other {k}", "two", "en", None) for k in range(2000, 2300)]
    out = mx.mix(_docs(spark, rows)).collect()
    taken, goal, largest = Counter(), {}, Counter()
    for r in out:
        taken[r.source] += r.taken
        goal[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] / 2 for s in goal)


def test_mixing_sql(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    got = mx.op9_source_mixing(spark, sf)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(f"SELECT doc_id, size, taken, round(target, 6) FROM ({oracle_sql()['op9_source_mixing']}) ORDER BY doc_id").fetchall()
    assert [(r.doc_id, r["size"], r.taken, round(r.target, 6)) for r in got.orderBy("doc_id").collect()] == [tuple(x) for x in want]
