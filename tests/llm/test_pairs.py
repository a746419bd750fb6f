"""Near-dedup of texts and vectors against brute force."""

import random
import re
from itertools import combinations

import numpy as np

from tessera.llm import neardup as nd
from tessera.llm import vectors as vc
from tessera.llm.common import components


def _sets(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        out.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    return out


def _brute(ids, linked):
    top = list(range(len(ids)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in linked:
        top[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(ids))]


def _near_texts(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [None, "", " \t", "one two", "ONE  two", "one", "long " * 30_000, "long " * 30_001]
    for _ in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 120))]
        for _ in range(rnd.choice((1, 1, 2, 5))):
            texts.append(" ".join(rnd.choice(vocabulary) if rnd.random() < 0.02 else w for w in base))
    base = [rnd.choice(vocabulary) for _ in range(100)]  # one large group of near copies
    texts += [" ".join(rnd.choice(vocabulary) if rnd.random() < rnd.choice((0.01, 0.05)) else w for w in base) for _ in range(300)]
    return texts + ["same copy of a text here"] * 200


def test_near_duplicates(spark):
    texts = _near_texts(3)
    random.Random(4).shuffle(texts)
    ids = [None if k == 5 else k // 2 * 2 if k < 12 else k for k in range(len(texts))]
    for width, percent in ((3, 85), (5, 80)):
        sets = _sets(texts, width)
        linked = [(a, b) for a, b in combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = _brute(ids, linked)
        got = nd.near_duplicates(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5), width, percent).collect()
        key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(((i, len(s), c) for i, s, c in zip(ids, sets, want, strict=True)), key=key)
        assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_deduplicate_keeps_columns_and_one_of_each_group(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, None), (None, "a b c d e f", "z"), (4, "q", "w")]
    out = nd.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, kept string"))
    assert out.columns == ["doc_id", "text", "kept"] and sorted(r.kept or "" for r in out.collect()) == ["", "w", "x", "z"]
    assert nd.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables_find_pairs_at_the_threshold():
    m, rng, missed = nd.collections(0.85), np.random.default_rng(1), 0
    for _ in range(300):
        common, a, b = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (170, 15, 15))
        both = np.concatenate([common, a, common, b])
        subs, sketch = nd.sub_hashes(both, np.array([0, 185, 370]), m)
        same = subs[0] == subs[1]
        missed += not (same[:m].any() and same[m:].any())
        close, near = nd.reach(0.85, sketch.shape[1])
        # a third set at any distance: what is close to a pivot ties its near copies to the pivot
        agree = (sketch[0] == sketch[1]).sum()
        assert close + agree - sketch.shape[1] >= near
    assert missed <= 1


def test_rows_without_id_bridge_their_neighbours(spark):
    word = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(word)), (None, " ".join([*word[:-3], "x", "y", "z"])), (9, " ".join(["a", "b", "c", *word[3:-3], "x", "y", "z"])), (None, "alone here now and then"), (None, " ".join([*word[:-3], "x", "y", "z"]))]
    sets = _sets([t for _, t in rows], 3)
    assert 100 * len(sets[0] & sets[2]) < 85 * len(sets[0] | sets[2]) and 100 * len(sets[1] & sets[2]) >= 85 * len(sets[1] | sets[2])
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, False), (0, 1, False), (0, 1, False), (1, 1, True), (9, 1, False)]


def test_repeated_ids(spark):
    """One id 20,000 times; another with two texts, of which one is a copy of a smaller id's."""
    rows = [(7, "a b c d e f g h", "x")] * 20_000 + [(8, "a b c d e f g h", "y"), (3, "k l m n o p q r", "z"), (5, "k l m n o p q r", "z"), (5, "s t u v w x y z", "own"), (4, None, "e"), (4, None, "e")]
    out = nd.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, _first string"))
    assert sorted((r.doc_id, r._first) for r in out.collect()) == [(3, "z"), (4, "e"), (4, "e"), (5, "own"), (7, "x")] and out.columns == ["doc_id", "text", "_first"]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1300)] + [(5000, k) for k in range(5001, 5400)]
    ids = sorted({x for e in edges if e[0] != e[1] for x in e})
    place = {x: k for k, x in enumerate(ids)}
    want = dict(zip(ids, _brute(ids, [(place[a], place[b]) for a, b in edges if a != b]), strict=True))
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == want


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 32))
    rows = []
    for k in range(400):
        v = base[0 if k < 150 else k % 60] + rng.standard_normal(32) * rng.choice((0, 0.01, 0.15, 0.19))
        rows.append((k if k != 9 else 8, v.astype(np.float32).tolist(), None if k % 50 == 7 else k % 2))
    v = rows[0][1]
    rows += [(1000, None, 0), (1001, [0.0] * 32, 0), (1002, [float("nan"), *v[1:]], 0), (1003, [None, *v[1:]], 0), (1004, [float("inf"), *v[1:]], 0), (1005, [], 0), (1006, [*v, 0.0], 0), (1007, [3 * x for x in v], 0), (None, v, 0)]
    n = len(rows)
    fine = [i is not None and lab is not None and bool(e) and all(x is not None and np.isfinite(x) for x in e) and any(e) for i, e, lab in rows]
    unit = [np.array(e, np.float32).astype(float) / np.linalg.norm(np.array(e, np.float32).astype(float)) if ok else None for (_, e, _), ok in zip(rows, fine, strict=True)]
    linked = [(a, b) for a, b in combinations(range(n), 2) if fine[a] and fine[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    links = [0] * n
    for a, b in linked:
        links[a] += 1
        links[b] += 1
    want = sorted(((r[0] is None, r[0] or 0, k, c is None, c or 0) for r, k, c in zip(rows, links, _brute([r[0] for r in rows], linked), strict=True)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vc.dedup_vectors(df.repartition(3)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id is None, r.component_id or 0) for r in got) == want
    assert vc.dedup_vectors(df.limit(0)).count() == 0


def test_vectors_in_double_precision_and_labels_of_any_type(spark):
    rows = [(1, [1e300, 0.0], "x"), (2, [1e300, 1.0], "x"), (3, [1e-60, 0.0], "x"), (4, [1.0, 1e-9], "y"), (5, [0.0, 1e-320], "x"), (6, [0.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").selectExpr("*", "vec_id as class_id", "vec_id as row", "label as second", "7 as top")
    got = vc.dedup_vectors(df)
    assert got.columns == [*df.columns, "n_links", "component_id", "kept"]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.second) for r in got.collect()) == [(1, 2, 1, "x"), (2, 2, 1, "x"), (3, 2, 1, "x"), (4, 0, 4, "y"), (5, 1, 5, "x"), (6, 1, 5, "x")]


def test_recall_at_the_threshold(spark):
    """4000 planted pairs with cosines from 0.98 to 0.981 among other vectors, one of them repeated very often."""
    rng = np.random.default_rng(9)
    x = vc.unit(rng.standard_normal((4000, 64)))
    y = rng.standard_normal((4000, 64))
    y = vc.unit(y - (x * y).sum(1, keepdims=True) * x)
    cosine = rng.uniform(0.98, 0.981, (4000, 1))
    z = cosine * x + np.sqrt(1 - cosine**2) * y
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(x)] + [(10_000 + k, v.tolist(), k % 3) for k, v in enumerate(z)] + [(20_000 + k, x[0].tolist(), 0) for k in range(2000)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vc.dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit_z = z / np.linalg.norm(z, axis=1, keepdims=True)
    there = np.flatnonzero((x * unit_z).sum(1) >= 0.98)
    found = sum(got[10_000 + int(k)][1] == k for k in there)
    assert len(there) > 3900 and found / len(there) >= 0.999
    assert got[20_000] == (2001, 0)


def test_estimates_and_bounds():
    rng = np.random.default_rng(5)
    x = vc.unit(rng.standard_normal((200, 64)))
    codes, factor, whole, scale, lost = vc.encode(x)
    signs = np.unpackbits(codes, axis=1)[:, :64] * 2.0 - 1
    error = (signs @ (x @ vc.rotation(64, 0)).T) / (8 * factor[:, None]) - x @ x.T
    bound = vc.EPS * np.sqrt(1 - factor**2) / factor / np.sqrt(63)
    assert (np.abs(error) <= bound[:, None] + 1e-9).all() and abs(error.mean()) < 0.01
    assert np.allclose(np.linalg.norm(x @ vc.rotation(64, 0) - whole * scale[:, None], axis=1), lost)
    near = vc.unit(x + 0.01 * rng.standard_normal(x.shape))
    maybe = vc.may_reach(*(np.concatenate(v) for v in zip(vc.encode(x), vc.encode(near), strict=True)), 0.98)
    assert maybe[np.arange(200), 200 + np.arange(200)].all() and maybe[:200, :200].mean() < 0.05
    assert vc.table_keys(x, np.zeros(200, np.int64), 12, 20).shape == (200, 20)


def test_a_group_of_near_copies_is_not_tied_by_every_table(spark, monkeypatch):
    rnd = random.Random(8)
    base = [f"w{rnd.randint(0, 300)}" for _ in range(200)]
    texts = [" ".join(f"x{k}" if j == k % 200 else w for j, w in enumerate(base)) for k in range(400)]
    tied, follow = [], nd.components
    monkeypatch.setattr(nd, "components", lambda edges: tied.append(edges.count()) or follow(edges))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in nd.near_duplicates(rows).collect()} == {0}
    m = nd.collections(0.8)
    assert max(tied[:2]) < m * len(texts)  # of m * m tables
