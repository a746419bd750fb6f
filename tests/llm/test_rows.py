"""Clashing column names, repeated rows and ids, far longer items: what every operator must bear."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import common, decontam, mixing, neardup, pii, rendering, sharding, toxicity, urls, vectors

#: Names that operators use, or used, inside.
NAMES = (
    "row bucket start inside place _bucket _start _in _place _cut _s _key _bin _quality quality suffix f_length f_suffix_share features probability predicted "
    "rawPrediction ruled fitting urls blocked _v _p _raw _r class_id second top _h1 _h2 node cluster _parts_ key _i _j _b _first document _copy col component"
).split()


def _with_names(df):
    return df.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))


def _own(rows):
    return all(r[n] == f"own {n}" for r in rows for n in NAMES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, " ".join(f"w{(k * j) % 97}" for j in range(30)), f"s{k % 3}") for k in range(40)] + [(None, None, None), (3, "", "s1")]
    return _with_names(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_clashing_names(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "not there at all in any of these")], "item_id long, text string")
    pages = _with_names(spark.createDataFrame([(k, f"http://a{k}.{'net' if k % 2 else 'org'}/fr/{k}", "<p>x") for k in range(30)], "page_id long, url string, html string"))
    vecs = _with_names(spark.createDataFrame([(k, [1.0, float(k % 3)], 0) for k in range(9)], "vec_id long, embedding array<float>, label int"))
    for out, n in (
        (sharding.shard_documents(docs), 42), (mixing.mix(docs, labels), 42), (neardup.deduplicate(docs), None), (decontam.decontaminate(docs, bench), 42),
        (toxicity.score(docs, toxicity.train(docs, labels)), 42), (pii.find_spans(docs), 42), (urls.judge(pages), 30), (rendering.render(pages), 30), (vectors.dedup_vectors(vecs), 9),
    ):
        rows = out.collect()
        assert _own(rows) and len(out.columns) == len(set(out.columns)) and n in (None, len(rows))


def test_stages_on_odd_tables(spark, docs, tmp_path):
    """Null ids and texts, repeated ids and clashing names go through all stages; so does an empty table."""
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int(k == 5)) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    frame = docs
    for name, stage in cp.STAGES:
        frame = common.materialise(stage(spark, frame, sf))
        assert _own(frame.collect()) and (name == "sharding" or frame.columns == docs.columns)
    assert frame.count() > 0
    frame = docs.limit(0)
    for _, stage in cp.STAGES:
        frame = stage(spark, frame, sf)
        assert frame.count() == 0


def test_repeated_rows(spark):
    text = "some words that come again and again in this one"
    docs = spark.createDataFrame([(1, text)] * 20_000 + [(None, f"{text} {k}") for k in range(300)] + [(k, f"{text} {k} other") for k in range(2, 300)], "doc_id long, text string").repartition(4)
    out = sharding.shard_documents(docs).select("shard", "slot").collect()
    per = Counter(r.shard for r in out)
    assert len({(r.shard, r.slot) for r in out}) == len(out) == docs.count() and max(per.values()) - min(per.values()) <= 1
    labels = spark.createDataFrame([(k, 0, int(k % 2)) for k in range(1, 300)] + [(1, 0, 1)] * 50, "doc_id long, quality int, toxic int")
    slots, weights, _ = toxicity.train(docs, labels)
    once = toxicity.train(docs.distinct(), labels)
    assert (slots == once[0]).all() and (weights == once[1]).all()


def test_a_hot_url_is_one_url_of_the_sample(spark):
    rows = [("http://hot.net/", 1)] * 30_000 + [(f"http://h{k}.net/x", 1) for k in range(400)] + [(f"http://h{k}.org/", 0) for k in range(400)]
    got = urls._sample(spark.createDataFrame(rows, "url string, label int"), 300)
    assert Counter(r.label for r in got) == {0: 300, 1: 300} and len({r.url for r in got}) == 600


def test_many_rules_are_joined(spark):
    rnd = random.Random(6)
    hosts = ["net", "example.net", "a.example.net", "org", "x.org", ""]
    rules = sorted({(rnd.choice(hosts) + "/" + rnd.choice(["", "a", "a/b", "fr/"]), "") for _ in range(60)})
    rules = [(r, rnd.choice(("block", "allow"))) for r, _ in rules] + [("net", "block")]
    rows = [(f"http://{rnd.choice(('', 'y.', 'z.y.'))}{rnd.choice(hosts)}/{rnd.choice(('', 'a', 'a/bc', 'fr/x'))}",) for _ in range(300)] + [(None,), ("nothing",)]
    df = spark.createDataFrame(rows, "url string").select("url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    asked, joined = (sorted(map(str, urls.with_rules(df, rules, n).collect())) for n in (500, 0))
    assert asked == joined


def test_long_and_frequent_items():
    rnd = random.Random(12)
    items = [[f"v{rnd.randrange(5000)}" for _ in range(25)] for _ in range(300)] + [[f"v{rnd.randrange(5000)}" for _ in range(10_000)]]
    items += [["the", "same", "start", f"u{k}", "x", "y"] for k in range(2000)]
    index = decontam.Index(list(range(len(items))), [" ".join(x) for x in items])
    assert sum(x.nbytes for x in index.words.values()) < 4e6
    text = " ".join([*items[300], *items[7], *["the same start"] * 3000, *items[400]])
    (_, raw, at), = list(common.chunks(__import__("pyarrow").array([text])))
    t, i, d = index.find(common.Words(raw, at, common.NO_LETTER, latin=True))
    assert {(7, 0), (300, 0), (400, 0)} <= set(zip(i.tolist(), d.tolist(), strict=True))


def test_spans_in_linear_time():
    text = "".join(f"user{k}@example{k}.com or b{k} [at] c{k} dot com, " for k in range(20_000))
    began = time.process_time()
    base, added = pii.scan(text)
    assert len(base) == 20_000 and len(added) == 20_000 and time.process_time() - began < 8
