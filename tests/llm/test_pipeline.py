"""The pipeline on a small corpus against brute force, stage by stage."""

import random
from collections import Counter

import corpus_pipeline as cp
from tessera.llm.common import materialise


def test_pipeline(spark, tmp_path):
    rnd = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    item = words(30)
    docs, toxic = [], {}
    for k in range(300):
        w = words(rnd.randint(30, 90))
        if k % 5 == 0:
            w[::20] = ["horrid"] * len(w[::20])
        docs.append((k, " ".join(w), "en", f"s{k % 4}", len(w)))
        toxic[k] = int(k % 5 == 0)
    docs += [(1000 + k, docs[k][1].upper(), "en", "s1", 0) for k in range(1, 40, 2)]  # copies
    docs += [(2000 + k, " ".join([*words(20), *item[:25], "odd", *item[26:], *words(20)]), "en", None, 0) for k in range(5)]  # leaks
    docs += [(3000, None, "en", "s0", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, 1, t) for k, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    frame, seen = cp.table(spark, sf, "documents"), {}
    for name, stage in cp.STAGES:
        frame = materialise(stage(spark, frame, sf))
        seen[name] = Counter(r.doc_id for r in frame.collect())
        if name != "sharding":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everything = {d[0] for d in docs}
    bad = {k for k, t in toxic.items() if t} | {1000 + k for k in range(1, 40, 2) if toxic[k]}
    assert set(seen["toxicity"]) == everything - bad
    assert set(seen["near_dedup"]) == set(seen["toxicity"]) - {1000 + k for k in range(1, 40, 2)}
    assert set(seen["decontamination"]) == {d for d in seen["near_dedup"] if not 2000 <= d < 3000}
    assert set(seen["mixing"]) <= set(seen["decontamination"]) and max(seen["mixing"].values()) == 2 and seen["sharding"] == seen["mixing"]
    rows = cp.run(spark, sf).collect()
    assert Counter(r.doc_id for r in rows) == seen["sharding"] and sorted(r.slot * 8 + r.shard for r in rows) == list(range(len(rows)))
