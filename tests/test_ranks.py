"""First rows of an order from few files, against full sorts in plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranks as rk
from tessera.operators.commits import CommitLog
from tessera.operators.filters import apply_filters
from tessera.operators.scoring import with_scores
from tessera.operators.search import SORTS
from tessera.schema import Catalog, SearchRequest

from .catalog import ITEM, NOW

N, PER_FILE = 600, 40


def _rows(rnd, ids):
    day = lambda: rnd.choice([None, NOW - dt.timedelta(days=rnd.randrange(9))])
    count = lambda: rnd.choice([None, 0, rnd.randrange(5), rnd.randrange(900)])
    return [(i, f"t{i}", None, None, day(), count(), count(), rnd.choice(("active",) * 6 + ("missing",))) for i in ids]


def _sorted(spark, rows, mode):
    scored = [r.asDict() for r in with_scores(spark.createDataFrame(rows, ITEM), str(NOW)).collect() if r.status == "active"]
    _, columns, falling = rk.layout(mode)
    return [r["item_id"] for r in sorted(scored, key=lambda r: rk._key(r[c] for c in columns), reverse=falling)]


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    rows = _rows(random.Random(4), range(N))
    files = rk.RankFiles(CommitLog(spark, str(tmp_path_factory.mktemp("ranks"))))
    files.build(with_scores(spark.createDataFrame(rows, ITEM), str(NOW)), per_file=PER_FILE)
    return rows, files


@pytest.mark.parametrize("mode", SORTS)
def test_pages_and_files_read(spark, laid, mode):
    rows, files = laid
    want = _sorted(spark, rows, mode)
    for offset, k in ((0, 12), (150, 30), (len(want) - 5, 20), (len(want) + 9, 3)):
        top = files.first(mode, k, offset)
        assert [r.item_id for r in top.rows.collect()] == want[offset : offset + k]
        # bounds of files come from a sample of the keys, so their sizes vary
        assert len(top.files) <= (offset + k) // PER_FILE * 3 + 2
    assert len(files.first(mode, 12).files) == 1
    assert len(files.first(mode, 12).rows.inputFiles()) == 1 and files.count(mode) == len(want)


@pytest.mark.parametrize("mode", ["published_desc", "favorites_asc", "popularity_desc"])
def test_filters_read_as_many_files_as_they_need(spark, laid, mode):
    rows, files = laid
    want = [i for i in _sorted(spark, rows, mode) if i % 3 == 0]
    top = files.first(mode, 10, 5, lambda r: r.where("item_id % 3 = 0"))
    assert [r.item_id for r in top.rows.collect()] == want[5:15] and len(top.files) < 8
    rare = files.first(mode, 10, 0, lambda r: r.where("item_id = 77 or item_id = 78"))
    assert [r.item_id for r in rare.rows.collect()] == [i for i in _sorted(spark, rows, mode) if i in (77, 78)]
    empty = spark.createDataFrame([], "item_id long, kind string, entity_id long")
    request = SearchRequest(counts={"view_count": (3, None)}, order=mode)
    meant = lambda r: apply_filters(Catalog(r, None, empty), request)
    views = {r[0]: r[5] or 0 for r in rows}
    assert [r.item_id for r in files.first(mode, 25, 0, meant).rows.collect()] == [i for i in _sorted(spark, rows, mode) if views[i] >= 3][:25]


def test_changed_items_and_compaction(spark, tmp_path):
    rnd = random.Random(8)
    rows = _rows(rnd, range(300))
    log = CommitLog(spark, str(tmp_path))
    files = rk.RankFiles(log)
    files.build(with_scores(spark.createDataFrame(rows, ITEM), str(NOW)), ["views_desc", "views_asc", "hot_desc"], 25)
    now = {r[0]: r for r in rows}
    for _ in range(3):
        before = {f for t in log.head().tables.values() for f in t.values()}
        changed = _rows(rnd, [*rnd.sample(range(300), 30), *rnd.sample(range(300, 400), 5)])
        now |= {r[0]: r for r in changed}
        files.update(with_scores(spark.createDataFrame(changed, ITEM), str(NOW)))
        assert before < {f for t in log.head().tables.values() for f in t.values()}  # nothing is rewritten
        for mode in ("views_desc", "views_asc", "hot_desc"):
            want = _sorted(spark, list(now.values()), mode)
            for offset in (0, 60):
                top = files.first(mode, 20, offset)
                assert [r.item_id for r in top.rows.collect()] == want[offset : offset + 20]
    files.compact()
    assert not log.head().tables["gone"]
    want = _sorted(spark, list(now.values()), "views_asc")
    top = files.first("views_asc", 20)
    assert [r.item_id for r in top.rows.collect()] == want[:20] and len(top.files) <= 2
    assert log.read("view_count").count() == len(want)


def test_empty(spark, tmp_path):
    files = rk.RankFiles(CommitLog(spark, str(tmp_path)))
    files.build(with_scores(spark.createDataFrame([], ITEM), str(NOW)))
    assert files.first("hot_desc", 5).rows.collect() == [] and files.first("views_asc", 5, 3, lambda r: r.where(F.lit(True))).rows.collect() == []
