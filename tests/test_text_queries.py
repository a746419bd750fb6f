"""Text queries over whole tables against plain Python."""

import hashlib
import re
import unicodedata

import duckdb

from tessera.plans.queries import oracle_sql, queries

TEXTS = [
    None, "", "   ", "plain  ASCII\ttext ", "Éa été, à la  crème", "Straße über Größe", "ＡＢＣ　１２３", "ﬁne ½ ① ㌔", "zero\u200bwidth\ufeff", "夏休み", "夏 x 水着", "한글", "e\u0301a", "  \u3000 ", "?!",
]
CJK = r"[\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af]+"


def _run(spark, tmp_path, name):
    folder = str(tmp_path / "sf")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return {r[0]: r[1] for r in queries()[name](spark, folder).collect()}


def _clean(v):
    v = unicodedata.normalize("NFKC", v or "").replace("\u200b", "").replace("\ufeff", "")
    return re.sub(r"\s+", " ", v).strip()


def _words(v):
    folded = "".join(c for c in unicodedata.normalize("NFD", re.sub(CJK, " ", v or "").lower()) if not unicodedata.combining(c))
    return " ".join(sorted({w for w in re.split(r"[\W_]+", folded) if w}))


def test_normalise_text_of_all_documents(spark, tmp_path):
    assert _run(spark, tmp_path, "normalise_text_all") == {k: hashlib.md5(_clean(v).encode()).hexdigest() for k, v in enumerate(TEXTS)}


def test_normalise_text_covers_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    every = {r[0]: r[1] for r in queries()["normalise_text_all"](spark, sf).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    plain = dict(con.sql(oracle_sql()["normalise_text"]).fetchall())
    wide = {r[0]: r[1] for r in queries()["normalise_text"](spark, sf).collect()}
    assert len(every) == con.sql("SELECT count(*) FROM documents").fetchall()[0][0] > 0 and every == plain == wide


def test_short_terms_of_all_documents(spark, tmp_path):
    assert _run(spark, tmp_path, "short_terms") == {k: _words(v) for k, v in enumerate(TEXTS)}
