"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from evirank.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{entry.SMOKE_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, entry.SMOKE_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in catalog.ORACLES:
        assert columns
        return
    query = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in query.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in query.fetchall()), key=repr)
    assert got == want


def test_quotes_that_touch_other_characters(spark, tmp_path):
    texts = ['He said "the quick brown fox jumps" twice', "(the quick brown foxes", "hippopotamus", "a hippopotamus here", None, "", "xthe quick browny", "the  <b>quick</b> brown fox", "unbelievably-good things"]
    quotes = ["the quick brown fox", "hippopotamus", "the quick brown", "quick brown", "elievably-good thing", "the quick brown fox jumps", "<p></p><br>", "short", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quotes)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = {tuple(r) for r in con.execute(catalog.ORACLES["quote_check"]).fetchall()}
    assert {(r["item_id"], r["first_doc"], r["n_docs"]) for r in catalog.QUERIES["quote_check"](spark, str(tmp_path)).collect()} == want and len(want) == 7


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
