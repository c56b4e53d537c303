import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from pageline.plans import registry


def rows(df):
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(map(plain, t))) for t in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_says_what_its_sql_says(spark, sf_dir, db, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert rows(got) == rows(db.execute(registry.ORACLES[name]).df())


def test_quotes_are_found_anywhere_and_of_any_length(spark, tmp_path):
    long = "De í lamo, vesti cor-ano: ruti mela sono para tive kolu nam beso \U0001f600 quid"
    items = [(1, long), (2, "As a"), (3, "De í"), (4, "x"), (5, "?!"), (6, ""), (7, None), (8, "abcdefg hij"), (8, "abcdefg hij"), (9, "I, a.b")]
    inner = long[:60]
    texts = [(1, f"words before {inner} and after"), (2, f"first line\nxx{inner.upper().replace(' ', '')}"), (3, inner.replace(",", "").replace(":", "")), (4, inner[:59]), (5, "was a one"), (6, None), (7, "zabc defghij"), (7, "no"), (None, "AbcDefg   hij"), (10, "what?! i ab"), (11, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = registry.QUERIES["checksum_prefix"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.execute(registry.ORACLES["checksum_prefix"]).df())
    assert {(1, 1), (2, 1), (3, 1), (5, 2), (7, 8)} <= set(zip(got.doc_id, got.item_id))


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_top_n_does_not_sort_everything(spark, sf_dir):
    assert "TakeOrderedAndProject" in registry.QUERIES["topn"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_headline_are_compared_once(spark, tmp_path, monkeypatch):
    """Each pair of documents was a candidate of its own."""
    from pageline.operators import stories

    heads = [(k, ("Rain floods old town", "old TOWN rain, again!", "One", None)[k % 4], None if k % 40 == 0 else "ab"[k // 100]) for k in range(200)]
    spark.createDataFrame([(k, None if h is None else f"{h}\nmore", "en", s) for k, h, s in heads], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    real, made = stories.candidates, []
    monkeypatch.setattr(stories, "candidates", lambda *a, **b: made.append(real(*a, **b).count()) or real(*a, **b))
    monkeypatch.setattr(stories, "LIST", 7, raising=False)
    got = registry.QUERIES["same_story"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.execute(registry.ORACLES["same_story"]).df()) and len(got) == 2209
    assert made == [2]
