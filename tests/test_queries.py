"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from postern import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cells = frame[sorted(frame.columns)].astype(object)
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(str(tuple(map(plain, r))) for r in cells.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = plans.queries()[name](spark, SF).toPandas(), duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_whole_texts_are_read(spark, tmp_path):
    late = "x" * 60 + " urgent mfa \u200b\u200b\u200b\u2060"
    spark.createDataFrame([(7, late, "en"), (9, "short", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    hits = {r.doc_id: r for r in plans.queries()["lexicon_hits"](spark, str(tmp_path)).collect()}
    assert "urgent" in hits[7].urgency.split(",") and "mfa" in hits[7].credentials.split(",") and "urgent" not in hits[9].urgency
    found = {r.doc_id: (r.total, r.most) for r in plans.queries()["invisible_chars"](spark, str(tmp_path)).collect()}
    assert found == {7: (6, "U+200B"), 9: (2, "U+200B")}


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
