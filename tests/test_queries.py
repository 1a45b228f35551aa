"""Registered queries of the record operators against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

from structlake.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda table: sorted((tuple(plain(v) for v in r) for r in table), key=repr)
    mine, theirs = rows(got.select(*cols).collect()), rows(want.select(*(f'"{c}"' for c in cols)).fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == pytest.approx(b) if all(isinstance(x, (int, float)) for x in a) else str(a) == str(b)


def test_feature_text_keeps_the_sign_of_numbers_that_round_to_nought(spark, tmp_path):
    con = duckdb.connect()
    con.sql("create table embeddings as select * from (values (1::BIGINT, [-3e-7, 3e-7, 0.0, '-0.0'::FLOAT, -0.0000005, 0.0000005, -1.5]::FLOAT[], 7), (2, [0.1, -0.1, 1/128, -1/128, 1e-9, -1e-9, 2]::FLOAT[], 7)) v(vec_id, embedding, label)")
    con.sql(f"copy embeddings to '{tmp_path}/embeddings.parquet' (format parquet)")
    want = con.sql(SQL["export_feature_text"]).fetchall()
    assert [tuple(r) for r in QUERIES["export_feature_text"](spark, str(tmp_path)).collect()] == want
