"""Every query of the archive operators against its SQL counterpart."""

from __future__ import annotations

import os

import duckdb
import pytest

from quern import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return round(float(x), 6) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = q.QUERIES[name](spark, SF)
    want = duck.sql(q.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    left = sorted(tuple(str(plain(r[c])) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    right = sorted(tuple(str(plain(r[i])) for i in at) for r in want.fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


def test_prefix_reaches_the_scan(spark):
    plan = q.r5_prefix_latest(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "event_id" in plan and "value" not in plan.split("ReadSchema")[1]


def odd_documents(spark, duck, folder, name):
    """A query's columns and its SQL's, over ids that repeat (with equal and other texts, empty and null ones), null ids and ids without text."""
    texts = [(1, "one text"), (1, "one text"), (2, "öne"), (2, "another " * 300), (3, ""), (4, None), (5, None), (5, "zz"), (6, ""), (6, "abc"), (None, "x"), (None, "yz")]
    texts += [(7, "abcd" * 500), (8, "a"), (9, "a" * 64 + "b" * 32 + "c" * 16 + "d" * 8 + "e" * 4 + "ff" + "gh")] + [(10, chr(33 + k)) for k in range(90)] + [(11, "".join(map(chr, range(256, 800))))]
    spark.createDataFrame([(k, t, "en", "s") for k, t in texts], "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(folder / "documents.parquet"))
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got, want = q.QUERIES[name](spark, str(folder)), con.sql(q.ORACLE_SQL[name])
    assert got.columns == want.columns
    return sorted(map(tuple, got.collect()), key=str), sorted(want.fetchall(), key=str)


def test_entropy_of_odd_documents(spark, duck, tmp_path):
    got, want = odd_documents(spark, duck, tmp_path, "e1_entropy")
    assert got == want and dict(got)[4] == 0 and 3 not in dict(got)


def test_codec_decision_of_odd_documents(spark, duck, tmp_path):
    got, want = odd_documents(spark, duck, tmp_path, "e2_codec_decision")
    assert got == want and {"lz4", "zstd"} <= set(dict(got).values())
