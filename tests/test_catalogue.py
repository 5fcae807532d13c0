"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from corpusloom.plans import catalogue


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", catalogue.ORACLE_SQL)
def test_sql(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = con.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr([r[c] for c in cols]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark, sf):
    """Column pruning and predicate pushdown survive the operators."""
    from pyspark.sql import functions as F

    from corpusloom.operators import chunking

    d = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select(F.col("source").alias("series"), F.col("doc_id").alias("filename"), "text")
    plan = chunking.document_chunks(d)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "n_chars" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_edges_of_many_chunks(spark, con, tmp_path):
    """More chunks of one edge than a node or edge keeps are all counted."""
    many = con.sql("SELECT range AS p_partkey, 'n' AS p_name, 'Brand#' || range % 2 AS p_brand, 'LARGE' AS p_type, CAST(40 AS INT) AS p_size, 1.0::DOUBLE AS p_retailprice FROM range(900)")
    many.write_parquet(str(tmp_path / "part.parquet"))
    got = catalogue.QUERIES["canonical_edges"](spark, str(tmp_path)).collect()
    assert [r["n_cids"] for r in got] == [450, 450]
