"""Every operator and stage on edge rows and on an empty table: defined results, all columns carried."""

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import EDGE, SCHEMA

from corpusloom.llm import bpe, decontaminate, exact_dedup, language_model, license_scan, line_dedup, near_dedup, quality, substring_dedup, toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def _encode(spark, docs):
    v = bpe.load_vocabulary(spark)
    return bpe.decode(bpe.encode(docs, v), v)


def _bench(spark):
    return spark.createDataFrame([(1, "two three four"), (None, "a"), (2, None), (3, ""), (3, "five six")], "item_id bigint, text string")


def _labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)] + [(None, 1, 1), (4, None, None), (99, 1, 0)], LABELS)


def _toxic(spark, docs):
    model = spark.sparkContext.broadcast(toxicity.fit(docs, _labels(spark), allowed=~toxicity.held_out()))
    return toxicity.measure(docs, model)


OPERATORS = {
    "bpe": _encode,
    "decontaminate": lambda s, d: decontaminate.scan(d, _bench(s)),
    "substring": lambda s, d: substring_dedup.remove_repeated(d, window=4, width_bits=10),
    "toxicity": _toxic,
    "quality": lambda s, d: quality.score(d, _labels(s)),
    "license": lambda s, d: license_scan.scan(d),
    "lm": lambda s, d: language_model.score(d, train=~language_model.held_out()),
    "lines": lambda s, d: line_dedup.remove_repeated(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_are_carried(spark, make, name):
    docs = make(EDGE)
    out = OPERATORS[name](spark, docs)
    got = sorted(map(str, out.select("row.*").select(docs.columns).collect()))
    assert got == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


FILTERS = {"exact": lambda s, d: exact_dedup.deduplicate(d), "near": lambda s, d: near_dedup.deduplicate(d)}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(spark, make, name):
    docs = make(EDGE)
    out = FILTERS[name](spark, docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert {6, 7, 8} <= set(kept)
    assert FILTERS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_filter_keeps_one_row_of_each_text(spark, make):
    out = [(r["doc_id"], r["text"]) for r in exact_dedup.deduplicate(make(EDGE)).collect()]
    assert len(out) == 7  # '', ' ', two spellings of the six words, the long, the Unicode and the short text
    assert (4, EDGE[3][1]) in out and ((1, None) in out or (2, "") in out)


def test_report_rows_for_all(spark, make):
    docs = make(EDGE)
    exact = exact_dedup.dedup(docs).collect()
    assert len(exact) == len(EDGE)
    near = near_dedup.near_duplicates(docs, shingle=2).collect()
    assert len(near) == len(EDGE)
    by = {}
    for r in near:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)]
    assert by[5] == [(5, 4, False)] and all(x[1] is None and x[2] for x in by[None])
    assert exact_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_labels(spark, make):
    none = spark.createDataFrame([], LABELS)
    docs = make(EDGE)
    assert quality.score(docs, none).select("score").distinct().count() == 1
    model = spark.sparkContext.broadcast(toxicity.fit(docs, none, allowed=F.lit(True)))
    assert toxicity.measure(docs, model).select("score").distinct().count() == 1


@pytest.mark.parametrize("master,fine", [("local", True), ("local[8]", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_a_cluster_must_name_a_shared_folder(master, fine):
    from types import SimpleNamespace

    from corpusloom.llm import common

    nothing = SimpleNamespace(get=lambda *_: None)
    session = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(master=master, getConf=lambda: nothing))
    if fine:
        assert common.shared_dir(session).startswith("/tmp/")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session)
    named = SimpleNamespace(get=lambda *_: "/shared/folder/")
    assert common.shared_dir(SimpleNamespace(conf=named, sparkContext=session.sparkContext)) == "/shared/folder"
