"""The inverted file against full searches: built, extended, reopened, replaced, compacted, tuned."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import entities, search, vector_index
from corpusloom.sources.manifests import Manifests

SCHEMA = "id bigint, embedding array<double>"


def _rows(n, dims=12, seed=1, centres=9):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return [(i, (middle[i % centres] + 0.3 * rng.normal(size=dims)).tolist()) for i in range(n)]


def _found(df):
    return {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = _rows(900)
    rows += [(1000, None), (1001, [0.0] * 12)] + [(2000 + i, rows[5][1]) for i in range(40)]  # null, zero and one common vector
    path = f"file://{tmp_path_factory.mktemp('ivf')}"
    return rows, vector_index.InvertedFile.build(spark.createDataFrame(rows, SCHEMA), path, lists=9)


def test_all_lists_give_the_full_search(spark, built):
    rows, index = built
    live = spark.createDataFrame([r for r in rows if r[1]], SCHEMA)
    queries = live.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    assert index.meta["rows"] == 942 - 1
    got = _found(index.search_many(queries, 7, index.lists))
    assert got == _found(search.vector_join(live, queries, 7)) and len(got) > 300


def test_codes_bracket_scores():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, error = vector_index.codes_of(unit, unit[0])
    near = unit[0] + scale[:, None] * codes
    assert (np.linalg.norm(unit - near, axis=1) <= error).all() and error.max() < 0.02


def test_few_probes_read_few_lists(spark, built):
    _, index = built
    out = index.search(_rows(900)[17][1], 5, probes=2)
    plan = out._jdf.queryExecution().toString()
    lists = index.probed(_rows(900)[17][1], 2)
    assert "PartitionFilters: [list#" in plan and f"IN ({','.join(map(str, lists))})" in plan
    assert out.head()["id"] == 17


def test_versions_replace_delete_and_compact(spark, tmp_path):
    rows = _rows(300)
    path = f"file://{tmp_path}"
    first = vector_index.InvertedFile.build(spark.createDataFrame(rows, SCHEMA), path, lists=6)
    second = first.upsert(spark.createDataFrame([(3, rows[8][1]), (500, rows[8][1])], SCHEMA))
    third = second.delete(spark.createDataFrame([(8,)], "id bigint"))
    ids = lambda index: [r["id"] for r in index.search(rows[8][1], 3).collect()]
    last = ids(third)
    assert last[:2] == [3, 500] and ids(second) == [3, 8, 500] and ids(first)[0] == 8
    again = vector_index.InvertedFile(spark, path)
    assert again.meta["version"] == 2 and again.rows().count() == 300
    whole = again.compact()
    assert ids(whole) == last and len(whole.meta["segments"]) == 1 and whole.meta["rows"] == 300
    whole.store.vacuum()
    assert whole.store.versions() == [3] and ids(vector_index.InvertedFile(spark, path)) == last
    with pytest.raises(KeyError):
        vector_index.InvertedFile(spark, path, 0)


def test_tuned_recall(spark, built):
    rows, index = built
    queries = spark.createDataFrame(random.Random(1).sample([r for r in rows if r[1] and any(r[1])], 60), SCHEMA).withColumnRenamed("id", "query_id")
    tuned = index.tune(queries, 10, 0.9)
    assert 1 <= tuned.meta["probes"] <= index.lists and tuned.meta["recall"] >= 0.9
    live = spark.createDataFrame([r for r in rows if r[1]], SCHEMA)
    want, got = _found(search.vector_join(live, queries, 10)), _found(tuned.search_many(queries, 10))
    hits = len({(q, i) for (q, _), (i, _) in want.items()} & {(q, i) for (q, _), (i, _) in got.items()})
    assert hits >= 0.9 * len(want)


def test_wrong_lengths_and_empty_tables(spark, tmp_path):
    index = vector_index.InvertedFile.build(spark.createDataFrame(_rows(20), SCHEMA), f"file://{tmp_path}/a", lists=2)
    with pytest.raises(ValueError):
        index.search([1.0], 3)
    with pytest.raises(Exception, match="dimensions"):
        index.upsert(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA))
    assert vector_index.InvertedFile(spark, f"file://{tmp_path}/a").meta["version"] == 0  # the failed change left nothing
    empty = vector_index.InvertedFile.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/b")
    assert empty.search([], 3).count() == 0


def test_a_version_is_written_once(spark, tmp_path):
    store = Manifests(spark, f"file://{tmp_path}")
    with pytest.raises(KeyError):
        store.read()
    store.commit({"version": 0, "x": 1})
    with pytest.raises(RuntimeError):
        store.commit({"version": 0, "x": 2})
    with pytest.raises(RuntimeError):
        store.commit({"version": 2})
    assert store.commit({"version": 1})["version"] == 1 and store.read(0)["x"] == 1


def test_catalogue_opens_what_it_registered(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}", "x", f"text {i}") for i in range(30)], "id string, name string, desc string")
    catalog = entities.Catalog(spark, f"file://{tmp_path}/catalog")
    for kind in ("scan", "inverted"):
        entities.sync_at(catalog, f"my {kind}", nodes, f"file://{tmp_path}/{kind}", dims=16, kind=kind)
    q = catalog.open("my scan").rows.where("id = 'n7'").head()["evec"]
    a, b = (sorted((round(r["score"], 9), r["id"]) for r in catalog.open(f"my {kind}").search(q, 5).select("id", "score").collect()) for kind in ("scan", "inverted"))
    assert a == b and a[-1][1] == "n7"
    with pytest.raises(ValueError):
        entities.IndexSpec("x", "t", "c", 3, kind="tree")


def test_requests_through_indexes_equal_scans(spark, tmp_path):
    """Every mode gives the same hits from stored indexes as from scans."""
    from corpusloom.operators import text_index
    from corpusloom.plans import pipelines
    from corpusloom.schemas import SearchRequest

    chunks = spark.createDataFrame([(f"c{i}", "s", f"word{i % 7} and more of text {i}", np.random.default_rng(i).normal(size=6).tolist()) for i in range(40)], "cid string, series string, text string, embedding array<double>")
    nodes = spark.createDataFrame([(f"n{i}", "s", f"name word{i % 7}", "t") for i in range(12)], "id string, series string, name string, type string")
    mentions = spark.createDataFrame([(f"n{i}", f"c{i}") for i in range(12)], "entity_id string, cid string")
    stored = {
        "names": text_index.TextIndex.build(nodes, f"file://{tmp_path}/n", text="name"),
        "words": text_index.TextIndex.build(chunks, f"file://{tmp_path}/w", id="cid"),
        "vectors": vector_index.InvertedFile.build(chunks, f"file://{tmp_path}/v", id="cid", lists=3),
    }
    for embed in (lambda q: [1.0, 0.5, 0.0, -1.0, 0.2, 0.1], lambda q: None):
        for mode in ("kg", "dense", "hybrid"):
            ask = lambda **own: [(r["id"], round(r["score"], 9)) for r in pipelines.retrieve(SearchRequest("word3 text", mode, k=4), nodes=nodes, chunks=chunks, mentions=mentions, embed=embed, **own).collect()]  # noqa: B023, E731
            assert sorted(ask()) == sorted(ask(**stored)) and ask()


def test_workers_hold_small_batches(spark, tmp_path):
    """Blocks and queries reach a worker a few megabytes at a time, however many meet."""
    rows = [(i, [float((i * j) % 17 - 8) for j in range(1, 33)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    index = vector_index.InvertedFile.build(df, str(tmp_path / "x"), lists=3)
    found = index.search_many(df.withColumnRenamed("id", "query_id"), 3)
    assert found.count() == 1800
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
    assert [x.stop - x.start for x in vector_index._slices(4, vector_index.CELLS // 2)] == [2, 2]


def test_rows_are_made_once(spark, tmp_path):
    """A build evaluates its rows once; blocks and turns are as row by row."""
    made = spark.sparkContext.accumulator(0)

    def count(it):
        for batch in it:
            made.add(batch.num_rows)
            yield batch

    rows = [(i, [float(i % 3), 1.0, float(i % 2)]) for i in range(1300)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>").mapInArrow(count, "id int, embedding array<double>")
    index = vector_index.InvertedFile.build(df, str(tmp_path / "x"), lists=2)
    assert made.value == 1300 and index.meta["rows"] == 1300
    for r in index.blocks().collect():
        v, seen = np.frombuffer(r["vectors"], "<f8").reshape(r["n"], 3), {}
        assert r["n"] <= vector_index.BLOCK_ROWS and list(r["ids"]) == sorted(r["ids"])
        for x, turn in zip(v, np.frombuffer(r["turns"], "<i4"), strict=True):
            assert seen.get(x.tobytes(), 0) == turn
            seen[x.tobytes()] = turn + 1
