"""The stored text index against a full BM25: built, extended, thinned, merged; blocks that are skipped."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search, text_index

SCHEMA = "id bigint, text string"


def _docs(n, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words[: 5 + i % 290]) for _ in range(rng.randint(1, 80)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "Ünï w3 W3, w3!"), (n + 3, "w299 " * 900)]


def _hits(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


@pytest.mark.parametrize("query", [["w3"], ["W3", "w250", "w7"], ["nothing"], ["w299", "ünï"]])
def test_hits_equal_a_full_scan(spark, index, query):
    rows, ix = index
    assert _hits(ix.search(query, 10)) == _hits(search.bm25(rows, query, 10))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame(_docs(700), SCHEMA).repartition(3)
    return rows, text_index.TextIndex.build(rows, f"file://{tmp_path_factory.mktemp('ti')}", chunk=16)


def test_blocks_are_skipped_and_texts_not_read(spark, index):
    rows, ix = index
    out = ix.search(["w250", "w3"], 3)
    assert 0 < ix.read < ix.blocks
    plan = out._jdf.queryExecution().toString()
    assert "text#" not in plan and "PartitionFilters" in plan and "In(token" in plan


def test_changes_equal_a_fresh_index(spark, tmp_path):
    rows = _docs(120)
    path = f"file://{tmp_path}"
    first = text_index.TextIndex.build(spark.createDataFrame([(i, "w1 w2 old") if i % 5 == 0 else (i, t) for i, t in rows], SCHEMA), path, chunk=16)
    second = first.upsert(spark.createDataFrame([(i, t) for i, t in rows if i % 5 == 0] + [(900, "w1 w1 w1")], SCHEMA))
    third = second.delete(spark.createDataFrame([(7,), (900,)], "id bigint"))
    fourth = third.merge()
    live = spark.createDataFrame([(i, t) for i, t in rows if i != 7], SCHEMA)
    for query in (["w1", "w2"], ["old"], ["w9", "w40"]):
        want = _hits(search.bm25(live, query, 8))
        assert _hits(third.search(query, 8)) == want == _hits(fourth.search(query, 8))
    assert len(fourth.meta["segments"]) == 1 and fourth.meta["segments"][0]["documents"] == len(rows) - 1
    assert _hits(text_index.TextIndex(spark, path, 1).search(["w1"], 1))[0][0] == 900  # an older version
    held = fourth._documents().count()
    assert held < 2 * (len(rows) // 16)  # small chunks have been put together


def test_an_empty_table(spark, tmp_path):
    ix = text_index.TextIndex.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}")
    assert ix.search(["x"], 3).count() == 0
    assert _hits(ix.upsert(spark.createDataFrame([(1, "x")], SCHEMA)).search(["x"], 3))[0][0] == 1


def test_full_chunks_stay_where_they_are_in_a_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "TOKENS", 200)
    rows = [(i, " ".join(f"w{i * j % 37}" for j in range(60 + i))) for i in range(80)]
    built = text_index.TextIndex.build(spark.createDataFrame(rows, SCHEMA).repartition(2), f"file://{tmp_path}", chunk=64)
    thinned = built.delete(spark.createDataFrame([(i,) for i in range(0, 80, 9)], "id bigint"))
    merged = thinned.merge()
    # Full by its tokens, a chunk is neither moved nor put together with others.
    kept = lambda ix: {(r["chunk"], r["token"]) for r in ix._every().where("token IS NOT NULL").select("chunk", "token").collect()}
    assert kept(merged) <= kept(built)
    sizes = [sum(r["lengths"]) for r in merged._documents().collect()]
    assert len(sizes) > 20 and max(sizes) < 3 * 200
    live = spark.createDataFrame([(i, t) for i, t in rows if i % 9], SCHEMA)
    for query in (["w1", "w2"], ["w36"]):
        assert _hits(merged.search(query, 8)) == _hits(thinned.search(query, 8)) == _hits(search.bm25(live, query, 8))


def test_a_merge_deals_only_small_chunks_again(spark, tmp_path, monkeypatch):
    dealt = []
    write = text_index.TextIndex._write.__func__
    monkeypatch.setattr(text_index.TextIndex, "_write", classmethod(lambda cls, rows, path: (dealt.append(rows.where("token IS NOT NULL").count()), write(cls, rows, path))[1]))
    rows = spark.createDataFrame(_docs(200), SCHEMA).coalesce(1)
    ix = text_index.TextIndex.build(rows, f"file://{tmp_path}", chunk=16).delete(rows.where("id % 11 = 5").select("id")).merge()
    held = ix._every().where("token IS NOT NULL").count()
    assert dealt[0] > held / 2 > 5 * dealt[1]


def test_numbers_of_two_and_of_four_bytes(spark, tmp_path):
    sizes, rows = np.array([2, 1, 3]), np.array([[0, 1, 5], [3, 70_000, 80_000], [1, 2, 9], [65_535, 65_536, 1 << 20], [2, 1, 65_535], [7, 7, 7]], np.int32)
    parts = [text_index._packed(sizes, rows), text_index._packed(sizes[1:], rows[:4] % 100), text_index._packed(sizes[:1], rows[4:])]
    batch = pa.RecordBatch.from_arrays([pa.concat_arrays(parts), pa.array([2, 1, 3, 1, 3, 2], pa.int32())], ["postings", "n"])
    for b, want in ((batch, np.vstack([rows, rows[:4] % 100, rows[4:]])), (batch.slice(1), np.vstack([rows[2:], rows[:4] % 100, rows[4:]]))):
        row, got = text_index._unpacked(b)
        assert (got == want).all() and (np.bincount(row) == b.column("n").to_numpy()).all()
    docs = [(1, "w1 " * 70_000 + "w2"), (2, "w1 w2 w2"), (3, "w3 w1"), (4, "w2"), (5, "w2 w3")]
    ix = text_index.TextIndex.build(spark.createDataFrame(docs[:1], SCHEMA), f"file://{tmp_path}").upsert(spark.createDataFrame(docs[1:], SCHEMA)).delete(spark.createDataFrame([(4,)], "id bigint"))
    want = _hits(search.bm25(spark.createDataFrame(docs[:3] + docs[4:], SCHEMA), ["w1", "w2"], 5))
    assert _hits(ix.search(["w1", "w2"], 5)) == want == _hits(ix.merge().search(["w1", "w2"], 5))
