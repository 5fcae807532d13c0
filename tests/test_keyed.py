"""Keyed tables: batches against one merge, bytes that follow the batch, versions, dead runs, levels."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import tables
from corpusloom.sources import keyed

COLS = ["id", "series", "name", "type", "aliases", "desc", "cids", "conf"]


def _entities(spark, ids, turn):
    return spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("i")).select(F.concat(F.lit("e"), "i").alias("id"), F.lit("s").alias("series"), F.concat(F.lit("name"), "i").alias("name"), F.lit("t").alias("type"), F.array(F.lit(f"a{turn}")).alias("aliases"), F.repeat(F.lit("d"), turn).alias("desc"), F.array(F.lit(f"c{turn}")).alias("cids"), F.lit(turn / 10).alias("conf"))


def _rows(df):
    return sorted(str(tuple(r)) for r in df.select(COLS).collect())


def test_batches_equal_one_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "FAN", 2)
    merge = tables.upsert_entities
    batches = [_entities(spark, range(0, 30), 1), _entities(spark, range(20, 40), 2), _entities(spark, [5], 3), _entities(spark, [5, 39], 4)]
    table = keyed.KeyedTable.create(spark, f"file://{tmp_path}", "id", 4)
    states, whole = [], None
    for n, batch in enumerate(batches):
        table = table.upsert(batch, merge, n)
        whole = batch if whole is None else whole.unionByName(batch)
        assert _rows(table.rows(merge)) == _rows(merge(None, whole))
        states.append((table.meta["version"], _rows(table.rows(merge))))
    again = table.upsert(batches[-1], merge, len(batches) - 1)  # the stream repeats its last batch
    assert again.meta["version"] == table.meta["version"]
    assert len({d["level"] for d in table.meta["deltas"]}) <= 2
    for version, state in states:
        assert _rows(keyed.KeyedTable(spark, f"file://{tmp_path}", version).rows(merge)) == state
    full = table.compact(merge, 0.0)
    assert not full.meta["deltas"] and _rows(full.rows(merge)) == states[-1][1]
    assert _rows(full.rows(merge, ["e5", "e39", "none"])) == [r for r in states[-1][1] if "'e5'" in r or "'e39'" in r]
    full.vacuum()
    assert _rows(keyed.KeyedTable(spark, f"file://{tmp_path}").rows(merge)) == states[-1][1]


def test_bytes_follow_the_batch(spark, tmp_path):
    merge = tables.upsert_chunks
    old = spark.range(20000).select(F.col("id").cast("string").alias("cid"), F.lit(1.0).alias("ts"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    table = keyed.KeyedTable.create(spark, f"file://{tmp_path}", "cid", 4).upsert(old, merge).compact(merge, 0.0)
    base = sum(table.store.size(p) for p in {e["path"] for e in table.meta["base"].values()})
    after = table.upsert(old.limit(20).withColumn("ts", F.lit(2.0)), merge)
    wrote = sum(after.store.size(d["path"]) for d in after.meta["deltas"])
    assert 0 < wrote < base / 50 and after.meta["base"] == table.meta["base"]
    assert after.rows(merge).count() == 20000 and after.rows(merge).where("ts = 2").count() == 20


def test_a_run_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    merge = tables.upsert_entities
    table = keyed.KeyedTable.create(spark, f"file://{tmp_path}", "id", 2).upsert(_entities(spark, [1, 2], 1), merge)
    before = _rows(table.rows(merge))

    def dies(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyed.Manifests, "commit", dies)
        with pytest.raises(OSError):
            table.upsert(_entities(spark, [2, 3], 2), merge)
    again = keyed.KeyedTable(spark, f"file://{tmp_path}")
    assert _rows(again.rows(merge)) == before
    assert len(again.upsert(_entities(spark, [2, 3], 2), merge).vacuum()) >= 1  # what the dead run had written
    with pytest.raises(RuntimeError):
        table.upsert(_entities(spark, [9], 1), merge)  # built on a version that is no longer the latest


def test_empty_tables_and_batches(spark, tmp_path):
    merge = tables.upsert_entities
    table = keyed.KeyedTable.open(spark, f"file://{tmp_path}", "id", 2)
    assert table.rows(merge) is None
    table = table.upsert(_entities(spark, [1], 1).where("false"), merge, 0)
    assert table.rows(merge).count() == 0 and table.meta["batch"] == 0
    assert table.upsert(_entities(spark, [1], 1), merge, 1).rows(merge).count() == 1
