"""Streams of phases and steps against their batch forms, idle keys and starts without an end."""

import datetime as dt

from pyspark.sql import functions as F

from corpusloom.streaming import health

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string"
T0 = dt.datetime(2024, 1, 1)


def _at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def _run(df, name, path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path)).start()
    q.processAllAvailable()
    q.stop()


def test_idle_keys_become_degraded_by_a_timer(spark, tmp_path):
    health.keep_state_on_disk(spark)
    batches = [
        [(1, _at(0), 1, "view"), (2, _at(1), 2, "error"), (3, _at(2), 2, "view"), (4, _at(5), 3, "view")],
        [(5, _at(30), 1, "view"), (6, _at(31), 2, "view")],
        [(7, _at(75), 1, "view"), (8, _at(140), 2, "view")],
        [(9, _at(400), 9, "view")],
        [(10, _at(401), 9, "view")],
    ]
    rows = [r for b in batches for r in b]
    for b in batches:
        spark.createDataFrame(b, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    _run(health.phases(stream, quiet=3600), "phases", tmp_path / "c")
    got = {tuple(r) for r in spark.table("phases").collect()}
    want = {tuple(r) for r in health.phases_of(spark.createDataFrame(rows, EVENTS), quiet=3600, until=_at(391)).collect()}
    assert got == want
    assert (3, None, _at(65), "DEGRADED") in got and (2, None, _at(91), "DEGRADED") in got and (1, None, _at(135), "DEGRADED") in got
    assert not any(r[0] == 9 and r[3] == "DEGRADED" for r in got)  # its timer is still running


def test_starts_without_an_end_expire(spark, tmp_path):
    schema = "step bigint, ts timestamp"
    starts = [[(1, _at(0)), (2, _at(1)), (3, _at(2))], [(4, _at(100)), (5, _at(300))], [(6, _at(301))]]
    ends = [[(1, _at(3))], [(2, _at(90)), (4, _at(101))], [(9, _at(301))]]
    for name, parts in (("s", starts), ("e", ends)):
        for p in parts:
            spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    _run(health.steps(read("s"), read("e")), "steps", tmp_path / "c")
    table = lambda name: spark.read.schema(schema).parquet(str(tmp_path / name))
    whole = {tuple(r) for r in health.steps(table("s"), table("e")).collect()}
    got = {tuple(r) for r in spark.table("steps").collect()}
    assert got == {r for r in whole if r[0] not in (5, 6)}  # their time is not over
    assert {(r[0], r[3], r[4]) for r in got} == {(1, 180000.0, "done"), (2, None, "expired"), (3, None, "expired"), (4, 60000.0, "done")}


def test_phases_of_a_history(spark):
    rows = [(1, _at(0), 1, "error"), (2, _at(1), 1, "view"), (2, _at(1), 1, "view"), (3, _at(200), 1, "view")]
    got = [(r["event_id"], r["ts"], r["phase"]) for r in health.phases_of(spark.createDataFrame(rows, EVENTS)).orderBy("ts", F.col("event_id").asc_nulls_last()).collect()]
    assert got == [(1, _at(0), "DEGRADED"), (2, _at(1), "RUNNING"), (None, _at(61), "DEGRADED"), (3, _at(200), "RUNNING"), (None, _at(260), "DEGRADED")]
    assert health.phases_of(spark.createDataFrame([], EVENTS)).count() == 0
