"""Incremental work: histories by series, failed replies, checked parameters."""

import json

from corpusloom import api
from corpusloom.plans import pipelines, runner

CHUNKS = "cid string, series string, filename string, idx int, text string"
GOOD = json.dumps({"entities": [{"name": "Ada", "type": "person", "conf": 0.9}], "relations": []})


def _chunk(series):
    return (f"{series}:a.txt:0", series, "a.txt", 0, "the same text")


def test_each_series_has_its_own_history(spark, tmp_path):
    r = runner.Runner(pipelines.Workspace(spark, f"file://{tmp_path}"), lambda _: GOOD, buckets=2)
    assert r.run(spark.createDataFrame([_chunk("A")], CHUNKS))["extracted"] == 1
    out = r.run(spark.createDataFrame([_chunk("A"), _chunk("B")], CHUNKS))
    assert out["extracted"] == 1
    assert {x["series"] for x in r.history().collect()} == {"A", "B"}


def test_failed_replies_stay_due(spark, tmp_path):
    work = pipelines.Workspace(spark, f"file://{tmp_path}")
    chunks = spark.createDataFrame([_chunk("A")], CHUNKS)
    bad = runner.Runner(work, lambda _: "no json", buckets=2).run(chunks)
    assert (bad["extracted"], bad["errors"], bad["nodes"].count()) == (1, 1, 0)
    good = runner.Runner(work, lambda _: GOOD).run(chunks)
    assert (good["extracted"], good["errors"], good["nodes"].count()) == (1, 0, 1)
    assert runner.Runner(work, lambda _: GOOD).run(chunks)["extracted"] == 0


def test_budgets_are_passed_on():
    got = api.checked(api.QUESTION_TOOL, ("series", "query"), {"series": "s", "query": "q", "budgets": {"map": 300}})
    assert got["budgets"] == {"map": 300}
