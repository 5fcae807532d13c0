"""Settings, providers and series folders."""

import json

import pytest

from corpusloom import config, providers
from corpusloom.sources.storage import Storage


def test_settings(tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(json.dumps({"x": "${HOST:local}:${PORT:1}", "y": {"z": ["${NONE}"]}, "k": 1}))
    b.write_text(json.dumps({"k": 2}))
    assert config.load(str(a), str(b), env={"PORT": "9"}) == {"x": "local:9", "y": {"z": [""]}, "k": 2}


def test_providers(spark):
    assert providers.get().capabilities()["dims"] == 384
    with pytest.raises(KeyError):
        providers.get("other")
    providers.register("again", providers.OfflineProvider)
    assert json.loads(providers.get("again").ask_llm("Alpha met Beta."))["relations"][0]["src"] == "Alpha"
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [len(r[0]) for r in df.select(providers.embedder(dims=8, batch=1)("t")).collect()] == [8, 8]
    assert [list(b) for b in providers.batch_iter([1, 2, 3], 2)] == [[1, 2], [3]]


def test_storage(spark, tmp_path):
    s = Storage(spark, f"file://{tmp_path}")
    name = s.create("My series")
    assert name == "My_series" and s.create("My series") == "My_series__1"
    with pytest.raises(FileExistsError):
        s.create("My series", on_conflict="error")
    assert s.save(name, "../a b.txt", b"salut")["filename"] == "_a_b.txt"
    assert s.save(name, "a.txt", b"1")["filename"] == "a.txt" and s.save(name, "a.txt", b"2")["filename"] == "a__1.txt"
    for bad in (("b.exe", b"oops"), ("c.txt", b"")):
        with pytest.raises(ValueError):
            s.save(name, *bad)
    s.save("My_series__1", "a.txt", b"3")
    assert s.merge(name, ["My_series__1"]) == 1 and s.list(name) == ["_a_b.txt", "a.txt", "a__1.txt", "a__2.txt"]
    assert s.delete(name, "a.txt") == 1 and s.delete(name, "nope") == 0
    assert s.delete(name) == 3 and s.series() == ["My_series__1"]
