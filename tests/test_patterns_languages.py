"""Patterns against nested loops, language profiles against dictionaries and held-out rows, the log of executions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import languages, patterns
from corpusloom.operators.patterns import Edge, Node
from corpusloom.plans import query_log


def _graph(spark, rng, n=9, m=26):
    nodes = [(f"n{i}", rng.choice("xyz"), rng.random()) for i in range(n)]
    edges = [(f"e{i}", f"n{rng.randrange(n)}", f"n{rng.randrange(n + 1)}", rng.choice("pq")) for i in range(m)]  # some ends do not exist
    return nodes, edges, spark.createDataFrame(nodes, "id string, type string, conf double"), spark.createDataFrame(edges, "id string, src_id string, dst_id string, pred string")


def _walks(edges, start, types, direction, used):
    for i, a, b, p in edges:
        if (types and p not in types) or i in used:
            continue
        ends = {"out": [(a, b)], "in": [(b, a)], "any": [(a, b)] if a == b else [(a, b), (b, a)]}[direction]
        yield from ((i, v) for u, v in ends if u == start)


def _brute(nodes, edges, chain):
    def grow(at, used, rest, row):
        if not rest:
            yield row
            return
        (types, direction, (least, most)), (name, ok) = rest[0], rest[1]
        stack = [(at, used, 0)]
        while stack:
            here, taken, hops = stack.pop()
            if hops >= least and here in nodes and ok(nodes[here]):
                yield from grow(here, taken, rest[2:], {**row, name: here})
            if hops < most:
                stack += [(v, taken | {i}, hops + 1) for i, v in _walks(edges, here, types, direction, taken)]

    name, ok = chain[0]
    for n in nodes:
        if ok(nodes[n]):
            yield from grow(n, frozenset(), chain[1:], {name: n})


@pytest.mark.parametrize("seed", range(3))
def test_patterns_equal_nested_loops(spark, seed):
    nodes, edges, n, e = _graph(spark, random.Random(seed))
    by = {i: (t, c) for i, t, c in nodes}
    every = lambda _: True
    cases = [
        ([Node("a"), Edge(("p",)), Node("b", F.col("type") == "x"), Edge((), "in"), Node("c")], [("a", every), (("p",), "out", (1, 1)), ("b", lambda r: r[0] == "x"), ((), "in", (1, 1)), ("c", every)]),
        ([Node("a", F.col("conf") > 0.4), Edge((), "any", (1, 3)), Node("b", F.col("type") == "y")], [("a", lambda r: r[1] > 0.4), ((), "any", (1, 3)), ("b", lambda r: r[0] == "y")]),
        ([Node("a"), Edge(("q",), "any", (2, 2)), Node("b"), Edge(("p",), "out"), Node("c", F.col("type") == "z")], [("a", every), (("q",), "any", (2, 2)), ("b", every), (("p",), "out", (1, 1)), ("c", lambda r: r[0] == "z")]),
    ]
    for pattern, chain in cases:
        got = sorted(tuple(sorted(r.asDict().items())) for r in patterns.match(n, e, *pattern).collect())
        assert got == sorted(tuple(sorted(r.items())) for r in _brute(by, edges, chain))


def test_patterns_names_columns_and_pruning(spark, tmp_path):
    _, _, n, e = _graph(spark, random.Random(9))
    e.write.parquet(str(tmp_path / "e"))
    out = patterns.match(n, spark.read.parquet(str(tmp_path / "e")), Node("a"), Edge(("p",), name="r"), Node("b"), keep=("type",))
    assert set(out.columns) == {"a", "b", "r", "a_type", "b_type"} and all(len(r["r"]) == 1 for r in out.collect())
    assert "EqualTo(pred,p)" in out._jdf.queryExecution().toString()
    for bad in ([], [Node("a"), Node("b")], [Node("a"), Edge(), Node("a")]):
        with pytest.raises(ValueError):
            patterns.match(n, e, *bad)
    for bad in ({"direction": "up"}, {"hops": (2, 1)}, {"hops": (0, 1)}, {"hops": (1, 99)}):
        with pytest.raises(ValueError):
            Edge(**bad)
    assert patterns.match(n.limit(0), e, Node("a"), Edge(), Node("b")).count() == 0


def _hashes(text):
    words = [w for w in "".join(chr(c) if 97 <= c <= 122 or c >= 128 else " " for c in text.lower().encode()).split(" ") if w]
    raw = (" " + " ".join(words) + " ").encode("latin-1") if words else b""
    for n in languages.GRAMS:
        for i in range(len(raw) - n + 1):
            h = sum(b * p for b, p in zip(raw[i : i + n], languages.PRIMES, strict=False)) & 0xFFFFFFFF
            h = ((h ^ h >> 15) * languages.PRIMES[0]) & 0xFFFFFFFF
            yield h >> 32 - languages.BITS


def test_profiles_equal_dictionaries(spark):
    texts = {"en": ["The cat sat, on the mat!", "words of the house"], "de": ["Die Katze saß auf der Matte", "über das Haus"], "xx": ["123 ...", ""]}
    rows = [(lang, t) for lang, ts in texts.items() for t in ts] + [(None, "the the"), ("en", None)]
    model = languages.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.names == ["de", "en"]
    counts = {lang: {} for lang in model.names}
    for lang in model.names:
        for t in texts[lang]:
            for h in _hashes(t):
                counts[lang][h] = counts[lang].get(h, 0) + 1
    odds = lambda c, h: math.log((c.get(h, 0) + 1) / (sum(c.values()) + (1 << languages.BITS)))
    for text in ("the mat of Haus über", "Ünd das", "ß"):
        hs = list(_hashes(text))
        want = [sum(odds(counts[a], h) - odds(counts[b], h) for h in hs) / len(hs) for a, b in (("de", "en"), ("en", "de"))]
        assert model.scores(text) == pytest.approx(want)
    asked = spark.createDataFrame([("the house",), ("das Haus",), ("1 2",), ("",), (None,)], "text string")
    assert [r["language"] for r in languages.detect(asked, model).collect()] == ["en", "de", None, None, None]
    assert languages.fit(asked.selectExpr("CAST(NULL AS STRING) AS lang", "text")).best("the") is None


def test_profiles_on_held_out_rows_and_whole_texts(spark, sf):
    from corpusloom.plans import catalogue

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    held = catalogue.language_profiles(spark, sf).where("held_out AND language IS NOT NULL").join(d, "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("language")).cast("int"))).head()[0]
    assert right > 0.9
    model = languages.fit(d)
    body = d.where("lang = 'de' AND length(text) > 300").head()["text"]
    assert model.best("the of and with " * 20 + body * 40) == "de"  # decided beyond the beginning


def test_executions_are_logged(spark, tmp_path):
    log = query_log.ExecutionLog(spark, f"file://{tmp_path}/log")
    with log.listening():
        lazy = spark.range(100).where("id % 2 = 0")
        assert len(lazy.collect()) == 50
        slow = spark.range(1).select(F.expr("reflect('java.lang.Thread', 'sleep', 300L)"))
        slow.collect()
        with pytest.raises(Exception, match="wrong"):
            spark.range(1).select(F.raise_error(F.lit("wrong"))).collect()
    spark.range(3).collect()  # after the end: not logged
    rows = log.read().orderBy("ts").collect()
    assert len(rows) == 3 and rows[0]["rows"] == 50 and "Filter" in rows[0]["plan"]
    assert rows[1]["ms"] >= 250 and rows[2]["error"] and "wrong" in rows[2]["message"]
