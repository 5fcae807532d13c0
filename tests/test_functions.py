"""Expressions against small models written from the specification, on edge cases."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import ids, jsonx, text
from corpusloom.functions import vectors as V
from corpusloom.operators import answer
from corpusloom.schemas import ChunkOptions, ExtractOptions, SearchRequest

TEXTS = ["", "no terminator", "One. Two! Three? Four.", "a" * 50, ". . .", "para one\n\npara two\n\n\n\nthree", "l1\r\nl2\rl3\nl4\x0bl5 l6", "x y z " * 40, "Long sentence " * 20 + ". short. " * 9, " \n ", "• a • b • c", "un deux trois"]


def _pack(parts, size, overlap):
    """What packing promises: greedy chunks, each led by the end of the finished one before."""
    chunks, buf = [], ""
    for p in parts:
        if len(buf) + len(p) + 1 <= size:
            buf = f"{buf} {p}" if buf else p
        else:
            chunks += [buf] if buf else []
            buf = p
    chunks += [buf] if buf else []
    out = []
    for c in chunks:
        out.append(c if not out or not overlap else (out[-1][-overlap:] + " " + c).strip())
    return out


def _split(strategy, t, size, overlap):
    clean = lambda xs: [x.strip() for x in xs if x.strip()]
    if strategy == "char":
        return clean(t[i : i + size] for i in range(0, len(t), max(1, size - overlap)))
    if strategy == "word":
        w, out, i = re.findall(r"\S+", t), [], 0
        while i < len(w):
            out.append(" ".join(w[i : i + size]))
            i = i + size - overlap if i + size < len(w) else len(w)
        return out
    if strategy == "recursive":
        pieces = [t]
        for sep in ChunkOptions.separators:
            pieces = [p for x in pieces for p in x.split(sep) if p]
            if sum(map(len, pieces)) / max(1, len(pieces)) <= size * 1.2:
                break
        return _pack(clean(pieces), size, overlap)
    parts = {"sentence": lambda: re.split(r"(?<=[.!?])\s+", t), "paragraph": lambda: re.split(r"\n{2,}", t), "line": t.splitlines}[strategy]()
    return _pack(clean(parts), size, overlap)


@pytest.mark.parametrize("strategy", ["char", "word", "sentence", "paragraph", "line", "recursive"])
@pytest.mark.parametrize("size,overlap", [(20, 5), (7, 0), (40, 39), (800, 150)])
def test_chunks(spark, strategy, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", text.chunks("t", ChunkOptions(strategy, size, overlap)).alias("c")).collect()}
    assert got == {i: _split(strategy, t, size, overlap) for i, t in enumerate(TEXTS)}


def test_unknown_strategy_means_sentences_and_bad_overlap_is_refused(spark):
    df = spark.createDataFrame([("A b. C d.",)], "t string")
    assert df.select(text.chunks("t", ChunkOptions("other"))).head()[0] == ["A b. C d."]
    with pytest.raises(ValueError):
        ChunkOptions("word", 10, 10)
    with pytest.raises(ValueError):
        SearchRequest("q", mode="x")


def test_fit_and_tokens(spark):
    rows = ["", "one two three", "First one here. Second one is here. Third.", "word " * 100, None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [tuple(r) for r in df.select(text.approx_tokens("t"), text.fit("t", 8), text.fit("t", 0)).collect()]
    assert [g[0] for g in got] == [0, 4, 11, 134, 0]
    assert got[1][1] == "one two three" and got[2][1] == "First one here." and got[3][1] == ("word " * 100)[:28] and got[4][1] == ""
    assert all(g[2] == "" for g in got)


def test_ranges_facts_and_normalising(spark):
    df = spark.createDataFrame([("1,2,5-8,10-,-5,x,2",)], "s string")
    assert df.select(text.parse_ranges("s")).head()[0] == [1, 2, 5, 6, 7, 8, 10]
    f = spark.createDataFrame([("A partir de 1,5 MDH, 120 m², 12 villas",), ("1.2.3 MAD",), ("",)], "t string").select(text.facts("t").alias("f")).select("f.*").collect()
    assert tuple(f[0]) == (1500000, 120.0, 12, "villas") and f[1]["price_from_mad"] is None and f[2]["area_m2"] is None
    n = spark.createDataFrame([("ﬁn a­b\nexam-\nple\r\n\r\n\r\nx  y",)], "t string")
    assert n.select(text.normalize()("t")).head()[0] == "fin ab\nexample\n\nx y"
    assert n.select(text.normalize(compat=True)("t")).head()[0] == "fin abexam-plex y"
    assert ExtractOptions(include=(1, 2), exclude=(2,)).allows(1) and not ExtractOptions(include=(1, 2), exclude=(2,)).allows(2)


def test_ids(spark):
    df = spark.createDataFrame([("s", " Été ", "T"), ("s", "été", "t"), ("s", "日本", "t"), ("s", "-- Ab c!", "t")], "series string, name string, kind string")
    c = [F.col(x) for x in ("series", "name", "kind")]
    r = df.select(ids.node_id(*c).alias("n"), ids.slug(c[1]).alias("s"), ids.fingerprint(c[1]).alias("f")).collect()
    assert r[0]["n"] == r[1]["n"] != r[2]["n"] and len(r[0]["n"]) == 16
    assert [x["s"] for x in r] == ["t", "t", "x", "---ab-c"]
    assert [x["f"] for x in r] == ["été", "été", "", ""]


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([], [1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0, 3.0], [1.0, 2.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = [r[0] for r in df.select(V.cosine(a, b, truncate=True)).collect()]
    assert got == pytest.approx([1 / math.sqrt(2), 0, 0, 1])
    with pytest.raises(Exception, match="unequal length"):
        df.select(V.cosine(a, b, strict=True)).collect()
    assert df.select(V.unit(a)).collect()[3][0] == pytest.approx([x / math.sqrt(14) for x in (1, 2, 3)])


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=30))
def test_hash_vector_is_a_unit(t):
    v = V.hash_vector(t)
    assert len(v) == 384 and abs((v * v).sum() - 1) < 1e-9


def test_replies(spark):
    rows = ['{"partial_answer": "a", "confidence": 0.9, "evidence": ["x"]}', '```json\n{"fragment": "b",}\n```', "plain text", "", None, 'so: {"answer": "c", "used": ["1", ], "confidence": 1} done']
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    m = [r[0] for r in df.select(jsonx.map_reply(F.col("raw"))).collect()]
    assert [(x["partial"], x["confidence"]) for x in m] == [("a", 0.9), ("b", 0.6), ("plain text", 0.4), ("", 0.4), ("", 0.4), ("c", 1.0)]
    r = [x[0] for x in df.select(jsonx.reduce_reply(F.col("raw"))).collect()]
    assert r[5]["used"] == ["1"] and r[2]["confidence"] == 0.5
    w = spark.createDataFrame([('{"winner": "a"}',), ('{"winner": "z"}',), ("NONE",)], "raw string").select(jsonx.link_reply(F.col("raw"), F.array(F.lit("a"), F.lit("b")))).collect()
    assert [x[0] for x in w] == ["a", None, None]
    t = spark.range(1).select(jsonx.render("{{a}} {b} {{c}}", a=F.lit("x"), c=F.lit(None).cast("string"))).head()[0]
    assert t == "x {b} "


@pytest.mark.parametrize("q,mode", [("Compare A et B", "graph"), ("qui a signé en 2020", "path"), ("Quelle relation", "path"), ("prix", "vector"), ("", "vector"), ("un mot " * 8, "graph"), ("qui " + "mot " * 20, "vector")])
def test_route(spark, q, mode):
    assert spark.range(1).select(answer.route(F.lit(q))["mode"]).head()[0] == mode
