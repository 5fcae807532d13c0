"""Entity vectors, the incremental runner, checked requests, tools, steps, events, images and storage listing."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_operators import NODE

from corpusloom import api, providers
from corpusloom.functions import jsonx, text
from corpusloom.functions import vectors as V
from corpusloom.operators import answer, chunking, entities, graph, kg, tables
from corpusloom.plans import catalogue, pipelines, runner
from corpusloom.schemas import ExtractOptions
from corpusloom.sources import files, ocr
from corpusloom.sources.storage import Storage


def _nodes(spark):
    rows = [("a", "Alpha", "first letter"), ("b", "Beta", ""), ("c", "Gamma", "  "), ("d", "", None)]
    return spark.createDataFrame([(i, "s", n, "t", [], d, [], 1.0) for i, n, d in rows], NODE)


def test_entity_index(spark, tmp_path):
    nodes = _nodes(spark)
    assert sorted(map(tuple, entities.entity_texts(nodes).collect())) == [("a", "first letter"), ("b", "Beta"), ("c", "Gamma")]
    catalog = entities.Catalog(spark, str(tmp_path / "catalog"))
    work = pipelines.Workspace(spark, str(tmp_path / "work"))
    index = entities.sync(catalog, "My Entities!", nodes, vector=catalogue._char_embed(F.col("text")), dims=8, save=work.save)
    assert catalog.names() == ["my_entities"] and catalog.get("My Entities!").dims == 8
    query = spark.range(1).select(catalogue._char_embed(F.lit("Beta")).alias("v")).head()["v"]
    assert index.search(query, 1).head()["id"] == "b"
    with pytest.raises(ValueError, match="8 dimensions"):
        index.search([1.0], 1)
    with pytest.raises(ValueError, match="8 dimensions"):
        catalog.create(entities.IndexSpec("my entities", "t", "evec", 4))
    with pytest.raises(KeyError):
        catalog.get("other")
    more = spark.createDataFrame([("b", [0.0] * 8), ("z", query)], "id string, evec array<double>")
    assert {r["id"] for r in index.upsert(more).search(query, 2).collect()} >= {"z"} and index.upsert(more).rows.count() == 4
    with pytest.raises(Exception, match="must have 8 dimensions"):
        index.upsert(spark.createDataFrame([("q", [1.0])], "id string, evec array<double>")).rows.collect()
    assert entities.safe_name("9 lives") == "ix_9_lives"


def test_runner_extracts_once(spark, tmp_path):
    work = pipelines.Workspace(spark, str(tmp_path))
    chunk = lambda rows: spark.createDataFrame([(f"s:f:{i}", "s", "f", i, t) for i, t in rows], "cid string, series string, filename string, idx int, text string")
    first = chunk([(0, "Alpha met Beta."), (1, "  "), (2, "Beta saw Gamma.")])
    r = runner.Runner(work, buckets=2)
    assert r.history() is None
    one = r.run(first, limit=1)
    assert one["extracted"] == 1 and {n["name"] for n in one["nodes"].collect()} == {"Alpha", "Beta"}
    two = r.run(first)
    assert two["extracted"] == 1 and {n["name"] for n in two["nodes"].collect()} == {"Alpha", "Beta", "Gamma"}
    assert r.run(first)["extracted"] == 0 and r.history().count() == 2
    assert {(m["cid"]) for m in two["mentions"].where("entity_id IS NOT NULL").collect()} == {"s:f:0", "s:f:2"}
    assert two["quality"].head()["orphans"] == 0
    # The same graph as one run over everything, and an old extraction is not read again for it.
    whole = runner.Runner(pipelines.Workspace(spark, str(tmp_path / "other")), buckets=2).run(first)
    for table in ("nodes", "edges", "mentions"):
        assert sorted(map(str, two[table].collect())) == sorted(map(str, whole[table].collect()))


def test_mentions_are_not_capped(spark):
    """An entity of more chunks than its array may hold keeps all its mentions."""
    rows = [("s", "f", i, f"c{i}", [("Acme", "org", [], "", 0.9)], []) for i in range(500)]
    x = spark.createDataFrame(rows, "series string, filename string, idx int, cid string, entities array<struct<name:string,type:string,aliases:array<string>,desc:string,conf:double>>, relations array<struct<src:string,pred:string,dst:string,conf:double>>")
    nodes = kg.canonical_nodes(x)
    assert len(nodes.head()["cids"]) == tables.MAX_CIDS
    assert tables.link_evidence(kg.map_evidence(kg.evidence(x), kg.id_map(nodes)), x.select("cid")).count() == 500


def test_requests_and_tools(spark, tmp_path):
    assert api.chunk_options("word", 50, 10).size == 50
    for bad in ({"size": 49}, {"size": 8001}, {"overlap": -1}, {"overlap": 4001}):
        with pytest.raises(ValueError):
            api.chunk_options(**bad)
    docs = spark.createDataFrame([("s", "f", "Alpha met Beta. Beta saw Gamma in 1999.")], "series string, filename string, text string")
    work = pipelines.Workspace(spark, str(tmp_path))
    chunks = pipelines.ingest(work, docs)
    graph_ = pipelines.build_graph(work, chunks.selectExpr("cid", "series", "file AS filename", "`order` AS idx", "text"))
    tools = api.Tools(spark, chunks, graph_, lambda prompt: "an answer")
    assert tools.call("ping")["status"] == "up"
    out = tools.call("query", series="s", query="Alpha", mode="vector")
    assert out["answer"] == "an answer" and out["series"] == "s" and out["citations"]
    assert tools.call("search", query="alpha", mode="kg", series="s").count() == 1
    for bad in ({"query": "x"}, {"series": "s", "query": "x", "k": 0}, {"series": "s", "query": "x", "mode": "other"}, {"series": "s", "query": 3}, {"series": "s", "query": "x", "more": 1}):
        with pytest.raises(ValueError):
            tools.call("query", **bad)
    with pytest.raises(KeyError):
        tools.call("other")
    assert api.health(spark, {"chunks": chunks, "none": chunks.limit(0)})["tables"] == {"chunks": "ok", "none": "empty"}
    log = api.QueryLog(spark, str(tmp_path / "log"))
    assert log.run("SELECT :x AS x", x=5).head()["x"] == 5
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        log.run("SELECT * FROM nowhere_at_all")
    assert [r["error"] for r in log.read().orderBy("ts").collect()] == [None, "AnalysisException"]


def test_steps_and_events(spark):
    events = api.Events(size=2)
    for i in range(3):
        events.put("log", msg=i)
    events.put("step", step="x")
    events.put("status", phase="RUNNING")
    assert [events.next().get("kind") for _ in range(5)] == ["status", "step", "log", "log", "ping"] and events.dropped == 1
    docs = spark.createDataFrame([("s", "f", "One. Two.")], "series string, filename string, text string")
    o = api.Orchestrator([("chunk", api.chunk_step()), ("count", lambda s: {"n": s["chunks"].count()})])
    assert o.run({"docs": docs}, series="s")["n"] == 1
    assert [json.loads(x[6:])["phase"] for x in o.events.lines(lambda: True)] == ["start", "end", "start", "end"]
    with pytest.raises(ZeroDivisionError):
        api.Orchestrator([("bad", lambda s: 1 / 0)], o.events).run()
    assert [e["phase"] for e in o.events.queues["step"]] == ["start", "error"]


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    page = np.full((60, 90), 230.0) + rng.normal(0, 3, (60, 90))
    page[20:24, 10:80] = 20
    page[40:44, 10:80] = 25
    black = ocr.preprocess(np.repeat(page[..., None], 3, axis=2))
    assert black.shape == (60, 90) and set(np.unique(black)) <= {0, 255}
    assert (black[21:23, 15:75] == 0).mean() > 0.9 and (black[30:36, 15:75] == 255).mean() > 0.9
    assert ocr.skew(ocr.rotated(black, 3.0)) == pytest.approx(-3.0, abs=1.0) or ocr.skew(ocr.rotated(black, 3.0)) == pytest.approx(3.0, abs=1.0)
    assert ocr.otsu(np.array([[10.0, 12.0], [200.0, 210.0]])).tolist() == [[0, 0], [255, 255]]
    with pytest.raises(RuntimeError):
        ocr.recogniser("none")
    ocr.register("words", lambda image, langs: [(w, 90.0 - i) for i, w in enumerate(image.decode().split())])
    df = spark.createDataFrame([(b"two words",), (b"",), (None,)], "image binary")
    assert [tuple(r["o"]) for r in df.select(ocr.read(F.col("image"), ocr.recogniser("words")).alias("o")).collect()] == [("two words", 89.5), ("", None), ("", None)]
    d = tmp_path / "in" / "s"
    d.mkdir(parents=True)
    (d / "scan.png").write_bytes(b"from an image")
    r = files.extract(files.scan(spark, str(tmp_path / "in")), ExtractOptions(recogniser="words")).head()
    assert r["text"] == "from an image" and r["meta"]["confidence"] == "89.0"
    assert ExtractOptions.parse_langs("fra+eng, ara") == ("fra", "eng", "ara") and ExtractOptions.parse_langs(None) == ("eng",)


def test_sheets_keep_blank_cells_in_their_columns():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>a</t></is></c><c r="B1" t="inlineStr"><is><t>b</t></is></c><c r="C1" t="inlineStr"><is><t>c</t></is></c></row><row><c r="A2"><v>1</v></c><c r="C2"><v>3</v></c></row><row><c r="AA3"><v>9</v></c></row></sheetData></worksheet>'
    other = f'<worksheet {ns}><sheetData><row><c><v>7</v></c></row><row><c><v>8</v></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="urn:r"><sheets><sheet name="One" r:id="rId7"/><sheet name="Two" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="urn:p"><Relationship Id="rId2" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/worksheets/other.xml", sheet)
        z.writestr("xl/worksheets/sheet1.xml", other)
    got = [t for _, _, t, _ in files.read_xlsx(out.getvalue(), ExtractOptions())]
    assert got == ["# Sheet: One\na: 1 | b:  | c: 3\na:  | b:  | c: ", "# Sheet: Two\n7: 8"]


def test_languages_options_and_small_functions(spark):
    df = spark.createDataFrame([("the cat is with the dog",), ("les chats et une souris dans est",), ("x y",), ("zzz",), (None,)], "t string")
    assert [r["l"] for r in df.select(text.detect_language("t").alias("l")).collect()] == ["en", "fr", "es", None, None]
    docs = spark.createDataFrame([("s", "a", "One two. " * 60), ("s", "b", "w " * 300)], "series string, filename string, text string")
    reply = lambda prompt: '{"strategy": "word", "size": 100, "overlap": 500}' if "w w w" in prompt else "none"
    got = chunking.model_chunks(docs, reply).collect()
    assert {(r["filename"], r["strategy"]) for r in got} == {("a", "sentence"), ("b", "word")}
    assert all(len(r["text"].split()) <= 100 for r in got if r["filename"] == "b")
    one = spark.createDataFrame([(1, {"k": "v"}), (2, None)], "id int, meta map<string,string>")
    assert [r["j"] for r in one.select(jsonx.dump(F.col("meta")).alias("j"), jsonx.now_ms().alias("n")).collect()] == ['{"k":"v"}', "{}"]
    chunks = spark.createDataFrame([("b", "2", None), ("a", "1", {"p": "1"})], "cid string, text string, meta map<string,string>")
    assert [tuple(r) for r in chunking.ordered(chunks).collect()] == [("a", "1", '{"p":"1"}'), ("b", "2", "{}")]
    rows = spark.createDataFrame([("s1", 0, "the cat"), ("s2", 0, "the cat")], "series string, level int, text string").withColumn("id", F.col("series")).withColumn("vec", F.lit(None).cast("array<double>"))
    assert [r["id"] for r in answer.search_summaries(rows, "the cat", series="s2").collect()] == ["s2"]


def test_storage_listing_streams_and_metadata(spark, tmp_path):
    s = Storage(spark, f"file://{tmp_path}", max_bytes=10)
    s.create("one")
    assert s.put_stream("one", "a.txt", io.BytesIO(b"hello"))["size"] == 5
    for data in (b"", b"x" * 11):
        with pytest.raises(ValueError):
            s.put_stream("one", "b.txt", io.BytesIO(data))
    (tmp_path / "c.txt").write_text("file")
    assert s.put_file("one", str(tmp_path / "c.txt"))["filename"] == "c.txt"
    (tmp_path / "one" / "sub").mkdir()
    for name in ("sub/d.txt", "x.jsonl", "x.report", "extract_report.json"):
        (tmp_path / "one" / name).write_text("1")
    assert [f["id"] for f in s.imported("one")] == ["a.txt", "c.txt", "sub/d.txt"] and s.imported("none") == []
    table = spark.createDataFrame([("one",), ("two",)], "series string")
    assert s.metadata("one", {"chunks": table}) == {"series": "one", "files": 3, "size_bytes": 10, "tables": {"chunks": 1}}


def test_remote_providers_need_their_packages():
    for name in ("openai", "azure", "gemini", "local"):
        with pytest.raises(ImportError):
            providers.get(name)


def test_detect_is_one_level(spark):
    edges = catalogue.tpch_graph(spark, "/root/testdata/sf0.001")[1].where("pred = 'part_of'")
    got = graph.detect(edges, catalogue._rounds(spark), weighted=False).select("level").distinct().collect()
    assert [r["level"] for r in got] == [0]
