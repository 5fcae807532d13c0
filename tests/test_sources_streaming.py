"""File readers and streams."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from corpusloom.operators import tables
from corpusloom.schemas import ExtractOptions
from corpusloom.sources import files, keyed
from corpusloom.streaming import flows

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _folder(tmp_path):
    d = tmp_path / "in" / "s1"
    d.mkdir(parents=True)
    (d / "a.txt").write_bytes(b"Bonjour\xff")
    (d / "a.csv").write_text("x,y\n" + "".join(f"{i},\n" for i in range(3)))
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    (d / "b.docx").write_bytes(_zip({"word/document.xml": f"<w:document {_W}><w:body>{p('One')}{p(' ')}<w:tbl><w:tr><w:tc>{p('c1')}</w:tc><w:tc>{p('c2')}</w:tc></w:tr></w:tbl></w:body></w:document>"}))
    sheet = f'<worksheet {_X}><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>k</t></is></c></row><row><c><v>5</v></c><c><v>6</v></c></row></sheetData></worksheet>'
    (d / "c.xlsx").write_bytes(_zip({"xl/workbook.xml": f'<workbook {_X}><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {_X}><si><t>h</t></si></sst>", "xl/worksheets/sheet1.xml": sheet}))
    (d / "bad.docx").write_bytes(b"nothing")
    (d / "b.exe").write_bytes(b"oops")
    return str(tmp_path / "in")


def test_extract_every_format(spark, tmp_path):
    f = files.scan(spark, _folder(tmp_path))
    rows = files.extract(f, ExtractOptions(csv_rows_per_block=2)).orderBy("filename", "order").collect()
    got = [(r["filename"], r["order"], r["text"]) for r in rows if r["status"] == "ok"]
    assert got == [("a.csv", 0, "x: 0 | y: \nx: 1 | y: "), ("a.csv", 1, "x: 2 | y: "), ("a.txt", 0, "Bonjour"), ("b.docx", 0, "One\n| c1 | c2 |"), ("c.xlsx", 0, "# Sheet: S\nh: 5 | k: 6")]
    report = {r["filename"]: (r["status"], r["n_blocks"]) for r in files.extract_report(files.extract(f)).collect()}
    assert report["bad.docx"] == ("error", 0) and report["a.txt"] == ("ok", 1) and "b.exe" not in report
    d = files.series_details(f).head()
    assert d["series"] == "s1" and d["files"] == 6
    c = {r["filename"]: r["reason"] for r in files.classify(f).collect()}
    assert c["b.exe"] == "extension not allowed" and c["a.txt"] is None
    assert f.where("filename = 'a.txt'").head()["mime"] == "text/plain"


def test_jsonl_round_trip_and_fallbacks(spark, tmp_path):
    p = tmp_path / "b.jsonl"
    p.write_text(json.dumps({"doc": {"series": "s", "filename": "f"}, "page": 2, "order": 1, "text": "ok x"}) + "\nnot json\n\n")
    got = [(r["page"], r["order"], r["text"]) for r in files.read_blocks_jsonl(spark, str(p)).collect()]
    assert got == [(2, 1, "ok x"), (1, 0, "not json")]
    q = tmp_path / "c.jsonl"
    q.write_text("\n".join(json.dumps({"doc": {"series": "s1", "filename": "f"}, "text": t, "order": i, "meta": {"page": 1}}) for i, t in enumerate("ab")))
    assert [(r["cid"], r["page"]) for r in files.read_chunks_jsonl(spark, str(q)).collect()] == [("s1:f:0", 1), ("s1:f:1", 1)]
    r = tmp_path / "r.json"
    r.write_text(json.dumps({"series": "s", "items": [{"file": "a", "output": "x", "status": "ok"}, {"file": "b", "status": "error"}]}))
    assert [x["output"] for x in files.read_report(spark, str(r)).collect()] == ["x"]
    files.write_jsonl(spark.createDataFrame([("s", "f", "t")], "series string, filename string, text string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_merge_series_renames(spark):
    f = spark.createDataFrame([("a", "x.txt", 1), ("b", "x.txt", 2), ("b", "y", 3)], "series string, filename string, seq int")
    assert sorted(r["stored_name"] for r in tables.merge_series(f, ["a", "b"], "c").collect()) == ["x.txt", "x__1.txt", "y"]


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_stream_ingest_skips_what_it_has_seen(spark, tmp_path):
    d = spark.createDataFrame([("s", "f1", "One. Two."), ("s", "f2", "One. Two.")], "series string, filename string, text string")
    for k in range(2):
        d.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = flows.new_chunks(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("ingested").option("checkpointLocation", str(tmp_path / "c")).start()
    _drain(q)
    assert sorted(r["filename"] for r in spark.table("ingested").collect()) == ["f1", "f2"]


def test_stream_upserts_equal_the_batch(spark, tmp_path):
    from corpusloom.plans.catalogue import _versions

    one, two = _versions(spark, "/root/testdata/sf0.001")
    for part in (one, two):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = flows.upsert_sink(spark, str(tmp_path / "out"), tables.upsert_entities, buckets=4)
    q = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).start()
    _drain(q)
    state = lambda: sorted(map(str, keyed.KeyedTable(spark, str(tmp_path / "out")).rows(tables.upsert_entities).select(one.columns).collect()))
    last = state()
    assert last == sorted(map(str, tables.upsert_entities(one, two).select(one.columns).collect()))
    sink(two, 1)  # a batch that is run again counts once
    assert state() == last


def test_stream_states_equal_the_batch(spark, sf, tmp_path):
    from corpusloom.plans import catalogue

    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    halves = [e.where("event_id < 500"), e.where("event_id >= 500")]
    for h in halves:
        h.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = flows.read_events(spark, str(tmp_path / "in"))
    _drain(flows.status_changes(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "a")).start())
    got = {(r["key"], r["event_id"]) for r in spark.table("changes").collect()}
    if e.where("event_id < 500").agg(F.max("ts")).head()[0] <= e.where("event_id >= 500").agg(F.min("ts")).head()[0]:
        assert got == {(r["user_id"], r["event_id"]) for r in catalogue.status_changes(spark, sf).collect()}
    assert len(got) > 0
    _drain(flows.windowed(stream).writeStream.format("memory").outputMode("update").queryName("windows").option("checkpointLocation", str(tmp_path / "b")).start())
    assert spark.table("windows").count() > 0
