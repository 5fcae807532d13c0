"""Files to text blocks: one ``binaryFile`` scan, parsed per file in Arrow batches."""

from __future__ import annotations

import csv
import functools
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.functions import vectors as V
from corpusloom.schemas import ExtractOptions
from corpusloom.sources import ocr

#: Parser of each extension: bytes and options to (page, order, text, meta) rows.
PARSERS: dict[str, Callable] = {}


def parser(*extensions: str):
    """Register a parser for extensions; users add their own the same way."""

    def add(f: Callable) -> Callable:
        for e in extensions:
            PARSERS[e] = f
        return f

    return add


def row_text(columns: list[str], values: list[str]) -> str:
    return " | ".join(f"{c}: {v}" for c, v in zip(columns, values, strict=False))


@parser(".txt", ".md")
def read_text(data: bytes, o: ExtractOptions):
    yield 1, 0, data.decode("utf-8", "ignore"), {"type": "paragraph", "source": "txt"}


@parser(".csv")
def read_csv(data: bytes, o: ExtractOptions):
    rows = list(csv.reader(io.StringIO(data.decode("utf-8", "ignore"))))
    if not rows:
        return
    head, body = rows[0], rows[1:]
    for n, at in enumerate(range(0, len(body), o.csv_rows_per_block)):
        yield 1, n, "\n".join(row_text(head, r) for r in body[at : at + o.csv_rows_per_block]), {"type": "table", "source": "csv"}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


@parser(".docx")
def read_docx(data: bytes, o: ExtractOptions):
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    words = lambda e: "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")
    body = next(e for e in root if _local(e.tag) == "body")
    paragraphs = [words(e) for e in body if _local(e.tag) == "p"]
    cells = [[words(c) for c in r if _local(c.tag) == "tc"] for t in body if _local(t.tag) == "tbl" for r in t if _local(r.tag) == "tr"]
    lines = [p for p in paragraphs if p.strip()] + ["| " + " | ".join(c) + " |" for c in cells]
    yield 1, 0, re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "\n".join(lines))).strip(), {"type": "paragraph", "source": "docx"}


@parser(".xlsx")
def read_xlsx(data: bytes, o: ExtractOptions):
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    targets = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = [s for s in book.iter() if _local(s.tag) == "sheet"]
    for n, s in enumerate(sheets):
        rel = next((v for k, v in s.attrib.items() if _local(k) == "id"), None)
        part = targets.get(rel) or f"worksheets/sheet{n + 1}.xml"
        sheet = ElementTree.fromstring(z.read(part.lstrip("/") if part.startswith("/") else f"xl/{part}"))
        rows = [_cells(r, shared) for r in sheet.iter() if _local(r.tag) == "row"]
        if rows:
            head = [rows[0].get(i, "") for i in range(max(rows[0], default=-1) + 1)]
            body = [row_text(head, [r.get(i, "") for i in range(len(head))]) for r in rows[1:]]
            yield n + 1, n, "\n".join([f"# Sheet: {s.get('name')}", *body]), {"type": "table", "source": "xlsx"}


def _cells(row, shared: list[str]) -> dict[int, str]:
    """Values of a row by column from 0; a cell without a reference follows the one before."""
    out, at = {}, -1
    for c in (e for e in row if _local(e.tag) == "c"):
        letters = re.match(r"[A-Z]+", c.get("r") or "")
        at = functools.reduce(lambda n, x: 26 * n + ord(x) - 64, letters[0], 0) - 1 if letters else at + 1
        v = next((e.text or "" for e in c if _local(e.tag) == "v"), "")
        inline = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
        out[at] = shared[int(v)] if c.get("t") == "s" and v else inline or v
    return out


@parser(".pdf")
def read_pdf(data: bytes, o: ExtractOptions):
    try:
        import fitz
    except ImportError:
        raise RuntimeError("no PDF reader is installed") from None
    for n, page in enumerate(fitz.open(stream=data, filetype="pdf"), 1):
        if not o.allows(n):
            continue
        if o.boxes:
            for k, (x0, y0, x1, y1, body, *_) in enumerate(page.get_text("blocks")):
                if body.strip():
                    yield n, k, body.strip(), {"type": "paragraph", "source": "pdf-blocks", "bbox": f"{x0:.1f},{y0:.1f},{x1:.1f},{y1:.1f}"}
            continue
        text = page.get_text("text").strip()
        if text:
            yield n, n - 1, text, {"type": "paragraph", "source": "pdf-text"}
        elif o.recogniser:
            yield _recognised(n, page.get_pixmap(dpi=o.dpi).tobytes("png"), o)


def _recognised(page: int, image: bytes, o: ExtractOptions):
    words = ocr.recogniser(o.recogniser)(image, o.langs)
    body, confidence = ocr._joined(words)
    return page, page - 1, body, {"type": "paragraph", "source": "ocr", "confidence": "" if confidence is None else f"{confidence:.1f}"}


@parser(".png", ".jpg", ".jpeg", ".tif", ".tiff")
def read_image(data: bytes, o: ExtractOptions):
    yield _recognised(1, data, o)


# File types by extension.
MIME = {".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".html": "text/html", ".json": "application/json", ".jsonl": "application/json"}


def mime(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.try_element_at(table, ids.extension(name))


def scan(spark: SparkSession, path: str, *, recursive: bool = False) -> DataFrame:
    """series, filename, path, size, mime, sha256, content of the files of series folders below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path if recursive else f"{path}/*")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.select(F.element_at(parts, -2).alias("series"), name.alias("filename"), "path", F.col("length").alias("size"), mime(name).alias("mime"), F.sha2("content", 256).alias("sha256"), "modificationTime", "content")


_SCHEMA = "series string, filename string, page int, `order` int, text string, meta map<string,string>, text_len int, status string, error string"


def extract(files: DataFrame, o: ExtractOptions | None = None) -> DataFrame:
    """Text blocks of every known file; a file that fails gives one row with its error instead."""
    o = o or ExtractOptions()
    parsers, engines = dict(PARSERS), dict(ocr._RECOGNISERS)
    known = files.where(ids.extension(F.col("filename")).isin(*parsers)).select("series", "filename", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ocr._RECOGNISERS.update(engines)
        for batch in batches:
            rows = []
            for series, name, content in batch.itertuples(index=False):
                try:
                    for page, order, text, meta in parsers["." + name.rsplit(".", 1)[-1].lower()](content, o):
                        if o.allows(page):
                            rows.append((series, name, page, order, text, meta, len(text), "ok", None))
                except Exception as e:
                    rows.append((series, name, None, None, None, None, None, "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["series", "filename", "page", "order", "text", "meta", "text_len", "status", "error"])

    return known.mapInPandas(run, _SCHEMA)


def page_linkage(blocks: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Whether the pages of each file belong together: the mean likeness of neighbours, with more than two pages."""
    pages = Window.partitionBy("series", "filename").orderBy("page", "order")
    near = blocks.withColumn("before", F.lag("text").over(pages))
    alike = F.avg(F.when(F.col("before").isNotNull(), V.jaccard(F.col("text"), F.col("before"))))
    out = near.groupBy("series", "filename").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(alike, F.lit(0.0)).alias("similarity"))
    return out.withColumn("mode", F.when((F.col("pages") > 2) & (F.round("similarity", 12) >= threshold), "linked").otherwise("per_page"))


def extract_report(blocks: DataFrame) -> DataFrame:
    """Status, blocks and characters per file."""
    ok = F.col("status") == "ok"
    return blocks.groupBy("series", "filename").agg(F.min("status").alias("status"), F.count(F.when(ok, 1)).alias("n_blocks"), F.coalesce(F.sum("text_len"), F.lit(0)).alias("n_chars"), F.max("error").alias("error"))


def series_details(files: DataFrame) -> DataFrame:
    """Files, bytes and first change of each series."""
    return files.groupBy("series").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.min("modificationTime").alias("since"))


def classify(files: DataFrame, allowed: tuple[str, ...] = (".txt", ".csv", ".pdf", ".docx", ".xlsx"), max_bytes: int = 64 << 20) -> DataFrame:
    """Uploads with the reason they are refused, null where they are accepted."""
    ext = ids.extension(F.col("filename"))
    reason = F.when(~ext.isin(*allowed), F.lit("extension not allowed")).when(F.coalesce("size", F.lit(0)) == 0, F.lit("empty file")).when(F.col("size") > max_bytes, F.lit("file too large"))
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def table_blocks(df: DataFrame, order: str, rows: int = 200, series: str = "table") -> DataFrame:
    """Rows of a table as text blocks of ``rows`` lines ``column: value | ...``, in order of a dense key from 0."""
    cells = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    line = F.concat_ws(" | ", *cells)
    block = F.floor(F.col(order) / rows).cast("int")
    each = df.select(block.alias("order"), F.struct(F.col(order).alias("k"), line.alias("line")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return each.groupBy("order").agg(text.alias("text")).select(F.lit(series).alias("series"), "order", "text")


_BLOCK = "doc STRUCT<series:STRING,filename:STRING>, page INT, `order` INT, text STRING, meta MAP<STRING,STRING>"


def read_blocks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of JSON lines; a line that is no block becomes a block of its raw text."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("j", F.from_json("value", _BLOCK))
    ok = F.col("j.text").isNotNull()
    return lines.select("j.doc.series", "j.doc.filename", F.coalesce("j.page", F.lit(1)).alias("page"), F.coalesce("j.order", F.lit(0)).alias("order"), F.when(ok, F.col("j.text")).otherwise(F.col("value")).alias("text"), "j.meta")


def read_chunks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunk lines; ``idx`` falls back to ``order``, the page to the meta's."""
    schema = "doc STRUCT<series:STRING,filename:STRING>, text STRING, idx INT, `order` INT, page INT, meta STRUCT<page:INT>"
    df = spark.read.schema(schema).json(path)
    idx = F.coalesce("idx", "order", F.lit(0))
    return df.select("doc.series", "doc.filename", idx.alias("idx"), ids.chunk_id(F.col("doc.series"), F.col("doc.filename"), idx).alias("cid"), "text", F.coalesce("page", "meta.page").alias("page"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Outputs of a report file that were written without error."""
    df = spark.read.option("multiLine", "true").schema("series STRING, items ARRAY<STRUCT<file:STRING,output:STRING,status:STRING>>").json(path)
    return df.select("series", F.explode("items").alias("i")).select("series", "i.*").where((F.coalesce("status", F.lit("ok")) == "ok") & F.col("output").isNotNull())


def append_history(df: DataFrame, path: str) -> None:
    """Rows added to an append-only history; readers see whole appends only."""
    df.write.mode("append").json(path)


def write_jsonl(df: DataFrame, path: str, by: tuple[str, ...] = ("series",)) -> None:
    """JSON lines by series; files are keyed by the full file name, so equal stems never meet."""
    df.write.partitionBy(*by).json(path)


def html_text(html: Column) -> Column:
    """Readable text of a page: without scripts, styles and tags, entities and blanks squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))
