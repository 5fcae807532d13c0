"""Blocks to chunks, chunk nodes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import ids, text
from corpusloom.operators import kg
from corpusloom.schemas import ChunkOptions

#: Block types that are never cut.
WHOLE = ("price_panel", "table")


def split_blocks(blocks: DataFrame, o: ChunkOptions | None = None) -> DataFrame:
    """Chunks of text blocks; ``idx`` counts through each file in page and block order.

    ``blocks``: series, filename, page, order, text and optionally btype,
    source.  The strategy ``llm`` picks options for each block on its own.
    """
    o = o or ChunkOptions()
    for name in ("btype", "source"):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast("string"))
    cut = text.chunks_suggested("text", o.separators) if o.strategy == "llm" else text.chunks("text", o)
    parts = F.when(F.lower("btype").isin(*WHOLE), F.array("text")).otherwise(cut)
    strategy = text.suggest("text")["strategy"] if o.strategy == "llm" else F.lit(o.strategy)
    df = blocks.select("series", "filename", "page", "order", "btype", "source", strategy.alias("strategy"), F.posexplode(parts).alias("pos", "text"))
    idx = F.row_number().over(Window.partitionBy("series", "filename").orderBy("page", "order", "pos")) - 1
    df = df.withColumn("idx", idx)
    return df.select("series", "filename", "idx", ids.chunk_id(F.col("series"), F.col("filename"), F.col("idx")).alias("cid"), "text", "page", "strategy", "btype", "source")


def model_chunks(docs: DataFrame, reply, o: ChunkOptions | None = None) -> DataFrame:
    """Chunks of whole documents by the options that a model proposes for each from a preview of it."""
    o = o or ChunkOptions()
    prompt = F.concat(F.lit(f"Choose how to cut the text for retrieval. Answer with one JSON object: strategy ({', '.join(text.STRATEGIES)}), size, overlap.\nText:\n"), F.substring("text", 1, text.PREVIEW))
    df = kg.ask(docs.withColumn("prompt", prompt), "prompt", "raw", reply).withColumn("options", text.model_options("raw", "text", o))
    df = df.select("series", "filename", "options", F.posexplode(text.chunks_by("text", F.col("options"), o.separators)).alias("idx", "text"))
    return df.select("series", "filename", "idx", ids.chunk_id(F.col("series"), F.col("filename"), F.col("idx")).alias("cid"), "text", F.col("options.strategy").alias("strategy"))


def ordered(chunks: DataFrame) -> DataFrame:
    """cid, text and meta ("{}" where there is none), by cid."""
    meta = F.coalesce(F.to_json("meta"), F.lit("{}")) if "meta" in chunks.columns else F.lit("{}")
    return chunks.select("cid", "text", meta.alias("meta")).orderBy("cid")


def document_chunks(docs: DataFrame, o: ChunkOptions | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of whole documents (series, filename, text): one block each, so no window and no shuffle."""
    o = o or ChunkOptions()
    cut = text.chunks_suggested("text", o.separators) if o.strategy == "llm" else text.chunks("text", o)
    df = docs.select("series", "filename", *keep, F.posexplode(cut).alias("idx", "text"))
    return df.select("series", "filename", "idx", ids.chunk_id(F.col("series"), F.col("filename"), F.col("idx")).alias("cid"), "text", *keep)


def report(chunks: DataFrame) -> DataFrame:
    """Chunks and characters per file."""
    return chunks.groupBy("series", "filename").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), F.max(F.length("text")).alias("longest"))


def fresh(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks whose (series, file, sha1 of text) was not processed before; each series has its own history."""
    keyed = chunks.withColumn("hash", F.sha1(F.col("text").cast("binary")))
    key = ["series", "filename", "hash"]
    return keyed.join(done.select(key).distinct(), key, "left_anti")
