"""Composed plans: corpus ingestion, graph building and question answering."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import jsonx
from corpusloom.functions import vectors as V
from corpusloom.operators import answer, chunking, graph, kg, search, tables
from corpusloom.operators.entities import VectorIndex
from corpusloom.operators.text_index import TextIndex
from corpusloom.schemas import BUDGETS, ChunkOptions, SearchRequest


class Workspace:
    """Tables of one corpus in a shared folder; every step writes a snapshot there and reads it back."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.turn = spark, path.rstrip("/"), 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a new snapshot of a table; older ones stay readable for running queries."""
        self.turn += 1
        target = f"{self.path}/{name}/{int(time.time() * 1000)}-{self.turn}"
        df.write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def checkpoint(self, df: DataFrame) -> DataFrame:
        return self.save(df, "_rounds")


def embed_chunks(chunks: DataFrame, *, dims: int = 384, embedder=None, provider: str = "hash", model: str = "sha256", build_id: str = "b0") -> DataFrame:
    """Chunk nodes with vectors of ``embedder``, which ``provider`` and ``model`` name, or of the hash embedder."""
    if embedder is not None and provider == "hash":
        raise ValueError("name the provider and the model of the embedder")
    vector = (embedder or V.hash_embed(dims))(F.col("text"))
    return chunks.select("cid", "series", F.col("filename").alias("file"), F.col("idx").alias("order"), "text", vector.alias("embedding"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(dims).alias("dims"), F.unix_timestamp().cast("double").alias("ts"), F.lit(build_id).alias("build_id"))


def build_graph(work: Workspace, chunks: DataFrame, *, reply: Callable[[str], str] = kg.rule_extractor, summarise: Callable[[str], str] | None = None, min_conf: float = 0.35, levels: int = 3, resolution: float = 1.2) -> dict[str, DataFrame]:
    """Extraction, canonical graph, linking, upsert, communities, hierarchy, summaries and their report."""
    extracted = work.save(kg.extract(chunks, reply), "extractions")
    nodes = work.save(kg.canonical_nodes(extracted, min_conf), "nodes_raw")
    edges = work.save(kg.canonical_edges(extracted, nodes, min_conf), "edges_raw")
    mapping = work.save(kg.id_map(nodes), "id_map")
    nodes = work.save(tables.upsert_entities(None, kg.link_nodes(nodes, mapping)), "nodes")
    edges = work.save(tables.upsert_relations(None, kg.remap_edges(edges, mapping), nodes), "edges")
    mentions = work.save(tables.link_evidence(kg.map_evidence(kg.evidence(extracted, min_conf), mapping), chunks), "mentions")
    membership = work.save(graph.communities(edges, work.checkpoint, levels=levels, resolution=resolution), "membership")
    parents = work.save(graph.hierarchy(membership), "parents")
    members = graph.members_text(graph.top_members(membership, nodes, edges))
    summaries = work.save(answer.summaries(members, summarise or (lambda prompt: prompt.split("\n", 1)[-1])), "summaries")
    out = {"nodes": nodes, "edges": edges, "mentions": mentions, "membership": membership, "parents": parents, "summaries": summaries}
    out["report"] = _report(out)
    return out


def _report(parts: dict[str, DataFrame]) -> DataFrame:
    rows = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def retrieve(request: SearchRequest, *, nodes: DataFrame, chunks: DataFrame, mentions: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None, names: TextIndex | None = None, words: TextIndex | None = None, vectors: VectorIndex | None = None) -> DataFrame:
    """Hits of a request: entities by name, chunks by vector (or words), or both fused on the chunk.

    Stored indexes of the request's series answer instead of scans where they
    are given: ``names`` over entities, ``words`` and ``vectors`` over chunks.
    """
    of = lambda df: df if request.series is None else df.where(F.col("series") == request.series)
    if "type" in request.filters:
        nodes = nodes.where(F.col("type") == request.filters["type"])
    terms = request.query.split()
    most = max(request.k, 50) if request.mode == "hybrid" else request.k
    entity = search.bm25(of(nodes), terms, most, text="name") if names is None or request.filters else names.search(terms, most)
    if request.mode == "kg":
        return entity.join(nodes.select("id", "name", "type"), "id")
    pool = of(chunks).withColumnRenamed("cid", "id")
    vector = (embed or (lambda q: V.hash_vector(q, 384).tolist()))(request.query)
    if vector and vectors is not None:
        dense = search.top_k(vectors.search(vector, request.k).select("id", "score").join(pool, "id"), request.k)
    elif vector:
        dense = search.vector_top_k(pool, vector, request.k)
    else:
        dense = search.bm25(pool, terms, request.k) if words is None else search.top_k(words.search(terms, request.k).join(pool, "id"), request.k)
    if request.mode == "dense":
        return dense
    if mentions is not None:  # entities count for the chunks that mention them
        entity = entity.join(mentions, entity["id"] == mentions["entity_id"]).groupBy("cid").agg(F.max("score").alias("score")).withColumnRenamed("cid", "id")
    return search.hybrid(entity, dense, request.k)


def ask(question: str, *, tables_: dict[str, DataFrame], chunks: DataFrame, reply: Callable[[str], str], mode: str = "auto", k: int = 12, n: int = 30, alpha: float = 0.8, theta: float = 0.05, budgets: dict | None = None) -> dict:
    """Answer bundle: mode, answer, citations, latency and token use.  Only the few final rows reach the driver."""
    began, b = time.time(), BUDGETS | (budgets or {})
    spark = chunks.sparkSession
    if mode == "auto":
        mode = spark.range(1).select(answer.route(F.lit(question))["mode"].alias("m")).head()["m"]
    cited: list[dict] = []
    if mode == "graph":
        found = answer.search_summaries(tables_["summaries"], question, vector=V.hash_vector(question).tolist())
        partials = answer.map_answers(found, question, reply, max_tokens=b["qfs_map"])
        prompt = answer.reduce_prompt(partials, question, max_tokens=b["qfs_reduce"])
        raw = spark.createDataFrame([(reply(prompt),)], "raw string").select(jsonx.reduce_reply(F.col("raw")).alias("r")).select("r.*")
        row = raw.head()
        text_, cited = row["answer"], [r.asDict() for r in answer.citations(raw, partials).collect()]
    elif mode == "path":
        seeds = search.keyword_top_n(tables_["nodes"], question, n).select("id", "score").orderBy(F.desc("score"), "id").limit(n)
        ranked = spark.createDataFrame([(r["id"], i) for i, r in enumerate(seeds.collect())], "id string, rank int")  # at most n rows
        best = graph.trails(tables_["nodes"], tables_["edges"], ranked, theta=theta, alpha=alpha, k=k)
        used = best.select(F.explode("nodes").alias("id")).distinct().join(tables_["nodes"].select("id", "name"), "id")
        lines = answer.path_lines(best, used, max_tokens=b["paths"], count=k).collect()  # at most k rows
        prompt = f"Question: {question}\n\n" + "\n".join(r["line"] for r in lines)
        text_, cited = reply(prompt), [{"src": r["src"], "dst": r["dst"], "score": r["score"]} for r in lines]
    else:
        mode = "vector"
        hits = search.vector_top_k(chunks.withColumnRenamed("cid", "id"), V.hash_vector(question).tolist(), k).collect()
        prompt = f"Question: {question}\n\n" + "\n".join(f"[{h['id']}] {h['text']}" for h in hits)
        text_, cited = reply(prompt), [{"id": h["id"], "score": h["score"]} for h in hits]
    # The keys of an answer.
    used_tokens = [int(len(x.split()) * 1.5) + 1 if x else 0 for x in (prompt, text_)]
    return {"mode_used": mode, "question": question, "answer": text_, "citations": cited, "latency_ms": int((time.time() - began) * 1000), "token_usage": {"prompt": used_tokens[0], "completion": used_tokens[1], "total": sum(used_tokens)}}


def ingest(work: Workspace, docs: DataFrame, o: ChunkOptions | None = None) -> DataFrame:
    """Documents (series, filename, text) to stored chunk nodes."""
    return work.save(embed_chunks(chunking.document_chunks(docs, o)), "chunks")


def query_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame], **args) -> DataFrame:
    """Any SQL over the graph's tables, which are named views while it is analysed."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or None)
