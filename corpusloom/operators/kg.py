"""Knowledge-graph building: extraction, canonical nodes and edges, linking, quality."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import ids, jsonx
from corpusloom.operators.tables import MAX_CIDS, first_elements
from corpusloom.schemas import EXTRACTION

#: Capitalised runs that the offline extractor takes for names, by type word.
_NAME = re.compile(r"\b[A-ZÀ-Þ][\wÀ-ÿ'-]+(?: [A-ZÀ-Þ][\wÀ-ÿ'-]+)*")


_TYPES = {"entities": "ARRAY<STRUCT<name:STRING,type:STRING,aliases:ARRAY<STRING>,desc:STRING,conf:DOUBLE>>", "relations": "ARRAY<STRUCT<src:STRING,pred:STRING,dst:STRING,conf:DOUBLE>>"}


def rule_extractor(text: str) -> str:
    """Offline stand-in for a language model: capitalised runs are concepts, neighbours in a sentence are related.

    The reply is JSON, as a model's would be, so the same parser reads both.
    """
    entities: dict[str, dict] = {}
    relations = []
    for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
        names = list(dict.fromkeys(m.group(0) for m in _NAME.finditer(sentence)))
        for n in names:
            entities.setdefault(n, {"name": n, "type": "concept", "aliases": [], "desc": "", "conf": 0.6})
        relations += [{"src": a, "pred": "related_to", "dst": b, "conf": 0.5} for a, b in zip(names, names[1:], strict=False)]
    return json.dumps({"entities": list(entities.values()), "relations": relations})


def ask(rows: DataFrame, prompt: str, out: str, reply: Callable[[str], str]) -> DataFrame:
    """``rows`` with the replies of a provider; ``reply`` runs once per row inside Arrow batches."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: reply(t or ""))

    return rows.withColumn(out, run(F.col(prompt)))


def extract(chunks: DataFrame, reply: Callable[[str], str] = rule_extractor) -> DataFrame:
    """Chunks with the parsed entities and relations of the provider's reply.

    A broken reply gives empty lists and the text of the reply in ``error``.
    """
    df = ask(chunks, "text", "raw", reply).withColumn("x", jsonx.parse(F.col("raw"), EXTRACTION))
    ok = F.col("x.entities").isNotNull() | F.col("x.relations").isNotNull()
    lists = {k: F.coalesce(F.col(f"x.{k}"), F.from_json(F.lit("[]"), t)) for k, t in _TYPES.items()}
    return df.select("series", "filename", "cid", "idx", lists["entities"].alias("entities"), lists["relations"].alias("relations"), F.when(~ok, F.col("raw")).alias("error"))




def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def canonical_nodes(extracted: DataFrame, min_conf: float = 0.35) -> DataFrame:
    """One node for each (series, name, type), case and outer blanks aside.

    The first occurrence in (file, idx, position) order gives name, type,
    aliases and description; confidence is the greatest.  ``cids`` holds the
    first ``MAX_CIDS``; :func:`evidence` has all as rows.
    """
    e = _mentioned(extracted, min_conf)
    first = F.min_by(F.struct("name", "type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("desc", F.lit("")).alias("desc")), "seq")
    merged = e.groupBy("id", "series").agg(first.alias("f"), F.max("conf").alias("conf"))
    return _with_cids(merged, e.select("id", F.array("cid").alias("cids"))).select("id", "series", "f.*", "cids", "conf")


def _mentioned(extracted: DataFrame, min_conf: float) -> DataFrame:
    e = extracted.select("series", "filename", "idx", "cid", F.posexplode("entities").alias("pos", "e")).select("series", "cid", F.struct("filename", "idx", "pos").alias("seq"), "e.*")
    e = e.where((F.coalesce("conf", F.lit(0.0)) >= min_conf) & _present("name") & _present("type"))
    return e.withColumn("id", ids.node_id(F.col("series"), F.col("name"), F.col("type")))


def evidence(extracted: DataFrame, min_conf: float = 0.35) -> DataFrame:
    """(entity_id, cid): every chunk that names an entity, as rows."""
    return _mentioned(extracted, min_conf).select(F.col("id").alias("entity_id"), "cid").distinct()


def map_evidence(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Evidence rows after the ids of ``mapping``; unknown ids stay."""
    return rows.join(mapping, rows["entity_id"] == mapping["old_id"], "left").select(F.coalesce("new_id", "entity_id").alias("entity_id"), "cid").distinct()


def _with_cids(merged: DataFrame, rows: DataFrame, limit: int = MAX_CIDS, column: str = "cids") -> DataFrame:
    """``merged`` with the first distinct elements of the rows' arrays; never more than ``limit`` are gathered."""
    return merged.join(first_elements(rows, "id", column, limit), "id", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))


def canonical_edges(extracted: DataFrame, nodes: DataFrame, min_conf: float = 0.35) -> DataFrame:
    """One edge for each (source, predicate, target), keyed by its id.

    Ends are found by name among the series' nodes (the smallest id of a name),
    and are concept nodes where no such name exists.  ``cids`` holds the first
    ``MAX_CIDS``; :func:`edge_evidence` has all as rows.
    """
    return _merged_edges(_related(extracted, nodes, min_conf).withColumn("cids", F.array("cid")))


def _related(extracted: DataFrame, nodes: DataFrame, min_conf: float) -> DataFrame:
    r = extracted.select("series", "cid", F.explode("relations").alias("r")).select("series", "cid", "r.*")
    r = r.where((F.coalesce("conf", F.lit(0.0)) >= min_conf) & _present("src") & _present("dst") & _present("pred"))
    key = lambda c: F.lower(F.trim(c))
    by_name = nodes.groupBy("series", key(F.col("name")).alias("key")).agg(F.min("id").alias("found"))
    for end in ("src", "dst"):
        r = r.withColumn("key", key(F.col(end))).join(by_name, ["series", "key"], "left").withColumn(f"{end}_id", F.coalesce("found", ids.node_id(F.col("series"), F.col(end), F.lit("concept")))).drop("key", "found")
    return r.withColumn("id", ids.stable_id(F.col("series"), F.col("src_id"), F.col("pred"), F.col("dst_id")))


def edge_evidence(extracted: DataFrame, nodes: DataFrame, min_conf: float = 0.35) -> DataFrame:
    """(edge_id, cid): every chunk that states an edge, as rows."""
    return _related(extracted, nodes, min_conf).select(F.col("id").alias("edge_id"), "cid").distinct()


def _merged_edges(rows: DataFrame) -> DataFrame:
    merged = rows.groupBy("id").agg(F.min("series").alias("series"), F.min("src_id").alias("src_id"), F.min("dst_id").alias("dst_id"), F.min("pred").alias("pred"), F.max("conf").alias("conf"))
    return _with_cids(merged, rows).select("id", "series", "src_id", "dst_id", "pred", "cids", "conf")


def upsert_edges(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Edges by id, whether their ends exist or not: union of cids, greatest confidence; a monoid."""
    return _merged_edges(new if old is None else old.unionByName(new))


def linking_context(candidates: DataFrame, *, by: str = "mention_id", limit: int = 20) -> DataFrame:
    """For each mention the types its candidates have and their names and descriptions, the first ``limit`` by id."""
    first = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("id"))).where(F.col("rank") <= limit)
    line = F.concat_ws(": ", "name", F.nullif(F.col("desc"), F.lit("")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    types = candidates.groupBy(by).agg(F.array_sort(F.collect_set("type")).alias("types"))  # as many as there are types
    return first.groupBy(by).agg(F.array_join(rows, "\n").alias("context")).join(types, by)


def link_groups(nodes: DataFrame) -> DataFrame:
    """Nodes with their fingerprint group; names without a fingerprint stay alone."""
    fp = ids.fingerprint(F.col("name"))
    return nodes.withColumn("fp", F.when(fp == "", F.concat(F.lit("#"), F.col("id"))).otherwise(fp))


def id_map(nodes: DataFrame) -> DataFrame:
    """(old_id, new_id): each fingerprint group maps to its most confident node, then the smallest id."""
    g = link_groups(nodes)
    winner = g.groupBy("series", "fp").agg(F.min(F.struct((-F.coalesce("conf", F.lit(0.5))).alias("c"), F.col("id"))).alias("w"))
    return g.join(winner, ["series", "fp"]).select(F.col("id").alias("old_id"), F.col("w.id").alias("new_id"))


def link_nodes(nodes: DataFrame, mapping: DataFrame, limit: int = 20) -> DataFrame:
    """Nodes merged to the winners of ``mapping``: other names become aliases, evidence and confidence unite."""
    df = nodes.join(mapping, nodes["id"] == mapping["old_id"], "left").withColumn("new_id", F.coalesce("new_id", "id"))
    own = F.col("id") == F.col("new_id")
    names = F.concat(F.when(own, F.coalesce("aliases", F.array().cast("array<string>"))).otherwise(F.array("name")))
    out = df.groupBy(F.col("new_id").alias("id")).agg(F.min("series").alias("series"), F.max(F.when(own, F.col("name"))).alias("name"), F.max(F.when(own, F.col("type"))).alias("type"), F.max(F.when(own, F.col("desc"))).alias("desc"), F.max("conf").alias("conf"))
    out = _with_cids(out, df.select(F.col("new_id").alias("id"), names.alias("aliases")), limit, "aliases")
    out = _with_cids(out, df.select(F.col("new_id").alias("id"), "cids"))
    return out.select("id", "series", "name", "type", "aliases", "desc", "cids", "conf")


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends mapped (unknown ends stay) and equal ones merged."""
    df = edges
    for end in ("src_id", "dst_id"):
        m = mapping.select(F.col("old_id").alias(end), F.col("new_id").alias("to"))
        df = df.join(m, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    df = df.withColumn("id", ids.stable_id(F.col("series"), F.col("src_id"), F.col("pred"), F.col("dst_id")))
    return _merged_edges(df)


def quality(nodes: DataFrame, edges: DataFrame, series: str | None = None) -> DataFrame:
    """Counts of entities, relations, isolated entities and relations off the series, in one row."""
    of = lambda df: df if series is None else df.where(F.col("series") == series)
    ends = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
    s = nodes.select(F.col("id").alias("src_id"), F.coalesce("series", F.lit("")).alias("s"))
    d = nodes.select(F.col("id").alias("dst_id"), F.coalesce("series", F.lit("")).alias("d"))
    off = edges.join(s, "src_id").join(d, "dst_id").where((F.coalesce("series", F.lit("")) != F.col("s")) | (F.coalesce("series", F.lit("")) != F.col("d")))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [one(of(nodes), "entities"), one(of(edges), "relations"), one(of(nodes).join(ends, "id", "left_anti"), "isolated"), one(of(off), "off_series"), one(nodes.groupBy("id").count().where("count > 1"), "duplicate_ids"), one(edges.join(s.select("src_id").distinct(), "src_id", "left_anti"), "orphans")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out
