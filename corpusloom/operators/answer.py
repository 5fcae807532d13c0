"""Routing, summaries, map and reduce, prompts: what turns hits into an answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import jsonx, text
from corpusloom.functions import vectors as V
from corpusloom.operators import kg, search

# Words that steer the automatic router.
COMPARE_WORDS = ["compare", "différence", "avantages", "inconvénients", "impact", "panorama", "synthèse", "overview"]
RELATION_WORDS = ["relation", "lié", "entre", "cause", "conséquence"]
FACT_STARTS = ["qui", "quoi", "quand", "où", "combien", "lequel", "laquelle"]
LONG_QUESTION = 14


def route(question: Column) -> Column:
    """Mode and rule of a question: graph for comparing or long open ones, path for relations and dated facts, else vector."""
    q = F.lower(text.strip(F.coalesce(question, F.lit(""))))
    has = lambda words: _any(q.contains(w) for w in words)
    fact = _any(q.startswith(w) for w in FACT_STARTS)
    long = F.size(text.words(q)) >= LONG_QUESTION
    mode = lambda m, r: F.struct(F.lit(m).alias("mode"), F.lit(r).alias("rule"))
    graph = has(COMPARE_WORDS) | (long & ~fact)
    path = has(RELATION_WORDS) | (fact & (q.rlike(r"\d") | q.contains("entre")))
    return F.when(graph, mode("graph", "global/sensemaking")).when(path, mode("path", "local/fact+relations")).otherwise(mode("vector", "fallback/simple"))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def level_number(level: Column) -> Column:
    """Level as a number, whether it was written 0 or "C0"."""
    return F.regexp_extract(level.cast("string"), r"(\d+)", 1).cast("int")


def summaries(members: DataFrame, reply: Callable[[str], str], *, max_tokens: int = 1000, embed: Column | None = None) -> DataFrame:
    """One summary row for each community from its members' text, ready to be searched."""
    prompt = jsonx.render("Level {{level}}. Summarise these entities:\n{{members}}", level=F.col("level"), members=text.fit("members", max_tokens))
    df = kg.ask(members.withColumn("prompt", prompt), "prompt", "text", reply)
    vec = embed if embed is not None else V.hash_embed()(F.col("text"))
    return df.select(F.concat_ws(":", "series", F.col("level").cast("string"), "cid").alias("id"), "series", "level", "text", vec.alias("vec"))


def search_summaries(rows: DataFrame, query: str, *, vector=None, series: str | None = None, levels: list[int] | None = None, limit: int = 12, max_tokens: int = 256) -> DataFrame:
    """Best summaries: cosine where both sides have vectors, else keyword overlap; texts cut to the budget."""
    df = rows if series is None else rows.where(F.col("series") == series)
    df = df if levels is None else df.where(F.col("level").isin(levels))
    words = V.keyword_overlap(F.col("text"), F.lit(query))
    score = words if vector is None else F.when(F.col("vec").isNotNull(), V.cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in vector]), truncate=True)).otherwise(words)
    return search.top_k(df.select("id", "level", "text", score.alias("score")), limit).withColumn("text", text.fit("text", max_tokens))


def map_answers(candidates: DataFrame, query: str, reply: Callable[[str], str], *, max_tokens: int = 512) -> DataFrame:
    """A partial answer from each candidate, in Arrow batches."""
    prompt = jsonx.render("Question: {{query}}\nContext:\n{{text}}", query=F.lit(query), text=text.fit("text", max_tokens))
    df = kg.ask(candidates.withColumn("prompt", prompt), "prompt", "raw", reply)
    return df.select("id", "level", jsonx.map_reply(F.col("raw")).alias("r")).select("id", "level", "r.*")


def reduce_prompt(partials: DataFrame, query: str, *, max_tokens: int = 1200, items: int = 12) -> str:
    """Prompt of the final call; the few best partials share its budget evenly."""
    rows = partials.orderBy(F.desc("confidence"), "id").limit(items)
    n = max(1, rows.count())
    share = max(1, max_tokens // n)
    parts = rows.select("id", text.fit("partial", share).alias("p")).collect()  # at most ``items`` rows
    return f"Question: {query}\n" + "\n".join(f"[{r['id']}] {r['p']}" for r in parts)


def citations(used: DataFrame, partials: DataFrame) -> DataFrame:
    """First sentence of every partial that the answer names, in the order named; unknown ids go."""
    each = used.select(F.posexplode("used").alias("pos", "id"))
    snippet = F.substring(F.element_at(F.split(F.coalesce("partial", F.lit("")), r"\. ", -1), 1), 1, 280)
    return each.join(partials.select("id", snippet.alias("snippet")), "id").orderBy("pos").select("pos", "id", "snippet")


def path_lines(paths: DataFrame, names: DataFrame, *, max_tokens: int = 800, count: int = 12) -> DataFrame:
    """Trails as text, the weakest first: ``<u> --[pred]--> <v> ; ...``."""
    lookup = names.agg(F.map_from_entries(F.collect_list(F.struct("id", "name"))).alias("names"))  # names of the few trails only
    share = max(1, max_tokens // max(1, count) // 8)
    df = paths.crossJoin(F.broadcast(lookup))
    name = lambda x: F.coalesce(F.try_element_at(F.col("names"), x), x)
    n = F.size("preds")
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("<"), text.fit(name(F.element_at("nodes", i)), share * 8), F.lit("> --["), F.element_at("preds", i), F.lit("]--> <"), text.fit(name(F.element_at("nodes", i + 1)), share * 8), F.lit(">")))
    return df.select("src", "dst", "score", F.concat(F.lit(" • "), F.array_join(steps, " ; ")).alias("line")).orderBy(F.col("score").asc(), "line")
