"""Graph operators: degree, neighbours, bounded trails, communities, hierarchy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import join_by_count


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected view (edge_id, u, v, conf, pred): each edge from either end."""
    e = edges.select(F.col("id").alias("edge_id"), F.col("src_id").alias("u"), F.col("dst_id").alias("v"), F.coalesce("conf", F.lit(0.5)).alias("conf"), "pred")
    back = e.where("u <> v").select("edge_id", F.col("v").alias("u"), F.col("u").alias("v"), "conf", "pred")
    return e.unionByName(back)


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src_id", "dst_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Targets of the edges that leave a node."""
    return edges.where(F.col("src_id") == node).select(F.col("dst_id").alias("id"), "pred", F.coalesce("weight" if "weight" in edges.columns else "conf", F.lit(1.0)).alias("weight"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct(), "id", "left_anti")


#: Trails that a task makes, or ranks.
TRAIL_ROWS = 1 << 19


def trails(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, *, hops: int = 3, theta: float = 0.05, alpha: float = 0.8, per_pair: int = 6, k: int | None = 12, checkpoint=None) -> DataFrame:
    """Best undirected trails of at most ``hops`` edges between two seeds.

    No edge occurs twice in a trail; nodes may.  Edges and nodes below
    ``theta`` are dropped before the first hop, which equals testing whole
    paths.  The score is ``alpha ** (length - 1)`` times the mean confidence of
    all nodes and edges.  ``seeds`` (id, rank) is the stated set; a pair runs
    from the lower to the higher rank.  A hop either ends at such a seed or
    goes to a node from which the hops that are left still lead to a seed, so
    walks that lead nowhere are never made.

    With ``checkpoint``, which writes a DataFrame and reads it back, walks are
    counted by node before they are made: a node where they would give more
    than ``TRAIL_ROWS`` is dealt to several tasks, and as many tasks rank the
    trails as there are ``TRAIL_ROWS`` of them.  Without it, as suits a few
    seeds, Spark's own number of tasks makes them.
    """
    n = nodes.select("id", F.coalesce("conf", F.lit(0.5)).alias("conf")).where(F.col("conf") >= theta)
    e = both_ways(edges).where(F.col("conf") >= theta)
    ok = n.select(F.col("id").alias("v"), F.col("conf").alias("v_conf"))
    step = e.join(ok, "v").join(n.select(F.col("id").alias("u")), "u", "left_semi")
    save = checkpoint or (lambda df: df)
    step = save(step)
    start = seeds.select(F.col("id").alias("src"), F.col("rank").alias("src_rank"))
    stop = seeds.select(F.col("id").alias("v"), F.col("rank").alias("dst_rank"))
    last = save(step.join(stop, "v"))
    # onward[d]: steps to nodes from which a seed is one to d steps away.
    towards, onward = last.select(F.col("u").alias("v")).distinct(), {}
    for left in range(1, hops):
        onward[left] = save(step.join(towards, "v", "left_semi"))
        towards = towards.union(onward[left].select(F.col("u").alias("v"))).distinct()
    now = n.join(start, n["id"] == start["src"]).select("src", "src_rank", F.col("src").alias("at"), F.array("src").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.array().cast("array<string>").alias("preds"), F.col("conf").alias("total"))
    turns = [(hop, near) for hop in range(1, hops + 1) for near in (last, onward.get(hops - hop)) if near is not None]
    meetings = _meetings(now, turns, last) if checkpoint else [None] * len(turns)
    rows = _counted(meetings) if checkpoint else [0] * len(turns)
    found = None
    for (hop, near), meeting, n_rows in zip(turns, meetings, rows, strict=True):
        met = _met(now, near, meeting, n_rows)
        met = met.where(F.col("src_rank") < F.col("dst_rank")) if near is last else met
        grown = met.where(~F.array_contains("edges", F.col("edge_id"))).select("src", "src_rank", F.col("v").alias("at"), F.array_append("nodes", F.col("v")).alias("nodes"), F.array_append("edges", F.col("edge_id")).alias("edges"), F.array_append("preds", F.col("pred")).alias("preds"), (F.col("total") + F.col("conf") + F.col("v_conf")).alias("total"))
        if near is not last:
            now = grown
            continue
        hit = grown.select("src", F.col("at").alias("dst"), "nodes", "edges", "preds", F.lit(hop).alias("length"), (F.lit(alpha ** (hop - 1)) * F.col("total") / (2 * hop + 1)).alias("score"))
        found = hit if found is None else found.unionByName(hit)
    total = sum(r for (_, near), r in zip(turns, rows, strict=True) if near is last)
    if total > TRAIL_ROWS:
        found = found.repartition(_tasks(nodes, total), "src", "dst")
    rank = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.round("score", 12).desc(), "length", F.array_join("edges", "|")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= per_pair).drop("rank")
    return best if k is None else best.orderBy(F.round("score", 12).desc(), "src", "dst", F.array_join("edges", "|")).limit(k)


def _meetings(now: DataFrame, turns: list[tuple[int, DataFrame]], last: DataFrame) -> list[DataFrame]:
    """For each turn (u, rows, parts): trails that the walks at a node and its steps give, and the tasks that make them."""
    walks, out = now.groupBy(F.col("at").alias("u")).agg(F.count(F.lit(1)).alias("walks")), []
    for _, near in turns:
        both = near.groupBy("u").agg(F.count(F.lit(1)).alias("steps")).join(walks, "u").select("u", "walks", (F.col("walks") * F.col("steps")).alias("rows"))
        out.append(both.select("u", "rows", F.least("walks", F.ceil(F.col("rows") / F.lit(TRAIL_ROWS))).cast("int").alias("parts")))
        if near is not last:
            walks = near.join(walks, "u").groupBy(F.col("v").alias("u")).agg(F.sum("walks").alias("walks"))
    return out


def _counted(meetings: list[DataFrame]) -> list[int]:
    counts = None
    for i, m in enumerate(meetings):
        one = m.agg(F.lit(i).alias("i"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
        counts = one if counts is None else counts.unionByName(one)
    return [r["rows"] for r in sorted(counts.collect(), key=lambda r: r["i"])]


def _tasks(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TRAIL_ROWS))


def _met(now: DataFrame, steps: DataFrame, meetings: DataFrame | None, rows: int) -> DataFrame:
    """Walks beside the steps that leave their node; ``rows`` of them in all."""
    if rows <= TRAIL_ROWS:
        return now.join(steps, now["at"] == steps["u"])
    many = meetings.where("parts > 1").select("u", "parts")
    deal = lambda df, part: df.join(many, "u", "left").withColumn("part", part(F.coalesce("parts", F.lit(1)))).drop("parts")
    left = deal(now.withColumn("u", F.col("at")), lambda n: F.pmod(F.xxhash64("src", "edges"), n).cast("int"))
    right = deal(steps, lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
    tasks = 4 * _tasks(now, rows)  # parts fall on tasks by hash
    return left.repartition(tasks, "u", "part").join(right.repartition(tasks, "u", "part"), ["u", "part"])


def _leiden(edges: pd.DataFrame, gamma: float) -> dict:
    """Deterministic local moving and aggregation on one component, nodes in order of id."""
    names = sorted(set(edges["u"]) | set(edges["v"]))
    index = {x: i for i, x in enumerate(names)}
    members = [[i] for i in range(len(names))]
    graph: list[dict[int, float]] = [{} for _ in names]
    for u, v, w in edges[["u", "v", "w"]].itertuples(index=False):
        a, b = index[u], index[v]
        graph[a][b] = graph[a].get(b, 0.0) + w
        if a != b:
            graph[b][a] = graph[b].get(a, 0.0) + w
    label = list(range(len(names)))
    while True:
        n = len(graph)
        strength = [sum(g.values()) + g.get(i, 0.0) for i, g in enumerate(graph)]
        total = sum(strength) or 1.0
        own, mass = list(range(n)), list(strength)
        moved_any = False
        for _ in range(50):
            moved = False
            for i in range(n):
                links: dict[int, float] = {}
                for j, w in graph[i].items():
                    if j != i:
                        links[own[j]] = links.get(own[j], 0.0) + w
                old = own[i]
                mass[old] -= strength[i]
                gain = lambda c, i=i, links=links: links.get(c, 0.0) - gamma * strength[i] * mass[c] / total
                best = old
                for c in sorted(links):
                    if gain(c) > gain(best) + 1e-12:
                        best = c
                mass[best] += strength[i]
                if best != old:
                    own[i], moved, moved_any = best, True, True
            if not moved:
                break
        # Refinement: a community falls apart into its connected parts.
        part = [-1] * n
        count = 0
        for i in range(n):
            if part[i] < 0:
                part[i], todo = count, [i]
                while todo:
                    x = todo.pop()
                    for j in graph[x]:
                        if part[j] < 0 and own[j] == own[i]:
                            part[j] = count
                            todo.append(j)
                count += 1
        if not moved_any or count == n:
            break
        merged: list[list[int]] = [[] for _ in range(count)]
        next_graph: list[dict[int, float]] = [{} for _ in range(count)]
        for i in range(n):
            merged[part[i]] += members[i]
            for j, w in graph[i].items():
                a, b = part[i], part[j]
                if i <= j:
                    next_graph[a][b] = next_graph[a].get(b, 0.0) + w
                    if a != b:
                        next_graph[b][a] = next_graph[b].get(a, 0.0) + w
        members, graph = merged, next_graph
    for c, group in enumerate(members):
        for i in group:
            label[i] = c
    smallest: dict[int, str] = {}
    for i, name in enumerate(names):
        smallest.setdefault(label[i], name)
    return {name: smallest[label[i]] for i, name in enumerate(names)}


def connected(edges: DataFrame, checkpoint) -> DataFrame:
    """(id, component): smallest id reachable, by large-star and small-star rounds.

    Each round is written by ``checkpoint(df)``; it ends when a round changes
    nothing.  Stars are minima per node, combined before the shuffle; the edges
    of a hub are joined by count.
    """
    pair = edges.select(F.greatest("src_id", "dst_id").alias("u"), F.least("src_id", "dst_id").alias("v"))
    now = checkpoint(pair.where("u <> v").distinct())
    size, mark = now.count(), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = join_by_count(both.where("v > u"), least, "u", 2 * size, "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(down.union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        seen = tuple(now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).head())
        if seen == mark:
            break
        size, mark = seen[0], seen
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")


#: Edges of a component up to which one task works on it; larger ones are worked on by all executors.
COMPONENT_EDGES = 2_000_000


def parallel_leiden(edges: DataFrame, gamma: float, checkpoint, passes: int = 10) -> DataFrame:
    """(entity_id, cid): communities of whole components in rounds of joins, without a group for a component.

    ``edges``: component, u, v, w.  A pass moves single nodes (:func:`refine`),
    splits what fell apart, and contracts the communities to the nodes of the
    next pass, until none can be joined; then the nodes of the whole graph move
    once more.
    """
    pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    now, member = checkpoint(edges.groupBy("component", *pair).agg(F.sum("w").alias("w"))), None
    for _ in range(passes):
        nodes = now.select(F.explode(F.array("u", "v")).alias("entity_id")).distinct()
        part = checkpoint(refine(now, nodes.withColumn("cid", F.col("entity_id")), gamma, checkpoint))
        one = part.withColumnRenamed("entity_id", "node")
        member = part if member is None else checkpoint(member.withColumnRenamed("cid", "node").join(one, "node").select("entity_id", "cid"))
        before, after = part.agg(F.count(F.lit(1)), F.count_distinct("cid")).head()
        if before == after:
            break
        for end in ("u", "v"):
            now = now.join(one.withColumnRenamed("node", end), end).withColumn(end, F.col("cid")).drop("cid")
        now = checkpoint(now.groupBy("component", *pair).agg(F.sum("w").alias("w")))
    return refine(edges, member, gamma, checkpoint)


def refine(edges: DataFrame, labels: DataFrame, gamma: float, checkpoint, rounds: int = 24) -> DataFrame:
    """(entity_id, cid): communities after moving single nodes of the whole graph, on all executors.

    ``edges``: component, u, v, w; ``labels``: entity_id, cid.  In a round every
    node looks for the neighbouring community that it gains most by, and a coin,
    a hash of node and round, lets half of those that want to move do so.  It
    ends when nobody wants to, or after ``rounds``.  What falls apart then is
    split into its connected parts.
    """
    loops = edges.where("u = v").select("component", "u", (2 * F.col("w")).alias("w"))
    ways = edges.where("u <> v").select("component", "u", "v", "w").unionByName(edges.where("u <> v").select("component", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    ways = checkpoint(ways.groupBy("component", "u", "v").agg(F.sum("w").alias("w")))
    strength = checkpoint(ways.select("component", "u", "w").unionByName(loops).groupBy("component", "u").agg(F.sum("w").alias("s")))
    total = checkpoint(strength.groupBy("component").agg(F.sum("s").alias("total")))
    now = checkpoint(labels.select(F.col("entity_id").alias("u"), F.col("cid").alias("own")))
    calm = 0
    for turn in range(rounds):
        node = now.join(strength, "u")
        mass = node.groupBy(F.col("own").alias("c")).agg(F.sum("s").alias("mass"))
        links = ways.join(now.select(F.col("u").alias("v"), F.col("own").alias("c")), "v").groupBy("u", "c").agg(F.sum("w").alias("k"))
        links = links.unionByName(now.select("u", F.col("own").alias("c"), F.lit(0.0).alias("k"))).groupBy("u", "c").agg(F.sum("k").alias("k"))
        each = links.join(mass, "c").join(node, "u").join(total, "component")
        gain = F.col("k") - gamma * F.col("s") * (F.col("mass") - F.when(F.col("c") == F.col("own"), F.col("s")).otherwise(0.0)) / F.col("total")
        best = each.withColumn("gain", F.round(gain, 9)).groupBy("u", "own").agg(F.min_by("c", F.struct((-F.col("gain")).alias("less"), "c")).alias("to"), F.max("gain").alias("most"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
        wants = F.col("most") > F.col("stay")
        coin = F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(2)) == 0
        moved = checkpoint(best.select("u", "own", F.when(wants & coin, F.col("to")).otherwise(F.col("own")).alias("to"), wants.alias("wants")))
        calm = 0 if moved.where("wants").limit(1).count() else calm + 1
        now = moved.select("u", F.col("to").alias("own"))
        if calm:
            break
    inside = ways.where("u < v").join(now, "u").join(now.select(F.col("u").alias("v"), F.col("own").alias("other")), "v").where("own = other")
    part = connected(inside.select(F.col("u").alias("src_id"), F.col("v").alias("dst_id")), checkpoint)
    return now.join(part.withColumnRenamed("id", "u"), "u", "left").select(F.col("u").alias("entity_id"), F.coalesce("component", "u").alias("cid"))


def communities(edges: DataFrame, checkpoint, *, levels: int = 3, resolution: float = 1.2, limit: int = COMPONENT_EDGES) -> DataFrame:
    """(series, level, cid, entity_id) at resolution ``resolution * (1 + 0.5 * level)``.

    Communities never cross connected components, so each (series, component)
    is one group of Arrow rows.  Components of more than ``limit`` edges go
    through :func:`parallel_leiden` instead.  A community is named by its
    smallest member.
    """
    of = connected(edges, checkpoint)
    e = edges.select("series", F.col("src_id").alias("u"), F.col("dst_id").alias("v"), F.coalesce("conf", F.lit(1.0)).alias("w"))
    e = e.join(of.select(F.col("id").alias("u"), "component"), "u", "left").withColumn("component", F.coalesce("component", "u"))
    e = checkpoint(e.select("series", "component", "u", "v", "w"))
    large = checkpoint(e.groupBy("series", "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("series", "component"))
    schema = "series string, level int, cid string, entity_id string"

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        series = batch["series"].iloc[0]
        rows = [(series, level, cid, node) for level in range(levels) for node, cid in _leiden(batch, resolution * (1 + 0.5 * level)).items()]
        return pd.DataFrame(rows, columns=["series", "level", "cid", "entity_id"])

    if large.isEmpty():
        return e.groupBy("series", "component").applyInPandas(run, schema)
    key = ["series", "component"]
    out = e.join(large, key, "left_anti").groupBy(*key).applyInPandas(run, schema)
    # Series share no community: nodes and components carry their series.
    own = lambda c: F.concat_ws("\x00", "series", c)
    big = checkpoint(e.join(large, key, "left_semi").select(own("component").alias("component"), own("u").alias("u"), own("v").alias("v"), "w"))
    part = lambda c, i: F.split(c, "\x00")[i]
    for level in range(levels):
        found = parallel_leiden(big, resolution * (1 + 0.5 * level), checkpoint)
        out = out.unionByName(found.select(part("entity_id", 0).alias("series"), F.lit(level).alias("level"), part("cid", 1).alias("cid"), part("entity_id", 1).alias("entity_id")))
    out = checkpoint(out)
    first = out.groupBy("series", "level", "cid").agg(F.min("entity_id").alias("name"))
    return out.join(first, ["series", "level", "cid"]).select("series", "level", F.col("name").alias("cid"), "entity_id")


def detect(edges: DataFrame, checkpoint, *, resolution: float = 1.0, weighted: bool = True) -> DataFrame:
    """One level of communities at one resolution, by confidence or with all edges alike."""
    if not weighted:
        edges = edges.withColumn("conf", F.lit(1.0))
    return communities(edges, checkpoint, levels=1, resolution=resolution)


def modularity(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Modularity of each (series, level) for a given membership."""
    e = edges.select("series", F.col("src_id").alias("u"), F.col("dst_id").alias("v"), F.coalesce("conf", F.lit(1.0)).alias("w"))
    m = membership.select("series", "level", "cid", "entity_id")
    a = m.select("series", "level", F.col("entity_id").alias("u"), F.col("cid").alias("cu"))
    b = m.select("series", "level", F.col("entity_id").alias("v"), F.col("cid").alias("cv"))
    inside = e.join(a, ["series", "u"]).join(b, ["series", "level", "v"]).groupBy("series", "level").agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("m"))
    ends = e.select("series", F.col("u").alias("entity_id"), "w").unionByName(e.select("series", F.col("v").alias("entity_id"), "w"))
    k = ends.groupBy("series", "entity_id").agg(F.sum("w").alias("k"))
    mass = m.join(k, ["series", "entity_id"]).groupBy("series", "level", "cid").agg(F.sum("k").alias("k")).groupBy("series", "level").agg(F.sum(F.col("k") * F.col("k")).alias("k2"), F.count(F.lit(1)).alias("communities"))
    return inside.join(mass, ["series", "level"]).select("series", "level", "communities", (F.col("inside") / F.col("m") - gamma * F.col("k2") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def hierarchy(membership: DataFrame) -> DataFrame:
    """Communities of adjacent levels that share entities, with the number shared."""
    lo = membership.select("series", F.col("level").alias("lo_level"), F.col("cid").alias("lo_cid"), "entity_id")
    hi = membership.select("series", F.col("level").alias("hi_level"), F.col("cid").alias("hi_cid"), "entity_id")
    both = lo.join(hi, ["series", "entity_id"]).where(F.col("hi_level") == F.col("lo_level") + 1)
    return both.groupBy("series", "lo_level", "lo_cid", "hi_level", "hi_cid").agg(F.count(F.lit(1)).alias("overlap"))


def top_members(membership: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 40) -> DataFrame:
    """Members of each community by degree, the first ``limit``."""
    d = degree(edges)
    df = membership.join(nodes.select(F.col("id").alias("entity_id"), "name"), "entity_id").join(d.withColumnRenamed("id", "entity_id"), "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("series", "level", "cid").orderBy(F.desc("degree"), "entity_id"))
    return df.withColumn("rank", rank).where(F.col("rank") <= limit).select("series", "level", "cid", "entity_id", "name", "degree", "rank")


def members_text(top: DataFrame) -> DataFrame:
    """One line of member names for each community, most linked first."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])
    return top.groupBy("series", "level", "cid").agg(F.array_join(names, ", ").alias("members"))
