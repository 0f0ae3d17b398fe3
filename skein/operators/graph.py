"""Graph operators over (source_id, target_id[, edge_type]).

Everything is joins and aggregates; kernels that need random access to the whole
adjacency (betweenness, Louvain) run only below a checked size.  Beyond it,
betweenness goes on by joins and Louvain refuses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, drop

#: Kernels hold the adjacency of graphs up to this many edges in one process.
KERNEL_EDGES = 2_000_000
#: Betweenness takes the ends of so many edges, as numbers, to every task.
BETWEENNESS_EDGES = 8_000_000
#: Steps along edges that one batch of its sources may hold.
HELD = 2_000_000
#: Ids of a frontier up to so many are broadcast to the edges.
FRONTIER = 1_000_000
#: Steps of a loop that are planned as one, before their state is written.
PLANNED = 4


def pairs(edges: DataFrame, valid_ids: DataFrame | None = None) -> DataFrame:
    """The simple digraph: src, dst once each, no self-loops, both ends valid."""
    p = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).filter("src <> dst").distinct()
    if valid_ids is not None:
        ids = valid_ids.select(F.col("id").alias("_id"))
        p = p.join(ids, F.col("src") == F.col("_id"), "left_semi").join(ids, F.col("dst") == F.col("_id"), "left_semi")
    return p


def laid_out(p: DataFrame) -> DataFrame:
    """Edges of ``p`` once each, dealt out by ``src``: one exchange, with no table of all edges in a task before it."""
    return p.select("src", "dst").repartition("src").distinct()


def vertices(p: DataFrame) -> DataFrame:
    return p.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def add_edges(p: DataFrame, new: DataFrame) -> DataFrame:
    return p.unionByName(pairs(new)).distinct()


def remove_edges(p: DataFrame, gone: DataFrame) -> DataFrame:
    return p.join(gone.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")), ["src", "dst"], "left_anti")


def remove_nodes(p: DataFrame, ids: DataFrame) -> DataFrame:
    x = ids.select(F.col("id").alias("_id"))
    return p.join(x, F.col("src") == F.col("_id"), "left_anti").join(x, F.col("dst") == F.col("_id"), "left_anti")


def degrees(p: DataFrame) -> DataFrame:
    """id, in_degree, out_degree from one aggregation of both ends."""
    ends = p.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def with_maximum(df: DataFrame, **maxima: str) -> DataFrame:
    """Each named maximum over all rows as a column: a one-row aggregate joined back, not a global window."""
    top = df.agg(*[F.max(c).alias(name) for name, c in maxima.items()])
    return df.join(F.broadcast(top))


def in_degree_norm(p: DataFrame) -> DataFrame:
    d = p.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return with_maximum(d, top="in_degree").select("id", (F.col("in_degree") / F.col("top")).alias("score"))


def entry_points(p: DataFrame) -> DataFrame:
    return p.select(F.col("src").alias("id")).distinct().join(p.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def hubs(p: DataFrame, k: int) -> DataFrame:
    return p.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree")).orderBy(F.desc("out_degree"), "id").limit(k)


def callees(p: DataFrame, ids: list[str]) -> DataFrame:
    return p.filter(F.col("src").isin(ids)).select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))


def callers(p: DataFrame, ids: list[str]) -> DataFrame:
    return p.filter(F.col("dst").isin(ids)).select(F.col("dst").alias("id"), F.col("src").alias("neighbor"))


def meeting(p: DataFrame, by: str, ids: DataFrame, n_ids: int) -> DataFrame:
    """Edges of ``p`` whose end ``by`` is among ``n_ids`` distinct ids (id): broadcast up to a checked number."""
    x = ids.select(F.col("id").alias(by))
    return p.join(F.broadcast(x) if n_ids <= FRONTIER else x, by, "left_semi")


def bfs(p: DataFrame, roots: list, depth: int, reverse: bool = False, max_visited: int | None = None) -> DataFrame:
    """id, depth of all nodes within ``depth`` hops of any root, roots left out.

    One join a level; the frontier is anti-joined with what is known, so each node
    is expanded once.  ``p`` is read once a level and may repeat edges.
    ``max_visited`` stops after the level that passes it.
    """
    spark = p.sparkSession
    a, b = ("dst", "src") if reverse else ("src", "dst")
    known = spark.createDataFrame([(r, 0) for r in roots], f"id {p.schema[a].dataType.simpleString()}, depth int")
    frontier, n, found = known.select("id").distinct(), len(set(roots)), 0
    for d in range(1, depth + 1):
        new = meeting(p, a, frontier, n).select(F.col(b).alias("id")).distinct().join(known, "id", "left_anti").select("id", F.lit(d).alias("depth"))
        # lineage doubles with every level unless it is cut
        level = cut(new)
        known = known.unionByName(level)
        frontier, n = level.select("id"), level.count()
        found += n
        if not n or (max_visited is not None and found >= max_visited):
            break
    return known.filter("depth > 0")


def collect_deps(p: DataFrame, root: str | int, depth: int) -> DataFrame:
    """direction, id, depth: what the root needs and what needs it."""
    down = bfs(p, [root], depth).select(F.lit("dependency").alias("direction"), "id", "depth")
    return down.unionByName(bfs(p, [root], depth, reverse=True).select(F.lit("dependent").alias("direction"), "id", "depth"))


def impact_tiers(reached: DataFrame) -> DataFrame:
    tier = F.when(F.col("depth") == 1, "CRITICAL").when(F.col("depth") == 2, "HIGH").when(F.col("depth") == 3, "MEDIUM").otherwise("LOW")
    return reached.withColumn("tier", tier)


def risk_label(callers_: Column, routes: Column, callees_: Column, affected: Column, indirect: Column, score: Column) -> Column:
    high = (callers_ >= 4) | (routes >= 2) | (callees_ >= 8) | (affected >= 20) | (score >= 0.5)
    medium = (callers_ >= 1) | (routes >= 1) | (indirect >= 2) | (callees_ >= 3) | (affected >= 5) | (score >= 0.15)
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def trace_paths(p: DataFrame, start: str | int, goal: str | int, max_depth: int = 10, limit: int = 20) -> DataFrame:
    """Shortest call paths start -> goal: path (array of ids), length; ties by the ids.

    A breadth-first pass gives distances from the start; from the goal back, only
    edges between its layers stay, so neither the walk back nor the path join ever
    grows beyond what the start reaches.  ``p`` may repeat edges.
    """
    spark = p.sparkSession
    kind = p.schema["src"].dataType.simpleString()
    ahead = bfs(p, [start], max_depth).unionByName(spark.createDataFrame([(start, 0)], f"id {kind}, depth int"))
    hit = ahead.filter(F.col("id") == goal).agg(F.min("depth").alias("d")).first()["d"]
    empty = spark.createDataFrame([], f"path array<{kind}>, length int")
    if hit is None or hit == 0:
        return empty
    # backwards from the goal, only through nodes that lie one step nearer to the start
    on = spark.createDataFrame([(goal,)], f"id {kind}")
    n, steps = 1, None
    for d in range(hit - 1, -1, -1):
        layer = ahead.filter(F.col("depth") == d).select("id")
        here = meeting(meeting(p, "dst", on, n), "src", layer, layer.limit(FRONTIER + 1).count())
        here = cut(here.select("src", "dst", F.lit(d).alias("at")).distinct())
        steps = here if steps is None else steps.unionByName(here)
        on = here.select(F.col("src").alias("id")).distinct()
        n = on.limit(FRONTIER + 1).count()
    paths = spark.createDataFrame([([start], start)], f"path array<{kind}>, last {kind}")
    for d in range(hit):
        here = steps.filter(F.col("at") == d).select(F.col("src").alias("last"), "dst")
        # only the first ``limit`` prefixes of each node can be among the first paths
        grown = paths.join(here, "last").select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"))
        rank = F.row_number().over(Window.partitionBy("last").orderBy("path"))
        paths = grown.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")
    return paths.select("path", F.lit(hit).alias("length")).orderBy("path").limit(limit)


def pagerank(p: DataFrame, steps: int = 100, damping: float = 0.85, teleport: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """id, rank by power iteration; mass of dangling nodes goes to the teleport set.

    Ends when a step moves less than ``tolerance`` in all, or after ``steps``; a
    tolerance of 0 makes all of them.  ``teleport`` (id) makes it personalised;
    without, it is uniform.  ``p`` may repeat edges: they are laid out by source once,
    and a step shuffles the ranks and the sums only.  The state is one row a node,
    written after every step in place of the last.
    """
    spark = p.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # with the number given, the kept layout is what the join of every step asks for
    links = p.select("src", "dst").repartition(n, "src").distinct().persist()
    ends = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out")).unionByName(links.select(F.col("dst").alias("id"), F.lit(0).cast("long").alias("out")))
    v = cut(ends.groupBy("id").agg(F.sum("out").alias("out")))
    if teleport is None:
        base, count = v, v.count()
        t = F.lit(1.0 / max(count, 1))
    else:
        seeds = v.join(teleport.select("id").distinct(), "id", "left_semi").select("id")
        count = seeds.count()
        base = v.join(seeds.withColumn("t", F.lit(1.0 / max(count, 1))), "id", "left").select("id", "out", F.coalesce("t", F.lit(0.0)).alias("t"))
        t = F.col("t")
    if not count:
        links.unpersist()
        return v.select("id", F.lit(0.0).alias("rank"))
    state = base.withColumn("rank", t)
    old, lost = v, state.agg(F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("rank"))), F.lit(0.0))).first()[0]
    for _ in range(steps):
        share = state.filter("out > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("share"))
        sent = links.join(share.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        new = F.lit(1 - damping) * t + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(float(lost)) * t)
        state = cut(state.join(sent, "id", "left").select(*base.columns, new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")))
        drop(old)
        # one row
        lost, moved = state.agg(F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("rank"))), F.lit(0.0)), F.sum("moved")).first()
        old, state = state, state.drop("moved")
        if tolerance > 0 and moved < tolerance:
            break
    links.unpersist()
    return state.select("id", "rank")


def subgraph(p: DataFrame, ids: DataFrame) -> DataFrame:
    x = ids.select(F.col("id").alias("_id"))
    return p.join(x, F.col("src") == F.col("_id"), "left_semi").join(x, F.col("dst") == F.col("_id"), "left_semi")


def ppr_kernel(src: list[str], dst: list[str], seeds: list[str], candidates: list[str], neighbours: set[str], alpha: float = 0.85, eps: float = 1e-4, steps: int = 15) -> dict[str, float]:
    """Personalised PageRank of a candidate subgraph of a few hundred nodes.

    Teleports to the seeds among the candidates, else to the seeds' neighbours among
    them, else to all.  Only nodes that received mass in the last step are returned.
    """
    ids = sorted(set(candidates))
    at = {x: i for i, x in enumerate(ids)}
    if not ids:
        return {}
    home = [x for x in dict.fromkeys(seeds) if x in at] or sorted(x for x in neighbours if x in at) or ids
    t = np.zeros(len(ids))
    t[[at[x] for x in home]] = 1 / len(home)
    a = np.array([at[x] for x in src], int)
    b = np.array([at[x] for x in dst], int)
    out = np.bincount(a, minlength=len(ids)) if len(a) else np.zeros(len(ids))
    r = t.copy()
    for _ in range(steps):
        got = np.bincount(b, weights=r[a] / out[a], minlength=len(ids)) if len(a) else np.zeros(len(ids))
        new = (1 - alpha) * t + alpha * (got + r[out == 0].sum() * t)
        done = np.abs(new - r).sum() < eps
        r = new
        if done:
            break
    return {x: float(r[i]) for x, i in at.items() if r[i] > 0}


def modularity(p: DataFrame, communities: DataFrame) -> DataFrame:
    """q: modularity of (id, community) on the undirected projection, each edge once."""
    e = p.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    c = communities.select("id", "community")
    lab = e.join(c.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    ends = lab.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), (F.col("ca") == F.col("cb")).cast("int").alias("i")), F.struct(F.col("cb").alias("c"), F.lit(0).alias("i")))).alias("x"))
    per = ends.groupBy("x.c").agg(F.sum("x.i").alias("inside"), F.count("*").alias("deg"))
    m = per.agg((F.sum("deg") / 2).alias("m"))
    return per.join(F.broadcast(m)).agg(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), F.lit(2.0))).alias("q"))


def connectors(p: DataFrame, betweenness: DataFrame, communities: DataFrame, k: int) -> DataFrame:
    """id, betweenness, n_communities of nodes with neighbours in two communities or more."""
    few = communities.limit(FRONTIER + 1).count() <= FRONTIER
    # each end for itself: the layout by source serves one of the joins as it is
    ends = []
    for a, b in (("src", "dst"), ("dst", "src")):
        c = communities.select(F.col("id").alias(b), "community")
        ends.append(p.join(F.broadcast(c) if few else c, b).select(F.col(a).alias("id"), "community"))
    n = ends[0].unionByName(ends[1]).groupBy("id").agg(F.countDistinct("community").alias("n_communities"))
    return n.filter("n_communities >= 2").join(betweenness.filter("betweenness > 0"), "id").select("id", "betweenness", "n_communities").orderBy(F.desc("betweenness"), "id").limit(k)


def _adjacency(p: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = p.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"the graph has over {limit} edges; this kernel holds it in one process")
    e = p.toPandas()
    ids, at = np.unique(np.concatenate([e["src"].to_numpy(), e["dst"].to_numpy()]), return_inverse=True) if len(e) else (np.array([]), np.array([], int))
    return ids, at[: len(e)], at[len(e) :]


def betweenness_by_joins(p: DataFrame, blocks: int) -> DataFrame:
    """``betweenness`` of a graph of any size, exact, with sources in ``blocks`` rounds.

    Each round counts shortest paths from its sources level by level and hands
    dependencies back from the deepest level, all as joins on (source, node): rows
    grow with sources times reached nodes, so more blocks need less space and more
    time.
    """
    p = p.persist()
    v = cut(vertices(p))
    n = v.count()
    total = None
    for k in range(blocks):
        frontier = cut(v.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma")))
        levels, known = [frontier], frontier.select("s", "id")
        while not frontier.isEmpty():
            step = frontier.join(p, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
            frontier = cut(step.join(known, ["s", "id"], "left_anti"))
            levels.append(frontier)
            known = known.unionByName(frontier.select("s", "id"))
        deep = None
        for here, above in zip(levels[-2:0:-1], levels[-3::-1], strict=False):
            own = here.withColumn("delta", F.lit(0.0)) if deep is None else here.join(deep, ["s", "id"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
            own = cut(own)
            part = own.select("id", "s", F.col("delta").alias("x"))
            total = part if total is None else total.unionByName(part)
            back = own.join(p, F.col("id") == F.col("dst")).select("s", F.col("src").alias("id"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
            deep = cut(back.join(above, ["s", "id"]).groupBy("s", "id").agg(F.sum(F.col("sigma") * F.col("share")).alias("delta")))
        if total is not None:
            total = cut(total.groupBy("id").agg(F.sum("x").alias("x")).select("id", F.lit("").alias("s"), "x"))
    p.unpersist()
    scale = max(1, (n - 1) * (n - 2))
    got = v.withColumn("x", F.lit(0.0)).select("id", "x") if total is None else v.join(total.select("id", "x"), "id", "left")
    return got.select("id", F.least(F.lit(1.0), F.coalesce("x", F.lit(0.0)) / scale).alias("betweenness"))


def dependencies(first: np.ndarray, to: np.ndarray, n: int, sources: np.ndarray, held: int | None) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Brandes from all ``sources`` at once: (nodes, dependencies) of each layer, or None beyond ``held`` steps along edges.

    Only nodes that a source reaches are touched, each as one number for source and node.
    """
    keys, sigma = np.arange(len(sources), dtype=np.int64) * n + sources, np.ones(len(sources))
    layers, known, seen = [(keys, sigma, None, None)], keys, 0
    while len(keys):
        s, v = np.divmod(keys, n)
        counts = first[v + 1] - first[v]
        seen += int(counts.sum())
        if held is not None and seen > held:
            return None
        u = np.repeat(np.arange(len(keys)), counts)
        w = to[np.repeat(first[v] - np.cumsum(counts) + counts, counts) + np.arange(len(u))]
        met, at = np.unique(s[u] * n + w, return_inverse=True)
        new = known[np.minimum(np.searchsorted(known, met), len(known) - 1)] != met
        ok = new[at]
        u, at = u[ok], (np.cumsum(new) - 1)[at[ok]]
        keys, sigma = met[new], np.bincount(at, weights=sigma[u], minlength=int(new.sum()))
        layers.append((keys, sigma, u, at))
        known = np.sort(np.concatenate([known, keys]))
    out, delta = [], np.zeros(0)
    for here, above in zip(layers[:0:-1], layers[-2::-1], strict=True):
        if len(here[0]):
            out.append((here[0] % n, delta))
        delta = np.bincount(here[2], weights=above[1][here[2]] / here[1][here[3]] * (1 + delta[here[3]]), minlength=len(above[0]))
    return out


def betweenness(p: DataFrame, limit: int = BETWEENNESS_EDGES, blocks: int = 64) -> DataFrame:
    """id, betweenness (Brandes, over (n-1)(n-2), at most 1; zeros included).

    Up to ``limit`` edges, the adjacency goes to every task; sources are dealt out, a
    batch walks what its sources reach, and partial sums are added in Spark.  Beyond it, ``betweenness_by_joins``.
    """
    if p.limit(limit + 1).count() > limit:
        return betweenness_by_joins(p, blocks)
    spark = p.sparkSession
    ids, a, b = _adjacency(p, limit)
    n = len(ids)
    order = np.argsort(a, kind="stable")
    start = np.searchsorted(a[order], np.arange(n + 1))
    shared = spark.sparkContext.broadcast((start, b[order]))

    held = HELD

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, to = shared.value
        total = np.zeros(n)
        for batch in batches:
            sources, at, size = batch["id"].to_numpy(np.int64), 0, len(batch)
            while at < len(sources):
                found = dependencies(first, to, n, sources[at : at + size], held if size > 1 else None)
                if found is None:
                    size //= 2
                    continue
                for node, delta in found:
                    np.add.at(total, node, delta)
                at += size
        some = np.flatnonzero(total)
        yield pd.DataFrame({"node": some, "x": total[some]})

    sums = spark.range(n).repartition(max(1, min(n // 64, spark.sparkContext.defaultParallelism))).mapInPandas(run, "node long, x double").groupBy("node").agg(F.sum("x").alias("x"))
    names = spark.createDataFrame(pd.DataFrame({"node": np.arange(n), "id": ids}) if n else [], f"node long, id {p.schema['src'].dataType.simpleString()}")
    scale = max(1, (n - 1) * (n - 2))
    return names.join(sums, "node", "left").select("id", F.least(F.lit(1.0), F.coalesce("x", F.lit(0.0)) / scale).alias("betweenness"))


def louvain(p: DataFrame, limit: int = KERNEL_EDGES, passes: int = 10) -> DataFrame:
    """id, community: Louvain on the undirected projection, nodes in id order, resolution 1.

    Beyond the limit use ``label_propagation``, which stays distributed.
    """
    spark = p.sparkSession
    ids, a, b = _adjacency(p.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), limit)
    n = len(ids)
    member = np.arange(n)
    graph: list[dict[int, float]] = [{} for _ in range(n)]
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        graph[x][y] = graph[x].get(y, 0) + 1.0
        graph[y][x] = graph[y].get(x, 0) + 1.0
    two_m = 2.0 * len(a) or 1.0
    loops = [0.0] * n
    for _ in range(passes):
        size = len(graph)
        comm = list(range(size))
        deg = [sum(w.values()) + loops[i] for i, w in enumerate(graph)]
        tot = deg[:]
        moved, sweep = True, 0
        while moved and sweep < 20:
            moved, sweep = False, sweep + 1
            for i in range(size):
                links: dict[int, float] = {}
                for j, w in graph[i].items():
                    links[comm[j]] = links.get(comm[j], 0) + w
                own = comm[i]
                tot[own] -= deg[i]
                best, gain = own, links.get(own, 0) - tot[own] * deg[i] / two_m
                for c in sorted(links):
                    g = links[c] - tot[c] * deg[i] / two_m
                    if g > gain + 1e-12:
                        best, gain = c, g
                tot[best] += deg[i]
                if best != own:
                    comm[i], moved = best, True
        names = {c: k for k, c in enumerate(dict.fromkeys(comm))}
        if len(names) == size:
            break
        member = np.array([names[comm[x]] for x in member])
        new: list[dict[int, float]] = [{} for _ in names]
        new_loops = [0.0] * len(names)
        for i, w in enumerate(graph):
            ci = names[comm[i]]
            new_loops[ci] += loops[i]
            for j, x in w.items():
                cj = names[comm[j]]
                if ci == cj:
                    new_loops[ci] += x
                else:
                    new[ci][cj] = new[ci].get(cj, 0) + x
        graph, loops = new, new_loops
    return spark.createDataFrame(pd.DataFrame({"id": ids, "community": member.astype(np.int64)}) if n else [], "id string, community long")


def label_propagation(p: DataFrame, steps: int = 5) -> DataFrame:
    """id, community for graphs of any size: each node takes its neighbours' most frequent label, ties to the least.

    ``p`` may repeat edges.  Edges are laid out by one end, once in a plan; a step
    shuffles a vote for each and nothing else.  First labels all differ, so the first
    step takes the least neighbour.
    """
    both = laid_out(p.select("src", "dst").unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    if not steps:
        return both.select(F.col("src").alias("id"), F.col("src").alias("community")).distinct()
    labels = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("community"))
    kept = None
    for i in range(1, steps):
        votes = both.join(labels.withColumnRenamed("id", "src").hint("shuffle_hash"), "src").select("dst", "community").repartition("dst").groupBy("dst", "community").agg(F.count("*").alias("n"))
        labels = votes.groupBy(F.col("dst").alias("id")).agg(F.min_by("community", F.struct((-F.col("n")).alias("m"), "community")).alias("community"))
        if i % PLANNED == 0:
            old, kept = kept, cut(labels)
            labels = kept
            drop(old)
    return labels
