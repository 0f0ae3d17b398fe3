"""Symbol resolution, inventories and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import graph


def find_by_name(nodes: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """Nodes whose name holds the pattern, any case; % and _ are plain characters."""
    return nodes.filter(F.contains(F.lower("symbol_name"), F.lit(pattern.lower()))).orderBy("symbol_name", "file_path", "id").limit(limit)


def candidates(nodes: DataFrame, ref: str) -> DataFrame:
    """id, symbol_name, file_path, score of all nodes that the reference may mean, best first."""
    return nodes.select("id", "symbol_name", "file_path", X.symbol_score(ref, F.col("symbol_name")).alias("score")).filter("score > 0").orderBy(F.desc("score"), "symbol_name", "file_path", "id")


def resolve(nodes: DataFrame, ref: str) -> DataFrame:
    """The one node a reference means, or none: by id, by exact variants, then the best candidate where it is clear.

    Clear: the only one, one of 900 and more, or one of 700 and more that leads by 100.
    """
    top = candidates(nodes, ref).limit(2)
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "symbol_name", "file_path", "id")))
    two = ranked.agg(F.max(F.when(F.col("r") == 1, F.struct("id", "score"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("next"))
    clear = F.col("next").isNull() | (F.col("best.score") >= 900) | ((F.col("best.score") >= 700) & (F.col("best.score") - F.col("next") >= 100))
    by_id = nodes.filter(F.col("id") == ref).select("id", F.lit(0).alias("p"))
    by_name = nodes.filter(F.col("symbol_name").isin(X.symbol_variants(ref) or [""])).orderBy("file_path", "id").limit(1).select("id", F.lit(1).alias("p"))
    by_score = two.filter(clear & F.col("best").isNotNull()).select(F.col("best.id").alias("id"), F.lit(2).alias("p"))
    return by_id.unionByName(by_name).unionByName(by_score).orderBy("p", "id").limit(1).join(nodes, "id")


def list_file_symbols(nodes: DataFrame, file_path: str, query: str = "", limit: int = 25) -> DataFrame:
    """Symbols of a file in source order, with the total; any query word may fit name or signature."""
    n = nodes.filter(F.col("file_path") == file_path)
    words = query.lower().replace(",", " ").split()
    if words:
        hay = F.lower(F.concat_ws(" ", "symbol_name", *(["content_sum"] if "content_sum" in nodes.columns else [])))
        n = n.filter(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(hay, w)))
    return n.join(F.broadcast(n.agg(F.count("*").alias("total")))).orderBy("start_byte", "id").limit(min(limit, 100))


def key_symbols(nodes: DataFrame, scores: DataFrame, prefix: str = "", limit: int = 5) -> DataFrame:
    """The nodes of highest PageRank below a path prefix, with the total."""
    n = nodes.filter(F.col("file_path").startswith(prefix)) if prefix else nodes
    n = n.join(scores.select(F.col("node_id").alias("id"), "pagerank"), "id")
    return n.join(F.broadcast(n.agg(F.count("*").alias("total")))).orderBy(F.desc("pagerank"), "id").limit(min(limit, 50))


def hot_paths(nodes: DataFrame, scores: DataFrame, limit: int = 20) -> DataFrame:
    best = scores.filter("betweenness > 0").orderBy(F.desc("betweenness"), "node_id").limit(limit)
    return nodes.join(F.broadcast(best), F.col("id") == F.col("node_id")).drop("node_id")


def compare_neighbors(simple: DataFrame, a: str | int, b: str | int, depth: int = 1) -> DataFrame:
    """side (caller or callee), id, where: both, only_a or only_b, over what is within ``depth`` hops."""
    out = None
    for side, reverse in (("callee", False), ("caller", True)):
        na = graph.bfs(simple, [a], depth, reverse).select("id", F.lit(1).alias("a"))
        nb = graph.bfs(simple, [b], depth, reverse).select("id", F.lit(1).alias("b"))
        where = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both")
        here = na.join(nb, "id", "full_outer").select(F.lit(side).alias("side"), "id", where.alias("where"))
        out = here if out is None else out.unionByName(here)
    return out


def understand(nodes: DataFrame, simple: DataFrame, ref: str, scores: DataFrame, communities: DataFrame, intents: DataFrame) -> DataFrame:
    """The resolved node with its degrees, score, community and file intent, a row."""
    one = resolve(nodes, ref).select("id", "symbol_name", "file_path")
    n_in = simple.join(F.broadcast(one.select(F.col("id").alias("dst"))), "dst").agg(F.count("*").alias("callers"))
    n_out = simple.join(F.broadcast(one.select(F.col("id").alias("src"))), "src").agg(F.count("*").alias("callees"))
    return (
        one.join(F.broadcast(n_in)).join(F.broadcast(n_out))
        .join(scores.select(F.col("node_id").alias("id"), "pagerank", "betweenness"), "id", "left")
        .join(communities, "id", "left")
        .join(intents.select("file_path", "intent"), "file_path", "left")
    )


def explore(nodes: DataFrame, ref: str, limit: int = 10) -> DataFrame:
    """Exact names first, then names that hold the reference: id, symbol_name, file_path, match."""
    low = ref.lower()
    name = F.lower("symbol_name")
    match = F.when(name == low, "exact").when(F.contains(name, F.lit(low)), "contains")
    found = nodes.withColumn("match", match).filter("match IS NOT NULL")
    return found.orderBy(F.when(F.col("match") == "exact", 0).otherwise(1), "symbol_name", "id").select("id", "symbol_name", "file_path", "match").limit(limit)


def architecture(simple: DataFrame, scores: DataFrame, communities: DataFrame, limit: int = 5, pool: int = 50) -> DataFrame:
    """id, role, score: entry points, hubs and connectors by 0.4 PageRank / max + 0.3 betweenness + 0.3 out-degree / max."""
    entry = graph.entry_points(simple).select("id", F.lit(0).alias("p"), F.lit("entry").alias("role"))
    hub = graph.hubs(simple, pool).select("id", F.lit(1).alias("p"), F.lit("hub").alias("role"))
    conn = graph.connectors(simple, scores.select(F.col("node_id").alias("id"), "betweenness"), communities, pool).select("id", F.lit(2).alias("p"), F.lit("connector").alias("role"))
    roles = entry.unionByName(hub).unionByName(conn).groupBy("id").agg(F.min_by("role", "p").alias("role"))
    out = simple.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    full = roles.join(scores.select(F.col("node_id").alias("id"), "pagerank", "betweenness"), "id", "left").join(out, "id", "left").na.fill(0, ["pagerank", "betweenness", "out_degree"])
    m = graph.with_maximum(full, top_pr="pagerank", top_out="out_degree")
    share = lambda x, top: F.when(F.col(top) > 0, F.col(x) / F.col(top)).otherwise(0.0)
    return m.select("id", "role", (0.4 * share("pagerank", "top_pr") + 0.3 * F.col("betweenness") + 0.3 * share("out_degree", "top_out")).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def index_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """metric, key, value: nodes by type, files, edges, and the ten largest files."""
    row = lambda m, k, v: (F.lit(m).alias("metric"), k.cast("string").alias("key"), v.cast("long").alias("value"))
    types = nodes.groupBy("node_type").count().select(*row("nodes", F.col("node_type"), F.col("count")))
    files = nodes.agg(F.countDistinct("file_path").alias("n")).select(*row("files", F.lit("all"), F.col("n")))
    n_edges = edges.agg(F.count("*").alias("n")).select(*row("edges", F.lit("all"), F.col("n")))
    top = nodes.groupBy("file_path").count().orderBy(F.desc("count"), "file_path").limit(10).select(*row("top_file", F.col("file_path"), F.col("count")))
    return types.unionByName(files).unionByName(n_edges).unionByName(top)
