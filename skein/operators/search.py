"""Hybrid search: lexical, vector and graph signals over candidates.

Lexical and vector top lists stay in Spark.  The candidate set is
max(5 * limit, 100) rows a list whatever the corpus, so its subgraph kernel and the
seeds are a bounded collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import HANDLES, ROUTE, SearchConfig
from . import fts, graph, vector
from .lineage import cut


def normalize_scores(scored: DataFrame, name: str) -> DataFrame:
    """id, name: min-max over the list, the largest of repeated ids; 0.5 where all are equal."""
    best = scored.groupBy("id").agg(F.max("score").alias("s"))
    ends = best.agg(F.min("s").alias("low"), F.max("s").alias("high"))
    return best.join(F.broadcast(ends)).select("id", X.minmax(F.col("s"), F.col("low"), F.col("high")).alias(name))


def per_file_cap(results: DataFrame, cap: int, route_query: bool = False, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """The best ``cap`` results of a file; of a file that is not core, one; routes of a route query, ten."""
    w = Window.partitionBy("file_path").orderBy(F.desc("score"), "id")
    limit: Column = F.when(X.path_penalty(X.path_category(F.col("file_path"))) <= cfg.non_core, 1).otherwise(cap)
    if route_query:
        limit = F.when(F.col("node_type") == ROUTE, 10).otherwise(limit)
    most = 10 if route_query else max(cap, 1)
    # the constant bound lets Spark keep top rows of a group before the exchange
    return results.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).filter(F.col("_r") <= limit).drop("_r")


def workflow_rerank(results: DataFrame) -> DataFrame:
    cat = X.path_category(F.col("file_path"))
    up = F.when(F.col("node_type") == 7, 0.25).when(F.col("node_type") == 4, 0.15).when(F.col("node_type") == 2, 0.10).otherwise(0.0)
    down = F.when(cat.isin("test", "vendor", "migration"), 0.3).when(cat == "generated", 0.2).otherwise(0.0)
    return results.withColumn("score", F.col("score") + up - down)


def hybrid_search(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 10, embeddings: DataFrame | None = None, betweenness: DataFrame | None = None, active_ids: tuple[str, ...] = (), max_per_file: int | None = None, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """id, file_path, symbol_name, node_type, score and its parts, best first.

    ``nodes`` has the columns of ``schema.NODES``; ``embeddings`` (node_id,
    embedding) is searched with the hashed embedding of the query.
    """
    spark = nodes.sparkSession
    fields = {c: w for c, w in fts.NODE_WEIGHTS.items() if c in nodes.columns}
    shown = nodes.select("id", "file_path", "symbol_name", "node_type", *([] if "content_sum" not in nodes.columns else ["content_sum"]))
    schema = "id string, file_path string, symbol_name string, node_type tinyint, score double, ppr double, bm25 double, betweenness double, in_degree double, semantic double"
    if not query.strip():
        return spark.createDataFrame([], schema)
    n = max(limit * cfg.multiplier, cfg.candidate_minimum)
    cleaned = X.clean_query(query)
    kind = X.query_kind(query)
    lexical = fts.top(fts.bm25(nodes, "id", fields, X.query_terms(cleaned)), n).toPandas()
    semantic = vector.knn(embeddings, "node_id", "embedding", vector.embed(query).tolist(), n).toPandas() if embeddings is not None else lexical.iloc[:0]
    ids = list(dict.fromkeys([*lexical["id"], *semantic["id"]]))
    if not ids:
        return spark.createDataFrame([], schema)
    seeds = list(dict.fromkeys([*(lexical if len(lexical) else semantic)["id"][: cfg.seed_count], *active_ids]))

    cand = spark.createDataFrame([(i,) for i in ids], "id string")
    # all that is asked of the graph has a candidate or a seed at an end: those edges alone are made distinct, once
    asked = F.broadcast(spark.createDataFrame([(i,) for i in {*ids, *seeds}], "_end string"))
    touching = edges.join(asked, F.col("source_id") == F.col("_end"), "left_semi").unionByName(edges.join(asked, F.col("target_id") == F.col("_end"), "left_semi"))
    simple = cut(graph.pairs(touching, nodes))
    inner = graph.subgraph(simple, cand).toPandas()
    near = simple.filter(F.col("src").isin(seeds) | F.col("dst").isin(seeds)).select("src", "dst").join(F.broadcast(cand.select(F.col("id").alias("_c"))), (F.col("src") == F.col("_c")) | (F.col("dst") == F.col("_c")), "left_semi").toPandas() if not set(seeds) & set(ids) else inner
    around = {*near["src"], *near["dst"]}
    ppr = graph.ppr_kernel(list(inner["src"]), list(inner["dst"]), seeds, ids, around)

    def scores(pairs_: list[tuple[str, float]], name: str) -> DataFrame:
        return normalize_scores(spark.createDataFrame(pairs_, "id string, score double"), name)

    into = simple.join(F.broadcast(cand.select(F.col("id").alias("dst"))), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("double").alias("score"))
    parts = cand
    for df in (scores(list(ppr.items()), "ppr"), scores(list(zip(lexical["id"], lexical["score"].astype(float), strict=True)), "bm25"), normalize_scores(into, "in_degree"), scores(list(zip(semantic["id"], semantic["score"].astype(float), strict=True)), "semantic")):
        parts = parts.join(df, "id", "left")
    if betweenness is not None:
        parts = parts.join(betweenness.select("id", "betweenness"), "id", "left")
    else:
        parts = parts.withColumn("betweenness", F.lit(0.0))
    parts = parts.na.fill(0.0)
    raw = cfg.weight_ppr * F.col("ppr") + cfg.weight_bm25 * F.col("bm25") + cfg.weight_betweenness * F.col("betweenness") + cfg.weight_in_degree * F.col("in_degree") + cfg.weight_semantic * F.col("semantic")
    penalty = X.path_penalty(X.path_category(F.col("file_path")))
    columns = ["id", "file_path", "symbol_name", "node_type", "score", "ppr", "bm25", "betweenness", "in_degree", "semantic"]
    results = shown.join(F.broadcast(parts), "id").withColumn("score", raw * penalty * X.type_boost(kind, F.col("node_type"), cfg)).select(*columns)
    results = spark.createDataFrame(results.collect(), results.schema)  # a few hundred rows, used several times below
    results = results.unionByName(expand(results, shown, simple, cleaned, limit, betweenness, cfg).select(*columns))
    cap = max_per_file or cfg.max_per_file
    if kind == "workflow":
        results, cap = workflow_rerank(results), max(cap, 3)
    results = per_file_cap(results, cap, kind == "route", cfg)
    if kind == "route":
        results = inject_routes(results, nodes, edges, query, fields, cfg).select(*columns)
    return results.orderBy(F.desc("score"), "id").limit(limit)


def expand(results: DataFrame, nodes: DataFrame, simple: DataFrame, cleaned: str, limit: int, betweenness: DataFrame | None, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Neighbours of the best seeds that are no candidates yet, with their scores.

    A neighbour of one seed must hold a query term; its score is its betweenness
    share, or else a tenth of its best seed's.
    """
    seeds = results.orderBy(F.desc("score"), "id").limit(cfg.seed_count).select(F.col("id").alias("seed"), F.col("score").alias("seed_score"))
    both = simple.join(F.broadcast(seeds), F.col("src") == F.col("seed")).select("seed", "seed_score", F.col("dst").alias("id")).unionByName(
        simple.join(F.broadcast(seeds), F.col("dst") == F.col("seed")).select("seed", "seed_score", F.col("src").alias("id"))
    )
    new = both.join(F.broadcast(results.select("id")), "id", "left_anti").groupBy("id").agg(F.countDistinct("seed").alias("n_seeds"), F.max("seed_score").alias("best"))
    new = new.orderBy(F.desc("n_seeds"), "id").limit(cfg.max_neighbors)
    full = nodes.join(F.broadcast(new), "id")
    if betweenness is not None:
        full = full.join(betweenness.select("id", F.col("betweenness").alias("_b")), "id", "left").withColumn("betweenness", F.coalesce("_b", F.lit(0.0)))
    else:
        full = full.withColumn("betweenness", F.lit(0.0))
    hay = F.lower(F.concat_ws("\n", "symbol_name", "file_path", *(["content_sum"] if "content_sum" in nodes.columns else [])))
    terms = cleaned.lower().split()
    relevant = F.lit(not terms)
    for t in terms:
        relevant = relevant | F.contains(hay, F.lit(t))
    base = cfg.weight_betweenness * F.col("betweenness")
    score = F.when(base > 0, base).otherwise(F.greatest(F.lit(0.0), F.col("best")) * cfg.expansion_bonus) * X.path_penalty(X.path_category(F.col("file_path")))
    zero = {c: F.lit(0.0) for c in ("ppr", "bm25", "in_degree", "semantic")}
    kept = full.withColumn("score", score).withColumns(zero).filter(((F.col("n_seeds") >= 2) | relevant) & (F.col("score") > 0))
    return kept.orderBy(F.desc("n_seeds"), "id").limit(max(limit // cfg.added_divisor, 3))


def inject_routes(results: DataFrame, nodes: DataFrame, edges: DataFrame, query: str, fields: dict[str, float], cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Route nodes that the query's keywords find, and their handlers, at the top score."""
    words = X.route_keywords(query)
    terms = [(w.lower(), True) for w in words if len(w) > 1] or X.query_terms(X.clean_query(query))
    found = fts.bm25(nodes, "id", fields, terms).join(nodes.filter(F.col("node_type") == ROUTE).select("id"), "id", "left_semi")
    routes = fts.top(found, 50).select("id")
    handlers = edges.filter(F.col("edge_type") == HANDLES).join(F.broadcast(routes), F.col("source_id") == F.col("id")).select(F.col("target_id").alias("id"))
    extra = routes.unionByName(handlers).distinct().join(F.broadcast(results.select("id")), "id", "left_anti")
    reference = results.agg(F.coalesce(F.max("score"), F.lit(1.0)).alias("reference"))
    parts = {c: F.lit(0.0) for c in ("ppr", "bm25", "betweenness", "in_degree", "semantic")}
    new = nodes.join(F.broadcast(extra), "id").join(F.broadcast(reference)).withColumns(parts).withColumn("score", F.col("reference") * cfg.route_boost * 0.25)
    return results.unionByName(new.select(*results.columns))


def reason(ppr: Column, bm25: Column, betweenness: Column, in_degree: Column, semantic: Column) -> Column:
    """The two strongest signals above 0.01, named."""
    parts = [("graph relevance", ppr), ("text match", bm25), ("architectural importance", betweenness), ("popularity", in_degree), ("semantic similarity", semantic)]
    listed = F.array(*[F.struct((-c).alias("v"), F.lit(name).alias("name")) for name, c in parts])
    best = F.slice(F.array_sort(F.filter(listed, lambda x: x["v"] < -0.01)), 1, 2)
    return F.when(F.size(best) > 0, F.array_join(F.transform(best, lambda x: x["name"]), " and ")).otherwise("weak match")
