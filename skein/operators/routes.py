"""Route operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import HANDLES, ROUTE
from . import graph


def parse(symbol: Column) -> Column:
    """struct(method, path) of ``GET /v1/x``."""
    return F.struct(F.split_part(symbol, F.lit(" "), F.lit(1)).alias("method"), F.regexp_replace(symbol, r"^\S+\s+", "").alias("path"))


def query_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.split(r"[\s/:\-_.]+", query.lower()) if len(t) >= 2))


def find(routes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, symbol_name) routes for a query: the best of each de-versioned path.

    2.0 where the name holds the whole query; 1 + 0.15 a matched token; half a point
    more where a version in the query is in the path.
    """
    tokens = query_tokens(query)
    name = F.lower("symbol_name")
    hits = sum((F.when(F.contains(name, F.lit(t)), 1).otherwise(0) for t in tokens), F.lit(0))
    score = F.greatest(F.when(F.contains(name, F.lit(query.lower())), 2.0).otherwise(0.0), F.when(hits > 0, 1 + 0.15 * hits).otherwise(0.0))
    versions = [t for t in tokens if re.fullmatch(r"v\d+", t)]
    for v in versions:
        score = score + F.when((score > 0) & F.contains(name, F.lit(f"/{v}/")), 0.5).otherwise(0.0)
    scored = routes.withColumn("score", score).filter("score > 0")
    group = F.concat_ws(" ", parse(F.col("symbol_name"))["method"], X.strip_version(parse(F.col("symbol_name"))["path"]))
    best = scored.withColumn("route_group", group).withColumn("_r", F.row_number().over(Window.partitionBy("route_group").orderBy(F.desc("score"), "symbol_name", "id"))).filter("_r = 1").drop("_r")
    return best.orderBy(F.desc("score"), "symbol_name", "id").limit(limit)


def handlers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, handler_id, handler: what handles each route; the named symbol where it is no node."""
    h = edges.filter(F.col("edge_type") == HANDLES)
    r = nodes.filter(F.col("node_type") == ROUTE).select("id").join(h, F.col("id") == F.col("source_id"))
    named = nodes.select(F.col("id").alias("handler_id"), F.col("symbol_name").alias("_name"))
    ref = F.col("target_symbol") if "target_symbol" in edges.columns else F.lit(None).cast("string")
    return r.select("id", F.col("target_id").alias("handler_id"), ref.alias("_ref")).join(named, "handler_id", "left").select("id", "handler_id", F.coalesce("_name", "_ref").alias("handler"))


def trace(nodes: DataFrame, edges: DataFrame, simple: DataFrame, route_id: str, depth: int = 2) -> DataFrame:
    """id, depth of what a route reaches through its handlers; handlers have depth 0."""
    h = [r["handler_id"] for r in handlers(nodes.filter(F.col("id").isin([route_id])).unionByName(nodes.filter("false")), edges).select("handler_id").collect()]
    start = simple.sparkSession.createDataFrame([(x, 0) for x in h], "id string, depth int")
    return start if not h else start.unionByName(graph.bfs(simple, h, min(depth, 4)))


def compare(simple: DataFrame, handlers_a: list[str], handlers_b: list[str], depth: int = 2) -> DataFrame:
    """id, where: downstream of both, only_a or only_b."""
    a = graph.bfs(simple, handlers_a, min(depth, 4)).select("id", F.lit(1).alias("a"))
    b = graph.bfs(simple, handlers_b, min(depth, 4)).select("id", F.lit(1).alias("b"))
    return a.join(b, "id", "full_outer").select("id", F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both").alias("where"))


RESOURCE = (("GET", "", "index"), ("GET", "/create", "create"), ("POST", "", "store"), ("GET", "/{id}", "show"), ("GET", "/{id}/edit", "edit"), ("PUT", "/{id}", "update"), ("DELETE", "/{id}", "destroy"))


def expand_resources(resources: DataFrame) -> DataFrame:
    """(path, controller, api_only) to method, path, handler: seven routes, five for apis."""
    all_ = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(p).alias("p"), F.lit(a).alias("a")) for m, p, a in RESOURCE])
    kept = F.filter(all_, lambda x: ~F.col("api_only") | ~x["a"].isin("create", "edit"))
    return resources.select("path", "controller", F.explode(kept).alias("x")).select(F.col("x.m").alias("method"), F.concat(X.normalize_path(F.col("path")), F.col("x.p")).alias("path"), F.concat_ws("@", "controller", "x.a").alias("handler"))
