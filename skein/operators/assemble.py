"""Budgeted context assembly and workflow analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..schema import HANDLES, ROUTE

ASYNC = "job queue event listener async worker dispatch cron".split()
PHASE_WEIGHTS = {"Entry": 2.0, "Core": 1.5, "State": 1.0, "Async": 1.0, "Other": 0.5}
CONFIDENCE = {"confirmed": 1.0, "inferred": 0.7, "unresolved": 0.3, "unreachable": 0.0, "orphaned": 0.0, "broken": 0.0}


def within_budget(items: DataFrame, budget: int = 4000, group_col: str | None = None, max_skips: int = 5) -> DataFrame:
    """(id, rank, tokens[, group]) that a greedy pass in rank order takes: id, rank, tokens, used.

    An item that does not fit is skipped and costs nothing; the pass stops after
    more than ``max_skips`` skips in a row.  The ranked list of a query is bounded by
    its limit, so its fold is one array.
    """
    budget = max(1, min(budget, 100_000))
    keys = [group_col] if group_col else []
    arr = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col("tokens").cast("long").alias("tokens")))).alias("xs"))
    taken = "array<struct<rank:int,id:string,tokens:bigint,used:bigint>>"
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("skips"), F.lit(False).alias("stop"), F.array().cast(taken).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        used = acc["used"] + x["tokens"]
        fits = ~acc["stop"] & (used <= budget)
        skips = F.when(fits, 0).otherwise(acc["skips"] + 1)
        one = F.array(F.struct(x["rank"].cast("int").alias("rank"), x["id"].cast("string").alias("id"), x["tokens"].alias("tokens"), used.alias("used")))
        return F.struct(F.when(fits, used).otherwise(acc["used"]).alias("used"), skips.alias("skips"), (acc["stop"] | (skips > max_skips)).alias("stop"), F.when(fits, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return arr.select(*keys, F.explode(F.aggregate("xs", zero, step)["out"]).alias("x")).select(*keys, "x.id", "x.rank", "x.tokens", "x.used")


def mode_content(mode: str, content: Column, signature: Column, summary: Column) -> Column:
    """The text of an item by mode: summary, signatures, snippets (50 lines), bundle or full."""
    if mode == "signatures":
        return signature
    if mode == "snippets":
        return F.array_join(F.slice(F.split(content, "\n"), 1, 50), "\n")
    if mode in ("bundle", "full"):
        return F.concat_ws("\n", summary, content) if mode == "bundle" else content
    return summary


def assemble(ranked: DataFrame, mode: str = "summary", budget: int = 4000) -> DataFrame:
    """(id, rank, content, signature, summary) cut to the budget: id, rank, text, tokens, used."""
    texts = ranked.select("id", "rank", mode_content(mode, F.col("content"), F.col("signature"), F.col("summary")).alias("text"))
    kept = within_budget(texts.select("id", "rank", estimate_tokens(F.col("text")).alias("tokens")), budget)
    return kept.join(texts.select(F.col("id").cast("string").alias("id"), "text"), "id")


def classify_phase(nodes: DataFrame, degrees: DataFrame, leaf_callees: DataFrame) -> DataFrame:
    """phase of each node: Entry, Async, Core, State or Other.

    Routes and callers-less nodes with callees are entries; names that speak of
    queues and events are async; nodes with both sides are core; leaves are state.
    """
    n = nodes.join(degrees, "id", "left").join(leaf_callees.select("id", "leaves"), "id", "left").na.fill(0, ["in_degree", "out_degree", "leaves"])
    words = F.split(F.lower(F.regexp_replace(F.concat_ws(" ", "symbol_name", "file_path"), r"([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    async_ = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ASYNC]))
    phase = (
        F.when(F.col("node_type") == ROUTE, "Entry")
        .when(async_, "Async")
        .when((F.col("in_degree") == 0) & (F.col("out_degree") > 0), "Entry")
        .when((F.col("in_degree") > 0) & (F.col("out_degree") > 0), F.when(F.col("leaves") == F.col("out_degree"), "State").otherwise("Core"))
        .when(F.col("in_degree") > 0, "State")
        .otherwise("Other")
    )
    return n.withColumn("phase", phase)


def confidence(status: Column) -> Column:
    out = F.lit(0.0)
    for k, v in CONFIDENCE.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def workflow_health(items: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """health, label of (phase, confidence): phase means weighted 2 / 1.5 / 1 / 1 / 0.5, within 0..1; healthy at 0.8, partial at 0.5."""
    weight = F.lit(PHASE_WEIGHTS["Other"])
    for k, v in PHASE_WEIGHTS.items():
        weight = F.when(F.col("phase") == k, v).otherwise(weight)
    per = items.groupBy(*group_cols, "phase").agg(F.avg("confidence").alias("c")).withColumn("w", weight)
    h = per.groupBy(*group_cols).agg((F.sum(F.col("w") * F.col("c")) / F.sum("w")).alias("health"))
    h = h.withColumn("health", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("health", F.lit(0.0)))))
    return h.withColumn("label", F.when(F.col("health") >= 0.8, "healthy").when(F.col("health") >= 0.5, "partial").otherwise("broken"))


def verify_routes(nodes: DataFrame, edges: DataFrame, simple: DataFrame) -> DataFrame:
    """id, phase, status, confidence of route nodes: confirmed with a handler that exists and calls on, inferred without calls, unresolved without an edge, broken where the handler is no node."""
    routes = nodes.filter(F.col("node_type") == ROUTE).select("id")
    handles = edges.filter(F.col("edge_type") == HANDLES).select(F.col("source_id").alias("id"), F.col("target_id").alias("handler"))
    r = routes.join(handles, "id", "left").join(nodes.select(F.col("id").alias("handler"), F.lit(1).alias("exists")), "handler", "left")
    calls = simple.select(F.col("src").alias("handler")).distinct().withColumn("calls", F.lit(1))
    r = r.join(calls, "handler", "left")
    status = F.when(F.col("handler").isNull(), "unresolved").when(F.col("exists").isNull(), "broken").when(F.col("calls").isNull(), "inferred").otherwise("confirmed")
    best = r.withColumn("status", status).withColumn("c", confidence(F.col("status"))).groupBy("id").agg(F.max_by("status", "c").alias("status"), F.max("c").alias("confidence"))
    return best.withColumn("phase", F.lit("Entry"))


def verify_items(items: DataFrame, simple: DataFrame, entries: DataFrame, depth: int = 4) -> DataFrame:
    """Items (id, phase) with status: reached from an entry confirmed, next to another item inferred, else orphaned."""
    from .graph import cut

    reached = entries.select("id", F.lit(0).alias("d"))
    frontier = reached
    for d in range(1, depth + 1):
        new = simple.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(reached, "id", "left_anti")
        frontier = cut(new.select("id", F.lit(d).alias("d")))
        reached = reached.unionByName(frontier)
    ids = items.select("id").distinct()
    near = simple.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    touched = near.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("near", F.lit(1))
    out = items.join(reached.select("id", F.lit(1).alias("hit")), "id", "left").join(touched, "id", "left")
    out = out.withColumn("status", F.when(F.col("hit").isNotNull(), "confirmed").when(F.col("near").isNotNull(), "inferred").otherwise("orphaned"))
    return out.withColumn("confidence", confidence(F.col("status"))).drop("hit", "near")


def risk_flags(items: DataFrame, cap: int = 5) -> DataFrame:
    """id, severity, flag of troubled items, worst first, at most ``cap``."""
    severity = F.when(F.col("status") == "broken", 0).when(F.col("status").isin("unreachable", "orphaned"), 1).when(F.col("status") == "unresolved", 2)
    return items.withColumn("severity", severity).filter("severity IS NOT NULL").select("id", "severity", F.concat_ws(": ", "phase", "status").alias("flag")).orderBy("severity", "id").limit(cap)


def critical_path(items: DataFrame, cap: int = 6) -> DataFrame:
    """Up to ``cap`` confirmed or inferred items, in phase order, best confidence first."""
    order = F.when(F.col("phase") == "Entry", 0).when(F.col("phase") == "Core", 1).when(F.col("phase") == "State", 2).when(F.col("phase") == "Async", 3).otherwise(4)
    return items.filter(F.col("status").isin("confirmed", "inferred")).withColumn("at", order).orderBy("at", F.desc("confidence"), "id").limit(cap)


def narrative(query: str, path: list[str], counts: dict[str, int], flags: list[str], label: str) -> str:
    told = f"The workflow behind '{query}' is {label}."
    if path:
        told += " It runs through " + " -> ".join(path) + "."
    if counts:
        told += " Phases: " + ", ".join(f"{n} {k.lower()}" for k, n in sorted(counts.items())) + "."
    return told + (" Risks: " + "; ".join(flags) + "." if flags else " No risks were found.")
