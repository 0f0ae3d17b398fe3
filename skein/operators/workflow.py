"""Workflow helpers: paths, coverage, phase groups, next steps, labels of blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import calls_helper, marked

STEP = "struct<tool:string,reason:string,args:map<string,string>>"

# Tools, their reasons and arguments as clients know them.
TRACE = ("trace_route", "Trace the strongest workflow entry point end to end")
CORE = ("read_symbol", "Inspect the core logic flow, helpers, and side effects in one view")
DISPATCH = ("read_symbol", "Confirm the async dispatch interface before following background work")
VERIFY = ("assemble_context", "Verify this workflow skeleton against concrete route, call, and data edges")
SURFACE = ("list_file_symbols", "Inspect the full state and data surface in this file")
RESOLVE = ("trace_route", "Resolve this entry point to its handler before trusting downstream workflow claims")
CONNECT = ("trace_call_path", "Check whether the core logic is disconnected from the best verified entry handler")
NEAREST = ("read_symbol", "Inspect the nearest verified core flow to confirm where this stateful symbol should be reached")
BOUNDARY = ("read_symbol", "Inspect this async boundary directly to confirm how work is dispatched")
FLOW_LABELS = {
    "validation": "Validate inputs",
    "db": "Persist data",
    "jobs": "Dispatch async work",
    "events": "Emit events",
    "notifications": "Send notifications",
    "integration": "Call external integration",
}
MENTIONS = {
    "validation": "validation",
    "db_write": "database writes",
    "job": "job dispatch",
    "event": "event emission",
    "notification": "notifications",
    "integration": "integration calls",
}
NO_MENTION = "Contains control flow and helper dispatch worth inspecting with a bounded or section read."


# ---- paths ------------------------------------------------------------------


def join_paths(prefix: Column, suffix: Column) -> Column:
    """Two id arrays in a row; a node that ends one and starts the other stands once. Null is empty."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(prefix, none), F.coalesce(suffix, none)
    meets = (F.size(a) > 0) & (F.size(b) > 0) & (F.element_at(F.concat(a, F.array(F.lit(""))), F.greatest(F.size(a), F.lit(1))) == F.get(b, F.lit(0)))
    return F.concat(a, F.when(F.coalesce(meets, F.lit(False)), F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0)))).otherwise(b))


def best_path(paths: DataFrame, keys: list[str], path_col: str = "path") -> DataFrame:
    """Of each key's non-empty paths the shortest, and of those the first by its ids joined with a bar."""
    p = F.col(path_col)
    return paths.filter(F.size(p) > 0).groupBy(*keys).agg(F.min_by(p, F.struct(F.size(p), F.array_join(p, "|"))).alias(path_col))


def path_names(paths: DataFrame, nodes: DataFrame, key: str, path_col: str = "path") -> DataFrame:
    """key, names: ids of a path replaced by their symbol's name, in order; an id that is no node stays."""
    each = paths.select(key, F.posexplode(path_col).alias("at", "id"))
    named = each.join(nodes.select("id", "symbol_name"), "id", "left").select(key, F.struct("at", F.coalesce("symbol_name", "id").alias("name")).alias("x"))
    return named.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("names"))


def direct_edges(asked: DataFrame, simple: DataFrame) -> DataFrame:
    """source_id, target_id of each distinct asked pair with ``direct``: whether the graph has that very edge.

    Both lists may repeat pairs; one exchange brings them together by source.
    """
    a = asked.select("source_id", "target_id", F.lit(True).alias("asked"), F.lit(False).alias("direct"))
    have = simple.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit(False).alias("asked"), F.lit(True).alias("direct"))
    met = a.unionByName(have).repartition("source_id").groupBy("source_id", "target_id").agg(F.max("asked").alias("asked"), F.max("direct").alias("direct"))
    return met.filter("asked").drop("asked")


# ---- candidates -------------------------------------------------------------


def graph_coverage(candidates: DataFrame, simple: DataFrame) -> DataFrame:
    """One row, ``coverage``: the share of candidates (id) with an edge; 0 without candidates."""
    ends = simple.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("has", F.lit(1.0))
    return candidates.select("id").join(ends, "id", "left").agg(F.coalesce(F.avg(F.coalesce("has", F.lit(0.0))), F.lit(0.0)).alias("coverage"))


def phase_groups(items: DataFrame) -> DataFrame:
    """phase, ids of items (id, rank, phase), in rank order."""
    return items.groupBy("phase").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))


#: Ids of one piece of a long list.
PIECE = 1000


def phase_digests(items: DataFrame) -> DataFrame:
    """phase, ids, n: MD5 of the comma-joined ids of ``phase_groups`` and their number, with no phase held in one row.

    Items are sorted by range; each range is joined to pieces, and one task a phase
    runs over its pieces in order, as the digest must.
    """
    ranged = items.select("phase", "rank", "id").repartitionByRange("phase", "rank", "id").sortWithinPartitions("phase", "rank", "id")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for phase, g in b.groupby("phase", sort=False, dropna=False):
                ids = g["id"].to_numpy()
                for k in range(0, len(ids), PIECE):
                    # as in a joined list, nulls are left out
                    there = [x for x in ids[k : k + PIECE] if x is not None]
                    out.append((phase, part, at, ",".join(there) if there else None, len(ids[k : k + PIECE])))
                    at += 1
            yield pd.DataFrame(out, columns=["phase", "part", "at", "text", "n"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phase, h, n, first = None, None, 0, True
        for b in batches:
            for p, text, k in zip(b["phase"], b["text"], b["n"], strict=True):
                if h is None or p != phase:
                    if h is not None:
                        yield pd.DataFrame({"phase": [phase], "ids": [h.hexdigest()], "n": [n]})
                    phase, h, n, first = p, hashlib.md5(usedforsecurity=False), 0, True
                n += k
                if text is not None:
                    h.update(text.encode() if first else b"," + text.encode())
                    first = False
        if h is not None:
            yield pd.DataFrame({"phase": [phase], "ids": [h.hexdigest()], "n": [n]})

    cut_up = ranged.mapInPandas(pieces, "phase string, part int, at long, text string, n long")
    return cut_up.repartition("phase").sortWithinPartitions("phase", "part", "at").mapInPandas(digest, "phase string, ids string, n long")


def named_ids(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, id of the distinct ids that are nodes, by name."""
    known = nodes.select("id", F.col("symbol_name").alias("name"))
    return ids.select("id").distinct().join(known, "id").select("name", "id").orderBy("name", "id")


def compact(results: DataFrame) -> DataFrame:
    """Results without the columns that explain them and propose what to do next."""
    return results.drop("reason", "why_now", "next_tool", "next_args")


def with_intents(results: DataFrame, intents: DataFrame) -> DataFrame:
    """Results (file_path) with ``why_now``, the intent of their file where there is one."""
    return results.join(intents.select("file_path", F.col("intent").alias("why_now")), "file_path", "left")


# ---- next steps -------------------------------------------------------------


def step(kind: tuple[str, str], **args: Column) -> Column:
    pairs = [x for k, v in args.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(F.lit(kind[0]).alias("tool"), F.lit(kind[1]).alias("reason"), F.create_map(*pairs).alias("args")).cast(STEP)


def step_key(x: Column) -> Column:
    """Tool and sorted arguments, by which steps are equal."""
    entries = F.array_sort(F.transform(F.map_entries(x["args"]), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.array_join(F.concat(F.array(x["tool"]), entries), "|")


def distinct_steps(steps: Column, cap: int) -> Column:
    """The first of equal steps, nulls out, ``cap`` at most."""
    there = F.filter(steps, lambda x: x.isNotNull())
    first = F.filter(there, lambda x, i: ~F.exists(F.slice(there, F.lit(1), i), lambda y: step_key(y) == step_key(x)))
    return F.slice(first, 1, cap)


def numbered(items: DataFrame, steps: Column, keys: list[str]) -> DataFrame:
    return items.select(*keys, F.posexplode(steps).alias("at", "s")).select(*keys, (F.col("at") + 1).alias("n"), "s.tool", "s.reason", "s.args")


def top(condition: Column) -> Column:
    """The item of least rank that fits; of equal ranks the first by id."""
    return F.min_by(F.when(condition, F.struct("id", "name", "file_path")), F.when(condition, F.struct("rank", "id", "file_path")))


def workflow_steps(items: DataFrame, keys: list[str] | None = None, cap: int = 4) -> DataFrame:
    """n, tool, reason, args: what to do next with items (id, name, file_path, phase, rank), by each key."""
    keys = keys or []
    phase = F.col("phase")
    route = F.col("name").rlike("^(?:GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD|ANY|ALL|MATCH|RESOURCE)\\s+/")
    one = items.groupBy(*keys).agg(
        top((phase == "Entry") & route).alias("entry"), top(phase == "Core").alias("core"), top(phase == "Async").alias("later"), top(phase == "State").alias("state"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"),
    )
    steps = F.array(
        F.when(F.col("entry").isNotNull(), step(TRACE, route=F.col("entry.name"))),
        F.when(F.col("core").isNotNull(), step(CORE, symbol_id=F.col("core.id"), mode=F.lit("flow_summary"))),
        F.when(F.col("later").isNotNull(), step(DISPATCH, symbol_id=F.col("later.id"), mode=F.lit("signature"))),
        F.when(F.size("ids") > 0, step(VERIFY, goal=F.lit("verify_workflow"), targets=F.array_join("ids", ","))),
        F.when(F.col("state").isNotNull(), step(SURFACE, file_path=F.col("state.file_path"))),
    )
    return numbered(one, distinct_steps(steps, cap), keys)


def verify_steps(items: DataFrame, keys: list[str] | None = None, cap: int = 3) -> DataFrame:
    """n, tool, reason, args for verified items (id, name, file_path, phase, status, confidence, rank), by each key.

    The best entry is the confirmed one of least rank; cores count as confirmed by their status.
    """
    keys = keys or []
    phase, status = F.col("phase"), F.col("status")
    one = items.groupBy(*keys).agg(
        top((phase == "Entry") & (status == "unresolved")).alias("open"), top((phase == "Entry") & (status == "confirmed")).alias("entry"),
        top((phase == "Core") & (status == "unreachable")).alias("cut_off"), top((phase == "Core") & (status == "confirmed")).alias("core"),
        top((phase == "State") & (status == "orphaned")).alias("orphan"), top((phase == "Async") & (status == "inferred") & (F.col("confidence") == 0.3)).alias("weak"),
    )
    steps = F.array(
        F.when(F.col("open").isNotNull(), step(RESOLVE, route=F.col("open.name"))),
        F.when(F.col("entry").isNotNull() & F.col("cut_off").isNotNull(), step(CONNECT, **{"from": F.col("entry.id"), "to": F.col("cut_off.id")})),
        F.when(F.col("core").isNotNull() & F.col("orphan").isNotNull(), step(NEAREST, symbol_id=F.col("core.id"), mode=F.lit("flow_summary"))),
        F.when(F.col("weak").isNotNull(), step(BOUNDARY, symbol_id=F.col("weak.id"), mode=F.lit("signature"))),
    )
    return numbered(one, distinct_steps(steps, cap), keys)


# ---- blocks of lines --------------------------------------------------------


def flow_label(hints: Column) -> Column:
    """What a block does, by the first of its hints."""
    first = F.get(hints, F.lit(0))
    known = reduce(lambda out, kv: F.when(first == kv[0], kv[1]).otherwise(out), FLOW_LABELS.items(), F.lit("Review control flow"))
    return F.when(F.coalesce(F.size(hints), F.lit(0)) <= 0, "Review logic block").otherwise(known)


def block_summary(block: Column) -> Column:
    """One sentence on what a block of lines mentions."""
    # no array functions: inside them lower case is made anew for each marker
    low = F.lower(block)
    told = [F.when(marked(low, k), F.lit(v)) for k, v in MENTIONS.items()]
    told.append(F.when(calls_helper(block), F.lit("helper calls")))
    said = F.concat(F.lit("Highlights "), F.concat_ws(", ", *told), F.lit("."))
    return F.replace(said, F.lit("Highlights ."), F.lit(NO_MENTION))
