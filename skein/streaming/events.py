"""File events: action mapping, debouncing as a batch and as a stream, applying them.

Pending events of a path fold until ``gap`` passes without one.  Fold: a delete
replaces anything; anything replaces a pending event that is no create; a create
stays through later modifies.  So create + modify is create, create + delete is
delete, delete + create is create, delete + modify is modify.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPS = {"remove": "delete", "rename": "delete", "create": "create", "write": "modify"}


def action_of(op: Column) -> Column:
    """create, modify or delete; null for what is ignored."""
    out = F.lit(None).cast("string")
    for k, v in OPS.items():
        out = F.when(F.lower(op) == k, v).otherwise(out)
    return out


def fold(pending: str | None, incoming: str) -> str:
    return incoming if pending != "create" or incoming == "delete" else pending


def debounce(events: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """path, action, first_ts, last_ts, n of each debounced event of (path, action, ts); equal times go by action.

    Sessions are gaps and islands over one window sort.  Within a session the fold's
    result is known from its last event: a delete stays; after the last delete, the
    pending action is create if a create came since, else modify.
    """
    order = Window.partitionBy("path").orderBy("ts", "action")
    new = F.when(F.col("ts") <= F.lag("ts").over(order) + F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
    s = events.withColumn("session", F.sum(new).over(order)).withColumn("pos", F.row_number().over(order))
    per = s.groupBy("path", "session").agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("n"),
        F.max_by("action", "pos").alias("last"),
        F.max(F.when(F.col("action") == "delete", F.col("pos"))).alias("d"),
        F.max(F.when(F.col("action") == "create", F.col("pos"))).alias("c"),
    )
    action = F.when(F.col("last") == "delete", "delete").when(F.col("c") > F.coalesce("d", F.lit(0)), "create").otherwise("modify")
    return per.select("path", action.alias("action"), "first_ts", "last_ts", "n")


def debounce_stream(events: DataFrame, gap_ms: int = 500, watermark: str = "10 seconds") -> DataFrame:
    """The streaming twin: state of a path is its pending action and times; an event-time timer sends it.

    Later arrivals within the watermark are sorted in each batch before they fold.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        pending = state.get if state.exists else None
        if state.hasTimedOut:
            out.append((key[0], *pending))
            state.remove()
        else:
            got = pd.concat(list(batches)).sort_values(["ts", "action"])
            for ts, action in zip(got["ts"].astype("int64") // 1_000 if got["ts"].dtype == "datetime64[us]" else got["ts"].astype("datetime64[us]").astype("int64") // 1_000, got["action"], strict=True):
                if pending and ts > pending[2] + gap_ms:
                    out.append((key[0], *pending))
                    pending = None
                pending = (fold(pending[0], action), min(pending[1], ts), max(pending[2], ts), pending[3] + 1) if pending else (action, ts, ts, 1)
            state.update(pending)
            state.setTimeoutTimestamp(max(pending[2] + gap_ms, state.getCurrentWatermarkMs() + 1))
        rows = pd.DataFrame(out, columns=["path", "action", "first_ms", "last_ms", "n"])
        yield rows

    return (
        events.withWatermark("ts", watermark)
        .groupBy("path")
        .applyInPandasWithState(run, "path string, action string, first_ms long, last_ms long, n long", "action string, first_ms long, last_ms long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def apply_events(tables: dict[str, DataFrame], events: DataFrame, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> dict[str, DataFrame]:
    """nodes and edges after debounced events: the touched files' rows go, re-parsed ones come.

    Edges from other files into a rewritten file stay if their target still exists.
    ``parse`` gives (nodes, edges) of the created and modified paths.
    """
    from ..operators.store import resolve_targets

    touched = events.select(F.col("path").alias("file_path")).distinct()
    old = tables["nodes"].join(touched, "file_path", "left_semi").select(F.col("id").alias("_id"))
    new_nodes, new_edges = parse(events.filter("action <> 'delete'").select("path"))
    nodes = tables["nodes"].join(touched, "file_path", "left_anti").unionByName(new_nodes, allowMissingColumns=True)
    kept = tables["edges"].join(old, F.col("source_id") == F.col("_id"), "left_anti")
    incoming = kept.join(old, F.col("target_id") == F.col("_id"), "left_semi").join(new_nodes.select(F.col("id").alias("_n")), F.col("target_id") == F.col("_n"), "left_semi")
    others = kept.join(old, F.col("target_id") == F.col("_id"), "left_anti")
    resolved = resolve_targets(new_edges, nodes)
    edges = others.unionByName(incoming).unionByName(resolved, allowMissingColumns=True).dropDuplicates(["source_id", "target_id", "edge_type"])
    return {**tables, "nodes": nodes, "edges": edges}


def run_index_stream(stream: DataFrame, read_tables: Callable[[], dict[str, DataFrame]], write_tables: Callable[[dict[str, DataFrame]], None], parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str, refresh_scores: Callable[[], None] | None = None, refresh_after: int = 20):
    """Applies each micro-batch of debounced events; scores are refreshed once ``refresh_after`` changes have come.

    The last batch and the changes since the last refresh are a row beside the
    checkpoint, so a restart goes on counting and leaves out a batch that was applied.
    A batch cut short before that row is applied again, which replaces whole files
    and so changes nothing.
    """
    from ..operators import store

    spark = stream.sparkSession
    path = f"{checkpoint.rstrip('/')}-progress"

    def each(batch: DataFrame, batch_id: int) -> None:
        last, changes = store.read_table(spark, path).first() if store.table_versions(spark, path) else (-1, 0)
        if batch_id <= last:
            return
        batch = batch.persist()
        n = batch.count()
        if n:
            write_tables(apply_events(read_tables(), batch, parse))
            changes += n
            if refresh_scores and changes >= refresh_after:
                refresh_scores()
                changes = 0
        batch.unpersist()
        store.replace_table(spark.createDataFrame([(batch_id, changes)], "batch long, changes long").coalesce(1), path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").start()
