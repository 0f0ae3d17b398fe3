"""Snapshots, deltas, change ranking and file intents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_low_signal, truncate_bytes
from . import graph


def snapshot(nodes: DataFrame, contents: DataFrame, max_bytes: int = 5_000_000) -> DataFrame:
    """id, file_path, symbol_name, hash: SHA-256 of each node's bytes; '' without them or beyond the size cap.

    ``contents`` is (file_path, content binary); offsets count bytes.
    """
    part = F.substring(F.col("content"), F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int"))
    ok = F.col("content").isNotNull() & (F.octet_length("content") <= max_bytes) & (F.col("end_byte") > F.col("start_byte")) & (F.col("end_byte") <= F.octet_length("content"))
    return nodes.join(contents, "file_path", "left").select("id", "file_path", "symbol_name", F.when(ok, F.sha2(part, 256)).otherwise("").alias("hash"))


def write_checkpoint(snap: DataFrame, root: str, name: str, keep: int = 10) -> None:
    """A named snapshot under ``root``; beyond ``keep`` the oldest go."""
    spark = snap.sparkSession
    snap.write.mode("overwrite").parquet(f"{root}/name={name}")
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(fs.listStatus(folder), key=lambda s: s.getModificationTime())
    for s in found[: max(0, len(found) - keep)]:
        fs.delete(s.getPath(), True)


def delta(old: DataFrame, new: DataFrame, limit: int | None = None, prefix: str = "") -> DataFrame:
    """change, id, file_path, symbol_name: added, modified and deleted nodes between two snapshots.

    One full outer join on the id; a node without an old hash is not modified.
    """
    o = old.select("id", F.col("file_path").alias("of"), F.col("symbol_name").alias("os"), F.col("hash").alias("oh"))
    n = new.select("id", F.col("file_path").alias("nf"), F.col("symbol_name").alias("ns"), F.col("hash").alias("nh"))
    change = F.when(F.col("oh").isNull(), "added").when(F.col("nh").isNull(), "deleted").when((F.col("oh") != "") & (F.col("oh") != F.col("nh")), "modified")
    out = o.join(n, "id", "full_outer").select(change.alias("change"), "id", F.coalesce("nf", "of").alias("file_path"), F.coalesce("ns", "os").alias("symbol_name")).filter("change IS NOT NULL")
    if prefix:
        out = out.filter(F.col("file_path").startswith(prefix))
    if limit is not None:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy("change").orderBy("file_path", "id"))).filter(F.col("_r") <= limit).drop("_r")
    return out


def rank_changes(changed: DataFrame, simple: DataFrame, betweenness: DataFrame, depth: int = 3) -> DataFrame:
    """changed (id, change) with dependents and score, best first.

    0.5 betweenness + 0.3 dependents / most + 0.2 severity; over 100 candidates
    0.8 betweenness + 0.2 severity, and dependents are not walked.  Dependents count
    nodes that reach the change within ``depth`` hops, itself not among them.
    ``simple`` may repeat edges.
    """
    severity = F.when(F.col("change") == "deleted", 1.0).when(F.col("change") == "added", 0.7).otherwise(0.5)
    base = changed.join(betweenness.select("id", "betweenness"), "id", "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0))).withColumn("severity", severity)
    if changed.limit(101).count() > 100:
        return base.withColumn("dependents", F.lit(0).cast("long")).withColumn("score", 0.8 * F.col("betweenness") + 0.2 * F.col("severity"))
    # at most 100 roots: each node has two masks of those that it reaches, 50 to a mask
    roots = [r["id"] for r in changed.select("id").distinct().collect()]
    kind = f"id {changed.schema['id'].dataType.simpleString()}"
    start = changed.sparkSession.createDataFrame([(r, 1 << j if j < 50 else 0, 1 << j - 50 if j >= 50 else 0) for j, r in enumerate(roots)], f"{kind}, m0 long, m1 long")
    masks = [F.bit_or("m0").alias("m0"), F.bit_or("m1").alias("m1")]
    known, frontier, n, levels = start, start, len(roots), []
    for _ in range(depth):
        x = frontier.withColumnRenamed("id", "dst")
        step = simple.join(F.broadcast(x) if n <= graph.FRONTIER else x, "dst").groupBy(F.col("src").alias("id")).agg(*masks)
        old = known.groupBy("id").agg(F.bit_or("m0").alias("k0"), F.bit_or("m1").alias("k1"))
        new = [F.col(f"m{i}").bitwiseAND(F.bitwise_not(F.coalesce(f"k{i}", F.lit(0).cast("long")))).alias(f"m{i}") for i in (0, 1)]
        frontier = graph.cut(step.join(old, "id", "left").select("id", *new).filter("m0 <> 0 OR m1 <> 0"))
        n = frontier.count()
        if not n:
            break
        levels.append(frontier)
        known = known.unionByName(frontier)
    held = [F.sum(F.shiftright(F.col(f"m{j // 50}"), j % 50).bitwiseAND(1)) for j in range(len(roots))]
    counts = reduce(DataFrame.unionByName, levels).agg(*held).first() if levels else [None] * len(roots)
    n = changed.sparkSession.createDataFrame([(r, c or 0) for r, c in zip(roots, counts, strict=True)], f"{kind}, dependents long")
    scored = graph.with_maximum(base.join(n, "id", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)).cast("long")), top="dependents")
    share = F.when(F.col("top") > 0, F.col("dependents") / F.col("top")).otherwise(0.0)
    return scored.withColumn("score", 0.5 * F.col("betweenness") + 0.3 * share + 0.2 * F.col("severity")).drop("top")


def latest_per_file(history: DataFrame, cap: int = 20) -> DataFrame:
    """The newest ``cap`` changes of each file; a constant bound, so tasks keep only those before the exchange."""
    w = Window.partitionBy("file_path").orderBy(F.desc("commit_time"), "commit_hash")
    return history.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).withColumnRenamed("_r", "rank")


def file_intents(history: DataFrame, cap: int = 20, lines: int = 10, max_bytes: int = 1500) -> DataFrame:
    """file_path, intent, n_commits, last_commit of each file with a telling change.

    Of the newest ``cap`` changes, subjects that say nothing or repeat go; ``lines``
    of the rest are listed and the others counted.
    """
    newest = latest_per_file(history, cap)
    kind = F.col("change_type") if "change_type" in history.columns else F.lit("modified")
    entry = F.struct("rank", F.lower(F.trim("subject")).alias("low"), "subject", kind.alias("kind"), F.date_format("commit_time", "yyyy-MM-dd").alias("day"), "commit_hash")
    telling = newest.filter(F.col("subject").isNotNull() & ~is_low_signal(F.col("subject")))
    per = telling.groupBy("file_path").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    per = per.withColumn("c", F.filter("c", lambda x, i: ~F.exists(F.slice("c", F.lit(1), i), lambda y: y["low"] == x["low"])))
    n = F.size("c")
    head = F.concat(F.lit("File: "), F.col("file_path"), F.lit("\nRecent changes ("), n.cast("string"), F.lit(" commits):\n"))
    body = F.array_join(F.transform(F.slice("c", 1, lines), lambda x: F.concat(F.lit("- ["), x["kind"], F.lit("] "), x["subject"], F.lit(" ("), x["day"], F.lit(")\n"))), "")
    more = F.when(n > lines, F.concat(F.lit("... and "), (n - lines).cast("string"), F.lit(" more commits\n"))).otherwise("")
    per = per.withColumn("intent", F.concat(head, body, more))
    return per.select("file_path", truncate_bytes(F.col("intent"), max_bytes).alias("intent"), n.cast("long").alias("n_commits"), F.get("c", F.lit(0))["commit_hash"].alias("last_commit"))


def recent_commits_text(commits: DataFrame, count: int) -> DataFrame:
    """One row, ``text``: the newest commits, a line each; commits is (commit_hash, is_merge, subject, author_name, author_time)."""
    top = commits.orderBy(F.desc("author_time"), "commit_hash").limit(count)
    line = F.concat(F.lit("- "), F.left("commit_hash", F.lit(8)), F.lit(" "), F.when(F.col("is_merge"), "[merge] ").otherwise(""), F.col("subject"), F.lit(" ("), F.col("author_name"), F.lit(", "), F.date_format("author_time", "yyyy-MM-dd"), F.lit(")\n"))
    rows = top.select(F.struct((-F.unix_micros(F.col("author_time").cast("timestamp"))).alias("t"), "commit_hash", line.alias("line")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("r"))
    text = F.concat(F.lit("Recent commits ("), F.size("r").cast("string"), F.lit("):\n"), F.array_join(F.transform("r", lambda x: x["line"]), ""))
    return rows.select(F.when(F.size("r") == 0, "No commits found.").otherwise(text).alias("text"))


def latest_commit(commits: DataFrame) -> DataFrame:
    """The hash of the newest commit by author time; one row, or none."""
    return commits.orderBy(F.desc("author_time"), "commit_hash").select("commit_hash").limit(1)


def diff_trees(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change of two (path, hash) trees: added, deleted, modified; a deleted and an added path with one hash are renamed."""
    both = old.select("path", F.col("hash").alias("oh")).join(new.select("path", F.col("hash").alias("nh")), "path", "full_outer")
    change = F.when(F.col("oh").isNull(), "added").when(F.col("nh").isNull(), "deleted").when(F.col("oh") != F.col("nh"), "modified")
    d = both.withColumn("change", change).filter("change IS NOT NULL")
    gone = d.filter("change = 'deleted'").groupBy(F.col("oh").alias("nh")).agg(F.min("path").alias("old_path"))
    moved = d.filter("change = 'added'").join(gone, "nh").select("path", "old_path")
    added = d.filter("change <> 'deleted'").join(moved, "path", "left").select("path", F.when(F.col("old_path").isNotNull(), "renamed").otherwise(F.col("change")).alias("change"))
    deleted = d.filter("change = 'deleted'").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti").select("path", "change")
    return added.unionByName(deleted)
