"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a word target; its rows get one expected number of copies,
target / source size.  The fractional parts are rounded so that the words taken
keep their sum: two units move word mass between each other, in a random
direction that keeps both expectations, until the copy number of one is whole.
Units are folded in blocks, the one open unit of each block goes up a
reduction tree, and the last one of a source is rounded to the nearest.  Units
of 1 / HEAVY of a source's words or more go first, HEAVY of a source at most, and
the light ones' expectations make up what rounding the last heavy one missed.  So
a source misses its target by half of one light row, if its light rows hold enough
words.

Rows that are equal in what is kept of them are one group: of its n rows, the whole
part of n times the fraction gets one copy more outright, and what is left of it is
one unit of a single row's size.  So repeated rows, and rows without an id, are
rounded row by row like all others.

Defined results: null texts have size 0; rows of size 0 take 0 words; null
sources are one source, last in order; of equal rows, copies differ by one at most;
extra columns are ignored; an empty table gives an empty table.  All randomness is
a hash of the seed and the rows, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import count_words, let, text_of
from .scratch import Scratch

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BLOCK = 256
#: A unit of 1 / HEAVY of its source's words, or more, is rounded before the others.
HEAVY = 64
#: Source tables up to so many rows are broadcast; larger ones are joined by sort-merge, which adaptive execution splits.
BROADCAST_ROWS = 100_000
#: Rows made at once from one group of equal rows.
CHUNK = 4096


def row_key(*cols: Column) -> Column:
    """One digest of the columns, nulls told from all values."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in cols]))


def source_ranks(per: DataFrame, scratch: Scratch) -> DataFrame:
    """``per`` with ``rank``, 0-based by source's code points, null last.

    Runs of sources are cut by range and ranked alone; the driver sees one count a run.
    """
    n = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = per.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("run", F.spark_partition_id())
    runs = scratch.write(runs)
    sizes = sorted((r["run"], r["n"]) for r in runs.groupBy("run").agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for run, size in sizes:
        offsets.append((run, before))
        before += size
    start = per.sparkSession.createDataFrame(offsets, "_run int, start long")
    order = Window.partitionBy("run").orderBy(F.col("source").asc_nulls_last())
    ranked = runs.withColumn("at", F.row_number().over(order)).join(F.broadcast(start), F.col("run") == F.col("_run"))
    return ranked.withColumn("rank", F.col("start") + F.col("at") - 1).drop("run", "_run", "start", "at")


def source_targets(groups: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target, rate, n_units of a table of groups (source, size, n).

    Targets are min(max_copies * size, level * weight) where the one level makes
    them add up to all words.  It is found as the contract words it: share, cap what
    is above, reshare the rest, until none is above; each round is one sum over the
    sources, and its capped set only grows.
    """
    per = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_units"))
    per = source_ranks(per, scratch)
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights)).cast("int"))
    per = scratch.write(per.withColumn("weight", w).withColumn("cap", F.lit(float(max_copies)) * F.col("source_size")))
    level, capped = 0.0, -1
    while True:
        # shares above the cap by rounding alone do not count
        above = F.col("cap") < F.lit(level) * F.col("weight") * (1 - 1e-12)
        row = per.agg(
            F.coalesce(F.sum(F.col("source_size").cast("double")), F.lit(0.0)).alias("all"),
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)).alias("cap"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("free"),
            F.count(F.when(above, 1)).alias("n"),
        ).first()
        if row["n"] == capped or row["free"] == 0:
            break
        level, capped = (row["all"] - row["cap"]) / row["free"], row["n"]
    per = per.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_copies)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return per.select("source", "source_size", "target", rate.alias("rate"), "n_units")


def with_source(rows: DataFrame, per_source: DataFrame, n_sources: int) -> DataFrame:
    """Join by source, nulls equal; a small table is broadcast, a larger one sorted and merged."""
    small = per_source.withColumnRenamed("source", "_s")
    small = F.broadcast(small) if n_sources <= BROADCAST_ROWS else small.hint("merge")
    return rows.join(small, rows["source"].eqNullSafe(F.col("_s")), "left").drop("_s")


def repeat(df: DataFrame, n: Column) -> DataFrame:
    """Each row ``n`` times with ``_i`` from 0, ``CHUNK`` at once, so that no row holds its own count as an array."""
    chunks = df.withColumn("_n", n.cast("long")).filter("_n > 0").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))))
    last = F.least(F.col("_n"), (F.col("_c") + 1) * CHUNK) - 1
    return chunks.withColumn("_i", F.explode(F.sequence(F.col("_c") * CHUNK, last))).drop("_n", "_c")


def uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def fold_block(xs: Column, seed: int) -> Column:
    """Pivotal rounding of an array of (h, key, s, p): struct(c: open element, out: decided ones)."""
    decided = "array<struct<key:string,up:int>>"

    def settle(x: Column, up: int) -> Column:
        return F.struct(x["key"].alias("key"), F.lit(up).alias("up"))

    def moved(x: Column, p: Column) -> Column:
        return F.struct(x["h"].alias("h"), x["key"].alias("key"), x["s"].alias("s"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        def pair(m: Column) -> Column:
            a, b = m["a"], m["b"]
            a_up, b_down = (1 - a["p"]) * a["s"], b["p"] * b["s"]
            a_down, b_up = a["p"] * a["s"], (1 - b["p"]) * b["s"]
            d1, d2 = F.least(a_up, b_down), F.least(a_down, b_up)
            first = uniform(F.lit(seed), a["h"], b["h"]) * (d1 + d2) < d2
            first = first | ((d1 + d2) == 0)

            def both(open_: Column, one: Column) -> Column:
                return F.struct(open_.alias("c"), F.concat(m["out"], F.array(one)).alias("out"))

            return (
                F.when(first & (a_up <= b_down), both(moved(b, b["p"] - d1 / b["s"]), settle(a, 1)))
                .when(first, both(moved(a, a["p"] + d1 / a["s"]), settle(b, 0)))
                .when(a_down <= b_up, both(moved(b, b["p"] + d2 / b["s"]), settle(a, 0)))
                .otherwise(both(moved(a, a["p"] - d2 / a["s"]), settle(b, 1)))
            )

        return let(F.struct(acc["c"].alias("a"), x.alias("b"), acc["out"].alias("out")), pair)

    # the first element opens the block; the rest meet it one by one
    start = F.struct(moved(F.get(xs, F.lit(0)), F.get(xs, F.lit(0))["p"]).alias("c"), F.array().cast(decided).alias("out"))
    return F.aggregate(F.slice(xs, F.lit(2), F.size(xs)), start, step)


def decide(groups: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 7) -> DataFrame:
    """``groups`` (key, source, size, n; a written table) with source_size, target, copies and ``up``, the rows of each that get one copy more."""
    per = scratch.write(source_targets(groups, scratch, weights, max_copies))
    n_sources, most = per.agg(F.count("*"), F.coalesce(F.max("n_units"), F.lit(0))).first()
    base = F.floor("rate")
    extra = F.when(F.col("size") > 0, F.col("n") * (F.col("rate") - base)).otherwise(0.0)
    rated = with_source(groups, per, n_sources).withColumn("copies", F.when(F.col("size") > 0, base).otherwise(0).cast("long")).withColumn("whole", F.least("n", F.floor(extra)))
    rated = rated.withColumn("p", F.greatest(F.lit(0.0), extra - F.col("whole")))
    open_ = scratch.write(
        rated.filter("p > 0").select("source", F.xxhash64(F.lit(seed), "key").alias("h"), "key", F.col("size").cast("double").alias("s"), "p", (F.col("size") * HEAVY >= F.col("source_size")).alias("heavy"))
    )
    elements = F.struct("h", "key", "s", "p")
    # the heavy ones first, HEAVY of a source at most; what rounding their last one misses, the light ones make up
    heavy = scratch.write(open_.filter("heavy").groupBy("source").agg(F.sort_array(F.collect_list(elements)).alias("xs")).select("source", fold_block(F.col("xs"), seed).alias("r")))
    nearest = F.when(F.col("r.c.p") >= 0.5, 1).otherwise(0)
    decided = heavy.select(F.explode(F.concat("r.out", F.array(F.struct(F.col("r.c.key"), nearest.alias("up"))))).alias("d")).select("d.*")
    missed = heavy.select(F.col("source").alias("_m"), ((F.col("r.c.p") - nearest) * F.col("r.c.s")).alias("missed"))
    light = open_.filter("NOT heavy").groupBy("source").agg(F.sum("s").alias("mass"), F.count("*").alias("n_units"))
    shift = light.join(missed, light["source"].eqNullSafe(F.col("_m")), "left").select("source", "n_units", (F.coalesce("missed", F.lit(0.0)) / F.col("mass")).alias("shift"))
    shift = scratch.write(shift)
    open_ = with_source(open_.filter("NOT heavy"), shift, n_sources).withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") + F.col("shift")))).select("source", "n_units", "h", "key", "s", "p")
    width = 1
    while True:
        width *= BLOCK
        # at each level a source's open elements are dealt to so many blocks that about BLOCK meet
        n_blocks = F.ceil(F.col("n_units") / F.lit(float(width)))
        blocks = (
            open_.withColumn("block", F.pmod(F.xxhash64(F.lit(width), "h"), n_blocks))
            .groupBy("source", "n_units", "block")
            .agg(F.sort_array(F.collect_list(elements)).alias("xs"))
            .select("source", "n_units", fold_block(F.col("xs"), seed).alias("r"))
        )
        folded = scratch.write(blocks)
        decided = decided.unionByName(folded.select(F.explode("r.out").alias("d")).select("d.*"))
        open_ = folded.select("source", "n_units", "r.c.*")
        if width >= most:
            break
    last = open_.select("key", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("up"))
    decided = decided.unionByName(last).select(F.col("key").alias("_k"), F.col("up").cast("long").alias("one"))
    joined = rated.join(decided, F.col("key") == F.col("_k"), "left").withColumn("up", F.col("whole") + F.coalesce("one", F.lit(0)))
    return joined.select(*groups.columns, "source_size", "target", "copies", "up")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(text_of(text_col)).alias("size"))
    groups = scratch.write(sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")).withColumn("key", row_key(F.col("source"), F.col("doc_id"), F.col("size"))))
    rows = repeat(decide(groups, scratch, **how), F.col("n"))
    copies = F.col("copies") + (F.col("_i") < F.col("up")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def draw(docs: DataFrame, text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; ``docs`` is read twice, so it should be a stored table."""
    scratch = Scratch(docs.sparkSession, "mixing")
    keyed = docs.select(*[F.col(c) for c in docs.columns], row_key(*[F.col(c) for c in docs.columns]).alias("_key"))
    sizes = keyed.select(F.col("_key").alias("key"), F.col(source_col).cast("string").alias("source"), count_words(text_of(text_col)).alias("size"))
    groups = scratch.write(sizes.groupBy("key", "source", "size").agg(F.count("*").alias("n")))
    total = (F.col("n") * F.col("copies") + F.col("up")).alias("_total")
    taken = scratch.write(decide(groups, scratch, **how).select(F.col("key").alias("_k"), "n", total).filter("_total > 0"))
    once = keyed.join(taken.filter("n = 1").select("_k", "_total"), F.col("_key") == F.col("_k"))
    # equal rows are alike in all columns: one of them stands for the group
    again = keyed.join(taken.filter("n > 1").select("_k", "_total"), F.col("_key") == F.col("_k")).dropDuplicates(["_k"])
    rows = repeat(once.unionByName(again), F.col("_total"))
    return rows.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
