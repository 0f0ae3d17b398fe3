"""A stored full-text index: postings by term bucket, with all that BM25 needs in each row.

``open_index`` builds it once for a state of its source and finds it again
afterwards; a query reads the buckets of its terms alone, and in them the row groups
that can hold the terms.  A build costs several scans of the texts, so a query of few
terms asks ``find_index`` and scans where there is none.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .fts import K1, B, tokens
from .lineage import shared_folder

BUCKETS = 64
#: A term's bucket is that of its first characters, so a prefix this long or longer has one bucket.
HEAD = 2
#: Terms of a batch, each counted in each of its queries, up to so many are broadcast.
BROADCAST_TERMS = 100_000
#: Pairs of a query and a row that one task of a batch sums, at most, if each query meets each row.
PAIRS = 2_000_000


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(term, F.lit(HEAD))), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    """(bucket, term, id, tf, dl), one row for each field that holds the term, and the one row (n_rows, avgdl) of the corpus."""

    postings: DataFrame
    stats: DataFrame


def _heads(ts: Column) -> Column:
    """Where runs of equal elements start in a sorted array."""
    at = F.when(F.size(ts) > 0, F.sequence(F.lit(0), F.size(ts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda j: (j == 0) | (F.get(ts, j) != F.get(ts, j - 1)))


def _counts(ts: Column, heads: Column, weight: float) -> Column:
    """(term, tf) of each run."""
    return F.transform(heads, lambda j, k: F.struct(F.get(ts, j).alias("term"), ((F.coalesce(F.get(heads, k + 1), F.size(ts)) - j) * F.lit(float(weight))).alias("tf")))


def postings(rows: DataFrame, id_col: str, fields: dict[str, float]) -> DataFrame:
    """id, dl, term, tf, bucket: terms counted inside each row, weighted by field; dl is in tokens of all fields."""
    n = range(len(fields))
    ts = rows.select(F.col(id_col).alias("id"), *[F.sort_array(tokens(F.col(c))).alias(f"t_{i}") for i, c in enumerate(fields)])
    # arrays are columns of their own, so that none is made again for each of its elements
    runs = ts.select("*", sum((F.size(f"t_{i}") for i in n), F.lit(0)).alias("dl"), *[_heads(F.col(f"t_{i}")).alias(f"h_{i}") for i in n])
    each = F.concat(*[_counts(F.col(f"t_{i}"), F.col(f"h_{i}"), w) for i, w in enumerate(fields.values())])
    return runs.select("id", "dl", F.inline(each)).withColumn("bucket", bucket(F.col("term")))


def build(rows: DataFrame, id_col: str, fields: dict[str, float], path: str) -> None:
    """Writes the index of ``rows``.

    A posting moves once, to its bucket; a bucket has as many tasks and files as its
    size asks for, so that a very frequent term is no single task's.
    """
    post = postings(rows, id_col, fields).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
    post.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    dl = sum((F.size(tokens(F.col(c))) for c in fields), F.lit(0))
    stats = rows.select(dl.alias("dl")).agg(F.count("*").alias("n_rows"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    store.replace_table(stats.coalesce(1), f"{path}/stats")


def source_state(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files at ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(p, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode(), usedforsecurity=False).hexdigest()


def _place(spark: SparkSession, source: str, id_col: str, fields: dict[str, float]) -> str:
    """Where the index of the present state of ``source`` lies or will lie."""
    if not (root := spark.conf.get("skein.index.dir", None)):
        root = shared_folder(spark)
        spark.conf.set("skein.index.dir", root)
    about = f"{source_state(spark, source)}|{id_col}|{sorted(fields.items())}"
    return f"{root.rstrip('/')}/skein-index-{hashlib.md5(about.encode(), usedforsecurity=False).hexdigest()}"


def find_index(spark: SparkSession, source: str, id_col: str, fields: dict[str, float]) -> Index | None:
    """The index of the Parquet table at ``source``, if one of its present state was built.

    ``stats`` is written last, so an index that a crash has left half done is none.
    """
    path = _place(spark, source, id_col, fields)
    if not store.table_versions(spark, f"{path}/stats"):
        return None
    id_type = spark.read.parquet(source).schema[id_col].dataType.simpleString()
    postings = spark.read.schema(f"term string, id {id_type}, dl int, tf double, bucket int").parquet(f"{path}/postings")
    return Index(postings, store.read_table(spark, f"{path}/stats"))


def open_index(spark: SparkSession, source: str, id_col: str, fields: dict[str, float]) -> Index:
    """The index of the Parquet table at ``source``, built if its present state has none."""
    if index := find_index(spark, source, id_col, fields):
        return index
    build(spark.read.parquet(source), id_col, fields, _place(spark, source, id_col, fields))
    return find_index(spark, source, id_col, fields)


def idf(n_rows: Column, n: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.log((n_rows - n + 0.5) / (n + 0.5)))


def part(idf: Column, avgdl: Column, tf: Column, dl: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avgdl))


def search(index: Index, terms: list[tuple[str, bool]]) -> DataFrame:
    """id, score of the rows that hold any of (term, is prefix); a prefix counts as one phrase."""
    p = index.postings
    heads = sorted({t[:HEAD] for t, _ in terms if len(t) >= HEAD})
    if heads and all(len(t) >= HEAD or not prefix for t, prefix in terms):
        asked = [F.lit(h) for h in {*heads, *(t for t, prefix in terms if len(t) < HEAD)}]
        # constants fold, so the reader lists the buckets of the terms alone
        p = p.filter(F.col("bucket").isin(*[bucket(a) for a in asked]))
    which = F.array_compact(F.array(*[F.when(F.col("term").startswith(t) if prefix else F.col("term") == t, F.lit(j)) for j, (t, prefix) in enumerate(terms)]))
    hit = F.lit(False)
    for t, prefix in terms:
        hit = hit | (F.col("term").startswith(t) if prefix else F.col("term") == t)
    tf = p.filter(hit).select("id", "dl", "tf", F.explode(which).alias("j")).groupBy("id", "dl", "j").agg(F.sum("tf").alias("tf"))
    # as many rows as the query has terms
    n = tf.groupBy("j").agg(F.count("*").alias("n"))
    scored = tf.join(F.broadcast(n), "j").join(F.broadcast(index.stats))
    x = part(idf(F.col("n_rows"), F.col("n")), F.col("avgdl"), F.col("tf"), F.col("dl"))
    # added in the order of the terms, as a scan does: in that of arrival equal rows would differ in the last digits, and no longer tie
    parts = [F.coalesce(F.sum(F.when(F.col("j") == j, x)), F.lit(0.0)) for j in range(len(terms))]
    return scored.groupBy("id").agg(sum(parts, F.lit(0.0)).alias("score"))


def search_batch(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the k best rows of each of (query_id, text); plain terms.

    Asked postings are dealt by row, once; queries go to them, so that sums need no
    exchange and what is shuffled grows with the postings, not with rows times queries.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    asked = q.select("term").distinct().withColumn("bucket", bucket(F.col("term")))
    few = q.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    spark = index.postings.sparkSession
    pairs = (index.stats.first()["n_rows"] or 0) * queries.select("query_id").distinct().count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-pairs // PAIRS))
    found = index.postings.join(F.broadcast(asked) if few else asked.hint("merge"), ["bucket", "term"], "left_semi").select("id", "dl", "term", "tf")
    tf = found.repartition(tasks, "id").groupBy("id", "dl", "term").agg(F.sum("tf").alias("tf"))
    # counted from the sums, so that both readers take the same exchange
    n = tf.groupBy("term").agg(F.count(F.when(F.col("tf") > 0, 1)).alias("n")).join(F.broadcast(index.stats))
    # the logarithm is taken once for a term, not for each of its postings and queries
    w = n.select("term", idf(F.col("n_rows"), F.col("n")).alias("idf"), "avgdl")
    s = tf.join(F.broadcast(w) if few else w.hint("merge"), "term")
    x = s.select("term", "id", part(F.col("idf"), F.col("avgdl"), F.col("tf"), F.col("dl")).alias("x"))
    # sums in another order differ in the last digits; rounded, equal rows tie and go by id.  ``round`` would make a decimal of each
    total = x.join(F.broadcast(q) if few else q, "term").groupBy("query_id", "id").agg((F.rint(F.sum("x") * 1e9) / 1e9).alias("score"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return total.withColumn("rank", r).filter(F.col("rank") <= k)
