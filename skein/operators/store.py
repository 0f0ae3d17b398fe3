"""Table maintenance: upserts, cascade deletes, resolution of edge targets.

Functions take and return DataFrames; ``replace_table`` writes a table's new state,
since the plain Parquet source has no merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """``current`` with rows of ``new`` in place of those with the same keys; of new rows with one key, the last by ``order``."""
    if order is not None:
        new = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).filter("_r = 1").drop("_r")
    else:
        new = new.dropDuplicates(keys)
    return current.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_if_absent(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(new.dropDuplicates(keys).join(current, keys, "left_anti"), allowMissingColumns=True)


def upsert_embeddings(current: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """As ``upsert``; a vector of another size fails the job."""
    checked = new.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"embedding does not have {dim} dimensions"))))
    return upsert(current, checked, ["node_id"])


def delete_by_file(tables: dict[str, DataFrame], file_path: str) -> dict[str, DataFrame]:
    """nodes, edges, embeddings, node_scores without the file's nodes and all that refers to them."""
    ids = tables["nodes"].filter(F.col("file_path") == file_path).select(F.col("id").alias("_id"))
    out = dict(tables)
    out["nodes"] = tables["nodes"].filter(F.col("file_path") != file_path)
    out["edges"] = tables["edges"].join(ids, F.col("source_id") == F.col("_id"), "left_anti").join(ids, F.col("target_id") == F.col("_id"), "left_anti")
    for name in ("embeddings", "node_scores"):
        if name in tables:
            out[name] = tables[name].join(ids, F.col("node_id") == F.col("_id"), "left_anti")
    return out


def incoming_cross_file_edges(nodes: DataFrame, edges: DataFrame, file_path: str) -> DataFrame:
    """Edges into the file's nodes from nodes of other files, or of none."""
    own = nodes.filter(F.col("file_path") == file_path).select(F.col("id").alias("_id"))
    return edges.join(own, F.col("target_id") == F.col("_id"), "left_semi").join(own, F.col("source_id") == F.col("_id"), "left_anti")


def symbol_index(nodes: DataFrame) -> DataFrame:
    """name, id: exact names first, then bare method names; the least (file_path, id) of each."""
    bare = F.substring_index("symbol_name", ".", -1)
    named = nodes.select("id", "file_path", F.explode(F.array(F.struct(F.col("symbol_name").alias("name"), F.lit(0).alias("p")), F.struct(bare.alias("name"), F.lit(1).alias("p")))).alias("n"))
    return named.groupBy("n.name").agg(F.min_by("id", F.struct("n.p", "file_path", "id")).alias("id"))


def resolve_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is no node, or null, pointed at the node that their target_symbol names."""
    known = nodes.select(F.col("id").alias("_known"))
    index = symbol_index(nodes).select(F.col("name").alias("target_symbol"), F.col("id").alias("_resolved"))
    e = edges.join(known, F.col("target_id") == F.col("_known"), "left").join(index, "target_symbol", "left")
    target = F.when(F.col("_known").isNotNull(), F.col("target_id")).otherwise(F.coalesce("_resolved", "target_id"))
    return e.withColumn("target_id", target).select(*edges.columns).dropDuplicates(["source_id", "target_id", "edge_type"])


def stale_files(known: DataFrame, current: DataFrame) -> DataFrame:
    return known.select("file_path").distinct().join(current.select("file_path"), "file_path", "left_anti")


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as the next version of the table at ``path`` and returns it.

    Versions lie beside each other in folders ``v=<n>``; a version is there once its
    ``_SUCCESS`` marker is, which Spark writes last.  So a reader, or a crash at any
    point, has the old version or the new one, never less.  The version before the
    current one is kept for readers that have listed it, older ones go.
    """
    spark = df.sparkSession
    versions = table_versions(spark, path)
    new = (versions[-1] if versions else 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v={new:08d}")
    fs, folder = _folder(spark, path)
    for v in versions[:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"v={v:08d}"), True)
    return read_table(spark, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that ``replace_table`` writes."""
    versions = table_versions(spark, path)
    if not versions:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v={versions[-1]:08d}")


def table_versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, in order."""
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder
