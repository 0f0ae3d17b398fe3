"""Cutting lineage of iterative plans in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder if all runs on this machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("skein.cut.dir", None)
    if root:
        return root
    if (kept := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return kept.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="skein-")
    spark.conf.set("skein.cut.dir", root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, once, and read from there; ``drop`` removes it.

    A checkpoint would run the last stage twice and stay on disk to the end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/skein-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Removes tables that ``cut`` wrote and nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_skein_path", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
