"""Helpers shared by the corpus operators: the shared scratch folder and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent, on one machine (as in tests), a temporary folder is made and set; on
    a cluster that would split the data among machines, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sparkveil-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sparkveil/{uuid.uuid4().hex}-{label}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table: lineage ends there.

    A lost executor later costs a reread of the table, never the work above it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables written by :func:`cut` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_and_digest(df: DataFrame) -> tuple[int, int]:
    got = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).first()
    return got[0], got[1] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) to (node, root): the smallest node reachable from each.

    Nodes without an edge to another node do not appear. Alternates the large-star and small-star
    steps (Kiveris et al., 2014): every round only needs each node's smallest neighbour, which is
    pre-aggregated before the shuffle, so no task ever gathers the neighbours of one node. A large step
    makes at most a row an edge, so only the small step, which may repeat rows, ends with a distinct.
    """
    forest = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    seen = rows_and_digest(forest)
    while seen[0]:
        both = forest.union(forest.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")), "large")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        hung = F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v"))))
        following = cut(large.join(low, "u").select(hung.alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "small")
        discard(large, forest)
        forest, before, seen = following, seen, rows_and_digest(following)
        if seen == before:
            break
    return forest.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        forest.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def clean_scratch(spark: SparkSession) -> None:
    """Delete all tables that these operators wrote to the shared folder; their results must be stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/sparkveil")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
