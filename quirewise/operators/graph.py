"""Lineage cuts and connected components, for operators that iterate."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: More rounds than any graph of 2**40 nodes needs; reaching it is an error.
MAX_ROUNDS = 60


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session's ``spark.checkpoint.dir`` names.

    Where a session names none: a temporary folder on one machine, an error on a cluster.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quirewise-"))
    return named or context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _to_smallest(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node is pointed at the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _below_smallest(edges: DataFrame) -> DataFrame:
    """Each node and its neighbours below it are pointed at the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node that an edge joins to another: the smallest node it can reach.

    ``edges`` has two columns of one orderable type; direction, repeats, loops and
    nulls do not matter.  Two star operations alternate until only stars are left:
    rounds grow with the logarithm of the nodes, not with the length of a chain,
    and a node of very many neighbours is never gathered in one place.
    """
    a, b = edges.columns
    now = checkpoint(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen.n == 0 or (seen.n, seen.h) == mark:
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.union(now.select(F.col("v"), F.col("v")).distinct())
        mark = (seen.n, seen.h)
        now = checkpoint(_below_smallest(_to_smallest(now)))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
