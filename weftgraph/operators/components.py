"""Connected components by star contraction (Kiveris and others, "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only a session on one machine may go without; it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _put(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, so that later stages neither recompute it nor need its executors."""
    return _put(df)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _contracted(now: DataFrame) -> bool:
    """Whether each node has one edge down at most, and none that is the lower end of another's."""
    ends = now.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(now.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or up = 1 and low = 1").isEmpty()


def labels(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, root): every node of an edge between two with the smallest that it is connected with.

    Rounds are logarithmic in the longest path; each reads and writes tables in the shared folder and removes those of the
    round before.  A node's least neighbour is a pre-aggregated minimum, and a node with very many edges is dealt out by Spark's skew
    join, so no neighbourhood meets in one task.  Loops and repeated edges do no harm; nothing comes to the driver but whether to go on.
    """
    spark = edges.sparkSession
    now, path = _put(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct())
    while not _contracted(now):
        sides = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        top = sides.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("top"))
        star, between = _put(sides.where("lo > hi").join(top, "hi").select(F.col("lo").alias("hi"), F.col("top").alias("lo")).where("hi <> lo").distinct())
        low = star.join(star.groupBy("hi").agg(F.min("lo").alias("top")), "hi")
        after = low.select(F.col("lo").alias("hi"), F.col("top").alias("lo")).unionByName(low.select("hi", F.col("top").alias("lo")))
        old, (now, path) = path, _put(after.where("hi <> lo").distinct())
        removed(spark, old)
        removed(spark, between)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id that each node is connected with.

    ``edges`` are (src, dst), made once and written, as they are read by the rounds and for their ends; ``nodes`` (id) adds isolated ones.
    """
    edges = written(edges.select("src", "dst"))
    out = labels(edges).select(F.col("node").alias("id"), F.col("root").alias("component"))
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    alone = (ends if nodes is None else ends.unionByName(nodes.select("id"))).distinct().join(out, "id", "left_anti")
    return out.unionByName(alone.select("id", F.col("id").alias("component")))
