"""Written intermediate tables, and connected groups of a graph."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether shuffle files go at the end of a query; else they stay until the driver's JVM happens to collect what refers to them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Unset, it is a temporary one on a local master (tests), and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table: its lineage is cut, and it outlives executors."""
    spark, was = df.sparkSession, df.sparkSession.conf.get(CLEANUP, "false")
    path = f"{shared_dir(spark)}/stash/{name}-{uuid.uuid4().hex}"
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    found = spark.read.schema(df.schema).parquet(path)
    found.__dict__["stashed_at"] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the files of stashed tables from which nothing will be read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.__dict__["stashed_at"])
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected groups of the undirected ``edges``: one row (node, component) per node, component = smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round links nodes to the smallest
    neighbour they know of, by a grouped minimum (partially aggregated) and one join that only repeats an edge's ends,
    so a hub with most of the nodes never meets in one group. Rounds go on until the edges stop changing, which takes
    about the logarithm of a group's diameter; each is written to the shared folder. Nodes may be of any type with an order,
    structs too. An empty input gives no rows; self-links and repeated links are ignored; null ends are dropped.
    """
    known = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    known = stash(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, mark = known, None
    for _ in range(max_rounds):
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash(large.where("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # large holds u > v only
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        known = stash(small.distinct(), "edges")
        discard(before, large)
        before = known
        now = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = known.select(F.col("v").alias("node")).distinct()
    return known.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        tops.select("node", F.col("node").alias("component"))
    )


def dense_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """As ``components``, for a written table in which nodes have many edges.

    A node first joins the group of its smallest neighbour, and that one's, which takes one grouped minimum over the edges and rounds over the nodes only. What
    is left are the edges between such groups, few where nodes have many edges; ``components`` joins the groups by them.
    """
    own = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
    tops = stash(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("top")), "tops")
    for _ in range(max_rounds):  # paths to a group's smallest node halve
        up = tops.select(F.col("node").alias("top"), F.col("top").alias("next"))
        after = stash(tops.join(up, "top").select("node", F.col("next").alias("top"), (F.col("next") != F.col("top")).alias("moved")), "tops")
        discard(tops)
        tops = after
        if tops.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
    to = lambda c: tops.select(F.col("node").alias(c), F.col("top").alias(f"top_{c}"))
    between = own.join(to("u"), "u").join(to("v"), "v").where("top_u <> top_v").select("top_u", "top_v")
    groups = components(between, "top_u", "top_v").withColumnRenamed("node", "top")
    return tops.join(groups, "top", "left").select("node", F.coalesce("component", "top").alias("component"))
