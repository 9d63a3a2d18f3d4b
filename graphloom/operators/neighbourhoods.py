"""Neighbourhoods of two steps in a table of nearest neighbours, and random ones that match a graph's by degree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .groups import stash
from .ordered import running

#: Rows that name a node from which on it is a hub, at least; there are at most so many hubs.
HUB_ROWS, HUBS = 1000, 10_000


def two_hop(neighbours: DataFrame, budget: int, decimals: int = 9) -> DataFrame:
    """(id, node, paths, best, rank): for each row of a table of nearest neighbours, the ``budget`` nodes that most of its neighbours name, and that aren't
    among them; by number of paths, then the largest product of similarities on one, then node. ``neighbours``: (id, neighbour, sim).

    The table is joined with itself. A node that very many rows name would meet all of them in one task; such hubs are few by their number of rows, so what
    they name is broadcast, and the shuffled join has only nodes with few rows.
    """
    first = stash(neighbours.select("id", F.col("neighbour").alias("mid"), F.col("sim").alias("sim1")), "neighbours")
    second = first.select(F.col("id").alias("m"), F.col("mid").alias("node"), F.col("sim1").alias("sim2"))
    hot = max(HUB_ROWS, first.count() // HUBS)
    hubs = F.broadcast(stash(first.groupBy("mid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(F.col("mid").alias("hub")), "hubs"))
    of_hubs = F.broadcast(second.join(hubs, F.col("m") == F.col("hub"), "left_semi"))
    near = first.join(of_hubs, F.col("mid") == F.col("m")).unionByName(first.join(hubs, F.col("mid") == F.col("hub"), "left_anti").join(second, F.col("mid") == F.col("m")))
    far = near.where("node <> id").groupBy("id", "node").agg(F.count(F.lit(1)).alias("paths"), F.round(F.max(F.col("sim1") * F.col("sim2")), decimals).alias("best"))
    far = far.join(first.select("id", F.col("mid").alias("node")), ["id", "node"], "left_anti")
    order = Window.partitionBy("id").orderBy(F.col("paths").desc(), F.col("best").desc(), F.col("node"))  # as many as a row's neighbours' neighbours
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget)


def _number(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def matched_samples(edges: DataFrame, labels: DataFrame, bins: DataFrame, draws: int, seed: int) -> DataFrame:
    """(node, draw, other): for each positive node and draw, as many random nodes of each degree bin as it has neighbours there, without itself or repeats.

    ``labels``: (node, y); ``bins``: (node, bin) of the labelled nodes; neighbours are labelled nodes. In each draw a bin's nodes stand in the order of a hash, and a node takes
    those that follow a place of its own, the last being followed by the first; so sizes are exact and no node meets all nodes of a bin.
    """
    rows = bins.select("node", "bin", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("draw"), F.col("node"))))
    placed = stash(running(rows, [F.col("h"), F.col("node")], {"place": ("sum", F.lit(1))}, ["draw", "bin"]).select("draw", "bin", "node", (F.col("place") - 1).alias("place")), "places")
    size = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("size"))
    ad = labels.where("y = 1").select(F.col("node").alias("u"))
    near = graph.adjacency(edges).join(ad, "u", "left_semi").join(bins.select(F.col("node").alias("v"), "bin"), "v")
    wanted = near.groupBy("u", "bin").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(size), "bin")  # a row for each bin
    wanted = wanted.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("from", F.pmod(_number(F.lit(seed), F.col("draw"), F.col("bin"), F.col("u")), F.col("size")))
    own = placed.select("draw", "bin", F.col("node").alias("u"), F.col("place").alias("own"))
    wanted = wanted.join(own, ["draw", "bin", "u"], "left").withColumn("own", F.pmod(F.col("own") - F.col("from"), F.col("size")))
    # Where the node itself is among those that follow, one more takes its place.
    steps = wanted.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m").cast("int")))).where("(i < m or own < m) and (own is null or i <> own)")
    at = steps.select("u", "draw", "bin", F.pmod(F.col("from") + F.col("i"), F.col("size")).alias("place"))
    return at.join(placed.withColumnRenamed("node", "other"), ["draw", "bin", "place"]).select(F.col("u").alias("node"), "draw", "other")


def neighbourhood_tests(edges: DataFrame, labels: DataFrame, bins: DataFrame, draws: int, seed: int, decimals: int = 9) -> DataFrame:
    """(node, degree, observed, null_mean, pvalue_right) of each positive node with labelled neighbours: the share of positives among them, and among random ones that match by degree."""
    y = labels.select(F.col("node").alias("other"), "y")
    samples = matched_samples(edges, labels, bins, draws, seed).join(y, "other").groupBy("node", "draw").agg(F.round(F.avg("y"), decimals).alias("x"))
    seen = graph.neighbour_fraction(edges, labels).where("y = 1 and degree_labeled > 0").select("node", F.col("degree_labeled").alias("degree"), F.round("ad_neighbor_fraction", decimals).alias("observed"))
    both = seen.join(samples, "node")
    return both.groupBy("node", "degree", "observed").agg(F.avg("x").alias("null_mean"), ((F.count_if(F.col("x") >= F.col("observed")) + 1) / (draws + 1)).alias("pvalue_right"))
