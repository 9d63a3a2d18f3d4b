"""Undirected graphs as canonical edge tables (src < dst, distinct), and label signals on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nan_to_null, normal_id
from .groups import components, dense_components, discard, stash
from .ordered import qcut, running, running_sums

CLASSES = ["ad_ad_edges", "ad_control_edges", "control_control_edges"]


def above(score: Column, least: float, strict: bool = True) -> Column:
    """score >= least; NaN and null fail. Strict: text that isn't a number is an error; else it fails too."""
    number = score.cast("double") if strict else score.cast("string").try_cast("double")
    return nan_to_null(number) >= least


def build(edges: DataFrame, src: str | None = None, dst: str | None = None, score: str | None = None, least: float = 0.0, strict: bool = True, once: bool = False) -> DataFrame:
    """(src, dst): ids are trimmed and upper-cased text; null and empty ends and self-loops go; src and dst default to the first two columns.

    ``once``: no two rows have the same ends, either way round and as such ids, so that rows needn't be compared.
    """
    src, dst = src or edges.columns[0], dst or edges.columns[1]
    if score is None and least > 0:
        raise ValueError("a least score needs a score column")
    if score is not None:
        if score not in edges.columns:
            raise ValueError(f"no column {score}")
        edges = edges.where(above(F.col(score), least, strict))
    ends = edges.select(normal_id(F.col(src)).alias("a"), normal_id(F.col(dst)).alias("b")).where("a <> '' and b <> '' and a <> b")
    pairs = ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return pairs if once else pairs.distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(u, v): each edge both ways."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree): 0 for a node without edges."""
    d = adjacency(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node").join(d, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def degree_bins(nodes: DataFrame, edges: DataFrame, bins: int = 10) -> DataFrame:
    """(node, degree, bin)."""
    return qcut(degrees(nodes, edges), "degree", bins)


def labelled_edges(edges: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges between labelled nodes with y_src and y_dst; ``by`` columns of ``labels`` (such as a permutation) repeat the graph."""
    by = by or []
    a = labels.select(*by, F.col("node").alias("src"), F.col("y").alias("y_src"))
    b = labels.select(*by, F.col("node").alias("dst"), F.col("y").alias("y_dst"))
    return edges.join(a, "src").join(b, [*by, "dst"])


def edge_classes(edges: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Labelled edges by class, one row for each ``by``."""
    both = F.col("y_src") + F.col("y_dst")
    counts = [F.count_if(both == k).alias(c) for k, c in zip((2, 1, 0), CLASSES)]
    out = labelled_edges(edges, labels, by)
    return out.groupBy(*by).agg(*counts) if by else out.agg(*counts)


def enrichment(classes: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Observed and expected shares of edges between positives, and their ratio."""
    n = labels.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_ad"))
    wide = n.join(classes, by, "left").fillna(0, CLASSES) if by else n.crossJoin(F.broadcast(classes))  # one row each
    return shares(wide)


def shares(wide: DataFrame) -> DataFrame:
    """Rows of numbers (n, n_ad, the classes) with labelled_edges, expected and observed shares of edges between positives, and their ratio, enrichment."""
    total = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    expected = F.when(F.col("n") < 2, 0.0).otherwise(F.col("n_ad") * (F.col("n_ad") - 1) / F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1)))
    wide = wide.withColumns({"labelled_edges": total, "expected": expected, "observed": F.when(total == 0, 0.0).otherwise(F.col(CLASSES[0]) / F.greatest(total, F.lit(1)))})
    return wide.withColumn("enrichment", F.col("observed") / F.greatest(F.col("expected"), F.lit(1e-12)))


def neighbour_fraction(edges: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, node, y, degree_labeled, ad_neighbor_fraction); the fraction is null for a node without labelled neighbours."""
    by = by or []
    adj = adjacency(edges)
    nb = labels.select(*by, F.col("node").alias("v"), F.col("y").alias("ny"))
    seen = adj.join(nb, "v").groupBy(*by, F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree_labeled"), F.avg("ny").alias("ad_neighbor_fraction"))
    return labels.select(*by, "node", "y").join(seen, [*by, "node"], "left").withColumn("degree_labeled", F.coalesce("degree_labeled", F.lit(0)))


def largest_component(edges: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, lcc): size of the largest connected group of positives; 1 if they have no edges, 0 without positives."""
    by = by or []
    inside = labelled_edges(edges, labels, by).where("y_src = 1 and y_dst = 1")
    key = lambda c: F.struct(*by, F.col(c).alias("node")) if by else F.col(c)
    groups = dense_components(stash(inside.select(key("src").alias("a"), key("dst").alias("b")), "inside"))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select(*[F.col("component")[c].alias(c) for c in by], "size")
    base = labels.groupBy(*by).agg(F.coalesce(F.max("y"), F.lit(0)).alias("any"))
    top = sizes.groupBy(*by).agg(F.max("size").alias("top"))
    wide = base.join(top, by, "left") if by else base.crossJoin(F.broadcast(top))
    return wide.select(*by, F.coalesce("top", "any").cast("long").alias("lcc"))


def spanning_forest(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(src, dst, score) of a maximum spanning forest of scored edges, of any number of components: Boruvka rounds.

    In each round every group of nodes keeps its best edge to another group (by score, then ends, so that no two are equal) and groups that edges join
    become one; a grouped maximum and two joins, whatever the degrees. Groups at least halve, so rounds go with the logarithm of the number of nodes.
    Repeated edges count once, by their best score; loops, and edges without an end or score, are left out.
    """
    own = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "score").where("src <> dst and score is not null")
    own = own.groupBy("src", "dst").agg(F.max("score").alias("score"))
    open_ = stash(own.select("src", "dst", "score", F.col("src").alias("a"), F.col("dst").alias("b")), "open")
    forest = None
    for _ in range(most_rounds):
        if open_.isEmpty():
            return forest if forest is not None else open_.select("src", "dst", "score")
        edge = F.struct("score", "src", "dst", "a", "b").alias("e")
        ends = open_.select(F.col("a").alias("group"), edge).union(open_.select(F.col("b").alias("group"), edge))
        best = stash(ends.groupBy("group").agg(F.max("e").alias("e")).select("e.*").distinct(), "best")
        chosen = best.select("src", "dst", "score")
        forest = chosen if forest is None else forest.union(chosen)
        merged = stash(components(best), "merged")
        to = lambda c: merged.select(F.col("node").alias(c), F.col("component").alias(f"new_{c}"))  # noqa: B023, E731
        joined = open_.join(to("a"), "a", "left").join(to("b"), "b", "left")
        moved = joined.select("src", "dst", "score", F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b")).where("a <> b")
        after = stash(moved, "open")
        discard(open_, merged)
        open_ = after
    raise RuntimeError(f"the forest did not settle in {most_rounds} rounds")


def threshold_sweep(edges: DataFrame, labels: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n_components, lcc) of the positives over edges of at least each threshold, isolated positives being components; lcc is 0 without positives.

    A maximum spanning forest has the same groups as the graph at any threshold, and fewer edges than nodes; so all thresholds are one job over it.
    """
    ad = stash(labels.where("y = 1").select("node"), "positives")
    inside = edges.join(ad.select(F.col("node").alias("src")), "src", "left_semi").join(ad.select(F.col("node").alias("dst")), "dst", "left_semi")
    cut = F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col("score"))).alias("threshold")
    kept = spanning_forest(inside).select("src", "dst", cut)
    key = lambda c: F.struct("threshold", F.col(c).alias("node"))
    groups = components(kept.select(key("src").alias("a"), key("dst").alias("b"))).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    found = groups.groupBy(F.col("component.threshold").alias("threshold")).agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("in_groups"), F.max("size").alias("top"))
    n = ad.agg(F.count(F.lit(1)).alias("n"))
    rows = ad.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double").crossJoin(F.broadcast(n)).join(found, "threshold", "left")
    alone = F.col("n") - F.coalesce("in_groups", F.lit(0))
    return rows.select("threshold", (F.coalesce("groups", F.lit(0)) + alone).alias("n_components"), F.coalesce("top", (F.col("n") > 0).cast("long")).alias("lcc"))


def bfs(edges: DataFrame, sources: DataFrame, allowed: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(source, node, dist): hops from every source within the allowed nodes; unreachable nodes are left out.

    A task searches from a block of sources in their piece of the graph. In pieces that no task holds, all sources advance together, hop by hop.
    """
    from . import pieces

    allowed = stash(allowed.select("node").distinct(), "allowed")
    sources = stash(sources.select("node").distinct().join(allowed, "node", "left_semi"), "sources")
    ends = lambda c: allowed.withColumnRenamed("node", c)
    nodes, held, open_ = pieces.pieces(edges.select("src", "dst").join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi"))
    found = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("dist")).unionByName(pieces.distances(nodes, pieces.packed(held), sources))
    return found if open_.isEmpty() else found.unionByName(_open_bfs(open_, sources, most_rounds).where("dist > 0"))


def _open_bfs(edges: DataFrame, sources: DataFrame, most_rounds: int) -> DataFrame:
    """As ``bfs``, over edges of any number, by a join for each hop."""
    adj = stash(adjacency(edges), "adjacency")
    front = stash(sources.join(adj.select(F.col("u").alias("node")), "node", "left_semi").select(F.col("node").alias("source"), "node", F.lit(0).alias("dist")), "frontier")
    seen = front
    for hop in range(1, most_rounds):
        step = front.join(adj, front["node"] == adj["u"]).select("source", F.col("v").alias("node")).distinct()
        front = stash(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("dist", F.lit(hop)), "frontier")
        if front.isEmpty():
            return seen
        seen = seen.union(front)
    raise RuntimeError(f"paths are longer than {most_rounds}")


def mean_shortest_path(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, mean_shortest_path: between positives, over labelled nodes, unreachable pairs left out; null with fewer than two positives, infinite if no pair is reachable."""
    from .bits import mean_paths, of_labels

    return mean_paths(edges, of_labels(labels), 1).select("mean_shortest_path")


def shortest_paths_by(edges: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean_ad_shortest_path): as ``mean_shortest_path`` for each ``by``, all of which label the same nodes."""
    from .bits import for_all, mean_paths, pack

    keys = stash(running_sums(labels.select(*by).distinct(), [F.col(c) for c in by], {"idx": F.lit(1)}).withColumn("idx", F.col("idx") - 1), "keys")
    n = keys.count()
    members = labels.where("y = 1").join(keys, by).select("node", "idx")
    means = mean_paths(edges, for_all(labels.select("node").distinct(), pack(members, n), n), n)
    return keys.join(means, "idx").select(*by, F.col("mean_shortest_path").alias("mean_ad_shortest_path"))


def nodes_by_class(labels: DataFrame) -> DataFrame:
    """(y, rank, node): the nodes of each class in the order of their ids."""
    return running(labels.select("y", "node"), [F.col("node")], {"rank": ("sum", F.lit(1))}, ["y"])


def within_graph(labels: DataFrame, edges: DataFrame, least: int = 20) -> DataFrame:
    """The labelled nodes that the graph has; an error if there are fewer than ``least``."""
    found = stash(labels.join(adjacency(edges).select(F.col("u").alias("node")), "node", "left_semi"), "labels")
    if (n := found.count()) < least:
        raise ValueError(f"only {n} labelled nodes are in the graph: check the kind of identifiers")
    return found


def metrics(edges: DataFrame, labels: DataFrame, by: list[str] | None = None, lcc: bool = True, paths: bool = False) -> DataFrame:
    """The metric bundle, one row for each ``by``: numbers of nodes, classes, shares, enrichment, neighbour fraction, and if asked for, largest component and shortest path."""
    out = enrichment(edge_classes(edges, labels, by), labels, by).withColumn("n_control", F.col("n") - F.col("n_ad"))
    nf = neighbour_fraction(edges, labels, by).groupBy(*(by or [])).agg(F.avg("ad_neighbor_fraction").alias("mean_ad_neighbor_fraction"))
    out = out.join(nf, by, "left") if by else out.crossJoin(F.broadcast(nf))
    if lcc:
        top = largest_component(edges, labels, by)
        out = out.join(top, by, "left") if by else out.crossJoin(F.broadcast(top))
    if paths:
        mean = shortest_paths_by(edges, labels, by) if by else mean_shortest_path(edges, labels).withColumnRenamed("mean_shortest_path", "mean_ad_shortest_path")
        out = out.join(mean, by, "left") if by else out.crossJoin(F.broadcast(mean))
    return out
