"""Ordered analytics over a whole table, without a task that sees all of it: running sums, ranks, quantiles, scores."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import stash


#: Aggregates that can run along an order, and how two results of one are put together.
RUNNING = {"sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running(df: DataFrame, order: list[Column], values: dict[str, tuple[str, Column]], by: list[str] | None = None) -> DataFrame:
    """Add to each row running aggregates over it and the rows before it, by ``order`` (which must be total for a repeatable result), within each ``by`` if given.

    ``values``: of each new column, an aggregate of RUNNING and what it takes. Rows are dealt out by ranges of the order; aggregates run within a range, and
    the results of the ranges before, one row for each range and key in it, are put to them; so neither a table nor a key meets in one task.
    """
    by = by or []
    dealt = df.withColumns({f"__{k}": v for k, (_, v) in values.items()}).repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__range", F.spark_partition_id())
    dealt = stash(dealt, "ranges")
    within = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__range", *by).agg(*[RUNNING[how][0](f"__{k}").alias(f"__t_{k}") for k, (how, _) in values.items()])
    keys = [F.col(c).alias(f"__k_{c}") for c in by]
    totals = totals.select(F.col("__range").alias("__r"), *keys, *[RUNNING[how][0](f"__t_{k}").over(before).alias(f"__b_{k}") for k, (how, _) in values.items()])
    if by:
        totals = stash(totals, "totals")
    if not by or totals.count() <= MOST_TOTALS:
        totals = F.broadcast(totals)  # a row per partition, or a number that was checked
    same = F.col("__range") == F.col("__r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    out = dealt.withColumns({k: RUNNING[how][0](f"__{k}").over(within) for k, (how, _) in values.items()}).join(totals, same)
    out = out.withColumns({k: RUNNING[how][1](F.col(k), F.col(f"__b_{k}")) for k, (how, _) in values.items()})
    return out.drop("__range", "__r", *[f"__{k}" for k in values], *[f"__b_{k}" for k in values], *[f"__k_{c}" for c in by])


#: Rows of a table of totals that is broadcast.
MOST_TOTALS = 100_000


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``running`` with sums over the whole table."""
    return running(df, order, {k: ("sum", v) for k, v in sums.items()})


def fdr(tests: DataFrame, p: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """``tests`` with rank, n_tests and q: Benjamini-Hochberg adjusted p-values within each family ``by``; equal p-values get ranks by ``tie``, a unique column.

    q is the least of p * n / rank over the tests from this one to the largest p, and 1 at most. Tests without a p-value (null or NaN) have no rank and no q,
    and don't count.
    """
    by = by or []
    known = F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))
    ranked = running(tests.where(known), [F.col(p).asc(), F.col(tie).asc()], {"rank": ("sum", F.lit(1))}, by)
    n = tests.where(known).groupBy(*by).agg(F.count(F.lit(1)).alias("n_tests"))
    if by:
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__f_{c}")) for c in by])
        sized = ranked.join(n.withColumnsRenamed({c: f"__f_{c}" for c in by}), same).drop(*[f"__f_{c}" for c in by])
    else:
        sized = ranked.crossJoin(F.broadcast(n))  # one row
    raw = F.least(F.lit(1.0), F.col(p).cast("double") * F.col("n_tests") / F.col("rank"))
    out = running(sized, [F.col("rank").desc()], {"q": ("min", raw)}, by)
    return out.unionByName(tests.where(~known | F.col(p).isNull()), allowMissingColumns=True)


def quantiles(df: DataFrame, value: str, probabilities: list[float], weight: str | None = None) -> list[float | None]:
    """Exact quantiles with linear interpolation, ignoring null and NaN; ``weight`` has whole repeat counts. None without values."""
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.col(value).cast("double").alias("x")).agg(F.sum(weight or F.lit(1)).alias("n"))
    upto = stash(running_sums(counts, [F.col("x")], {"upto": F.col("n")}), "value-counts")
    total = upto.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(probabilities)
    places = [p * (total - 1) for p in probabilities]
    asked = sorted({int(h) + d for h in places for d in (0, 1) if int(h) + d < total})
    want = df.sparkSession.createDataFrame([(k,) for k in asked], "k long")
    hit = upto.join(F.broadcast(want), (F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k")))
    at = {r["k"]: r["x"] for r in hit.select("k", "x").collect()}
    return [at[int(h)] + (h - int(h)) * (at.get(int(h) + 1, at[int(h)]) - at[int(h)]) for h in places]


def qcut(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Quantile bins, closed on the right, the lowest value included, equal edges merged; one bin, 0, for a single value."""
    distinct = df.select(value).distinct().count()
    q = min(max(2, bins), distinct)
    if q <= 1:
        return df.withColumn(out, F.lit(0))
    edges = sorted(set(quantiles(df, value, [k / q for k in range(q + 1)])))
    return df.withColumn(out, sum(((F.col(value) > e).cast("int") for e in edges[1:-1]), F.lit(0)))


def average_ranks(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Ranks from 1, ties sharing their mean rank."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    upto = running_sums(counts, [F.col(value)], {"__upto": F.col("__n")})
    return df.join(upto.select(value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out)), value)


def auroc(df: DataFrame, score: str, y: str) -> DataFrame:
    """One row, auroc: by rank sums over distinct scores; null if a class is missing."""
    counts = df.groupBy(score).agg(F.sum(F.col(y).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    r = running_sums(counts, [F.col(score)], {"upto": F.col("n")})
    mid = F.col("upto") - (F.col("n") - 1) / 2
    s = r.agg(F.sum(mid * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    return s.select(F.when((F.col("p") > 0) & (neg > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).alias("auroc"))


def auprc(df: DataFrame, score: str, y: str, tie: str) -> DataFrame:
    """One row, auprc: trapezoids under precision by recall, from the point (0, 1), a point for each row, ties by ``tie``."""
    r = running_sums(df.select(score, tie, F.col(y).cast("long").alias("y")), [F.col(score).desc(), F.col(tie).asc()], {"tp": F.col("y"), "k": F.lit(1)})
    total = df.agg(F.sum(F.col(y).cast("long"))).first()[0]
    if not total:
        return df.sparkSession.createDataFrame([(None,)], "auprc double")
    # A row that isn't positive leaves recall as it is, so only positive rows have an area; the row before has the same tp less one.
    prev = F.when(F.col("k") > 1, (F.col("tp") - 1) / (F.col("k") - 1)).otherwise(1.0)
    return r.where("y = 1").agg((F.sum((F.col("tp") / F.col("k") + prev) / 2) / total).alias("auprc"))


def zscore(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """(x - mean) / population standard deviation, 0 where that is 0 or unknown."""
    stats = df.groupBy(*(by or [])).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    wide = df.join(F.broadcast(stats) if not by else stats, by) if by else df.crossJoin(F.broadcast(stats))  # one row without ``by``
    z = F.when((F.col("__s") == 0) | F.col("__s").isNull() | F.isnan("__s"), 0.0).otherwise((F.col(value) - F.col("__m")) / F.col("__s"))
    return wide.withColumn(out, z).drop("__m", "__s")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in cols])
