"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only.

Sizes are summed by source and hash bucket; a source's budget falls into one bucket, and only that one is refined by the
next bits of the hash, until all bits are used. Documents below the threshold are taken: nothing is sorted, and which
documents are taken depends on their ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stash, text_or_empty

#: Bits of the hash that each histogram uses; together 32.
BITS = (8, 8, 8, 8)
#: No document is taken more often.
MOST = 3


def n_words(name: str = "text") -> Column:
    """Number of stretches without white space; null has none."""
    return F.regexp_count(text_or_empty(name), F.lit(f"[^{SPACE}]+")).cast("long")


def hash32(id_col: Column) -> Column:
    """The first 32 bits of MD5 of the id as text; 0 for a null id."""
    digest = F.md5(F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...], most: int = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size): shares by weight, at most ``most`` times the size, the excess reshared.

    Sources in code-point order, null last, have the weights in turn. Sources that reach their limit are those with the
    smallest limit for their weight; a running sum over them gives the level at which the rest share what is left. There
    is one row per source here, and no text.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("weight", w).withColumn("cap", (most * F.col("source_size")).cast("double"))
    everything = Window.partitionBy()
    upto = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    left = F.col("all_size") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    level = left / (F.col("all_weight") - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    # the level if all sources before this one are at their limits; the right one is the first that its own source can hold
    t = t.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    share = F.coalesce(level * F.col("weight"), F.col("cap"))
    return t.select("source", "source_size", F.least(share, F.col("cap")).alias("target"))


def _shift(level: int) -> int:
    return 32 - sum(BITS[: level + 1])


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: (doc_id, size, source, source_size, target, copies, taken).

    ``taken`` = size * copies; copies = the whole passes that fit the target, plus one for documents whose hash is below
    the threshold of what is left. Documents of a source with one hash (repeated ids) are taken together or not at all,
    so a source stays below its target by less than its documents at the threshold. Null texts have size 0; null sources
    are one source, the last; null ids share one hash. Empty table: empty result. Further columns are ignored.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        n_words(text).alias("size"),
        hash32(F.col(id_col)).alias("h"),
    )
    sized = stash(sized.withColumn("null_source", F.col("source").isNull()).withColumn("key", F.coalesce("source", F.lit(""))), "sizes")
    own = ["key", "null_source"]
    bucket = F.shiftrightunsigned("h", _shift(0))
    hist = stash(sized.groupBy(*own, bucket.alias("b")).agg(F.sum("size").alias("size")), "histogram")
    totals = hist.groupBy(*own).agg(F.sum("size").alias("source_size"))
    totals = totals.withColumn("source", F.when(~F.col("null_source"), F.col("key")))
    plan = targets(totals, weights)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(F.lit(0)).cast("int")
    plan = plan.withColumn("passes", whole).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = plan.withColumn("null_source", F.col("source").isNull()).withColumn("key", F.coalesce("source", F.lit(""))).drop("source")
    plan = stash(plan, "targets")

    # Nested thresholds: ``below`` is the first hash that is not taken; only the bucket in which the budget ends is refined.
    state = plan.select(*own, "rest", F.lit(0).cast("long").alias("below"), F.lit(True).alias("open"))
    for level in range(len(BITS)):
        step = 1 << _shift(level)
        if level == 0:
            counts = hist
        else:
            wide = _shift(level - 1)
            at = state.where("open").select(*own, F.shiftrightunsigned("below", wide).alias("p"))
            inside = sized.withColumn("p", F.shiftrightunsigned("h", wide)).join(at, [*own, "p"])
            counts = inside.groupBy(*own, F.shiftrightunsigned("h", _shift(level)).alias("b")).agg(F.sum("size").alias("size"))
        upto = Window.partitionBy(*own).orderBy("b")
        counts = counts.withColumn("upto", F.sum("size").over(upto)).withColumn("before", F.col("upto") - F.col("size"))
        met = counts.join(state.where("open"), own).where("upto > rest").groupBy(*own).agg(F.min(F.struct("b", "before")).alias("m"))
        nxt = state.join(met, own, "left")
        hit = F.col("open") & F.col("m").isNotNull()
        state = nxt.select(
            *own,
            F.when(hit, F.col("rest") - F.col("m.before")).otherwise(F.col("rest")).alias("rest"),
            # no bucket goes over the budget: everything up to the end of the refined range fits
            F.when(hit, F.col("m.b") * step).when(F.col("open"), F.col("below") + (1 << (32 if level == 0 else _shift(level - 1)))).otherwise(F.col("below")).alias("below"),
            hit.alias("open"),
        )
        state = stash(state, "thresholds")

    # One row per source and bucket, so that the rows of a hot source meet their plan in many keys.
    rules = hist.select(*own, "b").join(plan, own).join(state.select(*own, "below"), own)
    out = sized.withColumn("b", bucket).join(rules, [*own, "b"])
    copies = F.col("passes") + (F.col("h") < F.col("below")).cast("int")
    return out.select("doc_id", "size", "source", "source_size", "target", F.least(copies, F.lit(MOST)).alias("copies"), (F.col("size") * F.least(copies, F.lit(MOST))).alias("taken"))


def apply_mix(docs: DataFrame, **kwargs) -> DataFrame:
    """The documents of the mix, a document that is taken twice as two rows; columns are those of ``docs``.

    Rows that share a doc_id and source have one hash, and so are taken alike.
    """
    copies = mix(docs, **kwargs).groupBy("doc_id", "source").agg(F.max("copies").alias("__copies")).where("__copies > 0")
    copies = copies.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"))
    on = docs["doc_id"].eqNullSafe(F.col("__id")) & docs["source"].eqNullSafe(F.col("__source"))
    return docs.join(copies, on).select(*[docs[c] for c in docs.columns])
