"""Maximum coverage: candidates ranked by how many items each adds to what those before it cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import discard, stash
from .ordered import running


def coverage(pairs: DataFrame, most: int, loss: float = 0.0) -> DataFrame:
    """(rank, candidate, gain, covered) of the first ``most`` candidates of a greedy ranking. ``pairs``: (candidate, item).

    Without a ``loss`` each round picks the candidate of the largest gain, the smallest id of equal ones: plain greedy, a count and a join for each pick. With
    one, a round takes, of the candidates whose gain is within it of the best one's, in the order of gain and id, all that keep such a gain after those before
    them in the round; so each pick's gain is at least 1 - loss of the best there was, and rounds go with the logarithm of the gains rather than the number of
    picks. The items of what is picked go from the table, and the next round counts anew.
    Repeated pairs count once; pairs without a candidate or item, and candidates that add nothing, are left out.
    """
    left = stash(pairs.select("candidate", "item").where("candidate is not null and item is not null").distinct(), "pairs")
    picked, n, covered = None, 0, 0
    while n < most:
        gains = left.groupBy("candidate").agg(F.count(F.lit(1)).alias("gain"))
        if loss:
            gains = stash(gains, "gains")
        best = gains.orderBy(F.col("gain").desc(), F.col("candidate").asc()).first()
        if best is None:
            break
        if not loss:
            items = left.where(F.col("candidate") == F.lit(best["candidate"])).select("item")
            after = stash(left.join(items, "item", "left_anti").select("candidate", "item"), "pairs")
            discard(left)
            left, n, covered = after, n + 1, covered + best["gain"]
            picked = [*(picked or []), (n, best["candidate"], best["gain"], covered)]
            continue
        least = (1 - loss) * best["gain"]
        batch = stash(running(gains.where(F.col("gain") >= least), [F.col("gain").desc(), F.col("candidate").asc()], {"turn": ("sum", F.lit(1))}), "batch")
        first = lambda rows: rows.groupBy("item").agg(F.min("turn").alias("turn")).groupBy("turn").agg(F.count(F.lit(1)).alias("own"))
        owned = left.join(batch.select("candidate", "turn"), "candidate")
        kept = batch.join(first(owned), "turn").where(F.col("own") >= least)
        place = running(kept.select("turn", "candidate"), [F.col("turn")], {"place": ("sum", F.lit(1))})
        taken = stash(place.where(F.col("place") <= most - n), "taken")
        items = stash(left.join(taken.select("candidate", "turn"), "candidate").groupBy("item").agg(F.min("turn").alias("turn")), "items")
        gained = taken.join(items.groupBy("turn").agg(F.count(F.lit(1)).alias("gain")), "turn")
        rows = gained.select((F.col("place") + n).cast("long").alias("rank"), "candidate", "gain").collect()  # of the ``most`` that are asked for
        for r in sorted(rows):
            covered += r["gain"]
            picked = [*(picked or []), (r["rank"], r["candidate"], r["gain"], covered)]
        n += len(rows)
        after = stash(left.join(items.select("item"), "item", "left_anti").select("candidate", "item"), "pairs")
        discard(left, gains, batch, taken, items)
        left = after
    kind = pairs.schema["candidate"].dataType.simpleString()
    return pairs.sparkSession.createDataFrame(picked or [], f"rank long, candidate {kind}, gain long, covered long")
