"""Greedy matching of cases with their nearest controls, without a task that sees the whole table.

Controls are numbered by value and dealt into cells of bounded size. In each round every cell lets its cases, in their order, take the nearest controls
that no earlier case holds, reading the holders of nearby cells as they were; a control that several cells gave away goes to its earliest claimer.
Rounds go on until holders stay as they are. A case only depends on earlier ones, so what settles is what taking turns over all cases gives, and each
round settles the earliest case that was not: in practice all but those whose claims cross a cell's border are settled at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import discard, stash
from .ordered import running_sums

#: Controls of a cell.
CELL = 20_000


def _root(links: list[int], i: int) -> int:
    top = i
    while links[top] != top:
        top = links[top]
    while links[i] != top:
        links[i], i = top, links[i]
    return top


class Free:
    """Sorted controls of which some are gone: the nearest one left, by distance, then id."""

    def __init__(self, values: np.ndarray, ids: np.ndarray):
        self.values, self.ids, self.n = values, ids, len(values)
        self.starts = np.searchsorted(values, values, "left")
        # From a place, the next one left upwards; from a place and one, the next one left downwards and one. The ends stand for none.
        self.up, self.down = list(range(self.n + 1)), list(range(self.n + 1))

    def remove(self, i: int) -> None:
        self.up[i], self.down[i + 1] = i + 1, i

    def nearest(self, value: float) -> tuple[int, float] | None:
        """Place and distance of the nearest control left; of equally near ones the smallest id."""
        at = int(np.searchsorted(self.values, value, "left"))
        right, left = _root(self.up, at), _root(self.down, at) - 1
        if left >= 0:  # the first of the equal values on this side
            left = _root(self.up, int(self.starts[left]))
        return self._nearer(value, left, right)

    def _nearer(self, value: float, left: int, right: int) -> tuple[int, float] | None:
        if right >= self.n and left < 0:
            return None
        far_left = value - self.values[left] if left >= 0 else np.inf
        far_right = self.values[right] - value if right < self.n else np.inf
        if far_left < far_right or far_left == far_right and self.ids[left] < self.ids[right]:
            return left, float(far_left)
        return right, float(far_right)

    def in_order(self, value: float) -> Iterator[tuple[int, float]]:
        """All controls, none of which is gone, from the nearest on."""
        right = int(np.searchsorted(self.values, value, "left"))
        left, end = (int(self.starts[right - 1]), right) if right else (-1, 0)  # the next of the equal values on this side, and where they end
        while found := self._nearer(value, left, right):
            yield found
            if found[0] == right:
                right += 1
            elif left + 1 < end:
                left += 1
            else:
                end = int(self.starts[left])
                left = int(self.starts[end - 1]) if end else -1


def _turns(cases: pd.DataFrame, controls: pd.DataFrame, per_case: int, again: bool, first: bool, last: bool) -> list[tuple]:
    """(turn, case, control, rank, sure) that the cases of a cell take in their order, where ``controls`` are those of the cell and those around it, to the
    table's ``first`` or ``last`` or not. ``again``: controls may be taken again. Not sure: a control beyond those read might have been nearer."""
    values = controls["value"].to_numpy()
    free = Free(values, controls["id"].to_numpy())
    holders = controls["holder"].to_numpy()
    held = np.argsort(holders, kind="stable")
    gone, out = 0, []
    for turn, case, value in zip(cases["turn"], cases["id"], cases["value"]):
        while not again and gone < len(held) and holders[held[gone]] < turn:
            free.remove(int(held[gone]))
            gone += 1
        ends = [np.inf if first else value - values[0], np.inf if last else values[-1] - value] if len(values) else [np.inf if first and last else -1.0]
        order = free.in_order(value) if again else iter(lambda v=value: free.nearest(v), None)
        taken = 0
        for place, far in islice(order, per_case):
            taken += 1
            out.append((turn, case, free.ids[place], taken, far < min(ends)))
            if not again:
                free.remove(place)
        if taken < per_case and not (first and last):
            out.append((turn, case, None, taken + 1, False))
    return out


def matched(features: DataFrame, per_case: int, stratum: str | None = None, again: bool = False) -> DataFrame:
    """(case_id, control_id, rank): cases in the order of their ids take their ``per_case`` nearest controls by ``value`` that no case before took; equal
    distances go by id. ``again``: a control may serve several cases. ``stratum``: a column within which cases and controls have to agree.

    ``features``: (id, value, is_case), ids of any type with an order, unique. Rows without a value neither take nor are taken; a case gets fewer
    controls if too few are left. A task reads a cell and those around it, as many as its cases need: where cases use up the controls of whole cells,
    more cells are read.
    """
    s = F.col(stratum) if stratum else F.lit(0)
    rows = features.select("id", s.alias("s"), F.col("value").cast("double").alias("value"), "is_case").where("value is not null and not isnan(value)")
    order = [F.col("s"), F.col("value"), F.col("is_case").desc(), F.col("id")]
    placed = running_sums(rows, order, {"place": (F.col("is_case") == 0).cast("long")})
    base = placed.groupBy("s").agg(F.min(F.col("place") - (F.col("is_case") == 0).cast("long")).alias("base"), F.count_if(F.col("is_case") == 0).alias("n"))
    placed = stash(placed.join(base, "s").withColumn("place", F.col("place") - F.col("base") - (F.col("is_case") == 0).cast("long")), "placed")
    last_cell = F.greatest(F.lit(0), F.floor((F.col("n") - 1) / CELL)).cast("int")
    cell = F.least(F.floor(F.col("place") / CELL).cast("int"), last_cell)
    turns = running_sums(placed.where("is_case = 1").select("s", "id", "value", cell.alias("cell"), last_cell.alias("last_cell")), [F.col("id")], {"turn": F.lit(1)})
    cases = stash(turns, "cases")
    controls = stash(placed.where("is_case = 0").select("s", "id", "value", "place", cell.alias("cell"), last_cell.alias("last_cell")), "controls")
    kind = rows.schema["id"].dataType.simpleString()
    free = F.lit((1 << 62)).cast("long")

    def run(key, own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        names = ["s", "cell", "turn", "case_id", "control_id", "rank", "sure"]
        if not len(own):
            return pd.DataFrame(columns=names)
        around = around.sort_values("place")
        first = around["c_cell"].min() <= 0 if len(around) else True
        last = around["c_cell"].max() >= own["last_cell"].iloc[0] if len(around) else True
        got = _turns(own.sort_values("turn"), around.rename(columns={"c_id": "id", "c_value": "value"}), per_case, again, bool(first), bool(last))
        out = pd.DataFrame(got, columns=names[2:])
        return out.assign(s=own["s"].iloc[0], cell=own["cell"].iloc[0])[names]

    s_kind = rows.schema["s"].dataType.simpleString()
    schema = f"s {s_kind}, cell int, turn long, case_id {kind}, control_id {kind}, rank int, sure boolean"
    claims, reach = None, 1
    while True:
        held = controls.withColumn("holder", free).withColumn("of_cell", F.lit(-1))
        if claims is not None and not again:
            first = claims.where("sure").groupBy(F.col("control_id").alias("id")).agg(F.min(F.struct("turn", "cell")).alias("h"))
            held = controls.join(first, "id", "left").select(*controls.columns, F.coalesce("h.turn", free).alias("holder"), F.coalesce("h.cell", F.lit(-1)).alias("of_cell"))
        to = F.explode(F.sequence(F.greatest(F.lit(0), F.col("cell") - reach), F.least(F.col("last_cell"), F.col("cell") + reach))).alias("to")
        around = held.select(F.col("s").alias("c_s"), to, F.col("cell").alias("c_cell"), F.col("id").alias("c_id"), F.col("value").alias("c_value"), "place", "holder", "of_cell")
        # What a cell's own cases held before is decided anew.
        around = around.withColumn("holder", F.when(F.col("of_cell") == F.col("to"), free).otherwise(F.col("holder"))).drop("of_cell")
        now = stash(cases.groupBy("s", "cell").cogroup(around.groupBy("c_s", "to")).applyInPandas(run, schema), "claims")
        unsure = not now.where("not sure").isEmpty()
        settled = again or claims is not None and now.exceptAll(claims).isEmpty() and claims.exceptAll(now).isEmpty()
        if claims is not None:
            discard(claims)
        claims = now
        if settled and not unsure:
            return claims.select("case_id", "control_id", "rank")
        if unsure:
            reach *= 2
