"""Operators on (id, v ARRAY<DOUBLE>) tables: nearest neighbours, pairwise distances, means, standardising, spectrum.

All-pairs work goes block by block: rows are dealt into blocks of bounded size, and each pair of blocks is one matrix product
in one task, which returns only its best neighbours or its counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import binary_entropy
from ..functions.vectors import as_matrix

#: Bytes of a block's vectors, cells of a product that are held at a time, rows below which a block isn't divided, parts that are asked for at least.
BLOCK_BYTES, CELLS, FEW, PARTS = 16 << 20, 1 << 18, 250, 8
#: Decimals to which similarities are compared, so that ties don't hang on the order of summation.
DECIMALS = 9


def _sizes(vectors: DataFrame) -> tuple[int, int]:
    """Number of rows, and length of the longest."""
    n, d = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    return n, max(1, d or 1)


def _number(sizes: tuple[int, int], block: int | None, least: int) -> int:
    """Of blocks: of ``block`` rows, or as large as fit into BLOCK_BYTES, but no fewer than ``least`` if there are rows for them."""
    n, d = sizes
    rows = block or max(1, min(BLOCK_BYTES // (8 * d), max(FEW, -(-n // least))))
    return max(1, -(-n // rows))


def _block(n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def _tiles(rows: int) -> Iterator[slice]:
    """Slices of ``rows``; the product of two has CELLS cells at most."""
    step = max(1, math.isqrt(CELLS))
    for at in range(0, rows, step):
        yield slice(at, at + step)


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, each by its length."""
    x = as_matrix(column)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _block_pairs(vectors: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The table twice, each row copied to every pair of ``n`` blocks it takes part in, each pair once."""
    dealt = vectors.withColumn("blk", _block(n))
    others = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dealt.withColumn("other", others).withColumn("pair", F.concat_ws(":", "blk", "other"))
    right = dealt.withColumn("other", others).withColumn("pair", F.concat_ws(":", "other", "blk"))
    return left.where("blk <= other"), right.where("other <= blk")


def _renamed(right: DataFrame, names: list[str]) -> DataFrame:
    """Other names for the second copy of one table, so that none is taken for the first."""
    return right.select(*[F.col(n).alias(f"{n}_r") for n in names])


def _best(x: np.ndarray, y: np.ndarray, place: np.ndarray | None, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, sim) of the ``k`` best columns of each row but its own, ties by column. A tile's cells are rounded and ordered only where they reach the k-th best so far."""
    row, col, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least = np.full(len(x), -np.inf)
    for to in _tiles(len(y)):
        s = x @ y[to].T
        if place is None:
            s[own[:, None] == ids[None, to]] = -np.inf
        else:
            inside = np.flatnonzero((place >= to.start) & (place < to.stop))
            s[inside, place[inside] - to.start] = -np.inf
        bound = least if s.shape[1] <= k else np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]) if not to.start else least
        r, c = np.nonzero(s >= (bound - 10.0**-DECIMALS)[:, None])
        here = s[r, c]
        r, c, here = r[here > -np.inf], c[here > -np.inf], here[here > -np.inf]
        if not len(r):
            continue
        row, col, sim = np.append(row, r), np.append(col, c + to.start), np.append(sim, np.round(here, DECIMALS))
        order = np.lexsort((col, -sim, row))
        row, col, sim = row[order], col[order], sim[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < k
        row, col, sim, rank = row[kept], col[kept], sim[kept], rank[kept]
        last = rank == k - 1
        least[row[last]] = sim[last]
    return row, col, sim


def nearest(vectors: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(id, neighbour, sim, rank): the ``k`` other rows of the largest cosine, ties by id; fewer if there are fewer rows.

    Rows are asked for in parts and looked for in blocks, as large as a task's memory takes (or of ``block`` rows): a row is copied once for each block,
    and once for each part. A task returns the best of a block for each row of its part; the best of all blocks follow.
    """
    kind, arrow = vectors.schema["id"].dataType.simpleString(), to_arrow_type(vectors.schema["id"].dataType)
    sizes = _sizes(vectors)
    parts, blocks = _number(sizes, block, PARTS), _number(sizes, block, 1)
    left = vectors.select(_block(parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("in"), "id", "v")
    right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part_r"), _block(blocks).alias("in_r"), F.col("id").alias("id_r"), F.col("v").alias("v_r"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if len(a) and len(b):
            b = b.sort_by("id_r")
            ids, own, x, y = b["id_r"].to_numpy(), a["id"].to_numpy(), _unit(a["v"]), _unit(b["v_r"])
            index = pd.Index(ids)
            for at in _tiles(len(x)):
                row, col, sim = _best(x[at], y, index.get_indexer(own[at]) if index.is_unique else None, own[at], ids, k)
                found.append((own[at][row], ids[col], sim))
        columns = [np.concatenate(c) for c in zip(*found)] or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (arrow, arrow, pa.float64()))], names=["id", "neighbour", "sim"])

    cands = left.groupBy("part", "in").cogroup(right.groupBy("part_r", "in_r")).applyInArrow(run, f"id {kind}, neighbour {kind}, sim double")
    order = Window.partitionBy("id").orderBy(F.col("sim").desc(), F.col("neighbour"))
    return cands.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def purity(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, y, knn_purity, knn_entropy) from ``nearest`` and (id, y)."""
    nb = labels.select(F.col("id").alias("neighbour"), F.col("y").alias("ny"))
    g = neighbours.join(nb, "neighbour").join(labels, "id").groupBy("id", "y")
    out = g.agg(F.avg((F.col("ny") == F.col("y")).cast("int")).alias("knn_purity"), F.avg("ny").alias("p"))
    return out.select("id", "y", "knn_purity", binary_entropy(F.col("p")).alias("knn_entropy"))


def purity_sweep(neighbours: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """(k, id, y, knn_purity, knn_entropy) for several k, from neighbours ranked once to the largest."""
    each = neighbours.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))))
    nb = labels.select(F.col("id").alias("neighbour"), F.col("y").alias("ny"))
    g = each.join(nb, "neighbour").join(labels, "id").groupBy("k", "id", "y")
    out = g.agg(F.avg((F.col("ny") == F.col("y")).cast("int")).alias("knn_purity"), F.avg("ny").alias("p"))
    return out.select("k", "id", "y", "knn_purity", binary_entropy(F.col("p")).alias("knn_entropy"))


#: Classes of pairs by how many of the two are positive; bins of a pass in the search for an order statistic, values that are listed at once, rows that the first
#: guess of the medians is made from, and what of a class is looked at around it (on either side).
KINDS, FINE, LISTED, GUESSED, AROUND = ("control-control", "AD-control", "AD-AD"), 1 << 14, 1 << 20, 4000, 0.03
#: Width within which values are told apart by listing them only, and by which a listed range is widened: sums of other shapes may differ in their last bits.
CLOSE, SLACK = 1e-12, 1e-14


def _place(d: np.ndarray, lo: float, hi: float, bins: int) -> np.ndarray:
    return np.clip(((d - lo) * bins / (hi - lo)).astype(np.int64), 0, bins - 1) if hi > lo else np.zeros(len(d), np.int64)


class Distances:
    """Cosine distances of all pairs of rows of ``vectors`` (id, v, y), by class. Each pass over them is one job, whose tasks return a few numbers for a pair of blocks.

    A block's rows are ordered by class and id, so that a class's cells are tiles of a product, which are counted as they are.
    """

    def __init__(self, vectors: DataFrame, block: int | None = None, medians: bool = True):
        cols = ["pair", "blk", "id", "y", "v"]
        left, right = _block_pairs(vectors, _number(_sizes(vectors), block, 4))
        self.left, self.right = left.select(cols), _renamed(right, cols)
        #: By class: bins around a guess of its median, which are counted in the first pass; they save passes and change no result.
        self.around = self._guess(vectors) if medians else {}
        around = self.around

        def first(kind: int, tiles: Iterator[np.ndarray]) -> list[tuple]:
            n, total, lo, hi, below, counts = 0, 0.0, np.inf, -np.inf, 0, np.zeros(FINE, np.int64)
            for d in tiles:
                n, total, lo, hi = n + d.size, total + d.sum(), min(lo, d.min()), max(hi, d.max())
                if kind in around:
                    below += _count(d, *around[kind], counts)
            out = [(kind, -1, n, total, lo, hi)] if n else []
            return out + [(kind, -2, below, None, None, None)] * (below > 0) + [(kind, int(b), int(counts[b]), None, None, None) for b in np.flatnonzero(counts)]

        rows = self._pass(first, "kind int, bin int, n long, total double, lo double, hi double")
        found = rows.groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # FINE rows for each class
        #: By class: number, sum, least and largest.
        self.ends = {r["kind"]: (r["n"], r["total"], r["lo"], r["hi"]) for r in found if r["bin"] == -1}
        self.counted = {k: {r["bin"]: r["n"] for r in found if r["kind"] == k and r["bin"] != -1} for k in self.ends}

    @staticmethod
    def _guess(vectors: DataFrame) -> dict[int, tuple[float, float]]:
        some = vectors.select("id", "y", "v").orderBy(F.xxhash64("id"), "id").limit(GUESSED).toArrow()
        if len(some) < 50:
            return {}
        x, y, out = _unit(some["v"]).astype(np.float32), some["y"].to_numpy(), {}
        for k, (a, b) in enumerate(((x[y == 0], x[y == 0]), (x[y == 0], x[y == 1]), (x[y == 1], x[y == 1]))):
            if len(a) > 1 and len(b) > 1:
                lo, hi = np.quantile(1 - a @ b.T, [0.5 - AROUND, 0.5 + AROUND])
                if hi > lo:
                    out[k] = float(lo), float(hi)
        return out

    def _pass(self, of: Callable[[int, Iterator[np.ndarray]], list[tuple]], schema: str) -> DataFrame:
        """``of`` gets a class and its distances between two blocks, a tile at a time."""
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        types = [kinds[c.split()[1]] for c in schema.split(", ")]

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if len(a) and len(b):
                b = b.rename_columns([c.removesuffix("_r") for c in b.column_names])
                same = a["blk"][0] == b["blk"][0]
                sides = []
                for t in (a, b):
                    t = t.sort_by([("y", "ascending"), ("id", "ascending")])
                    x, y, ids = _unit(t["v"]), t["y"].to_numpy(), t["id"].to_numpy()
                    sides.append([(x[y == c], ids[y == c]) for c in (0, 1)])

                def tiles(kind: int) -> Iterator[np.ndarray]:
                    for i, j in ((0, 0),) if kind == 0 else ((0, 1), (1, 0)) if kind == 1 else ((1, 1),):
                        (x, ia), (y, ib) = sides[0][i], sides[1][j]
                        for at in _tiles(len(x)):
                            for to in _tiles(len(y)):
                                d = x[at] @ y[to].T
                                np.subtract(1, d, out=d)
                                d = d[ia[at, None] < ib[None, to]] if same else d.ravel()
                                if d.size:
                                    yield d

                for kind in range(3):
                    out += of(kind, tiles(kind))
            columns = list(zip(*out)) or [[]] * len(names)
            return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        return self.left.groupBy("pair").cogroup(self.right.groupBy("pair_r")).applyInArrow(run, schema)

    def binned(self, targets: list[tuple[int, float, float]], bins: int) -> DataFrame:
        """(target, bin, n): of the values of a target's class from lo to hi, how many are in each of equal bins; bin -2 has those below."""

        def count(kind: int, tiles: Iterator[np.ndarray]) -> list[tuple]:
            own = {t: np.zeros(bins, np.int64) for t, (k, *_) in enumerate(targets) if k == kind}
            below = dict.fromkeys(own, 0)
            for d in tiles if own else ():
                for t in own:
                    below[t] += _count(d, *targets[t][1:], own[t])
            return [(t, b, int(n)) for t in own for b, n in [(-2, below[t]), *((int(b), own[t][b]) for b in np.flatnonzero(own[t]))] if n]

        return self._pass(count, "target int, bin int, n long").groupBy("target", "bin").agg(F.sum("n").alias("n"))

    def listed(self, targets: list[tuple[int, float, float]]) -> DataFrame:
        """(target, value, n): the distinct values of a target's class from lo to hi; a null value has those below."""

        def values(kind: int, tiles: Iterator[np.ndarray]) -> list[tuple]:
            own = {t: [] for t, (k, *_) in enumerate(targets) if k == kind}
            below = dict.fromkeys(own, 0)
            for d in tiles if own else ():
                for t in own:
                    _, lo, hi = targets[t]
                    low = d < lo
                    below[t] += int(np.count_nonzero(low))
                    found = d[~low & (d <= hi)]
                    if len(found):
                        own[t].append(np.unique(found, return_counts=True))
            out = [(t, None, below[t]) for t in own if below[t]]
            for t, parts in own.items():
                if parts:
                    n = pd.Series(np.concatenate([n for _, n in parts])).groupby(np.concatenate([x for x, _ in parts])).sum()
                    out += [(t, float(x), int(c)) for x, c in n.items()]
            return out

        return self._pass(values, "target int, value double, n long").groupBy("target", "value").agg(F.sum("n").alias("n"))

    def at_ranks(self, asked: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
        """The distances of a class and rank, exactly: passes divide the bin that holds the rank, until it holds few enough to be listed; ranks are counted anew in each pass."""
        out, open_, few = {}, {}, {}
        for kind, rank in asked:
            n, _, lo, hi = self.ends[kind]
            open_[kind, rank] = (lo, hi)
            if n <= LISTED:
                few[kind, rank] = SLACK
            elif kind in self.around:
                self._narrow((kind, rank), self.around[kind], self.counted[kind], open_, few)
        while open_:
            wide = [k for k in open_ if k not in few]
            close = [k for k in open_ if k in few]
            if wide:
                found = self.binned([(k[0], *open_[k]) for k in wide], FINE).collect()  # FINE rows for each
                for t, key in enumerate(wide):
                    if not self._narrow(key, open_[key], {r["bin"]: r["n"] for r in found if r["target"] == t}, open_, few):
                        open_[key] = self.ends[key[0]][2:]
            if close:
                targets = sorted({(k[0], open_[k][0] - few[k], open_[k][1] + few[k]) for k in close})
                found = self.listed(targets).collect()  # LISTED rows for each, or as many as there are numbers within CLOSE
                for key in close:
                    t = targets.index((key[0], open_[key][0] - few[key], open_[key][1] + few[key]))
                    rank = key[1] - sum(r["n"] for r in found if r["target"] == t and r["value"] is None)
                    own = sorted((r["value"], r["n"]) for r in found if r["target"] == t and r["value"] is not None)
                    upto = np.cumsum([n for _, n in own])
                    if own and 0 <= rank < upto[-1]:
                        out[key] = own[int(np.searchsorted(upto, rank, side="right"))][0]
                        del open_[key]
                    else:
                        few[key] *= 16
        return out

    def _narrow(self, key: tuple[int, int], ends: tuple[float, float], counts: dict[int, int], open_: dict, few: dict) -> bool:
        """Go on with the bin that holds the rank, if the bins between ``ends`` hold it."""
        (lo, hi), rank = ends, key[1] - counts.get(-2, 0)
        for b in sorted(b for b in counts if b >= 0):
            if 0 <= rank < counts[b]:
                step = (hi - lo) / FINE
                open_[key] = (lo + b * step - SLACK, lo + (b + 1) * step + SLACK)
                if counts[b] <= LISTED or step <= CLOSE:
                    few[key] = SLACK
                return True
            rank -= counts[b]
        return False


def _count(d: np.ndarray, lo: float, hi: float, counts: np.ndarray) -> int:
    """Add to ``counts`` the values from lo to hi by bin; how many are below."""
    low = d < lo
    inside = d[~low & (d <= hi)]
    if len(inside):
        counts += np.bincount(_place(inside, lo, hi, len(counts)), minlength=len(counts))
    return int(np.count_nonzero(low))


def distance_counts(vectors: DataFrame, block: int | None = None, medians: bool = True) -> Distances:
    """The distances of all pairs, for ``distance_summary`` and ``histogram``; the latter needs no guess of ``medians``."""
    return Distances(vectors, block, medians)


def distance_summary(pairs: Distances) -> DataFrame:
    """(pair_type, n_pairs, mean_cosine_distance, median_cosine_distance); all three classes, nulls for an empty one."""
    middle = {k: ((n - 1) // 2, n // 2) for k, (n, *_) in pairs.ends.items()}
    found = pairs.at_ranks(sorted({(k, r) for k, own in middle.items() for r in own}))
    rows = []
    for k, name in enumerate(KINDS):
        n, total, *_ = pairs.ends.get(k, (0, None))
        rows.append((name, n, total / n, (found[k, middle[k][0]] + found[k, middle[k][1]]) / 2) if n else (name, 0, None, None))
    return pairs.left.sparkSession.createDataFrame(rows, "pair_type string, n_pairs long, mean_cosine_distance double, median_cosine_distance double")


def histogram(pairs: Distances, bins: int = 40) -> DataFrame:
    """(pair_type, bin, n, density): equal bins between a class's extremes, the last closed; the density is null where they are equal."""
    known = sorted(pairs.ends)
    rows = pairs.binned([(k, *pairs.ends[k][2:]) for k in known], bins).where("bin >= 0")
    one = F.lit(None).cast("string")
    density = F.lit(None).cast("double")
    for t, k in enumerate(known):
        n, _, lo, hi = pairs.ends[k]
        one = F.when(F.col("target") == t, KINDS[k]).otherwise(one)
        if hi > lo:
            density = F.when(F.col("target") == t, F.col("n") / (n * (hi - lo) / bins)).otherwise(density)
    return rows.select(one.alias("pair_type"), "bin", "n", density.alias("density"))


def mean_by(vectors: DataFrame, key: str) -> DataFrame:
    """(key, pos, mean): element-wise means of the vectors of each key."""
    return vectors.select(key, F.posexplode("v").alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("mean"))


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """(key, v): the means as vectors again."""
    cells = mean_by(vectors, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("c"))
    return cells.select(key, F.col("c.mean").alias("v"))


def standardise(vectors: DataFrame, fit: str) -> DataFrame:
    """(id, pos, z): by mean and population deviation of the rows where ``fit`` holds; a deviation of 0 counts as 1."""
    cells = vectors.select("id", F.expr(fit).alias("fit"), F.posexplode("v").alias("pos", "x"))
    stats = cells.where("fit").groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    s = F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    return cells.join(F.broadcast(stats), "pos").select("id", "pos", ((F.col("x") - F.col("m")) / s).alias("z"))  # a row per dimension


def moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sum and Gram matrix (d, d): each task adds up its rows; tasks' sums are added by matrix row, and d * d numbers return."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                m = np.column_stack([np.ones(len(batch)), np.array(batch["v"].tolist(), dtype=np.float64)])
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "g": list(total)})

    parts = vectors.select("v").mapInPandas(run, "i int, g array<double>")
    sums = parts.select("i", F.posexplode("g").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    d = max((r["i"] for r in sums), default=0) + 1
    m = np.zeros((d, d))
    for r in sums:
        m[r["i"], r["j"]] = r["x"]
    return int(m[0, 0]), m[0, 1:], m[1:, 1:]


def spectrum(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors (columns) of the centred Gram matrix; signs make each column's largest entry positive."""
    n, s, g = moments(vectors)
    values, columns = np.linalg.eigh(g - np.outer(s, s) / max(n, 1))
    values, columns = np.maximum(values[::-1], 0), columns[:, ::-1]
    return values, columns * np.sign(columns[np.abs(columns).argmax(0), range(len(values))])


def pca(vectors: DataFrame, components: int = 50) -> DataFrame:
    """(component, variance_ratio, cumulative, effective_rank) of the first components."""
    values, _ = spectrum(vectors)
    ratio = values / max(values.sum(), 1e-12)
    rank = float(values.sum() ** 2 / max((values**2).sum(), 1e-12))
    rows = [(k + 1, float(r), float(c), rank) for k, (r, c) in enumerate(zip(ratio[:components], np.cumsum(ratio)))]
    return vectors.sparkSession.createDataFrame(rows, "component int, variance_ratio double, cumulative double, effective_rank double")


def project(vectors: DataFrame, components: int = 2) -> DataFrame:
    """(id, component, score): centred vectors on the first components."""
    n, s, _ = moments(vectors)
    _, columns = spectrum(vectors)
    rows = [(k + 1, [float(x) for x in columns[:, k]], float(s @ columns[:, k] / max(n, 1))) for k in range(min(components, columns.shape[1]))]
    axes = vectors.sparkSession.createDataFrame(rows, "component int, axis array<double>, base double")
    from ..functions.vectors import dot

    return vectors.crossJoin(F.broadcast(axes)).select("id", "component", (dot(F.col("v"), F.col("axis")) - F.col("base")).alias("score"))  # an axis each
