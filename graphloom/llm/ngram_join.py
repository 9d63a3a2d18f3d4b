"""Exact Jaccard self-join of documents on word shingles, with set-relation skipping.

1. Every document becomes a set of shingle hashes; equal sets are one set from then on. A count sketch of all shingles of all
   documents is summed over the tasks; it only sets the order of shingles, rare ones first, so any error in it costs time,
   never a link.
2. A set's prefix in that order is its index entries (shingle, set, position, size): two sets that link share one.
3. First round: each index list has one leading set, the one with the shingle at the lowest position, the likeliest centre of
   a group of copies. It is compared with the list's other sets, never all with all; the index is skipped wherever sizes
   and positions rule a link out. Sets that link to a leader have their answer from it: they are in its group.
4. Second round: within lists whose sets are in different groups after that, pairs from different groups are compared, list
   blocks (sets of one size, position and group) that can't link being skipped as a whole. Pairs of one group need no comparison.
   So no link between sets of different groups is lost, and the groups are those of the full join.

Pairs that the counts of their shingles by hash rule out are dropped; comparisons of the others read whole texts. While one leader's pairs are verified in turn, the overlap with the next set is derived from the
computed overlap with a highly similar set before, by the shingles in which the two differ.

Shingles and sets are known by 64-bit hashes, sets by their size as well.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, components, discard, stash
from .quality_rules import _join_small

#: The sketch has 2 ** SKETCH_BITS counters, whatever the input's size; they are collected in BLOCKS parts.
SKETCH_BITS, BLOCKS = 20, 64
#: A set's shingles are counted in 2 ** CELL_BITS cells; two sets share at most the smaller count of each.
CELL_BITS = 6
#: Documents whose identifiers may be broadcast when texts are looked up; beyond that, texts are shuffled.
BROADCAST_IDS = 500_000


class Shingler:
    """Sorted distinct shingle hashes of a text.

    A word's hash is a polynomial over its bytes, read off running sums over the whole text, so no word becomes a Python object.
    """

    def __init__(self, n: int):
        self.n = n
        self.bytes = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        """Powers of BASE and of its inverse modulo 2 ** 64, for texts of up to ``n`` bytes."""
        while len(self.power) < n:
            k = len(self.power)
            self.power = np.concatenate([self.power, self.power * np.uint64(pow(BASE, k, 1 << 64))])
            self.inverse = np.concatenate([self.inverse, self.inverse * np.uint64(pow(BASE, -k, 1 << 64))])

    def words(self, text: str) -> np.ndarray:
        """Hashes of the words, A-Z lower-cased."""
        raw = np.frombuffer(text.encode().lower(), np.uint8)
        self._powers(len(raw))
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~IS_SPACE[raw]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.bytes[raw] * self.power[: len(raw)], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * self.inverse[starts])

    def __call__(self, text: str | None) -> np.ndarray:
        codes = self.words(text) if text else np.empty(0, np.uint64)
        if not len(codes):
            return codes
        width = min(self.n, len(codes))  # a text of fewer words is one shingle
        m = len(codes) - width + 1
        out = np.full(m, width, np.uint64)
        for k in range(width):
            out = _mixed(out + codes[k : k + m])
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


BASE = 0x9E3779B97F4A7C15
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def measured(docs: DataFrame, n: int) -> DataFrame:
    """Two kinds of rows, by one pass over the texts: (d, t, size, set, cells) of each document, and parts (block, part) of the sketch of each task.

    d and t, the id and a hash of the text, stand for the document. ``cells`` counts a set's shingles by the first bits of their hashes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, sketch = Shingler(n), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            sets = [shingles(t if isinstance(t, str) else None) for t in batch["text"]]
            if sets:
                sketch += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            out = batch[["d", "t"]].copy()
            yield out.assign(size=[len(x) for x in sets], set=[_set_id(x) for x in sets], cells=[np.bincount((x >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS).astype(np.int32) for x in sets], block=pd.array([None] * len(out), "Int32"), part=None)
        parts = [(k, zlib.compress(x.astype("<i8").tobytes(), 1)) for k, x in enumerate(np.split(sketch, BLOCKS)) if x.any()]
        made = pd.DataFrame(parts, columns=["block", "part"])
        none = pd.array([None] * len(made), "Int64")
        yield made.assign(d=none, t=none, size=none, set=none, cells=None)[["d", "t", "size", "set", "cells", "block", "part"]]

    return stash(docs.select("d", "t", "text").mapInPandas(run, "d long, t long, size long, set long, cells array<int>, block int, part binary"), "sets")


def summed_sketch(rows: DataFrame, fan: int = 64) -> np.ndarray:
    """The tasks' sketches, added by block in two steps and collected: 8 * 2 ** SKETCH_BITS bytes at any scale."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in pdf["part"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [zlib.compress(total.astype("<i8").tobytes(), 1)]})

    parts = rows.where("part is not null").select("block", "part")
    salted = parts.groupBy("block", F.pmod(F.xxhash64("part"), F.lit(fan)).alias("salt"))
    parts = salted.applyInPandas(add, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary")
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    width = len(out) // BLOCKS
    for r in parts.collect():
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(zlib.decompress(bytes(r["part"])), "<i8")
    return out


def index_entries(docs: DataFrame, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(token, set, pos, size): the prefix of each set, once per task and set."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, seen, counts = Shingler(n), set(), shared.value
        for batch in batches:
            tokens, sets, lengths, sizes = [], [], [], []
            for text in batch["text"]:
                own = shingles(text if isinstance(text, str) else None)
                key = _set_id(own)
                if not len(own) or key in seen:
                    continue
                seen.add(key)
                prefix = len(own) - -(-percent * len(own) // 100) + 1
                order = np.lexsort((own, counts[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:prefix]
                tokens.append(own[order])
                sets.append(key)
                lengths.append(len(order))
                sizes.append(len(own))
            if tokens:
                pos = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
                yield pd.DataFrame({"token": _signed(np.concatenate(tokens)), "set": np.repeat(np.array(sets, np.int64), lengths), "pos": pos, "size": np.repeat(np.array(sizes, np.int32), lengths)})

    return docs.select("text").mapInPandas(run, "token long, set long, pos int, size int")


def _may_link(percent: int, size_a: str, pos_a: str, size_b: str, pos_b: str) -> Column:
    """No link is possible where this is false and the token is the first that both prefixes hold: sizes too different, or too few shingles left."""
    a, b = F.col(size_a), F.col(size_b)
    sizes = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    left = F.least(a - F.col(pos_a), b - F.col(pos_b))
    return sizes & ((100 + percent) * left >= percent * (a + b))


def _within_bound(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that can link by the counts of their cells: an exact bound, which spares most of the others the reading of their texts."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("set").alias(side), F.col("size").alias(f"size_{side}"), F.col("cells").alias(f"cells_{side}")), side)
    most = F.aggregate(F.zip_with("cells_a", "cells_b", lambda a, b: F.least(a, b)), F.lit(0), lambda total, x: total + x)
    return pairs.where(100 * most >= percent * (F.col("size_a") + F.col("size_b") - most)).select("a", "b")


def links(overlap: int, size_a: int, size_b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that link. ``texts`` (set, text) has a text of each set."""
    with_b = pairs.join(texts.select(F.col("set").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("set").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(n)
        held, lead, before, overlap = None, None, None, 0
        for batch in batches:
            out = []
            for a, b, text_a, text_b in batch[["a", "b", "text_a", "text_b"]].itertuples(index=False, name=None):
                if a != held:
                    held, lead, before = a, set(shingles(text_a).tolist()), None
                own = set(shingles(text_b).tolist())
                if before is not None and len(own ^ before) * 4 < len(own):  # derived from the answer before
                    overlap += len((own - before) & lead) - len((before - own) & lead)
                else:
                    overlap = len(own & lead)
                before = own
                if links(overlap, len(lead), len(own), percent):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return both.mapInPandas(run, "a long, b long")


def _keyed(docs: DataFrame, d: str, t: str) -> DataFrame:
    """``docs`` with the id, filled, and a hash of the text: a row's key, which null and repeated ids don't blur."""
    return docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), t: F.xxhash64(F.col("text").cast("string"))})


def _grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(d, t, n_shingles, n_links, component, component_id) of every row of ``docs``; ``component`` is null without words."""
    docs = _keyed(docs, "d", "t").select("d", "t", F.col("text").cast("string").alias("text"))
    rows = measured(docs, n)
    own = rows.where("part is null").select("d", "t", "size", "set", "cells")
    first = F.min(F.struct("d", "t"))
    sets = own.where("size > 0").groupBy("set", "size").agg(first.alias("first"), F.min(F.nullif("d", F.lit(NO_ID))).alias("first_doc"), F.first("cells").alias("cells"))
    sets = stash(sets, "distinct-sets")
    entries = stash(index_entries(docs, n, percent, summed_sketch(rows)), "entries")

    many = entries.groupBy("token").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo <> hi").select("token")
    met = stash(entries.join(many, "token", "left_semi").distinct(), "shared-entries")
    lead = met.groupBy("token").agg(F.min(F.struct("pos", "set", "size")).alias("lead"))
    shared = stash(met.join(lead, "token"), "led-entries")
    discard(entries, met)

    def texts_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct().join(sets, "set")
        ids = stash(ids.select("set", "first.*"), "compared-sets")
        return stash(_join_small(docs.where("text is not null"), ids, ["d", "t"], "inner", BROADCAST_IDS).select("set", "text").dropDuplicates(["set"]), "compared-texts")

    def compare(pairs: DataFrame) -> DataFrame:
        pairs = stash(_within_bound(pairs.distinct(), sets, percent), "pairs")
        texts = texts_of(pairs)
        out = stash(verified(pairs, texts, n, percent), "links")
        discard(pairs, texts)
        return out

    first = shared.select("token", "set", "pos", "size", F.col("lead.set").alias("lead_set"), F.col("lead.pos").alias("lead_pos"), F.col("lead.size").alias("lead_size")).where("set <> lead_set")
    first = first.where(_may_link(percent, "size", "pos", "lead_size", "lead_pos"))
    found = compare(first.select(F.col("lead_set").alias("a"), F.col("set").alias("b")))
    group = components(found)

    rest = shared.join(group.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    many = rest.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    rest = stash(rest.join(many, "token").select("token", "component", "size", "pos", "set", F.col("lead.set").alias("lead_set")), "open-entries")
    blocks = rest.select("token", "component", "size", "pos").distinct()
    x = blocks.select("token", *[F.col(c).alias(f"{c}_x") for c in ("component", "size", "pos")])
    y = blocks.select("token", *[F.col(c).alias(f"{c}_y") for c in ("component", "size", "pos")])
    met = x.join(y, "token").where((F.col("component_x") < F.col("component_y")) & _may_link(percent, "size_x", "pos_x", "size_y", "pos_y"))
    for side in ("x", "y"):
        entry = rest.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("component", "size", "pos", "set")], F.col("lead_set").alias(f"lead_{side}"))
        met = met.join(entry, ["token", *[f"{c}_{side}" for c in ("component", "size", "pos")]])
    apart = met.where("set_x <> lead_x and set_y <> lead_y")  # a list's leader has been compared
    apart = apart.select(F.least("set_x", "set_y").alias("a"), F.greatest("set_x", "set_y").alias("b"))
    more = compare(apart)
    found = stash(found.union(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "all-links")
    group = stash(components(found), "groups")

    ends = found.select(F.col("a").alias("set")).union(found.select(F.col("b").alias("set"))).groupBy("set").agg(F.count(F.lit(1)).alias("n_links"))
    labelled = sets.drop("cells", "first").join(group.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set")).join(ends, "set", "left")
    labelled = stash(labelled, "labelled")
    smallest = labelled.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    answer = labelled.join(smallest, "component").select("set", "size", "component", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = stash(own.drop("cells").join(answer, ["set", "size"], "left"), "answers")
    discard(rows, sets, shared, rest, found, group, labelled)
    doc_id = F.nullif("d", F.lit(NO_ID))
    return out.select("d", "t", F.col("size").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component", F.coalesce("component_id", doc_id).alias("component_id"))


def similar_groups(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, n_shingles, n_links, component_id).

    Documents link when 100 * intersection >= percent * union of their sets of word n-grams (words after A-Z are lower-cased; a text
    of fewer words is one shingle). component_id is the smallest doc_id that links lead to. Null or empty texts, and texts without
    words, have the empty set and link with nothing. n_links counts the verified links to other sets, not those that the
    group's leaders made needless. Rows with a null id link like others; their group's id is the smallest other one, or null.
    Rows that share an id are documents of their own, each with its text. Repeated rows have equal sets, and so are in one group.
    Empty table: empty result. Further columns are ignored.
    """
    out = _grouped(docs, n, percent)
    return out.select(F.nullif("d", F.lit(NO_ID)).alias("doc_id"), "n_shingles", "n_links", "component_id")


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Of each group the document with the smallest doc_id, null ids last; columns are those of ``docs``. Documents without words stay.

    Rows that agree in id and text all stay if one of them does, since no column tells them apart.
    """
    rows = _grouped(docs, n, percent)
    best = rows.where("component is not null").groupBy("component").agg(F.min(F.struct((F.col("d") == NO_ID).alias("none"), "d", "t")).alias("best"))
    kept = best.select("best.d", "best.t").union(rows.where("component is null").select("d", "t")).distinct()
    kept = kept.select(F.col("d").alias("__d"), F.col("t").alias("__t"))
    return _keyed(docs, "__d", "__t").join(kept, ["__d", "__t"], "left_semi").select(*docs.columns)
