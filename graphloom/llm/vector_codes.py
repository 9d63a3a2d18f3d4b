"""Vector code compression: vectors are cut into parts, and each part is replaced by the nearest entry of its position's codebook.

Components become integers, so equal parts are frequent: each position's distinct parts are counted once, weighted Lloyd rounds and the final
assignment run over these rows alone, and codes and errors are joined back to the vectors. Sums are of integers, so results are exact and don't
depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

#: Parts of a vector, entries of a codebook, rounds, and integer steps of 1.
PARTS, ENTRIES, ROUNDS, STEPS = 16, 64, 2, 256
#: Components are held within this, beyond which doubles have no fraction anyway.
BOUND = 1 << 62
#: A part or label that more than one row in so many has is joined by broadcast; so there are at most so many of each position.
HOT = 1000
MAX_LONG = (1 << 63) - 1

Books = list[list[list[int]]]


def cells(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q): the vectors that are whole and finite, in integers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), x.cast("double") * STEPS)))
    return vectors.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long"), "label", F.transform("embedding", scaled).alias("q"))


def _parts(q: Column, width: int) -> Column:
    """The parts of a vector, which zeros lengthen to PARTS * width."""
    full = F.concat(q, F.array_repeat(F.lit(0).cast("byte"), F.lit(PARTS * width) - F.size(q)))
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.slice(full, k * width + 1, F.lit(width)))


def distinct_parts(rows: DataFrame, width: int) -> DataFrame:
    """(pos, part, n): each position's different parts, and how many vectors have them."""
    return rows.select(F.posexplode(_parts(F.col("q"), width)).alias("pos", "part")).groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n"))


def first_books(rows: DataFrame, width: int) -> Books:
    """The parts of the first vectors by id (null ids last; equal ids by components)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).select(_parts(F.col("q"), width).alias("p")).collect()
    return [[list(r["p"][pos]) for r in first] for pos in range(PARTS)]


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower of equally near ones, and squared distance. Both hold integers."""
    top = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    if parts.shape[1] * 4 * top * top < 1 << 52:  # doubles are exact
        x, c = parts.astype(np.float64), book.astype(np.float64)
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]
    else:
        x, c = parts.astype(object), book.astype(object)
        d = np.stack([((x - e) ** 2).sum(1) for e in c], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at]


def _by_position(batch: pd.DataFrame, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(position, its rows, their parts, codes, distances)."""
    for pos, at in batch.groupby("pos").indices.items():
        parts = np.stack(batch["part"].to_numpy()[at]).astype(np.int64)
        yield pos, at, parts, *nearest(parts, books[pos])


def lloyd_round(distinct: DataFrame, books: Books) -> Books:
    """Codebooks whose entries are the floors of their parts' weighted means; entries without parts stay.

    Each task adds up its rows by entry and component; the sums, whose number is that of the codebooks' components, come back.
    """
    arrays = [np.array(b, dtype=np.int64) for b in books]
    entries, width = arrays[0].shape

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for pos, at, parts, codes, _ in _by_position(batch, arrays):
                n = batch["n"].to_numpy()[at]
                wide = np.column_stack([n, parts * n[:, None] if int(np.abs(parts).max(initial=0)) * int(n.sum()) < 1 << 62 else parts.astype(object) * n[:, None]])
                sums = total.setdefault(pos, np.zeros((entries, width + 1), dtype=object))
                order = np.argsort(codes, kind="stable")
                used, starts = np.unique(codes[order], return_index=True)
                sums[used] += np.add.reduceat(wide[order], starts).astype(object)
        rows = [(pos, e, k, str(s[e, k])) for pos, s in total.items() for e in range(entries) if s[e, 0] for k in range(width + 1)]
        yield pd.DataFrame(rows, columns=["pos", "entry", "k", "s"])

    out = distinct.mapInPandas(add, "pos int, entry int, k int, s string").groupBy("pos", "entry", "k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {(r["pos"], r["entry"], r["k"]): int(r["s"]) for r in out.collect()}
    return [[[found[p, e, k + 1] // found[p, e, 0] for k in range(width)] if (p, e, 0) in found else old for e, old in enumerate(book)] for p, book in enumerate(books)]


def assigned(distinct: DataFrame, books: Books) -> DataFrame:
    """(pos, part, n, code, error) of the distinct parts."""
    arrays = [np.array(b, dtype=np.int64) for b in books]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            code, error = np.zeros(len(batch), np.int32), np.zeros(len(batch), object)
            for _, at, _, codes, d in _by_position(batch, arrays):
                code[at], error[at] = codes, [min(int(x), MAX_LONG) for x in d]
            yield batch.assign(code=code, error=error.astype(np.int64))

    return distinct.mapInPandas(run, f"pos int, part {distinct.schema['part'].dataType.simpleString()}, n long, code int, error long")


def digest(books: Books) -> str:
    """Of all components as decimal numbers, by part, entry and position within the part."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def join_weighted(rows: DataFrame, unique: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with the columns of ``unique``, a written table with a row per key and the number ``n`` of rows that have it; nulls match nulls.

    Keys that more than one row in HOT has are few by their weight, and are joined by broadcast; so a key of the shuffled join is held by no more rows than that.
    """
    unique = unique.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    often = F.col("n") * HOT > total
    hot = F.broadcast(unique.where(often))
    near = rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(unique.where(~often), same))
    return near.drop("n", *[f"__{k}" for k in keys])


def _limited(total: Column) -> Column:
    return F.least(total, F.lit(MAX_LONG).cast("decimal(38,0)")).cast("long")


def compress(vectors: DataFrame) -> tuple[DataFrame, Books]:
    """(vec_id, label, code, error, label_error) for each vector that is whole and finite, and the codebooks.

    ``vectors``: (vec_id, embedding, label); further columns are ignored. Rows whose vector is null or has a null, NaN or infinite component go;
    repeated rows are kept, each with its result; null ids sort last and null labels are one label. Vectors shorter than the longest, or than a
    multiple of the number of parts, are lengthened with zeros, empty ones too. With fewer vectors than entries, codebooks are shorter. Components
    beyond 2^62 steps count as that, errors beyond 64 bits as the largest number. An empty table, or one without a whole vector, gives no rows and no codebooks.
    """
    written = stash(cells(vectors).withColumn("row", F.monotonically_increasing_id()), "cells")
    total, longest, least, most = written.agg(F.count(F.lit(1)), F.max(F.size("q")), F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    kind = next((k for k, b in (("smallint", 15), ("int", 31)) if -(1 << b) <= (least or 0) and (most or 0) < 1 << b), "bigint")
    kept = written.withColumn("q", F.col("q").cast(f"array<{kind}>"))  # parts are shuffled as small as they are
    if not total:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    width = max(1, -(-longest // PARTS))
    distinct = stash(distinct_parts(kept, width), "parts")
    books = first_books(kept, width)
    for _ in range(ROUNDS):
        books = lloyd_round(distinct, books)
    coded = stash(assigned(distinct, books), "codes")
    rows = kept.select("row", "vec_id", "label", F.posexplode(_parts(F.col("q"), width)).alias("pos", "part"))
    joined = join_weighted(rows, coded, ["pos", "part"], total)
    # Codes are put into whole numbers of eight bytes, so that the sums by vector need no lists.
    words = [F.bit_or(F.when(F.floor(F.col("pos") / 8) == w, F.call_function("shiftleft", F.col("code").cast("long"), (7 - F.col("pos") % 8) * 8)).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(PARTS // 8)]
    whole = joined.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), *words, _limited(F.sum(F.col("error").cast("decimal(38,0)"))).alias("error"))
    code = F.lower(F.concat(*[F.lpad(F.hex(f"w{w}"), 16, "0") for w in range(PARTS // 8)]))
    out = stash(whole.select("vec_id", "label", code.alias("code"), "error"), "vector-codes")
    discard(distinct, coded, written)
    by_label = stash(out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), _limited(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")), "label-errors")
    return join_weighted(out, by_label, ["label"], total).select("vec_id", "label", "code", "error", "label_error"), books


def vector_codes(vectors: DataFrame) -> DataFrame:
    """``compress`` with codebooks_sha256, the digest of the final codebooks, in each row."""
    out, books = compress(vectors)
    return out.withColumn("codebooks_sha256", F.lit(digest(books)))
