"""Quality rules: statistics of each text, and the frequency of its lines across the documents of its host.

Lines are normalised and hashed; for every host the number of distinct documents that hold a line is counted over all
documents. A line above its host's limit is boilerplate and is removed; a document that loses most of its words this
way is depleted and rejected, as is one that fails the base rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import SPACE, filled_id, stash, true_id

WORD = re.compile(rf"[^{SPACE}]+")
SYMBOLS = str.maketrans("", "", "#*$%&|<>")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Production limits: a line is boilerplate if more than MIN_DOCS documents of its host, and more than SHARE of them, hold it.
MIN_DOCS, SHARE = 10, 0.10
#: A document is depleted if boilerplate holds more than this share of its words.
DEPLETED = 0.5


def _repeat_words(words: list[str], window: int = 5) -> int:
    """Words covered by windows of ``window`` words that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    codes = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int64, len(words))
    if len(ids) == len(words):
        return 0
    width = len(ids)
    code, size = codes, width
    for k in range(1, window):  # exact: renumbered before a code could overflow
        if size * width >= 2**62:
            code = np.unique(code, return_inverse=True)[1]
            size = len(code)
        code = code[: len(words) - k] * width + codes[k:]
        size *= width
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[:n] += twice
    edges[window : window + n] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


def line_key(line: str) -> str:
    """The normalised line: A-Z lower-cased, digits as 0, words joined by one space."""
    return re.sub("[0-9]", "0", " ".join(WORD.findall(line)).translate(LOWER))


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            text = text if isinstance(text, str) else ""
            words = WORD.findall(text)
            seen, dup, keys, sizes = set(), 0, [], []
            for line in text.split("\n"):
                own = WORD.findall(line)
                if not own:
                    continue
                dup += line in seen
                seen.add(line)
                key = re.sub("[0-9]", "0", " ".join(own).translate(LOWER))
                keys.append(xxhash.xxh3_64_intdigest(key) - 2**63)
                sizes.append(len(own))
            code = xxhash.xxh3_64_intdigest(text) - 2**63
            rows.append((len(words), sum(map(len, words)), len(text) - len(text.translate(SYMBOLS)), dup, _repeat_words(words), code, keys, sizes))
        out = pd.DataFrame(rows, columns=[*STATS, "text_key", "line_keys", "line_words"])
        yield pd.concat([batch[["doc_id", "host", "t"]].reset_index(drop=True), out], axis=1)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, most: int = 200_000) -> DataFrame:
    """``right`` is broadcast only if it has been counted to at most ``most`` rows; else the join is shuffled, and AQE splits its hot keys."""
    return left.join(F.broadcast(right) if right.count() <= most else right, on, how)


def boilerplate_lines(stats: DataFrame, min_docs: int, share: float, by_text: bool = False) -> DataFrame:
    """(host, line) of the lines that more than ``min_docs`` documents and more than ``share`` of a host's documents hold; ``by_text``: of its distinct texts."""
    if by_text:  # equal texts have equal lines
        stats = stats.groupBy("host", "text_key").agg(F.first("line_keys").alias("line_keys"))
    held = stats.select("host", F.explode(F.array_distinct("line_keys")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    frequent = stash(held.where(F.col("docs") > min_docs), "frequent-lines")
    over = _join_small(frequent, stash(hosts, "hosts"), ["host"], "inner").where(F.col("docs") > share * F.col("host_docs"))
    return stash(over.select("host", "line"), "boilerplate")


def _host() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED, by_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, the five statistics, boilerplate_words, base_failed, kept.

    A null text has no words, and fails the base rules; null sources form a host of their own. Repeated rows count as
    documents of their own, as in the query's SQL; ``by_text`` counts equal texts of a host once, so that copies don't make their own lines
    boilerplate. Texts are read whole, whatever their length. Further columns are ignored; an empty table
    gives an empty result. ``boilerplate_keys`` lists the hashes of the lines to be removed; ``row_key`` is the
    row's id, filled, with a hash of its text and its host.
    """
    cols = docs.select(filled_id("doc_id"), _host().alias("host"), F.col("text").cast("string").alias("text"))
    cols = cols.withColumn("t", F.xxhash64("text"))
    schema = "doc_id long, host string, t long, " + ", ".join(f"{c} long" for c in STATS) + ", text_key long, line_keys array<long>, line_words array<long>"
    stats = cols.mapInPandas(_measure, schema)
    stats = stash(stats.withColumn("row", F.monotonically_increasing_id()), "text-stats")
    over = boilerplate_lines(stats, min_docs, share, by_text)
    lines = stats.select("row", "host", F.explode(F.arrays_zip("line_keys", "line_words")).alias("x"))
    lines = lines.select("row", "host", F.col("x.line_keys").alias("line"), F.col("x.line_words").alias("words"))
    lost = _join_small(lines, over, ["host", "line"], "inner").groupBy("row").agg(F.sum("words").alias("boilerplate_words"), F.collect_set("line").alias("boilerplate_keys"))
    out = stats.join(lost, "row", "left")
    gone = F.coalesce("boilerplate_words", F.lit(0).cast("long"))
    return out.select(
        true_id("doc_id").alias("doc_id"),
        *STATS,
        gone.alias("boilerplate_words"),
        base_failed().alias("base_failed"),
        (~base_failed() & (gone <= depleted * F.col("n_words"))).alias("kept"),
        F.coalesce("boilerplate_keys", F.array().cast("array<long>")).alias("boilerplate_keys"),
        F.struct("doc_id", "t", "host").alias("row_key"),
    )


@F.pandas_udf(StringType())
def _without_lines(text: pd.Series, keys: pd.Series) -> pd.Series:
    out = []
    for t, gone in zip(text, keys):
        if t is not None and gone is not None and len(gone):
            gone = set(int(k) for k in gone)
            t = "\n".join(x for x in t.split("\n") if not WORD.search(x) or xxhash.xxh3_64_intdigest(line_key(x)) - 2**63 not in gone)
        out.append(t)
    return pd.Series(out, dtype=object)


def apply_quality_rules(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that the rules keep, with boilerplate lines removed from their texts and n_chars renewed.

    Equal texts of a host count once as holders of their lines: a group of copies is left for later stages to keep one of.
    Columns and types are those of ``docs``. Verdicts are found again by id, text and host, so rows with null or repeated ids have their own.
    """
    verdicts = quality_rules(docs, **{"by_text": True} | limits).where("kept").select("row_key.*", "boilerplate_keys")
    verdicts = verdicts.groupBy(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "t", "host")]).agg(F.first("boilerplate_keys").alias("__gone"))
    keyed = docs.withColumns({"__doc_id": filled_id("doc_id"), "__t": F.xxhash64(F.col("text").cast("string")), "__host": _host()})
    kept = keyed.join(verdicts, ["__doc_id", "__t", "__host"])
    kept = kept.withColumn("text", F.when(F.size("__gone") > 0, _without_lines("text", "__gone")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)
