"""Mixture-controlled packing: deficit round-robin over source queues fills windows of tokens to target proportions.

Documents are tokenised once and dealt at random, by a hash, into groups of about ``GROUP_TOKENS`` tokens; each group is packed
by one call, so a group's memory is bounded however large the table or a source is. Within a group, every source has a
queue. Each window grants every source its share of the window as credit; sources are served in turn, whole documents
where they fit, and what a source could not use is carried to its next window as a deficit. The deficits with which a
group starts are those that the groups before it leave: tokens due by the target proportions less tokens packed, a
running sum over groups. A group's last tokens, less than a window, are cut at powers of two, so no sequence is padded.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filled_id, stash, true_id

WINDOW = 4096
#: Tokens of a packing group, about; a longer document makes a longer group.
GROUP_TOKENS = 1_000_000
#: A cut leaves no piece shorter than this, except at the end of a document or window.
MIN_PIECE = 256
#: Id after each document.
END = 2
#: What tokens that end a word end by, in tokenizers whose words of ASCII letters have a way of their own; and those tokenizers' steps.
CLOSES = "</w>"
LETTERS_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
LETTERS_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: ASCII signs that, at the end of a word and after a letter, are a token of their own in those tokenizers.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words whose ids a worker remembers; it forgets all of them when there are more.
REMEMBERED = 1_000_000

PIECE = "doc_row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary"


def _latin_letter(sign: str) -> bool:
    """Whether the character is a letter that stays one when normalised, whatever sign of SIGNS follows."""
    return sign <= "\u024f" and sign.isalpha() and sign != "\u0130"


class _WordIds(dict):
    """Ids of a word (UTF-8) as bytes. The tokenizer never joins letters across white space, so a text's ids are those of its words.

    New words are encoded many at a time, joined by spaces, and told apart by offsets; one call for each would cost more than their ids.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        #: Bytes of an id: two are enough for a small vocabulary.
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.letters, self.closing = self._of_letters(), np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        if self.letters:
            self.closing[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(CLOSES)]] = True
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _of_letters(self):
        """The tokenizer without its steps that leave lower-case ASCII letters as they are; None if it has others, or doesn't close words by CLOSES."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        made = json.loads(self.tokenizer.to_str())
        if made["model"]["type"] != "BPE" or made["model"].get("end_of_word_suffix") != CLOSES or made["post_processor"] is not None:
            return None
        if made["normalizer"] != LETTERS_NORMALIZER or made["pre_tokenizer"] != LETTERS_SPLIT:
            return None
        plain = Tokenizer.from_str(json.dumps(made | {"normalizer": None, "pre_tokenizer": None}))
        plain.pre_tokenizer = WhitespaceSplit()
        return plain

    def _learn_letters(self, words: list[bytes]) -> None:
        """Words of ASCII letters, in either case: told apart by the ids that close a word, which costs less than offsets."""
        found = self.letters.encode_batch_fast([b" ".join(words).lower().decode()], add_special_tokens=False)[0].ids
        ids = np.array(found, dtype=f"<u{self.width}")
        cuts = ((np.flatnonzero(self.closing[ids]) + 1) * self.width).tolist()
        if len(cuts) != len(words):
            raise RuntimeError(f"{len(words)} words gave {len(cuts)} closing ids")
        ids = ids.tobytes()
        self.update((w, ids[i:j]) for w, i, j in zip(words, [0, *cuts], cuts))

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=f"<u{self.width}")

    def learn(self, words: set[bytes]) -> None:
        if len(self) + len(words) > REMEMBERED:
            self.clear()
        new = [w for w in words if w not in self]
        marked = b" ".join(new)
        marks = [m for m in self.marks if m in marked]
        if self.letters and not marks:
            ends = {w: core for w in new if (core := w.rstrip(SIGNS)) != w and core and _latin_letter(core.decode()[-1])}
            parts = set(ends.values()).union([w[len(core) :] for w, core in ends.items()], [w for w in new if w not in ends])
            new = [w for w in parts if w not in self]
            if plain := [w for w in new if w.isalpha()]:  # of bytes: ASCII letters only
                self._learn_letters(plain)
            self._learn_offsets([w for w in new if not w.isalpha()], [])
            self.update((w, self[core] + self[w[len(core) :]]) for w, core in ends.items())
        else:
            self._learn_offsets(new, marks)

    def _learn_offsets(self, new: list[bytes], marks: list[bytes]) -> None:
        alone = [w for w in new if any(m in w for m in marks)] if marks else []
        self.update((w, self.encode(w.decode()).tobytes()) for w in alone)
        plain = [w for w in new if w not in self] if alone else new
        if not plain:
            return
        joined = b" ".join(plain).decode()
        found = self.tokenizer.encode(joined, add_special_tokens=False)
        ids = np.array(found.ids, dtype=f"<u{self.width}").tobytes()
        starts = np.array([o[0] for o in found.offsets], dtype=np.int64)
        spaces = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), "<u4") == 32)
        cuts = (np.searchsorted(starts, spaces) * self.width).tolist()
        self.update((w, ids[i:j]) for w, i, j in zip(plain, [0, *cuts], [*cuts, len(ids)]))


_IDS: dict[str, _WordIds] = {}


def word_ids(tokenizer_path: str) -> _WordIds:
    """The worker process's words, which serve all its tasks."""
    if tokenizer_path not in _IDS:
        _IDS[tokenizer_path] = _WordIds(tokenizer_path)
    return _IDS[tokenizer_path]


def token_ids(known: _WordIds, texts: list[str | None]) -> list[bytes]:
    """The ids of the whole texts, each with the closing id, ``known.width`` bytes each, little-endian. bytes.split() splits at the contract's white space."""
    words = [t.encode().split() if t else [] for t in texts]
    known.learn(set().union(*words))
    end = END.to_bytes(known.width, "little")
    return [b"".join(map(known.__getitem__, w)) + end for w in words]


def tokenised(docs: DataFrame, tokenizer_path: str, at_once: int = 256) -> DataFrame:
    """(doc_row, doc_id, source, doc_tokens, ids): written once, so later passes read the same rows in the same order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = word_ids(tokenizer_path)
        for batch in batches:
            for k in range(0, len(batch), at_once):
                out = batch.iloc[k : k + at_once][["doc_id", "source"]].copy()
                ids = token_ids(known, [t if isinstance(t, str) else None for t in batch["text"].iloc[k : k + at_once]])
                out["doc_tokens"] = [len(x) // known.width for x in ids]
                out["ids"] = ids
                out["width"] = known.width
                yield out

    cols = docs.select(filled_id("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    out = cols.mapInPandas(run, "doc_id long, source string, doc_tokens long, ids binary, width long")
    return stash(out.withColumn("doc_row", F.monotonically_increasing_id()), "tokens")


def _power(n: int) -> int:
    return 1 << (n.bit_length() - 1)


class _Queue:
    """Documents of one source, cut from the front."""

    def __init__(self):
        self.docs, self.start, self.left = deque(), 0, 0

    def add(self, doc: int, tokens: int) -> None:
        self.docs.append((doc, tokens))
        self.left += tokens

    def take(self, most: int) -> tuple[int, int, int]:
        """(doc, start, length) of the next piece, of at most ``most`` tokens."""
        doc, tokens = self.docs[0]
        start, length = self.start, min(most, tokens - self.start)
        self.left -= length
        if start + length == tokens:
            self.docs.popleft()
            self.start = 0
        else:
            self.start += length
        return doc, start, length


def round_robin(lengths: list[int], sources: list[str], shares: dict[str, float], deficits: dict[str, float], window: int = WINDOW, min_piece: int = MIN_PIECE) -> Iterator[tuple[int, int, int, int, int]]:
    """(doc, start, length, sequence, offset) for documents given by length and source; ``deficits`` is carried on.

    A source is served while its credit covers a whole document or at least ``min_piece`` tokens; when no source has that much, the
    source with the largest credit fills the rest of the window, and goes into debt for it.
    """
    queues: dict[str, _Queue] = {}
    for doc, (n, s) in enumerate(zip(lengths, sources)):
        queues.setdefault(s, _Queue()).add(doc, n)
    total, sequence = sum(lengths), 0
    order = sorted(queues)
    while total:
        size = window if total >= window else _power(total)
        for s in shares:
            deficits[s] = deficits.get(s, 0.0) + size * shares[s]
        offset = 0
        while offset < size:
            served = False
            for s in order:
                q, room = queues[s], size - offset
                if not q.left or not room:
                    continue
                rest = q.docs[0][1] - q.start
                most = min(room, rest, int(deficits.get(s, 0.0)))
                if most > 0 and (most == rest or most >= min_piece):
                    doc, start, length = q.take(most)
                    yield doc, start, length, sequence, offset
                    offset += length
                    deficits[s] -= length
                    served = True
            if not served and offset < size:
                s = max((x for x in order if queues[x].left), key=lambda x: deficits.get(x, 0.0))
                doc, start, length = queues[s].take(min(size - offset, max(min_piece, int(deficits.get(s, 0.0)))))
                yield doc, start, length, sequence, offset
                offset += length
                deficits[s] = deficits.get(s, 0.0) - length
        total -= size
        sequence += 1
        order = order[1:] + order[:1]


def proportions(tokens: DataFrame) -> DataFrame:
    """(source_key, share): each source's share of all tokens, which makes all queues end together."""
    sums = tokens.groupBy("source_key").agg(F.sum("doc_tokens").alias("n"))
    return sums.select("source_key", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, shares: DataFrame | None = None, group_tokens: int = GROUP_TOKENS, min_piece: int = MIN_PIECE, with_ids: bool = True) -> DataFrame:
    """One row per piece: (doc_row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids).

    ``ids`` are the piece's ids, unsigned 32-bit little-endian (null without ``with_ids``); a sequence is its pieces by offset. ``shares`` (source_key,
    share) sets other target proportions; every token is packed all the same, at the target while all sources last. A null or
    empty text is its closing id alone; null sources are a source of their own; repeated and null ids are told apart by
    doc_row. Texts of any length are packed whole. Empty table: empty result. Further columns are ignored.
    """
    rows = tokenised(docs, tokenizer_path).withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    light = rows.select("doc_row", "source_key", "doc_tokens")
    total = light.agg(F.sum("doc_tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    group = F.pmod(F.xxhash64("doc_row"), F.lit(groups))
    share = stash(shares if shares is not None else proportions(light), "shares")
    # Deficits at a group's start: due by the shares of all tokens packed before it, less the source's own.
    held = stash(light.groupBy(group.alias("g"), "source_key").agg(F.sum("doc_tokens").alias("n")), "group-tokens")
    before = Window.partitionBy("source_key").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    start = held.withColumn("own_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = _running(held.groupBy("g").agg(F.sum("n").alias("n")), groups)
    start = start.join(sums, "g").join(share, "source_key", "left")
    start = start.withColumn("share", F.coalesce("share", F.lit(0.0)))
    start = start.groupBy("g").agg(F.collect_list(F.struct("source_key", "share", (F.col("share") * F.col("all_before") - F.col("own_before")).alias("deficit"))).alias("start"))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("doc_row", ignore_index=True)
        at = right["start"].iloc[0]
        given = {x["source_key"]: float(x["share"]) for x in at}
        deficits = {x["source_key"]: float(x["deficit"]) for x in at}
        out = []
        docs = list(left[["doc_row", "doc_id", "doc_tokens", "source", "ids", "width"]].itertuples(index=False, name=None))
        for doc, begin, length, sequence, offset in round_robin(left["doc_tokens"].tolist(), left["source_key"].tolist(), given, deficits, window, min_piece):
            row, doc_id, n, source, ids, width = docs[doc]
            piece = np.frombuffer(ids, f"<u{width}")[begin : begin + length].astype("<u4").tobytes()
            out.append((row, doc_id, begin, length, zlib.crc32(piece), n, (int(key[0]) << 32) + sequence, offset, source, piece if with_ids else None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in PIECE.split(", ")])

    dealt = rows.withColumn("g", group)
    return dealt.groupBy("g").cogroup(start.groupBy("g")).applyInPandas(run, PIECE).withColumn("doc_id", true_id("doc_id"))


def _running(sums: DataFrame, groups: int, wide: int = 1024) -> DataFrame:
    """(g, all_before): the sum of n over smaller g. In two steps, so that no task sees more than max(wide, groups / wide) rows."""
    own = sums.withColumn("block", F.floor(F.col("g") / wide))
    blocks = own.groupBy("block").agg(F.sum("n").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("block").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("in_block", F.coalesce(F.sum("n").over(within), F.lit(0))).join(blocks, "block").select("g", (F.col("base") + F.col("in_block")).alias("all_before"))
