"""Periodic runs of words: stretches that repeat with a smallest period, found with a suffix automaton.

A square (a piece of text standing twice in a row) shows in the automaton as two neighbouring end positions of a state that lie no further
apart than the state is long. The ordered sets of end positions are merged from small to large up the suffix links, each new pair of
neighbours is looked at once, and every square found is extended to the run around it.

The automaton reads only where a run can be. In a run of period q and at least 4 * q words, all but the first q words (grams of four words,
from period 4 on) stand at most q places after their last equal one, so periods are searched by octave, each only in stretches of such
places that are long enough, in blocks that overlap by two periods. This is a necessary condition: it loses no run, and memory depends on
the largest period, not on the text.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words of a gram in the search for stretches, words of a block at least, and words of the documents that are looked at together.
GRAM, BLOCK, TOGETHER = 4, 512, 200_000

Run = tuple[int, int, int]


class Automaton:
    """The suffix automaton of a sequence, with the place at which each state's first occurrence ends."""

    def __init__(self, ids: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for place, word in enumerate(ids):
            cur = self._state({}, self.length[last] + 1, place)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][word]
                if self.length[p] + 1 < self.length[q]:
                    copy = self._state(dict(self.next[q]), self.length[p] + 1, -1)
                    self.link[copy], self.link[q] = self.link[q], copy
                    while p >= 0 and self.next[p].get(word) == q:
                        self.next[p][word] = copy
                        p = self.link[p]
                    q = copy
                self.link[cur] = q
            last = cur

    def _state(self, follow: dict[int, int], length: int, end: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.end.append(end)
        self.link.append(0)
        return len(self.length) - 1

    def squares(self) -> Iterator[tuple[int, int]]:
        """(place, period): each pair of neighbouring ends of a state that are no further apart than it is long; place is the first of them."""
        ends: list[list[int] | None] = [[e] if e >= 0 else [] for e in self.end]
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            own, parent = ends[state], self.link[state]
            ends[state] = None
            if parent <= 0:
                continue
            large = ends[parent]
            if len(large) < len(own):
                own, large = large, own
            most = self.length[parent]
            for e in own:
                k = bisect_left(large, e)
                if k and e - large[k - 1] <= most:
                    yield large[k - 1], e - large[k - 1]
                if k < len(large) and large[k] - e <= most:
                    yield e, large[k] - e
                insort(large, e)
            ends[parent] = large


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _back(ids: np.ndarray) -> np.ndarray:
    """How many places before each the last equal value stands; larger than any period if there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), 1 << 60)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def _stretches(good: np.ndarray, least: int) -> list[tuple[int, int]]:
    step = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
    return [(a, b) for a, b in zip(step[::2].tolist(), step[1::2].tolist()) if b - a >= least]


def _extent(ids: np.ndarray, a: int, b: int, period: int) -> tuple[int, int]:
    """The stretch around [a, b) that keeps ``period``."""
    step = 64
    while b < len(ids):
        n = min(step, len(ids) - b)
        off = np.flatnonzero(ids[b : b + n] != ids[b - period : b - period + n])
        if len(off):
            b += int(off[0])
            break
        b, step = b + n, step * 2
    step = 64
    while a > 0:
        n = min(step, a)
        off = np.flatnonzero(ids[a - n : a] != ids[a - n + period : a + period])
        if len(off):
            a -= n - 1 - int(off[-1])
            break
        a, step = a - n, step * 2
    return a, b


def _within(ids: np.ndarray, base: int, block: np.ndarray, known: dict[int, list[Run]]) -> None:
    """Add to ``known``, by period, the maximal stretches around all squares of a block that begins at ``base``."""
    for place, period in Automaton(block.tolist()).squares():
        at = base + place
        stretches = known.setdefault(period, [])
        k = bisect_left(stretches, (at + 1,))
        # Stretches of one period overlap by less than it, so only the one that starts last may hold a square that ends at at + period.
        if k and at - period + 1 >= stretches[k - 1][0] and at + period < stretches[k - 1][1]:
            continue
        if k < len(stretches) and at - period + 1 >= stretches[k][0] and at + period < stretches[k][1]:
            continue
        insort(stretches, (*_extent(ids, at - period + 1, at + period + 1, period), period))


def runs(ids: np.ndarray, words: np.ndarray | None = None, grams: np.ndarray | None = None) -> list[Run]:
    """(start, end, period) of all runs, by start, then period. ``words`` and ``grams``: distances to the last equal word and gram, if they are known."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    if words is None:
        words, grams = distances(ids)
    known: dict[int, list[Run]] = {}
    low, high, length, back = 1, GRAM - 1, 1, words  # periods from low to high, with grams of ``length`` words
    while LEAST_TIMES * low <= n:
        least = LEAST_WORDS - 1 if length == 1 else (LEAST_TIMES - 1) * low - length + 1
        for a, b in _stretches(back[: n - length + 1] <= high, least):
            for start, end in _open(max(0, a - high), b + length - 1, high, known):
                size = max(8 * high, BLOCK)
                for base in range(start, max(start + 1, end - 2 * high), size - 2 * high):
                    _within(ids, base, ids[base : min(end, base + size)], known)
        low, high, length, back = high + 1, 2 * high + 1, GRAM, grams
    found = {r for own in known.values() for r in own if r[1] - r[0] >= max(LEAST_WORDS, LEAST_TIMES * r[2])}
    return sorted(found, key=lambda r: (r[0], r[2]))


def _open(start: int, end: int, high: int, known: dict[int, list[Run]]) -> list[tuple[int, int]]:
    """What is left of [start, end) for periods up to ``high``, which shares fewer than p + ``high`` words with a run of a smaller period p."""
    inner = sorted((a + p + high, b - p - high) for p, own in known.items() for a, b, _ in own if b - a > 2 * (p + high) and a < end and b > start)
    out = []
    for a, b in inner:
        if a > start:
            out.append((start, min(a, end)))
        start = max(start, b)
    return [*out, (start, end)] if start < end else out


def distances(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the last equal word, and to the last equal gram of four words (for the places where one starts)."""
    if len(ids) < GRAM:
        return _back(ids), np.zeros(0, np.int64)
    size = int(ids.max()) + 2
    two = _ranks(ids[:-1] * size + ids[1:])
    four = two[:-2] * (int(two.max()) + 2) + two[2:]
    return _back(ids), _back(four)


def folded(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the document, of which the tail repeats for a tenth of all ids, by a checksum of the id; a null id changes nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // len(part))))[: n - a] if p <= n - a else words


def _row(words: list[bytes], found: list[Run]) -> tuple:
    digest = hashlib.sha256("".join(f"{a},{b - a},{p}\n" for a, b, p in found).encode()).hexdigest()
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    kept = words
    if found:
        keep = np.ones(len(words), bool)
        for a, b, p in found:
            keep[a + p : b] = False
        kept = [words[i] for i in np.flatnonzero(keep)]
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (len(found), *top, digest, hashlib.sha256(b" ".join(kept)).hexdigest())


def _judge(texts: list[list[bytes]]) -> list[tuple]:
    """Rows of several documents, whose words are numbered and sorted together."""
    index: dict[bytes, int] = {}
    sizes = [len(w) for w in texts]
    flat = np.fromiter((index.setdefault(w, len(index)) for own in texts for w in own), np.int64, sum(sizes))
    # Words of different documents get different numbers, so that no distance reaches over a document's start.
    starts = np.cumsum([0, *sizes])
    which = np.repeat(np.arange(len(texts)), sizes)
    apart = flat * len(texts) + which
    words, grams = distances(_ranks(apart)) if len(apart) >= GRAM else (_back(apart), np.zeros(0, np.int64))
    out = []
    for k, own in enumerate(texts):
        a, b = starts[k], starts[k + 1]
        found = runs(flat[a:b], words[a:b], grams[a : max(a, b - GRAM + 1)]) if b - a >= LEAST_WORDS else []
        out.append(_row(own, found))
    return out


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    ``docs``: (doc_id, text). Words are split at ASCII white space; a run has at least 6 words and 4 times its smallest period; of equally long
    runs the first counts, then the one of the smaller period. The collapsed text keeps the first period of each run. A null or empty text, and
    one without runs, has no runs and four nulls; null ids are kept, with the text as it stands; repeated rows give repeated results; an empty
    table gives no rows; other columns are ignored. A text is read whole, by one task, which holds a small multiple of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            k = 0
            while k < len(ids):
                part, size, first = [], 0, k
                while k < len(ids) and (not part or size < TOGETHER):
                    part.append(folded((texts[k].as_py() or b"").split(), ids[k]))
                    size += len(part[-1])
                    k += 1
                rows = [(ids[first + j], *row) for j, row in enumerate(_judge(part))]
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names)

    return docs.select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).mapInArrow(run, SCHEMA)
