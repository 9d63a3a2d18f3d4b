"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network labels every byte of a text; a document's probabilities are the mean of its bytes'. It is fitted on the driver by
backpropagation through time, on windows from a sample of labelled documents whose size is bounded per language; tasks
get its few thousand weights and read whole texts, cut into windows that many rows share a matrix product for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled_id, true_id

#: Expected number of documents per language that the network is fitted on, at most, and windows from each of them.
FIT_DOCS, FIT_WINDOWS = 500, 12
#: Bytes of a window, units of each direction, windows that are worked on together.
STEPS, UNITS, LANES = 64, 8, 2048
UNKNOWN = "und"


def windows(text: str, steps: int = STEPS) -> np.ndarray:
    """The text's UTF-8 bytes as rows of ``steps``, the last filled up with spaces."""
    raw = text.encode("utf-8", "replace")
    return np.frombuffer(raw + b" " * (-len(raw) % steps), np.uint8).reshape(-1, steps)


class BiGRU:
    """Weights by gate (z, r, candidate) and direction: ``x`` (3, 2, 256, h) of input bytes with bias, ``u`` (3, 2, h, h) of states;
    ``o`` (2h, n) and ``b`` (n) of labels. Gates are kept apart so that each step works on whole, contiguous arrays."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 0):
        rng, n = np.random.default_rng(seed), len(languages)
        self.languages, self.h = languages, units
        self.p = {
            "x": rng.normal(0, 0.3, (3, 2, 256, units)),
            "u": rng.normal(0, units**-0.5, (3, 2, units, units)),
            "o": rng.normal(0, (2 * units) ** -0.5, (2 * units, n)),
            "b": np.zeros(n),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, bytes_: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, 2, rows, h) after each step; direction 1 reads backwards. ``keep`` gets what backpropagation needs."""
        rows, steps = bytes_.shape
        h = self.h
        gates, cand = -self.p["x"][:2].reshape(1024, h), self.p["x"][2].reshape(512, h)
        u_gates, u_cand = -self.p["u"][:2], self.p["u"][2]
        at = np.stack([bytes_.T, bytes_.T[::-1] + np.int64(256)], axis=1)  # steps, 2, rows
        out = np.empty((steps, 2, rows, h), np.float32)
        state = np.zeros((2, rows, h), np.float32)
        both, zr, c = np.empty((2, 2, rows), np.int64), np.empty((2, 2, rows, h), np.float32), np.empty((2, rows, h), np.float32)
        with np.errstate(over="ignore"):
            for t in range(steps):
                both[0] = at[t]
                np.add(at[t], 512, out=both[1])
                if keep is not None:
                    zr, c = np.empty_like(zr), np.empty_like(c)
                np.take(gates, both, axis=0, out=zr, mode="clip")
                zr += np.matmul(state, u_gates)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                s = np.matmul(state, u_cand)
                np.take(cand, at[t], axis=0, out=c, mode="clip")
                c += zr[1] * s
                np.tanh(c, out=c)
                if keep is not None:
                    keep.append((state, zr[0], zr[1], c, s))
                new = np.subtract(state, c, out=out[t])
                new *= zr[0]
                new += c
                state = new
        return out

    def scores(self, states: np.ndarray) -> np.ndarray:
        """Probabilities (steps, rows, n) of every position. States are within -1 and 1, so the exponentials can't overflow."""
        h, n = self.h, len(self.languages)
        v = states[:, 0] @ self.p["o"][:h]
        v += states[::-1, 1] @ self.p["o"][h:]
        v += self.p["b"]
        np.exp(v, out=v)
        v /= v @ np.ones((n, n), np.float32)
        return v

    def gradients(self, bytes_: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        rows, steps = bytes_.shape
        h, keep = self.h, []
        states = self.states(bytes_, keep)
        prob = self.scores(states)
        took = prob[:, np.arange(rows), labels]
        loss = float(-np.log(np.maximum(took, 1e-9)).mean())
        d = prob.copy()
        d[:, np.arange(rows), labels] -= 1
        d /= rows * steps
        flat = d.reshape(-1, d.shape[-1])
        ends = [states[:, 0].reshape(-1, h), states[::-1, 1].reshape(-1, h)]
        grad = {"b": flat.sum(0), "o": np.concatenate([x.T @ flat for x in ends])}
        out = np.stack([d @ self.p["o"][:h].T, (d @ self.p["o"][h:].T)[::-1]], axis=1)  # steps, 2, rows, h
        u_back = self.p["u"].transpose(0, 1, 3, 2)
        gates = np.empty((steps, 3, 2, rows, h), np.float32)
        gu = np.zeros_like(self.p["u"])
        carry = np.zeros((2, rows, h), np.float32)
        for t in reversed(range(steps)):
            state, z, r, c, s = keep[t]
            dn = out[t] + carry
            own = gates[t]
            own[0] = dn * (state - c) * z * (1 - z)
            own[2] = dn * (1 - z) * (1 - c * c)
            own[1] = own[2] * s * r * (1 - r)
            to_state = own.copy()
            to_state[2] *= r
            carry = dn * z + (to_state @ u_back).sum(0)
            gu += state.transpose(0, 2, 1) @ to_state
        gx = np.empty_like(self.p["x"])
        for way, read in enumerate((bytes_.T, bytes_.T[::-1])):
            read = read.ravel()
            for gate in range(3):
                for k in range(h):
                    gx[gate, way, :, k] = np.bincount(read, gates[:, gate, way, :, k].ravel(), 256)
        return loss, grad | {"x": gx, "u": gu}

    def fit(self, rows: np.ndarray, labels: np.ndarray, rounds: int = 300, batch: int = 192, rate: float = 0.03, seed: int = 0) -> list[float]:
        """Adam on batches that hold the languages evenly; the rate falls to a tenth. The losses, one for each round."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        by = [x for x in by if len(x)]
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        losses = []
        for i in range(1, rounds + 1):
            pick = np.concatenate([rng.choice(x, -(-batch // len(by))) for x in by])
            loss, grad = self.gradients(rows[pick], labels[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step = rate * 0.1 ** (i / rounds)
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                a, b = m[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                self.p[k] = (self.p[k] - step * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return losses

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """Mean probabilities over all bytes of each text (texts, n); zeros for an empty or null one."""
        cut = [windows(t) if t else np.empty((0, STEPS), np.uint8) for t in texts]
        lengths = np.array([len(t.encode("utf-8", "replace")) if t else 0 for t in texts])
        total = np.zeros((len(texts), len(self.languages)))
        if not lengths.any():
            return total
        rows = np.concatenate(cut)
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in cut])
        last = np.full(len(rows), STEPS)
        ends = np.cumsum([len(x) for x in cut])
        full = lengths > 0
        last[ends[full] - 1] = (lengths[full] - 1) % STEPS + 1
        for k in range(0, len(rows), LANES):
            prob = self.scores(self.states(rows[k : k + LANES]))
            own = last[k : k + LANES]
            for row in np.flatnonzero(own < STEPS):
                prob[own[row] :, row] = 0
            np.add.at(total, doc[k : k + LANES], prob.sum(axis=0))
        return total / np.maximum(lengths, 1)[:, None]


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_rows(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows and labels to fit on: about ``fit_docs`` documents per language by a hash of the id, ``fit_windows`` windows
    of each from all over its text."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.empty((0, STEPS), np.uint8), np.empty(0, np.int64)
    u = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    limit = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, int(min(1.0, fit_docs / counts[k]) * (1 << 30)))]), F.col("lang"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"]):
                raw = text.encode("utf-8", "replace")
                for k in range(fit_windows if len(raw) > STEPS else 1):
                    at = xxhash.xxh3_64_intdigest(f"{i}:{k}") % max(1, len(raw) - STEPS + 1)
                    out.append((int(i), k, lang, raw[at : at + STEPS].ljust(STEPS)))
            yield pd.DataFrame(out, columns=["doc_id", "k", "lang", "w"])

    sample = known.where(u < limit).select(filled_id("doc_id"), "text", "lang").mapInPandas(cut, "doc_id long, k int, lang string, w binary")
    got = sorted(sample.collect())
    if not got:
        return [], np.empty((0, STEPS), np.uint8), np.empty(0, np.int64)
    rows = np.frombuffer(b"".join(bytes(r["w"]) for r in got), np.uint8).reshape(-1, STEPS)
    return languages, rows, np.array([languages.index(r["lang"]) for r in got])


def identify(docs: DataFrame, model: BiGRU | None) -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, lang_pred, score), score being the pooled probability of lang_pred.

    ``und`` with score 0 for a null text, one without a letter, and without a model. Only the text decides. Texts of any
    length are read whole; null ids and repeated rows pass through; empty table: empty result. Further columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                texts = [t if isinstance(t, str) and any(map(str.isalpha, t)) else None for t in part["text"]]
                out = part[["doc_id", "held_out"]].copy()
                prob = model.pooled(texts) if model else np.zeros((len(texts), 1))
                best = prob.argmax(axis=1)
                known = [t is not None and model is not None for t in texts]
                out["lang_pred"] = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)]
                out["score"] = [min(1.0, float(prob[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, known))]
                yield out

    cols = docs.select(filled_id("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return cols.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double").withColumn("doc_id", true_id("doc_id"))


def language_id(docs: DataFrame, fit_docs: int = FIT_DOCS, rounds: int = 300) -> DataFrame:
    """Fit on the labelled documents that are not held out, then ``identify`` all."""
    languages, rows, labels = fit_rows(docs, fit_docs)
    model = None
    if languages:
        model = BiGRU(languages)
        model.fit(rows, labels, rounds)
    return identify(docs, model)
