"""Chat formatting: a finite-state machine over roles, and a declarative template that yields text segments with loss flags."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled_id, true_id


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles are trained on, and which role may follow which.

    ``turn`` is a list of (part, loss): a part is literal text, or ``role`` or ``text`` in braces; a part with loss is under
    the loss mask if the turn's role is in ``trained``. Literals open or close with ``mark``; inside roles and texts it is
    escaped, so that they can't be taken for marks and the output can be read back.
    """

    turn: tuple[tuple[str, bool], ...] = (("<|im_start|>", False), ("{role}", False), ("\n", False), ("{text}", True), ("<|im_end|>\n", False))
    trained: frozenset[str] = frozenset({"assistant"})
    #: state -> role -> next state; a conversation is valid if it ends in a state of ``final``.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: frozenset[str] = frozenset({"asked", "answered"})

    def valid(self, roles: list[str]) -> bool:
        state = "start"
        for role in roles:
            state = self.moves.get(state, {}).get(role)
            if state is None:
                return False
        return state in self.final

    def segments(self, turns: list[tuple[str, str]]) -> Iterator[tuple[str, bool]]:
        """(segment, under loss) of each turn, in order."""
        for role, text in turns:
            for part, loss in self.turn:
                if part == "{role}":
                    yield escape(role, line=True), loss and role in self.trained
                elif part == "{text}":
                    yield escape(text), loss and role in self.trained
                else:
                    yield part, loss and role in self.trained


def escape(text: str, line: bool = False) -> str:
    """Reversible: a backslash is doubled, and one goes between the two characters that open a mark. In a role, line feeds become \\n."""
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if line else text


def unescape(text: str) -> str:
    out, i = [], 0
    while (k := text.find("\\", i)) >= 0:
        out.append(text[i:k])
        out.append("\n" if text[k + 1] == "n" else text[k + 1])
        i = k + 2
    return "".join(out) + text[i:]


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a text that the default template made."""
    turns = []
    for turn in formatted.split("<|im_start|>")[1:]:
        role, _, text = turn.partition("\n")
        turns.append((unescape(role), unescape(text[: -len("<|im_end|>\n")])))
    return turns


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conv_id: (conv_id, n_turns, valid, formatted, segments array<struct<text, loss>>).

    Turns go by turn number, nulls first; ties by role and text, so repeated rows stay and reruns agree. A null text or role is
    empty; rows with a null conv_id are one conversation. ``valid`` is the state machine's verdict; an invalid conversation is formatted
    all the same. A conversation is one output row and has to fit in one. Empty table: empty result. Further columns are ignored.
    """
    template = template or Template()
    cols = turns.select(
        filled_id("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"),
    )
    grouped = cols.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, xs in zip(batch["conv_id"], batch["turns"]):
                own = [(x["role"], x["text"]) for x in xs]
                segments = list(template.segments(own))
                rows.append((conv, len(own), template.valid([r for r, _ in own]), "".join(s for s, _ in segments), [{"text": s, "loss": bool(f)} for s, f in segments]))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "valid", "formatted", "segments"])
            yield out

    return grouped.mapInPandas(run, "conv_id long, n_turns long, valid boolean, formatted string, segments array<struct<text: string, loss: boolean>>").withColumn("conv_id", true_id("conv_id"))


def digests(formatted: DataFrame) -> DataFrame:
    """Turn and loss digests, read back from the formatted text and the segments under loss."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["conv_id", "valid"]].copy()
            turns = [read_back(t) for t in batch["formatted"]]
            loss = ["".join(unescape(s["text"]) for s in segs if s["loss"]) for segs in batch["segments"]]
            out["n_turns"] = [len(t) for t in turns]
            out["turns_sha256"] = [hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest() for t in turns]
            out["loss_chars"] = [len(x) for x in loss]
            out["loss_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in loss]
            out["formatted_chars"] = [len(t) for t in batch["formatted"]]
            yield out

    return formatted.select(filled_id("conv_id"), "valid", "formatted", "segments").mapInPandas(
        run, "conv_id long, valid boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ).withColumn("conv_id", true_id("conv_id"))
