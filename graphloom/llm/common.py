"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.groups import components, discard, stash

__all__ = ["NO_ID", "SPACE", "components", "discard", "filled_id", "stash", "text_or_empty", "true_id"]

#: White space of the operators' contracts, as it stands inside a character class.
SPACE = r"\x20\x09-\x0D"
#: Stands for a null id where rows pass through pandas, which would turn a column of ids with a null into floats.
NO_ID = -(1 << 63)


def filled_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias(name)


def true_id(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
