"""Identifier and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value in source files.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Parts of an acronym that name the temporal lobe.
TEMPORAL = ("MTG", "STG", "ITG", "FUG", "TL")


def normal_id(c: Column) -> Column:
    """Trimmed and upper-cased; null stays null."""
    return F.upper(F.trim(c.cast("string")))


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def first_accession(c: Column) -> Column:
    """First of several accessions separated by | ; , or white space, upper-cased; null if there is none."""
    tokens = F.split(F.trim(F.regexp_replace(c, r"[|;,\s]+", " ")), " ")
    return F.nullif(F.upper(F.element_at(tokens, 1)), F.lit(""))


def accession_of_name(c: Column, pattern: str = "AF-([A-Z0-9]+)-F1") -> Column:
    """The pattern's first group; null if it doesn't match."""
    return F.nullif(F.upper(F.regexp_extract(c, pattern, 1)), F.lit(""))


def file_name(c: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(c, "/", -1)


def file_stem(c: Column) -> Column:
    """The file name without what follows its last point."""
    return F.regexp_replace(file_name(c), r"(?<=.)\.[^.]*$", "")


def region(main: Column, sub: Column, acronym: Column, fix_case: bool = False) -> Column:
    """Region of a sample: hippocampus, entorhinal, temporal or null, in this order of priority.

    By default only the acronym tells the first two apart, as the sub-structure tests of the original can't hold for the lower-cased
    names that it compares; ``fix_case`` makes them count.
    """
    a, m, s = (F.coalesce(F.upper(x), F.lit("")) for x in (acronym, main, sub))
    hippo, ento = a.contains("HC"), a.contains("PHG")
    if fix_case:
        hippo, ento = hippo | s.contains("HIP") & ~s.contains("PARAHIP"), ento | s.contains("PARAHIP")
    temporal = m == "TL"
    for part in TEMPORAL:
        temporal |= a.contains(part)
    return F.when(hippo, "hippocampus").when(ento, "entorhinal").when(temporal, "temporal")


def is_positive(label: Column, name: str = "AD") -> Column:
    return (F.upper(label) == name.upper()).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def binary_entropy(p: Column) -> Column:
    def term(q: Column) -> Column:
        return F.when(q > 0, -q * F.log2(q)).otherwise(0.0)

    return term(p) + term(1 - p)


def hash_order(*parts: Column) -> Column:
    """A pseudo-random order that any engine with MD5 can repeat."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
