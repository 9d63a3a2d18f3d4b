"""Secret scans with multipart credential linking, by DataFrame functions only.

Three strong patterns are secrets by themselves. Weak candidates (named account identifiers, named or random-looking secrets, endpoints) are common in
clean text, so each is reported only where its complement stands in the same scope, a paragraph, and near: an identifier needs a secret, a secret
needs an identifier, an endpoint needs both. Strong access identifiers and secrets serve as complements too.

Places come without a UDF: a text that is split at a pattern gives the lengths of the gaps, the matches give their own, and running sums over a
text's matches give the places. Parts meet in an interval join over cells of the text, as semi joins that emit no pairs; a cell is as wide as parts may be
apart, so the parts that share one are bounded by its width, in any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stash, text_or_empty


def either_case(word: str) -> str:
    """A pattern for a word in ASCII letters of either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _named(names: list[str], value: str) -> str:
    return f"({'|'.join(map(either_case, names))})[\"']?\\x20*[:=]\\x20*[\"']?({value}+)"


#: Kinds of spans in the order in which those of one start are listed: pattern, group that is measured, least length of it.
# The first three, which the contract gives.
KINDS = {
    "assign": (_named(["password", "passwd", "secret", "token", "api_?key"], "[A-Za-z0-9+/_.=-]"), 2, 8),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16),  # shorter ones have no longer one within
    "hex": ("[0-9a-f]{32,}", 0, 32),
    "identifier": (_named(["access_?key_?id", "client_?id", "account_?id", "tenant_?id", "user_?name", "user_?id", "user", "login"], "[A-Za-z0-9+/_.@=-]"), 2, 3),
    "secret": (_named(["passphrase", "pass_?code", "pass", "pwd", "private_?key", "access_?key", "shared_?key", "auth_?key", "credential"], "[A-Za-z0-9+/_.=!@#$%-]"), 2, 6),
    "random": ("[A-Za-z0-9+/_-]{20,}", 0, 20),
    "endpoint": ("[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9.:@_%-]+[A-Za-z0-9]", 0, 8),
}
STRONG, WEAK = ["assign", "access", "hex"], ["identifier", "secret", "random", "endpoint"]
IDENTIFIERS, SECRETS = ["access", "identifier"], ["assign", "hex", "secret", "random"]
#: What ends a scope: an empty line. Code points that parts may be apart.
BREAK, REACH = r"\n[\x20\x09\x0B-\x0D]*\n", 256


def matches(text: Column, kind: str) -> Column:
    """The pattern's matches, leftmost first, none overlapping: gap before it, length, whether it counts; an empty list for most texts."""
    pattern, group, least = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    good = F.transform(measured, lambda v: F.length(v) >= least)
    if kind == "random":
        good = F.transform(found, lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]"))
    return F.when(F.exists(good, lambda g: g), _measures(text, pattern, found, good))


def _measures(text: Column, pattern: str, found: Column, good: Column) -> Column:
    own = F.zip_with(found, good, lambda v, g: F.struct(F.length(v).alias("size"), g.alias("good")))
    both = F.zip_with(own, F.split(text, pattern, -1), lambda x, gap: F.struct(F.length(gap).alias("gap"), x["size"].alias("size"), x["good"].alias("good")))
    return F.filter(both, lambda x: x["size"].isNotNull())  # there is a gap more than matches


def scanned(docs: DataFrame) -> DataFrame:
    """(row, doc_id, a list of matches for each kind, breaks), written: the texts are read here, once. Row numbers hold from then on."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("t"))
    rows = rows.select("*", *[matches(F.col("t"), k).alias(k) for k in KINDS])
    ends = F.regexp_extract_all("t", F.lit(BREAK), F.lit(0))
    breaks = _measures(F.col("t"), BREAK, ends, F.transform(ends, lambda _: F.lit(True)))
    weak = F.coalesce(*[F.col(k) for k in WEAK]).isNotNull()
    return stash(rows.select("row", "doc_id", *KINDS, F.when(weak, breaks).alias("break")), "scanned")


def spans(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, scope) of the matches that count. A scope is known by where it begins; only texts with weak candidates have more than one."""
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("m")) for k in [*KINDS, "break"]])
    each = rows.select("row", F.explode(listed).alias("x")).select("row", "x.kind", F.posexplode("x.m").alias("i", "m")).repartition("row")
    upto = F.sum(F.col("m.gap") + F.col("m.size")).over(Window.partitionBy("row", "kind").orderBy("i"))
    placed = each.withColumn("end", upto).where("m.good").select("row", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end")
    order = Window.partitionBy("row").orderBy("start", (F.col("kind") != "break").cast("int"))
    scope = F.coalesce(F.max(F.when(F.col("kind") == "break", F.col("end"))).over(order), F.lit(0))
    return placed.withColumn("scope", scope).where("kind <> 'break'")


def _in_cells(found: DataFrame, reach: int) -> DataFrame:
    cell = F.sequence(F.floor((F.col("start") - reach) / REACH), F.floor((F.col("end") + reach) / REACH))
    return found.withColumn("cell", F.explode(cell))


def _with_partner(weak: DataFrame, partners: DataFrame) -> DataFrame:
    """The rows of ``weak`` with one of ``partners`` in reach within their scope."""
    p = _in_cells(partners, REACH).select(F.col("row").alias("p_row"), F.col("scope").alias("p_scope"), F.col("cell").alias("p_cell"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    near = (F.col("p_start") <= F.col("end") + REACH) & (F.col("start") <= F.col("p_end") + REACH)
    same = (F.col("row") == F.col("p_row")) & (F.col("scope") == F.col("p_scope")) & (F.col("cell") == F.col("p_cell"))
    return _in_cells(weak, 0).join(p, same & near, "left_semi").drop("cell").distinct()


def linked(found: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the weak candidates whose complements are in reach. ``found``: ``spans``.

    Those that overlap a strong span are part of it, and a random-looking text in any other span is no candidate of its own.
    """
    strong = found.where(F.col("kind").isin(STRONG))
    weak = found.where(F.col("kind").isin(WEAK))
    s = _in_cells(found.where("kind <> 'random'"), 0).select(F.col("row").alias("s_row"), F.col("kind").alias("s_kind"), F.col("cell").alias("s_cell"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    over = (F.col("row") == F.col("s_row")) & (F.col("cell") == F.col("s_cell")) & (F.col("s_start") < F.col("end")) & (F.col("start") < F.col("s_end"))
    over &= F.col("s_kind").isin(STRONG) | (F.col("kind") == "random")
    covered = _in_cells(weak, 0).join(s, over, "left_semi").select("row", "kind", "start", "end").distinct()
    own = stash(weak.join(covered, ["row", "kind", "start", "end"], "left_anti").select(*found.columns), "weak")
    parts = strong.unionByName(own)
    secrets, identifiers = parts.where(F.col("kind").isin(SECRETS)), parts.where(F.col("kind").isin(IDENTIFIERS))
    with_secret = _with_partner(own.where("kind in ('identifier', 'endpoint')"), secrets)
    of_endpoints = _with_partner(with_secret.where("kind = 'endpoint'"), identifiers)
    out = with_secret.where("kind = 'identifier'").unionByName(of_endpoints).unionByName(_with_partner(own.where("kind in ('secret', 'random')"), identifiers))
    return out.select("row", "kind", "start", "end")


def secret_links(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 (digest of the strong spans), spans (all spans).

    ``docs``: (doc_id, text). Spans are kind:start:end in code points, the end exclusive, ordered by start, then kind, then end, and joined by commas. A null
    or empty text has none: zeros, the digest of nothing, and an empty list. Texts of any length are read whole; null and repeated ids pass through, each
    row with its own result; an empty table gives no rows; other columns are ignored.
    """
    rows = scanned(docs)
    any_match = F.coalesce(*[F.col(k) for k in KINDS]).isNotNull()
    found = stash(spans(rows.where(any_match)), "spans")
    strong = found.where(F.col("kind").isin(STRONG)).select("row", "kind", "start", "end")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    listed = strong.unionByName(linked(found)).withColumn("s", F.struct("start", rank.alias("rank"), "end", "kind"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda c, kinds: F.filter(c, lambda x: x["kind"].isin(kinds))
    lists = listed.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("s")).select(  # a row's spans are bounded by its text
        "row",
        *[F.size(of("s", [k])).cast("long").alias(f"n_{k}") for k in STRONG],
        joined(of("s", STRONG)).alias("base"),
        joined(F.col("s")).alias("spans"),
    )
    busy = rows.where(any_match).select("row", "doc_id").join(lists, "row", "left").drop("row")
    bare = rows.where(~any_match).select("doc_id", *[F.lit(None).cast("long").alias(f"n_{k}") for k in STRONG], F.lit(None).cast("string").alias("base"), F.lit(None).cast("string").alias("spans"))
    out = busy.unionByName(bare)
    counts = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in STRONG]
    return out.select("doc_id", *counts, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
