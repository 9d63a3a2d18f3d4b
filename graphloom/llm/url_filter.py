"""URL filters: rules first, gradient-boosted trees on lexical features for the rest. DataFrame operations only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Expected number of labelled rows that the trees are fitted on, at most.
FIT_ROWS = 20_000
# Words of host names that label a URL as unwanted.
UNWANTED = ("adult", "bets", "bet", "casino", "loan", "loans", "pills", "poker", "porn", "viagra", "xxx")
#: How strongly a suffix's share of unwanted URLs is drawn to the share among all.
PRIOR_ROWS = 20.0
FEATURES = ["length", "host_length", "depth", "digits", "entropy", "params", "hyphens", "labels", "suffix1", "suffix2", "suffix3"]
#: Suffixes whose statistics may be broadcast; beyond that, the join is shuffled.
BROADCAST_SUFFIXES = 200_000

Rules = list[tuple[str, str, str]]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    host, path = host_and_path(F.col("__url"))
    return urls.withColumn("__url", F.col(url).cast("string")).withColumns({"__host": host, "__path": path})


def matched_rule(rules: Rules) -> Column:
    """Struct (rule, verdict) of the longest rule (host, path, verdict) that fits; null if none does. For rule lists of up to some hundreds."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("__host") == host) | F.col("__host").endswith("." + host)) & F.col("__path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _suffix(k: int) -> Column:
    return F.substring_index("__host", ".", -k)


def with_features(urls: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Lexical features. ``suffixes`` (suffix, share), of all labelled rows but those that the trees are fitted on, is broadcast only below a checked count."""
    few = suffixes.count() <= BROADCAST_SUFFIXES
    u, h = F.coalesce("__url", F.lit("")), F.col("__host")
    n = F.greatest(F.length(h), F.lit(1))
    part = lambda c: (F.length(h) - F.length(F.replace(h, c))) / n
    entropy = F.aggregate(F.array_distinct(F.split(h, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(part(c) * F.log2(F.greatest(part(c), F.lit(1e-9)))))
    out = urls.withColumns(
        {
            "length": F.length(u).cast("double"),
            "host_length": F.length(h).cast("double"),
            "depth": F.regexp_count("__path", F.lit("/")).cast("double"),
            "digits": F.regexp_count(u, F.lit("[0-9]")) / F.greatest(F.length(u), F.lit(1)),
            "entropy": entropy,
            "params": F.regexp_count(u, F.lit("=")).cast("double"),
            "hyphens": F.regexp_count("__host", F.lit("-")).cast("double"),
            "labels": F.size(F.split("__host", "[.]")).cast("double"),
        }
    )
    for k in (1, 2, 3):
        own = suffixes.select(F.col("suffix").alias(f"__s{k}"), F.col("share").alias(f"suffix{k}"))
        out = out.withColumn(f"__s{k}", _suffix(k)).join(F.broadcast(own) if few else own, f"__s{k}", "left").drop(f"__s{k}")
        out = out.withColumn(f"suffix{k}", F.coalesce(f"suffix{k}", F.lit(-1.0)))
    return VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(out)


def suffix_shares(labelled: DataFrame) -> DataFrame:
    """(suffix, share): the smoothed share of unwanted URLs for each one, two and three last labels of a host."""
    one = labelled.select(F.explode(F.array_distinct(F.array(*[_suffix(k) for k in (1, 2, 3)]))).alias("suffix"), "label")
    mean = labelled.agg(F.avg("label")).first()[0] or 0.0
    return one.groupBy("suffix").agg(((F.sum("label") + mean * PRIOR_ROWS) / (F.count(F.lit(1)) + PRIOR_ROWS)).alias("share"))


def seed_labels(urls: DataFrame, words: tuple[str, ...] = UNWANTED) -> DataFrame:
    """(url, label): 1 if a word of the host is an unwanted one."""
    named = F.split("__host", "[^a-z0-9]+")
    return with_parts(urls).where("__host <> ''").select("url", F.arrays_overlap(named, F.array(*[F.lit(w) for w in words])).cast("int").alias("label"))


def bounded_sample(labelled: DataFrame, most: int) -> DataFrame:
    """``labelled`` with weight, the labelled rows that one for fitting stands for, and fit: whether a row is one of those for fitting, chosen by a hash of host and path so that equal pages go together.

    Of each label about half of its rows at most, and about ``most`` in all: a label of less than half of ``most`` rows leaves its room to the other.
    """
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    room, part, weight = most, F.lit(0), F.lit(1.0)
    for k, (label, n) in enumerate(sorted(counts.items(), key=lambda x: x[1])):
        share = min(0.5, room / (len(counts) - k) / n)
        room -= share * n
        part = F.when(F.col("label") == label, F.lit(int(share * (1 << 30)))).otherwise(part)
        weight = F.when(F.col("label") == label, F.lit(1 / share)).otherwise(weight)
    return labelled.withColumn("weight", weight).withColumn("fit", F.pmod(F.xxhash64("__host", "__path", F.lit(7)), F.lit(1 << 30)) < part)


def url_filter(pages: DataFrame, rules: Rules, labelled: DataFrame, fit_rows: int = FIT_ROWS, trees: int = 10, depth: int = 3) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): (page_id, host, path, rule, verdict, score).

    ``labelled`` (url, label 0 or 1) trains the trees, on a sample of about ``fit_rows`` rows and half of each label's at most; suffix
    statistics come from all other labelled rows, so that the trees see statistics as good as they will meet. A rule's verdict goes before
    the trees'. Null URLs, and those without ://, have empty parts, match no rule, and are judged like others. Without labelled rows of
    both kinds there are no trees, and the verdict is the only known label's, or allow. Repeated rows and null ids pass
    through; empty table: empty result. Further columns are ignored.
    """
    marked = with_parts(labelled.where("label is not null")).select("url", "__url", "__host", "__path", F.col("label").cast("double").alias("label"))
    marked = bounded_sample(marked, fit_rows)
    fitted = stash(marked.where("fit"), "fitted-urls")
    kinds = [r[0] for r in fitted.groupBy("label").count().collect()]
    if len(kinds) < 2:  # of few rows, the hash may choose none of a label
        kinds = [r[0] for r in marked.groupBy("label").count().collect()]
        fitted = marked
    rows = with_parts(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"))).withColumn("__rule", matched_rule(rules))
    if len(kinds) == 2:
        shares = stash(suffix_shares(marked.where("not fit")), "suffixes")
        model = GBTClassifier(labelCol="label", weightCol="weight", featuresCol="__features", predictionCol="__block", maxIter=trees, maxDepth=depth, seed=1).fit(with_features(fitted, shares))
        rows = model.transform(with_features(rows, shares))
        from pyspark.ml.functions import vector_to_array

        rows = rows.withColumn("score", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("__block", F.lit(float(kinds[0]) if kinds else 0.0)).withColumn("score", F.col("__block"))
    own = F.when(F.col("__block") > 0.5, "block").otherwise("allow")
    return rows.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), own).alias("verdict"), "score")


def allowed(pages: DataFrame, rules: Rules, labelled: DataFrame, **kwargs) -> DataFrame:
    """The rows of ``pages`` whose verdict is allow. Rows that share a page_id go together if one is blocked; a null page_id is kept."""
    gone = url_filter(pages, rules, labelled, **kwargs).where("verdict = 'block'").select("page_id").distinct()
    return pages.join(gone, "page_id", "left_anti").select(*pages.columns)
