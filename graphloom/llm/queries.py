"""Queries opN_<name> over the documents, pages and conversations tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, html_extract, lang_id, line_dedup, mixing, ngram_join, packing, periodic_runs, quality_rules, secret_links, url_filter, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


RULES: url_filter.Rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.url_filter(pages, RULES, url_filter.seed_labels(pages))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_id(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.format_chats(turns))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).drop("boilerplate_keys", "row_key")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies", "source")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).drop("doc_row", "source", "ids")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents")).drop("n_links")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.secret_links(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""

OP5_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS safe, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS safe_role FROM rows_)
SELECT conv_id,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, '' ORDER BY turn, role, text), 's?u(au)*a?') AS valid,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(safe_role) + 1 + length(safe) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT r, doc_id, text, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT r, i, [ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]] AS five FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) t(k) GROUP BY r),
l AS (
  SELECT r, source, line, len(own) AS n,
    regexp_replace(translate(array_to_string(own, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS norm
  FROM (SELECT r, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS own FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM d))
  WHERE len(own) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
freq AS (
  SELECT f.source, norm FROM (SELECT source, norm, count(DISTINCT r) AS docs FROM l GROUP BY source, norm) f
  JOIN hosts h ON h.source IS NOT DISTINCT FROM f.source WHERE f.docs > 10 AND f.docs > 0.10 * h.docs),
lost AS (SELECT r, sum(n) AS n FROM l JOIN freq f ON f.source IS NOT DISTINCT FROM l.source AND f.norm = l.norm GROUP BY r),
s AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost.n, 0) AS boilerplate_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, boilerplate_words::BIGINT AS boilerplate_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND boilerplate_words <= 0.5 * n_words AS kept
FROM s
"""

OP7_SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
t AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s GROUP BY source),
c AS (SELECT *, (3 * source_size)::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS weights FROM t),
lv AS (
  SELECT *, (total - coalesce(sum(cap) OVER u, 0)) / (weights - coalesce(sum(weight) OVER u, 0)) AS level FROM c
  WINDOW u AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT arg_min(level, cap / weight) AS level FROM lv WHERE level * weight <= cap),
p AS (
  SELECT lv.source, source_size, least(coalesce(b.level * weight, cap), cap) AS target FROM lv, b),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS passes FROM p),
r AS (
  SELECT s.*, q.source_size, q.target, q.passes, q.target - q.passes * q.source_size AS rest,
    sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (size * least(3, passes + (upto <= rest)::BIGINT))::BIGINT AS taken FROM r
"""


def _lloyd(k: int) -> str:
    """Assignment to the codebooks c{k}, and the codebooks of the next round."""
    return f"""
a{k} AS (SELECT pos, part, any_value(n) AS n, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
  SELECT dp.*, c.e, list_sum(list_transform(list_zip(dp.part, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM dp JOIN c{k} c USING (pos)) GROUP BY pos, part),
s{k} AS (SELECT pos, e, i, floor(sum(n * part[i]) / sum(n))::BIGINT AS x FROM a{k}, range(1, 5) t(i) GROUP BY pos, e, i),
c{k + 1} AS (SELECT c.pos, c.e, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT pos, e, list(x ORDER BY i) AS c FROM s{k} GROUP BY pos, e) m USING (pos, e))"""


OP11_SQL = f"""
WITH k AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, vec_id, label, pos, q[4 * pos + 1 : 4 * pos + 4] AS part FROM k, range(0, 16) t(pos)),
dp AS (SELECT pos, part, count(*)::BIGINT AS n FROM p GROUP BY pos, part),
c0 AS (SELECT pos, e, part AS c FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k) USING (r) WHERE e < 64),{_lloyd(0)},{_lloyd(1)},{_lloyd(2)},
v AS (SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM p JOIN a2 USING (pos, part) GROUP BY r),
b AS (SELECT sha256(string_agg(x, ',' ORDER BY pos, e, i)) AS codebooks_sha256 FROM (SELECT pos, e, i, c[i]::VARCHAR AS x FROM c2, range(1, 5) t(i)))
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v, b
"""


def _op12_sql() -> str:
    """Matches by pattern, with their places; the links as semi joins without cells."""
    kinds = secret_links.KINDS
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    scan = " UNION ALL ".join(
        f"SELECT r, '{k}' AS kind, {rank} AS rank, {least} AS least, regexp_extract_all(t, {quote(p)}) AS found, regexp_extract_all(t, {quote(p)}, {g}) AS val, string_split_regex(t, {quote(p)}) AS gaps FROM d"
        for rank, (k, (p, g, least)) in enumerate([*kinds.items(), ("break", (secret_links.BREAK, 0, 0))])
    )
    listed = lambda names: "(" + ", ".join(map(quote, names)) + ")"
    near = f'o.r = w.r AND o.scope = w.scope AND o."start" <= w."end" + {secret_links.REACH} AND w."start" <= o."end" + {secret_links.REACH}'
    partner = lambda names: f"EXISTS (SELECT 1 FROM parts o WHERE {near} AND o.kind IN {listed(names)})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({scan}),
e AS (SELECT r, kind, rank, least, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS f, unnest(val) AS v, unnest(gaps[1:len(found)]) AS g FROM m WHERE len(found) > 0),
u AS (SELECT r, kind, rank, f, v, least, (sum(length(g) + length(f)) OVER (PARTITION BY r, kind ORDER BY i))::BIGINT AS "end" FROM e),
pl AS (
  SELECT r, kind, rank, "end" - length(f) AS "start", "end" FROM u
  WHERE length(v) >= least AND (kind <> 'random' OR regexp_matches(f, '[a-z]') AND regexp_matches(f, '[A-Z]') AND regexp_matches(f, '[0-9]'))),
sc AS (SELECT *, coalesce(max(CASE WHEN kind = 'break' THEN "end" END) OVER (PARTITION BY r ORDER BY "start"), 0) AS scope FROM pl),
sp AS (SELECT * FROM sc WHERE kind <> 'break'),
parts AS (
  SELECT * FROM sp w WHERE w.kind IN {listed(secret_links.STRONG)} OR NOT EXISTS (
    SELECT 1 FROM sp o WHERE o.r = w.r AND o."start" < w."end" AND w."start" < o."end" AND (o.kind IN {listed(secret_links.STRONG)} OR w.kind = 'random' AND o.kind <> 'random'))),
al AS (
  SELECT r, kind, rank, "start", "end" FROM parts w WHERE w.kind IN {listed(secret_links.STRONG)}
    OR w.kind IN ('identifier', 'endpoint') AND {partner(secret_links.SECRETS)} AND (w.kind = 'identifier' OR {partner(secret_links.IDENTIFIERS)})
    OR w.kind IN ('secret', 'random') AND {partner(secret_links.IDENTIFIERS)}),
g AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat(kind, ':', "start", ':', "end"), ',' ORDER BY "start", rank, "end") FILTER (rank < 3) AS base, string_agg(concat(kind, ':', "start", ':', "end"), ',' ORDER BY "start", rank, "end") AS spans
  FROM al GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


OP12_SQL = _op12_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_exact_dedup, op2_html_extract, op3_url_filter, op4_language_id, op5_chat_format, op6_quality_rules, op7_mixing, op8_packing, op9_ngram_join, op10_line_dedup, op11_vector_codes, op12_secret_links, op13_periodic_runs]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op5_chat_format": OP5_SQL, "op6_quality_rules": OP6_SQL, "op7_mixing": OP7_SQL, "op11_vector_codes": OP11_SQL, "op12_secret_links": OP12_SQL}
