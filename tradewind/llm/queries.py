"""Registered queries of the training-data operators and the pipeline, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import ann, credentials, decontaminate, language, licenses, lm, minhash, negatives, packing, periodic, substring, urls, warc
from tradewind.llm.common import workers_import
from tradewind.session import ready


@dataclass(frozen=True)
class LlmQuery:
    name: str
    build: Callable[[Callable[[str], DataFrame]], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_import(ready(spark))
        return self.build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))


LLM_QUERIES: dict[str, LlmQuery] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        LLM_QUERIES[name] = LlmQuery(name, build, sql)
        return build

    return register


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS largest FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)""")
def op1(table):
    """Archive every page, then read the archives back."""
    rows = warc.with_revisits(table("pages"), "page_id", "url", "html")
    read = warc.read_archives(warc.write_archives(rows), with_payload=False)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ALNUM_SQL = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op2_decontaminate", f"""
WITH d AS (SELECT doc_id, {_ALNUM_SQL.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT DISTINCT item_id, {_ALNUM_SQL.format("coalesce(text, '')")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS win, least(13, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, k, p.n AS n FROM places p JOIN windows v ON p.win = v.win AND p.n = v.n),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op2(table):
    """Hit words, matched items and verdict of every document."""
    return decontaminate.contamination(table("documents"), table("benchmark")).drop("spans", "longest_span")


@query("op3_multi_index")
def op3(table):
    """Twenty nearest of every twentieth vector."""
    return ann.nearest(table("embeddings"), every=20)


@query("op4_language_id")
def op4(table):
    """Language of every document, learned from the labelled documents that are not held out."""
    docs = table("documents")
    return language.predicted(docs, language.learned(docs))


@query("op5_lm_scoring")
def op5(table):
    """Base and lattice score of every document."""
    return lm.scored(table("documents"), piece_vocabulary())


@query("op6_minhash", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach AS r JOIN both_ways AS l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) AS c USING (doc_id)""")
def op6(table):
    """Component and kept flag of every document."""
    return minhash.near_duplicates(table("documents"))


@query("op9_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, k, array_to_string(w[k:k + 34], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
repeats AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY run) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS pos FROM repeats),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)""")
def op9(table):
    """Words, removed words and digest of what is kept of every document."""
    return substring.substring_report(table("documents"))


@query("op7_license_scan")
def op7(table):
    """Phrase places and license labels of every document."""
    return licenses.license_scan(table("documents")).drop("matches")


@query("op8_best_fit_packing")
def op8(table):
    """Every document's pieces and their places in sequences of 4096 tokens."""
    return packing.packed(table("documents"), word_tokenizer())


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _attribute_sql(name: str) -> str:
    parts = " || ".join(f"regexp_extract(tag, {_quoted(urls.attribute_pattern(name))}, {k}, 'is')" for k in (1, 2, 3))
    return f"regexp_replace({parts}, {_quoted(urls.AMPERSAND)}, '&', 'gi')"


def _without_dots_sql(path: str) -> str:
    parts = f"list_transform(string_split(regexp_replace({path}, '(/\\.\\.?)\\z', '\\1/'), '/'), lambda x: [x])"
    return (
        f"array_to_string(list_reduce({parts}, lambda kept, x: CASE x[1] WHEN '..' THEN kept[:greatest(1, len(kept) - 1)] WHEN '.' THEN kept ELSE kept || x END), '/')")


_LINKS_SQL = f"""tags AS (
  SELECT host, path, host || rest AS src, unnest(regexp_extract_all(
    regexp_replace(html, {_quoted(urls.COMMENT)}, '', 'gis'), {_quoted(urls.TAG)}, 0, 'is')) AS tag
  FROM p WHERE url LIKE '%://%'),
targets AS (
  SELECT host, path, src, trim(regexp_replace(
    CASE WHEN regexp_matches(tag, '^<link', 'i') THEN CASE WHEN regexp_matches({_attribute_sql("rel")}, {_quoted(urls.CANONICAL)}, 'is') THEN {_attribute_sql("href")} END
      WHEN lower(trim({_attribute_sql("http-equiv")})) = 'refresh' THEN regexp_extract({_attribute_sql("content")}, {_quoted(urls.AT_ONCE)}, 1, 'is') END,
    '[\\t\\n\\f\\r]', '', 'g')) AS target FROM tags),
parts AS (
  SELECT *, regexp_extract(target, '^([^?#]*)', 1, 's') AS own, regexp_extract(target, '^[^?#]*([^#]*)', 1, 's') AS query,
    CASE WHEN target LIKE '//%' THEN 'x:' || target WHEN regexp_matches(target, '{urls.SCHEME}//', 'i') THEN target END AS whole
  FROM targets WHERE target <> '' AND target NOT LIKE '#%'),
links AS (
  SELECT src AS a, CASE
    WHEN whole IS NOT NULL THEN translate(regexp_extract(whole, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || regexp_extract(whole, '^.*?://[^/?#]*([^#]*)', 1, 's')
    WHEN target LIKE '/%' THEN host || {_without_dots_sql("own")} || query
    WHEN target LIKE '?%' THEN host || path || query
    ELSE host || {_without_dots_sql("(regexp_extract(path, '^(.*)/', 1, 's') || '/' || own)")} || query END AS b
  FROM parts WHERE whole IS NOT NULL OR NOT regexp_matches(target, '{urls.SCHEME}', 'i')),
"""


@query("op10_url_filters", r"""
WITH p AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') AS rest
  FROM pages),
rules(verdict, h, path_start) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
""" + _LINKS_SQL + r"""both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM r JOIN both_ways l ON r.b = l.a) SELECT * FROM r),
own AS (
  SELECT n, split_part(regexp_extract(n, '^([^/?#]*)', 1), '/', 1) AS host, regexp_extract(n, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT DISTINCT b AS n FROM reach)),
ruled AS (
  SELECT n, arg_max(verdict, len(h) + len(path_start)) AS verdict
  FROM own JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, path_start) GROUP BY n),
alias AS (
  SELECT a AS n, bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow') AS blocked
  FROM reach JOIN ruled ON ruled.n = reach.b GROUP BY a),
best AS (
  SELECT page_id, url, arg_max(h || path_start, len(h) + len(path_start)) AS rule, arg_max(verdict, len(h) + len(path_start)) AS verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, path_start) GROUP BY page_id, url)
SELECT p.page_id, p.host, p.path, best.rule,
  coalesce(best.verdict, CASE WHEN alias.blocked THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN best ON best.page_id = p.page_id AND best.url = p.url LEFT JOIN alias ON p.url LIKE '%://%' AND alias.n = p.host || p.rest""")
def op10(table):
    """Host, path, rule and verdict of every page."""
    return urls.judged(table("pages"))

@query("op11_periodic_runs")
def op11(table):
    """Periodic runs of every document, after the tail of some was made to repeat."""
    found = periodic.periodic_runs(periodic.repeated_tail(table("documents")))
    best = periodic.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _matches_sql(name: str, number: int, kind: credentials.Kind) -> str:
    pattern = kind.pattern.replace("'", "''")
    return f"""
SELECT doc_id, source, {number} AS kind, '{name}' AS name, unnest(string_split_regex(text, '{pattern}')) AS gap,
  unnest(regexp_extract_all(text, '{pattern}')) AS found, unnest(regexp_extract_all(text, '{pattern}', {kind.group})) AS value,
  unnest(range(len(regexp_extract_all(text, '{pattern}')) + 1)) AS nr
FROM d WHERE regexp_matches(text, '{pattern}')"""


_SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
parts AS ({" UNION ALL ".join(_matches_sql(k.name, n, k) for n, k in enumerate(credentials.KINDS))}),
placed AS (
  SELECT doc_id, source, kind, name, value, length(found) AS n,
    sum(length(gap) + coalesce(length(found), 0)) OVER (PARTITION BY doc_id, kind ORDER BY nr ROWS UNBOUNDED PRECEDING) AS stop
  FROM parts),
found AS (
  SELECT doc_id, source, kind, name, value, CAST(stop - n AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed
  WHERE n IS NOT NULL AND CASE name WHEN 'assign' THEN length(value) >= 6 WHEN 'login' THEN length(value) >= 6
    WHEN 'mixed' THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 10 ELSE true END),
owned AS (
  SELECT value, count(DISTINCT doc_id) AS repositories, count(DISTINCT coalesce('=' || source, 'none')) AS owners FROM found GROUP BY value),
kept AS (
  SELECT f.*, max(stop) OVER (PARTITION BY doc_id ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
  FROM found AS f JOIN owned USING (value) WHERE kind < 3 OR (owners = 1 AND repositories < 10)),
spans AS (SELECT *, name || ':' || start || ':' || stop AS span FROM kept WHERE kind < 3 OR reached IS NULL OR reached < stop),
texts AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN texts USING (doc_id)"""


@query("op12_secret_scan", _SECRETS_SQL)
def op12(table):
    """Secrets of every document; a document is a repository, its source the owner."""
    return credentials.reported(*credentials.findings(table("documents"), repository="doc_id", owner="source"))


@query("op13_hard_negatives", """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
a AS (SELECT * FROM e WHERE vec_id % 50 = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS other, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
  FROM a JOIN e ON a.vec_id <> e.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positives AS p JOIN scores AS s ON p.anchor_id = s.anchor_id AND NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 3""")
def op13(table):
    """Hard negatives of every fiftieth vector; every seventh label is moved by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table("embeddings").withColumn("label", moved), every=50)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@dataclass(frozen=True)
class PipelineQuery:
    name: str
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pipeline(ready(spark), sf_dir)


LLM_QUERIES["pipeline"] = PipelineQuery("pipeline", None)
