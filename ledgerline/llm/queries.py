"""The registered queries of this subpackage, each next to its SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    bpe,
    embeddings,
    exact_dedup,
    filter_audit,
    jaccard_join,
    language,
    licenses,
    lm_score,
    mixing,
    packing,
    records,
    runs,
    secrets,
)
from ledgerline.llm.common import documents, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def put(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return put


@_register("op1_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to."""
    return bpe.encoding_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@_register("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language.labelled(documents(spark, sf_dir))


@_register("op3_lm_score")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked pseudo-likelihood of every document."""
    return lm_score.scored(documents(spark, sf_dir))


@_register(
    "op4_mixing",
    r"""
WITH sized AS (
  SELECT doc_id, source, text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM sized GROUP BY source),
-- Sources in the order in which a rising level makes them stop at 3 times their size.
stops AS (
  SELECT *, sum(source_size) OVER () AS words,
         coalesce(sum(3 * source_size) OVER o, 0) AS spent,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights
  FROM sources
  WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT words - spent AS rest, weights FROM stops
  WHERE NOT (3 * source_size * weights <= weight * (words - spent))
  ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT s.source, s.source_size,
         CASE WHEN l.rest IS NULL OR 3 * s.source_size * l.weights <= s.weight * l.rest
              THEN (3 * s.source_size)::DOUBLE
              ELSE (s.weight * l.rest)::DOUBLE / l.weights::DOUBLE END AS target
  FROM sources s LEFT JOIN level l ON true),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0
              THEN least(round(t.target / t.source_size * 16777216)::BIGINT, 3 * 16777216) ELSE 0 END AS each,
         row_number() OVER (
           PARTITION BY d.source
           ORDER BY length(bin(d.size)) * 4 + d.size * 4 // (1::BIGINT << (length(bin(d.size)) - 1)::INTEGER),
                    md5('7:' || d.doc_id), d.doc_id NULLS LAST, md5(d.text)) AS place,
         ('0x' || substr(md5('7:offset:' || coalesce('=' || d.source, '')), 1, 6))::BIGINT AS moved
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, ((place * each + moved) >> 24) - ((place * each + moved - each) >> 24) AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and words taken of every document."""
    plan = mixing.mixed(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


@_register(
    "op5_exact_dedup",
    r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
groups AS (
  SELECT body, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id
  FROM keyed GROUP BY body)
SELECT k.doc_id, g.keep_id, g.group_size, k.doc_id = g.keep_id AS kept, sha256(k.body) AS text_sha256
FROM keyed k JOIN groups g USING (body)
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy that stays of every document."""
    return exact_dedup.exact_groups(documents(spark, sf_dir))


@_register(
    "op8_embedding_near_dedup",
    """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id != b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT DISTINCT a AS node, a AS other FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.low, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.low, e.vec_id) AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT node, min(other) AS low FROM reach GROUP BY node) c ON c.node = e.vec_id
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector."""
    return embeddings.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_register("op9_token_records")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files of all documents, read back."""
    folder = new_folder(spark, "records")
    records.write_records(documents(spark, sf_dir), f"{folder}/data", public_tokenizers.path("word_bpe_49k.json"))
    index = records.write_index(spark, f"{folder}/data", f"{folder}/index")
    return records.record_digests(index)


@_register(
    "op6_jaccard_join",
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT DISTINCT a AS node, a AS other FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c.low, s.doc_id) AS component_id
FROM sets s LEFT JOIN (SELECT node, min(other) AS low FROM reach GROUP BY node) c ON c.node = s.doc_id
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard_join.near_groups(documents(spark, sf_dir))


@_register("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence statement in the documents."""
    return licenses.license_matches(documents(spark, sf_dir))


@_register("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.secret_scan(documents(spark, sf_dir))


@_register(
    "op11_filter_audit",
    r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
failed AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM words),
said AS (
  SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN said USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
gone AS (
  SELECT m.*, o.filter_order,
         coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda s: contains(m.fails, substr(o.filter_order, s, 1)))), 6) AS gone_at
  FROM masks m, orders o),
counted AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f,
         sum(CASE WHEN gone_at > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone_at < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone_at = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN gone_at = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM gone, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each order, by source."""
    failed = filter_audit.failures(documents(spark, sf_dir))
    return filter_audit.interaction_audit(filter_audit.with_labels(failed, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def repeating_part(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document as op12 looks at them: in one of ten documents, by
    a hash of the id, the end repeats some words. Without an id they stay."""
    seed, kind = divmod(zlib.crc32(str(doc_id).encode()), 10)
    n = len(words)
    if doc_id is None or kind or not n:
        return words
    a = seed % n
    p = 1 + (n - a) // (3 + seed % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


@_register("op12_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document."""
    return runs.run_report(documents(spark, sf_dir), rewrite=repeating_part)


@_register("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences."""
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
