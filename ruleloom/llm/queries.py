"""Queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed, lengths, media, neardup, packing, pieces, quality, secrets, suffix, urls
from .common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))
    n = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{secrets.KINDS[kind]}")
    return found.select("doc_id", n(0), n(1), n(2), F.sha2(secrets.listed("__base").cast("binary"), 256).alias("base_sha256"), secrets.listed("__spans").alias("spans"))


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for a list of bad URLs: the canonical URLs of pages whose id is labelled toxic."""
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host_of(F.col("url")).alias("h"), urls.path_of(F.col("url")).alias("p"))
    return pages.join(bad, "page_id", "left_semi").select(urls.canonical(F.col("h"), F.col("p")).alias("canonical"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), listed_urls(spark, sf_dir)).drop("url")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.trained(docs, table(spark, sf_dir, "labels"), quality.learnable())
    got = quality.scored(docs, model)
    return got.select("doc_id", F.coalesce(~quality.learnable(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, threshold=0.8).drop("h0", "h1")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.histogram(table(spark, sf_dir, "documents")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_url_filter, op3_quality, op4_sentencepiece, op5_media_columns, op6_minhash_dedup, op7_suffix_dedup, op8_packing, op9_token_counts, op10_embedding_dedup)}

_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)"
# the rules, longest first, spelled out so that a wrong rule in the code shows
_CASE = lambda what: " ".join(["CASE", *(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(r, v)[what]}'" for h, p, r, v in (
    ("example.com", "/en/7", "example.com/en/7", "allow"),
    ("example.net", "/de/8", "example.net/de/8", "block"),
    ("com", "/en/", "com/en/", "block"),
    ("net", "/de/", "net/de/", "allow"),
    ("org", "/es/", "org/es/", "block"),
)), "END"])

OP2_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM cut),
named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/)$', '') END AS canonical,
    {_CASE(0)} AS rule, {_CASE(1)} AS says FROM parts
), listed AS (SELECT DISTINCT canonical FROM named WHERE page_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND canonical IS NOT NULL)
SELECT page_id, host, path, rule, CASE WHEN says IS NOT NULL THEN says WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM named
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w
), x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * c >= 80 * (len(sa.sh) + len(sb.sh) - c)),
reach(s, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.s, l.b FROM reach JOIN l ON reach.t = l.a),
c AS (SELECT s AS doc_id, min(t) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.doc_id
"""
OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(s, t) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.s, l.b FROM reach JOIN l ON reach.t = l.a),
c AS (SELECT s AS vec_id, min(t) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c ON e.vec_id = c.vec_id LEFT JOIN n ON e.vec_id = n.vec_id
"""

ORACLES = {"op2_url_filter": OP2_SQL, "op6_minhash_dedup": OP6_SQL, "op10_embedding_dedup": OP10_SQL}
