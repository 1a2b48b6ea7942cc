"""Catalogue queries of the corpus operators: one ``opN_<name>`` each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waitwise.llm import ann, blocknames, decontaminate, htmltext, mixing, ngramjoin, pii, quality, repeats, sharding, tokalign, urlfilter, whitening
from waitwise.llm.common import stored, table

#: Production rules of op2: action, host, path.
URL_RULES = [urlfilter.Rule("allow", "com", "/"), urlfilter.Rule("block", "example.com", "/en/"),
             urlfilter.Rule("allow", "www.example.com", "/en/"), urlfilter.Rule("block", "net", "/es/"),
             urlfilter.Rule("block", "net", "/fr/")]
SHARDS, NEIGHBOURS, QUERY_EVERY = 8, 20, 20
#: Key of the surrogates; a real run sets its own.
PII_KEY = "corpus-surrogates"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.count_links(table(spark, sf_dir, "documents"))


def op2_bloom_cascade_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("url")


def op3_onebit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0), NEIGHBOURS)


def op4_mix_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing.fit_domains(docs, table(spark, sf_dir, "labels"))
    members = stored(mixing.classify(docs, model, ["doc_id"]), "mixing-members")
    return mixing.mixing_plan(members, mixing.fit_rates(members, model, mixing.TARGETS), model)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digest(table(spark, sf_dir, "documents"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, PII_KEY)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination_digest(decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), keep_text=False))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op10_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokalign.alignment_digest(table(spark, sf_dir, "documents"))


def op12_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_rows(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.duplicate_groups(table(spark, sf_dir, "documents")).drop("row")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_bloom_cascade_urls, op3_onebit_neighbours, op4_mix_domains, op5_suffix_dedup,
    op6_pii_surrogates, op7_decontaminate, op8_main_text, op9_jump_shards, op10_byte_cnn_quality,
    op11_token_alignment, op12_whiten_embeddings, op13_exact_dedup)}

_HOST = "CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') ELSE '' END"
_PATH = r"CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"

ORACLES: dict[str, str] = {
    "op2_bloom_cascade_urls": f"""
WITH parsed AS (
  SELECT page_id, coalesce(translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce({_PATH}, '') AS path
  FROM pages),
rules(action, rhost, rpath) AS (VALUES {", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in URL_RULES)}),
fits AS (
  SELECT page_id, host, path, action, rhost || rpath AS rule,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM (SELECT DISTINCT page_id, host, path FROM parsed) JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON f.k = 1 AND f.page_id IS NOT DISTINCT FROM p.page_id AND f.host = p.host AND f.path = p.path""",
    "op7_decontaminate": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i:i + least(10, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.win = x.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.listed, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hits h USING (doc_id) LEFT JOIN ids i USING (doc_id)""",
    "op13_exact_dedup": """
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM texts""",
}
