"""The opN_* queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), capacity=1024, end_id=2)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score

    return score(common.table(spark, sf_dir, "documents"), folds=7, held=2)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_graph import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fingerprints_with_edits

    return fingerprints_with_edits(common.table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), folds=5)


#: Shares of all tokens for documents of quality 0 and 1.
QUALITY_TARGETS = [0.1, 0.9]


def quality_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label: the labelled table's quality is the domain that mixing works on."""
    labels = common.table(spark, sf_dir, "labels")
    return labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("label"))


def op7_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import rates

    return rates(common.table(spark, sf_dir, "documents"), quality_domains(spark, sf_dir), QUALITY_TARGETS, tokenizer_path(BYTE_BPE))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(common.table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), limit=512)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    manifest = token_files.write(common.table(spark, sf_dir, "documents"), common.scratch(spark, "tokens"), tokenizer_path(WORD_BPE), end_id=2)
    return token_files.read(spark, manifest)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    files = warc.write(common.table(spark, sf_dir, "pages"), common.scratch(spark, "warc"), smallest=0)
    return warc.page_records(warc.read(spark, files))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_simhash_near_dedup, op3_lm_scoring, op4_embedding_near_dedup, op5_merkle_fingerprints, op6_toxicity, op7_mixing_to_targets, op8_token_counts, op9_token_files, op10_warc)}

#: The others apply hashes, models or tokenizers that SQL lacks; tests hold them against brute force.
ORACLES = {
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95 AND NOT isnan(list_cosine_similarity(a.e, b.e))),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b),
c AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)""",
    "op10_warc": """
WITH b AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, strlen(h) AS n, x, array_to_string(list_transform(string_split(x, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits FROM b),
e AS (SELECT page_id, n, max(page_id) OVER (PARTITION BY x) AS best, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS digest FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM e""",
}
