"""The registered queries of this subpackage, with SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, licenses, merkle, packing, partenum, passages, simhash, spelling, substrings, token_counts, toxicity, urls, vectors
from .common import table


def _tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages that documents share; cases as in passages.repeated_passages()."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in documents; cases as in decontamination.find_items()."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-match token counts of documents; cases as in token_counts.token_counts()."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _tokenizer())


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of documents; cases as in licenses.scan()."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best inner products of every twentieth vector; cases as in vectors.top_k()."""
    return vectors.top_k(table(spark, sf_dir, "embeddings"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages; cases as in urls.judged_pages()."""
    return urls.judged_pages(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of documents; cases as in toxicity.judged()."""
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes, and the bytes that those of 240 cover; cases as in substrings.repeat_report()."""
    return substrings.repeat_report(table(spark, sf_dir, "documents"), short=240)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of documents in sequences of 1024; cases as in packing.pack()."""
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components of documents; cases as in simhash.near_duplicates()."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaves, roots and proofs of documents; cases as in merkle.manifest()."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents under a four-word Jaccard similarity of 0.85; cases as in partenum.joined()."""
    return partenum.joined(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of documents; cases as in spelling.variants()."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_passages, op2_decontamination, op3_token_counts, op4_licenses, op5_top_k, op6_urls, op7_toxicity, op8_substrings,
        op9_packing, op10_simhash, op11_merkle, op12_jaccard, op13_spelling,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
    n AS (SELECT *, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i + 1 : i + size], ' ') AS g
        FROM (SELECT *, unnest(range(0, len(w) - size + 1)) AS i FROM n)),
    sizes AS (SELECT DISTINCT size FROM n),
    grams AS (SELECT rid, i, size, array_to_string(w[i + 1 : i + size], ' ') AS g
        FROM (SELECT rid, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
    hits AS (SELECT rid, i, size, item_id FROM grams JOIN windows USING (size, g)),
    words AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS place FROM
        (SELECT DISTINCT rid, i, size FROM hits)) GROUP BY rid),
    items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
        (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)""",
    "op4_licenses": licenses.scan_sql(),
    "op5_top_k": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
        vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 20""",
    "op6_urls": urls.pages_sql(),
    "op8_substrings": substrings.report_sql(),
    "op11_merkle": merkle.manifest_sql(),
    "op12_jaccard": partenum.joined_sql(),
    "op13_spelling": spelling.variants_sql(),
}
