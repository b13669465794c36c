"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the byte-level ranks and decoded again; a null text is empty."""
    from .byte_bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's fingerprint, its edited text's, and its likeness to that and to the next document's."""
    from .fingerprints import compared_with_next

    return compared_with_next(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every text; a token that crosses lines goes where it starts."""
    from .token_counts import section_token_counts

    return section_token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; empty if it has none."""
    from .html_text import extracted

    return extracted(_table(spark, sf_dir, "pages"))


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed matrix of all texts in sequences of 4096 tokens, ids and positions as binaries."""
    from .packing import packed_matrix

    return packed_matrix(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: an explicit rule's, else that of its host's reputation."""
    from .url_reputation import judged_urls

    # a labelled page is one whose id has a label: bad if it is of low quality or toxic
    labels = _table(spark, sf_dir, "labels").selectExpr("doc_id AS page_id", "quality = 0 OR toxic = 1 AS bad")
    return judged_urls(_table(spark, sf_dir, "pages"), labels)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict by the thresholds of its language and source."""
    from .quality import judged

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs, ["doc_id"])


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and the least id that similarity links reach."""
    from .ngram_jaccard import similarity_components

    return similarity_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language and certainty."""
    from .language_id import identified

    return identified(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code, its error and its label's."""
    from .vector_codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words; a tenth of them first get a tail that repeats itself."""
    from .periodic_runs import periodic_runs, repeated_tail, run_digests

    return run_digests(periodic_runs(_table(spark, sf_dir, "documents"), text_col=repeated_tail()))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the least id that links of at most three differing bits reach."""
    from .simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four stages of corpus_pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_fingerprints, op3_token_counts, op4_html_text, op5_packed_ids, op6_quality_rules, op7_url_reputation, op8_ngram_jaccard, op9_best_fit_packing, op10_language_id, op11_vector_codes, op12_periodic_runs, op13_simhash, pipeline)}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
