"""A corpus clean-up over ``documents``: quality rules, language ID, near-duplicate removal, best-fit packing."""

from __future__ import annotations

import os
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.language_id import predicted, train
from colloquy.llm.ngram_jaccard import similarity_components
from colloquy.llm.packing import pack
from colloquy.llm.quality import judged
from colloquy.llm.runtime import small, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Language ID rejects a document whose language it is less sure of than this, besides those without a letter.
LEAST_SCORE = 0.05


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality rules keep. Null, empty and short texts go (the base rule); repeated rows stay; a null language or
    source is a group of its own; texts are measured whole, however long; columns beyond those of documents are left out."""
    return judged(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no recognisable language. Null and empty texts go; null languages and ids are
    never learned from, but their texts are judged; repeated rows stay; very long texts are scored whole."""
    docs = docs.select(*COLUMNS)
    return predicted(docs, train(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of linked documents; of repeated rows, one. Texts without words are linked
    with nothing and stay; a null id goes if its group has another; very long texts count with all their shingles."""
    docs = docs.select(*COLUMNS)
    found = stage(similarity_components(docs).select("doc_id", "component_id"), "components")
    gone = stage(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    again = stage(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    same = lambda ids: docs["doc_id"].eqNullSafe(ids["doc_id"])
    gone, again = small(gone, 24), small(again, 24)
    kept = docs.join(gone, same(gone), "left_anti").join(again, same(again), "left_anti")
    repeated = docs.join(again, same(again), "left_semi").join(gone, same(gone), "left_anti").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(repeated)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 4096 tokens: one row per piece. Null and empty texts are the end token alone, very
    long ones several pieces; repeated rows are packed each; an empty table gives no row."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("language_id", language), ("ngram_jaccard", near_duplicates), ("best_fit_packing", packing)]
#: Language ID and packing have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written and read again before the next."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    return reduce(lambda df, step: stage(step[1](spark, df, sf_dir), step[0]), STAGES[:-1], docs).transform(lambda df: STAGES[-1][1](spark, df, sf_dir))
