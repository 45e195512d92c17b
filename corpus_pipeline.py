"""The corpus pipeline: STAGES in order, each on all that its predecessor kept.

Every stage takes documents with nulls in any column and further columns of any name, which stay with their rows. A null
text counts as empty: it is never toxic, equals other empty texts, is like no other, and has no tokens. Rows repeated with
their doc_id and text are one document from the second stage on. A null doc_id sorts below all others, and a null source is
a source of its own. Texts are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmill.llm import exact_dedup, ngram_join, sentencepiece_bpe, source_mix, toxicity
from textmill.llm.common import materialize, small_batches, table
from textmill.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from the labelled ones among docs. Without labels none goes."""
    small_batches(spark)
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    small_batches(spark)
    return exact_dedup.deduplicate(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of a Jaccard similarity of 0.75 connect, the one with the smallest doc_id stays; those without
    doc_id stay too."""
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def source_mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, put in the order of the mix: file after file, and from the first row of each to its last."""
    small_batches(spark)
    return source_mix.mixed_order(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with the digests of ids and decoded text, its place in the mix, and if it is in the mix."""
    small_batches(spark)
    placed = source_mix.with_positions(docs)
    return sentencepiece_bpe.sentencepiece(placed, tokenizer_path("piece_bpe_32k.model"), keep_text=False, carry=("mix_position", "in_mix"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("source_mix", source_mix_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    A row for each document that stays: doc_id, n_tokens, ids, ids_sha256, decoded_sha256, mix_position and in_mix."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Toxicity, mixing and encoding have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None
