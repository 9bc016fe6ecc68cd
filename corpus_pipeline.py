"""From raw documents to packed training sequences, one operator a stage."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsflow.llm import line_crf, near_dedup, packing, repetition, suffix_dedup
from newsflow.llm.common import table
from newsflow.scratch import materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field finds good on the whole."""
    return line_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are long enough and don't repeat themselves much."""
    return repetition.keep_unrepetitive(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return near_dedup.keep_first(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one holds; ``n_chars`` follows."""
    cut = suffix_dedup.cut_repeats(docs, kept_text=True)
    return cut.select(*[F.col("text") if c == "text" else
                        F.length("text").cast("bigint").alias(c) if c == "n_chars" else
                        F.col(f"row.`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of 2048 tokens."""
    return packing.packed_pieces(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_rules),
          ("MinHash near-dedup", minhash_near_dedup), ("suffix-array dedup", suffix_array_dedup),
          ("best-fit packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: SQL has neither the classifier nor the tokenizer; tests hold the stages to brute force.
ORACLE_SQL = None
