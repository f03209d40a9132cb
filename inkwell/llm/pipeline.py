"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs; all but the last return the columns of documents. A null text is dropped with the first
stage, as it has no language; an empty table stays empty. Rows that repeat doc_id and text are one document
from the Jaccard join on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import jaccard_join, language, line_dedup, mixing, packing
from inkwell.llm.common import WORD, Scratch, free_name, free_shuffles, table
from inkwell.llm.tokens import tokenizer_path


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models reject go. Learned from labelled rows, chosen by hash."""
    free_shuffles(spark)
    models = language.train(language.training_rows(docs, F.lit(True)), Scratch(spark, "p-language"))
    return language.accepted_rows(docs, models)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays. Documents of which no word is left go: all they said stays elsewhere."""
    removed = free_name(docs, "removed")
    out = line_dedup.dedup_lines(docs, Scratch(spark, "p-lines"), removed)
    return _counted(out.filter((F.col(removed) == 0) | F.col("text").rlike(WORD)), docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.one_per_group(docs, Scratch(spark, "p-jaccard"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; a row for every pass in which something of a document is taken."""
    free_shuffles(spark)
    mixed, _, _ = mixing.mix(docs, scratch := Scratch(spark, "p-mix"))
    return _counted(mixing.with_text(scratch.cut(mixed, "mixed"), docs, free_name(docs, "turn")), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences packed into windows of 2048."""
    free_shuffles(spark)
    return packing.pack(docs, Scratch(spark, "p-pack"), tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the language models, MinHash or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
