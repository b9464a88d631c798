"""A corpus pipeline: quality, line dedup, near duplicates, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumen.llm import lines, mixing, ngram_join, packing, quality
from lumen.llm.common import stage
from lumen.llm.queries import remainder, table, tokenizer


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled rows among docs."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return quality.keep_good(docs, model)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source."""
    return lines.drop_boilerplate_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers of copies that bring their sources to the target weights."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in token sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", good), ("line_dedup", without_boilerplate), ("near_duplicates", without_near_duplicates), ("mix", mix), ("pack", pack)]

#: No SQL: the classifier and the tokenizer cannot be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
