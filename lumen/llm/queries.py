"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, lines, maxent, mixing, ngram_join, packing, quality, search, secrets, shards


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate_lines(table(spark, sf_dir, "documents")).select("doc_id", "text")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.top_documents_by_documents(docs, queries)


def op4_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return search.top_documents(table(spark, sf_dir, "documents"), queries)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, vocabulary = maxent.fit(docs, remainder(10) != 0)
    scored = maxent.score(docs, model, vocabulary)
    return scored.select("doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.byte_shards(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    table_ = secrets.train(secrets.labelled_samples(spark, docs))
    return secrets.digest(secrets.find_secrets(docs, table_))


def remainder(k: int) -> Column:
    """crc32 of doc_id as text, modulo k."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return quality.score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_best_fit_packing, op3_ngram_jaccard_join, op4_bm25_documents, op4_bm25_search, op5_source_mixing, op6_maxent_scores, op7_nearest_neighbours, op8_byte_shards, op9_secret_scan, op10_quality)}
ORACLES = {"op1_line_dedup": lines.SQL, "op4_bm25_documents": search.DOCUMENTS_SQL, "op4_bm25_search": search.SQL}
