"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.llm import alignment, linerules, lines, mixing, neardup, ngrams, packing, phrases, pii, tokencount, toxicity, vectors
from wirelake.llm.common import table
from wirelake.llm.registry import query
from wirelake.llm.tokens import public_file
from wirelake.session import cut


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = mixing.word_count(F.col("text")).alias("size")
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", size))
    return mixing.taken_words(rows).drop("row_id")


@query("op3_neighbours")
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, "vec_id", "embedding", k=5)


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_file("word_bpe_49k.json"))


@query("op9_vector_dedup")
def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", cosine=0.95)


@query("op2_minhash")
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=75)


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.toxic_documents(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", "severity", "grade", "toxic_chance", (F.col("toxic_chance") >= toxicity.REJECT).alias("toxic"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_file("piece_bpe_32k.model"))


@query("op6_language_model")
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.language_scores(table(spark, sf_dir, "documents"))


@query("op1_surrogates")
def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.replace_entities(docs.select("doc_id", "text"), key=b"surrogates of the documents table")


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.near_lines(docs.withColumn("row_id", F.monotonically_increasing_id())).drop("row_id")


@query("op11_line_rules", linerules.oracle())
def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.cleaned_documents(table(spark, sf_dir, "documents")).drop("clean_text")


@query("op12_phrases", phrases.oracle())
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_counts(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model"))
