"""A training-data pipeline over ``documents``: each stage reads all that its predecessor kept.

A stage takes ``(spark, docs, sf_dir)``; its result is written and reread as the next one's ``docs``.
All but the last return the columns of ``documents``.  Null and empty texts pass every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.llm import lines, mixing, neardup, packing, toxicity
from wirelake.llm.common import table
from wirelake.llm.registry import Item
from wirelake.llm.tokens import public_file
from wirelake.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    scored = toxicity.toxic_documents(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col("toxic_chance") < toxicity.REJECT).select(*docs.columns)


def drop_near_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, exactly or nearly, stay once in the corpus; documents all stay."""
    return lines.without_near_lines(docs)


def drop_near_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its words up to its target; a document can appear up to three times, or in part."""
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document of the mix in a sequence of 2048 tokens."""
    return packing.pack_documents(docs, public_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_near_lines),
    ("near_dedup", drop_near_documents),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: None: the stages fit a model, draw sketches and tokenize, which SQL cannot say.  tests/llm/ holds
#: each stage against a plain version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs


ITEM = Item(run, ORACLE_SQL)
