"""Tables dealt into fixed blocks, so that joins and counts by block need no shuffle.

A block is a share of one input split, or what one partition of a shuffle holds.  Work that needs values of the whole corpus counts them per block first,
adds the counts up by value, and sends each block the totals of the values that occur in it.  No value is hot this
way: it travels once per block, however often it occurs there.
"""

from __future__ import annotations

import math
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an input split that make a block.
BLOCK_BYTES = 8 << 20
#: More buckets than this are refused by Spark's default settings.
MOST_BLOCKS = 100_000


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold for what is executed inside, and are put back after it."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: Tables bucketed by block meet without a shuffle when they are joined by the block and more columns, and are
#: read in the order in which they were written.
CO_LOCATED = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def block_keys(spark: SparkSession, blocks: int) -> list[int]:
    """One number for each bucket of ``blocks``, so that numbered blocks fill the buckets evenly."""
    tried = 32 * blocks
    while True:
        bucket = F.pmod(F.hash("id"), F.lit(blocks))
        rows = spark.range(tried).groupBy(bucket.alias("bucket")).agg(F.min("id").alias("key")).collect()
        if len(rows) == blocks:
            return [row["key"] for row in sorted(rows, key=lambda row: row["bucket"])]
        tried *= 2


def byte_size(text: str) -> int:
    """A size as Spark's settings give it: ``134217728b``, ``16m``, ``1g``."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", text.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit[:1]]


class Blocks:
    """Bucketed tables of one job; ``close`` removes those that are left."""

    def __init__(self, spark: SparkSession, partitions: int, parts: int = 1):
        self.spark, self.parts = spark, parts
        # a multiple of the parts, so that a block has the same part of each of its partitions
        self.number = max(1, min(MOST_BLOCKS // parts, partitions)) * parts
        self.keys = block_keys(self.spark, self.number)
        self.names: list[str] = []

    @classmethod
    def of_splits(cls, source: DataFrame) -> Blocks:
        """Blocks for a table that is read from files: each split is dealt into parts of about ``BLOCK_BYTES``."""
        split = byte_size(source.sparkSession.conf.get("spark.sql.files.maxPartitionBytes"))
        return cls(source.sparkSession, source.rdd.getNumPartitions(), max(1, math.ceil(split / BLOCK_BYTES)))

    @classmethod
    def of_shuffles(cls, spark: SparkSession) -> Blocks:
        """As many blocks as a shuffle has partitions."""
        return cls(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def place(self) -> tuple[Column, Column]:
        """The block of a row of a split or partition, and a number that is the row's own in its block.

        Both are the same when a task runs again.
        """
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        at = F.spark_partition_id().cast("bigint") * self.parts
        keys = F.array(*[F.lit(k).cast("bigint") for k in self.keys])
        block = F.element_at(keys, (F.pmod(at + F.pmod(row, F.lit(self.parts)), F.lit(self.number)) + 1).cast("int"))
        return block.alias("block"), (F.shiftleft(F.floor(at / self.number), 33) + row).alias("seg")

    def write(self, rows: DataFrame, *order: str) -> DataFrame:
        """``rows`` (with ``block``) as a table in the shared warehouse, each block in the given order."""
        name = f"wirelake_{uuid.uuid4().hex}"
        out = rows.write.format("parquet").option("compression", "zstd").bucketBy(self.number, "block")
        (out.sortBy("block", *order) if order else out).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def to_blocks(self, rows: DataFrame) -> DataFrame:
        """``rows`` where the bucketed tables have their blocks."""
        return rows.repartition(self.number, "block")

    def drop(self, table: int) -> None:
        """Remove the table that was written at this place in order, and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.names[table]}")

    def close(self) -> None:
        for i in range(len(self.names)):
            self.drop(i)
