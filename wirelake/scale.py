"""Building blocks that keep order-dependent work spread out when one key is hot.

A window over ``PARTITION BY key`` puts all rows of a key into one task.  Here the rows are first
range-partitioned by ``keys + order``; each range is a block, a hot key covers many blocks, and
only one row per (key, block) is needed to carry state from one block to the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.session import cut

BLOCK = "_block"


def _names(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def ordered_blocks(df: DataFrame, keys, order: list[Column]) -> DataFrame:
    """Add ``_block``: consecutive ranges of ``keys + order``, fixed by a checkpoint."""
    keys = _names(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return cut(ranged.withColumn(BLOCK, F.spark_partition_id()))


def number_rows(df: DataFrame, keys, order: list[Column], name: str = "rn") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without one task per key."""
    keys = _names(keys)
    blocks = ordered_blocks(df, keys, order)
    sizes = blocks.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(BLOCK).alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    on = [blocks[k].eqNullSafe(offsets[f"_k{i}"]) for i, k in enumerate(keys)]
    on.append(blocks[BLOCK] == offsets["_b"])
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    joined = blocks.join(offsets, reduce(lambda a, b: a & b, on))
    out = joined.withColumn(name, (F.row_number().over(inside) + F.col("_offset")).cast("bigint"))
    return out.select(*df.columns, name)


def lag_rows(df: DataFrame, keys, order: list[Column], columns: dict[str, str]) -> DataFrame:
    """``lag(col) over (partition by keys order by order)`` for each ``{new_name: col}``."""
    keys = _names(keys)
    blocks = ordered_blocks(df, keys, order)
    # the last row of a block is the one with the largest in-block number
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    numbered = blocks.withColumn("_rn", F.row_number().over(inside))
    for new, old in columns.items():
        numbered = numbered.withColumn(new, F.lag(old).over(inside))
    carried = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    tails = numbered.groupBy(*keys, BLOCK).agg(F.max_by(carried, "_rn").alias("_tail"))
    previous = Window.partitionBy(*keys).orderBy(BLOCK)
    heads = tails.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(BLOCK).alias("_b"),
        F.lag("_tail").over(previous).alias("_head"),
    )
    on = [numbered[k].eqNullSafe(heads[f"_k{i}"]) for i, k in enumerate(keys)]
    on.append(numbered[BLOCK] == heads["_b"])
    joined = numbered.join(heads, reduce(lambda a, b: a & b, on))
    for new in columns:
        joined = joined.withColumn(
            new, F.when(F.col("_rn") == 1, F.col(f"_head.{new}")).otherwise(F.col(new))
        )
    return joined.select(*df.columns, *columns)


def running_sum(df: DataFrame, keys, order: list[Column], value: Column, name: str) -> DataFrame:
    """Inclusive ``sum(value) over (partition by keys order by order)``, block by block."""
    keys = _names(keys)
    blocks = ordered_blocks(df.withColumn("_v", value), keys, order)
    sums = blocks.groupBy(*keys, BLOCK).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(BLOCK).alias("_b"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"),
    )
    on = [blocks[k].eqNullSafe(offsets[f"_k{i}"]) for i, k in enumerate(keys)]
    on.append(blocks[BLOCK] == offsets["_b"])
    inside = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = blocks.join(offsets, reduce(lambda a, b: a & b, on))
    return joined.withColumn(name, F.sum("_v").over(inside) + F.col("_offset")).select(
        *df.columns, name
    )


def top_rows(df: DataFrame, keys, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    ``row_number() <= k`` is turned by Spark into a limit that runs before the shuffle, so each
    task forwards at most ``k`` rows per key and a hot key stays small.
    """
    window = Window.partitionBy(*_names(keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).filter(F.col(rank) <= k)


def share_of(df: DataFrame, keys, value: str, total: str) -> DataFrame:
    """Add the per-key total of ``value`` by aggregate and join, not by window."""
    keys = _names(keys)
    totals = df.groupBy(*keys).agg(F.sum(value).alias(total))
    return df.join(totals, keys)


def best_readings(readings: DataFrame, key: list[str]) -> DataFrame:
    """``key, engine, r``: the most confident reading ``r (confidence, text)`` of each engine.

    The rows are shuffled by ``key`` alone, so a later aggregate by ``key`` needs no shuffle of its own.
    """
    near = readings.select(*key, "engine", "confidence", "text").repartition(*key)
    return near.groupBy(*key, "engine").agg(F.max(F.struct("confidence", "text")).alias("r"))
