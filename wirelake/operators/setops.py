"""Unions, differences, de-duplication and merges of row sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.scale import top_rows


def union_zones(assigned: DataFrame, unassigned: DataFrame) -> DataFrame:
    return assigned.unionByName(unassigned.withColumn("zone", F.lit("unassigned")))


def union_directions(out_df: DataFrame, in_df: DataFrame, item: str) -> DataFrame:
    both = out_df.withColumn("direction", F.lit("outgoing")).unionByName(in_df.withColumn("direction", F.lit("incoming")))
    return both.filter(F.col(item).isNotNull())


def set_diff(a: DataFrame, b: DataFrame, mode: str) -> DataFrame:
    return {"common": a.intersect, "only_left": a.subtract, "only_left_all": a.exceptAll}[mode](b)


def missing_fields(df: DataFrame, required: list[str], key: str = "id") -> DataFrame:
    """Required fields that are null or blank; a column that is not there counts as missing."""
    present = F.array_compact(F.array(*[
        F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", F.lit(c)) for c in required if c in df.columns]))
    return df.select(key, F.array_except(F.array(*[F.lit(c) for c in required]), present).alias("missing")).filter(F.size("missing") > 0)


def merge_netlists(nets: DataFrame, by_name: bool = False) -> DataFrame:
    """Nets of all pages of a document with connection counts; ``by_name`` joins same-named nets.

    ``nets``: ``doc, name, page, component_id, pin``.
    """
    keys = ["doc", "name"] if by_name else ["doc", "page", "name"]
    return nets.groupBy(*keys).agg(
        F.count_distinct("component_id", "pin").alias("connections"), F.count_distinct("page").alias("pages"),
        F.min("page").alias("first_page"))


def union_results(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def distinct_first_seen(df: DataFrame, key: list[str], column: str, position: str) -> DataFrame:
    return df.groupBy(*key, column).agg(F.min(position).alias("first_seen"))


def best_per_key(df: DataFrame, keys: list[str], score: Column, tie: list[Column]) -> DataFrame:
    return top_rows(df, keys, [score.desc(), *tie], 1).drop("rank")


def dedup_edges(edges: DataFrame, keys: tuple[str, ...] = ("src", "dst", "rel_type")) -> DataFrame:
    return edges.dropDuplicates(list(keys))


def apply_updates(df: DataFrame, updates: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Set ``{column: update_column}`` where the update has a value; other rows stay as they are."""
    joined = df.join(updates.select(*keys, *columns.values()), keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(u), F.col(c)) for c, u in columns.items()}).select(*df.columns)
