"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.session import cut, ensure_checkpoint_dir

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; read by Spark, so the folder can be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z in lower case; ``bytes.split`` splits at exactly the ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, which bounds what one step holds in memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, as a plain path that tasks can map into memory.

    Memory mapping needs a mounted file system; a store without one is refused rather than replaced
    by a folder of one machine.
    """
    ensure_checkpoint_dir(spark)
    place = urlparse(spark.sparkContext.getCheckpointDir())
    if place.scheme not in ("", "file"):
        raise RuntimeError("memory-mapped arrays need spark.checkpoint.dir on a mounted file system")
    path = f"{place.path.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    return path


def save_array(path: str, array: np.ndarray) -> None:
    """Write one array under its final name in one step, so a repeated task replaces it whole."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, path)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(id, component)`` for every end of an edge ``(u, v)``; ``component`` is the smallest id reached.

    Alternating large-star and small-star steps (distributed union-find): each round is an aggregate
    and a join and is written to the shared folder.  Rounds grow with the logarithm of the longest
    path.  A hub costs one aggregated row per task.
    """
    links = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join below has two plain sides and a hub's rows can be split over tasks
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter("u <> v").distinct()
        links = cut(small)
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            roots = links.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
            return cut(links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots))
        before = now
    raise RuntimeError("components did not settle")


def fold(columns: list[Column], combine: Callable[[Column, Column], Column]) -> Column:
    out = columns[0]
    for column in columns[1:]:
        out = combine(out, column)
    return out
