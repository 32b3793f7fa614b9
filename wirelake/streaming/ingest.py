"""Ingest of arriving rows into a table by key that survives a restart.

The table is a folder with versions of partitions, ``data/version=e/part=p``, and one manifest per epoch that says which
version of each partition is valid.  A batch merges its rows into the partitions that it touches, writes these as its own
epoch, and its manifest last, as one file.  What was written before a failure without a manifest is overwritten when the
batch runs again; a batch whose manifest exists changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "part string, version long, epoch long"


def manifest(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """``part, version`` of the newest epoch, or of the newest one below ``before``; no rows for a new table."""
    try:
        every = spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).parquet(f"{base}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "part string, version long")
    valid = every if before is None else every.filter(F.col("epoch") < before)
    newest = valid.agg(F.max("epoch").alias("epoch"))
    return valid.join(F.broadcast(newest), "epoch").select("part", "version")


def committed(spark: SparkSession, base: str, epoch: int) -> bool:
    try:
        return spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).parquet(f"{base}/manifest").filter(F.col("epoch") == epoch).limit(1).count() > 0
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _versions(spark: SparkSession, base: str, schema: str, valid: DataFrame) -> DataFrame:
    """The rows of the given versions of partitions; other files are pruned by the join."""
    if valid.isEmpty():
        return spark.createDataFrame([], f"{schema}, part string")
    rows = spark.read.schema(f"{schema}, version long, part string").option("basePath", f"{base}/data").parquet(f"{base}/data")
    # a manifest has a row per partition of the table, so it is far smaller than what it selects
    return rows.join(valid, ["part", "version"], "left_semi").drop("version")


def read_table(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The table as the newest manifest says."""
    return _versions(spark, base, schema, manifest(spark, base)).drop("part")


def merge_batch(df: DataFrame, epoch: int, base: str, keys: list[str], order: list[str], part: Column) -> None:
    """Merge the rows of one batch into the table at ``base``; the row with the greatest ``order`` of a key stays, in any order of arrival.

    ``part`` is a function of the keys.  Rows with a null key are left out.
    """
    spark = df.sparkSession
    if committed(spark, base, epoch):
        return
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    before = manifest(spark, base, epoch)
    fresh = df.dropna(subset=keys).withColumn("part", part.cast("string"))
    touched = fresh.select("part").distinct()
    old = _versions(spark, base, schema, before.join(touched, "part", "left_semi"))
    values = [c for c in df.columns if c not in keys]
    rank = F.struct(*order, *[c for c in values if c not in order])  # equal orders: the greater row, so that reruns agree
    both = old.unionByName(fresh)
    merged = both.groupBy("part", *keys).agg(F.max_by(F.struct(*values), rank).alias("v")).select(*keys, "v.*", "part")
    # only this epoch's folder is written, whole: what a failed run of the same batch left there goes
    path = f"{base}/data/version={epoch}"
    merged.select(*df.columns, "part").write.mode("overwrite").partitionBy("part").parquet(path)
    written = touched.select("part", F.lit(epoch).cast("bigint").alias("version"))
    kept = before.join(touched, "part", "left_anti").select("part", "version")
    kept.unionByName(written).withColumn("epoch", F.lit(epoch).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/{epoch}")


def ingest_files(stream: DataFrame, base: str, checkpoint: str, keys: list[str], order: list[str], part: Column) -> DataFrame:
    """Merge all that has arrived, batch by batch, and return the table; call it again after a stop to go on.

    ``base`` and ``checkpoint`` name the table and the stream's progress; both stay.
    """
    query = (
        stream.writeStream.foreachBatch(lambda df, epoch: merge_batch(df, epoch, base, keys, order, part))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return read_table(stream.sparkSession, base, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema))
