"""Streaming operators: functions from a streaming (or batch) table with event time to a table.

Event time is a ``timestamp`` column; every operator that keeps state sets a watermark, so state is
dropped and late rows are left out by rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.sources.writers import scratch


def n() -> Column:
    return F.count(F.lit(1))


def rate_counters(stream: DataFrame, limits: DataFrame, window: str = "1 hour", limit: str = "per_hour", delay: str = "1 hour") -> DataFrame:
    """Requests per user and window with the limit of the user's tier and an over-limit flag.

    ``stream``: ``user_id, ts, tier``; ``limits``: ``tier`` and the limit column.
    """
    counts = stream.withWatermark("ts", delay).groupBy("user_id", "tier", F.window("ts", window).alias("w")).agg(n().alias("requests"))
    return counts.join(limits.select("tier", F.col(limit).alias("allowed")), "tier", "left").select(
        "user_id", F.col("w.start").alias("window_start"), "requests", "allowed", (F.col("requests") > F.col("allowed")).alias("over_limit"))


def quota_usage(stream: DataFrame, quotas: DataFrame, default: int, delay: str = "1 day") -> DataFrame:
    """Use per user and month against the quota; it starts again at the first of the next month."""
    month = F.date_trunc("month", "ts")
    used = stream.withWatermark("ts", delay).groupBy("user_id", month.alias("month")).agg(F.sum("units").alias("used"))
    return used.join(quotas.select("user_id", "quota"), "user_id", "left").select(
        "user_id", "month", "used", F.coalesce("quota", F.lit(default)).alias("quota"), F.add_months(F.to_date("month"), 1).alias("reset_at"),
        (F.col("used") > F.coalesce("quota", F.lit(default))).alias("exhausted"))


def latency_monitor(stream: DataFrame, size: str = "10 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Mean, p95, p99 and error rate of a sliding window; ``stream``: ``ts, latency, failed``."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", size, slide).alias("w")).agg(
        n().alias("total"), F.avg("latency").alias("latency_mean"), F.percentile_approx("latency", 0.95, 1000).alias("latency_p95"),
        F.percentile_approx("latency", 0.99, 1000).alias("latency_p99"), (F.count(F.when(F.col("failed"), 1)) / n()).alias("error_rate")
    ).select(F.col("w.start").alias("window_start"), "total", "latency_mean", "latency_p95", "latency_p99", "error_rate")


def signal_summary(stream: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "signal_type", "severity").agg(
        n().alias("n"), F.avg("confidence").alias("avg_confidence")).select(F.col("w.start").alias("window_start"), "signal_type", "severity", "n", "avg_confidence")


def retain_recent(df: DataFrame, keep: str = "24 hours") -> DataFrame:
    """Rows of the last ``keep`` before the newest row."""
    newest = df.agg(F.max("ts").alias("_newest")).withColumn("_g", F.lit(1))
    return df.withColumn("_g", F.lit(1)).join(F.broadcast(newest), "_g").filter(F.col("ts") > F.col("_newest") - F.expr(f"INTERVAL {keep}")).drop("_g", "_newest")


def stream_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        n().alias("interactions"), F.count(F.when(~F.col("success"), 1)).alias("errors")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "interactions", "errors")


def dedup_stream(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First row of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def ops_metrics(stream: DataFrame, window: str = "1 hour", low: float = 0.0, high: float = 100.0, buckets: int = 10, delay: str = "1 hour") -> DataFrame:
    """Counts per label, window and duration bucket (0 and ``buckets + 1`` are the open ends)."""
    return stream.withWatermark("ts", delay).groupBy(
        F.window("ts", window).alias("w"), "label", F.width_bucket("duration", F.lit(low), F.lit(high), F.lit(buckets)).alias("bucket")
    ).agg(n().alias("n"), F.sum("duration").alias("duration")).select(F.col("w.start").alias("window_start"), "label", "bucket", "n", "duration")


def enrich_stream(stream: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Join each arriving row with a static table."""
    return stream.join(dim, key, "left")


def progress_view(states: DataFrame) -> DataFrame:
    """Of the last states of jobs (see ``state.job_states``): number of active ones, mean progress, oldest and newest move."""
    live = states.filter((F.col("event") == "open") & (F.col("progress") >= 0) & (F.col("progress") < 100))
    return live.agg(n().alias("active"), F.avg("progress").alias("avg_progress"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


# ---- running -----------------------------------------------------------------------------------


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process all that is there, batch by batch, and stop."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch(stream.sparkSession, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()


def collect_changes(stream: DataFrame, settings: dict[str, str]) -> DataFrame:
    """Run a stream in update mode under the given settings and return all that it gave out."""
    spark = stream.sparkSession
    path = scratch(spark, "changes")
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        run_batches(stream, lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/{batch}"), "update")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def collect_updates(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run the stream into files and return the last version of each key."""
    spark = stream.sparkSession
    path = scratch(spark, "updates")
    run_batches(stream, lambda df, batch: df.withColumn("_batch", F.lit(batch)).write.mode("append").parquet(path), mode)
    written = spark.read.parquet(path)
    if mode == "append":
        return written.drop("_batch")
    values = [c for c in written.columns if c not in {*keys, "_batch"}]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(*keys, "v.*")
