"""Writers and export forms."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.session import ensure_checkpoint_dir

TENANT = "vehicle_signature"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] = (), max_records: int = 5_000_000) -> None:
    """Parquet files of bounded size, partitioned by the given columns.

    ``overwrite_partitions`` replaces only the partitions that occur in ``df``.
    """
    writer = df.write.option("maxRecordsPerFile", max_records)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if mode == "overwrite_partitions":
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        writer.mode(mode).parquet(path)


def export_ndjson(tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON text per row with the table name as ``type``; write it with ``write.text``."""
    parts = [df.select(F.to_json(F.struct(F.lit(name).alias("type"), *df.columns)).alias("value")) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def net_clique_edges(connections: DataFrame, share: int = 1024) -> DataFrame:
    """``net, a, b``: each pair of components that share a net, once, whatever the size of the net.

    The pairs are the result, so their number is the square of a net's.  The members of a net are dealt into shares, and
    each pair of shares is a join key of its own, so a supply net with many members is spread over many tasks.
    ``net_hub_edges`` says the same in one row per member.
    """
    members = connections.select("net", "component_id").distinct()
    sizes = members.groupBy("net").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("_n"))
    dealt = members.join(sizes, "net").withColumn("_own", F.pmod(F.xxhash64("component_id"), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    a = dealt.select("net", F.col("component_id").alias("a"), F.col("_own").alias("_i"), every.alias("_j"))
    b = dealt.select("net", F.col("component_id").alias("b"), F.col("_own").alias("_j"), every.alias("_i"))
    return a.join(b, ["net", "_i", "_j"]).filter("a < b").select("net", "a", "b")


def net_hub_edges(connections: DataFrame) -> DataFrame:
    """``net, component_id``: one edge from a net to each of its members."""
    return connections.select("net", "component_id").distinct()


def xml_safe(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def export_graphml_lines(nodes: DataFrame, edges: DataFrame, attributes: list[str]) -> DataFrame:
    """One XML element per node and edge; a file is a head line, these lines and a foot line."""
    data = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), xml_safe(F.col(c)), F.lit("</data>"))) for c in attributes]
    n = nodes.select(F.concat(F.lit('<node id="'), xml_safe(F.col("id")), F.lit('">'), F.concat_ws("", *data), F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), xml_safe(F.col("src")), F.lit('" target="'), xml_safe(F.col("dst")), F.lit('"><data key="type">'), xml_safe(F.col("rel_type")), F.lit("</data></edge>")).alias("value"))
    return n.unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, attributes: list[str]) -> None:
    """Well-formed XML files of nodes below ``path/nodes`` and of edges below ``path/edges``."""

    def data(pairs: list[tuple[str, Column]]) -> Column:
        kept = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("_key"), v.cast("string").alias("_VALUE"))) for k, v in pairs]
        return F.array_compact(F.array(*kept)).alias("data")

    def write(df: DataFrame, tag: str) -> None:
        df.write.format("xml").option("rootTag", "graph").option("rowTag", tag).mode("overwrite").save(f"{path}/{tag}s")

    write(nodes.select(F.col("id").alias("_id"), data([(c, F.col(c)) for c in attributes])), "node")
    write(edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), data([("type", F.col("rel_type"))])), "edge")


def export_vehicle(tables: dict[str, DataFrame], path: str) -> list[str]:
    """One folder per table, one sub-folder per tenant."""
    out = []
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", "overwrite", [TENANT])
        out.append(f"{path}/{name}")
    return out


def storage_stats(artifacts: DataFrame) -> DataFrame:
    """``project, job, backend, name, size``: path of the artifacts and totals per backend and project."""
    path = F.concat_ws("/", "project", "job", "name")
    return artifacts.withColumn("path", path).groupBy("backend", "project").agg(
        F.count_distinct("path").alias("artifacts"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
