"""Merging new rows into existing tables, and building graph tables from extracted records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TENANT = "vehicle_signature"


def merge_entities(existing: DataFrame, incoming: DataFrame, keys: list[str], mode: str = "upsert") -> tuple[DataFrame, DataFrame]:
    """Merge by key; returns the new table and the counts per action.

    ``create_only`` keeps old rows, ``update_only`` adds none, ``upsert`` and ``merge`` set the given
    (non-null) properties, ``replace`` takes the new row as it is.  A row with a null key fails.
    """
    good = incoming.dropna(subset=keys)
    props = [c for c in existing.columns if c not in keys]
    fresh = good.select(*keys, *[(F.col(c) if c in good.columns else F.lit(None)).alias(f"_n_{c}") for c in props], F.lit(True).alias("_new"))
    both = existing.withColumn("_old", F.lit(True)).join(fresh, keys, "full")
    old, new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    take = {"create_only": ~old & new, "update_only": old & new, "upsert": new, "merge": new, "replace": new}[mode]
    action = F.when(old & ~new, "kept").when(take & ~old, "created").when(take, "updated").otherwise("skipped")

    def value(c: str):
        best = F.col(f"_n_{c}") if mode == "replace" else F.coalesce(F.col(f"_n_{c}"), F.col(c))
        return F.when(take, best).otherwise(F.col(c)).alias(c)

    labelled = both.select(*keys, *[value(c) for c in props], action.alias("_action"), old.alias("_was"))
    table = labelled.filter(F.col("_was") | F.col("_action").isin("created", "updated")).select(*existing.columns)
    bad = incoming.filter(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1).select(F.lit("failed").alias("_action"))
    summary = labelled.select("_action").unionByName(bad).groupBy(F.col("_action").alias("action")).agg(F.count(F.lit(1)).alias("n")).filter("action <> 'kept'")
    return table, summary


def merge_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends known (one per source, target and type), and the rejected ones."""
    ids = nodes.select("id").distinct()
    src, dst = ids.withColumnRenamed("id", "src"), ids.withColumnRenamed("id", "dst")
    one = edges.dropDuplicates(["src", "dst", "rel_type"])
    good = one.join(src, "src", "left_semi").join(dst, "dst", "left_semi")
    bad = one.join(src, "src", "left_anti").unionByName(one.join(src, "src", "left_semi").join(dst, "dst", "left_anti"))
    return good, bad


def build_schematic_graph(components: DataFrame, pins: DataFrame, nets: DataFrame) -> DataFrame:
    """Typed edges of a drawing: contains, has pin, on net, extracted from.

    ``components``: ``project, id, span_id``; ``pins``: ``component_id, pin``; ``nets``: ``net, component_id, pin``.
    """
    pin_id = F.concat_ws(":", "component_id", F.col("pin").cast("string"))

    def edge(df: DataFrame, src, kind: str, dst) -> DataFrame:
        return df.select(src.alias("src"), F.lit(kind).alias("rel_type"), dst.alias("dst"))

    parts = [edge(components, F.col("project"), "CONTAINS", F.col("id")), edge(pins, F.col("component_id"), "HAS_PIN", pin_id), edge(nets, pin_id, "ON_NET", F.col("net")),
             edge(components.filter(F.col("span_id").isNotNull()), F.col("id"), "EXTRACTED_FROM", F.col("span_id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def knowledge_to_edges(entries: DataFrame) -> DataFrame:
    """Located-in, connected-to and has-component edges of knowledge entries, each once."""
    kind = F.coalesce("component_type", F.lit("unknown"))
    where = entries.filter(F.col("location").isNotNull()).select(kind.alias("src"), F.lit("LOCATED_IN").alias("rel_type"), F.col("location.zone").alias("dst"),
                                                               F.to_json(F.struct("location.sub_zone", "location.side", "location.access", "confidence")).alias("props"))
    wire = entries.select("confidence", F.explode("connections").alias("c")).select(
        F.col("c.source").alias("src"), F.lit("CONNECTED_TO").alias("rel_type"), F.col("c.target").alias("dst"), F.to_json(F.struct("c.connection_type", "c.wire_color", "c.wire_gauge", "confidence")).alias("props"))
    v = F.col("vehicle")
    name = F.concat_ws("_", F.coalesce(v["make"], F.lit("unknown")), F.coalesce(v["model"], F.lit("unknown")), F.coalesce(v["year_start"], F.lit(0)).cast("string"), F.coalesce(v["year_end"], F.lit(9999)).cast("string"))
    has = entries.filter(v.isNotNull()).select(name.alias("src"), F.lit("HAS_COMPONENT").alias("rel_type"), kind.alias("dst"), F.lit("{}").alias("props"))
    return where.unionByName(wire).unionByName(has).distinct()


def backfill_tenant(nodes: DataFrame, edges: DataFrame, lookup: DataFrame, default: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fill missing tenants of nodes (by ``lookup: id, tenant``, else the default) and of edges (from
    their ends); also counts per tenant and of what is still missing."""
    known = lookup.select("id", F.col("tenant").alias("_t"))
    n = nodes.join(known, "id", "left").withColumn(TENANT, F.coalesce(TENANT, "_t", F.lit(default))).drop("_t")
    of = n.select("id", TENANT)
    s, d = of.select(F.col("id").alias("src"), F.col(TENANT).alias("_s")), of.select(F.col("id").alias("dst"), F.col(TENANT).alias("_d"))
    e = edges.join(s, "src", "left").join(d, "dst", "left").withColumn(TENANT, F.coalesce(TENANT, "_s", "_d")).drop("_s", "_d")
    check = n.select(F.lit("node").alias("kind"), TENANT).unionByName(e.select(F.lit("edge").alias("kind"), TENANT)).groupBy("kind", TENANT).agg(F.count(F.lit(1)).alias("n"))
    return n, e, check


def delete_tenant(df: DataFrame, tenants: DataFrame, column: str = TENANT) -> DataFrame:
    """Rows of all other tenants; write the result over the old table."""
    return df.join(tenants.select(column).distinct(), column, "left_anti")
