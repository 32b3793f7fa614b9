"""Joins between nodes, edges, pages, codes and vehicles.

Results are long: one row per related item, never a list per node, so a hub costs no more memory
than any other row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TENANT = "vehicle_signature"


def relations(nodes: DataFrame, edges: DataFrame, names: tuple[str, str], direction: str = "both") -> DataFrame:
    """``(id, direction, other_id, other_type)`` for edges leaving and entering each node."""
    other = nodes.select(F.col("id").alias("other_id"), F.col("type").alias("other_type"))
    known = nodes.select("id")
    out = edges.select(F.col("src").alias("id"), F.lit(names[0]).alias("direction"), F.col("dst").alias("other_id"))
    into = edges.select(F.col("dst").alias("id"), F.lit(names[1]).alias("direction"), F.col("src").alias("other_id"))
    chosen = {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]
    return chosen.join(known, "id", "left_semi").join(other, "other_id").select("id", "direction", "other_id", "other_type")


def connections(nodes, edges, direction: str = "both") -> DataFrame:
    return relations(nodes, edges, ("outgoing", "incoming"), direction)


def power_relations(nodes, powered_by, direction: str = "both") -> DataFrame:
    return relations(nodes, powered_by, ("power_source", "load"), direction)


def control_relations(nodes, controls, direction: str = "both") -> DataFrame:
    return relations(nodes, controls, ("controls", "controlled_by"), direction)


def locations(components, located_in, zones) -> DataFrame:
    return (
        located_in.select(F.col("src").alias("id"), F.col("dst").alias("zone_id"), "accessibility")
        .join(components.select("id", TENANT, "type"), "id")
        .join(zones.select(F.col("id").alias("zone_id"), F.col("name").alias("zone_name"), "access_level"), "zone_id")
    )


def memberships(components, part_of, circuits) -> DataFrame:
    return (
        part_of.select(F.col("src").alias("component_id"), F.col("dst").alias("circuit_id"), "role", "is_critical")
        .join(components.select(F.col("id").alias("component_id"), F.col("type").alias("component_type")), "component_id")
        .join(circuits.select(F.col("id").alias("circuit_id"), "circuit_type", F.col("name").alias("circuit_name")), "circuit_id")
    )


def all_relationships(nodes, edges, rel_types: list[str] | None = None) -> DataFrame:
    """Edges of each node by type and direction."""
    if rel_types:
        edges = edges.filter(F.col("rel_type").isin(rel_types))
    out = edges.select(F.col("src").alias("id"), "rel_type", F.lit("outgoing").alias("direction"), F.col("dst").alias("other_id"))
    into = edges.select(F.col("dst").alias("id"), "rel_type", F.lit("incoming").alias("direction"), F.col("src").alias("other_id"))
    return out.unionByName(into).join(nodes.select("id"), "id", "left_semi")


def relationship_counts(nodes, edges, rel_types: list[str] | None = None) -> DataFrame:
    return all_relationships(nodes, edges, rel_types).groupBy("id", "rel_type", "direction").agg(F.count(F.lit(1)).alias("n"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def orphans(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    if types:
        edges = edges.filter(F.col("rel_type").isin(types))
    return nodes.join(endpoints(edges), "id", "left_anti")


def net_connectivity(components: DataFrame, pins: DataFrame, nets: DataFrame) -> DataFrame:
    """Component -> pin -> net as rows; a pin without net and a component without pin stay.

    ``pins``: ``component_id, pin``; ``nets``: ``net, component_id, pin``.
    """
    return components.select(F.col("id").alias("component_id"), "type").join(pins, "component_id", "left").join(
        nets, ["component_id", "pin"], "left").distinct()


def circuit_topology(part_of: DataFrame, edges: DataFrame) -> DataFrame:
    """Per circuit: wires and controls between members, and power feeds of members."""
    member = part_of.select("src", F.col("dst").alias("circuit_id"))
    other = part_of.select(F.col("src").alias("dst"), F.col("dst").alias("circuit_id"))
    inner = edges.filter(F.col("rel_type").isin("CONNECTS_TO", "CONTROLS")).join(member, "src").join(
        other, ["dst", "circuit_id"], "left_semi")
    feeds = edges.filter(F.col("rel_type") == "POWERED_BY").join(member, "src")
    inner = inner.select("circuit_id", F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "rel_type")
    feeds = feeds.select("circuit_id", F.col("dst").alias("from_id"), F.col("src").alias("to_id"), "rel_type")
    return inner.unionByName(feeds).distinct()


def topology_counts(part_of: DataFrame, edges: DataFrame) -> DataFrame:
    members = part_of.groupBy(F.col("dst").alias("circuit_id")).agg(F.count_distinct("src").alias("component_count"))
    kinds = circuit_topology(part_of, edges).groupBy("circuit_id").agg(
        *[F.count(F.when(F.col("rel_type") == k, 1)).alias(n) for k, n in
          (("CONNECTS_TO", "connection_count"), ("POWERED_BY", "power_count"), ("CONTROLS", "control_count"))])
    return members.join(kinds, "circuit_id", "left").fillna(0)


def section_of_page(pages: DataFrame, sections: DataFrame, cell: int = 64) -> DataFrame:
    """The section with the greatest start page that contains each page.

    A section is filed under every ``cell`` of pages it touches, so the range join is an equi-join
    on the cell and no side has to be broadcast.
    """
    filed = sections.select(
        "name", "start_page", "end_page",
        F.explode(F.sequence(F.floor(F.col("start_page") / cell), F.floor(F.col("end_page") / cell))).alias("cell"))
    asked = pages.withColumn("cell", F.floor(F.col("page") / cell))
    inside = (F.col("page") >= F.col("start_page")) & (F.col("page") <= F.col("end_page"))
    hits = asked.join(filed, "cell").filter(inside)
    return hits.groupBy("page").agg(
        F.max_by("name", F.struct("start_page", "name")).alias("section"), F.max("start_page").alias("start_page"))


def knowledge_for(asks: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Knowledge for each asked (type, section): its type or its section fits.

    The OR is two equi-joins and a distinct; asks are distinct combinations, not components.
    """
    asks = asks.select("type", "section").distinct()
    by_type = knowledge.select("knowledge_id", F.col("applies_to_type").alias("type")).join(asks, "type")
    by_section = knowledge.select("knowledge_id", "section").join(asks, "section")
    keep = ["type", "section", "knowledge_id"]
    return by_type.select(*keep).unionByName(by_section.select(*keep)).distinct()


def placement_context(components: DataFrame, sections: DataFrame, knowledge: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per component: its section and the sizes of its knowledge and wiring context."""
    section = section_of_page(components.select("page").distinct(), sections).select("page", "section")
    placed = components.join(section, "page", "left")
    own = knowledge.groupBy(F.col("applies_to_type").alias("type")).agg(F.count(F.lit(1)).alias("type_knowledge"))
    here = knowledge.groupBy("section").agg(F.count(F.lit(1)).alias("section_knowledge"))
    wires = relationship_counts(components, edges).groupBy("id").agg(F.sum("n").alias("connections"))
    return placed.select("id", "type", "page", "section").join(own, "type", "left").join(here, "section", "left").join(
        wires, "id", "left").fillna(0, subset=["type_knowledge", "section_knowledge", "connections"])


def lookup_codes(df: DataFrame, metadata: DataFrame, kind: str, code: str) -> DataFrame:
    """Meaning of a code (null when unknown) and whether it is valid."""
    dim = metadata.filter(F.col("type") == kind).select(F.col("code").alias(code), "meaning")
    return df.join(dim, code, "left").withColumn("is_valid", F.col("meaning").isNotNull())


def specific_or_generic(keys: DataFrame, dim: DataFrame, key: str = "vehicle", generic: str = "generic") -> DataFrame:
    """Rows of ``dim`` for each key; a key without rows of its own gets the generic ones."""
    own = keys.join(dim, key)
    rest = keys.join(dim.select(key).distinct(), key, "left_anti")
    # every such key meets every generic row: spread the keys over shares of the join
    shared = dim.filter(F.col(key) == generic).drop(key).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return own.unionByName(rest.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(64)).cast("int")).join(shared, "_s").drop("_s"))


def power_bottlenecks(components: DataFrame, powered_by: DataFrame, fraction: float = 0.8) -> DataFrame:
    """Loads that draw more than a fraction of what their source is rated for."""
    load = components.select(F.col("id").alias("src"), F.col("current_rating").alias("load_current"))
    source = components.filter(F.col("current_rating").isNotNull()).select(
        F.col("id").alias("dst"), F.col("type").alias("source_type"), F.col("current_rating").alias("rating"))
    return powered_by.select("src", "dst").join(load, "src").join(source, "dst").filter(
        F.col("load_current") > F.col("rating") * fraction
    ).select(F.col("dst").alias("component_id"), "source_type", "rating", F.col("src").alias("heavy_load"))


def existing_conflicts(batch: DataFrame, existing: DataFrame) -> DataFrame:
    return batch.join(existing.select("id", TENANT).distinct(), ["id", TENANT], "left_semi")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an unknown end, and which end is unknown."""
    ids = nodes.select("id").distinct()
    src = ids.select(F.col("id").alias("src"), F.lit(True).alias("has_src"))
    dst = ids.select(F.col("id").alias("dst"), F.lit(True).alias("has_dst"))
    return edges.join(src, "src", "left").join(dst, "dst", "left").filter(
        F.col("has_src").isNull() | F.col("has_dst").isNull()
    ).withColumn("missing", F.when(F.col("has_src").isNotNull(), "dst").when(F.col("has_dst").isNotNull(), "src").otherwise("both")
    ).drop("has_src", "has_dst")


def vehicles_match(a: str, b: str) -> Column:
    """Whether two vehicle descriptions can be the same; a null field fits everything."""

    def fits(name: str) -> Column:
        x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
        return x.isNull() | y.isNull() | (x == "") | (y == "") | (F.lower(x) == F.lower(y))

    def before(x: Column, y: Column) -> Column:
        return F.coalesce(x <= y, F.lit(True))

    return (
        fits("make") & fits("model")
        & before(F.col(f"{a}.year_start"), F.col(f"{b}.year_end"))
        & before(F.col(f"{b}.year_start"), F.col(f"{a}.year_end"))
    )


def match_vehicles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matching pairs ``(a_id, b_id)``.

    Every match is found by one equi-join.  ``b`` is filed under (make, model) and under the three
    keys with one or both replaced by a wildcard; ``a`` asks with its own wildcards, so exactly one
    key pair meets for each combination of missing fields.
    """
    any_value = "*"

    def norm(c: str) -> Column:
        return F.lower(F.nullif(F.trim(c), F.lit("")))

    def filed(df: DataFrame, name: str, asking: bool) -> DataFrame:
        make, model = norm("make"), norm("model")
        # a missing field meets every filed value, a given field meets itself or a missing one
        choices = []
        for col in (make, model):
            known = F.array(col, F.lit(any_value)) if asking else F.array(col, F.concat(F.lit("~"), F.lit(any_value)))
            missing = F.array(F.lit("~" + any_value), F.lit(any_value)) if asking else F.array(F.lit(any_value))
            choices.append(F.when(col.isNotNull(), known).otherwise(missing))
        return df.select(
            F.struct(*df.columns).alias(name), F.explode(choices[0]).alias("k_make"), choices[1].alias("_m")
        ).select(name, "k_make", F.explode("_m").alias("k_model"))

    pairs = filed(a, "a", True).join(filed(b, "b", False), ["k_make", "k_model"])
    return pairs.filter(vehicles_match("a", "b")).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


def lookup_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def compare_sources(a: DataFrame, b: DataFrame, attributes: list[str], group: str) -> DataFrame:
    """How two sources of the same entities cover each other, per group value."""
    left = a.select("id", group, *[F.col(c).alias(f"a_{c}") for c in attributes], F.lit(True).alias("in_a"))
    right = b.select("id", F.col(group).alias("_g"), *[F.col(c).alias(f"b_{c}") for c in attributes], F.lit(True).alias("in_b"))
    both = left.join(right, "id", "full").withColumn("g", F.coalesce(group, "_g"))
    count = lambda c: F.count(F.when(c, 1))
    return both.groupBy(F.col("g").alias(group)).agg(
        count(F.col("in_a").isNotNull()).alias("n_a"), count(F.col("in_b").isNotNull()).alias("n_b"),
        count(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_both"),
        *[F.count(f"{s}_{c}").alias(f"{s}_{c}") for c in attributes for s in "ab"])


def equal_on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [left[k] == right[k] for k in keys])
