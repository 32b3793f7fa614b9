"""Reports over components, circuits, zones, edges, jobs, spans and layouts.

Every table is aggregated before it is joined to another one, so no join multiplies counts.
Lists of members are given as rows; only value sets that come from a small vocabulary (types,
zones, makers, messages) are collected into arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.operators import graph
from wirelake.operators.filters import has_position, literal_map, power
from wirelake.scale import share_of, top_rows

TENANT = "vehicle_signature"
SOURCES = ("battery", "alternator", "power_supply")


def n() -> Column:
    return F.count(F.lit(1))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def filled(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def messages(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the messages whose condition holds, in the order given."""
    made = [F.when(cond, msg if isinstance(msg, Column) else F.lit(msg)) for cond, msg in pairs]
    return F.array_compact(F.array(*made))


def system_overview(vehicles, components, circuits, zones, edges) -> DataFrame:
    comp = components.groupBy(TENANT).agg(
        n().alias("component_count"),
        count_if(has_position()).alias("positioned"),
        count_if(F.col("voltage_rating").isNotNull()).alias("with_voltage"),
        count_if(F.col("current_rating").isNotNull()).alias("with_current"),
    )
    circ = circuits.groupBy(TENANT).agg(n().alias("circuit_count"))
    zone = zones.groupBy(TENANT).agg(n().alias("zone_count"))
    rel = edges.groupBy(TENANT).agg(
        count_if(F.col("rel_type") == "CONNECTS_TO").alias("connection_count"),
        count_if(F.col("rel_type") == "POWERED_BY").alias("power_relationship_count"),
        count_if(F.col("rel_type") == "CONTROLS").alias("control_relationship_count"),
    )
    out = vehicles.select(F.col("signature").alias(TENANT), "make", "model", "year")
    for side in (comp, circ, zone, rel):
        out = out.join(side, TENANT, "left")
    counts = [c for c in out.columns if c.endswith("_count") or c in {"positioned", "with_voltage", "with_current"}]
    out = out.fillna(0, subset=counts)
    total = F.col("component_count")
    return out.select(
        TENANT, "make", "model", "year", "component_count", "circuit_count", "zone_count",
        "connection_count", "power_relationship_count", "control_relationship_count",
        F.round(pct(F.col("positioned"), total), 1).alias("position_data_percent"),
        F.round(pct(F.col("with_voltage"), total), 1).alias("voltage_data_percent"),
        F.round(pct(F.col("with_current"), total), 1).alias("current_data_percent"),
    )


def _group_analytics(df: DataFrame, key: str) -> DataFrame:
    base = df.groupBy(TENANT, key).agg(
        n().alias("count"),
        F.avg("voltage_rating").alias("avg_voltage"),
        F.avg("current_rating").alias("avg_current"),
        F.coalesce(F.sum(power()), F.lit(0.0)).alias("total_power"),
        count_if(has_position()).alias("positioned_count"),
        *(
            [F.array_sort(F.collect_set("zone")).alias("zones_used"),
             F.array_sort(F.collect_set("manufacturer")).alias("manufacturers")]
            if key == "type" else [F.array_sort(F.collect_set("type")).alias("component_types")]
        ),
    )
    with_total = share_of(base, TENANT, "count", "_total")
    return with_total.withColumn(
        "position_coverage_percent", pct(F.col("positioned_count"), F.col("count"))
    ).withColumn("percentage_of_total", pct(F.col("count"), F.col("_total"))).drop("_total")


def type_analytics(components: DataFrame) -> DataFrame:
    return _group_analytics(components, "type")


def zone_analytics(components: DataFrame) -> DataFrame:
    named = components.withColumn("zone", F.coalesce("zone", F.lit("unassigned")))
    return _group_analytics(named, "zone").withColumn(
        "type_diversity", F.size("component_types").cast("bigint"))


def circuit_loads(circuits, part_of, components) -> DataFrame:
    """Per circuit: members, summed current and power, load %, spare capacity."""
    members = part_of.select(F.col("src").alias("_cid"), F.col("dst").alias("id")).join(
        components.select(F.col("id").alias("_cid"), "voltage_rating", "current_rating"), "_cid")
    sums = members.groupBy("id").agg(
        n().alias("component_count"),
        F.sum(F.coalesce("current_rating", F.lit(0.0))).alias("total_load_current"),
        F.sum(F.coalesce(power(), F.lit(0.0))).alias("total_power"),
    )
    cap = F.col("max_current")
    return (
        circuits.join(sums, "id", "left")
        .fillna(0, subset=["component_count", "total_load_current", "total_power"])
        .withColumn("load_percentage", F.when(cap > 0, F.col("total_load_current") / cap * 100).otherwise(0.0))
        .withColumn("available_capacity", F.when(cap > 0, cap - F.col("total_load_current")).otherwise(0.0))
    )


def load_status(load: Column) -> Column:
    return (
        F.when(load > 100, "overloaded").when(load > 90, "critical")
        .when(load > 80, "heavily_loaded").when(load > 60, "moderately_loaded").otherwise("normal")
    )


def circuit_analytics(circuits, part_of, components) -> DataFrame:
    loads = circuit_loads(circuits, part_of, components)
    return loads.select(
        F.col("id").alias("circuit_id"), TENANT, "name", "circuit_type", "voltage",
        F.col("max_current").alias("max_capacity"), "protection", "safety_critical",
        "component_count", "total_load_current", "total_power",
        "load_percentage", "available_capacity",
        load_status(F.col("load_percentage")).alias("status"),
    )


def circuit_summary(analytics: DataFrame) -> DataFrame:
    load = F.col("load_percentage")
    return analytics.groupBy(TENANT).agg(
        n().alias("total_circuits"),
        count_if(load > 100).alias("overloaded_circuits"),
        count_if((load > 80) & (load <= 100)).alias("heavily_loaded_circuits"),
        count_if(F.col("safety_critical")).alias("safety_critical_circuits"),
        count_if(F.col("protection").isNull() | F.col("protection").isin("", "none"))
        .alias("circuits_without_protection"),
    )


def overloaded(circuits, part_of, components) -> DataFrame:
    loads = circuit_loads(circuits, part_of, components)
    return loads.filter(F.col("total_load_current") > F.col("max_current")).select(
        F.col("id").alias("circuit_id"), TENANT, F.col("total_load_current").alias("total_load"),
        (F.col("total_load_current") / F.nullif("max_current", F.lit(0.0))).alias("load_factor"),
        (F.col("total_load_current") - F.col("max_current")).alias("overload_amount"))


def circuit_load_detail(circuits, part_of, components) -> DataFrame:
    """One row per circuit and member: the circuit's load beside the member's ratings."""
    loads = circuit_loads(circuits, part_of, components).select(
        F.col("id").alias("circuit_id"), TENANT, "component_count", "total_load_current",
        "total_power", "load_percentage", F.col("available_capacity").alias("safety_margin"),
        (F.col("load_percentage") > 100).alias("is_overloaded"))
    members = part_of.select(F.col("dst").alias("circuit_id"), F.col("src").alias("component_id")).join(
        components.select(F.col("id").alias("component_id"), F.col("type").alias("component_type"),
                          "current_rating", "voltage_rating"), "component_id")
    return loads.join(members, "circuit_id", "left")


def circuit_comprehensive(circuits, part_of, components) -> DataFrame:
    kind = F.col("type")
    members = part_of.select(F.col("src").alias("_cid"), F.col("dst").alias("id")).join(
        components.select(F.col("id").alias("_cid"), "type", "current_rating"), "_cid")
    sums = members.groupBy("id").agg(
        n().alias("total_components"),
        count_if(kind.isin(*SOURCES)).alias("power_sources"),
        count_if(~kind.isin(*SOURCES, "fuse", "relay")).alias("loads"),
        count_if(kind.isin("fuse", "circuit_breaker")).alias("protection_devices"),
        F.sum(F.coalesce("current_rating", F.lit(0.0))).alias("total_current_draw"),
    )
    out = circuits.select("id", TENANT, "name", "max_current").join(sums, "id", "left").fillna(
        0, subset=["total_components", "power_sources", "loads", "protection_devices", "total_current_draw"])
    load, guarded = F.col("load_factor"), F.col("protection_devices") > 0
    return (
        out.withColumn("load_factor", F.when(F.col("max_current") > 0, F.col("total_current_draw") / F.col("max_current") * 100).otherwise(0.0))
        .withColumn("voltage_drop_percentage", F.lit(5.0))
        .withColumn("reliability_score", F.when(guarded & (load < 80), 0.9).when(guarded, 0.7).when(load < 80, 0.6).otherwise(0.4))
        .withColumn("potential_issues", messages(
            (load > 100, "Circuit overloaded - load exceeds capacity"),
            ((load > 80) & (load <= 100), "Circuit heavily loaded - consider capacity upgrade"),
            (~guarded, "No protection devices found in circuit"),
            (F.col("voltage_drop_percentage") > 5, "Excessive voltage drop detected")))
        .withColumnRenamed("id", "circuit_id").drop("max_current")
    )


def circuit_roles(part_of, components) -> DataFrame:
    """The members of every circuit by electrical role, as rows."""
    kind = F.col("type")
    return part_of.select(F.col("dst").alias("circuit_id"), F.col("src").alias("component_id")).join(
        components.select(F.col("id").alias("component_id"), "type"), "component_id"
    ).select("circuit_id", "component_id", F.when(kind.isin(*SOURCES), "power_source")
             .when(kind.isin("fuse", "circuit_breaker"), "protection_device")
             .when(kind == "relay", "switching").otherwise("load").alias("role"))


def power_flow(components, powered_by, depth: int = 5) -> DataFrame:
    """Per source: distinct loads fed within ``depth`` steps and how far it is used."""
    sources = components.filter(F.col("type").isin(*SOURCES))
    downward = graph.reversed_edges(powered_by)
    fed = graph.bounded_closure(downward, sources.select(F.col("id").alias("start")), depth)
    loads = fed.join(components.select(F.col("id").alias("node"), "current_rating"), "node").groupBy(
        F.col("start").alias("id")).agg(n().alias("loads_powered"),
                                        F.sum(F.coalesce("current_rating", F.lit(0.0))).alias("current_load"))
    out = sources.select("id", TENANT, "type", F.coalesce("current_rating", F.lit(0.0)).alias("capacity")).join(
        loads, "id", "left").fillna(0, subset=["loads_powered", "current_load"])
    use = F.col("utilization_percent")
    return out.withColumn("utilization_percent", pct(F.col("current_load"), F.col("capacity"))).withColumn(
        "status", F.when(use > 100, "overloaded").when(use > 80, "high").otherwise("normal")
    ).withColumnRenamed("id", "source_id")


def power_flow_summary(flow: DataFrame) -> DataFrame:
    return flow.groupBy(TENANT).agg(
        F.sum("capacity").alias("total_capacity"), F.sum("current_load").alias("total_load"),
        n().alias("power_source_count")
    ).withColumn("system_utilization_percent", pct(F.col("total_load"), F.col("total_capacity"))
    ).withColumn("redundancy_available", F.col("power_source_count") > 1)


def orphan_counts(components, edges) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return components.join(ends, "id", "left_anti").groupBy(TENANT).agg(n().alias("orphaned_components"))


def data_quality(components, edges) -> DataFrame:
    base = components.groupBy(TENANT).agg(
        n().alias("total"),
        count_if(has_position()).alias("p"), count_if(F.col("zone").isNotNull()).alias("z"),
        count_if(F.col("voltage_rating").isNotNull()).alias("v"),
        count_if(F.col("current_rating").isNotNull()).alias("c"),
        count_if(F.col("voltage_rating").isNotNull() & F.col("current_rating").isNotNull()).alias("e"),
        count_if(filled("name")).alias("nm"), count_if(filled("part_number")).alias("pn"),
        count_if(filled("manufacturer")).alias("m"),
    ).join(orphan_counts(components, edges), TENANT, "left").fillna(0, subset=["orphaned_components"])
    total = F.col("total")
    names = {"p": "position", "z": "zone", "v": "voltage", "c": "current", "e": "electrical",
             "nm": "name", "pn": "part_number", "m": "manufacturer"}
    out = base.select(TENANT, total.alias("total_components"), "orphaned_components",
                      *[pct(F.col(k), total).alias(f"{v}_percent") for k, v in names.items()])
    seven = ["position", "zone", "voltage", "current", "name", "part_number", "manufacturer"]
    score = sum((F.col(f"{v}_percent") for v in seven[1:]), F.col("position_percent")) / 7
    pos, ele = F.col("position_percent"), F.col("electrical_percent")

    def one(c: Column) -> Column:
        return F.format_string("%.1f", F.bround(c, 1))

    return (
        out.withColumn("overall_quality_score", score)
        .withColumn("issues", messages(
            (pos < 80, F.concat(F.lit("Only "), one(pos), F.lit("% of components have position data"))),
            (ele < 90, F.concat(F.lit("Only "), one(ele), F.lit("% of components have complete electrical ratings"))),
            (F.col("orphaned_components") > 0, F.concat(F.col("orphaned_components").cast("string"), F.lit(" components have no relationships")))))
        .withColumn("recommendations", messages(
            (pos < 50, "Prioritize spatial data mapping for 3D visualization"),
            (ele < 70, "Complete electrical specifications for better analysis"),
            (F.col("name_percent") < 95, "Improve component naming for better identification")))
    )


def daily_trend(df: DataFrame, days: int, now: Column, ts: str = "created_at", kind: str = "type") -> DataFrame:
    """Rows per day over the ``days`` before ``now``, with the kinds seen that day."""
    recent = df.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))
    return recent.groupBy(TENANT, F.to_date(ts).alias("creation_date")).agg(
        n().alias("components_added"), F.array_sort(F.collect_set(kind)).alias("types_added"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(TENANT, F.col(column).cast("string").alias("value")).agg(n().alias("n"))


def summary_stats(components: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return components.groupBy(TENANT).agg(
        n().alias("total_components"), distinct("type").alias("unique_types"),
        distinct("zone").alias("zones_used"), distinct("manufacturer").alias("manufacturers"),
        count_if(has_position()).alias("components_with_position"),
        F.count("voltage_rating").alias("components_with_voltage"),
        F.count("current_rating").alias("components_with_current"),
        F.avg("voltage_rating").alias("avg_voltage"), F.avg("current_rating").alias("avg_current"),
        F.max("voltage_rating").alias("max_voltage"), F.max("current_rating").alias("max_current"))


def edge_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select(F.col("id").alias("src"), TENANT)
    return edges.join(known, ["src", TENANT], "left_semi").groupBy(TENANT, "rel_type").agg(n().alias("n"))


def by_manufacturer(components: DataFrame) -> DataFrame:
    return components.filter(F.col("manufacturer").isNotNull()).groupBy(TENANT, "manufacturer").agg(
        n().alias("component_count"), F.array_sort(F.collect_set("type")).alias("component_types"))


def system_loads(components: DataFrame) -> DataFrame:
    """Per tenant totals with ``type`` null, and the break-down by type, in one pass."""
    loads = components.filter(F.col("current_rating").isNotNull() & ~F.col("type").isin("battery", "alternator"))
    return loads.rollup(TENANT, "type").agg(
        F.sum("current_rating").alias("total_current"), F.avg("current_rating").alias("average_current"),
        F.max("current_rating").alias("peak_current"), n().alias("component_count")
    ).filter(F.col(TENANT).isNotNull())


def system_health(components, edges) -> DataFrame:
    base = components.groupBy(TENANT).agg(
        n().alias("total_components"),
        count_if(~has_position()).alias("missing_position"),
        count_if(F.col("voltage_rating").isNull()).alias("missing_voltage"),
        count_if(F.col("current_rating").isNull()).alias("missing_current"))
    wires = edges.filter(F.col("rel_type") == "CONNECTS_TO").groupBy(TENANT).agg(n().alias("total_connections"))
    out = base.join(orphan_counts(components, edges), TENANT, "left").join(wires, TENANT, "left").fillna(
        0, subset=["orphaned_components", "total_connections"])
    bad = F.col("missing_position") + F.col("missing_voltage") + F.col("missing_current") + F.col("orphaned_components")
    total, score = F.col("total_components"), F.col("health_score")
    return out.withColumn("health_score", F.greatest(F.lit(0.0), (total - bad) / total * 100)).withColumn(
        "health_status", F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 50, "fair").otherwise("poor"))


def hot_spots(components: DataFrame, threshold: float = 50.0) -> DataFrame:
    return components.withColumn("power_consumption", power()).filter(F.col("power_consumption") > threshold).select(
        F.col("id").alias("component_id"), TENANT, "type", "zone", "power_consumption",
        F.when(F.col("power_consumption") > 100, "high").otherwise("medium").alias("thermal_risk"))


def thermal_zones(components, located_in, zones) -> DataFrame:
    p = F.col("total_power")
    return located_in.select(F.col("src").alias("id"), F.col("dst").alias("zone_id")).join(
        components.filter(power().isNotNull()).select("id", power().alias("w")), "id"
    ).groupBy("zone_id").agg(F.sum("w").alias("total_power"), n().alias("component_count")).join(
        zones.select(F.col("id").alias("zone_id"), TENANT, F.col("name").alias("zone_name")), "zone_id"
    ).withColumn("thermal_load", F.when(p > 200, "high").when(p > 100, "moderate").otherwise("low"))


def power_losses(edges: DataFrame, resistance: str | None = None) -> DataFrame:
    """Simple loss figures per tenant over wires; a wire is met from both ends."""
    r = F.coalesce(F.col(resistance), F.lit(0.1)) if resistance else F.lit(0.1)
    wires = edges.filter(F.col("rel_type") == "CONNECTS_TO").groupBy(TENANT).agg(
        (n() * 2).alias("connection_count"), F.avg(r).alias("avg_resistance"))
    return wires.withColumn("resistive_losses_watts", F.col("connection_count") * F.col("avg_resistance") * 0.1).withColumn(
        "conversion_losses_watts", F.col("connection_count") * 0.05).withColumn(
        "total_losses_watts", F.col("resistive_losses_watts") + F.col("conversion_losses_watts"))


def single_points_of_failure(components, powered_by) -> DataFrame:
    out_deg = powered_by.groupBy(F.col("src").alias("id")).agg(n().alias("power_sources"))
    in_deg = powered_by.groupBy(F.col("dst").alias("id")).agg(n().alias("dependents"))
    return components.select("id", TENANT, "type").join(in_deg, "id").join(out_deg, "id", "left").fillna(
        0, subset=["power_sources"]).filter("power_sources <= 1 AND dependents > 0")


def redundancy_gaps(components: DataFrame, types=("ecu", "sensor", "actuator")) -> DataFrame:
    """Components that are the only one of their type in the tenant."""
    only = components.filter(F.col("type").isin(*types)).groupBy(TENANT, "type").agg(
        n().alias("n"), F.min("id").alias("id"))
    return only.filter("n = 1").select(TENANT, "type", "id")


def potential_faults(circuits, part_of, components) -> DataFrame:
    loads = circuit_loads(circuits, part_of, components)
    over = loads.filter(F.col("total_load_current") > F.col("max_current")).select(
        TENANT, F.lit("circuit_overload").alias("fault"), F.lit("high").alias("severity"), F.col("id").alias("component_id"),
        F.concat(F.lit("Circuit "), F.col("name"), F.lit(" overloaded")).alias("description"),
        ((F.col("total_load_current") / F.nullif("max_current", F.lit(0.0)) - 1) * 100).alias("value"))
    exposed = part_of.select(F.col("src").alias("_cid"), F.col("dst").alias("id")).join(
        components.filter(~F.col("type").isin("fuse", "circuit_breaker")).select(F.col("id").alias("_cid")), "_cid"
    ).groupBy("id").agg(n().cast("double").alias("value"))
    bare = circuits.filter(F.col("protection").isNull() | (F.col("protection") == "none")).join(exposed, "id").select(
        TENANT, F.lit("missing_protection").alias("fault"), F.lit("medium").alias("severity"), F.col("id").alias("component_id"),
        F.concat(F.lit("Circuit "), F.col("name"), F.lit(" lacks protection")).alias("description"), "value")
    return over.unionByName(bare)


def fault_tolerance(components, edges, threshold: int = 5) -> DataFrame:
    """Tenant counts of weak points and the reliability score made of them."""
    powered_by = edges.filter(F.col("rel_type") == "POWERED_BY")
    total = components.groupBy(TENANT).agg(n().alias("total"))
    parts = {
        "spof_count": single_points_of_failure(components, powered_by),
        "critical_count": graph.critical_nodes(components, edges, threshold),
        "gap_count": redundancy_gaps(components),
    }
    out = total
    for name, df in parts.items():
        out = out.join(df.groupBy(TENANT).agg(n().alias(name)), TENANT, "left")
    out = out.fillna(0, subset=list(parts))
    score = 100 - F.col("spof_count") / F.col("total") * 30 - F.col("critical_count") / F.col("total") * 15 - F.col("gap_count") / F.col("total") * 20
    return out.withColumn("reliability_score", F.greatest(F.lit(0.0), score)).drop("total")


def efficiency_score(path_efficiency: DataFrame, tenants: DataFrame) -> DataFrame:
    sums = path_efficiency.groupBy(TENANT).agg(F.sum("avg_resistance").alias("r"))
    r = F.coalesce("r", F.lit(0.0))
    return tenants.join(sums, TENANT, "left").select(
        TENANT, F.when(r > 0, F.greatest(F.lit(0.5), 1.0 - r / 100)).otherwise(0.9).alias("overall_efficiency"))


def overall_health(circuit_analytics_df, faults, efficiency, hot) -> DataFrame:
    """Weighted tenant health: circuits 0.25, faults 0.30, efficiency 0.25, heat 0.20."""
    over = circuit_analytics_df.groupBy(TENANT).agg(
        n().alias("total_circuits"), count_if(F.col("load_percentage") > 100).alias("overloaded_circuits"))
    heat = hot.groupBy(TENANT).agg(n().alias("hot_spots"), count_if(F.col("thermal_risk") == "high").alias("high_risk"))
    out = faults.join(over, TENANT, "left").join(efficiency, TENANT, "left").join(heat, TENANT, "left").fillna(
        0, subset=["total_circuits", "overloaded_circuits", "hot_spots", "high_risk"])
    zero = F.lit(0).cast("bigint")
    score = (
        F.greatest(zero, 100 - F.col("overloaded_circuits") * 20) * 0.25 + F.col("reliability_score") * 0.30
        + F.col("overall_efficiency") * 100 * 0.25 + F.greatest(zero, 100 - F.col("high_risk") * 15) * 0.20)
    h = F.col("health_score")
    return out.withColumn("health_score", score).withColumn(
        "overall_status", F.when(h >= 85, "excellent").when(h >= 70, "good").when(h >= 50, "fair").otherwise("poor")
    ).withColumn("key_findings", messages(
        (F.col("overloaded_circuits") > 0, F.concat(F.col("overloaded_circuits").cast("string"), F.lit(" circuit(s) are overloaded"))),
        (F.col("spof_count") > 0, F.concat(F.col("spof_count").cast("string"), F.lit(" single points of failure identified"))),
        (F.col("overall_efficiency") < 0.8, "Power efficiency below optimal level"),
        (F.col("hot_spots") > 0, F.concat(F.col("hot_spots").cast("string"), F.lit(" thermal hot spots detected"))))
    ).withColumn("priority_actions", messages(
        (F.col("overloaded_circuits") > 0, "Address circuit overloading immediately"),
        (F.col("spof_count") > 5, "Implement redundancy for critical components"),
        (F.col("high_risk") > 0, "Implement thermal management for high-power components")))


def vehicle_stats(vehicles, components, circuits, zones, edges) -> DataFrame:
    comp = components.groupBy(TENANT).agg(n().alias("component_count"), count_if(has_position()).alias("positioned_components"))
    types = components.groupBy(TENANT, "type").agg(n().alias("c")).groupBy(TENANT).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "type", "c"))), "|").alias("type_distribution"))
    out = vehicles.select(F.col("signature").alias(TENANT), "make", "model", "year").join(comp, TENANT, "left").join(types, TENANT, "left")
    for name, df in (("circuit_count", circuits), ("zone_count", zones),
                     ("connection_count", edges.filter(F.col("rel_type") == "CONNECTS_TO"))):
        out = out.join(df.groupBy(TENANT).agg(n().alias(name)), TENANT, "left")
    out = out.fillna(0, subset=[c for c in out.columns if c.endswith("_count") or c == "positioned_components"])
    return out.withColumn("position_completeness_percent", pct(F.col("positioned_components"), F.col("component_count")))


def compare_vehicles(components: DataFrame, pairs: DataFrame) -> DataFrame:
    """Common and unique type sets of the tenant pairs asked for (``a, b``)."""
    sets = components.groupBy(TENANT).agg(F.array_sort(F.collect_set("type")).alias("types"), n().alias("n"))
    a = sets.select(F.col(TENANT).alias("a"), F.col("types").alias("ta"), F.col("n").alias("components_a"))
    b = sets.select(F.col(TENANT).alias("b"), F.col("types").alias("tb"), F.col("n").alias("components_b"))
    return pairs.join(a, "a").join(b, "b").select(
        "a", "b", "components_a", "components_b",
        F.size(F.array_intersect("ta", "tb")).cast("bigint").alias("common_types"),
        F.array_join(F.array_except("ta", "tb"), ", ").alias("unique_a"),
        F.array_join(F.array_except("tb", "ta"), ", ").alias("unique_b"),
        (F.size(F.array_intersect("ta", "tb")) > 5).alias("similar"))


def netlist_stats(components, nets, connections, unresolved, kinds: list[str]) -> DataFrame:
    """One row of totals per ``doc``; ``kinds`` lists the component types that get a column."""
    comp = components.groupBy("doc").agg(
        n().alias("total_components"),
        *[count_if(F.col("type") == k).alias(f"components_{k}") for k in kinds])
    net = nets.groupBy("doc").agg(n().alias("total_nets"), count_if(~F.col("name").startswith("Net_")).alias("named_nets"))
    con = connections.groupBy("doc").agg(n().alias("total_connections"))
    bad = unresolved.groupBy("doc").agg(n().alias("unresolved_connections"))
    out = comp.join(net, "doc", "full").join(con, "doc", "full").join(bad, "doc", "full")
    out = out.fillna(0)
    return out.withColumn("average_connections_per_net", F.when(
        F.col("total_nets") > 0, F.col("total_connections") / F.col("total_nets")).otherwise(0.0))


def bounds(df: DataFrame, padding: float = 100.0) -> DataFrame:
    placed = df.filter(has_position())
    out = placed.groupBy(TENANT).agg(*[
        e for a in "xyz" for e in ((F.min(a) - padding).alias(f"min_{a}"), (F.max(a) + padding).alias(f"max_{a}"))])
    size = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"]
    return out.withColumn("volume", size[0] * size[1] * size[2]).withColumns(
        {f"centre_{a}": (F.col(f"max_{a}") + F.col(f"min_{a}")) / 2 for a in "xyz"})


def position_distribution(df: DataFrame) -> DataFrame:
    base = df.groupBy(TENANT, F.coalesce("zone", F.lit("unknown")).alias("zone"), F.coalesce("type", F.lit("unknown")).alias("type")).agg(
        n().alias("n"), count_if(has_position()).alias("positioned"))
    sums = [F.sum("n").alias("n"), F.sum("positioned").alias("positioned")]
    by = {"zone": base.groupBy(TENANT, F.col("zone").alias("value")).agg(*sums),
          "type": base.groupBy(TENANT, F.col("type").alias("value")).agg(*sums)}
    out = None
    for kind, part in by.items():
        part = part.withColumn("by", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("position_coverage", pct(F.col("positioned"), F.col("n")))


#: Estimated volume per component type in mm3; other types count as 100000.
TYPE_VOLUME = {"battery": 5000000, "alternator": 2000000, "ecu": 500000, "relay": 50000,
               "fuse": 10000, "sensor": 25000, "connector": 15000}


def type_volume(column: str = "type") -> Column:
    found = F.try_element_at(literal_map({k: float(v) for k, v in TYPE_VOLUME.items()}), F.col(column))
    return F.coalesce(found, F.lit(100000.0))


def space_utilisation(components: DataFrame) -> DataFrame:
    used = components.groupBy(TENANT).agg(F.sum(type_volume()).alias("component_volume_mm3"))
    space = bounds(components).select(TENANT, F.col("volume").alias("vehicle_volume_mm3"))
    v = F.col("vehicle_volume_mm3")
    return used.join(space, TENANT).withColumn(
        "utilization_percentage", F.when(v > 0, F.col("component_volume_mm3") / v * 100).otherwise(0.0)
    ).withColumn("available_space_mm3", v - F.col("component_volume_mm3"))


def accessibility(located_in: DataFrame) -> DataFrame:
    a = F.coalesce("accessibility", F.lit("moderate"))
    return located_in.groupBy(TENANT).agg(
        n().alias("total_analyzed"), count_if(a == "easy").alias("easy"), count_if(a == "moderate").alias("moderate"),
        count_if(a == "difficult").alias("difficult"),
        count_if(F.col("service_access_required") & (a == "difficult")).alias("service_access_issues"))


def service_issues(located_in: DataFrame) -> DataFrame:
    return located_in.filter(F.col("service_access_required") & (F.col("accessibility") == "difficult")).select(
        F.col("src").alias("component_id"), TENANT, F.lit("requires_service_but_difficult_access").alias("issue"))


def dashboard(profiles, jobs, favourites, now: Column) -> DataFrame:
    """Per user: jobs by outcome, jobs of the last 30 days, favourites."""
    j = jobs.groupBy("user_id").agg(
        n().alias("total_models_generated"), count_if(F.col("status") == "completed").alias("completed_models"),
        count_if(F.col("status") == "failed").alias("failed_models"),
        count_if(F.col("created_at") > now - F.make_dt_interval(F.lit(30))).alias("models_last_30_days"))
    f = favourites.groupBy("user_id").agg(n().alias("favorite_models_count"))
    return profiles.join(j, "user_id", "left").join(f, "user_id", "left").fillna(
        0, subset=["total_models_generated", "completed_models", "failed_models", "models_last_30_days", "favorite_models_count"])


def ops_stats(jobs: DataFrame) -> DataFrame:
    """Jobs by project and status with sizes; rows with null status are the project totals."""
    return jobs.rollup("project_id", "status").agg(
        n().alias("n"), F.sum("size_bytes").alias("size_bytes"), F.count_distinct("user_id").alias("users"))


def engine_report(runs: DataFrame) -> DataFrame:
    """Per engine: time and elements per page, errors, and the ratio to the fastest engine."""
    base = runs.groupBy("engine").agg(
        n().alias("pages"), F.sum("elements").alias("total_elements"), F.sum("seconds").alias("total_time"),
        count_if(F.col("failed")).alias("errors"))
    every = Window.partitionBy()  # one row per engine is left here
    best = base.withColumns({"_t": F.min("total_time").over(every), "_e": F.max("total_elements").over(every)})
    return best.select(
        "engine", "pages", "total_elements", "total_time", "errors",
        (F.col("total_time") / F.col("pages")).alias("avg_time_per_page"),
        (F.col("total_elements") / F.col("pages")).alias("avg_elements_per_page"),
        (F.col("total_time") / F.nullif("_t", F.lit(0.0))).alias("slower_than_best"),
        (F.col("_e") - F.col("total_elements")).alias("elements_behind_best"))


def tier_summary(tiers: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tiers.items():
        part = df.groupBy("page").agg(n().alias("items")).select(F.lit(name).alias("tier"), "page", "items")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("tier").agg(F.sum("items").alias("items"), n().alias("pages"), F.max("items").alias("max_items_on_page"))


def collection_stats(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Points per key combination; nulls mark the totals of a rollup."""
    return vectors.rollup(*keys).agg(n().alias("points"))


def ocr_quality(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    return spans.groupBy(key).agg(F.avg("confidence").alias("avg_confidence")).withColumns({
        "cer": F.greatest(F.lit(0.0), (1 - F.col("avg_confidence")) * 0.3),
        "wer": F.greatest(F.lit(0.0), (1 - F.col("avg_confidence")) * 0.4)})


def op_stats(calls: DataFrame, recent: int = 100, slow: float = 1.0) -> DataFrame:
    """Per operation: totals over all calls and figures over its latest ``recent`` calls.

    ``calls``: ``operation, ts, call_id, duration``.
    """
    total = calls.groupBy("operation").agg(
        n().alias("total_calls"), F.sum("duration").alias("total_duration"), F.avg("duration").alias("average_duration"),
        count_if(F.col("duration") > slow).alias("slow_calls"))
    last = top_rows(calls, "operation", [F.col("ts").desc(), F.col("call_id").desc()], recent).groupBy("operation").agg(
        n().alias("recent_calls"), F.avg("duration").alias("recent_avg_duration"),
        F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"))
    return total.join(last, "operation")


def latency_stats(searches: DataFrame, key: str, size: int = 1000) -> DataFrame:
    """Mean, p95 and p99 of the latest ``size`` searches per key, and the error rate over all."""
    total = searches.groupBy(key).agg(n().alias("total_searches"), count_if(F.col("failed")).alias("total_errors"))
    last = top_rows(searches, key, [F.col("ts").desc(), F.col("search_id").desc()], size).groupBy(key).agg(
        F.avg("latency").alias("latency_mean"), F.percentile("latency", 0.95).alias("latency_p95"),
        F.percentile("latency", 0.99).alias("latency_p99"))
    return total.join(last, key).withColumn("error_rate", F.col("total_errors") / F.greatest(F.col("total_searches"), F.lit(1)))


def page_summaries(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """Summary sentence per page: entity counts, types, power nets, first ten terms.

    ``entities``: ``page, kind ('component'|'net'), name, type``; ``terms``: ``page, term``.
    """
    is_component, is_net = F.col("kind") == "component", F.col("kind") == "net"
    base = entities.groupBy("page").agg(
        count_if(is_component).alias("components"), count_if(is_net).alias("nets"),
        F.array_sort(F.collect_set(F.when(is_component, F.col("type")))).alias("types"),
        F.array_sort(F.collect_set(F.when(is_net & F.lower("name").rlike("vcc|gnd|power|supply"), F.col("name")))).alias("power_nets"))
    words = top_rows(terms.select("page", "term").distinct(), "page", [F.col("term")], 10).groupBy("page").agg(
        F.array_sort(F.collect_list("term")).alias("terms"))

    def listed(label: str, column: str) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(f"{label}: "), F.array_join(column, ", "), F.lit(".")))

    text = F.concat_ws(" ", F.format_string("Page %s schematic analysis summary.", F.col("page").cast("string")),
                       F.format_string("Contains %d components and %d electrical nets.", "components", "nets"),
                       listed("Component types", "types"), listed("Power nets", "power_nets"), listed("Key technical terms", "terms"))
    return base.join(words, "page", "left").select("page", "components", "nets", text.alias("summary"))


def power_budget(components: DataFrame, powered_by: DataFrame) -> DataFrame:
    """Per tenant: source capacity against consumption, peak, average, margin, critical loads."""
    w = F.coalesce(power(), F.lit(0.0))
    is_source = F.col("type").isin(*SOURCES)
    base = components.groupBy(TENANT).agg(
        F.sum(F.when(is_source, w).otherwise(0.0)).alias("total_available_power"),
        F.sum(F.when(~is_source, w).otherwise(0.0)).alias("total_consumed_power"),
        F.max(F.when(~is_source, w)).alias("peak_power"), F.avg(F.when(~is_source, power())).alias("average_power"))
    crit = single_points_of_failure(components, powered_by).filter(~F.col("type").isin(*SOURCES)).groupBy(TENANT).agg(
        n().alias("critical_loads"))
    return base.join(crit, TENANT, "left").fillna(0, subset=["critical_loads"]).withColumn(
        "power_margin", F.col("total_available_power") - F.col("total_consumed_power")).withColumn(
        "power_efficiency", F.when(F.col("total_available_power") > 0,
                                   F.least(F.lit(1.0), F.col("total_consumed_power") / F.col("total_available_power"))).otherwise(0.0))


def zone_utilisation(components: DataFrame, zones: DataFrame) -> DataFrame:
    """Per zone: extent of its components, occupied volume, share, access and upkeep class."""
    placed = components.filter(F.col("zone").isNotNull()).groupBy(F.col("zone").alias("id")).agg(
        n().alias("component_count"), F.sum(type_volume()).alias("occupied_volume"),
        *[(F.max(a) - F.min(a)).alias(f"d{a}") for a in "xyz"])
    out = zones.join(placed, "id", "left").fillna(0, subset=["component_count", "occupied_volume"])
    out = out.withColumn("volume", F.coalesce(F.col("dx") * F.col("dy") * F.col("dz"), F.lit(0.0)))
    hard = F.col("access_level") == "difficult"
    return out.select(
        F.col("id").alias("zone_id"), TENANT, "component_count", "volume", "occupied_volume",
        F.when(F.col("volume") > 0, F.col("occupied_volume") / F.col("volume") * 100).otherwise(0.0).alias("utilization_percentage"),
        F.col("access_level").alias("accessibility"),
        F.when(hard & (F.col("component_count") > 20), "high").when(hard | (F.col("component_count") > 20), "medium").otherwise("low").alias("maintenance_complexity"))


def harnesses(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Wires grouped by the zones they join: count, total and longest straight length."""
    at = components.filter(has_position()).select("id", "zone", "x", "y", "z")
    a, b = at.alias("a"), at.alias("b")
    wires = edges.filter(F.col("rel_type") == "CONNECTS_TO").alias("e").join(a, F.col("e.src") == F.col("a.id")).join(
        b, F.col("e.dst") == F.col("b.id"))
    d = [F.col(f"a.{k}") - F.col(f"b.{k}") for k in "xyz"]
    za, zb = F.coalesce("a.zone", F.lit("unassigned")), F.coalesce("b.zone", F.lit("unassigned"))
    return wires.select(
        F.col("e.vehicle_signature"), F.concat_ws("-", F.least(za, zb), F.greatest(za, zb)).alias("harness"),
        F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("length")
    ).groupBy(TENANT, "harness").agg(n().alias("wires"), F.sum("length").alias("total_length"), F.max("length").alias("longest"))


def unconnected(components: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return components.join(ends, "id", "left_anti")
