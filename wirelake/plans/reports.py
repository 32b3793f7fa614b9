"""Queries for aggregate reports (A ids)."""

from pyspark.sql import functions as F

from wirelake.operators import aggregates as op
from wirelake.operators import graph
from wirelake.plans.registry import query

POS = "x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def joined(df, *columns):
    return df.withColumns({c: F.array_join(c, "; ") for c in columns})


@query("a01_system_overview", f"""SELECT signature AS vehicle_signature, make, model, year, coalesce(component_count,0) AS component_count,
coalesce(circuit_count,0) AS circuit_count, coalesce(zone_count,0) AS zone_count, coalesce(connection_count,0) AS connection_count,
coalesce(power_relationship_count,0) AS power_relationship_count, coalesce(control_relationship_count,0) AS control_relationship_count,
round(CASE WHEN component_count>0 THEN p*100.0::DOUBLE/component_count ELSE 0 END,1) AS position_data_percent,
round(CASE WHEN component_count>0 THEN v*100.0::DOUBLE/component_count ELSE 0 END,1) AS voltage_data_percent,
round(CASE WHEN component_count>0 THEN c*100.0::DOUBLE/component_count ELSE 0 END,1) AS current_data_percent
FROM vehicles LEFT JOIN (SELECT vehicle_signature vs, count(*) component_count, count(*) FILTER ({POS}) p, count(voltage_rating) v, count(current_rating) c FROM components GROUP BY 1) a ON a.vs=signature
LEFT JOIN (SELECT vehicle_signature vs, count(*) circuit_count FROM circuits GROUP BY 1) b ON b.vs=signature
LEFT JOIN (SELECT vehicle_signature vs, count(*) zone_count FROM zones GROUP BY 1) z ON z.vs=signature
LEFT JOIN (SELECT vehicle_signature vs, count(*) FILTER (rel_type='CONNECTS_TO') connection_count, count(*) FILTER (rel_type='POWERED_BY') power_relationship_count,
 count(*) FILTER (rel_type='CONTROLS') control_relationship_count FROM edges GROUP BY 1) e ON e.vs=signature""",
       ("vehicles", "components", "circuits", "zones", "edges"))
def _(t):
    return op.system_overview(t.vehicles, t.components, t.circuits, t.zones, t.edges)


@query("a02_type_analytics", f"""SELECT vehicle_signature, type, count(*) AS count, round(avg(voltage_rating),6) AS avg_voltage, round(avg(current_rating),6) AS avg_current,
round(coalesce(sum(voltage_rating*current_rating),0),6) AS total_power, count(*) FILTER ({POS}) AS positioned_count,
string_agg(DISTINCT zone, '; ' ORDER BY zone) AS zones_used, string_agg(DISTINCT manufacturer, '; ' ORDER BY manufacturer) AS manufacturers,
round(count(*) FILTER ({POS})/count(*)*100,6) AS position_coverage_percent, round(count(*)/sum(count(*)) OVER (PARTITION BY vehicle_signature)*100,6) AS percentage_of_total
FROM components GROUP BY vehicle_signature, type""", "components")
def _(t):
    return joined(r6(op.type_analytics(t.components), "avg_voltage", "avg_current", "total_power", "position_coverage_percent", "percentage_of_total"), "zones_used", "manufacturers")


@query("a03_zone_analytics", f"""SELECT vehicle_signature, coalesce(zone,'unassigned') AS zone, count(*) AS count, round(avg(voltage_rating),6) AS avg_voltage, round(avg(current_rating),6) AS avg_current,
round(coalesce(sum(voltage_rating*current_rating),0),6) AS total_power, count(*) FILTER ({POS}) AS positioned_count,
string_agg(DISTINCT type, '; ' ORDER BY type) AS component_types, count(DISTINCT type) AS type_diversity,
round(count(*) FILTER ({POS})/count(*)*100,6) AS position_coverage_percent, round(count(*)/sum(count(*)) OVER (PARTITION BY vehicle_signature)*100,6) AS percentage_of_total
FROM components GROUP BY vehicle_signature, coalesce(zone,'unassigned')""", "components")
def _(t):
    return joined(r6(op.zone_analytics(t.components), "avg_voltage", "avg_current", "total_power", "position_coverage_percent", "percentage_of_total"), "component_types")


LOADS = """loads AS (SELECT c.id, c.vehicle_signature, c.name, c.circuit_type, c.voltage, c.max_current, c.protection, c.safety_critical,
 coalesce(m.n,0) AS component_count, coalesce(m.cur,0) AS total_load_current, coalesce(m.pw,0) AS total_power,
 CASE WHEN c.max_current>0 THEN coalesce(m.cur,0)/c.max_current*100 ELSE 0 END AS load_percentage,
 CASE WHEN c.max_current>0 THEN c.max_current-coalesce(m.cur,0) ELSE 0 END AS available_capacity
 FROM circuits c LEFT JOIN (SELECT p.dst, count(*) n, sum(coalesce(k.current_rating,0)) cur, sum(coalesce(k.voltage_rating*k.current_rating,0)) pw
 FROM part_of p JOIN components k ON k.id=p.src GROUP BY p.dst) m ON m.dst=c.id)"""
CIRC = ("circuits", "part_of", "components")


@query("a04_circuit_analytics", f"""WITH {LOADS} SELECT id AS circuit_id, vehicle_signature, name, circuit_type, voltage, max_current AS max_capacity, protection, safety_critical,
component_count, round(total_load_current,6) AS total_load_current, round(total_power,4) AS total_power, round(load_percentage,6) AS load_percentage,
round(available_capacity,6) AS available_capacity, CASE WHEN load_percentage>100 THEN 'overloaded' WHEN load_percentage>90 THEN 'critical' WHEN load_percentage>80 THEN 'heavily_loaded'
WHEN load_percentage>60 THEN 'moderately_loaded' ELSE 'normal' END AS status FROM loads""", CIRC)
def _(t):
    return r6(op.circuit_analytics(t.circuits, t.part_of, t.components), "total_load_current", "load_percentage", "available_capacity").withColumn("total_power", F.round("total_power", 4))


@query("a05_circuit_summary", f"""WITH {LOADS} SELECT vehicle_signature, count(*) AS total_circuits, count(*) FILTER (load_percentage>100) AS overloaded_circuits,
count(*) FILTER (load_percentage>80 AND load_percentage<=100) AS heavily_loaded_circuits, count(*) FILTER (safety_critical) AS safety_critical_circuits,
count(*) FILTER (protection IS NULL OR protection IN ('','none')) AS circuits_without_protection FROM loads GROUP BY 1""", CIRC)
def _(t):
    return op.circuit_summary(op.circuit_analytics(t.circuits, t.part_of, t.components))


@query("a06_overloaded_circuits", f"""WITH {LOADS} SELECT id AS circuit_id, vehicle_signature, round(total_load_current,6) AS total_load, round(total_load_current/nullif(max_current,0),6) AS load_factor,
round(total_load_current-max_current,6) AS overload_amount FROM loads WHERE total_load_current>max_current""", CIRC)
def _(t):
    return r6(op.overloaded(t.circuits, t.part_of, t.components), "total_load", "load_factor", "overload_amount")


@query("a07_circuit_load_detail", f"""WITH {LOADS} SELECT l.id AS circuit_id, l.vehicle_signature, component_count, round(total_load_current,6) AS total_load_current, round(total_power,4) AS total_power,
round(load_percentage,6) AS load_percentage, round(available_capacity,6) AS safety_margin, load_percentage>100 AS is_overloaded, k.id AS component_id, k.type AS component_type, k.current_rating, k.voltage_rating
FROM loads l LEFT JOIN (part_of p JOIN components k ON k.id=p.src) ON p.dst=l.id""", CIRC)
def _(t):
    return r6(op.circuit_load_detail(t.circuits, t.part_of, t.components), "total_load_current", "load_percentage", "safety_margin").withColumn("total_power", F.round("total_power", 4))


@query("a08_circuit_comprehensive", """SELECT circuit_id, vehicle_signature, name, total_components, power_sources, loads, protection_devices, round(cur,6) AS total_current_draw,
round(lf,6) AS load_factor, 5.0::DOUBLE AS voltage_drop_percentage,
CASE WHEN protection_devices>0 AND lf<80 THEN 0.9 WHEN protection_devices>0 THEN 0.7 WHEN lf<80 THEN 0.6 ELSE 0.4 END::DOUBLE AS reliability_score,
concat_ws('; ', CASE WHEN lf>100 THEN 'Circuit overloaded - load exceeds capacity' WHEN lf>80 THEN 'Circuit heavily loaded - consider capacity upgrade' END,
 CASE WHEN protection_devices=0 THEN 'No protection devices found in circuit' END) AS potential_issues
FROM (SELECT c.id AS circuit_id, c.vehicle_signature, c.name, count(k.id) AS total_components, count(*) FILTER (k.type IN ('battery','alternator','power_supply')) AS power_sources,
 count(*) FILTER (k.type NOT IN ('battery','alternator','power_supply','fuse','relay')) AS loads, count(*) FILTER (k.type IN ('fuse','circuit_breaker')) AS protection_devices,
 sum(coalesce(k.current_rating,0)) AS cur, CASE WHEN c.max_current>0 THEN sum(coalesce(k.current_rating,0))/c.max_current*100 ELSE 0 END AS lf
 FROM circuits c LEFT JOIN (part_of p JOIN components k ON k.id=p.src) ON p.dst=c.id GROUP BY c.id, c.vehicle_signature, c.name, c.max_current) q""", CIRC)
def _(t):
    return joined(r6(op.circuit_comprehensive(t.circuits, t.part_of, t.components), "total_current_draw", "load_factor"), "potential_issues")


@query("a08_circuit_roles", """SELECT p.dst AS circuit_id, k.id AS component_id, k.type, CASE WHEN k.type IN ('battery','alternator','power_supply') THEN 'power_source'
WHEN k.type IN ('fuse','circuit_breaker') THEN 'protection_device' WHEN k.type='relay' THEN 'switching' ELSE 'load' END AS role FROM part_of p JOIN components k ON k.id=p.src""", ("part_of", "components"))
def _(t):
    return op.circuit_roles(t.part_of, t.components).join(t.components.select(F.col("id").alias("component_id"), "type"), "component_id")


# breadth-first over at most five steps, loads below each source
FLOW = """hops AS (SELECT dst AS s, src AS n, 1 AS d FROM powered_by UNION
 SELECT h.s, p.src, h.d+1 FROM hops h JOIN powered_by p ON p.dst=h.n WHERE h.d<5),
flow AS (SELECT c.id AS source_id, c.vehicle_signature, c.type, coalesce(c.current_rating,0) AS capacity, count(l.id) AS loads_powered, sum(coalesce(l.current_rating,0)) AS current_load
FROM components c LEFT JOIN (SELECT DISTINCT s, n FROM hops) h ON h.s=c.id LEFT JOIN components l ON l.id=h.n
WHERE c.type IN ('battery','alternator','power_supply') GROUP BY c.id, c.vehicle_signature, c.type, c.current_rating)"""


@query("a09_power_flow", f"""WITH RECURSIVE {FLOW} SELECT source_id, vehicle_signature, type, capacity, loads_powered, round(current_load,6) AS current_load,
round(CASE WHEN capacity>0 THEN current_load/capacity*100 ELSE 0 END,6) AS utilization_percent,
CASE WHEN capacity>0 AND current_load/capacity*100>100 THEN 'overloaded' WHEN capacity>0 AND current_load/capacity*100>80 THEN 'high' ELSE 'normal' END AS status FROM flow""", ("components", "powered_by"))
def _(t):
    return r6(op.power_flow(t.components, t.powered_by), "current_load", "utilization_percent")


@query("a09_power_flow_summary", f"""WITH RECURSIVE {FLOW} SELECT vehicle_signature, round(sum(capacity),6) AS total_capacity, round(sum(current_load),6) AS total_load, count(*) AS power_source_count,
round(sum(current_load)/sum(capacity)*100,6) AS system_utilization_percent, count(*)>1 AS redundancy_available FROM flow GROUP BY 1""", ("components", "powered_by"))
def _(t):
    return r6(op.power_flow_summary(op.power_flow(t.components, t.powered_by)), "total_capacity", "total_load", "system_utilization_percent")


TRAILS = """ways AS (SELECT DISTINCT src, dst, rel_type FROM edges WHERE rel_type IN ('POWERED_BY','CONNECTS_TO')),
w AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst, rel_type) AS eid FROM ways),
trails AS (SELECT id AS s, vehicle_signature AS vs, id AS n, 0 AS len, CAST([] AS BIGINT[]) AS used FROM components WHERE type IN ('battery','alternator')
 UNION ALL SELECT t.s, t.vs, w.dst, t.len+1, list_append(t.used, w.eid) FROM trails t JOIN w ON w.src=t.n WHERE t.len<5 AND NOT list_contains(t.used, w.eid))"""


@query("a10_path_histogram", f"""WITH RECURSIVE {TRAILS} SELECT t.vs AS vehicle_signature, t.len AS path_length, count(*) AS path_count FROM trails t JOIN components c ON c.id=t.n
WHERE t.len>0 AND c.type NOT IN ('battery','alternator') GROUP BY 1,2""", ("components", "edges"))
def _(t):
    return graph.path_histogram(t.edges, t.components)


@query("g12_path_efficiency", f"""WITH RECURSIVE {TRAILS} SELECT t.vs AS vehicle_signature, t.s AS source_id, round(avg(t.len*0.1::DOUBLE),9) AS avg_resistance, round(avg(t.len),9) AS avg_path_length, count(*) AS path_count
FROM trails t JOIN components c ON c.id=t.n WHERE t.len>0 AND c.type NOT IN ('battery','alternator') GROUP BY 1,2""", ("components", "edges"))
def _(t):
    return graph.path_efficiency(t.edges, t.components).withColumns({c: F.round(c, 9) for c in ("avg_resistance", "avg_path_length")})


QUALITY = f"""base AS (SELECT vehicle_signature, count(*) AS total_components, count(*) FILTER ({POS})/count(*)*100 AS position_percent, count(zone)/count(*)*100 AS zone_percent,
count(voltage_rating)/count(*)*100 AS voltage_percent, count(current_rating)/count(*)*100 AS current_percent,
count(*) FILTER (voltage_rating IS NOT NULL AND current_rating IS NOT NULL)/count(*)*100 AS electrical_percent, count(*) FILTER (name<>'')/count(*)*100 AS name_percent,
count(*) FILTER (part_number<>'')/count(*)*100 AS part_number_percent, count(*) FILTER (manufacturer<>'')/count(*)*100 AS manufacturer_percent,
count(*) FILTER (id NOT IN (SELECT src FROM all_edges) AND id NOT IN (SELECT dst FROM all_edges)) AS orphaned_components FROM components GROUP BY 1)"""


@query("a11_data_quality", f"""WITH {QUALITY} SELECT vehicle_signature, total_components, orphaned_components, round(position_percent,6) AS position_percent, round(zone_percent,6) AS zone_percent,
round(voltage_percent,6) AS voltage_percent, round(current_percent,6) AS current_percent, round(electrical_percent,6) AS electrical_percent, round(name_percent,6) AS name_percent,
round(part_number_percent,6) AS part_number_percent, round(manufacturer_percent,6) AS manufacturer_percent,
round((position_percent+zone_percent+voltage_percent+current_percent+name_percent+part_number_percent+manufacturer_percent)/7,6) AS overall_quality_score,
concat_ws('; ', CASE WHEN position_percent<80 THEN printf('Only %.1f%% of components have position data', position_percent) END,
CASE WHEN electrical_percent<90 THEN printf('Only %.1f%% of components have complete electrical ratings', electrical_percent) END,
CASE WHEN orphaned_components>0 THEN concat(orphaned_components, ' components have no relationships') END) AS issues,
concat_ws('; ', CASE WHEN position_percent<50 THEN 'Prioritize spatial data mapping for 3D visualization' END, CASE WHEN electrical_percent<70 THEN 'Complete electrical specifications for better analysis' END,
CASE WHEN name_percent<95 THEN 'Improve component naming for better identification' END) AS recommendations FROM base""", ("components", "all_edges"))
def _(t):
    df = op.data_quality(t.components, t.all_edges)
    return joined(r6(df, *[c for c in df.columns if c.endswith("_percent")], "overall_quality_score"), "issues", "recommendations")


@query("a12_daily_trend", """SELECT project_id AS vehicle_signature, CAST(created_at AS DATE) AS creation_date, count(*) AS components_added, string_agg(DISTINCT status, '; ' ORDER BY status) AS types_added
FROM jobs WHERE created_at >= TIMESTAMP '1998-01-01' - INTERVAL 900 DAY GROUP BY 1,2""", "jobs")
def _(t):
    jobs = t.jobs.withColumnRenamed("project_id", "vehicle_signature")
    return joined(op.daily_trend(jobs, 900, F.lit("1998-01-01").cast("timestamp_ntz"), kind="status"), "types_added")


@query("a13_distributions", """SELECT vehicle_signature, 'type' AS by, type AS value, count(*) AS n FROM components GROUP BY 1,3 UNION ALL
SELECT vehicle_signature, 'zone', zone, count(*) FROM components WHERE zone IS NOT NULL GROUP BY 1,3 UNION ALL
SELECT vehicle_signature, 'circuit_type', circuit_type, count(*) FROM circuits GROUP BY 1,3""", ("components", "circuits"))
def _(t):
    a = op.distribution(t.components, "type").withColumn("by", F.lit("type"))
    b = op.distribution(t.components, "zone").withColumn("by", F.lit("zone"))
    return a.unionByName(b).unionByName(op.distribution(t.circuits, "circuit_type").withColumn("by", F.lit("circuit_type")))


@query("a14_summary_stats", f"""SELECT vehicle_signature, count(*) AS total_components, count(DISTINCT type) AS unique_types, count(DISTINCT zone) AS zones_used, count(DISTINCT manufacturer) AS manufacturers,
count(*) FILTER ({POS}) AS components_with_position, count(voltage_rating) AS components_with_voltage, count(current_rating) AS components_with_current, round(avg(voltage_rating),6) AS avg_voltage,
round(avg(current_rating),6) AS avg_current, max(voltage_rating) AS max_voltage, max(current_rating) AS max_current FROM components GROUP BY 1""", "components")
def _(t):
    return r6(op.summary_stats(t.components), "avg_voltage", "avg_current")


@query("a15_edge_stats", "SELECT vehicle_signature, rel_type, count(*) AS n FROM all_edges WHERE src IN (SELECT id FROM components) GROUP BY 1,2", ("components", "all_edges"))
def _(t):
    return op.edge_stats(t.all_edges, t.components)


@query("a16_by_manufacturer", "SELECT vehicle_signature, manufacturer, count(*) AS component_count, string_agg(DISTINCT type, '; ' ORDER BY type) AS component_types FROM components WHERE manufacturer IS NOT NULL GROUP BY 1,2", "components")
def _(t):
    return joined(op.by_manufacturer(t.components), "component_types")


@query("a17_system_loads", """SELECT vehicle_signature, type, round(sum(current_rating),6) AS total_current, round(avg(current_rating),6) AS average_current, max(current_rating) AS peak_current, count(*) AS component_count
FROM components WHERE current_rating IS NOT NULL AND type NOT IN ('battery','alternator') GROUP BY GROUPING SETS ((vehicle_signature), (vehicle_signature, type))""", "components")
def _(t):
    return r6(op.system_loads(t.components), "total_current", "average_current")


@query("a18_system_health", f"""WITH b AS (SELECT vehicle_signature, count(*) AS total_components, count(*) FILTER (NOT ({POS})) AS missing_position, count(*) FILTER (voltage_rating IS NULL) AS missing_voltage,
count(*) FILTER (current_rating IS NULL) AS missing_current, count(*) FILTER (id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges)) AS orphaned_components FROM components GROUP BY 1),
s AS (SELECT b.*, coalesce(n,0) AS total_connections, greatest(0.0, (total_components-missing_position-missing_voltage-missing_current-orphaned_components)/total_components*100) AS health_score
FROM b LEFT JOIN (SELECT vehicle_signature, count(*) n FROM connects_to GROUP BY 1) e USING (vehicle_signature))
SELECT * REPLACE (round(health_score,6) AS health_score), CASE WHEN health_score>=90 THEN 'excellent' WHEN health_score>=75 THEN 'good' WHEN health_score>=50 THEN 'fair' ELSE 'poor' END AS health_status FROM s""", ("components", "edges"))
def _(t):
    return r6(op.system_health(t.components, t.edges), "health_score")


@query("a19_hot_spots", """SELECT id AS component_id, vehicle_signature, type, zone, round(voltage_rating*current_rating,6) AS power_consumption, CASE WHEN voltage_rating*current_rating>100 THEN 'high' ELSE 'medium' END AS thermal_risk
FROM components WHERE voltage_rating*current_rating>50""", "components")
def _(t):
    return r6(op.hot_spots(t.components), "power_consumption")


@query("a19_thermal_zones", """SELECT z.id AS zone_id, z.vehicle_signature, z.name AS zone_name, round(sum(voltage_rating*current_rating),4) AS total_power, count(*) AS component_count,
CASE WHEN sum(voltage_rating*current_rating)>200 THEN 'high' WHEN sum(voltage_rating*current_rating)>100 THEN 'moderate' ELSE 'low' END AS thermal_load
FROM located_in l JOIN components c ON c.id=l.src JOIN zones z ON z.id=l.dst WHERE voltage_rating*current_rating IS NOT NULL GROUP BY 1,2,3""", ("located_in", "components", "zones"))
def _(t):
    return op.thermal_zones(t.components, t.located_in, t.zones).withColumn("total_power", F.round("total_power", 4))


@query("a20_power_losses", """SELECT vehicle_signature, count(*)*2 AS connection_count, 0.1::DOUBLE AS avg_resistance, round(count(*)*2*0.1*0.1,6)::DOUBLE AS resistive_losses_watts,
round(count(*)*2*0.05,6)::DOUBLE AS conversion_losses_watts, round(count(*)*2*0.06,6)::DOUBLE AS total_losses_watts FROM connects_to GROUP BY 1""", "connects_to")
def _(t):
    return r6(op.power_losses(t.edges), "avg_resistance", "resistive_losses_watts", "conversion_losses_watts", "total_losses_watts")


CRITICAL = """feeds AS (SELECT DISTINCT src, dst FROM edges WHERE rel_type IN ('POWERED_BY','CONTROLS')),
h1 AS (SELECT src AS s, dst AS n FROM feeds), h2 AS (SELECT DISTINCT h1.s, f.dst AS n FROM h1 JOIN feeds f ON f.src=h1.n), h3 AS (SELECT DISTINCT h2.s, f.dst AS n FROM h2 JOIN feeds f ON f.src=h2.n),
reach AS (SELECT n AS id, count(DISTINCT s) AS dep FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) q GROUP BY 1),
crit AS (SELECT c.id, c.vehicle_signature, c.type, coalesce(dep,0) AS dependency_count, CASE WHEN coalesce(dep,0)>5 THEN 'high_dependency' WHEN c.type IN ('battery','alternator','ecu') THEN 'critical_type' END AS criticality_reason
FROM components c LEFT JOIN reach r ON r.id=c.id WHERE coalesce(dep,0)>5 OR c.type IN ('battery','alternator','ecu'))"""
SPOF = """od AS (SELECT src, count(*) n FROM powered_by GROUP BY 1), idg AS (SELECT dst, count(*) n FROM powered_by GROUP BY 1),
spof AS (SELECT c.id, c.vehicle_signature, c.type, coalesce(od.n,0) AS power_sources, idg.n AS dependents FROM components c JOIN idg ON idg.dst=c.id LEFT JOIN od ON od.src=c.id WHERE coalesce(od.n,0)<=1)"""
GAPS = "gaps AS (SELECT vehicle_signature, type, min(id) AS id FROM components WHERE type IN ('ecu','sensor','actuator') GROUP BY 1,2 HAVING count(*)=1)"
FAULT = f"""{CRITICAL}, {SPOF}, {GAPS}, faults AS (SELECT t.vehicle_signature, coalesce(a.n,0) AS spof_count, coalesce(b.n,0) AS critical_count, coalesce(g.n,0) AS gap_count,
greatest(0.0, 100-coalesce(a.n,0)/total*30-coalesce(b.n,0)/total*15-coalesce(g.n,0)/total*20) AS reliability_score
FROM (SELECT vehicle_signature, count(*) total FROM components GROUP BY 1) t LEFT JOIN (SELECT vehicle_signature, count(*) n FROM spof GROUP BY 1) a USING (vehicle_signature)
LEFT JOIN (SELECT vehicle_signature, count(*) n FROM crit GROUP BY 1) b USING (vehicle_signature) LEFT JOIN (SELECT vehicle_signature, count(*) n FROM gaps GROUP BY 1) g USING (vehicle_signature))"""


@query("a21_fault_tolerance", f"WITH {FAULT} SELECT vehicle_signature, spof_count, critical_count, gap_count, round(reliability_score,6) AS reliability_score FROM faults", ("components", "edges"))
def _(t):
    return r6(op.fault_tolerance(t.components, t.edges), "reliability_score")


@query("a21_single_points_of_failure", f"WITH {SPOF} SELECT * FROM spof", ("components", "powered_by"))
def _(t):
    return op.single_points_of_failure(t.components, t.powered_by)


@query("a21_potential_faults", f"""WITH {LOADS} SELECT vehicle_signature, 'circuit_overload' AS fault, 'high' AS severity, id AS component_id, concat('Circuit ', name, ' overloaded') AS description,
round((total_load_current/max_current-1)*100,6) AS value FROM loads WHERE total_load_current>max_current AND max_current>0
UNION ALL SELECT c.vehicle_signature, 'missing_protection', 'medium', c.id, concat('Circuit ', c.name, ' lacks protection'), count(*)::DOUBLE
FROM circuits c JOIN part_of p ON p.dst=c.id JOIN components k ON k.id=p.src WHERE (c.protection IS NULL OR c.protection='none') AND k.type NOT IN ('fuse','circuit_breaker') GROUP BY c.vehicle_signature, c.id, c.name""", CIRC)
def _(t):
    return r6(op.potential_faults(t.circuits, t.part_of, t.components), "value")


@query("g04_critical_nodes", f"WITH {CRITICAL} SELECT * FROM crit", ("components", "edges"))
def _(t):
    return graph.critical_nodes(t.components, t.edges, 5)


@query("j15_redundancy_gaps", f"WITH {GAPS} SELECT * FROM gaps", "components")
def _(t):
    return op.redundancy_gaps(t.components)


@query("a22_overall_health", f"""WITH RECURSIVE {TRAILS}, {FAULT}, {LOADS},
eff AS (SELECT vehicle_signature, CASE WHEN coalesce(r,0)>0 THEN greatest(0.5, 1.0-r/100) ELSE 0.9 END AS overall_efficiency FROM (SELECT DISTINCT vehicle_signature FROM components) v
 LEFT JOIN (SELECT vs, sum(a) AS r FROM (SELECT t.vs, t.s, avg(t.len*0.1) AS a FROM trails t JOIN components c ON c.id=t.n WHERE t.len>0 AND c.type NOT IN ('battery','alternator') GROUP BY 1,2) q GROUP BY 1) e ON e.vs=v.vehicle_signature),
ov AS (SELECT vehicle_signature, count(*) AS total_circuits, count(*) FILTER (load_percentage>100) AS overloaded_circuits FROM loads GROUP BY 1),
heat AS (SELECT vehicle_signature, count(*) AS hot_spots, count(*) FILTER (voltage_rating*current_rating>100) AS high_risk FROM components WHERE voltage_rating*current_rating>50 GROUP BY 1),
h AS (SELECT f.*, coalesce(total_circuits,0) AS total_circuits, coalesce(overloaded_circuits,0) AS overloaded_circuits, overall_efficiency, coalesce(hot_spots,0) AS hot_spots, coalesce(high_risk,0) AS high_risk,
greatest(0,100-coalesce(overloaded_circuits,0)*20)*0.25::DOUBLE+reliability_score*0.30::DOUBLE+overall_efficiency*25+greatest(0,100-coalesce(high_risk,0)*15)*0.20::DOUBLE AS health_score
FROM faults f LEFT JOIN ov USING (vehicle_signature) LEFT JOIN eff USING (vehicle_signature) LEFT JOIN heat USING (vehicle_signature))
SELECT * REPLACE (round(health_score,6) AS health_score, round(reliability_score,6) AS reliability_score, round(overall_efficiency,6)::DOUBLE AS overall_efficiency), CASE WHEN health_score>=85 THEN 'excellent' WHEN health_score>=70 THEN 'good' WHEN health_score>=50 THEN 'fair' ELSE 'poor' END AS overall_status,
concat_ws('; ', CASE WHEN overloaded_circuits>0 THEN concat(overloaded_circuits,' circuit(s) are overloaded') END, CASE WHEN spof_count>0 THEN concat(spof_count,' single points of failure identified') END,
CASE WHEN overall_efficiency<0.8 THEN 'Power efficiency below optimal level' END, CASE WHEN hot_spots>0 THEN concat(hot_spots,' thermal hot spots detected') END) AS key_findings,
concat_ws('; ', CASE WHEN overloaded_circuits>0 THEN 'Address circuit overloading immediately' END, CASE WHEN spof_count>5 THEN 'Implement redundancy for critical components' END,
CASE WHEN high_risk>0 THEN 'Implement thermal management for high-power components' END) AS priority_actions FROM h""", ("components", "edges", "circuits", "part_of"))
def _(t):
    tenants = t.components.select("vehicle_signature").distinct()
    eff = op.efficiency_score(graph.path_efficiency(t.edges, t.components), tenants)
    df = op.overall_health(op.circuit_analytics(t.circuits, t.part_of, t.components),
                           op.fault_tolerance(t.components, t.edges), eff, op.hot_spots(t.components))
    return joined(r6(df, "health_score", "reliability_score", "overall_efficiency"), "key_findings", "priority_actions")


@query("a23_vehicle_stats", f"""SELECT v.signature AS vehicle_signature, make, model, year, coalesce(a.n,0) AS component_count, coalesce(p,0) AS positioned_components, td AS type_distribution,
coalesce(b.n,0) AS circuit_count, coalesce(z.n,0) AS zone_count, coalesce(e.n,0) AS connection_count, round(coalesce(p/a.n*100,0),6) AS position_completeness_percent
FROM vehicles v LEFT JOIN (SELECT vehicle_signature vs, count(*) n, count(*) FILTER ({POS}) p FROM components GROUP BY 1) a ON a.vs=v.signature
LEFT JOIN (SELECT vs, string_agg(concat(type,':',n),'|' ORDER BY concat(type,':',n)) td FROM (SELECT vehicle_signature vs, type, count(*) n FROM components GROUP BY 1,2) q GROUP BY 1) d ON d.vs=v.signature
LEFT JOIN (SELECT vehicle_signature vs, count(*) n FROM circuits GROUP BY 1) b ON b.vs=v.signature LEFT JOIN (SELECT vehicle_signature vs, count(*) n FROM zones GROUP BY 1) z ON z.vs=v.signature
LEFT JOIN (SELECT vehicle_signature vs, count(*) n FROM connects_to GROUP BY 1) e ON e.vs=v.signature""", ("vehicles", "components", "circuits", "zones", "connects_to"))
def _(t):
    return r6(op.vehicle_stats(t.vehicles, t.components, t.circuits, t.zones, t.edges), "position_completeness_percent")


@query("a24_compare_vehicles", """WITH s AS (SELECT vehicle_signature v, count(*) n, list_sort(list(DISTINCT type)) ty FROM components GROUP BY 1),
pairs AS (SELECT x.signature a, y.signature b FROM vehicles x JOIN vehicles y ON y.year=x.year+1)
SELECT a, b, s1.n AS components_a, s2.n AS components_b, len(list_intersect(s1.ty, s2.ty)) AS common_types, array_to_string(list_filter(s1.ty, lambda t: NOT list_contains(s2.ty, t)), ', ') AS unique_a,
array_to_string(list_filter(s2.ty, lambda t: NOT list_contains(s1.ty, t)), ', ') AS unique_b, len(list_intersect(s1.ty, s2.ty))>5 AS similar FROM pairs JOIN s s1 ON s1.v=a JOIN s s2 ON s2.v=b""", ("vehicles", "components"))
def _(t):
    x = t.vehicles.select(F.col("signature").alias("a"), (F.col("year") + 1).alias("year"))
    pairs = x.join(t.vehicles.select(F.col("signature").alias("b"), "year"), "year").select("a", "b")
    return op.compare_vehicles(t.components, pairs)


@query("a26_bounds", f"""SELECT vehicle_signature, min(x)-100 AS min_x, max(x)+100 AS max_x, min(y)-100 AS min_y, max(y)+100 AS max_y, min(z)-100 AS min_z, max(z)+100 AS max_z,
(max(x)-min(x)+200)*(max(y)-min(y)+200)*(max(z)-min(z)+200) AS volume, (min(x)+max(x))/2 AS centre_x, (min(y)+max(y))/2 AS centre_y, (min(z)+max(z))/2 AS centre_z FROM components WHERE {POS} GROUP BY 1""", "components")
def _(t):
    return op.bounds(t.components)


@query("a27_position_distribution", f"""SELECT vehicle_signature, 'zone' AS by, coalesce(zone,'unknown') AS value, count(*) AS n, count(*) FILTER ({POS}) AS positioned, round(count(*) FILTER ({POS})/count(*)*100,6) AS position_coverage FROM components GROUP BY 1,3
UNION ALL SELECT vehicle_signature, 'type', type, count(*), count(*) FILTER ({POS}), round(count(*) FILTER ({POS})/count(*)*100,6) FROM components GROUP BY 1,3""", "components")
def _(t):
    return r6(op.position_distribution(t.components), "position_coverage")


VOL = "CASE type WHEN 'battery' THEN 5000000 WHEN 'alternator' THEN 2000000 WHEN 'ecu' THEN 500000 WHEN 'relay' THEN 50000 WHEN 'fuse' THEN 10000 WHEN 'sensor' THEN 25000 WHEN 'connector' THEN 15000 ELSE 100000 END::DOUBLE"


@query("a28_space_utilisation", f"""SELECT vehicle_signature, sum({VOL}) AS component_volume_mm3, (max(x)-min(x)+200)*(max(y)-min(y)+200)*(max(z)-min(z)+200) AS vehicle_volume_mm3,
round(sum({VOL})/((max(x)-min(x)+200)*(max(y)-min(y)+200)*(max(z)-min(z)+200))*100,6) AS utilization_percentage,
(max(x)-min(x)+200)*(max(y)-min(y)+200)*(max(z)-min(z)+200)-sum({VOL}) AS available_space_mm3 FROM components GROUP BY 1""", "components")
def _(t):
    return r6(op.space_utilisation(t.components), "utilization_percentage")


@query("a29_accessibility", """SELECT vehicle_signature, count(*) AS total_analyzed, count(*) FILTER (accessibility='easy') AS easy, count(*) FILTER (accessibility='moderate') AS moderate, count(*) FILTER (accessibility='difficult') AS difficult,
count(*) FILTER (service_access_required AND accessibility='difficult') AS service_access_issues FROM located_in GROUP BY 1""", "located_in")
def _(t):
    return op.accessibility(t.located_in)


@query("a29_service_issues", "SELECT src AS component_id, vehicle_signature, 'requires_service_but_difficult_access' AS issue FROM located_in WHERE service_access_required AND accessibility='difficult'", "located_in")
def _(t):
    return op.service_issues(t.located_in)


@query("a30_dashboard", """SELECT c_custkey AS user_id, c_mktsegment AS tier, coalesce(j.n,0) AS total_models_generated, coalesce(j.c,0) AS completed_models, coalesce(j.f,0) AS failed_models, coalesce(j.r,0) AS models_last_30_days, coalesce(f.n,0) AS favorite_models_count
FROM customer LEFT JOIN (SELECT user_id, count(*) n, count(*) FILTER (status='completed') c, count(*) FILTER (status='failed') f, count(*) FILTER (created_at > TIMESTAMP '1997-01-01' - INTERVAL 30 DAY) r FROM jobs GROUP BY 1) j ON j.user_id=c_custkey
LEFT JOIN (SELECT user_id, count(*) n FROM events WHERE event_type='purchase' GROUP BY 1) f ON f.user_id=c_custkey""", "jobs")
def _(t):
    profiles = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("tier"))
    return op.dashboard(profiles, t.jobs, t.events.filter("event_type = 'purchase'"), F.lit("1997-01-01").cast("timestamp_ntz"))


@query("a31_ops_stats", "SELECT project_id, status, count(*) AS n, round(sum(size_bytes),2) AS size_bytes, count(DISTINCT user_id) AS users FROM jobs GROUP BY ROLLUP(project_id, status)", "jobs")
def _(t):
    return op.ops_stats(t.jobs).withColumn("size_bytes", F.round("size_bytes", 2))


@query("a32_engine_report", """WITH r AS (SELECT doc_id, engine, count(*) AS elements, sum(confidence)/10 AS seconds, avg(confidence)<0.6 AS failed FROM text_spans GROUP BY 1,2),
b AS (SELECT engine, count(*) AS pages, sum(elements)::BIGINT AS total_elements, sum(seconds) AS total_time, count(*) FILTER (failed) AS errors FROM r GROUP BY 1)
SELECT engine, pages, total_elements, round(total_time,4) AS total_time, errors, round(total_time/pages,6) AS avg_time_per_page, round(total_elements/pages,6) AS avg_elements_per_page,
round(total_time/min(total_time) OVER (),6) AS slower_than_best, (max(total_elements) OVER ()-total_elements)::BIGINT AS elements_behind_best FROM b""", "text_spans")
def _(t):
    runs = t.text_spans.groupBy("doc_id", "engine").agg(F.count(F.lit(1)).alias("elements"), (F.sum("confidence") / 10).alias("seconds"), (F.avg("confidence") < 0.6).alias("failed"))
    return r6(op.engine_report(runs), "avg_time_per_page", "avg_elements_per_page", "slower_than_best").withColumn("total_time", F.round("total_time", 4))


@query("a34_collection_stats", "SELECT lang, source, count(*) AS points FROM documents GROUP BY ROLLUP(lang, source)")
def _(t):
    return op.collection_stats(t.documents, ["lang", "source"])


@query("a35_ocr_quality", """SELECT doc_id, round(avg(confidence),9) AS avg_confidence, round(greatest(0,(1-avg(confidence))*0.3),9) AS cer, round(greatest(0,(1-avg(confidence))*0.4),9) AS wer FROM text_spans GROUP BY 1""", "text_spans")
def _(t):
    return op.ocr_quality(t.text_spans).withColumns({c: F.round(c, 9) for c in ("avg_confidence", "cer", "wer")})


@query("a36_op_stats", """WITH c AS (SELECT event_type AS operation, value/10 AS duration, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT operation, count(*) AS total_calls, round(sum(duration),4) AS total_duration, round(avg(duration),6) AS average_duration, count(*) FILTER (duration>1.0) AS slow_calls, count(*) FILTER (rn<=100) AS recent_calls,
round(avg(duration) FILTER (rn<=100),6) AS recent_avg_duration, min(duration) FILTER (rn<=100) AS min_duration, max(duration) FILTER (rn<=100) AS max_duration FROM c GROUP BY 1""")
def _(t):
    calls = t.events.select(F.col("event_type").alias("operation"), "ts", F.col("event_id").alias("call_id"), (F.col("value") / 10).alias("duration"))
    return r6(op.op_stats(calls), "average_duration", "recent_avg_duration").withColumn("total_duration", F.round("total_duration", 4))


@query("a37_latency_stats", """WITH c AS (SELECT event_type, value AS latency, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn, props LIKE '%9%' AS failed FROM events)
SELECT event_type, count(*) AS total_searches, count(*) FILTER (failed) AS total_errors, round(avg(latency) FILTER (rn<=1000),6) AS latency_mean, round(quantile_cont(latency,0.95) FILTER (rn<=1000),6) AS latency_p95,
round(quantile_cont(latency,0.99) FILTER (rn<=1000),6) AS latency_p99, round(count(*) FILTER (failed)/count(*),6) AS error_rate FROM c GROUP BY 1""")
def _(t):
    s = t.events.select("event_type", "ts", F.col("event_id").alias("search_id"), F.col("value").alias("latency"), F.col("props").contains("9").alias("failed"))
    return r6(op.latency_stats(s, "event_type"), "latency_mean", "latency_p95", "latency_p99", "error_rate")


@query("a39_power_budget", f"""WITH {SPOF}, b AS (SELECT vehicle_signature, sum(CASE WHEN type IN ('battery','alternator','power_supply') THEN coalesce(voltage_rating*current_rating,0) ELSE 0 END) AS av,
sum(CASE WHEN type NOT IN ('battery','alternator','power_supply') THEN coalesce(voltage_rating*current_rating,0) ELSE 0 END) AS co,
max(CASE WHEN type NOT IN ('battery','alternator','power_supply') THEN coalesce(voltage_rating*current_rating,0) END) AS pk, avg(CASE WHEN type NOT IN ('battery','alternator','power_supply') THEN voltage_rating*current_rating END) AS ap FROM components GROUP BY 1)
SELECT vehicle_signature, round(av,4) AS total_available_power, round(co,4) AS total_consumed_power, round(pk,6) AS peak_power, round(ap,6) AS average_power, coalesce(n,0) AS critical_loads,
round(av-co,4) AS power_margin, round(CASE WHEN av>0 THEN least(1.0,co/av) ELSE 0 END,6) AS power_efficiency FROM b LEFT JOIN (SELECT vehicle_signature, count(*) n FROM spof WHERE type NOT IN ('battery','alternator','power_supply') GROUP BY 1) c USING (vehicle_signature)""", ("components", "powered_by"))
def _(t):
    df = r6(op.power_budget(t.components, t.powered_by), "peak_power", "average_power", "power_efficiency")
    return df.withColumns({c: F.round(c, 4) for c in ("total_available_power", "total_consumed_power", "power_margin")})


@query("a40_zone_utilisation", f"""SELECT z.id AS zone_id, vehicle_signature, coalesce(n,0) AS component_count, coalesce(vol,0) AS volume, coalesce(occ,0) AS occupied_volume, round(CASE WHEN vol>0 THEN occ/vol*100 ELSE 0 END,6) AS utilization_percentage,
access_level AS accessibility, CASE WHEN access_level='difficult' AND coalesce(n,0)>20 THEN 'high' WHEN access_level='difficult' OR coalesce(n,0)>20 THEN 'medium' ELSE 'low' END AS maintenance_complexity
FROM zones z LEFT JOIN (SELECT zone, count(*) n, sum({VOL}) occ, (max(x)-min(x))*(max(y)-min(y))*(max(z)-min(z)) vol FROM components WHERE zone IS NOT NULL GROUP BY 1) c ON c.zone=z.id""", ("components", "zones"))
def _(t):
    return r6(op.zone_utilisation(t.components, t.zones), "utilization_percentage")


@query("a41_harnesses", """SELECT e.vehicle_signature, concat(least(coalesce(a.zone,'unassigned'),coalesce(b.zone,'unassigned')),'-',greatest(coalesce(a.zone,'unassigned'),coalesce(b.zone,'unassigned'))) AS harness, count(*) AS wires,
round(sum(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2)),4) AS total_length, round(max(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2)),6) AS longest
FROM connects_to e JOIN components a ON a.id=e.src AND a.x IS NOT NULL JOIN components b ON b.id=e.dst AND b.x IS NOT NULL GROUP BY 1,2""", ("connects_to", "components"))
def _(t):
    return r6(op.harnesses(t.components, t.edges), "longest").withColumn("total_length", F.round("total_length", 4))
