"""Queries for filters and projections."""

from pyspark.sql import functions as F

from wirelake.operators import filters as op
from wirelake.plans.registry import query

POS = "x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"


@query("p01_filter_components", f"""SELECT id, type, name, zone, voltage_rating, current_rating FROM components
WHERE type IN ('fuse','relay','battery') AND voltage_rating >= 10 AND voltage_rating <= 40
AND current_rating >= 9 AND {POS}""", "components")
def _(t):
    c = op.ComponentCriteria(types=["fuse", "relay", "battery"], has_position=True,
                             voltage=(10, 40), current=(9, None))
    return op.filter_components(t.components, c).select(
        "id", "type", "name", "zone", "voltage_rating", "current_rating")


@query("p02_filter_circuits", """SELECT id, circuit_type, voltage, max_current FROM circuits
WHERE circuit_type IN ('power','ground','lighting') AND max_current >= 100 AND max_current <= 1800
AND protection = 'fuse' AND safety_critical = false""", "circuits")
def _(t):
    c = op.CircuitCriteria(types=["power", "ground", "lighting"], current=(100, 1800),
                           safety_critical=False, protection="fuse")
    return op.filter_circuits(t.circuits, c).select("id", "circuit_type", "voltage", "max_current")


@query("p03_count_by_criteria", """SELECT vehicle_signature, 'components' AS kind, count(*) AS n FROM components
WHERE voltage_rating >= 20 GROUP BY vehicle_signature
UNION ALL SELECT vehicle_signature, 'circuits', count(*) FROM circuits WHERE voltage >= 20 GROUP BY vehicle_signature""",
       ("components", "circuits"))
def _(t):
    a = op.count_components(t.components, op.ComponentCriteria(voltage=(20, None)))
    b = op.count_circuits(t.circuits, op.CircuitCriteria(voltage=(20, None)))
    return a.withColumn("kind", F.lit("components")).unionByName(
        b.withColumn("kind", F.lit("circuits")))


@query("p04_search_name", "SELECT id, name FROM components WHERE regexp_matches(name, '(?i)PART.*7')", "components")
def _(t):
    return op.search_name(t.components, "PART.*7").select("id", "name")


@query("p05_filter_rating", """SELECT id, voltage_rating, current_rating FROM components
WHERE voltage_rating >= 5 AND voltage_rating <= 45 AND current_rating >= 9.5""", "components")
def _(t):
    return op.filter_rating(t.components, 5, 45, 9.5).select("id", "voltage_rating", "current_rating")


@query("p06_high_power", """SELECT id, round(voltage_rating * current_rating, 6) AS power_consumption FROM components
WHERE voltage_rating * current_rating > 200""", "components")
def _(t):
    return op.high_power(t.components, 200.0).select(
        "id", F.round("power_consumption", 6).alias("power_consumption"))


@query("p07_without_position", "SELECT id, zone, type FROM components WHERE x IS NULL OR y IS NULL OR z IS NULL", "components")
def _(t):
    return op.without_position(t.components).select("id", "zone", "type")


@query("p08_with_spatial", f"""SELECT c.id, c.vehicle_signature, c.type, c.name, c.x, c.y, c.z, l.dst AS zone_id, z.name AS zone_name
FROM components c LEFT JOIN located_in l ON l.src = c.id LEFT JOIN zones z ON z.id = l.dst
WHERE c.x IS NOT NULL AND c.y IS NOT NULL AND c.z IS NOT NULL""", ("components", "located_in", "zones"))
def _(t):
    return op.with_spatial(t.components, t.located_in, t.zones)


@query("p09_unprotected", "SELECT id, protection FROM circuits WHERE protection IS NULL OR protection = 'none'", "circuits")
def _(t):
    return op.unprotected(t.circuits).select("id", "protection")


@query("p10_safety_critical", "SELECT id, circuit_type FROM circuits WHERE safety_critical", "circuits")
def _(t):
    return op.safety_critical(t.circuits).select("id", "circuit_type")


@query("p11_apply_filters", """SELECT id, type, manufacturer FROM components WHERE type IN ('ecu','sensor')
AND manufacturer <> 'Brand#11' AND voltage_rating > 3 AND voltage_rating <= 44 AND contains(name, '1')""", "components")
def _(t):
    fs = [op.Filter("type", "in", ["ecu", "sensor"]), op.Filter("manufacturer", "ne", "Brand#11"),
          op.Filter("voltage_rating", "gt", 3), op.Filter("voltage_rating", "lte", 44),
          op.Filter("name", "contains", "1")]
    return op.apply_filters(t.components, fs).select("id", "type", "manufacturer")


@query("p12_filter_vectors", "SELECT vec_id, label FROM embeddings WHERE label >= 2 AND label <> 5 AND label <> 7")
def _(t):
    return op.filter_vectors(
        t.embeddings, must=[op.Filter("label", "gte", 2)],
        must_not=[op.Filter("label", "in", [5, 7])]).select("vec_id", "label")


@query("p13_select_subgraph", """SELECT c.id, c.vehicle_signature, c.type, e.dst AS target_id, e.rel_type
FROM components c LEFT JOIN edges e ON e.src = c.id
WHERE c.type IN ('battery','ecu') AND c.id IN (SELECT src FROM part_of)""", ("components", "edges", "part_of"))
def _(t):
    return op.select_subgraph(t.components, t.edges, types=["battery", "ecu"], members=t.part_of)


@query("p14_normalise_component", """SELECT id, type, name, coalesce(x, 0.0::DOUBLE) AS x, coalesce(y, 0.0::DOUBLE) AS y, coalesce(z, 0.0::DOUBLE) AS z,
0.05::DOUBLE AS width, 0.05::DOUBLE AS height, 0.025::DOUBLE AS depth, current_rating AS current, voltage_rating AS voltage,
zone, part_number, vehicle_signature FROM components""", "components")
def _(t):
    return op.normalise_component(t.components)


@query("p15_normalise_edges", """SELECT vehicle_signature, src AS from_component_id, dst AS to_component_id,
CASE WHEN rel_type IN ('MOUNTED_TO','ATTACHED_TO') THEN 'mechanical' WHEN rel_type IN ('COMMUNICATES_WITH','SENDS_DATA') THEN 'data'
ELSE 'electrical' END AS type FROM edges""", "edges")
def _(t):
    return op.normalise_edges(t.edges)


SEGMENT_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, x1, y1, x2, y2 FROM (
  SELECT *, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS len, fmod(abs(atan2(y2-y1, x2-x1)), pi()/2) AS a FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax * 1000 AS x1, l_discount * 1000 AS y1,
         l_quantity * 2 AS x2, l_linenumber * 30.0::DOUBLE AS y2 FROM lineitem) s) g
WHERE len >= 20 AND (a < 0.2 OR abs(a - pi()/4) < 0.2 OR abs(a - pi()/2) < 0.2 OR len > 50)"""


@query("p16_filter_segments", SEGMENT_SQL)
def _(t):
    seg = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        (F.col("l_tax") * 1000).alias("x1"), (F.col("l_discount") * 1000).alias("y1"),
        (F.col("l_quantity") * 2).alias("x2"), (F.col("l_linenumber") * F.lit(30.0)).alias("y2"))
    return op.filter_segments(seg)


@query("p17_drop_short", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 50")
def _(t):
    return op.drop_short(t.documents, "text", 50).select("doc_id")


@query("p18_sanitise", r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(
replace(replace(html, chr(13), ''), chr(10), ' '), '<script[^>]*>.*?</script>', '', 'gis'), '<[^>]+>', '', 'g'))) AS clean_md5 FROM pages""")
def _(t):
    return op.sanitise(t.pages, ["html"]).select("page_id", F.md5("html").alias("clean_md5"))


@query("p19_circuit_subgraph", """SELECT a.dst AS circuit_id, e.src, e.dst, e.rel_type FROM edges e
JOIN part_of a ON a.src = e.src JOIN part_of b ON b.src = e.dst AND b.dst = a.dst""", ("edges", "part_of"))
def _(t):
    return op.circuit_subgraph(t.part_of, t.edges)


@query("p20_tenant_views", """SELECT vehicle_signature, type, count(*) AS n FROM components
WHERE vehicle_signature IN ('V1','V3') GROUP BY vehicle_signature, type""", "components")
def _(t):
    op.tenant_views(t.spark, {"tenant_components": t.components}, ["V1", "V3"])
    return t.spark.sql(
        "SELECT vehicle_signature, type, count(*) AS n FROM tenant_components GROUP BY 1, 2")
