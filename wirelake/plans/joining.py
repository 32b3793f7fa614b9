"""Queries for joins (J ids) and set operations (U ids)."""

from pyspark.sql import functions as F

from wirelake.operators import joins as op
from wirelake.operators import setops
from wirelake.plans.registry import query

BOTH = """SELECT e.src AS id, '{0}' AS direction, e.dst AS other_id, c.type AS other_type FROM {2} e JOIN components c ON c.id=e.dst
UNION ALL SELECT e.dst, '{1}', e.src, c.type FROM {2} e JOIN components c ON c.id=e.src"""


@query("j01_connections", BOTH.format("outgoing", "incoming", "connects_to"), ("components", "connects_to"))
def _(t):
    return op.connections(t.components, t.connects_to)


@query("j02_power_relations", BOTH.format("power_source", "load", "powered_by"), ("components", "powered_by"))
def _(t):
    return op.power_relations(t.components, t.powered_by)


@query("j03_control_relations", BOTH.format("controls", "controlled_by", "controls"), ("components", "controls"))
def _(t):
    return op.control_relations(t.components, t.controls)


@query("j04_locations", """SELECT l.src AS id, l.dst AS zone_id, l.accessibility, c.vehicle_signature, c.type, z.name AS zone_name, z.access_level
FROM located_in l JOIN components c ON c.id=l.src JOIN zones z ON z.id=l.dst""", ("located_in", "components", "zones"))
def _(t):
    return op.locations(t.components, t.located_in, t.zones)


@query("j05_memberships", """SELECT p.src AS component_id, p.dst AS circuit_id, p.role, p.is_critical, c.type AS component_type, k.circuit_type, k.name AS circuit_name
FROM part_of p JOIN components c ON c.id=p.src JOIN circuits k ON k.id=p.dst""", ("part_of", "components", "circuits"))
def _(t):
    return op.memberships(t.components, t.part_of, t.circuits)


@query("j06_relationship_counts", """SELECT id, rel_type, direction, count(*) AS n FROM (SELECT src AS id, rel_type, 'outgoing' AS direction FROM edges
UNION ALL SELECT dst, rel_type, 'incoming' FROM edges) q WHERE id IN (SELECT id FROM components) GROUP BY 1,2,3""", ("edges", "components"))
def _(t):
    return op.relationship_counts(t.components, t.edges)


@query("j06_all_relationships", """SELECT src AS id, rel_type, 'outgoing' AS direction, dst AS other_id FROM edges UNION ALL SELECT dst, rel_type, 'incoming', src FROM edges""", ("edges", "components"))
def _(t):
    return op.all_relationships(t.components, t.edges)


@query("j07_orphans", """SELECT id, type FROM components WHERE id NOT IN (SELECT src FROM connects_to UNION SELECT dst FROM connects_to)""", ("components", "connects_to"))
def _(t):
    return op.orphans(t.components, t.edges, ["CONNECTS_TO"]).select("id", "type")


@query("j08_net_connectivity", """SELECT DISTINCT c.id AS component_id, c.type, p.pin, n.net FROM components c LEFT JOIN (SELECT DISTINCT concat('P', l_partkey) AS component_id, l_linenumber AS pin FROM lineitem) p ON p.component_id=c.id
LEFT JOIN (SELECT concat('N', l_suppkey) AS net, concat('P', l_partkey) AS component_id, l_linenumber AS pin FROM lineitem WHERE l_returnflag='R') n ON n.component_id=p.component_id AND n.pin=p.pin""", "components")
def _(t):
    line = t.lineitem.select(F.concat(F.lit("P"), "l_partkey").alias("component_id"), F.col("l_linenumber").alias("pin"), F.concat(F.lit("N"), "l_suppkey").alias("net"), "l_returnflag")
    return op.net_connectivity(t.components, line.select("component_id", "pin").distinct(), line.filter("l_returnflag = 'R'").drop("l_returnflag"))


TOPO = """topo AS (SELECT a.dst AS circuit_id, e.src AS from_id, e.dst AS to_id, e.rel_type FROM edges e JOIN part_of a ON a.src=e.src JOIN part_of b ON b.src=e.dst AND b.dst=a.dst WHERE e.rel_type<>'POWERED_BY'
UNION SELECT a.dst, e.dst, e.src, e.rel_type FROM edges e JOIN part_of a ON a.src=e.src WHERE e.rel_type='POWERED_BY')"""


@query("j09_circuit_topology", f"WITH {TOPO} SELECT * FROM topo", ("edges", "part_of"))
def _(t):
    return op.circuit_topology(t.part_of, t.edges)


@query("j09_topology_counts", f"""WITH {TOPO} SELECT m.circuit_id, m.n AS component_count, coalesce(c,0) AS connection_count, coalesce(p,0) AS power_count, coalesce(k,0) AS control_count
FROM (SELECT dst AS circuit_id, count(DISTINCT src) n FROM part_of GROUP BY 1) m LEFT JOIN (SELECT circuit_id, count(*) FILTER (rel_type='CONNECTS_TO') c, count(*) FILTER (rel_type='POWERED_BY') p, count(*) FILTER (rel_type='CONTROLS') k FROM topo GROUP BY 1) t USING (circuit_id)""", ("edges", "part_of"))
def _(t):
    return op.topology_counts(t.part_of, t.edges)


SECTION = "(SELECT d.doc_id AS page, max_by(s.name, s.start_page) AS section, CAST(max(s.start_page) AS INTEGER) AS start_page FROM documents d JOIN sections s ON d.doc_id BETWEEN s.start_page AND s.end_page GROUP BY 1)"


@query("j10_section_of_page", f"SELECT * FROM {SECTION} q", "sections")
def _(t):
    return op.section_of_page(t.documents.select(F.col("doc_id").alias("page")), t.sections)


KNOW = """know AS (SELECT doc_id AS knowledge_id, CASE lang WHEN 'en' THEN 'fuse' WHEN 'fr' THEN 'relay' WHEN 'de' THEN 'sensor' ELSE 'ecu' END AS applies_to_type, concat('S', doc_id // 40) AS section FROM documents),
comp AS (SELECT id, type, CAST(substr(id, 2) AS BIGINT) AS page, 'S' || substr(zone, 2) AS section FROM components)"""


def _knowledge(t):
    kind = F.when(F.col("lang") == "en", "fuse").when(F.col("lang") == "fr", "relay").when(F.col("lang") == "de", "sensor").otherwise("ecu")
    know = t.documents.select(F.col("doc_id").alias("knowledge_id"), kind.alias("applies_to_type"), F.concat(F.lit("S"), F.floor(F.col("doc_id") / 40)).alias("section"))
    comp = t.components.select("id", "type", F.substring("id", 2, 20).cast("bigint").alias("page"), F.concat(F.lit("S"), F.substring("zone", 2, 20)).alias("section"))
    return comp, know


@query("j11_knowledge_for", f"""WITH {KNOW} SELECT DISTINCT c.type, c.section, k.knowledge_id FROM (SELECT DISTINCT type, section FROM comp) c JOIN know k ON k.applies_to_type=c.type OR k.section=c.section""", "components")
def _(t):
    comp, know = _knowledge(t)
    return op.knowledge_for(comp, know)


@query("j12_placement_context", f"""WITH {KNOW}, sec AS (SELECT c.id, max_by(s.name, s.start_page) AS section FROM comp c JOIN sections s ON c.page BETWEEN s.start_page AND s.end_page GROUP BY 1)
SELECT c.id, c.type, c.page, sec.section, coalesce(k1.n,0) AS type_knowledge, coalesce(k2.n,0) AS section_knowledge, coalesce(w.n,0) AS connections FROM comp c LEFT JOIN sec ON sec.id=c.id
LEFT JOIN (SELECT applies_to_type, count(*) n FROM know GROUP BY 1) k1 ON k1.applies_to_type=c.type LEFT JOIN (SELECT section, count(*) n FROM know GROUP BY 1) k2 ON k2.section=sec.section
LEFT JOIN (SELECT id, count(*) n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) q GROUP BY 1) w ON w.id=c.id""", ("components", "sections", "edges"))
def _(t):
    comp, know = _knowledge(t)
    return op.placement_context(comp.drop("section"), t.sections, know, t.edges)


@query("j13_lookup_codes", """SELECT c.id, c.zone, z.name AS meaning, z.name IS NOT NULL AS is_valid FROM components c LEFT JOIN zones z ON z.id=c.zone AND z.access_level<>'difficult'""", ("components", "zones"))
def _(t):
    meta = t.zones.filter("access_level <> 'difficult'").select(F.lit("zone").alias("type"), F.col("id").alias("code"), F.col("name").alias("meaning"))
    return op.lookup_codes(t.components.select("id", "zone"), meta, "zone", "zone")


@query("j14_specific_or_generic", """WITH dim AS (SELECT CASE WHEN vehicle_signature IN ('V1','V3') THEN vehicle_signature ELSE 'generic' END AS vehicle, id AS panel FROM circuits)
SELECT v.signature AS vehicle, d.panel FROM vehicles v JOIN dim d ON d.vehicle=v.signature UNION ALL SELECT v.signature, d.panel FROM vehicles v JOIN dim d ON d.vehicle='generic' WHERE v.signature NOT IN (SELECT vehicle FROM dim)""", ("vehicles", "circuits"))
def _(t):
    own = F.col("vehicle_signature").isin("V1", "V3")
    dim = t.circuits.select(F.when(own, F.col("vehicle_signature")).otherwise("generic").alias("vehicle"), F.col("id").alias("panel"))
    return op.specific_or_generic(t.vehicles.select(F.col("signature").alias("vehicle")), dim)


@query("j16_power_bottlenecks", """SELECT s.id AS component_id, s.type AS source_type, s.current_rating AS rating, l.id AS heavy_load FROM powered_by p JOIN components s ON s.id=p.dst JOIN components l ON l.id=p.src
WHERE l.current_rating > s.current_rating*0.8::DOUBLE""", ("powered_by", "components"))
def _(t):
    return op.power_bottlenecks(t.components, t.powered_by)


@query("j17_existing_conflicts", "SELECT id, name FROM components WHERE type='fuse'", "components")
def _(t):
    return op.existing_conflicts(t.components.select("id", "vehicle_signature", "name"), t.components.filter("type = 'fuse'"))\
        .select("id", "name")


@query("j18_dangling_edges", """SELECT src, dst, rel_type, vehicle_signature, CASE WHEN a.id IS NOT NULL THEN 'dst' WHEN b.id IS NOT NULL THEN 'src' ELSE 'both' END AS missing FROM edges e
LEFT JOIN (SELECT id FROM components WHERE zone IS NOT NULL) a ON a.id=e.src LEFT JOIN (SELECT id FROM components WHERE zone IS NOT NULL) b ON b.id=e.dst WHERE a.id IS NULL OR b.id IS NULL""", ("edges", "components"))
def _(t):
    return op.dangling_edges(t.edges, t.components.filter("zone IS NOT NULL"))


@query("j19_match_vehicles", """WITH a AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey % 6 = 5 THEN NULL ELSE n_name END AS make, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('M', s_suppkey % 4) END AS model, 1990+s_suppkey % 20 AS year_start, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 1994+s_suppkey % 20 END AS year_end FROM supplier JOIN nation ON n_nationkey=s_nationkey),
b AS (SELECT n_nationkey AS id, CASE WHEN n_regionkey=0 THEN NULL ELSE lower(n_name) END AS make, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE concat('m', n_nationkey % 4) END AS model, 1992+n_nationkey AS year_start, 1995+n_nationkey AS year_end FROM nation)
SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON (a.make IS NULL OR b.make IS NULL OR lower(a.make)=lower(b.make)) AND (a.model IS NULL OR b.model IS NULL OR lower(a.model)=lower(b.model)) AND coalesce(a.year_start<=b.year_end, true) AND coalesce(b.year_start<=a.year_end, true)""")
def _(t):
    a = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).selectExpr(
        "s_suppkey AS id", "CASE WHEN s_nationkey % 6 = 5 THEN NULL ELSE n_name END AS make", "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('M', s_suppkey % 4) END AS model",
        "1990 + s_suppkey % 20 AS year_start", "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 1994 + s_suppkey % 20 END AS year_end")
    b = t.nation.selectExpr("n_nationkey AS id", "CASE WHEN n_regionkey = 0 THEN NULL ELSE lower(n_name) END AS make", "CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE concat('m', n_nationkey % 4) END AS model",
                            "1992 + n_nationkey AS year_start", "1995 + n_nationkey AS year_end")
    return op.match_vehicles(a, b)


@query("j24_lookup_ids", "SELECT id, type FROM components WHERE id IN (SELECT src FROM controls)", ("components", "controls"))
def _(t):
    return op.lookup_ids(t.components, t.controls.select(F.col("src").alias("id"))).select("id", "type")


@query("j25_compare_sources", """SELECT coalesce(a.type, b.type) AS type, count(a.id) AS n_a, count(b.id) AS n_b, count(CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 1 END) AS n_both,
count(a.zone) AS a_zone, count(b.zone) AS b_zone, count(a.voltage_rating) AS a_voltage_rating, count(b.voltage_rating) AS b_voltage_rating
FROM (SELECT * FROM components WHERE current_rating IS NOT NULL) a FULL JOIN (SELECT * FROM components WHERE x IS NOT NULL) b ON a.id=b.id GROUP BY 1""", "components")
def _(t):
    return op.compare_sources(t.components.filter("current_rating IS NOT NULL"), t.components.filter("x IS NOT NULL"), ["zone", "voltage_rating"], "type")


@query("u01_union_zones", "SELECT id, coalesce(zone, 'unassigned') AS zone FROM components", "components")
def _(t):
    c = t.components.select("id", "zone")
    return setops.union_zones(c.filter("zone IS NOT NULL"), c.filter("zone IS NULL"))


@query("u02_union_directions", """SELECT a.id, e.dst AS other, 'outgoing' AS direction FROM components a JOIN controls e ON e.src=a.id UNION ALL SELECT a.id, e.src, 'incoming' FROM components a JOIN controls e ON e.dst=a.id""", ("components", "controls"))
def _(t):
    out = t.components.select("id").join(t.controls.select(F.col("src").alias("id"), F.col("dst").alias("other")), "id", "left")
    into = t.components.select("id").join(t.controls.select(F.col("dst").alias("id"), F.col("src").alias("other")), "id", "left")
    return setops.union_directions(out, into, "other")


@query("u03_set_diff", """SELECT 'common' AS mode, manufacturer FROM (SELECT manufacturer FROM components WHERE type='fuse' INTERSECT SELECT manufacturer FROM components WHERE type='ecu') q
UNION ALL SELECT 'only_left', part_number FROM (SELECT part_number FROM components WHERE type='fuse' EXCEPT SELECT part_number FROM components WHERE type='ecu') q
UNION ALL SELECT 'only_left_all', part_number FROM (SELECT part_number FROM components WHERE type='fuse' EXCEPT ALL SELECT part_number FROM components WHERE type='ecu') q""", "components")
def _(t):
    f, e = t.components.filter("type = 'fuse'"), t.components.filter("type = 'ecu'")
    parts = [setops.set_diff(f.select("manufacturer"), e.select("manufacturer"), "common").select(F.lit("common").alias("mode"), "manufacturer")]
    for mode in ("only_left", "only_left_all"):
        parts.append(setops.set_diff(f.select("part_number"), e.select("part_number"), mode).select(F.lit(mode).alias("mode"), F.col("part_number").alias("manufacturer")))
    return setops.union_results(parts)


@query("u04_missing_fields", """SELECT id, concat_ws(',', CASE WHEN voltage_rating IS NULL THEN 'voltage_rating' END, CASE WHEN zone IS NULL THEN 'zone' END, 'serial') AS missing FROM components""", "components")
def _(t):
    return setops.missing_fields(t.components, ["name", "voltage_rating", "zone", "serial"]).withColumn("missing", F.array_join("missing", ","))


@query("u05_merge_netlists", """SELECT l_orderkey AS doc, l_returnflag AS name, count(DISTINCT (l_partkey, l_suppkey)) AS connections, count(DISTINCT l_linenumber) AS pages, min(l_linenumber) AS first_page FROM lineitem GROUP BY 1,2""")
def _(t):
    nets = t.lineitem.selectExpr("l_orderkey AS doc", "l_returnflag AS name", "l_linenumber AS page", "l_partkey AS component_id", "l_suppkey AS pin")
    return setops.merge_netlists(nets, by_name=True)


@query("u06_union_results", "SELECT 'components' AS collection, id FROM components UNION ALL SELECT 'circuits', id FROM circuits UNION ALL SELECT 'zones', id FROM zones", ("components", "circuits", "zones"))
def _(t):
    return setops.union_results([df.select(F.lit(n).alias("collection"), "id") for n, df in (("components", t.components), ("circuits", t.circuits), ("zones", t.zones))])


@query("u07_distinct_first_seen", "SELECT doc_id, word, min(pos) AS first_seen FROM words GROUP BY 1,2", "words")
def _(t):
    return setops.distinct_first_seen(t.words, ["doc_id"], "word", "pos")


@query("u08_best_per_key", """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rn FROM events) q WHERE rn=1""")
def _(t):
    return setops.best_per_key(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], F.col("value"), [F.col("event_id")])


@query("u09_dedup_edges", "SELECT DISTINCT concat('P', l_partkey) AS src, concat('C', l_suppkey) AS dst, l_returnflag AS rel_type FROM lineitem")
def _(t):
    return setops.dedup_edges(t.lineitem.selectExpr("concat('P', l_partkey) AS src", "concat('C', l_suppkey) AS dst", "l_returnflag AS rel_type"))
