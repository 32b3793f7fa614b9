"""Queries for graph work (G ids)."""

from pyspark.sql import functions as F

from wirelake.operators import dependency, graph, quality
from wirelake.operators.joins import all_relationships
from wirelake.plans.registry import query


def pairs(t):
    """Ask for the wiring between every controller and what it controls."""
    return t.controls.select(F.col("src").alias("source"), F.col("dst").alias("target")).filter("source <> target")


WAYS = "ways AS (SELECT src AS a, dst AS b FROM connects_to UNION SELECT dst, src FROM connects_to)"


def wires(t):
    return t.edges.filter("rel_type = 'CONNECTS_TO'").select("src", "dst", "rel_type")


@query("g01_shortest_paths", f"""WITH RECURSIVE {WAYS}, q AS (SELECT DISTINCT src AS s FROM controls), bfs AS (SELECT s, s AS n, 0 AS d FROM q UNION SELECT b.s, w.b, b.d+1 FROM bfs b JOIN ways w ON w.a=b.n WHERE b.d<6)
SELECT c.src AS source, c.dst AS target, CAST(min(d) AS INTEGER) AS path_length, round(min(d)*0.1,6)::DOUBLE AS total_resistance FROM controls c JOIN bfs ON bfs.s=c.src AND bfs.n=c.dst WHERE c.src<>c.dst GROUP BY 1,2""", ("connects_to", "controls"))
def _(t):
    df = graph.path_electrical(graph.shortest_paths(wires(t), pairs(t), 6, with_nodes=False), 10.0)
    return df.select("source", "target", "path_length", F.round("total_resistance", 6).alias("total_resistance"))


@query("g01_path_nodes")
def _(t):
    df = graph.shortest_paths(t.edges.select("src", "dst", "rel_type"), pairs(t), 15)
    return df.select("source", "target", "path_length", F.array_join("path_nodes", ">").alias("path_nodes"), F.array_join("path_relationships", ">").alias("path_relationships"))


@query("g02_k_paths")
def _(t):
    df = graph.k_paths(wires(t), pairs(t), 3, 6)
    return df.select("source", "target", "path_length", "path_index", F.array_join("path_nodes", ">").alias("path_nodes"))


@query("g03_power_closure", """WITH RECURSIVE h AS (SELECT src AS start, dst AS node, 1 AS d FROM powered_by UNION SELECT h.start, p.dst, h.d+1 FROM h JOIN powered_by p ON p.src=h.node WHERE h.d<5) SELECT start, node, CAST(min(d) AS INTEGER) AS depth FROM h GROUP BY 1,2""", "powered_by")
def _(t):
    return graph.bounded_closure(t.powered_by, depth=5)


@query("g05_long_paths")
def _(t):
    sources = t.components.filter("type = 'battery'").select(F.col("id").alias("start"))
    return graph.long_paths(wires(t), sources, 3, 20, 4).withColumn("path_nodes", F.array_join("path_nodes", ">"))


@query("g06_neighbours", """WITH RECURSIVE bw AS (SELECT src AS a, dst AS b, rel_type FROM edges UNION SELECT dst, src, rel_type FROM edges), s AS (SELECT id FROM components WHERE type='battery'), h AS (SELECT id AS start, id AS node, 0 AS d FROM s UNION SELECT h.start, b.b, h.d+1 FROM h JOIN bw b ON b.a=h.node WHERE h.d<2)
SELECT h.start, h.node, CAST(min(h.d) AS INTEGER) AS min_distance, (SELECT string_agg(DISTINCT b.rel_type, ',' ORDER BY b.rel_type) FROM bw b JOIN (SELECT start AS st, node AS nd, min(d) AS md FROM h GROUP BY 1,2) z ON z.nd=b.a WHERE b.b=h.node AND z.st=h.start AND z.md<2) AS types FROM h WHERE h.node<>h.start GROUP BY 1,2""", ("edges", "components"))
def _(t):
    starts = t.components.filter("type = 'battery'").select(F.col("id").alias("start"))
    return graph.neighbours(t.edges, starts, 2).select("start", "node", "min_distance", F.array_join("relationship_types", ",").alias("types"))


@query("g07_connected_components", f"""WITH RECURSIVE {WAYS}, r AS (SELECT id, id AS root FROM components UNION SELECT w.b, r.root FROM r JOIN ways w ON w.a=r.id), c AS (SELECT id, min(root) AS component FROM r GROUP BY 1) SELECT component, count(*) AS size FROM c GROUP BY 1""", ("connects_to", "components"))
def _(t):
    return graph.connected_components(t.components.select("id"), t.connects_to.select("src", "dst")).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query("g08_weighted_paths")
def _(t):
    w = t.lineitem.groupBy("l_partkey").agg(F.avg("l_quantity").alias("w")).select(F.concat(F.lit("P"), "l_partkey").alias("src"), "w")
    edges = t.powered_by.select("src", "dst").join(w, "src")
    return graph.weighted_paths(edges, t.components.select(F.col("id").alias("start")), "w")


@query("g09_expand_tree", """WITH RECURSIVE roots AS (SELECT DISTINCT dst AS id FROM powered_by WHERE dst NOT IN (SELECT src FROM powered_by)), h AS (SELECT id AS root, id AS node, 0 AS d FROM roots UNION SELECT h.root, p.src, h.d+1 FROM h JOIN powered_by p ON p.dst=h.node WHERE h.d<4) SELECT root, node, CAST(min(d) AS INTEGER) AS level FROM h GROUP BY 1,2""", "powered_by")
def _(t):
    roots = t.powered_by.select(F.col("dst").alias("start")).distinct().join(t.powered_by.select(F.col("src").alias("start")), "start", "left_anti")
    return graph.expand_tree(graph.reversed_edges(t.powered_by), roots, 4)


@query("g10_power_context", """WITH RECURSIVE u AS (SELECT src AS id, dst AS node, 1 AS d FROM powered_by UNION SELECT u.id, p.dst, u.d+1 FROM u JOIN powered_by p ON p.src=u.node WHERE u.d<5), w AS (SELECT dst AS id, src AS node, 1 AS d FROM powered_by UNION SELECT w.id, p.src, w.d+1 FROM w JOIN powered_by p ON p.dst=w.node WHERE w.d<2)
SELECT id, 'upstream' AS direction, node, CAST(min(d) AS INTEGER) AS depth FROM u GROUP BY 1,3 UNION ALL SELECT id, 'downstream', node, CAST(min(d) AS INTEGER) FROM w GROUP BY 1,3""", "powered_by")
def _(t):
    return graph.power_context(t.powered_by, t.components.select("id"))


@query("g11_degrees", "SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) q GROUP BY 1", "edges")
def _(t):
    return graph.degrees(t.edges)


@query("g13_topology", "SELECT src AS id, rel_type, 'outgoing' AS direction, dst AS other_id FROM edges WHERE rel_type<>'CONTROLS' UNION ALL SELECT dst, rel_type, 'incoming', src FROM edges WHERE rel_type<>'CONTROLS'", "edges")
def _(t):
    return all_relationships(t.components, t.edges, ["CONNECTS_TO", "POWERED_BY"])


@query("g14_control_chains", """WITH RECURSIVE s AS (SELECT DISTINCT src, dst FROM controls), c AS (SELECT src AS initiator, dst AS node, [src, dst] AS seq, 1 AS n FROM s WHERE src NOT IN (SELECT dst FROM s) UNION ALL SELECT c.initiator, s.dst, list_append(c.seq, s.dst), c.n+1 FROM c JOIN s ON s.src=c.node WHERE NOT list_contains(c.seq, s.dst))
SELECT initiator, node AS final, array_to_string(seq,'>') AS sequence, n::DOUBLE AS response_time, n::INTEGER AS complexity FROM c WHERE node NOT IN (SELECT src FROM s)""", "controls")
def _(t):
    return graph.control_chains(t.controls).withColumn("sequence", F.array_join("sequence", ">"))


@query("g15_hierarchy_depth", """WITH RECURSIVE h AS (SELECT DISTINCT dst AS root, dst AS node, 0 AS d FROM powered_by WHERE dst NOT IN (SELECT src FROM powered_by) UNION SELECT h.root, p.src, h.d+1 FROM h JOIN powered_by p ON p.dst=h.node) SELECT root, CAST(max(d) AS INTEGER) AS depth, count(DISTINCT node)-1 AS descendants FROM h GROUP BY 1""", "powered_by")
def _(t):
    return graph.hierarchy_depth(t.powered_by)


@query("g16_unpowered", """SELECT id, 'unpowered' AS issue FROM components WHERE type NOT IN ('battery','alternator','power_supply','ground') AND id NOT IN (SELECT src FROM powered_by) UNION ALL SELECT id, 'orphaned_connector' FROM components WHERE type='connector' AND id NOT IN (SELECT src FROM connects_to UNION SELECT dst FROM connects_to)""", ("components", "powered_by", "connects_to"))
def _(t):
    return quality.unpowered_report(t.components, t.edges)


REACH = """d AS (SELECT DISTINCT vehicle_signature AS t, dst AS src, src AS dst FROM {edges}),
v AS (SELECT t, src AS id FROM d UNION SELECT t, dst FROM d),
reach AS (SELECT t, src, dst FROM d UNION SELECT r.t, r.src, d.dst FROM reach r JOIN d ON d.t = r.t AND d.src = r.dst),
m AS (SELECT r.t, r.src AS id, min(r.dst) AS other FROM reach r JOIN reach b ON b.t = r.t AND b.src = r.dst AND b.dst = r.src GROUP BY 1, 2),
g AS (SELECT v.t, v.id, coalesce(least(v.id, other), v.id) AS grp FROM v LEFT JOIN m ON m.t = v.t AND m.id = v.id),
l AS (SELECT DISTINCT d.t, a.grp AS src, b.grp AS dst FROM d JOIN g a ON a.t = d.t AND a.id = d.src JOIN g b ON b.t = d.t AND b.id = d.dst WHERE a.grp <> b.grp),
ways AS (SELECT DISTINCT t, grp, 0 AS depth FROM g UNION SELECT w.t, l.dst, w.depth + 1 FROM ways w JOIN l ON l.t = w.t AND l.src = w.grp),
lv AS (SELECT t, grp, max(depth) AS depth FROM ways GROUP BY 1, 2)"""


@query("g15_system_dependencies", f"""WITH RECURSIVE {REACH.format(edges="edges")},
prev AS (SELECT a.t, a.grp, a.depth, min(b.grp) AS after FROM lv a LEFT JOIN l ON l.t = a.t AND l.dst = a.grp LEFT JOIN lv b ON b.t = l.t AND b.grp = l.src AND b.depth = a.depth - 1 GROUP BY 1, 2, 3),
path AS (SELECT * FROM (SELECT t, grp, depth, after FROM prev QUALIFY row_number() OVER (PARTITION BY t ORDER BY depth DESC, grp) = 1) z UNION SELECT q.t, q.grp, q.depth, q.after FROM path p JOIN prev q ON q.t = p.t AND q.grp = p.after),
c AS (SELECT DISTINCT vehicle_signature AS t, src AS id FROM part_of WHERE is_critical)
SELECT g.t AS vehicle_signature, g.grp AS "group", count(*) AS members, count(c.id) AS critical, (SELECT count(*) FROM l WHERE l.t = g.t AND l.dst = g.grp) AS parents, (SELECT count(*) FROM l WHERE l.t = g.t AND l.src = g.grp) AS children,
  any_value(lv.depth)::BIGINT AS depth, any_value(p.depth)::BIGINT AS path_step
FROM g JOIN lv ON lv.t = g.t AND lv.grp = g.grp LEFT JOIN c ON c.t = g.t AND c.id = g.id LEFT JOIN path p ON p.t = g.t AND p.grp = g.grp GROUP BY g.t, g.grp""", ("edges", "part_of"))
def _(t):
    critical = t.part_of.filter("is_critical").select("vehicle_signature", F.col("src").alias("id"))
    return dependency.system_dependencies(t.edges, critical)


@query("g15_circuit_hierarchy", f"""WITH RECURSIVE dep AS (SELECT DISTINCT p.vehicle_signature, a.dst AS src, b.dst AS dst FROM powered_by p JOIN part_of a ON a.src = p.src AND a.vehicle_signature = p.vehicle_signature AND a.is_critical JOIN part_of b ON b.src = p.dst AND b.vehicle_signature = p.vehicle_signature WHERE a.dst <> b.dst),
{REACH.format(edges="dep")}
SELECT m.vehicle_signature, m.dst AS circuit_id, count(*) AS component_count, count(*) FILTER (is_critical) AS critical_count, count(*) FILTER (NOT is_critical) AS other_count,
  (SELECT count(*) FROM dep WHERE dep.vehicle_signature = m.vehicle_signature AND dep.src = m.dst) AS parent_circuits, (SELECT count(*) FROM dep WHERE dep.vehicle_signature = m.vehicle_signature AND dep.dst = m.dst) AS child_circuits,
  coalesce(any_value(lv.depth), 0)::BIGINT AS dependency_depth
FROM part_of m LEFT JOIN g ON g.t = m.vehicle_signature AND g.id = m.dst LEFT JOIN lv ON lv.t = g.t AND lv.grp = g.grp GROUP BY m.vehicle_signature, m.dst""", ("part_of", "powered_by"))
def _(t):
    return dependency.circuit_hierarchy(t.part_of, t.powered_by)
