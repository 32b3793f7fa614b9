"""Queries for fusion, matching, wires and grid joins (D ids, J-20..J-23, X-01..X-04, X-09)."""

from pyspark.sql import functions as F

from wirelake.operators import ranking
from wirelake.operators import schematic as op
from wirelake.operators import setops, spatial
from wirelake.operators.aggregates import netlist_stats
from wirelake.plans.registry import query
from wirelake.session import cut

KEY = ["doc_id"]


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def spans(t):
    return t.text_spans.select("doc_id", "engine", "pos", "text", "confidence", "x1", "y1", "x2", "y2")


def one_engine(t):
    return t.text_spans.filter("engine = 'tesseract'").select(
        "doc_id", F.concat(F.lit("t"), "doc_id", F.lit("-"), "pos").alias("span_id"), "text", "confidence", "x1", "y1", "x2", "y2")


ONE = "one AS (SELECT doc_id, concat('t', doc_id, '-', pos) AS span_id, text, confidence, x1, y1, x2, y2, (x1+x2)/2 AS x, (y1+y2)/2 AS y FROM text_spans WHERE engine='tesseract')"
DET = "det AS (SELECT *, (x1+x2)/2 AS x, (y1+y2)/2 AS y FROM detections)"


@query("j20_near_pairs", f"""WITH {ONE}, {DET} SELECT o.span_id, d.comp_id, round(sqrt((o.x-d.x)**2+(o.y-d.y)**2),6) AS distance FROM one o JOIN det d ON d.doc_id=o.doc_id AND abs(o.y-d.y)<=50 AND abs(o.x-d.x)<=50 WHERE (o.x-d.x)**2+(o.y-d.y)**2<=2500""", ("text_spans", "detections"))
def _(t):
    def centred(df):
        return df.withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y2")) / 2})
    pairs = spatial.near_pairs(centred(one_engine(t)), centred(t.detections), 50.0, KEY)
    return pairs.select("a.span_id", "b.comp_id", F.round("distance", 6).alias("distance"))


@query("j21_nearest_pin", f"""WITH {ONE}, {DET}, p AS (SELECT o.doc_id, o.span_id AS label_id, d.comp_id AS pin_id, sqrt((o.x-d.x1)**2+(o.y-d.y1)**2) AS distance, o.confidence FROM one o JOIN det d ON d.doc_id=o.doc_id WHERE (o.x-d.x1)**2+(o.y-d.y1)**2<=400)
SELECT doc_id, label_id, pin_id, round(distance,6) AS distance, round(confidence*(1-distance/20),6) AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, label_id ORDER BY distance, pin_id)=1""", ("text_spans", "detections"))
def _(t):
    labels = one_engine(t).select("doc_id", F.col("span_id").alias("label_id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), "confidence")
    pins = t.detections.select("doc_id", F.col("comp_id").alias("pin_id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    return r6(spatial.nearest_pin(labels, pins, KEY), "distance", "confidence")


@query("j22_component_nets", """WITH e AS (SELECT doc_id, seg_id, x1 AS x, y1 AS y FROM segments UNION ALL SELECT doc_id, seg_id, x2, y2 FROM segments)
SELECT DISTINCT d.doc_id, d.comp_id, e.seg_id AS net_id FROM detections d JOIN e ON e.doc_id=d.doc_id AND e.x BETWEEN d.x1-15 AND d.x2+15 AND e.y BETWEEN d.y1-15 AND d.y2+15""", ("segments", "detections"))
def _(t):
    return spatial.component_nets(t.detections, t.segments.withColumnRenamed("seg_id", "net_id"), KEY)


@query("j23_net_label_pairs", f"""WITH {ONE} SELECT s.doc_id, s.seg_id AS net_id, o.span_id, round(sqrt((o.x-greatest(s.x1,least(s.x2,o.x)))**2+(o.y-greatest(s.y1,least(s.y2,o.y)))**2),6) AS distance
FROM segments s JOIN one o ON o.doc_id=s.doc_id AND (o.x-greatest(s.x1,least(s.x2,o.x)))**2+(o.y-greatest(s.y1,least(s.y2,o.y)))**2<=400""", ("segments", "text_spans"))
def _(t):
    return r6(spatial.net_label_pairs(t.segments.withColumnRenamed("seg_id", "net_id"), one_engine(t), KEY, 20.0), "distance")


# connected boxes: words of one line can overlap their neighbours, lines never do
def _groups(where: str) -> str:
    return f"""sp AS (SELECT doc_id*10000000 + pos*3 + CASE engine WHEN 'tesseract' THEN 0 WHEN 'deepseek' THEN 1 ELSE 2 END AS id, * FROM text_spans WHERE {where}),
pr AS (SELECT a.id AS a, b.id AS b FROM (SELECT a.id, b.id AS bid, greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)) AS i, (a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1) AS s
  FROM sp a JOIN sp b ON a.doc_id=b.doc_id AND a.pos//20=b.pos//20 AND a.id<>b.id AND abs(a.pos-b.pos)<20) a JOIN sp b ON b.id=a.bid WHERE i>0 AND i/(s-i)>0.3),
r AS (SELECT id, id AS root FROM sp UNION SELECT pr.b, r.root FROM r JOIN pr ON pr.a=r.id),
g AS (SELECT sp.*, q.root AS grp FROM sp JOIN (SELECT id, min(root) AS root FROM r GROUP BY 1) q ON q.id=sp.id)"""


@query("d01_group_boxes", f"WITH RECURSIVE {_groups('true')}, n AS (SELECT doc_id, grp, count(*) AS members FROM g GROUP BY 1,2) SELECT doc_id, members, count(*) AS groups FROM n GROUP BY 1,2", "text_spans")
def _(t):
    g = op.group_boxes(spans(t).select(*KEY, "x1", "y1", "x2", "y2"), KEY).groupBy("doc_id", "group").agg(F.count(F.lit(1)).alias("members"))
    return g.groupBy("doc_id", "members").agg(F.count(F.lit(1)).alias("groups"))


@query("d01_group_boxes_greedy")
def _(t):
    g = op.group_boxes_greedy(t.detections.select("doc_id", "comp_id", "confidence", "x1", "y1", "x2", "y2"), KEY, 0.15)
    return g.groupBy("doc_id", "group").agg(F.count(F.lit(1)).alias("members"))


@query("d02_fuse_confidence", f"""WITH RECURSIVE {_groups('confidence >= 0.5')} SELECT doc_id, members, s.text AS text, s.engine AS engine, s.confidence AS confidence, s.x1 AS x1 FROM (SELECT doc_id, grp, count(*) AS members, max_by(g, (confidence, engine, text, x1, y1, x2, y2)) AS s FROM g GROUP BY 1,2) q""", "text_spans")
def _(t):
    return op.fuse_confidence(spans(t).drop("pos"), KEY).select("doc_id", "members", "text", "engine", "confidence", "x1")


@query("d03_fuse_consensus", f"""WITH RECURSIVE {_groups('true')}, f AS (SELECT doc_id, grp, count(*) AS members, count(DISTINCT engine) AS engines, max(confidence) AS mx, avg(confidence) AS confidence, sum(x1*confidence)/sum(confidence) AS x1, sum(y2*confidence)/sum(confidence) AS y2, max_by(text, (confidence, engine, text)) AS text FROM g GROUP BY 1,2)
SELECT doc_id, members, engines, round(confidence,6) AS confidence, round(x1,5) AS x1, round(y2,5) AS y2, text FROM f WHERE engines>=2 OR (members=1 AND mx>0.8)""", "text_spans")
def _(t):
    df = op.fuse_consensus(spans(t), KEY)
    return df.select("doc_id", "members", "engines", F.round("confidence", 6).alias("confidence"), F.round("x1", 5).alias("x1"), F.round("y2", 5).alias("y2"), "text")


@query("d04_fuse_text_vote", f"""WITH RECURSIVE {_groups('true')}, v AS (SELECT doc_id, grp, lower(trim(text)) AS vote, sum(confidence) AS w, max_by(text, (confidence, engine, text)) AS tx FROM g GROUP BY 1,2,3),
b AS (SELECT doc_id, grp, max_by(tx, (round(w,9), vote)) AS text FROM v GROUP BY 1,2) SELECT b.doc_id, b.text, count(*) AS groups FROM b GROUP BY 1,2""", "text_spans")
def _(t):
    return op.fuse_text_vote(spans(t), KEY).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("groups"))


@query("d05_fuse_by_name")
def _(t):
    return op.fuse(spans(t), KEY, "ensemble").groupBy("doc_id", "engine").agg(F.count(F.lit(1)).alias("n"))


@query("d06_fusion_metrics", f"""WITH RECURSIVE {_groups('true')}, n AS (SELECT doc_id, grp, count(*) AS n, count(DISTINCT engine) AS e FROM g GROUP BY 1,2)
SELECT doc_id, sum(n)::BIGINT AS spans, count(*) AS total_groups, count(*) FILTER (e>1) AS multi_engine_groups, round(count(*) FILTER (e>1)/count(*),6) AS agreement_rate FROM n GROUP BY 1""", "text_spans")
def _(t):
    return r6(op.fusion_metrics(spans(t).select(*KEY, "engine", "x1", "y1", "x2", "y2"), KEY), "agreement_rate")


@query("d07_nms")
def _(t):
    return op.nms(t.detections.select("doc_id", "confidence", "x1", "y1", "x2", "y2"), KEY, 0.1)


@query("d08_merge_detections")
def _(t):
    d = t.detections.select("doc_id", "label", "confidence", "x1", "y1", "x2", "y2")
    moved = d.select("doc_id", "label", (F.col("confidence") - 0.1).alias("confidence"), (F.col("x1") + 3).alias("x1"), "y1", (F.col("x2") + 3).alias("x2"), "y2")
    return op.merge_detections(d, moved, KEY)


@query("d09_associate_text")
def _(t):
    return op.associate_text(one_engine(t), t.detections, KEY)


def lines_of(t):
    """The segments, written once: the steps on them read them many times."""
    return cut(t.segments)


def wires(t):
    return lines_of(t).withColumns({"thickness": F.lit(1.0), "confidence": F.lit(0.9)})


@query("d10_merge_collinear")
def _(t):
    return op.merge_collinear(wires(t), KEY)


@query("d11_junction_points")
def _(t):
    return op.junction_points(lines_of(t), KEY)


@query("d12_junctions")
def _(t):
    return op.junctions(op.junction_points(lines_of(t), KEY), KEY)[0]


@query("d13_trace_nets")
def _(t):
    segments = lines_of(t)
    _, lines = op.junctions(op.junction_points(segments, KEY), KEY)
    return op.trace_nets(segments, lines, KEY)


@query("d13_net_endpoints")
def _(t):
    segments = lines_of(t)
    table, lines = op.junctions(op.junction_points(segments, KEY), KEY)
    return op.net_endpoints(segments, op.trace_nets(segments, lines, KEY), table, KEY)


def drawn(t):
    """Components of the drawing with designators and pin counts, and segments with their line as net."""
    named = ranking.assign_designators(t.detections.select("doc_id", "comp_id", F.col("comp_id").alias("id"), F.col("label").alias("type"), "x1", "y1", "x2", "y2"), "doc_id")
    comp = cut(named.withColumns({"pins": F.when(F.col("type").isin("resistor", "capacitor", "diode"), 2).when(F.col("type") == "transistor", 3).otherwise(4), "pin_labels": F.lit(0)}))
    nets = lines_of(t).withColumnRenamed("seg_id", "net_id")
    texts = cut(one_engine(t).filter(F.col("text").rlike("^[A-Z]")))
    label = spatial.net_label_pairs(nets, texts, KEY, 10.0)
    found = label.join(texts.select(*KEY, "span_id", "text", "confidence"), [*KEY, "span_id"])
    primary = ranking.primary_label(found.withColumn("label_type", F.lit("custom")), "net_id").select("doc_id", "net_id", "text", "confidence")
    return comp, nets, primary


@query("d14_netlist_nets")
def _(t):
    return op.netlist(*drawn(t), KEY)[0]


@query("d14_netlist_unresolved")
def _(t):
    return op.netlist(*drawn(t), KEY)[2]


@query("a25_netlist_stats")
def _(t):
    comp, segments, labels = drawn(t)
    nets, connections, unresolved = op.netlist(comp, segments, labels, KEY)
    frames = [d.withColumnRenamed("doc_id", "doc") for d in (comp, nets, connections, unresolved)]
    return netlist_stats(*frames, ["resistor", "capacitor", "ic", "diode", "connector", "transistor"])


@query("d15_geometry_signals", """WITH p AS (SELECT a.doc_id, a.pos, greatest(0,least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0,least(a.y2,b.y2)-greatest(a.y1,b.y1)) AS i, (a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1) AS s
FROM text_spans a JOIN text_spans b ON b.doc_id=a.doc_id AND b.pos=a.pos AND b.engine='deepseek' WHERE a.engine='tesseract'), d AS (SELECT doc_id, pos, 1-i/(s-i) AS bd FROM p)
SELECT doc_id, pos, round(bd*2,6) AS total_difference, CASE WHEN bd*2>0.7 THEN 'high' WHEN bd*2>0.3 THEN 'medium' ELSE 'low' END AS severity FROM d WHERE bd*2>=0.1""", "text_spans")
def _(t):
    one = F.struct("x1", "y1", "x2", "y2")
    a = t.text_spans.filter("engine = 'tesseract'").select("doc_id", "pos", one.alias("expected"), F.array(one).alias("expected_pins"))
    b = t.text_spans.filter("engine = 'deepseek'").select("doc_id", "pos", one.alias("actual"), F.array(one).alias("actual_pins"))
    return op.geometry_signals(a.join(b, ["doc_id", "pos"])).select("doc_id", "pos", F.round("total_difference", 6).alias("total_difference"), "severity")


@query("d16_ocr_disagreement", """WITH r AS (SELECT doc_id, pos, count(*) AS engine_count, count(DISTINCT text) AS unique_results, round(max(confidence)-min(confidence),9) AS cd, var_pop(length(text)) AS v FROM text_spans GROUP BY 1,2 HAVING count(*)>=2 AND count(DISTINCT text)>1 AND round(max(confidence)-min(confidence),9)>=0.3),
e AS (SELECT a.doc_id, a.pos, avg(levenshtein(a.text,b.text)) AS d FROM text_spans a JOIN text_spans b ON b.doc_id=a.doc_id AND b.pos=a.pos AND a.engine<b.engine GROUP BY 1,2)
SELECT doc_id, pos, engine_count::INTEGER AS engine_count, unique_results::INTEGER AS unique_results, round(cd,6) AS confidence_difference, round(d,6) AS avg_edit_distance, round(v,6) AS text_length_variance, CASE WHEN cd>0.7 OR d>10 THEN 'high' WHEN cd>0.4 OR d>5 THEN 'medium' ELSE 'low' END AS severity FROM r JOIN e USING (doc_id, pos)""", "text_spans")
def _(t):
    df = op.ocr_disagreement(t.text_spans.withColumn("confidence", F.round("confidence", 9)), ["doc_id", "pos"])
    return r6(df, "confidence_difference", "avg_edit_distance", "text_length_variance")


@query("d17_detection_signals", """SELECT l_orderkey, count(*) AS error_count, count(DISTINCT l_returnflag) AS error_diversity, count(*) FILTER (l_returnflag='A') AS pin_count_errors, count(*) AS symbol_count, round(avg(l_discount*10),6) AS avg_confidence,
round(least(1.0,count(*)/10),6) AS confidence, CASE WHEN count(*) FILTER (l_returnflag='R')>0 THEN 'high' WHEN count(*)>3 THEN 'medium' ELSE 'low' END AS severity FROM lineitem GROUP BY 1""")
def _(t):
    symbols = t.lineitem.selectExpr("l_orderkey", "l_discount * 10 AS confidence")
    errors = t.lineitem.selectExpr("l_orderkey", "CASE l_returnflag WHEN 'A' THEN 'pin count wrong' WHEN 'N' THEN 'duplicate symbol' ELSE 'Type mismatch' END AS message")
    return r6(op.detection_signals(symbols, errors, ["l_orderkey"]), "avg_confidence", "confidence")


@query("d17_net_conflicts", """SELECT l_suppkey, l_partkey AS net_id, CASE WHEN count(DISTINCT l_linestatus)>1 THEN 'voltage' ELSE 'name' END AS conflict_type, CASE WHEN count(DISTINCT l_linestatus)>1 THEN 'high' ELSE 'medium' END AS severity,
greatest(count(DISTINCT l_linestatus), count(DISTINCT l_returnflag)) AS nets_involved, false AS has_power_nets, 0.8::DOUBLE AS confidence FROM lineitem GROUP BY 1,2 HAVING count(DISTINCT l_linestatus)>1 OR count(DISTINCT l_returnflag)>1""")
def _(t):
    nets = t.lineitem.selectExpr("l_suppkey", "l_partkey AS net_id", "l_returnflag AS name", "l_linestatus AS voltage")
    return op.net_conflicts(nets, ["l_suppkey"])


NEAR3 = "(a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2"


@query("x01_within_radius", f"SELECT a.id AS centre_id, b.id, round(sqrt({NEAR3}),6) AS distance FROM components a JOIN components b ON a.vehicle_signature=b.vehicle_signature AND a.id<>b.id WHERE {NEAR3}<=40000", "components")
def _(t):
    return r6(spatial.within_radius(t.components, t.components, 200.0), "distance")


@query("x02_spatial_clusters", f"""WITH RECURSIVE p AS (SELECT a.id AS a, b.id AS b FROM components a JOIN components b ON a.vehicle_signature=b.vehicle_signature AND a.id<>b.id WHERE {NEAR3}<=3600),
r AS (SELECT id, id AS root FROM components WHERE x IS NOT NULL UNION SELECT p.b, r.root FROM r JOIN p ON p.a=r.id), g AS (SELECT c.*, q.root FROM components c JOIN (SELECT id, min(root) AS root FROM r GROUP BY 1) q ON q.id=c.id),
m AS (SELECT root, vehicle_signature, count(*) AS size, min(id) AS first_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM g GROUP BY 1,2 HAVING count(*)>=2),
z AS (SELECT root, zone FROM (SELECT root, zone, count(*) n FROM g WHERE zone IS NOT NULL GROUP BY 1,2) q QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC, zone)=1)
SELECT m.vehicle_signature, m.size, m.first_id, round(cx,6) AS centre_x, round(cy,6) AS centre_y, round(cz,6) AS centre_z, round(max(sqrt((x-cx)**2+(y-cy)**2+(z-cz)**2)),6) AS radius, z.zone FROM m JOIN g ON g.root=m.root LEFT JOIN z ON z.root=m.root GROUP BY m.root, m.vehicle_signature, m.size, m.first_id, cx, cy, cz, z.zone""", "components")
def _(t):
    df = spatial.spatial_clusters(t.components, 60.0)
    return r6(df, "centre_x", "centre_y", "centre_z", "radius").drop("cluster", "density")


SIZE = "CASE type WHEN 'battery' THEN 240 WHEN 'ecu' THEN 180 WHEN 'relay' THEN 30 WHEN 'fuse' THEN 20 ELSE 40 END"


@query("x03_overlap_check", f"""WITH c AS (SELECT id, vehicle_signature, x, y, z, {SIZE} AS size FROM components WHERE x IS NOT NULL), h AS (SELECT a.id, b.id AS conflict_id, sqrt({NEAR3}) AS distance FROM c a JOIN c b ON a.vehicle_signature=b.vehicle_signature AND a.id<>b.id WHERE sqrt({NEAR3})<(a.size+b.size)/2+50)
SELECT id, conflict_id, round(distance,6) AS distance, count(*) OVER (PARTITION BY id) AS conflicts FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, conflict_id)=1""", "components")
def _(t):
    c = t.components.filter("x IS NOT NULL").select("id", "vehicle_signature", "x", "y", "z", F.expr(SIZE).alias("size"))
    return r6(spatial.overlap_check(c, c), "distance")


@query("x04_collisions", f"""WITH c AS (SELECT id, vehicle_signature, x, y, z, {SIZE}::DOUBLE AS d FROM components WHERE x IS NOT NULL) SELECT a.vehicle_signature, a.id AS a_id, b.id AS b_id FROM c a JOIN c b ON a.vehicle_signature=b.vehicle_signature AND a.id<b.id
WHERE abs(a.x-b.x)<=(a.d+b.d)/2 AND abs(a.y-b.y)<=(a.d+b.d)/2 AND abs(a.z-b.z)<=(a.d+b.d)/2""", "components")
def _(t):
    c = t.components.filter("x IS NOT NULL").withColumn("d", F.expr(SIZE).cast("double"))
    return spatial.collisions(c.select("id", "vehicle_signature", "x", "y", "z", *[F.col("d").alias(f"d{a}") for a in "xyz"]), ["vehicle_signature"])


@query("x09_scene_dataset", """SELECT vehicle_signature, 'component' AS kind, id, x, y, z, NULL::DOUBLE AS x2, NULL::DOUBLE AS y2, NULL::DOUBLE AS z2 FROM components WHERE x IS NOT NULL
UNION ALL SELECT e.vehicle_signature, 'wire', concat(e.src,'-',e.dst), a.x, a.y, a.z, b.x, b.y, b.z FROM connects_to e JOIN components a ON a.id=e.src AND a.x IS NOT NULL JOIN components b ON b.id=e.dst AND b.x IS NOT NULL
UNION ALL SELECT vehicle_signature, 'bounds', vehicle_signature, min(x)-100, min(y)-100, min(z)-100, max(x)+100, max(y)+100, max(z)+100 FROM components WHERE x IS NOT NULL GROUP BY 1""", ("components", "connects_to"))
def _(t):
    return spatial.scene_dataset(t.components, t.edges)


@query("x12_apply_positions", """SELECT c.id, coalesce(n.x, c.x) AS x, coalesce(n.y, c.y) AS y FROM components c LEFT JOIN (SELECT concat('P', l_partkey) AS id, max(l_quantity) AS x, max(l_tax) AS y FROM lineitem WHERE l_returnflag='A' GROUP BY 1) n ON n.id=c.id""", "components")
def _(t):
    new = t.lineitem.filter("l_returnflag = 'A'").groupBy(F.concat(F.lit("P"), "l_partkey").alias("id")).agg(F.max("l_quantity").alias("nx"), F.max("l_tax").alias("ny"))
    return setops.apply_updates(t.components, new, ["id"], {"x": "nx", "y": "ny"}).select("id", "x", "y")
