"""Queries for windows and orders (W and O ids)."""

from pyspark.sql import functions as F

from wirelake.operators import graph
from wirelake.operators import ranking as op
from wirelake.plans.registry import query


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("w01_share", "SELECT vehicle_signature, type, n, round(n/sum(n) OVER (PARTITION BY vehicle_signature)*100,6) AS share FROM (SELECT vehicle_signature, type, count(*) n FROM components GROUP BY 1,2) q", "components")
def _(t):
    counts = t.components.groupBy("vehicle_signature", "type").agg(F.count(F.lit(1)).alias("n"))
    return r6(op.share(counts, "vehicle_signature", "n"), "share")


@query("w02_bigram_sequences", """SELECT concat(b, ' -> ', interaction_type) AS sequence, count(*) AS n FROM (SELECT interaction_type, lag(interaction_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM interactions) q
WHERE b IS NOT NULL GROUP BY 1 HAVING count(*)>=2 ORDER BY n DESC, sequence LIMIT 5""", "interactions")
def _(t):
    return op.bigram_sequences(t.interactions)


@query("w03_error_streaks", """WITH i AS (SELECT user_id, success, sum(CAST(success AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM interactions),
r AS (SELECT user_id, island, count(*) FILTER (NOT success) AS len FROM i GROUP BY 1,2) SELECT user_id, count(*) FILTER (len>1) AS error_sequences, max(len) AS max_streak FROM r GROUP BY 1""", "interactions")
def _(t):
    return op.error_streaks(t.interactions)


@query("w04_group_nearby_spans", """WITH p AS (SELECT doc_id, pos, y1, x1, x2, lag(x1) OVER w AS px1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM text_spans WHERE engine='tesseract' WINDOW w AS (PARTITION BY doc_id ORDER BY y1, x1, pos))
SELECT doc_id, pos, CAST(sum(CASE WHEN py2 IS NULL OR ((y1-py2)<30 AND (NOT (x2<px1 OR x1>px2) OR (y1-py2)<10)) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY y1, x1, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM p""", "text_spans")
def _(t):
    spans = t.text_spans.filter("engine = 'tesseract'").select("doc_id", "pos", "x1", "y1", "x2", "y2")
    return op.group_nearby_spans(spans, ["doc_id"]).select("doc_id", "pos", "grp")


@query("w05_auto_positions", """WITH r AS (SELECT id, vehicle_signature, type, coalesce(zone,'default') AS zone, row_number() OVER (PARTITION BY vehicle_signature, coalesce(zone,'default') ORDER BY type, id)-1 AS i FROM components WHERE x IS NULL)
SELECT id, vehicle_signature, zone, -500.0::DOUBLE+(i % 10)*100 AS x, -500.0::DOUBLE+(i // 10)*100 AS y, CASE type WHEN 'battery' THEN 0 WHEN 'ecu' THEN 200 WHEN 'relay' THEN 150 WHEN 'fuse' THEN 100 WHEN 'sensor' THEN 50 WHEN 'connector' THEN 75 ELSE 100 END::DOUBLE AS z FROM r""", "components")
def _(t):
    return op.auto_positions(t.components)


#: Origins and offsets for the fixture; a user passes the tables of the own vehicle.
ZONES = {"Unknown": (0, 0, 0), **{f"Z{i}": (i * 1000, 500, 100) for i in range(25)}}
OFFSETS = {"component": (0, 0, 0), "fuse": (10, 0, 5), "relay": (20, 0, 10), "ecu": (30, 5, 0)}


@query("w06_auto_positions_by_type", """WITH r AS (SELECT id, vehicle_signature, type, coalesce(zone,'Unknown') AS zone, row_number() OVER (PARTITION BY vehicle_signature, coalesce(zone,'Unknown'), type ORDER BY id)-1 AS i FROM components WHERE x IS NULL)
SELECT id, vehicle_signature, zone, type, CASE WHEN zone='Unknown' THEN 0 ELSE CAST(substr(zone,2) AS BIGINT)*1000 END + CASE type WHEN 'fuse' THEN 10 WHEN 'relay' THEN 20 WHEN 'ecu' THEN 30 ELSE 0 END + (i % 5)*100.0::DOUBLE AS x,
CASE WHEN zone='Unknown' THEN 0 ELSE 500 END + CASE type WHEN 'ecu' THEN 5 ELSE 0 END::DOUBLE AS y, CASE WHEN zone='Unknown' THEN 0 ELSE 100 END + CASE type WHEN 'fuse' THEN 5 WHEN 'relay' THEN 10 ELSE 0 END + (i // 5)*100.0::DOUBLE AS z FROM r""", "components")
def _(t):
    return op.auto_positions_by_type(t.components, ZONES, OFFSETS)


@query("w07_grid_fallback", """WITH r AS (SELECT id, vehicle_signature, row_number() OVER (PARTITION BY vehicle_signature ORDER BY id)-1 AS i FROM components)
SELECT id, vehicle_signature, (i % 13)*150.0::DOUBLE+75 AS x, (i // 13)*150.0::DOUBLE+75 AS y, 100.0::DOUBLE AS z FROM r""", "components")
def _(t):
    return op.grid_fallback(t.components)


@query("w08_assign_designators", """WITH p AS (SELECT id, vehicle_signature, CASE type WHEN 'connector' THEN 'J' WHEN 'fuse' THEN 'F' WHEN 'relay' THEN 'K' ELSE 'U' END AS prefix FROM components)
SELECT id, vehicle_signature, concat(prefix, row_number() OVER (PARTITION BY vehicle_signature, prefix ORDER BY id)) AS designator FROM p""", "components")
def _(t):
    return op.assign_designators(t.components.select("id", "vehicle_signature", "type"), "vehicle_signature").drop("type")


@query("w09_best_label", "SELECT doc_id, pos, max(confidence) AS confidence FROM text_spans GROUP BY 1,2", "text_spans")
def _(t):
    return op.best_label(t.text_spans, ["doc_id", "pos"]).drop("text")


@query("w10_primary_label", """WITH l AS (SELECT l_orderkey AS net_id, CASE l_returnflag WHEN 'A' THEN 'custom' WHEN 'N' THEN 'voltage' ELSE 'bus' END AS label_type, l_discount AS confidence, concat(l_partkey, '-', l_suppkey, '-', l_quantity::INT) AS text FROM lineitem)
SELECT net_id, label_type, confidence, text FROM (SELECT *, row_number() OVER (PARTITION BY net_id ORDER BY CASE label_type WHEN 'voltage' THEN 5 WHEN 'bus' THEN 3 ELSE 1 END DESC, confidence DESC, text) AS rn FROM (SELECT DISTINCT * FROM l) d) q WHERE rn=1""")
def _(t):
    labels = t.lineitem.selectExpr("l_orderkey AS net_id", "CASE l_returnflag WHEN 'A' THEN 'custom' WHEN 'N' THEN 'voltage' ELSE 'bus' END AS label_type", "l_discount AS confidence",
                                   "concat(l_partkey, '-', l_suppkey, '-', CAST(l_quantity AS INT)) AS text").distinct()
    return op.primary_label(labels)


@query("w11_rank_hits", """SELECT user_id AS query_id, event_id AS doc_id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank<=10""")
def _(t):
    hits = t.events.selectExpr("user_id AS query_id", "event_id AS doc_id", "value AS score")
    return op.rank_hits(hits, 10)


@query("w12_model_versions", """WITH v AS (SELECT concat('m', o_custkey) AS name, o_orderkey AS version, o_orderdate AS created_at, CASE WHEN o_orderstatus='F' THEN 'production' ELSE 'staging' END AS stage FROM orders),
p AS (SELECT name, version, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, version DESC) AS rk FROM v WHERE stage='production'), l AS (SELECT name, version, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, version DESC) AS rk FROM v)
SELECT l.name, l.version AS latest, p1.version AS production, p2.version AS rollback_to FROM l LEFT JOIN p p1 ON p1.name=l.name AND p1.rk=1 LEFT JOIN p p2 ON p2.name=l.name AND p2.rk=2 WHERE l.rk=1""")
def _(t):
    v = t.orders.selectExpr("concat('m', o_custkey) AS name", "o_orderkey AS version", "o_orderdate AS created_at", "CASE WHEN o_orderstatus = 'F' THEN 'production' ELSE 'staging' END AS stage")
    return op.model_versions(v)


@query("w13_best_run", """SELECT experiment, run_id, value FROM (SELECT o_custkey AS experiment, o_orderkey AS run_id, o_totalprice AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus='F') q WHERE rn=1""")
def _(t):
    runs = t.orders.selectExpr("o_custkey AS experiment", "o_orderkey AS run_id", "CASE WHEN o_orderstatus = 'F' THEN 'FINISHED' ELSE 'RUNNING' END AS status", "'accuracy' AS metric", "o_totalprice AS value")
    return op.best_run(runs)


@query("w14_progress_eta", """SELECT user_id, event_id, row_number() OVER w AS done, round(sum(value) OVER w, 8) AS elapsed, count(*) OVER (PARTITION BY user_id) AS total, round(sum(value) OVER w/row_number() OVER w,8) AS avg_time,
round(sum(value) OVER w/row_number() OVER w*(count(*) OVER (PARTITION BY user_id)-row_number() OVER w),8) AS eta, round(row_number() OVER w/count(*) OVER (PARTITION BY user_id)*100,8) AS percent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    df = op.progress_eta(t.events.select("user_id", "event_id", "ts", "value"), "user_id", [F.col("ts"), F.col("event_id")], "value")
    return df.withColumns({c: F.round(c, 8) for c in ("avg_time", "percent", "elapsed", "eta")}).drop("ts", "value")


@query("w15_chunk_context", """WITH c AS (SELECT doc_id, pos AS chunk, word AS text FROM words), a AS (SELECT doc_id, chunk FROM c WHERE length(text)>24)
SELECT a.doc_id, a.chunk AS centre, count(*) AS n, string_agg(c.text, chr(10) ORDER BY c.chunk) AS context FROM a JOIN c ON c.doc_id=a.doc_id AND c.chunk BETWEEN a.chunk-2 AND a.chunk+2 GROUP BY 1,2""", "words")
def _(t):
    chunks = t.words.select("doc_id", F.col("pos").alias("chunk"), F.col("word").alias("text"))
    return op.chunk_context(chunks, chunks.filter(F.length("text") > 24), 2)


@query("o01_compatible_topk", """WITH specs AS (SELECT id AS spec_id, vehicle_signature, voltage AS target_v, voltage*0.5 AS lo_v, voltage*1.5 AS hi_v, CASE WHEN max_current>1000 THEN NULL ELSE max_current/100 END AS current FROM circuits),
s AS (SELECT spec_id, c.id AS component_id, c.name, round((CASE WHEN c.voltage_rating=target_v THEN 1.0 ELSE 1.0-abs(c.voltage_rating-target_v)/target_v END + CASE WHEN current IS NULL THEN 1.0 WHEN c.current_rating>=current*2 THEN 1.0 ELSE 0.8 END)/2,6)::DOUBLE AS compatibility_score
FROM specs JOIN components c ON c.vehicle_signature=specs.vehicle_signature AND c.voltage_rating BETWEEN lo_v AND hi_v AND (current IS NULL OR c.current_rating>=current))
SELECT spec_id, component_id, compatibility_score, row_number() OVER (PARTITION BY spec_id ORDER BY compatibility_score DESC, name, component_id) AS rank FROM s QUALIFY rank<=5""", ("circuits", "components"))
def _(t):
    specs = t.circuits.selectExpr("id AS spec_id", "vehicle_signature", "voltage AS target_v", "voltage * 0.5D AS lo_v", "voltage * 1.5D AS hi_v", "CASE WHEN max_current > 1000 THEN NULL ELSE max_current / 100 END AS current")
    return op.compatible_topk(t.components, specs, 5)


@query("o02_replacement_topk", """WITH s AS (SELECT a.id, b.id AS candidate_id, b.name, round((CASE WHEN a.manufacturer=b.manufacturer THEN 0.3 ELSE 0 END + CASE WHEN a.part_number=b.part_number THEN 0.4 ELSE 0 END + CASE WHEN a.voltage_rating=b.voltage_rating THEN 0.2 ELSE 0 END
+ CASE WHEN b.current_rating>=a.current_rating THEN 0.1 ELSE 0 END)::DOUBLE,6) AS similarity_score FROM components a JOIN components b ON a.vehicle_signature=b.vehicle_signature AND a.type=b.type AND a.id<>b.id
WHERE coalesce(abs(b.voltage_rating-a.voltage_rating)<=1.0, true) AND coalesce(b.current_rating>=a.current_rating*0.8::DOUBLE, true))
SELECT id, candidate_id, similarity_score, row_number() OVER (PARTITION BY id ORDER BY similarity_score DESC, name, candidate_id) AS rank FROM s QUALIFY rank<=5""", "components")
def _(t):
    return op.replacement_topk(t.components, t.components, 5)


@query("o03_long_paths")
def _(t):
    sources = t.components.filter("type = 'battery'").select(F.col("id").alias("start"))
    df = graph.long_paths(t.connects_to.withColumn("rel_type", F.lit("CONNECTS_TO")), sources, 4, 10, 5)
    return df.withColumn("path_nodes", F.array_join("path_nodes", ">"))


@query("o04_recent", """SELECT job_id, project_id, created_at, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) AS rank FROM jobs WHERE status='failed' QUALIFY rank<=20""", "jobs")
def _(t):
    return op.recent(t.jobs.filter("status = 'failed'").select("job_id", "project_id", "created_at"), "created_at", "job_id", 20, key="project_id")


@query("o05_wire_lengths", """SELECT e.src, e.dst, e.vehicle_signature, round(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2),6) AS total_length, CASE WHEN sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2)>1000 THEN 'high' WHEN sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2)>500 THEN 'medium' ELSE 'low' END AS routing_complexity
FROM connects_to e JOIN components a ON a.id=e.src AND a.x IS NOT NULL JOIN components b ON b.id=e.dst AND b.x IS NOT NULL""", ("connects_to", "components"))
def _(t):
    return r6(op.wire_lengths(t.components, t.connects_to), "total_length")


@query("o06_peripherals", """WITH d AS (SELECT a.id, b.id AS peripheral_id, round(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2),6) AS distance, b.type FROM components a JOIN components b ON a.vehicle_signature=b.vehicle_signature AND a.id<>b.id WHERE a.x IS NOT NULL AND b.x IS NOT NULL AND a.type='connector')
SELECT id, peripheral_id, distance, row_number() OVER (PARTITION BY id ORDER BY distance, peripheral_id) AS rank FROM d WHERE type = 'battery' OR distance<=800 QUALIFY rank<=8""", "components")
def _(t):
    return op.peripherals(t.components.filter("type = 'connector'"), t.components)


@query("o07_needs_inspection", """WITH g AS (SELECT c.*, coalesce(n,0) AS relationship_count FROM components c LEFT JOIN (SELECT id, count(*) n FROM (SELECT src AS id FROM connects_to UNION ALL SELECT dst FROM connects_to) q GROUP BY 1) d ON d.id=c.id)
SELECT id, vehicle_signature, relationship_count, CASE WHEN relationship_count=0 THEN 'orphaned' WHEN x IS NULL THEN 'missing_position' ELSE 'missing_electrical' END AS reason FROM g WHERE relationship_count=0 OR x IS NULL OR voltage_rating IS NULL OR current_rating IS NULL""", ("components", "connects_to"))
def _(t):
    return op.needs_inspection(t.components, t.connects_to)


@query("o08_text_regions", "SELECT doc_id, engine, pos, (x2-x1)*(y2-y1) AS area FROM text_spans WHERE (x2-x1)*(y2-y1)>100 AND (x2-x1)/(y2-y1)>0.1 AND (x2-x1)/(y2-y1)<20", "text_spans")
def _(t):
    return op.text_regions(t.text_spans).select("doc_id", "engine", "pos", "area")


@query("o09_favourites", """SELECT user_id, target_object_id, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, target_object_id) AS rank FROM (SELECT user_id, target_object_id, count(*) n FROM interactions GROUP BY 1,2) q QUALIFY rank<=5""", "interactions")
def _(t):
    return op.favourites(t.interactions)
