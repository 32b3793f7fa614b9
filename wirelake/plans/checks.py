"""Queries for evaluation, record rules and behaviour (E, Q and B ids)."""

from pyspark.sql import functions as F

from wirelake.operators import behaviour as bh
from wirelake.operators import evaluate as ev
from wirelake.operators import quality as q
from wirelake.operators import ranking
from wirelake.operators import schematic
from wirelake.plans.registry import query


def rd(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def joined(df, *columns):
    return df.withColumns({c: F.array_join(c, "; ") for c in columns})


RUNS = """runs AS (SELECT user_id AS query_id, event_id AS doc_id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank<=20),
rel AS (SELECT user_id AS query_id, event_id AS doc_id FROM events WHERE event_type IN ('click','purchase')), j AS (SELECT r.*, CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM runs r LEFT JOIN rel q ON q.query_id=r.query_id AND q.doc_id=r.doc_id),
n AS (SELECT query_id, count(*) AS relevant FROM rel GROUP BY 1)"""


def ranked(t):
    runs = ranking.rank_hits(t.events.selectExpr("user_id AS query_id", "event_id AS doc_id", "value AS score"), 20)
    return runs, t.events.filter("event_type IN ('click', 'purchase')").selectExpr("user_id AS query_id", "event_id AS doc_id")


@query("e01_precision_recall", f"""WITH {RUNS} SELECT query_id, max(rel)::DOUBLE AS hit_rate, round(sum(rel) FILTER (rank<=5)/count(*) FILTER (rank<=5),8) AS precision_5, round(coalesce(sum(rel) FILTER (rank<=5)/max(relevant),0),8) AS recall_5,
round(sum(rel) FILTER (rank<=10)/count(*) FILTER (rank<=10),8) AS precision_10, round(coalesce(sum(rel) FILTER (rank<=10)/max(relevant),0),8) AS recall_10 FROM j LEFT JOIN n USING (query_id) GROUP BY 1""")
def _(t):
    return rd(ev.precision_recall(*ranked(t), [5, 10]), 8, "precision_5", "recall_5", "precision_10", "recall_10")


@query("e02_ndcg", f"""WITH {RUNS} SELECT query_id, round(coalesce(sum(rel/log2(rank+1)) FILTER (rank<=10)/(SELECT sum(1/log2(i+1)) FROM range(1,11) t(i) WHERE i<=max(relevant)),0),8) AS ndcg_10 FROM j LEFT JOIN n USING (query_id) GROUP BY 1""")
def _(t):
    return rd(ev.ndcg(*ranked(t), [10]), 8, "ndcg_10")


@query("e03_average_precision", f"""WITH {RUNS}, c AS (SELECT query_id, rel*sum(rel) OVER (PARTITION BY query_id ORDER BY rank)/rank AS p FROM j) SELECT query_id, round(coalesce(sum(p)/max(relevant),0),8) AS average_precision FROM c LEFT JOIN n USING (query_id) GROUP BY 1""")
def _(t):
    return rd(ev.average_precision(*ranked(t)), 8, "average_precision")


@query("e04_reciprocal_rank", f"WITH {RUNS} SELECT query_id, round(coalesce(1.0/min(rank) FILTER (rel=1),0)::DOUBLE,8) AS reciprocal_rank FROM j GROUP BY 1")
def _(t):
    return rd(ev.reciprocal_rank(*ranked(t)), 8, "reciprocal_rank")


@query("e05_entity_accuracy", f"""WITH {RUNS}, h AS (SELECT DISTINCT query_id, doc_id % 50 AS entity FROM runs WHERE rank<=10), x AS (SELECT DISTINCT query_id, doc_id % 50 AS entity FROM rel)
SELECT x.query_id, round(count(h.entity)/count(*),8) AS accuracy FROM x LEFT JOIN h USING (query_id, entity) GROUP BY 1""")
def _(t):
    runs, rel = ranked(t)
    hits = runs.withColumn("entity", F.col("doc_id") % 50)
    return rd(ev.entity_accuracy(hits, rel.withColumn("entity", F.col("doc_id") % 50)), 8, "accuracy")


METRICS = "m AS (SELECT concat(event_type, CASE WHEN event_type IN ('click','view') THEN '_latency' ELSE '' END) AS metric, value FROM events)"


def metric_rows(t):
    return t.events.select(F.concat("event_type", F.when(F.col("event_type").isin("click", "view"), "_latency").otherwise("")).alias("metric"), "value")


@query("e06_aggregate_metrics", f"""WITH {METRICS}, r AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) AS rn, count(*) OVER (PARTITION BY metric) AS n FROM m)
SELECT metric, max(n) AS n, round(avg(value),8) AS mean, min(value) AS min, max(value) AS max, max(value) FILTER (contains(metric,'latency') AND rn=floor(0.95*n)+1) AS p95, max(value) FILTER (contains(metric,'latency') AND rn=floor(0.99*n)+1) AS p99 FROM r GROUP BY 1""")
def _(t):
    return rd(ev.aggregate_metrics(metric_rows(t)), 8, "mean")


@query("e07_compare_baseline", """WITH b AS (SELECT o_custkey AS benchmark, o_orderpriority AS metric, o_orderdate AS ts, o_totalprice AS value, o_orderstatus AS s FROM orders),
x AS (SELECT benchmark, metric, max(value) AS v FROM b JOIN (SELECT benchmark, max(ts) AS ts FROM b WHERE s='F' GROUP BY 1) l USING (benchmark, ts) WHERE s='F' GROUP BY 1,2), y AS (SELECT benchmark, metric, max(value) AS v FROM b JOIN (SELECT benchmark, max(ts) AS ts FROM b WHERE s='O' GROUP BY 1) l USING (benchmark, ts) WHERE s='O' GROUP BY 1,2)
SELECT benchmark, metric, x.v AS baseline, y.v AS current, round((y.v-x.v)/x.v,8) AS improvement, round(y.v-x.v,6) AS absolute_change, CASE WHEN (y.v-x.v)/x.v>0.05 THEN 'better' WHEN (y.v-x.v)/x.v<-0.05 THEN 'worse' ELSE 'same' END AS band FROM x JOIN y USING (benchmark, metric)""")
def _(t):
    r = t.orders.selectExpr("o_custkey AS benchmark", "o_orderdate AS run_ts", "o_orderpriority AS metric", "o_totalprice AS value", "o_orderstatus AS s")
    return rd(rd(ev.compare_baseline(r.filter("s = 'F'").drop("s"), r.filter("s = 'O'").drop("s")), 8, "improvement"), 6, "absolute_change")


@query("e08_overall_scores", """WITH m AS (SELECT CASE event_type WHEN 'click' THEN 'precision_mean' WHEN 'view' THEN 'recall_mean' ELSE 'ndcg_mean' END AS metric, value/200 AS value FROM events),
a AS (SELECT avg(value) FILTER (metric='precision_mean') AS p, avg(value) FILTER (metric='recall_mean') AS r, avg(value) FILTER (metric='ndcg_mean') AS n FROM m) SELECT round(p,8) AS overall_precision, round(r,8) AS overall_recall, round(n,8) AS overall_ndcg, NULL::DOUBLE AS overall_component_accuracy, NULL::DOUBLE AS overall_net_accuracy, round(2*p*r/(p+r),8) AS overall_f1 FROM a""")
def _(t):
    m = t.events.selectExpr("CASE event_type WHEN 'click' THEN 'precision_mean' WHEN 'view' THEN 'recall_mean' ELSE 'ndcg_mean' END AS metric", "value / 200 AS value")
    df = ev.overall_scores(m)
    return rd(df, 8, *df.columns)


@query("e09_compare_strategies", """WITH p AS (SELECT event_type AS strategy, user_id, max(value) AS l, avg(value) AS a, max(value) AS tp, count(*) AS n FROM events GROUP BY 1,2) SELECT strategy, round(avg(l),8) AS latency, round(avg(a),8) AS avg_relevance_score, round(avg(tp),8) AS top_score, round(avg(n),8) AS num_results FROM p GROUP BY 1""")
def _(t):
    r = t.events.selectExpr("event_type AS strategy", "user_id AS query_id", "value AS score", "value AS latency")
    return rd(ev.compare_strategies(r), 8, "latency", "avg_relevance_score", "top_score", "num_results")


@query("e10_signal_quality", "SELECT event_type AS signal_type, round(avg(value),8) AS avg_confidence, count(DISTINCT user_id) AS coverage, count(*) AS total FROM events GROUP BY 1")
def _(t):
    return rd(ev.signal_quality(t.events.selectExpr("event_type AS signal_type", "value AS confidence", "user_id AS page")), 8, "avg_confidence")


@query("e11_ocr_evaluation")
def _(t):
    line = F.floor(F.col("pos") / 20).alias("line")
    spans = t.text_spans.select("engine", "doc_id", line, "pos", "text")
    truth = t.words.join(t.documents.select("doc_id", "lang"), "doc_id").select("doc_id", line, "lang", "pos", F.col("word").alias("text"))
    df = ev.ocr_evaluation(spans, truth, ["doc_id", "line"], "lang")
    return rd(df, 8, *[c for c in df.columns if c.startswith("avg_")])


@query("e12_experiment_table", """SELECT o_orderkey AS run_id, date_diff('second', o_orderdate, o_orderdate + INTERVAL 90 MINUTE)/60 AS duration_minutes, max(l_discount) FILTER (l_returnflag='A') AS "A", max(l_discount) FILTER (l_returnflag='R') AS "R" FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1, 2""")
def _(t):
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("start_time"), (F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTES")).cast("timestamp").alias("end_time"))
    values = t.lineitem.selectExpr("l_orderkey AS run_id", "l_returnflag AS name", "l_discount AS value")
    return ev.experiment_table(runs, values, ["A", "R"]).select("run_id", "duration_minutes", "A", "R")


@query("e13_expand_grid", "SELECT s_suppkey AS experiment, lr, bs FROM supplier, (VALUES (0.1::DOUBLE), (0.01::DOUBLE)) a(lr), (VALUES (16), (32), (64)) b(bs)")
def _(t):
    spec = t.supplier.select(F.col("s_suppkey").alias("experiment"), F.array(F.lit(0.1), F.lit(0.01)).alias("lr"), F.array(*[F.lit(v) for v in (16, 32, 64)]).alias("bs"))
    return ev.expand_grid(spec)


@query("e13_sweep_analysis", """SELECT o_custkey AS experiment, 'o_orderpriority' AS parameter, o_orderpriority AS value, round(avg(o_totalprice),6) AS mean, count(*) AS runs FROM orders WHERE o_orderstatus='F' GROUP BY 1,3""")
def _(t):
    r = t.orders.selectExpr("o_custkey AS experiment", "o_orderkey AS run_id", "CASE WHEN o_orderstatus = 'F' THEN 'FINISHED' ELSE 'FAILED' END AS status", "o_orderpriority", "o_totalprice AS accuracy")
    return rd(ev.sweep_analysis(r, ["o_orderpriority"])[1], 6, "mean")


# ---- record rules ----------------------------------------------------------------------------



@query("q01_validate_components", """SELECT id, '' AS errors, concat_ws('; ', CASE WHEN type NOT IN ('relay','fuse','connector','sensor','actuator','switch','ecu','harness','battery','alternator','starter','ground') THEN 'Unknown type: '||type END) AS warnings, true AS is_valid FROM components""", "components")
def _(t):
    return joined(q.validate(t.components, "component").select("id", "errors", "warnings", "is_valid"), "errors", "warnings")


@query("q02_validate_connections", """SELECT from_id, to_id, concat_ws('; ', CASE WHEN NOT regexp_matches(from_id,'^[a-zA-Z0-9_-]+$') THEN 'from_id contains invalid characters. Use only letters, numbers, hyphens, and underscores' END) AS errors,
concat_ws('; ', CASE WHEN from_id=to_id THEN 'Component connects to itself' END, CASE WHEN g='x2mm' THEN 'wire_gauge has invalid format: x2mm' END) AS warnings FROM (SELECT CASE WHEN l_returnflag='A' THEN concat('P ', l_partkey) ELSE concat('P', l_partkey) END AS from_id, concat('P', l_suppkey) AS to_id, CASE WHEN l_linestatus='F' THEN 'x2mm' ELSE '2.5mm²' END AS g FROM lineitem) q""")
def _(t):
    c = t.lineitem.selectExpr("CASE WHEN l_returnflag = 'A' THEN concat('P ', l_partkey) ELSE concat('P', l_partkey) END AS from_id", "concat('P', l_suppkey) AS to_id", "CASE WHEN l_linestatus = 'F' THEN 'x2mm' ELSE '2.5mm²' END AS wire_gauge")
    return joined(q.validate(c, "connection").select("from_id", "to_id", "errors", "warnings"), "errors", "warnings")


@query("q03_duplicate_keys", """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS occurrence FROM lineitem QUALIFY occurrence>1""")
def _(t):
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")]
    return q.duplicate_keys(t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_partkey", "l_suppkey"], order)


@query("q04_component_rules", """SELECT id, concat_ws('; ', CASE WHEN (type='battery' AND voltage_rating NOT BETWEEN 6 AND 48) OR (type IN ('ecu','sensor') AND voltage_rating NOT BETWEEN 3.3 AND 24) OR (type='relay' AND voltage_rating NOT BETWEEN 5 AND 48) THEN 'voltage rating out of range for type' END,
CASE WHEN (type='fuse' AND current_rating NOT BETWEEN 0.1 AND 200) OR (type='relay' AND current_rating NOT BETWEEN 0.01 AND 100) OR (type='ecu' AND current_rating NOT BETWEEN 0.1 AND 20) OR (type='sensor' AND current_rating NOT BETWEEN 0.001 AND 5) THEN 'current rating out of range for type' END) AS errors FROM components""", "components")
def _(t):
    return joined(q.component_rules(t.components).select("id", "errors"), "errors")


@query("q05_circuit_rules", """SELECT id, concat_ws('; ', CASE WHEN (circuit_type='power' AND voltage NOT BETWEEN 6 AND 48) OR (circuit_type='ignition' AND voltage NOT BETWEEN 12 AND 48) OR (circuit_type='lighting' AND voltage NOT BETWEEN 12 AND 24) THEN 'voltage out of range for circuit type' END,
CASE WHEN protection='fuse' AND 1000<max_current*0.8 THEN 'fuse rating below 80% of maximum current' END, CASE WHEN max_current>20 THEN 'wire too thin for maximum current' END, CASE WHEN safety_critical THEN 'safety-critical circuit without redundancy or fail-safe mode' END) AS errors FROM circuits""", "circuits")
def _(t):
    c = t.circuits.withColumns({"protection_rating": F.lit("1000A"), "wire_gauge": F.lit("2.5mm²")})
    return joined(q.circuit_rules(c).select("id", "errors"), "errors")


@query("q06_batch_rules", """SELECT vehicle_signature, sources, power, earth, levels, concat_ws('; ', CASE WHEN sources=0 THEN 'no power source' END, 'no ground component', CASE WHEN power=0 THEN 'no power circuit' END, CASE WHEN earth=0 THEN 'no ground circuit' END, CASE WHEN levels>3 THEN 'more than 3 voltage levels' END) AS errors
FROM (SELECT vehicle_signature, count(*) FILTER (type='battery') AS sources FROM components GROUP BY 1) a JOIN (SELECT vehicle_signature, count(*) FILTER (circuit_type='power') AS power, count(*) FILTER (circuit_type='ground') AS earth, count(DISTINCT voltage) FILTER (circuit_type='power') AS levels FROM circuits GROUP BY 1) b USING (vehicle_signature)""", ("components", "circuits"))
def _(t):
    return joined(q.batch_rules(t.components, t.circuits), "errors").select("vehicle_signature", "sources", "power", "earth", "levels", "errors")


@query("q07_validate_vehicles", """WITH b AS (SELECT vehicle_signature, count(*) AS total, count(*) FILTER (x IS NULL) AS np, count(*) FILTER (zone IS NULL) AS nz, count(*) FILTER (id NOT IN (SELECT src FROM connects_to) AND id NOT IN (SELECT dst FROM connects_to)) AS o FROM components GROUP BY 1), u AS (SELECT vehicle_signature, count(*) FILTER (protection IS NULL OR protection='none') AS u FROM circuits GROUP BY 1)
SELECT vehicle_signature, u=0 AS is_valid, concat_ws('; ', CASE WHEN u>0 THEN concat(u,' circuits lack proper protection devices') END) AS issues, concat_ws('; ', CASE WHEN o>0 THEN concat('Found ',o,' orphaned components with no connections') END, CASE WHEN np>0 THEN printf('%d components (%.1f%%) missing position data', np, np/total*100) END, CASE WHEN nz>0 THEN printf('%d components (%.1f%%) missing zone assignment', nz, nz/total*100) END) AS warnings,
concat_ws('; ', CASE WHEN o>0 THEN 'Review isolated components and establish proper connections' END) AS recommendations FROM b JOIN u USING (vehicle_signature)""", ("components", "circuits", "connects_to"))
def _(t):
    df = q.validate_vehicles(t.vehicles, t.components, t.circuits, t.edges.filter("rel_type = 'CONNECTS_TO'"))
    return joined(df, "issues", "warnings", "recommendations")


@query("q08_dry_run", """SELECT 'components' AS kind, count(*) AS total, count(*) FILTER (NOT bad) AS valid, count(*) FILTER (bad) AS invalid, 0::BIGINT AS with_warnings FROM (SELECT coalesce((type='battery' AND voltage_rating NOT BETWEEN 6 AND 48) OR (type IN ('ecu','sensor') AND voltage_rating NOT BETWEEN 3.3 AND 24) OR (type='relay' AND voltage_rating NOT BETWEEN 5 AND 48), false) OR coalesce(type='sensor' AND current_rating>5, false) AS bad FROM components) q
UNION ALL SELECT 'circuits', count(*), count(*), 0, count(*) FILTER (max_current>500) FROM circuits""", ("components", "circuits"))
def _(t):
    return q.dry_run({"components": q.component_rules(t.components), "circuits": q.validate(t.circuits.drop("name").withColumn("name", F.lit("n")), "circuit")})


def typed(t):
    """Components with pins and systems, and a description of each type made from them."""
    pins = F.when(F.col("type") == "ecu", F.array(F.lit("vcc"), F.lit("io"))).when(F.col("type") == "relay", F.array(F.lit("85"), F.lit("86"))).otherwise(F.array(F.lit("1"), F.lit("gnd")))
    comp = t.components.select("id", "vehicle_signature", "type", F.col("zone").alias("system"), F.col("part_number").alias("value"), pins.alias("pins"))
    dim = t.components.filter("type <> 'connector'").groupBy("type").agg(F.lit(5).alias("pin_count"), F.array_sort(F.collect_set("zone")).alias("systems")).withColumns(
        {"roles": F.array(F.lit("power"), F.lit("ground")), "values": F.array(F.lit("PN1"))})
    return comp, dim


@query("q09_check_against_knowledge", """SELECT id, type, concat_ws('; ', CASE WHEN type='connector' THEN 'Unknown component type' ELSE 'Pin count mismatch' END, CASE WHEN type='connector' THEN NULL ELSE 'Missing critical pin roles' END) AS issues FROM components""", "components")
def _(t):
    return joined(q.check_against_knowledge(*typed(t)), "issues")


@query("q10_missing_connections", """WITH f AS (SELECT DISTINCT vehicle_signature, coalesce(zone,'') AS z FROM components WHERE type='fuse') SELECT c.vehicle_signature, id, 'may need fuse protection' AS suggestion FROM components c WHERE type='relay' AND NOT EXISTS (SELECT 1 FROM f WHERE f.vehicle_signature=c.vehicle_signature AND f.z=coalesce(c.zone,''))
UNION ALL SELECT vehicle_signature, id, 'missing ground connections' FROM components WHERE type='ecu' UNION ALL SELECT vehicle_signature, NULL, 'Power nets found but no ground nets - check ground distribution' FROM circuits WHERE circuit_type='power' GROUP BY 1""", ("components", "circuits"))
def _(t):
    nets = t.circuits.filter("circuit_type = 'power'").select("vehicle_signature", F.lit("VCC main").alias("name"))
    return q.missing_connections(typed(t)[0], nets)


@query("q11_infer_properties", "SELECT id, coalesce(c.zone, d.sys) AS system, CASE WHEN type='connector' THEN 'a:,b:x' ELSE 'a:power,b:x' END AS pins FROM components c LEFT JOIN (SELECT type, min(zone) AS sys FROM components WHERE type<>'connector' GROUP BY 1) d USING (type)", "components")
def _(t):
    comp, dim = typed(t)
    pins = F.array(F.struct(F.lit("a").alias("name"), F.lit(None).cast("string").alias("role")), F.struct(F.lit("b").alias("name"), F.lit("x").alias("role")))
    df = q.infer_properties(comp.withColumn("pins", pins), dim)
    return df.select("id", "system", F.array_join(F.transform("pins", lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["role"], F.lit("")))), ",").alias("pins"))


@query("q12_check_relationships", "SELECT src, dst, rel_type, rel_type<>'CONTROLS' AS is_valid FROM edges", "edges")
def _(t):
    return q.check_relationships(t.edges, ["CONNECTS_TO", "POWERED_BY"]).select("src", "dst", "rel_type", "is_valid")


# ---- behaviour -------------------------------------------------------------------------------

GAP = 6 * 3600
SESSIONS = """s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM interactions) q)"""


@query("b01_session_analysis", f"""WITH {SESSIONS}, k AS (SELECT user_id, session, interaction_type, count(*) AS c, count(*) FILTER (NOT success) AS bad FROM s GROUP BY 1,2,3), w AS (SELECT user_id, session, string_agg(concat(interaction_type,':',c), ',' ORDER BY concat(interaction_type,':',c)) AS breakdown, string_agg(concat('improve_',interaction_type,'_skills'), '; ' ORDER BY interaction_type) FILTER (bad>2) AS weak FROM k GROUP BY 1,2),
b AS (SELECT user_id, session, min(ts) AS start_time, max(ts) AS end_time, count(*) AS total, count(*) FILTER (success) AS ok, count(*) FILTER (interaction_type='undo_redo') AS undo, count(*) FILTER (interaction_type IN ('layout_approval','save_project')) AS done, count(*) FILTER (interaction_type='layout_approval') AS ap, count(*) FILTER (interaction_type='save_project') AS sv FROM s GROUP BY 1,2)
SELECT b.user_id, b.session::BIGINT AS session, start_time, end_time, total AS total_interactions, breakdown, round(greatest(0,least(1,ok/total-least(undo/total,0.5))),8) AS efficiency_score, CASE WHEN done>0 THEN 1.0 WHEN total>10 THEN 0.5 ELSE 0 END::DOUBLE AS task_completion_rate, round(1-ok/total,8) AS error_rate,
concat_ws('; ', CASE WHEN ap>0 THEN 'layout_approved' END, CASE WHEN sv>0 THEN 'project_saved' END, CASE WHEN undo/total<0.1 THEN 'smooth_workflow' END) AS satisfaction_indicators, coalesce(weak,'') AS learning_opportunities FROM b JOIN w USING (user_id, session)""", "interactions")
def _(t):
    return joined(rd(bh.session_analysis(t.interactions, GAP), 8, "efficiency_score", "error_rate"), "satisfaction_indicators", "learning_opportunities")


@query("b02_temporal_patterns", """WITH c AS (SELECT user_id, 'hour' AS "by", hour(ts)::INTEGER AS value, count(*) AS n FROM interactions GROUP BY 1,3 UNION ALL SELECT user_id, 'weekday', (isodow(ts)-1)::INTEGER, count(*) FROM interactions GROUP BY 1,3)
SELECT user_id, "by", value, n, row_number() OVER (PARTITION BY user_id, "by" ORDER BY n DESC, value)=1 AS is_peak FROM c""", "interactions")
def _(t):
    return bh.temporal_patterns(t.interactions)


@query("b03_error_patterns", """WITH i AS (SELECT user_id, success, sum(CAST(success AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM interactions), r AS (SELECT user_id, island, count(*) FILTER (NOT success) AS len FROM i GROUP BY 1,2), st AS (SELECT user_id, count(*) FILTER (len>1) AS error_sequences, max(len) AS max_streak FROM r GROUP BY 1)
SELECT user_id, count(*) AS total, count(*) FILTER (NOT success) AS errors, count(DISTINCT interaction_type) FILTER (NOT success) AS error_types, count(*) FILTER (interaction_type='undo_redo')>count(*)*0.15 AS high_undo_rate, round(count(*) FILTER (NOT success)/count(*),8) AS error_rate, max(error_sequences) AS error_sequences, max(max_streak) AS max_streak FROM interactions JOIN st USING (user_id) GROUP BY 1""", "interactions")
def _(t):
    return rd(bh.error_patterns(t.interactions), 8, "error_rate")


@query("b04_efficiency_patterns", """SELECT user_id, interaction_type, count(*) AS n, round(avg(duration_ms),6) AS avg_duration_ms, round(count(*) FILTER (success)/count(*),8) AS success_rate, round(count(*) FILTER (success)/count(*)/(1+avg(duration_ms)/1000),8) AS efficiency, count(*) FILTER (success)/count(*)/(1+avg(duration_ms)/1000)<0.1 AS is_slow FROM interactions GROUP BY 1,2""", "interactions")
def _(t):
    return rd(rd(bh.efficiency_patterns(t.interactions), 8, "success_rate", "efficiency"), 6, "avg_duration_ms")


@query("b05_preference_patterns", "SELECT user_id, CASE WHEN count(*) FILTER (interaction_type='view_change')>0 THEN count(*) FILTER (interaction_type='view_change')>count(*)*0.1 END AS frequent_view_changes, NULL::BOOLEAN AS prefers_manual_control FROM interactions GROUP BY 1", "interactions")
def _(t):
    return bh.preference_patterns(t.interactions)


@query("b06_usability_issues", f"""WITH recent AS (SELECT * FROM interactions WHERE ts>TIMESTAMP '2024-01-28' - INTERVAL 480 HOUR AND ts<=TIMESTAMP '2024-01-28'), tot AS (SELECT count(*) AS total, count(*) FILTER (interaction_type='undo_redo') AS undo, count(DISTINCT interaction_type) AS used FROM recent),
{SESSIONS.replace('FROM interactions', 'FROM recent')}, d AS (SELECT (epoch_us(max(ts))-epoch_us(min(ts)))/60e6 AS m FROM s GROUP BY user_id, session)
SELECT 'high_error_rate' AS issue, interaction_type AS feature, round(count(*) FILTER (NOT success)/max(total),8) AS value, CASE WHEN count(*) FILTER (NOT success)/max(total)>0.3 THEN 'high' ELSE 'medium' END AS severity FROM recent, tot GROUP BY 2 HAVING count(*) FILTER (NOT success)/max(total)>0.1
UNION ALL SELECT 'high_undo_rate', NULL, round(undo/total,8), 'medium' FROM tot WHERE undo/total>0.15 UNION ALL SELECT 'long_task_completion', NULL, round(avg(m),8), 'medium' FROM d WHERE m>1 HAVING avg(m)>30 UNION ALL SELECT 'feature_abandonment', NULL, KINDS-used, 'low' FROM tot WHERE KINDS-used>KINDS*0.3""".replace("KINDS", str(len(bh.INTERACTION_TYPES))), "interactions")
def _(t):
    return rd(bh.usability_issues(t.interactions, F.lit("2024-01-28").cast("timestamp_ntz"), 480, gap_seconds=GAP), 8, "value")


@query("b07_user_profiles", """SELECT user_id, count(*) AS total, count(DISTINCT target_object_id) AS components_used, max(ts) AS last_updated, CASE WHEN count(*)>300 THEN 'expert' WHEN count(*)>100 THEN 'intermediate' ELSE 'novice' END AS experience_level, CASE WHEN count(*) FILTER (NOT success)>0 THEN 'undo_redo_error' ELSE '' END AS error_patterns FROM interactions GROUP BY 1""", "interactions")
def _(t):
    return joined(bh.user_profiles(t.interactions), "error_patterns")


@query("b08_feedback_preferences", """SELECT c_custkey AS user_id, CASE WHEN c_acctbal>5000 THEN 'prefer_routing' ELSE 'avoid_'||i END AS preference, CASE WHEN c_acctbal>5000 THEN NULL WHEN contains(i,'routing') THEN 'layout' WHEN contains(i,'slow') THEN 'performance' ELSE 'ui' END AS category, count(*) AS n
FROM (SELECT c_custkey, c_acctbal, unnest(['good_routing', lower(c_mktsegment), 'slow_zoom']) AS i FROM customer) q WHERE c_acctbal<=5000 OR i LIKE 'good_%' GROUP BY 1,2,3""")
def _(t):
    f = t.customer.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") > 5000, "positive").otherwise("negative").alias("feedback_type"), F.array(F.lit("good_routing"), F.lower("c_mktsegment"), F.lit("slow_zoom")).alias("issues"))
    return bh.feedback_preferences(f)


@query("b09_user_recommendations", """WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (interaction_type='undo_redo')>count(*)*0.15 AS undo FROM interactions GROUP BY 1), e AS (SELECT user_id, count(*) FILTER (success)/count(*)/(1+avg(duration_ms)/1000)<0.1 AS slow FROM interactions WHERE interaction_type='component_selection' GROUP BY 1)
SELECT user_id, CASE WHEN n>300 THEN 'expert' WHEN n>100 THEN 'intermediate' ELSE 'novice' END AS experience_level, CASE WHEN n<=100 THEN 'Enable guided tutorials for complex tasks; Show tooltips for advanced features; Highlight recommended actions' ELSE '' END AS ui_improvements, CASE WHEN undo THEN 'Implement smart undo with preview' ELSE '' END AS workflow_optimizations,
CASE WHEN coalesce(slow,false) THEN 'Quick component search and favorites' ELSE '' END AS feature_suggestions, '' AS learning_resources FROM u LEFT JOIN e USING (user_id)""", "interactions")
def _(t):
    df = bh.user_recommendations(bh.user_profiles(t.interactions), bh.error_patterns(t.interactions), bh.efficiency_patterns(t.interactions))
    return joined(df, "ui_improvements", "workflow_optimizations", "feature_suggestions", "learning_resources")


FAR = " + ".join(f"(a.f{k} - b.f{k}) * (a.f{k} - b.f{k})" for k in range(5))


@query("b10_cluster_density", f"""WITH RECURSIVE raw AS (SELECT event_id, (CAST('0x' || substr(md5(interaction_type), 1, 4) AS BIGINT) % 1000)::DOUBLE AS r0, duration_ms::DOUBLE AS r1, success::INT::DOUBLE AS r2, hour(ts)::DOUBLE AS r3, (isodow(ts) - 1)::DOUBLE AS r4 FROM interactions),
st AS (SELECT {", ".join(f"avg(r{k}) AS m{k}, stddev_pop(r{k}) AS s{k}" for k in range(5))} FROM raw),
p AS (SELECT event_id, {", ".join(f"coalesce((r{k} - m{k}) / nullif(s{k}, 0), 0) AS f{k}" for k in range(5))} FROM raw, st),
e AS (SELECT a.event_id AS a, b.event_id AS b FROM p a JOIN p b ON {FAR} <= 0.25),
core AS (SELECT a AS id FROM e GROUP BY 1 HAVING count(*) >= 5),
ce AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM core UNION SELECT ce.b, min(cc.comp) FROM cc JOIN ce ON ce.a = cc.id JOIN recurring.cc AS r ON r.id = ce.b WHERE cc.comp < r.comp GROUP BY 1),
near AS (SELECT e.a AS id, min(comp) AS comp FROM e JOIN cc ON cc.id = e.b WHERE e.a NOT IN (SELECT id FROM core) GROUP BY 1)
SELECT event_id, coalesce(cc.comp, near.comp, -1) AS cluster, CASE WHEN cc.comp IS NOT NULL THEN 'core' WHEN near.comp IS NOT NULL THEN 'border' ELSE 'noise' END AS kind FROM p LEFT JOIN cc ON cc.id = event_id LEFT JOIN near ON near.id = event_id""", "interactions")
def _(t):
    return bh.cluster_interactions(t.interactions, "density")


@query("b10_cluster_kmeans")
def _(t):
    return bh.cluster_interactions(t.interactions, "kmeans")


@query("b11_search_quality", """WITH s AS (SELECT user_id AS search_id, count(*) AS results, count(*) FILTER (event_type='click') AS clicks, sum(event_id % 20) FILTER (event_type='click') AS ps, sum(value) FILTER (event_type='click') AS ds FROM events GROUP BY 1),
m AS (SELECT search_id, clicks/results AS ctr, coalesce(ps,0)/greatest(clicks,1) AS pos, coalesce(ds,0)/greatest(clicks,1) AS dwell FROM s), k AS (SELECT *, (ctr<0.1)::INT+(pos>5)::INT+(dwell<2)::INT AS n FROM m) SELECT search_id, round(ctr,8) AS click_through_rate, round(pos,8) AS avg_clicked_position, round(dwell,8) AS avg_dwell_time, round(n/3,8) AS confidence, CASE WHEN n>=2 THEN 'medium' ELSE 'low' END AS severity FROM k WHERE n>0""")
def _(t):
    click = F.col("event_type") == "click"
    s = t.events.groupBy(F.col("user_id").alias("search_id")).agg(F.count(F.lit(1)).alias("results"), F.count(F.when(click, 1)).alias("clicks"), F.coalesce(F.sum(F.when(click, F.col("event_id") % 20)), F.lit(0)).alias("position_sum"), F.coalesce(F.sum(F.when(click, F.col("value"))), F.lit(0.0)).alias("dwell_sum"))
    df = schematic.search_signals(s).drop("results", "clicks", "position_sum", "dwell_sum")
    return rd(df, 8, "click_through_rate", "avg_clicked_position", "avg_dwell_time", "confidence")


@query("b12_search_analytics", """WITH s AS (SELECT event_id, ts, concat('q', user_id % 37) AS query, concat('P', event_id % 50) AS component, event_type AS vehicle, CASE WHEN event_type='error' THEN 0 ELSE user_id % 9 END AS results, value AS latency FROM events WHERE ts>=TIMESTAMP '2024-01-05' AND ts<TIMESTAMP '2024-01-25'),
p AS (SELECT 'popular_query' AS figure, query AS key, count(*)::DOUBLE AS value FROM s GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, query)<=10), c AS (SELECT 'popular_component' AS figure, component AS key, count(*)::DOUBLE AS value FROM s GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, component)<=10), v AS (SELECT 'popular_vehicle' AS figure, vehicle AS key, count(*)::DOUBLE AS value FROM s GROUP BY 2)
SELECT figure, key, round(value,8) AS value FROM (SELECT * FROM p UNION ALL SELECT * FROM c UNION ALL SELECT * FROM v UNION ALL SELECT 'total_searches', NULL, count(*) FROM s UNION ALL SELECT 'unique_queries', NULL, count(DISTINCT query) FROM s UNION ALL SELECT 'avg_response_time', NULL, avg(latency) FROM s UNION ALL SELECT 'success_rate', NULL, count(*) FILTER (results>0)/count(*) FROM s
UNION ALL SELECT 'avg_results', NULL, avg(results) FROM s UNION ALL SELECT 'trend_volume', strftime(ts,'%Y-%m-%d %H'), count(*) FROM s GROUP BY 2 UNION ALL SELECT 'trend_response_time', strftime(ts,'%Y-%m-%d %H'), avg(latency) FROM s GROUP BY 2) z""")
def _(t):
    s = t.events.selectExpr("event_id AS search_id", "ts", "concat('q', user_id % 37) AS query", "concat('P', event_id % 50) AS component", "event_type AS vehicle", "CASE WHEN event_type = 'error' THEN 0 ELSE user_id % 9 END AS results", "value AS latency")
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return rd(bh.search_analytics(s, at("2024-01-05"), at("2024-01-25")), 8, "value")
