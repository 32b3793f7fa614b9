"""Queries for search, recommendations (V ids) and layouts (X-05..X-11)."""

from pyspark.sql import functions as F

from wirelake.functions import text as tx
from wirelake.operators import ivfpq, layout, ranking
from wirelake.operators import search as op
from wirelake.plans.registry import query
from wirelake.session import cut


def rd(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def vectors(t):
    return t.embeddings


def queries_of(t):
    return t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")


SIM = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, a.label AS la, b.label, round(list_cosine_similarity(a.v, b.v),6) AS score FROM e a, e b)"


@query("v01_cosine_topk", f"WITH {SIM} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score>=0.1 AND label<>3 QUALIFY rank<=10")
def _(t):
    return op.cosine_topk(queries_of(t), vectors(t), 10, 0.1, [op.Filter("label", "ne", 3)])


@query("v02_ann_topk")
def _(t):
    return ivfpq.ivf_topk(queries_of(t), vectors(t), 10, probe=0.6, refine=100)


@query("v02_ann_recall", "SELECT count(*) AS queries, true AS reached FROM embeddings")
def _(t):
    exact = cut(op.cosine_topk(queries_of(t), vectors(t), 10))
    found = ivfpq.recall(ivfpq.ivf_topk(queries_of(t), vectors(t), 10, probe=0.6, refine=100), exact)
    return found.select("queries", (F.col("recall") >= 0.9).alias("reached"))


@query("v03_similar_items", f"WITH {SIM} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE la=label AND query_id<>vec_id QUALIFY rank<=5")
def _(t):
    return op.similar_items(vectors(t), vectors(t), 5, "label")


@query("v04_multi_collection_topk", f"WITH {SIM} SELECT query_id, label, vec_id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank<=2")
def _(t):
    return op.multi_collection_topk(queries_of(t), vectors(t), 2, "label")


def questions(t):
    """The benchmark texts as questions: their words without punctuation."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.array_join(op.terms_of(F.col("text")), " ").alias("text"))


IDX = r"""idx AS (SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text),'[\p{L}\p{N}]+')) AS w FROM documents) d GROUP BY 1,2),
ask AS (SELECT DISTINCT item_id AS query_id, w AS asked FROM (SELECT item_id, unnest(regexp_extract_all(lower(text),'[\p{L}\p{N}]+')) AS w FROM benchmark) b)"""


@query("v05_sparse_search", f"""WITH {IDX}, df AS (SELECT term, count(*) AS df FROM idx GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS total FROM idx), need AS (SELECT query_id, count(*) AS need FROM ask GROUP BY 1),
h AS (SELECT query_id, doc_id, count(DISTINCT asked) AS have, round(sum(tf*ln(1+total/df)),6) AS score FROM ask JOIN df ON starts_with(df.term, ask.asked) JOIN idx USING (term), n GROUP BY 1,2)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h JOIN need USING (query_id) WHERE have=need QUALIFY rank<=10""")
def _(t):
    return op.sparse_search(questions(t), op.inverted_index(t.documents, "doc_id", "text"), 10)


@query("v06_keyword_score", r"""WITH ask AS (SELECT DISTINCT item_id AS query_id, w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text),'[\p{L}\p{N}]+')) AS w FROM benchmark) b), n AS (SELECT query_id, count(*) AS n FROM ask GROUP BY 1)
SELECT query_id, doc_id, round(count(*)/max(n),8) AS score FROM ask JOIN (SELECT doc_id, lower(text) AS t FROM documents) d ON contains(d.t, ask.w) JOIN n USING (query_id) GROUP BY 1,2""")
def _(t):
    return rd(op.keyword_score(questions(t), t.documents, "doc_id", "text"), 8, "score")


HITS = "den AS (SELECT user_id AS query_id, event_id % 400 AS doc_id, max(value)/200 AS score FROM events WHERE event_type='click' GROUP BY 1,2), spa AS (SELECT user_id AS query_id, event_id % 400 AS doc_id, max(value)/300 AS score FROM events WHERE event_type='view' GROUP BY 1,2)"


def hits(t, kind, by):
    return t.events.filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("query_id"), (F.col("event_id") % 400).alias("doc_id")).agg((F.max("value") / by).alias("score"))


@query("v07_hybrid_fuse", f"WITH {HITS} SELECT query_id, doc_id, round(coalesce(d.score,0)*0.6+coalesce(s.score,0)*0.4,8) AS score, CASE WHEN d.score IS NOT NULL AND s.score IS NOT NULL THEN 'hybrid' WHEN d.score IS NOT NULL THEN 'dense' ELSE 'sparse' END AS source FROM den d FULL JOIN spa s USING (query_id, doc_id)")
def _(t):
    return rd(op.hybrid_fuse(hits(t, "click", 200), hits(t, "view", 300)), 8, "score")


@query("v08_boost_rerank", """WITH h AS (SELECT l_orderkey AS query_id, concat('relay fuse P', l_suppkey) AS query, l_partkey AS doc_id, CASE WHEN l_returnflag='A' THEN 'the relay' ELSE 'some FUSE and relay' END AS text, l_discount AS score, concat('p', l_suppkey) AS cid, l_quantity, l_extendedprice FROM lineitem),
d AS (SELECT query_id, query, doc_id, text, max(score) AS score, any_value(cid) AS cid FROM h GROUP BY 1,2,3,4), c AS (SELECT query_id, count(*) AS c FROM d GROUP BY 1), b AS (SELECT d.*, CASE WHEN c>3 THEN CASE WHEN contains(text,'FUSE') THEN 1.44::DOUBLE ELSE 1.2::DOUBLE END*1.5 ELSE 1.0::DOUBLE END AS boost FROM d JOIN c USING (query_id))
SELECT query_id, doc_id, score AS original_score, round(boost,8) AS boost, round(score*boost,6) AS score FROM b""")
def _(t):
    h = t.lineitem.selectExpr("l_orderkey AS query_id", "concat('relay fuse P', l_suppkey) AS query", "l_partkey AS doc_id", "CASE WHEN l_returnflag = 'A' THEN 'the relay' ELSE 'some FUSE and relay' END AS text", "l_discount AS score", "array(concat('p', l_suppkey)) AS component_ids")
    one = h.groupBy("query_id", "query", "doc_id", "text").agg(F.max("score").alias("score"), F.min("component_ids").alias("component_ids")).withColumn("net_names", F.array().cast("array<string>"))
    return rd(op.boost_rerank(one, 1000, min_hits=3).drop("rank"), 8, "boost")


@query("v09_boost_results", "SELECT id, round(current_rating/20*CASE WHEN type IN ('relay','fuse') THEN 2.0 ELSE 1 END*CASE WHEN vehicle_signature='V2' THEN 1.2 ELSE 1 END,8)::DOUBLE AS score FROM components", "components")
def _(t):
    c = t.components.select("id", (F.col("current_rating") / 20).alias("score"), F.col("type").alias("component_type"), "vehicle_signature", F.array(F.lit("relay"), F.lit("fuse")).alias("component_types"), F.lit("V2").alias("asked_vehicle"))
    return rd(op.boost_results(c).select("id", "score"), 8, "score")


@query("v10_doc_rerank", "SELECT doc_id, round(least(1.0, n_chars/5000.0::DOUBLE*CASE lang WHEN 'en' THEN 1.2 WHEN 'fr' THEN 1.1 ELSE 1 END),8)::DOUBLE AS score FROM documents")
def _(t):
    h = t.documents.select("doc_id", (F.col("n_chars") / F.lit(5000.0)).alias("score"), F.when(F.col("lang") == "en", "troubleshooting").when(F.col("lang") == "fr", "repair_guide").otherwise("manual").alias("document_type"),
                           F.when(F.col("lang") == "en", "Troubleshoot it").otherwise("how to repair").alias("query"))
    return rd(op.doc_rerank(h).select("doc_id", "score"), 8, "score")


@query("v11_search_documents", f"WITH {SIM} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE label IN (1,2,4,6,8) QUALIFY rank<=3")
def _(t):
    chunks = t.embeddings.select("vec_id", "embedding", F.when(F.col("label") % 2 == 0, "manual").when(F.col("label") == 1, "manual").otherwise("other").alias("document_type"),
                                 F.array(F.concat(F.lit("m"), "label")).alias("vehicle_models"))
    return op.search_documents(queries_of(t), chunks, 3, document_types=["manual"], models=["m1", "m2", "m4", "m6", "m8"])


@query("v12_search_components", r"""WITH idx AS (SELECT id AS doc_id, w AS term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', name, type, manufacturer, part_number)),'[\p{L}\p{N}]+')) AS w FROM components) d GROUP BY 1,2),
ask AS (SELECT DISTINCT id AS query_id, w AS asked FROM (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', type, part_number)),'[\p{L}\p{N}]+')) AS w FROM components) b), df AS (SELECT term, count(*) AS df FROM idx GROUP BY 1),
n AS (SELECT count(DISTINCT doc_id) AS total FROM idx), need AS (SELECT query_id, count(*) AS need FROM ask GROUP BY 1), met AS (SELECT DISTINCT a.asked, df.term, df.df FROM (SELECT DISTINCT asked FROM ask) a JOIN df ON starts_with(df.term, a.asked)),
h AS (SELECT query_id, doc_id, count(DISTINCT asked) AS have, round(sum(tf*ln(1+total/df)),6) AS score FROM ask JOIN met USING (asked) JOIN idx USING (term), n GROUP BY 1,2)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h JOIN need USING (query_id) WHERE have=need QUALIFY rank<=3""", "components")
def _(t):
    asks = t.components.select(F.col("id").alias("query_id"), F.concat_ws(" ", "type", "part_number").alias("text"))
    return op.search_components(asks, t.components, 3)


@query("v13_chat_context")
def _(t):
    asks = t.embeddings.join(t.asked.select(F.regexp_extract("id", r"^P(\d+)$", 1).try_cast("bigint").alias("vec_id"), "text"), "vec_id").select(F.col("vec_id").alias("query_id"), "text", "embedding")
    return op.chat_context(asks, t.embeddings.filter("label < 5"), t.embeddings.filter("label >= 5"))


def items(t):
    """Components that have a vector."""
    c = t.components.select(F.substring("id", 2, 20).cast("bigint").alias("vec_id"), "vehicle_signature", "type", "zone", "manufacturer", "voltage_rating", "current_rating", F.col("name").alias("function"))
    circuit = t.part_of.groupBy(F.substring("src", 2, 20).cast("bigint").alias("vec_id")).agg(F.min("dst").alias("circuit"))
    return t.embeddings.join(c, "vec_id").join(circuit, "vec_id", "left").withColumns({"subsystem": F.col("zone"), "categories": F.array("type", "manufacturer")}).drop("label")


KINDS = ["similar", "compatible", "alternative", "related"]


@query("v14_recommend", f"""WITH {SIM}, it AS (SELECT CAST(substr(id,2) AS BIGINT) AS vec_id, * FROM components), p AS (SELECT s.query_id AS id, s.vec_id AS candidate_id, s.score, a.vehicle_signature va, b.vehicle_signature vb, a.voltage_rating v, b.voltage_rating w, a.type ta, b.type tb, a.zone za, b.zone zb, a.manufacturer ma, b.manufacturer mb FROM s JOIN it a ON a.vec_id=s.query_id JOIN it b ON b.vec_id=s.vec_id WHERE s.query_id<>s.vec_id)
SELECT id, candidate_id, 'similar' AS kind, ma=mb AS same_maker FROM (SELECT * FROM p WHERE score>=0.1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate_id)<=3) q
UNION ALL SELECT id, candidate_id, 'compatible', ma=mb FROM (SELECT * FROM p WHERE score>=0.08 AND va=vb AND (v IS NULL OR abs(w-v)<=abs(v)*0.2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate_id)<=3) q
UNION ALL SELECT id, candidate_id, 'alternative', ma=mb FROM (SELECT * FROM p WHERE score>=0.07 AND ta=tb AND za=zb AND ma<>mb QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate_id)<=3) q
UNION ALL SELECT id, candidate_id, 'related', ma=mb FROM (SELECT * FROM p WHERE score>=0.06 AND va=vb QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate_id)<=3) q""", "components")
def _(t):
    return op.recommend(items(t), KINDS, 3, 0.1).drop("score")


@query("v15_rank_recommendations")
def _(t):
    return op.rank_recommendations(op.recommend(items(t), KINDS, 3, 0.1))


@query("v16_search_knowledge", f"WITH {SIM} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE label=7 QUALIFY rank<=4")
def _(t):
    posts = t.embeddings.withColumn("make", F.concat(F.lit("make"), "label"))
    return op.search_knowledge(queries_of(t), posts, 4, "make7")


@query("v17_embed_missing", "SELECT doc_id AS id, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    cache = t.benchmark.select(F.md5("text").alias("hash"), tx.hash_embedding(F.col("text"), 16).alias("embedding")).dropDuplicates(["hash"])
    return op.embed_missing(texts, cache, 16).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


# ---- layouts ---------------------------------------------------------------------------------

SPACE = (1400.0, 900.0, 1200.0)


def placed(t):
    """Two candidate layouts per vehicle: the given places and the same drawn together."""
    c = layout.with_physical_defaults(t.components.filter("x IS NOT NULL")).withColumns({"voltage": F.coalesce("voltage_rating", F.lit(0.0)) * 4, "maintenance": F.when(F.col("type") == "fuse", 1).otherwise(0)})
    both = F.explode(F.array(F.struct(F.lit("a").alias("n"), F.lit(1.0).alias("f")), F.struct(F.lit("b").alias("n"), F.lit(0.5).alias("f"))))
    out = c.withColumn("l", both).withColumn("layout_id", F.concat("l.n", "vehicle_signature"))
    return out.withColumns({a: F.col(a) * F.col("l.f") for a in "xyz"}).drop("l")


def laid_wires(t):
    lengths = layout.wire_lengths(placed(t), t.connects_to)
    return lengths.select("layout_id", F.concat_ws("-", "p", "q").alias("wire_id"), "length", F.lit(1.5).alias("gauge"), (F.col("length") / 100).alias("current"), F.lit(2).alias("bends"), (F.col("length") / 1000).alias("cost"))


@query("x05_layout_fitness")
def _(t):
    return layout.layout_fitness(placed(t), t.connects_to, SPACE)


SX = """b AS (SELECT concat('a', vehicle_signature) AS layout_id, id, x, y, z, coalesce(voltage_rating,0)*4 AS v FROM components WHERE x IS NOT NULL UNION ALL SELECT concat('b', vehicle_signature), id, x*0.5, y*0.5, z*0.5, coalesce(voltage_rating,0)*4 FROM components WHERE x IS NOT NULL),
c AS (SELECT a.layout_id, count(*) AS n FROM b a JOIN b c ON a.layout_id=c.layout_id AND a.id<c.id WHERE sqrt((a.x-c.x)**2+(a.y-c.y)**2+(a.z-c.z)**2)<50 AND greatest(a.v,c.v)>60 GROUP BY 1),
w AS (SELECT a.layout_id, sqrt((a.x-c.x)**2+(a.y-c.y)**2+(a.z-c.z)**2) AS len FROM (SELECT DISTINCT least(src,dst) AS p, greatest(src,dst) AS q FROM connects_to) e JOIN b a ON a.id=e.p JOIN b c ON c.id=e.q AND c.layout_id=a.layout_id)"""


@query("x06_layout_violations", f"""WITH {SX} SELECT l.layout_id, coalesce(c.n,0) AS clearance_violations, coalesce(d.n,0) AS density_violations, CAST(coalesce(d.a>500,false) AS INTEGER) AS length_violations FROM (SELECT DISTINCT layout_id FROM b) l LEFT JOIN c USING (layout_id) LEFT JOIN (SELECT layout_id, count(*) FILTER (len/100/(pi()*1.5*1.5/4)>5) AS n, avg(len) AS a FROM w GROUP BY 1) d USING (layout_id)""", ("components", "connects_to"))
def _(t):
    return layout.layout_scores(placed(t), laid_wires(t)).select("layout_id", "clearance_violations", "density_violations", "length_violations")


@query("x06_layout_scores")
def _(t):
    return layout.layout_scores(placed(t), laid_wires(t))


@query("x07_layout_total")
def _(t):
    df = layout.layout_total(layout.layout_scores(placed(t), laid_wires(t)))
    return df.withColumn("recommendations", F.array_join("recommendations", "; "))


@query("x08_compare_layouts")
def _(t):
    return layout.compare_layouts(layout.layout_total(layout.layout_scores(placed(t), laid_wires(t))))


@query("x10_with_physical_defaults", "SELECT id, CASE type WHEN 'battery' THEN 240 WHEN 'relay' THEN 30 WHEN 'fuse' THEN 20 WHEN 'ecu' THEN 180 ELSE 40 END::DOUBLE AS dx, CASE WHEN type IN ('ecu','sensor') THEN 0.3 ELSE 0.1 END::DOUBLE AS emi FROM components", "components")
def _(t):
    return layout.with_physical_defaults(t.components).select("id", "dx", "emi")


ROUTE = "pts AS (SELECT l_orderkey AS wire_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, l_quantity AS x, l_discount*100 AS y, l_tax*100 AS z FROM lineitem)"


def way_points(t):
    ordered = ranking.number_rows(t.lineitem, "l_orderkey", [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")], "seq")
    return ordered.select(F.col("l_orderkey").alias("wire_id"), "seq", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))


@query("x11_route_metrics", f"""WITH {ROUTE}, st AS (SELECT wire_id, x-lag(x) OVER w AS px, y-lag(y) OVER w AS py, z-lag(z) OVER w AS pz FROM pts WINDOW w AS (PARTITION BY wire_id ORDER BY seq)) SELECT wire_id, round(coalesce(sum(sqrt(px*px+py*py+pz*pz)),0),6) AS total_length, round(coalesce(sum(sqrt(px*px+py*py+pz*pz)),0)*1.5,6)::DOUBLE AS total_cost FROM st GROUP BY 1""")
def _(t):
    pts = way_points(t)
    specs = pts.select("wire_id").distinct().withColumns({"cost_per_meter": F.lit(1.5), "min_bend_radius": F.lit(20.0)})
    return rd(layout.route_metrics(pts, specs), 6, "total_length", "total_cost").drop("bend_violations")


@query("x11_routing_summary")
def _(t):
    pts = way_points(t)
    specs = pts.select("wire_id").distinct().withColumns({"cost_per_meter": F.lit(1.5), "min_bend_radius": F.lit(20.0)})
    return layout.routing_summary(layout.route_metrics(pts, specs))
