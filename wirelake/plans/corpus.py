"""Queries for chunks, tiers and training samples (K ids, A-33, A-38)."""

from pyspark.sql import functions as F

from wirelake.functions import text as tx
from wirelake.operators import aggregates, chunking as op
from wirelake.plans.registry import query


@query("k01_chunk_words", """WITH w AS (SELECT doc_id, list(word ORDER BY pos) AS ws, count(*) AS n FROM words GROUP BY 1), s AS (SELECT doc_id, ws, n, unnest(range(0, n, 450)) AS st FROM w)
SELECT doc_id, CAST(st // 450 AS INTEGER) AS chunk, CAST(least(st+500, n)-st AS INTEGER) AS words, md5(array_to_string(ws[st+1:st+500], ' ')) AS h FROM s""", "words")
def _(t):
    return op.chunk_words(t.documents, "doc_id", "text").select("doc_id", "chunk", (F.col("end") - F.col("start")).alias("words"), F.md5("text").alias("h"))


@query("k02_chunk_document", """WITH w AS (SELECT doc_id, list(word ORDER BY pos) AS ws, count(*) AS n FROM words GROUP BY 1), s AS (SELECT doc_id, ws, n, unnest(range(0, n, 112)) AS st FROM w)
SELECT doc_id, CAST(st // 112 AS INTEGER) AS chunk, md5(concat(source, '. ', array_to_string(ws[st+1:st+128], ' '))) AS h, st // 300 + 1 AS page_number FROM s JOIN (SELECT doc_id, source FROM documents) d USING (doc_id)""", "words")
def _(t):
    return op.chunk_document(t.documents, "doc_id", "source", "text").select("doc_id", "chunk", F.md5("content").alias("h"), "page_number")


@query("k03_chunk_spans")
def _(t):
    spans = t.text_spans.filter("engine = 'tesseract'").select("doc_id", "engine", "pos", "text", "confidence", "x1", "y1", "x2", "y2")
    return op.chunk_spans(spans, ["doc_id"]).select("doc_id", "grp", "chunk", "span_count", "word_count", F.length("text").alias("chars"))


@query("k04_layout_chunks")
def _(t):
    return op.layout_chunks(t.text_spans.filter("engine = 'tesseract'"), ["doc_id"]).select("doc_id", "chunk", F.length("text").alias("chars"))


def pages(t):
    """Page records as an extraction step would leave them, made from the documents."""
    w = F.array_distinct(tx.words_of(F.col("text")))

    def pick(low, high):
        return F.filter(w, lambda v: (F.length(v) >= low) & (F.length(v) <= high))

    kind = F.when(F.col("lang") == "en", "lookup_table").when(F.col("lang") == "fr", "specifications").when(F.col("lang") == "de", "table_of_contents").otherwise("diagram")
    return t.documents.select(
        F.col("doc_id").alias("page"), kind.alias("page_type"), F.when(F.col("lang") == "es", 2).otherwise(4).alias("tier"),
        F.transform(pick(8, 8), lambda v: F.struct(v.alias("code"), F.upper(v).alias("meaning"))).alias("entries"),
        F.transform(pick(9, 9), lambda v: F.struct(v.alias("parameter"), F.lit("must be").alias("requirement"), F.reverse(v).alias("value"))).alias("specs"),
        pick(10, 10).alias("rules"), pick(11, 11).alias("warnings"), F.transform(pick(12, 99), lambda v: F.struct(v.alias("name"), F.length(v).alias("start_page"))).alias("sections"),
        F.split("text", "\n").alias("chunks"))


DW = "dw AS (SELECT DISTINCT doc_id, word, length(word) AS n, lang FROM words JOIN (SELECT doc_id, lang FROM documents) d USING (doc_id))"
TIERS = f"""{DW}, tiers AS (SELECT 'tier_1_metadata' AS tier, doc_id AS page FROM dw WHERE lang='en' AND n=8 UNION ALL SELECT 'tier_2_knowledge', doc_id FROM dw WHERE lang IN ('fr','es') AND n BETWEEN 9 AND 11
UNION ALL SELECT 'tier_3_structure', doc_id FROM dw WHERE lang='de' AND n BETWEEN 12 AND 99 UNION ALL SELECT 'tier_4_semantic', doc_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) u)"""


@query("k05_route_tiers", f"WITH {TIERS} SELECT tier, page, count(*) AS n FROM tiers GROUP BY 1,2", "words")
def _(t):
    out = None
    for name, df in op.route_tiers(pages(t)).items():
        part = df.groupBy("page").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tier"), "page", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("a33_tier_summary", f"WITH {TIERS}, p AS (SELECT tier, page, count(*) AS items FROM tiers GROUP BY 1,2) SELECT tier, sum(items)::BIGINT AS items, count(*) AS pages, max(items) AS max_items_on_page FROM p GROUP BY 1", "words")
def _(t):
    return aggregates.tier_summary(op.route_tiers(pages(t)))


@query("a38_page_summaries", """WITH e AS (SELECT l_orderkey AS page, l_linestatus='O' AS comp, CASE l_returnflag WHEN 'A' THEN 'VCC' WHEN 'N' THEN 'sig' ELSE 'gnd' END AS name, c.type FROM lineitem JOIN components c ON c.id=concat('P', l_partkey)),
s AS (SELECT page, count(*) FILTER (comp) AS components, count(*) FILTER (NOT comp) AS nets, string_agg(DISTINCT type, ', ' ORDER BY type) FILTER (comp) AS ty, string_agg(DISTINCT name, ', ' ORDER BY name) FILTER (NOT comp AND name<>'sig') AS pn FROM e GROUP BY 1),
w AS (SELECT page, string_agg(term, ', ' ORDER BY term) AS tm FROM (SELECT DISTINCT doc_id AS page, word AS term FROM words WHERE length(word)>11 QUALIFY dense_rank() OVER (PARTITION BY doc_id ORDER BY word)<=10) q GROUP BY 1)
SELECT page, components, nets, concat_ws(' ', concat('Page ',page,' schematic analysis summary.'), concat('Contains ',components,' components and ',nets,' electrical nets.'), 'Component types: '||ty||'.', 'Power nets: '||pn||'.', 'Key technical terms: '||tm||'.') AS summary FROM s LEFT JOIN w USING (page)""", ("components", "words"))
def _(t):
    e = t.lineitem.withColumn("id", F.concat(F.lit("P"), "l_partkey")).join(t.components.select("id", "type"), "id").selectExpr(
        "l_orderkey AS page", "CASE WHEN l_linestatus = 'O' THEN 'component' ELSE 'net' END AS kind", "CASE l_returnflag WHEN 'A' THEN 'VCC' WHEN 'N' THEN 'sig' ELSE 'gnd' END AS name", "type")
    terms = t.words.filter(F.length("word") > 11).select(F.col("doc_id").alias("page"), F.col("word").alias("term"))
    return aggregates.page_summaries(e, terms)


@query("k06_running_context", """WITH e AS (SELECT l_suppkey AS doc, l_linenumber AS page, l_orderkey AS idx, CASE l_returnflag WHEN 'A' THEN 'symbol' WHEN 'N' THEN 'rule' ELSE 'wire_color' END AS bucket, concat(l_orderkey,'-',l_partkey,'-',l_quantity::INT,'-',l_extendedprice::INT) AS body FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY doc, bucket ORDER BY page, idx, body) AS rn FROM e QUALIFY rn <= CASE bucket WHEN 'symbol' THEN 20 ELSE 10 END), p AS (SELECT DISTINCT doc, page FROM e)
SELECT p.doc, p.page, f.bucket, f.body FROM p JOIN f ON f.doc=p.doc AND f.page<p.page""")
def _(t):
    e = t.lineitem.selectExpr("l_suppkey AS doc", "l_linenumber AS page", "l_orderkey AS idx", "CASE l_returnflag WHEN 'A' THEN 'symbol' WHEN 'N' THEN 'rule' ELSE 'wire_color' END AS kind",
                              "concat(l_orderkey, '-', l_partkey, '-', CAST(round(l_quantity) AS INT), '-', CAST(bround(l_extendedprice) AS INT)) AS body")
    return op.running_context(e, e.select("doc", "page").distinct())


def answers(t):
    """Model answers about each document, some of them cut off, and the posts they are about."""
    items = F.array(F.struct(F.when(F.col("lang") == "es", "gossip").otherwise("specification").alias("type"), F.col("source").alias("component_type"),
                             F.struct(F.col("lang").alias("zone")).alias("location"),
                             F.array(F.struct(F.col("source").alias("source"), F.lit(None).cast("string").alias("target"))).alias("connections")))
    body = F.to_json(F.struct(F.struct(F.lit("Audi").alias("make")).alias("vehicle"), items.alias("knowledge")))
    raw = t.documents.select(F.col("doc_id").alias("post_id"), "lang", body.alias("answer"))
    raw = raw.withColumn("answer", F.when(F.col("lang") == "fr", F.expr("substring(answer, 1, length(answer) - 2)")).otherwise(F.col("answer")))
    vehicle = F.when(F.col("lang") == "de", F.struct(F.lit("Ford").alias("make"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("int").alias("year_start"), F.lit(None).cast("int").alias("year_end")))
    return raw.select("post_id", "answer"), t.documents.select(F.col("doc_id").alias("post_id"), F.col("text").alias("content"), vehicle.alias("vehicle"))


@query("k07_parse_knowledge", "SELECT doc_id AS post_id, 'specification' AS knowledge_type, CASE WHEN lang='de' THEN 'Ford' ELSE 'Audi' END AS make, source AS component_type, lang AS zone, concat(source,'>unknown') AS wire, 0.5::DOUBLE AS confidence FROM documents WHERE lang<>'es'")
def _(t):
    k = op.parse_knowledge(*answers(t))
    wire = F.concat_ws(">", F.col("connections").getItem(0)["source"], F.col("connections").getItem(0)["target"])
    return k.select("post_id", "knowledge_type", "vehicle.make", "component_type", "location.zone", wire.alias("wire"), "confidence")


@query("k08_entity_chunks")
def _(t):
    c = t.components.select(F.substring("id", 2, 20).cast("bigint").alias("page"), "id", "type", F.col("part_number").alias("value"), F.array("manufacturer").alias("pins"), (F.coalesce("voltage_rating", F.lit(0.0)) / 50).alias("confidence"))
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("name")).agg(F.count(F.lit(1)).alias("connections"), F.min(F.concat(F.lit("P"), "l_partkey", F.lit(" pin "), "l_linenumber")).alias("f")).select(
        "page", "name", "connections", F.array("f").alias("first"), F.lit(0.9).alias("confidence"))
    return op.entity_chunks(c, n).select("page", "kind", "name", "chunk_id", "text", "word_count")


@query("k09_failure_report", "SELECT o_orderpriority AS stage, count(*) AS failures, count(DISTINCT o_custkey) AS pages, count(DISTINCT o_orderstatus) AS errors, min(o_custkey) AS first_page FROM orders WHERE o_orderstatus<>'F' GROUP BY 1")
def _(t):
    return op.failure_report(t.orders.filter("o_orderstatus <> 'F'").selectExpr("o_custkey AS page", "o_orderpriority AS stage", "o_orderstatus AS error"))


@query("k10_sentence_chunks", """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text,'.'), lambda v: trim(v)), lambda v: length(v)>30)[1:10] AS l FROM documents)
SELECT doc_id, CAST(unnest(generate_series(0, len(l)-1)) AS INTEGER) AS chunk, md5(unnest(l)) AS h FROM s WHERE len(l)>0""")
def _(t):
    return op.sentence_chunks(t.documents, "doc_id", "text").select("doc_id", "chunk", F.md5("text").alias("h"))


@query("k11_bio_labels")
def _(t):
    labels = t.asked.select("id", op.bio_labels(F.col("text")).alias("l"))
    return labels.select("id", F.array_join("l", " ").alias("labels"), op.label_confidence(F.col("l")).alias("confidence"))


@query("k12_text_samples", "SELECT DISTINCT text FROM (SELECT trim(text) AS text FROM text_spans WHERE length(trim(text))>3 UNION ALL SELECT text FROM benchmark WHERE text<>'') q", "text_spans")
def _(t):
    return op.text_samples(t.text_spans.select("text"), t.benchmark.select("text"))


PAIRS = "r AS (SELECT doc_id, pos, engine, text, round(confidence,9) AS c FROM text_spans)"


@query("k13_contrastive_positive", f"WITH {PAIRS} SELECT doc_id, pos, a, b FROM (SELECT doc_id, pos, lag(text) OVER (PARTITION BY doc_id, pos ORDER BY engine) AS a, text AS b FROM r WHERE c>0.8) q WHERE a IS NOT NULL", "text_spans")
def _(t):
    return op.contrastive_pairs(t.text_spans, ["doc_id", "pos"])[0]


@query("k13_contrastive_negative", f"WITH {PAIRS} SELECT doc_id, pos, max_by(text, (c, engine)) AS a, min_by(text, (c, engine)) AS b, round(max(c)-min(c),9) AS gap FROM r GROUP BY 1,2 HAVING count(*)>=2 AND round(max(c)-min(c),9)>0.3", "text_spans")
def _(t):
    return op.contrastive_pairs(t.text_spans, ["doc_id", "pos"])[1]


@query("k14_error_patches", "SELECT l_suppkey AS job_id, l_orderkey AS page, l_returnflag AS detected_type, count(*) AS n FROM lineitem WHERE l_linestatus='F' GROUP BY 1,2,3")
def _(t):
    box = F.when(F.col("l_linestatus") == "F", F.array(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity"), F.col("l_extendedprice"))).otherwise(F.array("l_tax"))
    s = t.lineitem.select(F.col("l_suppkey").alias("job_id"), F.col("l_orderkey").alias("page"), F.lit("low").alias("severity"), F.array(F.lit("pin")).alias("errors"),
                          F.array(F.struct(F.col("l_returnflag").alias("type"), F.col("l_discount").alias("confidence"), box.alias("bbox"))).alias("symbols"))
    return op.error_patches(s).groupBy("job_id", "page", "detected_type").agg(F.count(F.lit(1)).alias("n"))


@query("k15_error_type_counts", "SELECT CASE l_returnflag WHEN 'A' THEN 'pin_errors' WHEN 'N' THEN 'duplicate_detections' ELSE 'classification_errors' END AS error_type, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return op.error_type_counts(t.lineitem.selectExpr("CASE l_returnflag WHEN 'A' THEN 'Pin count wrong' WHEN 'N' THEN 'duplicate symbol' ELSE 'Type mismatch' END AS message"))


@query("k16_due_jobs", """WITH j AS (SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'daily' WHEN 'O' THEN 'weekly' ELSE 'monthly' END AS schedule, o_orderdate AS last_run, CASE WHEN o_orderpriority LIKE '1%' THEN 'click' WHEN o_orderpriority LIKE '2%' THEN 'view' ELSE 'none' END AS st, CAST(o_totalprice/100 AS BIGINT) AS need FROM orders),
c AS (SELECT event_type, count(*) n FROM events GROUP BY 1) SELECT job, coalesce(n,0) AS samples, TIMESTAMP '1998-01-01'-last_run >= CASE schedule WHEN 'daily' THEN INTERVAL 1 DAY WHEN 'weekly' THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END AS due, coalesce(n,0)>=need AS ready FROM j LEFT JOIN c ON c.event_type=j.st""")
def _(t):
    jobs = t.orders.selectExpr("o_orderkey AS job", "CASE o_orderstatus WHEN 'F' THEN 'daily' WHEN 'O' THEN 'weekly' ELSE 'monthly' END AS schedule", "true AS enabled", "o_orderdate AS last_run",
                               "CASE WHEN o_orderpriority LIKE '1%' THEN 'click' WHEN o_orderpriority LIKE '2%' THEN 'view' ELSE 'none' END AS signal_type", "CAST(round(o_totalprice / 100) AS BIGINT) AS min_samples")
    return op.due_jobs(jobs, t.events.select(F.col("event_type").alias("signal_type")), F.lit("1998-01-01").cast("timestamp_ntz")).select("job", "samples", "due", "ready")
