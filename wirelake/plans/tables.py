"""The given parquet tables and the domain views over them.

Each view is one SQL text that runs unchanged in Spark SQL and in the SQL used for comparison.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

#: view name -> (tables and views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "vehicles": (
        ("region",),
        """SELECT concat('V', r_regionkey) AS signature, r_name AS make,
       concat('model_', r_name) AS model, 2000 + r_regionkey AS year FROM region""",
    ),
    "zones": (
        ("nation",),
        """SELECT concat('Z', n_nationkey) AS id, concat('V', n_nationkey % 5) AS vehicle_signature,
       n_name AS name,
       CASE n_nationkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'moderate' ELSE 'difficult' END AS access_level
FROM nation""",
    ),
    "components": (
        ("part",),
        """SELECT concat('P', p_partkey) AS id, concat('V', p_partkey % 5) AS vehicle_signature, p_name AS name,
       CASE p_type WHEN 'ECONOMY' THEN 'fuse' WHEN 'SMALL' THEN 'relay' WHEN 'MEDIUM' THEN 'sensor'
                   WHEN 'STANDARD' THEN 'connector' WHEN 'LARGE' THEN 'battery' ELSE 'ecu' END AS type,
       p_brand AS manufacturer, concat('PN', p_partkey % 500) AS part_number,
       CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS voltage_rating,
       CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE p_retailprice / 100.0 END AS current_rating,
       CASE WHEN p_partkey % 6 = 5 THEN NULL
            ELSE concat('Z', (CAST(floor(p_partkey / 5.0) AS BIGINT) % 5) * 5 + p_partkey % 5) END AS zone,
       CASE WHEN p_partkey % 9 = 4 THEN NULL ELSE CAST((p_partkey * 37) % 1400 AS DOUBLE) END AS x,
       CASE WHEN p_partkey % 9 = 4 THEN NULL ELSE CAST((p_partkey * 53) % 900 AS DOUBLE) END AS y,
       CASE WHEN p_partkey % 9 = 4 THEN NULL ELSE CAST((p_partkey * 71) % 1200 AS DOUBLE) END AS z
FROM part""",
    ),
    "circuits": (
        ("supplier",),
        """SELECT concat('C', s_suppkey) AS id, concat('V', s_suppkey % 5) AS vehicle_signature, s_name AS name,
       CASE s_suppkey % 4 WHEN 0 THEN 'power' WHEN 1 THEN 'ground' WHEN 2 THEN 'lighting' ELSE 'ignition' END AS circuit_type,
       CAST(CASE WHEN s_suppkey % 2 = 0 THEN 12 ELSE 24 END AS DOUBLE) AS voltage,
       abs(s_acctbal) / 5.0 AS max_current,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 7 = 1 THEN 'none' ELSE 'fuse' END AS protection,
       s_suppkey % 3 = 0 AS safety_critical
FROM supplier""",
    ),
    "part_of": (
        ("lineitem",),
        # a circuit of the part's own tenant: the supplier of that tenant in the block of five
        """SELECT concat('P', l_partkey) AS src, concat('C', l_suppkey - l_suppkey % 5 + l_partkey % 5) AS dst, concat('V', l_partkey % 5) AS vehicle_signature,
       CASE min(l_returnflag) WHEN 'A' THEN 'load' WHEN 'N' THEN 'control' ELSE 'protection' END AS role,
       min(l_linestatus) = 'F' AS is_critical
FROM lineitem
GROUP BY l_partkey, l_suppkey - l_suppkey % 5""",
    ),
    "connects_to": (
        ("lineitem",),
        """SELECT DISTINCT concat('P', prev) AS src, concat('P', l_partkey) AS dst, concat('V', l_partkey % 5) AS vehicle_signature
FROM (SELECT l_partkey,
             lag(l_partkey) OVER (PARTITION BY l_orderkey, l_partkey % 5
                                  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS prev
      FROM lineitem) t
WHERE prev IS NOT NULL AND prev <> l_partkey""",
    ),
    "powered_by": (
        ("part",),
        """SELECT concat('P', p_partkey) AS src,
       concat('P', CAST(floor((floor(p_partkey / 5.0) - 1) / 4.0) AS BIGINT) * 5 + p_partkey % 5) AS dst,
       concat('V', p_partkey % 5) AS vehicle_signature
FROM part
WHERE p_partkey >= 5""",
    ),
    "controls": (
        ("part",),
        """SELECT concat('P', a.p_partkey) AS src, concat('P', b.p_partkey) AS dst, concat('V', a.p_partkey % 5) AS vehicle_signature
FROM part a JOIN part b
  ON b.p_partkey = (CAST(floor(a.p_partkey / 5.0) AS BIGINT) * 3 + 1) * 5 + a.p_partkey % 5
WHERE a.p_type IN ('SMALL', 'MEDIUM', 'PROMO')""",
    ),
    "edges": (
        ("connects_to", "powered_by", "controls"),
        """SELECT vehicle_signature, src, dst, 'CONNECTS_TO' AS rel_type FROM connects_to
UNION ALL SELECT vehicle_signature, src, dst, 'POWERED_BY' AS rel_type FROM powered_by
UNION ALL SELECT vehicle_signature, src, dst, 'CONTROLS' AS rel_type FROM controls""",
    ),
    "all_edges": (
        ("edges", "part_of"),
        """SELECT vehicle_signature, src, dst, rel_type FROM edges
UNION ALL SELECT vehicle_signature, src, dst, 'PART_OF' AS rel_type FROM part_of""",
    ),
    "located_in": (
        ("components", "zones"),
        """SELECT c.id AS src, z.id AS dst, c.vehicle_signature, z.access_level AS accessibility,
       c.type IN ('fuse', 'relay', 'battery') AS service_access_required
FROM components c JOIN zones z ON c.zone = z.id""",
    ),
    "interactions": (
        ("events",),
        """SELECT event_id, user_id, ts,
       CASE event_type WHEN 'click' THEN 'component_selection' WHEN 'view' THEN 'view_change'
                       WHEN 'purchase' THEN 'layout_approval' WHEN 'signup' THEN 'save_project'
                       ELSE 'undo_redo' END AS interaction_type,
       event_type <> 'error' AS success,
       CAST(floor(value * 100) AS BIGINT) AS duration_ms,
       concat('P', event_id % 50) AS target_object_id
FROM events""",
    ),
    "jobs": (
        ("orders",),
        """SELECT o_orderkey AS job_id, o_custkey AS user_id, concat('V', o_orderkey % 5) AS project_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
       o_orderdate AS created_at, o_totalprice AS size_bytes
FROM orders""",
    ),
    "sections": (
        ("nation",),
        """SELECT concat('S', n_nationkey) AS name, n_nationkey * 40 AS start_page, n_nationkey * 40 + 59 AS end_page
FROM nation""",
    ),
    "tags": (
        ("part",),
        """SELECT concat('P', p_partkey) AS id,
       CASE p_partkey % 12 WHEN 0 THEN concat('R', p_size) WHEN 1 THEN concat(p_size, 'k') WHEN 2 THEN concat(p_size, 'V')
            WHEN 3 THEN 'VCC' WHEN 4 THEN concat('DATA[', p_size, ':0]') WHEN 5 THEN 'GND' WHEN 6 THEN concat('+', p_size, '.5V in')
            WHEN 7 THEN concat('relay k-', p_size) WHEN 8 THEN 'CLK' WHEN 9 THEN concat('FUSE F', p_size)
            WHEN 10 THEN concat('net_battery_ignition1', p_size) ELSE concat('can_h ', p_brand) END AS text
FROM part""",
    ),
    "strokes": (
        ("lineitem",),
        """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       l_tax * 1000 AS ax1, l_discount * 1000 AS ay1, l_quantity * 2 AS ax2, CAST(l_linenumber * 30 AS DOUBLE) AS ay2,
       l_quantity AS bx1, CAST(l_linenumber * 11 AS DOUBLE) AS by1, l_discount * 900 AS bx2, l_tax * 800 + 40 AS by2
FROM lineitem""",
    ),
    "asked": (
        ("conversations", "benchmark", "part"),
        """SELECT concat('C', conv_id, '-', turn) AS id, text FROM conversations WHERE role = 'user'
UNION ALL SELECT concat('B', item_id), text FROM benchmark
UNION ALL SELECT concat('P', p_partkey), concat(CASE p_partkey % 9 WHEN 0 THEN 'where is the relay with ' WHEN 1 THEN 'fuse problem in the dash, ' WHEN 2 THEN 'compare ecu and sensor '
  WHEN 3 THEN 'battery specs ' WHEN 4 THEN 'similar connector for ' WHEN 5 THEN 'install pump near trunk ' WHEN 6 THEN 'starter wire harness '
  WHEN 7 THEN 'ground point in engine bay ' ELSE 'general note ' END, p_size, CASE p_partkey % 4 WHEN 0 THEN 'V ' WHEN 1 THEN ' amps ' WHEN 2 THEN 'w 12 volt ' ELSE ' ' END, p_brand) FROM part""",
    ),
    "qrels": (
        ("embeddings",),
        """SELECT q.vec_id AS query_id, d.vec_id AS doc_id
FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id""",
    ),
}


#: Tables that the two dialects spell differently: name -> SQL used for comparison.
DERIVED_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "words": (
        ("documents",),
        r"""SELECT doc_id, unnest(ws) AS word, CAST(unnest(generate_series(0, len(ws) - 1)) AS INTEGER) AS pos
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents) d
WHERE len(ws) > 0""",
    ),
    "text_spans": (
        ("words",),
        """SELECT doc_id, page, engine, pos, text, x1, y1, x2, y2, confidence FROM (
SELECT doc_id, doc_id AS page, 'tesseract' AS engine, pos, word AS text, CAST((pos % 20) * 50 AS DOUBLE) AS x1,
  CAST((pos // 20) * 20 AS DOUBLE) AS y1, CAST((pos % 20) * 50 + 8 * length(word) AS DOUBLE) AS x2,
  CAST((pos // 20) * 20 + 14 AS DOUBLE) AS y2, 0.5 + (pos % 50) / 100.0::DOUBLE AS confidence FROM words
UNION ALL
SELECT doc_id, doc_id, 'deepseek', pos, CASE WHEN pos % 7 = 0 THEN replace(word, 'e', 'c') ELSE word END,
  CAST((pos % 20) * 50 + 2 AS DOUBLE), CAST((pos // 20) * 20 + 2 AS DOUBLE), CAST((pos % 20) * 50 + 8 * length(word) + 2 AS DOUBLE),
  CAST((pos // 20) * 20 + 16 AS DOUBLE), 0.9 - (pos % 40) / 100.0::DOUBLE FROM words
UNION ALL
SELECT doc_id, doc_id, 'mistral', pos, word, CAST((pos % 20) * 50 + 1 AS DOUBLE), CAST((pos // 20) * 20 + 1 AS DOUBLE),
  CAST((pos % 20) * 50 + 8 * length(word) + 1 AS DOUBLE), CAST((pos // 20) * 20 + 15 AS DOUBLE), 0.7 FROM words WHERE pos % 3 = 0) s""",
    ),
    "segments": (
        ("words",),
        """SELECT doc_id, concat('h', doc_id, '-', line) AS seg_id, 0.0::DOUBLE AS x1, CAST(line * 20 AS DOUBLE) AS y1, CAST(w AS DOUBLE) AS x2, CAST(line * 20 AS DOUBLE) AS y2
FROM (SELECT doc_id, pos // 20 AS line, max((pos % 20) * 50 + 8 * length(word)) AS w FROM words GROUP BY 1, 2) l
UNION ALL SELECT doc_id, concat('v', doc_id, '-', pos), CAST((pos % 20) * 50 AS DOUBLE), CAST((pos // 20) * 20 AS DOUBLE), CAST((pos % 20) * 50 AS DOUBLE), CAST((pos // 20) * 20 + 20 AS DOUBLE)
FROM words WHERE length(word) > 9""",
    ),
    "detections": (
        ("words",),
        """SELECT doc_id, concat('c', doc_id, '-', pos) AS comp_id,
  CASE length(word) WHEN 1 THEN 'resistor' WHEN 2 THEN 'resistor' WHEN 3 THEN 'capacitor' WHEN 4 THEN 'ic' WHEN 5 THEN 'diode' WHEN 6 THEN 'connector' ELSE 'transistor' END AS label,
  CAST((pos % 20) * 50 - 5 AS DOUBLE) AS x1, CAST((pos // 20) * 20 - 5 AS DOUBLE) AS y1, CAST((pos % 20) * 50 + 8 * length(word) + 5 AS DOUBLE) AS x2,
  CAST((pos // 20) * 20 + 19 AS DOUBLE) AS y2, 0.5 + (pos % 50) / 100.0::DOUBLE AS confidence
FROM words WHERE regexp_matches(word, '^[A-Z]')""",
    ),
}


def _words(t: "Tables") -> DataFrame:
    tokens = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return t.documents.select("doc_id", F.posexplode(tokens).alias("pos", "word"))


def _text_spans(t: "Tables") -> DataFrame:
    """Three engines' reading of each word on a grid of 20 words per line."""
    left, top = (F.col("pos") % 20) * 50, F.floor(F.col("pos") / 20).cast("int") * 20

    def engine(name, shift, text, confidence):
        return F.struct(
            F.lit(name).alias("engine"), text.alias("text"),
            (left + shift).cast("double").alias("x1"), (top + shift).cast("double").alias("y1"),
            (left + 8 * F.length("word") + shift).cast("double").alias("x2"),
            (top + 14 + shift).cast("double").alias("y2"), confidence.alias("confidence"))

    misread = F.when(F.col("pos") % 7 == 0, F.translate("word", "e", "c")).otherwise(F.col("word"))
    readings = F.array_compact(F.array(
        engine("tesseract", 0, F.col("word"), F.lit(0.5) + (F.col("pos") % 50) / F.lit(100.0)),
        engine("deepseek", 2, misread, F.lit(0.9) - (F.col("pos") % 40) / F.lit(100.0)),
        F.when(F.col("pos") % 3 == 0, engine("mistral", 1, F.col("word"), F.lit(0.7)))))
    return t.words.select("doc_id", F.col("doc_id").alias("page"), "pos", F.explode(readings).alias("r")).select(
        "doc_id", "page", "r.engine", "pos", "r.text", "r.x1", "r.y1", "r.x2", "r.y2", "r.confidence")


def _segments(t: "Tables") -> DataFrame:
    """One line under each row of words, and a tick at the start of each long word."""
    line, left = F.floor(F.col("pos") / 20).cast("int"), F.col("pos") % 20 * 50
    rows = t.words.groupBy("doc_id", line.alias("line")).agg(F.max(left + 8 * F.length("word")).alias("w"))
    y = F.col("line") * 20.0
    flat = rows.select("doc_id", F.concat(F.lit("h"), "doc_id", F.lit("-"), "line").alias("seg_id"), F.lit(0.0).alias("x1"), y.alias("y1"), F.col("w").cast("double").alias("x2"), y.alias("y2"))
    ticks = t.words.filter(F.length("word") > 9).select(
        "doc_id", F.concat(F.lit("v"), "doc_id", F.lit("-"), "pos").alias("seg_id"), left.cast("double").alias("x1"), (line * 20.0).alias("y1"), left.cast("double").alias("x2"), (line * 20.0 + 20).alias("y2"))
    return flat.unionByName(ticks)


def _detections(t: "Tables") -> DataFrame:
    """A box around each capitalised word; the word length picks the label."""
    line, left, n = F.floor(F.col("pos") / 20).cast("int") * 20, F.col("pos") % 20 * 50, F.length("word")
    label = (F.when(n <= 2, "resistor").when(n == 3, "capacitor").when(n == 4, "ic").when(n == 5, "diode").when(n == 6, "connector").otherwise("transistor"))
    return t.words.filter(F.col("word").rlike("^[A-Z]")).select(
        "doc_id", F.concat(F.lit("c"), "doc_id", F.lit("-"), "pos").alias("comp_id"), label.alias("label"), (left - 5).cast("double").alias("x1"), (line - 5).cast("double").alias("y1"),
        (left + 8 * n + 5).cast("double").alias("x2"), (line + 19).cast("double").alias("y2"), (F.lit(0.5) + (F.col("pos") % 50) / F.lit(100.0)).alias("confidence"))


BUILDERS = {"words": _words, "text_spans": _text_spans, "segments": _segments, "detections": _detections}


class Tables:
    """Lazy access to tables and views of one data folder: ``t.part``, ``t.components``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        if name in BUILDERS:
            return BUILDERS[name](self)
        if name not in VIEWS:
            raise AttributeError(name)
        needs, sql = VIEWS[name]
        for need in needs:
            getattr(self, need).createOrReplaceTempView(need)
        return self.spark.sql(sql)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run SQL over the given frames, named ``{name}`` in the text."""
        return self.spark.sql(text, **frames)


def with_views(names: tuple[str, ...], body: str) -> str:
    """Put the named views, and the views these need, in front of ``body`` as CTEs."""
    known = {**VIEWS, **DERIVED_SQL}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in known and name not in ordered:
            for need in known[name][0]:
                visit(need)
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS (\n{known[n][1]}\n)" for n in ordered)
    text = body.strip()
    if not ctes:
        return text
    if text[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{text[15:]}"
    if text[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"
