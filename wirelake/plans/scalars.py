"""Queries for column functions (F ids)."""

from pyspark.sql import functions as F

from wirelake.functions import electrical as el
from wirelake.functions import geometry as geo
from wirelake.functions import text as tx
from wirelake.plans.registry import query

ROW = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
SQL_ROW = ", ".join(ROW)


def pair():
    return geo.box("a"), geo.box("b")


def ordered_pair():
    """The same corners as proper boxes (x1<=x2, y1<=y2)."""
    def made(p):
        c = {k: F.col(p + k) for k in ("x1", "y1", "x2", "y2")}
        return F.struct(F.least(c["x1"], c["x2"]).alias("x1"), F.least(c["y1"], c["y2"]).alias("y1"),
                        F.greatest(c["x1"], c["x2"]).alias("x2"), F.greatest(c["y1"], c["y2"]).alias("y2"))
    return made("a"), made("b")


BOXES = f"""boxes AS (SELECT {SQL_ROW}, least(ax1,ax2) AS ax1, least(ay1,ay2) AS ay1, greatest(ax1,ax2) AS ax2, greatest(ay1,ay2) AS ay2,
least(bx1,bx2) AS bx1, least(by1,by2) AS by1, greatest(bx1,bx2) AS bx2, greatest(by1,by2) AS by2 FROM strokes)"""


@query("f01_levenshtein", "SELECT id, levenshtein(text, 'VCC+5V relay') AS d FROM tags", "tags")
def _(t):
    return t.tags.select("id", tx.levenshtein(F.col("text"), F.lit("VCC+5V relay")).cast("bigint").alias("d"))


def _readings(t):
    """Every document twice: as written, and with some words misread."""
    wrong = F.when(F.col("pos") % 7 == 0, F.translate("word", "e", "c")).otherwise(F.col("word"))
    pairs = t.words.select("doc_id", "pos", "word", wrong.alias("read"))
    return pairs


#: The misread text has the same words but for those that ``th`` begins; no two neighbours swap, so
#: the distance is the number of words that differ in place.
MISREAD = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS a,
  list_filter(regexp_split_to_array(regexp_replace(text, '\bth(\w+)', 'tb\1', 'g'), '\s+'), lambda x: x <> '') AS b FROM documents),
d AS (SELECT doc_id, len(a) AS n, CAST(len(list_filter(list_zip(a, b), lambda z: z[1] <> z[2])) AS INTEGER) AS d FROM w)
"""


@query("f02_word_levenshtein", MISREAD + "SELECT doc_id, d FROM d")
def _(t):
    misread = F.regexp_replace("text", r"\bth(\w+)", "tb$1")
    return t.documents.select("doc_id", tx.word_levenshtein(F.col("text"), misread).alias("d"))


@query("f03_cer", """SELECT doc_id, pos, round(levenshtein(word, CASE WHEN pos % 7 = 0 THEN replace(word,'e','c') ELSE word END)/length(word),9) AS cer FROM words""", "words")
def _(t):
    return _readings(t).select("doc_id", "pos", F.round(tx.cer(F.col("word"), F.col("read")), 9).alias("cer"))


@query("f03_wer", MISREAD + "SELECT doc_id, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE d / n END AS wer FROM d")
def _(t):
    misread = F.regexp_replace("text", r"\bth(\w+)", "tb$1")
    return t.documents.select("doc_id", tx.wer(F.col("text"), misread).alias("wer"))


@query("f04_text_matches", """WITH n AS (SELECT id, replace(lower(trim(text)),' ','') AS a FROM tags) SELECT id, levenshtein(a, 'relayk-12')/greatest(length(a), 9) <= 0.2 AS ok FROM n""", "tags")
def _(t):
    return t.tags.select("id", tx.text_matches(F.col("text"), F.lit("Relay K-12 ")).alias("ok"))


@query("f05_iou", f"""WITH {BOXES}, i AS (SELECT *, CASE WHEN least(ax2,bx2)>greatest(ax1,bx1) AND least(ay2,by2)>greatest(ay1,by1) THEN (least(ax2,bx2)-greatest(ax1,bx1))*(least(ay2,by2)-greatest(ay1,by1)) ELSE 0 END AS inter,
(ax2-ax1)*(ay2-ay1)+(bx2-bx1)*(by2-by1) AS s FROM boxes) SELECT {SQL_ROW}, round(CASE WHEN s-inter>0 THEN inter/(s-inter) ELSE 0 END,8) AS iou, round(1-CASE WHEN s-inter>0 THEN inter/(s-inter) ELSE 0 END,8) AS diff FROM i""", "strokes")
def _(t):
    a, b = ordered_pair()
    return t.strokes.select(*ROW, F.round(geo.iou(a, b), 8).alias("iou"), F.round(geo.bbox_diff(a, b), 8).alias("diff"))


REL = """CASE WHEN bx1-5<=ax1 AND ax2<=bx2+5 AND by1-5<=ay1 AND ay2<=by2+5 THEN 'contained' WHEN NOT (ax2<bx1 OR bx2<ax1 OR ay2<by1 OR by2<ay1) THEN 'overlapping'
WHEN abs(dy)<=10 OR abs(dx)<=10 THEN 'aligned' WHEN abs(dx)>abs(dy) AND dx>0 THEN 'adjacent_right' WHEN abs(dx)>abs(dy) THEN 'adjacent_left' WHEN dy>0 THEN 'adjacent_below' ELSE 'adjacent_above' END"""


@query("f06_f07_spatial_relation", f"""WITH {BOXES}, c AS (SELECT *, (ax1+ax2)/2-(bx1+bx2)/2 AS dx, (ay1+ay2)/2-(by1+by2)/2 AS dy FROM boxes), r AS (SELECT *, {REL} AS rel FROM c)
SELECT {SQL_ROW}, rel, round(CASE rel WHEN 'contained' THEN 1.0 WHEN 'overlapping' THEN 0.9 WHEN 'aligned' THEN 0.8 WHEN 'adjacent_above' THEN 0.7 WHEN 'adjacent_below' THEN 0.7 ELSE 0.6 END*greatest(0.1, 1-sqrt(dx*dx+dy*dy)/50),8) AS confidence FROM r""", "strokes")
def _(t):
    a, b = ordered_pair()
    rel = geo.spatial_relation(a, b)
    return t.strokes.select(*ROW, rel.alias("rel"), F.round(geo.spatial_confidence(rel, geo.centre_distance(a, b)), 8).alias("confidence"))


@query("f08_f09_text_class", r"""WITH k AS (SELECT id, CASE WHEN regexp_matches(text,'(?i)^([RULCQDT]\d+|IC\d+|SW\d+|J\d+|TP\d+)$') THEN 'reference' WHEN regexp_matches(text,'(?i)^(\d+[kKmM]?[ΩΩohm]*|\d+[pnumµμ]*[Ff]|\d+[pnumµμ]*[Hh]|\d+(\.\d+)?[Vv]|LM\d+|TL\d+|[12]N\d+)$') THEN 'value'
WHEN regexp_matches(text,'^\d{1,3}$') OR upper(text) IN ('VCC','GND','IN','OUT','CLK','RST','EN','CS','WR','RD') THEN 'pin_label' ELSE 'label' END AS class FROM tags)
SELECT id, class, CASE class WHEN 'reference' THEN 1.0 WHEN 'value' THEN 0.8 WHEN 'pin_label' THEN 1.0 ELSE 0.7 END::DOUBLE AS weight FROM k""", "tags")
def _(t):
    k = tx.text_class(F.col("text"))
    return t.tags.select("id", k.alias("class"), tx.type_weight(k, F.lit("ic")).alias("weight"))


@query("f10_looks_like_value", r"""SELECT id, regexp_matches(text,'^(\d+[kKmM]?[ΩΩohm]*|\d+[pnumµμ]*[Ff]|\d+[pnumµμ]*[Hh]|\d+(\.\d+)?[Vv]|[A-Z]{2,}\d+[A-Z]*)$') AS drawn,
contains('12v',lower(text)) OR contains(lower(text),'12v') OR contains('relay',lower(text)) OR contains(lower(text),'relay') OR regexp_matches(text,'\d+') AS listed FROM tags""", "tags")
def _(t):
    return t.tags.select("id", tx.looks_like_value(F.col("text")).alias("drawn"), tx.looks_like_value(F.col("text"), F.array(F.lit("12V"), F.lit("relay"))).alias("listed"))


@query("f11_f12_net_labels", r"""WITH u AS (SELECT id, text, upper(text) AS t FROM tags) SELECT id, CASE WHEN regexp_matches(t,'VCC|VDD|V\+|\+5V|\+3V|3\.3V|5V|12V|24V') THEN 'voltage' WHEN regexp_matches(t,'GND|GROUND|VSS|V-|0V') THEN 'ground'
WHEN regexp_matches(t,'PWR|POWER|VIN|VOUT|VBAT') THEN 'power' WHEN contains(text,'[') AND contains(text,']') THEN 'bus' WHEN regexp_matches(t,'CLK|CLOCK|OSC|XTAL') THEN 'signal' ELSE 'custom' END AS class,
coalesce(nullif(regexp_extract(t,'([+-]?\d+(?:\.\d+)?)\s*V',0),''), CASE WHEN contains(t,'VCC') OR contains(t,'VDD') THEN 'VCC' WHEN contains(t,'GND') THEN 'GND' END) AS voltage,
abs(TRY_CAST(regexp_extract(text,'\[(\d+):(\d+)\]',1) AS INTEGER)-TRY_CAST(regexp_extract(text,'\[(\d+):(\d+)\]',2) AS INTEGER))+1 AS width FROM u""", "tags")
def _(t):
    c = F.col("text")
    return t.tags.select("id", tx.net_label_class(c).alias("class"), tx.voltage_level(c).alias("voltage"), tx.bus_width(c).alias("width"))


LEN = "sqrt((ax2-ax1)**2+(ay2-ay1)**2)"


@query("f13_segments", f"""WITH s AS (SELECT *, {LEN} AS len, greatest(0, least(1, ((bx1-ax1)*(ax2-ax1)+(by1-ay1)*(ay2-ay1))/((ax2-ax1)**2+(ay2-ay1)**2))) AS u FROM strokes)
SELECT {SQL_ROW}, round(len,6) AS len, round(atan2(ay2-ay1,ax2-ax1),8) AS angle, (ax1+ax2)/2 AS mx, (ay1+ay2)/2 AS my, round(sqrt((bx1-ax1-u*(ax2-ax1))**2+(by1-ay1-u*(ay2-ay1))**2),6) AS dist FROM s""", "strokes")
def _(t):
    a, _ = pair()
    mid = geo.seg_mid(a)
    return t.strokes.select(*ROW, F.round(geo.seg_length(a), 6).alias("len"), F.round(geo.seg_angle(a), 8).alias("angle"), mid["x"].alias("mx"), mid["y"].alias("my"),
                            F.round(geo.seg_point_dist(a, F.col("bx1"), F.col("by1")), 6).alias("dist"))


DET = "((ax1-ax2)*(by1-by2)-(ay1-ay2)*(bx1-bx2))"


@query("f14_intersection", f"""WITH s AS (SELECT *, CASE WHEN abs({DET})>=1e-10 THEN {DET} END AS d FROM strokes), k AS (SELECT *, ((ax1-bx1)*(by1-by2)-(ay1-by1)*(bx1-bx2))/d AS t, -((ax1-ax2)*(ay1-by1)-(ay1-ay2)*(ax1-bx1))/d AS u FROM s)
SELECT {SQL_ROW}, round(ax1+t*(ax2-ax1),6) AS x, round(ay1+t*(ay2-ay1),6) AS y FROM k WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""", "strokes")
def _(t):
    a, b = pair()
    return t.strokes.select(*ROW, geo.seg_intersection(a, b).alias("p")).filter("p IS NOT NULL").select(*ROW, F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def _gap(px, py, s):
    u = f"greatest(0, least(1, coalesce((({px}-{s}x1)*({s}x2-{s}x1)+({py}-{s}y1)*({s}y2-{s}y1))/nullif(({s}x2-{s}x1)**2+({s}y2-{s}y1)**2,0),0)))"
    return f"sqrt(({px}-{s}x1-{u}*({s}x2-{s}x1))**2+({py}-{s}y1-{u}*({s}y2-{s}y1))**2)"


@query("f14_closest_points", f"""WITH s AS (SELECT *, CASE WHEN abs({DET})>=1e-10 THEN {DET} END AS d FROM strokes), k AS (SELECT *, ((ax1-bx1)*(by1-by2)-(ay1-by1)*(bx1-bx2))/d AS t, -((ax1-ax2)*(ay1-by1)-(ay1-ay2)*(ax1-bx1))/d AS u FROM s)
SELECT {SQL_ROW}, round(CASE WHEN t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN 0 ELSE least({_gap('ax1','ay1','b')}, {_gap('ax2','ay2','b')}, {_gap('bx1','by1','a')}, {_gap('bx2','by2','a')}) END,5) AS distance FROM k""", "strokes")
def _(t):
    a, b = pair()
    return t.strokes.select(*ROW, F.round(geo.closest_points(a, b)["distance"], 5).alias("distance"))


@query("f15_intersection_confidence", f"""WITH s AS (SELECT *, CASE WHEN abs({DET})>=1e-10 THEN {DET} END AS d FROM strokes), k AS (SELECT *, ((ax1-bx1)*(by1-by2)-(ay1-by1)*(bx1-bx2))/d AS t, -((ax1-ax2)*(ay1-by1)-(ay1-ay2)*(ax1-bx1))/d AS u,
abs(atan2(ay2-ay1,ax2-ax1)-atan2(by2-by1,bx2-bx1)) AS g FROM s), m AS (SELECT *, greatest(0.1, 1-2*abs(least(g, abs(g-pi()))-pi()/2)/pi()) AS ac FROM k WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)
SELECT {SQL_ROW}, round(ac*CASE WHEN round(t,9) BETWEEN 0.1 AND 0.9 THEN 1 WHEN round(t,9) BETWEEN 0.05 AND 0.95 THEN 0.8 ELSE 0.3 END*CASE WHEN round(u,9) BETWEEN 0.1 AND 0.9 THEN 1 WHEN round(u,9) BETWEEN 0.05 AND 0.95 THEN 0.8 ELSE 0.3 END,6) AS confidence FROM m""", "strokes")
def _(t):
    a, b = pair()
    p = geo.seg_intersection(a, b)
    return t.strokes.select(*ROW, p.alias("p"), a.alias("a"), b.alias("b")).filter("p IS NOT NULL").select(
        *ROW, F.round(geo.intersection_confidence(F.col("a"), F.col("b"), F.col("p")), 6).alias("confidence"))


@query("f16_f17_distance_3d", """SELECT e.src, e.dst, round(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2),6) AS d, abs(a.x-b.x)<=200 AND abs(a.y-b.y)<=200 AND abs(a.z-b.z)<=200 AS hit
FROM powered_by e JOIN components a ON a.id=e.src AND a.x IS NOT NULL JOIN components b ON b.id=e.dst AND b.x IS NOT NULL""", ("powered_by", "components"))
def _(t):
    at = t.components.filter("x IS NOT NULL").select("id", F.struct("x", "y", "z").alias("p"))
    both = t.powered_by.join(at.withColumnsRenamed({"id": "src", "p": "a"}), "src").join(at.withColumnsRenamed({"id": "dst", "p": "b"}), "dst")
    size = F.struct(*[F.lit(200.0).alias(c) for c in "xyz"])
    return both.select("src", "dst", F.round(geo.dist3(F.col("a"), F.col("b")), 6).alias("d"), geo.boxes_intersect3(F.col("a"), size, F.col("b"), size).alias("hit"))


@query("f18_voltage_drop", "SELECT id, round(coalesce(voltage_rating*current_rating/1000,0),8) AS drop FROM components", "components")
def _(t):
    return t.components.select("id", F.round(el.voltage_drop(F.col("voltage_rating"), F.col("current_rating")), 8).alias("drop"))


GAUGE = "CASE WHEN l_quantity<10 THEN '0.5mm²' WHEN l_quantity<20 THEN '1.5mm²' WHEN l_quantity<40 THEN '2.5mm²' ELSE '9mm²' END"


@query("f19_with_resistance", f"""SELECT {SQL_ROW}, round(CASE WHEN l_quantity<10 THEN 0.036 WHEN l_quantity<20 THEN 0.012 WHEN l_quantity<40 THEN 0.007 END*ax2/1000,9)::DOUBLE AS resistance FROM strokes""", "strokes")
def _(t):
    w = t.strokes.withColumns({"wire_gauge": F.expr(GAUGE), "wire_length": F.col("ax2")})
    return el.with_resistance(w).select(*ROW, F.round("resistance", 9).alias("resistance"))


@query("f20_edge_flags", f"""SELECT {SQL_ROW}, l_returnflag IN ('A') AS is_power, l_returnflag='N' AS is_data, l_linestatus='F' OR l_returnflag='R' AS is_critical_power, l_quantity*50>1000 AS is_high_frequency,
CASE WHEN l_linestatus='O' THEN 'high' ELSE 'medium' END AS control_complexity FROM lineitem""")
def _(t):
    e = t.lineitem.selectExpr(*ROW, "CASE l_returnflag WHEN 'A' THEN 'ground' WHEN 'N' THEN 'data' ELSE 'can_message' END AS signal_type", "l_linestatus = 'F' AS always_on",
                              "CASE WHEN l_returnflag = 'R' THEN 'battery' ELSE 'switched' END AS power_type", "l_quantity * 50 AS frequency_hz", "CASE WHEN l_linestatus = 'O' THEN 'can_bus' ELSE 'pwm' END AS control_type")
    return el.edge_flags(e).select(*ROW, "is_power", "is_data", "is_critical_power", "is_high_frequency", "control_complexity")


@query("f21_install_effort", """WITH s AS (SELECT id, type, CASE access_level WHEN 'easy' THEN 1.0 WHEN 'moderate' THEN 1.5 ELSE 2.5 END*CASE WHEN voltage_rating>25 THEN 1.5 ELSE 1 END*CASE WHEN type='battery' THEN 1.8 ELSE 1 END*CASE WHEN type='sensor' THEN 1.3 ELSE 1 END*CASE WHEN current_rating>12 THEN 1.5 ELSE 1 END::DOUBLE AS e, access_level FROM components_z)
SELECT id, round(e,8) AS effort_score, CASE WHEN e>5 THEN 'high' WHEN e>2 THEN 'medium' ELSE 'low' END AS complexity, round(30*e,8) AS estimated_time, CASE WHEN type='battery' THEN 'high' WHEN access_level='difficult' THEN 'medium' ELSE 'low' END AS service_complexity FROM s""".replace(
    "components_z", "(SELECT c.*, z.access_level FROM components c JOIN zones z ON z.id=c.zone)"), ("components", "zones"))
def _(t):
    c = t.components.join(t.zones.select(F.col("id").alias("zone"), "access_level"), "zone").selectExpr(
        "id", "access_level AS accessibility", "CASE WHEN voltage_rating > 25 THEN 6 ELSE 2 END AS mounting_points", "type = 'battery' AS special_tools_required",
        "type = 'sensor' AS requires_calibration", "current_rating > 12 AS safety_critical_location", "CAST(NULL AS INT) AS installation_time")
    return el.install_effort(c).select("id", F.round("effort_score", 8).alias("effort_score"), "complexity", F.round("estimated_time", 8).alias("estimated_time"), "service_complexity")


@query("f22_member_risk", """WITH m AS (SELECT src, dst, role, is_critical, CASE role WHEN 'load' THEN 'normal' WHEN 'control' THEN 'critical' ELSE 'optional' END AS lv, CAST(length(src)*2500-8000 AS DOUBLE) AS mtbf FROM part_of),
r AS (SELECT src, dst, is_critical, least(1.0, 0.5+least(mtbf/10000,1)*0.3+CASE lv WHEN 'normal' THEN 0.2 WHEN 'critical' THEN 0 ELSE 0.4 END+CASE WHEN is_critical THEN 0.1 ELSE 0 END)::DOUBLE AS rel,
(CASE lv WHEN 'normal' THEN 2 WHEN 'critical' THEN 5 ELSE 0.5 END*CASE WHEN mtbf<>0 AND mtbf<1000 THEN 2 WHEN mtbf>10000 THEN 0.5 ELSE 1 END*CASE WHEN is_critical THEN 4 ELSE 2 END*CASE WHEN is_critical THEN 0.8 ELSE 1 END)::DOUBLE AS risk FROM m)
SELECT src, dst, round(rel,8) AS reliability_score, round(risk,8) AS risk_score, CASE WHEN risk>8 THEN 'high' WHEN risk>3 THEN 'medium' ELSE 'low' END AS risk_level, is_critical AS mitigation_available FROM r""", "part_of")
def _(t):
    m = t.part_of.selectExpr("src", "dst", "CASE role WHEN 'load' THEN 'normal' WHEN 'control' THEN 'critical' ELSE 'optional' END AS criticality_level", "CAST(length(src) * 2500 - 8000 AS DOUBLE) AS mtbf",
                             "CASE WHEN is_critical THEN 'vehicle' ELSE 'system' END AS failure_impact", "CAST(NULL AS STRING) AS redundancy_group", "is_critical AS diagnostic_capable", "false AS self_test_capable")
    return el.member_risk(m).select("src", "dst", F.round("reliability_score", 8).alias("reliability_score"), F.round("risk_score", 8).alias("risk_score"), "risk_level", "mitigation_available")


@query("f23_f24_names", r"""WITH u AS (SELECT id, upper(trim(text)) AS t FROM tags) SELECT id, regexp_replace(regexp_replace(regexp_replace(t,'^RELAY\s*([KR]?\d+)','K\1'),'^FUSE\s*([F]?\d+)','F\1'),'^([KFR])[-_](\d+)','\1\2') AS component_id,
regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t,'BATTERY','BATT'),'GROUND','GND'),'IGNITION1','IG1'),'IGNITION2','IG2'),'ACCESSORY','ACC'),'POWER','PWR'),'SIGNAL','SIG'),'^(NET|SIGNAL|LINE)[-_]?',''),'[-_]?(NET|SIGNAL|LINE)$','') AS net_name FROM u""", "tags")
def _(t):
    return t.tags.select("id", tx.normalise_component_id(F.col("text")).alias("component_id"), tx.normalise_net_name(F.col("text")).alias("net_name"))


@query("f25_vehicle_signature", "SELECT signature, lower(replace(concat(make,'_',model,'_',year,'_eu'),' ','_')) AS name FROM vehicles", "vehicles")
def _(t):
    return t.vehicles.select("signature", tx.vehicle_signature(F.col("make"), F.col("model"), F.col("year"), F.lit("EU")).alias("name"))


@query("f26_extract_vehicle", r"""WITH s AS (SELECT o_orderkey, concat('Sale: ', year(o_orderdate), CASE WHEN o_orderstatus='F' THEN concat(' - ', year(o_orderdate)+3) ELSE '' END, ' ', CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE o_orderstatus||'make ' END, 'model ', o_custkey) AS x FROM orders),
e AS (SELECT o_orderkey, regexp_extract(x,'(\d{4})(?:\s*-\s*(\d{4}))?\s+([A-Za-z]+)\s+([A-Za-z0-9]+(?:\s+[A-Za-z0-9]+)?)',['a','b','c','d']) AS g FROM s)
SELECT o_orderkey, g.c AS make, g.d AS model, CAST(g.a AS INTEGER) AS year_start, CAST(coalesce(nullif(g.b,''), g.a) AS INTEGER) AS year_end FROM e WHERE g.a<>''""")
def _(t):
    x = F.expr("concat('Sale: ', year(o_orderdate), CASE WHEN o_orderstatus = 'F' THEN concat(' - ', year(o_orderdate) + 3) ELSE '' END, ' ', CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE o_orderstatus || 'make ' END, 'model ', o_custkey)")
    return t.orders.select("o_orderkey", tx.extract_vehicle(x).alias("v")).filter("v IS NOT NULL").select("o_orderkey", "v.*")


@query("f27_infer", r"""WITH u AS (SELECT id, lower(text) AS t, upper(text) AS p FROM tags) SELECT id, CASE WHEN t IN ('vcc','vdd','vbat','power','+12v','+5v','+3.3v') THEN 'power' WHEN t IN ('gnd','ground','vss','earth') THEN 'ground' WHEN regexp_matches(t,'can_h|canh') THEN 'can_h'
WHEN regexp_matches(t,'can_l|canl') THEN 'can_l' WHEN contains(t,'lin') THEN 'lin' ELSE 'signal' END AS role, regexp_matches(t,'vcc|vdd|vbat|ig1|ig2|acc|\+12v|\+5v') AS is_power, regexp_matches(t,'gnd|ground|earth|chassis') AS is_ground,
CASE WHEN contains(t,'can') THEN 'CAN' WHEN contains(t,'lin') THEN 'LIN' WHEN regexp_matches(t,'k-line|kline') THEN 'K_LINE' END AS bus,
CASE WHEN regexp_matches(p,'ECM|PCM|ECU') THEN 'engine_management' WHEN contains(p,'K') THEN CASE WHEN contains(p,'START') THEN 'starting' WHEN contains(p,'FUEL') THEN 'fuel' END WHEN contains(p,'F') THEN 'power_distribution' WHEN contains(p,'G') THEN 'ground_distribution' END AS system FROM u""", "tags")
def _(t):
    c = F.col("text")
    return t.tags.select("id", tx.infer_role(c).alias("role"), tx.infer_net(c).alias("n"), tx.infer_system(c).alias("system")).select("id", "role", "n.*", "system")


@query("f28_expected_pins", """SELECT id, CASE type WHEN 'relay' THEN '85:signal,86:power,30:power,87:power,87a:power' ELSE '' END AS pins FROM components""", "components")
def _(t):
    pins = F.array_join(F.transform("expected_pins", lambda p: F.concat_ws(":", p["name"], p["role"])), ",")
    return tx.expected_pins(t.components).select("id", pins.alias("pins"))


@query("f29_contexts", """SELECT id, concat_ws(' ', type||' '||id, 'value '||part_number, 'location '||zone, 'pin 1', 'pin 2', 'pin 3') AS component, concat_ws(' ', 'net '||lower(manufacturer), 'voltage '||CAST(CAST(voltage_rating AS INTEGER) AS VARCHAR)) AS net FROM components""", "components")
def _(t):
    none = F.lit(None).cast("string")
    pins = F.array(*[F.lit(str(i)) for i in range(1, 6)])
    return t.components.select("id", tx.component_context(F.col("type"), F.col("id"), F.col("part_number"), none, F.col("zone"), pins).alias("component"),
                               tx.net_context(F.lower("manufacturer"), F.col("voltage_rating").cast("int").cast("string"), none).alias("net"))


@query("f30_describe", """SELECT id, concat('Electronic component ',id,'. is a ',type,'. with value ',part_number,'. having pins A, B. located on page 7. detected with ',CASE WHEN coalesce(voltage_rating,0)/50>0.8 THEN 'high' WHEN coalesce(voltage_rating,0)/50>0.5 THEN 'medium' ELSE 'low' END,' confidence (',printf('%.2f',coalesce(voltage_rating,0)/50),').') AS component,
concat('Electrical net named ''',name,'''. connects 2 component pins. specifically P1 pin 1, P2 pin 2. spans across pages 1, 2. ', CASE WHEN regexp_matches(lower(name),'vcc|vdd|power|\\+|supply') THEN 'This is a power supply net providing electrical power' WHEN regexp_matches(lower(name),'gnd|ground|vss|-') THEN 'This is a ground net providing electrical reference'
WHEN regexp_matches(lower(name),'clk|clock') THEN 'This is a clock signal net for timing' WHEN regexp_matches(lower(name),'data|signal') THEN 'This is a signal net for data transmission' ELSE 'This net carries electrical signals between components' END, '. detected with high confidence (0.90).') AS net FROM components""", "components")
def _(t):
    conf = F.coalesce("voltage_rating", F.lit(0.0)) / 50
    two = F.array(F.lit("P1 pin 1"), F.lit("P2 pin 2"))
    return t.components.select("id", tx.describe_component(F.col("id"), F.col("type"), F.col("part_number"), F.array(F.lit("A"), F.lit("B")), F.lit(7), conf).alias("component"),
                               tx.describe_net(F.col("name"), F.lit(2), two, F.array(F.lit(1), F.lit(2)), F.lit(0.9)).alias("net"))


@query("f31_component_text", """SELECT id, concat_ws(' ', name, type, zone, CASE WHEN current_rating<>0 THEN concat(CAST(CAST(round(current_rating) AS BIGINT) AS VARCHAR),'A') END, manufacturer, part_number) AS text FROM components""", "components")
def _(t):
    c = t.components.withColumn("current_rating", F.round("current_rating").cast("bigint"))
    return c.select("id", tx.component_text(c, ["name", "type", "zone", "current_rating", "manufacturer", "part_number"]).alias("text"))


@query("f32_clean_ocr", r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(trim(regexp_replace(text,'\s+',' ','g')),'0hm','ohm'),'1K','1k'),'uF','µF'),'mH','mH'),'V DC','VDC'),'V AC','VAC'),'A DC','ADC'),'A AC','AAC')) AS h FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.clean_ocr(F.col("text"))).alias("h"))


@query("f33_clean_document", r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text,'\s+',' ','g'),'[^\p{L}\p{N}_\s.,;:!?\-()\[\]/\\]',' ','g') AS x FROM documents)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,'(\d+)\s*V(?:olt)?s?','\1V','gi'),'(\d+)\s*A(?:mp)?s?','\1A','gi'),'(\d+)\s*W(?:att)?s?','\1W','gi'),'(\d+)\s*(?:mm²|AWG)','\1mm²','gi'))) AS h FROM c""")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.clean_document(F.col("text"), compat=True)).alias("h"))


DICT = ", ".join(f"'{w}'" for w in tx.TECHNICAL_TERMS)


@query("f34_technical_terms", rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text),'[\p{{L}}\p{{N}}_]+'), lambda w: list_contains([{DICT}], w) OR regexp_matches(w,'^\d+[a-z]*$')))),',') AS terms FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.array_join(tx.technical_terms(F.col("text")), ",").alias("terms"))


@query("f35_technical_terms_rx", r"""SELECT id, array_to_string(list_sort(list_distinct(flatten([""" + ", ".join(f"regexp_extract_all(text,'(?i){p}')" for p in tx.TERM_PATTERNS) + r"""]))),',') AS terms FROM tags""", "tags")
def _(t):
    return t.tags.select("id", F.array_join(tx.technical_terms_rx(F.col("text")), ",").alias("terms"))


@query("f36_technical_entities", rf"""SELECT id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(lower(text),'{tx.ENTITY_WORDS}'), regexp_extract_all(text,'\b[A-Z0-9]{{5,15}}\b')))),',') AS entities FROM asked""", "asked")
def _(t):
    return t.asked.select("id", F.array_join(tx.technical_entities(F.col("text")), ",").alias("entities"))


@query("f37_extract_specs", r"""WITH l AS (SELECT id, lower(text) AS t FROM asked) SELECT id, coalesce(TRY_CAST(regexp_extract(t,'(\d+(?:\.\d+)?)\s*volt(?:age)?',1) AS DOUBLE), TRY_CAST(regexp_extract(t,'(\d+(?:\.\d+)?)\s*v(?:olt)?s?',1) AS DOUBLE)) AS voltage,
coalesce(TRY_CAST(regexp_extract(t,'(\d+(?:\.\d+)?)\s*amp(?:ere)?s?',1) AS DOUBLE), TRY_CAST(regexp_extract(t,'(\d+(?:\.\d+)?)\s*a(?:mp)?s?',1) AS DOUBLE)) AS current,
coalesce(TRY_CAST(regexp_extract(t,'(\d+(?:\.\d+)?)\s*watt(?:age)?',1) AS DOUBLE), TRY_CAST(regexp_extract(t,'(\d+(?:\.\d+)?)\s*w(?:att)?s?',1) AS DOUBLE)) AS power FROM l""", "asked")
def _(t):
    return t.asked.select("id", tx.extract_specs(F.col("text")).alias("s")).select("id", "s.*")


def _keyed_sql(table):
    parts = ", ".join(f"CASE WHEN regexp_matches(lower(text),'{'|'.join(words)}') THEN '{key}' END" for key, words in table.items())
    return f"concat_ws(',', {parts})"


EXPANDED = ", ".join(f"CASE WHEN contains(lower(text),'{k}') THEN [{', '.join(repr(w) for w in v)}] ELSE [] END" for k, v in tx.TERM_EXPANSIONS.items())
INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text),'{'|'.join(w)}') THEN '{k}'" for k, w in tx.INTENT_WORDS.items()) + \
    f" WHEN {_keyed_sql(tx.COMPONENT_SYNONYMS)} <> '' THEN 'find_component' ELSE 'general_question' END"


@query("f38_f39_query_facets", f"""SELECT id, {_keyed_sql(tx.COMPONENT_SYNONYMS)} AS component_types, {_keyed_sql(tx.ACTION_WORDS)} AS actions, {_keyed_sql(tx.LOCATION_WORDS)} AS locations,
array_to_string(list_sort(list_distinct(flatten([{EXPANDED}]))),',') AS expanded_terms, {INTENT_SQL} AS intent FROM asked""", "asked")
def _(t):
    df = tx.query_facets(t.asked, "text")
    return df.select("id", *[F.array_join(c, ",").alias(c) for c in ("component_types", "actions", "locations", "expanded_terms")], "intent")


COMPLETE = ", ".join(f"CASE WHEN regexp_matches(lower(text),'{'|'.join(k)}') THEN [{', '.join(repr(w) for w in v)}] ELSE [] END" for k, v in tx.COMPLETIONS)


@query("f40_enrich_query", "SELECT id, concat_ws(' ', text, " + ", ".join(f"CASE WHEN contains(lower(text),'{k}') THEN '{v}' END" for k, v in tx.QUERY_SYNONYMS.items()) + f""") AS enriched,
len(list_distinct(flatten([{COMPLETE}]))) AS completions, {INTENT_SQL} AS intent FROM asked""", "asked")
def _(t):
    q = F.col("text")
    return t.asked.select("id", tx.enrich_query(q).alias("enriched"), F.size(tx.completions(q, 100)).cast("bigint").alias("completions"), tx.query_intent(q).alias("intent"))


@query("f40_hints")
def _(t):
    df = tx.query_facets(t.asked, "text")
    return df.select("id", F.array_join(tx.suggestions(F.col("component_types"), F.col("specs"), F.col("intent")), "; ").alias("suggestions"),
                     F.array_join(tx.related(F.col("component_types")), "; ").alias("related"),
                     F.array_join(tx.follow_ups(F.col("intent"), F.try_element_at("component_types", F.lit(1))), "; ").alias("follow_ups"))


@query("f41_highlights", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text,'[.!?]+'), lambda v: trim(regexp_replace(v,'^\s+|\s+$','','g'))), lambda v: length(v)>=20 AND (contains(lower(v),'the') OR contains(lower(v),'ou'))) AS hit FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(hit[1:3], lambda v: regexp_replace(CASE WHEN contains(lower(v),'the') THEN regexp_replace(v,'the','**the**','gi') ELSE v END, CASE WHEN contains(lower(v),'ou') THEN 'ou' ELSE '(never)9' END,'**ou**','gi')),'|')) AS h FROM s""")
def _(t):
    return t.documents.select("doc_id", F.md5(F.array_join(tx.highlights(F.col("text"), F.lit("the ou")), "|")).alias("h"))


@query("f41_matched_fields", "SELECT id, concat_ws(',', CASE WHEN contains(lower(name),'1') OR contains(lower(name),'ecu') THEN 'name' END, CASE WHEN contains(lower(type),'1') OR contains(lower(type),'ecu') THEN 'type' END, CASE WHEN contains(lower(manufacturer),'1') OR contains(lower(manufacturer),'ecu') THEN 'manufacturer' END) AS fields FROM components", "components")
def _(t):
    return t.components.select("id", F.array_join(tx.matched_fields(t.components, ["name", "type", "manufacturer"], F.lit("1 ECU")), ",").alias("fields"))


@query("f42_explain_match", """SELECT id, concat_ws('; ', CASE WHEN current_rating/20>0.9 THEN 'Exact semantic match' WHEN current_rating/20>0.8 THEN 'Strong semantic similarity' WHEN current_rating/20>0.7 THEN 'Good semantic match' ELSE 'Relevant match' END,
CASE WHEN type IN ('relay','fuse') THEN 'Matches component type: '||type END, CASE WHEN voltage_rating<>0 THEN 'Voltage specification match' END) AS why FROM components""", "components")
def _(t):
    return t.components.select("id", tx.explain_match(F.col("current_rating") / 20, F.col("type"), F.array(F.lit("relay"), F.lit("fuse")), F.lit(12.0), F.col("voltage_rating")).alias("why"))


@query("f43_parse_llm_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def _(t):
    # cut-off, fenced and comma-ridden answers with the same content
    kind = F.pmod("event_id", F.lit(4))
    inner = F.regexp_replace("props", r"[{}]", "")
    raw = (F.when(kind == 0, F.concat(F.lit("```json\n{"), inner, F.lit(",}\n```"))).when(kind == 1, F.concat(F.lit("{"), inner))
           .when(kind == 2, F.concat(F.lit('{"lookup_table": {'), inner, F.lit(', "list": [1, 2'))).otherwise(F.col("props")))
    return t.events.select("event_id", tx.parse_llm_json(raw, "k bigint")["k"].alias("k"))


@query("f44_f45_placement", """WITH d AS (SELECT id, type, (x+40)/1200 AS nx, (y+20)/1600 AS ny, x, y, z FROM components WHERE x IS NOT NULL)
SELECT id, concat(CASE WHEN ny<0.5 THEN 'top' ELSE 'bottom' END,'-',CASE WHEN nx<0.5 THEN 'left' ELSE 'right' END) AS quadrant, CAST(CASE type WHEN 'battery' THEN 350 WHEN 'relay' THEN -350 WHEN 'fuse' THEN -350 ELSE CASE WHEN nx<0.5 THEN -400 ELSE 400 END END AS INTEGER) AS ex,
CAST(CASE type WHEN 'battery' THEN 240 WHEN 'relay' THEN 30 WHEN 'fuse' THEN 20 WHEN 'ecu' THEN 180 ELSE 40 END AS INTEGER) AS size, x<=700 AND y<=600 AND z<=800 AS ok FROM d""", "components")
def _(t):
    c = t.components.filter("x IS NOT NULL")
    b = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 80).alias("x2"), (F.col("y") + 40).alias("y2"))
    return c.select("id", geo.schematic_position(b, F.col("type"), F.lit("")).alias("p"), geo.bounds_check(F.col("x"), F.col("y"), F.col("z")).alias("c")).select(
        "id", "p.quadrant", F.col("p.estimate.x").alias("ex"), "p.size", "c.ok")


@query("f46_chunk_id", "SELECT doc_id, concat('text_', doc_id, '_', substr(md5(concat(source, '_text_', doc_id, '_0_1')),1,8)) AS chunk_id, md5(text) AS content_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.chunk_id(F.lit("text"), F.col("source"), F.col("doc_id"), F.lit(0), F.lit(1)).alias("chunk_id"), tx.content_hash(F.col("text")).alias("content_hash"))


@query("f47_section_title", r"""WITH l AS (SELECT doc_id, n_chars, list_filter(list_transform(string_split(text, chr(10))[1:3], lambda v: trim(v)), lambda v: length(v)<100 AND ((v=upper(v) AND v<>lower(v)) OR regexp_matches(v,'^\d+\.') OR regexp_matches(v,'^[A-Z][^.]{10,}$'))) AS h FROM documents)
SELECT doc_id, h[1] AS title, n_chars // 300 + 1 AS page FROM l""")
def _(t):
    return t.documents.select("doc_id", tx.section_title(F.col("text")).alias("title"), tx.page_estimate(F.col("n_chars")).alias("page"))


@query("f48_hash_embedding")
def _(t):
    return t.documents.select("doc_id", F.posexplode(tx.hash_embedding(F.col("text"), 16)).alias("i", "v"))


@query("f49_scores", """SELECT a.id, b.id AS other, round(CASE WHEN n>0 THEN s/n ELSE 0 END,8) AS electrical FROM (SELECT e.src, e.dst, coalesce(greatest(0,1-abs(a.voltage_rating-b.voltage_rating)/greatest(a.voltage_rating,b.voltage_rating)) ,0)+coalesce(least(a.current_rating,b.current_rating)/greatest(a.current_rating,b.current_rating),0)+CASE WHEN a.type=b.type THEN 0.5 ELSE 0 END AS s,
CASE WHEN a.voltage_rating IS NOT NULL AND b.voltage_rating IS NOT NULL THEN 1 ELSE 0 END+CASE WHEN a.current_rating IS NOT NULL AND b.current_rating IS NOT NULL THEN 1 ELSE 0 END+CASE WHEN a.type=b.type THEN 1 ELSE 0 END AS n FROM powered_by e JOIN components a ON a.id=e.src JOIN components b ON b.id=e.dst) q
JOIN components a ON a.id=q.src JOIN components b ON b.id=q.dst""".replace("coalesce(least(a.current_rating", "coalesce(CASE WHEN a.current_rating IS NOT NULL AND b.current_rating IS NOT NULL THEN least(a.current_rating").replace("greatest(a.current_rating,b.current_rating),0)", "greatest(a.current_rating,b.current_rating) END,0)").replace(
    "coalesce(greatest(0,1-abs", "coalesce(CASE WHEN a.voltage_rating IS NOT NULL AND b.voltage_rating IS NOT NULL THEN greatest(0,1-abs").replace("greatest(a.voltage_rating,b.voltage_rating)) ,0)", "greatest(a.voltage_rating,b.voltage_rating)) END,0)"), ("powered_by", "components"))
def _(t):
    c = t.components.select("id", F.struct("type", "voltage_rating", "current_rating").alias("s"))
    both = t.powered_by.join(c.withColumnsRenamed({"id": "src", "s": "a"}), "src").join(c.withColumnsRenamed({"id": "dst", "s": "b"}), "dst")
    return both.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.round(el.electrical_score(F.col("a"), F.col("b")), 8).alias("electrical"))


@query("f50_wire_formulas", """SELECT id, CASE WHEN voltage_rating<=12 THEN 2.0 WHEN voltage_rating<=60 THEN 5.0 WHEN voltage_rating<=300 THEN 15.0 ELSE 50.0 END::DOUBLE AS clearance, round(current_rating/(pi()*1.5*1.5/4),6) AS density, round(current_rating*current_rating*(0.0175/(pi()*1.5*1.5/4)*x/1000),6) AS loss FROM components""", "components")
def _(t):
    g = F.lit(1.5)
    return t.components.select("id", el.required_clearance(F.col("voltage_rating")).alias("clearance"), F.round(el.current_density(F.col("current_rating"), g), 6).alias("density"),
                               F.round(el.wire_loss(F.col("current_rating"), g, F.col("x")), 6).alias("loss"))
