"""What a job moves and writes must follow its input: bytes and rows of small runs, and the same results by brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wirelake.operators import chunking, graph, ivfpq, layout, ranking, schematic, search, spatial, tiles
from wirelake.session import cut


@pytest.fixture
def moved(spark):
    """Bytes shuffled, spilled and written by the stages since the fixture was made or last called."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        stages = store.stageList(None, False, False, gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() + stages.apply(i).diskBytesSpilled() + stages.apply(i).outputBytes() for i in range(stages.size())}

    seen = set(total())

    def since():
        now = total()
        fresh = sum(v for k, v in now.items() if k not in seen)
        seen.update(now)
        return fresh

    return since


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = w * h if w > 0 and h > 0 else 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


@pytest.mark.parametrize("limit", [0.0, 0.05, 0.3])
def test_groups_of_boxes_over_tiles_and_sizes(spark, limit):
    rnd = random.Random(5)
    rows = [("d", -3.0, -3.0, -3.0, 5.0), ("d", None, 0.0, 4.0, 4.0), ("d", float("nan"), 0.0, 4.0, 4.0), (None, 0.0, 0.0, 9.0, 9.0), (None, 0.0, 0.0, 9.0, 9.0), (None, 1.0, 0.0, 9.0, 9.0)]
    for doc in "de":
        for _ in range(120):  # a wide range of sizes on a plane of many tiles
            side = 4.0 * 2.0 ** rnd.uniform(0, 11)
            x, y = rnd.uniform(-9000, 9000), rnd.uniform(-9000, 9000)
            rows += [(doc, x + i * side / 4, y, x + i * side / 4 + side, y + side) for i in range(rnd.randint(1, 4))]
        rows += [(doc, 7.0 * i, 0.0, 7.0 * i + 20.0, 20.0) for i in range(400)]  # one chain through many tiles
    rows += rows[20:60]
    boxes = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, doc string, x1 double, y1 double, x2 double, y2 double")
    got = {r.n: r.group for r in schematic.group_boxes(boxes, ["doc"], limit).collect()}
    assert len(got) == len(rows)
    whole = [i for i, r in enumerate(rows) if r[0] and None not in r and r[1] == r[1]]
    root = {i: i for i in whole}

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a in whole:
        for b in whole:
            if a < b and rows[a][0] == rows[b][0] and (rows[a] == rows[b] or _iou(rows[a][1:], rows[b][1:]) > limit):
                root[find(a)] = find(b)
    want, have = {}, {}
    for i in whole:
        want.setdefault(find(i), set()).add(i)
        have.setdefault(got[i], set()).add(i)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))
    assert got[3] == got[4] != got[5] and len({got[1], got[2]}) == 2


def test_groups_of_boxes_move_each_box_once(spark, moved):
    """pairs of wide rows in grid cells moved about 950 bytes a box."""
    n = 60000
    at = spark.range(n).select((F.col("id") % 40).alias("doc"), (F.col("id") / 40).cast("bigint").alias("p"))
    boxes = at.select("doc", *[((F.col("p") % 20) * 50 + d).cast("double").alias(c) for c, d in (("x1", 0), ("x2", 60))],
                      *[(F.floor(F.col("p") / 20) * 20 + d).cast("double").alias(c) for c, d in (("y1", 0), ("y2", 14))])
    moved()
    assert schematic.group_boxes(boxes, ["doc"], 0.05).groupBy("group").count().count() == n / 20
    assert moved() < 150 * n


def _layout(spark, copies):
    at = spark.range(30).crossJoin(spark.range(copies).select(F.col("id").alias("copy")))
    return at.select(
        F.lit("L").alias("layout_id"), F.concat_ws("-", "id", "copy").alias("id"), *[(F.col("id") * k % m).cast("double").alias(a) for a, k, m in (("x", 37, 140), ("y", 53, 90), ("z", 71, 120))],
        F.element_at(F.array(*[F.lit(v) for v in ("battery", "fuse", "ecu")]), (F.col("id") % 3 + 1).cast("int")).alias("type"),
        ((F.col("id") + F.col("copy")) % 4 * 100.0).alias("voltage"), F.lit(0).alias("maintenance"))


def test_layouts_with_many_parts_at_one_place(spark):
    """F4 to F7: all pairs of parts, copied to 27 cells each, met on the driver or in one join."""
    copies = 5
    df = layout.with_physical_defaults(_layout(spark, copies)).cache()
    wires = spark.createDataFrame([], "layout_id string, wire_id string, length double, gauge double, current double, bends int, cost double")
    got = layout.layout_scores(df, wires).first()
    fit = layout.layout_fitness(df, spark.createDataFrame([], "src string, dst string"), (1000.0, 1000.0, 1000.0)).first()
    rows = [r.asDict() for r in df.collect()]
    far = lambda a, b: math.dist([a[k] for k in "xyz"], [b[k] for k in "xyz"])
    need = lambda v: 2.0 if v <= 12 else 5.0 if v <= 60 else 15.0 if v <= 300 else 50.0
    pairs = list(itertools.combinations(rows, 2))
    lack = sum(max(0.0, 1 - far(a, b) / need(max(a["voltage"], b["voltage"]))) for a, b in pairs if far(a, b) <= 50)
    assert got.clearance_violations == sum(max(a["voltage"], b["voltage"]) > 60 and far(a, b) < 50 for a, b in pairs)
    reach = sum(min(min(min(r[k], 1000 - r[k]) for k in "xyz") / 100, 1.0) for r in rows if r["maintenance"] > 0) or 1.0
    assert got.safety == pytest.approx((1 - lack / len(pairs)) * 0.3 + 0.25 + 0.0 + 0.12 + reach * 0.1)  # every hot part has a copy at its place
    assert fit.collisions == sum(all(abs(a[k] - b[k]) <= (a["d" + k] + b["d" + k]) / 2 for k in "xyz") for a, b in pairs)
    assert fit.emi_score == pytest.approx(1 - min(sum(a["emi"] * b["emi"] / (far(a, b) ** 2 + 1) for a, b in pairs) / len(rows) ** 2, 1.0))
    assert fit.access_score == pytest.approx(0.0)


def test_layouts_move_places_not_parts(spark, moved):
    wires = spark.createDataFrame([], "layout_id string, wire_id string, length double, gauge double, current double, bends int, cost double")
    layout.layout_scores(layout.with_physical_defaults(_layout(spark, 10)), wires).collect()
    few = moved()
    layout.layout_scores(layout.with_physical_defaults(_layout(spark, 2000)), wires).collect()
    assert moved() < 4 * few


def test_cells_around_a_row_are_not_broadcast(spark):
    """27 copies of each row were broadcast, as Spark takes them for one."""
    rows = spark.range(100).select(F.lit("V").alias("vehicle_signature"), F.col("id").cast("string").alias("id"), *[(F.col("id") * k).cast("double").alias(a) for a, k in (("x", 3), ("y", 5), ("z", 7))])
    pairs = spatial.within_radius(rows, rows, 20.0)
    assert "SortMergeJoin" in pairs._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().toString()
    assert pairs.count() == sum(math.dist((3 * i, 5 * i, 7 * i), (3 * j, 5 * j, 7 * j)) <= 20 for i in range(100) for j in range(100) if i != j)


def test_readings_are_shuffled_once(spark):
    """F8, F18, F19: readings went through one shuffle per engine, with each text twice, and one per region."""
    rows = [(p, e, t, c) for p in range(6) for e, t, c in (("a", f"w{p}", 0.95), ("a", "old", 0.2), ("b", f"v{p}" if p % 2 else f"w{p}", 0.5), ("c", "w", None))]
    df = spark.createDataFrame(rows, "pos int, engine string, text string, confidence double")
    differ = schematic.ocr_disagreement(df, ["pos"])
    positive, negative = chunking.contrastive_pairs(df, ["pos"], 0.4)
    for out in (differ, positive, negative):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.pos, r.engine_count, r.unique_results, round(r.confidence_difference, 9)) for r in differ.collect()} == {(p, 3, 3 if p % 2 else 2, 0.45) for p in range(6)}
    assert {(r.pos, r.a, r.b) for r in positive.collect()} == {(p, f"w{p}", f"v{p}" if p % 2 else f"w{p}") for p in range(6)}
    assert {(r.pos, r.a, r.gap) for r in negative.collect()} == {(p, f"w{p}", 0.45) for p in range(6)}


def test_page_files_are_small(spark, moved):
    """pages were written as plain JSON and whole texts joined, 9 MB on the smallest tables."""
    df = entry.queries()["s08_ocr_pages"](spark, "/root/testdata/sf0.001")
    assert df.count() == 200
    assert moved() < 5e6


def test_paths_are_counted_without_a_row_each(spark, moved):
    rnd = random.Random(3)
    pairs = {(f"n{rnd.randrange(400)}", f"n{rnd.randrange(400)}", "CONNECTS_TO") for _ in range(2400)}
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string, rel_type string")
    parts = spark.createDataFrame([(f"n{i}", "V", "battery" if i % 6 == 0 else "fuse") for i in range(400)], "id string, vehicle_signature string, type string")
    moved()
    assert sum(r.path_count for r in graph.path_efficiency(edges, parts).collect()) > 400_000
    assert moved() < 9_000_000


def test_only_the_first_long_paths_are_listed(spark, moved):
    rnd = random.Random(4)
    edges = spark.createDataFrame(sorted({(f"n{rnd.randrange(400)}", f"n{rnd.randrange(400)}", "W") for _ in range(2400)}), "src string, dst string, rel_type string")
    starts = edges.selectExpr("src AS start").distinct()
    moved()
    assert len(graph.long_paths(edges, starts, 3, 5, 4).collect()) == 5
    assert moved() < 1_500_000


def test_labels_near_segments_of_many_lengths(spark, moved):
    rnd = random.Random(8)
    segments = [(d, f"s{i % 25}", x, y, x + rnd.uniform(-1, 1) * w, y + rnd.uniform(-1, 1) * w) for d in "de" for i in range(60) for x, y, w in [(rnd.uniform(-900, 900), rnd.uniform(-900, 900), 2.0 ** rnd.uniform(0, 13))]]
    segments += [("d", "flat", 0.0, 20.0 * i, 900.0, 20.0 * i) for i in range(40)] + [("e", "point", 5.0, 5.0, 5.0, 5.0)]
    spans = [(d, i, x, y, x + 30.0, y + 14.0) for d in "de" for i in range(500) for x, y in [(rnd.uniform(-900, 900), rnd.uniform(-900, 900))]]
    want = {}
    for d, net, x1, y1, x2, y2 in segments:
        for e, n, a, b, c, f in spans:
            if d == e:
                x, y, l2 = (a + c) / 2, (b + f) / 2, (x2 - x1) ** 2 + (y2 - y1) ** 2
                u = min(1.0, max(0.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / l2)) if l2 else 0.0
                dist = math.hypot(x - x1 - u * (x2 - x1), y - y1 - u * (y2 - y1))
                if dist <= 30.0:
                    want[d, net, n] = min(dist, want.get((d, net, n), dist))
    of = "doc string, net_id string, x1 double, y1 double, x2 double, y2 double"
    got = spatial.net_label_pairs(spark.createDataFrame(segments, of), spark.createDataFrame(spans, "doc string, span_id int, x1 double, y1 double, x2 double, y2 double"), ["doc"])
    assert {(r.doc, r.net_id, r.span_id): r.distance for r in got.collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}

    # lines of text under ruled lines: what is moved follows the texts, not the grids
    page = spark.range(40_000).selectExpr("'d' || id % 20 AS doc", "id AS span_id", "id % 7 * 120.0D AS x1", "id * 3.0D AS y1", "id % 7 * 120.0D + 40 AS x2", "id * 3.0D + 14 AS y2")
    ruled = spark.range(2_000).selectExpr("'d' || id % 20 AS doc", "'n' || id AS net_id", "0.0D AS x1", "id * 60.0D AS y1", "50 * pow(2.0D, id % 5) AS x2", "id * 60.0D AS y2")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        moved()
        assert spatial.net_label_pairs(ruled, page, ["doc"], 20.0).count() > 500
        assert moved() < 3_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _vectors(spark, rows, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(rows, 32)))], "vec_id long, embedding array<double>")


def test_approximate_search_sends_each_query_once_per_bundle(spark, moved):
    v = cut(_vectors(spark, 2000, 3))
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    moved()
    found = ivfpq.ivf_topk(q, v, 10, probe=0.6, refine=100).collect()
    assert moved() < 8e6
    x = ivfpq.unit_rows(v.orderBy("vec_id").toArrow().column("embedding").combine_chunks())
    exact = np.argsort(-(x @ x.T), axis=1)[:, :10]
    got = {(r.query_id, r.vec_id) for r in found}
    assert len(found) == 20000 and np.mean([(i, j) in got for i, row in enumerate(exact.tolist()) for j in row]) >= 0.9


def test_exact_search_copies_rows_to_few_tiles(spark, moved):
    v = cut(_vectors(spark, 6000, 4))
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    moved()
    found = search.cosine_topk(q, v, 10).collect()
    assert moved() < 8e6 and len(found) == 60000
    x = ivfpq.unit_rows(v.orderBy("vec_id").toArrow().column("embedding").combine_chunks())
    assert {(r.query_id, r.vec_id) for r in found} == {(i, j) for i, row in enumerate(np.argsort(-(x @ x.T), axis=1)[:, :10].tolist()) for j in row}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_in_tile_with_ties(k):
    scores = np.random.default_rng(5).integers(0, 4, (30, 20)).astype(float)
    scores[3], scores[4, 5:], scores[5, ::3] = -np.inf, -np.inf, np.nan
    rows, cols = tiles.best_in_tile(scores, k)
    want = [(i, j) for i in range(30) for j in sorted((j for j in range(20) if np.isfinite(scores[i, j])), key=lambda j: (-scores[i, j], j))[:k]]
    assert list(zip(rows.tolist(), cols.tolist())) == want


def test_nearby_spans_are_shuffled_once(spark, moved):
    rnd = random.Random(8)
    rows = [(p or None, i, f"word{rnd.randint(0, 9)}", "e", 0.5, x, y, x + 40.0, y + 14.0)
            for p in range(30) for i in range(400) for x, y in [(50.0 * rnd.randint(0, 19), 20.0 * rnd.randint(0, 60))]]
    spans = cut(spark.createDataFrame(rows, "doc int, pos int, text string, engine string, confidence double, x1 double, y1 double, x2 double, y2 double"))
    moved()
    got = {(r.doc, r.pos): r.grp for r in ranking.group_nearby_spans(spans, ["doc"]).collect()}
    assert moved() < 5e5
    want = {}
    for page in {r[0] for r in rows}:
        group, last = 0, None
        for r in sorted((r for r in rows if r[0] == page), key=lambda r: (r[6], r[5], r[1])):
            gap = r[6] - last[8] if last else 0
            group += bool(last) and not (gap < 30 and (not (r[7] < last[5] or r[5] > last[7]) or gap < 10))
            want[page, r[1]], last = group, r
    assert got == want


def test_path_lengths_write_little(spark, moved):
    rnd = random.Random(9)
    rows = {(f"node-{rnd.randint(0, 399)}", f"node-{rnd.randint(0, 399)}") for _ in range(900)} | {("x", "x"), ("x", "y"), ("y", "z")}
    asked = [(f"node-{rnd.randint(0, 399)}", f"node-{rnd.randint(0, 399)}") for _ in range(300)] + [("x", "x"), ("x", "z"), ("x", "node-1"), ("new", "new"), ("new", "x"), (None, "x")]
    edges = cut(spark.createDataFrame([(*r, "R") for r in sorted(rows)], "src string, dst string, rel_type string"))
    pairs = cut(spark.createDataFrame(asked, "source string, target string"))
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for depth in (1, 3, 6):
        want = {}
        for s, t in set(asked):
            level, seen = {s} if s else set(), set()
            for n in range(depth + 1):
                if t in level:
                    want[s, t] = n
                    break
                seen |= level
                level = {b for a in level for b in near.get(a, ())} - seen
        moved()
        found = graph.shortest_paths(edges, pairs, depth, with_nodes=False).collect()
        assert len(found) == len(want) and {(r.source, r.target): r.path_length for r in found} == want
        assert moved() < 6e5
