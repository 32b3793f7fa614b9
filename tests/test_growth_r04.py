"""Cases of the review r04: odd rows against SQL, and steps whose work grew faster than their input."""

import glob
import os

import numpy as np
import pyarrow as pa
from compare import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wirelake.functions import text as tx
from wirelake.operators import evaluate, graph, schematic, spatial

SMALL = "/root/testdata/sf0.001"


def with_table(spark, path, name, df):
    """The smallest tables with another one in place of ``name``."""
    for file in glob.glob(f"{SMALL}/*.parquet"):
        if os.path.basename(file) != f"{name}.parquet":
            os.symlink(file, path / os.path.basename(file))
    df.coalesce(1).write.parquet(str(path / "made"))
    os.symlink(glob.glob(str(path / "made/*.parquet"))[0], path / f"{name}.parquet")
    return str(path)


def test_submissions_with_blank_and_padded_texts(spark, tmp_path):
    docs, n = spark.read.parquet(f"{SMALL}/documents.parquet"), F.col("doc_id") % 9
    text = (F.when(n == 1, "").when(n == 2, F.lit(None)).when(n == 3, "  ").when(n == 4, F.concat(F.lit("\u00a0"), "text", F.lit("\u3000 ")))
            .when(n == 5, F.concat(F.lit("\t"), "text", F.lit("\n"))).when(n == 6, "\u00a0 ").otherwise(F.col("text")))
    source = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit(" "), "source")).when(F.col("doc_id") % 5 == 2, "").otherwise(F.col("source"))
    sf = with_table(spark, tmp_path, "documents", docs.withColumns({"text": text, "source": source}))
    key = "s22_submissions_to_posts"
    assert differences(entry.queries()[key](spark, sf), connect(sf), entry.oracle_sql()[key]) == []


def test_profiles_of_events_without_a_type(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").filter("user_id < 5")
    sf = with_table(spark, tmp_path, "events", events.withColumn("event_type", F.when(F.col("event_id") % 7 != 3, F.col("event_type"))))
    key = "t06_profile_state"
    assert differences(entry.queries()[key](spark, sf), connect(sf), entry.oracle_sql()[key]) == []


def test_box_pairs_of_long_wide_and_tall_boxes(spark):
    rng = np.random.default_rng(4)
    low = rng.uniform(-500, 3000, (400, 2)).round(1)
    extent = np.where(rng.random((400, 2)) < 0.3, rng.uniform(0, 2500, (400, 2)), rng.uniform(0, 40, (400, 2))).round(1)
    rows = [(i % 2, i, float(x), float(y), float(x + w), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(low, extent))]
    df = spark.createDataFrame(rows, "page int, id int, x1 double, y1 double, x2 double, y2 double")
    for pad in (0.0, 4.0):
        want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and all(a[k] - pad <= b[k + 2] + pad and b[k] - pad <= a[k + 2] + pad for k in (2, 3))}
        got = [tuple(r) for r in spatial.box_pairs(df, df, ["page"], (50.0, 30.0), pad).select("a.id", "b.id").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_box_pairs_does_not_meet_all_lines_of_a_column(spark):
    # 2,000 wide lines above each other touch nothing but themselves: the join must not make their square
    lines = spark.range(2000).select(F.lit(0).alias("page"), "id", F.lit(0.0).alias("x1"), (F.col("id") * 20.0).alias("y1"), F.lit(20000.0).alias("x2"), (F.col("id") * 20.0).alias("y2"))
    pairs = spatial.box_pairs(lines, lines, ["page"], (200.0, 64.0), 4.0)
    assert pairs.count() == 2000
    text = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert all("_gx" in line and "_gy" in line for line in text.split("\n") if "Join Inner" in line)


def test_near_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    for axes in ("xy", "xyz"):
        rows = [(int(i) % 2, int(i), *(float(v) for v in p)) for i, p in enumerate(np.r_[rng.integers(-40, 40, (150, 3)), rng.uniform(-40, 40, (150, 3))])]
        df = spark.createDataFrame(rows, "page int, id int, x double, y double, z double")
        n = len(axes)
        want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and sum((a[2 + k] - b[2 + k]) ** 2 for k in range(n)) ** 0.5 <= 8.0}
        got = [tuple(r) for r in spatial.near_pairs(df, df, 8.0, ["page"], axes).select("a.id", "b.id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        # copies of the right side: four in the plane and eight in space at most, nine and 27 before
        plan = spatial.near_pairs(df, df, 8.0, ["page"], axes)._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" in plan


def test_farthest_points_of_many_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(f"v{g}", 5.0, float(20 * k)) for g in range(3000) for k in range(2 + g % 4)]
    odd = {f"o{g}": rng.integers(0, 30, (int(rng.integers(1, 60)), 2)).astype(float) for g in range(40)}
    rows += [(g, float(x), float(y)) for g, p in odd.items() for x, y in {tuple(q) for q in p}]
    df = spark.createDataFrame(rows, "wire_id string, x double, y double")
    for share in (50000, 20):
        got = {r["wire_id"]: (r["x1"], r["y1"], r["x2"], r["y2"]) for r in schematic._farthest(df, "wire_id", share).collect()}
        assert len(got) == 3040
        assert all(got[f"v{g}"] == (5.0, 0.0, 5.0, 20.0 * (1 + g % 4)) for g in range(3000))
        for g, p in odd.items():
            want = max(np.hypot(*(a - b)) for a in p for b in p)
            assert abs(np.hypot(got[g][0] - got[g][2], got[g][1] - got[g][3]) - want) < 1e-9
    # one Python call per bucket of points, not one per group
    plan = schematic._farthest(df, "wire_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "_bucket" in plan


def test_components_of_pages_and_of_a_large_page(spark):
    rng = np.random.default_rng(7)
    nodes = [(p, f"{p}:{i}") for p in range(30) for i in range(40)]
    links = [(p, f"{p}:{a}", f"{p}:{b}") for p in range(30) for a, b in rng.integers(0, 40, (25 if p else 400, 2))]
    v = spark.createDataFrame(nodes, "page int, id string")
    e = spark.createDataFrame(links, "page int, src string, dst string")
    want = {tuple(r) for r in graph.connected_components(v.select("id"), e.select("src", "dst")).collect()}
    for limit in (500_000, 100):  # with 100 the first page goes through the rounds, and the others come in several pieces
        got = [tuple(r) for r in graph.components_by_key(v, e, ["page"], limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_word_distances_need_no_search_where_a_bound_decides(monkeypatch):
    rng = np.random.default_rng(8)
    lists = [[f"w{k}" for k in rng.integers(0, 12, rng.integers(0, 14))] for _ in range(300)]
    others = [[w if rng.random() < 0.7 else f"w{rng.integers(0, 12)}" for w in words if rng.random() < 0.9] for words in lists]
    lists, others = [None, ["a"], None, []] + lists, [["a"], None, None, []] + others

    def plain(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, b in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        return row[-1]

    arrays = [pa.array(c, pa.list_(pa.string())) for c in (lists, others)]
    want = [None if x is None or y is None else plain(x, y) for x, y in zip(lists, others)]
    assert tx.word_distances(*arrays).to_pylist() == want
    assert tx.word_distances(*[c.slice(2) for c in arrays]).to_pylist() == want[2:]
    # misread and missing words are counted, not searched
    monkeypatch.setattr(tx, "word_distance", None)
    words = [f"w{k}" for k in range(5000)]
    misread = [w + "x" if k % 7 == 0 else w for k, w in enumerate(words)]
    assert tx.word_distances(pa.array([words, words]), pa.array([misread, words[::3]])).to_pylist() == [715, 3333]


def test_ocr_matches_of_small_and_large_samples(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(60)]
    seen = [(s, [words[k] for k in rng.integers(0, 60, 12)]) for s in range(8)] + [(8, [])]
    known = {s: [words[k] for k in rng.integers(0, 60, 15)] for s in range(9)}

    def close(x, y):
        d = tx.word_distances(pa.array([list(x)]), pa.array([list(y)]))[0].as_py()
        return d / max(len(x), len(y)) <= 0.2

    rows = [(s, a, known[s], len(a) + 1, len(known[s])) for s, a in seen]
    df = spark.createDataFrame(rows, "s int, seen array<string>, known array<string>, detected_count long, expected_count long")
    for small in (512, 0):
        got = {r["s"]: (r["precision"], r["recall"]) for r in evaluate.ocr_matches(df, ["s"], 0.2, small).collect()}
        for s, a, b, n, m in rows:
            want = (sum(any(close(x, y) for y in b) for x in a) / n, sum(any(close(x, y) for x in a) for y in b) / m)
            assert np.allclose(got[s], want)


def test_ocr_evaluation_with_a_null_text(spark):
    spans = spark.createDataFrame([("a", 1, 0, "one"), ("a", 1, 1, "twq words"), ("b", 1, 0, None), ("b", 1, 1, "two")], "engine string, page int, pos int, text string")
    truth = spark.createDataFrame([(1, "d", 0, "one"), (1, "d", 1, "two words")], "page int, lang string, pos int, text string")
    got = {(r["engine"], r["lang"]): r for r in evaluate.ocr_evaluation(spans, truth, ["page"], "lang").collect()}
    assert set(got) == {("a", None), ("b", None), (None, "d"), (None, None)}
    a, b = got["a", None], got["b", None]
    assert (a["avg_precision"], a["avg_recall"], a["avg_f1"]) == (1.0, 1.0, 1.0) and a["avg_wer"] == 1 / 3 and a["avg_cer"] == 1 / 13
    assert (b["avg_precision"], b["avg_recall"], b["avg_f1"]) == (0.0, 0.0, 0.0) and got[None, "d"]["samples"] == 2


def test_k_paths_meet_in_the_middle(spark, monkeypatch):
    # the distances of all nodes around each target are not needed: the halves meet
    monkeypatch.setattr(graph, "bfs", None)
    rng = np.random.default_rng(10)
    links = sorted({(f"n{a}", f"n{b}") for a, b in rng.integers(0, 12, (22, 2)) if a != b} | {("x0", "x1"), ("x1", "x2"), ("x2", "x3"), ("x3", "x4"), ("x4", "x5"), ("x5", "x6")})
    edges = spark.createDataFrame([(a, b, "W") for a, b in links], "src string, dst string, rel_type string")
    asked = [("n1", "n5"), ("n2", "n9"), ("n3", "n4"), ("x0", "x5"), ("x0", "x6"), ("n1", "x1"), ("n1", "none")]
    for k, depth in ((4, 5), (1000, 4)):
        want = {}
        for s, t in asked:
            trails, stack = [], [(s, (), (s,))]
            while stack:
                node, used, nodes = stack.pop()
                if used and node == t:
                    trails.append((len(used), ">".join(nodes)))
                if len(used) < depth:
                    for i, (a, b) in enumerate(links):
                        if i not in used and node in (a, b):
                            other = b if node == a else a
                            stack.append((other, (*used, i), (*nodes, other)))
            want |= {(s, t, rank): found for rank, found in enumerate(sorted(trails)[:k], 1)}
        rows = graph.k_paths(edges, spark.createDataFrame(asked, "source string, target string"), k, depth).collect()
        assert {(r["source"], r["target"], r["path_index"]): (r["path_length"], ">".join(r["path_nodes"])) for r in rows} == want
        assert len(rows) == len(want) and all(len(r["path_relationships"]) == r["path_length"] for r in rows)
