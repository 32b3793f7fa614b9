"""Order-dependent helpers against plain Python, with one key that holds most rows."""

import random

from pyspark.sql import functions as F

from wirelake.operators.graph import connected_components
from wirelake.scale import lag_rows, number_rows, running_sum, top_rows


def rows(n=600):
    rng = random.Random(5)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i * 7 % n, rng.randrange(10)) for i in range(n)]


def grouped(data):
    out = {}
    for k, o, v in sorted(data, key=lambda r: (r[0], r[1])):
        out.setdefault(k, []).append((o, v))
    return out


def test_number_lag_and_sum(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, o int, v int")
    order = [F.col("o")]
    want_rn, want_lag, want_sum = {}, {}, {}
    for k, items in grouped(data).items():
        total, before = 0, None
        for i, (o, v) in enumerate(items, 1):
            total += v
            want_rn[k, o], want_lag[k, o], want_sum[k, o] = i, before, total
            before = v
    assert {(r.k, r.o): r.rn for r in number_rows(df, "k", order).collect()} == want_rn
    assert {(r.k, r.o): r.b for r in lag_rows(df, "k", order, {"b": "v"}).collect()} == want_lag
    assert {(r.k, r.o): r.s for r in running_sum(df, "k", order, F.col("v"), "s").collect()} == want_sum


def test_number_without_key(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("x"))
    got = [(r.x, r.rn) for r in number_rows(df, [], [F.col("x")]).collect()]
    assert sorted(got) == [(x, i) for i, x in enumerate(sorted(x for x, _ in got), 1)]


def test_top_rows_limits_before_shuffle(spark):
    df = spark.createDataFrame(rows(), "k string, o int, v int")
    plan = top_rows(df, "k", [F.col("o")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_components_of_random_graph(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(55)] + [("hub", f"n{i}") for i in range(20)]
    nodes = sorted({x for e in edges for x in e} | {f"n{i}" for i in range(80)})
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string"))
    assert {r.id: r.component for r in got.collect()} == {x: find(x) for x in nodes}
