"""System dependencies on graphs with cycles, density clusters, and box joins of very different sizes, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirelake.operators import density, dependency, spatial

EDGE = "vehicle_signature string, src string, dst string"


def reach(edges, nodes):
    seen = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in seen[n]:
                    seen[n].add(b)
    return seen


def longest(links, group, memo):
    """Links on the longest way to a group."""
    if group not in memo:
        memo[group] = max((longest(links, a, memo) + 1 for a, b in links if b == group), default=0)
    return memo[group]


def test_groups_depths_and_paths(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for tenant in ("V1", "V2"):  # both use the same ids
        edges = {(f"n{rng.randrange(24):02d}", f"n{rng.randrange(24):02d}") for _ in range(30)} | {("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("c2", "d0"), ("d0", "d1"), ("d1", "d0"), ("d1", "e"), ("self", "self")}
        rows += [(tenant, a, b) for a, b in edges]
        nodes = sorted({x for e in edges for x in e})
        seen = reach(edges, nodes)
        group = {n: min(m for m in nodes if m in seen[n] and n in seen[m]) for n in nodes}
        links, memo = {(group[a], group[b]) for a, b in edges if group[a] != group[b]}, {}
        want[tenant] = (group, links, {g: longest(links, g, memo) for g in set(group.values())})
    edges = spark.createDataFrame(rows + rows[:3] + [("V1", None, "n01")], EDGE)
    groups = dependency.strong_groups(edges)
    links = dependency.group_links(edges, groups)
    levels = dependency.depths(groups, links)
    path = sorted((r.vehicle_signature, r.step, r.group) for r in dependency.critical_paths(levels).collect())
    for tenant, (group, wanted, depth) in want.items():
        assert {r.id: r.group for r in groups.filter(F.col("vehicle_signature") == tenant).collect()} == group
        assert {(r.src, r.dst) for r in links.filter(F.col("vehicle_signature") == tenant).collect()} == wanted
        assert {r.group: r.depth for r in levels.filter(F.col("vehicle_signature") == tenant).collect()} == depth
        chain = [g for t, _, g in path if t == tenant]
        assert [s for t, s, _ in path if t == tenant] == list(range(max(depth.values()) + 1))
        assert all(pair in wanted for pair in zip(chain[:-1], chain[1:], strict=True)) and depth[chain[-1]] == len(chain) - 1
    assert dependency.strong_groups(edges.limit(0)).count() == 0


def plain_clusters(rows, eps, least):
    x = np.array([r[1:] for r in rows])
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, [r[0] for r in rows], -1)
    while True:
        new = np.array([min(label[j] for j in range(len(x)) if near[i, j] and core[j]) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    out = {}
    for i, r in enumerate(rows):
        around = [label[j] for j in range(len(x)) if near[i, j] and core[j]]
        out[r[0]] = (int(label[i]), "core") if core[i] else (int(min(around)), "border") if around else (-1, "noise")
    return out


@pytest.mark.parametrize("tile", [7, 2048])
def test_density_clusters(spark, monkeypatch, tile):
    monkeypatch.setattr(density, "TILE", tile)
    rng = np.random.default_rng(tile)
    centres = rng.uniform(-3, 3, (5, 3))
    x = np.concatenate([centres[i % 5] + rng.normal(0, 0.2 + 0.1 * (i % 3), (1, 3)) for i in range(170)] + [rng.uniform(-4, 4, (50, 3)), np.full((20, 3), 9.0)])
    rows = [(i + 1, *map(float, v)) for i, v in enumerate(x)]
    odd = [(900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0), (None, 9.0, 9.0, 9.0)]
    table = spark.createDataFrame(rows + odd, "k long, a double, b double, c double")
    got = {r.k: (r.cluster, r.kind) for r in density.density_clusters(table, "k", ["a", "b", "c"], 0.5, 5).collect()}
    assert got == plain_clusters(rows, 0.5, 5)
    assert density.density_clusters(table.limit(0), "k", ["a", "b", "c"]).count() == 0


def test_boxes_of_very_different_sizes(spark):
    rng = random.Random(9)
    rows = [(f"p{i:03d}", "V", rng.uniform(0, 3), rng.uniform(0, 3), rng.uniform(0, 3), *[rng.choice([0.005, 0.02, 0.3])] * 3) for i in range(150)] + [("big", "V", 1.0, 1.0, 1.0, 5.0, 0.5, 0.5), ("huge", "V", 1.0, 1.0, 1.0, 900.0, 900.0, 900.0)]
    boxes = spark.createDataFrame(rows, "id string, vehicle_signature string, x double, y double, z double, dx double, dy double, dz double")
    touch = lambda a, b: all(abs(a[2 + k] - b[2 + k]) <= (a[5 + k] + b[5 + k]) / 2 for k in range(3))
    got = [(r.a_id, r.b_id) for r in spatial.collisions(boxes, ["vehicle_signature"]).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and touch(a, b)}
    flat = boxes.select("id", (F.col("x") - F.col("dx") / 2).alias("x1"), (F.col("y") - F.col("dy") / 2).alias("y1"), (F.col("x") + F.col("dx") / 2).alias("x2"), (F.col("y") + F.col("dy") / 2).alias("y2"), F.lit(1).alias("page"))
    pairs = [(r.a.id, r.b.id) for r in spatial.box_pairs(flat, flat, ["page"], 0.1, 0.01).collect()]
    sides = {r.id: r for r in flat.collect()}
    near = lambda p, q: p.x1 - 0.01 <= q.x2 + 0.01 and q.x1 - 0.01 <= p.x2 + 0.01 and p.y1 - 0.01 <= q.y2 + 0.01 and q.y1 - 0.01 <= p.y2 + 0.01
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, j) for i, p in sides.items() for j, q in sides.items() if near(p, q)}
