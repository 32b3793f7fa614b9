"""Queries whose work grew faster than their input: results by brute force, and what they move or compare on small tables."""

import random

from test_dependency_density import longest, reach
from test_growth import moved  # noqa: F401

from wirelake.operators import dependency, ranking, spatial, tiles


def test_circuit_hierarchy_makes_no_rows_per_pair_of_circuits(spark, moved):  # noqa: F811
    rng = random.Random(5)
    part_of = {(t, f"p{rng.randrange(12):02d}", f"c{rng.randrange(14):02d}"): rng.random() < 0.5 for t in ("V1", "V2") for _ in range(26)}
    powered = {(t, f"p{rng.randrange(12):02d}", f"p{rng.randrange(12):02d}") for t in ("V1", "V2") for _ in range(9)}
    members = spark.createDataFrame([(t, p, c, k) for (t, p, c), k in part_of.items()], "vehicle_signature string, src string, dst string, is_critical boolean")
    lines = spark.createDataFrame([*powered, *sorted(powered)[:2], ("V1", "p01", None)], "vehicle_signature string, src string, dst string")
    got = {(r.vehicle_signature, r.circuit_id): (r.component_count, r.critical_count, r.parent_circuits, r.child_circuits, r.dependency_depth) for r in dependency.circuit_hierarchy(members, lines).collect()}
    for t in ("V1", "V2"):
        down = {(b, a) for u, p, q in powered if u == t for (v, m, a), k in part_of.items() if v == t and m == p and k for (w, n, b) in part_of if w == t and n == q and a != b}
        nodes = sorted({x for e in down for x in e})
        seen = reach(down, nodes)
        group = {n: min(m for m in nodes if m in seen[n] and n in seen[m]) for n in nodes}
        ways, memo = {(group[a], group[b]) for a, b in down if group[a] != group[b]}, {}
        for c in {c for u, _, c in part_of if u == t}:
            here = [k for (u, _, d), k in part_of.items() if (u, d) == (t, c)]
            want = (len(here), sum(here), sum(b == c for _, b in down), sum(a == c for a, _ in down), longest(ways, group[c], memo) if c in group else 0)
            assert got[t, c] == want
    # a part of 1,500 circuits feeds one that is critical in 1,500: 2.25 million pairs
    wide = spark.range(3000).selectExpr("'V' AS vehicle_signature", "IF(id < 1500, 'a', 'b') AS src", "concat('c', id) AS dst", "true AS is_critical")
    moved()
    rows = dependency.circuit_hierarchy(wide, spark.createDataFrame([("V", "a", "b")], "vehicle_signature string, src string, dst string")).collect()
    assert moved() < 20_000_000
    assert {(r.parent_circuits, r.child_circuits, r.dependency_depth) for r in rows} == {(1500, 0, 1), (0, 1500, 0)}


def test_components_of_one_place_are_compared_once(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(f"p{rng.randrange(70):02d}", rng.choice(["V1", "V2"]), *[float(rng.randrange(4) * 40)] * 2, float(rng.randrange(2) * 60), rng.choice([None, 10.0, 90.0])) for _ in range(90)]
    rows += [("q1", "V1", None, 0.0, 0.0, 10.0), (None, "V1", 0.0, 0.0, 0.0, 10.0)]
    parts = spark.createDataFrame(rows, "id string, vehicle_signature string, x double, y double, z double, size double")
    far = lambda a, b: sum((a[i] - b[i]) ** 2 for i in (2, 3, 4)) ** 0.5
    known = [r for r in rows if r[0] and r[2] is not None]
    want = {}
    for a in known:
        hits = [(far(a, b), b[0]) for b in known if b[1] == a[1] and b[0] != a[0] and far(a, b) < ((a[5] or 0) + (b[5] or 0)) / 2 + 20]
        if hits:
            best, n = want.get(a[0], (min(hits), 0))
            want[a[0]] = (min(best, *hits), n + len(hits))
    got = {r.id: ((r.distance, r.conflict_id), r.conflicts) for r in spatial.overlap_check(parts, parts, 20.0).collect()}
    assert got == want
    made = []
    plain = spatial._sized_pairs
    monkeypatch.setattr(spatial, "_sized_pairs", lambda *a: made.append(plain(*a)) or made[-1])
    stack = spark.range(400).selectExpr("concat('p', lpad(id, 3, '0')) AS id", "'V' AS vehicle_signature", "1D AS x", "1D AS y", "1D AS z", "5D AS size")
    assert {(r.conflicts, r.distance, r.conflict_id) for r in spatial.overlap_check(stack, stack).collect()} == {(399, 0.0, "p000"), (399, 0.0, "p001")}
    boxes = stack.selectExpr("*", "size AS dx", "size AS dy", "size AS dz").drop("size")
    pairs = [(r.a_id, r.b_id) for r in spatial.collisions(boxes, ["vehicle_signature"]).collect()]
    assert len(pairs) == len(set(pairs)) == 400 * 399 // 2
    assert [p.count() for p in made] == [1, 1]


def scored(monkeypatch):
    """The sizes of both sides of each ``tiled_topk`` that ``alike_topk`` makes."""
    sides, plain = [], tiles.tiled_topk

    def counted(left, right, *args, **named):
        sides.append((left.count(), right.count()))
        return plain(left, right, *args, **named)

    monkeypatch.setattr(tiles, "tiled_topk", counted)
    return sides


def test_replacements_that_agree_are_scored_once(spark, monkeypatch):
    sides = scored(monkeypatch)
    rng = random.Random(11)
    rows = [(f"p{i:03d}", rng.choice("VW"), "fuse", rng.choice(["aa", "bb"]), rng.choice(["m", "n", None]), "x", rng.choice([None, 5.0, 6.0, 9.0]), rng.choice([None, 1.0, 2.0])) for i in range(300)]
    parts = spark.createDataFrame(rows, "id string, vehicle_signature string, type string, name string, manufacturer string, part_number string, voltage_rating double, current_rating double")
    want = {}
    for a in rows:
        found = []
        for b in rows:
            known = lambda i: a[i] is not None and b[i] is not None
            if b[0] == a[0] or b[1] != a[1] or (known(6) and abs(a[6] - b[6]) > 1) or (known(7) and b[7] < a[7] * 0.8):
                continue
            score = 0.3 * (known(4) and a[4] == b[4]) + 0.4 + 0.2 * (known(6) and a[6] == b[6]) + 0.1 * (known(7) and b[7] >= a[7])
            found.append((-round(score, 6), b[3], b[0]))
        want |= {(a[0], i + 1): (b, -s) for i, (s, _, b) in enumerate(sorted(found)[:5])}
    got = {(r.id, r["rank"]): (r.candidate_id, r.similarity_score) for r in ranking.replacement_topk(parts, parts, 5).collect()}
    assert got == want
    assert len(sides) == 1 and sides[0][0] <= 72 and sides[0][1] < 300


def test_peripherals_of_one_place_are_scored_once(spark, monkeypatch):
    sides = scored(monkeypatch)
    rng = random.Random(13)
    rows = [(f"p{i:03d}", rng.choice("VW"), rng.choice(["connector", "battery", "fuse"]), "a", float(rng.randrange(3) * 500), 0.0, float(rng.randrange(2))) for i in range(400)]
    rows.append(("none", "V", "battery", "a", None, 0.0, 0.0))
    parts = spark.createDataFrame(rows, "id string, vehicle_signature string, type string, name string, x double, y double, z double")
    want = {}
    for a in rows[:-1]:
        if a[2] == "connector":
            far = lambda b: round(((a[4] - b[4]) ** 2 + (a[6] - b[6]) ** 2) ** 0.5, 6)  # noqa: B023, E731
            found = sorted((far(b), b[0]) for b in rows[:-1] if b[1] == a[1] and b[0] != a[0] and (b[2] == "battery" or far(b) <= 800))
            want |= {(a[0], i + 1): (b, d) for i, (d, b) in enumerate(found[:8])}
    got = {(r.id, r["rank"]): (r.peripheral_id, r.distance) for r in ranking.peripherals(parts.filter("type = 'connector'"), parts).collect()}
    assert got == want
    assert len(sides) == 1 and sides[0][0] <= 12 and sides[0][1] <= 2 * 6 * 2 * 9
