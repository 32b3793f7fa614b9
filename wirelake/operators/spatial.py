"""Distance and box joins on grid cells, clusters, collisions, and the 3-D data set.

A row is filed under the grid cells it touches and meets others by an equi-join on the cell, so
there is no pairwise comparison of a whole page or vehicle.  Cells of two or three search radii
keep the copies per row at 4 (plane) or 8 (space).  Spark splits a hot cell when it sees skew.
Boxes of different sizes are filed in grids of their own, each twice as wide as the one before: a pair
meets in the grid of its larger box, so one large box neither widens the cells of the small ones nor fills many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions import geometry as geo
from wirelake.operators.aggregates import bounds
from wirelake.operators.filters import has_position
from wirelake.operators.graph import connected_components
from wirelake.scale import top_rows

TENANT = "vehicle_signature"


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size)))


def near_pairs(a: DataFrame, b: DataFrame, r: float, key: list[str], axes: str = "xy",
               names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Rows of ``a`` and ``b`` with equal ``key`` at most ``r`` apart, as ``struct, struct, distance``."""
    # a row of ``right`` reaches into two cells an axis at most: four copies in the plane, about 2.8 on average, and eight in space
    side = r * (3 if len(axes) == 2 else 2)
    left = a.select(F.struct(*a.columns).alias(names[0]), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
                    *[_cell(F.col(x), side).alias(f"_c{x}") for x in axes])
    # wider than ``r`` by more than the rounding of a distance
    reach = r * (1 + 1e-9)
    right = b.select(F.struct(*b.columns).alias(names[1]), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
                     *[F.sequence(_cell(F.col(x) - reach, side), _cell(F.col(x) + reach, side)).alias(f"_c{x}") for x in axes])
    for x in axes:
        right = right.withColumn(f"_c{x}", F.explode(f"_c{x}"))
    on = [f"_k{i}" for i in range(len(key))] + [f"_c{x}" for x in axes]
    d2 = reduce(lambda u, v: u + v, [(F.col(f"{names[0]}.{x}") - F.col(f"{names[1]}.{x}")) * (F.col(f"{names[0]}.{x}") - F.col(f"{names[1]}.{x}")) for x in axes])
    # Spark takes the copies of ``right`` for one row each and would broadcast them all
    return left.join(right.hint("merge"), on).withColumn("distance", F.sqrt(d2)).filter(F.col("distance") <= r).select(*names, "distance")


def _level(extent: Column, base: Column | float) -> Column:
    """The grid of an object: the first, from 0, whose cells (``base`` times a power of two) are as wide as it."""
    return F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(1e-300)) / base)), F.lit(0)).cast("int")


def _with_levels(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (with ``_level``) with ``_levels``, all grids in use; a size range of 2^1000 has a thousand at most."""
    used = a.select("_level").unionByName(b.select("_level")).agg(F.array_sort(F.collect_set("_level")).alias("_levels"))
    return a.crossJoin(F.broadcast(used)), b.crossJoin(F.broadcast(used))  # one row


def _flat(df: DataFrame, name: str) -> list[Column]:
    """The columns of one side under names of their own; they become a struct only after the join."""
    return [F.col(c).alias(f"{name}__{c}") for c in df.columns]


def _nested(df: DataFrame, name: str) -> Column:
    return F.struct(*[F.col(f"{name}__{c}").alias(c) for c in df.columns]).alias(name)


def _in_grids(df: DataFrame, above: int) -> DataFrame:
    """A row per grid in use from the own one (``above`` = 0), or from the one after it (1)."""
    return df.withColumn("_g", F.explode(F.filter("_levels", lambda g: g >= F.col("_level") + above))).drop("_levels")


def _box_cells(df: DataFrame, size: tuple[float, float], pad: float) -> DataFrame:
    """The at most four cells of grid ``_g`` that a box touches when it is grown by ``pad``."""
    for axis, side in zip("xy", size, strict=True):
        low, high = (F.floor((F.col(f"{axis}{end}") + grow) / (F.lit(float(side)) * F.pow(F.lit(2.0), "_g"))) for end, grow in ((1, -pad), (2, pad)))
        df = df.withColumn(f"_c{axis}", F.explode(F.sequence(low, F.greatest(low, high))))
    return df


def cell_size(boxes: DataFrame) -> tuple[float, float]:
    """Twice the mean box: most boxes then touch one to four cells."""
    w, h = boxes.agg(F.avg(F.col("x2") - F.col("x1")), F.avg(F.col("y2") - F.col("y1"))).first()
    return max(2 * (w or 1.0), 1.0), max(2 * (h or 1.0), 1.0)


def box_pairs(a: DataFrame, b: DataFrame, key: list[str], size: float | tuple[float, float] = 100.0, pad: float = 0.0,
              names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Pairs of boxes that touch when both are grown by ``pad``; each pair once.

    A box has a grid per axis, so a long thin one meets what is beside it and not all in a square of its length.  A pair meets
    in the coarser grid of each axis, in every cell both touch, and is kept in the cell of the lower corner of their
    common part, so no distinct is needed.
    """
    size = size if isinstance(size, tuple) else (float(size), float(size))
    keys = [f"_k{i}" for i in range(len(key))]

    def named(df: DataFrame, name: str) -> DataFrame:
        levels = [_level((F.col(f"{axis}2") - F.col(f"{axis}1") + 2 * pad) / side, 1.0).alias(f"_l{axis}") for axis, side in zip("xy", size, strict=True)]
        return df.select(*_flat(df, name), *[F.col(k).alias(n) for k, n in zip(key, keys, strict=True)], "x1", "y1", "x2", "y2", *levels)

    left, right = named(a, names[0]), named(b, names[1])
    # a row per pair of size classes, not per box
    used = sorted({(0, 0)} | {tuple(r) for r in left.select("_lx", "_ly").unionByName(right.select("_lx", "_ly")).distinct().collect()})
    grids = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in used])
    p, q = (lambda c, name=name: F.col(f"{name}__{c}") for name in names)
    touch = ((p("x1") - pad <= q("x2") + pad) & (q("x1") - pad <= p("x2") + pad) & (p("y1") - pad <= q("y2") + pad) & (q("y1") - pad <= p("y2") + pad))
    home = reduce(lambda u, v: u & v, [
        F.floor((F.greatest(p(f"{axis}1"), q(f"{axis}1")) - pad) / (F.lit(float(side)) * F.pow(F.lit(2.0), f"_g{axis}"))) == F.col(f"_c{axis}") for axis, side in zip("xy", size, strict=True)])
    out = [_nested(a, names[0]), _nested(b, names[1])]
    on = [*keys, "_gx", "_gy", "_cx", "_cy"]
    lx, ly = F.col("_lx"), F.col("_ly")
    own = F.array(F.struct(lx.alias("x"), ly.alias("y")))
    up = F.filter(grids, lambda g: (g["x"] >= lx) & (g["y"] >= ly))
    above = F.array_except(up, own)
    # grids where this box is the longer one along x, or along y, and the other box is along the other axis
    wide = F.array_distinct(F.transform(F.filter(grids, lambda g: (g["x"] < lx) & (g["y"] > ly)), lambda g: F.struct(lx.alias("x"), g["y"].alias("y"))))
    tall = F.array_distinct(F.transform(F.filter(grids, lambda g: (g["x"] > lx) & (g["y"] < ly)), lambda g: F.struct(g["x"].alias("x"), ly.alias("y"))))

    def filed(df: DataFrame, where: Column) -> DataFrame:
        df = df.withColumn("_g", F.explode(where)).withColumns({"_gx": F.col("_g.x"), "_gy": F.col("_g.y")})
        for axis, side in zip("xy", size, strict=True):
            low, high = (F.floor((F.col(f"{axis}{end}") + grow) / (F.lit(float(side)) * F.pow(F.lit(2.0), f"_g{axis}"))) for end, grow in ((1, -pad), (2, pad)))
            df = df.withColumn(f"_c{axis}", F.explode(F.sequence(low, F.greatest(low, high))))
        return df.drop("x1", "y1", "x2", "y2", "_lx", "_ly", "_g")

    ways = [(own, up), (above, own)]
    if any(x < u and y > v for x, y in used for u, v in used):
        ways += [(wide, tall), (tall, wide)]
    met = [filed(left, here).join(filed(right, there), on).filter(touch & home).select(*out) for here, there in ways]
    return reduce(DataFrame.unionByName, met)


def nearest_pin(labels: DataFrame, pins: DataFrame, key: list[str], max_d: float = 20.0) -> DataFrame:
    """For each label (``key, label_id, x, y, confidence``) the nearest pin (``key, pin_id, x, y``) within reach."""
    pairs = near_pairs(labels, pins, max_d, key).select(
        *[F.col(f"a.{k}").alias(k) for k in key], F.col("a.label_id").alias("label_id"), F.col("b.pin_id").alias("pin_id"), "distance", F.col("a.confidence").alias("_c"))
    best = top_rows(pairs, [*key, "label_id"], [F.col("distance"), F.col("pin_id")], 1)
    return best.select(*key, "label_id", "pin_id", "distance", (F.col("_c") * (1 - F.col("distance") / max_d)).alias("confidence"))


def segment_boxes(segments: DataFrame) -> DataFrame:
    """Replace end points by the box around them; the end points stay in ``s``."""
    keep = [c for c in segments.columns if c not in {"x1", "y1", "x2", "y2"}]
    return segments.select(*keep, geo.box().alias("s"), F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"),
                           F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"))


def component_nets(detections: DataFrame, segments: DataFrame, key: list[str], tol: float = 15.0, size: float = 100.0) -> DataFrame:
    """Nets with a segment end inside a component box grown by ``tol``.

    ``detections``: ``key, comp_id, x1..y2``; ``segments``: ``key, net_id, x1..y2``.
    """
    ends = segments.select(*key, "net_id", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")),
                                                             F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    points = ends.select(*key, "net_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")).distinct()
    extent = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + 2 * tol
    boxes = detections.select(*key, "comp_id", "x1", "y1", "x2", "y2").withColumn("_level", _level(extent, size))
    points, boxes = _with_levels(points.withColumn("_level", F.lit(0)), boxes)
    boxes = _box_cells(boxes.drop("_levels").withColumn("_g", F.col("_level")), (size, size), tol).drop("_level")
    points = _in_grids(points, 0).drop("_level")
    for axis in "xy":
        points = points.withColumn(f"_c{axis}", F.floor(F.col(axis) / (size * F.pow(F.lit(2.0), "_g"))))
    inside = F.col("x").between(F.col("x1") - tol, F.col("x2") + tol) & F.col("y").between(F.col("y1") - tol, F.col("y2") + tol)
    return points.join(boxes, [*key, "_g", "_cx", "_cy"]).filter(inside).select(*key, "comp_id", "net_id").distinct()


def net_label_pairs(segments: DataFrame, spans: DataFrame, key: list[str], max_d: float = 30.0, size: float = 100.0) -> DataFrame:
    """Texts at most ``max_d`` from a segment of a net, with the least distance per net and text.

    A segment is filed in the first grid, from cells of ``size``, in which it is at most 16 cells long; a level one fills
    about that many, a slanted one up to 18 times 18.  Texts are filed once per grid in use: most drawings have one.
    """
    extent = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + 2 * max_d
    boxes = segment_boxes(segments.select(*key, "net_id", "x1", "y1", "x2", "y2")).withColumn("_level", _level(extent, 16 * size))
    points = spans.select(*key, "span_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), F.lit(0).alias("_level"))
    points, boxes = _with_levels(points, boxes)
    boxes = _box_cells(boxes.drop("_levels").withColumn("_g", F.col("_level")), (size, size), max_d).select(*key, "net_id", "s", "_g", "_cx", "_cy")
    points = _in_grids(points, 0).drop("_level")
    for axis in "xy":
        points = points.withColumn(f"_c{axis}", F.floor(F.col(axis) / (size * F.pow(F.lit(2.0), "_g"))))
    pairs = points.join(boxes, [*key, "_g", "_cx", "_cy"]).withColumn("distance", geo.seg_point_dist(F.col("s"), F.col("x"), F.col("y")))
    return pairs.filter(F.col("distance") <= max_d).groupBy(*key, "net_id", "span_id").agg(F.min("distance").alias("distance"))


def within_radius(points: DataFrame, centres: DataFrame, r: float) -> DataFrame:
    """Positioned components at most ``r`` from each centre component of the same tenant."""
    pairs = near_pairs(centres.filter(has_position()).select("id", TENANT, "x", "y", "z"),
                       points.filter(has_position()).select("id", TENANT, "x", "y", "z"), r, [TENANT], "xyz")
    return pairs.filter(F.col("a.id") != F.col("b.id")).select(F.col("a.id").alias("centre_id"), F.col("b.id").alias("id"), "distance")


def cluster_members(points: DataFrame, r: float = 300.0) -> DataFrame:
    """``(id, cluster)`` by single linkage at ``r``.

    Points are first merged to distinct places, then to cells of side ``r / sqrt(3)``: all places
    of a cell are linked anyway.  Only neighbouring cells compare their places.
    """
    side = r / 3 ** 0.5
    placed = points.filter(has_position()).select("id", TENANT, "x", "y", "z")
    cell = F.concat_ws(":", TENANT, *[_cell(F.col(a), side).cast("string") for a in "xyz"])
    placed = placed.withColumn("cell", cell)
    places = placed.select("cell", TENANT, "x", "y", "z").distinct()
    links = near_pairs(places, places, r, [TENANT], "xyz").filter(F.col("a.cell") < F.col("b.cell")).select(
        F.col("a.cell").alias("src"), F.col("b.cell").alias("dst")).distinct()
    groups = connected_components(placed.select(F.col("cell").alias("id")), links)
    return placed.join(groups.select(F.col("id").alias("cell"), F.col("component").alias("cluster")), "cell").drop("cell")


def spatial_clusters(components: DataFrame, r: float = 300.0, min_size: int = 2) -> DataFrame:
    """Clusters of at least ``min_size``: centre, radius, density, most frequent zone."""
    members = cluster_members(components, r).join(components.select("id", "zone"), "id")
    centre = members.groupBy("cluster", TENANT).agg(
        F.count(F.lit(1)).alias("size"), F.min("id").alias("first_id"), *[F.avg(a).alias(f"centre_{a}") for a in "xyz"])
    centre = centre.filter(F.col("size") >= min_size)
    away = reduce(lambda u, v: u + v, [(F.col(a) - F.col(f"centre_{a}")) * (F.col(a) - F.col(f"centre_{a}")) for a in "xyz"])
    radius = members.select("cluster", "x", "y", "z").join(centre.select("cluster", *[f"centre_{a}" for a in "xyz"]), "cluster").groupBy("cluster").agg(
        F.max(F.sqrt(away)).alias("radius"))
    zones = members.filter(F.col("zone").isNotNull()).groupBy("cluster", "zone").agg(F.count(F.lit(1)).alias("n"))
    zone = top_rows(zones, "cluster", [F.col("n").desc(), F.col("zone")], 1).select("cluster", "zone")
    volume = F.lit(4 / 3) * F.pi() * F.pow("radius", F.lit(3))
    return centre.join(radius, "cluster").join(zone, "cluster", "left").withColumn(
        "density", F.when(volume > 0, F.col("size") / volume).otherwise(0.0))


def overlap_check(new: DataFrame, placed: DataFrame, clearance: float = 50.0) -> DataFrame:
    """Nearest placed component that is closer than half of both sizes plus the clearance.

    Components of one place and size are compared as one body.  Of a placed body its number and its two smallest ids go along: of
    two, one is not the component itself, and its own rows are taken off the number afterwards.
    """
    at = [TENANT, "x", "y", "z", "size"]
    one, two = (df.filter("id IS NOT NULL").select("id", TENANT, "x", "y", "z", F.coalesce("size", F.lit(0.0)).alias("size")) for df in (new, placed))
    ids = top_rows(two.select(*at, "id").distinct(), at, [F.col("id")], 2).groupBy(*at).agg(F.collect_list("id").alias("ids"))
    bodies = two.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).join(ids, at)
    apart = lambda p, q: F.sqrt(reduce(lambda u, v: u + v, [(F.col(p + c) - F.col(q + c)) * (F.col(p + c) - F.col(q + c)) for c in "xyz"]))
    need = lambda p, q: (F.col(p + "size") + F.col(q + "size")) / 2 + clearance
    pairs = _sized_pairs(one.select(*at).distinct(), bodies, [TENANT], F.col("size") + clearance)
    hits = pairs.withColumn("distance", apart("a.", "b.")).filter(F.col("distance") < need("a.", "b."))
    # a body's rows are shuffled once, for the aggregate and both windows
    hits = hits.select(*[F.col(f"a.{c}").alias(c) for c in at], "distance", F.col("b.n").alias("n"), F.posexplode("b.ids").alias("i", "other")).repartition(*at)
    others = hits.groupBy(*at, "other").agg(F.min("distance").alias("distance"), F.sum(F.when(F.col("i") == 0, F.col("n")).otherwise(0)).alias("n"))
    near = Window.partitionBy(*at)
    two_best = others.withColumns({"total": F.sum("n").over(near), "rn": F.row_number().over(near.orderBy("distance", "other"))}).filter("rn <= 2")
    hit = F.struct("distance", F.col("other").alias("conflict_id"))
    best = two_best.groupBy(*at).agg(F.max("total").alias("total"), *[F.max(F.when(F.col("rn") == i, hit)).alias(f"m{i}") for i in (1, 2)])
    rows = one.join(best, at).withColumn("m", F.when(F.col("m1.conflict_id") == F.col("id"), F.col("m2")).otherwise(F.col("m1")))
    rows = rows.groupBy("id").agg(F.min("m").alias("m"), F.sum("total").alias("total"))
    p, q = (df.select("id", TENANT, *[F.col(c).alias(f"{name}{c}") for c in ("x", "y", "z", "size")]) for df, name in ((one, "p"), (two, "q")))
    own = p.join(q, ["id", TENANT]).filter(apart("p", "q") < need("p", "q")).groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    out = rows.filter("m IS NOT NULL").join(own, "id", "left")
    return out.select("id", "m.conflict_id", "m.distance", (F.col("total") - F.coalesce("own", F.lit(0))).alias("conflicts"))


def _sized_pairs(a: DataFrame, b: DataFrame, key: list[str], extent: Column) -> DataFrame:
    """``a, b``: all pairs of equal ``key`` whose centres are, on each axis, at most the larger ``extent`` apart, and some more.

    A row is in one cell of its own grid; rows of the same and finer grids look into the 27 cells around them there.
    """
    base = a.select(extent.alias("e")).unionByName(b.select(extent.alias("e"))).filter("e > 0").agg(F.coalesce(F.percentile_approx("e", 0.5), F.lit(1.0)).alias("_base"))
    keys = [f"_k{i}" for i in range(len(key))]

    def named(df: DataFrame, name: str) -> DataFrame:
        made = df.select(*_flat(df, name), *[F.col(k).alias(n) for k, n in zip(key, keys, strict=True)], "x", "y", "z", extent.alias("_e"))
        return made.crossJoin(F.broadcast(base)).withColumn("_level", _level(F.col("_e"), F.col("_base")))  # one row

    left, right = _with_levels(named(a, "a"), named(b, "b"))
    cell = lambda c: F.floor(F.col(c) / (F.col("_base") * F.pow(F.lit(2.0), "_g")))
    on = [*keys, "_g", "_cx", "_cy", "_cz"]
    drop = ["x", "y", "z", "_e", "_base", "_level", "_levels"]

    def met(here: DataFrame, there: DataFrame, above: int) -> DataFrame:
        one, two = here.withColumn("_g", F.col("_level")), _in_grids(there, above)
        for c in "xyz":
            one = one.withColumn(f"_c{c}", cell(c))
            two = two.withColumn(f"_c{c}", F.explode(F.array(*[cell(c) + d for d in (-1, 0, 1)])))
        return one.drop(*drop).join(two.drop(*drop).hint("merge"), on).select(_nested(a, "a"), _nested(b, "b"))  # as in near_pairs

    return met(left, right, 0).unionByName(met(right, left, 1))


def collisions(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of 3-D boxes (centre ``x,y,z``, extents ``dx,dy,dz``) that touch.

    Boxes of one place and extent are compared as one body, in lists of about a thousand ids; pairs of ids are made last, where
    two bodies have met, and are not shuffled.
    """
    at = [*key, "x", "y", "z", "dx", "dy", "dz"]
    lists = boxes.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / 1024).alias("_n"))
    bodies = boxes.select("id", *at).join(lists, at).groupBy(*at, F.pmod(F.xxhash64("id"), "_n").alias("_i")).agg(F.collect_list("id").alias("ids")).drop("_i")
    pairs = _sized_pairs(bodies, bodies, key, F.greatest("dx", "dy", "dz"))
    hit = reduce(lambda u, v: u & v, [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= (F.col(f"a.d{c}") + F.col(f"b.d{c}")) / 2 for c in "xyz"])
    keys = [F.col(f"a.{k}").alias(k) for k in key]
    found = pairs.filter(hit).select(*keys, F.explode("a.ids").alias("a_id"), F.col("b.ids").alias("_b"))
    return found.select(*key, "a_id", F.explode("_b").alias("b_id")).filter("a_id < b_id")


def scene_dataset(components: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per thing to draw: component places, wires, and the bounds of each tenant."""
    placed = components.filter(has_position())
    at = placed.select("id", *[F.col(a) for a in "xyz"])
    comp = placed.select(TENANT, F.lit("component").alias("kind"), "id", "x", "y", "z", F.lit(None).cast("double").alias("x2"),
                         F.lit(None).cast("double").alias("y2"), F.lit(None).cast("double").alias("z2"))
    a = at.withColumnsRenamed({"id": "src"})
    b = at.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    wires = edges.filter(F.col("rel_type") == "CONNECTS_TO").join(a, "src").join(b, "dst").select(
        TENANT, F.lit("wire").alias("kind"), F.concat_ws("-", "src", "dst").alias("id"), "x", "y", "z", "x2", "y2", "z2")
    box = bounds(components).select(TENANT, F.lit("bounds").alias("kind"), F.col(TENANT).alias("id"), F.col("min_x").alias("x"), F.col("min_y").alias("y"),
                                    F.col("min_z").alias("z"), F.col("max_x").alias("x2"), F.col("max_y").alias("y2"), F.col("max_z").alias("z2"))
    return comp.unionByName(wires).unionByName(box)
