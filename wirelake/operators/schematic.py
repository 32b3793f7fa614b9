"""From boxes and line segments to fused text, nets and a netlist.

Identical boxes are merged before any pair is made, groups are connected components, and lists of
lines or pins are kept as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.functions import geometry as geo
from wirelake.functions import text as tx
from wirelake.operators.graph import components_by_key
from wirelake.operators.overlap import box_groups
from wirelake.operators.spatial import box_pairs, component_nets, near_pairs, segment_boxes
from wirelake.scale import best_readings, number_rows, top_rows
from wirelake.session import cut

BOX = ["x1", "y1", "x2", "y2"]


def _place(key: list[str]) -> Column:
    return F.concat_ws(":", *key, *BOX)


def group_boxes(boxes: DataFrame, key: list[str], iou: float = 0.3) -> DataFrame:
    """Add ``group``: boxes of the same ``key`` linked by IoU above the limit, over any chain.

    The group is the place text of its topmost box, then the leftmost.
    """
    return box_groups(boxes, key, iou)


def group_boxes_greedy(boxes: DataFrame, key: list[str], iou: float = 0.3) -> DataFrame:
    """Seed groups: the strongest free box takes all free boxes that overlap it, and so on.

    Same loop as ``nms``: a box is a seed once no stronger free neighbour is left.
    """
    kept = nms(boxes, key, iou, strict=True).select(*key, *BOX).distinct().withColumn("group", _place(key))
    seeds = kept.join(_best_by_place(boxes, key), [*key, *BOX])
    pairs = box_pairs(_best_by_place(boxes, key), seeds, key)
    a, b = F.col("a"), F.col("b")
    fit = pairs.filter(geo.iou(a, b) > iou).groupBy(*[a[c].alias(c) for c in [*key, *BOX]]).agg(
        F.max_by(b["group"], F.struct(b["confidence"], F.negative(b["y1"]), F.negative(b["x1"]))).alias("_taken"))
    out = boxes.join(fit, [*key, *BOX], "left").join(kept, [*key, *BOX], "left")
    return out.withColumn("group", F.coalesce("group", "_taken", _place(key))).drop("_taken")


def _best_by_place(boxes: DataFrame, key: list[str]) -> DataFrame:
    return boxes.groupBy(*key, *BOX).agg(F.max("confidence").alias("confidence"))


def nms(boxes: DataFrame, key: list[str], iou: float = 0.3, strict: bool = False, max_rounds: int = 1000) -> DataFrame:
    """Boxes left when every box that overlaps a stronger kept box is dropped.

    Equal confidence is ordered by place.  Copies of one box count once.  Each round keeps the boxes
    that are strongest among their open neighbours, all pages at once.  ``strict`` drops at IoU
    above the limit, else at or above it.
    """
    best = _best_by_place(boxes, key).withColumn("id", _place(key))
    pairs = box_pairs(best, best, key)
    a, b = F.col("a"), F.col("b")
    near = geo.iou(a, b) > iou if strict else geo.iou(a, b) >= iou
    stronger = (a["confidence"] > b["confidence"]) | ((a["confidence"] == b["confidence"]) & (a["id"] < b["id"]))
    rivals = cut(pairs.filter((a["id"] != b["id"]) & near & stronger).select(a["id"].alias("win"), b["id"].alias("lose")))
    open_ids = cut(best.select("id"))
    kept = None
    for _ in range(max_rounds):
        beaten = rivals.select(F.col("lose").alias("id")).distinct()
        winners = cut(open_ids.join(beaten, "id", "left_anti"))
        kept = winners if kept is None else kept.unionByName(winners)
        dropped = rivals.join(winners.select(F.col("id").alias("win")), "win", "left_semi").select(F.col("lose").alias("id")).distinct()
        open_ids = cut(open_ids.join(winners, "id", "left_anti").join(dropped, "id", "left_anti"))
        if open_ids.isEmpty():
            return best.join(kept, "id", "left_semi").drop("id")
        still = open_ids
        rivals = cut(rivals.join(still.select(F.col("id").alias("win")), "win", "left_semi").join(
            still.select(F.col("id").alias("lose")), "lose", "left_semi"))
    raise RuntimeError("suppression did not settle")


def fuse_confidence(spans: DataFrame, key: list[str], min_conf: float = 0.5, iou: float = 0.3) -> DataFrame:
    """The strongest span of each overlap group."""
    grouped = group_boxes(spans.filter(F.col("confidence") >= min_conf), key, iou)
    best = F.max(F.struct("confidence", "engine", "text", *BOX)).alias("s")
    return grouped.groupBy(*key, "group").agg(best, F.count(F.lit(1)).alias("members")).select(
        *key, "group", "members", "s.text", "s.engine", "s.confidence", *[f"s.{c}" for c in BOX])


def _fused(grouped: DataFrame, key: list[str]) -> DataFrame:
    total = F.sum("confidence")
    return grouped.groupBy(*key, "group").agg(
        F.count(F.lit(1)).alias("members"), F.count_distinct("engine").alias("engines"),
        F.max("confidence").alias("max_confidence"), F.least(F.avg("confidence"), F.lit(1.0)).alias("confidence"),
        *[(F.sum(F.col(c) * F.col("confidence")) / F.nullif(total, F.lit(0.0))).alias(c) for c in BOX],
        F.max_by("text", F.struct("confidence", "engine", "text")).alias("text"),
        F.max_by("engine", F.struct("confidence", "engine", "text")).alias("engine"))


def fuse_consensus(spans: DataFrame, key: list[str], iou: float = 0.3, single: float = 0.8) -> DataFrame:
    """Groups seen by two engines (weighted box, mean confidence), or one span above ``single``."""
    out = _fused(group_boxes(spans, key, iou), key)
    return out.filter((F.col("engines") >= 2) | ((F.col("members") == 1) & (F.col("max_confidence") > single)))


def fuse_text_vote(spans: DataFrame, key: list[str], iou: float = 0.3) -> DataFrame:
    """Weighted box per group with the text that has the most confidence behind it."""
    grouped = cut(group_boxes(spans, key, iou))
    votes = grouped.groupBy(*key, "group", F.lower(F.trim("text")).alias("_vote")).agg(
        F.sum("confidence").alias("_w"), F.max_by("text", F.struct("confidence", "engine", "text")).alias("_t"))
    voted = votes.groupBy(*key, "group").agg(F.max_by("_t", F.struct(F.round("_w", 9), "_vote")).alias("voted_text"))
    return _fused(grouped, key).join(voted, [*key, "group"]).withColumn("text", F.col("voted_text")).drop("voted_text")


def fuse(spans: DataFrame, key: list[str], strategy: str = "confidence") -> DataFrame:
    """Fuse by name; ``ensemble`` and ``simple`` are the confidence rule."""
    if strategy in {"confidence", "ensemble", "simple"}:
        return fuse_confidence(spans, key)
    return {"consensus": fuse_consensus, "text": fuse_text_vote}[strategy](spans, key)


def fusion_metrics(spans: DataFrame, key: list[str], iou: float = 0.3) -> DataFrame:
    """Per key: spans, groups, groups of several engines, and the agreement rate."""
    groups = group_boxes(spans, key, iou).groupBy(*key, "group").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("engine").alias("e"))
    return groups.groupBy(*key).agg(
        F.sum("n").alias("spans"), F.count(F.lit(1)).alias("total_groups"), F.count(F.when(F.col("e") > 1, 1)).alias("multi_engine_groups")
    ).withColumn("agreement_rate", F.col("multi_engine_groups") / F.col("total_groups"))


def merge_detections(a: DataFrame, b: DataFrame, key: list[str], iou: float = 0.3) -> DataFrame:
    grouped = group_boxes(a.unionByName(b), key, iou)
    best = F.max(F.struct("confidence", "label", *BOX)).alias("d")
    return grouped.groupBy(*key, "group").agg(best).select(*key, "d.label", "d.confidence", *[f"d.{c}" for c in BOX])


# ---- text to components ----------------------------------------------------------------------


def associations(spans: DataFrame, detections: DataFrame, key: list[str], radius: float = 50.0, min_conf: float = 0.3) -> DataFrame:
    """Every span at its best component: kind of text, relation, distance, confidence.

    ``spans``: ``key, span_id, text, x1..y2``; ``detections``: ``key, comp_id, label, x1..y2``.
    """

    def centred(df: DataFrame) -> DataFrame:
        return df.withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y2")) / 2})

    pairs = near_pairs(centred(spans), centred(detections), radius, key, names=("t", "c"))
    kind, rel = tx.text_class(F.col("t.text")), geo.spatial_relation(F.col("t"), F.col("c"))
    scored = pairs.select(
        *[F.col(f"t.{k}").alias(k) for k in key], F.col("t.span_id").alias("span_id"), F.col("c.comp_id").alias("comp_id"),
        F.col("t.text").alias("text"), F.col("c.label").alias("label"), kind.alias("kind"), rel.alias("relation"), "distance"
    ).withColumn("confidence", geo.spatial_confidence(F.col("relation"), F.col("distance"), radius) * tx.type_weight(F.col("kind"), F.col("label")))
    return top_rows(scored.filter(F.col("confidence") >= min_conf), [*key, "span_id"],
                    [F.col("confidence").desc(), F.col("comp_id")], 1).drop("rank")


def associate_text(spans: DataFrame, detections: DataFrame, key: list[str], radius: float = 50.0) -> DataFrame:
    """Components with their reference, value, number of pin labels and labels, and mean confidence."""
    found = associations(spans, detections, key, radius)

    def best(kind: str) -> Column:
        mine = F.col("kind") == kind
        return F.max_by(F.when(mine, F.col("text")), F.when(mine, F.struct("confidence", "text")))

    sums = found.groupBy(*key, "comp_id").agg(
        best("reference").alias("reference"), best("value").alias("value"),
        F.count(F.when(F.col("kind") == "pin_label", 1)).alias("pin_labels"), F.count(F.when(F.col("kind") == "label", 1)).alias("labels"),
        F.avg("confidence").alias("confidence"))
    return detections.select(*key, "comp_id", "label", *BOX).join(sums, [*key, "comp_id"], "left").fillna(0, subset=["pin_labels", "labels"])


# ---- wires -----------------------------------------------------------------------------------


def _angle_gap(a: Column, b: Column) -> Column:
    d = F.abs(geo.seg_angle(a) - geo.seg_angle(b))
    return F.least(d, F.abs(d - F.pi()))


def _segment_pairs(segments: DataFrame, key: list[str], pad: float, size: tuple[float, float] = (200.0, 64.0)) -> DataFrame:
    boxes = segment_boxes(segments.select(*key, "seg_id", "x1", "y1", "x2", "y2"))
    return box_pairs(boxes, boxes, key, size, pad / 2)


def _end_distances(a: Column, b: Column) -> list[Column]:
    return [F.hypot(a[f"x{i}"] - b[f"x{j}"], a[f"y{i}"] - b[f"y{j}"]) for i in (1, 2) for j in (1, 2)]


#: Between the parts of a vertex name; no key holds it.
_JOINT = "\x1f"


def _vertex(key: list[str], prefix: str = "") -> Column:
    """A segment of a page: ids can repeat on other pages."""
    return F.concat_ws(_JOINT, F.lit(prefix), *[F.col(k).cast("string") for k in key], "seg_id")


def _segment_of(vertex: str) -> Column:
    return F.element_at(F.split(vertex, _JOINT), -1)


def collinear_groups(segments: DataFrame, key: list[str], da: float = 0.1, d: float = 10.0) -> DataFrame:
    pairs = _segment_pairs(segments, key, d)
    a, b = F.col("a.s"), F.col("b.s")
    of = lambda side: F.concat_ws(_JOINT, F.lit(""), *[F.col(f"{side}.{k}").cast("string") for k in key], f"{side}.seg_id")
    links = pairs.filter((F.col("a.seg_id") < F.col("b.seg_id")) & (_angle_gap(a, b) <= da) & (F.least(*_end_distances(a, b)) <= d)).select(
        *[F.col(f"a.{k}").alias(k) for k in key], of("a").alias("src"), of("b").alias("dst"))
    groups = components_by_key(segments.select(*key, _vertex(key).alias("id")), links, key)
    return segments.withColumn("_v", _vertex(key)).join(groups.select(F.col("id").alias("_v"), F.col("component").alias("wire_id")), "_v").drop("_v")


def _hull(points: np.ndarray) -> np.ndarray:
    """Corner points of the convex hull."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def _widest(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two hull corners that are farthest apart, the first ones in hull order where several are."""
    best, pick = -1.0, (p[0], p[0])
    for i in range(len(p)):
        d = np.hypot(*(p - p[i]).T)
        j = int(d.argmax())
        if d[j] > best + 1e-9:
            best, pick = float(d[j]), (p[i], p[j])
    return pick


def _runs(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The points of a bucket in the order of ``keys, x, y``: row numbers, points, first place of each group, and whether its points
    are on one line."""
    points = np.column_stack([table[c].to_numpy().astype(float) for c in "xy"])
    codes = [np.asarray(table[k].combine_chunks().dictionary_encode().indices, dtype=np.int64) for k in keys]
    order = np.lexsort([points[:, 1], points[:, 0], *codes])
    points = points[order]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in codes], axis=0)
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    first, last = points[starts][group], points[np.r_[starts[1:], len(order)] - 1][group]
    off = ((last - first) * (points - first)[:, ::-1] * [1, -1]).sum(axis=1)
    return order, points, starts, np.maximum.reduceat(np.abs(off), starts) == 0


def _farthest(points: DataFrame, group: str, share: int = 50000) -> DataFrame:
    """The two points of each group that are farthest apart; only hull corners are compared.

    Groups are dealt into buckets of about ``share`` points, which numpy solves at once: of points on one line the ends are the first and the
    last.  A group above that is cut into shares; each share sends on the corners of its hull.
    """
    kind = dict(points.dtypes)[group]

    def hulls(table: pa.Table) -> pa.Table:
        order, p, starts, _ = _runs(table, [group, "_salt"])
        corners = [_hull(part) for part in np.split(p, starts[1:])]
        names = table[group].take(pa.array(np.repeat(order[starts], [len(c) for c in corners])))
        corners = np.concatenate(corners)
        return pa.table({group: names, "x": corners[:, 0], "y": corners[:, 1]})

    def ends(table: pa.Table) -> pa.Table:
        order, p, starts, flat = _runs(table, [group])
        stops = np.r_[starts[1:], len(p)]
        far = np.column_stack([p[starts], p[stops - 1]])
        for i in np.flatnonzero(~flat):
            far[i] = np.concatenate(sorted(_widest(_hull(p[starts[i]:stops[i]])), key=tuple))
        return pa.table({group: table[group].take(pa.array(order[starts])), **{c: far[:, i] for i, c in enumerate(BOX)}})

    sizes = points.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    large = sizes.filter(F.col("_n") > share).select(group, F.ceil(F.col("_n") / share).alias("_shares"))
    salted = points.join(large, group, "left").withColumn("_salt", F.when(F.col("_shares").isNotNull(), F.pmod(F.xxhash64("x", "y"), F.col("_shares"))))
    corners = salted.filter("_salt IS NOT NULL").drop("_shares").groupBy(group, "_salt").applyInArrow(hulls, f"{group} {kind}, x double, y double")
    rest = salted.filter("_salt IS NULL").select(group, "x", "y").unionByName(corners)
    dealt = rest.withColumn("_bucket", F.pmod(F.xxhash64(group), F.lit(max(1, -(-total // share)))))
    return dealt.groupBy("_bucket").applyInArrow(ends, f"{group} {kind}, x1 double, y1 double, x2 double, y2 double")


def merge_collinear(segments: DataFrame, key: list[str], da: float = 0.1, d: float = 10.0) -> DataFrame:
    """Segments in line with close ends become one, from end to end.

    ``segments``: ``key, seg_id, x1..y2, thickness, confidence``.
    """
    grouped = cut(collinear_groups(segments, key, da, d))
    means = cut(grouped.groupBy(*key, "wire_id").agg(F.count(F.lit(1)).alias("parts"), F.avg("thickness").alias("thickness"), F.avg("confidence").alias("confidence")))
    single = grouped.join(means.filter("parts = 1").select("wire_id"), "wire_id", "left_semi").select("wire_id", *BOX)
    many = grouped.join(means.filter("parts > 1").select("wire_id"), "wire_id", "left_semi")
    ends = cut(many.select("wire_id", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select("wire_id", "p.*").distinct())
    merged = means.join(single.unionByName(_farthest(ends, "wire_id")), "wire_id")
    return merged.withColumn("seg_id", _segment_of("wire_id")).select("seg_id", *[c for c in merged.columns if c != "wire_id"])


def junction_points(segments: DataFrame, key: list[str], tol: float = 8.0) -> DataFrame:
    """Crossings, near crossings, T ends and corners as ``key, x, y, kind, confidence, seg_id``
    rows: one row per line that takes part."""
    pairs = cut(_segment_pairs(segments, key, tol).filter(F.col("a.seg_id") != F.col("b.seg_id")))
    a, b = F.col("a.s"), F.col("b.s")
    ids = [F.col("a.seg_id"), F.col("b.seg_id")]
    keep = [F.col(f"a.{k}").alias(k) for k in key]
    once = pairs.filter(ids[0] < ids[1])
    # each stage is written out: the formulas are long and would be repeated inside each other
    met = cut(once.withColumn("p", geo.seg_intersection(a, b)))
    gap = geo.end_gap(a, b)
    point = F.when(F.col("p").isNotNull(), F.col("p")).when(F.col("g.distance") <= tol, F.struct(F.col("g.x").alias("x"), F.col("g.y").alias("y")))
    met = cut(met.withColumn("g", F.when(F.col("p").isNull(), gap)))
    met = cut(met.withColumn("q", point).filter(F.col("q").isNotNull()))
    met = cut(met.withColumn("confidence", geo.intersection_confidence(a, b, F.col("q"))))
    crossing = met.filter(
        F.col("confidence") > F.when(F.col("p").isNotNull(), 0.5).otherwise(0.3))
    crossing = crossing.select(*keep, F.col("q.x").alias("x"), F.col("q.y").alias("y"), F.lit("cross").alias("kind"), "confidence", F.explode(F.array(*ids)).alias("seg_id"))

    ends = pairs.select(*keep, F.col("a.seg_id").alias("own"), F.col("b.seg_id").alias("other"), b.alias("line"), F.explode(F.array(
        F.struct(a["x1"].alias("x"), a["y1"].alias("y")), F.struct(a["x2"].alias("x"), a["y2"].alias("y")))).alias("e"))
    close = ends.withColumn("d", geo.seg_point_dist(F.col("line"), F.col("e.x"), F.col("e.y"))).filter(F.col("d") <= tol).select(*key, "own", "other", "e.x", "e.y", "d")
    strength = close.groupBy(*key, "own", "x", "y").agg(F.greatest(F.lit(0.1), 1 - F.avg("d") / tol).alias("confidence"))
    tee = strength.select(*key, "x", "y", F.lit("T").alias("kind"), "confidence", F.col("own").alias("seg_id")).unionByName(
        close.join(strength, [*key, "own", "x", "y"]).select(*key, "x", "y", F.lit("T").alias("kind"), "confidence", F.col("other").alias("seg_id")))

    corners = once.filter(_angle_gap(a, b) > 0.2).select(*keep, F.array(*ids).alias("lines"), F.explode(F.array(*[
        F.struct(F.hypot(a[f"x{i}"] - b[f"x{j}"], a[f"y{i}"] - b[f"y{j}"]).alias("d"), ((a[f"x{i}"] + b[f"x{j}"]) / 2).alias("x"), ((a[f"y{i}"] + b[f"y{j}"]) / 2).alias("y"))
        for i in (1, 2) for j in (1, 2)])).alias("m")).filter(F.col("m.d") <= tol)
    corner = corners.select(*key, "m.x", "m.y", F.lit("corner").alias("kind"), (1 - F.col("m.d") / tol).alias("confidence"), F.explode("lines").alias("seg_id"))
    return crossing.unionByName(tee).unionByName(corner)


def junctions(points: DataFrame, key: list[str], tol: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """Junction points within ``tol`` become one junction.

    Returns the junctions ``(key, junction_id, x, y, degree, type, confidence)`` and their lines
    ``(key, junction_id, seg_id)``.
    """
    points = cut(points.withColumn("place", F.concat_ws(":", *key, F.round("x", 6), F.round("y", 6))))
    places = points.groupBy(*key, "place").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    links = near_pairs(places, places, tol, key).filter(F.col("a.place") < F.col("b.place")).select(
        *[F.col(f"a.{k}").alias(k) for k in key], F.col("a.place").alias("src"), F.col("b.place").alias("dst"))
    groups = components_by_key(places.select(*key, F.col("place").alias("id")), links, key)
    joined = points.join(groups.select(F.col("id").alias("place"), F.col("component").alias("junction_id")), "place")
    lines = joined.select(*key, "junction_id", "seg_id").distinct()
    degree = lines.groupBy("junction_id").agg(F.count(F.lit(1)).alias("degree"))
    marks = joined.select(*key, "junction_id", "x", "y", "kind", "confidence").distinct()
    w = F.sum("confidence")
    at = marks.groupBy(*key, "junction_id").agg((F.sum(F.col("x") * F.col("confidence")) / w).alias("x"), (F.sum(F.col("y") * F.col("confidence")) / w).alias("y"), F.max("confidence").alias("confidence"))
    kind = F.when(F.col("degree") >= 4, "cross").when(F.col("degree") == 3, "T").when(F.col("degree") == 2, "corner").otherwise("endpoint")
    return at.join(degree, "junction_id").withColumn("type", kind), lines


def trace_nets(segments: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """``(key, seg_id, net_id)``: segments joined over any chain of junctions.

    Segments and junctions are the two sides of one graph, so a junction of many lines costs one
    edge per line and not one per pair.
    """
    seg = _vertex(key, "s")
    links = lines.select(*key, seg.alias("src"), F.concat(F.lit("t"), "junction_id").alias("dst"))
    groups = components_by_key(segments.select(*key, seg.alias("id")), links, key)
    found = groups.filter(F.col("id").startswith("s")).select(F.col("id").alias("_v"), _segment_of("component").alias("net_id"))
    return segments.select(*key, "seg_id", seg.alias("_v")).join(found, "_v").select(*key, "seg_id", "net_id")


def net_endpoints(segments: DataFrame, nets: DataFrame, junction_table: DataFrame, key: list[str], tol: float = 8.0) -> DataFrame:
    """Ends of segments that are not at a junction: where components can connect."""
    ends = segments.join(nets, [*key, "seg_id"]).select(*key, "net_id", F.explode(F.array(
        F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select(*key, "net_id", "p.x", "p.y").distinct()
    taken = near_pairs(ends, junction_table.select(*key, "x", "y"), tol, key).select(*[F.col(f"a.{c}").alias(c) for c in [*key, "net_id", "x", "y"]]).distinct()
    return ends.join(taken, [*key, "net_id", "x", "y"], "left_anti")


def netlist(components: DataFrame, segments: DataFrame, labels: DataFrame, key: list[str], default_pins: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nets, pin connections and what stays unresolved.

    ``components``: ``key, comp_id, designator, pins, pin_labels, x1..y2``; ``segments`` carry ``net_id``;
    ``labels``: primary label per net ``key, net_id, text, confidence`` (may be empty).
    """
    linked = cut(component_nets(components, segments, key))
    comp = components.select(*key, "comp_id", "designator", "pins", "pin_labels")
    pins = linked.join(comp, [*key, "comp_id"]).withColumn("n", F.when(F.col("pin_labels") > 0, F.col("pin_labels")).otherwise(default_pins).cast("int"))
    connections = pins.select(*key, "net_id", "designator", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("pin"))
    counts = connections.groupBy(*key, "net_id").agg(F.count(F.lit(1)).alias("connections"))
    base = segments.select(*key, "net_id").distinct()
    numbered = number_rows(base, key, [F.col("net_id")], "_rn")
    name = F.coalesce("text", F.concat(F.lit("Net_"), F.col("_rn").cast("string")))
    level = F.when(F.col("text").isNotNull(), (F.lit(0.8) + F.col("confidence")) / 2).otherwise(0.8)
    nets = numbered.join(labels, [*key, "net_id"], "left").join(counts, [*key, "net_id"], "left").fillna(0, subset=["connections"]).select(
        *key, "net_id", name.alias("name"), "connections",
        F.least(F.lit(1.0), level * F.when(F.col("connections") > 0, 1.0).otherwise(0.5)).alias("confidence"))
    used = linked.groupBy(*key, "comp_id").agg(F.count(F.lit(1)).alias("used"))
    state = comp.join(used, [*key, "comp_id"], "left").fillna(0, subset=["used"])
    dangling = state.filter(F.col("used") < F.col("pins")).select(
        *key, "designator", F.lit("dangling_pin").alias("reason"),
        F.explode(F.transform(F.sequence(F.col("used") + 1, F.col("pins").cast("bigint")), lambda p: p.cast("string"))).alias("pin"))
    isolated = state.filter("used = 0").select(*key, "designator", F.lit("isolated_component").alias("reason"), F.lit("all").alias("pin"))
    return nets, connections, dangling.unionByName(isolated)


# ---- learning signals ------------------------------------------------------------------------


def geometry_signals(df: DataFrame, minimum: float = 0.1) -> DataFrame:
    """Boxes ``expected`` and ``actual`` and arrays of pin boxes that differ by at least ``minimum``."""
    diff = geo.bbox_diff(F.col("expected"), F.col("actual"))
    e, a = F.col("expected_pins"), F.col("actual_pins")
    each = F.zip_with(e, a, geo.bbox_diff)
    pin = (F.when(F.coalesce(F.size(e) <= 0, F.lit(True)) | F.coalesce(F.size(a) <= 0, F.lit(True)), 0.5).when(F.size(e) != F.size(a), 1.0)
           .otherwise(F.aggregate(each, F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size(e), F.lit(0))))
    t = F.col("total_difference")
    return df.withColumns({"bbox_difference": diff, "pin_difference": pin}).withColumn(
        "total_difference", F.col("bbox_difference") + F.col("pin_difference")).filter(t >= minimum).withColumns({
            "confidence": F.least(F.lit(1.0), t), "severity": F.when(t > 0.7, "high").when(t > 0.3, "medium").otherwise("low")})


def ocr_disagreement(results: DataFrame, key: list[str], gap: float = 0.3) -> DataFrame:
    """Regions where engines read different texts with clearly different confidence.

    One row per ``key`` and engine (``engine, text, confidence``); engines are few, so the pairs
    of a region are bounded by the number of engines.
    """
    one = best_readings(results, key)
    listed = one.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("engine", "r.text", "r.confidence"))).alias("e"))
    texts = F.transform("e", lambda x: x["text"])
    conf = F.transform("e", lambda x: x["confidence"])
    lengths = F.transform("e", lambda x: F.length(x["text"]).cast("double"))
    n = F.size("e")
    mean = F.aggregate(lengths, F.lit(0.0), lambda a, b: a + b) / n
    variance = F.aggregate(lengths, F.lit(0.0), lambda a, b: a + b * b) / n - mean * mean
    distances = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, n), lambda y: F.levenshtein(x["text"], y["text"]).cast("double"))))
    edit = F.aggregate("_d", F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size("_d"), F.lit(0))
    c, d = F.col("confidence_difference"), F.col("avg_edit_distance")
    return listed.filter((n >= 2) & (F.size(F.array_distinct(texts)) > 1)).withColumn(
        "confidence_difference", F.array_max(conf) - F.array_min(conf)).filter(F.round(c, 9) >= gap).withColumn("_d", distances).select(
        *key, n.alias("engine_count"), F.size(F.array_distinct(texts)).alias("unique_results"), "confidence_difference",
        edit.alias("avg_edit_distance"), F.greatest(variance, F.lit(0.0)).alias("text_length_variance")
    ).withColumn("severity", F.when((c > 0.7) | (d > 10), "high").when((c > 0.4) | (d > 5), "medium").otherwise("low"))


def detection_error_class(message: Column) -> Column:
    low = F.lower(message)
    return (F.when(low.contains("pin"), "wrong_pin_count").when(low.contains("type"), "wrong_component_type")
            .when(low.contains("missing"), "missing_component").when(low.contains("duplicate"), "duplicate_detection").otherwise("other"))


def detection_signals(symbols: DataFrame, errors: DataFrame, key: list[str]) -> DataFrame:
    """Per page with errors: counts, diversity, confidence and severity.

    ``symbols``: ``key, confidence``; ``errors``: ``key, message``.
    """
    kind = detection_error_class(F.col("message"))
    e = errors.groupBy(*key).agg(F.count(F.lit(1)).alias("error_count"), F.count_distinct(kind).alias("error_diversity"),
                                 F.count(F.when(kind == "wrong_pin_count", 1)).alias("pin_count_errors"), F.count(F.when(kind == "wrong_component_type", 1)).alias("_types"))
    s = symbols.groupBy(*key).agg(F.count(F.lit(1)).alias("symbol_count"), F.avg("confidence").alias("avg_confidence"))
    severity = F.when(F.col("_types") > 0, "high").when(F.col("error_count") > 3, "medium").otherwise("low")
    return e.join(s, key, "left").fillna(0, subset=["symbol_count", "avg_confidence"]).withColumns({
        "confidence": F.least(F.lit(1.0), F.col("error_count") / 10), "severity": severity}).drop("_types")


def net_conflicts(nets: DataFrame, key: list[str]) -> DataFrame:
    """Nets (``key, net_id, name, voltage``) with several voltages or several names."""
    base = nets.groupBy(*key, "net_id").agg(F.count_distinct("voltage").alias("v"), F.count_distinct("name").alias("m"),
                                            F.count(F.when(F.col("name").contains("VCC") | F.col("name").contains("GND"), 1)).alias("p"))
    kind = F.when(F.col("v") > 1, "voltage").when(F.col("m") > 1, "name")
    return base.withColumn("conflict_type", kind).filter(F.col("conflict_type").isNotNull()).select(
        *key, "net_id", "conflict_type", F.when(F.col("conflict_type") == "voltage", "high").otherwise("medium").alias("severity"),
        F.greatest("v", "m").alias("nets_involved"), (F.col("p") > 0).alias("has_power_nets"), F.lit(0.8).alias("confidence"))


def search_signals(searches: DataFrame) -> DataFrame:
    """Searches that went badly: few clicks, clicks far down, or short reading.

    ``searches``: ``search_id, results, clicks, position_sum, dwell_sum``.
    """
    ctr = F.col("clicks") / F.greatest(F.col("results"), F.lit(1))
    pos = F.col("position_sum") / F.greatest(F.col("clicks"), F.lit(1))
    dwell = F.col("dwell_sum") / F.greatest(F.col("clicks"), F.lit(1))
    out = searches.withColumns({"click_through_rate": ctr, "avg_clicked_position": pos, "avg_dwell_time": dwell})
    bad = [(F.col("click_through_rate") < 0.1), (F.col("avg_clicked_position") > 5), (F.col("avg_dwell_time") < 2.0)]
    n = sum((F.when(c, 1).otherwise(0) for c in bad[1:]), F.when(bad[0], 1).otherwise(0))
    return out.withColumn("_n", n).filter("_n > 0").withColumns({"confidence": F.col("_n") / 3.0, "severity": F.when(F.col("_n") >= 2, "medium").otherwise("low")}).drop("_n")
