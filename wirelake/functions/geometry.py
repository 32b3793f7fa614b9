"""Column functions on boxes ``struct(x1,y1,x2,y2)``, segments of the same shape, and 3-D points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "", names: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> Column:
    return F.struct(*[F.col(f"{prefix}{n}").alias(a) for n, a in zip(names, ("x1", "y1", "x2", "y2"))])


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def bbox_diff(a: Column, b: Column) -> Column:
    """1 - IoU; boxes without overlap differ by 1."""
    return 1.0 - iou(a, b)


def centre(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def centre_distance(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def spatial_relation(text: Column, comp: Column, tolerance: float = 5.0, align: float = 10.0) -> Column:
    """How a text box lies to a component box: the first that fits of contained, overlapping,
    aligned, and the side it is on."""
    (tx, ty), (cx, cy) = centre(text), centre(comp)
    contained = (
        (comp["x1"] - tolerance <= text["x1"]) & (text["x2"] <= comp["x2"] + tolerance)
        & (comp["y1"] - tolerance <= text["y1"]) & (text["y2"] <= comp["y2"] + tolerance))
    apart = (text["x2"] < comp["x1"]) | (comp["x2"] < text["x1"]) | (text["y2"] < comp["y1"]) | (comp["y2"] < text["y1"])
    dx, dy = tx - cx, ty - cy
    return (
        F.when(contained, "contained").when(~apart, "overlapping")
        .when((F.abs(dy) <= align) | (F.abs(dx) <= align), "aligned")
        .when((F.abs(dx) > F.abs(dy)) & (dx > 0), "adjacent_right").when(F.abs(dx) > F.abs(dy), "adjacent_left")
        .when(dy > 0, "adjacent_below").otherwise("adjacent_above"))


#: Base confidence of each relation.
RELATION_BASE = {"contained": 1.0, "overlapping": 0.9, "aligned": 0.8, "adjacent_above": 0.7, "adjacent_below": 0.7,
                 "adjacent_left": 0.6, "adjacent_right": 0.6, "nearest": 0.4}


def spatial_confidence(relation: Column, distance: Column, reach: float = 50.0) -> Column:
    pairs = [c for k, v in RELATION_BASE.items() for c in (F.lit(k), F.lit(v))]
    base = F.coalesce(F.try_element_at(F.create_map(*pairs), relation), F.lit(0.2))
    return base * F.greatest(F.lit(0.1), 1.0 - distance / reach)


def seg_length(s: Column) -> Column:
    return F.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"])


def seg_angle(s: Column) -> Column:
    return F.atan2(s["y2"] - s["y1"], s["x2"] - s["x1"])


def seg_mid(s: Column) -> Column:
    x, y = centre(s)
    return F.struct(x.alias("x"), y.alias("y"))


def _clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def seg_point_dist(s: Column, x: Column, y: Column, infinite: bool = False) -> Column:
    """Distance of a point to the segment, or to the whole line through it."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    len2 = dx * dx + dy * dy
    t = ((x - s["x1"]) * dx + (y - s["y1"]) * dy) / F.nullif(len2, F.lit(0.0))
    t = F.coalesce(t if infinite else _clamp(t), F.lit(0.0))
    return F.hypot(x - (s["x1"] + t * dx), y - (s["y1"] + t * dy))


def seg_intersection(a: Column, b: Column) -> Column:
    """Point where two segments cross, as ``struct(x, y)``; null when they do not (or are parallel)."""
    d = (a["x1"] - a["x2"]) * (b["y1"] - b["y2"]) - (a["y1"] - a["y2"]) * (b["x1"] - b["x2"])
    safe = F.when(F.abs(d) >= 1e-10, d)
    t = ((a["x1"] - b["x1"]) * (b["y1"] - b["y2"]) - (a["y1"] - b["y1"]) * (b["x1"] - b["x2"])) / safe
    u = -((a["x1"] - a["x2"]) * (a["y1"] - b["y1"]) - (a["y1"] - a["y2"]) * (a["x1"] - b["x1"])) / safe
    point = F.struct((a["x1"] + t * (a["x2"] - a["x1"])).alias("x"), (a["y1"] + t * (a["y2"] - a["y1"])).alias("y"))
    return F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), point)


def nearest_on(s: Column, x: Column, y: Column) -> Column:
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    t = F.coalesce(_clamp(((x - s["x1"]) * dx + (y - s["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))), F.lit(0.0))
    return F.struct((s["x1"] + t * dx).alias("x"), (s["y1"] + t * dy).alias("y"))


def end_gap(a: Column, b: Column) -> Column:
    """``struct(distance, x, y)``: shortest way from an end point of one segment to the other."""
    options = []
    for s, o in ((a, b), (b, a)):
        for end in ("1", "2"):
            x, y = s[f"x{end}"], s[f"y{end}"]
            near = nearest_on(o, x, y)
            options.append(F.struct(F.hypot(x - near["x"], y - near["y"]).alias("distance"),
                                    ((x + near["x"]) / 2).alias("x"), ((y + near["y"]) / 2).alias("y")))
    return F.array_min(F.array(*options))


def closest_points(a: Column, b: Column) -> Column:
    """``struct(distance, x, y)``: gap between two segments and the middle of that gap.

    For segments that do not cross, the gap ends at one of the four end points.
    """
    cross = seg_intersection(a, b)
    met = F.when(cross.isNotNull(), F.struct(F.lit(0.0).alias("distance"), cross["x"].alias("x"), cross["y"].alias("y")))
    return F.coalesce(met, end_gap(a, b))


def dist3(p: Column, q: Column) -> Column:
    return F.sqrt(sum(((p[a] - q[a]) * (p[a] - q[a]) for a in "yz"), (p["x"] - q["x"]) * (p["x"] - q["x"])))


def boxes_intersect3(p: Column, d1: Column, q: Column, d2: Column) -> Column:
    """Axis-aligned boxes given by centre and size touch or overlap in all three axes."""
    out = F.lit(True)
    for a in "xyz":
        out = out & (F.abs(p[a] - q[a]) <= (d1[a] + d2[a]) / 2)
    return out


def _position_confidence(s: Column, x: Column, y: Column) -> Column:
    length = seg_length(s)
    rel = F.round(F.hypot(x - s["x1"], y - s["y1"]) / F.when(length >= 1e-6, length), 9)
    return F.when(rel.isNull(), 0.1).when((rel >= 0.1) & (rel <= 0.9), 1.0).when((rel >= 0.05) & (rel <= 0.95), 0.8).otherwise(0.3)


def intersection_confidence(a: Column, b: Column, point: Column) -> Column:
    """Near 1 for a right angle met in the middle of both segments."""
    diff = F.abs(seg_angle(a) - seg_angle(b))
    diff = F.least(diff, F.abs(diff - F.pi()))
    angle = F.greatest(F.lit(0.1), 1.0 - 2 * F.abs(diff - F.pi() / 2) / F.pi())
    return angle * _position_confidence(a, point["x"], point["y"]) * _position_confidence(b, point["x"], point["y"])


#: Page size that schematic boxes are measured in.
PAGE_WIDTH, PAGE_HEIGHT = 1200.0, 1600.0
#: Typical component sizes in mm, first key contained in the type wins.
COMPONENT_SIZES = {"battery": 240, "alternator": 180, "starter": 200, "relay": 30, "fuse": 20, "fuse_box": 200,
                   "relay_box": 150, "ecu": 180, "sensor": 40, "ground": 10, "connector": 40, "light": 150, "switch": 25}


def component_size(kind: Column, text: Column) -> Column:
    """Largest "<n> mm" in the text, else the typical size of the type, else 50."""
    named = F.array_max(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\d+)\s*mm"), F.lit(1)), lambda v: v.cast("int")))
    low = F.lower(F.coalesce(kind, F.lit("")))
    typical = F.lit(None).cast("int")
    for key, size in COMPONENT_SIZES.items():
        typical = F.coalesce(typical, F.when(low.contains(key), size))
    return F.coalesce(named, typical, F.lit(50))


def schematic_position(b: Column, kind: Column, text: Column) -> Column:
    """Quadrant, normalised centre, likely zones, first 3-D estimate and size of a drawn component."""
    x, y = centre(b)
    nx, ny = x / PAGE_WIDTH, y / PAGE_HEIGHT
    left, top = nx < 0.5, ny < 0.5
    low = F.lower(F.coalesce(kind, F.lit("")))
    bay = kind.isin("battery", "starter", "alternator", "relay", "fuse")
    zones = F.array_compact(F.array(
        F.when(bay & left, "Engine Bay - Driver Side").when(bay, "Engine Bay - Passenger Side"),
        F.when(bay & top, "Upper Engine Compartment").when(bay, "Lower Engine Compartment"),
        F.when(kind == "ground", "Chassis Ground Point")))

    def at(px, py, pz):
        return F.struct(*[v.alias(a) for v, a in zip((px, py, pz), "xyz")])

    def fixed(*values):
        return at(*[F.lit(v) for v in values])

    side = at(F.when(left, -400).otherwise(400), F.when(top, 600).otherwise(0), F.when(top, 300).otherwise(0))
    guess = (
        F.when(low.contains("battery"), fixed(350, 400, 100)).when(low.contains("starter"), fixed(-300, 0, -100))
        .when(low.contains("alternator"), fixed(200, 200, 100))
        .when(low.contains("relay") | low.contains("fuse"), fixed(-350, 300, 400)).otherwise(side))
    return F.struct(
        F.concat_ws("-", F.when(top, "top").otherwise("bottom"), F.when(left, "left").otherwise("right")).alias("quadrant"),
        F.round(nx, 3).alias("normalized_x"), F.round(ny, 3).alias("normalized_y"), zones.alias("zones"),
        guess.alias("estimate"), component_size(kind, text).alias("size"))


def bounds_check(x: Column, y: Column, z: Column) -> Column:
    """Whether a place is inside the engine bay, and the first axis that is not."""
    message = F.lit("OK")
    for name, value, low, high in (("Z", z, -400, 800), ("Y", y, -300, 600), ("X", x, -700, 700)):
        text = F.concat(F.lit(f"{name}="), value.cast("string"), F.lit(f" out of bounds [{low}, {high}]"))
        message = F.when((value >= low) & (value <= high), message).otherwise(text)
    return F.struct((message == "OK").alias("ok"), message.alias("message"))
