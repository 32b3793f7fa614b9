"""Windows, orders, best-of picks and top-k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.operators.filters import has_position, literal_map
from wirelake.operators.tiles import alike_topk, tiled_topk
from wirelake.scale import lag_rows, number_rows, running_sum, share_of, top_rows

TENANT = "vehicle_signature"


def share(df: DataFrame, key: str, value: str) -> DataFrame:
    """Share of each row's ``value`` in the total of its key, in percent."""
    return share_of(df, key, value, "_total").withColumn(
        "share", F.when(F.col("_total") != 0, F.col(value) / F.col("_total") * 100).otherwise(0.0)).drop("_total")


def bigram_sequences(df: DataFrame, k: int = 5, min_count: int = 2) -> DataFrame:
    """Most frequent pairs of consecutive interactions of the same user, over all users."""
    pairs = lag_rows(df.select("user_id", "ts", "event_id", "interaction_type"), "user_id",
                     [F.col("ts"), F.col("event_id")], {"before": "interaction_type"})
    counts = pairs.filter(F.col("before").isNotNull()).groupBy(
        F.concat_ws(" -> ", "before", "interaction_type").alias("sequence")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_count).orderBy(F.col("n").desc(), "sequence").limit(k)


def error_streaks(df: DataFrame, count_open: bool = True) -> DataFrame:
    """Per user: runs of more than one failed interaction, and the longest run."""
    base = df.select("user_id", "ts", "event_id", F.col("success"))
    order = [F.col("ts"), F.col("event_id")]
    islands = running_sum(base, "user_id", order, F.col("success").cast("int"), "island")
    runs = islands.groupBy("user_id", "island").agg(F.count(F.when(~F.col("success"), 1)).alias("len"))
    if not count_open:
        last = islands.groupBy("user_id").agg(F.max("island").alias("island"))
        runs = runs.join(last, ["user_id", "island"], "left_anti")
    return runs.groupBy("user_id").agg(
        F.count(F.when(F.col("len") > 1, 1)).alias("error_sequences"), F.max("len").alias("max_streak"))


def group_nearby_spans(spans: DataFrame, key: list[str], proximity: float = 30.0) -> DataFrame:
    """Add ``grp``: a new group starts where the gap to the span before is too large.

    A page is read in order, and is short by nature: its spans are shuffled and sorted once, by ``key``, for both windows and
    for what is aggregated by ``key`` afterwards.
    """
    near = Window.partitionBy(*key).orderBy("y1", "x1", "pos")
    before = lambda name: F.lag(name).over(near)
    prev = spans.withColumns({"_x1": before("x1"), "_x2": before("x2"), "_y2": before("y2")})
    gap = F.col("y1") - F.col("_y2")
    overlap = ~((F.col("x2") < F.col("_x1")) | (F.col("x1") > F.col("_x2")))
    joined = (gap < proximity) & (overlap | (gap < 10))
    fresh = F.when(F.col("_y2").isNull() | joined, 0).otherwise(1)
    upto = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return prev.withColumn("grp", F.sum(fresh).over(upto)).drop("_x1", "_x2", "_y2")


#: Zone box origins (min x, min y, min z); unknown zones use "default".
ZONE_ORIGIN = {"engine_bay": (-1000, -500, 0), "dashboard": (-800, -300, 800), "trunk": (-600, -800, 0),
               "cabin": (-800, -200, 600), "default": (-500, -500, 0)}
#: Height above the zone floor per type; other types use 100.
TYPE_HEIGHT = {"battery": 0, "alternator": 100, "ecu": 200, "relay": 150, "fuse": 100, "sensor": 50, "connector": 75}


def _looked_up(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(literal_map(table), key), F.lit(default))


def auto_positions(components: DataFrame, spacing: float = 100.0) -> DataFrame:
    """Grid places for components without position: ten per row inside their zone."""
    todo = components.filter(~has_position()).select(
        "id", TENANT, "type", F.coalesce("zone", F.lit("default")).alias("zone"))
    ranked = number_rows(todo, [TENANT, "zone"], [F.col("type"), F.col("id")], "rn")
    i = F.col("rn") - 1
    ox, oy, oz = ({k: float(v[a]) for k, v in ZONE_ORIGIN.items()} for a in range(3))
    zone = F.col("zone")
    return ranked.select(
        "id", TENANT, "zone",
        (_looked_up(ox, zone, -500.0) + (i % 10) * spacing).alias("x"),
        (_looked_up(oy, zone, -500.0) + F.floor(i / 10) * spacing).alias("y"),
        (_looked_up(oz, zone, 0.0) + _looked_up({k: float(v) for k, v in TYPE_HEIGHT.items()}, F.col("type"), 100.0)).alias("z"))


def auto_positions_by_type(components: DataFrame, zone_origin: dict, type_offset: dict, spacing: float = 100.0) -> DataFrame:
    """Grid places by (zone, type): five per row, shifted by the zone origin and the type offset."""
    todo = components.filter(~has_position()).select(
        "id", TENANT, F.coalesce("type", F.lit("component")).alias("type"), F.coalesce("zone", F.lit("Unknown")).alias("zone"))
    ranked = number_rows(todo, [TENANT, "zone", "type"], [F.col("id")], "rn")
    i = F.col("rn") - 1

    def base(axis: int) -> Column:
        zone = _looked_up({k: float(v[axis]) for k, v in zone_origin.items()}, F.col("zone"), float(zone_origin["Unknown"][axis]))
        kind = _looked_up({k: float(v[axis]) for k, v in type_offset.items()}, F.col("type"), float(type_offset["component"][axis]))
        return zone + kind

    return ranked.select("id", TENANT, "zone", "type", (base(0) + (i % 5) * spacing).alias("x"), base(1).alias("y"),
                         (base(2) + F.floor(i / 5) * spacing).alias("z"))


def grid_fallback(components: DataFrame, width: float = 2000.0, spacing: float = 150.0, z: float = 100.0) -> DataFrame:
    per_row = int(width / spacing)
    ranked = number_rows(components.select("id", TENANT), TENANT, [F.col("id")], "rn")
    i = F.col("rn") - 1
    return ranked.select("id", TENANT, ((i % per_row) * spacing + spacing / 2).alias("x"),
                         (F.floor(i / per_row) * spacing + spacing / 2).alias("y"), F.lit(z).alias("z"))


#: Designator letters per component type; other types use U.
DESIGNATOR = {"resistor": "R", "capacitor": "C", "inductor": "L", "ic": "U", "transistor": "Q", "diode": "D", "led": "D",
              "connector": "J", "switch": "SW", "fuse": "F", "relay": "K", "transformer": "T", "crystal": "Y", "test_point": "TP"}


def assign_designators(df: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """Keep a given label; else number the components of each letter within ``key``."""
    prefix = _looked_up(DESIGNATOR, F.lower("type"), "U")
    given = F.nullif(F.trim(F.col(label)), F.lit("")) if label else F.lit(None).cast("string")
    base = df.withColumn("_prefix", prefix).withColumn("_given", given)
    open_rows = number_rows(base.filter(F.col("_given").isNull()), [key, "_prefix"], [F.col("id")], "_rn")
    made = open_rows.withColumn("designator", F.concat("_prefix", F.col("_rn").cast("string")))
    kept = base.filter(F.col("_given").isNotNull()).withColumn("designator", F.col("_given"))
    return made.drop("_rn").unionByName(kept).drop("_prefix", "_given")


def best_label(df: DataFrame, keys: list[str]) -> DataFrame:
    """The text with the highest confidence per key; ties go to the smaller text."""
    best = F.max_by("text", F.struct("confidence", F.negative(F.xxhash64("text")))).alias("text")
    return df.groupBy(*keys).agg(best, F.max("confidence").alias("confidence"))


#: Which kind of net label wins.
LABEL_PRIORITY = {"voltage": 5, "power": 4, "ground": 4, "signal": 3, "bus": 3, "custom": 1}


def primary_label(labels: DataFrame, key: str = "net_id") -> DataFrame:
    priority = _looked_up(LABEL_PRIORITY, F.col("label_type"), 0)
    order = [priority.desc(), F.col("confidence").desc(), F.col("text")]
    return top_rows(labels, key, order, 1).drop("rank")


def rank_hits(df: DataFrame, k: int, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    return top_rows(df, query, [F.col("score").desc(), F.col(item)], k)


def model_versions(versions: DataFrame) -> DataFrame:
    """Per model: the latest version, the production one, and the one to roll back to."""
    latest = versions.groupBy("name").agg(F.max_by("version", F.struct("created_at", "version")).alias("latest"))
    prod = top_rows(versions.filter(F.col("stage") == "production"), "name",
                    [F.col("created_at").desc(), F.col("version").desc()], 2)
    picks = prod.groupBy("name").agg(
        F.max(F.when(F.col("rank") == 1, F.col("version"))).alias("production"),
        F.max(F.when(F.col("rank") == 2, F.col("version"))).alias("rollback_to"))
    return latest.join(picks, "name", "left")


def best_run(runs: DataFrame, metric: str = "accuracy", higher: bool = True) -> DataFrame:
    """Best finished run per experiment; the smaller run id wins a tie.

    ``runs``: ``experiment, run_id, status, metric, value``.
    """
    done = runs.filter((F.col("status") == "FINISHED") & (F.col("metric") == metric) & F.col("value").isNotNull())
    value = F.col("value").desc() if higher else F.col("value").asc()
    return top_rows(done, "experiment", [value, F.col("run_id")], 1).select("experiment", "run_id", "value")


def progress_eta(events: DataFrame, key: str, order: list[Column], seconds: str) -> DataFrame:
    """After each step: mean time so far and time left. ``total`` is the size of the key."""
    steps = number_rows(events, key, order, "done")
    timed = running_sum(steps, key, [F.col("done")], F.col(seconds), "elapsed")
    totals = events.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    avg = F.col("elapsed") / F.col("done")
    return timed.join(totals, key).withColumns({"avg_time": avg, "eta": avg * (F.col("total") - F.col("done")),
                                                "percent": F.col("done") / F.col("total") * 100})


def chunk_context(chunks: DataFrame, asked: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """The chunks at most ``k`` before or after each chunk asked for, in order, as one text."""
    wanted = asked.select(doc, F.col("chunk").alias("centre"), F.explode(
        F.sequence(F.col("chunk") - k, F.col("chunk") + k)).alias("chunk"))
    return wanted.join(chunks, [doc, "chunk"]).groupBy(doc, "centre").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda s: s["text"]), "\n").alias("context"))


def _numbers(frame: pd.DataFrame, column: str) -> np.ndarray:
    return frame[column].to_numpy(dtype=float)


def compatible_topk(components: DataFrame, specs: DataFrame, k: int) -> DataFrame:
    """Best components per spec ``(spec_id, target_v, lo_v, hi_v, current, type?)``.

    Score: mean of the closeness to the target voltage and the current band 1.0 / 0.8 / 0.3.
    """

    def score(lp, rp):
        tv, need = _numbers(lp, "target_v")[:, None], _numbers(lp, "current")[:, None]
        v, i = _numbers(rp, "voltage_rating")[None, :], _numbers(rp, "current_rating")[None, :]
        with np.errstate(all="ignore"):
            close = np.where(v == tv, 1.0, 1.0 - np.abs(v - tv) / tv)
            band = np.where(np.isnan(need), 1.0, np.where(i >= need * 2, 1.0, np.where(i >= need, 0.8, 0.3)))
            ok = (v >= _numbers(lp, "lo_v")[:, None]) & (v <= _numbers(lp, "hi_v")[:, None])
            ok &= np.isnan(need) | (i >= need)
        return np.where(ok, (close + band) / 2, -np.inf)

    return tiled_topk(specs, components.select("id", TENANT, "name", "voltage_rating", "current_rating"), [TENANT], k, score,
                      left_id="spec_id", tie=["name", "id"]).withColumnsRenamed(
        {"left_id": "spec_id", "right_id": "component_id", "score": "compatibility_score"})


def replacement_topk(originals: DataFrame, components: DataFrame, k: int, tolerance: float = 1.0) -> DataFrame:
    """Replacement candidates of the same type: close voltage, enough current, scored by what agrees."""
    alike = ["manufacturer", "part_number", "voltage_rating", "current_rating"]

    def score(lp, rp):
        def same(c):
            a, b = lp[c].to_numpy(dtype=object)[:, None], rp[c].to_numpy(dtype=object)[None, :]
            return (a == b) & (lp[c].notna().to_numpy()[:, None])

        v0, v1 = _numbers(lp, "voltage_rating")[:, None], _numbers(rp, "voltage_rating")[None, :]
        i0, i1 = _numbers(lp, "current_rating")[:, None], _numbers(rp, "current_rating")[None, :]
        with np.errstate(all="ignore"):
            ok = np.isnan(v0) | np.isnan(v1) | (np.abs(v1 - v0) <= tolerance)
            ok &= np.isnan(i0) | np.isnan(i1) | (i1 >= i0 * 0.8)
            s = same("manufacturer") * 0.3 + same("part_number") * 0.4 + (v0 == v1) * 0.2 + (i1 >= i0) * 0.1
        return np.where(ok, s, -np.inf)

    columns = ["id", TENANT, "type", *alike]
    return alike_topk(originals.select(*columns), components.select(*columns, "name"), [TENANT, "type"], (alike, alike), k, score,
                      tie=["name", "id"]).withColumnsRenamed({"right_id": "candidate_id", "score": "similarity_score"})


def recent(df: DataFrame, by: str, tie: str, n: int, offset: int = 0, key: str | None = None) -> DataFrame:
    """Newest rows first: a page over all rows, or the newest ``n`` per key."""
    order = [F.col(by).desc(), F.col(tie).desc()]
    if key:
        return top_rows(df, key, order, n)
    paged = df.orderBy(*order)
    return (paged.offset(offset) if offset else paged).limit(n)


def wire_lengths(components: DataFrame, connects_to: DataFrame) -> DataFrame:
    at = components.filter(has_position())
    a = at.select(F.col("id").alias("src"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = at.select(F.col("id").alias("dst"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    d = [F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"]
    length = F.col("total_length")
    return connects_to.select("src", "dst", TENANT).join(a, "src").join(b, "dst").select(
        "src", "dst", TENANT, F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("total_length")
    ).withColumn("routing_complexity", F.when(length > 1000, "high").when(length > 500, "medium").otherwise("low"))


#: Parts that are always given as orientation.
LANDMARKS = ("engine", "battery", "fuse_box", "relay_box", "alternator", "starter")


def peripherals(new: DataFrame, placed: DataFrame, k: int = 8, reach: float = 800.0) -> DataFrame:
    """The ``k`` nearest placed components of the tenant: landmarks at any distance, others within reach."""
    marks = "|".join(LANDMARKS)

    def score(lp, rp):
        d = np.sqrt(sum((_numbers(lp, a)[:, None] - _numbers(rp, a)[None, :]) ** 2 for a in "xyz"))
        major = rp["major"].to_numpy(dtype=bool)[None, :]
        return np.where(major | (d <= reach), -d, -np.inf)

    at = ["x", "y", "z"]
    return alike_topk(new.filter(has_position()).select("id", TENANT, *at),
                      placed.filter(has_position()).select("id", TENANT, F.lower(F.concat_ws(" ", "type", "name")).rlike(marks).alias("major"), *at),
                      [TENANT], (at, ["major", *at]), k, score
                      ).select("id", F.col("right_id").alias("peripheral_id"), F.negative("score").alias("distance"), "rank")


def needs_inspection(components: DataFrame, edges: DataFrame, cutoff: Column | None = None) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("relationship_count"))
    out = components.join(degree, "id", "left").fillna(0, subset=["relationship_count"])
    reason = (
        F.when(F.col("relationship_count") == 0, "orphaned").when(~has_position(), "missing_position")
        .when(F.col("voltage_rating").isNull() | F.col("current_rating").isNull(), "missing_electrical"))
    if cutoff is not None:
        reason = reason.when(F.col("updated_at") < cutoff, "outdated")
    return out.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("id", TENANT, "relationship_count", "reason")


def text_regions(boxes: DataFrame, min_area: float = 100.0) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ratio = w / F.nullif(h, F.lit(0.0))
    return boxes.withColumns({"area": w * h, "aspect_ratio": ratio}).filter(
        (F.col("area") > min_area) & (F.col("aspect_ratio") > 0.1) & (F.col("aspect_ratio") < 20))


def favourites(df: DataFrame, k: int = 5, user: str = "user_id", item: str = "target_object_id") -> DataFrame:
    counts = df.filter(F.col(item).isNotNull()).groupBy(user, item).agg(F.count(F.lit(1)).alias("n"))
    return top_rows(counts, user, [F.col("n").desc(), F.col(item)], k)
