"""Density clusters in several dimensions, exact, by a grid of cells.

Equal points are merged.  A cell is so small that its points are all near each other, so a cell with enough points
is core as a whole, and its core points are one vertex of the graph whose components are the clusters.  Only occupied cells
that lie near each other meet; where the boxes around their points already tell that all pairs, or none, are near, no
points are compared.  The rest is compared in tiles of bounded size: the points of a crowded cell are dealt over many.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.operators.graph import connected_components
from wirelake.session import cut

#: Points of one side of a tile.
TILE = 2048


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _boxes(points: DataFrame, axes: list[str]) -> DataFrame:
    """Per cell: weight, number of points and the box around them."""
    ends = [f(x).alias(f"{name}{x}") for x in axes for name, f in (("lo_", F.min), ("hi_", F.max))]
    return points.groupBy("cell").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("points"), *ends)


def _near_cells(boxes: DataFrame, other: DataFrame, axes: list[str], eps: float, side: float) -> DataFrame:
    """``cell, near, sure, weight, points``: cells of ``boxes`` and of ``other`` with points that can be within ``eps``.

    ``sure``: all of their points are.  Weight and points are those of ``near``.  Cells are filed under blocks as wide as
    ``eps``; a block has a bounded number of cells, and only occupied blocks meet.
    """
    wide = math.ceil(math.sqrt(len(axes)))
    block = F.transform("cell", lambda c: F.floor(c / wide))
    one = boxes.withColumn("block", block)
    two = other.withColumn("block", block).select("block", F.col("cell").alias("near"), "weight", "points", *[F.col(f"{e}{x}").alias(f"n{e}{x}") for x in axes for e in ("lo_", "hi_")])
    # blocks first: they are far fewer than cells
    steps = F.array(*[F.array(*[F.lit(s).cast("bigint") for s in step]) for step in itertools.product((-1, 0, 1), repeat=len(axes))])
    shifted = one.select("block").distinct().withColumn("step", F.explode(steps)).select("block", F.zip_with("block", "step", lambda a, b: a + b).alias("next"))
    met = cut(shifted.join(two.select(F.col("block").alias("next")).distinct(), "next", "left_semi"))
    pairs = one.drop("weight", "points").join(met, "block").join(two.withColumnRenamed("block", "next"), "next")
    gap = [F.greatest(F.col(f"nlo_{x}") - F.col(f"hi_{x}"), F.col(f"lo_{x}") - F.col(f"nhi_{x}"), F.lit(0.0)) for x in axes]
    span = [F.greatest(F.col(f"nhi_{x}") - F.col(f"lo_{x}"), F.col(f"hi_{x}") - F.col(f"nlo_{x}")) for x in axes]
    least, most = _sum([g * g for g in gap]), _sum([s * s for s in span])
    return pairs.filter(least <= eps * eps).select("cell", "near", (most <= eps * eps).alias("sure"), "weight", "points")


def _compare(left: DataFrame, right: DataFrame, pairs: DataFrame, axes: list[str], eps: float) -> DataFrame:
    """``pid, cell, near, weight, label``: for points of ``left``, the weight and least label of ``right`` points within ``eps``.

    ``pairs``: ``cell, near``.  Both sides are dealt into tiles by the number of their points in the cell.
    """
    sized = lambda df: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    asked = pairs.join(sized(left).withColumnRenamed("parts", "mine"), "cell").join(sized(right).select(F.col("cell").alias("near"), F.col("parts").alias("others")), "near")
    asked = cut(asked.select(F.monotonically_increasing_id().alias("pair"), "cell", "near", "mine", "others"))
    own = lambda n: F.pmod(F.xxhash64("pid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(asked, "cell").select("pair", own("mine").alias("i"), every("others").alias("j"), "cell", "near", F.lit(True).alias("asks"), "pid", "w", F.lit(None).cast("bigint").alias("label"), *axes)
    b = right.withColumnRenamed("cell", "near").join(asked, "near").select("pair", every("mine").alias("i"), own("others").alias("j"), "cell", "near", F.lit(False).alias("asks"), "pid", "w", "label", *axes)

    def tile(held: pa.Table) -> pa.Table:
        side = held.column("asks").to_numpy()
        mine, others = held.filter(pa.array(side)), held.filter(pa.array(~side))
        x = np.stack([mine.column(c).to_numpy() for c in axes], 1)
        y = np.stack([others.column(c).to_numpy() for c in axes], 1)
        w, label = others.column("w").to_numpy(), others.column("label").to_numpy()
        total, least = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        for at in range(0, len(x), 256):
            far = np.zeros((len(x[at : at + 256]), len(y)))
            for k in range(len(axes)):  # in the order of the axes, as everywhere
                far += (x[at : at + 256, k, None] - y[None, :, k]) ** 2
            near = far <= eps * eps
            total[at : at + 256] = near @ w
            least[at : at + 256] = np.where(near, label[None, :], np.iinfo(np.int64).max).min(1) if len(y) else least[at : at + 256]
        some = total > 0
        out = mine.filter(pa.array(some))
        return pa.table({"pid": out.column("pid"), "cell": out.column("cell"), "near": out.column("near"), "weight": total[some], "label": least[some]})

    return cut(a.unionByName(b).groupBy("pair", "i", "j").applyInArrow(tile, "pid long, cell array<long>, near array<long>, weight long, label long"))


def density_clusters(points: DataFrame, key: str, axes: list[str], eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """``key, cluster, kind`` for every row: ``core``, ``border`` or ``noise``.

    A point is core when at least ``min_points`` rows, itself among them, are within ``eps``.  Core points within ``eps``
    of each other are in one cluster, named by the smallest ``key`` (a long) of its core points.  A border point is within
    ``eps`` of a core point and goes to the smallest such cluster; noise has cluster -1.  Rows with a null or NaN
    coordinate or a null key are left out.
    """
    side = eps / math.sqrt(len(axes)) * (1 - 1e-9)
    good = points.dropna(subset=[key, *axes]).filter(~reduce(lambda a, b: a | b, [F.isnan(x) for x in axes])).select(F.col(key).cast("bigint").alias("key"), *axes)
    merged = good.groupBy(*axes).agg(F.count(F.lit(1)).alias("w"), F.min("key").alias("label"))
    spots = cut(merged.select(F.monotonically_increasing_id().alias("pid"), F.array(*[F.floor(F.col(x) / side) for x in axes]).alias("cell"), "w", "label", *axes))
    boxes = cut(_boxes(spots, axes))
    near = cut(_near_cells(boxes, boxes, axes, eps, side))
    crowded = boxes.filter(F.col("weight") >= min_points).select("cell")
    # points of other cells: weights of cells that are near as a whole, then points of cells that are near in part
    few = cut(spots.join(crowded, "cell", "left_anti"))
    whole = near.filter("sure").groupBy("cell").agg(F.sum("weight").alias("whole"))
    open_cells = few.select("cell").distinct().join(whole.filter(F.col("whole") >= min_points), "cell", "left_anti")
    partly = near.filter("NOT sure").join(open_cells, "cell", "left_semi").select("cell", "near")
    counted = _compare(few, spots, partly, axes, eps).groupBy("pid").agg(F.sum("weight").alias("part"))
    total = few.join(whole, "cell", "left").join(counted, "pid", "left").withColumn("total", F.coalesce("whole", F.lit(0)) + F.coalesce("part", F.lit(0)))
    some_core = total.filter(F.col("total") >= min_points).select(*spots.columns)
    core = cut(spots.join(crowded, "cell", "left_semi").select(*spots.columns).unionByName(some_core))
    # cells of core points are the vertices; sure links first, as most of the others then lie in one cluster already
    vertices = cut(core.groupBy("cell").agg(F.min("label").alias("label")).withColumn("id", F.concat_ws(",", "cell")))
    name = lambda c: F.concat_ws(",", c)
    core_boxes = cut(_boxes(core, axes))
    links = cut(_near_cells(core_boxes, core_boxes, axes, eps, side).select("cell", "near", "sure", name("cell").alias("src"), name("near").alias("dst")).filter("src < dst"))
    sure = links.filter("sure").select("src", "dst")
    first = connected_components(vertices, sure)
    open_links = links.filter("NOT sure").join(first.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(first.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
    checked = _compare(core, core, open_links.filter("a <> b").select("cell", "near"), axes, eps).select(name("cell").alias("src"), name("near").alias("dst")).distinct()
    groups = connected_components(vertices, sure.unionByName(checked))
    named = groups.join(vertices.select("id", "cell", "label"), "id")
    cluster = cut(named.join(named.groupBy("component").agg(F.min("label").alias("cluster")), "component").select("cell", "cluster"))
    inside = core.select("pid", "cell").join(cluster, "cell").select("pid", "cluster", F.lit("core").alias("kind"))
    rest = cut(few.join(core.select("pid"), "pid", "left_anti"))
    around = cut(_near_cells(boxes.join(rest.select("cell").distinct(), "cell", "left_semi"), core_boxes, axes, eps, side))
    at_whole = rest.join(around.filter("sure"), "cell").join(cluster.withColumnRenamed("cell", "near"), "near").select("pid", "cluster")
    labelled = core.drop("label").join(cluster, "cell").withColumnRenamed("cluster", "label")
    at_part = _compare(rest, labelled, around.filter("NOT sure").select("cell", "near"), axes, eps).select("pid", F.col("label").alias("cluster"))
    border = at_whole.unionByName(at_part).groupBy("pid").agg(F.min("cluster").alias("cluster")).withColumn("kind", F.lit("border"))
    found = spots.select("pid", *axes).join(inside.unionByName(border), "pid", "left")
    on = reduce(lambda a, b: a & b, [good[x] == found[x] for x in axes])
    return good.join(found, on).select(good["key"].alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("kind", F.lit("noise")).alias("kind"))
