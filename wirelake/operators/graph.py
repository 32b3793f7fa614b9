"""Graph work on edge tables ``(src, dst, rel_type, vehicle_signature)``.

Loops run on DataFrames: each round is a join on node ids plus an aggregate, and is written to the
checkpoint folder so that the plan stays short and a lost executor costs one round.  Only counts
come back to the driver.  Tenants never mix because node ids are joined, and all tenants, sources
and pairs advance in the same round.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.scale import top_rows
from wirelake.session import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in stored and in reversed direction, as ``src, dst, rel_type``."""
    keep = [c for c in edges.columns if c not in {"src", "dst"}]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *keep)
    return edges.select("src", "dst", *keep).unionByName(back)


def reversed_edges(edges: DataFrame) -> DataFrame:
    keep = [c for c in edges.columns if c not in {"src", "dst"}]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *keep)


def bounded_closure(edges: DataFrame, starts: DataFrame | None = None, depth: int = 5) -> DataFrame:
    """``(start, node, depth)``: nodes reached in 1..depth steps along ``src -> dst``, fewest steps.

    ``starts`` has one column ``start``; without it every edge source is a start.
    """
    steps = edges.select("src", "dst").distinct()
    level = steps.select(F.col("src").alias("start"), F.col("dst").alias("node"))
    if starts is not None:
        level = level.join(starts.select("start").distinct(), "start", "left_semi")
    reached = cut(level.withColumn("depth", F.lit(1)))
    level = reached
    for step in range(2, depth + 1):
        found = (
            level.select("start", F.col("node").alias("src"))
            .join(steps, "src")
            .select("start", F.col("dst").alias("node"))
            .distinct()
            .join(reached.select("start", "node"), ["start", "node"], "left_anti")
        )
        level = cut(found.withColumn("depth", F.lit(step)))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached


def _ways_back(steps: DataFrame, longest: int) -> DataFrame:
    """``edge_id, node, left``: the fewest steps from ``node`` to the start of an edge, for the nodes that lie with it on
    a closed walk of at most ``longest`` edges.  The halves of the closed walks meet in the middle."""
    plain = cut(steps.select("src", "dst").distinct())
    ahead = steps.select("src", "dst", "edge_id", F.array("dst").alias("nodes"))
    back = plain.select("src", "dst", F.array("dst").alias("nodes"))
    first, second = {1: ahead}, {1: back}

    def longer(walks: DataFrame) -> DataFrame:
        on = plain.select(F.col("src").alias("dst"), F.col("dst").alias("_to"))
        return cut(walks.join(on, "dst").withColumn("nodes", F.array_append("nodes", F.col("_to"))).withColumn("dst", F.col("_to")).drop("_to"))

    for n in range(2, (longest + 1) // 2 + 1):
        first[n] = longer(first[n - 1])
    for n in range(2, longest // 2 + 1):
        second[n] = longer(second[n - 1])
    closed = [ahead.filter("src = dst")] if longest > 0 else []
    for n in range(2, longest + 1):
        home = second[n // 2].select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("nodes").alias("_rest"))
        closed.append(first[(n + 1) // 2].join(home, ["src", "dst"]).withColumn("nodes", F.concat("nodes", "_rest")).drop("_rest"))
    places = [c.select("edge_id", F.size("nodes").alias("_n"), F.posexplode("nodes").alias("_i", "node")) for c in closed]
    if not places:
        places = [steps.filter(F.lit(False)).select("edge_id", F.lit(1).alias("_n"), F.lit(0).alias("_i"), F.col("src").alias("node"))]
    return cut(reduce(DataFrame.unionByName, places).groupBy("edge_id", "node").agg(F.min(F.col("_n") - 1 - F.col("_i")).alias("left")))


def trail_counts(
    edges: DataFrame,
    sources: DataFrame,
    depth: int = 5,
    weight: Column | None = None,
    by_source: bool = True,
) -> DataFrame:
    """Number and summed weight of paths without repeated edges, per end node and length.

    Paths are not listed.  An edge is remembered only as long as the path can still come back to it within ``depth``, and
    paths that meet at a node with the same remembered edges are added up, so there is one row per (source, node)
    and length, and a few more near short cycles.
    ``sources`` has ``start`` and ``vehicle_signature``.
    """
    weight = F.lit(1.0) if weight is None else weight
    named = edges.withColumn("w", weight).groupBy("src", "dst", "rel_type").agg(F.collect_set(F.struct("w")).alias("ws"))
    named = cut(named.withColumn("edge_id", F.monotonically_increasing_id()))
    returns = _ways_back(named, depth - 1)
    own = returns.select("edge_id", F.col("node").alias("dst"), F.col("left").alias("own"))
    steps = cut(named.join(own, ["edge_id", "dst"], "left").select("src", "dst", "edge_id", "own", F.explode("ws").alias("_w")).select("src", "dst", "edge_id", "own", "_w.w"))
    start = F.col("start") if by_source else F.lit(None).cast("string")
    level = sources.select(
        "vehicle_signature",
        start.alias("start"),
        F.col("start").alias("node"),
        F.array().cast("array<bigint>").alias("used"),
        F.lit(1).cast("bigint").alias("paths"),
        F.lit(0.0).alias("weight_sum"),
    )
    keys = ["vehicle_signature", "start", "node"]
    sums = [F.sum("paths").alias("paths"), F.sum("weight_sum").alias("weight_sum")]
    out = None
    for step in range(1, depth + 1):
        spare = depth - step - 1  # steps that may lie between here and the start of an edge walked again
        used = F.when(F.col("own") <= spare, F.array_sort(F.array_append("used", F.col("edge_id")))).otherwise(F.col("used"))
        level = (
            level.withColumnRenamed("node", "src")
            .join(steps, "src")
            .filter(~F.array_contains("used", F.col("edge_id")))
            .select(
                "vehicle_signature", "start", F.col("dst").alias("node"), (used if spare >= 0 else F.array().cast("array<bigint>")).alias("used"),
                "paths", (F.col("weight_sum") + F.col("w") * F.col("paths")).alias("weight_sum"),
            )
            .groupBy(*keys, "used").agg(*sums)
        )
        if spare >= 0:
            level = _forget(level, returns, keys, spare).groupBy(*keys, "used").agg(*sums)
        level = cut(level)
        found = level.groupBy(*keys).agg(*sums).withColumn("length", F.lit(step))
        out = found if out is None else out.unionByName(found)
    return out


def _forget(level: DataFrame, returns: DataFrame, keys: list[str], spare: int) -> DataFrame:
    """The rows without those remembered edges whose start is more than ``spare`` steps away."""
    near = returns.filter(F.col("left") <= spare).select(F.col("edge_id").alias("_e"), "node", F.lit(True).alias("_near"))
    kept = F.array_sort(F.collect_list(F.when(F.col("_near"), F.col("_e"))))
    return (
        level.withColumn("_e", F.explode_outer("used")).join(near, ["_e", "node"], "left")
        .groupBy(*keys, F.col("used").alias("_used"))
        .agg(kept.alias("used"), F.first("paths").alias("paths"), F.first("weight_sum").alias("weight_sum"))
        .drop("_used")
    )


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(id, component)`` with ``component`` the smallest id that is connected to ``id``.

    Alternating star contraction: neighbours are re-linked to local minima until nothing changes.
    Rounds grow with the logarithm of the graph size; hubs only cost an aggregate and a join.
    """
    links = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    links = cut(links.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    signature = None
    for _ in range(max_rounds):
        # large star: every larger neighbour points to the minimum around u
        pairs = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        minima = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            pairs.filter("v > u").join(minima, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        large = cut(large)
        # small star: every smaller neighbour and u itself point to the minimum
        minima = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(minima, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(minima.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        links = cut(small)
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == signature:
            break
        signature = now
    else:
        raise RuntimeError("connected components did not settle")
    labels = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return vertices.select("id").distinct().join(labels, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


#: Links that are solved at once inside a task.
LOCAL_LINKS = 500_000


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For ``0 .. n - 1``: the smallest number that is linked to it by the pairs ``a, b``, over any chain."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        for end in (label[a], label[b]):
            np.minimum.at(label, end, low)
        while True:  # follow labels to their end
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _solved(table: pa.Table) -> pa.RecordBatch:
    """``id, component`` for the ends ``src, dst`` of all rows."""
    both = pa.concat_arrays([c for name in ("src", "dst") for c in table[name].chunks]).dictionary_encode()
    order = np.asarray(pc.array_sort_indices(both.dictionary), dtype=np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[np.asarray(both.indices, dtype=np.int64)]
    label = smallest_linked(len(order), codes[:table.num_rows], codes[table.num_rows:])
    return pa.RecordBatch.from_arrays([both.dictionary.take(pa.array(order)), both.dictionary.take(pa.array(order[label]))], names=["id", "component"])


def components_by_key(vertices: DataFrame, links: DataFrame, key: list[str], limit: int = LOCAL_LINKS) -> DataFrame:
    """``connected_components`` where each vertex ``key, id`` and each link ``key, src, dst`` belongs to one key.

    The links of a key meet in one task, which solves many keys at once.  Keys of more than ``limit`` links go through the rounds
    over all tasks.
    """
    alone = vertices.select(*key, F.col("id").alias("src"), F.col("id").alias("dst"))
    rows = cut(links.select(*key, "src", "dst").unionByName(alone))
    large = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*key))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            kept.append(batch)
            held += batch.num_rows
            if held < limit:
                continue
            table = pa.Table.from_batches(kept)
            before = np.zeros(held, bool)  # rows of another key than the last one
            for name in key:
                code = np.asarray(table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices)
                before |= code != code[-1]
            last = int(before.nonzero()[0][-1]) + 1 if before.any() else 0
            if last:
                yield _solved(table.slice(0, last))
                kept, held = table.slice(last).to_batches(), held - last
        if held:
            yield _solved(pa.Table.from_batches(kept))

    kind = dict(rows.dtypes)["src"]
    small, done = rows, None
    if not large.isEmpty():
        hot = rows.join(large, key, "left_semi")
        small = rows.join(large, key, "left_anti")
        done = connected_components(hot.select(F.col("src").alias("id")), hot.select("src", "dst"))
    found = cut(small.repartition(*key).sortWithinPartitions(*key).mapInArrow(solve, f"id {kind}, component {kind}"))
    return found if done is None else found.unionByName(done)


def bfs(
    edges: DataFrame, starts: DataFrame, max_depth: int | None, targets: DataFrame | None = None
) -> DataFrame:
    """Breadth-first levels ``(start, node, depth, parent, rel_type)``; the start has depth 0.

    Levels go on until nothing new is reached where ``max_depth`` is None.
    Among equal-length ways the smallest ``(parent, rel_type)`` is kept.  With ``targets``
    ``(start, target)`` a start stops growing once all its targets are reached.
    """
    kind = F.min("rel_type") if "rel_type" in edges.columns else F.lit("EDGE")
    steps = cut(edges.groupBy("src", "dst").agg(kind.alias("rel_type")))
    level = cut(
        starts.select("start").distinct().select(
            "start", F.col("start").alias("node"), F.lit(0).alias("depth"),
            F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("rel_type"))
    )
    seen = level
    for step in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        if targets is not None:
            missing = targets.join(
                seen.select("start", F.col("node").alias("target")), ["start", "target"], "left_anti"
            ).select("start").distinct()
            level = level.join(missing, "start", "left_semi")
        found = (
            level.select("start", F.col("node").alias("src"))
            .join(steps, "src")
            .groupBy("start", F.col("dst").alias("node"))
            .agg(F.min(F.struct(F.col("src").alias("parent"), "rel_type")).alias("best"))
            .join(seen.select("start", "node"), ["start", "node"], "left_anti")
        )
        level = cut(found.select("start", "node", F.lit(step).alias("depth"), "best.parent", "best.rel_type"))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level)) if step % 4 == 0 else seen.unionByName(level)
    return seen


def shortest_paths(
    edges: DataFrame, pairs: DataFrame, max_depth: int = 15, with_nodes: bool = True
) -> DataFrame:
    """One shortest undirected path per ``(source, target)`` pair; unreachable pairs give no row.

    Searches from both ends meet in the middle, so each side only grows to half the depth.  Near
    pairs are found with a small depth first; only the others are searched further.
    Returns ``source, target, path_length, path_nodes, path_relationships``; the last two only ``with_nodes``.
    """
    if not with_nodes:
        return path_lengths(edges, pairs, max_depth)
    ways = both_ways(edges)
    wanted = cut(pairs.select("source", "target").distinct())
    out = None
    for depth in sorted({min(d, max_depth) for d in (4, 8, max_depth)}):
        found = _meet(ways, wanted, depth)
        out = found if out is None else out.unionByName(found)
        if depth < max_depth:
            wanted = cut(wanted.join(found.select("source", "target"), ["source", "target"], "left_anti"))
            if wanted.isEmpty():
                break
    return out


def path_lengths(edges: DataFrame, pairs: DataFrame, max_depth: int = 15) -> DataFrame:
    """``source, target, path_length``: the fewest undirected steps, at most ``max_depth``, between the ends of each pair.

    Nodes are numbered.  The ends of walks of exactly ``n`` steps are kept from both sides, one side a step longer in turn; the
    first number of steps at which both sides share a node is the length.  Pairs that are found grow no further.
    """
    wanted, edges = cut(pairs.select("source", "target").distinct()), cut(edges.select("src", "dst").distinct())
    names = [df.select(F.col(c).alias("name")) for df, ends in ((edges, ("src", "dst")), (wanted, ("source", "target"))) for c in ends]
    numbers = cut(reduce(DataFrame.unionByName, names).distinct().withColumn("number", F.monotonically_increasing_id()))

    def numbered(df: DataFrame, ends: dict[str, str]) -> DataFrame:
        for name, new in ends.items():
            df = df.join(numbers.select(F.col("name").alias(name), F.col("number").alias(new)), name)
        return df

    steps = cut(both_ways(numbered(edges, {"src": "a", "dst": "b"}).select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct())
    wanted = cut(numbered(wanted, {"source": "s", "target": "t"}))
    out = wanted.filter("s = t").select("source", "target", F.lit(0).alias("path_length"))
    left = cut(wanted.filter("s <> t").select("s", "t"))
    sides = {end: left.select(end, F.col(end).alias("node")).distinct() for end in ("s", "t")}
    lengths = None
    for length in range(1, max_depth + 1):
        end = "s" if length % 2 else "t"
        live = sides[end].join(left.select(end).distinct(), end, "left_semi")
        sides[end] = cut(live.withColumnRenamed("node", "src").join(steps, "src").select(end, F.col("dst").alias("node")).distinct())
        found = cut(left.join(sides["s"], "s").join(sides["t"], ["t", "node"]).select("s", "t").distinct().withColumn("path_length", F.lit(length)))
        lengths = found if lengths is None else lengths.unionByName(found)
        left = cut(left.join(found, ["s", "t"], "left_anti"))
        if left.isEmpty():
            break
    return out if lengths is None else out.unionByName(wanted.join(lengths, ["s", "t"]).select("source", "target", "path_length"))


def _meet(ways: DataFrame, wanted: DataFrame, max_depth: int) -> DataFrame:
    """Shortest paths of at most ``max_depth`` edges for the pairs that have one."""
    half = (max_depth + 1) // 2
    ahead = cut(bfs(ways, wanted.select(F.col("source").alias("start")), half))
    back = cut(bfs(ways, wanted.select(F.col("target").alias("start")), max_depth - half))
    meets = (
        wanted.join(ahead.select(F.col("start").alias("source"), "node", F.col("depth").alias("_a")), "source")
        .join(back.select(F.col("start").alias("target"), "node", F.col("depth").alias("_b")), ["target", "node"])
    )
    best = cut(meets.groupBy("source", "target").agg(
        F.min(F.struct((F.col("_a") + F.col("_b")).alias("n"), F.col("node"))).alias("m")
    ).select("source", "target", F.col("m.n").alias("path_length"), F.col("m.node").alias("meet")))
    none = F.array().cast("array<string>")
    walk = best.withColumns({"at": F.col("meet"), "path_nodes": F.array("meet"), "path_relationships": none})
    walk = _follow(walk, ahead, "source", half, lambda old, new: F.concat(new, old))
    walk = walk.withColumn("at", F.col("meet"))
    walk = _follow(walk, back, "target", max_depth - half, lambda old, new: F.concat(old, new))
    return walk.select("source", "target", "path_length", "path_nodes", "path_relationships")


def _follow(walk: DataFrame, tree: DataFrame, end: str, depth: int, join) -> DataFrame:
    """Walk from ``at`` up the search tree of ``end``, adding nodes and edge types on the way."""
    links = tree.filter(F.col("parent").isNotNull()).select(
        F.col("start").alias(end), F.col("node").alias("at"), F.col("parent").alias("_up"), F.col("rel_type").alias("_type"))
    for _ in range(depth):
        step = walk.join(links, [end, "at"], "left")
        found = F.col("_up").isNotNull()
        walk = cut(step.withColumns({
            "path_nodes": F.when(found, join(F.col("path_nodes"), F.array("_up"))).otherwise(F.col("path_nodes")),
            "path_relationships": F.when(found, join(F.col("path_relationships"), F.array("_type"))).otherwise(F.col("path_relationships")),
            "at": F.col("_up")}).drop("_up", "_type"))
        if walk.filter(F.col("at").isNotNull()).isEmpty():
            break
    return walk


def resistance(edges: DataFrame) -> Column:
    """The stored resistance of an edge; 0.1 where there is none."""
    return F.coalesce(F.col("resistance"), F.lit(0.1)) if "resistance" in edges.columns else F.lit(0.1)


def path_electrical(paths: DataFrame, current: float, edges: DataFrame | None = None) -> DataFrame:
    """Summed resistance (0.1 per edge where none is stored) and the voltage drop R*I/1000.

    With ``edges`` (``src, dst, rel_type, resistance``) the steps of ``path_nodes`` and ``path_relationships`` are looked up, in
    either direction; of parallel edges the least resistance counts.
    """
    if edges is None:
        found = paths.withColumn("total_resistance", F.col("path_length") * F.lit(0.1))
    else:
        values = both_ways(edges.select("src", "dst", "rel_type", resistance(edges).alias("r"))).groupBy("src", "dst", "rel_type").agg(F.min("r").alias("r"))
        n = F.size("path_nodes") - 1
        steps = F.arrays_zip(F.slice("path_nodes", 1, n).alias("src"), F.slice("path_nodes", 2, n).alias("dst"), F.col("path_relationships").alias("rel_type"))
        walked = paths.filter("path_length > 0").select("source", "target", F.explode(steps).alias("s")).select(
            "source", "target", F.col("s")["src"].alias("src"), F.col("s")["dst"].alias("dst"), F.col("s")["rel_type"].alias("rel_type"))
        sums = walked.join(values, ["src", "dst", "rel_type"]).groupBy("source", "target").agg(F.sum("r").alias("total_resistance"))
        found = paths.join(sums, ["source", "target"], "left").withColumn("total_resistance", F.coalesce("total_resistance", F.lit(0.0)))
    return found.withColumn("voltage_drop", F.col("total_resistance") * F.lit(current) / 1000)


def k_paths(edges: DataFrame, pairs: DataFrame, k: int = 5, max_depth: int = 10) -> DataFrame:
    """The ``k`` shortest undirected paths without repeated edges for each pair.

    Beginnings from both ends meet: for paths of ``n`` steps each side is ``n // 2`` steps long, and one more step is taken where ``n`` is
    odd.  Lengths start at that of the shortest path of a pair and end where it has ``k`` paths or at ``max_depth``.
    """
    wanted = cut(pairs.select("source", "target").distinct())
    base = edges.select("src", "dst", "rel_type").distinct().withColumn("edge_id", F.xxhash64("src", "dst", "rel_type"))
    steps = cut(both_ways(base))
    pair = ["source", "target"]
    lengths = path_lengths(edges, wanted.filter("source <> target"), max_depth).select(*pair)
    open_pairs = cut(lengths.unionByName(wanted.filter("source = target")).withColumn("n", F.lit(0).cast("bigint")))

    def begun(end: str) -> DataFrame:
        return open_pairs.select(*pair, F.col(end).alias("src"), F.array(end).alias("nodes"), F.array().cast("array<bigint>").alias("used"), F.array().cast("array<string>").alias("rels"))

    def longer(df: DataFrame) -> DataFrame:
        return df.join(steps, "src").filter(~F.array_contains("used", F.col("edge_id"))).select(
            *pair, F.col("dst").alias("src"), F.array_append("nodes", F.col("dst")).alias("nodes"),
            F.array_append("used", F.col("edge_id")).alias("used"), F.array_append("rels", F.col("rel_type")).alias("rels"))

    sides = {end: begun(end) for end in pair}
    done = None
    for length in range(1, max_depth + 1):
        if length % 2 == 0:
            sides = {end: cut(longer(df.join(open_pairs.select(*pair), pair, "left_semi"))) for end, df in sides.items()}
        near = sides["source"].join(open_pairs.select(*pair), pair, "left_semi")
        far = sides["target"].select(*pair, "src", *[F.reverse(c).alias(f"_{c}") for c in ("nodes", "used", "rels")])
        met = (longer(near) if length % 2 else near).join(far, [*pair, "src"]).filter(~F.arrays_overlap("used", "_used"))
        hits = met.select(*pair, F.lit(length).alias("path_length"), F.concat("nodes", F.slice("_nodes", F.lit(2), F.size("_nodes") - 1)).alias("path_nodes"), F.concat("rels", "_rels").alias("path_relationships"))
        order = [F.array_join("path_nodes", ">"), F.array_join("path_relationships", ">")]
        found = cut(top_rows(hits, pair, order, k, "_rank").join(open_pairs, pair).withColumn("path_index", F.col("_rank") + F.col("n")).filter(F.col("path_index") <= k).drop("_rank", "n"))
        done = found if done is None else done.unionByName(found)
        if length == max_depth:
            break
        counts = found.groupBy(*pair).agg(F.count(F.lit(1)).alias("_more"))
        open_pairs = cut(open_pairs.join(counts, pair, "left").select(*pair, (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n")).filter(F.col("n") < k))
        if open_pairs.isEmpty():
            break
    return done


def neighbours(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` undirected steps: fewest steps, and the types of the last edges used
    on any path of that reach that does not turn back over the same edge at once."""
    near = cut(bfs(both_ways(edges), starts, hops).select("start", "node", "depth"))
    last = both_ways(edges).select("src", "dst", "rel_type").distinct()
    # a last edge counts when its other end is reachable with one step to spare
    types = (
        near.filter(F.col("depth") < hops).select("start", F.col("node").alias("src"))
        .join(last, "src")
        .groupBy("start", F.col("dst").alias("node"))
        .agg(F.array_sort(F.collect_set("rel_type")).alias("relationship_types"))
    )
    return near.filter("depth > 0").join(types, ["start", "node"]).select(
        "start", "node", F.col("depth").alias("min_distance"), "relationship_types")


def critical_nodes(
    nodes: DataFrame, edges: DataFrame, threshold: int = 5,
    types: tuple[str, ...] = ("battery", "alternator", "ecu"), flag: str | None = None,
) -> DataFrame:
    """Nodes with many dependants within 3 steps, of a critical type, or flagged."""
    feeds = edges.filter(F.col("rel_type").isin("POWERED_BY", "CONTROLS"))
    reach = bounded_closure(feeds, depth=3)
    counts = reach.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("dependency_count"))
    explicit = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    return (
        nodes.join(counts, "id", "left")
        .withColumn("dependency_count", F.coalesce("dependency_count", F.lit(0).cast("bigint")))
        .withColumn(
            "criticality_reason",
            F.when(explicit, "explicitly_critical")
            .when(F.col("dependency_count") > threshold, "high_dependency")
            .when(F.col("type").isin(*types), "critical_type"))
        .filter(F.col("criticality_reason").isNotNull())
        .select("id", "vehicle_signature", "type", "dependency_count", "criticality_reason")
    )


def long_paths(edges: DataFrame, sources: DataFrame, min_len: int = 4, k: int = 10,
               max_depth: int = 6) -> DataFrame:
    """The ``k`` longest of the paths that have more than ``min_len`` and at most ``max_depth``
    edges, with their nodes; of equally long ones those whose nodes come first.

    Paths are only listed at the longest lengths that are needed to fill ``k``.  A backward pass
    gives each node the lengths that are still possible, so that no dead end is followed.  At each step only the
    first beginnings of paths are followed: their paths come before those of all others.  Where fewer than ``k``
    paths come of them, the search is repeated with more beginnings, up to all of them.
    """
    steps = cut(edges.select("src", "dst", "rel_type").distinct().withColumn("edge_id", F.monotonically_increasing_id()))
    from_sources = cut(sources.select(F.col("start")).distinct())
    # names that hold the separator do not sort as their beginnings do
    names = steps.select("src").unionByName(steps.select(F.col("dst").alias("src")))
    ordered = names.filter(F.contains("src", F.lit(">"))).isEmpty()
    alive = {1: cut(steps.select("src").distinct())}  # nodes from which a walk of so many edges exists
    for n in range(2, max_depth + 1):
        alive[n] = cut(steps.join(alive[n - 1].select(F.col("src").alias("dst")), "dst", "left_semi").select("src").distinct())
    out, missing = None, k
    for length in range(max_depth, min_len, -1):
        width = 8 * k if ordered else None
        while True:
            found, whole = _first_trails(steps, from_sources, alive, length, width)
            count = found.limit(missing).count()
            if whole or count >= missing:
                break
            width *= 16
        found = found.select(
            F.col("start").alias("source_id"), F.col("src").alias("load_id"),
            F.lit(length).alias("path_length"), "path_nodes")
        out = found if out is None else out.unionByName(found)
        missing -= count
        if missing <= 0:
            break
    order = [F.col("path_length").desc(), F.array_join("path_nodes", ">")]
    return out.orderBy(*order).limit(k)


def _first_trails(steps: DataFrame, sources: DataFrame, alive: dict[int, DataFrame], length: int, width: int | None) -> tuple[DataFrame, bool]:
    """Paths of ``length`` edges from the first ``width`` beginnings at each step (and their equals), and whether these were all."""
    whole = True
    level = sources.join(alive[length].withColumnRenamed("src", "start"), "start", "left_semi").select(
        "start", F.col("start").alias("src"), F.array("start").alias("path_nodes"),
        F.array().cast("array<bigint>").alias("used"))
    for step in range(1, length + 1):
        if width is not None:
            level = cut(level.withColumn("_name", F.concat(F.array_join("path_nodes", ">"), F.lit(">"))))
            last = level.select("_name").orderBy("_name").limit(width + 1).agg(F.count(F.lit(1)), F.max("_name"))
            count, bound = last.first()
            if count > width:
                whole = False
                level = level.filter(F.col("_name") <= bound)
        level = level.join(steps, "src").filter(~F.array_contains("used", F.col("edge_id")))
        if step < length:
            level = level.join(alive[length - step].withColumnRenamed("src", "dst"), "dst", "left_semi")
        level = cut(level.select(
            "start", F.col("dst").alias("src"),
            F.array_append("path_nodes", F.col("dst")).alias("path_nodes"),
            F.array_append("used", F.col("edge_id")).alias("used")))
    return level, whole


def weighted_paths(edges: DataFrame, sources: DataFrame, weight: str, max_rounds: int = 200) -> DataFrame:
    """Least total weight from each source to each reachable node along ``src -> dst``.

    Relaxation rounds only extend the rows that improved in the round before.
    """
    steps = cut(edges.groupBy("src", "dst").agg(F.min(weight).alias("w")))
    best = cut(sources.select("start").distinct().select(
        "start", F.col("start").alias("node"), F.lit(0.0).alias("distance")))
    changed = best
    for _ in range(max_rounds):
        offers = (
            changed.select("start", F.col("node").alias("src"), "distance").join(steps, "src")
            .groupBy("start", F.col("dst").alias("node"))
            .agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
        )
        merged = cut(best.join(offers, ["start", "node"], "full").select(
            "start", "node",
            F.least("distance", "offer").alias("distance"),
            (F.col("distance").isNull() | (F.col("offer") < F.col("distance"))).alias("better")))
        best = merged.select("start", "node", "distance")
        changed = merged.filter(F.coalesce("better", F.lit(False))).select("start", "node", "distance")
        if changed.isEmpty():
            return best
    raise RuntimeError("weights did not settle; is there a negative cycle?")


def expand_tree(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Each node reachable from a root once, with the level where it is met first."""
    return bfs(edges, roots, max_depth).select(
        F.col("start").alias("root"), "node", F.col("depth").alias("level"))


def power_context(powered_by: DataFrame, ids: DataFrame, up: int = 5, down: int = 2) -> DataFrame:
    """Sources above (load -> source) and loads below each component, with distance."""
    starts = ids.select(F.col("id").alias("start"))
    above = bfs(powered_by, starts, up).filter("depth > 0").select(
        F.col("start").alias("id"), F.lit("upstream").alias("direction"), "node", "depth")
    below = bfs(reversed_edges(powered_by), starts, down).filter("depth > 0").select(
        F.col("start").alias("id"), F.lit("downstream").alias("direction"), "node", "depth")
    return above.unionByName(below)


def degrees(edges: DataFrame) -> DataFrame:
    """Outgoing, incoming and total edges per node; a self-loop counts once in each direction."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"),
        F.count(F.lit(1)).alias("degree"))


def _load_trails(edges: DataFrame, components: DataFrame, depth: int, weight: Column | None = None) -> DataFrame:
    """``start, vehicle_signature, length, paths, weight_sum``: the paths from each source to all loads together.

    They are walked from the loads back, so that all loads share one row per node and none is kept per pair of ends.
    """
    is_source = F.col("type").isin("battery", "alternator")
    sources = components.filter(is_source).select(F.col("id").alias("node"), "vehicle_signature")
    loads = components.filter(~is_source).select("id").distinct().select(F.col("id").alias("start"), F.lit(None).cast("string").alias("vehicle_signature"))
    counts = trail_counts(reversed_edges(edges), loads, depth, weight, by_source=False)
    return counts.drop("start", "vehicle_signature").join(sources, "node").withColumnRenamed("node", "start")


def path_efficiency(edges: DataFrame, components: DataFrame, depth: int = 5) -> DataFrame:
    """Per source: average path resistance, average length and number of paths to loads."""
    ways = edges.filter(F.col("rel_type").isin("POWERED_BY", "CONNECTS_TO"))
    return _load_trails(ways, components, depth, resistance(ways)).groupBy("vehicle_signature", F.col("start").alias("source_id")).agg(
        (F.sum("weight_sum") / F.sum("paths")).alias("avg_resistance"),
        (F.sum(F.col("length") * F.col("paths")) / F.sum("paths")).alias("avg_path_length"),
        F.sum("paths").alias("path_count"))


def path_histogram(edges: DataFrame, components: DataFrame, depth: int = 5) -> DataFrame:
    """Number of source-to-load paths by length for each tenant."""
    ways = edges.filter(F.col("rel_type").isin("POWERED_BY", "CONNECTS_TO"))
    return _load_trails(ways, components, depth).groupBy(
        "vehicle_signature", F.col("length").alias("path_length")).agg(F.sum("paths").alias("path_count"))


def control_chains(controls: DataFrame, delay: str | None = None) -> DataFrame:
    """Maximal control chains: from a controller nobody controls to a node that controls nothing.

    ``response_time`` sums the delay column (1.0 per step where there is none).  Chains have any
    length; no node occurs twice in one, so the rounds end.
    """
    cost = F.coalesce(F.col(delay), F.lit(0.0)) if delay else F.lit(1.0)
    steps = cut(controls.groupBy("src", "dst").agg(F.min(cost).alias("w")))
    heads = steps.select("src").distinct().join(
        steps.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
    level = heads.select(F.col("src").alias("initiator"), F.col("src").alias("node"),
                         F.array("src").alias("sequence"), F.lit(0.0).alias("response_time"))
    ends = steps.select(F.col("src").alias("node")).distinct()
    out = None
    for step in itertools.count(1):
        level = cut(
            level.join(steps.withColumnRenamed("src", "node"), "node")
            .filter(~F.array_contains("sequence", F.col("dst")))
            .select("initiator", F.col("dst").alias("node"),
                    F.array_append("sequence", F.col("dst")).alias("sequence"),
                    (F.col("response_time") + F.col("w")).alias("response_time")))
        if level.isEmpty():
            break
        found = level.join(ends, "node", "left_anti").select(
            "initiator", F.col("node").alias("final"), "sequence", "response_time", F.lit(step).alias("complexity"))
        out = found if out is None else out.unionByName(found)
        level = level.join(ends, "node", "left_semi")
    return out if out is not None else level.select(
        "initiator", F.col("node").alias("final"), "sequence", "response_time", F.lit(0).alias("complexity"))


def hierarchy_depth(edges: DataFrame) -> DataFrame:
    """Per root (a node nothing points from): deepest level and number of nodes below it.

    Edges point from child to parent.
    """
    down = reversed_edges(edges)
    roots = edges.select(F.col("dst").alias("start")).distinct().join(
        edges.select(F.col("src").alias("start")).distinct(), "start", "left_anti")
    levels = bfs(down, roots, None)
    return levels.groupBy(F.col("start").alias("root")).agg(
        F.max("depth").alias("depth"), (F.count(F.lit(1)) - 1).alias("descendants"))


def unpowered(nodes: DataFrame, powered_by: DataFrame,
              exempt: tuple[str, ...] = ("battery", "alternator", "power_supply", "ground")) -> DataFrame:
    """Components without a power source that are not sources or grounds themselves."""
    fed = powered_by.select(F.col("src").alias("id")).distinct()
    return nodes.filter(~F.col("type").isin(*exempt)).join(fed, "id", "left_anti")


def orphaned_connectors(nodes: DataFrame, connects_to: DataFrame) -> DataFrame:
    ends = connects_to.select(F.col("src").alias("id")).unionByName(
        connects_to.select(F.col("dst").alias("id"))).distinct()
    return nodes.filter(F.col("type") == "connector").join(ends, "id", "left_anti")
