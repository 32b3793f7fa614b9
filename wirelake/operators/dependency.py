"""System dependencies: strongly connected groups, their graph, depths and critical paths.

Vertices are ``(tenant, id)`` pairs, so ids that repeat over tenants stay apart.  Each round is a join and an aggregate, is
written as a table, and moves all tenants and all groups on at once; only a count comes back to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.session import cut

TENANT = "vehicle_signature"


def vertex(tenant: str, name: str) -> Column:
    return F.struct(F.col(tenant).alias("tenant"), F.col(name).alias("id"))


def _trim(links: DataFrame) -> DataFrame:
    """Links whose start has a link into it and whose end has one out of it: only these can lie on a cycle."""
    into, out = links.select(F.col("v").alias("u")).distinct(), links.select(F.col("u").alias("v")).distinct()
    return links.join(into, "u", "left_semi").join(out, "v", "left_semi").select("u", "v")


def _spread(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Carry the greatest label along the links until no label changes; ``labels``: ``u, label`` of all vertices."""
    changed = labels
    while not changed.isEmpty():
        offers = links.join(changed, "u").groupBy(F.col("v").alias("u")).agg(F.max("label").alias("offer"))
        moved = labels.join(offers, "u", "left").withColumn("moved", F.coalesce(F.col("offer") > F.col("label"), F.lit(False)))
        moved = cut(moved.select("u", F.greatest("label", "offer").alias("label"), "moved"))
        labels, changed = moved.select("u", "label"), moved.filter("moved").select("u", "label")
    return labels


def _backward(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``u, label``: vertices from which the vertex that is their own label can be reached within that label."""
    inner = links.join(labels, "u").join(labels.select(F.col("u").alias("v"), F.col("label").alias("other")), "v").filter("label = other").select("u", "v", "label")
    inner = cut(inner)
    reached = level = cut(labels.filter("u = label"))
    while not level.isEmpty():
        found = inner.join(level.select(F.col("u").alias("v"), "label"), ["v", "label"]).select("u", "label").distinct()
        level = cut(found.join(reached, "u", "left_anti"))
        reached = reached.unionByName(level)
    return reached


def strong_groups(edges: DataFrame, src: str = "src", dst: str = "dst", tenant: str = TENANT) -> DataFrame:
    """``tenant, id, group``: vertices that reach each other have one ``group``, the smallest of their ids."""
    links = cut(edges.dropna(subset=[src, dst]).select(vertex(tenant, src).alias("u"), vertex(tenant, dst).alias("v")).distinct())
    vertices = cut(links.select("u").unionByName(links.select(F.col("v").alias("u"))).distinct())
    groups = cyclic_groups(links)
    if groups is None:
        named = vertices.withColumn("name", F.col("u.id"))
    else:
        names = groups.groupBy("label").agg(F.min("u.id").alias("name"))
        named = vertices.join(groups.join(names, "label").select("u", "name"), "u", "left").withColumn("name", F.coalesce("name", "u.id"))
    return cut(named.select(F.col("u.tenant").alias(tenant), F.col("u.id").alias("id"), F.col("name").alias("group")))


def cyclic_groups(links: DataFrame) -> DataFrame | None:
    """``u, label`` of the vertices of ``links`` (``u, v``) that lie on a cycle: those that reach each other have one ``label``, the greatest of them.

    What cannot lie on a cycle is cut off first and is a group of its own, which is left out.  The rest is labelled with the
    greatest vertex that reaches it; the vertices that reach their label back are its group.  This is repeated on what is
    left.  All groups that are found in a round advance together.
    """
    left, groups = links.filter("u <> v"), None
    count = -1
    while True:
        # cutting goes on while it removes links; a chain of n vertices takes n / 2 rounds
        while True:
            left = cut(_trim(left))
            before, count = count, left.count()
            if count in (0, before):
                break
        if not count:
            return groups
        nodes = left.select("u").distinct().select("u", F.col("u").alias("label"))
        labels = cut(_spread(left, cut(nodes)))
        found = cut(_backward(left, labels))
        groups = found if groups is None else groups.unionByName(found)
        gone = found.select("u")
        left = left.join(gone, "u", "left_anti").join(gone.select(F.col("u").alias("v")), "v", "left_anti")
        # links between groups with other labels are on no cycle
        other = labels.select(F.col("u").alias("v"), F.col("label").alias("other"))
        left = cut(left.join(labels, "u").join(other, "v").filter("label = other").select("u", "v"))
        count = -1


def group_links(edges: DataFrame, groups: DataFrame, src: str = "src", dst: str = "dst", tenant: str = TENANT) -> DataFrame:
    """``tenant, src, dst``: the links between different groups; they have no cycle."""
    one = groups.select(tenant, F.col("id").alias(src), F.col("group").alias("_a"))
    two = groups.select(tenant, F.col("id").alias(dst), F.col("group").alias("_b"))
    joined = edges.select(tenant, src, dst).distinct().join(one, [tenant, src]).join(two, [tenant, dst])
    return cut(joined.filter("_a <> _b").select(tenant, F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct())


def depths(groups: DataFrame, links: DataFrame, tenant: str | None = TENANT) -> DataFrame:
    """``tenant, group, depth, after``: links on the longest way to a group, and the group before it on that way.

    A group gets its depth in the round after the last of the groups before it, so each link is used once.
    Of several longest ways the one over the smallest group is taken.  A link counts as its ``step``, or 1 where there is no such
    column.  Without ``tenant`` the groups of all tenants are told apart by ``group`` alone.
    """
    keys = [] if tenant is None else [tenant]
    links = links if "step" in links.columns else links.withColumn("step", F.lit(1))
    waiting = links.groupBy(*keys, F.col("dst").alias("group")).agg(F.count(F.lit(1)).alias("open"))
    every = groups.select(*keys, "group").distinct().join(waiting, [*keys, "group"], "left")
    level = cut(every.filter("open IS NULL").select(*keys, "group", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast(dict(links.dtypes)["src"]).alias("after")))
    waiting = cut(every.filter("open IS NOT NULL").select(*keys, "group", "open"))
    done = level
    while not level.isEmpty():
        used = links.join(level.select(*keys, F.col("group").alias("src"), "depth"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("group")).agg(F.count(F.lit(1)).alias("used"))
        state = cut(waiting.join(used, [*keys, "group"], "left").select(*keys, "group", (F.col("open") - F.coalesce("used", F.lit(0))).alias("open")))
        ready = state.filter("open = 0").select(*keys, F.col("group").alias("dst"))
        ways = links.join(ready, [*keys, "dst"]).join(done.select(*keys, F.col("group").alias("src"), "depth"), [*keys, "src"])
        best = ways.groupBy(*keys, F.col("dst").alias("group")).agg(F.min(F.struct((-F.col("depth") - F.col("step")).alias("d"), "src")).alias("b"))
        level = cut(best.select(*keys, "group", (-F.col("b.d")).alias("depth"), F.col("b.src").alias("after")))
        waiting = state.filter("open > 0")
        done = done.unionByName(level)
    return cut(done)


def critical_paths(levels: DataFrame, tenant: str = TENANT) -> DataFrame:
    """``tenant, step, group``: the longest chain of each tenant, from its first group (step 0) to its last.

    Of several the one that ends in the smallest group is taken.
    """
    ends = levels.groupBy(tenant).agg(F.min(F.struct((-F.col("depth")).alias("d"), "group")).alias("b"))
    level = cut(levels.join(ends.select(tenant, F.col("b.group").alias("group")), [tenant, "group"]).select(tenant, F.col("depth").alias("step"), "group", "after"))
    out = level
    while not level.isEmpty():
        back = level.filter("after IS NOT NULL").select(tenant, F.col("after").alias("group"))
        level = cut(levels.join(back, [tenant, "group"]).select(tenant, F.col("depth").alias("step"), "group", "after"))
        out = out.unionByName(level)
    return out.select(tenant, "step", "group")


def system_dependencies(edges: DataFrame, critical: DataFrame, tenant: str = TENANT) -> DataFrame:
    """A row per group of ``edges`` (``src`` depends on ``dst``): ``tenant, group, members, critical, parents, children, depth, path_step``.

    ``parents`` are groups that this one depends on, ``children`` those that depend on it.  ``critical`` (``tenant, id``)
    names the critical vertices, which are counted.  ``path_step`` is the place on the tenant's critical path, or null.
    """
    down = edges.select(tenant, F.col("dst").alias("src"), F.col("src").alias("dst"))
    groups = strong_groups(down, tenant=tenant)
    links = group_links(down, groups, tenant=tenant)
    levels = depths(groups, links, tenant)
    flagged = groups.join(critical.select(tenant, "id", F.lit(1).alias("flag")).distinct(), [tenant, "id"], "left")
    sizes = flagged.groupBy(tenant, "group").agg(F.count(F.lit(1)).alias("members"), F.count("flag").alias("critical"))
    out = sizes.join(levels.select(tenant, "group", "depth"), [tenant, "group"])
    for name, here in (("parents", "dst"), ("children", "src")):
        number = links.groupBy(tenant, F.col(here).alias("group")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(number, [tenant, "group"], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    path = critical_paths(levels, tenant).select(tenant, "group", F.col("step").alias("path_step"))
    return out.join(path, [tenant, "group"], "left").select(tenant, "group", "members", "critical", "parents", "children", "depth", "path_step")


def circuit_dependencies(part_of: DataFrame, powered_by: DataFrame, tenant: str = TENANT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Which circuits depend on which, without a row per pair: circuit ``a`` depends on ``b`` where a part that is a member of
    ``b`` feeds a critical member of ``a``.

    Circuits are numbered from 0, feeding parts from -1 downwards.  Returns the circuits (``tenant, circuit_id, number``), and the
    links ``part, a`` and ``part, b``; their join by ``part`` would be the pairs.
    """
    def numbered(df: DataFrame, number: Column) -> DataFrame:
        return cut(df.distinct().withColumn("number", number))

    circuits = numbered(part_of.select(tenant, F.col("dst").alias("circuit_id")), F.monotonically_increasing_id())
    parts = numbered(powered_by.dropna(subset=["src", "dst"]).select(tenant, F.col("dst").alias("src")), -1 - F.monotonically_increasing_id())
    of = part_of.join(circuits.withColumnsRenamed({"circuit_id": "dst", "number": "circuit"}), [tenant, "dst"]).select(tenant, "src", "circuit", "is_critical")
    of = cut(of)
    lines = powered_by.join(parts.withColumnsRenamed({"src": "dst", "number": "part"}), [tenant, "dst"]).select(tenant, "src", "part").distinct()
    fed = of.filter("is_critical").join(lines, [tenant, "src"]).select("part", F.col("circuit").alias("a")).distinct()
    feeds = of.join(parts.withColumnRenamed("number", "part"), [tenant, "src"]).select("part", F.col("circuit").alias("b")).distinct()
    return circuits, cut(fed), cut(feeds)


def _different(one: DataFrame, two: DataFrame, here: str, there: str, name: str) -> DataFrame:
    """``number, name``: how many other circuits ``there`` a circuit ``here`` is linked with over its parts.

    The circuits of a part travel as one list; the pairs are made where the rows of a circuit are, and are not shuffled.
    """
    lists = two.groupBy("part").agg(F.array_sort(F.collect_set(there)).alias("_others"))
    near = one.join(lists, "part").select(here, "_others").repartition(here)
    pairs = near.select(here, F.explode("_others").alias(there)).filter(F.col(here) != F.col(there)).distinct()
    return pairs.groupBy(F.col(here).alias("number")).agg(F.count(F.lit(1)).alias(name))


def circuit_hierarchy(part_of: DataFrame, powered_by: DataFrame, tenant: str = TENANT) -> DataFrame:
    """Per circuit: members, critical and other ones, circuits it depends on and that depend on it, and its depth.

    Circuits that depend on each other in a circle share one depth.  Circles and depths are found on the links over feeding
    parts, which are as many as memberships; a way over a part counts once, where it leaves a circuit.
    """
    part_of = cut(part_of.select(tenant, "src", "dst", "is_critical"))
    circuits, fed, feeds = circuit_dependencies(part_of, powered_by, tenant)
    links = cut(feeds.select(F.col("b").alias("u"), F.col("part").alias("v")).unionByName(fed.select(F.col("part").alias("u"), F.col("a").alias("v"))))
    vertices = links.select("u").unionByName(links.select(F.col("v").alias("u"))).distinct()
    found = cyclic_groups(links)
    if found is not None:
        vertices = vertices.join(found, "u", "left")
    groups = cut(vertices.select("u", (F.col("u") if found is None else F.coalesce("label", "u")).alias("group")))
    between = links.join(groups.withColumnRenamed("group", "src"), "u").join(groups.select(F.col("u").alias("v"), F.col("group").alias("dst")), "v")
    # the greatest vertex of a circle is a circuit, so only a part that is on none has a group below 0
    between = cut(between.filter("src <> dst").select("src", "dst").distinct().withColumn("step", (F.col("src") >= 0).cast("int")))
    levels = depths(groups, between, None)
    depth = groups.filter("u >= 0").join(levels, "group").select(F.col("u").alias("number"), "depth")
    out = part_of.groupBy(tenant, F.col("dst").alias("circuit_id")).agg(
        F.count(F.lit(1)).alias("component_count"), F.count(F.when(F.col("is_critical"), 1)).alias("critical_count"), F.count(F.when(~F.col("is_critical"), 1)).alias("other_count"))
    known = circuits.join(_different(fed, feeds, "a", "b", "parent_circuits"), "number", "left").join(_different(feeds, fed, "b", "a", "child_circuits"), "number", "left").join(depth, "number", "left")
    known = known.select(tenant, "circuit_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(name) for c, name in (("parent_circuits",) * 2, ("child_circuits",) * 2, ("depth", "dependency_depth"))])
    none = {c: 0 for c in ("parent_circuits", "child_circuits", "dependency_depth")}
    return out.join(known, [tenant, "circuit_id"], "left").fillna(none)
