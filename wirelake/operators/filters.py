"""Row filters and projections over components, circuits, edges, segments and texts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def has_position(prefix: str = "") -> Column:
    return (
        F.col(f"{prefix}x").isNotNull()
        & F.col(f"{prefix}y").isNotNull()
        & F.col(f"{prefix}z").isNotNull()
    )


@dataclass(frozen=True)
class ComponentCriteria:
    types: list[str] = field(default_factory=list)
    zone: str | None = None
    manufacturer: str | None = None
    has_position: bool | None = None
    voltage: tuple[float | None, float | None] = (None, None)
    current: tuple[float | None, float | None] = (None, None)
    tenants: list[str] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class CircuitCriteria:
    types: list[str] = field(default_factory=list)
    voltage: tuple[float | None, float | None] = (None, None)
    current: tuple[float | None, float | None] = (None, None)
    safety_critical: bool | None = None
    redundancy: bool | None = None
    protection: str | None = None
    tenants: list[str] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


def _range(column: str, bounds) -> list[Column]:
    low, high = bounds
    out = []
    if low is not None:
        out.append(F.col(column) >= low)
    if high is not None:
        out.append(F.col(column) <= high)
    return out


def component_predicate(c: ComponentCriteria) -> Column:
    parts: list[Column] = []
    if c.tenants:
        parts.append(F.col("vehicle_signature").isin(c.tenants))
    if c.types:
        parts.append(F.col("type").isin(c.types))
    if c.zone is not None:
        parts.append(F.col("zone") == c.zone)
    if c.manufacturer is not None:
        parts.append(F.col("manufacturer") == c.manufacturer)
    if c.has_position is not None:
        parts.append(has_position() if c.has_position else ~has_position())
    parts += _range("voltage_rating", c.voltage) + _range("current_rating", c.current)
    return all_of(parts)


def circuit_predicate(c: CircuitCriteria) -> Column:
    parts: list[Column] = []
    if c.tenants:
        parts.append(F.col("vehicle_signature").isin(c.tenants))
    if c.types:
        parts.append(F.col("circuit_type").isin(c.types))
    parts += _range("voltage", c.voltage) + _range("max_current", c.current)
    if c.safety_critical is not None:
        parts.append(F.col("safety_critical") == c.safety_critical)
    if c.redundancy is not None:
        parts.append(F.col("redundancy_available") == c.redundancy)
    if c.protection is not None:
        parts.append(F.col("protection") == c.protection)
    return all_of(parts)


def _page(df: DataFrame, order: list[Column], limit: int | None, offset: int) -> DataFrame:
    if limit is None and not offset:
        return df
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None else df


def filter_components(df: DataFrame, c: ComponentCriteria) -> DataFrame:
    """All criteria at once; a global sort happens only when a page is asked for."""
    order = [F.col("type"), F.col("name"), F.col("id")]
    return _page(df.filter(component_predicate(c)), order, c.limit, c.offset)


def filter_circuits(df: DataFrame, c: CircuitCriteria) -> DataFrame:
    order = [F.col("circuit_type"), F.col("name"), F.col("id")]
    return _page(df.filter(circuit_predicate(c)), order, c.limit, c.offset)


def count_components(df: DataFrame, c: ComponentCriteria) -> DataFrame:
    kept = df.filter(component_predicate(c))
    return kept.groupBy("vehicle_signature").agg(F.count(F.lit(1)).alias("n"))


def count_circuits(df: DataFrame, c: CircuitCriteria) -> DataFrame:
    kept = df.filter(circuit_predicate(c))
    return kept.groupBy("vehicle_signature").agg(F.count(F.lit(1)).alias("n"))


def search_name(df: DataFrame, pattern: str, column: str = "name") -> DataFrame:
    """Case-insensitive regular expression anywhere in the name."""
    return df.filter(F.col(column).rlike(f"(?i){pattern}"))


def filter_rating(df, lo_v=None, hi_v=None, lo_i=None, hi_i=None) -> DataFrame:
    parts = _range("voltage_rating", (lo_v, hi_v)) + _range("current_rating", (lo_i, hi_i))
    return df.filter(all_of(parts))


def power() -> Column:
    return F.col("voltage_rating") * F.col("current_rating")


def high_power(df: DataFrame, threshold: float) -> DataFrame:
    return df.withColumn("power_consumption", power()).filter(
        F.col("power_consumption") > threshold
    )


def without_position(df: DataFrame) -> DataFrame:
    return df.filter(~has_position())


def with_spatial(df: DataFrame, located_in: DataFrame, zones: DataFrame) -> DataFrame:
    """Positioned components with the zone they are placed in, if any."""
    where = located_in.select(F.col("src").alias("id"), F.col("dst").alias("zone_id"))
    named = zones.select(F.col("id").alias("zone_id"), F.col("name").alias("zone_name"))
    placed = df.filter(has_position()).join(where, "id", "left").join(named, "zone_id", "left")
    return placed.select(
        "id", "vehicle_signature", "type", "name", "x", "y", "z", "zone_id", "zone_name"
    )


def unprotected(circuits: DataFrame) -> DataFrame:
    return circuits.filter(F.col("protection").isNull() | (F.col("protection") == "none"))


def safety_critical(circuits: DataFrame) -> DataFrame:
    return circuits.filter(F.col("safety_critical"))


@dataclass(frozen=True)
class Filter:
    """One condition on a payload column; conditions are joined by AND."""

    field: str
    operator: str
    value: object


def condition(f: Filter) -> Column:
    col = F.col(f.field)
    simple = {
        "eq": lambda: col == f.value,
        "ne": lambda: col != f.value,
        "in": lambda: col.isin(list(f.value)),
        "gt": lambda: col > f.value,
        "lt": lambda: col < f.value,
        "gte": lambda: col >= f.value,
        "lte": lambda: col <= f.value,
        "contains": lambda: col.contains(f.value),
    }
    if f.operator not in simple:
        raise ValueError(f"unknown filter operator: {f.operator}")
    return simple[f.operator]()


def apply_filters(df: DataFrame, filters: list[Filter]) -> DataFrame:
    return df.filter(all_of(condition(f) for f in filters))


def filter_vectors(df, must: list[Filter] = (), must_not: list[Filter] = ()) -> DataFrame:
    """Keep rows that meet every ``must`` and no ``must_not`` (a null never matches)."""
    parts = [condition(f) for f in must]
    parts += [~F.coalesce(condition(f), F.lit(False)) for f in must_not]
    return df.filter(all_of(parts))


def select_subgraph(
    components: DataFrame,
    edges: DataFrame,
    types: list[str] | None = None,
    zone: str | None = None,
    members: DataFrame | None = None,
    properties: Mapping[str, object] | None = None,
) -> DataFrame:
    """Edges leaving the selected components; a selected component without edges stays once."""
    parts = []
    if types:
        parts.append(F.col("type").isin(types))
    if zone is not None:
        parts.append(F.col("zone") == zone)
    parts += [F.col(k) == v for k, v in (properties or {}).items()]
    chosen = components.filter(all_of(parts))
    if members is not None:
        chosen = chosen.join(members.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("target_id"), "rel_type")
    return chosen.select("id", "vehicle_signature", "type").join(out, "id", "left")


def normalise_component(df: DataFrame) -> DataFrame:
    """Fall back from one property name to the next; missing columns count as null."""

    def first(*names: str, default=None, kind="string") -> Column:
        options = [F.col(n).cast(kind) for n in names if n in df.columns]
        options.append(F.lit(default).cast(kind))
        return F.coalesce(*options)

    return df.select(
        first("id").alias("id"),
        first("type", "node_type", default="component").alias("type"),
        first("name", "label").alias("name"),
        first("anchor_x", "x", default=0.0, kind="double").alias("x"),
        first("anchor_y", "y", default=0.0, kind="double").alias("y"),
        first("anchor_z", "z", default=0.0, kind="double").alias("z"),
        first("bbox_w", default=0.05, kind="double").alias("width"),
        first("bbox_h", default=0.05, kind="double").alias("height"),
        first("bbox_d", default=0.025, kind="double").alias("depth"),
        first("current", "current_rating", "current_draw", kind="double").alias("current"),
        first("voltage", "voltage_rating", kind="double").alias("voltage"),
        first("zone", "anchor_zone").alias("zone"),
        first("part_number", "partNumber").alias("part_number"),
        first("vehicle_signature").alias("vehicle_signature"),
    )


#: Relationship type -> connection class; anything else counts as electrical.
CONNECTION_CLASS = {
    "CONNECTS_TO": "electrical",
    "POWERS": "electrical",
    "POWERED_BY": "electrical",
    "MOUNTED_TO": "mechanical",
    "ATTACHED_TO": "mechanical",
    "COMMUNICATES_WITH": "data",
    "SENDS_DATA": "data",
}


def literal_map(values: Mapping[str, object]) -> Column:
    pairs: list[Column] = []
    for key, value in values.items():
        pairs += [F.lit(key), F.lit(value)]
    return F.create_map(*pairs)


def normalise_edges(edges: DataFrame) -> DataFrame:
    kind = F.try_element_at(literal_map(CONNECTION_CLASS), F.upper("rel_type"))
    return edges.select(
        "vehicle_signature",
        F.col("src").alias("from_component_id"),
        F.col("dst").alias("to_component_id"),
        F.coalesce(kind, F.lit("electrical")).alias("type"),
    )


def filter_segments(df: DataFrame, min_length: float = 20.0) -> DataFrame:
    """Wire-like segments: along an axis or a diagonal within 0.2 rad, or longer than 50."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    angle = F.pmod(F.abs(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))), F.pi() / 2)
    aligned = (
        (angle < 0.2) | (F.abs(angle - F.pi() / 4) < 0.2) | (F.abs(angle - F.pi() / 2) < 0.2)
    )
    return df.filter((length >= min_length) & (aligned | (length > 50)))


def drop_short(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose trimmed text has at least ``n`` characters."""
    return df.filter(F.length(F.trim(F.col(column))) >= n)


def sanitised(text: Column) -> Column:
    """Drop NUL and CR, turn LF into a blank, drop script blocks and tags, trim."""
    flat = F.translate(F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" ")), "\x00", "")
    no_script = F.regexp_replace(flat, r"(?is)<script[^>]*>.*?</script>", "")
    return F.trim(F.regexp_replace(no_script, r"<[^>]+>", ""))


def _sanitise_typed(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return sanitised(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _sanitise_typed(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _sanitise_typed(v, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [_sanitise_typed(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def sanitise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Clean text columns, going into arrays, maps and structs by the column's type."""
    return df.withColumns(
        {c: _sanitise_typed(F.col(c), df.schema[c].dataType) for c in columns}
    )


def circuit_subgraph(part_of: DataFrame, edges: DataFrame) -> DataFrame:
    """For every circuit, the edges that have both ends among its members."""
    source = part_of.select(F.col("src"), F.col("dst").alias("circuit_id"))
    target = part_of.select(F.col("src").alias("dst"), F.col("dst").alias("circuit_id"))
    return (
        edges.select("src", "dst", "rel_type")
        .join(source, "src")
        .join(target, ["dst", "circuit_id"], "left_semi")
        .select("circuit_id", "src", "dst", "rel_type")
    )


def tenant_views(spark: SparkSession, tables: Mapping[str, DataFrame], tenants: list[str]) -> list[str]:
    """Temp views that only show the given tenants, for free-form ``spark.sql`` reading."""
    names = []
    for name, df in tables.items():
        key = "signature" if "signature" in df.columns else "vehicle_signature"
        df.filter(F.col(key).isin(tenants)).createOrReplaceTempView(name)
        names.append(name)
    return names
