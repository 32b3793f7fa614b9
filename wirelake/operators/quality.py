"""Record rules: each rule is a condition with a message and a level, all checked in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.functions import text as tx
from wirelake.operators import graph
from wirelake.operators.aggregates import count_if, n, unconnected
from wirelake.operators.filters import has_position, literal_map
from wirelake.scale import number_rows

TENANT = "vehicle_signature"


@dataclass(frozen=True)
class Rule:
    level: str  # error, warning or info
    broken: Column
    message: Column | str


def check_fields(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add arrays ``errors``, ``warnings``, ``infos`` and the flag ``is_valid``."""

    def texts(level: str) -> Column:
        made = [F.when(F.coalesce(r.broken, F.lit(False)), r.message if isinstance(r.message, Column) else F.lit(r.message)) for r in rules if r.level == level]
        return F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")

    return df.withColumns({"errors": texts("error"), "warnings": texts("warning"), "infos": texts("info")}).withColumn("is_valid", F.size("errors") == 0)


#: Known enumerations of the record rules.
COMPONENT_TYPES = ["relay", "fuse", "connector", "sensor", "actuator", "switch", "ecu", "harness", "battery", "alternator", "starter", "ground"]
CIRCUIT_TYPES = ["power", "ground", "lighting", "ignition", "engine", "body", "comfort", "safety", "communication", "auxiliary"]
SIGNAL_TYPES = ["power", "ground", "digital", "analog", "can", "lin", "flexray", "ethernet", "most", "pwm", "data"]


def id_rules(c: str) -> list[Rule]:
    v = F.col(c)
    given = v.isNotNull() & (v != "")
    return [Rule("error", ~given, f"{c} is required"), Rule("error", given & (F.length(v) > 100), f"{c} must be 100 characters or less"),
            Rule("error", given & ~v.rlike(r"^[a-zA-Z0-9_-]+$"), f"{c} contains invalid characters. Use only letters, numbers, hyphens, and underscores")]


def quantity_rules(c: str, unit: str, high: float) -> list[Rule]:
    text = F.col(c).cast("string")
    number = F.regexp_replace(text, f"[{unit.lower()}{unit}]", "").try_cast("double")
    return [Rule("warning", ~text.rlike(rf"^\d+(\.\d+)?[{unit.lower()}{unit}]?$"), F.concat(F.lit(f"{c} has invalid format: "), text)),
            Rule("error", number < 0, f"{c} cannot be negative"), Rule("error", text.isNotNull() & number.isNull(), F.concat(F.lit(f"{c} is not a valid number: "), text)),
            Rule("warning", number > high, F.concat(F.lit(f"{c} seems unusually high: "), number.cast("string"), F.lit(unit)))]


def pattern_rule(c: str, rx: str) -> Rule:
    return Rule("warning", ~F.col(c).rlike(rx), F.concat(F.lit(f"{c} has invalid format: "), F.col(c)))


def enum_rules(c: str, values: list[str], required: bool = False) -> list[Rule]:
    unknown = (F.col(c) != "") & ~F.lower(c).isin(values)
    out = [Rule("error", F.col(c).isNull(), f"{c} is required")] if required else []
    return out + [Rule("warning", unknown, F.concat(F.lit(f"Unknown {c}: "), F.col(c))), Rule("info", unknown, f"Known types: {', '.join(sorted(values))}")]


WIRE_GAUGE_RX, COLOUR_RX = r"(?i)^\d+(\.\d+)?(mm²?|awg)?$", r"^[a-zA-Z]+([/-][a-zA-Z]+)*$"


def rules_for(entity: str, columns: list[str]) -> list[Rule]:
    """Rules of an entity for the columns it has."""

    def has(c: str) -> bool:
        return c in columns

    rules: list[Rule] = []
    if entity in {"component", "circuit"}:
        rules += id_rules("id")
        if has("name"):
            rules.append(Rule("warning", F.coalesce(F.col("name"), F.lit("")) == "", "name is missing"))
    if entity == "component":
        rules += enum_rules("type", COMPONENT_TYPES, required=True)
        rules += quantity_rules("voltage_rating", "V", 1000) if has("voltage_rating") else []
        rules += quantity_rules("current_rating", "A", 500) if has("current_rating") else []
    if entity == "circuit":
        rules += enum_rules("circuit_type", CIRCUIT_TYPES)
        rules += quantity_rules("voltage", "V", 1000) if has("voltage") else []
        rules += quantity_rules("max_current", "A", 500) if has("max_current") else []
    if entity == "connection":
        rules += id_rules("from_id") + id_rules("to_id")
        rules.append(Rule("warning", F.col("from_id") == F.col("to_id"), "Component connects to itself"))
        rules += enum_rules("signal_type", SIGNAL_TYPES) if has("signal_type") else []
    rules += [pattern_rule("wire_gauge", WIRE_GAUGE_RX)] if has("wire_gauge") else []
    rules += [pattern_rule("wire_color", COLOUR_RX)] if has("wire_color") else []
    return rules


def validate(df: DataFrame, entity: str) -> DataFrame:
    return check_fields(df, rules_for(entity, df.columns))


def duplicate_keys(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every row after the first of its key, with its number within the key."""
    twice = df.groupBy(*keys).agg(n().alias("_n")).filter("_n > 1").drop("_n")
    return number_rows(df.join(twice, keys, "left_semi"), keys, order, "occurrence").filter("occurrence > 1")


#: Allowed ratings by component type and by circuit type; wire capacity by gauge.
VOLTAGE_RANGE = {"battery": (6, 48), "alternator": (12, 48), "ecu": (3.3, 24), "sensor": (3.3, 24), "relay": (5, 48), "light": (12, 24), "motor": (12, 400)}
CURRENT_RANGE = {"fuse": (0.1, 200), "relay": (0.01, 100), "ecu": (0.1, 20), "sensor": (0.001, 5), "starter": (50, 500), "light": (0.5, 20), "motor": (1, 200)}
CIRCUIT_VOLTAGE = {"power": (6, 48), "signal": (3.3, 24), "can_bus": (3.3, 5), "lin_bus": (9, 18), "ignition": (12, 48), "lighting": (12, 24)}
WIRE_CAPACITY = {"18AWG": 10, "16AWG": 13, "14AWG": 15, "12AWG": 20, "10AWG": 30, "0.5mm²": 6, "0.75mm²": 8, "1.0mm²": 10, "1.5mm²": 15, "2.5mm²": 20,
                 "4.0mm²": 27, "6.0mm²": 35, "10.0mm²": 50}
REQUIRED_SPECS = {"ecu": ["processor", "memory", "can_channels"], "sensor": ["signal_type"], "relay": ["coil_voltage"]}


def _outside(value: str, kind: str, table: dict) -> Column:
    low = F.try_element_at(literal_map({k: float(v[0]) for k, v in table.items()}), F.col(kind))
    high = F.try_element_at(literal_map({k: float(v[1]) for k, v in table.items()}), F.col(kind))
    return (F.col(value) < low) | (F.col(value) > high)


def component_rules(df: DataFrame) -> DataFrame:
    """Ratings by type, all-or-none coordinates, V*I close to P, required specifications."""
    given = sum((F.when(F.col(a).isNotNull(), 1).otherwise(0) for a in "yz"), F.when(F.col("x").isNotNull(), 1).otherwise(0))
    rules = [Rule("error", _outside("voltage_rating", "type", VOLTAGE_RANGE), "voltage rating out of range for type"),
             Rule("error", _outside("current_rating", "type", CURRENT_RANGE), "current rating out of range for type"),
             Rule("error", (given > 0) & (given < 3), "all three coordinates are needed")]
    if "power_rating" in df.columns:
        p = F.col("power_rating")
        rules.append(Rule("error", (p != 0) & (F.abs(F.col("voltage_rating") * F.col("current_rating") - p) > p * 0.1), "power inconsistent with voltage and current"))
    if "specifications" in df.columns:
        for kind, names in REQUIRED_SPECS.items():
            missing = F.size(F.array_except(F.array(*[F.lit(v) for v in names]), F.map_keys("specifications"))) > 0
            rules.append(Rule("error", (F.col("type") == kind) & missing, f"{kind} needs {', '.join(names)}"))
    return check_fields(df, rules)


def circuit_rules(df: DataFrame) -> DataFrame:
    """Voltage by type, currents, fuse size, wire capacity, temperatures, load factor, safety."""
    has = set(df.columns)
    top = F.col("max_current")
    rules = [Rule("error", _outside("voltage", "circuit_type", CIRCUIT_VOLTAGE), "voltage out of range for circuit type")]
    if "nominal_current" in has:
        rules.append(Rule("error", F.col("nominal_current") > top, "nominal current exceeds maximum current"))
        if "load_factor" in has:
            rules.append(Rule("error", F.col("nominal_current") * F.col("load_factor") > top * 1.1, "load factor exceeds maximum current"))
    if "protection_rating" in has:
        fuse, text = F.col("protection") == "fuse", F.col("protection_rating")
        rules += [Rule("error", fuse & ~text.rlike(r"^\d+(\.\d+)?A$"), "fuse rating must look like 10A"),
                  Rule("error", fuse & (F.regexp_extract(text, r"^(\d+(?:\.\d+)?)A$", 1).try_cast("double") < top * 0.8), "fuse rating below 80% of maximum current")]
    if "wire_gauge" in has:
        g = F.col("wire_gauge")
        rules += [Rule("error", ~g.rlike(r"^(\d+(\.\d+)?(AWG|mm²)|#\d+)$"), "wire gauge must look like 12AWG, 2.5mm² or #12"),
                  Rule("error", top > F.try_element_at(literal_map(WIRE_CAPACITY), g), "wire too thin for maximum current")]
    if {"operating_temperature_min", "operating_temperature_max"} <= has:
        rules.append(Rule("error", F.col("operating_temperature_min") >= F.col("operating_temperature_max"), "temperature range is empty"))
    if "safety_critical" in has:
        safe = F.coalesce(F.col("redundancy_available"), F.lit(False)) if "redundancy_available" in has else F.lit(False)
        mode = (F.coalesce(F.col("fail_safe_mode"), F.lit("")) != "") if "fail_safe_mode" in has else F.lit(False)
        rules.append(Rule("error", F.col("safety_critical") & ~safe & ~mode, "safety-critical circuit without redundancy or fail-safe mode"))
    return check_fields(df, rules)


def batch_rules(components: DataFrame, circuits: DataFrame) -> DataFrame:
    """Tenant-level needs: a source, a ground, power and ground circuits, at most three voltages."""
    a = components.groupBy(TENANT).agg(count_if(F.col("type").isin("battery", "alternator")).alias("sources"), count_if(F.col("type") == "ground").alias("grounds"))
    b = circuits.groupBy(TENANT).agg(count_if(F.col("circuit_type") == "power").alias("power"), count_if(F.col("circuit_type") == "ground").alias("earth"),
                                     F.count_distinct(F.when(F.col("circuit_type") == "power", F.col("voltage"))).alias("levels"))
    both = a.join(b, TENANT, "full").fillna(0)
    return check_fields(both, [
        Rule("error", F.col("sources") == 0, "no power source"), Rule("error", F.col("grounds") == 0, "no ground component"), Rule("error", F.col("power") == 0, "no power circuit"),
        Rule("error", F.col("earth") == 0, "no ground circuit"), Rule("error", F.col("levels") > 3, "more than 3 voltage levels")])


def validate_vehicles(vehicles: DataFrame, components: DataFrame, circuits: DataFrame, edges: DataFrame) -> DataFrame:
    """Issues, warnings and recommendations per tenant."""
    comp = components.groupBy(TENANT).agg(
        n().alias("total"), count_if(~has_position()).alias("no_position"), count_if(F.col("zone").isNull()).alias("no_zone"),
        count_if((F.col("voltage_rating") > 1000) | (F.col("current_rating") > 1000)).alias("unrealistic"))
    bare = circuits.filter(F.col("protection").isNull() | (F.col("protection") == "none")).groupBy(TENANT).agg(n().alias("unprotected"))
    lone = unconnected(components, edges).groupBy(TENANT).agg(n().alias("orphans"))
    base = vehicles.select(F.col("signature").alias(TENANT)).join(comp, TENANT, "left").join(bare, TENANT, "left").join(lone, TENANT, "left").fillna(0)

    def share(c: str) -> Column:
        return F.format_string("%.1f", F.bround(F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100).otherwise(0.0), 1))

    def text(c: str) -> Column:
        return F.col(c).cast("string")

    checked = check_fields(base, [
        Rule("warning", F.col("orphans") > 0, F.concat(F.lit("Found "), text("orphans"), F.lit(" orphaned components with no connections"))),
        Rule("warning", F.col("no_position") > 0, F.concat(text("no_position"), F.lit(" components ("), share("no_position"), F.lit("%) missing position data"))),
        Rule("warning", F.col("no_zone") > 0, F.concat(text("no_zone"), F.lit(" components ("), share("no_zone"), F.lit("%) missing zone assignment"))),
        Rule("warning", F.col("unrealistic") > 0, F.concat(text("unrealistic"), F.lit(" components have unrealistic electrical ratings"))),
        Rule("error", F.col("unprotected") > 0, F.concat(text("unprotected"), F.lit(" circuits lack proper protection devices"))),
        Rule("info", F.col("orphans") > 0, "Review isolated components and establish proper connections"),
        Rule("info", F.col("no_position") > F.col("total") * 0.5, "Complete spatial mapping for better 3D visualization"),
        Rule("info", F.col("unrealistic") > 0, "Review electrical specifications for accuracy")])
    return checked.select(TENANT, "is_valid", F.col("errors").alias("issues"), "warnings", F.col("infos").alias("recommendations"))


def dry_run(checked: dict[str, DataFrame]) -> DataFrame:
    """Totals of checked tables by kind."""
    out = None
    for kind, df in checked.items():
        part = df.agg(n().alias("total"), count_if(F.col("is_valid")).alias("valid"), count_if(~F.col("is_valid")).alias("invalid"),
                      count_if(F.size("warnings") > 0).alias("with_warnings")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def check_against_knowledge(components: DataFrame, dim: DataFrame) -> DataFrame:
    """Compare with what is typical for the type.

    ``components``: ``id, type, pins array<string>, value, system``; ``dim``: ``type, pin_count, roles, values, systems``.
    """
    d = components.join(dim.withColumn("_known", F.lit(True)), "type", "left")
    roles = F.array_distinct(F.transform("pins", tx.infer_role))
    lacking = F.array_except(F.array_intersect(F.array(F.lit("power"), F.lit("ground")), "roles"), roles)
    low, high = F.floor(F.col("pin_count") * 0.8), F.floor(F.col("pin_count") * 1.2)
    some = F.size("pins") > 0
    return check_fields(d, [
        Rule("warning", F.col("_known").isNull(), "Unknown component type"),
        Rule("warning", some & (F.col("pin_count") > 0) & ~F.size("pins").between(low, high), "Pin count mismatch"),
        Rule("warning", some & (F.size(lacking) > 0), "Missing critical pin roles"),
        Rule("warning", (F.size("values") > 0) & (F.col("value") != "") & ~tx.looks_like_value(F.col("value"), F.col("values")), "Unusual component value"),
        Rule("warning", (F.size("systems") > 0) & ~F.array_contains("systems", F.col("system")), "Unusual system assignment")]).select("id", "type", F.col("warnings").alias("issues"))


def missing_connections(components: DataFrame, nets: DataFrame) -> DataFrame:
    """Likely gaps: relays without a fuse of their system, control units without power, ground or CAN,
    and tenants with power nets but no ground net.

    ``components``: ``id, tenant, type, system, pins array<string>``; ``nets``: ``tenant, name``.
    """
    fuses = components.filter(F.col("type") == "fuse").select(TENANT, F.coalesce("system", F.lit("")).alias("_s")).distinct()
    relays = components.filter(F.col("type") == "relay").withColumn("_s", F.coalesce("system", F.lit(""))).join(fuses, [TENANT, "_s"], "left_anti")
    out = relays.select(TENANT, "id", F.lit("may need fuse protection").alias("suggestion"))
    roles = F.transform(F.coalesce("pins", F.array().cast("array<string>")), tx.infer_role)
    bus = ~F.array_contains("_r", "can_h") & ~F.array_contains("_r", "can_l") & F.col("system").isin("engine_management", "transmission")
    ecu = components.filter(F.col("type") == "ecu").withColumn("_r", roles).select(TENANT, "id", F.explode(F.array_compact(F.array(
        F.when(~F.array_contains("_r", "power"), "missing power connections"), F.when(~F.array_contains("_r", "ground"), "missing ground connections"),
        F.when(bus, "may need CAN bus connections")))).alias("suggestion"))
    kind = tx.infer_net(F.col("name"))
    ground = nets.groupBy(TENANT).agg(count_if(kind["is_power"]).alias("p"), count_if(kind["is_ground"]).alias("g")).filter("p > 0 AND g = 0").select(
        TENANT, F.lit(None).cast("string").alias("id"), F.lit("Power nets found but no ground nets - check ground distribution").alias("suggestion"))
    return out.unionByName(ecu).unionByName(ground)


#: Electrical role behind the names used in type descriptions.
ROLE_OF = {"power": "power", "ground": "ground", "coil_positive": "power", "coil_negative": "signal", "common": "power", "normally_open": "power",
           "signal": "signal", "terminal1": "signal", "terminal2": "signal", "positive": "power", "negative": "ground"}


def infer_properties(components: DataFrame, dim: DataFrame) -> DataFrame:
    """Fill the system and the roles of pins by position from the type description.

    ``components``: ``id, type, system, pins array<struct<name, role>>``; ``dim``: ``type, roles, systems``.
    """
    d = components.join(dim.select("type", "roles", "systems"), "type", "left")
    table = literal_map(ROLE_OF)
    pins = F.transform("pins", lambda p, i: F.struct(p["name"].alias("name"), F.coalesce(p["role"], F.try_element_at(table, F.get("roles", i))).alias("role")))
    return d.select("id", "type", F.coalesce("system", F.get("systems", F.lit(0))).alias("system"), pins.alias("pins"))


def check_relationships(edges: DataFrame, types: list[str]) -> DataFrame:
    rules = [Rule("error", F.coalesce(F.col(c), F.lit("")) == "", f"{c} is required") for c in ("src", "dst", "rel_type")]
    return check_fields(edges, [*rules, Rule("error", (F.col("rel_type") != "") & ~F.col("rel_type").isin(types), F.concat(F.lit("unknown type "), F.col("rel_type")))])


def unpowered_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Unpowered components and connectors without wires, tagged."""
    a = graph.unpowered(nodes, edges.filter(F.col("rel_type") == "POWERED_BY")).select("id", F.lit("unpowered").alias("issue"))
    b = graph.orphaned_connectors(nodes, edges.filter(F.col("rel_type") == "CONNECTS_TO")).select("id", F.lit("orphaned_connector").alias("issue"))
    return a.unionByName(b)
