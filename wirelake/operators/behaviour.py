"""How users work: sessions, habits, errors, profiles and search use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.operators.aggregates import count_if, messages, n
from wirelake.operators.density import density_clusters
from wirelake.operators.ranking import error_streaks
from wirelake.scale import lag_rows, running_sum
from wirelake.session import cut

#: All kinds of interaction.
INTERACTION_TYPES = ["component_selection", "component_placement", "wire_routing", "layout_approval", "layout_rejection", "manual_adjustment",
                     "zoom_pan", "view_change", "property_edit", "export_diagram", "save_project", "undo_redo"]
COMPLETIONS = ("layout_approval", "export_diagram", "save_project")


def kind_is(*kinds: str) -> Column:
    return F.col("interaction_type").isin(*kinds)


def with_sessions(interactions: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Add ``session``: a user's interactions with no pause above the gap share a number."""
    order = [F.col("ts"), F.col("event_id")]
    before = lag_rows(interactions, "user_id", order, {"_before": "ts"})
    pause = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))
    fresh = F.when(F.col("_before").isNull() | (pause > gap_seconds * 1_000_000), 1).otherwise(0)
    return running_sum(before, "user_id", order, fresh, "session").drop("_before")


def session_analysis(interactions: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Per session: times, counts, efficiency, completion, error rate, indicators, chances to learn."""
    s = with_sessions(interactions, gap_seconds)
    by_kind = s.groupBy("user_id", "session", "interaction_type").agg(n().alias("c"), count_if(~F.col("success")).alias("bad"))
    weak = by_kind.filter(F.col("bad") > 2).groupBy("user_id", "session").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("improve_"), "interaction_type", F.lit("_skills")))).alias("weak"))
    breakdown = by_kind.groupBy("user_id", "session").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "interaction_type", "c"))), ",").alias("breakdown"))
    base = s.groupBy("user_id", "session").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), n().alias("total_interactions"), count_if(F.col("success")).alias("ok"),
        count_if(kind_is("undo_redo")).alias("undo"), count_if(kind_is(*COMPLETIONS)).alias("done"), count_if(kind_is("layout_approval")).alias("approved"),
        count_if(kind_is("save_project")).alias("saved"), count_if(kind_is("manual_adjustment")).alias("manual"))
    total = F.col("total_interactions")
    out = base.join(breakdown, ["user_id", "session"]).join(weak, ["user_id", "session"], "left")
    return out.select(
        "user_id", "session", "start_time", "end_time", "total_interactions", "breakdown",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ok") / total - F.least(F.col("undo") / total, F.lit(0.5)))).alias("efficiency_score"),
        F.when(F.col("done") > 0, 1.0).when(total > 10, 0.5).otherwise(0.0).alias("task_completion_rate"),
        (1 - F.col("ok") / total).alias("error_rate"),
        messages((F.col("approved") > 0, "layout_approved"), (F.col("saved") > 0, "project_saved"), (F.col("undo") / total < 0.1, "smooth_workflow")).alias("satisfaction_indicators"),
        F.concat(F.coalesce("weak", F.array().cast("array<string>")), messages((F.col("manual") > total * 0.3, "learn_automated_optimization"))).alias("learning_opportunities"))


def temporal_patterns(interactions: DataFrame) -> DataFrame:
    """Interactions per user by hour and by weekday (Monday = 0) with a flag at the busiest one."""
    cells = interactions.groupBy("user_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday")).agg(n().alias("n"))
    out = None
    for kind in ("hour", "weekday"):
        part = cells.groupBy("user_id", F.lit(kind).alias("by"), F.col(kind).alias("value")).agg(F.sum("n").alias("n"))
        out = part if out is None else out.unionByName(part)
    peak = out.groupBy("user_id", "by").agg(F.max_by("value", F.struct("n", F.negative("value"))).alias("peak"))
    return out.join(peak, ["user_id", "by"]).withColumn("is_peak", F.col("value") == F.col("peak")).drop("peak")


def error_patterns(interactions: DataFrame, count_open: bool = True) -> DataFrame:
    base = interactions.groupBy("user_id").agg(
        n().alias("total"), count_if(~F.col("success")).alias("errors"), F.count_distinct(F.when(~F.col("success"), F.col("interaction_type"))).alias("error_types"),
        (count_if(kind_is("undo_redo")) > n() * 0.15).alias("high_undo_rate"))
    return base.withColumn("error_rate", F.col("errors") / F.col("total")).join(error_streaks(interactions, count_open), "user_id")


def efficiency_patterns(interactions: DataFrame) -> DataFrame:
    avg = F.avg("duration_ms")
    base = interactions.groupBy("user_id", "interaction_type").agg(n().alias("n"), avg.alias("avg_duration_ms"), (count_if(F.col("success")) / n()).alias("success_rate"))
    return base.withColumn("efficiency", F.col("success_rate") / (1 + F.col("avg_duration_ms") / 1000)).withColumn("is_slow", F.col("efficiency") < 0.1)


def preference_patterns(interactions: DataFrame) -> DataFrame:
    moves, manual, placed = count_if(kind_is("view_change")), count_if(kind_is("manual_adjustment")), count_if(kind_is("component_placement", "wire_routing"))
    return interactions.groupBy("user_id").agg(
        F.when(moves > 0, moves > n() * 0.1).alias("frequent_view_changes"), F.when(placed > 0, manual / placed > 0.3).alias("prefers_manual_control"))


def usability_issues(interactions: DataFrame, now: Column, hours: int = 24, rate: float = 0.1, gap_seconds: int = 1800) -> DataFrame:
    """System-wide issues over the hours before ``now`` as rows ``issue, feature, value, severity``."""
    recent = interactions.filter((F.col("ts") > now - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col("ts") <= now))
    total = recent.agg(n().alias("total"), count_if(kind_is("undo_redo")).alias("undo"), F.count_distinct("interaction_type").alias("used"))
    failed = recent.groupBy("interaction_type").agg(count_if(~F.col("success")).alias("bad"), n().alias("c"))
    shares = failed.withColumn("_g", F.lit(1)).join(F.broadcast(total.withColumn("_g", F.lit(1))), "_g").withColumn("value", F.col("bad") / F.col("total"))
    errors = shares.filter(F.col("value") > rate).select(F.lit("high_error_rate").alias("issue"), F.col("interaction_type").alias("feature"), "value",
                                                      F.when(F.col("value") > 0.3, "high").otherwise("medium").alias("severity"))
    undo = total.filter(F.col("undo") / F.greatest("total", F.lit(1)) > 0.15).select(
        F.lit("high_undo_rate").alias("issue"), F.lit(None).cast("string").alias("feature"), (F.col("undo") / F.col("total")).alias("value"), F.lit("medium").alias("severity"))
    spans = with_sessions(recent, gap_seconds).groupBy("user_id", "session").agg(
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 60e6).alias("m")).filter(F.col("m") > 1)
    long = spans.agg(F.avg("m").alias("value")).filter(F.col("value") > 30).select(
        F.lit("long_task_completion").alias("issue"), F.lit(None).cast("string").alias("feature"), "value", F.lit("medium").alias("severity"))
    all_kinds = len(INTERACTION_TYPES)
    unused = total.filter((all_kinds - F.col("used")) > all_kinds * 0.3).select(
        F.lit("feature_abandonment").alias("issue"), F.lit(None).cast("string").alias("feature"), (all_kinds - F.col("used")).cast("double").alias("value"), F.lit("low").alias("severity"))
    return errors.unionByName(undo).unionByName(long).unionByName(unused)


def user_profiles(interactions: DataFrame, threshold: int = 100) -> DataFrame:
    """Counts, level, and the kinds of interaction that failed; components used are counted."""
    t = F.col("total")
    return interactions.groupBy("user_id").agg(
        n().alias("total"), F.count_distinct("target_object_id").alias("components_used"), F.max("ts").alias("last_updated"),
        F.array_sort(F.collect_set(F.when(~F.col("success"), F.concat("interaction_type", F.lit("_error"))))).alias("error_patterns")
    ).withColumn("experience_level", F.when(t > threshold * 3, "expert").when(t > threshold, "intermediate").otherwise("novice"))


def feedback_preferences(feedback: DataFrame) -> DataFrame:
    """Preference keys and issue category per feedback issue.

    ``feedback``: ``user_id, feedback_type, issues array<string>``.
    """
    one = feedback.select("user_id", "feedback_type", F.explode("issues").alias("issue"))
    positive, negative = F.col("feedback_type") == "positive", F.col("feedback_type") == "negative"
    key = (F.when(positive & F.col("issue").startswith("good_"), F.regexp_replace("issue", "^good_", "prefer_"))
           .when(negative, F.concat(F.lit("avoid_"), "issue")))
    low = F.lower("issue")
    kind = F.when(negative, F.when(low.rlike("placement|routing|clearance|layout"), "layout").when(low.rlike("slow|lag|freeze|crash"), "performance").otherwise("ui"))
    return one.withColumns({"preference": key, "category": kind}).filter(F.col("preference").isNotNull()).groupBy("user_id", "preference", "category").agg(n().alias("n"))


def user_recommendations(profiles: DataFrame, errors: DataFrame, efficiency: DataFrame) -> DataFrame:
    slow = efficiency.filter((F.col("interaction_type") == "component_selection") & F.col("is_slow")).select("user_id", F.lit(True).alias("slow"))
    f = profiles.join(errors.select("user_id", "high_undo_rate"), "user_id", "left").join(slow, "user_id", "left").fillna(False, subset=["slow", "high_undo_rate"])
    novice = F.col("experience_level") == "novice"
    learner = F.col("experience_level").isin("novice", "intermediate")
    return f.select(
        "user_id", "experience_level",
        messages((novice, "Enable guided tutorials for complex tasks"), (novice, "Show tooltips for advanced features"), (novice, "Highlight recommended actions")).alias("ui_improvements"),
        messages((F.col("high_undo_rate"), "Implement smart undo with preview")).alias("workflow_optimizations"),
        messages((F.col("slow"), "Quick component search and favorites")).alias("feature_suggestions"),
        messages((learner & F.array_contains("error_patterns", "wire_routing_violations"), "Wire routing best practices tutorial"),
                 (learner & F.array_contains("error_patterns", "clearance_violations"), "Electrical clearance requirements guide")).alias("learning_resources"))


#: Features of an interaction: kind, duration, success, hour and day of the week.
FEATURES = ["f0", "f1", "f2", "f3", "f4"]


def interaction_features(interactions: DataFrame) -> DataFrame:
    """``event_id`` and five numbers per interaction, each scaled to zero mean and unit spread over all.

    The kind is a number below 1000 that follows from its name.
    """
    kind = F.conv(F.substring(F.md5("interaction_type"), 1, 4), 16, 10).cast("bigint") % 1000
    raw = [kind, F.col("duration_ms"), F.col("success").cast("int"), F.hour("ts"), F.weekday("ts")]
    base = interactions.select("event_id", *[x.cast("double").alias(name) for name, x in zip(FEATURES, raw, strict=True)])
    stats = base.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES])
    scaled = [F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in FEATURES]
    return base.withColumn("_g", F.lit(1)).join(F.broadcast(stats.withColumn("_g", F.lit(1))), "_g").select("event_id", *scaled)  # one row


def cluster_interactions(interactions: DataFrame, method: str = "density", k: int = 4, eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """Group interactions with alike features: ``kmeans``, or ``density`` with ``kind`` (see ``density_clusters``)."""
    f = cut(interaction_features(interactions))
    if method == "kmeans":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler

        v = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(f)
        return KMeans(k=k, seed=1, featuresCol="v", predictionCol="cluster").fit(v).transform(v).select("event_id", "cluster")
    return density_clusters(f, "event_id", FEATURES, eps, min_points)


def search_analytics(searches: DataFrame, start: Column, end: Column, k: int = 10) -> DataFrame:
    """Figures of a time range as rows ``figure, key, value``: totals, the most frequent, hourly trend.

    ``searches``: ``search_id, ts, query, component, vehicle, results, latency``.
    """
    s = searches.filter((F.col("ts") >= start) & (F.col("ts") < end))
    totals = s.agg(n().cast("double").alias("total_searches"), F.count_distinct("query").cast("double").alias("unique_queries"), F.avg("latency").alias("avg_response_time"),
                   (count_if(F.col("results") > 0) / n()).alias("success_rate"), F.avg("results").alias("avg_results"))
    out = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.lit(None).cast("string").alias("key"), F.col(c).alias("value")) for c in totals.columns])).alias("r")).select("r.*")
    for column in ("query", "component", "vehicle"):
        top = s.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(n().cast("double").alias("value")).orderBy(F.col("value").desc(), "key").limit(k)
        out = out.unionByName(top.select(F.lit(f"popular_{column}").alias("figure"), "key", "value"))
    hours = s.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("key")).agg(n().cast("double").alias("volume"), F.avg("latency").alias("response_time"))
    for column in ("volume", "response_time"):
        out = out.unionByName(hours.select(F.lit(f"trend_{column}").alias("figure"), "key", F.col(column).alias("value")))
    return out


