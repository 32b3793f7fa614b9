"""Ranking, reading and experiment evaluation.

``runs``: ``query_id, doc_id, rank, score``; ``qrels``: ``query_id, doc_id`` (relevant pairs).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions import text as tx
from wirelake.operators.filters import all_of
from wirelake.scale import number_rows
from wirelake.session import cut


def judged(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    rel = qrels.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1))
    return runs.join(rel, ["query_id", "doc_id"], "left").fillna(0, subset=["rel"])


def _relevant(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("query_id").agg(F.count_distinct("doc_id").alias("relevant"))


def precision_recall(runs: DataFrame, qrels: DataFrame, ks: list[int], strict_k: bool = False) -> DataFrame:
    """P@k over what was returned (or over k with ``strict_k``), R@k over all relevant, hit rate."""
    inside = [(k, F.col("rank") <= k) for k in ks]
    agg = [F.max("rel").alias("hit_rate")]
    for k, c in inside:
        agg += [F.sum(F.when(c, F.col("rel")).otherwise(0)).alias(f"_h{k}"), F.count(F.when(c, 1)).alias(f"_n{k}")]
    base = judged(runs, qrels).groupBy("query_id").agg(*agg).join(_relevant(qrels), "query_id", "left").fillna(0, subset=["relevant"])
    cols = [F.col("hit_rate").cast("double").alias("hit_rate")]
    for k, _ in inside:
        below = F.lit(k) if strict_k else F.nullif(F.col(f"_n{k}"), F.lit(0))
        cols += [F.coalesce(F.col(f"_h{k}") / below, F.lit(0.0)).alias(f"precision_{k}"),
                 F.coalesce(F.col(f"_h{k}") / F.nullif("relevant", F.lit(0)), F.lit(0.0)).alias(f"recall_{k}")]
    return base.select("query_id", *cols)


def ndcg(runs: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """DCG over the best possible DCG of all relevant documents."""
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    base = judged(runs, qrels).groupBy("query_id").agg(*[F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"_d{k}") for k in ks])
    base = base.join(_relevant(qrels), "query_id", "left").fillna(0, subset=["relevant"])

    def ideal(k: int) -> Column:
        steps = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i <= F.col("relevant"))
        return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))

    return base.select("query_id", *[F.coalesce(F.col(f"_d{k}") / F.nullif(ideal(k), F.lit(0.0)), F.lit(0.0)).alias(f"ndcg_{k}") for k in ks])


def average_precision(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Sum of the precision at each relevant rank over all relevant documents; runs are top-k lists."""
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at = judged(runs, qrels).withColumn("_p", F.sum("rel").over(w) / F.col("rank") * F.col("rel"))
    return at.groupBy("query_id").agg(F.sum("_p").alias("_s")).join(_relevant(qrels), "query_id", "left").select(
        "query_id", F.coalesce(F.col("_s") / F.col("relevant"), F.lit(0.0)).alias("average_precision"))


def reciprocal_rank(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    first = judged(runs, qrels).groupBy("query_id").agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("_r"))
    return first.select("query_id", F.coalesce(1.0 / F.col("_r"), F.lit(0.0)).alias("reciprocal_rank"))


def entity_accuracy(hits: DataFrame, expected: DataFrame, n: int = 10) -> DataFrame:
    """Share of the expected entities that the first ``n`` hits mention.

    ``hits``: ``query_id, rank, entity`` (one row per mention); ``expected``: ``query_id, entity``.
    """
    want = expected.select("query_id", "entity").distinct()
    found = hits.filter(F.col("rank") <= n).select("query_id", "entity").distinct().withColumn("_f", F.lit(1))
    return want.join(found, ["query_id", "entity"], "left").groupBy("query_id").agg((F.count("_f") / F.count(F.lit(1))).alias("accuracy"))


def aggregate_metrics(results: DataFrame) -> DataFrame:
    """Mean, min and max per metric; p95 and p99 by position for latency metrics.

    ``results``: ``metric, value``.  The percentile row is found by rank on a per-metric count.
    """
    base = results.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    late = number_rows(results.filter(F.col("metric").contains("latency")), "metric", [F.col("value")], "_rn")
    at = late.join(base.select("metric", "n"), "metric")
    points = at.groupBy("metric").agg(*[F.max(F.when(F.col("_rn") == F.floor(F.lit(p) * F.col("n")) + 1, F.col("value"))).alias(name) for p, name in ((0.95, "p95"), (0.99, "p99"))])
    return base.join(points, "metric", "left")


def compare_baseline(base: DataFrame, current: DataFrame, band: float = 0.05) -> DataFrame:
    """Latest result per benchmark and metric on both sides, with the relative change.

    Sides: ``benchmark, run_ts, metric, value``.
    """

    def latest(df: DataFrame, name: str) -> DataFrame:
        newest = df.groupBy("benchmark").agg(F.max("run_ts").alias("run_ts"))
        return df.join(newest, ["benchmark", "run_ts"], "left_semi").groupBy("benchmark", "metric").agg(F.max("value").alias(name))

    both = latest(base, "baseline").join(latest(current, "current"), ["benchmark", "metric"])
    b, c = F.col("baseline"), F.col("current")
    rel = F.when(b != 0, (c - b) / b).when(c > 0, F.lit(float("inf"))).otherwise(0.0)
    i = F.col("improvement")
    return both.withColumn("improvement", rel).withColumns({"absolute_change": c - b, "band": F.when(i > band, "better").when(i < -band, "worse").otherwise("same")})


def overall_scores(metrics: DataFrame) -> DataFrame:
    """Mean P, R, NDCG and accuracies over all ``*mean`` metrics, and F1; ``metrics``: ``metric, value``."""

    def mean(part: str) -> Column:
        return F.avg(F.when(F.col("metric").contains(part) & F.col("metric").contains("mean"), F.col("value")))

    out = metrics.agg(*[mean(p).alias(f"overall_{n}") for p, n in (("precision", "precision"), ("recall", "recall"), ("ndcg", "ndcg"),
                                                                 ("component_accuracy", "component_accuracy"), ("net_accuracy", "net_accuracy"))])
    p, r = F.col("overall_precision"), F.col("overall_recall")
    return out.withColumn("overall_f1", F.when(p + r > 0, 2 * p * r / (p + r)))


def compare_strategies(runs: DataFrame) -> DataFrame:
    """``runs``: ``strategy, query_id, score, latency`` (latency repeated per hit of a query)."""
    per = runs.groupBy("strategy", "query_id").agg(F.max("latency").alias("latency"), F.avg("score").alias("avg"), F.max("score").alias("top"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("strategy").agg(F.avg("latency").alias("latency"), F.avg("avg").alias("avg_relevance_score"), F.avg("top").alias("top_score"), F.avg("n").alias("num_results"))


def signal_quality(signals: DataFrame) -> DataFrame:
    return signals.groupBy("signal_type").agg(F.avg("confidence").alias("avg_confidence"), F.count_distinct("page").alias("coverage"), F.count(F.lit(1)).alias("total"))


def _normal(c: str) -> Column:
    return F.replace(F.trim(F.lower(c)), F.lit(" "), F.lit(""))


def fuzzy_matched(a: DataFrame, b: DataFrame, key: list[str], tolerance: float = 0.2) -> DataFrame:
    """Distinct texts of ``a`` (``key, text``) that match some text of ``b`` with the same key.

    Equal texts match by join.  Of the rest only texts that share two neighbouring characters
    with a similar length can be within the tolerance, so those pairs alone are measured.
    """
    left = a.select(*key, _normal("text").alias("n")).distinct()
    right = b.select(*key, _normal("text").alias("m")).distinct()
    same = left.join(right.withColumnRenamed("m", "n"), [*key, "n"], "left_semi")
    rest = left.join(same, [*key, "n"], "left_anti").filter(F.length("n") >= 4)

    def grams(c: str) -> Column:
        return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(F.col(c), i, F.lit(2)))))

    near = rest.withColumn("g", grams("n")).join(right.filter(F.length("m") >= 4).withColumn("g", grams("m")), [*key, "g"]).filter(
        F.abs(F.length("n") - F.length("m")) <= F.greatest(F.length("n"), F.length("m")) * tolerance).select(*key, "n", "m").distinct()
    hit = near.filter(F.levenshtein("n", "m") / F.greatest(F.length("n"), F.length("m")) <= tolerance).select(*key, "n").distinct()
    return same.unionByName(hit)


#: Distinct texts of a sample that are compared one by one; above that only texts with common pairs of characters are.
SMALL_SAMPLE = 512


def ocr_matches(grouped: DataFrame, key: list[str], tolerance: float = 0.2, small: int = SMALL_SAMPLE) -> DataFrame:
    """Fuzzy precision, recall and F1 of each row ``key, seen, known, detected_count, expected_count``.

    ``seen`` and ``known`` hold all normalised texts; the counts also count null texts, which match nothing.
    """
    few = F.greatest(F.size(F.array_distinct("seen")), F.size(F.array_distinct("known"))) <= small

    def unmatched(own: str, other: str) -> Column:
        def near(x: Column, y: Column) -> Column:
            longest = F.greatest(F.length(x), F.length(y))
            return (F.abs(F.length(x) - F.length(y)) <= longest * tolerance) & (F.levenshtein(x, y) / longest <= tolerance)

        return F.filter(F.array_except(own, other), lambda x: ~F.exists(other, lambda y: near(x, y)))

    def hits(own: str, other: str) -> Column:
        # the list is bound by a transform, as it would else be made anew for each text
        counted = F.transform(F.array(unmatched(own, other)), lambda bad: F.size(F.filter(own, lambda x: ~F.array_contains(bad, x))))
        return F.element_at(counted, 1)

    rows = grouped.filter(few).select(*key, "detected_count", "expected_count", hits("seen", "known").alias("_p"), hits("known", "seen").alias("_r"))
    large = grouped.filter(~few)
    if not large.isEmpty():
        seen, known = (large.select(*key, F.explode(c).alias("text")) for c in ("seen", "known"))
        parts = []
        for own, other, name in ((seen, known, "_p"), (known, seen, "_r")):
            good = fuzzy_matched(own, other, key, tolerance).withColumnRenamed("n", "text")
            parts.append(own.join(good, [*key, "text"], "left_semi").groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias(name)))
        found = large.select(*key, "detected_count", "expected_count").join(parts[0], key, "left").join(parts[1], key, "left").fillna(0, ["_p", "_r"])
        rows = rows.unionByName(found)
    pc, rc = F.col("precision"), F.col("recall")
    out = rows.withColumns({"precision": F.col("_p") / F.col("detected_count"), "recall": F.col("_r") / F.col("expected_count")}).drop("_p", "_r")
    return out.withColumn("f1", F.when(pc + rc > 0, 2 * pc * rc / (pc + rc)).otherwise(0.0))


def ocr_evaluation(spans: DataFrame, truth: DataFrame, sample: list[str], dataset: str, engine: str = "engine") -> DataFrame:
    """Error rates and fuzzy scores averaged by engine, by data set and over all.

    ``spans``: ``engine, sample.., pos, text``; ``truth``: ``sample.., dataset, pos, text``.  Both are shuffled once, by sample.
    """
    in_order = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ").alias(name)
    texts = lambda name: F.collect_list(_normal("text")).alias(name)
    rows = F.count(F.lit(1))
    read = spans.select(engine, *sample, "pos", "text").repartition(*sample).groupBy(*sample, engine).agg(in_order("read"), texts("seen"), rows.alias("detected_count"))
    real = truth.select(*sample, dataset, "pos", "text").repartition(*sample).groupBy(*sample, dataset).agg(in_order("real"), texts("_known"), rows.alias("_n"))
    # a sample of several data sets is matched against all its texts
    whole = Window.partitionBy(*sample)
    real = real.withColumns({"known": F.flatten(F.collect_list("_known").over(whole)), "expected_count": F.sum("_n").over(whole)}).drop("_known", "_n")
    rated = cut(read.join(real, sample).withColumns({"cer": tx.cer(F.col("real"), F.col("read")), "wer": tx.wer(F.col("real"), F.col("read"))}).drop("real", "read"))
    every = ocr_matches(rated, [engine, *sample, dataset, "cer", "wer"])
    return every.groupingSets([[F.col(engine)], [F.col(dataset)], []], F.col(engine), F.col(dataset)).agg(
        F.count(F.lit(1)).alias("samples"), *[F.avg(c).alias(f"avg_{c}") for c in ("cer", "wer", "precision", "recall", "f1")])


def experiment_table(runs: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """One row per run with a column per metric or parameter; ``values``: ``run_id, name, value``."""
    wide = values.groupBy("run_id").pivot("name", names).agg(F.max("value"))
    minutes = (F.unix_timestamp("end_time") - F.unix_timestamp("start_time")) / 60
    return runs.withColumn("duration_minutes", minutes).join(wide, "run_id", "left")


def expand_grid(spec: DataFrame) -> DataFrame:
    """All combinations of ``array`` columns per experiment, one row each."""
    out = spec
    for name, kind in spec.dtypes:
        if kind.startswith("array"):
            out = out.withColumn(name, F.explode(name))
    return out


def sweep_analysis(runs: DataFrame, params: list[str], metric: str = "accuracy") -> tuple[DataFrame, DataFrame]:
    """Best finished run per experiment, and the mean metric per parameter value."""
    done = runs.filter(all_of([F.col("status") == "FINISHED", F.col(metric).isNotNull()]))
    best = done.groupBy("experiment").agg(F.max_by(F.struct("run_id", *params, metric), F.struct(F.col(metric), F.negative("run_id"))).alias("b")).select("experiment", "b.*")
    parts = [done.groupBy("experiment", F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value")).agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("runs")) for p in params]
    return best, reduce(lambda a, b: a.unionByName(b), parts)
