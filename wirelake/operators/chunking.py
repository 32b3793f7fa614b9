"""Chunks, page tiers, extraction records and training samples."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.functions import text as tx
from wirelake.operators.ranking import group_nearby_spans
from wirelake.scale import best_readings, top_rows


def _windows(words: Column, size: int, step: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.least(i + size, F.size(words)).alias("end"), F.array_join(F.slice(words, i + 1, size), " ").alias("text")))


def chunk_words(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """Overlapping windows of ``size`` words over the whole text; no words, no chunk."""
    base = df.select(key, tx.words_of(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    made = base.select(key, F.posexplode(_windows(F.col("_w"), size, size - overlap)).alias("chunk", "c"))
    return made.select(key, "chunk", "c.start", "c.end", "c.text")


def chunk_document(df: DataFrame, key: str, title: str, text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows of ``size // 4`` words with the title in front, a heading guess and a page estimate."""
    base = df.select(key, F.col(title).alias("_t"), tx.words_of(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    made = base.select(key, "_t", F.posexplode(_windows(F.col("_w"), size // 4, max(size // 4 - overlap // 4, 1))).alias("chunk", "c"))
    return made.select(key, "chunk", "c.start", "c.end", F.concat("_t", F.lit(". "), "c.text").alias("content"),
                       tx.section_title(F.col("c.text")).alias("section_title"), tx.page_estimate(F.col("c.start")).alias("page_number"))


def pack(parts: Column, limit: int) -> Column:
    """Join consecutive parts with a blank while the result has at most ``limit`` characters.

    A part longer than the limit stands alone after what was open before it is closed.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, part: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(part) + 1 <= limit
        return F.when(fits, F.struct(acc["done"].alias("done"), F.when(acc["open"] == "", part).otherwise(F.concat_ws(" ", acc["open"], part)).alias("open"))).otherwise(
            F.struct(F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), part.alias("open")))

    return F.aggregate(parts, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def split_text(text: Column, limit: int = 512) -> Column:
    """Sentence-bounded pieces of at most ``limit`` characters; longer sentences break at words."""
    sentences = F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")
    pieces = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) + 1 > limit, pack(tx.words_of(s), limit)).otherwise(F.array(s))))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(pack(pieces, limit))


def chunk_spans(spans: DataFrame, key: list[str], limit: int = 512, minimum: int = 50) -> DataFrame:
    """Nearby spans of a page -> text -> chunks, with span count, confidence, box and engines."""
    grouped = group_nearby_spans(spans, key)
    ordered = F.array_sort(F.collect_list(F.struct("y1", "x1", "pos", F.trim("text").alias("t"))))
    groups = grouped.groupBy(*key, "grp").agg(
        F.concat_ws(" ", F.filter(F.transform(ordered, lambda s: s["t"]), lambda v: v != "")).alias("text"), F.count(F.lit(1)).alias("span_count"),
        F.avg("confidence").alias("avg_confidence"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.array_sort(F.collect_set("engine")).alias("engines"))
    kept = groups.filter(F.length("text") >= minimum)
    return kept.select(*key, "grp", "span_count", "avg_confidence", "x1", "y1", "x2", "y2", "engines", F.posexplode(split_text(F.col("text"), limit)).alias("chunk", "text")).withColumns(
        {"word_count": F.size(tx.words_of(F.col("text"))), "technical_terms": tx.technical_terms(F.col("text"))})


def layout_chunks(spans: DataFrame, key: list[str], limit: int = 512) -> DataFrame:
    """Spans of a page in reading order, packed up to ``limit`` characters."""
    ordered = F.array_sort(F.collect_list(F.struct("y1", "x1", "pos", F.trim("text").alias("t"))))
    pages = spans.filter(F.trim("text") != "").groupBy(*key).agg(ordered.alias("s"))
    return pages.select(*key, F.posexplode(pack(F.transform("s", lambda v: v["t"]), limit + 1)).alias("chunk", "text"))


def sentence_chunks(df: DataFrame, key: str, text: str, n: int = 10, minimum: int = 30) -> DataFrame:
    """The first ``n`` sentences of more than ``minimum`` characters."""
    parts = F.slice(F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(s)), lambda s: F.length(s) > minimum), 1, n)
    return df.select(key, F.posexplode(parts).alias("chunk", "text"))


def entity_chunks(components: DataFrame, nets: DataFrame) -> DataFrame:
    """Description chunks of components and nets in one table."""
    c = components.select("page", F.lit("component").alias("kind"), F.col("id").alias("name"),
                          tx.describe_component(F.col("id"), F.col("type"), F.col("value"), F.col("pins"), F.col("page"), F.col("confidence")).alias("text"))
    n = nets.select("page", F.lit("net").alias("kind"), "name",
                    tx.describe_net(F.col("name"), F.col("connections"), F.col("first"), F.array("page"), F.col("confidence")).alias("text"))
    both = c.unionByName(n)
    return both.withColumns({"chunk_id": tx.chunk_id(F.col("kind"), F.lit("project"), F.col("page"), F.xxhash64("name")), "word_count": F.size(tx.words_of(F.col("text"))),
                             "technical_terms": tx.technical_terms(F.col("text"))})


def route_tiers(pages: DataFrame) -> dict[str, DataFrame]:
    """Four tables from one page table.

    ``pages``: ``page, page_type, tier, entries, specs, rules, warnings, sections, chunks`` (arrays).
    """
    meta = (F.col("tier") == 1) | (F.col("page_type") == "lookup_table")
    know = (F.col("tier") == 2) | F.col("page_type").isin("specifications", "instructions")
    struct = (F.col("tier") == 3) | (F.col("page_type") == "table_of_contents")
    entries = pages.filter(meta).select("page", "page_type", F.explode("entries").alias("e")).select("page", "page_type", "e.*")
    facts = F.concat(
        F.transform("specs", lambda s: F.struct(F.lit("specification").alias("type"), F.concat_ws(" ", s["parameter"], s["requirement"], s["value"]).alias("content"))),
        F.transform("rules", lambda r: F.struct(F.lit("rule").alias("type"), r.alias("content"))),
        F.transform("warnings", lambda w: F.struct(F.lit("warning").alias("type"), w.alias("content"))))
    knowledge = pages.filter(know).select("page", F.explode(facts).alias("k")).select("page", "k.*")
    structure = pages.filter(struct).select(F.col("page").alias("source_page"), F.explode("sections").alias("s")).select("source_page", "s.*").withColumn("page", F.col("source_page"))
    semantic = pages.select("page", "page_type", F.posexplode("chunks").alias("chunk_index", "text"))
    return {"tier_1_metadata": entries, "tier_2_knowledge": knowledge, "tier_3_structure": structure, "tier_4_semantic": semantic}


#: How many items of each kind later pages get to see.
CONTEXT_CAPS = {"symbol": 20, "abbreviation": 20, "wire_color": 10, "component_code": 20, "instruction": 10, "rule": 10, "convention": 10}


def context_bucket(kind: Column, body: Column) -> Column:
    low = F.lower(body)
    return (F.when(kind.isin("symbol", "instruction", "rule", "convention"), kind)
            .when(low.contains("color") | (kind == "wire_color"), "wire_color")
            .when((kind == "component") | low.contains("component"), "component_code")
            .when((kind == "abbreviation") | low.contains("code"), "abbreviation"))


def running_context(entries: DataFrame, pages: DataFrame, caps: dict[str, int] = CONTEXT_CAPS) -> DataFrame:
    """What each page may read from pages before it: the first items of each kind.

    ``entries``: ``doc, page, idx, kind, body``.  Only the first items of a kind per document can
    ever be seen, so those few are picked first and then matched with the later pages.
    """
    bucketed = entries.withColumn("bucket", context_bucket(F.col("kind"), F.col("body"))).filter(F.col("bucket").isNotNull())
    seen = top_rows(bucketed, ["doc", "bucket"], [F.col("page"), F.col("idx"), F.col("body")], max(caps.values()))
    limit = F.try_element_at(F.create_map(*[c for k, v in caps.items() for c in (F.lit(k), F.lit(v))]), F.col("bucket"))
    first = seen.filter(F.col("rank") <= limit).select("doc", "bucket", F.col("page").alias("_from"), "body")
    return pages.select("doc", "page").join(first, "doc").filter(F.col("_from") < F.col("page")).select("doc", "page", "bucket", "body")


KNOWLEDGE_SCHEMA = """vehicle struct<make:string, model:string, year_start:int, year_end:int>, knowledge array<struct<type:string, component_type:string,
location:struct<zone:string, sub_zone:string, side:string, access:string>, connections:array<struct<source:string, target:string, connection_type:string, wire_color:string, wire_gauge:string>>,
symptom:string, root_cause:string, solution:string, cost_estimate:string, confidence:double>>"""
#: Kinds of knowledge that are accepted.
KNOWLEDGE_TYPES = ["location", "connection", "failure", "specification", "harness_path", "accessibility"]


def parse_knowledge(raw: DataFrame, posts: DataFrame, kinds: list[str] = KNOWLEDGE_TYPES) -> DataFrame:
    """One row per knowledge item of each answer; unknown kinds are dropped, the post's vehicle wins.

    ``raw``: ``post_id, answer``; ``posts``: ``post_id, content, vehicle`` (struct, may be null).
    """
    parsed = raw.select("post_id", F.from_json(tx.repair_json(tx.strip_fence(F.col("answer"))), KNOWLEDGE_SCHEMA).alias("a"))
    items = parsed.select("post_id", F.col("a.vehicle").alias("_v"), F.explode("a.knowledge").alias("k")).join(posts.select("post_id", "content", "vehicle"), "post_id")
    kind = F.coalesce("k.type", F.lit("specification"))
    loc = F.col("k.location")
    place = F.when(loc.isNotNull(), F.struct(F.coalesce("k.component_type", F.lit("unknown")).alias("component_type"), F.coalesce(loc["zone"], F.lit("unknown")).alias("zone"),
                                             loc["sub_zone"].alias("sub_zone"), loc["side"].alias("side"), loc["access"].alias("access")))
    wires = F.transform(F.coalesce("k.connections", F.array().cast(_connection_type())), lambda c: F.struct(
        *[F.coalesce(c[n], F.lit("unknown")).alias(n) for n in ("source", "target", "connection_type")], c["wire_color"].alias("wire_color"), c["wire_gauge"].alias("wire_gauge")))
    return items.filter(kind.isin(kinds)).select(
        "post_id", kind.alias("knowledge_type"), F.coalesce("vehicle", "_v").alias("vehicle"), F.col("k.component_type").alias("component_type"), place.alias("location"),
        wires.alias("connections"), F.col("k.symptom").alias("symptom"), F.col("k.root_cause").alias("root_cause"), F.col("k.solution").alias("solution"),
        F.coalesce("k.confidence", F.lit(0.5)).alias("confidence"), "content")


def _connection_type() -> str:
    return "array<struct<source:string, target:string, connection_type:string, wire_color:string, wire_gauge:string>>"


def failure_report(failures: DataFrame) -> DataFrame:
    """Failures and pages per stage; ``failures``: ``page, stage, error``."""
    return failures.groupBy("stage").agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("page").alias("pages"), F.count_distinct("error").alias("errors"), F.min("page").alias("first_page"))


#: Entity patterns, case-insensitive; a later one overrides an earlier one.
BIO_PATTERNS = [
    ("COMPONENT", r"\b[RKCLQUF]\d+[A-Z]*\b"), ("COMPONENT", r"\b(?:relay|fuse|resistor|capacitor|inductor|diode)\b"),
    ("NET", r"\b(?:VCC|VDD|GND|GROUND|IG1|IG2|ACC|BATT)\b"), ("NET", r"\b[A-Z]+\d*\b"),
    ("VALUE", r"\b\d+[kKmM]?[ΩΩ]?\b"), ("VALUE", r"\b\d+[.,]?\d*[uµnpmk]?[FH]\b"), ("VALUE", r"\b\d+[.,]?\d*[Vv]\b"), ("VALUE", r"\b\d+[.,]?\d*[Aa]\b"),
    ("LOCATION", r"\b(?:pin|connector|terminal|contact)\s+\d+\b"), ("LOCATION", r"\b(?:fuse|relay)\s+(?:box|panel)\b"),
]


def bio_labels(text: Column, patterns: list[tuple[str, str]] = BIO_PATTERNS) -> Column:
    """One label per blank-separated word: ``B-``/``I-`` of the last pattern that covers it, or ``O``."""
    compiled = [(name, re.compile(rx, re.IGNORECASE)) for name, rx in patterns]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def label(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            spots = [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
            ends = [e for _, e in spots]
            out = ["O"] * len(spots)
            for name, rx in compiled:
                for m in rx.finditer(t):
                    first, last = bisect.bisect_right(ends, m.start()), bisect.bisect_left(ends, m.end())
                    for i in range(first, min(last, len(out) - 1) + 1):
                        out[i] = f"{'B' if i == first else 'I'}-{name}"
            return out

        return texts.map(one)

    return label(text)


def label_confidence(labels: Column) -> Column:
    found = F.filter(labels, lambda x: x != "O")
    kinds = F.array_distinct(F.transform(found, lambda x: F.substr(x, F.lit(3))))
    return F.when(F.size(found) == 0, 0.5).otherwise(F.least(F.lit(1.0), (F.size(kinds) / 4.0 + F.size(found) / F.nullif(F.size(labels), F.lit(0))) / 2))


def text_samples(disagreements: DataFrame, failures: DataFrame, n: int = 3) -> DataFrame:
    """Distinct texts of more than ``n`` characters from readings, and all texts of failures."""
    a = disagreements.select(F.trim("text").alias("text")).filter(F.length("text") > n)
    return a.unionByName(failures.select("text").filter(F.col("text") != "")).distinct()


def contrastive_pairs(readings: DataFrame, key: list[str], high: float = 0.8, gap: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Positive pairs: neighbouring confident readings of a region in engine order; negative pairs:
    the most against the least confident reading when they are ``gap`` apart."""
    one = best_readings(readings, key).withColumn("r", F.struct("r.text", F.round("r.confidence", 9).alias("confidence")))
    listed = one.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("engine", "r.text", "r.confidence"))).alias("e")).filter(F.size("e") >= 2)
    sure = F.filter("e", lambda x: x["confidence"] > high)
    steps = F.transform(F.slice(sure, F.lit(2), F.greatest(F.size(sure), F.lit(1))), lambda x, i: F.struct(F.get(sure, i)["text"].alias("a"), x["text"].alias("b")))
    positive = listed.select(*key, F.explode(steps).alias("p")).select(*key, "p.*")
    top, low = F.max_by("r.text", F.struct("r.confidence", "engine")), F.min_by("r.text", F.struct("r.confidence", "engine"))
    negative = one.groupBy(*key).agg(top.alias("a"), low.alias("b"), F.round(F.max("r.confidence") - F.min("r.confidence"), 9).alias("gap")).filter(F.col("gap") > gap)
    return positive, negative


def error_patches(signals: DataFrame) -> DataFrame:
    """Boxes to learn from: one row per detected symbol with a full box.

    ``signals``: ``job_id, page, severity, symbols array<struct<type, confidence, bbox array>>, errors array``.
    """
    return signals.select("job_id", "page", "severity", F.size("errors").alias("error_count"), F.explode("symbols").alias("s")).filter(F.size("s.bbox") == 4).select(
        "job_id", "page", "severity", "error_count", F.col("s.type").alias("detected_type"), F.coalesce("s.confidence", F.lit(0.0)).alias("confidence"), F.col("s.bbox").alias("bbox"))


def error_type_counts(messages: DataFrame, column: str = "message") -> DataFrame:
    low = F.lower(column)
    kind = (F.when(low.contains("pin"), "pin_errors").when(low.contains("type"), "classification_errors").when(low.contains("missing"), "missed_detections")
            .when(low.contains("duplicate"), "duplicate_detections").otherwise("other_errors"))
    return messages.groupBy(kind.alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def due_jobs(jobs: DataFrame, signals: DataFrame, now: Column) -> DataFrame:
    """Jobs that are enabled, due by schedule and have enough signals of their type.

    ``jobs``: ``job, schedule, enabled, last_run, signal_type, min_samples``.
    """
    counts = signals.groupBy("signal_type").agg(F.count(F.lit(1)).alias("samples"))
    days = F.when(F.col("schedule") == "daily", 1).when(F.col("schedule") == "monthly", 30).otherwise(7)
    due = F.col("enabled") & (F.col("last_run").isNull() | (now - F.col("last_run") >= F.make_dt_interval(days)))
    return jobs.join(counts, "signal_type", "left").fillna(0, subset=["samples"]).withColumns(
        {"due": due, "ready": F.col("samples") >= F.col("min_samples")}).withColumn("run", F.col("due") & F.col("ready"))
