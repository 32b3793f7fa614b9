"""Severity of toxic texts by cumulative-link ordinal regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import slices, words_of
from wirelake.session import cut

#: Lengths of word beginnings that are features besides the word itself; texts of the sample that a feature needs.
STEMS, LEAST_TEXTS = (4, 5, 6), 3
#: Standard deviations by which a feature's share of graded texts must differ from the sample's to have a weight.
TELLING = 4.0
#: Buckets in which features are first counted.
FIRST = 1 << 22
#: At most so many labelled rows are fitted on, so that the fit is a bounded task: a documented sample.
FIT_ROWS = 20_000
_TRIM = b".,;:!?\"'()[]{}|*&%$#<>-_/\\=+~`@^"


class FeatureCache(dict):
    """Features of a word: 64-bit hashes, or with ``known`` (sorted hashes) the places of those it has there.

    Forgets all when it holds too many words.
    """

    def __init__(self, known: np.ndarray | None = None):
        super().__init__()
        self.place = None if known is None else {int(h): i for i, h in enumerate(known)}

    def __missing__(self, word: bytes) -> list[int]:
        bare = word.strip(_TRIM)
        text = bare.decode("utf-8", "replace")
        names = [b"w" + bare] + [b"s" + text[:n].encode() for n in STEMS if len(text) > n] if bare else []
        value = [xxhash.xxh3_64_intdigest(name) >> 1 for name in names]
        if self.place is not None:
            value = [self.place[v] for v in value if v in self.place]
        self[word] = value
        return value

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct features of a whole text, and how often each occurs."""
        if len(self) > 250_000:
            self.clear()
        found = [f for word in words_of(text) for f in self[word]]
        return np.unique(np.array(found, np.int64), return_counts=True)


@dataclass(frozen=True)
class Severity:
    """A fitted model: P(grade > k) = sigmoid(score - cut k), with one weight vector for all cuts.

    ``features`` are the sorted hashes that have a weight; no other feature counts.
    """

    features: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """Chance of a grade above each cut, per score."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -500, 500)))


def values_of(counts: np.ndarray) -> np.ndarray:
    """Feature values: repeats count less and less, and long texts are not scaled down."""
    return 1 + np.log(counts)


def fit_ordinal(features: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Severity:
    """Maximum likelihood of the cumulative-link model by full-batch Adagrad steps.

    P(grade = k) is the difference of neighbouring sigmoids; the cuts are kept apart by construction:
    the first is free and each next adds exp of a free number.
    """
    rows = np.repeat(np.arange(len(features)), [len(f) for f, _ in features])
    columns = np.concatenate([f for f, _ in features]) if features else np.zeros(0, np.int64)
    n = len(features)
    used, column, texts = np.unique(columns, return_inverse=True, return_counts=True)
    value = np.concatenate([values_of(c) for _, c in features]) if features else np.zeros(0)
    # features of very few texts, or as frequent in graded texts as in others, only add noise to long texts
    share = (grades > 0).mean() if n else 0.0
    graded = np.bincount(column, (grades > 0)[rows], len(used))
    odd = np.abs(graded - texts * share) >= TELLING * np.sqrt(np.maximum(texts * share * (1 - share), 1e-9))
    chosen = odd & (texts >= LEAST_TEXTS)
    rows, value, column = rows[chosen[column]], value[chosen[column]], (np.cumsum(chosen) - 1)[column[chosen[column]]]
    used = used[chosen]
    w = np.zeros(len(used))
    shares = np.array([max((grades > k).mean(), 1e-3) for k in range(levels - 1)])
    first = np.log(1 / shares - 1)
    gaps = np.log(np.maximum(np.diff(first), 0.1))
    free = np.concatenate([first[:1], gaps])
    sum_w, sum_free = np.full(len(used), 1e-6), np.full(len(free), 1e-6)
    for _ in range(steps):
        cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        score = np.bincount(rows, weights=w[column] * value, minlength=n)
        # cumulative chances at both ends of a row's grade
        ends = np.concatenate([[-np.inf], cuts, [np.inf]])
        with np.errstate(over="ignore"):
            low, high = (1 / (1 + np.exp(-(ends[grades + i] - score))) for i in (0, 1))
        chance = np.maximum(high - low, 1e-12)
        slope_low, slope_high = low * (1 - low), high * (1 - high)
        by_score = (slope_high - slope_low) / chance / n  # derivative of the loss by the score
        grad_w = np.bincount(column, weights=by_score[rows] * value, minlength=len(used)) + decay * w
        by_cut = np.array([((grades == k + 1) * slope_low / chance - (grades == k) * slope_high / chance).sum() / n for k in range(levels - 1)])
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad_free = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
        sum_w += grad_w**2
        sum_free += grad_free**2
        w -= rate * grad_w / np.sqrt(sum_w) * 0.3
        free -= rate * grad_free / np.sqrt(sum_free) * 0.3
    return Severity(used, w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def refine(features: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, grave: int = 6) -> np.ndarray:
    """Grades 0, 1, 2 from labels that only say toxic or not.

    A mark is a feature of at least 5 toxic texts of the sample of which 95 % or more are toxic.  A toxic
    text with at least ``grave`` occurrences of marks is of grade 2, another toxic text of grade 1.
    """
    columns = np.concatenate([f for f, _ in features]) if features else np.zeros(0, np.int64)
    bad = np.repeat(toxic, [len(f) for f, _ in features])
    used, column, in_all = np.unique(columns, return_inverse=True, return_counts=True)
    with_it = np.bincount(column, bad, len(used))
    marks = used[(with_it >= 5) & (with_it >= 0.95 * in_all)]
    hits = np.array([c[np.isin(f, marks, assume_unique=True)].sum() for f, c in features])
    return np.where(toxic > 0, np.where(hits >= grave, 2, 1), 0)


def fit(labelled: DataFrame, levels: int = 3, most: int = FIT_ROWS, refined: bool = False) -> Severity:
    """Fit on up to ``most`` labelled rows ``doc_id, text, grade`` (0 .. ``levels`` - 1), drawn by a keyed hash of the id.

    The rows become features in parallel.  Counts of hashed features first tell which can matter, so the
    one task that fits the model holds a few features of each row of the bounded sample.
    With ``refined`` the given grades are 0 and 1 and toxic texts are graded further by ``refine``.
    Rows with a null grade are not used.  Without any labelled row all scores are 0.
    """
    known = labelled.filter(F.col("grade").isNotNull())
    rows = known.select("text", F.col("grade").cast("int").alias("grade"), F.xxhash64(F.lit(7), "doc_id").alias("h"))
    # the bound is found on the hashes alone; no text is sorted
    last = rows.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return Severity(np.zeros(0, np.int64), np.zeros(0), np.arange(levels - 1, dtype=float) + 3)
    sample = cut(rows.filter(F.col("h") <= last).select("text", "grade").repartition(16))

    def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, texts, graded, size = FeatureCache(), np.zeros(FIRST, np.int32), np.zeros(FIRST, np.int32), [0, 0]
        for batch in slices(batches, 500):
            for text, grade in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.unique(cache.of(text)[0] % FIRST)
                texts[at] += 1
                graded[at] += grade > 0
                size = [size[0] + 1, size[1] + (grade > 0)]
        packed = [zstandard.compress(x.tobytes(), 1) for x in (texts, graded)]
        yield pa.RecordBatch.from_arrays([pa.array([0]), *[pa.array([x]) for x in size], *[pa.array([x], pa.binary()) for x in packed]], ["all", "n", "m", "texts", "graded"])

    def telling(held: pa.Table) -> pa.Table:
        sums = [np.zeros(FIRST, np.int64), np.zeros(FIRST, np.int64)]
        for total, name in zip(sums, ("texts", "graded"), strict=True):
            for part in held.column(name):
                total += np.frombuffer(zstandard.decompress(part.as_py()), np.int32)
        share = pc.sum(held.column("m")).as_py() / max(pc.sum(held.column("n")).as_py(), 1)
        odd = np.abs(sums[1] - sums[0] * share) >= TELLING / 2 * np.sqrt(np.maximum(sums[0] * share * (1 - share), 1e-9))
        chosen = np.flatnonzero(odd & (sums[0] >= LEAST_TEXTS)).astype(np.int32)
        return pa.table({"buckets": pa.array([zstandard.compress(chosen.tobytes())], pa.binary())})

    counted = sample.mapInArrow(bucket_counts, "all bigint, n bigint, m bigint, texts binary, graded binary")
    chosen = np.zeros(FIRST, bool)
    chosen[np.frombuffer(zstandard.decompress(counted.groupBy("all").applyInArrow(telling, "buckets binary").first()[0]), np.int32)] = True

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = FeatureCache()
        for batch in slices(batches, 500):
            both = [(f[chosen[f % FIRST]], c[chosen[f % FIRST]]) for f, c in map(cache.of, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([f.tobytes() for f, _ in both], pa.binary()), pa.array([c.tobytes() for _, c in both], pa.binary())], ["grade", "f", "c"])

    held = cut(sample.mapInArrow(features, "grade int, f binary, c binary"))

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["grade", "f"], ignore_index=True)
        both = [(np.frombuffer(f, np.int64), np.frombuffer(c, np.int64)) for f, c in zip(frame["f"], frame["c"], strict=True)]
        grades = frame["grade"].to_numpy(np.int64)
        model = fit_ordinal(both, refine(both, grades) if refined else grades, levels)
        return pd.DataFrame({"features": [model.features.tobytes()], "weights": [model.weights.tobytes()], "cuts": [model.cuts.tobytes()]})

    found = held.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(fitted, "features binary, weights binary, cuts binary").first()
    return Severity(np.frombuffer(found["features"], np.int64), np.frombuffer(found["weights"]), np.frombuffer(found["cuts"]))


def score(docs: DataFrame, model: Severity) -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``toxic_chance`` (of a grade above 0) and ``grade`` (most likely).

    The model is a bounded array (features of the bounded sample) that is broadcast.  Whole texts are
    read.  Null and empty texts have no features and score by the cuts alone.  All columns of ``docs``
    stay; result columns of the same name replace them.
    """
    names = [c for c in docs.columns if c not in ("severity", "toxic_chance", "grade")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<severity double, toxic_chance double, grade int>")
    def grades(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = shared.value
        cache = FeatureCache(held.features)
        for texts in parts:
            total = np.zeros(len(texts))
            for i, text in enumerate(texts):
                f, c = cache.of(text)
                total[i] = float(held.weights[f] @ values_of(c)) if len(f) else 0.0
            above = held.above(total)
            ends = np.concatenate([np.ones((len(total), 1)), above, np.zeros((len(total), 1))], axis=1)
            yield pd.DataFrame({"severity": above.sum(1), "toxic_chance": above[:, 0], "grade": (ends[:, :-1] - ends[:, 1:]).argmax(1).astype(np.int32)})

    scored = docs.select(*names, grades(F.col("text").cast("string")).alias("__s"))
    return scored.select(*names, F.col("__s.severity").alias("severity"), F.col("__s.toxic_chance").alias("toxic_chance"), F.col("__s.grade").alias("grade"))


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``severity``, ``toxic_chance``, ``grade`` by a model fitted on those that ``labels`` (``doc_id``, ``toxic``) names."""
    model = fit(graded_labels(docs, labels, F.when(F.col("toxic") > 0, 1).when(F.col("toxic") == 0, 0)), levels=3, refined=True)
    return score(docs, model)


#: A document with at least this chance of a grade above 0 is toxic.
REJECT = 0.3


def graded_labels(docs: DataFrame, labels: DataFrame, column: Column) -> DataFrame:
    """``doc_id, text, grade``: one row per labelled document; of several labels the gravest counts."""
    best = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max(column).alias("grade"))
    return docs.select("doc_id", "text").join(best, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "grade")
