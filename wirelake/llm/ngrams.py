"""An interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, mapped by workers."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import mix, save_array, shared_folder, slices, words_of
from wirelake.llm.neardup import WordHashes
from wirelake.session import cut

U64 = np.uint64
#: Tokens that a task counts before it sends the counts on, and occurrences of a shard of pairs.
CHUNK, SHARD = 1_000_000, 4_000_000
#: Bytes of text for which the vocabulary gets a shard, and how many shards it has at least.
WORD_BYTES, LEAST_SHARDS = 16 << 20, 64
#: The end of a text; the word hash of a byte string that no word can be.
END = b"\n"


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= (x >> U64(31)) ^ (x >> U64(62))
        x *= U64(pow(0x94D049BB133111EB, -1, 1 << 64))
        x ^= (x >> U64(27)) ^ (x >> U64(54))
        x *= U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
        x ^= (x >> U64(30)) ^ (x >> U64(60))
    return x


def squeeze(sorted_numbers: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences, equal bytes together."""
    steps = np.diff(sorted_numbers.astype(U64), prepend=U64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T.copy().view(U64)[:, 0]
    return np.cumsum(steps, dtype=U64)


def squeeze_counts(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unsqueeze_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0].astype(np.int64)


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys, and each column summed by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns))


def shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the numbers that belong to them."""

    folder: str
    word_base: tuple[int, ...]  # id of the first word of each vocabulary shard, and the number of words
    tokens: int
    bits: int = 0  # of the shards of pairs
    kinds: int = 0  # different pairs
    pair_discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    word_rest: float = 1.0  # share of the continuation mass that goes to the uniform distribution
    span: int = 1  # ids of one file of dense arrays

    @property
    def words(self) -> int:
        return self.word_base[-1]


class Arrays:
    """The arrays of a model, mapped into memory on first use; no worker reads more pages than it needs."""

    def __init__(self, model: Model):
        self.model, self.held = model, {}

    def get(self, name: str) -> np.ndarray:
        if name not in self.held:
            self.held[name] = np.load(f"{self.model.folder}/{name}.npy", mmap_mode="r")
        return self.held[name]

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unknown) and training count of each word hash."""
        each, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(each), -1, np.int64), np.zeros(len(each), np.int64)
        shards = len(self.model.word_base) - 1
        bounds = np.searchsorted(shard_of(each, shards.bit_length() - 1), np.arange(shards + 1))
        for shard in range(shards):
            a, b = bounds[shard], bounds[shard + 1]
            if a < b and self.model.word_base[shard] < self.model.word_base[shard + 1]:
                known = self.get(f"word-{shard}")
                at = np.minimum(np.searchsorted(known, each[a:b]), len(known) - 1)
                hit = known[at] == each[a:b]
                ids[a:b] = np.where(hit, self.model.word_base[shard] + at, -1)
                counts[a:b] = np.where(hit, self.get(f"wordcount-{shard}")[at], 0)
        return ids[back], counts[back]

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Training count of each hashed pair, 0 for unseen ones."""
        each, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(each), np.int64)
        bounds = np.searchsorted(shard_of(each, self.model.bits), np.arange((1 << self.model.bits) + 1))
        for shard in range(1 << self.model.bits):
            a, b = bounds[shard], bounds[shard + 1]
            if a < b and os.path.exists(f"{self.model.folder}/pair-{shard}.npy"):
                known = self.get(f"pair-{shard}")
                at = np.minimum(np.searchsorted(known, each[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == each[a:b], self.get(f"paircount-{shard}")[at], 0)
        return out[back]

    def dense(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of an array by word id that is kept in files of ``span`` ids."""
        out = np.zeros(len(ids))
        part = ids // self.model.span
        for p in np.unique(part):
            at = part == p
            if os.path.exists(f"{self.model.folder}/{name}-{p}.npy"):
                out[at] = self.get(f"{name}-{p}")[ids[at] % self.model.span]
        return out


@lru_cache(maxsize=2)
def arrays_of(model: Model) -> Arrays:
    return Arrays(model)


def discount(counts: np.ndarray, discounts: tuple[float, ...]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)]


def discounts_of(n: list[int]) -> tuple[float, ...]:
    """Modified Kneser-Ney discounts from the numbers of things seen once, twice, three and four times.

    Where these are too few to give a discount within 0 .. k, it is k / 2.
    """
    out = []
    base = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * base * n[k] / n[k - 1] if n[k - 1] else -1.0
        out.append(d if 0 < d < k else k / 2)
    return tuple(out)


def tallies(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], hashes: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(token hashes, is the first of its text)`` of about ``CHUNK`` tokens; every text has an end token."""
    end = hashes[END]
    tokens, starts, n = [], [], 0
    for batch in slices(batches, 500):
        for text in batch.column(0).to_pylist():
            own = np.append(hashes.of(words_of(text)), U64(end))
            tokens.append(own)
            starts.append(n)
            n += len(own)
        if n >= CHUNK:
            yield _joined(tokens, starts, n)
            tokens, starts, n = [], [], 0
    if n:
        yield _joined(tokens, starts, n)


def _joined(tokens: list[np.ndarray], starts: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(n, bool)
    first[starts] = True
    return np.concatenate(tokens), first


def _sent(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys with counts, one compressed row per shard."""
    bounds = np.searchsorted(shard_of(keys, bits), np.arange((1 << bits) + 1))
    rows = [(s, squeeze(keys[a:b]), squeeze_counts(counts[a:b])) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "keys", "counts"])


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = summed(np.concatenate([unsqueeze(x.as_py()) for x in table.column("keys")]),
                          np.concatenate([unsqueeze_counts(x.as_py()) for x in table.column("counts")]))
    return keys, counts


def train(texts: DataFrame) -> Model:
    """The model of a table with one column ``text`` (null: the empty text), each text ending in an end token.

    1. Words are counted per task, then per shard of their hashes: a word's id is its place in the sorted hashes.
    2. Pairs (word before or start, word) are counted likewise.  A pair's hash is a bijection of its two
       ids, so no two pairs share one, and shards are equally large whatever word is frequent.
    3. Each shard of pairs gives, per word, what it adds to the totals after it and to the number of
       different words before it; these are summed by ranges of ids.
    Tasks write their arrays to the shared folder under fixed names, so a task that runs again replaces
    its own.  Only numbers per shard reach the driver.
    """
    folder = shared_folder(texts.sparkSession, "ngrams")
    texts = texts.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (max(LEAST_SHARDS, -(-size // WORD_BYTES)) - 1).bit_length()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for tokens, _ in _chunks(batches, hashes):
            yield _sent(*np.unique(tokens, return_counts=True), bits)

    def word_shard(table: pa.Table) -> pa.Table:
        keys, counts = _gathered(table)
        shard = table.column("shard")[0].as_py()
        save_array(f"{folder}/word-{shard}.npy", keys)
        save_array(f"{folder}/wordcount-{shard}.npy", counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    blobs = "shard int, keys binary, counts binary"
    found = {r["shard"]: r for r in texts.mapInArrow(words, blobs).groupBy("shard").applyInArrow(word_shard, "shard int, n bigint, total bigint").collect()}
    base = [0]
    for shard in range(1 << bits):
        base.append(base[-1] + (found[shard]["n"] if shard in found else 0))
    tokens = sum(r["total"] for r in found.values())
    if not tokens:
        return Model(folder, tuple(base), 0)
    pair_bits = max(0, int(-(-tokens // SHARD) - 1).bit_length())
    model = Model(folder, tuple(base), tokens, bits=pair_bits)
    size, start = model.words + 1, model.words
    span = max(1 << 16, -(-size // (1 << pair_bits)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for tokens, first in _chunks(batches, hashes):
            ids = arrays_of(model).word_ids(tokens)[0]
            before = np.where(first, start, np.roll(ids, 1))
            yield _sent(*np.unique(mix((before * size + ids).astype(U64)), return_counts=True), pair_bits)

    kept = "kind string, part int, keys binary, a binary, b binary, c binary, d binary, n1 bigint, n2 bigint, n3 bigint, n4 bigint, n bigint"

    def pair_shard(table: pa.Table) -> pa.Table:
        keys, counts = _gathered(table)
        shard = table.column("shard")[0].as_py()
        save_array(f"{folder}/pair-{shard}.npy", keys)
        save_array(f"{folder}/paircount-{shard}.npy", counts.astype(np.uint32))
        both = unmix(keys).astype(np.int64)
        before, word = both // size, both % size
        rows = [("shard", shard, b"", b"", b"", b"", b"", *tallies(counts).tolist(), len(keys))]
        after = summed(before, counts, counts == 1, counts == 2, counts >= 3)
        less = summed(word, np.ones(len(word), np.int64))
        for kind, (ids, *columns) in (("after", after), ("before", less)):
            bounds = np.searchsorted(ids, np.arange(0, size + span, span))
            for part, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if a < b:
                    packed = [squeeze_counts(c[a:b]) for c in columns] + [b""] * (4 - len(columns))
                    rows.append((kind, part, squeeze(ids[a:b]), *packed, 0, 0, 0, 0, 0))
        names = [x.split()[0] for x in kept.split(", ")]
        kinds = [pa.string(), pa.int32(), *[pa.binary()] * 5, *[pa.int64()] * 5]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    stats = cut(texts.mapInArrow(pairs, blobs).groupBy("shard").applyInArrow(pair_shard, kept))
    tally = stats.filter("kind = 'shard'").agg(*[F.sum(x) for x in ("n1", "n2", "n3", "n4", "n")]).first()
    pair_discounts = discounts_of(list(tally[:4]))

    def ranges(table: pa.Table) -> pa.Table:
        kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
        ids = np.concatenate([unsqueeze(x.as_py()) for x in table.column("keys")]).astype(np.int64) - part * span
        column = lambda name: np.bincount(ids, np.concatenate([unsqueeze_counts(x.as_py()) for x in table.column(name)]), span)
        none = [0] * 5
        if kind == "after":
            total = column("a")
            mass = sum(d * column(x) for d, x in zip(pair_discounts, "bcd", strict=True))
            save_array(f"{folder}/total-{part}.npy", total)
            save_array(f"{folder}/rest-{part}.npy", np.divide(mass, total, out=np.zeros(span), where=total > 0))
        else:
            different = column("a").astype(np.int64)
            save_array(f"{folder}/different-{part}.npy", different.astype(np.uint32))
            none = [*tallies(different).tolist(), int((different > 0).sum())]
        return pa.table({n: pa.array([v], pa.int64()) for n, v in zip(("n1", "n2", "n3", "n4", "n"), none, strict=True)})

    parts = stats.filter("kind <> 'shard'").groupBy("kind", "part").applyInArrow(ranges, "n1 bigint, n2 bigint, n3 bigint, n4 bigint, n bigint").collect()
    low = [sum(r[i] for r in parts) for i in range(5)]
    word_discounts = discounts_of(low[:4])
    seen = [low[0], low[1], low[4] - low[0] - low[1]]
    rest = sum(d * x for d, x in zip(word_discounts, seen, strict=True)) / tally[4]
    return Model(folder, tuple(base), tokens, pair_bits, tally[4], pair_discounts, word_discounts, rest, span)


def text_scores(arrays: Arrays, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(log10 probability, log10 add-one probability, known)`` of each token."""
    model = arrays.model
    ids, counts = arrays.word_ids(hashes)
    base = np.log10((counts + 1) / (model.tokens + model.words + 1))
    if not model.tokens:
        return np.zeros(len(ids)), base, counts > 0
    known = ids >= 0
    some = np.where(known, ids, 0)
    different = np.where(known, arrays.dense("different", some), 0)
    # a word after any: its share of different pairs, and of the uniform rest over all words and one unknown
    single = (different - discount(different, model.word_discounts)) / model.kinds + model.word_rest / (model.words + 1)
    before = np.where(first, model.words, np.roll(ids, 1))
    ready = np.maximum(before, 0)
    total = np.where(before >= 0, arrays.dense("total", ready), 0)
    seen = np.zeros(len(ids))
    asked = np.flatnonzero(known & (total > 0))
    seen[asked] = arrays.pair_counts(mix((ready[asked] * (model.words + 1) + ids[asked]).astype(U64)))
    own = np.divide(seen - discount(seen, model.pair_discounts), total, out=np.zeros(len(ids)), where=total > 0)
    rest = np.where(total > 0, arrays.dense("rest", ready), 1.0)
    return np.log10(own + rest * single), base, known


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row ``doc_id, text, held_out``.

    Whole texts; a null text is the empty one, which has its end token.  Without training tokens all
    probability is on the unknown word.  The model's arrays are mapped from the shared folder.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, arrays = WordHashes(), arrays_of(model)
        end = hashes[END]
        for batch in slices(batches, 1000):
            own = [np.append(hashes.of(words_of(t)), U64(end)) for t in batch.column(1).to_pylist()]
            lengths = np.array([len(x) for x in own])
            starts = np.cumsum(lengths) - lengths
            found, base, known = text_scores(arrays, *_joined(own, starts.tolist(), int(lengths.sum())))
            sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, found)]
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lengths, pa.int64()), pa.array(sums[0], pa.int64()),
                 pa.array(np.full(n, model.tokens), pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out")
    return columns.mapInArrow(scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    """True for documents kept out of training; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def language_scores(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and score all; see ``train`` and ``score``."""
    split = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return score(split, train(split.filter(~F.col("held_out"))))
