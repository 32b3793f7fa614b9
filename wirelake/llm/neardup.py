"""Near-duplicate texts by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.common import components, mix, slices, words_of
from wirelake.llm.vectors import boundaries, forest, whole_groups
from wirelake.session import cut

U64 = np.uint64
#: Words of a shingle, coordinates of a sketch, coordinates of a band.
WORDS, COORDINATES, BAND = 5, 160, 5
#: Pairs whose sketches agree in a smaller share are not verified: five standard deviations below 0.75.
LIKELY = 0.58
#: Members and shingles of a block that one task compares.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
EMPTY = U64(0xFFFFFFFFFFFFFFFF)
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=U64))
_FACTORS = mix(np.arange(1001, 1001 + WORDS, dtype=U64)) | U64(1)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than a shingle are one shingle, no words none."""
    w = hashes.of(words)
    if not len(w):
        return w
    size = min(WORDS, len(w))
    with np.errstate(over="ignore"):
        total = np.full(len(w) - size + 1, U64(size))
        for i in range(size):
            total += w[i : len(w) - size + 1 + i] * _FACTORS[i]
    return np.unique(mix(total))


def sketch(shingles: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """``t`` coordinates of a non-empty set; two sets agree in one with the chance of their Jaccard similarity.

    In round i < t each element is hashed to a bin and a value i + fraction; each bin keeps its least
    value, so earlier rounds win.  Bins still empty after t rounds are filled by rounds t .. 2t - 1, in
    which round t + j sends every element to bin j: every coordinate is filled.  Several rounds of a
    small set are done at once, which changes nothing as later rounds only fill empty bins.
    """
    out = np.full(t, EMPTY)
    i = 0
    while i < t and (i == 0 or (out == EMPTY).any()):
        rounds = min(t - i, max(1, 2 * t // len(shingles)))
        h = mix(shingles[None, :] ^ _SEEDS[i : i + rounds, None])
        value = (np.arange(i, i + rounds, dtype=U64)[:, None] << U64(54)) | (h >> U64(10))
        np.minimum.at(out, ((h & U64(0xFFFFFFFF)) * U64(t) >> U64(32)).astype(np.int64).ravel(), value.ravel())
        i += rounds
    for j in np.flatnonzero(out == EMPTY):
        out[j] = (U64(t + j) << U64(54)) | (mix(shingles ^ _SEEDS[t + j]).min() >> U64(10))
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band of ``BAND`` coordinates."""
    rows, t = sketches.shape
    parts = sketches.reshape(rows, t // BAND, BAND)
    key = np.broadcast_to(np.arange(t // BAND, dtype=U64) + U64(77), parts.shape[:2]).copy()
    for i in range(BAND):
        key = mix(key ^ parts[:, :, i])
    return key


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, as two signed numbers."""
    with np.errstate(over="ignore"):
        both = [mix(shingles ^ U64(seed)).sum(dtype=U64) for seed in (0x5DEECE66D, 0x2545F4914F6CDD1D)]
    return tuple(int(np.array(x, U64).view(np.int64)) for x in both)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches, 1000):
        n, first, second, found = [], [], [], []
        for text in batch.column(1).to_pylist():
            shingles = shingle_set(words_of(text), hashes)
            one, two = fingerprint(shingles)
            n.append(len(shingles))
            first.append(one)
            second.append(two)
            found.append(sketch(shingles) if len(shingles) else np.full(COORDINATES, EMPTY))
        sketches = np.stack(found) if found else np.zeros((0, COORDINATES), U64)
        bands = band_keys(sketches).view(np.int64)
        small = mix(sketches).astype(np.uint8)
        flat = pa.array(bands.ravel(), pa.int64())
        offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
             pa.ListArray.from_arrays(offsets, flat), pa.array([s.tobytes() for s in small], pa.binary())],
            ["doc_id", "th", "n", "f1", "f2", "bands", "sketch"])


def _likely(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """Links of members of one bucket that look similar enough to be verified: a forest, not all pairs."""
    for held in whole_groups(batches, 2, 4000):
        edges = boundaries(held, 2)
        cid, n, side = (held.column(x).to_numpy() for x in ("cid", "n", "side"))
        sketches = np.frombuffer(b"".join(held.column("sketch").to_pylist()), np.uint8).reshape(len(cid), -1)
        root, left, right = np.arange(len(cid)), [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a == 2:
                left.append(a)
                right.append(a + 1)
        i, j = np.array(left, np.int64), np.array(right, np.int64)
        good = (sketches[i] == sketches[j]).mean(axis=1) >= LIKELY if len(i) else np.zeros(0, bool)
        good &= np.minimum(n[i], n[j]) >= similar * np.maximum(n[i], n[j])
        root[j[good]] = i[good]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 2:
                for k in range(a, b):
                    rest = np.flatnonzero((root[a:b] != root[k]) & ((side[a:b] == 0) | (side[a:b] != side[k]))) + a
                    rest = rest[np.minimum(n[rest], n[k]) >= similar * np.maximum(n[rest], n[k])]
                    if len(rest):
                        rest = rest[(sketches[rest] == sketches[k]).mean(axis=1) >= LIKELY]
                    if len(rest):
                        merged = np.unique(np.append(root[rest], root[k]))
                        part = root[a:b]
                        part[np.isin(part, merged)] = merged[0]
        out = np.flatnonzero(root != np.arange(len(cid)))
        yield pa.RecordBatch.from_arrays([pa.array(cid[out]), pa.array(cid[root[out]])], ["u", "v"])


def verified(sets: list[np.ndarray], known: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Roots after linking all members with 100 * intersection >= percent * union; members of equal ``known`` start linked.

    Only members that are not linked yet are intersected, on their whole sets.  With sides, only
    members of different sides are.
    """
    size = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(codes.max() + 1, bool)
    root = np.unique(known, return_index=True, return_inverse=True)
    root = root[1][root[2]]
    for k in range(len(sets)):
        rest = np.flatnonzero((root != root[k]) & ((side == 0) | (side != side[k])))
        rest = rest[100 * np.minimum(size[rest], size[k]) >= percent * np.maximum(size[rest], size[k])]
        if not len(rest):
            continue
        own = codes[starts[k] : starts[k] + size[k]]
        mark[own] = True
        if 4 * len(rest) < len(sets):
            both = np.array([mark[codes[starts[r] : starts[r] + size[r]]].sum() for r in rest])
        else:
            both = np.add.reduceat(mark[codes].astype(np.int64), starts)[rest]
        mark[own] = False
        linked = rest[100 * both >= percent * (size[rest] + size[k] - both)]
        if len(linked):
            merged = np.unique(np.append(root[linked], root[k]))
            root[np.isin(root, merged)] = merged[0]
    return root


def _check(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for held in whole_groups(batches, 2, 64):
        u, v = [], []
        edges = boundaries(held, 2)
        cid, known, side = (held.column(x).to_numpy() for x in ("cid", "known", "side"))
        raw = held.column("shingles")
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            root = verified([np.frombuffer(x.as_py(), U64) for x in raw.slice(a, b - a)], known[a:b], side[a:b], percent)
            out = np.flatnonzero(cid[a:b] != cid[a:b][root])
            u.append(cid[a:b][out])
            v.append(cid[a:b][root[out]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches, 500):
        cid, one, two = (batch.column(x).to_numpy() for x in ("cid", "f1", "f2"))
        keep, out = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            shingles = shingle_set(words_of(text), hashes)
            if fingerprint(shingles) == (one[i], two[i]):
                keep.append(i)
                out.append(shingles.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cid[keep]), pa.array(out, pa.binary())], ["cid", "shingles"])


def _in_tiles(members: DataFrame, group: str) -> DataFrame:
    """Members with ``blocks`` dealt to all tiles (i <= j) of two blocks of their group: ``tile, side``."""
    spread = members.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)
    return spread.select(group, (low * F.col("blocks") + high).cast("bigint").alias("tile"), side.alias("side"), "cid")


def near_duplicates(docs: DataFrame, percent: int = 75, with_hash: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` (and ``th``, the text's hash, on request) for every row of ``docs`` (``doc_id``, ``text``).

    1. Each whole text becomes its set of shingles (words in ASCII lower case), a fast similarity
       sketch and band keys.  Rows with equal sets form a class; from here on classes are compared.
    2. Classes that share a band key and whose sketches do not rule the similarity out are joined to
       groups.  A bucket returns a forest of such links, never its pairs.
    3. Groups are verified on full sets; a pair is only compared when it is not linked already.  A
       group of up to ``BLOCK`` classes is one tile.  Of a larger group every block is first compared
       with itself and with the first block; then only classes outside the group's largest component
       are compared with all blocks, in tiles.  So a large group of copies costs its size, plus its
       odd members times its size.
    4. Distributed union-find over the verified links gives the components.

    A pair of similarity s shares no band with chance (1 - s^5)^32: 2e-4 at 0.75, 2e-6 at 0.8.  Every
    pair of a group counts, so most such pairs are found through others.
    Texts without words (null, empty, blank) have 0 shingles and link with nothing.  ``component_id``
    is the smallest ``doc_id`` reached; rows with a null ``doc_id`` take part but never name a
    component that has other rows.  Rows with the same ``doc_id`` stay separate rows.  Other columns of ``docs``
    are not read.  No rows, no result.
    """
    similar = percent / 100
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))
    signed = cut(source.mapInArrow(_signatures, "doc_id bigint, th bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>, sketch binary"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th"))
    grouped = signed.filter("n > 0").groupBy("f1", "f2", "n").agg(least.alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("cid"), "f1", "f2", "n", "least.doc_id", "least.th", "bands", "sketch"))

    entries = classes.select(F.explode("bands").alias("key"), "cid")
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    blocks = F.when(F.col("m") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("m") / BLOCK)).cast("int").alias("blocks")
    met = _in_tiles(entries.join(sizes, "key").select("key", blocks, "cid"), "key")
    shown = met.join(classes.select("cid", "n", "sketch"), "cid").select("key", "tile", "side", "cid", "n", "sketch")
    likely = cut(shown.repartition("key", "tile").sortWithinPartitions("key", "tile")
                 .mapInArrow(lambda b: _likely(b, similar), "u bigint, v bigint").distinct())
    groups = components(likely).withColumnRenamed("id", "cid").withColumnRenamed("component", "grp")

    asked = groups.join(classes.select("cid", "f1", "f2", "n", F.col("doc_id").alias("rep"), F.col("th").alias("rep_th")), "cid")
    read = source.join(asked.select("cid", "f1", "f2", "rep", "rep_th"), (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    sets = cut(read.select("cid", "f1", "f2", "text").mapInArrow(_sets, "cid bigint, shingles binary").dropDuplicates(["cid"]))
    members = cut(asked.select("cid", "grp", "n"))
    per = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("volume"))
    need = F.when((F.col("m") <= 2 * BLOCK) & (F.col("volume") <= 2 * BLOCK_SHINGLES), 1).otherwise(
        F.ceil(F.greatest(F.col("m") / BLOCK, F.col("volume") / BLOCK_SHINGLES))).cast("int").alias("blocks")
    placed = cut(members.join(per.select("grp", need), "grp").select("grp", "cid", "blocks"))

    def compared(tiles: DataFrame) -> DataFrame:
        full = tiles.join(sets, "cid").select("grp", "tile", "side", "cid", "known", "shingles")
        return full.repartition("grp", "tile").sortWithinPartitions("grp", "tile").mapInArrow(lambda b: _check(b, percent), "u bigint, v bigint")

    # tile i has block i and the first block; the first tile has the first block alone
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    others = F.when(own == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    first = placed.select("grp", F.explode(others).alias("tile"), F.lit(0).alias("side"), "cid", F.col("cid").alias("known"))
    first = first.withColumn("tile", F.col("tile").cast("bigint"))
    links = cut(compared(first))
    large = placed.filter("blocks > 1")
    if not large.isEmpty():
        so_far = components(links)
        state = cut(large.join(so_far.withColumnRenamed("id", "cid"), "cid", "left").withColumn("known", F.coalesce("component", "cid")))
        main = state.groupBy("grp", "known").agg(F.count(F.lit(1)).alias("m")).groupBy("grp").agg(F.max_by("known", F.struct("m", "known")).alias("main"))
        odd = state.join(main, "grp").filter("known <> main").drop("main")
        odd_blocks = odd.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ob"))
        mine = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("ob")).cast("int")
        left = odd.join(odd_blocks, "grp").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "grp", (mine * F.col("blocks") + F.col("b")).cast("bigint").alias("tile"), F.lit(1).alias("side"), "cid", "known")
        right = state.join(odd_blocks, "grp").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("ob") - 1))).select(
            "grp", (F.col("b") * F.col("blocks") + own).cast("bigint").alias("tile"), F.lit(2).alias("side"), "cid", "known")
        links = cut(links.unionByName(compared(left.unionByName(right))))
    joined = components(links).withColumnRenamed("id", "cid")

    named = classes.select("cid", "f1", "f2", "n", "doc_id").join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    answer = named.join(smallest, "component").select("f1", "f2", "n", "component_id")
    linked = signed.filter("n > 0").join(answer, ["f1", "f2", "n"]).select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.filter("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    every = linked.unionByName(alone)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return every.select("doc_id", "n_shingles", "component_id", kept, *(["th"] if with_hash else []))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` in its own columns with one row of each group of near-duplicates: that of the smallest ``doc_id``.

    Texts without words all stay.  Of rows that repeat both ``doc_id`` and a non-empty text one stays.
    """
    found = near_duplicates(docs, percent, with_hash=True).filter("kept")
    stay = found.groupBy("doc_id", "th").agg(F.max("n_shingles").alias("n"))
    stay = stay.select(F.xxhash64("doc_id", "th").alias("__k"), F.col("doc_id").alias("__id"), F.col("th").alias("__h"), F.col("n").alias("__n"))
    th = F.xxhash64(F.col("text").cast("string"))
    keyed = docs.withColumn("__th", th).withColumn("__key", F.xxhash64(F.col("doc_id").cast("bigint"), F.col("__th")))
    same = (F.col("__key") == F.col("__k")) & (F.col("__th") == F.col("__h")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id"))
    again = Window.partitionBy("__key", "__th", "doc_id").orderBy(F.lit(1))
    return keyed.join(stay, same).withColumn("__rn", F.row_number().over(again)).filter("__n = 0 OR __rn = 1").select(*docs.columns)
