"""Nearest neighbours by int8 block products, and near-duplicates by Euclidean p-stable hashing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import components, mix
from wirelake.session import cut


def usable(vector: Column) -> Column:
    """False for a vector that is null, empty, all zero or holds null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    """Binary rows of ``dim`` doubles as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim).astype(kind, copy=False)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the largest component lies in 0.5 .. 1: no square overflows, none that counts vanishes.

    Such a factor changes neither a cosine nor, in the usual range, any bit of how it is computed.
    """
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    # in two steps, as the factor itself can be out of range
    half = -exponent // 2
    return np.ldexp(np.ldexp(x, half[:, None]), (-exponent - half)[:, None])


def packed_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, dim, x``: usable vectors as rows of little-endian doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.asarray(lists.offsets)
            flat = np.asarray(lists.values, np.float64)
            x = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int32()), pa.array(x, pa.binary())], ["id", "dim", "x"])

    good = rows.filter(usable(F.col(vector)) & F.col(key).isNotNull())
    return good.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(pack, "id bigint, dim int, x binary")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of equal first ``keys`` columns, from sorted input, of about ``rows`` rows.

    A group is never split, so a table holds ``rows`` and one group more at most.
    """
    held: pa.Table | None = None
    for batch in batches:
        held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
        while held.num_rows > rows:
            edges = boundaries(held, keys)
            inner = edges[(edges > 0) & (edges < held.num_rows)]
            if not len(inner):
                break
            at = int(inner[min(np.searchsorted(inner, rows), len(inner) - 1)])
            yield held.slice(0, at).combine_chunks()
            held = held.slice(at)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def boundaries(held: pa.Table, keys: int) -> np.ndarray:
    """Where groups begin, and the end."""
    new = np.zeros(held.num_rows + 1, bool)
    new[0] = new[-1] = True
    for i in range(keys):
        values = held.column(i).to_numpy()
        new[1:-1] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


# ---------------------------------------------------------------------------------------------
# nearest neighbours
# ---------------------------------------------------------------------------------------------


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, scale, error)`` of unit rows: ``scale * codes`` is within ``error`` of the row in Euclidean norm."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    codes = np.rint(x / scale)
    return codes.astype(np.int8), scale[:, 0], np.linalg.norm(x - scale * codes, axis=1)


class Nearest:
    """A heap of the ``k`` best candidates of one query: larger score first, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def push(self, score: float, candidate: int) -> None:
        item = (score, -candidate)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, item)
        elif item > self.heap[0]:
            heapq.heapreplace(self.heap, item)

    def best(self) -> list[tuple[float, int]]:
        return [(score, -negative) for score, negative in sorted(self.heap, reverse=True)]


def tile_survivors(q: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Mask of pairs that can be among the ``k`` best of a query in this tile.

    With unit rows x = s a + e and y = t b + f, |x.y - s t a.b| <= |e| |y| + |s a| |f| <= |e| + (1 + |e|) |f|.
    The int8 products are sums of at most dim * 127^2 < 2^53 and so exact in double precision.
    """
    (qa, qs, qe), (ca, cs, ce) = quantise(q), quantise(c)
    near = (qa.astype(np.float64) @ ca.astype(np.float64).T) * qs[:, None] * cs[None, :]
    bound = qe[:, None] + (1 + qe)[:, None] * ce[None, :] + 1e-9
    if c.shape[0] <= k:
        return np.ones_like(near, bool)
    floor = np.partition(near - bound, -k, axis=1)[:, -k]
    return near + bound >= floor[:, None]


def nearest(rows: DataFrame, queries: Column, key: str, vector: str, k: int = 5, query_block: int = 1024, block: int = 4096) -> DataFrame:
    """The ``k`` rows of largest cosine for each query row: ``query_id, rank, vec_id, score``.

    Queries are the rows where ``queries`` holds; candidates are all rows with another id.  Both are
    dealt into blocks, and every pair of blocks is one tile: int8 products with error bounds leave few
    pairs, whose cosine is computed in double precision; heaps keep ``k`` per query, first per tile,
    then over the tiles of a query.  No row holds a group: a tile has at most about ``query_block``
    queries and ``block`` candidates, a heap has ``k`` entries.  The work is queries times rows, by the
    definition of an exact search.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id,
    take no part.  Vectors of another length than the query's are no candidates.  Repeated ids other than the query's
    are candidates of their own.  Fewer than ``k`` candidates: all of them.  No rows: no result.
    """
    sample = packed_vectors(rows.withColumn("__asks", F.coalesce(queries, F.lit(False))).filter("__asks"), key, vector)
    asks, every = cut(sample), cut(packed_vectors(rows, key, vector))
    asked, total = asks.count(), every.count()
    left, right = max(1, math.ceil(asked / query_block)), max(1, math.ceil(total / block))
    dealt = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt), "x"), F.lit(n)).cast("int")
    a = asks.select("dim", dealt(left, 1).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(right - 1))).alias("cb"), F.lit(True).alias("asks"), "id", "x")
    b = every.select("dim", F.explode(F.sequence(F.lit(0), F.lit(left - 1))).alias("qb"), dealt(right, 2).alias("cb"), F.lit(False).alias("asks"), "id", "x")

    def tile(held: pa.Table) -> pa.Table:
        dim = held.column("dim")[0].as_py()
        side = held.column("asks").to_numpy()
        ids, x = held.column("id").to_numpy(), matrix(held.column("x"), dim)
        out: list[tuple[int, int, float]] = []
        if side.any() and not side.all():
            x = scaled(x)
            raw_q, raw_c, ids_q, ids_c = x[side], x[~side], ids[side], ids[~side]
            norm_q, norm_c = np.sqrt((raw_q**2).sum(1)), np.sqrt((raw_c**2).sum(1))
            order = np.argsort(ids_c, kind="stable")
            raw_c, ids_c, norm_c = raw_c[order], ids_c[order], norm_c[order]
            unit_q, unit_c = raw_q / norm_q[:, None], raw_c / norm_c[:, None]
            for at in range(0, len(ids_q), 128):
                # one more than k, as the query itself is among the candidates of one tile
                extra = int(max((ids_c[None, :] == ids_q[at : at + 128, None]).sum(1).max(), 0))
                mask = tile_survivors(unit_q[at : at + 128], unit_c, k + extra)
                i, j = np.nonzero(mask)
                i += at
                other = ids_q[i] != ids_c[j]
                i, j = i[other], j[other]
                score = (raw_q[i] * raw_c[j]).sum(axis=1) / (norm_q[i] * norm_c[j])
                heaps: dict[int, Nearest] = {}
                for query, value, candidate in zip(i.tolist(), score.tolist(), ids_c[j].tolist(), strict=True):
                    heaps.setdefault(query, Nearest(k)).push(value, candidate)
                out += [(int(ids_q[query]), candidate, value) for query, heap in heaps.items() for value, candidate in heap.best()]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    found = a.unionByName(b).groupBy("dim", "qb", "cb").applyInArrow(tile, "query_id bigint, vec_id bigint, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, 1, 20_000):
            heaps: dict[int, Nearest] = {}
            for query, candidate, score in zip(*(held.column(i).to_pylist() for i in range(3)), strict=True):
                heaps.setdefault(query, Nearest(k)).push(score, candidate)
            out = [(query, rank, candidate, score) for query, heap in heaps.items() for rank, (score, candidate) in enumerate(heap.best(), 1)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "rank", "vec_id", "score"])

    gathered = found.repartition("query_id").sortWithinPartitions("query_id")
    return gathered.mapInArrow(merge, "query_id bigint, rank int, vec_id bigint, score double")


# ---------------------------------------------------------------------------------------------
# near-duplicates
# ---------------------------------------------------------------------------------------------

#: Width of a hash interval, in units of the vectors' length.
WIDTH = 2.0
#: Chance that a pair at the threshold shares no table.
MISS = 0.001


def meeting(distance: float, width: float = WIDTH) -> float:
    """Chance that two vectors at ``distance`` share one quantised projection (2-stable, Gaussian)."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(rows: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """``(projections per table, tables)``: unrelated vectors meet about four to a bucket, links are missed with chance ``miss``."""
    near, far = meeting(math.sqrt(2 - 2 * cosine)), meeting(math.sqrt(2))
    depth = max(4, math.ceil(math.log(max(rows, 2) / 4) / -math.log(far)))
    return depth, math.ceil(math.log(miss) / math.log1p(-(near**depth)))


def bucket_keys(unit: np.ndarray, depth: int, tables: int, seed: int = 9) -> np.ndarray:
    """A 32-bit bucket key per row and table: floor((a.x + b) / width) of ``depth`` projections, hashed together."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    keys = np.zeros((len(unit), tables), np.uint32)
    for t in range(tables):
        project, shift = rng.standard_normal((unit.shape[1], depth)), rng.uniform(0, WIDTH, depth)
        cells = np.floor((unit @ project + shift) / WIDTH).astype(np.int64).view(np.uint64)
        h = np.full(len(unit), np.uint64(t + 1))
        for i in range(depth):
            h = mix(h ^ cells[:, i])
        keys[:, t] = (h >> np.uint64(32)).astype(np.uint32)
    return keys


def pairs_in_block(x: np.ndarray, keys: np.ndarray, group: np.ndarray, tables: np.ndarray, cross: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group with a cosine of at least ``cosine`` that meet in no earlier table.

    ``cross`` is 0 where all pairs of a tile count, else 1 or 2: then only pairs of different sides.
    """
    x = scaled(x)
    norm = np.sqrt((x**2).sum(1))
    unit = x / norm[:, None]
    i, j = np.nonzero(np.triu((unit @ unit.T >= cosine - 1e-9) & (group[:, None] == group[None, :]), 1))
    keep = (cross[i] == 0) | (cross[i] != cross[j])
    i, j = i[keep], j[keep]
    found_i, found_j = [], []
    for at in range(0, len(i), 200_000):
        a, b = i[at : at + 200_000], j[at : at + 200_000]
        sure = (x[a] * x[b]).sum(1) / (norm[a] * norm[b]) >= cosine
        a, b = a[sure], b[sure]
        earlier = np.arange(keys.shape[1])[None, :] < tables[a][:, None]
        first = ~((keys[a] == keys[b]) & earlier).any(axis=1)
        found_i.append(a[first])
        found_j.append(b[first])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (i[:0], j[:0])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes, the smallest node that the pairs connect it with."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (before == root).all():
            break
    while (root[root] != root).any():
        root = root[root]
    return root


def near_vectors(rows: DataFrame, key: str, vector: str, cosine: float = 0.95, most: int = 1024) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row, linking vectors with a cosine of at least ``cosine``.

    Normalised vectors fall into buckets of quantised Gaussian projections, in several tables whose
    number follows from the wanted recall; pairs that share a bucket are compared in double precision.
    A pair that meets in several tables is counted in the first.  Equal vectors are merged before and
    counted with their number.  A bucket above ``most`` vectors is split into blocks, each pair of
    blocks is a tile of its own, and a tile returns one count and one link per vector, never pairs.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do
    vectors of different lengths.  ``component_id`` is the smallest ``vec_id`` reached by links.  Rows
    with a null id are reported with no links.  Rows with the same id stay separate rows; no rows, no result.
    """
    packed = cut(packed_vectors(rows, key, vector))
    classes = packed.groupBy("dim", "x").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    depth, tables = table_plan(classes.count(), cosine)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = matrix(part.column("x"), int(dim))
                unit = scaled(x)
                keys = bucket_keys(unit / np.sqrt((unit**2).sum(1))[:, None], depth, tables)
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid"), part.column("dim"), part.column("copies"), part.column("x"), pa.array([k.tobytes() for k in keys], pa.binary()),
                     pa.array(list(keys.astype(np.int64)), pa.list_(pa.int64()))], ["cid", "dim", "copies", "x", "keys", "buckets"])

    signed = cut(classes.select("cid", "dim", "copies", "x").mapInArrow(hashed, "cid bigint, dim int, copies bigint, x binary, keys binary, buckets array<bigint>"))
    entries = signed.select("dim", F.posexplode("buckets").alias("t", "bucket"), "cid")
    sizes = entries.groupBy("dim", "t", "bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    blocks = F.ceil(F.col("m") / F.lit(most / 2)).cast("int")
    one = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    # of blocks 0 .. n-1, tile (i, j) with i <= j holds blocks i and j; a member of block i is in n tiles
    sent = entries.join(sizes, ["dim", "t", "bucket"]).withColumn("blocks", F.when(F.col("m") <= most, 1).otherwise(blocks)).withColumn("own", one)
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)
    tiles = sent.select("dim", "t", "bucket", (low * F.col("blocks") + high).cast("bigint").alias("tile"), side.alias("side"), "cid")
    full = tiles.join(signed.select("cid", "copies", "x", "keys"), "cid").select("dim", "t", "bucket", "tile", "side", "cid", "copies", "x", "keys")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, 4, 1000):
            edges = boundaries(held, 4)
            group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            dims = held.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = held.take(pa.array(at))
                keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.uint32).reshape(len(at), tables)
                cid, copies = part.column("cid").to_numpy(), part.column("copies").to_numpy()
                i, j = pairs_in_block(matrix(part.column("x"), int(dim)), keys, group[at], part.column("t").to_numpy(), part.column("side").to_numpy(), cosine)
                links = np.bincount(i, copies[j], len(at)) + np.bincount(j, copies[i], len(at))
                # the same class occurs once per group, so roots are taken per group: ids stay apart there
                root = forest(len(at), i, j)
                out = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[out]), pa.array(links[out].astype(np.int64)), pa.array(cid[root[out]])], ["cid", "links", "root"])

    order = ["dim", "t", "bucket", "tile"]
    met = cut(full.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "cid bigint, links bigint, root bigint"))
    counts = met.groupBy("cid").agg(F.sum("links").alias("others"))
    joined = components(met.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    named = classes.join(joined.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    per_class = named.join(counts, "cid", "left").join(smallest, "component").select(
        "dim", "x", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # rows of a class find it by its smallest id and the vector's bytes
    linked = packed.join(per_class, ["dim", "x"]).select("id", "n_links", "component_id")
    alone = rows.filter(~usable(F.col(vector)) | F.col(key).isNull()).select(
        F.col(key).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("n_links"), F.col(key).cast("bigint").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
