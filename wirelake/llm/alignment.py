"""Alignment of the tokens of two tokenizers over the same bytes, in Arrow tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.blocks import CO_LOCATED, Blocks, settings
from wirelake.llm.common import slices
from wirelake.session import cut

#: Characters of text, if no single text has more, that one step aligns; pairs that a task counts before it passes them on.
STEP, HELD = 3_000_000, 500_000
#: Where a text is cut into parts, and what a part ends in for that; parts that are encoded together.
PART, SAFE, RUN = re.compile(r"(?<=[\w.,;:!?])(?= +[^ ])"), re.compile(r"[\w.,;:!?]$"), 5000
#: Room for ids of the second tokenizer in the number of a pair.
SECOND = 1 << 32

ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
EMPTY = [0, 0, 0, 0, "", [], []]
_NAMES = [part.split()[0] for part in ALIGNED.split(", ")]


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """A byte-level vocabulary of a ``tokenizers`` file; special tokens in a text are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already share the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        tokens: list[bytes] = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.tokens = pa.array(tokens, pa.binary())

    def ids(self, texts: list[str]) -> pa.ListArray:
        """Ids of texts that begin with a blank."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return pa.array([e.ids for e in found], pa.list_(pa.int32()))


class Pieces:
    """A ``sentencepiece`` model, which puts the leading space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.tokens = pa.array(tokens, pa.binary())

    def ids(self, texts: list[str]) -> pa.ListArray:
        return pa.array(self.model.encode([t[1:] for t in texts], num_threads=1), pa.list_(pa.int32()))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteLevel | Pieces:
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


@lru_cache(maxsize=4)
def lengths(path: str) -> pa.Array:
    return pc.binary_length(vocabulary(path).tokens).cast(pa.int64())


@lru_cache(maxsize=2)
def written(size: int) -> pa.Array:
    """Entry 4 i + s: the number i and the mark s that follows it."""
    return pa.array([f"{i}{mark}" for i in range(size) for mark in (",", "|", ";", "")], pa.string())


def spelled(lists: pa.ListArray, path: str) -> pa.Array:
    """The bytes that the tokens of each list spell."""
    return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, vocabulary(path).tokens.take(lists.values)), b"")


def tokens_of(parts: list[str], path: str) -> tuple[pa.ListArray, pa.Array]:
    """Ids of each part, and whether they spell it.

    Tokens do not reach over the end of a part, so parts are encoded in long runs, which are cut at the
    ends of the parts.  A part that does not end in ``SAFE`` closes its run, and the parts of a run that is not spelled
    byte for byte are encoded one by one.
    """
    raw = [p.encode("utf-8", "surrogatepass") for p in parts]
    sizes = np.array([len(r) for r in raw], np.int64)
    closes = np.array([not SAFE.search(p) for p in parts], bool)
    closes |= np.arange(1, len(parts) + 1) % RUN == 0
    closes[-1] = True
    ends = np.flatnonzero(closes) + 1
    starts = np.concatenate([[0], ends[:-1]])
    lists = vocabulary(path).ids(["".join(parts[a:b]) for a, b in zip(starts, ends, strict=True)])
    good = pc.equal(spelled(lists, path), pa.array([b"".join(raw[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary())).to_numpy(zero_copy_only=False)
    inside = np.repeat(good, ends - starts)
    flat = pc.list_flatten(lists.filter(pa.array(good)))
    upto = np.concatenate([[0], np.cumsum(lengths(path).take(flat).to_numpy())])
    bounds = np.concatenate([[0], np.cumsum(sizes[inside])])
    cuts = np.searchsorted(upto, bounds).astype(np.int32)
    if not (upto[cuts] == bounds).all():
        raise ValueError(f"a token of {path} reaches over a blank")
    found = pa.ListArray.from_arrays(pa.array(cuts), flat.cast(pa.int32()))
    alone = np.flatnonzero(~inside)
    if not len(alone):
        return found, pa.array(np.ones(len(parts), bool))
    single = vocabulary(path).ids([parts[i] for i in alone])
    exact = pc.equal(spelled(single, path), pa.array([raw[i] for i in alone], pa.binary()))
    place = np.empty(len(parts), np.int64)
    place[np.concatenate([np.flatnonzero(inside), alone])] = np.arange(len(parts))
    return pa.concat_arrays([found, single]).take(pa.array(place)), pa.concat_arrays([pa.array(np.ones(int(inside.sum()), bool)), exact]).take(pa.array(place))


def token_ends(lists: pa.ListArray, path: str, name: str) -> pa.Table:
    """``part, end, name``: for each token its part, the byte after it, and its place among all tokens.

    The ends are one cumulative sum over all tokens, less its value where the token's part begins.
    """
    flat, part = pc.list_flatten(lists), pc.list_parent_indices(lists)
    upto = pc.cumulative_sum(lengths(path).take(flat))
    before = pa.array(np.concatenate([[0], upto.to_numpy()])[lists.offsets.to_numpy()[:-1]])
    return pa.table({"part": part, "end": pc.subtract(upto, before.take(part)), name: pa.array(np.arange(len(flat)))})


def align(parts: list[str], path_a: str, path_b: str) -> pa.Table:
    """``ok, n_a, n_b, n_groups, groups, links`` of different parts; ``links`` are numbers of pairs of ids.

    Parts that are not ``ok`` have no tokens here.
    """
    (all_a, ok_a), (all_b, ok_b) = tokens_of(parts, path_a), tokens_of(parts, path_b)
    ok = pc.and_(ok_a, ok_b)
    none = pa.scalar([], pa.list_(pa.int32()))
    a, b = pc.if_else(ok, all_a, none), pc.if_else(ok, all_b, none)
    ids_a, ids_b = pc.list_flatten(a), pc.list_flatten(b)
    # all ends of both sides in order: between two of them one token of each side goes on
    ends = token_ends(a, path_a, "i").join(token_ends(b, path_b, "j"), ["part", "end"], join_type="full outer", use_threads=False)
    ends = ends.sort_by([("part", "ascending"), ("end", "ascending")]).combine_chunks()
    i, j, part = (ends.column(name).combine_chunks() for name in ("i", "j", "part"))
    at_a, at_b, part = i.is_valid().to_numpy(zero_copy_only=False), j.is_valid().to_numpy(zero_copy_only=False), part.to_numpy()
    shared = at_a & at_b
    links = pc.add(pc.multiply(ids_a.take(pc.fill_null_backward(i)).cast(pa.int64()), SECOND), ids_b.take(pc.fill_null_backward(j)).cast(pa.int64()))
    per_part = np.searchsorted(part, np.arange(len(parts) + 1)).astype(np.int32)
    # groups as text: numbers of the first side, a bar, numbers of the second, a semicolon unless the part ends
    group = np.cumsum(shared) - shared
    last = np.ones(len(part), bool)
    last[:-1] = part[1:] != part[:-1]
    mark_a, mark_b = np.where(shared[at_a], 1, 0), np.where(shared[at_b], np.where(last[at_b], 3, 2), 0)
    entry = np.empty(len(ids_a) + len(ids_b), np.int64)
    entry[np.arange(len(ids_a)) + np.searchsorted(group[at_b], group[at_a], "left")] = 4 * ids_a.to_numpy().astype(np.int64) + mark_a
    entry[np.arange(len(ids_b)) + np.searchsorted(group[at_a], group[at_b], "right")] = 4 * ids_b.to_numpy().astype(np.int64) + mark_b
    numbers = written(max(len(vocabulary(path_a).tokens), len(vocabulary(path_b).tokens)))
    sizes_a, sizes_b = pc.list_value_length(a).to_numpy(), pc.list_value_length(b).to_numpy()
    places = np.concatenate([[0], np.cumsum(sizes_a + sizes_b)]).astype(np.int32)
    return pa.table({
        "ok": ok, "n_a": sizes_a.astype(np.int64), "n_b": sizes_b.astype(np.int64), "n_groups": np.bincount(part[shared], minlength=len(parts)),
        "groups": pc.binary_join(pa.ListArray.from_arrays(pa.array(places), numbers.take(pa.array(entry))), ""),
        "links": pa.ListArray.from_arrays(pa.array(per_part), links),
    })


def align_texts(texts: list[str], path_a: str, path_b: str) -> list[pa.Array]:
    """The columns of ``ALIGNED`` for texts without nulls.

    A text is cut before blanks that follow a letter, a digit or a stop, but for those at its end.  Neither tokenizer has tokens over such a
    place, so both end one there, and each different part need only be aligned once.
    """
    parts = [PART.split(" " + t) if t else [] for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    coded = pa.array([p for some in parts for p in some], pa.string()).dictionary_encode()
    if not len(coded.dictionary):
        return [pa.array([e] * len(texts), kind) for e, kind in zip(EMPTY, _KINDS, strict=True)]
    known = align(coded.dictionary.to_pylist(), path_a, path_b)
    code, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), sizes)
    ok = (sizes > 0) & (np.bincount(doc, ~known.column("ok").to_numpy()[code], len(texts)) == 0)
    total = lambda name: pa.array(np.where(ok, np.bincount(doc, known.column(name).to_numpy()[code], len(texts)), 0).astype(np.int64))
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(places), known.column("groups").combine_chunks().take(coded.indices)), ";")
    # different parts of a text with their numbers, then the links of those parts
    inside = pa.array(ok[doc])
    held = pa.table({"doc": doc, "code": code}).filter(inside).group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
    links = known.column("links").combine_chunks().take(held.column("code").combine_chunks())
    of = pc.list_parent_indices(links)
    pairs = pa.table({"doc": held.column("doc").take(of), "pair": pc.list_flatten(links), "times": held.column("count_all").take(of)})
    pairs = pairs.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")]).sort_by([("doc", "ascending"), ("pair", "ascending")]).combine_chunks()
    docs = pairs.column("doc").to_numpy()
    cuts = pa.array(np.searchsorted(docs, np.arange(len(texts) + 1)).astype(np.int32))
    listed = lambda name, kind: pa.ListArray.from_arrays(cuts, pairs.column(name).combine_chunks().cast(kind))
    n_links = pa.array(np.bincount(docs, pairs.column("times_sum").to_numpy(), len(texts)).astype(np.int64))
    return [total("n_a"), total("n_b"), total("n_groups"), n_links, pc.if_else(pa.array(ok), groups, ""), listed("pair", pa.int64()), listed("times_sum", pa.int32())]


def token_groups(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the columns of ``ALIGNED`` for every row.

    Both tokenizers encode a space and the text.  Byte offsets where a token of each ends cut the tokens into groups;
    ``groups`` lists their ids as ``a1,a2|b1;a3|b2``.  Links are pairs of tokens whose bytes overlap; ``pairs`` holds
    the different pairs of ids, as first id times 2^32 plus second, and ``times`` how often each occurs.  A text that is
    null or empty, or that one of the vocabularies does not spell byte for byte, has no tokens: zeros and empty values.
    """
    kind = docs.schema[key].dataType.simpleString()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            upto = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):
                # as many texts as fit a step, one at least
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *align_texts(texts[at:end], path_a, path_b)], ["key", *_NAMES])
                at = end

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(aligned, f"key {kind}, {ALIGNED}").withColumnRenamed("key", key)


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, pair, n`` of the documents in a task's batches; passed on whenever ``HELD`` pairs are gathered."""
    held: pa.Table | None = None
    for batch in batches:
        pairs = batch.column("pairs")
        flat = pa.table({"block": batch.column("block").take(pc.list_parent_indices(pairs)), "pair": pc.list_flatten(pairs)})
        new = flat.group_by(["block", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["block", "pair", "n"])
        held = new if held is None else pa.concat_tables([held, new]).group_by(["block", "pair"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["block", "pair", "n"])
        if held.num_rows > HELD:
            yield from held.to_batches()
            held = None
    if held is not None:
        yield from held.to_batches()


def alignment_counts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row; see ``token_groups``.

    The count of a pair of ids is the number of rows that hold it linked; ``count_sum`` adds it up over the links of
    a row, ``n_best`` counts the links whose pair has the largest count of its first id, ties included.

    Pairs are counted in Arrow per task and merged by Spark; their totals go back to the blocks in which they occur, so a
    pair of nearly every document travels once per block.  There are at most as many totals as pairs of ids, whatever the
    input.  Null keys and repeated rows are rows of their own; other columns are not read; no rows give none.
    """
    blocks = Blocks.of_splits(docs.select(key, text))
    try:
        with settings(docs.sparkSession, CO_LOCATED):
            found = token_groups(docs, path_a, path_b, key, text)
            digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
            facts = [F.col(key).alias("key"), "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256")]
            rows = blocks.write(found.select(*blocks.place(), *facts, "pairs", "times"))
            counted = rows.select("block", "pairs").mapInArrow(partial_counts, "block long, pair long, n long")
            counted = cut(counted.groupBy("block", "pair").agg(F.sum("n").alias("n")))
            totals = cut(counted.groupBy("pair").agg(F.sum("n").alias("f")).withColumn("a", F.shiftright("pair", 32)))
            best = totals.groupBy("a").agg(F.max("f").alias("most"))
            judged = totals.join(best, "a").select("pair", "f", (F.col("f") == F.col("most")).alias("best"))
            asked = blocks.to_blocks(counted.select("block", "pair").join(judged, "pair"))
            links = rows.select("block", "seg", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
            valued = links.join(asked.hint("shuffle_hash"), ["block", "pair"])
            sums = valued.groupBy("block", "seg").agg(F.sum(F.col("times") * F.col("f")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
            whole = rows.drop("pairs", "times").join(sums.hint("shuffle_hash"), ["block", "seg"], "left")
            zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
            out = whole.select("key", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
            return cut(out).withColumnRenamed("key", key)
    finally:
        blocks.close()
