"""Packing token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import slices
from wirelake.llm.tokens import word_tokenizer
from wirelake.session import cut

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END_ID = 2048, 0
#: Pieces that one task packs together.
GROUP = 4096
#: A sequence filled to this share is not packed anew.
NEARLY = 0.995
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Sum-of-squares packing of one group of pieces.

    ``count[g]`` is the number of open bins with ``g`` tokens of room.  A piece goes where the sum of
    ``count[g] ** 2`` over ``g`` in 1 .. capacity - 1 is smallest afterwards; a new bin is one of the
    choices, and ties go to the tightest bin.  Full and empty bins are not counted.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room
        self.number = 0

    def place(self, size: int) -> tuple[int, int]:
        """``(bin, offset)`` of a piece of ``size`` tokens."""
        cap, count = self.capacity, self.count
        # room g -> g - size: the square of count[g] shrinks by 2 count[g] - 1, that of count[g - size] grows by 2 count + 1
        cost = 2 * (count[: cap - size + 1] - count[size:]) + 2
        cost[0] -= 2 * count[0] + 1  # an exact fit fills the bin, which is then not counted
        cost[-1] = 2 * count[cap - size] + 1 if size < cap else 0  # a new bin
        usable = count[size:] > 0
        usable[-1] = True
        at = int(np.argmin(np.where(usable, cost, np.iinfo(np.int64).max)))
        room = at + size
        if room == cap:
            chosen, self.number = self.number, self.number + 1
        else:
            chosen = self.bins[room].pop()
            count[room] -= 1
        left = room - size
        if left:
            self.bins[left].append(chosen)
            count[left] += 1
        return chosen, cap - room


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each length; long pieces first, so that short ones close the gaps."""
    bins = OpenBins(capacity)
    found, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        found[i], offset[i] = bins.place(int(lengths[i]))
    return found, offset


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each document's ids and an end id, cut into pieces of at most ``capacity``.

    ``docs`` has ``doc_id`` and ``text`` (other columns are not read); the result has ``doc_id, piece,
    start, length, ids_crc32`` and, on request, ``ids``.  Whole texts are read; a null or empty text is
    the end id alone; null ids stay; repeated rows give repeated pieces.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        for batch in slices(batches, 500):
            out: list[list] = [[] for _ in range(6)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, value in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32)), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + ([pa.list_(pa.int32())] if with_ids else [])
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=False)], names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut_up, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = 3) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every piece in one sequence, gapless from 0.

    ``pieces`` has ``length`` in 1 .. capacity; its other columns stay.  Pieces of full length are
    sequences of their own.  The others are dealt at random into groups of about ``group``; each group
    is packed by the sum-of-squares rule in one task.  What lies in sequences with more than 0.5 % of
    room then forms new groups, so the loss at the end of a group is paid by few groups.  ``rounds``
    is the number of such rounds.  No pieces: no rows.
    """
    names = pieces.columns
    numbered = cut(pieces.withColumn("__uid", F.monotonically_increasing_id()))
    whole = numbered.filter(F.col("length") == capacity)
    done = whole.select(*names, F.col("__uid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = numbered.filter(F.col("length") < capacity)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", sequence_id long, offset long, __filled long"

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__uid", ignore_index=True)  # the same result when a lost task runs again
        lengths = frame["length"].to_numpy()
        found, offset = sum_of_squares(lengths, capacity)
        # a sequence is named by its first piece; names are unique as a piece lies in one sequence
        uid = frame["__uid"].to_numpy()
        name = np.zeros(found.max() + 1, np.int64)
        name[found[offset == 0]] = uid[offset == 0]
        filled = np.bincount(found, weights=lengths).astype(np.int64)
        return frame.assign(sequence_id=name[found], offset=offset, __filled=filled[found])

    for number in range(rounds):
        groups = max(1, round(rest.count() / group))
        dealt = rest.withColumn("__group", F.pmod(F.xxhash64("__uid", F.lit(number)), F.lit(groups)))
        fitted = cut(dealt.groupBy("__group").applyInPandas(lambda key, frame: packed(frame.drop(columns="__group")), schema))
        last = number == rounds - 1
        full = fitted if last else fitted.filter(F.col("__filled") >= capacity * NEARLY)
        done = done.unionByName(full.select(*names, "sequence_id", "offset"))
        if not last:
            rest = fitted.filter(F.col("__filled") < capacity * NEARLY).drop("sequence_id", "offset", "__filled")
    return done


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack; columns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(token_pieces(docs, tokenizer, capacity), capacity)
