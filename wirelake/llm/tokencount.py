"""Token counts under a unigram tokenizer, by a forward pass over a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import slices

#: The mark before each word in the pieces of the vocabulary file.
MARK = "▁"


class Pieces:
    """Pieces of a SentencePiece file with log probabilities.

    The file ranks its pieces and gives no probabilities, so a piece of rank r has probability
    1 / (r + 1) over the harmonic sum (Zipf's law).  A character in no piece counts as its UTF-8 bytes,
    each a piece that is less likely than all others.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        harmonic = math.log(sum(1 / (r + 1) for r in range(len(texts))))
        self.score = {text: -math.log(r + 1) - harmonic for r, text in enumerate(texts)}
        self.byte = -math.log(len(texts) + 1) - harmonic - 10.0
        #: all ends of pieces: a string that ends no piece needs no longer look
        self.tails = {text[i:] for text in texts for i in range(len(text))}


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def step(pieces: Pieces, text: str, at: int, score: list[float], count: list[int]) -> tuple[float, int]:
    """Best ``(score, pieces)`` of ``text[:at]`` from those of the shorter prefixes; ties take fewer pieces."""
    best, fewest = score[at - 1] + pieces.byte * len(text[at - 1].encode("utf-8", "surrogatepass")), count[at - 1] + len(text[at - 1].encode("utf-8", "surrogatepass"))
    start = at - 1
    while start >= 0:
        tail = text[start:at]
        if tail not in pieces.tails:
            break
        value = pieces.score.get(tail)
        if value is not None:
            total = score[start] + value
            if total > best or (total == best and count[start] + 1 < fewest):
                best, fewest = total, count[start] + 1
        start -= 1
    return best, fewest


def terminal_counts(pieces: Pieces, words: list[str]) -> list[int]:
    """Number of pieces of each word's best path.

    The words are inserted in a trie in sorted order, so it is built depth first and only the nodes of
    the current path are held: a node's forward score is computed when it is entered, once for all
    words below it, and a word's count is read off its terminal node.
    """
    out = [0] * len(words)
    path, score, count = "", [0.0], [0]
    for i in sorted(range(len(words)), key=words.__getitem__):
        text = MARK + words[i]
        shared = 0
        for a, b in zip(path, text, strict=False):
            if a != b:
                break
            shared += 1
        del score[shared + 1 :], count[shared + 1 :]
        for at in range(shared + 1, len(text) + 1):
            value, number = step(pieces, text, at, score, count)
            score.append(value)
            count.append(number)
        path, out[i] = text, count[-1]
    return out


def token_counts(docs: DataFrame, vocabulary: str, most: int = 500_000) -> DataFrame:
    """``doc_id, n_words, n_tokens`` for every row of ``docs`` (``doc_id``, ``text``).

    A pre-token is a word (a run without ASCII white space) of the whole text, with the mark of the
    vocabulary before it.  Each task keeps the counts of up to ``most`` pre-tokens; those it does not
    know yet go through the trie together, once per batch.  There is no shuffle.
    Null, empty and blank texts have no tokens; repeated rows repeat; other columns are not read.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = pieces_of(vocabulary), {}
        for batch in slices(batches, 1000):
            split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in batch.column(1).to_pylist()]
            every = [w for words in split for w in words]
            if len(known) > most:
                known = {}
            new = [w for w in dict.fromkeys(every) if w not in known]
            known.update(zip(new, terminal_counts(pieces, [w.decode("utf-8", "surrogatepass") for w in new]), strict=True))
            counts = np.concatenate([[0], np.cumsum(np.fromiter(map(known.__getitem__, every), np.int64, len(every)))])
            lengths = np.array([len(words) for words in split], np.int64)
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(counts[ends] - counts[ends - lengths], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(counted, "doc_id bigint, n_words bigint, n_tokens bigint")
