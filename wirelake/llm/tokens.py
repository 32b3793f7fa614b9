"""Tokenizing whole texts in tasks with a file of a public tokenizer."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

def public_file(name: str) -> str:
    """Where a file of the public tokenizers lies; the path is a parameter of every operator that needs one."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Stops that are taken off a word before it is looked up.
STOPS = (b".", b",")


class WordTokenizer:
    """Ids of texts by ``word_bpe_49k.json`` or a file like it, looked up by blank-separated pieces.

    The tokenizer drops white space before it merges, so the ids of a text are the ids of its pieces
    between ASCII blanks, one after the other, and each different piece need only be tokenized once.
    What is remembered is dropped whenever it holds ``most`` pieces, which bounds the memory.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        self.path, self.most = path, most
        tokenizer = _tokenizer(path)
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, i in tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.bounds = np.zeros(1 << 12, np.int64)  # ids of piece i lie in bounds[i] .. bounds[i + 1]

    def _add(self, pieces: list[bytes], lengths: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.code)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(pieces) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(pieces)] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.code.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _learn(self, pieces: list[bytes]) -> None:
        # a stop after a letter is a word of its own to the tokenizer, so "word." has the ids of "word" and of "."
        ended = [p for p in pieces if p[-1:] in STOPS and p[-2:-1].isalpha()]
        if not ended:
            self._learn_words(pieces)
            return
        apart = set(ended)
        words = [p[:-1] for p in ended]
        known = dict.fromkeys([p for p in pieces if p not in apart] + words + list(STOPS))
        self._learn_words([p for p in known if p not in self.code])
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        ids, length = self._gather(codes)
        stops = np.array([self.ids[self.bounds[self.code[stop]]] for stop in STOPS])
        at = np.cumsum(length + 1) - 1
        out = np.empty(len(ids) + len(ended), np.uint32)
        inner = np.ones(len(out), bool)
        inner[at] = False
        out[inner], out[at] = ids, stops[[STOPS.index(p[-1:]) for p in ended]]
        self._add(ended, length + 1, out)

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces by their codes, one after the other, and how many each has."""
        first, length = self.bounds[codes], self.bounds[codes + 1] - self.bounds[codes]
        upto = np.cumsum(length)
        at = np.repeat(first - (upto - length), length) + np.arange(upto[-1] if len(upto) else 0)
        return self.ids[at], length

    def _learn_words(self, pieces: list[bytes]) -> None:
        tokenizer = _tokenizer(self.path)
        texts = [p.decode("utf-8", "surrogatepass") for p in pieces]
        # a piece of letters is one word to the tokenizer, so its ids end at the first end-of-word id
        letters = [t.lower().isalpha() for t in texts]
        plain = [i for i, whole in enumerate(letters) if whole]
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join([texts[i] for i in some])], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("the tokenizer does not end each word with an end-of-word token")
            self._add([pieces[i] for i in some], np.diff(stops, prepend=0), ids)
        other = [i for i, whole in enumerate(letters) if not whole]
        for at in range(0, len(other), 2000):
            some = other[at : at + 2000]
            ids = [e.ids for e in tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)]
            self._add([pieces[i] for i in some], np.array([len(x) for x in ids]), np.array([i for x in ids for i in x], np.uint32))

    @staticmethod
    def pieces(text: str | None) -> list[bytes]:
        if not text:
            return []
        raw = text.encode("utf-8", "surrogatepass")
        # lower case early unless a combining mark follows, which could compose with one case only
        return (raw if b"\xcc" in raw or b"\xcd" in raw else raw.lower()).split()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none), without special tokens."""
        split = [self.pieces(t) for t in texts]
        every = [p for pieces in split for p in pieces]
        if len(self.code) > self.most:
            self._forget()
        new = [p for p in dict.fromkeys(every) if p not in self.code]
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.code.__getitem__, every), np.int64, len(every))
        ids, length = self._gather(codes)
        upto = np.cumsum(length)
        ends = np.concatenate([[0], upto])[np.cumsum([0] + [len(p) for p in split])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """The one of this worker process, with what earlier tasks have learnt; the ids do not depend on that."""
    return WordTokenizer(path)


def plain_ids(path: str, text: str | None) -> list[int]:
    """Ids by the tokenizer on the whole text at once: the plain version for tests."""
    return _tokenizer(path).encode(text or "", add_special_tokens=False).ids
