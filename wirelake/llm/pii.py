"""Surrogates for personal data: keyed, of the same kind, gender, script and format, and without collisions."""

from __future__ import annotations

import hashlib
import os
import re
import string
import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import save_array, shared_folder, slices
from wirelake.session import cut

DIGITS, HEX = string.digits, "abcdef"

# Titles by the gender they tell, and names by gender and script.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora", "Doña", "г-жа", "госпожа"],
    "m": ["Mr", "Herr", "Monsieur", "Sr", "Señor", "Don", "г-н", "господин"],
}
NAMES = {
    ("f", "latin"): ["Alice", "Bertha", "Clara", "Diana", "Emma", "Flora", "Greta", "Hannah", "Irene", "Julia", "Karin", "Laura", "Marta", "Nora", "Olga", "Paula"],
    ("m", "latin"): ["Albert", "Bruno", "Conrad", "David", "Edgar", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Lukas", "Martin", "Nico", "Oscar", "Paul"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Денис", "Иван", "Михаил", "Олег", "Павел"],
}
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "la", "me", "ni", "ro", "sa", "ti", "vel", "wen"], "cyrillic": ["ба", "ве", "ди", "го", "ла", "ме", "ни", "ро", "са", "ти"]}
ENDINGS = {("f", "latin"): "a", ("m", "latin"): "o", ("f", "cyrillic"): "а", ("m", "cyrillic"): "ов", ("", "latin"): "er", ("", "cyrillic"): "ен"}

_TITLE = "|".join(re.escape(t) for g in ("f", "m") for t in sorted(TITLES[g], key=len, reverse=True))
_UPPER = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isupper())
#: A word of a name, with combining marks; an initial keeps its dot outside.
_WORD = rf"[{_UPPER}](?:[^\W\d_]|[\u0300-\u036f])*"
#: Lower-case words that can stand before a word of a name; they are no names themselves and stay.
_PARTICLE = r"(?:(?:von und zu|(?:van|von)(?: (?:der|den|dem|de))?|de(?: (?:la|las|los))?|del|della|di|da|dos|du|ter|y|af|av|bin|bint|ibn)[ \u00a0]|d['’]|de l['’]|al-)"
#: Kinds in order of precedence: an earlier kind wins where two begin at the same place.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b)(?:\s*[=:]\s*)[\"']?(?P<secret>[A-Za-z0-9+/_-]{8,})",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "phone": r"(?<![\w+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\d-])",
}
#: What ends a name although a capital begins it: another kind, or the next title.
_OTHER = rf"{PATTERNS['email']}|{PATTERNS['access_key']}|{PATTERNS['iban']}|(?i:(?:password|passwd|pwd|token|secret|api[_-]?key)\s*[=:])"
_NEXT = rf"(?:(?<=\b[{_UPPER}])\.[ \u00a0]?|[ \u00a0]|[-'’]){_PARTICLE}?(?!{_OTHER}|(?:{_TITLE})\.?[ \u00a0]){_WORD}"
PATTERNS["name"] = rf"(?<!\w)(?P<title>{_TITLE})\.?[ \u00a0](?P<name>{_PARTICLE}?(?!{_OTHER}){_WORD}(?:{_NEXT})*)"
FINDER = re.compile("|".join(f"(?P<{kind}_>{pattern})" for kind, pattern in PATTERNS.items()))
#: What a text needs to hold anything, whatever the kind: texts without are passed by on these cheap tests.
HINT = re.compile(rf"@|\d{{3}}|\+\d|\d\.\d+\.\d|AKIA|ASIA|[A-Z]{{2}}[0-9]{{2}}|(?:{_TITLE})\.?[ \u00a0]|(?i:password|passwd|pwd|token|secret|api[_-]?key)")


#: A whole word, which can be a later mention of a name.
MENTION = re.compile(rf"(?<![\w\u0300-\u036f]){_WORD}(?![\w\u0300-\u036f])")


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    end: int
    canonical: str  # what all mentions of one entity share


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def script_of(word: str) -> str:
    return "cyrillic" if any("\u0400" <= c <= "\u04ff" for c in word) else "latin"


def entities(text: str | None) -> list[Entity]:
    """Entities of a whole text in order, without overlaps.

    Names are told by a title.  Their words count as the same names wherever the text repeats them as
    whole words in the same case, before or after; a word that is a given name once is one throughout.
    """
    if not text or not HINT.search(text):
        return []
    out, known, surfaces = [], {}, set()
    for m in FINDER.finditer(text):
        kind = m.lastgroup if m.lastgroup.endswith("_") else next(k for k, v in m.groupdict().items() if k.endswith("_") and v is not None)
        kind = kind[:-1]
        start, end = m.span("secret") if kind == "secret" else m.span()
        if kind == "name":
            gender = "f" if m["title"] in TITLES["f"] else "m"
            at = m.start("name")
            names = [w for w in re.finditer(_WORD, m["name"]) if w.start() == 0 or not m["name"][w.start() - 1].isalpha()]
            for i, w in enumerate(names):
                own = gender if i < len(names) - 1 else ""
                e = Entity(f"name:{own}:{script_of(w[0])}", at + w.start(), at + w.end(), w[0].lower())
                out.append(e)
                if e.canonical not in known or own and known[e.canonical].startswith("name::"):
                    known[e.canonical] = e.kind
                surfaces.add(w[0])
            continue
        value = text[start:end]
        if kind in ("phone", "card", "ssn"):
            canonical = re.sub(r"\D", "", value)
            if kind == "phone" and value.startswith("+"):
                canonical = "+" + canonical
        elif kind == "iban":
            canonical = value.replace(" ", "")
        else:
            canonical = value.lower() if kind == "email" else value
        out.append(Entity(kind, start, end, canonical))
    return with_mentions(text, out, known, surfaces) if known else out


def with_mentions(text: str, found: list[Entity], known: dict[str, str], surfaces: set[str]) -> list[Entity]:
    """``found`` with one kind for each name, and with the mentions of names that have no title.  Initials have none."""
    out = [replace(e, kind=known[e.canonical]) if e.kind.startswith("name:") else e for e in found]
    ends = iter([*found, Entity("", len(text), len(text), "")])
    e = next(ends)
    for m in MENTION.finditer(text):
        while e.end <= m.start() < len(text) and e.kind:
            e = next(ends)
        if m.end() <= e.start and len(m[0]) > 1 and m[0] in surfaces:
            out.append(Entity(known[m[0].lower()], m.start(), m.end(), m[0].lower()))
    return sorted(out, key=lambda e: e.start)


class Stream:
    """Numbers that follow from a key, a kind, an entity and an attempt."""

    def __init__(self, key: bytes, *parts: str):
        self.seed = hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), key=key[:64], digest_size=32).digest()
        self.block, self.buffer = 0, b""

    def below(self, n: int) -> int:
        if len(self.buffer) < 4:
            self.buffer = hashlib.blake2b(self.block.to_bytes(8, "little"), key=self.seed).digest()
            self.block += 1
        value, self.buffer = int.from_bytes(self.buffer[:4], "little"), self.buffer[4:]
        return value % n


def _like(character: str, stream: Stream, hexadecimal: bool = False) -> str:
    """Another character of the same class; marks stay."""
    if character in DIGITS:
        return DIGITS[stream.below(10)]
    if hexadecimal and character.lower() in HEX:
        new = HEX[stream.below(6)]
    elif character.isascii() and character.isalpha():
        new = string.ascii_lowercase[stream.below(26)]
    else:
        return character
    return new.upper() if character.isupper() else new


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The replacement of an entity in canonical form: same length and character classes, for names same gender and script.

    Country prefixes, the first digit of a card, key prefixes, top-level domains, and Luhn and IBAN
    check digits stay valid.  ``attempt`` picks another one after a collision.
    """
    stream = Stream(key, kind, canonical, str(attempt))
    if kind.startswith("name:"):
        _, gender, script = kind.split(":")
        listed = NAMES.get((gender, script))
        if listed and attempt == 0:
            return listed[stream.below(len(listed))].lower()
        parts = SYLLABLES[script]
        return "".join(parts[stream.below(len(parts))] for _ in range(2 + attempt // 3)) + ENDINGS[gender, script]
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        name, dot, top = domain.rpartition(".")
        return "".join(_like(c, stream) for c in local) + "@" + "".join(_like(c, stream) for c in name) + dot + top
    if kind == "ip":
        out = []
        for octet in canonical.split("."):
            low, high = {1: (0, 9), 2: (10, 99)}.get(len(octet), (100, 255))
            out.append(str(low + stream.below(high - low + 1)))
        return ".".join(out)
    if kind == "card":
        body = canonical[0] + "".join(_like(c, stream) for c in canonical[1:-1])
        last = next(d for d in DIGITS if luhn(body + d))
        if not luhn(canonical):  # keep a number that is no valid card not valid
            last = DIGITS[(int(last) + 1 + stream.below(9)) % 10]
        return body + last
    if kind == "iban":
        body = "".join(_like(c, stream) for c in canonical[4:])
        number = "".join(str(int(c, 36)) for c in body + canonical[:2] + "00")
        return canonical[:2] + f"{98 - int(number) % 97:02d}" + body
    keep = {"access_key": 4, "phone": 2 if canonical.startswith("+") else 0}.get(kind, 0)
    hexadecimal = kind == "secret" and all(c in string.hexdigits for c in canonical)
    return canonical[:keep] + "".join(_like(c, stream, hexadecimal) for c in canonical[keep:])


def dressed(kind: str, surface: str, new: str) -> str:
    """A surrogate in the format of the mention it replaces: its separators and its case."""
    if kind.startswith("name:"):
        return new.upper() if surface.isupper() and len(surface) > 1 else new[0].upper() + new[1:]
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(new.lstrip("+"))
        return "".join(next(rest) if c.isalnum() else c for c in surface)
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(surface, new, strict=True))
    return new


def entity_hash(kind: str, canonical: str) -> int:
    digest = hashlib.blake2b(f"{kind}\x00{canonical}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little")


#: Files over which the entities that needed another attempt are spread.
SHARDS = 64


class Attempts:
    """Attempts of the entities that collided, as sorted hashes mapped into memory; all others are at 0."""

    def __init__(self, folder: str):
        self.folder, self.held = folder, {}

    def of(self, kind: str, canonical: str) -> int:
        number = entity_hash(kind, canonical)
        shard = number % SHARDS
        if shard not in self.held:
            path = f"{self.folder}/hash-{shard}.npy"
            self.held[shard] = (np.load(path, mmap_mode="r"), np.load(f"{self.folder}/attempt-{shard}.npy", mmap_mode="r")) if os.path.exists(path) else None
        both = self.held[shard]
        if both is None:
            return 0
        at = int(np.searchsorted(both[0], np.uint64(number)))
        return int(both[1][at]) if at < len(both[0]) and int(both[0][at]) == number else 0


def entity_table(docs: DataFrame) -> DataFrame:
    """``kind, canonical``: each entity of the whole texts once."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            every = sorted({(e.kind, e.canonical) for text in batch.column(0).to_pylist() for e in entities(text)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in every], pa.string()), pa.array([c for _, c in every], pa.string())], ["kind", "canonical"])

    return docs.select(F.col("text").cast("string")).mapInArrow(found, "kind string, canonical string").distinct()


def resolve(table: DataFrame, key: bytes, max_rounds: int = 64) -> DataFrame:
    """``kind, canonical, attempt, surrogate``: distinct surrogates, none of which is an entity of the corpus.

    In each round an entity whose surrogate belongs to another one, or is itself a real entity, tries
    again, except the first of those that share it.  Few rows are left after the first rounds.
    """

    def drawn(rows: DataFrame) -> DataFrame:
        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = [surrogate(key, k, c, a) for k, c, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["kind", "canonical", "attempt", "surrogate"])

        return rows.mapInArrow(draw, "kind string, canonical string, attempt int, surrogate string")

    real = table.select(F.col("kind").alias("k"), F.col("canonical").alias("c"))
    now = cut(drawn(table.select("kind", "canonical", F.lit(0).alias("attempt"))))
    for _ in range(max_rounds):
        first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count(F.lit(1)).alias("n"))
        shared = first.filter("n > 1").select(F.col("kind").alias("k"), F.col("surrogate").alias("s"), F.col("first.canonical").alias("holder"))
        taken = now.join(real, (F.col("surrogate") == F.col("c")) & (F.col("kind") == F.col("k")), "left_semi").select("kind", "canonical")
        late = now.join(shared, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("s"))).filter("canonical <> holder").select("kind", "canonical")
        again = cut(taken.unionByName(late).distinct())
        if again.isEmpty():
            return now
        retry = now.join(again, ["kind", "canonical"]).select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        now = cut(now.join(again, ["kind", "canonical"], "left_anti").unionByName(drawn(retry)))
    raise RuntimeError("surrogates still collide")


def replace_entities(docs: DataFrame, key: bytes = b"surrogates") -> DataFrame:
    """``docs`` with surrogates in ``text``; adds ``n_entities`` and ``spans`` (kind, start, end in the old text, surrogate).

    Whole texts are searched.  All mentions of an entity get one surrogate in the format of the mention
    (names: those with a title, and whole words of the same case in the same text),
    different entities of a kind get different ones, and no surrogate is an entity of the corpus.  The
    names and numbers follow from ``key`` alone, apart from the attempts after collisions, which are
    kept in sorted arrays in the shared folder; no text is shuffled.
    Null texts stay null and have no entities; texts without entities are unchanged; repeated rows get
    equal results.  All columns of ``docs`` stay; result columns of the same name replace them.
    """
    folder = shared_folder(docs.sparkSession, "attempts")
    repeated = resolve(cut(entity_table(docs)), key).filter("attempt > 0")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array([entity_hash(k, c) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(SHARDS)).astype(np.int32)), pa.array(h.view(np.int64)), batch.column(2)], ["shard", "h", "attempt"])

    def save(held: pa.Table) -> pa.Table:
        h, attempt = held.column("h").to_numpy().view(np.uint64), held.column("attempt").to_numpy()
        order, shard = np.argsort(h), held.column("shard")[0].as_py()
        save_array(f"{folder}/attempt-{shard}.npy", attempt[order].astype(np.int32))
        save_array(f"{folder}/hash-{shard}.npy", h[order])
        return pa.table({"n": pa.array([len(h)], pa.int64())})

    hashed = repeated.select("kind", "canonical", "attempt").mapInArrow(keep, "shard int, h bigint, attempt int")
    hashed.groupBy("shard").applyInArrow(save, "n bigint").agg(F.sum("n")).first()

    names = [c for c in docs.columns if c not in ("n_entities", "spans")]
    shape = "struct<text string, spans array<struct<kind string, start int, end int, surrogate string>>>"

    @F.pandas_udf(shape)
    def changed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        attempts = Attempts(folder)
        for texts in parts:
            out, spans = [], []
            for text in texts:
                at, pieces, own = 0, [], []
                for e in entities(text):
                    new = dressed(e.kind, text[e.start : e.end], surrogate(key, e.kind, e.canonical, attempts.of(e.kind, e.canonical)))
                    pieces += [text[at : e.start], new]
                    own.append({"kind": e.kind.partition(":")[0], "start": e.start, "end": e.end, "surrogate": new})
                    at = e.end
                out.append("".join([*pieces, text[at:]]) if own else text)
                spans.append(own)
            yield pd.DataFrame({"text": out, "spans": spans})

    done = docs.select(*names, changed(F.col("text").cast("string")).alias("__new"))
    rest = [F.col("__new.text").alias("text") if c == "text" else F.col(c) for c in names]
    return done.select(*rest, F.size("__new.spans").cast("bigint").alias("n_entities"), F.col("__new.spans").alias("spans"))
