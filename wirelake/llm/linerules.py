"""Quality rules, lines first: failing lines go, then documents that lose too much text with them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import slices

# The characters and phrases that the rules look for.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»›•·"
STOPS = ".!?…。！？؟।"
CLOSERS = "\"'”’»)]"
NAVIGATION = [
    "home", "menu", "main menu", "navigation", "search", "sitemap", "contact", "contact us", "about us", "login", "log in",
    "sign in", "sign up", "register", "next", "next page", "previous", "previous page", "back", "back to top", "top", "read more",
    "show more", "load more", "skip to content", "share this page", "print this page", "startseite", "anmelden", "weiterlesen",
    "nach oben", "accueil", "connexion", "lire la suite", "haut de page", "inicio", "iniciar sesión", "leer más", "volver arriba",
]
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy",
    "uses cookies", "use of cookies", "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum",
    "subscribe to our newsletter", "copyright ©", "licensed under the", "alle rechte vorbehalten", "datenschutzerklärung",
    "tous droits réservés", "politique de confidentialité", "todos los derechos reservados", "política de privacidad",
]

#: Base rules: a text needs so many words, and at most this percentage of them in repeated windows of this length.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A line fails with more symbols than this percentage of its words.
SYMBOL_PERCENT = 30
#: A line is navigation with at least so many separators, if they are at least this percentage of its words.
LEAST_SEPARATORS, SEPARATOR_PERCENT = 2, 20
#: A document goes when its failing lines hold more than this percentage of its word characters.
LOST_PERCENT = 30

_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
STOPPED = set(STOPS)
_MENU = re.compile("(?:" + "|".join(map(re.escape, NAVIGATION)) + r")[\x20.:!>»›]*$")

RULES = ("punctuation", "navigation", "boilerplate", "repeated")
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
MORE = ", ".join(f"n_{rule} long" for rule in RULES) + ", lost_chars long, kept boolean, clean_text string"


def number_of(text: str, some: str) -> int:
    """How many characters of ``text`` are among ``some``."""
    return sum(map(text.count, some))


def repeated_words(words: list) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more, the first one included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    starts = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : i + len(windows)] |= starts
    return int(covered.sum())


def line_fault(line: str, low: str, words: int, seen: bool, phrases: list[str]) -> str | None:
    """The first rule that a line (without outer blanks, with ``words`` words) breaks, if any."""
    if any(phrase in low for phrase in phrases):
        return "boilerplate"
    separators = number_of(line, SEPARATORS)
    if (separators >= LEAST_SEPARATORS and 100 * separators >= SEPARATOR_PERCENT * words) or _MENU.match(low):
        return "navigation"
    if line.rstrip(CLOSERS)[-1:] not in STOPPED or 100 * number_of(line, SYMBOLS) > SYMBOL_PERCENT * words:
        return "punctuation"
    return "repeated" if seen else None


def judge(text: str) -> tuple:
    """The values of ``BASE`` and ``MORE`` for one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    lowered = raw.lower().decode("utf-8", "surrogatepass")  # bytes have lower case for A-Z only
    words, chars = raw.split(), len(text) - number_of(text, _BLANKS)
    phrases = [phrase for phrase in BOILERPLATE if phrase in lowered]
    found, seen, stay = Counter(), set(), []
    lost = filled = 0
    for whole, low, some in zip(text.split("\n"), lowered.split("\n"), raw.split(b"\n"), strict=True):
        line, n = whole.strip(_BLANKS), len(some.split())
        if not n:
            stay.append(whole)
            continue
        filled += 1
        fault = line_fault(line, low.strip(_BLANKS), n, whole in seen, phrases)
        seen.add(whole)
        if fault:
            found[fault] += 1
            lost += len(line) - number_of(line, _BLANKS)
        else:
            stay.append(whole)
    again = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * again > REPEAT_PERCENT * len(words)
    kept = not failed and 100 * lost <= LOST_PERCENT * chars
    return (len(words), chars, number_of(text, SYMBOLS), filled - len(seen), again, failed, *(found[r] for r in RULES), lost, kept, "\n".join(stay))


def cleaned_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the counts of the base rules, the faults of the lines, ``kept`` and ``clean_text`` for every row.

    Each line with a word is judged: known phrases (boilerplate), separators or a menu entry (navigation), no
    stop at its end or too many symbols (punctuation), equal to an earlier line of the text (repeated); it counts
    for the first of these.  Failing lines are left out of ``clean_text``.  A document is not kept when it
    fails a base rule or when the failing lines hold more than ``LOST_PERCENT`` of its word characters.

    One pass over the rows without a shuffle; a task holds a few hundred texts.  A null text counts as empty:
    no words, so it fails the base rules, and its ``clean_text`` is null.  Null keys and repeated rows stay rows
    of their own; columns other than ``key`` and ``text`` are not read; no rows give none.
    """
    schema = f"{BASE}, {MORE}"
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            rows = [judge(t or "")[:-1] + (None,) if t is None else judge(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], kind) for kind in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", *names])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(judged, f"key {kind}, {schema}")
    return out.withColumnRenamed("key", key)


def oracle(table: str = "documents") -> str:
    """The same counts and verdicts in DuckDB SQL."""
    quoted = lambda some: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in some) + "]"
    klass = lambda some: "".join("\\" + c if c in "]\\^-" else c for c in some).replace("'", "''")
    count = lambda text, some: f"(length({text}) - length(regexp_replace({text}, '[{klass(some)}]', '', 'g')))"
    blank = r"[\x20\x09-\x0D]"
    words = lambda text: f"len(list_filter(regexp_split_to_array({text}, '{blank}+'), lambda x: x <> ''))"
    lower = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    menu = "|".join(re.sub(r"([.\\])", r"\\\1", x) for x in NAVIGATION)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {table}),
raw AS (SELECT rid, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM docs),
lines AS (
  SELECT *, {words('line')} AS words, length(regexp_replace(line, '{blank}', '', 'g')) AS chars, {lower} AS low,
    {count('line', SEPARATORS)} AS separators, {count('line', SYMBOLS)} AS symbols,
    row_number() OVER (PARTITION BY rid, raw ORDER BY no) > 1 AS seen
  FROM (SELECT *, regexp_replace(raw, '^{blank}+|{blank}+$', '', 'g') AS line FROM raw) WHERE line <> ''),
faults AS (
  SELECT *, CASE
    WHEN len(list_filter({quoted(BOILERPLATE)}, lambda x: contains(low, x))) > 0 THEN 'boilerplate'
    WHEN (separators >= {LEAST_SEPARATORS} AND 100 * separators >= {SEPARATOR_PERCENT} * words) OR regexp_full_match(low, '({menu})[ .:!>»›]*') THEN 'navigation'
    WHEN NOT regexp_matches(line, '[{klass(STOPS)}][{klass(CLOSERS)}]*$') OR 100 * symbols > {SYMBOL_PERCENT} * words THEN 'punctuation'
    WHEN seen THEN 'repeated' END AS fault
  FROM lines),
per_doc AS (
  SELECT rid, sum(seen::int) AS dups, {", ".join(f"sum((coalesce(fault, '') = '{r}')::int) AS {r}" for r in RULES)},
    sum(CASE WHEN fault IS NOT NULL THEN chars ELSE 0 END) AS lost
  FROM faults GROUP BY rid),
split AS (SELECT rid, list_filter(regexp_split_to_array(text, '{blank}+'), lambda x: x <> '') AS w FROM docs),
windows AS (
  SELECT rid, pos, w[pos:pos + {WINDOW - 1}] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS pos FROM split WHERE len(w) >= {WINDOW})),
repeats AS (
  SELECT rid, count(DISTINCT pos + i) AS n FROM (
    SELECT rid, pos, unnest(range(0, {WINDOW})) AS i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS times FROM windows) WHERE times > 1)
  GROUP BY rid),
base AS (
  SELECT d.rid, d.doc_id, len(s.w) AS n_words, length(regexp_replace(d.text, '{blank}', '', 'g')) AS word_chars, {count('d.text', SYMBOLS)} AS n_symbols,
    coalesce(p.dups, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, {", ".join(f"coalesce(p.{r}, 0) AS n_{r}" for r in RULES)}, coalesce(p.lost, 0) AS lost_chars
  FROM docs d JOIN split s USING (rid) LEFT JOIN per_doc p USING (rid) LEFT JOIN repeats r USING (rid)),
failed AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, {", ".join(f"{c}::BIGINT AS {c}" for c in ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f"n_{r}" for r in RULES], "lost_chars"])},
  base_failed, NOT base_failed AND 100 * lost_chars <= {LOST_PERCENT} * word_chars AS kept
FROM failed"""
