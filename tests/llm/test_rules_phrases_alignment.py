"""Line rules, phrase mining and token alignment against plain versions on small tables with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from wirelake.llm import alignment, linerules, phrases
from wirelake.llm.blocks import CO_LOCATED, block_keys, settings
from wirelake.llm.tokens import public_file

DOCS = "doc_id long, text string, source string, lang string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BYTES, PIECES = public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model")


def clashing(df):
    for name in ("n", "f", "id", "a", "b", "at", "own", "seg", "block", "row", "words", "owned", "part", "pair", "pairs", "times", "key", "kept", "phrase", "groups"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", lang) for i, t, lang in rows], DOCS)


# ------------------------------------------------------------------ line rules


def faults(text):
    row = dict(zip([p.split()[0] for p in f"{linerules.BASE}, {linerules.MORE}".split(", ")], linerules.judge(text), strict=True))
    return row


@pytest.mark.parametrize(
    ("line", "rule"),
    [("A whole sentence ends with a stop.", None), ("„So“ said the man (twice).”", None), ("A heading without one", "punctuation"), ("Too ### many $$$ of *** them %%%.", "punctuation"),
     ("Home | About | Contact | News.", "navigation"), ("Read More >>", "navigation"), ("Back to top.", "navigation"), ("Copyright © 2020 by them. All Rights Reserved.", "boilerplate"),
     ("This text is licensed under the Public Licence.", "boilerplate"), ("終わりです。", None), ("A word | a bar in a rather long sentence of many words.", None)],
)
def test_line_rules(line, rule):
    row = faults(f"A first sentence stays here, as it should.\n{line}\n")
    assert {r: row[f"n_{r}"] for r in linerules.RULES if row[f"n_{r}"]} == ({rule: 1} if rule else {})
    assert (line in row["clean_text"]) == (rule is None) and "A first sentence" in row["clean_text"]


def plain_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)})


def test_repeated_words_are_counted_once():
    rng = random.Random(4)
    for _ in range(60):
        words = [rng.choice("ab") for _ in range(rng.randrange(0, 40))]
        assert linerules.repeated_words(words) == plain_repeats(words)


def test_cleaned_documents(spark):
    good = "This is the first of a few plain sentences that say something.\nAnother line follows it, and it ends well too."
    menu = "Home | News | Sport | Weather | Contact\nNext | Previous | Top | Menu\nOne sentence is left over here."
    rows = [(1, good, "en"), (2, menu, "en"), (3, None, None), (4, "", "en"), (5, " \t\n\x0b ", "en"), (None, good, "en"), (1, good, "en"),
            (6, LONG + ".", "en"), (7, "a b c d e " * 20, "en"), (8, "Gleich.\nGleich.\n" + good, "de"), (9, "\x85  x y.", "fr"), (10, "é" * 50 + ".", "fr")]
    docs = docs_of(spark, rows)
    out = linerules.cleaned_documents(clashing(docs)).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) and sum(r["doc_id"] == 1 for r in out) == 2
    assert by[1]["kept"] and by[1]["clean_text"] == good and by[6]["kept"] and not by[2]["kept"] and by[2]["n_navigation"] == 2
    assert by[3]["clean_text"] is None and by[3]["n_words"] == 0 and by[3]["base_failed"] and not by[4]["kept"]
    assert by[7]["n_repeat_words"] == 100 and by[7]["base_failed"] and by[8]["n_dup_lines"] == by[8]["n_repeated"] == 1
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    names = [c for c in linerules.cleaned_documents(docs).columns if c != "clean_text"]
    wanted = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({linerules.oracle()})").fetchall(), key=str)
    assert sorted((tuple(r[c] for c in names) for r in out), key=str) == wanted


# ------------------------------------------------------------------ phrases


def plain_phrases(rows, least, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                covered |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= 50 * f[p[i : i + k]]}
        found = []
        for p, a in candidates.items():
            if p not in covered:
                cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases(spark, monkeypatch, longest):
    monkeypatch.setattr(phrases, "LONG", 400)
    monkeypatch.setattr(phrases, "SLICE", 16)
    rng = random.Random(longest)
    rows = []
    for i in range(60):
        words = [rng.choice(["The", "cat", "sat", "on", "a", "mat", "Ünd", "x"]) + rng.choice(["", "", "", ",", ".", "\n", "  ", "\t", "\x0b"]) for _ in range(rng.randrange(0, 80))]
        rows.append((i, " ".join(words) + rng.choice(["", " ", "\n"]), rng.choice(["en", "de", None])))
    rows += [(100, " . the cat sat " * 200, "en"), (101, "hot pair " * 900, "en"), (101, "hot pair " * 900, "en"), (None, "a mat", "en"), (102, None, "en"), (103, "", None), (104, "und", "und")]
    docs = clashing(docs_of(spark, rows)).repartition(3)
    got = phrases.collocations(docs, least=5, longest=longest, top=30).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, 5, longest, 30)


def test_phrases_leave_no_tables_and_settings(spark):
    before = {key: spark.conf.get(key) for key in CO_LOCATED}
    docs = docs_of(spark, [(1, "a b " * 20, "en")])
    assert phrases.collocations(docs).count() == 2
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("wirelake_")] and {key: spark.conf.get(key) for key in CO_LOCATED} == before
    assert phrases.collocations(docs.limit(0)).count() == 0 and phrases.collocations(docs_of(spark, [(1, None, None)])).count() == 0
    with pytest.raises(ValueError), settings(spark, {"spark.sql.shuffle.partitions": "5"}):
        raise ValueError
    assert spark.conf.get("spark.sql.shuffle.partitions") != "5"


def test_blocks_fill_their_buckets(spark):
    keys = block_keys(spark, 7)
    buckets = spark.createDataFrame([(k,) for k in keys], "k long").select(F.pmod(F.hash("k"), F.lit(7))).collect()
    assert sorted(r[0] for r in buckets) == list(range(7))


# ------------------------------------------------------------------ alignment


def plain_alignment(rows):
    first, second = alignment.vocabulary(BYTES), alignment.vocabulary(PIECES)
    bytes_a, bytes_b = first.tokens.to_pylist(), second.tokens.to_pylist()
    facts, count = [], Counter()
    for doc, text in rows:
        a = first.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.model.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[i] for i in a) != raw or b"".join(bytes_b[i] for i in b) != raw:
            facts.append((doc, 0, 0, [], []))
            continue
        spans = [[], []]
        for side, ids, of in ((0, a, bytes_a), (1, b, bytes_b)):
            at = 0
            for i in ids:
                spans[side].append((at, at := at + len(of[i]), i))
        links = []
        for s, e, i in spans[0]:
            links += [(i, j) for x, y, j in spans[1] if x < e and s < y]
        groups, cuts, low = [], sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}), 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= cut) for side in spans))
            low = cut
        facts.append((doc, len(a), len(b), groups, links))
        count.update(set(links))
    best = Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return sorted(
        ((doc, na, nb, len(g), len(li), sum(count[p] == best[p[0]] for p in li), sum(count[p] for p in li), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for doc, na, nb, g, li in facts),
        key=str)


ODD_TEXTS = [
    "Plain words, and more of them.", " leading blank", "trailing blank ", "two  blanks   three", "\n\n lines \n\n  here\t\ttabs", "", None, " ", "▁ looks like a blank", "a▁b and so on",
    "<|endoftext|> <s> </s> <unk> are text", "don't we'll it's 12345 x12y", "日本語のテキスト。改行", "é ﬁ ①     \x85 \x1c \x00 end", "emoji 👩‍👩‍👧 and 🇫🇷 flags", "é ä. ́ x",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "same same same same", "UPPER lower MiXeD", "url http://a.b/c?d=e&f=g#h 50%", "(a) [b] {c} 'd' \"e\"", "﻿mark ​zero", "ﷺ ؟ العربية",
]


def test_alignment_of_odd_texts(spark):
    rows = [*enumerate(ODD_TEXTS), (None, "Plain words, and more of them."), (0, "Plain words, and more of them."), (99, " ".join(f"w{i % 97}x{i}" for i in range(600)))]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    got = alignment.alignment_counts(docs, BYTES, PIECES)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == plain_alignment(rows)
    assert alignment.alignment_counts(docs.limit(0), BYTES, PIECES).count() == 0


def test_parts_are_encoded_as_in_their_text():
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "\t", "a", "Word", "é", "1", ".", ",", "'s", "!", "▁", "(", "日", " ", "\x1c", "👩"]
    for _ in range(300):
        text = " " + "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40)))
        parts = alignment.PART.split(text)
        for path in (BYTES, PIECES):
            one, _ = alignment.tokens_of(parts, path)
            assert pc.list_flatten(one).to_pylist() == alignment.vocabulary(path).ids([text])[0].as_py()


def test_long_text(spark):
    docs = docs_of(spark, [(1, LONG * 3, "en"), (2, "short", "en")])
    groups = {r["doc_id"]: r for r in alignment.token_groups(docs, BYTES, PIECES).collect()}
    row = groups[1]
    assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"] == sum(row["times"])
    sides = [g.split("|") for g in row["groups"].split(";")]
    assert len(sides) == row["n_groups"]
    for side, path, size in ((0, BYTES, "n_a"), (1, PIECES, "n_b")):
        ids = [int(i) for s in sides for i in s[side].split(",")]
        voc = alignment.vocabulary(path).tokens.to_pylist()
        assert len(ids) == row[size] and b"".join(voc[i] for i in ids).decode() == " " + LONG * 3
