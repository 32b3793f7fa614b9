"""Phrases by set-oriented mining: sorted occurrence relations, merge joins, group counts and semi-joins."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.blocks import CO_LOCATED, Blocks, settings
from wirelake.scale import top_rows
from wirelake.session import cut

#: Characters that end a piece, besides the line feed.
ENDS = ".,;:!?\x0b\x0c\r"
#: A text of more characters is dealt out in slices of so many words and breaks.
LONG, SLICE = 65_536, 8_192
#: Places of a text or slice; more than it has words and breaks.
PLACES = 65_536
#: A phrase goes when a longer one around it has at least this percentage of its count.
COVERED_PERCENT = 50


def marked(text: Column) -> Column:
    """A-Z in lower case, single blanks between words, and a line feed between blanks for each end of a piece."""
    old, new = string.ascii_uppercase + "\t" + ENDS, string.ascii_lowercase + " " + "\n" * len(ENDS)
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), old, new)
    single = F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)
    return F.replace(single, F.lit("\n"), F.lit(" \n "))


def slices_of(docs: DataFrame, lang: str, text: str, overlap: int) -> DataFrame:
    """``lang, owned, words``: whole short texts, and slices of long ones that reach ``overlap`` words into the next.

    The first ``owned`` words of a slice are its own; the others are read by the next slice too.
    """
    tokens = F.split("words", " ")
    part = lambda at: F.struct(F.lit(SLICE).alias("owned"), F.concat_ws(" ", F.slice(tokens, at + 1, F.lit(SLICE + overlap))).alias("words"))
    whole = F.array(F.struct(F.lit(2**31 - 1).alias("owned"), F.col("words")))
    parts = F.when(F.length("words") <= LONG, whole).otherwise(F.transform(F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(SLICE)), part))
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), marked(F.col(text)).alias("words"))
    return rows.select("lang", F.explode(parts).alias("part")).select("lang", "part.owned", "part.words")


def word_places(texts: DataFrame) -> DataFrame:
    """``block, lang, at, own, word``: a row per word.

    ``at`` is the place in the block: the text's number and the word's.  A break takes a place, and a text has
    fewer than ``PLACES``, so words of two pieces or texts are never adjacent.
    """
    every = texts.select("block", "seg", "lang", "owned", F.posexplode(F.split("words", " ")).alias("no", "word"))
    at = (F.col("seg") * PLACES + F.col("no")).alias("at")
    return every.filter("word <> '' AND word <> '\n'").select("block", "lang", at, (F.col("no") < F.col("owned")).alias("own"), "word")


def frequent(counted: DataFrame, group: list[str], least: int) -> DataFrame:
    """``block, group, f, id, one``: the groups that occur ``least`` times in all blocks together, in each block that has them.

    ``id`` is a number of the group, and ``one`` is true in one of its rows.  A group has a row per block at most.
    """
    everywhere = Window.partitionBy(*group)
    rows = counted.withColumn("own_id", F.monotonically_increasing_id())
    rows = rows.withColumn("f", F.sum("n").over(everywhere)).withColumn("id", F.min("own_id").over(everywhere))
    return cut(rows.filter(F.col("f") >= least).select("block", *group, "f", "id", (F.col("id") == F.col("own_id")).alias("one")))


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, longest: int = 3) -> tuple[DataFrame, list[DataFrame]]:
    """``(lang, n)`` and, per length from 1, ``id, lang, phrase, last, heads, tails, f`` of all frequent phrases.

    ``heads[i]`` counts the first i + 1 words of a phrase, ``tails[i]`` the last i + 1.  Longer lengths also have
    ``a`` and ``b``, the phrases without the last and the first word.
    """
    spark = docs.sparkSession
    source = slices_of(docs, lang, text, longest - 1)
    blocks = Blocks.of_splits(source)
    try:
        with settings(spark, CO_LOCATED):
            texts = blocks.write(source.select(*blocks.place(), "lang", "owned", "words"))
            places = word_places(texts)
            counted = cut(places.filter("own").groupBy("block", "lang", "word").agg(F.count(F.lit(1)).alias("n")))
            totals = cut(counted.groupBy("lang").agg(F.sum("n").alias("n")))
            words = frequent(counted, ["lang", "word"], least)
            one = F.array(F.col("f"))
            found = [words.filter("one").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), one.alias("heads"), one.alias("tails"), "f")]
            group, occurrences = ["lang", "word"], places
            for length in range(2, longest + 1):
                # the semi-join: of the occurrences of the last length only those of frequent groups go on, by their numbers
                asked = blocks.to_blocks(words.select("block", *group, "id"))
                kept = occurrences.join(asked.hint("shuffle_hash"), ["block", *group])
                relation = blocks.write(kept.select("block", "at", "own", "id"), "at")
                blocks.drop(length - 2)
                one = relation.select("block", (F.col("at") + 1).alias("at"), F.col("id").alias("a"), "own")
                two = relation.select("block", "at", F.col("id").alias("b"))
                occurrences = one.join(two.hint("merge"), ["block", "at"]).select("block", (F.col("at") - 1).alias("at"), "own", "a", "b")
                group, number = ["a", "b"], F.count(F.lit(1))
                if length < longest:
                    counted = cut(occurrences.filter("own").groupBy("block", *group).agg(number.alias("n")))
                    words = frequent(counted, group, least)
                    groups = words.filter("one").select("id", *group, "f")
                else:  # nothing is sent back, so the counts need no blocks
                    last = occurrences.filter("own").groupBy(*group).agg(number.alias("f")).filter(F.col("f") >= least)
                    groups = last.withColumn("id", F.monotonically_increasing_id())
                found.append(cut(spelled(groups, found[-1])))
    finally:
        blocks.close()
    return totals, found


def spelled(groups: DataFrame, shorter: DataFrame) -> DataFrame:
    """The phrases of ``groups`` (``id, a, b, f``), made of the one without the last and the one without the first word."""
    head = shorter.select(F.col("id").alias("a"), "lang", "phrase", "heads")
    tail = shorter.select(F.col("id").alias("b"), "last", "tails")
    both = groups.join(head, "a").join(tail, "b")
    own = F.array(F.col("f"))
    return both.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("heads", own).alias("heads"), F.concat("tails", own).alias("tails"), "f", "a", "b")


def weakest_cut(length: int) -> Column:
    """``(score, k, l, r)`` of the cut after k words with the lowest score, the first one on ties.

    Products pass 64 bits, so they are decimals; the quotient is at most 1000000, as f is at most l and r.
    """
    score = "(1000000BD * cast(f AS decimal(15,0)) * cast(f AS decimal(15,0))) div (cast({l} AS decimal(15,0)) * cast({r} AS decimal(15,0)))"
    cuts = []
    for k in range(1, length):
        left, right = f"heads[{k - 1}]", f"tails[{length - k - 1}]"
        cuts.append(f"struct({score.format(l=left, r=right)} AS score, {k} AS k, {left} AS l, {right} AS r)")
    return F.expr(f"array_min(array({', '.join(cuts)}))")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, longest: int = 3, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of 2 to ``longest`` words of each language.

    Words lie between blanks and tabs, in pieces between ``.,;:!?`` and line ends.  A phrase is a candidate from
    ``least`` occurrences; its score is the least over its cuts of floor(1000000 a a / (l r)).  Candidates inside
    a longer one with at least ``COVERED_PERCENT`` of their count are left out; one that is a word longer decides this,
    as phrases between are at least as frequent.

    The relation of a length has a row per occurrence, by block, text and place, and is kept sorted in a bucketed
    table: it is merge-joined with itself at adjacent places, without a shuffle.  Groups are counted per block,
    the counts added up, and the numbers of frequent groups sent back to the blocks in which they occur; occurrences of
    others do not go on.  So a phrase that fills a third of the corpus travels once per block, and a long text is
    dealt out in slices.

    Null texts count as empty, a null language as ``und``; repeated rows count each; other columns are not read;
    without candidates no rows.
    """
    totals, found = mine(docs, lang, text, least, longest)
    candidates = None
    for length, phrases in enumerate(found[1:], 2):
        rows = phrases
        if length < longest:
            around = found[length].select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("around")).groupBy("id").agg(F.max("around").alias("around"))
            covered = 100 * F.coalesce("around", F.lit(0)) >= COVERED_PERCENT * F.col("f")
            rows = phrases.join(around, "id", "left").filter(~covered)
        part = rows.select("lang", "id", "phrase", F.col("f").alias("a"), weakest_cut(length).alias("cut"))
        part = part.select("lang", "id", "phrase", "a", "cut.l", "cut.r", "cut.score")
        candidates = part if candidates is None else candidates.unionByName(part)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = top_rows(candidates.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16))), ["lang", "salt"], order, top)
    best = top_rows(some.drop("rank"), ["lang"], order, top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(table: str = "documents", least: int = 10, top: int = 2000) -> str:
    """The phrases of two and three words in DuckDB SQL."""
    plain = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    score = "(1000000::HUGEINT * t.a * t.a) // ({l}::HUGEINT * {r})"
    return rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS pid, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({plain}, '[.,;:!?\x0A-\x0D]')) AS piece FROM {table})),
split AS (SELECT pid, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT pid, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS no FROM split),
runs AS (SELECT lang, w1, lead(w1) OVER q AS w2, lead(w1, 2) OVER q AS w3 FROM places WINDOW q AS (PARTITION BY pid ORDER BY no)),
f1 AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
totals AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
around AS (
  SELECT lang, w1, w2, max(a) AS most FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
two AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, x.f AS l, y.f AS r FROM f2 t
  JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w2
  LEFT JOIN around o ON o.lang = t.lang AND o.w1 = t.w1 AND o.w2 = t.w2
  WHERE t.f >= {least} AND 100 * coalesce(o.most, 0) < {COVERED_PERCENT} * t.f),
three AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.a, x.f AS l1, v.f AS r1, u.f AS l2, y.f AS r2 FROM f3 t
  JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w3
  JOIN f2 u ON u.lang = t.lang AND u.w1 = t.w1 AND u.w2 = t.w2 JOIN f2 v ON v.lang = t.lang AND v.w1 = t.w2 AND v.w2 = t.w3),
scored AS (
  SELECT lang, phrase, a, l, r, {score.format(l="l", r="r")} AS score FROM two t
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)
  FROM (SELECT *, {score.format(l="l1", r="r1")} AS s1, {score.format(l="l2", r="r2")} AS s2 FROM three t)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""
