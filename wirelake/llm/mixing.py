"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import WORD
from wirelake.scale import number_rows, running_sum
from wirelake.session import cut

#: A slot's block has about so many tokens.
BLOCK_TOKENS = 4096
#: Sources get the weights 1, 2, 3, 1, ... in the order of their names, null last.
CYCLE = 3


def targets_of(sources: DataFrame, limit: float = 3.0) -> DataFrame:
    """Water filling: ``target = min(limit * source_size, level * weight)`` with targets summing to all sizes.

    ``sources`` has ``source, source_size, weight``.  The excess of sources at their limit is shared
    again by weight until none is above; in closed form, sources are capped in the order of
    ``limit * size / weight``, and the level follows from what is left.  A table of one row per source;
    a source is a few hundred bytes, and only running sums over the ratio order are taken, in blocks.
    """
    ratio = F.col("source_size") * F.lit(limit) / F.col("weight")
    real = sources.filter("source_size > 0").withColumn("_ratio", ratio).withColumn("_one", F.lit(1))
    order = [F.col("_ratio").asc(), F.col("source").asc_nulls_last()]
    run = running_sum(real, "_one", order, F.col("weight").cast("double"), "_weights")
    run = cut(running_sum(run, "_one", order, F.col("source_size") * F.lit(limit), "_caps"))
    whole, weights = run.agg(F.sum("source_size").cast("double"), F.sum(F.col("weight").cast("double"))).first()
    # before source i (in ratio order) is decided, what is left over what weight is left
    level = (F.lit(whole) - (F.col("_caps") - F.col("source_size") * limit)) / (F.lit(weights) - (F.col("_weights") - F.col("weight")))
    free = run.withColumn("_level", level).filter(F.col("_ratio") >= F.col("_level") * (1 - 1e-12))
    final = free.agg(F.min_by("_level", "_weights")).first()[0]
    target = F.col("source_size") * F.lit(limit)
    if final is not None:
        target = F.least(target, F.col("weight") * F.lit(final))
    done = run.select("source", target.alias("target"))
    joined = sources.alias("s").join(done.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left")
    return joined.select("s.source", "source_size", "weight", F.coalesce("target", F.lit(0.0)).alias("target"))


def weigh_sources(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight``: one row per source, weights 1, 2, 3 in turn by name, null last.

    Names are ordered by UTF-8 bytes, which is the order of code points.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1))
    ranked = number_rows(per, "_one", [F.col("source").asc_nulls_last()], "_rn")
    return ranked.select("source", "source_size", ((F.col("_rn") - 1) % CYCLE + 1).alias("weight"))


def _reverse_bits(number: Column, bits: int) -> Column:
    """The van der Corput map on ``bits`` bits: digit string of ``number`` in base two, reversed."""
    return F.conv(F.reverse(F.lpad(F.bin(number), bits, "0")), 2, 10).cast("bigint") if bits else F.lit(0).cast("bigint")


def schedule(targets: DataFrame, block_tokens: int = BLOCK_TOKENS, most_per_row: int = 4096) -> DataFrame:
    """``position, source, slot, slots``: which source each of N = 2^k places of the mix draws from.

    Place i has the van der Corput point of i.  On 2^k places these points are the grid j / 2^k in
    another order, so the points that fall into a source's share of the cumulative weights number
    exactly its share: a source gets ``slots`` of them, at least one.  ``slot`` is the rank of a place
    among its source's places, from 0.  The places of a source are evenly spread at every prefix.
    """
    live = targets.filter("target > 0").withColumn("_one", F.lit(1))
    total = live.agg(F.sum("target"), F.count(F.lit(1))).first()
    if not total[1]:
        return targets.sparkSession.createDataFrame([], "position bigint, source string, slot bigint, slots bigint")
    # at least one slot a source: room for half the places, the rest by weight
    bits = max(0, int(max(total[0] / block_tokens, 2 * total[1]) - 1).bit_length())
    places = 1 << bits
    # cumulative share, a floor of one place each: place bounds are rounded sums, so they add up exactly
    share = F.lit(1.0) + F.col("target") * F.lit((places - total[1]) / total[0])
    bound = running_sum(live, "_one", [F.col("source").asc_nulls_last()], share, "_upto")
    last = F.least(F.round("_upto"), F.lit(float(places))).cast("bigint")
    ends = cut(bound.select("source", (F.round(F.col("_upto") - share)).cast("bigint").alias("_lo"), last.alias("_hi")))
    # no row makes more than most_per_row places; a large source is split before it is spread
    parts = ends.select("source", "_lo", "_hi", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1, F.lit(most_per_row))).alias("_at"))
    parts = parts.repartition(F.col("source"), F.col("_at"))
    grid = parts.select("source", (F.col("_hi") - F.col("_lo")).alias("slots"),
                        F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + most_per_row, F.col("_hi")) - 1)).alias("_j"))
    places_of = grid.select("source", "slots", _reverse_bits(F.col("_j"), bits).alias("position"))
    ranked = number_rows(places_of, "source", [F.col("position")], "_rank")
    return ranked.select("position", "source", (F.col("_rank") - 1).alias("slot"), "slots")


def mix_documents(rows: DataFrame, limit: float = 3.0, block_tokens: int = BLOCK_TOKENS, seed: int = 8) -> tuple[DataFrame, DataFrame]:
    """``(sized, pieces)``: rows with ``source_size, target``, and the pieces of them that the mix takes.

    ``rows`` has ``row_id`` (unique), ``doc_id``, ``source`` and ``size``; other columns are not read.
    A source's documents are put in an order that looks random (a keyed hash of ``doc_id``; ties by
    ``doc_id``, then ``row_id``) and laid end to end, again and again until its target is full.  That
    line is cut into ``slots`` blocks of equal length, which the schedule's slots draw in turn.  Each
    piece is ``row_id, position, source, slot, pass, offset, length``: at ``position`` of the mix stand
    ``length`` words of the row from its word ``offset``, for the ``pass``-th time.

    A source takes floor(target) words, so a row gives floor or ceil of target / source size passes,
    the last one in part: at most ``limit`` times its size, as a target is at most ``limit`` times its
    source.  Null sizes count as 0; rows of size 0 are never taken.  Null sources form one source.
    Repeated rows are separate documents.  No rows: both results are empty.
    """
    base = rows.select("row_id", "doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size"))
    targets = cut(targets_of(weigh_sources(base.select("source", "size")), limit))
    order = [F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id").asc_nulls_last(), F.col("row_id")]
    line = running_sum(base.filter("size > 0"), "source", order, F.col("size"), "_end")
    sized = line.withColumn("start", F.col("_end") - F.col("size")).drop("_end")
    sized = sized.unionByName(base.filter("size = 0").withColumn("start", F.lit(None).cast("bigint")))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    sized = cut(sized.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    slots = cut(schedule(targets, block_tokens))
    counts = slots.groupBy("source").agg(F.max("slots").alias("slots")).withColumnRenamed("source", "_s")
    passes = F.explode(F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1)).alias("pass")
    laid = (
        sized.filter("size > 0 AND target >= 1").select("row_id", "source", "start", "size", "source_size", F.floor("target").alias("_take"), passes)
        .withColumn("_from", F.col("pass") * F.col("source_size") + F.col("start"))
        .withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_take")))
        .filter("_from < _to")
        .join(counts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    )
    # block k of a line covers [k * take div slots, (k + 1) * take div slots)
    edge = lambda k: F.floor(k.cast("decimal(38,0)") * F.col("_take") / F.col("slots"))
    near = lambda x: F.floor(x.cast("decimal(38,0)") * F.col("slots") / F.col("_take")).cast("bigint")
    cutting = laid.withColumn("slot", F.explode(F.sequence(near(F.col("_from")), F.least(near(F.col("_to") - 1) + 1, F.col("slots") - 1))))
    low, high = F.greatest(F.col("_from"), edge(F.col("slot")).cast("bigint")), F.least(F.col("_to"), edge(F.col("slot") + 1).cast("bigint"))
    pieces = cutting.select("row_id", "source", "slot", "pass", (low - F.col("_from")).alias("offset"), (high - low).alias("length")).filter("length > 0")
    placed = slots.select(F.col("source").alias("_s"), F.col("slot").alias("_k"), "position")
    return sized, pieces.join(placed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slot") == F.col("_k"))).drop("_s", "_k")


def taken_words(rows: DataFrame, **options) -> DataFrame:
    """``row_id, doc_id, source, size, source_size, target, taken``: how many words the mix takes from each row."""
    sized, pieces = mix_documents(rows, **options)
    sums = pieces.groupBy("row_id").agg(F.sum("length").alias("taken"))
    joined = sized.join(sums, "row_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("bigint"))
    return joined.select("row_id", "doc_id", "source", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each pass over a document, a text cut short for a pass in part.

    The last pass over a document may cover a run of its words only; that row holds these words with
    the white space between them.  A pass over all words holds the whole text unchanged.
    """
    held = cut(docs.withColumn("__row_id", F.monotonically_increasing_id()))
    rows = held.select(F.col("__row_id").alias("row_id"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    _, pieces = mix_documents(rows, **options)
    passes = pieces.groupBy("row_id", "pass").agg(F.min("offset").alias("first"), F.sum("length").alias("words"))
    kept = passes.select(F.struct(F.col("row_id"), F.col("first"), F.col("words")).alias("__take"))
    joined = held.join(kept, F.col("__row_id") == F.col("__take.row_id"))
    # parts: each word with the white space after it, after a part of white space where the text begins with it
    parts = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    before = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    run = F.array_join(F.slice(parts, (F.col("__take.first") + before + 1).cast("int"), F.col("__take.words").cast("int")), "")
    text = F.when(F.col("__take.words") == word_count(F.col("text")), F.col("text")).otherwise(run)
    return joined.withColumn("text", text).select(*docs.columns)


def word_count(text: Column) -> Column:
    """Number of words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
