"""Vector, word and mixed search, re-ranking and recommendations.

Queries come as a table and are all answered in one job.  ``vectors``: ``vec_id, embedding`` plus
payload columns; ``queries``: ``query_id, embedding``.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.functions import electrical as el
from wirelake.functions import text as tx
from wirelake.operators.filters import Filter, apply_filters, literal_map
from wirelake.operators.tiles import tiled_topk
from wirelake.scale import top_rows
from wirelake.session import cut


def _unit(column) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _cosine(min_score: float | None, same: bool = False):
    def score(lp, rp):
        s = _unit(lp["embedding"]) @ _unit(rp["embedding"]).T
        if min_score is not None:
            s = np.where(np.round(s, 6) >= min_score, s, -np.inf)
        if same:
            s = np.where(lp["query_id"].to_numpy()[:, None] == rp["vec_id"].to_numpy()[None, :], -np.inf, s)
        return s

    return score


def _types(queries: DataFrame, vectors: DataFrame) -> tuple[str, str]:
    return dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["vec_id"]


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"left_id": "query_id", "right_id": "vec_id"})


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, min_score: float | None = None, filters: list[Filter] = (), exclude_self: bool = False) -> DataFrame:
    """Exact ``k`` nearest vectors by cosine; equal scores are ordered by id."""
    kept = apply_filters(vectors, list(filters)) if filters else vectors
    return _named(tiled_topk(queries.select("query_id", "embedding"), kept.select("vec_id", "embedding"), [], k, _cosine(min_score, exclude_self),
                             left_id="query_id", right_id="vec_id", left_size=8192, right_size=8192, id_types=_types(queries, vectors)))


def similar_items(ids: DataFrame, vectors: DataFrame, k: int, chunk_type: str, min_score: float | None = None) -> DataFrame:
    """Nearest other items of the same type for each item id (``vec_id``)."""
    asked = vectors.join(ids.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding", chunk_type)
    return _named(tiled_topk(asked, vectors.select("vec_id", "embedding", chunk_type), [chunk_type], k, _cosine(min_score, True),
                             left_id="query_id", right_id="vec_id", left_size=8192, right_size=8192, id_types=_types(asked, vectors)))


def multi_collection_topk(queries: DataFrame, vectors: DataFrame, k: int, collection: str) -> DataFrame:
    """The ``k`` nearest of every collection for every query."""
    names = vectors.select(collection).distinct().agg(F.collect_set(collection).alias("_names")).withColumn("_g", F.lit(1))
    asked = queries.withColumn("_g", F.lit(1)).join(F.broadcast(names), "_g").select("query_id", "embedding", F.explode("_names").alias(collection))
    asked = asked.withColumn("_key", F.concat_ws("|", F.col(collection).cast("string"), F.col("query_id").cast("string")))
    hits = tiled_topk(asked, vectors.select("vec_id", "embedding", collection), [collection], k, _cosine(None), left_id="_key", right_id="vec_id",
                      left_size=8192, right_size=8192, id_types=("string", dict(vectors.dtypes)["vec_id"]))
    q, v = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)[collection]
    part = F.split("left_id", r"\|", 2)
    return hits.select(part.getItem(1).cast(q).alias("query_id"), part.getItem(0).cast(v).alias(collection), F.col("right_id").alias("vec_id"), "score", "rank")


# ---- words -----------------------------------------------------------------------------------


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def inverted_index(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``term, doc, tf`` over the whole texts."""
    return docs.select(F.col(doc).alias("doc_id"), F.explode(terms_of(F.col(text))).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def prefix_terms(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``asked, term, df``: for each different ``asked`` the terms that begin with it.

    The dictionary is sorted into ranges of terms; a prefix goes to the ranges it can begin in, from the first term it begins
    to the last, and finds its terms there as one stretch of the sorted terms.  No prefix of a term is written down.
    """
    parts = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dictionary = cut(vocabulary.repartitionByRange(parts, "term").select("term", "df", F.spark_partition_id().alias("range")))
    ranges = dictionary.groupBy("range").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    meets = (F.col("high") >= F.col("asked")) & ((F.col("low") <= F.col("asked")) | F.startswith("low", F.col("asked")))
    sent = cut(asked.select("asked").distinct().join(F.broadcast(ranges), meets).select("range", "asked"))  # one row per partition

    def stretch(words: pa.Table, terms: pa.Table) -> pa.Table:
        # bytes are ordered as Spark orders strings
        raw = sorted(zip((t.encode() for t in terms.column("term").to_pylist()), range(terms.num_rows), strict=True))
        keys, place = [t for t, _ in raw], np.array([i for _, i in raw], np.int64)
        found = []
        for i, word in enumerate(words.column("asked").to_pylist()):
            low, high = bisect.bisect_left(keys, word.encode()), bisect.bisect_left(keys, word.encode() + b"\xff")
            found.append((np.full(high - low, i), place[low:high]))
        own, other = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (list(zip(*found, strict=True)) or [(), ()]))
        hit = terms.take(pa.array(other, pa.int64()))
        return pa.table({"asked": words.column("asked").take(pa.array(own, pa.int64())), "term": hit.column("term"), "df": hit.column("df")})

    return sent.groupBy("range").cogroup(dictionary.groupBy("range")).applyInArrow(stretch, "asked string, term string, df long")


def sparse_search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Documents in which every query term is the start of some word, best first.

    ``queries``: ``query_id, text``; score: sum over the matched words of ``tf * ln(1 + N / df)``.  Candidates
    come from the query term with the fewest postings alone; only their words are then compared with the other terms, so the
    postings of frequent terms are read for few documents.
    """
    asked = cut(queries.select("query_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("asked")))
    index = cut(index)
    total = index.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("_total")).withColumn("_g", F.lit(1))
    words = cut(prefix_terms(asked, index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))))
    reach = words.groupBy("asked").agg(F.sum("df").alias("postings"))
    # a query with a term that no word begins with has no answer
    sized = asked.join(reach, "asked", "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_need"), F.count("postings").alias("_met"), F.min(F.struct("postings", "asked")).alias("rarest"))
    open_ = cut(sized.filter("_need = _met").select("query_id", "_need", F.col("rarest.asked").alias("asked")))
    candidates = cut(open_.select("query_id", "asked").join(words.select("asked", "term"), "asked").join(index.select("term", "doc_id"), "term").select("query_id", "doc_id").distinct())
    terms = asked.join(open_.select("query_id"), "query_id", "left_semi").join(words, "asked")
    hits = candidates.join(index, "doc_id").join(terms, ["query_id", "term"]).withColumn("_g", F.lit(1)).join(F.broadcast(total), "_g")  # one row
    per_term = hits.groupBy("query_id", "doc_id", "asked").agg(F.sum(F.col("tf") * F.log1p(F.col("_total") / F.col("df"))).alias("s"))
    scored = per_term.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("_have"), F.round(F.sum("s"), 6).alias("score")).join(open_.select("query_id", "_need"), "query_id").filter("_have = _need")
    return top_rows(scored.select("query_id", "doc_id", "score"), "query_id", [F.col("score").desc(), F.col("doc_id")], k)


def keyword_score(queries: DataFrame, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Share of the query's words that occur anywhere in the text, for every pair above zero.

    A word without blanks occurs in a text when it is inside one of its words, so words are
    matched against the distinct words, found by their first three characters.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tx.words_of(F.lower("text")))).alias("w"))
    size = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    postings = docs.select(F.col(doc).alias("doc_id"), F.explode(F.array_distinct(tx.words_of(F.lower(F.col(text))))).alias("token"))

    def starts(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - n + 1, F.lit(1))), lambda i: F.substr(F.col("token"), i, F.lit(n)))

    tokens = postings.select("token").distinct().select("token", F.explode(F.array_distinct(F.concat(starts(1), starts(2), starts(3)))).alias("g"))
    found = asked.select("w").distinct().withColumn("g", F.substr(F.col("w"), F.lit(1), F.lit(3))).join(tokens, "g").filter(F.contains("token", F.col("w"))).select("w", "token")
    word_docs = found.join(postings, "token").select("w", "doc_id").distinct()
    return asked.join(word_docs, "w").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("_m")).join(size, "query_id").select(
        "query_id", "doc_id", (F.col("_m") / F.col("_n")).alias("score"))


# ---- fusion and re-ranking -------------------------------------------------------------------


def hybrid_fuse(dense: DataFrame, sparse: DataFrame, wd: float = 0.6, ws: float = 0.4) -> DataFrame:
    d = dense.select("query_id", "doc_id", F.col("score").alias("_d"))
    s = sparse.select("query_id", "doc_id", F.col("score").alias("_s"))
    both = d.join(s, ["query_id", "doc_id"], "full")
    source = F.when(F.col("_d").isNotNull() & F.col("_s").isNotNull(), "hybrid").when(F.col("_d").isNotNull(), "dense").otherwise("sparse")
    zero = F.lit(0.0)
    return both.select("query_id", "doc_id", (F.coalesce("_d", zero) * wd + F.coalesce("_s", zero) * ws).alias("score"), source.alias("source"))


#: Words that count when query and text share them.
DOMAIN_TERMS = ["relay", "fuse", "ecu", "starter", "fuel", "ignition", "ground"]


def boost_rerank(hits: DataFrame, k: int, terms: list[str] = DOMAIN_TERMS, min_hits: int = 20) -> DataFrame:
    """Boost shared domain terms x1.2, named components x1.5 and nets x1.3 for queries with more
    than ``min_hits`` hits; others keep their scores.

    ``hits``: ``query_id, query, doc_id, text, score, component_ids, net_names``.
    """
    q, t = F.lower("query"), F.lower("text")
    factor = F.lit(1.0)
    for term in terms:
        factor = factor * F.when(F.contains(q, F.lit(term)) & F.contains(t, F.lit(term)), 1.2).otherwise(1.0)

    def named(column: str, by: float) -> Column:
        return F.pow(F.lit(by), F.size(F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda c: F.contains(q, F.lower(c)))))

    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_c"))
    boosted = hits.join(counts, "query_id").withColumn("boost", F.when(F.col("_c") > min_hits, factor * named("component_ids", 1.5) * named("net_names", 1.3)).otherwise(1.0))
    scored = boosted.select("query_id", "doc_id", F.col("score").alias("original_score"), "boost", F.round(F.col("score") * F.col("boost"), 6).alias("score"))
    return top_rows(scored, "query_id", [F.col("score").desc(), F.col("doc_id")], k)


def boost_results(hits: DataFrame, exact: float = 2.0, vehicle: float = 1.2) -> DataFrame:
    """``hits``: ``score, component_type, vehicle_signature, component_types (array), asked_vehicle``."""
    kind = F.when(F.array_contains("component_types", F.col("component_type")), exact).otherwise(1.0)
    same = F.when(F.col("asked_vehicle") == F.col("vehicle_signature"), vehicle).otherwise(1.0)
    return hits.withColumn("score", F.col("score") * kind * same)


def doc_rerank(hits: DataFrame) -> DataFrame:
    """``hits``: ``query_id, query, doc_id, document_type, score``; the boosted score stays below 1."""
    q, d = F.lower("query"), F.col("document_type")

    def asks(word: str, kind: str) -> Column:
        return F.contains(q, F.lit(word)) & (d == kind)

    boost = (F.when(asks("troubleshoot", "troubleshooting"), 1.2).when(asks("wiring", "wiring_diagram"), 1.2).when(asks("repair", "repair_guide"), 1.1)
             .when(asks("install", "installation_guide"), 1.1).otherwise(1.0))
    return hits.withColumn("score", F.least(F.lit(1.0), F.col("score") * boost))


def search_documents(queries: DataFrame, chunks: DataFrame, k: int, document_types: list[str] | None = None, models: list[str] | None = None, components: list[str] | None = None) -> DataFrame:
    """Vector search over chunks that are of a type, for a model, or about a component asked for."""
    kept = chunks
    if document_types:
        kept = kept.filter(F.col("document_type").isin(document_types))
    for column, values in (("vehicle_models", models), ("component_types", components)):
        if values:
            kept = kept.filter(F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])))
    return cosine_topk(queries, kept, k)


def search_components(queries: DataFrame, components: DataFrame, k: int) -> DataFrame:
    """Word search over name, type, maker and part number."""
    docs = components.select("id", F.concat_ws(" ", "name", "type", "manufacturer", "part_number").alias("text"))
    return sparse_search(queries, inverted_index(docs, "id", "text"), k)


def search_knowledge(queries: DataFrame, posts: DataFrame, k: int, make: str) -> DataFrame:
    return cosine_topk(queries, posts, k, filters=[Filter("make", "eq", make)])


def chat_context(queries: DataFrame, components: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """Best components and best chunks per query as rows, with the follow-up questions of the intent.

    ``queries``: ``query_id, text, embedding``; both collections: ``vec_id, embedding``.
    """
    parts = cosine_topk(queries, components, k).withColumn("source", F.lit("component")).unionByName(cosine_topk(queries, chunks, k).withColumn("source", F.lit("chunk")))
    facets = tx.query_facets(queries.select("query_id", "text"), "text")
    asks = facets.select("query_id", "intent", F.array_join(tx.follow_ups(F.col("intent"), F.try_element_at("component_types", F.lit(1))), "; ").alias("follow_ups"))
    return parts.join(asks, "query_id")


# ---- recommendations -------------------------------------------------------------------------

#: Share of the similarity limit that applies to a kind, and its weight in the ranking.
KIND_LIMIT = {"similar": 1.0, "compatible": 0.8, "alternative": 0.7, "related": 0.6}
KIND_WEIGHT = {"similar": 1.0, "compatible": 0.9, "alternative": 0.8, "related": 0.7}


def recommend(items: DataFrame, kinds: list[str], k: int, threshold: float = 0.6) -> DataFrame:
    """Recommendations for every item, one row per item, kind and candidate.

    ``items``: ``vec_id, embedding, vehicle_signature, type, zone, manufacturer, voltage_rating,
    current_rating, function, circuit, subsystem, categories``.  Candidates are the nearest that pass
    the filter of the kind; their score is the similarity or the formula of the kind.
    """
    attributes = [c for c in items.columns if c not in {"vec_id", "embedding"}]
    out = None
    for kind in kinds:
        out_kind = _candidates(items, kind, k, threshold * KIND_LIMIT[kind])
        out = out_kind if out is None else out.unionByName(out_kind)
    a = items.select(F.col("vec_id").alias("id"), F.struct(*attributes).alias("a"))
    b = items.select(F.col("vec_id").alias("candidate_id"), F.struct(*attributes).alias("b"))
    x, y = F.col("a"), F.col("b")
    score = (F.when(F.col("kind") == "similar", F.col("similarity")).when(F.col("kind") == "compatible", el.electrical_score(x, y))
             .when(F.col("kind") == "alternative", el.functional_score(x, y)).otherwise(el.relation_score(x, y)))
    return out.join(a, "id").join(b, "candidate_id").select(
        "id", "candidate_id", "kind", score.alias("score"), (x["manufacturer"] == y["manufacturer"]).alias("same_maker"))


def _candidates(items: DataFrame, kind: str, k: int, limit: float) -> DataFrame:
    group = {"similar": [], "compatible": ["vehicle_signature"], "alternative": ["type", "zone"], "related": ["vehicle_signature"]}[kind]
    cosine = _cosine(limit, True)

    def score(lp, rp):
        s = cosine(lp, rp)
        if kind == "compatible":
            v, w = lp["voltage_rating"].to_numpy(float)[:, None], rp["voltage_rating"].to_numpy(float)[None, :]
            s = np.where(np.isnan(v) | (np.abs(w - v) <= np.abs(v) * 0.2), s, -np.inf)
        if kind == "alternative":
            s = np.where(lp["manufacturer"].to_numpy(object)[:, None] != rp["manufacturer"].to_numpy(object)[None, :], s, -np.inf)
        return s

    columns = ["embedding", "vehicle_signature", "type", "zone", "manufacturer", "voltage_rating"]
    left = items.select(F.col("vec_id").alias("query_id"), *columns)
    id_type = dict(items.dtypes)["vec_id"]
    hits = tiled_topk(left, items.select("vec_id", *columns), group, k, score, left_id="query_id", right_id="vec_id", left_size=8192, right_size=8192, id_types=(id_type, id_type))
    return hits.select(F.col("left_id").alias("id"), F.col("right_id").alias("candidate_id"), F.lit(kind).alias("kind"), F.col("score").alias("similarity"))


def rank_recommendations(recs: DataFrame) -> DataFrame:
    """Best row per candidate, weighted by kind and maker, at most 1."""
    best = top_rows(recs, ["id", "candidate_id"], [F.col("score").desc(), F.col("kind")], 1).drop("rank")
    weight = F.coalesce(F.try_element_at(literal_map(KIND_WEIGHT), F.col("kind")), F.lit(0.5)) * F.when(F.col("same_maker"), 1.1).otherwise(1.0)
    return best.withColumn("score", F.least(F.lit(1.0), F.col("score") * weight))


def embed_missing(texts: DataFrame, cache: DataFrame, dim: int = 64) -> DataFrame:
    """``id, text`` -> ``id, embedding``: each distinct text is embedded once, known ones not at all.

    ``cache``: ``hash, embedding``.  An empty text has the zero vector.
    """
    keyed = texts.select("id", "text", tx.content_hash(F.col("text")).alias("hash"))
    fresh = keyed.select("hash", "text").dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti").select("hash", tx.hash_embedding(F.col("text"), dim).alias("embedding"))
    return keyed.select("id", "hash").join(cache.select("hash", "embedding").unionByName(fresh), "hash").select("id", "embedding")
