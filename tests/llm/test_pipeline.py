"""The pipeline on the smallest tables: each stage against a plain version on its own input."""

import collections

import corpus_pipeline
from test_small_cases import plain_near

from wirelake.session import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF))
        seen[name] = (before.collect(), docs.collect())
        if name != "pack":
            assert docs.columns == columns
    before, after = seen["toxicity"]
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    labelled = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(gone & labelled - bad) <= 2 and all(r in before for r in after)
    before, after = seen["line_dedup"]
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in after)
    every = collections.Counter(x.strip(" ").lower() for r in after for x in r["text"].split("\n") if len(x.strip(" ")) >= 20)
    assert max(every.values()) == 1
    before, after = seen["near_dedup"]
    want = plain_near([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, _, c in want if i == c)
    before, after = seen["mix_sources"]
    size = sum(len(r["text"].split()) for r in before)
    assert abs(sum(len(r["text"].split()) for r in after) - size) <= 20
    before, after = seen["pack"]
    assert collections.Counter(r["doc_id"] for r in after if r["piece"] == 0) == collections.Counter(r["doc_id"] for r in before)
