import os
import sys

import pyarrow.parquet as pq

import corpus_pipeline
from wattframe.llm import op08_jaccard, op09_quality
from wattframe.operators.storage import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    start, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stored(stage(spark, docs, SF), "stage")
        assert new.columns == start.columns, name
        seen.append((docs, new))
        docs = new
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    (a, b), (c, d), (e, f), (g, h) = seen
    assert all(known.get(i) != 0 for i in ids(b)) and len([i for i in ids(a) - ids(b) if known.get(i) == 1]) <= 2
    groups = {r.doc_id: r.component_id for r in op08_jaccard.near_duplicates(c).collect()}
    assert ids(d) == set(groups.values())
    assert ids(f) == ids(e)
    assert ids(h) <= ids(g)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == ids(docs)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
