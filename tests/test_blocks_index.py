"""The index's postings are packed by term, and its ranking by blocks is that of its scores."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import retrieval
from siftline.sources.segments import SegmentIndex

from .test_blocks import corpus, queries, ranks


@pytest.mark.parametrize("stem", [False, True])
def test_index_ranking_equals_its_scores(spark, tmp_path, stem):
    docs = corpus(spark).where("section is not null").drop("tokens")
    index = SegmentIndex(spark, f"file://{tmp_path}/i", stem=stem, buckets=2)
    index.sync(docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, "old cat").otherwise(F.col("text"))))
    index.sync(docs.where("doc_id % 7 <> 0"))
    segment = index.state()[1]["segments"][0]
    packed, rows = index.log.read(segment["postings"]), index._live({"segments": [segment | {"gone": []}]}, "postings")
    assert packed.count() * 5 < rows.count()
    for pad in (False, True):
        want = ranks(retrieval.ranked(index.scores(queries(spark), pad=9 if pad else None), 9))
        assert ranks(index.ranked(queries(spark), 9, pad=pad)) == want and want
