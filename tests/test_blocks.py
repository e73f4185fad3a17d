"""Rankings by blocks hold what rankings by joins hold, and make no row for each query and document."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.functions.text import spaced, tokens
from siftline.operators import blocks, retrieval

WORDS = ["cat", "cats", "running", "run", "dog", "tree", "house", "blue", "k8s", "sky high", "x", "y"]


def corpus(spark, n=400):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b"]), k, " ".join(rng.choices(WORDS[: rng.randint(2, len(WORDS))], k=rng.randint(0, 12)))) for k in range(n)]
    rows += [("a", 1000 + k, rows[0][2] + " tree") for k in range(60)]  # equal scores, ranked by id
    rows += [("b", 2000, "dog"), ("b", 2000, "house blue dog"), (None, 7, "dog cat"), ("c", 8, "")]  # keys that repeat, no section, no word
    docs = spark.createDataFrame(rows, "section string, doc_id long, text string")
    return docs.withColumn("tokens", tokens(F.col("text"), stopwords=(), synonyms=None)).repartition(3)


def queries(spark):
    asked = spark.createDataFrame([("p", "cat dog dog"), ("q", "running tree x y"), ("r", "absent"), ("s", "dog cat run blue house")], "query_id string, text string")
    return asked.withColumn("tokens", tokens(F.col("text"), stopwords=(), synonyms=None))


def ranks(df):
    return {(r.query_id, r.section, r.rank): (r.doc_id, round(r.score, 9)) for r in df.collect()}


@pytest.mark.parametrize("stem", [False, True])
@pytest.mark.parametrize("pad", [False, True])
def test_bm25_ranked_equals_joins(spark, monkeypatch, stem, pad):
    docs = corpus(spark)
    joined = retrieval.ranked(retrieval.bm25_scores(docs, queries(spark), stem=stem, pad=9 if pad else None), 9)
    monkeypatch.setattr(blocks, "WIDTH", 3)
    monkeypatch.setattr(blocks, "RANK_ROWS", 50)
    got, want = ranks(retrieval.bm25_ranked(docs, queries(spark), 9, stem=stem, pad=pad)), ranks(joined)
    assert got == want


def test_keywords_ranked_equals_joins(spark):
    docs = corpus(spark).where("section is not null")
    asked = spark.createDataFrame([("p", "dog", 2), ("p", "sky high", 1), ("p", "kubernetes", 3), ("q", "tree house", 1), ("q", "x", 0), ("r", "absent", 4)], "query_id string, keyword string, freq int")
    got, want = (ranks(df) for df in (retrieval.keywords_ranked(docs, asked, 9), retrieval.ranked(retrieval.keyword_channel(docs, asked), 9)))
    assert got == want and got
    marks = spark.createDataFrame([("p", "c++", 1), ("p", "dog", 1)], "query_id string, keyword string, freq int")
    assert ranks(retrieval.keywords_ranked(docs, marks, 9)) == ranks(retrieval.ranked(retrieval.keyword_channel(docs, marks), 9))


def test_no_shuffle_by_query_and_document(spark):
    docs, asked = corpus(spark).where("doc_id <> 2000"), queries(spark)
    keywords = asked.select("query_id", F.explode("tokens").alias("keyword"), F.lit(1).alias("freq"))
    for ranking in (retrieval.bm25_ranked(docs, asked, 9), retrieval.keywords_ranked(docs, keywords, 9)):
        plan = ranking._jdf.queryExecution().toString()
        assert "hashpartitioning(query_id" in plan and "MapInArrow" in plan
        assert not [x for x in plan.split("hashpartitioning(query_id")[1:] if "doc_id" in x.split(")")[0]]


def test_texts_parted_in_tasks_equal_tokens(spark):
    texts = ["Cat  dog-Run", "", " \t lead and trail\n", "İstanbul ΟΔΟΣ straße", "a b c　d\u0085e​f g", "x\x1cy z\x1fq", "--", None]
    docs = spark.createDataFrame([("a", k, t) for k, t in enumerate(texts)], "section string, doc_id long, text string").coalesce(1)
    docs = docs.withColumns({"tokens": tokens(F.col("text"), stopwords=(), synonyms=None), "spaced": spaced(F.col("text"))})
    for some in (docs, docs.where("doc_id <> 5")):
        table = some.orderBy("doc_id").select("tokens", "spaced").toArrow()
        assert blocks.spaced_words(table["spaced"].combine_chunks()).to_pylist() == table["tokens"].to_pylist()
    assert blocks.spaced_words(pa.array([None, "a b"])).to_pylist() == [[], ["a", "b"]]
    got, want = (ranks(retrieval.bm25_ranked(corpus(spark).withColumn("spaced", spaced(F.col("text"))), queries(spark), 9, spaced=s)) for s in ("spaced", None))
    assert got == want and got


def test_a_batch_without_asked_words_has_no_section():
    assert list(blocks.by_section(pa.array(["a", None]), np.zeros(0, np.int64))) == []
    assert [(s, m.tolist()) for s, m in blocks.by_section(pa.array(["a", None]), np.array([0, 1, 1]))] in ([("a", [0]), (None, [1, 2])], [(None, [1, 2]), ("a", [0])])
