"""Places over a whole frame, the choice of a summary, progress of a review."""

import random

import pandas as pd
from pyspark.sql import functions as F

from siftline.operators import history, importer, selection
from siftline.operators.places import placed


def test_places_of_a_large_frame_equal_those_of_one_task(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 5)) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, n int").repartition(3)
    want = {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    for one_task in (10, 1000):
        assert {r.id: r.place for r in placed(df, [F.col("n").desc(), F.col("id")], one_task=one_task).collect()} == want
    assert placed(df.where("false"), [F.col("id")]).collect() == []


def test_variants_in_order(spark):
    stats = spark.createDataFrame([("b", 2, 1), ("a", 2, 1), ("c", 2, 2), ("d", 9, 0)], "text string, runs int, successful_runs int")
    assert [r.text for r in history.ordered_variants(stats).orderBy("place").collect()] == ["d", "c", "a", "b"]


def test_summary_pick(spark):
    queries = spark.createDataFrame([("q", "x", ["running", "spark"]), ("z", "y", ["nothing"])], "query_id string, query_text string, tokens array<string>")
    texts = spark.createDataFrame([(0, "aaaa", ["spark", "spark"]), (1, "bb", ["run", "spark"]), (2, "c", ["run", "spark"])], "index int, text string, tokens array<string>")
    pick = lambda *a, **k: {r.query_id: (r["index"], r.mode) for r in selection.summary_pick(*a, **k).collect()}
    assert pick(texts, queries) == {"q": (0, "positional_fallback"), "z": (0, "positional_fallback")}
    assert pick(texts, queries, stem=True) == {"q": (1, "positional_fallback"), "z": (0, "positional_fallback")}
    assert pick(texts, queries, lambda q, t: -t.str.len().astype(float)) == {"q": (2, "cross_encoder"), "z": (2, "cross_encoder")}
    assert pick(texts, queries, lambda q, t: pd.Series([0.0] * len(t))) == {"q": (0, "cross_encoder"), "z": (0, "cross_encoder")}
    assert pick(texts.where("index = 2"), queries) == {"q": (2, "single_option"), "z": (2, "single_option")}
    assert pick(texts.where("false"), queries) == {"q": (None, "none"), "z": (None, "none")}


def test_progress_counts_the_bullets_alone(spark):
    states = spark.createDataFrame([("a", "1", "done"), ("a", "2", "pending"), ("b", "1", "done")], "session_id string, cluster_id string, status string")
    got = lambda df: {r.session_id: (r.reviewed, r.total) for r in df.collect()}
    assert got(importer.progress(states)) == {"a": (1, 3), "b": (1, 2)}
    orphans = spark.createDataFrame([("b", True), ("c", False)], "session_id string, done boolean")
    assert got(importer.progress(states, orphans)) == {"a": (1, 3), "b": (2, 1), "c": (0, 1)}
