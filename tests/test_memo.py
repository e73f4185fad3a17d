"""Selections kept by fingerprint, and selection over the index."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from siftline.plans import memo, selecting
from siftline.plans.config import Settings
from siftline.sources.segments import SegmentIndex

S = Settings(use_reranker=False)


def corpus(spark):
    rows = [("experience", f"e{k}", k // 2, k % 2, t, f"20{10 + k // 2}-01") for k, t in enumerate(["Python and Kafka pipelines", "Spark SQL tuning", "Docker images", "Java services", "Kafka streams", "Excel sheets"])]
    return spark.createDataFrame(rows + [("skills", "s0", 0, 0, "Tools: Docker, Kafka", None)], "section string, doc_id string, entry_index int, slot_index int, text string, start_date string")


def queries(spark, *texts):
    return spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "query_id string, text string")


def entries(df):
    return sorted((r.query_id, r.section, r.entry_index, r.position, r.included, tuple(r.shown)) for r in df.collect())


def test_index_gives_the_selection_of_the_corpus(spark, tmp_path):
    index = SegmentIndex(spark, f"file://{tmp_path}/i", stem=S.use_stemming, buckets=2)
    index.sync(corpus(spark))
    asked = queries(spark, "Requirements: Kafka, Python and docker. No se requiere Excel.")
    assert entries(selecting.select(None, asked, S, index=index).entries) == entries(selecting.select(corpus(spark), asked, S).entries)


def light(asked):
    """A selection that takes no time: an entry a query, named by its text's length, and its words as keywords."""

    def select(corpus, queries, settings=None, index=None, **how):
        assert index is not None
        asked.append(queries.count())
        own = queries.select("query_id", F.lit("experience").alias("section"), F.length("text").alias("entry_index"), F.lit(0).alias("position"), F.lit(True).alias("included"), F.array(F.lit(settings.max_highlights)).alias("shown"))
        return SimpleNamespace(entries=own, flat=own.drop("shown").withColumn("section", F.lit("skills")), keywords=queries.select("query_id", F.explode(F.split("text", " ")).alias("keyword")))

    return select


def test_known_queries_are_not_selected_again(spark, tmp_path, monkeypatch):
    index = SegmentIndex(spark, f"file://{tmp_path}/i", stem=S.use_stemming, buckets=2)
    index.sync(corpus(spark))
    asked: list[int] = []
    monkeypatch.setattr(selecting, "select", light(asked))
    store = memo.SelectionMemo(spark, f"file://{tmp_path}/m", hours=1)
    first = store.select(index, queries(spark, "kafka streams", "java", "kafka streams"), S, now=1000.0)
    want = [("q0", "experience", 13, 0, True, (4,)), ("q1", "experience", 4, 0, True, (4,)), ("q2", "experience", 13, 0, True, (4,))]
    assert first.new == 2 and entries(first.entries) == [(*w[:5], (S.max_highlights,)) for w in want]
    assert sorted((r.query_id, r.keyword) for r in first.keywords.collect()) == [("q0", "kafka"), ("q0", "streams"), ("q1", "java"), ("q2", "kafka"), ("q2", "streams")]
    again = store.select(index, queries(spark, "kafka streams", "java", "kafka streams"), S, now=1100.0)
    assert again.new == 0 and asked == [2] and entries(again.entries) == entries(first.entries)
    assert str(tmp_path / "i") not in again.entries._jdf.queryExecution().toString()  # neither corpus nor index is read
    assert store.select(index, queries(spark, "java", "docker"), S, now=3000.0).new == 1 and asked == [2, 1]
    assert store.select(index, queries(spark, "java"), S, now=1000.0 + 3600).new == 1  # its time is up, that of "docker" isn't
    assert store.expire(now=1000.0 + 3601) == 1 and store.select(index, queries(spark, "docker"), S, now=4700.0).new == 0
    assert store.select(index, queries(spark, "docker"), Settings(use_reranker=False, max_highlights=1), now=4700.0).new == 1
    index.sync(corpus(spark).where("doc_id <> 'e0'"))
    assert store.select(index, queries(spark, "docker"), S, now=4700.0).new == 1  # the index has changed


def test_first_of_two_writers_stays(spark, tmp_path, monkeypatch):
    index = SegmentIndex(spark, f"file://{tmp_path}/i", stem=S.use_stemming, buckets=2)
    index.sync(corpus(spark))
    mine, other = (memo.SelectionMemo(spark, f"file://{tmp_path}/m", hours=0) for _ in range(2))
    plain = light([])

    def slow(*args, **how):  # the other writer is through before this one
        monkeypatch.setattr(selecting, "select", plain)
        other.select(index, queries(spark, "kafka"), S, now=7.0)
        return plain(*args, **how)

    monkeypatch.setattr(selecting, "select", slow)
    kept = mine.select(index, queries(spark, "kafka"), S, now=9.0)
    assert [r.at for r in mine.tables.read("done").collect()] == [7.0] and len(entries(kept.entries)) == 1


def test_no_queries(spark, tmp_path):
    index = SegmentIndex(spark, f"file://{tmp_path}/i", stem=S.use_stemming, buckets=2)
    index.sync(corpus(spark))
    with pytest.raises(ValueError, match="nothing"):
        memo.SelectionMemo(spark, f"file://{tmp_path}/m").select(index, queries(spark, "x").where("false"), S)
