"""Retrieval quality against relevance judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_mrr(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Per query of qrels (query_id, doc_id): recall@k and mrr@k of ranking (query_id, doc_id, rank from 0)."""
    relevant = qrels.distinct()
    n = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = ranking.where(F.col("rank") < k).join(relevant, ["query_id", "doc_id"]).groupBy("query_id").agg(F.countDistinct("doc_id").alias("found"), F.min("rank").alias("first"))
    out = n.join(hits, "query_id", "left")
    return out.select("query_id", (F.coalesce("found", F.lit(0)) / F.col("relevant")).alias("recall"), F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("mrr"))


def means(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.count("*").alias("queries"))


def unknown_relevant(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judged documents that the corpus lacks."""
    return qrels.select("doc_id").distinct().join(corpus.select("doc_id"), "doc_id", "left_anti")
