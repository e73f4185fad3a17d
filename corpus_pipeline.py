"""A training-corpus pipeline: quality, near duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of documents.

Defined results: a null text counts as empty everywhere; the classifier judges
an empty text as any other; empty texts are near copies of each other, texts
without words only of identical ones; a text without words holds no benchmark
item; a row without tokens is used once in the mixture; null sources are a source
of their own. Rows that repeat an id are judged each by its own text; of rows
that repeat both, all share one verdict. A null id is never the one that stays of
a group that has another. Ties are broken by doc_id, then by the text. An empty
table passes through as an empty one. Further columns, whatever their names, are
carried along, except those of the shards' own names, which the last stage
replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import checked_broadcast, documents, written
from siftline.llm.decontamination import decontaminate
from siftline.llm.mixing import mixed
from siftline.llm.near_dedup import near_classes, some_id, text_mark
from siftline.llm.quality import select_quality
from siftline.llm.sharding import interleave_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on `labels`, holds for clean."""
    return select_quality(docs, documents(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least doc_id; where an id repeats with another text, only the rejected text goes."""
    gone = near_classes(docs).where("not kept").select(some_id(F.col("doc_id")).alias("_gone_id"), F.col("mark").alias("_gone_mark")).distinct()
    gone = written(gone, "gone")
    same = (some_id(docs["doc_id"].cast("long")) == gone["_gone_id"]) & (text_mark(docs["text"]) == gone["_gone_mark"])
    return docs.join(checked_broadcast(gone, gone.count()), same, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, scarce sources up to twice."""
    return mixed(docs, repeat_limit=2.0)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its place in one of 24 shards."""
    return interleave_shards(docs, shards=24)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: The classifier, the sketches and the alignments have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
