"""Keyword coverage of what a selection shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import text_lines


def coverage(keywords: DataFrame, master: DataFrame, target: DataFrame) -> DataFrame:
    """Marks each keyword (query_id, keyword, freq): in_master, in_target, critical. master (keyword), target (query_id, keyword)."""
    known = master.select("keyword").distinct().withColumn("in_master", F.lit(True))
    shown = target.select("query_id", "keyword").distinct().withColumn("in_target", F.lit(True))
    out = keywords.join(known, "keyword", "left").join(shown, ["query_id", "keyword"], "left")
    return out.withColumns({"in_master": F.coalesce("in_master", F.lit(False)), "in_target": F.coalesce("in_target", F.lit(False)), "critical": F.col("freq") >= 2})


def summary(marked: DataFrame) -> DataFrame:
    """Per query: weighted share of keywords shown (100 where there are none), and the lists of what lacks, in the keywords' order: most frequent first, then by name."""
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct((-F.col("freq")).alias("order"), "keyword")))), lambda k: k["keyword"])
    total, shown = F.sum("freq"), F.sum(F.when(F.col("in_target"), F.col("freq")).otherwise(0))
    return marked.groupBy("query_id").agg(
        F.coalesce(F.bround(shown / F.nullif(total, F.lit(0)) * 100).cast("int"), F.lit(100)).alias("score"),
        listed(F.col("in_master") & ~F.col("in_target")).alias("missing_in_target"),
        listed(~F.col("in_master")).alias("not_in_master"),
        listed(F.col("critical") & F.col("in_master") & ~F.col("in_target")).alias("critical_missing"),
    )


def verified_keywords(candidates: DataFrame, in_master: Column, in_query: Column, most: int = 10) -> DataFrame:
    """Candidates (query_id, pos, keyword) that both corpora hold, in order, the first of equal strings, at most `most`."""
    kept = candidates.where(in_master & in_query).groupBy("query_id", "keyword").agg(F.min("pos").alias("pos"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "keyword"))), lambda s: s["keyword"])
    return kept.groupBy("query_id").agg(F.slice(listed, 1, most).alias("keywords"))


def manual_first(manual: Column, verified: Column, most: int = 10) -> Column:
    return F.slice(F.array_distinct(F.concat(manual, verified)), 1, most)


def page_lines(sections: DataFrame) -> DataFrame:
    """Estimated lines per document: 2, one a section, one an entry of experience or projects, and its texts.

    sections: (doc_id, section, entry_index, text); a null text is an entry's own heading.
    """
    kind = F.col("section")
    lines = F.when(kind.isin("summary"), text_lines(F.col("text"))).when(kind.isin("experience", "projects"), F.when(F.col("text").isNull(), 1).otherwise(text_lines(F.col("text")))).when(kind == "skills", F.greatest(F.lit(1), text_lines(F.col("text")))).otherwise(1)
    per = sections.groupBy("doc_id", "section").agg((F.sum(lines) + 1).alias("lines"))
    return per.groupBy("doc_id").agg((F.sum("lines") + 2).alias("estimated_lines"))


def overflow(lines: DataFrame, budget: int = 45) -> DataFrame:
    n = F.col("estimated_lines")
    return lines.withColumns({"page_budget_lines": F.lit(budget), "overflow": n > budget, "overflow_lines": F.greatest(n - budget, F.lit(0))})


def score_band(score: Column, high: float, middle: float) -> Column:
    return F.when(score >= high, "high").when(score >= middle, "middle").otherwise("low")
