"""Queries over kept tables: the segment index, selections kept by fingerprint, rows changed one by one."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from siftline.operators import retrieval
from siftline.operators.lineage import new_folder
from siftline.sources.rows import RowTables, RunStore
from siftline.sources.segments import SegmentIndex

from .document_queries import PLACED, PLAIN, SELECTED, tables_corpus
from .memo import SelectionMemo
from .registry import BM25, CUT, RRF, offers, plain, query, table


def indexed(spark, sf_dir) -> SegmentIndex:
    """An index of documents that came there in two steps: the first one lacked some documents and had others with another text, and some that are none."""
    index = SegmentIndex(spark, new_folder(spark, "index"), tokenise=plain, parameters="plain")
    docs = tables_corpus(spark, sf_dir)
    before = docs.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("the old wording "), "text")).otherwise(F.col("text")))
    index.sync(before.unionByName(docs.where("doc_id % 11 = 0").withColumn("doc_id", -F.col("doc_id") - 1)))
    index.sync(docs)
    return index


@query(f"WITH {BM25} SELECT query_id, section, doc_id, rank::INT AS rank, round(score, 6) AS score FROM sparse WHERE rank < {CUT}")
def bm25_indexed(spark, sf_dir):
    out = indexed(spark, sf_dir).ranked(offers(spark, sf_dir), CUT)
    return out.select("query_id", "section", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {BM25} {PLACED.replace(RRF.format(w=0.5), RRF.format(w=0.0))} {SELECTED}")
def selection_memoised(spark, sf_dir):
    """Some queries first, then all of them: those known come from the store, the others through the index."""
    memo, index = SelectionMemo(spark, new_folder(spark, "memo")), indexed(spark, sf_dir)
    settings, queries = replace(PLAIN, keyword_weight=0.0), offers(spark, sf_dir).select("query_id", "text")
    memo.select(index, queries.where("query_id % 3 = 0"), settings, tokenise=plain, pad=False)
    kept = memo.select(index, queries, settings, tokenise=plain, pad=False)
    return kept.entries.select("query_id", "section", "entry_index", F.col("position").cast("int").alias("position"), "included", F.array_join(F.col("shown").cast("array<string>"), ",").alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey END AS custkey
    FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 35 = 0""")
def rows_merged(spark, sf_dir):
    """Orders after a change, deletions, and some of the deleted ones put again."""
    store = RowTables(spark, new_folder(spark, "rows"), {"orders": ["o_orderkey"]})
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("custkey"))
    changed = orders.where("o_orderkey % 5 = 0").withColumns({"status": F.lit("changed"), "custkey": F.lit(0).cast(orders.schema["custkey"].dataType)})
    store.put("orders", orders)
    store.compact("orders")
    store.put("orders", changed)
    store.delete("orders", orders.where("o_orderkey % 7 = 0"))
    store.put("orders", changed.where("o_orderkey % 7 = 0"))
    return store.read("orders").select("o_orderkey", "status", "custkey")


@query("""SELECT 'k' || (props->>'$.k') AS variant_id, 5 + count(*) FILTER (user_id % 2 = 0) AS used_count FROM events GROUP BY 1""")
def usage_applied_once(spark, sf_dir):
    """Usage of runs, some of which were applied before, added to the variants in one commit; calling again adds nothing."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("k"))
    store = RunStore(spark, new_folder(spark, "runs"))
    store.tables.put("variants", events.select(F.col("k").alias("variant_id")).distinct().withColumn("used_count", F.lit(5).cast("long")))
    store.add(events.select(F.col("event_id").cast("string").alias("run_id"), F.create_map("k", F.lit(1)).alias("variant_usage"), (F.col("user_id") % 2 == 1).alias("variant_usage_applied")))
    store.apply_usage()
    store.apply_usage()
    return store.tables.read("variants").select("variant_id", "used_count")
