"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries, one per task, find the digests that a large share of
rows carries. Exact counts verify them, and the verified winners (at most
``counters + 1`` rows, a fixed bound) are broadcast, so their rows are settled
map-side. All other digests go through one ordinary shuffle, where no group can
exceed ``3 / (counters + 1)`` of the rows.

Defined results: null text counts as empty; equal means identical after
lower-casing A-Z only; the largest doc_id of a group stays; rows that repeat
the same id and text share one verdict; a null id is never the one that stays
unless the whole group has null ids; an empty table gives an empty result.
Only the id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written


def trim(counts: dict, k: int) -> dict:
    """Merge step of a Misra-Gries summary: at most k counters remain, each too low by at most total / (k + 1)."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {x: c - cut for x, c in counts.items() if c > cut}


def summaries(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    counts: dict = {}
    rows = 0
    for batch in batches:
        seen = Counter(batch.column(0).to_pylist())
        rows += batch.num_rows
        for digest, n in seen.items():
            counts[digest] = counts.get(digest, 0) + n
        counts = trim(counts, k)
    # what lies under a task's own share of the error bound can't make a digest frequent by itself
    kept = {x: c for x, c in counts.items() if c * (k + 1) >= rows}
    yield pa.RecordBatch.from_pydict({"digest": pa.array(list(kept), pa.binary()), "est": pa.array(list(kept.values()), pa.int64())})


def heavy_digests(digests: DataFrame, counters: int) -> DataFrame:
    """Digests of more than 3 / (counters + 1) of all rows, and perhaps smaller ones, with their exact counts."""
    n = digests.count()
    found = digests.select("digest").mapInArrow(lambda it: summaries(it, counters), "digest binary, est long")
    # the estimates add up to n at most, so at most counters + 1 digests pass
    likely = found.groupBy("digest").agg(F.sum("est").alias("est")).where(F.col("est") * (counters + 1) >= n).select("digest")
    exact = digests.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    return exact.where("group_size > 1")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 4095) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = df.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256)).alias("digest"))
    digests = written(hashed, "digests")
    winners = written(heavy_digests(digests, counters), "winners")
    heavy = digests.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = (
        digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("group_size", F.count("*").over(group))
        .withColumn("keep_id", F.max("doc_id").over(group))
    )
    both = heavy.select("doc_id", "keep_id", "group_size", "digest").unionByName(rest.select("doc_id", "keep_id", "group_size", "digest"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
