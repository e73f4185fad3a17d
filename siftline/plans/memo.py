"""Selections kept by fingerprint: of a batch of queries only those not known yet are worked out.

A fingerprint is made of a query's text and of all that its selection depends on
besides: the state of the index, the settings and the parameters. So a kept
selection can't be stale, only past its time. What a batch lacks is found by an
anti-join, selected, and stored in one commit; queries alike in text are selected
once. Of two writers that work out the same query, the first one's rows stay.
"""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.lineage import cut
from siftline.operators.retrieval import small
from siftline.sources.rows import Edit, RowTables
from siftline.sources.segments import SegmentIndex

from . import selecting
from .config import Settings

KEPT = {"done": ["fingerprint"], "entries": ["fingerprint", "section", "entry_index"], "flat": ["fingerprint", "section", "entry_index"], "keywords": ["fingerprint", "keyword"]}


@dataclass(frozen=True)
class Kept:
    """entries, flat and keywords as a Selection has them, by query_id; new: how many queries had to be worked out."""

    entries: DataFrame
    flat: DataFrame
    keywords: DataFrame
    new: int


class SelectionMemo:
    """hours: how long a selection holds; for ever at 0 or less."""

    def __init__(self, spark: SparkSession, root: str, hours: float = 24.0):
        self.tables, self.hours = RowTables(spark, root, KEPT), hours

    def context(self, index: SegmentIndex, settings: Settings, **parameters) -> str:
        """What a selection depends on besides its query."""
        number, state = index.state()
        said = json.dumps([state, settings.fingerprint(), {k: sorted(v) if isinstance(v, (set, frozenset)) else v for k, v in sorted(parameters.items())}], sort_keys=True, default=list)
        return hashlib.sha256(said.encode()).hexdigest()

    def _known(self, state: dict, now: float) -> DataFrame | None:
        """Fingerprints whose time isn't up."""
        done = self.tables.read("done", state)
        if done is None:
            return None
        return (done.where(F.col("at") > now - self.hours * 3600) if self.hours > 0 else done).select("fingerprint")

    def select(self, index: SegmentIndex, queries: DataFrame, settings: Settings | None = None, now: float | None = None, section: str | None = None, limits: dict[str, int] | None = None, dictionary=(), **how) -> Kept:
        """The selections of queries (query_id, text), kept ones and new ones; how: further arguments of `selecting.select` that don't change with the query, callables by their names."""
        s, now = settings or Settings(), time.time() if now is None else now
        named = {k: getattr(v, "__qualname__", str(v)) if callable(v) else v for k, v in how.items()}
        context = self.context(index, s, section=section, limits=limits, dictionary=set(dictionary), **named)
        marked = cut(queries.select("query_id", "text", F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit(f"\0{context}")), 256).alias("fingerprint")))
        known = self._known(self.tables.log.state()[1], now)
        asked = marked.dropDuplicates(["fingerprint"])
        missing = cut(asked if known is None else asked.join(known, "fingerprint", "left_anti"))
        new = missing.count()
        if new:
            chosen = selecting.select(None, missing.select(F.col("fingerprint").alias("query_id"), "text"), s, section=section, limits=limits, dictionary=dictionary, index=index, **how)
            parts = {name: cut(getattr(chosen, name).withColumnRenamed("query_id", "fingerprint")) for name in ("entries", "flat", "keywords")}
            parts["flat"] = parts["flat"].select("fingerprint", "section", "entry_index", "position", "included")
            mine = missing.select("fingerprint").withColumn("at", F.lit(now))

            def store(state: dict) -> Edit:
                others = self._known(state, now)
                left = mine if others is None else mine.join(small(others), "fingerprint", "left_anti")
                keys = small(left.select("fingerprint"))
                return Edit(puts={"done": left} | {name: rows.join(keys, "fingerprint", "left_semi") for name, rows in parts.items()}, read=("done",))

            self.tables.commit(store)
        state = self.tables.log.state()[1]
        if not state:
            raise ValueError("nothing is kept and nothing was asked")
        ids = small(marked.select("query_id", "fingerprint"))
        found = [self.tables.read(name, state).join(ids, "fingerprint").drop("fingerprint") for name in ("entries", "flat", "keywords")]
        return Kept(*found, new)

    def expire(self, now: float | None = None) -> int:
        """Delete the selections whose time is up; how many."""
        state, now = self.tables.log.state()[1], time.time() if now is None else now
        done = self.tables.read("done", state)
        if done is None or self.hours <= 0:
            return 0
        gone = cut(done.where(F.col("at") <= now - self.hours * 3600).select("fingerprint"))
        n = gone.count()
        if n:
            keys = {name: gone if name == "done" else self.tables.read(name, state).join(small(gone), "fingerprint", "left_semi").select(*self.tables.keys[name]) for name in KEPT}
            self.tables.commit(lambda _: Edit(deletes=keys))
        return n
