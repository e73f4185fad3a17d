"""A retrieval index of immutable segments.

A segment is three tables: postings (a row a term and some documents, with its
frequency in each and their lengths) in folders by a hash of the term and sorted by term; the
documents as they were given, with their tokens and a mark of their content; and the
vocabulary with its document frequencies. Adding documents writes one segment;
leaving documents out writes their keys and what the vocabulary loses; `merge` makes
one segment of many that are alike in size. Every step is one commit to the log, so
readers see the index before or after it.

Scores are those of `retrieval.bm25_scores` over the documents that are in force:
queries read the postings of the asked terms' folders alone (and within them, by
the files' statistics, little but the asked terms), and no text. Frequencies are
counted over just these postings; numbers of documents, lengths and the floor of
negative idf come from documents and vocabulary, once for each state of the index.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import tokens
from siftline.operators import blocks, retrieval
from siftline.operators.lineage import cut

from .log import Log

#: Asked terms up to which they are named in the postings' filter, so that files are skipped by their statistics.
NAMED_TERMS = 1_000
#: Segments alike in size that are merged into one.
FAN = 8
#: Keys of documents up to which they are broadcast.
KEY_ROWS = 1_000_000
KEY = ["section", "doc_id"]


class SegmentIndex:
    """tokenise, stem: how texts become terms; an index keeps them as `parameters`, which name them."""

    def __init__(self, spark: SparkSession, root: str, tokenise: Callable[[Column], Column] = tokens, stem: bool = False, parameters: str = "", buckets: int = 64):
        self.spark, self.log, self.tokenise, self.stem, self.buckets = spark, Log(spark, root), tokenise, stem, buckets
        self.parameters = f"{parameters}|stem={stem}|buckets={buckets}|packed"
        self._known: tuple[int, DataFrame] | None = None

    # -- what is in force

    def state(self) -> tuple[int, dict]:
        number, state = self.log.state()
        return number, state if state.get("parameters") == self.parameters else {"parameters": self.parameters, "segments": []}

    def _live(self, state: dict, table: str) -> DataFrame | None:
        """A table of all segments, without the documents that have left."""
        out = None
        for segment in state["segments"]:
            rows = self.log.read(segment[table])
            if table == "postings":
                each = F.explode(F.arrays_zip("doc_ids", "tfs", "dls")).alias("p")
                rows = rows.select("bucket", "section", "term", each).select("bucket", "section", F.col("p.doc_ids").alias("doc_id"), F.col("p.dls").alias("dl"), "term", F.col("p.tfs").alias("tf"))
            for gone in segment["gone"]:
                keys = self.log.read(gone["keys"]).select(F.col("section").alias("_s"), F.col("doc_id").alias("_d"))
                rows = rows.join(retrieval.small(keys, KEY_ROWS), (rows["section"] == F.col("_s")) & (rows["doc_id"] == F.col("_d")), "left_anti")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def documents(self) -> DataFrame | None:
        """The documents in force with their tokens; None for an empty index."""
        rows = self._live(self.state()[1], "documents")
        return None if rows is None else rows.drop("_mark", "_dl")

    def _words(self, state: dict) -> DataFrame:
        """The vocabularies of all segments and, below 0, of what has left them."""
        words = None
        for segment in state["segments"]:
            for folder in (segment["vocabulary"], *(g["vocabulary"] for g in segment["gone"])):
                one = self.log.read(folder)
                words = one if words is None else words.unionByName(one)
        return words

    def _stats(self, number: int, state: dict) -> DataFrame:
        """(section, n, avgdl, floor), worked out once for each state."""
        if self._known is None or self._known[0] != number:
            docs = self._live(state, "documents").groupBy("section").agg(F.count("*").alias("n"), F.avg("_dl").alias("avgdl"))
            df = self._words(state).groupBy("section", "term").agg(F.sum("df").alias("df")).where("df > 0")
            raw = df.join(docs, "section").select("section", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
            floor = raw.groupBy("section").agg((F.avg("raw") * retrieval.EPSILON).alias("floor"))
            self._known = (number, cut(docs.join(floor, "section", "left")))
        return self._known[1]

    # -- changes

    def _postings(self, docs: DataFrame) -> DataFrame:
        """Counted and packed where the documents lie: the shuffle takes a row a term and batch of documents."""
        each = blocks.packed_postings(docs.select(*KEY, F.col("_dl").alias("dl"), "tokens"), self.stem)
        salts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        # a term that a third of all documents holds is dealt out
        dealt = each.withColumns({"bucket": self.bucket(F.col("term")), "_salt": F.pmod(F.xxhash64(F.get("doc_ids", F.lit(0))), F.lit(salts))}).repartition(self.buckets * salts, "bucket", "_salt")
        return dealt.drop("_salt").sortWithinPartitions("bucket", "term", "section")

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _segment(self, docs: DataFrame) -> dict | None:
        """Write a segment of (section, doc_id, tokens, _mark, _dl, ..); nothing of no documents."""
        folder = self.log.write("documents", docs)
        docs = self.log.read(folder)
        n = docs.count()
        if not n:
            return None
        postings = self.log.write("postings", self._postings(docs), "bucket")
        words = self.log.read(postings).groupBy("section", "term").agg(F.sum(F.size("doc_ids")).alias("df"))
        return {"id": uuid.uuid4().hex, "documents": folder, "postings": postings, "vocabulary": self.log.write("vocabulary", words), "size": n, "gone": []}

    def sync(self, corpus: DataFrame) -> dict[str, int]:
        """Bring the index to corpus (section, doc_id, text, ..): {"added": .., "gone": ..} documents.

        Only documents that are new or whose columns have changed are tokenised
        and written; of (section, doc_id) that repeat, one stays. Neither may be null.
        """
        marked = corpus.withColumn("_mark", F.xxhash64(*[F.col(f"`{c}`") for c in corpus.columns]))
        # texts are sorted out only where keys repeat
        twice = cut(marked.groupBy(*KEY).agg(F.count("*").alias("_n")).where("_n > 1").select(*KEY))
        if not twice.isEmpty():
            keys = retrieval.small(twice)
            marked = marked.join(keys, KEY, "left_anti").unionByName(marked.join(keys, KEY, "left_semi").dropDuplicates(KEY))
        while True:
            number, state = self.log.state()
            base = self.state()[1]
            old = self._live(base, "documents")
            if old is None:
                new, left = marked, None
            else:
                old = old.select(*KEY, "_mark")
                fresh = cut(marked.select(*KEY, "_mark").join(old, [*KEY, "_mark"], "left_anti").select(*KEY))
                new = marked.join(retrieval.small(fresh, KEY_ROWS), KEY, "left_semi")
                left = old.join(marked.select(*KEY, "_mark"), [*KEY, "_mark"], "left_anti").select(*KEY)
                left = cut(left)
            segment = self._segment(new.withColumn("tokens", self.tokenise(F.col("text"))).withColumn("_dl", F.size("tokens")))
            n_left = left.count() if left is not None else 0
            segments = [dict(s, gone=list(s["gone"])) for s in base["segments"]]
            if n_left:
                segments = [self._without(s, left) for s in segments]
            wanted = {"parameters": self.parameters, "segments": [*segments, *([segment] if segment else [])]}
            if wanted == state or self.log.commit(number, wanted):
                return {"added": segment["size"] if segment else 0, "gone": n_left}

    def _without(self, segment: dict, left: DataFrame) -> dict:
        """The segment with those of `left` that it holds marked as gone."""
        mine = self.log.read(segment["documents"]).select(*KEY).join(retrieval.small(left, KEY_ROWS), KEY, "left_semi")
        for gone in segment["gone"]:
            mine = mine.join(self.log.read(gone["keys"]), KEY, "left_anti")
        keys = self.log.write("gone", mine)
        n = self.log.read(keys).count()
        if not n:
            return segment
        # counted in the tokens of those that leave: the postings stay unread
        leaving = self.log.read(segment["documents"]).join(retrieval.small(self.log.read(keys), KEY_ROWS), KEY, "left_semi")
        lost = blocks.frequencies(leaving, "tokens", self.stem).where("kind = 1").groupBy("section", "term").agg((-F.sum("n")).alias("df"))
        return segment | {"gone": [*segment["gone"], {"keys": keys, "vocabulary": self.log.write("vocabulary", lost), "size": n}]}

    def merge(self, fan: int = FAN) -> int:
        """Merge groups of `fan` or more segments alike in size, without what has left; how many segments went into merges."""
        merged = 0
        while True:
            number, state = self.log.state()
            tiers: dict[int, list[dict]] = {}
            for s in state.get("segments", []):
                live = s["size"] - sum(g["size"] for g in s["gone"])
                tiers.setdefault(int(math.log(max(1, live), fan)), []).append(s)
            full = next((t for t in tiers.values() if len(t) >= fan), None)
            if full is None or state.get("parameters") != self.parameters:
                return merged
            one = self._segment(self._live({"segments": full}, "documents"))
            rest = [s for s in state["segments"] if s not in full]
            if self.log.commit(number, state | {"segments": [*rest, *([one] if one else [])]}):
                merged += len(full)

    def tidy(self, keep: int = 3) -> int:
        """Delete files that none of the last states names."""
        return self.log.tidy(keep, lambda state: {f for s in state["segments"] for f in (s["documents"], s["postings"], s["vocabulary"], *(x for g in s["gone"] for x in (g["keys"], g["vocabulary"])))})

    # -- queries

    def postings_of(self, asked: DataFrame, state: dict | None = None) -> DataFrame:
        """The postings of the asked terms (term, ..), read from their folders alone."""
        rows = self._live(state or self.state()[1], "postings")
        buckets = [r[0] for r in asked.select(self.bucket(F.col("term"))).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(buckets))
        named = [r[0] for r in asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
        return rows.where(F.col("term").isin(named)) if len(named) <= NAMED_TERMS else rows

    def scores(self, queries: DataFrame, section: str | None = None, pad: int | None = None, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
        """(query_id, section, doc_id, score), as bm25_scores has them; queries (query_id, tokens)."""
        number, state = self.state()
        if not state["segments"]:
            raise ValueError("the index is empty")
        asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        asked = cut(retrieval.stemmed(asked, "times") if self.stem else asked)
        postings = self.postings_of(asked, state)
        if section is not None:
            postings = postings.where(F.col("section") == section)
        n = asked.limit(retrieval.QUERY_ROWS + 1).count()
        hint = F.broadcast if n <= retrieval.QUERY_ROWS else lambda df: df
        met = cut(postings.join(hint(asked.select("term").distinct()), "term", "left_semi").select("section", "doc_id", "term", "tf", "dl"))
        df = met.groupBy("section", "term").agg(F.count("*").alias("df"))
        stats = F.broadcast(self._stats(number, state))  # a row a section
        raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = df.join(stats, "section").select("section", "term", "avgdl", F.when(raw < 0, F.col("floor")).otherwise(raw).alias("idf"))
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        weighed = met.join(retrieval.small(idf), ["section", "term"]).select("section", "doc_id", "term", part.alias("part"))
        out = weighed.join(hint(asked), "term").groupBy("query_id", "section", "doc_id").agg(F.sum(F.col("part") * F.col("times")).alias("score"))
        if pad:
            docs = self._live(state, "documents").select(*KEY)
            out = retrieval.padded(out, docs if section is None else docs.where(F.col("section") == section), queries, pad)
        return out

    def ranked(self, queries: DataFrame, top_k: int, section: str | None = None, pad: bool = False, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
        """scores' ranking down to top_k, scored by blocks as retrieval.bm25_ranked does it."""
        number, state = self.state()
        if not state["segments"]:
            raise ValueError("the index is empty")
        asked = retrieval.asked_terms(queries, "tokens", self.stem)
        if asked.limit(retrieval.QUERY_ROWS + 1).count() > retrieval.QUERY_ROWS:
            return retrieval.ranked(self.scores(queries, section, top_k if pad else None, k1, b), top_k)
        names = F.broadcast(asked.select("term").distinct())
        df = self._words(state).join(names, "term").groupBy("section", "term").agg(F.sum("df").alias("df")).where("df > 0")
        stats = F.broadcast(self._stats(number, state))
        raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = df.join(stats, "section").select("section", "term", F.when(raw < 0, F.col("floor")).otherwise(raw).alias("idf"))
        rows = asked.collect()
        ids, terms = ({k: i for i, k in enumerate(dict.fromkeys(r[c] for r in rows))} for c in ("query_id", "term"))
        if self._stats(number, state).count() * max(len(terms), 1) > retrieval.WEIGHTS:
            return retrieval.ranked(self.scores(queries, section, top_k if pad else None, k1, b), top_k)
        sections = {r["section"]: (r["avgdl"], np.zeros(len(terms))) for r in self._stats(number, state).collect()}
        for r in idf.collect():
            sections[r["section"]][1][terms[r["term"]]] = r["idf"]
        postings = self.postings_of(asked, state)
        if section is not None:
            postings = postings.where(F.col("section") == section)
        of = F.broadcast(self.spark.createDataFrame(list(terms.items()), "term string, _t int"))
        met = postings.join(of, "term").select("section", "doc_id", F.col("_t").alias("term"), "tf", "dl")
        wanted = blocks.Asked(list(terms), [terms[r["term"]] for r in rows], [ids[r["query_id"]] for r in rows], [r["times"] for r in rows], len(ids))
        heads = blocks.posting_heads(met, wanted, top_k, blocks.Weighed(list(terms), range(len(terms)), max(len(terms), 1), sections, k1, b))
        out = heads.join(retrieval.numbered(list(ids), queries), "q").select("query_id", "section", "doc_id", "score")
        if pad:
            docs = self._live(state, "documents")
            docs = docs if section is None else docs.where(F.col("section") == section)
            out = out.unionByName(retrieval.unshared(docs, queries, asked, "tokens", top_k, self.stem))
        return retrieval.ranked(out, top_k)
