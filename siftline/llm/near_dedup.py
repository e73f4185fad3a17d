"""Near duplicates by Order MinHash over five-word shingles, verified by banded alignment.

Words are runs of letters, digits and underscores, lower-cased. A document's
k-mers are its five-word shingles, each labelled with its occurrence number. A
sketch takes, for each of `sketches` random orders, the `least` smallest labelled
k-mers and keeps them in the order in which they stand in the text (Marcais et
al., 2019), so it answers to edit similarity rather than to sets alone. Two
documents that agree in any one of these are candidates; a candidate pair
holds if the banded alignment of their word sequences leaves a distance of at
most 1 - similarity of the longer one's words. Connected documents form a class.

Texts with equal word sequences are one node from the start, so copies never
meet in pairs. With the defaults, two texts that share 80 % of their shingles
miss each other with a chance under 0.0003.

Defined results: null text counts as empty; texts under five words have one
shingle of all their words; texts without words are copies only of identical
texts; the least doc_id of a class is its class_id and its rows stay; rows that
repeat an id are judged each by its own text, so they can fall into classes
that share a class_id, which class_key (a digest of one of the class's texts)
tells apart; a null id never stands for a class that has another; only the id
and text columns are read, so other columns can have any name; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignment import similar_words
from .common import checked_broadcast, joined_by, written
from .graph import Marks, classes, word_bits

WORD = re.compile(r"\w+")
SHINGLE = 5
#: Distinct words whose hashes a worker keeps; beyond it the cache starts afresh.
CACHED_WORDS = 100_000
#: A word edit changes one word of each text at most.
MARKS = Marks(word_bits, 1, 128)


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95)
    return x ^ (x >> np.uint64(32))


def constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled_shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles, in text order."""
    factors = constants(SHINGLE, 5)
    n = len(hashes)
    if n < SHINGLE:
        return mixed((hashes * factors[:n]).sum(keepdims=True) + np.uint64(n))
    h = hashes[: n - SHINGLE + 1] * factors[0]
    for k in range(1, SHINGLE):
        h = h + hashes[k : n - SHINGLE + 1 + k] * factors[k]
    h = mixed(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    repeat = s[1:] == s[:-1]
    label = np.zeros(len(s), np.uint64)
    if repeat.any():
        at = np.arange(len(s))
        begin = np.maximum.accumulate(np.where(np.concatenate(([True], ~repeat)), at, 0))
        label[order] = (at - begin).astype(np.uint64)
    return mixed(h + label * np.uint64(0xA24BAED4963EE407))


def order_minhash(h: np.ndarray, orders: np.ndarray, least: int) -> np.ndarray:
    """One key a random order: its `least` smallest labelled k-mers, in text order."""
    take = min(least, len(h))
    factors, tags = constants(take, 17), mixed(np.arange(1, len(orders) + 1, dtype=np.uint64))
    out, step = [], max(1, 2_000_000 // len(h))
    for k in range(0, len(orders), step):
        ranks = h[None, :] * orders[k : k + step, None]
        if take == len(h):
            chosen = np.broadcast_to(h, ranks.shape)
        else:
            bound = np.partition(ranks, take - 1, axis=1)[:, take - 1]
            chosen = h[np.nonzero(ranks <= bound[:, None])[1].reshape(len(ranks), take)]
        out.append(mixed((chosen * factors).sum(axis=1, dtype=np.uint64) + tags[k : k + step]))
    return np.concatenate(out)


def sketcher(sketches: int, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, orders = Hashes(), constants(sketches, 9)
        for batch in batches:
            digests, sizes, keys = [], [], []
            for cell in batch.column(1):  # one text at a time in Python's memory
                text = cell.as_py()
                words = WORD.findall((text or "").lower())
                sizes.append(len(words))
                if words:
                    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    digests.append(xxhash.xxh3_128_digest(" ".join(words)))
                    keys.append(order_minhash(labelled_shingles(hashes), orders, least).view(np.int64))
                else:
                    digests.append(xxhash.xxh3_128_digest(f"\0{text or ''}"))
                    keys.append(np.zeros(sketches, np.int64))
            flat = np.array(keys, np.int64).reshape(-1, sketches)
            columns = [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(sketches)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), batch.column(2), *columns], names=["doc_id", "digest", "size", "mark", *(f"k{k}" for k in range(sketches))])

    return run


def word_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their words, joined by single blanks."""
    for batch in batches:
        words = [" ".join(WORD.findall((t.as_py() or "").lower())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string())], names=["node", "text"])


def word_aligner(similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hold = similar_words(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hold, pa.bool_()))

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, sketches: int = 16, least: int = 4) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept, class_key."""
    return near_classes(df, id_col, text_col, similarity, sketches, least).drop("mark")


def text_mark(text: Column) -> Column:
    """Tells apart the texts of rows that repeat an id; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def some_id(doc_id: Column) -> Column:
    """An id that is never null: a null one counts as the greatest."""
    return F.coalesce(doc_id, F.lit((1 << 63) - 1))


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, sketches: int = 16, least: int = 4) -> DataFrame:
    """near_duplicates with the text's mark of each row."""
    plain = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", text_mark(F.col("text")))
    names = [f"k{k}" for k in range(sketches)]
    sketched = written(plain.select("doc_id", "text", "mark").mapInArrow(sketcher(sketches, least), f"doc_id long, digest binary, size int, mark long, {', '.join(f'{k} long' for k in names)}"), "sketches")
    # equal word sequences are one node; its own number keeps all later keys and aggregates at a fixed width
    rep = some_id(F.col("doc_id"))
    nodes = sketched.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least_id"), F.min(rep).alias("rep_id"), F.min_by("mark", rep).alias("rep_mark"), *[F.min(c).alias(c) for c in ("size", *names)])
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = nodes.where("size > 0").select(F.explode(F.array(*names)).alias("bucket"), "node", "size")

    def texts_of(ids: DataFrame) -> DataFrame:
        n_ids = ids.count()
        wanted = nodes.join(checked_broadcast(ids, n_ids), "node", "left_semi").select("node", "rep_id", "rep_mark")
        wanted = written(wanted, "wanted")
        found = plain.join(checked_broadcast(wanted, n_ids), (some_id(F.col("doc_id")) == F.col("rep_id")) & (F.col("mark") == F.col("rep_mark")))
        found = written(found.select("node", "text").mapInArrow(word_texts, "node long, text string"), "found")
        # rows that repeat both id and text
        return found if found.count() == n_ids else written(found.dropDuplicates(["node"]), "once")

    roots = classes(buckets, texts_of, lambda pairs: pairs.mapInArrow(word_aligner(similarity), "a long, b long"), MARKS, similarity)
    roots = roots.select(F.col("id").alias("node"), "root")
    classed = nodes.select("node", "digest", "n", "least_id").join(checked_broadcast(roots, roots.count()), "node", "left").withColumn("root", F.coalesce("root", "node"))
    classed = written(classed, "classed")
    by_root = written(classed.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n"), F.hex(F.min_by("digest", "node")).alias("class_key")), "by_root")
    of = written(joined_by(classed.select("root", "digest", F.col("n").alias("of")), by_root, "root").select("digest", F.col("of").alias("n"), "class_id", "class_size", "class_key"), "of")
    out = joined_by(sketched.select("doc_id", "digest", "mark"), of, "digest")
    return out.select("doc_id", "mark", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "class_key")
