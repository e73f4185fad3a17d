"""Phrase collocations by sorted n-gram keys.

1. Words are counted by language, each task handing on its own counts.
2. Words of at least `least` occurrences get ids; no phrase that is frequent holds
   another word, so pieces are broken at all others.
3. Each place of the encoded text gives one key: the ids of the (up to) five words
   from there on, in a fixed width, padded with zeros. All phrases that begin there
   are the key's prefixes. A task sorts its keys by radix in blocks, and a run of
   equal keys becomes one key with its length.
4. Blocks are cut at the bounds of key ranges and shuffled, a row a block and range.
   The bounds come from a sample of keys taken while words are counted; it steers
   only how evenly work is dealt. A range is sorted by radix again, and the runs of
   equal prefixes of two to five words are the phrases with their counts. A phrase
   whose run touches the end of its range is added up with the next range's.
5. The frequent phrases, few against the text, are scored and thinned by joins.

The ids of up to `dictionary_words` words travel to the tasks at once, some 100 MB;
of more frequent words, the texts are encoded in several passes, a share of the
dictionary each. Everything else is shuffled or bounded by `top`.

Defined results: a null text is empty; a null language counts as `und`; upper-case
letters other than A-Z stay; rows that repeat an id or a text all count; empty
tables, or texts without a frequent phrase, give an empty result. Columns other
than text and language aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, checked_broadcast, forget, written

@dataclass(frozen=True)
class Sizes:
    """What bounds memory and deals out work; results don't depend on it."""

    #: Words whose ids travel to the tasks at once.
    dictionary_words: int = 1_000_000
    #: Distinct words that a task counts before it hands them on.
    words_at_once: int = 400_000
    #: Keys that a task sorts at once.
    keys_at_once: int = 2_000_000
    #: Keys that a range should hold on average.
    range_keys: int = 2_000_000
    #: A key is sampled for so many places, and about `sampled` of these steer the bounds.
    sample_every: int = 2_000
    sampled: int = 50_000


LONGEST = 5
BREAK = b"."
#: Characters that end a piece (they fall together in BREAK, which no word holds), and upper-case letters.
ENDS = b".,;:!?\n\x0b\x0c\r"
CLEAN = bytes.maketrans(UPPER.encode() + ENDS, UPPER.lower().encode() + BREAK * len(ENDS))


def words_of(text: str | None) -> list[bytes]:
    """The words, with BREAK between pieces. bytes.split() parts at ASCII blanks, of which the ends of lines are ends of pieces already."""
    return (text or "").encode().translate(CLEAN).replace(BREAK, b" . ").split()


def word_counter(sizes: Sizes):
    """Rows (lang, word, n), and rows (lang, word null, sample) with five words from a place of the text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        samples: list[tuple[str, list[bytes]]] = []
        since = texts = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, seen in counts.items():
                seen.pop(BREAK, None)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(seen), pa.string()), "word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64()), "sample": pa.nulls(len(seen), pa.list_(pa.binary()))})
            none = len(samples)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([s[0] for s in samples], pa.string()), "word": pa.nulls(none, pa.binary()), "n": pa.nulls(none, pa.int64()), "sample": pa.array([s[1] for s in samples], pa.list_(pa.binary()))})

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                counts.setdefault(lang, Counter()).update(words)
                for at in range(sizes.sample_every - since, len(words), sizes.sample_every):
                    samples.append((lang, words[at : at + LONGEST]))
                since = (since + len(words)) % sizes.sample_every
                texts += 1
                if texts % 32 == 0 and sum(map(len, counts.values())) > sizes.words_at_once:
                    yield from rows()
                    counts, samples = {}, []
        yield from rows()

    return run


class Ids(dict):
    """Words to ids; 0 for all others."""

    def __missing__(self, word: bytes) -> int:
        return 0


def packed(ids: np.ndarray, digits: int) -> np.ndarray:
    """Windows of ids as rows of 16-bit digits, the highest first, so that rows compare as the ids do."""
    halves = np.ascontiguousarray(ids.astype(">u4")).view(">u2").reshape(len(ids), 2 * ids.shape[1])
    return (halves if digits == 2 else halves[:, 1::2]).astype(np.uint16)


def windows(ids: np.ndarray) -> np.ndarray:
    """The LONGEST ids from each place on, zeros after a break, of places where a phrase of two words or more begins."""
    padded = np.concatenate([ids, np.zeros(LONGEST - 1, ids.dtype)])
    starts = np.flatnonzero((ids != 0) & (padded[1 : len(ids) + 1] != 0))
    out = np.zeros((len(starts), LONGEST), ids.dtype)
    out[:, 0], out[:, 1] = ids[starts], padded[starts + 1]
    going = np.ones(len(starts), bool)
    for k in range(2, LONGEST):
        word = padded[starts + k]
        going &= word != 0
        out[:, k] = np.where(going, word, 0)
    return out


def radix_sorted(keys: np.ndarray) -> np.ndarray:
    """The order of the rows: a stable pass for each digit from the last to the first (numpy sorts 16-bit integers by radix)."""
    order = np.argsort(keys[:, -1], kind="stable")
    for d in range(keys.shape[1] - 2, -1, -1):
        order = order[np.argsort(keys[order, d], kind="stable")]
    return order


def runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = radix_sorted(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    return keys[first], np.add.reduceat(counts, first)


def as_bytes(keys: np.ndarray) -> np.ndarray:
    """Rows as fixed-width byte strings that compare as the rows do."""
    wide = np.ascontiguousarray(keys.astype(">u2"))
    return wide.view(f"V{wide.shape[1] * 2}").ravel()


def below(rows: np.ndarray, bound: bytes) -> int:
    """How many of the sorted byte strings are less than bound."""
    low, high = 0, len(rows)
    while low < high:
        middle = (low + high) // 2
        if rows[middle].tobytes() < bound:
            low = middle + 1
        else:
            high = middle
    return low


def squeezed(rows: np.ndarray) -> bytes:
    """Integers as planes of bytes, column by column: of sorted keys, most planes hardly change from row to row."""
    wide = np.ascontiguousarray(rows.T)
    planes = wide.view(np.uint8).reshape(*wide.shape, wide.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.moveaxis(planes, -1, 0)).tobytes())


def restored(packed: bytes, shape: tuple[int, ...], kind: type) -> np.ndarray:
    """Rows of such planes."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, *shape[::-1])
    return np.ascontiguousarray(np.moveaxis(planes, 0, -1)).view(kind).reshape(shape[::-1]).T


BLOCKS = "part int, n int, keys binary, counts binary"


def blocks(keys: np.ndarray, bounds: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A row a key range that the block has keys of."""
    keys, counts = runs(keys, np.ones(len(keys), np.int64))
    rows = as_bytes(keys)
    cuts = [0, *(below(rows, b) for b in bounds), len(keys)]
    for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([b - a], pa.int32()), "keys": [squeezed(keys[a:b])], "counts": [squeezed(counts[a:b].astype(np.uint32))]})


def sorter(digits: int, bounds: list[bytes], sizes: Sizes):
    """Encoded texts to blocks of sorted keys, cut at the bounds."""

    def run(encoded: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for ids in encoded:
            held += ids
            n += sum(map(len, ids))
            if n >= sizes.keys_at_once:
                yield from blocks(packed(windows(np.concatenate(held)), digits), bounds)
                held, n = [], 0
        if held:
            yield from blocks(packed(windows(np.concatenate(held)), digits), bounds)

    return run


def encoded(lang: str, text: str | None, ids: dict[str, Ids]) -> np.ndarray:
    """The text's word ids, zeros for breaks and other words, and a zero at the end."""
    words, of = words_of(text), ids.get(lang)
    out = np.zeros(len(words) + 1, np.uint32)
    if of:
        out[:-1] = np.fromiter(map(of.__getitem__, words), np.uint32, len(words))
    return out


def keys_of_texts(ids, digits: int, bounds: list[bytes], sizes: Sizes):
    """Texts to blocks of keys; ids is the whole dictionary, as a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    some = batch.slice(k, 256)
                    yield [encoded(lang, text, ids.value) for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)]

        return sorter(digits, bounds, sizes)(arrays())

    return run


def keys_of_ids(digits: int, bounds: list[bytes], sizes: Sizes):
    """The same for texts that are encoded already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sorter(digits, bounds, sizes)([np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()] for batch in batches)

    return run


def some_ids(ids):
    """Texts and what earlier passes found of their ids, with the words of one more share of the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                rows = list(zip(*(some.column(c).to_pylist() for c in range(3)), strict=True))
                found = [encoded(lang, text, ids.value) for lang, text, _ in rows]
                merged = [x if was is None else np.maximum(x, np.frombuffer(was, np.uint32)) for x, (_, _, was) in zip(found, rows, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([x.tobytes() for x in merged], pa.binary())], names=["lang", "text", "ids"])

    return run


PHRASES = "words int, key binary, n long"


def phrases_of_range(digits: int, least: int, sizes: Sizes):
    """The blocks of one key range to its phrases of `least` occurrences or more, and those at its ends, which the ranges beside it may share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list] = {}
        for batch in batches:
            for part, n, keys, counts in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                mine = ranges.setdefault(part, [])
                mine.append((np.ascontiguousarray(restored(keys, (n, LONGEST * digits), np.uint16)), restored(counts, (n,), np.uint32).astype(np.int64)))
                if sum(len(k) for k, _ in mine) > 4 * sizes.keys_at_once:  # what repeats falls together early
                    ranges[part] = [runs(np.concatenate([k for k, _ in mine]), np.concatenate([c for _, c in mine]))]
        for mine in ranges.values():
            keys, counts = runs(np.concatenate([k for k, _ in mine]), np.concatenate([c for _, c in mine]))
            mine.clear()
            sums = np.concatenate([[0], np.cumsum(counts)])
            new = np.zeros(len(keys), bool)
            new[0] = True
            for words in range(1, LONGEST + 1):
                columns = slice((words - 1) * digits, words * digits)
                new[1:] |= (keys[1:, columns] != keys[:-1, columns]).any(axis=1)
                if words == 1:
                    continue
                first = np.flatnonzero(new)
                n = sums[np.append(first[1:], len(keys))] - sums[first]
                whole = (keys[first, columns] != 0).any(axis=1)  # else the phrase ends before
                ends = np.zeros(len(first), bool)
                ends[[0, -1]] = True
                kept = whole & ((n >= least) | ends)
                rows = as_bytes(keys[first[kept], : words * digits])
                key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * words * digits), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_pydict({"words": pa.array(np.full(len(rows), words, np.int32)), "key": key, "n": pa.array(n[kept], pa.int64())})

    return run


def share_of(frequent: DataFrame, share: int, taken: int) -> list[tuple[str, bytes, int, int]]:
    """(lang, word, n, id) of one share, in order of language and word; ids go on from those taken."""
    got = frequent.where(F.col("share") == share).select("lang", "word", "n").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in got.column_names), strict=True))
    return [(lang, word, n, taken + k) for k, (lang, word, n) in enumerate(rows, 1)]


def as_ids(rows: list[tuple[str, bytes, int, int]]) -> dict[str, Ids]:
    out: dict[str, Ids] = {}
    for lang, word, _, id_ in rows:
        out.setdefault(lang, Ids())[word] = id_
    return out


def range_bounds(sampled: list[np.ndarray], digits: int, ranges: int) -> list[bytes]:
    """Rising keys that part the sampled ones evenly."""
    if not sampled:
        return []
    keys = sorted(k.tobytes() for k in as_bytes(packed(np.array(sampled), digits)))
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)})


def counted_phrases(df: DataFrame, least: int, sizes: Sizes) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """words (lang, word, n, key), phrases (words, key, n) of `least` occurrences or more, totals (lang, total), and a word's width in a key."""
    spark = df.sparkSession
    seen = written(df.mapInArrow(word_counter(sizes), "lang string, word binary, n long, sample array<binary>"), "seen")
    counts = written(seen.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = written(counts.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    frequent = written(counts.where(F.col("n") >= least), "frequent")
    n_words, places = frequent.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
    shares, digits = -(-n_words // sizes.dictionary_words), max(1, -(-n_words.bit_length() // 16))
    if digits > 2:
        raise ValueError("more than 2**32 frequent words")
    frequent = frequent.withColumn("share", F.pmod(F.xxhash64("lang", "word"), F.lit(max(1, shares))))
    sampled = seen.where("sample is not null").select("lang", "sample")
    share_kept = min(1.0, sizes.sampled / max(1, sampled.count()))
    drawn = sampled.where(F.pmod(F.xxhash64("lang", "sample"), F.lit(1 << 20)) < int(share_kept * (1 << 20))).collect()
    drawn_ids = np.zeros((len(drawn), LONGEST), np.uint32)
    texts, tables, taken, ids = df, [], 0, {}
    for share in range(shares):
        rows = share_of(frequent, share, taken)
        taken += len(rows)
        ids = as_ids(rows)
        columns = {"lang": pa.array([r[0] for r in rows], pa.string()), "word": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.int64()), "key": pa.array([r[3].to_bytes(2 * digits, "big") for r in rows], pa.binary())}
        tables.append(written(spark.createDataFrame(pa.table(columns)), "ids"))
        for k, r in enumerate(drawn):
            of = ids.get(r["lang"], {})
            drawn_ids[k, : len(r["sample"])] = np.maximum(drawn_ids[k, : len(r["sample"])], [of.get(bytes(w), 0) for w in r["sample"]])
        if shares > 1:
            sent, before = spark.sparkContext.broadcast(ids), texts
            start = texts if share else df.withColumn("ids", F.lit(None).cast("binary"))
            texts = written(start.mapInArrow(some_ids(sent), "lang string, text string, ids binary"), "encoded")
            if share:
                forget(before)
            sent.unpersist()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-places // sizes.range_keys))
    bounds = range_bounds([w for row in drawn_ids for w in windows(row)[:1] if row[0]], digits, ranges)
    if shares > 1:
        cut = texts.mapInArrow(keys_of_ids(digits, bounds, sizes), BLOCKS)
    else:
        cut = df.mapInArrow(keys_of_texts(spark.sparkContext.broadcast(ids), digits, bounds, sizes), BLOCKS)
    parts = cut.repartitionById(len(bounds) + 1, F.col("part")).mapInArrow(phrases_of_range(digits, least, sizes), PHRASES)
    phrases = written(parts.groupBy("words", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
    for table in [seen, counts, *([texts] if shares > 1 else [])]:
        forget(table)
    words = spark.createDataFrame([], "lang string, word binary, n long, key binary")
    for table in tables:
        words = words.unionByName(table)
    return words, phrases, totals, 2 * digits


def part_of(key: str, width: int, first: Column | int, words: Column | int) -> Column:
    """The key of some words of a phrase, counted from 0."""
    first, words = (x if isinstance(x, Column) else F.lit(x) for x in (first, words))
    return F.substring(F.col(key), first * width + 1, words * width)


def thinned(phrases: DataFrame, width: int, percent: int) -> DataFrame:
    """Without phrases inside a longer one that makes up `percent` of their occurrences, whether that one stays or not."""
    inside = phrases.where("words > 2").select("n", "key", F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(0, words - m), s -> struct(s as s, m as m))))")).alias("p"))
    longer = inside.select(part_of("key", width, F.col("p.s"), F.col("p.m")).alias("key"), "n").groupBy("key").agg(F.max("n").alias("_longer"))
    return phrases.join(longer, "key", "left").where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("n") * percent)).drop("_longer")


def scored(phrases: DataFrame, kept: DataFrame, words: DataFrame, totals: DataFrame, width: int) -> DataFrame:
    """lang, key, a, l, r, n, score: the lowest score of all cuts, of equal ones that after the fewest words."""
    known = written(phrases.select("key", "n").unionByName(words.select("key", "n")), "known")
    rows = known.count()
    of_first = checked_broadcast(words.select(F.col("key").alias("_word"), "lang"), words.count())
    cuts = kept.select("key", "words", F.col("n").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    for name, first, n in (("l", F.lit(0), F.col("k")), ("r", F.col("k"), F.col("words") - F.col("k"))):
        side = known.select(F.col("key").alias(f"_{name}"), F.col("n").alias(name))
        cuts = cuts.withColumn(f"_{name}", part_of("key", width, first, n)).join(checked_broadcast(side, rows), f"_{name}").drop(f"_{name}")
    cuts = cuts.withColumn("_word", part_of("key", width, 0, 1)).join(of_first, "_word").join(checked_broadcast(totals, totals.count()), "lang")
    # decimals of 38 digits hold 1000 * a * n for any a and n up to 10 ** 17
    exact = F.expr("cast(cast(1000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(total as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)")
    best = cuts.withColumn("score", exact).groupBy("lang", "key", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "key", "a", "b.l", "b.r", F.col("total").alias("n"), "b.score")


def first_of_each(rows: DataFrame, by: list[str], order: list[Column], top: int, ties: bool) -> DataFrame:
    """The first `top` rows of each group (and those equal to the last), first within shares of a group, so no group meets in one task."""
    place = F.rank() if ties else F.row_number()
    for keys in ([*by, "_share"], by):
        placed = rows.withColumn("_share", F.pmod(F.xxhash64("key"), F.lit(64))).withColumn("_place", place.over(Window.partitionBy(*keys).orderBy(*order)))
        rows = placed.where(F.col("_place") <= top).drop("_place", "_share")
    return rows


def collocations(df: DataFrame, least: int = 100, top: int = 2000, percent: int = 100, text_col: str = "text", lang_col: str = "lang", sizes: Sizes | None = None) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words, phrases, totals, width = counted_phrases(texts, least, sizes or Sizes())
    rows = scored(phrases, thinned(phrases, width, percent), words, totals, width)
    best = written(first_of_each(rows, ["lang"], [F.desc("score"), F.desc("a")], top, ties=True), "best")
    # spelt only now: some `top` phrases a language
    spelt = best.select("lang", "key", F.posexplode(F.expr(f"transform(sequence(0, octet_length(key) div {width} - 1), k -> substring(key, cast(k * {width} + 1 as int), {width}))")).alias("at", "_key"))
    names = spelt.join(words.select(F.col("key").alias("_key"), F.col("word").cast("string").alias("word")), "_key").groupBy("lang", "key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    full = best.join(names, ["lang", "key"]).withColumn("phrase", F.array_join(F.col("w.word"), " "))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return full.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
