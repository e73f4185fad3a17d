"""Packing documents into sequences of a fixed number of tokens by minimum bin slack.

A task tokenises its documents, cuts the long ones and numbers its pieces within
each length. Of all pieces only the number of each length, at most `capacity`
numbers, reaches the driver. There, bin by bin, the longest piece left opens a
sequence (so that none is left over when nothing goes with it any more), a dynamic
programme over bitsets finds all sums that the lengths still at hand can reach in
the rest, and the combination that fills it furthest (of equally full ones the one
with the longest pieces) is taken and removed. A combination that is the fullest
stays so as long as its pieces last, so equal bins are made at once: at most some
`capacity * ln(capacity)` patterns describe any number of sequences. A piece's number among all pieces of
its length then leads to its pattern, its sequence and its place there by joins
with tables of bounded size; no group of pieces is gathered for it.

The numbers within a length are those inside a task's written part plus those of
the parts before it, so a length that a third of all pieces share is no hot key.

Defined results: a null text is empty and yields the end id alone; rows that
repeat an id are documents each; a null id is kept as null; a text of any length
is cut into pieces of `capacity`, of which the first may be shorter; an empty
table gives an empty result. Columns other than id and text aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_pieces import ByteEncoder
from .common import checked_broadcast, new_path, written

PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, place long"
#: Bytes of ids that a task gathers before it hands them on.
BATCH_BYTES = 8 << 20


def cut_lengths(length: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all but the first are full."""
    first = (length - 1) % capacity + 1
    return [first] + [capacity] * ((length - first) // capacity)


def cutter(tokenizer_path: str, capacity: int, end_id: int):
    """Tokenises a task's documents: a row a piece with its ids and its number among the task's pieces of that length."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seen = TaskContext.get().partitionId(), ByteEncoder.at(tokenizer_path), [0] * (capacity + 1)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1), end_id), strict=True):
                start = 0
                for piece, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    rows.append((doc_id, piece, start, length, ids[4 * start : 4 * (start + length)], part, seen[length]))
                    seen[length] += 1
                    start += length
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def fullest(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of the combination that fills `capacity` furthest; lengths rise, and of equally full ones that with the longest pieces wins."""
    mask = (1 << (capacity + 1)) - 1
    reach, before = 1, []
    for length, count in zip(lengths, counts, strict=True):
        before.append(reach)
        left, step = min(count, capacity // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << (step * length)) & mask
            left -= step
            step *= 2
    total, taken = reach.bit_length() - 1, []
    for length, count, sums in zip(reversed(lengths), reversed(counts), reversed(before), strict=True):
        n = min(count, total // length)
        while not sums >> (total - n * length) & 1:
            n -= 1
        if n:
            taken.append((length, n))
            total -= n * length
    return taken


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many sequences, their (length, how many of it) each) by minimum bin slack until no piece is left."""
    left, made = {k: counts[k] for k in sorted(counts) if counts[k]}, []
    while left:
        longest = next(reversed(left))
        others = left | {longest: left[longest] - 1}
        if not others[longest]:
            del others[longest]
        best = Counter(dict(fullest(list(others), list(others.values()), capacity - longest)) if longest < capacity else {})
        best[longest] += 1
        times = min(left[length] // n for length, n in best.items())
        made.append((times, sorted(best.items(), reverse=True)))
        for length, n in best.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
    return made


def intervals(made: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end, how many in a sequence, first sequence, offset there) of each pattern and length."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, parts in made:
        offset = 0
        for length, n in parts:
            first = used.get(length, 0)
            used[length] = first + times * n
            out.append((length, first, used[length], n, sequence, offset))
            offset += n * length
        sequence += times
    return out


def cut_documents(df: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece, written: doc_id, piece, start, length, ids (little-endian 32-bit), part, place (its number among the part's pieces of that length)."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = rows.mapInArrow(cutter(tokenizer_path, capacity, end_id), PIECES)
    path = new_path(df.sparkSession, "pieces")
    cut.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(cut.schema).parquet(path)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """The pieces of cut_documents with sequence_id and offset."""
    spark = pieces.sparkSession
    sizes = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "sizes")
    counts = dict(sizes.groupBy("length").agg(F.sum("n")).collect())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    plan = spark.createDataFrame(intervals(patterns(counts, capacity)), "length int, _first long, _end long, _each long, _sequence long, _offset long")
    numbered = pieces.join(checked_broadcast(offsets, sizes.count()), ["part", "length"]).withColumn("_number", F.col("_before") + F.col("place"))
    # at most capacity * ln(capacity) rows, whatever the input
    placed = numbered.join(F.broadcast(plan), "length").where((F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_end")))
    at = F.col("_number") - F.col("_first")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids",
        (F.col("_sequence") + F.expr("(_number - _first) div _each")).alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids, sequence_id, offset."""
    return pack(cut_documents(df, tokenizer_path, capacity, end_id, id_col, text_col), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences to train on: sequence_id, ids (little-endian 32-bit), n_tokens, and the pieces' ends in it. A sequence holds `capacity` pieces at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda out, x: F.concat(out, x["ids"]))
    return whole.select("sequence_id", ids.alias("ids"), F.transform("p", lambda x: x["offset"] + x["length"]).alias("ends")).withColumn("n_tokens", F.octet_length("ids") / 4)


def slack(lengths: np.ndarray, capacity: int) -> tuple[int, int]:
    """Sequences that the packing needs, and the least that any packing could need."""
    values, n = np.unique(lengths, return_counts=True)
    made = patterns(dict(zip(map(int, values), map(int, n), strict=True)), capacity)
    return sum(t for t, _ in made), -(-int(lengths.sum()) // capacity)
