"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as lower-cased words joined by single blanks,
with a blank before the first and after the last, so an item stands for whole
words: "cat" is not found in "concatenate", and a longer item that begins or ends
inside a word pays an edit for that.
An item of L characters may differ in at most ``rate * L`` edits. It is split
into one piece more than that budget, so at least one piece stands unchanged in
any stretch of text within the budget. An Aho-Corasick automaton finds all
piece hits in one pass over a text; each hit gives the window in which the item
would have to lie, and Myers' bit-parallel search gives the least distance
there. Windows of an item that overlap are searched as one.

The items are a stated query set. They are read in blocks of about
`block_items` (some MB). One block is shipped to the tasks and held against all
documents before the next is read, so a larger benchmark takes more passes, not
more memory; where there are several, each pass is written to the shared folder.

Defined results: null texts and items count as empty; an item without words
matches nothing; items shorter than one character per piece use single
characters; one row for each document row and item that match, the closest
stretch first in the text; rows that repeat an id give rows each; item rows
that repeat an id are searched each; `decontaminate` drops the rows that match
any item and keeps all columns, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import best_match, places
from .common import written

WORD = re.compile(r"\w+")
RATE, BLOCK_ITEMS = 0.06, 20_000


def normal(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in budget + 1 parts of nearly equal length, with their places."""
    n = min(budget + 1, len(item))
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, f" {t} ", int(len(t) * rate)) for i, t in items if t]
        self.places: dict[int, dict] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget) in enumerate(self.items):
            for at, piece in pieces(text, budget):
                found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, whose in found.items():
            self.automaton.add_word(piece, (len(piece), whose))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, budget, end in the normalised text) for each item that occurs within its budget."""
        if not self.items or not text:
            return []
        length_of_text, text = len(text), f" {text} "
        windows: dict[int, list[list[int]]] = {}
        for end, (length, whose) in self.automaton.iter(text):
            for k, at in whose:
                _, item, budget = self.items[k]
                start = end + 1 - length - at
                a, b = max(0, start - budget), min(len(text), start + len(item) + budget)
                mine = windows.setdefault(k, [])
                if mine and a <= mine[-1][1]:
                    mine[-1] = [min(a, mine[-1][0]), max(b, mine[-1][1])]
                else:
                    mine.append([a, b])
        out = []
        for k, mine in windows.items():
            item_id, item, budget = self.items[k]
            where = self.places.setdefault(k, places(item))
            best = None
            for a, b in mine:
                hit = best_match(item, where, text[a:b], budget if best is None else best[0] - 1)
                if hit:
                    best = (hit[0], a + hit[1])
                    if not hit[0]:
                        break
            if best:
                # without the blanks on both sides
                out.append((item_id, best[0], budget, min(length_of_text, max(0, best[1] - 2))))
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, block_items: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks of about block_items there are, and the normalised items of each."""
    items = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    n = max(1, -(-items.count() // block_items))
    return n, read_blocks(items, n)


def read_blocks(items: DataFrame, n: int) -> Iterator[list[tuple[int, str]]]:
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        yield sorted((r.item if r.item is not None else -1, normal(r.text)) for r in rows)


def finder(block: list[tuple[int, str]], rate: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block, rate)
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in matcher.find(normal(t))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "distance", "budget", "ends_at"])

    return run


def find_leaks(df: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, distance, budget, ends_at) of all matches."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    n, each = blocks(items, item_col, item_text_col, block_items)
    for block in each:
        found = docs.mapInArrow(finder(block, rate), "doc_id long, item_id long, distance int, budget int, ends_at int")
        found = written(found, "leaks") if n > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(df: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """df without the rows that hold an item; each block of items is a filter, without a shuffle."""
    n, each = blocks(items, item_col, item_text_col, block_items)
    for block in each:

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for batch in batches:
                texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
                yield batch.filter(pa.array([not matcher.find(normal(t)) for t in texts], pa.bool_()))

        df = df.mapInArrow(clean, df.schema)
        df = written(df, "clean") if n > 1 else df
    return df
