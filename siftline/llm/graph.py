"""Classes of similar texts from shared buckets: links without all pairs, and connected components by shuffles alone.

Nodes are numbers (long) that some earlier table gave out, so that every
aggregate here has a fixed width.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import similar_words
from .common import checked_broadcast, forget, written

#: Members of a bucket on either side of one unit of the last step.
BLOCK = 256
#: Steps of the size that the threshold allows in one band of sizes.
BAND = 2
#: Parts, by bands, in which what is apart is searched, and the rows that are worth another one.
SLICES, ROWS_A_SLICE = 8, 400_000
#: Pairs whose marks are held against each other at once.
PAIRS_AT_ONCE = 40_000
#: Pairs left possible by their marks that are collected before some are aligned.
PAIRS_KEPT = 50_000
#: Rows of blocks, and letters of their texts, that a task reads before it compares them.
ROWS_READ, LETTERS_READ = 40_000, 12_000_000
#: Pairs that meet at one copy of a text; a text with more pairs is dealt out in as many copies.
PAIRS_A_TEXT = 200


def near_enough(share: float):
    """Sizes that the similarity threshold allows."""
    return lambda a, b: F.least(a, b) >= F.greatest(a, b) * share


def word_bits(texts: list[str], width: int) -> np.ndarray:
    """A row of bits for each text: its words, each labelled with its occurrence, hashed."""
    out = np.zeros((len(texts), width), np.uint8)
    for row, text in zip(out, texts, strict=True):
        seen: dict = {}
        for word in text.split():
            seen[word] = n = seen.get(word, 0) + 1
            row[xxhash.xxh32_intdigest(f"{n} {word}") % width] = 1
    return out


@dataclass(frozen=True)
class Marks:
    """How texts are marked: bits(texts, width) gives a row of that many bits for each text, kept as `words` 64-bit numbers. One edit takes at most `per_edit` bits away. alike(firsts, seconds, share) tells which pairs are similar."""

    bits: Callable[[list[str], int], np.ndarray]
    per_edit: int
    words: int
    alike: Callable[[list[str], list[str], float], np.ndarray] = similar_words

    def marked(self, texts: DataFrame) -> DataFrame:
        """(node, bits, marks): how many bits are set, and the bits, of (node, text)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = self.bits(batch.column(1).to_pylist(), self.words * 64)
                ends = np.arange(len(rows) + 1, dtype=np.int32) * self.words
                marks = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.packbits(rows, axis=1).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows.sum(axis=1, dtype=np.int32)), marks], names=["node", "bits", "marks"])

        return texts.mapInArrow(run, "node long, bits int, marks array<long>")

    def sides(self, bands: np.ndarray, texts: list[str], share: float) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """How many bits are set, the texts' marks as ones of their bands, and all that a text similar to each may have there without a loss."""
        rows = self.bits(texts, self.words * 64)
        own = [row.tobytes() for row in np.packbits(rows, axis=1)]
        return rows.sum(axis=1, dtype=np.int32), own, own

    def lost(self, marks: np.ndarray, around: np.ndarray, bits: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many marks of one text (`bits` in all) the other one (`other` in all) lacks, or the other way round where that is more."""
        return np.bitwise_count(marks & ~around).sum(axis=1, dtype=np.int64) + np.maximum(0, other - bits)


def classes(rows: DataFrame, texts_of: Callable[[DataFrame], DataFrame], hold: Callable[[DataFrame], DataFrame], marks: Marks, share: float) -> DataFrame:
    """(id, root) of the nodes that have a similar one: root is the least node they are connected to.

    rows: bucket, node, size (of the text; sizes further apart than `share`
    allows are no pair; rows may repeat). texts_of: (node, text) for the nodes that a written frame names.
    hold: the pairs (a, b) that hold of those in a frame (a, b, text_a, text_b), as marks.alike tells.

    First every member of a bucket meets the bucket's least node: one pair a
    row, however large the bucket. What these links connect is settled. Then, in
    buckets that still hold more than one component, every member outside the
    bucket's largest component meets all members of other components, in blocks
    and within the sizes that the threshold allows; the block itself leaves out
    pairs whose marks already rule out enough similarity (a bound, not an
    estimate), aligns the others and hands on the links that connect something,
    fewer than it has members. So two members of a bucket go uncompared only
    where links connect them anyway or the bounds say that they can't be similar,
    and no step makes a row for each pair. The rule is the same at every bucket size.
    """
    fits = near_enough(share)
    kept = rows.select("bucket", "node", F.col("size").cast("int").alias("size")).repartition("bucket").sortWithinPartitions("bucket")
    members = written(kept.mapInArrow(shared, "bucket long, node long, size int, lead long, lead_size int"), "members")
    texts = texts_of(written(members.select("node").distinct(), "ids"))
    met = members.where((F.col("node") != F.col("lead")) & fits(F.col("size"), F.col("lead_size")))
    links = verified(met.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), texts, hold)
    roots = components(links)
    n_roots = roots.count()

    of = members.join(checked_broadcast(roots.withColumnRenamed("id", "node"), n_roots), "node", "left")
    of = written(of.select("bucket", "node", "size", F.coalesce("root", "node").alias("c")), "of")
    forget(members)
    parts = of.groupBy("bucket", "c").agg(F.count("*").alias("of"))
    largest = parts.groupBy("bucket").agg(F.max_by("c", "of").alias("most"), F.max("of").alias("in_most"), F.sum("of").alias("n"), F.count("*").alias("parts"))
    # in a bucket of two the first has met the only other
    largest = largest.where("parts > 1 and n > 2")
    largest = written(largest.select("bucket", "most", F.ceil(F.col("n") / BLOCK).cast("int").alias("across"), F.ceil((F.col("n") - F.col("in_most")) / BLOCK).cast("int").alias("down")), "largest")
    n_largest = largest.count()
    used = [of, largest]
    if n_largest:
        # a text is at home in the band of its size, and visits all bands that hold sizes near enough
        unit = math.log(1 / share)
        steps = F.log("size") / unit
        apart = of.join(checked_broadcast(largest, n_largest), "bucket").withColumn("outside", F.col("c") != F.col("most"))
        apart = apart.withColumn("home", F.floor(steps / BAND).cast("int")).withColumn("band", F.explode(F.sequence(F.floor((steps - 1) / BAND - 1e-6).cast("int"), F.floor((steps + 1) / BAND + 1e-6).cast("int"))))
        apart = written(apart.where(F.col("outside") | (F.col("home") == F.col("band"))).select("bucket", "node", "size", "c", "outside", (F.col("home") == F.col("band")).alias("home"), "band", "across", "down"), "apart")
        forget(of)
        # what has nothing to meet in a band needs no marks there
        ends = [f(F.when(F.col(w), F.col("c"))).alias(f"{w}_{n}") for w in ("home", "outside") for n, f in (("least", F.min), ("most", F.max))]
        other = lambda w: (F.col(f"{w}_least") != F.col("c")) | (F.col(f"{w}_most") != F.col("c"))
        here = apart.groupBy("bucket", "band").agg(*ends).where((F.col("home_least") != F.col("outside_least")) | (F.col("home_most") != F.col("outside_most")) | (F.col("home_least") != F.col("home_most")))
        left = apart.join(here, ["bucket", "band"]).withColumns({"comes": F.col("outside") & other("home"), "stays": F.col("home") & other("outside")})
        left = written(left.where("comes or stays").select("bucket", "node", "size", "c", "comes", "stays", "band", "across", "down"), "left")
        forget(apart)
        # blocks are of one band, so some bands at a time keep the texts on disk few
        slices = min(SLICES, -(-left.count() // ROWS_A_SLICE))
        parts = [written(apart_links(left.where(F.pmod("band", F.lit(slices)) == k), texts, marks, share), "found") for k in range(slices)]
        found = reduce(DataFrame.unionByName, parts) if parts else texts.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
        joined = components(found.distinct())
        roots = written(composed(roots, joined), "roots")
        used = [largest, left]
    for frame in [*used, texts]:
        forget(frame)
    return roots


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (bucket, node, size) sorted by bucket, each row of a bucket with several nodes once, with the least node and its size."""

    def made(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        bucket, node, size = map(np.concatenate, zip(*parts, strict=True))
        same = bucket[1:] == bucket[:-1]
        several = np.append(same, False) | np.append(False, same)
        bucket, node, size = bucket[several], node[several], size[several]
        order = np.lexsort((node, bucket))
        bucket, node, size = bucket[order], node[order], size[order]
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1]))[: len(bucket)]
        bucket, node, size = bucket[new], node[new], size[new]
        starts = np.nonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])[0]
        counts = np.diff(np.append(starts, len(bucket)))
        lead, lead_size = np.repeat(node[starts], counts), np.repeat(size[starts], counts)
        keep = np.repeat(counts > 1, counts)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (bucket, node, size, lead, lead_size)], names=["bucket", "node", "size", "lead", "lead_size"])

    parts: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [c.to_numpy() for c in batch.columns]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))  # where the last bucket begins, which may go on
        if cut or parts and parts[-1][0][-1] != columns[0][-1]:
            yield made([*parts, [c[:cut] for c in columns]])
            parts = []
        parts.append([c[cut:] for c in columns])
    if parts:
        yield made(parts)


def apart_links(left: DataFrame, texts: DataFrame, marks: Marks, share: float) -> DataFrame:
    """Links (a, b) between components some of whose members share a bucket and are similar. A task gives no more of them than it takes to connect what it has read."""
    place = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [F.xxhash64("bucket", "band", "i", "j").alias("block"), "node", "size", "c", "comes", "band", "text"]
    read = left.join(texts, "node")
    few = read.where("comes").withColumn("i", place(F.greatest("down", F.lit(1)), 1)).withColumn("j", each("across"))
    rest = read.where("stays").withColumn("comes", F.lit(False)).withColumn("j", place(F.col("across"), 2)).withColumn("i", each("down"))
    both = few.select(*columns).unionByName(rest.select(*columns)).repartition("block").sortWithinPartitions("block")

    def met(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        block, node, size, c, comes, band = (rows.column(k).to_numpy() for k in range(6))
        text = rows.column("text").to_pylist()
        # a text that comes in several blocks is marked once
        _, first, at = np.unique(np.stack([node, band.astype(np.int64)], axis=1), axis=0, return_index=True, return_inverse=True)
        at = at.ravel()
        bits, *sides = marks.sides(band[first], [text[i] for i in first], share)
        width = -(-max(map(len, sides[0])) // 8) * 8
        own, around = (np.frombuffer(b"".join(m.ljust(width, b"\0") for m in side), np.uint64).reshape(len(first), -1) for side in sides)
        ids, c = np.unique(c, return_inverse=True)
        root = np.arange(len(ids))
        order = np.lexsort((comes, block))  # those that stay first
        starts = np.nonzero(np.append(True, block[order][1:] != block[order][:-1]))[0]
        counts = np.diff(np.append(starts, len(order)))
        stay = np.add.reduceat((~comes[order]).astype(np.int64), starts)
        begin, n = np.repeat(starts, counts), np.repeat(stay, counts)
        coming = np.nonzero(comes[order])[0]
        ends = np.cumsum(n[coming])
        links, done, kept, n_kept = [], 0, [], 0
        while done < len(coming):
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS_AT_ONCE, side="right")))
            some = coming[done:to]
            many = n[some]
            u = np.repeat(order[some], many)
            x = order[np.arange(many.sum()) + np.repeat(begin[some] - (np.cumsum(many) - many), many)]
            done = to
            may = (root[c[u]] != root[c[x]]) & (np.minimum(size[u], size[x]) >= np.maximum(size[u], size[x]) * share)
            u, x = u[may], x[may]
            lost = marks.lost(own[at[x]], around[at[u]], bits[at[x]], bits[at[u]])
            most = np.floor(np.maximum(size[u], size[x]) * (1 - share) + 1e-9) * marks.per_edit
            near = np.nonzero(lost <= most)[0]
            kept.append((u[near], x[near], lost[near] / np.maximum(most[near], 1)))
            n_kept += len(near)
            if n_kept < PAIRS_KEPT and done < len(coming):
                continue
            u, x, lost = map(np.concatenate, zip(*kept, strict=True))
            kept, n_kept = [], 0
            pair = np.sort(np.stack([at[u], at[x]]), axis=0)
            once = np.unique(pair[0] * len(first) + pair[1], return_index=True)[1]
            root, made = connected(root, c[u[once]], c[x[once]], lost[once], lambda k, u=u[once], x=x[once]: marks.alike([text[i] for i in u[k]], [text[i] for i in x[k]], share))
            links += made
        if links:
            found = ids[np.array(links)]
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        rows = read = 0
        for batch in batches:
            if not len(batch):
                continue
            block = batch.column(0).to_numpy()
            cut = int(np.searchsorted(block, block[-1]))
            new = cut or parts and parts[-1].column(0)[-1].as_py() != block[-1]
            if new and (rows >= ROWS_READ or read >= LETTERS_READ):
                yield from met([*parts, batch.slice(0, cut)])
                parts, rows, read = [], 0, 0
                batch = batch.slice(cut)
            parts.append(batch)
            rows, read = rows + len(batch), read + batch.column(6).nbytes
        if parts:
            yield from met(parts)

    return both.mapInArrow(run, "a long, b long").distinct()


def connected(root: np.ndarray, a: np.ndarray, b: np.ndarray, order: np.ndarray, alike: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(root, links): the roots after the pairs (a, b) that alike() confirms, and those of them that connected something.

    Each component tries its most promising pair (least `order`), then four more, sixteen
    more and so on; pairs within what is connected by then are not looked at. So
    where most pairs hold, few are tried; where none does, all are.
    """
    todo, links, tries = np.argsort(order, kind="stable"), [], 1
    root = root.copy()
    while len(todo := todo[root[a[todo]] != root[b[todo]]]):
        by = np.argsort(root[a[todo]], kind="stable")
        of = root[a[todo]][by]
        starts = np.nonzero(np.append(True, of[1:] != of[:-1]))[0]
        now = np.zeros(len(todo), bool)
        now[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by)))) < tries
        some, todo, tries = todo[now], todo[~now], tries * 4
        for k in some[alike(some)]:
            ends = []
            for i in (int(a[k]), int(b[k])):
                while root[i] != i:
                    i = int(root[i])
                ends.append(i)
            if ends[0] != ends[1]:
                root[max(ends)] = min(ends)
                links.append((int(a[k]), int(b[k])))
        while (further := root[root]).tolist() != root.tolist():
            root = further
    return root, links


def dealt(pairs: DataFrame, texts: DataFrame, end: str, other: str) -> DataFrame:
    """pairs with the text of `end`; texts with very many pairs are copied, so no task holds all of one text's pairs."""
    hubs = written(pairs.groupBy(end).agg(F.count("*").alias("n")).where(F.col("n") > PAIRS_A_TEXT), "hubs")
    n_hubs = hubs.count()
    named = texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))
    if not n_hubs:
        return pairs.join(named, end)
    hubs = checked_broadcast(hubs.select(end, F.ceil(F.col("n") / PAIRS_A_TEXT).cast("int").alias("copies")), n_hubs)
    copied = named.join(hubs, end, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("copies"), F.lit(1)) - 1))).drop("copies")
    placed = pairs.join(hubs, end, "left").withColumn("copy", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    return placed.join(copied, [end, "copy"]).drop("copy")


def verified(pairs: DataFrame, texts: DataFrame, hold: Callable) -> DataFrame:
    """The pairs (a, b) whose texts align."""
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    both = dealt(dealt(pairs, texts, "a", "b"), texts, "b", "a")
    held = written(hold(both.select("a", "b", "text_a", "text_b")), "held")
    forget(pairs)
    return held


def composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """Two steps of (id, root) as one; ids that only the second knows are kept."""
    later = then.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    moved = first.join(checked_broadcast(later, later.count()), F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_root", "root").alias("root"))
    return moved.unionByName(then.join(first.select("id"), "id", "left_anti"))


def components(links: DataFrame) -> DataFrame:
    """(id, root): each linked id, roots too, with the least id of its component.

    Every vertex points to its least neighbour, pointers are followed to their
    ends by doubling, and the links are carried over to those ends; this halves
    the vertices at least, and goes on until no link is left. So the rounds, and
    the doublings in each, grow with the logarithm of the largest component.
    Neighbours meet in aggregates alone, whose partial results take care of
    stars. Every step is written to the shared folder.
    """
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "up")
        n = up.count()
        while True:
            ends = up.where("p <> u").select(F.col("u").alias("_u"), F.col("p").alias("q"))
            next_up = written(up.join(checked_broadcast(ends, n), F.col("p") == F.col("_u"), "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "up")
            forget(up)
            up = next_up.select("u", "p")
            if next_up.where("moved").isEmpty():
                break
        levels.append(up)
        moved = edges
        for end in ("u", "v"):
            at = checked_broadcast(up.select(F.col("u").alias("_u"), "p"), n)
            moved = moved.join(at, F.col(end) == F.col("_u")).withColumn(end, F.col("p")).drop("_u", "p")
        left = written(moved.where("u <> v").distinct(), "edges")
        forget(edges)
        edges = left
    if not levels:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    named = [x.select(F.col("u").alias("id"), F.col("p").alias("root")) for x in levels]
    out = named[-1]
    for level in reversed(named[:-1]):
        out = written(composed(level, out), "roots")
    return out
