"""Exact nearest vectors without all pairs: blocks of vectors around pivots, skipped by a bound on their products.

For a vector d near a pivot c, d.q = c.q + (d - c).q <= c.q + |d - c| |q|. So one
product with the pivot bounds those of all vectors within a radius of it. Pivots are
a bounded sample of the vectors; they steer only how much is skipped, never what is
found. Products are worked out as matrices of doubles and rounded to nine digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut

#: Pivots, and vectors of each section that are tried first.
PIVOTS, FIRST = 128, 400
#: Rows of query vectors that travel to the tasks at once.
QUERY_BLOCK = 20_000
#: Rows of a side of one unit of a join.
UNIT = 2_000
#: What rounding can add to a product, so that bounds skip nothing that ties.
MARGIN = 2e-9


def matrix(vectors: pa.Array) -> np.ndarray:
    """Arrays of numbers, all of one length, as a matrix of doubles."""
    if not len(vectors):
        return np.zeros((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def drawn(vectors: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """n vectors (of each group) by a hash of their components, the same ones in every run."""
    key = F.xxhash64("embedding")
    if not by:
        return vectors.orderBy(key).limit(n)
    return vectors.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where(F.col("_n") <= n).drop("_n")


def pivots_of(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray:
    found = drawn(vectors.select("embedding").where("embedding is not null").distinct(), n).collect()
    return np.array([r[0] for r in found], dtype=np.float64)


def nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest pivot, and its distance to it."""
    d2 = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T
    home = d2.argmin(axis=1)
    return home, np.sqrt(((x - pivots[home]) ** 2).sum(axis=1)) * (1 + 1e-9)


class Asked:
    """The chunks of some queries: vectors, where each query's begin, and each section's score to beat."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (str(r["query_id"]), r["chunk_idx"]))
        self.vectors = np.array([r["embedding"] for r in rows], dtype=np.float64)
        self.sizes = np.sqrt((self.vectors**2).sum(axis=1)) * (1 + 1e-9)
        self.chunks = [r["chunk_idx"] for r in rows]
        ids = [r["query_id"] for r in rows]
        self.starts = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
        self.ids = [ids[k] for k in self.starts]
        self.ends = [*self.starts[1:], len(ids)]
        self.beat: dict = {}

    def best(self, x: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some queries, each row's best product, and the chunk that has it (of equal ones the first)."""
        columns = np.concatenate([np.arange(self.starts[q], self.ends[q]) for q in queries])
        sims = np.round(x @ self.vectors[columns].T, 9)
        at = np.cumsum([0, *(self.ends[q] - self.starts[q] for q in queries[:-1])])
        score = np.maximum.reduceat(sims, at, axis=1)
        chunk = np.empty(score.shape, np.int64)
        for k, q in enumerate(queries):
            chunk[:, k] = self.starts[q] + sims[:, at[k] : at[k] + self.ends[q] - self.starts[q]].argmax(axis=1)
        return score, chunk


def top_of_task(asked, pivots: np.ndarray, top_k: int, count: Accumulator | None, schema: pa.Schema):
    """A task's best documents of each query and section; a running k-th score skips blocks and queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Asked = asked.value
        held: dict[tuple, list] = {}
        beat: dict = {s: list(v) for s, v in a.beat.items()}
        at_pivots = pivots @ a.vectors.T
        for batch in batches:
            if not batch.num_rows:
                continue
            sections, ids, x = batch.column(0).to_pylist(), batch.column(1).to_pylist(), matrix(batch.column(2))
            home, apart = nearest_pivot(x, pivots)
            places: dict = {}
            for k, (s, p) in enumerate(zip(sections, home.tolist(), strict=True)):
                places.setdefault(s, {}).setdefault(p, []).append(k)
            for s, blocks in places.items():
                need = np.array(beat.setdefault(s, [-np.inf] * len(a.ids)))
                bounds = {p: np.maximum.reduceat(at_pivots[p] + apart[rows].max() * a.sizes, a.starts) for p, rows in blocks.items()}
                for p in sorted(bounds, key=lambda p: -bounds[p].max()):
                    open_ = np.flatnonzero(bounds[p] >= need - MARGIN)
                    if not len(open_):
                        continue
                    rows = blocks[p]
                    score, chunk = a.best(x[rows], open_)
                    if count is not None:
                        count.add(len(rows) * int(sum(a.ends[q] - a.starts[q] for q in open_)))
                    for k, q in enumerate(open_):
                        mine = held.setdefault((q, s), [])
                        mine += [(-score[r, k], ids[rows[r]], a.chunks[chunk[r, k]]) for r in np.flatnonzero(score[:, k] >= need[q])]
                        if len(mine) > top_k:
                            mine.sort(key=lambda m: m[:2])
                            del mine[top_k:]
                        if len(mine) == top_k:
                            need[q] = max(need[q], -max(mine)[0])
                beat[s] = need.tolist()
        rows = [(a.ids[q], s, doc_id, -score, chunk) for (q, s), mine in held.items() for score, doc_id, chunk in mine]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 5, schema, strict=True)], schema=schema)

    return run


def top_products(corpus: DataFrame, chunks: DataFrame, top_k: int, count: Accumulator | None = None) -> DataFrame:
    """(query_id, section, doc_id, score, best_chunk): each query's documents of a section with the greatest product with one of its chunks; at least the first `top_k` by score and doc_id, in any order.

    Query vectors go to the tasks in blocks of QUERY_BLOCK rows, whole queries
    each; the corpus isn't shuffled, and a task hands on `top_k` rows a query and
    section at most. count: adds up the products that were worked out.
    """
    spark = corpus.sparkSession
    docs = corpus.select("section", "doc_id", "embedding").where("embedding is not null")
    pivots = pivots_of(docs)
    fields = {"query_id": chunks.schema["query_id"].dataType, "section": corpus.schema["section"].dataType, "doc_id": corpus.schema["doc_id"].dataType, "score": T.DoubleType(), "best_chunk": chunks.schema["chunk_idx"].dataType}
    schema = T.StructType([T.StructField(n, t) for n, t in fields.items()])
    if not len(pivots):
        return spark.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    tried = [(r["section"], r["embedding"]) for r in drawn(docs, FIRST, ["section"]).select("section", "embedding").collect()]
    out = None
    for some in query_blocks(chunks):
        asked = Asked(some)
        for section in {s for s, _ in tried}:
            score, _ = asked.best(np.array([v for s, v in tried if s == section], dtype=np.float64), np.arange(len(asked.ids)))
            if len(score) >= top_k:  # as many of the section's documents reach this much
                asked.beat[section] = np.sort(score, axis=0)[-top_k].tolist()
        found = docs.mapInArrow(top_of_task(spark.sparkContext.broadcast(asked), pivots, top_k, count, arrow), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def query_blocks(chunks: DataFrame) -> Iterator[list]:
    """The chunks' rows in blocks of whole queries, some QUERY_BLOCK rows each."""
    sizes = chunks.where("embedding is not null").groupBy("query_id").agg(F.count("*").alias("n"))
    blocks = -(-(sizes.agg(F.sum("n")).collect()[0][0] or 0) // QUERY_BLOCK)
    for k in range(blocks):
        rows = chunks.select("query_id", "chunk_idx", "embedding").where(F.col("embedding").isNotNull() & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)).collect()
        if rows:
            yield rows


def with_home(pivots: np.ndarray, threshold: float, radii: np.ndarray | None, schema: pa.Schema):
    """Rows with their nearest pivot and distance; with radii, rows (of the block, id, vector, pivot, home or visit) for each pivot a row has to be held against."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(2))
            home, apart = nearest_pivot(x, pivots)
            if radii is None:
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(apart)], schema=schema)
                continue
            reach = x @ pivots.T + np.sqrt((x * x).sum(axis=1) * (1 + 1e-9))[:, None] * radii[None]
            visits = (reach >= threshold - MARGIN) & (np.arange(len(pivots))[None] > home[:, None]) & (radii[None] >= 0)
            row, pivot = np.nonzero(visits)
            take = np.concatenate([np.arange(len(x)), row])
            at = np.concatenate([home, pivot]).astype(np.int32)
            visitor = np.concatenate([np.zeros(len(x), bool), np.ones(len(row), bool)])
            picked = pa.array(take)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), batch.column(2).take(picked), pa.array(at), pa.array(visitor)], schema=schema)

    return run


def products_of_unit(threshold: float, count: Accumulator | None, schema: pa.Schema):
    """A unit of two slices (or of one slice with itself): its pairs that reach the threshold."""

    def run(unit: pa.Table) -> pa.Table:
        side, ids, x = unit.column("_side").to_numpy(), unit.column("id").to_pylist(), matrix(unit.column("embedding").combine_chunks())
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = unit.column("_kind")[0].as_py() == 0 and unit.column("_i")[0].as_py() == unit.column("_j")[0].as_py()
        if count is not None:
            count.add(len(left) * (len(left) - 1) // 2 if alone else len(left) * len(right))
        sims = np.round(x[left] @ x[left if alone else right].T, 9)
        a, b = np.nonzero((sims >= threshold) & (np.arange(len(left))[:, None] < np.arange(len(left))[None] if alone else True))
        first, second = [ids[k] for k in left[a]], [ids[k] for k in (left if alone else right)[b]]
        pairs = [(p, q) if p < q else (q, p) for p, q in zip(first, second, strict=True)]
        block = unit.column(0)[0].as_py()
        return pa.Table.from_arrays([pa.array([block] * len(pairs), schema.field(0).type), pa.array([p for p, _ in pairs], schema.field(1).type), pa.array([q for _, q in pairs], schema.field(2).type), pa.array(sims[a, b])], schema=schema)

    return run


def similar_pairs(vectors: DataFrame, block: str, threshold: float, count: Accumulator | None = None) -> DataFrame:
    """(block, a, b, sim), a < b: each pair of a block with a product of `threshold` or more, once; vectors (block, id, embedding).

    Each vector lives with its nearest pivot and visits those pivots of greater
    number whose vectors it could reach. Vectors and visitors of a pivot are dealt
    into slices of some UNIT rows, and two slices meet in a task: a pivot with a
    third of all vectors makes many units of the usual size.
    """
    spark = vectors.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = vectors.select(block, "id", "embedding").where(F.col("embedding").isNotNull())
    kinds = [rows.schema[c].dataType for c in (block, "id")]
    out = T.StructType([T.StructField(block, kinds[0]), T.StructField("a", kinds[1]), T.StructField("b", kinds[1]), T.StructField("sim", T.DoubleType())])
    pivots = pivots_of(rows)
    if not len(pivots):
        return spark.createDataFrame([], out)
    homes = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("apart", T.DoubleType())])
    radius = dict(rows.mapInArrow(with_home(pivots, threshold, None, to_arrow_schema(homes)), homes).groupBy("home").agg(F.max("apart")).collect())
    radii = np.array([radius.get(k, -1.0) for k in range(len(pivots))])
    spread = T.StructType([*rows.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("visitor", T.BooleanType())])
    dealt = cut(rows.mapInArrow(with_home(pivots, threshold, radii, to_arrow_schema(spread)), spread))
    keys = [block, "pivot"]
    slices = lambda n: F.greatest(F.ceil(n / F.lit(UNIT)), F.lit(1)).cast("int")
    sizes = dealt.groupBy(*keys).agg(slices(F.count_if(~F.col("visitor"))).alias("_h"), slices(F.count_if("visitor")).alias("_v"), F.count_if("visitor").alias("_visitors"))
    mine = dealt.join(sizes, keys).withColumn("_slice", F.pmod(F.xxhash64("id"), F.when(F.col("visitor"), F.col("_v")).otherwise(F.col("_h"))).cast("int"))
    # a slice meets itself, the home slices behind it, and all slices of visitors
    unit = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    s = F.col("_slice")
    own = F.transform(F.sequence(F.lit(0), F.col("_h") - 1), lambda o: unit(0, F.least(s, o), F.greatest(s, o), 0).withField("side", F.when(o < s, 1).otherwise(0)))
    met = F.when(F.col("_visitors") > 0, F.transform(F.sequence(F.lit(0), F.col("_v") - 1), lambda o: unit(1, s, o, 0))).otherwise(F.expr("cast(array() as array<struct<kind:int,i:int,j:int,side:int>>)"))
    calls = F.transform(F.sequence(F.lit(0), F.col("_h") - 1), lambda o: unit(1, o, s, 1))
    each = mine.withColumn("u", F.explode(F.when(F.col("visitor"), calls).otherwise(F.concat(own, met))))
    each = each.select(block, "id", "embedding", "pivot", F.col("u.kind").alias("_kind"), F.col("u.i").alias("_i"), F.col("u.j").alias("_j"), F.col("u.side").alias("_side"))
    return each.groupBy(block, "pivot", "_kind", "_i", "_j").applyInArrow(products_of_unit(threshold, count, to_arrow_schema(out)), out)
