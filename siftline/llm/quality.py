"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

Grades are 0 (toxic), 1 (poor) and 2 (clean), made of the labels' toxic and
quality flags; toxic is the end of the scale, as more toxic words only make a
text more so. One weight vector over hashed features, shared by all
grades, scores a text; ordered thresholds cut the score's line into grades:
P(grade <= k) = sigmoid(threshold_k - score). From these follow the expected
grade and the tail probability P(grade = 2) by which documents are selected.

Features are sets, so long texts do not drown out a few telling words: words
and their beginnings of four to six letters, and for the whole text how often
words stand in capitals, end in marks, are bare marks, or repeat.

The model is fitted on the driver, on at most `max_train` labelled documents
chosen by a hash of their id (a documented bound, features only, some 20 MB).
Scoring reads every document, whole, with the weights (1 MB, fixed) shipped to
the tasks.

Defined results: null text counts as empty; null labels are not used; without
labelled rows, or with one grade only, every document gets that grade (2 where
there is none); rows that repeat an id are scored each; columns that the input
has beyond id and text may have any name and are carried along only by
`select_quality`; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
GRADES = 3
#: Distinct pieces whose features a worker keeps; beyond it the cache starts afresh.
CACHED_PIECES = 80_000
CORE = re.compile(r"\w+")
#: Upper ends of the shares that whole-text features tell apart (fixed values).
SHARES = (0.0, 0.02, 0.1, 0.3, 0.6, 1.0)


def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


class Pieces(dict):
    """For a blank-free piece: its hashed features, and whether it is in capitals, ends in marks, is all marks."""

    def __missing__(self, piece: str) -> tuple:
        if len(self) > CACHED_PIECES:
            self.clear()
        cores = CORE.findall(piece.lower())
        names = [f"w:{c}" for c in cores] + [f"{n}:{c[:n]}" for c in cores for n in (4, 5, 6) if len(c) > n]
        loud = len(piece) > 1 and piece.isupper()
        tail = len(piece) - len(piece.rstrip("!#$%&*+=<>@^~|"))
        self[piece] = out = (tuple(map(hashed, names)), loud, bool(cores) and tail > 0, not cores)
        return out


def bucket(share: float) -> int:
    return next(k for k, top in enumerate(SHARES) if share <= top)


def features(text: str | None, known: Pieces) -> np.ndarray:
    counts = Counter((text or "").split())
    found: set[int] = set()
    total = loud = marked = bare = 0
    for piece, n in counts.items():
        own, is_loud, is_marked, is_bare = known[piece]
        found.update(own)
        total += n
        loud += n * is_loud
        marked += n * is_marked
        bare += n * is_bare
    if total:
        top = max(counts.values()) / total
        whole = {"loud": loud / total, "marked": marked / total, "bare": bare / total, "same": 1 - len(counts) / total, "top": top}
        found.update(hashed(f"#{name}:{bucket(share)}") for name, share in whole.items())
    found.add(hashed(f"#size:{min(12, total.bit_length())}"))
    return np.fromiter(found, np.int32, len(found))


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k under the highest grade, a column each."""
        return 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds[None, :], -60, 60)))

    def score(self, rows: Iterable[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows])


def fit(rows: list[np.ndarray], grades: np.ndarray, least_epochs: int = 10, rate: float = 0.2, shrink: float = 3e-3, rare: float = 500.0, batch: int = 32, seed: int = 7) -> Ordinal:
    """Maximum likelihood by AdaGrad with soft thresholding, in a seeded order.

    Features of fewer than one in `rare` training texts (two at least) get no
    weight: they would only memorise single texts.
    """
    spread = np.bincount(np.concatenate(rows), minlength=BUCKETS) >= max(2, len(rows) / rare)
    rows = [r[spread[r]] for r in rows]
    rows = [r if len(r) else np.zeros(1, np.int32) for r in rows]
    w, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    cuts, cut_squares = np.array([-1.0, 1.0]), np.full(2, 1e-8)
    rng = np.random.default_rng(seed)
    # small samples are gone over more often, for about as many steps as the largest one gets
    for _ in range(max(least_epochs, min(200, 60_000 // len(rows)))):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            sizes = [len(rows[i]) for i in pick]
            flat = np.concatenate([rows[i] for i in pick])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            score, y = np.add.reduceat(w[flat], starts), grades[pick]
            edges = np.concatenate([np.full((len(pick), 1), -60.0), np.clip(cuts[None, :] - score[:, None], -60, 60), np.full((len(pick), 1), 60.0)], axis=1)
            below = 1 / (1 + np.exp(-edges))
            slope = below * (1 - below)
            at = np.arange(len(pick))
            p = np.maximum(below[at, y + 1] - below[at, y], 1e-9)
            # of the negative log likelihood
            by_score = (slope[at, y + 1] - slope[at, y]) / p
            g = np.repeat(by_score, sizes)
            used, place = np.unique(flat, return_inverse=True)
            g = np.bincount(place, g) / len(pick)
            squares[used] += g * g
            step = rate / np.sqrt(squares[used])
            new = w[used] - step * g
            w[used] = np.sign(new) * np.maximum(np.abs(new) - step * shrink, 0)
            by_cut = np.array([((-slope[at, c + 1] / p) * (y == c) + (slope[at, c + 1] / p) * (y == c + 1)).mean() for c in (0, 1)])
            cut_squares += by_cut**2
            cuts = cuts - rate * by_cut / np.sqrt(cut_squares)
            cuts[1] = max(cuts[1], cuts[0] + 1e-3)
    return Ordinal(w, cuts)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels with a quality and a toxic flag."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") < 1, 1).otherwise(2)
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Pieces()
    for batch in batches:
        rows = [features(t, known) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "grade", "features"])


def train(df: DataFrame, labels: DataFrame, max_train: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | int:
    """The fitted model, or the only grade there is."""
    sample = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    made = texts.select("doc_id", "grade", "text").mapInArrow(featured, "doc_id long, grade int, features binary")
    # of rows that repeat an id the one with the least features counts, so the bound holds and the model is the same each time
    got = made.groupBy("doc_id").agg(F.min(F.struct("features", "grade")).alias("r")).select("r.*").collect()
    got = sorted((r.features, r.grade) for r in got)
    grades = np.array([g for _, g in got], dtype=np.int64)
    if len(set(grades)) < 2:
        return int(grades[0]) if len(grades) else GRADES - 1
    return fit([np.frombuffer(f, np.int32) for f, _ in got], grades)


def scorer(model: Ordinal | int) -> Callable:
    weights = None if isinstance(model, int) else model.weights.astype(np.float32)

    known = Pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, int):
                below = np.tile([float(model <= k) for k in range(GRADES - 1)], (batch.num_rows, 1))
            else:
                now = Ordinal(weights, model.thresholds)
                below = now.at_most(now.score(features(t.as_py(), known) for t in batch.column(batch.num_columns - 1)).astype(float).reshape(-1))
            expected = (1 - below).sum(axis=1)
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(expected), pa.array(1 - below[:, -1])], names=[*batch.schema.names[:-1], "expected_grade", "p_clean"])

    return run


def score_quality(df: DataFrame, labels: DataFrame, least: float = 0.5, max_train: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, expected_grade, p_clean, kept (p_clean >= least)."""
    model = train(df, labels, max_train, id_col, text_col)
    out = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scorer(model), "doc_id long, expected_grade double, p_clean double")
    return out.withColumn("kept", F.col("p_clean") >= least)


def select_quality(df: DataFrame, labels: DataFrame, least: float = 0.5, max_train: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows and columns, without the rows that score_quality rejects; no shuffle."""
    model = train(df, labels, max_train, id_col, text_col)
    run = scorer(model)

    def only_good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(text_col))], names=["text"])
            (scored,) = run(iter([text]))
            yield batch.filter(pa.compute.greater_equal(scored.column(1), least))

    return df.mapInArrow(only_good, df.schema)
