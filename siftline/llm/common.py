"""Shared helpers: table access, lineage cuts in the shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest row count of a frame of a few numbers or digests a row (some 40 bytes, so 20 MB) that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Row count up to which such a frame is broadcast whole rather than its hot keys alone.
SMALL_ROWS = 20_000

#: Folders of our own, by application, where the session names none.
_own: dict[str, str] = {}

#: Spark's setting by which an action deletes its own shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if app not in _own:
            if master != "local" and not master.startswith("local["):
                raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
            _own[app] = f"file://{tempfile.mkdtemp(prefix='siftline-')}"
        base = _own[app]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siftline-{uuid.uuid4().hex}/{name}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go at the end of each action inside, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: a lineage cut that survives lost executors."""
    path = new_path(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checked_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted rows are within the limit; otherwise leave a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def joined_by(rows: DataFrame, facts: DataFrame, key: str | list[str], rows_a_key: int = 2_000) -> DataFrame:
    """rows with the columns of facts, a written frame with one row for each key and, as n, how many rows have it.

    A few facts are broadcast whole. Of many, those of keys with many rows are
    broadcast where their number is within bounds, so hot keys never meet in one
    task; the rest goes through a shuffle.
    """
    rest = facts.drop("n")
    if facts.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(rest), key)
    hot = written(facts.where(F.col("n") >= rows_a_key).drop("n"), "hot")
    n_hot = hot.count()
    if not n_hot:
        return rows.join(rest, key)
    if n_hot > BROADCAST_ROWS:
        return joined_by(rows, facts, key, rows_a_key * 10)
    marked = rows.join(F.broadcast(hot), key)
    return marked.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def ascii_lower(text):
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
