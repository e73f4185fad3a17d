"""Exact row numbers inside large groups without a window over a whole group.

The frames here have columns of our own alone; a caller's row travels in one
struct column (`carried`), so its columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, joined_by, written

#: Rows per block; the number of blocks of large groups stays under BLOCKS.
BLOCK_ROWS, BLOCKS = 1_000, 50_000


def carried(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """The row as one struct, without the columns that the operator replaces."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return F.struct(*kept) if kept else F.struct(F.lit(None).cast("int").alias("_"))


def unpacked(df: DataFrame, without: tuple[str, ...] = (), row: str = "row") -> list[Column]:
    """The columns that carried() packed, df being the frame it was made of."""
    return [F.col(row).getField(c).alias(c) for c in df.columns if c not in without]


def shuffle_key(seed: int, *parts: Column) -> Column:
    """A seeded pseudo-random order that any SQL engine can repeat; null parts count as empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def key_fraction(key: Column) -> Column:
    """An md5 key's place in [0, 1), from its first seven hex digits."""
    return F.conv(F.substring(key, 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def block_rows(total: int) -> int:
    return max(BLOCK_ROWS, -(-total // BLOCKS))


def numbered(df: DataFrame, group: str | None, block: Column, order: list[Column], name: str, weight: str | None = None) -> DataFrame:
    """Adds `name`: the rows (or the sum of `weight`) before each row of its group, ordered by block, then by `order`.

    Blocks must rise with `order` and hold a bounded number of rows each; only
    their counts are gathered per group.
    """
    df = df.withColumn("_block", block)
    keys = ([group] if group else []) + ["_block"]
    size = F.sum(weight) if weight else F.count("*")
    counts = df.groupBy(*keys).agg(size.alias("_n"))
    before = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select(*[F.col(k).alias(f"_o{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), "offsets")
    inside = Window.partitionBy(*keys).orderBy(*order)
    place = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(inside) - 1
    same = F.col("_block") == F.col("_o_block")
    if group:
        same = same & (F.col(group) == F.col(f"_o{group}"))
    placed = df.withColumn("_in", place).join(checked_broadcast(offsets, offsets.count()), same)
    return placed.withColumn(name, F.col("_offset") + F.col("_in")).drop("_block", "_offset", "_in", *[f"_o{k}" for k in keys])


def with_sizes(df: DataFrame, group: str) -> tuple[DataFrame, int]:
    """df with _of (rows of its group), and the rows of all."""
    sizes = written(df.groupBy(group).agg(F.count("*").alias("n"), F.count("*").alias("_of")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    return joined_by(df, sizes, group), total


def group_key(source: Column) -> Column:
    """A source name that is never null: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))
