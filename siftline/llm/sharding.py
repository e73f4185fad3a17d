"""Sharding by proportional stratified interleaving.

Rows of each source get a seeded shuffle rank; rows of all sources are ordered
by fractional rank ``(rank + start) / rows of the source``, start being the
source's own seeded place in [0, 1), and the order is cut into equal runs, so
each shard holds every source in the mixture's proportion and shard sizes
differ by one row at most (law ``rows``).

No window sees a whole source or the whole table: rows fall into blocks by
their shuffle key (then by fractional rank), per-block counts give each block's
offset, and row numbers are taken within blocks (see ``ranking``).

Defined results: a null source is a source of its own; a null text has size 8;
rows that repeat an id count as rows of their own; the shuffle key is made of
doc_id, the text's checksum and size, beyond which rows are interchangeable; an
empty table gives no rows. The operator's columns (size, text_crc32, law,
shard, slot, grown_shard) replace input columns of those names; all other
columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import block_rows, carried, group_key, key_fraction, numbered, shuffle_key, unpacked, with_sizes

LAW = "rows"
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def sized(df: DataFrame, text_col: str = "text") -> DataFrame:
    """size: UTF-8 bytes of the text plus 8; text_crc32: its unsigned CRC-32."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return df.withColumns({"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text)})


def interleave_shards(df: DataFrame, shards: int = 24, seed: int = 20, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = "text") -> DataFrame:
    """df with size, text_crc32, law, shard, slot and grown_shard; text_col None: df has size and text_crc32 already."""
    own = OWN if text_col is None else tuple(c for c in OWN if c != text_col)
    if text_col:
        df = sized(df.drop(*own), text_col)
    facts = [F.col(c).alias(f"_{c}") for c in ("size", "text_crc32")]
    key = shuffle_key(seed, F.col(id_col), F.col("text_crc32"), F.col("size"))
    plain = df.select(carried(df, own).alias("row"), *facts, F.col(id_col).alias("_id"), group_key(F.col(source_col)).alias("_src"), key.alias("_key"))
    plain, total = with_sizes(plain, "_src")
    rows = block_rows(total)
    ranked = numbered(plain, "_src", F.floor(key_fraction(F.col("_key")) * F.ceil(F.col("_of") / rows)), [F.col("_key"), F.col("_id"), F.col("_text_crc32"), F.col("_size")], "_rank")
    # each source starts at a place of its own, so small sources spread over all shards
    ranked = ranked.withColumn("_frac", (F.col("_rank") + key_fraction(shuffle_key(seed, F.col("_src")))) / F.col("_of"))
    placed = numbered(ranked, None, F.floor(F.col("_frac") * max(1, -(-total // rows))), [F.col("_frac"), F.col("_src"), F.col("_rank")], "_pos")
    n = max(1, total)
    placed = placed.withColumn("_shard", F.expr(f"_pos * {shards} div {n}"))
    first = F.expr(f"(_shard * {n} + {shards - 1}) div {shards}")
    made = {"size": F.col("_size"), "text_crc32": F.col("_text_crc32"), "law": F.lit(LAW), "shard": F.col("_shard").cast("int"), "slot": (F.col("_pos") - first).cast("long"), "grown_shard": F.lit(None).cast("int")}
    return placed.select(*unpacked(df, own), *[c.alias(name) for name, c in made.items()])
