"""Mixing sources to target weights by temperature, in built-in expressions only.

A source's weight is its share of all tokens raised to an exponent in [0, 1]
and normalised. The exponent is bisected: the largest one whose weights reach
a target entropy, or the smallest one that repeats no source more than a limit.
The weights are realised under a token budget. Each source is put into a seeded
block permutation (blocks by shuffle key, then rows within the block); it is
passed over as often as its quota holds whole passes, and the rest of the quota
takes a prefix of the permutation.

Without a budget the smallest one is taken under which every document of every
source is used at least once, so the mixture repeats scarce sources and drops
nothing.

The bisection tries 63 exponents a pass, so eight passes over the table of
sources stand for 48 halvings; the table stays distributed, however long.

Defined results: a null source is a source of its own; null and blank texts
have no tokens; a source without tokens has weight 0 and each of its rows is
used once; rows that repeat an id are rows of their own; an empty table gives
no rows. The operator's columns (n_tokens, exponent, mix_weight, quota, copies)
replace input columns of those names; all other columns, whatever their names,
are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_by, written
from .ranking import block_rows, carried, group_key, key_fraction, numbered, shuffle_key, unpacked

OWN = ("n_tokens", "exponent", "mix_weight", "quota", "copies")
#: Exponents that one pass over the sources tries, and passes: they find it to 2 ** -48.
TRIED, PASSES = 63, 8


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def bisected(good: Callable[[list[float]], list[bool]]) -> float:
    """The largest exponent in [0, 1] for which good holds, good holding from 0 up to it."""
    if good([1.0])[0]:
        return 1.0
    low, width = 0.0, 1.0
    for _ in range(PASSES):
        width /= TRIED + 1
        held = good([low + width * (k + 1) for k in range(TRIED)])
        low += width * (held.index(False) if False in held else TRIED)
    return low


def source_weights(sizes: DataFrame, entropy: float | None, repeat_limit: float, budget: int | None) -> tuple[DataFrame, float]:
    """(_src, mix_weight, quota) of the sources with tokens, and the exponent.

    Whatever the number of sources, they stay distributed: a pass sums the powers
    of their shares for TRIED exponents at once, and only the sums come back.
    """
    live = sizes.where("tokens > 0")
    n, total, least, most = live.agg(F.count("*"), F.sum("tokens").cast("double"), F.min("tokens").cast("double"), F.max("tokens").cast("double")).collect()[0]
    total, scarce, ample = (total, least / total, most / total) if n else (1.0, 1.0, 1.0)
    share = F.col("tokens") / F.lit(total)

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        """For each exponent a: the sums of p ** a and of p ** a * ln p."""
        of = [x for a in exponents for x in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)))]
        row = live.agg(*[x.alias(f"s{k}") for k, x in enumerate(of)]).collect()[0]
        return [(row[2 * k] or 1.0, row[2 * k + 1] or 0.0) for k in range(len(exponents))]

    if entropy is not None:
        # of w = p**a / z: ln z - a * sum(p**a ln p) / z, which falls as the exponent rises to 1
        exponent = bisected(lambda tried: [math.log(z) - a * s / z >= entropy * math.log(max(n, 1)) for a, (z, s) in zip(tried, sums(tried), strict=True)])
    elif budget:
        # the repeats of the scarcest source fall as the exponent rises: 1 - exponent rises from 0
        repeats = lambda tried: [budget * scarce**a / z / (scarce * total) for a, (z, _) in zip(tried, sums(tried), strict=True)]
        exponent = 1 - bisected(lambda rises: [r <= repeat_limit for r in repeats([1 - x for x in rises])])
    else:
        exponent = 1 - bisected(lambda rises: [(ample / scarce) ** x <= repeat_limit for x in rises])
    ((z, _),) = sums([exponent])
    # the smallest budget that uses each source once: tokens / weight is greatest for the ample one
    whole = float(budget) if budget else total * z * ample ** (1 - exponent)
    weight = F.pow(share, F.lit(exponent)) / F.lit(z)
    return live.select("_src", weight.alias("mix_weight"), (weight * F.lit(whole)).alias("quota")), exponent


def mix_sources(df: DataFrame, entropy: float | None = None, repeat_limit: float = 2.0, budget: int | None = None, seed: int = 11, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = "text") -> DataFrame:
    """df with n_tokens, exponent, mix_weight, quota (its source's tokens) and copies (how often the row is used).

    entropy: target as a share of the entropy of equal weights; if None,
    repeat_limit rules. text_col None: df has n_tokens already.
    """
    own = tuple(c for c in OWN if c != text_col)
    counted = n_tokens(F.col(text_col)) if text_col else F.col("n_tokens")
    plain = df.select(carried(df, own).alias("row"), F.col(id_col).alias("_id"), group_key(F.col(source_col)).alias("_src"), counted.alias("_tokens"))
    plain = plain.withColumn("_key", shuffle_key(seed, F.col("_id"), F.col("_tokens")))
    sizes = written(plain.groupBy("_src").agg(F.count("*").alias("n"), F.sum("_tokens").alias("tokens")), "sizes")
    rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    weights, exponent = source_weights(sizes, entropy, repeat_limit, budget)
    about = written(sizes.join(weights, "_src", "left").withColumn("_of", F.col("n")), "about")
    plain = joined_by(plain, about, "_src")
    block = F.floor(key_fraction(F.col("_key")) * F.ceil(F.col("_of") / block_rows(rows)))
    placed = numbered(plain, "_src", block, [F.col("_key"), F.col("_id"), F.col("_tokens")], "_before", weight="_tokens")
    # a hair over, so that a quota of exactly one pass isn't lost to rounding
    passes = F.floor(F.col("quota") / F.col("tokens") + F.lit(1e-9))
    rest = F.col("quota") - passes * F.col("tokens")
    copies = F.when(F.col("tokens") > 0, passes + F.when(F.col("_before") < rest - F.col("tokens") * F.lit(1e-9), 1).otherwise(0)).otherwise(1)
    made = {"n_tokens": F.col("_tokens"), "exponent": F.when(F.col("tokens") > 0, F.lit(exponent)), "mix_weight": F.coalesce("mix_weight", F.lit(0.0)), "quota": F.coalesce("quota", F.lit(0.0)), "copies": copies.cast("long")}
    return placed.select(*unpacked(df, own), *[c.alias(name) for name, c in made.items()])


def mixed(df: DataFrame, **how) -> DataFrame:
    """df's own columns, each row as often as the mixture uses it."""
    used = mix_sources(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(how.get(f"{c}_col", d)).alias(c) for c, d in (("id", "doc_id"), ("source", "source"), ("text", "text"))]), **{k: v for k, v in how.items() if not k.endswith("_col")}, id_col="id", source_col="source", text_col="text")
    copied = used.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return copied.select(*unpacked(df))
