"""Folds over arrays whose time stays near linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: Elements whose results a fold gathers before it hands them on; appending one by one would copy all earlier ones each time.
AT_ONCE = 64


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state before it, item) of each item, an array<kind>; step gives the next state. Null items give what emit makes of them."""

    def one(s: Column, x: Column) -> Column:
        return F.struct(step(s["state"], x).alias("state"), F.concat(s["out"], F.array(emit(s["state"], x))).alias("out"))

    def block(o: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(o["state"].alias("state"), empty(kind).alias("out")), one)
        return once(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(o["out"], F.array(i["out"])).alias("out")))

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, F.lit(AT_ONCE)), lambda at: F.slice(xs, at + 1, F.lit(AT_ONCE)))
        start = F.struct(zero.alias("state"), empty(f"array<{kind}>").alias("out"))
        return F.when(F.size(xs) > 0, F.aggregate(blocks, start, block, lambda o: F.flatten(o["out"]))).otherwise(empty(kind))

    return once(items, whole)
