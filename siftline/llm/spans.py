"""Regex matches with their code-point offsets, as built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,match:string,before:string,after:string>"
#: Elements that a scan gathers before it hands them on; appending one by one would copy all earlier ones each time.
SCANNED = 64


def none_of(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once; a lambda would work it out for each element it is named in."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state before it, item) of each item, an array<kind>; step gives the next state.

    Folds append to arrays by copying, so results are gathered in blocks, and
    the time stays near linear in the number of items.
    """

    def one(s: Column, x: Column) -> Column:
        return F.struct(step(s["state"], x).alias("state"), F.concat(s["out"], F.array(emit(s["state"], x))).alias("out"))

    def block(o: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(o["state"].alias("state"), none_of(kind).alias("out")), one)
        return bound(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(o["out"], F.array(i["out"])).alias("out")))

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, F.lit(SCANNED)), lambda at: F.slice(xs, at + 1, F.lit(SCANNED)))
        start = F.struct(zero.alias("state"), none_of(f"array<{kind}>").alias("out"))
        return F.when(F.size(xs) > 0, F.aggregate(blocks, start, block, lambda o: F.flatten(o["out"]))).otherwise(none_of(kind))

    return bound(items, whole)


def matches(text: Column, pattern: str, only_if: Column | None = None) -> Column:
    """All leftmost non-overlapping matches; only_if names rows that can have any."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if only_if is None else F.when(only_if, found).otherwise(none_of("string"))


def located(text: Column, pattern: str, hits: Column, around: int = 0) -> Column:
    """Spans of hits, the column that matches() gave: what lies between the matches gives their places.

    before and after: up to `around` characters beside the match, no further than its neighbours' ends.
    """
    no_text = F.lit("")

    def pieces(b: Column) -> Column:
        gap, hit = (lambda i: F.get(b["gaps"], i)), (lambda i: F.coalesce(F.get(b["hits"], i), no_text))
        before = lambda i: F.right(F.concat(F.when(i > 0, hit(i - 1)).otherwise(no_text), gap(i)), F.lit(around)) if around else no_text
        after = lambda i: F.left(F.concat(gap(i + 1), hit(i + 1)), F.lit(around)) if around else no_text
        return F.transform(b["hits"], lambda h, i: F.struct(F.length(gap(i)).alias("gap"), h.alias("hit"), before(i).alias("before"), after(i).alias("after")))

    def span(pos: Column, x: Column) -> Column:
        start = pos + x["gap"]
        return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))

    def placed(b: Column) -> Column:
        return scanned(pieces(b), F.lit(0), lambda pos, x: pos + x["gap"] + F.length(x["hit"]), span, SPAN)

    found = bound(F.struct(F.when(F.size(hits) > 0, F.split(text, pattern, -1)).alias("gaps"), hits.alias("hits")), placed)
    return F.when(F.size(hits) > 0, found).otherwise(none_of(SPAN))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.split(F.reverse(number), "")
    each = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2 % 10) + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def listed(spans: Column) -> Column:
    """Sorted (.., kind, start, end) structs as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
