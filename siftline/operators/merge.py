"""Deterministic assembly of selected slots and entries back into text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States and the default of a variant.
VARIANT_STATUSES = ("approved", "pending", "rejected")


def variant_status(status: Column) -> Column:
    return F.when(status.isin(*VARIANT_STATUSES), status).otherwise("approved")


def representative(variants: Column) -> Column:
    """Of an array of (id, text, status, used_count, created_at, ..) structs the approved one used most, then newest, then first."""
    ok = F.filter(variants, lambda v: (variant_status(v["status"]) == "approved") & (F.trim(F.coalesce(v["text"], F.lit(""))) != ""))
    ranked = F.transform(ok, lambda v, i: F.struct(F.coalesce(v["used_count"], F.lit(0)).alias("used"), F.coalesce(v["created_at"], F.lit("")).alias("at"), (-i).alias("pos"), v.alias("v")))
    best = F.reduce(ranked, F.get(ranked, F.lit(0)), lambda a, b: F.when((b["used"] > a["used"]) | ((b["used"] == a["used"]) & (b["at"] > a["at"])), b).otherwise(a))
    return best["v"]


def resolved(variants: Column, angle: Column) -> Column:
    """The first approved variant with the preferred angle, else the representative one."""
    fits = F.filter(variants, lambda v: (variant_status(v["status"]) == "approved") & F.array_contains(v["angles"], angle))
    return F.coalesce(F.get(fits, F.lit(0)), representative(variants))


def slot_union(achievements: DataFrame, highlights: DataFrame, keys: list[str]) -> DataFrame:
    """Slots of an entry: its achievements, then its non-blank highlights, trimmed; slot_index counts on."""
    own = Window.partitionBy(*keys).orderBy("kind", "pos")
    both = achievements.select(*keys, F.lit(0).alias("kind"), "pos", "text").unionByName(highlights.select(*keys, F.lit(1).alias("kind"), "pos", F.trim("text").alias("text")).where("text <> ''"))
    return both.withColumn("slot_index", F.row_number().over(own) - 1)


def emitted(slots: DataFrame, keys: list[str], most: int, order: str = "place") -> DataFrame:
    """The texts an entry shows: repeated texts once, where they stand first, at most `most`; out_pos counts from 0."""
    first = slots.where("text is not null").groupBy(*keys, "text").agg(F.min(order).alias(order))
    place = Window.partitionBy(*keys).orderBy(order)
    return first.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= most).withColumn("out_pos", F.col("_place") - 1).drop("_place")


def usage(shown: DataFrame, variant: str = "variant_id") -> DataFrame:
    return shown.where(F.col(variant).isNotNull()).groupBy(variant).agg(F.count("*").alias("times"))


def reordered_details(details: Column, keywords: Column) -> Column:
    """Comma-separated items, those that hold a keyword first; both parts keep their order."""
    items = F.filter(F.transform(F.split(details, ","), lambda x: F.trim(x)), lambda x: x != "")
    hit = lambda x: F.exists(keywords, lambda k: F.contains(F.lower(x), F.lower(k)))
    return F.array_join(F.concat(F.filter(items, hit), F.filter(items, lambda x: ~hit(x))), ", ")


def target(sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """Section frames (query_id, entry_index, text) as one document: (query_id, section_pos, section, entry_index, text)."""
    out = None
    for k, (name, df) in enumerate(sections):
        part = df.select("query_id", F.lit(k).alias("section_pos"), F.lit(name).alias("section"), "entry_index", "text")
        out = part if out is None else out.unionByName(part)
    return out
