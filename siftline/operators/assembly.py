"""A selection turned back into a document: entries by index, slots in order, resolved texts, sections.

Frames: items (query_id, section, position, entry_index, slot_order array<int>,
angles map<int,string>), slots (section, entry_index, slot_index, ach_id, text,
variants), lines (query_id, section, place, entry_index, out_pos, slot_index,
text, ach_id, variant_id, angle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .merge import emitted, reordered_details, representative, resolved
from .places import placed
from .retrieval import small

EDITED, HANDLED = ("experience", "projects"), ("summary", "keywords", "experience", "projects", "education", "skills", "languages")
# Fixed value: what opens the line of keywords.
KEYWORDS_LINE = "Palabras clave: "


def latest(items: DataFrame, keys: list[str], order: str = "item") -> DataFrame:
    """Of a model's items that name the same entry the last one."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


def entries_of(items: DataFrame, entries: DataFrame, most: int | Column) -> DataFrame:
    """items whose entry exists, in order, `most` a query and section; place counts from 0. An index that names no entry is dropped, never invented."""
    known = items.join(entries.select("section", "entry_index").distinct(), ["section", "entry_index"])
    order = Window.partitionBy("query_id", "section").orderBy("position")
    # the filter on the number itself lets the planner limit groups before the shuffle
    return known.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).withColumn("place", F.col("_place") - 1).drop("_place")


def texts_of(slots: DataFrame) -> DataFrame:
    """slots with emittable: the text of a plain slot, or that of its representative variant; null where it has none."""
    return slots.withColumn("emittable", F.coalesce("text", representative(F.col("variants"))["text"]))


def assembled(items: DataFrame, slots: DataFrame, most_entries: int, most_slots: int) -> DataFrame:
    """Lines of the chosen entries: their slots in the chosen order, each by its preferred angle, equal texts once, `most_slots` at most.

    An entry whose order is empty or names no slot that can be shown falls back
    on its first slots.
    """
    chosen = entries_of(items, slots, most_entries)
    keys = ["query_id", "section", "entry_index"]
    ordered = chosen.select(*keys, "place", "angles", F.posexplode("slot_order").alias("at", "slot_index")).join(slots, ["section", "entry_index", "slot_index"])
    pick = F.when(F.size(F.coalesce("variants", F.array())) > 0, resolved(F.col("variants"), F.coalesce(F.try_element_at("angles", F.col("slot_index")), F.lit(""))))
    lines = shown(ordered.withColumn("v", pick), keys, most_slots)
    missing = chosen.join(lines.select(*keys).distinct(), keys, "left_anti")
    first = missing.select(*keys, "place").join(slots, ["section", "entry_index"]).withColumn("at", F.col("slot_index"))
    plain = F.when(F.size(F.coalesce("variants", F.array())) > 0, representative(F.col("variants")))
    return lines.unionByName(shown(first.withColumn("v", plain), keys, most_slots))


def shown(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    texts = rows.withColumn("text", F.coalesce("text", F.col("v")["text"])).where("text is not null")
    first = emitted(texts, keys, most, "at")
    named = texts.select(*keys, "place", "at", "slot_index", "ach_id", F.col("v")["id"].alias("variant_id"), F.coalesce(F.get(F.col("v")["angles"], F.lit(0)), F.lit("")).alias("angle"))
    return first.join(named, [*keys, "at"]).select("query_id", "section", "place", "entry_index", F.col("out_pos").cast("int").alias("out_pos"), "slot_index", "text", "ach_id", "variant_id", "angle")


def trace(lines: DataFrame) -> DataFrame:
    """Which variant each line shows; plain highlights leave no trace."""
    return lines.where("ach_id <> '' and variant_id <> ''").select("query_id", "section", "entry_index", "out_pos", "ach_id", "variant_id", "angle", "text")


def education(picked: DataFrame, entries: DataFrame, extra: int) -> DataFrame:
    """(query_id, place, entry_index): entry 0 always, then the picked others that exist, `extra` of them. entries: (section, entry_index)."""
    known = entries.where("section = 'education'").select("entry_index").distinct()
    order = Window.partitionBy("query_id").orderBy("position")
    more = picked.where("entry_index > 0").join(known, "entry_index").withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= extra)
    first = picked.select("query_id").distinct().join(known.where("entry_index = 0"), F.lit(True))
    return first.select("query_id", F.lit(0).alias("place"), "entry_index").unionByName(more.select("query_id", F.col("_place").alias("place"), "entry_index"))


def passed_through(entries: DataFrame) -> DataFrame:
    """Entries of sections that no step handles: they stay as they are."""
    return entries.where(~F.col("section").isin(*HANDLED))


def keyword_line(keywords: Column, show: bool = True) -> Column:
    """The visible line of verified keywords; null where there are none or it is switched off."""
    return F.when(F.lit(show) & (F.size(keywords) > 0), F.concat(F.lit(KEYWORDS_LINE), F.array_join(keywords, ", ")))


def with_manual(manual: Column, verified: Column, corpus_holds, most: int = 10) -> Column:
    """Manual keywords that the corpus holds first, then the verified ones, each string once. corpus_holds(keyword) is a column test."""
    own = F.filter(F.transform(manual, lambda x: F.trim(x)), lambda k: (k != "") & corpus_holds(k))
    return F.slice(F.array_distinct(F.concat(own, verified)), 1, most)


def missing_manual(manual: DataFrame, report: DataFrame) -> DataFrame:
    """Manual keywords that a report lacks in any case, after the report's own: (query_id, keyword, manual)."""
    low = report.select("query_id", F.lower("keyword").alias("_low")).distinct()
    more = manual.select("query_id", "keyword", F.lower("keyword").alias("_low")).join(low, ["query_id", "_low"], "left_anti")
    return report.select("query_id", "keyword", F.lit(False).alias("manual")).unionByName(more.select("query_id", "keyword", F.lit(True).alias("manual")))


def excluded_panel(slots: DataFrame, lines: DataFrame, scores: DataFrame) -> DataFrame:
    """Slots that a query's document doesn't show, with their scores (null where they have none), best first in each query.

    Slots are put in order once for all queries. A query's scored slots, few beside
    them, come first; the others follow in that order, moved by how many of the
    query's scored or shown slots stand before them, so no query's slots are sorted.
    """
    at = ["section", "entry_index", "slot_index"]
    own = [c for c in (*at, "text") if c in slots.columns]
    ordered = cut(placed(slots.select(*own), [F.col(c) for c in at], "_at"))
    ids = cut(scores.select("query_id").distinct())
    shown = lines.select("query_id", *at).distinct().withColumn("_shown", F.lit(True))
    named = scores.select("query_id", *at, "score").join(shown, ["query_id", *at], "full")
    known = cut(ordered.select(*at, "_at").join(small(named), at).select("query_id", *at, "_at", "score", "_shown").join(small(ids), "query_id", "left_semi"))
    first = known.where("_shown is null and score is not null")
    best = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "_at")) - 1)
    apart = known.where("_shown or score is not null")
    marks = apart.groupBy("query_id").agg(F.array_sort(F.collect_set("_at")).alias("_out"), F.count_if(F.col("_shown").isNull()).alias("_first"))
    each = small(ids.join(marks, "query_id", "left").select("query_id", F.coalesce("_out", F.expr("cast(array() as array<bigint>)")).alias("_out"), F.coalesce("_first", F.lit(0).cast("long")).alias("_first")))
    rest = ordered.join(each, F.lit(True)).where(~F.array_contains("_out", F.col("_at").cast("long")))
    place = F.col("_at") + F.col("_first") - F.size(F.filter("_out", lambda x: x < F.col("_at")))
    head = ordered.join(small(best.select("query_id", "_at", "score", F.col("place").cast("long").alias("place"))), "_at").select("query_id", *own, "score", "place")
    return head.unionByName(rest.select("query_id", *own, F.lit(None).cast(dict(scores.dtypes)["score"]).alias("score"), place.cast("long").alias("place")))


def with_entry(lines: DataFrame, slots: DataFrame, query_id: object, section: str, entry_index: int) -> DataFrame:
    """lines with an entry's slots added at the section's end, unless the query shows the entry already."""
    here = (F.col("query_id") == F.lit(query_id)) & (F.col("section") == section)
    has = lines.where(here & (F.col("entry_index") == entry_index)).limit(1).count()
    if has:
        return lines
    last = lines.where(here).agg(F.coalesce(F.max("place"), F.lit(-1)).alias("m")).collect()[0].m
    new = texts_of(slots).where((F.col("section") == section) & (F.col("entry_index") == entry_index) & F.col("emittable").isNotNull())
    row = F.row_number().over(Window.partitionBy("section", "entry_index").orderBy("slot_index")) - 1
    kinds = dict(lines.dtypes)
    return lines.unionByName(new.select(F.lit(query_id).cast(kinds["query_id"]).alias("query_id"), "section", F.lit(last + 1).cast(kinds["place"]).alias("place"), "entry_index", row.cast("int").alias("out_pos"), "slot_index", F.col("emittable").alias("text"), "ach_id", F.lit(None).cast("string").alias("variant_id"), F.lit("").alias("angle")))


def with_line(lines: DataFrame, query_id: object, section: str, entry_index: int, text: str) -> DataFrame:
    """lines with one more text at the end of an entry that the query shows, unless it stands there already."""
    at = (F.col("query_id") == F.lit(query_id)) & (F.col("section") == section) & (F.col("entry_index") == entry_index)
    mine = lines.where(at)
    last = mine.groupBy("query_id", "section", "place", "entry_index").agg(F.max("out_pos").alias("out_pos"), F.bool_or(F.col("text") == text).alias("has")).where("not has")
    none = {"slot_index": "int", "ach_id": "string", "variant_id": "string", "angle": "string"}
    new = last.select("query_id", "section", "place", "entry_index", (F.col("out_pos") + 1).alias("out_pos"), F.lit(text).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    return lines.unionByName(new)


def section_lines(section: str, items: DataFrame, slots: DataFrame, settings, keywords: DataFrame | None = None) -> DataFrame:
    """Lines of one section alone; skills show their text with the items that hold a keyword first."""
    mine = slots.where(F.col("section") == section)
    if section in EDITED:
        return assembled(items.where(F.col("section") == section), mine, settings.max_experience if section == "experience" else settings.max_projects, settings.max_highlights)
    if section != "skills":
        raise ValueError(f"no section of its own: {section}")
    out = entries_of(items.where("section = 'skills'"), mine, settings.max_skills).join(texts_of(mine).select("section", "entry_index", "slot_index", "emittable", "ach_id"), ["section", "entry_index"])
    if keywords is not None:
        out = out.join(keywords.select("query_id", "keywords"), "query_id", "left")
        label, details = F.substring_index("emittable", ": ", 1), F.expr("substring(emittable, length(substring_index(emittable, ': ', 1)) + 3)")
        out = out.withColumn("emittable", F.when(F.contains("emittable", F.lit(": ")), F.concat(label, F.lit(": "), reordered_details(details, F.coalesce("keywords", F.expr("cast(array() as array<string>)"))))).otherwise(F.col("emittable")))
    return out.select("query_id", "section", "place", "entry_index", F.lit(0).alias("out_pos"), "slot_index", F.col("emittable").alias("text"), "ach_id", F.lit(None).cast("string").alias("variant_id"), F.lit("").alias("angle"))
