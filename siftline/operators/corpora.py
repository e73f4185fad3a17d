"""Texts of nested documents: located pieces, corpus strings, their rules and where keywords stand in them.

Documents come as JSON text and are read as VARIANT, so any keys do. Fields of
an entry are ordered by name, as VARIANT keeps them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.folds import empty, scanned
from siftline.functions.text import once

# Sections by kind where their entries don't tell, angles, sources and states of a variant.
TEXT_SECTIONS, LABEL_SECTIONS = ("summary", "objective", "keywords", "interests"), ("skills", "languages")
SOURCES, STATUSES, MOST_ANGLES = ("manual", "generated", "imported"), ("approved", "pending", "rejected"), 2

VARIANTS = "array<struct<id:string,text:string,status:string,source:string,used_count:int,angle:variant>>"


def get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def kind_of(value: Column) -> Column:
    """STRING, ARRAY, OBJECT or another kind of VARIANT value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def entries(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(key, section_pos, section, entry_index, entry) of JSON documents; sections that are no lists have none."""
    read = docs.select(key, get(F.try_parse_json(F.col(text)), "$.cv.sections", "map<string, variant>").alias("sections"))
    each = read.select(key, F.posexplode("sections").alias("section_pos", "section", "value"))
    return each.select(key, "section_pos", "section", F.posexplode(get(F.col("value"), "$", "array<variant>")).alias("entry_index", "entry"))


def pieces(found: DataFrame, key: str = "doc") -> DataFrame:
    """Strings of entries with their place: (.., field, item, text); field null for an entry that is a string, item null for a plain field."""
    place = [key, "section_pos", "section", "entry_index"]
    direct = found.where(kind_of(F.col("entry")) == "STRING").select(*place, F.lit(-1).alias("field_pos"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("int").alias("item"), get(F.col("entry"), "$", "string").alias("text"))
    fields = found.where(kind_of(F.col("entry")) == "OBJECT").select(*place, F.posexplode(get(F.col("entry"), "$", "map<string, variant>")).alias("field_pos", "field", "value"))
    plain = fields.where(kind_of(F.col("value")) == "STRING").select(*place, "field_pos", "field", F.lit(None).cast("int").alias("item"), get(F.col("value"), "$", "string").alias("text"))
    listed = fields.where(kind_of(F.col("value")) == "ARRAY").select(*place, "field_pos", "field", F.posexplode(get(F.col("value"), "$", "array<variant>")).alias("item", "v"))
    listed = listed.where(kind_of(F.col("v")) == "STRING").select(*place, "field_pos", "field", "item", get(F.col("v"), "$", "string").alias("text"))
    return direct.unionByName(plain).unionByName(listed)


def joined(parts: DataFrame, key: str, between: str) -> DataFrame:
    """(key, corpus): the texts in order, joined and lower-cased."""
    row = F.struct("section_pos", "entry_index", "part", F.coalesce("field_pos", F.lit(0)).alias("field_pos"), F.coalesce("item", F.lit(-1)).alias("item"), "text")
    return parts.groupBy(key).agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["text"]), between)).alias("corpus"))


def report_corpus(found: DataFrame, key: str = "doc") -> DataFrame:
    """The string in which reports look for keywords: all pieces, one level deep."""
    return joined(pieces(found, key).withColumn("part", F.lit(0)), key, " ")


def achievements(found: DataFrame, key: str = "doc") -> DataFrame:
    """(.., ach_index, ach_id, action, tools, variants) of the entries' achievements."""
    each = found.select(key, "section_pos", "section", "entry_index", F.posexplode(get(F.col("entry"), "$.achievements", "array<variant>")).alias("ach_index", "a"))
    return each.select(key, "section_pos", "section", "entry_index", "ach_index", get(F.col("a"), "$.id", "string").alias("ach_id"), get(F.col("a"), "$.facts.action", "string").alias("action"), get(F.col("a"), "$.facts.tools", "array<string>").alias("tools"), get(F.col("a"), "$.variants", VARIANTS).alias("variants"))


def approved_texts(variants: Column) -> Column:
    """Texts of the approved variants; a state that is none of the known ones counts as approved."""
    usable = lambda v: ~F.coalesce(v["status"], F.lit("")).isin("pending", "rejected") & (F.trim(F.coalesce(v["text"], F.lit(""))) != "")
    return F.transform(F.filter(F.coalesce(variants, F.expr(f"cast(array() as {VARIANTS})")), usable), lambda v: v["text"])


def facts_texts(action: Column, tools: Column) -> Column:
    return F.filter(F.concat(F.array(action), F.coalesce(tools, F.expr("cast(array() as array<string>)"))), lambda x: F.coalesce(x, F.lit("")) != "")


def check_corpus(found: DataFrame, key: str = "doc") -> DataFrame:
    """The string against which keywords are verified: details, labels, names and highlights, facts and approved variants."""
    own = pieces(found, key).where(F.col("field").isNull() | F.col("field").isin("details", "label", "name", "highlights")).withColumn("part", F.lit(0))
    deep = achievements(found, key).select(key, "section_pos", "entry_index", F.col("ach_index").alias("field_pos"), F.posexplode(F.concat(facts_texts(F.col("action"), F.col("tools")), approved_texts(F.col("variants")))).alias("item", "text"))
    parts = own.select(key, "section_pos", "entry_index", "part", "field_pos", "item", "text").unionByName(deep.withColumn("part", F.lit(1)))
    return joined(parts, key, " \n ")


def whole_text(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(key, corpus): every string at any depth in document order, keys that begin with an underscore left out."""

    def strings(value: object) -> Iterator[str]:
        if isinstance(value, str):
            yield value
        for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
            if not str(k).startswith("_"):
                yield from strings(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                try:
                    out.append(" \n ".join(strings(json.loads(t or "null"))).lower())
                except ValueError:
                    out.append("")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "corpus"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, corpus string")


def section_kinds(found: DataFrame, key: str = "doc") -> DataFrame:
    """(key, section, kind): text, entries or label_details, by the section's first entry."""
    first = found.where("entry_index = 0")
    top, fields = kind_of(F.col("entry")), get(F.col("entry"), "$", "map<string, variant>")
    rich = F.map_contains_key(fields, "highlights") | F.map_contains_key(fields, "achievements")
    return first.select(key, "section", F.when(top == "STRING", "text").when((top == "OBJECT") & rich, "entries").otherwise("label_details").alias("kind"))


def default_kind(section: Column) -> Column:
    return F.when(section.isin(*TEXT_SECTIONS), "text").when(section.isin(*LABEL_SECTIONS), "label_details").otherwise("entries")


def keyword_locations(keywords: DataFrame, found: DataFrame) -> DataFrame:
    """(keyword, section, entry_index, field, item, text) of the pieces that hold a keyword (keyword, variants array<string>).

    A piece is asked only for keywords one of whose variants shares its first run of
    a-z and 0-9 with it, by hash join; the bounded match decides.
    """
    run = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    asked = keywords.select("keyword", F.explode("variants").alias("variant")).withColumn("run", F.coalesce(F.get(run(F.col("variant")), F.lit(0)), F.lit("")))
    held = found.withColumn("run", F.explode(F.array_union(run(F.col("text")), F.array(F.lit("")))))
    pattern = F.concat(F.lit(r"(^|[^a-z0-9])\Q"), F.lower("variant"), F.lit(r"\E([^a-z0-9]|$)"))
    return held.join(asked, "run").where(F.regexp_like(F.lower("text"), pattern)).drop("run", "variant").distinct()


def structure_errors(found: DataFrame, angles: list[str], key: str = "doc") -> DataFrame:
    """(key, section, entry_index, ach_index, variant_index, rule) for each rule that a document breaks."""
    place = [key, "section", "entry_index"]
    entry = F.col("entry")
    listed = get(entry, "$.achievements", "array<variant>")
    has = F.map_contains_key(get(entry, "$", "map<string, variant>"), "achievements")
    rich = found.where(kind_of(entry) == "OBJECT")

    def broken(df: DataFrame, rules: dict[str, Column], ach: Column, variant: Column) -> DataFrame:
        hits = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(rule)) for rule, test in rules.items()]))
        return df.select(*place, ach.cast("int").alias("ach_index"), variant.cast("int").alias("variant_index"), F.explode(hits).alias("rule"))

    none = F.lit(None)
    blank = lambda v, path: F.trim(F.coalesce(F.when(kind_of(get(v, path, "variant")) == "STRING", get(v, path, "string")), F.lit(""))) == ""
    of_entry = broken(rich, {"highlights and achievements at once": has & (F.size(F.coalesce(get(entry, "$.highlights", "array<variant>"), F.expr("cast(array() as array<variant>)"))) > 0), "achievements are no list": has & listed.isNull()}, none, none)
    lines = rich.select(*place, F.posexplode(get(entry, "$.highlights", "array<variant>")).alias("at", "v"))
    of_line = broken(lines, {"a highlight is no text": kind_of(F.col("v")) != "STRING"}, none, F.col("at"))
    each = rich.select(*place, F.posexplode(listed).alias("ach", "a"))
    a = F.col("a")
    versions = get(a, "$.variants", "array<variant>")
    is_object = kind_of(a) == "OBJECT"
    of_ach = broken(each, {"an achievement is no object": ~is_object, "an achievement lacks its id": is_object & blank(a, "$.id"), "an achievement has no variant": is_object & (versions.isNull() | (F.size(versions) == 0))}, F.col("ach"), none)
    deep = each.where(is_object).select(*place, "ach", F.posexplode(versions).alias("at", "v"))
    v = F.col("v")
    object_ = kind_of(v) == "OBJECT"
    angle = get(v, "$.angle", "variant")
    named = F.filter(F.when(kind_of(angle) == "ARRAY", get(angle, "$", "array<string>")).otherwise(F.array(get(angle, "$", "string"))), lambda x: F.coalesce(x, F.lit("")) != "")
    status, source, used = get(v, "$.status", "string"), get(v, "$.source", "string"), get(v, "$.used_count", "variant")
    of_variant = broken(
        deep,
        {
            "a variant is no object": ~object_,
            "a variant lacks its text": object_ & blank(v, "$.text"),
            "a variant lacks its id": object_ & blank(v, "$.id"),
            "a variant has an unknown status": ~status.isin(*STATUSES),
            "a variant has an unknown source": ~source.isin(*SOURCES),
            "a variant has more than two angles": F.size(named) > MOST_ANGLES,
            "a variant has an unknown angle": F.exists(named, lambda x: ~x.isin(*angles)) if angles else F.lit(False),
            "a variant's count is no number of uses": used.isNotNull() & ((kind_of(used) != "BIGINT") | (get(used, "$", "bigint") < 0)),
        },
        F.col("ach"),
        F.col("at"),
    )
    return of_entry.unionByName(of_line).unionByName(of_ach).unionByName(of_variant)


RANGE = "struct<start:int,end:int>"


def merged_ranges(ranges: Column) -> Column:
    """Sorted (start, end) structs with those that overlap or touch made one."""
    # a range opens a new place where it begins behind the end of all before it; that place ends with the last range before the next one opens
    reach = lambda s, r: F.greatest(s, r["end"])
    seen = scanned(F.array_sort(ranges), F.lit(-1), reach, lambda s, r: F.struct(r["start"].alias("start"), reach(s, r).alias("reach"), (r["start"] > s).alias("opens")), "struct<start:int,reach:int,opens:boolean>")

    def places(e: Column) -> Column:
        last = lambda x, i: F.coalesce(F.get(e, i + 1)["opens"], F.lit(True))
        starts, ends = F.filter(e, lambda x: x["opens"]), F.filter(e, last)
        return F.zip_with(starts, ends, lambda x, y: F.struct(x["start"].alias("start"), y["reach"].alias("end")))

    return once(seen, places)


def occurrences(text: Column, term: Column) -> Column:
    """(start, end) of a plain term's occurrences that don't overlap, in any case."""
    gaps = F.split(F.lower(text), F.concat(F.lit(r"\Q"), F.lower(term), F.lit(r"\E")), F.lit(-1))
    size = F.length(term)
    begins = lambda at, gap: at + F.length(gap)
    spans = lambda at, gap: F.struct(begins(at, gap).alias("start"), (begins(at, gap) + size).alias("end"))
    placed = lambda g: scanned(F.slice(g, F.lit(1), F.size(g) - 1), F.lit(0), lambda at, gap: begins(at, gap) + size, spans, RANGE)
    return F.when(size > 0, once(gaps, placed)).otherwise(empty(RANGE))


def highlight_ranges(text: Column, terms: Column) -> Column:
    """Where any of the terms stands, overlapping places merged."""
    return merged_ranges(F.flatten(F.transform(terms, lambda t: occurrences(text, t))))


def marks(text: Column, terms: Column) -> Column:
    """Places of the terms, those from the left that overlap no earlier one; of places that begin together the longest term's."""
    every = F.flatten(F.transform(terms, lambda t: F.transform(occurrences(text, t), lambda r: F.struct(r["start"].alias("start"), (-(r["end"] - r["start"])).alias("shorter"), r["end"].alias("end")))))
    free = lambda last, r: r["start"] >= last
    step = lambda last, r: F.when(free(last, r), r["end"]).otherwise(last)
    emit = lambda last, r: F.struct(r["start"].alias("start"), r["end"].alias("end"), free(last, r).alias("stays"))
    judged = scanned(F.array_sort(every), F.lit(-1), step, emit, "struct<start:int,end:int,stays:boolean>")
    return F.transform(F.filter(judged, lambda r: r["stays"]), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
