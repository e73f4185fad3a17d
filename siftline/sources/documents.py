"""Nested documents (YAML or JSON) as flat frames, and imported sources as texts."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.importer import bullets

try:
    import yaml
except ImportError:  # YAML is optional; JSON documents work without it
    yaml = None

SLOTS = "section string, section_pos int, entry_index int, slot_index int, kind string, label string, text string, start_date string, variants array<struct<id:string,text:string,angles:array<string>,status:string,source:string,used_count:int,created_at:string>>"


def parsed(text: str) -> dict | None:
    """A document's mapping; empty text gives an empty one, unreadable text none."""
    if not text or not text.strip():
        return {}
    try:
        out = json.loads(text)
    except ValueError:
        if yaml is None:
            return None
        try:
            out = yaml.safe_load(text)
        except yaml.YAMLError:
            return None
    return out if isinstance(out, dict) else None


def visible(value: object) -> object:
    """Without keys that begin with an underscore, at any depth."""
    if isinstance(value, dict):
        return {k: visible(v) for k, v in value.items() if not str(k).startswith("_")}
    return [visible(v) for v in value] if isinstance(value, list) else value


def variant(v: dict) -> dict:
    angle = v.get("angle")
    angles = [a for a in (angle if isinstance(angle, list) else [angle]) if a]
    return {"id": v.get("id"), "text": v.get("text"), "angles": angles, "status": v.get("status"), "source": v.get("source"), "used_count": int(v.get("used_count") or 0), "created_at": str(v.get("created_at") or "")}


def slots(doc: dict) -> Iterator[tuple]:
    """Rows of SLOTS: every indexable place of a document."""
    for pos, (section, entries) in enumerate(((doc.get("cv") or {}).get("sections") or {}).items()):
        for k, entry in enumerate(entries if isinstance(entries, list) else []):
            if isinstance(entry, str):
                yield section, pos, k, 0, "text", None, entry.strip(), None, []
                continue
            if not isinstance(entry, dict):
                continue
            label = next((str(entry[c]) for c in ("company", "institution", "name", "label") if entry.get(c)), None)
            date = None if entry.get("start_date") is None else str(entry["start_date"])
            if "details" in entry:
                details = entry["details"]
                details = ", ".join(map(str, details)) if isinstance(details, list) else str(details or "")
                yield section, pos, k, 0, "skill", label, f"{label or ''}: {details}".strip(": "), date, []
                continue
            n = 0
            for achievement in entry.get("achievements") or []:
                if found := [variant(v) for v in achievement.get("variants") or [] if isinstance(v, dict)]:
                    yield section, pos, k, n, "achievement", label, None, date, found
                    n += 1
            for line in entry.get("highlights") or []:
                if isinstance(line, str) and line.strip():
                    yield section, pos, k, n, "highlight", label, line.strip(), date, []
                    n += 1


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_slots(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """One row a slot of each document; unreadable documents give none (see corrupt)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *row) for k, t in zip(batch[key], batch[text], strict=True) for row in slots(parsed(t) or {})]
            yield pd.DataFrame(rows, columns=[key, *[c.split(" ")[0] for c in SLOTS.split(", ")]])

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, {SLOTS}")


def corrupt(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Keys of the documents that can't be read."""

    @F.pandas_udf("boolean")
    def bad(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parsed(t) is None)

    return docs.where(bad(text)).select(key)


def slot_ids(df: DataFrame) -> DataFrame:
    """doc_id: {section}_{entry}_bullet_{slot}, or {section}_{entry}_0 of a skill."""
    skill = F.concat_ws("_", "section", "entry_index", F.lit("0"))
    return df.withColumn("doc_id", F.when(F.col("kind") == "skill", skill).otherwise(F.concat_ws("_", "section", "entry_index", F.lit("bullet"), "slot_index")))


def highlight_texts(doc: dict) -> list[str]:
    """All highlights, then all variants' texts of any state, of an imported document."""
    sections = ((doc.get("cv") or {}).get("sections") or {}).values()
    entries = [e for s in sections if isinstance(s, list) for e in s if isinstance(e, dict)]
    out = [h for e in entries for h in e.get("highlights") or [] if isinstance(h, str)]
    return out + [v["text"] for e in entries for a in e.get("achievements") or [] for v in a.get("variants") or [] if isinstance(v, dict) and v.get("text")]


def imported(sources: DataFrame, pdf_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """(file, pos, text) of sources (file, kind, content): text, yaml, json or base64 pdf by a given extractor; other kinds count as text."""

    @F.pandas_udf("array<string>")
    def structured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [x.strip() for x in highlight_texts(parsed(t) or {}) if x.strip()])

    @F.pandas_udf("string")
    def extracted(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: pdf_text(base64.b64decode(c)) if c else "")

    kind = F.lower(F.coalesce("kind", F.lit("text")))
    text: Column = F.col("content")
    if pdf_text is not None:
        text = F.when(kind == "pdf", extracted(F.when(kind == "pdf", F.col("content")))).otherwise(text)
    found = F.when(kind.isin("yaml", "json"), structured(F.when(kind.isin("yaml", "json"), F.col("content")))).when((kind == "pdf") & F.lit(pdf_text is None), F.expr("cast(array() as array<string>)")).otherwise(bullets(text))
    return sources.select("file", F.posexplode(found).alias("pos", "text"))


def page_text(html: Column) -> Column:
    """Text of a web page: scripts and styles out, tags to blanks, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def dumped(doc: dict) -> str:
    """A document as YAML (JSON without it), keys in order, internal keys left out."""
    plain = visible(doc)
    return yaml.safe_dump(plain, allow_unicode=True, sort_keys=False) if yaml else json.dumps(plain, ensure_ascii=False, indent=2)


def write_document(spark: SparkSession, doc: dict, path: str) -> None:
    """A document as a YAML file, on any storage that Spark writes to; the file appears whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    side, place = hadoop.Path(f"{path}.part"), hadoop.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(side, True)
    out.write(bytearray(dumped(doc).encode()))
    out.close()
    if fs.exists(place):
        fs.delete(place, False)
    fs.rename(side, place)
