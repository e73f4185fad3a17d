"""Terms of a large dictionary in many texts: words and runs of neighbouring words meet the dictionary by hash join.

The cost goes with the texts, not with the number of terms: a text's positions are
joined once, and only what meets a term is looked at further. Overlaps are resolved
by position afterwards. Frames: texts (query_id, text), terms (term), in lower case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import edge_trimmed, normalise, once, pairs_of, words
from siftline.functions.words import SEPARATORS

from .lineage import cut

#: What stands for marks between words.
APART = "␞"
#: Terms up to which the dictionary's side of a join is broadcast.
TERM_ROWS = 500_000


def checked(terms: DataFrame, limit: int = TERM_ROWS) -> DataFrame:
    """terms with a broadcast hint if there are at most `limit`."""
    return F.broadcast(terms) if terms.limit(limit + 1).count() <= limit else terms


def word_runs(text: Column) -> Column:
    """Distinct runs of word characters."""
    return F.array_distinct(F.filter(F.split(text, r"(?U)\W+"), lambda w: w != ""))


def parted_text(text: Column) -> Column:
    """The normalised text, with APART where marks stand between words."""
    return F.regexp_replace(normalise(text), r"(?U)[^\w\s]+", f" {APART} ")


def parted(text: Column) -> Column:
    """The words of the normalised text, and APART where marks stand between them."""
    return F.split(parted_text(text), r"(?U)\s+")


def runs_of(w: Column, n: int) -> Column:
    """The runs of n neighbours among w, joined by blanks, by where they begin."""
    if n == 1:
        return w
    if n == 2:
        return pairs_of(w)
    none = F.expr("cast(array() as array<string>)")
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))).otherwise(none)


def word_grams(text: Column, sizes: list[int]) -> Column:
    """The distinct runs of n neighbouring words of the normalised text with nothing but white space between them, for each n."""
    whole = lambda g: ~F.contains(g, F.lit(APART))
    return once(parted(text), lambda w: F.array_distinct(F.concat(*[F.filter(runs_of(w, n), whole) for n in sizes])))


def patterns_of(terms: DataFrame) -> DataFrame:
    """terms with raw (whether it is sought in the raw text), plain (whether it is words alone), pattern, and run, a run of word characters that any match holds whole."""
    raw = F.col("term").rlike(f"[{re.escape(SEPARATORS)}]")
    quoted = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    alnum = lambda c: c.rlike(r"(?U)[\p{L}\p{N}]")
    body = F.when(raw, quoted(F.col("term"))).otherwise(F.array_join(F.transform(F.split("term", " "), quoted), r"\s+"))
    left = F.when(~raw | alnum(F.left("term", F.lit(1))), r"(?<!\w)").otherwise("")
    right = F.when(~raw | alnum(F.right("term", F.lit(1))), r"(?!\w)").otherwise("")
    # borders and separators part the runs inside a term, so each stands whole in a text that matches; the longest is the rarest
    run = F.array_max(F.transform(word_runs(F.col("term")), lambda w: F.struct(F.length(w).alias("size"), w.alias("run"))))["run"]
    plain = ~raw & F.col("term").rlike(r"(?U)^\w+( \w+)*$")
    return terms.withColumns({"raw": raw, "plain": plain, "pattern": F.concat(F.lit("(?U)"), left, body, right), "run": run})


def term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, term, freq): how often each term stands in each text that holds it, as count_term counts it."""
    asked = cut(patterns_of(terms.select("term").where("term <> ''").distinct()))
    parts = []
    sizes = sorted(r[0] for r in asked.where("plain").select(F.size(F.split("term", " "))).distinct().collect())
    plain = checked(asked.where("plain").select("term", F.size(F.split("term", " ")).alias("n")))
    w = texts.select("query_id", parted(F.col("text")).alias("w"))
    if sizes:
        placed = lambda g, i: F.struct(g.alias("term"), i.alias("at"))
        runs = F.concat(*[F.transform(runs_of(F.col("w"), n), placed) for n in sizes])
        met = w.select("query_id", F.explode(runs).alias("r")).select("query_id", "r.term", "r.at").join(plain, "term")
        # a run of words that repeats can overlap itself; it counts from left to right
        free = F.struct(F.lit(-1).alias("next"), F.lit(0).alias("count"))
        step = lambda s, at: F.when(at >= s["next"], F.struct((at + F.col("n")).alias("next"), (s["count"] + 1).alias("count"))).otherwise(s)
        by_term = met.groupBy("query_id", "term", "n").agg(F.array_sort(F.collect_list("at")).alias("ats"))
        parts.append(by_term.select("query_id", "term", F.when(F.col("n") == 1, F.size("ats")).otherwise(F.aggregate("ats", free, step, lambda s: s["count"])).alias("freq")))
    marked = asked.where("not plain")
    if not marked.isEmpty():
        run = F.explode(F.array_union(F.array_union(word_runs(normalise(F.col("text"))), word_runs(F.lower("text"))), F.array(F.lit(""))))
        may = texts.select("query_id", run.alias("run")).join(checked(marked.withColumn("run", F.coalesce("run", F.lit("")))), "run").join(texts.select("query_id", "text"), "query_id")
        counted = F.regexp_count(F.when(F.col("raw"), F.lower("text")).otherwise(normalise(F.col("text"))), F.col("pattern"))
        parts.append(may.select("query_id", "term", counted.alias("freq")).where("freq > 0"))
    if not parts:
        return texts.select("query_id", F.lit("").alias("term"), F.lit(0).alias("freq")).where("false")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("query_id", "term", F.col("freq").cast("int").alias("freq"))


def dictionary_matches(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, term) as dictionary_terms finds them: from left to right two-word terms take their words before single words count; terms with separators are sought in the raw text."""
    known = terms.select("term").where("term <> ''").distinct()
    n_blanks = F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit("")))
    listed = cut(known.withColumn("n", n_blanks + 1).where("n <= 2"))
    found = texts.select("query_id", F.transform(words(normalise(F.col("text"))), edge_trimmed).alias("w"))
    single = F.transform("w", lambda x, i: F.struct(i.alias("at"), F.lit(2).alias("order"), x.alias("term")))
    double = F.transform(pairs_of(F.col("w")), lambda x, i: F.struct(i.alias("at"), F.lit(1).alias("order"), x.alias("term")))
    each = found.select("query_id", F.explode(F.concat(single, double)).alias("h")).select("query_id", "h.at", "h.order", "h.term")
    hits = each.join(checked(listed), "term").where(F.col("n") + F.col("order") == 3)
    start = F.struct(F.lit(0).alias("next"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(s: Column, h: Column) -> Column:
        taken = F.struct((h["at"] + 3 - h["order"]).alias("next"), F.when(F.array_contains(s["out"], h["term"]), s["out"]).otherwise(F.concat(s["out"], F.array(h["term"]))).alias("out"))
        return F.when(h["at"] >= s["next"], taken).otherwise(s)

    folded = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "order", "term"))).alias("h")).select("query_id", F.explode(F.aggregate("h", start, step, lambda s: s["out"])).alias("term"))
    apart = known.where(F.col("term").rlike(r"[+#.\-/]"))
    if apart.isEmpty():
        return folded
    return folded.unionByName(term_counts(texts, apart).select("query_id", "term")).distinct()

