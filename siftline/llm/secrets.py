"""Secret scans over a trigram inverted index, in built-in expressions only.

Each rule's regex yields a Boolean trigram query (see ``trigrams``). The index
holds postings (trigram, doc_id) for the trigrams that the rules' queries name;
a clause's postings are intersected by counting its trigrams per document, and
a rule's candidates are the documents that hold one of its clauses. Only these
are verified with the rule's regex. Rules without mandatory trigrams scan every
document.

Defined results: null text counts as empty and has no spans; one row per input
row; rows that share an id share its candidates and are verified each on their
own text; offsets are code points; trigrams are matched after lower-casing A-Z;
only the id and text columns are read, so other columns can have any name; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, checked_broadcast, written
from .spans import located, matches
from .trigrams import trigram_query

VALUE = r"(?i)^(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?"


@dataclass(frozen=True)
class Rule:
    """least: characters a match must have, after `prefix` is taken off. Regexes read alike in Python and Java."""

    name: str
    regex: str
    base: bool = False
    least: int = 0
    prefix: str = ""

    def holds(self, match: Column) -> Column:
        return F.length(F.regexp_replace(match, self.prefix, "") if self.prefix else match) >= self.least


#: In the order in which kinds are listed.
RULES = (
    Rule("assign", r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", True, 6, VALUE),
    Rule("access", r"AKIA[A-Z0-9]+", True, 20),
    Rule("hex", r"[0-9a-f]{24,}", True),
    Rule("session_key", r"ASIA[A-Z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def postings(df: DataFrame, grams: list[str]) -> DataFrame:
    """(trigram, doc_id) for the given trigrams; df has doc_id and _text."""
    low = df.select("doc_id", F.translate("_text", UPPER, UPPER.lower()).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.col("_low").contains(g), F.lit(g)) for g in grams]))
    return low.select(F.explode(held).alias("gram"), "doc_id")


def rule_candidates(df: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """doc_id and the rules whose trigram query it meets."""
    index = postings(df, sorted({g for cs in queries.values() for c in cs for g in c}))
    # a clause's posting lists meet per document: at most one row a document and trigram, no pairs of documents
    held = index.groupBy("doc_id").agg(F.collect_set("gram").alias("held"))
    met = held.select("doc_id", F.array_compact(F.array(*[F.when(any_of([all_of("held", c) for c in cs]), F.lit(rule)) for rule, cs in queries.items()])).alias("rules"))
    return met.where(F.size("rules") > 0)


def all_of(held: str, clause: frozenset[str]) -> Column:
    return F.size(F.array_intersect(F.col(held), F.array(*[F.lit(g) for g in sorted(clause)]))) == len(clause)


def any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans: sorted array of (start, rank, end, kind, base)."""
    df = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    queries = {r.name: q for r in rules if (q := trigram_query(r.regex))}
    if queries:
        found = written(rule_candidates(df, queries), "candidates")
        found = checked_broadcast(found.withColumnRenamed("doc_id", "_id"), found.count())
        df = df.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    df = df.withColumns({f"_h_{r.name}": matches(F.col("_text"), r.regex, F.coalesce(F.array_contains("rules", r.name), F.lit(False)) if r.name in queries else None) for r in rules})
    df = df.select("doc_id", *[located(F.col("_text"), r.regex, F.col(f"_h_{r.name}")).alias(r.name) for r in rules])

    def tagged(rank: int, r: Rule) -> Column:
        tag = lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(r.name).alias("kind"), F.lit(r.base).alias("base"))
        return F.transform(F.filter(r.name, lambda s: r.holds(s["match"])), tag)

    return df.select("doc_id", F.array_sort(F.concat(*[tagged(i, r) for i, r in enumerate(rules)])).alias("spans"))
