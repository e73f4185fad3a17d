"""Model calls behind plain callables, and the checks on what models say.

No provider is built in: `call(system, user, schema) -> dict` is given by the
user and runs inside Arrow batches, several calls at a time; without one, or on
any failure, every flow has a defined fallback. What is checked is checked by
column logic and needs no model.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Call = Callable[[str, str, dict], dict]

FACTS = "action string, tools array<string>, scope string, outcomes array<struct<metric:string,value:string>>"
NONE = "cast(array() as array<string>)"
#: What models are told; parameters of every flow.
IDEAL = "Write six to ten lines of the experience and skills of an ideal candidate for this offer, in its own words, without names. Answer with JSON: hypothetical_document."
EXTRACT = "Part this text into action, tools, scope and outcomes (metric, value). Use nothing that the text doesn't say. Answer with JSON."
REWRITE = "Reword this achievement from the given facts and wordings alone. Answer with JSON: text, tech_terms (every tool that the text names)."
STRATEGIC = "Say in one sentence why this entry fits the offer, and name the best angle of each slot. Answer with JSON: match_reason, preferred_angles (slot_index, angle)."
STORY = "Part this account into facts (action, tools, scope, outcomes) and word it as one line. Use nothing that it doesn't say. Answer with JSON: facts, variant_text."


def with_retry(structured: Call, plain: Call | None = None) -> Call:
    """A call that asks once more as plain chat where the structured one fails, unless what came back was JSON that can't be read; every failure is a RuntimeError."""

    def call(system: str, user: str, schema: dict) -> dict:
        try:
            return structured(system, user, schema)
        except json.JSONDecodeError as bad:
            raise RuntimeError(f"the answer is no JSON: {bad}") from bad
        except Exception as first:
            if plain is None:
                raise RuntimeError(str(first)) from first
        try:
            return plain(system, user, schema)
        except Exception as second:
            raise RuntimeError(str(second)) from second

    return call


class Later:
    """A call on a thread that never keeps its process from ending."""

    def __init__(self, call: Call, *args):
        self.answer, self.problem = None, "no answer in time"
        self.thread = threading.Thread(target=self.run, args=(call, *args), daemon=True)
        self.thread.start()

    def run(self, call: Call, *args) -> None:
        try:
            self.answer, self.problem = json.dumps(call(*args), ensure_ascii=False), None
        except Exception as failure:  # a model's failure never fails the query
            self.problem = str(failure) or type(failure).__name__


def asked(df: DataFrame, call: Call | None, system: str, user: Column, schema: dict, timeout: float = 15.0, at_once: int = 4) -> DataFrame:
    """df with answer (JSON text, null on a failure or after `timeout` seconds) and problem (why there is none)."""
    if call is None:
        return df.withColumns({"answer": F.lit(None).cast("string"), "problem": F.lit("no model")})
    kept = df.select(F.struct("*").alias("row"), user.alias("user"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts, answers, problems = batch.column(1).to_pylist(), [], []
            for k in range(0, len(prompts), at_once):
                calls = [Later(call, system, p or "", schema) for p in prompts[k : k + at_once]]
                for c in calls:
                    c.thread.join(timeout)
                    answers.append(c.answer)
                    problems.append(c.problem)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(problems, pa.string())], names=["row", "answer", "problem"])

    kind = kept.schema["row"].dataType.simpleString()
    return kept.mapInArrow(run, f"row {kind}, answer string, problem string").select("row.*", "answer", "problem")


def held(text: Column, term: Column) -> Column:
    """Whether a term stands in a text, in any case, as a whole."""
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(^|[^a-z0-9])\Q"), F.lower(term), F.lit(r"\E([^a-z0-9]|$)")))


def trimmed(terms: Column) -> Column:
    return F.filter(F.transform(F.coalesce(terms, F.expr(NONE)), lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: t != "")


def held_by_variant(text: Column, term: Column) -> Column:
    from .retrieval import variants_of

    return F.exists(variants_of(term), lambda v: held(text, v))


def verified_tools(text: Column, tools: Column) -> Column:
    return F.filter(trimmed(tools), lambda t: held_by_variant(text, t))


def verified_outcomes(text: Column, outcomes: Column) -> Column:
    """Outcomes whose metric, or whose value without its sign, the text holds; of each the part that it does."""
    low = F.lower(text)
    plain = lambda v: F.trim(F.coalesce(v, F.lit("")))
    bare = lambda v: F.regexp_replace(F.lower(plain(v)), r"^[+-]+", "")
    inside = lambda x: (x != "") & F.contains(low, x)
    kept = lambda o: F.struct(F.when(inside(F.lower(plain(o["metric"]))), plain(o["metric"])).otherwise("").alias("metric"), F.when(inside(bare(o["value"])), plain(o["value"])).otherwise("").alias("value"))
    return F.filter(F.transform(outcomes, kept), lambda o: (o["metric"] != "") | (o["value"] != ""))


def verified_facts(text: Column, facts: Column) -> Column:
    """facts with only what the text bears out; action and scope are prose and stay."""
    outcomes = F.coalesce(facts["outcomes"], F.expr("cast(array() as array<struct<metric:string,value:string>>)"))
    word = lambda v: F.trim(F.coalesce(v, F.lit("")))
    return F.struct(word(facts["action"]).alias("action"), verified_tools(text, facts["tools"]).alias("tools"), word(facts["scope"]).alias("scope"), verified_outcomes(text, outcomes).alias("outcomes"))


def verified_reason(reason: Column, slot: Column, query: Column, dictionary: list[str]) -> Column:
    """The reason if slot or query count each dictionary term that it names, by any variant, else null."""
    from siftline.functions.text import count_term
    from siftline.functions.words import variants

    both = F.concat_ws(" ", slot, query)
    good = F.lit(True)
    for t in dictionary:
        counts = [count_term(both, v) > 0 for v in variants(t)]
        backed = counts[0]
        for more in counts[1:]:
            backed = backed | more
        good = good & ((count_term(reason, t) == 0) | backed)
    return F.when(good & (F.coalesce(F.trim(reason), F.lit("")) != ""), reason)


def unverified(declared: Column, supported: Column) -> Column:
    """Declared terms that nothing supports, in order, once each."""
    return F.array_distinct(F.filter(declared, lambda t: ~F.array_contains(supported, t)))


def hypothetical(queries: DataFrame, call: Call | None, system: str = IDEAL, timeout: float = 15.0) -> DataFrame:
    """(query_id, answer): a text that an ideal candidate might have; null where there is none."""
    out = asked(queries.select("query_id", "text"), call, system, F.col("text"), {"hypothetical_document": "string"}, timeout)
    return out.select("query_id", F.nullif(F.trim(F.get_json_object("answer", "$.hypothetical_document")), F.lit("")).alias("answer"))


def extracted(texts: DataFrame, call: Call | None, system: str = EXTRACT, timeout: float = 10.0, text: str = "text") -> DataFrame:
    """texts with facts, verified against the text; empty facts where no model answers."""
    out = asked(texts, call, system, F.col(text), {"action": "string", "tools": ["string"], "scope": "string", "outcomes": [{"metric": "string", "value": "string"}]}, timeout)
    return out.withColumn("facts", verified_facts(F.coalesce(text, F.lit("")), F.from_json(F.coalesce("answer", F.lit("{}")), FACTS))).drop("answer", "problem")


def facts_text(facts: Column) -> Column:
    """All that facts say, as one text."""
    parts = F.concat(F.array(facts["action"], facts["scope"]), F.coalesce(facts["tools"], F.expr(NONE)), F.flatten(F.transform(F.coalesce(facts["outcomes"], F.expr("cast(array() as array<struct<metric:string,value:string>>)")), lambda o: F.array(o["metric"], o["value"]))))
    return F.array_join(F.filter(parts, lambda p: F.trim(F.coalesce(p, F.lit(""))) != ""), " ")


def reworded(achievements: DataFrame, call: Call | None, angles: list[str], system: str = REWRITE, timeout: float = 90.0) -> DataFrame:
    """achievements (facts, wordings array<string>, current, snippet, angle, ..) with new_text, unverified_terms and error.

    An unknown angle, nothing to reword, no answer in time or an empty one is an
    error; terms that the model declares and the achievement doesn't hold are listed.
    """
    source = F.trim(F.concat_ws(" ", facts_text(F.col("facts")), F.array_join(trimmed(F.col("wordings")), " "), F.trim(F.coalesce("current", F.lit("")))))
    df = achievements.withColumns({"_source": source, "_angle": F.lower(F.trim(F.coalesce("angle", F.lit(""))))})
    wrong = F.when(~F.col("_angle").isin("", *angles), F.concat(F.lit("unknown angle: "), F.col("_angle"))).when(F.col("_source") == "", "nothing to reword")
    df = df.withColumn("_wrong", wrong)
    user = F.concat_ws("\n", F.concat(F.lit("angle: "), F.col("_angle")), F.col("_source"), F.concat(F.lit("for emphasis only: "), F.coalesce("snippet", F.lit(""))))
    out = asked(df.where("_wrong is null"), call, system, user, {"text": "string", "tech_terms": ["string"]}, timeout)
    text = F.trim(F.coalesce(F.get_json_object("answer", "$.text"), F.lit("")))
    terms = trimmed(F.from_json(F.coalesce(F.get_json_object("answer", "$.tech_terms"), F.lit("[]")), "array<string>"))
    out = out.withColumns({"new_text": F.nullif(text, F.lit("")), "unverified_terms": F.array_distinct(F.filter(terms, lambda t: ~held_by_variant(F.col("_source"), t))), "error": F.coalesce("problem", F.when(text == "", "an empty wording"))}).drop("answer", "problem")
    bad = df.where("_wrong is not null").withColumns({"new_text": F.lit(None).cast("string"), "unverified_terms": F.expr(NONE), "error": F.col("_wrong")})
    return out.unionByName(bad).drop("_source", "_angle", "_wrong")


def strategic(entries: DataFrame, call: Call | None, dictionary: list[str], angles: list[str], system: str = STRATEGIC, timeout: float = 60.0) -> DataFrame:
    """entries (text, query_text, reason, achievement_slots array<int>, ..) with a model's reason where it holds, and angles map<int,string>.

    A reason that names a term which neither entry nor query has is dropped and
    the one at hand stays; angles must be known and name a slot that is an achievement.
    """
    out = asked(entries, call, system, F.concat_ws("\n", F.col("query_text"), F.col("text")), {"match_reason": "string", "preferred_angles": [{"slot_index": "int", "angle": "string"}]}, timeout)
    said = F.get_json_object("answer", "$.match_reason")
    named = F.from_json(F.coalesce(F.get_json_object("answer", "$.preferred_angles"), F.lit("[]")), "array<struct<slot_index:int,angle:string>>")
    good = F.filter(F.coalesce(named, F.expr("cast(array() as array<struct<slot_index:int,angle:string>>)")), lambda a: F.coalesce(F.array_contains("achievement_slots", a["slot_index"]) & a["angle"].isin(*angles), F.lit(False)))
    last = F.aggregate(good, F.expr("cast(map() as map<int,string>)"), lambda m, a: F.map_concat(F.map_filter(m, lambda k, v: k != a["slot_index"]), F.create_map(a["slot_index"], a["angle"])))
    return out.withColumns({"reason": F.coalesce(verified_reason(said, F.col("text"), F.col("query_text"), dictionary), F.col("reason")), "angles": last}).drop("answer", "problem")


def structured(answers: DataFrame, call: Call | None, system: str = STORY, timeout: float = 10.0) -> DataFrame:
    """answers (work, tools, outcomes, ..) with facts and wording: what a model makes of them, verified; else the account itself."""
    part = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    df = answers.withColumn("_account", F.concat_ws(" ", part("work"), part("tools"), part("outcomes")))
    out = asked(df, call, system, F.col("_account"), {"facts": {}, "variant_text": "string"}, timeout)
    raw = F.struct(F.coalesce(part("work"), F.lit("")).alias("action"), F.expr(NONE).alias("tools"), F.lit("").alias("scope"), F.expr("cast(array() as array<struct<metric:string,value:string>>)").alias("outcomes"))
    facts = F.from_json(F.coalesce(F.get_json_object("answer", "$.facts"), F.lit("{}")), FACTS)
    usable = F.col("answer").isNotNull() & part("work").isNotNull()
    wording = F.when(usable, F.coalesce(F.nullif(F.trim(F.get_json_object("answer", "$.variant_text")), F.lit("")), F.col("_account"))).otherwise(F.col("_account"))
    return out.withColumns({"facts": F.when(usable, verified_facts(F.col("_account"), facts)).otherwise(raw), "wording": wording}).drop("answer", "problem", "_account")
