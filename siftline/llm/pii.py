"""Personal data by weak supervision, in built-in expressions only.

Candidates are the matches of the base patterns (also those whose check fails)
and of wider ones: emails written around ``[at]``, phone numbers without a
country code. Three labelers vote for (+1), against (-1) or abstain (0) on each:
the pattern's strict check, a gazetteer (top-level domains, address blocks, card
issuers, dialling codes) and the words around the match. Expectation-
maximisation over the counts of vote patterns (4 kinds x 27 patterns at most,
whatever the corpus' size) estimates each labeler's reliability and the share
of true spans of each kind. Its posteriors train the final span classifier, a
naive Bayes model over the span's own features, whose vocabulary is bounded
too. Base spans stay whatever the model says; it adds the candidates that it
accepts where they overlap no base span.

The base patterns are written with possessive quantifiers and a look-behind:
same matches, but time linear in the text and no recursion, so very long runs
of digits or letters are harmless.

Defined results: null text counts as empty and has no spans; one row per input
row, also where ids repeat or are null; offsets are code points; only the id
and text columns are read, so other columns can have any name; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .spans import digits, located, luhn, matches, scanned

KINDS = ("email", "ip", "card", "phone")

LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "email_wide": rf"(?<![{LOCAL}])[{LOCAL}]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++",
    "phone_wide": r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}

#: Gazetteers and context words, as alternatives of a pattern.
DOMAINS = "com|org|net|edu|gov|info|io|co|eu|uk|de|fr|es|it|us|biz"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65"
DIALLING = "1|7|20|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
FOR = r"\b(?:e-?mail|mail|contact|write|reach|call|phone|tel|telephone|mobile|cell|fax|card|visa|mastercard|amex|credit|debit|pay|ip|host|address|login|from|client)\b"
AGAINST = r"\b(?:version|release|section|isbn|issn|order|invoice|serial|total|sum|number of|part|figure|table|page|year)\b"
AROUND = 40


def candidates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and its candidates: array of (kind, start, end, match, base, wide, around, left, right)."""
    text = F.col("_text")
    df = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    only = {"email": text.contains("@"), "phone": text.contains("+"), "email_wide": text.contains("at]") | text.contains("at)")}
    df = df.withColumns({f"_h_{k}": matches(text, p, only.get(k)) for k, p in PATTERNS.items()})
    df = df.withColumn("_h_card", F.when(F.exists("_h_card", lambda h: F.length(h) >= 13), F.col("_h_card")).otherwise(F.expr("cast(array() as array<string>)")))
    df = df.select("doc_id", "_text", *[located(text, p, F.col(f"_h_{k}"), AROUND).alias(k) for k, p in PATTERNS.items()])

    octets = lambda m: F.forall(F.split(m, r"\."), lambda o: F.coalesce(F.regexp_replace(o, "^0+(?=.)", "").try_cast("bigint"), F.lit(999)) <= 255)
    n_digits = lambda m: F.length(digits(m))
    checks = {
        "email": lambda m: F.lit(True),
        "ip": octets,
        "card": lambda m: n_digits(m).between(16, 19) & luhn(digits(m)),
        "phone": lambda m: n_digits(m).between(8, 15),
        "email_wide": lambda m: F.lit(False),
        "phone_wide": lambda m: F.lit(False),
    }
    worth = {"card": lambda s: n_digits(s["match"]).between(13, 19), "ip": lambda s: F.length(s["match"]) <= 19}

    def tagged(k: str) -> Column:
        found = F.filter(k, worth[k]) if k in worth else F.col(k)
        if k == "ip":  # leading zeros may make a valid address longer
            found = F.filter(k, lambda s: (F.length(s["match"]) <= 19) | octets(s["match"]))

        def tag(s: Column) -> Column:
            around = F.lower(F.concat(s["before"], s["match"], s["after"]))
            return F.struct(
                F.lit(k.split("_")[0]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), checks[k](s["match"]).alias("base"), F.lit(k.endswith("_wide")).alias("wide"),
                around.alias("around"), F.right(s["before"], F.lit(1)).alias("left"), F.left(s["after"], F.lit(1)).alias("right"),
            )

        return F.transform(found, tag)

    return df.select("doc_id", F.concat(*[tagged(k) for k in PATTERNS]).alias("cands"))


def votes(c: Column) -> list[Column]:
    """The three labelers' votes on a candidate struct."""
    kind, m, number = c["kind"], c["match"], digits(c["match"])
    strict = F.when(c["base"], 1).when(c["wide"] & (kind == "email"), F.when(m.rlike(r"[\]). ][A-Za-z]{2,6}$"), 1).otherwise(-1)).when(c["wide"], F.when(m.rlike(r"^\("), 1).otherwise(0)).otherwise(-1)
    gazetteer = (
        F.when(kind == "email", F.when(m.rlike(rf"(?i)[. \])](?:{DOMAINS})$"), 1).otherwise(-1))
        .when(kind == "ip", F.when(m.rlike(r"^(?:0|127|22[4-9]|2[3-9][0-9]|[3-9][0-9]{2})\."), -1).otherwise(1))
        .when(kind == "card", F.when(number.rlike(f"^(?:{ISSUERS})"), 1).otherwise(-1))
        .otherwise(F.when(c["wide"], F.when(number.rlike("^[2-9][0-9]{2}[2-9]"), 1).otherwise(-1)).when(number.rlike(f"^(?:{DIALLING})"), 1).otherwise(-1))
    )
    context = F.when(c["around"].rlike(AGAINST), -1).when(c["around"].rlike(FOR), 1).otherwise(0)
    return [strict, gazetteer, context]


def features(c: Column) -> Column:
    """The classifier's view of a span: a bounded vocabulary, each prefixed with the kind."""
    side = lambda x: F.when(x == "", "edge").when(x.rlike(r"\s"), "blank").when(x.rlike("[0-9]"), "digit").when(x.rlike(r"\p{L}"), "letter").otherwise("mark")
    length = F.least(F.floor((c["end"] - c["start"]) / 4), F.lit(9)).cast("string")
    named = {"len": length, "left": side(c["left"]), "right": side(c["right"]), "digits": F.least(F.length(digits(c["match"])), F.lit(20)).cast("string"), "shape": F.when(c["wide"], "wide").otherwise(F.when(c["base"], "base").otherwise("failed"))}
    named |= {"for": c["around"].rlike(FOR).cast("string"), "against": c["around"].rlike(AGAINST).cast("string")}
    return F.array(*[F.concat(c["kind"], F.lit(f"|{n}|"), v) for n, v in named.items()])


def estimate(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 40) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation for two classes: the chance that a candidate with these votes is a true span."""
    post = {(k, v): 0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for k, v, _ in counts}
    for _ in range(rounds):
        share, seen = defaultdict(lambda: [1.0, 1.0]), defaultdict(lambda: 1.0)
        for k, v, n in counts:
            for truth, p in ((1, post[k, v]), (0, 1 - post[k, v])):
                share[k][truth] += n * p
                for labeler, vote in enumerate(v):
                    seen[labeler, truth, vote] += n * p
        sums = {(lab, t): sum(seen[lab, t, x] for x in (-1, 0, 1)) for lab in range(3) for t in (0, 1)}
        for k, v, _ in counts:
            logs = [math.log(share[k][t]) + sum(math.log(seen[lab, t, x] / sums[lab, t]) for lab, x in enumerate(v)) for t in (0, 1)]
            post[k, v] = 1 / (1 + math.exp(max(-700, min(700, logs[0] - logs[1]))))
    return post


def literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in (values or {"": 0.0}).items() for x in kv])


def trained(cands: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of each kind and feature, from the labelers' posteriors."""
    each = cands.select(F.explode("cands").alias("c"))
    voted = each.select(F.col("c")["kind"].alias("kind"), *[v.alias(f"v{i}") for i, v in enumerate(votes(F.col("c")))], features(F.col("c")).alias("f"))
    table = written(voted.withColumn("feature", F.explode("f")).groupBy("kind", "v0", "v1", "v2", "feature").count(), "votes")
    # every candidate has one feature of each name; one of them counts candidates
    patterns = table.where(F.col("feature").contains("|shape|")).groupBy("kind", "v0", "v1", "v2").agg(F.sum("count").alias("n")).collect()
    post = estimate([(r.kind, (r.v0, r.v1, r.v2), r.n) for r in sorted(patterns)])
    true, false = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
    kinds_true, kinds_false = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
    for r in patterns:
        p = post[r.kind, (r.v0, r.v1, r.v2)]
        kinds_true[r.kind] += r.n * p
        kinds_false[r.kind] += r.n * (1 - p)
    for r in table.collect():
        p = post[r.kind, (r.v0, r.v1, r.v2)]
        true[r.feature] += r["count"] * p
        false[r.feature] += r["count"] * (1 - p)
    weights = {f: round(math.log(true[f] / (kinds_true[f.split("|")[0]] + 1)) - math.log(false[f] / (kinds_false[f.split("|")[0]] + 1)), 6) for f in sorted(true)}
    return {k: round(math.log(kinds_true[k] / kinds_false[k]), 6) for k in KINDS}, weights


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, base and spans: sorted arrays of (rank, start, end, kind, p), base spans and all spans."""
    found = written(candidates(df, id_col, text_col), "candidates")
    prior, weights = trained(found)
    odds, weight = literal_map(prior), literal_map(weights)
    ranks = literal_map({k: float(i) for i, k in enumerate(KINDS)})

    def judged(c: Column) -> Column:
        score = F.aggregate(features(c), odds[c["kind"]], lambda s, f: s + F.coalesce(weight[f], F.lit(0.0)))
        return F.struct(ranks[c["kind"]].cast("int").alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), F.round(1 / (1 + F.exp(-score)), 6).alias("p"), c["base"].alias("base"))

    seen = found.select("doc_id", F.transform("cands", judged).alias("all"))
    seen = seen.select("doc_id", F.filter("all", lambda s: s["base"] | (s["p"] >= threshold)).alias("all"))
    return seen.select("doc_id", F.transform(F.array_sort(F.filter("all", lambda s: s["base"])), plain).alias("base"), F.array_sort(F.transform(chosen(F.col("all")), plain)).alias("spans"))


def plain(s: Column) -> Column:
    return F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["p"].alias("p"))


def chosen(spans: Column) -> Column:
    """All base spans, and of the others those that overlap none of them; of others that overlap, the one that starts first stays, then the first by kind.

    Two scans, one from each end, so the time is near linear in the number of spans.
    """
    far = F.lit((1 << 31) - 1)
    at = lambda s: F.struct(s["start"].alias("start"), (~s["base"]).alias("added"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["p"].alias("p"))
    kind = "struct<start:int,added:boolean,rank:int,end:int,kind:string,p:double,next:int,kept:boolean>"
    flagged = lambda s, next_, kept: F.struct(*[s[c].alias(c) for c in ("start", "added", "rank", "end", "kind", "p")], next_.alias("next"), kept.alias("kept"))
    backwards = scanned(F.reverse(F.array_sort(F.transform(spans, at))), far, lambda n, s: F.when(s["added"], n).otherwise(s["start"]), lambda n, s: flagged(s, n, F.lit(False)), kind)
    free = lambda ends, s: ~s["added"] | ((s["start"] >= ends["base"]) & (s["end"] <= s["next"]) & (s["start"] >= ends["own"]))
    ends = lambda e, s: F.struct(F.when(s["added"], e["base"]).otherwise(F.greatest(e["base"], s["end"])).alias("base"), F.when(s["added"] & free(e, s), s["end"]).otherwise(e["own"]).alias("own"))
    swept = scanned(F.reverse(backwards), F.struct(F.lit(0).alias("base"), F.lit(0).alias("own")), ends, lambda e, s: flagged(s, s["next"], free(e, s)), kind)
    return F.filter(swept, lambda s: s["kept"])
