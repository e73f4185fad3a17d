"""Ranked channels, their fusion and their scores, for many queries at once.

Frames: corpus (section, doc_id, ..), queries (query_id, ..), rankings
(query_id, section, doc_id, score, rank), rank counting from 0. Ties rank by
doc_id. Scores that order rows are rounded to nine digits first, so that the
order of additions never decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.stems import stem_table
from siftline.functions.text import normalise, once, stands_in, variants_of

from . import blocks
from .lineage import cut
from .nearest import top_products
from .phrases import APART, parted_text, patterns_of, runs_of, term_counts, word_grams, word_runs

#: Rows up to which the query side of a join is broadcast.
QUERY_ROWS = 200_000
#: Weights of terms by section up to which tasks score documents by blocks.
WEIGHTS = 20_000_000
K1, B, EPSILON = 1.5, 0.75, 0.25


def small(df: DataFrame, limit: int = QUERY_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ranked(scores: DataFrame, top_k: int | None, keys: tuple[str, ...] = ("query_id", "section"), score: str = "score") -> DataFrame:
    """rank from 0 within keys by score, then doc_id; a group limit prunes before the shuffle when top_k is given."""
    order = Window.partitionBy(*keys).orderBy(F.round(F.col(score), 9).desc(), F.col("doc_id"))
    out = scores.withColumn("_place", F.row_number().over(order))
    # the planner limits groups early only under a filter on the row number itself
    out = out if top_k is None else out.where(F.col("_place") <= top_k)
    return out.withColumn("rank", F.col("_place") - 1).drop("_place")


def stemmed(counts: DataFrame, count: str) -> DataFrame:
    """Counts by term as counts by stem; each distinct word is stemmed once."""
    keys = [c for c in counts.columns if c not in ("term", count)]
    return counts.join(stem_table(counts), "term").groupBy(*keys, F.col("stem").alias("term")).agg(F.sum(count).alias(count))


def term_table(corpus: DataFrame, terms: str = "tokens", stem: bool = False) -> DataFrame:
    """(section, doc_id, dl, term, tf), a row a document and term, written down: statistics and scores all read this one table.

    Documents are dealt out before their terms are parted, so terms are counted
    without another shuffle.
    """
    docs = corpus.select("section", "doc_id", F.col(terms).alias("tokens")).repartition("section", "doc_id")
    each = docs.select("section", "doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    out = each.groupBy("section", "doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    return cut(stemmed(out, "tf") if stem else out)


def bm25_terms(corpus: DataFrame, terms: str = "tokens", epsilon: float = EPSILON, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per section: (section, term, df, idf) with negative idf floored, and (section, n, avgdl)."""
    table = term_table(corpus, terms) if table is None else table
    # the number of documents needs no text; their lengths add up to the sum of all tf
    count, total = corpus.groupBy("section").agg(F.count("*").alias("n")), table.groupBy("section").agg(F.sum("tf").alias("total"))
    stats = count.join(total, "section", "left").select("section", "n", (F.coalesce("total", F.lit(0)) / F.col("n")).alias("avgdl"))
    df = table.groupBy("section", "term").agg(F.count("*").alias("df"))
    raw = df.join(small(stats), "section").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.groupBy("section").agg((F.avg("raw") * epsilon).alias("floor"))
    idf = raw.join(small(floor), "section").select("section", "term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return idf, stats


def bm25_scores(corpus: DataFrame, queries: DataFrame, terms: str = "tokens", k1: float = K1, b: float = B, pad: int | None = None, stem: bool = False, table: DataFrame | None = None) -> DataFrame:
    """(query_id, section, doc_id, score) of documents that share a term with a query; query terms count as often as they stand there.

    The corpus is tokenised once, into `table` (term_table's) where none is given;
    of it the asked terms alone are weighed. pad: of documents that score 0, the
    first `pad` of each section by doc_id are added, as many as a ranking of that
    depth can show.
    """
    asked = queries.select("query_id", F.explode(terms).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = cut(stemmed(asked, "times") if stem else asked)
    n = asked.limit(QUERY_ROWS + 1).count()  # one look at the queries decides for both of their joins
    hint = F.broadcast if n <= QUERY_ROWS else lambda df: df
    table = term_table(corpus, terms, stem) if table is None else table
    idf, stats = bm25_terms(corpus, terms, table=table)
    idf = cut(idf.join(hint(asked.select("term").distinct()), "term").select("section", "term", "idf"))
    scores = joined_scores(table, idf, stats, asked, hint, k1, b)
    return padded(scores, corpus, queries, pad) if pad else scores


def joined_scores(table: DataFrame, idf: DataFrame, stats: DataFrame, asked: DataFrame, hint: Callable[[DataFrame], DataFrame], k1: float = K1, b: float = B) -> DataFrame:
    """Scores of term_table's documents, a row a document and query before they are added up."""
    tf = table.join(hint(asked.select("term").distinct()), "term").join(small(idf), ["section", "term"]).join(small(stats), "section")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighed = tf.select("section", "doc_id", "term", part.alias("part"))
    return weighed.join(hint(asked), "term").groupBy("query_id", "section", "doc_id").agg(F.sum(F.col("part") * F.col("times")).alias("score"))


def asked_terms(queries: DataFrame, terms: str = "tokens", stem: bool = False) -> DataFrame:
    """(query_id, term, times), written down."""
    asked = queries.select("query_id", F.explode(terms).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return cut(stemmed(asked, "times") if stem else asked)


def repeats(corpus: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose section and doc_id no other row has, and the others, None where there are none."""
    twice = cut(corpus.groupBy("section", "doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("section").alias("_s"), F.col("doc_id").alias("_d")))
    if twice.isEmpty():
        return corpus, None
    keys, same = small(twice), F.col("section").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    return corpus.join(keys, same, "left_anti"), corpus.join(keys, same, "left_semi")


def numbered(ids: list, queries: DataFrame) -> DataFrame:
    """(q, query_id): the ids by number, to be broadcast."""
    schema = f"q int, query_id {dict(queries.dtypes)['query_id']}"
    return F.broadcast(queries.sparkSession.createDataFrame(list(enumerate(ids)), schema))


def bm25_weights(corpus: DataFrame, asked: DataFrame, terms: str = "tokens", stem: bool = False, epsilon: float = EPSILON) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(section, term, idf) of the asked terms, (section, n, avgdl), and with stems (term, word) of the corpus's words for them; one look at the corpus."""
    names = asked.select("term").distinct()
    found = blocks.frequencies(corpus, terms, stem, [r[0] for r in names.collect()] if stem else ())
    wanted = F.broadcast(names.withColumn("_asked", F.lit(True)))
    # a term's share in the floor depends on its number of documents alone, so terms that aren't asked are but counted
    counts = found.join(wanted, "term", "left").groupBy("section", "kind", F.when(F.col("_asked"), F.col("term")).alias("term"), "word", "n").agg(F.count("*").alias("m"), F.sum("total").alias("total"))
    counts = cut(counts)
    stats = counts.where("kind = 0").select("section", "n", (F.col("total") / F.col("n")).alias("avgdl"))
    raw = counts.where("kind = 1").withColumnRenamed("n", "df").join(small(stats), "section").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.groupBy("section").agg((F.sum(F.col("raw") * F.col("m")) / F.sum("m") * epsilon).alias("floor"))
    idf = raw.where("term is not null").join(small(floor), "section").select("section", "term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return cut(idf), stats, counts.where("kind = 2").select("term", "word").distinct()


def bm25_ranked(corpus: DataFrame, queries: DataFrame, top_k: int, terms: str = "tokens", k1: float = K1, b: float = B, pad: bool = False, stem: bool = False, spaced: str | None = None) -> DataFrame:
    """bm25_scores' ranking down to top_k, without a row for each document and query: tasks score by blocks and hand on their heads.

    pad: documents of score 0 fill a ranking. spaced: a column of texts whose words
    between blanks are the terms, which tasks then part. Queries of more than QUERY_ROWS terms,
    and documents that share their key, are scored by joins.
    """
    asked = asked_terms(queries, terms, stem)
    if asked.limit(QUERY_ROWS + 1).count() > QUERY_ROWS:
        return ranked(bm25_scores(corpus, queries, terms, k1, b, top_k if pad else None, stem), top_k)
    idf, stats, words = bm25_weights(corpus, asked, spaced or terms, stem)
    rows = asked.collect()
    ids, names = {r["query_id"]: None for r in rows}, {r["term"]: None for r in rows}
    ids, names = {k: i for i, k in enumerate(ids)}, {k: i for i, k in enumerate(names)}
    spelt = [(r["word"], r["term"]) for r in words.limit(QUERY_ROWS + 1).collect()] if stem else [(t, t) for t in names]
    if len(spelt) > QUERY_ROWS or stats.count() * max(len(names), 1) > WEIGHTS:
        return ranked(bm25_scores(corpus, queries, terms, k1, b, top_k if pad else None, stem), top_k)
    sections = {r["section"]: (r["avgdl"], np.zeros(len(names))) for r in stats.collect()}
    for r in idf.collect():
        sections[r["section"]][1][names[r["term"]]] = r["idf"]
    single, several = repeats(corpus)
    weighed = blocks.Weighed([w for w, _ in spelt], [names[t] for _, t in spelt], max(len(names), 1), sections, k1, b)
    wanted = blocks.Asked(list(names), [names[r["term"]] for r in rows], [ids[r["query_id"]] for r in rows], [r["times"] for r in rows], len(ids))
    heads = blocks.heads(single.select("section", "doc_id", spaced or terms), wanted, top_k, weighed)
    scores = heads.join(numbered(list(ids), queries), "q").select("query_id", "section", "doc_id", "score")
    if several is not None:
        scores = scores.unionByName(joined_scores(term_table(several, terms, stem), idf, stats, asked, F.broadcast, k1, b))
    return ranked(scores.unionByName(unshared(corpus, queries, asked, terms, top_k, stem)) if pad else scores, top_k)


def first_documents(corpus: DataFrame, depth: int) -> DataFrame:
    """(section, doc_id) of the first `depth` rows of each section by doc_id."""
    return corpus.select("section", "doc_id", F.row_number().over(Window.partitionBy("section").orderBy("doc_id")).alias("_place")).where(F.col("_place") <= depth).drop("_place")


def unshared(corpus: DataFrame, queries: DataFrame, asked: DataFrame, terms: str, depth: int, stem: bool) -> DataFrame:
    """Score 0 for those of the first `depth` documents of each section that share no term with a query."""
    first = cut(first_documents(corpus, depth))
    held = corpus.join(small(first.distinct()), ["section", "doc_id"], "left_semi").select("section", "doc_id", F.explode(terms).alias("term")).withColumn("n", F.lit(1))
    shared = (stemmed(held, "n") if stem else held).join(small(asked), "term").select("query_id", "section", "doc_id").distinct()
    none = queries.select("query_id").distinct().join(small(first), F.lit(True)).join(shared, ["query_id", "section", "doc_id"], "left_anti")
    return none.select("query_id", "section", "doc_id", F.lit(0.0).alias("score"))


def padded(scores: DataFrame, corpus: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """scores and, with score 0, those of the first `depth` documents of each section by doc_id that a query has none for."""
    first = first_documents(corpus, depth)
    none = queries.select("query_id").distinct().join(small(first), F.lit(True)).join(scores, ["query_id", "section", "doc_id"], "left_anti")
    return scores.unionByName(none.select("query_id", "section", "doc_id", F.lit(0.0).alias("score")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def max_sim(corpus: DataFrame, chunks: DataFrame, top_k: int = 50, count: Accumulator | None = None) -> DataFrame:
    """Best chunk of each query for each document: corpus (section, doc_id, embedding), chunks (query_id, chunk_idx, embedding).

    Exact, by blocks around pivots (`nearest.top_products`); count: adds up the products worked out.
    """
    return ranked(top_products(corpus, chunks, top_k, count), top_k)


def prefixed(texts: Column, role: str, model: str) -> Column:
    """Role prefixes that models of the e5 family expect; other models and roles get the text alone."""
    prefix = {"query": "query: ", "passage": "passage: "}.get(role, "") if "e5" in model.lower() else ""
    return F.concat(F.lit(prefix), texts)


def normalised(vector: Column) -> Column:
    size = F.sqrt(dot(vector, vector))
    return F.when(size > 0, F.transform(vector, lambda x: x / size)).otherwise(vector)


def bordered_words(low: Column, inside: str) -> Column:
    """The words of a lower-cased text, made of the characters of a class, and APART where more than one blank stands between them."""
    apart = rf"[^{inside}]*[^{inside} ][^{inside}]*| {{2,}}"
    return F.split(F.regexp_replace(low, apart, f" {APART} "), " ")


def bordered_grams(low: Column, inside: str, sizes: list[int]) -> Column:
    """The distinct runs of n neighbouring words of a lower-cased text with one blank between them; words are made of the characters of a class."""
    return once(bordered_words(low, inside), lambda w: F.array_distinct(F.concat(*[F.filter(runs_of(w, n), lambda g: ~F.contains(g, F.lit(APART)) & (g != "")) for n in sizes])))


def held_variants(asked: DataFrame, texts: DataFrame, own: list[str], text: str = "text") -> DataFrame:
    """The rows (.., variant) of asked that a text (.., text) of theirs holds between characters other than a-z and 0-9; both have the columns `own`.

    Variants of a-z and 0-9 meet the texts' words and runs of words by hash join,
    which decides. So do others of letters, for which that only finds: what is not
    found may still stand beside a letter that is no border, and is searched in the
    texts that hold its longest run of a-z and 0-9 (variants without one in all).
    """
    plain, letters = "a-z0-9", r"\p{L}\p{N}"
    runs = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    longest = F.array_max(F.transform(runs(F.col("variant")), lambda w: F.struct(F.length(w).alias("size"), w.alias("run"))))["run"]
    words = lambda inside: F.col("variant").rlike(f"^[{inside}]+( [{inside}]+)*$")
    asked = cut(asked.select(*own, "variant").distinct().withColumns({"plain": words(plain), "lettered": words(letters), "n": F.size(F.split("variant", " ")), "run": F.coalesce(longest, F.lit(""))}))
    found = None
    for inside, some in ((plain, asked.where("plain")), (letters, asked.where("lettered and not plain"))):
        few = some.limit(QUERY_ROWS + 1).count() if not own else 0
        sizes = sorted(r[0] for r in some.select("n").distinct().collect())
        if 0 < few <= QUERY_ROWS:
            met = blocks.held_phrases(texts.select(F.lower(text)), [r[0] for r in some.select("variant").collect()], inside == letters)
            found = met if found is None else found.unionByName(met)
        elif sizes:
            grams = texts.select(*own, F.explode(bordered_grams(F.lower(text), inside, sizes)).alias("variant"))
            met = grams.join(small(some.select(*own, "variant")), [*own, "variant"]).distinct()
            found = met if found is None else found.unionByName(met)
    rest = asked.where("not plain")
    if found is not None:
        found = cut(found)
        rest = rest.join(found, [*own, "variant"], "left_anti")
    rest = cut(rest.select(*own, "variant", "run"))
    if not rest.isEmpty():
        if not own and rest.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS:
            may = blocks.holding(texts.select(F.lower(text)), [r[0] for r in rest.select("run").distinct().collect()])
            may = may.select(F.col("text").alias("_t"), F.explode("runs").alias("run")).join(small(rest), "run")
        else:
            # lowered only after the join: before it, that would be done for each run
            may = texts.select(*own, F.col(text).alias("_t"), F.explode(F.array_union(runs(F.col(text)), F.array(F.lit("")))).alias("run")).join(small(rest), [*own, "run"])
            may = may.withColumn("_t", F.lower("_t"))
        more = may.where(stands_in(F.col("_t"), F.col("variant"))).select(*own, "variant").distinct()
        found = cut(more if found is None else found.unionByName(more))
    return found if found is not None else asked.select(*own, "variant").where("false")


def held_terms(terms: DataFrame, corpus: DataFrame, text: str = "text") -> DataFrame:
    """Of (query_id, term) those terms of which a text of the corpus holds a variant: (query_id, held array)."""
    terms = cut(terms)  # worked out once, as it may take every text apart
    each = cut(terms.select("term").distinct().withColumn("variant", F.explode(variants_of(F.col("term")))))
    held = cut(each.join(held_variants(each, corpus, [], text), "variant").select("term").distinct())
    return terms.join(small(held), "term", "left_semi").groupBy("query_id").agg(F.collect_set("term").alias("held"))


def with_variants(keywords: DataFrame) -> DataFrame:
    """keywords (query_id, keyword, freq) with a row for each variant, and what patterns_of says of it."""
    each = keywords.where(F.trim("keyword") != "").withColumn("term", F.explode(variants_of(F.col("keyword"))))
    return patterns_of(each).withColumnRenamed("term", "variant")


def keyword_channel(corpus: DataFrame, keywords: DataFrame, text: str = "text") -> DataFrame:
    """Sum of the frequencies of the query's keywords that a document holds, by any variant; keywords (query_id, keyword, freq).

    A document's words and runs of neighbouring words, of the lengths that are
    asked, meet the variants by hash join, so one look at the text serves any
    number of keywords. Only variants with marks are searched by their pattern,
    in documents that hold one of their words whole.
    """
    keywords = keywords.groupBy("query_id", "keyword").agg(F.max("freq").alias("freq"))
    asked = cut(with_variants(keywords))
    names = asked.select("query_id", "keyword", "freq", "variant")
    lengths = sorted(r[0] for r in asked.where("plain").select(F.size(F.split("variant", " "))).distinct().collect())
    parts = []
    if lengths:
        held = corpus.select("section", "doc_id", F.explode(word_grams(F.col(text), lengths)).alias("variant"))
        parts.append(held.join(small(names.join(asked.where("plain").select("variant").distinct(), "variant", "left_semi")), "variant"))
    patterns = asked.where("not plain").select("variant", "run", "raw", "pattern").distinct()
    if not patterns.isEmpty():
        runs = corpus.select("section", "doc_id", F.explode(F.array_union(word_runs(normalise(F.col(text))), word_runs(F.lower(text)))).alias("run"))
        may = runs.join(small(patterns.where("run is not null")), "run").select("section", "doc_id", "variant", "raw", "pattern")
        found = may.join(corpus.select("section", "doc_id", F.col(text).alias("_t")), ["section", "doc_id"])
        found = found.where(F.regexp_like(F.when(F.col("raw"), F.lower("_t")).otherwise(normalise(F.col("_t"))), F.col("pattern"))).select("section", "doc_id", "variant")
        marks = patterns.where("run is null")
        if not marks.isEmpty():  # terms of marks alone have no word to meet by
            found = found.unionByName(corpus.select("section", "doc_id", F.lower(text).alias("_t")).join(small(marks), F.regexp_like("_t", F.col("pattern"))).select("section", "doc_id", "variant"))
        parts.append(found.join(small(names), "variant"))
    if not parts:
        return corpus.join(keywords, F.lit(False)).select("query_id", "section", "doc_id", F.lit(0.0).alias("score"))
    each = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    # a document holds a keyword once, whichever of its variants; a query's keywords are few
    once_each = each.groupBy("query_id", "section", "doc_id").agg(F.collect_set(F.struct("keyword", "freq")).alias("k"))
    return once_each.select("query_id", "section", "doc_id", F.aggregate("k", F.lit(0).cast("long"), lambda s, k: s + k["freq"]).cast("double").alias("score"))


def keywords_ranked(corpus: DataFrame, keywords: DataFrame, top_k: int, text: str = "text") -> DataFrame:
    """keyword_channel's ranking down to top_k: tasks find keywords of words alone and hand on their heads; where others are asked, joins find all."""
    keywords = cut(keywords.groupBy("query_id", "keyword").agg(F.max("freq").alias("freq")))
    if keywords.limit(QUERY_ROWS + 1).count() > QUERY_ROWS:
        return ranked(keyword_channel(corpus, keywords, text), top_k)
    variants = with_variants(keywords.select("keyword").distinct()).select("keyword", "variant", "plain").distinct().collect()
    if not variants or not all(r["plain"] for r in variants):
        return ranked(keyword_channel(corpus, keywords, text), top_k)
    rows = keywords.join(F.broadcast(keywords.sparkSession.createDataFrame([(k,) for k in {r["keyword"] for r in variants}], "keyword string")), "keyword", "left_semi").collect()
    ids = {k: i for i, k in enumerate(dict.fromkeys(r["query_id"] for r in rows))}
    names = {k: i for i, k in enumerate(dict.fromkeys(r["keyword"] for r in rows))}
    phrases = blocks.Phrases([r["variant"] for r in variants], [names[r["keyword"]] for r in variants], len(names))
    wanted = blocks.Asked(list(names), [names[r["keyword"]] for r in rows], [ids[r["query_id"]] for r in rows], [r["freq"] for r in rows], len(ids))
    single, several = repeats(corpus)
    heads = blocks.heads(single.select("section", "doc_id", parted_text(F.col(text)).alias("_words")), wanted, top_k, phrases)
    scores = heads.join(numbered(list(ids), keywords), "q").select("query_id", "section", "doc_id", "score")
    if several is not None:
        scores = scores.unionByName(keyword_channel(several, keywords, text))
    return ranked(scores, top_k)


def rrf(channels: list[tuple[DataFrame, float]], k: int = 15) -> DataFrame:
    """Weighted reciprocal rank fusion; a channel of weight 0 is not even planned. Ties keep channel order, then rank."""
    parts = [df.select("query_id", "section", "doc_id", "rank", F.lit(w).alias("w"), F.lit(c).alias("c")) for c, (df, w) in enumerate(channels) if w > 0]
    if not parts:
        raise ValueError("all channels have weight 0")
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    # summed in the channels' order, which a plain sum would leave open
    terms = F.transform(F.array_sort(F.collect_list(F.struct("c", "w", "rank"))), lambda t: t["w"] / (F.lit(k) + t["rank"] + 1))
    fused = every.groupBy("query_id", "section", "doc_id").agg(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("score"), F.min(F.struct("c", "rank")).alias("first")).where("score > 0")
    order = Window.partitionBy("query_id", "section").orderBy(F.round("score", 12).desc(), "first", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order) - 1).drop("first")


def positional(fused: DataFrame) -> DataFrame:
    """Scores from places alone: 1 / place, rounded half-even to three digits."""
    return fused.withColumn("score", F.bround(1 / (F.col("rank") + 1), 3))


def rerank(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], head: int = 30, query: str = "query_text", text: str = "text") -> DataFrame:
    """The fused head re-scored by a pluggable model: sigmoid of its score, rounded to three digits. The rank cut comes first."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield scorer(q, t)

    return pairs.where(F.col("rank") < head).withColumn("score", F.bround(1 / (1 + F.exp(-score(query, text))), 3))


def penalise(scored: DataFrame, negated: Column, factor: float = 0.3) -> DataFrame:
    """Scores of rows that a query excludes shrink; the order stays for the caller to renew."""
    return scored.withColumn("score", F.when(negated, F.bround(F.col("score") * factor, 3)).otherwise(F.col("score")))


def term_frequencies(queries: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """(query_id, keyword, freq) of the listed terms that a query's text holds; `ranked_keywords` orders them."""
    listed = queries.sparkSession.createDataFrame([(t.lower(),) for t in dict.fromkeys(terms)], "term string")
    return term_counts(queries.select("query_id", F.col(text).alias("text")), listed).withColumnRenamed("term", "keyword")


def snippet(best_chunk: Column) -> Column:
    return F.substring(best_chunk, 1, 200)


def ranked_keywords(frequencies: DataFrame) -> DataFrame:
    """pos: a keyword's place in its query, most frequent first, then by name."""
    return frequencies.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("freq").desc(), "keyword")) - 1)
