"""The whole selection, for many queries at once: channels, fusion, scores, entries, slots, keywords, and the document they make.

Everything is a plan over frames; models (an encoder, a re-ranker) are plain
callables and optional: without an encoder the dense channel is left out,
without a re-ranker places alone score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import assembly, phrases, report, retrieval, selection
from siftline.operators.lineage import cut
from siftline.sources.segments import SegmentIndex

from .config import Settings

GROUPED, FLAT = ("experience", "projects"), ("skills", "education")


@dataclass(frozen=True)
class Selection:
    """ranked: every scored slot; entries: (.., position by score, place by date, included, shown, swap_step); flat: skills and education; keywords: with variants; queries: with chunks and negated terms."""

    queries: DataFrame
    keywords: DataFrame
    ranked: DataFrame
    entries: DataFrame
    slots: DataFrame
    flat: DataFrame
    summary: DataFrame
    mode: str


def prepared(queries: DataFrame, corpus: DataFrame, dictionary=()) -> DataFrame:
    """queries (query_id, text) with query_text, chunks, held (terms of theirs that the corpus holds) and negated."""
    q = queries.withColumn("query_text", T.requirements(F.col("text"))).withColumn("chunks", T.chunks(F.col("query_text")))
    terms = q.select("query_id", F.explode(F.array_union(T.open_candidates(F.col("text")), T.negated_candidates(F.col("text")))).alias("term"))
    q = q.join(retrieval.held_terms(terms, corpus), "query_id", "left")
    return q.withColumn("negated", T.negated_terms(F.col("text"), F.col("held"), dictionary))


def keywords_of(queries: DataFrame, dictionary=(), custom=()) -> DataFrame:
    """(query_id, keyword, freq, kind, pos): dictionary terms by count, custom ones always, open ones that the corpus holds; most frequent first, then by name.

    queries: prepared(). A term's kind is the first of those that find it.
    """
    own = T.custom_terms(list(custom))
    listed = None
    if dictionary:
        terms = queries.sparkSession.createDataFrame([(t,) for t in sorted(dictionary)], "term string")
        counts = retrieval.term_frequencies(queries, sorted(dictionary)).withColumnRenamed("keyword", "term")
        listed = phrases.dictionary_matches(queries.select("query_id", "text"), terms).join(counts, ["query_id", "term"], "left").select("query_id", F.col("term").alias("keyword"), F.coalesce("freq", F.lit(0)).alias("freq"))
    forced = queries.select("query_id", F.explode(F.array(*[F.struct(F.lit(t).alias("keyword"), F.greatest(T.count_term(F.col("text"), t), F.lit(1)).cast("int").alias("freq")) for t in own])).alias("k")).select("query_id", "k.*") if own else None
    opened = queries.select("query_id", F.explode(T.open_terms(F.col("text"), F.col("held"), {*dictionary, *own})).alias("keyword"), "text")
    # an open term's pattern differs from row to row: its words stand between borders in the normalised text
    body = F.array_join(F.transform(F.split("keyword", " "), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s+")
    count = F.regexp_count(T.normalise(F.col("text")), F.concat(F.lit(r"(?U)(?<!\w)"), body, F.lit(r"(?!\w)")))
    opened = opened.select("query_id", "keyword", F.greatest(count, F.lit(1)).cast("int").alias("freq"))
    every = None
    for kind, df in enumerate((listed, forced, opened)):
        if df is not None:
            df = df.select("query_id", "keyword", "freq", F.lit(kind).alias("kind"))
            every = df if every is None else every.unionByName(df)
    first = every.groupBy("query_id", "keyword").agg(F.min_by("freq", "kind").alias("freq"), F.min("kind").alias("kind"))
    return retrieval.ranked_keywords(first)


def preview(queries: DataFrame, corpus: DataFrame, dictionary=(), custom=(), manual=()) -> DataFrame:
    """Keywords of queries with in_master, without any model."""
    found = keywords_of(prepared(queries, corpus, dictionary), dictionary, [*custom, *manual])
    return marked(found, corpus.withColumn("query_id", F.lit(None).cast("string")), every=True).withColumnRenamed("held", "in_master")


def marked(keywords: DataFrame, texts: DataFrame, every: bool) -> DataFrame:
    """keywords with held: whether a text holds a variant of theirs; every: texts belong to all queries, else to their query_id."""
    each = cut(keywords.select("query_id", "keyword", F.explode(retrieval.variants_of(F.col("keyword"))).alias("variant")))
    own = [] if every else ["query_id"]
    held = retrieval.held_variants(each, texts, own)
    found = each.join(held, [*own, "variant"], "left_semi").select("query_id", "keyword").distinct().withColumn("held", F.lit(True))
    return keywords.join(found, ["query_id", "keyword"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def encoded(df: DataFrame, text: str, encode: Callable[[list[str]], list]) -> DataFrame:
    """df with an embedding of the text, by Arrow batches."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encode(texts.tolist())))

    return df.withColumn("embedding", vectors(text))


def limit_of(settings: Settings, limits: dict[str, int] | None) -> Column:
    known = {"experience": settings.max_experience, "projects": settings.max_projects, "skills": settings.max_skills, "education": settings.max_education_extra} | (limits or {})
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[F.col("section")], F.lit(settings.max_projects))


def select(
    corpus: DataFrame,
    queries: DataFrame,
    settings: Settings | None = None,
    dictionary=(),
    encode: Callable[[list[str]], list] | None = None,
    model: str = "",
    scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None,
    section: str | None = None,
    limits: dict[str, int] | None = None,
    summaries: DataFrame | None = None,
    hypothetical: DataFrame | None = None,
    tokenise: Callable[[Column], Column] = T.tokens,
    keywords: DataFrame | None = None,
    pad: bool = True,
    index: SegmentIndex | None = None,
) -> Selection:
    """corpus (section, doc_id, entry_index, slot_index, text, start_date), queries (query_id, text).

    section: that section alone, without swaps across sections. limits: entries
    by section, over the settings. hypothetical: (query_id, answer) texts that
    stand before a query's chunks in the dense channel. keywords: (query_id,
    keyword, freq) that rule instead of those found in the queries. pad: the
    sparse channel shows documents of score 0 up to its depth. index: an index of
    the corpus (sync() brings it there), made with the same tokenise and stems; its
    postings give the sparse channel and its documents stand for the corpus, which
    isn't read or tokenised (and may be None). All channels are cut at the settings'
    depth. What queries, keywords, rankings and entries are is
    written down once each, so no plan holds more than one of these steps.
    """
    s = settings or Settings()
    if errors := s.errors():
        raise ValueError("; ".join(errors))
    if index is not None:
        corpus = index.documents()
    everything = corpus
    if section:
        corpus = corpus.where(F.col("section") == section)
    q = prepared(queries, everything, dictionary)
    if hypothetical is not None:
        q = q.join(hypothetical, "query_id", "left").withColumn("chunks", F.when(F.coalesce("answer", F.lit("")) != "", F.concat(F.array("answer"), F.col("chunks"))).otherwise(F.col("chunks"))).drop("answer")
    q = cut(q)
    found = retrieval.ranked_keywords(keywords) if keywords is not None else keywords_of(q, dictionary, s.custom_keywords)
    found = cut(found.withColumn("variants", retrieval.variants_of(F.col("keyword"))))
    asked = q.select("query_id", tokenise(F.col("query_text")).alias("tokens"))
    channels = []
    if s.sparse_weight > 0:
        if index is not None:
            sparse = index.ranked(asked, s.channel_depth, section, pad)
        else:
            sparse = retrieval.bm25_ranked(corpus.withColumn("tokens", tokenise(F.col("text"))), asked, s.channel_depth, pad=pad, stem=s.use_stemming)
        channels.append((sparse, s.sparse_weight))
    best = None
    if encode is not None and s.dense_weight > 0:
        chunks = q.select("query_id", F.posexplode("chunks").alias("chunk_idx", "chunk"))
        vectors = encoded(corpus.select("section", "doc_id", retrieval.prefixed(F.col("text"), "passage", model).alias("t")), "t", encode)
        dense = retrieval.max_sim(vectors, encoded(chunks.select("query_id", "chunk_idx", retrieval.prefixed(F.col("chunk"), "query", model).alias("t")), "t", encode), s.channel_depth)
        best = dense.select("query_id", "section", "doc_id", "best_chunk")
        channels.append((dense, s.dense_weight))
    if s.keyword_weight > 0:
        channels.append((retrieval.keywords_ranked(corpus, found.select("query_id", "keyword", "freq"), s.channel_depth), s.keyword_weight))
    fused = cut(retrieval.rrf(channels, s.rrf_k))
    about = corpus.select("section", "doc_id", "entry_index", "slot_index", "text", *(["tokens"] if index is not None else []))
    asking = cut(q.select("query_id", "query_text", "chunks", "negated", F.transform("chunks", T.reason_words).alias("_chunk_words"), T.reason_words(F.col("query_text")).alias("_query_words")))
    # tokens and words of what is shown alone, so after the join
    shown = about.join(retrieval.small(fused.select("section", "doc_id").distinct()), ["section", "doc_id"], "left_semi")
    shown = shown if index is not None else shown.withColumn("tokens", tokenise(F.col("text")))
    shown = cut(shown.withColumn("_words", T.reason_words(F.col("text"))))
    hits = fused.join(shown, ["section", "doc_id"]).join(retrieval.small(asking), "query_id")
    hits = hits.join(best, ["query_id", "section", "doc_id"], "left") if best is not None else hits.withColumn("best_chunk", F.lit(0))
    at = F.coalesce("best_chunk", F.lit(0))
    chunk, chunk_words = F.coalesce(F.get("chunks", at), F.col("query_text")), F.coalesce(F.get("_chunk_words", at), F.col("_query_words"))
    reranks = scorer is not None and s.use_reranker
    scored = retrieval.rerank(hits, scorer, s.rerank_depth, "query_text") if reranks else retrieval.positional(hits)
    if reranks:
        order = Window.partitionBy("query_id", "section").orderBy(F.col("score").desc(), "rank")
        scored = scored.withColumn("rank", F.row_number().over(order) - 1)
    scored = retrieval.penalise(scored, T.excludes(F.col("negated"), F.col("text")), s.negation_factor).withColumns({"snippet": retrieval.snippet(chunk), "reason": selection.match_reason(F.col("_words"), chunk_words)})
    scored = scored.drop("chunks", "query_text", "best_chunk", "_words", "_chunk_words", "_query_words")

    wanted = found.where(F.col("freq") >= s.critical_frequency).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "keyword", "variants"))), lambda k: F.struct(k["keyword"].alias("keyword"), k["variants"].alias("variants"))).alias("critical"))
    none = F.expr("cast(array() as array<struct<keyword:string,variants:array<string>>>)")
    scored = cut(scored.join(retrieval.small(wanted), "query_id", "left").withColumn("critical", F.coalesce("critical", none)))
    keys = ["query_id", "section", "entry_index"]
    flat = ~F.col("section").isin(*FLAT)
    # slots of an entry compete by score, which a penalty may have lowered
    by_score = scored.where(flat).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "section").orderBy(F.col("score").desc(), "rank")) - 1)
    entries = selection.group_entries(by_score, limit_of(s, limits))
    first = by_score.groupBy(*keys).agg(F.min_by("reason", "rank").alias("reason"))
    slots = selection.select_slots(by_score, s.max_highlights, s.mmr_balance, "critical", s.use_stemming)
    shown = slots.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "slot_index"))), lambda x: x["slot_index"]).alias("shown"))
    # an excluded entry lists all its slots, a selected one those it shows
    entries = cut(entries.join(shown, keys).join(first, keys).withColumn("shown", F.when(F.col("included"), F.col("shown")).otherwise(F.col("slots"))))
    if not section and s.max_coverage_swaps:
        entries = swapped(entries, by_score, everything, s)
    else:
        entries = entries.withColumn("swap_step", F.lit(0))
    entries = cut(entries) if not section and s.max_coverage_swaps else entries
    dated = corpus.groupBy("section", "entry_index").agg(F.min("start_date").alias("start_date"))
    entries = selection.chronological(entries.join(dated, ["section", "entry_index"], "left"), "start_date", ["query_id", "section", "included"], name="place")
    lists = selection.distinct_entries(scored.where(~flat & ~((F.col("section") == "education") & (F.col("entry_index") == 0))), limit_of(s, limits))
    one = None
    if summaries is not None:
        texts = summaries.select(F.col("entry_index").alias("index"), "text", tokenise(F.col("text")).alias("tokens"))
        one = selection.summary_pick(texts, q.select("query_id", "query_text", tokenise(F.col("query_text")).alias("tokens")), scorer if reranks else None, s.use_stemming)
    return Selection(q, found, scored, entries, slots, lists, one, "cross_encoder" if reranks else "positional_fallback")


def swapped(entries: DataFrame, ranked: DataFrame, corpus: DataFrame, s: Settings) -> DataFrame:
    """entries after the swaps for critical keywords that no shown slot holds; included marks those shown in the end."""
    keys = ["query_id", "section", "entry_index"]
    mine = ranked.groupBy(*keys).agg(F.collect_list(F.struct("slot_index", "score", "text", "tokens", F.lit(True).alias("ranked"))).alias("all_slots"), F.first("critical").alias("critical"), F.first("negated").alias("negated"))
    rows = entries.join(mine, keys).select(*keys, "entry_score", "position", "included", "shown", F.col("all_slots").alias("slots"), "critical", "negated")
    out = selection.swap_coverage(rows, s.max_highlights, s.max_coverage_swaps, s.mmr_balance).select(*keys, F.col("shown").alias("_shown"), F.col("swap_step"))
    joined = entries.join(out.withColumn("_in", F.lit(True)), keys, "left")
    return joined.withColumns({"included": F.col("_in").isNotNull(), "shown": F.coalesce("_shown", "shown"), "swap_step": F.coalesce("swap_step", F.lit(0))}).drop("_shown", "_in")


def generate(corpus: DataFrame, slots: DataFrame, queries: DataFrame, settings: Settings | None = None, manual=(), check: DataFrame | None = None, **how) -> tuple[DataFrame, Selection, DataFrame, DataFrame]:
    """(lines, selection, keyword report, variant usage) of each query's document.

    slots (section, entry_index, slot_index, ach_id, text, variants) resolve what
    the selection shows, and hold the sections that no selection touches: of the
    summaries each query gets one, languages and sections of other names stay whole.
    check: texts against which keywords are verified (the corpus itself where there
    are none).
    """
    s = settings or Settings()
    summaries = assembly.texts_of(slots.where("section = 'summary'")).select("entry_index", F.col("emittable").alias("text")).where("text is not null")
    chosen = select(corpus, queries, s, summaries=summaries, **how)
    items = chosen.entries.where("included").select("query_id", "section", F.col("place").alias("position"), "entry_index", F.col("shown").alias("slot_order"), F.expr("cast(map() as map<int,string>)").alias("angles"))
    items = cut(items)
    words = cut(verified(chosen, queries, check if check is not None else corpus, s, manual))
    parts = [assembly.section_lines(name, items, slots, s) for name in GROUPED]
    skills = chosen.flat.where("section = 'skills' and included").select("query_id", "section", "position", "entry_index")
    parts.append(assembly.section_lines("skills", skills, slots, s, words))
    school = assembly.education(chosen.flat.where("section = 'education' and included").select("query_id", "position", "entry_index").unionByName(queries.select("query_id", F.lit(-1).cast("int").alias("position"), F.lit(-1).alias("entry_index"))), slots, s.max_education_extra)
    texts = assembly.texts_of(slots.where("section = 'education'"))
    parts.append(school.join(texts, "entry_index").select("query_id", F.lit("education").alias("section"), "place", "entry_index", F.col("slot_index").alias("out_pos"), "slot_index", F.col("emittable").alias("text"), "ach_id", F.lit(None).cast("string").alias("variant_id"), F.lit("").alias("angle")))
    line = words.select("query_id", F.lit("keywords").alias("section"), F.lit(0).alias("place"), F.lit(0).alias("entry_index"), F.lit(0).alias("out_pos"), F.lit(0).alias("slot_index"), assembly.keyword_line(F.col("keywords")).alias("text"), F.lit(None).cast("string").alias("ach_id"), F.lit(None).cast("string").alias("variant_id"), F.lit("").alias("angle")).where("text is not null")
    parts += [summary_line(chosen.summary, summaries), untouched(queries, slots)]
    lines = line
    for part in parts:
        lines = lines.unionByName(part)
    lines = cut(lines)
    asked = cut(keywords_of(chosen.queries, how.get("dictionary", ()), [*s.custom_keywords, *manual]))
    known = marked(asked, corpus.withColumn("query_id", F.lit(None).cast("string")), every=True).withColumnRenamed("held", "in_master")
    both = marked(known, lines, every=False).withColumnRenamed("held", "in_target").withColumn("critical", F.col("freq") >= s.critical_frequency)
    used = lines.where("variant_id is not null").groupBy("query_id", "variant_id").agg(F.count("*").alias("times"))
    return lines, chosen, report.summary(both), used


def as_lines(rows: DataFrame) -> DataFrame:
    """Lines of (query_id, section, place, entry_index, out_pos, slot_index, text, ach_id) that show no variant."""
    return rows.select("query_id", "section", F.col("place").cast("int").alias("place"), "entry_index", F.col("out_pos").cast("int").alias("out_pos"), "slot_index", "text", "ach_id", F.lit(None).cast("string").alias("variant_id"), F.lit("").alias("angle"))


def summary_line(picked: DataFrame, summaries: DataFrame) -> DataFrame:
    """The summary of each query, as its one line; none where there is no summary."""
    shown = picked.join(retrieval.small(summaries), F.col("index") == F.col("entry_index"))
    none = F.lit(None).cast("string").alias("ach_id")
    return as_lines(shown.select("query_id", F.lit("summary").alias("section"), F.lit(0).alias("place"), "entry_index", F.lit(0).alias("out_pos"), F.lit(0).alias("slot_index"), "text", none))


def untouched(queries: DataFrame, slots: DataFrame) -> DataFrame:
    """Languages, and sections that no step handles, whole and in order, for each query."""
    kept = slots.where("section = 'languages'").unionByName(assembly.passed_through(slots))
    kept = assembly.texts_of(kept).where("emittable is not null").select("section", "entry_index", "slot_index", F.col("emittable").alias("text"), "ach_id")
    each = queries.select("query_id").join(retrieval.small(kept), F.lit(True))
    return as_lines(each.withColumns({"place": F.col("entry_index"), "out_pos": F.col("slot_index")}))


def verified(chosen: Selection, queries: DataFrame, texts: DataFrame, s: Settings, manual=()) -> DataFrame:
    """(query_id, keywords): manual keywords that the texts hold, then detected ones that texts and query hold and the query doesn't exclude, within the budget."""
    own = T.custom_terms(list(s.custom_keywords))
    found = chosen.keywords.select("query_id", "keyword", F.col("pos").cast("int").alias("pos"))
    if own:
        first = queries.select("query_id", F.posexplode(F.array(*map(F.lit, own))).alias("pos", "keyword")).withColumn("pos", F.col("pos") - len(own))
        found = first.select("query_id", "keyword", "pos").unionByName(found).groupBy("query_id", "keyword").agg(F.min("pos").alias("pos"))
    budget = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("_n") <= s.max_keywords).drop("_n")
    kept = budget.join(chosen.queries.select("query_id", "text", "negated"), "query_id").withColumn("variants", retrieval.variants_of(F.col("keyword")))
    kept = kept.where(~F.arrays_overlap("variants", "negated") & F.exists("variants", lambda v: T.stands_in(F.lower("text"), v)))
    held = marked(kept.select("query_id", "keyword", "pos"), texts, every=True)
    if manual:
        typed = queries.select("query_id", F.posexplode(F.array(*[F.lit(m.strip()) for m in manual if m and m.strip()])).alias("pos", "keyword")).withColumn("pos", F.col("pos") - 1000)
        held = held.unionByName(marked(typed, texts, every=True).select(*held.columns))
    return report.verified_keywords(held, F.col("held"), F.lit(True), s.max_keywords)


def regenerate(corpus: DataFrame, slots: DataFrame, queries: DataFrame, section: str, settings: Settings | None = None, **how) -> tuple[DataFrame, Selection]:
    """(lines, selection) of one section: experience, projects or skills."""
    s = settings or Settings()
    chosen = select(corpus, queries, s, section=section, **how)
    if section == "skills":
        items = chosen.flat.where("included").select("query_id", "section", "position", "entry_index")
    else:
        items = chosen.entries.where("included").select("query_id", "section", F.col("place").alias("position"), "entry_index", F.col("shown").alias("slot_order"), F.expr("cast(map() as map<int,string>)").alias("angles"))
    return assembly.section_lines(section, items, slots, s), chosen
