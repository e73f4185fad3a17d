"""Queries of the document operators: corpora, located keywords, assembly, whole selections. Importing it registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.functions.stems import stem_table
from siftline.functions.title import title_of
from siftline.operators import assembly, corpora, history, importer, retrieval, selection

from . import selecting
from .config import Settings
from .registry import APART, BM25, CUT, RRF, TERMS, TOKENS, corpus, fused, offer_keywords, offer_words, offers, placed, plain, query, table


def conversation_documents(spark, sf_dir) -> DataFrame:
    """Each conversation as a nested document: its first text as the summary, a turn an entry of experience."""
    turn = F.struct("turn", "role", "text")
    each = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    entry = lambda t: F.struct(t["role"].alias("name"), F.array(F.coalesce(t["text"], F.lit(""))).alias("highlights"))
    sections = F.struct(F.transform(F.slice("t", 1, 1), lambda t: F.coalesce(t["text"], F.lit(""))).alias("summary"), F.transform("t", entry).alias("experience"))
    return each.select(F.col("conv_id").alias("doc"), F.to_json(F.struct(F.struct(sections.alias("sections")).alias("cv"))).alias("text"))


CONV = """c AS (SELECT conv_id AS doc, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS e FROM conversations),
    p AS (SELECT doc, 'experience' AS section, e AS entry_index, 'highlights' AS field, 0 AS item, text FROM c UNION ALL SELECT doc, 'experience', e, 'name', NULL, role FROM c UNION ALL SELECT doc, 'summary', 0, NULL, NULL, text FROM c WHERE e = 0)"""


@query(f"WITH {CONV} SELECT doc, section, entry_index::INT AS entry_index, field, item::INT AS item, md5(text) AS digest FROM p")
def document_pieces(spark, sf_dir):
    out = corpora.pieces(corpora.entries(conversation_documents(spark, sf_dir)))
    return out.select("doc", "section", "entry_index", "field", "item", F.md5("text").alias("digest"))


@query(f"WITH {CONV} SELECT doc, md5(lower(string_agg(text, ' ' ORDER BY section, entry_index, field, item))) AS digest FROM p GROUP BY 1")
def report_corpora(spark, sf_dir):
    return corpora.report_corpus(corpora.entries(conversation_documents(spark, sf_dir))).select("doc", F.md5("corpus").alias("digest"))


@query(f"WITH {CONV} SELECT doc, md5(lower(string_agg(text, ' ' || chr(10) || ' ' ORDER BY section, entry_index, field, item))) AS digest FROM p GROUP BY 1")
def check_corpora(spark, sf_dir):
    return corpora.check_corpus(corpora.entries(conversation_documents(spark, sf_dir))).select("doc", F.md5("corpus").alias("digest"))


@query(f"WITH {CONV} SELECT doc, md5(lower(string_agg(text, ' ' || chr(10) || ' ' ORDER BY section DESC, entry_index, field DESC, item))) AS digest FROM p GROUP BY 1")
def whole_texts(spark, sf_dir):
    return corpora.whole_text(conversation_documents(spark, sf_dir)).select("doc", F.md5("corpus").alias("digest"))


@query(f"WITH {CONV} SELECT DISTINCT doc, section, CASE section WHEN 'summary' THEN 'text' ELSE 'entries' END AS kind FROM p")
def section_kinds(spark, sf_dir):
    return corpora.section_kinds(corpora.entries(conversation_documents(spark, sf_dir)))


LISTED = ", ".join(f"('{t}')" for t in TERMS)


@query(f"""WITH {CONV}, k(keyword) AS (VALUES {LISTED})
    SELECT DISTINCT keyword, doc, section, entry_index::INT AS entry_index, field, item::INT AS item FROM p JOIN k ON regexp_matches(lower(text), '(^|[^a-z0-9])' || keyword || '([^a-z0-9]|$)')""")
def keyword_locations(spark, sf_dir):
    keywords = spark.createDataFrame([(t, [t]) for t in TERMS], "keyword string, variants array<string>")
    found = corpora.keyword_locations(keywords, corpora.pieces(corpora.entries(conversation_documents(spark, sf_dir))))
    return found.select("keyword", "doc", "section", "entry_index", "field", "item")


@query("""WITH t AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS entry_index, turn, length(coalesce(text, '')) AS size FROM conversations),
    r AS (SELECT doc, entry_index, 'highlights and achievements at once' AS rule FROM t WHERE turn % 2 = 0 UNION ALL SELECT doc, entry_index, 'an achievement lacks its id' FROM t WHERE turn % 3 = 0
        UNION ALL SELECT doc, entry_index, 'a variant lacks its text' FROM t WHERE size % 5 = 0 UNION ALL SELECT doc, entry_index, 'a variant has an unknown status' FROM t WHERE size % 7 = 0
        UNION ALL SELECT doc, entry_index, 'a variant has more than two angles' FROM t WHERE size % 4 = 1 UNION ALL SELECT doc, entry_index, 'a variant has an unknown angle' FROM t WHERE size % 4 = 1)
    SELECT doc, entry_index::INT AS entry_index, rule FROM r""")
def structure_rules(spark, sf_dir):
    """Documents of which some entries break some rules, by turn and length of text."""
    size, turn = (lambda t: F.length(F.coalesce(t["text"], F.lit("")))), (lambda t: t["turn"])
    variant = lambda t: F.struct(F.lit("v").alias("id"), F.when(size(t) % 5 == 0, " ").otherwise("x").alias("text"), F.when(size(t) % 7 == 0, "nonsense").otherwise("approved").alias("status"), F.when(size(t) % 4 == 1, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"))).alias("angle"))
    entry = lambda t: F.struct(F.when(turn(t) % 2 == 0, F.array(F.lit("line"))).alias("highlights"), F.array(F.struct(F.when(turn(t) % 3 == 0, "").otherwise("id").alias("id"), F.array(variant(t)).alias("variants"))).alias("achievements"))
    each = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    docs = each.select(F.col("conv_id").alias("doc"), F.to_json(F.struct(F.struct(F.struct(F.transform("t", entry).alias("experience")).alias("sections")).alias("cv"))).alias("text"))
    return corpora.structure_errors(corpora.entries(docs), ["a", "b"]).select("doc", "entry_index", "rule")


@query(r"""WITH o AS (SELECT doc_id, lower(text) AS t, length(text) AS n FROM documents), g AS (SELECT doc_id, n, string_split(t, 'the') AS w FROM o),
    s AS (SELECT doc_id, len(w)::INT - 1 AS k, list_sum(list_transform(range(1, len(w)), lambda i: list_sum(list_transform(w[1:i], lambda x: length(x))) + 3 * (i - 1)))::BIGINT AS starts FROM g)
    SELECT doc_id, k AS n_places, coalesce(starts, 0) AS starts FROM s""")
def term_places(spark, sf_dir):
    """Where a term stands."""
    out = table(spark, sf_dir, "documents").select("doc_id", corpora.occurrences(F.col("text"), F.lit("the")).alias("r"))
    return out.select("doc_id", F.size("r").alias("n_places"), F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s + x["start"]).alias("starts"))


def numbered_slots(spark, sf_dir) -> DataFrame:
    """Documents as slots: sections are languages, entries sources."""
    order = Window.partitionBy("lang", "source").orderBy("doc_id")
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("section"), F.expr("cast(substring(source, 4) as int)").alias("entry_index"), (F.row_number().over(order) - 1).alias("slot_index"), F.concat(F.lit("a"), "doc_id").alias("ach_id"), "text", "doc_id")
    return docs.withColumn("variants", F.expr("cast(null as array<struct<id:string,text:string,angles:array<string>,status:string,source:string,used_count:int,created_at:string>>)"))


SLOTS = "s AS (SELECT lang AS section, substr(source, 4)::INT AS entry_index, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS slot_index, text, doc_id FROM documents)"


@query(f"""WITH {SLOTS}, q AS (SELECT item_id AS query_id, unnest([item_id % 20, (item_id + 7) % 20, 999]) AS entry_index, unnest([0, 1, 2]) AS position FROM benchmark),
    e AS (SELECT DISTINCT section, entry_index FROM s), v AS (SELECT query_id, section, entry_index, row_number() OVER (PARTITION BY query_id, section ORDER BY position) - 1 AS place FROM q JOIN e USING (entry_index)),
    o AS (SELECT v.*, unnest([4, 0, 2, 0, 7000]) AS slot_index, unnest([0, 1, 2, 3, 4]) AS k FROM v WHERE place < 1),
    t AS (SELECT query_id, section, place, entry_index, text, min(k) AS k FROM o JOIN s USING (section, entry_index, slot_index) GROUP BY 1, 2, 3, 4, 5)
    SELECT query_id, section, place::INT AS place, entry_index, (row_number() OVER (PARTITION BY query_id, section, entry_index ORDER BY k) - 1)::INT AS out_pos, md5(text) AS digest FROM t QUALIFY out_pos < 2""")
def assembled_lines(spark, sf_dir):
    order = F.array(*[F.lit(k) for k in (4, 0, 2, 0, 7000)])
    named = F.array(*[F.struct(F.lit(p).alias("position"), e.cast("int").alias("entry_index")) for p, e in enumerate((F.col("item_id") % 20, (F.col("item_id") + 7) % 20, F.lit(999)))])
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(named).alias("x")).select("query_id", "x.*", order.alias("slot_order"), F.expr("cast(map() as map<int,string>)").alias("angles"))
    slots = numbered_slots(spark, sf_dir)
    every = items.join(retrieval.small(slots.select("section").distinct()), F.lit(True))
    out = assembly.assembled(every, slots, 1, 2)
    return out.select("query_id", "section", F.col("place").cast("int").alias("place"), "entry_index", "out_pos", F.md5("text").alias("digest"))


@query(f"""WITH {BM25} {RRF.format(w=0.5)}, top AS (SELECT query_id, section, doc_id, round_even(1.0::DOUBLE / (rank + 1), 3) AS score FROM fused WHERE rank < 3),
    every AS (SELECT query_id, doc_id FROM (SELECT DISTINCT query_id FROM fused), (SELECT doc_id FROM documents))
    SELECT e.query_id, e.doc_id, t.score, (row_number() OVER (PARTITION BY e.query_id ORDER BY t.score DESC NULLS LAST, e.doc_id) - 1)::INT AS place FROM every e LEFT JOIN top t USING (query_id, doc_id)
    WHERE NOT (t.score IS NOT NULL AND t.score >= 1)""")
def excluded_panel(spark, sf_dir):
    slots = table(spark, sf_dir, "documents").select(F.lit("").alias("section"), F.lit(3).alias("entry_index"), F.col("doc_id").alias("slot_index"))
    ranked = fused(spark, sf_dir)
    scores = retrieval.positional(ranked.where("rank < 3")).select("query_id", F.lit("").alias("section"), F.lit(3).alias("entry_index"), F.col("doc_id").alias("slot_index"), "score")
    shown = scores.where("score >= 1").select("query_id", "section", "entry_index", "slot_index")
    out = assembly.excluded_panel(slots, shown, scores)
    return out.select("query_id", F.col("slot_index").alias("doc_id"), "score", F.col("place").cast("int").alias("place"))


@query(f"""WITH {BM25} {RRF.format(w=0.5)}, p AS (SELECT query_id || '/' || section AS query_id, substr(source, 4)::INT AS entry_index, min(rank) AS position FROM fused JOIN c USING (section, doc_id) GROUP BY ALL),
    e AS (SELECT DISTINCT substr(source, 4)::INT AS entry_index FROM documents),
    m AS (SELECT query_id, entry_index, row_number() OVER (PARTITION BY query_id ORDER BY position) AS place FROM p JOIN e USING (entry_index) WHERE entry_index > 0 QUALIFY place <= 1)
    SELECT DISTINCT query_id, 0::INT AS place, e.entry_index FROM p, e WHERE e.entry_index = 0 UNION ALL SELECT query_id, place::INT, entry_index FROM m""")
def education_entries(spark, sf_dir):
    """Each query's entries in each language, as if that were its list of degrees."""
    number = F.expr("cast(substring(entry_index, 4) as int)")
    ranked = placed(spark, sf_dir).withColumns({"entry_index": number, "query_id": F.concat_ws("/", "query_id", "section")})
    picked = ranked.groupBy("query_id", "entry_index").agg(F.min("rank").alias("position"))
    entries = corpus(spark, sf_dir).select(F.lit("education").alias("section"), number.alias("entry_index")).distinct()
    return assembly.education(picked, entries, 1).select("query_id", F.col("place").cast("int").alias("place"), "entry_index")


@query("""SELECT user_id AS run_id, event_type, max(event_id) AS item, arg_max(CASE WHEN value > 50 THEN 'kept' ELSE 'gone' END, event_id) AS what FROM events WHERE user_id <> 1 GROUP BY ALL""")
def latest_items(spark, sf_dir):
    """Of a user's events of one type the last one; one user's run is deleted."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_type", F.col("event_id").alias("item"), F.when(F.col("value") > 50, "kept").otherwise("gone").alias("what"))
    return history.without(assembly.latest(events, ["run_id", "event_type"]), 1)


@query("""WITH k AS (SELECT DISTINCT item_id AS query_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS keyword FROM benchmark), r AS (SELECT query_id, upper(keyword) AS keyword FROM k WHERE keyword LIKE 't%'), m AS (SELECT query_id, keyword FROM k WHERE length(keyword) = 4)
    SELECT query_id, keyword, false AS manual FROM r UNION ALL SELECT query_id, keyword, true FROM m WHERE keyword NOT LIKE 't%'""")
def manual_keywords(spark, sf_dir):
    k = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("keyword"))
    return assembly.missing_manual(k.where("length(keyword) = 4"), k.where("keyword like 't%'").select("query_id", F.upper("keyword").alias("keyword")))


def tables_corpus(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("section"), "doc_id", F.expr("cast(substring(source, 4) as int)").alias("entry_index"), F.col("doc_id").alias("slot_index"), "text", F.lit(None).cast("string").alias("start_date"))


#: Settings under which SQL can say the whole selection: places score, no diversity, no swaps, no stems.
PLAIN = Settings(mmr_balance=1.0, max_coverage_swaps=0, use_stemming=False, use_reranker=False, critical_frequency=1_000_000)
PLACED = RRF.format(w=0.5) + ", placed AS (SELECT f.query_id, f.section, f.doc_id, substr(c.source, 4)::INT AS entry_index, rank, round_even(1.0::DOUBLE / (rank + 1), 3) AS score FROM fused f JOIN c USING (section, doc_id))"
SELECTED = f""", g AS (SELECT query_id, section, entry_index, max(score) AS best, round_even(avg(score), 3) AS entry_score, min(rank) AS first_rank, list(doc_id ORDER BY rank) AS slots FROM placed GROUP BY 1, 2, 3),
    e AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY best DESC, first_rank) - 1 AS position FROM g)
    SELECT query_id, section, entry_index, position::INT AS position, position < 3 AS included, array_to_string(CASE WHEN position < 3 THEN slots[1:4] ELSE slots END, ',') AS shown FROM e"""


def selected(spark, sf_dir, section: str | None = None) -> DataFrame:
    queries = offers(spark, sf_dir).select("query_id", "text")
    chosen = selecting.select(tables_corpus(spark, sf_dir), queries, PLAIN, section=section, tokenise=plain, keywords=offer_keywords(spark, sf_dir), pad=False)
    return chosen.entries.select("query_id", "section", "entry_index", F.col("position").cast("int").alias("position"), "included", F.array_join(F.col("shown").cast("array<string>"), ",").alias("shown"))


@query(f"WITH {BM25} {PLACED} {SELECTED}")
def full_selection(spark, sf_dir):
    return selected(spark, sf_dir)


@query(f"WITH {BM25} {PLACED} {SELECTED} WHERE section = 'en'")
def section_selection(spark, sf_dir):
    return selected(spark, sf_dir, "en")


@query()
def full_selection_diverse(spark, sf_dir):
    """With stems, diversity and swaps: greedy steps that SQL can't say; tests compare them with plain Python."""
    queries = offers(spark, sf_dir).select("query_id", "text")
    chosen = selecting.select(tables_corpus(spark, sf_dir), queries, Settings(use_reranker=False), keywords=offer_keywords(spark, sf_dir))
    return chosen.entries.select("query_id", "section", "entry_index", "position", "included", "swap_step", F.array_join(F.col("shown").cast("array<string>"), ",").alias("shown"))


@query()
def bm25_stemmed(spark, sf_dir):
    return retrieval.bm25_ranked(corpus(spark, sf_dir), offers(spark, sf_dir), CUT, stem=True, spaced="spaced").select("query_id", "section", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@query()
def vocabulary_stems(spark, sf_dir):
    return stem_table(table(spark, sf_dir, "documents").select(F.explode(plain()).alias("term")))


@query(f"""WITH {BM25}, s AS (SELECT query_id, keyword, freq, EXISTS (SELECT 1 FROM documents d WHERE regexp_matches(lower(d.text), '(^|[^a-z0-9])' || keyword || '([^a-z0-9]|$)')) AS in_master FROM kw) SELECT query_id, keyword, freq, in_master FROM s""")
def keyword_preview(spark, sf_dir):
    return selecting.marked(offer_words(spark, sf_dir), table(spark, sf_dir, "documents").select("text"), every=True).withColumnRenamed("held", "in_master")


@query(rf"""WITH t AS (SELECT item_id, text, list_filter(string_split_regex(lower(text), '{APART}'), lambda x: x <> '') AS w FROM benchmark), f AS (SELECT item_id, unnest({[*TERMS]!r}) AS keyword FROM t)
    SELECT f.item_id AS query_id, keyword, greatest(len(list_filter(w, lambda x: x = keyword)), 1)::INT AS freq FROM f JOIN t ON f.item_id = t.item_id""")
def custom_keywords(spark, sf_dir):
    queries = offers(spark, sf_dir).select("query_id", "text").withColumn("held", F.expr("cast(array() as array<string>)"))
    return selecting.keywords_of(queries, (), TERMS).select("query_id", "keyword", "freq")


@query(f"""WITH t AS (SELECT item_id AS query_id, {TOKENS} AS w FROM benchmark), d AS (SELECT doc_id, {TOKENS} AS w FROM documents)
    SELECT query_id, arg_max(doc_id, len(list_intersect(list_distinct(d.w), list_distinct(t.w))) * 1000000 - doc_id)::INT AS index, 'positional_fallback' AS mode FROM t, d GROUP BY 1""")
def summary_pick(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("index"), "text", plain().alias("tokens"))
    return selection.summary_pick(texts, offers(spark, sf_dir).select("query_id", F.col("text").alias("query_text"), "tokens"))


@query("""WITH s AS (SELECT conv_id AS session_id, turn AS cluster_id, CASE WHEN turn % 3 = 0 THEN 'done' WHEN turn % 3 = 1 THEN 'awaiting' ELSE 'pending' END AS status FROM conversations),
    m AS (SELECT session_id, CASE WHEN cluster_id = 2 AND status = 'pending' THEN 'awaiting' ELSE status END AS status FROM s)
    SELECT session_id, count(*) FILTER (status = 'done') + (session_id % 2)::INT AS reviewed, count(*) + 1 - (session_id % 2)::INT AS total, count(*) FILTER (status = 'awaiting') AS awaiting FROM m GROUP BY 1""")
def import_progress(spark, sf_dir):
    states = F.when(F.col("turn") % 3 == 0, "done").when(F.col("turn") % 3 == 1, "awaiting").otherwise("pending")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("cluster_id"), states.alias("status"))
    moved = importer.moved(rows, F.col("cluster_id") == 2, "awaiting")
    orphans = rows.select("session_id").distinct().withColumn("done", F.col("session_id") % 2 == 1)
    both = importer.progress(moved, orphans).join(moved.groupBy("session_id").agg(F.count_if(F.col("status") == "awaiting").alias("awaiting")), "session_id")
    return both.select("session_id", "reviewed", "total", "awaiting")


@query("""WITH s AS (SELECT conv_id AS cluster, list_distinct(string_split_regex(lower(text), '\\s+')) AS w FROM conversations WHERE text IS NOT NULL), e AS (SELECT cluster, unnest(w) AS t FROM s), n AS (SELECT cluster, count(*) AS n FROM s GROUP BY 1)
    SELECT cluster, array_to_string(list(t ORDER BY t), ' ') AS common FROM (SELECT cluster, t FROM e JOIN n USING (cluster) WHERE t <> '' GROUP BY cluster, t, n HAVING count(*) = n) GROUP BY 1""")
def cluster_common_tokens(spark, sf_dir):
    members = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("cluster"), T.words(F.lower("text")).alias("tokens"))
    return importer.common_tokens(members).where(F.size("common") > 0).select("cluster", F.array_join("common", " ").alias("common"))


@query("""SELECT conv_id AS cluster, count(*) AS size, (row_number() OVER (ORDER BY count(*) DESC, conv_id) - 1)::INT AS place FROM conversations GROUP BY 1""")
def clusters_by_size(spark, sf_dir):
    out = importer.by_size(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("cluster"), F.col("turn").alias("id")))
    return out.select("cluster", "size", F.col("place").cast("int").alias("place"))


@query("""SELECT keyword, count, (row_number() OVER (ORDER BY count DESC, total DESC, keyword) - 1)::INT AS place FROM (SELECT 'k' || (props->>'$.k') AS keyword, count(*) AS count, sum(user_id) AS total FROM events GROUP BY 1)""")
def missing_keywords_ordered(spark, sf_dir):
    from .registry import event_runs

    out = history.ordered_missing(history.missing_keywords(event_runs(spark, sf_dir)))
    return out.select("keyword", "count", F.col("place").cast("int").alias("place"))


@query("""SELECT (SELECT count(*) FROM orders) AS total, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10""")
def runs_page_total(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    total, out = history.page_with_total(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25, 10)
    return out.join(retrieval.small(total), F.lit(True)).select("total", "o_orderkey")


@query()
def match_reasons(spark, sf_dir):
    found = placed(spark, sf_dir).where("rank < 3").join(retrieval.small(offers(spark, sf_dir).select("query_id", F.col("text").alias("chunk"))), "query_id")
    return found.select("query_id", "section", "doc_id", selection.match_reason(T.reason_words(F.col("text")), T.reason_words(F.col("chunk"))).alias("reason"))


@query()
def offer_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", title_of(F.col("text")).alias("title"))


@query(r"""WITH m AS (SELECT item_id, text, [' ' || string_split(text, ' ')[2] || ' ', 'the', 'zzz', text[1:3], 'the'] AS manual FROM benchmark),
    h AS (SELECT item_id, list_filter(list_transform(manual, lambda k: trim(k)), lambda k: k <> '' AND regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(lower(k)) || '([^a-z0-9]|$)')) || ['x', 'the'] AS own FROM m),
    o AS (SELECT item_id, k, min(i) AS i FROM (SELECT item_id, unnest(own) AS k, generate_subscripts(own, 1) AS i FROM h) GROUP BY ALL)
    SELECT item_id, array_to_string((list(k ORDER BY i))[1:3], '|') AS kept FROM o GROUP BY 1""")
def manual_first(spark, sf_dir):
    """Typed keywords that the item's own text holds, before two that were found."""
    items = table(spark, sf_dir, "benchmark")
    manual = F.array(F.concat(F.lit(" "), F.coalesce(F.get(F.split("text", " "), F.lit(1)), F.lit("")), F.lit(" ")), F.lit("the"), F.lit("zzz"), F.left("text", F.lit(3)), F.lit("the"))
    kept = assembly.with_manual(manual, F.array(F.lit("x"), F.lit("the")), lambda k: T.stands_in(F.lower("text"), F.lower(k)), 3)
    return items.select("item_id", F.array_join(kept, "|").alias("kept"))
