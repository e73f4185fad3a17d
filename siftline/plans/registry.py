"""Queries of the library's own operators over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.functions.title import title_of
from siftline.functions.words import GENERIC_WORDS, STOPWORDS
from siftline.operators import evaluation, history, importer, merge, report, retrieval, selection
from siftline.operators.lineage import cut
from siftline.sources.documents import page_text

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Parameters for the invented texts of the driver's tables.
TERMS = ["the", "and", "that", "der", "que", "les", "worthless"]
EXPAND = {"the": ["of this"], "der": ["die das"], "que": ["cual"]}
CUT = 10


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(text="text"):
    return T.tokens(F.col(text) if isinstance(text, str) else text, stopwords=(), synonyms=None)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("section"), "doc_id", F.col("source").alias("entry_index"), "text", plain().alias("tokens"), T.spaced(F.col("text")).alias("spaced"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", plain().alias("tokens"))


def offer_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of three letters or more of each offer, stop words left out, with their frequency."""
    each = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.split(F.lower("text"), r"(?U)\W+")).alias("keyword"))
    return each.where((F.length("keyword") >= 3) & ~F.col("keyword").isin(*sorted(STOPWORDS))).groupBy("query_id", "keyword").agg(F.count("*").cast("int").alias("freq"))


def offer_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """offer_words, and each offer's first two words as one keyword."""
    runs = F.filter(F.split(F.lower("text"), r"(?U)\W+"), lambda w: w != "")
    pairs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(runs, 1, 2), " ").alias("keyword"), F.lit(1).alias("freq"))
    return offer_words(spark, sf_dir).unionByName(pairs.where("keyword like '% %'"))


TOKENS = r"list_filter(string_split_regex(replace(lower(text), '-', ' '), '\s+'), lambda x: x <> '')"
#: What parts words, and the stop words, in SQL.
APART1 = r"[^\p{L}\p{N}\p{M}_]"
APART = APART1 + "+"
STOPS = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
BM25 = rf"""
    c AS (SELECT lang AS section, doc_id, source, text, {TOKENS} AS tokens FROM documents),
    q AS (SELECT item_id AS query_id, text, {TOKENS} AS tokens FROM benchmark),
    stats AS (SELECT section, count(*) AS n, avg(len(tokens)) AS avgdl FROM c GROUP BY 1),
    dfs AS (SELECT section, term, count(*) AS df FROM (SELECT section, unnest(list_distinct(tokens)) AS term FROM c) GROUP BY 1, 2),
    raws AS (SELECT section, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs JOIN stats USING (section)),
    floors AS (SELECT section, avg(r) * 0.25 AS floor FROM raws GROUP BY 1),
    idfs AS (SELECT section, term, df, CASE WHEN r < 0 THEN floor ELSE r END AS idf FROM raws JOIN floors USING (section)),
    asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(tokens) AS term FROM q) GROUP BY 1, 2),
    tfs AS (SELECT section, doc_id, dl, term, count(*) AS tf FROM (SELECT section, doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM c) GROUP BY ALL),
    bm25 AS (SELECT query_id, section, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
             FROM tfs JOIN idfs USING (section, term) JOIN stats USING (section) JOIN asked USING (term) GROUP BY 1, 2, 3),
    sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM bm25 QUALIFY rank < 50),
    kw AS (SELECT query_id, keyword, count(*)::INT AS freq FROM (SELECT item_id AS query_id, unnest(string_split_regex(lower(text), '{APART}')) AS keyword FROM benchmark) WHERE length(keyword) >= 3 AND keyword NOT IN ({STOPS}) GROUP BY 1, 2),
    pairs AS (SELECT query_id, w[1] AS w1, w[2] AS w2 FROM (SELECT item_id AS query_id, list_filter(string_split_regex(lower(text), '{APART}'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 2),
    pieces AS (SELECT DISTINCT lang AS section, doc_id, unnest(string_split_regex(lower(text), '{APART}')) AS keyword FROM documents),
    plain AS (SELECT doc_id, lang AS section, translate(lower(text), '-/+', '   ') AS t FROM documents),
    kscore AS (SELECT query_id, section, doc_id, sum(freq)::DOUBLE AS score FROM (
        SELECT query_id, section, doc_id, freq FROM pieces JOIN kw USING (keyword)
        UNION ALL SELECT query_id, p.section, p.doc_id, 1 FROM pairs JOIN pieces a ON a.keyword = w1 JOIN pieces b ON b.doc_id = a.doc_id AND b.keyword = w2 JOIN plain p ON p.doc_id = a.doc_id
            WHERE regexp_matches(t, '(^|{APART1})' || w1 || '\s+' || w2 || '({APART1}|$)')) GROUP BY 1, 2, 3),
    kws AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, doc_id) - 1 AS rank FROM kscore QUALIFY rank < 50)
"""


def sparse_channel(spark: SparkSession, sf_dir: str, top_k: int = 50) -> DataFrame:
    return retrieval.bm25_ranked(corpus(spark, sf_dir), offers(spark, sf_dir), top_k, spaced="spaced")


def keywords_ranked(spark: SparkSession, sf_dir: str, top_k: int = 50) -> DataFrame:
    return retrieval.keywords_ranked(corpus(spark, sf_dir), offer_keywords(spark, sf_dir), top_k)


@query(f"WITH {BM25} SELECT query_id, section, doc_id, rank::INT AS rank, round(score, 6) AS score FROM sparse WHERE rank < {CUT}")
def bm25_topk_per_section(spark, sf_dir):
    out = sparse_channel(spark, sf_dir, CUT)
    return out.select("query_id", "section", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT section, term, df, round(idf, 6) AS idf FROM idfs")
def bm25_idf_floor(spark, sf_dir):
    return retrieval.bm25_terms(corpus(spark, sf_dir))[0].select("section", "term", "df", F.round("idf", 6).alias("idf"))


@query(rf"""SELECT doc_id, len({TOKENS})::INT AS n_all,
    len(list_filter({TOKENS}, lambda x: NOT list_contains([{STOPS}], x)))::INT AS n_kept FROM documents""")
def token_stopword_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(plain()).alias("n_all"), F.size(T.tokens(F.col("text"), synonyms=None)).alias("n_kept"))


@query(rf"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents),
    e AS (SELECT doc_id, flatten(list_transform(w, lambda x: CASE x WHEN 'the' THEN ['the', 'of', 'this'] WHEN 'der' THEN ['der', 'die', 'das'] WHEN 'que' THEN ['que', 'cual'] ELSE [x] END)) AS w FROM t)
    SELECT doc_id, len(w)::INT AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM e""")
def synonym_expand(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text"), stopwords=(), synonyms=EXPAND).alias("w"))
    return found.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(lower(text), '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS has_{t}" for t in TERMS) + " FROM documents")
def term_contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[T.contains_term(F.col("text"), t).alias(f"has_{t}") for t in TERMS])


@query(r"WITH t AS (SELECT doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}_]+') AS w FROM documents) SELECT doc_id, " + ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::INT AS n_{t}" for t in TERMS) + " FROM t")
def term_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[T.count_term(F.col("text"), t).cast("int").alias(f"n_{t}") for t in TERMS])


@query(r"""WITH t AS (SELECT item_id AS query_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}_]+')) AS keyword FROM benchmark)
    SELECT query_id, keyword, count(*)::INT AS freq, (row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, keyword) - 1)::INT AS pos FROM t WHERE keyword IN (""" + ", ".join(f"'{t}'" for t in TERMS) + ") GROUP BY 1, 2")
def keyword_frequencies(spark, sf_dir):
    return retrieval.ranked_keywords(retrieval.term_frequencies(offers(spark, sf_dir), TERMS)).select("query_id", "keyword", "freq", F.col("pos").cast("int").alias("pos"))


@query(f"WITH {BM25} SELECT query_id, section, doc_id, rank::INT AS rank, score FROM kws")
def keyword_channel(spark, sf_dir):
    return keywords_ranked(spark, sf_dir).select("query_id", "section", "doc_id", F.col("rank").cast("int").alias("rank"), "score")


@query()
def open_keywords(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    terms = items.select("query_id", F.explode(T.open_candidates(F.col("text"))).alias("term"))
    held = retrieval.held_terms(terms, table(spark, sf_dir, "documents"))
    return items.join(held, "query_id").select(F.col("query_id").alias("item_id"), F.explode(T.open_terms(F.col("text"), F.col("held"), TERMS)).alias("keyword"))


SIMS = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


@query(f"""WITH s AS (SELECT q.label AS query_id, d.label AS section, d.vec_id AS doc_id, q.vec_id AS chunk_idx, round({SIMS.format(a="d.embedding", b="q.embedding")}, 9) AS sim
        FROM embeddings d, embeddings q WHERE q.vec_id % 20 = 0),
    b AS (SELECT query_id, section, doc_id, max(sim) AS score, min(chunk_idx) FILTER (sim = top) AS best_chunk FROM (SELECT *, max(sim) OVER (PARTITION BY query_id, section, doc_id) AS top FROM s) GROUP BY 1, 2, 3)
    SELECT query_id, section, doc_id, round(score, 6) AS score, best_chunk FROM b QUALIFY row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, doc_id) <= 10""")
def maxsim_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    docs = vectors.select(F.col("label").alias("section"), F.col("vec_id").alias("doc_id"), "embedding")
    chunks = vectors.where("vec_id % 20 = 0").select(F.col("label").alias("query_id"), F.col("vec_id").alias("chunk_idx"), "embedding")
    return retrieval.max_sim(docs, chunks, 10).select("query_id", "section", "doc_id", F.round("score", 6).alias("score"), "best_chunk")


def fused(spark, sf_dir, keyword_weight: float = 0.5) -> DataFrame:
    """Written down, as it is small beside the documents that it is joined with."""
    channels = [(sparse_channel(spark, sf_dir), 1.0), *([(keywords_ranked(spark, sf_dir), keyword_weight)] if keyword_weight > 0 else [])]
    return cut(retrieval.rrf(channels))


RRF = """, parts AS (SELECT 0 AS c, 1.0::DOUBLE AS w, query_id, section, doc_id, rank FROM sparse UNION ALL SELECT 1, {w}::DOUBLE, query_id, section, doc_id, rank FROM kws WHERE {w} > 0),
    sums AS (SELECT query_id, section, doc_id, sum(w / (15 + rank + 1)) AS score, min(c * 1000 + rank) AS first FROM parts GROUP BY 1, 2, 3),
    fused AS (SELECT query_id, section, doc_id, score, row_number() OVER (PARTITION BY query_id, section ORDER BY round(score, 12) DESC, first, doc_id) - 1 AS rank FROM sums)"""


@query(f"WITH {BM25} {RRF.format(w=0.5)} SELECT query_id, section, doc_id, rank::INT AS rank, round(score, 6) AS score FROM fused")
def rrf_channels(spark, sf_dir):
    return fused(spark, sf_dir).select("query_id", "section", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {BM25} {RRF.format(w=0.0)} SELECT query_id, section, doc_id, rank::INT AS rank, round(score, 6) AS score FROM fused")
def rrf_zero_weight(spark, sf_dir):
    return fused(spark, sf_dir, 0.0).select("query_id", "section", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {BM25} {RRF.format(w=0.5)} SELECT query_id, section, doc_id, round_even(1.0::DOUBLE / (rank + 1), 3) AS score FROM fused")
def positional_score(spark, sf_dir):
    return retrieval.positional(fused(spark, sf_dir)).select("query_id", "section", "doc_id", "score")


@query(f"WITH {BM25} {RRF.format(w=0.5)} SELECT f.query_id, f.section, f.doc_id, round_even(1 / (1 + exp(-(length(c.text) - length(q.text)) / 1000.0::DOUBLE)), 3) AS score FROM fused f JOIN c USING (section, doc_id) JOIN q USING (query_id) WHERE rank < 30")
def sigmoid_rerank(spark, sf_dir):
    pairs = corpus(spark, sf_dir).select("doc_id", "text").join(retrieval.small(fused(spark, sf_dir).where("rank < 30")), "doc_id").join(retrieval.small(offers(spark, sf_dir).select("query_id", F.col("text").alias("query_text"))), "query_id")
    return retrieval.rerank(pairs, lambda q, t: (t.str.len() - q.str.len()) / 1000.0).select("query_id", "section", "doc_id", "score")


#: What marks a sentence as excluding, in the invented texts.
MARKERS = ("worthless", "idiot")
SENTENCES = r"list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
MARKED = "regexp_matches(s, '(?i)" + "|".join(MARKERS) + "')"


@query(rf"""WITH d AS (SELECT doc_id, {SENTENCES} AS s FROM documents)
    SELECT doc_id, len(s)::INT AS n_sentences, len(list_filter(s, lambda s: {MARKED}))::INT AS n_negated, md5(array_to_string(s, '|')) AS digest FROM d""")
def negation_sentences(spark, sf_dir):
    said = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return said.select("doc_id", F.size("s").alias("n_sentences"), F.size(F.filter("s", lambda x: T.negated(x, MARKERS))).alias("n_negated"), F.md5(F.array_join("s", "|")).alias("digest"))


GENERIC = ", ".join(f"'{w}'" for w in sorted(STOPWORDS | GENERIC_WORDS))


@query(rf"""WITH said AS (SELECT doc_id, replace(CASE WHEN doc_id % 2 = 0 THEN replace(text, ' to ', ' k8s ') ELSE text END, ' the ', ' kubernetes ') AS text FROM documents), d AS (SELECT doc_id, {SENTENCES} AS s FROM said),
    f AS (SELECT doc_id, array_to_string(list_filter(s, lambda s: {MARKED}), ' ') AS fragment, lower(array_to_string(list_filter(s, lambda s: NOT {MARKED}), ' ')) AS positive FROM d),
    w AS (SELECT doc_id, positive, list_filter(list_transform(regexp_extract_all(fragment, '([a-zA-ZáéíóúñüÁÉÍÓÚÑÜ][\p{{L}}\p{{N}}\p{{M}}_+#.\-]*)', 1), lambda x: lower(x)), lambda x: length(x) >= 3 AND x NOT IN ({GENERIC})) AS one FROM f WHERE fragment <> ''),
    c AS (SELECT DISTINCT doc_id, positive, unnest(list_concat(one, list_transform(range(1, greatest(len(one), 1)), lambda i: one[i] || ' ' || one[i + 1]))) AS term FROM w),
    v AS (SELECT term, unnest(CASE WHEN term IN ('kubernetes', 'k8s') THEN ['kubernetes', 'k8s'] ELSE [term] END) AS variant FROM (SELECT DISTINCT term FROM c)),
    h AS (SELECT DISTINCT term FROM v JOIN benchmark ON regexp_matches(replace(lower(text), ' the ', ' k8s '), '(^|[^a-z0-9])' || regexp_escape(variant) || '([^a-z0-9]|$)'))
    SELECT doc_id, term FROM c JOIN h USING (term) JOIN v USING (term) GROUP BY doc_id, term, positive
    HAVING NOT bool_or(regexp_matches(positive, '(^|[^a-z0-9])' || regexp_escape(variant) || '([^a-z0-9]|$)'))""")
def negated_terms(spark, sf_dir):
    """Of two names of a thing, documents have one and benchmark items the other; documents whose other sentences have the second one again exclude nothing."""
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" to "), F.lit(" k8s "))).otherwise(F.col("text"))
    said = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.replace(text, F.lit(" the "), F.lit(" kubernetes ")).alias("text"))
    terms = said.select("query_id", F.explode(T.negated_candidates(F.col("text"), MARKERS)).alias("term"))
    held = retrieval.held_terms(terms, table(spark, sf_dir, "benchmark").select(F.replace(F.lower("text"), F.lit(" the "), F.lit(" k8s ")).alias("text")))
    found = said.join(held, "query_id").select("query_id", F.explode(T.negated_terms(F.col("text"), F.col("held"), (), MARKERS)).alias("term"))
    return found.select(F.col("query_id").alias("doc_id"), "term")


@query("""WITH s AS (SELECT doc_id, round_even(n_chars / 100000.0::DOUBLE, 3) AS score, regexp_matches(lower(text), '(^|[^a-z0-9])(worthless|k8s|to)([^a-z0-9]|$)') AS neg FROM documents)
    SELECT doc_id, CASE WHEN neg THEN round_even(score * 0.3::DOUBLE, 3) ELSE score END AS score FROM s""")
def negation_penalty(spark, sf_dir):
    """As the selection does it: a query excludes a term, and texts with any name of it lose."""
    scored = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"(?i)(?<![a-z0-9])to(?![a-z0-9])", "k8s").alias("text"), F.bround(F.col("n_chars") / 100000.0, 3).alias("score"))
    return retrieval.penalise(scored, T.excludes(F.array(F.lit("worthless"), F.lit("kubernetes")), F.col("text"))).select("doc_id", "score")


@query()
def requirements_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.requirements(F.col("text"))).alias("digest"))


@query(r"""WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, text, w, list_filter(range(0, greatest(len(w), 1), 150), lambda i: i = 0 OR i - 150 + 200 < len(w)) AS starts FROM t)
    SELECT doc_id, CASE WHEN len(w) <= 200 THEN 1 ELSE len(starts) END::INT AS n_chunks,
           md5(CASE WHEN len(w) <= 200 THEN text ELSE array_to_string(list_transform(starts, lambda i: array_to_string(w[i + 1:i + 200], ' ')), '|') END) AS digest FROM s""")
def chunk_windows(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", T.chunks(F.col("text")).alias("c"))
    return made.select("doc_id", F.size("c").alias("n_chunks"), F.md5(F.array_join("c", "|")).alias("digest"))


@query(rf"""WITH t AS (SELECT item_id, list_distinct({TOKENS}) AS w FROM benchmark)
    SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS similarity
    FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) > 0""")
def jaccard_pairs(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(plain()).alias("w"))
    terms = items.select("item_id", F.explode("w").alias("term"))
    shared = terms.alias("x").join(terms.alias("y"), "term").where("x.item_id < y.item_id").groupBy(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b")).agg(F.count("*").alias("n"))
    size = items.select("item_id", F.size("w").alias("size"))
    both = shared.join(size.withColumnsRenamed({"item_id": "a", "size": "sa"}), "a").join(size.withColumnsRenamed({"item_id": "b", "size": "sb"}), "b")
    return both.select("a", "b", F.round(F.col("n") / (F.col("sa") + F.col("sb") - F.col("n")), 6).alias("similarity"))


def placed(spark, sf_dir) -> DataFrame:
    """The fused ranking with its positional scores, entries being sources and slots documents."""
    scored = retrieval.positional(fused(spark, sf_dir))
    documents = corpus(spark, sf_dir).select("doc_id", "entry_index", "text").join(retrieval.small(scored), "doc_id")
    return documents.withColumns({"tokens": plain(), "slot_index": F.col("doc_id")})


@query()
def mmr_select(spark, sf_dir):
    return selection.select_slots(placed(spark, sf_dir), 2)


def terms_column(*terms: str):
    return F.array(*[F.struct(F.lit(t).alias("keyword"), F.array(F.lit(t)).alias("variants")) for t in terms])


@query()
def local_coverage_swap(spark, sf_dir):
    return selection.select_slots(placed(spark, sf_dir).withColumn("critical", terms_column("worthless", "the")), 1, critical="critical")


@query()
def global_coverage_swap(spark, sf_dir):
    found = placed(spark, sf_dir)
    keys = ["query_id", "section", "entry_index"]
    entries = selection.group_entries(found, 2).withColumnRenamed("slots", "shown")
    slots = found.groupBy(*keys).agg(F.collect_list(F.struct("slot_index", "score", "text", "tokens", F.lit(True).alias("ranked"))).alias("slots"))
    entries = entries.withColumn("shown", F.when(F.col("included"), F.slice("shown", 1, 4)).otherwise(F.col("shown"))).join(slots, keys)
    entries = entries.withColumns({"critical": terms_column("worthless", "that"), "negated": F.expr("cast(array() as array<string>)")})
    return selection.swap_coverage(entries, 4).withColumn("shown", F.array_join(F.col("shown").cast("array<string>"), ","))


PLACED = RRF.format(w=0.5) + ", placed AS (SELECT f.query_id, f.section, f.doc_id, c.source AS entry_index, rank, round_even(1.0::DOUBLE / (rank + 1), 3) AS score FROM fused f JOIN c USING (section, doc_id))"


@query(f"""WITH {BM25} {PLACED}, g AS (SELECT query_id, section, entry_index, max(score) AS best, round_even(avg(score), 3) AS entry_score, min(rank) AS first_rank, list(doc_id ORDER BY rank)[1:4] AS slots FROM placed GROUP BY 1, 2, 3),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY best DESC, first_rank) - 1 AS position FROM g)
    SELECT query_id, section, entry_index, best, array_to_string(slots, ',') AS slots, position::INT AS position, position < 2 AS included FROM p""")
def group_entries(spark, sf_dir):
    out = selection.group_entries(placed(spark, sf_dir), 2, 4)
    return out.select("query_id", "section", "entry_index", "best", F.array_join(F.col("slots").cast("array<string>"), ",").alias("slots"), F.col("position").cast("int").alias("position"), "included")


@query(f"WITH {BM25} {PLACED} SELECT query_id, section, entry_index, max(score) AS heat FROM placed GROUP BY 1, 2, 3")
def section_heat(spark, sf_dir):
    return selection.section_heat(placed(spark, sf_dir))


@query(f"""WITH {BM25} {PLACED}, g AS (SELECT query_id, section, entry_index, min(rank) AS first_rank FROM placed GROUP BY 1, 2, 3),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY first_rank) - 1 AS position FROM g) SELECT query_id, section, entry_index, position::INT AS position, position < 6 AS included FROM p""")
def distinct_entries_by_rank(spark, sf_dir):
    return selection.distinct_entries(placed(spark, sf_dir), 6).select("query_id", "section", "entry_index", F.col("position").cast("int").alias("position"), "included")


@query("""WITH p AS (SELECT o_custkey, o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders)
    SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY m DESC, position) - 1)::INT AS shown FROM p""")
def chronological_reorder(spark, sf_dir):
    price = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    runs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("start_date"), (F.row_number().over(price) - 1).alias("position"))
    return selection.chronological(runs, "start_date", ["o_custkey"]).select("o_custkey", "o_orderkey", F.col("shown").cast("int").alias("shown"))


@query("""SELECT conv_id, turn, text FROM conversations WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 5 DESC, role DESC, turn) = 1""")
def representative_variant(spark, sf_dir):
    v = F.struct("turn", F.col("turn").cast("string").alias("id"), "text", F.lit(None).cast("string").alias("status"), (F.length("text") % 5).alias("used_count"), F.col("role").alias("created_at"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(v)).alias("variants"))
    return grouped.select("conv_id", merge.representative(F.col("variants")).alias("v")).where("v is not null").select("conv_id", "v.turn", "v.text")


@query("""WITH s AS (SELECT conv_id, turn AS pos, CASE WHEN role = 'assistant' THEN 0 ELSE 1 END AS kind, CASE WHEN role = 'assistant' THEN text ELSE trim(text) END AS text FROM conversations)
    SELECT conv_id, kind, pos, (row_number() OVER (PARTITION BY conv_id ORDER BY kind, pos) - 1)::INT AS slot_index FROM s WHERE kind = 0 OR text <> ''""")
def slot_union(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("turn", "pos")
    out = merge.slot_union(turns.where("role = 'assistant'"), turns.where("role <> 'assistant'"), ["conv_id"])
    return out.select("conv_id", "kind", "pos", F.col("slot_index").cast("int").alias("slot_index"))


@query("""WITH f AS (SELECT source, text, min(doc_id) AS place FROM documents GROUP BY 1, 2)
    SELECT source, place, md5(text) AS digest, (row_number() OVER (PARTITION BY source ORDER BY place) - 1)::INT AS out_pos FROM f QUALIFY out_pos < 20""")
def merge_dedupe_budget(spark, sf_dir):
    out = merge.emitted(table(spark, sf_dir, "documents").withColumn("place", F.col("doc_id")), ["source"], 20)
    return out.select("source", "place", F.md5("text").alias("digest"), F.col("out_pos").cast("int").alias("out_pos"))


@query(f"""WITH {BM25}, v AS (SELECT keyword FROM pieces GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3), said AS (SELECT query_id, list(keyword) AS own FROM kw GROUP BY 1),
    k AS (SELECT query_id - 1 AS query_id, keyword FROM kw WHERE keyword IN (SELECT keyword FROM v))
    SELECT k.query_id, array_to_string(list(keyword ORDER BY keyword)[1:10], ',') AS keywords FROM k JOIN said USING (query_id) WHERE list_contains(own, keyword) GROUP BY 1""")
def verified_keywords(spark, sf_dir):
    """Candidates are the next offer's words; both the documents and the offer itself must hold them."""
    asked = offer_words(spark, sf_dir)
    common = corpus(spark, sf_dir).select("doc_id", F.explode(retrieval.word_runs(F.lower("text"))).alias("keyword")).groupBy("keyword").count().where("count >= 3").select("keyword", F.lit(True).alias("known"))
    own = asked.select("query_id", "keyword", F.lit(True).alias("said"))
    candidates = asked.select((F.col("query_id") - 1).alias("query_id"), "keyword", F.col("keyword").alias("pos"))
    both = candidates.join(common, "keyword", "left").join(own, ["query_id", "keyword"], "left")
    return report.verified_keywords(both, F.coalesce("known", F.lit(False)), F.coalesce("said", F.lit(False))).select("query_id", F.array_join("keywords", ",").alias("keywords"))


COVERED = """, master AS (SELECT DISTINCT keyword FROM pieces), shown AS (SELECT DISTINCT b.item_id AS query_id, p.keyword FROM benchmark b JOIN documents d ON d.source = 'src' || (b.item_id % 20) JOIN pieces p USING (doc_id)),
    marked AS (SELECT k.query_id, k.keyword, freq, m.keyword IS NOT NULL AS in_master, s.keyword IS NOT NULL AS in_target, freq >= 2 AS critical FROM kw k LEFT JOIN master m USING (keyword) LEFT JOIN shown s ON s.query_id = k.query_id AND s.keyword = k.keyword)"""


def marked(spark, sf_dir) -> DataFrame:
    asked = offer_words(spark, sf_dir)
    words = corpus(spark, sf_dir).select("entry_index", F.explode(retrieval.word_runs(F.lower("text"))).alias("keyword"))
    # only asked keywords go through the shuffle, which master and target share
    held = words.join(retrieval.small(asked.select("keyword").distinct()), "keyword").groupBy("entry_index", "keyword").agg(F.count("*").alias("n"))
    shown = held.join(asked.select("query_id", F.concat(F.lit("src"), F.col("query_id") % 20).alias("entry_index")).distinct(), "entry_index").select("query_id", "keyword")
    return report.coverage(asked, held.select("keyword"), shown)


@query(f"WITH {BM25} {COVERED} SELECT query_id, keyword, freq, in_master, in_target, critical FROM marked")
def coverage_marks(spark, sf_dir):
    return marked(spark, sf_dir).select("query_id", "keyword", "freq", "in_master", "in_target", "critical")


@query(f"""WITH {BM25} {COVERED} SELECT query_id, round_even(sum(CASE WHEN in_target THEN freq ELSE 0 END) / sum(freq)::DOUBLE * 100, 0)::INT AS score,
    coalesce(array_to_string(list(keyword ORDER BY freq DESC, keyword) FILTER (in_master AND NOT in_target), ','), '') AS missing_in_target, coalesce(array_to_string(list(keyword ORDER BY freq DESC, keyword) FILTER (NOT in_master), ','), '') AS not_in_master,
    coalesce(array_to_string(list(keyword ORDER BY freq DESC, keyword) FILTER (critical AND in_master AND NOT in_target), ','), '') AS critical_missing FROM marked GROUP BY 1""")
def coverage_report(spark, sf_dir):
    out = report.summary(marked(spark, sf_dir))
    return out.select("query_id", "score", *[F.array_join(c, ",").alias(c) for c in ("missing_in_target", "not_in_master", "critical_missing")])


@query("""WITH l AS (SELECT conv_id, CASE WHEN role = 'user' THEN 'experience' ELSE 'summary' END AS section, CASE WHEN trim(text) = '' THEN 0 ELSE greatest(1, ceil(length(text) / 90.0)) END AS n FROM conversations),
    s AS (SELECT conv_id, section, sum(n) + 1 AS n FROM l GROUP BY 1, 2), d AS (SELECT conv_id, (sum(n) + 2)::BIGINT AS estimated_lines FROM s GROUP BY 1)
    SELECT conv_id, estimated_lines, estimated_lines > 45 AS overflow, greatest(estimated_lines - 45, 0)::BIGINT AS overflow_lines FROM d""")
def page_overflow(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "user", "experience").otherwise("summary").alias("section"), F.col("turn").alias("entry_index"), F.coalesce("text", F.lit("")).alias("text"))
    out = report.overflow(report.page_lines(parts))
    return out.select(F.col("doc_id").alias("conv_id"), "estimated_lines", "overflow", F.col("overflow_lines").cast("long").alias("overflow_lines"))


def event_runs(spark, sf_dir) -> DataFrame:
    k = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.col("event_type").alias("offer_title"), F.array(k).alias("not_in_master"), F.create_map(k, F.col("user_id")).alias("not_in_master_frequencies"),
        F.when(F.col("value") > 50, F.array(k)).otherwise(F.expr("cast(array() as array<string>)")).alias("critical_missing"),
    )


@query("""SELECT 'k' || (props->>'$.k') AS keyword, count(*) AS count, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS first_seen, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS last_seen, md5(string_agg(event_type, ',' ORDER BY event_id)) AS titles,
    sum(user_id)::BIGINT AS total_frequency, bool_or(value > 50) AS ever_critical FROM events GROUP BY 1""")
def missing_keyword_stats(spark, sf_dir):
    out = history.missing_keywords(event_runs(spark, sf_dir))
    return out.select("keyword", "count", "first_seen", "last_seen", F.md5(F.array_join("offer_titles", ",")).alias("titles"), "total_frequency", "ever_critical")


@query("""WITH e AS (SELECT user_id AS run, event_id AS pos, event_type AS ach_id, 'v' || (props->>'$.k') AS variant_id, value > 50 AS success, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen FROM events),
    o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY run, ach_id, variant_id ORDER BY pos) = 1)
    SELECT ach_id, variant_id, count(*) AS runs, count(*) FILTER (success) AS successful_runs, max(seen) AS last_used, arg_min('t' || pos, pos) AS text FROM o GROUP BY 1, 2""")
def variant_stats(spark, sf_dir):
    k = F.concat(F.lit("v"), F.get_json_object("props", "$.k"))
    v = F.array(F.struct(F.col("event_type").alias("ach_id"), k.alias("variant_id"), F.lit("").alias("angle"), F.concat(F.lit("t"), F.col("event_id")).alias("text")))
    runs = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("pos"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.when(F.col("value") > 50, "oferta").otherwise("aplicado").alias("status"), v.alias("bullet_variants"))
    return history.variant_stats(runs).select("ach_id", "variant_id", "runs", "successful_runs", "last_used", "text")


@query("SELECT event_type AS status, count(*) AS n FROM events WHERE contains(lower(event_type || ' ' || props), 'c') GROUP BY 1")
def runs_facets(spark, sf_dir):
    return history.facets(history.matching(table(spark, sf_dir, "events"), " C ", ("event_type", "props")), F.col("event_type"))


@query("SELECT event_id, event_type, value FROM events WHERE contains(lower(event_type || ' ' || props), 'c') AND value::INT BETWEEN 0 AND 1000000 AND trunc(value)::INT >= 20 AND trunc(value)::INT <= 80")
def runs_filtered(spark, sf_dir):
    found = history.matching(table(spark, sf_dir, "events"), "c", ("event_type", "props"))
    return history.filtered(found, F.col("value"), F.col("event_type"), 20, 80).select("event_id", "event_type", "value")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 50")
def runs_page(spark, sf_dir):
    return history.page(table(spark, sf_dir, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 500, 50).select("o_orderkey", "o_totalprice")


@query("""WITH u AS (SELECT user_id AS variant_id, sum(greatest((props->>'$.k')::INT - 2, 0)) AS times FROM events WHERE value <= 50 OR value IS NULL GROUP BY 1)
    SELECT p_partkey, (p_size + coalesce(times, 0))::BIGINT AS used_count FROM part LEFT JOIN u ON p_partkey = variant_id""")
def variant_usage_apply(spark, sf_dir):
    times = F.get_json_object("props", "$.k").cast("int") - 2
    runs = table(spark, sf_dir, "events").select(F.create_map("user_id", times).alias("variant_usage"), (F.col("value") > 50).alias("variant_usage_applied"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("used_count"))
    return history.apply_usage(parts, history.pending_usage(runs), "p_partkey").select("p_partkey", "used_count")


@query("""WITH s AS (SELECT user_id, coalesce(list(DISTINCT props->>'$.k') FILTER (value > 50), []) AS a, coalesce(list(DISTINCT props->>'$.k') FILTER (value <= 50), []) AS b FROM events GROUP BY 1)
    SELECT user_id, array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), ',') AS common, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a,
    array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS only_b FROM s""")
def compare_runs(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    sides = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, k)).alias("a"), F.collect_set(F.when(F.col("value") <= 50, k)).alias("b"))
    out = sides.select("user_id", *history.compare(F.col("a"), F.col("b")))
    return out.select("user_id", *[F.array_join(c, ",").alias(c) for c in ("common", "only_a", "only_b")])


@query()
def import_lines_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(importer.bullets(F.col("text"))).alias("pos", "bullet"))


EDGES = f"""sims AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, round({SIMS.format(a="a.embedding", b="b.embedding")}, 9) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
    tops AS (SELECT a, greatest(max(sim), 0) AS top FROM sims GROUP BY 1),
    edges AS (SELECT s.label, s.a, s.b, s.sim FROM sims s JOIN tops x ON x.a = s.a JOIN tops y ON y.a = s.b WHERE s.a < s.b AND s.sim >= x.top - 1e-9 AND s.sim >= y.top - 1e-9 AND s.sim >= 0.3)"""


def nearest_edges(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), "embedding")
    return importer.nearest_edges(vectors, "label", 0.3)


@query(f"WITH {EDGES} SELECT label, a, b, round(sim, 6) AS sim FROM edges")
def mutual_nearest_edges(spark, sf_dir):
    return nearest_edges(spark, sf_dir).select("label", "a", "b", F.round("sim", 6).alias("sim"))


@query(f"""WITH RECURSIVE {EDGES}, both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.id)
    SELECT id, min(root) AS cluster FROM reach GROUP BY 1""")
def clusters(spark, sf_dir):
    return importer.clusters(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), nearest_edges(spark, sf_dir))


@query("""SELECT conv_id AS cluster, arg_min(role, -length(text) * 1000 + turn) AS action, arg_min(substr(text, 1, 5), CASE WHEN role = 'user' THEN -length(text) * 1000 + turn END) AS scope,
        array_to_string(list_sort(list_distinct(list(role) || list(substr(coalesce(text, ''), 1, 1)))), '|') AS tools, count(DISTINCT coalesce(role, '') || chr(0) || (turn % 2))::INT AS n_outcomes FROM conversations GROUP BY 1""")
def facts_consolidate(spark, sf_dir):
    outcomes = F.array(F.struct(F.coalesce("role", F.lit("")).alias("metric"), (F.col("turn") % 2).cast("string").alias("value")))
    scope = F.when(F.col("role") == "user", F.substring("text", 1, 5)).otherwise("")
    facts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("cluster"), F.col("turn").alias("pos"), "text", F.col("role").alias("action"), scope.alias("scope"), F.array_compact(F.array("role", F.substring(F.coalesce("text", F.lit("")), 1, 1))).alias("tools"), outcomes.alias("outcomes"))
    return importer.consolidated(facts).select("cluster", "action", F.nullif("scope", F.lit("")).alias("scope"), F.array_join(F.array_sort("tools"), "|").alias("tools"), F.size("outcomes").alias("n_outcomes"))


@query(f"""WITH {BM25}, qrels AS (SELECT query_id, doc_id FROM kws WHERE rank < 3), n AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY 1),
    hits AS (SELECT query_id, count(DISTINCT doc_id) AS f, min(rank) AS r FROM sparse JOIN qrels USING (query_id, doc_id) WHERE rank < 10 GROUP BY 1)
    SELECT query_id, round(coalesce(f, 0) / n::DOUBLE, 6) AS recall, round(coalesce(1.0 / (r + 1), 0)::DOUBLE, 6) AS mrr FROM n LEFT JOIN hits USING (query_id)""")
def eval_recall_mrr(spark, sf_dir):
    out = evaluation.recall_mrr(sparse_channel(spark, sf_dir), keywords_ranked(spark, sf_dir, 3).select("query_id", "doc_id"))
    return out.select("query_id", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query("SELECT doc_id, substr(sha1(text), 1, 8) AS run_hash, sha256(text) AS content FROM documents")
def fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", history.run_hash(F.col("text")).alias("run_hash"), F.sha2("text", 256).alias("content"))


@query()
def offer_title(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", title_of(F.col("text")).alias("title"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>|<style\b.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html")).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'middle' ELSE 'low' END AS band FROM orders")
def score_bands(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", report.score_band(F.col("o_totalprice"), 200000, 100000).alias("band"))
