import math
import random
from collections import Counter

from pyspark.sql import functions as F

from siftline.operators import evaluation, history, importer, merge, report, retrieval, selection


def test_bm25_equals_the_formula(spark):
    random.seed(4)
    docs = [("a" if i % 3 else "b", i, [random.choice("pqrstuv") for _ in range(random.randint(1, 9))]) for i in range(40)]
    asked = ["p", "q", "q", "z"]
    corpus = spark.createDataFrame(docs, "section string, doc_id long, tokens array<string>")
    queries = spark.createDataFrame([(1, asked)], "query_id int, tokens array<string>")
    got = {r.doc_id: r.score for r in retrieval.bm25_scores(corpus, queries).collect()}
    for section in "ab":
        own = [d for d in docs if d[0] == section]
        n, avg = len(own), sum(len(d[2]) for d in own) / len(own)
        df = Counter(t for d in own for t in set(d[2]))
        raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
        floor = 0.25 * sum(raw.values()) / len(raw)
        for _, i, tokens in own:
            want = sum((raw[t] if raw[t] >= 0 else floor) * tokens.count(t) * 2.5 / (tokens.count(t) + 1.5 * (0.25 + 0.75 * len(tokens) / avg)) for t in asked if t in df)
            assert math.isclose(got.get(i, 0.0), want, abs_tol=1e-9)


def test_top_k_prunes_before_the_shuffle(spark):
    scores = spark.range(100).selectExpr("id % 3 as query_id", "string(id % 2) as section", "id as doc_id", "double(id % 7) as score")
    plan = retrieval.ranked(scores, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_rrf_zero_weight_leaves_the_other_channel(spark):
    a = spark.createDataFrame([(1, "s", 10, 0), (1, "s", 11, 1)], "query_id int, section string, doc_id int, rank int")
    b = spark.createDataFrame([(1, "s", 12, 0)], "query_id int, section string, doc_id int, rank int")
    assert [r.doc_id for r in retrieval.rrf([(a, 1.0), (b, 0.0)]).orderBy("rank").collect()] == [10, 11]
    assert {r.doc_id for r in retrieval.rrf([(a, 1.0), (b, 1.0)]).collect()} == {10, 11, 12}


def test_max_sim_takes_the_first_of_equal_chunks(spark):
    docs = spark.createDataFrame([("s", 1, [1.0, 0.0])], "section string, doc_id int, embedding array<float>")
    chunks = spark.createDataFrame([(7, 0, [0.0, 1.0]), (7, 1, [1.0, 0.0]), (7, 2, [1.0, 0.0])], "query_id int, chunk_idx int, embedding array<float>")
    row = retrieval.max_sim(docs, chunks).collect()[0]
    assert (row.score, row.best_chunk, row["rank"]) == (1.0, 1, 0)


def test_mmr_prefers_what_differs():
    sets = [{"a", "b"}, {"a", "b"}, {"c"}]
    assert selection.mmr([1.0, 0.9, 0.8], sets, 2) == [0, 2]
    assert selection.mmr([1.0, 0.9, 0.8], sets, 2, balance=1.0) == [0, 1]
    assert selection.mmr([1.0], sets[:1], 3) == [0]


def test_cover_swaps_the_last_pick_once():
    texts = ["one", "two", "needs docker", "needs kafka"]
    assert selection.cover(texts, [0, 1], {"docker": ["docker"], "kafka": ["kafka"]}) == [0, 2]
    assert selection.cover(texts, [0, 2], {"docker": ["docker"]}) == [0, 2]


def clustered(spark, matrix):
    n = len(matrix)
    sims = spark.createDataFrame([("b", i, j, float(matrix[i][j])) for i in range(n) for j in range(n) if i != j], "block string, a int, b int, sim double")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id int")
    groups = {}
    for r in importer.clusters(nodes, importer.mutual_edges(sims, "block")).collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    return sorted(map(sorted, groups.values()))


def test_mutual_nearest_pairs_and_tie_chain(spark):
    m = [[0.0] * 4 for _ in range(4)]
    for i, j, s in ((0, 1, 0.95), (1, 2, 0.9), (2, 3, 0.85)):
        m[i][j] = m[j][i] = s
    assert clustered(spark, m) == [[0, 1], [2], [3]]
    chain = [[0.0] * 3 for _ in range(3)]
    for i, j in ((0, 1), (1, 2)):
        chain[i][j] = chain[j][i] = 0.9
    assert clustered(spark, chain) == [[0, 1, 2]]


def test_bullets_fold_lines(spark):
    text = "- First thing done\n  and its second half\n2020\n\x88 Another one here\n" + "- " + "w " * 200
    row = spark.createDataFrame([(text,)], "t string").select(importer.bullets(F.col("t")).alias("b")).collect()[0]
    assert row.b == ["First thing done and its second half", "Another one here"]


def test_coverage_and_overflow(spark):
    kw = spark.createDataFrame([(1, "python", 5), (1, "docker", 3), (1, "rust", 1)], "query_id int, keyword string, freq int")
    master = spark.createDataFrame([("python",), ("docker",)], "keyword string")
    target = spark.createDataFrame([(1, "python")], "query_id int, keyword string")
    row = report.summary(report.coverage(kw, master, target)).collect()[0]
    assert (row.score, row.missing_in_target, row.not_in_master, row.critical_missing) == (56, ["docker"], ["rust"], ["docker"])
    parts = spark.createDataFrame([(1, "summary", 0, "a" * 91), (1, "experience", 0, None), (1, "experience", 0, "done")], "doc_id int, section string, entry_index int, text string")
    assert report.page_lines(parts).collect()[0].estimated_lines == 2 + (1 + 2) + (1 + 1 + 1)


def test_missing_keywords_and_variants(spark):
    runs = spark.createDataFrame(
        [(0, "2024-01-02", "A", ["k", "m"], {"k": 3}, ["k"]), (1, "2024-01-01", None, ["k"], {}, [])],
        "pos int, created_at string, offer_title string, not_in_master array<string>, not_in_master_frequencies map<string,int>, critical_missing array<string>",
    )
    got = {r.keyword: r for r in history.missing_keywords(runs).collect()}
    assert (got["k"]["count"], got["k"].first_seen, got["k"].total_frequency, got["k"].ever_critical) == (2, "2024-01-01", 4, True)
    assert got["k"].offer_titles == ["A", history.UNTITLED]
    v = [("a", "v1", "x", "t")]
    used = spark.createDataFrame(
        [("r", 0, "2024", "oferta", v * 2), (None, 1, "2025", "aplicado", v * 2)],
        "run_id string, pos int, created_at string, status string, bullet_variants array<struct<ach_id:string,variant_id:string,angle:string,text:string>>",
    )
    row = history.variant_stats(used).collect()[0]
    assert (row.runs, row.successful_runs, row.last_used) == (3, 1, "2025")


def test_page_is_clamped(spark):
    runs = spark.range(300).withColumnRenamed("id", "run_id")
    assert history.page(runs, [F.col("run_id")], 500, -3).count() == 100
    assert history.page(runs, [F.col("run_id")], 0, 299).count() == 1


def test_emitted_slots_once_and_bounded(spark):
    slots = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (1, 3, "c"), (1, 4, None)], "entry int, place int, text string")
    assert [r.text for r in merge.emitted(slots, ["entry"], 2).orderBy("out_pos").collect()] == ["a", "b"]


def test_recall_and_mrr(spark):
    ranking = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (2, 5, 0)], "query_id int, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, 6), (1, 9), (2, 8)], "query_id int, doc_id int")
    got = {r.query_id: (r.recall, r.mrr) for r in evaluation.recall_mrr(ranking, qrels).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 0.0)}


def test_clusters_of_a_long_chain(spark):
    ids = list(range(60))
    nodes = spark.createDataFrame([(i,) for i in ids] + [(900,)], "id long")
    edges = spark.createDataFrame([(min(x), max(x)) for x in zip(ids, ids[1:])], "a long, b long")
    got = {r.id: r.cluster for r in importer.clusters(nodes, edges).collect()}
    assert got == {i: min(ids) for i in ids} | {900: 900}
