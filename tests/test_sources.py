import json

from pyspark.sql import functions as F

from siftline.plans.config import Settings, load, save
from siftline.sources import documents, store


def test_documents_to_slots(spark):
    doc = {"cv": {"sections": {"summary": ["Text"], "experience": [{"company": "Acme", "start_date": "2020-01", "achievements": [{"id": "a", "variants": [{"id": "v", "text": "Did", "angle": "x"}]}, {"id": "b", "variants": []}], "highlights": [" One ", "", None]}], "skills": [{"label": "Tools", "details": ["a", "b"]}, 7]}}}
    df = spark.createDataFrame([("p", json.dumps(doc)), ("q", "[broken"), ("r", "")], "path string, text string")
    rows = documents.slot_ids(documents.read_slots(df)).collect()
    assert [(r.doc_id, r.kind, r.text) for r in rows] == [("summary_0_bullet_0", "text", "Text"), ("experience_0_bullet_0", "achievement", None), ("experience_0_bullet_1", "highlight", "One"), ("skills_0_0", "skill", "Tools: a, b")]
    assert [r.path for r in documents.corrupt(df).collect()] == ["q"]


def test_imported_kinds(spark):
    src = spark.createDataFrame([("a", "text", "- first line here\n- second line"), ("b", "json", json.dumps({"cv": {"sections": {"x": [{"highlights": ["From json"]}]}}})), ("c", "pdf", "")], "file string, kind string, content string")
    assert sorted((r.file, r.text) for r in documents.imported(src).collect()) == [("a", "first line here"), ("a", "second line"), ("b", "From json")]


def test_documents_are_written_and_read(spark, tmp_path):
    path = f"file://{tmp_path}/d/doc.yaml"
    documents.write_document(spark, {"cv": {"sections": {"summary": ["Año 1"]}}, "_own": 1}, path)
    documents.write_document(spark, {"cv": {"sections": {"summary": ["Año 2"]}}, "_own": 1}, path)
    rows = documents.read_slots(documents.read_documents(spark, f"{tmp_path}/d/*.yaml")).collect()
    assert [r.text for r in rows] == ["Año 2"] and store.latest_file(spark, f"file://{tmp_path}/d", "*.yaml").endswith("doc.yaml")


def test_runs_texts_and_sessions(spark, tmp_path):
    tables = store.Tables(spark, f"file://{tmp_path}/t")
    texts = store.RunTexts(tables)
    assert texts.get("a") is None and not texts.delete("a")
    texts.put("a", "one")
    texts.put("b", "two")
    texts.put("a", "three")
    assert texts.get("a") == "three" and texts.delete("a") and texts.get("a") is None and texts.get("b") == "two"
    assert tables.within(f"file://{tmp_path}/t/x/../y") and not tables.within(f"file://{tmp_path}/t/../secret")
    sessions = store.Sessions(tables)
    assert sessions.load("s") is None
    frames = [spark.createDataFrame([("s", 1)], "session_id string, id int") for _ in range(3)]
    sessions.save("s", *frames)
    assert sessions.load("s")[0].count() == 1 and sessions.load("other") is None
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "good.json").write_text(json.dumps([{"run_id": "r"}]))
    (tmp_path / "runs" / "bad.json").write_text("{broken")
    runs = store.read_runs(spark, f"file://{tmp_path}/runs", "run_id string", aside=f"file://{tmp_path}/aside")
    assert [r.run_id for r in runs.collect()] == ["r"] and (tmp_path / "aside" / "bad.json.bak").exists()


def test_index_scores_equal_the_corpus(spark, tmp_path):
    from siftline.operators import retrieval

    index = store.RetrievalIndex(store.Tables(spark, f"file://{tmp_path}/s"))
    corpus = spark.createDataFrame([("s", 1, ["a", "b", "a"]), ("s", 2, ["b", "c"]), ("s", 3, ["d"])], "section string, doc_id int, tokens array<string>")
    queries = spark.createDataFrame([(7, ["a", "c", "c"])], "query_id int, tokens array<string>")
    index.build(corpus, "p")
    rounded = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in df.collect())
    assert rounded(index.scores(queries)) == rounded(retrieval.bm25_scores(corpus, queries))


def test_tables_versions_and_cache(spark, tmp_path):
    tables = store.Tables(spark, f"file://{tmp_path}/t")
    tables.write("runs", spark.range(3))
    tables.write("runs", tables.read("runs").where("id > 0"))  # rewritten from itself
    assert tables.read("runs").count() == 2
    tables.append("runs", spark.range(1))
    assert tables.read("runs").count() == 3
    cache = store.SelectionCache(tables, hours=1)
    assert cache.get("k") is None
    cache.put("k", spark.range(2))
    assert cache.get("k").count() == 2
    import time

    assert cache.get("k", now=time.time() + 7200) is None
    assert store.SelectionCache(tables, hours=0).get("k", now=time.time() + 7200).count() == 2


def test_index_is_fresh_until_the_corpus_changes(spark, tmp_path):
    index = store.RetrievalIndex(store.Tables(spark, f"file://{tmp_path}/i"))
    corpus = spark.createDataFrame([("s", 1, ["a", "b", "a"])], "section string, doc_id int, tokens array<string>")
    print_ = index.fingerprint(corpus, "p")
    assert not index.is_fresh(print_)
    index.build(corpus, print_)
    assert index.is_fresh(print_) and index.tables.read("postings").where(F.col("term") == "a").collect()[0].tf == 2
    assert not index.is_fresh(index.fingerprint(corpus.withColumn("doc_id", F.lit(2)), "p"))


def test_settings(tmp_path):
    assert Settings().errors() == []
    assert len(Settings(max_highlights=-1, mmr_balance=2.0).errors()) == 2
    path = str(tmp_path / "c.json")
    save(Settings(rrf_k=60), path)
    assert load(path, {"SIFTLINE_MAX_SKILLS": "9"}).rrf_k == 60
    assert load(path, {"SIFTLINE_MAX_SKILLS": "9"}).max_skills == 9
    assert Settings().fingerprint() == Settings(cache_hours=1).fingerprint() != Settings(rrf_k=60).fingerprint()
