"""Dictionary matching by joins against plain Python, term by term."""

import random
import re

from siftline.operators import phrases, retrieval

EDGES = ".,;:!?()[]{}<>\"'¡¿…"


def normal(text):
    return text.lower().replace("-", " ").replace("/", " ").replace("+", " ")


def count(text, term):
    raw = any(c in "+#.-/" for c in term)
    body = re.escape(term) if raw else r"\s+".join(map(re.escape, term.split(" ")))
    left = r"(?<!\w)" if not raw or term[0].isalnum() else ""
    right = r"(?!\w)" if not raw or term[-1].isalnum() else ""
    return len(re.findall(left + body + right, text.lower() if raw else normal(text)))


def found(text, dictionary):
    words, out, i = [w.strip(EDGES) for w in normal(text).split()], set(), 0
    while i < len(words):
        if i + 1 < len(words) and f"{words[i]} {words[i + 1]}" in dictionary:
            out.add(f"{words[i]} {words[i + 1]}")
            i += 2
            continue
        if words[i] in dictionary:
            out.add(words[i])
        i += 1
    return out | {t for t in dictionary if any(c in t for c in "+#.-/") and count(text, t)}


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["ha", "spark", "sql", "data", "Node.js", "c++", "C#", "x/y", "é", "big-data", "k8s", "stream", "(sql)", "sql,", "docker.", "…end", "w17", "w4711"]
    return [(k, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", ", ", ". "]) for _ in range(rng.randint(0, 40)))) for k in range(n)] + [(1000, ""), (1001, "ha ha ha ha ha"), (1002, "ha, ha")]


TERMS = ["ha", "ha ha", "ha ha ha", "spark sql", "spark", "sql", "sql data", "node.js", "c++", "c#", "x/y", "é", "big data", "big-data", "data stream sql", "++", "docker", "k8s stream", "don't"]


def test_counts_equal_regular_expressions(spark):
    rows = texts(1)
    got = {(r.query_id, r.term): r.freq for r in phrases.term_counts(spark.createDataFrame(rows, "query_id int, text string"), spark.createDataFrame([(t,) for t in TERMS], "term string")).collect()}
    assert got == {(k, t): count(x, t) for k, x in rows for t in TERMS if count(x, t)}


def test_dictionary_of_ten_thousand_terms(spark):
    rng = random.Random(3)
    dictionary = {*TERMS, *(f"w{k}" for k in range(5000)), *(f"w{rng.randint(0, 9999)} w{k}" for k in range(5000))}
    rows = [*texts(2), *((2000 + k, " ".join(f"w{rng.randint(0, 9999)}" for _ in range(200))) for k in range(20))]
    frame, terms = spark.createDataFrame(rows, "query_id int, text string"), spark.createDataFrame([(t,) for t in dictionary], "term string")
    matches = phrases.dictionary_matches(frame, terms)
    assert {(r.query_id, r.term) for r in matches.collect()} == {(k, t) for k, x in rows for t in found(x, dictionary)}
    counts = {(r.query_id, r.term): r.freq for r in phrases.term_counts(frame, terms).collect()}
    assert all(counts[k, t] == count(x, t) for k, x in rows[:20] for t in found(x, dictionary) if count(x, t))
    plan = matches._jdf.queryExecution().executedPlan().toString()
    assert "w4711" not in plan  # the dictionary is data, not part of the plan


def test_without_terms(spark):
    frame = spark.createDataFrame(texts(4, 3), "query_id int, text string")
    none = spark.createDataFrame([], "term string")
    assert phrases.term_counts(frame, none).collect() == [] and phrases.dictionary_matches(frame, none).collect() == []
    assert retrieval.term_frequencies(frame, []).columns == ["query_id", "keyword", "freq"]


def test_keyword_channel_counts_each_keyword_once(spark):
    corpus = spark.createDataFrame([("s", 1, "Kubernetes and k8s, big  data"), ("s", 2, "big, data node.js"), ("s", 3, "bigdata nodejs")], "section string, doc_id int, text string")
    keywords = spark.createDataFrame([("q", "kubernetes", 3), ("q", "big data", 2), ("q", "node.js", 5), ("q", "node.js", 1)], "query_id string, keyword string, freq int")
    got = {r.doc_id: r.score for r in retrieval.keyword_channel(corpus, keywords).collect()}
    assert got[1] == 5.0 and got[2] == 5.0 and got.get(3) in (None, 5.0)
    none = retrieval.keyword_channel(corpus, keywords.where("false"))
    assert none.collect() == [] and none.columns == ["query_id", "section", "doc_id", "score"]
