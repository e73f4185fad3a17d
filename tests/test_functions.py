import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import stems
from siftline.functions import text as T
from siftline.functions.words import STOPWORDS, variants


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).collect()[0].x


def test_tokens_keep_marks_and_expand(spark):
    text = "The ci/cd of C++ and next.js, gh actions well-known"
    got = one(spark, T.tokens(F.col("t")), t=text)
    assert "ci/cd" in got and "c++" in got and "next.js," in got
    assert got[got.index("gh actions") + 1 :][:2] == ["github", "actions"]
    assert "well" in got and "known" in got
    assert not set(got) & STOPWORDS


def test_contains_term_is_bounded(spark):
    for text, hit in (("uses jsp and json", False), ("on node.js daily", True), ("JavaScript.", True), ("", False)):
        assert one(spark, T.contains_term(F.col("t"), "js"), t=text) is hit


def test_count_term_regimes(spark):
    text = "GitHub actions, github  actions; github actionscript. C++ c++17 rápido r"
    assert one(spark, T.count_term(F.col("t"), "github actions"), t=text) == 2
    assert one(spark, T.count_term(F.col("t"), "c++"), t=text) == 2
    assert one(spark, T.count_term(F.col("t"), "r"), t=text) == 1


def test_dictionary_pairs_consume_words(spark):
    got = one(spark, T.dictionary_terms(F.col("t"), ["spring boot", "spring", "c++", "docker"]), t="Spring Boot, docker. and C++")
    assert got == ["c++", "docker", "spring boot"]
    assert one(spark, T.dictionary_terms(F.col("t"), ["spring boot", "spring"]), t="spring boot y spring core") == ["spring", "spring boot"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Intro\nRequisitos: Python y SQL\nOfrecemos: sueldo", "Python y SQL"),
        ("We build things. Nice to have: Go", "We build things."),
        ("Plus: kindness", "kindness"),
        ("Only text ", "Only text"),
    ],
)
def test_requirements(spark, text, want):
    assert one(spark, T.requirements(F.col("t")), t=text) == want


def test_chunks_overlap_and_end(spark):
    words = [str(i) for i in range(401)]
    got = one(spark, T.chunks(F.col("t")), t=" ".join(words))
    assert [len(c.split()) for c in got] == [200, 200, 101]
    assert got[1].split()[0] == "150"
    assert one(spark, T.chunks(F.col("t")), t="a  b") == ["a  b"]


def test_negated_terms_and_contradiction(spark):
    held = F.array(*map(F.lit, ("docker", "java", "kafka")))
    assert one(spark, T.negated_terms(F.col("t"), held, ["docker"]), t="No se requiere Docker. Java y Kafka.") == ["docker"]
    assert one(spark, T.negated_terms(F.col("t"), held, ["docker"]), t="No se requiere Docker. Usamos docker.") == []


def test_month_key(spark):
    rows = spark.createDataFrame([(d,) for d in ("2020-05", "2019", "present", "", None, "2020-01-31")], "d string").select(T.month_key(F.col("d")).alias("k")).collect()
    assert [r.k for r in rows] == [2020 * 12 + 5, 2019 * 12 + 1, 10**6, 10**6, 10**6, -(10**6)]


def test_text_lines(spark):
    assert [one(spark, T.text_lines(F.col("t")), t=x) for x in ("", " ", "a", "a" * 90, "a" * 91)] == [0, 0, 1, 1, 2]


def test_variants_are_symmetric():
    assert variants("PostgreSQL") == ["postgres", "postgresql"]
    assert variants("cassandra") == variants("mongodb")
    assert variants("kafka") == ["kafka"]


def test_chunks_equal_a_plain_loop(spark):
    for n in (0, 1, 199, 200, 201, 350, 351, 352, 500, 501, 777):
        words = [f"w{i}" for i in range(n)]
        want, at = [], 0
        while n > 200:
            want.append(" ".join(words[at : at + 200]))
            if at + 200 >= n:
                break
            at += 150
        assert one(spark, T.chunks(F.col("t")), t=" ".join(words)) == (want or [" ".join(words)])


def test_negation_knows_synonyms(spark):
    from siftline.operators import retrieval

    queries = spark.createDataFrame([("a", "No se requiere kubernetes."), ("b", "Buscamos experto en k8s. No se requiere kubernetes."), ("c", "No se requiere cobol.")], "query_id string, text string")
    corpus = spark.createDataFrame([("we run k8s daily",), ("nothing else",)], "text string")
    terms = queries.select("query_id", F.explode(T.negated_candidates(F.col("text"))).alias("term"))
    held = queries.join(retrieval.held_terms(terms, corpus), "query_id", "left")
    assert {r.query_id: r.n for r in held.select("query_id", T.negated_terms(F.col("text"), F.col("held")).alias("n")).collect()} == {"a": ["kubernetes"], "b": [], "c": []}
    with_list = held.select("query_id", T.negated_terms(F.col("text"), F.col("held"), ["kubernetes"]).alias("n"))
    assert {r.query_id: r.n for r in with_list.collect()} == {"a": ["kubernetes"], "b": [], "c": []}
    texts = spark.createDataFrame([("Uses K8s.",), ("Uses k8sx",)], "text string")
    assert [r.x for r in texts.select(T.excludes(F.array(F.lit("kubernetes")), F.col("text")).alias("x")).collect()] == [True, False]
    opened = spark.createDataFrame([("o", "k8s experto")], "query_id string, text string")
    found = retrieval.held_terms(opened.select("query_id", F.explode(T.open_candidates(F.col("text"))).alias("term")), spark.createDataFrame([("kubernetes here",)], "text string"))
    assert found.first().held == ["k8s"]


def test_negated_terms_by_words_alone_equal_those_by_patterns(spark):
    """Texts without a marker are left out before they are parted, and held_terms works its terms out once."""
    from siftline.operators import retrieval

    words, patterns = ("worthless", "idiot"), ("(?:worthless)", "(?:idiot)")
    texts = ["Docker is Worthless. Java here", "java docker", "", None, "IDIOT\nworthless kafka streams! kafka stays", "worth-less docker"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "query_id int, text string")
    held = F.array(*map(F.lit, ("docker", "kafka", "kafka streams", "streams")))
    one, other = ([(r.c or [], r.n) for r in docs.orderBy("query_id").select(T.negated_candidates(F.col("text"), p).alias("c"), T.negated_terms(F.col("text"), held, (), p).alias("n")).collect()] for p in (words, patterns))
    assert one == other and one[0][1] == ["docker"] and one[4][1] == ["kafka streams", "streams"]
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        calls.add(1)
        return t

    retrieval.held_terms(docs.where("query_id < 2").select("query_id", seen("text").alias("term")), docs).collect()
    assert calls.value == 2


def test_endings_by_length_equal_a_look_at_each():
    rng = random.Random(8)
    for _ in range(2000):
        endings = tuple({"".join(rng.choice("abá") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))})
        word, start = "".join(rng.choice("abá") for _ in range(rng.randint(0, 8))), rng.randint(0, 9)
        want = max((e for e in endings if len(word) - len(e) >= start and word.endswith(e)), key=len, default="")
        assert stems.ending(word, stems.Endings(endings), start) == stems.ending(word, endings, start) == want
