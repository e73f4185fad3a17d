"""Which terms a corpus holds, against the pattern itself."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from siftline.operators import blocks, retrieval


def test_held_variants_equal_the_pattern(spark):
    rng = random.Random(9)
    atoms = ["ab", "c", "é", "tat", "génération", "k8", " ", " ", "  ", "-", ". ", "ñ", "\n", "x1", "#", "_"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 30))) for _ in range(80)] + ["", "Ab C", "éétat", "c#"]
    terms = {"ab", "c", "ab c", "tat", "état", "é", "génération", "génération ab", "k8", "c#", "#", "ñ x1", "zz", "x1 c ab", "_", "c -", "étatx"} | {"".join(rng.choice(atoms) for _ in range(rng.randint(1, 4))).strip() for _ in range(150)}
    terms = sorted(t.lower() for t in terms if t and "\n" not in t)
    asked = spark.createDataFrame([(t,) for t in terms], "variant string")
    got = {r.variant for r in retrieval.held_variants(asked, spark.createDataFrame([(t,) for t in texts], "text string"), []).collect()}
    assert got == {t for t in terms if any(re.search(rf"(^|[^a-z0-9]){re.escape(t)}([^a-z0-9]|$)", x.lower()) for x in texts)}
    own = spark.createDataFrame([("q", "ab"), ("q", "c"), ("r", "ab"), ("r", "état")], "query_id string, variant string")
    mine = spark.createDataFrame([("q", "ab."), ("r", "c éétat")], "query_id string, text string")
    assert {tuple(r) for r in retrieval.held_variants(own, mine, ["query_id"]).collect()} == {("q", "ab"), ("r", "état")}
    assert retrieval.held_variants(asked.where("false"), mine, []).collect() == []


def test_tasks_part_words_as_the_pattern_does():
    rng = random.Random(5)
    atoms = ["ab", "c", "é", "tat", "漢字", "k8", " ", " ", "  ", "-", ". ", "ñ", "\n", "x1", "\u00a0", "_", "𝒳"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 20))) for _ in range(300)] + ["", None, " ", "ab", " ab "]
    column = pa.array(["unread", *texts], pa.string()).slice(1)
    for letters, inside in ((False, "a-z0-9"), (True, "a-z0-9à-ÿ漢字𝒳")):
        words, row = blocks.bordered(column, letters)
        got = [[] for _ in texts]
        for word, k in zip(words.to_pylist(), row.tolist(), strict=True):
            got[k].append(word)
        assert got == [[x for x in re.findall(f"[{inside}]+|[^{inside}]+", t or "") if x != " "] for t in texts]


def test_texts_that_hold_phrases_and_runs(spark):
    texts = spark.createDataFrame([("ab état",)], "text string")
    assert [tuple(r) for r in blocks.held_phrases(texts.select(F.lower("text")), ["état", "tat"], True).collect()] == [("état",)]
    found = blocks.holding(texts.unionByName(texts.select(F.lit("x y").alias("text"))), ["tat", "y", ""]).collect()
    assert {(r.text, tuple(sorted(r.runs))) for r in found} == {("ab état", ("", "tat")), ("x y", ("", "y"))}
