"""Folds over long arrays against plain Python."""

import random
import re
import time

from pyspark.sql import functions as F

from siftline.functions.folds import scanned
from siftline.operators import corpora, importer


def pick(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


def test_scanned_at_block_ends(spark):
    for n in (0, 1, 63, 64, 65, 200):
        got = spark.range(1).select(scanned(F.expr(f"slice(sequence(0, {n}), 1, {n})"), F.lit(0), lambda s, x: s + x, lambda s, x: s + x, "int").alias("x")).first().x
        assert got == [sum(range(k + 1)) for k in range(n)]


def plain_bullets(text):
    out = []
    for line in re.split(r"\r\n|[\n\x0b\x0c\r\x85  ]", text):
        own = re.sub(r"\s+", " ", re.sub(r"^[\s\-•·*–—>]+", "", line)).strip(" ")
        marked = re.match(r"\s*[-•·*–—>]", line)
        if not marked and out and len(own) >= 8 and len(out[-1]) + 1 + len(own) <= 300:
            out[-1] += " " + own
        elif 8 <= len(own) <= 300:
            out.append(own)
    return out


def test_bullets_equal_a_plain_loop(spark):
    rng = random.Random(6)
    texts = ["", "short", "- " + "x" * 400]
    for _ in range(60):
        texts.append("\n".join(rng.choice(["- ", "", "  ", "* ", "• "]) + " ".join(["word", "longer", "a"][rng.randrange(3)] for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 90))))
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", importer.bullets(F.col("t")).alias("b")).collect()
    assert {r.k: r.b for r in rows} == {k: plain_bullets(t) for k, t in enumerate(texts)}


def test_ranges_equal_a_plain_loop(spark):
    rng = random.Random(7)
    for _ in range(12):
        text = "".join(rng.choice("abcAB ") for _ in range(rng.randint(0, 300)))
        terms = ["ab", "abc", "b", "aa", "zz"][: rng.randint(1, 5)]
        spans = sorted((m.start(), m.end()) for t in terms for m in re.finditer(re.escape(t), text.lower()))
        merged, kept, last = [], [], 0
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
            if a >= last:
                kept.append((a, b))
                last = b
        assert [tuple(r) for r in pick(spark, corpora.highlight_ranges(F.col("t"), F.col("w")), t=text, w=terms)] == merged
        assert [tuple(r) for r in pick(spark, corpora.marks(F.col("t"), F.col("w")), t=text, w=terms)] == kept


def test_long_texts_take_linear_time(spark):
    def seconds(n):
        start = time.time()
        assert len(pick(spark, corpora.occurrences(F.col("t"), F.lit("the")), t="the " * n)) == n
        assert len(pick(spark, importer.bullets(F.col("t")), t="- a line of its own\n" * n)) == n
        return time.time() - start

    seconds(100)
    assert seconds(40_000) < 30  # quadratic folds took minutes
