"""Collocations against counting every phrase of every piece."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from siftline.llm import collocations as C

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(docs, least, top, percent=100):
    counts, totals = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    covered[p[s : s + m]] = max(covered[p[s : s + m]], a)
        rows = []
        for p, a in found.items():
            if 100 * covered[p] >= percent * a:
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((" ".join(p), a, f[p[:k]], f[p[k:]], totals[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, n, *r) for n, r in enumerate(rows[:top], 1)]
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [["New", "York", "city", "of", "the", "é", "ÉCLAIR", "a\x1cb", "x", "rare%d"], ["der", "die", "Das", "schöne", "rare%d"]]
    docs = []
    for k in range(n):
        which = rng.random() < 0.4
        text = "".join((w % rng.randint(0, 10**6) if "%" in w else w) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!"]) for w in rng.choices(words[which], [9, 9, 4, 6, 6, 2, 2, 1, 3, 2][: len(words[which])], k=rng.choice([0, 3, 40])))
        docs.append((("de" if which else "en") if rng.random() < 0.9 else None, text))
    docs += [("en", "New York city"), ("en", "new york"), (None, None), ("en", ""), ("fr", "once upon"), ("en", "ha ha ha ha ha ha ha ha")] * 9
    docs.append(("en", "New York city of the " * 700))
    return docs


def frame(spark, docs, parts=4):
    rows = [(n, lang, text, "clash", 1) for n, (lang, text) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string, word string, n int").repartition(parts)


@pytest.mark.parametrize("least,top,percent", [(8, 2000, 100), (3, 7, 80)])
def test_collocations_equal_counting(spark, least, top, percent):
    docs = corpus(least)
    got = C.collocations(frame(spark, docs), least=least, top=top, percent=percent)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(docs, least, top, percent)


@pytest.mark.parametrize("words", [4, 10**6])
def test_small_blocks_ranges_and_dictionary_shares(spark, words):
    """Many flushes, many key ranges and a dictionary in several passes change nothing."""
    docs, sizes = corpus(11, 60), C.Sizes(dictionary_words=words, words_at_once=5, keys_at_once=50, range_keys=200, sample_every=3, sampled=300)
    assert sorted(map(tuple, C.collocations(frame(spark, docs, 3), least=4, sizes=sizes).collect())) == plain(docs, 4, 2000)


def test_empty_and_without_frequent_phrases(spark):
    assert C.collocations(frame(spark, [], 1)).collect() == []
    assert C.collocations(frame(spark, [("en", None), (None, "a b c")], 1)).collect() == []


def test_wide_ids_sort_as_narrow_ones():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 20, (5000, C.LONGEST)).astype(np.uint32)
    ids[::7] = ids[0]
    keys, n = C.runs(C.packed(ids, 2), np.ones(len(ids), np.int64))
    want, count = np.unique(ids, axis=0, return_counts=True)
    assert (n == count).all() and (keys.reshape(len(keys), C.LONGEST, 2).astype(np.int64) @ np.array([65536, 1]) == want).all()
    rows = C.as_bytes(keys)
    assert [C.below(rows, rows[k].tobytes()) for k in (0, 17, len(rows) - 1)] == [0, 17, len(rows) - 1]


def test_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame([(2, bytes([0, 1, 0, 2]), 4 * 10**12)], "words int, key binary, n long")
    words = spark.createDataFrame([("en", b"a", 5 * 10**12 + 1, bytes([0, 1])), ("en", b"b", 7 * 10**12 + 3, bytes([0, 2]))], "lang string, word binary, n long, key binary")
    totals = spark.createDataFrame([("en", 9 * 10**15 + 7)], "lang string, total long")
    got = C.scored(phrases, phrases, words, totals, 2).collect()
    assert [r["score"] for r in got] == [1000 * 4 * 10**12 * (9 * 10**15 + 7) // ((5 * 10**12 + 1) * (7 * 10**12 + 3))]
