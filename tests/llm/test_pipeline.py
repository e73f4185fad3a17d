import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_ops import edit, prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS)


def alike(a, b):
    a, b = a.lower().split(), b.lower().split()
    return 1 - edit(a, b) / max(len(a), len(b)) >= 0.8


def test_near_dedup_drops_rows_not_ids(spark):
    a, b = prose(1, 60), prose(2, 60)
    a2, b2 = ["changed", *a[1:]], ["changed", *b[1:]]
    rows = [(7, " ".join(a), "s"), (9, " ".join(a2), "s"), (3, " ".join(b), "s"), (7, " ".join(b2), "s")]
    left = corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()
    assert {(r.doc_id, r.text) for r in left} == {(7, rows[0][1]), (3, rows[2][1])}


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows, an empty table, clashing columns."""
    text = " ".join(prose(9, 50))
    rows = [(1, text, "s"), (1, text, "s"), (2, text + " more", None), (None, None, None), (None, text, "s"), (3, "", "s"), (4, "", "s"), (5, "!!", "s"), (6, "w " * 30_000, "s"), (7, None, "t")]
    clash = ["_gone_id", "row", "n", "_src", "_of", "node", "bucket", "copies", "tokens", "hash"]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, lang string").withColumns({c: F.lit(c) for c in clash})
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (5, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(prose(77, 9))), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert all(r[c] == c for r in got for c in clash)
        if name != "shards":
            assert out.columns == docs.columns
        kept = Counter((r.doc_id, r.text) for r in got)
        if name in ("quality", "decontamination", "shards"):
            assert kept == Counter(r[:2] for r in rows)
        elif name == "mixture":
            assert set(kept) == {r[:2] for r in rows}
        else:
            assert kept == Counter({(1, text): 2, (3, ""): 1, (5, "!!"): 1, (6, "w " * 30_000): 1})


def test_run_against_plain_python(spark, tmp_path):
    rng, rows, labels, item = random.Random(4), [], [], " ".join(prose(4242, 30))
    for i in range(240):
        words, kind = prose(3000 + i, 40), i % 4
        if kind == 0:
            for k in range(0, 40, 3):
                words[k] = ("vile", "nasty")[k % 2]
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        labels.append((i, int(kind != 1), int(kind == 0)))
        rows.append((i, " ".join(words), "ample" if i % 12 in (2, 3, 6) else "scarce" if i % 12 in (7, 10) else "other"))
    rows = [(i, t, s if s != "other" or i % 4 < 2 else "ample") for i, t, s in rows]
    clean = [r for r in rows if r[0] % 4 > 1]
    for i, t, s in rng.sample(clean, 20):  # near copies
        words = t.split()
        words[rng.randrange(40)] = "changed"
        rows.append((1000 + i, " ".join(words), s))
        labels.append((1000 + i, 1, 0))
    for i in range(2000, 2006):  # leaks
        rows.append((i, f"{item} {' '.join(prose(i, 30))}", "ample"))
        labels.append((i, 1, 0))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = {i for i, quality, toxic in labels if quality and not toxic}
    stays: list = []
    for r in sorted(r for r in rows if r[0] in good):  # near copies differ from their first in one word, so classes are stars
        if not any(alike(r[1], x[1]) for x in stays):
            stays.append(r)
    stays = [r for r in stays if item not in r[1]]
    tokens = Counter()
    for _, t, s in stays:
        tokens[s] += len(t.split())
    most, by_id = max(tokens.values()), {r[0]: r for r in stays}
    assert all(most / n <= 2 for n in tokens.values()) and min(tokens.values()) < most  # so each source reaches the largest one's tokens

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(r.doc_id for r in got)
    assert set(copies) == set(by_id) and set(copies.values()) <= {1, 2}
    assert all((r.doc_id, r.text, r.source) == by_id[r.doc_id] for r in got)
    used = Counter()
    for r in got:
        used[r.source] += len(r.text.split())
    assert used.keys() == tokens.keys() and all(most <= n < most + 40 for n in used.values())
    per_shard = Counter(r.shard for r in got)
    assert set(per_shard) == set(range(24)) and max(per_shard.values()) - min(per_shard.values()) <= 1
    assert {(r.shard, r.slot) for r in got} == {(s, k) for s, n in per_shard.items() for k in range(n)}
