"""Packing against the tokenizer itself, and against what any packing needs."""

import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from siftline.llm.byte_pieces import ByteEncoder
from siftline.llm.packing import cut_documents, cut_lengths, fullest, pack, pack_documents, patterns, sequences, slack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_equals_tokenizer():
    rng = random.Random(7)
    letters = list("ab '\n\t é.,!?12<|>ß\x1c 中µª") + ["<|endoftext|>", "'ll", ".\n"]
    texts = ["", " ", "  ", "a  b", "a   b ", " a", "a \n  b\n\n c", "it's don't 'll x'", "x<|endoftext|> y", None, "é" * 500, "x.\nY, z"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    got = ByteEncoder(PATH).encode(pa.array(texts), 2)
    tokenizer = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, got, strict=True):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert ids == struct.pack(f"<{len(want)}I", *want), text


def test_other_tokenizers_are_used_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, tokenizer = ByteEncoder(path), Tokenizer.from_file(path)
    assert not encoder.plain
    texts = ["Some  Words, here.\n", "", "don't"]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in encoder.encode(pa.array(texts), 2)] == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_cut_lengths():
    assert [cut_lengths(n, 4) for n in (1, 4, 5, 8, 9)] == [[1], [4], [1, 4], [4, 4], [1, 4, 4]]


def test_fullest_is_the_best_sum():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randint(5, 40)
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 12)))
        sums = {0}
        for length in counts.elements():
            sums |= {s + length for s in sums if s + length <= capacity}
        taken = fullest(sorted(counts), [counts[k] for k in sorted(counts)], capacity)
        assert sum(a * n for a, n in taken) == max(sums) and all(n <= counts[a] for a, n in taken)


def test_patterns_take_every_piece_once():
    rng = random.Random(2)
    counts = Counter(rng.randint(1, 64) for _ in range(3000))
    made = patterns(counts, 64)
    used = Counter()
    for times, parts in made:
        assert sum(a * n for a, n in parts) <= 64
        for a, n in parts:
            used[a] += times * n
    assert used == counts
    need, least = slack(np.array(list(counts.elements())), 64)
    assert need <= 1.01 * least


def test_patterns_are_as_few_as_can_be():
    """Against every way to pack a handful of pieces."""
    rng = random.Random(4)

    def least(pieces, bins):
        if not pieces:
            return len(bins)
        options = []
        for k in {b: k for k, b in enumerate(bins) if b >= pieces[0]}.values():
            options.append(least(pieces[1:], [*bins[:k], bins[k] - pieces[0], *bins[k + 1 :]]))
        return min([*options, least(pieces[1:], [*bins, 20 - pieces[0]])])

    more = 0
    for _ in range(40):
        pieces = [rng.randint(1, 20) for _ in range(7)]
        more += slack(np.array(pieces), 20)[0] - least(pieces, [])
    assert more <= 1


def check(rows, docs, capacity):
    """Every document whole, every sequence gapless and within its capacity."""
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append(r)
    for parts in places.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == [sum(x["length"] for x in parts[:k]) for k in range(len(parts))]
        assert sum(r["length"] for r in parts) <= capacity
    for doc_id, text in docs:
        want = whole_ids(text)
        mine = sorted(pieces[doc_id], key=lambda r: r["piece"])
        assert [r["length"] for r in mine] == cut_lengths(len(want), capacity)
        assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:k]) for k in range(len(mine))]
        assert b"".join(bytes(r["ids"]) for r in mine) == struct.pack(f"<{len(want)}I", *want)
    return len(places)


def test_pack_documents(spark):
    rng = random.Random(3)
    docs = [(n, " ".join(rng.choice(["alpha", "Beta,", "gamma.\nDelta", "x"]) for _ in range(rng.choice([0, 1, 5, 20, 60, 400])))) for n in range(300)]
    docs += [(1000, None), (1001, ""), (None, "no id"), (1002, "word " * 3000)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, length int, sequence_id string").repartition(5)
    rows = pack_documents(df, PATH, capacity=64).collect()
    n = check(rows, docs, 64)
    least = -(-sum(r["length"] for r in rows) // 64)
    assert n <= least * 1.02 + 1


def test_repeated_ids_and_one_hot_length(spark):
    df = spark.createDataFrame([(7, "same text")] * 500 + [(8, "same text")] * 3, "doc_id long, text string").repartition(4)
    length = len(whole_ids("same text"))
    rows = pack_documents(df, PATH, capacity=4 * length + 1).collect()
    assert Counter(r["doc_id"] for r in rows) == {7: 500, 8: 3}
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 503 and len({r["sequence_id"] for r in rows}) == 126


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_sequences_hold_their_pieces(spark):
    docs = [(n, "one two three " * n) for n in range(40)]
    packed = pack(cut_documents(spark.createDataFrame(docs, "doc_id long, text string"), PATH, 50), 50)
    whole = {r["sequence_id"]: r for r in sequences(packed).collect()}
    for r in packed.collect():
        s = whole[r["sequence_id"]]
        assert bytes(s["ids"])[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"]) and r["offset"] + r["length"] in s["ends"]
        assert s["n_tokens"] <= 50 and zlib.crc32(bytes(r["ids"])) >= 0
