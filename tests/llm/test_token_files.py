import zlib

import numpy as np
import pytest

from siftline.llm.token_files import END_ID, FrameReader, WordEncoder, filesystem, token_output, write_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, world! It's 2 o'clock…", "", None, "É è ﬁ ǅ Σίσυφος ΟΔΟΣ İstanbul", "<|endoftext|> a<|startoftext|>b", "tab\tand nbsp em\x1cfs\r\nend", "é ≠ 'tis don't 'S x's!", "x" * 3000, "日本語 🙂🙂 ½²", " lead", "word. word, word!! (word)"]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    for text, got in zip(TEXTS, WordEncoder(PATH).encode(TEXTS), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, END_ID]


def test_every_letter_before_a_mark_equals_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha() and not 0x3400 <= c < 0xD800 and c < 0x20000]
    texts = [f"a{c}! b{c}.. {c}?{c}" for c in letters]
    for text, want, got in zip(texts, plain.encode_batch(texts, add_special_tokens=False), WordEncoder(PATH).encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*want.ids, END_ID], text


def test_round_trip_and_random_access(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i * 3 - 5, t) for i, t in enumerate(TEXTS * 3)] + [(None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_output(df, PATH, f"file://{tmp_path}/a").orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    encoded = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, END_ID], "<u4").tobytes() for i, t in rows}
    start = 0
    for r, i in zip(got, sorted(encoded, key=lambda i: (i is not None, i or 0)), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(encoded[i]) // 4, zlib.crc32(encoded[i]))
        start += r.n_tokens
    manifest = write_tokens(df, f"file://{tmp_path}/b", PATH).collect()
    fs, path = filesystem(manifest[0].file)
    with fs.open_input_file(path) as source:
        reader = FrameReader(source)
        assert reader.content(1) == encoded[reader.doc_ids[1]]
    raw = bytearray(open(path, "rb").read())
    raw[6] ^= 1
    open(path, "wb").write(raw)
    with fs.open_input_file(path) as source, pytest.raises(Exception):  # noqa: B017
        FrameReader(source).content(0)
    assert token_output(df.limit(0), PATH, f"file://{tmp_path}/c").count() == 0
