"""Ids of a byte-level vocabulary, worked out once for each distinct piece of text.

Such a vocabulary parts a text by a fixed pattern in which a blank belongs to the
word after it. So nothing joins across a blank that stands before a character
other than white space: a block of texts is cut at its blanks and the pieces are
dictionary-encoded by Arrow; only distinct ones are looked up or learnt, and the
texts' ids are gathered from them as arrays. Texts with other blanks go through
the whole tokenizer. A new piece of plain Latin letters (each one a letter to any
Unicode pattern), ASCII marks and perhaps a line end goes to the tokenizer's model
in parts, as the pattern parts them; apostrophes, digits and all else go through
the whole tokenizer. The rules hold for a tokenizer without normaliser and with a
byte-level pre-tokenizer that adds no blank; any other one is used as it is.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .token_files import byte_letters

#: Distinct pieces whose ids a worker keeps, in each of two generations; the older one goes when the younger is full.
CACHED_PIECES = 400_000
#: Longer pieces aren't kept.
LONGEST_KEPT = 64
#: Bytes of text that are encoded at once.
BLOCK_BYTES = 6 << 20


class ByteEncoder:
    """A worker process keeps its encoder from task to task."""

    of_process: dict = {}

    #: A word, marks after it, and perhaps a line end with another word and marks.
    PIECE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)?(?:\n([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)?)?")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        before, model = said.get("pre_tokenizer") or {}, said["model"]
        self.plain = (
            said.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or self.PIECE.fullmatch(t["content"]) for t in said["added_tokens"])
        )
        letters = byte_letters()
        self.model, self.blank = self.tokenizer.model, letters[0x20]
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.line_end = self.whole(["\n"])[0]
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> ByteEncoder:
        if path not in cls.of_process:
            cls.of_process[path] = cls(path)
        return cls.of_process[path]

    def whole(self, pieces: list[str]) -> list[bytes]:
        """Ids by way of the whole tokenizer."""
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def part(self, part: str, spelt: str) -> bytes:
        """Ids of a run of letters or marks, spelt in the letters that stand for its bytes, by way of the model."""
        found = self.old_parts.get(part)
        if found is None:
            tokens = self.model.tokenize(spelt)
            found = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        self.parts[part] = found
        return found

    def learn(self, pieces: list[str]) -> None:
        """Ids of pieces that a blank precedes."""
        ids, old, parts, match, letters, blank, others = self.ids, self.old, self.parts, self.PIECE.fullmatch, self.letters, self.blank, []
        for piece in pieces:
            if piece in old:
                ids[piece] = old[piece]
                continue
            m = match(piece)
            if m is None:
                others.append(piece)
                continue
            word, marks, next_word, next_marks = m.groups()
            # words are kept as they are, those at a line's start behind a line end: neither is taken for the other
            found = parts.get(word) or self.part(word, blank + (word if word.isascii() else word.translate(letters)))
            if marks:
                found += parts.get(" " + marks) or self.part(" " + marks, marks)
            if next_word:
                key = "\n" + next_word
                found += self.line_end + (parts.get(key) or self.part(key, next_word if next_word.isascii() else next_word.translate(letters)))
                if next_marks:
                    found += parts.get(" " + next_marks) or self.part(" " + next_marks, next_marks)
            ids[piece] = found
        ids.update(zip(others, self.whole([" " + p for p in others]), strict=True))

    def block(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts, none of them null."""
        if len(self.ids) > CACHED_PIECES:
            self.ids, self.old = {}, self.ids
        if len(self.parts) > CACHED_PIECES:
            self.parts, self.old_parts = {}, self.parts
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        pieces, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        first = np.zeros(len(codes), bool)
        first[ends[:-1]] = True
        # a blank before white space or the end isn't a place to cut
        uncut = np.fromiter([not p or p[0].isspace() for p in pieces], bool, len(pieces))
        odd = np.add.reduceat(uncut[codes] & ~first, ends[:-1]) > 0
        known = self.ids
        if unknown := [p for p in pieces if p not in known]:
            self.learn(unknown)
        found = [known[p] for p in pieces]
        # a text's first piece has no blank before it
        starts = self.whole([pieces[c] for c in codes[ends[:-1]]])
        codes = codes.copy()
        codes[ends[:-1]] = len(pieces) + np.arange(len(starts))
        found += starts
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        before = np.cumsum(lengths) - lengths
        ids = table[np.repeat(at[codes] - before, lengths) + np.arange(lengths.sum())]
        bounds = np.append(before, len(ids))[ends]
        out = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if odd.any():
            for k, whole in zip(np.flatnonzero(odd), self.whole(texts.filter(pa.array(odd)).to_pylist()), strict=True):
                out[k] = whole
        for p in unknown:
            if len(p) > LONGEST_KEPT:
                known.pop(p, None)
        return out

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[bytes]:
        """Each text's ids and the end id, as little-endian unsigned 32-bit integers; null counts as empty."""
        end = struct.pack("<I", end_id)
        texts = texts.cast(pa.large_string()).fill_null("")
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        k = 0
        while k < len(texts):
            upto = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + BLOCK_BYTES, "right")))
            some = texts.slice(k, upto - k)
            yield from (ids + end for ids in (self.block(some) if self.plain else self.whole(some.to_pylist())))
            k = upto
