"""Token-id files: one independent zstandard frame a document, a trailing seek table, per-frame checksums.

A file is, in this order: a frame for each document, holding its token ids as
little-endian unsigned 32-bit integers; a skippable frame with the documents'
ids (little-endian signed 64-bit); and a seek table in the public zstd seekable
layout (a skippable frame whose footer ends the file): for each frame its
compressed size, its decompressed size and the low 32 bits of the XXH64 of its
content. A reader seeks to the footer, reads the table, and decompresses just
the frames it wants; each is checked against its checksum.

Texts are dealt by ranges of doc_id, so file number, then place in the file,
is ascending doc_id order. A file is written under a temporary name and then
moved, with a name and content that depend on the partition alone, so a task
that runs again after a lost executor writes the same file again.

Defined results: null text counts as empty and yields the end id alone; rows
that repeat an id are encoded each, in order of their text; a null id comes
first and is stored as the smallest 64-bit integer, read back as null; an empty
table writes no frames.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, written

#: Fixed values of the zstd seekable layout and of skippable frames.
SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
NULL_ID = -(1 << 63)
END_ID = 2
#: Distinct pieces whose ids a worker keeps, in each of two generations; the older one goes when the younger is full.
CACHED_PIECES = 700_000


def byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary has for each byte: itself, or the next one from 256 on where it isn't printable."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class WordEncoder:
    """Ids of texts as bytes.

    The tokenizer never joins characters across a blank, so the ids of
    blank-free pieces are kept and joined. It ignores case, takes a run of
    letters as one word, and parts letters from the punctuation after them,
    apostrophes apart. So a new piece of plain Latin letters (ASCII and Latin-1:
    each is whole in normal form and stays one letter in lower case) goes to the
    tokenizer's model directly, in the letters that stand for its bytes, and a
    tail of ASCII marks is encoded by itself. All other pieces go through the
    whole tokenizer. A worker process keeps its encoder from task to task.
    """

    of_process: dict = {}

    PIECE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)?")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.ids, self.parts, self.tails = Tokenizer.from_file(path), {}, {}, {}
        self.old_ids, self.old_parts = {}, {}
        self.model, letters = self.tokenizer.model, byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}

    @classmethod
    def at(cls, path: str) -> WordEncoder:
        if path not in cls.of_process:
            cls.of_process[path] = cls(path)
        return cls.of_process[path]

    def learn(self, pieces: set[str]) -> None:
        ids, parts, known, old = self.ids, self.parts, self.old_ids, self.old_parts
        match, tokenize, pack = self.PIECE.fullmatch, self.model.tokenize, struct.pack
        others = []
        for piece in pieces:
            if piece in known:
                ids[piece] = known[piece]
                continue
            m = match(piece)
            if not m:
                others.append(piece)
                continue
            word, tail = m.groups("")
            word = word.lower()
            found = parts.get(word) or old.get(word)
            if found is None:
                tokens = tokenize(word if word.isascii() else word.translate(self.letters))
                found = pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            parts[word] = found
            if tail:
                if tail not in self.tails:
                    self.tails[tail] = self.whole([tail])[0]
                found += self.tails[tail]
            ids[piece] = found
        ids.update(zip(others, self.whole(others), strict=True))

    def whole(self, pieces: list[str]) -> list[bytes]:
        """Ids by way of the whole tokenizer."""
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, texts: list[str | None], at_once: int = 256) -> Iterator[bytes]:
        end = struct.pack("<I", END_ID)
        for k in range(0, len(texts), at_once):
            split = [(t or "").replace("\n", " ").split(" ") for t in texts[k : k + at_once]]
            if len(self.ids) > CACHED_PIECES:
                self.ids, self.old_ids, self.parts, self.old_parts = {}, self.ids, {}, self.parts
                self.tails = {}
            if unknown := set().union(*split).difference(self.ids):
                self.learn(unknown)
            for pieces in split:
                yield b"".join(map(self.ids.__getitem__, pieces)) + end


class FrameWriter:
    def __init__(self, sink, level: int = 3):
        self.sink, self.zstd, self.entries, self.ids = sink, zstandard.ZstdCompressor(level=level, write_checksum=False), [], []

    def add(self, doc_id: int | None, content: bytes) -> None:
        frame = self.zstd.compress(content)
        self.sink.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.ids.append(NULL_ID if doc_id is None else doc_id)

    def finish(self) -> None:
        ids = struct.pack(f"<{len(self.ids)}q", *self.ids)
        self.sink.write(struct.pack("<II", SKIPPABLE_IDS, len(ids)) + ids)
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)


class FrameReader:
    """Random access to a token file through its seek table."""

    def __init__(self, source):
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError("not a token file: its footer lacks the seek table's mark")
        table = size - 9 - 12 * n
        self.frames, where = [], 0
        for packed, plain, check in struct.iter_unpack("<III", self.at(table, 12 * n)):
            self.frames.append((where, packed, plain, check))
            where += packed
        self.doc_ids = struct.unpack(f"<{n}q", self.at(where + 8, 8 * n))

    def at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def content(self, k: int) -> bytes:
        start, packed, plain, check = self.frames[k]
        out = self.zstd.decompress(self.at(start, packed), max_output_size=plain)
        if len(out) != plain or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        return out


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def writer(folder: str, tokenizer_path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, try_ = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        encoder, out, tokens = WordEncoder.at(tokenizer_path), None, 0
        fs, root = filesystem(folder)
        name = f"{root}/tokens-{part:06d}.zst"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{name}.{try_}")
                out = FrameWriter(sink)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                out.add(doc_id, ids)
                tokens += len(ids) // 4
        if out is None:
            return
        out.finish()
        sink.close()
        fs.move(f"{name}.{try_}", name)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/tokens-{part:06d}.zst"], "docs": pa.array([len(out.ids)], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    return write


def write_tokens(df: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Writes the files; returns their manifest (part, file, docs, tokens), materialised."""
    keyed = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = dealt.mapInArrow(writer(folder, tokenizer_path), "part int, file string, docs long, tokens long")
    return written(manifest, "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as source:
                    reader, rows = FrameReader(source), []
                    for k, doc_id in enumerate(reader.doc_ids):
                        ids = reader.content(k)
                        rows.append((None if doc_id == NULL_ID else doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                    cols = list(zip(*rows, strict=True)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # the manifest has one row a file: its window is over files, not documents
    order = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("start"), "part")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartitionByRange(n, "part").select("file", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(df: DataFrame, tokenizer_path: str, folder: str | None = None, **columns) -> DataFrame:
    folder = folder or new_path(df.sparkSession, "tokens")
    return read_tokens(write_tokens(df, folder, tokenizer_path, **columns))
