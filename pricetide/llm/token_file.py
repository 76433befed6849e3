"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are dealt by ranges of doc_id and sorted, so partition k holds smaller ids than partition k + 1. Each task
writes three flat little-endian files through the shared folder: the token ids, in the narrowest unsigned type that
holds the vocabulary and the end id; 64-bit offsets of the documents within the file, one more than there are
documents; and the 64-bit doc_ids. A manifest row names them with their counts; exclusive prefix sums over the
manifest give the base of each partition. File names carry the attempt, and only a task that Spark counts gets into
the manifest, so lost executors and repeated tasks leave no trace in what is read.

Text is cut before spaces that follow another character than white space: a byte-level vocabulary has no token that
goes on from such a character into the space. A piece's ids are remembered; new pieces go to the tokenizers library.

Defined results: a null or empty text is the end id alone. Rows with one doc_id stand in the order of their texts;
rows with a null doc_id come first. Extra columns are ignored. No rows give no files.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import prepared, written
from .tokens import Pieces, Table, load

PIECES_KEPT = 600_000
# White space after which a space does not begin a piece.
_SPACES = [f"{chr(c)} " for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_CUT = re.compile(r"(?<=\S) ")

_coders: dict[int, Coder] = {}


class Coder:
    """Ids of whole texts under a tokenizer whose words begin with their space."""

    def __init__(self, definition: str, kind: np.dtype):
        self.tokenizer = load(definition)
        self.kind = kind
        self.pieces = Pieces(self.tokenizer)
        self.first = Table(self._flat, PIECES_KEPT // 4)
        self.after = Table(self._after, PIECES_KEPT)
        self.by_piece = self.pieces.library("a1 b  c\n d.") == [i for p in ("a1", " b", "  c\n d.") for i in self.pieces.library(p)]

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(self.kind.itemsize, "little") for i in ids])

    def _flat(self, piece: str) -> bytes:
        return self._pack(self.pieces.of(piece))

    def _after(self, piece: str) -> bytes:
        """Ids of a piece with the space before it."""
        if self.pieces.whole and not self.pieces.lower and (word := self.pieces.word.fullmatch(piece)):
            if marks := word[2]:
                return self.after[word[1]] + self.first[marks]
            return self._pack(self.pieces.of_pretoken(f" {piece}"))
        return self._flat(f" {piece}")

    def encode(self, text: str) -> bytes:
        if not self.by_piece:
            return np.array(self.pieces.library(text), self.kind).tobytes()
        if any(s in text for s in _SPACES):
            head, *rest = _CUT.split(text)
        else:
            head, *rest = text.split(" ")
        return b"".join([self.first[head], *map(self.after.__getitem__, rest)])


def width(size: int) -> np.dtype:
    """The narrowest little-endian unsigned type for ids below ``size``."""
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str) -> DataFrame:
    """Writes all texts to ``folder`` and returns the manifest: part, name, n_docs, n_tokens, width."""
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    shared = prepared(docs.sparkSession).sparkContext.broadcast(definition)
    kind = width(max(load(definition).get_vocab_size(), end_id + 1))
    key = hash((definition, kind.str))

    def write(batches):
        if key not in _coders:  # a worker keeps its memory from task to task
            _coders.clear()
            _coders[key] = Coder(shared.value, kind)
        coder = _coders[key]
        end = np.array([end_id], kind).tobytes()
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        store, base = _file_system(folder)
        store.create_dir(base, recursive=True)
        n_docs = n_tokens = 0
        outs = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if not outs:
                outs = {k: store.open_output_stream(f"{base}/{name}.{k}") for k in ("ids", "offsets", "docs")}
                outs["offsets"].write(np.zeros(1, "<u8").tobytes())
            coded = [coder.encode(t or "") + end for t in batch.column("text").to_pylist()]
            outs["ids"].write(b"".join(coded))
            ends = n_tokens + np.cumsum([len(c) // kind.itemsize for c in coded], dtype="<u8")
            outs["offsets"].write(ends.astype("<u8").tobytes())
            # A null doc_id is written as the least 64-bit value.
            outs["docs"].write(batch.column("doc_id").fill_null(-(1 << 63)).to_numpy().astype("<i8").tobytes())
            n_docs, n_tokens = n_docs + batch.num_rows, int(ends[-1])
        for out in outs.values():
            out.close()
        if n_docs:
            row = [[context.partitionId()], [name], [n_docs], [n_tokens], [kind.itemsize]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)],
                ["part", "name", "n_docs", "n_tokens", "width"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(write, "part int, name string, n_docs long, n_tokens long, width int"), "manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of each document in the files.

    Local files are memory-mapped, so a task holds the pages of one document at a time.
    """
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per written partition.
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))

    def read(batches):
        store, base = _file_system(folder)

        def load_file(name: str, kind: str):
            if isinstance(store, fs.LocalFileSystem):
                return np.memmap(f"{base}/{name}", np.dtype(kind), "r")
            with store.open_input_file(f"{base}/{name}") as file:
                return np.frombuffer(file.read_buffer(), np.dtype(kind))

        for batch in batches:
            for row in batch.to_pylist():
                ids = load_file(f"{row['name']}.ids", f"<u{row['width']}")
                offsets, doc_ids = load_file(f"{row['name']}.offsets", "<u8"), load_file(f"{row['name']}.docs", "<i8")
                for at in range(0, len(doc_ids), 256):
                    ends = offsets[at:at + 257].astype(np.int64)
                    own = doc_ids[at:at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, pa.int64(), mask=own == -(1 << 63)), pa.array(row["base"] + ends[:-1], pa.int64()),
                            pa.array(np.diff(ends), pa.int64()),
                            pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    # One task per file: the number is given, as the manifest alone looks small enough for one task.
    files = manifest.agg(F.max("part")).first()[0]
    parts = based.select("part", "name", "width", "base").repartitionByRange((files or 0) + 1, "part")
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op6_token_file(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Contract columns for every document, from the files."""
    folder = fresh_path(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, tokenizer_path, end_id, folder)
    return read_tokens(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
