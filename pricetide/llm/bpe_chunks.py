"""BPE encoding and decoding by content-defined chunk reuse.

A text is cut where a rolling hash of its last 16 characters meets a fixed pattern, so equal passages of different
documents give equal chunks wherever they stand. A chunk's core, from its first to its last white space, is encoded
once per worker memory and looked up after that. Cuts also fall inside words, so each join (the tail of one chunk and
the head of the next) is repaired: it is encoded anew together with the neighbouring words, and the ids between them
count once the neighbours' own ids come out unchanged on both sides; otherwise the window takes in twice as many
words, in the end the whole text.

Cores that no memory holds are put together from words, and only new words go to the tokenizers library. Both
memories are bounded and belong to one worker: sharing over all workers would send every chunk through a shuffle,
which costs more disk than the encoding saves.

Defined results: a null text is empty and has no ids. Texts with a special token's string, with characters outside
``_PLAIN`` (those whose white space the library might read in another way), and all texts of a tokenizer that has a
decoder or keeps white space, are encoded and decoded by the library as they are. Repeated rows and ids are encoded
alike; extra columns are ignored but for those to be carried along.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import prepared, quoted
from .tokens import Pieces, Table, load

CHUNK_BITS = 11
WINDOW = 16
WORDS_KEPT = 150_000
CORES_KEPT = 3_000

Piece = tuple[int, str, str]  # number of ids, decimal ids joined by one space, decoded text

_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧]*")
_SPACE = " \t\n\r"
_HASHES = np.random.default_rng(9).integers(0, 1 << 63, 256, dtype=np.uint64)


def cuts(text: str) -> list[int]:
    """Ends of the chunks but the last: where the rolling hash of the last WINDOW characters starts with zeros."""
    h = _HASHES[np.frombuffer(text.encode("utf-32-le"), np.uint32) & np.uint32(255)]
    width = 1
    while width < WINDOW:  # doubles the span that each sum covers
        h[width:] = h[width:] + h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width)
        width *= 2
    return (np.flatnonzero((h >> np.uint64(64 - CHUNK_BITS)) == 0) + 1).tolist()


def split(text: str) -> list[tuple[str, bool]]:
    """Cores (True) and joins (False) in order; put together they are the text. Joins hold no white space."""
    out, carry = [], ""
    for start, end in pairwise(dict.fromkeys([0, *cuts(text), len(text)])):
        chunk = text[start:end]
        spaces = [i for i in map(chunk.find, _SPACE) if i >= 0]
        if not spaces and end < len(text):
            carry += chunk
            continue
        first = 0 if not start else min(spaces, default=len(chunk))
        last = len(chunk) if end == len(text) else max(map(chunk.rfind, _SPACE)) + 1
        if carry or first:
            out.append((carry + chunk[:first], False))
        if first < last:
            out.append((chunk[first:last], True))
        carry = chunk[max(first, last):]
    return out + ([(carry, False)] if carry else [])


def together(pieces: list[Piece]) -> Piece:
    full = [p for p in pieces if p[0]]
    return sum([p[0] for p in full]), " ".join([p[1] for p in full]), " ".join([p[2] for p in full])


class Coder:
    """One tokenizer with its memories of words and chunk cores."""

    def __init__(self, definition: str):
        self.tokenizer = load(definition)
        self.pieces = Pieces(self.tokenizer)
        self.specials = self.pieces.specials
        self.token = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.digits = list(map(str, range(len(self.token))))
        probe = self.tokenizer.encode_batch_fast(["a", " a \n"], add_special_tokens=False)
        # Without a decoder the library joins tokens by one space.
        self.by_word = self.tokenizer.decoder is None and probe[0].ids == probe[1].ids
        self.words = Table(self._of_word, WORDS_KEPT)
        self.cores = Table(self._of_words, CORES_KEPT)

    def library(self, texts: list[str]) -> list[Piece]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        decoded = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [(len(i), " ".join(map(str, i)), d) for i, d in zip(ids, decoded, strict=True)]

    def _piece(self, ids: list[int]) -> Piece:
        """The piece of some ids of a tokenizer that decodes by joining tokens."""
        return len(ids), " ".join([self.digits[i] for i in ids]), " ".join([self.token[i] for i in ids])

    def _of_word(self, text: str) -> Piece:
        if self.pieces.whole and (word := self.pieces.word.fullmatch(text)):
            if marks := word[2]:
                return together([self.words[word[1]], self.words[marks]])
            return self._piece(self.pieces.of_pretoken(text))
        return self._piece(self.pieces.of(text))

    def _of_words(self, part: str) -> Piece:
        return together(list(map(self.words.__getitem__, part.split())))

    def _repair(self, joins: list[tuple[str, int, int]]) -> list[Piece | None]:
        """The pieces of joins (text, start, end); None where only the whole text agrees with itself."""
        out: list[Piece | None] = [None] * len(joins)
        missing, wide = list(range(len(joins))), 1
        while missing:
            windows = []
            for text, start, end in map(joins.__getitem__, missing):
                span = 64 * wide
                left, right = text[max(0, start - span):start].split(), text[end:end + span].split()
                # A word that the slice may have cut is left out.
                left = (left[1:] if start > span else left)[-wide:]
                right = (right[:-1] if end + span < len(text) else right)[:wide]
                windows.append((left, text[start:end], right))
            coded = self.tokenizer.encode_batch_fast([" ".join([*a, j, *b]) for a, j, b in windows], add_special_tokens=False)
            for i, (a, _, b), found in zip(missing, windows, coded, strict=True):
                ids = found.ids
                left, right = (together([self.words[w] for w in side]) for side in (a, b))
                middle = self._piece(ids[left[0]:len(ids) - right[0]])
                if together([left, middle, right])[1] == self._piece(ids)[1]:
                    out[i] = middle
            missing = [i for i in missing if out[i] is None and wide <= len(joins[i][0])]
            wide *= 2
        return out

    def encode(self, texts: list[str]) -> list[Piece]:
        """The piece of each text, equal to the library's."""
        plain = [i for i, t in enumerate(texts) if self.by_word and _PLAIN.fullmatch(t) and not any(s in t for s in self.specials)]
        whole = sorted(set(range(len(texts))) - set(plain))
        out = dict(zip(whole, self.library([texts[i] for i in whole]), strict=True))
        parts = {i: split(texts[i]) for i in plain}
        joins = []
        for i, own in parts.items():
            ends = np.cumsum([0, *(len(p) for p, _ in own)]).tolist()
            joins += [(texts[i], a, b) for (a, b), (_, core) in zip(pairwise(ends), own, strict=True) if not core]
        mended = iter(self._repair(joins))
        for i, own in parts.items():
            pieces = [self.cores[part] if core else next(mended) for part, core in own]
            out[i] = self.library([texts[i]])[0] if None in pieces else together(pieces)
        return [out[i] for i in range(len(texts))]


_coders: dict[int, Coder] = {}


def encoded(docs: DataFrame, tokenizer_path: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space) and decoded text of every row, and the columns ``carried``.

    The tokenizer's definition is read on the driver and broadcast; its size is that of its vocabulary.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    shared = prepared(docs.sparkSession).sparkContext.broadcast(definition)
    key = hash(definition)

    def code(batches):
        if key not in _coders:  # a worker keeps its memories from task to task
            _coders.clear()
            _coders[key] = Coder(shared.value)
        coder = _coders[key]
        for batch in batches:
            pieces = coder.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([p[0] for p in pieces], pa.int64()),
                    pa.array([p[1] for p in pieces], pa.string()), pa.array([p[2] for p in pieces], pa.string()),
                    *[batch.column(c) for c in carried],
                ],
                ["doc_id", "n_tokens", "ids", "decoded", *carried],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[quoted(c) for c in carried])
    made = StructType().add("doc_id", "long").add("n_tokens", "long").add("ids", "string").add("decoded", "string")
    return rows.mapInArrow(code, StructType([*made.fields, *[rows.schema[c] for c in carried]]))


def op9_bpe_chunks(docs: DataFrame, tokenizer_path: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """Contract columns for every document, and the columns ``carried``."""
    return encoded(docs, tokenizer_path, carried).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        *[quoted(c) for c in carried],
    )
