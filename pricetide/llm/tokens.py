"""Ids of short pieces under a tokenizers definition, remembered in bounded tables."""

from __future__ import annotations

import os
import re

from tokenizers import Tokenizer

PRETOKENS_KEPT = 50_000

# Letters and marks on whose classes Python, the library's patterns and its lower-casing agree.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_MARKS = r"!-&(-/:-@\[-`{-~"
# Ways a definition may cut a piece into pre-tokens: a pre-token, and whether it is lower-cased.
_SCHEMES = [
    (f" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n(?=[{_LETTERS}0-9{_MARKS}])", False),
    (f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+", True),
]
_PROBE = [
    "a", " a", "Word", " Word", "éÈçñ", "naïve,", " x12.34!?", "abc###", "12", "A1b2", "***", " (see", "end.\"", "ÀÖØöøɏ", "a-b_c", " $5,00", "ǅ", "ß",
    "thorreou", "Ölçek!", "http://a.b/c?d=e&f", "UPPER", "x=y", "0.5%", "~^`|", "q" * 40, "a.\nB", "a\n\nb",
]


def load(definition: str) -> Tokenizer:
    """A tokenizer without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Table(dict):
    """Values made on first use, kept in two generations: what is used again moves to the younger one, and the older
    one is dropped when the younger is full."""

    def __init__(self, make, kept: int):
        super().__init__()
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_letters()


class Pieces:
    """Ids of a piece that stands alone.

    Pieces of plain letters, digits and marks are cut into pre-tokens here and given to the library's model one by
    one, which is several times as fast as its whole chain; all other pieces go through the whole chain. The way of
    cutting is used only if it gives the library's ids for a list of probes.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.pretokens = Table(self.of_pretoken, PRETOKENS_KEPT)
        self.cut = self.whole = None
        # Most pieces: a word and marks behind it.
        self.word = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)")
        for pattern, lower in _SCHEMES:
            self.cut, self.whole, self.lower = re.compile(pattern), re.compile(f"[ \n{_LETTERS}0-9{_MARKS}]+"), lower
            self.pretokens.clear()
            if all(self.of(p) == self.library(p) for p in _PROBE):
                break
        else:
            self.whole = None

    def library(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def of_pretoken(self, pretoken: str) -> list[int]:
        if self.lower:
            pretoken = pretoken.lower()
        return [t.id for t in self.model.tokenize(pretoken.encode().decode("latin-1").translate(_BYTES))]

    def of(self, piece: str) -> list[int]:
        if self.whole and self.whole.fullmatch(piece):
            parts = self.cut.findall(piece)
            # Spaces that belong to no pre-token, and special tokens, are the library's.
            if sum(map(len, parts)) == len(piece) and not any(s in piece for s in self.specials):
                return [i for p in parts for i in self.pretokens[p]]
        return self.library(piece)
