"""Ids of whole texts from a tokenizer file, with the work of repeated words shared.

The tokenizers used here split a text at white space before they merge anything, so the ids of a
text are those of its pieces, one after the other. Pieces seen before are looked up. New ones are
cut by the file's own pre-token pattern and each part goes to the library's BPE model once.
Whatever could be normalised in another way than here goes through the library whole: texts with a
special token's string or with separators that only Python counts as white space, and pieces with
characters beyond Latin letters.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager

# GPT-style pre-tokenisers keep one space before a word and the rest of the white space apart.
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
ODD = re.compile("[\x1c-\x1f]")
FIRST = "\x1c"
PLAIN = re.compile("[\x00-ɏ]*").fullmatch
# The pattern that byte-level files use when they name none (a fixed value of the format).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN_PIECES = 1_000_000
KNOWN_LENGTH = 48


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable ones as themselves, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def spaced_pieces(text: str) -> list[str]:
    """Words, each with the one separator before it; longer white space as its own pieces."""
    if not text or text.replace("\n", " ").split(" ") != text.split():  # not single separators everywhere
        return [p[1:] if p[0] == " " and not p.isspace() else FIRST + p for p in SPACED.findall(text)]
    first, *rest = text.replace("\n", " \n").split(" ")
    return [FIRST + first, *rest]


def spelled(piece: str) -> str:
    """What a piece of ``spaced_pieces`` stands for: most have lost the space before them."""
    return piece[1:] if piece[0] == FIRST else piece if piece[0] == "\n" else " " + piece


class Encoder:
    """``ids(texts)`` gives little-endian unsigned 32-bit ids of each text as bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            says = json.load(f)
        steps = says["pre_tokenizer"].get("pretokenizers", [says["pre_tokenizer"]])
        own = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        self.folds = "Lowercase" in json.dumps(says["normalizer"])
        self.spaced = own is None
        self.parts = regex.compile(own or BYTE_LEVEL).findall
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        special = [t["content"] for t in says["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.asarray(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merged(self, part: str) -> bytes:
        written = part.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(written)])

    def _part(self, part: str) -> bytes:
        ids = self.known_parts.get(part)
        if ids is None:
            ids = self._merged(part)
            if len(part) <= KNOWN_LENGTH:
                self.known_parts[part] = ids
        return ids

    def _kept(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            ids = self._piece(piece)
            if len(piece) <= KNOWN_LENGTH:
                self.known[piece] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        text = spelled(piece) if self.spaced else piece
        if not PLAIN(text):
            return self._library([text])[0]
        if self.folds:
            text = unicodedata.normalize("NFC", text).lower()
        word = text[1:] if text[0] == " " else text
        if word.isalpha():
            return self._merged(text)
        if word[-1:] in (".", ",") and word[:-1].isalpha():  # the word is kept as the piece it is elsewhere
            return self._kept(piece[:-1]) + self._part(text[-1])
        return b"".join(map(self._part, self.parts(text)))

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if ODD.search(text) or (self.special and self.special.search(text)):
                out.append(self._library([text])[0])
                continue
            pieces = spaced_pieces(text) if self.spaced else text.split()
            try:
                out.append(b"".join(map(self.known.__getitem__, pieces)))
            except KeyError:
                out.append(self._mixed(pieces))
        return out

    def _mixed(self, pieces: list[str]) -> bytes:
        if len(self.known) + len(self.known_parts) > KNOWN_PIECES:
            self.forget()
        known, kept = self.known.get, self._kept
        return b"".join([known(p) or kept(p) for p in pieces])

    def forget(self) -> None:
        self.known, self.known_parts = {}, {}


_ENCODERS: dict[str, Encoder] = {}


@contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """One encoder per worker process. Pieces are known for a task: workers live on for other work."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    try:
        yield _ENCODERS[path]
    finally:
        _ENCODERS[path].forget()
