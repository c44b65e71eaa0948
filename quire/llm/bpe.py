"""Encoding with a byte-level BPE tokenizer through worker caches.

The library encodes each pre-token by itself.  A blank before a visible
character always begins a pre-token, and so do a mark after a letter or digit
and a line's end after a visible character.  A text may thus be cut there and
the pieces' ids looked up, so that a word is held once, whatever follows it; the
library encodes what the cache lacks.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers

from quire.llm.common import of_worker

TOKENIZER = "byte_bpe_50k.json"
#: Entries of each half of a worker's caches, of chunks between blanks and of
#: other pre-tokens; a full young half becomes the old one, from which entries
#: that are used again come back.
CACHE_ENTRIES = 350_000
PRETOKEN_ENTRIES = 80_000

_CUT = re.compile(r" (?=\S)")
#: Begins a chunk that follows no blank, in place of that blank.
JOINED = "\0"
_JOINING = rf" {JOINED}\g<0>"
#: A mark after a letter or digit, and a line's end after a visible character.
_ENDS = re.compile("[!-/:-@\\[-`{-~\n](?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ][!-~]|[!-~À-ÖØ-öø-ÿ]\n)").sub
#: The library's pre-tokens, where text has only characters for which Python's
#: classes and Unicode's are the same.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
_PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


class _Uncuttable(Exception):
    """A blank that is not followed by a visible character."""


class _Halves(dict):
    """A cache of f(key) in two halves of *entries*."""

    def __init__(self, f: Callable[[str], bytes], entries: int):
        self.f, self.entries, self.old = f, entries, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.f(key)
        if len(self) >= self.entries:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


class Encoder:
    """``encode(text)`` gives what the library's ``encode`` does without added special tokens."""

    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuttable = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model, self.pre = self.library.model, self.library.pre_tokenizer
        self.known = _Halves(self._pretoken, PRETOKEN_ENTRIES).__getitem__
        self.lookup = _Halves(self._chunk, CACHE_ENTRIES).__getitem__
        self.letters = _byte_letters()
        self.blank = self.letters[ord(" ")]

    def _ids(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _pretoken(self, piece: str) -> bytes:
        return self._ids(piece.encode("utf-8").decode("latin-1").translate(self.letters))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that follows a blank, or of what follows JOINED; letters are a pre-token."""
        if chunk.isalpha():
            return self._ids(chr(self.blank) + chunk) if chunk.isascii() else self._pretoken(" " + chunk)
        if not chunk or chunk[0].isspace():
            raise _Uncuttable
        return self.pretokens(chunk[1:] if chunk[0] == JOINED else " " + chunk)

    def pretokens(self, text: str) -> bytes:
        if _PLAIN(text):
            return b"".join(map(self.known, _PRETOKENS(text)))
        return b"".join(self.known(text[a:b]) for _, (a, b) in self.pre.pre_tokenize_str(text))

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as bytes of ``dtype``; a null text is empty."""
        if not text:
            return b""
        if not self.cuttable or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if JOINED in text:
            return self.pretokens(text)
        text = _ENDS(_JOINING, text)
        first, *rest = text.split(" ")
        try:
            return self.pretokens(first) + b"".join(map(self.lookup, rest))
        except _Uncuttable:
            first, *rest = _CUT.split(text)
            return self.pretokens(first) + b"".join(map(self.lookup, rest))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), self.dtype)


def _byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in such vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(printable))
    return {b: b for b in printable} | {b: 256 + n for n, b in enumerate(rest)}


def encoder(name: str = TOKENIZER) -> Encoder:
    """This process's encoder; its caches outlive tasks."""
    return of_worker(("bpe", name), lambda: Encoder(name))
