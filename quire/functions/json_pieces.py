"""Where the values of JSON texts begin and end: nested values as pieces of the text, found in one pass."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]|[^\s{}\[\],:"]+')


@dataclass
class Piece:
    """A value: its kind (``{``, ``[`` or empty for others), its place in the text, and what is inside, with keys in objects."""

    kind: str
    start: int
    end: int = 0
    inside: list[tuple[str | None, Piece]] = field(default_factory=list)


def parse(text: str) -> Piece:
    """The pieces of a JSON text, which must be valid."""
    top = Piece("[", 0)
    stack, key = [top], None
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token in "}]":
            stack.pop().end = m.end()
            continue
        of = stack[-1]
        if token[0] == '"' and of.kind == "{" and key is None:
            key = json.loads(token)
            continue
        piece = Piece(token if token in "{[" else "", m.start(), m.end())
        of.inside.append((key, piece))
        key = None
        if piece.kind:
            stack.append(piece)
    return top.inside[0][1]


def keys(text: str, max_depth: int | None = None) -> Iterator[tuple[str, str]]:
    """(dotted key, value as JSON) of every key of an object and of objects inside it, an object before its own keys."""
    todo = [("", parse(text), 0)]
    while todo:
        name, piece, depth = todo.pop()
        if depth:
            yield name, text[piece.start : piece.end]
        if piece.kind == "{" and (max_depth is None or depth < max_depth):
            todo += ((f"{name}.{k}" if depth else k, p, depth + 1) for k, p in reversed(piece.inside))


def blocks(text: str, top: str, below: tuple[str, ...]) -> Iterator[tuple[str, int, str]]:
    """(location, depth, block as JSON) of the items of the list *top* of a page, and of lists *below* in blocks, at any depth."""
    page = parse(text)
    todo = [("block", 0, p) for k, of in page.inside if k == top and of.kind == "[" for _, p in reversed(of.inside)]
    while todo:
        location, depth, piece = todo.pop()
        yield location, depth, text[piece.start : piece.end]
        if piece.kind == "{":
            todo += ((k, depth + 1, p) for k, of in piece.inside if k in below and of.kind == "[" for _, p in of.inside)
