"""The index's query syntax, read into a tree of nodes.

    login user            either word                 "login user"     the words in a row
    a AND b OR c          AND binds more              NOT a, -a, +a    must not, must
    (a OR b) c            groups                      body:a           a field
    a^2.5                 a weight                    *                every file
    [a TO c] {a TO c}     words in a range, with or without its ends; * for an open end

A word that the tokeniser cuts in several ("login_user") stands for its pieces in a row. Anything else is a QueryError.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import regex

FIELDS = ("body",)
_PIECES = regex.compile(r'\s+|"(?:[^"\\]|\\.)*"|[()\[\]{}^:+*-]|(?:[^\s"()\[\]{}^:\\+-]|\\.|(?<=\w)[+-])(?:[^\s"()\[\]{}^:\\]|\\.)*')


class QueryError(ValueError):
    """A query that has no meaning."""


@dataclass(frozen=True)
class Node:
    """kind: words (one or several in a row, with their places), range, all, or group of (must, should, not) parts."""

    kind: str
    words: tuple[tuple[int, str], ...] = ()
    parts: tuple[tuple[str, Node], ...] = ()
    bounds: tuple[tuple[str, bool] | None, tuple[str, bool] | None] = (None, None)
    weight: float = 1.0

    def leaves(self) -> list[Node]:
        return [self] if self.kind != "group" else [x for _, p in self.parts for x in p.leaves()]


@dataclass
class _Reader:
    pieces: list[str]
    tokenise: Callable[[str], list[tuple[int, str]]]
    at: int = 0
    depth: int = field(default=0)

    def peek(self) -> str:
        """The next piece that is not blank; nothing at the end."""
        rest = (p for p in self.pieces[self.at :] if not p.isspace())
        return next(rest, "")

    def take(self) -> str:
        while self.at < len(self.pieces) and self.pieces[self.at].isspace():
            self.at += 1
        self.at += 1
        return self.pieces[self.at - 1] if self.at <= len(self.pieces) else ""

    def touches(self, piece: str) -> bool:
        """Whether a piece follows at once, with no blank between."""
        return self.at < len(self.pieces) and self.pieces[self.at] == piece

    def expect(self, *pieces: str) -> str:
        found = self.take()
        if found not in pieces:
            raise QueryError(f"{' or '.join(pieces)} expected, not {found or 'the end'}")
        return found

    def either(self) -> Node:
        """Parts in a row or with OR between them; each is an AND chain or a part with a sign."""
        parts: list[tuple[str, Node]] = []
        while self.peek() not in ("", ")"):
            if self.peek() in ("OR", "AND"):
                raise QueryError(f"nothing before {self.peek()}")
            chain = [self.signed()]
            while self.peek() == "AND":
                self.take()
                chain.append(self.signed())
            parts.append(chain[0] if len(chain) == 1 else ("should", _group([("must" if s == "should" else s, n) for s, n in chain])))
            if self.peek() == "OR":
                self.take()
                if self.peek() in ("", ")"):
                    raise QueryError("nothing after OR")
        if not parts:
            raise QueryError("an empty group")
        return _group(parts)

    def signed(self) -> tuple[str, Node]:
        sign = self.peek()
        if sign in ("+", "-", "NOT"):
            self.take()
            return ("must" if sign == "+" else "not"), self.weighted()
        return "should", self.weighted()

    def weighted(self) -> Node:
        node = self.plain()
        if self.touches("^"):
            self.take()
            try:
                node = replace(node, weight=node.weight * float(self.take()))
            except ValueError as e:
                raise QueryError("a weight is a number") from e
        return node

    def plain(self) -> Node:
        piece = self.take()
        if piece == "(":
            self.depth += 1
            if self.depth > 50:
                raise QueryError("groups are too deep")
            node = self.either()
            self.expect(")")
            self.depth -= 1
            return node
        if piece in ("[", "{"):
            return self.range(piece == "[")
        if piece == "*":
            return Node("all")
        if not piece or piece in ("AND", "OR", "NOT") or piece in ")]}^:+-":
            raise QueryError(f"a word expected, not {piece or 'the end'}")
        if self.touches(":"):
            if piece not in FIELDS:
                raise QueryError(f"no field {piece}")
            self.take()
            return self.plain()
        text = piece[1:-1] if piece[0] == '"' else piece
        words = self.tokenise(regex.sub(r"\\(.)", r"\1", text))
        return Node("words", words=tuple(words))

    def range(self, first_in: bool) -> Node:
        low = self.take()
        self.expect("TO")
        high = self.take()
        last_in = self.expect("]", "}") == "]"
        if "" in (low, high):
            raise QueryError("a range without its ends")
        ends = [None if x == "*" else (x.lower(), inside) for x, inside in ((low, first_in), (high, last_in))]
        return Node("range", bounds=(ends[0], ends[1]))


def _group(parts: list[tuple[str, Node]]) -> Node:
    return parts[0][1] if len(parts) == 1 and parts[0][0] != "not" else Node("group", parts=tuple(parts))


def parse(query: str, tokenise: Callable[[str], list[tuple[int, str]]]) -> Node | None:
    """The query's tree; None for a blank one. tokenise: the (place, word) pairs of a text, as the index holds them."""
    if not query.strip():
        return None
    pieces, at = [], 0
    while at < len(query):
        m = _PIECES.match(query, at)
        if not m:
            raise QueryError(f"cannot read {query[at:at + 20]!r}")
        pieces.append(m[0])
        at = m.end()
    reader = _Reader(pieces, tokenise)
    node = reader.either()
    if reader.peek():
        raise QueryError(f"{reader.peek()} without its beginning")
    if not _finds(node):
        raise QueryError("a query that only excludes")
    return node


def _finds(node: Node) -> bool:
    """Whether a node can match by what it asks for, not only by what it excludes."""
    return node.kind != "group" or all(_finds(p) for s, p in node.parts if s != "not") and any(s != "not" for s, _ in node.parts)
