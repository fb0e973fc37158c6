"""Aggregates taken apart into pieces that can be added up from period to period."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: How the values of a piece merge.
MERGES = {"sum": "sum", "count": "sum", "min": "min", "max": "max"}
#: What may stand around pieces: words of SQL that are no aggregates.
PLAIN = frozenset("cast case when then else end and or not is null nullif coalesce round abs as double decimal bigint int float date string if greatest least true false in between try_divide".split())
_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|\s+|.", re.DOTALL)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Piece:
    """One aggregate: its function, what stands in its brackets, and its predicate."""

    function: str
    argument: str
    where: str | None = None

    @property
    def distinct(self) -> bool:
        return self.argument.lower().startswith("distinct")

    @property
    def key(self) -> str:
        """What a distinct count counts."""
        return self.argument[len("distinct") :].strip()

    @property
    def text(self) -> str:
        return f"{self.function}({self.argument})" + (f" FILTER (WHERE {self.where})" if self.where else "")


def _bracket(tokens: list[str], at: int) -> int:
    """The place of the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i] == "(") - (tokens[i] == ")")
        if not depth:
            return i
    raise ValueError("a bracket is left open")


def _next(tokens: list[str], at: int) -> int:
    while at < len(tokens) and tokens[at].isspace():
        at += 1
    return at


def taken_apart(text: str, prefix: str) -> tuple[str, list[Piece]] | None:
    """(the expression with the names prefix0, prefix1 ... in place of its aggregates, these); None if some do not add up.

    Distinct counts of one expression are pieces too: a key counts in the first
    period that has it.
    """
    tokens, out, pieces, i = _TOKEN.findall(text), [], [], 0
    while i < len(tokens):
        word = tokens[i].lower()
        if not _NAME.fullmatch(tokens[i]) or word in PLAIN:
            out.append(tokens[i])
            i += 1
            continue
        start = _next(tokens, i + 1)
        if word not in MERGES or start >= len(tokens) or tokens[start] != "(":
            return None  # another function, or a column outside of an aggregate
        end = _bracket(tokens, start)
        argument, where, i = "".join(tokens[start + 1 : end]).strip(), None, end + 1
        after = _next(tokens, i)
        if after < len(tokens) and tokens[after].lower() == "filter":
            start = _next(tokens, after + 1)
            end = _bracket(tokens, start)
            inner = "".join(tokens[start + 1 : end]).strip()
            where, i = re.sub(r"^where\b", "", inner, flags=re.IGNORECASE).strip(), end + 1
        piece = Piece(word, argument, where)
        if piece.distinct and (word != "count" or "," in piece.key):
            return None
        if piece not in pieces:
            pieces.append(piece)
        out.append(f"{prefix}{pieces.index(piece)}")
    return "".join(out), pieces
