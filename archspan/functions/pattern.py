"""Safe search patterns, compiled to SQL LIKE.

The grammar has literals, ``.*``, ``^`` at the start, ``$`` at the end and backslash
escapes; a dot alone is a literal. Every other operator is refused, so a user's
pattern never runs as a regular expression. Case is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PATTERN = 256
MAX_DEPTH = 50
_REFUSED = frozenset("[](){}+?|*")
ESCAPE = "!"


class QueryError(ValueError):
    """A request that cannot be answered; ``kind`` names the reason."""

    def __init__(self, kind: str, text: str):
        super().__init__(f"{kind}: {text}")
        self.kind, self.text = kind, text


def _quoted(literal: str) -> str:
    return "".join(ESCAPE + c if c in "%_" + ESCAPE else c for c in literal.lower())


def to_like(raw: str) -> str:
    """LIKE pattern (escape character ``!``) over lower-cased values."""
    if len(raw) > MAX_PATTERN:
        raise QueryError("invalid-pattern", f"pattern exceeds {MAX_PATTERN} characters")
    head = raw.startswith("^")
    slashes = len(raw) - len(raw.rstrip("\\"))
    tail = raw.endswith("$") and slashes % 2 == 0
    body = raw[int(head) : len(raw) - int(tail)]
    out, at = "" if head else "%", 0
    while at < len(body):
        char, following = body[at], body[at + 1 : at + 2]
        if char == "\\":
            if not following:
                raise QueryError("invalid-pattern", "pattern ends with an incomplete escape")
            out, at = out + _quoted(following), at + 2
        elif char == "." and following == "*":
            out, at = out + "%", at + 2
        elif char in _REFUSED:
            raise QueryError("invalid-pattern", f"unsupported pattern operator: {char}")
        elif char in "^$":
            raise QueryError("invalid-pattern", f"{char} is only supported at the pattern boundary")
        else:
            out, at = out + _quoted(char), at + 1
    return out if tail else out + "%"


def matches(value: Column, raw: str) -> Column:
    return F.like(F.lower(value), F.lit(to_like(raw)), F.lit(ESCAPE))


def depth_of(raw: str | int) -> int:
    try:
        depth = int(raw)
    except ValueError:
        raise QueryError("invalid-depth", f"depth must be an integer: {raw}") from None
    if not 0 <= depth <= MAX_DEPTH:
        raise QueryError("invalid-depth", f"depth must be between 0 and {MAX_DEPTH}: {raw}")
    return depth
