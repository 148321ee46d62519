"""Masking of comments and strings, and bracket structure, for lexer-based extractors."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Syntax:
    """Comment and string forms of a language."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: tuple[str, ...] = ('"', "'")
    #: Quotes whose strings may span lines, and quotes in which a backslash is plain.
    long: tuple[str, ...] = ()
    raw: tuple[str, ...] = ()
    nested: bool = False
    doubled: bool = False


@dataclass
class Source:
    """Text, and ``code``: the same length with comments and string contents blanked."""

    text: str
    code: str
    strings: list[tuple[int, int]] = field(default_factory=list)
    _starts: list[int] = field(default_factory=list)

    def line(self, at: int) -> int:
        if not self._starts:
            self._starts.append(0)
            self._starts += [m.end() for m in re.finditer("\n", self.text)]
        return bisect_right(self._starts, at)

    def string_at(self, quote: int) -> str | None:
        """Contents of the string literal that opens at ``quote``."""
        for a, b in self.strings:
            if a == quote + 1:
                return self.text[a:b]
        return None

    def close(self, opening: int) -> int:
        """Index of the bracket that closes the one at ``opening``; the end of text if none."""
        pairs = {"{": "}", "(": ")", "[": "]"}
        left, right = self.code[opening], pairs[self.code[opening]]
        depth = 0
        for at in range(opening, len(self.code)):
            if self.code[at] == left:
                depth += 1
            elif self.code[at] == right:
                depth -= 1
                if not depth:
                    return at
        return len(self.code)


def mask(text: str, syntax: Syntax) -> Source:
    out, strings, at = list(text), [], 0

    def blank(a: int, b: int) -> None:
        for i in range(a, min(b, len(text))):
            if out[i] != "\n":
                out[i] = " "

    opening = sorted({*syntax.quotes, *syntax.long, *syntax.raw}, key=len, reverse=True)
    while at < len(text):
        if any(text.startswith(mark, at) for mark in syntax.line):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            blank(at, end)
            at = end
            continue
        pair = next((p for p in syntax.block if text.startswith(p[0], at)), None)
        if pair:
            depth, end = 1, at + len(pair[0])
            while end < len(text) and depth:
                if text.startswith(pair[1], end):
                    depth -= 1
                    end += len(pair[1])
                elif syntax.nested and text.startswith(pair[0], end):
                    depth += 1
                    end += len(pair[0])
                else:
                    end += 1
            blank(at, end)
            at = end
            continue
        quote = next((q for q in opening if text.startswith(q, at)), None)
        if quote:
            begin = end = at + len(quote)
            closed = False
            while end < len(text):
                if text[end] == "\\" and quote not in syntax.raw and not syntax.doubled:
                    end += 2
                elif text.startswith(quote, end):
                    if syntax.doubled and text.startswith(quote * 2, end):
                        end += 2 * len(quote)
                        continue
                    closed = True
                    break
                elif text[end] == "\n" and quote not in syntax.long:
                    break
                else:
                    end += 1
            if not closed and quote not in syntax.long:
                at = begin  # a stray quote
                continue
            strings.append((begin, min(end, len(text))))
            blank(begin, end)
            at = end + len(quote)
            continue
        at += 1
    return Source(text, "".join(out), strings)


def top_level(code: str) -> str:
    """``code`` with everything inside braces blanked, braces kept."""
    out, depth = [], 0
    for char in code:
        if char == "}":
            depth = max(depth - 1, 0)
        out.append(char if depth == 0 or char == "\n" else " ")
        if char == "{":
            depth += 1
    return "".join(out)


def split_top(text: str, separator: str = ",") -> list[str]:
    """Parts between separators that no bracket encloses."""
    parts, depth, begin = [], 0, 0
    for at, char in enumerate(text):
        if char in "([{<":
            depth += 1
        elif char in ")]}>":
            depth -= 1
        elif char == separator and depth <= 0:
            parts.append(text[begin:at])
            begin = at + 1
    return [p.strip() for p in (*parts, text[begin:]) if p.strip()]


def unique(values) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def entity(name: str, kind: str, line: int, methods=(), decorators=(), bases=()) -> dict:
    return {"name": name, "kind": kind, "line": line, "methods": list(methods), "decorators": list(decorators), "bases": list(bases)}


def imported(local: str, original: str, module: str) -> dict:
    return {"local": local, "original": original, "module": module}


def facts(**found) -> dict:
    base = {"imports": [], "exports_abstract": [], "implements": [], "extends": [], "has_validation": False, "entities": [], "imported_names": [], "exported_names": [], "relations": []}
    return base | found
