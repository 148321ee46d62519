"""Pascal facts from a token walk; keywords and unit names ignore letter case."""

from __future__ import annotations

import re

from .lexing import Syntax, entity, facts, imported, mask, unique

SYNTAX = Syntax(block=(("(*", "*)"), ("{", "}")), quotes=("'",), doubled=True)
_TOKEN = re.compile(r"[A-Za-z_]\w*|'|[^\s\w]|\d+")
_ROUTINES = frozenset("procedure function constructor destructor operator".split())
_SECTIONS = frozenset("type const var threadvar resourcestring implementation initialization finalization begin uses procedure function".split())


class _Tokens:
    def __init__(self, code: str):
        self.all = [(m[0], m.start()) for m in _TOKEN.finditer(code)]
        self.low = [t.lower() for t, _ in self.all]

    def text(self, i: int) -> str:
        return self.all[i][0] if i < len(self.all) else ""

    def lower(self, i: int) -> str:
        return self.low[i] if i < len(self.low) else ""


def _dotted(t: _Tokens, i: int) -> tuple[str, int]:
    name, i = t.text(i), i + 1
    while t.text(i) == "." and re.match(r"[A-Za-z_]", t.text(i + 1) or " "):
        name, i = f"{name}.{t.text(i + 1)}", i + 2
    return name, i


def _imports(source, t: _Tokens, found: dict) -> None:
    for m in re.finditer(r"\{\$I(?:NCLUDE)?\s+'?([^'}\s]+)'?\s*\}", source.text, re.I):
        found["imports"].append(f"pascal-include:{m[1]}")
    i = 0
    while i < len(t.all):
        if t.lower(i) in ("uses", "contains", "requires") and t.lower(i - 1) != ".":
            i += 1
            while i < len(t.all) and t.text(i) != ";":
                name, i = _dotted(t, i)
                target = name
                if t.lower(i) == "in":
                    path = source.string_at(t.all[i + 1][1]) if i + 1 < len(t.all) else None
                    if path:
                        found["paths"].append({"unit": name, "path": path.replace("\\", "/")})
                    i += 2
                    while t.text(i) == "'":
                        i += 1
                found["imports"].append(target)
                found["imported_names"].append(imported(name.rsplit(".", 1)[-1], name, target))
                while t.text(i) == "'":
                    i += 1
                if t.text(i) == ",":
                    i += 1
                elif t.text(i) != ";":
                    break
        i += 1


def _until(t: _Tokens, i: int) -> int:
    """End of a type declaration: the semicolon outside brackets and record bodies."""
    depth = 0
    while i < len(t.all):
        word = t.lower(i)
        if word in ("(", "["):
            depth += 1
        elif word in (")", "]"):
            depth -= 1
        elif word == ";" and depth <= 0:
            return i
        i += 1
    return i


def _body_end(t: _Tokens, i: int) -> int:
    """Index of the ``end`` of a class, interface or record body."""
    depth = 1
    while i < len(t.all):
        word = t.lower(i)
        if word in ("record", "class", "object", "interface") and t.text(i - 1) in ("=", ":") and not (word == "class" and t.lower(i + 1) in ("of", "function", "procedure", ";")):
            depth += 1
        elif word == "case" and depth > 1:
            pass
        elif word == "end":
            depth -= 1
            if not depth:
                return i
        i += 1
    return i


def _methods(t: _Tokens, begin: int, end: int) -> list[str]:
    return unique(t.text(i + 1) for i in range(begin, end) if t.lower(i) in _ROUTINES and t.text(i - 1) not in ("=", ":") and t.lower(i - 1) not in ("to", "reference") and re.match(r"[A-Za-z_]", t.text(i + 1) or " "))


def _bases(t: _Tokens, i: int) -> tuple[list[str], int]:
    """Names in the parentheses at ``i``, outer names of generic bases only."""
    out, depth, i = [], 0, i + 1
    while i < len(t.all) and t.text(i) != ")":
        if t.text(i) == "<":
            depth += 1
        elif t.text(i) == ">":
            depth -= 1
        elif depth == 0 and re.match(r"[A-Za-z_]", t.text(i)) and t.lower(i) != "specialize":
            name, nxt = _dotted(t, i)
            out.append(name)
            i = nxt
            continue
        i += 1
    return out, i + 1


def _types(source, t: _Tokens, found: dict) -> None:
    by: dict[str, dict] = {}
    i, active = 0, False
    while i < len(t.all):
        word = t.lower(i)
        if word in _SECTIONS and t.text(i - 1) not in ("=", ":") and t.lower(i - 1) not in ("to", "of", "class"):
            active = word == "type"
            i += 1
            continue
        if not (active and re.match(r"[A-Za-z_]", t.text(i))):
            i += 1
            continue
        at = i
        if word == "generic":
            at = i = i + 1
        name, j = t.text(i), i + 1
        if t.text(j) == "<":
            while j < len(t.all) and t.text(j) != ">":
                j += 1
            j += 1
        if t.text(j) != "=":
            i += 1
            continue
        j += 1
        while t.lower(j) in ("packed", "bitpacked", "abstract", "sealed"):
            j += 1
        head, line = t.lower(j), source.line(t.all[at][1])
        kind, bases, methods = "type", [], []
        if head in ("class", "object", "interface", "dispinterface", "record", "objcclass") and not (head == "class" and t.lower(j + 1) == "of"):
            kind = {"class": "class", "object": "class", "objcclass": "class", "interface": "interface", "dispinterface": "interface"}.get(head, "type")
            j += 1
            while t.lower(j) in ("abstract", "sealed", "helper", "external"):
                j += 1
            if t.text(j) == "(":
                bases, j = _bases(t, j)
            if t.text(j) == ";":
                end = j
            else:
                stop = _body_end(t, j)
                methods = _methods(t, j, stop)
                end = _until(t, stop)
        else:
            end = _until(t, j)
        made = by.get(name.lower())
        if made is None:
            made = by[name.lower()] = entity(name, kind, line, methods, (), bases)
            found["entities"].append(made)
        else:
            made["methods"] = unique([*made["methods"], *methods])
            made["bases"] = unique([*made["bases"], *bases])
        if kind == "interface" and name not in found["exports_abstract"]:
            found["exports_abstract"].append(name)
        if kind == "class":
            interfaces = [b for b in bases if re.match(r"(?:\w+\.)*I[A-Z]", b)]
            found["implements"] += interfaces
            found["extends"] += [b for b in bases if b not in interfaces]
        i = end + 1


def _routines(source, t: _Tokens, found: dict, spans: list[tuple[int, int]]) -> None:
    seen = {e["name"].lower() for e in found["entities"]}
    for i, word in enumerate(t.low):
        if word in ("procedure", "function") and not any(a <= i <= b for a, b in spans) and t.text(i - 1) not in ("=", ":") and t.lower(i - 1) not in ("to", "class"):
            name = t.text(i + 1)
            if re.match(r"[A-Za-z_]", name or " ") and t.text(i + 2) not in (".", "<") and name.lower() not in seen:
                seen.add(name.lower())
                found["entities"].append(entity(name, "function", source.line(t.all[i][1])))


def extract(path: str, content: str) -> dict:
    source = mask(content, SYNTAX)
    t = _Tokens(source.code)
    found = facts(paths=[])
    _imports(source, t, found)
    _types(source, t, found)
    _routines(source, t, found, _type_spans(t))
    for base in unique([*found["extends"], *found["implements"]]):
        found["imported_names"].append(imported(base.rsplit(".", 1)[-1], base, f"pascal-type:{base}"))
    module = re.search(r"^\s*(?:unit|program|library|package)\s+([\w.]+)", source.code, re.I | re.M)
    found["declared"] = [module[1]] if module else []
    found["exported_names"] = [e["name"] for e in found["entities"]]
    return found


def _type_spans(t: _Tokens) -> list[tuple[int, int]]:
    """Token spans of class, interface and record bodies."""
    spans = []
    for i, word in enumerate(t.low):
        if word in ("class", "object", "interface", "record") and t.text(i - 1) == "=" and t.lower(i + 1) not in ("of", ";"):
            spans.append((i, _body_end(t, i + 1)))
    return spans
