"""Ruby facts: a line walk with a stack of open blocks."""

from __future__ import annotations

import re

from .lexing import Syntax, entity, facts, imported, mask

SYNTAX = Syntax(line=("#",), block=(("\n=begin", "\n=end"),), quotes=('"', "'"), long=("`",))
_CONST = r"(?:::)?[A-Z]\w*(?:::[A-Z]\w*)*"
_OPENS = re.compile(r"^(?:if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin)\b")
_CALLBACK = re.compile(r"^(?:before|after|around)_\w+\s|^validate\s")
_MIXINS = ("include", "extend", "prepend")
_ASSOCIATIONS = {"belongs_to": "one", "has_one": "one", "has_many": "many", "has_and_belongs_to_many": "many"}


class _Walk:
    def __init__(self, path: str, content: str):
        self.source = mask(content, SYNTAX)
        self.spec = "/spec/" in f"/{path}" or path.endswith("_spec.rb")
        self.found = facts()
        self.by: dict[str, dict] = {}
        self.stack: list[tuple[str, str]] = []
        self.callbacks: list[tuple[str, str]] = []

    def owner(self) -> str:
        return next((name for kind, name in reversed(self.stack) if kind in ("class", "module")), "")

    def add(self, name: str, kind: str, line: int, bases=()) -> dict:
        if name not in self.by:
            self.by[name] = entity(name, kind, line, (), (), bases)
            self.found["entities"].append(self.by[name])
        elif bases:
            self.by[name]["bases"] += [b for b in bases if b not in self.by[name]["bases"]]
        return self.by[name]

    def relate(self, target: str, relation: str, constant: str = "", source: str = "", entity_name: str = "") -> None:
        self.need(target, constant)
        row = {"target": target, "relation": relation, "source_entity": source or None, "target_entity": entity_name or None}
        if row not in self.found["relations"]:
            self.found["relations"].append(row)

    def need(self, target: str, constant: str = "") -> None:
        if target not in self.found["imports"]:
            self.found["imports"].append(target)
        row = imported(constant.rsplit("::", 1)[-1], constant, target)
        if constant and row not in self.found["imported_names"]:
            self.found["imported_names"].append(row)

    def constant(self, name: str, relation: str = "") -> None:
        name = name.removeprefix("::")
        if relation:
            self.relate(f"ruby-constant:{name}", relation, name)
        else:
            self.need(f"ruby-constant:{name}", name)

    def literal(self, text: str, offset: int, code: str) -> str | None:
        """Symbol or string at the start of arguments."""
        m = re.match(r"\s*:(\w+[?!]?)", text)
        if m:
            return m[1]
        m = re.match(r"\s*([\"'])", code)
        return self.source.string_at(offset + m.start(1)) if m else None

    def keyword(self, name: str, begin: int, end: int) -> str | None:
        m = re.search(rf"\b{name}:\s*(?::(\w+)|([\"']))", self.source.code[begin:end])
        if not m:
            return None
        return m[1] or self.source.string_at(begin + m.start(2))


def extract(path: str, content: str) -> dict:
    w = _Walk(path, content)
    offset = 0
    for number, raw in enumerate(w.source.code.split("\n"), 1):
        begin, offset = offset, offset + len(raw) + 1
        for at, part in _statements(raw):
            _statement(w, part, begin + at, number)
    for owner, method in w.callbacks:
        known = f"{owner}#{method}"
        w.relate(f"ruby-local-method:{method}", "callback", "", owner, known if known in w.by else "")
    w.found["exported_names"] = [e["name"] for e in w.found["entities"] if e["kind"] in ("class", "module")]
    w.found["extends"] = [b for e in w.found["entities"] for b in e["bases"]]
    w.found["has_validation"] = bool(re.search(r"^\s*validates?\b", content, re.M))
    return w.found


def _statements(raw: str):
    at = 0
    for part in raw.split(";"):
        text = part.strip()
        if text:
            yield at + part.index(text), text
        at += len(part) + 1


def _statement(w: _Walk, text: str, at: int, line: int) -> None:
    owner = w.owner()
    if m := re.match(rf"(class|module)\s+({_CONST})(?:\s*<\s*(?P<base>{_CONST}))?", text):
        name = m[2].removeprefix("::")
        full = f"{owner}::{name}" if owner and not m[2].startswith("::") else name
        bases = [m["base"].removeprefix("::")] if m["base"] else []
        w.add(full, m[1], line, bases)
        for base in bases:
            w.constant(m["base"])
        w.stack.append((m[1], full))
        if re.search(r"\bend$", text):
            w.stack.pop()
        return
    if re.match(r"class\s*<<\s*self", text):
        w.stack.append(("singleton", ""))
        return
    if m := re.match(r"(?:private\s+|protected\s+|public\s+|private_class_method\s+)?def\s+(self\.)?([\w]+[?!=]?)", text):
        if owner:
            single = bool(m[1]) or bool(w.stack and w.stack[-1][0] == "singleton")
            w.by[owner]["methods"].append(m[2])
            w.add(f"{owner}{'.' if single else '#'}{m[2]}", "function", line)
        elif not w.stack:
            w.add(m[2], "function", line)
        endless = re.match(r"[^=]*\)\s*=\s|def\s+[\w.]+\s*=\s", text[m.start() :])
        if not endless and not re.search(r"\bend$", text):
            w.stack.append(("def", ""))
        _uses(w, text[m.end() :], at + m.end())
        return
    if re.match(r"end\b", text):
        if w.stack:
            w.stack.pop()
        _uses(w, text[3:], at + 3)
        return
    declares = bool(owner) and w.stack[-1][0] in ("class", "module")
    if m := re.match(r"([A-Z]\w*)\s*=(?!=)", text):
        w.add(f"{owner}::{m[1]}" if owner else m[1], "type", line)
        _uses(w, text[m.end() :], at + m.end())
    elif m := re.match(r"(require_relative|require)\b\s*\(?", text):
        name = w.literal(text[m.end() :], at + m.end(), text[m.end() :])
        if name:
            w.need(f"ruby-{m[1].replace('_', '-')}:{name}")
    elif declares and (m := re.match(rf"({'|'.join(_MIXINS)})\s*\(?\s*({_CONST})", text)):
        for name in re.findall(_CONST, text[m.start(2) :]):
            w.constant(name, "concern")
            if name not in w.by[owner]["decorators"]:
                w.by[owner]["decorators"].append(name)
    elif declares and (m := re.match(rf"({'|'.join(_ASSOCIATIONS)})\s*\(?", text)):
        _association(w, m[1], text, at, m.end())
    elif declares and (m := _CALLBACK.match(text)):
        for name in re.findall(r"(?<![\w:]):(\w+[?!]?)(?!\s*=>)", text[m.end() - 1 :].split(" if:")[0]):
            w.callbacks.append((owner, name))
    else:
        _uses(w, text, at)
    if _OPENS.search(text) and not re.search(r"\bend$", text):
        w.stack.append(("block", ""))


def _association(w: _Walk, kind: str, text: str, at: int, begin: int) -> None:
    name = w.literal(text[begin:], at + begin, text[begin:])
    if not name or re.search(r"\bpolymorphic:\s*true", text):
        return
    explicit = w.keyword("class_name", at, at + len(text))
    source = w.keyword("source", at, at + len(text))
    if explicit:
        w.constant(explicit, "association")
    else:
        w.relate(f"ruby-association-{_ASSOCIATIONS[kind]}:{source or name}", "association")


def _uses(w: _Walk, text: str, at: int) -> None:
    """Constants in an expression; jobs and mailers by the call that enqueues them."""
    for m in re.finditer(rf"(?<![\w:]){_CONST}", text):
        rest = text[m.end() :]
        if re.match(r"\.(?:set\([^)]*\)\.)?perform_(?:later|async|in|at|now)\b", rest):
            w.constant(m[0], "job")
        elif re.match(r"\.\w+.*\.deliver_(?:later|now)\b", rest):
            w.constant(m[0], "mailer")
        else:
            w.constant(m[0], "spec" if w.spec else "")
