"""TypeScript and TSX facts from masked source."""

from __future__ import annotations

import re

from .lexing import Source, Syntax, entity, facts, imported, mask, split_top, top_level, unique

SYNTAX = Syntax(quotes=('"', "'"), long=("`",))
#: Decorators whose classes get their dependencies through the constructor (fixed values).
INJECTED = frozenset({"Injectable", "Controller", "Module", "Guard", "Interceptor", "Pipe", "Resolver"})
_NOT_METHODS = frozenset({"constructor", "if", "for", "while", "switch", "return", "catch", "function", "super", "await", "new", "throw", "typeof"})
_FROM = re.compile(r"""\b(?:import|export)\b(?P<what>[^;"'`]*?)\bfrom\s*(?P<q>["'])""")
_BARE = re.compile(r"""\bimport\s*(?P<q>["'])""")
_CALL = re.compile(r"""(?<![\w.$])(?:import|require)\s*\(\s*(?P<q>["'`])""")
_DECLARED = re.compile(
    r"(?P<lead>(?:@[\w$.]+\s*(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*)*)(?:\b(?:export|default|declare|async)\s+)*(?P<abstract>abstract\s+)?"
    r"\b(?P<kind>class|interface|type|enum|const\s+enum|function\*?|const|let)\s+(?P<name>[A-Za-z_$][\w$]*)"
)
_MEMBER = re.compile(r"(?:^|[;{}\n,])\s*(?:@[\w$.]+(?:\([^()]*\))?\s*)*(?:(?:public|private|protected|static|async|readonly|override|abstract|declare|get|set)\s+)*(?:\*\s*)?#?(?P<name>[A-Za-z_$][\w$]*)\s*[?!]?\s*(?P<next>[(<:=;])")


def _specifiers(source: Source) -> list[str]:
    found = []
    for pattern in (_FROM, _BARE, _CALL):
        for m in pattern.finditer(source.code):
            value = source.string_at(m.start("q"))
            if value and "${" not in value:
                found.append((m.start(), value))
    return unique(v for _, v in sorted(found))


def _imported(source: Source) -> list[dict]:
    out = []
    for m in _FROM.finditer(source.code):
        if not source.code[m.start() :].startswith("import"):
            continue
        module, what = source.string_at(m.start("q")), re.sub(r"^\s*type\b(?!\s*,|\s*from)", "", m["what"])
        if module is None:
            continue
        inner = re.search(r"\{(.*?)\}", what, re.S)
        for part in split_top(inner[1]) if inner else []:
            words = re.sub(r"^type\s+", "", part).split()
            out.append(imported(words[-1], words[0], module))
        rest = re.sub(r"\{.*?\}", "", what, flags=re.S)
        for part in split_top(rest):
            star = re.fullmatch(r"\*\s+as\s+([\w$]+)", part)
            if star:
                out.append(imported(star[1], "*", module))
            elif re.fullmatch(r"[\w$]+", part):
                out.append(imported(part, "default", module))
    return out


def _names(clause: str | None) -> list[str]:
    return [n for n in (re.sub(r"<.*", "", p, flags=re.S).strip().split(".")[-1] for p in split_top(clause or "")) if re.fullmatch(r"[\w$]+", n)]


def _methods(source: Source, opening: int) -> list[str]:
    body = top_level(source.code[opening + 1 : source.close(opening)])
    flat, depth = [], 0
    for char in body:  # parameter lists hold no members
        if char in ")]":
            depth -= 1
        flat.append(char if depth <= 0 or char == "\n" else " ")
        if char in "([":
            depth += 1
    return [m["name"] for m in _MEMBER.finditer("\n" + "".join(flat)) if m["name"] not in _NOT_METHODS]


def _constructor_types(source: Source, opening: int) -> list[str]:
    end = source.close(opening)
    begin = re.compile(r"\bconstructor\s*\(").search(source.code, opening, end)
    if not begin:
        return []
    close = source.close(begin.end() - 1)
    out = []
    for m in re.finditer(r"@Inject\s*\(\s*(?:(?P<q>[\"'`])|(?P<n>[\w$]+))|:\s*(?P<t>[A-Za-z_$][\w$]*)", source.code[begin.end() : close]):
        token = m["n"] or m["t"] or (source.string_at(begin.end() + m.start("q")) if m["q"] else None)
        if token and token[0].isupper():
            out.append(token)
    return out


def extract(path: str, content: str) -> dict:
    source = mask(content, SYNTAX)
    found = facts(imports=_specifiers(source), imported_names=_imported(source), has_validation=bool(re.search(r"\.safeParse|\.parse\(|zod\.|z\.|Joi\.|yup\.|ajv|validateSchema", content[:4096])))
    flat = top_level(source.code)
    for m in _DECLARED.finditer(flat):
        kind, name = m["kind"].split()[-1].rstrip("*"), m["name"]
        before = flat[: m.start()].rstrip()
        if before and before[-1] not in ";}{)\n" and flat[len(before) : m.start()].count("\n") == 0 and not before.endswith("default"):
            continue
        line = source.line(m.start("name"))
        decorators = [d.split(".")[-1] for d in re.findall(r"@([\w$.]+)", m["lead"])]
        if kind in ("class", "interface"):
            opening = source.code.find("{", m.end())
            if opening < 0:
                continue
            head = source.code[m.end() : opening]
            head = re.sub(r"^\s*<[^{]*?>(?=\s*(?:extends|implements|$))", "", head)
            clause = lambda word: (re.search(rf"\b{word}\b(.*?)(?=\bimplements\b|$)", head, re.S) or [None, None])[1]  # noqa: B023, E731
            extends, implements = _names(clause("extends")), _names((re.search(r"\bimplements\b(.*)", head, re.S) or [None, None])[1])
            methods = _methods(source, opening)
            if kind == "class":
                found["extends"] += extends
                found["implements"] += implements
                if INJECTED & set(decorators):
                    found["implements"] += _constructor_types(source, opening)
                if m["abstract"]:
                    found["exports_abstract"].append(name)
                found["entities"].append(entity(name, "class", line, methods, decorators, extends + implements))
            else:
                found["exports_abstract"].append(name)
                found["entities"].append(entity(name, "interface", line, methods))
        elif kind in ("const", "let"):
            value = re.compile(r"\s*(?::[^=]+?)?=\s*(?P<o>\{)?").match(source.code, m.end())
            if not value:
                continue
            keys: list[str] = []
            if value["o"]:
                opening = value.start("o")
                inner = top_level(source.code[opening + 1 : source.close(opening)])
                keys = [k for k in (re.match(r"(?:async\s+)?([\w$]+)", p) for p in split_top(inner)) if k]
                keys = [k[1] for k in keys]
            found["entities"].append(entity(name, "function", line, keys))
        else:
            found["entities"].append(entity(name, kind, line, (), decorators if kind == "function" else ()))
        found["exported_names"].append(name)
    return found
