"""Java, C#, Go and Rust facts from masked source."""

from __future__ import annotations

import re

from .lexing import Source, Syntax, entity, facts, imported, mask, split_top, top_level, unique

JAVA = Syntax(long=('"""',))
CSHARP = Syntax(long=('"""',))
GO = Syntax(long=("`",), raw=("`",))
RUST = Syntax(quotes=('"',), long=('"',), nested=True)
_WORD = r"[A-Za-z_]\w*"
_CONTROL = frozenset("if for while switch catch return new throw else do try using lock foreach synchronized super this base typeof sizeof nameof default when where get set".split())


def _plain(name: str) -> str:
    """Last segment of a type without its arguments."""
    return re.split(r"\.|::", re.sub(r"<.*", "", name, flags=re.S).strip())[-1].strip()


def _method_names(body: str, skip: str) -> list[str]:
    """Names before a parameter list at the level of a type's body."""
    found = re.findall(rf"(?<![\w.@])({_WORD})\s*(?:<[^<>()]*>)?\s*\(", body)
    return unique(n for n in found if n not in _CONTROL and n != skip)


def _without_calls(body: str) -> str:
    """Body level without field initialisers, annotations and attributes."""
    body = re.sub(r"@[\w.]+(?:\s*\([^()]*\))?", " ", body)
    return re.sub(r"=(?!>)[^;{}]*(?=[;{}])", " ", body)


def _constants(body: str) -> list[str]:
    """Names listed at the start of an enum's body."""
    head = body.split(";", 1)[0]
    return [m[0] for m in (re.match(_WORD, re.sub(r"^(?:@[\w.]+(?:\([^()]*\))?\s*|\[[^\]]*\]\s*)+", "", p)) for p in split_top(re.sub(r"\{[^}]*\}", "", head))) if m]


def _referenced(code: str, declared: set[str]) -> list[str]:
    return unique(n for n in re.findall(r"(?<![\w.])([A-Z]\w*)", code) if n not in declared)


_JAVA_TYPE = re.compile(rf"(?P<lead>(?:@(?!interface\b)[\w.]+(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*)*)(?P<mods>(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp)\s+)*)(?P<kind>class|interface|enum|record|@interface)\s+(?P<name>{_WORD})")
_KINDS = {"class": "class", "struct": "class", "record": "class", "interface": "interface", "@interface": "interface", "enum": "enum"}


def java(path: str, content: str) -> dict:
    source = mask(content, JAVA)
    found, flat = facts(), top_level(source.code)
    package = (re.search(r"^\s*package\s+([\w.]+)\s*;", flat, re.M) or [None, ""])[1]
    for m in _JAVA_TYPE.finditer(flat):
        opening = source.code.find("{", m.end())
        if opening < 0:
            continue
        head = source.code[m.end() : opening]
        body = source.code[opening + 1 : source.close(opening)]
        bases = [_plain(b) for word in ("extends", "implements") for b in split_top((re.search(rf"\b{word}\b(.*?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", head, re.S) or [None, ""])[1])]
        level = top_level(body)
        methods = _constants(body) if m["kind"] == "enum" else _method_names(_without_calls(level), m["name"])
        decorators = [d.split(".")[-1] for d in re.findall(r"@([\w.]+)", m["lead"])]
        found["entities"].append(entity(m["name"], _KINDS[m["kind"]], source.line(m.start("name")), methods, decorators, bases))
        if _KINDS[m["kind"]] == "interface" or "abstract" in m["mods"]:
            found["exports_abstract"].append(m["name"])
    names = [e["name"] for e in found["entities"]]
    used = _referenced(re.sub(r"^\s*(?:import|package)\b[^;]*;", "", source.code, flags=re.M), set(names))
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", flat, re.M):
        target = m[1]
        found["imports"].append(target)
        if target.endswith(".*"):
            found["imports"] += [f"{target[:-2]}.{n}" for n in used]
            found["imported_names"] += [imported(n, n, f"{target[:-2]}.{n}") for n in used]
        else:
            last = target.rsplit(".", 1)[-1]
            found["imported_names"].append(imported(last, last, target))
    if package:
        found["imports"] += [f"{package}.{n}" for n in used]
        found["imported_names"] += [imported(n, n, f"{package}.{n}") for n in used]
    bases = unique(b for e in found["entities"] for b in e["bases"])
    checked = r"@(Valid|Validated|NotNull|NotBlank|Size|Pattern)\b|javax\.validation|jakarta\.validation"
    return found | {"imports": unique(found["imports"]), "implements": bases, "extends": bases, "exported_names": names, "has_validation": bool(re.search(checked, content)), "declared": [f"{package}.{n}" if package else n for n in names]}


_CS_TYPE = re.compile(rf"(?P<lead>(?:\[[^\]]*\]\s*)*)(?P<mods>(?:(?:public|protected|private|internal|static|sealed|abstract|partial|readonly|ref|unsafe|file|new)\s+)*)(?P<kind>class|struct|record(?:\s+(?:class|struct))?|interface|enum|delegate\s+[\w<>\[\].?]+)\s+(?P<name>{_WORD})")


def _cs_types(source: Source, begin: int, end: int, space: str):
    """(namespace, match, opening brace or -1) of types declared in a namespace's span."""
    code = source.code[begin:end]
    flat = top_level(code)
    file_scoped = re.search(r"^\s*namespace\s+([\w.]+)\s*;", flat, re.M)
    if file_scoped:
        space = file_scoped[1]
    for m in re.finditer(r"\bnamespace\s+([\w.]+)\s*\{", flat):
        opening = begin + m.end() - 1
        yield from _cs_types(source, opening + 1, source.close(opening), f"{space}.{m[1]}" if space else m[1])
    for m in _CS_TYPE.finditer(flat):
        stop = re.compile(r"[{;]").search(source.code, begin + m.end())
        yield space, m, begin, stop.start() if stop and source.code[stop.start()] == "{" else -1, stop.start() if stop else end


def csharp(path: str, content: str) -> dict:
    source = mask(content, CSHARP)
    found = facts()
    spaces, declared = [], []
    for space, m, begin, opening, stop in _cs_types(source, 0, len(source.code), ""):
        kind, name = m["kind"].split()[0], m["name"]
        body = source.code[opening + 1 : source.close(opening)] if opening >= 0 else ""
        head = re.sub(r"\bwhere\b.*", "", source.code[begin + m.end() : stop], flags=re.S)
        head = re.sub(r"^\s*(?:<[^:]*?>)?\s*(?:\([^()]*\))?", "", head)
        bases = [_plain(re.sub(r"\(.*", "", b, flags=re.S)) for b in split_top(head.partition(":")[2])] if kind != "delegate" else []
        level = top_level(body)
        level = re.sub(r"\[[^\]]*\]", " ", level)
        level = re.sub(r"=>[^;]*;", ";", level)
        methods = _constants(body) if kind == "enum" else _method_names(_without_calls(level), name)
        decorators = [_plain(a.split("(")[0]) for group in re.findall(r"\[([^\]]*)\]", m["lead"]) for a in split_top(group)]
        found["entities"].append(entity(name, "type" if kind == "delegate" else _KINDS[kind], source.line(begin + m.start("name")), methods, decorators, bases))
        spaces.append(space)
        declared.append(f"{space}.{name}" if space else name)
        if kind == "interface" or "abstract" in m["mods"]:
            found["exports_abstract"].append(name)
    names = [e["name"] for e in found["entities"]]
    used = _referenced(re.sub(r"^\s*(?:using|namespace)\b[^;{]*[;{]", "", source.code, flags=re.M), set(names))
    for m in re.finditer(rf"^\s*(?:global\s+)?using\s+(static\s+)?(?:({_WORD})\s*=\s*)?([\w.]+)(?:<[^;]*>)?\s*;", source.code, re.M):
        target = m[3]
        found["imports"].append(target)
        if m[2]:
            found["imported_names"].append(imported(m[2], target.rsplit(".", 1)[-1], target))
        elif not m[1]:
            found["imports"] += [f"{target}.{n}" for n in used]
            found["imported_names"] += [imported(n, n, f"{target}.{n}") for n in used]
    for space in unique(spaces):
        found["imports"] += [f"{space}.{n}" for n in used]
        found["imported_names"] += [imported(n, n, f"{space}.{n}") for n in used]
    bases = unique(b for e in found["entities"] for b in e["bases"])
    checked = r"\[\s*(?:Required|Range|StringLength|RegularExpression|Validate\w*)\b|FluentValidation|AbstractValidator"
    return found | {"imports": unique(found["imports"]), "implements": bases, "extends": bases, "exported_names": names, "has_validation": bool(re.search(checked, content)), "declared": declared}


def go(path: str, content: str) -> dict:
    source = mask(content, GO)
    found, flat = facts(), top_level(source.code)
    for m in re.finditer(r"^import\b\s*(\()?", flat, re.M):
        end = source.close(m.start(1)) if m[1] else (flat.find("\n", m.end()) if "\n" in flat[m.end() :] else len(flat))
        for s in re.finditer(r"(?P<alias>[\w.]+)?[ \t]*(?P<q>[\"`])", source.code[m.end() : end]):
            target = source.string_at(m.end() + s.start("q"))
            if target:
                found["imports"].append(target)
                if s["alias"] != "_":
                    last = target.rsplit("/", 1)[-1]
                    found["imported_names"].append(imported(s["alias"] or last, last, target))
    types: dict[str, dict] = {}

    def add_type(name: str, rest: str, at: int) -> None:
        kind = "class" if re.match(r"(?:\[[^\]]*\])?\s*struct\b", rest) else "interface" if re.match(r"(?:\[[^\]]*\])?\s*interface\b", rest) else "type"
        methods: list[str] = []
        if kind == "interface":
            opening = source.code.find("{", at)
            methods = re.findall(rf"^\s*({_WORD})\s*\(", source.code[opening + 1 : source.close(opening)].replace(";", "\n"), re.M) or re.findall(rf"({_WORD})\s*\(", source.code[opening + 1 : source.close(opening)])
            found["exports_abstract"].append(name)
        types[name] = entity(name, kind, source.line(at), methods)
        found["entities"].append(types[name])

    for word in ("type", "const", "var"):
        for m in re.finditer(rf"^{word}\b\s*(\()?", flat, re.M):
            if m[1]:
                end = source.close(m.start(1))
                rows = [(m.end() + r.start(1), r[1]) for r in re.finditer(rf"^\s*({_WORD})", top_level(source.code[m.end() : end]), re.M)]
            else:
                r = re.compile(_WORD).match(flat, m.end())
                rows = [(r.start(), r[0])] if r else []
            for at, name in rows:
                if word == "type":
                    add_type(name, source.code[at + len(name) :].lstrip(), at)
                elif name != "_":
                    found["entities"].append(entity(name, "function", source.line(at)))
    for m in re.finditer(rf"^func\s+(?:\((?P<r>[^)]*)\)\s*)?(?P<n>{_WORD})", flat, re.M):
        if m["r"] is None:
            found["entities"].append(entity(m["n"], "function", source.line(m.start("n"))))
        else:
            owner = re.sub(r"\[.*", "", m["r"].split()[-1].lstrip("*")) if m["r"].split() else ""
            if owner in types:
                types[owner]["methods"].append(m["n"])
    found["entities"].sort(key=lambda e: e["line"])
    return found | {"imports": unique(found["imports"]), "exported_names": [e["name"] for e in found["entities"] if e["name"][0].isupper()], "has_validation": bool(re.search(r'go-playground/validator|validate:"|binding:"', content))}


def _use_leaves(tree: str, above: str = "") -> list[tuple[str, str]]:
    """(path, local name) of the leaves of a use tree."""
    tree = tree.strip()
    opening = tree.find("{")
    if opening >= 0:
        base = above + tree[:opening].strip()
        return [leaf for part in split_top(tree[opening + 1 : tree.rfind("}")]) for leaf in _use_leaves(part, base)]
    path, _, alias = (x.strip() for x in re.sub(r"\s+as\s+", "\0", tree).partition("\0"))
    full = above + path
    if full.endswith("::self"):
        full = full[: -len("::self")]
    return [(full, alias or full.rsplit("::", 1)[-1])]


_RUST_ITEM = re.compile(rf"(?P<lead>(?:#\[[^\]]*\]\s*)*)(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern(?:\s+\"[^\"]*\")?|default)\s+)*?(?P<kind>struct|union|trait|enum|type|fn|const|static|mod)\s+(?:mut\s+)?(?P<name>{_WORD})")
_RUST_KINDS = {"struct": "class", "union": "class", "trait": "interface", "enum": "enum", "type": "type", "fn": "function", "const": "function", "static": "function"}


def rust(path: str, content: str) -> dict:
    source = mask(content, RUST)
    found, flat = facts(), top_level(source.code)
    imports: list[tuple[int, str]] = []
    for m in re.finditer(r"\buse\s+", flat):
        end = source.code.find(";", m.end())
        for full, local in _use_leaves(source.code[m.end() : end if end >= 0 else None].lstrip(":")):
            imports.append((m.start(), full))
            if local not in ("*", "_"):
                found["imported_names"].append(imported(local, full.rsplit("::", 1)[-1], full))
    by: dict[str, dict] = {}
    for m in _RUST_ITEM.finditer(flat):
        kind, name, line = m["kind"], m["name"], source.line(m.start("name"))
        stop = re.compile(r"[{;]").search(flat, m.end())
        opening = stop.start() if stop and flat[stop.start()] == "{" else -1
        if kind == "mod":
            if opening < 0:
                imports.append((m.start(), f"self::{name}"))
            continue
        methods: list[str] = []
        if opening >= 0 and kind in ("trait", "enum"):
            body = source.code[opening + 1 : source.close(opening)]
            methods = re.findall(rf"\bfn\s+({_WORD})", top_level(body)) if kind == "trait" else _constants(re.sub(r"#\[[^\]]*\]", "", body))
        made = entity(name, _RUST_KINDS[kind], line, methods, [_plain(d.split("(")[0]) for d in re.findall(r"#\[\s*([\w:]+)", m["lead"])])
        by.setdefault(name, made)
        found["entities"].append(made)
        found["exported_names"].append(name)
        if kind == "trait":
            found["exports_abstract"].append(name)
    for m in re.finditer(r"\bimpl\b(?P<head>[^{;]*)\{", flat):
        opening = m.end() - 1
        head = re.sub(r"^\s*<[^>]*>", "", re.sub(r"\bwhere\b.*", "", m["head"], flags=re.S))
        trait, _, owner = head.rpartition(" for ")
        methods = re.findall(rf"\bfn\s+({_WORD})", top_level(source.code[opening + 1 : source.close(opening)]))
        target = by.get(_plain(owner or head))
        base = _plain(trait) if trait.strip() else ""
        if base:
            found["implements"].append(base)
        if target is not None:
            target["methods"] = sorted({*target["methods"], *methods})
            if base and base not in target["bases"]:
                target["bases"].append(base)
    return found | {"imports": unique(v for _, v in sorted(imports, key=lambda x: x[0])), "implements": unique(found["implements"])}
