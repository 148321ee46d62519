"""Fact maps: the line-oriented interchange text of an architecture graph.

A map is one text: a header, a table of short ids (a path trie or ``def`` lines), then
one fact a line. A file is written and parsed in blocks by all tasks (short ids may be
used anywhere below their table) and then lives as columns; Parquet is the native form.
"""

from __future__ import annotations

import fcntl
import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pattern import QueryError
from ..operators.edges import short_ids
from ..operators.graph import Graph
from ..operators.scratch import Scratch
from ..schema import EDGE_TYPES, KIND_TAGS
from ..shipping import ship

# Fixed values of the format: header tag, schema version, file names from preferred to older.
HEADER = "belief-map"
SCHEMA_VERSION = 1
MAP_NAMES = (".belief_map.sexp", "belief_map.sexp")
FACT = "line_no long, kind string, args array<string>, flags array<string>, lists map<string, array<string>>"
_EDGE_KINDS = tuple(v for v in EDGE_TYPES.values() if v != "violation")


_TOKEN = re.compile(r'[()]|"(?:[^"\\]|\\.)*("?)|[^\s()"]+', re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def _value(token: str) -> str:
    return _ESCAPED.sub(r"\1", token[1:-1]) if token[0] == '"' else token


def forms(text: str) -> Iterator[tuple[int, list]]:
    """(line number, nested lists) of the top-level forms; quoted atoms stand as their value."""
    stack: list[list] = []
    at, line, counted, begun = 0, 1, 0, 1
    while found := _TOKEN.search(text, at):
        token, at = found.group(), found.end()
        if not stack:
            line, counted = line + text.count("\n", counted, found.start()), found.start()
        if token == "(":
            if not stack:
                begun = line
            stack.append([])
        elif token == ")":
            if not stack:
                raise QueryError("bad-map", f"line {line}: unexpected )")
            done = stack.pop()
            if stack:
                stack[-1].append(done)
            else:
                yield begun, done
        elif token[0] == ";" and not stack:
            at = text.find("\n", found.start())
            if at < 0:
                return
        else:
            if not stack:
                raise QueryError("bad-map", f"line {line}: text outside a fact")
            stack[-1].append(_value(token))
    if stack:
        raise QueryError("bad-map", f"line {begun}: missing )")


def _paths(form: list, above: str, out: dict[str, str]) -> None:
    """Short ids of a trie: (dir child ...) and (sid leaf); (sid :self) is the directory's own id."""
    for child in form:
        if len(child) == 2 and isinstance(child[1], str):
            out[child[0]] = above if child[1] == ":self" else f"{above}/{child[1]}" if above else child[1]
        else:
            _paths(child[1:], f"{above}/{child[0]}" if above else child[0], out)


_KNOWN = {*KIND_TAGS.values(), *_EDGE_KINDS, "node", "violation"}
_TWO_ENDS = {*_EDGE_KINDS, "violation"} - {"http-calls"}
_VALUED = ("naming", "pkg", "eid", "lines", "transport", "client", "detail")


def _fact(form: list) -> tuple[str, list, list, dict]:
    """(kind, args, flags, lists) of a fact, short ids as they stand."""
    plain, flags, lists, at = [], [], {}, 1
    while at < len(form):
        item = form[at]
        if isinstance(item, list):
            lists[item[0].lstrip(":")] = [str(x) for x in item[1:]]
        elif item.startswith(":"):
            name = item[1:]
            taken = []
            while name in _VALUED and at + 1 < len(form) and isinstance(form[at + 1], str) and not form[at + 1].startswith(":") and (name == "lines" or not taken):
                taken.append(form[at + 1])
                at += 1
            flags.append(item)
            if taken:
                lists[name] = taken
        else:
            plain.append(item)
        at += 1
    return form[0], plain, flags, lists


def _numbers(items: list) -> dict[str, int]:
    """Header numbers of its names and values in turn."""
    return {k.lstrip(":"): int(v) for k, v in zip(items[::2], items[1::2], strict=False) if str(v).isdigit()}


def _checked(header: dict[str, int] | None) -> dict[str, int]:
    if header is None:
        raise QueryError("bad-map", "header is missing")
    if header.get("schema") != SCHEMA_VERSION:
        raise QueryError("bad-map", f"schema {header.get('schema')} is not supported")
    return header


def _check_nodes(header: dict[str, int], n: int) -> None:
    if header.get("nodes") != n:
        raise QueryError("bad-map", f"header says {header.get('nodes')} nodes, the map has {n}")


def parse(text: str) -> tuple[dict[str, int], list[tuple]]:
    """(header numbers, facts) with short ids resolved; a bad map raises QueryError."""
    header: dict[str, int] | None = None
    sids: dict[str, str] = {}
    facts: list[tuple] = []

    def full(entity: str) -> str:
        head, mark, rest = entity.partition("::")
        return sids.get(head, head) + mark + rest

    for line, form in forms(text):
        kind = form[0] if form and isinstance(form[0], str) else ""
        if kind == HEADER:
            header = _numbers(form[1:])
        elif kind == "paths":
            _paths(form[1:], "", sids)
        elif kind == "def":
            sids[form[1]] = form[2]
        elif kind in _KNOWN:
            if header is None:
                raise QueryError("bad-map", "header is missing")
            _, plain, flags, lists = _fact(form)
            plain = [full(x) if i == 0 or i == 1 and kind in _TWO_ENDS else x for i, x in enumerate(plain)]
            facts.append((line, kind, plain, flags, lists))
    header = _checked(header)
    _check_nodes(header, len({f[2][0] for f in facts if f[1] == "node"}))
    return header, facts


def parse_texts(texts: DataFrame) -> DataFrame:
    """Facts (line_no, kind, args, flags, lists) of whole map texts (value), each parsed by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame(parse(text)[1], columns=["line_no", "kind", "args", "flags", "lists"])

    ship(texts.sparkSession)
    return texts.mapInPandas(run, FACT)


def _logical(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str, bool]]:
    """(block, line in it, text, whether a quoted atom is cut off) of lines (value, block); lines that a quoted atom runs over are one."""
    block, n, held, begun = None, 0, "", 0
    for batch in batches:
        for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if at != block:
                if held:
                    yield block, begun, held, True
                block, n, held = at, 0, ""
            if held:
                text = f"{held}\n{text}"
            else:
                begun = n
            n += 1
            held = ""
            if '"' in text and _cut(text):
                held = text
            else:
                yield block, begun, text, False
    if held:
        yield block, begun, held, True


def _cut(text: str) -> bool:
    """Whether a quoted atom is open at the end; atoms that begin with ; outside a list of this text begin a comment."""
    depth = 0
    for found in _TOKEN.finditer(text):
        token = found.group()
        if token == "(":
            depth += 1
        elif token == ")":
            depth -= 1
        elif token[0] == '"' and not found.group(1):
            return True
        elif token[0] == ";" and depth <= 0:
            return False
    return False


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """What each block does to the lists that are open where it begins: closes ``pops``, then opens ``pushed``.

    ``notes``: the pops at which a comment was taken for one. ``regular``: no atom is cut. ``bare``: the
    innermost list holds no atom but its name.
    """
    out: list[dict] = []
    pushed: list[list] = []
    for block, line, text, cut in _logical(batches):
        if not out or out[-1]["block"] != block:
            pushed = []
            out.append({"block": block, "lines": 0, "pops": 0, "notes": [], "regular": True, "bare": True, "pushed": [], "begun": -1})
        now = out[-1]
        now["lines"] = line + 1 + text.count("\n")
        now["regular"] &= not cut
        if text.startswith("(") and text.endswith(")") and text.count("(") == text.count(")") == 1 and '"' not in text:
            continue
        for found in _TOKEN.finditer(text):
            token = found.group()
            if token == "(":
                if not pushed:
                    now["begun"] = line
                pushed.append([])
            elif token == ")":
                if pushed:
                    pushed.pop()
                else:
                    now["pops"] += 1
                    now["bare"] = True
            elif token[0] == ";" and not pushed:
                if now["pops"] not in now["notes"]:
                    now["notes"].append(now["pops"])
                break
            elif pushed:
                pushed[-1].append(_value(token) if not pushed[-1] else "")
            else:
                now["bare"] = False
        now["pushed"] = [x[0] if x else None for x in pushed]
        if pushed:
            now["regular"] &= None not in now["pushed"]
            now["tail"] = len(pushed[-1]) == 1
    for now in out:
        now["regular"] = now["regular"] and None not in now["pushed"]
        now["bare"] = now.pop("tail", True) if now["pushed"] else now["bare"]
    if out:
        yield pd.DataFrame(out)


def _starts(found: list) -> dict[int, tuple[int, list, int]] | None:
    """(lines above, names of open lists, line of the open form) of each block; None if blocks cannot be read apart."""
    out: dict[int, tuple[int, list, int]] = {}
    above, names, begun = 0, [], -1
    for now in sorted(found, key=lambda r: r["block"]):
        out[now["block"]] = (above, names, begun)
        if any(len(names) != n for n in now["notes"]) or not now["regular"]:
            return None
        if now["pops"] > len(names):
            raise QueryError("bad-map", "unexpected )")
        kept = names[: len(names) - now["pops"]]
        if not kept:
            begun = above + now["begun"] + 1
        names = kept + list(now["pushed"])
        if names and names[0] == "paths" and not now["bare"]:
            return None
        above += now["lines"]
    if names:
        raise QueryError("bad-map", f"line {begun}: missing )")
    return out


class _Block:
    """Rows (line_no, kind, args, flags, lists) of a block's lines. A form that is cut gives its pieces as rows of kind ''."""

    def __init__(self, number: int, above: int, names: list, begun: int):
        self.number, self.above, self.rows = number, above, []
        self.dirs = [[n, None, 0] for n in names] if names and names[0] == "paths" else []
        self.depth = 0 if self.dirs else len(names)
        self.begun, self.text, self.cut = begun, [], bool(self.depth)

    def row(self, line: int, form: list) -> None:
        kind = form[0] if form and isinstance(form[0], str) else ""
        if kind == "def":
            self.rows.append((line, kind, form[1:3], [], {}))
        elif kind == HEADER:
            self.rows.append((line, kind, [x for x in form[1:] if isinstance(x, str)], [], {}))
        elif kind == "paths":  # none but in pieces that were put together
            found: dict[str, str] = {}
            _paths(form[1:], "", found)
            self.rows += [(line, "def", list(x), [], {}) for x in found.items()]
        elif kind in _KNOWN:
            self.rows.append((line, *_fact(form)))

    def line(self, at: int, text: str) -> None:
        line = self.above + at + 1
        if not self.depth and not self.dirs and text.startswith("(") and text.endswith(")") and text.count("(") == text.count(")") == 1 and '"' not in text:
            form = text[1:-1].split()
            if form[:1] != ["paths"]:
                self.row(line, form)
                return
        start = 0
        for found in _TOKEN.finditer(text):
            token = found.group()
            if self.dirs:
                self.path(line, token)
            elif self.depth:
                self.depth += (token == "(") - (token == ")")
                if not self.depth:
                    self.text.append(text[start : found.end()])
                    self.ended()
                elif self.depth == 1 and not self.text and token not in "()" and text[start : found.start()].strip() == "(" and token == "paths":
                    self.dirs, self.depth = [["paths", None, 0]], 0
            elif token == "(":
                self.depth, self.begun, start = 1, line + text.count("\n", 0, found.start()), found.start()
            elif token[0] == ";":
                break
            else:
                raise QueryError("bad-map", f"line {line}: {'unexpected )' if token == ')' else 'text outside a fact'}")
        if self.depth:
            self.text.append(text[start:] + "\n")

    def path(self, line: int, token: str) -> None:
        top = self.dirs[-1]
        if token == "(":
            top[2] = 2
            self.dirs.append([None, None, 0])
        elif token == ")":
            self.dirs.pop()
            if self.dirs and top[2] == 1:
                above = "/".join(d[0] for d in self.dirs[1:])
                self.rows.append((line, "def", [top[0], above if top[1] == ":self" else f"{above}/{top[1]}" if above else top[1]], [], {}))
        elif top[0] is None:
            top[0] = _value(token)
        else:
            top[1], top[2] = _value(token), top[2] + 1

    def ended(self) -> None:
        text, self.text = "".join(self.text), []
        if self.cut:
            self.rows.append((self.begun, "", [text], [f"{self.number:020d}"], {}))
        else:
            for _, form in forms(text):
                self.row(self.begun, form)
        self.cut = False

    def closed(self) -> None:
        """The end of the block: a form that goes on is cut."""
        if self.depth:
            self.cut = True
            self.ended()

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c if t is not _LISTS else [list(x.items()) for x in c], t) for c, t in zip(columns, (pa.int64(), pa.string(), _STRINGS, _STRINGS, _LISTS), strict=True)], names=["line_no", "kind", "args", "flags", "lists"])


_STRINGS = pa.list_(pa.string())
_LISTS = pa.map_(pa.string(), _STRINGS)
#: Rows of a batch that a reader hands on.
_ROWS = 5000


def _resolved(parsed: DataFrame) -> DataFrame:
    """Facts with short ids replaced by what the nearest definition above says."""
    arg = lambda n: F.get("args", F.lit(n))
    defs = parsed.filter("kind = 'def'").select(arg(0).alias("sid"), F.struct("line_no", arg(1).alias("path")).alias("d"))
    ids = defs.groupBy("sid").agg(F.array_sort(F.collect_list("d")).alias("ds"))

    def full(facts: DataFrame, n: int) -> DataFrame:
        asked = facts.withColumn("_h", F.substring_index(arg(n), "::", 1)).join(ids.withColumnRenamed("sid", "_h"), "_h", "left")
        path = F.coalesce(F.element_at(F.filter("ds", lambda d: d["line_no"] < F.col("line_no")), -1)["path"], F.col("_h"))
        shown = F.concat(path, F.substring(arg(n), F.length("_h") + 1, F.length(arg(n))))
        return asked.withColumn("args", F.when(F.size("args") > n, F.transform("args", lambda x, i: F.when(i == n, shown).otherwise(x))).otherwise(F.col("args"))).select(facts.columns)

    facts = parsed.filter(F.col("kind").isin(*sorted(_KNOWN)))
    two = F.col("kind").isin(*sorted(_TWO_ENDS))
    return full(facts.filter(~two), 0).unionByName(full(full(facts.filter(two), 0), 1))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts (line_no, kind, args, flags, lists) of a map file, which is read in parallel.

    A survey finds which lists are open where each block of the file begins; then
    all blocks are parsed apart and written as a table, and short ids are joined. Where a
    block ends inside a quoted atom, or a list's name, one task parses the whole text.
    """
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("block"))

    def survey(batches):
        for made in _survey(batches):
            yield pa.RecordBatch.from_pandas(made, pa.schema([("block", pa.int64()), ("lines", pa.int64()), ("pops", pa.int64()), ("notes", pa.list_(pa.int64())), ("regular", pa.bool_()), ("bare", pa.bool_()), ("pushed", _STRINGS), ("begun", pa.int64())]), preserve_index=False)

    starts = _starts(lines.mapInArrow(survey, "block long, lines long, pops long, notes array<long>, regular boolean, bare boolean, pushed array<string>, begun long").collect())
    if starts is None:
        return parse_texts(spark.read.text(path, wholetext=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for block, at, text, _ in _logical(batches):
            if here is None or here.number != block:
                if here is not None:
                    here.closed()
                    yield here.taken()
                here = _Block(block, *starts[block])
            here.line(at, text)
            if len(here.rows) >= _ROWS:
                yield here.taken()
        if here is not None:
            here.closed()
            yield here.taken()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = _Block(0, 0, [], 0)
            for line, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for _, form in forms(text):
                    here.row(line, form)
            yield here.taken()

    parsed = Scratch(spark).write(lines.mapInArrow(run, FACT), "parsed")
    if any(names and names[0] != "paths" for _, names, _ in starts.values()):
        piece = F.struct(F.get("flags", F.lit(0)).alias("at"), F.get("args", F.lit(0)).alias("text"))
        whole = parsed.filter("kind = ''").groupBy("line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "").alias("text"))
        parsed = parsed.unionByName(whole.mapInArrow(joined, FACT))
    heads = parsed.filter(F.col("kind") == HEADER).select("line_no", "args").collect()
    header = _checked(_numbers(max(heads)["args"]) if heads else None)
    first = parsed.filter(F.col("kind").isin(*sorted(_KNOWN))).agg(F.min("line_no")).first()[0]
    if first is not None and first < min(heads)["line_no"]:
        raise QueryError("bad-map", "header is missing")
    facts = _resolved(parsed)
    _check_nodes(header, facts.filter("kind = 'node'").select(F.get("args", F.lit(0))).distinct().count())
    return facts


def raw_facts(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, module, fact): lines of a map with the module that each begins with, in full."""
    facts = read_facts(spark, path)
    shown = F.concat(F.lit("("), F.concat_ws(" ", "kind", F.array_join("args", " "), F.array_join("flags", " ")), F.lit(")"))
    return facts.select("line_no", F.substring_index(F.get("args", F.lit(0)), "::", 1).alias("module"), shown.alias("fact"))


def read_map(spark: SparkSession, path: str) -> Graph:
    return graph_of(read_facts(spark, path))


def graph_of(facts: DataFrame) -> Graph:
    arg = lambda n: F.get("args", F.lit(n))
    listed = lambda name: F.coalesce(F.col("lists").getItem(name), F.array().cast("array<string>"))
    one = lambda name: F.coalesce(F.get(listed(name), F.lit(0)), F.lit(""))
    modules = facts.filter("kind = 'node'").select(arg(0).alias("module"), arg(0).alias("path"), arg(1).alias("lang"), one("pkg").alias("pkg"), F.coalesce(arg(2), F.lit("")).alias("purpose"), one("naming").alias("naming"))
    tags = list(KIND_TAGS.values())
    line = F.coalesce(arg(2).try_cast("int"), F.lit(0))
    entities = facts.filter(F.col("kind").isin(*tags)).select(arg(0).alias("module"), arg(1).alias("name"), "kind", line.alias("line"), listed("bases").alias("bases"), listed("deco").alias("deco"), listed("methods").alias("methods"))
    edges = facts.filter(F.col("kind").isin(*_EDGE_KINDS)).select(F.col("kind").alias("etype"), arg(0).alias("source"), arg(1).alias("target"), F.transform("flags", lambda f: F.substring(f, 2, 1000)).alias("flags"), F.transform(listed("lines"), lambda x: x.cast("int")).alias("lines"))
    return Graph(modules, entities, edges)


def _quoted(value) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _atom(value) -> Column:
    return F.when((value == "") | value.rlike(r'[\s"()\;]'), _quoted(value)).otherwise(value)


def fact_text(graph: Graph) -> DataFrame:
    """(part, sort, fact): lines of a map, in the order part, sort."""
    ids = short_ids(graph.modules).select("module", "sid")
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    counts = graph.modules.sparkSession.range(1).select(count(graph.modules).alias("n"), count(graph.edges).alias("e"))
    head = counts.select(F.lit(0).alias("part"), F.lit("").alias("sort"), F.concat(F.lit(f"({HEADER} :schema {SCHEMA_VERSION} :files "), F.col("n"), F.lit(" :nodes "), F.col("n"), F.lit(" :edges "), F.col("e"), F.lit(" :violations 0)")).alias("fact"))
    defs = ids.select(F.lit(1).alias("part"), F.col("module").alias("sort"), F.concat(F.lit("(def "), "sid", F.lit(" "), _quoted(F.col("module")), F.lit(")")).alias("fact"))
    flag = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f" :{name} "), _atom(F.col(c)))).otherwise("")
    nodes = graph.modules.join(ids, "module").select(F.lit(2).alias("part"), F.col("module").alias("sort"), F.concat(F.lit("(node "), "sid", F.lit(" "), "lang", F.lit(" "), _quoted(F.coalesce("purpose", F.lit(""))), flag("naming", "naming"), flag("pkg", "pkg"), F.lit(")")).alias("fact"))
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f" (:{name} "), F.array_join(F.transform(c, _atom), " "), F.lit(")"))).otherwise("")
    entities = graph.entities.join(ids, "module", "left").withColumn("sid", F.coalesce("sid", _atom(F.col("module")))).select(
        F.lit(3).alias("part"), F.concat_ws(" ", "module", F.lpad(F.col("line").cast("string"), 9, "0"), "name").alias("sort"),
        F.concat(F.lit("("), "kind", F.lit(" "), "sid", F.lit(" "), _atom(F.col("name")), F.lit(" "), F.col("line").cast("string"), listed("bases", "bases"), listed("deco", "deco"), listed("methods", "methods"), F.lit(")")).alias("fact"),
    )
    src, dst = ids.select(F.col("module").alias("src_mod"), F.col("sid").alias("_s")), ids.select(F.col("module").alias("dst_mod"), F.col("sid").alias("_d"))
    tail = lambda ent: F.coalesce(F.concat(F.lit("::"), F.col(ent)), F.lit(""))
    ends = graph.ends.join(src, "src_mod", "left").join(dst, "dst_mod", "left")
    a = _atom(F.concat(F.coalesce("_s", "src_mod"), tail("src_ent")))
    b = _atom(F.when(F.col("etype") == "http-calls", F.col("target")).otherwise(F.concat(F.coalesce("_d", "dst_mod"), tail("dst_ent"))))
    flags = F.array_join(F.transform("flags", lambda f: F.concat(F.lit(" :"), f)), "") if "flags" in graph.edges.columns else F.lit("")
    edges = ends.select(F.lit(4).alias("part"), F.concat_ws(" ", "etype", "source", "target").alias("sort"), F.concat(F.lit("("), "etype", F.lit(" "), a, F.lit(" "), b, flags, F.lit(")")).alias("fact"))
    return head.unionByName(defs).unionByName(nodes).unionByName(entities).unionByName(edges)


def _shared(a: list[str], b: list[str]) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _trie_rows(rows: list[tuple[list[str], str]], before: list[str] | None = None, opened: list[int] = (), after: list[str] | None = None, ahead: list[int] = ()) -> Iterator[list[str]]:
    """Trie lines that each of some sorted rows adds, given the rows around them.

    ``opened`` are the depths of directories that stay open where the rows begin, ``ahead`` the depths that the
    last row shares with rows after it. A directory is opened where it branches: at a depth that the row shares with a later row
    and with none before.
    """
    later = [sorted(ahead)]
    for (one, _), (two, _) in zip(rows[-2::-1], rows[:0:-1], strict=True):
        d = _shared(one, two)
        later.append([*(x for x in later[-1] if x < d), d])
    later.reverse()
    stack = list(opened)
    for i, (segments, sid) in enumerate(rows):
        last = rows[i - 1][0] if i else before
        following = rows[i + 1][0] if i + 1 < len(rows) else after
        p = _shared(last, segments) if last is not None else 0
        at = stack[-1] if stack else 0
        out = []
        for d in later[i]:
            if d > p:
                out.append(f"({'/'.join(segments[at:d])}")
                stack.append(d)
                at = d
        end = len(segments)
        if at == end:
            out.append(f"({sid} :self)")
        elif at == end - 1:
            out.append(f"({sid} {segments[-1]})")
        else:
            out += [f"({'/'.join(segments[at : end - 1])}", f"({sid} {segments[-1]})", ")"]
        n = _shared(segments, following) if following is not None else 0
        while stack and stack[-1] > n:
            stack.pop()
            out.append(")")
        yield out


def path_trie(rows: list[tuple[list[str], str]]) -> Iterator[str]:
    """Lines of a trie over sorted (segments, short id): (dir child ...), (sid leaf) and (sid :self).

    A directory's name runs on over directories that have no other child.
    """
    for lines in _trie_rows(rows):
        yield from lines


#: Ids of a part of a trie that one task makes.
TRIE_ROWS = 100_000


def trie_parts(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, n, fact): lines of the trie over ids (module, sid), in the order part, n.

    Each part of the sorted ids is made by one task. What a part must know of the others, the depths that its ends
    share with rows beyond, follows from a few numbers of each part.
    """
    n = -(-ids.count() // TRIE_ROWS) or 1
    ranged = ids.repartitionByRange(n, F.split("module", "/"), "sid").select("module", "sid", F.spark_partition_id().alias("part"))
    parts = scratch.write(ranged, "trie").groupBy("part")
    ordered = lambda got: sorted((m.split("/"), s) for m, s in zip(got["module"], got["sid"], strict=True))

    def least(rows: list) -> list[int]:
        out: list[int] = []
        for (one, _), (two, _) in zip(rows, rows[1:], strict=False):
            d = _shared(one, two)
            if not out or d < out[-1]:
                out.append(d)
        return out

    def ends(got: pd.DataFrame) -> pd.DataFrame:
        rows = ordered(got)
        return pd.DataFrame([{"part": got["part"].iloc[0], "first": rows[0][0], "last": rows[-1][0], "right": least(rows), "left": least(rows[::-1])}])

    ship(ids.sparkSession)
    found = sorted(parts.applyInPandas(ends, "part int, first array<string>, last array<string>, right array<int>, left array<int>").collect())
    between = [_shared(a["last"], b["first"]) for a, b in zip(found, found[1:], strict=False)]
    beyond = lambda edge, own, further: {edge} | {min(edge, y) for y in {*own, *(min([*own, x]) for x in further)}}
    ahead, behind = [set()], [set()]
    for k in range(len(found) - 2, -1, -1):
        ahead.insert(0, beyond(between[k], found[k + 1]["right"], ahead[0]))
    for k in range(1, len(found)):
        behind.append(beyond(between[k - 1], found[k - 1]["left"], behind[-1]))
    around = {}
    for k, now in enumerate(found):
        p = between[k - 1] if k else 0
        right = {*now["right"], *(min([*now["right"], x]) for x in ahead[k])}
        around[now["part"]] = (found[k - 1]["last"] if k else None, sorted(d for d in behind[k] | right if 0 < d <= p), found[k + 1]["first"] if k + 1 < len(found) else None, sorted(ahead[k]))

    def made(got: pd.DataFrame) -> pd.DataFrame:
        part = int(got["part"].iloc[0])
        lines = _trie_rows(ordered(got), *around[part])
        return pd.DataFrame({"part": part, "n": range(len(got)), "fact": ["\n".join(x) for x in lines]})

    return parts.applyInPandas(made, "part int, n int, fact string")


@contextmanager
def exclusive(path: str) -> Iterator[None]:
    """Holds the lock of a map file among the writers of this machine; a second one raises QueryError at once."""
    name = hashlib.sha256(os.path.abspath(path).encode()).hexdigest()[:16]
    with open(os.path.join(tempfile.gettempdir(), f"archspan-map-{name}.lock"), "a", encoding="utf-8") as held:
        try:
            fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise QueryError("locked", path) from None
        try:
            yield
        finally:
            fcntl.flock(held, fcntl.LOCK_UN)


def write_map(graph: Graph, path: str, trie: bool = False) -> None:
    """One map file in place of an older one, by rename. The text is meant for tools that read one file.

    With ``trie`` the ids' paths are written as a trie; ids that are no plain atoms keep their ``def`` lines. All tasks
    write sorted text to the scratch folder, whose files the driver appends to the map as bytes.
    """
    spark = graph.modules.sparkSession
    temporary = f"{path}.{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    with exclusive(path):
        scratch = Scratch(spark)
        lines = fact_text(graph)
        plain = ~F.col("module").rlike(r'[\s"();]') & ~F.col("module").startswith(":")
        out = jvm.java.io.FileOutputStream(temporary)

        def add(found: DataFrame, name: str, *order: str) -> None:
            found.orderBy(*order).select("fact").write.option("lineSep", "\n").text(f"{scratch.folder}/{name}")
            folder = jvm.org.apache.hadoop.fs.Path(f"{scratch.folder}/{name}")
            store = folder.getFileSystem(conf)
            for file in sorted((x.getPath() for x in store.listStatus(folder)), key=lambda x: x.getName()):
                if file.getName().startswith("part-"):
                    data = store.open(file)
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, 1 << 20, False)
                    data.close()
            scratch.drop(name)

        for part in range(5):
            if part == 1 and trie:
                ids = short_ids(graph.modules).select("module", "sid")
                out.write(bytearray(b"(paths\n"))
                add(trie_parts(ids.filter(plain), scratch), "paths", "part", "n")
                scratch.drop("trie")
                out.write(bytearray(b")\n"))
                defs = ids.filter(~plain).select(F.lit(1).alias("part"), F.col("module").alias("sort"), F.concat(F.lit("(def "), "sid", F.lit(" "), _quoted(F.col("module")), F.lit(")")).alias("fact"))
                add(defs, "defs", "sort", "fact")
            else:
                add(lines.filter(F.col("part") == part), f"part{part}", "sort", "fact")
        out.getFD().sync()
        out.close()
        os.replace(temporary, path)


def find_map(start: str) -> str | None:
    """The nearest map file from ``start`` upwards."""
    here = os.path.abspath(start)
    while True:
        for name in MAP_NAMES:
            if os.path.isfile(os.path.join(here, name)):
                return os.path.join(here, name)
        if os.path.dirname(here) == here:
            return None
        here = os.path.dirname(here)
