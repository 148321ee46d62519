"""Registered queries over small graphs made of the nations, the query language, and string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, uri
from ..functions.pattern import QueryError, depth_of
from ..operators import edges as E
from ..operators import graph as G
from ..operators import lookup, ranges, resolve
from ..sources import projection as P
from . import report, sexpr, trees
from .catalog import query
from .catalog import with_sql as _with

# One graph for each nation. A walk of depth 3 from a first meets e at its limit, by way of b and d, and so never
# reaches f, which is three hops away by way of c.
LINKS = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("c", "e"), ("d", "a"), ("d", "e"), ("e", "f")]
FLOWS = [("calls", "a::f", "b::g"), ("imports", "a", "c"), ("refs", "b::g", "d::h"), ("imports", "b", "e"), ("imports", "c", "e")]
CALLS = [("a::f", "b::g"), ("b::g", "d::h"), ("a::f", "k::k"), ("k::k", "d::h"), ("d::h", "e::e")]


def _graph(spark: SparkSession, sf_dir: str, edges: list[tuple[str, str, str]]) -> G.Graph:
    rows = trees.filled(spark, sf_dir, "etype string, source string, target string", [(t, f"n@/{a}", f"n@/{b}") for t, a, b in edges])
    names = sorted({x.split("::")[0] for _, a, b in edges for x in (a, b)})
    modules = trees.filled(spark, sf_dir, "module string, path string, lang string, pkg string, purpose string, naming string", [(f"n@/{m}", f"n@/{m}.py", "py", "n@", "domain logic", "snake_case") for m in names])
    entities = trees.filled(spark, sf_dir, "module string, name string, kind string, line string", [(f"n@/{x.split('::')[0]}", x.split("::")[1], "fn", "1") for _, a, b in edges for x in (a, b) if "::" in x])
    empty = F.array().cast("array<string>")
    entities = entities.select("module", "name", "kind", F.col("line").cast("int").alias("line"), empty.alias("bases"), empty.alias("deco"), empty.alias("methods"))
    return G.Graph(modules, entities, rows)


def _linked(spark, sf_dir):
    return _graph(spark, sf_dir, [("imports", a, b) for a, b in LINKS])


def _root(spark, sf_dir, name):
    return trees.filled(spark, sf_dir, "module string", [(f"n@/{name}",)])


_AHEAD = [(0, 1, "b", "no"), (1, 2, "d", "no"), (2, 3, "a", "yes"), (3, 3, "e", "no"), (4, 1, "c", "no"), (5, 2, "d", "yes"), (6, 2, "e", "yes")]
_BACK = [(0, 1, "e", "no"), (1, 2, "c", "no"), (2, 3, "a", "no"), (3, 2, "d", "no"), (4, 3, "b", "no"), (5, 3, "c", "yes")]


def _walk_sql(root: str, rows: list[tuple]) -> str:
    inner = trees.expected_sql("root, step, depth, via, module, cycle", [(f"n@/{root}", s, d, "imports", f"n@/{m}", c) for s, d, m, c in rows])
    return f"select root, step, depth, via, module, cycle = 'yes' as cycle from ({inner}) w"


query("walk_strict", _walk_sql("a", _AHEAD))(lambda s, d: G.walk(_linked(s, d), _root(s, d, "a"), 3))
query("walk_strict_reverse", _walk_sql("f", _BACK))(lambda s, d: G.walk(_linked(s, d), _root(s, d, "f"), 3, True))
query("hops_of_all_roots", trees.expected_sql("root, module, depth, via", [("n@/a", f"n@/{m}", k, "imports") for m, k in (("b", 1), ("c", 1), ("d", 2), ("e", 2), ("f", 3))]))(lambda s, d: G.hops(_linked(s, d), _root(s, d, "a"), 3))
query(
    "flow_steps",
    "select cast(depth as int) as depth, source, target, via, module_level from (values (0, 'n3/a::f', 'n3/b::g', 'calls', false), (0, 'n3/a::f', 'n3/c', 'imports', true), (1, 'n3/b::g', 'n3/d::h', 'refs', false), "
    "(1, 'n3/b::g', 'n3/e', 'imports', true), (1, 'n3/c', 'n3/e', 'imports', false)) v(depth, source, target, via, module_level)",
)(lambda s, d: G.flow(_graph(s, d, FLOWS), "n3/a", "f"))


@query("call_chain_shortest", "select cast(2 as int) as hops, 'n3/a::f > n3/b::g > n3/d::h' as path")
def _chain(spark, sf_dir):
    calls = _graph(spark, sf_dir, [("calls", a, b) for a, b in CALLS]).edges.select("source", "target")
    node = lambda name: spark.createDataFrame([(name,)], "node string")
    return G.call_chain(calls, node("n3/a::f"), node("n3/d::h"), 5).select("hops", F.array_join("path", " > ").alias("path"))


# Commands, as lines.
def _lines(lines: list[str], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "place int, line string")


def _values(lines: list[str]) -> str:
    rows = ", ".join(f"({i}, '{x}')" for i, x in enumerate(lines))
    return f"select cast(place as int) as place, line from (values {rows}) v(place, line)"


_DEPS = ['(deps-root n3/a :lang py)'] + [f"(dep n3/a n3/{m} :lang py :via imports :depth {d}{' :cycle' if c == 'yes' else ''})" for _, d, m, c in _AHEAD]
_RDEPS = ['(rdeps-root n3/f :lang py)'] + [f"(rdep n3/f n3/{m} :lang py :via imports :depth {d}{' :cycle' if c == 'yes' else ''})" for _, d, m, c in _BACK]
query("command_deps", _values(_DEPS))(lambda s, d: _lines(report.run(report.Report(_linked(s, d)), "deps", "n3/a", "3"), s))
query("command_rdeps", _values(_RDEPS))(lambda s, d: _lines(report.run(report.Report(_linked(s, d)), "rdeps", "n3/f", "3"), s))
query("command_boundary", _values(['(boundary n3/e :lang py :file "n3/e.py" :purpose "domain logic")', '(boundary-dep n3/e n3/f :lang py :file "n3/f.py" :relation imports)', '(boundary-rdep n3/e n3/c :lang py :file "n3/c.py" :relation imports)', '(boundary-rdep n3/e n3/d :lang py :file "n3/d.py" :relation imports)', "(boundary-summary n3/e :total 4 :deps 1 :rdeps 2)"]))(
    lambda s, d: _lines(report.run(report.Report(_linked(s, d)), "boundary", "n3/e"), s)
)
query("command_search", _values(['(search-result n3/f :lang py :file "n3/f.py")', "(search-count 1)"]))(lambda s, d: _lines(report.run(report.Report(_linked(s, d)), "search", "n3/f"), s))


@query("command_errors", _values(['unknown-command "nothing"', 'invalid-depth "depth must be an integer: x"', 'invalid-depth "depth must be between 0 and 50: 51"', "7"]))
def _errors(spark, sf_dir):
    answer, out = report.Report(_linked(spark, sf_dir)), []
    for call in (lambda: report.run(answer, "nothing"), lambda: report.run(answer, "deps", "n3/a", "x"), lambda: depth_of("51"), lambda: depth_of("7")):
        try:
            out.append(str(call()))
        except QueryError as wrong:
            out.append(f"{wrong.kind} {report.quoted(wrong.text)}")
    return _lines(out, spark)


# A keyword finds a module by id first, else by the first fact that holds it.
@query("quick_lookup", "select concat('n', n_nationkey, '/e') as module from nation where n_nationkey = 3")
def _quick(spark, sf_dir):
    facts = trees.filled(spark, sf_dir, "module string, fact string", [("n@/e", "(cls n@/e KeyHolder@ 4)"), ("n@/f", "(fn n@/f other 9)")])
    numbered = facts.withColumn("line_no", F.regexp_extract("module", r"(\d+)", 1).cast("long") * 2)
    return lookup.quick(_linked(spark, sf_dir), numbered, "keyholder3 ")


# The functions of the query language that have no query of their own yet.
_FORMS = {
    "resolve": ('(resolve "nation_7")', "modules", "select module from modules where right(module, 8) = 'nation_7'"),
    "deps": ('(deps "wh/domain/nation_3" 1)', "neighbors", "select dst_mod as module from neighbors where src_mod='wh/domain/nation_3'"),
    "rdeps": ('(rdeps "wh/infra/supplier_3" 1)', "neighbors", "select src_mod as module from neighbors where dst_mod='wh/infra/supplier_3'"),
    "imports": ('(imports "wh/services/part_10")', "neighbors", "select dst_mod as module from neighbors where src_mod='wh/services/part_10'"),
    "entity": ('(entity "line3")', "entities", "select distinct module from entities where name='line3'"),
    "refs_to": ('(refs-to "line6")', "ends", "select distinct src_mod as module from ends where src_ent='line6' or dst_ent='line6'"),
    "layer_of": ('(layer-of (dependents "wh/domain/nation_3") ui)', "neighbors,layered", "select distinct src_mod as module from neighbors join layered on module=src_mod where dst_mod='wh/domain/nation_3' and layer='ui'"),
    "find_function": ('(find-function "line1")', "entities", "select distinct module from entities where kind='fn' and name like '%line1%'"),
    "find_type": ('(find-type "^Part1.*7$")', "entities", "select distinct module from entities where kind='cls' and lower(name) like 'part1%7'"),
    "find_callers": ('(find-callers "purchase" 1)', "entities,calls", "select module from entities where kind='fn' and lower(name) like '%purchase%' union select split_part(source,'::',1) from calls where split_part(target,'::',2) like '%purchase%'"),
    "find_calls": ('(find-calls "purchase" 1)', "calls", "select distinct split_part(target,'::',1) as module from calls where split_part(source,'::',2) like '%purchase%'"),
    "search": ('(search "supplier_1.*0")', "modules", "select module from modules where lower(module) like '%supplier!_1%0%' escape '!'"),
}
for _name, (_form, _needs, _sql) in _FORMS.items():
    query(f"sexpr_{_name}", _with(*_needs.split(",")) + _sql)(lambda s, d, form=_form, calls=_name in ("find_callers", "find_calls"): sexpr.query(P.graph(s, d, calls), form))

_PART = "wh/services/part_10"
query(
    "sexpr_analyze",
    _with("ends", "entities")
    + f"select concat('out:',etype) as metric, count(distinct target) as n from ends where src_mod='{_PART}' and dst_mod<>'{_PART}' group by etype union all select concat('in:', case when etype='imports' then 'imports' else 'refs' end), count(distinct src_mod) from ends where dst_mod='{_PART}' and src_mod<>'{_PART}' group by 1 union all select 'entities', count(*) from entities where module='{_PART}'",
)(lambda s, d: sexpr.query(P.graph(s, d), f'(analyze "{_PART}")'))
query("sexpr_analyze_nothing", "select 'entities' as metric, cast(0 as bigint) as n")(lambda s, d: sexpr.query(P.graph(s, d), '(analyze "no such module")'))


# A diff of every part's file: one change of two lines, for odd keys behind the last entity's assumed end.
def _diff(spark, sf_dir):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size") + F.when(F.col("p_partkey") % 2 == 1, 500).otherwise(0)
    named = F.struct((F.col("p_partkey") * 3).cast("long").alias("line_no"), F.concat(F.lit("+++ b/wh/services/part_"), key, F.lit(".go")).alias("line"))
    head = F.struct((F.col("p_partkey") * 3 + 1).cast("long").alias("line_no"), F.concat(F.lit("@@ -1,0 +"), size.cast("string"), F.lit(",2 @@ func")).alias("line"))
    more = F.struct((F.col("p_partkey") * 3 + 2).cast("long").alias("line_no"), F.lit("+text").alias("line"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.inline(F.array(named, head, more)))


query("diff_hunks", 'select concat(\'wh/services/part_\', p_partkey, \'.go\') as path, cast(p_size + p_partkey%2*500 as int) as start, cast(p_size + p_partkey%2*500 + 1 as int) as "end" from part')(lambda s, d: ranges.hunks(_diff(s, d)))
query("sexpr_diff_functions", "select concat('wh/services/part_', p_partkey) as module from part where p_partkey % 2 = 0")(lambda s, d: sexpr.query(P.graph(s, d), '(diff-functions "HEAD")', lambda ref: _diff(s, d)))

# A language server's calls and symbols, made of lines of orders and of parts.
query(
    "server_calls",
    "select concat('o',l_orderkey,'::f') as source, concat('m',l_partkey,'::g') as target, string_agg(distinct l_linenumber, ',' order by l_linenumber) as lines from lineitem where l_partkey%2=0 group by l_orderkey, l_partkey",
)(lambda s, d: _server_calls(s, d))


def _server_calls(spark, sf_dir):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    calls = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(text("o", "l_orderkey").alias("source"), F.lit("f").alias("name"), F.concat(text("p", "l_partkey"), F.lit(".py")).alias("path"), F.lit("g").alias("target_name"), F.col("l_linenumber").cast("int").alias("line"))
    paths = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 2 = 0").select(F.concat(text("p", "p_partkey"), F.lit(".py")).alias("path"), text("m", "p_partkey").alias("module"))
    return E.call_edges(calls, paths).select("source", "target", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query(
    "server_symbols",
    "select concat('p',p_partkey) as module, 'T' as name, case when p_partkey%3=0 then 'cls' else 'ifc' end as kind, cast(case when p_partkey%3=0 then 1 else 9 end as int) as line, 'Base' as bases from part union all select concat('p',p_partkey), 'S', 'fn', 5, '' from part where p_partkey%3=1",
)
def _server_symbols(spark, sf_dir):
    """The parser has every T; the server has those of keys not divisible by 3, and an S for some."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("module"), F.col("p_partkey").alias("k"))
    empty = F.array().cast("array<string>")
    shape = lambda df, name, kind, line, bases: df.select("module", F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(line).alias("line"), bases.alias("bases"), empty.alias("deco"), empty.alias("methods"))
    syntax = shape(part, "T", "cls", 1, F.array(F.lit("Base")))
    server = shape(part.filter("k % 3 <> 0"), "T", "ifc", 9, empty).unionByName(shape(part.filter("k % 3 = 1"), "S", "fn", 5, empty))
    return E.merge_symbols(syntax, server).select("module", "name", "kind", "line", F.array_join("bases", ",").alias("bases"))


# String functions over the names of parts.
def _names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct()


query("uri_codec", "select distinct p_name as path, concat('file:///', replace(p_name, ' ', '%20'), '/%C3%A9') as uri, concat('/', p_name, '/é') as back from part")(
    lambda s, d: _names(s, d).withColumn("uri", uri.path_to_uri(F.concat(F.lit("/"), "p_name", F.lit("/é")))).select(F.col("p_name").alias("path"), "uri", uri.uri_to_path("uri").alias("back"))
)
query("name_columns", "select distinct p_name as line, cast(greatest(position('e' in p_name) - 1, 0) as int) as at from part")(lambda s, d: _names(s, d).select(F.col("p_name").alias("line"), classify.column_of(F.lit("e"), F.col("p_name")).alias("at")))
query("kebab_names", "select distinct p_name as name, lower(replace(p_name, ' ', '-')) as kebab from part")(lambda s, d: _names(s, d).select(F.col("p_name").alias("name"), classify.kebab(F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).alias("kebab")))
query(
    "ruby_names",
    "select distinct p_name as name, concat('Api::', array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1]), w[2:])), ''), 'HTTP') as constant, case when p_name like '%ies' then concat(left(p_name, -3), 'y') when p_name like '%sses' then left(p_name, -2) when p_name like '%s' and p_name not like '%ss' then left(p_name, -1) else p_name end as single from part",
)(lambda s, d: _names(s, d).select(F.col("p_name").alias("name"), classify.camelize(F.concat(F.lit("api/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_http")), ("HTTP",)).alias("constant"), classify.singularize(F.col("p_name")).alias("single")))

_CONSTANTS = [("n@/app/models/order_item.rb", "OrderItem"), ("n@/app/models/concerns/http_able.rb", "HTTPAble"), ("n@/app/services/billing/charge.rb", "Billing::Charge"), ("n@/lib/tool.rb", "Tool"), ("n@/spec/x.rb", ""), ("n@/app/models/readme.md", "")]


@query("expected_constants", trees.expected_sql("path, constant", _CONSTANTS))
def _constants(spark, sf_dir):
    expected = F.udf(lambda p: resolve.expected_constant(p, resolve.autoload_roots(p), ["HTTP"]))
    return trees.filled(spark, sf_dir, "path string", [(p,) for p, _ in _CONSTANTS]).select("path", expected("path").alias("constant"))


_PURPOSES = [("domain logic", "domain"), ("The API Controller of @", "api"), ("general module", "other"), ("", "other"), ("repozitory @", "infra"), ("thing of @", "other"), ("React hook", "ui")]
query("layer_by_purpose", trees.expected_sql("purpose, layer", _PURPOSES))(
    lambda s, d: trees.filled(s, d, "purpose string", [(p,) for p, _ in _PURPOSES]).select("purpose", classify.layer_by_purpose(F.col("purpose")).alias("layer"))
)
