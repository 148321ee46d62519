"""Registered queries of the graph engine and their SQL counterparts.

A query is a pair: a function of (spark, sf_dir), and SQL for the same rows where
SQL can express them. SQL shares the projection as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import file_facts
from ..functions import classify
from ..functions.pattern import to_like
from ..operators import edges as E
from ..operators import graph as G
from ..operators import build, infra, lookup, policy, ranges, resolve
from ..operators.scratch import Scratch
from ..sources import factmap, tree
from ..sources import projection as P
from . import sexpr
from .catalog import QUERIES, SQL
from .catalog import query as _query
from .catalog import with_sql as _with

PART = "wh/services/part_10"
SUPPLIER = "wh/infra/supplier_3"
NATION = "wh/domain/nation_3"

def _hop_sql(root: str, depth: int, reverse: bool = False) -> str:
    """Levels 1..depth as CTEs over ``near``."""
    here, there = ("dst_mod", "src_mod") if reverse else ("src_mod", "dst_mod")
    parts = [f"near as (select {here} as here, {there} as there, via from neighbors)", f"l0 as (select '{root}' as module, 0 as depth, '' as via)"]
    for k in range(1, depth + 1):
        seen = " union ".join(f"select module from l{i}" for i in range(k))
        parts.append(f"l{k} as (select near.there as module, {k} as depth, min(near.via) as via from l{k - 1} join near on near.here=l{k - 1}.module where near.there not in ({seen}) group by near.there)")
    rows = " union all ".join(f"select module, cast(depth as int) as depth, via from l{k}" for k in range(1, depth + 1))
    return _with("neighbors", recursive=", ".join(parts)) + rows


def _roots(spark: SparkSession, *modules: str) -> DataFrame:
    return spark.createDataFrame([(m,) for m in modules], "module string")


# Neighbors and boundaries.
_query("neighbors_out", _with("neighbors") + f"select dst_mod as module, via from neighbors where src_mod='{PART}'")(lambda s, d: P.graph(s, d).neighbors.filter(F.col("src_mod") == PART).select(F.col("dst_mod").alias("module"), "via"))
_query("neighbors_in", _with("neighbors") + f"select src_mod as module, via from neighbors where dst_mod='{SUPPLIER}'")(lambda s, d: P.graph(s, d).neighbors.filter(F.col("dst_mod") == SUPPLIER).select(F.col("src_mod").alias("module"), "via"))
_query("neighbors_all", _with("neighbors") + "select src_mod, dst_mod, via from neighbors")(lambda s, d: P.graph(s, d).neighbors)
_BOUNDARY = (
    f"select 'self' as role, module, '' as via from modules where module='{PART}' union all select 'out', dst_mod, via from neighbors where src_mod='{PART}' "
    f"union all select 'in', src_mod, via from neighbors where dst_mod='{PART}'"
)
_query("boundary", _with("neighbors", "modules") + _BOUNDARY)(lambda s, d: G.boundary(P.graph(s, d), PART))
_query("boundary_files", _with("neighbors", "modules") + f"select path, min(cast(case role when 'self' then 0 when 'out' then 1 else 2 end as int)) as rank from ({_BOUNDARY}) b join modules m on m.module=b.module group by path")(lambda s, d: G.boundary_files(P.graph(s, d), PART))
_query(
    "module_view",
    _with("ends", "modules", "entities")
    + f"select 'node' as section, module as name, lang as detail from modules where module='{PART}' union all select 'entity', name, concat(kind,' ',line) from entities where module='{PART}' "
    f"union all select 'out', target, etype from ends where src_mod='{PART}' union all select 'in', source, etype from ends where dst_mod='{PART}' and src_mod<>'{PART}'",
)(lambda s, d: lookup.module_view(P.graph(s, d), PART))


# Resolution and search.
def _resolve_sql(pattern: str) -> str:
    tier = f"case when module='{pattern}' then 1 when right(module, {len(pattern)})='{pattern}' then 2 when position('{pattern}' in module)>0 then 3 when position('{pattern.lower()}' in lower(module))>0 then 4 end"
    return _with("modules") + f"select module, cast(tier as int) as tier from (select module, tier, min(tier) over () as best, row_number() over (partition by tier order by module) as r from (select module, {tier} as tier from modules) x where tier is not null) y where tier=best and (tier<=2 or r<=10)"


for _name, _pattern in (("resolve_exact", "wh/types/region_1"), ("resolve_suffix", "nation_7"), ("resolve_substring", "supplier_1"), ("resolve_ci", "WH/API/Order_1")):
    _query(_name, _resolve_sql(_pattern))(lambda s, d, p=_pattern: lookup.resolve(P.modules(s, d), p))

for _name, _pattern in (("search_modules", "supplier_1.*0"), ("search_anchored", "^part_1.*5$")):
    _like = to_like(_pattern)
    _query(_name, _with("modules") + f"select module from modules where lower(module) like '{_like}' escape '!' or lower(regexp_replace(module,'^.*/','')) like '{_like}' escape '!'")(lambda s, d, p=_pattern: lookup.search(P.modules(s, d), p))
_query("suggest_similar", _with("modules") + "select module, cast(score as int) as score from (select module, " + "+".join(f"cast(position('{p}' in lower(module))>0 as int)" for p in ("wh", "infra", "supplyer", "1")) + " as score from modules) x where score>0 order by score desc, module limit 5")(lambda s, d: lookup.suggest(P.modules(s, d), "wh/infra/supplyer_1"))

# Entities.
_query("entity_defs", _with("entities") + "select module, name, kind, line from entities where name='line3'")(lambda s, d: lookup.entity_definitions(P.graph(s, d), "line3"))
_query("entity_pattern", _with("entities") + "select module, name, kind, line from entities where lower(name) like 'part1%7' escape '!'")(lambda s, d: lookup.entity_definitions(P.graph(s, d), "^part1.*7$"))
_query("entity_refs", _with("ends") + "select etype, source, target from ends where src_ent='line7' or dst_ent='line7'")(lambda s, d: lookup.entity_references(P.graph(s, d), "line7"))
_query("refs_to", _with("ends") + "select distinct src_mod as module from ends where src_ent='line6' or dst_ent='line6'")(lambda s, d: lookup.refs_to(P.graph(s, d), "line6"))
_query("key_entities", _with("ends") + "select name, count(*) as n_refs, count(distinct src_mod) as n_modules from (select src_ent as name, src_mod from ends union all select dst_ent, src_mod from ends) t where name is not null group by name")(lambda s, d: lookup.key_entities(P.graph(s, d)))
_query(
    "find_function",
    _with("entities") + "select distinct concat(module,'::',name) as id, line, 'function' as kind from entities where kind='fn' and name='line1' "
    "union all select concat(e.module,'::',e.name,'.line1'), e.line, 'method' from entities e where kind='cls' and not exists (select 1 from entities f where f.kind='fn' and f.module=e.module and f.name='line1')",
)(lambda s, d: lookup.find_function(P.graph(s, d), "^line1$"))
_query("find_type", _with("entities") + "select module, name, kind, line from entities where kind in ('cls','mod','ifc','typ','enm') and lower(name) like '%a%' escape '!'")(lambda s, d: lookup.find_type(P.graph(s, d), "a"))
_query("entity_uid", _with("entities") + "select distinct module, name, substr(sha1(concat(module,'::',name)),1,8) as uid from entities")(lambda s, d: P.entities(s, d).select("module", "name", classify.entity_uid(F.col("module"), F.col("name")).alias("uid")).distinct())

# Traversal.
for _k in (1, 2, 3):
    _query(f"deps_k{_k}", _hop_sql(PART, _k))(lambda s, d, k=_k: G.hops(P.graph(s, d), _roots(s, PART), k).select("module", "depth", "via"))
for _k in (1, 2):
    _query(f"rdeps_k{_k}", _hop_sql(SUPPLIER, _k, True))(lambda s, d, k=_k: G.hops(P.graph(s, d), _roots(s, SUPPLIER), k, True).select("module", "depth", "via"))
_query("deps_k6_frontier", _hop_sql(PART, 6))(lambda s, d: G.hops(P.graph(s, d), _roots(s, PART), 6).select("module", "depth", "via"))
_query("deps_strict")(lambda s, d: G.walk(P.graph(s, d), _roots(s, PART), 3))
_query("flow_entity")(lambda s, d: G.flow(P.graph(s, d), PART, "line1"))
_query("find_callers", _with("calls") + "select source, target from calls where split_part(target,'::',2) like '%purchase%'")(lambda s, d: lookup.find_callers(P.graph(s, d, True), "purchase"))
_query("find_calls", _with("calls") + "select source, target from calls where split_part(source,'::',2) like '%purchase%'")(lambda s, d: lookup.find_calls(P.graph(s, d, True), "purchase"))


@_query("callchain_hops")
def _callchain(spark, sf_dir):
    calls = P.calls(spark, sf_dir).select("source", "target")
    first = calls.agg(F.min("source").alias("node"))
    last = calls.filter("source like 'ev/u1::%'").agg(F.max("target").alias("node"))
    return G.call_chain(calls, calls.filter("source like 'ev/u1::%'").agg(F.min("source").alias("node")).union(first), last, 3)


_COMMITS = "select concat('c',conv_id,'_',turn) as sha, case when turn>0 then concat('c',conv_id,'_',turn-1) end as first_parent from conversations"


def _commits(spark, sf_dir):
    sha = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(sha(F.col("turn")).alias("sha"), F.when(F.col("turn") > 0, sha(F.col("turn") - 1)).alias("first_parent"))


_query("descendants", f"with recursive commits as ({_COMMITS}), r as (select sha as node, cast(1 as int) as depth from commits where first_parent='c1_0' union select c.sha, r.depth+1 from r join commits c on c.first_parent=r.node) select node, depth from r")(
    lambda s, d: G.closure(_commits(s, d).select(F.col("first_parent").alias("parent"), F.col("sha").alias("child")), s.createDataFrame([("c1_0",)], "node string"))
)

# Policy.
_query("layers", _with("layered") + "select layer, count(*) as n_modules from layered group by layer")(lambda s, d: policy.layers(P.modules(s, d)))
_query("layer_of", _with("layered") + "select module from layered where layer='domain'")(lambda s, d: policy.layered(P.modules(s, d)).filter("layer = 'domain'").select("module"))
_query(
    "boundaries_violations",
    _with("ends", "layered", "deny") + "select e.src_mod as source, e.dst_mod as target, e.etype, s.layer as src_layer, t.layer as dst_layer, d.reason from ends e join layered s on s.module=e.src_mod join layered t on t.module=e.dst_mod join deny d on d.src_layer=s.layer and d.dst_layer=t.layer where e.etype in ('imports','data-flow') and e.src_mod<>e.dst_mod",
)(lambda s, d: policy.violations(P.graph(s, d)))
_query("violations_set", _with("ends", "layered", "deny") + "select distinct e.src_mod as module from ends e join layered s on s.module=e.src_mod join layered t on t.module=e.dst_mod join deny d on d.src_layer=s.layer and d.dst_layer=t.layer where e.etype in ('imports','data-flow') and e.src_mod<>e.dst_mod")(lambda s, d: sexpr.query(P.graph(s, d), "(violations all)"))
_query("v1_purpose_violations", _with("ends", "modules") + "select distinct e.src_mod as source, e.dst_mod as target, 'domain imports infrastructure without abstract base' as detail from ends e join modules s on s.module=e.src_mod join modules t on t.module=e.dst_mod where e.etype='imports' and s.purpose like '%domain%' and t.purpose like '%infrastructure%'")(lambda s, d: policy.purpose_violations(P.graph(s, d)))
_query("invariants", _with("modules") + "select module, lang, pkg, naming as actual, 'PascalCase camelCase kebab-case mixed' as expected from modules where lang='tsx'")(lambda s, d: policy.naming_violations(P.modules(s, d)))
_query("invariants_summary", _with("modules") + "select count(*) filter (lang='tsx') as violations, count(*) as checked from modules")(lambda s, d: policy.naming_summary(P.modules(s, d)))
_NAMES = "select distinct p_name as name from part union select n_name from nation union select r_name from region union select c_mktsegment from customer"
_query(
    "naming_convention",
    f"select name, case when regexp_full_match(name,'[a-z][a-z0-9_]*') then 'snake_case' when regexp_full_match(name,'[a-z][a-z0-9-]*') then 'kebab-case' when regexp_full_match(name,'[A-Z][a-zA-Z0-9]*') then 'PascalCase' when regexp_full_match(name,'[a-z][a-zA-Z0-9]*') then 'camelCase' else 'mixed' end as naming from ({_NAMES}) t",
)(lambda s, d: _names(s, d).select("name", classify.naming(F.col("name")).alias("naming")))


def _names(spark, sf_dir):
    read = lambda t, c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).alias("name"))
    return read("part", "p_name").union(read("nation", "n_name")).union(read("region", "r_name")).union(read("customer", "c_mktsegment")).distinct()


# One letter is missing from a keyword; no other word of a type is as near to one.
_query("layer_by_purpose_fuzzy", "select distinct lower(p_type) as purpose, 'service' as layer from part")(lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_type").distinct().select(F.lower("p_type").alias("purpose"), classify.layer_by_purpose(F.concat(F.lit("servce "), "p_type")).alias("layer")))
_query(
    "analyze_summary",
    _with("ends", "entities") + f"select concat('out:',etype) as metric, count(distinct target) as n from ends where src_mod='{PART}' and dst_mod<>'{PART}' group by etype union all select concat('in:', case when etype='imports' then 'imports' else 'refs' end), count(distinct src_mod) from ends where dst_mod='{PART}' and src_mod<>'{PART}' group by 1 union all select 'entities', count(*) from entities where module='{PART}'",
)(lambda s, d: policy.analyze_summary(P.graph(s, d), PART))
_query("analyze_dependents", _with("ends") + f"select distinct src_mod as module, case when etype='imports' then 'imports' else 'refs' end as relation from ends where dst_mod='{SUPPLIER}' and src_mod<>'{SUPPLIER}'")(lambda s, d: policy.analyze_dependents(P.graph(s, d), SUPPLIER))
_query("import_layers", _with("ends", "layered") + f"select distinct e.dst_mod as module, l.layer from ends e left join layered l on l.module=e.dst_mod where e.src_mod='{NATION}' and e.etype='imports' and e.dst_mod<>'{NATION}'")(lambda s, d: policy.import_layers(P.graph(s, d), NATION))
_query("id_collisions", _with("modules") + "select stem as module, count(distinct path) as n_paths from (select regexp_replace(module,'_[0-9]$','') as stem, path from modules) t group by stem having count(distinct path)>1")(lambda s, d: policy.id_collisions(P.modules(s, d).withColumn("module", F.regexp_replace("module", "_[0-9]$", ""))))
_query("incremental_changed", "select concat('d',doc_id) as path, md5(text) as content_hash from documents where doc_id%3=0 or lang='fr'")(
    lambda s, d: policy.changed(_hashed(s, d), _hashed(s, d, "not (doc_id % 3 = 0 or lang = 'fr')"))
)


def _hashed(spark, sf_dir, where="true"):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(where)
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.md5(F.col("text").cast("binary")).alias("content_hash"))


# Set algebra and the query language.
_DEPENDENTS = "select distinct src_mod as module from neighbors where dst_mod='wh/infra/supplier_{}'"
for _name, _op, _word in (("set_intersect", "intersect", "intersect"), ("set_union", "union", "union"), ("set_diff", "diff", "except")):
    _query(_name, _with("neighbors") + _DEPENDENTS.format(3) + f" {_word} " + _DEPENDENTS.format(4))(lambda s, d, op=_op: sexpr.query(P.graph(s, d), f'({op} (dependents "wh/infra/supplier_3") (dependents "wh/infra/supplier_4"))'))
_query("set_filter", _with("neighbors") + f"select module from ({_DEPENDENTS.format(3)}) t where lower(module) like '%part!_1%' escape '!'")(lambda s, d: sexpr.query(P.graph(s, d), '(filter (dependents "wh/infra/supplier_3") "part_1")'))
_query("set_count", _with("neighbors") + f"select count(*) as n from ({_DEPENDENTS.format(3)}) t")(lambda s, d: sexpr.query(P.graph(s, d), '(count (dependents "wh/infra/supplier_3"))'))
_query("sexpr_nested", _with("neighbors", "modules") + f"select distinct m.path from (select module from ({_DEPENDENTS.format(3)}) a union select module from ({_DEPENDENTS.format(4)}) b) t join modules m on m.module=t.module where m.path like '%part%'")(
    lambda s, d: sexpr.query(P.graph(s, d), '(files (filter (union (dependents "wh/infra/supplier_3") (dependents "wh/infra/supplier_4")) "part"))')
)
_query("sexpr_layer", _with("layered") + "select layer from layered where module='wh/domain/nation_3'")(lambda s, d: sexpr.query(P.graph(s, d), '(layer "wh/domain/nation_3")'))
_query("sexpr_boundary", _with("neighbors") + f"select '{PART}' as module union select dst_mod from neighbors where src_mod='{PART}' union select src_mod from neighbors where dst_mod='{PART}'")(lambda s, d: sexpr.query(P.graph(s, d), f'(boundary "{PART}")'))

# Lines and intervals. Every tenth line of a document starts an entity.
_STARTS = "select doc_id, concat('fn', line_no) as name, line_no from lines where line_no%10=1"


def _files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def _starts(spark, sf_dir):
    n = F.size(F.split("content", "\n"))
    rows = _files(spark, sf_dir).select("path", F.explode(F.sequence(F.lit(1), n, F.lit(10))).alias("line"))
    return rows.select("path", F.concat(F.lit("fn"), F.col("line").cast("string")).alias("name"), "line")


_query("grep_lines", _with("lines") + "select concat('d',doc_id) as path, concat('fn', ((line_no-1)//10)*10+1) as name, cast(line_no as int) as line_no, line from lines where lower(line) like '%that%the%' escape '!'")(lambda s, d: ranges.grep(_files(s, d), _starts(s, d), "that.*the"))
_query(
    "enclosing_entity_asof",
    _with("lines") + "select concat('d',doc_id) as path, line_no*7 as ref_id, cast(line_no as int) as ref_line, concat('fn', ((line_no-1)//10)*10+1) as name from lines",
)(lambda s, d: ranges.enclosing(ranges.source_lines(_files(s, d)).select("path", (F.col("line_no") * 7).alias("ref_id"), F.col("line_no").alias("ref_line")), _starts(s, d)))
_query(
    "diff_overlap",
    _with("lines", recursive=f"starts as ({_STARTS}), bodies as (select doc_id, name, line_no as a, coalesce(lead(line_no) over (partition by doc_id order by line_no)-1, line_no+200) as b from starts)") + "select distinct concat('d',doc_id) as path, name, cast(a as int) as line from bodies where a<=doc_id%40+3 and b>=doc_id%40+1",
)(
    lambda s, d: ranges.changed_entities(
        s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 40 + 1).cast("int").alias("start"), (F.col("doc_id") % 40 + 3).cast("int").alias("end")), _starts(s, d)
    )
)

# Edge builders.
_query(
    "import_edges_relations",
    "select concat('p',l_partkey) as source, concat('s',l_suppkey) as target, string_agg(distinct l_returnflag, ',' order by l_returnflag) as relations, l_suppkey%5=0 as via_base from lineitem group by l_partkey, l_suppkey",
)(lambda s, d: _import_edges(s, d))


def _import_edges(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    resolved = line.select(name("p", "l_partkey").alias("source"), name("s", "l_suppkey").alias("target"), F.col("l_returnflag").alias("relation"))
    abstract = line.filter("l_suppkey % 5 = 0").select(name("s", "l_suppkey").alias("module")).distinct()
    return E.import_edges(resolved, abstract).select("source", "target", F.array_join("relations", ",").alias("relations"), "via_base")


_query("provider_unique", "select concat(p_brand,p_size) as symbol, min(concat('p',p_partkey)) as module from part group by 1 having count(distinct p_partkey)=1")(
    lambda s, d: E.unique_providers(s.read.parquet(f"{d}/part.parquet").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("symbol"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("module")))
)
_ASKED = "select distinct concat('o',l_orderkey) as source, concat('t',l_suppkey%50) as symbol from lineitem where l_linenumber<=2"
_query(
    "calls_api_edges",
    f"with asked as ({_ASKED}), imp as (select source, symbol, t from (select concat('o',l_orderkey) as source, concat('t',l_suppkey%50) as symbol, case when l_returnflag='N' then null else concat('m',l_partkey%9) end as t, row_number() over (partition by l_orderkey, l_suppkey%50 order by l_linenumber, l_partkey, l_suppkey) as r from lineitem where l_linenumber=1) x where r=1), "
    "prov as (select symbol, min(module) as module from (select distinct concat('t',s_suppkey%50) as symbol, concat('m',s_nationkey) as module from supplier) y group by symbol having count(*)=1) "
    "select distinct a.source, coalesce(case when i.source is not null then i.t end, case when i.source is null then p.module end) as target from asked a left join imp i on i.source=a.source and i.symbol=a.symbol left join prov p on p.symbol=a.symbol where case when i.source is not null then i.t else p.module end is not null",
)(lambda s, d: _api_edges(s, d))


def _api_edges(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    keyed = line.select(text("o", F.col("l_orderkey")).alias("source"), text("t", F.col("l_suppkey") % 50).alias("symbol"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    imports = keyed.filter("l_linenumber = 1").select("source", "symbol", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.when(F.col("l_returnflag") == "N", None).otherwise(text("m", F.col("l_partkey") % 9)).alias("target"))
    candidates = supplier.select(text("t", F.col("s_suppkey") % 50).alias("symbol"), text("m", F.col("s_nationkey")).alias("module")).distinct()
    return E.api_edges(E.resolve_symbols(keyed.filter("l_linenumber <= 2"), imports, candidates))


_query("data_flow_edges", "select distinct concat('o',l_orderkey) as source, concat('p',l_partkey) as target from lineitem join part on p_partkey=l_partkey where p_size>40")(
    lambda s, d: E.data_flow_edges(
        s.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target")),
        s.read.parquet(f"{d}/part.parquet").filter("p_size > 40").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("module")),
    )
)
# Every brand asks for the names of its own parts (one entity or several), for their last parts, for the
# names of the parts behind (exported or unknown there), and for its default.
_query(
    "reference_target_tiers",
    "with p as (select concat('b',p_brand) as target, p_name as name, p_partkey as k from part), "
    "e as (select target, case when k%3=0 then concat('Mod::',name) else name end as name, k from p), x as (select target, concat(name,'!') as name, k from p where k%2=0), "
    "q as (select target, name as original, name as local from p union select p.target, concat(n.name,'!'), concat(n.name,'!') from p join p n on n.k=p.k+1 union select target, 'default', 'none' from p), "
    "c as (select q.target, q.original, q.local, count(*) filter (e.name=q.original) as n1, count(*) filter (regexp_extract(e.name,'[^:]*$')=q.original) as n2, min(e.name) filter (e.name=q.original) as e1, min(e.name) filter (regexp_extract(e.name,'[^:]*$')=q.original) as e2 "
    "from q left join e on e.target=q.target group by all) "
    "select * from (select c.target, c.original, c.local, coalesce(case when n1=1 then e1 when n1=0 and n2=1 then e2 end, case when exists (select 1 from x where x.target=c.target and x.name=c.original) then c.original when c.original='default' then (select min_by(x.name, x.k) from x where x.target=c.target) end) as entity from c) r where entity is not null",
)(lambda s, d: _tiers(s, d))


def _tiers(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("b"), "p_brand").alias("target"), F.col("p_name").alias("name"), F.col("p_partkey").alias("k"))
    shown = lambda c: (c.alias("original"), c.alias("local"))
    entities = part.select(F.col("target").alias("module"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("Mod::"), "name")).otherwise(F.col("name")).alias("name"))
    exported = part.filter("k % 2 = 0").select(F.col("target").alias("module"), F.concat("name", F.lit("!")).alias("name"), F.col("k").alias("ord"))
    behind = part.select("target", (F.col("k") + 1).alias("k")).join(part.select("k", F.concat("name", F.lit("!")).alias("n")), "k")
    asked = part.select("target", *shown(F.col("name"))).unionByName(behind.select("target", *shown(F.col("n")))).unionByName(part.select("target", F.lit("default").alias("original"), F.lit("none").alias("local")))
    return E.target_entities(asked.distinct(), entities, exported)


_query(
    "http_call_prefix_join",
    "with c as (select concat('p',p_partkey) as module, p_brand as repo, lower(split_part(p_name,' ',1)) as k, concat(split_part(p_name,' ',1),'Client') as name from part), r as (select distinct split_part(p_name,' ',2) as repo from part union select distinct split_part(p_name,' ',1) from part) "
    "select module as source, target, min(name) as client from (select c.module, c.name, min(r.repo) as target from c join r on starts_with(c.k, lower(r.repo)) or starts_with(lower(r.repo), c.k) where r.repo<>c.repo group by 1,2) t group by 1,2",
)(lambda s, d: _http(s, d))


def _http(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    word = lambda n: F.split_part(F.col("p_name"), F.lit(" "), F.lit(n))
    clients = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("module"), F.col("p_brand").alias("repo"), F.concat(word(1), F.lit("Client")).alias("name"))
    return E.http_edges(clients, part.select(word(1).alias("repo")).union(part.select(word(2))).distinct())


_query(
    "lsp_merge_outer",
    "with a as (select distinct concat('o',l_orderkey) as source, concat('p',l_partkey) as target from lineitem where l_linenumber<=3), b as (select distinct concat('o',l_orderkey) as source, concat('p',l_partkey) as target from lineitem where l_linenumber>=3) "
    "select coalesce(a.source,b.source) as source, coalesce(a.target,b.target) as target, 'calls' as etype, b.source is not null as lsp from a full join b on a.source=b.source and a.target=b.target",
)(lambda s, d: E.merge_verified(_order_parts(s, d, "l_linenumber <= 3"), _order_parts(s, d, "l_linenumber >= 3")))


def _order_parts(spark, sf_dir, where):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter(where)
    return line.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.lit("calls").alias("etype"))


def _by_language(spark, sf_dir):
    """The whole graph with its languages as packages: six prefixes, of which two collide."""
    whole = P.graph(spark, sf_dir)
    return G.Graph(whole.modules.withColumn("pkg", F.col("lang")), whole.entities, whole.edges)


_query("short_ids", _with("sids") + "select module, sid, pkg from sids")(lambda s, d: E.short_ids(_by_language(s, d).modules))
_query("short_ids_all")(lambda s, d: E.short_ids(P.modules(s, d)))

# Infrastructure.
_ENV = "select distinct concat(upper(replace(p_name,' ','_')), case p_size%4 when 0 then '_HOST' when 1 then '_URL' when 2 then '_SERVICE_HOST' else '_PORT' end) as env from part union select 'DATABASE_URL' union select 'REDIS_URI' union select 'NATS_URL' union select 'S3_ENDPOINT_X'"
_query(
    "infra_env_deps",
    f"select env, case when env='DATABASE_URL' then 'postgres' when env='REDIS_URI' then 'redis' when env='NATS_URL' then 'nats' when env='S3_ENDPOINT_X' then 'minio' when env like '%!_HOST' escape '!' then lower(replace(regexp_replace(env,'_HOST$',''),'_','-')) else lower(replace(regexp_replace(env,'_URL$',''),'_','-')) end as dep, case when env in ('DATABASE_URL','REDIS_URI','NATS_URL') then 'tcp' else 'http' end as transport from ({_ENV}) t where not env like '%!_PORT' escape '!'",
)(lambda s, d: _env_deps(s, d))


def _env_deps(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tail = F.element_at(F.array(*map(F.lit, ("_HOST", "_URL", "_SERVICE_HOST", "_PORT"))), F.col("p_size") % 4 + 1)
    names = part.select(F.concat(F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))), tail).alias("env"))
    more = spark.createDataFrame([("DATABASE_URL",), ("REDIS_URI",), ("NATS_URL",), ("S3_ENDPOINT_X",)], "env string")
    dep = infra.env_dependency(F.col("env"))
    return names.union(more).distinct().select("env", dep["dep"].alias("dep"), dep["transport"].alias("transport")).filter("dep is not null")


_query("infra_image_base", "select distinct concat('reg.io/', lower(replace(p_brand,'#','')), '/', replace(p_name,' ','-'), ':v', p_size) as image, replace(p_name,' ','-') as base from part")(
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("reg.io/"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit(":v"), F.col("p_size").cast("string")).alias("image")).distinct().select("image", infra.image_base(F.col("image")).alias("base"))
)


# Manifests made of the tables' rows: a deployment for each part, a directory of modules for each nation.
def _deployments(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("kind: Deployment\nmetadata:\n  name: part-"), key, F.lit("\nspec:\n  template:\n    spec:\n      containers:\n      - image: reg/"), F.col("p_brand"), F.lit(":v"), F.col("p_size").cast("string"),
        F.lit("\n        ports:\n        - containerPort: "), (F.col("p_size") + 8000).cast("string"), F.lit("\n        env:\n        - name: REDIS_URL\n        - name: PLAIN\n"),
    )
    folder = F.concat(F.lit("k8s/p"), key)
    kustomize = part.select(F.concat(folder, F.lit("/kustomization.yaml")).alias("path"), F.lit("resources:\n- .\n").alias("content"))
    return kustomize.unionByName(part.select(F.concat(folder, F.lit("/deployment.yaml")).alias("path"), text.alias("content")))


def _terraform(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    n, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    text = F.concat(F.lit('module "n'), n, F.lit('" {\n  source = "./n"\n  dep = module.r'), r, F.lit('.id\n}\nmodule "r'), r, F.lit('" {\n  source = "./r"\n}\nresource "kind" "res'), n, F.lit('" {\n}\n'))
    return nation.select(F.concat(F.lit("tf/"), n, F.lit("/main.tf")).alias("path"), text.alias("content"))


_query("infra_kustomize_nodes", "select concat('infra/part-',p_partkey) as id, 'deployment' as kind, concat('reg/',p_brand,':v',p_size) as image, cast(p_size+8000 as int) as port, '' as component, concat('k8s/p',p_partkey,'/deployment.yaml') as source_file from part")(lambda s, d: infra.topology(_deployments(s, d))[0])
_query("infra_kustomize_edges", "select concat('infra/part-',p_partkey) as source, 'infra/redis' as target, 'k8s-depends' as edge_type, 'env' as via, 'tcp' as transport, '' as extra from part union all select concat('infra/part-',p_partkey), p_brand, 'infra-maps', 'image-name', '', '' from part")(lambda s, d: infra.topology(_deployments(s, d))[1])
_query(
    "infra_terraform_nodes",
    "select id, 'terraform' as kind, '' as image, cast(0 as int) as port, component, min(concat('tf/',k)) as source_file from (select concat('infra/tf-n',n_nationkey) as id, 'module' as component, n_nationkey as k from nation "
    "union all select concat('infra/tf-res',n_nationkey), 'kind', n_nationkey from nation union all select concat('infra/tf-r',n_regionkey), 'module', n_nationkey from nation) t group by id, component",
)(lambda s, d: infra.topology(_terraform(s, d))[0])
_query("infra_terraform_edges", "select concat('infra/tf-n',n_nationkey) as source, concat('infra/tf-r',n_regionkey) as target, 'module-reference' as via from nation")(lambda s, d: infra.topology(_terraform(s, d))[1].select("source", "target", "via"))

# Sources made of the tables' rows.
_LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "tsx", "rb": "ruby", "go": "go", "java": "java"}


def _empty_sources(spark, sf_dir):
    language = F.create_map(*[F.lit(x) for pair in _LANGUAGES.items() for x in pair])
    return P.modules(spark, sf_dir).select("path", language[F.col("lang")].alias("language"), F.lit("repo").alias("repo"), F.lit("").alias("content"))


_query("module_ids", _with("modules") + "select path, module from modules")(lambda s, d: P.modules(s, d).select("path", tree.module_id(F.col("path"), tree.language(F.col("path"))).alias("module")))
_query(
    "purpose_inferred",
    _with("modules") + "select path, case lang when 'ts' then 'domain logic' when 'tsx' then 'UI component' when 'rb' then 'infrastructure adapter' when 'go' then 'service' when 'java' then 'API layer' else 'general module' end as purpose, naming from modules",
)(lambda s, d: file_facts(_empty_sources(s, d)).select("path", "purpose", "naming"))


def _sources(spark, sf_dir):
    """A package for each nation: a module with a class, and one for each supplier that imports it."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("n"))
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").cast("string").alias("n"))
    shape = lambda df, path, text: df.select(path.alias("path"), F.lit("python").alias("language"), F.lit("repo").alias("repo"), text.alias("content"))
    base = shape(nation, F.concat(F.lit("src/n"), "n", F.lit("/base.py")), F.concat(F.lit("class Port(Protocol):\n    def run(self): ...\n\ndef make"), "n", F.lit("():\n    return 1\n")))
    user = shape(supplier, F.concat(F.lit("src/n"), "n", F.lit("/s"), "k", F.lit(".py")), F.concat(F.lit("from .base import Port\nimport json\n\nclass Impl"), "k", F.lit("(Port):\n    def run(self):\n        return 2\n")))
    return base.unionByName(user)


_query("extract_python", "select concat('src/n',n_nationkey,'/base') as module, 'Port' as name, 'cls' as kind, cast(1 as int) as line from nation union all select concat('src/n',n_nationkey,'/base'), concat('make',n_nationkey), 'fn', 4 from nation union all select concat('src/n',s_nationkey,'/s',s_suppkey), concat('Impl',s_suppkey), 'cls', 4 from supplier")(
    lambda s, d: build.entities_of(file_facts(_sources(s, d))).select("module", "name", "kind", "line")
)
_query(
    "build_edges",
    "with p as (select concat('src/n',s_nationkey,'/s',s_suppkey) as m, concat('src/n',s_nationkey,'/base') as b, s_suppkey as k from supplier) select 'imports' as etype, m as source, b as target from p union all select 'calls-api', m, b from p union all select 'refs', concat(m,'::Impl',k), concat(b,'::Port') from p",
)(lambda s, d: build.build(file_facts(_sources(s, d)), resolve.Configs([])).edges.select("etype", "source", "target"))
# Facts as text, and written and read again as one file.
_ATOM = "case when {0} like '% %' then concat('\"',{0},'\"') else {0} end"
_facts = lambda part: lambda s, d: factmap.fact_text(_by_language(s, d)).filter(F.col("part") == part).select("fact")
_query("fact_nodes", _with("sids", "modules") + "select concat('(node ',sid,' ',lang,' \"',purpose,'\" :naming snake_case :pkg ',lang,')') as fact from modules join sids using (module)")(_facts(2))
_query(
    "fact_entities",
    _with("sids", "entities") + f"select concat('(',kind,' ',coalesce(sid,e.module),' ',{_ATOM.format('name')},' ',line,case kind when 'cls' then ' (:methods price line1)' else '' end,')') as fact from entities e left join sids s on s.module=e.module",
)(_facts(3))
_query(
    "fact_edges",
    _with("sids", "ends") + "select concat('(',etype,' ',coalesce(s.sid,src_mod),coalesce('::'||src_ent,''),' ',coalesce(t.sid,dst_mod),coalesce('::'||dst_ent,''),')') as fact from ends left join sids s on s.module=src_mod left join sids t on t.module=dst_mod",
)(_facts(4))
_query("fact_lines_all")(lambda s, d: factmap.fact_text(P.graph(s, d)).select("part", "fact"))
_WRITTEN: dict[tuple[str, str, bool], G.Graph] = {}


def _rewritten(spark, sf_dir, trie=False):
    """The whole graph written as a map file and read back, once for each folder."""
    key = (spark.sparkContext.applicationId, sf_dir, trie)
    if key not in _WRITTEN:
        path = Scratch(spark).folder.removeprefix("file:") + ".sexp"
        factmap.write_map(P.graph(spark, sf_dir), path, trie)
        _WRITTEN[key] = factmap.read_map(spark, path)
    return _WRITTEN[key]


_query("factmap_roundtrip", _with("modules") + "select module, lang, pkg, purpose from modules")(lambda s, d: _rewritten(s, d).modules.select("module", "lang", "pkg", "purpose"))
_query("factmap_trie_roundtrip", _with("modules") + "select module, lang, pkg, purpose from modules")(lambda s, d: _rewritten(s, d, True).modules.select("module", "lang", "pkg", "purpose"))
_query("factmap_roundtrip_entities", _with("entities") + "select module, name, kind, line from entities")(lambda s, d: _rewritten(s, d).entities.select("module", "name", "kind", "line"))
_query("factmap_roundtrip_edges", _with("edges") + "select etype, source, target from edges")(lambda s, d: _rewritten(s, d, True).edges.select("etype", "source", "target"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["boundary"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from . import graphs, tree_queries  # noqa: E402, F401  they add their queries
