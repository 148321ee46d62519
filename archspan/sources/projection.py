"""The supplied star-schema tables seen as an architecture graph.

Those tables hold no source code, so the graph operators run over this
projection. Each piece exists twice, as DataFrames and as SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph

_EMPTY = "cast(array() as array<string>)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


MODULE_PARTS = (
    # table, prefix, key, extension, language, package, purpose
    ("region", "wh/types/region_", "r_regionkey", ".py", "py", "r_name", "type definitions"),
    ("nation", "wh/domain/nation_", "n_nationkey", ".ts", "ts", "n_name", "domain logic"),
    ("customer", "wh/components/customer_", "c_custkey", ".tsx", "tsx", "c_mktsegment", "UI component"),
    ("supplier", "wh/infra/supplier_", "s_suppkey", ".rb", "rb", "s_name", "infrastructure adapter"),
    ("part", "wh/services/part_", "p_partkey", ".go", "go", "p_brand", "service"),
    ("orders", "wh/api/order_", "o_orderkey", ".java", "java", "o_orderpriority", "API controller"),
)


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, prefix, key, ext, lang, pkg, purpose in MODULE_PARTS:
        part = _table(spark, sf_dir, table).select(
            _id(prefix, key).alias("module"), F.concat(_id(prefix, key), F.lit(ext)).alias("path"), F.lit(lang).alias("lang"), F.col(pkg).alias("pkg"), F.lit(purpose).alias("purpose"), F.lit("snake_case").alias("naming")
        )
        out = part if out is None else out.unionByName(part)
    return out


MODULES_SQL = " union all ".join(
    f"select concat('{prefix}',{key}) as module, concat('{prefix}',{key},'{ext}') as path, '{lang}' as lang, {pkg} as pkg, '{purpose}' as purpose, 'snake_case' as naming from {table}"
    for table, prefix, key, ext, lang, pkg, purpose in MODULE_PARTS
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: _table(spark, sf_dir, name)
    pair = lambda kind, a, b: (F.lit(kind).alias("etype"), a.alias("source"), b.alias("target"))
    line = read("lineitem")
    parts = [
        read("nation").select(*pair("imports", _id("wh/domain/nation_", "n_nationkey"), _id("wh/types/region_", "n_regionkey"))),
        read("customer").select(*pair("imports", _id("wh/components/customer_", "c_custkey"), _id("wh/domain/nation_", "c_nationkey"))),
        read("supplier").select(*pair("imports", _id("wh/infra/supplier_", "s_suppkey"), _id("wh/domain/nation_", "s_nationkey"))),
        read("orders").select(*pair("imports", _id("wh/api/order_", "o_orderkey"), _id("wh/components/customer_", "o_custkey"))),
        line.select(*pair("refs", _id("wh/api/order_", "l_orderkey"), F.concat(_id("wh/services/part_", "l_partkey"), _id("::line", "l_linenumber")))).distinct(),
        line.filter("l_linenumber = 1").select(*pair("data-flow", _id("wh/services/part_", "l_partkey"), _id("wh/infra/supplier_", "l_suppkey"))).distinct(),
        read("supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k")).select(*pair("imports", _id("wh/domain/nation_", "s_nationkey"), _id("wh/infra/supplier_", "k"))),
        line.filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.min("l_orderkey").alias("k")).select(*pair("imports", _id("wh/services/part_", "l_partkey"), _id("wh/api/order_", "k"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


EDGES_SQL = """
select 'imports' as etype, concat('wh/domain/nation_',n_nationkey) as source, concat('wh/types/region_',n_regionkey) as target from nation
union all select 'imports', concat('wh/components/customer_',c_custkey), concat('wh/domain/nation_',c_nationkey) from customer
union all select 'imports', concat('wh/infra/supplier_',s_suppkey), concat('wh/domain/nation_',s_nationkey) from supplier
union all select 'imports', concat('wh/api/order_',o_orderkey), concat('wh/components/customer_',o_custkey) from orders
union all select distinct 'refs', concat('wh/api/order_',l_orderkey), concat('wh/services/part_',l_partkey,'::line',l_linenumber) from lineitem
union all select distinct 'data-flow', concat('wh/services/part_',l_partkey), concat('wh/infra/supplier_',l_suppkey) from lineitem where l_linenumber=1
union all select 'imports', concat('wh/domain/nation_',s_nationkey), concat('wh/infra/supplier_',min(s_suppkey)) from supplier group by s_nationkey
union all select 'imports', concat('wh/services/part_',l_partkey), concat('wh/api/order_',min(l_orderkey)) from lineitem where l_returnflag='R' group by l_partkey
"""
NEIGHBORS_SQL = """select src_mod, dst_mod, min(etype) as via from (select split_part(source,'::',1) as src_mod, split_part(target,'::',1) as dst_mod, etype from edges) t
where src_mod<>dst_mod group by src_mod, dst_mod"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive events of a user as calls: (source, target, n_calls)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = _table(spark, sf_dir, "events").select("user_id", "event_type", F.lead("event_type").over(order).alias("nx")).filter("nx is not null")
    name = lambda c: F.concat(_id("ev/u", "user_id"), F.lit("::"), F.col(c))
    return steps.groupBy(name("event_type").alias("source"), name("nx").alias("target")).agg(F.count(F.lit(1)).alias("n_calls"))


CALLS_SQL = """select source, target, count(*) as n_calls from (
select concat('ev/u',user_id,'::',event_type) as source, concat('ev/u',user_id,'::',nx) as target, nx from (
select user_id, event_type, lead(event_type) over (partition by user_id order by ts,event_id) as nx from events) e) t where nx is not null group by source, target"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of parts and event types as functions, parts as classes, regions as types."""
    empty = F.expr(_EMPTY)
    shape = lambda df, kind, methods=empty: df.select("module", "name", F.lit(kind).alias("kind"), F.col("line").cast("int").alias("line"), empty.alias("bases"), empty.alias("deco"), methods.alias("methods"))
    lines = _table(spark, sf_dir, "lineitem").select(_id("wh/services/part_", "l_partkey").alias("module"), _id("line", "l_linenumber").alias("name"), F.col("l_linenumber").alias("line")).distinct()
    parts = _table(spark, sf_dir, "part").select(_id("wh/services/part_", "p_partkey").alias("module"), _id("Part", "p_partkey").alias("name"), F.lit(0).alias("line"))
    types = _table(spark, sf_dir, "region").select(_id("wh/types/region_", "r_regionkey").alias("module"), F.col("r_name").alias("name"), F.lit(1).alias("line"))
    events = _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.lit(1).alias("line")).select(_id("ev/u", "user_id").alias("module"), F.col("event_type").alias("name"), "line")
    return shape(lines, "fn").unionByName(shape(parts, "cls", F.array(F.lit("price"), F.lit("line1")))).unionByName(shape(types, "typ")).unionByName(shape(events, "fn"))


ENTITIES_SQL = """select distinct concat('wh/services/part_',l_partkey) as module, concat('line',l_linenumber) as name, 'fn' as kind, cast(l_linenumber as int) as line from lineitem
union all select concat('wh/services/part_',p_partkey), concat('Part',p_partkey), 'cls', 0 from part
union all select concat('wh/types/region_',r_regionkey), r_name, 'typ', 1 from region
union all select distinct concat('ev/u',user_id), event_type, 'fn', 1 from events"""


#: Projected graphs that are kept, by application, folder and whether calls are in.
_KEPT: dict[tuple[str, str, bool], Graph] = {}


def graph(spark: SparkSession, sf_dir: str, with_calls: bool = False) -> Graph:
    """The projected graph; ``with_calls`` adds the calls between event types.

    Its edges are kept by the executors, one copy for each folder until ``release``.
    """
    key = (spark.sparkContext.applicationId, sf_dir, with_calls)
    if key not in _KEPT:
        every = edges(spark, sf_dir)
        if with_calls:
            every = every.unionByName(calls(spark, sf_dir).select(F.lit("calls").alias("etype"), "source", "target"))
        _KEPT[key] = Graph(modules(spark, sf_dir), entities(spark, sf_dir), every).cached()
    return _KEPT[key]


def release() -> None:
    """Free the kept edges."""
    for found in _KEPT.values():
        found.edges.unpersist()
    _KEPT.clear()
