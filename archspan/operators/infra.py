"""Infrastructure topology from manifests: Kustomize, Helm and Terraform.

Input is a DataFrame of files (path, content). YAML is parsed once by an Arrow UDF into
JSON; everything after is joins and Column expressions. Where a name may mean
several nodes the least one is taken.
"""

from __future__ import annotations

import json
import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .graph import FRONTIER_BYTES, FRONTIER_ROW
from .scratch import Scratch

# Environment names, the dependency they mean and its transport.
ENV_RULES = (
    (r"^(?:DATABASE_URL|POSTGRES_HOST|POSTGRES_URL|PG_HOST|PG_URL|PGHOST)", "postgres", "tcp"),
    (r"^(?:RABBITMQ_HOST|RABBITMQ_URL|AMQP_HOST|AMQP_URL|AMQP_URI)", "rabbitmq", "amqp"),
    (r"^(?:NATS_URL|NATS_HOST|NATS_URI)", "nats", "tcp"),
    (r"^(?:REDIS_HOST|REDIS_URL|REDIS_URI)", "redis", "tcp"),
    (r"^(?:S3_ENDPOINT|S3_HOST|MINIO_HOST|MINIO_URL|AWS_S3_ENDPOINT)", "minio", "http"),
    (r"^(?:VAULT_ADDR|VAULT_HOST|VAULT_URL)", "vault", "http"),
)
#: Name endings of a service reference; the first that fits cuts the shortest name.
SERVICE_ENV = r"^(.+?)(?:_HOST|_URL|_ENDPOINT)$"
# Manifest names in order of preference, and skipped directories.
KUSTOMIZATIONS = ("kustomization.yaml", "kustomization.yml")
WORKLOADS = ("deployment.yaml", "deployment.yml", "statefulset.yaml", "statefulset.yml")
SERVICES = ("service.yaml", "service.yml")
SKIP_DIRS = ("node_modules", ".git", ".venv", "dist", "build", "coverage", "target", "__pycache__")

NODE_COLUMNS = ("id", "kind", "image", "port", "component", "source_file")
EDGE_COLUMNS = ("source", "target", "edge_type", "via", "transport", "extra")


def env_dependency(name: Column) -> Column:
    """Struct (dep, transport) that an environment variable's name implies, or null fields."""
    dep, transport = F, F
    for pattern, kind, way in ENV_RULES:
        hit = name.rlike(pattern)
        dep, transport = dep.when(hit, F.lit(kind)), transport.when(hit, F.lit(way))
    service = F.nullif(F.regexp_extract(name, SERVICE_ENV, 1), F.lit(""))
    dep = dep.otherwise(F.lower(F.replace(service, F.lit("_"), F.lit("-"))))
    transport = transport.when(service.isNotNull(), F.lit("http")).otherwise(F.lit(None).cast("string"))
    return F.struct(dep.alias("dep"), transport.alias("transport"))


def image_base(image: Column) -> Column:
    """Last path segment of an image without its tag."""
    return F.element_at(F.split(F.substring_index(image, ":", 1), "/"), -1)


@F.pandas_udf(T.StringType())
def yaml_to_json(text: pd.Series) -> pd.Series:
    """First YAML document as JSON if it is a mapping, else null."""
    import yaml

    def load(raw: str):
        if yaml.__with_libyaml__:
            try:
                return yaml.load(raw, yaml.CSafeLoader)
            except yaml.YAMLError:
                pass  # what libyaml refuses is left to the other parser
        return yaml.safe_load(raw)

    def one(raw: str | None) -> str | None:
        if raw is None:
            return None
        try:
            data = load(raw)
        except yaml.YAMLError:
            return None
        return json.dumps(data, default=str) if isinstance(data, dict) else None

    return text.map(one)


@F.pandas_udf(T.StringType())
def normal_path(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else posixpath.normpath(p))


def _dir(path: str = "path") -> Column:
    return F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _base(path: str = "path") -> Column:
    return F.substring_index(path, "/", -1)


def kept(files: DataFrame) -> DataFrame:
    """Files outside the skipped directories."""
    ship(files.sparkSession)
    return files.filter(~F.arrays_overlap(F.split(_dir(), "/"), F.array(*map(F.lit, SKIP_DIRS))))


def _preferred(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(dir, path, content) of the first name that a directory holds."""
    rank = F.array_position(F.array(*map(F.lit, names)), _base())
    ranked = files.filter(_base().isin(*names)).select(_dir().alias("dir"), "path", "content", rank.alias("_r"))
    order = Window.partitionBy("dir").orderBy("_r")
    return ranked.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_r")


def _parts(name: str, sizes: list[int]) -> Column:
    """All different parts of a text that have one of some lengths."""
    size = F.length(name)
    starting = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(F.col(name), i, F.lit(n)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(none, *[F.when(size >= n, starting(n)).otherwise(none) for n in sizes])))


def _env_edges(rows: DataFrame, known: DataFrame, id_column: str = "id") -> DataFrame:
    """Edges of (id, env): to a known name that holds the dependency's, else to the dependency."""
    deps = rows.withColumn("_d", env_dependency(F.col("env"))).select(id_column, F.col("_d.dep").alias("dep"), F.col("_d.transport").alias("transport")).filter("dep is not null")
    # A known name holds the dependency's: an equi-join on the parts of known names that are as long as some dependency.
    # Parts are many more than the names that sizes are estimated from, so neither side may be broadcast unseen.
    sizes = sorted(r[0] for r in deps.select(F.length("dep")).distinct().collect())
    parts = known.select(F.col("name").alias("_k")).distinct().withColumn("dep", F.explode(_parts("_k", sizes)))
    least = parts.groupBy("dep").agg(F.min("_k").alias("_k"))
    best = Scratch(rows.sparkSession).write(deps.select("dep").distinct().join(least.hint("merge"), "dep"), "best")
    best = F.broadcast(best) if best.count() * FRONTIER_ROW <= FRONTIER_BYTES else best.hint("merge")
    named = deps.join(best, "dep", "left").select(F.col(id_column).alias("source"), F.concat(F.lit("infra/"), F.coalesce("_k", "dep")).alias("target"), "transport")
    return named.groupBy("source", "target").agg(F.min("transport").alias("transport")).select("source", "target", F.lit("k8s-depends").alias("edge_type"), F.lit("env").alias("via"), "transport", F.lit("").alias("extra"))


def _image_edges(nodes: DataFrame) -> DataFrame:
    rows = nodes.select("id", image_base(F.col("image")).alias("base")).filter("base <> ''")
    return rows.select(F.col("id").alias("source"), F.col("base").alias("target"), F.lit("infra-maps").alias("edge_type"), F.lit("image-name").alias("via"), F.lit("").alias("transport"), F.lit("").alias("extra"))


def kustomize(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of workloads that kustomizations list."""
    files = kept(files)
    get = lambda c, path, kind="string": F.try_variant_get(c, path, kind)
    # Parsing takes long for its bytes, so files are dealt by cores and not by size.
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    tops = files.filter(_base().isin(*KUSTOMIZATIONS)).select(_dir().alias("top"), "content").repartition(tasks, "top").select("top", F.try_parse_json(yaml_to_json("content")).alias("j"))
    listed = tops.select("top", F.explode(get("j", "$.resources", "array<string>")).alias("resource")).filter("resource is not null and resource <> ''")
    dirs = listed.select(normal_path(F.concat_ws("/", F.nullif("top", F.lit("")), "resource")).alias("dir")).distinct()
    # Manifests are longer than their paths, which sizes are estimated from: no side is broadcast. They are parsed once.
    loads = _preferred(files, WORKLOADS).join(dirs.hint("merge"), "dir", "left_semi").repartition(tasks, "dir").select("dir", "path", yaml_to_json("content").alias("json"))
    # Written, as a filter on what is parsed would be pushed below the parser and have it run again.
    loads = Scratch(files.sparkSession).write(loads, "manifests").withColumn("j", F.try_parse_json("json"))
    loads = loads.select("dir", "path", "j", get("j", "$.kind").alias("kind"), get("j", "$.metadata.name").alias("name")).filter("kind in ('Deployment', 'StatefulSet') and name <> ''")
    loads = loads.withColumn("c", get("j", "$.spec.template.spec.containers[0]", "variant"))
    loads = loads.select(
        "dir",
        "name",
        F.col("c").isNotNull().alias("runs"),
        F.concat(F.lit("infra/"), "name").alias("id"),
        F.lower("kind").alias("kind"),
        F.coalesce(get("c", "$.image"), F.lit("")).alias("image"),
        F.coalesce(get("c", "$.ports[0].containerPort", "int"), F.lit(0)).alias("port"),
        F.coalesce(F.try_variant_get("j", "$.metadata.labels['app.kubernetes.io/component']", "string"), F.lit("")).alias("component"),
        F.col("path").alias("source_file"),
        F.transform(get("c", "$.env", "array<variant>"), lambda e: get(e, "$.name")).alias("envs"),
    )
    found = loads.filter("runs")
    nodes = found.select(*NODE_COLUMNS)
    services = _preferred(files, SERVICES).select("dir", F.try_parse_json(yaml_to_json("content")).alias("s"))
    served = found.join(services.hint("merge"), "dir").select(F.col("id").alias("source"), F.col("name").alias("target"), F.lit("k8s-service").alias("edge_type"), F.lit("service-manifest").alias("via"), F.lit("").alias("transport"), F.coalesce(get("s", "$.metadata.namespace"), F.lit("")).alias("extra"))
    env = found.select("id", F.explode("envs").alias("env")).filter("env <> ''")
    return nodes, served.unionByName(_env_edges(env, loads.select("name"))).unionByName(_image_edges(nodes))


def helm(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of charts, with their values."""
    files = kept(files)
    get = lambda c, path, kind="string": F.try_variant_get(c, path, kind)
    charts = files.filter(_base() == "Chart.yaml").select(_dir().alias("dir"), "path", F.try_parse_json(yaml_to_json("content")).alias("j")).withColumn("name", get("j", "$.name")).filter("name <> ''")
    values = files.filter(_base() == "values.yaml").select(_dir().alias("dir"), yaml_to_json("content").alias("_v")).withColumn("v", F.try_parse_json("_v"))
    rows = charts.join(values, "dir", "left").withColumn("id", F.concat(F.lit("infra/"), "name"))
    repo, tag = F.coalesce(get("v", "$.image.repository"), F.lit("")), F.coalesce(get("v", "$.image.tag"), F.lit(""))
    image = F.when(repo == "", "").when(tag == "", repo).otherwise(F.concat(repo, F.lit(":"), tag))
    nodes = rows.select("id", F.lit("helm-chart").alias("kind"), image.alias("image"), F.coalesce(get("v", "$.service.port", "int"), F.lit(0)).alias("port"), F.lit("").alias("component"), F.col("path").alias("source_file"))
    needs = charts.select(F.concat(F.lit("infra/"), "name").alias("source"), F.explode(get("j", "$.dependencies", "array<variant>")).alias("d")).select("source", get("d", "$.name").alias("n")).filter("n <> ''")
    needs = needs.select("source", F.concat(F.lit("infra/"), "n").alias("target"), F.lit("helm-depends").alias("edge_type"), F.lit("chart-dependency").alias("via"), F.lit("").alias("transport"), F.lit("").alias("extra"))
    env = rows.select("id", F.explode(F.json_object_keys(F.get_json_object("_v", "$.env"))).alias("env"))
    return nodes, needs.unionByName(_env_edges(env, charts.select("name"))).unionByName(_image_edges(nodes))


_TF_MODULE = r'module\s+"(\w+)"\s*\{([^}]*)\}'


def terraform(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of resource and module blocks, per directory that holds main.tf."""
    files = kept(files)
    roots = files.filter(_base() == "main.tf").select(_dir().alias("dir"))
    texts = files.filter(_base().endswith(".tf")).select(_dir().alias("dir"), "path", "content").join(roots, "dir", "left_semi")
    # A directory of configuration is small; its files are joined in path order.
    whole = texts.groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "content"))), lambda x: x["content"]), "\n").alias("t"))
    kinds = F.regexp_extract_all("t", F.lit(r'resource\s+"(\w+)"\s+"(\w+)"\s*\{'), F.lit(1))
    names = F.regexp_extract_all("t", F.lit(r'resource\s+"(\w+)"\s+"(\w+)"\s*\{'), F.lit(2))
    resources = whole.select("dir", F.explode(F.arrays_zip(kinds.alias("k"), names.alias("n"))).alias("r")).select("dir", F.col("r.n").alias("name"), F.col("r.k").alias("component"))
    blocks = whole.select("dir", F.explode(F.arrays_zip(F.regexp_extract_all("t", F.lit(_TF_MODULE), F.lit(1)).alias("n"), F.regexp_extract_all("t", F.lit(_TF_MODULE), F.lit(2)).alias("b"))).alias("m")).select("dir", F.col("m.n").alias("name"), F.col("m.b").alias("body"))
    modules = blocks.select("dir", "name", F.lit("module").alias("component")).distinct()
    nodes = resources.unionByName(modules).select(F.concat(F.lit("infra/tf-"), "name").alias("id"), F.lit("terraform").alias("kind"), F.lit("").alias("image"), F.lit(0).alias("port"), "component", F.col("dir").alias("source_file"))
    used = blocks.select("dir", "name", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"module\.(\w+)\."), F.lit(1)))).alias("ref")).filter("ref <> name")
    known = modules.select("dir", F.col("name").alias("ref"))
    edges = used.join(known, ["dir", "ref"], "left_semi").select(F.concat(F.lit("infra/tf-"), "name").alias("source"), F.concat(F.lit("infra/tf-"), "ref").alias("target"), F.lit("tf-depends").alias("edge_type"), F.lit("module-reference").alias("via"), F.lit("").alias("transport"), F.lit("").alias("extra"))
    return nodes, edges


def topology(files: DataFrame, parts: tuple[str, ...] = ("kustomize", "helm", "terraform")) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all parts: first node of an id, first edge of (source, target, type, via)."""
    found = [{"kustomize": kustomize, "helm": helm, "terraform": terraform}[p](files) for p in parts]
    nodes = edges = None
    for rank, (n, e) in enumerate(found):
        n, e = n.withColumn("_p", F.lit(rank)), e.withColumn("_p", F.lit(rank))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    first = Window.partitionBy("id").orderBy("_p", "source_file", "kind", "component")
    nodes = nodes.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(*NODE_COLUMNS)
    once = Window.partitionBy("source", "target", "edge_type", "via").orderBy("_p", "transport", "extra")
    return nodes, edges.withColumn("_r", F.row_number().over(once)).filter("_r = 1").select(*EDGE_COLUMNS)


def _atom(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when((value == "") | value.rlike(r'[\s"()\\]'), quoted).otherwise(value)


def fact_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): facts of the topology as text, in the order part, line."""
    flag = lambda name, value, shown=None: F.when(value != "", F.concat(F.lit(f" :{name} "), shown if shown is not None else _atom(value))).otherwise("")
    node = F.concat(F.lit("(infra-node "), "id", F.lit(" :kind "), "kind", flag("image", F.col("image")), F.when(F.col("port") != 0, F.concat(F.lit(" :port "), F.col("port").cast("string"))).otherwise(""), flag("component", F.col("component")), F.lit(")"))
    kind = F.col("edge_type")
    target = F.when(kind.isin("k8s-service", "infra-maps"), _atom(F.col("target"))).otherwise(F.col("target"))
    tail = F.when(kind == "k8s-service", flag("namespace", F.col("extra"))).otherwise(F.concat(F.lit(" :via "), "via", F.when(kind == "k8s-depends", flag("transport", F.col("transport"), F.col("transport"))).otherwise("")))
    edge = F.concat(F.lit("("), kind, F.lit(" "), "source", F.lit(" "), target, tail, F.lit(")"))
    return nodes.select(F.lit(0).alias("part"), node.alias("line")).unionByName(edges.select(F.lit(1).alias("part"), edge.alias("line")))
