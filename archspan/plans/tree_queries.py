"""Registered queries over source trees: extraction, resolution, scans, purposes, manifests, caches."""

from __future__ import annotations

import os
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..extract import file_facts
from ..operators import build, infra, ranges, resolve, vcs
from ..operators.scratch import Scratch
from ..sources import factmap, tree
from . import trees
from .catalog import query

# Rows expected of one tree of each language.
EDGES: dict[str, list[tuple[str, str, str, str]]] = {
    "python": [
        ("calls-api", "n@/top", "n@/pkg/shared", "via-ifc"),
        ("data-flow", "n@/pkg/use", "n@/pkg/helper", "validated"),
        ("imports", "n@/pkg/feature/source", "n@/pkg/shared", "via-base"),
        ("imports", "n@/pkg/use", "n@/pkg/__init__", ""),
        ("imports", "n@/pkg/use", "n@/pkg/helper", ""),
        ("imports", "n@/pkg/use", "n@/pkg/shared", "via-base"),
        ("imports", "n@/top", "n@/pkg/shared", "via-base"),
        ("refs", "n@/pkg/feature/source", "n@/pkg/shared::VALUE", ""),
        ("refs", "n@/top", "n@/pkg/shared::VALUE", ""),
        ("refs", "n@/top::A", "n@/pkg/shared::Port", ""),
    ],
    "typescript": [
        ("calls-api", "n@/a/src/main", "n@/a/src/target", "via-ifc"),
        ("imports", "n@/a/src", "n@/a/src/lib/x", ""),
        ("imports", "n@/a/src/main", "n@/a/src/lazy", ""),
        ("imports", "n@/a/src/main", "n@/a/src/lib/x", ""),
        ("imports", "n@/a/src/main", "n@/a/src/target", "via-base"),
        ("imports", "n@/a/src/main", "n@/a/src/view", ""),
        ("imports", "n@/b/deep/use", "n@/b/src", ""),
        ("refs", "n@/a/src/main", "n@/a/src/lib/x::x", ""),
        ("refs", "n@/a/src/main::Impl@", "n@/a/src/target::Port", ""),
        ("refs", "n@/b/deep/use", "n@/b/src::T", ""),
    ],
    "rust": [
        ("imports", "n@/app/src/main", "n@/app/src/util", ""),
        ("imports", "n@/app/src/main", "n@/core/src/model", "via-base"),
        ("imports", "n@/core/src/lib", "n@/core/src/model", "via-base"),
        ("imports", "n@/core/src/model", "n@/core/src/lib", ""),
        ("refs", "n@/app/src/main", "n@/app/src/util::helper", ""),
        ("refs", "n@/app/src/main", "n@/core/src/model::Thing", ""),
    ],
    "go": [
        ("imports", "n@/main", "n@/model/a", "via-base"),
        ("imports", "n@/main", "n@/model/b", ""),
    ],
    "java": [
        ("calls-api", "n@/demo/Use@", "n@/demo/services/Widget@", "via-ifc"),
        ("imports", "n@/demo/Use@", "n@/demo/services/Widget@", "via-base"),
        ("imports", "n@/demo/Wild@", "n@/demo/services/Widget@", "via-base"),
        ("refs", "n@/demo/Use@::Use@", "n@/demo/services/Widget@::Widget@", ""),
        ("refs", "n@/demo/Wild@", "n@/demo/services/Widget@::Widget@", ""),
    ],
    "csharp": [
        ("imports", "n@/Controllers/C", "n@/Services/WidgetService@", ""),
        ("refs", "n@/Controllers/C", "n@/Services/WidgetService@::WidgetService@", ""),
    ],
    "ruby": [
        ("calls-api", "n@/app/models/order_n@", "n@/app/models/record_n@", "via-ifc"),
        ("calls-api", "n@/app/services/billing/charge_n@", "n@/app/models/record_n@", "via-ifc"),
        ("imports", "n@/app/models/order_n@", "n@/app/models/record_n@", ""),
        ("imports", "n@/app/services/billing/charge_n@", "lib/tool_n@", ""),
        ("imports", "n@/app/services/billing/charge_n@", "n@/app/jobs/charge_job_n@", "job"),
        ("imports", "n@/app/services/billing/charge_n@", "n@/app/models/concerns/auditable_n@", "concern"),
        ("imports", "n@/app/services/billing/charge_n@", "n@/app/models/order_n@", "association"),
        ("imports", "n@/app/services/billing/charge_n@", "n@/app/models/record_n@", ""),
        ("imports", "n@/app/services/billing/charge_n@", "n@/app/services/plain", ""),
        ("refs", "n@/app/models/order_n@::OrderN@", "n@/app/models/record_n@::RecordN@", ""),
        ("refs", "n@/app/services/billing/charge_n@", "n@/app/jobs/charge_job_n@::ChargeJobN@", ""),
        ("refs", "n@/app/services/billing/charge_n@::BillingN@::Charge", "n@/app/models/concerns/auditable_n@::AuditableN@", ""),
        ("refs", "n@/app/services/billing/charge_n@::BillingN@::Charge", "n@/app/models/record_n@::RecordN@", ""),
        ("refs", "n@/app/services/billing/charge_n@::BillingN@::Charge", "n@/app/services/billing/charge_n@::BillingN@::Charge#normalize", "callback"),
    ],
    "pascal": [
        ("imports", "n@/main@", "n@/model/uModel@", ""),
        ("imports", "n@/main@", "n@/uworker@", ""),
        ("imports", "n@/uworker@", "n@/defs.inc", ""),
    ],
}
ENTITIES: dict[str, list[tuple[str, str, str, int]]] = {
    "python": [
        ("n@/pkg/helper", "make@", "fn", 4),
        ("n@/pkg/shared", "Port", "cls", 2),
        ("n@/pkg/use", "Impl", "cls", 4),
        ("n@/top", "A", "cls", 2),
    ],
    "typescript": [
        ("n@/a/src/lazy", "Kind", "enm", 1),
        ("n@/a/src/lib/x", "x", "fn", 1),
        ("n@/a/src/main", "Impl@", "cls", 5),
        ("n@/a/src/main", "l", "fn", 4),
        ("n@/a/src/target", "Port", "ifc", 1),
        ("n@/a/src/view", "View", "fn", 1),
        ("n@/b/src", "T", "typ", 1),
        ("n@/c/shop.controller", "ShopController", "cls", 2),
        ("n@/c/shop.service", "ShopService", "cls", 2),
    ],
    "rust": [
        ("n@/app/src/main", "main", "fn", 4),
        ("n@/app/src/util", "helper", "fn", 2),
        ("n@/core/src/model", "Act", "ifc", 3),
        ("n@/core/src/model", "Thing", "cls", 2),
    ],
    "go": [
        ("n@/main", "main", "fn", 6),
        ("n@/model/a", "Shape", "ifc", 3),
        ("n@/model/b", "Box", "cls", 3),
    ],
    "java": [
        ("n@/demo/Idle@", "Idle@", "cls", 3),
        ("n@/demo/Twin@", "Twin@", "cls", 2),
        ("n@/demo/Use@", "Use@", "cls", 3),
        ("n@/demo/Wild@", "Wild@", "cls", 3),
        ("n@/demo/services/Widget@", "Widget@", "ifc", 2),
        ("n@/x/Both@", "Both@", "cls", 2),
        ("n@/y/Both@", "Both@", "cls", 2),
    ],
    "csharp": [
        ("n@/Controllers/C", "C@", "cls", 3),
        ("n@/Controllers/D", "D@", "cls", 3),
        ("n@/Services/WidgetService@", "WidgetService@", "cls", 1),
    ],
    "ruby": [
        ("lib/tool_n@", "X", "typ", 1),
        ("n@/app/jobs/charge_job_n@", "ChargeJobN@", "cls", 1),
        ("n@/app/models/concerns/auditable_n@", "AuditableN@", "mod", 1),
        ("n@/app/models/order_n@", "OrderN@", "cls", 1),
        ("n@/app/models/record_n@", "RecordN@", "cls", 1),
        ("n@/app/services/billing/charge_n@", "BillingN@", "mod", 3),
        ("n@/app/services/billing/charge_n@", "BillingN@::Charge", "cls", 4),
        ("n@/app/services/billing/charge_n@", "BillingN@::Charge#call", "fn", 10),
        ("n@/app/services/billing/charge_n@", "BillingN@::Charge#normalize", "fn", 15),
        ("one@/twice", "TwiceN@", "cls", 1),
        ("two@/twice", "TwiceN@", "cls", 1),
    ],
    "pascal": [
        ("n@/uworker@", "TWorker", "cls", 5),
    ],
}


def _edges(language: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = trees.files(spark, sf_dir, language)
        graph = build.build(file_facts(trees.sources(files)), resolve.configs(files))
        return graph.edges.select("etype", "source", "target", F.array_join("flags", ",").alias("flags"))

    return run


def _entities(language: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build.entities_of(file_facts(trees.sources(trees.files(spark, sf_dir, language)))).select("module", "name", "kind", "line")

    return run


for _language in trees.TREES:
    if _language in EDGES:
        query(f"edges_{_language}", trees.expected_sql("etype, source, target, flags", EDGES[_language]))(_edges(_language))
    if _language in ENTITIES:
        query(f"entities_{_language}", trees.expected_sql("module, name, kind, line", ENTITIES[_language]))(_entities(_language))

# Module ids of all languages, from the paths of the trees.
MODULE_IDS = [
    ("n@/pkg/__init__.py", "n@/pkg/__init__"), ("n@/a/src/index.ts", "n@/a/src"), ("n@/a/src/view.tsx", "n@/a/src/view"), ("n@/app/src/util/mod.rs", "n@/app/src/util"), ("n@/core/src/lib.rs", "n@/core/src/lib"),
    ("n@/model/a_test.go", "n@/model/a_test"), ("n@/x/Both@.java", "n@/x/Both@"), ("n@/Controllers/C.cs", "n@/Controllers/C"), ("lib/tool_n@.rb", "lib/tool_n@"), ("n@/main@.lpr", "n@/main@"), ("n@/defs.inc", "n@/defs.inc"),
]


def _all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for language in trees.TREES:
        part = trees.sources(trees.files(spark, sf_dir, language)).select("path", "language")
        out = part if out is None else out.unionByName(part)
    return out


@query("module_ids_trees", trees.expected_sql("path, module", MODULE_IDS))
def _module_ids(spark, sf_dir):
    rows = _all_paths(spark, sf_dir).select("path", tree.module_id(F.col("path"), F.col("language")).alias("module"))
    wanted = trees.filled(spark, sf_dir, "path string", [(p,) for p, _ in MODULE_IDS])
    return rows.join(wanted, "path", "left_semi")


# Scans: repositories, ignored paths, projects, and a tree on disk.
_REPOS = [("n@", "n@"), ("n@/app", "app"), ("one@", "one@")]


@query(
    "repositories",
    trees.expected_sql("path, repo", [("n@/pkg/use.py", "n@"), ("n@/pkg/feature/source.py", "n@"), ("n@/app/src/main.rs", "app"), ("n@/app/src/util/mod.rs", "app"), ("one@/twice.rb", "one@"), ("two@/twice.rb", "root")]),
)
def _repositories(spark, sf_dir):
    paths = ("n@/pkg/use.py", "n@/pkg/feature/source.py", "n@/app/src/main.rs", "n@/app/src/util/mod.rs", "one@/twice.rb", "two@/twice.rb")
    files = trees.filled(spark, sf_dir, "path string", [(p,) for p in paths])
    return tree.with_repo(files, trees.filled(spark, sf_dir, "top string", [(t,) for t, _ in _REPOS]), "root")


@query("ignored_paths", trees.expected_sql("path", [("n@/pkg/__init__.py",), ("n@/pkg/shared.py",), ("n@/pkg/use.py",), ("n@/top.py",)]))
def _ignored(spark, sf_dir):
    files = trees.sources(trees.files(spark, sf_dir, "python")).select("path")
    return tree.without_ignored(files, trees.filled(spark, sf_dir, "path string", [("n@/pkg/feature/",), ("n@/pkg/helper.py",)]))


@query(
    "project_configs",
    trees.expected_sql(
        "path, language, project, config",
        [
            ("n@/a/src/main.ts", "typescript", "n@/a", "n@/a/tsconfig.json"),
            ("n@/a/src/view.tsx", "tsx", "n@/a", "n@/a/tsconfig.json"),
            ("n@/core/src/model.rs", "rust", "n@/core", "n@/core/Cargo.toml"),
            ("n@/model/b.go", "go", "n@", "n@/go.mod"),
        ],
    ),
)
def _projects(spark, sf_dir):
    paths = ("n@/a/src/main.ts", "n@/a/src/view.tsx", "n@/core/src/model.rs", "n@/model/b.go", "n@/demo/Use@.java")
    files = trees.filled(spark, sf_dir, "path string", [(p,) for p in paths]).withColumn("language", tree.language(F.col("path")))
    configs = [("n@/a/tsconfig.json",), ("n@/core/Cargo.toml",), ("n@/go.mod",), ("n@/Cargo.toml",), ("x@/pom.xml",)]
    return tree.projects(files, trees.filled(spark, sf_dir, "path string", configs))


def on_disk(spark: SparkSession, files: dict[str, str]) -> str:
    """A folder with the given files, beside the session's scratch tables."""
    root = Scratch(spark).folder.removeprefix("file:") + "-tree"
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as out:
            out.write(text)
    return root


def _nation_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect()
    return {path.replace("@", str(r[0])): r[1] for r in rows for path in ("sub/n@.py", "sub/Backup/o@.pas", "sub/Backup/p@.rb", "node_modules/m@.ts", "skip/s@.go", "ign/i@.py", "top@.java", "types@.d.ts", "read@.me")}


@query(
    "tree_scan",
    "select replace(p, '@', cast(n_nationkey as varchar)) as path, l as language, r as repo, n_name as content from nation, (values ('sub/n@.py', 'python', 'sub'), ('sub/Backup/p@.rb', 'ruby', 'sub'), ('top@.java', 'java', 'main')) v(p, l, r)",
)
def _tree_scan(spark, sf_dir):
    root = on_disk(spark, _nation_files(spark, sf_dir) | {"sub/.git/HEAD": "ref"})
    return tree.discover(spark, root, ("skip",), spark.createDataFrame([("ign/",)], "path string"), "main")


@query("map_locator", "select '.belief_map.sexp' as name, 2 as levels")
def _map_locator(spark, sf_dir):
    root = on_disk(spark, {"belief_map.sexp": "", ".belief_map.sexp": "", "a/b/x.py": ""})
    found = factmap.find_map(os.path.join(root, "a", "b"))
    return spark.createDataFrame([(os.path.basename(found), os.path.relpath(os.path.join(root, "a", "b"), os.path.dirname(found)).count("/") + 1)], "name string, levels int")


# Purposes and naming of files, by every rule.
PURPOSES = [
    # path, content, purpose
    ("n@/domain/x.py", "", "domain logic"),
    ("n@/a/y.py", '"""Sends mail of @.\n\nMore.\n"""\n', "Sends mail of @."),
    ("n@/a/z.ts", "/**\n * Draws @.\n */\nexport const z = 1;\n", "Draws @."),
    ("n@/x/order.ts", "export class OrderServicee {}\n", "service"),
    ("n@/x/order_dto.ts", "", "data transfer object"),
    ("n@/x/shop.controllerr.ts", "", "API controller"),
    ("n@/x/thing.ts", "export enum A {}\n", "enum definitions"),
    ("n@/x/shape.ts", "export type A = string;\n", "type definitions"),
    ("n@/x/barrel.ts", "export { a } from './a';\n", "barrel re-exports"),
    ("n@/x/only.ts", "", "general module"),
    ("n@/x/w.ts", "~Injectable()\nexport class W {}\n", "general module"),
    ("n@/x/v.ts", "~Injectable()\n", "NestJS injectable"),
    ("n@/x/page.ts", "~Controller(1)\nexport class Page {}\n", "API controller"),
    ("n@/x/made.py", "class ThingFactory:\n    pass\n", "Factory pattern"),
    ("n@/x/__init__.py", "", "module entry point"),
    ("n@/x/relay.py", "from .core import run\n", "package re-exports"),
]


@query("purposes", trees.expected_sql("path, purpose", [(p, label) for p, _, label in PURPOSES]))
def _purposes(spark, sf_dir):
    files = trees.filled(spark, sf_dir, "path string, content string", [(p, c) for p, c, _ in PURPOSES])
    return file_facts(trees.sources(files)).select("path", "purpose")


@query("file_hashes", "select concat('d', doc_id, '.py') as path, sha256(coalesce(text, '')) as content_hash from documents")
def _file_hashes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return file_facts(trees.sources(files)).select("path", "content_hash")


# A cache of facts: the second batch holds the same files and, for odd keys, new texts.
@query("facts_cache", "select concat('f', n_nationkey, '.py') as path, case when n_nationkey % 2 = 1 then 'B' else 'A' end as exported from nation")
def _facts_cache(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    path = F.concat(F.lit("f"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path")
    batch = lambda text: nation.select(path, F.lit("python").alias("language"), F.lit("r").alias("repo"), text.alias("content"))
    at = f"{Scratch(spark).folder}-{uuid.uuid4().hex}"
    streaming.update_facts(batch(F.lit("A = 1\n")), at)
    streaming.update_facts(batch(F.when(F.col("n_nationkey") % 2 == 1, "B = 1\n").otherwise("A = 1\n")), at)
    return streaming.current_facts(spark, at).select("path", F.array_join("exported_names", ",").alias("exported"))


# Commits made of the conversations.
def _commits(spark, sf_dir):
    sha = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(sha(F.col("turn")).alias("sha"), F.when(F.col("turn") > 0, sha(F.col("turn") - 1)).alias("first_parent"), "role", "text")


query("commit_children", "select concat('c',conv_id,'_',turn-1) as parent, concat('c',conv_id,'_',turn) as child from conversations where turn>0")(lambda s, d: vcs.children(_commits(s, d)))
query("commit_listing", "select concat('c',conv_id,'_',turn) as sha, case when role='user' then text else '' end as subject from conversations where turn>0")(
    lambda s, d: vcs.listing(_commits(s, d).filter("first_parent is not null").select("sha"), _commits(s, d).filter("role = 'user'").select("sha", F.col("text").alias("subject")))
)

# A repository of two commits and a change that is not committed.
def _repository(spark: SparkSession) -> str:
    root = on_disk(spark, {".gitignore": "*.log\nout/\n", "a.py": "x = 1\ny = 2\n", "keep.log": "", "out/x.py": ""})
    git = lambda *args: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", "-C", root, *args], check=True, capture_output=True)
    git("init", "-q")
    for subject, text in (("first", "x = 1\ny = 2\n"), ("second", "x = 1\ny = 3\nz = 4\n")):
        with open(os.path.join(root, "a.py"), "w", encoding="utf-8") as out:
            out.write(text)
        git("add", "a.py", ".gitignore")
        git("commit", "-qm", subject)
    with open(os.path.join(root, "a.py"), "a", encoding="utf-8") as out:
        out.write("w = 5\nv = 6\n")
    return root


@query("git_history", "select * from (values ('first', null), ('second', 'first')) v(subject, parent)")
def _git_history(spark, sf_dir):
    root = _repository(spark)
    commits, subjects = tree.commits(spark, root), tree.subjects(spark, root)
    named = commits.join(subjects, "sha").select("subject", "first_parent")
    return named.join(subjects.select(F.col("sha").alias("first_parent"), F.col("subject").alias("parent")), "first_parent", "left").select("subject", "parent")


query("git_diff", "select 'a.py' as path, cast(4 as int) as start, cast(5 as int) as \"end\"")(lambda s, d: ranges.hunks(tree.diff_lines(s, _repository(s), "HEAD")))
query("git_ignored", "select * from (values ('keep.log'), ('out/x.py')) v(path)")(lambda s, d: tree.git_ignored(s, _repository(s), ["keep.log", "out/x.py", "a.py"]))

# Charts and services, as tables and as facts.
CHARTS = {
    "h@/Chart.yaml": "name: chart@\ndependencies:\n- name: redis\n- name: queue@\n",
    "h@/values.yaml": "image:\n  repository: reg/app@\n  tag: v@\nservice:\n  port: 81\nenv:\n  DATABASE_URL: x\n  OTHER: y\n",
    "h@/node_modules/Chart.yaml": "name: hidden@\n",
    "k@/kustomization.yml": "resources:\n- ./web\n",
    "k@/web/deployment.yaml": "kind: StatefulSet\nmetadata:\n  name: web@\n  labels:\n    app.kubernetes.io/component: front end\nspec:\n  template:\n    spec:\n      containers:\n      - image: reg/web@:1\n        env:\n        - name: WEB@_HOST\n",
    "k@/web/service.yaml": "kind: Service\nmetadata:\n  name: web@\n  namespace: space@\n",
}
_CHART_NODES = [("infra/chart@", "helm-chart", "reg/app@:v@", 81, "", "h@/Chart.yaml"), ("infra/web@", "statefulset", "reg/web@:1", 0, "front end", "k@/web/deployment.yaml")]
_CHART_EDGES = [
    ("infra/chart@", "infra/redis", "helm-depends", "chart-dependency", "", ""),
    ("infra/chart@", "infra/queue@", "helm-depends", "chart-dependency", "", ""),
    ("infra/chart@", "infra/postgres", "k8s-depends", "env", "tcp", ""),
    ("infra/chart@", "app@", "infra-maps", "image-name", "", ""),
    ("infra/web@", "web@", "k8s-service", "service-manifest", "", "space@"),
    ("infra/web@", "infra/web@", "k8s-depends", "env", "http", ""),
    ("infra/web@", "web@", "infra-maps", "image-name", "", ""),
]
_CHART_FACTS = [
    ("(infra-node infra/chart@ :kind helm-chart :image reg/app@:v@ :port 81)",),
    ('(infra-node infra/web@ :kind statefulset :image reg/web@:1 :component "front end")',),
    ("(helm-depends infra/chart@ infra/redis :via chart-dependency)",),
    ("(helm-depends infra/chart@ infra/queue@ :via chart-dependency)",),
    ("(k8s-depends infra/chart@ infra/postgres :via env :transport tcp)",),
    ("(infra-maps infra/chart@ app@ :via image-name)",),
    ("(k8s-service infra/web@ web@ :namespace space@)",),
    ("(k8s-depends infra/web@ infra/web@ :via env :transport http)",),
    ("(infra-maps infra/web@ web@ :via image-name)",),
]


def _charts(spark, sf_dir):
    return trees.filled(spark, sf_dir, "path string, content string", list(CHARTS.items()))


query("infra_charts_nodes", trees.expected_sql("id, kind, image, port, component, source_file", _CHART_NODES))(lambda s, d: infra.topology(_charts(s, d))[0])
query("infra_charts_edges", trees.expected_sql("source, target, edge_type, via, transport, extra", _CHART_EDGES))(lambda s, d: infra.topology(_charts(s, d))[1])
query("infra_charts_facts", trees.expected_sql("line", _CHART_FACTS))(lambda s, d: infra.fact_lines(*infra.topology(_charts(s, d))).select("line"))


@query("infra_tree_scan", trees.expected_sql("id, kind", [("infra/chart@", "helm-chart"), ("infra/web@", "statefulset")]))
def _infra_scan(spark, sf_dir):
    """The manifests as files below a folder."""
    from ..__main__ import manifests

    files = {r["path"]: r["content"] for r in _charts(spark, sf_dir).collect()}
    return infra.topology(manifests(spark, on_disk(spark, files)))[0].select("id", "kind")
