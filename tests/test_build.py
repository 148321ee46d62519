"""Source trees to edges, language by language."""

import pytest

from archspan.extract import extract_one, file_facts
from archspan.functions.pattern import QueryError
from archspan.functions.purpose import edits_at_most_one, infer
from archspan.operators import build, resolve
from archspan.sources import tree


_BUILT = {}


def rows_of(spark, files):
    """Edges (etype, source, target, flags) of a tree of files, built once."""
    key = tuple(files.items())
    if key not in _BUILT:
        df = spark.createDataFrame(list(files.items()), "path string, content string")
        sources = df.withColumn("language", tree.language(df.path)).filter("language is not null").selectExpr("path", "language", "'repo' as repo", "content")
        _BUILT[key] = build.build(file_facts(sources), resolve.configs(df)).edges.select("etype", "source", "target", "flags").collect()
    return _BUILT[key]


def edges_of(spark, files, etype="imports"):
    return {(r["source"], r["target"]) for r in rows_of(spark, files) if r["etype"] == etype}


def test_python(spark):
    files = {
        "pkg/__init__.py": "",
        "pkg/shared.py": "VALUE = 1\nclass Port(ABC):\n    def run(self): ...\n",
        "pkg/feature/source.py": "try:\n    from ..shared import VALUE\nexcept ImportError:\n    pass\nimport json\n",
        "pkg/use.py": "from pkg import shared\nimport helper\nclass Impl(Port):\n    pass\n",
        "pkg/helper.py": "",
        "top.py": "from pkg.shared import Port, VALUE\nclass A(Port): pass\n",
    }
    found = edges_of(spark, files)
    assert ("pkg/feature/source", "pkg/shared") in found
    assert ("pkg/use", "pkg/shared") in found and ("pkg/use", "pkg/__init__") in found and ("pkg/use", "pkg/helper") in found
    assert ("top", "pkg/shared") in found
    assert all("json" not in t for _, t in found)
    assert edges_of(spark, files, "calls-api") == {("pkg/use", "pkg/shared"), ("top", "pkg/shared")}
    assert ("top::A", "pkg/shared::Port") in edges_of(spark, files, "refs") and ("top", "pkg/shared::VALUE") in edges_of(spark, files, "refs")


def test_typescript(spark):
    files = {
        "a/tsconfig.json": '{\n  // paths\n  "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"],}}\n}',
        "a/src/target.ts": "export interface Port { run(): void }\n",
        "a/src/main.ts": 'import { Port } from "./target.js";\nimport { x } from "@/lib/x";\nexport * from "./view";\nconst l = import("./lazy");\nexport class Impl implements Port {}\n',
        "a/src/view.tsx": "", "a/src/lazy.ts": "", "a/src/lib/x.ts": "export const x = 1;\n", "a/src/index.ts": 'import y = require("./lib/x");\n',
        "b/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./other/*"]}}}', "b/other/lib/x.ts": "", "b/main.ts": 'import "@/lib/x";\n',
        "b/package.json": '{"name": "@org/b"}', "b/src/index.ts": "", "b/deep/use.ts": 'import z from "@org/b";\nimport q from "@org/none";\n',
    }
    found = edges_of(spark, files)
    assert {("a/src/main", t) for t in ("a/src/target", "a/src/lib/x", "a/src/view", "a/src/lazy")} <= found
    assert ("a/src", "a/src/lib/x") in found
    assert ("b/main", "b/other/lib/x") in found and ("b/deep/use", "b/src") in found
    assert len(found) == 7
    assert edges_of(spark, files, "calls-api") == {("a/src/main", "a/src/target")}


def test_rust(spark):
    files = {
        "crates/core-lib/Cargo.toml": '[package]\nname = "core-lib"\n', "crates/core-lib/src/lib.rs": "pub mod model;\n", "crates/core-lib/src/model.rs": "use super::*;\n",
        "crates/app/Cargo.toml": '[package]\nname = "app"\n', "crates/app/src/main.rs": "mod util;\nuse core_lib::model::Thing;\nuse crate::util::{self, helper};\n", "crates/app/src/util/mod.rs": "use std::fmt;\n",
    }
    found = edges_of(spark, files)
    assert found == {("crates/core-lib/src/lib", "crates/core-lib/src/model"), ("crates/core-lib/src/model", "crates/core-lib/src/lib"), ("crates/app/src/main", "crates/app/src/util"), ("crates/app/src/main", "crates/core-lib/src/model")}


def test_go(spark):
    files = {"go.mod": "module example.com/app\n", "main.go": 'package main\nimport "example.com/app/model"\nimport "fmt"\n', "model/a.go": "package model\n", "model/b.go": "package model\n", "model/a_test.go": "package model\n"}
    assert edges_of(spark, files) == {("main", "model/a"), ("main", "model/b")}


def test_java(spark):
    files = {
        "src/demo/services/Widget.java": "package demo.services;\npublic interface Widget { void go(); }\n",
        "src/demo/Use.java": "package demo;\nimport demo.services.Widget;\nclass Use implements Widget {}\n",
        "src/demo/Wild.java": "package demo;\nimport demo.services.*;\nclass Wild { Widget w; }\n",
        "src/demo/Idle.java": "package demo;\nimport demo.services.*;\nclass Idle { }\n",
        "src/demo/Twin.java": "package demo;\nclass Twin { Both b; }\n", "src/x/Both.java": "package demo;\nclass Both {}\n", "src/y/Both.java": "package demo;\nclass Both {}\n",
    }
    assert edges_of(spark, files) == {("src/demo/Use", "src/demo/services/Widget"), ("src/demo/Wild", "src/demo/services/Widget")}


def test_csharp(spark):
    files = {
        "Services/WidgetService.cs": "namespace Demo.Services { public class WidgetService { } }\n",
        "Controllers/C.cs": "using Demo.Services;\nnamespace Demo.Controllers;\npublic class C { private WidgetService s; }\n",
        "Controllers/D.cs": "using Demo.Services;\nnamespace Demo.Controllers;\npublic class D { }\n",
    }
    assert edges_of(spark, files) == {("Controllers/C", "Services/WidgetService")}


def test_ruby(spark):
    files = {
        "app/models/application_record.rb": "class ApplicationRecord\nend\n", "app/models/order.rb": "class Order < ApplicationRecord\nend\n",
        "app/models/concerns/auditable.rb": "module Auditable\nend\n", "app/jobs/charge_job.rb": "class ChargeJob\nend\n", "app/mailers/receipt_mailer.rb": "class ReceiptMailer\nend\n",
        "one/twice.rb": "class Twice\nend\n", "two/twice.rb": "class Twice\nend\n", "lib/tool.rb": "X = 1\n",
        "app/services/billing/charge.rb": 'require "tool"\nrequire_relative "../plain"\nmodule Billing\n  class Charge < ApplicationRecord\n    include Auditable\n    has_many :orders\n    belongs_to :any, polymorphic: true\n    before_validation :normalize\n\n    def call\n      ChargeJob.perform_later(order.id)\n      ReceiptMailer.paid(order).deliver_later\n      Twice.new if ready?\n    end\n\n    def normalize\n      true\n    end\n  end\nend\n',
        "app/services/plain.rb": "",
    }
    s = "app/services/billing/charge"
    found = {(t, tuple(f)) for src, t, f in ((a, b, c) for a, b, c in _with_flags(spark, files)) if src == s}
    assert found == {("app/models/application_record", ()), ("app/models/concerns/auditable", ("concern",)), ("app/models/order", ("association",)), ("app/jobs/charge_job", ("job",)), ("app/mailers/receipt_mailer", ("mailer",)), ("lib/tool", ()), ("app/services/plain", ())}
    assert (s, "app/models/application_record") in edges_of(spark, files, "calls-api")
    assert (f"{s}::Billing::Charge", f"{s}::Billing::Charge#normalize") in edges_of(spark, files, "refs")


def _with_flags(spark, files):
    return [(r["source"], r["target"], [f for f in r["flags"] if f != "via-base"]) for r in rows_of(spark, files) if r["etype"] == "imports"]


def test_pascal(spark):
    files = {
        "src/main.lpr": "program main;\nuses uWorker, uModel in 'model/uModel.pas', Missing in 'no/where.pas';\nbegin\nend.\n", "src/uworker.pas": "unit uWorker;\ninterface\n{$I defs.inc}\nimplementation\nend.\n",
        "src/model/uModel.pas": "unit uModel;\ninterface\nuses Twin;\nimplementation\nend.\n", "x/Twin.pas": "unit Twin;\nend.\n", "y/Twin.pas": "unit Twin;\nend.\n", "other/Missing.pas": "unit Missing;\nend.\n", "src/defs.inc": "const A = 1;\n",
    }
    assert edges_of(spark, files) == {("src/main", "src/uworker"), ("src/main", "src/model/uModel"), ("src/uworker", "src/defs.inc")}


def test_id_collisions_stop_the_build(spark):
    with pytest.raises(QueryError, match="dual.py.*dual.ts|dual.ts.*dual.py"):
        edges_of(spark, {"dual.py": "", "dual.ts": ""})


def test_comments_and_strings_hide_nothing_and_add_nothing():
    text = "unit u;\n{ uses Fake; }\n(* class *)\n// type X = class\ninterface\nconst S = 'uses Other; it''s';\nuses Real;\nimplementation\nend.\n"
    assert extract_one("u.pas", "pascal", "r", text)["imports"] == ["Real"]
    ts = '// import a from "no";\n/* class Hidden {} */\nconst s = "class Fake {}";\nimport b from "yes";\n'
    found = extract_one("a.ts", "typescript", "r", ts)
    assert found["imports"] == ["yes"] and [e["name"] for e in found["entities"]] == ["s"]


def test_broken_python_gives_its_import_lines():
    found = extract_one("a.py", "python", "r", "import os\nfrom x.y import z\ndef broken(:\n")
    assert found["imports"] == ["os", "x.y"] and found["entities"] == []


def test_purposes():
    assert infer("/a/domain/x.py", "", "python") == "domain logic"
    assert infer("/a/x.py", '"""Sends mail.\n\nMore."""\n', "python") == "Sends mail."
    assert infer("/x/order.ts", "", "typescript", [("OrderServicee", "class")]) == "service"
    assert infer("/x/order_dto.ts", "", "typescript") == "data transfer object"
    assert infer("/x/thing.ts", "export enum A {}", "typescript") == "enum definitions"
    assert infer("/x/thing.ts", "", "typescript") == "general module"
    assert infer("/x/y.ts", "@Injectable()\nexport class Y {}", "typescript") == "NestJS injectable"


def test_edit_distance():
    assert edits_at_most_one("abc", "abc") and edits_at_most_one("abc", "abxc") and edits_at_most_one("abc", "abd") and edits_at_most_one("abc", "bc")
    assert not edits_at_most_one("abc", "cba") and not edits_at_most_one("abc", "abcde")


def test_scan(spark, tmp_path):
    for path, text in {"a/x.py": "import os\n", "a/types.d.ts": "", "vendor/v.go": "", "sub/.git/HEAD": "ref", "sub/y.rb": "", "sub/Backup/old.pas": "", "sub/Backup/keep.py": "", "skip/z.py": "", "bin/b.py": "", "ign/i.py": "", "bad.py": b"\xff = 1"}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text if isinstance(text, bytes) else text.encode())
    ignored = spark.createDataFrame([("ign/",)], "path string")
    rows = {r["path"]: (r["language"], r["repo"]) for r in tree.discover(spark, str(tmp_path), ("skip",), ignored, "main").collect()}
    assert rows == {"a/x.py": ("python", "main"), "sub/y.rb": ("ruby", "sub"), "sub/Backup/keep.py": ("python", "sub"), "bad.py": ("python", "main")}
    with pytest.raises(ValueError):
        tree.discover(spark, str(tmp_path), ("a/b",))


def test_follow_adds_changed_files_once(spark, tmp_path):
    from archspan import streaming

    rows = lambda text: spark.createDataFrame([("a.py", "python", "r", text), ("b.py", "python", "r", "import a\n")], streaming.FILES)
    files, facts, marks = (str(tmp_path / n) for n in ("files", "facts", "marks"))
    for text in ("X = 1\n", "X = 1\n", "Y = 2\n"):
        rows(text).coalesce(1).write.mode("append").parquet(files)
        streaming.follow(spark, files, facts, marks).awaitTermination()
    assert spark.read.parquet(facts).count() == 3
    assert {r["path"]: r["exported_names"] for r in streaming.current_facts(spark, facts).collect()} == {"a.py": ["Y"], "b.py": []}


def test_source_that_the_parser_cannot_hold_gives_its_import_lines():
    found = extract_one("a.py", "python", "r", "import os\nx = " + "(" * 100_000)
    assert found["imports"] == ["os"] and found["entities"] == []
