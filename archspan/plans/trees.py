"""Source trees for the registered queries: one small tree of each language for every nation.

``@`` in paths, texts and expected rows stands for the nation's key, so that each
query runs over a whole table, and its SQL repeats the rows expected of one tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tree

TREES: dict[str, dict[str, str]] = {
    "python": {
        "n@/pkg/__init__.py": "",
        "n@/pkg/shared.py": "VALUE = 1\nclass Port(ABC):\n    def run(self): ...\n",
        "n@/pkg/feature/source.py": "try:\n    from ..shared import VALUE\nexcept ImportError:\n    pass\nimport json\n",
        "n@/pkg/use.py": "from pkg import shared\nimport helper\n\nclass Impl(Port):\n    pass\n",
        "n@/pkg/helper.py": "from pydantic import BaseModel\n\n~cached\ndef make@():\n    return 1\n",
        "n@/top.py": "from pkg.shared import Port, VALUE\nclass A(Port): pass\n",
    },
    "typescript": {
        "n@/a/tsconfig.json": '{\n  // paths\n  "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"],}}\n}'.replace("@", "~"),
        "n@/a/src/target.ts": "export interface Port { run(): void }\n",
        "n@/a/src/main.ts": 'import { Port } from "./target.js";\nimport { x } from "~/lib/x";\nexport * from "./view";\nconst l = import("./lazy");\nexport class Impl@ implements Port {}\n',
        "n@/a/src/view.tsx": "export function View() { return null; }\n",
        "n@/a/src/lazy.ts": "export enum Kind { A }\n",
        "n@/a/src/lib/x.ts": "export const x = 1;\n",
        "n@/a/src/index.ts": 'import y = require("./lib/x");\n',
        "n@/b/package.json": '{"name": "org-b@"}',
        "n@/b/src/index.ts": "export type T = string;\n",
        "n@/b/deep/use.ts": 'import z from "org-b@";\nimport q from "org-none";\n',
        "n@/c/shop.controller.ts": '@Controller("shop")\nexport class ShopController {\n  constructor(private readonly port: ShopService) {}\n}\n'.replace("@C", "~C"),
        "n@/c/shop.service.ts": "~Injectable()\nexport class ShopService {}\n",
    },
    "rust": {
        "n@/core/Cargo.toml": '[package]\nname = "core-lib@"\n',
        "n@/core/src/lib.rs": "pub mod model;\n",
        "n@/core/src/model.rs": "use super::*;\npub struct Thing { x: u8 }\npub trait Act { fn act(&self); }\nimpl Act for Thing { fn act(&self) {} }\n",
        "n@/app/Cargo.toml": '[package]\nname = "app@"\n',
        "n@/app/src/main.rs": "mod util;\nuse core_lib@::model::Thing;\nuse crate::util::{self, helper};\nfn main() {}\n",
        "n@/app/src/util/mod.rs": "use std::fmt;\npub fn helper() {}\n",
    },
    "go": {
        "n@/go.mod": "module example.com/app@\n",
        "n@/main.go": 'package main\n\nimport "example.com/app@/model"\nimport "fmt"\n\nfunc main() {}\n',
        "n@/model/a.go": "package model\n\ntype Shape interface { Area() int }\n",
        "n@/model/b.go": "package model\n\ntype Box struct { side int }\n\nfunc (b *Box) Area() int { return 1 }\n",
        "n@/model/a_test.go": "package model\n",
    },
    "java": {
        "n@/demo/services/Widget@.java": "package demo.services;\npublic interface Widget@ { void go(); }\n",
        "n@/demo/Use@.java": "package demo;\nimport demo.services.Widget@;\nclass Use@ implements Widget@ {}\n",
        "n@/demo/Wild@.java": "package demo;\nimport demo.services.*;\nclass Wild@ { Widget@ w; }\n",
        "n@/demo/Idle@.java": "package demo;\nimport demo.services.*;\nclass Idle@ { }\n",
        "n@/demo/Twin@.java": "package demo;\nclass Twin@ { Both@ b; }\n",
        "n@/x/Both@.java": "package demo;\nclass Both@ {}\n",
        "n@/y/Both@.java": "package demo;\nclass Both@ {}\n",
    },
    "csharp": {
        "n@/Services/WidgetService@.cs": "namespace Demo.Services { public class WidgetService@ { } }\n",
        "n@/Controllers/C.cs": "using Demo.Services;\nnamespace Demo.Controllers;\npublic class C@ { private WidgetService@ s; }\n",
        "n@/Controllers/D.cs": "using Demo.Services;\nnamespace Demo.Controllers;\npublic class D@ { }\n",
    },
    "ruby": {
        "config/initializers/inflections.rb": 'inflect.acronym "HTTP"\n',
        "n@/app/models/record_n@.rb": "class RecordN@\nend\n",
        "n@/app/models/order_n@.rb": "class OrderN@ < RecordN@\nend\n",
        "n@/app/models/concerns/auditable_n@.rb": "module AuditableN@\nend\n",
        "n@/app/jobs/charge_job_n@.rb": "class ChargeJobN@\nend\n",
        "n@/app/lib/http_n@.rb": "",
        "one@/twice.rb": "class TwiceN@\nend\n",
        "two@/twice.rb": "class TwiceN@\nend\n",
        "lib/tool_n@.rb": "X = 1\n",
        "n@/app/services/plain.rb": "",
        "n@/app/services/billing/charge_n@.rb": 'require "tool_n@"\nrequire_relative "../plain"\nmodule BillingN@\n  class Charge < RecordN@\n    include AuditableN@\n    has_many :order_n@s\n    belongs_to :any, polymorphic: true\n    before_validation :normalize\n\n    def call\n      ChargeJobN@.perform_later(order.id)\n      TwiceN@.new if ready?\n    end\n\n    def normalize\n      true\n    end\n  end\nend\n',
    },
    "pascal": {
        "n@/main@.lpr": "program main@;\nuses uWorker@, uModel@ in 'model/uModel@.pas', Missing@ in 'no/where.pas';\nbegin\nend.\n",
        "n@/uworker@.pas": "unit uWorker@;\ninterface\n{$I defs.inc}\ntype\n  TWorker = class(TObject)\n    procedure Run;\n  end;\nimplementation\nprocedure TWorker.Run;\nbegin\nend;\nend.\n",
        "n@/model/uModel@.pas": "unit uModel@;\ninterface\nuses Twin@;\nimplementation\nend.\n",
        "x@/Twin@.pas": "unit Twin@;\nend.\n",
        "y@/Twin@.pas": "unit Twin@;\nend.\n",
        "other@/Missing@.pas": "unit Missing@;\nend.\n",
        "n@/defs.inc": "const A = 1;\n",
    },
}


def filled(spark: SparkSession, sf_dir: str, schema: str, rows: list[tuple]) -> DataFrame:
    """The rows for every nation with its key filled in, each once; ``~`` stands for a real at sign."""
    if not rows:
        return spark.createDataFrame([], schema)
    names = [part.split()[0] for part in schema.split(", ")]
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])
    key = F.col("n_nationkey").cast("string")
    shown = lambda n: F.replace(F.replace(F.col(f"f.{n}"), F.lit("@"), key), F.lit("~"), F.lit("@")).alias(n)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select("n_nationkey", F.explode(listed).alias("f")).select(*map(shown, names)).distinct()


def files(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(path, content) of a language's trees."""
    return filled(spark, sf_dir, "path string, content string", list(TREES[language].items()))


def sources(found: DataFrame) -> DataFrame:
    return found.withColumn("language", tree.language(F.col("path"))).filter("language is not null").select("path", "language", F.lit("repo").alias("repo"), "content")


def expected_sql(columns: str, rows: list[tuple]) -> str:
    """SELECT of the rows for every nation, ``@`` filled in; numbers stay numbers."""
    shown = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(shown, row)) + ")" for row in rows)
    names = columns.split(", ")
    picked = ", ".join(f"cast({n} as int) as {n}" if isinstance(rows[0][i], int) else f"replace({n}, '@', k) as {n}" for i, n in enumerate(names))
    return f"select distinct {picked} from (values {values}) v({columns}), (select cast(n_nationkey as varchar) as k from nation) n"
