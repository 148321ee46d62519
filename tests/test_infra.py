from archspan.operators import infra

FILES = {
    "k8s/kustomization.yaml": "resources:\n- api\n- ./worker\n- missing\n",
    "k8s/api/deployment.yaml": "kind: Deployment\nmetadata:\n  name: api\n  labels:\n    app.kubernetes.io/component: backend\nspec:\n  template:\n    spec:\n      containers:\n      - image: reg.io/team/api-server:1.2\n        ports:\n        - containerPort: 8080\n        env:\n        - name: DATABASE_URL\n        - name: WORKER_SERVICE_HOST\n        - name: OTHER\n        - name: BILLING_URL\n",
    "k8s/api/service.yaml": "kind: Service\nmetadata:\n  namespace: prod\nspec:\n  ports:\n  - port: 80\n",
    "k8s/worker/statefulset.yml": "kind: StatefulSet\nmetadata:\n  name: my-worker-service\nspec:\n  template:\n    spec:\n      containers:\n      - image: worker\n",
    "charts/web/Chart.yaml": "name: web\ndependencies:\n- name: redis\n",
    "charts/web/values.yaml": "image:\n  repository: reg/web\n  tag: v1\nservice:\n  port: 3000\nenv:\n  REDIS_HOST: x\n",
    "charts/bad/Chart.yaml": "name: [unclosed\n",
    "tf/main.tf": 'module "net" {\n  source = "./net"\n}\nmodule "app" {\n  source = "./app"\n  vpc = module.net.id\n  self = module.app.x\n}\nresource "aws_s3_bucket" "logs" {\n}\n',
    "tf/more.tf": 'module "db" {\n  a = module.net.x\n  b = module.unknown.y\n}\n',
    "node_modules/x/Chart.yaml": "name: hidden\n",
}


def test_topology(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    nodes, edges = infra.topology(files)
    n = {r["id"]: r for r in nodes.collect()}
    assert set(n) == {"infra/api", "infra/my-worker-service", "infra/web", "infra/tf-net", "infra/tf-app", "infra/tf-db", "infra/tf-logs"}
    assert (n["infra/api"]["kind"], n["infra/api"]["port"], n["infra/api"]["component"]) == ("deployment", 8080, "backend")
    assert (n["infra/web"]["image"], n["infra/web"]["port"]) == ("reg/web:v1", 3000)
    assert n["infra/tf-logs"]["component"] == "aws_s3_bucket"
    e = {(r["source"], r["target"], r["edge_type"]) for r in edges.collect()}
    assert e == {
        ("infra/api", "api", "k8s-service"),
        ("infra/api", "infra/postgres", "k8s-depends"),
        ("infra/api", "infra/my-worker-service", "k8s-depends"),
        ("infra/api", "infra/billing", "k8s-depends"),
        ("infra/api", "api-server", "infra-maps"),
        ("infra/my-worker-service", "worker", "infra-maps"),
        ("infra/web", "infra/redis", "helm-depends"),
        ("infra/web", "infra/redis", "k8s-depends"),
        ("infra/web", "web", "infra-maps"),
        ("infra/tf-app", "infra/tf-net", "tf-depends"),
        ("infra/tf-db", "infra/tf-net", "tf-depends"),
    }
    lines = [r["line"] for r in infra.fact_lines(nodes, edges).orderBy("part", "line").collect()]
    assert "(infra-node infra/api :kind deployment :image reg.io/team/api-server:1.2 :port 8080 :component backend)" in lines
    assert "(k8s-service infra/api api :namespace prod)" in lines
    assert "(k8s-depends infra/api infra/postgres :via env :transport tcp)" in lines


def test_empty(spark):
    nodes, edges = infra.topology(spark.createDataFrame([], "path string, content string"))
    assert nodes.collect() == [] and edges.collect() == []


def test_parts_of_names_are_never_broadcast(spark):
    """A name has many parts, and sizes are estimated from the names alone."""
    rows = spark.createDataFrame([("i1", "REDIS_URL"), ("i2", "PAY_HOST"), ("i3", "PLAIN")], "id string, env string")
    known = spark.createDataFrame([("shop-pay",), ("pay",), ("pa",), ("x",)], "name string")
    planned = []
    write = infra.Scratch.write
    try:
        infra.Scratch.write = lambda self, df, name: (planned.append(df._jdf.queryExecution().optimizedPlan().toString()), write(self, df, name))[1]
        got = {(r["source"], r["target"]) for r in infra._env_edges(rows, known).collect()}
    finally:
        infra.Scratch.write = write
    assert got == {("i1", "infra/redis"), ("i2", "infra/pay")}
    assert len(planned) == 1 and "strategy=merge" in planned[0]
    text = spark.createDataFrame([("abcab", "x")], "name string, y string")
    assert sorted(text.select(infra._parts("name", [2, 4, 9])).first()[0]) == ["ab", "abca", "bc", "bcab", "ca"]
