import math

from pyspark.sql import functions as F

from skein.operators import assemble, changes, graph, routes, store, symbols


def edges(spark, text, kind=1):
    rows = [(*e.split(">"), kind) for e in text.split()]
    return spark.createDataFrame(rows, "source_id string, target_id string, edge_type int")


def as_dict(df, k="id"):
    return {r[k]: tuple(r)[1] for r in df.collect()}


def test_build_drops_loops_repeats_and_dangling(spark):
    e = edges(spark, "a>b a>b a>a b>c c>ghost")
    ids = spark.createDataFrame([(x,) for x in "abc"], "id string")
    assert {tuple(r) for r in graph.pairs(e, ids).collect()} == {("a", "b"), ("b", "c")}


def test_blast_radius_on_chain_and_cycle(spark):
    p = graph.pairs(edges(spark, "a>b b>c c>d d>a"))
    assert as_dict(graph.bfs(p, ["d"], 2, reverse=True)) == {"c": 1, "b": 2}
    assert as_dict(graph.bfs(p, ["a"], 9)) == {"b": 1, "c": 2, "d": 3}


def test_paths(spark):
    p = graph.pairs(edges(spark, "a>b a>c b>d c>d d>e a>x"))
    assert [r["path"] for r in graph.trace_paths(p, "a", "e").collect()] == [["a", "b", "d", "e"], ["a", "c", "d", "e"]]
    assert graph.trace_paths(p, "e", "a").count() == 0


def test_betweenness_of_a_chain(spark):
    got = as_dict(graph.betweenness(graph.pairs(edges(spark, "a>b b>c"))))
    assert got == {"a": 0.0, "b": 0.5, "c": 0.0}


def random_edges(seed, n, m):
    import random

    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)})


def test_betweenness_by_joins_is_the_kernels(spark):
    pairs = [e for e in random_edges(4, 14, 30) if e[0] != e[1]]
    p = spark.createDataFrame(pairs, "src string, dst string")
    want, got = as_dict(graph.betweenness(p)), as_dict(graph.betweenness(p, limit=5, blocks=2))
    assert set(want) == set(got) and all(math.isclose(want[k], got[k], abs_tol=1e-12) for k in want) and max(want.values()) > 0


def test_pagerank_converges(spark):
    pairs = [e for e in random_edges(9, 12, 26) if e[0] != e[1]]
    ids = sorted({x for e in pairs for x in e})
    out = {i: [b for a, b in pairs if a == i] for i in ids}
    r = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(300):
        lost = sum(r[i] for i in ids if not out[i])
        r = {i: 0.15 / len(ids) + 0.85 * (lost / len(ids) + sum(r[a] / len(out[a]) for a in ids if i in out[a])) for i in ids}
    got = as_dict(graph.pagerank(spark.createDataFrame(pairs, "src string, dst string"), tolerance=1e-4))
    assert all(abs(got[i] - r[i]) < 1e-3 for i in ids)


def test_pagerank_sums_to_one(spark):
    p = graph.pairs(edges(spark, "a>b b>c c>a a>d"))
    assert math.isclose(sum(as_dict(graph.pagerank(p, 10)).values()), 1, abs_tol=1e-9)
    seeds = spark.createDataFrame([("a",)], "id string")
    ppr = as_dict(graph.pagerank(p, 10, teleport=seeds))
    assert math.isclose(sum(ppr.values()), 1, abs_tol=1e-9) and ppr["a"] == max(ppr.values())


def test_subgraph_kernel_keeps_only_reached(spark):
    r = graph.ppr_kernel(["a"], ["b"], ["a"], ["a", "b", "z"], set())
    assert set(r) == {"a", "b"} and math.isclose(sum(r.values()), 1, abs_tol=1e-9)


def test_two_clusters(spark):
    p = graph.pairs(edges(spark, "a>b b>c c>a d>e e>f f>d c>d"))
    c = graph.louvain(p)
    got = as_dict(c)
    assert got["a"] == got["b"] == got["c"] != got["d"] == got["e"] == got["f"]
    q = graph.modularity(p, c).first()["q"]
    assert 0.3 < q < 0.5
    conn = graph.connectors(p, graph.betweenness(p), c, 5)
    assert {r["id"] for r in conn.collect()} == {"c", "d"}
    lp = as_dict(graph.label_propagation(p, 4))
    assert len(set(lp.values())) >= 1


def test_empty_graph(spark):
    p = graph.pairs(edges(spark, "a>a"))
    assert graph.degrees(p).count() == graph.pagerank(p, 2).count() == graph.betweenness(p).count() == graph.louvain(p).count() == 0


NODES = "id string, file_path string, symbol_name string, node_type int, start_byte long, end_byte long"


def test_store_and_symbols(spark):
    n = spark.createDataFrame([("1", "a.go", "Svc.Run", 4, 0, 9), ("2", "b.go", "Run", 1, 0, 9), ("3", "b.go", "Stop", 1, 10, 20)], NODES)
    e = spark.createDataFrame([("1", "2", 1, None), ("2", "3", 1, None), ("1", "?", 1, "Stop"), ("1", None, 8, "Run")], "source_id string, target_id string, edge_type int, target_symbol string")
    out = store.delete_by_file({"nodes": n, "edges": e}, "b.go")
    assert out["nodes"].count() == 1 and {r["target_id"] for r in out["edges"].collect()} == {"?", None}
    assert [tuple(r)[:2] for r in store.incoming_cross_file_edges(n, e, "b.go").collect()] == [("1", "2")]
    assert {(r["source_id"], r["target_id"], r["edge_type"]) for r in store.resolve_targets(e, n).collect()} == {("1", "2", 1), ("2", "3", 1), ("1", "3", 1), ("1", "2", 8)}
    assert symbols.resolve(n, "Svc::Run").first()["id"] == "1"
    assert symbols.resolve(n, "run").first()["id"] == "2"
    assert symbols.resolve(n, "nothing").count() == 0
    assert [r["id"] for r in symbols.list_file_symbols(n, "b.go").collect()] == ["2", "3"]
    new = spark.createDataFrame([("1", "a.go", "Svc.Walk", 4, 0, 9), ("4", "c.go", "New", 1, 0, 1)], NODES)
    assert {r["id"]: r["symbol_name"] for r in store.upsert(n, new, ["id"]).collect()} == {"1": "Svc.Walk", "2": "Run", "3": "Stop", "4": "New"}


def test_delta_and_snapshot(spark):
    n = spark.createDataFrame([("1", "a.go", "A", 1, 0, 3), ("2", "a.go", "B", 1, 3, 99)], NODES)
    c = spark.createDataFrame([("a.go", bytearray(b"foobar"))], "file_path string, content binary")
    s = changes.snapshot(n, c)
    h = as_dict(s.select("id", "hash"))
    assert h["2"] == "" and len(h["1"]) == 64
    assert changes.delta(s, s).count() == 0
    new = s.withColumn("hash", F.lit("x")).unionByName(spark.createDataFrame([("3", "b.go", "C", "y")], "id string, file_path string, symbol_name string, hash string"))
    assert {(r["change"], r["id"]) for r in changes.delta(s, new).collect()} == {("modified", "1"), ("added", "3")}


def test_budget_skips_and_stops(spark):
    rows = [("a", 1, 50), ("b", 2, 60), ("c", 3, 50), *[(f"x{i}", 4 + i, 99) for i in range(6)], ("z", 20, 0)]
    got = assemble.within_budget(spark.createDataFrame(rows, "id string, rank int, tokens int"), 100)
    assert [r["id"] for r in got.orderBy("rank").collect()] == ["a", "c"]


def test_workflow(spark):
    n = spark.createDataFrame([("r1", "r.php", "GET /a", 7), ("r2", "r.php", "GET /b", 7), ("r3", "r.php", "GET /c", 7), ("h", "h.php", "H.a", 4), ("k", "k.php", "K", 1)], "id string, file_path string, symbol_name string, node_type int")
    e = spark.createDataFrame([("r1", "h", 8), ("h", "k", 1), ("r2", "gone", 8)], "source_id string, target_id string, edge_type int")
    p = graph.pairs(e)
    v = assemble.verify_routes(n, e, p)
    assert {r["id"]: r["status"] for r in v.collect()} == {"r1": "confirmed", "r2": "broken", "r3": "unresolved"}
    assert assemble.risk_flags(v).first()["id"] == "r2"
    assert [r["id"] for r in assemble.critical_path(v).collect()] == ["r1"]
    h = assemble.workflow_health(v.select("phase", "confidence")).first()
    assert math.isclose(h["health"], 1.3 / 3) and h["label"] == "broken"
    assert {r["id"]: r["depth"] for r in routes.trace(n, e.withColumn("target_symbol", F.lit(None).cast("string")), p, "r1").collect()} == {"h": 0, "k": 1}
    assert "GET /a" in assemble.narrative("q", ["GET /a"], {"Entry": 1}, [], "partial")


def test_routes(spark):
    r = spark.createDataFrame([("1", "POST /v1/orders"), ("2", "GET /v3/orders/{id}"), ("3", "POST /v2/orders"), ("4", "POST /v2/orders/create")], "id string, symbol_name string")
    got = [x["id"] for x in routes.find(r, "v2 orders").collect()]
    assert got[0] in ("3", "4") and "1" not in got and len(got) == 3
    res = spark.createDataFrame([("photos", "PhotoController", False), ("api/x", "XController", True)], "path string, controller string, api_only boolean")
    assert routes.expand_resources(res).count() == 12
