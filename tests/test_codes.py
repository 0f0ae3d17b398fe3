"""Codes of node ids, tables that cut plans, and loops over links that repeat."""

import os
import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from skein.operators import graph, lineage
from skein.sources import tables as T


def test_code_sorts_as_its_id_and_gives_it_back(spark):
    rng = random.Random(3)
    keys = sorted({0, 1, 9, 10, 99, 100, 10**15, 10**16 - 1, *(rng.randrange(10 ** rng.randrange(1, 17)) for _ in range(200))})
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    seen = {}
    for kind in T.KINDS:
        for r in df.select("k", T.code(kind, "k").alias("c")).select("k", "c", T.name("c").alias("id")).collect():
            assert r["id"] == f"{kind}:{r['k']}" and r["c"] == T.code_of(r["id"])
            seen[r["id"]] = r["c"]
    assert sorted(seen) == sorted(seen, key=seen.get)


@pytest.mark.parametrize("key", [-1, 10**16])
def test_key_without_code_is_an_error(spark, key):
    with pytest.raises(Exception, match="no code for key"):
        spark.createDataFrame([(key,)], "k long").select(T.code("part", "k")).collect()


def test_cut_runs_a_plan_once_and_drop_removes_it(spark):
    ran = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            ran.add(len(b))
            yield b

    kept = lineage.cut(spark.range(10).mapInPandas(run, "id long"))
    assert kept.count() == 10 and ran.value == 10
    path = kept._skein_path.removeprefix("file://")
    assert os.path.isdir(path)
    lineage.drop(kept, None)
    assert not os.path.exists(path)


def exchanges(df):
    # bytes of the texts of ids never go through an exchange
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]


def test_label_propagation_shuffles_codes(spark):
    links = T.links(spark, DATA)
    assert {f.dataType.simpleString() for f in links.schema} == {"bigint"}
    # the layout by one end, shared by all steps, and a vote for each step
    found = [x for x in exchanges(graph.label_propagation(links, 3)) if "Reused" not in x]
    assert all("hashpartitioning(src" in x or "hashpartitioning(dst" in x for x in found)


def plain_labels(edges, steps):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    labels = {x: x for x in near}
    for _ in range(steps):
        votes = {x: [labels[y] for y in ys] for x, ys in near.items()}
        labels = {x: min(set(v), key=lambda c: (-v.count(c), c)) for x, v in votes.items()}
    return labels


@pytest.mark.parametrize("steps", [0, 1, 2, 7])
def test_label_propagation_of_repeated_links(spark, steps):
    rng = random.Random(8)
    edges = [(rng.randrange(30), 30 + rng.randrange(12)) for _ in range(80)]
    p = spark.createDataFrame(edges + edges[:40], "src long, dst long")
    assert {r["id"]: r["community"] for r in graph.label_propagation(p, steps).collect()} == plain_labels(edges, steps)


def test_paths_over_repeated_links_stay_in_reach_of_the_start(spark, monkeypatch):
    # 60 callers of the goal are out of the start's reach: a walk back must not gather them
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 5), (2, 4), *((100 + i, 5) for i in range(60))]
    p = spark.createDataFrame(edges, "src long, dst long")
    rows = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rows.append((out := cut(df)).count()) or out)
    assert [r["path"] for r in graph.trace_paths(p, 1, 5).collect()] == [[1, 2, 4, 5], [1, 3, 4, 5]]
    assert max(rows) <= 5


def test_pagerank_of_repeated_links_keeps_one_state(spark):
    edges = [(1, 2), (1, 2), (1, 3), (2, 3), (3, 1), (3, 4), (3, 4)]
    p = spark.createDataFrame(edges, "src long, dst long")
    folder = lineage.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = {r["id"]: r["rank"] for r in graph.pagerank(p, 6, tolerance=0).collect()}
    assert len(set(os.listdir(folder)) - before) == 1
    once = {r["id"]: r["rank"] for r in graph.pagerank(p.distinct(), 6, tolerance=0).collect()}
    assert got.keys() == once.keys() and all(abs(got[k] - once[k]) < 1e-12 for k in got) and abs(sum(got.values()) - 1) < 1e-9


def test_phase_digests_are_those_of_the_lists(spark, monkeypatch):
    from skein.operators import workflow

    rows = [("ab"[i % 2], i % 7, f"x{i * 37 % 500}") for i in range(900)]
    items = spark.createDataFrame(rows, "phase string, rank int, id string").repartition(3)
    monkeypatch.setattr(workflow, "PIECE", 10)
    want = workflow.phase_groups(items).select("phase", F.md5(F.array_join("ids", ",")).alias("ids"), F.size("ids").alias("n"))
    got = workflow.phase_digests(items)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ranked_changes_of_many_roots(spark):
    from skein.operators import changes

    edges = [(1000 + i, i % 60) for i in range(130)] + [(2000 + i, 1000 + i) for i in range(50)] + [(0, 2000), (1, 0), (1000, 0)]
    p = spark.createDataFrame(edges + edges[:30], "src long, dst long")
    ch = spark.createDataFrame([(i, "added") for i in range(60)], "id long, change string")
    got = {r["id"]: r["dependents"] for r in changes.rank_changes(ch, p, spark.createDataFrame([], "id long, betweenness double")).collect()}
    for root in range(60):
        reached, front = {root}, {root}
        for _ in range(3):
            front = {a for a, b in edges if b in front} - reached
            reached |= front
        assert got[root] == len(reached) - 1


def test_direct_edges_of_repeated_links(spark):
    from skein.operators import workflow

    p = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "src long, dst long")
    asked = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "source_id long, target_id long")
    assert sorted(map(tuple, workflow.direct_edges(asked, p).collect())) == [(1, 2, True), (1, 3, False)]


@pytest.mark.parametrize("name", ["entry_points", "valid_edges_semi", "direct_edges", "graph_coverage", "key_symbols", "connectors"])
def test_no_exchange_of_edges_by_text(spark, name):
    from skein.plans import catalogue

    assert not [x for x in exchanges(catalogue.QUERIES[name](spark, DATA)) if "target_id" in x]


def test_betweenness_in_small_batches(spark, monkeypatch):
    rng = random.Random(6)
    edges = sorted({(a, b) for a, b in ((rng.randrange(20), rng.randrange(20)) for _ in range(60)) if a != b})
    p = spark.createDataFrame(edges, "src long, dst long")
    want = {r["id"]: r["betweenness"] for r in graph.betweenness(p, limit=5, blocks=2).collect()}
    monkeypatch.setattr(graph, "HELD", 16)
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(p).collect()}
    assert got.keys() == want.keys() and max(got.values()) > 0 and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_hybrid_search_takes_edges_of_candidates_only(spark, monkeypatch):
    from skein.operators import search
    from skein.plans import catalogue

    sizes, pairs = [], graph.pairs
    monkeypatch.setattr(graph, "pairs", lambda e, *a: sizes.append(e.count()) or pairs(e, *a))
    assert catalogue.QUERIES["hybrid_search"](spark, DATA).count() == 10
    assert sizes and max(sizes) < T.edges(spark, DATA, repeats=True).count() / 4 and search


def test_embedding_hashes_a_feature_once():
    from skein.operators import vector

    vector.feature_hashes.cache_clear()
    a = vector.embed("parse the order and parse the part")
    done = vector.feature_hashes.cache_info().misses
    assert (vector.embed("parse the order and parse the part") == a).all() and vector.feature_hashes.cache_info().misses == done
    assert vector.feature_hashes("tri:abc") == tuple(vector.fnv1a32(b"tri:abc", s) for s in vector._SEEDS)
