import json

import pytest
from pyspark.sql import functions as F

from skein.operators import store, workflow
from skein.plans import service as S


def test_profiles():
    assert S.in_profile("retrieve_output", "minimal") and S.in_profile("context") and not S.in_profile("explore") and S.in_profile("explore", "extended")
    assert S.in_profile("health", "minimal") and not S.in_profile("context", "minimal") and S.in_profile("anything", "full")


def test_discovery():
    assert S.choose_tools("trace the blast radius of a change")[0] == "change_analysis"
    bundle, tools, words = S.choose_tools("zzz")
    assert (bundle, tools, words) == ("fallback", [], [])
    box = S.Toolbox({t: (lambda t=t, **a: (t, a)) for ts, _ in S.BUNDLES.values() for t in ts.split()})
    assert "explore" not in box.active
    got = box.discover("architecture overview of modules")
    assert "explore" in got["activated"] and "explore" in box.active and got["activated_count"] <= 5
    assert box.discover(activate=["explore"])["already_active"] == ["explore"]
    assert box.execute("explore", a=1) == ("explore", {"a": 1})
    with pytest.raises(PermissionError):
        box.execute("search_code")
    with pytest.raises(KeyError):
        box.execute("nothing")
    with pytest.raises(ValueError):
        box.discover()


def test_output_store_pages_and_forgets():
    now = [0.0]
    s = S.OutputStore(most=2, ttl=10, clock=lambda: now[0])
    a = s.put("x", b"0123456789")
    assert s.page(a, 2, 3) == {"content": "234", "total_size": 10, "returned_bytes": 3, "remaining_bytes": 5, "has_more": True, "next_args": {"handle": a, "offset": 5, "limit": 3}}
    assert s.page(a, 50)["content"] == "" and not s.page(a)["has_more"]
    b, c = s.put("x", b"b"), s.put("x", b"c")
    with pytest.raises(KeyError):
        s.page(a)
    now[0] = 11.0
    d = s.put("x", b"d" * 20_000)
    assert set(s.held) == {d} and s.page(d, limit=99_999)["returned_bytes"] == 16_000 and {b, c} & set(s.held) == set()


def test_responses():
    s = S.OutputStore()
    assert S.response("short", store=s) == "short" and json.loads(S.response({"a": 1})) == {"a": 1}
    out = json.loads(S.response({"a": "é" * 20_000}, "impact", s))
    assert out["sandboxed"] and out["recovery_hint"].startswith("Try compact") and s.page(out["handle"])["total_size"] == out["size_bytes"]
    for big in ("x" * 1_200_000, "é" * 900_000):
        cut = S.response(big)
        assert len(cut.encode()) <= S.RESPONSE_BYTES and cut.endswith("exceeded 1MB]")
    cut = S.response({"a": "\\\"\n" * 500_000})
    assert len(cut.encode()) <= S.RESPONSE_BYTES and json.loads(cut)["truncated"]


def test_names(tmp_path):
    assert S.check_git_ref("feature/my-branch~2") == "feature/my-branch~2"
    for bad in ("-x", "a..b", "HEAD@{1}", "a b", "$(x)", ""):
        with pytest.raises(ValueError):
            S.check_git_ref(bad)
    (tmp_path / "r/a").mkdir(parents=True)
    (tmp_path / "r/out").symlink_to(tmp_path)
    assert S.repo_path(str(tmp_path / "r"), "a/../a")[0] == "a" and S.repo_path(str(tmp_path / "r"), str(tmp_path / "r"))[0] == "."
    for bad in ("..", "out", "/etc", ""):
        with pytest.raises(ValueError):
            S.repo_path(str(tmp_path / "r"), bad)


def test_embedder_order():
    def broken():
        raise OSError

    assert S.choose_embedder({"tfidf": lambda: 1, "ollama": broken}) == ("tfidf", 1)
    with pytest.raises(LookupError):
        S.choose_embedder({})


def test_replace_table_survives(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace_table(spark.range(3), path)
    old = store.read_table(spark, path)
    store.replace_table(old.unionByName(spark.range(3, 5)), path)
    assert store.read_table(spark, path).count() == 5 and old.count() == 3
    # a version that was never finished is no version
    (tmp_path / "t/v=00000003").mkdir()
    (tmp_path / "t/v=00000003/part-0.parquet").write_text("half")
    assert store.read_table(spark, path).count() == 5
    store.replace_table(spark.range(1), path)
    assert store.read_table(spark, path).count() == 1
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, str(tmp_path / "none"))


def test_equal_steps_count_once(spark):
    one = workflow.step(workflow.CORE, symbol_id=F.lit("a"), mode=F.lit("x"))
    same = workflow.step(workflow.CORE, mode=F.lit("x"), symbol_id=F.lit("a"))
    other = workflow.step(workflow.CORE, symbol_id=F.lit("b"), mode=F.lit("x"))
    got = spark.range(1).select(workflow.distinct_steps(F.array(one, F.lit(None).cast(workflow.STEP), same, other, other), 3).alias("s")).first()["s"]
    assert [r["args"]["symbol_id"] for r in got] == ["a", "b"]
