from skein.operators import store
from skein.streaming import events as E

NODES = "id string, file_path string, symbol_name string, node_type int"
EDGES = "source_id string, target_id string, edge_type int, target_symbol string"


def test_counters_outlive_a_restart(spark, tmp_path):
    """Changes are counted over restarts, an applied batch is not applied again, and scores are refreshed in time."""
    src = tmp_path / "in"
    src.mkdir()
    state = {"nodes": spark.createDataFrame([("old", "a.go", "A", 1)], NODES), "edges": spark.createDataFrame([], EDGES)}
    writes, refreshed = [], []

    def parse(paths):
        n = paths.selectExpr("concat('n:', path) AS id", "path AS file_path", "path AS symbol_name", "1 AS node_type")
        return spark.createDataFrame(n.collect(), NODES), spark.createDataFrame([], EDGES)

    def write(tables):
        state["nodes"] = spark.createDataFrame(tables["nodes"].select("id", "file_path", "symbol_name", "node_type").collect(), NODES)
        writes.append(sorted(r["id"] for r in state["nodes"].collect()))

    def batch(name, rows):
        spark.createDataFrame(rows, "path string, action string").coalesce(1).write.parquet(str(src / name))

    def go():
        stream = spark.readStream.schema("path string, action string").parquet(f"{src}/*")
        q = E.run_index_stream(stream, lambda: state, write, parse, str(tmp_path / "cp"), lambda: refreshed.append(len(writes)), refresh_after=3)
        q.processAllAvailable()
        q.stop()

    batch("b0", [("a.go", "modify"), ("b.go", "create")])
    go()
    assert writes[-1] == ["n:a.go", "n:b.go"] and refreshed == []
    go()
    assert len(writes) == 1
    batch("b1", [("b.go", "delete")])
    go()
    assert writes[-1] == ["n:a.go"] and len(refreshed) == 1
    assert store.read_table(spark, str(tmp_path / "cp-progress")).first()["changes"] == 0
