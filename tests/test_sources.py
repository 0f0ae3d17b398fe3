import subprocess
import time

from skein.schema import CALLS, DEFINES_METHOD, HANDLES, INHERITS
from skein.sources import parsers, tree
from skein.streaming import events as E

GO = b'''package calc

import (
\t"fmt"
)

// Calc adds.
type Calc struct {
\tn int
}

// Add adds two numbers.
func (c *Calc) Add(a int, b int) int {
\tfmt.Println("call(x)")
\treturn helper(a)
}

func helper(a int) int { return a }

func routes(r Router) { r.GET("/v1/sum", Sum) }
'''
JS = b'''import { x } from './dep';
class User extends Base {
  greet(name) { return this.shout(name); }
  shout(n) { return n; }
}
function main() { const u = new User(); run(u); }
const go = (a) => { main(); };
app.use('/api', router);
router.get('/users/:id', auth, getUser);
'''
PHP = rb'''<?php
use App\Models\Order;
class OrderController extends Controller implements Shows {
    // shows it
    public function show($id) { return $this->load($id) ?? Order::find($id); }
    private function load($id) { return new Order($id); }
}
Route::prefix('v1')->group(function () {
    Route::post('/orders', [OrderController::class, 'store']);
});
Route::apiResource('photos', PhotoController::class);
'''


def parsed(path, raw):
    nodes, edges = parsers.parse_file(path, raw)
    names = {n[0]: n[2] for n in nodes}
    return {n[2]: n for n in nodes}, {(names.get(a), names.get(b, s), k) for a, b, k, s in edges}


def test_go():
    n, e = parsed("calc.go", GO)
    assert {"calc.go", "Calc", "Calc.Add", "helper", "routes", "GET /v1/sum"} <= set(n)
    assert ("Calc", "Calc.Add", DEFINES_METHOD) in e and ("Calc.Add", "helper", CALLS) in e
    assert ("GET /v1/sum", "Sum", HANDLES) in e and not any(b == "call" for _, b, _ in e)
    start, end = n["Calc.Add"][4:6]
    assert GO[start:end].startswith(b"func (c *Calc) Add") and GO[start:end].endswith(b"}")
    assert n["Calc.Add"][6] == "Add adds two numbers. Calc.Add(int, int)"


def test_js():
    n, e = parsed("user.js", JS)
    assert {"User", "User.greet", "User.shout", "main", "go", "GET /api/users/:id"} <= set(n)
    assert ("User", "Base", INHERITS) in e and ("User.greet", "User.shout", CALLS) in e and ("go", "main", CALLS) in e
    assert ("GET /api/users/:id", "getUser", HANDLES) in e


def test_php():
    n, e = parsed("routes.php", PHP)
    assert {"OrderController.show", "POST /v1/orders", "GET /photos", "DELETE /photos/{id}"} <= set(n) and "GET /photos/create" not in n
    assert ("OrderController.show", "OrderController.load", CALLS) in e and ("POST /v1/orders", "OrderController.store", HANDLES) in e


def test_other_files():
    assert parsers.parse_file("a.txt", b"x") == ([], []) and parsers.parse_file("a.go", b"x" * (parsers.MAX_BYTES + 1)) == ([], [])
    assert parsers.file_document("a/b.sql", "é".encode() * 3000).endswith("...")


def test_tree_and_git(spark, tmp_path):
    for path, text in {"a.go": GO.decode(), "sub/u.js": JS.decode(), "sub/skip.js": "x", "vendor/v.php": "<?php", "README.md": "# hi", ".gitignore": "skip.*\n!keep.js\n"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = tree.read_tree(spark, str(tmp_path))
    assert {r["file_path"] for r in files.select("file_path").collect()} == {"a.go", "sub/u.js"}
    out = parsers.parse(files)
    assert parsers.nodes_of(out).filter("symbol_name = 'User.greet'").count() == 1 and parsers.edges_of(out).count() > 5
    assert [r["file_path"] for r in tree.architecture_docs(spark, str(tmp_path)).collect()] == ["README.md"]
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "a.go")
    git("commit", "-qm", "first\n\nBy: me")
    assert tree.git_commits(spark, str(tmp_path)).first()["subject"] == "first"
    assert [r["change_type"] for r in tree.git_file_history(spark, str(tmp_path)).collect()] == ["added"]
    assert tree.git_snapshot(spark, str(tmp_path)).first()["untracked"] >= 1


def stamp(s):
    return f"2024-01-01 00:00:{s:06.3f}"


def events(spark, text):
    rows = [(e.split(":")[0], e.split(":")[1], stamp(float(e.split(":")[2]))) for e in text.split()]
    return spark.createDataFrame(rows, "path string, action string, t string").selectExpr("path", "action", "timestamp(t) AS ts")


def test_debounce(spark):
    got = E.debounce(events(spark, "a:create:1 a:modify:1.2 a:modify:1.5 a:modify:9 b:create:1 b:delete:1.1 c:delete:1 c:create:1.1 d:delete:1 d:modify:1.1"))
    assert sorted((r["path"], r["action"], r["n"]) for r in got.collect()) == [("a", "create", 3), ("a", "modify", 1), ("b", "delete", 2), ("c", "create", 2), ("d", "modify", 2)]


def test_fold_equals_session_rule(spark):
    import itertools

    for seq in itertools.product(["create", "modify", "delete"], repeat=4):
        p = None
        for a in seq:
            p = E.fold(p, a)
        d = max((i for i, a in enumerate(seq) if a == "delete"), default=-1)
        want = "delete" if seq[-1] == "delete" else "create" if "create" in seq[d + 1 :] else "modify"
        assert p == want, seq


def test_debounce_stream(spark, tmp_path):
    src = tmp_path / "in"
    events(spark, "a:create:1 a:modify:1.2 b:modify:2").write.parquet(str(src), mode="append")
    stream = spark.readStream.schema("path string, action string, ts timestamp").parquet(str(src))
    q = E.debounce_stream(stream, 500, "1 second").writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        events(spark, "z:modify:50").write.parquet(str(src), mode="append")
        q.processAllAvailable()
        end = time.time() + 60
        while time.time() < end and spark.table("debounced").count() < 2:
            q.processAllAvailable()
            time.sleep(0.5)
        assert {(r["path"], r["action"], r["n"]) for r in spark.table("debounced").collect()} >= {("a", "create", 2), ("b", "modify", 1)}
    finally:
        q.stop()


def test_apply_events_keeps_incoming_edges(spark):
    n = spark.createDataFrame([("1", "a.go", "A"), ("2", "b.go", "B"), ("3", "b.go", "Old")], "id string, file_path string, symbol_name string")
    e = spark.createDataFrame([("1", "2", 1, None), ("1", "3", 1, None), ("2", "1", 1, None)], "source_id string, target_id string, edge_type int, target_symbol string")
    ev = spark.createDataFrame([("b.go", "modify")], "path string, action string")

    def parse(paths):
        return spark.createDataFrame([("2", "b.go", "B")], n.schema), spark.createDataFrame([], e.schema)

    out = E.apply_events({"nodes": n, "edges": e}, ev, parse)
    assert {(r["source_id"], r["target_id"]) for r in out["edges"].collect()} == {("1", "2")}
    assert out["nodes"].count() == 2
