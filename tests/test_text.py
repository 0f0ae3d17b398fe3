import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import fts, lines, search, vector
from skein.plans import sql_guard


@pytest.mark.parametrize(
    "name, parts",
    [("ReadFile", "Read File"), ("HTTPServer", "HTTP Server"), ("parseJSON", "parse JSON"), ("simple", "simple"), ("ABC", "ABC"), ("HTMLParser", "HTML Parser"), ("", ""), ("a", "a"), ("getHTTPSConnection", "get HTTPS Connection"), ("A_bc", "Abc")],
)
def test_split_camel(name, parts):
    assert X.split_camel(name) == parts.split()


def one(spark, column, **cols):
    schema = ", ".join(f"{k} string" for k in cols) or "x string"
    return spark.createDataFrame([tuple(cols.values()) or ("",)], schema).select(column.alias("v")).first()["v"]


def test_search_terms(spark):
    got = one(spark, X.search_terms(F.col("s"), F.col("p")), s="stockTransaction", p="app/Inventory.php").split()
    assert got == ["stockTransaction", "Inventory", "stock", "transaction", "inventory"]
    got = one(spark, X.search_terms(F.col("s"), F.col("p")), s="POST /v1/shop/{storeID}", p="routes/api_v1.php").split()
    assert {"post", "v1", "shop", "storeid", "api"} <= set(got)


@pytest.mark.parametrize(
    "path, cat",
    [("a/generated/x.go", "generated"), ("x.d.ts", "generated"), ("vendor/a.php", "vendor"), ("db/migrations/1.php", "migration"), ("a/b_test.go", "test"), ("FooTest.php", "test"), ("examples/a.js", "example"), ("config/app.php", "config"), ("app/a.php", "core")],
)
def test_path_category(spark, path, cat):
    assert one(spark, X.path_category(F.col("p")), p=path) == cat


def test_queries():
    assert X.clean_query("How does the Order flow work end to end") == "the order flow work"
    assert [X.query_kind(q) for q in ("POST orders", "payment workflow", "OrderController", "my_func", "plain words")] == ["route", "workflow", "class", "function", "natural"]
    terms = dict(X.query_terms("authentication is ok"))
    assert {"authentication", "oauth", "ok"} <= set(terms) and terms["ok"] is False and "is" not in terms
    assert X.route_keywords("GET the /orders/ api") == ["orders"]
    assert X.sanitize('a* "b" AND c') == "a b and c"
    assert X.symbol_variants("A::b") == ["A::b", "A.b", "b"]


def test_scalar_columns(spark):
    assert one(spark, X.strip_version(F.col("p")), p="/v2/orders") == "/orders"
    assert one(spark, X.normalize_path(F.col("p")), p="a//b/") == "/a/b"
    assert one(spark, X.trailers(F.col("p")), p="text\n\nCloses: 1\n\nBy: x\nCloses: 2\n") == {"Closes": "1", "By": "x"}
    assert one(spark, X.trailers_json(F.col("p")), p="text\nno trailer: here\nB: 2\nA: 1") == '{"A":"1","B":"2"}'
    assert one(spark, X.trailers_json(F.col("p")), p="text") == ""
    assert one(spark, X.symbol_score("Foo.bar", F.col("p")), p="Foo::bar") == 950
    assert one(spark, X.truncate_bytes(F.col("p"), 12), p="hello world foo") == "hello world"
    assert one(spark, X.truncate_bytes(F.col("p"), 12), p="hello w\nor d foo") == "hello w"
    for n in range(1, 12):
        assert one(spark, X.truncate_bytes(F.col("p"), n), p="aé中😀é中") == "aé中😀é中".encode()[:n].decode(errors="ignore")
    assert one(spark, X.content_hash(F.col("p")), p="a") == "af63dc4c8601ec8c"
    assert one(spark, F.array_join(lines.helper_calls(F.col("p")), ","), p="if (a(b(1)))") == "a,b"


def test_block_summary_is_linear(spark):
    from time import monotonic

    from skein.operators.workflow import NO_MENTION, block_summary

    told = {"x": NO_MENTION, "if (y) for(z)": NO_MENTION, "iffy (1)": "Highlights helper calls.", "1if( 2run\t(": "Highlights helper calls.", "Queue; HTTP": "Highlights job dispatch, integration calls.", "f\x0b(": NO_MENTION, "Valid(éa(b": "Highlights validation, helper calls."}
    df = spark.createDataFrame([(t,) for t in told] + [(None,)], "text string")
    assert {r["text"]: r["s"] for r in df.select("text", block_summary(F.col("text")).alias("s")).collect()} == told | {None: NO_MENTION}
    assert one(spark, F.array_join(lines.helper_calls(F.col("p")), ","), p="9a1 (if(é_b\n(a1(") == "a1,_b"
    start = monotonic()
    for run in ("a" * 300_000, "a1" * 150_000, "a" + " " * 300_000, "ab " * 100_000, "a" * 1000 + " " * 300_000):
        assert one(spark, block_summary(F.col("p")), p=run) == NO_MENTION
        assert one(spark, F.size(lines.helper_calls(F.col("p"))), p=run) == 0
    assert monotonic() - start < 20
    # lower case is made once for all markers
    plan = df.select(block_summary(F.col("text")).alias("s"))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan


def test_bm25_against_plain(spark):
    docs = [("1", "red red blue"), ("2", "blue"), ("3", "green grass"), ("4", None), ("5", "redwood")]
    df = spark.createDataFrame(docs, "id string, text string")
    got = {r["id"]: r["score"] for r in fts.bm25(df, "id", {"text": 1.0}, [("red", True)]).collect()}
    n, dl = 5, {"1": 3, "5": 1}
    idf, avg = max(1e-6, math.log((n - 2 + 0.5) / 2.5)), (3 + 1 + 2 + 0 + 1) / 5
    for k, tf in (("1", 2), ("5", 1)):
        assert math.isclose(got[k], idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[k] / avg)), rel_tol=1e-9)
    assert set(got) == {"1", "5"}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0])], "id int, v array<float>")
    assert [(r["id"], round(r["score"], 6)) for r in vector.knn(df, "id", "v", [1.0, 0.0], 4).collect()] == [(1, 1.0), (2, 0.0), (3, 0.0), (4, 0.0)]
    two = df.filter("id < 3")
    got = vector.knn_batch(two, "id", "v", np.array([[1.0, 0.1], [0.0, 1.0]]), 1).orderBy("query").collect()
    assert [r["id"] for r in got] == [1, 2]
    v = vector.embed("readFileContents opens a file")
    assert math.isclose(float(np.linalg.norm(v)), 1, abs_tol=1e-5) and (v == vector.embed("readFileContents opens a file")).all()
    assert not vector.embed("").any()


def test_hybrid_search(spark):
    rows = [("c", "compute.go", "ComputeChecksum", "computes a checksum of data"), ("r", "read.go", "ReadFileContents", "reads file contents"), ("d", "db.go", "OpenDatabaseConnection", "opens the database"), ("t", "tests/read_test.go", "ReadFileTest", "tests reading files"), ("x", "x.go", "Unrelated", "other")]
    n = spark.createDataFrame([(*r[:3], 1, r[3]) for r in rows], "id string, file_path string, symbol_name string, node_type tinyint, content_sum string")
    e = spark.createDataFrame([("r", "d", 1), ("r", "x", 1), ("d", "x", 1)], "source_id string, target_id string, edge_type int")
    got = [r["id"] for r in search.hybrid_search(n, e, "read file contents", 5).collect()]
    assert got[0] == "r" and got.index("t") > 0
    assert search.hybrid_search(n, e, "  ", 5).count() == 0
    capped = search.per_file_cap(n.withColumn("score", F.lit(1.0)).withColumn("file_path", F.lit("one.go")), 2)
    assert capped.count() == 2


def test_lines(spark):
    df = spark.createDataFrame([("a", "x\nif (save()) {\ny\n\nz"), ("b", "none")], "id string, text string")
    assert [(r["id"], r["line"]) for r in lines.regex_scan(df, "id", "text", r"save\(").collect()] == [("a", 2)]
    ls = lines.lines_of(df, "id", "text").withColumn("score", lines.line_score(F.col("text")))
    best = {r["id"]: r["start"] for r in lines.densest_window(ls, 2).collect()}
    assert best == {"a": 1, "b": 1}
    sig = spark.createDataFrame([(1, 2), (1, 5), (1, 20)], "id int, line int")
    assert {(r["start"], r["end"]) for r in lines.gap_blocks(sig).collect()} == {(2, 5), (20, 20)}
    assert one(spark, lines.read_window(F.col("p"), 1, 9, 2), p="a\nb\nc") == "a\nb"
    assert one(spark, lines.read_window(F.col("p"), 1, 9, 2, keep_bottom=True), p="a\nb\nc") == "b\nc"
    assert one(spark, lines.signature(F.col("p")), p="\n// c\nfunc A()") == "func A()"


ATTACKS = [
    "DROP TABLE x", "SELECT 1; SELECT 2", "WITH RECURSIVE r AS (SELECT 1) SELECT * FROM r", "INSERT INTO x VALUES (1)", "", "SET a = 1",
    "SELECT * FROM parquet.`/etc/passwd`", "SELECT * FROM text.`file:///etc/passwd`", "SELECT * FROM csv.`/x` a JOIN nums b ON true", "WITH parquet AS (SELECT 1) SELECT * FROM parquet.`/x`",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT id FROM nums WHERE id IN (SELECT java_method('java.lang.Math', 'abs', 1))", "SELECT /* a */ try_reflect('java.lang.System', 'exit', 1) FROM nums",
    "SELECT * FROM hidden", "SELECT (SELECT max(id) FROM hidden)", "WITH a AS (SELECT * FROM hidden) SELECT * FROM a", "SELECT * FROM nums WHERE EXISTS (SELECT 1 FROM hidden)", "SELECT * FROM global_temp.nums",
    "SELECT TRANSFORM(id) USING 'cat' AS (a) FROM nums", "SELECT * FROM range(10)", "SELECT my_udf(id) FROM nums", "SELECT current_user()", "SELECT * FROM `default`.nums",
]


@pytest.mark.parametrize("sql", ATTACKS)
def test_sql_guard_rejects(spark, sql):
    spark.range(3).createOrReplaceTempView("hidden")
    spark.udf.register("my_udf", lambda x: x)
    with pytest.raises(sql_guard.RejectedQuery):
        sql_guard.query(spark, sql, {"nums": spark.range(5)})


def test_sql_guard_limits(spark):
    views = {"nums": spark.range(1000)}
    assert sql_guard.query(spark, "SELECT * FROM nums", views).count() == 500
    assert sql_guard.query(spark, "SELECT 'drop; it' AS replace_me FROM nums LIMIT 3;", views).count() == 3
    assert sql_guard.query(spark, "WITH a AS (SELECT id % 3 AS k FROM NUMS), b AS (SELECT k, count(*) AS n FROM a GROUP BY k) SELECT upper(concat('x', k)) AS x, n FROM b WHERE n IN (SELECT max(n) FROM b) -- ; DROP", views).count() == 1


LOW = ["fix lint", "Fix Lint: x", "WIP", "nit: y", "revert \"a\"", "squash", "initial commit", "merge branch 'x'", "update deps now"]
TELLING = ["fix", "refactor", "typo", "nitpick", "reverted", "fix linter", "merge", "chore: x", "style"]


def test_low_signal(spark):
    for s in LOW + TELLING:
        assert one(spark, X.is_low_signal(F.col("p")), p=s) == (s in LOW), s


def embed_by_rule(text, dim=384):
    """The embedder written out from its description: word, trigram and bigram shares, four signed places each."""
    import re
    from collections import Counter

    words = [p.lower() for w in re.split(r"[\s_./\\\-(){}\[\]:;,\"'`=+*&|<>#@!?]+", text.strip()) for p in X.split_camel(w)]
    words = [w for w in words if len(w.encode()) > 1]
    v = np.zeros(dim)

    def put(name, weight):
        for seed in range(4):
            h = 2166136261
            for c in seed.to_bytes(4, "little") + name.encode():
                h = (h ^ c) * 16777619 % 2**32
            v[h % dim] += weight if h >= 2**31 else -weight

    for w, n in Counter(words).items():
        put(w, n / len(words) * math.log(1 + len(w.encode())))
    low = text.strip().lower()
    for k, mark, share in ((3, "tri:", 0.5), (2, "bi:", 0.3)):
        grams = [low[i : i + k] for i in range(len(low) - k + 1)]
        for g, n in Counter(grams).items():
            put(mark + g, n / max(1, len(grams)) * share)
    size = math.sqrt((v * v).sum())
    return v / size if size else v


@pytest.mark.parametrize("text", ["ReadFile opens a file", "héllo_Wörld x", "a", "   ", "HTTPServer.listen(port) -> err", "中文 text ab ab"])
def test_embedder_follows_its_rule(text):
    assert np.allclose(vector.embed(text), embed_by_rule(text), atol=1e-6)


def test_vector_blobs(spark):
    df = spark.createDataFrame([([1.0, -2.5],), ([],), (None,)], "v array<float>")
    got = df.select(vector.pack(F.col("v")).alias("b")).select(vector.unpack(F.col("b")).alias("v")).collect()
    assert [r["v"] for r in got] == [[1.0, -2.5], [], None]
    bad = spark.createDataFrame([(bytearray(b"abc"),)], "b binary")
    assert bad.select(vector.unpack(F.col("b")).alias("v")).first()["v"] is None
