import re

import pytest
from pyspark.sql import functions as F

from skein.operators import match, store, text_index


def test_parse():
    P, B = match.Phrase, match.Both
    assert match.parse("a b OR c") == B("OR", B("AND", P(("a",)), P(("b",))), P(("c",)))
    assert match.parse("a NOT (b OR c*)") == B("NOT", P(("a",)), B("OR", P(("b",)), P(("c",), True)))
    assert match.parse('"Api  Key"* AND x-y') == B("AND", P(("api", "key"), True), P(("x", "y")))
    assert [p.words for p in match.phrases(match.parse("a NOT b OR a c"))] == [("a",), ("c",)]
    for bad in ("", "a OR", "NOT a", "(a", "a)", "AND", "a OR OR b", "--"):
        with pytest.raises(match.MatchError):
            match.parse(bad)


def test_raw_matches_as_written(spark):
    texts = ["api key here", "key api", "the api keys", "licensed token", "Licensed!", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")

    def hits(e):
        return sorted(r["id"] for r in match.bm25_raw(df, "id", "text", e).collect())

    assert hits('"api key"') == [0] and hits('"api key"*') == [0, 2] and hits("api key") == [0, 1] and hits("licensed NOT token") == [4] and hits("licen* OR keys") == [2, 3, 4]


def test_index_is_found_again(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    rows = [(i, f"the word{i % 7} and more text {'rare' if i == 3 else ''}", f"head{i % 2}") for i in range(60)] + [(100, None, None), (101, "", "")]
    spark.createDataFrame(rows, "doc_id long, text string, title string").write.parquet(path)
    spark.conf.set("skein.index.dir", str(tmp_path / "index"))
    try:
        fields = {"title": 3.0, "text": 1.0}
        index = text_index.open_index(spark, path, "doc_id", fields)
        built = sorted(p.name for p in (tmp_path / "index").iterdir())
        assert text_index.open_index(spark, path, "doc_id", fields).stats.first() == index.stats.first() and sorted(p.name for p in (tmp_path / "index").iterdir()) == built
        from skein.operators import fts

        docs = spark.read.parquet(path)
        for terms in ([("rare", False), ("the", False)], [("wor", True), ("head1", False)], [("w", True)], [("zzz", False)]):
            want = {r["id"]: round(r["score"], 9) for r in fts.bm25(docs, "doc_id", fields, terms).collect()}
            assert {r["id"]: round(r["score"], 9) for r in text_index.search(index, terms).collect()} == want
        plan = text_index.search(index, [("rare", False)])._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
        spark.createDataFrame([(200, "rare new", "x")], "doc_id long, text string, title string").write.mode("append").parquet(path)
        assert text_index.search(text_index.open_index(spark, path, "doc_id", fields), [("rare", False)]).count() == 2
    finally:
        spark.conf.unset("skein.index.dir")


def test_a_posting_moves_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b A b", "b"), (2, None, ""), (3, "", "c c")], "doc_id long, text string, title string")
    post = text_index.postings(rows, "doc_id", {"text": 1.0, "title": 3.0})
    assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["dl"], r["term"], r["tf"]) for r in post.collect()) == [(1, 4, "a", 1.0), (1, 4, "b", 2.0), (1, 4, "b", 3.0), (3, 2, "c", 6.0)]
    # a bucket is dealt by its size, not to a fixed number of files
    kept = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    try:
        many = spark.range(0, 6000, 1, 12).select(F.col("id").alias("doc_id"), F.lit("the theme").alias("text"))
        text_index.build(many, "doc_id", {"text": 1.0}, str(tmp_path / "i"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", kept)
    assert len(list((tmp_path / "i" / "postings").glob("bucket=*/*.parquet"))) > 4
    assert spark.read.parquet(str(tmp_path / "i" / "postings")).count() == 12_000


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_batch_sums_where_rows_lie(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(text_index, "BROADCAST_TERMS", broadcast)
    from skein.operators import fts

    rows = spark.createDataFrame([(i, f"the w{i % 7} w{i % 3} more w{i % 5}") for i in range(60)] + [(100, None), (101, "")], "doc_id long, text string")
    text_index.build(rows, "doc_id", {"text": 1.0}, str(tmp_path / "i"))
    index = text_index.Index(spark.read.parquet(str(tmp_path / "i" / "postings")), store.read_table(spark, str(tmp_path / "i" / "stats")))
    queries = spark.createDataFrame([(1, "w1 W2"), (2, "the w6"), (3, "none"), (4, None)], "query_id long, text string")
    want = sorted(map(tuple, fts.bm25_batch(rows, "doc_id", "text", queries, 3).collect()))
    # a query that stands twice counts once
    out = text_index.search_batch(index, queries.union(queries), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.select("query_id", "id", "score", "rank").collect())) == want and len(want) == 6
    if broadcast:
        assert not re.search(r"hashpartitioning\(query_id#\d+L, id#", plan)


def test_batch_weighs_fields_together(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red blue", "red"), (2, "blue", ""), (3, "green", "sky")], "doc_id long, text string, title string")
    fields = {"text": 1.0, "title": 3.0}
    text_index.build(rows, "doc_id", fields, str(tmp_path / "i"))
    index = text_index.Index(spark.read.parquet(str(tmp_path / "i" / "postings")), store.read_table(spark, str(tmp_path / "i" / "stats")))
    one = text_index.search(index, [("red", False)]).first()
    batch = text_index.search_batch(index, spark.createDataFrame([(1, "red")], "query_id long, text string"), 1).first()
    assert batch["id"] == one["id"] == 1 and batch["score"] == round(one["score"], 9)


def test_index_and_scan_give_the_same_digits(spark, tmp_path):
    """Copies tie whatever order their postings arrive in, so lists cut at k hold the least ids."""
    from skein.operators import fts

    texts = [" ".join(["the"] * (i % 5 + 1) + ["license"] * (i % 3 + 1) + ["token"] * (i % 4 + 1) + ["x"] * (i % 11)) for i in range(240)] + ["x y"] * 400
    rows = spark.createDataFrame([(i, texts[i % 640]) for i in range(1280)], "doc_id long, text string").repartition(7)
    text_index.build(rows, "doc_id", {"text": 1.0}, str(tmp_path / "i"))
    index = text_index.Index(spark.read.parquet(str(tmp_path / "i" / "postings")), store.read_table(spark, str(tmp_path / "i" / "stats")))
    terms = [("license", False), ("token", False), ("the", False), ("x", True)]
    got, *scans = [dict(map(tuple, s.select("id", "score").collect())) for s in (text_index.search(index, terms), fts.bm25(rows, "doc_id", {"text": 1.0}, terms), fts.bm25(rows, "doc_id", {"text": 1.0}, terms, once=True))]
    assert scans == [got, got] and len(got) == 1280
    assert all(got[i] == got[i + 640] for i in range(640))


def test_terms_are_counted_in_the_text(spark):
    from skein.operators import fts

    texts = ["the the THE other the", "", None, "the", "(the)the-the,", "  lic licx xlic LIC9 \u00e4lic ", "\u00df\u4e2d", "a", "a a  a", "c++ c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    terms = [("the", False), ("lic", True), ("a", False), ("c++", False), ("", True), ("", False), ("The", False), ("the the", False)]
    out = fts.counted(df, "id", {"text": 2.0}, terms)
    for r in out.collect():
        ts = re.findall("[a-z0-9]+", (texts[r["id"]] or "").lower())
        assert r["dl"] == len(ts)
        assert [r[f"f{j}"] for j in range(len(terms))] == [2.0 * sum(t.startswith(x) if p else t == x for t in ts) for x, p in terms]
    # functions in arrays are interpreted, element by element
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_short_query_builds_no_index(spark, tmp_path):
    """It reads the texts once and shuffles their counts; an index that is there is used, with the same result."""
    from skein.plans import catalogue

    d = tmp_path / "t"
    rows = [(i, f"{'the ' * (i % 5)}license w{i % 7} {'token ' * (i % 3)}", ("en", "fr", "de")[i % 3], "s", 1) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    kept = spark.conf.get("skein.index.dir", None)
    spark.conf.set("skein.index.dir", str(tmp_path / "index"))
    names = ("minmax_norm", "bm25_topk", "bm25_prefix", "bm25_by_type", "bm25_by_types")
    try:
        scanned = {}
        for name in names:
            df = catalogue.QUERIES[name](spark, str(d))
            scanned[name] = list(map(tuple, df.collect()))
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "ReusedExchange" in plan and len(re.findall(r"FileScan parquet \[[^]]*\btext#", plan)) == 1
        assert not (tmp_path / "index").exists()
        text_index.open_index(spark, f"{d}/documents.parquet", "doc_id", {"text": 1.0})
        for name in names:
            df = catalogue.QUERIES[name](spark, str(d))
            assert list(map(tuple, df.collect())) == scanned[name]
            assert "text#" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("skein.index.dir", kept) if kept else spark.conf.unset("skein.index.dir")
