"""Secret scans with corpus-wide ownership frequency.

Base spans are three patterns.  Further candidates (key blocks, signed web
tokens, service tokens with known prefixes, keys of cloud services, passwords in
addresses, bearer headers, hook addresses) become spans only if the corpus says that they look
live.  Every candidate's hash is counted over distinct owners (``source``) and
repositories (source and language): a value of ``EXAMPLE_OWNERS`` owners is a
copied example, a value of one owner is that owner's in however many repositories,
and one of a few owners is an example once ``EXAMPLE_REPOS`` repositories hold it.

Defined results: null texts count as empty; null owners count as one owner;
repeated rows get repeated results and count once in the frequencies; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import keep_columns, let, match_spans, spans_string, text_of
from .scratch import Scratch

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: kind, pattern; each is at least as long as it says, so none is dropped afterwards.
EXTRA = (
    ("key_block", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:\s{1,4}[A-Za-z0-9+/=]{16,}+)++"),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    ("service_token", r"(?:gh[pousr]_|github_pat_|sk_live_|rk_live_|xox[abprs]-|glpat-|npm_|pypi-|hf_|dop_v1_|shpat_)[A-Za-z0-9_-]{20,}+"),
    ("cloud_key", r"AIza[A-Za-z0-9_-]{35}|SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64}"),
    ("url_password", r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._%-]{1,64}+:[^\s:/@]{6,64}+@"),
    ("bearer", r"(?i:authorization)[\"']?\x20*[:=]\x20*[\"']?(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}+"),
    ("hook", r"https://hooks\.slack\.com/services/[A-Za-z0-9]{8,}+/[A-Za-z0-9]{8,}+/[A-Za-z0-9]{20,}+"),
)
#: So many distinct owners, or more, make a value a copied example; so do so many repositories of two owners or more.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 4


def base_and_extra(text: Column) -> Column:
    """struct(base, extra): arrays of spans, sorted by start, then kind as listed."""
    parts = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        scanned = r"[0-9a-f]{16,}+" if kind == "hex" else pattern
        parts.append(match_spans(text, scanned, kind, order, lambda v, least=least: F.length(v) >= least, group))
    more = [match_spans(text, pattern, kind, 10 + order, lambda v: F.lit(True)) for order, (kind, pattern) in enumerate(EXTRA)]
    return F.struct(F.sort_array(F.concat(*parts)).alias("base"), F.sort_array(F.concat(*more)).alias("extra"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row a document: doc_id, key, owner, repo, base and extra spans without their values, hashes of the values."""
    text = text_of(text_col)
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00none"))
    repo = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00none")) for c in repo_cols])

    def stripped(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))

    found = docs.select(F.col(id_col).alias("doc_id"), owner.alias("owner"), repo.alias("repo"), F.md5(text).alias("text_md5"), let(text, base_and_extra).alias("f"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.lit(":"), F.col("text_md5"))
    return found.select("doc_id", key.alias("key"), "owner", "repo", stripped(F.col("f.base")).alias("base"), stripped(F.col("f.extra")).alias("extra"))


def ownership(spans: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos, n_rows, verdict over (hash, owner, repo) rows.

    Rows are first summed by all three columns, map-side, so a value that fills a
    third of the corpus is a few rows by the time it is shuffled by hash alone.
    """
    per_repo = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    per = per_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_rows"))
    copied = (F.col("n_owners") >= EXAMPLE_OWNERS) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= EXAMPLE_REPOS))
    return per.withColumn("verdict", F.when(copied, "example").otherwise("live"))


def scan(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, base spans, all spans (base, and live-looking extra ones), n_live, n_example."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    found = scratch.write(candidates(docs, **columns))
    some = (F.size("base") + F.size("extra")) > 0
    each = found.filter(some).select("key", "owner", "repo", F.explode(F.concat("base", "extra")).alias("s"))
    each = scratch.write(each.select("key", "owner", "repo", F.col("s.hash").alias("hash")).distinct())
    verdicts = scratch.write(ownership(each).select("hash", "verdict"))
    # all holders of a common value meet one verdict: written tables and a sort-merge, which adaptive execution splits
    marked = (
        each.select("key", "hash").join(verdicts.hint("merge"), "hash")
        .groupBy("key")
        .agg(F.collect_set(F.when(F.col("verdict") == "live", F.col("hash"))).alias("live"), F.count_distinct(F.when(F.col("verdict") == "example", F.col("hash"))).alias("n_example"))
    )
    marked = marked.withColumnRenamed("key", "_k")
    hit = found.filter(some).join(marked, F.col("key") == F.col("_k"), "left").drop("_k")
    # without candidates there is nothing to look up, so those rows are not shuffled
    none = found.filter(~some).withColumns({"live": F.array().cast("array<string>"), "n_example": F.lit(0).cast("long")})
    both = hit.unionByName(none)
    all_spans = F.sort_array(F.concat("base", F.filter("extra", lambda s: F.array_contains(F.col("live"), s["hash"]))))
    return both.select("doc_id", "base", all_spans.alias("spans"), F.size("live").cast("long").alias("n_live"), "n_example")


def query(spark, sf_dir: str) -> DataFrame:
    docs = keep_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source", "lang")
    out = scan(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in BASE]
    return out.select("doc_id", *counts, F.sha2(spans_string(F.col("base")), 256).alias("base_sha256"), spans_string(F.col("spans")).alias("spans"), "n_live", "n_example")


def sql() -> str:
    """Spans from the pieces between matches, as the operator places them; RE2 needs no possessive quantifiers."""
    kinds = [(kind, order, r"[0-9a-f]{16,}" if kind == "hex" else pattern, group, least) for order, (kind, pattern, group, least) in enumerate(BASE)]
    kinds += [(kind, 10 + order, pattern, 0, 1) for order, (kind, pattern) in enumerate(EXTRA)]
    parts = []
    for kind, order, pattern, group, least in kinds:
        p = pattern.replace("}+", "}").replace(")++", ")+").replace("'", "''")
        parts.append(f"""
SELECT key, owner, repo, {order} AS ord, '{kind}' AS kind, s AS start, s + length(m) AS "end", sha256(v) AS hash FROM (
  SELECT key, owner, repo, ms[i] AS m, vs[i] AS v, (list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT key, owner, repo, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, string_split_regex(t, '{p}') AS gs FROM d))
) WHERE length(v) >= {least}""")
    count = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in BASE)
    text = "string_agg(concat(kind, ':', start, ':', \"end\"), ',' ORDER BY start, ord)"
    copied = f"n_owners >= {EXAMPLE_OWNERS} OR (n_owners > 1 AND n_repos >= {EXAMPLE_REPOS})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS t, coalesce(source, '~') AS owner, concat(coalesce(source, '~'), '|', coalesce(lang, '~')) AS repo FROM documents),
s AS ({" UNION ALL ".join(parts)}),
f AS (SELECT hash, count(DISTINCT owner) AS n_owners, count(DISTINCT repo) AS n_repos FROM s GROUP BY hash),
j AS (SELECT s.*, {copied} AS copied FROM s JOIN f USING (hash)),
b AS (SELECT key, {count}, sha256(coalesce({text}, '')) AS base_sha256 FROM s WHERE ord < 10 GROUP BY key),
a AS (SELECT key, {text} AS spans FROM j WHERE ord < 10 OR NOT copied GROUP BY key),
h AS (SELECT key, count(DISTINCT hash) FILTER (NOT copied) AS n_live, count(DISTINCT hash) FILTER (copied) AS n_example FROM j GROUP BY key)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN b USING (key) LEFT JOIN a USING (key) LEFT JOIN h USING (key)
"""
