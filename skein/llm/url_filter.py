"""URL filters: host and path rules, and trust propagated over the link graph.

A rule's verdict holds where its host (or a parent domain) and path prefix fit.
Other urls get their host's verdict: personalised PageRank from hosts whose urls
rules allow, along links, and from hosts whose urls rules block, against links; a
host is blocked where its distrust share is above ``THRESHOLD`` of its total.

The walks go on until no new host is reached and no host's rank moves by more than
``TOLERANCE`` of itself in ``ROUND`` steps.  Mass of hosts without links goes back
to the seeds; that only scales all ranks of a walk, so each walk is scaled to a
sum of one at the end.

Defined results: a null url, or one without ``://``, has empty host and path and
no rule; the empty host has no rank and is allowed, as is a host that neither walk
reaches; null html has no links; repeated rows get repeated results and count in
the seeds and links; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import keep_columns, let
from .scratch import Scratch

#: verdict, host and path prefix; the rule string is host + path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DAMPING = 0.85
#: Steps between two written tables, the relative move at which the walks end, and the most steps, at which 0.85 ** k is 1e-13.
ROUND = 4
TOLERANCE = 1e-3
MOST_STEPS = 184
THRESHOLD = 0.5
SQL_STEPS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> Column:
    """struct(host, path) of a url."""

    def parts(u: Column) -> Column:
        at = F.locate("://", u)
        rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))

        def cut(r: Column) -> Column:
            host = F.regexp_extract(r, r"^[^/?#]*", 0)
            tail = F.substring(r, F.length(host) + 1, F.length(r))
            return F.struct(F.translate(host, UPPER, LOWER).alias("host"), F.regexp_extract(tail, r"^[^?#]*", 0).alias("path"))

        return let(rest, cut)

    return let(F.coalesce(url, F.lit("")), parts)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def link_hosts(html: Column) -> Column:
    """Hosts of absolute and protocol-relative links; a relative link stays on its host and is no edge."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)href\s{0,8}=\s{0,8}["']?(?:https?:)?//([^/?#"'\s>:@]+)"""), F.lit(1))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda h: F.translate(h, UPPER, LOWER))


def judged_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, rule_verdict, links."""
    p = keep_columns(pages, "page_id", "url", "html").withColumn("u", host_and_path(F.col("url").cast("string")))
    r = rule_of(F.col("u.host"), F.col("u.path"), rules)
    return p.select("page_id", F.col("u.host").alias("host"), F.col("u.path").alias("path"), r.alias("r"), link_hosts(F.col("html").cast("string")).alias("links")).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict"), "links"
    )


def host_scores(judged: DataFrame, scratch: Scratch, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust of both walks.

    Edges are summed by host pair before anything else, so a host with a third of
    all pages is one row.  The two walks run as one table keyed by (walk, host).
    """
    seeds = judged.filter("rule_verdict IS NOT NULL AND host <> ''").groupBy("rule_verdict", "host").agg(F.count("*").alias("n"))
    seeds = scratch.write(seeds.select(F.when(F.col("rule_verdict") == "allow", "trust").otherwise("distrust").alias("walk"), "host", F.col("n").cast("double").alias("n")))
    totals = {r["walk"]: r["n"] for r in seeds.groupBy("walk").agg(F.sum("n").alias("n")).collect()}
    total = F.when(F.col("walk") == "trust", F.lit(totals.get("trust", 1.0))).otherwise(F.lit(totals.get("distrust", 1.0)))
    seeds = seeds.select("walk", "host", (F.col("n") / total).alias("seed"))

    links = judged.filter((F.size("links") > 0) & (F.col("host") != "")).select(F.col("host").alias("src"), F.explode("links").alias("dst"))
    pairs = links.filter("src <> dst AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("w"))
    both = pairs.select(F.explode(F.array(F.struct(F.lit("trust").alias("walk"), F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.lit("distrust").alias("walk"), F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e"), "w").select("e.*", "w")
    out_w = both.groupBy("walk", "a").agg(F.sum("w").alias("total"))
    out_w = scratch.write(out_w)
    edges = scratch.write(scratch.write(both).join(out_w.hint("merge"), ["walk", "a"]).select("walk", "a", "b", (F.col("w") / F.col("total")).alias("share")))

    ranks = scratch.write(seeds.select("walk", "host", F.col("seed").alias("rank")))
    steps = MOST_STEPS if edges.isEmpty() else 0
    while steps < MOST_STEPS:
        new = ranks
        for _ in range(ROUND):
            # of a host's links, all meet its one rank; a host with very many is split
            sent = edges.join(new.withColumnRenamed("host", "a").hint("merge"), ["walk", "a"]).select("walk", F.col("b").alias("host"), (F.lit(damping) * F.col("rank") * F.col("share")).alias("x"))
            back = seeds.select("walk", "host", (F.lit(1 - damping) * F.col("seed")).alias("x"))
            new = sent.unionByName(back).groupBy("walk", "host").agg(F.sum("x").alias("rank"))
        new = scratch.write(new)
        old = ranks.withColumnRenamed("rank", "old")
        moved = new.join(old, ["walk", "host"], "left").filter(F.col("old").isNull() | (F.abs(F.col("rank") - F.col("old")) > tolerance * F.col("rank")))
        settled = moved.isEmpty()
        scratch.drop(ranks)
        ranks = new
        steps += ROUND
        if settled:
            break
    mass = {r["walk"]: r["m"] for r in ranks.groupBy("walk").agg(F.sum("rank").alias("m")).collect()}

    def scaled(walk: str) -> Column:
        return (F.sum(F.when(F.col("walk") == walk, F.col("rank")).otherwise(0.0)) / F.lit(mass.get(walk) or 1.0)).alias(walk)

    return scratch.write(ranks.groupBy("host").agg(scaled("trust"), scaled("distrust")))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    judged = scratch.write(judged_pages(pages, rules))
    scores = host_scores(judged, scratch)
    # only urls without a rule ask for their host's score
    ruled = judged.filter("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"), F.lit(None).cast("double").alias("trust"), F.lit(None).cast("double").alias("distrust"))
    blocked = F.coalesce(F.col("distrust"), F.lit(0.0)) > threshold * (F.coalesce(F.col("trust"), F.lit(0.0)) + F.coalesce(F.col("distrust"), F.lit(0.0)))
    rest = judged.filter("rule IS NULL AND host <> ''").join(scores.hint("merge"), "host", "left").select("page_id", "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"), "trust", "distrust")
    nameless = judged.filter("rule IS NULL AND host = ''").select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"), F.lit(None).cast("double").alias("trust"), F.lit(None).cast("double").alias("distrust"))
    return ruled.unionByName(rest).unionByName(nameless)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def sql() -> str:
    """The walks are unrolled to ``SQL_STEPS``, which is all of them where no link path from a seed is longer."""
    whens = "\n".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)
    steps = []
    for k in range(1, SQL_STEPS + 1):
        steps.append(
            f"r{k} AS (SELECT walk, host, sum(x) AS rank FROM (SELECT e.walk, b AS host, {DAMPING} * rank * share AS x FROM edges e JOIN r{k - 1} r ON r.walk = e.walk AND r.host = e.a "
            f"UNION ALL SELECT walk, host, {1 - DAMPING} * rank FROM r0) GROUP BY ALL)"
        )
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, html, regexp_extract(r, '^[^/?#]*') AS h0, r FROM u),
p AS (SELECT page_id, html, translate(h0, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(r, length(h0) + 1), '^[^?#]*') AS path FROM h),
j AS (SELECT *, CASE {whens} END AS rule FROM p),
v AS (SELECT *, CASE rule {verdicts} END AS rv FROM j),
n AS (SELECT CASE rv WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS walk, host, count(*) AS n FROM v WHERE rv IS NOT NULL AND host <> '' GROUP BY ALL),
r0 AS (SELECT walk, host, n / sum(n) OVER (PARTITION BY walk) AS rank FROM n),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\s{{0,8}}=\s{{0,8}}["'']?(?:https?:)?//([^/?#"''\s>:@]+)', 1)) AS dst FROM v WHERE host <> ''),
w AS (SELECT src, translate(dst, '{UPPER}', '{LOWER}') AS dst, count(*) AS w FROM l GROUP BY ALL HAVING src <> dst AND dst <> ''),
bw AS (SELECT 'trust' AS walk, src AS a, dst AS b, w FROM w UNION ALL SELECT 'distrust', dst, src, w FROM w),
edges AS (SELECT walk, a, b, w / sum(w) OVER (PARTITION BY walk, a) AS share FROM bw),
{", ".join(steps)},
s AS (SELECT host, sum(CASE WHEN walk = 'trust' THEN rank ELSE 0 END) AS t, sum(CASE WHEN walk = 'distrust' THEN rank ELSE 0 END) AS d FROM (SELECT walk, host, rank / sum(rank) OVER (PARTITION BY walk) AS rank FROM r{SQL_STEPS}) GROUP BY host)
SELECT page_id, v.host, path, rule, coalesce(rv, CASE WHEN coalesce(d, 0) > {THRESHOLD} * (coalesce(t, 0) + coalesce(d, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN s ON s.host = v.host
"""
