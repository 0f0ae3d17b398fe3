"""Change, stream and line queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, graph, lines
from ..sources import tables as T
from ..streaming import events as E
from .graph_queries import CTE

REGISTERED: dict = {}


def register(name: str, sql: str | None = None):
    def put(f):
        REGISTERED[name] = (f, sql)
        return f

    return put


def snapshots(spark, d):
    """Two states of the documents: every seventh is new, every eleventh is gone, every fifth is changed."""
    docs = T.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("file_path"), F.col("lang").alias("symbol_name"), "doc_id", "text")
    old = docs.filter("doc_id % 7 <> 0").withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    new = docs.filter("doc_id % 11 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("!")), 256)).otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)))
    return old.drop("doc_id", "text"), new.drop("doc_id", "text")


@register(
    "checkpoint_delta",
    """SELECT CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'deleted' ELSE 'modified' END AS change, doc_id::VARCHAR AS id, source AS file_path, lang AS symbol_name FROM documents
WHERE (doc_id % 7 = 0 AND doc_id % 11 <> 0) OR (doc_id % 7 <> 0 AND doc_id % 11 = 0) OR (doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 = 0)""",
)
def checkpoint_delta(spark, d):
    return changes.delta(*snapshots(spark, d))


@register("delta_of_itself", "SELECT 'x' AS change, 'x' AS id WHERE false")
def delta_of_itself(spark, d):
    old, _ = snapshots(spark, d)
    return changes.delta(old, old).select("change", "id")


@register(
    "detect_changes_rank",
    f"""{CTE}, ch AS (SELECT id, CASE split_part(id, ':', 2)::BIGINT % 3 WHEN 0 THEN 'deleted' WHEN 1 THEN 'added' ELSE 'modified' END AS change FROM nodes WHERE id LIKE 'nation:%'),
d1 AS (SELECT DISTINCT ch.id AS root, p.src AS id FROM ch JOIN pairs p ON p.dst = ch.id), d2 AS (SELECT DISTINCT root, p.src AS id FROM d1 JOIN pairs p ON p.dst = d1.id), d3 AS (SELECT DISTINCT root, p.src AS id FROM d2 JOIN pairs p ON p.dst = d2.id),
n AS (SELECT root AS id, count(DISTINCT id) AS dependents FROM (SELECT * FROM d1 UNION SELECT * FROM d2 UNION SELECT * FROM d3) GROUP BY root),
b AS (SELECT dst AS id, count(*) / 1e6 AS betweenness FROM pairs GROUP BY dst)
SELECT ch.id, change, coalesce(dependents, 0) AS dependents, round(0.5 * coalesce(betweenness, 0) + 0.3 * coalesce(dependents, 0) / max(coalesce(dependents, 0)) OVER () + 0.2 * CASE change WHEN 'deleted' THEN 1.0 WHEN 'added' THEN 0.7 ELSE 0.5 END, 6) AS score
FROM ch LEFT JOIN n USING (id) LEFT JOIN b USING (id)""",
)
def detect_changes_rank(spark, d):
    key = F.split_part(T.name("id"), F.lit(":"), F.lit(2)).cast("long") % 3
    ch = T.nodes(spark, d, ("nation",), coded=True).select("id", F.when(key == 0, "deleted").when(key == 1, "added").otherwise("modified").alias("change"))
    p = T.links(spark, d)
    # only of what changed, some 25 rows
    into = p.join(F.broadcast(ch.select(F.col("id").alias("dst"))), "dst", "left_semi").distinct()
    b = into.groupBy(F.col("dst").alias("id")).agg((F.count("*") / 1e6).alias("betweenness"))
    return changes.rank_changes(ch, p, b).select(T.name("id").alias("id"), "change", "dependents", F.round("score", 6).alias("score"))


HISTORY = "SELECT concat('customers/', o_custkey) AS file_path, o_orderkey::VARCHAR AS commit_hash, o_orderdate AS commit_time, o_orderpriority AS subject FROM orders"


def history(spark, d):
    return T.table(spark, d, "orders").select(F.concat(F.lit("customers/"), F.col("o_custkey").cast("string")).alias("file_path"), F.col("o_orderkey").cast("string").alias("commit_hash"), F.col("o_orderdate").alias("commit_time"), F.col("o_orderpriority").alias("subject"))


#: Subjects that the blueprint's list tells apart: of six kinds, two say nothing.
SUBJECTS = ("WIP: parts", "Add order", "fix totals", "revert", "Nitpick names", "update deps")


@register(
    "file_intents",
    """WITH h AS (SELECT concat('customers/', o_custkey) AS file_path, o_orderkey::VARCHAR AS commit_hash, o_orderdate AS commit_time,
  ['WIP: parts', 'Add order', 'fix totals', 'revert', 'Nitpick names', 'update deps'][1 + o_orderkey % 6] || CASE WHEN o_orderkey % 6 IN (1, 2) THEN ' ' || (o_orderkey % 13)::VARCHAR ELSE '' END AS subject,
  CASE o_orderstatus WHEN 'F' THEN 'added' ELSE 'modified' END AS kind FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY commit_time DESC, commit_hash) AS rank FROM h QUALIFY rank <= 20),
t AS (SELECT * FROM r WHERE subject NOT IN ('WIP: parts', 'revert', 'update deps')),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY file_path, lower(trim(subject)) ORDER BY rank) = 1),
g AS (SELECT file_path, count(*) AS n_commits, arg_min(commit_hash, rank) AS last_commit,
  list(concat('- [', kind, '] ', subject, ' (', strftime(commit_time, '%Y-%m-%d'), ')', chr(10)) ORDER BY rank) AS ls FROM f GROUP BY file_path)
SELECT file_path, concat('File: ', file_path, chr(10), 'Recent changes (', n_commits, ' commits):', chr(10), array_to_string(ls[1:10], ''),
  CASE WHEN n_commits > 10 THEN concat('... and ', n_commits - 10, ' more commits', chr(10)) ELSE '' END) AS intent, n_commits, last_commit FROM g""",
)
def file_intents(spark, d):
    key = F.col("o_orderkey") % 6
    subject = F.concat(F.get(F.array(*[F.lit(x) for x in SUBJECTS]), key.cast("int")), F.when(key.isin(1, 2), F.concat(F.lit(" "), (F.col("o_orderkey") % 13).cast("string"))).otherwise(""))
    kind = F.when(F.col("o_orderstatus") == "F", "added").otherwise("modified")
    h = T.table(spark, d, "orders").select(F.concat(F.lit("customers/"), F.col("o_custkey").cast("string")).alias("file_path"), F.col("o_orderkey").cast("string").alias("commit_hash"), F.col("o_orderdate").alias("commit_time"), subject.alias("subject"), kind.alias("change_type"))
    return changes.file_intents(h, max_bytes=10_000)


@register("latest_per_file", f"WITH h AS ({HISTORY}) SELECT file_path, commit_hash FROM h QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY commit_time DESC, commit_hash) <= 3")
def latest_per_file(spark, d):
    return changes.latest_per_file(history(spark, d), 3).select("file_path", "commit_hash")


@register(
    "diff_trees",
    """WITH o AS (SELECT doc_id::VARCHAR AS path, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 = 0 THEN md5(concat(text, '!')) ELSE md5(concat(text, CASE WHEN doc_id % 7 = 0 THEN '?' ELSE '' END)) END AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.h IS NULL OR n.h IS NULL OR o.h <> n.h""",
)
def diff_trees(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    old = docs.filter("doc_id % 7 <> 0").select("path", F.md5("text").alias("hash"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "?").otherwise("")))
    new = docs.filter("doc_id % 11 <> 0").select("path", F.md5(changed).alias("hash"))
    return changes.diff_trees(old, new)


def file_events(spark, d):
    kind = F.col("event_type")
    action = F.when(kind == "error", "delete").when(kind.isin("signup", "purchase"), "create").otherwise("modify")
    return T.table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), action.alias("action"), "ts")


@register(
    "debounce_sessions",
    """WITH e AS (SELECT user_id::VARCHAR AS path, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type IN ('signup', 'purchase') THEN 'create' ELSE 'modify' END AS action, ts FROM events),
o AS (SELECT *, row_number() OVER w AS pos, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY path ORDER BY ts, action)),
s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY pos) AS session FROM o),
p AS (SELECT path, session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, arg_max(action, pos) AS last, max(CASE WHEN action = 'delete' THEN pos END) AS dp, max(CASE WHEN action = 'create' THEN pos END) AS cp FROM s GROUP BY path, session)
SELECT path, CASE WHEN last = 'delete' THEN 'delete' WHEN cp > coalesce(dp, 0) THEN 'create' ELSE 'modify' END AS action, first_ts, last_ts, n FROM p""",
)
def debounce_sessions(spark, d):
    return E.debounce(file_events(spark, d), "30 minutes")


@register("regex_line_scan", "WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT id, line::INT AS line, text FROM l WHERE regexp_matches(text, '[Ll]icen[cs]ed? under') ORDER BY id, line LIMIT 20")
def regex_line_scan(spark, d):
    return lines.regex_scan(T.table(spark, d, "documents"), "doc_id", "text", "[Ll]icen[cs]ed? under")


LINES = "SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents"


@register(
    "densest_window",
    f"""WITH l AS ({LINES}), s AS (SELECT id, line, length(text) % 7 AS score FROM l), w AS (SELECT id, line, sum(score) OVER k AS s, max(line) OVER k AS e, max(line) OVER (PARTITION BY id) AS last FROM s WINDOW k AS (PARTITION BY id ORDER BY line ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT id, line::INT AS start, e::INT AS "end", s::BIGINT AS score FROM w WHERE line = 1 OR line + 4 <= last QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, line) = 1""",
)
def densest_window(spark, d):
    ls = lines.lines_of(T.table(spark, d, "documents"), "doc_id", "text")
    return lines.densest_window(ls.select("id", "line", (F.length("text") % 7).alias("score")), 5)


@register(
    "gap_blocks",
    f"""WITH l AS ({LINES}), s AS (SELECT id, line FROM l WHERE contains(text, 'the ')), b AS (SELECT *, CASE WHEN line - lag(line) OVER w <= 5 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY id ORDER BY line)),
c AS (SELECT id, line, sum(new) OVER (PARTITION BY id ORDER BY line) AS block FROM b) SELECT id, block::BIGINT AS block, min(line)::INT AS start, max(line)::INT AS "end", count(*) AS n FROM c GROUP BY id, block""",
)
def gap_blocks(spark, d):
    ls = lines.lines_of(T.table(spark, d, "documents"), "doc_id", "text").filter(F.contains("text", F.lit("the ")))
    return lines.gap_blocks(ls.select("id", "line"))
