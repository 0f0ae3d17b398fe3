"""SpotSigs: content words that follow a common-word anchor form signatures.

An anchor (a common word of four languages) and the next ``CHAIN`` = 2 content
words are one signature.  A text's fingerprint is its set of 60-bit signature
hashes, sorted.  A text without any such chain takes every three words in a row
instead, one of under three words every ``GRAM`` code points in a row, and one too
short for that its whole; so texts without common words are alike in part, too.
Equal texts have equal fingerprints; the reverse holds but for texts that differ
only outside all their chains.

Sets are partitioned by length: the bounds grow by 1 / ``THRESHOLD``, so sets that
reach the threshold lie in one partition or in neighbouring ones, and Jaccard is
computed only where the lengths do not rule it out.

Defined results: null texts count as empty; two empty texts have likeness 1;
equal doc_ids are ordered by text; null doc_ids come first, ordered by text; one
row in, one row out; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import let, text_of
from .scratch import Scratch

CHAIN = 2
GRAM = 6
THRESHOLD = 0.8
#: Text of one run of ids, in code points, and the most runs.
RUN_CHARS = 8_000_000
MAX_RUNS = 65_536
ANCHORS = sorted(
    set(
        "the of and to in is it that for was on are as with by at from this be an or a "
        "le la les de des du et un une en est que qui dans pour sur pas par avec au aux "
        "der die das und zu den von mit ist im ein eine nicht auf für sich dem es auch "
        "el los las y por con para se su del al no lo como más".split()
    )
)


def signatures(text: Column) -> Column:
    """Sorted distinct signature hashes of a text (array<bigint>), never empty.

    Content words keep their word index; the anchors of a content word are the
    words between it and the one before, so each word is visited once.
    """

    def hashed(s: Column) -> Column:
        return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long")

    def by_words(ws: Column) -> Column:
        tagged = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~x["w"].isin(ANCHORS))

        def chains(content: Column) -> Column:
            def of(t: Column, j: Column) -> Column:
                before = F.coalesce(F.get(content, j - 1)["i"], F.lit(-1))
                anchors = F.slice(ws, before + 2, t["i"] - before - 1)
                return F.transform(anchors, lambda a: hashed(F.concat_ws(" ", a, t["w"], F.get(content, j + 1)["w"])))

            return F.flatten(F.transform(F.slice(content, F.lit(1), F.greatest(F.size(content) - (CHAIN - 1), F.lit(0))), of))

        return let(tagged, chains)

    def in_a_row(parts: Column, n: int, mark: str) -> Column:
        return F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (n - 1), F.lit(0))), lambda _, i: hashed(F.concat(F.lit(mark), F.array_join(F.slice(parts, i + 1, F.lit(n)), "\x1f"))))

    def some(sigs: Column, otherwise: Column) -> Column:
        return F.when(F.size(sigs) > 0, sigs).otherwise(otherwise)

    def plain(ws: Column) -> Column:
        whole = F.array(hashed(F.concat(F.lit("whole "), text)))
        grams = let(let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda cs: in_a_row(cs, GRAM, "chars ")), lambda g: some(g, whole))
        return F.when(F.size(ws) > 2, in_a_row(ws, 3, "words ")).otherwise(grams)

    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return let(words, lambda ws: let(let(let(ws, by_words), lambda sigs: some(sigs, plain(ws))), lambda sigs: F.sort_array(F.array_distinct(sigs))))


def length_partition(n: Column, threshold: float = THRESHOLD) -> Column:
    """Index of the partition of sets of ``n`` signatures."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 without comparing where lengths rule ``at_least`` out."""
    na, nb = F.size(a), F.size(b)

    def jaccard(common: Column) -> Column:
        return common.cast("double") / (na + nb - common)

    full = let(F.size(F.array_intersect(a, b)), jaccard)
    if at_least <= 0:
        return full
    return F.when(F.least(na, nb) < at_least * F.greatest(na, nb), F.lit(0.0)).otherwise(full)


def is_similar(a: Column, b: Column, threshold: float = THRESHOLD) -> Column:
    """Whether two sets reach the threshold; only sets of one or of neighbouring length partitions are compared."""
    near = F.abs(length_partition(F.size(a), threshold) - length_partition(F.size(b), threshold)) <= 1
    return F.when(near, likeness(a, b, threshold) >= threshold - 1e-12).otherwise(False)


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All pairs of different fingerprints with Jaccard >= threshold, as (set_a, set_b, likeness), with the members of each set.

    Texts with one fingerprint share a set and are not compared.  A set meets only
    sets of its own and the next length partition.  Within those, the least frequent
    floor((1 - threshold) * n) + 1 signatures of each set are the join keys, of which
    any pair at the threshold shares one; frequent signatures come last, so they are
    no keys, and the joins by signature read written tables, which adaptive execution
    splits.  Returns (pairs, members).
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    sets = docs.select(F.col(id_col).alias("id"), signatures(text_of(text_col)).alias("sigs"))
    members = scratch.write(sets.select("id", F.md5(F.array_join("sigs", ",")).alias("set_id"), "sigs"))
    uniq = scratch.write(members.groupBy("set_id").agg(F.any_value("sigs").alias("sigs")))
    freq = scratch.write(uniq.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df")))
    placed = scratch.write(uniq.select("set_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig")).join(freq.hint("merge"), "sig"))
    keys = placed.groupBy("set_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("ranked"))
    keep = (F.floor((1 - threshold) * F.col("n") + 1e-9) + 1).cast("int")
    ranked = scratch.write(keys.select("set_id", "n", F.explode(F.slice("ranked", F.lit(1), keep)).alias("r")).select("set_id", "n", "r.sig", length_partition(F.col("n"), threshold).alias("part")))
    left = ranked.select(F.col("set_id").alias("set_a"), F.col("n").alias("na"), "sig", "part")
    right = ranked.select(F.col("set_id").alias("set_b"), F.col("n").alias("nb"), "sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    cand = (
        left.join(right.hint("merge"), ["sig", "part"])
        .filter((F.col("set_a") != F.col("set_b")) & (F.col("na") <= F.col("nb")) & (F.col("na") >= threshold * F.col("nb") - 1e-9))
        .select(F.least("set_a", "set_b").alias("set_a"), F.greatest("set_a", "set_b").alias("set_b"))
        .distinct()
    )
    a = uniq.select(F.col("set_id").alias("set_a"), F.col("sigs").alias("sa"))
    b = uniq.select(F.col("set_id").alias("set_b"), F.col("sigs").alias("sb"))
    pairs = cand.join(a, "set_a").join(b, "set_b").select("set_a", "set_b", likeness(F.col("sa"), F.col("sb"), threshold).alias("likeness")).filter(F.col("likeness") >= threshold - 1e-12)
    return pairs, members.select("id", "set_id")


def order_key(id_: Column, tie: Column) -> Column:
    """A number that never falls along the order of (id, nulls first; tie, an MD5): nulls are spread by their tie, far below other ids."""
    low = -(2**63)
    return F.when(id_.isNull(), F.conv(F.substring(tie, 1, 14), 16, 10).cast("long") + F.lit(low)).otherwise(F.greatest(id_.cast("long"), F.lit(low + 2**57)))


def key_bounds(keyed: DataFrame, least: int) -> list[int]:
    """Keys that cut the table into runs of near equal row counts; the first is the smallest key.

    As many as hold ``RUN_CHARS`` of text each, ``least`` at least and ``MAX_RUNS``
    at most: the list grows with the table to that bound, after which runs do, and
    their sorts spill.
    """
    row = keyed.agg(F.sum("_chars").alias("chars"), F.min("_key").alias("low")).first()
    if row["low"] is None:
        return []
    n = min(MAX_RUNS, max(least, -(-(row["chars"] or 0) // RUN_CHARS)))
    q = keyed.agg(F.percentile_approx("_key", F.array(*[F.lit(i / n) for i in range(n)]), F.lit(max(10_000, 10 * n)))).first()[0]
    return sorted({row["low"], *(q or [])})


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Index of the last bound <= key, found in two steps of about sqrt(n) comparisons."""

    def numbers(xs: list[int]) -> Column:
        # one literal, folded once, where a list would be as many expressions
        return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")

    step = max(1, int(len(bounds) ** 0.5))
    first = F.size(F.filter(numbers(bounds[::step]), lambda b: b <= key)) - 1
    return let(first, lambda c: c * step + F.size(F.filter(F.slice(numbers(bounds), c * step + 1, F.lit(step)), lambda b: b <= key)) - 1).cast("int")


def with_next(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, text, sigs of each row, with ``next``, the struct (text, sigs) of the row that follows by id (the last: of the first).

    Rows are dealt to runs of ids cut at ``key_bounds``; the first row of a run
    is also sent, as a sentinel, to the run before, so every run is settled alone
    and no text is held back for a global window.  Only texts are shuffled.
    """
    keyed = docs.withColumn("_tie", F.md5("text"))
    keyed = keyed.withColumn("_key", order_key(F.col("doc_id"), F.col("_tie"))).withColumn("_chars", F.length("text").cast("long"))
    bounds = key_bounds(keyed, least)
    if not bounds:
        return docs.withColumn("sigs", signatures(F.col("text"))).withColumn("next", F.struct("text", "sigs"))
    last = len(bounds) - 1
    dealt = keyed.withColumn("_bucket", bucket_of(F.col("_key"), bounds))
    # rows that may start a run have a bound as their key; of those, the first by id and tie is met first
    starts = F.col("_key").isin(bounds) if last < 64 else F.array_contains(F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), F.col("_key"))
    sent = dealt.select("doc_id", "text", "_tie", "_bucket", F.explode(F.when(starts, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("_sentinel"))
    before = F.when(F.col("_bucket") == 0, F.lit(last)).otherwise(F.col("_bucket") - 1)
    sent = sent.withColumn("_bucket", F.when(F.col("_sentinel"), before).otherwise(F.col("_bucket")))
    signed = sent.repartition(max(least, last + 1), "_bucket").withColumn("sigs", signatures(F.col("text")))
    w = Window.partitionBy("_bucket").orderBy(F.col("_sentinel"), F.col("doc_id").asc_nulls_first(), "_tie")
    return signed.withColumn("next", F.lead(F.struct("text", "sigs")).over(w)).filter(~F.col("_sentinel")).select("doc_id", "text", "sigs", "next")


def edited(text: Column, following: Column, n_chars: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of ``following``."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars.cast("int") - half), F.substring(following, F.lit(1), half))


def fingerprint_string(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: s.cast("string")), " ")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    both = with_next(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_chars = F.length("text").cast("long")
    both = both.select("doc_id", n_chars.alias("n_chars"), "sigs", F.col("next.sigs").alias("next_sigs"), edited(F.col("text"), F.col("next.text"), n_chars).alias("edited"))
    both = both.select("*", signatures(F.col("edited")).alias("edited_sigs"))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_string(F.col("sigs")).alias("fingerprint"),
        fingerprint_string(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        is_similar(F.col("sigs"), F.col("edited_sigs")).alias("similar_edited"),
        is_similar(F.col("sigs"), F.col("next_sigs")).alias("similar_next"),
    )


def sql() -> str:
    anchors = ", ".join("'" + a + "'" for a in ANCHORS)

    def sigs(src: str, out: str) -> str:
        return f"""
{out}_w AS (SELECT doc_id, t, list_filter(string_split_regex(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM {src}),
{out}_p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM {out}_w),
{out}_c AS (SELECT doc_id, w, i, coalesce(lag(i) OVER k, 0) AS prev, lead(w) OVER k AS nxt
   FROM {out}_p WHERE w NOT IN ({anchors}) WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
{out}_s AS (SELECT DISTINCT c.doc_id, ('0x' || substr(md5(a.w || ' ' || c.w || ' ' || c.nxt), 1, 15))::BIGINT AS s
   FROM {out}_c c JOIN {out}_p a ON a.doc_id = c.doc_id AND a.i > c.prev AND a.i < c.i WHERE c.nxt IS NOT NULL),
{out}_g AS (SELECT doc_id, list(s ORDER BY s) AS sg FROM {out}_s GROUP BY doc_id),
{out}_r AS (SELECT doc_id, t, CASE WHEN len(ws) > 2 THEN ws ELSE regexp_extract_all(t, '(?s).') END AS ps,
   CASE WHEN len(ws) > 2 THEN 3 ELSE {GRAM} END AS k, CASE WHEN len(ws) > 2 THEN 'words ' ELSE 'chars ' END AS mark FROM {out}_w),
{out}_q AS (SELECT doc_id, t, list_transform(range(1, greatest(len(ps) - k + 2, 1)), lambda i: ('0x' || substr(md5(mark || array_to_string(ps[i : i + k - 1], chr(31))), 1, 15))::BIGINT) AS qs
   FROM {out}_r WHERE doc_id NOT IN (SELECT doc_id FROM {out}_g)),
{out} AS (SELECT w.doc_id, w.t, coalesce(sg, CASE WHEN len(qs) > 0 THEN list_sort(list_distinct(qs)) END, [('0x' || substr(md5('whole ' || w.t), 1, 15))::BIGINT]) AS sg
   FROM {out}_w w LEFT JOIN {out}_g USING (doc_id) LEFT JOIN {out}_q USING (doc_id))"""

    jac = "len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt,
  coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS nid FROM d),
e AS (SELECT doc_id, substr(t, 1, length(t) - length(t) // 2) || substr(nt, 1, length(t) // 2) AS t FROM n),
{sigs('d', 'f')}, {sigs('e', 'h')}
SELECT n.doc_id, length(n.t)::BIGINT AS n_chars, sha256(h.t) AS edited_sha256,
  array_to_string(f.sg, ' ') AS fingerprint, array_to_string(h.sg, ' ') AS edited_fingerprint,
  {jac.format('f.sg', 'h.sg')} AS near_edited, {jac.format('f.sg', 'x.sg')} AS near_next,
  {jac.format('f.sg', 'h.sg')} >= {THRESHOLD} - 1e-12 AS similar_edited, {jac.format('f.sg', 'x.sg')} >= {THRESHOLD} - 1e-12 AS similar_next
FROM n JOIN f USING (doc_id) JOIN h USING (doc_id) JOIN f x ON x.doc_id = n.nid
"""
