"""Quality rules: one projection of length, symbol, stop-word and line ratios.

The threshold table ``RULES`` compiles into whole-number comparisons: mean word
length, symbols, stop words (of four languages, in either case, marks around them
aside) and words with letters to words; repeated, bullet and ellipsis lines to lines.

Defined results: a null text counts as empty; an empty text has no words and
fails; repeated rows give repeated results; extra columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import NOT_WS, let, text_of, words_of

STOP_WORDS = {
    "en": "the of and to in is it that for was on are as with by at from this be an or",
    "fr": "le la les de des du et un une en est que qui dans pour sur pas par avec au aux",
    "de": "der die das und in zu den von mit ist im ein eine nicht auf für sich dem es auch an als",
    "es": "el la los las de y que en un una por con para se su del es al no lo como más",
}


#: Marks at the ends of words that do not belong to them.
MARKS = ".,;:!?()[]{}'\"*_-"


def stop_words() -> list[str]:
    """The words of all languages, lower-case."""
    return sorted({w for ws in STOP_WORDS.values() for w in ws.split()})


@dataclass(frozen=True)
class Rule:
    """Rejects where ``metric`` is outside [low, high] per thousand of ``per``."""

    name: str
    metric: str
    per: str
    low: int | None = None
    high: int | None = None


#: Per mille, so that both engines compare whole numbers.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 15_000),
    Rule("symbols", "n_symbols", "n_words", None, 300),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("letters", "n_letter_words", "n_words", 600, None),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 300),
    Rule("bullets", "n_bullet_lines", "n_lines", None, 900),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", None, 300),
)


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that the text has twice or more.

    Windows are hashed, sorted beside their place, and equal neighbours marked;
    the marked places, sorted, cover min(3, distance to the next) words each.
    """
    long0 = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))).cast("long")), long0, lambda s, v: s + v)

    def marked(sorted_: Column) -> Column:
        hits = F.filter(sorted_, lambda x, j: F.coalesce(x["h"] == F.get(sorted_, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(sorted_, j + 1)["h"], F.lit(False)))
        return let(F.sort_array(F.transform(hits, lambda x: x["i"])), covered)

    def windows(ws: Column) -> Column:
        return F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))

    def counted(hs: Column) -> Column:
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), long0).otherwise(let(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), marked))

    return let(windows(words), counted)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` behind ``m``, a struct of whole-number metrics."""
    text = text_of(text_col)

    def metrics(t: Column) -> Column:
        def by_words(ws: Column) -> Column:
            def by_lines(lines: Column) -> Column:
                return F.struct(
                    F.size(ws).cast("long").alias("n_words"),
                    F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                    F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                    F.size(lines).cast("long").alias("n_lines"),
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                    repeated_words(ws).alias("n_repeat_words"),
                    F.size(F.filter(ws, lambda w: F.lower(F.btrim(w, F.lit(MARKS))).isin(stop_words()))).cast("long").alias("n_stop_words"),
                    F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
                    F.size(F.filter(lines, lambda ln: ln.rlike(r"^\s*[-*\x{2022}]\s"))).cast("long").alias("n_bullet_lines"),
                    F.size(F.filter(lines, lambda ln: ln.rlike(r"(?:\.\.\.|\x{2026})\s*$"))).cast("long").alias("n_ellipsis_lines"),
                )

            return let(F.filter(F.split(t, "\n"), lambda ln: ln.rlike(NOT_WS)), by_lines)

        return let(words_of(t), by_words)

    return docs.select("*", let(text, metrics).alias("m"))


def compile_rules(rules: tuple[Rule, ...] = RULES, at: str = "m.") -> Column:
    """Names of the failed rules, comma-joined; '' where none fails."""
    tests = []
    for r in rules:
        x, per = F.col(at + r.metric) * 1000, F.col(at + r.per)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (x < r.low * per)
        if r.high is not None:
            bad = bad | (x > r.high * per)
        tests.append(F.when(bad, F.lit(r.name)))
    return F.concat_ws(",", *tests)


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``m``, ``base_failed``, ``failed_rules`` and ``kept``."""
    base_failed = (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    return (
        measure(docs, text_col)
        .withColumn("base_failed", base_failed)
        .withColumn("failed_rules", compile_rules(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_rules(docs)
    return out.select("doc_id", *[F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "failed_rules", "kept")


def sql() -> str:
    stops = ", ".join("'" + w + "'" for w in stop_words())
    marks = MARKS.replace("'", "''")
    tests = []
    for r in RULES:
        bad = [f"{r.metric} * 1000 < {r.low} * {r.per}"] if r.low is not None else []
        bad += [f"{r.metric} * 1000 > {r.high} * {r.per}"] if r.high is not None else []
        tests.append(f"CASE WHEN {' OR '.join(bad)} THEN '{r.name}' END")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t,
        list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
      FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: lower(trim(x, '{marks}')) IN ({stops})))::BIGINT AS n_stop_words,
        len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words,
        len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*\x{{2022}}]\s')))::BIGINT AS n_bullet_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.\.\.|\x{{2026}})\s*$')))::BIGINT AS n_ellipsis_lines
      FROM w LEFT JOIN r USING (doc_id)),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
        concat_ws(',', {", ".join(tests)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules,
  (NOT base_failed AND failed_rules = '') AS kept FROM v
"""
