"""Full-text ranking: BM25 over weighted fields.

A query's terms are few, so term frequencies are counted inside each row's text;
nothing is exploded, and the only exchange is one row of corpus statistics, or with
``once`` the counts of the rows.
``postings`` gives the inverted form for many queries at once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
K1, B = 1.2, 0.75
#: Column weights of the node index.
NODE_WEIGHTS = {"symbol_name": 10.0, "file_path": 1.0, "content_sum": 1.0, "search_terms": 5.0}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def spaced(text: Column) -> Column:
    """The tokens in their order, two blanks between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]++", "  "))


def _times(text: Column, part: str) -> Column:
    """How often ``part`` stands in an ASCII text, without overlaps: bytes lost when each loses its first."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit(part[1:])))


def _size(words: Column) -> Column:
    return F.when(words == "", 0).otherwise(_times(words, "  ") + 1)


def _hits(words: Column, term: str, prefix: bool) -> Column:
    """Tokens that equal the term or start with it; each has blanks of its own at both ends."""
    if prefix and not term:
        return _size(words)
    if not re.fullmatch(TOKEN, term):
        return F.lit(0)
    return _times(F.concat(F.lit(" "), words, F.lit(" ")), f" {term}" if prefix else f" {term} ")


def counted(rows: DataFrame, id_col: str, fields: dict[str, float], terms: list[tuple[str, bool]]) -> DataFrame:
    """id, dl and, for each term, its weighted frequency; a prefix is one phrase."""
    # a text of its own in place of an array: functions in arrays are interpreted, element by element
    words = rows.select(F.col(id_col).alias("id"), *[spaced(F.col(c)).alias(f"t_{i}") for i, c in enumerate(fields)])
    dl = sum((_size(F.col(f"t_{i}")) for i in range(len(fields))), F.lit(0))

    def tf(term: str, prefix: bool) -> Column:
        out = F.lit(0.0)
        for i, w in enumerate(fields.values()):
            out = out + F.lit(w) * _hits(F.col(f"t_{i}"), term, prefix)
        return out

    return words.select("id", dl.alias("dl"), *[tf(t, p).alias(f"f{j}") for j, (t, p) in enumerate(terms)])


def bm25(rows: DataFrame, id_col: str, fields: dict[str, float], terms: list[tuple[str, bool]], k1: float = K1, b: float = B, once: bool = False) -> DataFrame:
    """id, score of the rows that hold any term.

    idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6; statistics are of all rows.
    ``once``, for long texts, shuffles the counts of all rows in place of reading the
    texts for the statistics and again for the scores.
    """
    if not terms:
        return rows.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    c = counted(rows, id_col, fields, terms)
    if once:
        # dealt by a column that only the scores need, so that both readers keep the same columns and take one exchange
        c = c.repartition("id")
    fs = [f"f{j}" for j in range(len(terms))]
    stats = c.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), *[F.count(F.when(F.col(f) > 0, 1)).alias(f"n_{f}") for f in fs])
    joined = c.join(F.broadcast(stats))
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    score = F.lit(0.0)
    for f in fs:
        n = F.col(f"n_{f}")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("N") - n + 0.5) / (n + 0.5)))
        score = score + F.when(F.col(f) > 0, idf * F.col(f) * (k1 + 1) / (F.col(f) + norm)).otherwise(0.0)
    # a row that holds a term scores above 0; a filter on frequencies would be pushed down, where each makes the words anew
    return joined.select("id", score.alias("score")).filter("score > 0")


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id").limit(k)


def postings(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, id, tf."""
    return rows.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def bm25_batch(rows: DataFrame, id_col: str, text_col: str, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: the k best rows of each query in (query_id, text); plain terms.

    Query terms are first cut down to distinct ones and semi-joined before any
    posting is summed, so only postings of asked terms are shuffled.
    """
    from pyspark.sql import Window

    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    asked = q.select("term").distinct()
    dl = rows.select(F.col(id_col).alias("id"), F.size(tokens(F.col(text_col))).alias("dl"))
    stats = dl.agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avgdl"))
    # tokens are a column of their own, so that a row's size is not taken again for each of its tokens
    split = rows.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts"))
    found = split.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).join(asked, "term", "left_semi")
    tf = found.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("n"))
    s = tf.join(df, "term").join(F.broadcast(stats))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n_rows") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    part = s.select("term", "id", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl")))).alias("x"))
    # sums in another order differ in the last digits; rounded, equal rows tie and go by id
    total = part.join(q, "term").groupBy("query_id", "id").agg(F.round(F.sum("x"), 9).alias("score"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return total.withColumn("rank", r).filter(F.col("rank") <= k)


def keyword_match(rows: DataFrame, terms_col: str, keywords: list[str]) -> DataFrame:
    """Rows that hold any keyword as a substring, scored by the share of keywords held."""
    low = F.lower(F.col(terms_col))
    held = sum((F.when(F.contains(low, F.lit(k.lower())), 1).otherwise(0) for k in keywords), F.lit(0))
    return rows.withColumn("score", held / F.lit(len(keywords))).filter("score > 0")
