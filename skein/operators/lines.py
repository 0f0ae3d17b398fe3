"""Line operators: regex scans, densest windows, blocks, symbol reading."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = ("if ", "for ", "while ", "switch ", "return ", "try ", "catch ", "foreach ")
MARKERS = {
    "validation": ("validate", "valid(", "assert", "check("),
    "db_write": ("insert", "update(", "save(", "delete(", "create("),
    "job": ("dispatch(", "queue", "enqueue"),
    "event": ("event(", "emit(", "publish("),
    "notification": ("notify", "mail(", "sms"),
    "integration": ("http", "request(", "client."),
}


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line (from 1), text."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("p", "text")).select("id", (F.col("p") + 1).alias("line"), "text")


def regex_scan(docs: DataFrame, id_col: str, text_col: str, pattern: str, limit: int = 20, glob: str | None = None, path_col: str | None = None) -> DataFrame:
    """The first ``limit`` lines, by id and line, that a portable regex finds.

    Texts without a match are dropped before they are split.
    """
    if glob is not None:
        docs = docs.filter(F.col(path_col or id_col).rlike(glob_regex(glob)))
    hit = docs.filter(F.col(text_col).rlike(f"(?m){pattern}"))
    return lines_of(hit, id_col, text_col).filter(F.col("text").rlike(pattern)).orderBy("id", "line").limit(min(limit, 200))


def glob_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        out += ".*" if glob.startswith("**", i) else "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 2 if glob.startswith("**", i) else 1
    return f"^(?:.*/)?{out}$" if "/" not in glob else f"^{out}$"


def line_score(text: Column) -> Column:
    """3 a control word, 4 a marker, 1 each for ::, -> and a call."""
    low = F.lower(text)
    score = F.lit(0)
    for w in CONTROL:
        score = score + F.when(F.contains(low, F.lit(w)), 3).otherwise(0)
    for ws in MARKERS.values():
        for w in ws:
            score = score + F.when(F.contains(low, F.lit(w)), 4).otherwise(0)
    for w in ("::", "->", "("):
        score = score + F.when(F.contains(text, F.lit(w)), 1).otherwise(0)
    return score


def densest_window(scored: DataFrame, size: int = 40) -> DataFrame:
    """id, start, end, score: of (id, line, score), the window of ``size`` lines with the highest sum, the first of equals."""
    w = Window.partitionBy("id").orderBy("line").rowsBetween(0, size - 1)
    win = scored.select("id", "line", F.sum("score").over(w).alias("s"), F.max("line").over(w).alias("end"))
    # only full windows, or the first where the text is shorter
    last = F.max("line").over(Window.partitionBy("id"))
    full = win.withColumn("last", last).filter((F.col("line") == 1) | (F.col("line") + size - 1 <= F.col("last")))
    best = full.groupBy("id").agg(F.max_by(F.struct(F.col("line").alias("start"), "end", F.col("s").alias("score")), F.struct("s", (-F.col("line")).alias("n"))).alias("b"))
    return best.select("id", "b.start", "b.end", "b.score")


def gap_blocks(signals: DataFrame, gap: int = 5) -> DataFrame:
    """id, block, start, end, n: signal lines within ``gap`` lines of the one before form one block."""
    w = Window.partitionBy("id").orderBy("line")
    new = F.when(F.col("line") - F.lag("line").over(w) <= gap, 0).otherwise(1)
    return signals.withColumn("block", F.sum(new).over(w)).groupBy("id", "block").agg(F.min("line").alias("start"), F.max("line").alias("end"), F.count("*").alias("n"))


def signature(text: Column) -> Column:
    """The first line that is neither blank nor a comment, at most 240 characters."""
    told = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^(//|#|/\*|\*|--)"))
    return F.left(F.coalesce(F.get(told, F.lit(0)), F.lit("")), F.lit(240))


def interesting(line: Column) -> Column:
    return line.rlike(r"\b(func|function|class|return|if|for|foreach|while|switch|try|catch|throw)\b|->|::|\w\(")


def outline(text: Column, most: int = 8, least: int = 5) -> Column:
    """Up to ``most`` telling lines, filled to ``least`` with others, each once, in order."""
    lines = F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    telling = F.slice(F.filter(lines, interesting), 1, most)
    return F.when(F.size(telling) >= least, telling).otherwise(F.slice(F.array_distinct(F.concat(telling, lines)), 1, least))


#: Words before a bracket that call nothing.
KEYWORDS = "if for foreach while switch return catch function func elseif match array isset empty".split()
#: A name is met once, at the start of its word, and never given back: linear in the longest words and gaps.
WORD_START, NAME, CALL = r"(?<!\w)\d*+", r"[A-Za-z_]\w*+", r"[\t\n\f\r ]*+\("


def helper_calls(line: Column) -> Column:
    """Names called in a line, keywords left out, each once."""
    names = F.regexp_extract_all(line, F.lit(f"{WORD_START}({NAME}){CALL}"), F.lit(1))
    return F.array_except(F.array_distinct(names), F.array(*[F.lit(k) for k in KEYWORDS]))


def calls_helper(text: Column) -> Column:
    """Whether ``helper_calls`` finds any name; stops at the first."""
    return text.rlike(rf"{WORD_START}(?!(?:{'|'.join(KEYWORDS)})(?!\w)){NAME}{CALL}")


def marked(low: Column, kind: str) -> Column:
    """Whether lower-case text looks like a kind of side effect."""
    return reduce(or_, [F.contains(low, F.lit(w)) for w in MARKERS[kind]])


def side_effects(line: Column) -> Column:
    """The kinds of side effect that a line looks like."""
    return F.array_compact(F.array(*[F.when(marked(F.lower(line), kind), F.lit(kind)) for kind in MARKERS]))


def read_window(text: Column, start: int, end: int, max_lines: int = 60, max_chars: int = 6000, keep_bottom: bool = False) -> Column:
    """Lines start..end within both limits (60 and 6000; at most 200 and 20000), kept from the top or the bottom."""
    max_lines, max_chars = min(max_lines or 60, 200), min(max_chars or 6000, 20_000)
    part = F.slice(F.split(text, "\n"), start, max(0, end - start + 1))
    part = F.reverse(part) if keep_bottom else part
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, line: Column) -> Column:
        fits = ~acc["full"] & (acc["n"] + F.length(line) + 1 <= max_chars)
        return F.struct(F.when(fits, F.concat(acc["out"], F.array(line))).otherwise(acc["out"]).alias("out"), F.when(fits, acc["n"] + F.length(line) + 1).otherwise(acc["n"]).alias("n"), (~fits).alias("full"))

    kept = F.aggregate(F.slice(part, 1, max_lines), zero, step)["out"]
    return F.array_join(F.reverse(kept) if keep_bottom else kept, "\n")


def line_of_offset(content: Column, offset: Column) -> Column:
    """1-based line of a byte offset in a binary."""
    before = F.substring(content, F.lit(1), offset.cast("int")).cast("string")
    return F.size(F.split(before, "\n"))
