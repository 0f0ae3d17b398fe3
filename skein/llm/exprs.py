"""Column expressions shared by the operators (JVM side only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of every word count: blank and U+0009..U+000D.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row.

    Catalyst may inline a projected column into a lambda and evaluate it for
    every element; a lambda variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between white space, without the empty ends of a split."""
    return F.array_remove(F.split(text, WS + "+"), "")


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def running_sums(values: Column, block: int = 64) -> Column:
    """Sum of the elements before each one, in blocks so that a row of n elements costs n * block."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)

    def build(arr: Column) -> Column:
        n_blocks = F.ceil(F.size(arr) / F.lit(block)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(arr, b * block + 1, F.lit(block)))

        def offsets(bs: Column) -> Column:
            return let(
                F.transform(bs, total),
                lambda sums: F.flatten(F.transform(bs, lambda one, b: let(total(F.slice(sums, F.lit(1), b)), lambda base: F.transform(one, lambda _, i: base + total(F.slice(one, F.lit(1), i)))))),
            )

        return F.when(F.size(arr) == 0, F.array().cast("array<bigint>")).otherwise(let(blocks, offsets))

    return let(F.transform(values, lambda v: v.cast("long")), build)


def match_spans(text: Column, pattern: str, kind: str, order: int, keep: Callable[[Column], Column], group: int = 0, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Spans of all leftmost non-overlapping matches as (start, ord, kind, end, value), in code points.

    A match's start is the length of all before it: pieces between matches come
    from ``split`` and matches from ``regexp_extract_all``, with the same pattern.
    ``keep`` sees the value of ``group``; matches that fail it are dropped.
    """
    empty = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint,value:string>>")

    def place(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

        def spans(steps: Column) -> Column:
            return let(
                running_sums(steps),
                lambda sums: let(
                    gaps,
                    lambda gs: let(
                        values,
                        lambda vs: F.filter(
                            F.transform(
                                found,
                                lambda m, i: F.struct(
                                    (F.get(sums, i) + F.length(F.get(gs, i))).alias("start"),
                                    F.lit(order).alias("ord"),
                                    F.lit(kind).alias("kind"),
                                    (F.get(sums, i) + F.length(F.get(gs, i)) + F.length(m)).cast("bigint").alias("end"),
                                    F.get(vs, i).alias("value"),
                                ),
                            ),
                            lambda s: keep(s["value"]),
                        ),
                    ),
                ),
            )

        return F.when(F.size(found) == 0, empty).otherwise(
            let(gaps, lambda gs: spans(F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gs, i)))))
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def spans_string(spans: Column) -> Column:
    """kind:start:end, comma-joined, of spans sorted by (start, ord)."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, null where a table lacks one; extra columns, clashing names included, go."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).alias(n) for n in names])
