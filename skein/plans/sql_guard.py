"""Read-only SQL over registered views."""

from __future__ import annotations

import re

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 500
#: Functions that reach beyond the rows they are given: JVM methods, files, the session, other systems.
UNSAFE_FUNCTIONS = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user session_user user current_catalog current_database current_schema version spark_partition_id raise_error".split())
#: Plan nodes that read relations other than by name, or do anything but query.
UNSAFE_NODES = ("Command", "InsertInto", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "ScriptTransformation", "UnresolvedTableOrView")


class RejectedQuery(ValueError):
    pass


def strip_literals(sql: str) -> str:
    """The text without strings and comments."""
    return re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)


def check(sql: str) -> str:
    """The query, or RejectedQuery: one SELECT or WITH, no recursion."""
    text = sql.strip()
    text = text[:-1].rstrip() if text.endswith(";") else text
    plain = strip_literals(text)
    if ";" in plain:
        raise RejectedQuery("one statement only")
    words = re.findall(r"[a-z_]+", plain.lower())
    if not words or words[0] not in ("select", "with"):
        raise RejectedQuery("only SELECT and WITH are allowed")
    if words[0] == "with" and words[1:2] == ["recursive"]:
        raise RejectedQuery("recursion is not allowed")
    return text


def names_in(spark: SparkSession, text: str) -> tuple[set[tuple[str, ...]], set[str], set[str]]:
    """Relations, functions and node kinds that the parsed query names, subqueries and common table expressions included."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    relations: set[tuple[str, ...]] = set()
    functions: set[str] = set()
    kinds: set[str] = set()
    common: set[str] = set()

    def strings(seq) -> tuple[str, ...]:
        return tuple(seq.apply(i) for i in range(seq.size()))

    def each(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def expression(e) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            functions.add(strings(e.nameParts())[-1].lower())
        if is_instance_of(spark.sparkContext._gateway, e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            node(e.plan())
        for c in each(e.children()):
            expression(c)

    def node(n) -> None:
        kind = n.getClass().getSimpleName()
        kinds.add(kind)
        if kind == "UnresolvedRelation":
            relations.add(strings(n.multipartIdentifier()))
        if kind == "UnresolvedWith":
            for pair in each(n.cteRelations()):
                common.add(pair._1().lower())
                node(pair._2())
        for e in each(n.expressions()):
            expression(e)
        for c in each(n.children()):
            node(c)

    node(plan)
    return {r for r in relations if not (len(r) == 1 and r[0].lower() in common)}, functions, kinds


def query(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None, limit: int = MAX_ROWS) -> DataFrame:
    """Runs a checked query over ``views`` alone; at most ``limit`` rows, whatever LIMIT it has itself.

    The parsed plan, not its text, says what is read: a relation must be one of the
    views by its bare name, so files, catalogs and other views of the session are out
    of reach however they are quoted, and functions must be built in and harmless.
    """
    text = check(sql)
    known = {name.lower() for name in views or {}}
    relations, functions, kinds = names_in(spark, text)
    for r in relations:
        if len(r) != 1 or r[0].lower() not in known:
            raise RejectedQuery(f"{'.'.join(r)} is no view")
    if bad := functions & UNSAFE_FUNCTIONS:
        raise RejectedQuery(f"{min(bad)} is not allowed")
    built_in = {f.lower() for f in _built_in(spark)}
    if other := {f for f in functions if f not in built_in}:
        raise RejectedQuery(f"{min(other)} is no built-in function")
    if bad := {k for k in kinds if any(x in k for x in UNSAFE_NODES)}:
        raise RejectedQuery(f"{min(bad)} is not allowed")
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text).limit(min(limit, MAX_ROWS))


def _built_in(spark: SparkSession) -> set[str]:
    seq = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.functionSet().toSeq()
    return {seq.apply(i).funcName() for i in range(seq.size())}
