"""Table schemas, enumerations and the constants of ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 5
NODE_TYPES = {1: "function", 2: "class", 3: "struct", 4: "method", 5: "interface", 6: "file", 7: "route"}
EDGE_TYPES = {1: "calls", 2: "imports", 3: "implements", 4: "instantiates", 5: "defines", 6: "defines_method", 7: "inherits", 8: "handles"}
FUNCTION, CLASS, STRUCT, METHOD, INTERFACE, FILE, ROUTE = range(1, 8)
CALLS, IMPORTS, IMPLEMENTS, INSTANTIATES, DEFINES, DEFINES_METHOD, INHERITS, HANDLES = range(1, 9)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in columns.items()])


S, L, B, D, TS = T.StringType(), T.LongType(), T.ByteType(), T.DoubleType(), T.TimestampType()
NODES = _table(id=S, file_path=S, symbol_name=S, node_type=B, start_byte=L, end_byte=L, content_sum=S, search_terms=S)
EDGES = _table(source_id=S, target_id=S, edge_type=B, target_symbol=S)
EMBEDDINGS = _table(node_id=S, embedding=T.ArrayType(T.FloatType()))
NODE_SCORES = _table(node_id=S, pagerank=D, betweenness=D)
COMMUNITIES = _table(community_id=L, node_id=S)
PROJECT_SUMMARIES = _table(project=S, summary=S, source_hash=S, created_at=TS, updated_at=TS)
REPO_SNAPSHOTS = _table(repo_root=S, head_commit=S, branch=S, is_detached=T.BooleanType(), modified=L, staged=L, untracked=L, indexed_at=TS)
GIT_COMMITS = _table(commit_hash=S, parent_hash=S, author_name=S, author_email=S, author_time=TS, subject=S, body=S, trailers=T.MapType(S, S))
FILE_HISTORY = _table(file_path=S, commit_hash=S, change_type=S, commit_time=TS, subject=S, body=S)
FILE_INTENTS = _table(file_path=S, intent=S, intent_hash=S, commit_count=L, updated_at=TS)
FILE_EVENTS = _table(path=S, action=S, ts=TS)


def node_id(file_path: Column, symbol_name: Column) -> Column:
    return F.sha2(F.concat(file_path, F.lit("\x00"), symbol_name), 256)


def name_of(code: Column, names: dict[int, str]) -> Column:
    """The name of an enumeration code, null for none."""
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


@dataclass(frozen=True)
class SearchConfig:
    weight_ppr: float = 0.35
    weight_bm25: float = 0.30
    weight_betweenness: float = 0.20
    weight_in_degree: float = 0.0
    weight_semantic: float = 0.15
    route_boost: float = 4.0
    route_method_boost: float = 1.5
    class_boost: float = 1.5
    function_boost: float = 1.2
    workflow_boost: float = 1.3
    seed_count: int = 10
    max_neighbors: int = 20
    added_divisor: int = 4
    expansion_bonus: float = 0.10
    non_core: float = 0.5
    bm25_floor: float = 0.0
    multiplier: int = 5
    candidate_minimum: int = 100
    max_per_file: int = 1


PENALTIES = {"generated": 0.3, "vendor": 0.3, "migration": 0.2, "test": 0.3, "example": 0.6, "config": 0.8}
