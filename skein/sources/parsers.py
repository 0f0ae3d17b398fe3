"""Source files to typed nodes and edges (Go, JavaScript / TypeScript, PHP).

Files are read as Latin-1, so string places are byte offsets.  Comments and
strings are blanked first; structure is then found on the blanked text and text
taken from the original.  Each file is parsed alone, so files spread over tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CALLS, CLASS, DEFINES, DEFINES_METHOD, FILE, FUNCTION, HANDLES, IMPLEMENTS, IMPORTS, INHERITS, INSTANTIATES, INTERFACE, METHOD, ROUTE, STRUCT

MAX_BYTES = 5 * 1024 * 1024
DOC_BYTES = 4096
VERBS = "get post put patch delete options head".split()
NO_CALL = frozenset(
    "if for while switch return catch func function new else elseif foreach do case echo print throw try finally class array list isset unset empty die exit include require "
    "include_once require_once use namespace public private protected static abstract typeof await async super constructor import export default select go defer range make len append cap".split()
)


def node_id(path: str, name: str) -> str:
    return hashlib.sha256(f"{path}\0{name}".encode()).hexdigest()


def blank(src: str, hash_comments: bool = False) -> str:
    """``src`` with comments and strings as blanks, lines kept."""
    token = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    if hash_comments:
        token += r"|#(?!\[)[^\n]*"
    return re.sub(token, lambda m: re.sub(r"[^\n]", " ", m[0]), src, flags=re.S)


def block_end(plain: str, start: int) -> int:
    """End of the braces that open at or after ``start``; the line's end without any."""
    at = plain.find("{", start)
    stop = plain.find("\n", start)
    if at < 0:
        return len(plain) if stop < 0 else stop
    depth = 0
    for m in re.compile(r"[{}]").finditer(plain, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(plain)


class FileParse:
    """Collects a file's nodes and edges."""

    def __init__(self, path: str, src: str) -> None:
        self.path, self.src = path, src
        self.nodes: list[tuple] = []
        self.edges: dict[tuple, str | None] = {}
        self.seen: set[str] = set()
        self.node(path, FILE, 0, len(src), path)

    def utf8(self, s: str) -> str:
        return s.encode("latin-1").decode("utf-8", "replace")

    def node(self, name: str, kind: int, start: int, end: int, summary: str | None = None) -> bool:
        if name in self.seen:
            return False
        self.seen.add(name)
        told = summary if summary is not None else f"{self.doc(start)} {name}".strip()
        self.nodes.append((node_id(self.path, name), self.path, name, kind, start, end, told))
        if kind != FILE and kind != ROUTE and "." not in name:
            self.edge(self.path, name, DEFINES)
        return True

    def edge(self, a: str, b: str, kind: int, symbol: str | None = None, other_file: bool = False) -> None:
        target = node_id(b, b) if other_file else node_id(self.path, b)
        self.edges.setdefault((node_id(self.path, a), target, kind), symbol)

    def doc(self, start: int) -> str:
        """The comment block right above a declaration, without its marks."""
        lines = self.src[:start].split("\n")[:-1]
        out: list[str] = []
        for ln in reversed(lines):
            s = ln.strip()
            if not s.startswith(("//", "*", "/*", "#")) or s.startswith("#["):
                break
            out.append(re.sub(r"^[/*#\s]+|[*/\s]+$", "", s))
        return self.utf8(" ".join(x for x in reversed(out) if x and not x.startswith("@")))

    def calls(self, name: str, body: str, own: str | None = None) -> None:
        for m in re.finditer(r"(?<![\w.$>:])(?:(new)\s+)?((?:[A-Za-z_]\w*\.)?[A-Za-z_]\w*)\s*\(", body):
            called = m[2]
            if called.split(".")[0] in NO_CALL and not called.startswith("this."):
                continue
            if own and called.startswith("this."):
                called = f"{own}.{called[5:]}"
            if called != name:
                self.edge(name, called, INSTANTIATES if m[1] else CALLS, called)

    def route(self, method: str, path: str, handler: str, start: int, end: int) -> None:
        path = re.sub("/{2,}", "/", "/" + path.strip())
        path = path.rstrip("/") or "/"
        name = f"{method.upper()} {path}"
        words = [w for w in re.split(r"[/{}:\-_.]+", path) if w]
        told = " ".join([name, *words, *(["api endpoint"] if re.search(r"^/(api|v\d+)(/|$)", path) else []), *([handler] if handler else [])])
        if self.node(name, ROUTE, start, end, self.utf8(told)) and handler:
            self.edge(name, handler, HANDLES, handler)


def parse_go(f: FileParse) -> None:
    src = f.src
    plain = blank(src)
    for m in re.finditer(r"^import\s+(?:\(([^)]*)\)|[^\n]*)", plain, re.M):
        for q in re.findall(r"\"([^\"\n]+)\"", src[m.start() : m.end()]):
            f.edge(f.path, q, IMPORTS, other_file=True)
    kinds = {"struct": STRUCT, "interface": INTERFACE}
    for m in re.finditer(r"^type\s+(?:\(|(\w+)(?:\[[^\]]*\])?\s+=?\s*(\w+))", plain, re.M):
        if m[1]:
            kind = kinds.get(m[2], FUNCTION)
            f.node(m[1], kind, m.start(1), block_end(plain, m.end()) if kind != FUNCTION else plain.find("\n", m.end()) % (len(plain) + 1))
            continue
        depth = 1
        end = m.end()
        while end < len(plain) and depth:
            depth += {"(": 1, ")": -1}.get(plain[end], 0)
            end += 1
        for t in re.finditer(r"^[ \t]+(\w+)\s+(struct|interface)\b", plain[m.end() : end], re.M):
            f.node(t[1], kinds[t[2]], m.end() + t.start(1), block_end(plain, m.end() + t.end()))
    for m in re.finditer(r"^func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(([^)]*)\)", plain, re.M):
        name = f"{m[1]}.{m[2]}" if m[1] else m[2]
        end = block_end(plain, m.end())
        params = ", ".join(p.split()[-1] for p in m[3].split(",") if p.split())
        if f.node(name, METHOD if m[1] else FUNCTION, m.start(), end, f"{f.doc(m.start())} {name}({params})".strip()):
            if m[1]:
                f.edge(f.path, name, DEFINES)
                f.edge(m[1], name, DEFINES_METHOD)
            body = plain[m.end() : end]
            f.calls(name, body[body.find("{") + 1 :] if "{" in body else "")
    for m in re.finditer(r"\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\(\s*\"([^\"]+)\"\s*,\s*([\w.]+)", src):
        f.route(m[1], m[2], m[3], m.start(), m.end())
    for m in re.finditer(r"\.Handle(?:Func)?\(\s*\"(?:([A-Z]+) )?([^\"]+)\"\s*,\s*([\w.]+)[^\n]*?(?:\.Methods\(\s*\"(\w+)\"|$)", src, re.M):
        f.route(m[1] or m[4] or "ANY", m[2], m[3], m.start(), m.end())


def parse_js(f: FileParse) -> None:
    src = f.src
    plain = blank(src)
    for m in re.finditer(r"\bimport\b[^'\"\n;]*['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)|\bexport\b[^'\"\n;]*\bfrom\s*['\"]([^'\"]+)['\"]", src):
        f.edge(f.path, m[1] or m[2] or m[3], IMPORTS, other_file=True)
    for m in re.finditer(r"\bclass\s+(\w+)(?:\s+extends\s+([\w.]+))?(?:\s+implements\s+([\w.,\s]+?))?\s*\{", plain):
        end = block_end(plain, m.end() - 1)
        if not f.node(m[1], CLASS, m.start(), end):
            continue
        if m[2]:
            f.edge(m[1], m[2], INHERITS, m[2])
        for i in (m[3] or "").split(","):
            if i.strip():
                f.edge(m[1], i.strip(), IMPLEMENTS, i.strip())
        at = m.end()
        for x in re.finditer(r"^[ \t]*(?:(?:public|private|protected|static|async|override|get|set)\s+)*([A-Za-z_$]\w*)\s*\([^)]*\)\s*(?::\s*[^{};]+)?\{", plain[at:end], re.M):
            if x[1] in NO_CALL and x[1] != "constructor" or plain[at : at + x.start()].count("{") != plain[at : at + x.start()].count("}"):
                continue
            name, stop = f"{m[1]}.{x[1]}", block_end(plain, at + x.end() - 1)
            if f.node(name, METHOD, at + x.start(1), stop):
                f.edge(m[1], name, DEFINES_METHOD)
                f.calls(name, plain[at + x.end() : stop], m[1])
                for v, p in re.findall(r"@(Get|Post|Put|Patch|Delete)\(\s*['\"]?([^'\")]*)['\"]?\s*\)\s*$", src[at : at + x.start(1)].rstrip().removesuffix("async").rstrip()):
                    prefix = re.search(r"@Controller\(\s*['\"]([^'\"]*)['\"]\s*\)", src[: m.start()])
                    f.route(v, f"{prefix[1] if prefix else ''}/{p}", name, at + x.start(1), stop)
    for m in re.finditer(r"\bfunction\s*\*?\s+(\w+)\s*\(", plain):
        end = block_end(plain, m.end())
        if f.node(m[1], FUNCTION, m.start(), end):
            f.calls(m[1], plain[plain.find("{", m.end()) + 1 : end])
    for m in re.finditer(r"\b(?:const|let|var)\s+(\w+)(?:\s*:[^=\n]+)?\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)(?:\s*:[^=\n]+)?\s*=>", plain):
        end = block_end(plain, m.end()) if plain[m.end() :].lstrip().startswith("{") else (plain.find("\n", m.end()) % (len(plain) + 1))
        if f.node(m[1], FUNCTION, m.start(), end):
            f.calls(m[1], plain[m.end() : end])
    mounts: dict[str, list[str]] = {}
    for m in re.finditer(r"\b(\w+)\.use\(\s*['\"]([^'\"]+)['\"]\s*,\s*(?:[\w.]+\s*,\s*)*(\w+)\s*\)", src):
        mounts.setdefault(m[3], []).append(f"{m[1]}\0{m[2]}")

    def prefixes(name: str, seen: frozenset[str] = frozenset()) -> list[str]:
        if name in seen or name not in mounts:
            return [""]
        return [p + own for x in mounts[name] for parent, own in [x.split("\0")] for p in prefixes(parent, seen | {name})]

    for m in re.finditer(rf"\b(\w+)\.({'|'.join(VERBS)})\(\s*['\"](/[^'\"]*)['\"]\s*,([^\n]*)", src):
        last = re.findall(r"[A-Za-z_][\w.]*", re.sub(r"\(.*?\)\s*=>.*|function.*", "", m[4]))
        for p in prefixes(m[1]):
            f.route(m[2], p + m[3], last[-1] if last else "", m.start(), m.end())


def parse_php(f: FileParse) -> None:
    src = f.src
    plain = blank(src, True)
    for m in re.finditer(r"^use\s+([\w\\]+)", plain, re.M):
        f.edge(f.path, m[1], IMPORTS, m[1].rpartition("\\")[2], other_file=True)
    last = lambda s: s.strip().rpartition("\\")[2]
    inside: list[tuple[int, int]] = []
    for m in re.finditer(r"\b(class|interface|trait)\s+(\w+)(?:\s+extends\s+([\w\\,\s]+?))?(?:\s+implements\s+([\w\\,\s]+?))?\s*\{", plain):
        end = block_end(plain, m.end() - 1)
        inside.append((m.start(), end))
        if not f.node(m[2], INTERFACE if m[1] == "interface" else CLASS, m.start(), end):
            continue
        for group, kind in ((m[3], INHERITS), (m[4], IMPLEMENTS)):
            for x in (group or "").split(","):
                if x.strip():
                    f.edge(m[2], last(x), kind, last(x))
        at = m.end()
        for x in re.finditer(r"\bfunction\s+&?(\w+)\s*\(", plain[at:end]):
            name, stop = f"{m[2]}.{x[1]}", block_end(plain, at + x.end())
            if f.node(name, METHOD, at + x.start(), stop):
                f.edge(m[2], name, DEFINES_METHOD)
                php_calls(f, name, plain[at + x.end() : stop], m[2])
    for m in re.finditer(r"\bfunction\s+&?(\w+)\s*\(", plain):
        if not any(a <= m.start() < b for a, b in inside):
            end = block_end(plain, m.end())
            if f.node(m[1], FUNCTION, m.start(), end):
                php_calls(f, m[1], plain[m.end() : end], None)
    laravel_routes(f)


def php_calls(f: FileParse, name: str, body: str, own: str | None) -> None:
    for c in re.findall(r"\bnew\s+\\?([\w\\]+)", body):
        c = c.rpartition("\\")[2]
        if c not in ("self", "static", "class"):
            f.edge(name, c, INSTANTIATES, c)
    for obj, c in re.findall(r"(\$this|self|static|parent)\s*(?:->|::)\s*(\w+)\s*\(", body):
        f.edge(name, f"{own}.{c}" if own else c, CALLS, c)
    for cls, c in re.findall(r"\b([A-Z]\w+)\s*::\s*(\w+)\s*\(", body):
        f.edge(name, f"{cls}.{c}", CALLS, f"{cls}.{c}")
    for c in re.findall(r"(?<![>\w:$\\])(?<!new )(\w+)\s*\(", body):
        if c.lower() not in NO_CALL and not c.isdigit():
            f.edge(name, c, CALLS, c)


def laravel_handler(args: str) -> str:
    """Controller.method of the ways a handler is written; '' for closures."""
    m = re.match(r"\s*\[\s*([\w\\]+)::class\s*,\s*['\"](\w+)['\"]", args) or re.match(r"\s*['\"]([\w\\]+)@(\w+)['\"]", args) or re.search(r"['\"]uses['\"]\s*=>\s*['\"]([\w\\]+)@(\w+)['\"]", args)
    if m:
        return f"{m[1].rpartition(chr(92))[2]}.{m[2]}"
    m = re.match(r"\s*([\w\\]+)::class", args)
    return f"{m[1].rpartition(chr(92))[2]}.__invoke" if m else ""


def laravel_routes(f: FileParse) -> None:
    src, plain = f.src, blank(f.src, True)
    groups = []
    for m in re.finditer(r"prefix\(\s*['\"]([^'\"]*)['\"]\s*\)[^;{]*?group\(|group\(\s*\[[^\]]*['\"]prefix['\"]\s*=>\s*['\"]([^'\"]*)['\"]", src):
        groups.append((m.end(), block_end(plain, m.end()), m[1] or m[2]))

    def prefix(at: int) -> str:
        return "/".join(p for a, b, p in groups if a <= at < b)

    for m in re.finditer(rf"\bRoute::(?:[\w]+\([^)]*\)->)*({'|'.join(VERBS)}|any|match|resource|apiResource)\(\s*(?:\[([^\]]*)\]\s*,\s*)?['\"]([^'\"]*)['\"]\s*(?:,([^;]*))?", src):
        path, rest = f"{prefix(m.start())}/{m[3]}", m[4] or ""
        if m[1] in ("resource", "apiResource"):
            c = re.match(r"\s*([\w\\]+)::class|\s*['\"]([\w\\]+)['\"]", rest)
            ctl = (c[1] or c[2]).rpartition("\\")[2] if c else ""
            for verb, tail, act in (("GET", "", "index"), ("POST", "", "store"), ("GET", "/{id}", "show"), ("PUT", "/{id}", "update"), ("DELETE", "/{id}", "destroy"), ("GET", "/create", "create"), ("GET", "/{id}/edit", "edit")):
                if m[1] == "resource" or act not in ("create", "edit"):
                    f.route(verb, path + tail, f"{ctl}.{act}" if ctl else "", m.start(), m.end())
            continue
        verbs = re.findall(r"\w+", m[2] or "") if m[1] == "match" else ["ANY"] if m[1] == "any" else [m[1]]
        for v in verbs:
            f.route(v, path, laravel_handler(rest), m.start(), m.end())


def file_document(path: str, raw: bytes) -> str:
    """Base name and the first 4096 bytes of a document file, cut between characters."""
    base = path.rpartition("/")[2]
    text = raw[:DOC_BYTES].decode("utf-8", "ignore")
    return f"{base} {text}" + ("..." if len(raw) > DOC_BYTES else "")


PARSERS = {"go": parse_go, "js": parse_js, "jsx": parse_js, "ts": parse_js, "tsx": parse_js, "php": parse_php}


def parse_file(path: str, raw: bytes) -> tuple[list[tuple], list[tuple]]:
    """(nodes, edges) of a file; nothing for other extensions and beyond the size cap."""
    parser = PARSERS.get(path.rpartition(".")[2].lower())
    if parser is None or len(raw) > MAX_BYTES:
        return [], []
    f = FileParse(path, raw.decode("latin-1"))
    parser(f)
    return f.nodes, [(a, b, k, s) for (a, b, k), s in f.edges.items()]


PARSED = (
    "file_path string, nodes array<struct<id:string,file_path:string,symbol_name:string,node_type:tinyint,start_byte:bigint,end_byte:bigint,content_sum:string>>, "
    "edges array<struct<source_id:string,target_id:string,edge_type:tinyint,target_symbol:string>>"
)


def parse(files: DataFrame) -> DataFrame:
    """(file_path, content binary) to one row a file with its nodes and edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_keys = ("id", "file_path", "symbol_name", "node_type", "start_byte", "end_byte", "content_sum")
        e_keys = ("source_id", "target_id", "edge_type", "target_symbol")
        for b in batches:
            got = [parse_file(p, bytes(c)) for p, c in zip(b["file_path"], b["content"], strict=True)]
            yield pd.DataFrame({"file_path": b["file_path"], "nodes": [[dict(zip(n_keys, x, strict=True)) for x in n] for n, _ in got], "edges": [[dict(zip(e_keys, x, strict=True)) for x in e] for _, e in got]})

    return files.select("file_path", "content").mapInPandas(run, PARSED)


def nodes_of(parsed: DataFrame) -> DataFrame:
    from ..functions.text import search_terms

    n = parsed.select(F.explode("nodes").alias("n")).select("n.*")
    return n.withColumn("search_terms", search_terms(F.col("symbol_name"), F.col("file_path")))


def edges_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("edges").alias("e")).select("e.*").dropDuplicates(["source_id", "target_id", "edge_type"])
