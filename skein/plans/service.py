"""What stands between queries and a client: tool profiles and discovery, stored outputs, size limits, checks of names.

All of it is small state of one process; nothing here touches a table.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import secrets
import time
from collections import OrderedDict
from dataclasses import dataclass, field

# Tools by profile, bundles of tools with the words that ask for them, hints, limits in bytes.
ALWAYS = frozenset({"retrieve_output"})
MINIMAL = frozenset({"discover_tools", "execute_tool", "health"})
CORE = frozenset("context read_symbol list_file_symbols understand impact detect_changes trace_call_path".split())
EXTENDED = CORE | frozenset(
    """get_architecture_summary get_key_symbols explore search_code assemble_context compare_symbols find_routes trace_route compare_routes
    checkpoint_context read_delta""".split()
)
BUNDLES = {
    "inspection": ("context read_symbol list_file_symbols understand", "search find read code source definition symbol inspect look understand"),
    "change_analysis": ("impact detect_changes trace_call_path", "impact blast radius risk change trace call path break affect downstream diff"),
    "architecture": ("get_architecture_summary explore get_key_symbols", "architecture structure modules overview navigate key hub entry onboard"),
    "assembly": ("assemble_context checkpoint_context read_delta search_code", "assemble budget token context checkpoint delta snapshot regex search pattern"),
}
HINTS = {
    "understand": "Try compact=true to reduce output size",
    "impact": "Try compact=true or reduce depth",
    "list_file_symbols": "Try query=... or a smaller limit to narrow large-file inventories",
    "assemble_context": "Try a smaller budget_tokens or mode=signatures",
    "get_architecture_summary": "Try compact=true or a smaller limit",
    "context": "Try compact=true or a smaller limit",
    "read_symbol": "Try mode=bounded or mode=signature instead of full",
    "explore": "Try compact=true or include_deps=false",
}
SANDBOX_BYTES = 16 * 1024
RESPONSE_BYTES = 1024 * 1024
MOST_ACTIVATED = 5
MOST_FALLBACK = 3


def in_profile(tool: str, profile: str = "core") -> bool:
    if tool in ALWAYS or profile == "full":
        return True
    return tool in {"extended": EXTENDED, "minimal": MINIMAL}.get(profile, CORE)


# ---- discovery --------------------------------------------------------------


def asked_words(need: str, keywords: str) -> list[str]:
    """Keywords that hold, or are held by, a word of the need."""
    words = need.lower().split()
    return [k for k in keywords.split() if any(k in w or w in k for w in words)]


def choose_tools(need: str) -> tuple[str, list[str], list[str]]:
    """(bundle, tools, matched words): the best bundle, with the second where it is not twice as good; without any, the three best tools by the words of their bundles."""
    hits = {name: asked_words(need, keywords) for name, (_, keywords) in BUNDLES.items()}
    ranked = sorted(hits, key=lambda b: -len(hits[b]))
    best, second = ranked[:2]
    if hits[best]:
        take = [best]
        if 2 <= len(hits[best]) < 2 * len(hits[second]):
            take.append(second)
        return "+".join(take), [t for b in take for t in BUNDLES[b][0].split()], [w for b in take for w in hits[b]]
    by_tool = {t: asked_words(need, keywords) for tools, keywords in BUNDLES.values() for t in tools.split()}
    some = sorted((t for t in by_tool if by_tool[t]), key=lambda t: -len(by_tool[t]))[:MOST_FALLBACK]
    return "fallback", some, [w for t in some for w in by_tool[t]]


@dataclass
class Toolbox:
    """Registered callables, of which a client sees the active ones."""

    tools: dict
    profile: str = "core"
    active: set = field(default_factory=set)

    def __post_init__(self) -> None:
        self.active |= {t for t in self.tools if in_profile(t, self.profile)}

    def discover(self, need: str = "", activate: list[str] | None = None) -> dict:
        """Activates tools by name, or those that fit a need, five at most a call."""
        if not activate and not need:
            raise ValueError("need is required where nothing is to be activated")
        bundle, names, words = ("direct", list(activate), []) if activate else choose_tools(need)
        new = [n for n in names if n in self.tools and n not in self.active]
        known = [n for n in names if n in self.active]
        self.active |= set(new[:MOST_ACTIVATED])
        return {
            "bundle": bundle,
            "reason": "Directly activated: " + ", ".join(names) if activate else "Matched keywords: " + ", ".join(words),
            "activated": new[:MOST_ACTIVATED],
            "activated_count": len(new[:MOST_ACTIVATED]),
            "activation_capped": len(new) > MOST_ACTIVATED,
            "already_active": known,
            "pending": sorted(set(self.tools) - self.active),
        }

    def execute(self, tool: str, /, **args):
        """Runs an active tool on behalf of a client that lists none itself."""
        if tool not in self.tools:
            raise KeyError(f"no tool {tool}")
        if tool not in self.active and not in_profile(tool, self.profile):
            raise PermissionError(f"{tool} is not active")
        return self.tools[tool](**args)


# ---- outputs ----------------------------------------------------------------


def whole_prefix(text: str, limit: int) -> str:
    """The longest prefix of whole characters within ``limit`` bytes."""
    return text.encode()[: max(0, limit)].decode(errors="ignore")


class OutputStore:
    """Large outputs by handle: ``ttl`` seconds, ``most`` of them, the oldest goes first."""

    def __init__(self, most: int = 50, ttl: float = 600.0, clock=time.monotonic) -> None:
        self.most, self.ttl, self.clock = most, ttl, clock
        self.held: OrderedDict[str, tuple[float, str, bytes]] = OrderedDict()

    def put(self, tool: str, data: bytes) -> str:
        self.expire()
        handle = secrets.token_hex(8)
        self.held[handle] = (self.clock(), tool, data)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return handle

    def expire(self) -> None:
        limit = self.clock() - self.ttl
        for handle in [h for h, (at, _, _) in self.held.items() if at < limit]:
            del self.held[handle]

    def page(self, handle: str, offset: int = 0, limit: int = 4000) -> dict:
        """A slice of bytes; 4000 unless asked otherwise, 16000 at most."""
        if handle not in self.held:
            raise KeyError(f"handle {handle!r} not found or expired")
        data = self.held[handle][2]
        offset, limit = max(0, offset), min(limit if limit > 0 else 4000, 16_000)
        part = data[offset : offset + limit]
        rest = max(0, len(data) - offset - len(part))
        out = {"content": part.decode(errors="replace"), "total_size": len(data), "returned_bytes": len(part), "remaining_bytes": rest, "has_more": rest > 0}
        return out | ({"next_args": {"handle": handle, "offset": offset + len(part), "limit": limit}} if rest else {})


def response(result, tool: str = "", store: OutputStore | None = None) -> str:
    """A result as text: as it is, as a stored output with a preview, or cut to a megabyte and still valid JSON if it was."""
    text = result if isinstance(result, str) else json.dumps(result, indent=2, ensure_ascii=False)
    size = len(text.encode())
    if store is not None and size > SANDBOX_BYTES:
        handle = store.put(tool, text.encode())
        preview = whole_prefix(text, 500)
        about = {"sandboxed": True, "handle": handle, "tool": tool, "size_bytes": size, "preview": preview + "...", "recovery_hint": HINTS.get(tool, "Try compact=true to reduce output size")}
        return json.dumps(about | {"next_tool": "retrieve_output", "next_args": {"handle": handle, "offset": 0, "limit": 4000}}, indent=2, ensure_ascii=False)
    if size <= RESPONSE_BYTES:
        return text
    if text.lstrip()[:1] not in ("{", "["):
        tail = "\n... [truncated, response exceeded 1MB]"
        return whole_prefix(text, RESPONSE_BYTES - len(tail)) + tail

    def wrapped(part: str) -> str:
        return json.dumps({"truncated": True, "message": "Response exceeded 1MB size limit", "partial_data": part}, ensure_ascii=False)

    # the longest prefix whose escaped form fits, by halving: a prefix of characters is always valid once escaped
    low, high = 0, RESPONSE_BYTES
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if len(wrapped(text[:mid]).encode()) <= RESPONSE_BYTES else (low, mid - 1)
    return wrapped(text[:low])


# ---- names ------------------------------------------------------------------


def check_git_ref(ref: str) -> str:
    """A ref of letters, digits and ``~^.-/``, without a leading dash, ``..`` or ``@{``; else ValueError."""
    if not re.fullmatch(r"[A-Za-z0-9~^.\-/]+", ref) or ref.startswith("-") or ".." in ref:
        raise ValueError(f"invalid git ref: {ref}")
    return ref


def repo_path(root: str, path: str) -> tuple[str, str]:
    """(path below the root, absolute path) with links resolved; ValueError where it leads out of the root."""
    if not path:
        raise ValueError("path is required")
    top = os.path.realpath(root)
    full = os.path.realpath(os.path.join(root, path))
    if full != top and not full.startswith(top + os.sep):
        raise ValueError(f"{path} is outside the root")
    return posixpath.normpath(os.path.relpath(full, top)), full


def choose_embedder(available: dict[str, object], order: tuple[str, ...] = ("onnx", "ollama", "openai", "llamacpp", "tfidf")):
    """(name, embedder) of the first in order that is there; factories that fail are passed over."""
    for name in order:
        factory = available.get(name)
        if factory is None:
            continue
        try:
            return name, factory()
        except Exception:  # noqa: BLE001, S112  the next one is the fallback
            continue
    raise LookupError("no embedder is available")
