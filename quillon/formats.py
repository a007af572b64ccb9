"""Results and their output: terminal text, pretty text and JSON over the collected top rows (at most 100)."""
from __future__ import annotations

import json
from dataclasses import dataclass, field


def lines_str(a: int, b: int) -> str:
    return str(a) if a == b else f"{a}-{b}"


def preview(text: str, limit: int) -> str:
    raw = text.strip().encode()
    return raw.decode() if len(raw) <= limit else raw[:limit].decode("utf-8", "ignore") + "..."


def summary(kinds: list[str]) -> str:
    semantic = sum(k in ("Semantic", "Hybrid") for k in kinds)
    text = sum(k in ("Text", "Hybrid") for k in kinds)
    return f"{text} text + {semantic} semantic" if text and semantic else "semantic" if semantic else "text"


@dataclass
class SearchResult:
    """The collected hits of one search, best first."""

    hits: list[dict] = field(default_factory=list)
    query_time_ms: int = 0

    @classmethod
    def of(cls, df, query_time_ms: int = 0) -> SearchResult:
        return cls(sorted((r.asDict() for r in df.collect()), key=lambda h: (-h["score"], str(h["row_id"]))), query_time_ms)

    kinds = property(lambda self: [h.get("match_type", "Text") for h in self.hits])
    total = property(lambda self: len(self.hits))
    is_empty = property(lambda self: not self.hits)
    text_hits = property(lambda self: sum(k != "Semantic" for k in self.kinds))
    semantic_hits = property(lambda self: sum(k != "Text" for k in self.kinds))
    type_summary = property(lambda self: summary(self.kinds))


def format_ai(hits: list[dict], scores: bool = False) -> str:
    out = [f"# {len(hits)} results ({summary([h.get('match_type', 'Text') for h in hits])})", ""]
    for h in hits:
        mark = {"Hybrid": " +", "Semantic": " ~"}.get(h.get("match_type"), "")
        raw = f" [{h['score']:.6f}]" if scores else ""
        out += [f"{h['path']}:{h['line_start']} ({min(h['score'] * 3000, 99.9):.0f}%){mark}{raw}", "  " + preview((h["snippet"].splitlines() or [""])[0], 100)]
    return "\n".join(out) + "\n"


def format_pretty(hits: list[dict]) -> str:
    out = []
    for h in hits:
        out.append(f"{h['path']}:{lines_str(h['line_start'], h['line_end'])}")
        out += [f"  {h['line_start'] + i:>4} | {preview(x, 80)}" for i, x in enumerate(h["snippet"].splitlines()[:3])]
    return "\n".join(out) + "\n"


def format_json(hits: list[dict], query_time_ms: int = 0) -> str:
    r = SearchResult(hits, query_time_ms)
    return json.dumps({"hits": hits, "total": r.total, "query_time_ms": query_time_ms, "text_hits": r.text_hits, "semantic_hits": r.semantic_hits}, indent=2, ensure_ascii=False)


def format_size(n: int, places: int = 1, small: str = "B") -> str:
    """1 place and "B" in listings; index reports use 2 places and "bytes"."""
    for unit, at in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= at:
            return f"{n / at:.{places}f} {unit}"
    return f"{n} {small}"


def format_status(details: dict, detailed: bool = False) -> str:
    out = [f"Workspace: {details['workspace']}", "Indexed: yes", f"Index type: {'semantic' if details['semantic'] else 'text'}"]
    if details["semantic"]:
        out.append("Semantic search: available")
    if detailed:
        out += [f"  {k}: {details[k]}" for k in ("indexed_at", "files_indexed", "rows", "tokens", "terms", "vectors", "generation", "segments")]
        out.append(f"  size: {format_size(details['size'])}")
    return "\n".join(out) + "\n"
