"""Markdown of results, outlines and books."""

from __future__ import annotations

from collections.abc import Iterable

MARKS = (". ", "! ", "? ", ".\n")


def cut(text: str, limit: int) -> str:
    """At most limit characters, cut after a sentence or at a space in the last two fifths, else hard."""
    if len(text) <= limit:
        return text
    for mark in MARKS:
        at = text.rfind(mark, int(limit * 0.6), limit)
        if at >= 0:
            return text[: at + len(mark)].rstrip()
    at = text.rfind(" ", int(limit * 0.6), limit)
    return text[:at] if at >= 0 else text[:limit]


def results(rows: Iterable[dict], limit: int = 1000) -> str:
    """Hits in order, each with its book, section and score."""
    out = []
    for i, r in enumerate(rows, 1):
        body = cut(r["content"], limit)
        shown = f"```\n{body}\n```" if r["content_type"] in ("code", "diagram") else body
        out.append(f"### {i}. {r['book_title']}\n*{' > '.join(r['section_path'] or [])}* ({r['source']}, {r['score']:.3f})\n\n{shown}{' …' if body != r['content'] else ''}")
    return "\n\n".join(out)


def outline(lines: Iterable[dict]) -> str:
    """Indented list of (first, depth, name) lines."""
    return "\n".join("  " * r["depth"] + f"- {r['name']}" for r in sorted(lines, key=lambda r: (r["first"], r["depth"])))


def book_table(books: Iterable[dict]) -> str:
    head = "| Id | Title | Collection |\n| --- | --- | --- |"
    return "\n".join([head, *(f"| {b['book_id']} | {b['title']} | {b.get('collection') or ''} |" for b in books)])


def book_info(book: dict) -> str:
    return "\n".join(f"- **{k}**: {', '.join(v) if isinstance(v, list) else v}" for k, v in book.items() if v not in (None, "", []))
