"""DOCX files: body order, headings, code, tables and amendment boxes."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

from foliant.functions.text import is_monospace

# The box that announces a change, "[id: instruction upon ... implementation of trigger:] body"; a pattern may go without the trigger.
AMENDMENTS = (
    re.compile(
        r"(?s)^\[(?P<id>(?:OBD|NPRR)\w+(?:\s+and\s+(?:OBD|NPRR)\w+)*):\s*(?P<instruction>.+?)"
        r"(?:\s+upon\s+.*?implementation\s+of\s+(?P<trigger>(?:NPRR|OBD)\w+(?:;\s*or\s+.*?(?:NPRR|OBD)\w+)*))[^]]*:\]\s*(?P<body>.+)$"
    ),
)
# Paragraph styles of code, languages that a style may name, and what code of a language starts with.
CODE_STYLES = ("code", "html code", "preformatted text", "source code", "macro text", "plain text", "console", "listing")
LANGUAGES = ("python", "javascript", "java", "go", "rust", "sql", "shell", "bash")
STARTS = {"#!/": "shell", "def ": "python", "import ": "python", "class ": "python", "SELECT ": "sql", "INSERT ": "sql"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def guess_language(style: str, text: str) -> str | None:
    """A language that the style's name holds, or the one that code starts like this in."""
    named = [x for x in LANGUAGES if x in style.lower()]
    return next(iter(named + [language for start, language in STARTS.items() if text.startswith(start)]), None)


def amendment(text: str, patterns=AMENDMENTS) -> str | None:
    """The box's text under a line that names the change and, where the pattern finds one, its trigger."""
    found = next((m for p in patterns if (m := p.match(text))), None)
    if found is None:
        return None
    part = {"trigger": None} | found.groupdict()
    head = ", effective upon ".join(x for x in (part["id"], part["trigger"]) if x)
    return f"[PENDING AMENDMENT — {head}]\n{part['instruction'].strip().rstrip('.')}:\n{part['body'].strip()}"


def _text(e: ET.Element) -> str:
    out = []
    for x in e.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
        elif x.tag == _W + "tab":
            out.append("\t")
    return "".join(out)


def parse_docx(data: bytes, patterns=AMENDMENTS) -> tuple[dict, list[tuple]]:
    """(metadata, blocks); a block is (content, kind, path, language, file)."""
    book = zipfile.ZipFile(io.BytesIO(data))
    meta = {"title": None, "authors": ["Unknown"]}
    if "docProps/core.xml" in book.namelist():
        for e in ET.fromstring(book.read("docProps/core.xml")).iter():
            if e.tag.endswith("}title") and (e.text or "").strip():
                meta["title"] = e.text.strip()
            if e.tag.endswith("}creator") and (e.text or "").strip():
                meta["authors"] = [a.strip() for a in re.split(";" if ";" in e.text else ",", e.text) if a.strip()]
    body = ET.fromstring(book.read("word/document.xml")).find(_W + "body")
    stack: list[tuple[int, str]] = []
    blocks: list[tuple] = []
    held: list[str] = []
    held_kind, held_style = "text", ""

    def flush() -> None:
        if any(x.strip() for x in held):
            content = ("\n" if held_kind == "code" else "\n\n").join(held)
            blocks.append((content, held_kind, tuple(x for _, x in stack), guess_language(held_style, content) if held_kind == "code" else None, "word/document.xml"))
        held.clear()

    for e in body if body is not None else ():
        if e.tag == _W + "tbl":
            flush()
            rows = [["\n".join(_text(p) for p in c.iter(_W + "p")).strip() for c in r.findall(_W + "tc")] for r in e.findall(_W + "tr")]
            rows = [r for r in rows if any(r)]
            boxed = amendment("\n".join(r[0] for r in rows), patterns) if rows and max(map(len, rows)) == 1 else None
            path = tuple(x for _, x in stack)
            if boxed:
                blocks.append((boxed, "text", path, None, "word/document.xml"))
            elif rows:
                lines = ["| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r) + " |" for r in rows]
                lines.insert(1, "| " + " | ".join("---" for _ in rows[0]) + " |")
                blocks.append(("\n".join(lines), "table", path, None, "word/document.xml"))
        elif e.tag == _W + "p":
            style = next((s.get(_W + "val") or "" for s in e.iter(_W + "pStyle")), "")
            text = _text(e)
            level = re.fullmatch(r"heading\s*(\d)", style, re.I)
            if (level or style.lower() == "title") and text.strip():
                flush()
                depth = int(level[1]) if level else 0
                stack[:] = [h for h in stack if h[0] < depth] + [(depth, text.strip())]
                continue
            fonts = [f.get(_W + "ascii") or "" for f in e.iter(_W + "rFonts")]
            named = style.lower() in CODE_STYLES or is_monospace(style)
            kind = "code" if named or (fonts and all(map(is_monospace, fonts))) else "text"
            if kind != held_kind:
                flush()
            held_kind, held_style = kind, style
            if kind == "code" or text.strip():
                held.append(text)
    flush()
    return meta, blocks
