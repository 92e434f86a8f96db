"""EPUB files: metadata, table of contents and blocks in reading order."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree as ET

from foliant.sources.html_blocks import html_blocks

# File stems of matter outside the table of contents, and their labels.
MATTER = {
    "cover": "Cover", "toc": "Table of Contents", "contents": "Table of Contents", "copyright": "Copyright", "copyrights": "Copyright", "title": "Title Page",
    "titlepage": "Title Page", "title-page": "Title Page", "dedication": "Dedication", "preface": "Preface", "foreword": "Foreword", "introduction": "Introduction",
    "intro": "Introduction", "acknowledgements": "Acknowledgements", "acknowledgments": "Acknowledgements", "about": "About", "colophon": "Colophon",
    "halftitle": "Half Title", "half-title": "Half Title",
}


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if _name(e) == name]


def _text(e: ET.Element) -> str:
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip()


def matter_label(href: str) -> str:
    """A label from the file's stem: a known name, a stem that starts or ends with one, else the stem in title case."""
    stem = posixpath.splitext(posixpath.basename(href))[0]
    key = stem.lower()
    if key in MATTER:
        return MATTER[key]
    near = next((v for k, v in MATTER.items() if key.startswith(k) or key.endswith(k)), None)
    return near or re.sub(r"[\s_-]+", " ", stem).strip().title()


def _insert(toc: dict[str, tuple[str, ...]], href: str, path: tuple[str, ...]) -> None:
    """Entries with a fragment always count; a plain file keeps its first path unless a longer one of the same chain comes."""
    old = toc.get(href)
    if "#" in href or old is None or (len(path) > len(old) and path[: len(old)] == old):
        toc[href] = path


def _nav(doc: ET.Element, base: str) -> dict[str, tuple[str, ...]]:
    navs = _all(doc, "nav")
    typed = [n for n in navs if any(k.rpartition("}")[2] == "type" and "toc" in v.split() for k, v in n.attrib.items())]
    chosen = (typed or [n for n in navs if n.get("id") == "toc"] or navs)[:1]
    toc: dict[str, tuple[str, ...]] = {}

    def walk(items: ET.Element, path: tuple[str, ...]) -> None:
        for li in items:
            if _name(li) != "li":
                continue
            label = next((c for c in li if _name(c) in ("a", "span")), None)
            here = path + ((_text(label),) if label is not None and _text(label) else ())
            if label is not None and label.get("href"):
                _insert(toc, posixpath.normpath(posixpath.join(base, unquote(label.get("href")))), here)
            for sub in li:
                if _name(sub) == "ol":
                    walk(sub, here)

    for nav in chosen:
        for ol in nav:
            if _name(ol) == "ol":
                walk(ol, ())
    return toc


def _ncx(doc: ET.Element, base: str) -> dict[str, tuple[str, ...]]:
    toc: dict[str, tuple[str, ...]] = {}

    def walk(parent: ET.Element, path: tuple[str, ...]) -> None:
        for point in parent:
            if _name(point) != "navPoint":
                continue
            label = next((_text(x) for x in point if _name(x) == "navLabel"), "")
            here = path + ((label,) if label else ())
            src = next((x.get("src") for x in point if _name(x) == "content"), None)
            if src:
                _insert(toc, posixpath.normpath(posixpath.join(base, unquote(src))), here)
            walk(point, here)

    for nav_map in _all(doc, "navMap"):
        walk(nav_map, ())
    return toc


def _places(toc: dict[str, tuple[str, ...]], href: str) -> tuple[tuple[str, ...], dict[str, tuple[str, ...]]]:
    """The path that a file begins with, and the paths of the ids in it.

    A file with ids only begins with the first one's path.  Beside a path of its
    own, ids count that lie below it, beside it or its parents, or below another id.
    """
    own, inside = toc.get(href), {h.partition("#")[2]: p for h, p in toc.items() if h.startswith(f"{href}#")}
    if own is None:
        return next(iter(inside.values()), ()), inside
    parents = {own[:i] for i in range(len(own) + 1)} | set(inside.values())
    return own, {x: p for x, p in inside.items() if p[:-1] in parents or p[: len(own)] == own}


def parse_epub(data: bytes) -> tuple[dict, list[tuple]]:
    """(metadata, blocks); a block is (content, kind, path, language, file)."""
    book = zipfile.ZipFile(io.BytesIO(data))
    opf = next(e.get("full-path") for e in _all(ET.fromstring(book.read("META-INF/container.xml")), "rootfile"))
    package, base = ET.fromstring(book.read(opf)), posixpath.dirname(opf)
    first = lambda name: next((_text(e) for e in _all(package, name) if _text(e)), None)
    authors = [a for e in _all(package, "creator") for a in (x.strip() for x in _text(e).split(";")) if a]
    isbn = next((d for e in _all(package, "identifier") if len(d := re.sub(r"[^0-9Xx]", "", re.sub("(?i)^urn:isbn:", "", _text(e)))) in (10, 13)), None)
    meta = {"title": first("title"), "authors": authors or ["Unknown"], "isbn": isbn, "language": first("language"), "publisher": first("publisher"), "description": first("description")}
    items = {e.get("id"): e for e in _all(package, "item")}
    where = lambda e: posixpath.normpath(posixpath.join(base, unquote(e.get("href"))))
    toc: dict[str, tuple[str, ...]] = {}
    nav = next((e for e in items.values() if "nav" in (e.get("properties") or "").split()), None)
    ncx = next((e for e in items.values() if e.get("media-type") == "application/x-dtbncx+xml"), None)
    for item, read in ((nav, _nav), (ncx, _ncx)):
        if item is not None and not toc:
            toc = read(ET.fromstring(book.read(where(item))), posixpath.dirname(where(item)))
    meta["structure_source"] = "toc" if toc else "inferred"
    blocks: list[tuple] = []
    for ref in _all(package, "itemref"):
        item = items.get(ref.get("idref"))
        if item is None or where(item) not in book.namelist():
            continue
        href, page = where(item), book.read(where(item)).decode("utf-8", "replace")
        path, anchors = _places(toc, href)
        found = html_blocks(page, path, anchors)
        if not path and not any(p for _, _, p, _ in found):
            found = html_blocks(page, (matter_label(href),))
        blocks += [(content, kind, where_, language, href) for content, kind, where_, language in found]
    return meta, blocks
