"""HTML to typed blocks with their section path."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

CONTAINERS = frozenset("article aside blockquote body dd details div dl dt figcaption figure footer header html li main nav ol p section summary table tbody td th thead tr ul".split())
SKIPPED = frozenset(("script", "style", "head", "title", "template", "noscript"))
_SPACE = re.compile(r"\s+")
_LANG = re.compile(r"\b(?:language|lang)-([\w+#]+)", re.I)
_MATH = re.compile(r"\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\\begin\{", re.S)
_BOX = re.compile(r"[─-╿|+\-=<>/\\^v*#]")


def is_drawing(text: str) -> bool:
    drawn = len(_BOX.findall(text))
    return len(text) >= 20 and text.strip().count("\n") >= 1 and drawn > 5 and drawn / len(text) > 0.15


class Blocks(HTMLParser):
    """Blocks as (content, kind, path, language); headings give the path below `base`.

    From an element with an id in `anchors` on, that path is the base.
    """

    def __init__(self, base: tuple[str, ...] = (), anchors: dict[str, tuple[str, ...]] | None = None):
        super().__init__(convert_charrefs=True)
        self.base, self.headings, self.out = base, [], []
        self.anchors = anchors or {}
        self.text: list[str] = []
        self.skip = self.pre = self.math = 0
        self.heading: int | None = None
        self.rows: list[list[str]] | None = None
        self.language: str | None = None

    @property
    def path(self) -> tuple[str, ...]:
        """The base and the headings; a heading that repeats the end of the base counts once."""
        below = tuple(x for _, x in self.headings)
        return self.base + below[bool(self.base and below and below[0].lower() == self.base[-1].lower()) :]

    def emit(self) -> None:
        raw = "".join(self.text)
        self.text.clear()
        if self.pre:
            if raw.strip():
                self.out.append((raw.strip("\n"), "code", self.path, self.language))
            return
        text = _SPACE.sub(" ", raw).strip()
        if not text:
            return
        if self.heading:
            self.headings = [h for h in self.headings if h[0] < self.heading] + [(self.heading, text)]
        kind = "math" if self.math or _MATH.search(text) else "diagram" if is_drawing(raw) else "text"
        self.out.append((raw.strip("\n") if kind == "diagram" else text, kind, self.path, None))

    def handle_starttag(self, tag, attrs):
        here = next((v for k, v in attrs if k in ("id", "name") and v in self.anchors), None)
        if here is not None and not self.skip:
            if self.rows is None and not self.pre:
                self.emit()
            self.base, self.headings = self.anchors[here], []
        if tag in SKIPPED:
            self.skip += 1
        elif self.rows is not None:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                self.text.clear()
        elif tag == "table" and not self.pre:
            self.emit()
            self.rows = []
        elif tag == "pre":
            self.emit()
            self.pre += 1
            found = _LANG.search(" ".join(v or "" for _, v in attrs))
            self.language = found[1].lower() if found else None
        elif tag == "code" and self.pre:
            found = _LANG.search(" ".join(v or "" for _, v in attrs))
            self.language = found[1].lower() if found else self.language
        elif re.fullmatch("h[1-6]", tag):
            self.emit()
            self.heading = int(tag[1])
        elif tag == "math":
            self.math += 1
        elif tag == "br":
            self.text.append("\n")
        elif tag in CONTAINERS and not self.pre:
            self.emit()

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.rows is not None:
            if tag in ("td", "th"):
                if not self.rows:
                    self.rows.append([])
                self.rows[-1].append(_SPACE.sub(" ", "".join(self.text)).strip())
                self.text.clear()
            elif tag == "table":
                rows, self.rows = [r for r in self.rows if any(r)], None
                lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in rows]
                if lines:
                    lines.insert(1, "| " + " | ".join("-" * max(3, len(c)) for c in rows[0]) + " |")
                    self.out.append(("\n".join(lines), "table", self.path, None))
                self.text.clear()
        elif tag == "pre" and self.pre:
            self.emit()
            self.pre, self.language = self.pre - 1, None
        elif re.fullmatch("h[1-6]", tag):
            self.emit()
            self.heading = None
        elif tag == "math":
            self.math = max(0, self.math - 1)
        elif tag in CONTAINERS and not self.pre:
            self.emit()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)

    def close(self):
        super().close()
        if self.rows is None:
            self.emit()


def html_blocks(page: str | None, base: tuple[str, ...] = (), anchors: dict[str, tuple[str, ...]] | None = None) -> list[tuple[str, str, tuple[str, ...], str | None]]:
    parser = Blocks(base, anchors)
    parser.feed(page or "")
    parser.close()
    return parser.out


SCHEMA = "source_file string, block_index int, content string, content_type string, section_path array<string>, language string"


def extract(pages: DataFrame) -> DataFrame:
    """Blocks of (source_file, html) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, i, c, k, list(p), lang) for s, h in batch.itertuples(index=False) for i, (c, k, p, lang) in enumerate(html_blocks(h))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return pages.select("source_file", "html").mapInPandas(run, SCHEMA)
