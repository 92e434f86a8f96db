"""Blocks to chunks of bounded size.

The rules look back at the last chunk, so a book is a fold.  Each book's
blocks stream through Python in order, sorted by Spark; no more than one open
chunk is held, so a book may be of any length.  Ids are hashes of book, place
and content: a task that runs twice makes the same ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ATOMIC = frozenset(("code", "diagram", "math", "table"))
# Fixed values of the sizing rules.
TINY_TOKENS, LEAD_IN_TOKENS, MIN_FLOOR, MAX_CEILING = 20, 50, 100, 2000

_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE_END = re.compile(r"[.!?]\s+")


def count_tokens(text: str) -> int:
    """Words and punctuation marks."""
    return sum(1 for _ in _TOKEN.finditer(text))


def truncate(text: str, n: int) -> str:
    """The first n tokens, as they stand in the text."""
    for i, m in enumerate(_TOKEN.finditer(text), 1):
        if i == n:
            return text[: m.end()] if n else ""
    return text if n else ""


@dataclass(frozen=True)
class Sizes:
    least: int = 400
    most: int = 800
    overlap: int = 50

    def __post_init__(self) -> None:
        if self.least < MIN_FLOOR:
            raise ValueError(f"least must be {MIN_FLOOR} or more")
        if not MIN_FLOOR < self.most <= MAX_CEILING:
            raise ValueError(f"most must be over {MIN_FLOOR} and at most {MAX_CEILING}")
        if self.least >= self.most:
            raise ValueError("least must be below most")


def split(text: str, most: int, overlap: int) -> list[str]:
    """Parts of at most `most` tokens, each starting up to `overlap` tokens before the last one's end.

    A part ends after the last sentence in its second half, else at a space.
    """
    marks = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    overlap, at, out = min(overlap, most // 2), 0, []
    while at < len(marks):
        stop = min(at + most, len(marks))
        begin, end = marks[at][0], marks[stop - 1][1]
        if stop < len(marks):
            half = begin + (end - begin) // 2
            ends = [m.start() + 1 for m in _SENTENCE_END.finditer(text, half, end)]
            space = text.rfind(" ", half, end)
            end = ends[-1] if ends else space if space > begin else end
            stop = max(at + 1, next(i for i in range(stop, at, -1) if marks[i - 1][1] <= end or i == at + 1))
        if part := text[begin : max(end, marks[stop - 1][1])].strip():
            out.append(part)
        if stop >= len(marks):
            break
        at = max(at + 1, stop - overlap)
    return out


@dataclass
class Draft:
    content: str
    kind: str
    language: str | None
    path: tuple[str, ...]
    sections: list[str]
    tokens: int
    whole: bool = False
    lead_in: int = 0


class Fold:
    """Takes blocks in order and gives finished chunks; only the last one is open."""

    def __init__(self, sizes: Sizes, count: Callable[[str], int] = count_tokens):
        self.sizes, self.count, self.open = sizes, count, None

    def add(self, content: str, kind: str, language: str | None, path: tuple[str, ...]) -> Iterator[Draft]:
        if not content.strip():
            return
        drafts = self._drafts(content, kind, language, path)
        last = self.open
        if last is not None and kind not in ATOMIC and not last.whole and self._within(last, path) and last.tokens < self.sizes.least:
            together = f"{last.content}\n\n{content}"
            if self.count(together) > self.sizes.most:
                if self.count(content) <= self.sizes.most:
                    drafts = [self._join(last, drafts[0])]
                else:  # the block is cut anyway, so its lead is cut with it
                    drafts = self._drafts(together, kind, language, path)
                    drafts[0].sections = list(dict.fromkeys(last.sections + drafts[0].sections))
                self.open = None
                yield from self._push(drafts)
                return
        for draft in drafts:
            if self.open is not None and self._joins(self.open, draft):
                self.open = self._join(self.open, draft)
            else:
                yield from self._push([draft])

    def end(self) -> Iterator[Draft]:
        if self.open is not None:
            yield self.open
        self.open = None

    def _push(self, drafts: list[Draft]) -> Iterator[Draft]:
        for draft in drafts:
            if self.open is not None:
                yield self.open
            self.open = draft

    def _drafts(self, content: str, kind: str, language: str | None, path: tuple[str, ...]) -> list[Draft]:
        n = self.count(content)
        base = Draft(content, kind, language, path, [path[-1]] if path else [], n)
        if kind in ATOMIC:
            return [replace(base, whole=n >= TINY_TOKENS and "\n" in content.strip())]
        if n <= self.sizes.most:
            return [base]
        return [replace(base, content=p, tokens=self.count(p), sections=list(base.sections)) for p in split(content, self.sizes.most, self.sizes.overlap)]

    @staticmethod
    def _within(last: Draft, path: tuple[str, ...]) -> bool:
        return path[: len(last.path)] == last.path

    def _joins(self, last: Draft, new: Draft) -> bool:
        if last.whole or not self._within(last, new.path):
            return False
        if new.whole:
            return last.tokens <= LEAD_IN_TOKENS
        small = last.tokens < self.sizes.least or (last.path == new.path and new.tokens < self.sizes.least)
        return small and self.count(f"{last.content}\n\n{new.content}") <= self.sizes.most

    def _join(self, last: Draft, new: Draft) -> Draft:
        content = f"{last.content}\n\n{new.content}"
        kind, language = "text", None
        if new.whole:
            kind, language = new.kind, new.language
        elif last.kind == new.kind:
            kind, language = last.kind, last.language or new.language
        lead = len(last.content) if new.whole and last.kind == "text" else 0
        return Draft(content, kind, language, new.path, list(dict.fromkeys(last.sections + new.sections)), self.count(content), new.whole, lead)


CHUNKED = "chunk_id string, book_id string, content string, content_type string, token_count int, section_path array<string>, sections array<string>, language string, sequence int, lead_in int"


def chunk(blocks: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks of (book_id, block_index, content, content_type, section_path, language) rows.

    Books are dealt by id and sorted inside their partition; a book's blocks
    pass one by one, so even the longest book needs little memory.
    """
    columns = ["book_id", "block_index", "content", "content_type", "section_path", "language"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, fold, place = None, Fold(sizes), 0
        out: list[tuple] = []

        def row(d: Draft) -> None:
            nonlocal place
            key = sha256("\0".join((str(book), str(place), d.content)).encode()).hexdigest()
            out.append((key, book, d.content, d.kind, d.tokens, list(d.path), d.sections, d.language, place, d.lead_in))
            place += 1

        names = [x.split()[0] for x in CHUNKED.split(", ")]
        for batch in batches:
            for b, _, content, kind, path, language in batch.itertuples(index=False):
                if b != book:
                    for d in fold.end():
                        row(d)
                    book, place = b, 0
                for d in fold.add(content or "", kind, language, tuple(path if path is not None else ())):
                    row(d)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        for d in fold.end():
            row(d)
        if out:
            yield pd.DataFrame(out, columns=names)

    dealt = blocks.select(*columns).repartition("book_id").sortWithinPartitions("book_id", "block_index")
    return dealt.mapInPandas(run, CHUNKED)


def linked(chunks: DataFrame) -> DataFrame:
    """chunks with prev_chunk_id and next_chunk_id."""
    w = Window.partitionBy("book_id").orderBy("sequence")
    return chunks.withColumns({"prev_chunk_id": F.lag("chunk_id").over(w), "next_chunk_id": F.lead("chunk_id").over(w)})
