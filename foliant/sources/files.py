"""Files to books and blocks: one Arrow pass over binaryFile rows."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.docx import parse_docx
from foliant.sources.epub import parse_epub

PARSERS = {".epub": parse_epub, ".docx": parse_docx}
SCHEMA = (
    "path string, status string, reason string, book_id string, title string, authors array<string>, isbn string, file_hash string, "
    "blocks array<struct<block_index:int,content:string,content_type:string,section_path:array<string>,language:string,source_file:string>>"
)


def parse_file(path: str, data: bytes) -> dict:
    """A book with its blocks, or the reason why there is none.  PDF needs a parser in PARSERS."""
    suffix = posixpath.splitext(path)[1].lower()
    out = {"path": path, "status": "parsed", "reason": None, "book_id": None, "title": None, "authors": [], "isbn": None, "file_hash": sha256(data).hexdigest(), "blocks": []}
    if suffix not in PARSERS:
        return out | {"status": "unsupported", "reason": f"no parser for {suffix or 'files without suffix'}"}
    try:
        meta, blocks = PARSERS[suffix](data)
    except Exception as e:  # a broken file is an outcome, not an end of the job
        return out | {"status": "parse_failed", "reason": f"{type(e).__name__}: {e}"}
    title = meta.get("title") or posixpath.splitext(posixpath.basename(path))[0]
    authors = meta.get("authors") or ["Unknown"]
    key = sha256(data + title.encode() + authors[0].encode()).hexdigest()[:6]
    rows = [{"block_index": i, "content": c, "content_type": k, "section_path": list(p), "language": lang, "source_file": f} for i, (c, k, p, lang, f) in enumerate(blocks)]
    return out | {"book_id": key, "title": title, "authors": authors, "isbn": meta.get("isbn"), "blocks": rows}


def parse(files: DataFrame) -> DataFrame:
    """Parsed rows of (path, content) files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in batch.itertuples(index=False):
                yield pd.DataFrame([parse_file(path, bytes(data))])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a folder, parsed."""
    return parse(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def blocks(parsed: DataFrame) -> DataFrame:
    """Blocks of the parsed books, one a row."""
    return parsed.where("status = 'parsed'").select("book_id", F.inline("blocks"))
