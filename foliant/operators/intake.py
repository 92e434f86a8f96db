"""Intake: identity, duplicates, notes and metadata that is carried over."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import looks_like_file_name

MIN_HASHED_CHARS = 200
SIMILAR_TITLE = 0.8


def book_id(content: Column, title: Column, author: Column) -> Column:
    """First six hex digits of the hash of a file with its title and first author."""
    return F.substring(F.sha2(F.concat(content, F.encode(title, "utf-8"), F.encode(author, "utf-8")), 256), 1, 6)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def content_hash(blocks: DataFrame) -> DataFrame:
    """(book_id, content_hash) over types and texts in block order; null below 200 visible characters.

    A book's blocks come together in one row, as they do in the book itself.
    """
    rows = blocks.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("block_index", "content_type", "content"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: F.concat(x["content_type"], F.lit("\0"), x["content"], F.lit("\0"))), "")
    seen = F.length(F.regexp_replace(F.array_join("b.content", ""), r"(?U)\s", ""))
    return rows.select("book_id", F.when(seen >= MIN_HASHED_CHARS, F.sha2(text, 256)).alias("content_hash"))


def first_twins(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """Incoming files with `twin`: the oldest book with the same bytes, else with the same content.

    A row is matched by bytes before it is matched by content.
    """
    byte = library.groupBy("file_hash").agg(F.min_by("book_id", F.struct("added_at", "book_id")).alias("byte_twin"))
    text = library.where("content_hash is not null").groupBy("content_hash").agg(F.min_by("book_id", F.struct("added_at", "book_id")).alias("text_twin"))
    return incoming.join(byte, "file_hash", "left").join(text, "content_hash", "left")


def intake_status(policy: str = "reject") -> Column:
    """Status of a file with columns exists, suffix, parsed, byte_twin, text_twin."""
    if policy not in ("reject", "skip", "replace"):
        raise ValueError(f"unknown policy: {policy}")
    twin = F.when(F.col("byte_twin").isNotNull(), "duplicate").when(F.col("text_twin").isNotNull(), "duplicate_content")
    done = {"reject": twin, "skip": F.when(twin.isNotNull(), "skipped"), "replace": F.when(twin.isNotNull(), "replaced")}[policy]
    return F.when(~F.col("exists"), "not_found").when(~F.lower("suffix").isin(".epub", ".docx", ".pdf"), "unsupported").when(~F.col("parsed"), "parse_failed").otherwise(F.coalesce(done, F.lit("added")))


def carry_over(new: DataFrame, old: DataFrame, fields: list[str], force: bool = False) -> DataFrame:
    """A replaced book keeps its id and edited metadata; force takes the file's non-empty values."""
    kept = old.select(F.col("book_id").alias("twin"), *(F.col(f).alias(f"_{f}") for f in fields))
    joined = new.join(kept, "twin", "left")
    pick = {f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_{f}")) if force else F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}
    return joined.withColumns(pick).drop(*(f"_{f}" for f in fields))


def update_metadata(books: DataFrame, book_id: str, **changes: str | None) -> DataFrame:
    """books with the given fields of one book changed; an empty isbn or collection becomes null."""
    changes = {k: v for k, v in changes.items() if v is not None}
    if not changes:
        raise ValueError("nothing to update")
    here = F.col("book_id") == book_id
    value = lambda k, v: F.lit(None) if v == "" and k in ("isbn", "collection") else F.lit(v)
    return books.withColumns({k: F.when(here, value(k, v)).otherwise(F.col(k)) for k, v in changes.items()})


def remove_books(books: DataFrame, *dependents: DataFrame, removed: DataFrame) -> tuple[DataFrame, ...]:
    """The books and their dependent tables without the removed ids."""
    return tuple(t.join(removed.select("book_id").distinct(), "book_id", "left_anti") for t in (books, *dependents))


@F.pandas_udf(T.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks; Spark has edit distances only."""
    return pd.Series([SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)])


def similar_titles(books: DataFrame, title: str, least: float = SIMILAR_TITLE) -> DataFrame:
    """(book_id, title, ratio) of the titles like one given title.

    Lengths bound the ratio, so most titles never reach Python.
    """
    a, b = F.lit(len(title)), F.length("title")
    close = books.where(F.col("title").isNotNull() & (2 * F.least(a, b) >= least * (a + b)))
    return close.select("book_id", "title", F.round(title_ratio(F.lit(title), F.col("title")), 6).alias("ratio")).where(F.col("ratio") >= least)


def notes(title: Column, isbn_ok: Column, similar: Column, embedded: Column) -> Column:
    """Names of the remarks that apply to a stored book."""
    marks = F.array(
        F.when(similar, "similar_title"), F.when(~isbn_ok, "suspect_isbn"), F.when(looks_like_file_name(title), "file_name_title"), F.when(~embedded, "not_embedded")
    )
    return F.filter(marks, lambda x: x.isNotNull())
