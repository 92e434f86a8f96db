"""Metadata from lookup tables, as a bibliographic service would answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import isbn_13, isbn_clean, plain_name

FIELDS = ("title", "authors", "publisher", "year", "description")


def _key(title: Column, authors: Column) -> Column:
    """Title without its subtitle, and the first author."""
    return F.concat_ws("|", plain_name(F.split(title, ":")[0]), plain_name(F.element_at(authors, 1)))


def enrich(books: DataFrame, *sources: DataFrame) -> DataFrame:
    """books with the empty fields filled from the sources, the first that knows a book first.

    A source is matched by ISBN, else by title and first author; a missing
    description is filled from a later source.  `source` numbers the first
    match.  Sources are shuffled by key like the books: both may be large.
    """
    out = books.withColumns({"_isbn": isbn_13(isbn_clean(F.col("isbn"))), "_key": _key(F.col("title"), F.col("authors"))})
    found: list[dict[str, Column]] = []
    for i, source in enumerate(sources):
        fields = F.struct(*(F.col(f) for f in FIELDS))
        by_isbn = source.select(isbn_13(isbn_clean(F.col("isbn"))).alias("_isbn"), fields.alias("f")).where("_isbn is not null").groupBy("_isbn").agg(F.min("f").alias(f"_i{i}"))
        by_key = source.select(_key(F.col("title"), F.col("authors")).alias("_key"), fields.alias("f")).groupBy("_key").agg(F.min("f").alias(f"_k{i}"))
        out = out.join(by_isbn, "_isbn", "left").join(by_key, "_key", "left")
        found.append({f: F.coalesce(F.col(f"_i{i}")[f], F.col(f"_k{i}")[f]) for f in FIELDS})
    hit = [F.col(f"_i{i}").isNotNull() | F.col(f"_k{i}").isNotNull() for i in range(len(sources))]
    first = F.coalesce(*(F.when(h, F.lit(i)) for i, h in enumerate(hit))) if hit else F.lit(None).cast("int")
    filled = {f: F.coalesce(F.col(f), *(x[f] for x in found)) for f in FIELDS if f in books.columns}
    return out.withColumns(filled | {"source": first}).drop("_isbn", "_key", *(f"_{x}{i}" for i in range(len(sources)) for x in "ik"))
