"""A library as users call it: add, list, search, read, edit, back up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import catalog, chunker, context, embedding, intake
from foliant.plans import search as plans
from foliant.sources import files
from foliant.sources.store import Store, export_paths


class Library:
    def __init__(self, spark: SparkSession, root: str, provider: embedding.Provider | None = None):
        self.store, self.provider, self.spark = Store(spark, root), provider, spark

    @property
    def tables(self) -> plans.Library:
        return plans.Library(self.store.read("books"), self.store.read("chunks"), self.store.read("vectors"))

    def add(self, folder: str, policy: str = "reject", collection: str | None = None) -> DataFrame:
        """Take in all files of a folder; one row (path, status, reason, book_id) a file.

        Chunks are stored before vectors are asked for, so a failing provider
        leaves books without vectors and not half-stored ones.
        """
        if policy not in ("reject", "skip", "replace"):
            raise ValueError(f"unknown policy: {policy}")
        parsed = files.read_folder(self.spark, folder)
        hashes = intake.content_hash(files.blocks(parsed))
        old = self.store.read("books")
        ranked = parsed.join(hashes, "book_id", "left")
        twins = intake.first_twins(ranked, old.select("file_hash", "content_hash", "book_id", "added_at"))
        status = intake.intake_status(policy)
        rows = twins.withColumns({"exists": F.lit(True), "suffix": F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)), "parsed": F.col("status") == "parsed"}).withColumn("outcome", status)
        first = rows.groupBy("file_hash").agg(F.min("path").alias("path"))
        new = rows.where(F.col("outcome").isin("added", "replaced")).join(first, ["file_hash", "path"], "left_semi")
        books = new.select(
            F.coalesce("byte_twin", "text_twin", "book_id").alias("book_id"), "title", "authors", "isbn", "file_hash", "content_hash", F.col("path").alias("file_path"),
            F.lit(collection).cast("string").alias("collection"), F.current_timestamp().alias("added_at"), F.lit("toc").alias("structure_source"),
        )
        blocks = new.select(F.coalesce("byte_twin", "text_twin", "book_id").alias("book_id"), F.inline("blocks"))
        report = rows.select("path", F.col("outcome").alias("status"), "reason", "book_id").collect()  # one row a file
        ids = [r[0] for r in books.select("book_id").collect()]
        if ids:
            self.store.add(books, chunker.linked(chunker.chunk(blocks)))
            self.embed(ids)
        return self.spark.createDataFrame(report, "path string, status string, reason string, book_id string")

    def embed(self, book_ids: list[str]) -> int:
        """Vectors of the given books; 0 without a provider."""
        if self.provider is None or not book_ids:
            return 0
        chunks = self.store.read("chunks").where(F.col("book_id").isin(book_ids))
        made = embedding.embed(chunks, self.provider).join(chunks.select("chunk_id", "book_id", "content_type", F.array_join("section_path", " > ").alias("section_path"), "sequence"), "chunk_id")
        rest = self.store.read("vectors").where(~F.col("book_id").isin(book_ids))
        self.store.write(vectors=rest.unionByName(made.select(*rest.columns)))
        return self.store.read("vectors").where(F.col("book_id").isin(book_ids)).count()

    def reindex(self) -> DataFrame:
        """Embed all books in library order; the first failure stops, and the rest count as skipped."""
        rows, failed = [], False
        for r in catalog.listed(self.store.read("books")).orderBy("place").collect():
            if failed:
                rows.append((r["book_id"], "skipped", None))
                continue
            try:
                self.embed([r["book_id"]])
                rows.append((r["book_id"], "success", None))
            except Exception as e:  # the report tells what went wrong
                failed = True
                rows.append((r["book_id"], "partial", str(e).splitlines()[0][:300]))
        return self.spark.createDataFrame(rows, "book_id string, status string, reason string")

    def list(self, collection: str | None = None) -> DataFrame:
        books = self.store.read("books")
        return catalog.listed(books.where(F.col("collection") == collection) if collection else books).orderBy("place")

    def search(self, query: str, vector: Sequence[float] | None = None, **options) -> plans.SearchResponse:
        if vector is None and self.provider is not None and query.strip() and options.get("mode", "hybrid") != "keyword":
            vector = self.provider.embed([query])[0]
        return plans.search(self.tables, query, vector, **options)

    def structure(self, book_id: str) -> DataFrame:
        return context.outline_lines(context.outline(self.store.read("chunks"), book_id))

    def read(self, book_id: str, start: int, end: int) -> DataFrame:
        return context.read_range(self.store.read("chunks"), book_id, start, end)

    def update(self, book_id: str, **changes: str | None) -> None:
        self.store.write(books=intake.update_metadata(self.store.read("books"), book_id, **changes))

    def remove(self, book_id: str) -> bool:
        return self.store.remove(book_id)

    def export(self, folder: str) -> int:
        return export_paths(self.store.read("books"), folder)

    def backup(self, folder: str) -> dict:
        return self.store.backup(folder)

    def restore(self, folder: str, force: bool = False) -> dict:
        return self.store.restore(folder, force)
