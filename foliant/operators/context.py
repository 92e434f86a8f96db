"""Context around hits, outlines and reading ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windows(hits: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """Hits (chunk_id, book_id, sequence, section_path, score) with start_seq and end_seq.

    A window reaches up to `window` chunks on either side, as far as chunks
    follow each other in the same section.  Hits are few, so their neighbours
    are found by an equi join on the wanted positions.
    """
    h = hits.select("chunk_id", "book_id", "sequence", "section_path", "score")
    wanted = h.select("chunk_id", "book_id", F.col("sequence").alias("s"), F.col("section_path").alias("p"), F.explode(F.sequence(F.greatest(F.col("sequence") - window, F.lit(0)), F.col("sequence") + window)).alias("sequence"))
    near = chunks.select("book_id", "sequence", F.col("section_path").alias("q")).join(F.broadcast(wanted), ["book_id", "sequence"])
    other = ~F.col("p").eqNullSafe(F.col("q"))
    edge = near.groupBy("chunk_id").agg(
        F.max(F.when(other & (F.col("sequence") < F.col("s")), F.col("sequence"))).alias("below"), F.min(F.when(other & (F.col("sequence") > F.col("s")), F.col("sequence"))).alias("above"),
        F.min("sequence").alias("lo"), F.max("sequence").alias("hi"),
    )
    start = F.coalesce(F.col("below") + 1, F.col("lo"))
    end = F.coalesce(F.col("above") - 1, F.col("hi"))
    return h.join(edge, "chunk_id").select("chunk_id", "book_id", "sequence", "score", start.alias("start_seq"), end.alias("end_seq"))


def merge_windows(expanded: DataFrame) -> DataFrame:
    """Windows of a book that overlap or touch become one, led by its best hit."""
    w = Window.partitionBy("book_id").orderBy("start_seq", "sequence")
    reach = F.max("end_seq").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = expanded.withColumn("new", F.coalesce((F.col("start_seq") > reach + 1).cast("int"), F.lit(1)))
    island = flagged.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lead = F.max(F.struct("score", (-F.col("sequence")).alias("m"), F.col("chunk_id").alias("id")))
    return island.groupBy("book_id", "island").agg(
        F.min("start_seq").alias("start_seq"), F.max("end_seq").alias("end_seq"), F.array_sort(F.collect_set("chunk_id")).alias("matched"), lead.alias("b")
    ).select("book_id", "start_seq", "end_seq", "matched", F.col("b.id").alias("chunk_id"), F.col("b.score").alias("score"))


def read_range(chunks: DataFrame, book_id: str, start: int, end: int, limit: int = 20) -> DataFrame:
    """Chunks of a book from start to end in reading order."""
    return chunks.where((F.col("book_id") == book_id) & F.col("sequence").between(max(0, start), end)).orderBy("sequence").limit(limit)


def outline(chunks: DataFrame, book_id: str | None = None) -> DataFrame:
    """(book_id, first, section_path) of each distinct non-empty path in reading order."""
    rows = chunks.where(F.size("section_path") > 0)
    if book_id:
        rows = rows.where(F.col("book_id") == book_id)
    return rows.groupBy("book_id", "section_path").agg(F.min("sequence").alias("first"))


def outline_lines(paths: DataFrame) -> DataFrame:
    """(book_id, first, depth, name) of an outline: only the parts of a path that the one before lacks.

    One row a section is windowed, not one a chunk.
    """
    before = F.lag("section_path").over(Window.partitionBy("book_id").orderBy("first"))
    shared = F.aggregate(
        F.zip_with("section_path", F.coalesce("before", F.array().cast("array<string>")), lambda a, b: a.eqNullSafe(b)),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda a, same: F.struct((a["n"] + (a["go"] & same).cast("int")).alias("n"), (a["go"] & same).alias("go")),
        lambda a: F.least(a["n"], F.size("section_path")),
    )
    lines = paths.withColumn("before", before).withColumn("shared", shared)
    return lines.select("book_id", "first", F.col("shared"), F.posexplode("section_path").alias("depth", "name")).where("depth >= shared").select("book_id", "first", "depth", "name")


def neighbours(chunks: DataFrame) -> DataFrame:
    """(chunk_id, prev_chunk_id, next_chunk_id) in reading order of each book."""
    w = Window.partitionBy("book_id").orderBy("sequence")
    return chunks.select("chunk_id", F.lag("chunk_id").over(w).alias("prev_chunk_id"), F.lead("chunk_id").over(w).alias("next_chunk_id"))
