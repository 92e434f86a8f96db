"""Page layout: operators on boxes of text, as a PDF reader would give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def furniture_key(text: Column) -> Column:
    """The text without numbers, lower case; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), "[0-9]+", "")), F.lit(""))


def without_furniture(boxes: DataFrame, reach: int = 3) -> DataFrame:
    """boxes (page, text, edge, and doc where there are several) without edge texts that recur on another page within `reach` pages.

    Only edge texts are shuffled.  They are compared by hash and page with the
    neighbouring pages' texts, not box by box.
    """
    doc = [c for c in ("doc",) if c in boxes.columns]
    keyed = boxes.withColumn("_key", F.sha2(furniture_key(F.col("text")), 256))
    pages = keyed.where("_key is not null").select(*doc, "_key", "page").distinct()
    near = pages.select(*doc, "_key", F.explode(F.array(*(F.col("page") + d for d in range(-reach, reach + 1) if d))).alias("page")).distinct()
    recurring = near.join(pages, [*doc, "_key", "page"], "left_semi").withColumn("_recurs", F.lit(True))
    return keyed.join(recurring, [*doc, "_key", "page"], "left").where(~(F.coalesce("_recurs", F.lit(False)) & F.col("edge"))).drop("_key", "_recurs")


def sections(boxes: DataFrame, marks: DataFrame) -> DataFrame:
    """boxes (page, y) with the title of the last mark (page, y, title) at or above them.

    Marks of a page are found by a join on the page; boxes above the first mark
    of their page take the last mark of an earlier page, found in a window over
    pages, of which there are few next to the boxes; with a column doc, documents
    are apart and spread the window.
    """
    doc = [c for c in ("doc",) if c in boxes.columns]
    per_page = marks.groupBy(*doc, "page").agg(F.sort_array(F.collect_list(F.struct("y", "title"))).alias("marks"))
    pages = boxes.select(*doc, "page").union(marks.select(*doc, "page")).distinct().join(per_page, [*doc, "page"], "left")
    before = F.last(F.element_at("marks", -1)["title"], ignorenulls=True).over(Window.partitionBy(*doc).orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    pages = pages.withColumn("carried", before)
    joined = boxes.join(pages, [*doc, "page"], "left")
    own = F.filter("marks", lambda m: m["y"] <= F.col("y"))
    title = F.when(F.size(own) > 0, F.element_at(own, -1)["title"]).otherwise(F.col("carried"))
    return joined.withColumn("title", title).drop("marks", "carried")


def listing_line(x0: Column, left: Column, width: Column, text: Column) -> Column:
    """A line of code with the spaces that its place on the page stands for."""
    return F.concat(F.repeat(F.lit(" "), F.round((x0 - left) / width).cast("int")), text)


def listing(lines: DataFrame) -> DataFrame:
    """(listing, text) of rows (listing, line, x0, width, text)."""
    g = lines.groupBy("listing").agg(F.min("x0").alias("left"), F.median("width").alias("w"), F.sort_array(F.collect_list(F.struct("line", "x0", "text"))).alias("ls"))
    return g.select("listing", F.array_join(F.transform("ls", lambda r: listing_line(r["x0"], F.col("left"), F.col("w"), r["text"])), "\n").alias("text"))


def heading_size(boxes: DataFrame) -> DataFrame:
    """(doc, size): of the sizes above the body's that at least two headings share, the largest."""
    n = boxes.where("heading").groupBy("doc", "size").agg(F.count(F.lit(1)).alias("n"))
    return n.where("n > 1").groupBy("doc").agg(F.max("size").alias("size"))
