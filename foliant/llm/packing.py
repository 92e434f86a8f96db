"""Best-fit packing by minimum bin slack.

Lengths are whole numbers up to the capacity, so the multiset of all pieces is
a histogram of at most `capacity` counts, however many documents there are.
``plan_bins`` works on that histogram: it takes the longest length left, finds
by a bitset subset-sum over the available lengths the fullest feasible
combination with it, removes that combination as often as its counts allow,
and repeats.  Each combination claims ranges of ranks of its lengths, and
``assign`` gives every piece the place of its rank in a join with those ranges.

Nulls: a null text is an empty one (its piece is the end id alone).  Repeated
rows are packed apart.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import materialise
from foliant.llm.tokens import encode_documents


@dataclass(frozen=True)
class Combination:
    #: (length, times in one bin), longest first.
    uses: tuple[tuple[int, int], ...]
    bins: int


def fullest(counts: dict[int, int], room: int) -> Counter:
    """The lengths, each at most its count times, whose sum comes closest to room from below."""
    reached, layers, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... copies at once give every number of copies
            part = min(part, left)
            layers.append((length, part, reached))
            reached |= (reached << (length * part)) & mask
            left, part = left - part, part * 2
            if reached >> room & 1:
                break
        if reached >> room & 1:
            break
    total, used = reached.bit_length() - 1, Counter()
    for length, part, before in reversed(layers):
        if not before >> total & 1:
            used[length] += part
            total -= length * part
    return used


def plan_bins(counts: dict[int, int], capacity: int) -> list[Combination]:
    """Combinations that use up all counts.

    Each one leaves fewer of some length than it takes itself, so there are at
    most a few for each length.
    """
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        seed = max(left)
        rest = left | {seed: left[seed] - 1}
        uses = fullest(rest, capacity - seed)
        uses[seed] += 1
        bins = min(left[x] // n for x, n in uses.items())
        out.append(Combination(tuple(sorted(uses.items(), reverse=True)), bins))
        for x, n in uses.items():
            left[x] -= n * bins
            if not left[x]:
                del left[x]
    return out


def ranges(plan: list[Combination]) -> list[tuple[int, int, int, int, list[int]]]:
    """(length, first rank, end rank, first bin, offsets in a bin) of every length in every combination."""
    out, taken, first_bin = [], Counter(), 0
    for c in plan:
        at = 0
        for length, n in c.uses:
            out.append((length, taken[length], taken[length] + n * c.bins, first_bin, [at + i * length for i in range(n)]))
            taken[length] += n * c.bins
            at += n * length
        first_bin += c.bins
    return out


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"


def cut_pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the documents' ids; only documents longer than capacity have several.

    `rank` counts the pieces of equal length before it in the same task.
    """

    def run(batches):
        part, ranks = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, ids in zip(batch.column(0).to_pylist(), encode_documents(batch.column(1).to_pylist(), tokenizer, end_id), strict=True):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    for values, v in zip(out, (key, k, at, len(piece), zlib.crc32(piece.tobytes()), part, ranks[len(piece)]), strict=True):
                        values.append(v)
                    ranks[len(piece)] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES)


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces with sequence_id and offset.  `pieces` must be a written table: ranks are read twice."""
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # One row for each task and length: no length is large here, however many pieces have it.
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = ranges(plan_bins(histogram, capacity))
    places = spark.createDataFrame(rows, "length int, lo long, hi long, first_bin long, offsets array<long>")
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    # `places` has a few rows for each of at most `capacity` lengths.
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & F.col("rank").between(F.col("lo"), F.col("hi") - 1)).drop(places["length"])
    at, per = F.col("rank") - F.col("lo"), F.size("offsets").cast("long")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("first_bin") + F.floor(at / per)).cast("long").alias("sequence_id"),
        F.element_at("offsets", (F.pmod(at, per) + 1).cast("int")).alias("offset"),
    )


def pack(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and place in it."""
    return assign(materialise(cut_pieces(df, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity)
