"""Keyword search: query words, BM25 and match rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import SEPARATORS, STOPWORDS, fold, tokens, tokens_py

K1, B, RRF_K = 1.2, 0.75, 60

#: A character inside a token.
_IN = r"[\p{L}\p{N}\p{Co}]"


def query_words(query: str) -> list[str]:
    """The words that count: with a letter or digit, and no stopwords unless there is nothing else."""
    words = [w for w in query.split() if any(c.isalnum() for c in w)]
    return [w for w in words if w.lower() not in STOPWORDS] or words


@dataclass(frozen=True)
class Phrase:
    """A query word as the index splits it; several tokens must follow each other."""

    tokens: tuple[str, ...]

    def count(self, folded: Column) -> Column:
        """Places in a folded text where the tokens follow each other.  Tokens are letters and digits, so they need no escapes."""
        first, *rest = self.tokens
        after = "".join(f"{SEPARATORS}{t}" for t in rest)
        pattern = f"(?<!{_IN}){first}(?={after}(?!{_IN}))"
        every = F.lit(True)
        for t in self.tokens:
            every = every & folded.contains(t)
        return F.when(every, F.regexp_count(folded, F.lit(pattern))).otherwise(F.lit(0))

    def possible(self, folded: Column) -> Column:
        return folded.contains(self.tokens[0])


def phrases(query: str) -> list[Phrase]:
    return [Phrase(tuple(t)) for w in query_words(query) if (t := tokens_py(w))]


def bm25(chunks: DataFrame, query: str, match_all: bool = False, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(chunk_id, bm25) of the chunks that match any term, or all of them."""
    return scored(chunks, query, match_all, id_col, text_col).select(id_col, "bm25")


def scored(chunks: DataFrame, query: str, match_all: bool = False, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(chunk_id, bm25, every) of the chunks that match; `every` tells which have all terms, and statistics cover all of `chunks`.

    Terms are counted inside the scan and only numbers leave it: one row of
    statistics is broadcast back, so nothing is shuffled however large the
    library.  The second scan counts only in texts that hold a term at all.
    """
    terms = phrases(query)
    if not terms:
        return chunks.select(id_col, F.lit(0.0).alias("bm25"), F.lit(True).alias("every")).limit(0)
    folded = fold(F.col(text_col))

    def numbers(t: Column) -> Column:
        return F.struct(F.regexp_count(t, F.lit(f"{_IN}++")).alias("dl"), *(p.count(t).alias(f"tf{i}") for i, p in enumerate(terms)))

    def possible(t: Column) -> Column:
        some = terms[0].possible(t)
        for p in terms[1:]:
            some = some & p.possible(t) if match_all else some | p.possible(t)
        return some

    # As a lambda's argument a text is folded once, and the generator keeps filters above it: below, a filter would fold for each term.
    counted = chunks.select(id_col, F.explode(F.transform(F.array(folded), lambda t: F.when(possible(t), numbers(t)))).alias("c")).where("c is not null").select(id_col, "c.*")
    stats = chunks.select(F.explode(F.transform(F.array(folded), numbers)).alias("c")).select("c.*").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms)))
    )
    hit = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    every, any_ = hit[0], hit[0]
    for h in hit[1:]:
        every, any_ = every & h, any_ | h

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    total = part(0)
    for i in range(1, len(terms)):
        total = total + part(i)
    found = counted.where(every if match_all else any_).crossJoin(F.broadcast(stats))  # one row
    return found.select(id_col, F.round(total, 9).alias("bm25"), every.alias("every"))


def ranked(hits: DataFrame, limit: int, id_col: str = "chunk_id") -> DataFrame:
    """The best hits with kw_rank from 1; equal scores go by id.  The window sees `limit` rows."""
    best = hits.orderBy(F.desc("bm25"), id_col).limit(limit)
    return best.withColumn("kw_rank", F.row_number().over(Window.orderBy(F.desc("bm25"), id_col)))


def ranked_both(hits: DataFrame, limit: int, id_col: str = "chunk_id") -> DataFrame:
    """The best of scored hits by any term and by every term, from one pass.

    kw_rank is the place among all hits, null beyond `limit`.  Tasks cut each
    kind to `limit` rows before they are shuffled.
    """
    by = [F.desc("bm25"), F.col(id_col)]
    best = hits.withColumn("_place", F.row_number().over(Window.partitionBy("every").orderBy(*by))).where(F.col("_place") <= limit).drop("_place")
    place = F.row_number().over(Window.orderBy(*by))  # over twice the limit
    return best.withColumn("_place", place).withColumn("kw_rank", F.when(F.col("_place") <= limit, F.col("_place"))).drop("_place")


def rank_score(rank: Column) -> Column:
    """Score of a rank in a keyword-only search: the first is 1."""
    return F.lit(RRF_K + 1.0) / (RRF_K + rank)


def document_frequency(chunks: DataFrame, text_col: str = "content") -> DataFrame:
    """(term, n_chunks) of the whole vocabulary; counts combine before the shuffle."""
    each = chunks.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"))
