"""Quality rules as a short-circuit cascade.

A rule rejects a document on features of its text.  ``plan_cascade`` runs every
rule on a sample, measures what it costs and what share it rejects, and sorts
the rules by rejection per cost; ``apply_cascade`` then stops at a document's
first rejecting rule, so costly features of most bad documents are never
computed.  The order changes the cost only: the verdict is that of all rules.

Nulls: a null text is a text without words.  Repeated rows are judged alike.
Empty tables give empty results.  Rules of equal rejection per cost run cheapest
first, and at a tie in their given order.  Other columns are ignored, whatever
they are called.  A text of any length is read whole, one row at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import WORD, map_rows

SYMBOLS = "#*$%&|<>"
_NOT_SYMBOL = str.maketrans("", "", SYMBOLS)
_LETTER = regex.compile(r"\p{L}")
_UPPER = regex.compile(r"\p{Lu}")
_BULLET = regex.compile(r"(?m)^[ \t]*[-*•]")
_ELLIPSIS = regex.compile(r"(?m)(\.\.\.|…)[ \t]*$")


def repeated_window_words(ids: np.ndarray, width: int = 8) -> int:
    """Words in windows of `width` (a power of two) ids that occur twice or more.

    Ranks of windows double in width: equal rank means equal window, exactly.
    """
    if len(ids) < width + 1:
        return 0
    ranks, w = ids.astype(np.int64), 1
    while w < width:
        pairs = ranks[:-w] * (int(ranks.max()) + 1) + ranks[w:]
        values, ranks = np.unique(pairs, return_inverse=True)
        if len(values) == len(pairs):
            return 0
        w *= 2
    twice = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Doc:
    """Features of a text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(_NOT_SYMBOL))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if WORD.search(x)]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        seen: dict[str, int] = {}
        return repeated_window_words(np.array([seen.setdefault(w, len(seen)) for w in self.words], np.int64))

    @cached_property
    def n_letters(self) -> int:
        return len(_LETTER.findall(self.text))

    @cached_property
    def n_upper(self) -> int:
        return len(_UPPER.findall(self.text))

    @cached_property
    def n_letter_words(self) -> int:
        return sum(_LETTER.search(w) is not None for w in self.words)

    @cached_property
    def n_bullets(self) -> int:
        return len(_BULLET.findall(self.text))

    @cached_property
    def n_ellipses(self) -> int:
        return len(_ELLIPSIS.findall(self.text))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


#: What the contract calls base.
BASE_RULES = (
    Rule("too_short", lambda d: d.n_words < 20),
    Rule("repetition", lambda d: 100 * d.n_repeat_words > 30 * d.n_words),
)

#: Web-text rules in whole numbers, so any engine gets the same verdicts.
METHOD_RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("short_words", lambda d: 2 * d.word_chars < 5 * d.n_words),
    Rule("long_words", lambda d: d.word_chars > 15 * d.n_words),
    Rule("duplicate_lines", lambda d: 100 * d.n_dup_lines > 30 * d.n_lines),
    Rule("upper_case", lambda d: 2 * d.n_upper > d.n_letters),
    Rule("no_letters", lambda d: 100 * d.n_letter_words < 80 * d.n_words),
    Rule("bullets", lambda d: 100 * d.n_bullets > 90 * d.n_lines),
    Rule("ellipses", lambda d: 100 * d.n_ellipses > 30 * d.n_lines),
)


@dataclass(frozen=True)
class Cascade:
    rules: tuple[Rule, ...]
    #: (name, seconds a document, share rejected), in the order of `rules`.
    estimates: tuple[tuple[str, float, float], ...]


def plan_cascade(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = METHOD_RULES, sample_rows: int = 400, emit: tuple[str, ...] = ()) -> Cascade:
    """Order the rules by rejection per cost, estimated on at most sample_rows rows.

    The sample is a tenth of the rows of as few partitions as give enough; it
    settles the order alone, never a verdict.  One task reads it and the driver
    gets the sums.  Features in `emit` are computed anyway and cost a rule nothing.
    """

    def measure(batches):
        for batch in batches:
            texts = batch.column(0)
            for i, rule in enumerate(rules):
                cost = hits = 0
                for at in range(batch.num_rows):  # one text at a time
                    doc = Doc(texts[at].as_py())
                    for x in emit:
                        getattr(doc, x)
                    began = time.perf_counter()
                    hits += rule.rejects(doc)
                    cost += time.perf_counter() - began
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([float(cost)]), pa.array([int(hits)], pa.int64()), pa.array([batch.num_rows], pa.int64())], ["rule", "cost", "hits", "n"])

    sample = df.select(text_col).sample(0.1, seed=7).limit(sample_rows)
    sums = sample.mapInArrow(measure, "rule int, cost double, hits long, n long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    found = {r["rule"]: (max(r["cost"], 1e-9) / r["n"], r["hits"] / r["n"]) for r in sums.collect()}
    seen = [(rule, *found.get(i, (1e-9, 0.0))) for i, rule in enumerate(rules)]
    seen.sort(key=lambda x: (-x[2] / x[1], x[1]))
    return Cascade(tuple(x[0] for x in seen), tuple((r.name, c, s) for r, c, s in seen))


def first_rejection(doc: Doc, rules: tuple[Rule, ...]) -> str | None:
    return next((r.name for r in rules if r.rejects(doc)), None)


def apply_cascade(
    df: DataFrame,
    cascade: Cascade,
    gate: tuple[Rule, ...] = (),
    emit: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: id, the `emit` features (long), gate_failed, rejected_by, kept.

    `gate` rules run first and in their own order.  Features in `emit` are
    computed for every document, the others only as far as the cascade gets.
    """
    fields = [T.StructField("doc_id", df.schema[id_col].dataType)]
    fields += [T.StructField(x, T.LongType()) for x in emit]
    fields += [T.StructField("gate_failed", T.BooleanType()), T.StructField("rejected_by", T.StringType()), T.StructField("kept", T.BooleanType())]

    def make():
        def judge(key, text):
            doc = Doc(text)
            gated = first_rejection(doc, gate)
            why = gated or first_rejection(doc, cascade.rules)
            return (key, *(getattr(doc, x) for x in emit), gated is not None, why, why is None)

        return judge

    return map_rows(df, [F.col(id_col), F.col(text_col)], make, T.StructType(fields))
