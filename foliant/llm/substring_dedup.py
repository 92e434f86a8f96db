"""Substring dedup by hashing the lines, sentences and word windows of all documents.

Words are normalised: A-Z lower-cased, outer punctuation dropped, words of
punctuation alone skipped.  Two kinds of passages count as repeated:

    units      a sentence inside a line: it ends with the line, after a word
               that ends a sentence, or before a capitalised word
    windows    any `min_words` words in a row, wherever they start

A passage is hashed to 128 bits and hashes are grouped globally; the document
with the smallest id keeps its first occurrence and every other occurrence is
repeated.  A run of neighbouring repeated words with at least `min_words` words
is removed, so every passage of that many words is found wherever it is cut,
while short lines that many documents share stay.

Not all windows are shuffled.  The smallest hash of the shorter grams inside a
window is its anchor; equal windows have equal anchors.  Anchors (about one in
eleven words) are grouped first, along with the units, and only windows whose
anchor occurs twice are grouped after that, in one row for each anchor.  This
loses no repeated window.

The result has one row for each removed run with its offsets in the original
text (code points, end exclusive); ``cut`` removes them from the texts.

Nulls: null and empty texts have no words.  Rows with a null id are left
alone.  Rows that share an id count as one document for the ranking, so one
does not repeat the other.  An empty table gives an empty result.  Other columns
are ignored by ``removed_runs`` and kept by ``cut``, whatever they are called.
A text of any length is read whole; it has to fit a task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from foliant.llm.common import SLICE, fresh, hot_keys, join_unique, list_values, materialise

_ENDS = re.compile(r"[.!?…][\"'”’)\]]*$")
_OUTER = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")
_BARE, _CAPITAL, _END = 1, 2, 4
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_U = np.uint64


#: First or last bytes of words that need a closer look: ASCII punctuation; what may end a sentence; capitals.
_PUNCTUATION = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_CLOSING = frozenset(b".!?\"')]") | frozenset(range(128, 256))
_CAPITALS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") | frozenset(range(128, 256))


class Words(dict):
    """Raw word -> its row in `hashes` (16 bytes) and `flags`."""

    def __init__(self, entries: int = 400_000):
        self.entries = entries
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.hashes, self.flags = bytearray(), bytearray()

    def __missing__(self, raw: bytes) -> int:
        key, flag = raw.lower(), 0
        if raw[0] in _PUNCTUATION or raw[-1] in _PUNCTUATION:
            key = _OUTER.sub(b"", key)
            flag = 0 if key else _BARE
        if raw[-1] in _CLOSING and _ENDS.search(raw.decode(errors="replace")):
            flag |= _END
        if raw[0] in _CAPITALS and (w := raw.decode(errors="replace"))[0].isupper() and not w[1:2].isupper():
            flag |= _CAPITAL
        self.hashes += xxh3_128_digest(key)
        self.flags.append(flag)
        self[raw] = at = len(self.flags) - 1
        return at


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Texts:
    """Hashes of a batch of texts; words are numbered through all of them, `bare` ones count in `at` only."""

    def __init__(self, texts: list[str | None], words: Words, window: int):
        if len(words.flags) > words.entries:
            words.reset()
        rows: list[int] = []
        lines: list[int] = []
        self.first = [0]
        for text in texts:
            for line in (text or "").encode(errors="replace").split(b"\n"):
                lines.append(len(rows))
                rows.extend(map(words.__getitem__, line.split()))
            self.first.append(len(rows))
        n, rows = len(rows), np.array(rows, np.int64)
        flags = np.frombuffer(words.flags, np.uint8)[rows]
        begins = np.zeros(n + 1, bool)
        begins[lines] = True
        begins[:n] |= (flags & _CAPITAL) > 0
        begins[1:] |= (flags & _END) > 0
        begins[n] = False
        bounds = np.flatnonzero(begins)
        solid = (flags & _BARE) == 0
        #: The place of each word that is more than punctuation, and how many stand before each word.
        self.at, self.before = np.flatnonzero(solid), np.concatenate([[0], np.cumsum(solid)]).astype(np.int64)
        #: Units with such a word: first word and the word after the last.
        stops = np.append(bounds[1:], n)[: len(bounds)]
        more = self.before[stops] > self.before[bounds]
        self.begin, self.end = bounds[more], stops[more]
        m = len(self.at)
        pairs = np.frombuffer(words.hashes, np.uint64).reshape(-1, 2)[rows[self.at]]
        self.sums, self.inverse = [], []
        for k, base in enumerate(_BASES):
            power, inverse = np.full(m + 1, base, np.uint64), np.full(m + 1, pow(base, -1, 2**64), np.uint64)
            power[0] = inverse[0] = 1
            power, inverse = np.cumprod(power), np.cumprod(inverse)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(pairs[:, k] * power[:m])]))
            self.inverse.append(inverse)
        self.unit = self.hashes(self.before[self.begin], self.before[self.end], 1)
        self._anchors(window)

    def hashes(self, s: np.ndarray, e: np.ndarray, kind: int) -> np.ndarray:
        """(n, 2) signed halves of the digests of the solid words s to e."""
        salt = (e - s).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F) + _U(kind)
        return np.stack([_mix((p[e] - p[s]) * inv[s] + salt) for p, inv in zip(self.sums, self.inverse, strict=True)], axis=1).view(np.int64)

    def _anchors(self, window: int) -> None:
        """Windows of `window` solid words inside a text, and the gram that is the anchor of each."""
        gram = max(1, min(10, window // 2))
        m, reach = len(self.at), window - gram + 1
        text = np.searchsorted(self.before[np.array(self.first[1:])], np.arange(m), side="right")
        inside = text[: max(m - window + 1, 0)] == text[window - 1 :]
        if not inside.any():
            self.window = self.anchor = np.zeros(0, np.int64)
            self.grams = np.zeros((0, 2), np.int64)
            return
        starts = np.arange(m - gram + 1)
        self.grams = self.hashes(starts, starts + gram, 2)
        least, where, span = self.grams[:, 0], starts, 1
        while span < reach:  # the smallest of `span` grams in a row, the first of equal ones
            step = min(span, reach - span)
            less = least[step:] < least[:-step]
            where = np.where(less, where[step:], where[:-step])
            least = np.where(less, least[step:], least[:-step])
            span += step
        #: First solid word of each window, and the first solid word of its anchor.
        self.window, self.anchor = np.flatnonzero(inside), where[inside]

    def ranges(self) -> Iterator[tuple[slice, slice]]:
        """For each text its units and its windows."""
        u = np.searchsorted(self.begin, self.first)
        w = np.searchsorted(self.window, self.before[np.array(self.first)])
        for i in range(len(self.first) - 1):
            yield slice(u[i], u[i + 1]), slice(w[i], w[i + 1])


def _column(c: pa.Array) -> Iterable:
    """The values of a column; lists as numpy arrays."""
    return list_values(c) if pa.types.is_list(c.type) else c.to_pylist()


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Iterable]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):  # bounds the Python objects of a task
            yield [_column(c) for c in batch.slice(at, SLICE).columns]


def _arrow(out: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))


def _spans(text: str) -> np.ndarray:
    """First character of each word, and the character after its last."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(c) + 2, np.int8)
    inside[1:-1] = (c != 32) & ((c < 9) | (c > 13))
    return np.flatnonzero(np.diff(inside)).reshape(-1, 2)


def _marks(min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the units and anchors of each text (h2 is 0 for anchors), with the words that repeats of each may remove.

    An anchor stands for `min_words` words.  `own` is the same for repeats inside the text.
    """
    words = Words()
    for keys, texts in _batches(batches):
        made, out = Texts(texts, words, min_words), []
        for key, (u, w) in zip(keys, made.ranges(), strict=True):
            grams = made.grams[np.unique(made.anchor[w]), 0]
            if key is None or not len(made.unit[u]):
                continue
            h1, h2 = np.concatenate([made.unit[u, 0], grams]), np.concatenate([made.unit[u, 1], np.zeros(len(grams), np.int64)])
            lengths = np.concatenate([made.end[u] - made.begin[u], np.full(len(grams), min_words)])
            _, at, same = np.unique(h1 ^ h2, return_index=True, return_inverse=True)
            total = np.bincount(same, weights=lengths).astype(np.int64)
            out.append((key, h1[at], h2[at], np.minimum(total, min_words), int((total - lengths[at]).sum())))
        yield _arrow(out, {"doc_id": pa.int64(), "h1": pa.list_(pa.int64()), "h2": pa.list_(pa.int64()), "n": pa.list_(pa.int32()), "own": pa.int64()})


_PASSAGES = "doc_id long, places binary, firsts array<long>, own array<int>, anchors array<struct<a: long, at: int, w: array<long>>>"


def _lists(parts: list, values: pa.Array) -> pa.Array:
    """`values` cut into lists as long as `parts` are."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), values)


def _passages(min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated units of each text, with their keepers in `firsts`, and then the windows whose anchor is repeated.

    `places` packs the first word, the word after the last, and the same in
    characters of each.  `own` numbers the windows that repeat an earlier one of
    the text without overlap; `anchors` holds for each anchor the number of its
    first window and half hashes of its windows.  Texts without room for a run
    have no row.
    """
    longs = pa.list_(pa.int64())
    kinds = {"doc_id": pa.int64(), "places": pa.binary(), "firsts": longs, "own": pa.list_(pa.int32())}
    words = Words()
    for keys, texts, *rep in _batches(batches):
        made, out = Texts(texts, words, min_words), []
        anchors: list[tuple] = []
        for i, (key, text, r1, first, (u, w)) in enumerate(zip(keys, texts, *rep, made.ranges(), strict=True)):
            zero, n = made.first[i], made.first[i + 1] - made.first[i]
            # The list holds marks of this document alone, so half of a digest tells them apart.
            mine, order = made.unit[u, 0], np.argsort(r1)
            place = np.minimum(np.searchsorted(r1[order], mine), max(len(r1) - 1, 0))
            keeper = first[order][place] if len(r1) else np.full(len(mine), key)
            told = (r1[order][place] == mine) & (keeper != key) if len(r1) else np.zeros(len(mine), bool)
            _, earliest, same = np.unique(mine, return_index=True, return_inverse=True)
            repeated = np.flatnonzero(told | (earliest[same] != np.arange(len(mine))))
            at, firsts = u.start + repeated, np.where(told, keeper, key)[repeated]
            places, group = np.unique(made.anchor[w], return_inverse=True)
            grams = made.grams[places, 0]
            own, times = np.unique(grams, return_counts=True)
            chosen = np.isin(grams, np.concatenate([r1, own[times > 1]]))[group]
            s, group = made.window[w][chosen], group[chosen]
            begins = np.concatenate([made.begin[at], made.at[s]]) - zero
            stops = np.concatenate([made.end[at], made.at[s + min_words - 1] + 1]) - zero
            covered = np.bincount(begins, minlength=n + 1) - np.bincount(stops, minlength=n + 1)
            runs = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(covered[:n]) > 0, [0]]))).reshape(-1, 2)
            room = runs[runs[:, 1] - runs[:, 0] >= min_words]
            if not len(room):
                continue
            inside = np.searchsorted(room[:, 0], begins, side="right") > np.searchsorted(room[:, 1], begins, side="right")
            begins, stops, firsts = begins[inside], stops[inside], firsts[inside[: len(firsts)]]  # windows are always inside
            spans = _spans(text)
            packed = np.stack([begins, stops, spans[begins, 0], spans[stops - 1, 1]]).astype(np.int32)
            h = made.hashes(s, s + min_words, 3)[:, 0]
            _, earliest, same = np.unique(h, return_index=True, return_inverse=True)
            apart = np.flatnonzero(stops[len(firsts) :][earliest[same]] <= begins[len(firsts) :])
            heads = np.flatnonzero(np.diff(group, prepend=-1))
            anchors.append((grams[group[heads]], heads, np.diff(np.append(heads, len(s))), h))
            out.append((key, zlib.compress(np.diff(packed, axis=1, prepend=np.int32(0)).tobytes(), 1), firsts, apart))
        a, heads, sizes, h = (np.concatenate(x) for x in zip(*anchors, strict=True)) if anchors else [np.zeros(0, np.int64)] * 4
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(h))
        each = pa.StructArray.from_arrays([pa.array(a), pa.array(heads, pa.int32()), lists], ["a", "at", "w"])
        made_of = _arrow(out, kinds)
        yield pa.RecordBatch.from_arrays([*made_of.columns, _lists([x[0] for x in anchors], each)], [*kinds, "anchors"])


def _removed(min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of words inside repeated units and windows."""
    kinds = dict.fromkeys(("doc_id", "start", "end", "n_words", "first_doc_id"), pa.int64())
    for rows in _batches(batches):
        parts = [[np.zeros(0, np.int64)] for _ in kinds]
        for key, places, firsts, own, repeated, keepers in zip(*rows, strict=True):
            begins, stops, starts, ends = np.cumsum(np.frombuffer(zlib.decompress(places), np.int32).reshape(4, -1), axis=1)
            first, found = np.full(len(begins), key, np.int64), np.zeros(len(begins), bool)
            units = len(firsts)
            first[:units], found[:units] = firsts, True
            found[units + own] = found[units + repeated] = True
            first[units + repeated] = keepers
            x = np.flatnonzero(found)
            x = x[np.lexsort((first[x], stops[x], begins[x]))]
            if not len(x):
                continue
            reach = np.maximum.accumulate(stops[x])
            heads = np.flatnonzero(np.concatenate([[True], begins[x][1:] > reach[:-1]]))
            length = reach[np.append(heads[1:], len(x)) - 1] - begins[x][heads]
            enough = length >= min_words
            runs = (starts[x][heads], np.maximum.reduceat(ends[x], heads), length, first[x][heads])
            for part, column in zip(parts, (np.full(len(heads), key), *runs), strict=True):
                part.append(column[enough])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).astype(np.int64)) for p in parts], list(kinds))


def _keepers(pairs: DataFrame, key: str, also: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Pairs with a hash (key, also) that another document has too, with the smallest of its documents as `first`; and (key, also, n)."""
    # A digest's ranks shrink to three numbers before they are shuffled, however often it occurs.
    kept = pairs.groupBy(key, also).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    kept = materialise(kept.select(key, also, "first", "n"), f"kept_{label}")
    return join_unique(pairs, kept.drop("n"), key, "doc_id", counts=kept.select(key, "n"), also=(also,)), kept.select(key, also, "n")


def _repeated_windows(found: DataFrame, hot: list[int]) -> DataFrame:
    """(row, j, first) of each window that an earlier document has.

    An anchor and half a digest tell windows apart.  Windows travel with their
    anchor; those of hot anchors are counted one by one, and dealt over tasks.
    """
    rows = found.select("doc_id", "row", F.explode("anchors").alias("g")).select("doc_id", "row", "g.a", "g.at", "g.w")
    each = ["doc_id", "row", "a", "at", F.posexplode("w").alias("k", "w")]
    told = [F.col("row"), (F.col("at") + F.col("k")).alias("j"), F.col("first")]
    listed = F.broadcast(found.sparkSession.createDataFrame([(a,) for a in hot], "a long"))
    single = rows.join(listed, "a", "left_anti").repartition("a").select(*each)
    out = single.withColumn("first", F.min("doc_id").over(Window.partitionBy("w", "a"))).where("first < doc_id").select(*told)
    if hot:
        kept, _ = _keepers(rows.join(listed, "a", "left_semi").select(*each), "w", "a", "windows")
        out = out.union(kept.where("first < doc_id").select(*told))
    return out


def removed_runs(df: DataFrame, min_words: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id) of every run to remove.

    first_doc_id is the document that keeps the run's first passage.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    table = materialise(docs.mapInArrow(partial(_marks, min_words), "doc_id long, h1 array<long>, h2 array<long>, n array<int>, own long"), "marks")
    pairs = table.select("doc_id", F.explode(F.arrays_zip("h1", "h2", "n")).alias("u")).select("doc_id", "u.h1", "u.h2", "u.n")
    marks, counts = _keepers(pairs, "h1", "h2", "marks")
    hot = [a for a, _ in hot_keys(counts.where("h2 = 0"), "h1", "n")]
    # The keepers' own anchors are there as well: their windows are what others are compared with.
    marks = marks.where("h2 = 0 or first < doc_id").select("doc_id", "n", F.struct("h1", "first").alias("r"))
    own = table.where("own > 0").select("doc_id", "own", F.lit(None).alias("r"))  # repeats inside the document
    # Texts whose repeated marks have too few words for a run are not read again.  A list holds at most a document's marks.
    lists = marks.union(own).groupBy("doc_id").agg(F.sum("n").alias("n"), F.collect_list("r").alias("r")).where(F.col("n") >= min_words)
    near = docs.join(materialise(lists.drop("n"), "lists"), "doc_id").select("doc_id", "text", "r.h1", "r.first")
    # Rows are numbered, as an id may stand in several.
    found = materialise(near.mapInArrow(partial(_passages, min_words), _PASSAGES).withColumn("row", F.monotonically_increasing_id()), "passages")

    windows = _repeated_windows(found, hot).groupBy("row").agg(F.collect_list(F.struct("j", "first")).alias("r"))  # at most a document's windows
    joined = found.drop("anchors").join(windows, "row", "left").select("doc_id", "places", "firsts", "own", F.col("r.j").alias("j"), F.col("r.first").alias("keepers"))
    return joined.mapInArrow(partial(_removed, min_words), "doc_id long, start long, end long, n_words long, first_doc_id long")


def cut(df: DataFrame, runs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the runs taken out of its texts; documents without runs are not shuffled if few have some."""
    name = fresh("_runs", df)
    spans = materialise(runs.groupBy(F.col("doc_id").alias(id_col)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(name)), "spans")
    few = (spans.agg(F.sum(F.size(name) + 1)).first()[0] or 0) <= 500_000  # runs and documents
    joined = df.join(F.broadcast(spans) if few else spans, id_col, "left")
    begin = F.lit(0).cast("long")
    left = F.aggregate(
        name,
        F.struct(F.lit("").alias("t"), begin.alias("at")),
        lambda a, r: F.struct(F.concat(a["t"], F.substring(text_col, (a["at"] + 1).cast("int"), (r["start"] - a["at"]).cast("int"))).alias("t"), r["end"].alias("at")),
        lambda a: F.concat(a["t"], F.substring(text_col, (a["at"] + 1).cast("int"), F.length(text_col))),
    )
    return joined.withColumn(text_col, F.when(F.col(name).isNull(), F.col(text_col)).otherwise(left)).select(*df.columns)
