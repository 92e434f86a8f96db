"""Token ids of whole texts, and their Simple-8b file format.

A token file set is a Parquet dataset of blocks in ascending document order.
Each row is one block: its shard and place in it, the ids before it in its
shard, and a payload that decodes alone:

    header    magic, documents, packed words, escapes (4 x u32), ids (u64)
    documents id (i64 each), valid flag (u8 each), ids of each (u32 each)
    words     u64: 4 selector bits above 60 payload bits
    escapes   u64: values of 60 bits or more

Selectors 2 to 15 pack 60, 30, ... 1 values of equal width; selector 1 is a run
(28 bits count, 32 bits value); selector 0 points at an escape.  Every word
tells its own count, so a block decodes with array operations only.

Nulls: a null text is an empty one; null ids sort first.  Rows that share an
id stay apart, in the order of their texts.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import WORD

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Values a word holds and bits each has, by selector from 2 on (fixed values of the format).
PACKINGS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
MAGIC = 0x31423853
_HEAD = struct.Struct("<IIIIQ")
_RUN = 61


def pack_ids(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned values; every word takes as many values as it can."""
    n = len(values)
    values = values.astype(np.uint64)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    narrow = padded.astype(np.uint32) if not n or values.max() < 1 << 32 else padded
    # What a selector fits, each wider one with fewer values fits too, so the number of those that fit tells the best.
    steps = np.zeros(n + 1, np.int8)
    for count, bits in PACKINGS:
        wide = np.flatnonzero(narrow >= (1 << bits)) if bits < 8 * narrow.itemsize else np.zeros(0, np.int64)
        edges = np.concatenate([[-1], wide, [n + 60]])
        room = np.flatnonzero(np.diff(edges) > count)
        steps[np.minimum(edges[room] + 1, n)] += 1
        stops = edges[room + 1] - count + 1
        steps[stops[stops < n]] -= 1
    fits = np.cumsum(steps[:n], dtype=np.int8)
    choice = np.where(fits > 0, len(PACKINGS) + 2 - fits, 0)
    best = np.array([0, 0, *(c for c, _ in PACKINGS)])[choice]  # values that the best word from here on takes
    same = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if n else np.zeros(1, np.int64)
    ends = np.repeat(same[1:], np.diff(same)) if n else same
    run = np.minimum(ends - np.arange(n), (1 << 28) - 1)
    runs = (run >= _RUN) & (values < np.uint64(1 << 32))
    best[runs], choice[runs] = run[runs], 1
    best[choice == 0] = 1
    starts, at, step = [], 0, best.tolist()
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    chosen = choice[starts] if n else starts
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (count, bits) in enumerate(PACKINGS, 2):
        if len(at := np.flatnonzero(chosen == selector)):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            words[at] |= np.bitwise_or.reduce(padded[starts[at][:, None] + np.arange(count)] << shifts, axis=1)
    at = np.flatnonzero(chosen == 1)
    words[at] |= (run[starts[at]].astype(np.uint64) << np.uint64(32)) | values[starts[at]]
    at = np.flatnonzero(chosen == 0)
    words[at] |= np.arange(len(at), dtype=np.uint64)
    return words, values[starts[at]] if n else values


def unpack_ids(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first n values of the words."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([1, 0, *(c for c, _ in PACKINGS)])[chosen]
    at = chosen == 1
    counts[at] = ((words[at] >> np.uint64(32)) & np.uint64((1 << 28) - 1)).astype(np.int64)
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector, (count, bits) in enumerate(PACKINGS, 2):
        if len(at := np.flatnonzero(chosen == selector)):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[starts[at][:, None] + np.arange(count)] = (words[at][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    if len(at := np.flatnonzero(chosen == 1)):
        inner = np.arange(counts[at].sum()) - np.repeat(np.cumsum(counts[at]) - counts[at], counts[at])
        out[np.repeat(starts[at], counts[at]) + inner] = np.repeat(words[at] & np.uint64(0xFFFFFFFF), counts[at])
    at = np.flatnonzero(chosen == 0)
    out[starts[at]] = escapes[(words[at] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


def write_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    lengths = np.array([len(x) for x in ids], "<u4")
    words, escapes = pack_ids(np.concatenate([*ids, np.zeros(0, np.uint32)]))
    head = _HEAD.pack(MAGIC, len(ids), len(words), len(escapes), int(lengths.sum()))
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    valid = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join([head, keys.tobytes(), valid.tobytes(), lengths.tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def read_block(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    magic, docs, n_words, n_escapes, n = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    keys, valid, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    values = unpack_ids(take("<u8", n_words), take("<u8", n_escapes), n).astype("<u4")
    return [k if v else None for k, v in zip(keys.tolist(), valid.tolist(), strict=True)], np.split(values, np.cumsum(lengths)[:-1]) if docs else []


def _byte_level() -> dict[int, int]:
    """The character that the byte-level pre-tokenizer puts for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class Pieces(dict):
    """Piece of the pre-tokenizer -> its ids by the library's model, which is asked when a piece is new.

    At most about `entries` pieces are kept, none longer than `longest`.
    """

    _BYTES = _byte_level()

    def __init__(self, library, entries: int, longest: int):
        self.tokenize, self.entries, self.longest = library.model.tokenize, entries, longest

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._BYTES)
        found = [x.id for x in self.tokenize(shown)]
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(self) < self.entries and len(piece) <= self.longest:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of a whole text, as little-endian u32 bytes, by the tokenizers library.

    Equal pieces of text recur, and the library is asked once for each.  Its
    pre-tokenizer never joins what white space separates, so words are encoded
    apart.  Texts of plain Latin-1 characters, for which lower-casing and
    character classes agree between libraries, are cut further into the pieces
    of the pre-tokenizer, and the library's model encodes each.  The cache keeps
    at most about `entries` pieces, none longer than `longest`, and lives as
    long as the Python worker.
    """

    _LETTERS = "a-zª\xb5º\xdf-\xf6\xf8-\xff"
    _NUMBERS = "0-9²³¹¼½¾"
    _OTHER = re.compile(r"[^\t-\r\x20-\x7e\xa1-\xac\xae-\xff]")
    _PIECE = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\t-\r {_LETTERS}{_NUMBERS}]+")
    _known: dict[str, Encoder] = {}

    def __init__(self, path: str, entries: int = 600_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.library, self.entries, self.longest = Tokenizer.from_file(path), entries, longest
        self.cache = Pieces(self.library, entries, longest)
        self.cuts = "\\p{L}" in str(self.library.pre_tokenizer) and "ByteLevel(add_prefix_space=False" in str(self.library.pre_tokenizer) and "Removed" in str(self.library.pre_tokenizer) and "Lowercase" in str(self.library.normalizer)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(x)}I", *x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts:
            return self._ask([text])[0]
        cache = self.cache
        if "<|" not in text and not self._OTHER.search(text):
            return b"".join(map(cache.__getitem__, self._PIECE.findall(text.lower())))
        pieces = WORD.findall(text)
        new = [p for p in set(pieces) if p not in cache]
        asked = dict(zip(new, self._ask(new), strict=True))
        out = b"".join(asked[p] if p in asked else cache[p] for p in pieces)
        if len(cache) < self.entries:
            cache.update((p, x) for p, x in asked.items() if len(p) <= self.longest)
        return out


def encode_documents(texts: Iterable[str | None], tokenizer: str, end_id: int | None = 1) -> Iterator[np.ndarray]:
    """The ids of each text, with the end id."""
    encoder = Encoder.at(tokenizer)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    for text in texts:
        yield np.frombuffer(encoder.encode(text) + end, "<u4")


BLOCKS = "shard int, block int, n_docs int, n_ids long, ids_before long, payload binary"


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, block_ids: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of df's texts to path, in ascending id_col order over all shards.

    Texts are dealt by ranges of ids, each task sorts and encodes its range, and
    holds no more than one block of ids (or one document, if that is longer).
    """

    def run(batches):
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        keys, ids, held = [], [], 0

        def flush():
            nonlocal block, before, keys, ids, held
            row = [shard, block, len(keys), held, before, write_block(keys, ids)]
            block, before = block + 1, before + held
            keys, ids, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "block", "n_docs", "n_ids", "ids_before", "payload"])

        for batch in batches:
            for key, one in zip(batch.column(0).to_pylist(), encode_documents(batch.column(1).to_pylist(), tokenizer, end_id), strict=True):
                keys.append(key)
                ids.append(one)
                held += len(one)
                if held >= block_ids:
                    yield flush()
        if keys:
            yield flush()

    rows = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    rows.repartitionByRange("k").sortWithinPartitions("k", "t").mapInArrow(run, BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files; ids are u32 bytes.

    `start` counts the ids of all documents before it.  The totals of shards,
    one row for each write task, are all that is gathered in one place.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    placed = blocks.join(F.broadcast(before), "shard").select((F.col("shard_start") + F.col("ids_before")).alias("start"), "payload")

    def run(batches):
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, ids = read_block(data)
                n = np.array([len(x) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
