"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

Only lengths decide which pieces share a sequence, and there are no more than ``capacity`` of them. So the plan is made from the number of
pieces of each length, a table of bounded size however large the input: a sequence is filled greedily from the longest length on, then its
smallest piece is replaced by two others that fit the larger gap more tightly; the pattern is repeated while its lengths last. Pieces then
find their places by rank: the r-th piece of a length takes the r-th place planned for that length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, map_texts, shuffle_partitions
from tidemark.llm.token_counts import Remembered

CAPACITY = 4096
END_ID = 1
#: ASCII letters in lower case.
LOWER = bytes(range(256)).lower()


class WordIds:
    """Ids of a word-level BPE file for texts of any length, as little-endian unsigned 32-bit numbers.

    The file drops white space and lower-cases letter by letter, so no token spans a blank and words can be encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.words = Remembered(self._word)

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # one pre-token of ASCII letters, only merges are left to do
            ids = [t.id for t in self.merge(word.decode().lower())]
        elif word[-1:] in {b".", b","} and word[:-1].isalpha():
            return self.words[word[:-1]] + self.words[word[-1:]]
        else:
            ids = self.library.encode(word.decode(), add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> bytes:
        data = text.encode()
        if b"\xcc" not in data and b"\xcd" not in data:  # no letter that may join a combining mark in one case only
            data = data.translate(LOWER)
        return b"".join(map(self.words.__getitem__, data.split()))


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and an end id, cut only where longer than ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encode = encoder(tokenizer_path)

        def run(texts):
            out = []
            for text in texts:
                ids = encode(text) + end
                step = 4 * capacity
                out.append(([(i // step, i // 4, len(part := ids[i : i + step]) // 4, zlib.crc32(part)) for i in range(0, len(ids), step)],))
            return out

        return run

    made = map_texts(docs, make, "pieces array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>")
    return made.select("doc_id", F.inline("pieces"))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-two-fit over lengths: rows of (length, first rank, uses in each sequence, first sequence, offset in it), and of a repeat count.

    Each row: (length, first_rank, uses, first_sequence, offset, repeats) packed as a tuple of six numbers.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    rows, sequence = [], 0

    def largest(most: int, free: np.ndarray) -> int:
        found = np.flatnonzero(free[1 : most + 1])
        return int(found[-1]) + 1 if len(found) else 0

    while (top := largest(capacity, left)) > 0:
        take: dict[int, int] = {}
        free, gap, length = left.copy(), capacity, top
        while length:
            n = min(int(free[length]), gap // length)
            take[length] = take.get(length, 0) + n
            free[length] -= n
            gap -= n * length
            length = largest(min(gap, capacity), free) if gap else 0
        if gap and sum(take.values()) > 1:
            small = min(take)
            room = gap + small
            lengths = np.flatnonzero(free[: room + 1])
            lengths = lengths[lengths > 0]
            best, pair = small, None
            at = len(lengths) - 1
            for i, a in enumerate(lengths):  # for each, the largest partner that still fits
                while at >= 0 and a + lengths[at] > room:
                    at -= 1
                if at < i:
                    break
                b = lengths[at]
                if a == b and free[a] < 2:
                    if at - 1 < i:
                        continue
                    b = lengths[at - 1]
                if a + b > best:
                    best, pair = int(a + b), (int(a), int(b))
            if pair:
                take[small] -= 1
                for x in pair:
                    take[x] = take.get(x, 0) + 1
        take = {k: n for k, n in take.items() if n}
        repeats = min(int(left[k]) // n for k, n in take.items())
        offset = 0
        for k in sorted(take, reverse=True):
            rows.append((k, int(used[k]), take[k], sequence, offset, repeats))
            used[k] += take[k] * repeats
            left[k] -= take[k] * repeats
            offset += k * take[k]
        sequence += repeats
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows of doc_id, piece, length (1 to ``capacity``); other columns stay. No rows give no rows."""
    spark = pieces.sparkSession
    salts = 4 * shuffle_partitions(spark)
    ranked = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    groups = ranked.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = cut(groups.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # one row a length, capacity at most
    places = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(places)

    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    ranked = ranked.withColumn("_rank", rank).join(groups.drop("_n"), ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") - 1 + F.col("_before")).cast("long").alias("_rank"))
    n = len(pieces.columns)
    at = pieces.columns.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            r = batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
            row = table[np.searchsorted(key, length * (1 << 44) + r, side="right") - 1] if len(r) else table[:0]
            inside = r - row[:, 1]
            sequence = row[:, 3] + inside // np.maximum(row[:, 2], 1)
            offset = row[:, 4] + length * (inside % np.maximum(row[:, 2], 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:n], "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType(pieces.schema.fields).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenizes, cuts and packs documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are packed once each. Ids may be null.
    """
    return pack(cut(tokenized_pieces(docs, tokenizer_path, capacity, end_id)), capacity)
