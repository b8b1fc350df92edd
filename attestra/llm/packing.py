"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents become pieces of at most ``capacity`` tokens. The plan is made over the
histogram of piece lengths, which has at most ``capacity`` entries whatever the
input's size: best-fit decreasing runs over counts, so a thousand bins with the
same room are one entry, and each step of the plan says "pieces of length L with
ranks from lo to hi go, q to a sequence, into the sequences from s, at offset o".
The plan has a few steps for each length. Pieces then take their slots by joining
on length and on the step that holds their rank within the length.

Ranks are dealt without bringing a length together: pieces get a salt whose
number grows with the length's count, each (length, salt) is ranked on its own,
and running sums of their sizes give the first rank of each. The salt comes from
the number that a piece got when it was written, so equal rows spread as well.

Edge cases: a null or empty text is one piece that holds the end token only; long
runs of white space are encoded like any text. Repeated rows are documents of
their own. Null ids are packed like others. Extra columns are ignored by
``pack``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, str_texts

RUN_OF_SPACE = re.compile(r"\s\s")
#: tiktoken's pattern recurses over such runs and overflows its stack on very long ones.
LONG_SPACE = re.compile(r"\s{1000}")
#: Least rows that one (length, salt) group holds on average.
SALTED = 256


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """Token ids of texts by a byte-level BPE file of the tokenizers library.

    tiktoken runs the merges over the file's vocabulary, at several times the
    speed and with the same ids. The pattern's look-ahead only matters where white
    space follows white space, so texts without that use the pattern without it.
    A text that holds one of the file's added tokens or a long run of white space
    goes to tokenizers itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in vocabulary.items() if token not in self.added}
        pattern = public_tokenizers.PATTERN
        plain = pattern.replace(r"|\s+(?!\S)", "")
        self.any, self.plain = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (pattern, plain))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit bytes."""
        runs = RUN_OF_SPACE.search(text)
        if any(map(text.__contains__, self.added)) or (runs and LONG_SPACE.search(text, runs.start())):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.any if runs else self.plain)(text)
        return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def bpe(path: str) -> ByteBpe:
    """One encoder for each worker process."""
    return ByteBpe(path)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of each document's pieces.

    Only a document of more than ``capacity`` tokens is cut, into pieces of that
    many; its first piece holds what is left over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = bpe(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for k, text in enumerate(str_texts(b.column(1))):
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    stop = start + (capacity if piece else first)
                    for column, value in zip(rows, (k, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        column.append(value)
            columns = [b.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Step(NamedTuple):
    """Pieces of ``length`` with ranks ``lo`` <= r < ``hi``: sequence first + (r - lo) // each, offset at + (r - lo) % each * length."""

    length: int
    lo: int
    hi: int
    first: int
    each: int
    at: int


def plan(histogram: dict[int, int], capacity: int = 1024) -> tuple[list[Step], int]:
    """Best-fit decreasing over counts of piece lengths; the steps and the number of sequences."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, count) of runs of sequences
    steps, opened = [], 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            room.setdefault(left, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]

        def fill(left: int, first: int, count: int, length: int = length) -> int:
            """Put what is left to do into these sequences, each as full as it goes."""
            nonlocal rank, todo
            each = left // length
            full = min(count, todo // each)
            if full:
                steps.append(Step(length, rank, rank + full * each, first, each, capacity - left))
                put(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            used = full
            if full < count and todo:
                steps.append(Step(length, rank, rank + todo, first + full, each, capacity - left))
                put(left - todo * length, first + full, 1)
                rank, todo, used = rank + todo, 0, full + 1
            put(left, first + used, count - used)
            return used

        while todo and (fits := [r for r in room if r >= length]):
            left = min(fits)
            for first, count in room.pop(left):
                if todo:
                    fill(left, first, count)
                else:
                    put(left, first, count)
        if todo:
            opened += fill(capacity, opened, -(-todo // (capacity // length)))
    return steps, opened


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pieces`` with the ``sequence_id`` and ``offset`` that the plan gives each."""
    made = pieces(docs, tokenizer, end_id, capacity, id_col, text_col).withColumn("number", F.monotonically_increasing_id())
    return placed(staged(made, "pieces"), capacity)


def placed(made: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give slots to pieces; ``made`` has ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, and ``number``, another for each row."""
    spark = made.sparkSession
    # at most `capacity` rows
    histogram = {r.length: r["count"] for r in made.groupBy("length").count().collect()}
    steps, _ = plan(histogram, capacity)
    each = max(SALTED, sum(histogram.values()) >> 20)
    sizes = [(length, -(-n // each)) for length, n in histogram.items()]
    salts = F.broadcast(spark.createDataFrame(sizes or [(0, 1)], "length long, salts long"))  # at most `capacity` rows
    schema = "length long, lo long, hi long, first long, each long, at long"
    slots = F.broadcast(spark.createDataFrame(steps or [Step(0, 0, 0, 0, 1, 0)], schema))  # a few rows for each length
    salted = made.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("number"), "salts"))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("number")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(groups, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base"))
    out = ranked.join(slots, (ranked.length == slots.length) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(slots.length)
    place = F.col("rank") - F.col("lo")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(place / F.col("each"))).alias("sequence_id"),
        (F.col("at") + place % F.col("each") * F.col("length")).alias("offset"),
    )
