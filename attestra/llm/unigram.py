"""SentencePiece tokens by the file's own kind of model: encoding, decoding, counting.

A BPE file is encoded by its merges: ``sentencepiece`` itself over whole texts, as
its scores are merge ranks and their largest sum is not the encoding. Any other
file counts as a unigram model, by Viterbi over an Aho-Corasick automaton.

The automaton holds the pieces of a SentencePiece file with their scores. One
pass over a text meets every piece at the position where it ends, longest first
by following output links, and relaxes the best score there. Equal scores keep
the piece that starts first, as the tokenizer does; a character that is no piece
by itself counts as unknown with the least score less ten, and becomes its bytes.

Where no piece holds the space mark after another character (true of the files
here, and checked), no piece spans the start of a word, so the best path of a
text is the best paths of its words one after the other. Each worker keeps the
words it has met in a bounded cache.

Sums are exact (integers or doubles), where the tokenizer's are single-precision
and round beyond 2^24. The score of a BPE encoding is the sum of its pieces' scores.

Edge cases: a null or empty text has no tokens; texts are read whole; repeated
rows and null ids are handled row by row; extra columns are ignored. An empty
table gives an empty result. The space mark itself (U+2581) in a text decodes as
a space; any other text decodes to itself.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import str_texts

MARK = "▁"
#: A word with its marks; a line end stands alone, as no piece holds one.
UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
#: Less than any path's score.
LEAST = float("-inf")
#: Characters in a worker's cache of words, which starts anew when full, and words looked up between two looks at its size.
CACHE, STEP = 2_000_000, 20_000
#: Longer words aren't kept.
KEPT = 200
#: Bytes of ids that one batch of results holds.
BATCH = 8 << 20


class Unigram:
    """A vocabulary of scored pieces; ``path`` is a SentencePiece file with bytes for unknown characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scored: list[tuple[str, tuple[int, int, float]]] = []
        self.text_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.singles: set[str] = set()
        least, whole_words = 0.0, True
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.text_of.append(bytes([value]))
            elif model.is_control(i):
                self.text_of.append(b"")
            elif model.is_unknown(i):
                self.text_of.append(" ⁇ ".encode())
            else:
                self.text_of.append(piece.replace(MARK, " ").encode())
                score = model.get_score(i)
                least = min(least, score)
                self.scored.append((piece, (i, len(piece), score)))
                whole_words &= MARK not in piece.lstrip(MARK) and "\n" not in piece
                if len(piece) == 1:
                    self.singles.add(piece)
        self.unknown = least - 10
        self.cut = UNIT.findall if whole_words else lambda text: [text]
        self.ids_cache: dict[str, bytes] = {}
        self.count_cache: dict[str, tuple[int, float]] = {}
        self.cached = 0

    @cached_property
    def automaton(self):
        """Built when a worker first encodes; decoding needs none."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for piece, value in self.scored:
            out.add_word(piece, value)
        out.make_automaton()
        return out

    def units(self, text: str) -> list[str]:
        return self.cut(MARK + text.replace(" ", MARK)) if text else []

    def best_ids(self, unit: str) -> bytes:
        """Ids of the best path of one unit, as unsigned 32-bit integers."""
        n = len(unit)
        best, piece, length_of = [0.0] + [LEAST] * n, [-1] * (n + 1), [1] * (n + 1)
        done = n if self.singles.issuperset(unit) else 0  # positions whose unknown character has been tried

        def unknown(at: int) -> None:
            if unit[at - 1] not in self.singles and (found := best[at - 1] + self.unknown) > best[at]:
                best[at], piece[at], length_of[at] = found, -1, 1

        for end, (i, length, score) in self.automaton.iter(unit):
            while done < end:
                done += 1
                unknown(done)
            end += 1
            if (found := best[end - length] + score) > best[end]:
                best[end], piece[end], length_of[end] = found, i, length
        while done < n:
            done += 1
            unknown(done)
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out += [self.byte_ids[x] for x in reversed(unit[n - 1].encode())]
            n -= length_of[n]
        return array("I", reversed(out)).tobytes()

    def best_count(self, unit: str) -> tuple[int, float]:
        """Tokens and score of the best path of one unit, without the path."""
        n = len(unit)
        best, count = [0.0] + [LEAST] * n, [0] * (n + 1)
        done = n if self.singles.issuperset(unit) else 0

        def unknown(at: int) -> None:
            if unit[at - 1] not in self.singles and (found := best[at - 1] + self.unknown) > best[at]:
                best[at], count[at] = found, count[at - 1] + len(unit[at - 1].encode())

        for end, (_, length, score) in self.automaton.iter(unit):
            while done < end:
                done += 1
                unknown(done)
            end += 1
            if (found := best[end - length] + score) > best[end]:
                best[end], count[end] = found, count[end - length] + 1
        while done < n:
            done += 1
            unknown(done)
        return count[n], best[n]

    def looked_up(self, text: str, cache: dict, best) -> Iterator:
        """What ``best`` gives for each unit of the text, by the cache."""
        units = self.units(text)
        for at in range(0, len(units), STEP):
            part = units[at : at + STEP]
            if self.cached > CACHE:
                cache.clear()
                self.cached = 0
            for u in set(part).difference(cache):
                if len(u) <= KEPT:
                    cache[u] = best(u)
                    self.cached += len(u) + 8  # and at least its ids
            yield from (best(u) if len(u) > KEPT else cache[u] for u in part)

    def encode(self, text: str) -> bytes:
        return b"".join(self.looked_up(text, self.ids_cache, self.best_ids))

    def count(self, text: str) -> tuple[int, float]:
        found = list(self.looked_up(text, self.count_cache, self.best_count))
        return sum(n for n, _ in found), float(sum(s for _, s in found))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.text_of.__getitem__, array("I", ids))).removeprefix(b" ").decode("utf-8", "replace")


class Merges(Unigram):
    """A BPE file: the library's own merges over whole texts, decoded by the same table."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores = np.array([self.library.get_score(i) for i in range(self.library.get_piece_size())])

    def encode(self, text: str) -> bytes:
        return array("I", self.library.encode(text)).tobytes()

    def count(self, text: str) -> tuple[int, float]:
        ids = np.array(self.library.encode(text), np.int64)
        return len(ids), float(self.scores[ids].sum())


def _fields(body: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            at += 1
            value |= (body[at - 1] & 127) << shift
            shift += 7
            if body[at - 1] < 128:
                return value

    while at < len(body):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, body[at : at + size]
            at += size


def is_bpe(path: str) -> bool:
    """Whether the file's trainer (field 2) made a BPE model (field 3 is 2; 1, a unigram model, if unset)."""
    with open(path, "rb") as f:
        trainer = b"".join(v for k, v in _fields(f.read()) if k == 2)
    return dict(_fields(trainer)).get(3, 1) == 2


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Unigram:
    """One model for each worker process, of the file's own kind."""
    return Merges(path) if is_bpe(path) else Unigram(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` of each row's text: packed little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)

        def out(names: list, ids: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

        for b in batches:
            names, ids, size = [], [], 0
            for name, text in zip(b.column(0).to_pylist(), str_texts(b.column(1)), strict=True):
                names.append(name)
                ids.append(model.encode(text))
                size += len(ids[-1])
                if size > BATCH:
                    yield out(names, ids)
                    names, ids, size = [], [], 0
            yield out(names, ids)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids``, ``text`` of rows that ``encode`` returned; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        for b in batches:
            texts = [model.decode(ids or b"") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``score`` (sum over the tokens) of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        for b in batches:
            found = [model.count(t) for t in str_texts(b.column(1))]
            columns = [b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, score double")


def digested(decoded: DataFrame) -> DataFrame:
    """``doc_id``, ``n_ids``, ``ids_crc32``, ``text_sha256`` of what ``decode`` returns."""
    return decoded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )
