"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

The model has order two over ``<s> w1 .. wn </s>``: S(w | v) = c(v w) / c(v) if the
pair was seen, else alpha * c(w) / N. A document's score is the sum of log S.

Words are 64-bit hashes. Counts and scores meet in partitions of the n-gram
hash: a context's pairs share a partition, so c(v) is the sum of c(v w) there.
Contexts that fill more than half a partition are found by counting all words
first; their pairs are spread by the whole pair, and their counts, of which there
are at most ``2 * N / size`` < 2^21, are broadcast. A pair that fills more than half a
partition has two such words: those pairs are counted next, their counts are broadcast
under the same bound, and they are scored where they are met and never shuffled. So no
key has more rows than half a partition. Each task packs the pairs of a
batch of documents into one row for each partition (sorted pairs, and the
documents that hold them), so the shuffle carries each pair of a batch once.
Partial sums go back by batch and are added per document.

With no ``train`` the model is counted on the documents themselves; then every
pair has been seen. With ``train``, pairs that it lacks are looked up in the word
counts by a join on the word's hash. Batches are numbered by task and place, so
``docs`` must come in the same order if a task runs again: from files, or written
before.

Edge cases: a null or empty text has the one pair ``<s> </s>``; texts are read
whole; repeated rows count each time and each gets its score; null ids go
through; extra columns are ignored. An empty table gives an empty result, and an
empty ``train`` scores every word as unseen (half a count of one).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, staged

START = np.uint64(xxhash.xxh64_intdigest(b"<s>", 1))
END = np.uint64(xxhash.xxh64_intdigest(b"</s>", 1))
#: Words of a task's table before it is passed on.
FLUSH = 200_000
#: Pairs that a partition holds on average; more only beyond 2^20 partitions.
SIZE = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
PAYLOAD = "part long, block long, train boolean, body binary"


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (hash), ``n``: how often each word and each mark stands in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Counter[bytes] = Counter()
        texts = 0

        def out() -> pa.RecordBatch:
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in table], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(table.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for text in byte_texts(b.column(0)):
                table.update(text.split())
                texts += 1
                if len(table) > FLUSH:
                    yield out()
                    table.clear()
        yield out()
        marks = np.array([START, END]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array([texts, texts], pa.int64())], ["word", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word long, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays in as few bytes each as their largest value needs."""
    out = []
    for a in arrays:
        if a.dtype != np.uint64 and a.dtype != np.int64:
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)
        out += [np.array([len(a), ord(a.dtype.char)], np.int64).tobytes(), a.tobytes()]
    return b"".join(out)


def _unpack(body: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(body):
        n, kind = np.frombuffer(body, np.int64, 2, at)
        a = np.frombuffer(body, np.dtype(chr(kind)), int(n), at + 16)
        out.append(a)
        at += 16 + a.nbytes
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


class Hot:
    """Frequent words (hash, count, sorted by hash) and frequent pairs of them (code, count, sorted by code)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.pairs, self.pair_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def place(self, words: np.ndarray) -> np.ndarray:
        """Where each word is in ``words``, or -1."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def codes(self, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        """A number for each pair of two frequent words, -1 for others."""
        i, j = self.place(c), self.place(w)
        return np.where((i >= 0) & (j >= 0), i * len(self.words) + j, -1)

    def scored(self, c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are frequent, and their scores."""
        if not len(self.pairs):
            return np.zeros(len(c), bool), np.zeros(0)
        code = self.codes(c, w)
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        met = self.pairs[at] == code
        return met, np.log(self.pair_counts[at[met]]) - np.log(self.counts[code[met] // len(self.words)])


def _rows_of(text: bytes, hashes: dict[bytes, int]) -> np.ndarray:
    """Hashes of a text's words between its marks; ``hashes`` is a bounded cache."""
    words = text.split()
    if len(hashes) > FLUSH:
        hashes.clear()
    for w in set(words).difference(hashes):
        hashes[w] = xxhash.xxh64_intdigest(w)
    row = np.empty(len(words) + 2, np.uint64)
    row[0], row[-1] = START, END
    row[1:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return row


def hot_pairs(docs: DataFrame, hot: Hot, text_col: str = "text") -> DataFrame:
    """``code``, ``n``: how often each pair of two frequent words stands in the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[bytes, int] = {}
        for whole in batches:
            found = [np.zeros(0, np.int64)]
            for at in range(0, whole.num_rows, 1024):
                rows = [_rows_of(text, hashes) for text in byte_texts(whole.slice(at, 1024).column(0))]
                code = shared.value.codes(np.concatenate([r[:-1] for r in rows]), np.concatenate([r[1:] for r in rows]))
                found.append(code[code >= 0])
            code, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "code long, n long")
    return found.groupBy("code").agg(F.sum("n").alias("n"))


def pair_blocks(docs: DataFrame, train: bool, hot: Hot, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``PAYLOAD``: the pairs of a batch of documents that belong to one partition.

    A body holds contexts, pairs of each context, words, pairs' holders, the
    holders' places among the batch's documents, how often each holds the pair,
    and the documents' ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[bytes, int] = {}
        busy, task = shared.value.words, TaskContext.get().partitionId()
        number = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                context, word, doc = [], [], []
                for k, text in enumerate(byte_texts(b.column(1))):
                    row = _rows_of(text, hashes)
                    context.append(row[:-1])
                    word.append(row[1:])
                    doc.append(np.full(len(row) - 1, k, np.uint32))
                c, w, d = map(np.concatenate, (context, word, doc))
                met, value = shared.value.scored(c, w)
                known = _pack(np.bincount(d[met], value, b.num_rows).view(np.int64), np.bincount(d[met], minlength=b.num_rows).astype(np.int64))
                c, w, d = c[~met], w[~met], d[~met]
                spread = np.isin(c, busy)
                part = ((c * MIX + np.where(spread, w * MIX + np.uint64(1), np.uint64(0))) >> np.uint64(20)) % np.uint64(parts)
                order = np.lexsort((d, w, c, part))
                c, w, d, part = c[order], w[order], d[order], part[order]
                first = _runs(part, c, w, d)
                times = np.diff(np.r_[first, len(c)]).astype(np.uint32)
                c, w, d, part = c[first], w[first], d[first], part[first]
                ids = b.column(0).to_numpy(zero_copy_only=False) if not b.column(0).null_count else None
                starts = _runs(part)
                rows = []
                for s, e in zip(starts, np.r_[starts[1:], len(part)], strict=True):
                    pairs = _runs(c[s:e], w[s:e])
                    contexts = _runs(c[s:e][pairs])
                    rows.append(_pack(
                        c[s:e][pairs][contexts], np.diff(np.r_[contexts, len(pairs)]).astype(np.uint32), w[s:e][pairs],
                        np.diff(np.r_[pairs, e - s]).astype(np.uint32), d[s:e], times[s:e],
                    ))
                block = (task << 32) + number
                number += 1
                names = _pack(*((ids.astype(np.int64),) if ids is not None else (b.column(0).fill_null(0).to_numpy().astype(np.int64), b.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint32))))
                owner = [] if train else [-1 - block] * 2  # the ids, and the sums so far, told apart by the flag
                n = len(rows) + len(owner)
                columns = [
                    pa.array([*map(int, part[starts]), *owner], pa.int64()), pa.array([block] * n, pa.int64()),
                    pa.array([train] * len(rows) + [False, True][: len(owner)]), pa.array(rows + [names, known][: len(owner)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "train", "body"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, PAYLOAD)


def scores(docs: DataFrame, train: DataFrame | None = None, alpha: float = 0.4, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_pairs``, ``score`` (sum of natural logs) of each row."""
    spark = docs.sparkSession
    own = train is None
    words = staged(word_counts(docs if own else train, text_col), "word-counts")
    start = int(np.array(START).view(np.int64))
    total = words.where(F.col("word") != start).agg(F.sum("n")).first()[0] or 0  # words and ends: what is predicted
    size = max(size, total >> 20)
    # at most 2 * total / size, so under 2^21
    busy = words.where(F.col("n") > size // 2).toArrow()
    hot = Hot(busy.column("word").to_numpy().astype(np.int64).view(np.uint64), busy.column("n").to_numpy().astype(np.int64))
    parts = 1 + total // size
    if len(hot.words):
        # likewise at most 2 * total / size
        common = hot_pairs(docs if own else train, hot, text_col).where(F.col("n") > size // 2).orderBy("code").toArrow()
        hot.pairs, hot.pair_counts = (common.column(c).to_numpy().astype(np.int64) for c in ("code", "n"))
    counted = spark.sparkContext.broadcast(hot)
    blocks = pair_blocks(docs, False, hot, parts, id_col, text_col)
    if not own:
        blocks = blocks.unionByName(pair_blocks(train, True, hot, parts, id_col, text_col))

    def lookup(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
        block, body = table.column("block").to_pylist(), table.column("body").to_pylist()
        if part < 0:  # the ids of one batch, and its sums over frequent pairs
            return pa.table([block, list(map(int, table.column("train").to_pylist())), body], schema=schema)
        opened = [_unpack(x) for x in body]
        trains = np.array(table.column("train").to_pylist()) if not own else np.ones(len(body), bool)
        # every batch's pairs at once: sorted, equal ones are one row of this partition's count table
        sizes = [len(o[2]) for o in opened]
        cs, ws = np.concatenate([np.repeat(o[0], o[1]) for o in opened]), np.concatenate([o[2] for o in opened])
        ns = np.concatenate([np.add.reduceat(o[5].astype(np.int64), np.r_[0, np.cumsum(o[3][:-1], dtype=np.int64)]) for o in opened])
        ns *= np.repeat(trains, sizes)
        order = np.lexsort((ws, cs))
        cs, ws = cs[order], ws[order]
        first = _runs(cs, ws)
        count = np.add.reduceat(ns[order], first)
        at = _runs(cs[first])
        context = np.add.reduceat(count, at)
        whole = counted.value
        place = whole.place(cs[first][at])
        context = np.where(place >= 0, whole.counts[place] if len(whole.counts) else 0, context)
        context = np.repeat(context, np.diff(np.r_[at, len(first)]))
        value = np.log(np.maximum(count, 1)) - np.log(np.maximum(context, 1))
        slot = np.empty(len(cs), np.int64)
        slot[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(cs)]))
        slots = np.split(slot, np.cumsum(sizes)[:-1])
        out: list[list] = [[], [], []]
        for o, blk, mine, t in zip(opened, block, slots, table.column("train").to_pylist(), strict=True):
            if t:
                continue
            seen = count[mine] > 0
            holders, doc, times = o[3].astype(np.int64), o[4].astype(np.int64), o[5].astype(np.float64)
            logs = np.repeat(np.where(seen, value[mine], 0.0), holders)
            n = int(doc.max()) + 1
            sums = np.bincount(doc, times * logs, n)
            for column, v in zip(out, (blk, 1, _pack(sums.view(np.int64), np.bincount(doc, times, n).astype(np.int64))), strict=True):
                column.append(v)
            if not seen.all():
                lost = np.repeat(~seen, holders)
                for column, v in zip(out, (blk, 2, _pack(np.repeat(o[2], holders)[lost], doc[lost], times[lost].astype(np.int64))), strict=True):
                    column.append(v)
        return pa.table(out, schema=schema)

    found = blocks.groupBy("part").applyInArrow(lookup, "block long, kind int, body binary")
    if own:
        back = found
    else:
        back = staged(found, "lm-partials")
        back = back.where("kind < 2").unionByName(_backed_off(back.where("kind = 2"), words, total, alpha))
    return back.groupBy("block").applyInArrow(_summed, "doc_id long, n_pairs long, score double")


def _backed_off(lost: DataFrame, words: DataFrame, total: int, alpha: float) -> DataFrame:
    """Partial sums of pairs that the training texts lack, by their words' counts."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                word, doc, times = _unpack(body)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(word), pa.int64()), pa.array(doc.astype(np.int64)), pa.array(word.view(np.int64)), pa.array(times)], ["block", "doc", "word", "times"])

    rows = lost.select("block", "body").mapInArrow(opened, "block long, doc long, word long, times long")
    rows = rows.groupBy("block", "doc", "word").agg(F.sum("times").alias("times"))
    share = F.coalesce(F.col("n").cast("double"), F.lit(0.5)) / float(max(total, 1))
    sums = rows.join(words, "word", "left").groupBy("block", "doc").agg(F.sum(F.col("times") * (math.log(alpha) + F.log(share))).alias("s"))

    def closed(table: pa.Table) -> pa.Table:
        doc, s = table.column("doc").to_numpy(), table.column("s").to_numpy()
        sums = np.bincount(doc, s)
        body = _pack(sums.view(np.int64), np.zeros(len(sums), np.int64))
        return pa.table([table.column("block")[:1], pa.array([1], pa.int32()), pa.array([body], pa.binary())], names=["block", "kind", "body"])

    return sums.groupBy("block").applyInArrow(closed, "block long, kind int, body binary")


def _summed(table: pa.Table) -> pa.Table:
    """The documents of one batch with the sums of their partial scores."""
    kinds, bodies = table.column("kind").to_pylist(), table.column("body").to_pylist()
    ids = next(_unpack(b) for k, b in zip(kinds, bodies, strict=True) if k == 0)
    score, pairs = np.zeros(len(ids[0])), np.zeros(len(ids[0]), np.int64)
    for k, b in zip(kinds, bodies, strict=True):
        if k == 1:
            sums, times = _unpack(b)
            score[: len(sums)] += sums.view(np.float64)
            pairs[: len(times)] += times
    names = pa.array(ids[0], pa.int64(), mask=ids[1].astype(bool) if len(ids) > 1 else None)
    return pa.table([names, pa.array(pairs), pa.array(score)], names=["doc_id", "n_pairs", "score"])
