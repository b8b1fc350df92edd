"""Runs of repeated words in texts, by Crochemore's refinement of equal factors.

A run is a stretch of words with smallest period ``q``, at least ``2 * q`` long, that no
neighbouring word extends. Positions of a text fall into classes of equal factors of
length 1, 2, 3 and so on. A class of length ``l + 1`` is what a class of length ``l``
leaves when it is split by the class of the next position; only the small children of
the classes split last (all but the largest of each) need to be looked at, so a position
takes part at most log n times. Neighbours of one class at distance ``l``, while factors are
``l`` long, are squares with a primitive root; squares at consecutive positions with one period are a run.

Texts are independent and stay in their task. A task refines the words of many texts
at once, as arrays, with a word that occurs nowhere else after each text; per text only
the words, their classes and the changes of neighbours (n log n at most) are held. A text
leaves the refinement when no neighbours of it are far enough apart to make a square still.

Edge cases: a null or empty text has no words, no run and an empty collapsed text; texts
are read whole; repeated rows and null ids are handled row by row; extra columns are ignored. An empty
table gives an empty result. Words are runs of characters other than ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, let

#: Words of the texts that are refined at once; a longer text is refined by itself.
TOGETHER = 1_000_000
LEAST = 12


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _changes(values: np.ndarray) -> np.ndarray:
    """Whether each value is the first or another one than that before it."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def _largest(length: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether each is the first of the largest in its section; sections begin at ``begin``."""
    sizes = np.diff(np.append(begin, len(length)))
    most = length == np.repeat(np.maximum.reduceat(length, begin), sizes)
    before = np.cumsum(most) - most
    return most & (before == np.repeat(before[begin], sizes))


class Classes:
    """Classes of positions: each a section of ``perm``, its members linked by position."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.perm = np.argsort(keys, kind="stable")
        ranked = keys[self.perm]
        new = _changes(ranked)
        self.of = np.empty(n, np.int64)
        self.of[self.perm] = np.cumsum(new) - 1
        self.at = np.empty(n, np.int64)
        self.at[self.perm] = np.arange(n)
        self.count = int(new.sum())
        self.start, self.size = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.start[: self.count] = np.flatnonzero(new)
        self.size[: self.count] = np.diff(np.append(np.flatnonzero(new), n))
        self.next, self.prev = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        inside = np.flatnonzero(~new[1:]) if n else np.zeros(0, np.int64)
        self.next[self.perm[inside]], self.prev[self.perm[inside + 1]] = self.perm[inside + 1], self.perm[inside]
        self.coming = np.zeros(n, bool)

    def split(self, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Split classes by the class of the next position, where that is among ``small``.

        Gives the members of the new small classes, and the positions whose next neighbour changed.
        """
        none = np.zeros(0, np.int64)
        x = np.sort(small[small > 0]) - 1
        x = x[self.size[self.of[x]] > 1]
        if not len(x):
            return none, none
        old, key = self.of[x], self.of[x + 1]
        by = np.lexsort((key, old))  # stable: positions stay in order
        x, old, key = x[by], old[by], key[by]
        first = np.flatnonzero(_changes(old) | _changes(key))
        length = np.diff(np.append(first, len(x)))
        group_old = old[first]
        begin = np.flatnonzero(_changes(group_old))
        # a class that moves as a whole keeps its largest group, the first of equals
        whole = np.add.reduceat(length, begin) == self.size[group_old[begin]]
        if whole.any():
            moves = ~(_largest(length, begin) & np.repeat(whole, np.diff(np.append(begin, len(length)))))
            if not moves.any():
                return none, none
            x = x[np.repeat(moves, length)]
            length, group_old = length[moves], group_old[moves]
            begin = np.flatnonzero(_changes(group_old))
        parents, moved = group_old[begin], np.add.reduceat(length, begin)
        rest = self.size[parents] - moved

        # sections: those that move go to the end of their class's, group by group
        zone = _ranges(self.start[parents] + rest, moved)
        self.coming[x] = True
        out = self.perm[zone]
        out = out[~self.coming[out]]
        self.coming[x] = False
        holes = self.at[x]
        holes = holes[holes < np.repeat(self.start[parents] + rest, moved)]
        self.perm[holes], self.at[out] = out, holes
        self.perm[zone], self.at[x] = x, zone
        ids = self.count + np.arange(len(length))
        self.count += len(length)
        self.size[parents] = rest
        self.start[ids] = zone[np.cumsum(length) - length]
        self.size[ids] = length

        # links: chains of those that move leave their class's list, and each group gets its own
        parent = np.repeat(parents, moved)
        by = np.lexsort((x, parent))
        y = x[by]
        broken = np.flatnonzero(np.concatenate(([True], self.next[y[:-1]] != y[1:])))
        heads, tails = y[broken], y[np.append(broken[1:], len(y)) - 1]
        before, after = self.prev[heads], self.next[tails]
        has = before >= 0
        self.next[before[has]] = after[has]
        left = after >= 0
        self.prev[after[left]] = before[left]
        group = np.repeat(ids, length)
        same = group[1:] == group[:-1]
        self.next[x], self.prev[x] = -1, -1
        self.next[x[:-1][same]], self.prev[x[1:][same]] = x[1:][same], x[:-1][same]
        self.of[x] = group

        # all children but the largest of each class are small
        less = rest < np.maximum.reduceat(length, begin)
        small = x
        if less.any():
            largest = _largest(length, begin) & np.repeat(less, np.diff(np.append(begin, len(length))))
            small = np.concatenate((x[np.repeat(~largest, length)], self.perm[_ranges(self.start[parents[less]], rest[less])]))
        return small, np.concatenate((before[has], x))


def squares(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and period of all squares with a primitive root.

    ``words`` are numbers; ``ends`` says for each position where its text ends. Each text is
    followed by a position of its own, whose word is found nowhere else.
    """
    classes = Classes(words)
    n = len(words)
    small = np.arange(n)
    where = np.cumsum(_changes(ends)) - 1
    dead = np.zeros(where[-1] + 1 if n else 0, bool)
    some_dead = False
    level, check = 1, 2
    at = np.flatnonzero(classes.next >= 0)
    seen = [(np.full(len(at), 1), at, classes.next[at])]
    while len(small):
        small, changed = classes.split(small)
        level += 1
        if len(changed):
            seen.append((np.full(len(changed), level), changed, classes.next[changed]))
        if level >= check:  # in steps that grow, so that all checks together are n log n
            check = max(level + 4, level * 5 // 4)
            gap = classes.next - np.arange(n)
            dead[:] = True
            dead[where[(gap >= level) & (np.arange(n) + 2 * gap <= ends)]] = False
            some_dead = dead.any()
        if len(small) and some_dead:
            small = small[~dead[where[small]]]
    since, at, to = (np.concatenate(x) for x in zip(*seen, strict=True))
    by = np.argsort(at, kind="stable")
    since, at, to = since[by], at[by], to[by]
    until = np.append(since[1:], 0)
    until[np.append(at[1:] != at[:-1], True)] = n + 1  # its last neighbour stays
    gap = to - at
    # of a text that left, classes are those of when it left: it had no gap of that length or more to come
    good = (to >= 0) & (since <= gap) & (gap < until) & (at + 2 * gap <= ends[at])
    return at[good], gap[good]


def runs_of(texts: list[list[int]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, given as word numbers, by start and period."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    firsts = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), np.int64)
    stop = firsts + sizes - 1
    inside = np.ones(len(words), bool)
    inside[stop] = False
    flat = np.concatenate([np.asarray(t, np.int64) for t in texts]) if texts else words
    text = np.repeat(np.arange(len(texts)), sizes - 1)
    words[inside] = text * (int(flat.max(initial=0)) + 1) + flat  # a word is another one in each text
    words[stop] = -1 - np.arange(len(texts))
    at, period = squares(words, np.repeat(stop, sizes))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(at):
        return out
    by = np.lexsort((at, period))
    at, period = at[by], period[by]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1]))))
    length = np.diff(np.append(first, len(at))) + 2 * period[first] - 1
    long = length >= least
    at, period, length = at[first][long], period[first][long], length[long]
    of = np.searchsorted(firsts, at, side="right") - 1
    for k in np.lexsort((period, at)):
        out[of[k]].append((int(at[k] - firsts[of[k]]), int(length[k]), int(period[k])))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: of each run its first period stays."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id``, ``runs`` (start, length, period; words counted from 0) and ``collapsed`` (the text's words without repetitions)."""

    def some(texts: list[bytes]) -> tuple[list, list]:
        number: dict[bytes, int] = {}
        split = [t.split() for t in texts]
        found = runs_of([[number.setdefault(w, len(number)) for w in ws] for ws in split], least)
        return [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found], [
            b" ".join(kept_words(ws, rs)) for ws, rs in zip(split, found, strict=True)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[bytes] = []
            size = done = 0
            for k, text in enumerate(byte_texts(b.column(1))):
                texts.append(text)
                size += len(text)
                if size >= TOGETHER * 6 or k + 1 == b.num_rows:
                    runs, kept = some(texts)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(texts)), pa.array(runs, RUNS), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])
                    done, size, texts = done + len(texts), 0, []

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeated(text: Column, a: Column, p: Column) -> Column:
    """The text's words with each word i >= a replaced by word a + (i - a) % p, joined by a space; ``a`` and ``p`` may use the number of words."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def joined(w: Column) -> Column:
        n = F.size(w)
        return let(F.struct(a(n).cast("int").alias("a"), p(n).cast("int").alias("p")), lambda x: F.array_join(F.concat(
            F.slice(w, F.lit(1), x["a"]),
            F.transform(F.sequence(F.lit(0), n - x["a"] - 1), lambda i: F.get(w, x["a"] + i % x["p"])),
        ), " "))

    return let(words, lambda w: F.when(F.size(w) > 0, joined(w)).otherwise(F.lit("")))
