"""Toxicity of texts by a weighted lexicon, learned from labels.

Texts are folded, one character for one: lower case, no accents, letters of other scripts
that look Latin, and digits that stand for letters inside a word; ``l`` and ``i`` become one.
Terms of the lexicon are words, or the beginnings of words (stems of at least ``STEM``
letters); a term weighs the logarithm of how much more often toxic texts hold it. An
exception is a phrase of two words that holds a term and is found in clean texts: a term inside
it doesn't count. All terms and exceptions of a text are found by one Aho-Corasick automaton, the longest at
each word. The score is a logistic function of the summed weights and of these by the
text's length.

``learn`` takes at most ``sample`` labelled documents of each label, chosen by a hash of
their ids: the bound of what is fitted. Of texts that are copies or near copies (they share
the least hash of five words) one of each label counts. Only counts of terms reach the driver, at most
``terms`` of them, and three numbers for each sampled document. To be honest about terms that a document
itself taught, the logistic function is fitted on documents scored under the lexicon of the other
half. ``score`` reads every whole text once and shuffles nothing.

Edge cases: a null or empty text has no terms and the score of such a text; texts are read
whole; repeated rows and null ids are scored row by row; extra columns are ignored. Labels that are null
are none; of several labels of one id, one that says 1 is enough. Without labels of both kinds
the lexicon is empty and every score is the share of toxic labels (0 without any). An empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, str_texts

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("авсԁеіјкмнорԛѕтухѡαβεικνορτυχωℓı", "abcdeijkmhopqstyxwabeiknoptuxwii", strict=True))
SUBSTITUTES = str.maketrans("013457@$", "oieasta" + "s")
STEM, LONGEST = 4, 10


class _Folds(dict):
    """Code point to folded code point, worked out when first met."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        low = c.lower() if len(c.lower()) == 1 else c
        low = HOMOGLYPHS.get(low, low)
        bare = unicodedata.normalize("NFKD", low)
        if len(bare) > 1 and all(map(unicodedata.combining, bare[1:])) or len(bare) == 1:
            low = HOMOGLYPHS.get(bare[0].lower(), bare[0].lower())
        self[code] = ord("i" if low == "l" else low)
        return self[code]


FOLDS = _Folds()
WORD = re.compile(r"[^\W\d_]+")
#: Words in which a digit or sign stands beside a letter.
MIXED = re.compile(r"(?<![\w@$])(?=[\d@$_]*[^\W\d_])(?=[^\W\d]*[\d@$])[\w@$]+")


def fold(text: str) -> str:
    """The folded text; it is as long as the text."""
    out = text.translate(FOLDS)
    return MIXED.sub(lambda m: m[0].translate(SUBSTITUTES).replace("l", "i"), out)


def terms_of(words: set[str]) -> set[str]:
    """The terms that hold for any of the words: themselves, with a space at the end, and their stems."""
    return {w + " " for w in words if 3 <= len(w) <= 30} | {w[:k] for w in words for k in range(STEM, min(len(w), LONGEST) + 1)}


def sketch(words: list[str]) -> int:
    """The least hash of five words in a row, as signed 64 bits; near copies mostly share it."""
    windows = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    return min(map(xxhash.xxh64_intdigest, windows)) - (1 << 63)


class Model(NamedTuple):
    """Terms and exceptions with a space before each, exceptions and whole words with one after it; the logistic function's weights."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    logistic: tuple[float, ...]


class Hit(NamedTuple):
    word: int  # number of the word
    term: str
    weight: float


@lru_cache(2)
def _automaton(terms: tuple[tuple[str, float], ...], exceptions: frozenset[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, weight in terms:
        out.add_word(" " + term, (len(term) + 1, term, weight))
    for phrase in exceptions:
        out.add_word(f" {phrase} ", (len(phrase) + 2, phrase, None))
    if len(out):
        out.make_automaton()
    return out


def hits(words: list[str], model: Model) -> list[Hit]:
    """The longest term at each word of a folded text, without those inside an exception."""
    automaton = _automaton(tuple(model.weights.items()), model.exceptions)
    if not words or not len(automaton):
        return []
    joined = f" {' '.join(words)} "
    best: dict[int, tuple[int, str, float]] = {}
    void = set()
    for end, (size, term, weight) in automaton.iter(joined):
        at = end - size + 1
        if weight is None:
            void |= {at, joined.index(" ", at + 1)}
        elif at not in best or best[at][0] < size:
            best[at] = (size, term, weight)
    found = [at for at in best if at not in void]
    if not found:
        return []
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    return [Hit(bisect.bisect_left(starts, at), *best[at][1:]) for at in sorted(found)]


def features(total: float, n_words: int) -> list[float]:
    """What the logistic function sees: a constant, the weights found, and these by length."""
    return [1.0, math.log1p(total), math.log1p(100 * total / (n_words + 20))]


def score_of(total: float, n_words: int, logistic: tuple[float, ...]) -> float:
    z = sum(a * b for a, b in zip(logistic, features(total, n_words), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# --- learning: over bounded counts ---------------------------------------------


def surprise(a: float, b: float, c: float, d: float) -> float:
    """Twice the log-likelihood ratio of the rows (a, b) and (c, d) having one share."""
    n = a + b + c + d
    cells = ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d))
    return 2 * sum(x * math.log(x * n / (row * column)) for x, row, column in cells if x > 0)


def lexicon(counts: dict[str, tuple[int, int]], toxic: int, clean: int, least: int, ratio: float = 5.0) -> dict[str, float]:
    """Terms and weights from the toxic and clean documents that hold each term; toxic ones hold it ``ratio`` times as often."""

    def odds(a: float, b: float) -> float:
        return math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))

    def better(u: str, t: str) -> bool:
        """Whether the longer term u is toxic more often than what else t begins, beyond chance."""
        (a, b), (c, d) = counts[u], counts[t]
        return odds(a, b) >= odds(c, d) + 1 and surprise(a, b, c - a, d - b) > 12

    bar = 2 * math.log(len(counts) + 1) + 12
    good = {t: odds(a, b) for t, (a, b) in counts.items() if a >= least and odds(a, b) > math.log(ratio) and surprise(a, b, toxic - a, clean - b) > bar}
    longer: dict[str, list[str]] = {}
    for t in good:
        longer.setdefault(t[:-1], []).append(t)
    # a term that nearly always goes on in one way is that longer term; one whose better continuations make most of it is left to them
    closed = {
        t: w
        for t, w in good.items()
        if not any(counts[u][0] >= 0.9 * counts[t][0] for u in longer.get(t, ())) and sum(counts[u][0] for u in longer.get(t, ()) if better(u, t)) < 0.7 * counts[t][0]
    }
    out: dict[str, float] = {}
    for t in sorted(closed, key=len):
        shorter = next((t[:k] for k in range(len(t) - 1, STEM - 1, -1) if t[:k] in out), None)
        if shorter is None or better(t, shorter):
            out[t] = closed[t]
    return out


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> tuple[float, ...]:
    """Weights of a logistic function by Newton's method, with a small penalty on all but the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _counted(rows: DataFrame, of: Callable[[list[str]], set[str]], flush: int = 300_000) -> DataFrame:
    """``term``, ``half``, ``toxic``, ``n``: documents of ``rows`` that hold each term, counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(seen)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.bool_()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["term", "half", "toxic", "n"])

        for b in batches:
            for half, toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), str_texts(b.column(2)), strict=True):
                seen.update((t, half, toxic) for t in of(text.split(" ")))
                if len(seen) > flush:
                    yield out()
                    seen.clear()
        yield out()

    return rows.select("half", "toxic", "folded").mapInArrow(run, "term string, half int, toxic boolean, n long").groupBy("term", "half", "toxic").agg(F.sum("n").alias("n"))


def _by_term(rows: list) -> dict[str, dict[tuple[int, bool], int]]:
    out: dict[str, dict[tuple[int, bool], int]] = {}
    for r in rows:
        out.setdefault(r.term, {})[r.half, r.toxic] = r.n
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, terms: int = 200_000) -> Model:
    """The model of all labelled documents of ``labels`` (``doc_id``, ``toxic``); ``sample`` and ``terms`` bound what is fitted."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col("toxic") == 1).alias("toxic"))
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (True, False)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # at most twice the sample
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [WORD.findall(fold(t)) for t in str_texts(b.column(1))]
            columns = [b.column(0), b.column(2), pa.array([xxhash.xxh32_intdigest(str(i)) & 1 for i in b.column(0).to_pylist()], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(map(sketch, words)), pa.int64()), pa.array(list(map(" ".join, words)), pa.string())], ["id", "toxic", "half", "sketch", "folded"])

    read = staged(texts.select("id", "text", "toxic").mapInArrow(folded, "id long, toxic boolean, half int, sketch long, folded string"), "toxicity-texts")
    least_ids = staged(read.groupBy("sketch", "toxic").agg(F.min("id").alias("id")), "toxicity-sketches")  # ids are at most twice the sample
    rows = read.join(F.broadcast(least_ids), ["sketch", "toxic", "id"], "left_semi")
    size = {(r.half, r.toxic): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    of = lambda toxic, halves=(0, 1): sum(size.get((h, toxic), 0) for h in halves)
    if not of(True) or not of(False):
        share = of(True) / max(of(True) + of(False), 1)
        return Model({}, frozenset(), (math.log(share / (1 - share)) if 0 < share < 1 else 30.0 if share else -30.0, 0.0, 0.0))
    least = lambda n: max(3, n // 200)
    common = _counted(rows.where("toxic"), lambda words: terms_of(set(words)))
    enough = common.groupBy("term").agg(F.sum("n").alias("all")).where(F.col("all") >= least(of(True))).orderBy(F.desc("all"), "term").limit(terms)
    candidates = {r.term for r in enough.collect()}

    def lexicon_of(counts: dict[str, dict[tuple[int, bool], int]], halves: tuple[int, ...], ratio: float) -> dict[str, float]:
        table = {t: tuple(sum(n.get((h, y), 0) for h in halves) for y in (True, False)) for t, n in counts.items()}
        return lexicon(table, of(True, halves), of(False, halves), least(of(True, halves)), ratio)

    # exceptions: phrases of two words that hold a suspect and are found in clean texts; then suspects are judged without them
    suspects = Model(lexicon_of(_by_term(_counted(rows, lambda words: terms_of(set(words)) & candidates).collect()), (0, 1), 2.0), frozenset(), ())

    def phrases(words: list[str]) -> set[str]:
        at = {h.word for h in hits(words, suspects)}
        return {" ".join(words[k : k + 2]) for h in at for k in (h - 1, h) if 0 <= k < len(words) - 1}

    found = _counted(rows, phrases).groupBy("term").agg(*[F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(c) for c, y in (("a", True), ("b", False))])
    often = found.where((F.col("b") >= 3) & (F.col("b") * of(True) > 4 * (F.col("a") + 0.5) * of(False))).orderBy(F.desc("b"), "term").limit(terms)
    exceptions = frozenset(r.term for r in often.collect())

    def outside(words: list[str]) -> set[str]:
        void = {k for at in range(len(words) - 1) if f"{words[at]} {words[at + 1]}" in exceptions for k in (at, at + 1)} if exceptions else ()
        return terms_of({w for k, w in enumerate(words) if k not in void}) & candidates

    counts = _by_term(_counted(rows, outside).collect())
    whole, others = lexicon_of(counts, (0, 1), 5.0), {h: lexicon_of(counts, (1 - h,), 5.0) for h in (0, 1)}
    models = {h: Model(others[h], exceptions, ()) for h in (0, 1)}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [[w for w in t.split(" ") if w] for t in str_texts(b.column(2))]
            totals = [sum(h.weight for h in hits(ws, models[half])) for ws, half in zip(words, b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(totals, pa.float64()), pa.array(list(map(len, words)), pa.int64())], ["toxic", "total", "n_words"])

    seen = rows.select("half", "toxic", "folded").mapInArrow(measured, "toxic boolean, total double, n_words long").collect()  # at most twice the sample
    x = np.array([features(r.total, r.n_words) for r in sorted(seen)])
    y = np.array([float(r.toxic) for r in sorted(seen)])
    return Model(whole, exceptions, logistic_fit(x, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``n_words`` and ``hits`` (start, end, term, weight; code points of the whole text) of each row."""
    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, sizes, found = [], [], []
            for text in str_texts(b.column(1)):
                folded = fold(text)
                words = WORD.findall(folded)
                of = hits(words, model)
                scores.append(score_of(sum(h.weight for h in of), len(words), model.logistic))
                sizes.append(len(words))
                spans = [m.span() for m in WORD.finditer(folded)] if of else []
                found.append([{"start": spans[h.word][0], "end": spans[h.word][1], "term": h.term, "weight": h.weight} for h in of])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(found, hit_type)], ["doc_id", "score", "n_words", "hits"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, n_words long, hits array<struct<start:int,end:int,term:string,weight:double>>")
