"""Document quality rules as a short-circuit cascade.

Each rule tests one measure of a document. On a sample the cascade measures what
each rule costs and how many documents it rejects, and then runs the rules in
order of rejections per second; a document that a rule rejects is not tested
further. The order changes only the work, never the verdict: a document is kept
if no rule rejects it.

Words are runs of characters that are not ASCII white space, lines are split at
``\\n``. Edge cases: a null or empty text has no words and fails ``few_words``;
texts are read whole whatever their length; repeated rows and null ids are judged
row by row; extra columns are ignored by ``judge`` and kept by ``keep``. An empty
table gives an empty result.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, str_texts

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measured:
    """One document's measures, each computed when a rule first asks for it."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def bytes(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.bytes.split()  # bytes split at ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, ASCII_SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.bytes.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in a window of three words that is found twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        counts = Counter(windows)
        if len(counts) == len(windows):
            return 0
        total = end = 0  # words before end are counted or not in a repeated window
        for at, window in enumerate(windows):
            if counts[window] > 1:
                total += at + 3 - max(at, end)
                end = at + 3
        return total

    @cached_property
    def n_upper(self) -> int:
        return sum(map(str.isupper, filter(str.isalpha, self.text)))

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def n_exclamations(self) -> int:
        return self.text.count("!")


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Measured], bool]


#: The rules in production; the first two are the base that always holds.
BASE = (
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repeated_words", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
)
RULES = BASE + (
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("exclamations", lambda d: 2 * d.n_exclamations > d.n_words),
    Rule("capitals", lambda d: 2 * d.n_upper > d.n_letters),
    Rule("repeated_lines", lambda d: 10 * d.n_dup_lines > 3 * len(d.lines) and d.n_dup_lines >= 3),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 20 * d.n_words),
)


def sampled_costs(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], fraction: float, seed: int) -> dict[str, tuple[int, int, float]]:
    """For each rule: documents sampled, rejections, seconds. One row a rule reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hits, took = 0, [0] * len(rules), [0.0] * len(rules)
        for b in batches:
            for text in str_texts(b.column(0)):
                seen += 1
                for k, rule in enumerate(rules):
                    doc = Measured(text)  # a new one: each rule pays for all that it needs
                    began = time.perf_counter()
                    hits[k] += rule.rejects(doc)
                    took[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array([r.name for r in rules]), pa.array([seen] * len(rules)), pa.array(hits), pa.array(took)], ["rule", "seen", "hits", "s"]
        )

    sample = docs.select(F.col(text_col).cast("string").alias("text")).sample(fraction, seed)
    found = sample.mapInArrow(run, "rule string, seen long, hits long, s double")
    return {r.rule: (r.seen, r.hits, r.s) for r in found.groupBy("rule").agg(F.sum("seen").alias("seen"), F.sum("hits").alias("hits"), F.sum("s").alias("s")).collect()}


def order_of(rules: tuple[Rule, ...], costs: dict[str, tuple[int, int, float]]) -> tuple[Rule, ...]:
    """Rules by rejections per second, best first; rules without a sample keep their place at the end."""

    def rate(rule: Rule) -> float:
        seen, hits, s = costs.get(rule.name, (0, 0, 0.0))
        return (hits + 0.5) / (seen + 1) / max(s / max(seen, 1), 1e-9) if seen else 0.0

    return tuple(sorted(rules, key=rate, reverse=True))


def planned(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, fraction: float = 0.01, seed: int = 7) -> tuple[Rule, ...]:
    return order_of(rules, sampled_costs(docs, text_col, rules, fraction, seed))


def judge(docs: DataFrame, order: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text", measures: bool = True) -> DataFrame:
    """``doc_id``, ``kept``, ``rejected_by`` (first rule in ``order``, null if kept), and the measures if asked for."""
    extra = MEASURES if measures else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by, found = [], []
            for text in str_texts(b.column(1)):
                doc = Measured(text)
                by.append(next((r.name for r in order if r.rejects(doc)), None))
                if extra:
                    found.append([getattr(doc, m) for m in extra])
            columns = [b.column(0), pa.array([x is None for x in by], pa.bool_()), pa.array(by, pa.string())]
            columns += [pa.array([f[k] for f in found], pa.int64()) for k in range(len(extra))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kept", "rejected_by", *extra])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, kept boolean, rejected_by string" + "".join(f", {m} long" for m in extra))


def keep(docs: DataFrame, text_col: str = "text", order: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns unchanged; nothing is shuffled."""
    order = order or planned(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            at = b.schema.get_field_index(text_col) if at is None else at
            kept = [not any(r.rejects(doc) for r in order) for doc in map(Measured, str_texts(b.column(at)))]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
