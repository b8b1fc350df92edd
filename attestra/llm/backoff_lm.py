"""Stupid backoff of any order, each document scored by the counts of all others.

S(w | v) = c(v w) / c(v) if the n-gram was seen outside the document, else
alpha * S(w | v without its first word), down to c(w) / N; a word seen nowhere else
counts half. All counts are without the document's own, so its rare n-grams
don't speak for themselves. Words stand over ``<s> w1 .. wn </s>``; a position with
fewer words before it starts at the longest n-gram it has.

Each distinct n-gram of a document is one row. Rows are summed to a count table
by n-gram, contexts get their sums from it, and each order joins its n-grams with the
table; those unseen go to the join of the next lower order. N-grams are 64-bit hashes.

Edge cases: as in ``ngram_lm``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, staged
from .ngram_lm import END, MIX, START


def _grams(text: bytes, order: int) -> list[np.ndarray]:
    """For n from 1: hashes of the n-grams that end at each place, ``<s>`` being place 0; the first n - 1 mean nothing."""
    h = np.array([START, *(xxhash.xxh64_intdigest(w) for w in text.split()), END], np.uint64)
    out = [h]
    for n in range(2, order + 1):
        g = np.zeros(len(h), np.uint64)
        g[1:] = (out[-1][:-1] * MIX + np.uint64(n)) ^ (out[-1][:-1] >> np.uint64(29))
        g[1:] = (g[1:] ^ h[1:]) * MIX
        out.append(g ^ (g >> np.uint64(32)))
    return out


def _own(keys: np.ndarray) -> np.ndarray:
    """How often each place's key is there."""
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[at]


def _columns(order: int) -> list[tuple[str, str]]:
    """n-gram, context, and the document's own counts of both, for each order."""
    return [(f"{c}{n}", "long" if c in "gv" else "int") for n in range(1, order + 1) for c in "gvab"]


def rows(docs: DataFrame, order: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, ``doc_id``, ``t`` and ``_columns``: each document's distinct n-grams of the highest order, ``t`` times each."""
    names = _columns(order)
    kinds = [("row", "long"), ("doc_id", "long"), ("t", "int"), *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2)), strict=True):
                grams = _grams(text, order)
                size = len(grams[0]) - 1  # places 1 to size are predicted
                place = np.arange(1, size + 1)
                data, lacks = [], []
                for n in range(1, order + 1):
                    g, v = grams[n - 1][1:], grams[n - 2][:-1] if n > 1 else np.zeros(size, np.uint64)
                    lack = place < n - 1
                    a, c = np.zeros(size, np.int32), np.zeros(size, np.int32)
                    a[~lack], c[~lack] = _own(g[~lack]), _own(v[~lack])
                    data += [g.view(np.int64), v.view(np.int64), a, c]
                    lacks += [lack] * 4
                top = np.minimum(place, order - 1)  # words before: places at the start differ by it
                _, first, times = np.unique(np.stack(grams)[top, place] ^ (top.astype(np.uint64) << np.uint64(1)), return_index=True, return_counts=True)
                columns = [pa.array(np.full(len(first), row)), pa.array([doc] * len(first), pa.int64()), pa.array(times.astype(np.int32))]
                columns += [pa.array(x[first], mask=y[first]) for x, y in zip(data, lacks, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [n for n, _ in kinds])

    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds))


def scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words`` (with the end), ``score`` (sum of natural logs), ``n_backed_off`` of each row."""
    every = staged(rows(docs, order, id_col, text_col), "lm-rows")
    left, parts = every.withColumn("drops", F.lit(0)), []
    total = every.agg(F.sum("t")).first()[0] or 0
    for n in range(order, 0, -1):
        g, v, a, b = (F.col(f"{c}{n}") for c in "gvab")
        # t is of the highest order: summed over a document it gives the n-gram's own count
        counted = every.where(g.isNotNull()).groupBy(g.alias("g"), v.alias("v")).agg(F.sum("t").alias("c"))
        if n > 1:
            counted = staged(counted, "lm-counts")
            context = counted.groupBy("v").agg(F.sum("c").alias("cv"))
            counted = counted.join(context, "v")
        else:
            counted = counted.withColumn("cv", F.lit(total))
        met = left.join(counted.select(F.col("g").alias(f"g{n}"), "c", "cv"), f"g{n}", "left")
        seen = F.coalesce(F.col("c") - a > 0, F.lit(False))
        log = F.log((F.col("c") - a) / (F.col("cv") - b))
        if n == 1:
            log = F.when(seen, log).otherwise(F.log(F.lit(0.5) / F.greatest(F.lit(total) - b, F.lit(1))))
            seen = F.lit(True)
        met = met.withColumn("s", F.when(seen, F.col("t") * (log + F.col("drops") * math.log(alpha))))
        met = met.withColumn("drops", F.col("drops") + F.when(F.col("s").isNull() & g.isNotNull(), 1).otherwise(0)).drop("c", "cv", *(f"{c}{n}" for c in "gvab"))
        met = staged(met, "lm-order")
        parts.append(met.where("s IS NOT NULL").groupBy("row", "doc_id").agg(F.sum("t").alias("n"), F.sum("s").alias("s"), F.sum(F.when(F.col("drops") > 0, F.col("t")).otherwise(0)).alias("k")))
        left = met.where("s IS NULL").drop("s")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("row", "doc_id").agg(F.sum("n").alias("n_words"), F.sum("s").alias("score"), F.sum("k").alias("n_backed_off"))
    return out.select("doc_id", "n_words", "score", "n_backed_off")
