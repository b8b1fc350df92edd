"""How filters interact: what each order of the same filters keeps, and which filter is to thank.

Each document is reduced to a mask, one bit for each filter it fails. For each part
of the corpus at most ``2 ** len(FILTERS)`` cells (documents, good and toxic ones by
mask) hold all that any order of filters can show. The orders are visited by swaps of
two neighbours (Johnson-Trotter): a swap changes only the two steps it touches, and
these are worked out anew from the cells. What a filter removes is summed along the walk; over all
orders this is its Shapley value times their number.

The last filter asks whether a text was seen before: a document fails it if a smaller
id has an identical text (by SHA-256) anywhere in the table. Texts are read once and
leave their task as digests; equal rows are counted before they are shuffled, and the
least id of a digest meets its row by digest and id together, so that a large group of
copies is no hot key. Parts stay distributed: only the cells of one part meet in one row.

Edge cases: a null text counts as empty, a null part as the empty string; texts are
read whole. A row without an id never fails ``E`` and has no labels. Repeated rows are
documents of their own: rows of one id don't fail ``E`` because of each other. Of several
labels of one id, one that says 1 is enough. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Filters in the order of their bits.
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Parts whose walks run at once in a task.
TOGETHER = 64


def failures(text: Column) -> Column:
    """The mask of the filters that look at the text alone: few words, few distinct ones, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    tests = (n < 50, 100 * distinct < 65 * n, 100 * F.length(F.regexp_replace(text, "[^A-Z]", "")) > 5 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: documents by part and by the filters they fail, one row a mask that occurs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"),
    )
    rows = staged(read.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n")), "audit-rows")
    named = rows.where("id IS NOT NULL")
    firsts = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    known = known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    seen = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    judged = named.join(firsts, ["digest", "id"], "left").join(known, "id", "left").withColumn("mask", F.col("mask") + seen)
    columns = ["part", "mask", "n", "is_good", "is_toxic"]
    nameless = rows.where("id IS NULL").select("part", "mask", "n", F.lit(False).alias("is_good"), F.lit(False).alias("is_toxic"))
    out = judged.select(columns).unionByName(nameless).groupBy("part", "mask")
    return out.agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(f"is_{x}"), F.col("n")).otherwise(0)).alias(x) for x in ("good", "toxic")])


def swaps(n: int) -> Iterator[int]:
    """Places k whose swap with k + 1 leads from each permutation of ``n`` to one not seen yet, till all were seen."""
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if (k := next(inner, None)) is None:
            return
        yield k + down  # the last element stands at the left end after it went down
        down = not down


def walk(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: str = FILTERS) -> Iterator[tuple[str, list[dict[str, np.ndarray]]]]:
    """Each order with its steps, for many parts at once; each argument has a row a part and a column a mask."""
    masks = np.arange(n.shape[1])
    bit = {f: 1 << k for k, f in enumerate(filters)}
    fails = {f: n[:, masks & bit[f] > 0].sum(1) for f in filters}
    alone = {f: n[:, bit[f]] for f in filters}

    def step(order: list[str], k: int) -> dict[str, np.ndarray]:
        before = sum(bit[f] for f in order[:k])
        here = (masks & before == 0) & (masks & bit[order[k]] > 0)
        removed = n[:, here].sum(1)
        return {
            "kept": n[:, masks & (before | bit[order[k]]) == 0].sum(1), "removed": removed, "redundant": fails[order[k]] - removed,
            "unique_fails": alone[order[k]], "good_lost": good[:, here].sum(1), "toxic_lost": toxic[:, here].sum(1),
        }

    order = list(filters)
    steps = [step(order, k) for k in range(len(order))]
    yield "".join(order), list(steps)
    for k in swaps(len(order)):
        order[k], order[k + 1] = order[k + 1], order[k]
        steps[k], steps[k + 1] = step(order, k), step(order, k + 1)
        yield "".join(order), list(steps)


def audit(found: DataFrame) -> DataFrame:
    """One row for each part, order and step, of what ``cells`` found: ``COUNTS`` and the step's filter's ``shapley``."""
    by_part = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most one a mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                some = b.slice(at, TOGETHER)
                tables = np.zeros((3, some.num_rows, 1 << len(FILTERS)), np.int64)
                for row, listed in enumerate(some.column(1).to_pylist()):
                    for x in listed:
                        tables[:, row, x["mask"]] = x["n"], x["good"], x["toxic"]
                shapley = {f: np.zeros(some.num_rows, np.int64) for f in FILTERS}
                visited = []
                for order, steps in walk(*tables):
                    visited += [(order, k, x) for k, x in enumerate(steps)]
                    for f, x in zip(order, steps, strict=True):
                        shapley[f] += x["removed"]
                n = len(visited)
                columns = {
                    "part": pa.concat_arrays([some.column(0)] * n),
                    "filter_order": pa.array(np.repeat([o for o, _, _ in visited], some.num_rows)),
                    "step": pa.array(np.repeat(np.array([k + 1 for _, k, _ in visited], np.int32), some.num_rows)),
                }
                columns |= {c: pa.array(np.concatenate([x[c] for _, _, x in visited])) for c in COUNTS}
                columns["shapley"] = pa.array(np.concatenate([shapley[o[k]] for o, k, _ in visited]))
                yield pa.RecordBatch.from_pydict(columns)

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTS, "shapley")))
