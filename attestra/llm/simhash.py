"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64 bits over word shingles. Equal fingerprints form one class.
Classes meet in buckets: the 64 bits are cut into five bands, and two
fingerprints that differ in at most three bits agree in at least two whole
bands, so each of the ten pairs of bands gives a bucket key. Inside a bucket the
bits are stored vertically (one row of machine words per bit position) and many
distances grow together in carry-save counters; a block stops once all its
counters are past the radius. A bucket of more than ``CHUNK`` classes is dealt
as pairs of chunks, so no task holds a whole hot bucket. A comparison returns a
spanning forest of its links, never all pairs; connected components of these
links are found by alternating star contraction, all in joins and group-bys.

Edge cases: a null text is an empty one; an empty text has fingerprint zero and
links like any other. Rows with a null id take part and get the smallest
non-null id of their component (null if there is none). Repeated rows stay
repeated rows. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, byte_texts, staged

#: (lowest bit, width) of the bands; a radius of 3 leaves two of five intact.
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
RADIUS = 3
#: Classes of a bucket that one chunk holds; a task compares two chunks.
CHUNK = 2048
#: Small buckets that are compared together, one machine word each.
TOGETHER = 4096
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)


# --- fingerprints -----------------------------------------------------------


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: a bit is set if set in over half of the shingles' hashes."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(grams), 16384):
        hashes = np.array([xxhash.xxh64_intdigest(g, seed) for g in grams[at : at + 16384]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(grams), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long), one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in byte_texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


# --- bit-sliced comparison --------------------------------------------------


def within(planes, query_bits, radius: int = RADIUS) -> np.ndarray | None:
    """Words whose set bits are the slots within ``radius`` of the queries; None if there are none.

    ``planes[b]`` holds bit b of many fingerprints, ``query_bits[b]`` is all ones
    or all zeros by bit b of the query; both broadcast against each other. Four
    words count: two bits in carry-save form and one that stays set on overflow.
    """
    assert radius == 3, "the two counter bits hold distances up to 3"
    low = high = over = None
    for b in range(64):
        differs = planes[b] ^ query_bits[b]
        if low is None:
            low, high, over = differs, np.zeros_like(differs), np.zeros_like(differs)
            continue
        carry = low & differs
        low = low ^ differs
        over |= high & carry
        high ^= carry
        if b % 8 == 7 and over.min() == ALL:
            return None
    return ~over


def spread(fps: np.ndarray) -> np.ndarray:
    """Bit b of each fingerprint as a word of all ones or zeros: shape (64, len)."""
    return np.stack([ALL * ((fps >> np.uint64(b)) & ONE) for b in range(64)])


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """The transposed bits: shape (64, words of 64 slots)."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((64, n), np.uint8)
    bits[:, : len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def forest_of_large(fps: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (member, root) of the links among ``fps``, of any number."""
    m = len(fps)
    planes = bit_planes(fps)
    width = planes.shape[1]
    valid = np.full(width, ALL)
    if m % 64:
        valid[-1] = (ONE << np.uint64(m % 64)) - ONE
    links = np.zeros((m, width), np.uint64)
    for at in range(0, m, block):
        query = spread(fps[at : at + block])
        if (near := within(planes[:, None, :], query[:, :, None])) is not None:
            links[at : at + block] = near & valid
    linked = np.bitwise_count(links).sum(axis=1) > 1
    unseen = np.packbits(np.pad(linked, (0, width * 64 - m)), bitorder="little").view("<u8").astype(np.uint64)
    members, roots = [], []
    for start in np.flatnonzero(linked):
        if not unseen[start // 64] >> np.uint64(start % 64) & ONE:
            continue
        front = np.array([start])
        unseen[start // 64] &= ~(ONE << np.uint64(start % 64))
        while len(front):
            reached = np.bitwise_or.reduce(links[front], axis=0) & unseen
            unseen &= ~reached
            front = np.flatnonzero(np.unpackbits(reached.astype("<u8").view(np.uint8), bitorder="little"))
            members.append(front)
            roots.append(np.full(len(front), start))
    if not members:
        return fps[:0], fps[:0]
    return fps[np.concatenate(members)], fps[np.concatenate(roots)]


def forest_of_small(buckets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each bucket of at most 64; one word a bucket."""
    members, roots = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for size in (2, 4, 8, 16, 32, 64):
        group = [b for b in buckets if size // 2 < len(b) <= size]
        if not group:
            continue
        table = np.zeros((size, len(group)), np.uint64)
        valid = np.zeros(len(group), np.uint64)
        for g, b in enumerate(group):
            table[: len(b), g] = b
            valid[g] = ALL if len(b) == 64 else (ONE << np.uint64(len(b))) - ONE
        planes = np.zeros((64, len(group)), np.uint64)
        for slot in range(size):
            planes |= spread(table[slot]) & (ONE << np.uint64(slot))
        reach = np.zeros((size, len(group)), np.uint64)
        for slot in range(size):
            inside = ALL * ((valid >> np.uint64(slot)) & ONE)
            if (near := within(planes, spread(table[slot]))) is not None:
                reach[slot] = near & valid & inside
        for k in range(size):  # transitive closure
            for slot in range(size):
                reach[slot] |= reach[k] & (ALL * ((reach[slot] >> np.uint64(k)) & ONE))
        for slot in range(1, size):
            lowest = reach[slot] & (~reach[slot] + ONE)
            root = np.bitwise_count(lowest - ONE).astype(np.int64)
            if len(hit := np.flatnonzero((lowest != 0) & (root < slot))):
                members.append(table[slot, hit])
                roots.append(table[root[hit], hit])
    return np.concatenate(members), np.concatenate(roots)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each unit; the rows of a unit follow each other."""

    def out(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        a, b = (x.astype(np.uint64).view(np.int64) for x in pair)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    small: list[np.ndarray] = []

    def done(parts: list[np.ndarray]) -> pa.RecordBatch | None:
        fps = parts[0] if len(parts) == 1 else np.concatenate(parts)
        if len(fps) > 64:
            return out(forest_of_large(fps))
        if len(fps) > 1:
            small.append(fps)
            if len(small) >= TOGETHER:
                full, small[:] = list(small), []
                return out(forest_of_small(full))
        return None

    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        units = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        fps = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.r_[0, np.flatnonzero((units[:, 1:] != units[:, :-1]).any(axis=0)) + 1, len(fps)]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            unit = tuple(units[:, s])
            if unit != last:
                if held and (made := done(held)):
                    yield made
                last, held = unit, []
            held.append(fps[s:e])
    if held and (made := done(held)):
        yield made
    if small:
        yield out(forest_of_small(small))


def links(classes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links ``a`` < ``b`` that connect all distinct ``fp`` of ``classes`` within the radius.

    They span each connected set of a bucket; pairs beyond a spanning forest are
    not listed.
    """
    keys = []
    fp = F.col("fp")
    band = [F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in BANDS]
    for i in range(len(BANDS)):
        for j in range(i):
            keys.append(F.lit(len(keys) << 26).cast("long") + F.shiftleft(band[i], 13) + band[j])
    rows = classes.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    hot = (
        rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
        .select("bucket", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    )
    dealt = rows.join(hot, "bucket", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("own"))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("chunks") > 1, others).otherwise(F.array("own"))))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    units = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return units.mapInArrow(_forests, "a long, b long").distinct()


# --- connected components ---------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for all nodes of ``edges`` (a, b).

    Alternating large-star and small-star contraction: each round is two joins of
    the edges with the per-node minimum, and rounds grow with the logarithm of
    the longest path. Edges are written after each round.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = staged(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark, now = tuple(seen), after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (smallest doc_id reachable over links), one row per row of ``docs``."""
    fps = staged(with_fingerprints(docs, id_col, text_col), "fingerprints")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = staged(components(links(classes)), "roots")
    of = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    label = of.join(named, "root").select("fp", "component_id")
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one document of each near-duplicate component.

    The smallest id stays. Rows without an id can't be told apart and stay; so do
    repeated rows of the id that stays.
    """
    found = near_duplicates(docs, id_col, text_col)
    gone = staged(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-duplicates")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).cast("long").alias("__id"))
    return rows.join(bounded_broadcast(gone), F.col("__id") == F.col("__gone"), "left_anti").select("__row.*")
