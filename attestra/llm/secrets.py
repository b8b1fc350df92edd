"""Secrets in texts: fixed patterns, and a battery of randomness tests.

Three patterns give the base spans. The method adds tokens that look random: for
each run of at least ``LEAST`` characters of an encoding's alphabet it infers the
encoding (hexadecimal, base32 or base64), and tests whether its symbols are
uniform (chi-squared over as many bins as the length can fill), alternate freely
(runs about the middle of the alphabet) and don't follow from the one before
(serial correlation). Fisher's method combines the three into one p-value: small
for tokens that are not random.

What is to be held down is the share of natural names among the tokens reported.
So the hypothesis that a token is a natural name gets a p-value of its own: how often names
of its class (length, as power grows with it; digits, case and encoding) look as random as it does.
Names come from a fixed list of words, ``REFERENCE`` for each class, so that one key in five
documents is judged as one in a million; and each token adds a decoy, words from around it joined
to a name of its length and in its style, so that where a table's own names look more random than
those of the list, more is asked. Below their ``TAIL`` quantile the names' likeness to random ones
is taken to fall off exponentially. In each class the Benjamini-Hochberg procedure then holds the
share of names among the tokens reported, added as ``random``, to ``fdr``. The counts are at most
``2 * CLASSES * BINS`` rows whatever the input's size. Runs of digits alone are numbers, not tested.

Edge cases: a null or empty text has no spans; texts are read whole; repeated
rows and null ids are handled row by row; extra columns are ignored. An empty
table gives an empty result. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged, str_texts

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LEAST = 16
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % LEAST)
#: Parts of a run that no alphabet holds as a whole.
PART = re.compile(r"[A-Za-z0-9]{%d,}" % LEAST)
#: Fixed value: letters by their frequency in prose. In this order symbols of names crowd in few bins and on one side, those of random tokens don't.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
DIGITS = "0123456789"
ALPHABETS = (
    ("hex", "eadcfb" + DIGITS),
    ("hex", "EADCFB" + DIGITS),
    ("base32", LETTERS.upper() + "234567"),
    ("base64", LETTERS + LETTERS.upper() + DIGITS + "+/"),
    ("base64", LETTERS + LETTERS.upper() + DIGITS + "-_"),
)
WORD = re.compile(r"[A-Za-z]{2,15}")
#: Words that names are made of, where a text has none of its own.
NAMES = (
    "get user name value index list make file data count page item order time state view account action active address after array before block body buffer build button cache call change "
    "channel check child class clear client close code color column command common config connect content context control copy create current date default delete delta device dialog "
    "directory document domain double element enable entry error event example export factory field filter find first format found frame function global group handle header height "
    "image import input install instance interface internal item label language layer left length level library limit line link load local location lock login manager map mask match "
    "max member memory menu message method minimum mode model module mount move network next node normal number object offset open option output owner package parameter parent parse "
    "password path pattern place player point position prefix previous print process project property provider public query queue random read record reference region register release "
    "remote remove render report request reset resource response result return right role root route rule schema scope screen script search second section select sender server service "
    "session setting shape share signal simple size sort source stack start static status step stop storage store stream string style submit support switch system table target task "
    "template test text thread title token total trace track transform tree trigger type unit update upload url utility valid variable version video visible wait width window world write"
).split()
#: Names of the list by which each class is judged, and the quantile from which their tail is extrapolated.
REFERENCE, TAIL = 800, 0.04
#: Words of the text that decoys are made of, around the token.
AROUND = 400
#: Classes of lengths (powers of the square root of two) and bins of p-values (twentieths of a power of ten).
LENGTHS, BINS = 48, 400
#: Classes of tokens: of length, with digits or not, lower, upper or mixed case or with separators, and encoding.
CASES, ENCODINGS = ("lower", "upper", "mixed", "joined"), ("hex", "base32", "base64")
CLASSES = LENGTHS * 2 * len(CASES) * len(ENCODINGS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    low = text.lower()
    if any(map(low.__contains__, WORDS)):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def encoding(token: str) -> tuple[str, str] | None:
    """Name and alphabet of the narrowest encoding whose alphabet holds the token."""
    letters = set(token)
    return next((a for a in ALPHABETS if letters <= set(a[1])), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(symbols: list[int], size: int) -> float:
    """p of a chi-squared test that symbols are uniform, five expected in a bin at least (Wilson-Hilferty)."""
    n = len(symbols)
    bins = max(2, min(size, n // 5))
    seen, room = [0] * bins, [0] * bins
    for s in range(size):
        room[s * bins // size] += 1
    for s in symbols:
        seen[s * bins // size] += 1
    x = sum((o - n * r / size) ** 2 / (n * r / size) for o, r in zip(seen, room, strict=True))
    df = bins - 1
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs(symbols: list[int], size: int) -> float:
    """p of the runs test about the middle of the alphabet."""
    high = [2 * s >= size for s in symbols]
    a = sum(high)
    b = len(high) - a
    n = a + b
    if not a or not b:
        return 2.0 ** (1 - n)  # all on one side
    found = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    return _two_sided((found - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial_correlation(symbols: list[int]) -> float:
    """p of the correlation of each symbol with the next."""
    n = len(symbols)
    mean = sum(symbols) / n
    var = sum((s - mean) ** 2 for s in symbols)
    if not var:
        return 2.0 ** (1 - n)
    r = sum((x - mean) * (y - mean) for x, y in zip(symbols, symbols[1:], strict=False)) / var
    return _two_sided((r + 1 / n) * math.sqrt(n))


def randomness(token: str) -> float | None:
    """Fisher's combined p that the token is random in its encoding; None if no encoding holds it."""
    if (found := encoding(token)) is None:
        return None
    at = {c: k for k, c in enumerate(found[1])}
    symbols = [at[c] for c in token]
    tests = (uniformity(symbols, len(at)), runs(symbols, len(at)), serial_correlation(symbols))
    half = -sum(math.log(max(p, 1e-300)) for p in tests)
    return math.exp(-half) * (1 + half + half * half / 2) if half < 700 else 0.0


def _bin(p: float) -> int:
    return min(int(-20 * math.log10(p)), BINS - 1) if p > 0 else BINS - 1


def size_class(n: int) -> int:
    return min(int(2 * math.log2(n)), LENGTHS - 1)


def class_of(token: str, name: str) -> int:
    """The number of the class of a token in an encoding of that name."""
    case = 3 if not token.isalnum() else 0 if token == token.lower() else 1 if token == token.upper() else 2
    return ((size_class(len(token)) * 2 + any(map(str.isdigit, token))) * 4 + case) * 3 + ENCODINGS.index(name)


def decoy(token: str, words: list[str], at: int, rng: random.Random | None = None) -> str:
    """Words from number ``at`` on (any words, if ``rng`` is given), joined to a name of the token's length, case, separators and digits."""
    mixed = token != token.lower() and token != token.upper()
    joint = next((c for c in "_-/+" if c in token), "")
    out = ""
    for k in range(len(token)):
        if len(out) >= len(token):
            break
        w = (rng.choice(words) if rng else words[(at + k) % len(words)]).lower()
        out += joint * (k > 0) + (w.capitalize() if mixed and k else w)
    out = (out + "".join(NAMES))[: len(token)]
    if digits := [c for c in token if c.isdigit()]:  # a version, a year or a number at its end
        out = out[:-2] + digits[at % len(digits)] + digits[(at + 1) % len(digits)]
    return out.upper() if token == token.upper() else out


def random_candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, end, class, bin of p, bin of the decoy's p) of runs, or of their parts, that an alphabet holds."""
    spans = []
    for m in RUN.finditer(text):
        parts = [m.span()] if encoding(m[0]) else [(m.start() + x.start(), m.start() + x.end()) for x in PART.finditer(m[0])]
        spans += parts
    out = []
    for start, end in spans:
        token = text[start:end]
        if token.isdecimal():
            continue
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        words = WORD.findall(before) + WORD.findall(after) or list(NAMES)
        kind = class_of(token, encoding(token)[0])
        fake = randomness(decoy(token, words, start))
        out.append((start, end, kind, _bin(randomness(token)), BINS - 1 if fake is None else _bin(fake)))
    return out


def apart(tokens: list[tuple[int, int, int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The tokens that touch no base span."""
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))  # the furthest end of those that start so far
    return [t for t in tokens if not (k := bisect_left(starts, t[1])) or ends[k - 1] <= t[0]]


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``base`` (start, kind, end), ``tokens`` (start, end, size, bin, fake) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        token_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("size", pa.int32()), ("bin", pa.int32()), ("fake", pa.int32())]))
        for b in batches:
            base, tokens = [], []
            for text in str_texts(b.column(1)):
                fixed = base_spans(text)
                base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in fixed])
                tokens.append([dict(zip(("start", "end", "size", "bin", "fake"), x, strict=True)) for x in apart(random_candidates(text), fixed)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, base_type), pa.array(tokens, token_type)], ["doc_id", "base", "tokens"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(
        run, "doc_id long, base array<struct<start:int,kind:int,end:int>>, tokens array<struct<start:int,end:int,size:int,bin:int,fake:int>>"
    )


@lru_cache(None)
def reference(kind: int) -> dict[int, int]:
    """Names of the fixed list by bin of p, for a class; those of long classes are as those of 512 characters."""
    size, digits, case, name = kind // 24, kind // 12 % 2, kind // 3 % 4, ENCODINGS[kind % 3]
    rng = random.Random(kind)
    low = max(LEAST, math.ceil(2 ** (size / 2)))
    high = max(low, min(math.ceil(2 ** ((size + 1) / 2)) - 1, 512))
    out: Counter = Counter()
    for _ in range(REFERENCE):
        n = min(rng.randint(low, high), 512)
        style = ("a" * n, "A" * n, "aB" * n, rng.choice(("a_" + "a" * n, "aB-" + "a" * n, "A_" + "A" * n)))[case][: n - 2 * digits]
        style += "".join(rng.choice("234567" if name == "base32" else DIGITS) for _ in range(2 * digits))
        p = randomness(decoy(style, list(NAMES), rng.randrange(1 << 20), rng))
        out[BINS - 1 if p is None else _bin(p)] += 1
    return dict(out)


def null(names: dict[int, int]) -> list[float]:
    """For each bin, how often names look as random or more; below the ``TAIL`` quantile by an exponential tail in the root of the bin."""
    n = sum(names.values())
    share, so_far = [], 0
    for at in range(BINS):
        so_far += names.get(at, 0)
        share.append(so_far / n)
    edge = next(at for at in range(BINS) if share[at] >= TAIL)
    root = lambda at: math.sqrt(at + 1)
    under = [(names.get(at, 0), root(edge) - root(at)) for at in range(edge + 1)]
    mean = max(sum(k * x for k, x in under) / sum(k for k, _ in under), 0.15 * root(edge) / -math.log(TAIL))
    return [max(share[at], share[edge] * math.exp(-(root(edge) - root(at)) / mean)) if at < edge else share[at] for at in range(BINS)]


def thresholds(counts: dict[tuple[int, int], int], decoys: dict[tuple[int, int], int], fdr: float) -> list[int]:
    """For each class, the bin below which its tokens are reported (0: none), by Benjamini and Hochberg."""
    out = [0] * CLASSES
    for kind in {k for k, _ in counts}:
        names = Counter(reference(kind)) + Counter({at: n for (k, at), n in decoys.items() if k == kind})
        p = null(names)
        total = sum(n for (k, _), n in counts.items() if k == kind)
        found = 0
        for at in range(BINS):
            found += counts.get((kind, at), 0)
            if found and total * p[at] <= fdr * found:
                out[kind] = at + 1
    return out


def find(docs: DataFrame, fdr: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``spans`` (start, kind, end): base spans and added ones that don't touch them.

    Tokens within a base span are reported already and take no part in the counts.
    """
    narrow = staged(scanned(docs, id_col, text_col), "secrets")
    free = narrow.select(F.explode("tokens").alias("t"))
    sides = F.explode(F.array(F.struct(F.lit(False).alias("fake"), F.col("t.bin").alias("bin")), F.struct(F.lit(True).alias("fake"), F.col("t.fake").alias("bin"))))
    found = free.select("t.size", sides.alias("x")).groupBy("size", "x.fake", "x.bin").count().collect()
    side = lambda fake: {(r["size"], r["bin"]): r["count"] for r in found if r["fake"] == fake}
    limit = F.array(*map(F.lit, thresholds(side(False), side(True), fdr)))

    def chosen(tokens: Column) -> Column:
        good = F.filter(tokens, lambda x: x["bin"] < F.get(limit, x["size"]))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))

    return narrow.select("doc_id", F.array_sort(F.concat("base", let(F.col("tokens"), chosen))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
