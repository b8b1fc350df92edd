"""Personal data by weak supervision (DataFrame operations only).

Candidate spans come from one pattern per kind. Four labelers vote on each
candidate (+1 personal, -1 not, 0 abstains): whether it is well formed for its kind,
a gazetteer, the words before the span (the ``CONTEXT`` characters there), and a
test for placeholder values. The gazetteer of names and mail domains grows with the corpus: a
term on which the other labelers agree in nearly all of its candidates is promoted.
Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability for each kind without labels, leaning on its reliability over
all kinds where a kind is rare; its posteriors train a naive Bayes
classifier of spans on shape and context, which decides the spans that the method
adds. Spans of the base kinds that pass their test always stay.

What reaches the driver is one row per (kind, vote pattern, shape), at most
``len(KINDS) * 81 * 6912`` rows by construction and a few hundred in practice,
whatever the input's size. Nothing is shuffled but these counts and those of terms, of which the
``TERMS`` most frequent promoted ones are broadcast. Texts are searched
once: spans are written (with the texts, for ``redact``) before they are judged.

Edge cases: a null or empty text has no spans; texts are read whole; repeated
rows and null ids are handled row by row; extra columns are ignored by ``find``
and kept by ``redact``. An empty table gives an empty result. Offsets are code
points, the end exclusive.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged

#: Kinds in the order in which spans of one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "masked_email", "local_phone", "national_id", "person")
N_BASE = 4
#: Possessive quantifiers where nothing could be given back: same matches, no backtracking, no recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9]|[.-][0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?",
}
#: What a text must hold for a kind's pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}
NEEDS_PATTERN = {
    "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "masked_email": r"[\[(](?:at|AT)[\])]", "local_phone": r"[0-9]{3}[.\x20-][0-9]{4}",
    "national_id": r"-[0-9]{2}-", "person": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20",
}
#: Endings of common mail domains, issuers' first digits, country calling codes, given names.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|it|nl|eu|us|ca|ch|at|co)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|6011|65)"
CALLING_CODES = r"^(?:1|7|20|27|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
GIVEN_NAMES = r"(?i)\b(?:anna|anne|carlos|claire|daniel|david|elena|emma|hans|james|jean|john|jose|julia|karl|laura|lucas|luis|maria|marie|martin|mary|michael|paul|peter|pierre|robert|sarah|sofia|thomas)\b"
CUES = r"(?i)(?:e-?mail|mail|contact|write|phone|call|tel|fax|mobile|card|visa|credit|payment|address|host|server|ssn|social|name|dear|from|by|login)[^\p{L}]*+(?:\p{L}++[^\p{L}]++)?$"
COUNTERCUES = r"(?i)(?:version|release|isbn|order|invoice|figure|section|table|page|chapter|part|serial|sample|test)[^\p{L}]*+$"
PLACEHOLDER = r"^(?:([0-9])\1*|0?123456789?0?[0-9]*)$"
#: Terms that the corpus may add to the gazetteer, how often each must be met, and the share of candidates on which the others agree.
TERMS, TERM_COUNT, TERM_SHARE = 10_000, 5, 0.9
#: Characters before a span that the context labeler reads.
CONTEXT = 48
#: Numbers published as samples.
SAMPLE_IDS = ("078-05-1120", "219-09-9999", "123-45-6789", "987-65-4321", "111-11-1111", "222-22-2222", "333-33-3333", "444-44-4444", "555-55-5555", "777-77-7777", "888-88-8888")
WELL_FORMED = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?!-)[^@]*[A-Za-z0-9]\.[A-Za-z]{2,}$",
    "masked_email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+\x20?[\[(].*[A-Za-z0-9\x20\])]\.?\x20?[A-Za-z]{2,}$",
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    """The test of a match that the base asks for, or that makes an added kind plausible."""
    if kind == "ip":
        return s.rlike(OCTETS)
    if kind == "card":
        n = F.length(_digits(s))
        # the checksum is only asked of lengths that count
        return F.when((n >= 14) & (n <= 19), F.call_function("luhn_check", _digits(s))).otherwise(F.lit(False))
    if kind in ("phone", "local_phone"):
        return F.length(_digits(s)).between(10, 15)
    if kind == "national_id":
        return ~s.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _well_formed(kind: str, s: Column) -> Column:
    if kind == "person":  # a given name or a title alone says little
        return F.when(s.rlike(r"\x20\p{Lu}\p{Ll}+\x20"), 1).otherwise(0)
    return F.when(s.rlike(WELL_FORMED[kind]) & ~s.contains("..") if kind in WELL_FORMED else _valid(kind, s), 1).otherwise(-1)


def _gazetteer(kind: str, s: Column) -> Column:
    if kind == "national_id":  # areas up to 665 were given out most; samples never
        return F.when(s.isin(*SAMPLE_IDS), -1).when(s.rlike("^(?:[1-5]|0(?!00)|6[0-5]|66[0-5])"), 1).otherwise(0)
    if kind == "person":  # a surname alone is no counter-evidence
        return F.when(s.rlike(GIVEN_NAMES), 1).otherwise(0)
    yes = {
        "email": s.rlike(DOMAINS), "masked_email": F.regexp_replace(s, r"\x20?[\[(](?:dot|DOT)[\])]\x20?", ".").rlike(DOMAINS),
        "ip": ~s.rlike(r"^0*(?:0|10|127|255)\.|^192\.168\.|^169\.254\."), "card": _digits(s).rlike(ISSUERS),
        "phone": _digits(s).rlike(CALLING_CODES), "local_phone": s.rlike(r"^\(?[2-9]"),
    }[kind]
    return F.when(yes, 1).otherwise(-1)


def _term(kind: str, s: Column) -> Column:
    """What of a candidate the corpus may add to the gazetteer: a name after a title, or a mail domain."""
    if kind == "person":
        return F.lower(F.regexp_extract(s, r"\x20(\p{Lu}\p{Ll}+)", 1))
    if kind in ("email", "masked_email"):
        plain = F.regexp_replace(F.regexp_replace(s, r"\x20?[\[(](?:dot|DOT)[\])]\x20?", "."), r"^.*(?:@|[\])]\x20?)", "")
        return F.lower(F.regexp_extract(plain, r"([^.]+\.[^.]+)$", 1))
    return F.lit(None).cast("string")


def _context(before: Column) -> Column:
    return F.when(before.rlike(COUNTERCUES), -1).when(before.rlike(CUES), 1).otherwise(0)


def _placeholder(s: Column) -> Column:
    d = _digits(s)
    return F.when((F.length(d) >= 7) & d.rlike(PLACEHOLDER), -1).when(F.length(d) >= 7, 1).otherwise(0)


def _shape(kind: str, s: Column, before: Column) -> Column:
    """Length, share of digits, separators, context, form and placeholder in one small number (under 6912)."""
    size = F.least(F.floor(F.length(s) / 4), F.lit(7))
    digits = F.floor(3 * F.length(_digits(s)) / F.length(s))
    seps = F.when(s.contains(" "), 1).otherwise(0) + F.when(s.contains("-"), 2).otherwise(0) + F.when(s.contains("."), 4).otherwise(0)
    plain = ((size * 4 + digits) * 3 + _context(before) + 1) * 8 + seps
    return (plain + 768 * (_well_formed(kind, s) + 1) + 2304 * (_placeholder(s) + 1)).cast("int")


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array of (start, end, before, s), in linear time.

    The gaps between matches and the matches themselves come from the same
    pattern; running lengths of both, first by blocks of 128, give the offsets.
    """
    pairs = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, s: F.struct(F.length(gap).alias("gap"), F.right(gap, F.lit(CONTEXT)).alias("before"), s.alias("s")),
    )
    pairs = F.filter(pairs, lambda x: x.s.isNotNull())
    long = lambda x: x.gap + F.length(x.s)
    span = "array<struct<start:int,end:int,before:string,s:string>>"

    def walk(block: Column) -> Column:
        start = F.struct(block["at"].alias("at"), F.array().cast(span).alias("out"))
        step = lambda a, x: F.struct(
            (a["at"] + long(x)).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x.gap).alias("start"), (a["at"] + long(x)).alias("end"), x.before.alias("before"), x.s.alias("s")))).alias("out"),
        )
        return F.aggregate(block["rows"], start, step, lambda a: a["out"])

    def blocks(rows: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / 128).cast("int")), lambda b: F.slice(rows, b * 128 + 1, F.lit(128)))
        item = "array<struct<at:int,rows:array<struct<gap:int,before:string,s:string>>>>"
        start = F.struct(F.lit(0).alias("at"), F.array().cast(item).alias("out"))
        step = lambda a, part: F.struct(
            (a["at"] + F.aggregate(part, F.lit(0), lambda n, x: n + long(x))).alias("at"),
            F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), part.alias("rows")))).alias("out"),
        )
        return F.flatten(F.transform(F.aggregate(parts, start, step, lambda a: a["out"]), walk))

    return let(pairs, lambda rows: F.when(F.size(rows) > 0, blocks(rows)).otherwise(F.array().cast(span)))


def _votes(kind: str, x: Column) -> Column:
    """The four votes, each 0 (no), 1 (abstains) or 2 (yes), as digits of base 3."""
    return ((_well_formed(kind, x.s) + 1) * 27 + (_gazetteer(kind, x.s) + 1) * 9 + (_context(x.before) + 1) * 3 + _placeholder(x.s) + 1).cast("int")


def _of_kind(text: Column, kind: str) -> Column:
    """The candidates of one kind; its pattern is tried only on texts that can hold it."""
    k = KINDS.index(kind)

    def span(x: Column) -> Column:
        base = F.lit(False) if k >= N_BASE else F.lit(True) if kind == "email" else _valid(kind, x.s)
        return F.struct(
            x.start.alias("start"), F.lit(k).alias("kind"), x.end.alias("end"), base.alias("base"),
            _votes(kind, x).alias("votes"), _shape(kind, x.s, x.before).alias("shape"), _term(kind, x.s).alias("term"),
        )

    needs = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike(NEEDS_PATTERN[kind])
    none = F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean,votes:int,shape:int,term:string>>")
    return F.when(needs, F.transform(matches(text, PATTERNS[kind]), span)).otherwise(none)


def candidates(text: Column) -> Column:
    """All candidate spans: array of (start, kind, end, base, votes, shape, term), in order."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_sort(F.concat(*[_of_kind(text, kind) for kind in KINDS]))


# --- label model and classifier: over bounded counts ---------------------------


#: What a labeler is thought to do before any evidence: votes no, abstains, yes on false and on true spans.
BELIEF = [[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]]
#: Spans' worth of weight that a labeler's table over all kinds has in its table for one kind.
LEAN = 20.0


def label_model(counts: dict[tuple[int, int], int], rounds: int = 60) -> dict[tuple[int, int], float]:
    """Expectation-maximisation over (kind, votes) -> count; the posterior that such a span is personal data.

    Labelers vote independently given the truth; each has a table of votes for true
    and false spans of each kind, and one over all kinds that it leans on; each kind
    has its own share of true spans.
    """
    votes = {code: (code // 27, code // 9 % 3, code // 3 % 3, code % 3) for _, code in counts}
    kinds = {k for k, _ in counts}
    table = {k: [BELIEF] * 4 for k in kinds}
    prior = dict.fromkeys(kinds, 0.5)
    post: dict[tuple[int, int], float] = {}
    share = lambda row: [x / sum(row) for x in row]
    for _ in range(rounds):
        for (kind, code), _n in counts.items():
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(table[kind][j][1][v] / table[kind][j][0][v]) for j, v in enumerate(votes[code]))
            post[kind, code] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        own = {k: [[[0.0] * 3, [0.0] * 3] for _ in range(4)] for k in kinds}
        true = {k: [1.0, 2.0] for k in kinds}
        for (kind, code), n in counts.items():
            p = post[kind, code]
            true[kind][0] += n * p
            true[kind][1] += n
            for j, v in enumerate(votes[code]):
                own[kind][j][1][v] += n * p
                own[kind][j][0][v] += n * (1 - p)
        prior = {k: min(max(a / b, 0.01), 0.99) for k, (a, b) in true.items()}
        for j in range(4):
            for y in (0, 1):
                # a kind weighs as one in what holds for all kinds, however common it is
                whole = share([2 * BELIEF[y][v] + sum(share([x + 1e-9 for x in own[k][j][y]])[v] for k in kinds) for v in range(3)])
                for k in kinds:
                    table[k] = [[list(row) for row in one] for one in table[k]]
                    table[k][j][y] = share([own[k][j][y][v] + LEAN * whole[v] for v in range(3)])
    return post


def classifier(counts: dict[tuple[int, int, int], int], post: dict[tuple[int, int], float]) -> set[tuple[int, int]]:
    """Naive Bayes on kind and the parts of the shape, trained on soft labels; the (kind, shape) it accepts."""

    def features(kind: int, shape: int) -> list[tuple]:
        plain = shape % 768
        return [
            ("size", kind, plain // 96), ("digits", kind, plain // 24 % 4), ("context", plain // 8 % 3), ("seps", kind, plain % 8),
            ("formed", kind, shape // 768 % 3), ("placeholder", kind, shape // 2304),
        ]

    seen = defaultdict(lambda: [1.0, 1.0])
    kinds = defaultdict(lambda: [1.0, 1.0])
    for (kind, code, shape), n in counts.items():
        p = post[kind, code]
        for where, key in [(kinds, kind), *((seen, f) for f in features(kind, shape))]:
            where[key][0] += n * (1 - p)
            where[key][1] += n * p
    total = [sum(v[y] for v in kinds.values()) for y in (0, 1)]

    def score(kind: int, shape: int) -> float:
        out = math.log(kinds[kind][1] / kinds[kind][0])
        for f in features(kind, shape):
            by = total if f[0] == "context" else kinds[kind]
            out += math.log(seen[f][1] / (by[1] + 2)) - math.log(seen[f][0] / (by[0] + 2))
        return out

    return {(kind, shape) for kind, _, shape in counts if kind >= N_BASE and score(kind, shape) > 0}


def promoted(found: DataFrame) -> DataFrame:
    """``kind``, ``term``: terms that stand in at least ``TERM_COUNT`` candidates, of which ``TERM_SHARE`` are personal by all other labelers that vote.

    ``found`` has a row a candidate. The gazetteer's own vote is left out, so that a term isn't its own witness.
    """
    form, before, blank = (F.col("votes") / 27).cast("int"), (F.col("votes") / 3).cast("int") % 3, F.col("votes") % 3
    agree = ((form == 2) | (before == 2)) & (form != 0) & (before != 0) & (blank != 0)
    counted = found.where(F.col("term") != "").groupBy("kind", "term").agg(F.count("*").alias("n"), F.count_if(agree).alias("yes"))
    return counted.where((F.col("n") >= TERM_COUNT) & (F.col("yes") >= TERM_SHARE * F.col("n"))).orderBy(F.desc("n"), "kind", "term").limit(TERMS).select("kind", "term")


def trained(spans: DataFrame) -> set[tuple[int, int]]:
    """The (kind, shape) pairs that the classifier accepts; ``spans`` has a column of candidates."""
    found = spans.select(F.explode("spans").alias("x")).select("x.kind", "x.votes", "x.shape", "x.term")
    known = F.broadcast(promoted(found).withColumn("known", F.lit(True)))  # at most TERMS rows
    votes = F.when(F.col("known"), F.col("votes") - (F.col("votes") / 9).cast("int") % 3 * 9 + 18).otherwise(F.col("votes"))
    rows = found.join(known, ["kind", "term"], "left").groupBy("kind", votes.cast("int").alias("votes"), "shape").count().collect()
    counts = {(r.kind, r.votes, r.shape): r["count"] for r in rows}
    by_votes: dict[tuple[int, int], int] = defaultdict(int)
    for (kind, code, _), n in counts.items():
        by_votes[kind, code] += n
    return classifier(counts, label_model(by_votes))


#: Spans in a row whose furthest end and next start are looked up together.
BLOCK = 128


def free_of_base(found: Column, wanted) -> Column:
    """The spans of ``found``, in order of their starts, that are base or ``wanted`` and touch no base span; in linear time.

    A span touches one that starts before it if the furthest end so far is beyond its start,
    and one that starts later if the next start is before its end; both are told by blocks.
    """
    count = F.greatest(F.ceil(F.size(found) / BLOCK).cast("int"), F.lit(1))
    blocks = F.sequence(F.lit(0), count - 1)
    part = lambda values, b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    ends, starts = F.transform(found, lambda x: F.when(x["base"], x["end"]).otherwise(-1)), F.transform(found, lambda x: F.when(x["base"], x["start"]).otherwise(2**31 - 1))

    def with_all(ends: Column, starts: Column, most: Column, least: Column) -> Column:
        # of the blocks before and after each, from those of the blocks
        sides = F.struct(
            F.transform(blocks, lambda b: F.coalesce(F.array_max(F.slice(most, F.lit(1), b)), F.lit(-1))).alias("before"),
            F.transform(blocks, lambda b: F.coalesce(F.array_min(F.slice(least, b + 2, count)), F.lit(2**31 - 1))).alias("after"),
        )

        def clear(side: Column, x: Column, k: Column) -> Column:
            b = F.floor(k / BLOCK).cast("int")
            before = F.greatest(F.get(side["before"], b), F.array_max(F.slice(ends, b * BLOCK + 1, k - b * BLOCK)))
            after = F.least(F.get(side["after"], b), F.array_min(F.slice(starts, k + 2, (b + 1) * BLOCK - k - 1)))
            return (before <= x["start"]) & (after >= x["end"])

        return let(sides, lambda side: F.filter(found, lambda x, k: x["base"] | (wanted(x) & clear(side, x, k))))

    return let(ends, lambda e: let(starts, lambda s: let(
        F.transform(blocks, lambda b: F.array_max(part(e, b))), lambda most: let(F.transform(blocks, lambda b: F.array_min(part(s, b))), lambda least: with_all(e, s, most, least)),
    )))


def accepted(spans: Column, ok: set[tuple[int, int]]) -> Column:
    """Base spans and the added ones that are accepted and don't touch a base span."""
    codes = F.array(*[F.lit(kind * 6912 + shape) for kind, shape in sorted(ok)]).cast("array<int>")
    wanted = lambda x: ~x["base"] & F.array_contains(codes, x["kind"] * 6912 + x["shape"])
    return let(spans, lambda found: F.when(F.exists(found, wanted), free_of_base(found, wanted)).otherwise(F.filter(found, lambda x: x["base"])))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``spans`` (start, kind, end, base, votes, shape, term) of each row: base spans and added ones."""
    narrow = staged(docs.select(F.col(id_col).alias("doc_id"), candidates(F.col(text_col)).alias("spans")), "pii-candidates")
    return narrow.select("doc_id", accepted(F.col("spans"), trained(narrow)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap become one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.when(
        x["start"] >= a["at"],
        F.struct(x["end"].alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, x["start"] - a["at"]), F.get(names, x["kind"])).alias("out")),
    ).otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out")))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in its text; other columns unchanged; nothing is shuffled."""
    found = docs.select(F.struct(*docs.columns).alias("__row"), candidates(F.col(text_col)).alias("spans"))
    found = staged(found, "pii-texts")
    spans = accepted(F.col("spans"), trained(found))
    text = let(spans, lambda s: redacted(F.col("__row")[text_col], s))
    return found.select(*[(text if c == text_col else F.col("__row")[c]).alias(c) for c in docs.columns])
