"""Cell grammars as Column expressions: JVM-side, no UDF.

Each grammar gives the cell's typed value, or null and the rule it breaks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. ``\\A`` and ``\\z``: ``$`` would let a line end pass.
PATTERNS = {
    "id": r"\A[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z",
    "rev": r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,31}\z",
    "kind": r"\A[a-z][a-z0-9_]{0,63}\z",
    "digest": r"\Asha256:[0-9a-f]{64}\z",
}
TIMESTAMP = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?(?:Z|[+-][0-9]{2}:[0-9]{2})\z"
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
#: Paths that surely break no rule (but for their length): they need no look at each segment.
PLAIN_PATH = r"\A(?:(?!(?i:con|prn|aux|nul|com[1-9]|lpt[1-9])\x20*(?:[./]|\z))[A-Za-z0-9_.\x20-]{0,99}[A-Za-z0-9_-](?:/(?!\z)|\z))+\z"
ODD_CHARACTER = r'[\p{Cc}\\<>:"|?*]'
CANONICAL_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def is_text(c: Column) -> Column:
    """1 to 200 code points, none of them a control character."""
    return F.length(c).between(1, 200) & ~c.rlike(r"\p{Cc}")


def parse_bool(c: Column) -> Column:
    """Exactly ``true`` or ``false``; a cast would take other words too."""
    return F.when(c == "true", True).when(c == "false", False)


def parse_ts(c: Column) -> Column:
    """The canonical UTC text of a strict timestamp with offset, null if it isn't one.

    The parts are checked before they make a timestamp, as the built-in parser
    takes second 60, year 0 and no offset beyond 18 hours.
    """
    n = F.length(c)
    zulu = c.endswith("Z")
    year, hour, minute, second = (F.substr(c, F.lit(at), F.lit(size)).try_cast("int") for at, size in ((1, 4), (12, 2), (15, 2), (18, 2)))
    fraction = F.rpad(F.substr(c, F.lit(21), F.greatest(n - F.when(zulu, 21).otherwise(26), F.lit(0))), 6, "0")
    local = F.concat(F.substr(c, F.lit(1), F.lit(10)), F.lit(" "), F.substr(c, F.lit(12), F.lit(8)), F.lit("."), fraction).try_cast("timestamp_ntz")
    hours, minutes = F.substr(c, n - 4, F.lit(2)).try_cast("int"), F.substr(c, n - 1, F.lit(2)).try_cast("int")
    offset = F.when(zulu, 0).otherwise((hours * 60 + minutes) * F.when(F.substr(c, n - 5, F.lit(1)) == "-", -1).otherwise(1))
    fits = (year >= 1) & (hour <= 23) & (minute <= 59) & (second <= 59) & (zulu | ((hours <= 23) & (minutes <= 59)))
    utc = F.timestamp_add("MINUTE", -offset, local)
    text = F.date_format(F.when(c.rlike(TIMESTAMP) & fits, utc), CANONICAL_TIME)
    # beyond year 9999 the text has a sign and more digits
    return F.when((F.length(text) == 27) & ~text.startswith("0000"), text)


def path_rule(c: Column) -> Column:
    """The first rule that a relative path breaks, null if it breaks none."""
    odd = F.regexp_extract(c, ODD_CHARACTER, 0)

    def of_segment(s: Column) -> Column:
        base = F.upper(F.rtrim(F.split(s, r"\.", 2)[0]))
        return (
            F.when(s == "", "empty-segment").when(s.isin(".", ".."), "dot-segment").when(s.rlike(r"[. ]\z"), "trailing-dot-or-space")
            .when(F.length(s) > 100, "segment-too-long").when(base.isin(RESERVED), "reserved-name")
        )

    broken = F.get(F.filter(F.transform(F.split(c, "/", -1), of_segment), lambda r: r.isNotNull()), 0)
    rule = (
        F.when(c.startswith("/"), "absolute").when(F.length(c) > 240, "too-long")
        .when(odd.rlike(r"\p{Cc}"), "control-character").when(odd != "", "forbidden-character").otherwise(broken)
    )
    plain = c.rlike(PLAIN_PATH) & (F.length(c) <= 240)
    return F.when(~plain, F.concat(F.lit("path:"), rule))


def parsed(kind: str, c: Column) -> Column | None:
    """What a second column must hold for ``checked`` to judge a cell of this kind; null for kinds that need none."""
    return {"bool": parse_bool, "ts": parse_ts, "path": path_rule}.get(kind, lambda _: None)(c)


def checked(kind: str, c: Column, extra: Column, required: bool) -> tuple[Column, Column]:
    """The cell's value (null if it breaks a rule), and the rule it breaks (null if none).

    ``extra`` is a column that holds ``parsed`` of the cell, so that it is computed once.
    """
    value = c
    if kind in PATTERNS:
        rule = F.when(~c.rlike(PATTERNS[kind]), f"grammar:{kind.upper()}")
    elif kind == "text":
        rule = F.when(~is_text(c), "grammar:TEXT")
    elif kind in ("bool", "ts"):
        rule, value = F.when(extra.isNull(), f"grammar:{kind.upper()}"), extra
    elif kind == "path":
        rule = extra
    else:
        rule = F.when(~c.isin(kind.split("|")), f"enum:{kind}")
    rule = F.when(c.isNull(), F.lit("required" if required else None).cast("string")).otherwise(rule)
    return value, rule


def sanitized_file_name(c: Column) -> Column:
    """One safe path segment for a file's name: odd characters become ``_``, at most 100 characters."""
    s = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_"), r"\.+\z", "")
    s = F.when(s == "", "file").otherwise(s)
    s = F.when(F.upper(F.split(s, r"\.", 2)[0]).isin(RESERVED), F.concat(F.lit("_"), s)).otherwise(s)
    ending = F.regexp_extract(s, r"\A.+?(\.[^.]*)\z", 1)
    short = F.concat(F.substring(s, 1, 83), F.lit("~"), F.substring(F.sha2(c.cast("binary"), 256), 1, 8), ending)
    return F.when(F.length(s) > 100, F.substring(short, 1, 100)).otherwise(s)
