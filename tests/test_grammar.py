import re
from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestra.functions import grammar


def values(spark, texts, make):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.v for r in rows.select("k", make(F.col("t")).alias("v")).orderBy("k").collect()]


def test_identifiers(spark):
    texts = ["A", "a-b.c:d_e", "-a", "", "a" * 128, "a" * 129, "a\n", "ä", "a b"]
    assert values(spark, texts, lambda c: c.rlike(grammar.PATTERNS["id"])) == [True, True, False, False, True, False, False, False, False]
    assert values(spark, ["r1", "a:b", "1" * 33], lambda c: c.rlike(grammar.PATTERNS["rev"])) == [True, False, False]
    assert values(spark, ["x_1", "X", "1x"], lambda c: c.rlike(grammar.PATTERNS["kind"])) == [True, False, False]
    assert values(spark, ["a", "", "a" * 200, "a" * 201, "😀" * 200, "a\tb", "a\x85"], grammar.is_text) == [True, False, True, False, True, False, False]


def expected_time(text):
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,6}))?(Z|[+-]\d\d:\d\d)", text, re.A)
    if not m:
        return None
    try:
        at = datetime(*map(int, m.groups()[:6]), int((m[7] or "0").ljust(6, "0")))
        if m[8] != "Z":
            h, mi = int(m[8][1:3]), int(m[8][4:])
            if h > 23 or mi > 59:
                return None
            at -= timedelta(hours=h, minutes=mi) * (-1 if m[8][0] == "-" else 1)
        return f"{at.replace(tzinfo=UTC):%Y}".zfill(4) + at.strftime("-%m-%dT%H:%M:%S.%fZ")
    except (ValueError, OverflowError):
        return None


def test_timestamps(spark):
    texts = [
        "2024-02-29T23:59:59Z", "2023-02-29T00:00:00Z", "2024-01-01T00:00:60Z", "2024-01-01T24:00:00Z", "2024-01-01T00:00:00", "2024-01-01t00:00:00Z", "2024-01-01T00:00:00.1234567Z",
        "2024-01-01T00:00:00.5+23:59", "2024-01-01T00:00:00-24:00", "0001-01-01T00:00:00+00:01", "9999-12-31T23:59:59-00:01", "0000-01-01T00:00:00Z", "2024-01-01T00:00:00Z\n", "2024-13-01T00:00:00Z", "",
    ]
    assert values(spark, texts, grammar.parse_ts) == [expected_time(t) for t in texts]


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9999), st.integers(0, 13), st.integers(0, 32), st.integers(0, 25), st.integers(0, 61), st.integers(0, 61), st.sampled_from(["", ".1", ".000001", "."]), st.sampled_from(["Z", "+00:00", "-12:30", "+23:59", "+25:00", ""])), min_size=40, max_size=60))
def test_timestamps_match_the_rule(spark, parts):
    texts = ["%04d-%02d-%02dT%02d:%02d:%02d%s%s" % p for p in parts]
    assert values(spark, texts, grammar.parse_ts) == [expected_time(t) for t in texts]


@pytest.mark.parametrize(
    ("path", "rule"),
    [
        ("a/b.txt", None), ("/a", "absolute"), ("a" * 241, "too-long"), ("a\tb?", "control-character"), ("a?b\t", "forbidden-character"), ("a//b", "empty-segment"), ("a/", "empty-segment"),
        ("a/../b", "dot-segment"), ("a/b.", "trailing-dot-or-space"), ("a /b", "trailing-dot-or-space"), ("a/" + "b" * 101, "segment-too-long"), ("a/nul.txt", "reserved-name"), ("Com1 .x/y", "reserved-name"), ("com10", None),
    ],
)
def test_paths(spark, path, rule):
    assert values(spark, [path], grammar.path_rule) == [rule and f"path:{rule}"]


def test_file_names(spark):
    got = values(spark, ["a b.txt", "...", "con.txt", "x" * 120 + ".pdf", "é.jpg"], grammar.sanitized_file_name)
    assert got[:3] == ["a_b.txt", "file", "_con.txt"] and len(got[3]) <= 100 and got[3].endswith(".pdf") and got[4] == "_.jpg"
