import math
from collections import Counter

import pytest

from attestra.llm import licenses

from . import cases

FILES = "id long, path string, text string, extra string"


def test_nearest_ancestor_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.", "x"),
        (2, "a/b/c/file.txt", "no licence words", "x"),
        (3, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3.", "x"),
        (4, "a/b/c/d/file.txt", None, "x"),
        (5, "a/file.txt", "", "x"),
        (6, "z/file.txt", "plain", "x"),
        (7, "a/b/own.py", "code\nLicensed under CC BY-NC 4.0.\nmore code", "x"),
        (8, None, "plain", "x"),
        (9, "top.txt", "All rights reserved.", "x"),
        (9, "top.txt", "All rights reserved.", "x"),
    ]
    got = {r.id: (r.license, r.origin, r.of) for r in licenses.scan(spark.createDataFrame(rows, FILES)).collect()}
    assert got[1] == ("MIT", "own", None) and got[3] == ("GPL-3.0", "own", None)
    assert got[2] == ("GPL-3.0", "inherited", "a/b") and got[4] == ("GPL-3.0", "inherited", "a/b")
    assert got[5] == ("MIT", "inherited", "a") and got[6] == (None, None, None)
    assert got[7] == ("CC-BY-NC-4.0", "own", None) and got[8] == (None, None, None) and got[9][0] == "Proprietary"
    assert licenses.scan(spark.createDataFrame(rows, FILES)).count() == len(rows)


def test_cosines_match_brute_force(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "This is released, under a License", "copyright x y z", "the License License MIT " * 3]
    passages = [" ".join(licenses.words(t)) for t in texts]
    found = spark.createDataFrame(list(enumerate(passages)), "key long, passage string")
    got = {passages[r.key]: (r.license, r.score) for r in licenses.scored(found, threshold=0.0).collect()}
    templates = [(name, Counter(licenses.words(text))) for name, text, *_ in (*licenses.NOTICES, *licenses.TEXTS, *licenses.identifiers())]
    idf = lambda w: 1 + math.log((1 + len(templates)) / (1 + sum(w in c for _, c in templates)))
    vector = lambda c: {w: (1 + math.log(n)) * idf(w) for w, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for passage in passages:
        w = vector(Counter(passage.split()))
        scores = [round(sum(x * v.get(t, 0) for t, x in w.items()) / norm(w) / norm(v), 6) for v in (vector(c) for _, c in templates)]
        best = max(scores)
        name = min(n for (n, _), s in zip(templates, scores, strict=True) if s == best)
        assert got[passage] == (name, pytest.approx(best, abs=2e-6))


def test_null_and_repeated_ids_are_files_of_their_own(spark):
    rows = [(None, "p/a.py", "Released under the MIT License.", "x"), (4, "q/a.py", "Licensed under CC BY 4.0", "x"), (4, "q/b.py", "nothing here", "x"), (None, "r/c.py", "plain", "x")]
    got = sorted((r.id or 0, r.path, r.license) for r in licenses.scan(spark.createDataFrame(rows, FILES)).collect())
    assert got == [(0, "p/a.py", "MIT"), (0, "r/c.py", None), (4, "q/a.py", "CC-BY-4.0"), (4, "q/b.py", None)]


def test_a_notice_inside_a_line_beats_the_folder(spark):
    prose = "the river bank lies near an old mill where boats were built and sold for years "
    rows = [(1, "a/LICENSE", "Released under the MIT License.", "x"), (2, "a/f.py", prose * 4 + "It is Licensed under the Apache License, Version 2.0, " + prose * 4, "x")]
    got = {r.id: (r.license, r.score, r.origin) for r in licenses.scan(spark.createDataFrame(rows, FILES)).collect()}
    assert got[2] == ("Apache-2.0", 1.0, "own")


def test_licence_files_take_the_licence_of_the_nearest_text(spark):
    rows = [(k, f"{k}/LICENSE", text.replace("(c)", "(c) 2021 Some One and others", 1), "x") for k, (_, text) in enumerate(licenses.TEXTS)]
    got = {r.id: r.license for r in licenses.scan(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {k: name for k, (name, _) in enumerate(licenses.TEXTS)}


def test_empty_long_and_clashing(spark):
    assert licenses.scan(spark.createDataFrame([], FILES)).count() == 0
    files = licenses.documents_as_files(cases.odd(spark).withColumnRenamed("lang", "source"))
    assert licenses.scan(files, "doc_id").count() == 10
    long = spark.createDataFrame([(1, "LICENSE", cases.LONG + " licensed under the MIT License " + cases.LONG, "x")], FILES)
    assert licenses.scan(long).count() == 1
