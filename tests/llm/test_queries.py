"""Every registered query of the subpackage over the smallest tables, against SQL or brute force."""

import os
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from attestra.llm import pii, quality, queries

from .test_packing import PATH
from .test_pii import brute as brute_pii
from .test_simhash import brute_components, brute_fingerprint

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the benchmark tables are not here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({queries.SQL[name]})").fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(want)


def test_simhash_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(sorted(fps.items()))
    got = queries.op9_simhash(spark, str(DATA)).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (fps[i], want[i]) for i in fps}


def test_pipeline_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    kept = {i: t for i, t in docs.items() if not any(r.rejects(quality.Measured(t or "")) for r in quality.RULES)}
    bare = defaultdict(list)
    for i, t in kept.items():
        bare["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((-len(t), i))
    once = {min(g)[1] for g in bare.values()}
    fps = sorted((i, brute_fingerprint(kept[i])) for i in once)
    label = brute_components(fps)
    left = {i for i in once if label[i] == i}
    rows = corpus_pipeline.run(spark, str(DATA)).collect()
    assert {r.doc_id for r in rows} == left
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 1024
    # without added spans in these texts, redaction replaces the base spans: token counts follow from it
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    for i in sorted(left)[:60]:
        text, out, at = kept[i], "", 0
        for kind, s, e in (x.split(":") for x in brute_pii(text).split(",") if x):
            s, e = int(s), int(e)
            if s >= at:
                out, at = out + text[at:s] + f"[{kind.upper()}]", e
        out += text[at:]
        assert sum(r.length for r in rows if r.doc_id == i) == len(library.encode(out, add_special_tokens=False).ids) + 1
    assert pii.KINDS[:4] == ("email", "ip", "card", "phone")


def test_pipeline_redacts_added_spans(spark, tmp_path):
    """Local phone numbers and names, with and without cues, are gone from what is packed; look-alikes stay."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    words = [w for w in (Path(__file__).parent / "cases.py").read_text().split() if w.isalpha()]
    shown = [
        lambda k: (f"please call 423-555-{1000 + k} and", "please call [LOCAL_PHONE] and"), lambda k: ("contact Dr. Maria Keller and", "contact [PERSON] and"),
        lambda k: ("order 111.111.1111 and", None), lambda k: (f"mail a{k}@b.org and", "mail [EMAIL] and"),
    ]
    rows, want = [], {}
    for k in range(240):
        filler = [f"{rng.choice(words)}{rng.randrange(10**6)}x" for _ in range(60)]
        text, clean = shown[k % 4](k)
        rows.append((k, " ".join([*filler[:30], text, *filler[30:]]), "en", "s", 0))
        want[k] = " ".join([*filler[:30], clean or text, *filler[30:]])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].append((r.piece, r.length, r.ids_crc32))
    assert set(got) == set(want)
    for k, pieces in got.items():
        ids = [*library.encode(want[k], add_special_tokens=False).ids, 2]
        assert len(pieces) == 1 and pieces[0][1:] == (len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(DATA))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_survive_a_megabyte_of_white_space(spark):
    prose = " ".join(f"word{k} of line{k}," for k in range(40))
    rows = [(1, f"{prose}{' ' * 10**6}{prose[::-1]}", "en", "s", 0), (2, prose + "\n" * 10**6, "en", "s", 0), (3, " " * 10**6, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(DATA))
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {1, 2}
