"""Ids against the library with the file as it is, BPE, over whole texts."""

from array import array

import public_tokenizers
import sentencepiece

from attestra.llm import unigram

from . import cases
from .test_unigram import samples

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    return [*samples(), "hello world", "a\0b", "<s> </s> <unk> <0x41>", "  two  spaces ", cases.LONG]


def test_kind_of_file(tmp_path):
    assert unigram.is_bpe(PATH)
    raw = open(PATH, "rb").read()
    at = raw.index(b"\x12\x06tok_v0\x18\x02") + 9
    (tmp_path / "unigram.model").write_bytes(raw[:at] + b"\x01" + raw[at + 1 :])
    assert not unigram.is_bpe(str(tmp_path / "unigram.model"))


def test_ids_are_the_library_s(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    back = unigram.decode(unigram.encode(docs, PATH), PATH).collect()
    assert {r.doc_id: list(array("I", r.ids)) for r in back} == dict(enumerate(map(LIBRARY.encode, texts())))
    assert {r.doc_id: r.text for r in back} == {k: t.replace("▁", " ") for k, t in enumerate(texts())}


def test_counts_are_the_library_s(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    want = {}
    for k, t in enumerate(texts()):
        ids = LIBRARY.encode(t)
        want[k] = len(ids), float(sum(map(LIBRARY.get_score, ids)))
    assert {r.doc_id: (r.n_tokens, r.score) for r in unigram.counts(docs, PATH).collect()} == want
