import random
from array import array

import public_tokenizers
import sentencepiece

from attestra.llm import unigram

from . import cases

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(model, text):
    """(score, ids) of the best path: of equal scores, the last piece that starts first."""
    scores = {p: (s, i) for p, (i, _, s) in model.scored}
    text = unigram.MARK + text.replace(" ", unigram.MARK) if text else ""
    best = [(0.0, None, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            if text[start:end] in scores:
                s, i = scores[text[start:end]]
                found, ids = best[start][0] + s, [i]
            elif end - start == 1:
                found, ids = best[start][0] + model.unknown, [model.byte_ids[b] for b in text[start].encode()]
            else:
                continue
            if best[end] is None or found > best[end][0]:
                best[end] = (found, start, ids)
    out, at = [], len(text)
    while at:
        out = best[at][2] + out
        at = best[at][1]
    return best[len(text)][0], out


def samples():
    rng = random.Random(1)
    parts = ["the", "re", "of", " ", "  ", "hello", "wörld", "你", "벨", "\n", "\t", "😀", "ing", ".", "a", "▁"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]


def test_paths_and_counts_match_brute_force():
    model = unigram.Unigram(PATH)
    for text in samples():
        score, ids = brute(model, text)
        assert list(array("I", model.encode(text))) == ids
        assert model.count(text) == (len(ids), score)


def test_best_score_is_that_of_the_library_lattice():
    raw = open(PATH, "rb").read()
    at = raw.index(b"\x12\x06tok_v0\x18\x02") + 9  # the model's type: 2 is BPE, 1 is unigram
    library = sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x01" + raw[at + 1 :])
    model = unigram.Unigram(PATH)
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) + " " + "".join(rng.choice("etaoin") for _ in range(4))
        best = max(sum(map(library.get_score, ids)) for ids in library.nbest_encode_as_ids(text, 20))
        assert model.count(text)[1] == best


def test_the_cache_is_bounded_within_a_text(monkeypatch):
    model, whole = unigram.Unigram(PATH), unigram.Unigram(PATH)
    text = " ".join(f"word{k}x" for k in range(500)) + " " + "z" * 900
    want = whole.encode(text), whole.count(text)
    monkeypatch.setattr(unigram, "CACHE", 300)
    monkeypatch.setattr(unigram, "STEP", 20)
    assert (model.encode(text), model.count(text)) == want
    assert len(model.ids_cache) + len(model.count_cache) < 100 and model.cached < 1000


def test_round_trip(spark):
    docs = spark.createDataFrame([(k, t, "en", 0.0) for k, t in enumerate(samples())], cases.TEXT).union(cases.odd(spark))
    back = unigram.decode(unigram.encode(docs, PATH), PATH)
    got = sorted((r.doc_id or -1, r.text) for r in back.select("doc_id", "text").collect())
    assert got == sorted((r.doc_id or -1, (r.text or "").replace("▁", " ")) for r in docs.collect())
    n = {(r.doc_id, r.n_ids) for r in unigram.digested(back).collect()}
    assert n == {(r.doc_id, r.n_tokens) for r in unigram.counts(docs, PATH).collect()}


def test_empty_and_clashing(spark):
    assert unigram.encode(cases.empty(spark), PATH).count() == 0
    assert unigram.counts(cases.clashing(spark), PATH).count() == 1
