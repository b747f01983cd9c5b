"""What the third review found in the numbered operators: CPU time of op1, disk of op10."""

import random

import numpy as np
import pytest

from fleetgauge.llm import backoff, pieces


def test_words_are_encoded_a_level_of_their_trie_at_a_time(monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(21)
    texts = ["".join(rng.choice("aeinst  the\t.é日🙂-") for _ in range(rng.randint(0, 50))) for _ in range(800)]
    texts += [None, "", " ", "a", "a\x00b a\x00", "the thee theme them then", "  double  spaces  ", "end "]
    model = pieces.Model(open(pieces.MODEL, "rb").read())

    def alone(*_):
        raise AssertionError("a state was computed by itself")

    with monkeypatch.context() as m:
        m.setattr(pieces.Model, "step", alone)
        got = model.encode_all(texts)
    assert [x.tolist() for x in got] == [library.encode(t or "") for t in texts]
    # full tables are begun anew, and words that are too long for a trie of levels are encoded as before
    for name, n in (("KEPT", 1), ("KEPT_PAIRS", 1), ("LEVELS", 3)):
        monkeypatch.setattr(pieces, name, n)
        model = pieces.Model(open(pieces.MODEL, "rb").read())
        assert [x.tolist() for x in model.encode_all(texts)] == [x.tolist() for x in got]


def test_decoding_a_step_tells_each_text(monkeypatch):
    model = pieces.Model(open(pieces.MODEL, "rb").read())
    texts = pieces.marked(pieces.pa.array(["one two", None, "", "▁three", " x"]))
    ids, ends = model.encode_column(texts)
    assert model.restored(texts, ids, ends).all()
    wrong = ids.copy()
    wrong[0] = ids[-1]
    assert model.restored(texts, wrong, ends).tolist() == [False, True, True, True, True]
    assert model.restored(texts, np.append(ids, ids[-1]), ends + (np.arange(6) == 5)).tolist() == [True, True, True, True, False]


def test_packed_pairs_are_small(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(1500)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60)), i) for i in range(1500)]
    keyed = spark.createDataFrame(docs, "doc_id long, text string, doc long").coalesce(1)
    known = backoff.vocabulary(keyed)
    assert known.bits == 11
    hot = (np.zeros(0, np.int64),) * 2
    packed = backoff._packed(keyed, known, hot, 4).selectExpr("sum(length(packed))", "count(*)").first()
    assert packed[0] < 6 * 60 * 1500 and packed[1] < 100


def test_packed_numbers_come_back():
    rng = np.random.default_rng(6)
    lists = [np.array([0, -1, 5, 1 << 62, -(1 << 63)]), np.zeros(0, np.int64), rng.random(7), np.zeros(3, np.int32), rng.random(4).astype(np.float32)]
    back = backoff._unpack(backoff._pack(*lists))
    assert all(np.array_equal(x, y) for x, y in zip(lists, back)) and [x.dtype.kind for x in back] == list("iifif")
    for bits in (1, 7, 20):
        a, b = rng.integers(0, 1 << bits, (2, 50))
        assert all(np.array_equal(x, y) for x, y in zip((a, b), backoff._ids(backoff._keys(a, b, bits), bits)))


def test_pieces_of_the_same_documents_and_pairs_of_rare_words(spark, monkeypatch):
    monkeypatch.setattr(backoff, "BITS", 1)
    monkeypatch.setattr(backoff, "steps", lambda batch: (batch.slice(i, 2) for i in range(0, batch.num_rows, 2)))
    docs = [(1, "a b c c c a a"), (2, "a a c b x x"), (1, "a b c c c a a"), (2, "a a c b x x"), (3, "x x y a"), (4, "c b y x x x"), (5, "z")]
    got = {r.doc_id: r.log_score for r in backoff.scores(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()}
    for i, (doc, text) in enumerate(docs):
        rest = [t.split() for k, (_, t) in enumerate(docs) if k != i]
        count = lambda *g: sum(tuple(t[j:j + len(g)]) == g for t in rest for j in range(len(t)))
        n, words, score = max(1, sum(map(len, rest))), text.split(), 0.0
        for j, w in enumerate(words):
            pair = count(words[j - 1], w) if j else 0
            score += np.log(pair / count(words[j - 1])) if pair else np.log((backoff.BACKOFF if j else 1) * max(count(w), backoff.UNSEEN) / n)
        assert got[doc] == pytest.approx(score, rel=1e-6), doc
