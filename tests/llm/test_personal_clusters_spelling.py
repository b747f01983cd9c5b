"""Personal data, centroid clusters and spelling variants against brute force."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import centroids, personal, spelling

# personal data


@pytest.fixture(scope="module")
def model():
    rows = personal.seeds(900)
    names, weights, moves = personal.fit([t for t, _ in rows], [[dict(zip(("kind", "start", "end"), s)) for s in spans] for _, spans in rows])
    whole = np.zeros((len(personal.NAMES) << personal.BITS, personal.TAGS))
    whole[names] = weights
    return personal.Model(whole, moves)


def plain_rules(text):
    """The base rules by searches from every position."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], personal.KINDS.index(s[0])))


def test_base_rules_equal_plain_searches():
    rng = random.Random(3)
    for alphabet, n in (("a@.b-%1 ", 6000), ("0125. -", 6000), ("+1234 ()-.5", 4000), ("4 -0é", 3000)):
        for _ in range(n):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            assert personal.ordered(personal.rule_spans(text)) == plain_rules(text), text


def test_long_runs_take_linear_time():
    start = time.perf_counter()
    text = "a" * 400_000 + " " + "1" * 400_000 + " " + "1.2.3." * 60_000 + "+1" + " " * 200_000 + "@" * 100_000
    kinds = Counter(k for k, *_ in personal.rule_spans(text))
    assert kinds == {"ip": 45_000} and time.perf_counter() - start < 20


def test_hint_misses_no_rule():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("a@.+12 (-") for _ in range(rng.randint(0, 40)))
        assert re.search(personal.HINT, text) or not list(personal.rule_spans(text))


def test_viterbi_and_set_aside_tokens_equal_all_paths(model):
    rng = np.random.default_rng(5)
    names = len(personal.NAMES) << personal.BITS
    for _ in range(30):
        weights = np.zeros((names, personal.TAGS))
        values = rng.integers(0, 4, 4)
        weights[:4] = rng.normal(size=(4, personal.TAGS)) * 2
        small = personal.Model(weights, rng.normal(size=(personal.TAGS, personal.TAGS)))
        features = [values] + [np.full(4, 100)] * (len(personal.NAMES) - 1)
        got = small.decode(features, np.zeros(4, bool))

        def worth(path):
            steps = [0, *path, 0]
            return sum(small.moves[a, b] for a, b in itertools.pairwise(steps)) + sum(small.weights[v, t] for v, t in zip(values, path))

        allowed = range(5)  # two kinds are enough for all paths to be tried
        small.weights[:, 5:] = small.moves[:, 5:] = -1e4
        small.most = (small.weights[:, 1:].max(axis=1) - small.weights[:, 0]).astype(float)
        got = small.decode(features, np.zeros(4, bool))
        best = max(worth(p) for p in itertools.product(allowed, repeat=4))
        assert worth(got.tolist()) == pytest.approx(best, abs=1e-3)


def test_long_texts_decode_as_whole_sequences(model):
    texts = [t for t, _ in personal.seeds(300, 8)]
    tokens = personal.Tokens(pa.array(texts))
    features = tokens.features()
    fast = model.decode(features, tokens.breaks)
    model_all = personal.Model(model.weights, model.moves)
    model_all.stretches = lambda f, breaks: (np.flatnonzero(np.diff(np.r_[0, ~breaks, 0].astype(int)) == 1),
                                             np.flatnonzero(np.diff(np.r_[0, ~breaks, 0].astype(int)) == -1))
    assert (model_all.decode(features, tokens.breaks) == fast).all()


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    weights, moves = rng.normal(size=(6, personal.TAGS)), rng.normal(size=(personal.TAGS, personal.TAGS))
    features, tags = rng.integers(0, 6, (1, 3, 2)), np.array([[0, 1, 2]])
    inside = np.ones((1, 3), bool)

    def likelihood(w, m):
        m = np.where(personal.ALLOWED, m, -np.inf)
        e = w[features[0]].sum(axis=1)
        now = m[0] + e[0]
        for t in (1, 2):
            now = np.logaddexp.reduce(now[:, None] + m, axis=0) + e[t]
        path = tags[0]
        own = m[0, path[0]] + m[path[0], path[1]] + m[path[1], path[2]] + m[path[2], 0] + sum(e[t, path[t]] for t in range(3))
        return own - np.logaddexp.reduce(now + m[:, 0])

    grad_w, grad_m = personal._gradient(weights, moves, features, tags, inside)
    for a, b in ((0, 0), (0, 1), (1, 2), (2, 0), (3, 4)):
        step = np.zeros_like(moves)
        step[a, b] = 1e-5
        assert grad_m[a, b] == pytest.approx((likelihood(weights, moves + step) - likelihood(weights, moves - step)) / 2e-5, abs=1e-5)
    for f, t in ((features[0, 0, 0], 0), (features[0, 2, 1], 3)):
        step = np.zeros_like(weights)
        step[f, t] = 1e-5
        mine = sum(grad_w[0, i, t] * (features[0, i] == f).sum() for i in range(3))
        assert mine == pytest.approx((likelihood(weights + step, moves) - likelihood(weights - step, moves)) / 2e-5, abs=1e-5)


def test_held_out_sentences(model):
    rows = personal.seeds(400, 77)
    _, found = personal.all_spans(pa.array([t for t, _ in rows]), model)
    hit = sum(len(set(a) & set(b)) for a, (_, b) in zip(found, rows))
    assert hit > 0.9 * sum(len(b) for _, b in rows) and hit > 0.9 * sum(map(len, found))


def test_base_spans_stay_and_field_spans_touch_none(model):
    texts = ["write to ann@mail.example.com today. E-mail: anna.weber (at) mail3 (dot) com", "card 4111 1111 1111 1111, tel: (555) 123-4567", None, "", "é" * 50 + " 1.2.3.4"]
    base, every = personal.all_spans(pa.array(texts, pa.string()), model)
    assert [set(b) <= set(e) for b, e in zip(base, every)] == [True] * 5
    assert base[0] == [("email", 9, 29)] and len(every[0]) == 2 and every[0][1][0] == "email"
    assert base[1] == [("card", 5, 24)] and every[1][1][0] == "phone"
    assert base[2:] == [[], [], [("ip", 51, 58)]]


def test_personal_odd_input(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(personal, "EPOCHS", 1)
    got = personal.find(spark, odd).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 3, 4, 5, 5, 6] and all(r.base == "" for r in got)
    assert personal.find(spark, empty).collect() == []
    model = personal.read_model(personal.train(spark.createDataFrame([("x", [])], personal.LABELLED)))
    long = spark.createDataFrame([(1, "word " * 400_000 + "a@b.cd")], "doc_id long, text string")
    assert personal.scan(long, model).first().base == "email:2000000:2000006"


# centroid clusters

def test_nearest_equals_all_distances():
    rng = np.random.default_rng(2)
    for spread in (2, 5, 1000):
        x, c = rng.integers(-spread, spread, (500, 6)), rng.integers(-spread, spread, (8, 6))
        c[5] = c[2]
        who, distance = centroids.nearest(x, c)
        every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (who == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def plain_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: ((0, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()) if r[0] is not None else (1, ""), r[1]))
    c = [v for _, v in starts[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, z)), j) for j, z in enumerate(c))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        c = [[sum(x) // len(members[j]) for x in zip(*members[j])] if members[j] else c[j] for j in range(len(c))]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    own = Counter()
    for _, j, d in last:
        own[j] += d
    return sorted(((i, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in last), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("x"), "v": F.lit(1), "c": F.lit(2)})


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).round(1).tolist()) for i in range(60)]
    rows += [(7, rows[9][1]), (7, rows[9][1]), (None, rows[3][1]), (70, None), (71, [1.0]), (72, [None] + [0.0] * 63),
             (73, [float("nan")] + [0.0] * 63), (74, [float("inf")] + [0.0] * 63), (75, [0.0] * 64), (76, [])]
    got = sorted((tuple(r) for r in centroids.clusters(vectors(spark, rows)).collect()), key=str)
    assert got == plain_clusters(rows, 8, 10)


def test_few_no_and_far_vectors(spark):
    rows = [(1, [0.5] * 64), (2, [0.25] * 64)]
    assert sorted((tuple(r) for r in centroids.clusters(vectors(spark, rows)).collect()), key=str) == plain_clusters(rows, 8, 10)
    assert centroids.clusters(vectors(spark, [])).collect() == []
    far = centroids.clusters(vectors(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)]), k=1, rounds=0).collect()
    assert sorted(r.distance for r in far) == [0, 64 * (2 * centroids.LIMIT) ** 2]


# spelling variants

def plain_variants(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def close(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out, form, count = [], {}, {}
    for w in n:
        near = [x for x in n if close(w, x)]
        top = min(near, key=lambda x: (-n[x], x), default=None)
        count[w] = len(near)
        if top and n[top] >= 2 * n[w]:
            form[w] = top
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], count[w], n[form[w]] if w in form else None))
    return sorted(out)


def spelling_rows(seed, letters, size):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(size)]
    return [(i if i % 9 else None, " ".join(rng.choices(words, k=60)) + ", É×÷ÿÀ ÉÉÉÉÉÉ ÉÉÉÉÉÈ x") for i in range(120)] + [(1, None), (2, ""), (3, "straße STRASSE")]


@pytest.mark.parametrize("seed, letters, size, node, groups", [
    (1, "abé", 400, 1 << 17, spelling.GROUPS), (2, "abcÉ", 500, 300, spelling.GROUPS), (4, "ab", 200, 8, 2)])
def test_variants_equal_brute_force(spark, monkeypatch, seed, letters, size, node, groups):
    # the driver alone divides nodes, here down to level ``groups``, where what is left is divided by hash
    monkeypatch.setattr(spelling, "NODE_CHARS", node)
    monkeypatch.setattr(spelling, "GROUPS", groups)
    rows = spelling_rows(seed, letters, size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("y") for c in ("word", "n", "node", "run", "id", "h", "s", "d")})
    assert sorted(tuple(r) for r in spelling.variants(docs).collect()) == plain_variants(rows)


@pytest.mark.parametrize("few, states", [(1, 50), (0, 7), (3, 1 << 18)])
def test_the_trie_reaches_what_the_budget_allows(monkeypatch, few, states):
    monkeypatch.setattr(spelling, "FEW", few)
    monkeypatch.setattr(spelling, "STATES", states)
    words = sorted({w for _, t in spelling_rows(3, "abc", 400) for w in re.findall("[a-zÀ-ÿ]{5}", t or "")})
    v = spelling.vectors_of(*spelling.letters_of(pa.array(words)))
    got = {(int(a), int(b)) for q, w in spelling.Trie(v).reach(v, np.ones(len(v)), np.ones(len(v))) for a, b in zip(q, w)}
    want = {(i, j) for i in range(len(v)) for j in range(len(v)) if (v[j] - v[i]).clip(0).sum() <= 1 and (v[i] - v[j]).clip(0).sum() <= 1}
    assert want <= got and (few or want == got)


def test_spelling_odd_input(spark, odd, empty):
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(odd).collect() == []
    long = spark.createDataFrame([(1, ("word" * 30_000 + " ") * 3 + ("word" * 29_999 + "wort ") * 9)], "doc_id long, text string")
    assert sorted((len(r.word), r.n, r.n_near, r.form_n) for r in spelling.variants(long).collect()) == [(120_000, 3, 1, 9), (120_000, 9, 1, None)]


def test_a_long_chain_of_forms_ends_at_its_root(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(40)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w40"}
