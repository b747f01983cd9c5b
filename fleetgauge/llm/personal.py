"""Personal data in texts: base rules, and a linear-chain conditional random field over word-shape features.

A text is cut into tokens: runs of letters (any non-ASCII byte counts as one), runs of digits, single other characters.
``NAMES`` lists the features of a token: shapes and words of the token and its neighbours, hashed to ``BITS`` bits each.
Tags are outside, begin and inside of each kind; a line is a sequence, so no span goes over a line break.

Training takes a small labelled table ``(text, spans)``: ``SEEDS`` sentences made from the frames below, and at most
``LINES`` lines of the corpus (from the ``DOCS`` documents with the smallest hashed ids) that the base rules label; lines with
digits or ``@`` of which the rules find nothing are not taken, as their label is unknown. One task fits the field
to that bounded table by forward and backward sums and gradient steps with a rate per weight. The model, at most one row of weights per hashed
feature, goes to the tasks.

Decoding is exact Viterbi in numpy batches. Before it, tokens that can't be inside any span are set aside: an upper bound of
what each token adds over "outside" is summed by a running maximum from both sides, and where no stretch through the token
can gain, the best path is outside. Only the remaining stretches are decoded, grouped by length.

Spans of the field that touch one of the base rules', or can't be of their kind (``holds``), are dropped; base spans always stay.

Defined cases: null text is empty; spans count code points, end exclusive, sorted by start, then kind as in ``KINDS``, then end;
repeated rows get a row each; with an empty table of documents the model comes from the seeds alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm.common import by_text, steps
from fleetgauge.llm.words import LOWER, bytes_of, mix, powers, prefix
from fleetgauge.session import stored

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "id")
SEEDS, LINES, DOCS = 1200, 512, 256
LINE_CHARS = 600
BITS = 14
EPOCHS, BATCH, RATE, L2 = 14, 128, 0.5, 1e-3
SCAN_BYTES = 1 << 20

Span = tuple[str, int, int]

# fixed values: the base patterns (an email is found from its @, see _emails) and what a match must hold
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)
#: A text without any of these has no base span.
HINT = r"@|\+[0-9]|[0-9]\.[0-9]|[0-9][\x20-]?[0-9][\x20-]?[0-9]"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    # one step per @ instead of a search from every character of a long run: all starts of a run share the @ that follows
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            free = m.end()
        else:
            # characters before a failed @ can begin no later match
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def rule_spans(text: str) -> Iterator[Span]:
    """Matches of the base rules that hold what they must, per kind leftmost and non-overlapping."""
    yield from _emails(text)
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text):
        if PHONE_DIGITS[0] <= sum(map(str.isdigit, m[0])) <= PHONE_DIGITS[1]:
            yield "phone", m.start(), m.end()


def holds(kind: str, found: str) -> bool:
    """Whether what the field found can be of its kind: the same conditions that the rules set, but any separators."""
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= PHONE_DIGITS[1]
    if kind == "ip":
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "email":
        return re.search(r"@|\bat\b", found) is not None
    return kind != "id" or len(digits) >= 6


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


# ---- tokens and features

SPACE, LETTER, DIGIT, OTHER, BREAK = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[[9, 11, 12, 32]] = SPACE
CLASS[[10, 13]] = BREAK

#: Features of a token, named by what they read: shapes (s) and words (w) at distances, and the gap before the token.
NAMES = ("s", "s-1", "s+1", "s-2 s-1 s", "s-1 s s+1", "s s+1 s+2", "w", "w-1 s", "w-2 w-1", "w-3 s", "gap s", "w+1 s")


class Tokens:
    """Tokens of a string column: byte range, row and code points before them; every row ends with a break."""

    def __init__(self, column: pa.Array):
        line, none = (pa.scalar(x, pa.large_string()) for x in ("\n", ""))
        ended = pc.binary_join_element_wise(column.cast(pa.large_string()).fill_null(""), none, line)
        data, offsets = bytes_of(ended)
        cls = CLASS[data]
        edge = np.ones(len(data), bool)
        if len(data):
            edge[1:] = (cls[1:] != cls[:-1]) | (cls[1:] >= OTHER)
        bounds = np.append(np.flatnonzero(edge), len(data))
        held = np.flatnonzero(cls[bounds[:-1]] != SPACE)
        self.start, self.end = bounds[held], bounds[held + 1]
        self.data, self.offsets, self.cls = data, offsets, cls[self.start]
        self.breaks = self.cls == BREAK

    def shape_and_word(self) -> tuple[np.ndarray, np.ndarray]:
        a, b, data = self.start, self.end, self.data
        upper = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
        n_upper, length = upper[b] - upper[a], b - a
        first = upper[a + 1] - upper[a]
        letters = 512 + 8 * np.minimum(length, 4) + 4 * first + 2 * (n_upper == length) + (n_upper > first)
        shape = np.where(self.cls == LETTER, letters, np.where(self.cls == DIGIT, 1024 + np.minimum(length, 24), data[a]))
        up, down = powers(len(data) + 1)
        sums = prefix(LOWER[data], up)
        word = mix((sums[b] - sums[a]) * down[a] + length.astype(np.uint64))
        return shape.astype(np.uint64), np.where(self.cls == DIGIT, shape.astype(np.uint64), word)

    def features(self) -> list[np.ndarray]:
        """One array per name in NAMES: the hashed value, below 2^BITS."""
        s, w = self.shape_and_word()
        n = len(s)
        gap = np.ones(n, np.uint64)
        gap[1:] = self.start[1:] > self.end[:-1]

        def at(values: np.ndarray, by: int) -> np.ndarray:
            out = np.full(n, 10, np.uint64)
            if by < 0:
                out[-by:] = values[:by]
            elif by < n:
                out[:n - by] = values[by:]
            return out

        p, q, pp, qq = at(s, -1), at(s, 1), at(s, -2), at(s, 2)
        k = np.uint64(1 << 12)
        values = (s, p, q, (pp * k + p) * k + s, (p * k + s) * k + q, (s * k + q) * k + qq, w, at(w, -1) * np.uint64(3) + s,
                  at(w, -2) * np.uint64(5) + at(w, -1), at(w, -3) * np.uint64(7) + s, gap * k + s, at(w, 1) * np.uint64(11) + s)
        return [(mix(v + np.uint64(977 * (i + 1))) >> np.uint64(64 - BITS)).astype(np.int64) for i, v in enumerate(values)]


TAGS = 1 + 2 * len(KINDS)  # 0 outside, 2k+1 begins kind k, 2k+2 goes on with it
NEVER = -1e4
ALLOWED = np.ones((TAGS, TAGS), bool)
for _k in range(len(KINDS)):
    ALLOWED[:, 2 * _k + 2] = False
    ALLOWED[2 * _k + 1:2 * _k + 3, 2 * _k + 2] = True


class Model:
    """Weights ``(feature, tag)`` of hashed features, ``name * 2^BITS + value``, and of steps from tag to tag."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights = weights.astype(np.float32)
        self.moves = np.where(ALLOWED, moves, NEVER).astype(np.float32)
        # what a feature can add at most over "outside", and what entering, staying and leaving can
        self.most = (self.weights[:, 1:].max(axis=1) - self.weights[:, 0]).astype(np.float64)
        self.enter = float((self.moves[:, 1:]).max() - self.moves[0, 0])
        self.leave = max(0.0, float(self.moves[1:, 0].max() - self.moves[0, 0]))

    def emissions(self, features: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), TAGS), np.float32)
        for i, f in enumerate(features):
            out += self.weights[f[at] + (i << BITS)]
        return out

    def stretches(self, features: list[np.ndarray], breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of tokens outside which the best path is surely "outside"."""
        gain = np.full(len(breaks), self.enter)
        for i, f in enumerate(features):
            gain += self.most[f + (i << BITS)]
        gain[breaks] = NEVER
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        left = sums[1:] - np.minimum.accumulate(sums[:-1])
        right = np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]
        live = np.zeros(len(gain) + 2, np.int8)
        # the slack is for the sums' rounding and only makes more tokens live
        live[1:-1] = (left + right - gain + self.leave > -1e-3) & ~breaks
        step = np.diff(live)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def decode(self, features: list[np.ndarray], breaks: np.ndarray) -> np.ndarray:
        """The tag of every token on the best path."""
        tags = np.zeros(len(breaks), np.int8)
        first, last = self.stretches(features, breaks)
        order = np.argsort(last - first, kind="stable")
        first, length = first[order], (last - first)[order]
        at = 0
        while at < len(first):
            # stretches of like length together, about 2^16 tokens a time; a longer one is a time of its own
            to = at + 1
            while to < len(first) and (to + 1 - at) * length[to] <= 1 << 16 and length[to] <= 2 * length[at] + 8:
                to += 1
            self._viterbi(features, tags, first[at:to], length[at:to])
            at = to
        return tags

    def _viterbi(self, features, tags, first, length) -> None:
        rows, most = len(first), int(length[-1])
        inside = np.arange(most)[None, :] < length[:, None]
        where = (first[:, None] + np.arange(most)[None, :])[inside]
        scores = np.zeros((rows, most, TAGS), np.float32)
        scores[inside] = self.emissions(features, where)
        back = np.zeros((rows, most, TAGS), np.int8)
        best = self.moves[0][None, :] + scores[:, 0]
        final = np.zeros(rows, np.int64)

        def close(at: int) -> None:
            done = length == at + 1
            if done.any():
                final[done] = (best[done] + self.moves[:, 0]).argmax(axis=1)

        close(0)
        for t in range(1, most):
            step = best[:, :, None] + self.moves[None]
            back[:, t] = step.argmax(axis=1)
            best = step.max(axis=1) + scores[:, t]
            close(t)
        path = np.zeros((rows, most), np.int8)
        now = final
        for t in range(most - 1, -1, -1):
            here = t < length
            path[here, t] = now[here]
            now = np.where(here, back[np.arange(rows), t, now], now)
        tags[where] = path[inside]


def tag_spans(tokens: Tokens, tags: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
    """``row, kind, start, end`` of the tagged spans, in code points of the row."""
    begins = np.flatnonzero(tags % 2 == 1)
    if not len(begins):
        return
    outside = np.append(np.flatnonzero((tags == 0) | (tags % 2 == 1)), len(tags))
    ends = outside[np.searchsorted(outside, begins, side="right")] - 1
    points = np.zeros(len(tokens.data) + 1, np.int64)
    np.cumsum((tokens.data & 0xC0) != 0x80, out=points[1:])
    rows = np.searchsorted(tokens.offsets, tokens.start[begins], side="right") - 1
    base = points[tokens.offsets[rows]]
    starts, stops = points[tokens.start[begins]] - base, points[tokens.end[ends]] - base
    for row, tag, a, b in zip(rows.tolist(), tags[begins].tolist(), starts.tolist(), stops.tolist()):
        yield row, KINDS[tag // 2], a, b


# ---- the labelled table

GIVEN = "Anna Boris Carla David Elena Franz Greta Hugo Irene Jonas Karin Louis Maria Nils Olga Pedro Rosa Sven Tina Victor".split()
FAMILY = "Adler Bianchi Costa Dubois Eriksen Fischer Garcia Hansen Ivanov Jensen Keller Lopez Moreau Novak Olsen Peters Rossi Silva Weber Young".split()
HOSTS = "mail post web office home".split()
ENDS = "com org net de fr es".split()
FRAMES = [
    "{name} can be reached at {email} or {phone}.", "Please write to {email} before noon.", "Call {phone} after six.",
    "My name is {name} and my number is {phone}.", "Dear Mr. {name}, your card {card} was charged.", "Mrs. {name} lives here.",
    "the server {ip} did not answer", "login from {ip} by {email}", "ssn {id} on file", "passport no. {id}, holder {name}",
    "social security number: {id}", "Name: {name}", "Contact: {name}, tel. {phone}", "Tel: {phone}", "E-mail: {email}",
    "Herr {name} wohnt in der Stadt, Telefon {phone}", "Frau {name} schreibt an {email}", "Karte {card} wurde belastet",
    "Monsieur {name} habite ici, tél. {phone}", "Mme {name} a écrit à {email}", "la carte {card} est bloquée",
    "Señor {name} vive aquí, teléfono {phone}", "la tarjeta {card} de {name}", "escribe a {email} hoy",
    "paid with card {card} today", "host {ip} and host {ip}", "fax {phone}", "ask for Dr. {name} at the desk", "mobile: {phone}",
    "credit card number {card}", "send it to {email}, thanks", "address {ip} port {number}", "signed by {name}",
]
PLAIN = [
    "The {word} {word} was {word} in {year}.", "In {year} about {number} of {number} were left.", "It costs {price} euros or {price} dollars.",
    "Version {version} came out on {date}.", "{Word} {word} and {word}. {Word} {word} the {word}.", "See page {number} to {number} of chapter {small}.",
    "At {time} the {word} ended.", "{Word}: {number} items", "a score of {small}-{small} at {time}", "order {number} of {date}", "{word} {word} at {word} {word}",
    "{Word} {word}, {word} {word}.", "i = {number} + {small} - {price}", "{small}. {Word} {word}", "on {date}, {Word} {Word} {word}",
    "section {version}", "{Word} {Word} {Word}", "Mr. and Mrs. came at {time}", "the name of the {word} is {word}", "my card and my phone are {word}",
    "total {price}, tax {price}, sum {price}", "from {year} to {year}", "{word}@{word} is no mail", "isbn {small}-{number}-{number}-{small}",
    'token = "{hex}"', "key: {hex}", "commit {hex} of {date}", "{word} under the {Word} {Word} {Word} License, version {small}", "{word} {hex} {word}",
    "{echo}", "{word}. {echo} {word}", "the {Word} {Word} Foundation in {year}", "Copyright {year} {Word} {Word}", "{Word} and {Word} {Word}",
]


def seeds(n: int = SEEDS, seed: int = 1) -> list[tuple[str, list[Span]]]:
    """``n`` labelled sentences, every third without personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[rng.integers(len(x))]
    digits = lambda k: "".join(str(rng.integers(10)) for _ in range(k))
    syllables = "the an er on re en ti ch ou la que de st ing ble eé ün ño".split()
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))

    def value(slot: str) -> str:
        if slot == "name":
            given = pick(GIVEN) if rng.random() < 0.7 else word().capitalize()
            family = pick(FAMILY) if rng.random() < 0.7 else word().capitalize()
            return pick([f"{given} {family}", f"{given} {family}", f"{given} {pick('ABCDEFGH')}. {family}", f"{given}-{pick(GIVEN)} {family}"])
        if slot == "email":
            user = pick([f"{pick(GIVEN).lower()}.{pick(FAMILY).lower()}", f"{word()}{rng.integers(99)}", f"{pick('abcdefg')}{pick(FAMILY).lower()}"])
            host, end = f"{pick(HOSTS)}{rng.integers(9)}", pick(ENDS)
            return pick([f"{user}@{host}.{end}", f"{user}@{host}.example.{end}", f"{user} [at] {host} [dot] {end}",
                         f"{user} (at) {host} (dot) {end}", f"{user} at {host} dot {end}"])
        if slot == "ip":
            part = lambda: str(rng.integers(256))
            return pick([".", ".", "[.]", " . "]).join(part() for _ in range(4))
        if slot == "card":
            number = digits(15)
            number += next(c for c in "0123456789" if luhn(number + c))
            return pick(["", " ", "-", ".", "  "]).join(number[i:i + 4] for i in range(0, 16, 4))
        if slot == "phone":
            return pick([f"+{rng.integers(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}",
                         f"00{rng.integers(10, 99)} {digits(3)} {digits(7)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)}/{digits(6)}"])
        if slot == "id":
            return pick([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{pick('CFGHJK')}{digits(8)}", f"{pick('XYZ')}{digits(7)}{pick('ABCDEF')}"])
        return {"number": lambda: str(rng.integers(10, 99999)), "small": lambda: str(rng.integers(1, 30)), "year": lambda: str(rng.integers(1800, 2030)),
                "price": lambda: f"{rng.integers(1, 900)}.{digits(2)}", "version": lambda: ".".join(str(rng.integers(20)) for _ in range(rng.integers(2, 4))),
                "date": lambda: pick([f"{rng.integers(1, 28)}.{rng.integers(1, 12)}.{rng.integers(1900, 2030)}", f"{rng.integers(1900, 2030)}-{digits(2)}-{digits(2)}"]),
                "time": lambda: f"{rng.integers(24)}:{digits(2)}", "hex": lambda: rng.bytes(int(rng.integers(4, 24))).hex(),
                "echo": lambda: " ".join([word().capitalize()] * int(rng.integers(3, 30))), "word": word, "Word": lambda: word().capitalize()}[slot]()

    out = []
    for i in range(n):
        frame = pick(PLAIN) if i % 3 == 2 else pick(FRAMES)
        text, spans = "", []
        for j, part in enumerate(re.split(r"\{(\w+)\}", " ".join([word() for _ in range(rng.integers(0, 4))] + [frame]))):
            got = value(part) if j % 2 else part
            if j % 2 and part in KINDS:
                spans.append((part, len(text), len(text) + len(got)))
            text += got
        out.append((text + "".join(f" {word()}" for _ in range(rng.integers(0, 4))), spans))
    return out


LABELLED = "text string, spans array<struct<kind:string,start:bigint,end:bigint>>"


def labelled(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The labelled table: the seed sentences and sampled lines of ``docs`` with the spans of the base rules."""
    # few more rows than DOCS are left before they are sorted, whatever the size of the table
    share = min(1.0, 8 * DOCS / max(1, docs.count()))
    drawn = docs.where("text IS NOT NULL").where(F.expr(f"pmod(xxhash64(doc_id), {1 << 30}L) < {int(share * (1 << 30))}L"))
    picked = drawn.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(DOCS)
    lines = picked.select(F.explode(F.split("text", r"[\r\n]+")).alias("text")).where(f"length(text) BETWEEN 10 AND {LINE_CHARS}")
    lines = lines.distinct().orderBy(F.xxhash64("text"), "text").limit(4 * LINES)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = [{"text": t, "spans": [dict(zip(("kind", "start", "end"), s)) for s in spans]}
                    for t in texts if (spans := clean_spans(t)) is not None]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    def clean_spans(text: str) -> list[Span] | None:
        spans = ordered(rule_spans(text))
        if any(a[2] > b[1] for a, b in zip(spans, spans[1:])):
            return None
        rest = "".join(text[a:b] for a, b in zip([0, *(s[2] for s in spans)], [*(s[1] for s in spans), len(text)]))
        return None if re.search(r"[0-9@]", rest) else spans

    known = lines.mapInArrow(label, LABELLED).orderBy(F.xxhash64("text"), "text").limit(LINES)
    return spark.createDataFrame(seeds(), LABELLED).unionByName(known)


ARROW = pa.schema([("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def _true_tags(tokens: Tokens, spans: list[list[dict]]) -> np.ndarray:
    points = np.zeros(len(tokens.data) + 1, np.int64)
    np.cumsum((tokens.data & 0xC0) != 0x80, out=points[1:])
    rows = np.searchsorted(tokens.offsets, tokens.start, side="right") - 1
    start = points[tokens.start] - points[tokens.offsets[rows]]
    tags = np.zeros(len(rows), np.int64)
    firsts = np.searchsorted(rows, np.arange(len(spans) + 1))
    for row, some in enumerate(spans):
        a, b = firsts[row], firsts[row + 1]
        for s in some or []:
            hit = a + np.flatnonzero((start[a:b] >= s["start"]) & (start[a:b] < s["end"]))
            if s["kind"] in KINDS and len(hit):
                tags[hit] = 2 * KINDS.index(s["kind"]) + 2
                tags[hit[0]] -= 1
    return tags


def fit(texts: list[str], spans: list[list[dict]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their weights and the weights of steps, by gradient steps on the log-likelihood of the rows."""
    tokens = Tokens(pa.array(texts, pa.string()))
    hashed = np.stack([f + (i << BITS) for i, f in enumerate(tokens.features())], axis=1)
    tags = _true_tags(tokens, spans)
    names, compact = np.unique(hashed, return_inverse=True)
    compact = compact.reshape(hashed.shape)
    rows = np.searchsorted(tokens.offsets, tokens.start, side="right") - 1
    firsts = np.searchsorted(rows, np.arange(len(texts) + 1))
    size = np.diff(firsts)
    weights, moves = np.zeros((len(names), TAGS)), np.zeros((TAGS, TAGS))
    sq_w, sq_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        batches = np.array_split(np.argsort(size + rng.random(len(size)) * 8, kind="stable"), max(1, len(size) // BATCH))
        for i in rng.permutation(len(batches)):
            which = batches[i]
            if not len(which) or not size[which].max():
                continue
            most = int(size[which].max())
            inside = np.arange(most)[None, :] < size[which][:, None]
            at = firsts[which][:, None] + np.minimum(np.arange(most)[None, :], np.maximum(size[which][:, None] - 1, 0))
            flat = at[inside]
            grad_w, grad_m = _gradient(weights, moves, compact[at], tags[at], inside)
            used, back = np.unique(compact[flat], return_inverse=True)
            back, each = back.reshape(-1), np.repeat(grad_w[inside], compact.shape[1], axis=0)
            sums = np.stack([np.bincount(back, each[:, t], len(used)) for t in range(TAGS)], axis=1)
            sums = sums / len(which) - L2 * weights[used]
            sq_w[used] += sums * sums
            weights[used] += RATE * sums / np.sqrt(sq_w[used])
            grad_m = np.where(ALLOWED, grad_m / len(which) - L2 * moves, 0.0)
            sq_m += grad_m * grad_m
            moves += RATE * grad_m / np.sqrt(sq_m)
    return names, weights, moves


def _gradient(weights, moves, features, tags, inside) -> tuple[np.ndarray, np.ndarray]:
    """Observed minus expected tags (per row and token) and steps (summed), by scaled forward and backward sums."""
    rows, most = tags.shape
    scores = weights[features].sum(axis=2)
    scores -= scores.max(axis=2, keepdims=True)
    likely = np.exp(np.maximum(scores, -60.0))
    step = np.where(ALLOWED, np.exp(np.clip(moves, -30, 30)), 0.0)
    ahead, after = np.zeros((most, rows, TAGS)), np.zeros((most, rows, TAGS))
    scale = np.ones((most, rows))
    now = step[0][None, :] * likely[:, 0]
    for t in range(most):
        if t:
            now = np.where(inside[:, t, None], (ahead[t - 1] @ step) * likely[:, t], ahead[t - 1])
        scale[t] = now.sum(axis=1)
        ahead[t] = now / scale[t][:, None]
    now = np.broadcast_to(step[:, 0], (rows, TAGS)).copy()
    for t in range(most - 1, -1, -1):
        if t < most - 1:
            # rows that end at t or before keep what leaving adds
            now = np.where(inside[:, t + 1, None], (likely[:, t + 1] * after[t + 1]) @ step.T, after[t + 1])
        after[t] = now / now.sum(axis=1)[:, None]
    share = ahead * after
    share /= share.sum(axis=2)[:, :, None]
    share = share.transpose(1, 0, 2)
    seen = np.zeros_like(share)
    np.put_along_axis(seen, tags[:, :, None], 1.0, axis=2)
    moved = np.zeros((TAGS, TAGS))
    for t in range(1, most):
        both = inside[:, t]
        if not both.any():
            break
        pair = ahead[t - 1][both][:, :, None] * step[None] * (likely[both, t] * after[t][both])[:, None, :]
        pair /= pair.sum(axis=(1, 2))[:, None, None]
        moved -= pair.sum(axis=0)
        np.add.at(moved, (tags[both, t - 1], tags[both, t]), 1.0)
    moved[0] += seen[:, 0].sum(axis=0) - share[:, 0].sum(axis=0)
    last = inside.sum(axis=1) - 1
    here = last >= 0
    picked = np.arange(rows)[here], last[here]
    moved[:, 0] += seen[picked].sum(axis=0) - share[picked].sum(axis=0)
    return np.where(inside[:, :, None], seen - share, 0.0), moved


def train(rows: DataFrame) -> DataFrame:
    """``feature, weights`` of the field; feature -1 - t holds the steps out of tag t. ``rows`` is a labelled table of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for batch in batches for r in batch.to_pylist() if r["text"]]
        names, weights, moves = fit([r["text"] for r in got], [r["spans"] for r in got])
        kept = np.flatnonzero(np.abs(weights).max(axis=1, initial=0.0) > 0)
        numbers = [*names[kept].tolist(), *(-1 - t for t in range(TAGS))]
        yield pa.RecordBatch.from_pydict({"feature": numbers, "weights": [*weights[kept].tolist(), *moves.tolist()]})

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("text"), "text")
    return stored(one.mapInArrow(run, "feature long, weights array<double>"), "personal-model")


def read_model(model: DataFrame) -> Model:
    """The model of at most ``len(NAMES) * 2^BITS + TAGS`` rows, a bound that does not depend on the data."""
    weights, moves = np.zeros((len(NAMES) << BITS, TAGS)), np.zeros((TAGS, TAGS))
    got = model.toArrow()
    feature = got.column("feature").to_numpy()
    values = got.column("weights").combine_chunks().flatten().to_numpy().reshape(-1, TAGS)
    weights[feature[feature >= 0]] = values[feature >= 0]
    moves[-1 - feature[feature < 0]] = values[feature < 0]
    return Model(weights, moves)


def all_spans(column: pa.Array, model: Model) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text."""
    hint = pc.fill_null(pc.match_substring_regex(column, HINT), False).to_pylist()
    base = [ordered(rule_spans(column[i].as_py())) if there else [] for i, there in enumerate(hint)]
    every = [list(b) for b in base]
    tokens, texts = Tokens(column), {}
    for row, kind, a, b in tag_spans(tokens, model.decode(tokens.features(), tokens.breaks)):
        if row not in texts:
            texts[row] = column[row].as_py()
        if holds(kind, texts[row][a:b]) and not any(x < b and a < y for _, x, y in base[row]):
            every[row].append((kind, a, b))
    return base, [ordered(s) for s in every]


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, base, found``: the spans as text, ``kind:start:end`` joined by commas."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [all_spans(piece.column("text"), model) for piece in steps(batch, size=SCAN_BYTES)]
        base, found = ([joined(s) for p in parts for s in p[i]] for i in (0, 1))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.string()), pa.array(found, pa.string())],
                                          ["doc_id", "base", "found"])

    return by_text(docs, ["doc_id", "text"], run, f"doc_id {dict(docs.dtypes)['doc_id']}, base string, found string")


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Trains on seeds and sampled lines of ``docs`` and scans every whole text of it."""
    return scan(docs, read_model(train(labelled(spark, docs))))
