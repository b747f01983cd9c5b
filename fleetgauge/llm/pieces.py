"""SentencePiece encoding and decoding over a trie of distinct marked words.

A text is marked (a space is written as U+2581, with one before the text) and cut into words, each
with the marks before it; no piece but runs of marks goes over such a cut, so words are encoded apart.
The distinct words of a step are sorted, which is the depth-first order of their trie; going from one
word to the next, the forward states of their common prefix are kept and only the rest is computed.

What a forward state holds depends on the kind of model:

* Unigram: the best score of the prefix and its last piece (Viterbi).
* BPE: pieces have merge ranks, not probabilities, and the path of the best sum of ranks is not what
  SentencePiece gives. But the merges give each prefix one last piece: the one whose encoding next to the
  last piece of the rest stays those two. So the state is that piece, found among the pieces that end here.

Both states depend on the prefix alone, which is what lets words share them. Characters without piece
are their UTF-8 bytes (or the unknown piece, if the model has no bytes).

Texts are cut where their bytes say, and the distinct words of a step are told by Arrow, so Python sees a word once per
step; ids are gathered for all its occurrences at once. Decoding gathers the spellings of all ids of a step likewise.

Defined cases: null and empty text have no pieces and decode to empty text; a repeated row gets a row each;
a mark U+2581 in a text reads back as a space, as in SentencePiece itself.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fleetgauge.llm.common import by_text
from fleetgauge.llm.words import bytes_of

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Entries a worker keeps from step to step, of words and of pairs of pieces; full tables are begun anew.
KEPT = 1 << 19
KEPT_PAIRS = 1 << 18
#: Longer words than this are encoded one by one, the others a level of their trie at a time.
LEVELS = 64
#: Fills the matrix of characters of the words of a trie.
NO_CHAR = 0x110000


class Model:
    """Pieces of a SentencePiece model file and the forward steps over them."""

    def __init__(self, content: bytes):
        import sentencepiece.sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(content)
        rules = proto.normalizer_spec
        if rules.name not in ("identity", "") or not rules.add_dummy_prefix or rules.remove_extra_whitespaces:
            raise ValueError("only models without normalisation, with a mark before the text, are read")
        self.unigram = proto.trainer_spec.model_type == 1
        self.pieces = [p.piece for p in proto.pieces]
        plain = [(i, p) for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        self.ids = {p.piece: i for i, p in plain}
        self.scores = {p.piece: p.score for _, p in plain}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0)
        self.unknown_score = min(self.scores.values(), default=0.0) - 10.0
        ends: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                ends.setdefault(piece[-2:], set()).add(len(piece))
        #: Lengths of the pieces that end in two characters, longest first.
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        raw = {i: bytes([b]) for b, i in self.bytes.items()}
        #: What an id reads back as; control pieces as nothing.
        self.spelling = [
            b"" if p.type == 3 else raw[i] if i in raw else p.piece.replace(MARK, " ").encode() for i, p in enumerate(proto.pieces)]
        self.spellings = pa.array(self.spelling, pa.large_binary())
        self._reverse()
        self.fits: dict[tuple[str, str], bool] = {}
        #: As ``fits``, by left id * (number of pieces + 1) + right id; the left id is the number of pieces if there is no left one.
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _reverse(self) -> None:
        """The trie of the pieces read backwards: ``edges`` (node << 21 | character) in order, where they lead, the piece of a node or -1."""
        lead: dict[int, int] = {}
        ends = {0: -1}
        for piece, i in self.ids.items():
            node = 0
            for c in reversed(piece):
                node = lead.setdefault(node << 21 | ord(c), len(lead) + 1)
            ends[node] = i
        edges = np.array([*lead, 1 << 62], np.int64)
        order = np.argsort(edges)
        self.edges, self.leads = edges[order], np.array([*lead.values(), 0], np.int64)[order]
        self.ends = np.array([ends.get(k, -1) for k in range(len(lead) + 1)], np.int64)

    def merged(self, text: str) -> list[str]:
        """Plain merges of a short text or a run of marks: always the best-scored pair, leftmost first."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts) and (s := self.scores.get(pair := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (-s, i, pair))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[j] is None or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j] = pair, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in parts if x is not None]

    def _fit(self, left: str, right: str) -> bool:
        """Whether the two pieces next to each other stay two pieces; without a left one, whether the right one stays one."""
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        if left and left not in self.scores:  # a character without piece merges with nothing
            left = ""
        known = self.fits[left, right] = self._stay(left, right)
        return known

    def _stay(self, left: str, right: str) -> bool:
        return self.merged(left + right) == ([left, right] if left else [right])

    def _fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_fit`` of many pairs of ids."""
        none = len(self.pieces)
        pairs = self.pairs
        keys = (left * (none + 1) + right).tolist()
        new = {k for k in keys if k not in pairs}
        if len(pairs) + len(new) > KEPT_PAIRS:
            pairs.clear()
            new = set(keys)
        for key in new:
            a, b = divmod(key, none + 1)
            pairs[key] = self._stay("" if a == none else self.pieces[a], self.pieces[b])
        return np.fromiter(map(pairs.__getitem__, keys), bool, len(keys))

    def step(self, word: str, at: int, states: list) -> None:
        """Appends the state of ``word[:at]`` to the states of its shorter prefixes.

        A state is (score, length of the last piece); a last piece of length 1 may have no id.
        """
        lengths = self.lengths.get(word[at - 2:at], ()) if at > 1 else ()
        scores = self.scores
        if self.unigram:
            best = (states[at - 1][0] + scores.get(word[at - 1], self.unknown_score), 1)
            for n in lengths:
                if n <= at and (s := scores.get(word[at - n:at])) is not None and states[at - n][0] + s > best[0]:
                    best = (states[at - n][0] + s, n)
            states.append(best)
            return
        fits = self.fits
        for n in lengths:
            if n <= at and (piece := word[at - n:at]) in scores:
                end = at - n
                left = word[end - states[end][1]:end]
                known = fits.get((left, piece))
                if known if known is not None else self._fit(left, piece):
                    states.append((0.0, n))
                    return
        states.append((0.0, 1))

    def _ids_of(self, word: str, states: list) -> tuple[int, ...]:
        parts, at = [], len(word)
        while at:
            parts.append(word[at - states[at][1]:at])
            at -= states[at][1]
        return tuple(i for p in reversed(parts) for i in self._spelt(p))

    def _spelt(self, part: str) -> Iterable[int]:
        if (i := self.ids.get(part)) is not None:
            return (i,)
        if self.bytes:
            return [self.bytes[b] for b in part.encode("utf-8", "surrogatepass")]
        return (self.unknown,)

    def _levels(self, words: list[str]) -> Iterable[tuple[int, ...]]:
        """Ids of each of the words, which are in order and no longer than ``LEVELS``, a level of their trie at a time (BPE)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.full((len(words), sizes.max()), NO_CHAR, np.int64)
        chars[np.arange(chars.shape[1]) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        common = np.zeros(len(words), np.int64)
        common[1:] = (chars[1:] != chars[:-1]).argmax(axis=1)
        none = len(self.pieces)
        # the states: length and id of the last piece of each prefix
        last = np.ones((chars.shape[1] + 1, len(words)), np.int64)
        piece = np.full((chars.shape[1] + 1, len(words)), none, np.int64)
        for at in range(1, chars.shape[1] + 1):
            # a node is computed with the first word that has it
            rows = np.flatnonzero((common < at) & (sizes >= at))
            node, alive, ends = np.zeros(len(rows), np.int64), rows, []
            for n in range(1, at + 1):
                key = node << 21 | chars[alive, at - n]
                to = np.searchsorted(self.edges, key)
                there = self.edges[to] == key
                alive, node = alive[there], self.leads[to[there]]
                if not len(alive):
                    break
                found = self.ends[node]
                ends.append((alive[found >= 0], found[found >= 0]))
            open_ = np.zeros(len(words), bool)
            open_[rows] = True
            for n in range(len(ends), 0, -1):
                some, ids = ends[n - 1]
                still = open_[some]
                some, ids = some[still], ids[still]
                if n > 1:
                    fits = self._fitting(piece[at - n, some], ids)
                    some, ids = some[fits], ids[fits]
                last[at, some], piece[at, some] = n, ids
                open_[some] = False
            first = np.zeros(len(words), np.int64)
            first[rows] = rows
            first = np.maximum.accumulate(first)
            last[at], piece[at] = last[at, first], piece[at, first]
        # back from the ends of the words
        rows, at, parts = np.arange(len(words)), sizes, []
        while len(rows):
            parts.append((rows, at, piece[at, rows]))
            at = at - last[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        rows, at, ids = map(np.concatenate, zip(*parts))
        order = np.lexsort((at, rows))
        rows, at, ids = rows[order], at[order], ids[order].tolist()
        cuts = np.searchsorted(rows, np.arange(len(words) + 1)).tolist()
        odd = set(rows[np.flatnonzero(np.array(ids) == none)].tolist())
        ends = at.tolist()
        for row, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if row in odd:
                yield tuple(i for k in range(a, b) for i in ((ids[k],) if ids[k] < none else self._spelt(words[row][ends[k] - 1])))
            else:
                yield tuple(ids[a:b])

    def encode_words(self, distinct: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each word, by depth-first traversal of the trie of the words (their sorted order)."""
        out: dict[str, tuple[int, ...]] = {}
        states, last = [(0.0, 0)], ""
        distinct = sorted(distinct)
        if not self.unigram and (short := [w for w in distinct if len(w) <= LEVELS and w[:2] != MARK * 2]):
            out.update(zip(short, self._levels(short)))
            distinct = [w for w in distinct if w not in out]
        for word in distinct:
            if not self.unigram and word[:2] == MARK * 2:
                out[word] = self._marked(word)
                continue
            common = len(os.path.commonprefix((last, word)))
            del states[common + 1:]
            for at in range(common + 1, len(word) + 1):
                self.step(word, at, states)
            out[word] = self._ids_of(word, states)
            last = word
        return out

    def _marked(self, word: str) -> tuple[int, ...]:
        """A word after several marks: runs of marks merge last, so the word takes the mark before it first."""
        run = len(word) - len(word.lstrip(MARK))
        rest = word[run - 1:]
        tail = self.encode_words([rest])[rest] if len(rest) > 1 else (self.ids.get(MARK, self.unknown),)
        if tail[0] == self.ids.get(MARK):
            run, tail = run + 1, tail[1:]
        return tuple(i for p in self.merged(MARK * (run - 1)) for i in self._spelt(p)) + tail

    def encode_column(self, marked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of ``marked``, which have spaces for marks, and where each text's begin (with the end last)."""
        data, offsets = bytes_of(marked)
        # a word begins with the first of its spaces, and a text that isn't empty with one
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        cuts = np.append(np.flatnonzero(begins), len(data))
        words = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        known = self.words
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > KEPT:
            known.clear()
            new = distinct
        coded = self.encode_words([w.replace(" ", MARK) for w in new])
        known.update((w, coded[w.replace(" ", MARK)]) for w in new)
        found = [known[w] for w in distinct]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, sizes.sum())
        # the ids of every occurrence
        at = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        ids = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], sizes[at])]
        return ids, ends[np.searchsorted(cuts, offsets)]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, ends = self.encode_column(marked(pa.array(texts, pa.string())))
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def restored(self, marked: pa.Array, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the ids of each text read back as that text."""
        spelt, at = bytes_of(self.spellings.take(pa.array(ids)))
        data, offsets = bytes_of(marked)
        at = at[ends]
        if np.array_equal(at, offsets) and np.array_equal(spelt, data):
            return np.ones(len(marked), bool)
        spelt, data = spelt.tobytes(), data.tobytes()
        # bytes that aren't the same may still read the same
        return np.array([spelt[a:b] == data[c:d] or self.decode(ids[e:f].tolist()) == data[c:d].decode()[1:] for a, b, c, d, e, f in zip(
            at, at[1:], offsets, offsets[1:], ends, ends[1:])], bool)

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def marked(texts: pa.Array) -> pa.Array:
    """The texts as the model reads them, with spaces for marks: one before each text that isn't empty."""
    plain = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), MARK, " ")
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    return pc.if_else(pc.equal(pc.binary_length(plain), 0), none, pc.binary_join_element_wise(space, plain, none))


_LOADED: dict[str, Model] = {}


def model(path: str = MODEL) -> Model:
    """The model of a file, read once per worker. The file lies on every machine, as its library does."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = Model(f.read())
    return _LOADED[path]


def encode(docs: DataFrame, path: str = MODEL, *keep: str) -> DataFrame:
    """``doc_id``, the kept columns, ``n_pieces``, ``ids`` and ``restored``: whether decoding gives the text back."""
    kept = ["doc_id", *keep]

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        coder, texts = model(path), marked(piece.column("text"))
        ids, ends = coder.encode_column(texts)
        same = coder.restored(texts, ids, ends)
        return pa.RecordBatch.from_arrays(
            [*(piece.column(c) for c in kept), pa.array(np.diff(ends)),
             pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(same)],
            [*kept, "n_pieces", "ids", "restored"])

    kinds = dict(docs.dtypes)
    columns = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    return by_text(docs, [*kept, "text"], run, f"{columns}, n_pieces long, ids array<int>, restored boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give null text."""

    def run(batches):
        for batch in batches:
            texts = [None if x is None else model(path).decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")
