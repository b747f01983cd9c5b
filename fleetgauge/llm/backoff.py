"""Language-model scores by stupid backoff over word pairs, computed as joins of count tables.

The model is the corpus itself, each document left out of its own counts. The score of word b after word a is
c(a b) / c(a) if the pair occurs elsewhere, else ``BACKOFF`` * c(b) / N; a first word has c(b) / N; a word that occurs nowhere
else counts ``UNSEEN``. All counts are of the whole corpus less the document's own.

Every word counts for itself. The words with at least ceil(N / 2^``BITS``) occurrences, 2^``BITS`` at most by that very rule,
are frequent and their counts go to every task; the other ones are rare and known by their 64-bit hashes. A pair of frequent
words is two ids, as wide as the number of frequent words asks, which a bijection scatters over the number range. The upper
part of that number, or of the hash of a rare word, is the partition of its counts.

1. Word counts: combined per step of text, then summed by hash.
2. Pairs that are frequent within steps (``LOCAL`` times) and make up 2^-``HOT`` of the corpus, at most 2^``HOT``: their exact
   counts go to every task and they are scored where the text is, so no frequent pair gathers in one partition.
3. All other pairs of frequent words go per document to the partition of their count table, sorted, delta coded and compressed.
   There the counts are summed and joined back to the documents' pairs; what the pairs found elsewhere add to their
   documents is summed per document. Their words are read from the number, so of the words' scores nothing is sent, and
   documents are named by their piece of text and their row in it.
4. Rare words go to the partitions of their counts, each with its neighbours: a pair of two rare words goes to either. The
   logarithm of a rare word's count enters its document's score there once per occurrence, but not where a pair was found
   elsewhere. A rare word has fewer than N / 2^``BITS`` occurrences, so neither it nor its pairs gather in one partition.

Defined cases: null and blank text has no words, log score 0 and null mean; words are runs of characters other than ASCII
white space, A-Z lowered; a repeated row is a further document; a lone document has N = 0, which counts as 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import steps
from fleetgauge.llm.words import LOWER, bytes_of, mix, word_hashes
from fleetgauge.session import stored

BACKOFF = 0.4
UNSEEN = 0.5
BITS = 20
HOT = 14
LOCAL = 8
#: Bytes of text whose pairs make up a partition of the count table.
PART = 16 << 20
#: What a rare word's neighbour is: a frequent word after it or before it, a rare word after it or before it.
AFTER, BEFORE, RARE_AFTER, RARE_BEFORE = range(4)
INSIDE = np.ones(256, np.int8)
INSIDE[[9, 10, 11, 12, 13, 32]] = 0


class Vocabulary:
    """Hashes of the frequent words in order with their counts; ``bits`` is the width of an id."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, bits: int):
        order = np.argsort(words)
        self.words, self.counts, self.total, self.bits = words[order], counts[order], total, bits

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id of each word, -1 if it is rare, and its number among the distinct words given."""
        distinct, where = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, distinct), max(len(self.words) - 1, 0))
        known = self.words[at] == distinct if len(self.words) else np.zeros(len(distinct), bool)
        return np.where(known, at, -1)[where], where


def _hashes(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words, rows, *_ = word_hashes(*bytes_of(piece.column("text")), INSIDE, LOWER)
    return words, rows


def _summed(docs: DataFrame, of) -> DataFrame:
    """``key, n``: what ``of`` counts in each piece of text, summed over the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch):
                keys, n = of(piece)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> Vocabulary:
    def words(piece: pa.RecordBatch):
        keys, n = np.unique(_hashes(piece)[0].view(np.int64), return_counts=True)
        return keys, n

    counts = stored(_summed(docs, words), "lm-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counts.where(F.col("n") >= max(1, -(-total >> BITS))).toArrow()  # 2^BITS rows at most
    bits = max(1, (frequent.num_rows - 1).bit_length())
    return Vocabulary(frequent.column("key").to_numpy().view(np.uint64), frequent.column("n").to_numpy(), total, bits)


def _keys(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The pairs of two ids of ``bits`` bits, scattered over 2 * bits bits."""
    wide = (1 << 2 * bits) - 1
    return ((a << bits | b) * (0x9E3779B97F4A7C15 & wide | 1)) & wide


def _ids(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pairs, as ``_keys`` scatters them."""
    wide = (1 << 2 * bits) - 1
    both = (keys.view(np.uint64) * np.uint64(pow(0x9E3779B97F4A7C15 & wide | 1, -1, wide + 1))).view(np.int64) & wide
    return both >> bits, both & (1 << bits) - 1


def _frequent_pairs(known: Vocabulary, piece: pa.RecordBatch) -> np.ndarray:
    """Keys of the pairs of two frequent words, repeats included."""
    words, rows = _hashes(piece)
    ids, _ = known.ids(words)
    both = (rows[1:] == rows[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0)
    return _keys(ids[:-1][both], ids[1:][both], known.bits)


def hot_pairs(docs: DataFrame, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Keys, in order, and exact counts of the frequent pairs; at most 2^HOT."""

    def frequent(piece: pa.RecordBatch):
        keys, n = np.unique(_frequent_pairs(known, piece), return_counts=True)
        return keys[n >= LOCAL], n[n >= LOCAL]

    least = max(LOCAL, known.total >> HOT)
    keys = np.sort(_summed(docs, frequent).where(F.col("n") >= least).select("key").toArrow().column("key").to_numpy())

    def exact(piece: pa.RecordBatch):
        found = _frequent_pairs(known, piece)
        return np.unique(found[_among(found, keys)], return_counts=True)

    got = _summed(docs, exact).toArrow()
    order = np.argsort(got.column("key").to_numpy())
    return got.column("key").to_numpy()[order], got.column("n").to_numpy()[order]


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _first(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct row, in order of the columns, and how often it occurs."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(c[order]) != 0 for c in columns], axis=0)
    starts = np.flatnonzero(new)
    return order[starts], np.diff(np.append(starts, len(order)))


def _scored(piece: pa.RecordBatch, known: Vocabulary, hot: tuple[np.ndarray, np.ndarray]):
    """Base scores of the rows, as if no pair occurred elsewhere but the hot ones, and what is open.

    An open pair of frequent words is (key, row, times, times of either word in the row). The logarithms of the counts of rare
    words are left out of scores; a rare word is (word, row, times), by word. An open pair with a rare word is (place of that
    word, kind, its neighbour's id or hash, times, times of a frequent neighbour in the row).
    """
    words, rows = _hashes(piece)
    ids, number = known.ids(words)
    n = piece.num_rows
    length = np.bincount(rows, minlength=n)
    # times of each word in its row, looked up by (row, word)
    _, once, where, times = np.unique(rows * (len(words) + 1) + number, return_index=True, return_inverse=True, return_counts=True)
    rare = ids < 0
    left = np.ones(len(ids), np.int64)
    left[~rare] = known.counts[ids[~rare]] - times[where][~rare]
    rest = np.log(np.maximum(left, UNSEEN))
    alone = rest - np.log(np.maximum(known.total - length[rows], 1))
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    base = np.bincount(rows, alone + np.where(first, 0.0, np.log(BACKOFF)), n)
    seldom = np.flatnonzero(rare[once])
    seldom = seldom[np.argsort(words[once[seldom]], kind="stable")]
    single = (words[once[seldom]], rows[once[seldom]], times[seldom])
    follow = np.flatnonzero(~first)
    # a word that occurs in this row only is in no pair elsewhere
    follow = follow[(left[follow - 1] > 0) & (left[follow] > 0)]
    some = rare[follow - 1] | rare[follow]
    two, follow = follow[some], follow[~some]
    key, at = _keys(ids[follow - 1], ids[follow], known.bits), rows[follow]
    place, count = _first(key, at)
    key, at, follow = key[place], at[place], follow[place]
    ready = _among(key, hot[0])
    if ready.any():
        gain = -rest[follow - 1] - alone[follow] - np.log(BACKOFF)
        elsewhere = hot[1][np.searchsorted(hot[0], key[ready])] - count[ready]
        more = np.where(elsewhere > 0, count[ready] * (np.log(np.maximum(elsewhere, 1)) + gain[ready]), 0.0)
        base += np.bincount(at[ready], more, n)
    keep = ~ready
    follow = follow[keep]
    pairs = (key[keep], at[keep], count[keep], times[where[follow - 1]], times[where[follow]])
    spot = np.zeros(len(once), np.int64)
    spot[seldom] = np.arange(len(seldom))
    a, b = two[rare[two - 1]] - 1, two[rare[two]]
    mine, other = np.concatenate([a, b]), np.concatenate([a + 1, b - 1])
    kind = np.concatenate([np.where(rare[a + 1], RARE_AFTER, AFTER), np.where(rare[b - 1], RARE_BEFORE, BEFORE)])
    named = np.where(rare[other], words[other].view(np.int64), ids[other])
    around = np.where(rare[other], 0, times[where[other]])
    mine = spot[where[mine]]
    place, count = _first(mine, kind, named)
    return length, base, single, pairs, (mine[place], kind[place], named[place], count, around[place])


_BASE, _PAIRS, _RARE = range(3)
_ZSTD = pa.Codec("zstd", compression_level=3)


def _pack(*lists: np.ndarray) -> bytes:
    """Lists of integers, doubles or floats, by their bytes: the lowest bytes of all, then the next ones; compressed."""
    head, parts = [], []
    for x in lists:
        x = np.ascontiguousarray(x, x.dtype if x.dtype.kind == "f" else np.int64)
        planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
        # the uppermost bytes of small integers are not written
        width = -x.itemsize if x.dtype.kind == "f" else max((k + 1 for k in range(8) if planes[k].any()), default=0)
        head += [len(x), width]
        parts.append(planes[:abs(width)].tobytes())
    body = np.array([len(lists), *head], np.int64).tobytes() + b"".join(parts)
    return len(body).to_bytes(8, "little") + _ZSTD.compress(body, asbytes=True)


def _unpack(packed: bytes) -> list[np.ndarray]:
    body = _ZSTD.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    head, at, out = np.frombuffer(body, np.int64, 2 * n, 8).reshape(n, 2).tolist(), 8 + 16 * n, []
    for size, width in head:
        planes = np.zeros((size, -width if width < 0 else 8), np.uint8)
        planes[:, :abs(width)] = np.frombuffer(body, np.uint8, size * abs(width), at).reshape(abs(width), size).T
        out.append(planes.view({-8: np.float64, -4: np.float32}.get(width, np.int64)).ravel())
        at += size * abs(width)
    return out


def _cuts(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each partition of ``part``, which is in order, and where it begins and ends."""
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return zip(part[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(part)])


def _packed(docs: DataFrame, known: Vocabulary, hot: tuple[np.ndarray, np.ndarray], bits: int) -> DataFrame:
    """Per piece: a row with the base scores, and a row per partition with the open pairs of frequent words and one with the rare words.

    The base scores go along to one of the partitions, so the texts are read once and nothing is written in between.
    """

    def rows_of(piece: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
        length, base, (word, at, times), pairs, near = _scored(piece, known, hot)
        docs = piece.column("doc").to_numpy()
        # pieces of the same documents in the same order have one name, and equal scores
        name = mix(np.cumsum(mix(docs.view(np.uint64)) * np.arange(1, 2 * len(docs), 2, dtype=np.uint64))[-1:] + np.uint64(len(docs))).view(np.int64)[0]
        yield int(name) & ((1 << bits) - 1), _BASE, name, _pack(docs, length, base)
        key, row, count, one, two = pairs
        for part, a, b in _cuts(key >> max(0, 2 * known.bits - bits)):
            yield part, _PAIRS, name, _pack(np.diff(key[a:b], prepend=0), row[a:b], count[a:b], one[a:b], two[a:b])
        mine, kind, named, count, around = near
        for part, a, b in _cuts((word >> np.uint64(64 - bits)).astype(np.int64)):
            c, d = np.searchsorted(mine, (a, b))
            seldom = kind[c:d] >= RARE_AFTER
            yield part, _RARE, name, _pack(np.diff(word[a:b].view(np.int64), prepend=0), at[a:b], times[a:b], np.diff(mine[c:d], prepend=a),
                                           kind[c:d], named[c:d][~seldom], named[c:d][seldom], count[c:d], around[c:d])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch):
                part, kind, name, packed = zip(*rows_of(piece))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(name, pa.int64()),
                                                  pa.array(packed, pa.binary())], ["part", "kind", "piece", "packed"])

    return docs.select("doc", "text").mapInArrow(run, "part int, kind int, piece long, packed binary")


def _elsewhere(keys: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each key occurs in other rows."""
    _, where = np.unique(keys, return_inverse=True)
    return np.bincount(where, times)[where].astype(np.int64) - times


def _joined(table, known: Vocabulary, bits: int):
    """What the words and pairs of one partition add to their documents: a row per piece, and the base scores as they came.

    Of a document that is its row in the piece, the sum of the scores but the one factor that all its pairs share, and how
    many pairs were found elsewhere.
    """
    pieces, number = np.unique(table.column("piece").to_numpy(), return_inverse=True)
    base, pairs, word, near, n_words = [], [], [], [], 0
    for kind, piece, packed in zip(table.column("kind").to_pylist(), number.tolist(), table.column("packed").to_pylist()):
        if kind == _BASE:
            base.append((pieces[piece], True, packed))
            continue
        step, row, *rest = _unpack(packed)
        doc = (piece << 32) + row
        if kind == _PAIRS:
            pairs.append((np.cumsum(step), doc, *(x.astype(np.int32) for x in rest)))
        else:
            times, mine, kinds, ids, hashes, count, around = rest
            named = np.empty(len(kinds), np.int64)
            named[kinds < RARE_AFTER], named[kinds >= RARE_AFTER] = ids, hashes
            word.append((np.cumsum(step), doc, times.astype(np.int32)))
            near.append((np.cumsum(mine) + n_words, kinds.astype(np.int8), named, count.astype(np.int32), around.astype(np.int32)))
            n_words += len(step)
    gains, empty = [], np.zeros(0, np.int64)
    if pairs:
        keys, doc, times, one, two = map(np.concatenate, zip(*pairs))
        left = _elsewhere(keys, times)
        some = left > 0
        a, b = _ids(keys[some], known.bits)
        gain = np.log(left[some]) - np.log(known.counts[a] - one[some]) - np.log(known.counts[b] - two[some])
        gains.append((doc[some], times[some] * gain, times[some]))
    if word:
        words, doc, times = map(np.concatenate, zip(*word))
        rest = np.log(np.maximum(_elsewhere(words, times), UNSEEN))
        gains.append((doc, times * rest, np.zeros(len(doc), np.int64)))
        mine, kinds, named, count, around = map(np.concatenate, zip(*near))
        named_ = mix(named.view(np.uint64) + kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        left = _elsewhere(mix(words[mine].view(np.uint64) * np.uint64(3) + named_), count)
        some = left > 0
        mine, kinds, named, count, around, left = (x[some] for x in (mine, kinds, named, count, around, left))
        brings = kinds != RARE_BEFORE  # of two rare words the first one brings the pair
        gain = np.where(brings, np.log(left), 0.0) - rest[mine]
        frequent = kinds < RARE_AFTER
        gain[frequent] -= np.log(known.counts[named[frequent]] - around[frequent])
        gains.append((doc[mine], count * gain, count * brings))
    doc, more, found = map(np.concatenate, zip(*gains)) if gains else (empty,) * 3
    docs, at = np.unique(doc, return_inverse=True)
    more, found = np.bincount(at, more, len(docs)).astype(np.float32), np.bincount(at, found, len(docs)).astype(np.int64)
    rows = base + [(pieces[k], False, _pack(np.diff(docs[a:b] & 0xFFFFFFFF, prepend=0), more[a:b], found[a:b])) for k, a, b in _cuts(docs >> 32)]
    name = np.array([x for x, *_ in rows], np.int64)
    return pa.table([pa.array(name & ((1 << bits) - 1)), pa.array(name), pa.array([x for _, x, _ in rows], pa.bool_()),
                     pa.array([x for *_, x in rows], pa.binary())], ["bucket", "piece", "base", "packed"])


def _totals(table, total: int):
    """Sums per document of one bucket of pieces."""
    is_base = table.column("base").to_numpy().astype(bool)
    packed, piece = table.column("packed").to_pylist(), table.column("piece").to_numpy()
    texts, sums, out = {}, {}, []
    for k in np.flatnonzero(is_base).tolist():
        docs, length, base = _unpack(packed[k])
        copies, _ = texts.get(piece[k], (0, None))
        texts[piece[k]] = copies + 1, (docs, length, base)
        sums.setdefault(piece[k], np.zeros((2, len(docs))))
    for k in np.flatnonzero(~is_base).tolist():
        step, more, found = _unpack(packed[k])
        sums[piece[k]][:, np.cumsum(step)] += more, found
    for name, (copies, (docs, length, base)) in texts.items():
        more, found = sums[name]
        scale = np.log(np.maximum(total - length, 1)) - np.log(BACKOFF)
        out.append((docs, length, copies * base + more + found * scale, np.full(len(docs), copies)))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], ["doc", "n_words", "s", "copies"])


def scores(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` per row of ``docs``."""
    keyed = docs.select("doc_id", "text").withColumn("doc", F.xxhash64("doc_id", "text"))
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(4, (size // PART).bit_length())
    known = vocabulary(keyed)
    total = known.total
    parts = _packed(keyed, known, hot_pairs(keyed, known), bits).groupBy("part").applyInArrow(
        lambda table: _joined(table, known, bits), "bucket long, piece long, base boolean, packed binary")
    # rows that repeat doc_id and text have one key: their base scores are equal and their gains are summed
    sums = parts.groupBy("bucket").applyInArrow(lambda table: _totals(table, total), "doc long, n_words long, s double, copies long")
    by_doc = sums.groupBy("doc").agg(F.max("n_words").alias("n_words"), F.sum("s").alias("s"), F.sum("copies").alias("copies"))
    out = keyed.select("doc_id", "doc").join(by_doc, "doc")
    return out.selectExpr("doc_id", "n_words", "s / copies AS log_score", "IF(n_words > 0, s / copies / n_words, NULL) AS mean_log_score")
