"""Spelling variants: words of the corpus that differ by one letter, searched in tries of letter counts.

A word's frequency vector is its length and how often each letter group occurs in it (``GROUPS``: the letters a to z, the
frequent ones first, and six groups of other letters). One replaced letter lowers at most one count by one and raises at most
one; one inserted letter raises exactly one. So in a trie of the vectors, the near words of a word lie at the leaves that a
depth-first search reaches with a surplus of one and a deficit of one to spend. Leaf words are then compared letter by letter.

The words are spread over Spark's groups by the trie itself: a group is a trie node of at most ``NODE_CHARS`` characters of words; a larger
node is divided by the next count, again and again, and words that do not differ in any count are divided by
hash. Every word is sent as a query to each group that its budget lets it reach: three children of a divided node, less
where the budget is spent. In a group the search is done for many queries at once, by number arrays kept on a stack.

Only whole words are sent, once per group reached, and only links found come back; nothing is collected. Forms are
followed to the root by joining the table of forms with itself, which doubles the distance each time.

Defined cases: null text has no words; a null doc_id is the empty text in the hash; rows are counted each, so repeated rows add to
``n``; an empty table gives no rows. A run holds letters of Latin-1 only, so a letter is one byte inside a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import stored

RUN = r"[A-Za-zÀ-ÿ]+"
EVERY, LEAST_LETTERS, LEAST_COUNT, RATIO = 97, 5, 3, 2
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
OTHERS = 6
GROUPS = len(LETTERS) + OTHERS
#: Characters of words that one group holds.
NODE_CHARS = 1 << 17
#: States of the search that are widened at a time.
STATES = 1 << 18
#: Words below a trie node from which on its leaves are not visited one by one but all compared.
FEW = 3

LINK = "word string, near string, near_n bigint"


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: the words, with one letter deleted where the hash says so, that are long and frequent enough."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    # lower() changes letters beyond A-Z too, so it is for runs of ASCII letters only
    low = runs.selectExpr("id", f"IF(octet_length(run) = length(run), lower(run), translate(run, '{upper}', '{upper.lower()}')) AS run")
    hashed = low.selectExpr("run", "crc32(cast(concat(id, ':', run) AS binary)) AS h").where(f"length(run) >= {LEAST_LETTERS}")
    words = hashed.selectExpr(
        f"IF(h % {EVERY} = 0, concat(left(run, int(h % length(run))), substring(run, int(h % length(run)) + 2)), run) AS word")
    return words.where(f"length(word) >= {LEAST_LETTERS}").groupBy("word").agg(F.count("*").alias("n")).where(f"n >= {LEAST_COUNT}")


def _count_sql(level: int) -> str:
    """Count of letter group ``level`` in ``word``."""
    if level < len(LETTERS):
        return f"length(word) - length(replace(word, '{LETTERS[level]}', ''))"
    return f"size(filter(split(word, ''), c -> c <> '' AND ascii(c) > 127 AND ascii(c) % {OTHERS} = {level - len(LETTERS)}))"


def _routed(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words with the group they lie in, and the queries with every group they can reach."""
    lies = words.selectExpr("*", "string(length(word)) AS node")
    # s, d: surplus and deficit still to be spent; one inserted letter has its surplus to spend and no deficit
    asks = words.selectExpr("*", "1 AS s", "explode(array(0, 1)) AS d").withColumn("node", F.expr("string(length(word) + 1 - d)"))
    homes, queries = [], []
    for level in range(GROUPS + 1):
        sizes = stored(lies.groupBy("node").agg(F.sum(F.length("word")).alias("chars")), "trie-nodes")
        last = level == GROUPS
        small = sizes if last else sizes.where(f"chars <= {NODE_CHARS}")
        parts = f"int(ceil(chars / {NODE_CHARS}))"
        homes.append(lies.join(small, "node").selectExpr("word", "n", f"concat(node, '#', pmod(xxhash64(word), {parts})) AS node"))
        queries.append(asks.join(small, "node").selectExpr(
            "word", "n", f"explode(transform(sequence(0, {parts} - 1), i -> concat(node, '#', i))) AS node"))
        big = sizes.where(f"chars > {NODE_CHARS}").select("node")
        if last or big.isEmpty():
            break
        count = _count_sql(level)
        lies = stored(lies.join(big, "node").selectExpr("word", "n", f"concat(node, ',', {count}) AS node"), "trie-words")
        child = ("explode(filter(array(struct(0 AS by, s, d), struct(1 AS by, s - 1 AS s, d), struct(-1 AS by, s, d - 1 AS d)), "
                 f"x -> x.s >= 0 AND x.d >= 0 AND {count} + x.by >= 0))")
        asks = stored(asks.join(big, "node").selectExpr("word", "n", "node", f"{count} AS count", f"{child} AS x").selectExpr(
            "word", "n", "x.s AS s", "x.d AS d", "concat(node, ',', count + x.by) AS node"), "trie-queries")
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    # a query may reach a group by more than one way of spending
    return union(homes).toDF("home", "home_n", "node"), union(queries).distinct().toDF("word", "n", "node")


_GROUP_OF = np.array([LETTERS.find(chr(c)) if chr(c) in LETTERS else len(LETTERS) + c % OTHERS for c in range(256)])


def letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One row of letters per word, filled up with zeros, and the lengths."""
    raw = [w.encode("latin-1") for w in column.to_pylist()]
    length = np.array([len(r) for r in raw], np.int64)
    most = int(length.max(initial=0))
    return np.frombuffer(b"".join(r.ljust(most, b"\0") for r in raw), np.uint8).reshape(len(raw), most), length


def vectors_of(letters: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros((len(letters), GROUPS), np.int32)
    rows = np.arange(len(letters))
    for at in range(letters.shape[1]):
        here = at < length
        out[rows[here], _GROUP_OF[letters[here, at]]] += 1
    return out


class Trie:
    """Vectors as a trie: per level the sorted keys (parent node, count) of its nodes, and the range of words below each node."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.lexsort(vectors.T[::-1])
        rows = vectors[self.order]
        parent = np.zeros(len(rows), np.int64)
        self.base = int(rows.max(initial=0)) + 3
        self.keys, self.low, self.high = [], [], []
        fresh = np.zeros(len(rows), bool)
        fresh[:1] = True
        for level in range(GROUPS):
            fresh = fresh.copy()
            fresh[1:] |= rows[1:, level] != rows[:-1, level]
            first = np.flatnonzero(fresh)
            self.keys.append(parent[first] * self.base + rows[first, level] + 1)
            self.low.append(first)
            self.high.append(np.append(first[1:], len(rows)))
            parent = np.cumsum(fresh) - 1

    def reach(self, queries: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, word) of the words at the leaves that each query's budget reaches, in pieces."""
        if not len(self.order):
            return
        stack = [(0, np.arange(len(queries)), np.zeros(len(queries), np.int64), surplus.astype(np.int8), deficit.astype(np.int8))]
        while stack:
            level, q, node, s, d = stack.pop()
            if len(q) > STATES:
                half = len(q) // 2
                stack += [(level, q[half:], node[half:], s[half:], d[half:]), (level, q[:half], node[:half], s[:half], d[:half])]
                continue
            keys = self.keys[level]
            parts = []
            for by in (0, 1, -1):
                can = slice(None) if by == 0 else np.flatnonzero(s > 0 if by > 0 else d > 0)
                want = node[can] * self.base + queries[q[can], level] + (1 + by)
                at = np.searchsorted(keys, want)
                hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == want)
                parts.append((q[can][hit], at[hit], s[can][hit] - (by > 0), d[can][hit] - (by < 0)))
            q, node, s, d = (np.concatenate(x) for x in zip(*parts))
            low, high = self.low[level][node], self.high[level][node]
            leaf = np.ones(len(q), bool) if level == GROUPS - 1 else high - low <= FEW
            width = (high - low)[leaf]
            yield from self._words(q[leaf], low[leaf], width)
            if not leaf.all():
                stack.append((level + 1, q[~leaf], node[~leaf], s[~leaf], d[~leaf]))

    def _words(self, q: np.ndarray, low: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ends = np.cumsum(width)
        at = 0
        while at < len(q):
            # at most STATES pairs a piece; a leaf with more words is a piece of its own
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STATES, side="right")))
            size = width[at:to]
            start = np.repeat(low[at:to] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            yield np.repeat(q[at:to], size), self.order[start + np.arange(size.sum())]
            at = to


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter, or ``b`` by one more letter than ``a``."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= a.shape[1]


def _links(homes: pa.Table, queries: pa.Table) -> pa.Table:
    """Near pairs between a group's words, all of one length, and the queries of that length or one less."""
    homes, queries = homes.combine_chunks(), queries.combine_chunks()
    found: list[tuple] = []
    if homes.num_rows and queries.num_rows:
        letters, length = letters_of(homes["home"])
        trie = Trie(vectors_of(letters, length))
        size = int(length[0])
        asked, asked_length = letters_of(queries["word"])
        vectors = vectors_of(asked, asked_length)
        for shorter in (0, 1):
            rows = np.flatnonzero(asked_length == size - shorter)
            if not len(rows):
                continue
            for q, w in trie.reach(vectors[rows], np.ones(len(rows)), np.full(len(rows), 1 - shorter)):
                q = rows[q]
                for at in range(0, len(q), max(1, (8 << 20) // size)):
                    part = slice(at, at + max(1, (8 << 20) // size))
                    near = one_edit(asked[q[part], :size - shorter], letters[w[part]])
                    found.append((q[part][near], w[part][near], shorter))
    word, near, near_n = [], [], []
    for q, w, shorter in found:
        a, b = queries["word"].take(q), homes["home"].take(w)
        word.append(a), near.append(b), near_n.append(homes["home_n"].take(w))
        if shorter:
            word.append(b), near.append(a), near_n.append(queries["n"].take(q))
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    parts = [pa.Table.from_arrays([pa.chunked_array(c) if isinstance(c, list) else c for c in row], schema=schema)
             for row in zip(word, near, near_n)]
    return pa.concat_tables(parts) if parts else schema.empty_table()


def links(words: DataFrame) -> DataFrame:
    """``word, near, near_n`` of all near words, each pair from both sides once."""
    homes, queries = _routed(words)
    return homes.groupBy("node").cogroup(queries.groupBy("node")).applyInArrow(_links, LINK)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: the form's form and so on to the last; no cycle may be in it."""
    step = stored(forms.selectExpr("word", "form AS root"), "roots")
    while True:
        further = step.selectExpr("word AS root", "root AS beyond")
        joined = stored(step.join(further, "root", "left"), "roots")
        if joined.where("beyond IS NOT NULL").isEmpty():
            return step
        step = joined.selectExpr("word", "coalesce(beyond, root) AS root")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary."""
    words = stored(vocabulary(docs), "vocabulary")
    near = links(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("top"))
    found = stored(words.join(near, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) AS n_near", f"IF(-top.m >= {RATIO} * n, top.near, NULL) AS form",
        f"IF(-top.m >= {RATIO} * n, -top.m, NULL) AS form_n"), "forms")
    last = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(last, "word", "left").selectExpr("word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n")
