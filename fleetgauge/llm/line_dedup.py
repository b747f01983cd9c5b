"""Near-duplicate lines by MinHash.

A line is a piece of a text between line feeds that holds a character other than ASCII white space. Its shingles are
its runs of ``SHINGLE`` characters (a shorter line is one shingle). Each shingle is hashed once. ``ROWS`` rotations of the
hash order the shingles anew; in each order the first bits deal them into ``BANDS`` bins, and the least hash of every bin is
one of the ``BANDS * ROWS`` minima of the signature. An empty bin takes the minimum of the next filled one, in an order of its
own. Lines that agree on all rows of a band share a bucket. The lines of a bucket are searched for pairs whose shingle sets
have a Jaccard similarity of ``SIMILAR`` or more: in buckets of at most ``FEW`` lines all pairs are compared. In larger ones
lines are compared with ``PIVOTS`` of the bucket first, and then all pairs that these links don't join yet and that share one
of their rarer shingles, as only such pairs can have it (all but SIMILAR of a set, rarest first). A bucket of more than
``CHUNK`` bytes is cut into chunks by hash, and every two chunks meet. Buckets that hold the same lines are searched once.
Connected components of the links, with equal lines as one node, keep their first line (by document, then position); the
other ones are removed.

All of it is DataFrame functions. Every character begins a shingle and is a row between the scan of the distinct lines and
the minima of a line, which one stage computes without writing these rows.

A pair at the threshold meets in some band with probability 1 - (1 - 0.8^ROWS)^BANDS = 0.985, at 0.9 with 0.9999; a pair
that meets is linked, whatever else its bucket holds. Lines, shingles and the sets of buckets are told apart by 64-bit hashes.

Defined cases: null text has no lines and stays null; blank lines are never removed; rows that repeat doc_id and
text share their decisions; documents may lose all lines and stay, with empty text; ``n_chars`` follows the text
where it is a column.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import components
from fleetgauge.session import stored

SHINGLE = 8
ROWS = 4
BANDS = 8
SIMILAR = 0.8
#: Condition of a line that isn't blank; it looks no further than the first other character.
FILLED = "trim(LEADING ' \\t\\u000b\\u000c\\r' FROM {}) <> ''"
#: Bytes of lines in a chunk of a bucket.
CHUNK = 1 << 21
#: Groups of so many lines are compared pair by pair.
FEW = 16
#: Lines of a larger group that all its lines are compared with first.
PIVOTS = 4


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, hash`` (of the text), ``pos, line, node`` of every line that isn't blank."""
    split = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("hash"), F.split("text", "\n").alias("all"))
    every = split.select("doc_id", "hash", F.posexplode("all").alias("pos", "line"))
    return every.where(FILLED.format("line")).withColumn("node", F.xxhash64("line"))


#: Four bytes per character, so that a shingle is found by its position.
CODE = "encode(line, 'UTF-32')"
#: Positions of the shingles of ``code``, and the hash of the one at ``i``.
PLACES = f"sequence(0, greatest(octet_length(code) div 4 - {SHINGLE}, 0))"
HASH = f"xxhash64(substring(code, 4 * i + 1, {4 * SHINGLE}))"


def shingles(table: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``h``, the hash of a shingle, for every shingle of every ``line``, repeats included."""
    coded = table.selectExpr(*columns, f"{CODE} AS code")
    return coded.selectExpr(*columns, "code", f"explode({PLACES}) AS i").selectExpr(*columns, f"{HASH} AS h")


def signatures(table: DataFrame) -> DataFrame:
    """``node, size`` (bytes) and the minima ``s<row>_<band>`` of the signature of every different line."""
    once = table.select("node", "line").dropDuplicates(["node"]).selectExpr("node", "octet_length(line) AS size", "line")
    turns = [r * (64 // ROWS) for r in range(ROWS)]
    bits = (BANDS - 1).bit_length()
    turned = shingles(once, "node", "size").selectExpr(
        "node", "size", *[f"shiftleft(h, {t}) | shiftrightunsigned(h, {64 - t}) AS h{r}" if t else f"h AS h{r}" for r, t in enumerate(turns)])
    dealt = turned.selectExpr("*", *[f"cast(shiftrightunsigned(h{r}, {64 - bits}) AS int) AS b{r}" for r in range(ROWS)])
    least = dealt.groupBy("node", "size").agg(*[
        F.expr(f"min(h{r}) FILTER (WHERE b{r} = {k})").alias(f"m{r}_{k}") for r in range(ROWS) for k in range(BANDS)])
    rng = random.Random(11)
    filled = []
    for r in range(ROWS):
        for k in range(BANDS):
            others = rng.sample([j for j in range(BANDS) if j != k], BANDS - 1)
            filled.append(f"coalesce({', '.join(f'm{r}_{j}' for j in [k, *others])}) AS s{r}_{k}")
    return least.selectExpr("node", "size", *filled)


def buckets(table: DataFrame) -> DataFrame:
    """``node, size, bucket``, one row per band of every different line."""
    keys = [f"xxhash64({k}, {', '.join(f's{r}_{k}' for r in range(ROWS))})" for k in range(BANDS)]
    return signatures(table).selectExpr("node", "size", f"explode(array({', '.join(keys)})) AS bucket")


def shared(placed: DataFrame) -> DataFrame:
    """``bucket, n, bytes, lo, hi`` (least and greatest node) of the buckets of several lines; of those that hold the same lines, one."""
    sets = placed.groupBy("bucket").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"), F.expr("bit_xor(node)").alias("x"),
        F.expr("bit_xor(xxhash64(node))").alias("y"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("lo < hi")
    return sets.groupBy("lo", "hi", "x", "y", "n", "bytes").agg(F.min("bucket").alias("bucket")).drop("x", "y")


def chunked(members: DataFrame) -> DataFrame:
    """``node, bucket, left, right, second``: the lines of each two chunks of a bucket, or of a single one with itself."""
    cut = members.withColumn("chunks", F.expr(f"cast(ceil((bytes + 1) / {CHUNK}) AS int)")).withColumn("chunk", F.expr("pmod(hash(node), chunks)"))
    return cut.selectExpr("node", "bucket", """inline(concat(
        transform(sequence(chunk, chunks - 1), c -> named_struct('left', chunk, 'right', c, 'second', false)),
        IF(chunk = 0, array(), transform(sequence(0, chunk - 1), c -> named_struct('left', c, 'right', chunk, 'second', true)))))""")


def texts_of(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, line`` of the named lines."""
    return table.select("node", "line").join(nodes.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose lines are similar."""
    # the line is a lambda's variable, as a column of bytes is copied each time it is read
    first, other = (f"array_distinct(flatten(transform(array({CODE.replace('line', c)}), code -> transform({PLACES}, i -> {HASH}))))"
                    for c in ("first", "other"))
    both = pairs.join(texts.selectExpr("node AS a", "line AS first"), "a").join(texts.selectExpr("node AS b", "line AS other"), "b")
    # a generated row, so that the sets are not computed anew for each use
    sets = both.selectExpr("a", "b", f"inline(array(named_struct('x', {first}, 'y', {other})))")
    return sets.where(f"""least(size(x), size(y)) >= {SIMILAR}D * greatest(size(x), size(y)) AND
        size(array_intersect(x, y)) >= {SIMILAR}D * (size(x) + size(y) - size(array_intersect(x, y)))""").select("a", "b")


def searched(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links within buckets of many lines."""
    pivots = members.groupBy("bucket", F.expr(f"pmod(xxhash64(node), {PIVOTS})")).agg(F.min("node").alias("a")).select("bucket", "a")
    stars = members.selectExpr("bucket", "node AS b").join(pivots, "bucket").where("a <> b").selectExpr(
        "least(a, b) AS a", "greatest(a, b) AS b").distinct()
    near = stored(verified(stars, texts), "line-stars")
    roots = components(near).withColumnRenamed("root", "label")
    shingled = stored(shingles(texts_of(texts, members), "node").distinct(), "line-shingles")
    often = shingled.groupBy("h").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    sizes = shingled.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    # shingles of one line come first and are counted, as they can't be shared
    ranked = shingled.join(often, "h").join(sizes, "node").selectExpr(
        "node", "h", "n", "row_number() OVER (PARTITION BY node ORDER BY often, h) AS k",
        "count(*) OVER (PARTITION BY node) AS many")
    # of a similar pair the longer line shares one of its rarest n - SIMILAR * n + 1, the shorter one of fewer, as it must share more
    rarer = ranked.selectExpr("node", "h", "n", "n - many + k AS k", f"n - ceil({SIMILAR}D * n) + 1 AS rarest").where("k <= rarest").join(
        roots, "node", "left").selectExpr("node", "h", "n", "k", f"k <= n - ceil({2 * SIMILAR / (1 + SIMILAR)}D * n - 1e-9D) + 1 AS short",
                                          "coalesce(label, node) AS label")
    rows = stored(chunked(members).join(rarer, "node"), "line-rarer")
    keys = ["bucket", "left", "right", "h"]
    one = rows.where("short").selectExpr(*keys, "node AS a", "n AS na", "k AS ka", "label AS la", "second AS sa")
    two = rows.selectExpr(*keys, "node AS b", "n AS nb", "k AS kb", "label AS lb", "second AS sb")
    # after the first one they share, what is left of both must hold the others
    met = one.join(two, keys).where(f"""la <> lb AND (na < nb OR na = nb AND a < b) AND (left = right OR sa <> sb) AND na >= {SIMILAR}D * nb
        AND 1 + least(na - ka, nb - kb) >= {SIMILAR / (1 + SIMILAR)}D * (na + nb) - 1e-9D""")
    return near.unionByName(verified(met.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), texts))


def links(table: DataFrame) -> DataFrame:
    """Verified links ``(a, b)`` between different lines."""
    placed = stored(buckets(table), "line-buckets")
    sets = stored(shared(placed), "line-sets")
    more = sets.where("n > 2").select("bucket", "n", "bytes")
    members = stored(placed.select("node", "bucket").join(more, "bucket"), "line-members")
    few = members.where(f"n <= {FEW}")
    met = few.selectExpr("bucket", "node AS a").join(few.selectExpr("bucket", "node AS b"), "bucket").where("a < b").select("a", "b")
    pairs = stored(sets.where("n = 2").selectExpr("lo AS a", "hi AS b").unionByName(met).distinct(), "line-pairs")
    many = stored(members.where(f"n > {FEW}"), "line-many")
    texts = stored(texts_of(table, pairs.selectExpr("explode(array(a, b)) AS node").unionByName(many.select("node"))), "line-texts")
    found = verified(pairs, texts)
    return found if many.isEmpty() else found.unionByName(searched(many, texts))


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, hash, pos`` of every line to remove."""
    table = lines(docs)
    places = stored(table.select("doc_id", "hash", "pos", "node"), "line-places")
    roots = stored(components(links(table)), "line-roots")
    many = places.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    # a line is in question if it occurs again or is linked
    asked = stored(many.join(roots, "node", "left").where("n > 1 OR root IS NOT NULL").selectExpr(
        "node", "coalesce(root, node) AS root"), "line-asked")
    mine = places.join(asked, "node").select("doc_id", "hash", "pos", "root")
    first = stored(mine.groupBy("root").agg(F.min(F.struct("doc_id", "hash", "pos")).alias("first")), "line-first")
    return mine.join(first, "root").where("NOT (struct(doc_id, hash, pos) <=> first)").select("doc_id", "hash", "pos").distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines, plus ``_lines`` and ``_removed``: how many lines a text had and lost."""
    gone = stored(repeated(docs).groupBy("doc_id", "hash").agg(F.collect_list("pos").alias("_gone")), "line-gone")
    key = gone.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "_gone")
    joined = docs.withColumn("_text", F.xxhash64("text")).join(
        key, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left")
    cut = joined.withColumn("_split", F.split("text", "\n"))
    kept = cut.withColumn("_kept", F.expr("""IF(_gone IS NULL, text, array_join(transform(
        array_except(sequence(0, size(_split) - 1), _gone), i -> get(_split, i)), '\\n'))"""))
    out = {"text": "_kept"} | ({"n_chars": "cast(length(_kept) AS bigint)"} if "n_chars" in docs.columns else {})
    return kept.selectExpr(
        *[f"{out[c]} AS `{c}`" if c in out else f"`{c}`" for c in docs.columns],
        f"coalesce(size(filter(_split, x -> {FILLED.format('x')})), 0) AS _lines",
        "coalesce(size(_gone), 0) AS _removed")


# Local forms of the search; tests compare with them.

def _least(n: int) -> int:
    """How many of n shingles a similar line must share at least."""
    return next(k for k in range(max(int(SIMILAR * n) - 1, 1), n + 1) if k >= SIMILAR * n)


def _few(sets: list[frozenset], sides: list[bool]) -> list[tuple[int, int]]:
    """A tree of links by comparing all."""
    tree, label = [], list(range(len(sets)))
    cross = any(sides)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            # the smaller set bounds what both share
            if label[i] == label[j] or cross and sides[i] == sides[j] or min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
                continue
            both = len(a & b)
            if both >= SIMILAR * (len(a) + len(b) - both):
                tree.append((j, i))
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return tree


def _many(hashes: np.ndarray, begins: np.ndarray, sides: np.ndarray) -> list[tuple[int, int]]:
    """A tree of links among lines that share one of their rarer shingles."""
    n = len(begins) - 1
    distinct, token = np.unique(hashes, return_inverse=True)
    key = np.unique(np.repeat(np.arange(n), np.diff(begins)) * len(distinct) + token)
    owner, token = key // len(distinct), key % len(distinct)
    rank = np.empty(len(distinct), np.int64)
    rank[np.argsort(np.bincount(token, minlength=len(distinct)), kind="stable")] = np.arange(len(distinct))
    order = np.lexsort((rank[token], owner))
    owner, token = owner[order], rank[token][order]
    size = np.bincount(owner, minlength=n)
    start = np.concatenate([[0], np.cumsum(size)])
    rarer = size - np.array([_least(k) for k in size.tolist()]) + 1
    inside = np.arange(len(owner)) - start[owner] < rarer[owner]
    by_token = np.lexsort((owner[inside], token[inside]))
    holders, held = owner[inside][by_token], token[inside][by_token]
    low, high = np.searchsorted(held, token), np.searchsorted(held, token, side="right")
    tree, label, mark, cross = [], np.arange(n), np.zeros(len(distinct), bool), sides.any()
    for i in range(n):
        at = np.arange(start[i], start[i] + rarer[i])
        at = at[high[at] - low[at] > 1]
        if not len(at):
            continue
        near = np.unique(np.concatenate([holders[low[k]:high[k]] for k in at]))
        near = near[(near < i) & (label[near] != label[i]) & (np.minimum(size[near], size[i]) >= SIMILAR * np.maximum(size[near], size[i]))]
        if cross:
            near = near[sides[near] != sides[i]]
        mark[token[start[i]:start[i + 1]]] = True
        # a step of these at a time, so memory does not follow their number
        for k in range(0, len(near), 1024):
            some = near[k:k + 1024]
            ends = np.cumsum(size[some])
            spots = np.arange(ends[-1]) + np.repeat(start[some] - (ends - size[some]), size[some])
            both = np.add.reduceat(mark[token[spots]].astype(np.int64), ends - size[some])
            for j in some[both >= SIMILAR * (size[some] + size[i] - both)].tolist():
                if label[i] != label[j]:
                    tree.append((j, i))
                    label[label == label[i]] = label[j]
        mark[token[start[i]:start[i + 1]]] = False
    return tree
