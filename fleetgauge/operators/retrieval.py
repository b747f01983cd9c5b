"""Keyword and vector index, and hybrid retrieval behind an access wall.

Hashed vectors are whole numbers, so their dot products are exact and do not depend on the order of summation; vectors
of a model may be given instead, of any length. Keyword contributions are summed as fixed-point whole numbers. Equal
chunks therefore get equal scores and ties fall back to corpus order.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.functions import text as tx
from fleetgauge.policies import RetrievalFilters, RetrievalWeights
from fleetgauge.session import stored

DIMENSION = 32
K1, B = 1.5, 0.75
FIXED_POINT = 1e12
QUERY_BLOCK = 256  # queries and chunks scored together, on average: the size of a task's matrix
CHUNK_BLOCK = 8192
IMPACT_BLOCK = 1024  # chunks whose postings of a term are stored together
PAIRS = 1 << 19  # pairs of a query and a chunk counted in a task
FIRST_BLOCKS = 2  # blocks scored to get a first k-th best score


# --- index -------------------------------------------------------------------------------------


def _summed_hashes(dim: int):
    """Per list of tokens: the signs of their hashes added up by bucket. A word is hashed once per batch."""
    def run(tokens: pa.Array) -> pa.Array:
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        hashes = [hashlib.sha256(word.encode()).hexdigest() for word in coded.dictionary.to_pylist()]
        bucket = np.array([int(h[:8], 16) % dim for h in hashes], np.int64)
        sign = np.array([int(h[9], 16) % 2 * 2 - 1 for h in hashes], np.float64)
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.repeat(np.arange(len(sizes)), sizes) * dim + bucket[word]
        sums = np.bincount(place, weights=sign[word], minlength=len(sizes) * dim).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * dim, pa.int32()), pa.array(sums))
    return run


def vector_of(text: Column, dim: int = DIMENSION) -> Column:
    """Signed feature hashes of a text's tokens as ARRAY<BIGINT>; null without tokens. A value of the row alone."""
    vector = F.arrow_udf(_summed_hashes(dim), "array<bigint>")(tx.embedding_tokens(text))
    return F.when(F.lower(text).rlike(v.EMBEDDING_TOKEN_PATTERN), vector)


NORM = "sqrt(CAST(aggregate(vector, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS DOUBLE)) AS norm"


def hashed_embedding(texts: DataFrame, key: str, column: str, dim: int = DIMENSION) -> DataFrame:
    """``key, vector ARRAY<BIGINT>, norm``; null vector for a text without tokens. No shuffle."""
    return texts.select(key, vector_of(F.col(column), dim).alias("vector")).selectExpr("*", NORM)


def l2_normalise(vectors: DataFrame, column: str) -> DataFrame:
    """Unit vectors as ARRAY<DOUBLE>; a zero vector stays zero."""
    squares = f"aggregate({column}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))"
    return vectors.withColumn("_norm", F.expr(f"sqrt({squares})")).withColumn(column, F.expr(
        f"transform({column}, x -> CAST(x AS DOUBLE) / IF(_norm = 0, 1D, _norm))")).drop("_norm")


def cosine_score(a: str, b: str) -> str:
    """SQL text: dot product of two unit vectors; unequal dimensions are an error."""
    return (f"IF(size({a}) = size({b}), aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x), "
            f"CAST(raise_error('vector dimensions differ') AS DOUBLE))")


def term_counts(texts: DataFrame, key: str, column: str, out: str) -> DataFrame:
    """``key, term, out``: how often each term occurs in the texts of a key.

    The sorted tokens of a text are counted by their runs, in its row, so a task holds one text at a time. Only keys that
    occur in several rows have their counts added up.
    """
    def counted(rows: DataFrame) -> DataFrame:
        tokens = rows.select(key, F.sort_array(tx.tokenize(F.col(column))).alias("_tokens"))
        runs = tokens.selectExpr("*", "IF(size(_tokens) > 0, filter(sequence(0, size(_tokens) - 1), "
                                 "i -> i = 0 OR _tokens[i] <> _tokens[i - 1]), array()) AS _starts")
        return runs.selectExpr(key, "inline(transform(_starts, (i, k) -> named_struct('term', _tokens[i], "
                               f"'{out}', CAST(IF(k + 1 < size(_starts), _starts[k + 1], size(_tokens)) - i AS BIGINT))))")

    repeated = stored(texts.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"), "repeated-keys")
    if repeated.isEmpty():
        return counted(texts)
    same = F.col(key).eqNullSafe(F.col("_key"))
    added = counted(texts.join(repeated, same, "left_semi")).groupBy(key, "term").agg(F.sum(out).alias(out))
    return counted(texts.join(repeated, same, "left_anti")).unionByName(added)


def postings(chunks: DataFrame) -> DataFrame:
    """``chunk_id, term, tf``."""
    return term_counts(chunks, "chunk_id", "text", "tf")


def indexed_chunks(chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Chunks with ``doc_len, vector, norm``. ``vectors`` (chunk_id, vector) are those of a model; without them texts are hashed."""
    sized = chunks.withColumn("doc_len", F.size(tx.tokenize(F.col("text"))))
    if vectors is None:
        indexed = sized.withColumn("vector", vector_of(F.col("text")))
    else:
        indexed = sized.join(vectors.select("chunk_id", "vector"), "chunk_id", "left")
    return indexed.selectExpr("*", NORM)


def build_index(chunks: DataFrame, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Indexed chunks and postings.

    The whole corpus is indexed, restricted chunks included: term statistics must not change
    with the reader's access.
    """
    return indexed_chunks(chunks, vectors), postings(chunks)


def term_df(posting_table: DataFrame) -> DataFrame:
    """Document frequency per term; postings are distinct per chunk, so a count suffices."""
    return posting_table.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(indexed: DataFrame) -> DataFrame:
    """One row: number of chunks and mean length."""
    return indexed.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("doc_len").alias("avg_len"))


# --- keyword scores ------------------------------------------------------------------------------


def query_terms(queries: DataFrame) -> DataFrame:
    terms = F.array_distinct(tx.tokenize(F.col("query")))
    return queries.select("query_id", F.explode(terms).alias("term"))


def shared_terms(queries: DataFrame, indexed: DataFrame, posting_table: DataFrame) -> DataFrame:
    """``query_id, chunk_id, shared_terms, hits`` of every chunk that shares a term with the query.

    The asked terms' postings are dealt by chunk into parts of PAIRS pairs at most on average. What a pair shares lies in one part
    then, so pairs are counted where they arise and none is shuffled; more queries or chunks are more parts.
    """
    asked = stored(query_terms(queries), "asked")
    hits = posting_table.join(asked.select("term").distinct(), "term", "left_semi")
    parts = max(1, -(-indexed.count() * queries.count() // PAIRS))
    return hits.repartition(parts, "chunk_id").join(asked, "term").groupBy("query_id", "chunk_id").agg(
        F.count(F.lit(1)).alias("shared_terms"), F.sum("tf").alias("hits"))


def _idf(n: str, df: str = "df") -> str:
    return f"ln(1D + ({n} - {df} + 0.5D) / ({df} + 0.5D))"


def _weights(asked: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """Asked terms that occur, with their idf. They are few beside the corpus and are stored, so their size is known when they are joined."""
    return stored(asked.join(term_df(hits), "term").selectExpr("query_id", "term", f"{_idf(str(n))} AS idf"), "asked-weights")


def _spread(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``counts[i]`` numbers for every i."""
    ends = np.cumsum(counts)
    return np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _block_scores(avg_len: float, schema: pa.Schema):
    """The pairs of a block of chunks and a block of queries that share a term. Rows without a term are the lengths of the block's chunks."""
    def run(posts: pa.Table, asks: pa.Table) -> pa.Table:
        is_length = pc.is_null(posts.column("term"))
        lengths, hits = posts.filter(is_length), posts.filter(pc.invert(is_length))
        if not lengths.num_rows or not hits.num_rows or not asks.num_rows:
            return schema.empty_table()
        ids = pc.unique(lengths.column("chunk_id"))
        owner = pc.index_in(lengths.column("chunk_id"), value_set=ids).to_numpy()
        doc_len = lengths.column("tf").to_numpy()[np.argsort(owner, kind="stable")].astype("float64")
        copies = np.bincount(owner, minlength=len(ids))
        first_copy = np.cumsum(copies) - copies
        # pairs (term number, query), sorted by term, and for each term where its pairs begin
        asked = asks.column("terms").combine_chunks()
        words = asked.flatten().field("term")
        names = pc.unique(words)
        word = pc.index_in(words, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(word, kind="stable")
        query = np.repeat(np.arange(asks.num_rows), asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[order]
        start = np.searchsorted(word[order], np.arange(len(names) + 1))
        idf = np.zeros(len(names))
        idf[word] = asked.flatten().field("idf").to_numpy(zero_copy_only=False)

        chunk, term = (pc.index_in(hits.column(c), value_set=v) for c, v in (("chunk_id", ids), ("term", names)))
        known = pc.and_(chunk.is_valid(), term.is_valid())
        chunk, term = (c.filter(known).to_numpy().astype(np.int64) for c in (chunk, term))
        tf = hits.column("tf").filter(known).to_numpy().astype("float64")
        order = np.argsort(chunk, kind="stable")
        chunk, term, tf = chunk[order], term[order], tf[order]
        n = copies[chunk]
        length = doc_len[_spread(n, first_copy[chunk])]
        chunk, term, tf = (np.repeat(x, n) for x in (chunk, term, tf))
        part = np.floor(_saturated(tf, length, avg_len, idf[term]) * FIXED_POINT + 0.5)
        fan = start[term + 1] - start[term]
        # some chunks at a time, so memory follows neither the pairs nor the terms they share
        reach, q = np.cumsum(fan), asks.num_rows
        found, low = [], 0
        while low < len(chunk):
            high = int(np.searchsorted(reach, (reach[low - 1] if low else 0) + PAIRS))
            if high < len(chunk):
                high = max(int(np.searchsorted(chunk, chunk[high], "left")), int(np.searchsorted(chunk, chunk[low], "right")))
            base, width = chunk[low], chunk[high - 1] - chunk[low] + 1
            place = np.repeat((chunk[low:high] - base) * q, fan[low:high]) + query[_spread(fan[low:high], start[term[low:high]])]
            total = np.bincount(place, weights=np.repeat(part[low:high], fan[low:high]), minlength=width * q)
            met = np.zeros(width * q, bool)
            met[place] = True
            at = np.flatnonzero(met)
            found.append((at % q, at // q + base, total[at] / FIXED_POINT))
            low = high
        if not found:
            return schema.empty_table()
        rows, chunks, scores = (np.concatenate(x) for x in zip(*found))
        return pa.Table.from_arrays([
            asks.column("query_id").combine_chunks().take(pa.array(rows)), ids.take(pa.array(chunks)), pa.array(scores)], schema=schema)
    return run


def bm25_score(queries: DataFrame, indexed: DataFrame, posting_table: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``query_id, chunk_id, score`` of every chunk (of ``candidates``, if given) that shares a term with the query.

    The postings of the asked terms are dealt by chunk into blocks, with the lengths of the chunks as rows without a term. A block of
    chunks meets each block of queries in a group that adds up the contributions of its pairs, so pairs become rows once they are
    scored and none is shuffled. How frequent terms are is told by the whole corpus. For the best chunks alone see ``bm25_topk``.
    """
    id_type = dict(queries.dtypes)["query_id"]
    stats = corpus_stats(indexed).first()
    n, avg_len = int(stats["n_chunks"]), float(stats["avg_len"] or 0.0)
    asked = stored(query_terms(queries), "asked")
    weights = _weights(asked, posting_table.join(asked.select("term").distinct(), "term", "left_semi"), n)
    terms = stored(weights.select("term").distinct(), "asked-terms")
    asks = stored(weights.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms")), "asked-queries")
    query_blocks, chunk_blocks = max(1, -(-asks.count() // QUERY_BLOCK)), max(1, -(-n // CHUNK_BLOCK))
    scored = indexed if candidates is None else indexed.join(candidates.select("chunk_id"), "chunk_id", "left_semi")
    hits = posting_table.join(terms, "term", "left_semi").selectExpr("chunk_id", "term", "CAST(tf AS BIGINT) AS tf")
    rows = hits.unionByName(scored.selectExpr("chunk_id", "CAST(NULL AS STRING) AS term", "CAST(doc_len AS BIGINT) AS tf")).where(
        "chunk_id IS NOT NULL").selectExpr(
        "*", f"pmod(xxhash64(chunk_id), {chunk_blocks}) AS cb", f"explode(sequence(0L, {query_blocks - 1}L)) AS qb")
    asking = asks.selectExpr("*", f"pmod(xxhash64(query_id), {query_blocks}) AS qb", f"explode(sequence(0L, {chunk_blocks - 1}L)) AS cb")
    key = queries.select("query_id").limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("query_id", key), ("chunk_id", pa.string()), ("score", pa.float64())])
    return rows.groupBy("qb", "cb").cogroup(asking.groupBy("qb", "cb")).applyInArrow(
        _block_scores(avg_len, schema), f"query_id {id_type}, chunk_id string, score double")


IMPACTS = ("term string, block bigint, n bigint, most double, entries array<struct<chunk_id:string,tf:bigint,doc_len:int>>, "
           "n_chunks bigint, avg_len double")


def _saturated(tf: np.ndarray, doc_len: np.ndarray, avg_len: float, idf: float = 1.0) -> np.ndarray:
    """What a term with weight ``idf`` adds to a chunk's score."""
    norm = K1 * (1 - B + B * doc_len / avg_len) if avg_len else K1
    return idf * tf * (K1 + 1) / (tf + norm)


def _blocked(n_chunks: int, avg_len: float):
    """The postings and chunks of a block as one row per term."""
    entry = pa.struct([("chunk_id", pa.string()), ("tf", pa.int64()), ("doc_len", pa.int32())])
    schema = pa.schema([("term", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("most", pa.float64()), ("entries", pa.list_(entry)),
                        ("n_chunks", pa.int64()), ("avg_len", pa.float64())])
    lengths = pa.schema([("chunk", pa.string()), ("doc_len", pa.int32())])

    def run(key: tuple[pa.Scalar, ...], posts: pa.Table, chunks: pa.Table) -> pa.Table:
        if not posts.num_rows:
            return schema.empty_table()
        chunks = chunks.select(lengths.names) if chunks.num_rows else lengths.empty_table()
        coded = posts.column("term").combine_chunks().dictionary_encode()
        term, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        df = np.bincount(term, minlength=len(names))
        posts = posts.select(["chunk_id", "tf"]).append_column("term", pa.array(term))
        held = posts.join(chunks, "chunk_id", "chunk", join_type="inner").sort_by([("term", "ascending"), ("chunk_id", "ascending")])
        columns = [held.column(c).combine_chunks() for c in ("chunk_id", "tf", "doc_len")]
        term = held.column("term").to_numpy()
        starts = np.searchsorted(term, np.arange(len(names) + 1))
        most = np.zeros(len(names))
        np.maximum.at(most, term, _saturated(*(c.to_numpy().astype("float64") for c in columns[1:]), avg_len))
        entries = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(entry)))
        every = len(names)
        return pa.Table.from_arrays([
            names, pa.array(np.full(every, key[0].as_py()), pa.int64()), pa.array(df, pa.int64()), pa.array(most), entries,
            pa.array(np.full(every, n_chunks), pa.int64()), pa.array(np.full(every, avg_len, "float64"))], schema=schema)
    return run


def impact_blocks(indexed: DataFrame, posting_table: DataFrame) -> DataFrame:
    """``term, block, n, most, entries, n_chunks, avg_len``: the postings of a term in a block of chunks with what their scores need,
    how many they are and the most that a term of weight 1 adds among them.

    A block has about IMPACT_BLOCK chunks, so no row grows with the corpus: a frequent term has more rows, not a longer one.
    Postings are shuffled once, by block, and become lists where they then lie.
    """
    stats = corpus_stats(indexed).first()
    n, avg_len = int(stats["n_chunks"]), float(stats["avg_len"] or 0.0)
    block = f"pmod(xxhash64(chunk_id), {max(1, -(-n // IMPACT_BLOCK))}) AS block"
    posts = posting_table.selectExpr("term", "chunk_id", "CAST(tf AS BIGINT) AS tf", block)
    # both sides may come from one frame, whose columns a cogroup can't tell apart
    lengths = indexed.selectExpr("chunk_id AS chunk", "CAST(doc_len AS INT) AS doc_len", block)
    return posts.groupBy("block").cogroup(lengths.groupBy("block")).applyInArrow(_blocked(n, avg_len), IMPACTS)


def _best_of_block(top_k: int, schema: pa.Schema):
    """The best chunks of a block for each query that asks for it, from the lists of the queries' terms."""
    def run(lists: pa.Table, asks: pa.Table) -> pa.Table:
        if not lists.num_rows or not asks.num_rows:
            return schema.empty_table()
        entries = lists.column("entries").combine_chunks()
        flat = entries.flatten()
        # ids get numbers in their own order, so a tie goes to the smaller id
        names = pc.unique(flat.field("chunk_id")).sort()
        number = pc.index_in(flat.field("chunk_id"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        tf, doc_len = (flat.field(c).to_numpy(zero_copy_only=False).astype("float64") for c in ("tf", "doc_len"))
        avg_len = lists.column("avg_len")[0].as_py()
        ends = np.append(0, np.cumsum(entries.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        places: dict[str, list[tuple[int, int]]] = {}
        for i, term in enumerate(lists.column("term").to_pylist()):
            places.setdefault(term, []).append((ends[i], ends[i + 1]))
        rows, chunks, totals = [], [], []
        for i, terms in enumerate(asks.column("terms").to_pylist()):
            spans = [(low, high, t["idf"]) for t in terms for low, high in places.get(t["term"], ())]
            if not spans:
                continue
            total, met = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
            for low, high, idf in spans:
                part = np.floor(_saturated(tf[low:high], doc_len[low:high], avg_len, idf) * FIXED_POINT + 0.5)
                np.add.at(total, number[low:high], part.astype(np.int64))
                met[number[low:high]] = True
            held = np.flatnonzero(met)
            best = held[np.argsort(-total[held], kind="stable")[:top_k]]
            rows.append(np.full(len(best), i))
            chunks.append(best)
            totals.append(total[best])
        if not rows:
            return schema.empty_table()
        return pa.Table.from_arrays([
            asks.column("query_id").take(pa.array(np.concatenate(rows))), names.take(pa.array(np.concatenate(chunks))),
            pa.array(np.concatenate(totals))], schema=schema)
    return run


def bm25_topk(queries: DataFrame, impacts: DataFrame, top_k: int = 10) -> DataFrame:
    """``query_id, rank, chunk_id, score``: the ``top_k`` chunks of each query by keyword score, ties by id.

    A block of chunks can't score more than the sum of the most its terms add. The FIRST_BLOCKS most promising blocks
    of a query are scored; what its k-th chunk then has is the least that counts, so only blocks whose bound
    reaches it are scored besides. The result is exact. Pairs of queries and blocks become rows, pairs of queries and chunks don't.
    """
    id_type = dict(queries.dtypes)["query_id"]
    asked = stored(query_terms(queries), "asked")
    terms = stored(asked.select("term").distinct(), "asked-terms")
    found_terms = stored(impacts.select("term", "block", "n", "most", "n_chunks").join(terms, "term", "left_semi"), "asked-blocks")
    idf = found_terms.groupBy("term").agg(F.sum("n").alias("df"), F.max("n_chunks").alias("n_chunks")).selectExpr("term", f"{_idf('n_chunks')} AS idf")
    asked = stored(asked.join(idf, "term"), "asked-weights")
    # rounding of the parts and of this product is well below 1
    bounds = stored(asked.join(found_terms, "term").groupBy("query_id", "block").agg(
        F.expr(f"sum(CAST(round(idf * most * {FIXED_POINT:.0f}D) AS BIGINT) + 1)").alias("bound")), "block-bounds")
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    by_total = Window.partitionBy("query_id").orderBy(F.desc("total"), "chunk_id")
    first = stored(bounds.withColumn("_place", F.row_number().over(by_bound)).where(f"_place <= {FIRST_BLOCKS}").drop("_place"), "first-blocks")

    lists = impacts.select("term", "block", "entries", "avg_len").join(terms, "term", "left_semi")
    by_query = stored(asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms")), "asked-queries")
    key = queries.select("query_id").limit(0).toArrow().schema.field(0).type
    rows = pa.schema([("query_id", key), ("chunk_id", pa.string()), ("total", pa.int64())])

    def scored(pairs: DataFrame) -> DataFrame:
        """A block's lists are shuffled once for all queries that ask for the block."""
        asks = pairs.select("query_id", "block").join(by_query, "query_id")
        blocks = stored(pairs.select("block").distinct(), "wanted-blocks")
        return lists.join(blocks, "block", "left_semi").groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(
            _best_of_block(top_k, rows), f"query_id {id_type}, chunk_id string, total bigint")

    best = stored(scored(first), "first-best")
    least = best.withColumn("_place", F.row_number().over(by_total)).where(f"_place = {top_k}").select("query_id", F.col("total").alias("least"))
    rest = stored(bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(least, "query_id", "left").where(
        "least IS NULL OR bound >= least"), "other-blocks")
    return best.unionByName(scored(rest)).withColumn("rank", F.row_number().over(by_total)).where(f"rank <= {top_k}").select(
        "query_id", "rank", "chunk_id", (F.col("total") / F.lit(FIXED_POINT)).alias("score"))


# --- access and filters --------------------------------------------------------------------------


def access_wall(chunks: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    return chunks.filter(F.col("access_level").isin(*allowed))


def metadata_filter(chunks: DataFrame, filters: RetrievalFilters) -> DataFrame:
    out = chunks
    if filters.feature is not None:
        out = out.filter(F.col("feature") == filters.feature)
    if filters.source_types is not None:
        out = out.filter(F.col("source_type").isin(*filters.source_types))
    if filters.vehicle_platform is not None:
        out = out.filter(F.col("vehicle_platform") == filters.vehicle_platform)
    return out


def candidate_counts(chunks: DataFrame, filters: RetrievalFilters) -> DataFrame:
    """One row: chunks considered after all filters, and chunks the access wall withheld."""
    allowed = F.col("access_level").isin(*filters.allowed_access)
    passing = metadata_filter(access_wall(chunks, filters.allowed_access), filters)
    considered = passing.agg(F.count(F.lit(1)).alias("candidates_considered"))
    withheld = chunks.agg(F.count_if(~allowed).alias("excluded_by_access"))
    return considered.join(withheld)  # one row each


def minmax(x: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1 between the extremes; a flat set becomes 0 or 1."""
    flat = F.when(high <= 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(high - low < 1e-12, flat).otherwise((x - low) / (high - low))


def minmax_per_query(scores: DataFrame, column: str, out: str, candidates: DataFrame, listed: bool = False) -> DataFrame:
    """Min-max over each query's candidates, from pre-aggregated extremes.

    ``scores`` lists pairs with a score other than 0; candidates that are not listed have 0 and count among the extremes.
    Listed pairs that are no candidates (withheld or filtered out) are dropped; with ``listed`` all pairs are known to be candidates,
    and none is looked up. The extremes, a row per query, are written, so their size is known when the pairs meet them.
    """
    n = candidates.count()
    if not listed:
        scores = scores.join(candidates.select("chunk_id"), "chunk_id", "left_semi")
    bounds = stored(scores.groupBy("query_id").agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count("*").alias("_n")).selectExpr(
        "query_id", f"IF(_n < {n}, least(_lo, 0), _lo) AS _lo", f"IF(_n < {n}, greatest(_hi, 0), _hi) AS _hi"), "query-extremes")
    return scores.join(bounds, "query_id").withColumn(
        out, minmax(F.col(column), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def prior_score(today: dt.date, weights: RetrievalWeights) -> Column:
    """Trust bonus and staleness penalty of a chunk."""
    trust = F.create_map(*[F.lit(x) for kv in v.SOURCE_TRUST.items() for x in kv])[F.col("source_type")]
    stale = tx.is_stale(F.col("valid_from"), today, weights.stale_after_days)
    return F.lit(weights.trust_boost) * trust - F.when(stale, F.lit(weights.stale_penalty)).otherwise(0.0)


# --- hybrid retrieval ------------------------------------------------------------------------------


def _scaled(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    flat = hi - lo < 1e-12
    return np.where(flat, np.where(hi <= 0, 0.0, 1.0), (x - lo) / np.where(flat, 1.0, hi - lo))


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    """Vectors over their norms; a missing or zero vector is zero."""
    listed = table.column("vector").combine_chunks()
    out = np.zeros((table.num_rows, dim))
    have = np.asarray(listed.is_valid())
    if have.any():
        out[have] = listed.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dim)
    return out


def _norms(table: pa.Table) -> np.ndarray:
    norms = pc.fill_null(table.column("norm"), 1.0).to_numpy().astype("float64")
    return np.where(norms == 0, 1.0, norms)


def _dimension(*tables: pa.Table) -> int:
    sizes = {n for t in tables for n in pc.unique(pc.list_value_length(t.column("vector"))).to_pylist() if n is not None}
    if len(sizes) > 1:
        raise ValueError(f"vector dimensions differ: {sorted(sizes)}")
    return sizes.pop() if sizes else 1


def _pair_scores(queries: pa.Table, chunks: pa.Table, avg_len: float) -> tuple[np.ndarray, np.ndarray]:
    """(cosine, keyword) of every chunk (rows) against every query (columns) of two blocks."""
    dim = _dimension(queries, chunks)
    cosine = (_matrix(chunks, dim) @ _matrix(queries, dim).T) / (_norms(chunks)[:, None] * _norms(queries))
    n, q = chunks.num_rows, queries.num_rows
    asked, held = queries.column("terms").combine_chunks(), chunks.column("hits").combine_chunks()
    words = asked.flatten().field("term")
    names = pc.unique(words)
    keyword = np.zeros((n, q))
    if not len(names) or not len(held.flatten()):
        return cosine, keyword
    # pairs (term number, query), sorted by term, and for each term where its pairs begin
    term_of = pc.index_in(words, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    query_of = np.repeat(np.arange(q), asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    order = np.argsort(term_of, kind="stable")
    query_of, start = query_of[order], np.searchsorted(term_of[order], np.arange(len(names) + 1))
    idf = np.zeros(len(names))
    idf[term_of] = asked.flatten().field("idf").to_numpy(zero_copy_only=False)
    hits = held.flatten()
    found = pc.index_in(hits.field("term"), value_set=names)
    known = np.asarray(found.is_valid())
    term = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[known]
    tf = hits.field("tf").to_numpy(zero_copy_only=False).astype("float64")[known]
    length = chunks.column("doc_len").to_numpy().astype("float64")[row]
    norm = K1 * (1 - B + B * length / avg_len) if avg_len else K1
    part = np.rint(idf[term] * tf * (K1 + 1) / (tf + norm) * FIXED_POINT)
    fan = start[term + 1] - start[term]
    first = np.repeat(start[term] - np.cumsum(fan) + fan, fan)
    flat = np.repeat(row, fan) * q + query_of[first + np.arange(fan.sum())]
    keyword = np.bincount(flat, weights=np.repeat(part, fan), minlength=n * q).reshape(n, q)
    return cosine, keyword / FIXED_POINT


_BOUNDS = ("cos_lo", "cos_hi", "kw_lo", "kw_hi")


def _extremes(avg_len: float, schema: pa.Schema):
    def run(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        if not queries.num_rows or not chunks.num_rows:
            return schema.empty_table()
        cos, kw = _pair_scores(queries, chunks, avg_len)
        return pa.Table.from_arrays([queries.column("query_id"), *(pa.array(x) for x in (cos.min(0), cos.max(0), kw.min(0), kw.max(0)))], schema=schema)
    return run


def _local_best(avg_len: float, weights: RetrievalWeights, top_k: int, schema: pa.Schema):
    def run(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        if not queries.num_rows or not chunks.num_rows:
            return schema.empty_table()
        # chunks in corpus order, so a stable sort breaks ties by it
        chunks = chunks.sort_by([("file_name", "ascending"), ("ordinal", "ascending")])
        cos, kw = _pair_scores(queries, chunks, avg_len)
        lo_hi = [queries.column(c).to_numpy() for c in _BOUNDS]
        final = (weights.vector * _scaled(cos, *lo_hi[:2]) + weights.keyword * _scaled(kw, *lo_hi[2:])
                 + chunks.column("prior").to_numpy()[:, None])
        k = min(top_k, chunks.num_rows)
        rows = np.argsort(-final, axis=0, kind="stable")[:k].T.ravel()
        q = np.repeat(np.arange(queries.num_rows), k)
        held = [chunks.column(c).take(pa.array(rows)) for c in ("chunk_id", "file_name", "ordinal")]
        return pa.Table.from_arrays(
            [queries.column("query_id").take(pa.array(q)), *held, *(pa.array(x[rows, q]) for x in (final, cos, kw))], schema=schema)
    return run


def hybrid_retrieve(
    indexed: DataFrame, posting_table: DataFrame, queries: DataFrame, *, today: dt.date,
    filters: RetrievalFilters = RetrievalFilters(), weights: RetrievalWeights = RetrievalWeights(),
    top_k: int = 5,
) -> DataFrame:
    """Ranked chunks per query: ``query_id, rank, chunk_id, score, vector_score, keyword_score``.

    ``queries``: ``query_id`` (of any type, one row each), ``query`` and, if the index holds vectors of a model, ``vector``.

    Every candidate has to be scored, since scores are scaled by each query's extremes. Queries and chunks lie in blocks
    by hash; each pair of a query block and a chunk block is a group that scores its pairs as a matrix, first for the
    extremes, then for ``top_k`` rows per query. Pairs never become rows, nothing passes through the driver but counts, and
    more queries are more groups of the same two passes.
    """
    id_type = dict(queries.dtypes)["query_id"]
    if "vector" not in queries.columns:
        queries = queries.withColumn("vector", vector_of(F.col("query")))
    stats = corpus_stats(indexed).first()
    avg_len, n = float(stats["avg_len"] or 0.0), int(stats["n_chunks"])
    asked = stored(query_terms(queries), "asked")
    hits = posting_table.join(asked.select("term").distinct(), "term", "left_semi")
    # postings are read once; the lists of the asked terms, of all chunks, also tell how frequent these are
    per_chunk = stored(hits.groupBy("chunk_id").agg(
        F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("hits")), "chunk-hits")
    idf = term_df(per_chunk.select(F.explode("hits.term").alias("term"))).selectExpr("term", f"{_idf(str(n))} AS idf")
    terms = asked.join(idf, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms"))
    candidates = metadata_filter(access_wall(indexed, filters.allowed_access), filters).select(
        "chunk_id", "file_name", F.col("ordinal").cast("int").alias("ordinal"), "doc_len", "vector", "norm", prior_score(today, weights).alias("prior"))
    left = stored(queries.selectExpr("query_id", "vector", NORM).join(terms, "query_id", "left"), "asked-blocks")
    right = stored(candidates.join(per_chunk, "chunk_id", "left"), "chunk-blocks")
    query_blocks, chunk_blocks = max(1, -(-left.count() // QUERY_BLOCK)), max(1, -(-right.count() // CHUNK_BLOCK))

    def paired(asks: DataFrame):
        """The query side and the chunk side of every pair of blocks."""
        asks = asks.withColumn("qb", F.expr(f"pmod(xxhash64(query_id), {query_blocks})")).withColumn(
            "cb", F.expr(f"explode(sequence(0L, {chunk_blocks - 1}L))"))
        chunks = right.withColumn("cb", F.expr(f"pmod(xxhash64(chunk_id), {chunk_blocks})")).withColumn(
            "qb", F.expr(f"explode(sequence(0L, {query_blocks - 1}L))"))
        return asks.groupBy("qb", "cb").cogroup(chunks.groupBy("qb", "cb"))

    key = left.limit(0).select("query_id").toArrow().schema.field(0).type
    spans = pa.schema([("query_id", key), *((c, pa.float64()) for c in _BOUNDS)])
    rows = pa.schema([("query_id", key), ("chunk_id", pa.string()), ("file_name", pa.string()), ("ordinal", pa.int32()),
                      *((c, pa.float64()) for c in ("score", "vector_score", "keyword_score"))])
    extremes = paired(left).applyInArrow(
        _extremes(avg_len, spans), f"query_id {id_type}, " + ", ".join(f"{c} double" for c in _BOUNDS)).groupBy("query_id").agg(
        *[(F.min if c.endswith("lo") else F.max)(c).alias(c) for c in _BOUNDS])
    best = paired(left.join(extremes, "query_id")).applyInArrow(
        _local_best(avg_len, weights, top_k, rows),
        f"query_id {id_type}, chunk_id string, file_name string, ordinal int, score double, vector_score double, keyword_score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "file_name", "ordinal")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).drop("file_name", "ordinal")


# --- the query text of a diagnosis ---------------------------------------------------------------


def retrieval_query_text(metrics: DataFrame) -> DataFrame:
    """Per log: base vocabulary, failing metrics, then the names of metrics that are missing.

    A log has thirteen metrics, so the lists are short.
    """
    failing = F.expr("array_join(transform(array_sort(collect_list(CASE WHEN passed = false THEN "
                     "named_struct('i', metric_index, 'n', name) END)), x -> x.n), ' ')")
    missing = F.expr("array_join(transform(array_sort(collect_list(CASE WHEN value IS NULL AND value_bool IS NULL "
                     "THEN named_struct('i', metric_index, 'n', name) END)), x -> x.n), ' ')")
    return metrics.groupBy("file_id").agg(failing.alias("f"), missing.alias("m")).select(
        "file_id", F.concat_ws(
            " ", F.lit(v.BASE_QUERY), F.expr("nullif(f, '')"),
            F.when(F.col("m") != "", F.concat(F.lit(v.LOGGING_QUERY + " "), F.col("m")))).alias("query"))

