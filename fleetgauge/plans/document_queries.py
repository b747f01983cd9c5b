"""Documents, chunks, embeddings and retrieval."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.functions import text as tx
from fleetgauge.operators import cells, corpus, listings, retrieval
from fleetgauge.plans import document_views as dv  # noqa: F401  (adds the views)
from fleetgauge.plans import fixtures as fx
from fleetgauge.plans.registry import r6, register, rounded
from fleetgauge.plans.telemetry_queries import _analysis
from fleetgauge.policies import RetrievalFilters, RetrievalWeights
from fleetgauge.session import shared_folder

TODAY = dt.date(2026, 6, 1)
READER = RetrievalFilters(allowed_access=("public", "internal"), feature="AEB")


def _parsed(spark, sf_dir):
    return corpus.front_matter(fx.raw_documents(spark, sf_dir))


@register("tokenize", r"""
SELECT doc_id, term, count(*) AS n FROM (
  SELECT doc_id, trim(unnest(regexp_extract_all(lower(raw), '[a-z0-9][a-z0-9_.\-]*')), '.-') AS term FROM v_docs) x
WHERE length(term) > 1 GROUP BY doc_id, term""")
def tokenize(spark, sf_dir):
    return retrieval.term_counts(fx.raw_documents(spark, sf_dir), "doc_id", "raw", "n")


@register("neutralise", r"""
SELECT page_id, replace(regexp_replace(html, '[\x00-\x08\x0b-\x1f\x7f]|\x{80}|[\x{81}-\x{9f}]', '', 'g'), '```', '''''''') AS safe FROM pages""")
def neutralise(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", tx.neutralise(F.col("html")).alias("safe"))


@register("front_matter", """
SELECT doc_id, key, value, CAST(length(body) AS BIGINT) AS body_chars FROM v_fields f JOIN (SELECT doc_id AS d, body FROM v_parsed) p ON f.doc_id = p.d""")
def front_matter(spark, sf_dir):
    return _parsed(spark, sf_dir).selectExpr("doc_id", "CAST(length(body) AS BIGINT) AS body_chars", "inline(fields)")


@register("document_meta", """
SELECT document_id, file_name, title, sha256, source_type, feature, CAST(valid_from AS VARCHAR) AS valid_from, access_level FROM v_meta""")
def document_meta(spark, sf_dir):
    return corpus.document_meta(_parsed(spark, sf_dir)).select(
        "document_id", "file_name", "title", "sha256", "source_type", "feature",
        F.col("valid_from").cast("string").alias("valid_from"), "access_level")


@register("split_sections", """
SELECT m.file_name, section, heading, text FROM v_sections s JOIN v_meta m ON s.doc_id = m.doc_id""")
def split_sections(spark, sf_dir):
    return corpus.split_sections(_parsed(spark, sf_dir))


@register("split_long", """
SELECT m.file_name, section, row_number() OVER (PARTITION BY m.file_name, section ORDER BY ordinal) - 1 AS part, piece
FROM v_pieces p JOIN v_meta m ON p.doc_id = m.doc_id""")
def split_long(spark, sf_dir):
    return corpus.split_sections(_parsed(spark, sf_dir)).selectExpr(
        "file_name", "section", f"posexplode({corpus.split_long('text')}) AS (part, piece)")


@register("chunk_documents", """
SELECT chunk_id, document_id, document_title, ordinal, heading, text, source_type, feature, CAST(valid_from AS VARCHAR) AS valid_from, access_level FROM v_chunks""")
def chunk_documents(spark, sf_dir):
    return fx.chunks(spark, sf_dir).select(
        "chunk_id", "document_id", "document_title", "ordinal", "heading", "text", "source_type", "feature",
        F.col("valid_from").cast("string").alias("valid_from"), "access_level")


@register("requirement_ids", r"""
SELECT chunk_id, id FROM (SELECT DISTINCT chunk_id,
  unnest(regexp_extract_all(heading || ' ' || piece, '\b(?:REQ|TC|SCN)-[A-Z]+(?:-[A-Z]+)*-\d+\b|\bINC-\d+\b')) AS id FROM v_chunks) x""")
def requirement_ids(spark, sf_dir):
    return fx.chunks(spark, sf_dir).select("chunk_id", F.explode("requirement_ids").alias("id"))


_VOCABULARY = ("REQ-AEB", "preamble", "that", "INC-2041", "de la", "ego_speed_mps")


@register("related_signals", f"""
SELECT chunk_id, s.signal AS signal FROM v_chunks, (SELECT unnest({list(_VOCABULARY)}) AS signal) s WHERE contains(text, s.signal)""")
def related_signals(spark, sf_dir):
    chunks = corpus.chunk_documents(fx.raw_documents(spark, sf_dir), known_signals=_VOCABULARY)
    return chunks.select("chunk_id", F.explode("related_signal_names").alias("signal"))


@register("is_stale", f"""
SELECT document_id, coalesce({dv.TODAY} - valid_from > 365, false) AS stale FROM v_meta""")
def is_stale(spark, sf_dir):
    return corpus.document_meta(_parsed(spark, sf_dir)).select(
        "document_id", tx.is_stale(F.col("valid_from"), TODAY, RetrievalWeights().stale_after_days).alias("stale"))


@register("access_up_to", """
SELECT document_id, access_level = 'public' AS public_reader, access_level <> 'restricted' AS internal_reader, true AS restricted_reader FROM v_meta""")
def access_up_to(spark, sf_dir):
    meta = corpus.document_meta(_parsed(spark, sf_dir))
    return meta.select("document_id", *[
        F.col("access_level").isin(*tx.access_up_to(a)).alias(f"{a}_reader") for a in v.ACCESS_LEVELS])


@register("citation", "SELECT chunk_id, document_title || ' > ' || heading || ' (' || chunk_id || ')' AS citation FROM v_chunks")
def citation(spark, sf_dir):
    return fx.chunks(spark, sf_dir).select(
        "chunk_id", tx.citation(F.col("document_title"), F.col("heading"), F.col("chunk_id")).alias("citation"))


@register("injection_scan", r"""
SELECT chunk_id, pattern, count(*) AS hits FROM (
  SELECT chunk_id, 'ignore_instructions' AS pattern, unnest(regexp_extract_all(text, '(?i)ignore (all |any |the )?(previous|prior|above) instructions')) AS hit FROM v_chunks
  UNION ALL SELECT chunk_id, 'role_override', unnest(regexp_extract_all(text, '(?i)\byou are (now|no longer)\b')) FROM v_chunks
  UNION ALL SELECT chunk_id, 'system_prompt', unnest(regexp_extract_all(text, '(?i)\bsystem prompt\b')) FROM v_chunks
  UNION ALL SELECT chunk_id, 'exfiltration', unnest(regexp_extract_all(text, '(?i)\b(api[_ ]?key|password|secret)s?\b.*\b(print|reveal|output|send)\b|\b(print|reveal|output|send)\b.*\b(api[_ ]?key|password|secret)s?\b')) FROM v_chunks
  UNION ALL SELECT chunk_id, 'tool_call', unnest(regexp_extract_all(text, '(?i)\b(call|invoke|execute) (the )?(tool|function|command)\b')) FROM v_chunks
  UNION ALL SELECT chunk_id, 'hidden_directive', unnest(regexp_extract_all(text, '(?i)\[\[.*?\]\]|<\s*/?\s*(system|assistant|instruction)\s*>')) FROM v_chunks) x
GROUP BY chunk_id, pattern""")
def injection_scan(spark, sf_dir):
    return corpus.injection_scan(fx.chunks(spark, sf_dir)).groupBy("chunk_id", "pattern").agg(
        F.count(F.lit(1)).alias("hits"))


@register("injection_excerpts", """
SELECT chunk_id, pattern, CASE WHEN pattern = 'ignore_instructions' THEN
    replace(substr(text, greatest(i - 40, 1), least(i - 1, 40) + 28 + 1 + 40 + 2), chr(10), ' ')
  ELSE replace(substr(text, greatest(e - 40, 1), least(e - 1, 40) + 18 + 40), chr(10), ' ') END AS excerpt
FROM (SELECT chunk_id, text, instr(text, 'Ignore previous instructions') AS i, instr(text, 'reveal the api key') AS e,
        unnest(['ignore_instructions', 'exfiltration']) AS pattern FROM v_chunks WHERE instr(text, 'Ignore previous instructions') > 0) x""")
def injection_excerpts(spark, sf_dir):
    return corpus.injection_scan(fx.chunks(spark, sf_dir))


@register("corpus_summary", """
SELECT facet, value, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(documents) AS BIGINT) AS documents FROM (
  SELECT 'source' AS facet, source_type AS value, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM v_chunks GROUP BY 2
  UNION ALL SELECT 'access', access_level, count(*), count(DISTINCT document_id) FROM v_chunks GROUP BY 2
  UNION ALL SELECT 'all', 'all', count(*), count(DISTINCT document_id) FROM v_chunks) x GROUP BY 1, 2""")
def corpus_summary(spark, sf_dir):
    return corpus.corpus_summary(fx.chunks(spark, sf_dir))


@register("chunk_lookup_guarded", """
SELECT w.chunk_id, CASE WHEN c.chunk_id IS NULL THEN 404 WHEN c.access_level = 'restricted' THEN 403 ELSE 200 END AS status,
  CASE WHEN c.access_level <> 'restricted' THEN c.heading END AS heading, CASE WHEN c.access_level <> 'restricted' THEN c.source_type END AS source_type,
  CASE WHEN c.access_level <> 'restricted' THEN c.text END AS text
FROM (SELECT chunk_id FROM v_chunks UNION ALL
      SELECT 'chunk_' || lpad(CAST(p_partkey AS VARCHAR(12)), 12, '0') FROM part) w LEFT JOIN v_chunks c ON w.chunk_id = c.chunk_id""")
def chunk_lookup_guarded(spark, sf_dir):
    chunks = fx.index(spark, sf_dir)[0]
    parts = fx.table(spark, sf_dir, "part").selectExpr(
        "concat('chunk_', lpad(cast(p_partkey as string), 12, '0')) as chunk_id")
    wanted = chunks.select("chunk_id").unionByName(parts)
    return listings.chunk_lookup(chunks, wanted, "internal").select("chunk_id", "status", "heading", "source_type", "text")


# --- index -----------------------------------------------------------------------------------


@register("hashed_embedding", """
SELECT c.chunk_id, string_agg(CAST(coalesce(e.w, 0) AS VARCHAR), ',' ORDER BY b.bucket) AS vector, round(max(n.norm), 6) AS norm
FROM v_chunks c JOIN v_cnorm n ON c.chunk_id = n.chunk_id CROSS JOIN (SELECT unnest(range(32)) AS bucket) b
LEFT JOIN v_cvec e ON e.chunk_id = c.chunk_id AND e.bucket = b.bucket GROUP BY c.chunk_id
UNION ALL SELECT chunk_id, NULL, NULL FROM v_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM v_cnorm)""")
def hashed_embedding(spark, sf_dir):
    vectors = retrieval.hashed_embedding(fx.chunks(spark, sf_dir), "chunk_id", "text")
    return vectors.select(
        "chunk_id", F.array_join(F.col("vector").cast("array<string>"), ",").alias("vector"), r6("norm").alias("norm"))


@register("l2_normalise", """
SELECT vec_id, dim, round(x / CASE WHEN norm = 0 THEN 1e0 ELSE norm END, 6) AS x FROM (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim,
    sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS norm FROM embeddings) e""")
def l2_normalise(spark, sf_dir):
    unit = retrieval.l2_normalise(fx.table(spark, sf_dir, "embeddings"), "embedding")
    return rounded(unit.select("vec_id", F.posexplode("embedding").alias("dim", "x")), "x")


@register("cosine_score", """
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda y: y::DOUBLE) AS e,
    sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS norm FROM embeddings),
c AS (SELECT label, list(m ORDER BY dim) AS m FROM (
  SELECT label, dim, sum(x) AS m FROM (SELECT label, unnest(e) / norm AS x, generate_subscripts(e, 1) AS dim FROM u) y GROUP BY 1, 2) z GROUP BY 1),
cn AS (SELECT label, m, sqrt(list_sum(list_transform(m, lambda y: y * y))) AS norm FROM c)
SELECT u.vec_id, u.label, round(list_dot_product(u.e, cn.m) / (u.norm * cn.norm), 6) AS cosine FROM u JOIN cn ON u.label = cn.label""")
def cosine_score(spark, sf_dir):
    """Every vector against the centroid of its label."""
    unit = retrieval.l2_normalise(fx.table(spark, sf_dir, "embeddings"), "embedding")
    sums = unit.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(
        F.sum("x").alias("m"))
    centroid = sums.groupBy("label").agg(F.expr(
        "transform(array_sort(collect_list(struct(dim, m))), s -> s.m) AS centroid"))
    pairs = unit.join(retrieval.l2_normalise(centroid, "centroid"), "label")
    return pairs.select("vec_id", "label", r6(F.expr(
        retrieval.cosine_score("embedding", "centroid"))).alias("cosine"))


@register("bm25_term_df", "SELECT term, df FROM v_df")
def bm25_term_df(spark, sf_dir):
    return retrieval.term_df(fx.index(spark, sf_dir)[1])


@register("bm25_stats", "SELECT n_chunks, round(avg_len, 6) AS avg_len FROM v_corpus")
def bm25_stats(spark, sf_dir):
    return rounded(retrieval.corpus_stats(fx.index(spark, sf_dir)[0]), "avg_len")


@register("postings_join", """
SELECT q.query_id, p.chunk_id, count(*) AS shared_terms, CAST(sum(tf) AS BIGINT) AS hits FROM v_qterms q JOIN v_post p ON q.term = p.term GROUP BY 1, 2""")
def postings_join(spark, sf_dir):
    return retrieval.shared_terms(fx.retrieval_queries(spark, sf_dir), *fx.index(spark, sf_dir))


@register("bm25_score", "SELECT query_id, chunk_id, round(score, 6) AS score FROM v_bm25")
def bm25_score(spark, sf_dir):
    indexed, posting_table = fx.index(spark, sf_dir)
    return rounded(retrieval.bm25_score(fx.retrieval_queries(spark, sf_dir), indexed, posting_table), "score")


@register("bm25_topk", """
SELECT query_id, rank, chunk_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM v_bm25) x WHERE rank <= 10""")
def bm25_topk(spark, sf_dir):
    return rounded(retrieval.bm25_topk(fx.retrieval_queries(spark, sf_dir), fx.impacts(spark, sf_dir)), "score")


@register("access_wall", """
SELECT access_level, count(*) AS chunks FROM v_chunks WHERE access_level IN ('public', 'internal') GROUP BY 1""")
def access_wall(spark, sf_dir):
    allowed = retrieval.access_wall(fx.index(spark, sf_dir)[0], READER.allowed_access)
    return allowed.groupBy("access_level").agg(F.count(F.lit(1)).alias("chunks"))


@register("metadata_filter", """
SELECT chunk_id FROM v_chunks WHERE feature = 'AEB' AND source_type IN ('requirement', 'test_spec')""")
def metadata_filter(spark, sf_dir):
    wanted = RetrievalFilters(feature="AEB", source_types=("requirement", "test_spec"))
    return retrieval.metadata_filter(fx.index(spark, sf_dir)[0], wanted).select("chunk_id")


@register("retrieval_candidates", """
SELECT (SELECT count(*) FROM v_cand) AS candidates_considered, (SELECT count(*) FROM v_chunks WHERE access_level = 'restricted') AS excluded_by_access""")
def retrieval_candidates(spark, sf_dir):
    return retrieval.candidate_counts(fx.index(spark, sf_dir)[0], READER)


@register("minmax_per_query", """
SELECT query_id, chunk_id, round(CASE WHEN hi - lo < 1e-12 THEN CASE WHEN hi <= 0 THEN 0e0 ELSE 1e0 END ELSE (score - lo) / (hi - lo) END, 6) AS scaled
FROM (SELECT query_id, c.chunk_id, b.score, min(coalesce(b.score, 0e0)) OVER (PARTITION BY query_id) AS lo, max(coalesce(b.score, 0e0)) OVER (PARTITION BY query_id) AS hi
  FROM v_queries q CROSS JOIN v_cand c LEFT JOIN v_bm25 b USING (query_id, chunk_id)) x WHERE score IS NOT NULL""")
def minmax_per_query(spark, sf_dir):
    indexed, posting_table = fx.index(spark, sf_dir)
    candidates = retrieval.metadata_filter(retrieval.access_wall(indexed, READER.allowed_access), READER)
    scores = retrieval.bm25_score(fx.retrieval_queries(spark, sf_dir), indexed, posting_table, candidates)
    return rounded(retrieval.minmax_per_query(scores, "score", "scaled", candidates, listed=True).select("query_id", "chunk_id", "scaled"), "scaled")


def _retrieved(spark, sf_dir):
    indexed, posting_table = fx.index(spark, sf_dir)
    return retrieval.hybrid_retrieve(
        indexed, posting_table, fx.retrieval_queries(spark, sf_dir), today=TODAY, filters=READER)


@register("hybrid_score", "SELECT query_id, round(score, 6) AS score, round(vec, 6) AS vector_score, round(kw, 6) AS keyword_score FROM v_ranked")
def hybrid_score(spark, sf_dir):
    names = ("score", "vector_score", "keyword_score")
    return rounded(_retrieved(spark, sf_dir).select("query_id", *names), *names)


@register("retrieval_topk", "SELECT query_id, rank, chunk_id FROM v_ranked")
def retrieval_topk(spark, sf_dir):
    return _retrieved(spark, sf_dir).select("query_id", "rank", "chunk_id")


@register("hybrid_retrieve", """
SELECT r.query_id, r.rank, r.chunk_id, c.heading, c.source_type, r.stale, round(r.score, 6) AS score,
  (SELECT count(*) FROM v_cand) AS candidates_considered, (SELECT count(*) FROM v_chunks WHERE access_level = 'restricted') AS excluded_by_access
FROM v_ranked r JOIN v_chunks c ON r.chunk_id = c.chunk_id""")
def hybrid_retrieve(spark, sf_dir):
    indexed = fx.index(spark, sf_dir)[0]
    top = _retrieved(spark, sf_dir).join(
        indexed.select("chunk_id", "heading", "source_type", "valid_from"), "chunk_id")
    counts = retrieval.candidate_counts(indexed, READER)
    return rounded(top.join(F.broadcast(counts)).select(  # one row
        "query_id", "rank", "chunk_id", "heading", "source_type",
        tx.is_stale(F.col("valid_from"), TODAY, 365).alias("stale"), "score",
        "candidates_considered", "excluded_by_access"), "score")


@register("retrieval_query_text", f"""
SELECT file_id, concat_ws(' ', '{v.BASE_QUERY}', string_agg(name, ' ' ORDER BY metric_index) FILTER (WHERE passed = false),
  '{v.LOGGING_QUERY} ' || string_agg(name, ' ' ORDER BY metric_index) FILTER (WHERE value IS NULL AND value_bool IS NULL)) AS query
FROM v_metrics GROUP BY file_id""")
def retrieval_query_text(spark, sf_dir):
    return retrieval.retrieval_query_text(_analysis(spark, sf_dir).metrics)


@register("vector_search", """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda y: y::DOUBLE) AS e,
    sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS norm FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (q.norm * v.norm) AS cosine FROM u q, u v WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, round(cosine, 6) AS cosine
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM p) x WHERE rank <= 10""")
def vector_search(spark, sf_dir):
    """Every hundredth vector asks; all vectors lie in stored cells."""
    path = f"{shared_folder(spark)}/fleetgauge-cells-{uuid.uuid4().hex}"
    vectors = fx.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    cells.write_cells(*cells.build_cells(vectors, "vec_id"), path)
    asked = vectors.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "vector")
    return rounded(cells.nearest(asked, *cells.read_cells(spark, path), "query_id", "vec_id"), "cosine")
