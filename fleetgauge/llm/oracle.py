"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from fleetgauge.llm import centroids as k
from fleetgauge.llm import mixing as m
from fleetgauge.llm import quality_rules as q
from fleetgauge.llm import spelling as w


def quality_rules() -> str:
    tests = ", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(q.CUTOFFS))
    rules = " UNION ALL ".join(
        f"SELECT stratum, '{name}' AS rule, {sql.replace('try_divide(', '(').replace(', ', ' / nullif(').replace(')', ', 0))')} AS ratio FROM held"
        for name, sql in q.RULES.items())
    cuts = ", ".join(f"max(cut) FILTER (rule = '{name}') AS cut_{name}" for name in q.RULES)
    rejected = " OR ".join(
        f"coalesce({sql.replace('try_divide(', '').replace(', ', ' / nullif(').replace(')', ', 0)')} > cut_{name}, false)"
        for name, sql in q.RULES.items())
    gap, odd = r"[\x20\x09-\x0D]", q.SYMBOLS
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{gap}+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS g
    FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
base AS (SELECT doc_id, coalesce('=' || lang, 'null') AS stratum, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '{gap}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{odd}', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
    FROM w LEFT JOIN covered USING (rid)),
judged AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
held AS (SELECT * FROM judged WHERE NOT base_failed
    AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
ratios AS ({rules}),
tests AS (SELECT stratum, rule, i, c, count(*) AS n, count(*) FILTER (ratio > c) AS k
    FROM ratios, (VALUES {tests}) AS t(i, c) GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k >= n * {q.ALPHA} THEN 1 ELSE (
    SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({q.ALPHA}) + (n - j) * ln(1 - {q.ALPHA})))
    FROM (SELECT unnest(range(0, k + 1)) AS j)) END AS p FROM tests),
passed AS (SELECT *, p <= {q.DELTA} / ({len(q.RULES)} * (SELECT count(DISTINCT stratum) FROM held)) AS ok FROM tails),
runs AS (SELECT stratum, rule, c, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY i) AS held FROM passed),
tight AS (SELECT stratum, rule, min(c) FILTER (held) AS cut FROM runs GROUP BY ALL),
cuts AS (SELECT stratum, {cuts} FROM tight GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT ({rejected}) AS kept
FROM judged LEFT JOIN cuts USING (stratum)"""


def mixing() -> str:
    b, f = m.BLOCK, m.FRAME
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, 'null') AS s,
    row_number() OVER (PARTITION BY source ORDER BY coalesce(md5(doc_id::VARCHAR), ''), doc_id) - 1 AS r FROM documents),
n AS (SELECT s, count(*) AS n FROM d GROUP BY s),
q AS (SELECT s, n, greatest(1, round({f} * sqrt(n) / sum(sqrt(n)) OVER ()))::BIGINT AS quota FROM n),
c AS (SELECT s, quota, (n // {b}) // quota AS frames, (n + {b} - 1) // {b} - quota * ((n // {b}) // quota) AS rest FROM q),
ends AS (SELECT frames AS phase, coalesce(lag(frames) OVER (ORDER BY frames), 0) AS first_frame
    FROM (SELECT DISTINCT frames FROM c WHERE frames > 0)),
part AS (SELECT phase, first_frame, s, quota FROM ends JOIN c ON frames >= phase
    UNION ALL SELECT -1, NULL, s, rest FROM c WHERE rest > 0),
size AS (SELECT phase, any_value(first_frame) AS first_frame, list(s ORDER BY s) AS src, list(quota ORDER BY s) AS qs, sum(quota)::BIGINT AS slots,
    CASE WHEN phase > 0 THEN (SELECT sum(quota * least(frames, any_value(first_frame))) FROM c)
         ELSE (SELECT sum(quota * frames) FROM c) END::BIGINT AS base FROM part GROUP BY phase),
edf AS (SELECT phase, 0::BIGINT AS t, list_transform(qs, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM size
    UNION ALL
    SELECT phase, t + 1, list_transform(range(1, len(done) + 1), lambda i: done[i] + (i = p)::BIGINT), p
    FROM (SELECT e.phase, e.t, e.done, list_reduce(list_filter(range(1, len(e.done) + 1), lambda i:
            e.done[i] < z.qs[i] AND e.done[i] * z.slots <= e.t * z.qs[i]),
            lambda x, y: CASE WHEN ((e.done[y] + 1) * z.slots + z.qs[y] - 1) // z.qs[y] < ((e.done[x] + 1) * z.slots + z.qs[x] - 1) // z.qs[x] THEN y ELSE x END) AS p
        FROM edf e JOIN size z USING (phase) WHERE e.t < z.slots)),
placed AS (SELECT phase, first_frame, base, slots, src[pick] AS s, qs[pick] AS quota, t - 1 AS slot, done[pick] - 1 AS j
    FROM edf JOIN size USING (phase) WHERE t > 0),
blocks AS (SELECT doc_id, d.s, r // {b} AS block, r % {b} AS place, (r // {b}) // quota AS frame,
    CASE WHEN (r // {b}) // quota < frames THEN (SELECT min(phase) FROM ends WHERE phase > (r // {b}) // c.quota) ELSE -1 END AS phase,
    CASE WHEN (r // {b}) // quota < frames THEN (r // {b}) % quota ELSE r // {b} - quota * frames END AS j
    FROM d JOIN c ON d.s = c.s)
SELECT doc_id, block, place, base + coalesce(frame - first_frame, 0) * slots + slot AS slot,
    base + coalesce(frame - first_frame, 0) * slots + (j * slots) // quota AS release,
    base + coalesce(frame - first_frame, 0) * slots + ((j + 1) * slots + quota - 1) // quota AS deadline
FROM blocks JOIN placed USING (s, phase, j)"""


def clusters() -> str:
    """One block of CTEs a round: distances by a join over the components, then floored means."""
    rounds = []
    for i in range(k.ROUNDS + 1):
        rounds.append(f"""
d{i} AS MATERIALIZED (SELECT rid, c, sum((v.x - z.x) * (v.x - z.x))::BIGINT AS distance FROM v JOIN c{i} z USING (i) GROUP BY rid, c),
a{i} AS MATERIALIZED (SELECT rid, arg_min(c, struct_pack(distance := distance, c := c)) AS c, min(distance) AS distance FROM d{i} GROUP BY rid)""")
        if i < k.ROUNDS:
            rounds.append(f"""
m{i} AS (SELECT c, i, (s - ((s % n) + n) % n) // n AS x
    FROM (SELECT a.c, v.i, sum(v.x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{i} a JOIN v USING (rid) GROUP BY a.c, v.i)),
c{i + 1} AS MATERIALIZED (SELECT z.c, z.i, coalesce(m.x, z.x) AS x FROM c{i} z LEFT JOIN m{i} m USING (c, i))""")
    last = k.ROUNDS
    return rf"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: greatest(least(floor(greatest(least({k.SCALE} * x::DOUBLE, 1e15), -1e15))::BIGINT, {k.LIMIT}), -{k.LIMIT})) AS v
    FROM embeddings WHERE len(embedding) = {k.DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {k.DIM}),
v AS MATERIALIZED (SELECT rid, i, v[i] AS x FROM (SELECT rid, v, unnest(range(1, {k.DIM} + 1)) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT c, i, v[i] AS x FROM (SELECT v, c, unnest(range(1, {k.DIM} + 1)) AS i FROM (
    SELECT v, row_number() OVER (ORDER BY sha256('{k.SEED}:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS c FROM kept) WHERE c < {k.K})),
{",".join(rounds)},
digest AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT vec_id, c::INT AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
    sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{last} JOIN kept USING (rid) JOIN digest USING (c)"""


def spelling() -> str:
    """Words that become equal without one letter at the same place differ by a replacement, if of one length; else by an insertion."""
    return rf"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]),
    lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS tab),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(x), 2),
        lambda i: ('0x' || substr(x, i, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h FROM per, bits),
words AS MATERIALIZED (SELECT CASE WHEN h % {w.EVERY} = 0
        THEN left(run, (h % length(run)::UBIGINT)::BIGINT) || substr(run, (h % length(run)::UBIGINT)::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= {w.LEAST_LETTERS} AND sum(n) >= {w.LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest, length(word) AS l
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS near FROM cut a JOIN cut b USING (i, rest, l) WHERE a.word <> b.word
    UNION SELECT c.word, c.rest FROM cut c WHERE c.rest IN (SELECT word FROM words)
    UNION SELECT c.rest, c.word FROM cut c WHERE c.rest IN (SELECT word FROM words)),
found AS MATERIALIZED (SELECT a.word, any_value(a.n) AS n, count(b.word) AS n_near, max(b.n) AS top,
    min(b.word) FILTER (b.n = m) AS form
    FROM (SELECT w.word, w.n, r.near, max(x.n) OVER (PARTITION BY w.word) AS m FROM words w LEFT JOIN near r ON r.word = w.word
        LEFT JOIN words x ON x.word = r.near) a LEFT JOIN words b ON b.word = a.near GROUP BY a.word),
forms AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN top >= {w.RATIO} * n THEN form END AS form,
    CASE WHEN top >= {w.RATIO} * n THEN top END AS form_n FROM found),
chain AS (SELECT word, word AS last, 0 AS step FROM forms
    UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n
FROM forms JOIN (SELECT word, arg_max(last, step) AS root FROM chain GROUP BY word) USING (word)"""
