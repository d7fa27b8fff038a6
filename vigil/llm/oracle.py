"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_CHANCE = lambda r, m: f"({r} + 3.0::DOUBLE * sqrt({r} / {m}) + 9.0::DOUBLE / {m})"


def _usual(q: str, m: str) -> str:
    """The highest quantile that is reached from the median by steps which chance explains; the steps after a jump don't count."""
    out = f"{q}[5]"
    for i in (4, 3, 2, 1):
        out = f"CASE WHEN {q}[{i + 1}] > {_CHANCE(f'{q}[{i}]', m)} THEN {q}[{i}] ELSE {out} END"
    return out


OP1 = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) >= 2
), cov AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, CAST(len(ln) AS BIGINT) AS n_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id
), r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols / greatest(n_words, 1)::DOUBLE AS a, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS b,
         n_repeat_words / greatest(n_words, 1)::DOUBLE AS c
  FROM s
), q AS (
  SELECT lang, source, GROUPING(lang, source) AS lvl, CAST(count(*) AS DOUBLE) AS n, quantile_disc(a, [0.5, 0.75, 0.9, 0.95, 0.99]) AS qa, quantile_disc(b, [0.5, 0.75, 0.9, 0.95, 0.99]) AS qb,
         quantile_disc(c, [0.5, 0.75, 0.9, 0.95, 0.99]) AS qc, list_transform(quantile_disc(n_words, [0.5, 0.95]), lambda x: greatest(x, 1)::DOUBLE) AS mw, list_transform(quantile_disc(n_lines, [0.5, 0.95]), lambda x: greatest(x, 1)::DOUBLE) AS ml
  FROM r WHERE NOT base_failed GROUP BY ROLLUP (lang, source)
), e AS (
  SELECT lang, source, lvl, n, {_usual('qa', 'mw[1]')} AS ua, {_usual('qb', 'ml[1]')} AS ub, {_usual('qc', 'ml[1]')} AS uc, mw[2] AS lw, ml[2] AS ll FROM q
), f AS (
  SELECT g.lang, g.source, {', '.join(f"(g.n * g.{x} + 100.0::DOUBLE * ((l.n * l.{x} + 100.0::DOUBLE * t.{x}) / (l.n + 100.0::DOUBLE))) / (g.n + 100.0::DOUBLE) AS {x}" for x in ('ua', 'ub', 'uc', 'lw', 'll'))}
  FROM (SELECT * FROM e WHERE lvl = 0) g JOIN (SELECT * FROM e WHERE lvl = 1) l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT * FROM e WHERE lvl = 3) t
), x AS (
  SELECT r.*, ua, ub, uc, least(greatest(n_words, 1)::DOUBLE, lw) AS ew, least(greatest(n_lines, 1)::DOUBLE, ll) AS el
  FROM r LEFT JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(a <= {_CHANCE('ua', 'ew')} AND b <= {_CHANCE('ub', 'el')} AND c <= {_CHANCE('uc', 'el')}, TRUE) AS kept
FROM x
"""

OP2 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), m AS (
  SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id
), places AS (
  SELECT doc_id, item, item_id, dw.i, bp.i AS j, n FROM dw JOIN (
    SELECT item, item_id, i, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k
    FROM (SELECT item, item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM (SELECT row_number() OVER () AS item, * FROM b) WHERE len(w) > 0)
  ) AS bp USING (n, k)
), runs AS (
  SELECT *, CASE WHEN n = 13 THEN i - row_number() OVER (PARTITION BY doc_id, item, n, i - j ORDER BY i) ELSE i END AS run FROM places
), longest AS (
  SELECT doc_id, item, item_id, min(i) - 1 AS doc_at, min(j) - 1 AS item_at, count(*) + any_value(n) - 1 AS words FROM runs GROUP BY doc_id, item, item_id, n, i - j, run
), mt AS (
  SELECT doc_id, count(*) AS n_matches, max(words) AS longest_match, string_agg(x, ',' ORDER BY x) AS matches
  FROM (SELECT *, coalesce(CAST(item_id AS VARCHAR), '') || ':' || doc_at || ':' || item_at || ':' || words AS x FROM longest) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_matches, 0) AS n_matches, CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match, sha256(coalesce(matches, '')) AS matches_sha256
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN mt USING (doc_id)
"""

OP3 = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS of FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest, CASE WHEN of IS NULL OR of = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN of <> page_id THEN of END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h AND n >= 1000
"""

OP4 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (SELECT a AS i, a AS j FROM e UNION SELECT r.i, e.b FROM r JOIN e ON r.j = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.j, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT i, min(j) AS j FROM r GROUP BY i) m ON m.i = d.doc_id
"""

OP6 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, 2 + length(role) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(role, '\|\\*>')) + 3 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 8 AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
), later AS (
  SELECT doc_id, i FROM win QUALIFY doc_id > min(doc_id) OVER (PARTITION BY k)
), gone AS (
  SELECT DISTINCT doc_id, i + o AS i FROM later, (SELECT unnest(generate_series(0, 49)) AS o)
), kept AS (
  SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.i) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d) x ANTI JOIN gone USING (doc_id, i) GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP11 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents
), w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM p
), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, s, array_to_string(w[i : i + s - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, s, unnest(generate_series(1, len(w) - s + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS s) WHERE len(w) >= s)
  GROUP BY lang, s, phrase HAVING count(*) >= 30
), c AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS v FROM g WHERE s >= 2
), alone AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS o WHERE o.lang = c.lang AND o.s > c.s AND 100::HUGEINT * o.a >= 80::HUGEINT * c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))
), cut AS (
  SELECT alone.lang, alone.phrase, alone.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * alone.a) // (l.f::HUGEINT + r.f) AS score
  FROM (SELECT *, unnest(generate_series(1, s - 1)) AS k FROM alone) AS alone
  JOIN g AS l ON l.lang = alone.lang AND l.phrase = array_to_string(v[1 : k], ' ') JOIN g AS r ON r.lang = alone.lang AND r.phrase = array_to_string(v[k + 1 : alone.s], ' ')
), low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def _op13(k: int = 8, rounds: int = 10) -> str:
    """Every round is two tables: the nearest centroid of each vector (ties: smaller number), then floors of the means."""
    near = "SELECT i, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': k}}) AS m FROM kept, c{n} GROUP BY i"
    mean = (
        "SELECT p.k, coalesce(q.c, p.c) AS c FROM c{n} AS p LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c "
        "FROM (SELECT m.k AS k, j, sum(v[j]) AS s, count(*) AS n FROM a{n}, (SELECT unnest(generate_series(1, 64)) AS j) GROUP BY m.k, j) GROUP BY k) AS q ON p.k = q.k"
    )
    steps = "".join(f"a{n} AS MATERIALIZED ({near.format(n=n)}), c{n + 1} AS MATERIALIZED ({mean.format(n=n)}),\n" for n in range(rounds))
    return rf"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS k, v AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY k < {k}),
{steps}last AS ({near.format(n=rounds)}), d AS (SELECT vec_id, CAST(m.k AS INT) AS cluster, CAST(m.d AS BIGINT) AS distance FROM last)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM d JOIN c{rounds} AS c ON c.k = d.cluster
"""


OP13 = _op13()

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1, "op2_decontamination": OP2, "op3_warc": OP3, "op4_ngram_jaccard": OP4, "op6_chat_formatting": OP6, "op8_substring_dedup": OP8, "op11_phrase_collocations": OP11, "op13_centroids": OP13}
