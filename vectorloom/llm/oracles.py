"""DuckDB SQL for the operators that SQL can express: brute force over whole tables."""

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"

EMBEDDINGS = f"""
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, embedding, sqrt({_DOT.format(a='embedding', b='embedding')}) AS norm FROM v),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.embedding) = len(b.embedding)
  WHERE {_DOT.format(a='a.embedding', b='b.embedding')} / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
least AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
counted AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, TRUE) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.u LEFT JOIN counted ON vec_id = counted.u
"""

SIMHASH = r"""
WITH RECURSIVE texts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
words AS (SELECT id, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS w FROM texts),
shingles AS (
  SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.id AS u, b.id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT u, v FROM common JOIN sizes x ON x.id = u JOIN sizes y ON y.id = v WHERE c >= 0.8::DOUBLE * (x.n + y.n - c)),
links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach AS (SELECT id AS u, id AS w FROM texts UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.w = l.u),
least AS (SELECT u, min(w) AS class_id FROM reach GROUP BY u)
SELECT doc_id, class_id, coalesce(doc_id = class_id, TRUE) AS kept
FROM documents LEFT JOIN texts ON coalesce(documents.text, '') = texts.text AND doc_id IS NOT NULL LEFT JOIN least ON texts.id = least.u
"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS pos, h FROM d WHERE length(h) >= 100),
keyed AS (SELECT doc_id, pos, hash(substr(h, 2 * pos + 1, 100)) AS a, md5_number(substr(h, 2 * pos + 1, 100)) AS b FROM strings),
first AS (SELECT a, b, min(doc_id) AS doc FROM keyed GROUP BY 1, 2),
marked AS (SELECT k.doc_id, k.pos FROM keyed k JOIN first f ON k.a = f.a AND k.b = f.b AND f.doc < k.doc_id),
fresh AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS begins FROM marked),
runs AS (SELECT doc_id, pos, sum(begins) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM fresh),
spans AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h
  FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
