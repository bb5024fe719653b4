"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from quillon.llm.secrets import RULES

SQL: dict[str, str] = {}

SQL["op4_decontaminate"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), runs AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS run
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)
), windows AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS run
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM runs) WHERE len(words) >= n)
), hits AS (
  SELECT doc_id, i, n, item_id FROM windows JOIN runs USING (n, run)
), covered AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

SQL["op2_chat_prefix_targets"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, row_number() OVER w AS i, role = 'assistant' AS reply,
    33 + length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?SYS>|/?INST\])', '\1\2\\\3', 'g'))
       + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?SYS>|/?INST\])', '\1\2\\\3', 'g')) AS n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto,
    max(CASE WHEN reply THEN i ELSE 0 END) OVER (PARTITION BY conv_id) AS last_reply FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE reply), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE reply), '')) AS loss_sha256,
  CAST(sum(CASE WHEN reply THEN upto WHEN i > last_reply THEN n ELSE 0 END) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""


def _secret_scan() -> str:
    """SQL of the secret scan, a part for each rule: matches and the gaps before them, then running sums."""
    parts, good = [], []
    for number, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {number} AS rule, '{rule.kind}' AS kind, generate_subscripts(m, 1) AS i, unnest(m) AS hit, unnest(g[1:len(m)]) AS gap FROM"
            f" (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM d)"
        )
        good.append(f"WHEN {number} THEN length(regexp_extract(hit, '{pattern}', {rule.group})) >= {rule.least}")
    base = ", ".join(str(i) for i, r in enumerate(RULES) if r.base)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    shown = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rule ORDER BY i) AS BIGINT) AS stop FROM hits),
spans AS (SELECT doc_id, rule, kind, stop - length(hit) AS start, stop FROM placed WHERE CASE rule {" ".join(good)} END),
found AS (SELECT doc_id, {counts}, {shown} FILTER (WHERE rule IN ({base})) AS base, {shown} AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (doc_id)
"""


SQL["op3_secret_scan"] = _secret_scan()

SQL["op11_embedding_dedup"] = r"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS MATERIALIZED (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS v, vec_id AS c FROM v UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.v
)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM (SELECT v AS vec_id, min(c) AS c FROM reach GROUP BY v) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""

SQL["op12_lexical_search"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
sizes AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
p AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, sizes GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN p USING (term) JOIN w USING (term), sizes GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


def _clustering(k: int = 16, rounds: int = 3) -> str:
    """SQL of the clustering: a table of centroids and one of distances for each round."""
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS j, CAST(floor(64 * unnest(e)) AS BIGINT) AS x FROM v),
chosen AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM v QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, j, x AS y FROM x JOIN chosen USING (vec_id))"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, best.c AS c, best.d AS d
  FROM (SELECT vec_id, min({{'d': d, 'c': c}}) AS best FROM (SELECT vec_id, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN c{r} USING (j) GROUP BY vec_id, c) GROUP BY vec_id)
)""")
        if r < rounds:
            parts.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c, j, CAST(coalesce(floor(s / n), y) AS BIGINT) AS y FROM c{r} LEFT JOIN (SELECT c, j, sum(x) AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY c, j) USING (c, j)
)""")
    last = f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)"""
    return ",".join(parts) + last


SQL["op13_centroid_clustering"] = _clustering()
