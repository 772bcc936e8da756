"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) AS dim
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.dim = c.dim AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

LINE_DEDUP = r"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM split
), worded AS (
  SELECT DISTINCT doc_id, line_no,
    list_sort(list_distinct(list_filter(regexp_split_to_array(
      lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS words
  FROM lines
), named AS (
  SELECT doc_id, line_no, words, len(words) AS n FROM worded WHERE len(words) > 0
), sets AS (
  SELECT words, n, min(struct_pack(d := doc_id, l := line_no)) AS first, row_number() OVER () AS sid FROM named GROUP BY words, n
), tokens AS (
  SELECT sid, n, first, unnest(words) AS w FROM sets
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY w) AS df FROM tokens
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY df, w) AS pos FROM counted
), prefixed AS (
  SELECT * FROM placed WHERE pos <= n - (80 * n + 99) // 100 + 1
), candidates AS (
  SELECT DISTINCT a.sid AS x, b.sid AS y
  FROM prefixed a JOIN prefixed b ON a.w = b.w AND b.first < a.first
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), near AS (
  SELECT DISTINCT x FROM candidates JOIN sets p ON p.sid = x JOIN sets q ON q.sid = y
  WHERE 100 * len(list_intersect(p.words, q.words)) >= 80 * (p.n + q.n - len(list_intersect(p.words, q.words)))
)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(named.n AS INTEGER) AS n_words,
       struct_pack(d := doc_id, l := line_no) > sets.first AS same
FROM named JOIN sets USING (words) LEFT JOIN near ON near.x = sets.sid
WHERE struct_pack(d := doc_id, l := line_no) > sets.first OR near.x IS NOT NULL
"""


def _share(nodes: str, parent: str, child: str) -> str:
    """Children's parts of their parents' budgets; nodes has parent_budget, cap, weight."""
    over = f"PARTITION BY {parent}" if parent else ""
    order = f"ORDER BY CAST(cap AS DOUBLE) / nullif(w, 0) ASC NULLS FIRST, {child}"
    before = f"({over} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
  SELECT *, CASE WHEN is_full THEN cap ELSE rest * cum // everything - rest * (cum - open) // everything END AS given FROM (
    SELECT *, sum(open) OVER ({over} {order} ROWS UNBOUNDED PRECEDING) AS cum, greatest(sum(open) OVER ({over}), 1) AS everything FROM (
      SELECT *, CASE WHEN is_full THEN 0 ELSE w END AS open,
        total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({over}), 0) AS rest FROM (
        SELECT *, cap * later <= remaining * w OR w = 0 AS is_full FROM (
          SELECT *, least(parent_budget, sum(cap) OVER ({over})) AS total,
            least(parent_budget, sum(cap) OVER ({over})) - coalesce(sum(cap) OVER {before}, 0) AS remaining,
            sum(w) OVER ({over}) - coalesce(sum(w) OVER {before}, 0) AS later
          FROM (SELECT * REPLACE (CASE WHEN weight > 0 THEN cap ELSE 0 END AS cap), greatest(weight, 0) AS w FROM ({nodes}))))))"""


def mix_sources(domain: str, weights: dict[str, str]) -> str:
    levels = ("domain", "language", "source")
    steps, above = [], "SELECT CAST(sum(tokens) AS HUGEINT) * 3 // 5 AS given FROM leaves"
    for k, level in enumerate(levels):
        path, parent = ", ".join(levels[: k + 1]), ", ".join(levels[:k])
        nodes = f"SELECT {path}, sum(tokens * 2) AS cap, max({weights[level]}) AS weight FROM leaves GROUP BY {path}"
        joined = f"SELECT n.*, p.given AS parent_budget FROM ({nodes}) n JOIN ({above}) p " + (f"USING ({parent})" if parent else "ON true")
        steps.append(f"b{k} AS (SELECT {path}, given FROM ({_share(joined, parent, level)}))")
        above = f"SELECT * FROM b{k}"
    return rf"""
WITH slim AS (
  SELECT *, {domain} AS domain FROM (
    SELECT doc_id, coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS source, coalesce(CAST(doc_id AS VARCHAR), md5(text)) AS name,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents) WHERE n_tokens > 0
), leaves AS (
  SELECT domain, language, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM slim GROUP BY ALL
), {", ".join(steps)},
plan AS (
  SELECT domain, language, source, given // tokens AS whole, given % tokens AS rest FROM leaves JOIN b2 USING (domain, language, source)
), placed AS (
  SELECT *, md5(concat_ws(':', '17', CAST(whole + 1 AS VARCHAR), name)) AS k
  FROM slim JOIN plan USING (domain, language, source)
), started AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY k, doc_id, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM placed
), taken AS (
  SELECT *, greatest(0, least(n_tokens, rest - begins)) AS prefix_tokens FROM started
)
SELECT doc_id, domain, language, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(whole AS BIGINT) AS whole, CAST(prefix_tokens AS BIGINT) AS prefix_tokens
FROM taken WHERE whole > 0 OR prefix_tokens > 0
"""


SOURCE_DIVERGENCE = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), counted AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs FROM (SELECT d, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL
), vocabulary AS MATERIALIZED (
  SELECT lang, term, sum(n) AS total FROM counted GROUP BY ALL HAVING sum(docs) >= 10
), groups AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(sum(n) FILTER (v.term IS NOT NULL), 0) AS size
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counted c USING (lang, source) LEFT JOIN vocabulary v ON v.lang = c.lang AND v.term = c.term GROUP BY ALL
), sizes AS (
  SELECT lang, count(*) AS kept, sum(total) AS lang_size FROM vocabulary GROUP BY lang
), shares AS MATERIALIZED (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (g.size + 2 * kept) AS HUGEINT) AS p,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (v.total + 2) // (lang_size + 2 * kept) AS HUGEINT) AS q
  FROM groups g JOIN sizes USING (lang) JOIN vocabulary v USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def centroid_clusters(k: int = 8, dim: int = 64, scale: int = 1024, rounds: int = 10, seed: int = 3) -> str:
    """Each round is two common tables: nearest centroids, then the floored means."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), m0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS INTEGER) AS c, v AS m
  FROM kept QUALIFY c < {k}
)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT r, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, m{i}) GROUP BY r
)""")
        if i < rounds:
            steps.append(f"""m{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(n.m, m{i}.m) AS m FROM m{i} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM (
      SELECT c, j, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(range({dim})) AS j, unnest(v) AS x FROM kept JOIN a{i} USING (r)) GROUP BY c, j) GROUP BY c) n USING (c)
)""")
    return ", ".join(steps) + f"""
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN m{rounds} ON c = best.c
"""
