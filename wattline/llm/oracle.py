"""DuckDB SQL for the registered queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op3_weighted_mix"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(cast(doc_id AS varchar), md5(coalesce(text, '')))) AS place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
a AS (SELECT source, source_size, 2 * source_size AS cap, weight, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget, count(*) OVER () AS n FROM s),
r AS (  -- share by weight, stop sources at twice their size, share the excess anew
  SELECT *, 0 AS i, false AS is_full, budget / (sum(weight) OVER ())::BIGINT AS level FROM a
  UNION ALL
  SELECT source, source_size, cap, weight, budget, n, i + 1, now_full,
         (budget - coalesce(sum(CASE WHEN now_full THEN cap END) OVER (), 0)::BIGINT) / (sum(CASE WHEN NOT now_full THEN weight END) OVER ())::BIGINT
  FROM (SELECT *, is_full OR cap <= level * weight AS now_full FROM r WHERE i <= n)),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE level * weight END AS target FROM r WHERE i = n + 1),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (least(size, greatest(0, floor(target)::BIGINT - first)) + least(size, greatest(0, floor(target)::BIGINT - first - source_size)))::BIGINT AS taken,
       CASE WHEN target > 0 THEN (first + size) / target END AS vft
FROM p
"""

ORACLE["op11_filter_audit"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS fails
  FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT part, filter_order, step,
       sum(CASE WHEN fails & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN fails & bit > 0 AND fails & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN fails & bit > 0 AND fails & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN fails & bit > 0 AND fails & before = 0 AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN fails & bit > 0 AND fails & before = 0 AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN fails & bit > 0 THEN n * (120 // bit_count(fails::BIGINT)) ELSE 0 END)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""
