"""SQL twins of queries whose text is put together from parts."""

from __future__ import annotations

import string

_MANIFEST = r"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, sha256(concat(
    {doc_id}, {source}, {lang}, {n_chars}, {text})) AS leaf,
    CASE WHEN text IS NOT NULL AND {crc} % 3 = 0 THEN sha256(concat({doc_id}, {source}, {lang}, {n_chars}, {lower})) END AS other
  FROM documents
), langs AS (
  SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)
), leaves AS (
  SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, doc_id, leaf,
    coalesce(other, leaf) AS other
  FROM hashed JOIN langs ON hashed.lang IS NOT DISTINCT FROM langs.lang
), nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT *, count(*) OVER (PARTITION BY tree) FROM (
    SELECT tree, level + 1 AS level, pos // 8 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node
    FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8)
), tops AS (
  SELECT tree, node AS subroot, level AS height FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, tree AS pos, subroot AS node, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT *, count(*) OVER () FROM (
    SELECT level + 1 AS level, pos // 8 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node
    FROM upper WHERE n > 1 GROUP BY level, pos // 8)
), runs AS (
  SELECT tree, level, pos // 8 AS run, list(node ORDER BY pos) AS run_nodes FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8
), upper_runs AS (
  SELECT level, pos // 8 AS run, list(node ORDER BY pos) AS run_nodes FROM upper WHERE n > 1 GROUP BY level, pos // 8
), climb AS (
  SELECT tree, pos AS leaf_pos, 0 AS level, pos, other AS node, '' AS siblings FROM leaves
  UNION ALL
  SELECT climb.tree, leaf_pos, climb.level + 1, run, sha256(concat({folded})), concat(siblings, {rest})
  FROM climb JOIN runs ON runs.tree = climb.tree AND runs.level = climb.level AND runs.run = climb.pos // 8
), above AS (
  SELECT climb.tree, leaf_pos, 0 AS level, climb.tree AS pos, node, siblings
  FROM climb JOIN tops ON tops.tree = climb.tree AND climb.level = height
  UNION ALL
  SELECT climb.tree, leaf_pos, climb.level + 1, run, sha256(concat({folded})), concat(siblings, {rest})
  FROM above AS climb JOIN upper_runs AS runs ON runs.level = climb.level AND runs.run = climb.pos // 8
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, above.node AS folded_root, above.node = root AS verified
FROM above JOIN (SELECT level, node AS root FROM upper WHERE n = 1) USING (level)
JOIN leaves ON leaves.tree = above.tree AND leaves.pos = leaf_pos JOIN tops ON tops.tree = above.tree
"""


def manifest() -> str:
    def field(value: str) -> str:
        text = f"CAST({value} AS VARCHAR)"
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(strlen({text}), ':', {text}) END"

    def joined(nodes: str) -> str:
        return f"array_to_string({nodes}, '')"

    lower = field(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    # CRC-32 bit by bit: each byte is followed by eight shifts, marked by -1.
    steps = f"flatten(list_transform({digits}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = (f"xor(list_reduce(list_concat([4294967295], {steps}), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) "
           "WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)")
    left, right = joined("run_nodes[:climb.pos % 8]"), joined("run_nodes[climb.pos % 8 + 2:]")
    fields = {c: field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    return _MANIFEST.format(**fields, lower=lower, crc=crc, folded=f"{left}, climb.node, {right}", rest=f"{left}, {right}")


def interactions() -> str:
    return r"""
WITH marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts) LEFT JOIN marks USING (doc_id)
), masks AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM judged GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
  JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), steps AS (
  SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders
), counted AS (
  SELECT part, filter_order, step, filter_order[step] AS f, n, good, bad, fails, contains(fails, filter_order[step]) AS own,
    length(translate(fails, filter_order[1:step - 1], '')) < length(fails) AS gone
  FROM masks CROSS JOIN steps
), measured AS (
  SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (own AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (own AND gone), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (own AND NOT gone), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(bad) FILTER (own AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM counted GROUP BY part, filter_order, step, f
)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM measured
"""
