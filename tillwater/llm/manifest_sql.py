"""Check SQL of the manifest and the prefix trie."""

#: CRC-32 (reflected polynomial 0xEDB88320) of the decimal digits in {s}, bit by bit.
_CRC32 = """xor(list_reduce(
  list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({s}) + 1), lambda i: CAST(ascii({s}[i]) AS BIGINT))),
  lambda c, b: list_reduce(
    list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
    lambda x, y: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT))"""


def crc32(digits: str) -> str:
    return _CRC32.format(s=f"({digits})")


def _leaf(text: str) -> str:
    columns = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns) + ")"


MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source AS src, {_leaf('text')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0
              THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS now
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY src) AS n FROM d
), tree AS (
  SELECT src, 0 AS lvl, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT src, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM tree WHERE n > 1 GROUP BY src, lvl, pos // 3
), subs AS (
  SELECT src, h, row_number() OVER (ORDER BY src NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, pos, h, n FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM tops WHERE n > 1 GROUP BY lvl, pos // 3
), sibs AS (
  SELECT a.src, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM tree a JOIN tree b ON a.src IS NOT DISTINCT FROM b.src AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY a.src, a.lvl, a.pos
), top_sibs AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY a.lvl, a.pos
), fold AS (
  SELECT doc_id, leaf, src, 0 AS lvl, pos, now AS cur, '' AS proof FROM leaves
  UNION ALL
  SELECT f.doc_id, f.leaf, f.src, f.lvl + 1, f.pos // 3, sha256(s.l || f.cur || s.r), f.proof || s.l || s.r
  FROM fold f JOIN sibs s ON s.src IS NOT DISTINCT FROM f.src AND s.lvl = f.lvl AND s.pos = f.pos
), top_fold AS (
  SELECT f.doc_id, f.leaf, u.h AS subroot, 0 AS lvl, u.pos, f.cur, f.proof
  FROM fold f JOIN tree t ON t.src IS NOT DISTINCT FROM f.src AND t.lvl = f.lvl AND t.n = 1
  JOIN subs u ON u.src IS NOT DISTINCT FROM f.src
  UNION ALL
  SELECT f.doc_id, f.leaf, f.subroot, f.lvl + 1, f.pos // 3, sha256(s.l || f.cur || s.r), f.proof || s.l || s.r
  FROM top_fold f JOIN top_sibs s ON s.lvl = f.lvl AND s.pos = f.pos
)
SELECT f.doc_id, f.leaf, f.subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.cur AS folded_root, f.cur = t.h AS verified
FROM top_fold f JOIN tops t ON t.n = 1 AND f.lvl = t.lvl
"""

PREFIXES = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.p, t.r, t.x FROM c JOIN t ON t.conv_id = c.base WHERE t.p <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.p, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.p > c.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, md5(strlen(r) || ':' || r || x) AS k,
         strlen(x) AS b FROM rebuilt
), walked AS (
  SELECT conv_id, d, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS node, b FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b FROM walked GROUP BY node, d
), kids AS (
  SELECT left(node, -32) AS node, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1
), summed AS (
  SELECT w.node, sum((u.n - 1) * u.b) AS saved, count(*) FILTER (kids.k IS NULL) AS leaves
  FROM nodes u LEFT JOIN kids ON kids.node = u.node JOIN walked w ON w.conv_id = u.conv_id AND w.d <= u.d GROUP BY w.node
), ends AS (
  SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS e
  FROM (SELECT conv_id, max(d) AS d FROM walked GROUP BY conv_id) JOIN walked USING (conv_id, d) GROUP BY node
)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(kids.k, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nodes v LEFT JOIN kids ON kids.node = v.node JOIN summed ON summed.node = v.node LEFT JOIN ends ON ends.node = v.node
LEFT JOIN nodes p ON v.d > 0 AND p.node = left(v.node, -32)
"""
