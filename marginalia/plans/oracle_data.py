"""DuckDB statements of the general data-processing queries, over the driver's views."""

P6_FOUND = r"""
WITH folded AS (
  SELECT vault_key, nfc_normalize(lower(nfc_normalize(trim(file_path)))) AS path, added_at, deleted_at FROM vault_files
  UNION ALL
  SELECT v.vault_key, nfc_normalize(lower(nfc_normalize(trim(h.file_path)))), h.added_at, h.deleted_at FROM hub_files h CROSS JOIN (SELECT DISTINCT vault_key FROM vaults) v
), names AS (
  SELECT *, trim(regexp_extract(path, '[^/]*$')) AS name FROM folded
), keyed AS (
  SELECT vault_key, 'p|' || path AS key, added_at, deleted_at FROM names
  UNION ALL SELECT vault_key, 'n|' || name, added_at, deleted_at FROM names
  UNION ALL SELECT vault_key, 's|' || regexp_replace(name, '\.md$', ''), added_at, deleted_at FROM names WHERE name LIKE '%.md'
), asked AS (
  SELECT 'parsed_links' AS tbl, link_id AS ref_id, 0 AS pos, vault_key, seen_at AS at_time, target AS name, 't' AS kind FROM parsed_links
  UNION SELECT 'resolutions', resolution_id, i, vault_key, resolved_at, matches[i], 'p' FROM (SELECT *, unnest(generate_series(1, len(matches))) AS i FROM resolutions)
  UNION SELECT 'canvas_nodes', node_row_id, 0, vault_key, seen_at, label, 'p' FROM canvas_nodes WHERE node_type = 'file'
), refs AS (
  SELECT *, nfc_normalize(lower(nfc_normalize(trim(name)))) AS path FROM asked
  WHERE name IS NOT NULL AND trim(name) <> '' AND at_time IS NOT NULL AND NOT regexp_matches(lower(trim(name)), '^(https?:|mailto:)')
), looked AS (
  SELECT tbl, ref_id, pos, vault_key, at_time,
    CASE WHEN kind = 'p' THEN 'p|' || path
         WHEN regexp_matches(trim(regexp_extract(path, '[^/]*$')), '\.[^.]+$') THEN 'n|' || trim(regexp_extract(path, '[^/]*$'))
         ELSE 's|' || trim(regexp_extract(path, '[^/]*$')) END AS key
  FROM refs
), met AS (
  SELECT l.tbl, l.ref_id, l.pos, l.at_time,
    coalesce(bool_or(k.added_at <= l.at_time AND (k.deleted_at IS NULL OR k.deleted_at > l.at_time)), false) AS live,
    coalesce(bool_or(k.deleted_at <= l.at_time), false) AS gone,
    coalesce(bool_or(k.added_at > l.at_time), false) AS late
  FROM looked l LEFT JOIN keyed k ON k.vault_key = l.vault_key AND k.key = l.key
  GROUP BY ALL
)
SELECT tbl, CAST(ref_id AS BIGINT) AS ref_id, CAST(pos AS BIGINT) AS pos,
  CASE WHEN gone THEN 'deleted' WHEN late THEN 'late' ELSE 'missing' END AS state, strftime(at_time, '%Y-%m') AS ref_month
FROM met WHERE NOT live
"""
