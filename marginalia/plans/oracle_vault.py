"""DuckDB statements of the vault queries, over the driver's views."""

from __future__ import annotations

_B = r"\p{Zs}\t"
_S = _B + r"\n\x0B\f\r\x{85}\x{2028}\x{2029}"


def _trim(c: str, cls: str = _B) -> str:
    return f"regexp_replace({c}, '^[{cls}]+|[{cls}]+$', '', 'g')"


_NOTES = "notes_v AS (SELECT 'notes/' || coalesce(source, 'none') || '/doc-' || doc_id || '.md' AS path, text AS content, modified FROM documents)"
_FILES = """files_v AS (
  SELECT 'notes/' || vault_key || substr(file_path, 6) AS path, max(size_bytes) AS size_bytes, max(modified) AS modified FROM vault_files WHERE deleted_at IS NULL GROUP BY 1
  UNION ALL SELECT file_path, NULL, added_at FROM hub_files WHERE deleted_at IS NULL)"""
_LINKS = "links_v AS (SELECT DISTINCT link_id, 'notes/' || vault_key || substr(note_path, 6) AS source, target FROM parsed_links WHERE target IS NOT NULL)"
_PAGES = "pages_v AS (SELECT DISTINCT page_id, 'references/' || vault_key || substr(ref_path, 11) AS path, page_number AS page, book_label AS label, text FROM ref_pages)"
_REFS = """refs_v AS (SELECT DISTINCT cache_id, 'references/' || vault_key || substr(ref_path, 11) AS path, cache_id * 1000 AS size_bytes,
  source_modified + to_minutes(CAST(cache_id % 3 - 1 AS BIGINT)) AS modified, title, author, total_pages AS pages, cache_version AS version, source_modified FROM cache_metadata)"""
_CANVAS = """canvas_v AS (SELECT 'notes/canvas/' || doc_id || '.canvas' AS path,
  '{"nodes":[' || replace(replace(text, chr(10), ','), '"x":', '"width":10,"height":10,"x":') || '],"edges":[{"id":"e1","fromNode":"' || doc_id || '","toNode":"' || doc_id || '"}]}' AS content, modified
  FROM documents WHERE source = 'canvas' AND text IS NOT NULL),
good_v AS (SELECT path, CAST(content AS JSON) AS j FROM canvas_v WHERE json_valid(content)),
nodes_v AS (SELECT path, i AS pos, json_extract(j, '$.nodes[' || i || ']') AS n FROM (SELECT path, j, unnest(range(0, CAST(json_array_length(j, '$.nodes') AS BIGINT))) AS i FROM good_v))"""
_VERSIONS = """versions_v AS (SELECT doc_id AS seq, modified AS ts, CASE WHEN doc_id % 10 = 9 THEN 'delete' WHEN doc_id % 10 = 0 THEN 'create' ELSE 'update' END AS op,
  'notes/' || vault_key || '/p' || (doc_id % 40) || '.md' AS path, text AS content FROM documents)"""

# Front matter: first two lines of just three dashes, if the trimmed content begins with them.
_PARSED = rf"""{_NOTES}, split_v AS (
  SELECT path, modified, coalesce(content, '') AS c, string_split(coalesce(content, ''), chr(10)) AS lines FROM notes_v
), marks_v AS (
  SELECT *, list_filter(range(1, len(lines) + 1), lambda i: {_trim('lines[i]')} = '---') AS marks FROM split_v
), block_v AS (
  SELECT *, starts_with({_trim('c', _S)}, '---') AND len(marks) >= 2 AS on_ FROM marks_v
), fields_v AS (
  SELECT path, modified, c, CASE WHEN on_ THEN array_to_string(lines[marks[2] + 1:], chr(10)) ELSE c END AS body,
    CASE WHEN on_ THEN list_transform(list_filter(list_transform(lines[marks[1] + 1:marks[2] - 1], lambda x: {_trim('x')}), lambda x: contains(x, ':')),
      lambda x: {{'k': lower({_trim("split_part(x, ':', 1)")}), 'v': {_trim("regexp_replace(x, '^[^:]*:', '')")}}}) ELSE [] END AS f FROM block_v
), heads_v AS (
  SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: {_trim('x')}), lambda x: starts_with(x, '# ')) AS h,
    list_filter(f, lambda x: x.k <> '') AS g FROM fields_v
), parsed_v AS (
  SELECT path, modified, c, body,
    coalesce(list_filter(g, lambda x: x.k = 'title')[-1].v, {_trim("substr(h[1], 3)")}, translate(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]+$', ''), '-_', '  ')) AS title,
    list_filter(g, lambda x: x.k = 'created')[-1].v AS created,
    list_filter(list_transform(string_split(regexp_replace({_trim("coalesce(list_filter(g, lambda x: x.k = 'tags')[-1].v, '')")}, '^\[|\]$', '', 'g'), ','), lambda x: lower({_trim('x')})), lambda x: x <> '') AS tags,
    len(list_distinct(list_transform(list_filter(g, lambda x: x.k NOT IN ('title', 'tags', 'created')), lambda x: x.k))) AS n_custom
  FROM heads_v
)"""


def _search(terms: list[str], limit: int) -> str:
    where = " AND ".join(f"contains(lower(c), '{t}')" for t in terms)
    score = " + ".join(f"(length(lower(c)) - length(replace(lower(c), '{t}', ''))) // {len(t)} + CASE WHEN contains(lower(title), '{t}') THEN 5 ELSE 0 END" for t in terms)
    at = _at(terms, "c")
    return f"WITH {_PARSED}, hit AS (SELECT path, title, c, CAST({score} AS DOUBLE) AS score, {at} AS at_pos FROM parsed_v WHERE {where}) SELECT path, title, {_snippet('c')} AS snippet, score FROM hit ORDER BY score DESC, path LIMIT {limit}"


def _at(terms: list[str], c: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains(lower({c}), '{t}') THEN strpos(lower({c}), '{t}') - 1 END" for t in terms) + ")"


def _snippet(c: str) -> str:
    piece = f"replace({_trim(f'substr({c}, greatest(0, at_pos - 60) + 1, 150)', _S)}, chr(10), ' ')"
    return f"CASE WHEN at_pos > 60 THEN '...' ELSE '' END || {piece} || CASE WHEN greatest(0, at_pos - 60) + 150 < length({c}) THEN '...' ELSE '' END"


_TARGET_PARTS = "list_filter(string_split(target, '/'), lambda x: x <> '')"
_RESOLVED = rf"""{_FILES}, {_LINKS}, based_v AS (SELECT path, regexp_extract(path, '[^/]*$') AS base FROM files_v
), named_v AS (
  SELECT path, 'n|' || lower(base) AS k FROM based_v
  UNION ALL SELECT path, 's|' || lower(regexp_replace(base, '\.[^.]+$', '')) FROM based_v WHERE regexp_matches(base, '^.+\.[mM][dD]$')
), asked_v AS (
  SELECT *, {_TARGET_PARTS} AS parts FROM links_v WHERE len({_TARGET_PARTS}) > 0
), keyed_v AS (
  SELECT *, regexp_matches(parts[-1], '^.+\.[^.]+$') AS ext FROM asked_v
), hits_v AS (
  SELECT l.link_id, l.source, n.path, len(parts) > 1 AND (n.path = 'notes/' || target || CASE WHEN ext THEN '' ELSE '.md' END OR ends_with(n.path, '/' || target || CASE WHEN ext THEN '' ELSE '.md' END)) AS hit
  FROM keyed_v l JOIN named_v n ON n.k = CASE WHEN ext THEN 'n|' ELSE 's|' END || lower(parts[-1])
), kept_v AS (
  SELECT *, string_split(path, '/') AS a, string_split(source, '/') AS b FROM (SELECT *, max(hit::INT) OVER (PARTITION BY link_id) AS any_hit FROM hits_v) WHERE hit OR any_hit = 0
), resolved_v AS (
  SELECT link_id, path AS match, row_number() OVER (PARTITION BY link_id ORDER BY len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) DESC, length(path), path) AS rank FROM kept_v
)"""

_WIKI, _MARKED = r"(!?\[\[[^\]]+\]\])", r"(!?\[[^\]]*\]\([^)]+\))"
_EDGES = rf"""{_NOTES}, raw_v AS (
  SELECT path, list_concat(list_transform(regexp_extract_all(content, '{_WIKI}'), lambda x: {{'w': true, 'raw': x}}), list_transform(regexp_extract_all(content, '{_MARKED}'), lambda x: {{'w': false, 'raw': x}})) AS r FROM notes_v WHERE content IS NOT NULL
), flat_v AS (
  SELECT path, i - 1 AS pos, r[i].w AS w, r[i].raw AS raw FROM (SELECT path, r, unnest(range(1, len(r) + 1)) AS i FROM raw_v)
), inner_v AS (
  SELECT *, regexp_extract(raw, '^!?\[\[([^\]]+)\]\]$', 1) AS inn, regexp_replace({_trim("regexp_extract(raw, '^!?\\[[^\\]]*\\]\\(([^)]+)\\)$', 1)".replace(chr(92) * 2, chr(92)))}, '(?s) .*$', '') AS url, regexp_extract(raw, '^!?\[([^\]]*)\]', 1) AS shown FROM flat_v
), edges_v AS (
  SELECT path, pos, CASE WHEN w THEN {_trim("split_part(split_part(inn, '|', 1), '#', 1)")} ELSE {_trim("CASE WHEN contains(split_part(url, '#', 1), '%') THEN url_decode(split_part(url, '#', 1)) ELSE split_part(url, '#', 1) END")} END AS target,
    CASE WHEN w THEN CASE WHEN contains(split_part(inn, '|', 1), '#') THEN substr(split_part(inn, '|', 1), strpos(split_part(inn, '|', 1), '#')) END ELSE CASE WHEN contains(url, '#') THEN substr(url, strpos(url, '#')) END END AS subpath,
    CASE WHEN w THEN CASE WHEN contains(inn, '|') THEN nullif({_trim("substr(inn, strpos(inn, '|') + 1)")}, '') END ELSE nullif(shown, '') END AS alias,
    starts_with(raw, '!') AS is_embed, raw
  FROM inner_v WHERE w OR NOT regexp_matches(lower(url), '^(?:https?://|mailto:)')
)"""
_BACK = rf"""{_EDGES}, {_FILES}, based_v AS (SELECT path, regexp_extract(path, '[^/]*$') AS base FROM files_v
), named_v AS (
  SELECT path, 'n|' || lower(base) AS k FROM based_v
  UNION ALL SELECT path, 's|' || lower(regexp_replace(base, '\.[^.]+$', '')) FROM based_v WHERE regexp_matches(base, '^.+\.[mM][dD]$')
), asked_v AS (
  SELECT path || '|' || pos AS link_id, path AS source, raw, is_embed, target, {_TARGET_PARTS} AS parts FROM edges_v WHERE target <> '' AND len({_TARGET_PARTS}) > 0
), keyed_v AS (SELECT *, regexp_matches(parts[-1], '^.+\.[^.]+$') AS ext FROM asked_v
), hits_v AS (
  SELECT l.link_id, l.source, l.raw, l.is_embed, n.path, len(parts) > 1 AND (n.path = 'notes/' || target || CASE WHEN ext THEN '' ELSE '.md' END OR ends_with(n.path, '/' || target || CASE WHEN ext THEN '' ELSE '.md' END)) AS hit
  FROM keyed_v l JOIN named_v n ON n.k = CASE WHEN ext THEN 'n|' ELSE 's|' END || lower(parts[-1])
), kept_v AS (
  SELECT *, string_split(path, '/') AS a, string_split(source, '/') AS b FROM (SELECT *, max(hit::INT) OVER (PARTITION BY link_id) AS any_hit FROM hits_v) WHERE hit OR any_hit = 0
), back_v AS (
  SELECT path AS target, source AS path, raw, is_embed FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) DESC, length(path), path) AS rank FROM kept_v) WHERE rank = 1
)"""

_NODE = r"json_type(n, '$.{0}') = 'VARCHAR'"
_STATE = """state_v AS (SELECT path, arg_max(content, seq) AS c0, max(seq) AS seq, arg_max(op, seq) AS last, arg_max({'c': content}, seq).c AS content FROM versions_v WHERE seq <= %s GROUP BY path)"""
_ALL, _MIDDLE = "9223372036854775807", "(SELECT coalesce(max(doc_id), 0) // 2 FROM documents)"
_CANVAS_LINES = r"regexp_split_to_array(t, '\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]')"

_MARKED_TEXT = rf"""{_PAGES}, counted_v AS (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM pages_v), marked_v AS (
  SELECT path, CASE WHEN max(n) < 200 THEN 'fullText' ELSE 'tocOnly' END AS kind, string_agg('--- Page ' || page || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY page, '--- Page ' || page || ' ---' || chr(10) || coalesce(text, '')) AS content
  FROM counted_v WHERE n < 200 OR page <= 30 GROUP BY path)"""
_PATCHED = """p1 AS (SELECT path, content AS c, (length(content) - length(replace(content, 'canal', ''))) // 5 AS n1 FROM notes_v WHERE content IS NOT NULL),
p2 AS (SELECT *, CASE WHEN n1 = 1 THEN replace(c, 'canal', 'river bank') END AS d FROM p1),
p3 AS (SELECT *, (length(d) - length(replace(d, 'the river', ''))) // 9 AS n2 FROM p2)"""

# Edits: one for each path, judged against the newest state.
_EDITS = """edits_v AS (SELECT arg_min(note_id, note_id) AS pos, path, arg_min({'c': content}, note_id).c AS content, arg_min(vault_key, note_id) AS vault_key
  FROM (SELECT *, 'notes/' || vault_key || '/p' || (note_id % 80) || '.md' AS path FROM notes WHERE note_id IS NOT NULL) GROUP BY path),
live_v AS (SELECT path, content FROM state_v WHERE last <> 'delete'),
both_v AS (SELECT e.*, l.content AS old, l.path IS NOT NULL AS there, 'notes/' || vault_key || '/p' || (pos % 7 + 36) || '/m' || pos || '.md' AS goal FROM edits_v e LEFT JOIN live_v l ON l.path = e.path)"""
_CREATED = rf"""CASE WHEN starts_with({_trim("coalesce(content, '')", _S)}, '---') THEN coalesce(content, '') ELSE '---' || chr(10) || 'title: ' || regexp_extract(path, '([^/]+)\.md$', 1) || chr(10) || 'created: 2025-12-31' || chr(10) || '---' || chr(10) || chr(10) || coalesce(content, '') END"""


def _edit(text: str, message: str, error: str, goal: str = "CAST(NULL AS VARCHAR)") -> str:
    made = f"SELECT pos, path, {goal} AS new_path, {text} AS c, {message} AS m, {error} AS error FROM both_v"
    return f"WITH {_VERSIONS}, {_STATE % _ALL}, {_EDITS}, made_v AS ({made}) SELECT pos, path, new_path, CASE WHEN error IS NULL THEN md5(c) END AS digest, CASE WHEN error IS NULL THEN m END AS message, error FROM made_v"


_MISSING = "CASE WHEN NOT there THEN 'no such file' END"
_IMAGES = r"""raw_v AS (SELECT path, lower(regexp_extract(path, '[^/]+\.([^./]+)$', 1)) AS ext, size_bytes AS n, size_bytes % 30 + 1 AS k FROM files_v WHERE size_bytes IS NOT NULL),
image_v AS (SELECT *, list_transform(range(1, k + 1), lambda i: (n + i) % 7 + 1) AS d, CASE WHEN k > 8 THEN list_transform(range(0, 8), lambda i: CAST(floor(i * (k - 1) / 7.0 + 0.5) AS BIGINT)) ELSE range(0, k) END AS picked
  FROM raw_v WHERE ext IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'heic', 'tiff', 'tif', 'bmp'))"""
_OFFSETS = "list_transform(picked, lambda i: CAST(coalesce(list_sum(d[1:i]), 0) AS BIGINT))"

ORACLES = {
    "search_notes_single": _search(["the"], 20),
    "search_notes_multi": _search(["canal", "the"], 50),
    "search_notes_repeated_token": _search(["map", "map"], 30),
    "note_frontmatter": f"WITH {_PARSED} SELECT path, title, created, array_to_string(tags, ',') AS tags, CAST(n_custom AS BIGINT) AS n_custom, CAST(length(body) AS BIGINT) AS body_chars FROM parsed_v",
    "note_word_count": f"WITH {_PARSED} SELECT path, CAST(len(list_filter(regexp_split_to_array(body, '[{_S}]+'), lambda x: x <> '')) AS BIGINT) AS word_count FROM parsed_v",
    "note_links_flat": rf"WITH {_NOTES}, l AS (SELECT path, list_concat(regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1), list_filter(regexp_extract_all(content, '\[[^\]]*\]\(([^)]+)\)', 1), lambda x: NOT regexp_matches(x, '^https?://'))) AS links FROM notes_v) SELECT path, array_to_string(links, chr(10)) AS links FROM l WHERE len(links) > 0",
    "link_edges": f"WITH {_EDGES} SELECT path, CAST(pos AS BIGINT) AS pos, target, subpath, alias, is_embed, raw FROM edges_v WHERE target <> ''",
    "resolve_links_ranked": f"WITH {_RESOLVED} SELECT link_id, match, rank FROM resolved_v",
    "resolve_ambiguous": f"WITH {_RESOLVED} SELECT link_id, count(*) AS matches FROM resolved_v GROUP BY 1 HAVING count(*) > 1",
    "dangling_links": f"WITH {_RESOLVED} SELECT link_id, target FROM links_v WHERE link_id NOT IN (SELECT link_id FROM resolved_v)",
    "backlinks_all": f"WITH {_BACK} SELECT target, count(*) AS links, count(*) FILTER (is_embed) AS embeds FROM back_v GROUP BY 1",
    "backlinks_to_one": f"WITH {_BACK}, best AS (SELECT path FROM based_v WHERE lower(base) = 'home.md' ORDER BY length(path), path LIMIT 1) SELECT path, raw, is_embed FROM back_v WHERE target = (SELECT path FROM best)",
    "list_notes_by_dir": f"WITH {_PARSED} SELECT path, title, modified FROM parsed_v WHERE starts_with(path, 'notes/meeting/')",
    "list_notes_by_tag": f"WITH {_PARSED} SELECT path, title, modified FROM parsed_v WHERE list_contains(tags, 'botany')",
    "tag_counts": f"WITH {_PARSED} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM parsed_v) GROUP BY 1",
    "recent_notes": f"WITH {_PARSED} SELECT path, title, modified FROM parsed_v WHERE modified >= TIMESTAMP '2025-12-31' - INTERVAL 30 DAYS",
    "note_index": f"""WITH {_PARSED} SELECT path, '{{"path":' || to_json(path) || CASE WHEN len(tags) > 0 THEN ',"tags":' || to_json(tags) ELSE '' END || ',"title":' || to_json(title) || '}}' AS entry FROM parsed_v""",
    "title_from_path": rf"WITH {_FILES}, b AS (SELECT path, regexp_extract(path, '[^/]*$') AS base FROM files_v) SELECT path, translate(CASE WHEN regexp_matches(base, '^.+\.[^.]+$') THEN regexp_replace(base, '\.[^.]+$', '') ELSE base END, '-_', '  ') AS title, regexp_extract(base, '^.+\.([^.]+)$', 1) AS ext FROM b",
    "reference_search_capped": f"""WITH {_PAGES}, hit AS (SELECT path, page_id AS part, text AS c, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 + (length(lower(text)) - length(replace(lower(text), 'canal', ''))) // 5 AS DOUBLE) AS score, {_at(['the', 'canal'], 'text')} AS at_pos
      FROM pages_v WHERE contains(lower(text), 'the') AND contains(lower(text), 'canal')), capped AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, part) AS r FROM hit)
      SELECT path, part, {_snippet('c')} AS snippet, score FROM capped WHERE r <= 3 ORDER BY score DESC, path, part LIMIT 200""",
    "reference_page_of_match": rf"""WITH {_MARKED_TEXT}, hit AS (SELECT path, content, substr(content, 1, strpos(lower(content), 'canal') - 1) AS head, CAST((length(lower(content)) - length(replace(lower(content), 'canal', ''))) // 5 AS DOUBLE) AS score FROM marked_v WHERE contains(lower(content), 'canal'))
      SELECT path, TRY_CAST(regexp_extract(head, '(?s)^.*--- Page (.*?) ---', 1) AS BIGINT) AS page, score FROM hit ORDER BY score DESC, path LIMIT 1000""",
    "reference_in_doc_pages": f"WITH {_PAGES} SELECT path, page FROM (SELECT path, page, row_number() OVER (PARTITION BY path ORDER BY page) AS r FROM (SELECT DISTINCT path, page FROM pages_v WHERE contains(lower(text), 'canal'))) WHERE r <= 5",
    "reference_index_text": f"WITH {_MARKED_TEXT} SELECT path, kind, md5(content) AS digest FROM marked_v",
    "reference_labels": f"WITH {_PAGES}, one AS (SELECT path, page, max(label) AS label FROM pages_v GROUP BY 1, 2) SELECT path, count(*) AS labels FROM one WHERE label IS NOT NULL GROUP BY 1 HAVING NOT bool_and(label = CAST(page AS VARCHAR))",
    "reference_label_lookup": f"WITH {_PAGES} SELECT path, CAST(page AS BIGINT) AS page FROM (SELECT path, coalesce(min(page) FILTER (label = '3'), min(page) FILTER (page = 3)) AS page FROM pages_v GROUP BY 1) WHERE page IS NOT NULL",
    "reference_list": rf"WITH {_REFS} SELECT r.path, CASE WHEN {_trim('coalesce(m.title, ' + chr(39) * 2 + ')', _S)} <> '' THEN m.title ELSE regexp_replace(regexp_extract(r.path, '[^/]*$'), '\.[^.]+$', '') END AS title, m.author, m.pages, r.size_bytes / 1048576.0::DOUBLE AS size_mb FROM refs_v r JOIN refs_v m ON m.path = r.path",
    "cache_staleness": f"WITH {_REFS}, best AS (SELECT path, max(source_modified) AS m FROM refs_v WHERE version >= 3 GROUP BY 1) SELECT r.path, coalesce(date_trunc('second', r.modified) <= date_trunc('second', b.m), false) AS fresh FROM refs_v r LEFT JOIN best b ON b.path = r.path",
    "canvas_counts": f"WITH {_CANVAS} SELECT c.path, CAST(coalesce(json_array_length(g.j, '$.nodes'), 0) AS BIGINT) AS node_count, CAST(coalesce(json_array_length(g.j, '$.edges'), 0) AS BIGINT) AS edge_count FROM canvas_v c LEFT JOIN good_v g ON g.path = c.path",
    "canvas_type_breakdown": f"WITH {_CANVAS} SELECT path, n->>'type' AS type, count(*) AS n FROM nodes_v WHERE {_NODE.format('type')} GROUP BY 1, 2",
    "canvas_briefs": rf"""WITH {_CANVAS}, t AS (SELECT path, pos, n->>'id' AS id, n->>'type' AS type, coalesce(regexp_split_to_array(n->>'text', '[\n\x0B\f\r\x{{85}}\x{{2028}}\x{{2029}}]')[1], '') AS first FROM nodes_v WHERE {_NODE.format('id')} AND {_NODE.format('type')})
      SELECT path, CAST(pos AS BIGINT) AS pos, id, type, CASE WHEN length(first) > 60 THEN substr(first, 1, 60) || '…' ELSE first END AS label FROM t""",
    "canvas_search": rf"""WITH {_CANVAS}, t AS (SELECT path, pos, n->>'id' AS id, n->>'text' AS flat FROM nodes_v WHERE {_NODE.format('id')} AND {_NODE.format('type')} AND {_NODE.format('text')}),
      h AS (SELECT *, strpos(lower(flat), 'tin box') - 1 AS p FROM t WHERE contains(lower(flat), 'tin box')), w AS (SELECT *, greatest(0, p - 40) AS lo, least(length(flat), p + 47) AS hi FROM h)
      SELECT path, CAST(pos AS BIGINT) AS pos, id, 'text' AS field, CASE WHEN lo > 0 THEN '…' ELSE '' END || {_trim('substr(flat, lo + 1, hi - lo)')} || CASE WHEN hi < length(flat) THEN '…' ELSE '' END AS snippet, (SELECT count(*) FROM h) AS total FROM w ORDER BY path, pos LIMIT 100""",
    "canvas_violations": f"""WITH {_CANVAS} SELECT path, 'malformed' AS code, CAST(0 AS BIGINT) AS part, CAST(NULL AS VARCHAR) AS ref FROM canvas_v WHERE NOT json_valid(content)
      UNION ALL SELECT path, 'duplicate id', 0, id FROM (SELECT path, n->>'id' AS id, row_number() OVER (PARTITION BY path, n->>'id' ORDER BY pos) AS r FROM nodes_v) WHERE r > 1
      UNION ALL SELECT path, 'dangling edge', p, regexp_extract(path, '([0-9]+)[.]canvas$', 1) FROM good_v, (SELECT unnest([0, 1]) AS p)""",
    "canvas_missing_files": f"WITH {_FILES} SELECT DISTINCT node_row_id, 'notes/' || vault_key || substr(label, 6) AS file, 'file not found' AS warning FROM canvas_nodes WHERE node_type = 'file' AND label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files_v f WHERE f.path = 'notes/' || vault_key || substr(label, 6))",
    "attachment_list": rf"WITH {_FILES}, e AS (SELECT *, lower(regexp_extract(path, '[^/]+\.([^./]+)$', 1)) AS ext FROM files_v) SELECT path, ext, size_bytes, ext IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'heic', 'tiff', 'tif', 'bmp') AS readable, modified FROM e WHERE starts_with(path, 'notes/') AND ext NOT IN ('md', 'markdown', 'canvas') AND NOT regexp_matches(path, '(?:^|/)\.')",
    "version_latest": f"WITH {_VERSIONS}, {_STATE % '9223372036854775807'} SELECT path, seq, md5(content) AS digest FROM state_v WHERE last <> 'delete'",
    "version_as_of": f"WITH {_VERSIONS}, {_STATE % _MIDDLE} SELECT path, seq FROM state_v WHERE last <> 'delete'",
    "file_history": f"WITH {_VERSIONS} SELECT seq, ts, op, op || ' ' || path AS message FROM versions_v WHERE path = 'notes/v000/p7.md' ORDER BY ts DESC, seq DESC LIMIT 10",
    "changelog_since": f"WITH {_VERSIONS} SELECT seq, ts, op, path, op || ' ' || path AS message FROM versions_v WHERE ts >= TIMESTAMP '2024-01-01' ORDER BY ts DESC, seq DESC LIMIT 50",
    "patch_apply": f"""WITH {_NOTES}, {_PATCHED} SELECT path, CASE WHEN n1 = 0 OR (n1 = 1 AND n2 = 0) THEN 'not found' WHEN n1 > 1 OR n2 > 1 THEN 'ambiguous' END AS error,
      CAST(CASE WHEN n1 = 1 AND n2 = 1 THEN 2 ELSE 0 END AS BIGINT) AS applied, CASE WHEN n1 = 1 AND n2 = 1 THEN md5(replace(d, 'the river', 'a river')) END AS digest FROM p3""",
    "batch_move_conflicts": f"""WITH {_FILES}, m AS (SELECT i AS pos, 'notes/hub/' || CASE WHEN i % 3 > 0 THEN 'Inbox' ELSE 'Sources' END || CASE WHEN i > 4 THEN i::VARCHAR ELSE '' END || '.md' AS s, 'notes/' || CASE WHEN i < 2 THEN 'Home' ELSE 'moved/' || i END || '.md' AS d FROM range(20) t(i))
      SELECT pos, 'source twice' AS code FROM m WHERE lower(s) IN (SELECT lower(s) FROM m GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT pos, 'destination twice' FROM m WHERE lower(d) IN (SELECT lower(d) FROM m GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT pos, 'source is a destination' FROM m a WHERE EXISTS (SELECT 1 FROM m b WHERE lower(b.d) = lower(a.s) AND b.pos <> a.pos)
      UNION ALL SELECT pos, 'missing source' FROM m WHERE s NOT IN (SELECT path FROM files_v)
      UNION ALL SELECT pos, 'destination exists' FROM m WHERE lower(s) <> lower(d) AND d IN (SELECT path FROM files_v)""",
    "frame_sampling": "SELECT doc_id, array_to_string(CASE WHEN doc_id % 60 > 8 THEN list_transform(range(0, 8), lambda i: CAST(floor(i * (doc_id % 60 - 1) / 7.0 + 0.5) AS BIGINT)) ELSE range(0, doc_id % 60) END, ',') AS picked FROM documents",
    "image_plans": rf"""WITH {_FILES}, {_IMAGES}, a AS (SELECT *, CASE WHEN n > 26214400 THEN 'reject_size' WHEN (n % 9000)::DOUBLE * (n % 7000) / 1000000 > 50 THEN 'reject_pixels' WHEN ext = 'gif' AND k > 1 THEN 'frames' WHEN ext IN ('png', 'jpg', 'jpeg', 'gif', 'webp') AND greatest(n % 9000, n % 7000) <= 2576 THEN 'pass_through' ELSE 're_encode' END AS action FROM image_v)
      SELECT path, action, CASE WHEN action = 'pass_through' THEN CASE WHEN ext IN ('jpg', 'jpeg') THEN 'image/jpeg' ELSE 'image/' || ext END WHEN action IN ('re_encode', 'frames') THEN 'image/png' END AS mime,
        CASE WHEN action = 'frames' THEN array_to_string(picked, ',') WHEN action IN ('pass_through', 're_encode') THEN '0' END AS frames, CASE WHEN action = 'frames' THEN array_to_string({_OFFSETS}, ',') END AS offsets, CASE WHEN action = 'frames' THEN CAST(list_sum(d) AS BIGINT) END AS duration FROM a""",
    "animation_frames": rf"WITH {_FILES}, {_IMAGES}, f AS (SELECT path, picked, {_OFFSETS} AS o FROM image_v WHERE k > 1 AND n <= 26214400) SELECT path, i - 1 AS pos, picked[i] AS frame, o[i] AS offset FROM (SELECT *, unnest(range(1, len(picked) + 1)) AS i FROM f)",
    "edit_create": _edit(_CREATED, "'Create ' || path", "CASE WHEN there THEN 'exists' END"),
    "edit_replace": _edit("coalesce(content, '')", "'Update ' || path", _MISSING),
    "edit_append": _edit("coalesce(old, '') || chr(10) || coalesce(content, '')", "'Update ' || path", _MISSING),
    "edit_move": _edit("old", "'Move ' || path || ' to ' || goal", _MISSING, "goal"),
    "edit_delete": _edit("old", r"'Delete ' || path || ' to 2025-12-31T00-00-00Z_' || regexp_extract(path, '[^/]*$')", _MISSING),
    "edit_revert": f"WITH {_VERSIONS}, {_STATE % _ALL}, {_EDITS}, {_STATE.replace('state_v', 'then_v') % _MIDDLE} SELECT e.pos, e.path, CAST(NULL AS VARCHAR) AS new_path, CASE WHEN t.path IS NOT NULL THEN md5(t.content) END AS digest, CASE WHEN t.path IS NOT NULL THEN 'Revert ' || e.path || ' to ' || {_MIDDLE} END AS message, CASE WHEN t.path IS NULL THEN 'no such version' END AS error FROM edits_v e LEFT JOIN (SELECT * FROM then_v WHERE last <> 'delete') t ON t.path = e.path",
    "state_after_edits": f"""WITH {_VERSIONS}, {_STATE % _ALL}, {_EDITS} SELECT path, md5(content) AS digest FROM live_v WHERE path NOT IN (SELECT path FROM edits_v)
      UNION ALL SELECT goal, md5(old) FROM both_v WHERE there UNION ALL SELECT path, md5({_CREATED}) FROM both_v""",
    "version_changes": f"WITH {_VERSIONS}, {_STATE % _ALL}, {_EDITS} SELECT path FROM both_v WHERE there UNION ALL SELECT goal FROM both_v WHERE there",
    "vault_snapshot": f"""WITH {_VERSIONS}, {_STATE % _ALL}, new AS (SELECT path, content FROM state_v WHERE last <> 'delete'), {_STATE.replace('state_v', 'old_v') % _MIDDLE}, old AS (SELECT path, content FROM old_v WHERE last <> 'delete'),
      d AS (SELECT coalesce(n.path, o.path) AS path, n.content, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM new n FULL JOIN old o ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.content IS DISTINCT FROM n.content)
      SELECT CASE WHEN change = 'removed' THEN 'delete' ELSE 'snapshot' END AS op, 'Snapshot ' || change AS message, count(*) AS n, count(DISTINCT path) AS paths, count(*) FILTER (content IS NULL) AS blank FROM d GROUP BY ALL""",
    "file_at_version": f"WITH {_VERSIONS}, {_STATE % _MIDDLE} SELECT path, md5(content) AS digest FROM state_v WHERE last <> 'delete' AND path = 'notes/v000/p7.md'",
    "batch_read": rf"""WITH {_PARSED}, asked AS (SELECT i AS pos, 'notes/' || ['journal', 'meeting', 'reading'][i % 3 + 1] || '/doc-' || i * 7 || '.md' AS path FROM range(25) t(i))
      SELECT a.pos, a.path, CASE WHEN pos < 20 THEN CAST(len(list_filter(regexp_split_to_array(p.body, '[{_S}]+'), lambda x: x <> '')) AS BIGINT) END AS word_count, CASE WHEN pos < 20 THEN md5(n.content) END AS digest, CASE WHEN pos >= 20 THEN 'skipped' WHEN n.path IS NULL THEN 'not found' END AS error
      FROM asked a LEFT JOIN parsed_v p ON p.path = a.path LEFT JOIN notes_v n ON n.path = a.path""",
    "batch_read_counts": f"WITH {_NOTES}, asked AS (SELECT i AS pos, 'notes/' || ['journal', 'meeting', 'reading'][i % 3 + 1] || '/doc-' || i * 7 || '.md' AS path FROM range(25) t(i)) SELECT count(*) AS asked, count(*) FILTER (pos < 20 AND n.path IS NOT NULL) AS found, count(*) FILTER (pos < 20 AND n.path IS NULL) AS missing, count(*) FILTER (pos >= 20) AS skipped FROM asked a LEFT JOIN notes_v n ON n.path = a.path",
    "reference_cached_texts": f"WITH {_PAGES} SELECT path, CASE WHEN page % 7 = 1 THEN CAST(0 AS BIGINT) ELSE CAST(page AS BIGINT) END AS part, md5(text) AS digest FROM pages_v WHERE page IS NOT NULL AND text IS NOT NULL AND page % 7 NOT IN (0, 2) AND page % 5 <> 0 AND page % 11 <> 10",
    "canvas_read": f"WITH {_CANVAS} SELECT c.path, CAST(coalesce(json_array_length(g.j, '$.nodes'), 0) AS BIGINT) AS node_count, CAST(coalesce(json_array_length(g.j, '$.edges'), 0) AS BIGINT) AS edge_count, md5(c.content) AS digest FROM canvas_v c LEFT JOIN good_v g ON g.path = c.path",
    "reference_pages_read": f"""WITH {_PAGES}, own AS (SELECT * FROM pages_v WHERE path = (SELECT min(path) FROM pages_v)), labelled AS (SELECT coalesce(min(page) FILTER (label = '3'), min(page) FILTER (page = 3)) AS p FROM own), top AS (SELECT max(page) AS t FROM own),
      asked AS (SELECT 'query' AS how, 20 AS most, * FROM own WHERE contains(lower(text), 'the') UNION ALL SELECT 'label', 5, * FROM own WHERE page = (SELECT p FROM labelled) UNION ALL SELECT 'page', 5, * FROM own WHERE page = 2
        UNION ALL SELECT 'range', 5, * FROM own WHERE page BETWEEN 2 AND least(4, (SELECT t FROM top)) UNION ALL SELECT 'first', 5, * FROM own UNION ALL SELECT 'bad range', 20, * FROM own WHERE page BETWEEN 1 AND least(10, (SELECT t FROM top)))
      SELECT how, CAST(page AS BIGINT) AS page, label, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY how ORDER BY page) AS r FROM asked) WHERE r <= most""",
    "reference_cache_build": f"""WITH {_REFS}, {_PAGES}, f AS (SELECT path, max(modified) AS modified FROM refs_v GROUP BY 1), best AS (SELECT path, max(source_modified) AS m FROM refs_v WHERE version >= 3 GROUP BY 1),
      fresh AS (SELECT f.path FROM f JOIN best USING (path) WHERE date_trunc('second', f.modified) <= date_trunc('second', best.m)), p AS (SELECT * FROM pages_v WHERE page IS NOT NULL AND path IN (SELECT path FROM f) AND path NOT IN (SELECT path FROM fresh)),
      c AS (SELECT path, count(*) AS n FROM p GROUP BY 1), b AS (SELECT path, 0 AS k, page AS o, page, '--- Page ' || page || ' ---' || chr(10) || coalesce(text, '') AS t, n FROM p JOIN c USING (path) WHERE n < 200 OR page <= 30
        UNION ALL SELECT path, 1, page_id, page, '--- Page ' || page || ' ---' || chr(10) || coalesce(label, ''), n FROM p JOIN c USING (path) WHERE page % 3 = 0)
      SELECT path, CASE WHEN max(n) < 200 THEN 'fullText' ELSE 'tocOnly' END AS kind, max(n) AS pages, md5(string_agg(t, chr(10) || chr(10) ORDER BY k, o, t)) AS digest, CAST(3 AS BIGINT) AS version FROM b GROUP BY 1
      UNION ALL SELECT path, 'fullText', CAST(arg_max({{'p': pages}}, source_modified).p AS BIGINT), md5(coalesce(arg_max({{'t': title}}, source_modified).t, '')), CAST(max(version) AS BIGINT) FROM refs_v WHERE version >= 3 AND path IN (SELECT path FROM fresh) GROUP BY 1""",
    "audit_by_operation": r"WITH o AS (SELECT regexp_extract(line, '^[0-9TZ:\-]+ \| ([A-Z]+) +\| ', 1) AS operation FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE source = 'log' AND text IS NOT NULL)) SELECT operation, count(*) AS n, operation IN ('CREATE', 'UPDATE', 'MOVE', 'DELETE') AS writes FROM o WHERE operation <> '' GROUP BY 1",
    "path_guard": r"""WITH t AS (SELECT DISTINCT link_id, target, CASE WHEN contains(target, '%') THEN url_decode(target) ELSE target END AS d FROM parsed_links)
      SELECT link_id, CASE WHEN target IS NULL OR target = '' THEN 'empty' WHEN starts_with(d, '/') THEN 'absolute' WHEN list_contains(string_split(d, '/'), '..') THEN 'traversal' WHEN NOT starts_with(d, 'notes/') THEN 'outside' WHEN lower(regexp_extract(d, '[^/]+\.([^./]+)$', 1)) NOT IN ('md', 'markdown') THEN 'extension' END AS problem FROM t""",
    "sanitize_message": r"SELECT DISTINCT result_id, regexp_replace(replace(snippet, chr(10), ' '), '[^\p{L}\p{M}\p{N} \-_./\[\]():,]', '', 'g') AS message, regexp_replace(title, '[^\p{L}\p{M}0-9\-_/.]', '', 'g') AS ref FROM search_results",
    "byte_format": "WITH b AS (SELECT DISTINCT file_id, size_bytes * 37 AS n FROM vault_files WHERE size_bytes IS NOT NULL) SELECT file_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%.1f MB', n / 1048576.0::DOUBLE) END AS shown FROM b",
    "cache_keys": rf"WITH {_REFS} SELECT path, substr(sha256(path), 1, 32) AS key, regexp_replace(path, '\.[^./]+$', '') || '.png' AS png FROM refs_v",
    "dirty_files": f"""WITH {_VERSIONS}, {_STATE % '9223372036854775807'}, new AS (SELECT path, content FROM state_v WHERE last <> 'delete'), {_STATE.replace('state_v', 'old_v') % _MIDDLE}, old AS (SELECT path, content FROM old_v WHERE last <> 'delete')
      SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM new n FULL JOIN old o ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.content IS DISTINCT FROM n.content""",
}
