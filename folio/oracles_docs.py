"""DuckDB SQL for functions, html, page lists, corrections, differences, exports and sources."""

from __future__ import annotations

from folio.oracles import oracle
from folio.sqlparts import PARTS, part, resolve

NOTE = "display:block;font-size:0.82em;color:#1e5aa8;font-weight:bold;"
PICTURE = "display:block;font-size:0.82em;color:#1c9b4a;font-weight:bold;"


def esc(c: str, quote: str = "") -> str:
    """Escaped text; ``quote`` is the entity of the apostrophe, '' leaves quotes alone."""
    out = f"replace(replace(replace({c},'&','&amp;'),'<','&lt;'),'>','&gt;')"
    if quote:
        out = f"replace(replace({out},'\"','&quot;'),'''','{quote}')"
    return out


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def unescape(c: str) -> str:
    for ent, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&#x27;", "''"),
                     ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = f"replace({c},'{ent}','{raw}')"
    return c


def block_text(c: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace({c},'<[^>]+>',' ','g'),'\\s+',' ','g')))"


oracle("fn_clean_text", "SELECT doc_id, trim(regexp_replace(text,'[\\s ]+',' ','g')) AS clean FROM documents")
oracle("fn_pid", """
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'uuid:' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS pid FROM orders""")
oracle("fn_page_number", "SELECT page_id, value, searchable FROM nl_num")
oracle("fn_page_label", """
SELECT page_id, lower(replace(trim(trim(trim(page_number), '[](){}')),' ','')) AS label, lower(replace(title,' ','')) AS title_label FROM fx_pages""")
oracle("fn_hyp_resolve", f"SELECT page_id, token_seq, {resolve()} AS word FROM fx_tokens")
oracle("fn_token_len", r"""
SELECT page_id, token_seq, length(regexp_replace(content,'\s','','g')) AS n, regexp_matches(content,'[\p{L}\p{N}]') AS alnum,
  regexp_matches(content,'\p{L}') AS alpha FROM fx_tokens""")
oracle("fn_unescape", f"SELECT page_id, {unescape('html')} AS plain FROM pages")
oracle("fn_escape", f"SELECT doc_id, {esc('text', '&#x27;')} AS quoted, {esc('text')} AS unquoted FROM documents")
oracle("fn_strip_fences", f"""
SELECT conv_id * 1000 + turn AS page_id, CASE turn % 3 WHEN 0 THEN {strip('text')} WHEN 1 THEN
  CASE WHEN contains(text, chr(10)) AND regexp_matches(text, '(?s)\\n```') THEN 'unexpected' ELSE {strip("trim(text, '`')")} END
  ELSE {strip('text')} END AS body FROM conversations""")
part("safe_talk", """
SELECT conv_id * 1000 + turn AS page_id, replace(text, chr(92), '') AS t FROM conversations
""")
oracle("fn_json_repair", """
SELECT page_id, '{"blocks":' || chr(10) || '[{"id":"b1","type":"p","text":"'
  || replace(replace(replace(t, '"', chr(92) || '"'), chr(13), chr(92) || 'n'), chr(10), chr(92) || 'n') || '"}]}' AS json FROM safe_talk""")
oracle("block_docs", "SELECT page_id, 'b1' AS block_id, CAST(0 AS BIGINT) AS ord, 'p' AS type, t AS text FROM safe_talk")
oracle("join_decision_parse", """
SELECT conv_id * 1000 + turn AS page_id, CASE (conv_id * 1000 + turn + turn) % 8 WHEN 0 THEN 'join' WHEN 1 THEN 'merge' WHEN 2 THEN 'merge'
  WHEN 3 THEN 'join' WHEN 4 THEN 'merge' WHEN 5 THEN 'split' WHEN 6 THEN
    CASE WHEN lower(trim(text)) IN ('join','merge','split') THEN lower(trim(text)) ELSE 'split' END ELSE 'split' END AS decision FROM conversations""")
oracle("content_key", "SELECT doc_id, doc_id || ':' || sha256(text) || ':' || sha256(lower(text)) AS key FROM documents")
part("lib_urls", "SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS site FROM pages")
part("lib_base", """
SELECT DISTINCT site || CASE page_id % 4 WHEN 0 THEN '/search/api/v5.0' WHEN 1 THEN '/search/api/client/v7.0' WHEN 2 THEN '/api' ELSE '' END AS base,
  site || CASE page_id % 4 WHEN 0 THEN '/search' WHEN 1 THEN '/search' ELSE '' END AS handle, page_id % 4 AS k, site FROM lib_urls
""")
part("lib_known", "SELECT DISTINCT site || '/search/api/client/v7.0' AS base, 'Library ' || site AS label FROM lib_urls WHERE page_id % 5 = 1")
oracle("library_info", """
SELECT base AS api_base, handle AS handle_base, regexp_replace(site, '^https?://', '') AS netloc,
  coalesce(k.label, regexp_replace(site, '^https?://', '')) AS label,
  CASE WHEN k.label IS NOT NULL THEN 'known' ELSE split_part(regexp_replace(site, '^https?://', ''), '.', 1) END AS code,
  CASE b.k WHEN 0 THEN 'K5' WHEN 1 THEN 'K7' ELSE '' END AS version
FROM lib_base b LEFT JOIN lib_known k USING (base)""")
oracle("note_bbox", """
SELECT page_id, seq, CASE WHEN seq <> 2 THEN x END AS x, CASE WHEN seq <> 2 THEN y END AS y, CASE WHEN seq <> 2 THEN w END AS w,
  CASE WHEN seq <> 2 THEN h END AS h, CAST(CASE WHEN seq <> 1 THEN 1400 END AS BIGINT) AS pw, CAST(CASE WHEN seq <> 1 THEN 4000 END AS BIGINT) AS ph
FROM fx_illustrations""")
part("crop0", """
SELECT page_id, seq, CAST(round_even(x*sx, 0) AS BIGINT) AS cx, CAST(round_even(y*sy, 0) AS BIGINT) AS cy,
  CAST(round_even(w*sx, 0) AS BIGINT) AS cw, CAST(round_even(h*sy, 0) AS BIGINT) AS ch, iw, ih
FROM (SELECT *, iw / 1400e0 AS sx, ih / 2000e0 AS sy FROM (SELECT *, floor((1e0 + (page_id % 5) / 4e0) * 1400) AS iw,
  floor((1e0 + (page_id % 5) / 4e0) * 2000) AS ih FROM fx_illustrations))
""")
oracle("crop_region", """
SELECT page_id, seq, cx AS x, cy AS y, w2 AS w, h2 AS h, CASE WHEN greatest(w2, h2) > 1600 THEN ',1600' ELSE 'max' END AS size,
  cx || ',' || cy || ',' || w2 || ',' || h2 AS region
FROM (SELECT *, CAST(CASE WHEN cx + cw > iw THEN greatest(1, iw - cx) ELSE cw END AS BIGINT) AS w2,
   CAST(CASE WHEN cy + ch > ih THEN greatest(1, ih - cy) ELSE ch END AS BIGINT) AS h2 FROM crop0)""")

# --- html ------------------------------------------------------------------------------------------
VOID = "('br','hr','img','input','meta','link','source','track','area','col','embed','param','wbr','base')"
part("art", "SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS html FROM pages WHERE regexp_extract(html, '(?s)<article>(.*)</article>', 1) <> ''")
part("hb_arr", "SELECT page_id, string_split_regex(html, '<[^>]+?>') AS texts, regexp_extract_all(html, '<[^>]+?>') AS tags FROM art")
part("hb_units", f"""
SELECT * FROM (
  SELECT page_id, 2*(i-1) AS unit_at, texts[i] AS piece, FALSE AS is_tag, '' AS name FROM hb_arr, LATERAL unnest(generate_series(1, len(texts))) AS u(i)
  UNION ALL
  SELECT page_id, 2*(i-1)+1, tags[i], TRUE, lower(regexp_extract(tags[i], '^<\\s*/?\\s*([a-zA-Z0-9:-]+)', 1)) FROM hb_arr, LATERAL unnest(generate_series(1, len(tags))) AS u(i))
WHERE piece <> ''
""")
ATTRS = """(?:[^''">]+|"[^"]*"|''[^'']*'')*"""
HIDDEN = rf"<!--.*?(?:-->|\z)|<script(?:[\s/]{ATTRS})?>.*?(?:</script\s*>|\z)|<style(?:[\s/]{ATTRS})?>.*?(?:</style\s*>|\z)|<[!?][^>]*>"
LEX = rf"(?is){HIDDEN}|</?[a-z]{ATTRS}>|</?[a-z][^>]*>"
part("bb_raw", """
SELECT page_id, CASE page_id % 4
  WHEN 0 THEN '<!-- <p>hidden > </p> --><p title="a > b" class=''x>y''>shown <!-- not --> here</p>' || html
  WHEN 1 THEN '<script type="a>b">if (a < b) write("<p>no</p>");</script><p>a < b &amp; c</p><STYLE>p > a {}</STYLE >' || html
  WHEN 2 THEN html || '<!DOCTYPE html><div class="note" data-x="</div>">noted<script>var x = "</div>"</script></div><p>open <!-- to the end <p>lost</p>'
  ELSE html END AS html FROM art
""")
part("bb_lex", f"SELECT page_id, string_split_regex(html, '{LEX}') AS texts, regexp_extract_all(html, '{LEX}') AS tags FROM bb_raw")
part("bb_art", """
SELECT page_id, array_to_string(list_transform(generate_series(1, len(texts)), lambda i: replace(texts[i], '<', '&lt;')
  || coalesce(CASE WHEN regexp_matches(tags[i], '(?i)^<(?:[!?]|(?:script|style)[\\s/>])') THEN '<wbr>' ELSE '<' || translate(tags[i][2:-2], '<>', '  ') || '>' END, '')), '') AS html FROM bb_lex
""")
part("bb_arr", "SELECT page_id, string_split_regex(html, '<[^>]+?>') AS texts, regexp_extract_all(html, '<[^>]+?>') AS tags FROM bb_art")
part("bb_units", PARTS["hb_units"].replace("hb_arr", "bb_arr"))
for _name, _cond in (("hb", "TRUE"), ("bb", "name IN ('p','div','blockquote','li','h1','h2','h3','small','note')")):
    part(f"{_name}_step", f"""
SELECT *, CASE WHEN NOT ({_cond}) OR NOT is_tag OR ends_with(piece, '/>') OR name IN {VOID} THEN 0 WHEN starts_with(piece, '</') THEN -1 ELSE 1 END AS step FROM {_name}_units
""")
    part(f"{_name}_sum", f"SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY unit_at) AS s FROM {_name}_step")
    part(f"{_name}_depth", f"SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY unit_at)) AS depth_after FROM {_name}_sum")
    part(f"{_name}_both", f"SELECT *, coalesce(lag(depth_after) OVER (PARTITION BY page_id ORDER BY unit_at), 0) AS depth_before FROM {_name}_depth")
part("hb_num", """
SELECT *, sum(CASE WHEN depth_before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY unit_at) - 1 AS block_no
FROM hb_both WHERE NOT (depth_before = 0 AND step = -1)
""")
part("hb_out", "SELECT page_id, CAST(block_no AS BIGINT) AS block_no, string_agg(piece, '' ORDER BY unit_at) AS fragment FROM hb_num GROUP BY page_id, block_no")
oracle("html_blocks", "SELECT * FROM hb_out")


def frag_text(c: str) -> str:
    return unescape(
        f"array_to_string(list_filter(list_transform(string_split_regex({c}, '<[^>]+?>'), lambda x: {strip('x')}), lambda x: x <> ''), ' ')")


def frag_type(c: str) -> str:
    inner = f"regexp_replace(regexp_replace({c}, '(?is)^<p[^>]*>', ''), '(?is)</p\\s*>\\s*$', '')"
    name = f"lower(regexp_extract({c}, '^<\\s*/?\\s*([a-zA-Z0-9:-]+)', 1))"
    cls = f"' ' || lower(regexp_extract({c}, '(?is)^<div[^>]*class=\"([^\"]*)\"', 1)) || ' '"
    bare = f"regexp_replace(regexp_replace({inner}, '(?is)<small[^>]*>.*?</small>', '', 'g'), '(?is)<br[^>]*>', '', 'g')"
    return f"""CASE WHEN {name} IN ('h1','h2','h3','small','note','blockquote','li') THEN {name}
      WHEN {name} = 'p' AND contains(lower({inner}), '<small') AND trim(regexp_replace({bare}, '\\s+', ' ', 'g')) = '' THEN 'small'
      WHEN {name} = 'div' AND contains({cls}, ' centered ') THEN 'centered' WHEN {name} = 'div' AND contains({cls}, ' note ') THEN 'note' ELSE 'p' END"""


part("bb_num", """
SELECT *, sum(CASE WHEN depth_before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY unit_at) AS block_no FROM bb_both WHERE depth_before > 0 OR step = 1
""")
part("bb_frag", "SELECT page_id, block_no, string_agg(piece, '' ORDER BY unit_at) AS fragment FROM bb_num GROUP BY 1, 2")
part("bb_text", f"SELECT page_id, block_no, {frag_type('fragment')} AS type, {frag_text('fragment')} AS text FROM bb_frag")
part("bb_out", f"""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block_no) - 1 AS ord, type, text FROM bb_text WHERE text <> ''
UNION ALL SELECT page_id, 0, 'p', {frag_text('html')} FROM bb_art WHERE {frag_text('html')} <> '' AND page_id NOT IN (SELECT page_id FROM bb_text WHERE text <> '')
""")
oracle("html_to_blocks", "SELECT page_id, 'b' || (ord+1) AS block_id, ord, type, text FROM bb_out")
TAG1 = "lower(regexp_extract(trim(fragment), '^<\\s*([a-zA-Z0-9]+)', 1))"
oracle("block_key", f"SELECT page_id, block_no, {TAG1} || '|' || {block_text('fragment')} AS key FROM hb_out")
oracle("noise_blocks", f"""
SELECT page_id, block_no, length(t) <= 6 OR regexp_full_match(t, '[•\\sIVXLCDM/0-9.,\\-]+')
  OR (length(t) - length(translate(t, '•.,/ -', ''))) / greatest(length(t), 1) > 7e-1 AS noise
FROM (SELECT page_id, block_no, {block_text('fragment')} AS t FROM hb_out)""")
oracle("block_type", "SELECT page_id, ord, CASE ord % 5 WHEN 0 THEN 'small' WHEN 1 THEN 'centered' WHEN 2 THEN 'p' WHEN 3 THEN 'note' ELSE type END AS kind FROM fx_blocks")


def block_html(profile: str, p: str = "") -> str:
    t = f"trim({p}text)"
    if profile == "server":
        body, bid, br = esc(t, "&#x27;"), "''", ""
        note = f"CASE WHEN starts_with(lower({t}), 'ilustrace') THEN '<note class=\"illustration\" style=\"{PICTURE}\">' ELSE '<note style=\"{NOTE}\">' END || {body} || '</note>'"
    else:
        body = esc(t) if profile == "diff" else esc(t, "&#39;")
        bid = f"' data-block-id=\"' || {p}block_id || '\"'" if profile == "diff" else "''"
        note = f"'<br><note' || {bid} || ' style=\"{NOTE}\">' || {body} || '</note>'"
    return f"""CASE WHEN {t} <> '' THEN CASE WHEN {p}type IN ('h1','h2','h3') THEN '<' || {p}type || {bid} || '>' || {body} || '</' || {p}type || '>'
      WHEN {p}type = 'small' THEN '<p' || {bid} || '><small>' || {body} || '</small></p>' WHEN {p}type = 'note' THEN {note}
      ELSE '<p' || {bid} || '>' || {body} || '</p>' END END"""


oracle("block_html", f"SELECT page_id, ord, {block_html('server')} AS server, {block_html('diff')} AS diff, {block_html('client')} AS client FROM fx_blocks")
part("ill_all_html", f"""
SELECT page_id, seq, '<note class="illustration" style="{PICTURE}" data-uuid="' || page_id || '" data-bbox="' || box
  || '" data-page-width="1400" data-page-height="4000">Ilustrace: bbox=' || box || ' page=1400x4000</note>' AS html, 'Ilustrace: bbox=' || box || ' page=1400x4000' AS text
FROM (SELECT *, CAST(x AS BIGINT) || ',' || CAST(y AS BIGINT) || ',' || CAST(w AS BIGINT) || ',' || CAST(h AS BIGINT) AS box FROM fx_illustrations)
""")
oracle("block_filter", """
SELECT page_id, ord AS block_no, type = 'small' AS small, type = 'note' AS note, FALSE AS picture FROM fx_blocks
UNION ALL SELECT page_id, seq + 1000000, FALSE, TRUE, TRUE FROM ill_all_html""")
oracle("page_content", f"""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS ord, tag, text, html FROM (
  SELECT page_id, ord AS n, type AS tag, {frag_text(block_html('server'))} AS text, {block_html('server')} AS html FROM fx_blocks WHERE type NOT IN ('small','note')
  UNION ALL SELECT page_id, seq + 1000000, 'note', text, html FROM ill_all_html)""")

# --- page lists --------------------------------------------------------------------------------------
part("tree_walk", """
  SELECT pid AS root_pid, pid, [CAST(0 AS BIGINT)] AS path, FALSE AS is_page, 0 AS depth FROM fx_objects WHERE parent_pid IS NULL
  UNION ALL
  SELECT w.root_pid, o.pid, list_append(w.path, o.ord), coalesce(o.model, 'page') = 'page', w.depth + 1
  FROM tree_walk w JOIN fx_objects o ON o.parent_pid = w.pid WHERE NOT w.is_page AND w.depth <= 4
""")
oracle("collect_pages", "SELECT root_pid, pid, row_number() OVER (PARTITION BY root_pid ORDER BY path) - 1 AS page_index FROM tree_walk WHERE is_page")
oracle("book_of_item", """
SELECT o.pid, CASE WHEN p.parent_pid IS NOT NULL THEN coalesce(CASE WHEN o.model IN ('monographunit','monograph','periodicalitem') THEN o.pid END,
  CASE WHEN p.model IN ('monographunit','monograph','periodicalitem') THEN p.pid END, CASE WHEN o.model = 'page' THEN o.parent_pid ELSE o.pid END)
  ELSE CASE WHEN o.model = 'page' THEN coalesce(o.parent_pid, o.pid) ELSE o.pid END END AS book_pid
FROM fx_objects o LEFT JOIN fx_objects p ON p.pid = o.parent_pid""")
oracle("page_enrich", """
SELECT page_id,
  coalesce(CASE WHEN page_id % 3 = 0 THEN page_number END,
    CASE WHEN page_id % 5 <> 0 THEN coalesce(CASE WHEN page_id % 7 <> 0 THEN page_number END, CASE WHEN page_id % 11 <> 0 THEN title || ' i' END) END,
    page_number, CAST(page_index AS VARCHAR)) AS page_number,
  coalesce(CASE WHEN page_id % 2 = 0 THEN title END, CASE WHEN page_id % 5 <> 0 THEN title || ' i' END, title) AS title,
  page_side
FROM fx_pages""")
oracle("page_pairs", """
SELECT book_id, page_index, page_id AS left_page, nxt AS right_page FROM (
  SELECT *, lead(page_id) OVER w AS nxt, lead(page_index) OVER w AS ni FROM (SELECT * REPLACE (page_index + page_index // 7 AS page_index) FROM fx_pages) WINDOW w AS (PARTITION BY book_id ORDER BY page_index))
WHERE ni = page_index + 1""")
part("sn", f"""
SELECT page_id, ord, tag, text, book_id, page_index, coalesce(CASE WHEN ord % 4 = 1 THEN regexp_replace(html, '^(<[^>]+>)([^<\\s]+) ', '\\1<i class=''w''>\\2</i> ') ELSE html END, {esc('text', '&#x27;')}) AS html
FROM (SELECT b.page_id, b.ord, b.type AS tag, b.text, p.book_id, p.page_index, {block_html('server', 'b.')} AS html FROM fx_blocks b JOIN fx_pages p USING (page_id))
""")
part("sn_edge", """
SELECT book_id, page_index, min_by(struct_pack(ord, tag, text, html), ord) FILTER (WHERE tag <> 'note') AS head,
  max_by(struct_pack(ord, tag, text, html), ord) FILTER (WHERE tag <> 'note') AS tail, max(ord) AS last_ord,
  count(*) FILTER (WHERE tag <> 'note') AS bodies, count(*) AS n FROM sn GROUP BY 1, 2
""")
part("sn_pair", """
SELECT l.book_id, l.page_index, l.tail, r.head, l.bodies AS left_bodies, l.last_ord, r.n AS right_n FROM sn_edge l JOIN sn_edge r
  ON l.book_id = r.book_id AND r.page_index = l.page_index + 1 WHERE l.tail IS NOT NULL AND r.head IS NOT NULL
""")


def decision(end: str, start: str) -> str:
    return f"""CASE WHEN tail.tag <> head.tag THEN 'split' WHEN trim(tail.text) = '' OR trim(head.text) = '' THEN 'split'
      WHEN regexp_matches(trim(tail.text), '{end}') AND regexp_matches(trim(head.text), '{start}') THEN 'split'
      WHEN regexp_matches(trim(tail.text), '[-–—‑‒−‐]$') THEN 'merge' ELSE 'join' END"""


QUOTES = "[\"''„“”«»‚‘’‹›)\\]\\s]*$"
OPENERS = "^[\\s\"''„“”«»‚‘’‹›(\\[{\\-—–]*"
SERVER = decision("[.!?…]" + QUOTES, OPENERS + "[A-ZÀ-Ž]")
CLIENT = decision("[.!?…:]" + QUOTES, OPENERS + "[A-ZÀ-Ÿ]")
oracle("join_decide", f"SELECT book_id, page_index, {SERVER} AS server, {CLIENT} AS client FROM sn_pair")
part("jn_e", f"SELECT *, {SERVER} IN ('join','merge') AS e FROM sn_pair")
part("jn_start", """
SELECT *, CASE WHEN NOT (left_bodies = 1 AND e AND coalesce(lag(e) OVER w AND lag(page_index) OVER w = page_index - 1, FALSE)) THEN page_index END AS st
FROM jn_e WINDOW w AS (PARTITION BY book_id ORDER BY page_index)
""")
part("jn_m", """
SELECT * FROM (SELECT *, max(st) OVER (PARTITION BY book_id ORDER BY page_index) AS run FROM jn_start) WHERE e AND (page_index - run) % 2 = 0
""")
part("jn_put", """
SELECT book_id, page_index, last_ord AS ord, tail.tag AS tag, CASE WHEN a = '' THEN b WHEN b = '' THEN a
   WHEN regexp_matches(a, '[-–—‑‒−‐]$') THEN rtrim(regexp_replace(a, '[-–—‑‒−‐]+$', '')) || b
   WHEN regexp_matches(b, '^[,.;:!?)]') THEN a || b ELSE a || ' ' || b END AS text, coalesce(nullif(regexp_extract(tail.html, '^<[^>]+>'), ''), nullif(regexp_extract(head.html, '^<[^>]+>'), ''), '<' || tail.tag || '>') AS opens
FROM (SELECT *, trim(tail.text) AS a, trim(head.text) AS b FROM jn_m)
""")
part("jn_take", "SELECT book_id, page_index + 1 AS page_index, head.ord AS ord, right_n = 1 AS emptied FROM jn_m")
part("jn_out", f"""
SELECT s.book_id, s.page_index, s.ord, CASE WHEN p.tag IS NOT NULL THEN p.tag WHEN t.ord IS NOT NULL THEN 'p' ELSE s.tag END AS tag,
  CASE WHEN p.tag IS NOT NULL THEN p.text WHEN t.ord IS NOT NULL THEN '' ELSE s.text END AS text,
  CASE WHEN p.tag IS NOT NULL THEN opens || {esc('p.text', '&#x27;')} || '</' || regexp_extract(opens, '^<([a-zA-Z0-9:-]+)', 1) || '>' WHEN t.ord IS NOT NULL THEN '' ELSE s.html END AS html
FROM sn s LEFT JOIN jn_put p USING (book_id, page_index, ord) LEFT JOIN jn_take t USING (book_id, page_index, ord) WHERE t.ord IS NULL OR t.emptied
""")
oracle("join_apply", "SELECT * FROM jn_out")
part("st_rank", """
SELECT *, CASE WHEN tag = 'p' THEN 0 WHEN tag = 'div' THEN 1 WHEN tag = 'blockquote' THEN 2 WHEN tag = 'li' THEN 3 WHEN tag IN ('h1','h2','h3') THEN 4 END AS rk FROM sn
""")
part("st_ends", """
SELECT book_id, page_index, min_by(text, rk * 1000000 + ord) AS first_text,
  coalesce(max_by(text, ord) FILTER (WHERE rk = 0), max_by(text, rk * 1000000 + ord)) AS last_text FROM st_rank WHERE rk IS NOT NULL GROUP BY 1, 2
""")
oracle("stitch_context", """
SELECT e.book_id, e.page_index, e.first_text, e.last_text, b.last_text AS previous_last, a.first_text AS next_first FROM st_ends e
LEFT JOIN st_ends b ON b.book_id = e.book_id AND b.page_index = e.page_index - 1 LEFT JOIN st_ends a ON a.book_id = e.book_id AND a.page_index = e.page_index + 1""")
part("pg", "SELECT *, lower(replace(trim(trim(trim(page_number), '[](){}')),' ','')) AS label, count(*) OVER (PARTITION BY book_id) AS total FROM fx_pages")
part("rq", """
SELECT book_id || ':' || k AS request_id, book_id, part, lt, rt FROM (SELECT DISTINCT book_id FROM fx_pages),
 (VALUES ('c', 0, '5', '9'), ('c', 1, '14', NULL), ('c', 2, 'xiv', '[20]'), ('c', 3, '30', '24'), ('d', 0, '7', NULL), ('d', 1, '7', NULL), ('d', 2, '', '6'), ('d', 3, 'foo', NULL)) v(k, part, lt, rt)
""")
part("rq_start", """
SELECT r.*, CASE WHEN lt = '' THEN 0 ELSE coalesce((SELECT min(page_index) FROM pg WHERE pg.book_id = r.book_id AND pg.label = trim(r.lt, '[]')),
   (SELECT max(TRY_CAST(r.lt AS BIGINT) - 1 + 0 * pg.total) FROM pg WHERE pg.book_id = r.book_id AND TRY_CAST(r.lt AS BIGINT) BETWEEN 1 AND pg.total)) END AS a FROM rq r
""")
part("rq_end", """
SELECT r.*, CASE WHEN rt IS NULL THEN a ELSE coalesce(
   (SELECT min(page_index) FROM pg WHERE pg.book_id = r.book_id AND pg.label = trim(r.rt, '[]') AND pg.page_index >= r.a),
   (SELECT max(page_index) FROM pg WHERE pg.book_id = r.book_id AND pg.label = trim(r.rt, '[]')),
   (SELECT max(TRY_CAST(r.rt AS BIGINT) - 1 + 0 * pg.total) FROM pg WHERE pg.book_id = r.book_id AND TRY_CAST(r.rt AS BIGINT) BETWEEN 1 AND pg.total)) END AS z FROM rq_start r
""")
part("rq_bad", "SELECT DISTINCT request_id FROM rq_end WHERE a IS NULL OR z IS NULL UNION SELECT DISTINCT book_id || ':e' FROM fx_pages")
oracle("select_pages", """
SELECT e.request_id, CAST(min(e.part) AS BIGINT) AS part, p.page_index, p.page_id FROM rq_end e JOIN fx_pages p ON p.book_id = e.book_id
  AND p.page_index BETWEEN least(a, z) AND greatest(a, z) WHERE e.request_id NOT IN (SELECT request_id FROM rq_bad) GROUP BY e.request_id, p.page_index, p.page_id
UNION ALL SELECT book_id || ':a', 0, page_index, page_id FROM fx_pages
UNION ALL SELECT book_id || ':b', 0, page_index, page_id FROM fx_pages QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY page_id DESC) = 1
UNION ALL SELECT request_id, -1, -1, NULL FROM rq_bad""")
oracle("cover_page", """
SELECT book_id, page_id AS cover_page FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY
  CASE WHEN lower(page_type) IN ('frontcover','titlepage','frontjacket','cover','frontendsheet') THEN 0 ELSE 1 END, page_index) AS r
  FROM fx_pages) WHERE r = 1""")
oracle("locate_page", """
SELECT 'p' || (a.page_id * 2) AS item_key, a.book_id, b.page_index, b.page_id FROM fx_pages a LEFT JOIN fx_pages b ON b.book_id = a.book_id AND b.page_id = a.page_id * 2
UNION ALL SELECT book_id, book_id, min(page_index), min_by(page_id, page_index) FROM fx_pages GROUP BY book_id""")
oracle("pick_version", """
SELECT doc_id AS page_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 THEN 'Fixed: ' || text WHEN doc_id % 13 <> 0 THEN lower(text) END AS html,
  CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 THEN 'cached' WHEN doc_id % 13 <> 0 THEN 'computed' END AS origin FROM documents""")
oracle("navigation", """
SELECT book_id, page_id, lag(page_id) OVER w AS prev_page, lead(page_id) OVER w AS next_page, lag(page_id) OVER w IS NOT NULL AS has_prev,
  lead(page_id) OVER w IS NOT NULL AS has_next, count(*) OVER (PARTITION BY book_id) AS total
FROM (SELECT * REPLACE (page_index + page_index // 5 AS page_index) FROM fx_pages) WINDOW w AS (PARTITION BY book_id ORDER BY page_index)""")
oracle("ordered_distinct", """
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
oracle("label_lists", """
SELECT doc_id, string_agg(w, '; ' ORDER BY p) AS labels FROM (
  SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, trim(a[p]) AS w, p FROM (SELECT doc_id, string_split(regexp_replace(text,'[ \\t\\n\\r]+',' ','g'),' ') AS a FROM documents),
    LATERAL unnest(generate_series(1, len(a))) AS u(p)) WHERE w <> '' GROUP BY doc_id, w) GROUP BY doc_id
UNION ALL SELECT doc_id, NULL FROM documents WHERE trim(regexp_replace(text,'[ \\t\\n\\r]+',' ','g')) = ''""")
oracle("fetch_stats", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM events")

# --- reading and search ----------------------------------------------------------------------------
oracle("full_text", f"SELECT page_id, coalesce(string_agg({resolve()}, ' ' ORDER BY token_seq) FILTER (WHERE {resolve()} <> ''), '') AS text FROM fx_tokens GROUP BY page_id")
part("rb_line", f"""
SELECT l.*, trim(coalesce(t.txt, '')) AS txt FROM fx_lines l JOIN (SELECT page_id, block_seq, line_seq,
  string_agg({resolve()}, ' ' ORDER BY token_seq) FILTER (WHERE {resolve()} <> '') AS txt FROM fx_tokens GROUP BY 1, 2, 3) t USING (page_id, block_seq, line_seq) WHERE l.width >= 50
""")
part("rb_cut", """
SELECT *, CASE WHEN lag(bottom) OVER w > 0 AND vpos - lag(bottom) OVER w > 50 THEN 1 ELSE 0 END AS c FROM rb_line WINDOW w AS (PARTITION BY page_id ORDER BY block_seq, line_seq)
""")
part("rb_no", "SELECT *, sum(c) OVER (PARTITION BY page_id ORDER BY block_seq, line_seq) AS no FROM rb_cut")
oracle("reading_blocks", """
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY no) - 1 AS block_no, h_min, v_min, h_max, v_max, text FROM (
  SELECT page_id, no, min_by(hpos, line_seq) AS h_min, min_by(vpos, line_seq) AS v_min, max(hpos + width) AS h_max, max(bottom) AS v_max,
    string_agg(txt, chr(10) ORDER BY line_seq) || chr(10) AS text FROM rb_no WHERE txt <> '' GROUP BY page_id, no)""")
part("v1_line", f"""
SELECT l.*, t.txt, t.bold FROM fx_lines l JOIN (SELECT page_id, block_seq, line_seq,
  coalesce(string_agg({resolve()} || ' ', '' ORDER BY token_seq) FILTER (WHERE subs_type IS NULL OR subs_type <> 'HypPart2'), '') AS txt,
  bool_and(contains(style, 'bold')) AS bold FROM fx_tokens GROUP BY 1, 2, 3) t USING (page_id, block_seq, line_seq) WHERE l.width >= 50
""")
part("v1_cut", """
SELECT *, CASE WHEN (lag(bottom) OVER w > 0 AND vpos - lag(bottom) OVER w > 40) OR (lag(hpos) OVER w > 0 AND hpos - lag(hpos) OVER w > 40) THEN 1 ELSE 0 END AS c
FROM v1_line WINDOW w AS (PARTITION BY page_id, block_seq ORDER BY line_seq)
""")
part("v1_seg", "SELECT *, sum(c) OVER (PARTITION BY page_id, block_seq ORDER BY line_seq) AS seg FROM v1_cut")
part("v1_h3", """
SELECT *, bool_and(bold AND txt <> '') OVER s AS h3, row_number() OVER s AS n FROM v1_seg WINDOW s AS (PARTITION BY page_id, block_seq, seg ORDER BY line_seq)
""")
part("v1_block", """
SELECT page_id, block_seq, min(line_seq) AS line_at, CASE WHEN h3 THEN 'h3' WHEN max(font_size) > 18 THEN 'h1' WHEN max(font_size) > 11 THEN 'h2' ELSE 'p' END AS tag,
  string_agg(txt, '' ORDER BY line_seq) AS text FROM v1_h3 GROUP BY page_id, block_seq, seg, h3, CASE WHEN h3 THEN n ELSE 0 END
""")
oracle("page_html_v1", "SELECT page_id, string_agg('<' || tag || '>' || text || '</' || tag || '>', '' ORDER BY block_seq, line_at) AS html FROM v1_block WHERE text <> '' GROUP BY page_id")
part("qw", """
SELECT item_id AS query_id, i - 1 AS word_no, translate(lower(a[i]), '-?!»«;)(.„",', '') AS word
FROM (SELECT item_id, regexp_split_to_array(trim(replace(split_part(text, '~', 1), '"', '')), '\\s+') AS a FROM benchmark),
  LATERAL unnest(generate_series(1, len(a))) AS u(i)
""")
oracle("word_boxes", """
SELECT query_id, q.word_no, t.page_id, t.block_seq, t.line_seq, t.token_seq, t.hpos * 5e-1 AS x0, -(t.vpos * 25e-2) AS y0,
  t.hpos * 5e-1 + t.width * 5e-1 AS x1, -(t.vpos * 25e-2) - t.height * 25e-2 AS y1
FROM (SELECT *, unnest(list_distinct([translate(lower(content), '-?!»«;)(.„",', ''), translate(lower(subs_content), '-?!»«;)(.„",', '')])) AS word,
    page_id % (SELECT count(*) FROM benchmark) AS query_id FROM fx_tokens) t
JOIN qw q USING (query_id, word) WHERE word <> ''""")
oracle("text_in_box", f"""
SELECT l.page_id, b.box_id, coalesce(string_agg({resolve('t.')}, ' ' ORDER BY t.token_seq) FILTER (WHERE {resolve('t.')} <> '' AND t.hpos >= x0 AND t.hpos + t.width <= x1
   AND t.vpos >= y0 AND t.vpos + t.height <= y1), '') AS text
FROM fx_lines l JOIN (VALUES (CAST(0 AS BIGINT), 0, 0, 1400, 700), (1, 160, 300, 5000, 2000)) b(box_id, x0, y0, x1, y1)
  ON l.hpos >= x0 AND l.hpos + l.width <= x1 AND l.vpos >= y0 AND l.bottom <= y1
JOIN fx_tokens t USING (page_id, block_seq, line_seq) GROUP BY l.page_id, b.box_id""")

# --- corrections and differences -------------------------------------------------------------------
part("ch_bad", "SELECT * FROM fx_changes UNION ALL SELECT page_id, ord + 100000, ' ', text FROM fx_blocks WHERE page_id % 97 = 5")


def applied(name: str, changes: str) -> None:
    part(name + "_id", f"""
SELECT page_id, block_id, max(bad) AS bad, max_by(text, ord) FILTER (WHERE trim(text) <> '') AS new_text, bool_or(trim(text) = '') AS blank, min(ord) AS first_ord
FROM (SELECT *, max(trim(block_id) = '') OVER (PARTITION BY page_id) AS bad FROM {changes}) GROUP BY 1, 2
""")
    part(name + "_all", f"""
SELECT coalesce(b.page_id, c.page_id) AS page_id, coalesce(b.block_id, c.block_id) AS block_id, b.ord, b.type, b.text, c.new_text, coalesce(c.blank, FALSE) AS blank, c.first_ord,
  coalesce(max(c.bad) OVER (PARTITION BY coalesce(b.page_id, c.page_id)), FALSE) AS bad
FROM fx_blocks b FULL JOIN {name}_id c ON b.page_id = c.page_id AND b.block_id = c.block_id
""")
    part(name, f"""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord IS NULL, coalesce(ord, first_ord)) - 1 AS ord, block_id, coalesce(type, 'p') AS type,
  CASE WHEN NOT bad AND (ord IS NULL OR type <> 'note') AND new_text IS NOT NULL THEN new_text ELSE coalesce(text, '') END AS text,
  CASE WHEN bad THEN 'invalid id' END AS error
FROM {name}_all WHERE NOT (ord IS NULL AND bad) AND NOT (NOT bad AND (ord IS NULL OR type <> 'note') AND blank)
""")


applied("ap_bad", "ch_bad")
applied("ap_ok", "fx_changes")
oracle("apply_changes", "SELECT * FROM ap_bad")
oracle("doc_payload", """
SELECT page_id, '{"language_hint":"cs","blocks":[' || string_agg('{"id":' || to_json(block_id) || ',"type":' || to_json(type) || ',"text":' || to_json(text) || '}', ',' ORDER BY ord) || ']}' AS document,
  string_agg(trim(text), chr(10) ORDER BY ord) FILTER (WHERE type <> 'note' AND trim(text) <> '') AS plain,
  CASE WHEN count(*) FILTER (WHERE type <> 'note' AND trim(text) <> '') = 0 THEN 'empty' END AS error
FROM fx_blocks GROUP BY page_id""")
part("dd_l", f"SELECT page_id, block_id, ord, {block_html('diff')} AS html FROM fx_blocks WHERE trim(text) <> ''")
part("dd_r", f"SELECT page_id, block_id, ord, {block_html('diff')} AS html FROM ap_ok WHERE trim(text) <> ''")
part("dd", """
SELECT coalesce(l.page_id, r.page_id) AS page_id, coalesce(l.block_id, r.block_id) AS block_id, l.ord AS left_ord, r.ord AS right_ord, l.html AS left_html, r.html AS right_html,
  CASE WHEN r.html IS NULL THEN 'removed' WHEN l.html IS NULL THEN 'added' WHEN l.html = r.html THEN 'equal' ELSE 'changed' END AS change
FROM dd_l l FULL JOIN dd_r r ON l.page_id = r.page_id AND l.block_id = r.block_id
""")
oracle("doc_diff", "SELECT * FROM dd")
oracle("diff_summary", """
SELECT page_id, count(*) FILTER (WHERE change = 'equal') AS equal, count(*) FILTER (WHERE change = 'changed') AS changed, count(*) FILTER (WHERE change = 'removed') AS removed,
  count(*) FILTER (WHERE change = 'added') AS added, bool_or(change <> 'equal') AS has_changes FROM dd GROUP BY 1""")
oracle("block_sets", """
SELECT page_id, block_id, html, 'unchanged' AS change FROM (SELECT page_id, block_id, html FROM dd_l INTERSECT SELECT page_id, block_id, html FROM dd_r)
UNION ALL SELECT *, 'removed' FROM (SELECT page_id, block_id, html FROM dd_l EXCEPT SELECT page_id, block_id, html FROM dd_r)
UNION ALL SELECT *, 'added' FROM (SELECT page_id, block_id, html FROM dd_r EXCEPT SELECT page_id, block_id, html FROM dd_l)""")
WORD = "<[^>]+?>|\\s+|[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_<]+|<"
part("rw", """
SELECT * REPLACE (CASE WHEN page_id % 3 = 0 THEN regexp_replace(right_html, '^(<[^>]+>)([^\\s<]+) ([^<]+)', '\\1\\3 \\2') ELSE right_html END AS right_html) FROM dd WHERE change = 'changed'
""")
for _s in ("left", "right"):
    part(f"tk_{_s}", f"""
SELECT page_id, block_id, i - 1 AS tok_seq, a[i] AS value, CASE WHEN regexp_matches(a[i], '^<[^>]+>$') THEN 'tag' ELSE 'text' END AS kind,
  regexp_full_match(a[i], '\\s+') AS is_ws, n_chars FROM (SELECT page_id, block_id,
   regexp_extract_all(regexp_replace({_s}_html, '>\\s+<', '><', 'g'), '{WORD}') AS a,
   len(regexp_extract_all(regexp_replace({_s}_html, '>\\s+<', '><', 'g'), '(?s)<[^>]+?>|.')) AS n_chars FROM rw),
   LATERAL unnest(generate_series(1, len(a))) AS u(i)
""")
    part(f"ts_{_s}", f"SELECT page_id, block_id, tok_seq AS i, value AS v FROM tk_{_s}")
oracle("diff_tokens", "SELECT page_id, block_id, tok_seq, value, kind, is_ws, n_chars FROM tk_left")


def matching(p: str, left: str, right: str, keys: str) -> None:
    """Parts ``p``_size (keys, n, m) and ``p``_hit (keys, i, j, n): the longest run of equal elements first, then both sides of it.

    ``left`` and ``right`` have the keys, i (from 0) and v.
    """
    part(f"{p}_pair", f"SELECT {keys}, l.i AS i, r.i AS j FROM {left} l JOIN (SELECT * FROM {right}) r USING ({keys}, v)")
    part(f"{p}_run", f"""
SELECT {keys}, min(i) AS i, min(j) AS j, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY {keys}, i - j ORDER BY i) AS g FROM {p}_pair) GROUP BY {keys}, i - j, g
""")
    part(f"{p}_size", f"""
SELECT {keys}, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM (SELECT {keys}, count(*) AS n FROM {left} GROUP BY ALL) FULL JOIN (SELECT {keys}, count(*) AS m FROM {right} GROUP BY ALL) USING ({keys})
""")
    part(f"{p}_rec", f"""
SELECT {keys}, CAST(0 AS BIGINT) AS alo, n AS ahi, CAST(0 AS BIGINT) AS blo, m AS bhi, false AS hit FROM {p}_size WHERE n > 0 AND m > 0
UNION ALL
SELECT {keys}, u.alo, u.ahi, u.blo, u.bhi, u.hit FROM (
  SELECT {keys}, alo, ahi, blo, bhi, -b[2] AS i, -b[3] AS j, b[1] AS n FROM (
    SELECT {keys}, alo, ahi, blo, bhi, max([least(n - s, ahi - i - s, bhi - j - s), -i - s, -j - s]) AS b
    FROM (SELECT g.*, r.i, r.j, r.n, greatest(0, g.alo - r.i, g.blo - r.j) AS s FROM {p}_rec g JOIN {p}_run r USING ({keys}) WHERE NOT g.hit)
    WHERE least(n - s, ahi - i - s, bhi - j - s) > 0 GROUP BY ALL)),
  LATERAL unnest([{{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': j, 'hit': false}}, {{'alo': i, 'ahi': i + n, 'blo': j, 'bhi': j + n, 'hit': true}},
                  {{'alo': i + n, 'ahi': ahi, 'blo': j + n, 'bhi': bhi, 'hit': false}}]) AS t(u)
WHERE u.hit OR (u.alo < u.ahi AND u.blo < u.bhi)
""")
    part(f"{p}_hit", f"SELECT {keys}, alo AS i, blo AS j, ahi - alo AS n FROM {p}_rec WHERE hit")


matching("tm", "ts_left", "ts_right", "page_id, block_id")
part("tm_each", "SELECT page_id, block_id, i + k AS i, j + k AS j FROM tm_hit, LATERAL unnest(generate_series(0, n - 1)) AS u(k)")
part("td_all", """
SELECT l.page_id, l.block_id, value, kind, is_ws, tok_seq AS left_seq, j AS right_seq, CASE WHEN j IS NULL THEN 'removed' ELSE 'equal' END AS change, CASE WHEN j IS NULL THEN 0 ELSE 2 END AS kind_no,
  coalesce(count(j) OVER (PARTITION BY l.page_id, l.block_id ORDER BY tok_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after
FROM tk_left l LEFT JOIN tm_each e ON e.page_id = l.page_id AND e.block_id = l.block_id AND e.i = l.tok_seq
UNION ALL SELECT * FROM (
  SELECT r.page_id, r.block_id, value, kind, is_ws, CASE WHEN i IS NOT NULL THEN -1 END AS left_seq, tok_seq, 'added', 1,
    coalesce(count(i) OVER (PARTITION BY r.page_id, r.block_id ORDER BY tok_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  FROM tk_right r LEFT JOIN tm_each e ON e.page_id = r.page_id AND e.block_id = r.block_id AND e.j = r.tok_seq) WHERE left_seq IS NULL
""")
part("td", """
SELECT page_id, block_id, row_number() OVER (PARTITION BY page_id, block_id ORDER BY after, kind_no, coalesce(left_seq, right_seq)) - 1 AS ord, value, kind, is_ws, left_seq, right_seq, change FROM td_all
""")
oracle("token_diff", "SELECT * FROM td")
CLS = "diff-block diff-block--changed"
part("dm", """
SELECT page_id, block_id,
  string_agg(CASE WHEN kind = 'tag' OR is_ws OR change = 'equal' THEN value ELSE '<span class="diff-removed">' || value || '</span>' END, '' ORDER BY left_seq) FILTER (WHERE left_seq IS NOT NULL) AS l,
  string_agg(CASE WHEN kind = 'tag' OR is_ws OR change = 'equal' THEN value ELSE '<span class="diff-added">' || value || '</span>' END, '' ORDER BY right_seq) FILTER (WHERE right_seq IS NOT NULL) AS r,
  bool_or(change <> 'equal') AS c
FROM td GROUP BY 1, 2
""")
oracle("diff_markup", f"""
SELECT page_id, block_id, CASE WHEN c THEN regexp_replace(l, '^((?:<br>)?<[a-z0-9]+[^>]*)>', '\\1 class="{CLS}">') ELSE l END AS left_markup,
  CASE WHEN c THEN regexp_replace(r, '^((?:<br>)?<[a-z0-9]+[^>]*)>', '\\1 class="{CLS}">') ELSE r END AS right_markup FROM dm""")
# alignment without ids
for _s, _t, _rest in (("l", "fx_blocks", 1), ("r", "ap_ok", 0)):
    part(f"al_{_s}", f"""
SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord, html) - 1 AS i, html AS v, {block_text('html')} AS txt
FROM (SELECT page_id, ord + CASE WHEN page_id % 3 = {_rest} THEN 3 + page_id % 8 ELSE 0 END AS ord, {block_html('client')} AS html FROM {_t}
    UNION ALL SELECT doc_id, k, '<p>Inserted paragraph ' || k || ' of page ' || doc_id || ' with words number ' || (k * 7) || '</p>'
    FROM documents, LATERAL unnest(generate_series(0, 2 + doc_id % 8)) AS u(k) WHERE doc_id % 3 = {_rest}) WHERE html IS NOT NULL
""")
def noise(t: str) -> str:
    return (f"(length({t}) <= 6 OR regexp_full_match({t}, '[•\\sIVXLCDM/0-9.,\\-]+') OR "
            f"(length({t}) - length(translate({t}, '•.,/ -', ''))) / greatest(length({t}), 1) > 7e-1)")


def shingle_list(t: str) -> str:
    w = f"string_split({t}, ' ')"
    return f"CASE WHEN len({w}) < 3 THEN [{t}] ELSE list_distinct(list_transform(generate_series(1, len({w}) - 2), lambda q: array_to_string({w}[q:q+2], ' '))) END"


matching("am", "al_l", "al_r", "page_id")
part("al_gap", """
SELECT * FROM (
  SELECT page_id, lag(i + n, 1, 0) OVER w AS alo, i AS ahi, lag(j + n, 1, 0) OVER w AS blo, j AS bhi
  FROM (SELECT page_id, i, j, n FROM am_hit UNION ALL SELECT page_id, n, m, 0 FROM am_size) WINDOW w AS (PARTITION BY page_id ORDER BY i, j, n DESC))
WHERE alo < ahi OR blo < bhi
""")
for _s in ("l", "r"):
    part(f"al_sh{_s}", f"""
SELECT page_id, i, noise, length(txt) AS len, {shingle_list('txt')} AS one, {shingle_list('two')} AS two
FROM (SELECT page_id, i, txt, {noise('txt')} AS noise, trim(txt || ' ' || lead(txt) OVER (PARTITION BY page_id ORDER BY i)) AS two FROM al_{_s})
""")
part("al_score", """
SELECT g.page_id, l.i, r.i AS j, l.len <= r.len AS shorter, l.noise AS ln, r.noise AS rn, """ + ", ".join(
    f"CASE WHEN {c} THEN coalesce(len(list_intersect(l.{a}, r.{b})) / (len(l.{a}) + len(r.{b}) - len(list_intersect(l.{a}, r.{b}))), 0) ELSE 0 END AS {n}"
    for n, a, b, c in (("s11", "one", "one", "true"), ("s12", "one", "two", "r.i + 1 < bhi"), ("s21", "two", "one", "l.i + 1 < ahi"), ("s22", "two", "two", "l.i + 1 < ahi AND r.i + 1 < bhi"))) + """
FROM al_gap g JOIN al_shl l ON l.page_id = g.page_id AND l.i >= alo AND l.i < ahi JOIN al_shr r ON r.page_id = g.page_id AND r.i >= blo AND r.i < bhi
""")
part("al_way", """
SELECT page_id, i, j, best AS s, CASE WHEN ln THEN [1, 0] WHEN rn THEN [0, 1]
  WHEN best >= 5e-1 THEN CASE best WHEN s11 THEN [1, 1] WHEN s12 THEN [1, 2] WHEN s21 THEN [2, 1] ELSE [2, 2] END
  WHEN greatest(s11, s12) < greatest(s11, s21) OR (greatest(s11, s12) = greatest(s11, s21) AND shorter) THEN [1, 0] ELSE [0, 1] END AS go
FROM (SELECT *, CASE WHEN s11 >= 5e-1 THEN greatest(s11, s12, s21) ELSE greatest(s11, s12, s21, s22) END AS best FROM al_score)
""")
part("al_walk", """
SELECT page_id, ahi, bhi, alo AS i, blo AS j, CAST(0 AS BIGINT) AS di, CAST(0 AS BIGINT) AS dj, CAST(0 AS DOUBLE) AS s FROM al_gap
UNION ALL
SELECT w.page_id, w.ahi, w.bhi, w.i + go[1], w.j + go[2], go[1], go[2], CASE WHEN go[1] * go[2] > 0 THEN x ELSE 0 END FROM (
  SELECT w.*, a.s AS x, CASE WHEN w.i >= w.ahi THEN [0, 1] WHEN w.j >= w.bhi THEN [1, 0] ELSE a.go END AS go
  FROM al_walk w LEFT JOIN al_way a ON a.page_id = w.page_id AND a.i = w.i AND a.j = w.j WHERE w.i < w.ahi OR w.j < w.bhi) w
""")
oracle("align_blocks", """
SELECT h.page_id, l.ord AS left_ord, r.ord AS right_ord, CAST(1 AS BIGINT) AS left_n, CAST(1 AS BIGINT) AS right_n, 1e0 AS similarity, 'equal' AS change
FROM (SELECT page_id, i + k AS i, j + k AS j FROM am_hit, LATERAL unnest(generate_series(0, n - 1)) AS u(k)) h
  JOIN al_l l ON l.page_id = h.page_id AND l.i = h.i JOIN al_r r ON r.page_id = h.page_id AND r.i = h.j
UNION ALL SELECT w.page_id, l.ord, r.ord, di, dj, round_even(s, 6),
  CASE WHEN di > 0 AND dj > 0 THEN 'changed' WHEN di > 0 THEN CASE WHEN x.noise THEN 'noise' ELSE 'removed' END WHEN y.noise THEN 'noise' ELSE 'added' END
FROM al_walk w LEFT JOIN al_l l ON di > 0 AND l.page_id = w.page_id AND l.i = w.i - di LEFT JOIN al_r r ON dj > 0 AND r.page_id = w.page_id AND r.i = w.j - dj
  LEFT JOIN al_shl x ON x.page_id = l.page_id AND x.i = l.i LEFT JOIN al_shr y ON y.page_id = r.page_id AND y.i = r.i WHERE di + dj > 0""")
oracle("response_extract", """
SELECT conv_id * 1000 + turn AS page_id, CASE turn % 6 WHEN 0 THEN trim(text || chr(10) || 'end') WHEN 4 THEN trim(text || chr(10) || 'more') WHEN 5 THEN '' ELSE trim(text) END AS text,
  CASE turn % 6 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' WHEN 4 THEN 'length' END AS stop_reason, CASE WHEN turn % 6 NOT IN (3, 5) THEN length(text) END AS input_tokens,
  CASE WHEN turn % 6 NOT IN (3, 5) THEN turn END AS output_tokens, CASE WHEN turn % 6 NOT IN (3, 5) THEN length(text) + turn END AS total_tokens FROM conversations""")
oracle("join_sections", """
SELECT page_id, unnest(CASE k
  WHEN 0 THEN [{'section': 'start', 'action': 'join', 'text': NULL, 'tag': NULL}, {'section': 'end', 'action': 'join', 'text': NULL, 'tag': NULL}]
  WHEN 1 THEN [{'section': 'start', 'action': 'merge', 'text': trim(text), 'tag': 'h2'}, {'section': 'end', 'action': 'split', 'text': NULL, 'tag': NULL}]
  WHEN 2 THEN [{'section': 'start', 'action': 'join', 'text': NULL, 'tag': NULL}, {'section': 'end', 'action': 'join', 'text': NULL, 'tag': NULL}]
  WHEN 3 THEN [{'section': 'start', 'action': 'join', 'text': text, 'tag': 'p'}, {'section': 'end', 'action': 'split', 'text': 'one two' || chr(10) || chr(10) || 'three', 'tag': NULL}]
  WHEN 4 THEN [{'section': 'start', 'action': 'merge', 'text': NULL, 'tag': NULL}, {'section': 'end', 'action': 'merge', 'text': NULL, 'tag': NULL}]
  WHEN 5 THEN [{'section': 'end', 'action': 'join', 'text': 'both' || chr(10) || 'lines', 'tag': NULL}]
  WHEN 6 THEN [{'section': 'start', 'action': 'join', 'text': trim(text), 'tag': NULL}] END, recursive := true)
FROM (SELECT conv_id * 1000 + turn AS page_id, (conv_id * 1000 + turn + turn) % 8 AS k, text FROM conversations)""")
oracle("correction_validate", """
SELECT page_id, ord, CASE WHEN ord % 13 = 0 THEN 'changes' ELSE CASE (page_id + ord) % 4 WHEN 0 THEN '' WHEN 1 THEN 'keys' WHEN 2 THEN 'id' ELSE 'keys' END END = '' AS ok,
  CASE WHEN ord % 13 = 0 THEN 'changes' ELSE CASE (page_id + ord) % 4 WHEN 0 THEN '' WHEN 1 THEN 'keys' WHEN 2 THEN 'id' ELSE 'keys' END END AS reason FROM fx_blocks""")
oracle("settings_scan", """
SELECT 'agent' || p_partkey AS name, CASE WHEN p_partkey % 9 = 0 THEN 'agent' || p_partkey ELSE p_name END AS display_name,
  CASE WHEN p_partkey % 9 <> 0 THEN 'Fix ' || p_type END AS prompt, CASE WHEN p_partkey % 9 <> 0 THEN 'm' || (p_size % 5) END AS model,
  CASE WHEN p_partkey % 9 <> 0 THEN p_size / 100 END AS temperature, CASE WHEN p_partkey % 9 <> 0 THEN 5e-1 END AS top_p FROM part""")
part("ef", """
SELECT 'agent' || p_partkey AS name, 'm' || (p_size % 5) AS model,
  CASE WHEN p_size % 5 = 4 OR p_size % 5 <> 1 THEN least(2e0, CASE WHEN p_partkey % 10 = 1 THEN 7e-1 WHEN own OR p_partkey % 2 = 0 THEN p_retailprice / 500 ELSE p_size / 100 END) END AS temperature,
  CASE WHEN p_size % 5 = 4 THEN 5e-1 WHEN p_size % 5 <> 2 THEN 9e-1 END AS top_p,
  CASE WHEN p_size % 5 = 3 THEN CASE WHEN own OR p_partkey % 2 = 0 THEN 'high' ELSE 'low' END END AS reasoning_effort,
  CASE WHEN own OR p_partkey % 2 = 0 THEN CAST(least(128000, greatest(1, p_partkey * 300)) AS BIGINT) END AS max_output_tokens
FROM (SELECT *, p_partkey % 3 = 0 AND p_size % 5 = 0 AS own FROM part WHERE p_partkey % 9 <> 0)""")
oracle("effective_settings", "SELECT * FROM ef")
SCOPED = """CASE model WHEN 'm0' THEN 'base-0' WHEN 'm1' THEN 'openai/base-1' WHEN 'm2' THEN ' M2 ' WHEN 'm3' THEN 'base-3' ELSE model END"""
oracle("model_scope", f"SELECT name, model, CASE model WHEN 'm1' THEN 'other' WHEN 'm4' THEN NULL ELSE 'openai' END AS provider, {SCOPED} AS request_model FROM ef")
part("rq_page", """
SELECT page_id, page_id % (SELECT count(*) FROM part) AS agent, '{"language_hint":"cs","blocks":[' || string_agg('{"id":' || to_json(block_id) || ',"type":' || to_json(type) || ',"text":' || to_json(text) || '}', ',' ORDER BY ord) || ']}' AS payload
FROM fx_blocks GROUP BY page_id
""")
oracle("llm_requests", f"""
SELECT page_id, agent, CASE WHEN name IS NOT NULL THEN '{{"model":' || to_json({SCOPED}) || ',"instructions":' || to_json('Fix ' || p_type) || ',"input":' || to_json(payload)
   || coalesce(',"temperature":' || CAST(CAST(temperature AS DOUBLE) AS VARCHAR), '') || coalesce(',"top_p":' || CAST(CAST(top_p AS DOUBLE) AS VARCHAR), '') || coalesce(',"reasoning_effort":"' || reasoning_effort || '"', '')
   || coalesce(',"max_output_tokens":' || max_output_tokens, '') || '}}' END AS request, CASE WHEN name IS NULL THEN 'no_agent' END AS error
FROM rq_page LEFT JOIN (SELECT e.*, p_partkey, p_type FROM ef e JOIN part ON e.name = 'agent' || p_partkey) ON p_partkey = agent""")
part("lr_page", "SELECT DISTINCT page_id FROM fx_changes")
oracle("llm_results", """
SELECT page_id, ord, block_id, type, text FROM ap_ok WHERE page_id % 5 = 0
UNION ALL SELECT page_id, ord, block_id, type, text FROM fx_blocks b WHERE page_id % 5 <> 0 AND (page_id % 5 IN (3, 4) OR page_id NOT IN (SELECT page_id FROM lr_page))
UNION ALL SELECT page_id, 0, 'b1', 'h1', 'New' FROM lr_page WHERE page_id % 5 = 1
UNION ALL SELECT page_id, 1, 'b2', 'p', 'page' FROM lr_page WHERE page_id % 5 = 1
UNION ALL SELECT page_id, 0, 'b1', 'p', 'Plain answer' FROM lr_page WHERE page_id % 5 = 2""")
part("pv_a", f"SELECT page_id, string_agg({block_html('server')}, '' ORDER BY ord) AS html FROM fx_blocks WHERE trim(text) <> '' GROUP BY 1")
part("pv_b", f"SELECT page_id, string_agg({block_html('server')}, '' ORDER BY ord) AS html FROM ap_ok WHERE trim(text) <> '' AND page_id % 3 <> 0 GROUP BY 1")
part("pv_c", f"SELECT page_id, string_agg({block_html('server')}, '' ORDER BY ord) AS html FROM fx_blocks WHERE trim(text) <> '' AND page_id % 4 = 1 AND type <> 'note' GROUP BY 1")
oracle("page_versions", "SELECT * FROM pv_a")
oracle("compare_versions", """
SELECT page_id, a.html AS formatter, b.html AS corrector, c.html AS reader FROM pv_a a FULL JOIN pv_b b USING (page_id) FULL JOIN pv_c c USING (page_id)""")

# --- exports ---------------------------------------------------------------------------------------
ALLOWED = "tag IN ('h1','h2','h3','p','blockquote','small','div','note') AND text <> ''"
oracle("export_txt", f"SELECT book_id, page_index, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text FROM jn_out WHERE {ALLOWED} GROUP BY 1, 2")
oracle("export_md", f"""
SELECT book_id, page_index, string_agg(CASE tag WHEN 'h1' THEN '# ' WHEN 'h2' THEN '## ' WHEN 'h3' THEN '### ' WHEN 'blockquote' THEN '> ' ELSE '' END || text,
  chr(10) || chr(10) ORDER BY ord) AS text FROM jn_out WHERE {ALLOWED} GROUP BY 1, 2""")
oracle("export_html", f"""
SELECT s.book_id, s.page_index + 1 AS part, '<section data-page="' || {esc("coalesce(nullif(p.page_number, ''), 'Strana ' || (s.page_index + 1))", "&#x27;")} || '">' || chr(10) || trim(body) || chr(10) || '</section>' AS html
FROM (SELECT book_id, page_index, string_agg(CASE WHEN text = '' THEN '' ELSE html END, chr(10) ORDER BY ord) AS body FROM jn_out GROUP BY 1, 2) s JOIN fx_pages p USING (book_id, page_index)
UNION ALL SELECT book_id, 0, '<!DOCTYPE html>' || chr(10) || '<html lang="cs">' || chr(10) || '  <head>' || chr(10) || '    <meta charset="utf-8" />' || chr(10) || '    <title>'
  || CASE WHEN book_id <> 'src1' THEN 'Kniha ' || book_id ELSE 'Download' END || '</title>' || chr(10) || '  </head>' || chr(10) || '  <body>' || chr(10) FROM fx_pages GROUP BY book_id
UNION ALL SELECT book_id, max(page_index) + 2, chr(10) || '  </body>' || chr(10) || '</html>' || chr(10) FROM fx_pages GROUP BY book_id""")
part("cp_run", """
SELECT *, sum(CASE WHEN tag IN ('h1','h2','h3') THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY page_index, ord) AS run FROM jn_out WHERE text <> ''
""")
part("cp_no", "SELECT *, CAST(run + CASE WHEN min(run) OVER (PARTITION BY book_id) = 0 THEN 1 ELSE 0 END AS BIGINT) AS chapter_no FROM cp_run")
part("cp_title", "SELECT book_id, chapter_no, text AS title FROM cp_no WHERE tag IN ('h1','h2','h3')")
oracle("chapters", f"""
SELECT book_id, chapter_no, page_index, coalesce(any_value(title), 'Kapitola ' || chapter_no) AS title, 'chap_' || chapter_no || '.xhtml' AS file_name,
  string_agg(html, chr(10) ORDER BY ord) AS html FROM cp_no LEFT JOIN cp_title USING (book_id, chapter_no) GROUP BY book_id, chapter_no, page_index""")
oracle("export_name", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_brand || '.txt' ELSE CASE WHEN p_partkey % 7 <> 0 THEN regexp_replace(trim(p_name), '\\s+', '_', 'g') ELSE 'export' END
  || '-' || lower(p_type) || '.epub' END AS file_name FROM part""")
oracle("illustration_backfill", """
SELECT page_id, seq AS ord, CAST(x AS BIGINT) || ',' || CAST(y AS BIGINT) || ',' || CAST(w AS BIGINT) || ',' || CAST(h AS BIGINT) AS bbox, CAST(7 AS BIGINT) AS page_w, CAST(8 AS BIGINT) AS page_h,
  CAST(NULL AS VARCHAR) AS uuid FROM fx_illustrations WHERE seq = 0
UNION ALL SELECT n.page_id, n.seq, coalesce(CAST(s.x AS BIGINT) || ',' || CAST(s.y AS BIGINT) || ',' || CAST(s.w AS BIGINT) || ',' || CAST(s.h AS BIGINT),
    CAST(n.x AS BIGINT) || ',' || CAST(n.y AS BIGINT) || ',' || CAST(n.w AS BIGINT) || ',' || CAST(n.h AS BIGINT)),
  CASE WHEN s.seq IS NOT NULL THEN 1400 ELSE 11 END, CASE WHEN s.seq IS NOT NULL THEN 4000 ELSE 12 END, 'u' || s.seq
FROM fx_illustrations n LEFT JOIN (SELECT * FROM fx_illustrations WHERE seq < 2) s ON s.page_id = n.page_id AND s.seq = n.seq - 1 WHERE n.seq > 0""")

# --- sources ---------------------------------------------------------------------------------------
oracle("scan_pages", """
SELECT DISTINCT page_id, CAST(1400 AS BIGINT) AS page_w, CAST(4000 AS BIGINT) AS page_h, CAST(1200 AS BIGINT) AS ps_w, CAST(3800 AS BIGINT) AS ps_h, TRUE AS parsed, FALSE AS parse_error FROM fx_tokens""")
oracle("layout_tokens", """
SELECT page_id, block_seq, line_seq % 7 AS line_seq, token_seq - line_seq * 9 AS token_seq, content, subs_content, subs_type, style, hpos, vpos, width, height FROM fx_tokens""")
oracle("styles", "SELECT page_id, style_id, font_size, font_family, font_style, font_weight FROM fx_styles WHERE page_id IN (SELECT page_id FROM fx_tokens)")
oracle("illustrations", "SELECT page_id, seq, x, y, w, h FROM fx_illustrations WHERE page_id IN (SELECT page_id FROM fx_tokens)")
part("mo", """
SELECT p_partkey AS pid, k, label, value FROM part, LATERAL (VALUES
  (0, 'Název', p_name || ' - ' || p_type || CASE WHEN p_partkey % 3 = 0 THEN ' - ' || p_size ELSE '' END),
  (1, 'Autoři', p_brand || ' (18' || p_size || ') [aut]' || CASE WHEN p_partkey % 2 = 0 THEN '; Second Name' ELSE '' END),
  (2, 'Edice', CASE WHEN p_partkey % 5 = 0 THEN '2' END), (3, 'Publikační údaje', 'Praha, ' || p_brand), (4, 'Jazyk', 'cze'),
  (5, 'Identifikátory', 'isbn: ' || p_partkey || '; x' || p_size), (6, 'PageSide', CASE WHEN p_partkey % 2 = 0 THEN 'left' END),
  (7, 'Poznámky', CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'n' || p_size END || ' | two'), (8, 'PageNumber', CAST(p_size AS VARCHAR))) v(k, label, value) WHERE value IS NOT NULL
""")
oracle("mods_entries", "SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY k) - 1 AS ord, label, value FROM mo")
oracle("authors", """
SELECT p_partkey AS pid, CAST(0 AS BIGINT) AS ord, p_brand || ' (18' || p_size || ') [aut]' AS author FROM part
UNION ALL SELECT p_partkey, 1, 'Second Name' FROM part WHERE p_partkey % 2 = 0""")
oracle("manifest_pages", """
SELECT 'uuid:b' || g AS book_id, CASE WHEN o_orderkey % 4 = 0 THEN 'ab' || o_orderkey ELSE 'cd' || o_orderkey END AS page_uuid, page_index,
  CASE WHEN o_orderkey % 3 = 2 THEN '[' || o_orderkey || ']' ELSE CAST(o_orderkey AS VARCHAR) END AS title,
  CASE WHEN o_orderkey % 3 = 2 THEN '[' || o_orderkey || ']' ELSE CAST(o_orderkey AS VARCHAR) END AS page_number
FROM (SELECT o_orderkey, CAST(floor(o_orderkey/100) AS BIGINT) AS g, row_number() OVER (PARTITION BY floor(o_orderkey/100) ORDER BY o_orderkey) - 1 AS page_index FROM orders)
WHERE o_orderkey % 4 IN (0, 1)""")
oracle("objects_scan", """
SELECT 'o' || o_orderkey AS pid, CASE WHEN o_orderkey % 2 = 0 THEN 'page' ELSE 'monograph' END AS model, CASE WHEN o_orderkey % 2 = 0 THEN 'T' || o_orderkey END AS title,
  'c' || o_custkey AS root_pid, 'hasPage' AS context_model, 'k1:page,k2:page,f' || o_custkey || ':unit' AS children FROM orders""")
part("jr", """
SELECT *, sum(CASE WHEN ts < last + INTERVAL 1 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY ts, processed) AS run
FROM (SELECT *, lag(ts) OVER (PARTITION BY job_id ORDER BY ts, processed) AS last FROM fx_job_events)
""")
oracle("job_runs", """
SELECT job_id, done AS processed, total, message, round_even(least(greatest(done * 100e0 / total, 0), 100), 6) AS percent,
  round_even(CASE WHEN done < total THEN (total - done) * (greatest((epoch_us(updated) - epoch_us(started)) / 1000000e0, 1e-3) / done) END, 3) AS eta_seconds
FROM (SELECT job_id, arg_max(processed, [epoch_us(ts), processed]) AS done, arg_max(total, [epoch_us(ts), processed]) AS total, arg_max(message, [epoch_us(ts), processed]) AS message,
  min(ts) AS started, max(ts) AS updated FROM jr GROUP BY job_id, run)""")
oracle("job_progress", """
SELECT job_id, done AS processed, total, message, round_even(least(greatest(done * 100e0 / total, 0), 100), 6) AS percent,
  round_even(CASE WHEN done < total THEN (total - done) * (greatest((epoch_us(updated) - epoch_us(started)) / 1000000e0, 1e-3) / done) END, 3) AS eta_seconds
FROM (SELECT job_id, max(processed) AS done, max_by(total, processed) AS total, max_by(message, processed) AS message, min(ts) AS started, max(ts) AS updated
  FROM fx_job_events GROUP BY job_id)""")

# --- older reading blocks ----------------------------------------------------------------------------
part("rb_lines", """
SELECT page_id, block_seq, line_seq, row_number() OVER w AS ln, coalesce(lag(bottom) OVER w > 0 AND vpos - lag(bottom) OVER w > 50, FALSE) AS pause
FROM fx_lines WHERE width >= 50 WINDOW w AS (PARTITION BY page_id ORDER BY block_seq, line_seq)
""")
part("rb_tokens", """
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ln, token_seq) AS rn, coalesce(content, '') AS c, hpos AS x, t.vpos AS y, hpos + width AS x2, CAST(t.vpos + t.height AS BIGINT) AS y2,
  row_number() OVER (PARTITION BY page_id, ln ORDER BY token_seq) = 1 AS opens, pause FROM fx_tokens t JOIN rb_lines USING (page_id, block_seq, line_seq)
""")
part("rb_walk", """
SELECT page_id, rn - 1 AS rn, '' AS text, 0 AS lines, CAST(0 AS BIGINT) AS h1, CAST(0 AS BIGINT) AS v1, CAST(0 AS BIGINT) AS h2, CAST(0 AS BIGINT) AS v2, '' AS said, false AS shut,
  CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c2, CAST(0 AS BIGINT) AS d FROM rb_tokens WHERE rn = 1
UNION ALL
SELECT page_id, rn, CASE WHEN shut THEN '' ELSE said || ' ' END, CASE WHEN shut THEN 0 ELSE n END, CASE WHEN shut THEN 0 ELSE a END, CASE WHEN shut THEN 0 ELSE b END,
  CASE WHEN shut THEN 0 ELSE c2 END, CASE WHEN shut THEN 0 ELSE d END, said, shut, a, b, c2, d FROM (
  SELECT *, n >= 3 AND length(said) > 120 AND (ends_with(c, '.') OR ends_with(c, ';')) AS shut FROM (
    SELECT t.page_id, t.rn, t.c, CASE WHEN opens AND pause AND text <> '' THEN text || '. -- -- ' ELSE text END || t.c AS said, lines + CAST(opens AS INTEGER) AS n,
      CASE WHEN h1 = 0 OR h1 > x THEN x ELSE h1 END AS a, CASE WHEN v1 = 0 OR v1 > y THEN y ELSE v1 END AS b, CASE WHEN h2 = 0 OR h2 < x2 THEN x2 ELSE h2 END AS c2, CASE WHEN v2 = 0 OR v2 < y2 THEN y2 ELSE v2 END AS d
    FROM rb_walk w JOIN rb_tokens t ON t.page_id = w.page_id AND t.rn = w.rn + 1))
""")
oracle("reading_blocks_v1", """
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY rn) - 1 AS block_no, CASE WHEN shut THEN said ELSE text END AS text, a AS h_min, b AS v_min, c2 AS h_max, d AS v_max
FROM (SELECT *, max(rn) OVER (PARTITION BY page_id) AS last FROM rb_walk) WHERE shut OR (rn = last AND text <> '')""")
