"""DuckDB SQL over the given tables, written as named pieces that build on each other.

``query(select)`` prefixes a SELECT with just the pieces it needs.  The SQL uses
plain windows per book or page: it is the yardstick, not the design.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def part(name: str, body: str) -> None:
    PARTS[name] = body.strip()


def _needed(sql: str, out: set[str] | None = None) -> set[str]:
    out = set() if out is None else out
    for n in PARTS:
        if n not in out and re.search(rf"\b{n}\b", sql):
            out.add(n)
            _needed(PARTS[n], out)
    return out


def query(select: str) -> str:
    used = _needed(select)
    if not used:
        return select.strip()
    kept = lambda n: "MATERIALIZED " if n.endswith(("_run", "_size", "rb_tokens")) else ""  # noqa: E731 - read in every turn of a recursion
    ctes = ",\n".join(f"{n} AS {kept(n)}({PARTS[n]})" for n in PARTS if n in used)
    return f"WITH RECURSIVE {ctes}\n{select.strip()}"


def resolve(p: str = "") -> str:
    """The word as read, for a table alias ``p``."""
    return (
        f"CASE {p}subs_type WHEN 'HypPart1' THEN coalesce({p}subs_content,'') WHEN 'HypPart2' THEN '' "
        f"ELSE coalesce({p}content,'') END"
    )


part("fx_words", r"""
SELECT doc_id, source, p - 1 AS pos, a[p] AS word
FROM (SELECT doc_id, source, string_split(trim(regexp_replace(text,'[ \t\n\r]+',' ','g')),' ') AS a FROM documents),
     LATERAL unnest(generate_series(1, len(a))) AS u(p)
""")
part("fx_k", """
SELECT doc_id, source, pos, word, CAST(floor(pos/9) AS BIGINT) AS line_no, pos % 9 AS tok_no,
       CAST(floor(floor(pos/9)/7) AS BIGINT) AS block_no,
       lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS next_word
FROM fx_words WHERE word <> ''
""")
part("fx_t", """
SELECT *, line_no % 7 AS lib,
       CASE (doc_id*31 + block_no*17) % 12 WHEN 0 THEN 66 WHEN 1 THEN 34 WHEN 2 THEN 22 ELSE 30 END AS base_h,
       150 + CASE WHEN (doc_id + line_no) % 7 IN (0,1) THEN 45 ELSE 0 END AS line_left
FROM fx_k
""")
part("fx_tokens", """
SELECT doc_id AS page_id, source AS book_id, block_no AS block_seq, line_no AS line_seq, pos AS token_seq,
  CASE WHEN tok_no = 8 AND (doc_id+line_no) % 8 = 5 THEN word || '-' ELSE word END AS content,
  CASE WHEN tok_no = 8 AND (doc_id+line_no) % 8 = 3 THEN word || next_word END AS subs_content,
  CASE WHEN tok_no = 8 AND (doc_id+line_no) % 8 = 3 AND next_word IS NOT NULL THEN 'HypPart1'
       WHEN tok_no = 0 AND line_no > 0 AND (doc_id+line_no-1) % 8 = 3 THEN 'HypPart2' END AS subs_type,
  CASE WHEN (doc_id+block_no) % 9 = 0 THEN 'bold' ELSE '' END AS style,
  CAST(line_left + tok_no*110 AS BIGINT) AS hpos,
  CAST(200 + line_no*46 + block_no*70
    + CASE WHEN lib >= 4 AND (doc_id+block_no) % 5 = 0 THEN 65 ELSE 0 END AS BIGINT) AS vpos,
  CAST(12*length(word) AS BIGINT) AS width, CAST(base_h + (doc_id+pos) % 2 AS DOUBLE) AS height,
  CAST(CASE base_h WHEN 66 THEN 24 WHEN 34 THEN 14 WHEN 22 THEN 8 ELSE 11 END AS DOUBLE) AS font_size
FROM fx_t
""")
part("fx_lines", """
SELECT page_id, book_id, block_seq, line_seq,
  CASE WHEN c THEN CAST(700 - floor((w - 60*lib)/2) AS BIGINT) ELSE h END AS hpos, vpos,
  CASE WHEN c THEN w - 60*lib ELSE w END AS width, height, vpos + height AS bottom, font_size
FROM (SELECT page_id, book_id, block_seq, line_seq, line_seq % 7 AS lib, (page_id+block_seq) % 11 = 4 AS c,
        min(hpos) AS h, min(vpos) AS vpos, max(hpos+width)-min(hpos) AS w, CAST(max(height) AS BIGINT) AS height,
        max(font_size) AS font_size
      FROM fx_tokens GROUP BY page_id, book_id, block_seq, line_seq) g
""")
part("fx_pages", """
SELECT source AS book_id, doc_id AS page_id, n-1 AS page_index,
  CASE n % 10 WHEN 0 THEN '[' || CAST(n AS VARCHAR) || ']' WHEN 1 THEN 'xiv' WHEN 2 THEN NULL WHEN 3 THEN 'foo'
       ELSE CAST(n AS VARCHAR) END AS page_number,
  'Strana ' || CAST(n AS VARCHAR) AS title,
  CASE WHEN n = 1 THEN 'frontCover' WHEN n = 2 THEN 'titlePage' WHEN n % 17 = 0 THEN 'map' ELSE 'normalPage' END AS page_type,
  CASE WHEN n % 2 = 0 THEN 'left' ELSE 'right' END AS page_side, 'page' AS model
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) p
""")
part("fx_number_lines", """
SELECT page_id, book_id, 1000000 + k AS seq, 60 + 30*k AS vpos, 12*length(txt) AS width, txt
FROM (SELECT page_id, book_id, CAST(0 AS BIGINT) AS k,
        CASE (page_index+1) % 10 WHEN 4 THEN NULL WHEN 6 THEN CAST(page_index+900 AS VARCHAR) WHEN 7 THEN 'x~y'
             ELSE page_number END AS txt FROM fx_pages
      UNION ALL
      SELECT page_id, book_id, CAST(1 AS BIGINT),
        CASE WHEN (page_index+1) % 10 = 8 THEN '12 *' WHEN (page_index+1) % 10 = 9 THEN '3 * ab' END FROM fx_pages) q
WHERE txt IS NOT NULL
""")
part("all_tokens", """
SELECT page_id, book_id, block_seq, line_seq, token_seq, content, subs_content, subs_type, style, hpos, vpos, width, height
FROM fx_tokens
UNION ALL
SELECT page_id, book_id, seq, seq, 0, txt, NULL, NULL, '', 700, vpos, width, 30 FROM fx_number_lines
""")
part("all_lines", """
SELECT page_id, book_id, block_seq, line_seq, hpos, vpos, width, height, bottom, font_size FROM fx_lines
UNION ALL
SELECT page_id, book_id, seq, seq, 700, vpos, width, 30, vpos + 30, 11 FROM fx_number_lines
""")
part("fx_blocks", """
SELECT page_id, book_id, 'b' || CAST(block_seq+1 AS VARCHAR) AS block_id, block_seq AS ord,
  CASE (page_id*31 + block_seq*17) % 12 WHEN 0 THEN 'h1' WHEN 1 THEN 'h2' WHEN 2 THEN 'small' WHEN 3 THEN 'note'
       ELSE 'p' END AS type, text
FROM (SELECT page_id, book_id, block_seq, string_agg(content,' ' ORDER BY token_seq) AS text
      FROM fx_tokens GROUP BY page_id, book_id, block_seq) b
""")
part("fx_changes", """
SELECT page_id, ord, CASE WHEN (page_id+ord) % 23 = 0 THEN 'b' || CAST(9000+ord AS VARCHAR) ELSE block_id END AS block_id,
  CASE WHEN (page_id+ord) % 11 = 0 THEN ' ' ELSE replace(text,'th','ht') END AS text
FROM fx_blocks WHERE (page_id+ord) % 5 = 0 OR (page_id+ord) % 11 = 0 OR (page_id+ord) % 23 = 0
""")
part("fx_illustrations", """
SELECT doc_id AS page_id, k AS seq,
  CAST(CASE WHEN k < 3 THEN 100 + (doc_id*37 + k*211) % 900 ELSE 110 + (doc_id*37) % 900 END AS DOUBLE) AS x,
  CAST(CASE WHEN k < 3 THEN 200 + (doc_id*53 + k*97) % 1500 ELSE 210 + (doc_id*53) % 1500 END AS DOUBLE) AS y,
  CAST(CASE WHEN k < 3 THEN 200 + k*150 ELSE 100 END AS DOUBLE) AS w,
  CAST(CASE WHEN k < 3 THEN 200 + k*130 ELSE 100 END AS DOUBLE) AS h
FROM documents, LATERAL unnest(generate_series(0, CASE WHEN doc_id % 8 = 0 THEN 3 ELSE 2 END)) AS u(k)
""")
part("fx_objects", """
SELECT 'r' || r_regionkey AS pid, CAST(NULL AS VARCHAR) AS parent_pid, CAST(r_regionkey AS BIGINT) AS ord,
       'monograph' AS model, r_name AS title FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, 'monographunit', n_name FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, 'internalpart', c_name FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'page' END, CAST(o_orderkey AS VARCHAR) FROM orders
""")
part("fx_job_events", """
SELECT user_id AS job_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS processed,
  count(*) OVER (PARTITION BY user_id) + user_id % 3 AS total, event_type AS message
FROM events
""")

# --- page segmentation -------------------------------------------------------------------------
HYPH = "-–—‑‒−‐"
part("tok_read", f"""
SELECT *, {resolve()} AS tok,
  trim(CASE subs_type WHEN 'HypPart2' THEN coalesce(nullif(subs_content,''), content, '') ELSE {resolve()} END) AS seen,
  row_number() OVER (PARTITION BY page_id, block_seq, line_seq ORDER BY token_seq) AS tok_pos
FROM fx_tokens
""")
part("line_read", """
SELECT page_id, block_seq, line_seq,
  trim(coalesce(string_agg(tok, ' ' ORDER BY token_seq) FILTER (WHERE tok <> ''), '')) AS text,
  min_by(hpos, token_seq) FILTER (WHERE tok_pos <= 3 AND seen <> '' AND (regexp_matches(seen, '[\\p{L}\\p{N}]')
     OR NOT (length(seen) = 1 AND contains('.:,;)]"''“”’', seen)))) AS edge,
  bool_and(contains(style, 'bold')) AS bold,
  avg(height) FILTER (WHERE tok <> '' AND height > 0) AS mean_h
FROM tok_read GROUP BY page_id, block_seq, line_seq
""".replace("\\\\", "\\"))
part("ln_steps", """
SELECT *, vpos - lag(bottom) OVER b AS gap, hpos - lag(hpos) OVER b AS shift
FROM fx_lines WHERE width > 0
WINDOW b AS (PARTITION BY page_id, block_seq ORDER BY line_seq)
""")
part("ln_median", """
SELECT page_id, block_seq, median(height) AS med_h, median(width) AS med_w,
  median(gap) FILTER (WHERE gap > 0) AS med_gap,
  list_sort(list(shift) FILTER (WHERE shift > 0)) AS shifts
FROM ln_steps GROUP BY page_id, block_seq
""")
part("ln_low", """
SELECT page_id, block_seq, med_h, med_w, med_gap,
  list_median(shifts[1:greatest(1, CAST(floor(len(shifts)/2) AS BIGINT))]) AS med_shift
FROM ln_median
""")
part("ln_thr", """
SELECT *,
  coalesce(CASE WHEN med_h <> 0 THEN least(greatest(raw_v, 1), round_even(med_h*3, 0)) ELSE greatest(raw_v, 1) END, 40) AS vthr,
  coalesce(CASE WHEN raw_h IS NOT NULL THEN greatest(raw_h, 12) END, 40) AS hthr
FROM (SELECT *,
   CASE WHEN nullif(med_gap,0) IS NULL AND nullif(med_h,0) IS NULL THEN NULL
        ELSE greatest(round_even(nullif(med_gap,0)*2.5e0, 0), round_even(nullif(med_h,0)*85e-2, 0)) END AS raw_v,
   greatest(round_even(nullif(med_w,0)*3e-2, 0), round_even(nullif(CASE WHEN med_w <> 0 AND med_shift > med_w*6e-1 THEN 0 ELSE med_shift END, 0)*85e-2, 0)) AS raw_h
  FROM ln_low)
""")
part("ln_all", """
SELECT l.*, t.vthr, t.hthr, r.text, coalesce(r.edge, l.hpos) AS eff_left, r.bold, r.mean_h
FROM ln_steps l JOIN ln_thr t USING (page_id, block_seq) JOIN line_read r USING (page_id, block_seq, line_seq)
""")
part("ln_groups", """
SELECT *, CAST(sum(CASE WHEN gap > vthr THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, block_seq ORDER BY line_seq) AS BIGINT) AS vgroup
FROM ln_all
""")
part("ln_center", """
SELECT *, (near_med_g OR near_page_g) AND wide_g AS group_centered, (near_med_b OR near_page_b) AND wide_b AS block_centered
FROM (SELECT *,
   max(hpos+width/2) OVER g - median(hpos+width/2) OVER g <= median(width) OVER g * 2e-2
     AND median(hpos+width/2) OVER g - min(hpos+width/2) OVER g <= median(width) OVER g * 2e-2 AS near_med_g,
   max(hpos+width/2) OVER g - 700 <= 1400*2e-2 AND 700 - min(hpos+width/2) OVER g <= 1400*2e-2 AS near_page_g,
   max(width) OVER g - min(width) OVER g > median(width) OVER g * 1e-1 AS wide_g,
   max(hpos+width/2) OVER b - median(hpos+width/2) OVER b <= median(width) OVER b * 2e-2
     AND median(hpos+width/2) OVER b - min(hpos+width/2) OVER b <= median(width) OVER b * 2e-2 AS near_med_b,
   max(hpos+width/2) OVER b - 700 <= 1400*2e-2 AND 700 - min(hpos+width/2) OVER b <= 1400*2e-2 AS near_page_b,
   max(width) OVER b - min(width) OVER b > median(width) OVER b * 1e-1 AS wide_b
  FROM ln_groups
  WINDOW g AS (PARTITION BY page_id, block_seq, vgroup), b AS (PARTITION BY page_id, block_seq))
""")
part("ln_located", """
SELECT *,
  lag(CASE WHEN text = '' THEN hpos ELSE eff_left END) OVER b AS prev_left,
  coalesce(pf > 0 AND font_size > 0 AND greatest(pf, font_size)/least(pf, font_size) >= 1.2e0, FALSE) AS font_differs,
  max(vgroup) OVER (PARTITION BY page_id, block_seq) AS last_vgroup
FROM (SELECT *, lag(font_size) OVER (PARTITION BY page_id, block_seq ORDER BY line_seq) AS pf FROM ln_center)
WINDOW b AS (PARTITION BY page_id, block_seq ORDER BY line_seq)
""")
part("ln_cut", """
SELECT *,
  NOT coalesce(pg = vgroup, FALSE) AS b_first,
  coalesce(NOT group_centered AND prev_left IS NOT NULL AND (eff_left - prev_left > hthr OR font_differs), FALSE) AS b_shift,
  group_centered AND block_centered AND coalesce(pg = vgroup, FALSE)
    AND (font_differs OR coalesce(greatest(pm, mean_h)/least(pm, mean_h) >= 1.25e0 AND pm IS NOT NULL AND mean_h IS NOT NULL, FALSE)) AS b_center
FROM (SELECT *, eff_left - prev_left AS step, lag(vgroup) OVER b AS pg, lag(mean_h) OVER b AS pm
      FROM ln_located WHERE text <> '' WINDOW b AS (PARTITION BY page_id, block_seq ORDER BY line_seq))
""")
part("ln_seg", """
SELECT *, CAST(sum(CASE WHEN b_first OR b_shift OR b_center THEN 1 ELSE 0 END) OVER b AS BIGINT) AS seg,
  CASE WHEN coalesce(lead(vgroup) OVER b, last_vgroup) <> vgroup THEN 'vertical_gap'
       WHEN lead(b_shift) OVER b THEN 'horizontal_shift' WHEN lead(b_center) OVER b THEN 'center_font_change' END AS line_end
FROM ln_cut WINDOW b AS (PARTITION BY page_id, block_seq ORDER BY line_seq)
""")
part("ln_num", """
SELECT *, row_number() OVER (PARTITION BY page_id, block_seq, seg ORDER BY line_seq) - 1 AS n FROM ln_seg
""")
part("ln_neg", """
SELECT *, max(CASE WHEN NOT group_centered AND n > 0 AND step < 0 AND -step > hthr*95e-2 THEN n END)
    OVER (PARTITION BY page_id, block_seq, seg) - 1 AS cut,
  last_value(line_end) OVER (PARTITION BY page_id, block_seq, seg ORDER BY line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS seg_end
FROM ln_num
""")
part("ln_final", """
SELECT *, coalesce(n < cut, FALSE) AS single, CASE WHEN n < cut THEN n ELSE coalesce(cut, 0) END AS sub,
  CASE WHEN n < cut THEN block_centered ELSE group_centered END AS centered,
  CASE WHEN n < cut THEN 'horizontal_indent' ELSE seg_end END AS split_reason
FROM ln_neg
""")
# words of the final lines, hyphen merging
part("ln_words", """
SELECT f.page_id, f.block_seq, f.seg, f.sub, f.line_seq, f.n, f.text,
  list(struct_pack(tok := t.tok, height := t.height) ORDER BY t.token_seq) FILTER (WHERE t.tok <> '') AS words
FROM ln_final f JOIN tok_read t USING (page_id, block_seq, line_seq)
GROUP BY f.page_id, f.block_seq, f.seg, f.sub, f.line_seq, f.n, f.text
""")
part("hy_base", f"""
SELECT *, coalesce(len(words), 0) AS nw, words[-1].tok AS last_tok, lead(words[1]) OVER o AS nxt,
  row_number() OVER o AS k
FROM ln_words WINDOW o AS (PARTITION BY page_id, block_seq, seg, sub ORDER BY line_seq)
""")
part("hy_e", f"""
SELECT *, coalesce(regexp_matches(last_tok, '[{HYPH}]$') AND regexp_matches(left(last_tok, length(last_tok)-1), '\\p{{L}}')
   AND nxt IS NOT NULL, FALSE) AS e FROM hy_base
""")
part("hy_start", """
SELECT *, max(CASE WHEN NOT (nw = 1 AND e AND coalesce(pe, FALSE)) THEN k END) OVER (PARTITION BY page_id, block_seq, seg, sub ORDER BY line_seq) AS st
FROM (SELECT *, lag(e) OVER (PARTITION BY page_id, block_seq, seg, sub ORDER BY line_seq) AS pe FROM hy_e)
""")
part("hy_m", """
SELECT *, e AND (k - st) % 2 = 0 AS m FROM hy_start
""")
part("hy_t", """
SELECT *, coalesce(lag(m) OVER (PARTITION BY page_id, block_seq, seg, sub ORDER BY line_seq), FALSE) AS taken FROM hy_m
""")
part("hy_w", """
SELECT *, CASE WHEN taken THEN words[2:] ELSE words END AS w0 FROM hy_t
""")
part("hy_out", """
SELECT page_id, block_seq, seg, sub, line_seq, m, taken,
  CASE WHEN m THEN list_concat(w0[:len(w0)-1], [struct_pack(tok := left(last_tok, length(last_tok)-1) || nxt.tok,
        height := greatest(words[-1].height, nxt.height))]) ELSE w0 END AS words2,
  text AS text0
FROM hy_w
""")
part("hy_lines", r"""
SELECT *, CASE WHEN m OR taken THEN trim(list_aggregate(list_transform(words2, lambda w: w.tok), 'string_agg', ' ')) ELSE text0 END AS text1
FROM hy_out
""")
part("pb_raw", """
SELECT h.page_id, h.block_seq, h.seg, h.sub,
  trim(string_agg(coalesce(h.text1,''), ' ' ORDER BY h.line_seq) FILTER (WHERE coalesce(h.text1,'') <> '')) AS text,
  any_value(f.book_id) AS book_id, bool_and(f.centered) AS centered, bool_and(f.bold) AS all_bold, count(*) AS line_count,
  any_value(f.split_reason) AS split_reason,
  CAST(min_by(f.vpos, f.line_seq) AS DOUBLE) AS top, min_by(f.hpos + f.width/2, f.line_seq) AS left_pos,
  CAST(min_by(f.bottom, f.line_seq) AS DOUBLE) AS bottom, min_by(f.width, f.line_seq) AS width,
  max(f.font_size) AS max_font, flatten(list(h.words2 ORDER BY h.line_seq)) AS words
FROM hy_lines h JOIN ln_final f USING (page_id, block_seq, line_seq)
GROUP BY h.page_id, h.block_seq, h.seg, h.sub
""")
part("pb", """
SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY block_seq, seg, sub) - 1 AS block_no FROM pb_raw WHERE text <> ''
""")

# --- book style ----------------------------------------------------------------------------------
TERMS = (
    "titul|title|cover|obal|obsah|content|contents|ilustr|illustr|obraz|image|map|fotograf|photo|reklam|advert|"
    "příloh|priloh|appendix|příloha|napis|blank|prázd|prazd|index"
)
part("txt_pages", f"""
SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_index) - 1 AS rnk, count(*) OVER (PARTITION BY book_id) AS n
FROM fx_pages WHERE NOT regexp_matches(lower(page_type || chr(10) || title), '{TERMS}')
""")
part("sample", """
SELECT book_id, page_id, page_index FROM txt_pages t WHERE EXISTS (
  SELECT 1 FROM (SELECT unnest(generate_series(0, 4)) AS i) WHERE i < least(5, t.n) AND
    t.rnk = CASE WHEN least(5, t.n) > 1 THEN floor(i * (t.n - 1) / (least(5, t.n) - 1)) ELSE 0 END)
""")
part("height_counts", """
SELECT page_id, round_even(height, 1) AS h, count(*) AS cnt, min(block_seq * 1000000000 + token_seq) AS first_at FROM fx_tokens GROUP BY 1, 2
""")
part("mode_rows", """
SELECT page_id, h AS mode_height, CAST(words AS BIGINT) AS words FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY cnt DESC, first_at) AS r, sum(cnt) OVER (PARTITION BY page_id) AS words
  FROM height_counts) WHERE r = 1 AND words >= 20
""")
part("style_rows", """
SELECT s.book_id, s.page_id, s.page_index, m.mode_height, m.words, l.lines
FROM sample s JOIN mode_rows m USING (page_id) JOIN (SELECT page_id, count(*) AS lines FROM fx_lines GROUP BY page_id) l USING (page_id)
""")
part("bstyle", """
SELECT b.book_id, s.average_height, coalesce(s.confidence, 0) AS confidence, coalesce(s.pages_used, 0) AS pages_used,
  coalesce(s.lines_sampled, 0) AS lines_sampled, coalesce(s.words_sampled, 0) AS words_sampled,
  coalesce(s.distinct_styles, 0) AS distinct_styles, coalesce(s.sampled_pages, '') AS sampled_pages
FROM (SELECT DISTINCT book_id FROM fx_pages) b LEFT JOIN (
  SELECT book_id, round_even(avg(mode_height), 2) AS average_height,
    CAST(round_even(least(1e0, greatest(0e0, 1 - stddev_pop(mode_height)/avg(mode_height))) * 100, 0) AS BIGINT) AS confidence,
    count(*) AS pages_used, CAST(sum(lines) AS BIGINT) AS lines_sampled, CAST(sum(words) AS BIGINT) AS words_sampled,
    count(DISTINCT mode_height) AS distinct_styles, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_index) AS sampled_pages
  FROM style_rows GROUP BY book_id) s USING (book_id)
""")
part("fonth", f"""
SELECT l.page_id, l.font_size, CAST(sum(length(regexp_replace({resolve('t.')}, '\\s', '', 'g'))) AS BIGINT) AS chars
FROM fx_tokens t JOIN fx_lines l USING (page_id, block_seq, line_seq) WHERE l.width > 0 GROUP BY 1, 2
""")
part("fx_styles", """
SELECT doc_id AS page_id, 'FONT_' || s AS style_id, CAST(s AS DOUBLE) AS font_size,
  CASE WHEN s > 11 THEN 'Fraktur' ELSE 'Times' END AS font_family, CASE WHEN s = 14 THEN 'italics' END AS font_style,
  CASE WHEN s = 24 THEN 'bold' END AS font_weight
FROM documents, (SELECT unnest([24, 14, 11, 8]) AS s)
""")
part("hcut", """
SELECT page_id, coalesce(max(font_size) FILTER (WHERE font_size > nxt * 1.2e0), max(font_size)) AS cut
FROM (SELECT page_id, font_size, lead(font_size) OVER (PARTITION BY page_id ORDER BY font_size DESC) AS nxt
      FROM (SELECT DISTINCT page_id, font_size FROM fx_styles)) GROUP BY page_id
""")

# --- printed page numbers ------------------------------------------------------------------------
part("nl_num", """
SELECT page_id, book_id, page_number,
  CASE WHEN regexp_matches(trim(page_number), '^([0-9]+|[IVXLCDMivxlcdm]+)$') THEN upper(trim(page_number))
       WHEN regexp_matches(trim(page_number), '^\\[\\s*([0-9]+|[IVXLCDMivxlcdm]+)\\s*\\]$')
       THEN upper(regexp_extract(trim(page_number), '^\\[\\s*([0-9]+|[IVXLCDMivxlcdm]+)\\s*\\]$', 1)) END AS value,
  coalesce(regexp_matches(trim(page_number), '^([0-9]+|[IVXLCDMivxlcdm]+)$'), FALSE) AS searchable
FROM fx_pages
""".replace("\\\\", "\\"))
part("nl_text", f"""
SELECT page_id, block_seq, line_seq,
  trim(coalesce(string_agg(tok, ' ' ORDER BY token_seq) FILTER (WHERE tok <> ''), '')) AS txt,
  min(hpos) FILTER (WHERE tok <> '' AND regexp_matches(tok, '[\\p{{L}}\\p{{N}}]')) AS lft,
  max(hpos + greatest(width, 0)) FILTER (WHERE tok <> '' AND regexp_matches(tok, '[\\p{{L}}\\p{{N}}]')) AS rgt
FROM (SELECT *, {resolve()} AS tok FROM all_tokens) GROUP BY 1, 2, 3
""")
part("nl_cons", r"""
SELECT l.page_id, l.block_seq, l.line_seq, l.vpos, t.txt, n.value, regexp_matches(n.value, '\p{L}') AS roman
FROM all_lines l JOIN nl_text t USING (page_id, block_seq, line_seq) JOIN nl_num n USING (page_id)
WHERE n.value IS NOT NULL AND n.searchable
  AND CASE WHEN lft IS NULL THEN l.width ELSE greatest(rgt - lft, 0) END BETWEEN 1 AND 280 AND t.txt <> ''
  AND (regexp_matches(n.value, '\p{L}') OR length(regexp_replace(t.txt, '\s', '', 'g')) < 5
       OR length(regexp_replace(t.txt, '[^\p{L}]', '', 'g')) < 5e-1 * length(regexp_replace(t.txt, '\s', '', 'g')))
""")
part("nl_role", r"""
SELECT *, CASE
  WHEN regexp_matches(txt, CASE WHEN roman THEN '(^|[^0-9A-Za-z])' || value || '($|[^0-9A-Za-z])' ELSE '(^|[^0-9])' || value || '($|[^0-9])' END) THEN 'match'
  WHEN regexp_matches(txt, '(^|[^0-9])[0-9]+[^\p{L}\p{N}_]*\*') THEN
    CASE WHEN regexp_matches(regexp_extract(txt, '(?s)^((?:.*?[^0-9])??)[0-9]+[^\p{L}\p{N}_]*\*(.*)$', 1)
                || regexp_extract(txt, '(?s)^((?:.*?[^0-9])??)[0-9]+[^\p{L}\p{N}_]*\*(.*)$', 2), '[0-9A-Za-z]') THEN 'starred_mixed' ELSE 'starred' END
  WHEN regexp_matches(txt, '^[0-9]{1,4}$') THEN 'bare' ELSE 'suspect' END AS role0
FROM nl_cons
""")
part("nl_count", """
SELECT *, count(*) FILTER (WHERE role0 = 'match') OVER p AS n_match, count(*) FILTER (WHERE role0 = 'suspect') OVER p AS n_susp,
  count(*) FILTER (WHERE role0 IN ('starred','starred_mixed','bare')) OVER p AS n_sec
FROM nl_role WINDOW p AS (PARTITION BY page_id)
""")
part("nl_final", """
SELECT * FROM (SELECT *, CASE WHEN role0 = 'bare' AND n_match = 0 AND n_susp = 0 AND n_sec = 1 THEN 'promoted'
    WHEN role0 = 'suspect' AND n_match > 0 THEN NULL ELSE role0 END AS role FROM nl_count) WHERE role IS NOT NULL
""")
part("nl_first", """
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY vpos, block_seq, line_seq) - 1 AS note_seq, vpos,
  'Page number: ' || value || ' ; OCR text: ' || txt || CASE WHEN role = 'match' THEN '' ELSE ' ; !FOUND ONLY KANDIDATE!' END AS text
FROM nl_final WHERE role IN ('match','suspect','promoted')
UNION ALL
SELECT page_id, 0, 4001, 'Page number: ' || value || ' ; OCR text: None ; !NOT FOUND!' FROM nl_num
WHERE value IS NOT NULL AND searchable AND page_id NOT IN (SELECT page_id FROM nl_final WHERE role IN ('match','suspect','promoted'))
UNION ALL
SELECT page_id, 0, 4001, 'Page number: ' || trim(page_number) || ' ; SHOULDN''T BE ON PAGE' FROM nl_num
WHERE NOT (value IS NOT NULL AND searchable) AND trim(page_number) <> ''
""")
part("nl_second", """
SELECT s.page_id, f.n + row_number() OVER o - 1 AS note_seq, greatest(f.top, 4000) + row_number() OVER o AS vpos,
  'Secondary page number OCR: ' || s.txt || CASE WHEN s.role = 'starred_mixed' THEN ' ; !FOUND OLNY KANDIDATE!' ELSE '' END AS text
FROM nl_final s JOIN (SELECT page_id, count(*) AS n, max(vpos) AS top FROM nl_first GROUP BY 1) f USING (page_id)
WHERE s.role IN ('starred','starred_mixed','bare') WINDOW o AS (PARTITION BY s.page_id ORDER BY s.vpos, s.block_seq, s.line_seq)
""")
part("pn_notes", "SELECT * FROM nl_first UNION ALL SELECT * FROM nl_second")
part("html_lines", """
SELECT l.* FROM all_lines l ANTI JOIN (SELECT * FROM nl_final WHERE role IN ('match','starred','promoted')) r USING (page_id, block_seq, line_seq)
""")


part("para", """
SELECT t.*, f.seg FROM tok_read t JOIN ln_final f USING (page_id, block_seq, line_seq)
""")


def _chain(prefix: str, renamed: dict[str, str]) -> None:
    """The segmentation and book style pieces again over other lines and words."""
    names = [n for n in PARTS if n.startswith(
        ("tok_read", "line_read", "ln_", "hy_", "pb", "height_counts", "mode_rows", "style_rows", "bstyle"))]
    swap = {n: prefix + n for n in names} | renamed
    pattern = re.compile(r"\b(" + "|".join(sorted(swap, key=len, reverse=True)) + r")\b")
    for n in names:
        part(prefix + n, pattern.sub(lambda m: swap[m.group(1)], PARTS[n]))


_chain("x_", {"fx_lines": "html_lines", "fx_tokens": "all_tokens"})


def _tags(prefix: str, blocks: str, fonts: str, book: str) -> None:
    """Tag rules over a set of blocks."""
    part(prefix + "head", f"""
SELECT page_id, sum(chars) FILTER (WHERE font_size >= cut) AS head, sum(chars) AS total FROM {fonts} JOIN hcut USING (page_id) GROUP BY 1
""")
    part(prefix + "el", f"""
SELECT b.*, s.average_height, c.cut,
  coalesce(h.total > 0 AND coalesce(h.head, 0) / h.total <= 4e-1, FALSE) AND b.max_font >= c.cut AS in_head,
  list_filter(b.words, lambda w: regexp_matches(w.tok, '[\\p{{L}}\\p{{N}}]')) AS aw
FROM {blocks} b JOIN {book} s USING (book_id) JOIN hcut c USING (page_id) LEFT JOIN {prefix}head h USING (page_id)
""")
    part(prefix + "el2", f"""
SELECT *, CASE WHEN len(list_filter(aw, lambda w: length(regexp_replace(w.tok, '\\s', '', 'g')) > 1)) > 5
  THEN list_filter(aw, lambda w: length(regexp_replace(w.tok, '\\s', '', 'g')) > 1) ELSE aw END AS el FROM {prefix}el
""")
    part(prefix + "hc", f"""
SELECT *, CASE WHEN average_height IS NULL OR len(el) = 0 OR len(el) > 25 OR coalesce(split_reason = 'horizontal_indent', FALSE) THEN 'p'
  WHEN len(list_filter(el, lambda w: w.height >= average_height * 2))/len(el) >= need THEN 'h1'
  WHEN len(list_filter(el, lambda w: w.height >= average_height * 1.08e0))/len(el) >= need THEN 'h2' ELSE 'p' END AS tag
FROM (SELECT *, CASE WHEN in_head THEN 82e-2 * 56e-2 ELSE 82e-2 END AS need FROM {prefix}el2)
""")


_tags("t_", "pb", "fonth", "bstyle")
part("x_fonth", f"""
SELECT l.page_id, l.font_size, sum(length(regexp_replace({resolve('t.')}, '\\s', '', 'g'))) AS chars
FROM all_tokens t JOIN html_lines l USING (page_id, block_seq, line_seq) WHERE l.width > 0 GROUP BY 1, 2
""")
_tags("xt_", "x_pb", "x_fonth", "x_bstyle")


def _finish(prefix: str, tagged: str) -> None:
    part(prefix + "run0", f"""
SELECT *, CASE WHEN line_count = 1 AND lag(line_count) OVER w = 1 AND (top - lag(bottom) OVER w <= 0
   OR top - lag(bottom) OVER w <= greatest(lag(greatest(bottom - top, 1)) OVER w, greatest(bottom - top, 1)) * 3) THEN 0 ELSE 1 END AS brk
FROM {tagged} WINDOW w AS (PARTITION BY page_id ORDER BY block_no)
""")
    part(prefix + "run", f"""
SELECT *, sum(brk) OVER (PARTITION BY page_id ORDER BY block_no) AS run FROM {prefix}run0
""")
    part(prefix + "slc", f"""
SELECT * REPLACE (centered OR (line_count = 1 AND count(*) OVER r >= 2
  AND max(left_pos) OVER r - median(left_pos) OVER r <= median(width) OVER r * 2e-2
  AND median(left_pos) OVER r - min(left_pos) OVER r <= median(width) OVER r * 2e-2
  AND max(width) OVER r - min(width) OVER r > median(width) OVER r * 1e-1) AS centered)
FROM {prefix}run WINDOW r AS (PARTITION BY page_id, run)
""")
    part(prefix + "h3", f"""
SELECT * REPLACE (CASE WHEN tag = 'p' AND all_bold AND NOT (pt IS NULL AND nt IS NULL)
   AND (pt IS NULL OR pt IN ('h1','h2') OR (pt = 'p' AND NOT pbold)) AND (nt IS NULL OR nt IN ('h1','h2') OR (nt = 'p' AND NOT nbold))
   THEN 'h3' ELSE tag END AS tag)
FROM (SELECT *, lag(tag) OVER w AS pt, lead(tag) OVER w AS nt, lag(all_bold) OVER w AS pbold, lead(all_bold) OVER w AS nbold
      FROM {prefix}slc WINDOW w AS (PARTITION BY page_id ORDER BY block_no))
""")
    part(prefix + "small", f"""
SELECT * REPLACE (CASE WHEN tag IN ('p','h3') AND average_height IS NOT NULL AND len(el) > 0
   AND len(list_filter(el, lambda w: w.height < average_height * 92e-2))/len(el)
       >= CASE WHEN tag = 'h3' OR starts_with(ltrim(text), '*') THEN 61e-2 * 7e-1 ELSE 61e-2 END THEN 'small' ELSE tag END AS tag)
FROM {prefix}h3
""")


_finish("t_", "t_hc")
_finish("xt_", "xt_hc")
FRAGMENT = """CASE WHEN trim(text) <> '' THEN CASE WHEN tag = 'small' THEN '<p' || CASE WHEN centered THEN ' style="text-align: center;"' ELSE '' END
  || '><small>' || trim(text) || '</small></p>' ELSE '<' || tag || CASE WHEN centered THEN ' style="text-align: center;"' ELSE '' END
  || '>' || trim(text) || '</' || tag || '>' END END"""
part("ill_pairs", """
SELECT a.page_id, a.seq AS sa, b.seq AS sb, CASE WHEN greatest(1, a.w*a.h) <= greatest(1, b.w*b.h) THEN a.seq ELSE b.seq END AS loser
FROM fx_illustrations a JOIN fx_illustrations b ON a.page_id = b.page_id AND a.seq < b.seq
WHERE greatest(0, least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y)) > 0
  AND greatest(0, least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y))
      / least(greatest(1, a.w*a.h), greatest(1, b.w*b.h)) >= 95e-2
""")
part("ill_kept", """
SELECT i.* FROM fx_illustrations i ANTI JOIN (SELECT DISTINCT page_id, loser AS seq FROM ill_pairs) d USING (page_id, seq)
""")
part("ill_html", """
SELECT page_id, seq, x, y, '<note class="illustration" style="display:block;font-size:0.82em;color:#1c9b4a;font-weight:bold;" data-uuid="'
  || page_id || '" data-bbox="' || box || '" data-page-width="1400" data-page-height="4000">Ilustrace: bbox=' || box || ' page=1400x4000</note>' AS html
FROM (SELECT *, CAST(x AS BIGINT) || ',' || CAST(y AS BIGINT) || ',' || CAST(w AS BIGINT) || ',' || CAST(h AS BIGINT) AS box FROM ill_kept)
""")
part("ph_items", f"""
SELECT page_id, top, left_pos, 0 AS kind, block_no AS seq, {FRAGMENT} AS html FROM xt_small
UNION ALL SELECT page_id, y, x, 1, seq, html FROM ill_html
""")
part("ph_body", "SELECT page_id, string_agg(html, '' ORDER BY top, left_pos, kind, seq) AS body FROM ph_items WHERE html IS NOT NULL GROUP BY 1")
part("ph_tail", """
SELECT page_id, string_agg('<note style="display:block;font-size:0.82em;color:#1e5aa8;font-weight:bold;">'
  || replace(replace(replace(text,'&','&amp;'),'<','&lt;'),'>','&gt;') || '</note>', '<br>' ORDER BY vpos, note_seq) AS tail FROM pn_notes GROUP BY 1
""")
part("page_htmls", """
SELECT page_id, coalesce(body,'') || CASE WHEN body IS NOT NULL AND tail IS NOT NULL THEN '<br>' ELSE '' END || coalesce(tail,'') AS html
FROM ph_body FULL JOIN ph_tail USING (page_id)
""")
