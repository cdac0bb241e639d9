"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from folio.sqlparts import part, query

ORACLES: dict[str, str] = {}


def oracle(name: str, select: str) -> None:
    ORACLES[name] = query(select)


oracle("fx_pages", "SELECT * FROM fx_pages")
oracle("fx_tokens", "SELECT * FROM all_tokens")
oracle("fx_lines", "SELECT * FROM all_lines")
oracle("layout_thresholds", "SELECT page_id, block_seq, med_h, med_w, med_gap, med_shift, vthr, hthr FROM ln_thr")
oracle("vgap_segments", "SELECT page_id, block_seq, line_seq, gap, vthr, hthr, vgroup FROM ln_groups")
oracle("centered_groups", "SELECT page_id, block_seq, line_seq, vgroup, group_centered, block_centered FROM ln_center")
oracle("effective_left", "SELECT page_id, block_seq, line_seq, text, eff_left, bold FROM (SELECT l.page_id, l.block_seq, l.line_seq, r.text, coalesce(r.edge, l.hpos) AS eff_left, r.bold FROM fx_lines l JOIN line_read r USING (page_id, block_seq, line_seq))")
oracle("hshift_segments", "SELECT page_id, block_seq, line_seq, step, b_first, b_shift FROM ln_cut")
oracle("center_split", "SELECT page_id, block_seq, line_seq, b_center FROM ln_cut")
oracle("indent_split", "SELECT page_id, block_seq, line_seq, seg, sub, single, centered, split_reason FROM ln_final")
oracle("hyphen_merge", "SELECT page_id, block_seq, line_seq, coalesce(text1,'') AS text, CAST(coalesce(len(words2),0) AS BIGINT) AS n_words FROM hy_lines")
oracle("page_blocks", """
SELECT page_id, book_id, block_no, text, centered, all_bold, line_count, split_reason, top, left_pos AS "left", max_font,
  CAST(len(words) AS BIGINT) AS n_words FROM pb""")
oracle("sample_pages", "SELECT * FROM sample")
oracle("wave_sample", """
SELECT book_id, page_id, wave, min(pos) AS pos FROM (
  SELECT t.book_id, t.page_id, CAST(w.wave AS INTEGER) AS wave, g.d AS pos
  FROM txt_pages t, (SELECT unnest([0,1,2]) AS wave, unnest([0e0, 5e-1, 25e-2]) AS off) w,
    LATERAL (SELECT idx, row_number() OVER (ORDER BY min(i)) AS d FROM (
       SELECT i, round_even(least((i+1+w.off)/(least(10, t.n)+1), 999e-3) * (t.n-1), 0) AS idx
       FROM (SELECT unnest(generate_series(0, least(10, t.n)-1)) AS i)) GROUP BY idx) g
  WHERE g.idx = t.rnk) GROUP BY 1, 2, 3""")
oracle("text_pages", "SELECT book_id, page_id, page_type, title FROM txt_pages")
oracle("page_mode_height", "SELECT * FROM mode_rows")
oracle("book_style", "SELECT * FROM bstyle")
oracle("font_hist", "SELECT * FROM fonth")
oracle("heading_fonts", """
SELECT DISTINCT s.page_id, s.font_size FROM fx_styles s JOIN hcut USING (page_id) JOIN t_head h USING (page_id)
WHERE h.total > 0 AND coalesce(h.head, 0)/h.total <= 4e-1 AND s.font_size >= cut""")
oracle("line_font", """
SELECT page_id, block_seq, line_seq, 'FONT_' || CAST(CAST(font_size AS BIGINT) AS VARCHAR) AS style_id, font_size FROM fx_lines""")
oracle("token_style", """
SELECT page_id, token_seq, font_size AS size, style = 'bold' OR font_size = 24 AS bold, font_size = 14 AS italic,
  CASE WHEN font_size > 11 THEN 'Fraktur' ELSE 'Times' END AS font_family,
  'FONT_' || CAST(CAST(font_size AS BIGINT) AS VARCHAR) AS style_id FROM fx_tokens""")
FONT_STATS = """
SELECT * FROM (WITH words AS (
  SELECT *, length(regexp_replace(tok, '\\s', '', 'g')) AS len, CASE WHEN token_seq %% 2 = 0 THEN l_size ELSE round_even(height, 2) END AS size,
    style = 'bold' OR (token_seq %% 2 = 0 AND l_size = 24) AS bold, token_seq %% 2 = 0 AND l_size = 14 AS italic,
    CASE WHEN token_seq %% 2 = 1 THEN '' WHEN l_size > 11 THEN 'Fraktur' ELSE 'Times' END AS family
  FROM (SELECT s.*, l.font_size AS l_size FROM %(src)s s JOIN (SELECT page_id, block_seq, line_seq, max(font_size) OVER (PARTITION BY page_id, block_seq) AS font_size FROM fx_lines) l USING (page_id, block_seq, line_seq))),
sizes AS (
  SELECT page_id, %(k)s, size, sum(len) AS chars, sum(len) FILTER (WHERE bold) AS bold_chars, sum(len) FILTER (WHERE italic) AS italic_chars, min(token_seq) AS first_seq
  FROM words WHERE len > 0 GROUP BY page_id, %(k)s, size),
units AS (
  SELECT * FROM (SELECT *, sum(chars) OVER (PARTITION BY page_id, %(k)s) AS all_chars, row_number() OVER (PARTITION BY page_id, %(k)s ORDER BY chars DESC, first_seq) AS r FROM sizes)
  JOIN (SELECT page_id, %(k)s, count(DISTINCT line_seq) AS lines FROM words WHERE len > 0 GROUP BY page_id, %(k)s) USING (page_id, %(k)s) WHERE r = 1 AND all_chars >= 40),
fam AS (
  SELECT page_id, size, arg_min(family, (-n, family)) AS font_family FROM (
    SELECT page_id, size, family, sum(len) AS n FROM words JOIN units USING (page_id, %(k)s, size) WHERE len > 0 AND family <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT u.page_id, u.size, CAST(sum(chars) AS BIGINT) AS chars, CAST(coalesce(sum(bold_chars), 0) AS BIGINT) AS bold_chars, CAST(coalesce(sum(italic_chars), 0) AS BIGINT) AS italic_chars,
  count(*) AS blocks, CAST(sum(lines) AS BIGINT) AS lines, any_value(font_family) AS font_family
FROM units u LEFT JOIN fam f ON f.page_id = u.page_id AND f.size = u.size GROUP BY u.page_id, u.size)"""
oracle("block_font_stats", FONT_STATS % {"k": "block_seq", "src": "tok_read"})
oracle("paragraph_font_stats", FONT_STATS % {"k": "block_seq, seg", "src": "para"})
oracle("counter_confidence", """
SELECT page_id, CAST(round_even(max(cnt) / sum(cnt) * 100, 0) AS BIGINT) AS confidence
FROM (SELECT page_id, height, count(*) AS cnt FROM fx_tokens GROUP BY 1, 2) GROUP BY 1""")
oracle("page_number_notes", "SELECT page_id, note_seq, vpos, text FROM pn_notes")
oracle("heading_class", "SELECT page_id, block_no, tag FROM t_hc")
oracle("single_line_center", "SELECT page_id, block_no, centered FROM t_slc")
oracle("h3_class", "SELECT page_id, block_no, tag FROM t_h3")
oracle("small_class", "SELECT page_id, block_no, tag FROM t_small")
from folio.sqlparts import FRAGMENT  # noqa: E402

oracle("block_fragment", f"SELECT page_id, block_no, {FRAGMENT} AS html FROM t_slc")
part("hm_blocks", """
SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY block_no) AS rn, [CAST(max_font AS DOUBLE) FOR k IN range(line_count)] AS sizes,
  tag IN ('h1','h2') AND lag(tag) OVER w = tag AND lag(floor(block_no/6)) OVER w = floor(block_no/6) AND lag(all_bold) OVER w = all_bold AS alike
FROM t_hc WINDOW w AS (PARTITION BY page_id ORDER BY block_no)
""")
part("hm_walk", """
SELECT page_id, rn, block_no, sizes, 1 AS run FROM hm_blocks WHERE rn = 1
UNION ALL
SELECT page_id, rn, block_no, CASE WHEN j THEN list_sort(list_concat(old, sizes)) ELSE sizes END, CASE WHEN j THEN run ELSE run + 1 END FROM (
  SELECT b.page_id, b.rn, b.block_no, w.sizes AS old, b.sizes, w.run,
    coalesce(b.alike AND least(list_aggregate(w.sizes, 'median'), list_aggregate(b.sizes, 'median')) > 0
      AND (greatest(list_aggregate(w.sizes, 'median'), list_aggregate(b.sizes, 'median')) - least(list_aggregate(w.sizes, 'median'), list_aggregate(b.sizes, 'median'))) / least(list_aggregate(w.sizes, 'median'), list_aggregate(b.sizes, 'median')) <= 1e-1, FALSE) AS j
  FROM hm_walk w JOIN hm_blocks b ON b.page_id = w.page_id AND b.rn = w.rn + 1)
""")
oracle("heading_merge", """
SELECT page_id, min(block_no) AS block_no, any_value(tag) AS tag,
  CASE WHEN count(*) > 1 THEN regexp_replace(trim(replace(string_agg(text, chr(1) ORDER BY block_no), '-' || chr(1), '')), '[\\s\\x01]+', ' ', 'g')
       ELSE any_value(text) END AS text,
  bool_or(centered) AS centered, bool_and(all_bold) AS all_bold, CAST(sum(line_count) AS BIGINT) AS line_count
FROM t_hc JOIN hm_walk USING (page_id, block_no) GROUP BY page_id, run""")
oracle("illustration_dedupe", "SELECT * FROM ill_kept")
oracle("page_html", "SELECT * FROM page_htmls")
