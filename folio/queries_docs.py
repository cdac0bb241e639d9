"""Registered queries: functions, html, page lists, corrections, differences, exports, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio import fixtures as fx
from folio.functions import library
from folio.functions import markup as M
from folio.functions import text as T
from folio.operators import corrections, diff, export, html, illustrations, pages, search
from folio.queries import page_h, page_w, register, register_as
from folio.sources import page_xml, records
from folio.streaming import progress


def _docs(spark, sf):
    return fx.table(spark, sf, "documents")


def _talk(spark, sf):
    """Conversation turns as texts with one key."""
    return fx.table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS page_id", "turn", "text")


# --- functions -----------------------------------------------------------------------------------
@register
def fn_clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text("text").alias("clean"))


@register
def fn_pid(spark, sf):
    o = fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN 'uuid:' ELSE ' ' END || o_orderkey AS raw",
        "'https://k.example/' || CASE WHEN o_custkey % 3 = 0 THEN 'search/api/client/v7.0' ELSE 'search/api/v5.0' END AS base",
    )
    return o.select("o_orderkey", T.pid_for("raw", T.api_version("base")).alias("pid"))


@register
def fn_page_number(spark, sf):
    n = T.page_number("page_number")
    return fx.pages(spark, sf).select("page_id", n["value"].alias("value"), n["searchable"].alias("searchable"))


@register
def fn_page_label(spark, sf):
    return fx.pages(spark, sf).select(
        "page_id", T.page_label("page_number").alias("label"),
        T.page_label(F.concat(F.lit(" ( "), F.col("title"), F.lit(" ] "))).alias("title_label"),
    )


@register
def fn_hyp_resolve(spark, sf):
    return fx.tokens(fx.text_lines(spark, sf)).select(
        "page_id", "token_seq", T.hyp_resolve(F.col("content"), F.col("subs_content"), F.col("subs_type")).alias("word")
    )


@register
def fn_token_len(spark, sf):
    return fx.tokens(fx.text_lines(spark, sf)).select(
        "page_id", "token_seq", T.nonspace_len("content").cast("bigint").alias("n"),
        T.has_alnum("content").alias("alnum"), T.has_alpha("content").alias("alpha"),
    )


@register
def fn_unescape(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", T.unescape("html").alias("plain"))


@register
def fn_escape(spark, sf):
    return _docs(spark, sf).select("doc_id", T.escape("text").alias("quoted"), T.escape("text", False).alias("unquoted"))


@register
def fn_strip_fences(spark, sf):
    fenced = F.expr("CASE turn % 3 WHEN 0 THEN '```json\\n' || text || '\\n``` ' WHEN 1 THEN ' ```' || text || '```' ELSE text END")
    return _talk(spark, sf).select("page_id", M.strip_fences(fenced).alias("body"))


def _broken_json(spark, sf):
    safe = F.regexp_replace(F.replace("text", F.lit("\\"), F.lit("")), '"', '\\\\\\\\"')
    return _talk(spark, sf).select(
        "page_id", F.concat(F.lit('{"blocks":\n[{"id":"b1","type":"p","text":"'), safe, F.lit('"}]}')).alias("json")
    )


@register
def fn_json_repair(spark, sf):
    return _broken_json(spark, sf).select("page_id", M.json_repair(F.col("json")).alias("json"))


@register
def block_docs(spark, sf):
    fenced = _broken_json(spark, sf).withColumn(
        "json", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("json"), F.lit("\n```"))).otherwise(F.col("json"))
    )
    return records.block_docs(fenced)


@register
def join_decision_parse(spark, sf):
    answer = F.expr(
        "CASE (page_id + turn) % 8 WHEN 0 THEN ' Join ' WHEN 1 THEN '2' WHEN 2 THEN '{\"pairs\":{\"start\":{\"action\":\"Merge\"}}}' "
        "WHEN 3 THEN '{\"start\":{\"decision\":\"1\"}}' WHEN 4 THEN '{\"decision\":{\"start\":\"2\"}}' "
        "WHEN 5 THEN '{\"pairs\":{\"start\":{\"action\":\"maybe\"}}}' WHEN 6 THEN text ELSE 'split' END"
    )
    return _talk(spark, sf).select("page_id", M.join_decision(answer).alias("decision"))


@register
def content_key(spark, sf):
    return _docs(spark, sf).select("doc_id", T.content_key("doc_id", "text", F.lower("text")).alias("key"))


@register
def library_info(spark, sf):
    urls = fx.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("site"))
    bases = urls.select(
        "page_id",
        F.concat("site", F.expr("CASE page_id % 4 WHEN 0 THEN '/search/api/v5.0/' WHEN 1 THEN '/search/api/client/v7.0' WHEN 2 THEN '/api' ELSE '' END")).alias("api_base"),
    ).select("api_base").distinct()
    known = urls.filter("page_id % 5 = 1").select(
        F.concat("site", F.lit("/search/api/client/v7.0")).alias("api_base"), F.concat(F.lit("Library "), "site").alias("o_label"),
        F.lit("known").alias("o_code"), F.lit(None).cast("string").alias("o_handle"),
    ).distinct()
    return library.library_info(bases, known)


@register
def note_bbox(spark, sf):
    text = F.expr(
        "'Ilustrace: bbox=' || cast(x as bigint) || ',' || cast(y as bigint) || ',' || cast(w as bigint) || "
        "CASE WHEN seq = 2 THEN '' ELSE ',' || cast(h as bigint) END || CASE WHEN seq = 1 THEN '' ELSE ' page=1400x4000' END"
    )
    return fx.illustrations(spark, sf).select("page_id", "seq", illustrations.note_bbox(text).alias("b")).select("page_id", "seq", "b.*")


@register
def crop_region(spark, sf):
    scale = F.lit(1.0) + F.col("page_id") % 5 / 4
    region = illustrations.crop_region(
        *[F.col(c) for c in "xywh"], F.lit(float(fx.PAGE_W)), F.lit(2000.0),
        F.floor(scale * 1400).cast("double"), F.floor(scale * 2000).cast("double"),
    )
    return fx.illustrations(spark, sf).select("page_id", "seq", region.alias("r")).select("page_id", "seq", "r.*")


# --- html ----------------------------------------------------------------------------------------
def _fragments(spark, sf):
    return html.html_blocks(fx.articles(spark, sf), "html")


@register
def html_blocks(spark, sf):
    return _fragments(spark, sf)


def _scripted(spark, sf):
    """Articles with what an html page has besides text: on three of four pages a comment, a script, marks in quoted values."""
    extra = F.expr("""CASE page_id % 4
      WHEN 0 THEN '<!-- <p>hidden > </p> --><p title="a > b" class=\\'x>y\\'>shown <!-- not --> here</p>'
      WHEN 1 THEN '<script type="a>b">if (a < b) write("<p>no</p>");</script><p>a < b &amp; c</p><STYLE>p > a {}</STYLE >'
      WHEN 2 THEN '<!DOCTYPE html><div class="note" data-x="</div>">noted<script>var x = "</div>"</script></div><p>open <!-- to the end <p>lost</p>'
      ELSE '' END""")
    return fx.articles(spark, sf).select("page_id", F.when(F.col("page_id") % 4 == 2, F.concat("html", extra)).otherwise(F.concat(extra, F.col("html"))).alias("html"))


@register
def html_to_blocks(spark, sf):
    return html.html_to_blocks(_scripted(spark, sf), "html")


@register
def block_key(spark, sf):
    return _fragments(spark, sf).select("page_id", "block_no", T.block_key("fragment").alias("key"))


@register
def noise_blocks(spark, sf):
    return _fragments(spark, sf).select("page_id", "block_no", T.is_noise("fragment").alias("noise"))


@register
def block_type(spark, sf):
    made = F.expr(
        "CASE ord % 5 WHEN 0 THEN '<p><small>' || text || '</small><br/></p>' WHEN 1 THEN '<div class=\"x centered\">' || text || '</div>' "
        "WHEN 2 THEN '<p>' || text || '<small>' || type || '</small></p>' WHEN 3 THEN '<div class=\"note\">' || text || '</div>' "
        "ELSE '<' || type || '>' || text || '</' || type || '>' END"
    )
    return fx.blocks(spark, sf).select("page_id", "ord", M.block_type(made).alias("kind"))


@register
def block_html(spark, sf):
    b = fx.blocks(spark, sf)
    return b.select("page_id", "ord", *[
        M.block_html(F.col("type"), F.col("text"), F.col("block_id"), p).alias(p) for p in ("server", "diff", "client")])


def _server_fragments(spark, sf):
    made = fx.blocks(spark, sf).select(
        "page_id", F.col("ord").alias("block_no"), M.block_html(F.col("type"), F.col("text"), F.col("block_id"), "server").alias("fragment"))
    notes = illustrations.illustration_notes(fx.illustrations(spark, sf), page_w(), page_h()).select(
        "page_id", (F.col("seq") + 1000000).alias("block_no"), F.col("html").alias("fragment"))
    return made.unionByName(notes)


@register
def block_filter(spark, sf):
    f = F.col("fragment")
    tag = T.block_tag("fragment")
    return _server_fragments(spark, sf).select(
        "page_id", "block_no", M.is_small(f, tag).alias("small"), M.is_note(f, tag).alias("note"), M.is_illustration(f, tag).alias("picture"))


@register
def page_content(spark, sf):
    return html.page_content(_server_fragments(spark, sf), "epub", omit_small=True, omit_note=True)


# --- page lists ------------------------------------------------------------------------------------
@register
def collect_pages(spark, sf):
    objs = fx.objects(spark, sf)
    return pages.collect_pages(objs, objs.filter("parent_pid IS NULL"))


@register
def book_of_item(spark, sf):
    o = fx.objects(spark, sf)
    parent = o.select(F.col("pid").alias("parent_pid"), F.col("model").alias("p_model"), F.col("parent_pid").alias("g_pid"))
    node = lambda p, m: F.struct(p.alias("pid"), m.alias("model"))
    items = o.join(parent, "parent_pid", "left").select(
        "pid", "model", F.col("parent_pid").alias("root_pid"),
        F.when(F.col("g_pid").isNotNull(), F.array(F.array(
            node(F.col("g_pid"), F.lit("collection")), node(F.col("parent_pid"), F.col("p_model")), node(F.col("pid"), F.col("model"))))).alias("context"),
    )
    return pages.book_of_item(items)


@register
def page_enrich(spark, sf):
    p = fx.pages(spark, sf)
    listed = p.select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("page_number")).alias("page_number"),
                      F.when(F.col("page_id") % 2 == 0, F.col("title")).alias("title"), F.lit(None).cast("string").alias("page_side"))
    items = p.filter("page_id % 5 <> 0").selectExpr(
        "page_id", "title || ' i' AS title", "CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_number END AS number",
        "CASE WHEN page_id % 4 = 0 THEN page_side END AS side", "CASE WHEN page_id % 11 = 0 THEN 'map' ELSE 'page' END AS model")
    mods = p.selectExpr("page_id", "stack(4, 0L, 'PageNumber', page_number, 1L, 'PageIndex', cast(page_index as string), 2L, 'PageSide', page_side, 3L, 'Title', ' ' || title) AS (ord, label, value)")
    return pages.enrich_pages(listed, items, mods)


def _gaps(p, every):
    """The pages with a hole in their numbering after each run of ``every``."""
    return p.withColumn("page_index", F.col("page_index") + F.floor(F.col("page_index") / every))


@register
def page_pairs(spark, sf):
    return pages.page_pairs(_gaps(fx.pages(spark, sf), 7)).select("book_id", "page_index", "left_page", "right_page")


@register
def join_decide(spark, sf):
    s = fx.snippets(spark, sf).drop("page_id")
    a, b = (pages.join_decide(s, p).select("book_id", "page_index", F.col("decision").alias(p)) for p in ("server", "client"))
    return a.join(b, ["book_id", "page_index"])


def _joined(spark, sf):
    s = fx.snippets(spark, sf).drop("page_id")
    return pages.join_apply(s, pages.join_decide(s))


@register
def join_apply(spark, sf):
    return _joined(spark, sf)


@register
def stitch_context(spark, sf):
    return pages.stitch_context(fx.snippets(spark, sf))


@register
def select_pages(spark, sf):
    p = fx.pages(spark, sf)
    req = p.groupBy("book_id").agg(F.min("page_id").alias("p0"), F.max("page_id").alias("p1")).selectExpr(
        "book_id", "p1",
        "explode(array(struct('a' AS k, 'all' AS mode, '' AS expr), struct('b' AS k, 'current' AS mode, '' AS expr), "
        "struct('c' AS k, 'custom' AS mode, '5-9, 14,xiv-[20],30-24' AS expr), struct('d' AS k, 'custom' AS mode, '7,7,-6,foo' AS expr), "
        "struct('e' AS k, 'custom' AS mode, '1-3,nowhere' AS expr))) AS r",
    ).selectExpr("book_id || ':' || r.k AS request_id", "book_id", "r.mode AS mode", "r.expr AS expr", "p1 AS current_page")
    return pages.select_pages(p, req)


@register
def cover_page(spark, sf):
    return pages.cover_page(fx.pages(spark, sf))


@register
def locate_page(spark, sf):
    p = fx.pages(spark, sf).withColumn("page_key", F.concat(F.lit("P"), F.col("page_id")))
    items = p.select(F.concat(F.lit("p"), F.col("page_id") * 2).alias("item_key"), "book_id").unionByName(
        p.select(F.col("book_id").alias("item_key"), "book_id").distinct())
    return pages.locate_page(p, items)


@register
def pick_version(spark, sf):
    p = _docs(spark, sf).selectExpr("doc_id AS page_id", "CASE WHEN doc_id % 13 <> 0 THEN lower(text) END AS computed")
    v = _docs(spark, sf).filter("doc_id % 3 <> 0").selectExpr(
        "doc_id AS page_id", "CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'Fixed: ' || text END AS llm", "text AS python", "text AS ocr")
    return pages.pick_version(p, v, "llm", "html")


@register
def navigation(spark, sf):
    return pages.navigation(_gaps(fx.pages(spark, sf), 5))


@register
def ordered_distinct(spark, sf):
    ev = fx.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return pages.ordered_distinct(ev, ["user_id", "event_type"], ["event_id"])


@register
def label_lists(spark, sf):
    words = F.split(F.regexp_replace("text", r"[ \t\n\r]+", " "), " ")
    return _docs(spark, sf).select("doc_id", records.ordered_distinct_list(words, "; ").alias("labels"))


@register
def fetch_stats(spark, sf):
    return fx.table(spark, sf, "events").rollup("event_type").agg(F.count("*").alias("n")).select(
        F.coalesce("event_type", F.lit("total")).alias("kind"), "n")


# --- reading and search --------------------------------------------------------------------------
@register
def full_text(spark, sf):
    return search.full_text(fx.text_lines(spark, sf))


@register
def reading_blocks(spark, sf):
    return search.reading_blocks(fx.text_lines(spark, sf))


@register
def reading_blocks_v1(spark, sf):
    return search.reading_blocks_v1(fx.text_lines(spark, sf))


@register
def page_html_v1(spark, sf):
    return search.page_html_v1(fx.text_lines(spark, sf), F.col("font_size"))


@register
def word_boxes(spark, sf):
    """On each page the words of one benchmark text."""
    items = fx.table(spark, sf, "benchmark")
    n = items.count()
    q = _docs(spark, sf).select(F.col("doc_id").alias("page_id"), (F.col("doc_id") % n).alias("item_id")).join(items, "item_id").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), "page_id")
    hits = search.word_boxes(fx.tokens(fx.text_lines(spark, sf)), q, F.lit(0.5), F.lit(0.25))
    p = F.col("polygon")
    return hits.select(
        "query_id", "word_no", "page_id", "block_seq", "line_seq", "token_seq",
        p[0][0].alias("x0"), p[0][1].alias("y0"), p[2][0].alias("x1"), p[2][1].alias("y1"))


@register
def text_in_box(spark, sf):
    boxes = _docs(spark, sf).selectExpr(
        "doc_id AS page_id", "explode(array(struct(0L AS box_id, 0L AS x0, 0L AS y0, 1400L AS x1, 700L AS y1), "
        "struct(1L AS box_id, 160L AS x0, 300L AS y0, 5000L AS x1, 2000L AS y1))) AS b").selectExpr("page_id", "b.*")
    return search.text_in_box(fx.text_lines(spark, sf), boxes)


# --- corrections and differences -----------------------------------------------------------------
def _changes(spark, sf):
    bad = fx.blocks(spark, sf).filter("page_id % 97 = 5").selectExpr("page_id", "ord + 100000 AS ord", "' ' AS block_id", "text")
    return fx.changes(fx.blocks(spark, sf)).unionByName(bad)


def _versions(spark, sf):
    b = fx.blocks(spark, sf)
    return b, corrections.apply_changes(b.drop("book_id"), fx.changes(b))


@register
def apply_changes(spark, sf):
    return corrections.apply_changes(fx.blocks(spark, sf).drop("book_id"), _changes(spark, sf))


@register
def doc_payload(spark, sf):
    b = fx.blocks(spark, sf)
    as_json = corrections.doc_payload(b, F.lit("cs")).select("page_id", F.col("payload").alias("document"))
    as_text = corrections.doc_payload(b, F.lit("cs"), "text").select("page_id", F.col("payload").alias("plain"), "error")
    return as_json.join(as_text, "page_id")


@register
def doc_diff(spark, sf):
    l, r = _versions(spark, sf)  # noqa: E741
    return diff.doc_diff(l, r)


@register
def diff_summary(spark, sf):
    l, r = _versions(spark, sf)  # noqa: E741
    return diff.diff_summary(diff.doc_diff(l, r))


@register
def block_sets(spark, sf):
    l, r = _versions(spark, sf)  # noqa: E741
    return diff.block_sets(l, r)


def _changed(spark, sf):
    l, r = _versions(spark, sf)  # noqa: E741
    return diff.doc_diff(l, r).filter("change = 'changed'")


@register
def diff_tokens(spark, sf):
    c = _changed(spark, sf)
    words = diff.diff_tokens(c, "left_html", ["page_id", "block_id"])
    chars = diff.diff_tokens(c, "left_html", ["page_id", "block_id"], "char").groupBy("page_id", "block_id").agg(
        F.count("*").alias("n_chars"))
    return words.join(chars, ["page_id", "block_id"])


def _reworded(spark, sf):
    """Changed blocks; on every third page the first word has moved to the end."""
    moved = F.regexp_replace("right_html", r"^(<[^>]+>)([^\s<]+) ([^<]+)", "$1$3 $2")
    return _changed(spark, sf).withColumn("right_html", F.when(F.col("page_id") % 3 == 0, moved).otherwise(F.col("right_html")))


@register
def token_diff(spark, sf):
    return diff.token_diff(_reworded(spark, sf), "left_html", "right_html", ["page_id", "block_id"])


@register
def diff_markup(spark, sf):
    return diff.diff_markup(_reworded(spark, sf), "left_html", "right_html", ["page_id", "block_id"])


@register
def align_blocks(spark, sf):
    """A group of 3 to 10 paragraphs stands before the others, on a third of the pages left, on a third right."""
    l, r = _versions(spark, sf)  # noqa: E741

    def markup(df, rest):
        html = M.block_html(F.col("type"), F.col("text"), F.col("block_id"), "client")
        shift = F.when(F.col("page_id") % 3 == rest, 3 + F.col("page_id") % 8).otherwise(0)
        more = _docs(spark, sf).filter(f"doc_id % 3 = {rest}").selectExpr("doc_id AS page_id", "explode(sequence(0, 2 + doc_id % 8)) AS ord").select(
            "page_id", "ord", F.format_string("<p>Inserted paragraph %d of page %d with words number %d</p>", "ord", "page_id", F.col("ord") * 7).alias("html"))
        return df.select("page_id", (F.col("ord") + shift).alias("ord"), html.alias("html")).unionByName(more)

    a = diff.align_blocks(markup(l, 1), markup(r, 0))
    return a.select("page_id", "left_ord", "right_ord", F.col("left_n").cast("bigint").alias("left_n"),
                    F.col("right_n").cast("bigint").alias("right_n"), F.bround("similarity", 6).alias("similarity"), "change")


@register
def response_extract(spark, sf):
    """Six shapes of responses, by turn."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    usage = F.struct(F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"), (F.length("text") + F.col("turn")).alias("total_tokens")).alias("usage")
    message = lambda content: F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"), F.lit("length").alias("finish_reason"))).alias("choices"), usage))
    spoken = F.array(part("output_text", F.col("text")), part("reasoning", F.lit("hidden")), part("text", F.lit("end"))).alias("content")
    nested = F.array(part("text", F.struct(F.col("text").alias("value"))), part("reasoning", F.struct(F.lit("hidden").alias("value")))).alias("content")
    body = (
        F.when(F.col("turn") % 6 == 0, F.to_json(F.struct(F.array(F.struct(spoken, F.lit("stop").alias("stop_reason"))).alias("output"), usage)))
        .when(F.col("turn") % 6 == 1, message(F.col("text")))
        .when(F.col("turn") % 6 == 2, F.to_json(F.struct(F.array().alias("output"), F.array(F.struct(nested)).alias("outputs"), usage)))
        .when(F.col("turn") % 6 == 3, F.to_json(F.struct(F.col("text").alias("output_text"), F.array(F.struct(spoken)).alias("output"))))
        .when(F.col("turn") % 6 == 4, message(F.array(F.struct(F.col("text").alias("text")), F.struct(F.lit("more").alias("text")))))
        .otherwise(F.concat(F.lit("{"), F.col("text"))))
    return _talk(spark, sf).select("page_id", M.response_extract(body).alias("r")).select("page_id", "r.*")


@register
def join_sections(spark, sf):
    """Eight forms of join answers, by page and turn."""
    js = lambda c: F.to_json(F.struct(c)).substr(F.lit(6), F.length(F.to_json(F.struct(c))) - 6)  # noqa: E731 - {"t":...} without its frame
    text = js(F.col("text").alias("t"))
    answer = (
        F.when(F.col("k") == 0, F.lit(" 1 "))
        .when(F.col("k") == 1, F.concat(F.lit('```json\n{"pairs":{"start":{"action":"Merge","merged":{"text":'), text, F.lit(',"tag":"h2"}},"end":{"action":"0"}}}\n```')))
        .when(F.col("k") == 2, F.concat(F.lit('[{"note":1},{"decision":"","action":"join"},"split"]')))
        .when(F.col("k") == 3, F.concat(F.lit('{"sections":{"start":{"merged_text":'), text, F.lit(',"tag":"p"},"end":{"blocks":[{"text":"one  two"},{"text":" "},{"text":"three"}],"split":true}}}')))
        .when(F.col("k") == 4, F.lit('{"pairs":{"start":{"action":"maybe"}},"decision":2}'))
        .when(F.col("k") == 5, F.concat(F.lit('{"end":"  both\nlines ","start":""}')))
        .when(F.col("k") == 6, F.concat(F.lit('{"start":{"merged":'), text, F.lit("}}")))
        .otherwise(F.concat(F.lit("?"), F.col("text"))))
    rows = _talk(spark, sf).withColumn("k", (F.col("page_id") + F.col("turn")) % 8)
    return rows.select("page_id", F.inline(M.join_sections(answer)))


@register
def correction_validate(spark, sf):
    item = F.expr(
        "CASE (page_id + ord) % 4 WHEN 0 THEN to_json(struct(block_id AS id, text)) WHEN 1 THEN to_json(struct(block_id AS id, text, 1 AS extra)) "
        "WHEN 2 THEN to_json(struct('x' || block_id AS id, text)) ELSE to_json(struct(block_id AS id)) END")
    answer = F.when(F.col("ord") % 13 == 0, F.lit('{"changes":{}}')).otherwise(F.concat(F.lit('{"changes":['), item, F.lit("]}")))
    return fx.blocks(spark, sf).select("page_id", "ord", M.validate_changes(answer).alias("v")).select("page_id", "ord", "v.*")


def _agents(spark, sf):
    """Agent files made from parts: every ninth is unreadable."""
    values = "named_struct('temperature', p_retailprice / 500, 'top_p', cast(NULL as double), 'reasoning_effort', 'HIGH', 'max_output_tokens', p_partkey * 300)"
    files = fx.table(spark, sf, "part").selectExpr(
        "'agent' || p_partkey AS name",
        f"""CASE WHEN p_partkey % 9 = 0 THEN '{{broken' ELSE to_json(named_struct('name', 'agent' || p_partkey, 'display_name', p_name,
            'prompt', 'Fix ' || p_type, 'model', 'm' || p_size % 5, 'temperature', p_size / 100, 'top_p', 0.5D, 'settings', named_struct(
            'defaults', CASE WHEN p_partkey % 2 = 0 THEN {values} END,
            'per_model', CASE WHEN p_partkey % 3 = 0 THEN map('m0', {values}) END))) END AS json""")
    return records.settings(files)


@register
def settings_scan(spark, sf):
    return _agents(spark, sf).select("name", "display_name", "prompt", "model", "temperature", "top_p")


def _settings(spark, sf):
    models = fx.table(spark, sf, "part").selectExpr("'m' || p_size % 5 AS model", "p_size % 5 AS k").distinct().filter("k < 4").selectExpr(
        "model", "k <> 1 AS can_temperature", "k <> 2 AS can_top_p", "k = 3 AS can_reasoning",
        "cast(NULL as double) AS m_temperature", "0.9D AS m_top_p", "'low' AS m_reasoning_effort", "cast(NULL as bigint) AS m_max_output_tokens")
    over = fx.table(spark, sf, "part").filter("p_partkey % 10 = 1").selectExpr(
        "'agent' || p_partkey AS name", "0.7D AS o_temperature", "cast(NULL as double) AS o_top_p", "cast(NULL as string) AS o_reasoning_effort")
    return corrections.effective_settings(_agents(spark, sf).filter("model IS NOT NULL"), models, over)


@register
def effective_settings(spark, sf):
    return _settings(spark, sf)


def _request_models(spark, sf):
    """Five models: upstream ids of the provider's own and of others, none, and one that is not registered."""
    registry = fx.table(spark, sf, "part").selectExpr("p_size % 5 AS k").distinct().filter("k < 4").selectExpr(
        "' M' || k || ' ' AS model", "CASE k WHEN 2 THEN NULL WHEN 3 THEN 'base-3' ELSE 'openai/base-' || k END AS upstream", "CASE k WHEN 1 THEN 'Other' ELSE ' OpenAI' END AS provider")
    return corrections.request_models(_settings(spark, sf), registry)


@register
def model_scope(spark, sf):
    return _request_models(spark, sf).select("name", "model", "provider", "request_model")


@register
def llm_requests(spark, sf):
    """Each page goes to the agent its id selects."""
    agents = _agents(spark, sf).filter("model IS NOT NULL")
    n = fx.table(spark, sf, "part").count()
    picked = agents.withColumn("agent", F.regexp_extract("name", "([0-9]+)$", 1).cast("bigint"))
    payloads = corrections.doc_payload(fx.blocks(spark, sf), F.lit("cs")).withColumn("agent", F.col("page_id") % n)
    return corrections.requests(payloads, _request_models(spark, sf), picked.select("agent", "name", "prompt"))


@register
def llm_results(spark, sf):
    """Answers of all kinds: changes, whole documents, plain text, nothing, unusable."""
    b = fx.blocks(spark, sf)
    ch = fx.changes(b).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "block_id", "text"))).alias("c"))
    changes = F.to_json(F.struct(F.transform("c", lambda x: F.struct(x.block_id.alias("id"), x.text.alias("text"))).alias("changes")))
    text = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("```json\n"), changes, F.lit("\n```"))).when(
        F.col("page_id") % 5 == 1, F.lit('{"blocks":[{"id":"b1","type":"h1","text":"New"},{"id":"b2","type":"p","text":"page"}]}')).when(
        F.col("page_id") % 5 == 2, F.lit("Plain answer")).when(F.col("page_id") % 5 == 3, F.lit("")).otherwise(
        F.lit('{"changes":[{"id":"zz","text":"x"}]}'))
    response = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))
    return corrections.results(ch.select("page_id", response.alias("response")), b.drop("book_id"))


@register
def page_versions(spark, sf):
    return corrections.page_versions(fx.blocks(spark, sf))


@register
def compare_versions(spark, sf):
    b, fixed = _versions(spark, sf)
    v = lambda df: corrections.page_versions(df)
    return corrections.compare_versions(v(b), v(fixed.filter("page_id % 3 <> 0")), v(b.filter("page_id % 4 = 1 AND type <> 'note'")))


# --- exports -------------------------------------------------------------------------------------
@register
def export_txt(spark, sf):
    return export.to_text(_joined(spark, sf))


@register
def export_md(spark, sf):
    return export.to_markdown(_joined(spark, sf))


@register
def export_html(spark, sf):
    p = fx.pages(spark, sf)
    titles = p.filter("book_id <> 'src1'").select("book_id").distinct().select("book_id", F.concat(F.lit("Kniha "), F.col("book_id")).alias("title"))
    return export.to_html(_joined(spark, sf), p, titles)


@register
def chapters(spark, sf):
    return export.chapters(_joined(spark, sf))


@register
def export_name(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", T.export_name(
        F.when(F.col("p_partkey") % 4 == 0, F.concat("p_brand", F.lit(".txt"))), F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit(" "), F.col("p_name"))),
        F.lower("p_type"), F.lit("epub")).alias("file_name"))


# --- illustrations ---------------------------------------------------------------------------------
@register
def illustration_backfill(spark, sf):
    i = fx.illustrations(spark, sf)
    box = F.expr("cast(x as bigint) || ',' || cast(y as bigint) || ',' || cast(w as bigint) || ',' || cast(h as bigint)")
    size = lambda c: F.lit(c).cast("bigint")
    src = i.filter("seq < 2").select("page_id", "seq", box.alias("bbox"), size(fx.PAGE_W).alias("page_w"), size(fx.PAGE_H).alias("page_h"), F.concat(F.lit("u"), F.col("seq")).alias("uuid"))
    notes = i.select(
        "page_id", F.col("seq").alias("ord"), F.when(F.col("seq") == 0, box).alias("bbox"), F.when(F.col("seq") == 0, size(7)).alias("page_w"),
        F.when(F.col("seq") == 0, size(8)).alias("page_h"), F.lit(None).cast("string").alias("uuid"),
        F.concat(F.lit("Ilustrace: bbox="), box, F.lit(" page=11x12")).alias("text"))
    return illustrations.illustration_backfill(notes, src)


# --- sources -------------------------------------------------------------------------------------
def _parsed(spark, sf):
    return page_xml.parse(fx.page_xml(spark, sf))


@register
def scan_pages(spark, sf):
    return page_xml.geometry(_parsed(spark, sf))


@register
def layout_tokens(spark, sf):
    lines = page_xml.layout_lines(_parsed(spark, sf))
    return fx.tokens(lines).drop("book_id").withColumn("token_seq", F.col("line_seq") * 0 + F.col("token_seq"))


@register
def styles(spark, sf):
    return page_xml.styles(_parsed(spark, sf))


@register_as("illustrations")
def illustrations_scan(spark, sf):
    return page_xml.illustrations(_parsed(spark, sf))


def _mods_xml(spark, sf):
    """Metadata records made from parts and their names."""
    return fx.table(spark, sf, "part").selectExpr(
        "p_partkey AS pid",
        """'<m:mods xmlns:m="http://www.loc.gov/mods/v3"><m:titleInfo><m:title>' || p_name || '</m:title><m:subTitle>' || p_type || '</m:subTitle>'
        || CASE WHEN p_partkey % 3 = 0 THEN '<m:partNumber>' || p_size || '</m:partNumber>' ELSE '' END || '</m:titleInfo>'
        || '<m:name><m:namePart> ' || p_brand || '</m:namePart><m:namePart type="date">18' || p_size || '</m:namePart><m:role><m:roleTerm>aut</m:roleTerm></m:role></m:name>'
        || CASE WHEN p_partkey % 2 = 0 THEN '<m:name><m:namePart>Second</m:namePart><m:namePart>Name</m:namePart></m:name>' ELSE '' END
        || '<m:originInfo><m:publisher>' || p_brand || '</m:publisher><m:place><m:placeTerm>Praha</m:placeTerm></m:place>' ||
        CASE WHEN p_partkey % 5 = 0 THEN '<m:edition>2</m:edition>' ELSE '' END || '</m:originInfo>'
        || '<m:language><m:languageTerm>cze</m:languageTerm></m:language><m:language><m:languageTerm>cze</m:languageTerm></m:language>'
        || '<m:identifier type="isbn">' || p_partkey || '</m:identifier><m:identifier>x' || p_size || '</m:identifier>'
        || '<m:note>' || CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'n' || p_size END || '</m:note><m:note>two</m:note>'
        || '<m:part><m:detail type="pageNumber"><m:number>' || p_size || '</m:number></m:detail></m:part></m:mods>' AS xml""",
    )


@register
def mods_entries(spark, sf):
    return records.mods_entries(_mods_xml(spark, sf))


@register
def authors(spark, sf):
    return records.authors(records.mods_entries(_mods_xml(spark, sf)))


@register
def manifest_pages(spark, sf):
    """Manifests of the customers' orders as page lists, a hundred orders to a manifest."""
    canvas = """'{"id":"https://x/uuid:b' || g || '/c","label":' || CASE o_orderkey % 3 WHEN 0 THEN '{"none":["' || o_orderkey || ' (verso)"]}'
        WHEN 1 THEN '"' || o_orderkey || '"' ELSE '{"cs":["[' || o_orderkey || ']"]}' END
        || CASE WHEN o_orderkey % 4 = 0 THEN ',"thumbnail":[{"id":"https://x/items/uuid:AB' || o_orderkey || '/thumb"}]'
                WHEN o_orderkey % 4 = 1 THEN ',"items":[{"items":[{"body":{"id":"z","service":[{"@id":"s/uuid:cd' || o_orderkey || '"}]}}]}]' ELSE '' END || '}'"""
    rows = fx.table(spark, sf, "orders").selectExpr("o_orderkey", "cast(floor(o_orderkey / 100) as bigint) AS g").selectExpr("g", "o_orderkey", f"{canvas} AS c")
    docs = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "c"))).alias("cs")).select(
        F.concat(F.lit("uuid:b"), F.col("g")).alias("book_id"),
        F.concat(F.lit('{"items":['), F.array_join(F.transform("cs", lambda x: x.c), ","), F.lit("]}")).alias("json"))
    return records.manifest_pages(docs)


@register
def objects_scan(spark, sf):
    """Objects given as info and structure JSON; orders without a customer parent keep their own record."""
    rec = fx.table(spark, sf, "orders").selectExpr(
        "'o' || o_orderkey AS pid",
        """CASE WHEN o_orderkey % 2 = 0 THEN to_json(named_struct('model', 'page', 'title', 'T' || o_orderkey, 'details', map('pagenumber', cast(o_orderkey as string)))) END AS info""",
        """to_json(named_struct('model', 'monograph', 'parents', named_struct('own', named_struct('pid', 'c' || o_custkey, 'relation', 'hasPage')),
           'children', named_struct('own', array(named_struct('pid', 'k1', 'model', 'page'), named_struct('pid', 'k2', 'model', cast(NULL as string))),
           'foster', array(named_struct('pid', 'f' || o_custkey, 'type', 'unit'))))) AS structure""",
    )
    o = records.objects(rec)
    kids = records.object_children(o).groupBy("parent_pid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(":", "pid", "model").alias("k")))), lambda x: x.k), ",").alias("children"))
    return o.select("pid", "model", "title", "root_pid", F.get(F.get("context", F.lit(0)), F.lit(0))["model"].alias("context_model")).join(
        kids, F.col("pid") == F.col("parent_pid")).drop("parent_pid")


# --- progress ------------------------------------------------------------------------------------
@register
def job_runs(spark, sf):
    """Runs of jobs, parted by pauses of an hour or more, with the progress each ended with."""
    p = progress.job_progress(fx.job_events(spark, sf), idle="1 hour")
    return p.withColumn("percent", F.bround("percent", 6)).withColumn("eta_seconds", F.bround("eta_seconds", 3))


@register
def job_progress(spark, sf):
    p = progress.job_progress(fx.job_events(spark, sf))
    return p.withColumn("percent", F.bround("percent", 6)).withColumn("eta_seconds", F.bround("eta_seconds", 3))
