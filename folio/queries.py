"""Registered queries: name -> (spark, data folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import fixtures as fx
from folio.functions import text as T
from folio.operators import headings, illustrations, layout, page_numbers, style
from folio.plans import formatter
from folio.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def register_as(name: str):
    """Register under a name other than the function's."""
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


def page_w():
    return F.lit(fx.PAGE_W)


@register
def fx_pages(spark, sf):
    return fx.pages(spark, sf)


@register
def fx_tokens(spark, sf):
    return fx.tokens(fx.lines(spark, sf))


@register
def fx_lines(spark, sf):
    return fx.lines(spark, sf).select(
        "page_id", "book_id", "block_seq", "line_seq", "hpos", "vpos", "width", "height", "bottom", "font_size"
    )


@register
def layout_thresholds(spark, sf):
    return layout.layout_thresholds(fx.text_lines(spark, sf)).select(
        "page_id", "block_seq", "med_h", "med_w", "med_gap", "med_shift", "vthr", "hthr"
    )


@register
def vgap_segments(spark, sf):
    return layout.vgap_segments(fx.text_lines(spark, sf)).select(
        "page_id", "block_seq", "line_seq", "gap", "vthr", "hthr", "vgroup"
    )


@register
def centered_groups(spark, sf):
    grouped = layout.vgap_segments(fx.text_lines(spark, sf))
    return layout.centered_groups(grouped, page_w()).select(
        "page_id", "block_seq", "line_seq", "vgroup", "group_centered", "block_centered"
    )


@register
def effective_left(spark, sf):
    return layout.read_words(fx.text_lines(spark, sf)).select(
        "page_id", "block_seq", "line_seq", "text", "eff_left", "bold"
    )


def _cut(spark, sf):
    grouped = layout.vgap_segments(layout.read_words(fx.text_lines(spark, sf)))
    return layout.hshift_segments(layout.centered_groups(grouped, page_w()))


@register
def hshift_segments(spark, sf):
    return _cut(spark, sf).select("page_id", "block_seq", "line_seq", "step", "b_first", "b_shift")


@register
def center_split(spark, sf):
    return _cut(spark, sf).select("page_id", "block_seq", "line_seq", "b_center")


@register
def indent_split(spark, sf):
    return layout.indent_split(_cut(spark, sf)).select(
        "page_id", "block_seq", "line_seq", "seg", "sub", "single", "centered", "split_reason"
    )


@register
def hyphen_merge(spark, sf):
    return layout.hyphen_merge(layout.segment_lines(fx.text_lines(spark, sf), page_w())).select(
        "page_id", "block_seq", "line_seq", "text", F.size("words").cast("bigint").alias("n_words"),
    )


@register
def page_blocks(spark, sf):
    return layout.page_blocks(fx.text_lines(spark, sf), page_w()).select(
        "page_id", "book_id", "block_no", "text", "centered", "all_bold", "line_count", "split_reason",
        "top", "left", "max_font", F.size("words").cast("bigint").alias("n_words"),
    )


def page_h():
    return F.lit(fx.PAGE_H)


@register
def sample_pages(spark, sf):
    return style.sample_pages(fx.pages(spark, sf)).select("book_id", "page_id", "page_index")


@register
def wave_sample(spark, sf):
    out = None
    for wave in range(3):
        one = style.wave_sample(fx.pages(spark, sf), wave).select(
            "book_id", "page_id", F.lit(wave).alias("wave"), F.col("pos").cast("bigint").alias("pos")
        )
        out = one if out is None else out.unionByName(one)
    return out


@register
def text_pages(spark, sf):
    return style.text_pages(fx.pages(spark, sf)).select("book_id", "page_id", "page_type", "title")


@register
def page_mode_height(spark, sf):
    return style.page_mode_height(fx.text_lines(spark, sf))


def _style(spark, sf, pages):
    sample = style.sample_pages(pages).select("book_id", "page_id", "page_index")
    return style.book_style(fx.text_lines(spark, sf, sample), sample, pages)


@register
def book_style(spark, sf):
    return _style(spark, sf, materialise(fx.pages(spark, sf)))


@register
def font_hist(spark, sf):
    return style.font_hist(fx.text_lines(spark, sf))


@register
def heading_fonts(spark, sf):
    return style.heading_fonts(fx.styles(spark, sf), style.font_hist(fx.text_lines(spark, sf)))


@register
def line_font(spark, sf):
    return layout.line_font(fx.text_lines(spark, sf), fx.styles(spark, sf)).select(
        "page_id", "block_seq", "line_seq", "style_id", "font_size"
    )


def _font():
    """What names the style of a line's words."""
    return F.concat(F.lit("X, "), F.element_at(F.split("block_style_refs", " "), 2), F.lit("; "))


@register
def token_style(spark, sf):
    words = fx.text_lines(spark, sf).select("page_id", _font().alias("font"), F.explode_outer("tokens").alias("t"))
    return style.token_style(words.select(
        "page_id", F.col("t.seq").alias("token_seq"), F.concat("font", "t.style").alias("style"), "t.height"), fx.styles(spark, sf))


def _styled(lines):
    """Every other word names its style, the rest only has a height."""
    named = lambda t, font: F.concat(F.when(t["seq"] % 2 == 0, font).otherwise(""), t["style"])
    return lines.withColumn("tokens", T.let(_font(), lambda font: F.transform("tokens", lambda t: t.withField("style", named(t, font)))))


@register
def block_font_stats(spark, sf):
    return style.block_font_stats(_styled(fx.text_lines(spark, sf)), fx.styles(spark, sf), ["page_id", "block_seq"])


@register
def paragraph_font_stats(spark, sf):
    """The lines keep their words while they are cut into paragraphs, so they meet nothing again."""
    cut = layout.segment_lines(fx.text_lines(spark, sf), page_w()).filter("page_id IS NOT NULL")
    return style.block_font_stats(_styled(cut), fx.styles(spark, sf), ["page_id", "block_seq", "seg"])


@register
def counter_confidence(spark, sf):
    words = fx.text_lines(spark, sf).select("page_id", F.explode("tokens").alias("t"))
    counts = words.groupBy("page_id", F.col("t.height").alias("h")).agg(F.count("*").alias("cnt"))
    return style.counter_confidence(counts, "page_id", "cnt")


def _context(spark, sf):
    pages = materialise(fx.pages(spark, sf))
    return formatter.page_context(pages, _style(spark, sf, pages), fx.styles(spark, sf))


@register
def page_number_notes(spark, sf):
    pages = materialise(fx.pages(spark, sf))
    lines = fx.lines(spark, sf, pages).join(pages.select("page_id", "page_number"), "page_id", "left")
    return page_numbers.page_number_notes(page_numbers.flag_lines(lines, page_w()), pages, page_h())


def _raw_blocks(spark, sf):
    ctx = _context(spark, sf).select("page_id", "average_height", "cut")
    return layout.page_blocks(fx.text_lines(spark, sf), page_w()).join(ctx, "page_id", "left")


@register
def heading_class(spark, sf):
    return headings.heading_class(_raw_blocks(spark, sf)).select("page_id", "block_no", "tag")


@register
def heading_merge(spark, sf):
    """Six blocks in a row share an id and count as unsplit here, so that merges occur."""
    shared = headings.heading_class(_raw_blocks(spark, sf)).withColumn(
        "source_block_id", F.concat(F.lit("s"), F.floor(F.col("block_no") / 6).cast("string"))
    ).withColumn("split_reason", F.lit(None).cast("string"))
    return headings.heading_merge(shared).select("page_id", "block_no", "tag", "text", "centered", "all_bold", "line_count")


@register
def single_line_center(spark, sf):
    return headings.single_line_center(layout.page_blocks(fx.text_lines(spark, sf), page_w())).select(
        "page_id", "block_no", "centered"
    )


@register
def h3_class(spark, sf):
    return headings.h3_class(headings.heading_class(_raw_blocks(spark, sf))).select("page_id", "block_no", "tag")


@register
def small_class(spark, sf):
    return headings.small_class(headings.h3_class(headings.heading_class(_raw_blocks(spark, sf)))).select(
        "page_id", "block_no", "tag"
    )


@register
def block_fragment(spark, sf):
    b = headings.single_line_center(headings.heading_class(_raw_blocks(spark, sf)))
    return b.select("page_id", "block_no", formatter.fragment(F.col("tag"), F.col("text"), F.col("centered")).alias("html"))


@register
def illustration_dedupe(spark, sf):
    return illustrations.illustration_dedupe(fx.illustrations(spark, sf))


@register
def page_html(spark, sf):
    pages = materialise(fx.pages(spark, sf))
    return formatter.page_html(
        lambda only: fx.lines(spark, sf, pages, only), pages, fx.styles(spark, sf), fx.illustrations(spark, sf), page_w(), page_h()
    )
