"""Typical text size of a book, and the sizes that mark headings on a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.ordering import with_rank

# Fixed values.
SAMPLE_PAGES = 5
MIN_PAGE_WORDS = 20
WAVE_SIZE = 10
WAVE_OFFSETS = [0.0, 0.5, 0.25]
HEADING_FONT_GAP = 1.2
HEADING_FONT_MAX_SHARE = 0.4


def text_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(T.is_text_page("page_type", "title"))


def _ranked_text_pages(pages: DataFrame) -> DataFrame:
    """Text pages with their rank in the book and the book's number of text pages."""
    kept = text_pages(pages)
    sizes = kept.groupBy("book_id").agg(F.count("*").alias("n"))
    return with_rank(kept, "book_id", "page_index").join(sizes, "book_id")


def sample_pages(pages: DataFrame, k: int = SAMPLE_PAGES) -> DataFrame:
    """At most ``k`` text pages of each book, evenly spread from the first to the last.

    Page r is taken if r = floor(i (n-1) / (m-1)) for some i below m = min(k, n).
    """
    m = F.least(F.lit(k), F.col("n"))
    picks = F.transform(
        F.sequence(F.lit(0).cast("bigint"), m - 1),
        lambda i: F.when(m > 1, F.floor(i * (F.col("n") - 1) / F.nullif(m - 1, F.lit(0)))).otherwise(F.lit(0)),
    )
    return _ranked_text_pages(pages).filter(F.array_contains(picks, F.col("rank"))).drop("n", "rank")


def wave_sample(pages: DataFrame, wave: int, m: int = WAVE_SIZE) -> DataFrame:
    """Pages of one sampling wave: fraction (i+1+offset)/(m+1) of the book, first hit of a page counts."""
    off = WAVE_OFFSETS[wave] if wave < len(WAVE_OFFSETS) else 0.0
    n = F.col("n")
    size = F.least(F.lit(m), n)
    fraction = lambda i: F.least((i + 1 + off) / (size + 1), F.lit(0.999))
    spots = F.transform(
        F.sequence(F.lit(0).cast("bigint"), size - 1),
        lambda i: F.bround(fraction(i) * (n - 1), 0).cast("bigint"),
    )
    pos = F.array_position(F.array_distinct(spots), F.col("rank"))
    return _ranked_text_pages(pages).withColumn("pos", pos).filter("pos > 0").drop("n", "rank")


def page_mode_height(lines: DataFrame, min_words: int = MIN_PAGE_WORDS) -> DataFrame:
    """Most frequent word height of a page (one decimal, first seen on a tie); sparse pages give no row."""
    words = lines.select(
        "page_id", "block_seq", "line_seq", F.explode(F.filter("tokens", lambda t: t["height"].isNotNull())).alias("t")
    )
    per_height = words.groupBy("page_id", F.bround("t.height", 1).alias("h")).agg(
        F.count("*").alias("cnt"), F.min(F.struct("block_seq", "line_seq", "t.seq")).alias("first_at")
    )
    rank = F.struct(-F.col("cnt"), F.col("first_at"))
    return (
        per_height.groupBy("page_id")
        .agg(F.min_by("h", rank).alias("mode_height"), F.sum("cnt").alias("words"))
        .filter(F.col("words") >= min_words)
    )


def book_style(sampled_lines: DataFrame, sample: DataFrame, pages: DataFrame) -> DataFrame:
    """Typical word height of every book from its sampled pages, with a confidence.

    ``sampled_lines`` are the lines of the pages in ``sample`` (see :func:`sample_pages`) only: the
    choice is made on the page list, before any page is unfolded.
    """
    modes = page_mode_height(sampled_lines)
    counts = sampled_lines.groupBy("page_id").agg(F.count("*").alias("lines"))
    used = sample.join(modes, "page_id").join(counts, "page_id")
    mean = F.avg("mode_height")
    spread = F.when(mean != 0, F.stddev_pop("mode_height") / F.nullif(mean, F.lit(0.0))).otherwise(F.lit(0.0))
    certain = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - spread))
    per_book = used.groupBy("book_id").agg(
        F.bround(mean, 2).alias("average_height"),
        F.bround(certain * 100, 0).cast("bigint").alias("confidence"),
        F.count("*").alias("pages_used"),
        F.sum("lines").alias("lines_sampled"),
        F.sum("words").alias("words_sampled"),
        F.count_distinct("mode_height").alias("distinct_styles"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("page_index", "page_id"))), lambda x: x.page_id.cast("string")
            ),
            ",",
        ).alias("sampled_pages"),
    )
    zero = F.lit(0).cast("bigint")
    return pages.select("book_id").distinct().join(per_book, "book_id", "left").select(
        "book_id",
        "average_height",
        *[F.coalesce(c, zero).alias(c) for c in (
            "confidence", "pages_used", "lines_sampled", "words_sampled", "distinct_styles")],
        F.coalesce("sampled_pages", F.lit("")).alias("sampled_pages"),
    )


def font_hist(lines: DataFrame) -> DataFrame:
    """Characters (no spaces) of each page by line font size."""
    resolved = lambda t: T.hyp_resolve(t.content, t.subs_content, t.subs_type)
    chars = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + T.nonspace_len(resolved(t)))
    return (
        lines.filter("width > 0")
        .withColumn("chars", chars)
        .groupBy("page_id", "font_size")
        .agg(F.sum("chars").alias("chars"))
    )


def heading_cut(styles: DataFrame) -> DataFrame:
    """Per page the smallest size above the first wide gap of its style table; no gap, the largest size."""
    sizes = F.sort_array(F.collect_set("font_size"), asc=False)
    gap_at = F.filter(
        F.sequence(F.lit(1), F.size("sizes") - 1),
        lambda i: F.element_at("sizes", i) > F.element_at("sizes", i + 1) * HEADING_FONT_GAP,
    )
    first_gap = F.when(F.size("sizes") > 1, F.get(gap_at, F.lit(0)))
    return (
        styles.groupBy("page_id")
        .agg(sizes.alias("sizes"))
        .filter(F.size("sizes") > 0)
        .select("page_id", F.element_at("sizes", F.coalesce(first_gap, F.lit(1))).alias("cut"))
    )


def heading_fonts(styles: DataFrame, hist: DataFrame) -> DataFrame:
    """Sizes that mark headings: those from the cut up, if they hold at most 40% of the characters."""
    cut = heading_cut(styles)
    share = hist.join(cut, "page_id").groupBy("page_id", "cut").agg(
        F.sum(F.when(F.col("font_size") >= F.col("cut"), F.col("chars")).otherwise(0)).alias("head"),
        F.sum("chars").alias("total"),
    )
    ok = share.filter("total > 0").filter(F.col("head") / F.col("total") <= HEADING_FONT_MAX_SHARE)
    return (
        styles.select("page_id", "font_size").distinct()
        .join(ok.select("page_id", "cut"), "page_id")
        .filter("font_size >= cut")
        .select("page_id", "font_size")
    )


def style_map(styles: DataFrame) -> DataFrame:
    """Style table of each page as one map, with what a style says of its words read off it."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    entry = F.struct("style_id", F.struct(
        "font_size", T.clean_text(F.coalesce("font_family", F.lit(""))).alias("family"),
        low("font_weight").contains("bold").alias("bold"), low("font_style").contains("italic").alias("italic")))
    return styles.groupBy("page_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_styles"))


def _signed(words: DataFrame, styles: DataFrame) -> DataFrame:
    """``words`` (page_id, style, height, ...) with size, weight, slant, family and style id of each.

    The maps of a part's pages are held, so that the words need no sort; each is looked up once.
    """
    attr = F.lower(F.coalesce("style", F.lit("")))
    ids = F.transform(F.split(F.trim(F.coalesce("style", F.lit(""))), r"\s+"), lambda x: F.btrim(x, F.lit(" ,;")))
    known = F.get(F.filter(ids, lambda x: F.map_contains_key("_styles", x)), F.lit(0))
    looked_up = (
        words.join(style_map(styles).hint("shuffle_hash"), "page_id", "left")
        .withColumn("_known", known)
        .withColumn("_own", F.try_element_at("_styles", "_known"))
    )
    no = F.lit(False)
    return looked_up.withColumns({
        "size": F.bround(F.coalesce("_own.font_size", "height"), 2),
        "bold": attr.contains("bold") | F.coalesce("_own.bold", no),
        "italic": attr.contains("italic") | F.coalesce("_own.italic", no),
        "font_family": F.coalesce("_own.family", F.lit("")),
        "style_id": F.coalesce("_known", F.lit("")),
    }).drop("_styles", "_known", "_own")


def token_style(tokens: DataFrame, styles: DataFrame) -> DataFrame:
    """Style of a word: the first id in its style list that the page declares; size from there, else its height."""
    return _signed(tokens.select("page_id", "token_seq", "style", "height"), styles).drop("style", "height")


def block_font_stats(lines: DataFrame, styles: DataFrame, keys: list[str], min_chars: int = 40) -> DataFrame:
    """Per page and size, what the text units hold whose dominant size it is.

    A unit (``keys``) counts if it has ``min_chars`` characters in all; of these only those of its dominant size (most
    characters, ties to the first seen) are added up: all, bold and italic ones, the family most of them are
    set in, the units and their lines with text.  Words of a line that say the same of their style are one before it is looked up.
    """
    word = lines.select(*keys, "line_seq", F.explode_outer("tokens").alias("t")).select(
        *keys, "line_seq", "t.seq", "t.style", "t.height", T.nonspace_len(T.hyp_resolve(F.col("t.content"), F.col("t.subs_content"), F.col("t.subs_type"))).alias("len"))
    alike = word.filter("len > 0").groupBy(*keys, "line_seq", "style", "height").agg(F.sum("len").alias("len"), F.min("seq").alias("seq"))
    words = _signed(alike, styles).filter("size IS NOT NULL")
    some = lambda c: F.sum(F.when(F.col(c), F.col("len")).otherwise(0)).alias(f"{c}_chars")
    by_family = words.groupBy(*keys, "size", "font_family").agg(
        F.sum("len").alias("chars"), some("bold"), some("italic"), F.min("seq").alias("first_seq"), F.collect_set("line_seq").alias("in_lines"))
    by_size = by_family.groupBy(*keys, "size").agg(
        *[F.sum(c).alias(c) for c in ("chars", "bold_chars", "italic_chars")], F.min("first_seq").alias("first_seq"),
        F.flatten(F.collect_list("in_lines")).alias("in_lines"),
        F.collect_list(F.struct(F.col("font_family").alias("family"), F.col("chars").alias("n"))).alias("families"))
    unit = F.struct("size", "chars", "bold_chars", "italic_chars", "families")
    dominant = by_size.groupBy(*keys).agg(
        F.min_by(unit, F.struct(-F.col("chars"), F.col("first_seq"))).alias("u"), F.sum("chars").alias("all_chars"),
        F.size(F.array_distinct(F.flatten(F.collect_list("in_lines")))).cast("bigint").alias("lines"),
    ).filter(F.col("all_chars") >= min_chars).select("page_id", "u.*", "lines")
    totals = dominant.groupBy("page_id", "size").agg(
        *[F.sum(c).alias(c) for c in ("chars", "bold_chars", "italic_chars")], F.count("*").alias("blocks"), F.sum("lines").alias("lines"))
    family = dominant.select("page_id", "size", F.explode("families").alias("f")).filter("f.family <> ''").groupBy("page_id", "size", "f.family").agg(
        F.sum("f.n").alias("n")).groupBy("page_id", "size").agg(F.min_by("family", F.struct(-F.col("n"), F.col("family"))).alias("font_family"))
    return totals.join(family, ["page_id", "size"], "left")


def counter_confidence(df: DataFrame, key: str, cnt: str) -> DataFrame:
    """Share of the top count in percent, half-even."""
    return df.groupBy(key).agg(
        F.bround(F.max(cnt) / F.nullif(F.sum(cnt), F.lit(0)) * 100, 0).cast("bigint").alias("confidence")
    )
