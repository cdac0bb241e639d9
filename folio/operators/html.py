"""Html of a page cut into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.functions import text as T


# What a page consists of besides text, the first that fits: a comment, a script or style with its content, a declaration, a tag,
# whose quoted values may hold any mark, and a tag with a quote that is not closed.
ATTRIBUTES = """(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""  # possessive, so that long tags need no stack
HIDDEN = [r"<!--.*?(?:-->|\z)", rf"<script(?:[\s/]{ATTRIBUTES})?>.*?(?:</script\s*>|\z)", rf"<style(?:[\s/]{ATTRIBUTES})?>.*?(?:</style\s*>|\z)", r"<[!?][^>]*>"]
LEXEMES = "(?is)" + "|".join([*HIDDEN, rf"</?[a-z]{ATTRIBUTES}>", r"</?[a-z][^>]*>"])


def lexed(html: Column) -> Column:
    """Html in which ``<`` and ``>`` stand for tags only: comments, declarations, scripts and styles are gone.

    A comment parts the text before it from the text behind it.  Marks in texts are escaped, those in quoted values blank.
    """
    tags = F.regexp_extract_all(html, F.lit(LEXEMES), F.lit(0))
    texts = F.transform(F.split(html, LEXEMES, -1), lambda t: F.replace(t, F.lit("<"), F.lit("&lt;")))
    inside = lambda t: F.when(t.rlike(r"(?i)^<(?:[!?]|(?:script|style)[\s/>])"), "<wbr>").otherwise(F.concat(F.lit("<"), F.translate(F.substring(t, F.lit(2), F.length(t) - 2), "<>", "  "), F.lit(">")))
    return F.array_join(F.flatten(F.zip_with(texts, tags, lambda t, g: F.array(t, F.coalesce(inside(g), F.lit(""))))), "")


def _units(html: Column) -> Column:
    """Texts and tags of a page in order: STRUCT(at, piece, is_tag)."""
    texts = F.split(html, M.TAG, -1)
    tags = F.regexp_extract_all(html, F.lit(M.TAG), F.lit(0))
    unit = lambda at, piece, is_tag: F.struct(at.alias("at"), piece.alias("piece"), F.lit(is_tag).alias("is_tag"))
    return F.filter(
        F.flatten(F.transform(texts, lambda t, i: F.array(
            unit(i * 2, t, False), unit(i * 2 + 1, F.coalesce(F.get(tags, i), F.lit("")), True)))),
        lambda u: u.piece != "",
    )


def _with_depth(df: DataFrame, html_col: str, counted: Column | None) -> DataFrame:
    """Explode a page's units with the nesting depth before and after each.

    The depth never falls below zero: it is the running sum less its lowest value so far.
    ``counted`` limits the tags that nest.
    """
    rows = df.select("page_id", F.inline_outer(_units(F.col(html_col)))).filter("at IS NOT NULL")
    name = M.tag_name(F.col("piece"))
    void = F.col("piece").endswith("/>") | name.isin(*M.VOID_TAGS)
    step = F.when(~F.col("is_tag") | void, 0).when(F.startswith("piece", F.lit("</")), -1).otherwise(1)
    rows = rows.withColumn("name", F.when(F.col("is_tag"), name).otherwise("")).withColumn("step", step)
    if counted is not None:
        rows = rows.withColumn("step", F.when(counted, F.col("step")).otherwise(0))
    order = Window.partitionBy("page_id").orderBy("at")
    return (
        rows.withColumn("_s", F.sum("step").over(order))
        .withColumn("_low", F.least(F.lit(0), F.min("_s").over(order)))
        .withColumn("after", F.col("_s") - F.col("_low"))
        .withColumn("before", F.coalesce(F.lag("after").over(order), F.lit(0)))
        .drop("_s", "_low")
    )


def html_blocks(df: DataFrame, html_col: str) -> DataFrame:
    """Top-level blocks of a page: an element with all it holds, a lone tag, or the text between."""
    html = F.col(html_col)
    only_closings = ~html.rlike(r"(?s)[^>]$|^[^<]|>[^<]") & ~html.rlike("<[^/>][^>]*?>") & (html != "")
    plain = df.select("page_id", F.when(only_closings, F.lit("")).otherwise(html).alias(html_col))
    units = _with_depth(plain, html_col, None).filter(~((F.col("before") == 0) & (F.col("step") == -1)))
    order = Window.partitionBy("page_id").orderBy("at")
    numbered = units.withColumn("block", F.sum(F.when(F.col("before") == 0, 1).otherwise(0)).over(order))
    blocks = numbered.groupBy("page_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("u")
    ).select(
        "page_id",
        (F.col("block") - 1).cast("bigint").alias("block_no"),
        F.array_join(F.transform("u", lambda x: x.piece), "").alias("fragment"),
    )
    whole = df.filter(only_closings).select("page_id", F.lit(0).cast("bigint"), html_col)
    return blocks.union(whole)


def html_to_blocks(df: DataFrame, html_col: str) -> DataFrame:
    """Numbered document blocks: outermost block elements with text; none at all gives one paragraph.

    Comments, declarations, scripts and styles have no text and open no block; a mark in a quoted value ends no tag.
    """
    df = df.select("page_id", lexed(F.col(html_col)).alias(html_col))
    rows = _with_depth(df, html_col, F.col("name").isin(*M.BLOCK_TAGS))
    order = Window.partitionBy("page_id").orderBy("at")
    inside = (
        rows.filter((F.col("before") > 0) | (F.col("step") == 1))
        .withColumn("block", F.sum(F.when(F.col("before") == 0, 1).otherwise(0)).over(order))
    )
    blocks = (
        inside.groupBy("page_id", "block")
        .agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("u"))
        .select("page_id", "block", F.array_join(F.transform("u", lambda x: x.piece), "").alias("fragment"))
        .select("page_id", "block", M.block_type(F.col("fragment")).alias("type"), M.fragment_text(F.col("fragment")).alias("text"))
        .filter("text <> ''")
    )
    per_page = blocks.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "type", "text"))).alias("found")
    )
    rest = df.select("page_id", M.fragment_text(F.col(html_col)).alias("plain"))
    fallback = F.array(F.struct(F.lit(1).cast("bigint").alias("block"), F.lit("p").alias("type"), F.col("plain").alias("text")))
    return (
        rest.join(per_page, "page_id", "left")
        .filter("found IS NOT NULL OR plain <> ''")
        .select("page_id", F.posexplode(F.coalesce("found", fallback)).alias("ord", "b"))
        .select(
            "page_id",
            F.concat(F.lit("b"), (F.col("ord") + 1).cast("string")).alias("block_id"),
            F.col("ord").cast("bigint").alias("ord"),
            "b.type",
            "b.text",
        )
    )


def page_content(
    fragments: DataFrame, fmt: str = "txt", omit_small: bool = False, omit_note: bool = False, ignore_images: bool = False
) -> DataFrame:
    """Fragments that go into an export: top-level block elements, small text and notes by option."""
    frag, tag = F.col("fragment"), F.col("tag")
    picture = M.is_illustration(frag, tag)
    kept = fragments.withColumn("tag", T.block_tag("fragment")).filter(tag.isin(*M.BLOCK_TAGS))
    if ignore_images:
        kept = kept.filter(~picture)
    if omit_small:
        kept = kept.filter(~M.is_small(frag, tag))
    if omit_note:
        stays = picture if fmt == "epub" else F.lit(False)
        kept = kept.filter(~M.is_note(frag, tag) | stays)
    text = M.fragment_text(frag)
    if fmt == "epub" and not ignore_images:
        text = F.when((text == "") & picture, "Ilustrace").otherwise(text)
    return (
        kept.withColumn("text", text)
        .filter("text <> ''")
        .select(
            "page_id",
            (F.row_number().over(Window.partitionBy("page_id").orderBy("block_no")) - 1).cast("bigint").alias("ord"),
            "tag",
            "text",
            F.col("fragment").alias("html"),
        )
    )
