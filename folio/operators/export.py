"""Exports of whole books.

A book may be of any size, so no export gathers one into a single row: the unit is the page, in
book order, and the writers range-sort the pieces, so that a book's files read one after the
other give the book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.functions import text as T
from folio.operators.ordering import with_running
from folio.operators.pages import with_html
from folio.session import materialise

TEXT_TAGS = ["h1", "h2", "h3", "p", "blockquote", "small", "div", "note"]
HEADINGS = ["h1", "h2", "h3"]
# The document frame, and default names.
HTML_HEAD = '<!DOCTYPE html>\n<html lang="cs">\n  <head>\n    <meta charset="utf-8" />\n    <title>%s</title>\n  </head>\n  <body>\n'
HTML_TAIL = "\n  </body>\n</html>\n"
PAGE_LABEL = "Strana %d"
CHAPTER_LABEL = "Kapitola %d"
CHAPTER_FILE = "chap_%d.xhtml"


def _per_page(snippets: DataFrame, piece: Column, glue: str) -> DataFrame:
    return (
        snippets.withColumn("_piece", piece)
        .groupBy("book_id", "page_index")
        .agg(F.array_sort(F.collect_list(F.struct("ord", F.col("_piece").alias("p")))).alias("ps"))
        .select("book_id", "page_index", F.array_join(F.transform("ps", lambda x: x.p), glue).alias("text"))
    )


def to_text(snippets: DataFrame) -> DataFrame:
    """Plain text, one row per page; pages and blocks are parted by a blank line."""
    return _per_page(snippets.filter(F.col("tag").isin(*TEXT_TAGS) & (F.col("text") != "")), F.col("text"), "\n\n")


def to_markdown(snippets: DataFrame) -> DataFrame:
    """Markdown, one row per page."""
    kept = snippets.filter(F.col("tag").isin(*TEXT_TAGS) & (F.col("text") != ""))
    return _per_page(kept, M.md_line(F.col("tag"), F.col("text")), "\n\n")


def to_html(snippets: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Html document in pieces: the head (part 0), one section per page, the tail (last part)."""
    body = _per_page(with_html(snippets), F.when(F.col("text") == "", "").otherwise(F.col("html")), "\n")
    label = F.coalesce(F.when(F.col("page_number") != "", F.col("page_number")), F.format_string(PAGE_LABEL, F.col("page_index") + 1))
    sections = body.join(pages.select("book_id", "page_index", "page_number"), ["book_id", "page_index"]).select(
        "book_id", (F.col("page_index") + 1).alias("part"),
        F.concat(F.lit('<section data-page="'), T.escape(label), F.lit('">\n'), F.trim("text"), F.lit("\n</section>")).alias("html"),
    )
    ends = pages.groupBy("book_id").agg((F.max("page_index") + 2).alias("last_part")).join(titles, "book_id", "left")
    frame = ends.select("book_id", F.inline(F.array(
        F.struct(F.lit(0).cast("bigint").alias("part"), F.format_string(HTML_HEAD, F.coalesce("title", F.lit("Download"))).alias("html")),
        F.struct(F.col("last_part").alias("part"), F.lit(HTML_TAIL).alias("html")),
    )))
    return sections.unionByName(frame)


def chapter_ids(snippets: DataFrame) -> DataFrame:
    """Add number and title of the chapter to every snippet.

    Headings start a chapter; text before the first heading of a book is a chapter of its own.  What
    a page carries on from earlier pages comes from one narrow row per page.
    """
    keys = ["book_id", "page_index"]
    heading = F.col("tag").isin(*HEADINGS)
    per_page = materialise(snippets.groupBy(*keys).agg(
        F.count(F.when(heading, 1)).alias("heads"),
        F.min_by(heading, "ord").alias("opens"),
        F.max_by(F.when(heading, F.col("text")), F.when(heading, F.col("ord"))).alias("last_head"),
    ))
    mark = F.when(F.col("heads") > 0, F.struct("page_index", "last_head"))
    carried = with_running(per_page, "book_id", "page_index", F.col("heads"), "sum", "before", inclusive=False)
    titled = with_running(per_page, "book_id", "page_index", mark, "max", "open_head", inclusive=False)
    preface = per_page.groupBy("book_id").agg(F.when(F.min_by("opens", "page_index"), 0).otherwise(1).alias("preface"))
    carry = (
        carried.select(*keys, "before").join(titled.select(*keys, F.col("open_head.last_head").alias("open_title")), keys)
        .join(preface, "book_id")
    )
    inside = Window.partitionBy(*keys).orderBy("ord")
    return (
        snippets.withColumn("_in", F.count(F.when(heading, 1)).over(inside))
        .withColumn("_head", F.last(F.when(heading, F.col("text")), ignorenulls=True).over(inside))
        .join(carry, keys)
        .withColumn("chapter_no", F.col("before") + F.col("_in") + F.col("preface"))
        .withColumn("title", F.coalesce("_head", "open_title"))
        .drop("_in", "_head", "before", "open_title", "preface")
    )


def chapters(snippets: DataFrame) -> DataFrame:
    """Chapters in pieces, one row per chapter and page, each with the chapter's title and file."""
    numbered = chapter_ids(with_html(snippets).filter(F.col("text") != ""))
    pieces = (
        numbered.groupBy("book_id", "chapter_no", "page_index")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "html"))).alias("ps"), F.first("title").alias("title"))
    )
    return pieces.select(
        "book_id", "chapter_no", "page_index",
        F.coalesce(F.when(F.col("title") != "", F.col("title")), F.format_string(CHAPTER_LABEL, F.col("chapter_no"))).alias("title"),
        F.format_string(CHAPTER_FILE, F.col("chapter_no")).alias("file_name"),
        F.array_join(F.transform("ps", lambda x: x.html), "\n").alias("html"),
    )


def write_text(pieces: DataFrame, path: str, text: str = "text", order: str = "page_index") -> None:
    """Write pieces as text files per book; the files of a book in name order hold it in reading order."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        pieces.repartitionByRange(n, "book_id", order)
        .sortWithinPartitions("book_id", order)
        .select("book_id", F.concat(F.col(text), F.lit("\n")).alias("value"))
        .write.mode("overwrite").partitionBy("book_id").text(path)
    )


def write_chapters(pieces: DataFrame, path: str) -> None:
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        pieces.repartitionByRange(n, "book_id", "chapter_no", "page_index")
        .sortWithinPartitions("book_id", "chapter_no", "page_index")
        .write.mode("overwrite").partitionBy("book_id").parquet(path)
    )
