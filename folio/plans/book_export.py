"""Export of whole books: page html to text, Markdown, html or chapter pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame

from folio.operators import export, html, pages


def book_snippets(page_html: DataFrame, page_list: DataFrame, fmt: str = "txt", join: bool = True, **options) -> DataFrame:
    """Snippets of all books from the html of their pages, joined across page breaks.

    page_html: page_id, html; page_list: book_id, page_id, page_index.
    """
    content = html.page_content(html.html_blocks(page_html, "html"), fmt, **options)
    placed = content.select("page_id", "ord", "tag", "text", "html").join(
        page_list.select("page_id", "book_id", "page_index"), "page_id"
    ).drop("page_id")
    return pages.join_apply(placed, pages.join_decide(placed)) if join else placed


def export_books(snippets: DataFrame, page_list: DataFrame, titles: DataFrame, fmt: str, path: str) -> None:
    """Write all books in one format below ``path``."""
    if fmt == "txt":
        export.write_text(export.to_text(snippets), path)
    elif fmt == "md":
        export.write_text(export.to_markdown(snippets), path)
    elif fmt == "html":
        export.write_text(export.to_html(snippets, page_list, titles), path, text="html", order="part")
    elif fmt == "epub":
        export.write_chapters(export.chapters(snippets), path)
    else:
        raise ValueError(f"unknown format: {fmt}")
