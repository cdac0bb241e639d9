"""Correction round: documents to requests, answers back to documents and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import corrections, diff, html


def page_documents(page_html: DataFrame) -> DataFrame:
    """Numbered block documents of pages given as html (page_id, html)."""
    return html.html_to_blocks(page_html, "html")


def prepare(blocks: DataFrame, settings: DataFrame, prompts: DataFrame, agent: str, language: str = "cs") -> DataFrame:
    """Request rows of all pages for one agent; write them as JSON lines for the outside service."""
    payloads = corrections.doc_payload(blocks, F.lit(language)).withColumn("agent", F.lit(agent))
    return corrections.requests(payloads, settings, prompts)


def review(responses: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corrected documents, and the differences to the ones sent."""
    fixed = corrections.results(responses, blocks)
    return fixed, diff.doc_diff(blocks, fixed)
