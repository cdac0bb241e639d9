"""Cleaning and packing of a document table: quality, exact copies, near copies, repeated passages, sequences.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with their columns; the last gives the packed
pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).  Rows are judged by ``text`` alone, null as
empty; a null or repeated ``doc_id`` is allowed, further columns are carried through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from folio.llm import exact_dedup, packing, quality, simhash, substring
from folio.llm.common import table
from folio.session import drop_scratch, materialise, scratch

_LEFT: list[str] = []  # folders of stages that have run


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose tables are removed when a later one starts on documents that no longer read them."""

    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _LEFT else []
        for place in [p for p in _LEFT if not any(p.rpartition("/")[2] in f for f in files)]:
            drop_scratch(spark, place)
            _LEFT.remove(place)
        with scratch(spark) as place:
            _LEFT.append(place)
            return work(spark, docs, sf_dir)

    return stage


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest ``doc_id``."""
    return exact_dedup.unique_rows(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose fingerprints differ in 4 bits or fewer or that share 0.8 of their five-word shingles, directly or over others,
    the row with the smallest ``doc_id``."""
    return simhash.without_near_copies(docs, radius=simhash.RADIUS)


@_stage
def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the words of 35-word windows that occur more than once."""
    return substring.without_repeats(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    return packing.pack(materialise(packing.cut(docs, packing.vocabulary_path()))).drop("ids")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("packing", pack_sequences),
]

#: Tokens, fingerprints and weights are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as place:
            docs = materialise(stage(spark, docs, sf_dir))
        if before is not None:
            drop_scratch(spark, before)
        before = place
    return STAGES[-1][1](spark, docs, sf_dir)
