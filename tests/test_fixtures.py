"""Lines, words and blocks made of texts, against plain Python; plans that work each word out once."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folio import fixtures as fx
from folio.operators import ordering

SF = "/root/testdata/sf0.001"
TEXTS = [
    "one", "  a  b\tc\n\nd  ", " ".join(f"w{i}" for i in range(9)), " ".join(f"w{i}" for i in range(10)), "x" * 5000,
    "\n".join(f"w{i}" for i in range(400)), " ".join(["$1", "\\", "a b"] * 50), "", "  \n ", None,
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, f"src{i % 2}") for i, t in enumerate(TEXTS * 8)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{sf}/documents.parquet")
    return sf


def _words(text):
    return [w for w in re.split(r"[ \t\n\r]+", text or "") if w]


def _read(p, n, i, w):
    """Content of word ``i`` of page ``p``."""
    return w + "-" if i % 9 == 8 and (p + i // 9) % 8 == 5 else w


def test_lines_hold_every_word_in_order(spark, odd):
    got = {}
    for r in fx.text_lines(spark, odd).orderBy("page_id", "line_seq").collect():
        got.setdefault(r.page_id, []).append(r)
    for p, text in enumerate(TEXTS * 8):
        words = _words(text)
        lines = got.get(p, [])
        assert [len(r.tokens) for r in lines] == [len(words[i : i + 9]) for i in range(0, len(words), 9)]
        tokens = [t for r in lines for t in r.tokens]
        assert [t.content for t in tokens] == [_read(p, len(words), i, w) for i, w in enumerate(words)]
        assert [t.seq for t in tokens] == list(range(len(words)))
        for i, t in enumerate(tokens):
            first = i % 9 == 8 and (p + i // 9) % 8 == 3
            last = i % 9 == 0 and i and (p + i // 9 - 1) % 8 == 3
            whole = first and i + 1 < len(words)
            assert (t.subs_content, t.subs_type) == (words[i] + words[i + 1] if whole else None, "HypPart1" if whole else "HypPart2" if last else None)
        for r in lines:
            assert r.height == max(t.height for t in r.tokens)


def test_blocks_hold_the_words_of_seven_lines(spark, odd):
    got = {(r.page_id, r.ord): r.text for r in fx.blocks(spark, odd).collect()}
    want = {}
    for p, text in enumerate(TEXTS * 8):
        words = _words(text)
        for b in range(0, len(words), 63):
            want[p, b // 63] = " ".join(_read(p, len(words), b + i, w) for i, w in enumerate(words[b : b + 63]))
    assert got == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_made_once_and_without_a_lambda(spark):
    assert "transform(" not in _plan(entry.queries()["fn_hyp_resolve"](spark, SF))


def test_parts_grow_with_the_tables(spark, monkeypatch):
    docs = fx.table(spark, SF, "documents")
    assert ordering.parts_for(docs) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(ordering, "PART_BYTES", 5000)
    assert ordering.parts_for(docs) > 8
    assert fx.text_lines(spark, SF).rdd.getNumPartitions() == ordering.parts_for(docs)
