"""Font statistics: plans and results of alike words."""

import __spark_entry__ as entry
from folio.operators import style

SF = "/root/testdata/sf0.001"


def test_paragraph_statistics_shuffle_no_lines(spark):
    plan = entry.queries()["paragraph_font_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "tokens" in line]
    assert not moved and "line_seq" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert plan.count("regexp_replace(text") <= 2  # the text is cut into lines once


def test_words_meet_their_styles_without_a_sort(spark):
    plan = entry.queries()["token_style"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_font_statistics_look_a_style_up_once_for_alike_words(spark):
    lines = spark.sql("""SELECT 1L AS page_id, 0L AS block_seq, 0L AS line_seq, array(
        named_struct('seq', 0L, 'content', repeat('a', 30), 'subs_content', null, 'subs_type', null, 'style', 'S1 bold', 'height', 30.0D),
        named_struct('seq', 1L, 'content', repeat('b', 30), 'subs_content', null, 'subs_type', null, 'style', 'S1 bold', 'height', 31.0D),
        named_struct('seq', 2L, 'content', 'c', 'subs_content', null, 'subs_type', null, 'style', null, 'height', 31.0D)) AS tokens""")
    styles = spark.sql("SELECT 1L AS page_id, 'S1' AS style_id, 12D AS font_size, ' Old  Face' AS font_family, 'Italic' AS font_style, cast(null as string) AS font_weight")
    got = style.block_font_stats(lines, styles, ["page_id", "block_seq"]).collect()
    assert [r.asDict() for r in got] == [{"page_id": 1, "size": 12.0, "chars": 60, "bold_chars": 60, "italic_chars": 60, "blocks": 1, "lines": 1, "font_family": "Old Face"}]
