import time
from difflib import SequenceMatcher

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.operators import diff, sequence


def pairs(spark, left, right):
    side = lambda ps: spark.createDataFrame([(1, i, f"<p>{t}</p>") for i, t in enumerate(ps)], "page_id bigint, ord bigint, html string")
    got = diff.align_blocks(side(left), side(right)).collect()
    return sorted((r.left_ord, r.right_ord, r.change) for r in got if r.left_ord is not None and r.right_ord is not None), len(got)


def test_changed_blocks_pair_behind_an_inserted_group(spark):
    texts = [f"block {i} holds alpha{i} beta{i} gamma{i} delta{i} words of its own" for i in range(5)]
    changed = [t.replace("words", "things") for t in texts]
    new = [f"wholly new text number {i} without any likeness zz{i}" for i in range(4)]
    assert pairs(spark, texts, new + changed) == ([(i, i + 4, "changed") for i in range(5)], 9)
    assert pairs(spark, new + texts, changed) == ([(i + 4, i, "changed") for i in range(5)], 9)


def test_blocks_do_not_pair_across_an_anchor(spark):
    a, b = "some words that changed just a little here", "some words that changed just a bit here"
    anchor = "an anchor between that is equal on both sides"
    assert pairs(spark, [a, anchor], [anchor, b]) == ([(1, 0, "equal")], 3)
    assert pairs(spark, [a, anchor], [b, anchor])[0] == [(0, 0, "changed"), (1, 1, "equal")]


def test_a_moved_block_is_removed_and_added_and_others_keep_their_anchors(spark):
    texts = [f"paragraph {i} with words{i} of its own{i} and more{i}" for i in range(6)]
    moved = texts[1:5] + [texts[0], texts[5]]
    got, n = pairs(spark, texts, moved)
    assert got == [(i, i - 1, "equal") for i in range(1, 5)] + [(5, 5, "equal")] and n == 7


def test_two_blocks_pair_with_one(spark):
    a, b = "the first half of a long paragraph about the old town hall", "and the second half of it about the river and the bridge"
    side = lambda ps: spark.createDataFrame([(1, i, f"<p>{t}</p>") for i, t in enumerate(ps)], "page_id bigint, ord bigint, html string")
    [row] = diff.align_blocks(side([a, b]), side([f"{a} {b}"])).collect()
    assert (row.left_ord, row.left_n, row.right_ord, row.right_n, row.similarity, row.change) == (0, 2, 0, 1, 1.0, "changed")


def test_noise_and_pages_of_one_side(spark):
    left = spark.createDataFrame([(1, 0, "<p>12</p>"), (1, 1, "<p>a text that stands on one side only</p>"), (2, 0, "<p>a page of the left side</p>"), (2, 1, None)], "page_id bigint, ord bigint, html string")
    right = spark.createDataFrame([(1, 0, "<p>IV - 7</p>"), (3, 5, "<p>a page of the right side</p>")], "page_id bigint, ord bigint, html string")
    got = {(r.page_id, r.left_ord, r.right_ord, r.change) for r in diff.align_blocks(left, right).collect()}
    assert got == {(1, 0, None, "noise"), (1, None, 0, "noise"), (1, 1, None, "removed"), (2, 0, None, "removed"), (3, None, 5, "added")}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd "), max_size=14), st.lists(st.sampled_from("abcde "), max_size=14)), min_size=1, max_size=40))
def test_runs_are_those_of_the_standard_matcher(spark, rows):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "k int, a array<string>, b array<string>")
    got = {r.k: [tuple(x) for x in r.runs] for r in df.select("k", sequence.matching_runs(F.col("a"), F.col("b")).alias("runs")).collect()}
    for k, (a, b) in enumerate(rows):
        assert got[k] == [(m.a, m.b, m.size) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


def _runs(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    [row] = df.select(sequence.matching_runs(F.col("a"), F.col("b")).alias("runs")).collect()
    return [tuple(x) for x in row.runs]


def test_long_texts_are_not_compared_place_by_place(spark):
    """20,000 words a side: 400 million places a run."""
    a = [f"w{i}" for i in range(20_000)]
    b = ["new", *a[5:9_000], "other", *a[9_003:]]
    start = time.monotonic()
    assert _runs(spark, a, b) == [(5, 1, 8_995), (9_003, 8_997, 10_997)]
    assert time.monotonic() - start < 25


def test_runs_where_hashes_mislead_and_nulls(spark, monkeypatch):
    a, b = ["x", "y", None, "z", "z"], ["y", None, "z", "x", "z", "z"]
    assert _runs(spark, a, b) == [(0, 3, 1), (3, 4, 2)] and _runs(spark, a[1:], b) == [(0, 0, 1), (2, 4, 2)]
    monkeypatch.setattr(sequence, "_both", lambda x, y: F.lit(7).cast("bigint"))
    assert _runs(spark, a, b) == [(0, 3, 1), (3, 4, 2)]


def test_moved_words_are_marked(spark):
    df = spark.createDataFrame([(1, "<p>red blue</p>", "<p>blue red</p>"), (2, "<p>one two</p>", None), (3, "<p>same</p>", "<p>same</p>"), (4, "<p>a, b</p>", "<p>a, <b>b</b></p>")], "k int, l string, r string")
    got = {r.k: (r.left_markup, r.right_markup) for r in diff.diff_markup(df, "l", "r", ["k"]).collect()}
    cls = ' class="diff-block diff-block--changed"'
    assert got[1] == (f'<p{cls}>red <span class="diff-removed">blue</span></p>', f'<p{cls}><span class="diff-added">blue</span> red</p>')
    assert got[2] == (f'<p{cls}><span class="diff-removed">one</span> <span class="diff-removed">two</span></p>', "")
    assert got[3] == ("<p>same</p>", "<p>same</p>")
    assert got[4] == (f"<p{cls}>a, b</p>", f"<p{cls}>a, <b>b</b></p>")
    rows = [(r.value, r.change, r.left_seq, r.right_seq) for r in diff.token_diff(df.where("k = 1"), "l", "r", ["k"]).orderBy("ord").collect()]
    assert rows == [("<p>", "equal", 0, 0), ("blue", "added", None, 1), (" ", "added", None, 2), ("red", "equal", 1, 3), (" ", "removed", 2, None), ("blue", "removed", 3, None), ("</p>", "equal", 4, 4)]
    assert [r.value for r in diff.token_diff(df.where("k = 4"), "l", "r", ["k"], "char").where("change = 'added'").orderBy("ord").collect()] == ["<b>", "</b>"]
