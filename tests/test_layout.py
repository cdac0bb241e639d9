"""Segmentation rules on hand-made lines, and closed forms against sequential readings."""

import random

import pytest
from pyspark.sql import functions as F

from folio.fixtures import TOKEN_TYPE
from folio.operators import illustrations, layout, page_numbers, search

LINE = (
    "page_id bigint, book_id string, block_seq bigint, line_seq bigint, block_id string, hpos bigint, vpos bigint, width bigint, "
    f"height bigint, bottom bigint, font_size double, tokens array<{TOKEN_TYPE}>"
)


def tok(i, text, hpos, vpos=0, width=40, height=30.0, subs=None, kind=None, style=""):
    return (i, text, subs, kind, style, hpos, vpos, width, height)


def line(page, block, n, text, hpos=100, vpos=None, width=800, height=30, font=11.0, style=""):
    vpos = 100 + 40 * n if vpos is None else vpos
    words = text.split(" ") if text else []
    tokens = [tok(i, w, hpos + 50 * i, vpos, style=style, height=float(height)) for i, w in enumerate(words)]
    return (page, "b", block, n, f"blk{block}", hpos, vpos, width, height, vpos + height, font, tokens)


def blocks(spark, rows, page_w=1400):
    df = layout.page_blocks(spark.createDataFrame(rows, LINE), F.lit(page_w))
    return [(r.text, r.split_reason, r.line_count) for r in df.orderBy("page_id", "block_no").collect()]


def test_vertical_gap(spark):
    rows = [line(1, 0, i, f"l{i}", vpos=100 + 40 * i + (200 if i >= 3 else 0)) for i in range(5)]
    assert blocks(spark, rows) == [("l0 l1 l2", "vertical_gap", 3), ("l3 l4", None, 2)]


def test_indent_starts_block(spark):
    rows = [line(1, 0, i, f"l{i}", hpos=150 if i in (0, 3) else 100) for i in range(6)]
    got = blocks(spark, rows)
    assert [b[0] for b in got] == ["l0 l1 l2", "l3 l4 l5"]


@pytest.mark.parametrize("at,expected", [
    (1, ["l0 l1 l2 l3"]), (2, ["l0", "l1 l2 l3"]), (3, ["l0", "l1", "l2 l3"])])
def test_negative_indent_splits_back(spark, at, expected):
    rows = [line(1, 0, i, f"l{i}", hpos=200 if i < at else 100) for i in range(4)]
    got = blocks(spark, rows)
    assert [b[0] for b in got] == expected
    assert all(b[1] == "horizontal_indent" for b in got[:-1])


def test_font_change_splits(spark):
    rows = [line(1, 0, i, f"l{i}", font=11.0 if i < 2 else 16.0) for i in range(4)]
    assert [b[:2] for b in blocks(spark, rows)] == [("l0 l1", "horizontal_shift"), ("l2 l3", None)]


def test_centred_verse_with_font_change(spark):
    rows = [line(1, 0, i, f"v{i}", hpos=700 - w // 2, width=w, font=11.0 if i < 2 else 20.0) for i, w in enumerate((300, 500, 260, 420))]
    df = layout.page_blocks(spark.createDataFrame(rows, LINE), F.lit(1400)).orderBy("block_no").collect()
    assert [(r.text, r.split_reason, r.centered) for r in df] == [("v0 v1", "center_font_change", True), ("v2 v3", None, True)]


def test_hyphen_pairs(spark):
    rows = [line(1, 0, 0, "one exam-"), line(1, 0, 1, "ple two"), line(1, 0, 2, "ab-"), line(1, 0, 3, "cd-"), line(1, 0, 4, "ef 5-")]
    assert blocks(spark, rows)[0][0] == "one example two abcd- ef 5-"
    subs = [line(1, 0, 0, "x"), line(1, 0, 1, "y")]
    subs[0][-1].append(tok(1, "be", 200, subs="behold", kind="HypPart1"))
    subs[1][-1].insert(0, tok(0, "hold", 100, subs="behold", kind="HypPart2"))
    assert blocks(spark, subs)[0][0] == "x behold y"


def test_word_without_height_vanishes_in_merged_line(spark):
    rows = [line(1, 0, 0, "a ex-"), line(1, 0, 1, "tra b")]
    rows[0][-1].insert(1, tok(9, "lost", 120, height=None))
    assert blocks(spark, rows)[0][0] == "a extra b"


def test_hyphen_parity_against_sequence(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for page in range(60):
        lines = [[rnd.choice(["ab-", "cd", "1-", "ef-"]) for _ in range(rnd.choice([1, 1, 2]))] for _ in range(8)]
        rows += [line(page, 0, i, " ".join(ws)) for i, ws in enumerate(lines)]
        work = [list(ws) for ws in lines]
        for i in range(len(work) - 1):
            cur, nxt = work[i], work[i + 1]
            if cur and nxt and cur[-1].endswith("-") and any(c.isalpha() for c in cur[-1][:-1]):
                cur[-1] = cur[-1][:-1] + nxt.pop(0)
        want[page] = " ".join(" ".join(ws) for ws in work if ws)
    got = layout.page_blocks(spark.createDataFrame(rows, LINE), F.lit(1400)).collect()
    assert {r.page_id: r.text for r in got} == want


def test_every_word_lands_in_one_block(spark):
    rnd = random.Random(5)
    rows, n = [], 0
    for page in range(20):
        for i in range(30):
            ws = " ".join(f"w{n + k}" for k in range(4))
            n += 4
            rows.append(line(page, i // 10, i, ws, hpos=rnd.choice([100, 100, 160, 220]), vpos=100 + 45 * i + rnd.choice([0, 0, 0, 90]), font=rnd.choice([11.0, 11.0, 16.0])))
    got = layout.page_blocks(spark.createDataFrame(rows, LINE).repartition(7), F.lit(1400)).collect()
    words = [w.tok for r in got for w in r.words]
    assert sorted(words) == sorted(f"w{i}" for i in range(n))
    again = layout.page_blocks(spark.createDataFrame(rows, LINE).coalesce(1), F.lit(1400)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def notes(spark, page_number, texts):
    rows = [line(1, 0, i, t, width=60) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, LINE).withColumn("page_number", F.lit(page_number))
    flagged = page_numbers.flag_lines(df, F.lit(1400))
    pages = spark.createDataFrame([(1, page_number)], "page_id bigint, page_number string")
    found = page_numbers.page_number_notes(flagged, pages, F.lit(2000)).orderBy("note_seq").collect()
    removed = [r.line_seq for r in flagged.filter("is_number_line").collect()]
    return [(r.vpos, r.text) for r in found], removed


@pytest.mark.parametrize("number,texts,expected,removed", [
    ("12", ["12", "13"], [(100, "Page number: 12 ; OCR text: 12"), (2001, "Secondary page number OCR: 13")], [0]),
    ("12", ["x~y"], [(100, "Page number: 12 ; OCR text: x~y ; !FOUND ONLY KANDIDATE!")], []),
    ("12", ["99"], [(100, "Page number: 12 ; OCR text: 99 ; !FOUND ONLY KANDIDATE!")], [0]),
    ("12", ["3 * ab"], [(2001, "Page number: 12 ; OCR text: None ; !NOT FOUND!"), (2002, "Secondary page number OCR: 3 * ab ; !FOUND OLNY KANDIDATE!")], []),
    ("12", ["4 *"], [(2001, "Page number: 12 ; OCR text: None ; !NOT FOUND!"), (2002, "Secondary page number OCR: 4 *")], [0]),
    ("[7]", ["7"], [(2001, "Page number: [7] ; SHOULDN'T BE ON PAGE")], []),
    ("xiv", ["XIV"], [(100, "Page number: XIV ; OCR text: XIV")], [0]),
    (None, ["5"], [], []),
])
def test_page_numbers(spark, number, texts, expected, removed):
    assert notes(spark, number, texts) == (expected, removed)


def kept_pictures(spark, rects):
    rows = [(p, i, *map(float, r)) for p, page in enumerate(rects) for i, r in enumerate(page)]
    df = spark.createDataFrame(rows, "page_id bigint, seq bigint, x double, y double, w double, h double")
    got = {p: [] for p in range(len(rects))}
    for r in illustrations.illustration_dedupe(df).orderBy("page_id", "seq").collect():
        got[r.page_id].append(r.seq)
    return list(got.values())


def test_nested_illustrations_by_example(spark):
    big, small, far, half = (0, 0, 40, 40), (10, 10, 20, 20), (100, 100, 20, 20), (30, 0, 20, 20)
    assert kept_pictures(spark, [
        [big, small], [small, big], [big, big], [big, far], [big, half], [small, far, big, small], [(0, 0, 0, 0), big], [big],
        [(0, 0, 100, 100), (0, 0, 100, 96), (0, 0, 100, 91)],
    ]) == [[0], [1], [1], [0, 1], [0, 1], [1, 2], [0, 1], [0], [0]]


def test_dropped_illustrations_are_covered(spark):
    rnd = random.Random(2)
    pages = [[(rnd.randrange(3) * 10, rnd.randrange(3) * 10, rnd.choice([20, 40]), rnd.choice([20, 40])) for _ in range(rnd.randrange(1, 6))] for _ in range(80)]
    for page, kept in zip(pages, kept_pictures(spark, pages), strict=True):
        assert kept
        for i in set(range(len(page))) - set(kept):
            x, y, w, h = page[i]
            inner = [(max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b))) for n, (a, b, c, d) in enumerate(page) if n != i]
            assert max(inner) >= 0.95 * w * h


def v1_texts(spark, rows):
    return [r.text for r in search.reading_blocks_v1(spark.createDataFrame(rows, LINE)).orderBy("block_no").collect()]


def test_reading_blocks_v1_by_example(spark):
    long = "word " * 25 + "end."
    assert v1_texts(spark, [line(1, 0, 0, "a b", vpos=40), line(1, 0, 1, "c.", vpos=80)]) == ["a b c. "]
    assert v1_texts(spark, [line(1, 0, 0, long, vpos=40), line(1, 0, 1, "x.", vpos=80), line(1, 0, 2, "y. z", vpos=120), line(1, 1, 0, "w;", vpos=160)]) == [f"{long} x. y.", "z w; "]
    assert v1_texts(spark, [line(1, 0, 0, "a", vpos=40), line(1, 0, 1, "b", vpos=400)]) == ["a . -- -- b "]
    assert v1_texts(spark, [line(1, 0, 0, "a", vpos=40), line(1, 0, 1, "narrow", vpos=80, width=30), line(1, 0, 2, "b", vpos=120)])[0].split(" ")[-2:] == ["b", ""]


def test_reading_blocks_v1_close_only_at_sentence_ends(spark):
    rnd = random.Random(9)
    rows, words, vpos = [], [], 0
    for i in range(60):
        vpos += 40
        ws = ["word" + rnd.choice(["", "", ".", ";", ","]) for _ in range(rnd.randrange(1, 9))]
        words += ws
        rows.append(line(1, i // 10, i, " ".join(ws), vpos=vpos, width=800))
    got = v1_texts(spark, rows)
    assert [w for t in got for w in t.split()] == words
    assert all(t[-1] in ".;" and len(t) > 120 for t in got[:-1])


def test_reading_blocks_v1_take_whole_lines_as_word_by_word(spark):
    """Places of 0, none and below 0 beside plain lines, against the reading of one word after the other."""
    rnd = random.Random(4)
    rows = []
    for i in range(80):
        ws = ["word" + rnd.choice(["", "", "", ".", ";", "a. b"]) for _ in range(rnd.randrange(0, 7))]
        place = lambda: rnd.choice([0, None, -7]) if rnd.random() < 0.03 else rnd.randrange(1, 900)
        tokens = [tok(n, w, place(), place(), width=rnd.randrange(1, 60)) for n, w in enumerate(ws)]
        rows.append((*line(i // 40, 0, i, "", vpos=40 * i)[:-1], None if i == 60 else tokens))
    low = lambda a, b: None if a is None else b if a == 0 else a if b is None or a <= b else b
    high = lambda a, b: None if a is None else b if a == 0 else a if b is None or a >= b else b
    plus = lambda a, b: None if a is None or b is None else a + b
    want = []
    for page in (0, 1):
        done, text, n, box = [], "", 0, (0, 0, 0, 0)
        for *_, tokens in rows[40 * page:40 * page + 40]:
            n += 1
            for _, c, _, _, _, x, y, w, h in tokens or []:
                text += c
                box = (low(box[0], x), low(box[1], y), high(box[2], plus(x, w)), high(box[3], plus(y, int(h))))
                if n >= 3 and c[-1] in ".;" and len(text) > 120:
                    done.append((page, text, *box))
                    text, n, box = "", 0, (0, 0, 0, 0)
                else:
                    text += " "
        want += [] if page == 1 else done + ([(page, text, *box)] if text else [])
    got = search.reading_blocks_v1(spark.createDataFrame(rows, LINE))
    assert [tuple(r)[:1] + tuple(r)[2:] for r in got.orderBy("page_id", "block_no").collect()] == want
    # a plain line has its text, and keeps no words to be read one by one
    assert "array_min" in got._jdf.queryExecution().optimizedPlan().toString()


def test_word_boxes_shuffle_only_words_that_are_asked_for(spark):
    from folio import fixtures as fx

    words = fx.tokens(spark.createDataFrame([line(p, 0, 0, "alpha beta alpha gamma") for p in (1, 2)], LINE))
    asked = spark.createDataFrame([("q", "alpha gamma alpha", 1), ("r", "beta", 1), ("s", "delta", 2)], "query_id string, query string, page_id bigint")
    hits = search.word_boxes(words, asked, F.lit(1.0), F.lit(1.0))
    got = sorted((r.query_id, r.word_no, r.page_id, r.token_seq) for r in hits.collect())
    assert got == [("q", 0, 1, 0), ("q", 0, 1, 2), ("q", 1, 1, 3), ("q", 2, 1, 0), ("q", 2, 1, 2), ("r", 0, 1, 1)]
    assert "array_contains" in hits._jdf.queryExecution().optimizedPlan().toString()


def test_merged_headings_follow_the_growing_median(spark):
    from statistics import median

    from folio.operators import headings

    cases = {1: [[10.0], [10.9], [11.9], [12.0]], 2: [[10.0, 10.0], [10.9], [11.1]], 3: [[20.0], [21.0], [22.5], [20.0]], 4: [[0.0], [10.0]], 5: [[10.0], [30.0], [31.0], [33.0, 33.0], [36.0]]}
    rows = [(p, i, "h1", f"t{i}", "s", False, None, f, False, len(f)) for p, fs in cases.items() for i, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "page_id int, block_no bigint, tag string, text string, source_block_id string, all_bold boolean, split_reason string, fonts array<double>, centered boolean, line_count int")

    def loop(fonts):
        out, sizes = [], None
        for i, f in enumerate(fonts):
            f = [x for x in f if x]
            if sizes and f and (max(median(sizes), median(f)) - min(median(sizes), median(f))) / min(median(sizes), median(f)) <= headings.MERGE_TOLERANCE:
                out[-1] += f" t{i}"
                sizes = sizes + f
            else:
                out.append(f"t{i}")
                sizes = f
        return out

    got = {}
    for r in headings.heading_merge(df).orderBy("page_id", "block_no").collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got == {p: loop(fs) for p, fs in cases.items()}


def test_sizes_of_each_page(spark):
    """Pages with sizes of their own come out as in a run in which all pages have that size."""
    from folio import fixtures as fx
    from folio.plans import formatter
    from folio.session import materialise

    sf = "/root/testdata/sf0.001"
    pages = materialise(fx.pages(spark, sf))

    def run(**size):
        return formatter.page_html(lambda only: fx.lines(spark, sf, pages, only), pages, fx.styles(spark, sf), fx.illustrations(spark, sf), **size)

    wide, narrow = (dict((r.page_id, r.html) for r in run(page_w=F.lit(w), page_h=F.lit(h)).collect()) for w, h in ((fx.PAGE_W, fx.PAGE_H), (300, 90)))
    own = F.col("page_id") % 2 == 0
    pick = lambda a, b: F.when(own, F.lit(a)).otherwise(F.lit(b))
    w, h = pick(fx.PAGE_W, 300), pick(fx.PAGE_H, 90)
    sizes = pages.select("page_id", w.alias("text_w"), h.alias("text_h"), w.alias("page_w"), h.alias("page_h"))
    got = {r.page_id: r.html for r in run(sizes=sizes).collect()}
    assert got == {p: (wide if p % 2 == 0 else narrow)[p] for p in wide} and wide != narrow
    none = run(sizes=sizes.where("page_id % 3 <> 0")).collect()
    assert len(none) == len(wide) and all(r.html is not None for r in none)


def test_words_are_read_as_they_stand(spark):
    word = lambda text, subs=None, kind=None, h=30.0, at=10: (0, text, subs, kind, "bold", at, 0, 5, h)
    rows = [
        (1, [word("Ab"), word(None), word(""), word("x y", at=20), word("5", h=None), word("é"), word("…"), word("b", h=0.0), None]),
        (2, [word("rest", None, "HypPart2", at=7), word("gro", "grown", "HypPart1"), word("q")]),
        (3, []),
        (4, [word(",", at=1), word(" a ", at=None), word("c", at=3)]),
    ]
    df = spark.createDataFrame(rows, f"line_seq int, tokens array<{TOKEN_TYPE}>").withColumn("hpos", F.lit(99).cast("bigint"))
    got = [(r.text, r.chars, [tuple(w) for w in r.words], r.mean_h, r.eff_left, r.bold) for r in layout.read_words(df).orderBy("line_seq").collect()]
    assert got == [
        ("Ab x y 5 é … b", 8, [("Ab", 2, 30.0, True), ("x y", 2, 30.0, True), ("é", 1, 30.0, True), ("…", 1, 30.0, False), ("b", 1, 0.0, True)], 30.0, 10, False),
        ("grown q", 6, [("grown", 5, 30.0, True), ("q", 1, 30.0, True)], 30.0, 7, True),
        ("", 0, [], None, 99, True),
        (",  a  c", 3, [(",", 1, 30.0, False), (" a ", 1, 30.0, True), ("c", 1, 30.0, True)], 30.0, 99, True),
    ]


def test_lines_pass_few_windows(spark):
    plan = layout.page_blocks(spark.createDataFrame([line(1, 0, 0, "a")], LINE), F.lit(1400))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Window [") <= 14
