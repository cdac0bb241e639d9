"""Model answers in all their shapes, and html pages against the standard library's parser."""

import json
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.operators import html


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "c string").select(fn(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(("shape", "text", "stop", "total"), [
    ({"output_text": " direct ", "output": [{"content": [{"type": "text", "text": "no"}]}]}, "direct", None, None),
    ({"output_text": "", "output": [{"content": [{"type": "text", "text": "a"}, {"type": "output_text", "text": "b"}, {"type": "x", "text": "c"}], "stop_reason": "end"}]}, "a\nb", "end", None),
    ({"outputs": [{"content": [{"type": "text", "text": {"value": "v"}}, {"type": "text", "text": {"text": "t", "value": ""}}, {"type": "text", "text": {"value": 5}}]}], "usage": {"total_tokens": 9}}, "v\nt\n5", None, 9),
    ({"output": [], "outputs": [{"content": [{"type": "text", "text": "o"}]}, "odd", {"content": "odd"}]}, "o", None, None),
    ({"output": {"a": 1}, "outputs": [{"content": [{"type": "text", "text": "o"}]}]}, "", None, None),
    ({"choices": [{"message": {"content": [{"text": "x"}, "y", {"other": 1}]}, "finish_reason": "length"}]}, "x\ny", "length", None),
    ({"choices": [{"message": {"content": "plain"}}], "usage": "none"}, "plain", None, None),
    ([1, 2], "", None, None), ("text", "", None, None),
])
def test_response_shapes(spark, shape, text, stop, total):
    r = one(spark, M.response_extract, json.dumps(shape))
    assert (r.text, r.stop_reason, r.total_tokens) == (text, stop, total)


def test_unreadable_responses(spark):
    for c in ("{broken", "", None):
        assert one(spark, M.response_extract, c).text == ""


BOTH = lambda a: [("start", a, None, None), ("end", a, None, None)]


@pytest.mark.parametrize(("answer", "rows"), [
    (" Merge ", BOTH("merge")), ("0", BOTH("split")), ("1", BOTH("join")), ('"2"', BOTH("merge")), ("maybe", []), ("", []), ("true", []),
    ('```json\n{"pairs":{"start":{"action":"join","text":" a\nb "},"end":{"action":2,"merged":{"text":"m","tag":"h1"}}}}\n```', [("start", "join", "a\nb", None), ("end", "merge", "m", "h1")]),
    ('{"pairs":{"start":{"action":"x"}},"decision":"split"}', BOTH("split")),
    ('[{"a":1},"x",{"decision":"","action":"1"},"split"]', BOTH("join")), ("[]", []),
    ('{"sections":{"start":{"merged":{"mergedText":"t","tag":"p","split":1}},"end":{"html":"<p>h</p>"}}}', [("start", "split", "t", "p"), ("end", "join", "", None)]),
    ('{"start":"  ","end":{"merged_blocks":[{"text":"a  b"},{"text":7},{"text":"c"}]}}', [("start", "split", None, None), ("end", "join", "a b\n\nc", None)]),
    ('{"start":{},"other":1}', []),
])
def test_both_ends_of_join_answers(spark, answer, rows):
    assert [tuple(r) for r in one(spark, M.join_sections, answer)] == rows


class Outermost(HTMLParser):
    """Texts of the outermost block elements, and all text, as the standard parser sees them."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.blocks, self.texts, self.hidden = [], [], [], None
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden = tag
        elif tag in M.BLOCK_TAGS:
            if not self.stack:
                self.blocks.append([])
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = None
        elif tag in M.BLOCK_TAGS and self.stack:
            self.stack.pop()

    def handle_data(self, data):
        if self.hidden is None and data.strip():
            self.texts.append(data.strip())
            if self.stack:
                self.blocks[-1].append(data.strip())


PAGES = [
    "<p>plain</p><div>two <b>bold</b> three</div>",
    "<!-- <p>hidden</p> --><p>a<!-- x > y -->b</p>",
    '<p title="a > b" data-x=\'<p>\'>quoted</p><p>next</p>',
    '<script type="x>y">if (a < b) { w("<p>no</p>") }</script><p>after</p><style>p > a { }</style><p>last</p>',
    "<div>before<script>document.write('</div><p>no</p>')</script>behind</div>",
    "<!DOCTYPE html><p>a &lt; b &amp; c</p>", "<p>1 < 2 and 3 > 2</p>", "only text <i>here</i>", "<script>x</script>",
    "<stylex>custom</stylex><p>p</p>", "<p " + " ".join(f'a{i}="{"v" * 50}>"' for i in range(400)) + ">long tag</p>", "",
]


def test_blocks_are_those_of_the_standard_parser(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)), "page_id int, html string")
    got = {}
    for r in html.html_to_blocks(df, "html").orderBy("page_id", "ord").collect():
        got.setdefault(r.page_id, []).append(r.text)
    for i, page in enumerate(PAGES):
        seen = Outermost(page)
        blocks = [" ".join(b) for b in seen.blocks if b]
        assert got.get(i, []) == (blocks or ([" ".join(seen.texts)] if seen.texts else [])), page


def test_a_comment_without_end_reaches_to_the_end(spark):
    df = spark.createDataFrame([(1, "<p>open <!-- never closed <p>lost</p>")], "page_id int, html string")
    assert [r.text for r in html.html_to_blocks(df, "html").collect()] == ["open"]
