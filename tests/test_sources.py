import json

import pytest
from pyspark.sql import functions as F

from folio.functions import library
from folio.functions import markup as M
from folio.functions import text as T
from folio.operators import html
from folio.sources import page_xml, records

BODY = (
    '<{p}Styles><{p}TextStyle ID="F1" FONTSIZE="10.5"/></{p}Styles><{p}Layout><{p}Page WIDTH="1000" HEIGHT="1500"><{p}PrintSpace WIDTH="900" HEIGHT="1400">'
    '<{p}TextBlock ID="A"><{p}TextLine HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4" STYLEREFS="P F1"><{p}String CONTENT="a &amp;amp; b" HPOS="5"/></{p}TextLine></{p}TextBlock>'
    '<{p}ComposedBlock><{p}ComposedBlock><{p}TextBlock ID="B" STYLEREFS="P F1"><{p}TextLine WIDTH="9"><{p}String CONTENT="deep" HEIGHT="x"/></{p}TextLine></{p}TextBlock></{p}ComposedBlock></{p}ComposedBlock>'
    '<{p}TextBlock ID="C"><{p}TextLine><{p}String CONTENT="last"/></{p}TextLine></{p}TextBlock>'
    '<{p}Illustration HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4"/></{p}PrintSpace></{p}Page></{p}Layout>'
)
NS = "http://www.loc.gov/standards/alto/ns-v%d#"


def pages(spark):
    rows = [
        (1, f'<alto xmlns="{NS % 3}">' + BODY.format(p="") + "</alto>"),
        (2, f'<alto xmlns="{NS % 2}">' + BODY.format(p="") + "</alto>"),
        (3, f'<a:alto xmlns:a="{NS % 3}">' + BODY.format(p="a:") + "</a:alto>"),
        (4, "<alto>" + BODY.format(p="") + "</alto>"),
        (5, "<alto><Layout><broken"),
        (6, '<alto><Layout><Page WIDTH="7" HEIGHT="8"><PrintSpace/></Page></Layout></alto>'),
    ]
    return page_xml.parse(spark.createDataFrame(rows, "page_id bigint, xml string"))


def test_versions_prefixes_and_order(spark):
    lines = page_xml.layout_lines(pages(spark)).orderBy("page_id", "block_seq").collect()
    for page in (1, 2, 3, 4):
        mine = [r for r in lines if r.page_id == page]
        assert [(r.block_id, r.block_seq, r.tokens[0].content) for r in mine] == [("A", 0, "a & b"), ("B", 1, "deep"), ("C", 2, "last")]
        assert [r.font_size for r in mine] == [10.5, 10.5, 0.0]
        assert mine[1].tokens[0].height is None and mine[0].bottom == 6
    assert not [r for r in lines if r.page_id > 4]


def test_geometry_flags_bad_pages(spark):
    rows = {r.page_id: r for r in page_xml.geometry(pages(spark)).collect()}
    assert (rows[1].page_w, rows[1].ps_h, rows[1].parsed) == (1000, 1400, True)
    assert rows[5].parsed is False and (rows[6].page_w, rows[6].ps_w) == (7, 0)
    assert page_xml.illustrations(pages(spark)).filter("page_id < 5").count() == 4


def test_read_pages_from_files(spark, tmp_path):
    for book in ("a", "b"):
        (tmp_path / book).mkdir()
        (tmp_path / book / "p1.xml").write_bytes(f'<?xml version="1.0"?>\n<alto xmlns="{NS % 3}">'.encode() + BODY.format(p="").replace("last", "l\0st").encode().replace(b"\0", b"\xff") + b"</alto>")
    read = page_xml.read_pages(spark, str(tmp_path))
    parsed = page_xml.parse(read)
    assert sorted((r.page_id, r.parsed) for r in page_xml.geometry(parsed).collect()) == [("a/p1", True), ("b/p1", True)]
    lines = page_xml.layout_lines(parsed)
    assert {r.book_id for r in lines.collect()} == {"a", "b"} and "l\ufffdst" in {t.content for r in lines.collect() for t in r.tokens}
    (tmp_path / "a" / "p1.txt").write_text("<alto/>")
    with pytest.raises(ValueError, match="a/p1"):
        page_xml.read_pages(spark, str(tmp_path))


def _one(spark, body, head='<alto><Layout>', tail="</Layout></alto>"):
    return page_xml.parse(spark.createDataFrame([(1, head + body + tail)], "page_id bigint, xml string"))


def _block(word, attrs=""):
    return f'<TextBlock {attrs}><TextLine WIDTH="1"><String CONTENT="{word}"/></TextLine></TextBlock>'


def test_blocks_wherever_they_stand(spark):
    deep = "<ComposedBlock>" * 9 + _block("deep", 'ID="d"') + '<Illustration HPOS="2.5"/>' + "</ComposedBlock>" * 9
    body = (
        f'<Page WIDTH="10.9" HEIGHT="x"><TopMargin>{_block("top")}</TopMargin><PrintSpace WIDTH="5"><!-- {_block("gone", "ID=\'d\'")} -->{deep}'
        f'{_block("same", "ID=\'d\'")}<TextBlock/>{_block("no id")}</PrintSpace></Page><Page WIDTH="77"><PrintSpace>{_block("second page &gt; &#269;")}</PrintSpace></Page>')
    parsed = _one(spark, body)
    lines = page_xml.layout_lines(parsed).orderBy("block_seq").collect()
    assert [(r.block_seq, r.tokens[0].content) for r in lines] == [(0, "top"), (1, "deep"), (2, "same"), (4, "no id"), (5, "second page > č")]
    geo = page_xml.geometry(parsed).first()
    assert (geo.page_w, geo.page_h, geo.ps_w, geo.parse_error) == (10, 0, 5, True)
    assert [tuple(r) for r in page_xml.illustrations(parsed).collect()] == [(1, 0, 2.5, 0.0, 0.0, 0.0)]
    assert tuple(page_xml.page_size(page_xml.geometry(parsed)).first()) == (1, 5, 0, 10, 0)


def test_coordinates_with_decimals(spark):
    line = '<Page><PrintSpace><TextBlock><TextLine HPOS="500.5" VPOS="7" WIDTH="9.0" HEIGHT="tall"><String CONTENT="a" HPOS="3.9" WIDTH=""/></TextLine></TextBlock></PrintSpace></Page>'
    r = page_xml.layout_lines(_one(spark, line)).first()
    assert (r.hpos, r.vpos, r.width, r.height, r.bottom, r.parse_error) == (500, 7, 9, 0, 7, True)
    assert (r.tokens[0].hpos, r.tokens[0].width) == (3, None)


def test_scale_falls_back(spark):
    geo = spark.createDataFrame([(1, 100, 200, 50, 50), (2, 0, 200, 50, 40), (3, 0, 0, 0, 0)], "page_id int, page_w bigint, page_h bigint, ps_w bigint, ps_h bigint")
    got = [tuple(r) for r in page_xml.scale(geo, F.lit(200), F.lit(400)).orderBy("page_id").collect()]
    assert got == [(1, 2.0, 2.0), (2, 4.0, 10.0), (3, 1.0, 1.0)]


def test_unescape_is_complete(spark):
    import html

    texts = [
        "a &amp;lt; b", "&#269;&eacute;&mdash;&notit;&not;&foo; & &", "&#x80;&#128;&#0;&#xD800;&#x110000;&#99999999999;&#1;&#x1F600;", "&ampx &AMP &copy", "plain", "",
        "&NotEqualTilde;&nGt;", "&#x0041;&#65"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.unescape("t")).collect()]
    assert got == [html.unescape(t) for t in texts]


def test_page_number_without_line_end(spark):
    row = spark.createDataFrame([("12\n", "uuid:" + "x" * 1_500_000)], "n string, u string").select(T.page_number("n"), F.length(T.strip_uuid("u"))).first()
    assert (row[0].value, row[0].searchable, row[1]) == ("12", True, 1_500_000)


def test_settings_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"display_name": "Good", "model": "m", "settings": {"per_model": {"m": {"top_p": 0.4}}}}))
    (tmp_path / "bad.json").write_text("{no")
    rows = {r.name: r for r in records.settings(records.settings_files(spark, str(tmp_path))).collect()}
    assert rows["bad"].display_name == "bad" and rows["bad"].model is None
    assert rows["good"].per_model["m"].top_p == 0.4


def _fragments(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "page_id bigint, html string")
    got = {i: [] for i in range(len(docs))}
    for r in html.html_blocks(df, "html").orderBy("page_id", "block_no").collect():
        got[r.page_id].append(r.fragment)
    return got


def test_html_blocks_by_example(spark):
    cases = {
        "<p>a</p><p>b</p>": ["<p>a</p>", "<p>b</p>"],
        "before<p>a<b>c</b></p> after": ["before", "<p>a<b>c</b></p>", " after"],
        "<hr/><br><div><p>x</p><br></div>": ["<hr/>", "<br>", "<div><p>x</p><br></div>"],
        "<p>open <b>still": ["<p>open <b>still"],
        "</p>x</div><p>y</p>": ["x", "<p>y</p>"],
        "only text": ["only text"],
        "</p></b>": ["</p></b>"],
    }
    assert list(_fragments(spark, list(cases)).values()) == list(cases.values())


def test_html_blocks_lose_nothing_but_stray_closings(spark):
    import random
    import re

    rnd = random.Random(4)
    docs = []
    for _ in range(200):  # well nested: what is opened is closed
        open_, out = [], []
        for _ in range(rnd.randrange(1, 14)):
            out.append(rnd.choice(["text", " ", "<br>", "<hr/>", "<small>x</small>"]))
            if rnd.random() < 0.5:
                open_.append(rnd.choice(["p", "b", "div"]))
                out.append(f"<{open_[-1]}>")
            elif open_:
                out.append(f"</{open_.pop()}>")
        docs.append("".join(out) + "".join(f"</{t}>" for t in reversed(open_)))
    for i, fragments in _fragments(spark, docs).items():
        assert "".join(fragments) == docs[i]
        for f in fragments:
            assert len(re.findall(r"<(?:p|b|div|small)>", f)) == len(re.findall(r"</(?:p|b|div|small)>", f))
    strays = _fragments(spark, ["</div>" + d for d in docs[:40]])
    assert all("".join(strays[i]) == docs[i] for i in range(40) if "<" in docs[i])


def test_document_blocks(spark):
    rows = [(1, "<section><h1> A &amp; b</h1><p><small>n</small><br/></p><div class='x'></div><li>i <b>j</b></li></section>"), (2, "only <i>text</i>")]
    got = html.html_to_blocks(spark.createDataFrame(rows, "page_id bigint, html string"), "html").orderBy("page_id", "ord").collect()
    assert [(r.page_id, r.block_id, r.type, r.text) for r in got] == [
        (1, "b1", "h1", "A & b"), (1, "b2", "small", "n"), (1, "b3", "li", "i j"), (2, "b1", "p", "only text")]


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert one(M.strip_fences(lit("```json\n{\"a\":1}\n```"))) == '{"a":1}'
    assert one(M.json_repair(lit('{"a": "x\ny\\"\n",\n"b": 1}'))) == '{"a": "x\\ny\\"\\n",\n"b": 1}'
    assert one(M.join_decision(lit('{"pairs":{"start":{"action":"2"}}}'))) == "merge"
    assert one(M.join_decision(lit("nonsense"))) == "split"
    assert one(T.page_label(lit(" [ A 12 ] "))) == "a12"
    assert one(T.clean_text(lit("\u00a0 a \t b\u00a0"))) == "a b"
    assert one(T.clamp(lit("9"), 0, 2, 0.5)) == 2.0 and one(T.clamp(lit("x"), 0, 2, 0.5)) == 0.5
    assert one(T.reasoning_effort(lit(" HIGH "))) == "high" and one(T.reasoning_effort(lit("none"))) == "medium"
    assert one(library.scoped_model(lit("openai/m"), lit("openai"))) == "m"
    assert one(library.scoped_model(lit("openai/m"), lit("other"))) == "openai/m"
    assert one(records.label_text(lit('{"cs":["x"]}'))) == "x"
    assert one(M.validate_changes(lit('{"changes":[{"id":"b1","text":"t"}]}'))).ok
    assert one(M.validate_changes(lit('{"changes":[{"id":"1","text":"t"}]}'))).reason == "id"
