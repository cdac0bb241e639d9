"""Markup column functions: block types, block html, note predicates, JSON wrappers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import text as T

# Tags that form blocks, and tags without content.
BLOCK_TAGS = ["p", "div", "blockquote", "li", "h1", "h2", "h3", "small", "note"]
VOID_TAGS = ["br", "hr", "img", "input", "meta", "link", "source", "track", "area", "col", "embed", "param", "wbr", "base"]
TAG = "<[^>]+?>"
NOTE_STYLE = "display:block;font-size:0.82em;color:#1e5aa8;font-weight:bold;"
PICTURE_STYLE = "display:block;font-size:0.82em;color:#1c9b4a;font-weight:bold;"
# Fragments of the joiner rules.
SENTENCE_END = r"[.!?…][\"'„“”«»‚‘’‹›)\]\s]*$"
SENTENCE_START = r"^[\s\"'„“”«»‚‘’‹›(\[{\-—–]*[A-ZÀ-Ž]"
SENTENCE_END_CLIENT = r"[.!?…:][\"'„“”«»‚‘’‹›)\]\s]*$"
SENTENCE_START_CLIENT = r"^[\s\"'„“”«»‚‘’‹›(\[{\-—–]*[A-ZÀ-Ÿ]"
LEADING_PUNCT = r"^[,.;:!?)]"


def tag_name(tag: Column) -> Column:
    """Name of a tag, opening or closing, lower case."""
    return F.lower(F.regexp_extract(tag, r"^<\s*/?\s*([a-zA-Z0-9:-]+)", 1))


def fragment_text(c: Column) -> Column:
    """Text of a fragment: the trimmed text pieces between tags, joined by a space, entities decoded."""
    pieces = F.transform(F.split(c, TAG), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return T.unescape(F.array_join(F.filter(pieces, lambda x: x != ""), " "))


def block_type(c: Column) -> Column:
    """Type of a block fragment, from its first tag, its class and what it holds."""
    name = tag_name(c)
    inner = F.regexp_replace(F.regexp_replace(c, r"(?is)^<p[^>]*>", ""), r"(?is)</p\s*>\s*$", "")
    bare = F.regexp_replace(F.regexp_replace(inner, r"(?is)<small[^>]*>.*?</small>", ""), r"(?is)<br[^>]*>", "")
    only_small = F.lower(inner).contains("<small") & (F.trim(F.regexp_replace(bare, r"\s+", " ")) == "")
    cls = F.concat(F.lit(" "), F.lower(F.regexp_extract(c, r'(?is)^<div[^>]*class="([^"]*)"', 1)), F.lit(" "))
    return (
        F.when(name.isin("h1", "h2", "h3", "small", "note", "blockquote", "li"), name)
        .when((name == "p") & only_small, "small")
        .when((name == "div") & cls.contains(" centered "), "centered")
        .when((name == "div") & cls.contains(" note "), "note")
        .otherwise("p")
    )


def block_html(type_: Column, text: Column, block_id: Column, profile: str) -> Column:
    """Html of a document block; profiles ``server``, ``diff`` (keeps ids) and ``client``."""
    t = F.trim(text)
    kind = F.lower(F.coalesce(type_, F.lit("p")))
    body = T.escape(t, quote=profile == "server")
    if profile == "client":
        body = F.replace(F.replace(body, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))
        block_id = F.lit("")
    wrap = lambda tag, attrs="": F.concat(F.lit(f"<{tag}"), attrs if isinstance(attrs, Column) else F.lit(attrs), F.lit(">"), body, F.lit(f"</{tag}>"))
    if profile == "server":
        note = F.when(
            F.lower(t).startswith("ilustrace"), wrap("note", f' class="illustration" style="{PICTURE_STYLE}"')
        ).otherwise(wrap("note", f' style="{NOTE_STYLE}"'))
        html = (
            F.when(kind == "h1", wrap("h1")).when(kind == "h2", wrap("h2")).when(kind == "h3", wrap("h3"))
            .when(kind == "small", F.concat(F.lit("<p><small>"), body, F.lit("</small></p>")))
            .when(kind == "note", note)
            .when(kind == "centered", wrap("div", ' class="centered"'))
            .when(kind == "blockquote", wrap("blockquote"))
            .otherwise(wrap("p"))
        )
        return F.when(t != "", html)
    bid = F.when(
        F.coalesce(block_id, F.lit("")) != "",
        F.concat(F.lit(' data-block-id="'), T.escape(block_id, quote=False), F.lit('"')),
    ).otherwise(F.lit(""))
    typed = lambda v: F.concat(bid, F.lit(' data-block-type="'), T.escape(v, quote=False), F.lit('"'))
    html = (
        F.when(kind == "h1", wrap("h1", bid)).when(kind == "h2", wrap("h2", bid)).when(kind == "h3", wrap("h3", bid))
        .when(kind == "small", F.concat(F.lit("<p"), bid, F.lit("><small>"), body, F.lit("</small></p>")))
        .when(kind == "note", F.concat(F.lit("<br>"), wrap("note", F.concat(bid, F.lit(f' style="{NOTE_STYLE}"')))))
        .when(kind == "centered", wrap("div", F.concat(bid, F.lit(' class="centered"'))))
        .when(kind == "blockquote", wrap("blockquote", bid))
        .when(kind.isin("p", ""), wrap("p", bid))
        .otherwise(wrap("p", typed(kind)))
    )
    return F.when(t != "", html)


def snippet_html(tag: Column, text: Column) -> Column:
    """Plain html of a snippet."""
    return F.concat(F.lit("<"), tag, F.lit(">"), T.escape(text, quote=True), F.lit("</"), tag, F.lit(">"))


def opening_tag(html: Column) -> Column:
    """First tag of a block with its attributes; null if it does not begin with one."""
    found = lambda n: F.regexp_extract(html, r"^\s*<([a-zA-Z0-9:-]+)([^>]*)>", n)
    attrs = T.let(F.regexp_replace(found(2), r"^\s+|\s+$", ""), lambda a: F.when(a == "", "").otherwise(F.concat(F.lit(" "), a)))
    return F.when(found(1) != "", F.concat(F.lit("<"), found(1), attrs, F.lit(">")))


def is_small(markup: Column, tag: Column) -> Column:
    return (tag == "small") | F.lower(markup).contains("<small")


def is_note(markup: Column, tag: Column) -> Column:
    low = F.lower(markup)
    return (tag == "note") | low.contains("<note") | low.rlike("class=[\"']note[\"']")


def is_illustration(markup: Column, tag: Column) -> Column:
    opening = F.lower(F.regexp_extract(markup, r"(?is)^\s*(<[^>]*>)", 1))
    cls = F.regexp_extract(opening, "class=[\"']([^\"']*)[\"']", 1)
    kind = F.regexp_extract(opening, "data-(?:kind|type)=[\"']([^\"']*)[\"']", 1)
    return (tag == "note") & (cls.contains("illustration") | (kind == "illustration"))


def md_line(tag: Column, text: Column) -> Column:
    t = F.lower(F.coalesce(tag, F.lit("p")))
    mark = F.when(t == "h1", "# ").when(t == "h2", "## ").when(t == "h3", "### ").when(t == "blockquote", "> ").otherwise("")
    return F.concat(mark, text)


def strip_fences(c: Column) -> Column:
    """Text without the surrounding Markdown code fence."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    fenced = t.startswith("```") & t.endswith("```")
    inner = F.regexp_extract(t, r"(?s)^[^\n]*\n(.*)\n```", 1)
    has_body = t.rlike(r"(?s)^[^\n]*\n(.*)\n```")
    return F.when(
        fenced & has_body, F.regexp_replace(inner, r"^\s+|\s+$", "")
    ).when(fenced, F.regexp_replace(F.btrim(t, F.lit("`")), r"^\s+|\s+$", "")).otherwise(t)


def json_repair(c: Column) -> Column:
    """Raw line breaks inside JSON strings replaced by an escaped one.

    Cut at quotes that are not escaped: the odd pieces are the insides of strings.
    """
    masked = F.regexp_replace(c, r"\\([\s\S])", "\u0001$1\u0002")
    pieces = F.split(F.regexp_replace(masked, "\u0001\"\u0002", "\u0003"), '"', -1)
    fixed = F.transform(
        pieces, lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, "(?<!\u0001)[\n\r\u2028\u2029]", r"\\n")).otherwise(x)
    )
    joined = F.array_join(fixed, '"')
    back = F.replace(joined, F.lit("\u0003"), F.lit('\\"'))
    return F.regexp_replace(back, "\u0001([\\s\\S])\u0002", r"\\$1")


def _decision(v: Column) -> Column:
    t = F.lower(F.trim(v))
    return (
        F.when(t.isin("join", "merge", "split"), t)
        .when(t == "0", "split").when(t == "1", "join").when(t == "2", "merge")
    )


def join_decision(c: Column) -> Column:
    """Decision of a page-join answer: a word, a digit, or JSON; ``split`` when unreadable."""
    direct = F.regexp_replace(c, r"^\s+|\s+$", "")
    repaired = json_repair(direct)
    get = lambda path: F.coalesce(F.get_json_object(direct, path), F.get_json_object(repaired, path))
    in_pairs = get("$.pairs").startswith("{")
    start = lambda name: F.when(F.coalesce(in_pairs, F.lit(False)), get(f"$.pairs.start.{name}")).otherwise(get(f"$.start.{name}"))
    plain = get("$.decision.start")
    return F.coalesce(
        _decision(direct),
        _decision(F.coalesce(F.when(start("action") != "", start("action")), start("decision"))),
        F.when(plain == "0", "split").when(plain == "1", "join").when(plain == "2", "merge"),
        F.lit("split"),
    )


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or the name of a number's type."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _items(v: Column) -> Column:
    """Elements of an array, none of anything else."""
    return T.let(v, lambda v: F.coalesce(F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")), F.expr("cast(array() as array<variant>)")))


def _string(v: Column) -> Column:
    """A string that is not empty, null for anything else."""
    return T.let(v, lambda v: F.when((_kind(v) == "STRING") & (F.to_json(v) != '""'), F.try_variant_get(v, "$", "string")))


def _truthy(v: Column) -> Column:
    """The value, or null if it is empty, zero, false or null."""
    return T.let(v, lambda v: F.when(~F.coalesce(F.to_json(v).isin('""', "0", "0.0", "false", "null", "[]", "{}"), F.lit(True)), v))


def response_extract(c: Column) -> Column:
    """STRUCT(text, stop_reason, input_tokens, output_tokens, total_tokens) of a model's response, whatever its shape.

    The text is ``output_text`` if that is given; else that of the parts of ``output`` or ``outputs``, each a string or an object
    with ``value`` or ``text``; else that of the first choice's message, a string or a list of parts.  Unreadable JSON gives
    an empty text and nulls.
    """
    def said(text: Column) -> Column:
        inner = F.coalesce(_truthy(_field(text, "$.value")), _truthy(_field(text, "$.text")))
        told = T.let(inner, lambda i: F.when(_kind(i).isin("OBJECT", "ARRAY"), F.to_json(i)).otherwise(F.try_variant_get(i, "$", "string")))
        return F.when(_kind(text) == "STRING", F.try_variant_get(text, "$", "string")).when(_kind(text) == "OBJECT", told)

    def joined(texts: Column) -> Column:
        return T.let(F.filter(texts, lambda t: t.isNotNull()), lambda ts: F.when(F.size(ts) > 0, F.array_join(ts, "\n")))

    def spoken(output: Column) -> Column:
        blocks = F.flatten(F.transform(_items(output), lambda o: _items(_field(o, "$.content"))))
        voiced = F.filter(blocks, lambda p: F.coalesce(_string(_field(p, "$.type")).isin("output_text", "text"), F.lit(False)))
        stops = F.transform(_items(output), lambda o: F.try_variant_get(_truthy(_field(o, "$.stop_reason")), "$", "string"))
        return F.struct(joined(F.transform(voiced, lambda p: T.let(_field(p, "$.text"), said))).alias("text"),
                        F.get(F.filter(stops, lambda s: s.isNotNull()), F.lit(0)).alias("stop"))

    def chosen(content: Column) -> Column:
        parts = F.transform(_items(content), lambda p: F.coalesce(_string(_field(p, "$.text")), _string(p)))
        return F.coalesce(_string(content), joined(parts))

    def read(r: Column) -> Column:
        output = F.coalesce(_truthy(_field(r, "$.output")), _field(r, "$.outputs"))
        choice = F.get(_items(_field(r, "$.choices")), F.lit(0))
        usage = lambda name: F.try_variant_get(r, f"$.usage.{name}", "bigint").alias(name)
        chat = F.struct(T.let(_field(choice, "$.message.content"), chosen).alias("text"), F.try_variant_get(choice, "$.finish_reason", "string").alias("stop"))
        told = lambda s, h: F.struct(
            F.regexp_replace(F.coalesce(_string(_field(r, "$.output_text")), s["text"], h["text"], F.lit("")), r"^\s+|\s+$", "").alias("text"),
            F.coalesce(s["stop"], h["stop"]).alias("stop_reason"), usage("input_tokens"), usage("output_tokens"), usage("total_tokens"))
        return T.let(T.let(output, spoken), lambda s: T.let(chat, lambda h: told(s, h)))

    return T.let(F.try_parse_json(c), read)


def _label(v: Column) -> Column:
    """join, merge or split for a word or digit given as a string or number."""
    word = T.let(v, lambda v: F.when(_kind(v).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(v, "$", "string")))
    return T.let(word, _decision)


SECTIONS = "array<struct<section:string,action:string,text:string,tag:string>>"


def join_sections(c: Column) -> Column:
    """Decisions of a page-join answer for both ends of a page: an array of (section, action, text, tag), start before end.

    An answer is, the first that fits: a word or digit, which holds for both ends; JSON, fenced or with raw line breaks, with
    ``pairs`` of actions and merged texts; a word or digit as JSON; a list, whose first readable item holds for both; an object,
    or its ``sections``, with a ``decision`` for both or with merged text for either end.  An end with nothing merged is split.
    What cannot be read gives no rows.
    """
    none = F.lit(None).cast("string")
    row = lambda section, action, text=none, tag=none: F.struct(F.lit(section).alias("section"), action.alias("action"), text.alias("text"), tag.alias("tag"))
    both = lambda action: T.let(action, lambda a: F.when(a.isNotNull(), F.array(row("start", a), row("end", a))))
    strip = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    blank = lambda t: F.nullif(strip(t), F.lit(""))
    given = lambda *rows: T.let(F.filter(F.array(*rows), lambda r: r["action"].isNotNull()), lambda rs: F.when(F.size(rs) > 0, rs))

    def pair(section: str, p: Column) -> Column:
        def told(action: Column) -> Column:
            joins = action.isin("join", "merge")
            text = F.when(_kind(_field(p, "$.merged.text")) == "STRING", _string(_field(p, "$.merged.text"))).otherwise(_string(_field(p, "$.text")))
            return row(section, action, F.when(joins, blank(text)), F.when(joins, _string(_field(p, "$.merged.tag"))))

        return T.let(F.when(_kind(p) == "OBJECT", _label(_field(p, "$.action"))), told)

    def merged(section: str, end: Column) -> Column:
        def told(s: Column) -> Column:
            words = F.coalesce(*[_truthy(_field(s, f"$.{n}")) for n in ("merged_text", "mergedText", "merged", "joined", "result", "text")])
            html = F.coalesce(*[_truthy(_field(s, f"$.{n}")) for n in ("merged_html", "mergedHtml", "html")])
            lists = F.coalesce(*[T.let(_field(s, f"$.{n}"), lambda x: F.when(_kind(x) == "ARRAY", x)) for n in ("merged_blocks", "mergedBlocks", "blocks")])
            parts = F.filter(F.transform(_items(lists), lambda b: blank(F.regexp_replace(_string(_field(b, "$.text")), r"\s+", " "))), lambda t: t.isNotNull())
            filled = lambda t: T.let(_string(t), lambda t: F.when(blank(t).isNotNull(), t))
            blocks = T.let(parts, lambda ts: F.when(F.size(ts) > 0, F.array_join(ts, "\n\n")))
            text = F.coalesce(filled(words), blocks, F.when(filled(html).isNotNull(), F.lit("")))
            whole = F.when(_kind(s) == "STRING", blank(_string(s))).when(_kind(s) == "OBJECT", text)
            split = F.coalesce((_kind(s) == "OBJECT") & _truthy(_field(s, "$.split")).isNotNull(), F.lit(False))
            tag = F.when(_kind(s) == "OBJECT", _string(_field(s, "$.tag")))
            return T.let(whole, lambda w: row(section, F.when(w.isNull() | split, "split").otherwise("join"), w, tag))

        read = T.let(F.coalesce(_truthy(_field(end, "$.merged")), end), told)
        return F.when(end.isNotNull(), read).otherwise(row(section, none))

    def sections(ends: Column) -> Column:
        end = lambda name: T.let(_truthy(_field(ends, f"$.{name}")), lambda e: merged(name, e))
        return F.coalesce(both(_label(_field(ends, "$.decision"))), given(end("start"), end("end")))

    def read(v: Column) -> Column:
        items = F.transform(_items(v), lambda i: F.coalesce(_label(i), _label(F.coalesce(_truthy(_field(i, "$.decision")), _field(i, "$.action")))))
        listed = F.get(F.filter(items, lambda a: a.isNotNull()), F.lit(0))
        one = lambda name: T.let(_field(v, f"$.pairs.{name}"), lambda p: pair(name, p))
        pairs = given(one("start"), one("end"))
        return F.when(_kind(v) == "ARRAY", both(listed)).when(
            _kind(v) == "OBJECT", F.coalesce(pairs, T.let(F.coalesce(_truthy(_field(v, "$.sections")), v), sections))).otherwise(both(_label(v)))

    fenced = F.regexp_extract(strip(c), r"(?s)^```[a-zA-Z0-9_-]*\s*(.*?)(?:```(?!.*```).*)?$", 1)
    body = T.let(F.when(strip(c).startswith("```"), strip(fenced)).otherwise(strip(c)), lambda t: F.coalesce(F.try_parse_json(t), F.try_parse_json(json_repair(t))))
    return F.coalesce(both(_decision(strip(c))), T.let(body, read), F.array().cast(SECTIONS))


def validate_changes(c: Column) -> Column:
    """STRUCT(ok, reason): a ``changes`` list whose items hold exactly an id ``b<n>`` and a text."""
    raw = F.get_json_object(c, "$.changes")
    items = F.from_json(raw, "array<map<string,string>>")
    keys = lambda m: F.array_sort(F.map_keys(m))
    bad_keys = F.exists(items, lambda m: keys(m) != F.array(F.lit("id"), F.lit("text")))
    bad_id = F.exists(items, lambda m: ~F.coalesce(m["id"].rlike(r"^b\d+$"), F.lit(False)))
    reason = (
        F.when(raw.isNull() | ~F.coalesce(raw.startswith("["), F.lit(False)) | items.isNull(), "changes")
        .when(bad_keys, "keys")
        .when(bad_id, "id")
        .otherwise("")
    )
    return F.struct((reason == "").alias("ok"), reason.alias("reason"))
