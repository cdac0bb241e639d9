"""Word search and text by region on the page image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T


def word_boxes(tokens: DataFrame, queries: DataFrame, sx: Column, sy: Column) -> DataFrame:
    """Closed five-point polygon, y negated, of every word that matches a query word.

    ``queries``: query_id, query and, to look on one page only, page_id.  A word matches by its text or by its whole hyphenated form; a
    query word given twice counts twice, and one that is only punctuation matches nothing.
    """
    cut = F.trim(F.replace(F.element_at(F.split("query", "~"), 1), F.lit('"'), F.lit("")))
    place = [c for c in ("page_id",) if c in queries.columns]
    words = queries.select("query_id", *place, F.posexplode(F.split(cut, r"\s+")).alias("word_no", "raw")).select(
        "query_id", *place, "word_no", T.query_word("raw").alias("word")
    ).filter("word <> ''")
    forms = F.array_distinct(F.array_compact(F.array(T.query_word("content"), T.query_word("subs_content"))))
    spelled = tokens.select(
        "page_id", "block_seq", "line_seq", "token_seq", "hpos", "vpos", "width", "height", F.explode(forms).alias("word")
    )
    if place:
        # only words that their page asks for go into the shuffle by word; this join finds the pages where they stand
        asked = words.groupBy("page_id").agg(F.collect_set("word").alias("_asked"))
        spelled = spelled.join(asked.hint("shuffle_hash"), "page_id").filter(F.array_contains("_asked", F.col("word"))).drop("_asked")
    x0, y0 = F.col("hpos") * sx, -(F.col("vpos") * sy)
    x1, y1 = x0 + F.col("width") * sx, y0 - F.col("height") * sy
    ring = F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    return spelled.join(words, [*place, "word"]).select(
        "query_id", F.col("word_no").cast("bigint").alias("word_no"), "page_id", "block_seq", "line_seq", "token_seq", ring.alias("polygon")
    )


def text_in_box(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words fully inside a box, of lines fully inside it, joined in reading order.

    ``boxes``: page_id, box_id, x0, y0, x1, y1 in page units; boxes meet lines by page.
    """
    inside = lambda h, v, w, hh: (h >= F.col("x0")) & (h + w <= F.col("x1")) & (v >= F.col("y0")) & (v + hh <= F.col("y1"))
    near = lines.join(boxes, "page_id").filter(inside(F.col("hpos"), F.col("vpos"), F.col("width"), F.col("height")))
    value = lambda t: T.hyp_resolve(t.content, t.subs_content, t.subs_type)
    words = F.filter("tokens", lambda t: inside(t["hpos"], t["vpos"], t["width"], t["height"]) & (value(t) != ""))
    per_line = near.select(
        "page_id", "box_id", "block_seq", "line_seq", F.transform(words, value).alias("w")
    )
    return (
        per_line.groupBy("page_id", "box_id")
        .agg(F.array_sort(F.collect_list(F.struct("block_seq", "line_seq", "w"))).alias("ls"))
        .select("page_id", "box_id", F.array_join(F.flatten(F.transform("ls", lambda x: x.w)), " ").alias("text"))
    )


def full_text(lines: DataFrame, trailing_space: bool = False) -> DataFrame:
    """Text of every page: its words in reading order, hyphenated pairs resolved."""
    value = lambda t: T.hyp_resolve(t.content, t.subs_content, t.subs_type)
    words = F.filter(F.transform("tokens", value), lambda v: v != "")
    text = F.array_join(F.flatten(F.transform("ls", lambda x: x.w)), " ")
    return (
        lines.select("page_id", "block_seq", "line_seq", words.alias("w"))
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("block_seq", "line_seq", "w"))).alias("ls"))
        .select("page_id", (F.concat(text, F.lit(" ")) if trailing_space else text).alias("text"))
    )


def reading_blocks(lines: DataFrame, min_width: int = 50, max_gap: int = 50) -> DataFrame:
    """Blocks for reading aloud: lines wide enough, cut where the gap is large, with a bounding box."""
    order = Window.partitionBy("page_id").orderBy("block_seq", "line_seq")
    value = lambda t: T.hyp_resolve(t.content, t.subs_content, t.subs_type)
    text = F.trim(F.array_join(F.filter(F.transform("tokens", value), lambda v: v != ""), " "))
    wide = lines.filter(F.col("width") >= min_width).withColumn("txt", text)
    prev = F.lag("bottom").over(order)
    cut = F.coalesce((prev > 0) & (F.col("vpos") - prev > max_gap), F.lit(False))
    numbered = wide.withColumn("_cut", cut).withColumn("no", F.sum(F.when(F.col("_cut"), 1).otherwise(0)).over(order))
    at = F.struct("block_seq", "line_seq")
    blocks = numbered.filter("txt <> ''").groupBy("page_id", "no").agg(
        F.min_by("hpos", at).alias("h_min"), F.min_by("vpos", at).alias("v_min"),
        F.max(F.col("hpos") + F.col("width")).alias("h_max"), F.max("bottom").alias("v_max"),
        F.array_sort(F.collect_list(F.struct("block_seq", "line_seq", "txt"))).alias("ls"),
    )
    page = Window.partitionBy("page_id").orderBy("no")
    return blocks.select(
        "page_id", (F.row_number().over(page) - 1).cast("bigint").alias("block_no"), "h_min", "v_min", "h_max", "v_max",
        F.concat(F.array_join(F.transform("ls", lambda x: x.txt), "\n"), F.lit("\n")).alias("text"),
    )


# Fixed values of the older reading blocks.
V1_PAUSE = ". -- -- "
V1_MIN_LINES, V1_MIN_CHARS = 3, 120


def reading_blocks_v1(lines: DataFrame, min_width: int = 50, max_gap: int = 50) -> DataFrame:
    """Reading blocks of the older service: closed inside a line after a sentence end.

    Where a block closes depends on the length since the last close, a true running state, so the
    page's lines are folded in order inside one row; a page is bounded.
    """
    order = Window.partitionBy("page_id").orderBy("block_seq", "line_seq")
    prev = F.lag("bottom").over(order)
    wide = lines.filter(F.col("width") >= min_width).withColumn(
        "_pause", F.coalesce((prev > 0) & (F.col("vpos") - prev > max_gap), F.lit(False)))
    words = F.transform("tokens", lambda t: F.struct(
        t["seq"].alias("seq"), F.coalesce(t["content"], F.lit("")).alias("c"), t["hpos"].alias("x"), t["vpos"].alias("y"),
        (t["hpos"] + t["width"]).alias("x2"), (t["vpos"] + t["height"]).cast("bigint").alias("y2")))
    # a line whose places are all known and not 0 and that cannot close a block goes on whole; only other lines need their words
    placed = (F.size("_ts") > 0) & ~F.array_contains("_ts.x", 0) & ~F.array_contains("_ts.y", 0) & ~F.array_contains("_ts.x2", 0) & ~F.array_contains("_ts.y2", 0)
    joined = F.concat(F.array_join("_ts.c", " "), F.lit(" "))
    ends = F.col("_text").contains(". ") | F.col("_text").contains("; ")
    told = wide.withColumn("_ts", words).withColumn("_text", joined).withColumn("_placed", F.coalesce(placed, F.lit(False))).withColumn("_ends", ends)
    page = told.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(
        "block_seq", "line_seq", F.col("_pause").alias("pause"), F.col("_placed").alias("placed"), F.col("_ends").alias("ends"),
        F.when(F.col("_placed"), F.col("_text")).alias("text"), F.array_min("_ts.x").alias("x"), F.array_min("_ts.y").alias("y"),
        F.array_max("_ts.x2").alias("x2"), F.array_max("_ts.y2").alias("y2"),
        F.when(~F.col("_placed") | F.col("_ends"), F.col("_ts")).alias("ts"),
    ))).alias("ls"))
    block = "struct<text:string,h_min:bigint,v_min:bigint,h_max:bigint,v_max:bigint>"
    state = F.expr(
        f"named_struct('done', cast(array() as array<{block}>), 'text', '', 'lines', 0, 'h_min', cast(0 as bigint), "
        "'v_min', cast(0 as bigint), 'h_max', cast(0 as bigint), 'v_max', cast(0 as bigint))"
    )
    low = lambda old, new: F.when((old == 0) | (old > new), new).otherwise(old)
    high = lambda old, new: F.when((old == 0) | (old < new), new).otherwise(old)
    whole = lambda s: F.struct(s["text"], s["h_min"], s["v_min"], s["h_max"], s["v_max"])

    def token(s: Column, t: Column) -> Column:
        grown = F.struct(
            s["done"].alias("done"), F.concat(s["text"], t["c"]).alias("text"), s["lines"].alias("lines"),
            low(s["h_min"], t["x"]).alias("h_min"), low(s["v_min"], t["y"]).alias("v_min"),
            high(s["h_max"], t["x2"]).alias("h_max"), high(s["v_max"], t["y2"]).alias("v_max"),
        )
        closes = (grown["lines"] >= V1_MIN_LINES) & (t["c"].endswith(".") | t["c"].endswith(";")) & (F.length(grown["text"]) > V1_MIN_CHARS)
        zero = F.lit(0).cast("bigint")
        return F.when(closes, F.struct(
            F.array_append(grown["done"], whole(grown)).alias("done"), F.lit("").alias("text"), F.lit(0).alias("lines"),
            zero.alias("h_min"), zero.alias("v_min"), zero.alias("h_max"), zero.alias("v_max"),
        )).otherwise(grown.withField("text", F.concat(grown["text"], F.lit(" "))))

    def line(s: Column, ln: Column) -> Column:
        begun = s.withField(
            "text", F.when(ln["pause"] & (s["text"] != ""), F.concat(s["text"], F.lit(V1_PAUSE))).otherwise(s["text"])
        ).withField("lines", s["lines"] + 1)
        at_once = F.struct(
            begun["done"].alias("done"), F.concat(begun["text"], ln["text"]).alias("text"), begun["lines"].alias("lines"),
            low(s["h_min"], ln["x"]).alias("h_min"), low(s["v_min"], ln["y"]).alias("v_min"),
            high(s["h_max"], ln["x2"]).alias("h_max"), high(s["v_max"], ln["y2"]).alias("v_max"),
        )
        return F.when(ln["placed"] & (~ln["ends"] | (begun["lines"] < V1_MIN_LINES)), at_once).otherwise(F.aggregate(ln["ts"], begun, token))

    end = lambda s: F.when(s["text"] != "", F.array_append(s["done"], whole(s))).otherwise(s["done"])
    return page.select("page_id", F.posexplode(F.aggregate("ls", state, line, end)).alias("block_no", "b")).select(
        "page_id", F.col("block_no").cast("bigint").alias("block_no"), "b.*"
    )


# Fixed values of the older formatter.
V1_H1_OVER, V1_H2_OVER, V1_STEP = 18, 11, 40


def page_html_v1(lines: DataFrame, block_size: Column) -> DataFrame:
    """Html of the older formatter: tag by the block's font size, cuts at large steps, bold first lines as h3.

    Bold lines at the start of a segment each stand alone; the rest of the segment is one block.
    """
    order = Window.partitionBy("page_id", "block_seq").orderBy("line_seq")
    value = lambda t: T.hyp_resolve(t.content, t.subs_content, t.subs_type)
    shown = F.filter("tokens", lambda t: F.coalesce(t["subs_type"] != "HypPart2", F.lit(True)))
    text = F.array_join(F.transform(shown, lambda t: F.concat(value(t), F.lit(" "))), "")
    bold = F.forall("tokens", lambda t: F.coalesce(t["style"].contains("bold"), F.lit(False)))
    step = lambda now, before: F.coalesce((before > 0) & (now - before > V1_STEP), F.lit(False))
    cut = step(F.col("vpos"), F.lag("bottom").over(order)) | step(F.col("hpos"), F.lag("hpos").over(order))
    seg = Window.partitionBy("page_id", "block_seq", "seg").orderBy("line_seq")
    marked = (
        lines.filter("width >= 50")
        .withColumn("txt", text).withColumn("_bold", bold).withColumn("_cut", cut)
        .withColumn("seg", F.sum(F.when(F.col("_cut"), 1).otherwise(0)).over(order))
        .withColumn("h3", F.min(F.col("_bold") & (F.col("txt") != "")).over(seg))
        .withColumn("n", F.row_number().over(seg))
        .withColumn("part", F.when(F.col("h3"), F.col("n")).otherwise(F.lit(0)))
        .withColumn("tag", F.when(F.col("h3"), "h3").when(block_size > V1_H1_OVER, "h1").when(block_size > V1_H2_OVER, "h2").otherwise("p"))
    )
    blocks = marked.groupBy("page_id", "block_seq", "seg", "part").agg(
        F.min("line_seq").alias("at"), F.first("tag").alias("tag"),
        F.array_sort(F.collect_list(F.struct("line_seq", "txt"))).alias("ls"),
    ).withColumn("text", F.array_join(F.transform("ls", lambda x: x.txt), "")).filter("text <> ''")
    html = F.concat(F.lit("<"), F.col("tag"), F.lit(">"), F.col("text"), F.lit("</"), F.col("tag"), F.lit(">"))
    return blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block_seq", "at", html.alias("h")))).alias("hs")).select(
        "page_id", F.array_join(F.transform("hs", lambda x: x.h), "").alias("html")
    )
