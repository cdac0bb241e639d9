"""Layout tables derived from the given parquet tables.

The inputs carry prose but no page geometry, so pages, blocks, lines and words
get arithmetic coordinates: 9 words a line, 7 lines a block.  Every derived row
comes from a given row, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.operators.ordering import parts_for, spread, with_rank

PAGE_W, PAGE_H = 1400, 4000

TOKEN_TYPE = (
    "struct<seq:bigint,content:string,subs_content:string,subs_type:string,style:string,"
    "hpos:bigint,vpos:bigint,width:bigint,height:double>"
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page list: one row per page with its position in the book."""
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("page_id")
    )
    ranked = with_rank(docs, "book_id", "page_id", "page_index")
    n = F.col("page_index") + 1
    label = n.cast("string")
    return ranked.select(
        "book_id",
        "page_id",
        "page_index",
        F.when(n % 10 == 0, F.concat(F.lit("["), label, F.lit("]")))
        .when(n % 10 == 1, "xiv")
        .when(n % 10 == 2, F.lit(None).cast("string"))
        .when(n % 10 == 3, "foo")
        .otherwise(label)
        .alias("page_number"),
        F.concat(F.lit("Strana "), label).alias("title"),
        F.when(n == 1, "frontCover")
        .when(n == 2, "titlePage")
        .when(n % 17 == 0, "map")
        .otherwise("normalPage")
        .alias("page_type"),
        F.when(n % 2 == 0, "left").otherwise("right").alias("page_side"),
        F.lit("page").alias("model"),
    )


def _parts(spark: SparkSession, sf: str) -> int:
    """How many parts the pages are spread over: as the tables grow, so that the lines of a part can be sorted in memory."""
    return parts_for(table(spark, sf, "documents"))


def _cut_lines(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """One row per page with its text as lines of 9 words; pages are spread by id before they are unfolded.

    ``only`` limits the pages (column page_id) before anything is done to their text.  A text is cut where every ninth
    word ends, in one pass over it.
    """
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("book_id"), "text")
    if only is not None:
        docs = docs.join(only.select("page_id"), "page_id", "left_semi")
    squeezed = F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))
    some = docs.filter(F.col("text").rlike(r"[^ \t\n\r]"))
    cut = F.split(F.regexp_replace(squeezed, r"\G((?:[^ ]++ ){8}[^ ]++) ", "$1\n"), "\n")
    return spread(some, parts=_parts(spark, sf)).select("page_id", "book_id", cut.alias("lines"))


def _word_lines(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """One row per line with its 9 words and the first word of the next."""
    docs = _cut_lines(spark, sf, only)
    pairs = F.arrays_zip("lines", F.slice("lines", 2, F.size("lines")).alias("after"))
    return docs.select("page_id", "book_id", F.posexplode_outer(pairs).alias("line_no", "line")).select(
        "page_id",
        "book_id",
        F.col("line_no").cast("bigint").alias("line_no"),
        F.expr("cast(floor(line_no / 7) as bigint)").alias("block_no"),
        F.split("line.lines", " ").alias("words"),
        F.substring_index("line.after", " ", 1).alias("next_word"),
    )


def _token(j: int) -> str:
    """Word ``j`` of a line of ``_word_lines``; only the first and the last of nine words may be parts of others."""
    word = f"get(words, {j})"
    content = f"CASE WHEN (page_id + line_no) % 8 = 5 THEN {word} || '-' ELSE {word} END" if j == 8 else word
    subs = f"CASE WHEN (page_id + line_no) % 8 = 3 THEN {word} || next_word END" if j == 8 else "cast(NULL as string)"
    kind = {
        0: "CASE WHEN line_no > 0 AND (page_id + line_no - 1) % 8 = 3 THEN 'HypPart2' END",
        8: "CASE WHEN (page_id + line_no) % 8 = 3 AND next_word IS NOT NULL THEN 'HypPart1' END",
    }.get(j, "cast(NULL as string)")
    return f"""named_struct('seq', line_no * 9 + {j}, 'content', {content}, 'subs_content', {subs}, 'subs_type', {kind},
        'style', style, 'hpos', cast(line_left + {j * 110} as bigint), 'vpos', vpos, 'width', cast(12 * length({word}) as bigint),
        'height', cast(base_h + (page_id + line_no * 9 + {j}) % 2 as double))"""


def text_lines(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """Lines with nested words: the shape of one parsed layout line.

    The words are spelt out place by place: compiled code, where a lambda would be interpreted word by word.
    """
    base = _word_lines(spark, sf, only).selectExpr(
        "*",
        "line_no % 7 AS lib",
        "CASE (page_id * 31 + block_no * 17) % 12 WHEN 0 THEN 66 WHEN 1 THEN 34 WHEN 2 THEN 22 ELSE 30 END AS base_h",
        "150 + CASE WHEN (page_id + line_no) % 7 IN (0, 1) THEN 45 ELSE 0 END AS line_left",
        "200 + line_no * 46 + block_no * 70 + CASE WHEN line_no % 7 >= 4 AND (page_id + block_no) % 5 = 0 "
        "THEN 65 ELSE 0 END AS vpos",
        "CASE WHEN (page_id + block_no) % 9 = 0 THEN 'bold' ELSE '' END AS style",
    )
    token = f"slice(array({', '.join(map(_token, range(9)))}), 1, size(words))"
    odd = "(page_id + line_no * 9) % 2, CASE WHEN size(words) > 1 THEN (page_id + line_no * 9 + 1) % 2 END"
    lines = base.withColumn("tokens", F.expr(token).cast(f"array<{TOKEN_TYPE}>")).selectExpr(
        "*",
        "cast(array_max(transform(words, (x, j) -> j * 110 + 12 * length(x))) as bigint) AS w",
        f"base_h + greatest({odd}) AS height",
        "(page_id + block_no) % 11 = 4 AS c",
    )
    return lines.selectExpr(
        "page_id",
        "book_id",
        "block_no AS block_seq",
        "line_no AS line_seq",
        "'blk_' || block_no AS block_id",
        "cast(NULL as string) AS style_refs",
        "'PAR_0 FONT_' || CASE base_h WHEN 66 THEN 24 WHEN 34 THEN 14 WHEN 22 THEN 8 ELSE 11 END AS block_style_refs",
        "CASE WHEN c THEN 700 - cast(floor((w - 60 * lib) / 2) as bigint) ELSE cast(line_left as bigint) END AS hpos",
        "vpos",
        "CASE WHEN c THEN w - 60 * lib ELSE w END AS width",
        "height",
        "vpos + height AS bottom",
        "cast(CASE base_h WHEN 66 THEN 24 WHEN 34 THEN 14 WHEN 22 THEN 8 ELSE 11 END as double) AS font_size",
        "tokens",
    )


def number_lines(page_list: DataFrame) -> DataFrame:
    """Short page-number lines, in the shape of ``text_lines``."""
    k0 = """CASE (page_index + 1) % 10 WHEN 4 THEN NULL WHEN 6 THEN cast(page_index + 900 as string)
            WHEN 7 THEN 'x~y' ELSE page_number END"""
    k1 = "CASE WHEN (page_index + 1) % 10 = 8 THEN '12 *' WHEN (page_index + 1) % 10 = 9 THEN '3 * ab' END"
    return (
        page_list
        .selectExpr("page_id", "book_id", f"posexplode(array({k0}, {k1})) AS (k, txt)")
        .filter("txt IS NOT NULL")
        .selectExpr("page_id", "book_id", "cast(k as bigint) AS k", "txt")
        .selectExpr(
            "page_id",
            "book_id",
            "1000000 + k AS block_seq",
            "1000000 + k AS line_seq",
            "'blk_' || (1000000 + k) AS block_id",
            "cast(NULL as string) AS style_refs",
            "'PAR_0 FONT_11' AS block_style_refs",
            "cast(700 as bigint) AS hpos",
            "60 + 30 * k AS vpos",
            "cast(12 * length(txt) as bigint) AS width",
            "cast(30 as bigint) AS height",
            "90 + 30 * k AS bottom",
            "cast(11 as double) AS font_size",
            f"""cast(array(named_struct('seq', cast(0 as bigint), 'content', txt, 'subs_content', cast(NULL as string),
                'subs_type', cast(NULL as string), 'style', '', 'hpos', cast(700 as bigint), 'vpos', 60 + 30 * k,
                'width', cast(12 * length(txt) as bigint), 'height', cast(30 as double)))
                AS array<{TOKEN_TYPE}>) AS tokens""",
        )
    )


def lines(
    spark: SparkSession, sf: str, page_list: DataFrame | None = None, only: DataFrame | None = None
) -> DataFrame:
    """All lines of all pages (or of those in ``only``): text lines and page-number lines."""
    page_list = pages(spark, sf) if page_list is None else page_list
    if only is not None:
        page_list = page_list.join(only.select("page_id"), "page_id", "left_semi")
    return text_lines(spark, sf, only).unionByName(spread(number_lines(page_list), parts=_parts(spark, sf)))


def tokens(lines_df: DataFrame) -> DataFrame:
    """Flat word rows of nested line rows."""
    return lines_df.select(
        "page_id", "book_id", "block_seq", "line_seq", F.explode_outer("tokens").alias("t")
    ).filter("t IS NOT NULL").select(
        "page_id",
        "book_id",
        "block_seq",
        "line_seq",
        F.col("t.seq").alias("token_seq"),
        *[f"t.{c}" for c in ("content", "subs_content", "subs_type", "style", "hpos", "vpos", "width", "height")],
    )


def styles(spark: SparkSession, sf: str) -> DataFrame:
    """Style table: every page declares the same four sizes under its own id."""
    return table(spark, sf, "documents").selectExpr(
        "doc_id AS page_id",
        "explode(array(24, 14, 11, 8)) AS s",
    ).selectExpr(
        "page_id", "'FONT_' || s AS style_id", "cast(s as double) AS font_size",
        "CASE WHEN s > 11 THEN 'Fraktur' ELSE 'Times' END AS font_family",
        "CASE WHEN s = 14 THEN 'italics' END AS font_style",
        "CASE WHEN s = 24 THEN 'bold' END AS font_weight",
    )


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Block documents: numbered, typed text blocks of a page."""
    return (
        _cut_lines(spark, sf)
        .select("page_id", "book_id", F.posexplode_outer("lines").alias("line_no", "line"))
        .selectExpr(
            "page_id", "book_id", "cast(floor(line_no / 7) as bigint) AS block_seq", "cast(line_no as bigint) AS line_seq",
            "CASE WHEN (page_id + line_no) % 8 = 5 AND length(line) - length(replace(line, ' ', '')) = 8 THEN line || '-' ELSE line END AS txt",
        )
        .groupBy("page_id", "book_id", "block_seq")
        .agg(F.array_sort(F.collect_list(F.struct("line_seq", "txt"))).alias("ls"))
        .selectExpr(
            "page_id",
            "book_id",
            "'b' || (block_seq + 1) AS block_id",
            "block_seq AS ord",
            """CASE (page_id * 31 + block_seq * 17) % 12 WHEN 0 THEN 'h1' WHEN 1 THEN 'h2'
               WHEN 2 THEN 'small' WHEN 3 THEN 'note' ELSE 'p' END AS type""",
            "array_join(ls.txt, ' ') AS text",
        )
    )


def changes(blocks_df: DataFrame) -> DataFrame:
    """Corrections of block documents: replacements, deletions, new ids, note targets."""
    return blocks_df.filter(
        "(page_id + ord) % 5 = 0 OR (page_id + ord) % 11 = 0 OR (page_id + ord) % 23 = 0"
    ).selectExpr(
        "page_id",
        "ord",
        "CASE WHEN (page_id + ord) % 23 = 0 THEN 'b' || (9000 + ord) ELSE block_id END AS block_id",
        "CASE WHEN (page_id + ord) % 11 = 0 THEN ' ' ELSE replace(text, 'th', 'ht') END AS text",
    )


def illustrations(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").selectExpr("doc_id AS page_id")
    return (
        docs.selectExpr("page_id", "explode(sequence(0, CASE WHEN page_id % 8 = 0 THEN 3 ELSE 2 END)) AS k")
        .selectExpr(
            "page_id",
            "cast(k as bigint) AS seq",
            "cast(CASE WHEN k < 3 THEN 100 + (page_id * 37 + k * 211) % 900 ELSE 110 + (page_id * 37) % 900 END as double) AS x",
            "cast(CASE WHEN k < 3 THEN 200 + (page_id * 53 + k * 97) % 1500 ELSE 210 + (page_id * 53) % 1500 END as double) AS y",
            "cast(CASE WHEN k < 3 THEN 200 + k * 150 ELSE 100 END as double) AS w",
            "cast(CASE WHEN k < 3 THEN 200 + k * 130 ELSE 100 END as double) AS h",
        )
    )


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """Library tree: region > nation > customer > order."""
    region = table(spark, sf, "region").selectExpr(
        "'r' || r_regionkey AS pid", "cast(NULL as string) AS parent_pid",
        "cast(r_regionkey as bigint) AS ord", "'monograph' AS model", "r_name AS title",
    )
    nation = table(spark, sf, "nation").selectExpr(
        "'n' || n_nationkey", "'r' || n_regionkey", "cast(n_nationkey as bigint)", "'monographunit'", "n_name"
    )
    customer = table(spark, sf, "customer").selectExpr(
        "'c' || c_custkey", "'n' || c_nationkey", "c_custkey", "'internalpart'", "c_name"
    )
    orders = table(spark, sf, "orders").selectExpr(
        "'o' || o_orderkey", "'c' || o_custkey", "o_orderkey",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'page' END", "cast(o_orderkey as string)",
    )
    return region.union(nation).union(customer).union(orders)


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    """Progress events: the n-th event of a user is n units of work done."""
    ev = table(spark, sf, "events").selectExpr(
        "user_id AS job_id", "event_id", "ts", "event_type AS message"
    )
    ranked = with_rank(ev, "job_id", "event_id", "rank")
    totals = ev.groupBy("job_id").agg(F.count("*").alias("n"))
    return ranked.join(totals, "job_id").selectExpr(
        "job_id", "ts", "rank + 1 AS processed", "n + job_id % 3 AS total", "message"
    )


def page_xml(spark: SparkSession, sf: str) -> DataFrame:
    """The text lines again as layout XML, one document per page, in all the shapes such files take.

    Blocks stand in the print space, in margins, up to six groups deep or on a second page; ids are missing or shared; a
    comment holds a block; coordinates have decimals; pictures stand anywhere.
    """
    from folio.functions.text import escape

    esc = escape
    attr = lambda name, c: F.concat(F.lit(f' {name}="'), F.coalesce(c.cast("string"), F.lit("")), F.lit('"'))
    place = lambda name, c: F.when(F.col("page_id") % 4 == 1, attr(name, F.concat(c.cast("string"), F.lit(".75")))).otherwise(attr(name, c))
    optional = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f' {name}="'), esc(c), F.lit('"'))).otherwise(F.lit(""))
    word = lambda t: F.concat(
        F.lit("<String"), optional("CONTENT", t["content"]), optional("SUBS_CONTENT", t["subs_content"]),
        optional("SUBS_TYPE", t["subs_type"]), optional("STYLE", t["style"]), place("HPOS", t["hpos"]), place("VPOS", t["vpos"]),
        place("WIDTH", t["width"]), attr("HEIGHT", t["height"]), F.lit("/>"),
    )
    line = F.concat(
        F.lit("<TextLine"), place("HPOS", F.col("hpos")), place("VPOS", F.col("vpos")), place("WIDTH", F.col("width")),
        place("HEIGHT", F.col("height")), F.lit(">"), F.array_join(F.transform("tokens", word), "<SP/>"), F.lit("</TextLine>"),
    )
    blocks = (
        text_lines(spark, sf).withColumn("line", line)
        .groupBy("page_id", "block_seq")
        .agg(F.array_sort(F.collect_list(F.struct("line_seq", "line"))).alias("ls"), F.first("block_style_refs").alias("refs"))
    )
    seq, page = F.col("block_seq"), F.col("page_id")
    ident = F.when((page % 3 == 1) & (seq % 2 == 1), "").when(page % 11 == 0, ' ID="same"').otherwise(F.concat(F.lit(' ID="blk_'), seq.cast("string"), F.lit('"')))
    one = F.concat(
        F.lit("<TextBlock"), ident, F.lit(' STYLEREFS="'), F.col("refs"), F.lit('">'), F.array_join(F.transform("ls", lambda x: x.line), ""), F.lit("</TextBlock>"))
    deep = F.when(seq % 3 == 2, F.when(page % 2 == 0, 6).otherwise(1)).otherwise(0)
    nested = F.concat(F.repeat(F.lit("<ComposedBlock>"), deep), one, F.repeat(F.lit("</ComposedBlock>"), deep))
    commented = F.when(seq % 5 == 3, F.concat(F.lit("<!-- <TextBlock ID=\'blk_0\'><TextLine/></TextBlock> -->"), nested)).otherwise(nested)
    space = f'<PrintSpace WIDTH="{PAGE_W - 200}" HEIGHT="{PAGE_H - 200}">'
    margin = F.when(page % 7 == 0, F.concat(F.lit("<TopMargin>"), F.array_join(F.transform(F.filter("bs", lambda x: x.block_seq < 1), lambda x: x.b), ""), F.lit("</TopMargin>"))).otherwise("")
    kept = F.filter("bs", lambda x: (page % 7 != 0) | (x.block_seq > 0))
    second = lambda x: (page % 6 == 0) & (x.block_seq > 1)
    inside = lambda later: F.array_join(F.transform(F.filter(kept, lambda x: second(x) if later else ~second(x)), lambda x: x.b), "")
    pages_ = blocks.withColumn("b", commented).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block_seq", "b"))).alias("bs"))
    fonts = "".join(
        f'<TextStyle ID="FONT_{s}" FONTSIZE="{s}" FONTFAMILY="{"Fraktur" if s > 11 else "Times"}"'
        + (' FONTSTYLE="italics"' if s == 14 else "") + (' FONTWEIGHT="bold"' if s == 24 else "") + "/>"
        for s in (24, 14, 11, 8)
    )
    pics = illustrations(spark, sf).groupBy("page_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "x", "y", "w", "h"))),
        lambda i: F.concat(F.lit("<Illustration"), attr("HPOS", i["x"]), attr("VPOS", i["y"]), attr("WIDTH", i["w"]), attr("HEIGHT", i["h"]), F.lit("/>")),
    ), "").alias("pics"))
    pics_at = lambda where: F.when(page % 3 == where, F.coalesce("pics", F.lit(""))).otherwise("")
    version = F.when(page % 2 == 0, "2").otherwise("3")
    return pages_.join(pics, "page_id", "left").select(
        "page_id",
        F.concat(
            F.lit('<?xml version="1.0"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v'), version, F.lit(f'#"><Styles>{fonts}</Styles><Layout>'),
            F.lit(f'<Page WIDTH="{PAGE_W}" HEIGHT="{PAGE_H}">'), margin, F.lit(space), inside(False), pics_at(0), F.lit("</PrintSpace>"),
            F.lit("<BottomMargin>"), pics_at(1), F.lit("</BottomMargin></Page>"),
            F.when(page % 6 == 0, F.concat(F.lit('<Page WIDTH="1" HEIGHT="1"><PrintSpace>'), inside(True), F.lit("</PrintSpace></Page>"))).otherwise(""),
            F.lit("<Page><PrintSpace><ComposedBlock>"), pics_at(2), F.lit("</ComposedBlock></PrintSpace></Page></Layout></alto>"),
        ).alias("xml"),
    )


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Main part of the given web pages."""
    return spread(
        table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1).alias("html"))
    ).filter("html <> ''")


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of the pages as export snippets, placed in their books; every fourth has its first word in an inline tag."""
    html = M.block_html(F.col("type"), F.col("text"), F.col("block_id"), "server")
    inline = F.regexp_replace(html, r"^(<[^>]+>)([^<\s]+) ", "$1<i class='w'>$2</i> ")
    return blocks(spark, sf).select("page_id", "ord", F.col("type").alias("tag"), "text", F.when(F.col("ord") % 4 == 1, inline).otherwise(html).alias("html")).join(
        pages(spark, sf).select("page_id", "book_id", "page_index"), "page_id"
    )
