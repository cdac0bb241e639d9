"""Page lists: tree walk, enrichment, selection, neighbours, joining text across page breaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.functions import text as T
from folio.operators.ordering import first_by, with_running
from folio.session import materialise

# Fixed values.
BOOK_MODELS = ["monographunit", "monograph", "periodicalitem"]
COVER_TYPES = ["frontcover", "titlepage", "frontjacket", "cover", "frontendsheet"]
MAX_DEPTH = 4


def book_of_item(objects: DataFrame) -> DataFrame:
    """Book an object belongs to: nearest ancestor of a book model in its first context path."""
    path = F.get("context", F.lit(0))
    hit = F.filter(path, lambda x: F.lower(x["model"]).isin(*BOOK_MODELS) & (x["pid"] != ""))
    nearest = F.when(F.size(hit) > 0, F.element_at(hit, -1)["pid"])
    own = F.when(F.col("model") == "page", F.col("root_pid")).otherwise(F.col("pid"))
    return objects.select("pid", F.coalesce(nearest, own, F.col("pid")).alias("book_pid"))


def collect_pages(objects: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Pages under each root in reading order (depth first), with their index.

    One join per level, never a loop over rows.  The index of a page is the number of pages in
    everything that precedes it at each level of its path, so no window spans a whole book.
    Columns: root_pid, pid, page_index.
    """
    kids = objects.filter("parent_pid IS NOT NULL").select(
        F.col("parent_pid"), F.col("pid").alias("kid"), F.col("ord").alias("kid_ord"),
        (F.col("model").isNull() | (F.col("model") == "page")).alias("is_page"),
    )
    level = roots.select(
        F.col("pid").alias("root_pid"), F.col("pid").alias("node"),
        F.expr("cast(array() as array<bigint>)").alias("path"), F.array("pid").alias("seen"),
    )
    found, inner = [], []
    for depth in range(max_depth + 1):
        below = level.join(kids, level["node"] == kids["parent_pid"]).select(
            "root_pid", "kid", "is_page", F.col("path").alias("parent_path"), F.col("kid_ord").alias("ord"),
            F.concat("path", F.array("kid_ord")).alias("path"), "seen",
        )
        found.append(below.filter("is_page").select("root_pid", "kid", "parent_path", "ord", "path"))
        if depth == max_depth:  # what lies deeper is not walked, so it has not been seen either
            break
        # inner nodes are few next to pages; kept as a table so that deeper levels do not walk them again
        level = materialise(below.filter(~F.col("is_page") & ~F.array_contains("seen", F.col("kid"))).select(
            "root_pid", F.col("kid").alias("node"), "path", F.concat("seen", F.array("kid")).alias("seen")
        ))
        inner.append(level.select("root_pid", "node", "path"))
    pages = reduce(DataFrame.unionByName, found)
    again = _walked_before(reduce(DataFrame.unionByName, inner)) if inner else roots.select(F.col("pid").alias("root_pid"), F.array().cast("array<bigint>").alias("again")).limit(0)
    above = pages.select("root_pid", "kid", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("again"))
    repeated = above.join(again, ["root_pid", "again"], "left_semi").select("root_pid", "path").distinct()
    pages = materialise(pages.join(repeated, ["root_pid", "path"], "left_anti").select("root_pid", "kid", "path"))

    # pages under every node of the tree, counted once per ancestor path
    spots = pages.select("root_pid", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("path"))
    sizes = spots.groupBy("root_pid", "path").agg(F.count("*").alias("n")).select(
        "root_pid", F.slice("path", 1, F.size("path") - 1).alias("parent_path"),
        F.element_at("path", -1).alias("ord"), "n",
    )
    before = with_running(sizes, ["root_pid", "parent_path"], "ord", F.col("n"), "sum", "before", inclusive=False)
    steps = pages.select("root_pid", "kid", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("path")),
        lambda n: F.struct(F.slice("path", 1, n - 1).alias("parent_path"), F.element_at("path", n).alias("ord")),
    )).alias("s")).select("root_pid", "kid", "path", "s.*")
    return (
        steps.join(before.select("root_pid", "parent_path", "ord", "before"), ["root_pid", "parent_path", "ord"])
        .groupBy("root_pid", F.col("kid").alias("pid"), "path")
        .agg(F.sum("before").alias("page_index"))
        .select("root_pid", "pid", "page_index")
    )


def _walked_before(visits: DataFrame) -> DataFrame:
    """(root_pid, again): the paths at which an inner node is met that reading order has walked before.

    ``visits`` has root_pid, node, path.  What lies below such a path is not walked, so it counts for no later place; whether
    a visit counts depends on earlier ones only, so repeating the rule settles them in reading order.
    """
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", 1, n))
    above = visits.where(F.size("path") > 1).select("root_pid", "path", F.explode(prefixes).alias("again"))
    again = None
    while True:
        below = None if again is None else above.join(again, ["root_pid", "again"], "left_semi").select("root_pid", "path").distinct()
        live = visits if below is None else visits.join(below, ["root_pid", "path"], "left_anti")
        first = live.groupBy("root_pid", "node").agg(F.min("path").alias("first_path"))
        found = materialise(live.join(first, ["root_pid", "node"]).where("path > first_path").select("root_pid", F.col("path").alias("again")))
        if found.isEmpty() if again is None else found.exceptAll(again).isEmpty() and again.exceptAll(found).isEmpty():
            return found
        again = found


def enrich_pages(pages: DataFrame, items: DataFrame, mods: DataFrame) -> DataFrame:
    """Number, title and side of a page: from the list, else its own record, else its metadata."""
    value = T.clean_text("value")
    label = F.lower("label")
    pick = lambda *names: F.min_by(F.when(label.isin(*names), value), F.when(label.isin(*names) & (value != ""), F.col("ord")))
    meta = mods.groupBy("page_id").agg(
        pick("pagenumber", "page number", "pageindex", "page index").alias("m_number"),
        pick("název", "title").alias("m_title"),
        pick("pageside").alias("m_side"),
    )
    some = lambda c: F.when(F.trim(c) != "", T.clean_text(c))
    info = items.select(
        "page_id",
        some("title").alias("i_title"),
        F.coalesce(some("number"), F.when(F.coalesce(F.col("model"), F.lit("page")) == "page", some("title"))).alias("i_number"),
        some("side").alias("i_side"),
    )
    return pages.join(info, "page_id", "left").join(meta, "page_id", "left").select(
        "page_id",
        F.coalesce(some("page_number"), "i_number", "m_number").alias("page_number"),
        F.coalesce(some("title"), "i_title", "m_title").alias("title"),
        F.coalesce(some("page_side"), "i_side", "m_side").alias("page_side"),
    )


def page_pairs(pages: DataFrame) -> DataFrame:
    """Neighbouring pages of a book whose indexes differ by one.

    An equality join on (book, index + 1): the keys are as fine as the pages, so a book of any
    size spreads evenly, unlike a window over the book.
    """
    left = pages.select("book_id", F.col("page_index"), F.col("page_id").alias("left_page"))
    right = pages.select("book_id", (F.col("page_index") - 1).alias("page_index"), F.col("page_id").alias("right_page"))
    return left.join(right, ["book_id", "page_index"])


def with_html(snippets: DataFrame) -> DataFrame:
    """Snippets with ``html``: their own, the escaped text where that is empty; plain markup if none have any."""
    if "html" not in snippets.columns:
        return snippets.withColumn("html", F.when(F.col("text") == "", "").otherwise(M.snippet_html(F.col("tag"), F.col("text"))))
    return snippets.withColumn("html", F.when(F.trim("html") != "", F.col("html")).otherwise(T.escape(F.col("text"), quote=True)))


def _edges(snippets: DataFrame) -> DataFrame:
    """Per page: first and last snippet that is no note, with its first tag, the last of all, and how many there are."""
    body = F.col("tag") != "note"
    opens = M.opening_tag(F.col("html")) if "html" in snippets.columns else F.lit(None).cast("string")
    one = F.struct("ord", "tag", "text", opens.alias("opens"))
    return snippets.groupBy("book_id", "page_index").agg(
        F.min_by(F.when(body, one), F.when(body, F.col("ord"))).alias("head"),
        F.max_by(F.when(body, one), F.when(body, F.col("ord"))).alias("tail"),
        F.max("ord").alias("last_ord"),
        F.count(F.when(body, 1)).alias("bodies"),
        F.count("*").alias("n"),
    )


def decide(left_tag: Column, left: Column, right_tag: Column, right: Column, profile: str = "server") -> Column:
    """How two snippets across a page break belong together: split, join or merge (hyphen)."""
    end, start = (M.SENTENCE_END, M.SENTENCE_START) if profile == "server" else (M.SENTENCE_END_CLIENT, M.SENTENCE_START_CLIENT)
    a, b = F.trim(left), F.trim(right)
    return (
        F.when((left_tag != "") & (right_tag != "") & (F.lower(left_tag) != F.lower(right_tag)), "split")
        .when((a == "") | (b == ""), "split")
        .when(a.rlike(end) & b.rlike(start), "split")
        .when(a.rlike(rf"[{T.HYPHENS}]$"), "merge")
        .otherwise("join")
    )


def merge_text(left: Column, right: Column) -> Column:
    a, b = F.trim(left), F.trim(right)
    return (
        F.when(a == "", b)
        .when(b == "", a)
        .when(a.rlike(rf"[{T.HYPHENS}]$"), F.concat(F.rtrim(F.regexp_replace(a, rf"[{T.HYPHENS}]+$", "")), b))
        .when(b.rlike(M.LEADING_PUNCT), F.concat(a, b))
        .otherwise(F.concat(a, F.lit(" "), b))
    )


def join_decide(snippets: DataFrame, profile: str = "server") -> DataFrame:
    """Decision for every pair of neighbouring pages with text on both sides of the break."""
    e = _edges(snippets)
    left = e.select("book_id", "page_index", "tail", F.col("bodies").alias("left_bodies"), "last_ord")
    right = e.select(
        "book_id", (F.col("page_index") - 1).alias("page_index"), "head", F.col("bodies").alias("right_bodies"),
        F.col("n").alias("right_n"),
    )
    return (
        left.join(right, ["book_id", "page_index"])
        .filter("tail IS NOT NULL AND head IS NOT NULL")
        .withColumn("decision", decide(F.col("tail.tag"), F.col("tail.text"), F.col("head.tag"), F.col("head.text"), profile))
    )


def joined_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that are really merged.

    A page whose only snippet was taken by the page before cannot take from the next.  Along a run
    of such pages the merges alternate, so the distance to the start of the run decides.  Only the
    flags take part; the texts join back by page.
    """
    keys = ["book_id", "page_index"]
    wants = pairs.filter(F.col("decision").isin("join", "merge")).select(*keys, (F.col("left_bodies") == 1).alias("single"))
    prev = wants.select("book_id", (F.col("page_index") + 1).alias("page_index"), F.lit(True).alias("prev"))
    flagged = wants.join(prev, keys, "left").withColumn("starts", ~(F.col("single") & F.col("prev").isNotNull()))
    run = with_running(flagged, "book_id", "page_index", F.when(F.col("starts"), F.col("page_index")), "max", "run_start")
    return pairs.join(run.filter((F.col("page_index") - F.col("run_start")) % 2 == 0).select(*keys), keys)


def join_apply(snippets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Snippets after merging across page breaks, with their html.

    The merged text replaces the last snippet of the left page (even a note) and the right page
    loses the one it gave; a page left with nothing keeps one empty paragraph.  A snippet that is not merged keeps its
    html, with its classes and inline tags; a merged one has the first tag of its first half, or of its second.
    """
    merged = joined_pairs(materialise(pairs))
    tag = F.coalesce(F.when(F.col("tail.tag") != "", F.col("tail.tag")), F.when(F.col("head.tag") != "", F.col("head.tag")), F.lit("p"))
    opens = F.coalesce("tail.opens", "head.opens", F.concat(F.lit("<"), tag, F.lit(">")))
    text = merge_text(F.col("tail.text"), F.col("head.text"))
    html = F.concat(F.col("put.html"), T.escape(F.col("put.text"), quote=True), F.lit("</"), F.regexp_extract("put.html", r"^<([a-zA-Z0-9:-]+)", 1), F.lit(">"))
    give = merged.select(
        "book_id", "page_index", F.col("last_ord").alias("ord"),
        F.struct(F.coalesce(F.when(F.col("tail.tag") != "", F.col("tail.tag")), F.col("head.tag")).alias("tag"), text.alias("text"), opens.alias("html")).alias("put"),
    )
    take = merged.select(
        "book_id", (F.col("page_index") + 1).alias("page_index"), F.col("head.ord").alias("ord"),
        (F.col("right_n") == 1).alias("emptied"), F.lit(True).alias("gone"),
    )
    keys = ["book_id", "page_index", "ord"]
    kept = lambda c, made, left: F.when(F.col("put").isNotNull(), made).when(F.col("gone").isNotNull(), left).otherwise(F.col(c)).alias(c)
    return (
        with_html(snippets).join(give, keys, "left").join(take, keys, "left")
        .filter(F.col("gone").isNull() | F.col("emptied"))
        .select(*keys, kept("tag", F.col("put.tag"), "p"), kept("text", F.col("put.text"), ""), kept("html", html, ""))
    )


def select_pages(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Pages each request selects, ordered by ``pos``; an unreadable selector gives an error row.

    ``requests``: request_id, book_id, mode (all, current, custom), expr, current_page.
    A selector is a printed label, else a 1-based position.  The right end of a range prefers a
    label at or after its start.
    """
    index = materialise(pages.select("book_id", "page_id", "page_index", T.page_label("page_number").alias("label")))
    # per label the first and the last page; the next one after a range's start is a running value
    labels = index.filter("label <> ''").groupBy("book_id", "label").agg(
        F.min("page_index").alias("first_at"), F.max("page_index").alias("last_at")
    )
    sizes = index.groupBy("book_id").agg(F.count("*").alias("total"))
    custom = requests.filter("mode = 'custom'").join(sizes, "book_id").select(
        "request_id", "book_id", "total", F.posexplode(F.split("expr", ",")).alias("part", "token")
    ).withColumn("token", F.trim("token")).filter("token <> ''").withColumn(
        "ranged", F.col("token").contains("-")
    ).withColumn("lt", F.trim(F.substring_index("token", "-", 1))).withColumn(
        "rt", F.when(F.col("ranged"), F.trim(F.regexp_replace("token", "^[^-]*-", "")))
    )

    def position(tok: str) -> Column:
        n = F.col(tok).try_cast("bigint") - 1
        return F.when((n >= 0) & (n < F.col("total")), n)

    left_labels = labels.select("book_id", F.col("label").alias("l_label"), F.col("first_at").alias("l_first"))
    right_labels = labels.select("book_id", F.col("label").alias("r_label"), F.col("last_at").alias("r_last"))
    lefts = (
        custom.withColumn("l_label", T.page_label("lt")).withColumn("r_label", T.page_label("rt"))
        .join(left_labels, ["book_id", "l_label"], "left")
        .withColumn("start_at", F.when(F.col("lt") == "", F.lit(0).cast("bigint")).otherwise(F.coalesce("l_first", position("lt"))))
    )
    lefts = materialise(lefts)
    nothing = F.lit(None).cast("bigint")
    asked = lefts.filter("ranged AND start_at IS NOT NULL AND r_label <> ''").select(
        "book_id", F.col("r_label").alias("label"), (F.col("start_at") * 2).alias("at"), nothing.alias("page_index"), "request_id", "part")
    there = index.filter("label <> ''").select(
        "book_id", "label", (F.col("page_index") * 2 + 1).alias("at"), "page_index",
        F.lit(None).cast(asked.schema["request_id"].dataType).alias("request_id"), F.lit(None).cast("int").alias("part"))
    later = with_running(
        asked.unionByName(there), ["book_id", "label"], "at", F.col("page_index"), "min", "r_after", following=True
    ).filter("part IS NOT NULL AND r_after IS NOT NULL").select("request_id", "part", "r_after")
    ends = (
        lefts.join(right_labels, ["book_id", "r_label"], "left").join(later, ["request_id", "part"], "left")
        .withColumn(
            "end_at",
            F.when(~F.col("ranged"), F.col("start_at"))
            .when(F.col("rt") == "", F.col("total") - 1)
            .otherwise(F.coalesce("r_after", "r_last", position("rt"))),
        )
        .withColumn("lo", F.least("start_at", "end_at"))
        .withColumn("hi", F.greatest("start_at", "end_at"))
        .withColumn("bad", F.col("start_at").isNull() | F.col("end_at").isNull())
    )
    errors = ends.groupBy("request_id").agg(F.max("bad").alias("bad")).filter("bad")
    hits = (
        ends.join(errors.select("request_id"), "request_id", "left_anti")
        .select("request_id", "book_id", "part", F.explode(F.sequence("lo", "hi")).alias("page_index"))
        .groupBy("request_id", "book_id", "page_index")
        .agg(F.min("part").alias("part"))
        .join(index.select("book_id", "page_index", "page_id"), ["book_id", "page_index"])
        .select("request_id", F.col("part").cast("bigint").alias("part"), "page_index", "page_id")
    )
    zero = F.lit(0).cast("bigint")
    every = requests.filter("mode = 'all'").join(index, "book_id").select("request_id", zero.alias("part"), "page_index", "page_id")
    here = requests.filter("mode = 'current'").select("request_id", "book_id", "current_page")
    at = here.join(index, (here["book_id"] == index["book_id"]) & (here["current_page"] == index["page_id"]), "left").select(
        "request_id", here["book_id"], F.coalesce("page_index", F.lit(0)).alias("page_index")
    )
    current = at.join(index.select("book_id", "page_index", "page_id"), ["book_id", "page_index"]).select(
        "request_id", zero.alias("part"), "page_index", "page_id"
    )
    failed = errors.select(
        "request_id", F.lit(-1).cast("bigint").alias("part"), F.lit(-1).cast("bigint").alias("page_index"),
        F.lit(None).cast(index.schema["page_id"].dataType).alias("page_id"),
    )
    return hits.unionByName(every).unionByName(current).unionByName(failed)


def cover_page(pages: DataFrame) -> DataFrame:
    """First page of a cover type in list order, else the first page."""
    is_cover = F.lower(F.trim("page_type")).isin(*COVER_TYPES)
    return pages.groupBy("book_id").agg(
        F.min_by("page_id", F.struct(~F.coalesce(is_cover, F.lit(False)), F.col("page_index"))).alias("cover_page")
    )


def locate_page(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Place of an item in its book by id without regard to case; a book itself opens at its first page."""
    by_id = pages.select("book_id", F.lower("page_key").alias("k"), "page_index", "page_id")
    first = pages.groupBy("book_id").agg(F.min_by(F.struct("page_index", "page_id"), "page_index").alias("f"))
    keyed = items.withColumn("k", F.lower("item_key"))
    start = F.col("item_key") == F.col("book_id")
    return keyed.join(by_id, ["book_id", "k"], "left").join(first, "book_id", "left").select(
        "item_key", "book_id",
        F.coalesce("page_index", F.when(start, F.col("f.page_index"))).alias("page_index"),
        F.coalesce("page_id", F.when(start, F.col("f.page_id"))).alias("page_id"),
    )


def pick_version(pages: DataFrame, versions: DataFrame, source: str, fmt: str) -> DataFrame:
    """Html a page is exported from: the cached version of the wanted source, else the computed one."""
    some = lambda c: F.when(F.trim(c) != "", F.col(c))
    cached = {"python": some("python"), "llm": some("llm"), "ocr": some("ocr")}[source]
    if source == "python" and fmt == "epub":
        cached = F.when(cached.contains("illustration"), cached)
    return pages.join(versions, "page_id", "left").select(
        "page_id",
        F.coalesce(cached, F.col("computed")).alias("html"),
        F.when(cached.isNotNull(), F.lit("cached")).when(F.col("computed").isNotNull(), F.lit("computed")).alias("origin"),
    )


def navigation(pages: DataFrame) -> DataFrame:
    """Previous and next page, whether they exist, and the number of pages of the book."""
    here = F.struct("page_index", "page_id")
    back = with_running(pages.select("book_id", "page_id", "page_index"), "book_id", "page_index", here, "max", "p", inclusive=False)
    both = with_running(back, "book_id", "page_index", here, "min", "x", inclusive=False, following=True)
    totals = pages.groupBy("book_id").agg(F.count("*").alias("total"))
    return both.join(totals, "book_id").select(
        "book_id", "page_id", F.col("p.page_id").alias("prev_page"), F.col("x.page_id").alias("next_page"),
        F.col("p").isNotNull().alias("has_prev"), F.col("x").isNotNull().alias("has_next"), "total",
    )


def stitch_context(snippets: DataFrame) -> DataFrame:
    """Snippets around the breaks of a page: end of the one before, both ends of its own, start of the next.

    Paragraphs come first; other tags only where a page has no paragraph; notes never.
    """
    rank = (
        F.when(F.col("tag") == "p", 0).when(F.col("tag") == "div", 1).when(F.col("tag") == "blockquote", 2)
        .when(F.col("tag") == "li", 3).when(F.col("tag").rlike("^h[1-6]$"), 4)
    )
    usable = snippets.withColumn("_rank", rank).filter("_rank IS NOT NULL")
    ends = usable.groupBy("book_id", "page_index").agg(
        F.min_by("text", F.struct("_rank", "ord")).alias("first_text"),
        F.max_by("text", F.struct(F.col("_rank") == 0, F.col("_rank"), F.col("ord"))).alias("last_text"),
    )
    before = ends.select("book_id", (F.col("page_index") + 1).alias("page_index"), F.col("last_text").alias("previous_last"))
    after = ends.select("book_id", (F.col("page_index") - 1).alias("page_index"), F.col("first_text").alias("next_first"))
    keys = ["book_id", "page_index"]
    return ends.join(before, keys, "left").join(after, keys, "left")


def ordered_distinct(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in the given order."""
    return first_by(df, keys, order)
