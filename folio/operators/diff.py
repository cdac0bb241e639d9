"""Differences between two versions of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.functions import text as T
from folio.functions.text import let
from folio.operators.sequence import gaps, matching_runs, ordered_changes

# Class names of marked blocks.
BLOCK_CLASS = {
    "added": "diff-block diff-block--added",
    "removed": "diff-block diff-block--removed",
    "changed": "diff-block diff-block--changed",
}
WORD_TOKENS = r"<[^>]+?>|\s+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_<]+|<"
CHAR_TOKENS = r"(?s)<[^>]+?>|."


def doc_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Blocks of two documents by id: equal, changed, removed or added.

    Blocks without an id never match.  Columns ``left_html`` / ``right_html`` hold the markup.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "page_id", "block_id",
            F.when(F.coalesce("block_id", F.lit("")) == "", F.concat(F.lit(f"{name}-"), F.col("ord"))).otherwise(
                F.concat(F.lit("id-"), F.col("block_id"))).alias("_key"),
            F.col("ord").alias(f"{name}_ord"),
            M.block_html(F.col("type"), F.col("text"), F.col("block_id"), "diff").alias(f"{name}_html"),
        ).filter(f"{name}_html IS NOT NULL")

    l, r = side(left, "left"), side(right, "right").withColumnRenamed("block_id", "_rid")  # noqa: E741
    change = (
        F.when(F.col("right_html").isNull(), "removed")
        .when(F.col("left_html").isNull(), "added")
        .when(F.col("left_html") == F.col("right_html"), "equal")
        .otherwise("changed")
    )
    return l.join(r, ["page_id", "_key"], "full_outer").select(
        "page_id", F.coalesce("block_id", "_rid").alias("block_id"), "left_ord", "right_ord", "left_html", "right_html",
        change.alias("change"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(c)
    return diff.groupBy("page_id").agg(
        n("equal"), n("changed"), n("removed"), n("added"), F.max(F.col("change") != "equal").alias("has_changes")
    )


def block_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Added, removed and unchanged (id, markup) rows of a page, in one pass over both sides."""
    def rows(df: DataFrame, flag: int) -> DataFrame:
        return df.select(
            "page_id", "block_id",
            M.block_html(F.col("type"), F.col("text"), F.col("block_id"), "diff").alias("html"), F.lit(flag).alias("side"),
        ).filter("html IS NOT NULL")

    both = rows(left, 1).unionByName(rows(right, 2)).groupBy("page_id", "block_id", "html").agg(
        F.bit_or("side").alias("sides")
    )
    return both.select(
        "page_id", "block_id", "html",
        F.when(F.col("sides") == 3, "unchanged").when(F.col("sides") == 2, "added").otherwise("removed").alias("change"),
    )


def diff_normalise(c: Column | str) -> Column:
    """Markup without the whitespace between tags."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r">\s+<", "><")


def tokens_of(html: Column | str, mode: str = "word") -> Column:
    """Tokens of a block as an array: tags whole, text by word or by character."""
    return F.regexp_extract_all(diff_normalise(html), F.lit(CHAR_TOKENS if mode == "char" else WORD_TOKENS), F.lit(0))


def _kind(value: Column) -> Column:
    return F.when(value.rlike(r"^<[^>]+>$"), "tag").otherwise("text")


def diff_tokens(blocks: DataFrame, html: str, keys: list[str], mode: str = "word") -> DataFrame:
    """Tokens of a block, one row each."""
    return blocks.select(*keys, F.posexplode(tokens_of(html, mode)).alias("tok_seq", "value")).select(
        *keys,
        F.col("tok_seq").cast("bigint").alias("tok_seq"),
        _kind(F.col("value")).alias("kind"),
        "value",
        F.col("value").rlike(r"^\s+$").alias("is_ws"),
    )


def _compared(pairs: DataFrame, left: str, right: str, keys: list[str], mode: str) -> DataFrame:
    """``keys`` and ``_ops``, the tokens of both sides in order (left, right, change, value); a side that is null has no tokens."""
    both = pairs.select(*keys, *[F.coalesce(tokens_of(c, mode), F.array().cast("array<string>")).alias(n) for c, n in ((left, "_l"), (right, "_r"))])
    value = lambda op: F.coalesce(F.get("_l", op["left"]), F.get("_r", op["right"]))
    told = F.transform(ordered_changes(F.col("_l"), F.col("_r")), lambda op: F.struct(op["left"].alias("left"), op["right"].alias("right"), op["change"].alias("change"), value(op).alias("value")))
    return both.select(*keys, told.alias("_ops"))


def token_diff(pairs: DataFrame, left: str, right: str, keys: list[str], mode: str = "word") -> DataFrame:
    """Tokens of both sides of a block in order: equal, removed, added.

    The longest run of equal tokens is matched first and then what lies on either side of it, so a moved word is removed at
    one place and added at the other.  Blocks are compared within their row.
    """
    rows = _compared(pairs, left, right, keys, mode).select(*keys, F.posexplode_outer("_ops").alias("ord", "_op")).where("_op IS NOT NULL")  # an outer one is not computed twice
    value = F.col("_op.value")
    return rows.select(
        *keys, F.col("ord").cast("bigint").alias("ord"), value.alias("value"), _kind(value).alias("kind"), value.rlike(r"^\s+$").alias("is_ws"),
        F.col("_op.left").cast("bigint").alias("left_seq"), F.col("_op.right").cast("bigint").alias("right_seq"), F.col("_op.change").alias("change"))


def annotate(html: Column, change: Column) -> Column:
    """Markup with the class of its change on the first element; text without a tag stays as it is."""
    cls = F.create_map(*[F.lit(x) for pair in BLOCK_CLASS.items() for x in pair])
    name = F.try_element_at(cls, change)
    head = F.regexp_extract(html, r"(?is)^(\s*(?:<br[^>]*>)*)", 1)
    rest = F.substring(html, F.length(head) + 1, F.length(html))
    tag = F.regexp_extract(rest, r"^<[a-zA-Z0-9:-]+[^>]*>", 0)
    inner = F.left(tag, F.length(tag) - 1)
    with_class = F.concat(
        F.regexp_extract(tag, '(?s)^(.*?class=")', 1), F.regexp_extract(tag, '(?s)class="([^"]*)"', 1), F.lit(" "), name, F.lit('"'),
        F.regexp_extract(tag, '(?s)class="[^"]*"(.*)$', 1),
    )
    without = F.concat(inner, F.when(inner.endswith(" "), "").otherwise(" "), F.lit('class="'), name, F.lit('">'))
    marked = F.concat(
        head, F.when(tag.contains('class="'), with_class).otherwise(without), F.substring(rest, F.length(tag) + 1, F.length(rest))
    )
    return F.when(name.isNull() | (tag == ""), html).otherwise(marked)


def diff_markup(pairs: DataFrame, left: str, right: str, keys: list[str], mode: str = "word") -> DataFrame:
    """Both sides of a block with removed / added tokens wrapped; tags and whitespace never are."""
    def side(place: str, label: str) -> Column:
        plain = lambda op: (op["change"] == "equal") | op["value"].rlike(r"^<[^>]+>$|^\s+$")
        piece = lambda op: F.when(plain(op), op["value"]).otherwise(F.concat(F.lit(f'<span class="diff-{label}">'), op["value"], F.lit("</span>")))
        return F.array_join(F.transform(F.filter("_ops", lambda op: op[place].isNotNull()), piece), "")

    changed = F.when(F.exists("_ops", lambda op: op["change"] != "equal"), "changed")
    told = _compared(pairs, left, right, keys, mode).select(
        *keys, side("left", "removed").alias("_lm"), side("right", "added").alias("_rm"), changed.alias("_c"))
    return told.select(*keys, annotate(F.col("_lm"), F.col("_c")).alias("left_markup"), annotate(F.col("_rm"), F.col("_c")).alias("right_markup"))


def _shingles(c: Column) -> Column:
    """Distinct word 3-shingles of a text; shorter texts give themselves."""
    w = F.split(c, " ")
    return F.array_distinct(
        F.when(F.size(w) < 3, F.array(c)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " "))
        )
    )


def _likeness(x: Column, y: Column) -> Column:
    """Share of common shingles; zero where a side is missing."""
    return let(F.size(F.array_intersect(x, y)), lambda c: F.coalesce(F.when(x.isNotNull() & y.isNotNull(), c / (F.size(x) + F.size(y) - c)), F.lit(0.0)))


def align_blocks(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """Pair the blocks of two versions of a page without ids, in order.

    The longest run of equal blocks is matched first, then what lies on either side of it; nothing is paired across such a
    match, so a moved block is removed at one place and added at the other.  Between matches both sides are walked
    together: noise comes out alone; of one or two blocks a side (two and two only where one and one will not do) the most alike
    are paired, if they share ``least`` of their word shingles; otherwise the block goes alone whose chances with the next two of the other side are
    worse, in a draw the shorter one, or the left.  ``left`` / ``right``: page_id, ord, html.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        blocks = df.where("html IS NOT NULL").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "html"))).alias("_b"))
        return blocks.select("page_id", F.col("_b.ord").alias(f"{name}_ord"), F.col("_b.html").alias(f"{name}_html"))

    def described(pages: DataFrame, name: str, place: str) -> DataFrame:
        """Text, noise and shingles of the blocks that match none; shingles also of each with the next one."""
        free = lambda i: ~F.exists("_runs", lambda r: (i >= r[place]) & (i < r[place] + r["n"]))
        html, txt = F.col(f"{name}_html"), F.col("_txt")
        hashes = lambda t: F.transform(_shingles(t), lambda s: F.xxhash64(s))
        following = lambda i: F.get(txt, i + 1)
        two = lambda t, i: F.when(t.isNotNull() & following(i).isNotNull(), hashes(F.trim(F.concat(t, F.lit(" "), following(i)))))
        return pages.withColumn("_txt", F.transform(html, lambda h, i: F.when(free(i), T.block_text(h)))).withColumns({
            f"{name}_noise": F.transform(txt, lambda t: F.when(t.isNotNull(), T.is_noise(t))), f"{name}_len": F.transform(txt, F.length),
            f"{name}_one": F.transform(txt, lambda t: F.when(t.isNotNull(), hashes(t))), f"{name}_two": F.transform(txt, two)}).drop("_txt")

    pages = side(left, "left").join(side(right, "right"), "page_id", "full_outer")
    kinds = {"ord": "bigint", "html": "string"}
    pages = pages.select("page_id", *[F.coalesce(f"{n}_{c}", F.array().cast(f"array<{t}>")).alias(f"{n}_{c}") for n in ("left", "right") for c, t in kinds.items()])
    pages = described(described(pages.withColumn("_runs", matching_runs(F.col("left_html"), F.col("right_html"))), "left", "i"), "right", "j")
    at = lambda name, i: F.get(F.col(name), i)
    none = F.lit(None).cast("int")
    row = lambda i, ln, j, rn, s, change: F.struct(*[c.cast(t).alias(n) for c, n, t in (
        (i, "i", "int"), (ln, "ln", "int"), (j, "j", "int"), (rn, "rn", "int"), (s, "s", "double"), (change, "change", "string"))])
    one, zero = F.lit(1), F.lit(0)

    def walked(gap: Column) -> Column:
        """Rows of what lies between two matches."""
        lone_left = lambda i: row(i, one, none, zero, F.lit(0.0), F.when(at("left_noise", i), "noise").otherwise("removed"))
        lone_right = lambda j: row(none, zero, j, one, F.lit(0.0), F.when(at("right_noise", j), "noise").otherwise("added"))

        def step(s: Column, _: Column) -> Column:
            i, j = s["i"], s["j"]
            put = lambda r, di, dj: F.struct((i + di).cast("int").alias("i"), (j + dj).cast("int").alias("j"), F.concat(s["out"], F.array(r)).alias("out"))
            drop_left, drop_right = put(lone_left(i), one, zero), put(lone_right(j), zero, one)
            alike = lambda a, b: _likeness(at(f"left_{a}", i), at(f"right_{b}", j))
            left_two, right_two = i + 1 < gap["ahi"], j + 1 < gap["bhi"]
            ways = F.struct(
                alike("one", "one").alias("s11"), F.when(right_two, alike("one", "two")).otherwise(0.0).alias("s12"),
                F.when(left_two, alike("two", "one")).otherwise(0.0).alias("s21"), F.when(left_two & right_two, alike("two", "two")).otherwise(0.0).alias("s22"))

            def chosen(w: Column) -> Column:
                single = F.greatest(w["s11"], w["s12"], w["s21"])
                best = F.when(w["s11"] >= least, single).otherwise(F.greatest(single, w["s22"]))
                pick = lambda ln, rn, s: put(row(i, F.lit(ln), j, F.lit(rn), s, F.lit("changed")), F.lit(ln), F.lit(rn))
                paired = F.when(w["s11"] == best, pick(1, 1, best)).when(w["s12"] == best, pick(1, 2, best)).when(w["s21"] == best, pick(2, 1, best)).otherwise(pick(2, 2, best))
                chance_left, chance_right = F.greatest(w["s11"], w["s12"]), F.greatest(w["s11"], w["s21"])
                shorter = at("left_len", i) <= at("right_len", j)
                return F.when(best >= least, paired).when((chance_left < chance_right) | ((chance_left == chance_right) & shorter), drop_left).otherwise(drop_right)

            return (F.when((i >= gap["ahi"]) & (j >= gap["bhi"]), s).when(i >= gap["ahi"], drop_right).when(j >= gap["bhi"], drop_left)
                    .when(at("left_noise", i), drop_left).when(at("right_noise", j), drop_right).otherwise(let(ways, chosen)))

        steps = gap["ahi"] - gap["alo"] + gap["bhi"] - gap["blo"]
        start = F.struct(gap["alo"].alias("i"), gap["blo"].alias("j"), F.array().cast("array<struct<i:int,ln:int,j:int,rn:int,s:double,change:string>>").alias("out"))
        through = F.aggregate(F.when(steps > 0, F.sequence(one, steps)).otherwise(F.array().cast("array<int>")), start, step)["out"]
        equal = F.transform(F.when(gap["n"] > 0, F.sequence(zero, gap["n"] - 1)).otherwise(F.array().cast("array<int>")),
                            lambda k: row(gap["ahi"] + k, one, gap["bhi"] + k, one, F.lit(1.0), F.lit("equal")))
        return F.concat(through, equal)

    told = pages.select("page_id", "left_ord", "right_ord", F.explode_outer(F.flatten(F.transform(gaps(F.col("_runs"), F.size("left_html"), F.size("right_html")), walked))).alias("_r")).where("_r IS NOT NULL")
    return told.select(
        "page_id", F.get("left_ord", F.col("_r.i")).alias("left_ord"), F.get("right_ord", F.col("_r.j")).alias("right_ord"),
        F.col("_r.ln").alias("left_n"), F.col("_r.rn").alias("right_n"), F.col("_r.s").alias("similarity"), F.col("_r.change").alias("change"))
