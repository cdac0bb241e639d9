"""Page segmentation: input text blocks -> thresholds -> boundaries -> output blocks.

Input is one row per text line with its words nested (``folio.fixtures.TOKEN_TYPE``
or what ``folio.sources.page_xml`` produces).  Every window is keyed by page, so
lines spread by ``page_id`` once are never shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T

# The rules' constants.
GAP_FACTOR = 2.5            # line gap against the usual gap
HEIGHT_FACTOR = 0.85        # line gap against the usual line height
HEIGHT_MAX_FACTOR = 3       # upper limit of the vertical threshold in line heights
WIDTH_FACTOR = 0.03         # shift against the usual line width
SHIFT_FACTOR = 0.85         # shift against the usual small shift
SHIFT_MIN = 12              # lowest horizontal threshold
NEGATIVE_FACTOR = 0.95      # negative indent against the horizontal threshold
FALLBACK = 40               # threshold where nothing can be measured
CENTER_MARGIN = 0.02        # allowed deviation of line centres
CENTER_WIDTH_SPREAD = 0.1   # line widths must differ by more than this share
FONT_RATIO = 1.2            # font change that splits
CENTER_HEIGHT_RATIO = 1.25  # word height change that splits centred text
SCAN_TOKENS = 3             # words looked at for the effective left edge

BLOCK = ["page_id", "block_seq"]


def _rows():
    """Lines of an input block in order."""
    return Window.partitionBy(*BLOCK).orderBy("line_seq")


def _all():
    """All lines of an input block."""
    return Window.partitionBy(*BLOCK)


def _whole(window):
    """The same window over all of its rows."""
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def line_font(lines: DataFrame, styles: DataFrame) -> DataFrame:
    """Font size of each line: second style reference of the line, else of its block; 0 if unknown."""
    refs = F.split(F.trim(F.coalesce(F.when(F.col("style_refs") != "", F.col("style_refs")), F.col("block_style_refs"))), r"\s+")
    keyed = lines.drop("font_size").withColumn("style_id", F.get(refs, F.lit(1)))
    sizes = styles.select("page_id", "style_id", "font_size")
    return keyed.join(sizes, ["page_id", "style_id"], "left").withColumn(
        "font_size", F.coalesce("font_size", F.lit(0.0))
    )


def read_words(lines: DataFrame) -> DataFrame:
    """Add what the rules read off a line's words: text, measured words and their mean height, left edge, boldness.

    Each word is resolved and measured once here; later rules only look at the results.  What holds for a whole line is read
    off the line, so that most words need no look at their characters.
    """
    value = lambda t: T.hyp_resolve(t["content"], t["subs_content"], t["subs_type"])
    # the text whose place counts for the left edge: a second half still stands on its line
    seen = lambda t: F.trim(F.when(
        t["subs_type"] == "HypPart2",
        F.coalesce(F.when(t["subs_content"] != "", t["subs_content"]), t["content"], F.lit("")),
    ).otherwise(value(t)))
    first = F.transform(F.slice("tokens", 1, SCAN_TOKENS), lambda t: F.struct(seen(t).alias("seen"), t["hpos"].alias("hpos")))
    edge = F.filter(
        first,
        lambda t: (t["seen"] != "")
        & (T.has_alnum(t["seen"]) | ~((F.length(t["seen"]) == 1) & F.lit(T.NOISE_LEADING).contains(t["seen"]))),
    )
    one = F.get("tokens", F.lit(0))
    edge_left = F.when(T.has_alnum(seen(one)), one["hpos"]).otherwise(F.get(edge, F.lit(0))["hpos"])
    resolved = F.when(F.array_max("tokens.subs_type").isNull(), F.col("tokens.content")).otherwise(F.transform("tokens", value))
    unspaced = F.length(F.array_join("_toks", "")) == F.col("chars")
    measured = F.filter(
        F.zip_with("_toks", "tokens.height", lambda tok, height: F.struct(
            tok.alias("tok"), F.when(F.col("_unspaced"), F.length(tok)).otherwise(T.nonspace_len(tok)).alias("len"), height.alias("height"),
            # begins with a plain letter: a comparison instead of a pattern
            F.when((tok >= "a") & (tok < "{"), F.lit(True)).otherwise(T.has_alnum(tok)).alias("alnum"),
        )),
        lambda w: (w["tok"] != "") & w["height"].isNotNull(),
    )
    # here, so that rules that need no word itself send none through their windows
    mean_h = F.expr("aggregate(_heights, cast(0.0 as double), (a, h) -> a + h) / nullif(size(_heights), 0)")
    return (
        lines.withColumn("_toks", resolved)
        .withColumn("text", F.trim(F.array_join(F.array_remove("_toks", ""), " ")))
        .withColumn("chars", T.nonspace_len(F.array_join("_toks", "")))
        .withColumn("_unspaced", unspaced)
        .withColumn("words", measured)
        .withColumn("_heights", F.filter("words.height", lambda h: h > 0))
        .withColumn("mean_h", mean_h)
        .withColumn("eff_left", F.coalesce(edge_left, F.col("hpos")))
        .withColumn("bold", F.forall("tokens.style", lambda x: F.coalesce(x.contains("bold"), F.lit(False))))
        .drop("_toks", "_unspaced", "_heights")
    )


def median_of_low_half(values: Column) -> Column:
    """Median of the smaller half (at least one) of an array."""
    ordered = F.sort_array(values)
    low = F.slice(ordered, 1, F.greatest(F.lit(1), F.floor(F.size(ordered) / 2)).cast("int"))
    n = F.size(low)
    mid = (F.get(low, F.floor((n - 1) / 2).cast("int")) + F.get(low, F.floor(n / 2).cast("int"))) / 2
    return F.when(F.size(ordered) > 0, mid)


def threshold_columns(med_h: Column, med_w: Column, med_gap: Column, low_shift: Column) -> tuple[Column, Column]:
    """Vertical and horizontal split thresholds from a block's medians (zero or missing = absent)."""
    half_even = lambda c: F.bround(c, 0)
    some = lambda c: F.when(c != 0, c)
    vertical = F.greatest(half_even(some(med_gap) * GAP_FACTOR), half_even(some(med_h) * HEIGHT_FACTOR))
    vertical = F.greatest(vertical, F.when(vertical.isNotNull(), F.lit(1.0)))
    vertical = F.when(some(med_h).isNotNull(), F.least(vertical, half_even(med_h * HEIGHT_MAX_FACTOR))).otherwise(vertical)
    shift = F.when((med_w != 0) & (low_shift > med_w * 0.6), F.lit(0.0)).otherwise(low_shift)
    horizontal = F.greatest(half_even(some(med_w) * WIDTH_FACTOR), half_even(some(shift) * SHIFT_FACTOR))
    horizontal = F.greatest(horizontal, F.when(horizontal.isNotNull(), F.lit(float(SHIFT_MIN))))
    fallback = F.lit(float(FALLBACK))
    return F.coalesce(vertical, fallback), F.coalesce(horizontal, fallback)


def _with_steps(lines: DataFrame) -> DataFrame:
    return (
        lines.filter("width > 0").withColumns({
            "gap": F.col("vpos") - F.lag("bottom").over(_rows()), "shift": F.col("hpos") - F.lag("hpos").over(_rows())})
    )


def layout_thresholds(lines: DataFrame) -> DataFrame:
    """One row per input block: medians and the two split thresholds."""
    med = (
        _with_steps(lines)
        .groupBy(*BLOCK)
        .agg(
            F.median("height").alias("med_h"),
            F.median("width").alias("med_w"),
            F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("med_gap"),
            F.collect_list(F.when(F.col("shift") > 0, F.col("shift"))).alias("_shifts"),
        )
        .withColumn("med_shift", median_of_low_half(F.col("_shifts")))
        .drop("_shifts")
    )
    v, h = threshold_columns(F.col("med_h"), F.col("med_w"), F.col("med_gap"), F.col("med_shift"))
    return med.withColumn("vthr", v).withColumn("hthr", h)


def with_thresholds(lines: DataFrame) -> DataFrame:
    """Lines with their block's thresholds, as windows: no second pass over the lines."""
    med = (
        _with_steps(lines)
        .withColumns({  # together: one window for all of them
            "med_h": F.median("height").over(_all()),
            "med_w": F.median("width").over(_all()),
            "_gap": F.median(F.when(F.col("gap") > 0, F.col("gap"))).over(_all()),
            "_shifts": F.collect_list(F.when(F.col("shift") > 0, F.col("shift"))).over(_all()),
        })
        .withColumn("_shift", median_of_low_half(F.col("_shifts")))
    )
    v, h = threshold_columns(F.col("med_h"), F.col("med_w"), F.col("_gap"), F.col("_shift"))
    return med.withColumn("vthr", v).withColumn("hthr", h).drop("_gap", "_shifts", "_shift", "shift")


def _center_flag(window, page_w: Column) -> Column:
    """All line centres agree with their median or the page centre, and widths vary enough."""
    center = F.col("hpos") + F.col("width") / 2
    med_c, med_w = F.median(center).over(window), F.median("width").over(window)
    lo, hi = F.min(center).over(window), F.max(center).over(window)
    near_median = (hi - med_c <= med_w * CENTER_MARGIN) & (med_c - lo <= med_w * CENTER_MARGIN)
    page_c = page_w / 2
    near_page = (hi - page_c <= page_w * CENTER_MARGIN) & (page_c - lo <= page_w * CENTER_MARGIN)
    spread = F.max("width").over(window) - F.min("width").over(window)
    return (near_median | near_page) & (spread > med_w * CENTER_WIDTH_SPREAD)


def vgap_segments(lines: DataFrame) -> DataFrame:
    """Number the vertical groups of a block: a new one where the gap passes the threshold."""
    return with_thresholds(lines).withColumn(
        "vgroup", F.sum(F.when(F.col("gap") > F.col("vthr"), 1).otherwise(0)).over(_rows()).cast("bigint")
    )


def centered_groups(grouped: DataFrame, page_w: Column) -> DataFrame:
    """Add the centred flag of the vertical group and of the whole block."""
    group = Window.partitionBy(*BLOCK, "vgroup")
    return grouped.withColumn("block_centered", _center_flag(_all(), page_w)).withColumn(
        "group_centered", _center_flag(group, page_w)
    )


def hshift_segments(flagged: DataFrame) -> DataFrame:
    """Non-empty lines with the flags of every boundary kind before them."""
    ordered = _rows()
    prev_font = F.col("_font")
    ratio = F.greatest(prev_font, F.col("font_size")) / F.nullif(F.least(prev_font, F.col("font_size")), F.lit(0.0))
    located = (
        flagged.withColumns({
            "prev_left": F.lag(F.when(F.col("text") == "", F.col("hpos")).otherwise(F.col("eff_left"))).over(ordered),
            "_font": F.lag("font_size").over(ordered), "last_vgroup": F.max("vgroup").over(_whole(ordered))})
        .withColumn("font_differs", F.coalesce((prev_font > 0) & (F.col("font_size") > 0) & (ratio >= FONT_RATIO), F.lit(False)))
        .filter("text <> ''")
        .withColumns({"_group": F.lag("vgroup").over(ordered), "_h": F.lag("mean_h").over(ordered)})
    )
    prev_group, prev_h = F.col("_group"), F.col("_h")
    h_ratio = F.greatest(prev_h, F.col("mean_h")) / F.nullif(F.least(prev_h, F.col("mean_h")), F.lit(0.0))
    same_group = F.coalesce(prev_group == F.col("vgroup"), F.lit(False))
    step = F.col("eff_left") - F.col("prev_left")
    return (
        located.withColumn("step", step)
        .withColumn("b_first", ~same_group)
        .withColumn(
            "b_shift",
            F.coalesce(
                ~F.col("group_centered") & F.col("prev_left").isNotNull() & ((step > F.col("hthr")) | F.col("font_differs")),
                F.lit(False),
            ),
        )
        .withColumn(
            "b_center",
            F.col("group_centered") & F.col("block_centered") & same_group
            & (F.col("font_differs") | F.coalesce(
                prev_h.isNotNull() & F.col("mean_h").isNotNull() & (h_ratio >= CENTER_HEIGHT_RATIO), F.lit(False))),
        )
        .drop("prev_left", "font_differs", "mean_h", "_font", "_group", "_h")
    )


def indent_split(cut: DataFrame) -> DataFrame:
    """Final block numbers: segments, cut again before the last line that steps back to the left.

    In a segment let K be the last line stepping left by more than the limit; lines before
    K-1 stand alone, the rest stays together.
    """
    seg = F.sum(F.when(F.col("b_first") | F.col("b_shift") | F.col("b_center"), 1).otherwise(0)).over(_rows())
    rows = Window.partitionBy(*BLOCK, "seg").orderBy("line_seq")
    negative = (
        ~F.col("group_centered") & (F.col("n") > 0) & (F.col("step") < 0)
        & (-F.col("step") > F.col("hthr") * NEGATIVE_FACTOR)
    )
    next_group, next_shift, next_center = (F.lead(c).over(_rows()) for c in ("vgroup", "b_shift", "b_center"))
    ends_with = (
        F.when(F.coalesce(next_group, F.col("last_vgroup")) != F.col("vgroup"), "vertical_gap")
        .when(next_shift, "horizontal_shift")
        .when(next_center, "center_font_change")
    )
    return (
        cut.withColumns({"seg": seg.cast("bigint"), "_end": ends_with})
        .withColumn("n", (F.row_number().over(rows) - 1).cast("bigint"))
        .withColumns({"_cut": F.max(F.when(negative, F.col("n"))).over(_whole(rows)) - 1, "_end": F.last("_end").over(_whole(rows))})
        .withColumn("single", F.coalesce(F.col("n") < F.col("_cut"), F.lit(False)))
        .withColumn("sub", F.when(F.col("single"), F.col("n")).otherwise(F.coalesce(F.col("_cut"), F.lit(0))))
        .withColumn("centered", F.when(F.col("single"), F.col("block_centered")).otherwise(F.col("group_centered")))
        .withColumn("split_reason", F.when(F.col("single"), "horizontal_indent").otherwise(F.col("_end")))
        .drop("_cut", "_end")
    )


OUT_BLOCK = [*BLOCK, "seg", "sub"]


def hyphen_merge(numbered: DataFrame) -> DataFrame:
    """Join words broken across lines of one block.

    A line gives its last word to the next line's first when it ends in a hyphen after a letter.
    A one-word line whose word was taken cannot take in turn, which alternates along runs of such
    lines; the position inside the run decides.
    """
    rows = Window.partitionBy(*OUT_BLOCK).orderBy("line_seq")
    last = F.element_at("words", -1)
    has = F.size("words") > 0
    last_tok = F.when(has, last["tok"]).otherwise(F.lit(""))
    following = F.lead(F.when(has, F.get("words", F.lit(0)))).over(rows)
    ends = last_tok.rlike(rf"[{T.HYPHENS}]$") & T.has_alpha(F.expr("left(_last, length(_last) - 1)"))
    marked = (
        numbered.withColumn("_last", last_tok)
        .withColumn("_ends", ends)
        # the line before takes a word if there is a first one here
        .withColumns({"_next": following, "_before": F.lag("_ends").over(rows), "_k": F.row_number().over(rows)})
        .withColumn("_e", F.col("_ends") & F.col("_next").isNotNull())
        .withColumn("_one", F.size("words") == 1)
    )
    prev_e = F.coalesce(F.col("_before") & has & F.get("words", F.lit(0)).isNotNull(), F.lit(False))
    starts = ~(F.col("_one") & F.col("_e") & prev_e)
    taken = F.coalesce(F.lag("_m").over(rows), F.lit(False))
    tail = F.struct(
        F.concat(F.expr("left(_last, length(_last) - 1)"), F.col("_next.tok")).alias("tok"),
        T.nonspace_len(F.concat(F.expr("left(_last, length(_last) - 1)"), F.col("_next.tok"))).alias("len"),
        F.greatest(last["height"], F.col("_next.height")).alias("height"),
        F.lit(True).alias("alnum"),  # the part before the hyphen holds a letter
    )
    kept = F.when(F.col("_taken"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))).otherwise(F.col("words"))
    joined = F.when(
        F.col("_m"), F.concat(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), F.array(tail))
    ).otherwise(F.col("_w"))
    return (
        marked.withColumn("_start", F.max(F.when(starts, F.col("_k"))).over(rows))
        .withColumn("_m", F.col("_e") & ((F.col("_k") - F.col("_start")) % 2 == 0))
        .withColumn("_taken", taken)
        .withColumn("_w", kept)
        .withColumn("words", joined)
        .withColumn(
            "text",
            F.when(F.col("_m") | F.col("_taken"), F.trim(F.array_join("words.tok", " ")))
            .otherwise(F.col("text")),
        )
        .drop("_last", "_ends", "_next", "_before", "_e", "_one", "_k", "_start", "_m", "_taken", "_w")
    )


def segment_lines(lines: DataFrame, page_w: Column) -> DataFrame:
    """Lines with their output block number, centred flag and split reason."""
    grouped = centered_groups(vgap_segments(read_words(lines)), page_w)
    return indent_split(hshift_segments(grouped))


def gather_blocks(merged: DataFrame) -> DataFrame:
    """One row per output block; a block number counts blocks of the page in document order."""
    line = F.struct("line_seq", "text", "words", "font_size", "chars", "bold", "hpos", "vpos", "width", "bottom")
    per_block = (
        merged.groupBy(*OUT_BLOCK)
        .agg(
            F.array_sort(F.collect_list(line)).alias("ls"),
            F.first("book_id").alias("book_id"),
            F.first("block_id").alias("source_block_id"),
            F.first("centered").alias("centered"),
            F.first("split_reason").alias("split_reason"),
            F.min("bold").alias("all_bold"),
            F.max("font_size").alias("max_font"),
            F.count("*").alias("line_count"),
        )
        .withColumn("text", F.trim(F.array_join(F.array_remove("ls.text", ""), " ")))
        .filter("text <> ''")
    )
    order = Window.partitionBy("page_id").orderBy("block_seq", "seg", "sub")
    first = F.get("ls", F.lit(0))
    return per_block.select(
        "page_id",
        "book_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("block_no"),
        "source_block_id",
        "text",
        "centered",
        "all_bold",
        "line_count",
        "split_reason",
        first["vpos"].cast("double").alias("top"),
        (first["hpos"] + first["width"] / 2).alias("left"),
        first["bottom"].cast("double").alias("bottom"),
        first["width"].alias("width"),
        "max_font",
        F.col("ls.font_size").alias("fonts"),
        F.transform("ls", lambda x: F.struct(x["font_size"].alias("font"), x["chars"].alias("chars"))).alias("font_chars"),
        F.flatten("ls.words").alias("words"),
    )


def page_blocks(lines: DataFrame, page_w: Column) -> DataFrame:
    """Output blocks of every page, before tags are decided."""
    return gather_blocks(hyphen_merge(segment_lines(lines, page_w)))
