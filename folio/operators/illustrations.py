"""Illustration rectangles: nested ones, notes, metadata of incomplete notes, crop regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
NESTED_RATIO = 0.95
NOTE_STYLE = ' style="display:block;font-size:0.82em;color:#1c9b4a;font-weight:bold;"'
CROP_SIDE = 1600


def illustration_dedupe(illustrations: DataFrame, ratio: float = NESTED_RATIO) -> DataFrame:
    """Drop a rectangle covered by another one (the first of two equal ones).

    Pairs are taken in order.  A rectangle dropped earlier takes part in no further pair, except
    that one dropped while it is being compared finishes its own comparisons.  The fold walks the
    page's overlapping pairs; a page has a handful of them.
    """
    area = lambda r: F.greatest(F.lit(1.0), r.w * r.h)

    def overlap(a: Column, b: Column) -> Column:
        iw = F.greatest(F.lit(0.0), F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x))
        ih = F.greatest(F.lit(0.0), F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y))
        return (iw * ih > 0) & (iw * ih / F.least(area(a), area(b)) >= ratio)

    rects = F.array_sort(F.collect_list(F.struct("seq", "x", "y", "w", "h")))
    pairs = F.flatten(F.transform("_r", lambda a: F.transform(
        F.filter("_r", lambda b: (b.seq > a.seq) & overlap(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    loser = lambda p: F.when(area(p.a) <= area(p.b), p.a.seq).otherwise(p.b.seq)
    start = F.expr("named_struct('out', cast(array() as array<bigint>), 'cur', cast(-1 as bigint), 'skip', false)")

    def step(acc: Column, p: Column) -> Column:
        skip = F.when(acc["cur"] == p.a.seq, acc["skip"]).otherwise(F.array_contains(acc["out"], p.a.seq))
        out = F.when(skip | F.array_contains(acc["out"], p.b.seq), acc["out"]).otherwise(
            F.array_append(acc["out"], loser(p)))
        return F.struct(out.alias("out"), p.a.seq.alias("cur"), skip.alias("skip"))

    dropped = F.aggregate("_p", start, step, lambda acc: acc["out"])
    return (
        illustrations.groupBy("page_id")
        .agg(rects.alias("_r"))
        .withColumn("_p", pairs)
        .withColumn("_d", dropped)
        .select("page_id", F.inline(F.filter("_r", lambda r: ~F.array_contains(F.col("_d"), r.seq))))
    )


def illustration_notes(kept: DataFrame, page_w: Column, page_h: Column) -> DataFrame:
    """Placeholder note of each illustration."""
    i = lambda c: F.col(c).cast("bigint")
    box = F.format_string("%d,%d,%d,%d", i("x"), i("y"), i("w"), i("h"))
    size = F.format_string("%dx%d", page_w.cast("bigint"), page_h.cast("bigint"))
    has_size = (page_w != 0) & (page_h != 0)
    html = F.concat(
        F.lit(f'<note class="illustration"{NOTE_STYLE} data-uuid="'), F.col("page_id").cast("string"),
        F.lit('" data-bbox="'), box,
        F.lit('" data-page-width="'), page_w.cast("bigint").cast("string"),
        F.lit('" data-page-height="'), page_h.cast("bigint").cast("string"),
        F.lit('">Ilustrace: bbox='), box, F.when(has_size, F.concat(F.lit(" page="), size)).otherwise(F.lit("")),
        F.lit("</note>"),
    )
    return kept.withColumn("html", html)


def note_bbox(c: Column) -> Column:
    """STRUCT(x, y, w, h, pw, ph) read from a note such as ``bbox=1,2,3,4 page=10x20``."""
    num = r"(-?[0-9]+(?:\.[0-9]+)?)"
    box = rf"^(?:[^b]|b(?!box=))*bbox={num},{num},{num},{num}(?:\s|$)"
    page = r"^(?:[^p]|p(?!age=))*page=([0-9]+)x([0-9]+)(?:\s|$)"
    n = lambda pat, g, kind: F.regexp_extract(c, pat, g).try_cast(kind)
    return F.struct(
        *[n(box, k + 1, "double").alias(name) for k, name in enumerate("xywh")],
        n(page, 1, "bigint").alias("pw"), n(page, 2, "bigint").alias("ph"),
    )


def illustration_backfill(notes: DataFrame, illustrations: DataFrame) -> DataFrame:
    """Fill the k-th incomplete note of a page from its k-th illustration, then from its own text.

    Values already present stay.
    """
    order = Window.partitionBy("page_id").orderBy("ord")
    incomplete = F.col("bbox").isNull() | F.col("page_w").isNull() | F.col("page_h").isNull()
    keyed = notes.withColumn("_k", F.when(incomplete, F.count(F.when(incomplete, 1)).over(order)))
    seq = Window.partitionBy("page_id").orderBy("seq")
    fields = ["bbox", "page_w", "page_h", "uuid"]
    source = illustrations.select(
        "page_id", F.row_number().over(seq).cast("bigint").alias("_k"), *[F.col(c).alias(f"_{c}") for c in fields]
    )
    text = note_bbox(F.col("text"))
    whole = lambda f: F.col(f"_t.{f}").cast("bigint")
    own = {
        "bbox": F.when(F.col("_t.x").isNotNull() & incomplete, F.format_string("%d,%d,%d,%d", *[whole(f) for f in "xywh"])),
        "page_w": F.when(incomplete, F.col("_t.pw")),
        "page_h": F.when(incomplete, F.col("_t.ph")),
        "uuid": F.lit(None).cast("string"),
    }
    return (
        keyed.join(source, ["page_id", "_k"], "left")
        .withColumn("_t", text)
        .select("page_id", "ord", *[F.coalesce(c, f"_{c}", own[c]).alias(c) for c in fields])
    )


def crop_region(x, y, w, h, pw, ph, iw, ih) -> Column:
    """Crop of the scanned image: page units scaled to pixels, half-even, kept inside the image.

    STRUCT(x, y, w, h, size, region); NULL where a dimension is missing.
    """
    px = lambda v, low, img, page: F.bround(F.greatest(v, F.lit(low)) * (img / F.nullif(page, F.lit(0.0))), 0).cast("bigint")
    inside = lambda at, n, img: F.when(at + n > img, F.greatest(F.lit(1).cast("bigint"), img.cast("bigint") - at)).otherwise(n)
    cx, cy = px(x, 0.0, iw, pw), px(y, 0.0, ih, ph)
    cw, ch = inside(cx, px(w, 1.0, iw, pw), iw), inside(cy, px(h, 1.0, ih, ph), ih)
    return F.when(
        (pw > 0) & (ph > 0) & (iw > 0) & (ih > 0),
        F.struct(
            cx.alias("x"), cy.alias("y"), cw.alias("w"), ch.alias("h"),
            F.when(F.greatest(cw, ch) > CROP_SIDE, F.lit(f",{CROP_SIDE}")).otherwise(F.lit("max")).alias("size"),
            F.format_string("%d,%d,%d,%d", cx, cy, cw, ch).alias("region"),
        ),
    )
