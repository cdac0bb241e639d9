"""Printed page numbers: which short lines carry them, and the notes that report them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T

# Fixed values.
SHORT_SHARE = 0.2
LETTER_SHARE = 0.5
LETTER_MIN_CHARS = 5
NOTE_STYLE = ' style="display:block;font-size:0.82em;color:#1e5aa8;font-weight:bold;"'
FOUND = "Page number: %s ; OCR text: %s"
CANDIDATE = " ; !FOUND ONLY KANDIDATE!"
NOT_FOUND = "Page number: %s ; OCR text: None ; !NOT FOUND!"
UNPRINTED = "Page number: %s ; SHOULDN'T BE ON PAGE"
SECONDARY = "Secondary page number OCR: %s%s"
SECONDARY_CANDIDATE = " ; !FOUND OLNY KANDIDATE!"
STARRED = r"(^|[^0-9])[0-9]+[^\p{L}\p{N}_]*\*"
AROUND_STARRED = r"(?s)^((?:.*?[^0-9])??)[0-9]+[^\p{L}\p{N}_]*\*(.*)$"


def flag_lines(lines: DataFrame, page_w: Column) -> DataFrame:
    """Add ``role`` (match, suspect, starred, starred_mixed, bare) and ``is_number_line``.

    Lines carry ``page_number`` of their page.
    """
    num = T.page_number("page_number")
    value = lambda t: T.hyp_resolve(t.content, t.subs_content, t.subs_type)
    limit = F.greatest(page_w * SHORT_SHARE, F.lit(1.0))
    end = lambda t: t["hpos"] + F.greatest(F.coalesce(t["width"], F.lit(0)), F.lit(0))
    # most lines are plainly too long: their first and last words alone reach beyond the limit
    one, last = F.get("tokens", F.lit(0)), F.get("tokens", F.size("tokens") - 1)
    long_ = T.has_alnum(value(one)) & T.has_alnum(value(last)) & (end(last) - one["hpos"] > limit)
    short = F.coalesce(F.col("_search") & ~F.coalesce(long_, F.lit(False)), F.lit(False))
    kept = F.when(short, F.filter(
        F.transform("tokens", lambda t: F.struct(value(t).alias("tok"), t["hpos"].alias("lo"), end(t).alias("hi"))),
        lambda t: t["tok"] != ""))
    signs = F.filter("_kept", lambda t: T.has_alnum(t["tok"]) & t["lo"].isNotNull())
    txt = F.col("_text")
    chars = F.length(F.regexp_replace(txt, r"\s", ""))
    letters = F.length(F.regexp_replace(txt, r"[^\p{L}]", ""))
    wordy = (~F.col("_roman")) & (chars >= LETTER_MIN_CHARS) & (letters >= chars * LETTER_SHARE)
    considered = (
        F.col("_kept").isNotNull() & F.col("_value").isNotNull() & (F.col("_width") > 0) & (F.col("_width") <= limit)
        & (txt != "") & ~wordy
    )
    edge = F.when(F.col("_roman"), F.lit("[^0-9A-Za-z]")).otherwise(F.lit("[^0-9]"))
    matches = F.regexp_like(txt, F.concat(F.lit("(^|"), edge, F.lit(")"), F.col("_value"), F.lit("($|"), edge, F.lit(")")))
    rest = F.concat(F.regexp_extract(txt, AROUND_STARRED, 1), F.regexp_extract(txt, AROUND_STARRED, 2))
    role = (
        F.when(~F.coalesce(considered, F.lit(False)), F.lit(None).cast("string"))
        .when(matches, "match")
        .when(txt.rlike(STARRED), F.when(rest.rlike("[0-9A-Za-z]"), "starred_mixed").otherwise("starred"))
        .when(txt.rlike(r"^[0-9]{1,4}$"), "bare")
        .otherwise("suspect")
    )
    page = Window.partitionBy("page_id")
    count = lambda *roles: F.count(F.when(F.col("role").isin(*roles), 1)).over(page)
    return (
        lines.withColumn("_value", num["value"])
        .withColumn("_search", num["searchable"])
        .withColumn("_roman", F.coalesce(T.has_alpha(num["value"]), F.lit(False)))
        .withColumn("_kept", kept)
        .withColumn("_text", F.trim(F.array_join("_kept.tok", " ")))
        .withColumn("_signs", signs)
        .withColumn("_width", F.when(F.size("_signs") > 0, F.greatest(F.array_max("_signs.hi") - F.array_min("_signs.lo"), F.lit(0)))
                    .otherwise(F.col("width")))
        .withColumn("role", role)
        .withColumn("_matches", count("match"))
        .withColumn("_suspects", count("suspect"))
        .withColumn("_secondary", count("starred", "starred_mixed", "bare"))
        .withColumn(
            "role",
            F.when(
                (F.col("role") == "bare") & (F.col("_matches") == 0) & (F.col("_suspects") == 0) & (F.col("_secondary") == 1),
                "promoted",
            ).when((F.col("role") == "suspect") & (F.col("_matches") > 0), F.lit(None)).otherwise(F.col("role")),
        )
        .withColumn("is_number_line", F.coalesce(F.col("role").isin("match", "starred", "promoted"), F.lit(False)))
        .withColumn("number_text", F.when(F.col("role").isNotNull(), F.col("_text")))
        .drop("_value", "_search", "_roman", "_kept", "_signs", "_text", "_width", "_matches", "_suspects", "_secondary")
    )


def note(text: Column) -> Column:
    return F.concat(F.lit(f"<note{NOTE_STYLE}>"), T.escape(text, quote=False), F.lit("</note>"))


def page_number_notes(flagged: DataFrame, pages: DataFrame, page_h: Column) -> DataFrame:
    """Notes of every page, in order: found or missing number first, then secondary numbers.

    ``flagged`` comes from :func:`flag_lines`; only the few lines with a role reach the aggregation.  ``page_h`` is a value or a
    column of ``pages``.
    """
    roles = flagged.filter("role IS NOT NULL").select(
        "page_id", "role", "number_text", "vpos", "block_seq", "line_seq",
        F.when(F.col("role").isin("match", "suspect", "promoted"), 1).otherwise(2).alias("kind"),
    )
    per_page = roles.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("kind", "vpos", "block_seq", "line_seq", "role", "number_text"))).alias("found")
    )
    num = T.page_number("page_number")
    shown = F.coalesce(F.when(F.trim("page_number") != "", F.trim("page_number")), F.col("_n.value"))
    primary = F.filter("found", lambda x: x.kind == 1)
    second = F.filter("found", lambda x: x.kind == 2)
    h = F.col("_h")
    first_notes = (
        F.when(
            F.col("_n.value").isNotNull() & F.col("_n.searchable"),
            F.when(
                F.size("_primary") > 0,
                F.transform(
                    "_primary",
                    lambda x: F.struct(
                        x.vpos.alias("vpos"),
                        F.concat(
                            F.format_string(FOUND, F.col("_n.value"), x.number_text),
                            F.when(x.role == "match", "").otherwise(CANDIDATE),
                        ).alias("text"),
                    ),
                ),
            ).otherwise(F.array(F.struct((h + 1).alias("vpos"), F.format_string(NOT_FOUND, F.col("_n.value")).alias("text")))),
        )
        .when(shown.isNotNull(), F.array(F.struct((h + 1).alias("vpos"), F.format_string(UNPRINTED, shown).alias("text"))))
    )
    top = F.greatest(F.array_max(F.transform("_notes", lambda x: x.vpos)), h) + 1
    second_notes = F.transform(
        "_second",
        lambda x, i: F.struct(
            (F.col("_top") + i).alias("vpos"),
            F.format_string(
                SECONDARY, x.number_text, F.when(x.role == "starred_mixed", SECONDARY_CANDIDATE).otherwise("")
            ).alias("text"),
        ),
    )
    return (
        pages.select("page_id", "page_number", page_h.cast("bigint").alias("_h"))
        .filter("page_number IS NOT NULL")
        .join(per_page, "page_id", "left")
        .withColumn("_n", num)
        .withColumn("found", F.coalesce("found", F.expr("from_json('[]', 'array<struct<kind:int,vpos:bigint,block_seq:bigint,line_seq:bigint,role:string,number_text:string>>')")))
        .withColumn("_primary", primary)
        .withColumn("_second", second)
        .withColumn("_notes", first_notes)
        .filter("_notes IS NOT NULL")
        .withColumn("_top", top)
        .select("page_id", F.posexplode(F.concat("_notes", second_notes)).alias("note_seq", "n"))
        .select("page_id", F.col("note_seq").cast("bigint").alias("note_seq"), "n.vpos", "n.text")
    )
