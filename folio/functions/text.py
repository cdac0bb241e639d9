"""Text column functions; every one is a native column expression."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end a line as a hyphen.
HYPHENS = "-–—‑‒−‐"
# Punctuation skipped when it stands alone at the left edge of a line.
NOISE_LEADING = ".:,;)]\"'“”’"
# A page whose type or title holds one of these is not a text page.
NON_TEXT_TERMS = [
    "titul", "title", "cover", "obal", "obsah", "content", "contents",
    "ilustr", "illustr", "obraz", "image", "map", "fotograf", "photo",
    "reklam", "advert", "příloh", "priloh", "appendix", "příloha",
    "napis", "blank", "prázd", "prazd", "index",
]
# Characters dropped from a search word.
QUERY_DROP = "-?!»«;)(.„\","

# A fragment made only of these is noise; more than 70% of the second set is noise too.
NOISE_ONLY = r"^[•\sIVXLCDM/0-9.,\-]+$"
NOISE_PUNCT = "•.,/ -"

ROMAN = "[IVXLCDMivxlcdm]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# What counts as white space at the ends of a text.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(_c(c), F.lit(WHITE))


def clean_text(c: Column | str) -> Column:
    """No-break space to space, whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(_c(c), r"[\s ]+", " "))


def strip_uuid(c: Column | str) -> Column:
    c = _c(c)
    return F.when(c.startswith("uuid:"), F.substr(c, F.lit(6))).otherwise(c)


def api_version(url: Column | str) -> Column:
    return F.when(_c(url).contains("api/client/v7.0"), F.lit("k7")).otherwise(F.lit("k5"))


def pid_for(c: Column | str, version: Column) -> Column:
    """Identifier as the given interface version wants it: bare or with ``uuid:``."""
    bare = strip_uuid(strip(c))
    return F.when((version == "k7") & (bare != ""), F.concat(F.lit("uuid:"), bare)).otherwise(bare)


def page_number(c: Column | str) -> Column:
    """STRUCT(value, searchable) of a printed page number: digits or roman, bare or in brackets."""
    t = strip(c)
    bare = t.rlike(rf"^([0-9]+|{ROMAN})$")
    bracketed = t.rlike(rf"^\[\s*([0-9]+|{ROMAN})\s*\]$")
    inner = F.regexp_extract(t, rf"^\[\s*([0-9]+|{ROMAN})\s*\]$", 1)
    return F.struct(
        F.when(bare, F.upper(t)).when(bracketed, F.upper(inner)).alias("value"),
        F.coalesce(bare, F.lit(False)).alias("searchable"),
    )


def page_label(c: Column | str) -> Column:
    """Label used to look a page up: no outer brackets, no spaces, lower case."""
    return F.lower(F.replace(F.trim(F.btrim(strip(c), F.lit("[](){}"))), F.lit(" "), F.lit("")))


def hyp_resolve(content: Column, subs_content: Column, subs_type: Column) -> Column:
    """Word as read: the first half of a hyphenated pair gives the whole word, the second gives ''."""
    return (
        F.when(subs_type == "HypPart1", F.coalesce(subs_content, F.lit("")))
        .when(subs_type == "HypPart2", F.lit(""))
        .otherwise(F.coalesce(content, F.lit("")))
    )


def is_text_page(page_type: Column | str, title: Column | str) -> Column:
    hay = F.lower(F.concat_ws("\n", F.coalesce(_c(page_type), F.lit("")), F.coalesce(_c(title), F.lit(""))))
    return ~hay.rlike("|".join(NON_TEXT_TERMS))


def nonspace_len(c: Column | str) -> Column:
    return F.length(F.translate(_c(c), " \t\n\r\f\u000b", ""))


def has_alnum(c: Column | str) -> Column:
    return _c(c).rlike(r"[\p{L}\p{N}]")


def has_alpha(c: Column | str) -> Column:
    return _c(c).rlike(r"\p{L}")


def escape(c: Column | str, quote: bool = True) -> Column:
    """HTML escape; quotes only on request."""
    out = _c(c)
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if quote:
        pairs += [('"', "&quot;"), ("'", "&#x27;")]
    for raw, entity in pairs:
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


# longest names first: a name without its semicolon ends where a longer one does not go on
_ENTITY = (
    r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&(?:" + "|".join(sorted((re.escape(n) for n in html5), key=len, reverse=True)) + r")|[^&]+|&"
)


_NAMED = json.dumps({f"&{name}": value for name, value in html5.items()})
_WESTERN = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def _code_point(ref: Column) -> Column:
    """Character of a numeric reference; what is no character gives nothing or the replacement mark."""
    digits = F.regexp_extract(ref, r"^&#[xX]?([0-9a-fA-F]+)", 1)
    n = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 7, F.lit(0x110000)).otherwise(F.when(F.lower(ref).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("int"))
    western = F.substr(F.lit(_WESTERN), n - 0x7F, F.lit(1))
    gone = n.isin(1, 0xB, 0x7F, 0xFFFE, 0xFFFF) | n.between(2, 8) | n.between(0xE, 0x1F) | n.between(0xFDD0, 0xFDEF) | ((n > 0xFFFF) & (n % 65536 >= 0xFFFE))
    return (
        F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
        .when(n.between(0x80, 0x9F), western).when(gone, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))


def unescape(c: Column | str) -> Column:
    """Decode named and numeric character references, once."""
    text = _c(c)
    named = F.from_json(F.lit(_NAMED), "map<string,string>")
    one = lambda t: (
        F.when(~t.startswith("&") | (t == "&"), t).when(t == "&amp;", "&").when(t.startswith("&#"), _code_point(t)).otherwise(F.try_element_at(named, t)))
    return F.when(text.contains("&"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)), one), "")).otherwise(text)


def query_word(c: Column | str) -> Column:
    return F.translate(F.lower(_c(c)), QUERY_DROP, "")


def content_key(page: Column | str, left: Column | str, right: Column | str) -> Column:
    """Key of a comparison result: changes whenever the page or either text does."""
    return F.concat_ws(":", _c(page).cast("string"), F.sha2(_c(left), 256), F.sha2(_c(right), 256))


def is_noise(c: Column | str) -> Column:
    """Fragment without enough text to be worth comparing.

    The text is lower-cased first, so upper-case roman letters never match; kept as it is.
    """
    t = block_text(c)
    weak = F.length(t) - F.length(F.translate(t, NOISE_PUNCT, ""))
    return (F.length(t) <= 6) | t.rlike(NOISE_ONLY) | (weak / F.greatest(F.length(t), F.lit(1)) > 0.7)


def block_text(c: Column | str) -> Column:
    """Comparable text of a fragment: no tags, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(_c(c), r"<[^>]+>", " "), r"\s+", " ")))


def block_tag(c: Column | str) -> Column:
    """Name of the first tag of a fragment, lower case, '' for plain text."""
    return F.lower(F.regexp_extract(F.trim(_c(c)), r"^<\s*([a-zA-Z0-9]+)", 1))


def block_key(c: Column | str) -> Column:
    return F.concat_ws("|", block_tag(c), block_text(c))


def export_name(name: Column, title: Column, source: Column, fmt: Column) -> Column:
    """Given file name, else the title with underscores, the source and the format."""
    t = F.trim(F.coalesce(title, F.lit("")))
    safe = F.when(t == "", F.lit("export")).otherwise(F.regexp_replace(t, r"\s+", "_"))
    return F.coalesce(F.when(name != "", name), F.concat(safe, F.lit("-"), source, F.lit("."), fmt))


def clamp(c: Column | str, lo: float, hi: float, default: float) -> Column:
    """Numeric setting kept inside its range; unreadable or missing gives the default."""
    v = F.coalesce(_c(c).cast("string").try_cast("double"), F.lit(default).cast("double"))
    return F.least(F.greatest(v, F.lit(lo).cast("double")), F.lit(hi).cast("double"))


def reasoning_effort(c: Column | str) -> Column:
    v = F.lower(F.trim(_c(c)))
    return F.when(v.isin("low", "medium", "high"), v).otherwise(F.lit("medium"))
