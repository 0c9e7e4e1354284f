"""Column functions on text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import folded, let

#: White space as the browser's regular expressions have it (a fixed value).
WHITE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def half_up(x: Column) -> Column:
    """Rounds to the nearest integer, halves up (Spark's round takes halves away from zero)."""
    return F.floor(x + 0.5)


def snippet(text: Column, most: int = 160) -> Column:
    """The text, or its first most - 3 characters and three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def shortened(text: Column, most: int = 160) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WHITE}+", " "))


def literal_pattern(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def occurrences(text: Column, needle: str, case_sensitive: bool = True) -> Column:
    """0-based positions of the needle's non-overlapping occurrences, from left to right. They are found in the text itself: a
    lower-cased copy can have other positions."""
    empty = F.array().cast("array<int>")
    zero = lambda before: F.struct((F.lit(-len(needle)) if before is None else before["at"]).alias("at"), empty.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        at = acc["at"] + len(needle) + F.length(piece)
        return F.struct(at.alias("at"), F.array_append(acc["out"], at).alias("out"))

    # Each piece but the last ends where an occurrence starts.
    parts = F.split(text, ("" if case_sensitive else "(?iu)") + literal_pattern(needle), -1)
    return let(parts, lambda parts: folded(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), zero, step, empty))


def keywords(text: Column, between: str = "[,\n]") -> Column:
    """Entries between commas or line ends (or what else the pattern says, WORDS for white space), trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, between), lambda x: F.trim(x)), lambda x: x != "")


#: For keywords: entries between commas or any white space.
WORDS = WHITE.replace("]", ",]") + "+"


def expand_tokens(template: str, page: Column, pages: Column, date: str, title: Column) -> Column:
    """{page}, {pages}, {date} and {title} filled in; the date is a parameter so that results are reproducible."""
    fill = {"{page}": page.cast("string"), "{pages}": pages.cast("string"), "{date}": F.lit(date), "{title}": F.coalesce(title, F.lit(""))}
    return reduce(lambda out, kv: F.replace(out, F.lit(kv[0]), kv[1]), fill.items(), F.lit(template))


def file_name(name: Column) -> Column:
    """A name safe for file systems: anything but word characters, dots and - becomes one _."""
    return F.regexp_replace(name, r"[^\w.\-]+", "_")


#: Byte forms in which a string may survive in a file.
ENCODINGS = ("utf8", "utf16be", "utf16be-bom", "utf16le", "utf16le-bom", "latin1", "hex")


def encoded(text: Column) -> dict[str, Column]:
    be, le = F.encode(text, "UTF-16BE"), F.encode(text, "UTF-16LE")
    utf8 = F.encode(text, "UTF-8")
    return {
        "utf8": utf8, "utf16be": be, "utf16be-bom": F.concat(F.unhex(F.lit("FEFF")), be), "utf16le": le, "utf16le-bom": F.concat(F.unhex(F.lit("FFFE")), le),
        "latin1": F.when(text.rlike("^[\\x00-\\xff]*$"), F.encode(text, "ISO-8859-1")), "hex": F.encode(F.hex(utf8), "UTF-8"),
    }


def iso_date(text: Column) -> Column:
    """A document's date (D:YYYYMMDDHHmmSS and Z or +HH'mm', all but the year optional) as UTC in ISO form; null for what is none."""
    part = lambda k: F.regexp_extract(text, r"^(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:[Zz].*|([+-])(\d\d)'?(\d\d)?'?)?$", k)
    or_ = lambda k, default: F.when(part(k) == "", default).otherwise(part(k))
    known = F.concat(part(1), or_(2, "01"), or_(3, "01"), or_(4, "00"), or_(5, "00"), or_(6, "00"), or_(7, "+"), or_(8, "00"), F.lit(":"), or_(9, "00"))
    at = F.to_utc_timestamp(F.try_to_timestamp(F.when(part(1) != "", known), F.lit("yyyyMMddHHmmssXXX")), F.current_timezone())
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
