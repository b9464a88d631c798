"""Column functions on spreadsheet references, number formats, mail addresses and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_index(letters: Column) -> Column:
    """A is 1, Z 26, AA 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def col_letters(n: Column) -> Column:
    """The other way round, for columns up to three letters."""
    letter = lambda k: F.char(65 + F.pmod(k, F.lit(26)))
    a, b = n - 1, F.floor((n - 1) / 26) - 1
    c = F.floor(b / 26) - 1
    return F.concat(F.when(c >= 0, letter(c)).otherwise(""), F.when(b >= 0, letter(b)).otherwise(""), letter(a))


def masks(code: Column) -> Column:
    """Whether a number format shows nothing: its sections, quoted and escaped parts set apart, are all empty."""
    bare = F.regexp_replace(F.regexp_replace(code, r'"([^"]*)"', "$1x"), r"\\.", "x")
    bare = F.regexp_replace(bare, r'"x', "")
    return F.contains(bare, F.lit(";")) & (F.size(F.split(bare, ";", -1)) >= 3) & F.forall(F.split(bare, ";", -1), lambda s: F.regexp_replace(s, r"\[[^\]]*\]|\s", "") == "")


def domain(address: Column) -> Column:
    """The domain of a mail address, empty if it has none."""
    inner = F.when(address.rlike("<[^>]*>"), F.regexp_extract(address, "<([^>]*)>", 1)).otherwise(F.trim(address))
    return F.when(F.contains(inner, F.lit("@")), F.lower(F.trim(F.substring_index(inner, "@", -1)))).otherwise("")


def extension(name: Column) -> Column:
    """Lower-case extension without the dot, empty if there is none or the name begins with its only dot."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^.*[^.].*?\.([^.]*)$|^[^.]+\.([^.]*)$", 1))


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))


def printable_strings(content: Column, least: int = 6, limit: int = 40) -> Column:
    """Runs of printable ASCII, then of such characters as UTF-16LE, at most limit of the former and 2 * limit in all."""
    latin = F.decode(content, "ISO-8859-1")
    plain = F.slice(F.regexp_extract_all(latin, F.lit(r"[\x20-\x7e\t\r\n]{%d,}+" % least), F.lit(0)), 1, limit)
    wide = F.regexp_extract_all(latin, F.lit(r"(?:[\x20-\x7e]\x00){%d,}+" % least), F.lit(0))
    wide = F.transform(wide, lambda s: F.regexp_replace(s, "\\x00", ""))
    return F.slice(F.concat(plain, wide), 1, 2 * limit)


def image_trailer(content: Column) -> Column:
    """(kind, extra) of what stands behind an image's end, null if it is not an image or nothing counts there."""
    latin = F.decode(content, "ISO-8859-1")
    behind = lambda mark, more: F.when(F.contains(latin, F.lit(mark)), F.substring(F.substring_index(latin, mark, -1), more + 1, 2_000_000_000))
    kind = F.when(latin.startswith("\x89PNG\r\n\x1a\n"), "PNG").when(latin.startswith("\xff\xd8\xff"), "JPEG").when(latin.rlike(r"\AGIF8[79]a"), "GIF")
    extra = F.when(kind == "PNG", behind("IEND", 4)).when(kind == "JPEG", behind("\xff\xd9", 0)).when(kind == "GIF", behind("\x3b", 0))
    solid = F.length(F.regexp_replace(extra, r"\A\x00+|\x00+\z", "")) > 16
    return F.when(solid, F.struct(kind.alias("kind"), F.encode(extra, "ISO-8859-1").alias("extra")))
