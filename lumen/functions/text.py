"""Column functions on text: invisible characters, decoders, snippets. All count code points."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen import rules


def char_class(points) -> str:
    """The inside of a Java character class for code points, runs joined."""
    points, out = sorted(points), []
    k = 0
    while k < len(points):
        j = k
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[k]:X}}}" + (f"-\\x{{{points[j]:X}}}" if j > k else ""))
        k = j + 1
    return "".join(out)


TAGS, SELECTORS = r"\x{E0000}-\x{E007F}", r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
ZERO = char_class(rules.ZERO_WIDTH)
ZERO_NO_SHY = char_class(x for x in rules.ZERO_WIDTH if x != 0xAD)
BIDI = char_class(rules.BIDI)
CONTROL = r"\x00-\x08\x0E-\x1F"
PRIVATE = r"\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}"
#: Any character that some character detector counts; most texts have none, and are done with one test.
SPECIAL = f"[{TAGS}{SELECTORS}{ZERO}{BIDI}{CONTROL}{PRIVATE}]"
INVISIBLE = f"[{ZERO}{BIDI}\\x{{E0000}}-\\x{{E01EF}}\\x{{FE00}}-\\x{{FE0F}}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
#: Characters beyond ASCII, of Latin scripts and their punctuation, that no detector counts and folding leaves as they are.
COMMON = char_class(c for c in [*range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0)] if unicodedata.is_normalized("NFKC", chr(c)) and not unicodedata.combining(chr(c)) and c not in rules.ZERO_WIDTH and c not in rules.BIDI)
#: What is neither that nor plain ASCII: a text without it has no special character, one script, and nothing to fold but spaced letters.
#: The inner class is tried last: Java goes through all ranges of a class in turn, and most characters are in the first.
ODD = f"[^\\x20-\\x7F\\x09-\\x0D\\xC0-\\xFF[{COMMON}]]"


def count(text: Column, inside: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{inside}]"))


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def clip(text: Column, most: int = rules.CLIP) -> Column:
    over = F.length(text) - most
    return F.when(text.isNull(), "").when(over <= 0, text).otherwise(F.concat(F.substring(text, 1, most), F.lit(" … [+"), over, F.lit(" chars]")))


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def _hex(c: Column, width: int) -> Column:
    code = F.hex(F.ascii(c))
    return F.lpad(code, F.greatest(F.lit(width), F.length(code)), F.lit("0"))


def visible(text: Column) -> Column:
    """Text with invisible and control characters written as ⟨U+…⟩ and ⟨0x…⟩. What stands between two of them stays in one piece."""
    marks, codes = f"{TAGS}{SELECTORS}{ZERO}{BIDI}", r"\x00-\x08\x0B-\x1F"
    shown = lambda c: F.when(F.length(c) > 1, c).when(c.rlike(f"[{marks}]"), F.concat(F.lit("⟨U+"), _hex(c, 4), F.lit("⟩"))).when(c.rlike(f"[{codes}]"), F.concat(F.lit("⟨0x"), _hex(c, 2), F.lit("⟩"))).otherwise(c)
    pieces = extract(text, f"[\\x20-\\x7F\\x09\\x0A\\xC0-\\xFF[^{marks}{codes}]]++|[{marks}{codes}]")  # ASCII first, as in ODD
    return F.array_join(F.transform(pieces, shown), "")


def decoded_tags(text: Column) -> Column:
    return F.array_join(F.transform(extract(text, r"[\x{E0020}-\x{E007E}]"), lambda c: F.char(F.ascii(c) - 0xE0000)), "")


def _utf8(data: Column) -> Column:
    """Bytes as text, or null if they are not UTF-8."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))


def decoded_selectors(text: Column) -> Column:
    """Variation selectors as the bytes they stand for: as text if that is UTF-8, else as hex digits."""
    value = lambda c: F.when(F.ascii(c) < 0xE0100, F.ascii(c) - 0xFE00).otherwise(F.ascii(c) - 0xE0100 + 16)
    digits = F.array_join(F.transform(extract(text, f"[{SELECTORS}]"), lambda c: F.lpad(F.hex(value(c)), 2, "0")), "")
    return F.coalesce(_utf8(F.unhex(digits)), F.lower(digits))


def printable_share(text: Column, also: str = "") -> Column:
    good = F.regexp_count(text, F.lit(r"[^\p{C}\p{Z}]|[\x20" + also + "]"))
    return good / F.greatest(F.length(text), F.lit(1))


def decoded_zero_width(text: Column) -> Column:
    """Two kinds of zero-width characters read as bits, either way round; null if that is no readable text."""
    marks = extract(text, r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]")
    kinds = F.array_sort(F.array_distinct(marks))

    def read(zero: int, one: int) -> Column:
        bits = F.array_join(F.transform(F.filter(marks, lambda c: c.isin(F.get(kinds, F.lit(0)), F.get(kinds, F.lit(1)))), lambda c: F.when(c == F.get(kinds, F.lit(zero)), "0").otherwise("1")), "")
        size = F.floor(F.length(bits) / 8).cast("int")
        data = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lpad(F.conv(F.substring(bits, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
        got = _utf8(F.unhex(F.array_join(data, "")))
        return F.when((size > 0) & (F.length(got) > 0) & (printable_share(got) > 0.9), got)

    return F.when((F.size(marks) >= 16) & (F.size(kinds) >= 2), F.coalesce(read(0, 1), read(1, 0)))


def zero_width_names(text: Column) -> Column:
    """Names of the zero-width characters in order, a leading byte order mark and soft hyphens left out."""
    names = F.create_map(*[F.lit(x) for point, name in rules.ZERO_WIDTH.items() if point != 0xAD for x in (chr(point), name)])
    return F.transform(extract(F.regexp_replace(text, r"\A\x{FEFF}", ""), f"[{ZERO_NO_SHY}]"), lambda c: F.element_at(names, c))


def tally(names: Column) -> Column:
    """'NAME xN' of each name in order of first appearance."""
    each = F.transform(F.array_distinct(names), lambda n: F.concat(n, F.lit(" x"), F.size(F.filter(names, lambda m: m == n))))
    return F.array_join(each, ", ")


def script_count(word: Column) -> Column:
    """How many of the told-apart scripts a word has letters of; compatibility forms of Latin belong to none."""
    odd = {"Latin": r"ªº\x{212A}\x{212B}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{2160}-\x{2188}ʰ-ʸˠ-ˤᴬ-ᵜ", "Greek": r"\x{2126}"}
    has = [F.when(word.rlike(f"[\\p{{Is{s}}}&&\\p{{L}}" + (f"&&[^{odd[s]}]" if s in odd else "") + "]"), 1).otherwise(0) for s in rules.SCRIPTS]
    return sum(has[1:], has[0])


def mixed_words(text: Column) -> Column:
    other = "".join(f"\\p{{Is{s}}}" for s in rules.SCRIPTS[1:])
    words = F.filter(extract(text, WORD_CHAR + "{3,}"), lambda w: script_count(w) > 1)
    return F.when(text.rlike(f"[{other}]"), words).otherwise(F.array().cast("array<string>"))


def base64_runs(text: Column) -> Column:
    """All Base64 runs of 40 and more characters, with their padding."""
    return extract(text, r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40,}+={0,2}(?![A-Za-z0-9+/=])")


def base64_text(run: Column) -> Column:
    """Readable text that a Base64 run decodes to, padded or not; null if there is none."""
    bare = F.regexp_replace(run, "=+$", "")
    size = F.length(bare)
    padded = F.rpad(bare, size + F.pmod(-size, F.lit(4)), F.lit("="))
    got = _utf8(F.try_to_binary(padded, F.lit("base64")))
    return F.when((F.pmod(size, F.lit(4)) != 1) & (F.length(got) >= 12) & (printable_share(got, r"\r\n\t") > 0.95), got)


def base64_texts(text: Column) -> Column:
    """What base64_text() reads in each of the base64_runs()."""
    return F.transform(base64_runs(text), base64_text)


def java(pattern: str) -> str:
    """A rule's pattern under Unicode, ignoring case, with the dot matching line ends."""
    return "(?isU)" + pattern


def context(text: Column, pattern: str, before: int = 80, after: int = 120) -> Column:
    """The first match with what stands around it. The start is the length of the text before, in code points."""
    around = F.split(text, java(pattern), 2)  # one search: what is not before and not behind is the match
    begin = F.length(F.get(around, F.lit(0)))
    a = F.greatest(begin - before, F.lit(0))
    z = F.length(text) - F.length(F.get(around, F.lit(1))) + after
    return F.substring(text, a + 1, z - a)


#: Letters that Unicode folds to s and k stand for them here, too.
_STEMS = "(?i)" + rules.INJECTION_STEMS.replace("s", "[sſ]").replace("k", "[k\u212a]")


def once(df: DataFrame, **values: Column) -> DataFrame:
    """df with more columns, each computed once a row: explode() of a one-element array makes a plain column of it, that
    filters and projections above read and do not compute again."""
    for name, value in values.items():
        df = df.select(*df.columns, F.explode(F.array(value)).alias(name))
    return df


def lowered(text: Column) -> Column:
    """Text in lower case, with a plain letter for each that patterns take for one: what INJECTION_NEEDS is looked for in."""
    low = F.lower(text)
    for c, plain in (("ſ", "s"), ("ı", "i"), ("i\u0307", "i")):
        low = F.replace(low, F.lit(c), F.lit(plain))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(low)


def matches(text: Column, low: Column, k: int) -> Column:
    """Whether pattern k of INJECTION matches; low is lowered(text)."""
    needs = [reduce(or_, [F.contains(low, F.lit(w)) for w in words]) for words in rules.INJECTION_NEEDS[k]]
    return reduce(and_, needs) & text.rlike(java(rules.INJECTION[k][0]))


def hits(text: Column, low: Column) -> Column:
    """(description, context) of each pattern of INJECTION that matches, in their order; low is lowered(text)."""
    each = F.array_compact(F.array(*[F.when(matches(text, low, k), F.struct(F.lit(d).alias("what"), context(text, p).alias("around"))) for k, (p, d) in enumerate(rules.INJECTION)]))
    dotless = F.contains(text, F.lit("ı")) | F.contains(text, F.lit("İ"))  # these patterns take them for an i, the stems do not
    return F.when(~dotless | text.rlike(_STEMS), each).otherwise(F.array().cast("array<struct<what:string,around:string>>"))


#: A word of letters set apart by single marks; a longer run that may spell a phrase. Possessive, so no input is too deep.
_SPACED = r"(?<!\w)(?:\w[ .\-_·*]){3,}+\w(?!\w)|(?<!\w)\w(?:[\s.\-_·*]{1,3}+\w(?!\w)){7,}+"


#: What such letters need, in ASCII and in a text of COMMON characters: found faster.
_NEAR = r"[\s.\-_*]\w[\s.\-_*]{1,3}\w[\s.\-_*]"
_APART = r"[\s\x1C-\x1F.\-_·*]" + WORD_CHAR + r"[\s\x1C-\x1F.\-_·*]{1,3}" + WORD_CHAR + r"[\s\x1C-\x1F.\-_·*]"


def may_be_disguised(text: Column, odd: Column) -> Column:
    """False for texts that folding leaves as they are: no letter spacing, and nothing ODD beyond ASCII; odd is whether
    the text has a character that is ODD."""
    ascii = F.length(text) == F.octet_length(text)
    return F.when(ascii, text.rlike(_NEAR) & text.rlike(_SPACED)).otherwise(odd | text.rlike(_APART))


#: Bytes of text that are folded at once.
SLICE = 1 << 20


@F.arrow_udf(T.StructType([T.StructField("folded", T.StringType()), T.StructField("phrase", T.StringType())]))
def fold(texts: pa.Array) -> pa.Array:
    """Text as a model reads it: invisibles gone, compatibility and look-alike letters made plain, spaced letters joined,
    or null if that is the text itself; and the first listed phrase that a letter-spaced run spells. NFKC has no built-in
    function."""
    import re

    gone = re.compile("[%s]" % "".join(map(re.escape, [*map(chr, rules.ZERO_WIDTH), *map(chr, rules.BIDI)])) + "|[\U000e0000-\U000e01ef︀-️]")
    plain = str.maketrans(rules.CONFUSABLE_FROM, rules.CONFUSABLE_TO)
    mark = r"[ .\-_·*]"
    word, run = re.compile(rf"(?<!\w)(?:\w{mark}){{3,}}\w(?!\w)"), re.compile(r"(?<!\w)\w(?:[\s.\-_·*]{1,3}\w(?!\w)){7,}")
    kind = pa.struct([("folded", pa.string()), ("phrase", pa.string())])
    rows, held, done = [], 0, []
    for value in texts:
        text = value.as_py()
        if text is None:
            rows.append({"folded": None, "phrase": None})
        else:
            made = unicodedata.normalize("NFKC", gone.sub("", text)).translate(plain)
            spelled = (p for r in run.findall(made) for p in rules.SQUASHED if p in re.sub(r"[\W_]", "", r).lower())
            joined = word.sub(lambda m: re.sub(mark, "", m.group()), made)
            rows.append({"folded": None if joined == text else joined, "phrase": next(spelled, None)})
            held += len(text)
        if held >= SLICE:  # strings and their folded copies are held for a slice only, as Arrow for the others
            done.append(pa.array(rows, kind))
            rows, held = [], 0
    return pa.concat_arrays([*done, pa.array(rows, kind)])
