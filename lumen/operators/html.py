"""HTML detectors: column expressions over the facts of pages, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.functions.text import WORD_CHAR
from lumen.operators.text import FINDING, exploded, finding

#: Facts that can start a link's shown domain.
SHOWN = r"(?:https?://)?([a-z0-9-]+(?:\.[a-z0-9-]+)+)"


def _joined(items: Column) -> Column:
    return F.array_join(items, "\n")


def _when(condition: Column, *found: Column) -> Column:
    return F.when(condition, F.array(*found)).otherwise(F.array().cast(f"array<{FINDING}>"))


def host(href: Column) -> Column:
    """The host of a link in lower case; links without a scheme are taken as http."""
    full = F.when(F.contains(href, F.lit("://")), href).otherwise(F.concat(F.lit("http://"), href))
    rest = F.regexp_extract(full, r"(?s)^[^:/?#]*://([^/?#]*)", 1)
    return F.lower(F.regexp_extract(rest, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def findings(pages: DataFrame, at: Column | str = "document", email: Column | bool = False, base: Column | int = 0) -> DataFrame:
    """Findings of pages, from read_html()."""
    mail = email if isinstance(email, Column) else F.lit(email)
    loc = at if isinstance(at, Column) else F.lit(at)

    def hidden(x: Column, k: Column) -> Column:
        pre = mail & (F.length(x["text"]) <= 160) & F.exists(x["reasons"], lambda r: r.rlike("display:none|mso-hide|max-height"))
        note = F.when(pre, " (short hidden text in mail is often a harmless preheader)").otherwise("")
        return finding(k, F.when(pre | (F.length(x["text"]) < 40), "MEDIUM").otherwise("HIGH"), "Hidden HTML text", loc, F.concat(F.lit("Text hidden by: "), F.array_join(x["reasons"], "; "), note), x["text"])

    said = F.filter("hidden", lambda x: x["text"].rlike(WORD_CHAR + "{2}"))
    comments, inputs = _joined(F.col("comments")), F.col("inputs")
    remote = F.transform(F.filter("images", lambda i: F.lower(i["src"]).rlike("^(https?:)?//")), lambda i: i["src"])
    count = lambda c, words: F.concat(F.size(c), F.lit(words))

    def pixel(i: Column) -> Column:
        return F.lower(i["src"]).rlike("^(https?:)?//") & (((i["width"] <= 2) & (i["height"] <= 2)) | (F.size(i["reasons"]) > 0))

    def link(x: Column) -> Column:
        shown, real = F.regexp_extract(F.lower(x["text"]), SHOWN, 1), host(x["href"])
        return F.struct(x["href"].alias("href"), x["text"].alias("text"), shown.alias("shown"), real.alias("real"))

    links = F.transform("links", link)
    deceptive = F.filter(links, lambda x: (x["shown"] != "") & (x["real"] != "") & F.lower(x["href"]).rlike("^(http|//)") & ~x["real"].endswith(x["shown"]) & ~x["shown"].endswith(x["real"]))
    dangerous = F.filter("links", lambda x: F.lower(x["href"]).rlike(r"^(javascript:|vbscript:|file:|\\\\)"))
    large = F.filter("images", lambda i: F.lower(i["src"]).startswith("data:") & (F.length(i["src"]) > 200_000))

    found = F.concat(
        F.transform(said, hidden),
        _when(comments.rlike(r"[A-Za-z]{3,}.*\s+[A-Za-z]{3,}"), finding(200, "LOW", "HTML comments", loc, count("comments", " HTML comments: not shown, but read by tools that take raw HTML."), comments)),
        _when(F.size(inputs) > 0, finding(201, "MEDIUM", "Hidden form fields", loc, count("inputs", " hidden input fields with values."), _joined(inputs))),
        _when(F.col("scripts") > 0, finding(202, F.when(mail, "HIGH").otherwise("MEDIUM"), "Script in HTML", loc, F.concat("scripts", F.lit(" <script> elements.")))),
        _when((F.col("forms") > 0) & mail, finding(203, "MEDIUM", "Form in email", loc, "The mail holds a form, as phishing for credentials does.")),
        F.transform(F.filter("images", pixel), lambda i, k: finding(k + 210, "MEDIUM", "Tracking pixel", loc, "Tiny or hidden remote image, as is used to see that a message was opened.", i["src"])),
        F.transform(large, lambda i, k: finding(k + 400, "LOW", "Large inline image", loc, F.concat(F.lit("Inline image of "), F.format_number(F.length(i["src"]), 0), F.lit(" characters.")))),
        _when(F.size(remote) > 0, finding(500, "INFO", "Remote images", loc, F.concat(F.size(remote), F.lit(" images are loaded from the internet.")), _joined(F.array_distinct(F.slice(remote, 1, 20))))),
        F.transform(deceptive, lambda x, k: finding(k + 510, "MEDIUM", "Deceptive link", loc, F.concat(F.lit("The link shows '"), x["shown"], F.lit("' but leads to '"), x["real"], F.lit("'.")), F.concat(F.lit("text: "), x["text"], F.lit("\nhref: "), x["href"]))),
        F.transform(dangerous, lambda x, k: finding(k + 750, "HIGH", "Dangerous link", loc, "The link uses a script, file or network-share scheme.", x["href"])),
    )
    return exploded(pages.withColumn("unit_seq", (base if isinstance(base, Column) else F.lit(base)).cast("long")), found)


def text_units(pages: DataFrame, at: Column | str = "document", base: Column | int = 0) -> DataFrame:
    """Texts of pages for the text analyser: hidden ones first, the visible text last."""
    hidden = _joined(F.transform(F.filter("hidden", lambda x: x["text"].rlike(WORD_CHAR + "{2}")), lambda x: x["text"]))
    comments = _joined(F.col("comments"))
    comments = F.when(comments.rlike(r"[A-Za-z]{3,}.*\s+[A-Za-z]{3,}"), comments)
    unit = lambda k, context, hid, text: F.struct(F.lit(k).alias("k") if isinstance(k, int) else k.alias("k"), F.lit(context).alias("context"), F.lit(hid).alias("hidden"), text.alias("text"))
    fixed = F.array(unit(1, "hidden HTML", True, hidden), unit(2, "HTML comment", True, comments), unit(3, "hidden input", True, _joined(F.col("inputs"))), unit(4, "meta tags", True, _joined(F.col("meta"))), unit(5000, "", False, F.col("visible")))
    alts = F.transform(F.filter("images", lambda i: i["alt"] != ""), lambda i, k: unit(k + 5, "image alt text", True, i["alt"]))
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = pages.select("artifact_id", col(at).alias("location"), col(base).alias("base"), F.explode(F.concat(fixed, alts)).alias("u")).where("u.text <> ''")
    return out.select("artifact_id", (F.col("u.k") + F.col("base")).cast("long").alias("unit_seq"), "location", "u.context", "u.hidden", "u.text")
