"""Line detectors of plain text: whitespace codes, pushed-away text, gaps, Markdown and CSV tricks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.operators.text import exploded, finding

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
BLANK = r"(?U)^[\s\x1C-\x1F]*$"
FAR = r"(?s)\S([ \t]{150,})(\S.*)"
INDENT = r"(?s)^([ \t]{200,})(\S.*)"
GAP, AFTER = 40, 21


def lines_of(text: Column) -> Column:
    """Lines of a text, as an array; the end of the last line makes no further one."""
    parts = F.split(text, LINE_END, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def blank_gaps(docs: DataFrame, least: int = GAP, after: int = AFTER) -> DataFrame:
    """(artifact_id, n, start, blanks, rest): lines that follow a run of at least `least` blank ones: islands of the
    running count of other lines. Only texts that can hold such a run are split into rows."""
    may = docs.where(F.regexp_count("text", F.lit(LINE_END)) >= least)
    rows = may.select("artifact_id", "lines", F.posexplode("lines").alias("n", "line")).withColumn("blank", F.col("line").rlike(BLANK))
    w = Window.partitionBy("artifact_id").orderBy("n")
    rows = rows.withColumn("island", F.sum(F.when(F.col("blank"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("blanks", F.count_if("blank").over(Window.partitionBy("artifact_id", "island")))
    rows = rows.where(~F.col("blank") & (F.col("blanks") >= least))
    return rows.select("artifact_id", (F.col("n") + 1).alias("n"), (F.col("n") + 1 - F.col("blanks")).alias("start"), "blanks", F.array_join(F.slice("lines", F.col("n") + 1, F.lit(after)), "\n").alias("rest"))


def prepared(docs: DataFrame, artifact_id: Column, text: Column, ext: Column | None = None, encoding: Column | None = None) -> DataFrame:
    col = lambda x, otherwise: (x if x is not None else F.lit(otherwise))
    out = docs.select(artifact_id.cast("string").alias("artifact_id"), text.alias("text"), col(ext, "txt").alias("ext"), col(encoding, "utf-8").alias("encoding")).where("text IS NOT NULL")
    return out.withColumn("lines", lines_of(F.col("text"))).withColumn("unit_seq", F.lit(0).cast("long"))


def far_lines(docs: DataFrame) -> DataFrame:
    """(artifact_id, n, blanks, rest): text behind many blanks in its line."""
    far = docs.where(F.col("text").rlike(r"[ \t]{150}")).select("artifact_id", F.posexplode("lines").alias("n", "line"))
    pattern = F.when(F.col("line").rlike(FAR), F.struct(F.regexp_extract("line", FAR, 1).alias("b"), F.regexp_extract("line", FAR, 2).alias("r"))).when(F.col("line").rlike(INDENT), F.struct(F.regexp_extract("line", INDENT, 1).alias("b"), F.regexp_extract("line", INDENT, 2).alias("r")))
    far = far.withColumn("m", pattern).where("m IS NOT NULL")
    return far.select("artifact_id", (F.col("n") + 1).alias("n"), F.length("m.b").alias("blanks"), F.col("m.r").alias("rest"))


def line_counts(docs: DataFrame) -> DataFrame:
    """docs with trailing, mixed, coded (arrays of lines) and filled (a number)."""
    solid = lambda x: ~x.rlike(BLANK)
    trailing = F.filter("lines", lambda x: x.rlike(r"[ \t]$") & solid(x))
    coded = F.filter("lines", lambda x: (x != "") & ~solid(x) & F.contains(x, F.lit(" ")) & F.contains(x, F.lit("\t")))
    out = docs.withColumns({"trailing": trailing, "coded": coded, "filled": F.size(F.filter("lines", solid))})
    return out.withColumn("mixed", F.filter("trailing", lambda x: x.rlike(r"(?: \t|\t )[ \t]*$")))


def findings(docs: DataFrame) -> DataFrame:
    """Findings of prepared() texts."""
    file = F.lit("file")
    size = lambda c, *more: F.concat(F.size(c), *[m if isinstance(m, Column) else F.lit(m) for m in more])
    nuls = F.regexp_count("text", F.lit("\\x00"))
    n = F.size("trailing")
    snow = (n >= 5) & ((F.size("mixed") >= 3) | (n > 0.4 * F.greatest(F.lit(1), F.col("filled"))))
    tails = F.array_join(F.transform(F.slice("trailing", 1, 10), lambda x: F.concat(F.lit("'"), F.replace(F.substring(x, -40, 40), F.lit("\t"), F.lit("\\t")), F.lit("'"))), "\n")
    comments = F.concat(F.regexp_extract_all("text", F.lit(r"(?s)<!--(.*?)-->"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?m)^\[[^\]\n]*\]:\s*#\s*\((.*)\)\s*$"), F.lit(1)))
    cells = F.regexp_extract_all("text", F.lit(r"""(?m)(?:^|[,;\t])\s*"?([=+\-@][A-Za-z]{2,}[^,\n]*)"""), F.lit(1))
    dde = F.filter(cells, lambda c: c.rlike(r"""(?i)\w+\|['"]|cmd\||HYPERLINK\(|WEBSERVICE\("""))
    csv = F.col("ext").isin("csv", "tsv")
    own = F.array_compact(
        F.array(
            F.when((nuls > 0) & ~F.col("encoding").startswith("utf-16"), finding(0, "MEDIUM", "Null bytes in text", file, F.concat(nuls, F.lit(" NUL characters, at which some editors stop.")))),
            F.when(snow, finding(1, "MEDIUM", "Whitespace steganography pattern", file, size("trailing", " lines end in blanks (", F.size("mixed"), " mix spaces and tabs), as whitespace codes do."), tails)),
            F.when(F.size("coded") >= 8, finding(2, "MEDIUM", "Whitespace-only encoded lines", file, size("coded", " lines hold nothing but mixed spaces and tabs."))),
            F.when((F.col("ext") == "md") & (F.size(comments) > 0), finding(900, "LOW", "Markdown comments", file, size(comments, " comments that are not rendered but read by tools."), F.array_join(comments, "\n"))),
            F.when(csv & (F.size(dde) > 0), finding(901, "HIGH", "CSV formula injection", file, "Cells run as formulas or commands when opened.", F.array_join(F.slice(dde, 1, 20), "\n"))),
            F.when(csv & (F.size(dde) == 0) & (F.size(cells) > 0), finding(902, "LOW", "CSV formulas", file, size(cells, " cells begin like a formula."), F.array_join(F.slice(cells, 1, 10), "\n"))),
        )
    )
    line = lambda: F.concat(F.lit("line "), "n")
    far = far_lines(docs).withColumn("unit_seq", F.col("n").cast("long"))
    far = exploded(far, F.array(finding(0, "MEDIUM", "Text pushed off-screen", line(), F.concat(F.lit("Text behind "), "blanks", F.lit(" blanks, far beyond the visible edge.")), F.col("rest"))))
    gaps = blank_gaps(docs).withColumn("unit_seq", F.col("n").cast("long"))
    gaps = exploded(gaps, F.array(finding(1, "MEDIUM", "Content after large blank gap", line(), F.concat("blanks", F.lit(" blank lines (from line "), "start", F.lit(") stand before this.")), F.col("rest"))))
    return exploded(line_counts(docs), own).unionByName(far).unionByName(gaps)


def text_units(docs: DataFrame) -> DataFrame:
    """Texts that the line detectors found, hidden ones, and the whole text of what is not HTML."""
    line = F.concat(F.lit("line "), "n").alias("location")
    out = [x.select("artifact_id", F.col("n").cast("long").alias("unit_seq"), line, F.lit("").alias("context"), F.lit(True).alias("hidden"), F.col("rest").alias("text")) for x in (far_lines(docs), blank_gaps(docs))]
    whole = docs.select("artifact_id", F.lit(1 << 40).alias("unit_seq"), F.lit("document").alias("location"), F.lit("").alias("context"), F.lit(False).alias("hidden"), "text")
    return out[0].unionByName(out[1]).unionByName(whole)


def is_html(text: Column, ext: Column) -> Column:
    return ext.isin("html", "htm", "xhtml", "svg") | F.substring(text, 1, 3000).rlike("(?i)<html|<body|<div")
