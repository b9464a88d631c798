"""Detectors over the facts of files: mail, containers, packages, sheets, slides, PDF, compound files, streams, slack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen import rules
from lumen.functions import cells as C
from lumen.functions import text as X
from lumen.operators import geometry, sequences
from lumen.operators.text import STEPS

FIELDS = ("artifact_id", "seq", "severity", "category", "location", "detail", "snippet")


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def told(rows: DataFrame, severity, category, location, detail, snippet="", seq: Column | None = None) -> DataFrame:
    """Findings from rows that have artifact_id and seq."""
    return rows.select("artifact_id", ((seq if seq is not None else F.col("seq")) * STEPS).alias("seq"), _lit(severity).alias("severity"), _lit(category).alias("category"), _lit(location).alias("location"), _lit(detail).alias("detail"), F.coalesce(_lit(snippet), F.lit("")).alias("snippet"))


def of(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.where(F.col("kind").isin(*kinds))


def listed(rows: DataFrame, by: list[str], item: Column, sep: str = "\n", most: int | None = None) -> DataFrame:
    """(by, items, count, seq): the items of a group in order, joined; at most `most` of them."""
    got = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("x")))).getField("x").alias("all"), F.min("seq").alias("seq"))
    some = F.slice("all", 1, most) if most else F.col("all")
    return got.withColumn("items", F.array_join(some, sep)).withColumn("count", F.size("all"))


def _said(*parts) -> Column:
    return F.concat(*[_lit(p) for p in parts])


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def as_found(facts: DataFrame) -> DataFrame:
    f = of(facts, "found")
    return told(f, F.col("name"), F.col("context"), F.col("location"), F.col("reasons")[0], F.col("text"))


def type_mismatch(artifacts: DataFrame, spark: SparkSession) -> DataFrame:
    """Roots whose extension does not fit what they hold: a join with the rule table."""
    fits = F.broadcast(spark.createDataFrame([(k, list(v)) for k, v in rules.EXPECTED.items()], "kind string, fits array<string>"))
    a = artifacts.where("depth = 0").withColumn("ext", C.extension(F.col("artifact_id"))).join(fits, "kind")
    a = a.where((F.col("ext") != "") & ~F.array_contains("fits", F.col("ext")))
    return told(a, "MEDIUM", "File type mismatch", "file", _said("The extension is '.", F.col("ext"), "' but the content is ", F.upper("kind"), "."))


def containers(facts: DataFrame) -> DataFrame:
    """ZIP structure: comments, duplicates, encryption, gaps; bytes before and behind files; image trailers."""
    z, e, size = of(facts, "zip"), of(facts, "zip_entry"), F.col("n")[0].cast("long")
    twice = e.groupBy("artifact_id", "location", "name").agg(F.count("*").alias("k"), F.min("seq").alias("seq")).where("k > 1")
    twice = listed(twice, ["artifact_id", "location"], F.col("name"), ", ")
    spans = of(facts, "zip_span").select("artifact_id", "location", "name", "seq", *[F.col("n")[k].cast("long").alias(c) for k, c in enumerate(("a", "z", "last"))])
    gaps = sequences.span_gaps(spans, ["artifact_id", "location"], "a", "z", "last")
    solid = of(facts, "zip_gap_bytes").select("artifact_id", "seq", F.col("n")[0].cast("long").alias("at"), "text")
    gaps = gaps.join(solid, ["artifact_id", "at"]).join(spans.select("artifact_id", F.col("z").alias("at"), "name"), ["artifact_id", "at"])
    image, extra = of(facts, "image_extra"), F.col("n")[0].cast("long")
    return union([
        told(z.where("text <> ''"), "MEDIUM", "ZIP comment", F.col("location"), _said("The archive has a comment of ", size, " bytes."), F.col("text")),
        told(of(facts, "appended"), "HIGH", "Data appended after file end", F.col("location"), _said(F.format_number(size, 0), " bytes behind ", F.col("context"), "; programs skip them."), F.col("text")),
        told(of(facts, "prepended").where("context = 'ZIP'"), "HIGH", "Data prepended before ZIP", F.col("location"), _said(size, " bytes stand before the first entry."), F.col("text")),
        told(of(facts, "prepended").where("context = 'PDF'"), "MEDIUM", "Data prepended before PDF header", F.col("location"), _said(size, " bytes stand before the header."), F.col("text")),
        told(twice, "HIGH", "Duplicate ZIP entries", F.col("location"), "A name stands more than once; programs may read different copies.", F.col("items")),
        told(e.where("text <> ''"), "MEDIUM", "ZIP entry comment", _said(F.col("location"), ": ", F.col("name")), "An entry has a comment.", F.col("text")),
        told(e.where(F.col("n")[0].cast("int").bitwiseAND(F.lit(1)) == 1), "MEDIUM", "Encrypted ZIP entry", _said(F.col("location"), ": ", F.col("name")), "The entry is encrypted."),
        told(gaps, "HIGH", "Hidden data between ZIP entries", F.col("location"), _said(F.format_number("size", 0), " bytes behind '", F.col("name"), "' belong to no entry."), F.col("text")),
        told(image, F.when((extra > 512) | F.col("hidden"), "HIGH").otherwise("MEDIUM"), "Data appended to image", F.col("location"), _said(F.format_number(extra, 0), " bytes behind the end of the ", F.col("context"), " image", F.when(F.col("hidden"), " (a ZIP archive)").otherwise(""), "."), F.col("text")),
    ])


HEADERS = ("from", "to", "reply-to", "return-path", "subject", "date")


def headers(facts: DataFrame) -> DataFrame:
    """One row a mail: artifact_id, seq and a column per key header; of repeated headers the last counts."""
    h = of(facts, "header").where(F.col("name").isin(*HEADERS, "authentication-results"))
    return h.groupBy("artifact_id").agg(F.min("seq").alias("seq"), *[F.max_by(F.when(F.col("name") == k, F.col("text")), F.when(F.col("name") == k, F.col("seq"))).alias(k) for k in (*HEADERS, "authentication-results")])


def mail(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """Headers, attachments and plain parts that say other things than the HTML part."""
    h = headers(facts)
    d = {k: C.domain(F.coalesce(F.col(k), F.lit(""))) for k in ("from", "reply-to", "return-path")}
    h = h.withColumns({"fd": d["from"], "rd": d["reply-to"], "pd": d["return-path"]})
    lines = F.concat_ws("\n", *[F.when(F.coalesce(F.length(F.col(k)), F.lit(0)) > 0, _said(F.initcap(F.lit(k)), ": ", F.col(k))) for k in HEADERS])
    fails = F.regexp_extract_all(F.coalesce(F.col("authentication-results"), F.lit("")), F.lit(r"(?i)\b((?:spf|dkim|dmarc)=(?:fail|softfail|permerror))"), F.lit(1))
    a = of(facts, "attachment")
    entry = _said(F.col("name"), " (", F.col("context"), ", ", F.format_number(F.coalesce(F.col("n")[0], F.lit(0.0)).cast("long"), 0), " bytes)", F.when(F.col("hidden"), " [hidden]").otherwise(""))
    every = listed(a, ["artifact_id", "location"], entry)
    return union([
        told(h.where(lines != ""), "INFO", "Message headers", "headers", "Key headers.", lines),
        told(h.where("fd <> '' AND rd <> '' AND fd <> rd"), "LOW", "Reply-To differs from sender", "headers", _said("Replies go to '", F.col("rd"), "', not to '", F.col("fd"), "'.")),
        told(h.where((F.col("fd") != "") & (F.col("pd") != "") & (F.col("fd") != F.col("pd")) & ~F.col("pd").endswith(F.concat(F.lit("."), "fd"))), "INFO", "Return-Path differs from sender", "headers", _said("Sent through '", F.col("pd"), "', from '", F.col("fd"), "'.")),
        told(h.where(F.size(fails) > 0), "MEDIUM", "Authentication failure", "headers", _said("The sender's authentication failed: ", F.array_join(fails, ", ")), F.col("authentication-results")),
        told(a.where(C.extension(F.col("name")).isin(*rules.RISKY_MAIL)), "HIGH", "Risky attachment type", F.col("name"), "Attachments of this type carry malware or phishing pages."),
        told(a.where("hidden"), "MEDIUM", "Hidden attachment", F.col("name"), "The attachment is marked hidden."),
        told(every, "INFO", "Attachments", F.col("location"), _said(F.col("count"), " attachments, each scanned too."), F.col("items")),
        told(plain_only(facts, pages).where("n_only >= 12 AND n_only > 0.3 * n_words"), "MEDIUM", "Plain-text part differs from HTML", "body", _said(F.col("n_only"), " words stand in the plain part only, which tools read and people do not see."), F.array_join(F.slice("told", 1, 30), "\n")),
    ])


def plain_only(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """(artifact_id, seq, n_words, n_only, told): lines of the plain part with words that the HTML part lacks."""
    plain = listed(of(facts, "mail_plain"), ["artifact_id"], F.col("text")).select("artifact_id", "seq", F.col("items").alias("plain"))
    shown = pages.where("email").groupBy("artifact_id").agg(F.array_join(F.collect_list("visible"), " ").alias("shown")).where("shown <> ''")
    both = plain.join(shown, "artifact_id").withColumn("words", C.words(F.col("plain"))).withColumn("only", F.array_except("words", C.words(F.col("shown"))))
    lines = F.filter(F.split("plain", r"\r?\n"), lambda x: F.arrays_overlap(F.regexp_extract_all(F.lower(x), F.lit("[a-z]{4,}"), F.lit(0)), F.col("only")))
    return both.select("artifact_id", "seq", F.size("words").alias("n_words"), F.size("only").alias("n_only"), lines.alias("told"))


def packages(facts: DataFrame, spark: SparkSession) -> DataFrame:
    """Relationships, orphaned parts, parts that run, metadata."""
    r, low = of(facts, "rel").where("hidden"), F.lower("text")
    links = r.where("name = 'hyperlink'")
    table = F.broadcast(spark.createDataFrame(rules.EXTERNAL, "name string, sev string, cat string, does string"))
    other = r.where("name <> 'hyperlink'").join(table, "name", "left")
    share = low.rlike(r"^(\\\\|file:|[a-z]:\\)")
    exploit = low.rlike("mhtml:|!x-usc:|ms-msdt")
    does = _said(F.coalesce("does", _said("External '", F.col("name"), "' relationship.")), F.when(share, " It names a file or network share.").otherwise(""), F.when(exploit, " Its scheme is used by exploits.").otherwise(""))
    p = of(facts, "part")
    targets = of(facts, "rel").where("NOT hidden").select("artifact_id", F.col("context").alias("location")).distinct()
    orphans = p.join(targets, ["artifact_id", "location"], "left_anti")
    size = F.format_number(F.col("n")[0].cast("long"), 0)
    meta = listed(of(facts, "meta"), ["artifact_id", "location"], _said(F.col("name"), ": ", F.col("text")))
    custom = listed(of(facts, "custom_property"), ["artifact_id", "location"], _said(F.col("name"), ": ", F.col("text")))
    ext = C.extension(F.col("location"))
    return union([
        told(links.where(low.rlike(r"^(javascript:|vbscript:|file:|\\\\|mhtml:|ms-msdt:|search-ms:|ms-officecmd:)")), "HIGH", "Dangerous hyperlink", F.col("location"), "The link uses a script, file or handler scheme.", F.col("text")),
        told(other, F.when(share | exploit, "HIGH").otherwise(F.coalesce("sev", F.lit("MEDIUM"))), F.coalesce("cat", F.lit("External reference")), F.col("location"), does, F.col("text")),
        told(listed(links, ["artifact_id"], F.col("text")).withColumn("items", F.array_join(F.array_distinct(F.slice("all", 1, 40)), "\n")), "INFO", "Hyperlinks", "package", _said(F.col("count"), " external links."), F.col("items")),
        told(orphans.where(F.lower("location").startswith("[trash]/")), "MEDIUM", "Deleted parts retained ([trash])", F.col("location"), "A part of an earlier edit is still stored."),
        told(orphans, F.when(F.col("context") == "image", "LOW").otherwise("MEDIUM"), "Orphaned part", F.col("location"), _said("A part of ", size, " bytes that nothing refers to."), F.col("text")),
        told(p.where(ext.isin(*rules.RUNNING_PARTS)), "HIGH", "Executable content in package", F.col("location"), "The package holds a file that runs."),
        told(p.where(F.lower("location").endswith("vbaproject.bin")), "HIGH", "VBA macros", F.col("location"), "The document holds a VBA macro project."),
        told(p.where(F.lower("location").contains("/embeddings/") & ~F.lower("location").endswith("vbaproject.bin")), "MEDIUM", "Embedded object", F.col("location"), _said("An object of ", size, " bytes, scanned too.")),
        told(p.where(F.lower("location").rlike(r"/activex/.*\.bin$")), "MEDIUM", "ActiveX control", F.col("location"), _said("A control of ", size, " bytes, scanned too.")),
        told(meta, "INFO", "Document metadata", F.col("location"), "Data on author and revisions.", F.col("items")),
        told(custom, "LOW", "Custom document properties", F.col("location"), _said(F.col("count"), " own properties."), F.col("items")),
    ])


def orphan_units(facts: DataFrame) -> DataFrame:
    """Texts of orphaned parts, for the text analyser."""
    targets = of(facts, "rel").where("NOT hidden").select("artifact_id", F.col("context").alias("location")).distinct()
    p = of(facts, "part").where("context = 'text' AND text <> ''").join(targets, ["artifact_id", "location"], "left_anti")
    return p.select("artifact_id", F.col("seq").alias("unit_seq"), "location", F.lit("orphaned part").alias("context"), F.lit(True).alias("hidden"), "text")


def grouped_runs(facts: DataFrame) -> DataFrame:
    """(artifact_id, location, name, reasons, text, seq): runs joined by their reasons, in order; also covered shapes'
    runs with that as a further reason."""
    runs = of(facts, "run").where("context <> 'deleted'").withColumn("z", F.when(F.col("name") == "drawing", F.col("n")[0].cast("int")))
    cover = covered_shapes(facts).select(F.col("artifact_id").alias("ca"), F.col("location").alias("page"), F.col("z").alias("cz"), "cover")
    runs = runs.join(cover, (F.col("artifact_id") == F.col("ca")) & F.col("location").startswith(F.concat("page", F.lit(" › "))) & (F.col("z") == F.col("cz")), "left")
    why = F.when(F.col("cover").isNotNull(), F.array_append("reasons", _said("covered by the opaque shape '", F.col("cover"), "'"))).otherwise(F.col("reasons"))
    runs = runs.withColumn("why", why)
    parts = F.array_sort(F.collect_list(F.struct("seq", "text"))).getField("text")
    text = F.when(F.col("name") == "odf", F.array_join(parts, " ")).otherwise(F.array_join(parts, ""))
    return runs.groupBy("artifact_id", "location", "name", F.col("why").alias("reasons")).agg(text.alias("text"), F.min("seq").alias("seq"))


def covered_shapes(facts: DataFrame) -> DataFrame:
    """(artifact_id, location, z, cover): shapes with text that a later opaque shape of the page covers whole."""
    s = of(facts, "shape").select("artifact_id", "location", "name", *[F.col("n")[k].alias(c) for k, c in enumerate(("z", "x0", "y0", "x1", "y1"))], (F.col("n")[5] > 0).alias("opaque"))
    return geometry.covered(s, ["artifact_id", "location"]).withColumn("z", F.col("z").cast("int"))


def hidden_runs(groups: DataFrame) -> DataFrame:
    """Hidden text of Word, drawings and OpenDocument, by what hides it."""
    g = groups.where(F.size("reasons") > 0)
    weak = F.forall("reasons", lambda r: r.contains("vanish") | r.contains("table style"))
    weak_odf = F.forall("reasons", lambda r: r.contains("visibility") | r.contains("zero-height"))
    styled = F.exists("reasons", lambda r: r.contains("table style"))
    severity = F.when((F.col("name") == "word") & weak, F.when(styled, "LOW").otherwise("MEDIUM")).when((F.col("name") == "odf") & weak_odf, "MEDIUM").otherwise("HIGH")
    gate = F.when(F.col("name") == "odf", F.col("text").rlike(X.WORD_CHAR + "{2}")).otherwise(F.col("text").rlike(X.WORD_CHAR))
    return told(g.where(gate), severity, "Hidden text", F.col("location"), F.array_join("reasons", "; "), F.col("text"))


def run_units(groups: DataFrame) -> DataFrame:
    """Visible and hidden texts of runs, one unit each a location."""
    g = groups.withColumn("hidden", F.size("reasons") > 0)
    out = g.groupBy("artifact_id", "location", "hidden").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "text"))).getField("text"), " ").alias("text"), F.min("seq").alias("unit_seq"))
    return out.select("artifact_id", "unit_seq", "location", F.lit("").alias("context"), "hidden", "text")


def word(facts: DataFrame, spark: SparkSession) -> DataFrame:
    gone = listed(of(facts, "run").where("context = 'deleted'"), ["artifact_id", "location"], F.col("text"), "")
    table = F.broadcast(spark.createDataFrame([(k, *x) for k, x in enumerate(rules.FIELDS)], "k int, pattern string, sev string, does string"))
    fields = of(facts, "field").crossJoin(table).where("text RLIKE pattern")  # six rules, a fixed table
    comments = listed(of(facts, "comment"), ["artifact_id", "location", "context"], F.col("text"))
    variables = listed(of(facts, "doc_variable"), ["artifact_id", "location"], F.col("text"))
    return union([
        told(gone.where(F.trim("items") != ""), "MEDIUM", "Tracked deletions retained", F.col("location"), _said(F.format_number(F.length("items"), 0), " characters of deleted text are still stored."), F.col("items")),
        told(fields, F.col("sev"), "Field code", F.col("location"), F.col("does"), F.col("text"), seq=F.col("seq")),
        told(comments, "INFO", F.col("context"), F.col("location"), _said(F.col("count"), " comments."), F.col("items")),
        told(variables, "MEDIUM", "Document variables", F.col("location"), _said(F.col("count"), " variables, which only macros and fields show."), F.col("items")),
    ])


def cells(facts: DataFrame) -> DataFrame:
    """Cells with what hides them; a column counts as hidden by a range join with the hidden columns of its sheet."""
    c = of(facts, "cell").select("artifact_id", "location", "context", "seq", "name", "text", "reasons", F.col("n")[0].cast("long").alias("row"), F.col("n")[1].cast("long").alias("col"))
    h = of(facts, "hidden_columns").select("artifact_id", "location", F.col("n")[0].cast("long").alias("lo"), F.col("n")[1].cast("long").alias("hi"))
    inside = geometry.in_ranges(c, h, ["artifact_id", "location"]).select("artifact_id", "seq", F.lit("hidden column").alias("gone"))
    c = c.join(inside, ["artifact_id", "seq"], "left")
    row_first = F.array_contains("reasons", "hidden row")
    both = F.when(F.col("gone").isNull(), F.col("reasons")).when(row_first, F.concat(F.array(F.lit("hidden row"), F.col("gone")), F.array_remove("reasons", "hidden row"))).otherwise(F.concat(F.array("gone"), "reasons"))
    part = of(facts, "cell_part").select("artifact_id", "location", "context", "seq", "name", "text", "reasons", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("col"))
    return c.withColumn("reasons", both).drop("gone").unionByName(part)


def sheets(facts: DataFrame, all_cells: DataFrame) -> DataFrame:
    hid = F.col("context").isin("hidden", "veryHidden")
    s, d, f = of(facts, "sheet"), of(facts, "defined_name"), of(facts, "formula")
    own = all_cells.where("row IS NOT NULL")
    data = listed(own.where(hid), ["artifact_id", "location", "context"], F.col("text"), " | ", 60)
    groups = listed(all_cells.where(~hid & (F.size("reasons") > 0)), ["artifact_id", "location", "reasons"], _said(F.col("name"), ": ", F.col("text")), " | ", 40)
    weak = F.forall("reasons", lambda r: r.isin("hidden row", "hidden column"))
    masked = F.exists("reasons", lambda r: r.contains("displays fixed text"))
    category = F.when(masked, "Masked cell values").when(weak, "Cells in hidden rows/columns").otherwise("Hidden cell content")
    far = listed(sequences.far_cells(own.select("artifact_id", "location", "seq", "name", "row", "col"), ["artifact_id", "location"]), ["artifact_id", "location"], F.col("name"), ", ", 30)
    names = listed(d.where("hidden AND name NOT LIKE '\\\\_xlnm.%' AND name NOT LIKE '\\\\_xlfn.%'"), ["artifact_id"], _said(F.col("name"), " = ", F.col("text")))
    password = F.col("text").rlike(r"(?i)password\s*=")
    return union([
        told(s.where("context = 'veryHidden'"), "HIGH", "Very hidden sheet", F.col("location"), "No menu can show this sheet."),
        told(s.where("context = 'hidden'"), "MEDIUM", "Hidden sheet", F.col("location"), "The sheet is hidden."),
        told(s.where("hidden"), "HIGH", "Excel 4.0 (XLM) macro sheet", F.col("location"), "An old kind of macro that malware likes.", F.col("text")),
        told(data, F.when(F.col("context") == "veryHidden", "HIGH").otherwise("MEDIUM"), "Data on hidden sheet", F.col("location"), _said(F.col("count"), " filled cells on a ", F.col("context"), " sheet."), F.col("items")),
        told(groups, F.when(weak | masked, "MEDIUM").otherwise("HIGH"), category, F.col("location"), _said(F.col("count"), " cells: ", F.array_join("reasons", "; ")), F.col("items")),
        told(far, "MEDIUM", "Data far outside main area", F.col("location"), _said(F.col("count"), " cells far away from the other data."), F.col("items")),
        told(d.where(F.lower("name").isin("_xlnm.auto_open", "auto_open", "_xlnm.auto_activate", "auto_close", "_xlnm.auto_close")), "HIGH", "Auto-run macro name", F.col("location"), "A name that starts a macro by itself.", F.col("text")),
        told(names, "LOW", "Hidden defined names", "workbook", _said(F.col("count"), " hidden names."), F.col("items")),
        told(d.where(F.col("text").rlike(r'^\s*=?\s*"') & (F.length("text") > 20)), "MEDIUM", "Text stored in defined name", F.col("location"), "A name holds text that only the name manager shows.", F.col("text")),
        told(f.where(F.col("text").rlike(r"(?i)\b(WEBSERVICE|FILTERXML)\s*\(")), "MEDIUM", "Formula fetches web content", F.col("location"), "The formula calls an address.", F.col("text")),
        told(f.where(F.col("text").rlike(r"""^\s*[=@+-]?\s*['"]?\w+\|['"]|(?i)\bcmd\|""")), "HIGH", "DDE formula", F.col("location"), "The formula can start programs.", F.col("text")),
        told(f.where(F.regexp_count("text", F.lit(r"(?i)\bCHAR\s*\(")) >= 5), "MEDIUM", "Obfuscated formula", F.col("location"), "The formula spells text by many CHAR() calls.", F.col("text")),
        told(of(facts, "connection"), F.when(password, "HIGH").otherwise("MEDIUM"), "Data connection", F.col("location"), F.when(password, "An outside connection with its password.").otherwise("An outside connection."), F.col("text")),
    ])


def cell_units(all_cells: DataFrame) -> DataFrame:
    hid = F.col("context").isin("hidden", "veryHidden") | (F.size("reasons") > 0)
    u = listed(all_cells.withColumn("h", hid), ["artifact_id", "location", "h"], F.col("text"))
    return u.select("artifact_id", F.col("seq").alias("unit_seq"), "location", F.when(F.col("h"), "hidden cells").otherwise("").alias("context"), F.col("h").alias("hidden"), F.col("items").alias("text"))


def pdf_spans(facts: DataFrame) -> DataFrame:
    """Text spans of pages with what hides them and their background."""
    names = ("page", "seqno", "x0", "y0", "x1", "y1", "size", "mode", "opacity", "r", "g", "b", "px0", "py0", "px1", "py1")
    s = of(facts, "pdf_span").select("artifact_id", "location", "seq", "text", *[F.col("n")[k].alias(c) for k, c in enumerate(names)])
    f = of(facts, "pdf_fill", "pdf_image").select("artifact_id", "location", "seq", "kind", *[F.col("n")[k].alias(c) for k, c in enumerate(("page", "seqno", "x0", "y0", "x1", "y1", "opacity", "r", "g", "b"))])
    keys = ["artifact_id", "page"]
    fills = f.where("kind = 'pdf_fill'").select(*keys, F.col("seq").alias("fill_ord"), "seqno", "x0", "y0", "x1", "y1", "opacity", F.struct("r", "g", "b").alias("rgb"))
    images = f.where("kind = 'pdf_image'").select(*keys, "seqno", "x0", "y0", "x1", "y1")
    s = geometry.background(s, fills, keys)
    at = lambda x, name: x.select("artifact_id", "seq", F.lit(True).alias(name)).distinct()
    over = geometry.held(s, fills.where("opacity >= 0.9"), keys, 1.0, later=True)
    under = geometry.held(s, images, keys, 1.0, later=True)
    on = geometry.held(s, images, keys, 2.0)
    for rows, name in ((over, "covered"), (under, "image"), (on, "on_image")):
        s = s.join(at(rows, name), ["artifact_id", "seq"], "left")
    largest = images.groupBy(*keys).agg(F.max(F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).alias("image_area"))
    s = s.join(largest, keys, "left")
    page_area = F.greatest(F.lit(1.0), (F.col("px1") - F.col("px0")) * (F.col("py1") - F.col("py0")))
    s = s.withColumn("ocr", (F.col("mode") == 3) & F.coalesce(F.col("image_area") > 0.5 * page_area, F.lit(False)))
    lum = lambda r, g, b: sum(w * F.when(v / 255 <= 0.03928, v / 255 / 12.92).otherwise(F.pow((v / 255 + 0.055) / 1.055, F.lit(2.4))) for w, v in ((0.2126, r), (0.7152, g), (0.0722, b)))
    fore = lum(F.col("r"), F.col("g"), F.col("b"))
    back = F.when(F.col("back").isNotNull(), lum(F.col("back.r"), F.col("back.g"), F.col("back.b"))).when(F.col("on_image").isNull(), F.lit(1.0))
    ratio = (F.greatest(fore, back) + 0.05) / (F.least(fore, back) + 0.05)
    outside = (F.col("x1") < F.col("px0")) | (F.col("x0") > F.col("px1")) | (F.col("y1") < F.col("py0")) | (F.col("y0") > F.col("py1"))
    why = [
        (F.col("mode") == 3, "invisible render mode (Tr 3)"),
        (F.col("opacity") < 0.1, "text is transparent"),
        (F.col("size") < 1.5, "tiny font"),
        (outside, "outside the page"),
        ((F.col("mode") != 3) & (ratio < rules.LOW_CONTRAST), "text color cannot be told from its background"),
        (F.col("covered"), "covered by a shape drawn later"),
        (F.col("image"), "covered by an image drawn later"),
    ]
    return s.withColumn("reasons", F.array_compact(F.array(*[F.when(~F.col("ocr") & cond, said) for cond, said in why])))


def pdf(facts: DataFrame, spark: SparkSession, spans: DataFrame) -> DataFrame:
    o = of(facts, "pdf_object")
    keys = F.broadcast(spark.createDataFrame([(k, *x, x[0] + "(?![A-Za-z])") for k, x in enumerate(rules.PDF_KEYS)], "k int, key string, sev string, cat string, pattern string"))
    scripts = of(facts, "pdf_js")
    acting = o.crossJoin(keys).where("text RLIKE pattern")  # eleven rules, a fixed table
    acting = acting.join(scripts.select("artifact_id").distinct().withColumn("js", F.lit(True)), "artifact_id", "left").where("js IS NULL OR cat <> 'JavaScript'")
    acting = listed(acting, ["artifact_id", "k", "key", "sev", "cat"], F.col("n")[0].cast("int").cast("string"), ", ", 12)
    nodes = o.select("artifact_id", "seq", "text", "name", F.col("n")[0].cast("long").alias("node"))
    edges = of(facts, "pdf_edge").select("artifact_id", F.col("n")[0].cast("long").alias("src"), F.col("n")[1].cast("long").alias("dst"))
    starts = of(facts, "pdf_start").select("artifact_id", F.col("n")[0].cast("long").alias("node"))
    lost = sequences.unreached(nodes.where("name = ''"), edges, starts, ["artifact_id"])
    lost = listed(lost, ["artifact_id"], F.col("node").cast("string"), ", ", 40)
    old = of(facts, "pdf_old_line").where(F.length("text") > 3).join(of(facts, "pdf_final_line").select("artifact_id", "text").distinct(), ["artifact_id", "text"], "left_anti")
    old = listed(old.groupBy("artifact_id", "text").agg(F.min("seq").alias("seq")), ["artifact_id"], F.col("text"), "\n", 60)
    flags = F.col("n")[0].cast("int")
    note, field = of(facts, "pdf_annotation").where("context = 'annotation'"), of(facts, "pdf_annotation").where("context = 'field'")
    unseen = flags.bitwiseAND(F.lit(2 | 32)) != 0
    groups = listed(spans.where(F.size("reasons") > 0), ["artifact_id", "location", "reasons"], F.col("text"), " ")
    scanned = listed(spans.where("ocr"), ["artifact_id", "location"], F.col("text"), " ")
    many = of(facts, "pdf_revisions")
    return union([
        told(acting, F.col("sev"), F.col("cat"), "document", _said("Key ", F.col("key"), " in objects ", F.col("items"), "."), seq=F.col("seq")),
        told(listed(scripts, ["artifact_id"], F.col("text")), "HIGH", "JavaScript", "document", _said(F.col("count"), " scripts."), F.col("items")),
        told(listed(of(facts, "pdf_uri"), ["artifact_id"], F.col("text")).withColumn("items", F.array_join(F.array_distinct(F.slice("all", 1, 40)), "\n")), "INFO", "Links", "document", _said(F.col("count"), " links."), F.col("items")),
        told(lost, "LOW", "Orphaned objects", "document", _said(F.col("count"), " objects that nothing leads to: ", F.col("items"))),
        told(listed(of(facts, "pdf_layer_off"), ["artifact_id"], F.col("text"), ", "), "MEDIUM", "Hidden layers", "document", _said("Layers that are off: ", F.col("items"))),
        told(groups.where(F.col("items").rlike(X.WORD_CHAR + "{2}")), "HIGH", "Hidden text", F.col("location"), F.array_join("reasons", "; "), F.col("items")),
        told(scanned, "INFO", "OCR text layer", F.col("location"), "Invisible text over a scanned image, as text recognition leaves it.", F.substring("items", 1, 300)),
        told(note.where(unseen), F.when(F.col("text") != "", "HIGH").otherwise("LOW"), "Hidden annotation", F.col("location"), "The annotation is marked not to show.", F.col("text")),
        told(field.where(unseen), "HIGH", "Hidden form field", F.col("location"), "The field is marked not to show.", F.col("text")),
        told(of(facts, "pdf_xmp").where(F.length(F.regexp_replace("text", r"\s+", "")) > 4000), "LOW", "Large XMP metadata", F.col("location"), "Much more metadata than usual."),
        told(many, "INFO", "Incremental updates", "file", _said("The file was saved ", F.col("n")[0].cast("int"), " times.")),
        told(old, "MEDIUM", "Content from earlier revision", "file", _said(F.col("count"), " lines of earlier revisions are gone from the last."), F.col("items")),
    ])


def pdf_units(facts: DataFrame, spans: DataFrame) -> DataFrame:
    u = listed(spans.withColumn("h", F.size("reasons") > 0), ["artifact_id", "location", "h", "ocr"], F.col("text"), " ")
    u = u.select("artifact_id", F.col("seq").alias("unit_seq"), "location", F.when(F.col("ocr"), "OCR layer").otherwise("").alias("context"), F.col("h").alias("hidden"), F.col("items").alias("text"))
    js = of(facts, "pdf_js", "pdf_annotation").where("text <> ''").select("artifact_id", F.col("seq").alias("unit_seq"), "location", F.col("kind").alias("context"), F.lit(True).alias("hidden"), "text")
    return u.unionByName(js)


def legacy(facts: DataFrame) -> DataFrame:
    m = of(facts, "macro")
    auto = F.array_sort(F.filter(F.array(*[F.lit(w) for w in rules.MACRO_AUTO]), lambda w: F.contains(F.lower("text"), F.lower(w))))
    risky = F.array_sort(F.slice(F.filter(F.array(*[F.lit(w) for w in rules.MACRO_RISKY]), lambda w: F.regexp_like(F.lower("text"), F.concat(F.lit(r"(?<!\w)\Q"), F.lower(w), F.lit(r"\E(?!\w)")))), 1, 25))
    iocs = F.array_sort(F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)https?://[^\s\"']+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[\w-]+\.(?:exe|dll|ps1|vbs|bat)\b"), F.lit(0))), 1, 15))
    m = m.withColumns({"auto": auto, "risky": risky, "iocs": iocs})
    detail = F.concat_ws(" | ", F.when(F.size("auto") > 0, _said("Runs by itself: ", F.array_join("auto", ", "))), F.when(F.size("risky") > 0, _said("Reaches outside: ", F.array_join("risky", ", "))), F.when(F.size("iocs") > 0, _said("Names: ", F.array_join("iocs", ", "))))
    r = of(facts, "rtf_object")
    exploit = F.col("text").rlike(r"(?i)equation\.3|package|htmlfile|ole2link|script")
    slack = of(facts, "ole_slack")
    return union([
        told(m, F.when((F.size("auto") > 0) | (F.size("risky") > 0), "HIGH").otherwise("MEDIUM"), "Macro code analysis", F.col("location"), F.when(detail == "", "The document holds macro code.").otherwise(detail), F.col("text")),
        told(r, F.when(exploit, "HIGH").otherwise("MEDIUM"), "Embedded OLE object (RTF)", F.col("location"), _said("Object of class '", F.col("text"), "'.")),
        told(slack, F.when(F.col("text") != "", "MEDIUM").otherwise("LOW"), "Data in unallocated OLE sectors", F.col("location"), _said(F.format_number(F.col("n")[0].cast("long"), 0), " bytes in sectors that belong to nothing."), F.col("text")),
    ])


def streams(ads: DataFrame) -> DataFrame:
    """Alternate data streams: rows (artifact_id, seq, stream, size, content)."""
    name = F.lower(F.regexp_replace("stream", "^:|:\\$DATA$", ""))
    text = F.decode(F.col("content"), "ISO-8859-1")
    zone = F.regexp_extract(text, r"ZoneId\s*=\s*(\d)", 1)
    where = F.create_map(*[F.lit(x) for k, v in rules.ZONES.items() for x in (str(k), v)])
    benign = name.isin(*rules.BENIGN_STREAMS) | F.exists(F.array(*[F.lit(b) for b in rules.BENIGN_BEGINNINGS]), lambda b: name.startswith(b))
    mark = ads.where(name == "zone.identifier")
    strings = F.array_join(C.printable_strings(F.col("content"), 6, 20), "\n")
    return union([
        told(mark, "INFO", "Mark of the Web", F.col("stream"), _said("The file came from zone ", F.coalesce(F.try_element_at(where, zone), F.lit("unknown")), "."), text),
        told(ads.where(benign & (name != "zone.identifier")), "INFO", "Alternate data stream", F.col("stream"), _said(F.col("size"), " bytes in a common stream.")),
        told(ads.where(~benign), "HIGH", "Hidden alternate data stream", F.col("stream"), _said(F.col("size"), " bytes that folders do not list."), strings),
    ])


def slack(artifacts: DataFrame, info: DataFrame) -> DataFrame:
    """File slack, of rows (path, status, title, message, slack): joined to roots by path; files without a row have
    no finding. Notes stay notes, NULs are clean, anything else is data."""
    s = artifacts.where("depth = 0").join(info, F.col("artifact_id") == F.col("path"))
    data = s.where("status = 'ok'").withColumn("found", C.printable_strings(F.col("slack"), 6, 30))
    latin = F.decode("slack", "ISO-8859-1")
    empty = F.length(F.regexp_replace(latin, "\\x00", "")) == 0
    magic = latin.rlike(r"PK\x03\x04|%PDF|\xD0\xCF\x11\xE0|\x89PNG|MZ\x90|Rar!|7z\xBC\xAF")
    return union([
        told(s.where("status = 'note'"), "INFO", F.col("title"), "file slack", F.col("message")),
        told(data.where(empty), "INFO", "File slack checked", "file slack", "The slack holds nothing but zeros."),
        told(data.where(~empty), F.when(magic | (F.size("found") > 5), "HIGH").otherwise("MEDIUM"), "Data in file slack", "file slack", _said(F.octet_length("slack"), " bytes behind the end of the file."), F.array_join("found", "\n")),
    ])
