"""Text analyser: findings of concealed or manipulative content in text units.

Units are rows (artifact_id, unit_seq, location, context, hidden, text). Everything is a column expression except the
folding of disguised letters, which runs on the few texts that need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.functions import text as X

FINDING = "struct<step:int,severity:string,category:string,location:string,detail:string,snippet:string>"
#: seq of a finding = unit_seq * STEPS + step
STEPS = 1000


def finding(step: int | Column, severity: str | Column, category: str, location: Column, detail: Column, snippet: Column | str = "") -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(step).cast("int").alias("step"), as_col(severity).alias("severity"), F.lit(category).alias("category"), location.alias("location"), as_col(detail).alias("detail"), F.coalesce(as_col(snippet), F.lit("")).alias("snippet"))


def _said(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def exploded(rows: DataFrame, findings: Column) -> DataFrame:
    """(artifact_id, seq, severity, category, location, detail, snippet) from an array of findings a row."""
    out = rows.select("artifact_id", "unit_seq", F.explode(findings).alias("f"))
    return out.select("artifact_id", (F.col("unit_seq") * STEPS + F.col("f.step")).alias("seq"), "f.severity", "f.category", "f.location", "f.detail", "f.snippet")


def units(df: DataFrame, artifact_id: Column, text: Column, location: Column | str = "document", hidden: bool | Column = False, context: Column | str = "", unit_seq: Column | int = 0) -> DataFrame:
    """Text units from any table. Null texts and texts of nothing but NULs are no units."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = df.select(artifact_id.cast("string").alias("artifact_id"), col(unit_seq).cast("long").alias("unit_seq"), col(location).alias("location"), col(context).alias("context"), col(hidden).alias("hidden"), text.alias("text"))
    return out.where(F.length(F.regexp_replace("text", "^\\x00+$", "")) > 0)


def character_findings(where: Column, text: Column) -> Column:
    """Findings that count special characters, for texts that have any."""
    tags, selectors, names = X.count(text, X.TAGS), X.count(text, X.SELECTORS), X.zero_width_names(text)
    n, decoded = F.size(names), X.decoded_zero_width(text)
    shy, bidi, control, private = (X.count(text, c) for c in ("\\x{AD}", X.BIDI, X.CONTROL, X.PRIVATE))
    sample = X.visible(F.substring(text, 1, 300))
    return F.array_compact(
        F.array(
            F.when(tags > 0, finding(1, "HIGH", "Unicode smuggling (tag characters)", where, _said(tags, " Unicode tag characters: models read them, people do not see them."), _said("Decoded hidden text: ", X.decoded_tags(text)))),
            F.when(selectors >= 4, finding(3, F.when(selectors >= 8, "HIGH").otherwise("MEDIUM"), "Unicode smuggling (variation selectors)", where, _said(selectors, " variation selectors, which can carry bytes unseen."), _said("Decoded bytes: ", X.decoded_selectors(text)))),
            F.when(n > 0, finding(5, F.when(decoded.isNotNull() | (n >= 16), "HIGH").when(n >= 3, "MEDIUM").otherwise("LOW"), "Invisible characters", where, _said(n, " zero-width or invisible characters: ", X.tally(names)), _said(F.coalesce(_said("Decoded as binary: ", decoded, "\n"), F.lit("")), sample))),
            F.when(shy >= 10, finding(7, "LOW", "Invisible characters", where, _said(shy, " soft hyphens, which can break words up to evade filters."))),
            F.when(bidi > 0, finding(8, "MEDIUM", "Bidirectional override", where, _said(bidi, " bidirectional controls: what is shown can differ from what is stored."), sample)),
            F.when(control >= 3, finding(9, "LOW", "Control characters", where, _said(control, " control characters that are not printed."))),
            F.when(private >= 5, finding(10, "LOW", "Private-use characters", where, _said(private, " private-use code points, which may show as nothing."))),
        )
    )


def injections(texts: DataFrame) -> DataFrame:
    """Findings in (artifact_id, unit_seq, step, location, hidden, text, odd, found): those found already, and prompt injection.

    First the text without invisible characters; only where nothing matches there, the text with its disguises
    folded: the Python function gets null for all other rows.
    """
    text = F.col("text")
    rows = X.once(texts, plain=F.when(F.col("odd"), X.strip_invisible(text)).otherwise(text))
    rows = X.once(rows, low=X.lowered(F.col("plain")))
    rows = X.once(rows, direct=X.hits(F.col("plain"), F.col("low"))).drop("plain", "low")
    rows = X.once(rows, read=X.fold(F.when((F.size("direct") == 0) & X.may_be_disguised(text, F.col("odd")), text))).drop("text")
    rows = X.once(rows, low=X.lowered(F.col("read.folded")))
    phrase = F.struct(F.lit("Letter-spaced instruction phrase").alias("what"), _said("'", F.col("read.phrase"), "' spelled out with spaces between letters").alias("around"))
    none = F.array().cast("array<struct<what:string,around:string>>")
    folded = F.concat(F.when(F.col("low").isNotNull(), X.hits(F.col("read.folded"), F.col("low"))).otherwise(none), F.when(F.col("read.phrase").isNotNull(), F.array(phrase)).otherwise(none))
    rows = X.once(rows, hits=F.when(F.size("direct") > 0, F.col("direct")).otherwise(folded))
    obfuscated = F.size("direct") == 0
    severity = F.when(F.col("hidden") | obfuscated | (F.size("hits") >= 2), "HIGH").otherwise("MEDIUM")
    what = F.array_join(F.array_distinct(F.col("hits.what")), "; ")
    detail = _said(F.when(F.col("hidden"), "HIDDEN text ").otherwise("Text "), "matches prompt-injection patterns: ", what, F.when(obfuscated, " - disguised by full-width, look-alike or spaced letters").otherwise(""))
    told = F.when(F.size("hits") > 0, F.array(finding(F.col("step"), severity, "Possible AI prompt injection", F.col("location"), detail, F.get("hits", F.lit(0))["around"])))
    return exploded(rows, F.concat(F.col("found"), F.coalesce(told, F.array().cast(f"array<{FINDING}>"))))


def analyse(units: DataFrame) -> DataFrame:
    """All findings of text units, snippets not yet clipped. Units are read once: a row goes on as its own text with what
    its characters tell, and one more row for each text decoded from it, in which injections are looked for, too."""
    text, at, none = F.col("text"), F.col("where"), F.array().cast(f"array<{FINDING}>")
    where = F.when(F.col("context") != "", F.concat("location", F.lit(" ("), "context", F.lit(")"))).otherwise(F.col("location"))
    rows = X.once(units.select("artifact_id", "unit_seq", where.alias("where"), "hidden", "text"), odd=text.rlike(X.ODD))
    rows = X.once(rows, special=F.col("odd") & text.rlike(X.SPECIAL), mixed=F.when(F.col("odd"), X.mixed_words(text)), blobs=F.when(text.rlike("[A-Za-z0-9+/]{40}"), X.base64_texts(text)))

    n = F.size("mixed")
    mixed = F.when(n > 0, F.array(finding(11, F.when(n > 2, "MEDIUM").otherwise("LOW"), "Homoglyphs (mixed scripts)", at, _said(n, " words mix letters of different scripts that look alike."), F.array_join(F.array_distinct(F.slice("mixed", 1, 15)), ", "))))
    blob = lambda t, k: F.when(t.isNotNull(), finding(13 + 2 * k, F.when(F.col("hidden"), "MEDIUM").otherwise("LOW"), "Encoded text (Base64)", at, F.lit("A Base64 run decodes to readable text."), _said("Decoded: ", t)))
    encoded = F.when(F.col("blobs").isNotNull(), F.array_compact(F.transform("blobs", blob)))
    found = F.concat(F.when(F.col("special"), character_findings(at, text)).otherwise(none), F.coalesce(mixed, none), F.coalesce(encoded, none))

    # what was decoded is text too, and hidden
    item = lambda step, location, hidden, t, odd, own: F.struct(step.cast("int").alias("step"), location.alias("location"), hidden.alias("hidden"), t.alias("text"), odd.alias("odd"), own.alias("found"))
    decoded = lambda step, name, t: item(step, _said(at, f" [decoded {name}]"), F.lit(True), t, t.rlike(X.ODD), none)
    own = item(F.lit(12), at, F.col("hidden"), text, F.col("odd"), found)
    smuggled = F.array(
        decoded(F.lit(2), "tag chars", F.when(X.count(text, X.TAGS) > 0, X.decoded_tags(text))),
        decoded(F.lit(4), "variation selectors", F.when(X.count(text, X.SELECTORS) >= 4, X.decoded_selectors(text))),
        decoded(F.lit(6), "zero-width", F.when(F.size(X.zero_width_names(text)) > 0, X.decoded_zero_width(text))),
    )
    unpacked = F.transform("blobs", lambda t, k: decoded(14 + 2 * k, "base64", t))
    kind = "array<struct<step:int,location:string,hidden:boolean,text:string,odd:boolean,found:array<" + FINDING + ">>>"
    items = F.concat(F.array(own).cast(kind), F.when(F.col("special"), smuggled.cast(kind)).otherwise(F.array().cast(kind)), F.when(F.col("blobs").isNotNull(), unpacked.cast(kind)).otherwise(F.array().cast(kind)))
    rows = rows.select("artifact_id", "unit_seq", F.explode(items).alias("i")).select("artifact_id", "unit_seq", "i.*")
    return injections(rows.where("text IS NOT NULL AND text <> ''"))
