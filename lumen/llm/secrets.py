"""Secret scans: fixed patterns, and character Markov models of random against ordinary strings. DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed patterns of the base scan, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # a run that begins with AKIA is taken whole, so 16 more make the 20
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"  # runs are maximal, so shorter ones can be left out at once
#: Strings that the Markov models judge: maximal runs of these characters, at least so long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
LONG = 12
TOKEN = rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{LONG},}}+"
KINDS = ("assign", "access", "hex", "markov")
SIDE = len(ALPHABET) + 1
#: Matches of one text that are appended to one array.
BLOCK = 256


def labelled_samples(spark: SparkSession, docs: DataFrame | None = None, text_col: str = "text", strings: int = 3000, words: int = 20_000) -> DataFrame:
    """(token, secret): `strings` seeded random strings of four alphabets, and ordinary identifiers.

    Ordinary ones are separators repeated, numbers of 6 to 20 digits, and up to `words` of the words of docs that are letters only, alone and
    joined as identifiers are; those with the smallest hashes are taken. Both numbers bound the sample.
    """
    i = F.col("id")
    digest = [F.sha2((i * 7 + k).cast("string"), 256) for k in range(3)]
    b64 = F.base64(F.unhex(digest[0]))
    kinds = [F.translate(b64, "+/=", ""), b64, F.substring(digest[1], 1, 40), F.substring(F.upper(F.conv(F.substring(digest[2], 1, 15), 16, 36)), 1, 20)]
    random = spark.range(strings).select(F.explode(F.array(*kinds)).alias("token"), F.lit(1).alias("secret"))
    marks = spark.range(40).select(F.explode(F.array(*[F.repeat(F.lit(c), 24) for c in "-=_+/"])).alias("token"), F.lit(0).alias("secret"))
    digits = F.translate(F.substring(F.sha2(F.concat(i.cast("string"), F.lit("d")), 256), 1, 40), "abcdef", "")
    numbers = spark.range(strings).select(digits.substr(F.lit(1), (6 + i % 15).cast("int")).alias("token"), F.lit(0).alias("secret"))
    plain = spark.range(1).select(F.explode(F.split(F.lit("name value index count first last next item user file path size time date line text list code type kind state error result config default message version number session request response content version document element handler manager"), " ")).alias("w"))
    if docs is not None:
        own = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(r"(?<![^\s])[A-Za-z]{3,14}(?=[\s.,;:!?])"), F.lit(0)))).alias("w"))
        plain = plain.union(own.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.xxhash64("w"), "w").limit(words).select("w"))
    # its partner: another word of the bounded list
    pairs = plain.select("w", F.lead("w", 1, "item").over(Window.orderBy(F.xxhash64("w"), "w")).alias("x"))
    w, x = F.col("w"), F.col("x")
    joined = [w, F.concat_ws("_", w, x), F.concat_ws("-", w, x), F.concat_ws("/", w, x), F.concat(w, F.initcap(x)), F.concat(F.initcap(w), F.initcap(x)), F.upper(w), F.concat_ws("_", F.upper(w), F.upper(x)), F.concat(w, x), F.concat_ws("=", w, x)]
    return random.union(marks).union(numbers).union(pairs.select(F.explode(F.array(*joined)).alias("token"), F.lit(0).alias("secret")))


def train(samples: DataFrame, smooth: float = 0.2) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each character pair: a table of SIDE x SIDE, by code of the
    first and the second character (0: not in ALPHABET). Rows with null token or label are left out."""
    codes = F.transform(F.split("token", ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    known = samples.where("token IS NOT NULL AND secret IS NOT NULL AND length(token) > 1").select("secret", codes.alias("c"))
    pairs = known.select("secret", F.explode(F.expr("transform(sequence(1, size(c) - 1), i -> c[i - 1] * %d + c[i])" % SIDE)).alias("p"))
    count = {(x["secret"], x["p"]): x["n"] for x in pairs.groupBy("secret", "p").agg(F.count("*").alias("n")).collect()}  # 2 * SIDE^2 rows at most
    table = []
    for a in range(SIDE):
        total = [sum(count.get((s, a * SIDE + b), 0) for b in range(SIDE)) for s in (0, 1)]
        for b in range(SIDE):
            p = [(count.get((s, a * SIDE + b), 0) + smooth) / (total[s] + smooth * SIDE) for s in (0, 1)]
            table.append(round(math.log(p[1] / p[0]), 4))
    return table


def _spans(text: Column, pattern: str, kind: int, gate: Column, value: Column | None = None) -> Column:
    """Spans of a pattern's matches in code points: the text between matches and the matches have lengths, and their
    running sum gives the places. length() counts code points, which offsets of the JVM's matcher do not."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if value is None else value
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"), values.alias("v"))
    parts = F.filter(parts, lambda x: x["m"].isNotNull())
    # Appending copies what is there, so spans are summed up in blocks: long texts take little more time a match.
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(parts) - 1, F.lit(0)) / BLOCK).cast("int")), lambda i: F.slice(parts, i * BLOCK + 1, BLOCK))

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        z = a + F.length(x["m"])
        return F.struct(z.alias("at"), F.concat(acc["own"], F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), z.alias("end"), x["v"].alias("v")))).alias("own"))

    def add_block(acc: Column, block: Column) -> Column:
        got = F.aggregate(block, F.struct(acc["at"].alias("at"), none.alias("own")), add)
        return F.struct(got["at"].alias("at"), F.concat(acc["all"], F.array(got["own"])).alias("all"))

    none = F.array().cast("array<struct<start:int,kind:int,end:int,v:string>>")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,kind:int,end:int,v:string>>>").alias("all"))
    return F.when(gate, F.aggregate(blocks, start, add_block, lambda acc: F.flatten(acc["all"]))).otherwise(none)


def ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio per character pair of a string of at least two characters."""
    codes = F.transform(F.split(token, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(table, a * SIDE + b))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs)


def find_secrets(docs: DataFrame, table: list[float], text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """docs with `secrets`: array of (start, end, kind, value), by start and then kind; places in code points.

    Kinds assign, access and hex are the fixed patterns; markov is any run of LONG or more characters whose mean
    log-likelihood ratio is above `threshold` and that touches no span of the fixed patterns. LONG and the threshold are
    set from strings not trained on: of random ones of 12 characters and more in six alphabets 99 % and more are found, of
    identifiers made of common words 0.5 % are taken for secrets, of numbers none. Words in base64 are taken for secrets.

    Null text is empty and has no spans; an empty table gives an empty result. Whole texts are read, however long. All
    rows stay, repeated ones too, each with its own spans; other columns stay, a column named secrets is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # one folded constant instead of thousands of literals
    weights = F.from_json(F.lit(json.dumps(table)), "array<double>")
    assign = _spans(text, ASSIGN, 0, text.rlike("(?i)(?:passw|secret|token|api_?key)"), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    base = F.concat(F.filter(assign, lambda x: F.length(x["v"]) >= 6), _spans(text, ACCESS, 1, F.contains(text, F.lit("AKIA"))), _spans(text, HEX, 2, text.rlike(HEX)))
    tokens = _spans(text, TOKEN, 3, text.rlike(TOKEN))
    b, t = (next(c for k in range(len(docs.columns) + 1) if (c := f"__{x}{k}") not in docs.columns) for x in ("base", "token"))
    own = {b: base, t: tokens}
    out = docs.withColumns(own)
    apart = lambda t: ~F.exists(b, lambda x: (x["start"] < t["end"]) & (t["start"] < x["end"]))
    added = F.filter(t, lambda x: apart(x) & (ratio(x["v"], weights) > threshold))
    spans = F.array_sort(F.concat(b, added))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(names, x["kind"]).alias("kind"), x["v"].alias("value")))
    return out.withColumn("secrets", spans).drop(*own)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda x: x["kind"] != "markov")
    return found.select(id_col, *[count(k) for k in KINDS[:3]], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))
