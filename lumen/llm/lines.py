"""Line dedup: drop lines that stand on more than a share of their site's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of (site, lines to drop) that may be broadcast; beyond it the table is joined by site.
BROADCAST_BYTES = 32 << 20


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, ratio: float = 0.1, min_pages: int = 3, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(site, line key): lines on more than `ratio` of their site's pages and on at least `min_pages` of them."""
    pages = docs.select(F.col(site_col).alias("site"), F.coalesce(text_col, F.lit("")).alias("text"))
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    each = pages.select("site", F.explode(F.array_distinct(F.transform(lines, _key))).alias("line"))
    counts = each.groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = totals.withColumnRenamed("site", "of")
    return counts.join(totals, F.col("site").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("pages")).select("site", "line")


def drop_boilerplate_lines(docs: DataFrame, ratio: float = 0.1, min_pages: int = 3, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with the lines removed that are boilerplate of their site; every row and every other column stays.

    A line is what stands between newlines, compared without outer spaces; blank lines are never counted nor dropped.
    A page counts once for a line that it repeats, and all its copies of the line go. Pages of a site are all its
    rows, repeated rows and empty texts included; a null site is a site of its own. Null texts stay null. Sites with
    fewer than min_pages pages keep all lines, since no share can be told from them.

    Counting shuffles (site, 8-byte hash) rows with map-side combine. What is to be dropped is at most
    lines-per-page / ratio lines a site; the list is broadcast if it measures under BROADCAST_BYTES, else joined by
    site, where adaptive execution splits a site with many pages.
    """
    gone = boilerplate(docs, ratio, min_pages, text_col, site_col).groupBy("site").agg(F.collect_set("line").alias("lines"))
    gone = gone.persist()
    held = gone.agg(F.coalesce(F.sum(F.size("lines") * 8 + 64), F.lit(0))).first()[0]
    names = {c: f"__c{k}" for k, c in enumerate(docs.columns)}  # whatever the other columns are called
    out = docs.toDF(*names.values())
    site, text = names[site_col], names[text_col]
    out = out.join(F.broadcast(gone) if held < BROADCAST_BYTES else gone, F.col(site).eqNullSafe(F.col("site")), "left")
    split = F.split(text, "\n")
    hit = F.array_intersect(F.transform(split, _key), F.col("lines"))
    kept = F.when(F.col("lines").isNull() | ~F.arrays_overlap(F.transform(split, _key), F.col("lines")), F.col(text)).otherwise(F.array_join(F.filter(split, lambda x: ~F.array_contains(hit, _key(x)) | (F.trim(x) == "")), "\n"))
    return out.withColumn(text, kept).select(*[F.col(v).alias(k) for k, v in names.items()])


#: The same in SQL, on documents with source as the site.
SQL = """
WITH pages AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
lines AS (SELECT r, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM pages),
counts AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT r) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY ALL),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
gone AS (SELECT c.source, list(c.line) AS lines FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= 3 AND c.n > 0.1 * t.pages GROUP BY c.source)
SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x : g.lines IS NULL OR trim(x, ' ') = '' OR NOT list_contains(g.lines, trim(x, ' '))), chr(10)) AS text
FROM pages p LEFT JOIN gone g ON p.source IS NOT DISTINCT FROM g.source
"""
