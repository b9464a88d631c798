"""Whole plans: from files, texts or pages to one findings table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen import rules
from lumen.operators import documents, html, lines, text
from lumen.plans import report
from lumen.session import checkpointed
from lumen.sources import unpack
from lumen.sources.html import read_html


@dataclass
class Scan:
    """artifacts, findings and errors of a scan."""

    artifacts: DataFrame
    findings: DataFrame
    errors: DataFrame

    def counts(self) -> DataFrame:
        return report.subtree_counts(self.artifacts, self.findings)

    def verdicts(self) -> DataFrame:
        """One row a root, its artifacts below included."""
        roots = self.artifacts.select("artifact_id", "root_id")
        own = lambda df: df.join(roots, "artifact_id").drop("artifact_id").withColumnRenamed("root_id", "artifact_id")
        return report.verdicts(self.artifacts.where("depth = 0"), own(self.findings), self.errors)

    def json(self) -> list[str]:
        """Nested reports, one string a root; empty children are left out."""
        kept = report.kept(self.artifacts, self.findings, self.errors)
        return [r["json"] for r in report.trees(kept, self.findings, self.errors).orderBy("root_id").toLocalIterator()]


def scan_text(df: DataFrame, artifact_id: Column, content: Column, **unit) -> DataFrame:
    """Findings of a table of texts."""
    return report.distinct_findings(text.analyse(text.units(df, artifact_id, content, **unit)))


def scan_html(df: DataFrame, artifact_id: Column, content: Column, email: bool = False) -> DataFrame:
    """Findings of a table of pages."""
    pages = read_html(df, artifact_id, content)
    return report.distinct_findings(html.findings(pages, email=email).unionByName(text.analyse(html.text_units(pages))))


def scan_files(spark: SparkSession, paths, include_all: bool = False, ads: DataFrame | None = None, slack: DataFrame | None = None, total: int = rules.MAX_TOTAL) -> Scan:
    """Scan files: unpack and parse once, then detect.

    The records of all files are checkpointed in the shared folder, since every detector reads them; contents of files
    are not among them. ads and slack are optional tables of alternate streams and file slack, read by other means.
    """
    records = checkpointed(unpack.unpack(unpack.list_files(spark, paths, include_all), total=total))
    return scan_records(spark, records, ads, slack)


def scan_records(spark: SparkSession, records: DataFrame, ads: DataFrame | None = None, slack: DataFrame | None = None) -> Scan:
    artifacts = records.where("rec = 'artifact'").select("artifact_id", "root_id", "parent_id", "depth", "seq", "name", "kind", "file_type", "size")
    errors = records.where("rec = 'error'").select("artifact_id", "seq", F.col("text").alias("message"))
    facts = records.where("rec = 'fact'").select("artifact_id", "seq", "kind", "name", "location", "context", "hidden", "text", "reasons", "n")
    # HTML in mail, chunks, and text files that are HTML
    plain = facts.where("kind = 'plain'")
    is_page = lines.is_html(F.col("text"), F.col("context"))
    sources = facts.where("kind = 'html'").select("artifact_id", "location", F.col("hidden").alias("email"), "seq", "text")
    sources = sources.unionByName(plain.where(is_page).select("artifact_id", "location", F.lit(False).alias("email"), "seq", "text"))
    pages = read_html(sources, F.col("artifact_id"), F.col("text"), "location", "email", "seq")
    page_findings = html.findings(pages, at=F.col("location"), email=F.col("email"), base=F.col("seq"))
    page_units = html.text_units(pages, at=F.col("location"), base=F.col("seq") * 10_000)
    # lines of all text files; the text itself where it is no page
    texts = lines.prepared(plain, F.col("artifact_id"), F.col("text"), F.col("context"), F.col("name"))
    whole = F.col("location") != "document"
    line_units = lines.text_units(texts).where(whole | ~lines.is_html(F.col("text"), F.lit("")))
    comments = texts.where("ext = 'md'").select("artifact_id", F.lit(900).cast("long").alias("unit_seq"), F.lit("markdown comments").alias("location"), F.lit("").alias("context"), F.lit(True).alias("hidden"), F.array_join(F.regexp_extract_all("text", F.lit(r"(?s)<!--(.*?)-->"), F.lit(1)), "\n").alias("text"))
    groups, cells, spans = documents.grouped_runs(facts), documents.cells(facts), documents.pdf_spans(facts)
    heads = documents.headers(facts)
    head_units = heads.select("artifact_id", F.col("seq").alias("unit_seq"), F.lit("headers").alias("location"), F.lit("").alias("context"), F.lit(False).alias("hidden"), F.concat_ws(" ", "from", "subject", "to").alias("text"))
    only = documents.plain_only(facts, pages).where("n_only >= 12 AND n_only > 0.3 * n_words").select("artifact_id", F.col("seq").alias("unit_seq"), F.lit("body").alias("location"), F.lit("text/plain-only content").alias("context"), F.lit(True).alias("hidden"), F.array_join("told", "\n").alias("text"))
    own_units = facts.where("kind = 'text'").select("artifact_id", F.col("seq").alias("unit_seq"), "location", "context", "hidden", "text")
    units = documents.union([own_units, page_units, line_units, comments, head_units, only, documents.orphan_units(facts), documents.run_units(groups), documents.cell_units(cells), documents.pdf_units(facts, spans)])
    units = units.where(F.length(F.regexp_replace("text", "^\\x00+$", "")) > 0)
    parts = [
        documents.as_found(facts), documents.type_mismatch(artifacts, spark), documents.containers(facts), documents.mail(facts, pages), documents.packages(facts, spark), documents.hidden_runs(groups),
        documents.word(facts, spark), documents.sheets(facts, cells), documents.pdf(facts, spark, spans), documents.legacy(facts), page_findings, lines.findings(texts), text.analyse(units),
    ]
    if ads is not None:
        parts.append(documents.streams(ads))
    if slack is not None:
        parts.append(documents.slack(artifacts, slack))
    findings = checkpointed(report.distinct_findings(documents.union(parts)))
    page_errors = pages.where("error IS NOT NULL").select("artifact_id", "seq", F.concat("location", F.lit(": "), "error").alias("message"))
    return Scan(artifacts, findings, errors.unionByName(page_errors))
