"""Findings tables: identity, rollups, verdicts and exports."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen import rules
from lumen.functions.text import clip, visible

KEY = ["artifact_id", "severity", "category", "location", "detail", "snippet"]


def rank(severity: Column | str = "severity") -> Column:
    """0 for the highest severity."""
    return F.array_position(F.array(*[F.lit(s) for s in rules.SEVERITIES]), F.col(severity) if isinstance(severity, str) else severity) - 1


def distinct_findings(findings: DataFrame) -> DataFrame:
    """Snippets clipped; of findings that are then equal, the first. One aggregation with map-side combine."""
    return findings.withColumn("snippet", clip(F.col("snippet"))).groupBy(*KEY).agg(F.min("seq").alias("seq"))


def counts(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES])


def totals(findings: DataFrame, by: str = "artifact_id") -> DataFrame:
    """Counts by artifact and, in the row with a null artifact, of all."""
    return findings.rollup(by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES])


def verdicts(artifacts: DataFrame, findings: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """artifact_id, counts, verdict for every artifact."""
    ids = artifacts.select("artifact_id").distinct()
    out = ids.join(counts(findings, "artifact_id"), "artifact_id", "left").na.fill(0, list(rules.SEVERITIES))
    failed = errors.select("artifact_id").distinct().withColumn("failed", F.lit(True)) if errors is not None else None
    out = out.join(failed, "artifact_id", "left") if failed is not None else out.withColumn("failed", F.lit(None).cast("boolean"))
    some = sum((F.col(s) for s in rules.SEVERITIES[1:]), F.col(rules.SEVERITIES[0]))
    verdict = F.when(F.col("HIGH") > 0, "Suspicious").when(F.col("MEDIUM") > 0, "Review").when(F.col("failed") & (some == 0), "Partial").otherwise("Clean")
    return out.withColumn("verdict", verdict).drop("failed")


def subtree_counts(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts of each artifact with all below it. artifacts: (artifact_id, parent_id), at most rules.MAX_DEPTH deep."""
    above = artifacts.select("artifact_id", F.col("artifact_id").alias("of"))
    parents = artifacts.where("parent_id IS NOT NULL").select(F.col("artifact_id").alias("of"), "parent_id")
    every, level = above, above
    for _ in range(rules.MAX_DEPTH + 1):
        level = level.join(parents, "of").select("artifact_id", F.col("parent_id").alias("of"))
        every = every.union(level)
    own = counts(findings, "artifact_id")
    return every.join(own, "artifact_id").groupBy(F.col("of").alias("artifact_id")).agg(*[F.sum(s).alias(s) for s in rules.SEVERITIES])


def kept(artifacts: DataFrame, findings: DataFrame, errors: DataFrame) -> DataFrame:
    """Roots, streams (kind 'ads') and all artifacts with a finding or error in or below them."""
    some = findings.select("artifact_id").union(errors.select("artifact_id")).distinct()
    edges = artifacts.select("artifact_id", "parent_id")
    keep, level = some, some
    for _ in range(rules.MAX_DEPTH + 1):
        level = level.join(edges, "artifact_id").where("parent_id IS NOT NULL").select(F.col("parent_id").alias("artifact_id")).distinct()
        keep = keep.union(level)
    stays = artifacts.where("parent_id IS NULL OR kind = 'ads'")
    return stays.union(artifacts.where("parent_id IS NOT NULL AND kind <> 'ads'").join(keep.distinct(), "artifact_id", "left_semi"))


def latest(reports: DataFrame) -> DataFrame:
    """Of several scans of a path, the last: rows (path, scanned_at, ...)."""
    return reports.groupBy("path").agg(F.max_by(F.struct("*"), "scanned_at").alias("r")).select("r.*")


def trees(artifacts: DataFrame, findings: DataFrame, errors: DataFrame) -> DataFrame:
    """(root_id, json): one nested report a root, children inside parents, built level by level from below."""
    own = findings.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct(rank().alias("r"), "seq", "severity", "category", "location", "detail", "snippet"))).alias("fs"))
    own = own.select("artifact_id", F.transform("fs", lambda x: F.struct(x["severity"].alias("severity"), x["category"].alias("category"), x["location"].alias("location"), x["detail"].alias("detail"), x["snippet"].alias("snippet"))).alias("findings"))
    err = errors.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("seq", "message"))).getField("message").alias("errors"))
    total = subtree_counts(artifacts, findings).select("artifact_id", F.struct(*rules.SEVERITIES).alias("counts"))
    zero = F.struct(*[F.lit(0).cast("long").alias(s) for s in rules.SEVERITIES])
    rows = artifacts.join(own, "artifact_id", "left").join(err, "artifact_id", "left").join(total, "artifact_id", "left")
    part = F.to_json(F.struct(F.col("name").alias("path"), "file_type", F.coalesce("counts", zero).alias("counts"), F.coalesce("findings", F.array()).alias("findings"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors")))
    rows = rows.select("artifact_id", "parent_id", "depth", "seq", part.alias("json"))
    below = None
    for depth in range(rules.MAX_DEPTH + 1, -1, -1):
        level = rows.where(F.col("depth") == depth)
        level = level.join(below, "artifact_id", "left") if below is not None else level.withColumn("children", F.lit(None).cast("string"))
        body = F.concat(F.expr("substring(json, 1, length(json) - 1)"), F.lit(',"children":['), F.coalesce("children", F.lit("")), F.lit("]}"))
        level = level.select("artifact_id", "parent_id", "seq", body.alias("json"))
        if depth:
            below = level.groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "json"))), lambda x: x["json"]), ",").alias("children")).withColumnRenamed("parent_id", "artifact_id")
    return level.select(F.col("artifact_id").alias("root_id"), "json")


def to_json(reports: Iterable[str]) -> str:
    """One JSON document of all trees, indented."""
    return json.dumps([json.loads(r) for r in reports], indent=2, ensure_ascii=False)


def console(report: dict, indent: int = 0) -> list[str]:
    """Lines that show one tree as text."""
    pad, c = "  " * indent, report["counts"]
    out = [f"{pad}== {report['path']}  [{report['file_type']}]  HIGH={c['HIGH']} MED={c['MEDIUM']} LOW={c['LOW']} INFO={c['INFO']}"]
    for f in report["findings"]:
        out.append(f"{pad}  [{f['severity']:6}] {f['category']} @ {f['location']}: {f['detail'][:160]}")
        if f["snippet"]:
            out.append(f"{pad}           > " + f["snippet"].replace("\n", " ")[:140])
    out += [f"{pad}  [ERROR ] {(e.splitlines() or [''])[0]}" for e in report["errors"]]
    for child in report["children"]:
        out += console(child, indent + 1)
    return out


def to_html(reports: list[dict], when: str) -> str:
    """A page with all trees. Snippets come with invisibles already shown (see shown())."""
    esc = html.escape

    def section(r: dict, child: bool = False) -> str:
        own = [sum(f["severity"] == s for f in r["findings"]) for s in rules.SEVERITIES]
        pills = "".join(f'<span class="pill {s}">{n} {s}</span>' for s, n in zip(rules.SEVERITIES, own, strict=True) if n)
        body = "".join(f'<tr><td class="{f["severity"]}">{f["severity"]}</td><td>{esc(f["category"])}</td><td>{esc(f["location"])}</td><td>{esc(f["detail"])}' + (f"<pre>{esc(f['snippet'])}</pre>" if f["snippet"] else "") + "</td></tr>" for f in r["findings"])
        table = f"<table><tr><th>Severity</th><th>Category</th><th>Location</th><th>Detail</th></tr>{body}</table>" if body else "" if r["children"] else "<p>No hidden content found.</p>"
        notes = "".join(f"<div>Scanner note: {esc((e.splitlines() or [''])[0])}</div>" for e in r["errors"])
        return f'<section{" class=child" if child else ""}><h2>{esc(r["path"])} <small>{esc(r["file_type"])}</small> {pills}</h2>{table}{notes}{"".join(section(c, True) for c in r["children"])}</section>'

    total = " · ".join(f"{sum(r['counts'][s] for r in reports)} {s.lower()}" for s in rules.SEVERITIES)
    return f"<!doctype html><meta charset=utf-8><title>Scan report</title><style>section{{border:1px solid #ccc;margin:1em;padding:1em}}pre{{white-space:pre-wrap}}</style><h1>Scan report</h1><p>{when} · {len(reports)} file(s) · {total}</p>{''.join(map(section, reports))}"


def shown(findings: DataFrame) -> DataFrame:
    return findings.withColumn("snippet", visible(F.col("snippet")))


def without_info(findings: DataFrame) -> DataFrame:
    return findings.where("severity <> 'INFO'")
