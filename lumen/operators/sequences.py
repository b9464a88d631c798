"""Windows and graph walks: ordinals, gaps, budgets, reachability."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordinal(df: DataFrame, keys: list[str], value: str, share: float = 0.9) -> DataFrame:
    """(keys, value): the element at place int(share * n), from 1, of the sorted values; no interpolation."""
    w = Window.partitionBy(*keys).orderBy(value)
    rows = df.withColumn("__k", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    at = F.greatest(F.floor(F.lit(share) * F.col("__n")), F.lit(1))
    return rows.where(F.col("__k") == at).select(*keys, F.col(value))


def far_cells(cells: DataFrame, keys: list[str], row: str = "row", col: str = "col") -> DataFrame:
    """Cells far outside the area of most: row above 10 * p90 + 200 or column above 4 * p90 + 60, where fewer than a
    tenth of the cells (and one) are so."""
    out = cells.join(ordinal(cells, keys, row).withColumnRenamed(row, "__r"), keys).join(ordinal(cells, keys, col).withColumnRenamed(col, "__c"), keys)
    out = out.withColumn("__far", (F.col(row) > 10 * F.col("__r") + 200) | (F.col(col) > 4 * F.col("__c") + 60))
    w = Window.partitionBy(*keys)
    out = out.withColumn("__few", F.count_if("__far").over(w) < 0.1 * F.count("*").over(w) + 1)
    return out.where("__far AND __few").drop("__r", "__c", "__far", "__few")


def span_gaps(spans: DataFrame, keys: list[str], start: str, end: str, last: str) -> DataFrame:
    """(keys, at, size): bytes between a span and the next, the boundary `last` standing behind the final one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    nxt = F.coalesce(F.lead(start).over(w), F.col(last))
    return spans.withColumn("__next", nxt).where(F.col("__next") > F.col(end)).select(*keys, F.col(end).alias("at"), (F.col("__next") - F.col(end)).alias("size"))


def carried(df: DataFrame, keys: list[str], order: str, number: str) -> DataFrame:
    """df with `number` filled in where it is missing: one more than the row before, from 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__run", F.count(number).over(upto)).withColumn("__base", F.coalesce(F.last(number, ignorenulls=True).over(upto), F.lit(0)))
    k = F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(order))
    return out.withColumn(number, F.col("__base") + k - F.when(F.col("__run") > 0, 1).otherwise(0)).drop("__run", "__base")


def within_budget(parts: DataFrame, root: str, order: str, size: str, part_limit: int, total_limit: int) -> DataFrame:
    """parts with `used` (bytes charged before) and `ok`: false from the first part of a root that breaks a limit on."""
    w = Window.partitionBy(root).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumn("__sum", F.sum(size).over(w))
    broken = (F.col(size) > part_limit) | (F.col("__sum") > total_limit)
    out = out.withColumn("__bad", F.max(broken.cast("int")).over(w))
    return out.select(*parts.columns, (F.col("__sum") - F.col(size)).alias("used"), (F.col("__bad") == 0).alias("ok"))


def line_breaks(spans: DataFrame, keys: list[str], order: str, y: str, least: float = 2.0) -> DataFrame:
    """spans with `breaks`: whether a span begins a new line, its y differing from the one before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return spans.withColumn("breaks", F.coalesce(F.abs(F.col(y) - F.lag(y).over(w)) > least, F.lit(False)))


def reachable(edges: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node): what can be reached from the start nodes over edges (keys, src, dst), the start nodes included.
    Cycles and chains of any length are no matter: a graph is that of one file, which was parsed in one task too, and it
    is walked in one. Nulls in keys are a key of their own, null nodes are left out. No start, no row."""
    kind = edges.schema["dst"].dataType
    out = T.StructType([*[edges.schema[k] for k in keys], T.StructField("node", kind)])
    start = starts.select(*keys, F.col("node").cast(kind).alias("src"), F.col("node").cast(kind).alias("dst"), F.lit(True).alias("start"))
    rows = edges.select(*keys, F.col("src").cast(kind).alias("src"), "dst", F.lit(False).alias("start")).union(start).where("src IS NOT NULL AND dst IS NOT NULL").distinct()

    def walk(own: pd.DataFrame) -> pd.DataFrame:
        ahead: dict = {}
        for a, b in zip(own["src"], own["dst"], strict=True):
            ahead.setdefault(a, []).append(b)
        todo = own.loc[own["start"], "dst"].tolist()
        seen = dict.fromkeys(todo)
        while todo:
            for b in ahead.get(todo.pop(), ()):
                if b not in seen:
                    seen[b] = None
                    todo.append(b)
        got = own.iloc[:1][keys].merge(pd.DataFrame({"node": list(seen)}), how="cross")
        return got if len(seen) else got.astype({"node": own["dst"].dtype})

    return rows.groupBy(*keys).applyInPandas(walk, out)


def unreached(nodes: DataFrame, edges: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """nodes (keys, node, ...) that cannot be reached: orphans."""
    return nodes.join(reachable(edges, starts, keys), [*keys, "node"], "left_anti")
