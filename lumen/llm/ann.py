"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


@dataclass
class Tree:
    """Nodes of a k-means tree over vectors with one more component, sqrt(top - |x|^2): there the largest inner
    product with a query, whose own such component is 0, is the nearest vector."""

    centres: list[np.ndarray]  # of each inner node: one row a child
    children: list[list[int]]  # of each inner node: >= 0 an inner node, < 0 the leaf -1 - child
    leaves: int
    top: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))[:, None]], 1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre, level by level."""
        x, node, out = self.lift(x), np.zeros(len(x), "int64"), np.full(len(x), -1)
        while (open_ := np.flatnonzero(out < 0)).size:
            for k in np.unique(node[open_]):
                rows = open_[node[open_] == k]
                c = self.centres[k]
                near = (x[rows] @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
                child = np.array(self.children[k])[near]
                node[rows] = np.maximum(child, 0)
                out[rows] = np.where(child < 0, -1 - child, -1)
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves in the order of a best-bin-first traversal: a queue holds all branches met and not taken, and the
        one whose centre is nearest is followed next."""
        q, queue, out = np.append(query, 0.0), [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                continue
            for d, child in zip(((self.centres[node] - q) ** 2).sum(1).tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (d, child))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c, (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


def grow(sample: np.ndarray, rows: int, top: float, rows_per_leaf: int, branch: int = 12, seed: int = 3) -> Tree:
    """A tree over the sample whose leaves shall hold about rows_per_leaf of `rows` rows."""
    tree = Tree([], [], 0, top)
    x, rng = Tree.lift(tree, sample), np.random.default_rng(seed)
    share = max(2.0, len(x) * rows_per_leaf / max(rows, 1))

    def node(own: np.ndarray) -> int:
        here = len(tree.centres)
        tree.centres.append(np.zeros(0))
        tree.children.append([])
        k = int(min(branch, max(1, round(len(own) / share)), len(own)))
        c, at = _kmeans(own, k, rng)
        keep = [j for j in range(k) if (at == j).any()]
        tree.centres[here] = c[keep]
        for j in keep:
            part = own[at == j]
            if len(part) > 1.5 * share and len(keep) > 1:
                tree.children[here].append(node(part))
            else:
                tree.children[here].append(-1 - tree.leaves)
                tree.leaves += 1
        return here

    node(x)
    return tree


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, width)


def usable(vectors: DataFrame, id_col: str, vector_col: str, query: Column) -> tuple[DataFrame, int]:
    """(id, v, asked) of the rows that take part, and their width: finite, not zero, no null, of the commonest length."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(query, F.lit(False)).alias("asked")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = width["w"] if width else 0
    return rows.where(F.size("v") == width).groupBy("id", "v").agg(F.max("asked").alias("asked")), width


def nearest(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000, rows_per_leaf: int | None = None, recall: float = 0.93, calibration: int = 200, block: int = 4096, report: dict | None = None) -> DataFrame:
    """For each row of `vectors` for which `query` (over the columns of vectors) holds, its k nearest other rows by
    inner product.

    The tree is fitted on the vectors of smallest hashes, `sample` of them or 16 for each leaf if that is more, and
    every vector is put into a leaf. A leaf holds about rows_per_leaf vectors; by default that is the root of their
    number, at least 64, so leaves and their size grow alike. Equal vectors are one vector that carries its k + 1
    smallest ids, all that can be among k nearest since ties go to the smaller id; a group of copies of any size is
    thereby one entry, cut down before the shuffle. For `calibration` query vectors the exact nearest are found by
    brute force over all vectors, and the number of leaves that a search visits is widened until `recall` of them are
    reached. Leaves of more than `block` vectors are split. `report` gets leaves, visits and that recall.

    Ids may be of any type that can be ordered. Vectors that are null, zero, hold null, NaN or infinite components, have
    a null id or another length than most take no part. Repeated rows (same id and vector) count once. Fewer candidates
    than k: all are returned, if the leaves reach them all. An empty table gives an empty result. Other columns play no
    part, whatever their names.

    Returns query_id, rank (from 1), id, score.
    """
    spark = vectors.sparkSession
    rows, width = usable(vectors, id_col, vector_col, query)
    kind = vectors.schema[id_col].dataType.simpleString()
    out_names = ["query_id", "rank", id_col, "score"]
    rows = stage(rows.withColumn("h", F.xxhash64("v")), "vectors")
    own = Window.partitionBy("h", "v").orderBy("id")
    entries = rows.withColumn("n", F.row_number().over(own)).where(F.col("n") <= k + 1).groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = stage(entries, "entries")
    n, top = entries.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, `{id_col}` {kind}, score double")
    rows_per_leaf = rows_per_leaf or max(64, round(n**0.5))
    chosen = np.array([x["v"] for x in entries.orderBy("h").select("v").limit(max(sample, 16 * n // rows_per_leaf)).toLocalIterator()], "float64")
    tree = spark.sparkContext.broadcast(grow(chosen, n, top, rows_per_leaf))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.leaf_of(_matrix(batch.column(1), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["h", "v", "ids", "leaf"])

    entries = stage(entries.mapInArrow(place, f"h long, v array<double>, ids array<{kind}>, leaf int"), "placed")
    queries = rows.where("asked").groupBy("h", "v").agg(F.count("*").alias("n")).drop("n")
    visits, reached = _calibrated(entries, queries, tree.value, k, width, calibration, recall)
    if report is not None:
        report |= {"leaves": tree.value.leaves, "visits": visits, "recall": reached}
    # one row a leaf: how many blocks it is split into
    blocks = {x["leaf"]: -(-x["count"] // block) for x in entries.groupBy("leaf").count().collect()}
    split = F.broadcast(spark.createDataFrame(sorted(blocks.items()), "leaf int, blocks int"))
    held = entries.join(split, "leaf").withColumn("block", F.pmod(F.xxhash64("h", F.lit(1)), F.col("blocks")).cast("int")).select("leaf", "block", "v", "ids")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), width)
                rows_, leaf, part = [], [], []
                for i in range(len(x)):
                    for at in tree.value.visits(x[i], visits):
                        for b in range(blocks.get(at, 0)):
                            rows_.append(i)
                            leaf.append(at)
                            part.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(part, pa.int32()), batch.column(0).take(pa.array(rows_, pa.int64())), batch.column(1).take(pa.array(rows_, pa.int64()))], names=["leaf", "block", "h", "v"])

    asked = queries.mapInArrow(route, "leaf int, block int, h long, v array<double>")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            x, ids = np.stack(right["v"].to_numpy()), right["ids"].to_list()
            least = np.array([i[0] for i in ids])
            for a in range(0, len(left), 256):
                part = left.iloc[a : a + 256]
                near = np.stack(part["v"].to_numpy()) @ x.T
                for h, s in zip(part["h"], near, strict=True):
                    few = np.flatnonzero(s >= np.partition(s, -min(k + 1, len(s)))[-min(k + 1, len(s))])
                    few = few[np.lexsort((least[few], -s[few]))][: k + 1]
                    best = sorted((-s[j], i) for j in few for i in ids[j])[: k + 1]
                    found.append((h, [-s_ for s_, _ in best], [i for _, i in best]))
        return pd.DataFrame(found, columns=["h", "s", "ids"])

    found = asked.groupBy("leaf", "block").cogroup(held.groupBy("leaf", "block")).applyInPandas(search, f"h long, s array<double>, ids array<{kind}>")
    pairs = F.transform(F.arrays_zip("s", "ids"), lambda x: F.struct((-x["s"]).alias("d"), x["ids"].alias("i")))
    best = found.groupBy("h").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k + 1).alias("best"))
    asking = rows.where("asked").select(F.col("id").alias("query_id"), "h").join(best, "h")
    others = F.slice(F.filter("best", lambda x: x["i"] != F.col("query_id")), 1, k)
    return asking.select("query_id", F.posexplode(others).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.i").alias("i"), (-F.col("x.d")).alias("score")).toDF(*out_names)


def _calibrated(entries: DataFrame, queries: DataFrame, tree: Tree, k: int, width: int, calibration: int, recall: float) -> tuple[int, float]:
    """The least number of leaves to visit that reaches `recall` of the exact nearest vectors of some queries, and the
    share reached."""
    asked = queries.orderBy("h").limit(calibration).collect()
    if not asked:
        return 1, 1.0
    x = np.array([q["v"] for q in asked], "float64")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, leaf = np.full((len(x), 0), 0.0), np.zeros((len(x), 0), "int32")
        for batch in batches:
            if batch.num_rows:
                s = x @ _matrix(batch.column(1), width).T
                near = np.concatenate([near, s], 1)
                leaf = np.concatenate([leaf, np.broadcast_to(batch.column(3).to_numpy(), s.shape)], 1)
                keep = np.argsort(-near, axis=1, kind="stable")[:, : k + 1]
                near, leaf = np.take_along_axis(near, keep, 1), np.take_along_axis(leaf, keep, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(x)), near.shape[1]), pa.int32()), pa.array(near.ravel()), pa.array(leaf.ravel(), pa.int32())], names=["q", "s", "leaf"])

    first = Window.partitionBy("q").orderBy(F.desc("s"), "leaf")
    exact = entries.mapInArrow(scan, "q int, s double, leaf int").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).collect()
    order = [{leaf: i for i, leaf in enumerate(tree.visits(q, tree.leaves))} for q in x]
    ranks = np.array([order[r["q"]][r["leaf"]] for r in exact])
    need = 1
    while need < tree.leaves and (ranks < need).mean() < recall:
        need += 1
    return need, float((ranks < need).mean())


