"""Helpers shared by the training-data operators: staged tables, word hashing, label propagation."""

from __future__ import annotations

import atexit
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.session import own_folder

#: Links that the driver takes at once to find components, 16 bytes each.
FEW = 1 << 18

#: Words as the contracts define them, on UTF-8 bytes: bytes.split() separates at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where it is unset, in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        path = own_folder(spark)
        spark.sparkContext.setCheckpointDir(path)
    return path


_staged: list[tuple[SparkSession, str]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lumen-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    """Staged tables go when the driver ends."""
    for spark, path in _staged:
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone by now
            return


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, so that they do not hold disk."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            root = f.rsplit("/", 1)[0]
            for k, (spark, path) in enumerate(_staged):
                if root.endswith(path.split(":", 1)[-1].lstrip("/")):
                    drop_path(spark, path)
                    del _staged[k]
                    break


def power_of_two(x: float, least: int, most: int) -> int:
    n = least
    while n < x and n < most:
        n *= 2
    return n


def binary_texts(batch: pa.RecordBatch, k: int) -> list[bytes | None]:
    """Column k of an Arrow batch as UTF-8 bytes, without decoding."""
    col = batch.column(k)
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def release() -> None:
    """Give memory that this Python worker no longer needs back to the system: workers live on between tasks, and what
    one stage held would count against the executor in all later ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def scramble(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of many texts at once, A-Z in lower case: no Python step for a word.

    A word's hash is the sum of a random number of each byte times a power of an odd base. With running sums over the
    whole buffer, a word is a difference of two of them, moved to power 0 by the inverse base, then mixed with its length.
    """

    BASE = 0x9E3779B97F4A7C15
    STEP = 1 << 20

    def __init__(self):
        self.value = scramble(np.arange(1, 257, dtype="<u8") * np.uint64(0xD6E8FEB86659FD93))
        self.space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        self.up = self.down = np.ones(1, "<u8")
        self._reach(self.STEP)

    def _reach(self, size: int) -> None:
        if len(self.up) < size:
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                got = np.full(size, base, "<u8")
                got[0] = 1
                setattr(self, name, np.cumprod(got))

    def __call__(self, texts: list[bytes | None], tails: bool = False) -> tuple[np.ndarray, ...]:
        """(hashes of all words in order, number of words of each text); if asked for, each word's last three bytes
        as a number, too."""
        sizes = np.array([len(t) if t else 0 for t in texts], "int64") + 1
        b = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]).lower(), "u1")
        self._reach(len(b) + 1)
        word = ~self.space[b]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[::2], edge[1::2]  # the last byte is a line end
        sums = np.concatenate([np.zeros(1, "<u8"), np.cumsum(self.value[b] * self.up[: len(b)], dtype="<u8")])
        h = scramble((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype("<u8"))
        places = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        if tails:
            b = np.concatenate([b, np.zeros(2, "u1")])  # places before the first byte read these
            tail = np.zeros(len(ends), "int64")
            for k in range(1, 4):
                tail = tail * 256 + np.where(ends - k >= starts, b[ends - k], 0)
            return h, np.diff(places), tail
        return h, np.diff(places)

    def batches(self, ids: list, texts: list[bytes | None], tails: bool = False):
        """(ids, hashes, counts) of parts of about STEP bytes; a longer text is a part of its own."""
        at, held = 0, 0
        for k, t in enumerate(texts):
            size = len(t) + 1 if t else 1
            if held and held + size > self.STEP:
                yield ids[at:k], *self(texts[at:k], tails)
                at, held = k, 0
            held += size
        if at < len(texts):
            yield ids[at:], *self(texts[at:], tails)


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each is linked to, by any number of links): each round hooks the larger of two
    linked roots to the smaller, which leaves at most half of the roots that still have links."""
    node, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    a, b, root = at[: len(lo)], at[len(lo) :], np.arange(len(node))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return node, node[root]


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, comp): comp is the smallest node that links reach. Only linked nodes are returned.

    At most FEW distinct links between longs are merged on the driver at once: a round below is several shuffles, whose
    plans, tasks and threads the driver holds as well. More links are merged in alternating large-star and small-star rounds over a staged edge table, until no edge changes; every step is a
    groupBy with map-side combine followed by a join on the node, so a star of any size stays spread over tasks.
    """
    edges = links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi").distinct()
    edges = stage(edges, "cc0")
    if all(f.dataType == LONG for f in edges.schema) and edges.count() <= FEW:
        few = edges.toArrow()
        node, comp = merged(few.column(0).to_numpy(), few.column(1).to_numpy())
        unstage(edges)
        return edges.sparkSession.createDataFrame(pa.table({"node": node, "comp": comp}), schema(node=LONG, comp=LONG))
    before = None
    for k in range(1, rounds + 1):
        # large star: each node's larger neighbours link to the least node around it
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select(F.col("hi"), F.col("lo")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = large.where("lo <> hi").distinct()
        # small star: each node links its smaller neighbours, and itself, to the least of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("hi")))).alias("e")).select("e.*")
        new = stage(small.where("lo <> hi").distinct(), f"cc{k}")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        unstage(edges)
        edges = new
        if before == now:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("hi").agg(F.min("lo").alias("comp")).withColumnRenamed("hi", "node").union(edges.select("lo", "lo").distinct())


LONG, INT, DOUBLE, STRING, BINARY = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BinaryType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
