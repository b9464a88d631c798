"""N-gram Jaccard join: exact links between documents by a prefix-tree join, and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD, WordHasher, binary_texts, components, power_of_two, release, scramble, stage, unstage

MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: n-grams that a task holds before it counts them early, and before it deals them out.
CHUNK, HELD = 2_000_000, 600_000
#: n-grams of a range of hashes, which one Python call sorts.
RANGE = 3_000_000
#: An n-gram in so many sets of one chunk is counted early, and is hot if the early counts come to the share HOT of all sets.
LOCAL, HOT, LEAST_HOT = 8, 1 / 512, 4096
#: An n-gram as a number: its level (0 to 30: 2 ** level sets at most; 31: hot) above so many bits of its hash. Numeric
#: order is the global order, rare first.
BITS, HOT_LEVEL = 58, 31
#: Elements of one trie.
TRIE = 100_000
#: Sets of one element that its other sets are compared with, and candidates a set has in that step.
PIVOTS = 3


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """The set of word n-grams of each text, as ascending 64-bit hashes. Fewer words than n are one n-gram; no word,
    no n-gram."""
    size = len(hashes) - n + 1
    x = np.zeros(max(size, 0), "<u8")
    for i in range(n):
        x = (x ^ hashes[i : i + size]) * np.uint64(MIX[i % 6]) + np.uint64(i)
        x ^= x >> np.uint64(32)
    x = scramble(x)
    out, at = [], 0
    for k in counts.tolist():
        if k >= n:
            own = np.sort(x[at : at + k - n + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif k:
            one = xxhash.xxh3_64_intdigest(hashes[at : at + k].tobytes(), seed=k)
            out.append(np.array([one], "<u8"))
        else:
            out.append(np.zeros(0, "<u8"))
        at += k
    return out


def _print(own: np.ndarray) -> int:
    """A set's fingerprint: what stands for all documents with that set."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """(id, fingerprint, set) of whole texts."""
    hasher = WordHasher()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for ids, hashes, counts in hasher.batches(part.column(0).to_pylist(), binary_texts(part, 1)):
                for doc, own in zip(ids, shingle_sets(hashes, counts, n), strict=True):
                    yield doc, _print(own) if len(own) else 0, own


class _Met(set):
    """Fingerprints that a task has met lately; bounded."""

    def new(self, fp: int) -> bool:
        if fp in self:
            return False
        if len(self) > 500_000:
            self.clear()
        self.add(fp)
        return True


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _prints(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """One row a document (id, n, fp), and rows (h, k) of n-grams that k sets of a chunk hold, k at least LOCAL."""
    kind = docs.schema[id_col].dataType
    fields = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("h", T.LongType()), T.StructField("k", T.IntegerType())])
    arrow = pa.schema([("id", to_arrow_type(kind)), ("n", pa.int64()), ("fp", pa.int64()), ("h", pa.int64()), ("k", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, size, met = ([], [], []), [], 0, _Met()

        def out() -> Iterator[pa.RecordBatch]:
            some = len(rows[0])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, arrow.types[:3], strict=True)] + [pa.nulls(some, t) for t in arrow.types[3:]], schema=arrow)
            if held:
                h = np.sort(np.concatenate(held))
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                k = np.diff(np.append(first, len(h)))
                h, k = h[first][k >= LOCAL], k[k >= LOCAL]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(h), t) for t in arrow.types[:3]] + [pa.array(h.view("<i8")), pa.array(k.astype("<i4"))], schema=arrow)

        for doc, fp, own in _sets(batches, n):
            for x, v in zip(rows, (doc, len(own), fp), strict=True):
                x.append(v)
            if len(own) and met.new(fp):  # copies do not make their n-grams frequent
                held.append(own)
                size += len(own)
            if size >= CHUNK or len(rows[0]) >= 50_000:
                yield from out()
                rows, held, size = ([], [], []), [], 0
        yield from out()
        release()

    return _texts(docs, id_col, text_col).mapInArrow(run, fields)


def _six(h: np.ndarray) -> bytes:
    """The low six bytes of each number."""
    return np.ascontiguousarray(h.astype("<u8").view("u1").reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), "u1")
    out[:, :6] = np.frombuffer(data, "u1").reshape(-1, 6)
    return out.view("<u8").ravel()


def _runs(key: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal keys, which also end at the edges."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    new[edges[edges < len(key)]] = True
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(key)))


def _dealt(part: np.ndarray, parts: int, s: np.ndarray, n: np.ndarray, data: np.ndarray, code) -> Iterator[tuple]:
    """(part, s, n, k, data) of n-grams in the order of their sets: sets are named once a part, with the number k of their n-grams."""
    by = np.argsort(part, kind="stable")
    part, s, n, data = part[by], s[by], n[by], data[by]
    edges = np.searchsorted(part, np.arange(parts + 1))
    first, k = _runs(s, edges)
    runs = np.searchsorted(first, edges)
    for p in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        a, z = runs[p], runs[p + 1]
        own = first[a:z]
        yield p, s[own].tobytes(), n[own].tobytes(), k[a:z].astype("<u4").tobytes(), code(data[edges[p] : edges[p + 1]])


BLOBS = "part int, s binary, n binary, k binary, data binary"
_BLOBS = pa.schema([("part", pa.int32()), ("s", pa.binary()), ("n", pa.binary()), ("k", pa.binary()), ("data", pa.binary())])


def _all(rows: pd.DataFrame, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows[column]), kind)


def _postings(docs: DataFrame, id_col: str, text_col: str, n: int, parts: int, hot: Broadcast) -> DataFrame:
    """All n-grams of all sets, dealt to `parts` ranges of hashes; those of hot n-grams by set to as many parts again."""
    bits = parts.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, size, met, known = [], [], 0, _Met(), hot.value

        def out() -> pa.RecordBatch:
            h, sizes = np.concatenate(held), np.array([len(x) for x in held])
            s, k = np.repeat(np.array(names, "<i8"), sizes), np.repeat(sizes.astype("<u4"), sizes)
            wide = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
            rows = []
            x = h[~wide]
            part = (x >> np.uint64(64 - bits)).astype("int32") if bits else np.zeros(len(x), "int32")
            rows += _dealt(part, parts, s[~wide], k[~wide], x >> np.uint64(16 - bits) if bits < 16 else x, _six)
            if wide.any():
                part = (scramble(s[wide].view("<u8")) % np.uint64(parts)).astype("int32")
                rows += [(p + parts, *rest) for p, *rest in _dealt(part, parts, s[wide], k[wide], h[wide], np.ndarray.tobytes)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOBS.types, strict=True)], schema=_BLOBS)

        for _, fp, own in _sets(batches, n):
            if len(own) and met.new(fp):
                held.append(own)
                names.append(fp)
                size += len(own)
                if size >= HELD:
                    yield out()
                    held, names, size = [], [], 0
        if held:
            yield out()
        release()

    return _texts(docs, id_col, text_col).mapInArrow(run, BLOBS)


def _shared(postings: DataFrame, parts: int) -> DataFrame:
    """The n-grams that at least two sets hold, as numbers in the global order, dealt to `parts` ranges of sets."""
    bits = parts.bit_length() - 1

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s, n, k = _all(rows, "s", "<i8"), _all(rows, "n", "<u4"), _all(rows, "k", "<u4")
        of = np.repeat(np.arange(len(k), dtype="<u4"), k)  # the run of each n-gram
        if key[0] >= parts:
            h = (_all(rows, "data", "<u8") >> np.uint64(64 - BITS)) + np.uint64(HOT_LEVEL << BITS)
            s, n = s[of], n[of]
        else:
            h = np.concatenate([_from_six(x) for x in rows["data"]])
            by = np.argsort(h)
            h = h[by]
            some = np.zeros(len(h), bool)
            some[1:] = h[1:] == h[:-1]
            some[:-1] |= some[1:]
            h, of = h[some], of[by[some]]
            del by, some
            s, n = s[of], n[of]
            by = np.lexsort((s, h))
            h, s, n = h[by], s[by], n[by]
            new = np.ones(len(h), bool)  # a set that several tasks met is one
            new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
            h, s, n = h[new], s[new], n[new]
            _, k = _runs(h, np.zeros(0, "int64"))
            k = np.repeat(k, k)
            h, s, n, k = h[k > 1], s[k > 1], n[k > 1], k[k > 1]
            level = np.minimum(HOT_LEVEL - 1, np.ceil(np.log2(np.maximum(k, 2)))).astype("<u8")
            # the hash again: the range's bits and six bytes below them, cut or filled to BITS
            low = BITS - bits - 48
            h = h << np.uint64(low) if low >= 0 else h >> np.uint64(-low)
            h = h + np.uint64(int(key[0]) << (BITS - bits)) + (level << np.uint64(BITS))
        by = np.argsort(s, kind="stable")
        s, n, h = s[by], n[by], h[by]
        out = list(_dealt((scramble(s.view("<u8")) % np.uint64(parts)).astype("int32"), parts, s, n, h, np.ndarray.tobytes)) if len(s) else []
        del s, n, h, by, of
        release()
        return pd.DataFrame(out, columns=_BLOBS.names)

    return postings.groupBy("part").applyInPandas(run, BLOBS)


def _reduced(shared: DataFrame, percent: int) -> DataFrame:
    """(s, n, r, own, cls): sets of n n-grams as the r of them that other sets hold too, in the global order. What two
    sets have in common lies in these; a set with fewer of them than it must share with another is left out. cls is
    the same for the same n-grams."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k = _all(rows, "k", "<u4")
        s, n, h = np.repeat(_all(rows, "s", "<i8"), k), np.repeat(_all(rows, "n", "<u4"), k), _all(rows, "data", "<u8")
        del rows
        by = np.lexsort((h, s))
        s, n, h = s[by], n[by], h[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        s, n, h = s[new], n[new], h[new]
        first, r = _runs(s, np.zeros(0, "int64"))
        found = []
        for a, z in zip(first.tolist(), r.tolist(), strict=True):
            if 100 * z >= percent * int(n[a]):
                own = h[a : a + z].tobytes()
                found.append((int(s[a]), int(n[a]), z, own, xxhash.xxh3_64_intdigest(own) - (1 << 63)))
        del s, n, h, by
        release()
        return pd.DataFrame(found, columns=["s", "n", "r", "own", "cls"])

    return shared.groupBy("part").applyInPandas(run, "s long, n int, r int, own binary, cls long")


def _prefixes(reduced: DataFrame, percent: int) -> DataFrame:
    """(h, s, n, left, head): of each set, its first n-grams in the global order, and how many are left from each on.

    Two sets that link have an n-gram in common among the first n - ceil(percent * n) + 1 of either, n being its
    size; and the first one in common is in the smaller set's head, where the n-grams from there on can still make up
    what two sets of its size need to share. n-grams that no other set holds come first of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                cols = ([], [], [], [], [])
                for x in batch.slice(at, 200).to_pylist():
                    own, size, r = np.frombuffer(x["own"], "<i8"), x["n"], x["r"]
                    some = r - -(-percent * size // 100) + 1
                    left = r - np.arange(some)
                    for c, v in zip(cols, (own[:some], np.full(some, x["s"]), np.full(some, size), left, left >= -(-2 * percent * size // (100 + percent))), strict=True):
                        c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["h", "s", "n", "left", "head"])

    return reduced.select("s", "n", "r", "own").mapInArrow(run, "h long, s long, n int, left int, head boolean")


class Trie:
    """Sets in the global order as the paths of a prefix tree: sorted, they are its leaves from left to right, and
    what neighbours have in common is the path that they share."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes, self.lengths = sizes[self.order], np.array([len(x) for x in self.sets])
        self.common = np.zeros(len(sets), "int64")  # how much of the path a leaf shares with the one before
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            self.common[i] = differ.argmax() if m and differ.any() else m
        # each part of a path is kept once, with the leaf that comes first of those below it
        parts = [x[c:] for x, c in zip(self.sets, self.common.tolist(), strict=True)]
        self.elements, self.edges = np.unique(np.concatenate([np.zeros(0, "<u8"), *parts]), return_inverse=True)
        self.ends = np.cumsum([len(x) for x in parts], dtype="int64")
        self.starts = self.ends - (self.lengths - self.common)
        self.parent, self.leave = [-1] * len(sets), np.zeros(len(sets), "int64")  # whose part a path goes on from, and where
        open_: list[int] = []
        for i, c in enumerate(self.common.tolist()):
            while open_ and self.common[open_[-1]] >= c:
                open_.pop()
            if open_:
                self.parent[i] = open_[-1]
                self.leave[i] = self.starts[open_[-1]] + c - self.common[open_[-1]]
            open_.append(i)
        self.from_ = np.where(np.array(self.parent, "int64") >= 0, self.starts[np.maximum(self.parent, 0)], 0) if sets else self.leave

    def linked(self, probe: np.ndarray, size: int, percent: int, among: np.ndarray) -> list[int]:
        """The leaves, of those marked in `among`, whose sets link with the probe.

        Where a path leaves the one before, what is shared up to there and what is left on both sides must reach what
        the leaf needs. A path's overlap with the probe is summed once from the root, and a leaf takes over the sum of
        the path that it shares; all parts of paths are summed in one step.
        """
        need = -(-percent * (size + self.sizes) // (100 + percent))
        open_ = among & (need <= np.minimum(self.lengths, len(probe)))
        if not open_.any():
            return []
        some = np.flatnonzero(open_ & (self.lengths > self.common))
        before = np.searchsorted(probe, self.elements[self.edges[self.starts[some]]])
        reach = np.minimum(self.common[some], before) + np.minimum(self.lengths[some] - self.common[some], len(probe) - before)
        open_[some] = reach >= need[some]
        if not open_.any():
            return []
        held = np.zeros(len(self.elements), bool)
        at = np.minimum(np.searchsorted(self.elements, probe), len(self.elements) - 1)
        held[at[self.elements[at] == probe]] = True
        sums = np.concatenate([np.zeros(1, "int64"), np.cumsum(held[self.edges], dtype="int64")])
        base: list[int] = []
        for p, up in zip(self.parent, (sums[self.leave] - sums[self.from_]).tolist(), strict=True):
            base.append(base[p] + up if p >= 0 else 0)
        overlap = np.array(base, "int64") + sums[self.ends] - sums[self.starts]
        return [self.order[i] for i in np.flatnonzero(open_ & (overlap >= need)).tolist()]


def trie_join(probe: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets link with the probe; all are whole sets in the global order."""
    linked = np.zeros(len(sets), bool)
    linked[Trie(sets, np.array([len(x) for x in sets])).linked(probe, len(probe), percent, np.ones(len(sets), bool))] = True
    return linked


def trie_links(sets: list[np.ndarray], sizes: np.ndarray, comps: list, probes: list[int], percent: int) -> list[tuple[int, int]]:
    """Links of the probes with the sets, by place, that join the components which the sets are in; links inside a
    component are passed over."""
    trie, found = Trie(sets, sizes), []
    ids = {c: k for k, c in enumerate(dict.fromkeys(comps))}
    comp = np.array([ids[c] for c in comps])
    at = np.empty(len(sets), "int64")
    at[trie.order] = np.arange(len(sets))
    leaf = comp[trie.order]  # component of each leaf
    for p in probes:
        among = leaf != leaf[at[p]]
        if not among.any():
            continue
        for q in trie.linked(sets[p], int(sizes[p]), percent, among):
            if leaf[at[q]] != leaf[at[p]]:
                found.append((p, q))
                leaf[leaf == leaf[at[q]]] = leaf[at[p]]
    return found


def _joined(groups: DataFrame, reduced: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of groups (g, block, s, c, probe): each is a trie, walked by its probes; c is the set's component."""

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "s"]).drop_duplicates("s")
        probes = np.flatnonzero(rows["probe"].to_numpy()).tolist()
        s = rows["s"].to_numpy()
        found = trie_links([np.frombuffer(x, "<u8") for x in rows["own"]], rows["n"].to_numpy().astype("int64"), rows["c"].tolist(), probes, percent) if probes and len(rows) > 1 else []
        return pd.DataFrame({"a": s[[p for p, _ in found]], "b": s[[q for _, q in found]]}, dtype="int64")

    own = groups.groupBy("g", "block", "s", "c").agg(F.max("probe").alias("probe")).join(reduced.select("s", "n", "own"), "s")
    return stage(own.groupBy("g", "block").applyInPandas(join, "a long, b long"), "links")


def _blocks(elements: Column) -> Column:
    return F.greatest(F.ceil(elements / TRIE).cast("int"), F.lit(1))


def _block(s: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(s, F.lit(5)), blocks).cast("int")


def _by_first(lists: DataFrame) -> DataFrame:
    """Groups of sets by their first n-gram that is in a list. A large group is dealt into blocks, each with the
    group's smallest set."""
    home = lists.groupBy("s").agg(F.min("h").alias("g"), F.max("n").alias("n"))
    size = home.groupBy("g").agg(_blocks(F.sum("n")).alias("blocks"), F.min(F.struct("n", "s"))["s"].alias("least"), F.count("*").alias("k")).where("k > 1")
    home = home.join(size, "g")
    own = home.select("g", _block(F.col("s"), F.col("blocks")).alias("block"), "s")
    hub = size.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("least").alias("s"))
    return own.union(hub).distinct().select("g", "block", "s", F.col("s").alias("c"), F.lit(True).alias("probe"))


def _stars(lists: DataFrame, reach: str) -> DataFrame:
    """Groups of a drawn set and sets in other components: each set with at most PIVOTS of the drawn ones of its lists,
    those with which it shares most."""
    pivot = lambda k: F.min(F.when(F.col("head"), F.struct(F.xxhash64("s", F.lit(k)).alias("o"), F.col("s").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("c").alias("ca"))))
    drawn = F.array_distinct(F.array(*[pivot(k).dropFields("o") for k in range(PIVOTS)]))
    pivots = lists.groupBy("h").agg(drawn.alias("pivots")).where("pivots[0] IS NOT NULL")
    pairs = lists.select("h", "w", F.col("s").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("c").alias("cb")).join(pivots, "h")
    pairs = pairs.select("w", "b", "nb", "lb", "cb", F.explode("pivots").alias("v")).select("w", "b", "nb", "lb", "cb", "v.*").where(f"ca <> cb AND {reach}")
    nearest = Window.partitionBy("b").orderBy(F.desc("k"), "a")
    pairs = pairs.groupBy("a", "ca", "b", "cb", "nb").agg(F.sum("w").alias("k")).withColumn("i", F.row_number().over(nearest)).where(F.col("i") <= PIVOTS)
    size = pairs.groupBy("a", "ca").agg(_blocks(F.sum("nb")).alias("blocks"))
    own = pairs.join(size.drop("ca"), "a").select(F.col("a").alias("g"), _block(F.col("b"), F.col("blocks")).alias("block"), F.col("b").alias("s"), F.col("cb").alias("c"), F.lit(False).alias("probe"))
    return own.union(size.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), F.col("a").alias("s"), "ca", F.lit(True)))


def _whole(lists: DataFrame) -> DataFrame:
    """Groups of all sets of each list. The sets outside the list's largest component are its probes, and meet all its
    sets, so that any two of different components meet.

    Lists with the same largest component are one group, where that makes no more pairs of probe and set than the
    lists do: copies of one text share most of their n-grams, and would meet again in each list. The sets of a group
    are dealt into blocks, its probes too, and each block of the one meets each of the other."""
    parts = lists.groupBy("h", "c").agg(F.count("*").alias("k"))
    size = parts.groupBy("h").agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.sum("k").alias("k"), F.max("k").alias("most"))
    listed = stage(lists.select("h", "s", "c", "n").join(size.select("h", "main"), "h"), "listed")
    apart = size.groupBy("main").agg(F.sum(F.col("k") * (F.col("k") - F.col("most"))).alias("pairs"))
    probe = F.col("c") != F.col("main")
    once = listed.groupBy("main", "s").agg(F.max(probe.cast("int")).alias("p"))
    one = once.groupBy("main").agg((F.count("*") * F.sum("p")).alias("merged")).join(apart, "main").where("merged <= pairs").select(F.col("main"), F.lit(True).alias("one"))
    at = listed.join(one, "main", "left").withColumn("g", F.when(F.col("one"), F.xxhash64("main", F.lit(7))).otherwise(F.col("h")))
    at = stage(at.groupBy("g", "s", "c", "main").agg(F.max("n").alias("n")).withColumn("probe", probe), "whole")
    unstage(listed)
    blocks = at.groupBy("g").agg(_blocks(F.sum("n")).alias("across"), _blocks(F.sum(F.when(F.col("probe"), F.col("n")).otherwise(0))).alias("down"))
    at = at.join(blocks, "g")
    leaf = at.select("g", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), _block(F.col("s"), F.col("across")).alias("j"), "across", "s", "c", F.lit(False).alias("probe"))
    asks = at.where("probe").select("g", _block(F.col("s"), F.col("down")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"), "across", "s", "c", "probe")
    return leaf.union(asks).select("g", (F.col("i") * F.col("across") + F.col("j")).alias("block"), "s", "c", "probe")


def _apart(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """The lists whose sets are in several components, each set with its component."""
    own = lists.join(comps.select(F.col("node").alias("s"), "comp"), "s", "left").withColumn("c", F.coalesce("comp", "s")).drop("comp")
    own = stage(own, "in_comp")
    mixed = own.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("z"), F.max("head").alias("some")).where("x < z AND some").select("h")
    return own.join(mixed, "h", "left_semi")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The components of documents whose sets of word n-grams have a Jaccard similarity of at least percent / 100.

    Words are runs without white space, A-Z in lower case. Documents with equal sets are one set; only sets are
    compared. Steps:
    1. fingerprints of all sets;
    2. all n-grams are shuffled by hash and counted exactly. From here on a set is the n-grams that other sets hold too,
       ordered by count (rare first) and hash, and its size; n-grams that it holds alone come before them. Sets that
       cannot share enough are dropped;
    3. of sets that are equal now, those that link with the smallest are joined to it: what links with them links with it;
    4. the first n-grams of each set make lists of the sets that hold them; lists of the same sets are one;
    5. prefix trees find the links: first over sets with the same first n-gram; then, in lists whose sets are still in
       different components, between each set and a few drawn ones; then over whole lists still so. Trees are of
       bounded size: in a long list, sets of its largest component are dealt out, the others meet all of them.
    A link between two sets is thereby found, or both are in one component already: none is lost.

    Null, empty and wordless texts have an empty set and link with nothing. Rows that repeat an id are one document:
    their sets count as linked. Rows with a null id are left out of all links and have a null component. Very long
    texts are taken whole. An empty table gives an empty result. Other columns play no part, whatever their names.
    Sets are told apart by 64-bit hashes, n-grams by the first bits of theirs, 48 and those of the range of hashes.

    n-grams held by a share HOT of all sets and more would make one range large. They are found beforehand, from counts
    by chunk, and go by set, without being counted; there are at most 1 / HOT times the mean size of a set of them.

    Returns id, n_shingles, component_id (the smallest id of the component) for every row.
    """
    spark = docs.sparkSession
    prints = stage(_prints(docs, id_col, text_col, n), "prints")
    found = prints.where("n IS NOT NULL").select("id", "n", "fp")
    sets, grams = found.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = prints.where("k IS NOT NULL").groupBy("h").agg(F.sum("k").alias("k")).where(F.col("k") >= max(LEAST_HOT, sets * HOT)).select("h")
    hot = spark.sparkContext.broadcast(np.sort(np.array([x["h"] for x in hot.collect()], "<i8").view("<u8")))
    parts = power_of_two(grams / RANGE, 16, 1 << 16)
    known = docs.where(F.col(id_col).isNotNull())
    reduced = stage(_reduced(_shared(_postings(known, id_col, text_col, n, parts, hot), parts), percent), "reduced")

    least = reduced.groupBy("cls").agg(F.min(F.struct("n", "s")).alias("m")).select("cls", F.col("m.n").alias("na"), F.col("m.s").alias("a"))
    equal = reduced.select("s", "n", "r", "cls").join(least, "cls").where(f"s <> a AND {100 + percent}L * r >= {percent}L * (n + na)")
    equal = stage(equal.select("a", F.col("s").alias("b")), "equal")
    # Two sets whose first common n-gram is at these places can share no more than what is left from there on in either.
    reach = f"{100 + percent}L * least(la, lb) >= {percent}L * (na + nb)"
    first = _prefixes(reduced, percent).join(equal.select(F.col("b").alias("s")), "s", "left_anti")
    same = first.groupBy("h").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("s")).alias("who"), F.min("n").alias("smallest"), F.max("head").alias("some")).where("k > 1 AND some")
    same = same.groupBy("k", "who").agg(F.min("h").alias("h"), F.count("*").alias("w"), F.min("smallest").alias("smallest")).drop("k", "who")
    lists = first.join(same, "h").where(f"{100 + percent}L * left >= {percent}L * (n + smallest)").drop("smallest")
    lists = stage(lists, "lists")

    by_id = found.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").drop("z")
    links = equal.union(found.where("n > 0").join(by_id, "id").where("fp > a").select("a", F.col("fp").alias("b")))
    links = links.union(_joined(_by_first(lists), reduced, percent))
    comps = stage(components(links), "comps")
    apart = stage(_apart(lists, comps), "apart")
    if not apart.isEmpty():
        links = links.union(_joined(_stars(apart, reach), reduced, percent))
        comps = stage(components(links), "comps")
        apart = stage(_apart(lists, comps), "apart")
        if not apart.isEmpty():
            links = links.union(_joined(_whole(apart), reduced, percent))
            comps = stage(components(links), "comps")
    unstage(reduced, lists, apart)
    out = found.join(comps, found["fp"] == comps["node"], "left").select("id", "n", F.coalesce("comp", "fp").alias("c"))
    out = stage(out, "members")
    first = out.where("n > 0 AND id IS NOT NULL").groupBy("c").agg(F.min("id").alias("first"))
    out = out.join(first, "c", "left").select("id", "n", F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("first"))).otherwise(F.col("id")).alias("own"))
    return out.toDF(id_col, "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with exactly one row of each component: one with its id, with words if any row of that id has some.

    Rows that repeat an id are one document. Rows with a null id are documents of their own here, behind all others in
    order, so copies among them and of other documents go too. Documents without words link with nothing and stay.
    Only rows of repeated ids are shuffled, at most one of an id from each task.
    """
    if not docs.where(F.col(id_col).isNull()).isEmpty():
        none = F.col(id_col).isNull()
        key = F.struct(none.alias("none"), F.col(id_col).alias("id"), F.when(none, F.monotonically_increasing_id()).otherwise(-1).alias("row"))
        return keep_one(stage(docs.withColumn("__key", key), "keyed"), n, percent, "__key", text_col).drop("__key")
    found = near_duplicates(docs, n, percent, id_col, text_col)
    ids = stage(found.groupBy(F.col(id_col).alias("__id")).agg(F.min("component_id").alias("__c"), F.count("*").alias("__rows")).where("__c <> __id OR __rows > 1"), "ids")
    kept = docs.join(ids, docs[id_col] == ids["__id"], "left_anti")
    again = ids.where("__c = __id").select("__id")
    if again.isEmpty():
        return kept
    words = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    order = Window.partitionBy(id_col).orderBy(words.desc(), text_col)
    one = docs.join(again, docs[id_col] == again["__id"], "left_semi").withColumn("__row", F.row_number().over(order)).where("__row = 1").drop("__row")
    return kept.union(one)
