"""LM scoring: a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, binary_texts, power_of_two, stage

#: Stands for the end of a text among the hashes of words.
END = np.uint64(0x656E64206F662074)
#: Outcomes of the softmax: CLASSES classes of PER outcomes. The first ENDINGS outcomes are groups of words with like
#: endings, then comes the end, then the commonest words, each its own.
CLASSES, PER = 32, 32
OUTCOMES, ENDINGS = CLASSES * PER, 511
#: Contexts: the outcomes, and the begin of a text.
BEGIN = OUTCOMES
CONTEXTS = OUTCOMES + 1
#: Bits of a word's hash that hold its group.
GROUP = np.uint64(511)
#: Rows of the hashed feature tables, at least and at most; between, twice the root of the training tokens.
LEAST_ROWS, MOST_ROWS = 1 << 13, 1 << 18
CHUNK = 400_000


def named(hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Hashes of words with the group of their last three bytes in the lowest bits."""
    return (hashes & ~GROUP) | ((tails * 0x9E3779B1 >> 8) % ENDINGS).astype("<u8")


@dataclass
class Model:
    """Vocabulary and weights: biases, and one row for each previous word, word before it (skip), and hashed pair, by
    class; and for each hashed (previous word, class) and (skip, class) cell, by outcome of the class.

    A word without an outcome of its own is told apart inside its group by its count; words never met have the share of
    the group's tokens that were met once, which is how often a token is new (Good and Turing), as one word."""

    hashes: np.ndarray  # of the commonest training words, by count
    counts: np.ndarray
    n: int  # training tokens
    v: int  # distinct ones
    groups: np.ndarray  # by group: tokens, distinct words, words met once
    class_bias: np.ndarray = None
    word_bias: np.ndarray = None
    tables: list[np.ndarray] = None

    def __post_init__(self) -> None:
        end = int(END)
        self.rows = power_of_two(2 * self.n**0.5, LEAST_ROWS, MOST_ROWS)
        top = [(h, c) for h, c in zip(self.hashes[:OUTCOMES].tolist(), self.counts[:OUTCOMES].tolist(), strict=True) if h != end][: OUTCOMES - ENDINGS - 1]
        own = [(end, int(c)) for c in self.counts[self.hashes == end]] or [(end, 0)]
        self.chosen = [*own, *top]  # outcomes ENDINGS, ENDINGS + 1, ...
        left = self.groups.astype("float64")
        for h, c in top:
            left[h & int(GROUP)] -= (c, 1, c == 1)
        tokens, types, once = left.T
        self.new = (once + 0.5) / (tokens + 1)
        self.held = tokens + 0.1 * types
        n = np.zeros(OUTCOMES)
        n[:ENDINGS] = tokens
        n[ENDINGS : ENDINGS + len(self.chosen)] = [c for _, c in self.chosen]
        live = np.arange(OUTCOMES) < ENDINGS + len(self.chosen)
        n = (n + np.where(live, 0.5, 0)).reshape(CLASSES, PER)
        with np.errstate(divide="ignore"):
            self.class_bias = np.maximum(np.log(n.sum(1) / n.sum()), -1e9).astype("float32")
            self.word_bias = np.maximum(np.log(n / np.maximum(n.sum(1, keepdims=True), 1e-300)), -1e9).astype("float32")
        self.shapes = [(CONTEXTS, CLASSES), (CONTEXTS, CLASSES), (self.rows, CLASSES), (self.rows, PER), (self.rows, PER)]
        self.tables = [np.zeros(s, "float32") for s in self.shapes]

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def inside(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log10 of a word's share of its group, for words without an outcome of their own; count 0: of all new ones."""
        k = (hashes & GROUP).astype("int64")
        known = (1 - self.new[k]) * (counts + 0.1) / np.maximum(self.held[k], 1e-300)
        return np.log10(np.where(counts > 0, known, self.new[k]))


class Words:
    """Looks up many word hashes at once: place among the common words (-1: not there), context and outcome."""

    SLOTS = 22

    def __init__(self, model: Model):
        self.hashes = model.hashes
        self.order = np.argsort(model.hashes).astype("int32")
        self.ascending = model.hashes[self.order]
        # a slot for each range of hashes holds one of its words; words of crowded slots are searched for
        slot = self._slot(model.hashes)
        self.first = np.full(1 << self.SLOTS, -1, "int32")
        self.first[slot[::-1]] = np.arange(len(slot), dtype="int32")[::-1]
        self.crowded = np.zeros(1 << self.SLOTS, bool)
        self.crowded[slot[self.first[slot] != np.arange(len(slot))]] = True
        self.outcome = np.full(len(model.hashes) + 1, -1)  # of words with one of their own; the last is that of place -1
        place = {h: i for i, h in enumerate(model.hashes.tolist())}
        for i, (h, _) in enumerate(model.chosen):
            if h in place:
                self.outcome[place[h]] = ENDINGS + i

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.SLOTS)).astype("int64")

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1, "int32")
        slot = self._slot(hashes)
        at = self.first[slot]
        at = np.where(self.hashes[at] == hashes, at, -1)
        rest = np.flatnonzero((at < 0) & self.crowded[slot])
        if len(rest):
            k = np.minimum(np.searchsorted(self.ascending, hashes[rest]), len(self.ascending) - 1)
            at[rest] = np.where(self.ascending[k] == hashes[rest], self.order[k], -1)
        return at


@dataclass
class Tokens:
    """Tokens of some texts in order, each text closed by an end."""

    hash: np.ndarray
    at: np.ndarray
    out: np.ndarray


class Chunk:
    """Tokens of some texts with the features of their contexts. Equal contexts are computed once."""

    def __init__(self, tokens: Tokens, lengths: np.ndarray, rows: int):
        x, self.size = tokens.out, rows
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype("int64")
        one = np.concatenate([[BEGIN], x[:-1]])
        one[start] = BEGIN
        two = np.concatenate([[BEGIN], one[:-1]])
        two[start] = BEGIN
        out = tokens.out
        key, self.of, self.n = np.unique(one * CONTEXTS + two, return_inverse=True, return_counts=True)
        a, b = key // CONTEXTS, key % CONTEXTS
        self.rows = [a, b, (key * 0x9E3779B1 >> 7) % rows]
        self.cls, self.within = out // PER, out % PER
        cell, self.cell_of, self.cell_n = np.unique(self.of * CLASSES + self.cls, return_inverse=True, return_counts=True)
        u, self.cell_class = cell // CLASSES, cell % CLASSES
        self.rows += [(a[u] * CLASSES + self.cell_class) * 0x9E3779B1 % 0x1FFFFFFF % rows, ((b[u] * CLASSES + self.cell_class) * 0x85EBCA6B + 77) % 0x1FFFFFFF % rows]

    def observed(self, m: Model) -> list[np.ndarray]:
        got = []
        for t, (rows, (size, width)) in enumerate(zip(self.rows, m.shapes, strict=True)):
            of, col = (self.of, self.cls) if t < 3 else (self.cell_of, self.within)
            got.append(np.bincount(rows[of] * width + col, minlength=size * width).reshape(size, width).astype("float32"))
        return got

    def cell_classes(self) -> list[np.ndarray]:
        """For the rows of the cell tables, how many tokens are of each class."""
        return [np.bincount(self.rows[t] * CLASSES + self.cell_class, weights=self.cell_n, minlength=self.size * CLASSES).reshape(self.size, CLASSES).astype("float32") for t in (3, 4)]

    def logs(self, m: Model, level: int, a: int, z: int) -> np.ndarray:
        """Log probabilities of classes (level 0), or of the words of each cell's class (1)."""
        pick = range(3) if not level else range(3, 5)
        x = (m.word_bias[self.cell_class[a:z]] if level else np.broadcast_to(m.class_bias, (z - a, CLASSES))).copy()
        for t in pick:
            x += m.tables[t][self.rows[t][a:z]]
        x -= x.max(1, keepdims=True)
        return x - np.log(np.exp(x).sum(1, keepdims=True))

    def expected(self, m: Model) -> list[np.ndarray]:
        got = [np.zeros(s, "float32") for s in m.shapes]
        for level, n in ((0, self.n), (1, self.cell_n)):
            for a in range(0, len(n), 65_536):
                z = min(len(n), a + 65_536)
                p = np.exp(self.logs(m, level, a, z)) * n[a:z, None].astype("float32")
                for t in range(3) if not level else range(3, 5):
                    rows = self.rows[t][a:z]
                    order = np.argsort(rows, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) != 0]))
                    got[t][rows[order[first]]] += np.add.reduceat(p[order], first, axis=0)
        return got

    def score(self, m: Model) -> np.ndarray:
        """Log10 probability of each token's outcome."""
        at = np.empty((len(self.n), CLASSES), "float32")
        for a in range(0, len(self.n), 65_536):
            z = min(len(self.n), a + 65_536)
            at[a:z] = self.logs(m, 0, a, z)
        got = at[self.of, self.cls].astype("float64")
        del at
        at = np.empty((len(self.cell_n), PER), "float32")
        for a in range(0, len(self.cell_n), 65_536):
            z = min(len(self.cell_n), a + 65_536)
            at[a:z] = self.logs(m, 1, a, z)
        return (got + at[self.cell_of, self.within]) / np.log(10)


def ascend(m: Model, observed: list[np.ndarray], expected: list[np.ndarray], rate: float, prior: float = 1.0) -> None:
    """One step along the gradient, observed less expected counts, each component scaled by the logarithmic mean of
    the two: that is rate * log(observed / expected). The prior draws rare features to no change."""
    for w, o, e in zip(m.tables, observed, expected, strict=True):
        w += rate * np.log((o + prior) / (e + prior)).astype("float32")


def first_expected(m: Model, observed: list[np.ndarray], cells: list[np.ndarray]) -> list[np.ndarray]:
    """What the biases alone expect: features are independent of outcomes then, so counts of features (and of classes
    within a cell's row) suffice, without a pass over the texts."""
    by_class = [o.sum(1, keepdims=True) * np.exp(m.class_bias) for o in observed[:3]]
    return by_class + [c @ np.exp(m.word_bias) for c in cells]


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _chunks(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[tuple[list, Tokens, np.ndarray]]:
    """(ids, tokens, lengths) of whole texts, about CHUNK tokens at a time; one text may be longer."""
    hasher = WordHasher()
    ids, parts, held = [], [], 0

    def out() -> tuple:
        h, counts, tails = (np.concatenate(x) for x in zip(*parts, strict=True))
        lengths = counts + 1
        ends = np.cumsum(lengths) - 1
        word = np.ones(int(lengths.sum()), bool)
        word[ends] = False
        all_h = np.full(len(word), END, "<u8")
        all_h[word] = named(h, tails)
        at = words(all_h)
        outcome = words.outcome[at]
        outcome[ends] = ENDINGS
        outcome = np.where(outcome < 0, (all_h & GROUP).astype("int64"), outcome)
        return ids, Tokens(all_h, at, outcome), lengths

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for some, h, counts, tails in hasher.batches(part.column(0).to_pylist(), binary_texts(part, 1), tails=True):
                ids += some
                parts.append((h, counts, tails))
                held += len(h) + len(some)
                if held >= CHUNK:
                    yield out()
                    ids, parts, held = [], [], 0
    if ids:
        yield out()


def _parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Edges of the parts in ascending hashes."""
    return np.searchsorted(hashes, (np.arange(parts, dtype="float64") * (2.0**64 / parts)).astype("uint64")).tolist() + [len(hashes)]


def count_words(docs: DataFrame, id_col: str, text_col: str, parts: int, most: int = 1_000_000) -> DataFrame:
    """(part, hashes, counts, n, v): counts of all tokens, summed in each task before they are shuffled, by hash range."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, h, n, held, size = WordHasher(), np.zeros(0, "<u8"), np.zeros(0, "<i8"), [], 0

        def merge() -> None:
            nonlocal h, n, size
            own, more = np.unique(np.concatenate(held), return_counts=True)
            both = np.concatenate([h, own])
            order = np.argsort(both, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(both[order]) != 0]))
            n = np.add.reduceat(np.concatenate([n, more])[order], first)
            h = both[order[first]]
            held.clear()
            size = 0

        def out() -> pa.RecordBatch:
            edges = _parts(h, parts)
            rows = [{"part": p, "hashes": h[a:z].tobytes(), "counts": n[a:z].astype("<u4").tobytes()} for p, (a, z) in enumerate(zip(edges, edges[1:], strict=False)) if z > a]
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]))

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for ids, own, _, tails in hasher.batches(part.column(0).to_pylist(), binary_texts(part, 1), tails=True):
                    held += [named(own, tails), np.full(len(ids), END, "<u8")]
                    size += len(own) + len(ids)
                    if size >= 1_000_000:
                        merge()
                        if len(h) >= most:
                            yield out()
                            h, n = np.zeros(0, "<u8"), np.zeros(0, "<i8")
        if held:
            merge()
        if len(h):
            yield out()

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, "<u8") for x in rows["hashes"]])
        n = np.concatenate([np.frombuffer(x, "<u4") for x in rows["counts"]])
        h, of = np.unique(h, return_inverse=True)
        n = np.bincount(of, weights=n).astype("<i8")
        return pd.DataFrame([(key[0], h.tobytes(), n.tobytes(), int(n.sum()), len(n))], columns=["part", "hashes", "counts", "n", "v"])

    each = _tokens(docs, id_col, text_col).mapInArrow(count, "part int, hashes binary, counts binary")
    return each.groupBy("part").applyInPandas(total, "part int, hashes binary, counts binary, n long, v long")


def _common(vocabulary: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest words, at most `most`: a histogram of counts on a fine log scale tells from which count on."""

    def level(n: np.ndarray) -> np.ndarray:
        return (16 * np.log2(n)).astype("int64")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n = np.bincount(level(np.frombuffer(x, "<i8")))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["level", "n"])

    seen = vocabulary.select("counts").mapInArrow(histogram, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
    least, total = 1 << 20, 0
    for x in seen:
        total += x["n"]
        if total > most:
            break
        least = x["level"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, n = np.frombuffer(h, "<u8"), np.frombuffer(n, "<i8")
                keep = level(n) >= least
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view("<i8")), pa.array(n[keep])], names=["h", "n"])

    got = vocabulary.select("hashes", "counts").mapInArrow(pick, "h long, n long").toArrow()
    h, n = got.column(0).to_numpy().view("<u8"), got.column(1).to_numpy()
    order = np.lexsort((h, -n))
    return h[order], n[order]


def _groups(vocabulary: DataFrame) -> np.ndarray:
    """By group of endings: tokens, distinct words, words met once; one row a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, n = np.frombuffer(h, "<u8"), np.frombuffer(n, "<i8")
                h, n = h[h != END], n[h != END]
                k = (h & GROUP).astype("int64")
                sums = [np.bincount(k, weights=x, minlength=ENDINGS).astype("int64") for x in (n, np.ones(len(n)), n == 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS)), *map(pa.array, sums)], names=["k", "tokens", "types", "once"])

    out = np.zeros((ENDINGS, 3), "int64")
    for x in vocabulary.select("hashes", "counts").mapInArrow(run, "k long, tokens long, types long, once long").groupBy("k").agg(F.sum("tokens"), F.sum("types"), F.sum("once")).collect():
        out[x[0]] = x[1:]
    return out


def _summed(docs: DataFrame, model: Model, make) -> list[np.ndarray]:
    """Sum over all texts of the arrays that make(chunk, model) gives: one partial sum a task, added up by block of
    rows on the executors, so the driver gets each block once."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows_per_block = 2048
    # partial sums are as many as tasks, so there are as many as the cluster can run a few times over, not more
    docs = docs.coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, task = None, None, TaskContext.get().partitionId()
        for batch in batches:
            words = words or Words(held.value)
            for _, tokens, lengths in _chunks(iter([batch]), words):
                got = make(Chunk(tokens, lengths, held.value.rows), held.value)
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        for t, x in enumerate(total or []):
            for a in range(0, len(x), rows_per_block):
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([a], pa.int32()), pa.array([task], pa.int32()), pa.array([x[a : a + rows_per_block].astype("<f4").tobytes()], pa.binary())], names=["t", "a", "task", "x"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # always in the same order, so that reruns agree to the last digit
        total = sum(np.frombuffer(x, "<f4").astype("<f8") for x in rows.sort_values("task")["x"])
        return pd.DataFrame([(*key, total.tobytes())], columns=["t", "a", "x"])

    blocks = docs.mapInArrow(run, "t int, a int, task int, x binary").groupBy("t", "a").applyInPandas(add, "t int, a int, x binary").collect()
    held.unpersist()
    out: dict[int, list] = {}
    for t, a, x in sorted(blocks, key=lambda r: (r["t"], r["a"])):
        out.setdefault(t, []).append(np.frombuffer(x, "<f8"))
    return [np.concatenate(out[t]) for t in sorted(out)]


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", common: int = 200_000, rounds: int = 2, rate: float = 0.5) -> tuple[Model, DataFrame]:
    """The model, and the staged counts of all training tokens that scoring joins rare words with.

    Every text for which `train` holds is counted, and read in each round. A round is one full-batch gradient step:
    tasks sum what the model expects over their texts, the sums are added up, the driver steps and broadcasts the new
    weights. A lost task is run again from its input; nothing else holds state. All words are outcomes, by themselves or
    in the group of their ending; counts of all of them are kept. Feature tables have twice as many rows as the root of
    the training tokens. The driver holds those and at most `common` words with their counts.

    Null and empty texts are an end alone. Repeated rows count as often as they stand. With no training text every word
    is new. Very long texts are read whole. Other columns play no part.
    """
    rows = docs.where(train)
    parts = power_of_two(2 * docs.rdd.getNumPartitions(), 16, 1 << 16)
    vocabulary = stage(count_words(rows, id_col, text_col, parts), "vocabulary")
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    model = Model(*_common(vocabulary, common), n, v, _groups(vocabulary))
    if n:
        rows = _tokens(rows, id_col, text_col)
        got = _summed(rows, model, lambda c, m: [*c.observed(m), *c.cell_classes()])
        got = [x.reshape(s) for x, s in zip(got, [*model.shapes, *[(model.rows, CLASSES)] * 2], strict=True)]
        observed = got[:5]
        ascend(model, observed, first_expected(model, observed, got[5:]), rate)
        for _ in range(rounds - 1):
            got = _summed(rows, model, lambda c, m: c.expected(m))
            ascend(model, observed, [x.reshape(s) for x, s in zip(got, model.shapes, strict=True)], rate)
    return model, vocabulary


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score of every row, over whole texts.

    Common words are looked up in the broadcast model; the others are joined exactly with the counts of all training
    tokens, by hash range. Null text is empty: one token, the end. Repeated rows and ids, null ids too, are scored row
    by row. Words are told apart by 64-bit hashes. Other columns play no part.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    parts = power_of_two(vocabulary.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1, 16, 1 << 16)
    kind = docs.schema[id_col].dataType
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("id", kind), *[T.StructField(c, t) for c, t in (("n", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()), ("of", T.BinaryType()), ("hashes", T.BinaryType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = held.value, None
        schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("id", to_arrow_type(kind)), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("of", pa.binary()), ("hashes", pa.binary())])
        table, inside = m.base(m.counts), m.inside(m.hashes, m.counts)
        task, row = TaskContext.get().partitionId() << 33, 0
        words = Words(m)
        for ids, tokens, lengths in _chunks(batches, words):
            n = len(ids)
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            at = tokens.at
            base = np.where(at >= 0, table[at] if len(table) else 0.0, 0.0)
            score = Chunk(tokens, lengths, m.rows).score(m) + np.where((tokens.out < ENDINGS) & (at >= 0), inside[at] if len(inside) else 0.0, 0.0)
            add = lambda x: np.add.reduceat(x, first)  # noqa: E731  every text has a token
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1), pa.int32()), pa.array(task + row + np.arange(n), pa.int64()), pa.array(ids, to_arrow_type(kind)), pa.array(lengths, pa.int64()), pa.array(add((at >= 0).astype("int64")), pa.int64()), pa.array(add(base)), pa.array(add(score)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=schema)
            rare = np.flatnonzero(at < 0)
            of = np.repeat(np.arange(n, dtype="<u4"), lengths)[rare]
            h = tokens.hash[rare]
            order = np.argsort(h, kind="stable")
            edges = _parts(h[order], parts)
            got = []
            for p, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                if z > a:
                    own = np.sort(order[a:z])  # by text
                    got.append({"part": p, "key": task + row, "of": of[own].tobytes(), "hashes": h[own].tobytes()})
            yield pa.RecordBatch.from_pylist(got, schema=schema)
            row += n

    rows = stage(_tokens(docs, id_col, text_col).mapInArrow(run, out), "scored")

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        m = held.value
        got = []
        known = [(np.frombuffer(h, "<u8"), np.frombuffer(n, "<i8")) for h, n in zip(right["hashes"], right["counts"], strict=True)]
        hashes, counts = known[0] if known else (np.zeros(0, "<u8"), np.zeros(0, "<i8"))
        for key, of, h in zip(left["key"], left["of"], left["hashes"], strict=True):
            of, h = np.frombuffer(of, "<u4"), np.frombuffer(h, "<u8")
            at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
            c = np.where(hashes[at] == h, counts[at], 0) if len(hashes) else np.zeros(len(h))
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            base = m.base(c)
            got.append(pd.DataFrame({"key": key + of[first].astype("int64"), "known": np.add.reduceat((c > 0).astype("int64"), first), "base": np.add.reduceat(base, first), "score": np.add.reduceat(m.inside(h, c), first)}))
        return pd.concat(got) if got else pd.DataFrame({"key": [], "known": [], "base": [], "score": []}).astype({"key": "int64", "known": "int64"})

    rare = rows.where("part >= 0").select("part", "key", "of", "hashes").groupBy("part").cogroup(vocabulary.select("part", "hashes", "counts").groupBy("part")).applyInPandas(join, "key long, known long, base double, score double")
    whole = rows.where("part < 0").select("key", "id", "n", "known", "base", "score")
    both = whole.unionByName(rare, allowMissingColumns=True).groupBy("key").agg(F.max("id").alias(id_col), F.max("n").alias("n_tokens"), *[F.sum(c).alias(c) for c in ("known", "base", "score")])
    return both.select(id_col, "n_tokens", F.col("known").alias("n_known"), F.col("base").alias("base_score"), "score")
