"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOUBLE, binary_texts, release, schema

#: Bytes to their class: letters a or A, digits 0, all of a multi-byte character a; marks stay as they are.
SHAPE = bytes(97 if x >= 128 or chr(x).islower() else 65 if chr(x).isupper() else 48 if chr(x).isdigit() else x for x in range(256))
RUNS = re.compile(rb"(.)\1+")
MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum())
#: A whole-text figure counts like a word that stands so often in the text.
FIGURE = 20


class _Shapes(dict):
    """Shape of a word -> its term, runs collapsed; bounded."""

    def __missing__(self, shape: bytes) -> bytes:
        if len(self) > 100_000:
            self.clear()
        got = self[shape] = b"\0" + RUNS.sub(rb"\1", shape)[:12]
        return got


def terms(text: bytes, shapes: _Shapes) -> Counter:
    """Terms of a whole text with their counts: words, collapsed word shapes, and buckets of whole-text figures."""
    words = text.lower().split()
    found = Counter(words)
    if not words:
        return found
    n, distinct, size = len(words), len(found), len(text)
    for shape, k in Counter(text.translate(SHAPE).split()).items():
        found[shapes[shape]] += k
    lines = [x for x in text.split(b"\n") if x.strip()]
    marks = size - len(text.translate(None, MARKS))
    upper = size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = size - len(text.translate(None, b"0123456789"))
    for name, x in ((b"n", np.log2(1 + n)), (b"d", 10 * distinct / n), (b"m", 40 * marks / size), (b"u", 20 * upper / size), (b"0", 20 * digits / size), (b"w", size / n), (b"l", 10 * len(set(lines)) / max(1, len(lines))), (b"r", 10 * sum(map(operator.eq, words, words[1:])) / n)):
        found[b"\1%s%d" % (name, min(int(x), 30))] += FIGURE
        if name in b"mur":  # marks, capitals, repeats: near values are alike, and many are much unlike none
            for least in (1, 2, 4, 7):
                if x >= least:
                    found[b"\1%s>%d" % (name, least)] += FIGURE
    return found


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    project: np.ndarray  # term x dimension, idf included
    vectors: np.ndarray  # labelled row x dimension, of length 1
    labels: np.ndarray
    neighbours: int
    power: float
    prior: float
    shapes: _Shapes = field(default_factory=_Shapes)

    def latent(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.project.shape[1]), "float32")
        ids, counts, rows = [], [], []
        for r, text in enumerate(texts):
            own = [(i, k) for w, k in terms(text, self.shapes).items() if (i := self.vocabulary.get(w)) is not None]
            if own:
                rows.append((r, len(ids)))
                ids += [i for i, _ in own]
                counts += [k for _, k in own]
        if rows:
            x = self.project[ids] * (1 + np.log(np.array(counts, "float32")))[:, None]
            out[[r for r, _ in rows]] = np.add.reduceat(x, [a for _, a in rows], axis=0)
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, size, out=out, where=size > 0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = self.latent(texts)
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        near = x @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        # all that are as near as the k-th vote, so ties do not hang on an order
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        weight = np.where(near >= least, np.maximum(near, 0), 0).astype("float64") ** self.power
        total = weight.sum(1)
        vote = (weight * self.labels).sum(1)
        got = np.divide(vote, total, out=np.full(len(texts), self.prior), where=total > 0)
        return np.round(got, 6)


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4096, sample_bytes: int = 64 << 20, vocabulary: int = 6000, dimensions: int = 64, neighbours: int = 24, power: float = 4.0) -> Model:
    """Latent vectors of at most `sample` labelled rows for which `train` (over docs) holds, the ones whose hashed ids are smallest.

    `sample` and `sample_bytes` bound what the driver collects and what is broadcast: rows are taken until either is
    reached, texts whole. Rows with null label, id or text are left out; a document labelled twice counts by its larger
    label, one with several texts by the least of them. Without labelled rows, as with empty tables, every score is the
    neutral 0.5.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("__y"))
    # the ids are chosen before the texts are fetched, so that texts are never sorted
    texts = docs.where(train & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    sizes = texts.groupBy("__id").agg(F.max(F.octet_length("__text")).alias("__size"))
    chosen, held = [], 0
    for x in known.join(sizes, "__id").orderBy(F.xxhash64("__id"), "__id").limit(sample).collect():
        held += x["__size"]
        if held > sample_bytes and chosen:
            break
        chosen.append((x["__id"], x["__y"]))
    chosen = docs.sparkSession.createDataFrame(chosen, schema(__id=docs.schema[id_col].dataType, __y=DOUBLE))
    rows = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "__y").agg(F.min("__text").cast("binary").alias("__text")).select("__id", "__y", "__text").toArrow()
    order = np.argsort(np.array(rows.column(0).to_pylist()), kind="stable") if rows.num_rows else []
    y = np.array(rows.column(1).to_pylist(), "float64")[order] if rows.num_rows else np.zeros(0)
    raw = rows.column(2).to_pylist()
    del rows
    # every text's terms as numbers: its counter is let go at once, so the driver holds eight bytes a term
    number: dict[bytes, int] = {}
    found, shapes = [], _Shapes()
    for i in order:
        c = terms(raw[i], shapes)
        found.append((np.fromiter((number.setdefault(w, len(number)) for w in c), "int32", len(c)), np.fromiter(c.values(), "int32", len(c))))
    n = len(found)
    df = np.bincount(np.concatenate([i for i, _ in found]), minlength=len(number)) if n else np.zeros(0, "int64")
    top = sorted((w for w, i in number.items() if df[i] > 1), key=lambda w: (-df[number[w]], w))[:vocabulary]
    index = {w: i for i, w in enumerate(top)}
    if not n or not top:
        return Model({}, np.zeros((0, 1), "float32"), np.zeros((0, 1), "float32"), np.zeros(0), neighbours, power, float(y.mean()) if n else 0.5)
    kept = np.array([number[w] for w in top])
    place = np.full(len(number), -1, "int32")
    place[kept] = np.arange(len(top))
    idf = np.log((1 + n) / (df[kept] + 0.5)).astype("float32")
    del number
    # rows are kept as the places and weights of their terms; only 256 of them are ever spread out
    rows = []
    for i, k in found:
        at = place[i]
        w = (1 + np.log(k[at >= 0])).astype("float32") * idf[at[at >= 0]]
        size = np.sqrt((w * w).sum())
        rows.append((at[at >= 0], w / size if size > 0 else w))
    del found, place

    def spread() -> Iterator[np.ndarray]:
        for a in range(0, n, 256):
            x = np.zeros((min(256, n - a), len(top)), "float32")
            for r, (at, w) in enumerate(rows[a : a + 256]):
                x[r, at] = w
            yield x

    d = min(dimensions, n, len(top))
    q = np.random.default_rng(5).standard_normal((len(top), min(d + 16, n, len(top)))).astype("float32")
    for _ in range(4):  # the leading right singular vectors, by subspace iteration
        q = np.linalg.qr(sum(x.T @ (x @ q) for x in spread()))[0]
    _, s, vt = np.linalg.svd(np.concatenate([x @ q for x in spread()]), full_matrices=False)
    basis = (q @ vt.T)[:, :d] / np.sqrt(np.maximum(s[:d], 1e-6))
    del rows
    model = Model(index, np.ascontiguousarray(basis * idf[:, None], "float32"), np.zeros((0, d), "float32"), y, neighbours, power, float(y.mean()))
    model.vectors = np.concatenate([model.latent([raw[i] for i in order[a : a + 256]]) for a in range(0, n, 256)])
    del raw
    release()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out_col: str = "score", block: int = 256) -> DataFrame:
    """(id, score) for every row of docs: the similarity-weighted share of label 1 among its nearest labelled vectors.

    Whole texts are read; only the text is an input. Null and empty texts, and texts without a known term, get the
    share of label 1 in the sample. Repeated rows and ids are scored row by row; other columns play no part.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = schema(__id=docs.schema[id_col].dataType, __score=DOUBLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score([t or b"" for t in binary_texts(part, 1)]))], names=["__id", "__score"])

    got = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, out)
    return got.toDF(id_col, out_col)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the threshold, with the columns of docs; rows are decided one by one in
    the pass that reads them, so there is neither a join nor a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array(m.score([t or b"" for t in binary_texts(part, k)]) >= threshold))
        release()

    return docs.mapInArrow(run, docs.schema)
