"""The registered queries on a small folder with nulls, empty and long texts, ties, repeats and clashing columns, and on
empty tables: names, types, and values by brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lumen.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import SCHEMA, WORD, brute_secrets, corpus, linked, shingles

COLUMNS = {
    "op1_line_dedup": "doc_id bigint, text string",
    "op2_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5_source_mixing": "doc_id bigint, size bigint, source string, source_size bigint, target double, taken bigint, copies int",
    "op6_maxent_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op7_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op8_byte_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op10_quality": "doc_id bigint, held_out boolean, score double, predicted int",
}


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode())


def vectors() -> list[tuple]:
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 6))
    return [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(100 + i, x[0].tolist(), 0) for i in range(30)] + [(200, None, 0), (220, [0.0] * 6, 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    rng = random.Random(1)
    spark.createDataFrame([(r[0], rng.randrange(2), 0) for r in rows[:70]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


@pytest.fixture(scope="module")
def nothing(spark, folder, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_empty_tables(spark, nothing, name):
    got = QUERIES[name](spark, nothing)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == COLUMNS[name] and got.count() == 0


def rows_of(spark, folder, name):
    got = QUERIES[name](spark, folder)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == COLUMNS[name]
    return [r.asDict() for r in got.collect()]


def test_op1(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["op1_line_dedup"]).fetchall()
    assert Counter((r["doc_id"], r["text"]) for r in rows_of(spark, folder, "op1_line_dedup")) == Counter(want)


def test_op2(spark, folder):
    bins, pieces = defaultdict(list), Counter()
    for r in rows_of(spark, folder, "op2_best_fit_packing"):
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]] += 1
    assert set(pieces) == {r[0] for r in corpus()}
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 2048


def test_op3(spark, folder):
    want = linked(corpus())
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(spark, folder, "op3_ngram_jaccard_join"))
    assert got == sorted((r[0], len(shingles(r[1])), want[r[0]]) for r in corpus())


def test_op5(spark, folder):
    got, sizes = rows_of(spark, folder, "op5_source_mixing"), defaultdict(int)
    for r in corpus():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
    for r in got:
        assert abs(taken[r["source"]] - r["target"]) <= max(16, 0.02 * r["target"])


def test_op6(spark, folder):
    bags = [(r[0], [*(r[1] or "").encode().lower().split(), None]) for r in corpus()]
    count = Counter(w for i, b in bags if crc(i) % 10 for w in b)
    n, v = sum(count.values()), len(count)
    want = sorted((i, crc(i) % 10 == 0, len(b), sum(w in count for w in b), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in b), 6)) for i, b in bags)
    got = rows_of(spark, folder, "op6_maxent_scores")
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert sum(r["score"] - r["base_score"] for r in got if r["held_out"]) > 0


def test_op7(spark, folder):
    have = {i: np.array(v) for i, v, _ in vectors() if v and any(v)}
    want = []
    for q in sorted(i for i in have if i % 20 == 0):
        near = sorted((-round(float(have[q] @ v), 9), i) for i, v in have.items() if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in rows_of(spark, folder, "op7_nearest_neighbours")]
    assert len(got) == len(want) and len({x[::2] for x in got} & {x[::2] for x in want}) >= 0.9 * len(want)


def test_op8(spark, folder):
    got, slots = rows_of(spark, folder, "op8_byte_shards"), defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    data = [(r[0], (r[1] or "").encode()) for r in corpus()]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len(t) + 1, zlib.crc32(t)) for i, t in data)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


def test_op9(spark, folder):
    import hashlib

    want = Counter()
    for r in corpus():
        said = ",".join(f"{k}:{a}:{z}" for a, _, z, k in brute_secrets(r[1]))
        want[(r[0], hashlib.sha256(said.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["base_sha256"]) for r in rows_of(spark, folder, "op9_secret_scan")) == want


def test_op10(spark, folder):
    got = rows_of(spark, folder, "op10_quality")
    assert sorted((r["doc_id"], r["held_out"]) for r in got) == sorted((r[0], crc(r[0]) % 5 == 0) for r in corpus())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
