"""The corpus pipeline on a small fixture, against the same stages done by hand."""

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from lumen.llm.queries import tokenizer
from tests.llm.test_operators import WORDS, linked


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    clean = lambda: ". ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(8, 30))).capitalize() for _ in range(4)) + "."
    junk = lambda: " ".join(rng.choice(WORDS).upper() + rng.choice(["!!", "$$$", "***"]) for _ in range(60))
    rows = [(i, junk() if i % 6 == 5 else clean() + ("\nShared footer of the site" if i % 2 else ""), "en", f"s{i % 4}", 0) for i in range(240)]
    rows += [(300 + k, rows[0][1], "en", "s0", 0) for k in range(5)] + [(400, rows[2][1] + " end", "en", "s1", 0), (500, None, "en", None, None), (501, "", "en", "s1", 0)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] % 6 != 5), 0) for r in rows if r[0] < 240], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
    good = {r["doc_id"] for r in kept[0].collect()}
    assert {r[0] for r in rows if r[0] % 6 != 5 and r[0] < 240} <= good and not {r[0] for r in rows if r[0] % 6 == 5 and r[0] < 240} & good
    texts = {r[0]: r[1] for r in rows}
    pages, lines = Counter(), defaultdict(Counter)
    for r in rows:
        if r[0] in good:
            pages[r[3]] += 1
            lines[r[3]].update({x.strip(" ") for x in (r[1] or "").split("\n")} - {""})
    gone = {s: {x for x, n in c.items() if n >= 3 and n > 0.1 * pages[s]} for s, c in lines.items()}
    want = {i: None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in gone[s] or not x.strip(" ")) for i, t, _, s, _ in rows if i in good}
    assert {r["doc_id"]: r["text"] for r in kept[1].collect()} == want and any("Shared footer" in (texts[i] or "") and "Shared footer" not in (t or "") for i, t in want.items())
    comps = linked(list(want.items()))
    assert sorted(r["doc_id"] for r in kept[2].collect()) == sorted(set(comps.values()))
    assert all(k.columns == ["doc_id", "text", "lang", "source", "n_chars"] for k in kept[:4])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    copies = Counter(r["doc_id"] for r in kept[3].collect())
    assert set(copies) <= set(comps.values()) and max(copies.values()) <= 3
    words = Counter()
    for r in kept[3].collect():
        words[r["source"]] += size(r["text"])
    assert words["s2"] > 1.5 * words["s0"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    pieces = Counter()
    for i, n in copies.items():
        ids = np.array([*t.encode(want[i] or "", add_special_tokens=False).ids, 0], "<u4")
        pieces[(i, len(ids), zlib.crc32(ids.tobytes()))] += n
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in kept[4].collect()) == pieces
    assert kept[4].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["length"]) for r in again.collect()) == sorted((r["doc_id"], r["length"]) for r in kept[4].collect())
