"""Best-fit packing: token sequences of fixed length from whole documents."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BINARY, INT, LONG, binary_texts, release, schema, stage


#: Texts of these characters need no normalising but lower case, and are split by SPLIT as the tokenizer does.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff \t-\r]*").fullmatch
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9 \t-\r]+").findall


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one letter: itself if it is a visible Latin-1 character, else the next one
    from U+0100 on."""
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    rest = [x for x in range(256) if x not in shown]
    return {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(rest)}


class PartIds(dict):
    """Part of a text -> its token ids as little-endian 32-bit words; ids() gives those of a whole text. The tokenizer
    drops white space and joins over no part's end, so ids of a text are those of its parts in order. What is kept is
    bounded: parts of the last generation that are not met again are forgotten."""

    def __init__(self, path: str, most: int = 200_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.old, self.letters = Tokenizer.from_file(path), most, {}, byte_letters()
        self.model = self.tokenizer.model
        special = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or "(?!)").search  # found inside words, too

    def ids(self, text: bytes) -> bytes:
        whole = text.decode("utf-8", "replace")
        if self.plain(whole):
            return b"".join(map(self.__getitem__, SPLIT(whole.lower())))
        words = (x.decode("utf-8", "replace") for x in text.split())
        return b"".join([self[p] for w in words for p in (SPLIT(w.lower()) if self.plain(w) else (w,))])

    def plain(self, text: str) -> bool:
        return bool(PLAIN(text)) and not self.special(text)

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        got = self.old.get(part)
        if got is None:
            got = self._ids(part)
        self[part] = got
        return got

    def _ids(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():
            ids = [x.id for x in self.model.tokenize(part)]
        elif self.plain(part):
            ids = [x.id for x in self.model.tokenize("".join(map(self.letters.__getitem__, part.encode())))]
        else:  # a word of other characters, or with a special token
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def tokenized_pieces(docs: DataFrame, path: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each document's ids and then end_id, cut into pieces of `length` (the last may be shorter).

    Returns id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit). Null text is empty:
    one piece that holds end_id alone.
    """
    end = np.array([end_id], "<u4").tobytes()
    fields = {"id": docs.schema[id_col].dataType, "piece": INT, "start": LONG, "length": LONG, "ids_crc32": LONG} | ({"ids": BINARY} if with_ids else {})
    out = schema(**fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PartIds(path)
        step = 4 * length
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, cols = part.column(0).to_pylist(), ([], [], [], [], [], [])
                for doc, text in zip(ids, binary_texts(part, 1), strict=True):
                    own = known.ids(text or b"") + end
                    for piece, a in enumerate(range(0, len(own), step)):
                        x = own[a : a + step]
                        for c, v in zip(cols, (doc, piece, a // 4, len(x) // 4, zlib.crc32(x), x), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)][: len(fields)], names=list(fields))
        del known
        release()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out)


class _Unpacked:
    """Lengths of unpacked items, as counts: bit sets of the lengths that are there find the longest fit and the best
    pair in a few machine words."""

    def __init__(self, lengths: list[int], size: int):
        self.size, self.count, self.have, self.back = size, [0] * (size + 1), 0, 0
        for x in lengths:
            self.give(x)

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            self.have &= ~(1 << x)
            self.back &= ~(1 << (self.size - x))

    def give(self, x: int) -> None:
        self.count[x] += 1
        self.have |= 1 << x
        self.back |= 1 << (self.size - x)  # bit size - x: length x is there

    def longest(self, gap: int) -> int:
        """The longest that fits; none: -1."""
        return (self.have & ((2 << gap) - 1)).bit_length() - 1

    def pair(self, most: int, least: int) -> tuple[int, int] | None:
        """Two lengths whose sum is as near to most as can be, and at least least."""
        for want in range(most, least - 1, -1):
            # x is there and want - x is there: bit want - x of have is bit size - want + x of back
            half = (want + 1) // 2
            both = (self.have & (self.back >> (self.size - want))) >> half
            while both:  # the most even pair: small lengths are kept to fill gaps later
                low = both & -both
                x = half + low.bit_length() - 1
                if x < want and (2 * x != want or self.count[x] > 1):
                    return x, want - x
                both ^= low
        return None


def _fill(own: list[int], free: _Unpacked) -> None:
    gap = free.size - sum(own)
    while gap and (x := free.longest(gap)) > 0:
        free.take(x)
        own.append(x)
        gap -= x


def _greedy(free: _Unpacked) -> list[list[int]]:
    bins: list[list[int]] = []
    while free.have:
        bins.append([])
        _fill(bins[-1], free)
    return bins


def _bins(lengths: list[int], size: int) -> list[list[int]]:
    """Bins as lists of lengths."""
    bins = _greedy(_Unpacked(lengths, size))
    while True:
        bins.sort(key=sum, reverse=True)
        lost = len(bins) - sum(map(sum, bins)) // size  # sequences that perfect packing would save, at most one more
        tail = min(len(bins) - 1, 2 * lost)
        if lost < 2 or tail < 1:
            return bins
        kept = [list(x) for x in bins[:-tail]]
        free = _Unpacked([x for own in bins[-tail:] for x in own], size)
        for own in reversed(kept):  # the widest gap first
            while free.have and (gap := size - sum(own)):
                _fill(own, free)
                least = min(own)
                gap = size - sum(own)
                if not gap or not (two := free.pair(least + gap, least + 1)):
                    break
                own.remove(least)
                free.give(least)
                for x in two:
                    free.take(x)
                own += two
        new = kept + _greedy(free)
        if len(new) >= len(bins):
            return new if len(new) == len(bins) else bins
        bins = new


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of capacity `size` for lengths in [1, size]: the bin of each item, and its offset there.

    Bins are filled greedily with the longest item that still fits. Then the emptiest bins, twice as many as perfect
    packing would save, are unpacked again; in the others, the widest gap first, the smallest item gives way to two
    unpacked items that together fit the expanded gap more tightly, as long as that is possible; the item that gave
    way is unpacked now. What stays unpacked is filled into bins again. This is repeated while it takes fewer bins;
    swaps that would take more are not made.
    """
    bins = _bins(lengths.tolist(), size)
    of_length: list[list[int]] = [[] for _ in range(size + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        of_length[lengths[i]].append(i)
    at, offset = np.empty(len(lengths), "int64"), np.empty(len(lengths), "int64")
    for b, own in enumerate(bins):
        begin = 0
        for x in sorted(own, reverse=True):
            i = of_length[x].pop()
            at[i], offset[i] = b, begin
            begin += x
    return at, offset


def pack(docs: DataFrame, path: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, items_per_shard: int = 8192) -> DataFrame:
    """Pack whole documents into sequences of at most `length` tokens; only longer ones are cut.

    Full pieces are sequences of their own. All other pieces are dealt by the hash of id and piece into shards of
    about items_per_shard, and every shard is packed by best_two_fit: memory is bounded by the shard, and what is
    lost against one global packing is at most one part-filled sequence a shard.

    Null text: as empty, one piece with end_id alone. Repeated ids are separate documents. An empty table gives an
    empty result. Other columns play no part.

    Returns id, piece, start, length, ids_crc32, sequence_id, offset. sequences() gives the token ids themselves.
    """
    kind = docs.schema[id_col].dataType
    pieces = stage(tokenized_pieces(docs, path, length, id_col, text_col, end_id), "pieces")
    rest = pieces.where(F.col("length") < length)
    shards = max(1, -(-rest.count() // items_per_shard))
    full = pieces.where(F.col("length") >= length)
    # a full piece's sequence number: partition and row of the staged table, from 2^62 up
    full = full.select("*", (F.monotonically_increasing_id() + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "id", "piece", "ids_crc32"]).reset_index(drop=True)
        at, offset = best_two_fit(items["length"].to_numpy(), length)
        return items.assign(sequence_id=key[0] * (1 << 32) + at, offset=offset).drop(columns="shard")

    out = schema(id=kind, piece=INT, start=LONG, length=LONG, ids_crc32=LONG, sequence_id=LONG, offset=LONG)
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.lit(3)), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(run, out)
    return packed.union(full).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, path: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves as arrays of token ids. Ids that repeat in docs or are
    null cannot be told apart here, so they must be unique; pack() has no such need."""
    where = pack(docs, path, length, id_col, text_col, end_id).select(id_col, "piece", "sequence_id", "offset")
    ids = tokenized_pieces(docs, path, length, id_col, text_col, end_id, with_ids=True).select(F.col("id").alias(id_col), "piece", "ids")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.concatenate([np.frombuffer(x["ids"], "<u4") for x in own]).astype("int32") for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    own = ids.join(where, [id_col, "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("own"))
    return own.mapInArrow(unpack, "sequence_id long, ids array<int>")
