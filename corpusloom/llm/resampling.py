"""Resampling towards a target distribution by importance weights over hashed features (operator 12).

Documents and target texts are read as runs of words; the bucket of a run is its CRC-32 modulo a fixed number.  A bucket's gain is the
logarithm of how much likelier the target holds it; a document's weight is the sum of its gains, and Gumbel noise that depends on its id
alone turns the highest scores into a draw without replacement.

CRC-32 is linear over bits: the checksum of a span is the XOR of what each byte contributes at its distance from the span's end, and of a
constant of the length.  So one table look-up by (distance, byte) for all bytes of a batch and one ``bitwise_xor.reduceat`` over the
spans give every checksum at once.  Bytes further from the end than the table is deep are folded block by block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import documents, fresh, query, stored, text_of
from corpusloom.plans import ordered

#: Depth of the position table: one block.
DEPTH = 128
#: Bytes of text that are looked at together.
PIECE = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters and all of code points above ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def _zeros_after(value: int, n: int) -> int:
    """The linear part of the checksum ``value`` with ``n`` zero bytes put behind."""
    return zlib.crc32(bytes(n), value) ^ zlib.crc32(bytes(n))


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contribution of (distance from the end, byte); constant of each length below DEPTH; shift of a checksum's bytes by one block."""
    by_byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    at = np.empty((DEPTH, 256), np.uint32)
    at[0] = by_byte
    for d in range(1, DEPTH):  # a zero byte more behind
        at[d] = (at[d - 1] >> np.uint32(8)) ^ by_byte[at[d - 1] & np.uint32(255)]
    constant = np.array([zlib.crc32(bytes(n)) for n in range(DEPTH + 1)], np.uint32)
    shift = np.array([[_zeros_after(b << (8 * k), DEPTH) for b in range(256)] for k in range(4)], np.uint32)
    return at, constant, shift


def span_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for non-empty spans in any order, overlapping or not."""
    at, constant, shift = tables()
    if not len(start):
        return np.zeros(0, np.uint32)
    blocks = -((start - end) // DEPTH)
    # blocks are counted from the end, so only a span's first block is short; they lie in order of the text
    first = np.cumsum(blocks) - blocks
    owner = np.repeat(np.arange(len(start)), blocks)
    left = np.repeat(first + blocks, blocks) - np.arange(len(owner))  # 1 for the last block of a span
    stop = end[owner] - (left - 1) * DEPTH
    begin = np.maximum(start[owner], stop - DEPTH)
    size = stop - begin
    heads = np.cumsum(size) - size
    where = np.arange(int(size.sum())) - np.repeat(heads - begin, size)
    value = np.bitwise_xor.reduceat(at[np.repeat(stop, size) - 1 - where, data[where]], heads)
    out = value[first]
    zero = constant[size[first]]
    for k in range(1, int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        for x in (out, zero):  # the text so far moves a block away from the end
            v = x[on]
            x[on] = shift[0][v & 255] ^ shift[1][v >> 8 & 255] ^ shift[2][v >> 16 & 255] ^ shift[3][v >> 24]
        out[on] ^= value[first[on] + k]
        zero[on] ^= constant[DEPTH]
    return out ^ zero


@dataclass(frozen=True)
class Features:
    """Runs of ``least`` to ``most`` consecutive words, hashed into ``buckets``."""

    least: int = 1
    most: int = 1
    buckets: int = 10_000

    def __post_init__(self):
        if not 1 <= self.least <= self.most or self.buckets < 1:
            raise ValueError("runs must have at least a word, and there must be a bucket")

    def of(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For texts ``data[bounds[i]:bounds[i + 1]]``, piece by piece: text of each feature, its bucket, and text of each word.

        Memory is that of one piece; only a single word longer than it makes a piece longer.
        """
        at = done = int(bounds[0])
        last = int(bounds[-1])
        told = 0  # words at the piece's head that the piece before has told
        while done < last:
            stop = min(done + PIECE, last)
            while stop < last and IN_WORD[LOWER[data[stop]]]:
                stop += 1
            piece = LOWER[data[at:stop]]
            inside = IN_WORD[piece]
            starts, ends = inside.copy(), inside.copy()
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            cuts = bounds[(bounds > at) & (bounds < stop)] - at
            starts[cuts], ends[cuts - 1] = inside[cuts], inside[cuts - 1]
            first, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
            owner = np.searchsorted(bounds, first + at, side="right") - 1
            start, plain, texts, buckets = first, piece, [], []
            if self.most > 1 and len(first):  # words one behind the other with a blank between them
                size = end - first
                start = np.cumsum(size + 1) - size - 1
                end = start + size
                plain = np.full(int(end[-1]), 32, np.uint8)
                inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                plain[np.repeat(start, size) + inner] = piece[np.repeat(first, size) + inner]
            for n in range(self.least, self.most + 1):
                i = np.arange(max(0, told - n + 1), len(start) - n + 1)
                i = i[owner[i] == owner[i + n - 1]]
                texts.append(owner[i])
                buckets.append(span_crcs(plain, start[i], end[i + n - 1]) % np.uint32(self.buckets))
            yield np.concatenate(texts), np.concatenate(buckets).astype(np.int64), owner[told:]
            told = min(self.most - 1, len(first))
            at = at + int(first[-told]) if told else stop
            done = stop


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each string begins and the last ends."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def bucket_counts(docs: DataFrame, features: Features, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket: each task sums what it reads, so at most a row a bucket reaches the driver."""
    def count(batches):
        held = np.zeros(features.buckets, np.int64)
        for b in batches:
            if b.num_rows:
                for _, buckets, _ in features.of(*_bytes(b.column(0))):
                    held += np.bincount(buckets, minlength=features.buckets)
        used = np.flatnonzero(held)
        yield pa.record_batch({"bucket": pa.array(used, pa.int64()), "n": pa.array(held[used], pa.int64())})

    per = docs.select(text_of(text).alias("t")).mapInArrow(count, "bucket long, n long")
    got = per.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(features.buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray, unit: int = 1000) -> np.ndarray:
    """Of each bucket the logarithm of the target's share over the raw share, both smoothed by one, in whole units rounded down."""
    n, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(unit * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, features: Features, carry: list[str], text: str = "text") -> DataFrame:
    """``doc`` (the carried columns as a struct), n_words, n_features and weight of each row, and ``tie``, a hash of its text."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket, whatever the input

    def weigh(batches):
        for b in batches:
            n = b.num_rows
            words, found, weight = (np.zeros(n, np.int64) for _ in range(3))
            if n:
                for of, buckets, word in features.of(*_bytes(b.column(1))):
                    words += np.bincount(word, minlength=n)
                    found += np.bincount(of, minlength=n)
                    weight += np.bincount(of, held.value[buckets], minlength=n).astype(np.int64)  # whole numbers below 2**53: exact
            yield pa.record_batch({"doc": b.column(0), "tie": b.column(2), "n_words": pa.array(words), "n_features": pa.array(found), "weight": pa.array(weight)})

    rows = docs.select(F.struct(*carry).alias("doc"), text_of(text).alias("t"), F.xxhash64(text_of(text)).alias("tie"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"doc {kind}, tie long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int, unit: int = 1000) -> Column:
    """Gumbel noise in whole units, from the hash of seed and key; a null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(unit)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, features: Features = Features(), doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
           carry: list[str] | None = None, least_words: int = 20, share: tuple[int, int] = (10, 100), seed: int = 2024) -> DataFrame:
    """``doc`` (a struct of ``carry``, all columns by default), n_words, n_features, weight, score and rank of every row of ``docs``.

    Drawn are floor(share * N) of the N rows with at least ``least_words`` words: the highest scores, of equal ones the smaller ids, rows without
    an id last, then by the text's hash; ``rank`` counts them from 1 and is null for all others.  Null and empty texts have no feature and weight 0.
    Each row counts, also where ids or whole rows repeat.  Without target texts, gains only even out the documents' own buckets.
    """
    raw, wanted = bucket_counts(docs, features, text), bucket_counts(target, features, target_text)
    key = fresh("id")
    rows = weighted(docs.withColumn(key, F.col(doc_id)), gains(raw, wanted), features, [*(docs.columns if carry is None else carry), key], text)
    rows = rows.withColumn("score", F.col("weight") + noise(F.col(f"doc.{key}"), seed))
    rows = rows.select(F.col("doc").dropFields(key).alias("doc"), "n_words", "n_features", "weight", "score", F.col(f"doc.{key}").alias("_id"), "tie")
    rows = stored(rows.withColumn("_down", -F.col("score")).withColumn("_no_id", F.col("_id").isNull()), "resampling")
    eligible = rows.filter(F.col("n_words") >= least_words)
    most = eligible.count() * share[0] // share[1]
    order = ["_down", "_no_id", "_id", "tie"]
    ranked = ordered.numbered(eligible.select(*rows.columns), [], order, "_rank")
    ranked = ranked.withColumn("rank", F.when(F.col("_rank") <= most, F.col("_rank").cast("long"))).drop("_rank")
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc", "n_words", "n_features", "weight", "score", "rank")


def sample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the draw takes, with the options of ``scored``."""
    return scored(docs, target, **options).filter(F.col("rank").isNotNull()).select("doc.*")


@query("op12_importance_resampling")
def op12_importance_resampling(spark, sf_dir):
    got = scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    return got.select("doc.doc_id", "n_features", "weight", "score", "rank")
