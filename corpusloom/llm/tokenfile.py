"""Token ids as binary files (operator 2).

A token file is a folder with three Parquet tables:

* ``table``: id, frequency - the shared static frequency table (one row per id that occurs);
* ``blocks``: file, block, n_docs, n_ids, words, parts, crc32 - coded blocks of about a million ids (see ``rans``); ``parts``
  are the checkpoints, ``crc32`` is of words and parts together;
* ``index``: doc_id, file, block, doc, n_tokens, start - where each document lies, in ascending doc_id order.

Spark's committer writes them, so a lost executor leaves no half-written file.  Blocks decode independently.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import bytebpe as B, rans
from corpusloom.llm.bpe import VOCABULARY, batches_of_text
from corpusloom.llm.common import documents, query, stored, text_of
from corpusloom.session import scratch

BLOCK_IDS = 1 << 20
TEXT_CHARS = 4_000_000
#: Distinct words whose ids a Python worker keeps from task to task; a cache.
KNOWN_WORDS = 1_200_000
PACKS = "file int, block int, doc_ids array<bigint>, counts array<int>, ids binary, used array<int>, times array<bigint>"


class Encoder:
    """Ids of whole texts through the task's table of distinct words."""

    def __init__(self, vocabulary: str):
        self.vocabulary, self.special = vocabulary, B.specials(vocabulary)
        self.clear()

    def clear(self) -> None:
        self.words, self.ids = B.Numbered(), np.zeros(1 << 20, np.uint32)
        self.free, self.begin, self.count, self.room = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the count per text."""
        if len(self.words) > KNOWN_WORDS:
            self.clear()
        had = len(self.words)
        code, n_words = B.numbered_words(texts, self.words, self.special)
        if len(self.words) > had:
            new = list(islice(self.words, had, None))
            got, n = B.encode_words(new, self.vocabulary)
            if self.free + len(got) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(got)), np.uint32)])
            self.ids[self.free:self.free + len(got)] = got
            self.begin = np.append(self.begin, self.free + np.cumsum(n) - n)
            self.count = np.append(self.count, n)
            self.free += len(got)
        total = np.concatenate([[0], np.cumsum(self.count[code])])
        ends = np.cumsum(n_words)
        return B.gather(self.ids, self.begin, self.count, code), total[ends] - total[ends - n_words]


@cache
def worker_encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def _packs(rows: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Ids by range of doc_id: each pack holds whole documents of about BLOCK_IDS ids, and how often each id occurs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, block = worker_encoder(vocabulary), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush():
            doc_ids = pa.concat_arrays([h[0] for h in held])
            counts, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            times = np.bincount(ids)
            used = np.flatnonzero(times)
            return pa.record_batch({
                "file": pa.array([file], pa.int32()), "block": pa.array([block], pa.int32()),
                "doc_ids": pa.ListArray.from_arrays([0, len(doc_ids)], doc_ids), "counts": pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                "ids": pa.array([ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()], pa.binary()),
                "used": pa.array([used.astype(np.int32)], pa.list_(pa.int32())), "times": pa.array([times[used]], pa.list_(pa.int64()))})

        for b in batches_of_text(batches, TEXT_CHARS):
            flat, count = encode(b.column(1).to_pylist())
            ends = np.cumsum(count)
            ids = np.insert(flat, ends, end_id)  # the end id after each document
            held.append((b.column(0), count + 1, ids))
            size += len(ids)
            if size >= BLOCK_IDS:
                yield flush()
                held, size, block = [], 0, block + 1
        if held:
            yield flush()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "_h")
              .sortWithinPartitions("doc_id", "_h").select("doc_id", "text"))
    return stored(ranged.mapInArrow(pack, PACKS), "token-packs", compression="zstd")


def _broadcast(spark: SparkSession, table: rans.Table):
    return spark.sparkContext.broadcast(table.freq)  # one number per vocabulary entry


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts and write them as a token file at ``path``.

    Null texts count as empty: such a document is its end id alone.  Rows with equal ids keep together, ordered by a hash of the text;
    rows without an id come first.  An empty table makes an empty file.
    """
    spark = docs.sparkSession
    packs = _packs(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")), vocabulary, end_id)
    per_id = (packs.select(F.explode(F.arrays_zip("used", "times")).alias("x")).groupBy(F.col("x.used").alias("id"))
              .agg(F.sum("x.times").alias("n")).toArrow())  # one row per vocabulary entry
    count = np.zeros(int(max(per_id.column("id").to_numpy(), default=0)) + 1, np.int64)
    count[per_id.column("id").to_numpy()] = per_id.column("n").to_numpy()
    table = rans.Table.scaled(count)
    used = np.flatnonzero(table.freq)
    spark.createDataFrame(pa.table({"id": used.astype(np.int32), "frequency": table.freq[used].astype(np.int32)})).coalesce(1).write.parquet(f"{path}/table")
    freq = _broadcast(spark, table)

    def code(batches):
        t = rans.Table(freq.value)
        for b in batches:
            for i in range(b.num_rows):
                data, counts = b.column(4)[i].as_buffer(), np.asarray(b.column(3)[i].values)
                ids = np.frombuffer(data, f"<u{data.size // int(counts.sum())}")
                words, parts = rans.encode(ids, t)
                packed = rans.pack_parts(parts)
                yield pa.record_batch({
                    "file": b.column(0).slice(i, 1), "block": b.column(1).slice(i, 1), "n_docs": pa.array([len(counts)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                    "words": pa.array([words], pa.binary()), "parts": pa.array([packed], pa.binary()), "crc32": pa.array([zlib.crc32(packed, zlib.crc32(words))], pa.int64())})

    (packs.select("file", "block", "doc_ids", "counts", "ids").mapInArrow(code, "file int, block int, n_docs long, n_ids long, words binary, parts binary, crc32 long")
     .write.option("compression", "uncompressed").parquet(f"{path}/blocks"))  # coded words do not compress
    # ids before each file: one row per file
    per_file = packs.groupBy("file").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    before, total = [], 0
    for file, n in sorted(per_file):
        before.append((file, total))
        total += n
    starts = spark.createDataFrame(before, "file int, _before long")

    def index(batches):
        last, total = None, 0
        for b in batches:
            for file, block, ids, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if file != last:
                    last, total = file, 0
                n = np.asarray(counts.values, np.int64)
                ends = total + np.cumsum(n)
                yield pa.record_batch({
                    "doc_id": ids.values, "file": pa.array(np.full(len(n), file, np.int32)), "block": pa.array(np.full(len(n), block, np.int32)),
                    "doc": pa.array(np.arange(len(n), dtype=np.int64)), "n_tokens": pa.array(n), "in_file": pa.array(ends - n)})
                total = int(ends[-1])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (packs.select("file", "block", "doc_ids", "counts").repartition(parts, "file").sortWithinPartitions("file", "block")
     .mapInArrow(index, "doc_id long, file int, block int, doc long, n_tokens long, in_file long")
     .join(F.broadcast(starts), "file").withColumn("start", F.col("in_file") + F.col("_before")).drop("in_file", "_before")
     .write.parquet(f"{path}/index"))


def read_table(spark: SparkSession, path: str) -> rans.Table:
    got = spark.read.parquet(f"{path}/table").toArrow()
    freq = np.zeros(int(max(got.column("id").to_numpy(), default=0)) + 1, np.int64)
    freq[got.column("id").to_numpy()] = got.column("frequency").to_numpy()
    return rans.Table(freq)


def read_blocks(spark: SparkSession, path: str, use, schema: str) -> DataFrame:
    """Decode the blocks of a token file, each verified by its checksums; ``use(file, block, doc_starts, ids)`` gives the columns of ``schema``.

    Documents are told apart by the index, which travels to its block as counts only.
    """
    freq = _broadcast(spark, read_table(spark, path))
    counts = (spark.read.parquet(f"{path}/index").groupBy("file", "block")
              .agg(F.array_sort(F.collect_list(F.struct("doc", "doc_id", "start", "n_tokens"))).alias("docs")))
    blocks = spark.read.parquet(f"{path}/blocks").select("file", "block", "n_ids", "words", "parts", "crc32")

    def run(batches):
        t = rans.Table(freq.value)
        for b in batches:
            for i in range(b.num_rows):
                words, parts = b.column(3)[i].as_buffer(), b.column(4)[i].as_buffer()
                if zlib.crc32(parts, zlib.crc32(words)) != b.column(5)[i].as_py():
                    raise ValueError("checksum of a coded block differs")
                n, data = b.column(2)[i].as_py(), np.frombuffer(words, "<u4")
                found = [rans.decode_part(data, p, n, t) for p in rans.unpack_parts(parts.to_pybytes())]
                yield pa.record_batch(use(b.column(6)[i].values, np.concatenate(found) if found else np.zeros(0, np.uint32)))

    return blocks.join(counts, ["file", "block"]).select("file", "block", "n_ids", "words", "parts", "crc32", "docs").mapInArrow(run, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array) of every document of a token file."""

    def use(docs: pa.Array, ids: np.ndarray) -> dict:
        n = docs.field("n_tokens").to_numpy()
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return {"doc_id": docs.field("doc_id"), "start": docs.field("start"), "ids": pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))}

    return read_blocks(spark, path, use, "doc_id long, start long, ids array<int>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files' ids."""

    def use(docs: pa.Array, ids: np.ndarray) -> dict:
        data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(docs.field("n_tokens").to_numpy()).tolist()
        crc = [zlib.crc32(data[4 * a:4 * z]) for a, z in zip([0, *ends], ends)]
        return {"doc_id": docs.field("doc_id"), "start": docs.field("start"), "n_tokens": docs.field("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())}

    return read_blocks(spark, path, use, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op2_token_file")
def op2_token_file(spark, sf_dir):
    path = scratch(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path)
    return token_digests(spark, path)
