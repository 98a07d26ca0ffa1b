"""BPE encoding and decoding through a table of distinct words (operator 7).

1. Split: documents are packed into blocks of a few million characters; a block holds its distinct words and, for each
   document, the words' numbers by position.  Blocks are stored once.
2. Encode: each block sends its words to hash buckets, and a bucket encodes every distinct word once.  Words of all
   blocks meet there, but a word arrives once per block, however frequent it is.
3. Join back: the ids return to the block and are put in place by the words' numbers.  Blocks are stored in buckets of their key, so only ids move.
4. Decode: ids are joined with the id-to-piece table, which has one row per vocabulary entry and so a fixed size.

Buckets are streamed, so a task holds a few blocks, or the distinct words of one bucket.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as TY

from corpusloom.llm import bytebpe as B
from corpusloom.llm.common import documents, free_name, query, stored_by, text_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BLOCK_CHARS = 8_000_000
#: Words per bucket that the number of buckets aims at.
BUCKET_WORDS = 200_000
MOST_BUCKETS = 4096

BLOCKS = "block long, rows long, n_words long, numbers binary, counts array<int>, keys {keys}, words binary, at binary"


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_words(words: list[bytes]) -> bytes:
    size = np.fromiter(map(len, words), np.uint32, len(words))
    return squeeze(np.uint32(len(words)).tobytes() + size.tobytes() + b"".join(words))


def unpack_words(data) -> list[bytes]:
    raw = unsqueeze(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    cuts = [4 + 4 * n, *ends.tolist()]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def pack_numbers(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, which is how they compress."""
    return squeeze(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(data) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def batches_of_text(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """Cut batches (text in the last column) so that a part has about ``chars`` bytes of text, or one text."""
    for b in batches:
        text = b.column(b.num_columns - 1)
        size = np.asarray(pc.binary_length(text).fill_null(0), np.int64)
        part = np.cumsum(size) // chars
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows] if b.num_rows else []
        for lo, hi in zip(cuts, cuts[1:]):
            yield b.slice(lo, hi - lo)


def word_blocks(rows: DataFrame, vocabulary: str = VOCABULARY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Store the blocks of ``rows`` (any key columns, and the text last)."""
    keys = rows.columns[:-1]
    kind = f"array<struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in rows.schema.fields[:-1])}>>"

    def split(batches):
        special, block = B.specials(vocabulary), TaskContext.get().partitionId() << 32
        for b in batches_of_text(batches, block_chars):
            numbers = B.Numbered()
            code, counts = B.numbered_words(b.column(len(keys)).to_pylist(), numbers, special)
            # frequent words get small numbers, which store well
            rank = np.argsort(-np.bincount(code, minlength=len(numbers)), kind="stable")
            place = np.empty(len(rank), np.int32)
            place[rank] = np.arange(len(rank))
            words = [w.encode() for w in numbers]
            by_hash = np.argsort(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), kind="stable")
            yield pa.record_batch({
                "block": pa.array([block], pa.int64()), "rows": pa.array([b.num_rows], pa.int64()), "n_words": pa.array([len(words)], pa.int64()),
                "numbers": pa.array([pack_numbers(place[code])], pa.binary()), "counts": pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                "keys": pa.ListArray.from_arrays([0, b.num_rows], pa.StructArray.from_arrays(b.columns[:-1], keys)),
                "words": pa.array([pack_words([words[i] for i in by_hash.tolist()])], pa.binary()),
                "at": pa.array([pack_numbers(place[by_hash])], pa.binary())})
            block += 1

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored_by(rows.mapInArrow(split, BLOCKS.format(keys=kind)), "word-blocks", "block", parts, compression="zstd")


def bucket_ids(blocks: DataFrame, vocabulary: str) -> DataFrame:
    """Ids of each block's words by bucket: block, bucket, ids (uint16 or uint32 after a count per word), in the words' hash order."""
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    n = int(min(MOST_BUCKETS, max(1, total // BUCKET_WORDS)))

    def deal(batches):
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1)):
                words = unpack_words(data.as_buffer())
                bucket = (np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(n)) >> np.uint64(32)
                cuts = np.searchsorted(bucket, np.arange(n + 1)).tolist()
                used = [k for k in range(n) if cuts[k] < cuts[k + 1]]
                yield pa.record_batch({
                    "bucket": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int64()),
                    "words": pa.array([pack_words(words[cuts[k]:cuts[k + 1]]) for k in used], pa.binary())})

    def encode(batches):
        current, known, ids, begin, count, free = None, {}, None, None, None, 0
        for b in batches:
            packed = []
            for bucket, data in zip(b.column(0).to_pylist(), b.column(2)):
                if bucket != current:
                    current, known, free = bucket, B.Numbered(), 0
                    ids, begin, count = np.zeros(1 << 16, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
                words, had = unpack_words(data.as_buffer()), len(known)
                of = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                if len(known) > had:  # each distinct word is encoded when it comes first
                    new = [w.decode() for w in islice(known, had, None)]
                    got, n_ids = B.encode_words(new, vocabulary)
                    while free + len(got) > len(ids):
                        ids = np.concatenate([ids, np.zeros(len(ids), np.uint32)])
                    ids[free:free + len(got)] = got
                    begin = np.append(begin, free + np.cumsum(n_ids) - n_ids)
                    count = np.append(count, n_ids)
                    free += len(got)
                packed.append(pack_ids(B.gather(ids, begin, count, of), count[of]))
            yield pa.record_batch({"block": b.column(1), "bucket": b.column(0), "ids": pa.array(packed, pa.binary())})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.select("block", "words").mapInArrow(deal, "bucket int, block long, words binary")
    return (dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(encode, "block long, bucket int, ids binary"))


def pack_ids(ids: np.ndarray, count: np.ndarray) -> bytes:
    """Counts per word and ids; most vocabularies fit two bytes an id."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    long = len(count) > 0 and int(count.max()) > 0xFF
    head = np.array([len(count), wide, long], np.uint32).tobytes()
    return squeeze(head + count.astype(np.uint32 if long else np.uint8).tobytes() + ids.astype(np.uint32 if wide else np.uint16).tobytes())


def unpack_ids(data) -> tuple[np.ndarray, np.ndarray]:
    raw = unsqueeze(data)
    n, wide, long = np.frombuffer(raw, np.uint32, 3).tolist()
    count = np.frombuffer(raw, np.uint32 if long else np.uint8, n, 12).astype(np.int64)
    return np.frombuffer(raw, np.uint32 if wide else np.uint16, -1, 12 + n * (4 if long else 1)).astype(np.uint32), count


class Block:
    """A block with the ids of its words: words are numbered from 0, ``begin`` and ``count`` find the ids of each."""

    def __init__(self, ids: np.ndarray, begin: np.ndarray, count: np.ndarray, numbers: np.ndarray, counts: np.ndarray, keys: pa.Array):
        self.ids, self.begin, self.count, self.numbers, self.keys = ids, begin, count, numbers, keys
        self.ends = np.cumsum(counts)

    def documents(self) -> Iterator[np.ndarray]:
        """The words' numbers of each document."""
        yield from np.split(self.numbers, self.ends[:-1]) if len(self.ends) else ()

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        return B.gather(self.ids, self.begin, self.count, numbers)

    def decimal(self) -> list[str]:
        """The ids of each word as decimals joined by commas."""
        flat = list(map(str, self.ids.tolist()))
        return [",".join(flat[a:a + n]) for a, n in zip(self.begin.tolist(), self.count.tolist())]


def encoded(rows: DataFrame, use: Callable[[Block], dict], schema: str, vocabulary: str = VOCABULARY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Encode the texts (last column of ``rows``) and hand each block with its ids to ``use``, which returns the columns of ``schema``.

    Null texts count as empty; an empty text has no ids.  Rows may repeat: every row comes out once.
    """
    blocks = word_blocks(rows.withColumn(rows.columns[-1], text_of(rows.columns[-1])), vocabulary, block_chars)
    ids = bucket_ids(blocks, vocabulary).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "ids"))).alias("ids"))
    both = blocks.select("block", "numbers", "counts", "keys", "at").join(ids, "block", "left")

    def place(batches):
        for b in batches:
            for i in range(b.num_rows):
                got = [unpack_ids(x.as_buffer()) for x in b.column(5)[i].values.field("ids")] if b.column(5)[i].is_valid else []
                flat = np.concatenate([x for x, _ in got]) if got else np.zeros(0, np.uint32)
                in_hash_order = np.concatenate([n for _, n in got]) if got else np.zeros(0, np.int64)
                at = unpack_numbers(b.column(4)[i].as_buffer())
                begin, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                begin[at], count[at] = np.cumsum(in_hash_order) - in_hash_order, in_hash_order
                yield pa.record_batch(use(Block(flat, begin, count, unpack_numbers(b.column(1)[i].as_buffer()), np.asarray(b.column(2)[i].values, np.int64), b.column(3)[i].values)))

    return both.mapInArrow(place, schema)


def decode(encoded_rows: DataFrame, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``decoded``, the text of an array of ids, as the library decodes it without skipping special tokens.

    Bytes that are no UTF-8 become replacement signs.  A null array stays null.  Where the rows have a column ``decoded``, the new one is ``decoded_``.
    """
    name = free_name("decoded", encoded_rows.columns)
    schema = TY.StructType([*encoded_rows.schema.fields, TY.StructField(name, TY.StringType())])

    def run(batches):
        for b in batches:
            text = [None if x is None else B.decode_ids(np.array(x, np.int64), vocabulary).decode("utf-8", "replace") for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, name])

    return encoded_rows.mapInArrow(run, schema)


def encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The other columns of ``docs`` and ``ids``, an array of token ids; where ``docs`` has a column ``ids``, the new one is ``ids_``.

    ``block_chars`` bounds what a task holds at once; smaller blocks store and move common words more often.
    """
    keys = [c for c in docs.columns if c != text]
    name = free_name("ids", keys)
    fields = [docs.schema[c] for c in keys]

    def use(block: Block) -> dict:
        found = [block.ids_of(d) for d in block.documents()]
        return dict(zip(keys, block.keys.flatten())) | {name: pa.array(found, pa.list_(pa.int32()))}

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` array<int>"])
    return encoded(docs.select(*keys, text), use, schema, vocabulary, block_chars)


def digests(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The other columns, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the text decoded from the ids)."""
    keys = [c for c in docs.columns if c != text]

    def use(block: Block) -> dict:
        decimal, n, of_ids, of_text = block.decimal(), [], [], []
        for numbers in block.documents():
            ids = block.ids_of(numbers)
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join([decimal[k] for k in numbers.tolist()]).encode()).hexdigest())
            decoded = B.decode_ids(ids, vocabulary)
            of_text.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
        return dict(zip(keys, block.keys.flatten())) | {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keys), "n_tokens long", "ids_sha256 string", "decoded_sha256 string"])
    return encoded(docs.select(*keys, text), use, schema, vocabulary)


@query("op7_bpe")
def op7_bpe(spark, sf_dir):
    return digests(documents(spark, sf_dir).select("doc_id", "text"))
