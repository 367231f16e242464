"""Token-id shards: raw id payloads with a minimal perfect hash index from document keys to offsets.

A shard is one binary value:

    header    4s magic, u2 version, u2 bytes of an id, u8 documents, u8 keys, u8 buckets, u8 tokens
    keys      i8 per document: the keys in order; documents without a key come first (u8 count of them)
    seeds     i4 per bucket: a seed >= 0, or -1 - slot for a bucket of one key
    prints    u4 per slot: fingerprint of the key in it
    ordinals  u4 per slot: the first document with that key;  copies  u4 per slot: how many have it
    offsets   u8 per document + 1: where its ids begin, in tokens
    payload   the ids, little-endian

Shards are rows of a Parquet table with the range of their keys, so that Spark's committer makes them whole on any
store, and a filter on the range reads no other shard's row group (``lookup``).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import new_path
from .textbytes import U64, mix
from .units import encoder as shared_encoder
from .units import groups

END_ID = 2
#: A shard is closed at so many tokens or documents.
SHARD_TOKENS, SHARD_DOCS = 1 << 19, 1 << 16
_HEAD = struct.Struct("<4sHHQQQQQ")
_MAGIC, _VERSION, _PER_BUCKET = b"LWTS", 1, 4
_SHARDS = "part int, seq int, before long, n_tokens long, n_docs long, first_key long, last_key long, shard binary"


def _slot(hashes: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes ^ mix(seed.astype(U64) + U64(0x632BE59BD9B4E019))) >> U64(32)) * U64(n) >> U64(32)


class KeyIndex:
    """Hash and displace: each bucket has a seed that sends its keys to slots of their own; no slot stays free."""

    @staticmethod
    def bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
        return (((hashes & U64(0xFFFFFFFF)) * U64(buckets)) >> U64(32)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(seeds, slot of each key) for distinct hashes."""
        n = len(hashes)
        buckets = -(-n // _PER_BUCKET)
        seeds, slots, free = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
        if not n:
            return seeds, slots
        own = cls.bucket(hashes, buckets)
        order = np.argsort(own, kind="stable")
        at = np.searchsorted(own[order], np.arange(buckets + 1))
        for b in np.argsort(-np.diff(at), kind="stable"):
            keys = order[at[b] : at[b + 1]]
            if len(keys) < 2:
                break
            seed = 0
            while True:
                tries = np.arange(seed, seed + 32)
                to = np.sort(_slot(hashes[keys][None, :], tries[:, None], n).astype(np.int64), axis=1)
                good = free[to].all(axis=1) & (to[:, 1:] != to[:, :-1]).all(axis=1)
                if good.any():
                    seeds[b] = tries[int(good.argmax())]
                    break
                seed += 32
            slots[keys] = _slot(hashes[keys], seeds[b : b + 1], n).astype(np.int64)
            free[slots[keys]] = False
        left = np.flatnonzero(free)
        single = np.flatnonzero(np.diff(at) == 1)
        slots[order[at[single]]] = left
        seeds[single] = -1 - left
        return seeds, slots


def pack(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A shard of documents in key order, null keys first."""
    nulls = sum(k is None for k in keys)
    own = np.array([0 if k is None else k for k in keys], np.int64)
    distinct, first, copies = np.unique(own[nulls:], return_index=True, return_counts=True)
    hashes = mix(distinct.view(U64))
    seeds, slots = KeyIndex.build(hashes)
    prints, ordinals, many = (np.zeros(len(distinct), "<u4") for _ in range(3))
    prints[slots], ordinals[slots], many[slots] = (mix(hashes + U64(1)) >> U64(32)).astype("<u4"), first + nulls, copies
    offsets = np.cumsum([0, *map(len, ids)]) // width
    head = _HEAD.pack(_MAGIC, _VERSION, width, len(keys), len(distinct), len(seeds), int(offsets[-1]), nulls)
    return b"".join([head, own.astype("<i8").tobytes(), seeds.astype("<i4").tobytes(), prints.tobytes(), ordinals.tobytes(), many.tobytes(), offsets.astype("<u8").tobytes(), *ids])


class Shard:
    """Reads one shard; ``find`` needs constant time per key."""

    def __init__(self, data: bytes):
        magic, version, width, docs, keys, buckets, tokens, self.nulls = _HEAD.unpack_from(data)
        if magic != _MAGIC or version != _VERSION:
            raise ValueError("not a token shard")
        at = _HEAD.size
        parts = []
        for kind, n in (("<i8", docs), ("<i4", buckets), ("<u4", keys), ("<u4", keys), ("<u4", keys), ("<u8", docs + 1), (f"<u{width}", tokens)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        if at != len(data):
            raise ValueError("a token shard was cut short")
        self.keys, self.seeds, self.prints, self.ordinals, self.copies, self.offsets, self.ids = parts

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, copies) of each key; copies is 0 for a key whose fingerprint the shard doesn't hold."""
        n = len(self.prints)
        if not n:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        hashes = mix(np.asarray(keys, np.int64).view(U64))
        seeds = self.seeds[KeyIndex.bucket(hashes, len(self.seeds))].astype(np.int64)
        slot = np.where(seeds < 0, -1 - seeds, _slot(hashes, np.maximum(seeds, 0), n).astype(np.int64))
        held = self.prints[slot] == (mix(hashes + U64(1)) >> U64(32)).astype("<u4")
        return self.ordinals[slot].astype(np.int64), np.where(held, self.copies[slot], 0).astype(np.int64)

    def documents(self, keys: np.ndarray) -> np.ndarray:
        """The document of each of the ascending ``keys``, by the index; the second of equal keys is the second document that has it, and so on."""
        first, copies = self.find(keys)
        own = np.arange(len(keys)) - np.searchsorted(keys, keys)
        if (own >= copies).any():
            raise KeyError("a key is not in the token shard")
        return first + own

    def tokens(self, document: int) -> np.ndarray:
        return self.ids[int(self.offsets[document]) : int(self.offsets[document + 1])]


def _write(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        width, part = encoder.dtype.itemsize, TaskContext.get().partitionId()
        end, keys, ids, held, seq, before = np.array([end_id], encoder.dtype).tobytes(), [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal keys, ids, held, seq, before
            n = held // width
            known = [k for k in keys if k is not None]
            row = [[part], [seq], [before], [n], [len(keys)], [known[0] if known else None], [known[-1] if known else None], [pack(keys, ids, width)]]
            keys, ids, held, seq, before = [], [], 0, seq + 1, before + n
            kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["part", "seq", "before", "n_tokens", "n_docs", "first_key", "last_key", "shard"])

        for batch in batches:
            for i, j in groups(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()):
                some = batch.slice(i, j - i)
                texts = [x or "" for x in some.column(1).to_pylist()]
                for key, own in zip(some.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    keys.append(key)
                    ids.append(own + end)
                    held += len(ids[-1])
                    if held >= SHARD_TOKENS * width or len(keys) >= SHARD_DOCS:
                        yield close()
        if keys:
            yield close()

    return run


def write_shards(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending order of doc_id (nulls first) into shards at ``path``; returns the shard table.

    The documents are range-partitioned by doc_id, with the text's hash after it, so that even a key that many
    rows share spreads over tasks; each task writes its range as shards of bounded size.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-shards")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_write(tokenizer, end_id), _SHARDS).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_SHARDS).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, data in zip(batch.column("base").to_pylist(), batch.column("shard"), strict=True):
            shard = Shard(data.as_py())
            n = np.arange(len(shard.keys))
            place = np.concatenate([n[: shard.nulls], shard.documents(shard.keys[shard.nulls :])])
            begin, end = shard.offsets[place].astype(np.int64), shard.offsets[place + 1].astype(np.int64)
            raw, width = memoryview(shard.ids.astype("<u4")).cast("B"), 4
            crc = [zlib.crc32(raw[a * width : b * width]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            columns = [pa.array(shard.keys, pa.int64(), mask=n < shard.nulls), pa.array(base + begin), pa.array(end - begin), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document; its place comes from its key through its shard's index.

    ``start`` counts the ids of all documents before it. The table of a base per range has a row for each task
    that wrote shards, whatever the size of the data.
    """
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    placed = shards.join(F.broadcast(bases), "part").select((F.col("first") + F.col("before")).alias("base"), "shard")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _found(keys: list[int]):
    own = np.unique(np.array(keys, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("shard"):
                shard = Shard(data.as_py())
                first, copies = shard.find(own)
                held = np.flatnonzero(copies)
                held = held[shard.keys[first[held]] == own[held]]
                places = [int(d) + c for d, n in zip(first[held], copies[held], strict=True) for c in range(int(n))]
                yield pa.RecordBatch.from_arrays([pa.array([int(shard.keys[d]) for d in places], pa.int64()), pa.array([shard.tokens(d).tolist() for d in places], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return run


def lookup(shards: DataFrame, keys: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents with these ``keys``, a short list; a document for each copy of a key, none for a key that isn't there.

    The range of the keys is pushed down to the shard table, the shards in whose own range a key lies are read, and
    each key costs constant time in its shard.
    """
    out = "doc_id long, ids array<long>"
    if not keys:
        return shards.sparkSession.createDataFrame([], out)
    held = F.exists(F.array(*(F.lit(int(k)).cast("long") for k in sorted(set(keys)))), lambda k: (k >= F.col("first_key")) & (k <= F.col("last_key")))
    near = shards.where((F.col("first_key") <= max(keys)) & (F.col("last_key") >= min(keys)) & held)
    return near.select("shard").mapInArrow(_found(keys), out)


def token_shards(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text; other columns are ignored) as token shards and read every document back.

    Null texts are empty; each document ends with ``end_id``. Special tokens in a text are found as the library finds
    them. Rows without doc_id come first and have no key.
    Repeated ids are kept, in the order of their texts' hashes; their key leads to the first of them in a shard.
    An empty table gives an empty result.
    """
    return read_shards(write_shards(docs, tokenizer, path, end_id))
