"""Append only what has not been appended: a ledger of keys in hash buckets, which Bloom filters keep from being read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import drop_stored, stored
from .batches import BatchTable

BUCKETS, BITS_PER_KEY, PROBES = 64, 12, 8
_BLOOMS = "bucket int, bits binary"


@dataclass
class Appended:
    """``read`` of the ``held`` pairs of micro-batch and bucket were looked into; ``replayed`` if the micro-batch had been committed."""

    read: int = 0
    held: int = 0
    replayed: bool = False


def _places(pairs: pa.Array, bits: int) -> np.ndarray:
    """The ``PROBES`` bits of each pair of hashes in a filter of ``bits`` bits, a power of two."""
    first, second = (pairs.field(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (0, 1))
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((first[:, None] + steps * (second[:, None] | np.uint64(1))) >> np.uint64(7)) & np.uint64(bits - 1)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for pairs in batch.column("hashes"):
            bits = np.zeros(1 << max(6, (len(pairs.values) * BITS_PER_KEY - 1).bit_length()), bool)
            bits[_places(pairs.values, len(bits))] = True
            out.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(out, pa.binary())], ["bucket", "bits"])


def _tests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = []
        for data, pairs in zip(batch.column("bits"), batch.column("hashes"), strict=True):
            bits = np.frombuffer(data.as_py(), np.uint8)
            at = _places(pairs.values, len(bits) * 8)
            hit.append(bool((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1).any()))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("query", "batch", "bucket")], ["query", "batch", "bucket"]).filter(pa.array(hit, pa.bool_()))


class KeyLedger:
    """A table of rows at ``path``, one for each ``key``, that micro-batches append to.

    Rows lie by micro-batch and by ``buckets`` ranges of their key's hash. Each micro-batch leaves a Bloom filter for
    each bucket it wrote to. A later one tests its keys against the filters of their buckets, in as many tasks as
    there are filters to test, and reads the key column of only those pairs of micro-batch and bucket whose filter
    took one of them for its own; keys that are new everywhere cost no read. The filters are read whole, at 12 to 24 bits a
    key. Writing the filters commits the micro-batch, so one that is replayed writes nothing, and one that was
    interrupted is written again.
    """

    def __init__(self, like: DataFrame, path: str, key: str, buckets: int = BUCKETS):
        """``like`` has the columns of the rows; none may be named bucket, query or batch."""
        self.spark, self.key, self.buckets = like.sparkSession, key, buckets
        self.columns = like.columns
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
        self.table = BatchTable(self.spark, path, ("rows", "blooms"))

    def _hashes(self) -> Column:
        text = F.col(self.key)
        return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))

    def _seen(self, packed: DataFrame, out: Appended) -> DataFrame | None:
        """The keys of the pairs of micro-batch and bucket that may hold one of ``packed`` (bucket, hashes); None if no pair may."""
        blooms = self.table.read("blooms", _BLOOMS)
        out.held = blooms.count()
        if not out.held:
            return None
        hits = blooms.join(packed, "bucket").select("query", "batch", "bucket", "bits", "hashes").mapInArrow(_tests, "query string, batch long, bucket int").collect()  # folders, not keys
        out.read = len(hits)
        if not hits:
            return None
        folders = [f"{self.table.folder('rows', h['query'], h['batch'])}/bucket={h['bucket']}" for h in hits]
        return self.spark.read.schema(f"{self.schema}, query string, batch long, bucket int").option("basePath", f"{self.table.path}/rows").parquet(*folders).select(self.key)

    def append(self, batch: DataFrame, batch_id: int, query: str = "append", order: str | None = None) -> Appended:
        """Append the rows of keys that the ledger doesn't have: of rows that share a key, the first by ``order`` (else by a hash of the row). Null keys are left out."""
        if self.table.is_committed(query, batch_id):
            return Appended(replayed=True)
        first = F.min_by(F.struct(*self.columns), F.struct(*([order] if order else []), F.xxhash64(*self.columns))).alias("row")
        fresh = batch.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("__key")).agg(first).select("row.*")
        fresh = stored(fresh.withColumn("bucket", F.pmod(F.xxhash64(F.lit(2), self.key), F.lit(self.buckets)).cast("int")), "fresh")
        out = Appended()
        pack = lambda rows: rows.groupBy("bucket").agg(F.collect_list(self._hashes()).alias("hashes"))
        seen = self._seen(pack(fresh), out)
        new = fresh if seen is None else fresh.join(seen, self.key, "left_anti")
        self.table.write("rows", new.repartition("bucket"), query, batch_id, by="bucket")
        own = self.table.read("rows", f"{self.schema}, bucket int", [(query, batch_id)])
        self.table.write("blooms", pack(own).mapInArrow(_filters, _BLOOMS), query, batch_id)
        drop_stored(fresh)
        return out

    def rows(self) -> DataFrame:
        """What has been appended."""
        return self.table.read("rows", self.schema).drop("query", "batch", "bucket")

    def append_stream(self, rows: DataFrame, checkpoint: str, query: str = "stream", order: str | None = None) -> StreamingQuery:
        """Append what a streaming source has; a restart goes on at ``checkpoint``."""
        return rows.writeStream.foreachBatch(lambda batch, k: self.append(batch, k, query, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
