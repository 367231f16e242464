"""MinHash near-duplicate detection: one-permutation hashing, optimal densification, banded buckets, star-shaped edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored
from .components import connected_components
from .textbytes import U64, mix, sequence_hash, words_of

#: Words of a shingle, bins of the permutation, rows of a band. At a similarity of 0.85 a pair shares no band
#: with probability (1 - 0.85**8)**40, about 3e-6.
WIDTH, BINS, ROWS = 5, 320, 8
BANDS = BINS // ROWS
#: How many members of a bucket become centres of stars, round by round; in the last round all that are left.
CENTRES = (1, 16, None)
#: Cells of the shingles' space in which two sets are compared by number before they are compared in full; a power of two.
CELLS = 32


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; one of the whole sequence if it has fewer words; none without words."""
    for i, j, words in words_of(column):
        runs = sequence_hash(words.hash, width)
        for a, b in zip(words.row_at[:-1], words.row_at[1:], strict=True):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            else:
                yield sequence_hash(words.hash[a:b], int(b - a)) if b > a else np.zeros(0, U64)


class Signer:
    """One-permutation signatures. An empty bin takes the value of the full bin that comes first in its own random order of all bins."""

    def __init__(self, bins: int = BINS, rows: int = ROWS, seed: int = 7):
        self.bins, self.rows = bins, rows
        draw = np.random.default_rng(seed)
        self.rank = np.argsort(draw.random((bins, bins)), axis=1).astype(np.int16)
        self.salt = draw.integers(1, 1 << 62, bins).astype(U64) | U64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        h = mix(shingles ^ U64(0x5851F42D4C957F2D))
        h.sort()
        at = ((h >> U64(32)) * U64(self.bins) >> U64(32)).astype(np.int64)
        full, first = np.unique(at, return_index=True)
        out = np.empty(self.bins, U64)
        out[full] = h[first]
        empty = np.ones(self.bins, bool)
        empty[full] = False
        if empty.any():
            out[empty] = out[full[self.rank[np.ix_(np.flatnonzero(empty), full)].argmin(axis=1)]]
        return out

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        """A key for each band."""
        return mix(mix(self.signature(shingles) * self.salt).reshape(-1, self.rows).sum(axis=1, dtype=U64)).view(np.int64)


def _sign(width: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bins, rows)
        for batch in batches:
            n, keys, bands = [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                keys.append(_class(s))
                bands.append(signer.bands(s) if len(s) else np.zeros(0, np.int64))
            lengths = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            values = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths), values)], ["doc_id", "n_shingles", "class", "bands"])

    return run


def _class(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for a set."""
    return np.array([mix(shingles).sum(dtype=U64), mix(shingles * U64(0x2545F4914F6CDD1D)).sum(dtype=U64)], ">u8").tobytes() if len(shingles) else None


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), width))
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = pa.array((np.concatenate(sets) if sets else np.zeros(0, U64)).view(np.int64))
            cells = pa.array([np.bincount((s % U64(CELLS)).astype(np.int64), minlength=CELLS) for s in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(map(_class, sets), pa.binary()), pa.ListArray.from_arrays(pa.array(at), values), cells], ["node", "shingles", "cells"])

    return run


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda n, x: n + x)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    common = F.size(F.array_intersect("su", "sv"))
    joined = pairs.join(left, "u").join(right, "v").withColumn("common", common)
    return joined.where(100 * F.col("common") >= percent * (F.size("su") + F.size("sv") - F.col("common"))).select("u", "v")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Rows with equal shingle sets form one class; only classes are compared. Each class goes to one bucket per
    band; one class of the bucket is the centre of a star, and each candidate edge of the star is confirmed on
    the full sets. What the stars left in different components is taken up again with the next classes of the
    bucket as centres, until every pair of a bucket has been confirmed, refuted, or lies in one component. So a
    group of n copies costs n edges, and no link within a bucket is lost.

    Two sets share no more than the lesser of their counts in each cell of the shingles' space, shingles that no
    other class in any bucket has left out. A pair whose bound is too low is refuted without comparing its sets;
    it is what keeps altered copies that are not alike enough from being compared with each other. Classes with
    the fewest shingles of their own, the likely originals, become centres first.

    Null or empty texts, and texts of white space only, have no set and stay alone. A text of fewer than
    ``width`` words has its word sequence as its one shingle. Repeated rows each appear in the result, in the
    same component. A row without doc_id joins its component but never names it.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(slim.mapInArrow(_sign(width, bins, rows), "doc_id long, n_shingles long, class binary, bands array<long>"), "signed")
    some = signed.where("class is not null")
    classes = some.groupBy("class").agg(F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.min("doc_id").alias("reader"))
    placed = classes.select(F.col("class").alias("node"), "n", F.posexplode("bands").alias("band", "key"))
    full = placed.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1").drop("members")
    buckets = stored(placed.join(full, ["band", "key"]), "buckets")
    wanted = buckets.select("node").distinct()
    readers = classes.join(wanted, classes["class"] == wanted["node"]).select("reader").distinct()
    texts = slim.join(readers, slim["doc_id"].eqNullSafe(readers["reader"]), "left_semi")
    sets = stored(texts.mapInArrow(_sets(width), "node binary, shingles array<long>, cells array<int>"), "sets")

    # what a class can have in common with any other, by cells of the shingles' space: its shingles less those that no other class in a bucket has
    held = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("holders"), F.min("node").alias("node"))
    lone = held.where("holders = 1").withColumn("cell", F.col("shingle").bitwiseAND(F.lit(CELLS - 1))).groupBy("node").agg(F.array(*(F.count_if(F.col("cell") == k).cast("int") for k in range(CELLS))).alias("lone"))
    shared = sets.select("node", "cells").dropDuplicates(["node"]).join(lone, "node", "left").select("node", F.coalesce(F.zip_with("cells", "lone", lambda x, y: x - y), F.col("cells")).alias("cells"))
    shared = shared.withColumn("most", _total(F.col("cells")))
    order = Window.partitionBy("band", "key").orderBy(F.desc(F.col("most") / F.col("n")), F.xxhash64("node", "band"), "node")
    members = buckets.join(shared, "node").where(F.col("most") * 100 >= F.col("n") * percent).withColumn("rank", F.row_number().over(order) - 1)
    members = stored(members, "members")

    tried, root, first = None, None, 0
    for centres in CENTRES:
        state = members if root is None else members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        heads = state if centres is None else state.where(F.col("rank") < first + centres)
        a, b = heads.where(F.col("rank") >= first).alias("a"), state.where(F.col("rank") > first).alias("b")
        near = (F.col("a.rank") < F.col("b.rank")) & (100 * F.least("a.most", "b.most") >= percent * F.greatest("a.n", "b.n"))
        if root is not None:
            near = near & (F.col("a.root") != F.col("b.root"))
        common = _total(F.zip_with("a.cells", "b.cells", lambda x, y: F.least(x, y)))
        near = near & ((100 + percent) * common >= percent * (F.col("a.n") + F.col("b.n")))
        pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & near)
        pairs = pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        if pairs.isEmpty() and root is not None:
            first += centres or 0
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = stored(_verified(pairs, sets, percent), "links")
        if not new.isEmpty():
            known = new if root is None else new.unionByName(root.select(F.col("node").alias("u"), F.col("root").alias("v")))
            root = stored(connected_components(known), "roots")
        first += centres or 0

    if root is None:
        named = some.groupBy("class").agg(F.min("doc_id").alias("component"))
    else:
        heads = some.groupBy("class").agg(F.min("doc_id").alias("low"))
        rooted = heads.join(root, heads["class"] == root["node"], "left").select("class", "low", F.coalesce("root", "class").alias("root"))
        named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component")), "root").select("class", "component")
    out = signed.drop("bands").join(named, "class", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
