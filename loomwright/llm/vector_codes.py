"""Vector code compression: product codes of whole-number vectors, nearest entries found by a vector-approximation filter.

The entries of a codebook are what is searched, the parts of the vectors are the queries. Entry coordinates are
quantised to a few bits, so that each dimension has few cells. A query's table has, per dimension and cell, the least
and the greatest squared distance to a coordinate in that cell; adding up an entry's cells bounds its distance. Only
entries whose lower bound is no more than the least upper bound are compared by exact whole-number distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_stored, stored

PARTS, ENTRIES, ROUNDS, SCALE, CELL_BITS = 8, 16, 6, 4096, 3
#: Whole-number components end here, so that distances of a vector stay within 63 bits; with a scale of 4096, at about 16384 either way.
LIMIT = (1 << 26) - 1
_CHUNK = 4096
#: So many labels are sent to all executors; more are joined by shuffle.
BROADCAST_LABELS = 100_000


def _cells(entries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each entry's coordinate, least and greatest value of each dimension's cells)."""
    low, high = entries.min(axis=0), entries.max(axis=0)
    width = ((high - low) >> bits) + 1
    begin = low[:, None] + width[:, None] * np.arange(1 << bits)
    return (entries - low) // width, begin, begin + width[:, None] - 1


def nearest(queries: np.ndarray, entries: np.ndarray, bits: int = CELL_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance, entries compared) of each query; ties go to the lower index."""
    n = len(queries)
    code, error, compared = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    cell, begin, end = _cells(entries, bits)
    for i in range(0, n, _CHUNK):
        own = queries[i : i + _CHUNK]
        lower = upper = np.zeros((len(own), len(entries)), np.int64)
        for d in range(entries.shape[1]):
            below, above = begin[d] - own[:, d : d + 1], own[:, d : d + 1] - end[d]
            least = np.maximum(np.maximum(below, above), 0)
            most = np.maximum(np.abs(below), np.abs(above))
            lower = lower + (least * least)[:, cell[:, d]]
            upper = upper + (most * most)[:, cell[:, d]]
        at, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        apart = own[at] - entries[entry]
        distance = (apart * apart).sum(axis=1)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        best = np.minimum.reduceat(distance, first)
        hits = np.flatnonzero(distance == best[at])
        hits = hits[np.diff(at[hits], prepend=-1) > 0]
        code[i : i + _CHUNK], error[i : i + _CHUNK] = entry[hits], best
        compared[i : i + _CHUNK] = np.diff(np.append(first, len(at)))
    return code, error, compared


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _least_ids(many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            held = np.unique(np.concatenate([held, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)]))[:many]
        yield pa.RecordBatch.from_arrays([pa.array(held)], ["vec_id"])

    return run


def _sums(codebooks: np.ndarray, bits: int):
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), parts * width)
            for p in range(parts):
                own = vectors[:, p * width : (p + 1) * width]
                code, _, _ = nearest(own, codebooks[p], bits)
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                if len(used):
                    total[p, used] += np.add.reduceat(own[order], first, axis=0)
                    many[p] += np.bincount(code, minlength=entries)
        part, entry, place = (x.ravel() for x in np.indices(total.shape))
        columns = [part, entry, place, total.ravel(), np.repeat(many.ravel(), width)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["part", "entry", "place", "total", "many"])

    return run


def _encode(codebooks: np.ndarray, bits: int):
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vec"), parts * width)
            found = [nearest(vectors[:, p * width : (p + 1) * width], codebooks[p], bits) for p in range(parts)]
            codes = np.stack([x[0] for x in found], axis=1)
            digits = [bytes(row).hex() for row in codes.astype(np.uint8)] if len(codebooks[0]) <= 256 else ["".join(f"{c:04x}" for c in row) for row in codes.tolist()]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(digits, pa.string()), pa.array(sum(x[1] for x in found)), pa.array(sum(x[2] for x in found))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "n_compared"])

    return run


@dataclass
class Compressed:
    """``codes``: (vec_id, label, code, error, n_compared) per kept row; ``codebooks``: whole numbers by part, entry and position, or None if no row is kept."""

    codes: DataFrame
    codebooks: np.ndarray | None

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal, by part, entry and position."""
        flat = [] if self.codebooks is None else self.codebooks.ravel().tolist()
        return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, vec): the usable rows with components floor(scale * x), held within ``LIMIT``."""
    v = F.col(vector)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    usable = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & finite
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), whole.alias("vec"))


def _start(kept: DataFrame, entries: int, parts: int, dims: int) -> np.ndarray:
    """The parts of the vectors with the least ids, a null id after all others; the least vector of rows that share an id."""
    near = kept.where(F.col("vec_id").isNotNull()).select("vec_id").mapInArrow(_least_ids(entries), "vec_id long")
    ids = [r[0] for r in near.distinct().orderBy("vec_id").limit(entries).collect()]
    wanted = F.col("vec_id").isin(ids) if ids else F.lit(False)
    if len(ids) < entries:
        wanted = wanted | F.col("vec_id").isNull()
    rows = kept.where(wanted).groupBy("vec_id").agg(F.min("vec").alias("vec")).collect()
    rows.sort(key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    first = np.array([r["vec"] for r in rows[:entries]], np.int64).reshape(-1, parts, dims // parts)
    return np.ascontiguousarray(first.transpose(1, 0, 2))


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, bits: int = CELL_BITS, vector: str = "embedding", label: str = "label") -> Compressed:
    """Product codes of ``vectors`` (vec_id, the vector, a label; other columns are ignored).

    Left out are rows whose vector is null, empty, holds a null or a non-finite component, can't be cut into ``parts``
    equal parts, or has another length than most kept vectors have (ties to the shorter). Components beyond ``LIMIT``
    after scaling are held at it. Repeated rows all count; of an id that several rows share, the least vector starts
    an entry; null ids come last. With fewer ids than entries the codebooks have fewer entries. No usable row gives
    no rows and no codebooks.

    Every round is one pass over the stored whole-number vectors: each task finds the nearest entries of its rows and
    adds up their parts, the sums of all tasks are added by Spark, and the codebooks, whose size is a parameter,
    go to the driver and out with the next pass. Sums and divisions are exact, so the result depends on no order.
    """
    kept = stored(whole_vectors(vectors, parts, scale, vector, label), "whole-vectors")
    lengths = kept.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    out = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long, n_compared long"
    if lengths is None:
        return Compressed(kept.sparkSession.createDataFrame([], out), None)
    dims = lengths["dims"]
    own = kept.where(F.size("vec") == dims)
    books = _start(own, entries, parts, dims)
    for _ in range(rounds):
        sums = own.select("vec").mapInArrow(_sums(books, bits), "part long, entry long, place long, total long, many long")
        rows = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("many").alias("many")).where("many > 0").collect()
        books = books.copy()
        for r in rows:
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["many"]
    codes = stored(own.select("vec_id", "label", "vec").mapInArrow(_encode(books, bits), out), "vector-codes")
    drop_stored(kept)
    return Compressed(codes, books)


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the errors of all rows that have the row's label added up (null if beyond 63 bits); null labels are one group.

    Errors are added up by label before the shuffle; their table has one row a label.
    """
    totals = codes.groupBy(F.col("label").alias("own_label")).agg(F.try_sum("error").alias("label_error"))
    if totals.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        totals = F.broadcast(totals)
    return codes.join(totals, F.col("label").eqNullSafe(F.col("own_label")), "left").drop("own_label")


def _sql() -> str:
    """The same for DuckDB, over tables whose vec_id is unique and whose vectors have one length."""
    steps = [
        "usable as (select vec_id, label, embedding as v, len(embedding) as dims from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"flat as (select vec_id, dims // {PARTS} as width, unnest(range(dims)) as k, unnest(v) as x from usable)",
        f"points as (select vec_id, k // width as part, k % width as place, cast(floor({SCALE} * cast(x as double)) as bigint) as x from flat)",
        f"first as (select vec_id, row_number() over (order by vec_id) - 1 as entry from usable order by vec_id limit {ENTRIES})",
        "book0 as (select part, entry, place, x from points join first using (vec_id))",
    ]
    for r in range(ROUNDS + 1):
        steps += [
            f"apart{r} as (select p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) as d from points p join book{r} b on p.part = b.part and p.place = b.place group by all)",
            f"code{r} as materialized (select vec_id, part, min(struct_pack(d := d, entry := entry)) as best from apart{r} group by all)",
        ]
        if r < ROUNDS:
            mean = "cast((sum(p.x) - (((sum(p.x) % count(*)) + count(*)) % count(*))) // count(*) as bigint)"
            steps += [
                f"mean{r} as (select c.part, c.best.entry as entry, p.place, {mean} as x from code{r} c join points p on p.vec_id = c.vec_id and p.part = c.part group by all)",
                f"book{r + 1} as materialized (select b.part, b.entry, b.place, coalesce(m.x, b.x) as x from book{r} b left join mean{r} m on m.part = b.part and m.entry = b.entry and m.place = b.place)",
            ]
    steps += [
        f"coded as (select vec_id, string_agg(printf('%02x', best.entry), '' order by part) as code, cast(sum(best.d) as bigint) as error from code{ROUNDS} group by vec_id)",
        f"digest as (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, place)) as codebooks_sha256 from book{ROUNDS})",
    ]
    total = "cast(sum(error) over (partition by label) as bigint) as label_error"
    return f"with {', '.join(steps)} select vec_id, code, error, {total}, codebooks_sha256 from coded join usable using (vec_id), digest"


SQL = _sql()
