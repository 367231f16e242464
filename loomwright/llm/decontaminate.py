"""Benchmark decontamination: a prefix-filtered set join between documents and the word windows of benchmark items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .textbytes import ALNUM, U64, Words, words_of

WIDTH = 10
#: Bytes of benchmark windows that are sent to the executors at once; a larger benchmark goes in blocks of this size.
BLOCK_BYTES = 48 << 20
_PAIRS = 1 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), ([], [])
            for i, _, words in words_of(batch.column(1), ALNUM):
                for k, (a, b) in enumerate(zip(words.row_at[:-1], words.row_at[1:], strict=True)):
                    n = min(width, b - a)
                    for p in range(a, b - n + 1 if n else a):
                        out[0].append(ids[i + k])
                        out[1].append(words.hash[p : p + n].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(map(str, out[0]), pa.string()), pa.array(out[1], pa.binary())], ["item_id", "window"])

    return run


def _frequencies(vocabulary):
    """Per task, how often each word of the vocabulary occurs in the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        counts = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, words in words_of(batch.column(0), ALNUM):
                at = np.searchsorted(known, words.hash)
                at[at == len(known)] = 0
                counts += np.bincount(at[known[at] == words.hash], minlength=len(known))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(counts[some])], ["word", "n"])

    return run


@dataclass
class Index:
    """Distinct windows, ordered by their key: the word of the window that is rarest in the documents (its necessary prefix)."""

    key: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    words: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    names: list[str]

    @classmethod
    def build(cls, item_ids: list[str], windows: list[bytes], frequency: dict[int, int], width: int) -> Index:
        names = sorted(set(item_ids))
        number = {x: i for i, x in enumerate(names)}
        holders: dict[bytes, set[int]] = {}
        for x, w in zip(item_ids, windows, strict=True):
            holders.setdefault(w, set()).add(number[x])
        n = len(holders)
        words, length, offset, key = np.zeros((n, width), U64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, U64)
        for i, w in enumerate(holders):
            own = np.frombuffer(w, U64)
            words[i, : len(own)], length[i] = own, len(own)
            offset[i] = min(range(len(own)), key=lambda k: (frequency.get(int(own[k]), 0), int(own[k]), k))
            key[i] = own[offset[i]]
        order = np.argsort(key, kind="stable")
        held = list(holders.values())
        items = [sorted(held[i]) for i in order]
        return cls(key[order], offset[order], length[order], words[order], np.cumsum([0, *map(len, items)]), np.array([x for own in items for x in own], np.int64), names)

    def seen(self) -> np.ndarray:
        out = np.zeros(1 << 16, bool)
        out[(self.key & U64(0xFFFF)).astype(np.int64)] = True
        return out

    def occurrences(self, words: Words, seen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first word, window) of all occurrences: positions joined on the key, cut by the bounds of the row, then compared word by word."""
        if not len(self.key):
            return
        w, row_at = words.hash, words.row_at
        at = np.flatnonzero(seen[(w & U64(0xFFFF)).astype(np.int64)])
        low, high = np.searchsorted(self.key, w[at], "left"), np.searchsorted(self.key, w[at], "right")
        at, low, many = at[high > low], low[high > low], (high - low)[high > low]
        ends = np.cumsum(many)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _PAIRS, "right")))
            n = many[i:j]
            window = np.repeat(low[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start = np.repeat(at[i:j], n) - self.offset[window]
            row = np.searchsorted(row_at, np.repeat(at[i:j], n), "right") - 1
            fits = (start >= row_at[row]) & (start + self.length[window] <= row_at[row + 1])
            start, window = start[fits], window[fits]
            for k in range(self.words.shape[1]):
                inside = k < self.length[window]
                same = ~inside | (w[np.where(inside, start + k, 0)] == self.words[window, k])
                start, window = start[same], window[same]
            yield start, window
            i = j


def _matched(index_sent, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = index_sent.value
        seen = index.seen()
        for batch in batches:
            total, spans, items = [], [], []
            for _, _, words in words_of(batch.column("text"), ALNUM):
                row_at = words.row_at
                delta = np.zeros(len(words.hash) + 1, np.int64)
                pairs = [np.zeros(0, np.int64)]
                for start, window in index.occurrences(words, seen):
                    np.add.at(delta, start, 1)
                    np.add.at(delta, start + index.length[window], -1)
                    row = np.searchsorted(row_at, start, "right") - 1
                    n = np.diff(index.item_at)[window]
                    own = np.repeat(index.item_at[window] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    pairs.append(np.unique(np.repeat(row, n) * len(index.names) + index.items[own]))
                hit = np.zeros(len(delta) + 1, bool)
                hit[1:] = np.cumsum(delta) > 0
                turn = np.flatnonzero(hit[1:] != hit[:-1])
                starts, ends = turn[::2], turn[1::2]
                # spans of neighbouring rows can touch: cut them at the bounds of the rows
                total += np.diff(row_at).tolist()
                new = [[] for _ in range(len(row_at) - 1)]
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    r = int(np.searchsorted(row_at, a, "right")) - 1
                    while a < b:
                        end = min(b, int(row_at[r + 1]))
                        if end > a:
                            new[r].append([a - int(row_at[r]), end - int(row_at[r])])
                        a, r = max(a, end), r + 1
                spans += new
                named = [[] for _ in new]
                for x in np.unique(np.concatenate(pairs)).tolist():
                    named[x // len(index.names)].append(index.names[x % len(index.names)])
                items += named
            if not first:
                spans = [_union(a, b) for a, b in zip(spans, batch.column("spans").to_pylist(), strict=True)]
                items = [sorted({*a, *b}) for a, b in zip(items, batch.column("items").to_pylist(), strict=True)]
            columns = [batch.column("doc_id"), batch.column("text"), pa.array(total, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_words", "spans", "items"])

    return run


def _union(a: list, b: list) -> list:
    out: list = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans, text_hash) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of ASCII letters and digits and of characters beyond ASCII, lower-cased A-Z. A window is
    ``width`` consecutive words of an item, or all words of a shorter one. For a full containment the necessary
    prefix of a window is one word; it is the one that is rarest over all documents. A document's words are
    joined with those keys; the key's position in the window and the document's bounds place the window, and
    its words are compared one by one. ``spans`` are the hit word ranges [start, end).

    One pass over the documents counts the benchmark's words, one matches. The windows are sent to the
    executors in blocks of at most ``block_bytes``; a benchmark of one block needs no shuffle of documents, and
    with more blocks the documents are matched against one block after another.

    Null texts and texts without words have no words and no hits. Items that are null, empty or have no id are
    no items; repeated item ids count once. Repeated documents each get a row.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = stored(items.mapInArrow(_windows(width), "item_id string, window binary"), "windows")
    blocks = max(1, -(-windows.count() * (8 * width + 64) // block_bytes))
    out = texts
    for k in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow() if blocks > 1 else windows.toArrow()
        ids, held = own.column("item_id").to_pylist(), own.column("window").to_pylist()
        vocabulary = np.unique(np.frombuffer(b"".join(held), U64)) if held else np.zeros(0, U64)
        frequency: dict[int, int] = {}
        if len(vocabulary):
            counted = texts.select("text").mapInArrow(_frequencies(spark.sparkContext.broadcast(vocabulary)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
            frequency = dict(zip(np.asarray(counted.column("word")).view(U64).tolist(), counted.column("n").to_pylist(), strict=True))
        index = spark.sparkContext.broadcast(Index.build(ids, held, frequency, width))
        if k:
            out = stored(out, "matched")
        out = out.mapInArrow(_matched(index, not k), "doc_id long, text string, n_words long, spans array<array<long>>, items array<string>")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"), "spans", F.xxhash64("text").alias("text_hash"))
