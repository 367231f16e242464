"""Language identification by partial matching: byte context trees per language, frozen into exact code lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import column_bytes, row_chunks

UNKNOWN = "und"
#: Contexts hold up to so many bytes.
ORDER = 2


def _alphabet() -> tuple[np.ndarray, int]:
    """A symbol for each byte: 0 begins a text, white space, digits, other ASCII, each letter (case folded), each byte beyond ASCII that UTF-8 can hold."""
    table = np.full(256, 3, np.int32)
    table[[0x20, *range(0x09, 0x0E)]] = 1
    table[0x30:0x3A] = 2
    for k in range(26):
        table[[0x41 + k, 0x61 + k]] = 4 + k
    table[0x80:0xC0] = 30 + np.arange(64)
    lead = np.minimum(np.arange(0x40), 30)
    table[0xC0:0x100] = 94 + lead
    return table, 94 + 31


SYMBOLS, SIZE = _alphabet()
_LETTER = regex.compile(r"\p{L}")


def grams(raw: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, its symbol with the ``order`` symbols before it as one number; a text begins with symbols 0."""
    code = SYMBOLS[raw].astype(np.int64)
    out = code.copy()
    position = np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))
    scale = 1
    for k in range(1, order + 1):
        scale *= SIZE
        back = np.zeros_like(code)
        back[k:] = code[:-k] if k <= len(code) else 0
        back[position < k] = 0
        out += back * scale
    return out


def _counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, at = column_bytes(batch.column("text"))
            languages = batch.column("lang").to_numpy(zero_copy_only=False)
            for i, j in row_chunks(at):
                codes = grams(raw[at[i] : at[j]], at[i : j + 1] - at[i], order)
                sizes = np.diff(at[i : j + 1])
                for name in set(languages[i:j]):
                    own = codes[np.repeat(languages[i:j] == name, sizes)]
                    if name not in sums:
                        sums[name] = np.zeros(SIZE ** (order + 1), np.int32)
                    sums[name] += np.bincount(own, minlength=SIZE ** (order + 1)).astype(np.int32)
        for name, counts in sums.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["lang", "gram", "n"])

    return run


class Matcher:
    """Frozen context trees. ``cost[gram, language]`` is the exact code length, in bits, of the gram's last symbol after the others.

    A context that was never seen passes to the next shorter one at no cost. One that was seen gives each symbol
    seen after it n / (total + distinct), and distinct / (total + distinct) to escape to the shorter context;
    below the empty context all symbols are alike.
    """

    def __init__(self, languages: list[str], cost: np.ndarray):
        self.languages, self.cost = languages, cost

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Matcher:
        languages = sorted(counts)
        cost = np.empty((SIZE ** (order + 1), len(languages)), np.float32)
        for k, name in enumerate(languages):
            full = np.zeros(SIZE ** (order + 1))
            full[counts[name][0]] = counts[name][1]
            bits = np.full(SIZE, np.log2(SIZE))
            for depth in range(order + 1):
                n = full.reshape(-1, SIZE ** (depth + 1)).sum(axis=0).reshape(-1, SIZE)
                total, distinct = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
                shorter = np.tile(bits.reshape(-1, SIZE), (len(n) // max(1, len(bits) // SIZE), 1)) if depth else bits[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    own = np.log2((total + distinct) / n)
                    escaped = np.log2((total + distinct) / distinct) + shorter
                bits = np.where(n > 0, own, np.where(total > 0, escaped, shorter)).ravel()
            cost[:, k] = bits
        return cls(languages, cost)

    def bits(self, raw: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(at) - 1, len(self.languages)))
        some = np.flatnonzero(np.diff(at))
        if len(some):
            out[some] = np.add.reduceat(self.cost[grams(raw, at, order)], at[some], axis=0, dtype=np.float64)
        return out


def _predicted(sent, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher: Matcher = sent.value
        latin = np.zeros(256, bool)
        latin[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        for batch in batches:
            raw, at = column_bytes(batch.column("text"))
            named, scores, lengths = [], [], []
            for i, j in row_chunks(at):
                own, own_at = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                letters = np.diff(np.concatenate([[0], np.cumsum(latin[own])])[own_at])
                bits = matcher.bits(own, own_at, order)
                for k in range(j - i):
                    text = own[own_at[k] : own_at[k + 1]]
                    if not len(matcher.languages) or not (letters[k] or (len(text) and _LETTER.search(text.tobytes().decode("utf-8", "replace")))):
                        named.append(UNKNOWN)
                        scores.append(0.0)
                        lengths.append(None)
                        continue
                    best = int(bits[k].argmin())
                    named.append(matcher.languages[best])
                    scores.append(float(1 / np.exp2(np.maximum(bits[k].min() - bits[k], -1000)).sum()))
                    lengths.append(float(bits[k].min()) / len(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(named, pa.string()), pa.array(scores, pa.float64()), pa.array(lengths, pa.float64()), batch.column("text_hash")], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte", "text_hash"])

    return run


def fit_languages(labelled: DataFrame, order: int = ORDER) -> Matcher:
    """Context trees of every language in ``labelled`` (text, lang), from all its rows.

    Each task sums counts of byte runs of ``order`` + 1 symbols; what reaches the driver is at most SIZE**(order + 1)
    counts per language, however many documents there are.
    """
    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    summed = rows.mapInArrow(_counts(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, gram, n = np.array(summed.column("lang").to_pylist(), object), np.asarray(summed.column("gram")), np.asarray(summed.column("n"))
    return Matcher.fit({x: (gram[names == x], n[names == x]) for x in sorted(set(names))}, order)


def identify_languages(docs: DataFrame, order: int = ORDER, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte, text_hash) for each row of ``docs`` (doc_id, text, lang; other columns are ignored).

    Learns from all texts with a language whose crc32(doc_id) mod ``folds`` isn't ``held_fold``; the language, source
    and id of a document play no part in its prediction. The score is the posterior of the best language under
    equal priors. A null text and one without any letter is ``und`` with score 0, and so is every text if there
    is nothing to learn from. Ties go to the first language by name. Repeated rows each get the same result. A
    row without doc_id belongs to no fold: it is learned from and not held out.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held.alias("held_out"))
    matcher = docs.sparkSession.sparkContext.broadcast(fit_languages(slim.where("not held_out"), order))
    return slim.select("doc_id", "text", "held_out", F.xxhash64("text").alias("text_hash")).mapInArrow(_predicted(matcher, order), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double, text_hash long")
