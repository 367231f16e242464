"""Alignment of two tokenizers over whole texts, each distinct segment of text tokenised and aligned once.

A text is cut before runs of white space, where neither vocabulary has a token that goes on across the cut, so the
tokens of a text are those of its segments, one after another, and every cut is the end of a token of both. Documents
are numbered in blocks: a block holds the numbers of each document's segments and each distinct segment once. The
blocks' segments meet by their text, where each distinct one is encoded by both tokenizers and aligned; alignments go
back to the blocks that hold the segment, packed by block, and each block composes its documents from them.

An alignment is an array of unsigned 32-bit numbers: how many tokens A has, then A's tokens, then B's, each as twice
its id, plus one if a group ends with it.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer, pre_tokenizers

from ..storage import drop_stored, stored
from .textbytes import row_chunks

#: A block is closed at so many characters.
BLOCK_CHARS = 1 << 24
#: Occurrences of segments whose pairs are told apart at once; a longer document is taken alone.
_OCCURRENCES = 1 << 18
_GROUP_CHARS = 1 << 20
#: Tokens and links of segments that are written or linked at once; a longer segment is taken alone.
_LINKS = 1 << 18
#: Alignments that a task gathers before it sends them back.
_PACKED_ROWS = 1 << 20
_SPACE = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_BLOCKS = "block long, doc_ids array<long>, sizes array<int>, numbers binary, segments array<string>"
_COMPOSED = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, sizes array<int>, numbers binary, links binary, pairs array<long>, n_docs array<int>"


def _byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers: A is byte-level BPE of the tokenizers library, B a sentencepiece model that puts a space before the text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[x] for x in token) if all(x in letters for x in token) else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = _BYTE_PIECE.fullmatch(piece) if self.b.is_byte(i) else None
            self.bytes_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace(_SPACE, " ").encode())
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id(_SPACE)
        self.cuts = "".join(c for c in " \n" if self._parts(c))
        #: U+180E is white space to some pattern engines only, so no text is cut after it.
        self.cut = re.compile(rf"(?<=[^\s᠎])(?=[{self.cuts}])") if self.cuts else None

    def _parts(self, space: str) -> bool:
        """Whether no token of A or B has ``space`` after a character that isn't white space, and a line end is in no longer piece of B.

        A's own pattern ends a token before white space, whatever follows it. B's merges only ever make its pieces.
        """
        across = re.compile(rf"\S{space}")
        inside = space != " " and any(space.encode() in x and len(x) > 1 for x in self.bytes_b)
        return isinstance(self.a.pre_tokenizer, pre_tokenizers.ByteLevel) and self.a.normalizer is None and not inside and not any(across.search(x.decode(errors="replace")) for own in (self.bytes_a, self.bytes_b) for x in own)

    def segments(self, text: str) -> list[str]:
        """Space and text, cut; each segment begins with a space or a line end."""
        return self.cut.split(" " + text) if self.cut else [" " + text]

    def _ids_b(self, segments: list[str]) -> list[list[int]]:
        """B puts a space before what it encodes: the segment's own, or one more token before a line end."""
        own = self.b.encode([x[1:] if x[0] == " " else x for x in segments], num_threads=1)
        return [[self.space] if x == " " else ids if x[0] == " " else ids[1:] for x, ids in zip(segments, own, strict=True)]

    def align(self, segments: list[str]) -> list[bytes | None]:
        """The alignment of each segment; None where the tokens' bytes are not the segment's."""
        ids_a = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        ids_b = self._ids_b(segments)
        same = []
        for text, own_a, own_b in zip(segments, ids_a, ids_b, strict=True):
            raw = text.encode()
            same.append(b"".join([self.bytes_b[i] for i in own_b]) == raw and b"".join([self.bytes_a[i] for i in own_a]) == raw)
        kept_a, kept_b = ([x for x, s in zip(own, same, strict=True) if s] for own in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (kept_a, kept_b))
        end_a, end_b = np.cumsum(self.sizes_a[flat_a]), np.cumsum(self.sizes_b[flat_b])
        words_a, words_b = ((flat << 1 | np.isin(ends, others)).astype("<u4").tobytes() for flat, ends, others in ((flat_a, end_a, end_b), (flat_b, end_b, end_a)))
        out, i, j = [], 0, 0
        kept = zip(map(len, kept_a), map(len, kept_b), strict=True)
        for s in same:
            if not s:
                out.append(None)
                continue
            n, m = next(kept)
            out.append(n.to_bytes(4, "little") + words_a[4 * i : 4 * (i + n)] + words_b[4 * j : 4 * (j + m)])
            i, j = i + n, j + m
        return out


@functools.cache
def tokenizer_pair(path_a: str, path_b: str) -> Pair:
    """The tokenizers of this process; tasks that a worker runs one after another share them."""
    return Pair(path_a, path_b)


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _zipped(numbers: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, packed byte by byte of all, as the high bytes hardly differ."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unzipped(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<i4").ravel()


def _number(path_a: str, path_b: str, block_chars: int):
    names = [x.split()[0] for x in _BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, base = tokenizer_pair(path_a, path_b), TaskContext.get().partitionId() << 33
        numbers, keys, sizes, found, held, seq = _Numbers(), [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal numbers, keys, sizes, found, held, seq
            flat = np.concatenate([np.zeros(0, np.uint32), *found])
            row = [pa.array([base + seq]), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([_zipped(flat)], pa.binary()), pa.array([list(numbers)], pa.list_(pa.string()))]
            numbers, keys, sizes, found, held, seq = _Numbers(), [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays(row, names)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                own = pair.segments(text) if text else []
                keys.append(key)
                sizes.append(len(own))
                found.append(np.fromiter(map(numbers.__getitem__, own), np.uint32, len(own)))
                held += len(text or "")
                if held >= block_chars:
                    yield close()
        if keys:
            yield close()

    return run


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... ``many[0]`` of them, and so on for each."""
    ends = np.cumsum(many)
    return np.arange(int(many.sum())) + np.repeat(first - (ends - many), many)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each range at[i]:at[i + 1]."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[at])


def _picked_sums(values: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the values at numbers[at[i]:at[i + 1]], some ranges at a time."""
    parts = [_sums(values[numbers[at[i] : at[j]]], at[i : j + 1] - at[i]) for i, j in row_chunks(at, _OCCURRENCES)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


class _Packed:
    """Alignments on their way back to their blocks: those of one block together, in few rows."""

    def __init__(self):
        self.homes, self.numbers, self.codes, self.known, self.held = [], [], [], [], 0

    def add(self, homes: np.ndarray, numbers: np.ndarray, codes: list[int]) -> None:
        self.homes.append(homes)
        self.numbers.append(numbers)
        self.codes.append(np.array(codes, np.int64))
        self.held += len(codes)

    def rows(self) -> pa.RecordBatch:
        home, number, code = (np.concatenate(x) for x in (self.homes, self.numbers, self.codes))
        words = np.frombuffer(b"".join(x or b"" for x in self.known), "<u4")
        size = np.array([len(x or b"") // 4 for x in self.known], np.int64)
        first = np.cumsum(size) - size
        order = np.lexsort((number, home))
        home, number, code = home[order], number[order], code[order]
        at = np.append(np.flatnonzero(np.diff(home, prepend=home[0] - 1)), len(home)).tolist()
        out = [[], [], [], []]
        for i, j in zip(at, at[1:], strict=False):
            own = code[i:j]
            for column, x in zip(out, (home[i], _zipped(np.diff(number[i:j], prepend=0)), _zipped(size[own]), _zipped(words[_spread(first[own], size[own])])), strict=True):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], ["home", "steps", "sizes", "words"])


def _align(path_a: str, path_b: str):
    """Rows come in order of their segment, so that each distinct one is aligned once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, packed, last = tokenizer_pair(path_a, path_b), _Packed(), None
        for batch in batches:
            segments = batch.column("segment").to_pylist()
            new = list(dict.fromkeys(segments))
            known = {}
            if packed.known and new and new[0] == last:
                known[new.pop(0)] = len(packed.known) - 1
            i = 0
            while i < len(new):
                j, chars = i, 0
                while j < len(new) and (j == i or chars + len(new[j]) <= _GROUP_CHARS):
                    chars += len(new[j])
                    j += 1
                known.update(zip(new[i:j], range(len(packed.known), len(packed.known) + j - i), strict=True))
                packed.known += pair.align(new[i:j])
                i = j
            last = segments[-1] if segments else last
            packed.add(*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("home", "number")), [known[x] for x in segments])
            if packed.held >= _PACKED_ROWS:
                yield packed.rows()
                packed, code = _Packed(), packed.known[-1]
                packed.known.append(code)
        if packed.held:
            yield packed.rows()

    return run


class Segments:
    """The alignments of a block's distinct segments, by number."""

    def __init__(self, codes: pa.Table):
        parts = [[_unzipped(x.as_py()) for x in codes.column(c)] for c in ("steps", "sizes", "words")]
        none = [np.zeros(0, np.int64)]
        number, size = np.concatenate(none + [np.cumsum(x) for x in parts[0]]), np.concatenate(none + parts[1])
        words = np.concatenate([np.zeros(0, np.int32), *parts[2]])
        del parts
        begin, order, n = np.cumsum(size) - size, np.argsort(number), len(number)
        begin, size = begin[order], size[order]
        del number, order
        self.valid = size > 0
        self.n_a = np.zeros(n, np.int64)
        self.n_a[self.valid] = words[begin[self.valid]]
        self.n_b = np.where(self.valid, size - 1 - self.n_a, 0)
        a, b = words[_spread(begin + 1, self.n_a)], words[_spread(begin + 1 + self.n_a, self.n_b)]
        #: The tokens' groups, numbered through the block.
        self.group_a, self.group_b = (np.cumsum(x & 1, dtype=np.int32) - (x & 1) for x in (a, b))
        self.a, self.b = a >> 1, b >> 1
        ends = np.concatenate([[0], np.cumsum(a & 1)])
        self.at_a, self.at_b = (np.concatenate([[0], np.cumsum(x)]) for x in (self.n_a, self.n_b))
        #: The groups of segment i are group_at[i]:group_at[i + 1].
        self.group_at = ends[self.at_a]
        self.n_groups = np.diff(self.group_at)
        groups = int(self.group_at[-1])
        self.n_links = _sums(np.bincount(self.group_a, minlength=groups) * np.bincount(self.group_b, minlength=groups), self.group_at)

    def _chunks(self) -> Iterator[tuple[int, int]]:
        """Ranges of segments with a bounded number of tokens and links, one segment at least."""
        return row_chunks(np.concatenate([[0], np.cumsum(self.n_a + self.n_b + self.n_links)]), _LINKS)

    def texts(self) -> list[str]:
        """Each segment's groups in writing: ids joined by commas, A's and B's by a bar, groups by semicolons."""
        out = []
        for i, j in self._chunks():
            (a, group_a), (b, group_b) = ((ids[at[i] : at[j]], group[at[i] : at[j]]) for ids, group, at in ((self.a, self.group_a, self.at_a), (self.b, self.group_b, self.at_b)))
            side = np.repeat([0, 1], [len(a), len(b)])
            group = np.concatenate([group_a, group_b])
            order = np.argsort(group << 1 | side, kind="stable")
            ids, group, side = np.concatenate([a, b])[order], group[order], side[order]
            mark = np.zeros(len(ids), np.int64)
            mark[:-1] = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
            at = np.concatenate([[0], np.cumsum((self.n_a + self.n_b)[i:j])])
            mark[at[1:][self.valid[i:j]] - 1] = 3
            known, place = np.unique(ids << 2 | mark, return_inverse=True)
            written = [f"{x >> 2}{(',', '|', ';', '')[x & 3]}" for x in known.tolist()]
            parts, bounds = list(map(written.__getitem__, place.tolist())), at.tolist()
            out += ["".join(parts[k:m]) for k, m in zip(bounds, bounds[1:], strict=False)]
        return out

    def _links(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(links of each of the segments, their pairs as A's id << 32 | B's, how often each is in the segment)."""
        parts = []
        low, groups = self.group_at[i], int(self.group_at[j] - self.group_at[i])
        for ids, group, at in ((self.a, self.group_a, self.at_a), (self.b, self.group_b, self.at_b)):
            key, times = np.unique((group[at[i] : at[j]] - low).astype(np.int64) << 24 | ids[at[i] : at[j]], return_counts=True)
            many = np.bincount(key >> 24, minlength=groups)
            parts.append((key & 0xFFFFFF, times, many, np.cumsum(many) - many))
        (id_a, times_a, many_a, _), (id_b, times_b, many_b, first_b) = parts
        of = np.repeat(np.arange(groups), many_a)
        per = many_b[of]
        left, right = np.repeat(np.arange(len(id_a)), per), _spread(first_b[of], per)
        segment = np.repeat(np.arange(j - i), self.n_groups[i:j])[of[left]]
        pair, times = id_a[left] << 32 | id_b[right], times_a[left] * times_b[right]
        order = np.lexsort((pair, segment))
        pair, segment, times = pair[order], segment[order], times[order]
        first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(segment, prepend=-1) != 0))
        times = np.add.reduceat(times, first) if len(first) else times
        return np.bincount(segment[first], minlength=j - i), pair[first], times

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pairs of the block, bounds of each segment's links, the pair of each, how often it is in the segment)."""
        none = [np.zeros(0, np.int64)]
        many, pair, times = ([*none, *x] for x in zip(*(self._links(*c) for c in self._chunks()), strict=True)) if len(self.n_a) else (none, none, none)
        known, place = np.unique(np.concatenate(pair), return_inverse=True)
        return known, np.concatenate([[0], np.cumsum(np.concatenate(many))]), place.astype(np.int32), np.concatenate(times).astype(np.int32)


class Documents:
    """A block's documents: the segment numbers of document i are numbers[at[i]:at[i + 1]]."""

    def __init__(self, block: pa.Table):
        self.block = block.column("block")[0].as_py()
        self.keys = block.column("doc_ids").combine_chunks().flatten()
        self.sizes = block.column("sizes").combine_chunks().flatten()
        self.packed = block.column("numbers")[0].as_py()
        self.numbers = _unzipped(self.packed)
        self.at = np.concatenate([[0], np.cumsum(self.sizes.to_numpy(zero_copy_only=False).astype(np.int64))])

    def sums(self, values: np.ndarray) -> np.ndarray:
        return _picked_sums(values, self.numbers, self.at)

    def valid(self, segments: Segments) -> np.ndarray:
        return (self.sums((~segments.valid).astype(np.int64)) == 0) & (np.diff(self.at) > 0)

    def texts(self, segments: Segments, valid: np.ndarray) -> Iterator[str]:
        """The groups of each document; nothing for one that has no tokens."""
        written = segments.texts()
        for i, good in enumerate(valid.tolist()):
            yield ";".join(map(written.__getitem__, self.numbers[self.at[i] : self.at[i + 1]].tolist())) if good else ""

    def holders(self, valid: np.ndarray, link_at: np.ndarray, pair_of: np.ndarray, pairs: int) -> np.ndarray:
        """How many valid documents hold each pair."""
        out = np.zeros(pairs, np.int64)
        many = np.diff(link_at)
        for i, j in row_chunks(self.at, _OCCURRENCES):
            numbers = self.numbers[self.at[i] : self.at[j]]
            doc = np.repeat(np.arange(j - i), np.diff(self.at[i : j + 1]))
            good = valid[i:j][doc]
            held = np.unique(doc[good] * len(many) + numbers[good])
            doc, segment = held // max(1, len(many)), held % max(1, len(many))
            key = np.repeat(doc, many[segment]) * pairs + pair_of[_spread(link_at[segment], many[segment])]
            out += np.bincount(np.unique(key) % max(1, pairs), minlength=pairs)
        return out


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _compose(block: pa.Table, codes: pa.Table) -> pa.Table:
    docs, segments = Documents(block), Segments(codes)
    valid = docs.valid(segments)
    pairs, link_at, pair_of, times = segments.pairs()
    counts = [_lists(docs.sums(x) * valid, pa.int64()) for x in (segments.n_a, segments.n_b, segments.n_groups, segments.n_links)]
    links = _zipped(np.concatenate([[len(link_at) - 1], np.diff(link_at), pair_of, times]))
    held = docs.holders(valid, link_at, pair_of, len(pairs))
    del link_at, pair_of, times
    sizes = pa.array(np.where(valid, np.diff(docs.at), -np.diff(docs.at)), pa.int32())
    digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in docs.texts(segments, valid)]
    lists = [_lists(docs.keys, pa.int64()), *counts, pa.ListArray.from_arrays(pa.array([0, len(digests)], pa.int32()), pa.array(digests, pa.string())), _lists(sizes, pa.int32())]
    columns = [pa.array([docs.block]), *lists, pa.array([docs.packed], pa.binary()), pa.array([links], pa.binary()), _lists(pairs, pa.int64()), _lists(held, pa.int32())]
    return pa.table(columns, [x.split()[0] for x in _COMPOSED.split(", ")])


def _texts(block: pa.Table, codes: pa.Table) -> pa.Table:
    docs, segments = Documents(block), Segments(codes)
    return pa.table([docs.keys, pa.array(docs.texts(segments, docs.valid(segments)), pa.string())], ["doc_id", "groups"])


def _score(block: pa.Table, scores: pa.Table) -> pa.Table:
    signed = block.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    numbers, links = _unzipped(block.column("numbers")[0].as_py()), _unzipped(block.column("links")[0].as_py())
    pairs = block.column("n_pairs")[0].as_py()
    count, best = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    at = scores.column("place").combine_chunks().to_numpy(zero_copy_only=False)
    count[at], best[at] = (scores.column(x).combine_chunks().to_numpy(zero_copy_only=False) for x in ("count", "best"))
    many, (pair_of, times) = links[1 : links[0] + 1], np.split(links[links[0] + 1 :], 2)
    link_at = np.concatenate([[0], np.cumsum(many)])
    doc_at = np.concatenate([[0], np.cumsum(np.abs(signed))])
    totals = [_picked_sums(_sums(times * x[pair_of], link_at), numbers, doc_at) * (signed > 0) for x in (best, count)]
    own = [block.column(x).combine_chunks().flatten() for x in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
    columns = [*own, *(pa.array(x, pa.int64()) for x in totals), block.column("groups_sha256").combine_chunks().flatten()]
    return pa.table(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _blocks_and_codes(docs: DataFrame, path_a: str, path_b: str, block_chars: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = stored(rows.mapInArrow(_number(path_a, path_b, block_chars), _BLOCKS), "segment-blocks")
    held = blocks.select(F.col("block").alias("home"), F.posexplode("segments").alias("number", "segment"))
    codes = held.repartition("segment").sortWithinPartitions("segment").mapInArrow(_align(path_a, path_b), "home long, steps binary, sizes binary, words binary")
    return blocks.select("block", "doc_ids", "sizes", "numbers"), codes


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, groups): the groups of each text in writing, ``a1,a2|b1;a3|b2,b3``; nothing for a text that has no tokens (see ``align_tokenizers``)."""
    blocks, codes = _blocks_and_codes(docs, path_a, path_b, block_chars)
    return blocks.groupBy("block").cogroup(codes.groupBy("home")).applyInArrow(_texts, "doc_id long, groups string")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level BPE at ``path_a``, B the sentencepiece model at ``path_b``; both encode a space and the text.
    Special tokens in a text are plain text. A null or empty text, and one whose tokens' bytes of A or B differ from
    the space and the text (U+2581 in it, say), has no tokens: zeros and an empty digest. Every row is a document of
    its own, so repeated rows, and rows that share a doc_id or have none, count as often as they are there. An
    A id's pairs with the greatest count tie. An empty table gives an empty result.

    What a task holds is a block: some 16 million characters, or one longer text, and its distinct segments. A segment
    is in a block once, so no segment, pair or document has more rows in a shuffle than there are blocks.
    """
    blocks, codes = _blocks_and_codes(docs, path_a, path_b, block_chars)
    composed = stored(blocks.groupBy("block").cogroup(codes.groupBy("home")).applyInArrow(_compose, _COMPOSED), "composed-blocks")
    drop_stored(blocks)
    # Pairs that no valid document holds are in the lists too, with no documents.
    counts = composed.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n_docs").alias("count"))
    counts = stored(counts, "pair-counts")
    a_id = F.shiftright("pair", 32).alias("a_id")
    most = counts.groupBy(a_id).agg(F.max("count").alias("most"))  # a row for each id of A's vocabulary at most
    scores = counts.select("pair", "count", a_id).join(F.broadcast(most), "a_id").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    held = composed.select(F.col("block").alias("home"), F.posexplode("pairs").alias("place", "pair"))
    found = held.join(scores, "pair").select("home", "place", "count", "best")
    parts = composed.select("block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "sizes", "numbers", "links", F.size("pairs").alias("n_pairs"))
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return parts.groupBy("block").cogroup(found.groupBy("home")).applyInArrow(_score, out)
