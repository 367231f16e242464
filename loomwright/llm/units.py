"""Encoding whole texts with a public tokenizer through a cache of units between single spaces and line ends."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Estimated bytes of the units kept at once: half for those of late, half for those before them.
CACHE_BYTES = 256 << 20
#: Characters of the texts that are encoded together; longer texts are encoded piece by piece.
GROUP_CHARS = 1 << 20
#: Characters that Python and the tokenizer may take differently as white space.
_DOUBTFUL = "\u180e"
#: Where a text with irregular white space can be cut: before a single space between two visible characters.
_CUT = re.compile(rf"(?<=[^\s{_DOUBTFUL}])(?= [^\s{_DOUBTFUL}])")
_ENDS = ".,;:!?"
#: Units by what is plain to see of their pre-tokens: letters or digits (after a line end, if they begin with it) and
#: perhaps one mark after them; or anything else.
_UNIT = re.compile(rf"(?:(\n?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+))([{_ENDS}]?)|([^ ]*)) ")
_UNIT_COST, _JOINED = 220, 50
#: Characters of the texts whose distinct units are looked up together.
_LOOKED_UP = 1 << 22

_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The encoder of this process; tasks that a worker runs one after another share its cache."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def groups(sizes: Iterable[int], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``limit`` at most, one row at least."""
    i = j = held = 0
    for size in sizes:
        if j > i and held + size > limit:
            yield i, j
            i, held = j, 0
        held += size
        j += 1
    if j > i:
        yield i, j


def _shown(kept: str) -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary; the bytes of ``kept`` stand for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b if b in plain else next(other)) for b in range(256)} | {ord(x): x for x in kept}


def numbered(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct values, number of each value in order, values of each list): what follows is done once for each distinct value."""
    own = lists.flatten().dictionary_encode()
    return own.dictionary, np.asarray(own.indices), np.asarray(pc.list_value_length(lists)).astype(np.int64)


def _odd(unit: str) -> bool:
    first = unit[1:2] if unit[:1] == "\n" else unit[:1]
    return not first or first.isspace() or first == _DOUBTFUL or unit[-1].isspace() or unit[-1] == _DOUBTFUL


class UnitEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)`` of a byte-level BPE.

    Its pre-tokenizer never joins characters across a single space or line end that stands between two visible
    characters, nor a letter with a mark after it, so the pieces between such places are encoded on their own,
    each distinct piece once while the cache holds it. Pieces of letters alone are split by their spaces instead
    of the tokenizer's pattern, which gives the same pre-tokens. Special tokens in a text are found as the
    library finds them.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = self.tokenizer.pre_tokenizer
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # pieces are kept here; most that are new to it occur once
        cut = [pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self.spaces = pre_tokenizers.Sequence(cut)
        #: For units that are written in the vocabulary's own characters already: one cut before each space is enough.
        self.shown, self.space = _shown("\0"), pre_tokenizers.Split("Ġ", "merged_with_next")
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        #: Ids that stand first in a unit of letters.
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == "Ġ" or token == "Ċ"]] = True
        self.cache_bytes, self.held = cache_bytes, 0
        #: Ids of units, without their space; None for one that can't be told apart by spaces alone.
        self.late: dict[str, bytes | None] = {}
        self.before: dict[str, bytes | None] = {}
        self.marks = {"": b""} | dict(zip(_ENDS, self._ids(list(_ENDS)), strict=True))

    def _ids(self, pieces: list[str]) -> list[bytes]:
        kind, self.tokenizer.pre_tokenizer = "H" if self.dtype.itemsize == 2 else "I", self.pattern
        out = [array(kind, x.ids) for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        if sys.byteorder == "big":
            for x in out:
                x.byteswap()
        return [x.tobytes() for x in out]

    def _plain_ids(self, units: list[str]) -> list[bytes]:
        """Ids of units of letters or digits, many to a call; their first ids tell them apart."""
        lined, rest = [u for u in units if u[0] == "\n"], [u for u in units if u[0] != "\n"]
        shown = (" " + "\0 ".join(rest)).encode().decode("latin-1").translate(self.shown).split("\0") if rest else []
        own, more = self._joined_ids(lined, self.spaces), self._joined_ids(shown, self.space)
        if own is None or more is None:
            return self._ids([u if u[0] == "\n" else " " + u for u in units])
        if not lined:
            return more
        own, more = iter(own), iter(more)
        return [next(own if u[0] == "\n" else more) for u in units]

    def _joined_ids(self, spaced: list[str], cut: pre_tokenizers.PreTokenizer) -> list[bytes] | None:
        """Ids of each text, some encoded together; None if their first ids do not tell them apart."""
        self.tokenizer.pre_tokenizer = cut
        flat = array("I")
        for x in self.tokenizer.encode_batch_fast(["".join(spaced[i : i + _JOINED]) for i in range(0, len(spaced), _JOINED)], add_special_tokens=False):
            flat.fromlist(x.ids)
        ids = np.frombuffer(flat, np.uint32) if flat else np.zeros(0, np.uint32)
        at = np.flatnonzero(self.begins[ids])
        if len(at) != len(spaced):
            return None
        raw, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        ends = (np.append(at, len(ids)) * width).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def unit_ids(self, units: list[str]) -> list[bytes | None]:
        """Ids of each unit after its space (or its own line end); None where white space or none is at its edges, so that its surroundings matter."""
        parts = _UNIT.findall(" ".join(units) + " ") if units else []
        cores = dict.fromkeys([c for c, _, _ in parts if c])
        late, before = self.late, self.before
        ids = {c: x for c in [c for c, m, _ in parts if m] if (x := late.get(c) or before.get(c)) is not None}
        new = [c for c in cores if c not in ids]
        ids.update(zip(new, self._plain_ids(new), strict=True))
        rest = [u for c, _, u in parts if not c and not _odd(u)]
        other = dict(zip(rest, self._ids([u if u[0] == "\n" else " " + u for u in rest]), strict=True)) if rest else {}
        marks = self.marks
        return [ids[c] + marks[m] if c else other.get(u) for c, m, u in parts]

    def _learn(self, units: set[str]) -> None:
        """Puts the units into ``late``, from ``before`` where it has them."""
        kept = self.before.keys() & units
        for u in kept:
            self.late[u] = self.before[u]
        new = list(units - kept) if kept else list(units)
        self.late.update(zip(new, self.unit_ids(new), strict=True))
        self.held += _UNIT_COST * len(units)

    def _encode(self, texts: list[str], inside: bool = False) -> list[bytes]:
        """``inside``: each text stands after a single space between visible characters, which is left out."""
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n"), " ")
        units, code, n = numbered(lists)
        at = np.concatenate([[0], np.cumsum(n)])
        first = [] if inside else units.take(pa.array(code[at[:-1]])).to_pylist()
        if not inside:
            code, at = np.delete(code, at[:-1]), at - np.arange(len(at))
        if 2 * self.held > self.cache_bytes:
            self.late, self.before, self.held = {}, self.late, 0
        used = np.flatnonzero(np.bincount(code, minlength=len(units)))
        names = units.take(pa.array(used)).to_numpy(zero_copy_only=False).tolist()
        own = list(map(self.late.get, names))
        missing = [k for k, x in enumerate(own) if x is None]
        self._learn({names[k] for k in missing}.difference(self.late))
        for k in missing:
            own[k] = self.late[names[k]]
        width, size, unknown = self.dtype.itemsize, np.zeros(len(units), np.int64), np.zeros(len(units), bool)
        unknown[used] = [x is None for x in own]
        size[used] = [len(x or b"") // width for x in own]
        ids, start, size = np.frombuffer(b"".join(x or b"" for x in own), self.dtype), np.cumsum(size) - size, size[code]
        ends = np.cumsum(size)
        ids = ids[np.repeat(start[code] - (ends - size), size) + np.arange(size.sum())]
        raw, place = ids.tobytes(), (np.append(0, ends)[at] * width).tolist()
        part = np.append(0, np.cumsum(unknown[code]))[at]
        doubtful, more = (part[1:] > part[:-1]).tolist(), (at[1:] > at[:-1]).tolist()
        out: list[bytes | None] = []
        for k, text in enumerate(texts):
            if doubtful[k] or (not inside and more[k] and (not first[k] or first[k][-1].isspace() or first[k][-1] == _DOUBTFUL)):
                out.append(b"".join(self._ids(_CUT.split(" " + text if inside else text))))
                if not inside:
                    first[k] = ""
            else:
                out.append(raw[place[k] : place[k + 1]])
        return out if inside else [a + b for a, b in zip(self._ids(first), out, strict=True)]

    def _long(self, text: str) -> bytes:
        """The ids of a text that is encoded piece by piece."""
        out, at, inside = [], 0, False
        while at < len(text):
            m = _CUT.search(text, at + GROUP_CHARS)
            to = m.start() if m else len(text)
            out += self._encode([text[at:to]], inside)
            at, inside = to + 1, True
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of ``dtype``."""
        out: list[bytes] = []
        for i, j in groups(map(len, texts), _LOOKED_UP):
            out += self._encode(texts[i:j]) if j > i + 1 or len(texts[i]) <= GROUP_CHARS else [self._long(texts[i])]
        return out
