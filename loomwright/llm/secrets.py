"""Secret scans: fixed patterns, and sliding-window entropy per character class over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Any text with a span matches one of these; RE2 rules out the rest in one pass.
_LIKELY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[A-Za-z0-9+/_=-]{20}"""

WINDOW = 20
#: Per class: its characters and the bits per character that a window of it needs. A random window of 20 has about
#: 3.2 bits over hexadecimal digits and 4.0 over the others; words of a language stay well below.
CLASSES = {
    "hex": (frozenset("0123456789abcdefABCDEF"), 3.0),
    "base64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 3.7),
    "url64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"), 3.7),
}
#: Candidates that are no secrets: UUIDs, plain numbers and dates, and stand-ins.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9+/_=-]+"),
)
#: Stand-ins: a span that holds one of these is none; what stands beside it in the same string is judged by itself.
STAND_INS = re.compile(r"example|sample|dummy|placeholder|changeme|xxxx|abcdefgh|12345678|your[_-]", re.IGNORECASE)


def hot_ranges(text: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """The unions of all windows whose entropy within one class reaches the class's bits and that mix digits with letters.

    The window slides over each run of the class; the sum of c * log2(c) over the counts c is kept up to date as a
    character enters and one leaves, so a run costs time in proportion to its length.
    """
    found: list[tuple[int, int]] = []
    part = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    full = math.log2(window)
    for characters, least in CLASSES.values():
        counts: dict[str, int] = {}
        run, weight, digits, letters = 0, 0.0, 0, 0
        for i, x in enumerate(text):
            if x not in characters:
                counts.clear()
                run, weight, digits, letters = 0, 0.0, 0, 0
                continue
            if run == window:
                old = text[i - window]
                c = counts[old]
                counts[old] = c - 1
                weight += part[c - 1] - part[c]
                digits -= old.isdigit()
                letters -= old.isalpha()
            else:
                run += 1
            c = counts.get(x, 0)
            counts[x] = c + 1
            weight += part[c + 1] - part[c]
            digits += x.isdigit()
            letters += x.isalpha()
            if run == window and digits and letters and full - weight / window >= least:
                found.append((i - window + 1, i + 1))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index into KINDS), ordered; positions are code points, the end is exclusive."""
    spans = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    known = sorted(spans)
    begins, reach = [a for a, _, _ in known], list(accumulate((b for _, b, _ in known), max))
    for m in _CANDIDATE.finditer(text):
        if any(rule.fullmatch(m[0]) for rule in ALLOWED):
            continue
        for a, b in hot_ranges(m[0]):
            a, b = a + m.start(), b + m.start()
            before = bisect_left(begins, b)
            if not (before and reach[before - 1] > a) and not STAND_INS.search(text, a, b):
                spans.append((a, b, 3))
    return sorted(spans)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        texts = batch.column(1)
        likely = pc.fill_null(pc.match_substring_regex(texts, _LIKELY), False).to_pylist()
        counts, hashes, spans = ([], [], []), [], []
        for x, maybe in zip(texts, likely, strict=True):
            found = secret_spans(x.as_py()) if maybe else []
            for k in range(3):
                counts[k].append(sum(s[2] == k for s in found))
            base = _joined([s for s in found if s[2] < 3])
            hashes.append(hashlib.sha256(base.encode()).hexdigest() if base else none)
            spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in found])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, found) for each row of ``docs`` (doc_id, text; other columns are ignored).

    ``found`` has all spans (kind, start, end) by start, then kind. Those of the patterns are always there; spans
    of kind ``entropy`` are added where none of those lies and no allow-list rule fits the candidate string. A
    null or empty text has none; repeated rows each get theirs. Rows are independent: nothing is shuffled.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:string,start:long,end:long>>")
