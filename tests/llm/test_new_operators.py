"""Tokenizer alignment, vector codes and shared lines against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import line_dedup, token_align, vector_codes
from loomwright.llm.language import identify_languages
from loomwright.llm.tokenizer_files import byte_bpe, piece_bpe

DOCS = "doc_id long, text string, key_a string, n_lines string, block string"


def text_rows() -> list[tuple]:
    """Nulls, empties, repeats, clashing columns, long texts, and what tokenizers may take differently."""
    draw = np.random.default_rng(7)
    parts = ["the", "Word", "naïve", "Straße", "it's", "x1y22", "漢字かな", "ไทยไทย", "🙂🙂🏽", "foo_bar", "'ll", "á", "==========", "12345", "<s>", "</s>", "<0x41>", "<|endoftext|>", " ", "᠎", "​", "\x00", "\x1f", "\x85", "﻿", "ﬁ", "٣"]
    gaps = [" ", " ", " ", " ", "\n", "\n\n", "  ", "\t", "\r\n", " \n ", "   ", "　", "", "\x0b", "\n "]
    rows = [(k, "".join(parts[i] + gaps[j] for i, j in zip(draw.integers(0, len(parts), 12), draw.integers(0, len(gaps), 12), strict=True))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "\n"), (204, " \n\t "), (205, "a▁b c"), (206, "▁"), (207, "end "), (208, "end\n"), (209, "  two  spaces  "), (210, "x" * 3000), (211, "ab" * 50 + " " * 70 + "c"), (212, "漢字" * 300), (213, "a\r b\r\nc")]
    rows += [(220, "same text of some words"), (220, "same text of some words"), (None, "same text of some words"), (None, "same text of some words"), (None, None)]
    rows += [(221, " ".join(parts[i] for i in draw.integers(0, 10, 20000)))]
    return [(*r, "k", "n", "b") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(text_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain_tokens(pair: token_align.Pair, text: str | None) -> tuple[list[int], list[int]]:
    if not text:
        return [], []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
        return [], []
    return a, b


def plain_groups(pair: token_align.Pair, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]]:
    ends_a, ends_b = (np.cumsum([len(own[i]) for i in ids]).tolist() for own, ids in ((pair.bytes_a, a), (pair.bytes_b, b)))
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def plain_alignment(rows: list[tuple]) -> Counter:
    pair = token_align.Pair(byte_bpe(), piece_bpe())
    held, count = [], Counter()
    for key, text, *_ in rows:
        a, b = plain_tokens(pair, text)
        groups = plain_groups(pair, a, b)
        links = [x for g in groups for x in product(*g)]
        count.update(set(links))
        held.append((key, a, b, groups, links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = Counter()
    for key, a, b, groups, links in held:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if a else ""
        out[key, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), digest] += 1
    return out


@pytest.mark.parametrize("block_chars", [token_align.BLOCK_CHARS, 500])
def test_alignment_equals_whole_texts_encoded_plainly(docs, block_chars):
    found = Counter(map(tuple, token_align.align_tokenizers(docs, byte_bpe(), piece_bpe(), block_chars).collect()))
    assert found == plain_alignment(text_rows())


def test_alignment_in_writing(docs):
    pair = token_align.Pair(byte_bpe(), piece_bpe())
    want = Counter()
    for key, text, *_ in text_rows():
        want[key, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain_groups(pair, *plain_tokens(pair, text)))] += 1
    assert Counter(map(tuple, token_align.aligned_texts(docs, byte_bpe(), piece_bpe()).collect())) == want


def test_alignment_of_no_rows(none, spark):
    assert token_align.align_tokenizers(none, byte_bpe(), piece_bpe()).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, token_align.align_tokenizers(nothing, byte_bpe(), piece_bpe()).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_cuts_hold_for_these_vocabularies_alone():
    pair = token_align.Pair(byte_bpe(), piece_bpe())
    assert pair.cuts == " \n"
    pair.bytes_b[300] = b"x y"
    assert not pair._parts(" ") and pair._parts("\n")
    pair.bytes_b[300] = b"\nx"
    assert pair._parts(" ") and not pair._parts("\n")


VECTORS = "vec_id long, embedding array<double>, label int, code string, error string"


def vector_rows() -> list[tuple]:
    draw = np.random.default_rng(3)
    rows = [(k * 3, [float(x) for x in draw.normal(0, 1, 16)], int(draw.integers(0, 3)) if k % 7 else None) for k in range(300)]
    rows += [(5, None, 1), (6, [], 1), (8, [1.0, None] * 8, 1), (10, [math.nan] * 16, 2), (11, [math.inf] + [0.0] * 15, 2), (13, [0.5] * 8, 1), (14, [0.5] * 15, 1), (16, [1e30] * 8 + [-1e30] * 8, 2)]
    rows += [(9, rows[3][1], 1), (9, rows[4][1], 1), (None, rows[5][1], 0), (2, [-0.00001] * 16, 9), (2, [-0.00001] * 16, 9)]
    return [(*r, "x", "y") for r in rows]


def plain_codes(rows: list[tuple], entries: int = 16) -> tuple[Counter, str]:
    limit = vector_codes.LIMIT
    kept = [(i, [math.floor(max(min(x * 4096, limit), -limit)) for x in v], label) for i, v, label, *_ in rows if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v)]
    first: dict = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    start = [first[i] for i in sorted(first, key=lambda i: (i is None, i or 0))[:entries]]
    books = [[v[p * 2 : p * 2 + 2] for v in start] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    code = lambda p, v: min(range(len(books[p])), key=lambda e: (far(v[p * 2 : p * 2 + 2], books[p][e]), e))
    for _ in range(6):
        assigned = [[code(p, v) for p in range(8)] for _, v, _ in kept]
        new = []
        for p in range(8):
            own = []
            for e in range(len(books[p])):
                parts = [v[p * 2 : p * 2 + 2] for (_, v, _), c in zip(kept, assigned, strict=True) if c[p] == e]
                own.append([sum(x) // len(parts) for x in zip(*parts, strict=True)] if parts else books[p][e])
            new.append(own)
        books = new
    found = [(i, label, [code(p, v) for p in range(8)], v) for i, v, label in kept]
    errors = [sum(far(v[p * 2 : p * 2 + 2], books[p][c[p]]) for p in range(8)) for _, _, c, v in found]
    by_label = Counter()
    for (_, label, _, _), e in zip(found, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{x:02x}" for x in c), e, by_label[label]) for (i, label, c, _), e in zip(found, errors, strict=True)), digest


@pytest.mark.parametrize("few", [False, True])
def test_vector_codes_equal_plain_rounds(spark, few):
    rows = vector_rows()[:5] + vector_rows()[300:] if few else vector_rows()
    made = vector_codes.compress_vectors(spark.createDataFrame(rows, VECTORS).repartition(3))
    found = Counter(map(tuple, vector_codes.label_errors(made.codes).select("vec_id", "code", "error", "label_error").collect()))
    assert (found, made.digest()) == plain_codes(rows)


def test_nearest_is_exact_and_compares_few_entries():
    draw = np.random.default_rng(5)
    for spread in (1, 3, 4000):
        queries, entries = draw.integers(-spread, spread + 1, (5000, 8)), draw.integers(-spread, spread + 1, (16, 8))
        entries[9] = entries[4]
        apart = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
        code, error, compared = vector_codes.nearest(queries, entries)
        assert (code == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all()
        assert compared.min() >= 1 and compared.mean() < 10


def test_vector_codes_of_no_usable_rows(spark):
    for rows in ([], [(1, None, 1, "x", "y"), (2, [math.nan] * 8, 1, "x", "y")]):
        made = vector_codes.compress_vectors(spark.createDataFrame(rows, VECTORS))
        assert made.codebooks is None and vector_codes.label_errors(made.codes).collect() == []
        assert made.digest() == hashlib.sha256(b"").hexdigest()


def plain_lines(rows: list[tuple], min_docs: int, min_chars: int = 1) -> Counter:
    split = [(key, (text or "").split("\n")) for key, text, *_ in rows]
    key_of = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = Counter(k for _, lines in split for k in {key_of(x) for x in lines})
    out = Counter()
    for key, lines in split:
        kept = [x for x in lines if not (len(key_of(x)) >= min_chars and holders[key_of(x)] >= min_docs)]
        out[key, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def line_rows() -> list[tuple]:
    draw = np.random.default_rng(11)
    lines = ["Home", " home\t", "HOME\r", "About us", "", " ", "É", "é", "Copyright 2020", "unique", " home", "🙂", "İ"]
    rows = [(k, "\n".join(lines[i] if i < len(lines) else f"own {k} {i}" for i in draw.integers(0, len(lines) + 6, 12))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "Home"), (104, "Home\nhome\n\nHOME"), (105, "only here\nHome\n"), (106, "\n".join(["rare", "Home"] * 6000))]
    rows += [(107, "repeated row\nx")] * 3 + [(None, "repeated row\ny")] * 4 + [(None, None)] + [(108, f"repeated row\nz{k}") for k in range(3)]
    return [(*r, "k", "n", "b") for r in rows]


@pytest.mark.parametrize(("min_docs", "min_chars", "bound"), [(10, 1, 1 << 18), (3, 2, 0), (1, 1, 1 << 18)])
def test_shared_lines(spark, monkeypatch, min_docs, min_chars, bound):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", bound)
    found = line_dedup.drop_shared_lines(spark.createDataFrame(line_rows(), DOCS).repartition(3), min_docs, min_chars)
    assert Counter(map(tuple, found.collect())) == plain_lines(line_rows(), min_docs, min_chars)


def test_shared_lines_of_no_rows(none):
    assert line_dedup.drop_shared_lines(none).collect() == []


def test_frequent_keys_count_documents(spark):
    rows = spark.createDataFrame([(k, "a\na\nb") for k in range(12)] + [(20, "A ")], "doc_id long, text string")
    assert sorted(r["n_docs"] for r in line_dedup.frequent_keys(rows).collect()) == [12, 13]
    assert line_dedup.drop_shared_lines(rows).agg(F.sum("n_dropped")).first()[0] == 37


def test_numbers_that_look_like_letters_are_none(spark):
    rows = [(k, "The cat and the dog. " * 3, "en") for k in range(12)] + [(100 + k, t, None) for k, t in enumerate(["½ ² ① Ⅷ", "١٢٣ 42", "a½", "é", "漢", "ʰ"])]
    got = {r.doc_id: r.lang_pred for r in identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[100 + k] == "und" for k in range(6)] == [True, True, False, False, False, False]
