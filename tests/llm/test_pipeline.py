"""The pipeline's stages on rows whose doc_id is null or repeated."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"item{k}" for k in range(12))


def prose(k: int, n: int = 60) -> str:
    return " ".join(f"w{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in np.random.default_rng(k).integers(0, 600, n))


def rows() -> list[tuple]:
    near = prose(3).split()
    near[30] = "changed"
    texts = [(None, prose(1, 80)), (None, prose(2, 80)), (None, None), (None, "12 34 !"), (7, prose(3)), (7, prose(4)), (8, " ".join(near[:30] + near[31:])), (9, prose(5)), (9, f"{prose(6)} {PASSAGE}"), (9, "56 78"), (None, f"{prose(7)} {PASSAGE}"), (10, ""), (11, prose(8)), (11, prose(8)), (None, prose(1, 80)), (12, prose(2, 80)), (13, prose(4) + " more")]
    return [(i, t, "en", "ab"[k % 2], len(t or "")) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain() -> list[list[tuple]]:
    """What the first three stages leave, by brute force."""
    lettered = [r[:2] for r in rows() if r[1] and any(c.isalpha() for c in r[1])]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in lettered]
    group = list(range(len(lettered)))
    for a in range(len(lettered)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    kept = [min((lettered[k] for k in range(len(lettered)) if group[k] == g), key=lambda r: (r[0] is None, r[0] or 0)) for g in sorted(set(group))]
    return [lettered, kept, [r for r in kept if PASSAGE not in r[1]]]


def test_rows_are_judged_by_their_own_text(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), want in zip(P.STAGES, plain(), strict=False):
        docs = P.stored(stage(spark, docs, folder), name)
        assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(want), name
