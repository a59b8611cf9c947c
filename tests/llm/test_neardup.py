"""Near duplicates against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from floodframe.llm import neardup
from floodframe.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            linked = a and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & sets[j]) >= 80 * len(a | sets[j])
            if linked or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), None if d is None else least[root(i)], d is None or d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, rows, extra="component_id"):
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], f"doc_id long, text string, {extra} int, a string")
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()), key=str)


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_matches_all_pairs(spark):
    rng = random.Random(3)
    texts = [t for k in range(12) for t in family(rng, 12, 40 + 30 * k, 2 + 2 * k)]
    texts += family(rng, 30, 12, 2) + ["one", "one", "One", "two", "a b", "b a", "a b a", "", None, " \n"]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    assert found(prepare(spark), rows) == brute(rows)


def test_chains_are_followed(spark):
    words = [f"v{i}" for i in range(140)]
    rows = [(100 - k, " ".join(words[2 * k:2 * k + 60])) for k in range(40)]
    want = brute(rows)
    assert len({r[2] for r in want}) == 1
    assert found(prepare(spark), rows) == want


def test_sample_table(spark):
    docs = prepare(spark).read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"z{i}" for i in range(30_000))
    rows = [(None, "a b c"), (None, None), (5, "a b c"), (5, "a b c"), (4, "a b c"), (7, long), (6, long + " end"), (9, "p q r s"), (9, "t u v w"), (8, "t u v w"), (3, None), (2, "")]
    assert found(prepare(spark), rows) == brute(rows)
    assert found(spark, []) == []


def test_one_of_each_keeps_columns(spark):
    docs = prepare(spark).createDataFrame([(1, "a b c", 1), (2, "a b c", 2), (3, "d e", 3), (3, "d e", 3), (None, "a b c", 4), (4, None, 5)], "doc_id long, text string, n_shingles int")
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c", 1), (3, "d e", 3), (None, "a b c", 4), (4, None, 5)], key=str)


@pytest.mark.parametrize("similarity", [0.3, 0.8, 0.95])
def test_estimate(similarity):
    rng = np.random.default_rng(1)
    n = 3000
    common = int(2 * n * similarity / (1 + similarity))
    value = rng.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
    sets = np.concatenate([value[:n], value[n - common:]])
    rows = neardup.sketches(sets, np.array([0, n, 2 * n]))
    got = neardup.estimate(rows[:1], rows[1:], np.array([n * 1.0]), np.array([n * 1.0]))[0]
    assert abs(got - similarity) < 0.09
    # registers of a union are the maxima of both sides
    union = neardup.sketches(value, np.array([0, len(value)]))
    assert (np.maximum(rows[0], rows[1]) == union[0]).all()
