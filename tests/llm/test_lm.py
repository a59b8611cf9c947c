"""The language model against a plain model over dictionaries."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from floodframe.llm import lm
from floodframe.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*WORD.findall(lower), "</s>"]


def brute(train, texts):
    seen, pairs = Counter(), Counter()
    for t in train:
        w = split(t)
        seen.update(w)
        pairs.update(zip(["<s>", *w], w))
    ended = Counter(w for _, w in pairs)
    follow = Counter(seen) | Counter({"<s>": len(train)})
    counts = lambda c: lm.discounts(*[sum(n == k for n in c.values()) for k in (1, 2, 3, 4)])
    d, e, v, n = counts(pairs), counts(ended), len(seen), sum(seen.values())
    after: dict = {}
    for (u, _), c in pairs.items():
        after.setdefault(u, Counter())[min(c, 3)] += 1
    total = max(len(pairs), 1)
    spare = sum(e[min(c, 3)] for c in ended.values()) / total if pairs else 1.0
    single = lambda w: max(ended[w] - e[min(ended[w], 3)], 0) / total + spare / (v + 1)

    def p(u, w):
        if not follow[u]:
            return single(w)
        back = sum(d[k] * m for k, m in after[u].items()) / follow[u]
        return max(pairs[u, w] - d[min(pairs[u, w], 3)], 0) / follow[u] + back * single(w)

    out = []
    for t in texts:
        w = split(t)
        out.append((len(w), sum(seen[x] > 0 for x in w), sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w),
                    sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w], w))))
    return n, out, seen, p


def compare(spark, rows, shard_bytes):
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    train = [t for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    n, want, *_ = brute(train, [t for _, t, _ in rows])
    model = lm.fit(docs.where(lm.remainder(F.col("doc_id")) != 2), shard_bytes)
    got = {(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score(docs, model).collect()}
    assert model["tokens"] == n
    assert got == {(r[0], a, b, round(c, 6), round(d, 6)) for r, (a, b, c, d) in zip(rows, want)}


@pytest.mark.parametrize("shard_bytes", [1 << 30, 4000])
def test_scores_match_brute_force(spark, shard_bytes):
    docs = prepare(spark).read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rows = [(r["doc_id"], r["text"][:3000], "x") for r in docs]
    compare(spark, rows + [(1000 + k, "the the the the of " * 300, None) for k in range(8)], shard_bytes)


def test_odd_rows(spark):
    prepare(spark)
    compare(spark, [(1, None, None), (2, "", None), (None, "a b", None), (3, "A a\ta b", None), (3, "A a\ta b", None), (4, "é\x1f\x00 x" + "y" * 100_000, None)], 100)
    compare(spark, [(None, "a", None)], 100)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, lm.fit(docs)).count() == 0


def test_probabilities_sum_to_one():
    _, _, seen, p = brute(["a b a c", "a b b", "c a"], [])
    for u in ("a", "b", "<s>", "zz"):
        assert sum(p(u, w) for w in seen) + p(u, "unknown") == pytest.approx(1)
