"""Benchmark windows against a scan of every position."""

import hashlib
import re

import pytest

from floodframe.llm import decontaminate as D
from floodframe.llm.common import prepare

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            strings = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i:i + n]) in strings:
                    hit.update(range(i, i + n))
                    found.add("" if item is None else str(item))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


NUMBERS = " ".join(f"n{i}" for i in range(40))
ITEMS = [(7, NUMBERS), (10, NUMBERS), (2, "Short ITEM here"), (3, "solo"), (4, ""), (5, None), (None, "no id item"), (6, "x " * 14), (6, "y z"), (11, "é ü ñ")]
DOCS = [
    (1, "a n3 n4 n5 n6 n7 n8 n9 n10 n11 n12, n13! b"), (2, "n3 n4 n5 n6 n7 n8 n9 n10 n11 c n12"), (3, "short item HERE. solo solo"), (4, None), (5, ""),
    (6, "x " * 30), (7, "x " * 9), (8, "no-id-item y,z É ü ñ é ü ñ"), (None, "y z"), (8, "y z"), (9, "q " * 20_000 + NUMBERS + " q" * 5000), (10, "...---..."), (11, NUMBERS + " " + NUMBERS)]


def rows(df):
    return sorted((tuple(r)[:6] for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


@pytest.fixture
def tables(spark):
    prepare(spark)
    return spark.createDataFrame([(*d, 1, "q") for d in DOCS], "doc_id long, text string, n_hit int, spans string"), spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, doc_id int")


def test_matches_scan(tables):
    assert rows(D.contamination(*tables)) == brute(DOCS, ITEMS)


def test_blocks_of_the_benchmark_give_the_same(tables):
    docs, items = tables
    whole = {(r["doc_id"], r["n_words"]): (r["item_ids"], r["spans"]) for r in D.find_items(docs, items).collect()}
    parts = {(r["doc_id"], r["n_words"]): (r["item_ids"], r["spans"]) for r in D.find_items(docs, items, block_bytes=100).collect()}
    assert whole == parts
    assert whole[1, 13][1][0]["first"] == 1 and whole[1, 13][1][0]["last"] == 11


def test_clean_keeps_columns_and_clean_rows(tables):
    docs, items = tables
    want = sorted(((d, t) for (d, t), r in zip(DOCS, [next(x for x in brute([y], ITEMS)) for y in DOCS]) if not r[5]), key=str)
    for size in (1 << 20, 100):
        kept = D.clean(docs, items, block_bytes=size)
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == want


def test_empty_tables(spark, tables):
    docs, items = tables
    assert D.contamination(docs.limit(0), items).count() == 0
    assert not any(r[5] for r in rows(D.contamination(docs, items.limit(0))))


def test_sample_table(spark):
    prepare(spark)
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    docs = [(r["doc_id"], r["text"]) for r in read("documents").collect()]
    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    assert rows(D.contamination(read("documents"), read("benchmark"))) == brute(docs, items)
