"""Quality rules against plain counts, and the log ratio against dictionaries."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from floodframe.llm import rules as R, words as W
from floodframe.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


TEXTS = [None, "", " \n\t", "one", "a\n a\na\n\n\nb\na", "#x $y <z> é|ü", "p q r s t " * 3, "a b c d e f g h i j k l m n o p q r s t u v w x y z " + "1 2 3 4 5 6 0 1 2 3 4 5",
         "Ünïcödé wörds ärë côunted by code points 日本語 text ok", "w" * 200_000 + " tail", "\x1f\x85 x y", "same line\nsame line"]


def test_counts(spark):
    rows = [(i, t, 5, "c") for i, t in enumerate(TEXTS)] + [(None, "a b", 1, "d"), (3, "one", 2, "e")]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, n_words int, is_trusted string")
    trusted = spark.createDataFrame([(7, True), (8, True), (8, False), (None, True)], "doc_id long, is_trusted boolean")
    out = R.quality_rules(docs, trusted).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out), key=str)
    assert got == sorted(((d, *brute(t)) for d, t, *_ in rows), key=str)
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_sample_table(spark):
    prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").selectExpr("doc_id", "quality = 1 AS is_trusted")
    out = {r["doc_id"]: r for r in R.quality_rules(docs, labels).collect()}
    trusted = {r["doc_id"] for r in labels.where("is_trusted").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    slots = {}
    for d, t in texts.items():
        w = W.scan(pa.array([t]), W.SPACED)
        slots[d] = R._slots(w)[0].tolist()
    raw, good = Counter(), Counter()
    for d, s in slots.items():
        raw.update(s)
        if d in trusted:
            good.update(s)
    n, m, k = sum(raw.values()), sum(good.values()), 1 << R.SLOT_BITS
    for d, s in slots.items():
        want = sum(math.log((good[x] + R.PRIOR * raw[x] / n * k) / (m + R.PRIOR * k) / (raw[x] / n)) for x in s) / max(len(s), 1)
        assert out[d]["log_ratio"] == pytest.approx(want, abs=1e-9)
        assert out[d]["kept"] == (not out[d]["base_failed"] and out[d]["log_ratio"] >= R.THRESHOLD)
        assert (out[d]["n_words"], out[d]["word_chars"], out[d]["n_symbols"], out[d]["n_dup_lines"], out[d]["n_repeat_words"], out[d]["base_failed"]) == brute(texts[d])


def test_junk_goes_and_prose_stays(spark):
    prepare(spark)
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    out = R.quality_rules(read("documents"), read("labels").selectExpr("doc_id", "quality = 1 AS is_trusted"))
    got = out.join(read("labels"), "doc_id").select("quality", "kept").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.98
    assert np.mean(bad) < 0.1


def test_empty_tables(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, is_trusted boolean")
    assert R.quality_rules(docs.limit(0), none).count() == 0
    row = R.quality_rules(docs, none).first()
    assert row["log_ratio"] == 0 and row["kept"]
