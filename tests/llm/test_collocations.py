import re
from collections import Counter

from floodframe.llm import collocations
from floodframe.llm.common import prepare

SCHEMA = "lang string, text string, n long, word string"


def phrases(spark, rows, **more):
    prepare(spark)
    out = collocations.top_phrases(spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(3), **more)
    return sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def brute(rows, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if a >= 30 and len(p) > 2}
    inside = Counter()
    for p, a in found.items():
        w = p[1:]
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                q = (p[0], *w[i:i + k])
                inside[q] = max(inside[q], a)
    scored = []
    for p, a in found.items():
        if 100 * inside[p] >= 80 * a:
            continue
        score, _, l, r = min((2000000 * a // (f[p[:k + 1]] + f[(p[0], *p[k + 1:])]), k, f[p[:k + 1]], f[(p[0], *p[k + 1:])]) for k in range(1, len(p) - 1))
        scored.append((p[0], -score, -a, " ".join(p[1:]).encode(), l, r))
    out, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(scored):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


ROWS = ([("en", "New York is in the state of New York; the State of the art.\nof the art")] * 31 + [(None, "a b a b a b a b\tA B")] * 8 + [("und", "a b")] * 3
        + [("", "x  x x x x x")] * 12 + [("de", None), ("de", ""), (None, None), ("fr", "été à la mer été à la ville, été à la mer!")] + [("fr", "été à la mer")] * 29
        + [("en", f"word{i} the state number {i}") for i in range(40)])


def test_against_brute_force(spark):
    want = brute(ROWS)
    assert phrases(spark, ROWS) == want and want
    assert {r[0] for r in want} >= {"en", "und", "", "fr"}
    assert phrases(spark, ROWS, top=2) == brute(ROWS, 2)


def test_cut_stripes_small_buffers_and_a_full_bit_map(spark, monkeypatch):
    want = brute(ROWS)
    for name, value in (("CUTS", 4), ("BUFFER", 50), ("LEAST_BITS", 19), ("MOST_BITS", 19)):
        monkeypatch.setattr(collocations, name, value)
    assert phrases(spark, ROWS) == want


def test_many_tasks_for_one_stripe(spark):
    rows = [("en", f"hot w{i % 50} end") for i in range(3000)]
    prepare(spark)
    made = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(150)
    assert sorted(tuple(r) for r in collocations.top_phrases(made).collect()) == brute(rows)


def test_nothing_to_find(spark):
    assert phrases(spark, []) == []
    assert phrases(spark, [("en", None), (None, "a b"), ("en", "...")]) == []
