"""The pipeline's stages keep columns and rows as they should, and its result is a whole packing."""

import random

import corpus_pipeline
from floodframe.llm.common import prepare, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(prepare(spark), SF, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names, name
        after = out.count()
        assert 0 < after <= before, name
        before, docs = after, out


def test_run_packs_everything(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    held: dict = {}
    for r in rows:
        held.setdefault(r["doc_id"], [0, r["doc_tokens"]])[0] += r["length"]
    assert held and all(a == b for a, b in held.values())


def test_extra_columns_and_odd_rows(spark):
    prepare(spark)
    docs = spark.createDataFrame(
        [(None, None, "a", 1), (1, "", "b", 2), (2, "x", "c", 3), (2, "x", "c", 3)], "doc_id long, text string, kept string, label int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_duplicates_by_five_words(spark):
    rng = random.Random(7)
    rows = [(900, "a b c"), (901, "a b c"), (902, "a b d"), (903, "a b c d")]
    for d, gap in enumerate((20, 20, 30, 30, 40, 60, 60, 90)):
        base = [f"w{rng.randrange(5000)}" for _ in range(360)]
        rows += [(10 * d + k, " ".join(f"e{d}-{k}-{i}" if k and i % gap == gap // 2 else w for i, w in enumerate(base))) for k in range(3)]
    sets, parent = {}, {d: d for d, _ in rows}
    for d, t in rows:
        w = t.split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))}

    def root(d):
        return d if parent[d] == d else root(parent[d])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == {d for d in sets if root(d) == d} and len(rows) > len(kept) > 15
