"""Token ids, packed sequences and token files against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from floodframe.llm import packing, token_files
from floodframe.llm.common import prepare, scratch_path
from floodframe.llm.tokens import Encoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = [None, "", "  a  b\n\nc\t d ", "it's He'll 's\n 'S x", "Ünï ΣΑΣ İx", "<|endoftext|> hi", "a\u00a0b\u2003c x\x85y", "1234 5.6, foo.. bar!!! (x) _a_ b_", "x\r\ny", "\n", " ",
       "é e\u0301 \u0301x", "don't! can't, o'Neil's.", "A.b.C,d!", "tail... Tail!! TAIL?", "long " * 5000, "z" * 30_000, "\x01 \x01\x01 a\x01b"]


def plain(file, texts):
    t = Tokenizer.from_file(public_tokenizers.path(file))
    t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("file", FILES)
def test_encoder(spark, file):
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    encoder = Encoder(public_tokenizers.path(file))
    for part in (texts[:9], texts, texts[::-1]):
        assert [x.tolist() for x in encoder.encode(part)] == plain(file, part)


def test_pack_is_exact_and_full():
    for sizes in ([1], [], [2048], [2049, 5000, 1], list(range(1, 900)), [700] * 50, [1] * 3000):
        rows = packing.pack(sizes, 2048)
        held, pieces = defaultdict(list), defaultdict(list)
        for d, start, n, sequence, offset in rows:
            held[sequence].append((offset, n))
            pieces[d].append((start, n))
        for spans in (*held.values(), *pieces.values()):
            at = 0
            for start, n in sorted(spans):
                assert start == at and n > 0
                at += n
        assert [sum(n for _, n in pieces[d]) for d in range(len(sizes))] == sizes
        totals = [sum(n for _, n in x) for x in held.values()]
        assert all(n == 2048 or n & (n - 1) == 0 and n < 2048 for n in totals)


def test_costs_are_balanced():
    sizes = np.random.default_rng(0).integers(20, 1500, 2000).tolist()
    cost = defaultdict(float)
    for _, _, n, sequence, _ in packing.pack(sizes, 2048):
        cost[sequence] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = sorted(cost.values())[12:]
    assert full[-1] / full[0] < 1.6


def test_pack_documents(spark):
    rows = [(i, t, 1, "s") for i, t in enumerate(ODD)] + [(None, "a b", 1, "s"), (3, ODD[3], 1, "s")]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, start int, length string").repartition(3)
    out = packing.pack_documents(docs, public_tokenizers.path(FILES[0]), with_ids=True).collect()
    want = sorted(((d, x) for (d, *_), x in zip(rows, plain(FILES[0], [r[1] for r in rows])) if d not in (3, None)), key=str)
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["ids_crc32"] == crc(r["ids"]) and r["length"] == len(r["ids"])
        got[r["doc_id"]] += r["ids"]
    assert sorted(((d, x) for d, x in got.items() if d not in (3, None)), key=str) == want
    assert sum(r["length"] for r in out) == sum(len(x) for x in plain(FILES[0], [r[1] for r in rows]))
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x[:k]) == o for x in map(sorted, places.values()) for k, (o, _) in enumerate(x))
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path(FILES[0])).count() == 0


def test_token_files(spark):
    rows = [(i * 7 % 50, t, 1, "s") for i, t in enumerate(ODD)] + [(None, "a b", 1, "s"), (3, "repeat", 1, "s"), (3, "repeat", 1, "s")]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, ids int, part string").repartition(4)
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, path, public_tokenizers.path(FILES[1]))
    out = sorted(token_files.token_index(spark, path).collect(), key=lambda r: r["start"])
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in out]
    assert keys == sorted(keys)
    want = sorted(((d, len(x), crc(x)) for (d, *_), x in zip(rows, plain(FILES[1], [r[1] for r in rows]))), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out), key=str) == want
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs.limit(0), path, public_tokenizers.path(FILES[1]))
    assert token_files.token_index(spark, path).count() == 0


def test_files_are_pruned_by_document(spark):
    docs = prepare(spark).createDataFrame([(i, f"text {i}") for i in range(2000)], "doc_id long, text string")
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, path, public_tokenizers.path(FILES[1]))
    plan = token_files.read_tokens(spark, path).where("doc_id = 5")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan
