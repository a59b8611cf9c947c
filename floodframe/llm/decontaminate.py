"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items in documents.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. An item's patterns are its windows of ``width``
consecutive words, or all its words if it has fewer. Patterns of one length share a shift table over blocks of two words: a text
position moves on by the least distance at which its block occurs in any pattern, so most positions are never looked at. Where the
shift is zero, the bucket of the pattern's last and first blocks gives the strings to compare word for word.

Defined results: a null or wordless text has no words and no hits; an item without words has no pattern; a null item id counts
as the id ``""``; items that repeat an id count once; repeated documents are judged each by itself; other columns are ignored.
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from floodframe.llm import words as W
from floodframe.llm.common import cut_lineage

#: Bytes of benchmark text searched for in one pass; a larger benchmark is searched in several.
BLOCK_BYTES = 32 << 20
_SPANS = "array<struct<first:long,last:long>>"


class Patterns:
    """Tables of all patterns of one length."""

    def __init__(self, length: int, strings: dict[bytes, set[str]]):
        self.length, self.block = length, min(2, length)
        self.strings = list(strings)
        self.items = [sorted(strings[s]) for s in self.strings]
        found = W.scan(pa.array([s.decode() for s in self.strings], pa.string()), W.ALNUM)
        ids = found.ids.reshape(-1, length)
        n = len(ids)
        self.bits = max(12, (8 * n * length).bit_length())
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.uint8)
        for q in range(self.block, length + 1):
            np.minimum.at(self.shift, self._slot(self._block(ids, np.full(n, q - 1))), length - q)
        key = W.join(self._block(ids, np.full(n, length - 1)), self._block(ids, np.full(n, self.block - 1)))
        order = np.argsort(key)
        self.key, self.order = key[order], order

    def _block(self, ids, last):
        if ids.ndim == 2:
            row = np.arange(len(ids))
            return ids[row, last] if self.block == 1 else W.join(ids[row, last - 1], ids[row, last])
        return ids[last] if self.block == 1 else W.join(ids[last - 1], ids[last])

    def _slot(self, block):
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, w: W.Words) -> list[tuple[int, int]]:
        """(last word, pattern) of every occurrence. Long texts are dealt over lanes that advance together."""
        width, lanes, ends = 256, [], []
        low, high = w.first[:-1] + self.length - 1, w.first[1:]
        for a, b in zip(low[low < high].tolist(), high[low < high].tolist()):
            lanes.append(np.arange(a, b, width))
            ends.append(np.minimum(lanes[-1] + width, b))
        if not lanes:
            return []
        at, end, zero = np.concatenate(lanes), np.concatenate(ends), []
        while len(at):
            shift = self.shift[self._slot(self._block(w.ids, at))]
            zero.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            at, end = at[at < end], end[at < end]
        at = np.concatenate(zero)
        key = W.join(self._block(w.ids, at), self._block(w.ids, at - self.length + self.block))
        low, high = np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")
        out = []
        for k in np.flatnonzero(low < high):
            text = w.text(at[k] - self.length + 1, at[k])
            out += [(int(at[k]), int(p)) for p in self.order[low[k]:high[k]] if self.strings[p] == text]
        return out


def compile_patterns(rows, width: int) -> list[Patterns]:
    """Tables per pattern length from (item id, text) rows."""
    by_length: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in rows:
        w = W.scan(pa.array([text], pa.string()), W.ALNUM, lower=True)
        n = len(w.ids)
        length = min(n, width)
        for i in range(n - length + 1 if n else 0):
            by_length[length][w.text(i, i + length - 1)].add("" if item is None else str(item))
    return [Patterns(n, dict(strings)) for n, strings in sorted(by_length.items())]


def find_items(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Occurrences of benchmark items in each document.

    Gives ``doc_id``, ``n_words``, ``item_ids`` (distinct, sorted as strings) and ``spans`` (merged ranges of hit words, both ends
    included) for each row of ``docs(doc_id, text)``. The benchmark is measured first (a job) and its patterns are broadcast in
    blocks of ``block_bytes`` of text; each further block is another pass over the documents.
    """
    spark = docs.sparkSession
    out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"),
                      F.expr("cast(array() as array<string>)").alias("item_ids"), F.expr(f"cast(array() as {_SPANS})").alias("spans"))
    schema = out.schema
    for k, held in enumerate(_blocks(benchmark, width, block_bytes)):
        out = (cut_lineage(spark, out) if k else out).mapInArrow(_searcher(held), schema)
    return out.drop("text")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a benchmark item, with all their columns."""
    def cleaner(held):
        def run(batches):
            for batch in batches:
                w = W.scan(batch.column(batch.schema.names.index("text")), W.ALNUM, lower=True)
                hit = [last for t in held.value for last, _ in t.search(w)]
                keep = np.ones(batch.num_rows, bool)
                keep[np.searchsorted(w.first, np.array(hit, np.int64), "right") - 1] = False
                yield batch.filter(pa.array(keep))
        return run

    out = docs
    for held in _blocks(benchmark, width, block_bytes):
        out = out.mapInArrow(cleaner(held), docs.schema)
    return out


def _blocks(benchmark: DataFrame, width: int, block_bytes: int):
    """Broadcast tables of the benchmark's patterns, block by block of about ``block_bytes`` of text."""
    size = benchmark.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-size // block_bytes) or 1
    items = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    for k in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in items.where(F.col("block") == k).collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(compile_patterns(rows, width))


def _searcher(held):
    def run(batches):
        for batch in batches:
            yield _search(batch, held.value)
    return run


def _search(batch: pa.RecordBatch, tables: list[Patterns]) -> pa.RecordBatch:
    w = W.scan(batch.column("text"), W.ALNUM, lower=True)
    items = [set(x) for x in batch.column("item_ids").to_pylist()]
    start, end = [], []
    for d, spans in enumerate(batch.column("spans").to_pylist()):
        for s in spans:
            start.append(w.first[d] + s["first"])
            end.append(w.first[d] + s["last"] + 1)
    for table in tables:
        for last, pattern in table.search(w):
            items[int(np.searchsorted(w.first, last, "right")) - 1].update(table.items[pattern])
            start.append(last - table.length + 1)
            end.append(last + 1)
    hit = W.covered(len(w.ids), np.array(start, np.int64), np.array(end, np.int64))
    runs: list[list[dict]] = [[] for _ in items]
    if start:
        doc = w.doc()
        edge = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (doc[1:] != doc[:-1])]))
        stop = np.flatnonzero(hit & np.concatenate([~hit[1:] | (doc[1:] != doc[:-1]), [True]]))
        for a, b in zip(edge.tolist(), stop.tolist()):
            runs[doc[a]].append({"first": a - int(w.first[doc[a]]), "last": b - int(w.first[doc[a]])})
    columns = {"n_words": pa.array(np.diff(w.first), pa.int64()), "item_ids": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
               "spans": pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))}
    return pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, found items, their digest and the verdict."""
    found = find_items(docs, benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "item_ids", "spans")
