"""Cost-balanced packing of documents into training sequences.

A document is tokenised and closed by an end id. Whole sequences are cut from documents that are longer than one; the rest of each
document is a piece with the cost ``LINEAR * n + QUADRATIC * n ** 2``. Pieces go, in descending order, each to the sequence of least
cost that has room for it; a piece that fits nowhere nearby is cut to fill the cheapest one. Documents are packed in groups of
about ``GROUP_TOKENS`` ids as they stream through a task, so nothing is shuffled and memory is bounded by a group and a document.
Sequence sizes of a group are full ones and the powers of two that make up what is left, so nothing is padded.

Defined results: a null or empty text is the end id alone; rows that repeat a document, or have a null id, are packed each by
itself; an empty table gives no pieces; other columns are ignored.
"""

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from floodframe.llm.tokens import encoder

LENGTH = 2048
#: Cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1 / 2048
#: Ids packed together.
GROUP_TOKENS = 1 << 20
#: Sequences without room that are passed over before a piece is cut.
TRIES = 16


def sequence_sizes(tokens: int, length: int) -> list[int]:
    """Capacities that hold exactly ``tokens``: full sequences, then powers of two."""
    full, rest = divmod(tokens, length)
    return [length] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(sizes: list[int], length: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of these sizes; sequences are numbered from 0."""
    out, rest, sequence = [], [], 0
    for d, n in enumerate(sizes):
        for start in range(0, n - length + 1, length):
            out.append((d, start, length, sequence, 0))
            sequence += 1
        if n % length:
            rest.append((n % length, d, n - n % length))
    room = sequence_sizes(sum(n for n, _, _ in rest), length)
    used = [0] * len(room)
    heap = [(0.0, k) for k in range(len(room))]
    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            passed = []
            while heap and len(passed) < TRIES and room[heap[0][1]] - used[heap[0][1]] < n:
                passed.append(heapq.heappop(heap))
            fits = heap and room[heap[0][1]] - used[heap[0][1]] >= n
            cost, k = heapq.heappop(heap) if fits else passed.pop(0)
            for x in passed:
                heapq.heappush(heap, x)
            part = min(n, room[k] - used[k])
            out.append((d, start, part, sequence + k, used[k]))
            used[k] += part
            start, n = start + part, n - part
            if used[k] < room[k]:
                heapq.heappush(heap, (cost + LINEAR * part + QUADRATIC * part * part, k))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, if asked, ``ids``."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema += ", ids array<int>" * with_ids

    def run(batches):
        base, ids, keys, held = TaskContext.get().partitionId() << 40, [], [], 0
        for batch in batches:
            keys += batch.column("doc_id").to_pylist()
            ids += (new := encoder(tokenizer).encode(batch.column("text").to_pylist()))
            held += sum(map(len, new))
            if held >= GROUP_TOKENS:
                rows = pack([len(x) for x in ids], length)
                yield _pieces(rows, keys, ids, base, with_ids, batch.schema.field("doc_id").type)
                base += 1 + max(r[3] for r in rows)
                ids, keys, held = [], [], 0
            kind = batch.schema.field("doc_id").type
        if ids:
            yield _pieces(pack([len(x) for x in ids], length), keys, ids, base, with_ids, kind)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _pieces(rows, keys, ids, base, with_ids, kind):
    columns = {
        "doc_id": pa.array([keys[d] for d, *_ in rows], kind), "start": pa.array([s for _, s, *_ in rows], pa.int64()),
        "length": pa.array([n for _, _, n, *_ in rows], pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(ids[d][s:s + n].astype("<u4").tobytes()) for d, s, n, *_ in rows], pa.int64()),
        "doc_tokens": pa.array([len(ids[d]) for d, *_ in rows], pa.int64()),
        "sequence_id": pa.array([base + q for *_, q, _ in rows], pa.int64()), "offset": pa.array([o for *_, o in rows], pa.int64())}
    if with_ids:
        columns["ids"] = pa.array([ids[d][s:s + n].astype(np.int32) for d, s, n, *_ in rows], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
