"""Language-model scores: an interpolated modified Kneser-Ney model of word pairs, counted in Spark and memory-mapped by workers.

Counting. A task reduces its texts to distinct words and distinct pairs with counts (sorted 48-bit word hashes), and sends one packed
block per shard of the hash range; a shard merges its blocks and writes sorted arrays into the model folder. Pairs are sharded by
their first word; words so frequent that a shard would fill up are sharded by the second word instead. Context totals and
continuation counts are sums over shards, so it doesn't matter where a pair is counted. Scoring maps the arrays and looks up each
batch's distinct words and pairs by binary search; no worker loads the model.

The folder must be reachable as a path on every worker (``file:`` or a mounted share), as arrays in an object store can't be mapped.

Words are lower-cased runs of characters other than ASCII white space; one end token closes each text.

Defined results: a null or empty text is the end token alone; rows that repeat a document are counted and scored each; a null id is
neither learned from nor held out; an empty training set gives one unknown word with probability 1; other columns are ignored.
"""

import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from floodframe.llm import words as W
from floodframe.llm.common import scratch_path

U64 = np.uint64
END, BEGIN = U64(1), U64(2)
#: Bytes of training text per shard of the model.
SHARD_BYTES = 16 << 20
#: Pairs a task gathers before it reduces them.
BUFFER = 3_000_000
_ROWS = "shard int, payload binary, n1 long, n2 long, n3 long, n4 long"


def remainder(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo 7; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 7


def mounted(path: str) -> str:
    """The folder as a path of the local file system."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"workers map the model's files: {path} must be mounted as a path")
    return path


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """48-bit ids of all tokens, each text closed by END, and each text's first token."""
    w = W.scan(column, W.SPACED, lower=True)
    first = w.first + np.arange(len(w.first))
    out = np.full(first[-1], END, U64)
    out[np.arange(len(w.ids)) + w.doc()] = w.ids >> U64(16)
    return out, first


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each token."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[first[:-1]] = BEGIN
    return out


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return W.join(u, w)


# --- packed blocks

def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; 64-bit ones hold 48-bit hashes and take six bytes an entry, others the fewest bytes that hold them."""
    head, body = [len(arrays)], []
    for a in arrays:
        if a.dtype == U64:
            body += [a.astype("<u4").tobytes(), (a >> U64(32)).astype("<u2").tobytes()]
            head += [len(a), 6]
        else:
            size = next(s for s in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << 8 * s)
            body.append(a.astype(f"<u{size}").tobytes())
            head += [len(a), size]
    return np.array(head, "<i8").tobytes() + b"".join(body)


def _unpack(data: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(data, "<i8", 1)[0])
    head, at, out = np.frombuffer(data, "<i8", 1 + 2 * count)[1:].reshape(-1, 2), 8 + 16 * count, []
    for n, size in head.tolist():
        if size == 6:
            low, high = np.frombuffer(data, "<u4", n, at), np.frombuffer(data, "<u2", n, at + 4 * n)
            out.append(low.astype(U64) | (high.astype(U64) << U64(32)))
        else:
            out.append(np.frombuffer(data, f"<u{size}", n, at).astype(np.int64))
        at += n * size
    return out


def _shard(word: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 48-bit hash by its place in the range; ascending with the hash."""
    return (((word >> U64(16)) * U64(shards)) >> U64(32)).astype(np.int64)


def pair_shard(u: np.ndarray, w: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    """Shard of each pair: by its first word, or by the second if the first is one of ``hot``."""
    out = _shard(u, shards)
    if len(hot):
        common = np.isin(u, hot)
        out[common] = _shard(W.mix(w[common]) >> U64(16), shards)
    return out


def _sums(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, ascending, and the sums of each value."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return [key[at], *[np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]]


def _rows(shards, payloads, stats=None) -> pa.RecordBatch:
    zero = [0] * len(shards)
    stats = stats or [zero] * 4
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(payloads, pa.binary()), *[pa.array(x, pa.int64()) for x in stats]],
                                      ["shard", "payload", "n1", "n2", "n3", "n4"])


def _blocks(shard: np.ndarray, shards: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """One packed block per shard; ``shard`` must be ascending."""
    edge = np.searchsorted(shard, np.arange(shards + 1))
    used = np.flatnonzero(edge[1:] > edge[:-1]).tolist()
    return _rows(used, [_pack(*[a[edge[s]:edge[s + 1]] for a in arrays]) for s in used])


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write in one step, so that a task that runs twice leaves one whole file."""
    os.makedirs(folder, exist_ok=True)
    part = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, os.path.join(folder, name))


# --- counting

def count_words(train: DataFrame, folder: str, shards: int) -> DataFrame:
    """Merge word counts per shard into the folder; rows (shard, tokens, types, candidates for hot words)."""
    def read(batches):
        held, size = [], 0
        for batch in batches:
            held.append(np.unique(tokens(batch.column("text"))[0], return_counts=True))
            size += len(held[-1][0])
            if size > BUFFER:
                held = [tuple(_sums(np.concatenate([a for a, _ in held]), np.concatenate([n for _, n in held])))]
                if len(held[0][0]) > BUFFER // 2:
                    yield _blocks(_shard(held[0][0], shards), shards, *held[0])
                    held = []
                size = sum(len(a) for a, _ in held)
        if held:
            word, n = _sums(np.concatenate([a for a, _ in held]), np.concatenate([n for _, n in held]))
            yield _blocks(_shard(word, shards), shards, word, n)

    def merge(table):
        blocks = [_unpack(p.as_py()) for p in table.column("payload")]
        word, n = _sums(np.concatenate([a for a, _ in blocks]), np.concatenate([c for _, c in blocks]))
        s = table.column("shard")[0].as_py()
        _save(folder, f"seen-{s}.npy", np.stack([word, n.astype(U64)]))
        often = n > n.sum() // (2 * shards)
        return pa.table({"tokens": pa.array([int(n.sum())]), "types": pa.array([len(word)]),
                         "often": pa.array([[{"word": int(a), "n": int(b)} for a, b in zip(word[often], n[often])]],
                                           pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())])))})

    blocks = train.select("text").mapInArrow(read, _ROWS)
    return blocks.groupBy("shard").applyInArrow(merge, "tokens long, types long, often array<struct<word:long,n:long>>")


def count_pairs(train: DataFrame, folder: str, shards: int, hot: np.ndarray) -> DataFrame:
    """Merge pair counts and per-word statistics into the folder; rows of counts of counts."""
    def reduce(u, w):
        key, at, n = np.unique(pair_key(u, w), return_index=True, return_counts=True)
        u, w = u[at], w[at]
        shard = pair_shard(u, w, shards, hot)
        order = np.lexsort((u, shard))
        shard, u, w, n = shard[order], u[order], w[order], n[order]
        edge = np.searchsorted(shard, np.arange(shards + 1))
        used = np.flatnonzero(edge[1:] > edge[:-1]).tolist()
        payloads = []
        for s in used:
            own = slice(edge[s], edge[s + 1])
            context, runs = np.unique(u[own], return_counts=True)
            payloads.append(_pack(context, runs, w[own], n[own]))
        return _rows(used, payloads)

    def read(batches):
        held, size = [], 0
        for batch in batches:
            ids, first = tokens(batch.column("text"))
            held.append((contexts(ids, first), ids))
            size += len(ids)
            if size >= BUFFER:
                yield reduce(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield reduce(*map(np.concatenate, zip(*held)))

    def merge(table):
        parts = []
        for p in table.column("payload"):
            context, runs, w, n = _unpack(p.as_py())
            parts.append((np.repeat(context, runs), w, n))
        u, w, n = map(np.concatenate, zip(*parts))
        parts.clear()
        key, at, inverse = np.unique(pair_key(u, w), return_index=True, return_inverse=True)
        n = np.bincount(inverse, weights=n).astype(np.int64)
        u, w = u[at], w[at]
        s = table.column("shard")[0].as_py()
        big = np.flatnonzero(n > 254)
        _save(folder, f"pair-{s}.npy", key)
        _save(folder, f"pair-count-{s}.npy", np.minimum(n, 255).astype(np.uint8))
        _save(folder, f"pair-more-{s}.npy", np.stack([big, n[big]]))
        context = _sums(u, *[(n == k).astype(np.int64) for k in (1, 2)], (n > 2).astype(np.int64))
        ended = _sums(w, np.ones(len(w), np.int64))
        zero = np.zeros(len(ended[0]), np.int64)
        word = np.concatenate([context[0], ended[0]])
        values = [np.concatenate([c, zero]) for c in context[1:]] + [np.concatenate([np.zeros(len(context[0]), np.int64), ended[1]])]
        word, *values = _sums(word, *values)
        out = _blocks(_shard(word, shards), shards, word, *values)
        stats = [[int((n == k).sum())] + [0] * (out.num_rows - 1) for k in (1, 2, 3, 4)]
        return pa.Table.from_batches([_rows(out.column("shard").to_pylist(), out.column("payload").to_pylist(), stats)])

    def finish(table):
        blocks = [_unpack(p.as_py()) for p in table.column("payload")]
        word, *values = map(np.concatenate, zip(*blocks))
        word, *values = _sums(word, *values)
        s = table.column("shard")[0].as_py()
        path = os.path.join(folder, f"seen-{s}.npy")
        seen, count = np.load(path) if os.path.exists(path) else (np.zeros(0, U64), np.zeros(0, U64))
        every = np.union1d(word, seen)
        stats = np.zeros((5, len(every)), np.uint32 if not len(count) or int(count.max()) < 1 << 32 else U64)
        stats[0, np.searchsorted(every, seen)] = count
        for k, v in enumerate(values, 1):
            stats[k, np.searchsorted(every, word)] = v
        _save(folder, f"word-{s}.npy", every)
        _save(folder, f"word-stats-{s}.npy", stats)
        ended = stats[4]
        columns = {f"n{k}": pa.array([int(np.sum(table.column(f"n{k}").to_numpy()))]) for k in (1, 2, 3, 4)}
        columns |= {f"m{k}": pa.array([int((ended == k).sum())]) for k in (1, 2, 3, 4)}
        return pa.table(columns | {"m_all": pa.array([int((ended > 0).sum())]), "pairs": pa.array([int(ended.sum(dtype=np.int64))])})

    blocks = train.select("text").mapInArrow(read, _ROWS)
    merged = blocks.groupBy("shard").applyInArrow(merge, _ROWS)
    return merged.groupBy("shard").applyInArrow(finish, "n1 long, n2 long, n3 long, n4 long, m1 long, m2 long, m3 long, m4 long, m_all long, pairs long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more; a half for each step where counts of counts are missing."""
    if not (n1 and n2):
        return [0.0, 0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return [0.0, *[min(max(x, 0.05), k) for k, x in enumerate(d, 1)]]


def fit(train: DataFrame, shard_bytes: int = SHARD_BYTES) -> dict:
    """Count the model of ``train(text)`` into a fresh shared folder; runs three jobs. Gives the folder and a few totals."""
    spark = train.sparkSession
    folder = mounted(scratch_path(spark, "lm"))
    size = train.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // shard_bytes))
    path = scratch_path(spark, "lm-words")
    count_words(train, folder, shards).write.parquet(path)
    seen = spark.read.parquet(path)
    total = seen.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    n, v = total["tokens"] or 0, total["types"] or 0
    # fewer than 2 * shards words can be this frequent
    hot = [r["word"] for r in seen.select(F.explode("often").alias("w")).select("w.*").where(F.col("n") > n // (2 * shards)).select("word").collect()]
    held = np.array(sorted([*hot, int(BEGIN)]), U64)
    sums = count_pairs(train, folder, shards, held).groupBy().sum().first()
    sums = {k[4:-1]: x or 0 for k, x in sums.asDict().items()}
    return {"folder": folder, "shards": shards, "hot": held, "tokens": n, "types": v, "pairs": sums["pairs"],
            "pair_discounts": discounts(*[sums[f"n{k}"] for k in (1, 2, 3, 4)]), "word_discounts": discounts(*[sums[f"m{k}"] for k in (1, 2, 3, 4)]),
            "ended": (sums["m1"], sums["m2"], sums["m_all"] - sums["m1"] - sums["m2"])}


# --- scoring

@lru_cache(maxsize=4096)
def _mapped(folder: str, name: str) -> np.ndarray | None:
    path = os.path.join(folder, name)
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def _look_up(keys: np.ndarray, shard: np.ndarray, folder: str, stem: str, found) -> None:
    """Call ``found(positions in keys, shard, positions in the shard's array)`` for all hits of ascending distinct keys."""
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange((int(shard.max()) if len(shard) else -1) + 2))
    for s in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
        array = _mapped(folder, f"{stem}-{s}.npy")
        if array is None or not len(array):
            continue
        mine = order[edge[s]:edge[s + 1]]
        at = np.minimum(np.searchsorted(array, keys[mine]), len(array) - 1)
        hit = array[at] == keys[mine]
        found(mine[hit], s, at[hit])


def log_scores(model: dict, column: pa.Array) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, base score and model score (log10)."""
    ids, first = tokens(column)
    before = contexts(ids, first)
    folder, shards = model["folder"], model["shards"]
    word, which = np.unique(np.concatenate([ids, before]), return_inverse=True)
    own, context = which[:len(ids)], which[len(ids):]
    stats = np.zeros((5, len(word)))

    def put_words(mine, s, at):
        stats[:, mine] = _mapped(folder, f"word-stats-{s}.npy")[:, at]

    _look_up(word, _shard(word, shards), folder, "word", put_words)
    key, at, inverse = np.unique(pair_key(before, ids), return_index=True, return_inverse=True)
    pairs = np.zeros(len(key))

    def put_pairs(mine, s, at):
        n = _mapped(folder, f"pair-count-{s}.npy")[at].astype(np.float64)
        if (big := np.flatnonzero(n == 255)).size:
            place, count = _mapped(folder, f"pair-more-{s}.npy")
            n[big] = count[np.searchsorted(place, at[big])]
        pairs[mine] = n

    _look_up(key, pair_shard(before[at], ids[at], shards, model["hot"]), folder, "pair", put_pairs)
    count, once, twice, more, ended = stats
    d, e, v = np.array(model["pair_discounts"]), np.array(model["word_discounts"]), model["types"]
    total = max(model["pairs"], 1)
    spare = float(np.dot(e[1:], model["ended"])) / total if model["pairs"] else 1.0
    single = np.maximum(ended - e[np.minimum(ended, 3).astype(int)], 0) / total + spare / (v + 1)
    follow = count.copy()  # how often each word is a context
    begin = np.searchsorted(word, BEGIN)
    if begin < len(word) and word[begin] == BEGIN:
        follow[begin] = count[np.searchsorted(word, END)]
    back = (d[1] * once + d[2] * twice + d[3] * more) / np.maximum(follow, 1)
    pairs = pairs[inverse]
    p = np.where(follow[context] > 0,
                 np.maximum(pairs - d[np.minimum(pairs, 3).astype(int)], 0) / np.maximum(follow[context], 1) + back[context] * single[own], single[own])
    base = np.log10((count + 1) / (model["tokens"] + v + 1))[own]
    return np.diff(first), W.per_text(first, count[own] > 0), W.per_text(first, base), W.per_text(first, np.log10(p))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row of ``docs(doc_id, text)``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            n, known, base, own = log_scores(held.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), held.value["tokens"]), pa.int64()), pa.array(base), pa.array(own)],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
