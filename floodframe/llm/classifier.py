"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are laid out in chunks of ``CHUNK`` bytes that overlap by ``OVERLAP``, so that the whole text is covered. Learned
filters of ``WIDTH`` bytes slide over each chunk (a filter is a weight per byte value and place, so convolution is a table look-up);
the largest response per filter is the chunk's reading. Mean and maximum of the readings over all chunks give one probability.

Learning uses a bounded sample: the labelled rows first in hash order, at most ``SAMPLE_DOCS`` of them and ``SAMPLE_BYTES`` of text in
all (both parameters). Every document is scored.

Defined results: null and empty texts are one chunk of padding and get that chunk's score; a document whose labels disagree, or
whose label or id is null, is not learned from; with no usable label of both kinds every score is 0.5; repeated documents get the
same score; other columns pass through untouched.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from floodframe.llm import words as W

CHUNK, OVERLAP, WIDTH, FILTERS = 256, 32, 5, 16
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 6 << 20
EPOCHS, RATE, GROUP = 5, 0.01, 512  # GROUP: chunks convolved at once
_PAD = 256


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, docs_limit: int = SAMPLE_DOCS, bytes_limit: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """(text, label) rows to learn from. Collects at most ``docs_limit`` rows and ``bytes_limit`` bytes; longer texts give way to later rows."""
    known = (labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
             .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other")
             .select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_limit))
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    sizes = texts.select("doc_id", "label", F.octet_length("text").alias("n"), F.xxhash64("doc_id", "text").alias("order"))
    rows, total, chosen = sizes.orderBy("order").limit(2 * docs_limit).collect(), 0, []
    for r in rows:
        if total + (r["n"] or 0) <= bytes_limit:
            total += r["n"] or 0
            chosen.append(r["order"])
    if not chosen:
        return []
    found = texts.where(F.xxhash64("doc_id", "text").isin(chosen)).orderBy(F.xxhash64("doc_id", "text"))
    return [(r["text"] or "", r["label"]) for r in found.collect()]


def layout(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks (padded bytes) and the first chunk of each text."""
    size, step = np.diff(texts), CHUNK - OVERLAP
    many = np.maximum(1, -(-(size - OVERLAP) // step))
    first = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(size)), many)
    place = (np.arange(first[-1]) - first[doc]) * step
    at = texts[doc][:, None] + place[:, None] + np.arange(CHUNK)
    inside = at < texts[doc + 1][:, None]
    padded = np.append(data.astype(np.int16), np.int16(_PAD))
    return padded[np.where(inside, at, len(data))], first


def readings(model: dict, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of every filter in every chunk, and where it is."""
    best, where = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int16)
    span = CHUNK - WIDTH + 1
    for i in range(0, len(chunks), GROUP // 8):
        part = chunks[i:i + GROUP // 8]
        response = model["filters"][0][part[:, :span]]
        for k in range(1, WIDTH):
            response += model["filters"][k][part[:, k:k + span]]
        where[i:i + GROUP // 8] = response.argmax(1)
        best[i:i + GROUP // 8] = response.max(1)
    return np.tanh(best), where


def _pooled(reading, first):
    mean = np.add.reduceat(reading, first[:-1], axis=0) / np.diff(first)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(reading, first[:-1], axis=0)], axis=1)


def _probability(model, pooled):
    return 1 / (1 + np.exp(-np.clip(pooled @ model["weights"] + model["bias"], -30, 30)))


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> dict | None:
    """Filters and output weights by Adam on batches of whole documents, both labels weighted alike; None without both labels."""
    label = np.array([y for _, y in rows], np.float32)
    if len(set(label.tolist())) < 2:
        return None
    random = np.random.default_rng(seed)
    model = {"filters": random.normal(0, 0.25, (WIDTH, 257, FILTERS)).astype(np.float32),
             "weights": random.normal(0, 0.3, 2 * FILTERS).astype(np.float32), "bias": np.zeros(1, np.float32)}
    model["filters"][:, _PAD] = 0
    share = label.mean()
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    encoded = [t.encode() for t, _ in rows]
    memory = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    step = 0
    for _ in range(epochs):
        for part in np.array_split(random.permutation(len(rows)), max(1, len(rows) // 24)):
            data = np.frombuffer(b"".join(encoded[i] for i in part), np.uint8)
            chunks, first = layout(data, np.concatenate([[0], np.cumsum([len(encoded[i]) for i in part])]))
            reading, where = readings(model, chunks)
            pooled = _pooled(reading, first)
            slope = (_probability(model, pooled) - label[part]) * weight[part] / len(part)
            back = slope[:, None] * model["weights"]
            doc = np.repeat(np.arange(len(part)), np.diff(first))
            top = reading == pooled[doc, FILTERS:]
            d_reading = (back[doc, :FILTERS] / np.diff(first)[doc][:, None] + back[doc, FILTERS:] * top) * (1 - reading**2)
            d_filters = np.zeros_like(model["filters"])
            row, column = np.arange(len(chunks))[:, None], np.arange(FILTERS)[None]
            for k in range(WIDTH):
                np.add.at(d_filters[k], (chunks[row, where + k], column), d_reading)
            d_filters[:, _PAD] = 0
            step += 1
            grads = {"filters": d_filters, "weights": slope @ pooled, "bias": np.array([slope.sum()])}
            for k, g in grads.items():
                m, v = memory[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def probabilities(model: dict | None, column: pa.Array) -> np.ndarray:
    """Score of every text of an Arrow column."""
    data, texts = W.buffers(column)
    if model is None or not len(column):
        return np.full(len(column), 0.5)
    chunks, first = layout(data, texts)
    return _probability(model, _pooled(readings(model, chunks)[0], first)).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Model learned from the labelled sample; runs its jobs at once."""
    return train(labelled_sample(docs, labels))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id`` and ``score`` of every row of ``docs(doc_id, text)``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probabilities(held.value, batch.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: dict | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored ``least`` or more, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(probabilities(held.value, batch.column(batch.schema.names.index("text"))) >= least))

    return docs.mapInArrow(run, docs.schema)
