"""Quality rules: plain counts per document, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Words are runs of characters other than ASCII white space. Two multinomials over hashed one- and two-word sequences are counted,
one on the trusted documents, one on all documents; a document's score is the mean log ratio of the two over its sequences, and
every document is judged by the same threshold.

Defined results: a null or empty text has no words, all counts 0, score 0 and fails the base rules; a document is trusted if all
rows of its id in ``trusted`` say so; a null id is never trusted; repeated documents count and are judged each by itself; with no
trusted document the score is 0 everywhere; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from floodframe.llm import words as W
from floodframe.llm.common import bounded

#: Number of hash slots of the two multinomials, as a power of two; this bounds what reaches the driver and is broadcast.
SLOT_BITS = 17
#: A document is kept if its mean log ratio is at least this.
THRESHOLD = -0.1
#: Sequences a slot of either multinomial starts with, split in proportion to the raw counts.
PRIOR = 4.0

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CHAR_START = (np.arange(256) & 0xC0) != 0x80


def _slots(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash slot of every one- and two-word sequence, and the word it starts at."""
    pairs, at = W.ngrams(w, 2)
    both = np.concatenate([W.mix(w.ids), pairs])
    return (both >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.concatenate([np.arange(len(w.ids)), at])


def slot_counts(docs: DataFrame) -> DataFrame:
    """``slot``, ``raw``, ``trusted``: sequences of all and of trusted documents of ``docs(text, is_trusted)``; summed per task before the shuffle."""
    def run(batches):
        raw, trusted = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            w = W.scan(batch.column("text"), W.SPACED)
            slot, at = _slots(w)
            good = batch.column("is_trusted").to_numpy(zero_copy_only=False).astype(bool)[w.doc()[at]] if len(at) else np.zeros(0, bool)
            raw += np.bincount(slot, minlength=len(raw))
            trusted += np.bincount(slot[good], minlength=len(raw))
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(trusted[used])], ["slot", "raw", "trusted"])

    counted = docs.select("text", "is_trusted").mapInArrow(run, "slot int, raw long, trusted long")
    return counted.groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def log_ratios(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Log of the trusted over the raw probability of each slot; trusted counts are drawn towards the raw share."""
    if not trusted.sum():
        return np.zeros(len(raw), np.float64)
    share = raw / raw.sum()
    smooth = (trusted + PRIOR * share * len(raw)) / (trusted.sum() + PRIOR * len(raw))
    return np.log(np.divide(smooth, share, out=np.ones(len(raw)), where=raw > 0))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, score and verdict per row of ``docs(doc_id, text)``; ``trusted(doc_id, is_trusted)`` marks the target rows.

    Runs the counting job while the plan is built; its ``2 ** SLOT_BITS`` sums come to the driver.
    """
    marks = trusted.where("doc_id is not null").groupBy("doc_id").agg(F.min("is_trusted").alias("is_trusted")).where("is_trusted")
    flagged = docs.select("doc_id", "text").join(bounded(marks), "doc_id", "left").select("text", F.coalesce("is_trusted", F.lit(False)).alias("is_trusted"))
    sums = slot_counts(flagged).toArrow()
    raw, good = np.zeros(1 << SLOT_BITS), np.zeros(1 << SLOT_BITS)
    slot = sums["slot"].to_numpy()
    raw[slot], good[slot] = sums["raw"].to_numpy(), sums["trusted"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(log_ratios(raw, good))

    def run(batches):
        for batch in batches:
            yield _judge(batch, held.value)

    counts = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ratio double")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("log_ratio") >= threshold))


def _judge(batch: pa.RecordBatch, ratios: np.ndarray) -> pa.RecordBatch:
    w = W.scan(batch.column("text"), W.SPACED)
    n = np.diff(w.first)
    size = np.concatenate([[0], np.cumsum(_CHAR_START[w.data])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
    slot, at = _slots(w)
    doc = w.doc()
    total = np.bincount(doc[at], weights=ratios[slot], minlength=len(n))
    columns = [
        batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(W.per_text(w.first, size[w.end] - size[w.start]), pa.int64()),
        pa.array(symbols[w.texts[1:]] - symbols[w.texts[:-1]], pa.int64()), pa.array(_repeated_lines(batch, w), pa.int64()),
        pa.array(W.per_text(w.first, _repeated(w, doc).astype(np.int64)), pa.int64()), pa.array(total / np.maximum(2 * n - 1, 1), pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio"])


def _repeated_lines(batch: pa.RecordBatch, w: W.Words) -> np.ndarray:
    lines = W.scan(batch.column("text"), W.LINES)
    filled = np.searchsorted(w.start, lines.start) < np.searchsorted(w.start, lines.end)
    doc = lines.doc()[filled]
    _, seen = np.unique(W.join(lines.ids[filled], doc.astype(np.uint64)), return_index=True)
    texts = len(w.first) - 1
    return np.bincount(doc, minlength=texts) - np.bincount(doc[seen], minlength=texts)


def _repeated(w: W.Words, doc: np.ndarray) -> np.ndarray:
    """Which words lie in a five-word window that its text holds twice or more."""
    windows, at = W.ngrams(w, 5)
    key = W.join(windows, doc[at].astype(np.uint64))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return W.covered(len(w.ids), at[twice], at[twice] + 5)
