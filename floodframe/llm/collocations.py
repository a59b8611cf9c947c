"""Collocations of two to four words per language, by stripes.

A stripe is a prefix (language and up to three words) with an associative counter of next words. Tasks count stripes of their texts, packed
as two sorted arrays; stripes of a prefix are sorted together and merged elementwise as a stream. A merged stripe gives the extensions of its
prefix, their greatest count, and with the empty prefix the number of words.

No phrase is more frequent than its parts, so a pass takes only phrases whose parts the pass before found ``LEAST`` times: words, then pairs,
then three and four words. These parts are marked in a bit map whose size follows their number up to ``MOST_BITS``; a false mark only costs
counting, counts are exact at every size. Everything after the passes works on phrases of ``LEAST`` or more.

Skew. Counts are combined in tasks before they are shuffled. The empty prefix and prefixes with more than a ``CUTS``-th of all words are cut
into ``CUTS`` stripes by next word; there are fewer than ``CUTS`` such prefixes of each length.

Defined results: null and empty texts have no words; a null language is ``und``; repeated documents count each; ids don't matter; no
candidate, or an empty table, gives no rows; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from floodframe.llm import words as W
from floodframe.llm.common import cut_lineage

U64 = np.uint64
LEAST, TOP = 30, 2000
CUTS = 1024
#: Bits of the map of frequent parts: sixteen or more a part, never above 128 MB.
LEAST_BITS, MOST_BITS = 23, 30
#: Phrases a task gathers before it counts them.
BUFFER = 2_000_000

_bytes = np.arange(256)
_BREAK = np.isin(_bytes, list(b".,;:!?\n\x0b\x0c\r"))
_WORD = ~_BREAK & (_bytes != 32) & (_bytes != 9)


def code_of(lang: str) -> U64:
    """What stands for a language in hashes."""
    return U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Phrases:
    """Words of a batch with the language and the piece each lies in; phrases are named by where they start."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        self.w = w = W.scan(text, _WORD, lower=True)
        names = lang.cast(pa.string()).fill_null("und").dictionary_encode()
        self.names = names.dictionary
        codes = np.array([code_of(n) for n in names.dictionary.to_pylist()], U64)
        doc = w.doc()
        self.lang_of = codes[names.indices.to_numpy()][doc] if len(doc) else np.zeros(0, U64)
        self.name_of = names.indices.to_numpy()[doc] if len(doc) else np.zeros(0, np.int64)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[w.data])])[w.start] if len(doc) else np.zeros(0, np.int64)
        self.next = (doc[1:] == doc[:-1]) & (breaks[1:] == breaks[:-1])  # whether the next word belongs to the same piece

    def starts(self, n: int) -> np.ndarray:
        """Words at which ``n`` words of one piece start."""
        ok = np.ones(max(len(self.w.ids) - n + 1, 0), bool)
        for k in range(n - 1):
            ok &= self.next[k:len(ok) + k]
        return np.flatnonzero(ok)

    def parts(self, at: np.ndarray, n: int) -> np.ndarray:
        """Language and words of the phrases, a row each."""
        return np.stack([self.lang_of[at], *[self.w.ids[at + k] for k in range(n)]], 1)


def names(parts: np.ndarray) -> np.ndarray:
    """Hash of each row of language and words."""
    out = W.mix(parts[:, 0])
    for k in range(1, parts.shape[1]):
        out = W.join(out, parts[:, k])
    return out


def _binary(flat: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Rows of a binary column: the bytes of ``flat`` between edges."""
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _entries(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All items of a packed column, and how many each row has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind), np.array([len(r) for r in raw], np.int64) // np.dtype(kind).itemsize


def _marked(bits: np.ndarray, name: np.ndarray) -> np.ndarray:
    at = name >> U64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, the first one first, and where each group of equal ones begins in it."""
    order = np.lexsort(keys[::-1])
    change = np.ones(len(order), bool)
    if len(order):
        change[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(change)


# --- words: stripes of the empty prefix, with the words as text

def _word_stripes(docs: DataFrame) -> DataFrame:
    def count(held):
        lang, word, n, text = (np.concatenate([h[i] for h in held]) for i in range(4))
        order, at = _grouped(lang, word)
        return lang[order[at]], word[order[at]], np.add.reduceat(n[order], at) if len(at) else n, text[order[at]]

    def stripes(held):
        lang, word, n, text = count(held)
        cut = (word % U64(CUTS)).astype(np.int64)
        order, at = _grouped(lang, cut, word)  # all distinct: sorted by stripe
        lang, word, n, text, cut = lang[order], word[order], n[order], text[order], cut[order]
        _, first = _grouped(lang, cut)
        edge = np.append(first, len(lang))
        listed = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(text, pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(lang[first], pa.string()), pa.array(cut[first]), _binary(word, edge), _binary(n.astype("<i8"), edge), pc.binary_join(listed, " ")],
                                          ["lang", "cut", "next", "n", "words"])

    def read(batches):
        held, size = [], 0
        for batch in batches:
            p = Phrases(batch.column("text"), batch.column("lang"))
            if not len(p.w.ids):
                continue
            order, at = _grouped(p.name_of, p.w.ids)
            first = order[at]
            ends = np.stack([p.w.start[first], p.w.end[first]], 1)
            by = np.argsort(ends[:, 0])
            whole = pa.Array.from_buffers(pa.large_string(), 2 * len(first) - 1, [None, pa.py_buffer(ends[by].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(p.w.data))])
            text = np.empty(len(first), object)
            text[by] = whole.take(pa.array(np.arange(0, 2 * len(first), 2))).to_numpy(zero_copy_only=False)
            lang = p.names.to_numpy(zero_copy_only=False)[p.name_of[first]]
            held.append((lang, p.w.ids[first], np.diff(np.append(at, len(order))), text))
            size += len(first)
            if size > BUFFER // 4:
                held = [count(held)]
                size = len(held[0][0])
                if size > BUFFER // 8:
                    yield stripes(held)
                    held, size = [], 0
        if held:
            yield stripes(held)

    return docs.select("lang", "text").mapInArrow(read, "lang string, cut long, next binary, n binary, words string")


def count_words(docs: DataFrame) -> DataFrame:
    """``lang``, ``name`` (hash), ``word`` and ``n`` of the words found ``LEAST`` times; and rows without a word, whose sum over a language is all its words."""
    def merge(batches):
        for lang, cut, (word, n, text) in _merged(batches, ["lang", "cut"], True):
            code = code_of(lang)
            often = n >= LEAST
            parts = np.stack([np.full(often.sum(), code, U64), word[often]], 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (1 + len(parts)), pa.string()), pa.array(np.append(names(parts).view(np.int64), 0)), pa.array(np.append(parts[:, 1].view(np.int64), 0)),
                 pa.array([*text[often], None], pa.string()), pa.array(np.append(n[often], n.sum())), pa.array(np.full(1 + len(parts), np.array(code).view(np.int64)))],
                ["lang", "name", "id", "word", "n", "code"])

    rows = _word_stripes(docs).repartition("lang", "cut").sortWithinPartitions("lang", "cut")
    return rows.mapInArrow(merge, "lang string, name long, id long, word string, n long, code long")


def _merged(batches, keys: list[str], text: bool):
    """Each key's stripe, merged elementwise from the sorted rows: key values and (next, counts, texts)."""
    def merge(held):
        word, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order, at = _grouped(word)
        words_ = np.concatenate([h[2] for h in held])[order[at]] if text else None
        return word[order[at]], np.add.reduceat(n[order], at), words_

    key, held, size = None, [], 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in keys]
        raw = [batch.column(c).to_pylist() for c in ("next", "n")]
        listed = batch.column("words").to_pylist() if text else [None] * batch.num_rows
        for *own, word, n, said in zip(*columns, *raw, listed):
            if own != key:
                if held:
                    yield *key, merge(held)
                key, held, size = own, [], 0
            held.append((np.frombuffer(word, "<u8"), np.frombuffer(n, "<i8"), np.array(said.split(" "), object) if text else None))
            size += len(held[-1][0])
            if size > BUFFER and len(held) > 1:
                held = [merge(held)]
                size = 0
    if held:
        yield *key, merge(held)


# --- phrases

def _phrase_stripes(docs: DataFrame, lengths: tuple[int, ...], known: int, bits, hot) -> DataFrame:
    """Stripes (``key``: language and prefix, ``cut``, ``next``, ``n``) of phrases whose parts of ``known`` words are all marked."""
    def stripes(parts, n):
        prefix, last = parts[:, :-1], parts[:, -1]
        name = names(prefix)
        cut = np.where(np.isin(name, hot.value), (last % U64(CUTS)).astype(np.int64), 0)
        order, _ = _grouped(name, cut, last)
        name, cut, last, n, prefix = name[order], cut[order], last[order], n[order], prefix[order]
        _, first = _grouped(name, cut)
        edge = np.append(first, len(name))
        key = np.ascontiguousarray(prefix[first]).astype("<u8").ravel()
        return pa.RecordBatch.from_arrays([_binary(key, np.arange(len(first) + 1) * prefix.shape[1]), pa.array(cut[first]), _binary(last.astype("<u8"), edge), _binary(n.astype("<i4"), edge)],
                                          ["key", "cut", "next", "n"])

    def read(batches):
        held, size = {n: [] for n in lengths}, dict.fromkeys(lengths, 0)

        def reduce(length):
            parts = np.concatenate(held[length])
            _, at, n = np.unique(names(parts), return_index=True, return_counts=True)
            held[length], size[length] = [], 0
            return stripes(parts[at], n)

        for batch in batches:
            p = Phrases(batch.column("text"), batch.column("lang"))
            at = p.starts(known)
            good = np.zeros(len(p.w.ids) + max(lengths), bool)
            good[at] = _marked(bits.value, names(p.parts(at, known)))
            for length in lengths:
                at = p.starts(length)
                for k in range(length - known + 1):
                    at = at[good[at + k]]
                if len(at):
                    held[length].append(p.parts(at, length))
                    size[length] += len(at)
                if size[length] > BUFFER:
                    yield reduce(length)
        for length in lengths:
            if size[length]:
                yield reduce(length)

    return docs.select("lang", "text").mapInArrow(read, "key binary, cut long, next binary, n binary")


def count_phrases(docs: DataFrame, lengths: tuple[int, ...], known: int, bits, hot) -> DataFrame:
    """``code`` (language), ``ids`` (words), ``name`` and ``n`` of phrases found ``LEAST`` times."""
    def merge(batches):
        # rows come sorted by key and cut; entries of one batch are merged at once, the last stripe waits for the next batch
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if left is not None:
                table = pa.concat_tables([left, table])
            keys, cuts = table.column("key").to_pylist(), table.column("cut").to_pylist()
            stay = len(keys)
            while stay and keys[stay - 1] == keys[-1] and cuts[stay - 1] == cuts[-1]:
                stay -= 1
            if stay:
                yield from finish(table.slice(0, stay))
            left = table.slice(stay)
            if left.num_rows > 64:  # a stripe of many tasks
                left = squeeze(left)
        if left is not None and left.num_rows:
            yield from finish(left)

    def sums(table):
        table = table.combine_chunks()
        keys, cuts = table.column("key").to_pylist(), table.column("cut").to_numpy()
        wide = table.column("n").to_pylist()
        last, size = _entries(table.column("next"), "<u8")
        # merged stripes carry eight bytes a count, fresh ones four
        n = np.concatenate([np.frombuffer(w, "<i8" if len(w) == 8 * s else "<i4").astype(np.int64) for w, s in zip(wide, size.tolist())])
        run = np.cumsum([0] + [int(keys[i] != keys[i - 1] or cuts[i] != cuts[i - 1]) for i in range(1, len(keys))])
        row = np.repeat(run, size)
        order, at = _grouped(row, last)
        return keys, cuts, run, row[order[at]], last[order[at]], np.add.reduceat(n[order], at)

    def squeeze(table):
        keys, cuts, _, _, last, n = sums(table)
        edge = np.array([0, len(last)])
        return pa.table({"key": pa.array(keys[:1], pa.binary()), "cut": pa.array(cuts[:1]), "next": _binary(last.astype("<u8"), edge), "n": _binary(n.astype("<i8"), edge)})

    def finish(table):
        keys, _, run, row, last, n = sums(table)
        often = n >= LEAST
        row, last, n = row[often], last[often], n[often]
        first = np.searchsorted(run, row)
        length = np.array([len(keys[i]) // 8 for i in first.tolist()], np.int64)
        for size in np.unique(length).tolist():
            mine = np.flatnonzero(length == size)
            prefix = np.frombuffer(b"".join(keys[i] for i in first[mine].tolist()), "<u8").reshape(-1, size)
            parts = np.concatenate([prefix, last[mine, None]], 1)
            suffix = names(np.concatenate([parts[:, :1], parts[:, 2:]], 1))
            ids = parts[:, 1:].copy().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts[:, 0].copy().view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1) * size, pa.int32()), pa.array(ids.ravel())),
                 pa.array(names(parts).view(np.int64)), pa.array(n[mine]), pa.array(names(prefix).view(np.int64)), pa.array(suffix.view(np.int64)),
                 pa.array(np.stack([names(parts[:, :k + 1]) for k in range(1, size)], 1).view(np.int64).tolist(), pa.list_(pa.int64())),
                 pa.array(np.stack([names(np.concatenate([parts[:, :1], parts[:, k + 1:]], 1)) for k in range(1, size)], 1).view(np.int64).tolist(), pa.list_(pa.int64()))],
                ["code", "ids", "name", "n", "prefix", "suffix", "heads", "tails"])

    rows = _phrase_stripes(docs, lengths, known, bits, hot).repartition("key", "cut").sortWithinPartitions("key", "cut")
    return rows.mapInArrow(merge, "code long, ids array<long>, name long, n long, prefix long, suffix long, heads array<long>, tails array<long>")


def _bits(rows: DataFrame) -> np.ndarray:
    """Bit map of the hashes in ``rows(name)``; made of pieces of 64 kB, of which the driver holds at most 128 MB."""
    wanted = 16 * max(rows.count(), 1)
    size = min(max(wanted.bit_length(), LEAST_BITS), MOST_BITS)
    place = F.shiftrightunsigned("name", 64 - size)

    def make(table):
        out = np.zeros(1 << 19, np.uint8)
        out[table.column("place").to_numpy() & ((1 << 19) - 1)] = 1
        return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    pieces = rows.select(F.shiftright(place, 19).alias("piece"), place.alias("place")).distinct().groupBy("piece").applyInArrow(make, "piece long, bits binary")
    bits = np.zeros(1 << size - 3, np.uint8)
    for row in pieces.toLocalIterator():
        bits[row["piece"] << 16:(row["piece"] + 1) << 16] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _frequent(rows: DataFrame, total: int) -> np.ndarray:
    """Hashes of the parts that hold more than a ``CUTS``-th of all words: fewer than ``CUTS`` of each length."""
    found = rows.where(F.col("n") > total // CUTS).select("name").collect()
    return np.array([r["name"] for r in found], np.int64).view(U64)


def top_phrases(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the first ``top`` phrases of each language of ``docs(lang, text)``.

    The score of a cut is floor(2000000 a / (l + r)), that of a phrase its lowest, of equal ones the first. Phrases inside a longer one that has
    at least 0.8 of their count are left out. Runs the counting passes while the plan is built.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    counted = cut_lineage(spark, count_words(docs))
    words_ = counted.where("word is not null")
    langs = counted.where("word is null").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    total = langs.agg(F.sum("n").alias("n")).first()["n"] or 0
    pairs = cut_lineage(spark, count_phrases(docs, (2,), 1, share(_bits(words_)), share(_frequent(words_, total))))
    longer = cut_lineage(spark, count_phrases(docs, (3, 4), 2, share(_bits(pairs)), share(_frequent(pairs, total))))
    phrases = pairs.unionByName(longer)
    # a part of two words less is subsumed only if the part between is
    wider = longer.select(F.col("prefix").alias("name"), "n").unionByName(longer.select(F.col("suffix").alias("name"), "n")).groupBy("name").agg(F.max("n").alias("most"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    kept = phrases.join(wider, "name", "left").where(F.col("most").isNull() | (exact("most") * 100 < exact("n") * 80))
    counts = words_.select("name", "n").unionByName(phrases.select("name", "n"))
    cuts = kept.select("code", "ids", "name", F.col("n").alias("a"), F.posexplode(F.arrays_zip("heads", "tails")).alias("cut", "part")).select(
        "code", "ids", "name", "a", "cut", F.col("part.heads").alias("head"), F.col("part.tails").alias("tail"))
    cuts = cuts.join(counts.select(F.col("name").alias("head"), F.col("n").alias("l")), "head").join(counts.select(F.col("name").alias("tail"), F.col("n").alias("r")), "tail")
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = cuts.withColumn("score", score).groupBy("name", "code", "ids", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    spelled = best.select("name", "code", "a", "c.score", "c.l", "c.r", F.posexplode("ids").alias("place", "id")).join(
        words_.select("code", "id", "word"), ["code", "id"]).groupBy("name", "code", "a", "score", "l", "r").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("code").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(langs, "code").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB: all phrases of up to four words counted outright.
ORACLE = """
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    g AS (SELECT lang, k, w[i:i + k - 1] AS ws FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE len(w) >= k)),
    f AS (SELECT lang, k, ws, count(*) AS n FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
    total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
    wider AS (SELECT lang, ws, max(n) AS most FROM (SELECT lang, ws[1:k - 1] AS ws, n FROM f WHERE k > 2 UNION ALL SELECT lang, ws[2:k], n FROM f WHERE k > 2
              UNION ALL SELECT lang, ws[1:2], n FROM f WHERE k = 4 UNION ALL SELECT lang, ws[2:3], n FROM f WHERE k = 4 UNION ALL SELECT lang, ws[3:4], n FROM f WHERE k = 4) GROUP BY 1, 2),
    c AS (SELECT f.* FROM f LEFT JOIN wider USING (lang, ws) WHERE k >= 2 AND (most IS NULL OR 100 * most < 80 * f.n)),
    cuts AS (SELECT c.lang, c.ws, c.n AS a, j, l.n AS l, r.n AS r, CAST(2000000 * CAST(c.n AS HUGEINT) // (l.n + r.n) AS BIGINT) AS score
             FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:j] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[j + 1:c.k]),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1),
    ranked AS (SELECT *, array_to_string(ws, ' ') AS phrase FROM best)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked) JOIN total USING (lang) WHERE rank <= 2000"""
