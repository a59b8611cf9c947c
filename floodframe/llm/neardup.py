"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct shingles of ``width`` words. Each shingle deals exponentially spaced values, one from each of ``REGISTERS``
equally likely intervals, to the registers in an order of its own; a register keeps the least value it gets, on a logarithmic scale.
Registers of a union are the maxima of both sides' registers, and two documents agree in a register about as often as their sets
overlap. Bands of registers propose pairs, a joint likelihood over the registers and both set sizes drops hopeless ones, and the full
sets decide: linked if 100 * |A and B| >= 80 * |A or B|. A link at 0.8 shares no band with probability 4e-9.

Skew. Equal sets are one node from the start. In each round a document is compared with one centre of its bands; what is connected by
then needs no further comparison. What shares a band but no component after ``STAR_ROUNDS`` is compared whole, in blocks of documents.

Defined results: null, empty and wordless texts have an empty set, are linked with nothing and kept; a text of fewer words than a shingle is one shingle; rows
with a null id are linked with nothing and kept; rows that share an id are one document (linked even if their texts differ); ties go
to the smallest id; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from floodframe.llm import words as W
from floodframe.llm.common import bounded, cut_lineage
from floodframe.llm.graph import components

U64 = np.uint64
_MASK = (1 << 64) - 1
REGISTERS, BANDS, ROWS = 512, 64, 6
#: Base and rate of the registers' scale.
BASE, RATE, TOP = 1.001, 20.0, 65534
LINK = 80  # percent
#: A pair estimated below this similarity is not compared: more than eight standard errors under the link.
LEAST_ESTIMATE = 0.65
#: Rounds of comparisons with single documents of each band before the rest is compared in blocks.
STAR_ROUNDS = 2
#: Bytes of text of a block, and documents that visit one copy of it.
BLOCK_BYTES, VISITORS = 2 << 20, 2000


def shingle_sets(column: pa.Array, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text after text, and each text's first."""
    w = W.scan(column, W.SPACED, lower=True)
    value, at = W.ngrams(w, width)
    parts, places = [value], [at]
    for n in range(1, width):  # texts of n words, whole
        short = w.first[:-1][np.diff(w.first) == n]
        whole = w.ids[short]
        for k in range(1, n):
            whole = W.join(whole, w.ids[short + k])
        parts.append(W.mix(whole ^ U64(0xA5A5A5A5)))
        places.append(short)
    value, doc = np.concatenate(parts), w.doc()[np.concatenate(places)]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(len(column) + 1))


def sketches(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers of each set as 16-bit numbers, one row per set."""
    sets, m = len(first) - 1, REGISTERS
    least = np.ones((sets, m), np.float32)
    doc = np.repeat(np.arange(sets), np.diff(first))
    open_sets = np.flatnonzero(np.diff(first) > 0)
    odd, add, odd2 = (value >> U64(8)) | U64(1), value >> U64(24), (value >> U64(40)) | U64(1)
    for j in range(m):
        # the j-th least value of every shingle whose set has a register that may still shrink
        u = (W.mix(value + U64((j + 1) * 0x9E3779B97F4A7C15 & _MASK)) >> U64(40)).astype(np.float32) / np.float32(1 << 24)
        place = (U64(j) * odd) & U64(m - 1)
        place = ((place ^ (place >> U64(4))) * odd2 + add) & U64(m - 1)
        place = (place ^ (place >> U64(5))).astype(np.int64)
        np.minimum.at(least.reshape(-1), doc * m + place, (np.float32(j) + u) / np.float32(m))
        open_sets = open_sets[least[open_sets].max(1) * m > j + 1]
        if not len(open_sets):
            break
        mask = np.zeros(sets, bool)
        mask[open_sets] = True
        if not mask[doc].all():
            keep = mask[doc]
            value, doc, odd, add, odd2 = value[keep], doc[keep], odd[keep], add[keep], odd2[keep]
    with np.errstate(divide="ignore"):
        x = -np.log1p(-least.astype(np.float64)) / RATE
        scale = np.floor(1 - np.log(x) / np.log(BASE))
    # values of real sets lie far inside the 16-bit range once shifted
    return np.clip(scale + 20000, 0, TOP).astype(np.uint16)


def sketch_table(docs: DataFrame, width: int = 2) -> DataFrame:
    """``doc_id``, ``n_shingles``, two 64-bit digests of the set, and the registers."""
    def run(batches):
        for batch in batches:
            value, first = shingle_sets(batch.column("text"), width)
            n = np.diff(first)
            digest = [W.per_text(first, x.astype(np.int64)) for x in (W.mix(value), W.mix(value ^ U64(0x5DEECE66D)))]
            rows = sketches(value, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(digest[0]), pa.array(digest[1]), pa.array([r.tobytes() if k else b"" for r, k in zip(rows, n)], pa.binary())],
                ["doc_id", "n_shingles", "h1", "h2", "registers"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, h1 long, h2 long, registers binary")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely similarity of sets of sizes n_a, n_b from the numbers of registers that are greater, smaller and equal."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(s):
        more, less = p(u - v * s), p(v - u * s)
        return above * np.log(more) + below * np.log(less) + equal * np.log(np.clip(1 - more - less, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        one, two = low + (high - low) / 3, high - (high - low) / 3
        right = likelihood(one) < likelihood(two)
        low, high = np.where(right, one, low), np.where(right, high, two)
    return (low + high) / 2


def _confirmed(pairs: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """Pairs whose full sets are linked; those whose sizes or registers allow no link are not compared."""
    side = lambda x: known.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n_shingles", "registers", "text")])
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(f"registers_{x}").to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in "ab")
                likely = estimate(a, b, batch.column("n_shingles_a").to_numpy().astype(float), batch.column("n_shingles_b").to_numpy().astype(float))
                batch = batch.filter(pa.array(likely >= LEAST_ESTIMATE))
                yield batch.select(["a", "b"]).filter(pa.array(_linked(batch.column("text_a"), batch.column("text_b"), width)))

    columns = ["a", "b", *[f"{c}_{x}" for x in "ab" for c in ("n_shingles", "registers", "text")]]
    return joined.select(columns).mapInArrow(run, pairs.select("a", "b").schema)


def _confirmed_in_blocks(named: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """All links between documents of different labels that share a key of ``named(key, node, label)``.

    Documents are dealt to blocks of about ``BLOCK_BYTES`` of text. One that is not of a key's most frequent label is compared with every block
    that holds a document of the key: a row per document and block instead of one per pair. A block with many such visitors is
    handed out several times.
    """
    spark = named.sparkSession
    sizes = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = cut_lineage(spark, sizes.groupBy("key").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main")))
    nodes = cut_lineage(spark, named.select(F.col("node").alias("doc_id"), "label").distinct())
    texts = cut_lineage(spark, known.select("doc_id", "text").join(bounded(nodes), "doc_id"))
    blocks = -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES) or 1
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    held = named.select("key", block("node").alias("block")).distinct()
    visitors = named.join(bounded(main), "key").where("label != main").select("key", F.col("node").alias("doc_id"))
    visits = cut_lineage(spark, visitors.join(held, "key").select("doc_id", "block").distinct())
    parts = cut_lineage(spark, visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / VISITORS).alias("parts")))
    parts = bounded(parts)
    left = texts.withColumn("block", block("doc_id")).join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    right = visits.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts"))).drop("parts").join(
        texts.select("doc_id", F.col("text").alias("own_text"), F.col("label").alias("own_label")), "doc_id").withColumnRenamed("doc_id", "own_id")
    kind = known.schema["doc_id"].dataType.simpleString()

    def run(block_docs, visiting):
        (x, at_x), (y, at_y) = (shingle_sets(t.column(c).combine_chunks(), width) for t, c in ((block_docs, "text"), (visiting, "own_text")))
        doc = np.repeat(np.arange(len(at_x) - 1), np.diff(at_x))
        order = np.argsort(x, kind="stable")
        x, doc = x[order], doc[order]
        low, high = np.searchsorted(x, y), np.searchsorted(x, y, "right")
        size, label = np.diff(at_x), block_docs.column("label").to_numpy()
        found = ([], [])
        for k, own in enumerate(visiting.column("own_label").to_numpy()):
            a, b = low[at_y[k]:at_y[k + 1]], high[at_y[k]:at_y[k + 1]]
            length = b - a
            stop = np.cumsum(length)
            hits = doc[np.repeat(b - stop, length) + np.arange(stop[-1] if len(stop) else 0)]
            both = np.bincount(hits, minlength=len(size))
            linked = np.flatnonzero((100 * both >= LINK * (size + len(a) - both)) & (both > 0) & (label != own))
            found[0].append(np.full(len(linked), k))
            found[1].append(linked)
        a = visiting.column("own_id").combine_chunks().take(pa.array(np.concatenate(found[0]).astype(np.int64)))
        b = block_docs.column("doc_id").combine_chunks().take(pa.array(np.concatenate(found[1]).astype(np.int64)))
        return pa.table({"a": a, "b": b})

    left, right = left.select("block", "part", "doc_id", "text", "label"), right.select("block", "part", "own_id", "own_text", "own_label")
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, f"a {kind}, b {kind}")


def _linked(a: pa.Array, b: pa.Array, width: int) -> np.ndarray:
    """Whether the full sets of each row's two texts are linked."""
    (x, at_x), (y, at_y) = shingle_sets(a, width), shingle_sets(b, width)
    row = np.concatenate([np.repeat(np.arange(len(a)), np.diff(f)) for f in (at_x, at_y)])
    own = W.join(np.concatenate([x, y]), row.astype(U64))
    order = np.argsort(own)
    twice = order[1:][own[order[1:]] == own[order[:-1]]]
    both = np.bincount(row[twice], minlength=len(a))
    either = np.diff(at_x) + np.diff(at_y) - both
    return (100 * both >= LINK * either) & (either > 0)


def _members(nodes: DataFrame) -> DataFrame:
    """(band key, node, its set's size) of all keys that two nodes or more share. The first pass only counts, so a key of any size is a sum."""
    width = 2 * ROWS
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    rows = nodes.select("doc_id", "n_shingles", "registers", band).select(
        F.expr(f"xxhash64(band, substring(registers, band * {width} + 1, {width}))").alias("key"), F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"))
    shared = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    return rows.join(bounded(cut_lineage(nodes.sparkSession, shared)), "key")  # written first, so that the join can split a hot key


def near_duplicates(docs: DataFrame, width: int = 2) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs(doc_id, text)``.

    Runs jobs while the plan is built; sketches, shared band keys and links go to the shared folder.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = cut_lineage(spark, sketch_table(docs, width))
    real = table.where("n_shingles > 0 and doc_id is not null")
    digest = ["h1", "h2", "n_shingles"]
    copied = real.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    # the class of each row; rows of a large class only meet its one line
    rows = cut_lineage(spark, table.select("doc_id", *digest).join(bounded(cut_lineage(spark, copied)), digest, "left").select(
        "doc_id", *digest, F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.coalesce("rep", "doc_id")).alias("node")))
    copies = rows.where("doc_id != node")
    nodes = real.join(bounded(copies.select("doc_id", "h1", "h2").distinct()), ["doc_id", "h1", "h2"], "left_anti")
    members = cut_lineage(spark, _members(nodes))
    involved = bounded(cut_lineage(spark, members.select(F.col("node").alias("doc_id")).distinct()))
    known = nodes.select("doc_id", "n_shingles", "registers", "h1", "h2").join(involved, "doc_id", "left_semi")
    known = cut_lineage(spark, known.join(docs.select("doc_id", "text").join(involved, "doc_id", "left_semi"), "doc_id"))

    # rows that share an id but not a text
    nodes_of = rows.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most")
    links = cut_lineage(spark, nodes_of.select("doc_id", "a").join(rows.select("doc_id", F.col("node").alias("b")), "doc_id").where("a != b").select("a", "b").distinct())
    labels = components(links)
    for turn in range(STAR_ROUNDS + 1):
        named = _labelled(members, labels)
        if turn:
            mixed = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key")
            named = cut_lineage(spark, named.join(bounded(cut_lineage(spark, mixed)), "key"))
            if named.isEmpty():
                break
        if turn < STAR_ROUNDS:  # each document with that one of its bands' centres it shares most bands with
            rank = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
            centre = named.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "node", "n", "label")).alias("c")).select(
                "key", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.label").alias("centre_label"))
            near = f"label != centre_label AND 100 * least(n, centre_n) >= {LINK} * greatest(n, centre_n)"
            met = named.join(bounded(cut_lineage(spark, centre)), "key").where(near).groupBy("node", "centre").agg(F.count(F.lit(1)).alias("bands"))
            pairs = met.groupBy("node").agg(F.max_by("centre", F.struct("bands", -F.col("centre"))).alias("centre"))
            pairs = pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
            found = _confirmed(pairs, known, width)
        else:
            found = _confirmed_in_blocks(named, known, width)
        links = links.unionByName(cut_lineage(spark, found))
        labels = components(links)
    joined = rows.join(bounded(labels.withColumnRenamed("v", "node")), "node", "left")
    component = F.coalesce("label", "node", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 2) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with all their columns; rows that repeat an id become the least of them."""
    judged = cut_lineage(docs.sparkSession, near_duplicates(docs, width))
    out = docs.join(bounded(judged.where("not kept").select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)
    repeated = judged.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    repeated = bounded(repeated)
    single = out.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("least"))
    return out.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(single.select("doc_id", "least.*").select(*docs.columns))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    named = bounded(labels.withColumnRenamed("v", "node"))
    return members.join(named, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
