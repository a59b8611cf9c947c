"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Every vector gets one more component that brings it to the length of the longest, every query a zero: the nearest by distance then has the
largest inner product. A table hashes a vector by Gaussian projections cut into cells of ``WIDTH``. A query visits its own and perturbed
buckets in the order of estimated success: a neighbour's projection is normal around a multiple of the query's, so a bucket's chance is a
product over the projections, and the best products are found one projection at a time. Candidates of all tables are merged and ranked by
their exact inner products.

Fitting. The number of projections follows the number of vectors. ``SAMPLE`` vectors (first in hash order) search exactly; their neighbours
give the spread of the projections and the number of buckets to visit so that ``TARGET`` of them are met. More tables are added, up to
``MOST_TABLES``, if ``MOST_PROBES`` buckets don't suffice. Every vector is indexed.

Skew. Equal vectors are one class that keeps its smallest ids; a class is searched once however many queries share it. A group of buckets is
dealt in slices of vectors and blocks of queries by its counted size. Queries that met too few candidates search all vectors, in blocks.

Defined results: a vector that is null, empty, zero or holds null or non-finite components takes no part, nor does a null id or a vector whose
length isn't the commonest (the greater, if equally common); of several vectors of one id the smallest counts; ties go to the smaller id; an
empty table, or one without queries, gives no rows; other columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from floodframe.llm import words as W
from floodframe.llm.common import bounded, cut_lineage

U64 = np.uint64
WIDTH = 2.5
TABLES, MOST_TABLES, MOST_PROBES = 4, 32, 4096
SAMPLE, TARGET, SEED = 128, 0.95, 7
#: Vectors of an average bucket, were all cells equally likely.
BUCKET = 4
#: Bytes of vectors, as doubles, and number of queries that meet in one task.
CELL_BYTES, CELL_QUERIES = 32 << 20, 4096
#: Pairs a task holds before it keeps only the best.
_PAIRS = 1 << 20
#: Rounding of a matrix product against the exact order.
_EPS = 1e-9
_grid = np.linspace(-9, 9, 8001)
_PHI = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in _grid])


def usable(vectors: DataFrame) -> DataFrame:
    """One row (``vec_id``, ``v``) per id whose vector takes part."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (length["n"] if length else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """``class_id`` (smallest id), ``ids`` (the ``k + 1`` smallest) and ``v`` of each distinct vector."""
    least = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    return least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("class_id"), "ids", "v")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list or packed column as doubles."""
    if pa.types.is_binary(column.type):
        raw = b"".join(column.to_pylist())
        return np.frombuffer(raw, "<f4" if len(raw) == 4 * dim * len(column) else "<f8").reshape(-1, dim).astype(np.float64)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _packed(array: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    size = array.shape[1] * array.itemsize
    return pa.Array.from_buffers(pa.binary(), len(array), [None, pa.py_buffer(np.arange(len(array) + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(array))])


def best(query: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's ``k`` highest scores and of those that rounding can't tell from the last."""
    order = np.lexsort((-score, query))
    q, s = query[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(q)))
    last = s[first + np.minimum(size, k) - 1]
    return order[s >= np.repeat(last - _EPS * np.maximum(np.abs(last), 1e-300), size)]


# --- hashing

def _tables(dim: int, projections: int, tables: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(SEED)
    return [(rng.normal(size=(dim + 1, projections)), rng.uniform(0, WIDTH, projections)) for _ in range(tables)]


def _lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors at unit length after the added component."""
    rest = np.sqrt(np.maximum(longest ** 2 - (x * x).sum(1), 0))
    return np.concatenate([x, rest[:, None]], 1) / longest


def _directions(x: np.ndarray) -> np.ndarray:
    """Queries at unit length; their length doesn't change what is nearest."""
    x = x / np.abs(x).max(1)[:, None]
    return np.concatenate([x / np.sqrt((x * x).sum(1))[:, None], np.zeros((len(x), 1))], 1)


def codes(unit: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bucket of each row as a hash of its cells."""
    cells = np.floor((unit @ table[0] + table[1]) / WIDTH).astype(np.int64).astype(U64)
    out = np.zeros(len(unit), U64)
    for i in range(cells.shape[1]):
        out = W.join(out, cells[:, i])
    return out


def probes(unit: np.ndarray, table: tuple[np.ndarray, np.ndarray], cosine: float, count: int) -> np.ndarray:
    """Buckets of each query, most likely first: at most ``count`` columns.

    A prefix of one of the best ``count`` products is one of the best ``count`` prefixes, so nothing better is lost on the way.
    """
    at, shift = unit @ table[0], table[1]
    spread = math.sqrt(max(1 - cosine * cosine, 1e-6))
    cell = np.arange(-4, 5)
    chance, code = np.ones((len(unit), 1)), np.zeros((len(unit), 1), U64)
    for i in range(at.shape[1]):
        edge = (np.append(cell, 5) * WIDTH - shift[i] - cosine * at[:, i:i + 1]) / spread
        p = np.maximum(np.diff(np.interp(edge, _grid, _PHI), axis=1), 1e-12)
        likely = np.argsort(-p, 1, kind="stable")[:, :3]
        step = cell[likely].astype(np.int64).astype(U64)
        chance = (chance[:, :, None] * np.take_along_axis(p, likely, 1)[:, None, :]).reshape(len(unit), -1)
        code = W.join(np.repeat(code, 3, 1), np.tile(step, (1, code.shape[1])))
        if chance.shape[1] > count:
            keep = np.argpartition(-chance, count - 1, axis=1)[:, :count]
            chance, code = np.take_along_axis(chance, keep, 1), np.take_along_axis(code, keep, 1)
    return np.take_along_axis(code, np.argsort(-chance, 1, kind="stable"), 1)


# --- meeting of points and queries

def _deal(points: DataFrame, asked: DataFrame, dim: int) -> DataFrame:
    """Slices of vectors and blocks of queries of each group, from counts."""
    n = max(1024, CELL_BYTES // (8 * dim))
    size = lambda rows, name, most: rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / most).alias(name))
    return bounded(cut_lineage(points.sparkSession, size(points, "slices", n).join(size(asked, "blocks", CELL_QUERIES), "part")))


def meet(points: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """(``query``, ``found``, ``score``): the best ``k`` per query of each meeting of ``points(part, class_id, code, v)`` with ``asked(part, query, codes, v)``."""
    deal = _deal(points, asked, dim)
    many = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    points = points.join(deal, "part").select("part", F.pmod(F.xxhash64("class_id"), "slices").alias("slice"), many("blocks").alias("block"), "class_id", "code", "v")
    asked = asked.join(deal, "part").select("part", F.pmod(F.xxhash64("query"), "blocks").alias("block"), many("slices").alias("slice"), "query", "codes", "v")
    kind = points.schema["class_id"].dataType.simpleString()

    def run(points, asked):
        points, asked = points.combine_chunks(), asked.combine_chunks()
        ids, query = points.column("class_id").combine_chunks(), asked.column("query").combine_chunks()
        x, q = (_matrix(t.column("v").combine_chunks(), dim) for t in (points, asked))
        code = points.column("code").to_numpy().astype(np.int64)
        order = np.argsort(code, kind="stable")
        bucket, start, size = np.unique(code[order], return_index=True, return_counts=True)
        raw = asked.column("codes").to_pylist()
        wanted = np.frombuffer(b"".join(raw), "<i8")
        who = np.repeat(np.arange(len(raw)), [len(r) // 8 for r in raw])
        by = np.argsort(wanted, kind="stable")
        wanted, who = wanted[by], who[by]
        low, high = np.searchsorted(wanted, bucket), np.searchsorted(wanted, bucket, "right")
        floor = np.full(len(q), -np.inf)
        held, count = [], 0

        def reduce():
            mine, other, score = map(np.concatenate, zip(*held))
            keep = best(mine, score, k)
            mine, other, score = mine[keep], other[keep], score[keep]
            seen = np.bincount(mine, minlength=len(q))
            least = np.full(len(q), np.inf)
            np.minimum.at(least, mine, score)
            full = seen >= k
            floor[full] = least[full]
            return mine, other, score

        for b in np.flatnonzero(high > low).tolist():
            mine, others = who[low[b]:high[b]], order[start[b]:start[b] + size[b]]
            for cut in range(0, len(others), 4096):
                some = others[cut:cut + 4096]
                score = q[mine] @ x[some].T
                i, j = np.nonzero(score >= floor[mine][:, None])
                if len(i):
                    held.append((mine[i], some[j], score[i, j]))
                    count += len(i)
                if count > _PAIRS:
                    held = [reduce()]
                    count = min(len(held[0][0]), _PAIRS // 2)
        mine, other, _ = reduce() if held else (np.zeros(0, np.int64),) * 3
        score = np.array([float((q[i] * x[j]).sum()) for i, j in zip(mine, other)])
        return pa.table({"query": query.take(pa.array(mine)), "found": ids.take(pa.array(other)), "score": pa.array(score, pa.float64())})

    keys = ["part", "slice", "block"]
    return points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, f"query {kind}, found {kind}, score double")


def _top(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    return pairs.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _scan(found: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """The best ``k`` classes of all for each row of ``asked(query, v)``, exactly, in blocks."""
    here = F.lit(0).cast("long").alias("part")
    none = F.lit(0).cast("long")
    points = _bytes(found.select(here, "class_id", none.alias("code"), "v"))
    return _top(meet(points, _bytes(asked.select(here, "query", F.unhex(F.lit("00" * 8)).alias("codes"), "v")), dim, k), k)


def _bytes(df: DataFrame) -> DataFrame:
    """``v`` packed."""
    small = df.schema["v"].dataType.elementType.simpleString() == "float"
    names = df.columns

    def run(batches):
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f4" if small else "<f8")
            packed = _packed(flat.reshape(batch.num_rows, -1)) if batch.num_rows else pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if n == "v" else batch.column(n) for n in names], names)

    schema = ", ".join(f"{f.name} {'binary' if f.name == 'v' else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema)


# --- fitting and searching

def fit(found: DataFrame, dim: int, k: int) -> dict:
    """Hash tables, spread and number of probes, from ``SAMPLE`` classes of ``found(class_id, v)``; collects them and their neighbours."""
    n = found.count()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    longest = found.agg(F.max(norm).alias("longest")).first()["longest"]
    chosen = found.select(F.col("class_id").alias("query"), "v").orderBy(F.xxhash64("class_id")).limit(SAMPLE)
    sample = cut_lineage(found.sparkSession, chosen)
    near = _scan(found, sample, dim, k + 1).where("query != found")
    pairs = near.join(sample.withColumnRenamed("v", "mine"), "query").join(found.select(F.col("class_id").alias("found"), "v"), "found").select("query", "mine", "v").collect()
    projections = max(1, round(math.log2(max(n / BUCKET, 2))))
    model = {"longest": longest, "projections": projections, "dim": dim, "classes": n, "cosine": 0.5, "probes": 1, "tables": TABLES, "recall": 1.0}
    if not pairs:
        return model
    asking = {r["query"]: r["mine"] for r in pairs}
    place = {q: i for i, q in enumerate(asking)}
    who = np.array([place[r["query"]] for r in pairs])
    query, other = _directions(np.array(list(asking.values()), np.float64)), _lengthened(np.array([r["v"] for r in pairs], np.float64), longest)
    model["cosine"] = float(np.clip(np.median((query[who] * other).sum(1)), 0.05, 0.999))
    rank = np.full(len(pairs), MOST_PROBES)
    tables = _tables(dim, projections, MOST_TABLES)
    for t, table in enumerate(tables, 1):
        same = probes(query, table, model["cosine"], MOST_PROBES)[who] == codes(other, table)[:, None]
        rank = np.minimum(rank, np.where(same.any(1), same.argmax(1), MOST_PROBES))
        if t >= TABLES and (rank < MOST_PROBES).mean() >= TARGET:
            break
    model["tables"] = t
    model["probes"] = int(min(np.sort(rank)[math.ceil(TARGET * len(rank)) - 1] + 1, MOST_PROBES))
    model["recall"] = float((rank < model["probes"]).mean())
    return model


def _index(found: DataFrame, model: dict, parts: int) -> DataFrame:
    """A row (``part``, ``class_id``, ``code``, ``v``) per class and table."""
    kind, small = found.schema["class_id"].dataType.simpleString(), found.schema["v"].dataType.elementType.simpleString() == "float"

    def run(batches):
        tables = _tables(model["dim"], model["projections"], model["tables"])
        for batch in batches:
            x = _matrix(batch.column("v"), model["dim"])
            unit, packed = _lengthened(x, model["longest"]), _packed(x.astype("<f4" if small else "<f8"))
            for t, table in enumerate(tables):
                code = codes(unit, table)
                part = (code % U64(parts)).astype(np.int64) + t * parts
                yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("class_id"), pa.array(code.astype(np.int64)), packed], ["part", "class_id", "code", "v"])

    return found.select("class_id", "v").mapInArrow(run, f"part long, class_id {kind}, code long, v binary")


def _asked(queries: DataFrame, model: dict, parts: int) -> DataFrame:
    """A row (``part``, ``query``, ``codes``, ``v``) per query, table and part that holds one of its buckets."""
    kind, small = queries.schema["query"].dataType.simpleString(), queries.schema["v"].dataType.elementType.simpleString() == "float"

    def run(batches):
        tables = _tables(model["dim"], model["projections"], model["tables"])
        for batch in batches:
            for cut in range(0, batch.num_rows, 256):
                some = batch.slice(cut, 256)
                x = _matrix(some.column("v"), model["dim"])
                unit, raw = _directions(x), x.astype("<f4" if small else "<f8")
                out = ([], [], [], [])
                for t, table in enumerate(tables):
                    code = probes(unit, table, model["cosine"], model["probes"])
                    part = (code % U64(parts)).astype(np.int64)
                    for i in range(len(code)):
                        for p in np.unique(part[i]).tolist() if parts > 1 else [0]:
                            out[0].append(p + t * parts)
                            out[1].append(i)
                            out[2].append(code[i][part[i] == p].astype("<u8").tobytes())
                            out[3].append(raw[i].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), some.column("query").take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
                    ["part", "query", "codes", "v"])

    return queries.select("query", "v").mapInArrow(run, f"part long, query {kind}, codes binary, v binary")


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest found of every row of ``vectors(vec_id, embedding)`` with ``is_query``.

    Runs jobs while the plan is built; classes, index and candidates go to the shared folder.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = cut_lineage(spark, usable(vectors))
    some = rows.select(F.size("v").alias("dim")).first()
    asks = rows.where(is_query)
    if some is None or asks.isEmpty():
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    dim = some["dim"]
    found = cut_lineage(spark, classes(rows, k))
    members = cut_lineage(spark, asks.join(found, "v").select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query"), "v"))
    queries = cut_lineage(spark, members.groupBy("query").agg(F.first("v").alias("v")))
    model = fit(found, dim, k)
    parts = -(-model["classes"] // max(1024, CELL_BYTES // (8 * dim)))
    index = cut_lineage(spark, _index(found, model, parts))
    pairs = cut_lineage(spark, _top(meet(index, cut_lineage(spark, _asked(queries, model, parts)), dim, k + 1), k + 1))
    # classes found, as ids; a class without enough of them searches everything
    total = rows.count()
    ids = lambda p: p.join(found.select(F.col("class_id").alias("found"), "ids"), "found").select("query", "score", F.explode("ids").alias("vec_id"))
    enough = pairs.join(found.select(F.col("class_id").alias("found"), F.size("ids").alias("n")), "found").groupBy("query").agg(F.sum("n").alias("n"))
    short = cut_lineage(spark, queries.join(enough.where(F.col("n") >= min(k + 1, total)).select("query"), "query", "left_anti"))
    if not short.isEmpty():
        pairs = pairs.join(short.select("query"), "query", "left_anti").unionByName(cut_lineage(spark, _scan(found, short, dim, k + 1)))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    first = ids(pairs).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = first.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    mine = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return members.select("query_id", "query").join(lists, "query").select("query_id", F.posexplode(mine).alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
