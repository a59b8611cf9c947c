"""Prefix trie of conversations by ROLLUP over turn columns.

A conversation lies in blocks of ``BLOCK`` turns, a column per turn. One ``ROLLUP`` over these columns gives every prefix that ends in the
block, ``grouping_id`` tells its depth; further blocks are keyed by the node their conversation has reached, which a digest of all turns
before names, so that all blocks of all conversations are rolled up at once.

What holds for whole subtrees comes from the same aggregate. A node belongs to its smallest member; the nodes of a conversation are its path
from some depth on, so a subtree is the rest of its smallest member's path and everything that its other members own. Sums over members of
what each owns are therefore sums over the distinct nodes of a subtree. A first rollup finds the owners, a second one sums.

Skew. Places and digests along a conversation are summed in slices of its turns; sums per node are combined before they are shuffled; the ids
that end in a node are joined in slices and hashed as a stream, none is held whole.

Defined results: null role and text are empty; turns tie by the digest of role and text, and repeated rows are turns of their own; a null
conversation id takes no part; an empty table has no node; other columns are ignored.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from floodframe.llm.common import cut_lineage

#: Turn columns of a block.
BLOCK = 8
#: Turn numbers, blocks or ids of one slice.
SLICE = 1024
_NODE = ["depth", "x", "y"]


def _running(df: DataFrame, slice_, order, measures: dict) -> DataFrame:
    """Append ``<name>_before`` and ``<name>_total`` of each measure (column, aggregate, sum of two) along a conversation, slice by slice."""
    sliced = df.withColumn("slice", slice_)
    within = Window.partitionBy("conv_id", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")  # one row per slice
    ahead = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    inner = sliced.select("*", *[zero(agg(c).over(within)).alias(f"_{m}") for m, (c, agg, _) in measures.items()])
    sums = sliced.groupBy("conv_id", "slice").agg(*[zero(agg(c)).alias(m) for m, (c, agg, _) in measures.items()])
    offsets = sums.select("conv_id", "slice", *[zero(agg(m).over(ahead)).alias(f"{m}_off") for m, (_, agg, _) in measures.items()],
                          *[agg(m).over(whole).alias(f"{m}_total") for m, (_, agg, _) in measures.items()])
    return inner.join(offsets, ["conv_id", "slice"]).select(
        *df.columns, *[both(F.col(f"_{m}"), F.col(f"{m}_off")).alias(f"{m}_before") for m, (_, _, both) in measures.items()],
        *[f"{m}_total" for m in measures])


_SUM = (F.sum, lambda a, b: a + b)
_XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def placed(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 1), ``id`` (digest of role and text) and ``words`` of each turn."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    known = F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.unhex(F.md5(known)).alias("id"), F.regexp_count(text("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    turns = cut_lineage(conversations.sparkSession, turns)
    slice_ = F.coalesce(F.floor(F.col("turn") / SLICE).cast("long"), F.lit(-(1 << 62)))
    rows = _running(turns, slice_, [F.col("turn").asc_nulls_first(), "id"], {"n": (F.lit(1), *_SUM)})
    return rows.select("conv_id", (F.col("n_before") + 1).alias("place"), "id", "words")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Turns (``conv_id``, ``place``, ``id``, ``words``) in which each conversation c begins with up to crc32(c) % 4 turns of c - c % 20.

    Each conversation also has one row without a turn, so that one left with none isn't lost.
    """
    turns = cut_lineage(conversations.sparkSession, placed(conversations))
    base = (F.col("conv_id") - F.col("conv_id") % 20).alias("base")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    first = turns.where("place <= 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "place", "id", "words")
    each = turns.where("place = 1").select("conv_id", base, taken.alias("taken"))
    shared = each.where("taken > 0").join(first, "base").where("place <= taken").select("conv_id", "place", "id", "words")
    have = first.groupBy("base").agg(F.max("place").alias("have"))
    own = turns.withColumn("taken", taken).where("place > taken").withColumn("base", base).join(have, "base", "left")
    at = F.col("place") - F.col("taken") + F.least("taken", F.coalesce("have", F.lit(0)))
    none = each.select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("id"), F.lit(None).cast("long").alias("words"))
    return shared.unionByName(own.select("conv_id", at.alias("place"), "id", "words")).unionByName(none)


def blocks(turns: DataFrame) -> DataFrame:
    """Conversations in rows of ``BLOCK`` turns ``t0``.., with what lies before: ``x``, ``y`` (digest), ``words``; and totals of the conversation."""
    here = F.col("id").isNotNull()
    at = F.col("place") - 1
    mark = lambda *c: F.when(here, F.xxhash64(*c, "place", "id"))
    rows = turns.groupBy("conv_id", F.coalesce(F.floor(at / BLOCK), F.lit(0)).alias("block")).agg(
        F.map_from_entries(F.collect_list(F.when(here, F.struct((at % BLOCK).cast("int"), F.struct("id", "words"))))).alias("turns"),
        F.bit_xor(mark()).alias("x"), F.bit_xor(mark(F.lit(1))).alias("y"), F.sum("words").alias("words"), F.count("id").alias("n"))
    rows = cut_lineage(turns.sparkSession, rows)
    held = _running(rows, F.floor(F.col("block") / SLICE), ["block"], {
        "x": (F.col("x"), *_XOR), "y": (F.col("y"), *_XOR), "words": (F.col("words"), *_SUM), "n": (F.col("n"), *_SUM)})
    return held.select("conv_id", "block", *[F.col("turns")[k].alias(f"t{k}") for k in range(BLOCK)], *[F.col(f"{c}_before").alias(c) for c in ("x", "y", "words")],
                       F.col("x_total").alias("x_end"), F.col("y_total").alias("y_end"), F.col("words_total").alias("all_words"), F.col("n_total").alias("length"))


def _rolled(rows: DataFrame, measures: str) -> DataFrame:
    """``measures`` per node, with its ``depth``, ``level`` in the block, ``block``, ``x``, ``y``, ``words`` before the block and turns."""
    turns = ", ".join(f"t{k}" for k in range(BLOCK))
    level = f"{BLOCK} - bit_count(grouping_id())"
    nodes = rows.sparkSession.sql(
        f"SELECT block, x, y, words, {turns}, {level} AS level, block * {BLOCK} + {level} AS depth, {measures} FROM {{rows}} GROUP BY block, x, y, words, ROLLUP({turns})", rows=rows)
    last = F.coalesce(*[F.when(F.col("level") == k + 1, F.col(f"t{k}")) for k in range(BLOCK)])
    return nodes.withColumn("last", last).where("last is not null or depth = 0")


def _ends(rows: DataFrame) -> DataFrame:
    """``ends_sha256`` per node in which conversations end."""
    some = rows.where("block = 0").select(F.col("length").alias("depth"), F.col("x_end").alias("x"), F.col("y_end").alias("y"), "conv_id")
    joined = some.groupBy(*_NODE, F.floor(F.col("conv_id") / SLICE).alias("slice")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))  # up to SLICE ids

    def run(batches):
        node, digest = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids"))):
                if key == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            yield _batch(done)
        yield _batch([(*node, digest.hexdigest())] if node else [])

    def _batch(rows):
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*_NODE, "ends_sha256"])

    return joined.repartition(*_NODE).sortWithinPartitions(*_NODE, "slice").mapInArrow(run, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row per distinct prefix of the conversations in ``turns(conv_id, place, id, words)``; a row without ``id`` states a conversation.

    ``conv_id`` is the smallest member, with ``depth`` it names the node. Runs jobs while the plan is built.
    """
    spark = turns.sparkSession
    rows = cut_lineage(spark, blocks(turns))
    owned = _rolled(rows, "min(conv_id) AS conv_id, max(length) AS longest").groupBy("conv_id").agg(
        F.sum(F.coalesce("last.words", F.lit(0))).alias("owned"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    held = rows.join(cut_lineage(spark, owned), "conv_id", "left").fillna(0, ["owned", "leaf"])
    nodes = _rolled(held, "min(conv_id) AS conv_id, count(*) AS n_convs, sum(leaf) AS n_leaves, sum(all_words) AS every, sum(owned) AS distinct, "
                          "min_by(all_words, conv_id) AS own_words, min_by(owned, conv_id) AS own_owned")
    before, up = F.col("words"), {"x": F.col("x"), "y": F.col("y")}
    full = dict(up)
    for k in range(BLOCK):
        t, place = F.col(f"t{k}"), F.col("block") * BLOCK + k + 1
        for name, more in (("x", ()), ("y", (F.lit(1),))):
            turn = F.xxhash64(*more, place, t["id"])
            full[name] = full[name].bitwiseXOR(F.when(F.col("level") > k, turn).otherwise(0))
            up[name] = up[name].bitwiseXOR(F.when(F.col("level") > k + 1, turn).otherwise(0))
        before = before + F.when(F.col("level") > k + 1, t["words"]).otherwise(0)
    saved = (F.col("every") - F.col("n_convs") * before) - (F.col("distinct") - F.col("own_owned") + F.col("own_words") - before)
    nodes = cut_lineage(spark, nodes.select(F.col("depth").cast("long"), full["x"].alias("x"), full["y"].alias("y"), up["x"].alias("up_x"), up["y"].alias("up_y"),
                                            "conv_id", "n_convs", "n_leaves", saved.alias("saved_tokens")))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(children, _NODE, "left").join(_ends(rows), _NODE, "left").join(parents, ["depth", "up_x", "up_y"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""

#: DuckDB: whole paths as text, subtrees by joining every path with its beginnings.
ORACLE = f"""
    WITH t AS (SELECT conv_id, turn, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
                      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS place FROM t),
    c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor({_CRC}, 4294967295) % 4 AS taken FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT c.conv_id, 0 AS mine, p.place, p.id, p.words FROM c JOIN p ON p.conv_id = c.base AND p.place <= c.taken
          UNION ALL SELECT c.conv_id, 1, p.place, p.id, p.words FROM c JOIN p ON p.conv_id = c.conv_id AND p.place > c.taken),
    s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY mine, place) AS depth FROM r),
    paths AS (SELECT conv_id, depth, words, string_agg(id, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM s
              UNION ALL SELECT conv_id, 0, 0, '' FROM c),
    lens AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY 1),
    nodes AS (SELECT path, depth, CASE WHEN depth > 1 THEN left(path, length(path) - 33) WHEN depth = 1 THEN '' END AS up, any_value(words) AS words,
                     min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(depth = length) AS leaf,
                     string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = length) AS ends
              FROM paths JOIN lens USING (conv_id) GROUP BY 1, 2),
    below AS (SELECT DISTINCT a.path AS top, b.path FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
    sums AS (SELECT top AS path, sum(CAST(leaf AS INT)) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM below JOIN nodes USING (path) GROUP BY 1),
    kids AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1)
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
           CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
    FROM nodes n JOIN sums USING (path) LEFT JOIN kids USING (path) LEFT JOIN nodes u ON u.path = n.up"""
