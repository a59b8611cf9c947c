"""Running totals, exact quantiles and ranks that never sort a whole group in one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from floodframe.session import cut_lineage

_SLICE_BITS = 10


def _slice_number(value: Column, cuts: Column) -> Column:
    """How many of the ``2**_SLICE_BITS - 1`` sorted cuts lie below a value, by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(_SLICE_BITS))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.element_at(cuts, at + step) < value, at + step).otherwise(at)
    )


def running_totals(
    df: DataFrame, order_col: str, measures: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Append ``<m>_before`` (sum over smaller ``order_col``) and ``<m>_total`` for each measure.

    ``df`` holds one row per ``(by, order_col)``. Approximate quantiles only choose the slice
    boundaries, so that slices are about equal however the values are distributed; each slice is
    scanned on its own and gets the exact total of the slices before it. ``df`` is read three times,
    so it is written out first.
    """
    by = list(by)
    df = cut_lineage(df.sparkSession, df)
    slices = 1 << _SLICE_BITS
    marks = [i / slices for i in range(1, slices)]
    cuts = df.groupBy(*by).agg(F.percentile_approx(order_col, marks, 10_000).alias("_cuts"))
    keyed = df.join(cuts, by) if by else df.withColumn("_cuts", cuts.scalar())
    sliced = keyed.withColumn("_slice", _slice_number(F.col(order_col), F.col("_cuts"))).drop("_cuts")
    within = Window.partitionBy(*by, "_slice").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    inner = sliced.select("*", *[F.coalesce(F.sum(m).over(within), F.lit(0)).alias(f"_{m}_in") for m in measures])

    sums = sliced.groupBy(*by, "_slice").agg(*[F.sum(m).alias(f"_{m}_sum") for m in measures])
    group = Window.partitionBy(*(by or [F.lit(0)]))  # at most 1024 rows per group
    ahead = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, "_slice",
        *[F.coalesce(F.sum(f"_{m}_sum").over(ahead), F.lit(0)).alias(f"_{m}_off") for m in measures],
        *[F.sum(f"_{m}_sum").over(group).alias(f"{m}_total") for m in measures],
    )
    return inner.join(offsets, by + ["_slice"]).select(
        *df.columns,
        *[(F.col(f"_{m}_in") + F.col(f"_{m}_off")).alias(f"{m}_before") for m in measures],
        *[f"{m}_total" for m in measures],
    )


_SKETCH = 10_000
_MARGINS = (3 / _SKETCH, 0.02)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row per ``(by, column_name)`` with ``q0, q1, ...``.

    A sketch proposes a narrow and a wide bracket per quantile. Counting the values below and inside tells which of them holds the
    wanted ranks; if neither does, the bracket is the whole range. Only values inside the bracket taken are ranked. Runs its jobs at once.
    """
    by, marks_per = list(by), 2 * len(_MARGINS)
    spark = df.sparkSession
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    values = df.select(*by, *[number(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    marks = [m for p in probabilities for margin in _MARGINS for m in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = values.groupBy(*by).agg(F.struct(*[
        F.struct(F.min(f"_v{i}").alias("lo"), F.max(f"_v{i}").alias("hi"), F.percentile_approx(f"_v{i}", marks, _SKETCH).alias("q")).alias(f"_s{i}")
        for i in range(len(columns))
    ]).alias("_s"))
    sketch = cut_lineage(spark, sketch)  # one row per group
    with_row = lambda rows, name: values.join(rows, by) if by else values.withColumn(name, rows.select(name).scalar())

    pairs = [(i, k) for i in range(len(columns)) for k in range(len(probabilities))]
    proposed = {
        (i, k): [(F.col(f"_s._s{i}.q")[marks_per * k + 2 * m], F.col(f"_s._s{i}.q")[marks_per * k + 2 * m + 1]) for m in range(len(_MARGINS))]
        for i, k in pairs
    }
    counts = []
    for i, k in pairs:
        v = F.col(f"_v{i}")
        tried = [F.struct(F.count_if(v < lo).alias("below"), F.count_if(v <= hi).alias("upto")) for lo, hi in proposed[i, k]]
        counts.append(F.struct(F.count(v).alias("total"), F.array(*tried).alias("tried")).alias(f"_c{i}_{k}"))
    counted_rows = with_row(sketch, "_s").groupBy(*by).agg(*counts)
    joined = counted_rows.join(sketch, by) if by else counted_rows.withColumn("_s", sketch.select("_s").scalar())
    brackets = []
    for key, (i, k) in enumerate(pairs):
        c = F.col(f"_c{i}_{k}")
        position = F.lit(float(probabilities[k])) * (c["total"] - 1)
        chosen = F.struct(F.col(f"_s._s{i}.lo").alias("lo"), F.col(f"_s._s{i}.hi").alias("hi"), F.lit(0).cast("long").alias("below"))
        for m in reversed(range(len(_MARGINS))):
            lo, hi = proposed[i, k][m]
            tried = c["tried"][m]
            holds = (tried["below"] <= F.floor(position)) & (F.ceil(position) < tried["upto"])
            chosen = F.when(holds, F.struct(lo.alias("lo"), hi.alias("hi"), tried["below"].alias("below"))).otherwise(chosen)
        brackets.append(F.struct(F.lit(key).alias("key"), c["total"].alias("total"), chosen["lo"].alias("lo"), chosen["hi"].alias("hi"), chosen["below"].alias("below")))
    bracket = cut_lineage(spark, joined.select(*by, F.array(*brackets).alias("_b")))
    inside = [
        F.when(F.col(f"_v{i}").between(F.col("_b")[key]["lo"], F.col("_b")[key]["hi"]), F.struct(F.lit(key).alias("key"), F.col(f"_v{i}").alias("value")))
        for key, (i, k) in enumerate(pairs)
    ]
    counted = (
        with_row(bracket, "_b").select(*by, F.explode(F.array_compact(F.array(*inside))).alias("_p")).select(*by, "_p.*")
        .groupBy(*by, "key", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    offsets = bracket.select(*by, F.inline("_b")).select(*by, "key", "total", "below")
    ranked = running_totals(counted, "value", ["n"], by + ["key"]).join(offsets, by + ["key"])

    chance = F.element_at(F.array(*[F.lit(float(p)) for p in probabilities]), F.pmod("key", F.lit(len(probabilities))) + 1)
    position = chance * (F.col("total") - 1)
    first = F.col("below") + F.col("n_before")

    def value_at(rank):
        return F.max(F.when((first <= rank) & (rank < first + F.col("n")), F.col("value")))

    found = ranked.groupBy(*by, "key", "total").agg(
        value_at(F.floor(position)).alias("_lo"), value_at(F.ceil(position)).alias("_hi")
    ).withColumn("q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (position - F.floor(position)))
    names = F.array(*[F.lit(c) for c in columns])
    which = F.element_at(names, F.floor(F.col("key") / len(probabilities)).cast("int") + 1)
    return found.groupBy(*by, which.alias("column_name")).agg(
        F.max("total").alias("n"),
        *[F.max(F.when(F.pmod("key", F.lit(len(probabilities))) == k, F.col("q"))).alias(f"q{k}") for k in range(len(probabilities))],
    )


def quantile_row(df: DataFrame, columns: Sequence[str], probability: float) -> DataFrame:
    """The same quantile of several columns as one row, one field per column."""
    q = exact_quantiles(df, columns, [probability])
    return q.agg(*[F.max(F.when(F.col("column_name") == c, F.col("q0"))).alias(c) for c in columns])


def seeded_hash(key: str, seed: int):
    """Hash text of a row key, the order of a repeatable shuffle."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def shuffled_rank(df: DataFrame, key: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Append ``shuffle_rank`` (from 1) and ``group_size``: the place of each row in a seeded shuffle of its group.

    ``key`` identifies a row. Rows are ranked inside hash slices, so a group of any size is spread out.
    """
    by = list(by)
    hashed = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_slice", F.substring("_h", 1, 3)).withColumn("_h", F.unhex("_h"))
    inner = Window.partitionBy(*by, "_slice").orderBy("_h", key)
    ranked = hashed.withColumn("_rn", F.row_number().over(inner))
    counts = hashed.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*(by or [F.lit(0)]))  # at most 4096 slices per group
    ahead = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "_slice",
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"),
        F.sum("_n").over(group).alias("group_size"),
    )
    return ranked.join(offsets, by + ["_slice"]).select(
        *df.columns, (F.col("_rn") + F.col("_off")).alias("shuffle_rank"), "group_size"
    )
