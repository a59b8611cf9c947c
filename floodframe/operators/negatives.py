"""Negative samples, exclusion zones and positive augmentation."""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from floodframe import constants as K
from floodframe.functions.geo import bucket_of, mercator_xy, point_in_ring
from floodframe.operators.ranking import running_totals
from floodframe.session import cut_lineage, spread


def negatives_time_offset(
    df: DataFrame, offsets: Sequence[int] = K.NEGATIVE_OFFSETS, id_col: str = "event_id"
) -> DataFrame:
    """One negative per positive and offset, dated that many days earlier at the same place."""
    rows = F.array(*[
        F.struct(
            F.lit(n).alias("days"),
            F.lit(K.SOFT_LABELS.get(n, 0.0)).alias("soft"),
            F.lit(1 if n in K.SOFT_LABELS else 0).alias("near"),
        )
        for n in offsets
    ])
    shifted = df.withColumn("_o", F.explode(rows)).withColumn(
        "flood_start_date", F.date_sub("flood_start_date", F.col("_o.days"))
    )
    return (
        shifted.where(F.col("flood_start_date") >= F.lit(K.EARLIEST_NEGATIVE))
        .withColumns({
            "target": F.lit(0),
            "soft_label": F.col("_o.soft"),
            "near_miss": F.col("_o.near"),
            "year": F.year("flood_start_date"),
            id_col: F.concat(F.lit("neg_"), F.col(id_col).cast("string"), F.lit("_d"), F.col("_o.days").cast("string")),
        })
        .drop("_o")
    )


def augment_by_duration(df: DataFrame, duration: str = "flood_duration_days") -> DataFrame:
    """Positives plus a copy for each further day a long flood is taken to last."""
    days = F.floor(F.col(duration).cast("double"))
    extra = F.lit(K.DURATION_EXTRA_MAX)
    for longest, count in reversed(K.DURATION_STEPS):
        extra = F.when(days <= longest, count).otherwise(extra)
    usable = days.isNotNull() & F.col("flood_start_date").isNotNull()
    if "target" in df.columns:
        usable = usable & (F.coalesce(F.col("target"), F.lit(1)) == 1)
    shift = F.explode(F.sequence(F.lit(0), F.when(usable, extra).otherwise(0)))
    return (
        df.withColumn("_shift", shift)
        .withColumn("flood_start_date", F.date_add("flood_start_date", F.col("_shift")))
        .drop("_shift")
    )


def combine_events(*frames: DataFrame, day: str = "flood_start_date") -> DataFrame:
    """Union of frames with differing columns; year and month recomputed, -1 where undated."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return union.withColumns({
        "year": F.coalesce(F.year(day), F.lit(-1)),
        "month": F.coalesce(F.month(day), F.lit(-1)),
    })


def exclude_within(df: DataFrame, positives: DataFrame, metres: float = K.NEGATIVE_EXCLUSION_M) -> DataFrame:
    """Drop rows lying within ``metres`` of any positive, measured on the Web-Mercator plane.

    A candidate in a square too small to reach across, which holds a positive, is settled by that. The other distinct candidate
    places are compared with occupied squares of shrinking size, not with the positives in them. A square wholly within reach settles
    the place, one wholly out of reach is dropped, and only squares cut by the circle are opened, down to the positives themselves. So
    a crowded spot costs a place no more than a bounded number of squares per step. Candidates and steps are written once. Runs jobs at once.
    """
    spark, names = df.sparkSession, df.columns
    x, y = mercator_xy(F.col("latitude"), F.col("longitude"))
    located = cut_lineage(spark, df.withColumns({"_x": x, "_y": y}))
    known = "latitude IS NOT NULL AND longitude IS NOT NULL"
    points = cut_lineage(spark, positives.where(known).select(x.alias("_px"), y.alias("_py")).distinct())
    places = located.where(known).select("_x", "_y").distinct()

    # the diagonal of such a square is shorter than the distance
    side, on_plane = metres / 1.5, F.lit(float("inf"))
    square = lambda a, b: (F.when(F.abs(c) < on_plane, bucket_of(c, side)).alias(n) for c, n in ((F.col(a), "_i"), (F.col(b), "_j")))
    held = points.select(*square("_px", "_py")).distinct().withColumn("_held", F.lit(True))
    first = cut_lineage(spark, places.select("_x", "_y", *square("_x", "_y")).join(held, ["_i", "_j"], "left").select("_x", "_y", "_held"))
    near, step = [first.where("_held").select("_x", "_y")], metres
    # candidates meet the squares of their own and the eight neighbouring buckets
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    open_pairs = (
        spread(spark, first.where("_held IS NULL").select("_x", "_y"), _PLACES_AT_ONCE)
        .withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
        .select("_x", "_y", (bucket_of(F.col("_x"), step) + F.col("_dx")).alias("_i"), (bucket_of(F.col("_y"), step) + F.col("_dy")).alias("_j"))
    )
    for split in _SPLITS:
        inner = step / split
        squares = points.select(
            bucket_of(F.col("_px"), step).alias("_i"), bucket_of(F.col("_py"), step).alias("_j"),
            bucket_of(F.col("_px"), inner).alias("_k"), bucket_of(F.col("_py"), inner).alias("_l"),
        ).distinct()
        across, along = _square_reach(F.col("_x"), F.col("_k"), inner), _square_reach(F.col("_y"), F.col("_l"), inner)
        touched = open_pairs.join(squares, ["_i", "_j"]).select(
            "_x", "_y", F.col("_k").alias("_i"), F.col("_l").alias("_j"),
            (across[0] + along[0]).alias("_lo"), (across[1] + along[1]).alias("_hi"),
        ).where(F.col("_lo") <= metres * metres)
        touched = cut_lineage(spark, touched.select("_x", "_y", "_i", "_j", (F.col("_hi") <= metres * metres).alias("_sure")))
        settled = touched.where("_sure").select("_x", "_y").distinct()
        near.append(settled)
        open_pairs = touched.where("NOT _sure").join(settled, ["_x", "_y"], "left_anti").select("_x", "_y", "_i", "_j")
        step = inner
    last = points.withColumns({"_i": bucket_of(F.col("_px"), step), "_j": bucket_of(F.col("_py"), step)})
    apart = F.pow(F.col("_x") - F.col("_px"), 2.0) + F.pow(F.col("_y") - F.col("_py"), 2.0)
    near.append(open_pairs.join(last, ["_i", "_j"]).where(apart <= metres * metres).select("_x", "_y").distinct())
    excluded = reduce(DataFrame.unionByName, near).distinct()
    return located.join(excluded, ["_x", "_y"], "left_anti").select(*names)


#: Candidate places that one task compares with the squares around them.
_PLACES_AT_ONCE = 50_000
_SPLITS = (16, 16)  # squares per side of the square before


def _square_reach(v, index, size: float):
    """Squared distance along one axis from ``v`` to the nearest and farthest edge of a square, a hair wide for rounding."""
    low, high = index * size, (index + 1) * size
    slack = size * 1e-6
    gap = F.greatest(low - v, v - high, F.lit(0.0))
    far = F.greatest(F.abs(v - low), F.abs(v - high))
    return F.pow(F.greatest(gap - slack, F.lit(0.0)), F.lit(2.0)), F.pow(far + slack, F.lit(2.0))


def polygon_table(polygons: DataFrame) -> DataFrame:
    """Add bounds and planar Web-Mercator area to ``(country_code, ring)`` polygons."""
    ring = F.col("ring")
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    projected = F.transform(
        ring, lambda p: F.struct(*[c.alias(n) for c, n in zip(mercator_xy(p["y"], p["x"]), ("x", "y"))])
    )
    shoelace = F.aggregate(
        F.sequence(F.lit(1), F.size("_q")), F.lit(0.0),
        lambda acc, i: acc + _cross(F.element_at("_q", i), F.element_at("_q", F.when(i == F.size("_q"), F.lit(1)).otherwise(i + 1))),
    )
    return (
        polygons.withColumns({
            "x_min": F.array_min(xs), "x_max": F.array_max(xs),
            "y_min": F.array_min(ys), "y_max": F.array_max(ys),
            "_q": projected,
        })
        .withColumn("area", F.abs(shoelace) / 2.0)
        .drop("_q")
    )


def _cross(a, b):
    return a["x"] * b["y"] - b["x"] * a["y"]


def _uniform(column: str, seed: int):
    """Repeatable uniform number in [0, 1) for a row number: the first 13 hex digits of a digest."""
    digits = F.substring(F.md5(F.concat(F.col(column).cast("string"), F.lit(f"|{seed}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _gather(draw: Callable[[int, int], DataFrame], wanted: int, start: int, give_up: int) -> tuple[list[DataFrame], int, int]:
    """Rounds of accepted candidates until ``wanted``; each round's size follows the rate of acceptance so far.

    Each round is written once. Ends early only if ``give_up`` candidates in a row brought nothing. Returns the rounds, the number
    accepted and the next candidate number.
    """
    rounds, have, first, barren, size = [], 0, start, 0, 2 * wanted + 64
    while have < wanted and barren < give_up:
        points = draw(start, start + size)
        points = cut_lineage(points.sparkSession, points)
        got, start = points.count(), start + size
        barren = 0 if got else barren + size
        have += got
        rounds.append(points)
        rate = have / (start - first)
        size = int((wanted - have) / rate * 1.1) + 64 if rate else 4 * size
    return rounds, have, start


def negatives_spatial(
    positives: DataFrame, polygons: DataFrame, ratio: float = 1.0, seed: int = K.SEED,
    metres: float = K.NEGATIVE_EXCLUSION_M, give_up: int = 200_000,
) -> DataFrame:
    """Area-weighted random points in the positives' countries, none near a positive.

    All polygons serve, each as likely as the next, if no positive names a known country or the
    named ones have no room left. Points are drawn as rows, in rounds, until ``ratio`` times the
    number of positives have been accepted. ``give_up`` candidates in a row without one count as no room; if no polygon
    has any, a ValueError says how many were found. Runs jobs at once; only counts and the total weight reach the driver.
    """
    wanted = int(positives.count() * ratio)
    world = polygon_table(polygons).where((F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min")))
    tables = [world.withColumn("area", F.lit(1.0))]
    if "country_code" in positives.columns:
        codes = positives.select(F.upper("country_code").alias("country_code")).where("country_code IS NOT NULL").distinct()
        home = world.join(codes, "country_code", "left_semi")
        tables.insert(0, world if home.isEmpty() else home)
    else:
        tables.insert(0, world)

    rounds, have, start = [], 0, 0
    for table in tables:
        line, total, step = _weighted_line(table)
        if total and have < wanted:
            draw = lambda a, b: exclude_within(_draw(line, total, step, a, b, seed), positives, metres)  # noqa: B023, E731
            more, got, start = _gather(draw, wanted - have, start, give_up)
            rounds, have = rounds + more, have + got
    if have < wanted:
        raise ValueError(f"room for only {have} of {wanted} negatives farther than {metres} m from all positives ({start} candidates drawn)")
    if not rounds:
        return _as_negatives(_draw(*_weighted_line(world), 0, 0, seed))
    return _as_negatives(_first(reduce(DataFrame.unionByName, rounds), wanted))


def _weighted_line(table: DataFrame):
    """Polygons laid end to end by weight, keyed by the slots each stretch touches.

    Polygons are a look-up table of a few hundred rows, so one running sum places them.
    """
    order = Window.orderBy("country_code", "x_min", "y_min", F.size("ring"))
    total = table.agg(F.sum("area")).first()[0] or 0.0
    step = total / 1024 or 1.0
    line = table.withColumn("_to", F.sum("area").over(order)).withColumn("_from", F.col("_to") - F.col("area"))
    slots = F.sequence(F.floor(F.col("_from") / step), F.floor(F.col("_to") / step))
    return cut_lineage(table.sparkSession, line.withColumn("_slot", F.explode(slots))), total, step


def _draw(line: DataFrame, total: float, step: float, start: int, end: int, seed: int) -> DataFrame:
    """One point per candidate number, in the polygon its number falls on; points outside the polygon go."""
    return (
        line.sparkSession.range(start, end).withColumnRenamed("id", "candidate")
        .withColumn("_at", _uniform("candidate", seed) * total)
        .withColumn("_slot", F.floor(F.col("_at") / step))
        .join(line, "_slot")
        .where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
        .withColumns({
            "longitude": F.col("x_min") + _uniform("candidate", seed + 1) * (F.col("x_max") - F.col("x_min")),
            "latitude": F.col("y_min") + _uniform("candidate", seed + 2) * (F.col("y_max") - F.col("y_min")),
        })
        .where(point_in_ring(F.col("longitude"), F.col("latitude"), F.col("ring")))
        .select("candidate", "latitude", "longitude", "country_code")
    )


def _first(points: DataFrame, n: int) -> DataFrame:
    """The ``n`` lowest candidate numbers, without gathering them in one task."""
    numbered = running_totals(points.withColumn("one", F.lit(1)), "candidate", ["one"])
    return numbered.where(F.col("one_before") < n).select(*points.columns)


def negatives_bbox(
    positives: DataFrame, polygons: DataFrame, ratio: float = 1.5, seed: int = K.SEED, give_up: int = 1_000_000
) -> DataFrame:
    """Uniform points over the polygons' joint box, kept if inside one; exactly ``ratio`` times the positives.

    Drawn in rounds until enough lie inside; ``give_up`` candidates in a row outside raise a ValueError. Runs jobs at once.
    """
    spark = positives.sparkSession
    wanted = int(positives.count() * ratio)
    table = polygon_table(polygons)
    box = table.agg(F.struct(
        F.min("x_min").alias("x0"), F.max("x_max").alias("x1"), F.min("y_min").alias("y0"), F.max("y_max").alias("y1"),
    )).scalar()
    step = 5.0
    tiles = table.select(
        "country_code", "ring", "x_min", "x_max", "y_min", "y_max",
        F.explode(F.sequence(bucket_of(F.col("x_min"), step), bucket_of(F.col("x_max"), step))).alias("_bx"),
    ).withColumn("_by", F.explode(F.sequence(bucket_of(F.col("y_min"), step), bucket_of(F.col("y_max"), step))))

    def draw(start, end):
        drawn = (
            spark.range(start, end).withColumnRenamed("id", "candidate").withColumn("_box", box)
            .withColumns({
                "longitude": F.col("_box.x0") + _uniform("candidate", seed) * (F.col("_box.x1") - F.col("_box.x0")),
                "latitude": F.col("_box.y0") + _uniform("candidate", seed + 1) * (F.col("_box.y1") - F.col("_box.y0")),
            })
            .withColumns({"_bx": bucket_of(F.col("longitude"), step), "_by": bucket_of(F.col("latitude"), step)})
        )
        inside = drawn.join(tiles, ["_bx", "_by"]).where(
            F.col("longitude").between(F.col("x_min"), F.col("x_max"))
            & F.col("latitude").between(F.col("y_min"), F.col("y_max"))
            & point_in_ring(F.col("longitude"), F.col("latitude"), F.col("ring"))
        )
        return inside.groupBy("candidate", "latitude", "longitude").agg(F.min("country_code").alias("country_code"))

    rounds, have, start = _gather(draw, wanted, 0, give_up)
    if have < wanted:
        raise ValueError(f"only {have} of {wanted} negatives lie inside the polygons ({start} candidates drawn)")
    if not rounds:
        return _as_negatives(draw(0, 0))
    return _as_negatives(_first(reduce(DataFrame.unionByName, rounds), wanted))


def _as_negatives(points: DataFrame) -> DataFrame:
    return points.select(
        "candidate", "latitude", "longitude", "country_code",
        F.lit(None).cast("date").alias("flood_start_date"), F.lit(0).alias("target"),
    )
