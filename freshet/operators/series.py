"""Time series of readings: anomalies and lagged correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import discard, staged

DAY_SECONDS = 86_400
#: Parts of a slice of the rolling anomaly, so that one series within one window is many tasks.
PARTS = 64
#: Rows of a slice from which it is cut into parts.
PART_ROWS = 1_000_000
#: Slots of a block of the lagged correlation.
BLOCK_SLOTS = 1024
#: Lags up to which the lagged correlation is a join of slots.
FEW_LAGS = 8


def rolling_anomaly(
    readings: DataFrame,
    window_seconds: int = DAY_SECONDS,
    threshold: float = 3.0,
    key: str = "notation",
    moment: str = "r_datetime",
    value: str = "value",
    parts: int = PARTS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Mean, deviation and z-score of the preceding ``window_seconds``, and whether it is anomalous.

    A series is cut into slices as long as the window, and a row is also given to the
    next slice as history. Within a slice rows enter at their moment and leave a window
    later; both kinds of events in order of time give running sums, so the work grows as
    n log n however many rows a window holds. A slice of over ``part_rows`` rows, and the
    next one, are cut once more into ``parts``: the totals of the parts, which partial
    aggregates make, are summed up first, and a task adds the running sums of one part to
    what came before it. So a series of any rate is many tasks, and others cost no more.

    Values are centred on the slice's mean, and what is left of a variance by rounding
    counts as none. Null values count for nothing; a window that holds a NaN or an
    infinity has no finite mean.
    """
    micros = F.unix_micros(F.col(moment).cast("timestamp"))
    length = window_seconds * 1_000_000
    start = F.col("_at") - F.pmod("_at", F.lit(length))
    timed = readings.where(F.col(moment).isNotNull()).withColumn("_at", micros)
    number = F.col(value).cast("double")
    finite = F.coalesce(F.abs(number) < float("inf"), F.lit(False))
    # an event: the slice it counts in, when, and whether the row enters (1) or leaves (-1)
    event = lambda step, later, sign: F.struct(
        (start + step * length).alias("slice"), (F.col("_at") + later).alias("when"), F.lit(sign).alias("sign"))
    events = timed.withColumn("_event", F.explode(F.array(event(0, 0, 1), event(1, 0, 1), event(1, length, -1))))
    events = events.withColumns({"_slice": F.col("_event.slice"), "_when": F.col("_event.when"), "_sign": F.col("_event.sign")})
    # a struct is never null, so series without a key are found by plain equality
    name = F.struct(F.col(key).alias("k")).alias("_key")
    full = timed.groupBy(name, start.alias("s")).agg(F.count("*").alias("c")).where(F.col("c") > part_rows)
    full = full.select("_key", F.explode(F.array("s", F.col("s") + length)).alias("_slice")).distinct().withColumn("_full", F.lit(True))
    full = staged(full, "full_slices")
    events = events.select("*", name)
    if full.isEmpty():
        discard(full)
        events = events.withColumns({"_part": F.lit(0), **{c: F.lit(None).cast("double") for c in ("_mean", "_n0", "_odd0", "_sum0", "_squares0")}})
    else:
        part = F.floor((F.col("_when") - F.col("_slice")) / max(1, length // parts)).cast("int")
        events = events.join(full, ["_key", "_slice"], "left").withColumn("_part", F.when(F.col("_full"), part).otherwise(0))
        offsets = staged(_offsets(events.where("_full"), number, finite), "offsets")
        # dealt out by the parts, whichever way the totals were joined
        events = events.join(offsets, ["_key", "_slice", "_part"], "left").repartition("_key", "_slice", "_part")
    own_centre = F.avg(F.when(finite, number)).over(Window.partitionBy("_key", "_slice", "_part"))
    events = events.withColumn("_centre", F.coalesce("_mean", own_centre, F.lit(0.0)))
    before = Window.partitionBy("_key", "_slice", "_part").orderBy("_when").rangeBetween(Window.unboundedPreceding, -1)
    own = (F.col("_sign") == 1) & (F.col("_slice") == start)
    part = F.when(finite, number - F.col("_centre")).otherwise(0.0)
    total = lambda x, offset: F.coalesce(F.sum(F.col("_sign") * x).over(before), F.lit(0)) + F.coalesce(F.col(offset), F.lit(0))
    scored = events.withColumns(
        {
            "n_before": total(number.isNotNull().cast("long"), "_n0").cast("long"),
            "_odd": total((number.isNotNull() & ~finite).cast("long"), "_odd0"),
            "_sum": total(part, "_sum0"),
            "_squares": total(part * part, "_squares0"),
        }
    ).where(own)
    count, odd = F.col("n_before"), F.col("_odd") > 0
    spread = F.col("_squares") - F.col("_sum") * F.col("_sum") / count
    spread = F.when(spread > 1e-12 * F.col("_squares"), spread).otherwise(0.0)
    scored = scored.withColumns(
        {
            "mean_before": F.when(odd, float("nan")).when(count > 0, F.col("_centre") + F.col("_sum") / count),
            "stddev_before": F.when(odd, float("nan")).when(count > 1, F.sqrt(spread / (count - 1))),
        }
    )
    z = F.when(F.col("stddev_before") > 0, (number - F.col("mean_before")) / F.col("stddev_before"))
    return scored.withColumn("z_score", z).withColumn("anomalous", F.coalesce(F.abs("z_score") > threshold, F.lit(False))).select(
        *readings.columns, "n_before", "mean_before", "stddev_before", "z_score", "anomalous")


def _offsets(events: DataFrame, number: Column, finite: Column) -> DataFrame:
    """What the parts of a slice before each part add up to, and the slice's mean.

    A part's sums around the slice's mean follow from its own mean and variance.
    """
    of = lambda sign: F.when(F.col("_sign") == sign, F.when(finite, number))
    counted = number.isNotNull().cast("long")
    totals = events.groupBy("_key", "_slice", "_part").agg(
        F.sum(F.col("_sign") * counted).alias("_n"),
        F.sum(F.when(number.isNotNull() & ~finite, F.col("_sign")).otherwise(0)).alias("_odd1"),
        *[f(of(sign)).alias(f"_{name}{side}") for sign, side in ((1, "in"), (-1, "out"))
          for f, name in ((F.count, "n"), (F.avg, "m"), (F.var_pop, "v"))],
    )
    whole = Window.partitionBy("_key", "_slice")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    value = lambda name, side: F.coalesce(F.col(f"_{name}{side}"), F.lit(0.0))
    everything = F.sum(value("n", "in") * value("m", "in") + value("n", "out") * value("m", "out")).over(whole)
    centre = F.coalesce(F.try_divide(everything, F.sum(value("n", "in") + value("n", "out")).over(whole)), F.lit(0.0))
    totals = totals.withColumn("_centre", centre)
    away = lambda side: F.when(F.col(f"_n{side}") > 0, value("m", side) - F.col("_centre")).otherwise(0.0)
    sums = lambda side: value("n", side) * away(side)
    squares = lambda side: value("n", side) * (value("v", side) + away(side) * away(side))
    running = lambda x: F.coalesce(F.sum(x).over(earlier), F.lit(0))
    return totals.select(
        "_key", "_slice", "_part", F.col("_centre").alias("_mean"), running(F.col("_n")).alias("_n0"), running(F.col("_odd1")).alias("_odd0"),
        running(sums("in") - sums("out")).alias("_sum0"), running(squares("in") - squares("out")).alias("_squares0"))


def gridded(
    readings: DataFrame, seconds: int, key: str = "notation", moment: str = "r_datetime", value: str = "value"
) -> DataFrame:
    """``(key, slot, mean)``: the mean of each period of ``seconds``."""
    slot = F.floor(F.unix_seconds(F.col(moment).cast("timestamp")) / seconds).cast("long")
    return (
        readings.where(F.col(value).isNotNull() & F.col(moment).isNotNull())
        .groupBy(key, slot.alias("slot"))
        .agg(F.avg(F.col(value).cast("double")).alias("mean"))
    )


def lag_correlation(
    grid: DataFrame, pairs: DataFrame, max_lag: int, key: str = "notation", min_slots: int = 1, block_slots: int = BLOCK_SLOTS
) -> DataFrame:
    """Correlation of each ``(left, right)`` pair at lags of -``max_lag`` to ``max_lag`` slots.

    A positive lag compares the left series with later values of the right one.
    The correlation is null where a series does not vary. Lags at which the two share
    fewer than ``min_slots`` slots are left out; by default none is.

    A series becomes one array for each block of slots; those of right series also hold
    the ``max_lag`` slots on both sides. A pair joins equal blocks, and a task takes all
    lags of a pair of blocks at once and adds up sums, so what is shuffled does not grow
    with the number of lags, and no array is longer than a block and its margins. Up to
    ``FEW_LAGS`` lags are rows of a plain join instead, which costs less.
    Values are taken from their series' mean. The grid holds a slot of a series once; a
    slot whose mean is null or NaN counts as absent.
    """
    if 2 * max_lag + 1 <= FEW_LAGS:
        return _few_lags(grid, pairs, max_lag, key, min_slots)
    size = max(block_slots, max_lag, 1)
    known = grid.where(F.col("mean").isNotNull() & ~F.isnan("mean") & F.col("slot").isNotNull() & F.col(key).isNotNull())
    centre = known.groupBy(key).agg(F.avg("mean").alias("_centre"))
    known = known.join(centre, key).select(key, "slot", (F.col("mean") - F.col("_centre")).alias("v"), "mean")
    block = F.floor(F.col("slot") / size).cast("long")
    cells = F.collect_list(F.struct((F.col("slot") - F.col("block") * size).cast("int").alias("at"), "v", "mean")).alias("cells")
    left = known.withColumn("block", block).groupBy(F.col(key).alias("left"), "block").agg(cells.alias("left_cells"))
    # a slot belongs to its block, and to the next ones if it lies within their margin
    around = F.sequence(F.floor((F.col("slot") - max_lag) / size).cast("long"), F.floor((F.col("slot") + max_lag) / size).cast("long"))
    right = known.withColumn("block", F.explode(around)).groupBy(F.col(key).alias("right"), "block").agg(cells.alias("right_cells"))
    wanted = pairs.select("left", "right").distinct()
    # a series joins once per pair it is in; the adaptive skew join divides a hub with many pairs
    blocks = left.join(wanted, "left").join(right, ["right", "block"])
    kinds = dict(blocks.select("left", "right").dtypes)
    sums = blocks.select("left", "right", "left_cells", "right_cells").mapInArrow(
        _lag_sums(max_lag, size), f"left {kinds['left']}, right {kinds['right']}, lag int, n long, "
        + ", ".join(f"{name} double" for name in LAG_SUMS))
    whole = sums.groupBy("left", "right", "lag").agg(
        F.sum("n").alias("n_slots"), *[F.sum(name).alias(name) for name in LAG_SUMS[:5]],
        F.min("least_x").alias("least_x"), F.max("most_x").alias("most_x"), F.min("least_y").alias("least_y"), F.max("most_y").alias("most_y"))
    n = F.col("n_slots")
    moment = lambda xy, x, y: F.col(xy) - F.col(x) * F.col(y) / n
    spread = F.sqrt(F.greatest(moment("xx", "x", "x"), F.lit(0.0))) * F.sqrt(F.greatest(moment("yy", "y", "y"), F.lit(0.0)))
    varies = (F.col("least_x") < F.col("most_x")) & (F.col("least_y") < F.col("most_y"))
    return whole.where(n >= min_slots).select(
        "left", "right", "lag", "n_slots", F.when(varies, F.try_divide(moment("xy", "x", "y"), spread)).alias("correlation"))


def _few_lags(grid: DataFrame, pairs: DataFrame, max_lag: int, key: str, min_slots: int) -> DataFrame:
    """The same with a row for each lag; the slots of a series are spread over the shuffle."""
    grid = grid.where(~F.isnan("mean"))
    left = grid.select(F.col(key).alias("left"), "slot", F.col("mean").alias("left_mean"))
    right = grid.select(F.col(key).alias("right"), F.col("slot").alias("other_slot"), F.col("mean").alias("right_mean"))
    paired = left.join(pairs.select("left", "right").distinct(), "left")
    lagged = (
        paired.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
        .withColumn("other_slot", F.col("slot") + F.col("lag"))
    )
    # corr() fails on a series that does not vary; that has no correlation
    spread = F.stddev_pop("left_mean") * F.stddev_pop("right_mean")
    return (
        lagged.join(right, ["right", "other_slot"])
        .groupBy("left", "right", "lag")
        .agg(
            F.count("*").alias("n_slots"),
            F.try_divide(F.covar_pop("left_mean", "right_mean"), spread).alias("correlation"),
        )
        .where(F.col("n_slots") >= min_slots)
    )


LAG_SUMS = ("x", "y", "xx", "yy", "xy", "least_x", "most_x", "least_y", "most_y")


def _lag_sums(max_lag: int, size: int):
    """Sums of all lags of pairs of blocks, for ``mapInArrow``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def dense(cells, first: int, n: int):
            """Deviations and values by slot; NaN where a slot has none."""
            out = np.full((2, n), np.nan)
            at = cells.field("at").to_numpy() - first
            out[0, at] = cells.field("v").to_numpy()
            out[1, at] = cells.field("mean").to_numpy()
            return out

        lags = np.arange(-max_lag, max_lag + 1)
        for batch in batches:
            for k in range(batch.num_rows):
                x, x_own = dense(batch.column("left_cells")[k].values, 0, size)
                y, y_own = dense(batch.column("right_cells")[k].values, -max_lag, size + 2 * max_lag)
                has = np.flatnonzero(~np.isnan(x))
                x, x_own = x[has], x_own[has]
                rows = []
                for lag in lags:
                    there, own = y[has + lag + max_lag], y_own[has + lag + max_lag]
                    both = ~np.isnan(there)
                    n = int(both.sum())
                    if n:
                        a, b, p, q = x[both], there[both], x_own[both], own[both]
                        rows.append((lag, n, a.sum(), b.sum(), a @ a, b @ b, a @ b, p.min(), p.max(), q.min(), q.max()))
                if rows:
                    times = pa.array(np.full(len(rows), k))
                    columns = [batch.column("left").take(times), batch.column("right").take(times)]
                    values = list(zip(*rows))
                    columns += [pa.array(values[0], pa.int32()), pa.array(values[1], pa.int64())]
                    columns += [pa.array(v, pa.float64()) for v in values[2:]]
                    yield pa.RecordBatch.from_arrays(columns, ["left", "right", "lag", "n", *LAG_SUMS])

    return run


def best_lag(correlations: DataFrame) -> DataFrame:
    """The lag with the strongest correlation of every pair, the smallest lag among equals."""
    strength: Column = F.struct(F.abs("correlation"), -F.abs("lag"), -F.col("lag"))
    return (
        correlations.where(F.col("correlation").isNotNull())
        .groupBy("left", "right")
        .agg(F.max_by(F.struct("lag", "correlation", "n_slots"), strength).alias("_best"))
        .select("left", "right", "_best.*")
    )
