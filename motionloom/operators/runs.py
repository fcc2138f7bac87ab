"""Gaps-and-islands operators over ordered series.

Every function takes a long DataFrame, the columns `by` that name a series and the
column `order` that orders its rows, and uses one window specification per series, so
that chained operators share one sort. Masks are boolean columns without nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from motionloom.functions import geometry as geo


def series(by: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def whole(by: list[str], order: str) -> WindowSpec:
    return series(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def with_runs(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """df with run (from 1), run_length, run_row (from 1) and last_run, for runs of equal value."""
    w = series(by, order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w).cast("long")).drop("_changed")
    inside = Window.partitionBy(*by, "run")
    return numbered.withColumns({
        "run_length": F.count(F.lit(1)).over(inside),
        "run_row": F.row_number().over(inside.orderBy(order)).cast("long"),
        "last_run": F.max("run").over(Window.partitionBy(*by)),
    })


def _without(df: DataFrame) -> DataFrame:
    return df.drop("run", "run_length", "run_row", "last_run")


def run_lengths(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """One row for each run: first, last, length and value."""
    runs = with_runs(df, by, order, value).groupBy(*by, "run")
    return runs.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length"), F.first(value).alias(value))


def fill_short_gaps(df: DataFrame, by: list[str], order: str, mask: str, most: int) -> DataFrame:
    """False runs of up to `most` rows that stand between true ones become true."""
    runs = with_runs(df, by, order, mask)
    short = ~F.col(mask) & (F.col("run_length") <= most) & (F.col("run") > 1) & (F.col("run") < F.col("last_run"))
    return _without(runs.withColumn(mask, F.col(mask) | short))


def drop_short_runs(df: DataFrame, by: list[str], order: str, mask: str, most: int) -> DataFrame:
    """True runs of up to `most` rows become false, at the ends too."""
    runs = with_runs(df, by, order, mask)
    return _without(runs.withColumn(mask, F.col(mask) & (F.col("run_length") > most)))


def stop_mask(df: DataFrame, by: list[str], order: str, v: str, w: str, v_max: float, w_max: float, hold: int, debounce: int) -> DataFrame:
    """stop: slow in both speeds, gaps of up to `debounce` rows closed, runs of `hold` rows or more kept."""
    slow = df.withColumn("stop", F.coalesce((F.col(v) < v_max) & (F.col(w) < w_max), F.lit(False)))
    return drop_short_runs(fill_short_gaps(slow, by, order, "stop", debounce), by, order, "stop", hold - 1)


def closed_mask(df: DataFrame, by: list[str], order: str, mask: str, size: int) -> DataFrame:
    """Morphological closing with a window of `size` rows; rows beyond the ends count as absent."""
    before, after = size // 2, size - 1 - size // 2
    w = series(by, order)
    wide = df.withColumn(mask, F.max(mask).over(w.rowsBetween(-before, after)))
    return wide.withColumn(mask, F.min(mask).over(w.rowsBetween(-after, before)))


def veto_turning(df: DataFrame, by: list[str], order: str, mask: str, yaw: str, least: int, veto: float) -> DataFrame:
    """True runs shorter than `least` rows go, and so do those over which yaw changes by `veto` or more."""
    runs = with_runs(drop_short_runs(df, by, order, mask, least - 1), by, order, mask)
    inside = Window.partitionBy(*by, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = F.abs(F.last(yaw).over(inside) - F.first(yaw).over(inside)) >= veto
    return _without(runs.withColumn(mask, F.col(mask) & ~turned))


def delay_onset(df: DataFrame, by: list[str], order: str, mask: str, rows: int) -> DataFrame:
    """The first rows of every true run become false; none or fewer changes nothing."""
    if rows <= 0:
        return df
    return _without(with_runs(df, by, order, mask).withColumn(mask, F.col(mask) & (F.col("run_row") > rows)))


def median_filter(df: DataFrame, by: list[str], order: str, value: str, size: int) -> DataFrame:
    """Median over an odd window, the series' ends repeated beyond them."""
    half, w = size // 2, series(by, order)
    at, n = F.row_number().over(w), F.count(F.lit(1)).over(whole(by, order))
    inner = F.collect_list(value).over(w.rowsBetween(-half, half))
    first, last = F.first(value).over(whole(by, order)), F.last(value).over(whole(by, order))
    zero = F.lit(0)
    padded = F.concat(F.array_repeat(first, F.greatest(zero, half + 1 - at)), inner, F.array_repeat(last, F.greatest(zero, (at + half - n).cast("int"))))
    return df.withColumn("_padded", padded).withColumn(value, F.sort_array("_padded")[half]).drop("_padded")


def merge_short_runs(df: DataFrame, by: list[str], order: str, value: str, least: int) -> DataFrame:
    """Runs shorter than `least` rows take the next run's value, the last one the previous run's; one pass."""
    runs = with_runs(df, by, order, value)
    heads = runs.groupBy(*by, "run").agg(F.first(value).alias("_own"))
    w = Window.partitionBy(*by).orderBy("run")
    around = heads.withColumn("_other", F.coalesce(F.lead("_own").over(w), F.lag("_own").over(w), F.col("_own"))).drop("_own")
    joined = runs.join(around, [*by, "run"])
    return _without(joined.withColumn(value, F.when(F.col("run_length") < least, F.col("_other")).otherwise(F.col(value))).drop("_other"))


def mark_finish(df: DataFrame, by: list[str], order: str, value: str, rows: int, skip: int = 3, mark: int = 4) -> DataFrame:
    """The last rows of the last run whose value is not `skip` become `mark`."""
    runs = with_runs(df, by, order, value)
    last = F.max(F.when(F.col(value) != skip, F.col("run"))).over(Window.partitionBy(*by))
    tail = (F.col("run") == last) & (F.col("run_length") - F.col("run_row") < rows)
    return _without(runs.withColumn("_last", last).withColumn(value, F.when(tail, F.lit(mark)).otherwise(F.col(value))).drop("_last"))


def longest_run(df: DataFrame, by: list[str], order: str, mask: str) -> DataFrame:
    """The longest true run of every series, the first of equals."""
    runs = run_lengths(df, by, order, mask).filter(F.col(mask))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("length"), "first"))
    return runs.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "run", mask)


def hysteresis(df: DataFrame, by: list[str], order: str, ratio: str, close: float, open_: float, state: str = "state", distance: str | None = None, near: float = 0.105) -> DataFrame:
    """A latch: 1 below `close`, 0 above `open_`, between them and for nulls as before; 0 at first.

    With a column `distance`, a row without ratio is 1 if its distance is below `near`, and
    leaves the latch as it is.
    """
    mark = F.when(F.col(ratio) < close, 1).when(F.col(ratio) > open_, 0)
    latched = F.coalesce(F.last(mark, ignorenulls=True).over(series(by, order)), F.lit(0))
    if distance is not None:
        latched = F.when(F.col(ratio).isNull(), F.coalesce((F.col(distance) < near).cast("int"), F.lit(0))).otherwise(latched)
    return df.withColumn(state, latched)


def bad_streak(df: DataFrame, by: list[str], order: str, bad: str) -> DataFrame:
    """streak: rows since the last good one, 0 on a good one."""
    runs = with_runs(df, by, order, bad)
    return _without(runs.withColumn("streak", F.when(F.col(bad), F.col("run_row")).otherwise(0)))


def modes(df: DataFrame, by: list[str], order: str, stop: str, v: str, w: str, turn: float, slow: float, least: int, filter_size: int = 21, first_forward: int = 80, extend: int = 0) -> DataFrame:
    """mode: 0 stopped, 1 forward, 2 turning; smoothed, short runs merged, a short first advance is a turn.

    With `extend`, each mode reaches that many rows into the next run.
    """
    turning = (F.col(w) >= turn) & (F.col(v) <= 2 * slow)
    raw = df.withColumn("mode", F.when(F.col(stop), 0).when(turning, 2).otherwise(1))
    smooth = merge_short_runs(median_filter(raw, by, order, "mode", filter_size), by, order, "mode", least)
    runs = with_runs(smooth, by, order, "mode")
    first = F.min(F.when(F.col("mode") != 0, F.col("run"))).over(Window.partitionBy(*by))
    runs = runs.withColumn("_first", first)
    early = (F.col("run") == F.col("_first")) & (F.col("mode") == 1) & (F.col("run_length") < first_forward)
    fixed = _without(runs.withColumn("mode", F.when(early, 2).otherwise(F.col("mode"))).drop("_first"))
    if extend > 0:
        runs = with_runs(fixed, by, order, "mode")
        heads = runs.groupBy(*by, "run").agg(F.first("mode").alias("_own"))
        before = heads.withColumn("_before", F.lag("_own").over(Window.partitionBy(*by).orderBy("run"))).drop("_own")
        fixed = _without(runs.join(before, [*by, "run"]).withColumn("mode", F.when((F.col("run") > 1) & (F.col("run_row") <= extend), F.col("_before")).otherwise(F.col("mode"))).drop("_before"))
    return merge_short_runs(median_filter(fixed, by, order, "mode", filter_size), by, order, "mode", least)


def refine_stops(df: DataFrame, by: list[str], order: str, mode: str, hand_speed: str, slow: float, wait: int, margin: int, stop: int = 0, mark: int = 3) -> DataFrame:
    """Within each run of `stop`, rows before the hands first rest and after they last rest become `mark`.

    The hands rest at a row if the mean speed of `wait` rows, from it on (at the run's
    beginning) or up to it (at its end), is below `slow`; a missing speed counts as 99. The
    first and last `margin` rows of the rest become `mark` too. A scan never reaches the
    last, or the first, `wait` rows of a run, and marks all others if it finds no rest.
    """
    runs = with_runs(df, by, order, mode)
    inside = Window.partitionBy(*by, "run")
    at = inside.orderBy(order)
    v = F.coalesce(hand_speed, F.lit(99.0))
    runs = runs.withColumns({"_i": F.col("run_row") - 1, "_ahead": F.avg(v).over(at.rowsBetween(0, wait - 1)), "_back": F.avg(v).over(at.rowsBetween(-(wait - 1), 0))})
    early, late = F.col("_i") < F.col("run_length") - wait, F.col("_i") >= wait
    runs = runs.withColumns({"_first": F.min(F.when(early & (F.col("_ahead") < slow), F.col("_i"))).over(inside), "_last": F.max(F.when(late & (F.col("_back") < slow), F.col("_i"))).over(inside)})
    moving = (early & F.coalesce(F.col("_i") < F.col("_first"), F.lit(True))) | (late & F.coalesce(F.col("_i") > F.col("_last"), F.lit(True)))
    edge = F.coalesce(F.col("_i").between(F.col("_first"), F.col("_first") + (margin - 1)), F.lit(False)) | F.coalesce(F.col("_i").between(F.col("_last") - (margin - 1), F.col("_last")), F.lit(False))
    refined = F.when((F.col(mode) == stop) & (moving | edge), mark).otherwise(F.col(mode))
    return _without(runs.withColumn(mode, refined)).drop("_i", "_ahead", "_back", "_first", "_last")


def phases(df: DataFrame, by: list[str], order: str, v: str, w: str, yaw: str, v_max: float, w_max: float, *, hold: int = 3, debounce: int = 2, least_stop: int = 3, veto: float = 1e9, offset: int = 1, turn: float = 1.0, slow: float = 1.0, least: int = 3, filter_size: int = 5, first_forward: int = 8, extend: int = 0, hand_speed: str | None = None, hand_slow: float = 0.15, wait: int = 5, margin: int = 15, finish: int = 3) -> DataFrame:
    """The whole phase plan as column mode: stops, closing, veto, delay, modes, hands at rest (if hand_speed names their speed), the finished tail."""
    stopped = stop_mask(df, by, order, v, w, v_max, w_max, hold, debounce)
    stopped = veto_turning(closed_mask(stopped, by, order, "stop", debounce), by, order, "stop", yaw, least_stop, veto)
    moded = modes(delay_onset(stopped, by, order, "stop", offset), by, order, "stop", v, w, turn, slow, least, filter_size, first_forward, extend)
    if hand_speed is not None:
        moded = refine_stops(moded, by, order, "mode", hand_speed, hand_slow, wait, margin)
    return mark_finish(moded, by, order, "mode", finish)


def window_median_change(df: DataFrame, by: list[str], order: str, value: str, rows: int) -> DataFrame:
    """jump: the median of this and the next rows less that of the rows before; null near the ends."""
    w, at = series(by, order), F.row_number().over(series(by, order))
    n = F.count(F.lit(1)).over(whole(by, order))
    before = F.expr(f"percentile({value}, 0.5)").over(w.rowsBetween(-rows, -1))
    after = F.expr(f"percentile({value}, 0.5)").over(w.rowsBetween(0, rows - 1))
    return df.withColumn("jump", F.when((at > rows) & (at + rows - 1 <= n), after - before))


def unwrapped(df: DataFrame, by: list[str], order: str, angle: str, out: str = "unwrapped") -> DataFrame:
    """Angles without jumps of more than half a turn; a step of exactly +pi stays."""
    w = series(by, order)
    step = F.col(angle) - F.lag(angle).over(w)
    turns = -F.floor((step + F.pi()) / (2 * F.pi()))
    turns = F.when((step + F.pi() == 2 * F.pi()) | (F.abs(step) < F.pi()), 0).otherwise(turns)
    return df.withColumn("_turns", F.coalesce(turns, F.lit(0))).withColumn(out, F.col(angle) + 2 * F.pi() * F.sum("_turns").over(w)).drop("_turns")


def speed(df: DataFrame, by: list[str], order: str, value: str, dt: Column, valid: str, bridge: bool) -> DataFrame:
    """speed: the step over dt. With bridge from the last valid row whatever the gap; else 0 after a gap."""
    w = series(by, order)
    known = F.when(F.col(valid), F.col(value))
    if bridge:
        last = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("speed", F.when(F.col(valid), F.coalesce((F.col(value) - last) / dt, F.lit(0.0))))
    return df.withColumn("speed", F.when(F.col(valid), F.coalesce((known - F.lag(known).over(w)) / dt, F.lit(0.0))))


def pose_speed(df: DataFrame, by: list[str], order: str, position: list[str], quaternion: list[str], dt: Column, valid: str, bridge: bool) -> DataFrame:
    """linear (a vector) and angular (the rotation's logarithm in the earlier frame) over dt, acceleration of the linear speed.

    With bridge from the last valid row whatever the gap, else zero after a gap; the first
    valid row has zero. acceleration is null on a series' first row and next to a gap.
    """
    w = series(by, order)
    row = F.when(F.col(valid), F.struct(*position, *quaternion))
    before = F.last(row, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if bridge else F.lag(row).over(w)
    met = df.withColumn("_b", before)
    step = tuple((F.col(c) - F.col(f"_b.{c}")) / dt for c in position)
    turn = geo.rotation_vector(geo.quaternion_product(geo.conjugate(tuple(F.col(f"_b.{c}") for c in quaternion)), tuple(F.col(c) for c in quaternion)))
    vector = lambda parts: F.when(F.col(valid), F.array(*[F.coalesce(p, F.lit(0.0)) for p in parts]))
    met = met.withColumns({"linear": vector(step), "angular": vector(tuple(t / dt for t in turn)), "_v": F.when(F.col(valid) & F.col("_b").isNotNull(), geo.norm(step))}).drop("_b")
    return met.withColumn("acceleration", (F.col("_v") - F.lag("_v").over(w)) / dt).drop("_v")


def odometry(df: DataFrame, by: list[str], order: str, ts: str, position: list[str], yaw: str) -> DataFrame:
    """unwrapped (yaw without jumps, from the first row's), speed over ground and yaw_rate; zero on the first row and for a time step of zero."""
    w = series(by, order)
    turned = unwrapped(df, by, order, yaw)
    dt = F.col(ts) - F.lag(ts).over(w)
    step = F.sqrt(sum((F.pow(F.col(c) - F.lag(c).over(w), F.lit(2)) for c in position[1:]), F.pow(F.col(position[0]) - F.lag(position[0]).over(w), F.lit(2))))
    rate = lambda x: F.coalesce(F.when(dt > 0, x / dt), F.lit(0.0))
    found = turned.withColumns({"speed": rate(step), "yaw_rate": rate(F.abs(F.col("unwrapped") - F.lag("unwrapped").over(w)))})
    return found.withColumn("unwrapped", F.col("unwrapped") - F.first("unwrapped").over(w))
