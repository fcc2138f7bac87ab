"""Filling, shifting, thinning and resampling of ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionloom.functions import geometry as geo

from .runs import series, whole


def _around(df: DataFrame, by: list[str], order: list[Column], back: list[Column], row: Column, before: str, after: str) -> DataFrame:
    """df with the last row known up to each one, and the first known from it on.

    Either window only ever grows at its current row (the second one runs backwards), so
    both cost one pass over a series, however long it is.
    """
    return df.withColumns({
        before: F.last(row, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)),
        after: F.last(row, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*back).rowsBetween(Window.unboundedPreceding, 0)),
    })


def carried(df: DataFrame, by: list[str], order: str, value: str, default: object) -> DataFrame:
    """Nulls take the last value seen, `default` before the first."""
    return df.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(series(by, order)), F.lit(default)))


def filled_both_ways(df: DataFrame, by: list[str], order: str, value: str, default: object) -> DataFrame:
    """Nulls take the last value seen, leading ones the first to come; `default` where there is none."""
    before = F.last(value, ignorenulls=True).over(series(by, order))
    first = F.first(value, ignorenulls=True).over(whole(by, order))
    return df.withColumn(value, F.coalesce(before, first, F.lit(default)))


def next_row(df: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """The next row's value; the last row repeats its own."""
    return df.withColumn(out, F.coalesce(F.lead(value).over(series(by, order)), F.col(value)))


def consecutive_valid(df: DataFrame, by: list[str], order: str, valid: str) -> DataFrame:
    """Rows that are valid and followed by a valid one; never the last row."""
    follows = F.coalesce(F.lead(valid).over(series(by, order)), F.lit(False))
    return df.withColumn("_next", follows).filter(F.col(valid) & F.col("_next")).drop("_next")


def interpolated(df: DataFrame, by: list[str], order: str, value: str, most: int | None = None, hold_ends: bool = False) -> DataFrame:
    """Nulls between known values become linear in `order`, for gaps of up to `most` rows."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("x"), F.col(value).alias("y")))
    df = _around(df, by, [F.col(order)], [F.desc(order)], known, "_p", "_n")
    between = F.col("_p.y") + (F.col("_n.y") - F.col("_p.y")) * (F.col(order) - F.col("_p.x")) / (F.col("_n.x") - F.col("_p.x"))
    short = F.lit(True) if most is None else (F.col("_n.x") - F.col("_p.x") - 1 <= most)
    ends = F.coalesce("_p.y", "_n.y") if hold_ends else F.lit(None).cast("double")
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_p").isNotNull() & F.col("_n").isNotNull(), F.when(short, between)).otherwise(ends)
    return df.withColumn(value, filled).drop("_p", "_n")


def _mixed(share: Column, linear: list[str], quaternions: list[list[str]], nearest: list[str]) -> dict[str, Column]:
    """Columns between the rows _p and _n: linear, along the shorter arc, or the nearer row's (the left one before the middle)."""
    out = {c: F.col(f"_p.{c}") + share * (F.col(f"_n.{c}") - F.col(f"_p.{c}")) for c in linear}
    for q in quaternions:
        out |= dict(zip(q, geo.slerp(tuple(F.col(f"_p.{c}") for c in q), tuple(F.col(f"_n.{c}") for c in q), share), strict=True))
    return out | {c: F.when(share < 0.5, F.col(f"_p.{c}")).otherwise(F.col(f"_n.{c}")) for c in nearest}


def bridged(df: DataFrame, by: list[str], order: str, valid: str, most: int, linear: list[str], quaternions: list[list[str]] = (), left: list[str] = ()) -> DataFrame:
    """Invalid rows in gaps of up to `most` rows between valid ones take poses between these, and become valid.

    Positions are linear in `order`, rotations on the shorter arc, and columns of `left`
    those of the row before the gap. All other rows stay as they are.
    """
    columns = [*linear, *[c for q in quaternions for c in q], *left]
    row = F.when(F.col(valid), F.struct(F.col(order).alias("at"), *columns))
    met = _around(df, by, [F.col(order)], [F.desc(order)], row, "_p", "_n")
    share = (F.col(order) - F.col("_p.at")) / (F.col("_n.at") - F.col("_p.at"))
    gap = F.coalesce(~F.col(valid) & (F.col("_n.at") - F.col("_p.at") - 1 <= most), F.lit(False))
    new = _mixed(share, list(linear), list(quaternions), []) | {c: F.col(f"_p.{c}") for c in left}
    return met.withColumn("_gap", gap).withColumns({c: F.when(F.col("_gap"), v).otherwise(F.col(c)) for c, v in new.items()} | {valid: F.col(valid) | F.col("_gap")}).drop("_p", "_n", "_gap")


def picks(n: Column, count: int) -> Column:
    """The row numbers rint(linspace(0, n - 1, count)) without repeats, half to even."""
    at = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(i * (n - 1) / F.lit(max(1, count - 1))).cast("long"))
    return F.array_distinct(at)


def thinned(df: DataFrame, by: list[str], order: str, count: int) -> DataFrame:
    """Up to `count` rows of every series, evenly spread, both ends included."""
    w = series(by, order)
    placed = df.withColumns({"_k": (F.row_number().over(w) - 1).cast("long"), "_n": F.count(F.lit(1)).over(whole(by, order))})
    return placed.filter(F.array_contains(picks(F.col("_n"), count), F.col("_k"))).drop("_k", "_n")


def target_times(df: DataFrame, by: list[str], ts: str, count: int | None = 200, rate: float | None = None) -> DataFrame:
    """(by, sample, t): an even grid over each series, of `count` times or, if given, of about `rate` a second.

    A series without duration is an error, and so are a count below two and a rate that is not positive.
    """
    if rate is not None and rate <= 0 or rate is None and (count or 0) < 2:
        raise ValueError("a rate must be positive, a count two or more")
    ends = df.groupBy(*by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    many = F.greatest(F.lit(2), (F.rint((F.col("_b") - F.col("_a")) * rate) + 1).cast("int")) if rate is not None else F.lit(count)
    some = F.when(F.col("_b") > F.col("_a"), many).otherwise(F.raise_error(F.lit("a series without duration has no grid")).cast("int"))
    grid = ends.withColumn("_many", some).select(*by, "_a", "_b", "_many", F.explode(F.sequence(F.lit(0), F.col("_many") - 1)).alias("_k"))
    step = (F.col("_b") - F.col("_a")) / (F.col("_many") - 1)
    target = F.when(F.col("_k") == F.col("_many") - 1, F.col("_b")).otherwise(F.col("_a") + F.col("_k") * step)
    return grid.select(*by, F.col("_k").cast("long").alias("sample"), target.alias("t"))


def resampled(df: DataFrame, by: list[str], ts: str, valid: str, max_gap: float, count: int | None = 200, rate: float | None = None, linear: list[str] = (), quaternions: list[list[str]] = (), nearest: list[str] = ()) -> DataFrame:
    """(by, sample, t, the columns, valid): each series on an even grid of times.

    A target takes the row at its time, or the next one within 1e-10 + 1e-5 * |t|. Else
    both neighbouring rows must be valid and max_gap apart at most; columns are then linear,
    quaternions (lists of four columns) on the shorter arc, or those of the nearer row, the
    left one before the middle. Neighbours are rows as they stand: an invalid one is not
    skipped, and leaves nulls. Found by a union with the grid and two windows, so no row
    meets more than its own series.
    """
    columns = [*linear, *[c for q in quaternions for c in q], *nearest]
    row = F.struct(F.col(ts).alias("at"), F.col(valid).alias("ok"), *columns)
    rows = df.select(*by, F.lit(None).cast("long").alias("sample"), F.col(ts).alias("t"), row.alias("_r"))
    grid = target_times(df, by, ts, count, rate)
    both = rows.unionByName(grid.withColumn("_r", F.lit(None).cast(rows.schema["_r"].dataType)))
    on_grid = F.col("sample").isNotNull()
    met = _around(both, by, [F.col("t"), on_grid], [F.desc("t"), F.desc(on_grid.cast("int"))], F.col("_r"), "_p", "_n").filter(on_grid)
    # _p is at the target or before it, _n after it
    close = F.abs(F.col("_n.at") - F.col("t")) <= 1e-10 + 1e-5 * F.abs(F.col("t"))
    hit = F.when(F.col("_p.at") == F.col("t"), F.col("_p")).when(close, F.col("_n"))
    met = met.withColumn("_e", hit)
    share = (F.col("t") - F.col("_p.at")) / (F.col("_n.at") - F.col("_p.at"))
    usable = F.coalesce(F.col("_p.ok") & F.col("_n.ok") & (F.col("_n.at") - F.col("_p.at") <= max_gap), F.lit(False))
    ok = F.when(F.col("_e").isNotNull(), F.col("_e.ok")).otherwise(usable)
    mixed = _mixed(share, list(linear), list(quaternions), list(nearest))
    return met.withColumn("_ok", ok).select(*by, "sample", "t", *[F.when(F.col("_ok"), F.when(F.col("_e").isNotNull(), F.col(f"_e.{c}")).otherwise(v)).alias(c) for c, v in mixed.items()], F.col("_ok").alias(valid))


def densified(df: DataFrame, by: list[str], order: str, ts: str, value: str, rate: float, speed: float, most: float) -> DataFrame:
    """Commands between successive rows, enough that neither time (over speed) nor value (over most) runs too fast."""
    w = series(by, order)
    stepped = df.withColumns({"_v": F.lag(value).over(w), "_t": F.lag(ts).over(w)}).filter(F.col("_v").isNotNull())
    need = F.greatest((F.col(ts) - F.col("_t")) / speed, F.abs(F.col(value) - F.col("_v")) / most) * rate
    steps = F.greatest(F.lit(1), F.ceil(need)).cast("int")
    rows = stepped.withColumn("_n", steps).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return rows.select(*by, order, F.col("step").cast("long").alias("step"), (F.col("_v") + (F.col(value) - F.col("_v")) * F.col("step") / F.col("_n")).alias("command"))


def uninterrupted_signs(df: DataFrame, by: list[str], order: str, parts: list[str]) -> DataFrame:
    """Quaternions normalised and flipped where they oppose the one before; parity of negative products."""
    w = series(by, order)
    norm = F.sqrt(sum((F.col(p) * F.col(p) for p in parts[1:]), F.col(parts[0]) * F.col(parts[0])))
    unit = df.withColumn("_norm", norm).withColumns({p: F.col(p) / F.col("_norm") for p in parts}).drop("_norm")
    dot = sum((F.col(p) * F.lag(p).over(w) for p in parts[1:]), F.col(parts[0]) * F.lag(parts[0]).over(w))
    unit = unit.withColumn("_dot", dot).withColumn("_part", F.sum(F.when(F.col("_dot") == 0, 1).otherwise(0)).over(w))
    inside = Window.partitionBy(*by, "_part").orderBy(order)
    flips = F.sum(F.when(F.col("_dot") < 0, 1).otherwise(0)).over(inside)
    sign = F.when(F.pmod("_flips", F.lit(2)) == 1, -1.0).otherwise(1.0)
    return unit.withColumn("_flips", flips).withColumns({p: F.col(p) * sign for p in parts}).drop("_dot", "_part", "_flips")


def rebased(df: DataFrame, by: list[str], order: str, ts: str, fps: float, out: str = "t") -> DataFrame:
    """Seconds from a series' first row; nanoseconds if the median step is over 1000; index / fps if a time is missing."""
    every = whole(by, order)
    known = F.min(F.col(ts).isNotNull()).over(every)
    stepped = df.withColumn("_step", F.col(ts) - F.lag(ts).over(series(by, order)))
    unit = F.when(F.coalesce(F.expr("percentile(_step, 0.5)").over(Window.partitionBy(*by)), F.lit(0.0)) > 1e3, 1e-9).otherwise(1.0)
    seconds = (F.col(ts) - F.first(ts).over(every)) * unit
    return stepped.withColumn(out, F.when(known, seconds).otherwise((F.row_number().over(series(by, order)) - 1) / F.lit(fps))).drop("_step")


def resolved_times(df: DataFrame, by: list[str], order: str, seconds: str, ts: str, fps: str, out: str = "t") -> DataFrame:
    """Times of each series: its seconds if all rows have them; else ts from the first row (nanoseconds if
    the median step is over 1000), if all rows have it; else the row's number over fps, which must be positive.
    """
    every = whole(by, order)
    all_ = lambda c: F.min(F.col(c).isNotNull()).over(every)
    stepped = df.withColumn("_step", F.col(ts) - F.lag(ts).over(series(by, order)))
    middle = F.expr("percentile(_step, 0.5)").over(Window.partitionBy(*by))
    unit = F.when(F.coalesce(middle, F.lit(0.0)) > 1e3, 1e-9).otherwise(1.0)
    rate = F.when(F.col(fps) > 0, F.col(fps)).otherwise(F.raise_error(F.lit("fps must be positive")).cast("double"))
    at = (F.row_number().over(series(by, order)) - 1) / rate
    found = F.when(rate.isNotNull() & all_(seconds), F.col(seconds)).when(all_(ts), (F.col(ts) - F.first(ts).over(every)) * unit).otherwise(at)
    return stepped.withColumn(out, found).drop("_step")


def trimmed(df: DataFrame, by: list[str], order: str, start_seconds: float, end_seconds: float, fps: float, strict: bool = False) -> DataFrame:
    """Rows left after round(seconds * fps) rows, half to even, are cut from either end.

    A series of which nothing is left is an error if strict, else it has no rows.
    """
    w, n = series(by, order), F.count(F.lit(1)).over(whole(by, order))
    at = F.row_number().over(w) - 1
    a, b = round(start_seconds * fps), round(end_seconds * fps)
    if strict:
        n = F.when(n > a + b, n).otherwise(F.raise_error(F.concat(F.lit("nothing is left of a series of rows: "), n.cast("string"))).cast("long"))
    return df.withColumns({"_at": at, "_n": n}).filter((F.col("_at") >= a) & (F.col("_at") < F.col("_n") - b)).drop("_at", "_n")


def grasp_series(df: DataFrame, by: list[str], order: str, ns: str, valid: str, columns: list[str], fps: float) -> DataFrame:
    """df with t, and the columns null on rows that are not valid.

    t is in seconds from the first row's nanoseconds, or the row's number over fps if one
    is missing or all are equal.
    """
    every = whole(by, order)
    timed = F.min(F.col(ns).isNotNull()).over(every) & (F.max(ns).over(every) > F.min(ns).over(every))
    at = (F.row_number().over(series(by, order)) - 1) / F.lit(fps)
    found = df.withColumn("t", F.when(timed, (F.col(ns) - F.first(ns).over(every)) * 1e-9).otherwise(at))
    return found.withColumns({c: F.when(F.col(valid), F.col(c)) for c in columns})
