"""Checks of trajectories, targets and records: a column for each rule, or the rows that break one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.functions import geometry as geo

from .runs import series


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")), F.lit(False))


def trajectory_rules(df: DataFrame, by: list[str], order: str, ts: str, state: str, valid: str, values: list[str], quaternion: list[str] | None = None) -> DataFrame:
    """Per series: increasing (finite times that rise), binary_state, finite and unit (on valid rows), n_rows.

    A quaternion's length may differ from 1 by 1e-3 + 1e-5.
    """
    stepped = df.withColumn("_t", F.lag(ts).over(series(by, order)))
    rises = finite(F.col(ts)) & (F.col("_t").isNull() | (F.col(ts) > F.col("_t")))
    good = F.lit(True)
    for v in [*values, *(quaternion or [])]:
        good = good & finite(F.col(v))
    unit = F.abs(geo.norm(tuple(F.col(q) for q in quaternion)) - 1) <= 1e-3 + 1e-5 if quaternion else F.lit(True)
    every = lambda c: F.every(F.coalesce(c, F.lit(False)))
    return stepped.groupBy(*by).agg(every(rises).alias("increasing"), every(F.col(state).isin(0, 1)).alias("binary_state"), every(~F.col(valid) | good).alias("finite"), every(~F.col(valid) | unit).alias("unit"), F.count(F.lit(1)).alias("n_rows"))


def bounded_joints(joints: Column, low: list[float], high: list[float], tolerance: float) -> Column:
    """Joint values clipped to their range; a value beyond it by more than the tolerance, or none, is an error."""
    out = []
    for k, (a, b) in enumerate(zip(low, high, strict=True)):
        q = F.get(joints, k)
        inside = finite(q) & q.between(a - tolerance, b + tolerance)
        out.append(F.when(inside, F.greatest(F.lit(a), F.least(F.lit(b), q))).otherwise(F.raise_error(F.concat(F.lit(f"joint {k + 1} out of range: "), F.coalesce(q.cast("string"), F.lit("null")))).cast("double")))
    return F.array(*out)


def joint_faults(joints: Column, before: Column, low: list[float], high: list[float], most_step: float) -> Column:
    """Why a joint solution can't be taken (not finite, outside the range, too far from the one before), else null."""
    n = range(len(low))
    each = lambda rule: F.forall(F.array(*[F.coalesce(rule(k), F.lit(False)) for k in n]), lambda x: x)
    known = each(lambda k: finite(F.get(joints, k)))
    inside = each(lambda k: F.get(joints, k).between(low[k], high[k]))
    step = F.greatest(*[F.abs(F.get(joints, k) - F.get(before, k)) for k in n], F.lit(0.0))
    return F.when(~known, "not finite").when(~inside, "out of range").when(step > most_step + 1e-12, "step too large")


def step_faults(df: DataFrame, by: list[str], order: str, position: list[str], quaternion: list[str], most: float, most_degrees: float) -> DataFrame:
    """df with too_far and too_turned against the row before, null on a series' first row."""
    w = series(by, order)
    step = geo.norm(tuple(F.col(c) - F.lag(c).over(w) for c in position))
    angle = geo.angle_degrees(tuple(F.col(c) for c in quaternion), tuple(F.lag(c).over(w) for c in quaternion))
    return df.withColumns({"too_far": step > most + 1e-12, "too_turned": angle > most_degrees + 1e-9})


def residual_faults(position: geo.Vector, target: geo.Vector, quaternion: geo.Vector, target_quaternion: geo.Vector, most: float, most_degrees: float) -> Column:
    """Whether a pose misses its target by more than the limits."""
    gap = geo.norm(tuple(a - b for a, b in zip(position, target, strict=True)))
    return (gap > most) | (geo.angle_degrees(quaternion, target_quaternion) > most_degrees)


def workspace_fault(position: geo.Vector, quaternion: geo.Vector, box: list[tuple[float, float]]) -> Column:
    """Why a target can't be taken: not finite, outside the box, a quaternion of length outside 0.9 to 1.1; else null."""
    known = F.lit(True)
    for x in (*position, *quaternion):
        known = known & finite(x)
    fault = F.when(~known, "not finite")
    for x, (a, b), name in zip(position, box, "xyz", strict=True):
        fault = fault.when(~x.between(a, b), f"{name} outside")
    return fault.when(~geo.norm(quaternion).between(0.9, 1.1), "quaternion length")


def gripper_command(share: Column, threshold: float, open_raw: float, closed_raw: float) -> Column:
    """closed_raw over the threshold, else open_raw; a share outside 0 to 1 is an error."""
    return F.when(~F.coalesce(share.between(0.0, 1.0), F.lit(False)), F.raise_error(F.lit("a gripper's share lies between 0 and 1")).cast("double")).when(share > threshold, closed_raw).otherwise(open_raw)


def camera_faults(stamps: DataFrame, by: list[str], role: str, ts: str, now: str, roles: list[str], most_age: float, most_skew: float) -> DataFrame:
    """(by, fault): observations that lack a camera, hold a frame older than most_age, or frames more than most_skew apart; times in seconds."""
    seen = stamps.groupBy(*by).agg(F.count_distinct(F.when(F.col(role).isin(roles), F.col(role))).alias("_n"), F.max(F.col(now) - F.col(ts)).alias("_age"), (F.max(ts) - F.min(ts)).alias("_skew"))
    fault = F.when(F.col("_n") < len(roles), "camera missing").when(F.col("_age") > most_age, "too old").when(F.col("_skew") > most_skew, "skew")
    return seen.select(*by, fault.alias("fault"))


def frame_mismatches(ego: DataFrame, real: DataFrame, side: str, name: str) -> DataFrame:
    """(side, ego name, real name) of sides whose coordinate frames differ; poses of different frames are never compared."""
    one = lambda df, out: df.select(side, F.col(name).alias(out)).distinct()
    return one(ego, "ego_frame").join(one(real, "real_frame"), side).filter(~F.col("ego_frame").eqNullSafe(F.col("real_frame")))


def required(df: DataFrame, ok: Column, message: str, column: str) -> DataFrame:
    """df, failing when read at a row that is not ok; the check rides on `column`."""
    return df.withColumn(column, F.when(F.coalesce(ok, F.lit(False)), F.col(column)).otherwise(F.raise_error(F.lit(message))))


def package_faults(packaged: DataFrame, expected: DataFrame) -> DataFrame:
    """(experiment, variant, episode, fault) of expected episodes whose package is missing or another.

    packaged and expected have experiment, variant, episode, signature, source (a path) and
    fingerprint (sha256 of the source); a null signature or fingerprint on either side is
    not compared.
    """
    key = ["experiment", "variant", "episode"]
    side = lambda df, x: df.select(*key, *[F.col(c).alias(f"{x}_{c}") for c in ("signature", "source", "fingerprint")], F.lit(True).alias(x))
    both = side(expected, "e").join(side(packaged, "p"), key, "left")
    fault = (
        F.when(F.col("p").isNull(), "not packaged").when(F.col("e_signature") != F.col("p_signature"), "another package")
        .when(~F.col("e_source").eqNullSafe(F.col("p_source")), "another source").when(F.col("e_fingerprint") != F.col("p_fingerprint"), "another fingerprint")
    )
    return both.select(*key, fault.alias("fault")).filter("fault is not null")


def complete(status: Column, signature: Column, wanted: Column, files: Column) -> Column:
    """A record is complete if its status says so, its signature is the wanted one and none of its files is missing."""
    return F.coalesce((status == "complete") & (signature == wanted) & F.forall(files, lambda x: x), F.lit(False))
