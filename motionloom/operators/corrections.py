"""Corrections of trajectories towards calibrated anchors: where anchors stand, what they are fitted to, how they move a series.

An anchor is an event's ordinal, as text, or `start` or `end`, a series' first or last
valid row. A series that lacks an anchor is left as it is, with a reason.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.functions import geometry as geo

from . import numeric, stats
from .events import health
from .resample import interpolated
from .runs import series, whole


def anchor_id(value: object) -> str:
    """start, end or an ordinal that is not negative, as text."""
    text = str(value).strip().lower()
    if isinstance(value, bool) or text not in ("start", "end") and not text.isdecimal():
        raise ValueError(f"an anchor is start, end or an event's ordinal, not {value!r}")
    return text if text in ("start", "end") else str(int(text))


def anchor_order(anchor: str) -> tuple[int, int]:
    """start first, then events, end last."""
    return {"start": (0, 0), "end": (2, 0)}.get(anchor) or (1, int(anchor))


def anchor_frames(df: DataFrame, events: DataFrame, by: list[str], order: str, valid: str, anchors: list[str]) -> DataFrame:
    """(by, anchor, frame, transition, fault) for each series and anchor."""
    ends = df.groupBy(*by).agg(F.min(F.when(F.col(valid), F.col(order))).alias("_a"), F.max(F.when(F.col(valid), F.col(order))).alias("_b"))
    found = events.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col("ordinal").cast("string"), F.struct(F.col(order).alias("at"), "transition", "ambiguous")))).alias("_events"))
    each = ends.join(found, by, "left").withColumn("anchor", F.explode(F.array(*[F.lit(a) for a in anchors])))
    event = F.try_element_at("_events", F.col("anchor"))
    at = F.when(F.col("anchor") == "start", F.col("_a")).when(F.col("anchor") == "end", F.col("_b")).otherwise(event["at"])
    fault = F.when(F.col("anchor").isin("start", "end"), F.when(F.col("_a").isNull(), "no valid row")).when(event.isNull(), "no such event").when(event["ambiguous"], "ambiguous event")
    return each.select(*by, "anchor", at.alias("frame"), event["transition"].alias("transition"), fault.alias("fault"))


def propagated(df: DataFrame, by: list[str], order: str, columns: list[str], method: str = "linear", **weights: float) -> DataFrame:
    """Columns that hold values at anchors and null elsewhere, carried to all rows; both ends are zero unless they are anchors.

    linear is a window plan; the other methods (see numeric.propagate) solve a system of
    five diagonals for each series.
    """
    if method == "linear":
        w, at = series(by, order), F.row_number().over(series(by, order))
        n = F.count(F.lit(1)).over(whole(by, order))
        placed = df.withColumns({"_at": at, "_rows": n})
        edge = (F.col("_at") == 1) | (F.col("_at") == F.col("_rows"))
        for c in columns:
            placed = placed.withColumn(c, F.when(F.col(c).isNull() & edge, 0.0).otherwise(F.col(c)))
            placed = interpolated(placed, by, "_at", c)
        return placed.drop("_at", "_rows")

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        values = pdf[columns].to_numpy(float)
        frames = np.flatnonzero(np.isfinite(values).all(axis=1))
        pdf[columns] = numeric.propagate(len(pdf), frames.tolist(), values[frames], method, **weights)
        return pdf

    typed = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return typed.groupBy(*by).applyInPandas(run, typed.schema)


def _at_anchors(df: DataFrame, events: DataFrame, targets: DataFrame, by: list[str], order: str, valid: str, position: list[str], anchors: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows at the anchors of series that have them all, with targets t0, t1, ...; (by, reason) of the others)."""
    wanted = targets.select("anchor", F.col("transition").alias("_wanted"), *[F.col(c).alias(f"t{k}") for k, c in enumerate(position)])
    frames = anchor_frames(df, events, by, order, valid, anchors).join(F.broadcast(wanted), "anchor")  # a row for each anchor
    fault = F.coalesce("fault", F.when(F.col("transition") != F.col("_wanted"), "another transition"))
    frames = frames.withColumn("fault", F.when(fault.isNotNull(), F.concat("anchor", F.lit(": "), fault)))
    reasons = frames.groupBy(*by).agg(F.min("fault").alias("reason")).filter("reason is not null")
    good = frames.join(reasons, by, "left_anti").select(*by, F.col("frame").alias(order), *[f"t{k}" for k in range(len(position))])
    return df.select(*by, order, *position).join(good, [*by, order]), reasons


def corrected_positions(df: DataFrame, events: DataFrame, targets: DataFrame, by: list[str], order: str, valid: str, position: list[str], anchors: list[str], method: str = "linear", camera: tuple[geo.Vector, geo.Vector] | None = None, **weights: float) -> DataFrame:
    """df with positions moved so that valid rows meet the targets (anchor, transition, the position columns) at the anchors, and reason.

    Displacements are propagated between the anchors. With camera (quaternion, translation)
    only the depth along the camera's rays moves. reason is null for a series that is
    corrected; others keep their positions.
    """
    at, reasons = _at_anchors(df, events, targets, by, order, valid, position, anchors)
    here, there = tuple(F.col(c) for c in position), tuple(F.col(f"t{k}") for k in range(len(position)))
    moves = [geo.on_ray(here, there, *camera)["delta"]] if camera else [t - p for t, p in zip(there, here, strict=True)]
    names = [f"_d{k}" for k in range(len(moves))]
    given = at.groupBy(*by, order).agg(*[F.max(m).alias(n) for m, n in zip(moves, names, strict=True)], *[F.min(m).alias(f"{n}m") for m, n in zip(moves, names, strict=True)])
    agree = [F.when(F.abs(F.col(n) - F.col(f"{n}m")) <= 1e-10 + 1e-5 * F.abs(n), F.col(n)).otherwise(F.raise_error(F.lit("two anchors move one row differently")).cast("double")).alias(n) for n in names]
    spread = propagated(df.join(given.select(*by, order, *agree), [*by, order], "left"), by, order, names, method, **weights)
    done = spread.join(reasons, by, "left")
    moved = geo.deeper(here, F.col("_d0"), *camera) if camera else tuple(p + F.col(n) for p, n in zip(here, names, strict=True))
    apply = F.col(valid) & F.col("reason").isNull()
    new = {f"_p{k}": F.when(apply, m).otherwise(p) for k, (m, p) in enumerate(zip(moved, here, strict=True))}
    return done.withColumns(new).withColumns({c: F.col(f"_p{k}") for k, c in enumerate(position)}).drop(*new, *names)


def corrected_rotations(df: DataFrame, valid: str, quaternion: list[str], bias: geo.Vector) -> DataFrame:
    """df with R * bias^-1 on valid rows."""
    turned = geo.quaternion_product(tuple(F.col(c) for c in quaternion), geo.conjugate(bias))
    new = {f"_q{k}": F.when(F.col(valid), t).otherwise(F.col(c)) for k, (t, c) in enumerate(zip(turned, quaternion, strict=True))}
    return df.withColumns(new).withColumns({c: F.col(f"_q{k}") for k, c in enumerate(quaternion)}).drop(*new)


def _outer(q: list[str]) -> Column:
    return F.array(*[F.sum(F.col(a) * F.col(b)) for a in q for b in q])


def fitted_anchors(df: DataFrame, events: DataFrame, by: list[str], order: str, valid: str, position: list[str], quaternion: list[str], anchors: list[str], shrinkage: float = 0.1, expected: str | None = None) -> DataFrame:
    """Per anchor: n, transition, mean and shrunk covariance of positions, mean rotation, fault.

    Series that are not healthy, and ambiguous events, are left out. fault says if fewer
    than two series are left or their transitions differ.
    """
    healthy = health(df, events, by, valid, expected).filter("reason is null").select(*by)
    frames = anchor_frames(df, events, by, order, valid, anchors).filter("fault is null").join(healthy, by, "left_semi")
    at = df.select(*by, F.col(order).alias("frame"), *position, *quaternion).join(frames, [*by, "frame"])
    gaussian = stats.shrunk_gaussian(at, ["anchor"], position, shrinkage)
    kinds = at.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("transition").alias("_kinds"), F.min("transition").alias("transition"), _outer(quaternion).alias("s"))
    turned = numeric.mean_rotations(kinds, ["anchor"]).drop("n")
    fault = F.when(F.col("n") < 2, "fewer than two series").when(F.col("_kinds") > 1, "several transitions")
    return kinds.drop("s").withColumn("fault", fault).drop("_kinds").join(gaussian.drop("n"), "anchor", "left").join(turned, "anchor")


def rotation_bias(aligned: DataFrame, by: list[str], ego: str = "a") -> DataFrame:
    """(by, n_ego, n_pairs, qx, qy, qz, qw, angle_deg, spread_deg): the mean rotation from reference to ego, of numeric.align_pairs' rows.

    The offsets on all alignment paths of an ego give its mean, the egos' means the bias;
    spread_deg is their mean distance from it. Fewer than two egos give no row.
    """
    some = aligned.filter("offset is not null")
    sums = some.groupBy(*by, ego).agg(F.sum("n_path").alias("n"), F.count(F.lit(1)).alias("_pairs"), F.array(*[F.sum(F.col("offset")[i]) for i in range(16)]).alias("s"))
    q = ["qx", "qy", "qz", "qw"]
    egos = numeric.mean_rotations(sums, [*by, ego])
    both = egos.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _outer(q).alias("s")).filter("n >= 2")
    bias = numeric.mean_rotations(both, by).select(*by, F.col("n").alias("n_ego"), *[F.col(c).alias(f"b{c}") for c in q])
    pairs = some.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"))
    near = egos.join(bias, by) if by else egos.crossJoin(F.broadcast(bias))  # a row for each side
    off = geo.angle_degrees(tuple(F.col(c) for c in q), tuple(F.col(f"b{c}") for c in q))
    found = near.groupBy(*by, "n_ego", *[f"b{c}" for c in q]).agg(F.avg(off).alias("spread_deg"))
    found = found.join(pairs, by) if by else found.crossJoin(F.broadcast(pairs))  # one row
    angle = F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs("bqw"))))
    return found.select(*by, "n_ego", "n_pairs", *[F.col(f"b{c}").alias(c) for c in q], angle.alias("angle_deg"), "spread_deg")
