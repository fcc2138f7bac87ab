"""Gripper events: transitions between valid rows, invalid spans, health of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import run_lengths, series


def transitions(df: DataFrame, by: list[str], order: str, ts: str, state: str, valid: str, max_gap: float) -> DataFrame:
    """One row for each change of state between successive valid rows.

    ordinal counts a series' events from 0; a change is ambiguous if rows are missing in
    between and the time between is over max_gap, and invalid_gap is 0 without missing rows.
    """
    w = series(by, order)
    good = df.filter(F.col(valid)).withColumns({"_state": F.lag(state).over(w), "_row": F.lag(order).over(w), "_ts": F.lag(ts).over(w)})
    moved = good.filter(F.col("_state") != F.col(state))
    missing = F.col(order) - F.col("_row") > 1
    return moved.select(
        *by, (F.row_number().over(w) - 1).cast("long").alias("ordinal"), F.col(order), F.col(ts),
        F.when(F.col(state) == 1, "close").otherwise("open").alias("transition"),
        (missing & (F.col(ts) - F.col("_ts") > max_gap)).alias("ambiguous"),
        F.when(missing, F.col(ts) - F.col("_ts")).otherwise(0.0).alias("invalid_gap"),
    )


def event_sequences(events: DataFrame, by: list[str]) -> DataFrame:
    """The ordered transitions of every series that has any, and whether one is ambiguous."""
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "transition")))
    return events.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["transition"]), ",").alias("sequence"), F.max("ambiguous").alias("ambiguous"))


def invalid_spans(df: DataFrame, by: list[str], order: str, ts: str, valid: str) -> DataFrame:
    """Maximal runs of invalid rows: first and last row, rows, seconds."""
    runs = run_lengths(df, by, order, valid).filter(~F.col(valid)).select(*by, "first", "last", "length")
    times = df.select(*by, F.col(order).alias("_o"), F.col(ts).alias("_t"))
    start = times.select(*by, F.col("_o").alias("first"), F.col("_t").alias("_a"))
    end = times.select(*by, F.col("_o").alias("last"), F.col("_t").alias("_b"))
    return runs.join(start, [*by, "first"]).join(end, [*by, "last"]).select(*by, "first", "last", "length", (F.col("_b") - F.col("_a")).alias("seconds"))


def health(df: DataFrame, events: DataFrame, by: list[str], valid: str, expected: str | None = None, allow_ambiguous: bool = False) -> DataFrame:
    """reason: null for a healthy series, else why it is left out (no valid pose, other events, ambiguous)."""
    rows = df.groupBy(*by).agg(F.count(F.when(F.col(valid), 1)).alias("n_valid"), F.count(F.lit(1)).alias("n_rows"))
    joined = rows.join(event_sequences(events, by), by, "left")
    reason = F.when(F.col("n_valid") == 0, "no valid pose")
    if expected is not None:
        reason = reason.when(F.coalesce("sequence", F.lit("")) != expected, "unexpected events")
    if not allow_ambiguous:
        reason = reason.when(F.coalesce("ambiguous", F.lit(False)), "ambiguous event")
    return joined.select(*by, "n_rows", "n_valid", F.coalesce("sequence", F.lit("")).alias("sequence"), reason.alias("reason"))


def summary_counts(df: DataFrame, by: list[str], order: str, state: str, valid: str) -> DataFrame:
    """Valid rows, and changes between successive known states (unknown ones skipped)."""
    known = df.filter(F.col(state).isNotNull() & F.col(valid)).withColumn("_before", F.lag(state).over(series(by, order)))
    changes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n_valid"), F.count(F.when(F.col("_before") != F.col(state), 1)).alias("n_transitions"))
    return df.select(*by).distinct().join(changes, by, "left").fillna(0, ["n_valid", "n_transitions"])


def segment_bounds(df: DataFrame, events: DataFrame, by: list[str], order: str, start: int | str | None, end: int | str | None) -> DataFrame:
    """(by, first, last, fault): the rows from one event to another, both included.

    An endpoint is an event's ordinal, "first" or "last" event, or None for the series' own
    end. fault says why a series has no such segment (its event is not there, or is
    ambiguous, or the end is not after the start), else it is null.
    """
    rows = df.groupBy(*by).agg(F.min(order).alias("_min"), F.max(order).alias("_max"))
    found = events.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", F.struct(F.col(order).alias("at"), "ambiguous")))).alias("_events"), F.max("ordinal").alias("_top"))
    rows = rows.join(found, by, "left")

    def point(k: int | str | None, own: str) -> tuple[Column, Column]:
        if k is None:
            return F.col(own), F.lit(None).cast("string")
        ordinal = F.lit(0) if k == "first" else F.col("_top") if k == "last" else F.lit(k)
        event = F.try_element_at("_events", ordinal.cast("long"))
        missing = F.when(event.isNull(), f"no event {k}").when(event["ambiguous"], f"event {k} is ambiguous")
        return event["at"], missing

    (a, no_a), (b, no_b) = point(start, "_min"), point(end, "_max")
    fault = F.coalesce(no_a, no_b, F.when(b <= a, "the end is not after the start"))
    return rows.select(*by, a.alias("first"), b.alias("last"), fault.alias("fault"))


def segments(df: DataFrame, events: DataFrame, by: list[str], order: str, start: int | str | None, end: int | str | None) -> DataFrame:
    """The rows of every series' segment; a series with a fault (see segment_bounds) has none."""
    bounds = segment_bounds(df, events, by, order, start, end).filter("fault is null").select(*by, F.col("first").alias("_a"), F.col("last").alias("_b"))
    return df.join(bounds, by).filter(F.col(order).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def event_errors(a: DataFrame, b: DataFrame, by: list[str], position: list[str]) -> DataFrame:
    """(by, ordinal, transition, error): the distance between two tracks' positions at events of the same ordinal and transition.

    a and b have by, ordinal, transition and the position columns; an event that the other
    track has not, or with another transition, has no row.
    """
    other = b.select(*by, "ordinal", "transition", *[F.col(c).alias(f"_{c}") for c in position])
    square = sum((F.pow(F.col(c) - F.col(f"_{c}"), F.lit(2)) for c in position[1:]), F.pow(F.col(position[0]) - F.col(f"_{position[0]}"), F.lit(2)))
    return a.join(other, [*by, "ordinal", "transition"]).select(*by, "ordinal", "transition", F.sqrt(square).alias("error"))


def staleness(df: DataFrame, by: list[str], order: str, ts: str, most: float) -> DataFrame:
    """(by, stale, worst): rows more than `most` after the one before, and the longest such time."""
    aged = df.withColumn("_age", F.col(ts) - F.lag(ts).over(series(by, order)))
    return aged.groupBy(*by).agg(F.count_if(F.col("_age") > most).alias("stale"), F.max("_age").alias("worst"))
