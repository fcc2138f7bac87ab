"""Queries of the segmentation, event, fill and resampling operators over the frames proxy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionloom.operators import corrections as co
from motionloom.operators import events as ev
from motionloom.operators import guards, runs
from motionloom.operators import resample as rs

from .proxies import BY, FRAMES_SQL, ORDER, R6, frames
from .registry import FLAGSHIP, ORACLES, QUERIES
from .sqltext import Chain

MAX_GAP = 3600.0
_W = "(PARTITION BY episode_id ORDER BY frame_idx)"


def query(name: str, sql: str | None = None):
    """Register a function of the frames proxy; sql follows the CTE f."""

    def add(function):
        QUERIES[name] = lambda spark, sf_dir: function(frames(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH {FRAMES_SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return function

    return add


def _events(f: DataFrame) -> DataFrame:
    return ev.transitions(f, BY, ORDER, "t", "state", "valid", MAX_GAP)


_EVENTS_SQL = f""",
    g AS (SELECT *, lag(state) OVER w AS s0, lag(frame_idx) OVER w AS i0, lag(t) OVER w AS t0 FROM f WHERE valid WINDOW w AS {_W}),
    e AS (SELECT episode_id, row_number() OVER {_W} - 1 AS ordinal, frame_idx, t, CASE WHEN state = 1 THEN 'close' ELSE 'open' END AS transition,
                 frame_idx - i0 > 1 AND t - t0 > {MAX_GAP} AS ambiguous, CASE WHEN frame_idx - i0 > 1 THEN t - t0 ELSE 0 END AS invalid_gap FROM g WHERE s0 <> state)"""


@query("w21_grasp_hysteresis", " SELECT episode_id, frame_idx, CASE WHEN NOT valid THEN (value < 20)::INT ELSE coalesce(last_value(CASE WHEN valid AND value < 30 THEN 1 WHEN valid AND value > 60 THEN 0 END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 0) END::INT AS state FROM f")
def _w21(f: DataFrame) -> DataFrame:
    """Rows without a ratio take their distance, and leave the latch alone."""
    ratio = f.withColumn("ratio", F.when(F.col("valid"), F.col("value")))
    return runs.hysteresis(ratio, BY, ORDER, "ratio", 30.0, 60.0, distance="value", near=20.0).select("episode_id", "frame_idx", F.col("state").cast("int").alias("state"))


@query("w1_transitions", _EVENTS_SQL + " SELECT episode_id, ordinal, frame_idx, round(t, 6) AS t, transition, ambiguous, round(invalid_gap, 6) AS invalid_gap FROM e")
def _w1(f: DataFrame) -> DataFrame:
    return _events(f).withColumns({"t": R6("t"), "invalid_gap": R6("invalid_gap")})


@query("w2_event_sequence", _EVENTS_SQL + " SELECT episode_id, string_agg(transition, ',' ORDER BY ordinal) AS sequence, bool_or(ambiguous) AS ambiguous FROM e GROUP BY episode_id")
def _w2(f: DataFrame) -> DataFrame:
    return ev.event_sequences(_events(f), BY)


def _runs_sql(value: str, of: str = "f") -> str:
    """CTE r: of with run, run_length, run_row and last_run of equal `value`, as the operator has them."""
    return f"""
    r0 AS (SELECT *, CASE WHEN frame_idx > 0 AND lag({value}) OVER {_W} IS NOT DISTINCT FROM {value} THEN 0 ELSE 1 END AS ch FROM {of}),
    r1 AS (SELECT *, sum(ch) OVER {_W} AS run FROM r0),
    r AS (SELECT *, count(*) OVER (PARTITION BY episode_id, run) AS run_length, row_number() OVER (PARTITION BY episode_id, run ORDER BY frame_idx) AS run_row,
                 max(run) OVER (PARTITION BY episode_id) AS last_run FROM r1)"""


@query("w3_invalid_spans", "," + _runs_sql("valid") + """ SELECT episode_id, min(frame_idx) AS "first", max(frame_idx) AS "last", count(*) AS length, round(max(t) - min(t), 6) AS seconds
       FROM r WHERE NOT valid GROUP BY episode_id, run""")
def _w3(f: DataFrame) -> DataFrame:
    return ev.invalid_spans(f, BY, ORDER, "t", "valid").withColumn("seconds", R6("seconds"))


@query("w4_run_lengths", "," + _runs_sql("state") + """ SELECT episode_id, run::BIGINT AS run, min(frame_idx) AS "first", max(frame_idx) AS "last", count(*) AS length, min(state)::INT AS state
       FROM r GROUP BY episode_id, run""")
def _w4(f: DataFrame) -> DataFrame:
    return runs.run_lengths(f, BY, ORDER, "state")


@query("w5_fill_short_gaps", "," + _runs_sql("valid") + " SELECT episode_id, frame_idx, valid OR (run_length <= 1 AND run > 1 AND run < last_run) AS valid FROM r")
def _w5(f: DataFrame) -> DataFrame:
    return runs.fill_short_gaps(f, BY, ORDER, "valid", 1).select("episode_id", "frame_idx", "valid")


@query("w6_drop_short_runs", "," + _runs_sql("valid") + " SELECT episode_id, frame_idx, valid AND run_length > 2 AS valid FROM r")
def _w6(f: DataFrame) -> DataFrame:
    return runs.drop_short_runs(f, BY, ORDER, "valid", 2).select("episode_id", "frame_idx", "valid")


_SPEED = f",\n    s AS (SELECT *, value AS v, abs(value - coalesce(lag(value) OVER {_W}, value)) AS w FROM f)"


def _speeds(f: DataFrame) -> DataFrame:
    w = runs.series(BY, ORDER)
    return f.withColumns({"v": F.col("value"), "w": F.abs(F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value")))})


_STOP = _SPEED + ",\n    m AS (SELECT *, v < 60 AND w < 50 AS stop FROM s)," + _runs_sql("stop", "m") + """,
    c AS (SELECT episode_id, frame_idx, t, value, v, w, stop OR (run_length <= 2 AND run > 1 AND run < last_run) AS stop FROM r)"""
_STOP2 = _STOP + "," + _runs_sql("stop", "c").replace("r0", "x0").replace("r1", "x1").replace("r AS", "x AS") + """,
    h AS (SELECT episode_id, frame_idx, t, value, v, w, stop AND run_length > 2 AS stop FROM x)"""


@query("w7_stop_mask", _STOP2 + " SELECT episode_id, frame_idx, stop FROM h")
def _w7(f: DataFrame) -> DataFrame:
    return runs.stop_mask(_speeds(f), BY, ORDER, "v", "w", 60.0, 50.0, 3, 2).select("episode_id", "frame_idx", "stop")


@query("w8_closed_mask", f""", d AS (SELECT *, bool_or(valid) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS dv FROM f)
       SELECT episode_id, frame_idx, bool_and(dv) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS valid FROM d""")
def _w8(f: DataFrame) -> DataFrame:
    return runs.closed_mask(f, BY, ORDER, "valid", 4).select("episode_id", "frame_idx", "valid")


@query("w9_veto_turning", "," + _runs_sql("valid") + ",\n k AS (SELECT episode_id, frame_idx, value, valid AND run_length > 2 AS valid FROM r)," + _runs_sql("valid", "k").replace("r0", "x0").replace("r1", "x1").replace("r AS", "x AS") + """
       SELECT episode_id, frame_idx, valid AND NOT abs(last_value(value) OVER q - first_value(value) OVER q) >= 40 AS valid FROM x
       WINDOW q AS (PARTITION BY episode_id, run ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def _w9(f: DataFrame) -> DataFrame:
    return runs.veto_turning(f, BY, ORDER, "valid", "value", 3, 40.0).select("episode_id", "frame_idx", "valid")


@query("w10_delay_onset", "," + _runs_sql("valid") + " SELECT episode_id, frame_idx, valid AND run_row > 2 AS valid FROM r")
def _w10(f: DataFrame) -> DataFrame:
    return runs.delay_onset(f, BY, ORDER, "valid", 2).select("episode_id", "frame_idx", "valid")


_MEDIAN = f""", n AS (SELECT *, count(*) OVER (PARTITION BY episode_id) AS cnt FROM f),
    o AS (SELECT a.episode_id, a.frame_idx, b.state FROM n a CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS d) JOIN n b
          ON a.episode_id = b.episode_id AND b.frame_idx = least(greatest(a.frame_idx + d, 0), a.cnt - 1)),
    md AS (SELECT episode_id, frame_idx, quantile_disc(state, 0.5)::INT AS state FROM o GROUP BY episode_id, frame_idx)"""


@query("w11_median_filter", _MEDIAN + " SELECT * FROM md")
def _w11(f: DataFrame) -> DataFrame:
    return runs.median_filter(f, BY, ORDER, "state", 5).select("episode_id", "frame_idx", "state")


@query("w12_merge_short_runs", "," + _runs_sql("state") + """,
    h AS (SELECT DISTINCT episode_id, run, state FROM r), h2 AS (SELECT *, coalesce(lead(state) OVER q, lag(state) OVER q, state) AS other FROM h WINDOW q AS (PARTITION BY episode_id ORDER BY run))
    SELECT r.episode_id, frame_idx, CASE WHEN run_length < 3 THEN other ELSE r.state END::INT AS state FROM r JOIN h2 ON r.episode_id = h2.episode_id AND r.run = h2.run""")
def _w12(f: DataFrame) -> DataFrame:
    return runs.merge_short_runs(f, BY, ORDER, "state", 3).select("episode_id", "frame_idx", "state")


@query("w13_modes", _SPEED + Chain("s").step("SELECT *, v < 60 AND w < 50 AS stop FROM {of}").filled("stop", 2).dropped("stop", 2).modes("stop", "v", "w", 40, 40, 3, 5, 8, 2).sql("SELECT episode_id, frame_idx, mode::INT AS mode"))
def _w13(f: DataFrame) -> DataFrame:
    stopped = runs.stop_mask(_speeds(f), BY, ORDER, "v", "w", 60.0, 50.0, 3, 2)
    return runs.modes(stopped, BY, ORDER, "stop", "v", "w", 40.0, 40.0, 3, 5, 8, 2).select("episode_id", "frame_idx", F.col("mode").cast("int").alias("mode"))


@query("w14_manipulation_window", Chain("f").refined("state", "CASE WHEN valid THEN value END", 45, 3, 2).sql("SELECT episode_id, frame_idx, state::INT AS state"))
def _w14(f: DataFrame) -> DataFrame:
    hands = f.withColumn("speed", F.when(F.col("valid"), F.col("value")))
    return runs.refine_stops(hands, BY, ORDER, "state", "speed", 45.0, 3, 2).select("episode_id", "frame_idx", F.col("state").cast("int").alias("state"))


@query("w15_mark_finish", "," + _runs_sql("state") + """, l AS (SELECT *, max(CASE WHEN state <> 3 THEN run END) OVER (PARTITION BY episode_id) AS lastrun FROM r)
       SELECT episode_id, frame_idx, CASE WHEN run = lastrun AND run_length - run_row < 2 THEN 4 ELSE state END::INT AS state FROM l""")
def _w15(f: DataFrame) -> DataFrame:
    return runs.mark_finish(f, BY, ORDER, "state", 2).select("episode_id", "frame_idx", F.col("state").cast("int").alias("state"))


_PHASES = (
    Chain("s").step("SELECT *, v < 60 AND w < 50 AS stop FROM {of}").filled("stop", 2).dropped("stop", 2).closed("stop", 2).vetoed("stop", "value", 3, 60.0).delayed("stop", 1)
    .modes("stop", "v", "w", 40, 40, 3, 5, 8, 2).refined("mode", "CASE WHEN valid THEN value END", 45, 2, 1).finished("mode", 3)
)


@query("w16_phases", _SPEED + _PHASES.sql("SELECT episode_id, frame_idx, mode::INT AS mode"))
def _w16(f: DataFrame) -> DataFrame:
    hands = _speeds(f).withColumn("hand", F.when(F.col("valid"), F.col("value")))
    done = runs.phases(hands, BY, ORDER, "v", "w", "value", 60.0, 50.0, turn=40.0, slow=40.0, veto=60.0, extend=2, hand_speed="hand", hand_slow=45.0, wait=2, margin=1)
    return done.select("episode_id", "frame_idx", F.col("mode").cast("int").alias("mode"))


@query("w17_longest_run", "," + _runs_sql("valid") + """, g AS (SELECT episode_id, run, min(frame_idx) AS "first", max(frame_idx) AS "last", count(*) AS length FROM r WHERE valid GROUP BY episode_id, run)
       SELECT episode_id, "first", "last", length FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY length DESC, "first") AS k FROM g) WHERE k = 1""")
def _w17(f: DataFrame) -> DataFrame:
    return runs.longest_run(f, BY, ORDER, "valid")


@query("w18_unwrapped_yaw", f""", a AS (SELECT *, value / 30.0 - floor(value / 30.0 / (2 * pi())) * 2 * pi() AS yaw FROM f),
      b AS (SELECT *, yaw - lag(yaw) OVER {_W} AS d, t - lag(t) OVER {_W} AS dt FROM a),
      c AS (SELECT *, yaw + 2 * pi() * sum(CASE WHEN d IS NULL OR abs(d) < pi() THEN 0 ELSE -floor((d + pi()) / (2 * pi())) END) OVER {_W} AS u FROM b)
      SELECT episode_id, frame_idx, round(u - first_value(u) OVER {_W}, 6) + 0 AS unwrapped, round(coalesce(CASE WHEN dt > 0 THEN 1e6 * abs(u - lag(u) OVER {_W}) / dt END, 0), 5) AS rate,
             round(coalesce(CASE WHEN dt > 0 THEN 1e6 * sqrt((value - lag(value) OVER {_W})**2 + (value / 2 - lag(value / 2) OVER {_W})**2) / dt END, 0), 4) AS speed FROM c""")
def _w18(f: DataFrame) -> DataFrame:
    angle = F.col("value") / 30.0
    turning = f.withColumns({"yaw": angle - F.floor(angle / (2 * F.pi())) * 2 * F.pi(), "y": F.col("value") / 2})
    found = runs.odometry(turning, BY, ORDER, "t", ["value", "y"], "yaw")
    return found.select("episode_id", "frame_idx", (R6("unwrapped") + 0.0).alias("unwrapped"), F.round(1e6 * F.col("yaw_rate"), 5).alias("rate"), F.round(1e6 * F.col("speed"), 4).alias("speed"))


@query("w19_speed_reset", f""" SELECT episode_id, frame_idx, CASE WHEN valid THEN round(coalesce((value - lag(CASE WHEN valid THEN value END) OVER {_W}) / 0.5, 0), 6) END AS speed FROM f""")
def _w19(f: DataFrame) -> DataFrame:
    return runs.speed(f, BY, ORDER, "value", F.lit(0.5), "valid", bridge=False).select("episode_id", "frame_idx", R6("speed").alias("speed"))


@query("w20_speed_bridge", """ SELECT episode_id, frame_idx, CASE WHEN valid THEN round(coalesce((value - last_value(CASE WHEN valid THEN value END IGNORE NULLS)
       OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 0.5, 0), 6) END AS speed FROM f""")
def _w20(f: DataFrame) -> DataFrame:
    return runs.speed(f, BY, ORDER, "value", F.lit(0.5), "valid", bridge=True).select("episode_id", "frame_idx", R6("speed").alias("speed"))


@query("w25_next_state", f" SELECT episode_id, frame_idx, round(coalesce(lead(value) OVER {_W}, value), 6) AS action FROM f")
def _w25(f: DataFrame) -> DataFrame:
    return rs.next_row(f, BY, ORDER, "value", "action").select("episode_id", "frame_idx", R6("action").alias("action"))


_KNOWN = "CASE WHEN valid THEN value END"


@query("w26_fill_both_ways", f""" SELECT episode_id, frame_idx, round(coalesce(last_value({_KNOWN} IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING),
       first_value({_KNOWN} IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1.0), 6) AS value FROM f""")
def _w26(f: DataFrame) -> DataFrame:
    known = f.withColumn("value", F.when(F.col("valid"), F.col("value")))
    return rs.filled_both_ways(known, BY, ORDER, "value", 1.0).select("episode_id", "frame_idx", R6("value").alias("value"))


@query("w28_bad_streak", "," + _runs_sql("valid") + " SELECT episode_id, frame_idx, CASE WHEN valid THEN 0 ELSE run_row END AS streak FROM r")
def _w28(f: DataFrame) -> DataFrame:
    return runs.bad_streak(f.withColumn("bad", ~F.col("valid")), BY, ORDER, "bad").select("episode_id", "frame_idx", F.col("streak").cast("long").alias("streak"))


@query("k2_carry_forward", """ SELECT episode_id, frame_idx, coalesce(last_value(CASE WHEN valid THEN state END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 0)::INT AS state FROM f""")
def _k2(f: DataFrame) -> DataFrame:
    return rs.carried(f.withColumn("state", F.when(F.col("valid"), F.col("state"))), BY, ORDER, "state", 0).select("episode_id", "frame_idx", "state")


@query("k3_state_action", f""" SELECT episode_id, frame_idx, CASE WHEN state = 1 THEN 0.0 ELSE -3.4 END::DOUBLE AS state_raw, CASE WHEN coalesce(lead(state) OVER {_W}, state) = 1 THEN 0.0 ELSE -3.4 END::DOUBLE AS action_raw FROM f""")
def _k3(f: DataFrame) -> DataFrame:
    raw = f.withColumn("state_raw", F.when(F.col("state") == 1, 0.0).otherwise(-3.4))
    return rs.next_row(raw, BY, ORDER, "state_raw", "action_raw").select("episode_id", "frame_idx", "state_raw", "action_raw")


@query("p13_consecutive_valid", f", a AS (SELECT *, coalesce(lead(valid) OVER {_W}, false) AS nx FROM f) SELECT episode_id, frame_idx FROM a WHERE valid AND nx")
def _p13(f: DataFrame) -> DataFrame:
    return rs.consecutive_valid(f, BY, ORDER, "valid").select("episode_id", "frame_idx")


@query("p10_health", _EVENTS_SQL + """, n AS (SELECT episode_id, count(*) AS n_rows, count(*) FILTER (WHERE valid) AS n_valid FROM f GROUP BY episode_id),
       q AS (SELECT episode_id, string_agg(transition, ',' ORDER BY ordinal) AS sequence, bool_or(ambiguous) AS amb FROM e GROUP BY episode_id)
       SELECT n.episode_id, n_rows, n_valid, coalesce(sequence, '') AS sequence, CASE WHEN n_valid = 0 THEN 'no valid pose' WHEN coalesce(amb, false) THEN 'ambiguous event' END AS reason
       FROM n LEFT JOIN q ON n.episode_id = q.episode_id""")
def _p10(f: DataFrame) -> DataFrame:
    return ev.health(f, _events(f), BY, "valid")


@query("p19_summary_counts", f""", g AS (SELECT *, lag(state) OVER {_W} AS s0 FROM f WHERE valid), h AS (SELECT episode_id, count(*) AS a, count(*) FILTER (WHERE s0 <> state) AS b FROM g GROUP BY episode_id)
       SELECT d.episode_id, coalesce(a, 0) AS n_valid, coalesce(b, 0) AS n_transitions FROM (SELECT DISTINCT episode_id FROM f) d LEFT JOIN h ON d.episode_id = h.episode_id""")
def _p19(f: DataFrame) -> DataFrame:
    return ev.summary_counts(f, BY, ORDER, "state", "valid")


@query("g2_event_segment", _EVENTS_SQL + """, b AS (SELECT episode_id, max(frame_idx) FILTER (WHERE ordinal = 0) AS a, max(frame_idx) FILTER (WHERE ordinal = 3) AS z, bool_or(ambiguous) FILTER (WHERE ordinal IN (0, 3)) AS am FROM e GROUP BY episode_id)
       SELECT f.episode_id, frame_idx, round(value, 6) AS value FROM f JOIN b ON f.episode_id = b.episode_id AND frame_idx BETWEEN a AND z AND z > a AND NOT am""")
def _g2(f: DataFrame) -> DataFrame:
    return ev.segments(f, _events(f), BY, ORDER, 0, 3).select("episode_id", "frame_idx", R6("value").alias("value"))


@query("g2_segment_bounds", _EVENTS_SQL + """, q AS (SELECT episode_id, min(frame_idx) AS lo, max(frame_idx) AS hi FROM f GROUP BY episode_id), x AS (SELECT episode_id, max(ordinal) AS top FROM e GROUP BY episode_id),
       b AS (SELECT q.episode_id, lo, hi, l.frame_idx AS z, l.ambiguous AS am, top FROM q LEFT JOIN x ON q.episode_id = x.episode_id LEFT JOIN e l ON q.episode_id = l.episode_id AND l.ordinal = x.top)
       SELECT episode_id, lo AS "first", z AS "last", CASE WHEN z IS NULL THEN 'no event last' WHEN am THEN 'event last is ambiguous' WHEN z <= lo THEN 'the end is not after the start' END AS fault FROM b""")
def _g2b(f: DataFrame) -> DataFrame:
    """From a series' beginning to its last event; why some have no such segment."""
    return ev.segment_bounds(f, _events(f), BY, ORDER, None, "last")


_TARGETS = [("start", None, 45.0123457, 20.0345679), ("0", "close", 20.0567891, 12.0789123), ("2", "close", 18.0912347, 9.0134579), ("end", None, 55.0356791, 30.0579137)]
_TARGETS_SQL = ", ".join(f"('{a}', {repr(t) if t else 'NULL'}, {x}, {y})" for a, t, x, y in _TARGETS)
_G7_SQL = f"""{_EVENTS_SQL}, tg(anchor, wanted, tx, ty) AS (VALUES {_TARGETS_SQL}), q AS (SELECT episode_id, min(frame_idx) FILTER (WHERE valid) AS lo, max(frame_idx) FILTER (WHERE valid) AS hi, max(frame_idx) AS n1 FROM f GROUP BY episode_id),
       an AS (SELECT q.episode_id, anchor, tx, ty, CASE anchor WHEN 'start' THEN lo WHEN 'end' THEN hi ELSE e.frame_idx END AS pos,
                     CASE WHEN anchor IN ('start', 'end') THEN CASE WHEN lo IS NULL THEN 'no valid row' END WHEN e.episode_id IS NULL THEN 'no such event' WHEN ambiguous THEN 'ambiguous event' WHEN transition <> wanted THEN 'another transition' END AS fault
              FROM q CROSS JOIN tg LEFT JOIN e ON q.episode_id = e.episode_id AND e.ordinal::VARCHAR = anchor),
       re AS (SELECT episode_id, min(anchor || ': ' || fault) AS reason FROM an GROUP BY episode_id),
       d AS (SELECT an.episode_id, pos AS frame_idx, tx - value AS dx, ty - value / 2 AS dy FROM an JOIN f ON an.episode_id = f.episode_id AND pos = f.frame_idx WHERE an.episode_id NOT IN (SELECT episode_id FROM re WHERE reason IS NOT NULL)),
       w AS (SELECT f.*, CASE WHEN d.dx IS NOT NULL THEN d.dx WHEN f.frame_idx IN (0, n1) THEN 0 END AS cx, CASE WHEN d.dy IS NOT NULL THEN d.dy WHEN f.frame_idx IN (0, n1) THEN 0 END AS cy FROM f JOIN q ON f.episode_id = q.episode_id LEFT JOIN d ON f.episode_id = d.episode_id AND f.frame_idx = d.frame_idx),
       z AS (SELECT *, last_value(CASE WHEN cx IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER p AS x0, first_value(CASE WHEN cx IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER n AS x1, last_value(cx IGNORE NULLS) OVER p AS a0, first_value(cx IGNORE NULLS) OVER n AS a1,
                    last_value(cy IGNORE NULLS) OVER p AS b0, first_value(cy IGNORE NULLS) OVER n AS b1 FROM w
             WINDOW p AS (PARTITION BY episode_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
       m AS (SELECT *, CASE WHEN x1 > x0 THEN (frame_idx - x0) / (x1 - x0)::DOUBLE ELSE 0 END AS sh FROM z)
       SELECT m.episode_id, frame_idx, round(value + CASE WHEN valid AND reason IS NULL THEN a0 + (a1 - a0) * sh ELSE 0 END, 5) + 0 AS x, round(value / 2 + CASE WHEN valid AND reason IS NULL THEN b0 + (b1 - b0) * sh ELSE 0 END, 5) + 0 AS y, reason FROM m JOIN re ON m.episode_id = re.episode_id"""


def _corrected(f: DataFrame, method: str) -> DataFrame:
    rows = f.withColumns({"x": F.col("value"), "y": F.col("value") / 2})
    targets = f.sparkSession.createDataFrame(_TARGETS, "anchor string, transition string, x double, y double")
    done = co.corrected_positions(rows, _events(f), targets, BY, ORDER, "valid", ["x", "y"], [a for a, *_ in _TARGETS], method)
    return done.select("episode_id", "frame_idx", *[(F.round(c, 5) + 0.0).alias(c) for c in "xy"], "reason")


@query("g7_position_correction", _G7_SQL)
def _g7(f: DataFrame) -> DataFrame:
    """Series drawn to targets at their ends and at two events, by lines between; others say what they lack."""
    return _corrected(f, "linear")


@query("g7_position_correction_min_bending")
def _g7b(f: DataFrame) -> DataFrame:
    return _corrected(f, "min_bending")


@query("j9_anchor_correspondence", _EVENTS_SQL + """ SELECT a.episode_id AS a, a.ordinal, a.transition, round(abs(x.value - y.value), 6) AS error FROM e a JOIN e b ON b.episode_id = a.episode_id + 1 AND b.ordinal = a.ordinal AND a.transition = b.transition
       JOIN f x ON x.episode_id = a.episode_id AND x.frame_idx = a.frame_idx JOIN f y ON y.episode_id = b.episode_id AND y.frame_idx = b.frame_idx""")
def _j9(f: DataFrame) -> DataFrame:
    """A series' events against those of the next series, as of two tracks of one take."""
    at = _events(f).select("episode_id", "ordinal", "transition", ORDER).join(f.select("episode_id", ORDER, "value"), ["episode_id", ORDER])
    left = at.withColumnRenamed("episode_id", "a")
    right = at.withColumn("a", F.col("episode_id") - 1)
    return ev.event_errors(left, right, ["a"], ["value"]).select("a", "ordinal", "transition", R6("error").alias("error"))


@query("g11_short_gap_interpolation", f""", a AS (SELECT *, {_KNOWN} AS k, CASE WHEN valid THEN frame_idx END AS i FROM f),
      b AS (SELECT *, last_value(i IGNORE NULLS) OVER p AS x0, first_value(i IGNORE NULLS) OVER n AS x1, last_value(k IGNORE NULLS) OVER p AS y0, first_value(k IGNORE NULLS) OVER n AS y1 FROM a
            WINDOW p AS (PARTITION BY episode_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      SELECT episode_id, frame_idx, round(CASE WHEN valid THEN value WHEN x1 - x0 - 1 <= 2 THEN y0 + (y1 - y0) * (frame_idx - x0) / (x1 - x0) END, 6) AS value FROM b""")
def _g11(f: DataFrame) -> DataFrame:
    known = f.withColumn("value", F.when(F.col("valid"), F.col("value")))
    return rs.interpolated(known, BY, ORDER, "value", 2).select("episode_id", "frame_idx", R6("value").alias("value"))


@query("g15_densified", f""", a AS (SELECT *, lag(value) OVER {_W} AS v0, lag(t) OVER {_W} AS t0 FROM f), b AS (SELECT *, greatest(1, ceil(greatest((t - t0) / 1e6, abs(value - v0) / 20.0) * 2.0))::INT AS n FROM a WHERE v0 IS NOT NULL),
      c AS (SELECT *, unnest(range(1, n + 1)) AS step FROM b) SELECT episode_id, frame_idx, step, round(v0 + (value - v0) * step / n, 9) AS command FROM c""")
def _g15(f: DataFrame) -> DataFrame:
    return rs.densified(f, BY, ORDER, "t", "value", 2.0, 1e6, 20.0).withColumn("command", F.round("command", 9))


@query("g16_thinned", """, n AS (SELECT *, count(*) OVER (PARTITION BY episode_id) AS c FROM f), k AS (SELECT DISTINCT episode_id, round_even(i * (c - 1) / 8.0, 0)::BIGINT AS frame_idx FROM n CROSS JOIN range(9) r(i))
       SELECT f.episode_id, f.frame_idx FROM f JOIN k ON f.episode_id = k.episode_id AND f.frame_idx = k.frame_idx""")
def _g16(f: DataFrame) -> DataFrame:
    return rs.thinned(f, BY, ORDER, 9).select("episode_id", "frame_idx")


_GRID = ", z AS (SELECT episode_id, min(t) AS a, max(t) AS b FROM f GROUP BY episode_id), tg AS (SELECT episode_id, i AS sample, CASE WHEN i = 19 THEN b ELSE a + i * ((b - a) / 19) END AS tt FROM z CROSS JOIN range(20) r(i))"


@query("g1_resampled", _GRID + """, lf AS (SELECT tg.*, f.t AS pt, f.value AS pv, f.state AS ps, f.valid AS pok FROM tg ASOF LEFT JOIN f ON tg.episode_id = f.episode_id AND tg.tt > f.t),
      rt AS (SELECT lf.*, f.t AS nt, f.value AS nv, f.state AS ns, f.valid AS nok FROM lf ASOF LEFT JOIN f ON lf.episode_id = f.episode_id AND lf.tt <= f.t),
      x AS (SELECT *, nt IS NOT NULL AND abs(nt - tt) <= 1e-10 + 1e-5 * abs(tt) AS hit, coalesce(pok AND nok AND nt - pt <= 200000, false) AS ok, (tt - pt) / (nt - pt) AS al FROM rt)
      SELECT episode_id, sample, round(tt, 6) AS t, round(CASE WHEN hit THEN CASE WHEN nok THEN nv END WHEN ok THEN pv + al * (nv - pv) END, 6) AS value,
             CASE WHEN hit THEN CASE WHEN nok THEN ns END WHEN ok THEN CASE WHEN al < 0.5 THEN ps ELSE ns END END::INT AS state, CASE WHEN hit THEN nok ELSE ok END AS valid FROM x""")
def _g1(f: DataFrame) -> DataFrame:
    found = rs.resampled(f, BY, "t", "valid", 200_000.0, 20, linear=["value"], nearest=["state"])
    return found.withColumns({"t": R6("t"), "value": R6("value")})


@query("s2_timestamps", f""", a AS (SELECT *, CASE WHEN episode_id % 5 = 0 AND frame_idx = 3 THEN NULL ELSE t * 1e9 END AS ns, CASE WHEN episode_id % 3 = 0 THEN t * 2 WHEN frame_idx <> 2 THEN t END AS sec FROM f), b AS (SELECT *, ns - lag(ns) OVER {_W} AS st FROM a),
      c AS (SELECT *, bool_and(sec IS NOT NULL) OVER (PARTITION BY episode_id) AS timed, bool_and(ns IS NOT NULL) OVER (PARTITION BY episode_id) AS known, first_value(ns) OVER {_W} AS n0, quantile_cont(st, 0.5) OVER (PARTITION BY episode_id) AS md FROM b)
      SELECT episode_id, frame_idx, round(CASE WHEN timed THEN sec WHEN known THEN (ns - n0) * (CASE WHEN coalesce(md, 0) > 1e3 THEN 1e-9 ELSE 1 END) ELSE frame_idx / 10.0 END, 6) AS t FROM c""")
def _s2(f: DataFrame) -> DataFrame:
    ns = F.when(~((F.col("episode_id") % 5 == 0) & (F.col("frame_idx") == 3)), F.col("t") * 1e9)
    seconds = F.when(F.col("episode_id") % 3 == 0, F.col("t") * 2).when(F.col("frame_idx") != 2, F.col("t"))
    timed = f.withColumns({"ns": ns, "sec": seconds, "fps": F.lit(10.0)}).drop("t")
    return rs.resolved_times(timed, BY, ORDER, "sec", "ns", "fps").select("episode_id", "frame_idx", F.round("t", 6).alias("t"))


@query("s2_rebased", f""", b AS (SELECT *, t * 1e9 AS ns FROM f) SELECT episode_id, frame_idx, round((ns - first_value(ns) OVER {_W}) * 1e-9, 6) AS t FROM b""")
def _s2b(f: DataFrame) -> DataFrame:
    """Nanoseconds from the first row; a series of one row, without a step, keeps its zero."""
    return rs.rebased(f.withColumn("ns", F.col("t") * 1e9).drop("t"), BY, ORDER, "ns", 10.0).select("episode_id", "frame_idx", F.round("t", 6).alias("t"))


@query("p6_trimmed", """, n AS (SELECT *, count(*) OVER (PARTITION BY episode_id) AS c FROM f) SELECT episode_id, frame_idx FROM n WHERE frame_idx >= 2 AND frame_idx < c - 4""")
def _p6(f: DataFrame) -> DataFrame:
    return rs.trimmed(f, BY, ORDER, 0.25, 0.35, 10.0).select("episode_id", "frame_idx")


@query("p1_validation", f""", a AS (SELECT *, CASE WHEN frame_idx = 5 AND episode_id % 4 = 0 THEN t - 1e9 ELSE t END AS u, CASE WHEN episode_id % 6 = 0 AND frame_idx = 2 THEN 'inf'::DOUBLE ELSE value END AS x FROM f), b AS (SELECT *, lag(u) OVER {_W} AS u0 FROM a)
       SELECT episode_id, bool_and(u0 IS NULL OR u > u0) AS increasing, bool_and(state IN (0, 1)) AS binary_state, bool_and(NOT valid OR isfinite(x)) AS finite, count(*) AS n_rows FROM b GROUP BY episode_id""")
def _p1(f: DataFrame) -> DataFrame:
    """Some series have a time that falls, some a value that is not finite."""
    late = F.when((F.col("frame_idx") == 5) & (F.col("episode_id") % 4 == 0), F.col("t") - 1e9).otherwise(F.col("t"))
    value = F.when((F.col("episode_id") % 6 == 0) & (F.col("frame_idx") == 2), float("inf")).otherwise(F.col("value"))
    return guards.trajectory_rules(f.withColumns({"t": late, "value": value}), BY, ORDER, "t", "state", "valid", ["value"]).drop("unit")


@query("a20_median_jump", f""", a AS (SELECT *, count(*) OVER (PARTITION BY episode_id) AS c, quantile_cont(value, 0.5) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b,
      quantile_cont(value, 0.5) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM f)
      SELECT episode_id, frame_idx, CASE WHEN frame_idx >= 3 AND frame_idx + 3 <= c THEN round(n - b, 6) END AS jump FROM a""")
def _a20(f: DataFrame) -> DataFrame:
    return runs.window_median_change(f, BY, ORDER, "value", 3).select("episode_id", "frame_idx", R6("jump").alias("jump"))


@query(FLAGSHIP, _EVENTS_SQL + """, n AS (SELECT episode_id, count(*) AS n_rows, count(*) FILTER (WHERE valid) AS n_valid, round(avg(value) FILTER (WHERE valid), 6) AS mean_value FROM f GROUP BY episode_id),
       q AS (SELECT episode_id, count(*) AS c, count(*) FILTER (WHERE transition = 'close') AS cl, count(*) FILTER (WHERE ambiguous) AS am, round(max(invalid_gap), 6) AS mg FROM e GROUP BY episode_id)
       SELECT n.*, coalesce(c, 0) AS n_events, coalesce(cl, 0) AS n_close, coalesce(am, 0) AS n_ambiguous, coalesce(mg, 0) AS max_gap FROM n LEFT JOIN q ON n.episode_id = q.episode_id""")
def _flagship(f: DataFrame) -> DataFrame:
    rows = f.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("valid"), 1)).alias("n_valid"), R6(F.avg(F.when(F.col("valid"), F.col("value")))).alias("mean_value"))
    one = lambda c: F.count(F.when(c, 1))
    found = _events(f).groupBy(*BY).agg(F.count(F.lit(1)).alias("n_events"), one(F.col("transition") == "close").alias("n_close"), one(F.col("ambiguous")).alias("n_ambiguous"), R6(F.max("invalid_gap")).alias("max_gap"))
    return rows.join(found, BY, "left").fillna(0, ["n_events", "n_close", "n_ambiguous"]).fillna(0.0, ["max_gap"])
