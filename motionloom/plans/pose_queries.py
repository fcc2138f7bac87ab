"""Queries of the geometry, statistics and pairing operators over the poses proxy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.functions import geometry as geo
from motionloom.functions import hands
from motionloom.functions import scalars as sc
from motionloom.operators import corrections as co
from motionloom.operators import events as ev
from motionloom.operators import guards, numeric, runs, stats
from motionloom.operators import resample as rs

from . import sqltext as q
from .proxies import POINTS_SQL, POSES_SQL, R6, TRACKS_SQL, hand_points, poses, tracks
from .registry import ORACLES, QUERIES

POS, QUAT = ["px", "py", "pz"], ["qx", "qy", "qz", "qw"]
BY, ORDER = ["episode_id"], "frame_idx"


def query(name: str, sql: str | None = None, proxy=poses, ctes: str = POSES_SQL):
    """Register a function of the poses proxy (or another); sql follows its CTE p."""

    def add(function):
        QUERIES[name] = lambda spark, sf_dir: function(proxy(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH {ctes}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return function

    return add


def track_query(name: str, sql: str | None = None):
    """Of the tracks proxy; sql follows its CTE k."""
    return query(name, sql, tracks, TRACKS_SQL)


def hand_query(name: str, sql: str | None = None):
    """Of the key points proxy; sql follows its CTE h."""
    return query(name, sql, hand_points, POINTS_SQL)


def _p(names: list[str]) -> tuple:
    return tuple(F.col(n) for n in names)


def _named(values: tuple, names: str) -> list:
    return [R6(v + 0.0).alias(n) for v, n in zip(values, names.split(), strict=True)]


def _steps(p: DataFrame) -> DataFrame:
    """Each pose with the one before (b...), within its episode."""
    from motionloom.operators.runs import series

    w = series(BY, ORDER)
    return p.withColumns({"b" + c: F.lag(c).over(w) for c in POS + QUAT}).filter("bpx is not null")


_STEPS = ", s AS (SELECT *, " + ", ".join(f"lag({c}) OVER w AS b{c}" for c in ["px", "py", "pz", "qx", "qy", "qz", "qw"]) + " FROM p WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx)), t AS (SELECT * FROM s WHERE bpx IS NOT NULL)"
_M = {
    "m0": "1-2*(qy*qy+qz*qz)", "m1": "2*(qx*qy-qz*qw)", "m2": "2*(qx*qz+qy*qw)", "m3": "2*(qx*qy+qz*qw)", "m4": "1-2*(qx*qx+qz*qz)",
    "m5": "2*(qy*qz-qx*qw)", "m6": "2*(qx*qz-qy*qw)", "m7": "2*(qy*qz+qx*qw)", "m8": "1-2*(qx*qx+qy*qy)",
}
_MAT = ", m AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _M.items()) + " FROM p)"
_KEYS = "episode_id, frame_idx, "


@query("f1_transform_point", _MAT + f" SELECT {_KEYS}round(m0*px+m1*py+m2*pz, 6)+0 AS x, round(m3*px+m4*py+m5*pz, 6)+0 AS y, round(m6*px+m7*py+m8*pz, 6)+0 AS z FROM m")
def _f1(p: DataFrame) -> DataFrame:
    return p.select("episode_id", "frame_idx", *_named(geo.matrix_vector(geo.matrix(_p(QUAT)), _p(POS)), "x y z"))


@query("f2_rotation_vector", f""", a AS (SELECT *, sqrt(qx*qx+qy*qy+qz*qz) AS n, CASE WHEN qw < 0 THEN -1.0 ELSE 1.0 END AS sg FROM p), b AS (SELECT *, CASE WHEN n > 1e-12 THEN 2*atan2(n, qw*sg)*sg/n ELSE 0 END AS k FROM a)
       SELECT {_KEYS}round(qx*k, 6)+0 AS x, round(qy*k, 6)+0 AS y, round(qz*k, 6)+0 AS z FROM b""")
def _f2(p: DataFrame) -> DataFrame:
    return p.select("episode_id", "frame_idx", *_named(geo.rotation_vector(_p(QUAT)), "x y z"))


@query("f2_log_exp_round_trip", f" SELECT {_KEYS}round(CASE WHEN qw < 0 THEN -qx ELSE qx END, 6)+0 AS x, round(abs(qw), 6)+0 AS w FROM p")
def _f2b(p: DataFrame) -> DataFrame:
    q = geo.from_rotation_vector(geo.rotation_vector(_p(QUAT)))
    return p.select("episode_id", "frame_idx", *_named((q[0], q[3]), "x w"))


@query("f9_six_numbers", _MAT + f" SELECT {_KEYS}round(m0, 6)+0 AS a, round(m3, 6)+0 AS b, round(m2, 6)+0 AS c, round(m8, 6)+0 AS d FROM m")
def _f9(p: DataFrame) -> DataFrame:
    back = geo.from_six_numbers(geo.six_numbers(geo.matrix(_p(QUAT))))
    return p.select("episode_id", "frame_idx", *_named((back[0], back[3], back[2], back[8]), "a b c d"))


@query("f10_standardised", ", g AS (SELECT episode_id, avg(px) AS mu, stddev_pop(px) AS sd, quantile_cont(px, 0.01) AS q1, quantile_cont(px, 0.99) AS q9 FROM p GROUP BY episode_id) SELECT p.episode_id, frame_idx, round((px - mu) / (sd + 1e-8), 6)+0 AS z, round((px + 1) / 2 * (q9 - q1 + 1e-6) + q1, 6)+0 AS u FROM p JOIN g ON p.episode_id = g.episode_id")
def _f10(p: DataFrame) -> DataFrame:
    g = p.groupBy(*BY).agg(F.avg("px").alias("mu"), F.stddev_pop("px").alias("sd"), F.percentile("px", 0.01).alias("q1"), F.percentile("px", 0.99).alias("q9"))
    x = p.join(g, BY)
    return x.select("episode_id", "frame_idx", *_named((sc.standardised(F.col("px"), F.col("mu"), F.col("sd")), sc.from_quantiles(F.col("px"), F.col("q1"), F.col("q9"))), "z u"))


@query("f11_geodesic_angle", _STEPS + f" SELECT {_KEYS}round(degrees(2*acos(least(1.0, abs(qx*bqx+qy*bqy+qz*bqz+qw*bqw)))), 5) AS degrees FROM t")
def _f11(p: DataFrame) -> DataFrame:
    return _steps(p).select("episode_id", "frame_idx", F.round(geo.angle_degrees(_p(QUAT), _p(["b" + c for c in QUAT])), 5).alias("degrees"))


@query("f11_slerp_middle", _STEPS + f""", d AS (SELECT *, qx*bqx+qy*bqy+qz*bqz+qw*bqw AS dt FROM t), h AS (SELECT *, CASE WHEN dt < 0 THEN -1 ELSE 1 END AS sg FROM d),
       k AS (SELECT *, sqrt((qx+sg*bqx)**2+(qy+sg*bqy)**2+(qz+sg*bqz)**2+(qw+sg*bqw)**2) AS n FROM h)
       SELECT {_KEYS}round((sg*qx+bqx)/n, 5)+0 AS x, round((sg*qw+bqw)/n, 5)+0 AS w FROM k""")
def _f11b(p: DataFrame) -> DataFrame:
    q = geo.slerp(_p(["b" + c for c in QUAT]), _p(QUAT), F.lit(0.5))
    return _steps(p).select("episode_id", "frame_idx", (F.round(q[0], 5) + 0.0).alias("x"), (F.round(q[3], 5) + 0.0).alias("w"))


_P, _Q = ("px", "py", "pz"), ("qx", "qy", "qz", "qw")


@query("f12_mirrored", f" SELECT {_KEYS}round(-px, 6)+0 AS x, round(-qy, 6)+0 AS y, round(-qz, 6)+0 AS z, round(640 - (320 + px), 6)+0 AS cx, round(240 + py, 6)+0 AS cy FROM p")
def _f12(p: DataFrame) -> DataFrame:
    a, b = geo.mirrored(_p(POS), _p(QUAT))
    _, _, cx, cy = geo.mirrored_intrinsics(F.lit(300.0), F.lit(300.0), 320 + F.col("px"), 240 + F.col("py"), F.lit(640.0))
    return p.select("episode_id", "frame_idx", *_named((a[0], b[1], b[2], cx, cy), "x y z cx cy"))


@query("f13_gripper", f" SELECT {_KEYS}round(least(1.0, greatest(0.0, (px + 0.5) / 1.0)), 6)+0 AS share, CASE WHEN px >= 0.1 THEN 1 ELSE 0 END AS closed FROM p")
def _f13(p: DataFrame) -> DataFrame:
    return p.select("episode_id", "frame_idx", R6(sc.gripper_share(F.col("px"), -0.5, 0.5) + 0.0).alias("share"), sc.gripper_closed(F.col("px"), 0.1).alias("closed"))


@query("f14_euler", _MAT + f" SELECT {_KEYS}round(atan2(m7, m8), 6)+0 AS roll, round(asin(greatest(-1.0, least(1.0, -m6))), 6)+0 AS pitch, round(atan2(m3, m0), 6)+0 AS yaw FROM m")
def _f14(p: DataFrame) -> DataFrame:
    return p.select("episode_id", "frame_idx", *_named(geo.euler_xyz(geo.matrix(_p(QUAT))), "roll pitch yaw"))


_TOOL_SQL, _ARM_SQL = ("0.1", "-0.02", "0.05"), (("0.3", "0.1", "-0.2", "sqrt(0.86)"), ("0.5", "-0.4", "0.2"))


def _tool() -> tuple:
    return tuple(F.lit(x) for x in (0.1, -0.02, 0.05))


def _arm() -> tuple:
    """A pose: quaternion and translation."""
    return tuple(map(F.lit, (0.3, 0.1, -0.2, 0.86**0.5))), tuple(map(F.lit, (0.5, -0.4, 0.2)))


@query("f16_composed_tool", f" SELECT {_KEYS}" + q.rounded(q.add(q.rotated(_ARM_SQL[0], q.add(q.rotated(_Q, _TOOL_SQL), _P)), _ARM_SQL[1]), "x y z") + " FROM p")
def _f16(p: DataFrame) -> DataFrame:
    """The tool's tip in the arm's base: arm, hand and tool one behind the other."""
    hand = geo.pose_product(*_arm(), _p(QUAT), _p(POS))
    tip = geo.pose_product(*hand, (F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), _tool())[1]
    return p.select("episode_id", "frame_idx", *_named(tip, "x y z"))


@query("f21_reframed", f" SELECT {_KEYS}" + q.rounded(q.back_rotated(_ARM_SQL[0], q.sub(_P, _ARM_SQL[1])), "x y z") + ", " + q.rounded(q.times(q.inverse(_ARM_SQL[0]), _Q)[:1] + q.back_rotated(_ARM_SQL[0], _P)[:1], "q v") + " FROM p")
def _f21(p: DataFrame) -> DataFrame:
    """Poses in another frame; directions turn only."""
    turned, moved = geo.pose_in(*_arm(), _p(QUAT), _p(POS))
    return p.select("episode_id", "frame_idx", *_named((*moved, turned[0], geo.rotate(geo.conjugate(_arm()[0]), _p(POS))[0]), "x y z q v"))


@query("f8_projected", f""", a AS (SELECT *, 300 * px / nullif(pz, 0) + 320 AS u, 300 * py / nullif(pz, 0) + 240 AS v FROM p), b AS (SELECT *, coalesce(pz > 0 AND u >= 0 AND u < 640 AND v >= 0 AND v < 480, false) AS inside FROM a)
       SELECT {_KEYS}round(CASE WHEN inside THEN u ELSE 0 END, 4) AS u, round(CASE WHEN inside THEN v ELSE 0 END, 4) AS v, inside FROM b""")
def _f8(p: DataFrame) -> DataFrame:
    u, v, inside = geo.projected(_p(POS), 300.0, 300.0, 320.0, 240.0, 640.0, 480.0)
    return p.select("episode_id", "frame_idx", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"), inside.alias("inside"))


@query("f4_grasp_ratio", f""", a AS (SELECT *, sqrt(px*px+py*py+pz*pz) AS tip, sqrt(qx*qx+qy*qy+qz*qz) AS palm FROM p) SELECT {_KEYS}round(CASE WHEN palm > 0.01 THEN tip / palm END, 6) AS ratio FROM a""")
def _f4(p: DataFrame) -> DataFrame:
    return p.select("episode_id", "frame_idx", R6(sc.grasp_ratio(_p(POS), _p(QUAT[:3]))).alias("ratio"))


@query("f6_confidence", f" SELECT {_KEYS}round(greatest(0.05, least(0.99, 1 / (1 + exp(200 * (abs(px) / 10 - 0.025))))), 6) AS confidence FROM p")
def _f6(p: DataFrame) -> DataFrame:
    return p.select("episode_id", "frame_idx", R6(sc.reprojection_confidence(F.abs("px") / 10)).alias("confidence"))


@query("f15_arm_mask", f" SELECT {_KEYS}round(px, 6)+0 AS a, 0.0::DOUBLE AS b, round(pz, 6)+0 AS c FROM p")
def _f15(p: DataFrame) -> DataFrame:
    masked = p.withColumn("m", sc.arm_masked(F.array(*POS), [True, False, True]))
    return masked.select("episode_id", "frame_idx", *_named((F.col("m")[0], F.col("m")[1], F.col("m")[2]), "a b c"))


_BAD = "CASE frame_idx % 4 WHEN 1 THEN 1.00002 WHEN 2 THEN -1 WHEN 3 THEN 'nan'::DOUBLE ELSE 1 END"


@query("p2_rigid_matrix", _MAT + f" SELECT {_KEYS}frame_idx % 4 IN (0, 1) AS loose, frame_idx % 4 = 0 AS strict, round(m0*(m4*m8-m5*m7)-m1*(m3*m8-m5*m6)+m2*(m3*m7-m4*m6), 5) AS det FROM m")
def _p2(p: DataFrame) -> DataFrame:
    """Every second matrix's first row is stretched, mirrored or not a number; stretching passes the loose tolerance only."""
    m = geo.matrix(_p(QUAT))
    k = F.when(F.col("frame_idx") % 4 == 1, 1.00002).when(F.col("frame_idx") % 4 == 2, -1.0).when(F.col("frame_idx") % 4 == 3, float("nan")).otherwise(1.0)
    bad = (*[k * x for x in m[:3]], *m[3:])
    return p.select("episode_id", "frame_idx", geo.is_rotation(bad, 1e-4).alias("loose"), geo.is_rotation(bad, 1e-6).alias("strict"), F.round(geo.determinant(m), 5).alias("det"))


@query("p14_step_limits", _STEPS.replace("WHERE bpx IS NOT NULL", "") + f", d AS (SELECT *, sqrt((px-bpx)**2+(py-bpy)**2+(pz-bpz)**2) AS s FROM t) SELECT {_KEYS}s > 0.3 + 1e-12 AS too_far, degrees(2*acos(least(1.0, abs(qx*bqx+qy*bqy+qz*bqz+qw*bqw)))) > 90 + 1e-9 AS too_turned FROM d")
def _p14(p: DataFrame) -> DataFrame:
    return guards.step_faults(p, BY, ORDER, POS, QUAT, 0.3, 90.0).select("episode_id", "frame_idx", "too_far", "too_turned")


@query("p14_joint_faults", f""", b AS (SELECT *, lag(px) OVER {q.W} AS bx, lag(py) OVER {q.W} AS by_ FROM p) SELECT {_KEYS}CASE WHEN px NOT BETWEEN -0.2 AND 0.2 OR py NOT BETWEEN -0.15 AND 0.25 THEN 'out of range'
       WHEN greatest(abs(px - bx), abs(py - by_)) > 0.15 + 1e-12 THEN 'step too large' END AS fault, round(greatest(-0.2, least(0.2, px * 0.3)), 6) + 0 AS clipped FROM b""")
def _p14b(p: DataFrame) -> DataFrame:
    w = runs.series(BY, ORDER)
    joints = p.withColumns({"j": F.array("px", "py"), "small": F.array(F.col("px") * 0.3)}).withColumn("b", F.lag("j").over(w))
    clipped = guards.bounded_joints(F.col("small"), [-0.2], [0.2], 10.0)
    return joints.select("episode_id", "frame_idx", guards.joint_faults(F.col("j"), F.col("b"), [-0.2, -0.15], [0.2, 0.25], 0.15).alias("fault"), (R6(clipped[0]) + 0.0).alias("clipped"))


@query("p15_workspace", f""" SELECT {_KEYS}CASE WHEN abs(px) > 0.2 THEN 'x outside' WHEN abs(py) > 0.2 THEN 'y outside' WHEN NOT pz BETWEEN -0.1 AND 0.3 THEN 'z outside' WHEN frame_idx % 3 = 0 THEN 'quaternion length' END AS fault,
       CASE WHEN least(1.0, abs(px)) > 0.1 THEN 0.0 ELSE -3.4 END::DOUBLE AS gripper FROM p""")
def _p15(p: DataFrame) -> DataFrame:
    long = tuple(F.when(F.col("frame_idx") % 3 == 0, 1.2 * F.col(c)).otherwise(F.col(c)) for c in QUAT)
    fault = guards.workspace_fault(_p(POS), long, [(-0.2, 0.2), (-0.2, 0.2), (-0.1, 0.3)])
    gripper = guards.gripper_command(F.least(F.lit(1.0), F.abs("px")), 0.1, -3.4, 0.0)
    return p.select("episode_id", "frame_idx", fault.alias("fault"), gripper.alias("gripper"))


@track_query("p1_pose_validation", f""", a AS (SELECT *, lag(t) OVER {q.W} AS t0, CASE WHEN frame_idx % 100 = 7 THEN 1.01 ELSE 1 END * sqrt(qx*qx+qy*qy+qz*qz+qw*qw) AS n FROM k)
       SELECT episode_id, bool_and(t0 IS NULL OR t > t0) AS increasing, bool_and(state IN (0, 1)) AS binary_state, bool_and(NOT valid OR isfinite(px)) AS finite, bool_and(NOT valid OR abs(n - 1) <= 1.01e-3) AS unit, count(*) AS n_rows FROM a GROUP BY episode_id""")
def _p1(k: DataFrame) -> DataFrame:
    long = k.withColumns({c: F.when(F.col("frame_idx") % 100 == 7, 1.01 * F.col(c)).otherwise(F.col(c)) for c in QUAT})
    return guards.trajectory_rules(long, BY, ORDER, "t", "state", "valid", POS, QUAT)


@query("w27_continuous_quaternions", _STEPS.replace("t AS (SELECT * FROM s WHERE bpx IS NOT NULL)", "t AS (SELECT *, sum(CASE WHEN qx*bqx+qy*bqy+qz*bqz+qw*bqw < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY frame_idx) % 2 AS odd FROM s)") + f" SELECT {_KEYS}round(CASE WHEN odd = 1 THEN -qx ELSE qx END, 6)+0 AS x, round(CASE WHEN odd = 1 THEN -qw ELSE qw END, 6)+0 AS w FROM t")
def _w27(p: DataFrame) -> DataFrame:
    return rs.uninterrupted_signs(p, BY, ORDER, QUAT).select("episode_id", "frame_idx", *_named(_p(["qx", "qw"]), "x w"))


@track_query("g10_rotation_correction", f" SELECT {_KEYS}round(CASE WHEN valid THEN qx*cos(0.1) - qy*sin(0.1) ELSE qx END, 6)+0 AS x, round(CASE WHEN valid THEN qw*cos(0.1) + qz*sin(0.1) ELSE qw END, 6)+0 AS w FROM k")
def _g10(k: DataFrame) -> DataFrame:
    bias = (F.lit(0.0), F.lit(0.0), F.sin(F.lit(0.1)), F.cos(F.lit(0.1)))
    return co.corrected_rotations(k, "valid", QUAT, bias).select("episode_id", "frame_idx", *_named(_p(["qx", "qw"]), "x w"))


_PREV = ("x.px", "x.py", "x.pz"), ("x.qx", "x.qy", "x.qz", "x.qw")


@track_query("g18_pose_deviation", f""", s AS (SELECT *, row_number() OVER {q.W} AS i FROM k), d AS (SELECT n.episode_id, n.frame_idx, CASE WHEN n.valid AND x.valid THEN {q.norm(q.sub(("n.px", "n.py", "n.pz"), _PREV[0]))} END AS m,
       CASE WHEN n.valid AND x.valid THEN {q.degrees_between(("n.qx", "n.qy", "n.qz", "n.qw"), _PREV[1])} END AS g FROM s n LEFT JOIN s x ON n.episode_id = x.episode_id AND n.i = x.i + 1) SELECT {_KEYS}round(m, 6) AS metres, round(g, 5) AS degrees FROM d""")
def _g18(k: DataFrame) -> DataFrame:
    """A series against itself one row late; nothing where either pose is missing."""
    w = runs.series(BY, ORDER)
    late = k.withColumns({"b" + c: F.lag(c).over(w) for c in [*POS, *QUAT, "valid"]})
    metres, degrees = geo.pose_deviation(_p(POS), _p(QUAT), _p(["b" + c for c in POS]), _p(["b" + c for c in QUAT]))
    both = F.col("valid") & F.coalesce("bvalid", F.lit(False))
    return late.select("episode_id", "frame_idx", F.when(both, R6(metres)).alias("metres"), F.when(both, F.round(degrees, 5)).alias("degrees"))


_SEEN = q.back_rotated(_ARM_SQL[0], q.sub(_P, _ARM_SQL[1]))
_RAY = q.rotated(_ARM_SQL[0], ("rx", "ry", "1.0"))
_RAY_SQL = f""", c AS (SELECT *, {_SEEN[0]} AS sx, {_SEEN[1]} AS sy, {_SEEN[2]} AS sz FROM p), r AS (SELECT *, sx / sz AS rx, sy / sz AS ry FROM c WHERE abs(sz) >= 1e-3), v AS (SELECT *, {_RAY[0]} AS vx, {_RAY[1]} AS vy, {_RAY[2]} AS vz FROM r),
      t AS (SELECT *, {q.dot(("vx", "vy", "vz"), q.sub(("qx", "qy", "qz"), _ARM_SQL[1]))} / greatest({q.dot(("vx", "vy", "vz"), ("vx", "vy", "vz"))}, 1e-12) AS deep FROM v)"""


@query("g8_ray_depth", _RAY_SQL + f" SELECT {_KEYS}round(sz, 6) AS depth, round(deep - sz, 5) + 0 AS delta, round({_ARM_SQL[1][0]} + vx * deep, 5) + 0 AS x, round({q.norm(q.sub(q.add(_ARM_SQL[1], q.scale('deep', ('vx', 'vy', 'vz'))), ('qx', 'qy', 'qz')))}, 5) + 0 AS residual, round({_ARM_SQL[1][0]} + vx * (sz + 0.1), 5) + 0 AS deeper FROM t")
def _g8(p: DataFrame) -> DataFrame:
    """Each position's camera ray, and the point on it that is nearest to a target (the quaternion's vector part)."""
    far = p.filter(F.abs(geo.seen_from(*_arm(), _p(POS))[2]) >= 1e-3)  # the camera's plane has no rays
    ray = geo.on_ray(_p(POS), _p(QUAT[:3]), *_arm())
    moved = geo.deeper(_p(POS), F.lit(0.1), *_arm())
    return far.select("episode_id", "frame_idx", R6(ray["depth"]).alias("depth"), *[(F.round(v, 5) + 0.0).alias(n) for v, n in ((ray["delta"], "delta"), (ray["point"][0], "x"), (ray["residual"], "residual"), (moved[0], "deeper"))])


@track_query("g8_ray_correction")
def _g8b(k: DataFrame) -> DataFrame:
    """Series drawn along camera rays to a target at their first event; a test holds it against NumPy."""
    events = ev.transitions(k, BY, ORDER, "t", "state", "valid", 1.0)
    targets = k.sparkSession.createDataFrame([("0", None, 0.1, 0.05, 0.2)], "anchor string, transition string, px double, py double, pz double")
    camera = (tuple(map(F.lit, (0.0, 0.0, 0.0, 1.0))), tuple(map(F.lit, (0.0, 0.0, -4.0))))
    done = co.corrected_positions(k, events, targets, BY, ORDER, "valid", POS, ["0"], "linear", camera)
    return done.select("episode_id", "frame_idx", *_named(_p(POS), "px py pz"), "reason")


@track_query("g1_resampled_poses", f""", z AS (SELECT episode_id, min(t) AS a, max(t) AS b FROM k GROUP BY episode_id), n AS (SELECT *, greatest(2, round_even((b - a) * 7.0, 0)::BIGINT + 1) AS c FROM z),
      tg AS (SELECT episode_id, i AS sample, CASE WHEN i = c - 1 THEN b ELSE a + i * ((b - a) / (c - 1)) END AS tt FROM (SELECT *, unnest(range(c)) AS i FROM n)),
      lf AS (SELECT tg.*, x.t AS pt, x.px AS ax, x.qx AS a1, x.qy AS a2, x.qz AS a3, x.qw AS a4, x.valid AS pok FROM tg ASOF LEFT JOIN k x ON tg.episode_id = x.episode_id AND tg.tt > x.t),
      rt AS (SELECT lf.*, x.t AS nt, x.px AS bx, x.qx AS b1, x.qy AS b2, x.qz AS b3, x.qw AS b4, x.valid AS nok FROM lf ASOF LEFT JOIN k x ON lf.episode_id = x.episode_id AND lf.tt <= x.t),
      y AS (SELECT *, nt IS NOT NULL AND abs(nt - tt) <= 1e-10 + 1e-5 * abs(tt) AS hit, coalesce(pok AND nok AND nt - pt <= 1.5, false) AS ok, (tt - pt) / (nt - pt) AS al FROM rt)
      SELECT episode_id, sample, round(tt, 6) AS t, round(CASE WHEN hit THEN CASE WHEN nok THEN bx END WHEN ok THEN ax + al * (bx - ax) END, 6) + 0 AS px, round(CASE WHEN hit THEN CASE WHEN nok THEN b1 END WHEN ok THEN {q.between(("a1", "a2", "a3", "a4"), ("b1", "b2", "b3", "b4"), "al")[0]} END, 5) + 0 AS qx,
             round(CASE WHEN hit THEN CASE WHEN nok THEN b4 END WHEN ok THEN {q.between(("a1", "a2", "a3", "a4"), ("b1", "b2", "b3", "b4"), "al")[3]} END, 5) + 0 AS qw, CASE WHEN hit THEN nok ELSE ok END AS valid FROM y""")
def _g1(k: DataFrame) -> DataFrame:
    """Poses on a grid of seven a second: positions linear, rotations on the shorter arc."""
    found = rs.resampled(k, BY, "t", "valid", 1.5, rate=7.0, linear=POS, quaternions=[QUAT])
    return found.select("episode_id", "sample", R6("t").alias("t"), (R6("px") + 0.0).alias("px"), *[(F.round(c, 5) + 0.0).alias(c) for c in ("qx", "qw")], "valid")


@track_query("g11_short_gap_poses", f""", i AS (SELECT *, row_number() OVER {q.W} AS i FROM k), b AS (SELECT n.*, x.px AS ax, x.qx AS a1, x.qy AS a2, x.qz AS a3, x.qw AS a4, x.state AS st, y.px AS bx, y.qx AS b1, y.qy AS b2, y.qz AS b3, y.qw AS b4, n.valid OR (coalesce(x.valid AND y.valid, false)) AS ok
      FROM i n LEFT JOIN i x ON n.episode_id = x.episode_id AND x.i = n.i - 1 LEFT JOIN i y ON n.episode_id = y.episode_id AND y.i = n.i + 1)
      SELECT episode_id, i AS row_number, round(CASE WHEN valid OR NOT ok THEN px ELSE (ax + bx) / 2 END, 6) + 0 AS px, round(CASE WHEN valid OR NOT ok THEN qx ELSE {q.between(("a1", "a2", "a3", "a4"), ("b1", "b2", "b3", "b4"), "0.5")[0]} END, 5) + 0 AS qx, CASE WHEN valid OR NOT ok THEN state ELSE st END::INT AS state, ok AS valid FROM b""")
def _g11(k: DataFrame) -> DataFrame:
    """Gaps of one row between valid ones take the pose half way, and the state before."""
    rows = k.withColumn("i", F.row_number().over(runs.series(BY, ORDER)).cast("long"))
    found = rs.bridged(rows, BY, "i", "valid", 1, POS, [QUAT], ["state"])
    return found.select("episode_id", F.col("i").alias("row_number"), (R6("px") + 0.0).alias("px"), (F.round("qx", 5) + 0.0).alias("qx"), "state", "valid")


_REL = q.times(q.inverse(("x.qx", "x.qy", "x.qz", "x.qw")), ("n.qx", "n.qy", "n.qz", "n.qw"))


@track_query("w19_pose_speed", f""", i AS (SELECT *, row_number() OVER {q.W} AS i FROM k), d AS (SELECT n.episode_id, n.frame_idx, n.valid, x.valid AS ok, (n.px - x.px) / 0.1 AS vx, {_REL[0]} AS rx, {q.norm(_REL[:3])} AS rn, {_REL[3]} AS rw FROM i n LEFT JOIN i x ON n.episode_id = x.episode_id AND x.i = n.i - 1)
      SELECT {_KEYS}CASE WHEN valid THEN round(CASE WHEN ok THEN vx ELSE 0 END, 5) + 0 END AS vx, CASE WHEN valid THEN round(CASE WHEN ok THEN rx * 2 * atan2(rn, rw * CASE WHEN rw < 0 THEN -1 ELSE 1 END) * CASE WHEN rw < 0 THEN -1 ELSE 1 END / rn / 0.1 ELSE 0 END, 4) + 0 END AS wx FROM d""")
def _w19(k: DataFrame) -> DataFrame:
    found = runs.pose_speed(k, BY, ORDER, POS, QUAT, F.lit(0.1), "valid", bridge=False)
    return found.select("episode_id", "frame_idx", (F.round(F.col("linear")[0], 5) + 0.0).alias("vx"), (F.round(F.col("angular")[0], 4) + 0.0).alias("wx"))


@query("x9_wireframe", _MAT + f""", s AS (SELECT unnest([0, 1, 2, 3]) AS seg, unnest([-0.05, 0.05, -0.05, 0.05]) AS lx, unnest([0.0, 0.0, 0.1, 0.1]) AS lz)
       SELECT {_KEYS}seg::BIGINT AS segment, round(px + m0*lx + m2*lz, 6)+0 AS x, round(py + m3*lx + m5*lz, 6)+0 AS y, round(pz + m6*lx + m8*lz, 6)+0 AS z FROM m CROSS JOIN s""")
def _x9(p: DataFrame) -> DataFrame:
    corner = lambda x, z: F.struct(F.lit(x).alias("lx"), F.lit(z).alias("lz"))
    each = p.select("*", F.posexplode(F.array(corner(-0.05, 0.0), corner(0.05, 0.0), corner(-0.05, 0.1), corner(0.05, 0.1))).alias("segment", "c"))
    m = geo.matrix_vector(geo.matrix(_p(QUAT)), (F.col("c.lx"), F.lit(0.0), F.col("c.lz")))
    return each.select("episode_id", "frame_idx", F.col("segment").cast("long").alias("segment"), *_named(tuple(F.col(a) + b for a, b in zip(POS, m, strict=True)), "x y z"))


@query("a8_column_statistics", """, e AS (SELECT episode_id, unnest([0, 1, 2]) AS dim, unnest([px, py, pz]) AS x FROM p)
       SELECT episode_id, dim, count(x) AS n, round(min(x), 6) AS "min", round(max(x), 6) AS "max", round(avg(x), 6)+0 AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.1), 6)+0 AS q10, round(quantile_cont(x, 0.5), 6)+0 AS q50, round(quantile_cont(x, 0.99), 6)+0 AS q99 FROM e GROUP BY episode_id, dim""")
def _a8(p: DataFrame) -> DataFrame:
    found = stats.column_statistics(p.withColumn("v", F.array(*POS)), BY, "v")
    return found.select("episode_id", "dim", "n", *[(R6(c) + 0.0).alias(c) for c in ("min", "max", "mean", "std", "q10", "q50", "q99")])


@query("a11_shrunk_gaussian", """, c AS (SELECT episode_id, count(*) AS n, avg(px) AS m, covar_samp(px, px) AS xx, covar_samp(py, py) AS yy, covar_samp(pz, pz) AS zz, covar_samp(px, py) AS xy FROM p GROUP BY episode_id)
       SELECT episode_id, n, round(m, 6)+0 AS mean_px, round(0.9*xx + 0.1*greatest((xx+yy+zz)/3, 1e-10) + 1e-10, 6) AS cov_xx, round(0.9*xy, 6)+0 AS cov_xy FROM c WHERE n >= 2""")
def _a11(p: DataFrame) -> DataFrame:
    g = stats.shrunk_gaussian(p, BY, POS, 0.1)
    return g.select("episode_id", "n", (R6("mean_px") + 0.0).alias("mean_px"), R6("cov_pxpx").alias("cov_xx"), (R6("cov_pxpy") + 0.0).alias("cov_xy"))


def _centroids(p: DataFrame) -> DataFrame:
    return p.groupBy(*BY).agg(*[F.avg(c).alias(c) for c in POS])


_CENTROIDS = ", c AS (SELECT episode_id, avg(px) AS px, avg(py) AS py, avg(pz) AS pz FROM p GROUP BY episode_id)"
_PAIRS = _CENTROIDS + ", q AS (SELECT a.episode_id AS a, b.episode_id AS b, sqrt((a.px-b.px)**2+(a.py-b.py)**2+(a.pz-b.pz)**2) AS d FROM c a JOIN c b ON a.episode_id < b.episode_id)"


def _pair_distances(p: DataFrame) -> DataFrame:
    c = _centroids(p)
    pairs = stats.unordered_pairs(c, [], "episode_id")
    side = lambda x: c.select(F.col("episode_id").alias(x), *[F.col(n).alias(x + n) for n in POS])
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", geo.norm(tuple(F.col("a" + n) - F.col("b" + n) for n in POS)).alias("d"))


@query("j2_unordered_pairs", _PAIRS + " SELECT a, b, round(d, 6) AS d FROM q")
def _j2(p: DataFrame) -> DataFrame:
    return _pair_distances(p).withColumn("d", R6("d"))


@query("a3_noise_floor", _PAIRS + ", u AS (SELECT a AS item, d FROM q UNION ALL SELECT b, d FROM q) SELECT item, round(avg(d), 6) AS floor FROM u GROUP BY item")
def _a3(p: DataFrame) -> DataFrame:
    return stats.noise_floor(_pair_distances(p), [], "d").withColumn("floor", R6("floor"))


@query("a4_floor_summary", _PAIRS + ", u AS (SELECT a AS item, d FROM q UNION ALL SELECT b, d FROM q), f AS (SELECT item, avg(d) AS floor FROM u GROUP BY item) SELECT count(*) AS n, round(1000 * avg(floor), 6) AS mean_mm, round(1000 * stddev_pop(floor), 6) AS std_mm FROM f")
def _a4(p: DataFrame) -> DataFrame:
    f = stats.noise_floor(_pair_distances(p), [], "d")
    return f.agg(F.count(F.lit(1)).alias("n"), R6(1000 * F.avg("floor")).alias("mean_mm"), R6(1000 * F.stddev_pop("floor")).alias("std_mm"))


@query("a3_leave_one_out_offset", _CENTROIDS + ", s AS (SELECT sum(px) AS sx, sum(py) AS sy, sum(pz) AS sz, count(*) AS n FROM c) SELECT episode_id, round(sqrt((px-(sx-px)/(n-1))**2+(py-(sy-py)/(n-1))**2+(pz-(sz-pz)/(n-1))**2), 6) AS offset_m FROM c CROSS JOIN s")
def _a3b(p: DataFrame) -> DataFrame:
    return stats.leave_one_out_offset(_centroids(p), [], POS).select("episode_id", R6("offset").alias("offset_m"))


@query("a3_complete_cohort", _PAIRS + " SELECT 10 AS n_items, count(*) AS n_pairs, count(*) = 45 AS complete FROM q")
def _a3c(p: DataFrame) -> DataFrame:
    return stats.complete_cohort(_pair_distances(p), []).select("n_items", "n_pairs", "complete").withColumn("n_items", F.col("n_items").cast("int"))


@query("a7_eta_dispersion", _PAIRS + " SELECT round(avg(d) FILTER (WHERE a % 2 = 0 AND b % 2 = 0) / avg(d) FILTER (WHERE a % 2 = 1 AND b % 2 = 1), 6) AS eta FROM q")
def _a7(p: DataFrame) -> DataFrame:
    both = lambda k: F.avg(F.when((F.col("a") % 2 == k) & (F.col("b") % 2 == k), F.col("d")))
    return _pair_distances(p).agg(R6(both(0) / both(1)).alias("eta"))


@query("a5_ratio_metrics", _PAIRS + f""", f AS (SELECT avg(d) AS fp, avg(d * 12) AS fr, avg(d / 2) AS fs FROM q), rc AS (SELECT avg(px) AS rx, avg(py) AS ry, avg(pz) AS rz FROM c WHERE episode_id >= 7),
       o AS (SELECT avg(sqrt((px-rx)**2+(py-ry)**2+(pz-rz)**2)) AS fo FROM c CROSS JOIN rc WHERE episode_id >= 7), r AS (SELECT a % 2 AS variant, a AS ego, avg(d) AS dp, avg(d * 10) AS dr, avg(d * d) AS ds FROM q WHERE a < 7 AND b >= 7 GROUP BY a),
       e AS (SELECT r.*, sqrt((px-rx)**2+(py-ry)**2+(pz-rz)**2) AS dofs FROM r JOIN c ON ego = episode_id CROSS JOIN rc)
       SELECT variant, count(*) AS n_ego, round(avg(dp / fp), 6) AS rho_pos, round(avg(dr / fr), 6) AS rho_rot, round(avg(ds / fs), 6) AS rho_shape, round(avg(dofs / fo), 6) AS rho_offset, round(avg(sqrt(dp / fp * (dr / fr))), 6) AS rho_se3 FROM e CROSS JOIN f CROSS JOIN o GROUP BY variant""")
def _a5(p: DataFrame) -> DataFrame:
    """Seven egos against three references, over floors of all pairs."""
    d, c = _pair_distances(p), _centroids(p)
    real = c.filter("episode_id >= 7")
    middle = real.agg(*[F.avg(x).alias(f"r{x}") for x in POS], F.count(F.lit(1)).alias("n_references"))
    off = real.crossJoin(F.broadcast(middle)).agg(F.avg(geo.norm(tuple(F.col(x) - F.col(f"r{x}") for x in POS))).alias("floor_offset"))  # one row each
    floors = d.agg(F.avg("d").alias("floor_pos"), F.avg(F.col("d") * 12).alias("floor_rot"), F.avg(F.col("d") / 2).alias("floor_shape")).crossJoin(off).crossJoin(middle.withColumnsRenamed({f"r{x}": x for x in POS}))
    records = d.filter("a < 7 and b >= 7").withColumnRenamed("a", "episode_id").join(c, "episode_id")
    records = records.select((F.col("episode_id") % 2).alias("variant"), F.col("episode_id").alias("ego"), F.col("d").alias("d_pos"), (F.col("d") * 10).alias("d_rot"), (F.col("d") * F.col("d")).alias("d_shape"), *POS)
    found = stats.ratio_metrics(records, floors, ["variant"], "ego", POS)
    return found.select("variant", "n_ego", *[R6(x).alias(x) for x in ("rho_pos", "rho_rot", "rho_shape", "rho_offset", "rho_se3")])


@query("g4_normalised_time", """, k AS (SELECT episode_id, px, py, pz, row_number() OVER (PARTITION BY episode_id ORDER BY frame_idx) - 1 AS i, count(*) OVER (PARTITION BY episode_id) AS n FROM p),
       j AS (SELECT k.episode_id, s.i AS step, px, py, pz FROM k JOIN (SELECT unnest(range(10)) AS i) s ON k.i = round_even(s.i * (n - 1) / 9.0, 0))
       SELECT a.episode_id AS a, b.episode_id AS b, round(avg(sqrt((a.px-b.px)**2+(a.py-b.py)**2+(a.pz-b.pz)**2)), 6) AS d FROM j a JOIN j b ON a.step = b.step AND a.episode_id < b.episode_id GROUP BY 1, 2""")
def _g4(p: DataFrame) -> DataFrame:
    """Pairs are made of ids; each then fetches its ten poses by equality."""
    lists = _pose_lists(p, 10)
    side = lambda x: lists.select(F.col("episode_id").alias(x), F.col("pose").alias(f"pose_{x}"))
    pairs = stats.unordered_pairs(p.select(*BY).distinct(), [], "episode_id").join(side("a"), "a").join(side("b"), "b")
    gap = F.transform(F.arrays_zip("pose_a", "pose_b"), lambda z: geo.norm(tuple(z["pose_a"][k] - z["pose_b"][k] for k in range(3))))
    return pairs.select("a", "b", R6(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.size(gap)).alias("d"))


def _pose_lists(p: DataFrame, count: int) -> DataFrame:
    t = rs.thinned(p, BY, ORDER, count)
    rows = F.sort_array(F.collect_list(F.struct("frame_idx", F.array(*POS, *QUAT).alias("v"))))
    return t.groupBy(*BY).agg(F.transform(rows, lambda r: r["v"]).alias("pose"))


def _aligned(p: DataFrame) -> DataFrame:
    """All pairs of a cohort, aligned; ids are paired, and each fetches its poses by equality."""
    lists = _pose_lists(p, 40)
    side = lambda x: lists.select(F.col("episode_id").alias(x), F.col("pose").alias(f"pose_{x}"))
    pairs = stats.unordered_pairs(p.select(*BY).distinct(), [], "episode_id")
    return numeric.align_pairs(pairs.join(side("a"), "a").join(side("b"), "b"), 0.5)


@query("g3_g5_dtw_pair_metrics")
def _g3(p: DataFrame) -> DataFrame:
    return _aligned(p).select("a", "b", *[R6(c).alias(c) for c in ("d_pos", "d_rot", "d_shape")])


@query("a13_rotation_bias")
def _a13(p: DataFrame) -> DataFrame:
    """The mean rotation from the later to the earlier episodes of all pairs."""
    return co.rotation_bias(_aligned(p), []).select("n_ego", "n_pairs", *[R6(c).alias(c) for c in ("qx", "qy", "qz", "qw", "angle_deg", "spread_deg")])


@track_query("a12_fitted_anchors")
def _a12(k: DataFrame) -> DataFrame:
    events = ev.transitions(k, BY, ORDER, "t", "state", "valid", 9.0)
    found = co.fitted_anchors(k, events, BY, ORDER, "valid", POS, QUAT, ["start", "0", "1", "end"])
    return found.select("anchor", "n", "transition", "fault", *[R6(c).alias(c) for c in ("mean_px", "cov_pxpx", "cov_pxpy", "qx", "qw")])


@track_query("a12_anchor_positions", f""", g AS (SELECT *, lag(state) OVER w AS s0, lag(t) OVER w AS t0, lag(frame_idx) OVER w AS i0 FROM k WHERE valid WINDOW w AS {q.W}),
      e AS (SELECT *, row_number() OVER {q.W} - 1 AS ordinal, frame_idx - i0 > 1 AND t - t0 > 9.0 AS ambiguous FROM g WHERE s0 <> state), bad AS (SELECT DISTINCT episode_id FROM e WHERE ambiguous),
      a AS (SELECT ordinal::VARCHAR AS anchor, * FROM e WHERE ordinal < 2 AND NOT ambiguous AND episode_id NOT IN (SELECT episode_id FROM bad))
      SELECT anchor, count(*) AS n, CASE WHEN min(state) <> max(state) THEN 'several transitions' END AS fault, round(avg(px), 6) + 0 AS mean_px, round(0.9 * covar_samp(px, py), 6) + 0 AS cov_pxpy FROM a GROUP BY anchor HAVING count(*) >= 2""")
def _a12b(k: DataFrame) -> DataFrame:
    """The part of the fit that SQL can express, of healthy series."""
    events = ev.transitions(k, BY, ORDER, "t", "state", "valid", 9.0)
    found = co.fitted_anchors(k, events, BY, ORDER, "valid", POS, QUAT, ["0", "1"])
    return found.select("anchor", "n", "fault", (R6("mean_px") + 0.0).alias("mean_px"), (R6("cov_pxpy") + 0.0).alias("cov_pxpy"))


def _numeric(name: str, columns: list[str], function, out_type: str = "double"):
    @query(name)
    def run(p: DataFrame) -> DataFrame:
        found = numeric.per_series(p, BY, ORDER, columns, function, "value", out_type)
        return found.withColumn("value", R6("value")) if out_type == "double" else found


def _stack(*c) -> np.ndarray:
    return np.stack(c, axis=1)


def _thirds(p: DataFrame) -> DataFrame:
    """px at a third and two thirds of each series, null elsewhere."""
    w = runs.series(BY, ORDER)
    placed = p.withColumns({"i": (F.row_number().over(w) - 1).cast("long"), "n": F.count(F.lit(1)).over(runs.whole(BY, ORDER))})
    at = (F.col("i") == F.floor(F.col("n") / 3)) | (F.col("i") == F.floor(2 * F.col("n") / 3))
    return placed.withColumn("value", F.when(at, F.col("px"))).select("episode_id", "frame_idx", "i", "value")


_G6_SQL = f""", a AS (SELECT episode_id, frame_idx, px, row_number() OVER {q.W} - 1 AS i, count(*) OVER (PARTITION BY episode_id) AS n FROM p), b AS (SELECT *, CASE WHEN i IN (n // 3, 2 * n // 3) THEN px WHEN i IN (0, n - 1) THEN 0 END AS c FROM a),
      z AS (SELECT *, last_value(CASE WHEN c IS NOT NULL THEN i END IGNORE NULLS) OVER u AS x0, first_value(CASE WHEN c IS NOT NULL THEN i END IGNORE NULLS) OVER v AS x1, last_value(c IGNORE NULLS) OVER u AS y0, first_value(c IGNORE NULLS) OVER v AS y1 FROM b
            WINDOW u AS (PARTITION BY episode_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      SELECT episode_id, frame_idx, round(CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (i - x0) / (x1 - x0) ELSE y0 END, 6) + 0 AS value FROM z"""


def _g6(method: str, sql: str | None = None) -> None:
    @query(f"g6_propagate_{method}", sql)
    def run(p: DataFrame) -> DataFrame:
        found = co.propagated(_thirds(p), BY, ORDER, ["value"], method)
        return found.select("episode_id", "frame_idx", (R6("value") + 0.0).alias("value"))


_g6("linear", _G6_SQL)
_g6("min_bending")
_g6("smooth_spline")
_numeric("g12_savitzky_golay", ["px"], lambda x: numeric.savitzky_golay(x, 7))
_numeric("g13_step_limiter", [*POS, *QUAT], lambda *c: numeric.limited_poses(_stack(*c[:3]), _stack(*c[3:]), np.ones(len(c[0]), bool), 0.05, 0.1)[0][:, 0])
_numeric("g13_turn_limiter", [*POS, *QUAT], lambda *c: numeric.limited_poses(_stack(*c[:3]), _stack(*c[3:]), np.ones(len(c[0]), bool), 0.05, 0.1)[1][:, 3])
_numeric("g14_smoothed_frames", [*POS, *QUAT], lambda *c: numeric.smoothed_frames(_stack(*c[:3]), _stack(*c[3:6]), 0.3, 0.2)[:, 0, 1])
_numeric("w22_debounce", ["px"], lambda x: numeric.debounced([int(v > 0) for v in x], 3), "int")
_numeric("w23_w24_flip_short_runs", ["px"], lambda x: numeric.flipped_short_runs([int(v > 0) for v in x], 2), "int")


_numeric("w23_grasp_by_distance", ["px"], lambda x: numeric.grasp_by_distance(np.abs(x), 0.1, 5, 2), "int")
_numeric("w24_grasp_by_state", ["px"], lambda x: numeric.grasp_by_state([int(v > 0) for v in x], 5, 2), "int")
def _xyz(name: str) -> tuple[str, ...]:
    return tuple(f"k{hands.POINTS[name]}{c}" for c in "xyz")


def _angle_sql(a: tuple, b: tuple) -> str:
    return f"degrees(acos(greatest(-1.0, least(1.0, {q.dot(a, b)} / (({q.norm(a)} + 1e-6) * ({q.norm(b)} + 1e-6))))))"


_SIDE = q.cross(q.sub(_xyz("index_mcp"), _xyz("wrist")), q.sub(_xyz("middle_mcp"), _xyz("wrist")))
_FLAT = lambda v: q.sub(v, tuple(f"({q.dot(v, ('nx', 'ny', 'nz'))} * {n})" for n in ("nx", "ny", "nz")))
_AHEAD = q.sub(_xyz("middle_pip"), _xyz("middle_mcp"))
_ANGLES = {
    "Index_MCP_Flex": _angle_sql(q.sub(_xyz("index_mcp"), _xyz("wrist")), q.sub(_xyz("index_pip"), _xyz("index_mcp"))),
    "Ring_PIP_Flex": _angle_sql(q.sub(_xyz("ring_pip"), _xyz("ring_mcp")), q.sub(_xyz("ring_dip"), _xyz("ring_pip"))),
    "Pinky_DIP_Flex": _angle_sql(q.sub(_xyz("pinky_dip"), _xyz("pinky_pip")), q.sub(_xyz("pinky_tip"), _xyz("pinky_dip"))),
    "Pinky_MCP_Abd": _angle_sql(_FLAT(q.sub(_xyz("pinky_pip"), _xyz("pinky_mcp"))), _FLAT(_AHEAD)),
    "Thumb_CMC_Flex": _angle_sql(q.sub(_xyz("middle_mcp"), _xyz("wrist")), q.sub(_xyz("thumb_mcp"), _xyz("wrist"))),
    "Thumb_CMC_Abd": _angle_sql(_FLAT(q.sub(_xyz("thumb_mcp"), _xyz("wrist"))), _FLAT(_AHEAD)),
    "Thumb_IP_Flex": _angle_sql(q.sub(_xyz("thumb_ip"), _xyz("thumb_mcp")), q.sub(_xyz("thumb_tip"), _xyz("thumb_ip"))),
    "Middle_MCP_Abd": "0.0::DOUBLE",
}
_NORMAL = ", ".join(f"{v} / ({q.norm(_SIDE)} + 1e-6) AS n{c}" for v, c in zip(_SIDE, "xyz", strict=True))


@hand_query("f5_joint_angles", f", n AS (SELECT *, {_NORMAL} FROM h) SELECT {_KEYS}20 AS n_angles, " + ", ".join(f"round({v}, 4) AS {k}" for k, v in _ANGLES.items()) + " FROM n")
def _f5(h: DataFrame) -> DataFrame:
    found = h.withColumn("a", hands.joint_angles(F.col("points")))
    return found.select("episode_id", "frame_idx", F.size("a").alias("n_angles"), *[F.round(F.col("a")[k], 4).alias(k) for k in _ANGLES])


@hand_query("f7_reordered_points", f" SELECT {_KEYS}round(k4x, 6) + 0 AS thumb_tip, round(k3y, 6) + 0 AS thumb_ip, round(k19z, 6) + 0 AS pinky_dip, round((k0x + k5x + k9x) / 3, 6) + 0 AS palm, 21 AS n FROM h")
def _f7(h: DataFrame) -> DataFrame:
    r = h.withColumn("r", hands.remapped(F.col("points")))
    at = lambda name, k: hands.point(F.col("r"), name)[k]
    return r.select("episode_id", "frame_idx", *_named((at("thumb_tip", 0), at("thumb_ip", 1), at("pinky_dip", 2), at("palm", 0)), "thumb_tip thumb_ip pinky_dip palm"), F.size("r").alias("n"))


def _axes_sql(mode: str) -> str:
    """Jaw, forward and up by mode, row after row; the wrist's or the frame before where the points span none."""
    m = hands.MODES[mode]
    tip = _xyz("index_tip") if m.index == 1.0 else q.add(q.scale(m.index, _xyz("index_tip")), q.scale(round(1 - m.index, 9), _xyz("middle_tip")))
    jaw = q.sub(tip, _xyz("thumb_tip")) if m.jaw_from_tips else q.sub(_xyz("index_mcp"), _xyz("thumb_mcp"))
    forward = q.sub(tip if m.jaw_from_tips else q.mean(*[_xyz(n) for n in m.forward_to]), _xyz("wrist"))
    along = q.sub(_xyz("palm"), _xyz("wrist"))
    cols = lambda v, n: ", ".join(f"{x} AS {n}{c}" for x, c in zip(v, "xyz", strict=True))
    name = lambda n: (f"{n}x", f"{n}y", f"{n}z")
    over = lambda v, n: tuple(f"({x} / {n})" for x in v)
    side = q.sub(_xyz("index_mcp"), _xyz("middle_mcp"))
    pos = q.scale(0.5, q.add(_xyz("thumb_tip"), tip))
    return f""", a AS (SELECT episode_id, frame_idx, {cols(pos, "o")}, {cols(jaw, "j")}, {cols(forward, "f")}, {cols(along, "l")}, {cols(side, "s")} FROM h), b AS (SELECT *, {q.norm(name("j"))} AS jn, {q.norm(name("l"))} AS ln FROM a),
      c AS (SELECT *, jn > 1e-8 AS own, {cols(over(name("j"), "nullif(jn, 0)"), "u")}, {cols(q.cross(over(name("l"), "nullif(ln, 0)"), name("s")), "w")} FROM b), d AS (SELECT *, {q.norm(name("w"))} AS wn FROM c),
      e AS (SELECT *, CASE WHEN ln >= 1e-6 AND wn >= 1e-6 THEN wx / wn END AS wjx, CASE WHEN ln >= 1e-6 AND wn >= 1e-6 THEN wy / wn END AS wjy, CASE WHEN ln >= 1e-6 AND wn >= 1e-6 THEN wz / wn END AS wjz FROM d),
      g AS (SELECT *, coalesce(last_value(CASE WHEN own THEN ux END IGNORE NULLS) OVER bw, first_value(wjx IGNORE NULLS) OVER bw) AS bx, coalesce(last_value(CASE WHEN own THEN uy END IGNORE NULLS) OVER bw, first_value(wjy IGNORE NULLS) OVER bw) AS by_,
                   coalesce(last_value(CASE WHEN own THEN uz END IGNORE NULLS) OVER bw, first_value(wjz IGNORE NULLS) OVER bw) AS bz FROM e WINDOW bw AS (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      i AS (SELECT *, CASE WHEN sum(CASE WHEN own AND bx * ux + by_ * uy + bz * uz < 0 THEN 1 ELSE 0 END) OVER {q.W} % 2 = 1 THEN -1 ELSE 1 END AS sg, {cols(q.cross(name("u"), name("f")), "v")} FROM g),
      z AS (SELECT *, {q.norm(name("v"))} AS vn FROM i)
      SELECT episode_id, frame_idx, round(ox, 6) + 0 AS x, round(coalesce(last_value(CASE WHEN own THEN sg * ux END IGNORE NULLS) OVER n, first_value(wjx IGNORE NULLS) OVER n), 5) + 0 AS jaw_x, round(last_value(CASE WHEN own THEN vx / vn END IGNORE NULLS) OVER n, 5) + 0 AS up_x
      FROM z WINDOW n AS (PARTITION BY episode_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)"""


def _framed(mode: str, name: str) -> None:
    @hand_query(name, _axes_sql(mode))
    def run(h: DataFrame) -> DataFrame:
        found = hands.gripper_axes(h.withColumn("right", F.lit(True)), BY, ORDER, "points", "right", hands.gripper_mode(mode))
        own = F.max(F.when(F.col("frame_idx") % 7 != 0, 1) if not hands.MODES[mode].jaw_from_tips else F.lit(1)).over(runs.series(BY, ORDER))
        return found.select("episode_id", "frame_idx", *_named((F.col("position")[0],), "x"), (F.round(F.col("axes")[0][0], 5) + 0.0).alias("jaw_x"), F.when(own == 1, F.round(F.col("axes")[2][0], 5) + 0.0).alias("up_x"))


_framed("finger_center", "f3_hand_frame")
_framed("humanego", "x2_humanego_frame")
_framed("qwen", "x2_qwen_frame")


@hand_query("f22_initial_grasp", f""", a AS (SELECT *, {q.norm(q.sub(_xyz("thumb_tip"), _xyz("index_tip")))} AS tip, {q.norm(q.sub(_xyz("middle_mcp"), _xyz("wrist")))} AS palm, {q.norm(q.sub(_xyz("palm"), _xyz("wrist")))} AS along FROM h)
       SELECT {_KEYS}CASE WHEN palm > 0.01 THEN tip / palm < 1.0 ELSE tip < 0.105 END AS grasped, along >= 1e-6 AS has_wrist FROM a""")
def _f22(h: DataFrame) -> DataFrame:
    mode = hands.gripper_mode("finger_center")
    ratio = mode.ratio(F.col("points"))
    grasped = F.when(ratio.isNotNull(), ratio < 1.0).otherwise(mode.distance(F.col("points")) < 0.105)
    return h.select("episode_id", "frame_idx", grasped.alias("grasped"), hands.wrist_axes(F.col("points")).isNotNull().alias("has_wrist"))


@hand_query("f6_recovered_depth", f""", a AS (SELECT *, {q.norm(q.sub(("k9x", "k9y", "k9z"), ("k0x", "k0y", "k0z")))} AS size, 100 * sqrt((k9x - k0x)**2 + (k9y - k0y)**2) AS px FROM h), b AS (SELECT *, 305.0 * CASE WHEN size < 0.01 THEN 0.085 ELSE size END / CASE WHEN px >= 5 THEN px END AS z FROM a)
       SELECT {_KEYS}CASE WHEN z BETWEEN 0.05 AND 3.0 THEN round((320 + 100 * k0x - 320) * z / 300 + k3x - k0x, 5) + 0 END AS x, CASE WHEN z BETWEEN 0.05 AND 3.0 THEN round(greatest(0.01, z + k3z - k0z), 5) + 0 END AS z FROM b""")
def _f6(h: DataFrame) -> DataFrame:
    flat = F.transform("points", lambda p: F.array(320 + 100 * p[0], 240 + 100 * p[1]))
    found = hands.recovered(flat, F.col("points"), 300.0, 310.0, 320.0, 240.0)
    return h.select("episode_id", "frame_idx", (F.round(found[3][0], 5) + 0.0).alias("x"), (F.round(found[3][2], 5) + 0.0).alias("z"))


@hand_query("x3_gripper_export")
def _x3(h: DataFrame) -> DataFrame:
    """Hands to gripper poses: axes and grasps, debounced, moved to the tool, and no faster than the limits."""
    mode = hands.gripper_mode("finger_center")
    framed = hands.gripper_axes(h.withColumn("right", F.lit(True)), BY, ORDER, "points", "right", mode)
    framed = framed.withColumns({"ratio": mode.ratio(F.col("points")), "distance": mode.distance(F.col("points"))})
    latched = runs.hysteresis(framed, BY, ORDER, "ratio", 0.45, 0.55, distance="distance")
    m = [F.col("axes")[c][r] for r in range(3) for c in range(3)]  # axes are columns
    quat = geo.from_matrix(tuple(m))
    rows = latched.select("episode_id", "frame_idx", "state", *[v.alias(n) for v, n in zip(quat, QUAT, strict=True)], *[F.col("position")[k].alias(n) for k, n in enumerate(POS)])
    tool = geo.pose_product(_p(QUAT), _p(POS), (F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), _tool())[1]
    rows = rows.withColumns({f"t{c}": v for c, v in zip(POS, tool, strict=True)})

    def limits(state, *c):
        p, t = numeric.limited_poses(_stack(*c[:3]), _stack(*c[3:]), np.isfinite(c[3]), 0.05, 0.1)
        steady = numeric.debounced([int(x) for x in state], 3)
        return [[float(x) for x in (*a, *b, s)] for a, b, s in zip(p, t, steady, strict=True)]

    done = numeric.per_series(rows, BY, ORDER, ["state", *[f"t{c}" for c in POS], *QUAT], limits, "out", "array<double>")
    return done.select("episode_id", "frame_idx", *[F.round(F.col("out")[k], 6).alias(n) for k, n in enumerate([*POS, *QUAT])], F.col("out")[7].cast("int").alias("state"))
