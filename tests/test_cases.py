"""Known cases of loaders, corrections, limits and metrics, and the errors that they must give."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.functions import geometry as geo
from motionloom.functions import hands
from motionloom.functions import scalars as sc
from motionloom.operators import corrections as co
from motionloom.operators import datasets as ds
from motionloom.operators import events as ev
from motionloom.operators import guards, numeric, runs, stats
from motionloom.operators import resample as rs
from motionloom.plans import config
from motionloom.sources import sinks, trajectories

from .test_operators import BY, ORDER, column, ego_file, series


@pytest.mark.parametrize(
    ("changes", "fault"),
    [
        ({"total_frames": 9}, "total_frames differs"), ({"fps": 0.0}, "no positive fps"), ({"schema": "x"}, "another schema"),
        ({"eef_coordinate_convention": {"pose_semantics": "wrist", "per_side_frames": {"right": "base", "left": "base"}}}, None),
    ],
)
def test_ego_files_that_cannot_be_taken(spark, tmp_path, changes, fault):
    rows = trajectories.read_ego_json(spark, ego_file(tmp_path, **changes))
    found = {(r.side, r.fault) for r in trajectories.faults(rows, "dual_arm", 2, "tcp").collect()}
    assert found == ({("left", fault), ("right", fault)} if fault else set())
    other = {r.fault for r in trajectories.faults(rows.filter("side = 'right'"), "dual_arm", 2, "another").collect()}
    assert other == {"other pose semantics"} or fault == "another schema"


def test_real_files_of_another_convention(spark, tmp_path):
    pose = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
    arm = {"output_frame": "base", "T_tcp_in_output_frame": pose, "gripper": {"binary": 0}}
    body = {"schema": "fk", "schema_version": 1, "gripper_convention": {"binary_open": 1, "binary_closed": 0}, "frames": [{"timestamp_s": i / 10, "arms": {"left": arm, "right": arm}} for i in range(3)]}
    (tmp_path / "a.json").write_text(json.dumps(body))
    assert {r.fault for r in trajectories.faults(trajectories.read_real_json(spark, str(tmp_path)), "fk", 1).collect()} == {"gripper convention"}
    del body["gripper_convention"]
    body["frames"][1]["arms"]["left"] = arm | {"output_frame": "camera"}
    (tmp_path / "a.json").write_text(json.dumps(body))
    assert {(r.side, r.fault) for r in trajectories.faults(trajectories.read_real_json(spark, str(tmp_path)), "fk", 1).collect()} == {("left", "not one frame name")}


def test_identical_poses_align_without_cost(spark, tmp_path):
    rows = trajectories.read_ego_json(spark, ego_file(tmp_path)).filter("side = 'right'").withColumnsRenamed({"episode_id": "e", "frame_idx": "i"})
    timed = rs.resolved_times(rows.withColumn("ts", F.col("ts").cast("double")), ["e"], "i", "timestamp_s", "ts", "fps")
    events = ev.transitions(timed, ["e"], "i", "t", "state", "valid", 0.5)
    part = ev.segments(timed, events, ["e"], "i", 0, 2)
    assert [r.i for r in part.orderBy("i").collect()] == [2, 3, 4, 5, 6]
    flat = part.select("e", "t", "valid", *[F.get("pose", k).alias(n) for k, n in enumerate(["x", "y", "z", "a", "b", "c", "d"])])
    grid = rs.resampled(flat, ["e"], "t", "valid", 0.5, 20, linear=["x", "y", "z"], quaternions=[["a", "b", "c", "d"]]).orderBy("sample").collect()
    path = np.array([[r.x, r.y, r.z] for r in grid])
    turn = np.array([[r.a, r.b, r.c, r.d] for r in grid])
    assert len(grid) == 20 and np.allclose(path[:, 0], np.linspace(0.02, 0.06, 20)) and np.allclose(turn, [0, 0, 0, 1])
    found = numeric.pair_distances(path, turn, path, turn, 0.5)
    assert found["d_pos"] == found["d_shape"] == 0 and found["d_rot"] < 1e-6


def test_segments_with_faults(spark):
    df = series(spark, s=[0, 1, 1, 0, 0], ok=[True, True, False, True, True], t=[0.0, 5.0, 6.0, 20.0, 21.0])
    events = ev.transitions(df, BY, ORDER, "t", "s", "ok", 2.0)
    fault = lambda a, b: ev.segment_bounds(df, events, BY, ORDER, a, b).first().fault
    assert fault("first", None) is None and fault(0, "last") == "event last is ambiguous" and fault(2, None) == "no event 2" and fault(0, 0) == "the end is not after the start" and fault(-1, None) == "no event -1"
    assert ev.segments(df, events, BY, ORDER, "first", "last").count() == 0 and ev.segments(df, events, BY, ORDER, 0, None).count() == 4


def test_a_target_just_before_a_row_takes_it_but_not_one_just_after(spark):
    df = series(spark, t=[0.0, 10.0, 20.0001], ok=[True, True, False], x=[0.0, 1.0, 2.0])
    middle = rs.resampled(df, BY, "t", "ok", 100.0, 3, linear=["x"]).orderBy("sample").collect()[1]
    assert abs(middle.t - 10.00005) < 1e-9 and not middle.ok and middle.x is None
    df = series(spark, t=[0.0, 10.0001, 20.0], ok=[True, False, True], x=[0.0, 1.0, 2.0])
    middle = rs.resampled(df, BY, "t", "ok", 100.0, 3, linear=["x"]).orderBy("sample").collect()[1]
    assert middle.t == 10.0 and not middle.ok
    with pytest.raises(Exception, match="without duration"):
        rs.resampled(series(spark, t=[1.0], ok=[True], x=[1.0]), BY, "t", "ok", 1.0, 3, linear=["x"]).collect()
    assert rs.target_times(series(spark, t=[0.0, 2.0], ok=[True, True]), BY, "t", rate=4.0).count() == 9


def test_ratio_metrics_of_the_cohort_itself_are_one(spark):
    pairs = spark.createDataFrame([(0, 1, 1.0, 10.0, 0.5), (0, 2, 2.0, 20.0, 1.0), (1, 2, 3.0, 30.0, 1.5)], "a long, b long, d double, r double, s double")
    points = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 3.0)], "e long, x double")
    floor = lambda c: stats.noise_floor(pairs, [], c).agg(F.avg("floor")).first()[0]
    offset = stats.leave_one_out_offset(points, [], ["x"]).agg(F.avg("offset")).first()[0]
    assert (floor("d"), floor("r"), floor("s")) == (2.0, 20.0, 1.0) and np.isclose(offset, 5 / 3)
    assert stats.complete_cohort(pairs, []).first().complete and not stats.complete_cohort(pairs.filter("a = 0"), []).first().complete
    kinds = "floor_pos double, floor_rot double, floor_shape double, floor_offset double, n_references long, x double"
    floors = spark.createDataFrame([(2.0, 20.0, 1.0, 5 / 3, 3, 4 / 3)], kinds)
    records = spark.createDataFrame([("v", 9, 2.0, 20.0, 1.0, 3.0)] * 3, "variant string, ego long, d_pos double, d_rot double, d_shape double, x double")
    found = stats.ratio_metrics(records, floors, ["variant"], "ego", ["x"]).first()
    assert found.n_ego == 1 and np.allclose([found.rho_pos, found.rho_rot, found.rho_shape, found.rho_offset, found.rho_se3], 1)
    for bad, what in ((records.limit(2), "other references"), (records, "floor of shape")):
        broken = floors if what == "other references" else floors.withColumn("floor_shape", F.lit(0.0))
        with pytest.raises(Exception, match=what):
            stats.ratio_metrics(bad, broken, ["variant"], "ego", ["x"]).collect()


def test_merged_statistics_need_the_same_groups(spark):
    rows = spark.createDataFrame([("a", 1, 2, 0.0, 1.0, 0.5, 0.5), ("b", 1, 2, 0.0, 1.0, 0.5, 0.5), ("a", 2, 2, 0.0, 1.0, 0.5, 0.5)], "src string, g long, n long, min double, max double, mean double, std double")
    with pytest.raises(Exception, match="different groups"):
        stats.merged_statistics(rows, ["g"], "src").collect()
    assert stats.merged_statistics(rows.filter("g = 1"), ["g"], "src").first().n == 4


def test_ray_depth_of_the_known_case(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    camera = lit(0, 0, 0, 1), lit(0, 0, 0)
    ray = geo.on_ray(lit(0, 0, 2), lit(1, 0, 4), *camera)
    row = spark.range(1).select(ray["depth"].alias("depth"), ray["delta"].alias("delta"), F.array(*ray["point"]).alias("point"), ray["residual"].alias("residual"), F.array(*geo.deeper(lit(1, 1, 2), F.lit(1.0), *camera)).alias("moved")).first()
    assert (row.depth, row.delta, row.point, row.residual) == (2.0, 2.0, [0.0, 0.0, 4.0], 1.0) and row.moved == [1.5, 1.5, 3.0]
    with pytest.raises(Exception, match="no ray"):
        spark.range(1).select(geo.on_ray(lit(1, 0, 0), lit(1, 0, 4), *camera)["delta"]).collect()


def test_series_meet_their_targets_at_anchors(spark):
    states = [0, 0, 1, 1, 1, 0, 0, 1, 1]
    df = series(spark, s=states, ok=[True] * 8 + [False], t=[float(i) for i in range(9)], x=[0.1 * i for i in range(9)], y=[1.0] * 9)
    df = df.unionByName(df.withColumn("e", F.lit(2).cast("long")).withColumn("s", F.lit(0)))
    events = ev.transitions(df, BY, ORDER, "t", "s", "ok", 2.0)
    targets = spark.createDataFrame([("start", None, 1.0, 1.0), ("0", "close", 0.0, 2.0), ("1", "open", 1.0, 1.0)], "anchor string, transition string, x double, y double")
    anchors = sorted(["1", "start", "0"], key=co.anchor_order)
    assert anchors == ["start", "0", "1"]
    for method in ("linear", "min_bending"):
        rows = co.corrected_positions(df, events, targets, BY, ORDER, "ok", ["x", "y"], anchors, method).orderBy("e", "i").collect()
        first = rows[:9]
        assert np.allclose([[first[i].x, first[i].y] for i in (0, 2, 5)], [[1, 1], [0, 2], [1, 1]]) and first[8].x == df.filter("e = 1 and i = 8").first().x
        assert all(r.reason is None for r in first) and all(r.reason == "0: no such event" and np.isclose(r.x, 0.1 * r.i) for r in rows[9:])
    wrong = targets.withColumn("transition", F.when(F.col("anchor") == "0", "open").otherwise(F.col("transition")))
    assert co.corrected_positions(df, events, wrong, BY, ORDER, "ok", ["x", "y"], anchors).filter("e = 1").first().reason == "0: another transition"
    camera = tuple(F.lit(float(v)) for v in (0, 0, 0, 1)), tuple(F.lit(float(v)) for v in (0, 0, -1))
    deep = df.withColumn("z", F.lit(1.0))
    goal = spark.createDataFrame([("0", None, 0.4, 2.0, 3.0)], "anchor string, transition string, x double, y double, z double")
    moved = co.corrected_positions(deep, events, goal, BY, ORDER, "ok", ["x", "y", "z"], ["0"], camera=camera).filter("e = 1").orderBy("i").collect()
    assert np.allclose([moved[2].x, moved[2].y, moved[2].z], [0.4, 2.0, 3.0]) and np.isclose(moved[1].z, 2.0) and np.isclose(moved[1].x, 0.1 * 1.5)
    for bad in ("middle", -1, True, "1.5"):
        with pytest.raises(ValueError):
            co.anchor_id(bad)


def test_fits_of_anchors_and_of_a_rotation(spark):
    rng = np.random.default_rng(3)
    rows = []
    for e in range(4):
        for i, s in enumerate([0, 0, 1, 1, 0]):
            rows.append((e, i, float(i), s, True, *rng.normal(size=3).tolist(), 0.0, 0.0, float(np.sin(0.05 * e)), float(np.cos(0.05 * e))))
    df = spark.createDataFrame(rows, "e long, i long, t double, s int, ok boolean, x double, y double, z double, qx double, qy double, qz double, qw double")
    events = ev.transitions(df, BY, ORDER, "t", "s", "ok", 2.0)
    found = {r.anchor: r for r in co.fitted_anchors(df, events, BY, ORDER, "ok", ["x", "y", "z"], ["qx", "qy", "qz", "qw"], ["start", "0", "7"]).collect()}
    at = np.array([r[5:8] for r in rows if r[1] == 2])
    cov = np.cov(at, rowvar=False, ddof=1)
    want = 0.9 * cov + 0.1 * np.trace(cov) / 3 * np.eye(3) + 1e-10 * np.eye(3)
    one = found["0"]
    assert set(found) == {"start", "0"} and one.n == 4 and one.transition == "close" and one.fault is None
    assert np.allclose([one.mean_x, one.cov_xx, one.cov_xy, one.cov_zz], [at[:, 0].mean(), want[0, 0], want[0, 1], want[2, 2]]) and np.isclose(one.qz, np.sin(0.075), atol=1e-6)
    pose = lambda turn: [[float(k), 0.0, 0.0, 0.0, 0.0, float(np.sin(turn / 2)), float(np.cos(turn / 2))] for k in range(5)]
    pairs = spark.createDataFrame([(a, b, pose(0.3 + 0.1 * a), pose(0.1)) for a in (0, 1) for b in (5, 6, 7)], "a long, b long, pose_a array<array<double>>, pose_b array<array<double>>")
    bias = co.rotation_bias(numeric.align_pairs(pairs), []).first()
    assert bias.n_ego == 2 and bias.n_pairs == 6 and np.isclose(bias.angle_deg, np.degrees(0.25)) and np.isclose(bias.spread_deg, np.degrees(0.05)) and bias.qz > 0


def test_pose_limits_of_the_known_case():
    q = np.array([[0, 0, 0, 1.0], [0, 0, np.sin(np.pi / 4), np.cos(np.pi / 4)]])
    p, turned = numeric.limited_poses(np.array([[0.0, 0, 0], [1.0, 0, 0]]), q, np.array([True, True]), 0.05, 0.1)
    assert np.allclose(p[1], [0.05, 0, 0]) and np.isclose(2 * np.arccos(turned[1, 3]), 0.1) and turned[1, 2] > 0
    same, kept = numeric.limited_poses(np.array([[0.0, 0, 0], [1.0, 0, 0]]), q, np.array([True, True]), 0.0, 0.0)
    assert np.allclose(same[1], [1, 0, 0]) and np.allclose(kept, q)
    axes = numeric.smoothed_frames(np.array([[1.0, 0, 0], [-1.0, 0.2, 0]]), np.array([[0, 1.0, 0], [0, 1.0, 0.3]]), 0.5, 0.5)
    assert np.allclose(axes[1].T @ axes[1], np.eye(3), atol=1e-5) and axes[1][0, 0] > 0
    assert numeric.filled_gaps(np.array([5.0, 0, 7.0, 0]), np.array([True, False, True, False])).tolist() == [5, 6, 7, 7]


def test_joint_approach():
    path = numeric.approach(np.zeros(3), np.array([0.1, 0.0, -0.25]), 0.1)
    assert len(path) == 3 and np.allclose(path[-1], [0.1, 0, -0.25]) and np.abs(np.diff(path, axis=0)).max() <= 0.1
    assert len(numeric.approach(np.zeros(2), np.zeros(2), 0.1)) == 0
    assert len(numeric.approach(np.zeros(1), np.ones(1), 0.5, reachable=lambda a, b: abs(b - a)[0] < 0.3)) == 4
    for options in ({"most_total": 0.5}, {"reachable": lambda a, b: False, "most_steps": 8}):
        with pytest.raises(ValueError):
            numeric.approach(np.zeros(1), np.ones(1), 0.5, **options)


def test_debounce_equals_repeated_absorption():
    def by_loop(states, least):
        known = [k for k, s in enumerate(states) if s is not None]
        x = [states[k] for k in known]
        while len(x) >= 3 and least > 1:
            cuts = [0, *[k for k in range(1, len(x)) if x[k] != x[k - 1]], len(x)]
            short = next((k for k in range(1, len(cuts) - 2) if cuts[k + 1] - cuts[k] < least), None)
            if short is None:
                break
            x[cuts[short] : cuts[short + 1]] = [x[cuts[short] - 1]] * (cuts[short + 1] - cuts[short])
        out = list(states)
        for k, s in zip(known, x, strict=True):
            out[k] = s
        return out

    rng = np.random.default_rng(1)
    for _ in range(300):
        states = [None if v == 3 else int(v) for v in rng.integers(0, 4, int(rng.integers(0, 25)))]
        for least in (1, 2, 3, 5):
            assert numeric.debounced(states, least) == by_loop(states, least)


def test_stops_are_refined_where_hands_move(spark):
    df = series(spark, m=[1, 0, 0, 0, 0, 0, 0, 0, 0, 1], v=[0.0, 9.0, 9.0, 0.0, 0.0, 0.0, 0.0, 0.0, 9.0, 0.0])
    assert column(runs.refine_stops(df, BY, ORDER, "m", "v", 1.0, 2, 1), "m") == [1, 3, 3, 3, 0, 0, 0, 3, 3, 1]
    never = df.withColumn("v", F.lit(None).cast("double"))
    assert column(runs.refine_stops(never, BY, ORDER, "m", "v", 1.0, 2, 1), "m") == [1, 3, 3, 3, 3, 3, 3, 3, 3, 1]
    assert column(runs.refine_stops(df.filter("i < 3"), BY, ORDER, "m", "v", 1.0, 5, 1), "m") == [1, 0, 0]


def test_speeds_reset_or_bridge_gaps(spark):
    half = [0.0, 0.0, 0.0, float(np.sin(0.1)), float(np.sin(0.1))]
    df = series(spark, ok=[True, True, False, True, True], x=[0.0, 1.0, 5.0, 3.0, 4.0], a=[0.0] * 5, b=[0.0] * 5, c=half, d=[float(np.sqrt(1 - s * s)) for s in half])
    speed = lambda bridge: runs.pose_speed(df, BY, ORDER, ["x"], ["a", "b", "c", "d"], F.lit(0.5), "ok", bridge)
    assert column(speed(False), "linear") == [[0.0], [2.0], None, [0.0], [2.0]] and column(speed(True), "linear") == [[0.0], [2.0], None, [4.0], [2.0]]
    assert np.isclose(column(speed(True), "angular")[3][2], 0.4) and column(speed(False), "angular")[3] == [0.0, 0.0, 0.0]
    assert column(speed(False), "acceleration") == [None, None, None, None, None] and column(speed(True), "acceleration") == [None, None, None, None, -4.0]


def hand(scale=1.0, jaw=(1.0, 0.0, 0.0)):
    """A palm of a tenth of a metre in the plane, with a jaw direction."""
    points = np.zeros((21, 3))
    names = hands.POINTS
    points[names["middle_mcp"]] = points[names["palm"]] = [0, 0.1, 0]
    for k, name in enumerate(("index_mcp", "ring_mcp", "pinky_mcp")):
        points[names[name]] = [0.02 - 0.02 * k, 0.1, 0]
    points[names["thumb_mcp"]] = points[names["index_mcp"]] - 0.03 * np.array(jaw)
    points[names["thumb_tip"]], points[names["index_tip"]] = [0, 0.15, 0], [0.1 * scale, 0.15, 0]
    return points.tolist()


def test_hands_become_grippers(spark):
    mode = hands.gripper_mode("finger_center")
    rows = [(1, i, hand(r), True) for i, r in enumerate([0.6, 0.5, 0.4, 0.5, 0.6])]
    df = spark.createDataFrame(rows, "e long, i long, p array<array<double>>, right boolean").withColumn("r", mode.ratio(F.col("p")))
    assert np.allclose(column(df, "r"), [0.6, 0.5, 0.4, 0.5, 0.6]) and column(runs.hysteresis(df, BY, ORDER, "r", 0.45, 0.55), "state") == [0, 0, 1, 1, 0]
    flat = [hand(jaw=(0.0, 0.0, 0.0)), hand(), hand(jaw=(-1.0, 0.0, 0.0)), hand(jaw=(0.0, 0.0, 0.0)), hand(jaw=(-0.9, 0.1, 0.0))]
    df = spark.createDataFrame([(1, i, p, True) for i, p in enumerate(flat)], "e long, i long, p array<array<double>>, right boolean")
    axes = [np.array(r.axes) for r in hands.gripper_axes(df, BY, ORDER, "p", "right", mode).orderBy("i").collect()]
    assert all(np.allclose(a @ a.T, np.eye(3), atol=1e-9) and np.isclose(np.linalg.det(a), 1) for a in axes)
    assert all(a[0] @ b[0] > 0.9 for a, b in zip(axes[1:], axes[2:], strict=False)) and abs(axes[0][0] @ axes[1][0]) < 1e-9 and np.allclose(axes[2], axes[3])
    with pytest.raises(ValueError, match="no mode"):
        hands.gripper_mode("tongs")
    angles = spark.range(1).select(hands.joint_angles(F.lit(None).cast("array<array<double>>")).alias("none")).first()
    assert angles.none is None


def test_joint_angles_stay_a_small_expression_and_equal_numpy(spark):
    assert len(str(hands.joint_angles(F.col("p")))) < 200_000  # it is part of the plan, which the driver holds
    rng = np.random.default_rng(5)
    p = rng.normal(size=(21, 3))
    v = lambda a, b: p[hands.POINTS[b]] - p[hands.POINTS[a]]
    angle = lambda a, b: np.degrees(np.arccos(np.clip(a @ b / ((np.linalg.norm(a) + 1e-6) * (np.linalg.norm(b) + 1e-6)), -1, 1)))
    side = np.cross(v("wrist", "index_mcp"), v("wrist", "middle_mcp"))
    normal = side / (np.linalg.norm(side) + 1e-6)
    flat = lambda a: a - (a @ normal) * normal
    ahead = flat(v("middle_mcp", "middle_pip"))
    expected = {"Thumb_CMC_Flex": angle(v("wrist", "middle_mcp"), v("wrist", "thumb_mcp")), "Thumb_CMC_Abd": angle(flat(v("wrist", "thumb_mcp")), ahead), "Middle_MCP_Abd": 0.0}
    expected |= {"Thumb_MCP_Flex": angle(v("wrist", "thumb_mcp"), v("thumb_mcp", "thumb_ip")), "Thumb_IP_Flex": angle(v("thumb_mcp", "thumb_ip"), v("thumb_ip", "thumb_tip"))}
    for finger in hands.FINGERS:
        chain = ["wrist", *[f"{finger}_{j}" for j in ("mcp", "pip", "dip", "tip")]]
        bones = [v(a, b) for a, b in zip(chain, chain[1:], strict=False)]
        expected |= {f"{finger.capitalize()}_{j}_Flex": angle(a, b) for j, a, b in zip(("MCP", "PIP", "DIP"), bones, bones[1:], strict=False)}
        if finger != "middle":
            expected[f"{finger.capitalize()}_MCP_Abd"] = angle(flat(bones[1]), ahead)
    df = spark.createDataFrame([(p.tolist(),), (p[:20].tolist(),)], "p array<array<double>>")
    whole, short = (r.a for r in df.select(hands.joint_angles(F.col("p")).alias("a")).collect())
    assert short is None and whole.keys() == expected.keys() and all(np.isclose(whole[k], x, atol=1e-9) for k, x in expected.items())


def test_guards(spark):
    one = spark.range(1)
    array = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one.select(guards.bounded_joints(array(1.0005, -2), [-1, -2], [1, 2], 0.001).alias("q")).first().q == [1.0, -2.0]
    for bad in (array(1.1, 0), array(float("nan"), 0)):
        with pytest.raises(Exception, match="out of range"):
            one.select(guards.bounded_joints(bad, [-1, -2], [1, 2], 0.001)).collect()
    with pytest.raises(Exception, match="finite values"):
        one.select(sc.checked_vector(array(1, float("inf")), 2)).collect()
    with pytest.raises(Exception, match="head camera"):
        one.select(sc.policy_input(array(1), array(1), F.array(F.lit(False), F.lit(True), F.lit(True)), [], 1)).collect()
    with pytest.raises(Exception, match="no frame name"):
        one.select(sc.first_name(F.lit(""), F.lit(None).cast("string"))).collect()
    with pytest.raises(ValueError, match="no column"):
        sc.column_of(["a"], ["b"], F.lit(None))
    with pytest.raises(Exception, match="different lengths"):
        left = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k long, o long, x string")
        ds.zipped(left, left.limit(1).withColumnRenamed("x", "y"), ["k"], "o", "o").collect()
    with pytest.raises(Exception, match="unknown task"):
        tasks = spark.createDataFrame([("s", 0, "t")], "source string, task_index long, task string")
        ds.remapped_tasks(spark.createDataFrame([("s", 1, 5)], "source string, task_index long, o long"), tasks, ["o"]).collect()
    with pytest.raises(Exception, match="nothing is left"):
        rs.trimmed(series(spark, x=[1, 2, 3]), BY, ORDER, 1.0, 1.0, 2.0, strict=True).collect()
    fault = lambda *q: one.select(guards.workspace_fault(tuple(F.lit(0.0) for _ in range(3)), tuple(F.lit(float(x)) for x in q), [(-1, 1)] * 3).alias("f")).first().f
    assert fault(0, 0, 0, 1.05) is None and fault(0, 0, 0, 0.8) == "quaternion length" and fault(float("nan"), 0, 0, 1) == "not finite"


def test_driver_side_splits_draws_and_json():
    train, held = config.ratio_split(range(10), 0.3, 7, "task")
    values = np.arange(10)
    np.random.default_rng(7 + sum(map(ord, "task"))).shuffle(values)
    assert train == set(values[:3].tolist()) and held == set(values[3:].tolist())
    assert config.checked_split({1}, {2}, {1, 2}) == ({1}, {2})
    for bad in (({1}, {1, 2}), ({1}, set())):
        with pytest.raises(ValueError, match="part the ids"):
            config.checked_split(*bad, {1, 2})
    rng = np.random.default_rng(5)
    first = rng.multivariate_normal(np.zeros(3), np.eye(3))
    assert np.allclose(config.sampled_target(np.zeros(3), np.eye(3), "draw", 5, 0.0), first)
    with pytest.raises(ValueError, match="none of"):
        config.sampled_target(np.zeros(3), np.eye(3), "draw", 5, 1e-9)
    assert config.plain({1: np.float32(0.5), "a": (np.arange(2), {"b": np.bool_(True)})}) == {"1": 0.5, "a": [[0, 1], {"b": True}]}
    assert config.leaked([{"calibration": [{"x": 1}, 2]}, {"meta": {"Calibration_Episode_Ids": [3]}}, {"episodes": [4]}], {"1", "2", "3", "4"}) == {"2", "3"}


def test_datasets_are_replaced_as_a_whole(spark, tmp_path):
    rows = spark.createDataFrame([(e, i, float(i)) for e in (1, 2) for i in range(3)], "episode_index long, frame_index long, x double")
    path = str(tmp_path / "set")
    assert sinks.write_episodes(rows, path, signature="a", provenance={"by": "test"})
    assert not sinks.write_episodes(rows.limit(0), path, signature="a") and spark.read.parquet(path).count() == 6
    assert sinks.read_provenance(spark, path) == {"by": "test", "signature": "a"}
    broken = rows.withColumn("x", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_episodes(broken, path, signature="b")
    assert spark.read.parquet(path).count() == 6
    assert sinks.write_episodes(rows.filter("episode_index = 1"), path, signature="b") and spark.read.parquet(path).count() == 3
    assert [p.name for p in tmp_path.iterdir() if "old" in p.name] == []
    noted = sinks.with_features(rows.withColumn("v", F.array("x", "x").cast("array<float>")), {"v": 2})
    noted.write.parquet(str(tmp_path / "noted"))
    assert sinks.features(spark.read.parquet(str(tmp_path / "noted")))["v"] == {"dtype": "float32", "shape": [2]}


def test_packages_of_several_roots(spark, tmp_path):
    root = tmp_path / "set"
    spark.createDataFrame([(4, 0, 1.0, 5.0), (4, 1, 2.0, 5.5)], "source_episode_index long, frame_index long, x double, timestamp double").write.parquet(str(root / "data" / "a"))
    spark.createDataFrame([(9,)], "x long").write.parquet(str(root / "meta" / "b"))
    assert trajectories.parquet_files(spark, str(root)).count() == 2
    found = trajectories.read_episodes(spark, str(root), [4]).orderBy("frame_index").collect()
    assert [r.t for r in found] == [0.0, 0.5] and trajectories.read_episodes(spark, str(root), [5]).count() == 0
    plan = trajectories.read_episodes(spark, str(root), [4])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "source_episode_index" in plan.split("PushedFilters")[1].split("]")[0]
    rows = spark.createDataFrame([(1, 1, "t", None)], "e long, o long, task string, timestamp double")
    with pytest.raises(ValueError, match="rate or videos"):
        ds.concatenated([(rows, {"fps": 10}), (rows, {"fps": 20})], "e", "o", "task")
    matrix = lambda *rows: np.array(rows, float).tolist()
    left, right = matrix([0, -1, 0, 1], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]), matrix([1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 2], [0, 0, 0, 1])
    sides = spark.createDataFrame([("left", left), ("right", right)], "side string, m array<array<double>>")
    pose = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    poses = spark.createDataFrame([("left", pose), ("right", pose), ("left", None)], "side string, pose array<double>")
    half = 0.5**0.5
    moved = [r.pose for r in trajectories.in_scene(poses, sides).collect()]
    assert np.allclose(moved[0], [1, 1, 0, 0, 0, half, half]) and np.allclose(moved[1], [1, 0, 2, 0, 0, 0, 1]) and moved[2] is None
    assert trajectories.in_scene(poses, sides.filter("side = 'left'")).first().pose == pose
    record = {"ts": 2e9, "valid": True, "grasp": 1, "T_ee_in_base": {"translation_m": [1.0, 2.0, 3.0], "quat_xyzw": [0.0, 0.0, 0.0, 1.0]}}
    (tmp_path / "r.json").write_text(json.dumps({"records": [record, record | {"valid": False, "ts": 3e9}, record | {"ts": 4e9}]}))
    replay = trajectories.read_replay_records(spark, str(tmp_path / "r.json"), 10.0).orderBy("t").collect()
    assert [(r.t, r.state) for r in replay] == [(0.0, 1), (2.0, 1)] and replay[0].pose[:3] == [1.0, 2.0, 3.0]
