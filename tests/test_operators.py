"""Operators on small cases with known results."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.functions import geometry as geo
from motionloom.functions import scalars as sc
from motionloom.operators import datasets as ds
from motionloom.operators import events as ev
from motionloom.operators import numeric, runs, stats
from motionloom.operators import resample as rs
from motionloom.sources import sinks, trajectories

BY, ORDER = ["e"], "i"


def series(spark, **columns):
    n = len(next(iter(columns.values())))
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    names = ", ".join(f"{k} {kinds[next(type(x) for x in v if x is not None)]}" for k, v in columns.items())
    return spark.createDataFrame([(1, i, *(v[i] for v in columns.values())) for i in range(n)], f"e long, i long, {names}")


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def ego_file(folder, **changes):
    frames = []
    for i, state in enumerate([1, 1, 0, 0, 1, 1, 0]):
        pose = [[1.0, 0, 0, 0.01 * i], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
        frames.append({"idx": i, "ts": int(i * 1e8), "hand_l": None, "hand_r": {"pose_semantics": "tcp", "eef_frame": "base", "tcp_pose_eef_frame": pose, "grasp_state": state, "grasp_ratio": 0.5}})
    body = {"schema": "dual_arm", "schema_version": 2, "fps": 10.0, "total_frames": 7, "eef_coordinate_convention": {"pose_semantics": "tcp", "per_side_frames": {"left": "base", "right": "base"}}, "frames": frames} | changes
    (folder / "3.json").write_text(json.dumps(body))
    return str(folder)


def test_ego_file_to_events(spark, tmp_path):
    rows = trajectories.read_ego_json(spark, ego_file(tmp_path))
    assert rows.count() == 14 and rows.filter("valid").count() == 7
    assert trajectories.faults(rows, "dual_arm", 2).count() == 0
    right = rs.rebased(rows.filter("side = 'right'").withColumn("ts", F.col("ts").cast("double")), ["episode_id", "side"], "frame_idx", "ts", 10.0)
    found = ev.event_sequences(ev.transitions(right, ["episode_id", "side"], "frame_idx", "t", "state", "valid", 0.5), ["episode_id", "side"]).first()
    assert found.sequence == "open,close,open" and not found.ambiguous and found.episode_id == "3"
    assert [round(r.t, 6) for r in right.orderBy("frame_idx").collect()] == [round(0.1 * i, 6) for i in range(7)]
    assert right.orderBy("frame_idx").collect()[3].pose == [0.03, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    with pytest.raises(ValueError, match="another schema"):
        trajectories.require(rows, trajectories.faults(rows, "dual_arm", 1))


def test_real_file(spark, tmp_path):
    pose = [[0.0, -1.0, 0, 1], [1.0, 0, 0, 2], [0, 0, 1.0, 3], [0, 0, 0, 1.0]]
    frames = [{"idx": i, "frame_index": i, "timestamp_s": i / 10, "arms": {"left": {"output_frame": "base", "T_tcp_in_output_frame": pose, "gripper": {"binary": 0, "continuous": 0.1}}}} for i in range(3)]
    (tmp_path / "a.json").write_text(json.dumps({"schema": "fk", "schema_version": 1, "source": {"episode_index": 5}, "frames": frames}))
    rows = trajectories.read_real_json(spark, str(tmp_path))
    left = rows.filter("side = 'left'").first()
    assert left.episode_id == "5" and np.allclose(left.pose, [1, 2, 3, 0, 0, 0.5**0.5, 0.5**0.5])
    assert rows.filter("side = 'right' and not valid and pose is null").count() == 3


def test_hysteresis_and_fills(spark):
    df = series(spark, r=[0.6, 0.5, 0.4, 0.5, 0.6], m=[True, False, True, True, False], x=[None, 1.0, None, 3.0, None])
    assert column(runs.hysteresis(df, BY, ORDER, "r", 0.45, 0.55), "state") == [0, 0, 1, 1, 0]
    assert column(runs.fill_short_gaps(df, BY, ORDER, "m", 1), "m") == [True, True, True, True, False]
    assert column(runs.drop_short_runs(df, BY, ORDER, "m", 1), "m") == [False, False, True, True, False]
    assert column(runs.delay_onset(df, BY, ORDER, "m", 1), "m") == [False, False, False, True, False]
    assert column(rs.interpolated(df, BY, ORDER, "x"), "x") == [None, 1.0, 2.0, 3.0, None]
    assert column(rs.interpolated(df, BY, ORDER, "x", hold_ends=True), "x") == [1.0, 1.0, 2.0, 3.0, 3.0]
    assert column(rs.filled_both_ways(df, BY, ORDER, "x", 9.0), "x") == [1.0, 1.0, 1.0, 3.0, 3.0]
    assert column(rs.carried(df, BY, ORDER, "x", 0.0), "x") == [0.0, 1.0, 1.0, 3.0, 3.0]


def test_ambiguous_events_need_missing_rows_and_a_long_gap(spark):
    df = series(spark, s=[0, 1, 1, 0], ok=[True, True, False, True], t=[0.0, 5.0, 6.0, 20.0])
    found = ev.transitions(df, BY, ORDER, "t", "s", "ok", 2.0).orderBy("ordinal").collect()
    assert [(r.transition, r.ambiguous, r.invalid_gap) for r in found] == [("close", False, 0.0), ("open", True, 15.0)]


def test_thinning_is_half_to_even(spark):
    df = series(spark, x=list(range(20)))
    assert column(rs.thinned(df, BY, ORDER, 5), "x") == [0, 5, 10, 14, 19]


def test_median_filter_repeats_the_ends(spark):
    assert column(runs.median_filter(series(spark, x=[5, 1, 1, 9, 9]), BY, ORDER, "x", 5), "x") == [5, 5, 5, 9, 9]
    assert column(runs.median_filter(series(spark, x=[5, 1]), BY, ORDER, "x", 5), "x") == [5, 1]


def test_unwrapped_equals_numpy(spark):
    angles = [0.1, 3.0, -3.0, -2.9, 3.1, 0.0, float(np.pi), -float(np.pi), 1.0]
    found = column(runs.unwrapped(series(spark, x=angles), BY, ORDER, "x"), "unwrapped")
    assert np.allclose(found, np.unwrap(angles))


def test_continuous_quaternions_equal_a_loop(spark):
    rng = np.random.default_rng(0)
    q = rng.normal(size=(60, 4))
    df = series(spark, **{n: q[:, k].tolist() for k, n in enumerate("abcd")})
    found = np.array([[r[n] for n in "abcd"] for r in rs.uninterrupted_signs(df, BY, ORDER, list("abcd")).orderBy("i").collect()])
    wanted = q / np.linalg.norm(q, axis=1, keepdims=True)
    for k in range(1, len(wanted)):
        if wanted[k] @ wanted[k - 1] < 0:
            wanted[k] = -wanted[k]
    assert np.allclose(found, wanted)


def test_resampling_does_not_skip_an_invalid_neighbour(spark):
    df = series(spark, t=[0.0, 1.0, 2.0, 3.0, 4.0], x=[0.0, 1.0, 2.0, 3.0, 4.0], s=[0, 0, 1, 1, 1], ok=[True, True, False, True, True])
    found = rs.resampled(df, BY, "t", "ok", 1.5, 9, linear=["x"], nearest=["s"]).orderBy("sample").collect()
    assert [r.x for r in found] == [0.0, 0.5, 1.0, None, None, None, 3.0, 3.5, 4.0]
    assert [r.ok for r in found] == [True, True, True, False, False, False, True, True, True]


def test_floors_and_pooled_statistics(spark):
    pairs = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0)], "a long, b long, d double")
    floors = {r["item"]: r["floor"] for r in stats.noise_floor(pairs, [], "d").collect()}
    assert floors == {0: 1.5, 1: 2.0, 2: 2.5} and np.mean(list(floors.values())) == 2.0
    points = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 3.0)], "c long, x double")
    offsets = sorted(r.offset for r in stats.leave_one_out_offset(points, ["c"], ["x"]).collect())
    assert np.isclose(np.mean(offsets), 5 / 3)
    rng = np.random.default_rng(2)
    parts = [rng.normal(size=n) for n in (5, 9, 30)]
    rows = spark.createDataFrame([(1, len(p), float(p.min()), float(p.max()), float(p.mean()), float(p.std())) for p in parts], "g long, n long, min double, max double, mean double, std double")
    found, every = stats.merged_statistics(rows, ["g"]).first(), np.concatenate(parts)
    assert np.allclose([found["mean"], found["std"], found["min"], found["max"]], [every.mean(), every.std(), every.min(), every.max()])


def dtw_by_loop(a, b):
    n, m = len(a), len(b)
    c = np.linalg.norm(a[:, None] - b[None], axis=2)
    t = np.full((n + 1, m + 1), np.inf)
    t[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i, j] = c[i - 1, j - 1] + min(t[i - 1, j - 1], t[i - 1, j], t[i, j - 1])
    return t[n, m] / ((n + m) / 2)


def test_dtw():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(17, 3)), rng.normal(size=(23, 3))
    cost, path = numeric.dtw(a, b)
    assert np.isclose(cost, dtw_by_loop(a, b)) and tuple(path[0]) == (0, 0) and tuple(path[-1]) == (16, 22)
    assert numeric.dtw(a, a, 0.5)[0] == 0.0
    with pytest.raises(ValueError):
        numeric.dtw(a[:1], b)


@pytest.mark.parametrize("method", ["linear", "min_bending"])
def test_propagation_keeps_ends_and_anchor(method):
    out = numeric.propagate(11, [5], np.array([[2.0]]), method)[:, 0]
    assert abs(out[0]) < 1e-9 and abs(out[-1]) < 1e-9 and abs(out[5] - 2) < 1e-9


@pytest.mark.parametrize("n", [2, 3, 4, 7, 40])
def test_propagation_equals_dense_systems(n):
    rng = np.random.default_rng(n)
    bend = np.zeros((max(0, n - 2), n))
    for k in range(n - 2):
        bend[k, k : k + 3] = 1, -2, 1
    for count in range(0, min(n, 4)):
        frames = sorted(rng.choice(n, count, replace=False).tolist())
        values = rng.normal(size=(count, 2))
        control = {0: np.zeros(2), n - 1: np.zeros(2)} | dict(zip(frames, values, strict=True))
        at = np.array(sorted(control))
        points = np.array([control[f] for f in at])
        weight = np.zeros(n)
        weight[at] = np.where((at == 0) | (at == n - 1), 3.0, 2.0)
        target = np.zeros((n, 2))
        target[at] = weight[at, None] * points
        smooth = np.linalg.solve(np.diag(weight) + 7 * bend.T @ bend + 0.1 * np.eye(n), target)
        assert np.allclose(numeric.propagate(n, frames, values, "smooth_spline", 3.0, 2.0, 7.0, 0.1), smooth)
        free = np.setdiff1d(np.arange(n), at)
        if n > 2 and len(free):
            h = bend.T @ bend
            want = np.zeros((n, 2))
            want[at] = points
            want[free] = np.linalg.solve(h[np.ix_(free, free)] + 1e-12 * np.eye(len(free)), -h[np.ix_(free, at)] @ points)
            assert np.allclose(numeric.propagate(n, frames, values, "min_bending"), want, atol=1e-6)
    assert abs(numeric.propagate(11, [5], np.array([[2.0]]), "smooth_spline")[5, 0] - 0.83) < 0.01
    with pytest.raises(ValueError, match="two values"):
        numeric.propagate(5, [2, 2], np.array([[1.0], [2.0]]))


def test_sequential_numerics():
    assert numeric.debounced([0, 0, 1, 0, 0, 1, 1, 1, None, 1], 2) == [0, 0, 0, 0, 0, 1, 1, 1, None, 1]
    assert numeric.flipped_short_runs([0, 1, 0, 0, 1], 1) == [0, 0, 0, 0, 1]
    moved = numeric.limited(np.array([[0.0], [1.0], [5.0], [5.0]]), np.array([True, True, False, True]), 0.05)[:, 0]
    assert np.allclose(moved, [0.0, 0.05, 5.0, 5.0])
    x = np.linspace(0, 3, 20)
    assert np.allclose(numeric.savitzky_golay(x**2, 7), x**2)
    q = np.array([[0, 0, 0, 1.0], [0, 0, np.sin(0.1), np.cos(0.1)], [0, 0, -np.sin(0.1), -np.cos(0.1)]])
    assert np.allclose(np.abs(numeric.mean_rotation(q)[3]), np.cos(0.0666), atol=1e-3)


def test_geometry_round_trips(spark):
    q = tuple(F.lit(x) for x in (0.1, -0.2, 0.3, 0.9273618495))
    m = geo.matrix(q)
    back = geo.from_six_numbers(geo.six_numbers(m))
    again = geo.from_rotation_vector(geo.rotation_vector(q))
    row = spark.range(1).select(geo.is_rotation(m, 1e-6).alias("ok"), F.array(*m).alias("m"), F.array(*back).alias("b"), F.array(*again).alias("q"), geo.angle_degrees(q, q).alias("zero")).first()
    assert row.ok and np.allclose(row.m, row.b) and np.allclose(row.q, [0.1, -0.2, 0.3, 0.92736185], atol=1e-6) and row.zero < 1e-2


def test_id_lists_and_splits(spark):
    assert spark.range(1).select(sc.id_list(F.lit("0,3,10:12, 8-9")).alias("x")).first().x == [0, 3, 10, 11, 12, 8, 9]
    split = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2), ("b", 9)], "part string, item long")
    known = spark.createDataFrame([(1,), (2,)], "item long")
    assert {(r["item"], r.fault) for r in ds.split_faults(split, known, "part", "item").collect()} == {(1, "repeated"), (2, "in several parts"), (9, "unknown")}


def test_episodes_are_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(e, i, float(i)) for e in (1, 2) for i in range(3)], "episode_index long, frame_index long, x double")
    sinks.write_episodes(rows, str(tmp_path / "set" / "data"))
    assert spark.read.parquet(str(tmp_path / "set" / "data")).filter("episode_index = 2").count() == 3
    (tmp_path / "joints").mkdir()
    np.savez(tmp_path / "joints" / "a.npz", left_arm_qpos=np.ones((2, 6)), right_arm_qpos=2 * np.ones((2, 6)))
    joints = trajectories.read_joint_arrays(spark, str(tmp_path / "joints")).orderBy("frame_idx").collect()
    assert len(joints) == 2 and joints[1].right == [2.0] * 6
    with pytest.raises(Exception, match="not 3 wide"):
        sinks.checked_width(rows.select(F.array("x").alias("v")), "v", 3).collect()


def test_streaming_sessions_and_streaks(spark, tmp_path):
    import pandas as pd

    from motionloom.streaming import monitor

    times = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:05", "2024-01-01 00:06", "2024-01-01 02:00", "2024-01-02 00:00"])
    rows = spark.createDataFrame(pd.DataFrame({"k": [1] * 5, "ts": times, "bad": [True, True, True, False, True]}))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    assert [(r.key, r.streak) for r in run(monitor.bad_streaks(stream, "k", "ts", "bad", 2), "streaks")] == [(1, 3)]
    assert sorted(r.n for r in run(monitor.sessions(stream, "k", "ts"), "sessions")) == [1, 3]


def test_driver_side_metadata(tmp_path):
    from motionloom.plans import config

    assert config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    assert config.names("all", ["x", "y"]) == ["x", "y"] and config.names("y,x", ["x", "y"]) == ["x", "y"]
    assert config.segment("first:3") == ("first", 3) and config.segment("0:last") == (0, "last") and config.segment(":") == (None, None)
    assert [r["id"] for r in config.run_product({"p": 1, "q": 2}, {"z": 3})] == ["p+z", "q+z"]
    assert config.leaked({"sides": {"calibration_episode_ids": [1, 2], "ego_calibration_episodes": [3]}, "calibration": [4]}, {"2", "3", "4"}) == {"2", "4"}
    assert config.stable_seed(1, "a") == config.stable_seed(1, "a") != config.stable_seed(2, "a")
    mean, covariance = np.zeros(3), np.eye(3)
    x = config.sampled_target(mean, covariance, "draw", 5, 1.0)
    assert np.linalg.norm(x) <= 1 and (config.sampled_target(mean, covariance, "mean", 5, 1.0) == mean).all()
    with pytest.raises(ValueError):
        config.trajectory_options({"arm_mode": "single", "sides": ["left", "right"]})
    (tmp_path / "b").mkdir()
    assert config.first_existing([tmp_path / "a", tmp_path / "b"]) == tmp_path / "b"


def test_manifest_and_catalog(spark, tmp_path):
    def manifest(*ids, name="m"):
        (tmp_path / "m.json").write_text(json.dumps({"schema": name, "schema_version": 1, "episodes": [{"episode_index": i, "path": f"{i}.json"} for i in ids]}))
        return trajectories.read_manifest(spark, str(tmp_path / "m.json"), "m", 1, str(tmp_path))

    for i in (1, 2):
        (tmp_path / f"{i}.json").write_text("{}")
    assert {(r.episode_id, r.path) for r in manifest(1, 2).collect()} == {("1", "1.json"), ("2", "2.json")}
    for ids, error, what in (((), ValueError, "no episodes"), ((1, 1), ValueError, "twice"), ((1, 3), FileNotFoundError, "3.json")):
        with pytest.raises(error, match=what):
            manifest(*ids)
    with pytest.raises(ValueError, match="not a manifest"):
        manifest(1, name="other")
    kinds = "`episode_index` long, length long, `data/chunk_index` long, `data/file_index` long, `videos/head/chunk_index` long, `videos/head/file_index` long, `videos/head/from_timestamp` double"
    root = tmp_path / "set"
    spark.createDataFrame([(7, 60, 0, 3, 0, 1, 2.0)], kinds).write.parquet(str(root / "meta" / "episodes"))
    found = trajectories.read_catalog(spark, str(root), "data/chunk-{chunk}/file-{file}.parquet", "head").first()
    assert found.data_file == "data/chunk-000/file-003.parquet" and found.from_timestamp == 2.0
    (root / "meta" / "info.json").write_text(json.dumps({"fps": 30, "data_path": "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet", "video_path": "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"}))
    found = trajectories.read_catalog(spark, str(root), video_key="head").first()
    assert (found.data_file, found.video_file, found.start_frame) == ("data/chunk-000/file-003.parquet", "videos/head/chunk-000/file-001.mp4", 60)
    spark.createDataFrame([(7, 60, 0, 3, 0, 1, 2.0)], kinds).write.mode("append").parquet(str(root / "meta" / "episodes"))
    with pytest.raises(ValueError, match="listed twice"):
        trajectories.read_catalog(spark, str(root))
    (root / "meta" / "tasks.jsonl").write_text('{"task_index": 1, "task": "b"}\n{"task_index": 0, "task": "a"}\n')
    assert [r.task for r in trajectories.read_tasks(spark, str(root), 2).collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="3 declared"):
        trajectories.read_tasks(spark, str(root), 3)


def test_grasp_smoothing():
    assert numeric.grasp_by_distance(np.array([0.2, np.nan, 0.2, 0.0, 0.0, 0.0, 0.0]), 0.1, 1, 0) == [0, 0, 0, 1, 1, 1, 1]
    assert numeric.grasp_by_state([0, 0, 0, 1, 1, None, 1, 1, 1], 3, 2) == [0, 0, 0, 1, 1, 1, 1, 1, 1]
