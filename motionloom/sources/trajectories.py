"""Readers of episode files as one long DataFrame, a row for each side and frame.

Schemas are explicit. A missing hand is a row with a null pose and valid = false.
Faults are rows of `faults`, not exceptions; `require` turns them into an error.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionloom.functions import geometry as geo

_MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))
_HAND = T.StructType([
    T.StructField("pose_semantics", T.StringType()), T.StructField("eef_frame", T.StringType()),
    T.StructField("tcp_pose_eef_frame", _MATRIX), T.StructField("eef_pose_world", _MATRIX),
    T.StructField("grasp_state", T.IntegerType()), T.StructField("grasp_ratio", T.DoubleType()), T.StructField("valid", T.BooleanType()),
])
EGO = T.StructType([
    T.StructField("schema", T.StringType()), T.StructField("schema_version", T.IntegerType()), T.StructField("episode_id", T.StringType()),
    T.StructField("fps", T.DoubleType()), T.StructField("total_frames", T.LongType()),
    T.StructField("eef_coordinate_convention", T.StructType([T.StructField("pose_semantics", T.StringType()), T.StructField("per_side_frames", T.MapType(T.StringType(), T.StringType()))])),
    T.StructField("frames", T.ArrayType(T.StructType([
        T.StructField("idx", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("timestamp_s", T.DoubleType()),
        T.StructField("hand_l", _HAND), T.StructField("hand_r", _HAND),
    ]))),
])
_ARM = T.StructType([
    T.StructField("output_frame", T.StringType()), T.StructField("T_tcp_in_output_frame", _MATRIX), T.StructField("valid", T.BooleanType()),
    T.StructField("gripper", T.StructType([T.StructField("binary", T.IntegerType()), T.StructField("continuous", T.DoubleType())])),
])
REAL = T.StructType([
    T.StructField("schema", T.StringType()), T.StructField("schema_version", T.IntegerType()),
    T.StructField("source", T.StructType([T.StructField("episode_index", T.LongType())])),
    T.StructField("gripper_convention", T.StructType([T.StructField("binary_open", T.IntegerType()), T.StructField("binary_closed", T.IntegerType())])),
    T.StructField("frames", T.ArrayType(T.StructType([
        T.StructField("idx", T.LongType()), T.StructField("frame_index", T.LongType()), T.StructField("timestamp_s", T.DoubleType()),
        T.StructField("arms", T.MapType(T.StringType(), _ARM)),
    ]))),
])


def _pose(m: Column) -> Column:
    """x, y, z, qx, qy, qz, qw of a 4x4 matrix; the quaternion by its largest part, qw not negative."""
    at = lambda i, j: F.get(F.get(m, i), j)
    trace = at(0, 0) + at(1, 1) + at(2, 2)

    def of(t: Column, parts: tuple[Column, Column, Column, Column], lead: int) -> Column:
        s = F.sqrt(t + 1) * 2
        values = [p / s for p in parts]
        values[lead] = s / 4
        sign = F.when(values[3] < 0, -1.0).otherwise(1.0)
        return F.array(*[at(i, 3) for i in range(3)], *[v * sign for v in values])

    a, b, c = at(2, 1) - at(1, 2), at(0, 2) - at(2, 0), at(1, 0) - at(0, 1)
    xy, xz, yz = at(0, 1) + at(1, 0), at(0, 2) + at(2, 0), at(1, 2) + at(2, 1)
    x_first = (at(0, 0) >= at(1, 1)) & (at(0, 0) >= at(2, 2))
    return (
        F.when(m.isNull(), None).when(trace > 0, of(trace, (a, b, c, F.lit(0.0)), 3))
        .when(x_first, of(at(0, 0) - at(1, 1) - at(2, 2), (F.lit(0.0), xy, xz, a), 0))
        .when(at(1, 1) >= at(2, 2), of(at(1, 1) - at(0, 0) - at(2, 2), (xy, F.lit(0.0), yz, b), 1))
        .otherwise(of(at(2, 2) - at(0, 0) - at(1, 1), (xz, yz, F.lit(0.0), c), 2))
    )


def read_ego_json(spark: SparkSession, path: str) -> DataFrame:
    """path, schema, schema_version, episode_id, side, frame_idx, ts, timestamp_s, fps, pose, valid, state, ratio, frame_name."""
    raw = spark.read.schema(EGO).json(path, multiLine=True).withColumn("path", F.input_file_name())
    frames = raw.select("*", F.posexplode("frames").alias("frame_idx", "f"))
    sided = frames.select("*", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("f.hand_l").alias("h")), F.struct(F.lit("right").alias("side"), F.col("f.hand_r").alias("h")))).alias("s"))
    hand = F.col("s.h")
    name = F.coalesce(F.nullif(hand["eef_frame"], F.lit("")), F.try_element_at("eef_coordinate_convention.per_side_frames", F.col("s.side")))
    return sided.select(
        "path", "schema", "schema_version", F.coalesce("episode_id", F.regexp_extract("path", "([^/]+)\\.json$", 1)).alias("episode_id"),
        F.col("s.side").alias("side"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col("f.ts").alias("ts"), F.col("f.timestamp_s").alias("timestamp_s"), "fps",
        _pose(F.coalesce(hand["tcp_pose_eef_frame"], hand["eef_pose_world"])).alias("pose"),
        F.when(hand.isNull(), False).otherwise(F.coalesce(hand["valid"], F.lit(True))).alias("valid"),
        F.when(hand.isNull(), 0).otherwise(hand["grasp_state"]).alias("state"), hand["grasp_ratio"].alias("ratio"), name.alias("frame_name"),
        F.col("total_frames"), F.size("frames").cast("long").alias("n_frames"),
        F.coalesce(hand["pose_semantics"], F.col("eef_coordinate_convention.pose_semantics")).alias("semantics"),
    )


def read_real_json(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from forward-kinematics files (state 0 open, 1 closed)."""
    raw = spark.read.schema(REAL).json(path, multiLine=True).withColumn("path", F.input_file_name())
    frames = raw.select("*", F.posexplode("frames").alias("frame_idx", "f")).select("*", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"))
    arm = F.try_element_at("f.arms", F.col("side"))
    return frames.select(
        "path", "schema", "schema_version", F.col("source.episode_index").cast("string").alias("episode_id"), "side", F.col("frame_idx").cast("long").alias("frame_idx"),
        F.col("f.timestamp_s").alias("timestamp_s"), _pose(arm["T_tcp_in_output_frame"]).alias("pose"),
        F.when(arm.isNull(), False).otherwise(F.coalesce(arm["valid"], F.lit(True))).alias("valid"),
        F.when(arm.isNull(), 0).otherwise(arm["gripper"]["binary"]).alias("state"), arm["gripper"]["continuous"].alias("ratio"), F.nullif(arm["output_frame"], F.lit("")).alias("frame_name"),
        (F.coalesce("gripper_convention.binary_open", F.lit(0)) == 0).alias("_open"), (F.coalesce("gripper_convention.binary_closed", F.lit(1)) == 1).alias("_closed"),
    ).withColumn("opens_at_zero", F.col("_open") & F.col("_closed")).drop("_open", "_closed")


def faults(rows: DataFrame, schema: str, version: int, semantics: str | None = None) -> DataFrame:
    """(path, side, fault) of files that can't be taken: another schema, other pose semantics (if given), another number of
    frames than declared, no positive rate, several or no frame names, states other than 0 and 1, another gripper
    convention, a pose that is missing or not rigid, times that are missing in part or do not rise.

    rows come from read_ego_json or read_real_json; rules whose column is not there do not apply.
    """
    has = set(rows.columns)
    every = lambda c: F.every(F.coalesce(c, F.lit(False)))
    seconds = F.col("timestamp_s")
    quaternion = tuple(F.get("pose", k) for k in range(3, 7))
    rules = {
        "another schema": every((F.col("schema") == schema) & (F.col("schema_version") == version)),
        "other pose semantics": every(~F.col("valid") | (F.coalesce("semantics", F.lit("")) == semantics)) if semantics and "semantics" in has else None,
        "total_frames differs": every(F.col("total_frames").isNull() | (F.col("total_frames") == F.col("n_frames"))) if "total_frames" in has else None,
        "no positive fps": every(F.col("fps") > 0) if "fps" in has else None,
        "not one frame name": F.count_distinct("frame_name") == 1,
        "state is not 0 or 1": every(F.col("state").isin(0, 1)),
        "gripper convention": every(F.col("opens_at_zero")) if "opens_at_zero" in has else None,
        "pose is not rigid": every(~F.col("valid") | (F.abs(geo.norm(quaternion) - 1) <= 1e-3)),
        "repeated time": (F.count(seconds) == 0) | (F.count_distinct(seconds) == F.count(F.lit(1))),
        "times missing": (F.count(seconds) == 0) | (F.count(seconds) == F.count(F.lit(1))),
    }
    held = {name: rule for name, rule in rules.items() if rule is not None}
    found = rows.groupBy("path", "side").agg(*[rule.alias(f"r{k}") for k, rule in enumerate(held.values())])
    fault = F.coalesce(*[F.when(~F.coalesce(F.col(f"r{k}"), F.lit(False)), name) for k, name in enumerate(held)])
    return found.select("path", "side", fault.alias("fault")).filter("fault is not null")


def require(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows, or an error that names the first faults."""
    first = found.limit(5).collect()
    if first:
        raise ValueError("; ".join(f"{r.path} ({r.side}): {r.fault}" for r in first))
    return rows


def parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all Parquet files below a folder, or of one file, but those in a `meta` folder, with their file as `_file`."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    return rows.withColumn("_file", F.col("_metadata.file_path")).filter("not _file rlike '/meta/'")


def read_episodes(spark: SparkSession, root: str, episodes: list[int] | None = None, fps: float | None = None) -> DataFrame:
    """Rows of a packaged dataset's Parquet files below root/data, with t; the filter on episodes reaches the scan.

    The episode is source_episode_index if there is one, else episode_index; without either
    all is episode 0. t is the timestamp from the episode's first row, else the row's number
    over fps; without both it is an error.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/data")
    key = next((c for c in ("source_episode_index", "episode_index") if c in rows.columns), None)
    if key is None:
        rows, key = rows.withColumn("episode_index", F.lit(0).cast("long")), "episode_index"
    if episodes is not None:
        rows = rows.filter(F.col(key).isin(episodes))
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("frame_index")
    if "timestamp" in rows.columns:
        return rows.withColumn("t", (F.col("timestamp") - F.first("timestamp").over(w)).cast("double"))
    if fps is None or fps <= 0:
        raise ValueError("the episodes have neither timestamps nor a positive fps")
    return rows.withColumn("t", (F.row_number().over(w) - 1) / F.lit(float(fps)))


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def read_info(spark: SparkSession, root: str) -> dict:
    """root/meta/info.json."""
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/meta/info.json").collect()))


def _listed(spark: SparkSession, root: str, name: str, schema: str, order: str, total: int | None) -> DataFrame:
    """root/meta/<name>.jsonl, or else .parquet, in order; another number of rows than `total` is an error."""
    path = f"{root}/meta/{name}"
    rows = spark.read.schema(schema).json(f"{path}.jsonl") if _exists(spark, f"{path}.jsonl") else spark.read.parquet(f"{path}.parquet")
    if total is not None and (n := rows.count()) != total:
        raise ValueError(f"{path}: {n} rows, {total} declared")
    return rows.orderBy(order)


def read_tasks(spark: SparkSession, root: str, total: int | None = None) -> DataFrame:
    """task_index and task of a dataset, in order."""
    return _listed(spark, root, "tasks", "task_index long, task string", "task_index", total)


def read_episode_list(spark: SparkSession, root: str, total: int | None = None) -> DataFrame:
    """episode_index, length and tasks of a dataset's episodes, in order."""
    return _listed(spark, root, "episodes", "episode_index long, length long, tasks array<string>", "episode_index", total)


# The names under which joint arrays are stored, the first found counts.
LEFT_KEYS = ["left_arm_qpos", "left_qpos", "left"]
RIGHT_KEYS = ["right_arm_qpos", "right_qpos", "right"]


def joint_slices(rows: DataFrame, state: str = "observation.state", action: str = "action", width: int = 7) -> DataFrame:
    """rows with left and right, the first and second `width` values of state, or of action if there is no state."""
    source = state if state in rows.columns else action
    wide = F.col(f"`{source}`")
    checked = F.when(F.size(wide) >= 2 * width, wide).otherwise(F.raise_error(F.lit(f"{source}: fewer than {2 * width} values")))
    return rows.withColumn("_wide", checked).withColumns({"left": F.slice("_wide", 1, width), "right": F.slice("_wide", width + 1, width)}).drop("_wide")


def read_joint_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame_idx, left, right) from NPZ files with an array under one of LEFT_KEYS and RIGHT_KEYS, one file in a task at a time."""

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf.path, pdf.content, strict=True):
                with np.load(io.BytesIO(content)) as z:
                    left, right = (z[next(k for k in keys if k in z)].astype(float) for keys in (LEFT_KEYS, RIGHT_KEYS))
                yield pd.DataFrame({"path": p, "frame_idx": range(len(left)), "left": list(left), "right": list(right)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, frame_idx long, left array<double>, right array<double>")


def read_manifest(spark: SparkSession, path: str, schema: str, version: int, root: str | None = None) -> DataFrame:
    """(episode_id, path) of a manifest with an `episodes` list.

    Another schema, no episodes, an id given twice and, with root (the folder that paths
    start from), a missing file are errors at once; a manifest is read by the driver.
    """
    fields = "schema string, schema_version int, episodes array<struct<episode_index: long, path: string, output: string>>"
    found = spark.read.schema(fields).json(path, multiLine=True).collect()  # one row
    if len(found) != 1 or found[0].schema != schema or found[0].schema_version != version:
        raise ValueError(f"{path}: not a manifest {schema} of version {version}")
    rows = [(str(e.episode_index), e.output or e.path) for e in found[0].episodes or []]
    ids = [i for i, _ in rows]
    if not ids or len(set(ids)) < len(ids):
        raise ValueError(f"{path}: " + ("no episodes" if not ids else "an episode is listed twice"))
    if root is not None and (lost := [p for _, p in rows if not _exists(spark, f"{root}/{p}")]):
        raise FileNotFoundError(", ".join(lost))
    return spark.createDataFrame(rows, "episode_id string, path string")


def read_catalog(spark: SparkSession, root: str, data_path: str | None = None, video_key: str | None = None) -> DataFrame:
    """Episodes of root/meta/episodes in order with their files by the templates of root/meta/info.json, and a video's first frame.

    Templates name {chunk_index}, {file_index} (three digits each) and {video_key}. An episode listed twice is an error.
    """
    info = {} if data_path else read_info(spark, root)
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/meta/episodes")
    spell = lambda template: template.replace("{chunk}", "%03d").replace("{file}", "%03d").replace("{chunk_index:03d}", "%03d").replace("{file_index:03d}", "%03d").replace("{video_key}", video_key or "")
    at = lambda of: (F.col(f"`{of}/chunk_index`"), F.col(f"`{of}/file_index`"))
    columns = [F.col("episode_index"), F.col("length"), F.format_string(spell(data_path or info["data_path"]), *at("data")).alias("data_file")]
    if video_key:
        begin = F.col(f"`videos/{video_key}/from_timestamp`")
        columns.append(begin.alias("from_timestamp"))
        if info:
            columns += [F.format_string(spell(info["video_path"]), *at(f"videos/{video_key}")).alias("video_file"), F.rint(begin * float(info["fps"])).cast("long").alias("start_frame")]
    twice = rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if first := twice.limit(1).collect():
        raise ValueError(f"{root}: episode {first[0].episode_index} is listed twice")
    return rows.select(*columns).orderBy("episode_index")


def _moved(m: Column, pose: Column) -> Column:
    """A pose [x, y, z, qx, qy, qz, qw] seen through a 4x4 matrix."""
    frame = _pose(m)
    part = lambda p, a, b: tuple(F.get(p, k) for k in range(a, b))
    q, p = geo.pose_product(part(frame, 3, 7), part(frame, 0, 3), part(pose, 3, 7), part(pose, 0, 3))
    return F.array(*p, *q)


def in_scene(rows: DataFrame, transforms: DataFrame) -> DataFrame:
    """rows with poses seen through each side's scene transform (side, m: 4x4).

    A scene transform needs both sides, else poses stay in the right arm's base.
    """
    sides = transforms.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("side", "m"))).alias("_by"))  # two rows
    joined = rows.crossJoin(F.broadcast(sides))
    both = F.try_element_at("_by", F.lit("left")).isNotNull() & F.try_element_at("_by", F.lit("right")).isNotNull()
    m = F.try_element_at("_by", F.col("side"))
    return joined.withColumn("pose", F.when(F.col("pose").isNull() | ~F.coalesce(both, F.lit(False)), F.col("pose")).otherwise(_moved(m, F.col("pose")))).drop("_by")


def read_replay_records(spark: SparkSession, path: str, fps: float) -> DataFrame:
    """path, side, t, pose, state of files with a `records` list (one right arm; translation_m and quat_xyzw): rows that are not valid are left out."""
    schema = "records array<struct<ts: double, valid: boolean, grasp: int, T_ee_in_base: struct<translation_m: array<double>, quat_xyzw: array<double>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).select(F.input_file_name().alias("path"), F.posexplode("records").alias("_i", "r"))
    kept = raw.filter(F.coalesce("r.valid", F.lit(True)) & F.col("r.T_ee_in_base").isNotNull())
    at = F.coalesce(F.col("r.ts") * 1e-9, F.col("_i") / F.lit(fps))
    from pyspark.sql import Window

    first = F.min(at).over(Window.partitionBy("path"))
    return kept.select("path", F.lit("right").alias("side"), (at - first).alias("t"), F.concat("r.T_ee_in_base.translation_m", "r.T_ee_in_base.quat_xyzw").alias("pose"), F.coalesce("r.grasp", F.lit(0)).alias("state"))
