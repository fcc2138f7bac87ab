"""Stand-ins for trajectories on the supplied tables, as DataFrames and as SQL.

The tables hold no trajectories, so every operator runs on a proxy: a user's events are
an episode, ordered by time; value is a signal, an event other than 'error' is a valid
row, and a latch on value is the gripper. The first seven numbers of an embedding are a
pose, its label the episode.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionloom.operators.runs import hysteresis

CLOSE, OPEN = 30.0, 60.0
BY, ORDER = ["episode_id"], "frame_idx"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder's name that all executors see: below spark.checkpoint.dir, or a temporary one on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or 'file://' + tempfile.gettempdir()).rstrip('/')}/motionloom-{uuid.uuid4().hex}"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, frame_idx, t (seconds from the first row), value, valid, state, event_type, event_id."""
    events = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select(
        F.col("user_id").alias("episode_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_idx"),
        ((micros - F.min(micros).over(Window.partitionBy("user_id"))) / 1e6).alias("t"),
        "value", (F.col("event_type") != "error").alias("valid"), "event_type", "event_id",
    )
    return hysteresis(rows, BY, ORDER, "value", CLOSE, OPEN).withColumn("state", F.col("state").cast("int"))


#: The same rows as SQL, to follow WITH.
FRAMES_SQL = f"""
    f0 AS (SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
                  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t, value,
                  event_type <> 'error' AS valid, event_type, event_id FROM events),
    f AS (SELECT *, coalesce(last_value(CASE WHEN value < {CLOSE} THEN 1 WHEN value > {OPEN} THEN 0 END IGNORE NULLS)
                    OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 0) AS state FROM f0)"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id (label), frame_idx, px, py, pz, and the unit quaternion qx, qy, qz, qw."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda i: F.col("embedding")[i].cast("double")
    rows = e.select(F.col("label").cast("long").alias("episode_id"), F.col("vec_id").alias("frame_idx"), *[part(i).alias(n) for i, n in enumerate(["px", "py", "pz", "ax", "ay", "az", "aw"])])
    size = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az") + F.col("aw") * F.col("aw"))
    return rows.withColumn("_n", size).select("episode_id", "frame_idx", "px", "py", "pz", *[(F.col("a" + c) / F.col("_n")).alias("q" + c) for c in "xyzw"])


POSES_SQL = """
    p0 AS (SELECT label::BIGINT AS episode_id, vec_id AS frame_idx, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS pz,
                  embedding[4]::DOUBLE AS ax, embedding[5]::DOUBLE AS ay, embedding[6]::DOUBLE AS az, embedding[7]::DOUBLE AS aw FROM embeddings),
    p AS (SELECT episode_id, frame_idx, px, py, pz, ax / n AS qx, ay / n AS qy, az / n AS qz, aw / n AS qw
          FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az + aw * aw) AS n FROM p0))"""

R6 = lambda c: F.round(c, 6)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The poses with times t (a tenth of a second a vector), valid (four of five) and a latch on px as state."""
    rows = poses(spark, sf_dir).withColumns({"t": F.col("frame_idx") / 10.0, "valid": F.col("frame_idx") % 5 != 0})
    return hysteresis(rows, BY, ORDER, "px", -0.05, 0.05).withColumn("state", F.col("state").cast("int"))


TRACKS_SQL = POSES_SQL + """,
    k AS (SELECT *, frame_idx / 10.0::DOUBLE AS t, frame_idx % 5 <> 0 AS valid,
                 coalesce(last_value(CASE WHEN px < -0.05 THEN 1 WHEN px > 0.05 THEN 0 END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 0)::INT AS state FROM p)"""


def hand_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, frame_idx, points: 63 numbers of an embedding as 21 points; every seventh has no jaw, every eleventh no palm."""
    e = table(spark, sf_dir, "embeddings")
    place = lambda i: F.when((F.col("vec_id") % 7 == 0) & (i == 6), 8).when((F.col("vec_id") % 11 == 0) & (i == 20), 5).otherwise(i)
    at = lambda i, k: F.get("embedding", 3 * place(i) + k).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.array(*[at(i, k) for k in range(3)]))
    return e.select(F.col("label").cast("long").alias("episode_id"), F.col("vec_id").alias("frame_idx"), points.alias("points"))


#: The same as columns k0x ... k20z.
POINTS_SQL = "h AS (SELECT label::BIGINT AS episode_id, vec_id AS frame_idx, " + ", ".join(
    f"embedding[CASE WHEN vec_id % 7 = 0 AND {i} = 6 THEN {3 * 8 + k + 1} WHEN vec_id % 11 = 0 AND {i} = 20 THEN {3 * 5 + k + 1} ELSE {3 * i + k + 1} END]::DOUBLE AS k{i}{c}"
    for i in range(21) for k, c in enumerate("xyz")
) + " FROM embeddings)"
