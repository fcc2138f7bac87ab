"""Queries of scans, packaging, hands, seeds, splits and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionloom.functions import scalars as sc
from motionloom.operators import datasets as ds
from motionloom.operators import guards
from motionloom.operators import resample as rs
from motionloom.sources import sinks, trajectories

from . import corrections
from .proxies import FRAMES_SQL, POSES_SQL, R6, frames, poses, scratch, table
from .registry import ORACLES, QUERIES

_W = "(PARTITION BY episode_id ORDER BY frame_idx)"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query("s5_episode_scan", f"WITH {FRAMES_SQL} SELECT episode_id, frame_idx AS frame_index, round(t - first_value(t) OVER (PARTITION BY episode_id ORDER BY frame_idx), 6) AS t, round(value, 6) AS value FROM f")
def _s5(spark: SparkSession, d: str) -> DataFrame:
    """Episodes written as a packaged dataset and read from it."""
    root = scratch(spark)
    rows = frames(spark, d).select(F.col("episode_id").alias("source_episode_index"), F.col("frame_idx").alias("frame_index"), F.col("t").alias("timestamp"), "value", (F.col("episode_id") % 7).alias("episode_index"))
    sinks.write_episodes(rows, f"{root}/data")
    return trajectories.read_episodes(spark, root).select(F.col("source_episode_index").alias("episode_id"), "frame_index", R6("t").alias("t"), R6("value").alias("value"))


@query("s6_stacked_columns", "SELECT vec_id, 64 AS width, round(embedding[1]::DOUBLE + embedding[64]::DOUBLE, 6)+0 AS ends, CASE WHEN vec_id % 3 = 0 THEN 'feature' WHEN vec_id % 3 = 1 THEN 'info' ELSE 'provenance' END AS frame_name FROM embeddings")
def _s6(spark: SparkSession, d: str) -> DataFrame:
    """Vectors checked to their width, and the first frame name that metadata has."""
    e = sinks.checked_width(table(spark, d, "embeddings"), "embedding", 64)
    k = F.col("vec_id") % 3
    name = sc.first_name(F.when(k == 0, "feature").otherwise(""), F.when(k == 1, "info"), F.lit("provenance"))
    return e.select("vec_id", F.size("embedding").alias("width"), (R6(F.col("embedding")[0].cast("double") + F.col("embedding")[63].cast("double")) + 0.0).alias("ends"), name.alias("frame_name"))


@query("s9_trimmed_source", f"WITH {FRAMES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_id) AS c FROM f) SELECT episode_id, frame_idx - 3 AS frame_index, frame_idx AS source_frame_index FROM n WHERE frame_idx >= 3 AND frame_idx < c - 2")
def _s9(spark: SparkSession, d: str) -> DataFrame:
    kept = rs.trimmed(frames(spark, d), ["episode_id"], "frame_idx", 0.3, 0.2, 10.0)
    return kept.select("episode_id", (F.col("frame_idx") - 3).alias("frame_index"), F.col("frame_idx").alias("source_frame_index"))


@query("s10_joint_slices", "SELECT vec_id, round(list_sum(list_transform(list_slice(embedding, 1, 7), lambda x: x::DOUBLE)), 5)+0 AS left_sum, round(list_sum(list_transform(list_slice(embedding, 8, 14), lambda x: x::DOUBLE)), 5)+0 AS right_sum FROM embeddings")
def _s10(spark: SparkSession, d: str) -> DataFrame:
    cut = trajectories.joint_slices(table(spark, d, "embeddings").withColumnRenamed("embedding", "action"))
    total = lambda side: F.round(F.aggregate(side, F.lit(0.0), lambda s, x: s + x.cast("double")), 5) + 0.0
    return cut.select("vec_id", total("left").alias("left_sum"), total("right").alias("right_sum"))


@query("s15_grasp_series", f"""WITH {FRAMES_SQL}, a AS (SELECT *, CASE WHEN episode_id % 4 = 0 AND frame_idx = 1 THEN NULL ELSE t * 1e9 END AS ns FROM f), b AS (SELECT *, bool_and(ns IS NOT NULL) OVER (PARTITION BY episode_id) AND max(ns) OVER (PARTITION BY episode_id) > min(ns) OVER (PARTITION BY episode_id) AS timed FROM a)
       SELECT episode_id, frame_idx, round(CASE WHEN timed THEN t ELSE frame_idx / 30.0 END, 6) AS t, CASE WHEN valid THEN round(value / 100, 6) END AS ratio, CASE WHEN valid THEN state END::INT AS state FROM b""")
def _s15(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from nanoseconds, or from the rate where some are missing or all are equal; nothing where no hand is seen."""
    ns = F.when(~((F.col("episode_id") % 4 == 0) & (F.col("frame_idx") == 1)), F.col("t") * 1e9)
    seen = frames(spark, d).withColumns({"ns": ns, "ratio": F.col("value") / 100}).drop("t")
    found = rs.grasp_series(seen, ["episode_id"], "frame_idx", "ns", "valid", ["ratio", "state"], 30.0)
    return found.select("episode_id", "frame_idx", R6("t").alias("t"), R6("ratio").alias("ratio"), "state")


@query("s16_tolerant_lookup", "SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN round(embedding[1]::DOUBLE, 6) + 0 WHEN 1 THEN round(embedding[17]::DOUBLE, 6) + 0 WHEN 2 THEN round(embedding[33]::DOUBLE, 6) + 0 END AS pose FROM embeddings")
def _s16(spark: SparkSession, d: str) -> DataFrame:
    """The first of three poses that is one: some are missing, some too short, some not finite."""
    k = F.col("vec_id") % 4
    pose = lambda a: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.transform(F.slice("embedding", a + 4 * r, 4), lambda x: x.cast("double")))
    short = F.slice(pose(1), 1, 3)
    odd = F.transform(pose(17), lambda r: F.transform(r, lambda x: x * float("nan")))
    found = sc.first_valid(F.when(k == 0, pose(1)).when(k != 1, short), F.when(k == 1, pose(17)).otherwise(odd), F.when(k == 2, pose(33)))
    return table(spark, d, "embeddings").select("vec_id", (R6(found[0][0]) + 0.0).alias("pose"))


@query("k1_episode_table", f"""WITH {FRAMES_SQL}, e AS (SELECT DISTINCT episode_id FROM f), k AS (SELECT episode_id, row_number() OVER (ORDER BY episode_id) - 1 AS episode_index FROM e)
       SELECT k.episode_index, f.frame_idx AS frame_index, 100 + row_number() OVER (ORDER BY f.episode_id, f.frame_idx) - 1 AS "index", f.episode_id AS source_episode_index, f.frame_idx + 7 AS source_frame_index, 0 AS task_index,
              f.valid, round(value, 6) AS raw, round(value * 2, 6) AS final, round(value * 3, 6) AS joint FROM f JOIN k ON f.episode_id = k.episode_id""")
def _k1(spark: SparkSession, d: str) -> DataFrame:
    """Source rows (from frame 7 on), raw and final poses and joints, each from a table of its own."""
    f = frames(spark, d)
    part = lambda name, k: f.select("episode_id", "frame_idx", R6(F.col("value") * k).alias(name))
    source = f.select("episode_id", (F.col("frame_idx") + 7).alias("frame_idx"), "t", "valid")
    done = ds.episode_table(source, part("raw", 1), part("final", 2), part("joint", 3), "episode_id", "frame_idx", "t", 100, "task")
    return done.select("episode_index", "frame_index", "index", "source_episode_index", "source_frame_index", F.col("task_index").cast("int").alias("task_index"), "valid", "raw", "final", "joint")


@query("k4_episode_metadata", "SELECT o_custkey AS episode_index, count(*) AS length, min(o_orderkey) AS dataset_from_index, max(o_orderkey) + 1 AS dataset_to_index, list_sort(list(DISTINCT o_orderpriority))::VARCHAR AS tasks FROM orders GROUP BY 1")
def _k4(spark: SparkSession, d: str) -> DataFrame:
    found = sinks.episode_metadata(table(spark, d, "orders").withColumnRenamed("o_custkey", "episode_index"), index="o_orderkey", task="o_orderpriority")
    return found.withColumn("tasks", F.concat(F.lit("["), F.array_join(F.transform("tasks", lambda x: x), ", "), F.lit("]")))


@query("k9_task_table", "WITH t AS (SELECT o_orderpriority AS task, min(o_orderkey) AS k FROM orders GROUP BY 1) SELECT task, row_number() OVER (ORDER BY k) - 1 AS task_index FROM t")
def _k9(spark: SparkSession, d: str) -> DataFrame:
    return ds.task_indices(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "task"), ["o_orderkey"], "task")


@query("p18_complete_records", "SELECT o_orderkey, o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 50000 AS complete FROM orders")
def _p18(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "complete").otherwise("failed")
    found = guards.complete(status, F.col("o_orderpriority"), F.lit("1-URGENT"), F.array(F.col("o_totalprice") > 50_000))
    return table(spark, d, "orders").select("o_orderkey", found.alias("complete"))


@query("p3_p4_guards", "SELECT DISTINCT o.o_orderpriority AS side, o.o_orderstatus AS ego_frame, p.s AS real_frame FROM orders o JOIN (SELECT DISTINCT o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN 'F' ELSE o_orderstatus END AS s FROM orders) p ON o.o_orderpriority = p.o_orderpriority WHERE o.o_orderstatus <> p.s")
def _p3(spark: SparkSession, d: str) -> DataFrame:
    """Orders read under a guard of known states; sides whose frames differ from those of another cohort."""
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("side"), F.col("o_orderstatus").alias("frame"))
    known = guards.required(orders, F.col("frame").isin("F", "O", "P"), "an unknown state", "frame")
    other = known.withColumn("frame", F.when(F.col("side") == "5-LOW", "F").otherwise(F.col("frame")))
    return guards.frame_mismatches(known, other, "side", "frame")


@query("j7_manifest_lookup", "SELECT c_custkey, coalesce(max(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), max(o_orderkey)) AS chosen FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _j7(spark: SparkSession, d: str) -> DataFrame:
    """A customer's last finished order, else the last one of any kind."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    last = lambda rows: ds.latest(rows, ["c_custkey"], ["o_orderkey"]).select("c_custkey", F.col("o_orderkey").alias("chosen"))
    return ds.preferred(table(spark, d, "customer").select("c_custkey"), last(orders.filter("o_orderstatus = 'F'")), last(orders), ["c_custkey"], "chosen")


@query("g9_stable_seeds", "WITH h AS (SELECT c_custkey, sha256('7|' || c_custkey || '|right|0') AS d FROM customer) SELECT c_custkey, ('0x' || d[15:16] || d[13:14] || d[11:12] || d[9:10] || d[7:8] || d[5:6] || d[3:4] || d[1:2])::UBIGINT::VARCHAR AS seed FROM h")
def _g9(spark: SparkSession, d: str) -> DataFrame:
    """A seed for each item from a keyed digest, the same on every machine."""
    return table(spark, d, "customer").select("c_custkey", sc.stable_seed(7, F.col("c_custkey"), F.lit("right"), F.lit(0)).alias("seed"))


@query("u2_split_assignment", "SELECT c_custkey, CASE WHEN sha256('seed|' || c_custkey)[1:8] < '33333333' THEN 'eval' ELSE 'train' END AS part FROM customer")
def _u2(spark: SparkSession, d: str) -> DataFrame:
    """About a fifth of the ids, by a keyed digest (config.ratio_split shuffles a small cohort's ids exactly)."""
    return ds.hash_split(table(spark, d, "customer").select("c_custkey"), "c_custkey", 0.2, "seed")


@query("u7_concatenated", """WITH a AS (SELECT 0 AS source, o_custkey AS e, o_orderkey AS o, o_orderpriority AS task FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'),
       n AS (SELECT *, row_number() OVER (PARTITION BY source, e ORDER BY o) - 1 AS frame_index, dense_rank() OVER (ORDER BY source, e) - 1 AS episode_index FROM a),
       t AS (SELECT task, row_number() OVER (ORDER BY min((episode_index, frame_index))) - 1 AS task_index FROM n GROUP BY task)
       SELECT source, n.episode_index, n.frame_index, n.task, task_index, CASE WHEN source = 1 THEN round(frame_index / 10.0, 6) ELSE 0.5 END::DOUBLE AS timestamp FROM n JOIN t ON n.task = t.task""")
def _u7(spark: SparkSession, d: str) -> DataFrame:
    """Two datasets as one; the second has no timestamps."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("task"), F.when(F.col("o_orderstatus") == "F", 0.5).alias("timestamp"))
    info = {"fps": 10, "video_keys": ["head"]}
    parts = [(orders.filter("o_orderstatus = 'F'"), info), (orders.filter("o_orderstatus <> 'F'"), info)]
    rows, _ = ds.concatenated([(p.drop("o_orderstatus"), i) for p, i in parts], "o_custkey", "o_orderkey", "task")
    return rows.select("source", "episode_index", "frame_index", "task", "task_index", R6("timestamp").alias("timestamp"))


@query("g17_joint_approach")
def _g17(spark: SparkSession, d: str) -> DataFrame:
    """Bounded joint steps from the first seven numbers of a vector to the next seven."""
    import numpy as np

    from motionloom.operators import numeric

    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 7).alias("a"), F.slice("embedding", 8, 7).alias("b"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            paths = [numeric.approach(np.array(a, float), np.array(b, float), 0.05) for a, b in zip(pdf.a, pdf.b, strict=True)]
            yield pd.DataFrame([(i, k, float(q[0])) for i, p in zip(pdf.vec_id, paths, strict=True) for k, q in enumerate(p)], columns=["vec_id", "step", "q0"])

    return e.mapInPandas(run, "vec_id long, step long, q0 double").withColumn("q0", R6("q0"))


@query("f19_policy_input", """SELECT vec_id, 16 AS width, round(embedding[16]::DOUBLE, 6) + 0 AS last_state, round(embedding[32]::DOUBLE, 6) + 0 AS last_action, CASE WHEN vec_id % 2 = 0 THEN round(embedding[41]::DOUBLE, 6) + 0 ELSE 0 END AS left_image, 0.0::DOUBLE AS right_image FROM embeddings""")
def _f19(spark: SparkSession, d: str) -> DataFrame:
    """Samples of 16 numbers; the right camera is masked, the left one in every second sample."""
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    mask = F.array(F.lit(True), F.col("vec_id") % 2 == 0, F.lit(False))
    packed = table(spark, d, "embeddings").select("vec_id", sc.policy_input(part(1, 20), part(17, 16), mask, [part(33, 4), part(41, 4), part(49, 4)]).alias("s"))
    at = lambda c, k: R6(F.col(f"s.{c}")[k]) + 0.0
    return packed.select("vec_id", F.size("s.state").alias("width"), at("state", 15).alias("last_state"), at("actions", 15).alias("last_action"), at("image_1", 0).alias("left_image"), at("image_2", 0).alias("right_image"))


@query("x1_registered_correction", f"WITH {POSES_SQL} SELECT episode_id, frame_idx, round(px + 0.25, 6)+0 AS corrected FROM p")
def _x1(spark: SparkSession, d: str) -> DataFrame:
    done = corrections.applied(poses(spark, d), ["episode_id"], "frame_idx", "px", "offset", amount=0.25, unknown=1)
    return done.withColumn("corrected", R6("corrected") + 0.0)
