"""Queries of joins, aggregates, guards and dataset operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionloom.functions import scalars as sc
from motionloom.operators import datasets as ds
from motionloom.operators import events as ev
from motionloom.operators import guards, stats
from motionloom.operators import resample as rs

from .proxies import FRAMES_SQL, R6, frames, table
from .registry import ORACLES, QUERIES


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


_S = 'round(min({0}), 6) AS "min", round(max({0}), 6) AS "max", round(avg({0}), 6) AS mean, round(stddev_pop({0}), 6) AS std'


@query("a2_summary", "SELECT user_id, count(value) AS n, " + _S.format("value") + ", round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY user_id")
def _a2(spark: SparkSession, d: str) -> DataFrame:
    found = stats.summary(table(spark, d, "events"), ["user_id"], "value")
    return found.select("user_id", "n", *[R6(c).alias(c) for c in ("min", "max", "mean", "std", "median")])


@query("a1_episode_groups", f"WITH {FRAMES_SQL} SELECT episode_id, count(*) AS n_rows, min(frame_idx) AS \"first\", max(frame_idx) AS \"last\", round(max(t), 6) AS seconds FROM f GROUP BY episode_id")
def _a1(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), R6(F.max("t")).alias("seconds"))


@query("a6_side_mean", "WITH s AS (SELECT user_id, event_id % 2 AS side, avg(value) FILTER (WHERE event_type <> 'error') AS m FROM events GROUP BY user_id, side) SELECT user_id, round(avg(m), 6) AS mean FROM s GROUP BY user_id")
def _a6(spark: SparkSession, d: str) -> DataFrame:
    sides = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 2).alias("side")).agg(F.avg(F.when(F.col("event_type") != "error", F.col("value"))).alias("m"))
    return sides.groupBy("user_id").agg(R6(F.avg("m")).alias("mean"))


@query("a10_merged_statistics", "SELECT l_returnflag, count(*) AS n, " + _S.format("l_quantity::DOUBLE") + " FROM lineitem GROUP BY l_returnflag")
def _a10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("x", F.col("l_quantity").cast("double"))
    parts = rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    found = stats.merged_statistics(parts, ["l_returnflag"])
    return found.select("l_returnflag", "n", *[R6(c).alias(c) for c in ("min", "max", "mean", "std")])


@query("a9_scalar_statistics", "SELECT l_linestatus, count(*) AS n, " + _S.format("l_extendedprice::DOUBLE") + " FROM lineitem GROUP BY l_linestatus")
def _a9(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("x", F.col("l_extendedprice").cast("double"))
    found = stats.summary(rows, ["l_linestatus"], "x")
    return found.select("l_linestatus", "n", *[R6(c).alias(c) for c in ("min", "max", "mean", "std")])


@query("a14_coverage", f"""WITH {FRAMES_SQL}, s AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY episode_id ORDER BY frame_idx)) AS sp FROM f)
       SELECT episode_id, count(*) FILTER (WHERE valid) AS present, round(max(sp), 6) AS max_speed, round(avg(sp), 6) AS mean_speed,
       CASE WHEN avg(valid::INT) > 0.8 THEN 'good' WHEN avg(valid::INT) > 0.4 THEN 'fair' ELSE 'poor' END AS band FROM s GROUP BY episode_id""")
def _a14(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("episode_id").orderBy("frame_idx")
    s = frames(spark, d).withColumn("sp", F.abs(F.col("value") - F.lag("value").over(w)))
    share = F.avg(F.col("valid").cast("int"))
    return s.groupBy("episode_id").agg(F.count(F.when(F.col("valid"), 1)).alias("present"), R6(F.max("sp")).alias("max_speed"), R6(F.avg("sp")).alias("mean_speed"), F.when(share > 0.8, "good").when(share > 0.4, "fair").otherwise("poor").alias("band"))


@query("a15_masked_rmse", """WITH e AS (SELECT label, unnest(range(8)) AS dim, unnest(list_slice(embedding, 1, 8)) AS a, unnest(list_slice(embedding, 9, 16)) AS b FROM embeddings)
       SELECT label::BIGINT AS label, dim::BIGINT AS dim, round(sqrt(avg(pow(a::DOUBLE - b::DOUBLE, 2))), 6) AS rmse FROM e WHERE dim <> 3 GROUP BY label, dim""")
def _a15(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    both = F.arrays_zip(F.slice("embedding", 1, 8).alias("a"), F.slice("embedding", 9, 8).alias("b"))
    each = e.select(F.col("label").cast("long").alias("label"), F.posexplode(both).alias("dim", "x")).filter("dim <> 3")
    gap = F.col("x.a").cast("double") - F.col("x.b").cast("double")
    return each.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(R6(F.sqrt(F.avg(gap * gap))).alias("rmse"))


@query("a16_lookahead_statistics", f"""WITH {FRAMES_SQL}, n AS (SELECT *, max(frame_idx) OVER (PARTITION BY episode_id) AS z FROM f), k AS (SELECT n.episode_id, n.frame_idx, unnest(range(5)) AS k, z FROM n)
       SELECT k.episode_id, k.k::BIGINT AS k, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM k JOIN f ON k.episode_id = f.episode_id AND f.frame_idx = least(k.frame_idx + k.k, z) GROUP BY k.episode_id, k.k""")
def _a16(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.clamped_windows(frames(spark, d), ["episode_id"], "frame_idx", "value", 5)
    each = rows.select("episode_id", F.posexplode("window").alias("k", "x"))
    return each.groupBy("episode_id", F.col("k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), R6(F.avg("x")).alias("mean"), R6(F.stddev_pop("x")).alias("std"))


@query("a17_range_summary", f"""WITH {FRAMES_SQL}, s AS (SELECT *, lag(value) OVER w AS v0, lag(t) OVER w AS t0 FROM f WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx))
       SELECT episode_id, round(min(value), 6) AS low, round(max(value), 6) AS high, round(max(abs(value - v0) / CASE WHEN t - t0 > 0 THEN t - t0 ELSE 0.1 END), 6) AS fastest FROM s GROUP BY episode_id""")
def _a17(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("episode_id").orderBy("frame_idx")
    s = frames(spark, d).withColumns({"v0": F.lag("value").over(w), "dt": F.col("t") - F.lag("t").over(w)})
    rate = F.abs(F.col("value") - F.col("v0")) / F.when(F.col("dt") > 0, F.col("dt")).otherwise(0.1)
    return s.groupBy("episode_id").agg(R6(F.min("value")).alias("low"), R6(F.max("value")).alias("high"), R6(F.max(rate)).alias("fastest"))


@query("a18_fingerprints", "SELECT c_custkey, sha256(concat_ws('|', c_custkey, c_name, c_nationkey)) AS fingerprint FROM customer")
def _a18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.sha2(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string")), 256).alias("fingerprint"))


@query("a19_frame_rate", f"WITH {FRAMES_SQL}, g AS (SELECT episode_id, count(*) AS n, max(t) AS s FROM f GROUP BY episode_id) SELECT episode_id, CASE WHEN n < 2 THEN 10.0 ELSE round((n - 1) / (s / 100000)) END::DOUBLE AS rate FROM g")
def _a19(spark: SparkSession, d: str) -> DataFrame:
    g = frames(spark, d).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("s"))
    return g.select("episode_id", sc.frames_per_second(F.col("n"), F.col("s") / 100_000).alias("rate"))


@query("a21_masked_mean", "SELECT l_linestatus, round(sum(l_quantity::DOUBLE * (l_returnflag = 'N')::INT) / sum((l_returnflag = 'N')::INT), 6) AS mean FROM lineitem GROUP BY l_linestatus")
def _a21(spark: SparkSession, d: str) -> DataFrame:
    on = (F.col("l_returnflag") == "N").cast("int")
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(R6(F.sum(F.col("l_quantity").cast("double") * on) / F.sum(on)).alias("mean"))


@query("k12_histogram_statistics", """WITH x AS (SELECT l_linestatus, l_quantity::BIGINT AS b FROM lineitem)
       SELECT l_linestatus, count(*) AS n, min(b) AS "min", max(b) AS "max", round(avg(b), 6) AS mean, round(stddev_pop(b), 6) AS std, quantile_disc(b, 0.5) AS q50 FROM x GROUP BY l_linestatus""")
def _k12(spark: SparkSession, d: str) -> DataFrame:
    bins = table(spark, d, "lineitem").groupBy("l_linestatus", F.col("l_quantity").cast("long").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    found = stats.histogram_statistics(bins, ["l_linestatus"], "b", "c", {"q50": 0.5})
    return found.select("l_linestatus", "n", "min", "max", R6("mean").alias("mean"), R6("std").alias("std"), "q50")


@query("j1_all_pairs", "SELECT s_suppkey AS ego, n_nationkey AS real FROM supplier CROSS JOIN nation")
def _j1(spark: SparkSession, d: str) -> DataFrame:
    return ds.paired(table(spark, d, "supplier").select(F.col("s_suppkey").alias("ego")), table(spark, d, "nation").select(F.col("n_nationkey").alias("real")))


@query("j1_fixed_pairs", "SELECT o_custkey AS ego, o_orderkey AS real FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _j1b(spark: SparkSession, d: str) -> DataFrame:
    ego = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("ego"))
    real = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("real"))
    return ds.paired(ego, real, table(spark, d, "orders").select(F.col("o_custkey").alias("ego"), F.col("o_orderkey").alias("real")))


@query("j4_positional_zip", """WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
       b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i FROM events)
       SELECT a.user_id, round(a.value, 6) AS left_value, round(b.value, 6) AS right_value FROM a JOIN b ON a.user_id = b.user_id AND a.i = b.i""")
def _j4(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as they came beside the same in order of value."""
    e = table(spark, d, "events")
    left = e.select("user_id", "event_id", R6("value").alias("left_value"))
    right = e.select("user_id", F.struct("value", "event_id").alias("at"), R6("value").alias("right_value"))
    return ds.zipped(left, right, ["user_id"], "event_id", "at").select("user_id", "left_value", "right_value")


_SIDES_SQL = f"""{FRAMES_SQL}, sd AS (SELECT episode_id // 2 AS pair, CASE WHEN episode_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, frame_idx, state FROM f WHERE valid)"""


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """Two users' valid rows as the two arms of one series."""
    f = frames(spark, d).filter("valid")
    return f.select(F.floor(F.col("episode_id") / 2).alias("pair"), F.when(F.col("episode_id") % 2 == 0, "left").otherwise("right").alias("side"), "frame_idx", "state")


def _thin_sql(of: str, count: int) -> str:
    """CTE pk: frames of {of} (pair, frame_idx, l, r: the states) that are thinned, or next to a change."""
    w = "(PARTITION BY pair ORDER BY frame_idx)"
    return f"""n0 AS (SELECT *, row_number() OVER {w} - 1 AS k, count(*) OVER (PARTITION BY pair) AS c, lag(l) OVER {w} AS l0, lag(r) OVER {w} AS r0, lead(l) OVER {w} AS l1, lead(r) OVER {w} AS r1 FROM {of}),
       pt AS (SELECT DISTINCT pair, round_even(i * (c - 1) / {count - 1}.0, 0)::BIGINT AS k FROM n0 CROSS JOIN range({count}) t(i)),
       pk AS (SELECT n0.pair, frame_idx FROM n0 LEFT JOIN pt ON n0.pair = pt.pair AND n0.k = pt.k WHERE c <= {count} OR pt.k IS NOT NULL OR l0 <> l OR r0 <> r OR l1 <> l OR r1 <> r)"""


_BOTH_SQL = "cm AS (SELECT pair, frame_idx, max(state) FILTER (WHERE side = 'left') AS l, max(state) FILTER (WHERE side = 'right') AS r FROM {of} GROUP BY pair, frame_idx HAVING count(DISTINCT side) = 2)"


@query("j5_common_frames", f"WITH {_SIDES_SQL}, {_BOTH_SQL.format(of='sd')}, {_thin_sql('cm', 12)} SELECT pair, frame_idx FROM pk")
def _j5(spark: SparkSession, d: str) -> DataFrame:
    return ds.common_frames(_sides(spark, d), ["pair"], "side", "frame_idx", "state", ["left", "right"], 12)


@query("j6_first_event_entry", f"""WITH {_SIDES_SQL}, ch AS (SELECT *, lag(state) OVER (PARTITION BY pair, side ORDER BY frame_idx) AS s0 FROM sd), en AS (SELECT pair, side, min(frame_idx) AS entry FROM ch WHERE s0 <> state GROUP BY pair, side),
       lt AS (SELECT pair, max(entry) AS latest FROM en GROUP BY pair HAVING count(*) = 2), tl AS (SELECT sd.* FROM sd JOIN lt ON sd.pair = lt.pair AND frame_idx > latest), {_BOTH_SQL.format(of='tl')}, {_thin_sql('cm', 9)}
       SELECT en.pair, side, entry AS frame_idx FROM en JOIN lt ON en.pair = lt.pair UNION ALL SELECT pair, unnest(['left', 'right']), frame_idx FROM pk""")
def _j6(spark: SparkSession, d: str) -> DataFrame:
    return ds.entries_and_tail(_sides(spark, d), ["pair"], "side", "frame_idx", "state", ["left", "right"], 10)


@query("j8_task_remap", """WITH t AS (SELECT p_type AS name, min(p_partkey) AS k FROM part GROUP BY 1), i AS (SELECT name, row_number() OVER (ORDER BY k) - 1 AS task_index FROM t) SELECT p_partkey, task_index FROM part JOIN i ON p_type = name""")
def _j8(spark: SparkSession, d: str) -> DataFrame:
    """Each brand has an index of its own for its types; all get one list in order of first appearance."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("source"), F.col("p_type").alias("task"), F.xxhash64("p_type").alias("task_index"))
    tasks = part.select("source", "task_index", "task").distinct()
    return ds.remapped_tasks(part.drop("task"), tasks, ["p_partkey"]).select("p_partkey", "task_index")


@query("k7_comparable", """WITH s AS (SELECT l_linestatus AS variant, l_returnflag AS side, list_sort(list(DISTINCT l_suppkey)) AS p FROM lineitem GROUP BY 1, 2), b AS (SELECT side, arg_min(p, variant) AS base FROM s GROUP BY side)
       SELECT variant, s.side, len(p) AS n_pairs, p = base AS comparable FROM s JOIN b ON s.side = b.side""")
def _k7(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("variant"), F.col("l_returnflag").alias("side"), "l_suppkey")
    return ds.comparable(rows, "variant", "side", ["l_suppkey"])


@query("k8_cotrain_episodes", """WITH a AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AS real, l_quantity::DOUBLE AS x, l_returnflag AS pattern FROM lineitem)
       SELECT l_orderkey AS episode, CASE WHEN bool_and(real) THEN 1 ELSE 0 END AS domain, count(*) AS length, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
              count(*) FILTER (WHERE pattern = 'A') AS n_head, count(*) FILTER (WHERE pattern = 'N') AS n_both, count(*) FILTER (WHERE pattern = 'R') AS n_left FROM a GROUP BY l_orderkey""")
def _k8(spark: SparkSession, d: str) -> DataFrame:
    """Orders as episodes of two domains (open ones as real), with statistics and the counts of their camera masks."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode"), F.col("l_quantity").cast("double").alias("x"), F.col("l_returnflag").alias("pattern"), (F.col("l_linestatus") == "O").alias("real"))
    found = ds.cotrain_episodes(rows, "episode", "real", "x", "pattern", {"head": "A", "both": "N", "left": "R"})
    return found.select("episode", "domain", "length", R6("mean").alias("mean"), R6("std").alias("std"), "n_head", "n_both", "n_left")


@query("k10_latest_record", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def _k10(spark: SparkSession, d: str) -> DataFrame:
    return ds.latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("k11_run_summary", "SELECT o_orderpriority AS run, o_custkey AS episode, count(*) AS n_records, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, bool_or(o_orderstatus = 'F') AS ever_complete FROM orders GROUP BY 1, 2")
def _k11(spark: SparkSession, d: str) -> DataFrame:
    """Run by episode: how many records, the last one's status, and whether any was complete."""
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_custkey").alias("episode"), F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    return ds.run_report(orders, "run", "episode", "status", ["o_orderdate", "o_orderkey"], "F")


@query("u1_reindexed_union", """WITH a AS (SELECT 0 AS source, o_custkey AS source_episode, o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O')
       SELECT source, source_episode, row_number() OVER (PARTITION BY source, source_episode ORDER BY o) - 1 AS frame_index, dense_rank() OVER (ORDER BY source, source_episode) - 1 AS episode_index,
       row_number() OVER (ORDER BY source, source_episode, o) - 1 AS "index", o AS o_orderkey FROM a""")
def _u1(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    parts = [orders.filter(F.col("o_orderstatus") == s) for s in ("F", "O")]
    return ds.reindexed_union(parts, "o_custkey", "k", ["o_orderkey"])


@query("u3_mask_dropout")
def _u3(spark: SparkSession, d: str) -> DataFrame:
    """Four camera patterns with shares 1/2, 1/4, 1/8, 1/8, by a keyed hash of the row."""
    bucket = F.pmod(F.xxhash64("event_id", F.lit(7)), F.lit(8))
    pattern = F.when(bucket < 4, "both").when(bucket < 6, "head").when(bucket < 7, "left").otherwise("right")
    return table(spark, d, "events").select("event_id", pattern.alias("pattern"))


@query("u4_materialised", f"""WITH {FRAMES_SQL}, n AS (SELECT *, lead(valid) OVER w AS nv, lead(value) OVER w AS nx FROM f WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx))
       SELECT episode_id, frame_idx, CASE WHEN episode_id % 10 = 0 THEN 'eval' ELSE 'train' END AS part, round(nx, 6) AS action FROM n WHERE valid AND nv""")
def _u4(spark: SparkSession, d: str) -> DataFrame:
    f = rs.next_row(frames(spark, d), ["episode_id"], "frame_idx", "value", "action")
    kept = rs.consecutive_valid(f, ["episode_id"], "frame_idx", "valid")
    return kept.select("episode_id", "frame_idx", F.when(F.col("episode_id") % 10 == 0, "eval").otherwise("train").alias("part"), R6("action").alias("action"))


@query("u6_train_steps", "SELECT l_linestatus, (floor(count(*) / 32) * 3)::BIGINT AS steps FROM lineitem GROUP BY l_linestatus")
def _u6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg((F.floor(F.count(F.lit(1)) / 32) * 3).cast("long").alias("steps"))


@query("p5_id_spec", "SELECT c_custkey FROM customer WHERE c_custkey IN (1, 4) OR c_custkey BETWEEN 10 AND 15 OR c_custkey BETWEEN 20 AND 22")
def _p5(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.range(1).select(F.explode(sc.id_list(F.lit("1,4,10:15,20-22"))).alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(F.broadcast(ids), "c_custkey", "left_semi")  # a list typed by hand


@query("p7_split_faults", """WITH s AS (SELECT o_orderpriority AS part, o_custkey AS item FROM orders), c AS (SELECT item, count(*) AS n, count(DISTINCT part) AS p FROM s GROUP BY item)
       SELECT item, 'in several parts' AS fault FROM c WHERE p > 1 UNION ALL SELECT item, 'repeated' FROM c WHERE n > p
       UNION ALL SELECT DISTINCT item, 'unknown' FROM s WHERE item NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def _p7(spark: SparkSession, d: str) -> DataFrame:
    split = table(spark, d, "orders").select(F.col("o_orderpriority").alias("part"), F.col("o_custkey").alias("item"))
    known = table(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("item"))
    return ds.split_faults(split, known, "part", "item")


@query("p8_leakage", "SELECT DISTINCT o_custkey AS item FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _p8(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("item"), "o_orderstatus")
    used, held = orders.filter("o_orderstatus = 'P'"), orders.filter("o_orderstatus = 'F'")
    return used.join(held, "item", "left_semi").select("item").distinct()


@query("p9_common_cohort", "WITH h AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT o_custkey::VARCHAR AS o_custkey FROM h WHERE n = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def _p9(spark: SparkSession, d: str) -> DataFrame:
    return ds.complete_everywhere(table(spark, d, "orders"), "o_custkey", "o_orderpriority", F.col("o_orderstatus") != "P")


@query("p11_confidence_filter", "SELECT event_id, CASE WHEN value >= 40 THEN event_type END AS kept FROM events")
def _p11(spark: SparkSession, d: str) -> DataFrame:
    return ds.confident(table(spark, d, "events"), "value", 40.0, ["event_type"]).select("event_id", F.col("event_type").alias("kept"))


@query("p12_dominant_side", """WITH s AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, sum(value) AS total FROM events GROUP BY 1, 2)
       SELECT user_id, side, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, side DESC) AS k FROM s) WHERE k = 1""")
def _p12(spark: SparkSession, d: str) -> DataFrame:
    sided = table(spark, d, "events").withColumn("side", F.when(F.col("event_id") % 2 == 0, "left").otherwise("right"))
    return ds.dominant_side(sided, ["user_id"], "side", "value").withColumn("total", R6("total"))


@query("p16_freshness", f"WITH {FRAMES_SQL}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS age FROM f) SELECT episode_id, count(*) FILTER (WHERE age > 100000) AS stale, round(max(age), 4) AS worst FROM g GROUP BY episode_id")
def _p16(spark: SparkSession, d: str) -> DataFrame:
    return ev.staleness(frames(spark, d), ["episode_id"], "frame_idx", "t", 100_000.0).withColumn("worst", F.round("worst", 4))


@query("p16_camera_faults", """WITH a AS (SELECT o_custkey, o_orderstatus, epoch(o_orderdate::TIMESTAMP) AS t FROM orders), g AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n, max(915148800 - t) AS age, max(t) - min(t) AS skew FROM a GROUP BY 1)
       SELECT o_custkey, CASE WHEN n < 3 THEN 'camera missing' WHEN age > 86400 * 2300 THEN 'too old' WHEN skew > 86400 * 1800 THEN 'skew' END AS fault FROM g""")
def _p16b(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as frames of three cameras, by status."""
    stamps = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t"), F.lit(915_148_800).alias("now"))
    return guards.camera_faults(stamps, ["o_custkey"], "o_orderstatus", "t", "now", ["F", "O", "P"], 86_400 * 2300, 86_400 * 1800)


@query("p20_single_task", "SELECT o_custkey, count(DISTINCT o_orderpriority) = 1 AS single FROM orders GROUP BY o_custkey")
def _p20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.count_distinct("o_orderpriority") == 1).alias("single"))


@query("p21_names_to_columns", "SELECT vec_id, round(embedding[3]::DOUBLE, 6) AS gripper, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings")
def _p21(spark: SparkSession, d: str) -> DataFrame:
    picked = sc.column_of(["x", "y", "gripper", "w"], ["gripper", "x"], F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", R6(picked[0].cast("double")).alias("gripper"), R6(picked[1].cast("double")).alias("x"))


@query("p17_package_faults", """WITH e AS (SELECT o_orderkey, o_custkey::VARCHAR || '.json' AS source, sha256(o_comment_) AS fp, o_orderstatus AS sg FROM (SELECT *, o_orderpriority AS o_comment_ FROM orders)),
       p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'moved.json' ELSE source END AS source, CASE WHEN o_orderkey % 7 = 0 THEN 'x' WHEN o_orderkey % 3 = 0 THEN NULL ELSE fp END AS fp, CASE WHEN sg = 'P' THEN 'F' ELSE sg END AS sg FROM e WHERE o_orderkey % 11 <> 0)
       SELECT e.o_orderkey AS episode, CASE WHEN p.o_orderkey IS NULL THEN 'not packaged' WHEN e.sg <> p.sg THEN 'another package' WHEN e.source <> p.source THEN 'another source' ELSE 'another fingerprint' END AS fault
       FROM e LEFT JOIN p ON e.o_orderkey = p.o_orderkey WHERE p.o_orderkey IS NULL OR e.sg <> p.sg OR e.source <> p.source OR e.fp <> p.fp""")
def _p17(spark: SparkSession, d: str) -> DataFrame:
    """Orders as packaged episodes, some of them missing, moved, of another signature or content."""
    k = F.col("o_orderkey")
    own = table(spark, d, "orders").select(F.lit("e").alias("experiment"), F.lit("v").alias("variant"), k.alias("episode"), F.col("o_orderstatus").alias("signature"), F.concat(F.col("o_custkey").cast("string"), F.lit(".json")).alias("source"), F.sha2("o_orderpriority", 256).alias("fingerprint"))
    e = F.col("episode")
    packaged = own.filter(e % 11 != 0).withColumns({"source": F.when(e % 5 == 0, "moved.json").otherwise(F.col("source")), "fingerprint": F.when(e % 7 == 0, "x").when(e % 3 == 0, None).otherwise(F.col("fingerprint")), "signature": F.when(F.col("signature") == "P", "F").otherwise(F.col("signature"))})
    return guards.package_faults(packaged, own).select("episode", "fault")


@query("f20_short_variants", """SELECT DISTINCT p_type, p_brand, p_type || CASE p_brand WHEN 'Brand#1' THEN '' WHEN 'Brand#2' THEN '+xyz' WHEN 'Brand#3' THEN '+xyz_all' ELSE '+' || p_brand END AS short FROM part""")
def _f20(spark: SparkSession, d: str) -> DataFrame:
    correction = F.col("p_brand")
    for maker, name in (("Brand#1", "none"), ("Brand#2", "xyz_mean_target_min_bending"), ("Brand#3", "xyz_mean_target_min_bending_all_anchors")):
        correction = F.when(F.col("p_brand") == maker, name).otherwise(correction)
    kinds = table(spark, d, "part").select("p_type", "p_brand").distinct()
    return kinds.select("p_type", "p_brand", sc.short_variant(F.concat("p_type", F.lit("_hys085")), correction).alias("short"))
