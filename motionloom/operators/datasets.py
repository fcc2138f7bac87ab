"""Dataset operators: union with reindex, task tables, splits, cohorts, upserts, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reindexed_union(parts: list[DataFrame], episode: str, order: str, keep: list[str]) -> DataFrame:
    """Datasets one after the other: episodes numbered on from 0, frame within episode, index over all.

    Row numbers come from per-episode counts, added up over the (few) episodes, so no
    window spans more than one episode's rows.
    """
    tagged = [p.select(F.lit(k).alias("source"), F.col(episode).alias("source_episode"), F.col(order).alias("_o"), *keep) for k, p in enumerate(parts)]
    rows = tagged[0]
    for more in tagged[1:]:
        if more.schema != rows.schema:
            raise ValueError("datasets differ in their schema")
        rows = rows.unionByName(more)
    w = Window.partitionBy("source", "source_episode").orderBy("_o")
    framed = rows.withColumn("frame_index", (F.row_number().over(w) - 1).cast("long")).drop("_o")
    sizes = rows.groupBy("source", "source_episode").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("source", "source_episode")  # one row for each episode
    numbered = sizes.select("source", "source_episode", (F.row_number().over(upto) - 1).cast("long").alias("episode_index"), (F.sum("_n").over(upto) - F.col("_n")).alias("_start"))
    joined = framed.join(numbered, ["source", "source_episode"])
    return joined.withColumn("index", F.col("_start") + F.col("frame_index")).drop("_start")


def task_indices(tasks: DataFrame, order: list[str], name: str) -> DataFrame:
    """task_index by first appearance of each name."""
    first = tasks.groupBy(name).agg(F.min(F.struct(*order)).alias("_first"))
    return first.select(name, (F.row_number().over(Window.orderBy("_first")) - 1).cast("long").alias("task_index"))  # one row for each task


def complete_everywhere(states: DataFrame, item: str, variant: str, done: Column) -> DataFrame:
    """Items done in every variant (relational division), ids as text."""
    total = states.agg(F.count_distinct(variant).alias("_all"))
    held = states.filter(done).groupBy(item).agg(F.count_distinct(variant).alias("_n"))
    return held.join(F.broadcast(total), F.col("_n") == F.col("_all")).select(F.col(item).cast("string").alias(item))  # total is one row


def split_faults(split: DataFrame, known: DataFrame, part: str, item: str) -> DataFrame:
    """(item, fault): repeated in a part, in several parts, or unknown."""
    counts = split.groupBy(item).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(part).alias("_p"))
    several = counts.filter("_p > 1").select(item, F.lit("in several parts").alias("fault"))
    repeated = counts.filter("_n > _p").select(item, F.lit("repeated").alias("fault"))
    unknown = split.select(item).distinct().join(known.select(item), item, "left_anti").select(item, F.lit("unknown").alias("fault"))
    return several.unionByName(repeated).unionByName(unknown)


def latest(records: DataFrame, key: list[str], at: list[str]) -> DataFrame:
    """The last record of every key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in at])
    return records.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def dominant_side(detections: DataFrame, by: list[str], side: str, confidence: str, mode: str = "auto") -> DataFrame:
    """The sides to keep and their sums of confidence: auto keeps the larger sum's (right if equal), left or right that side, both all."""
    sums = detections.groupBy(*by, side).agg(F.sum(confidence).alias("total"))
    if mode != "auto":
        return sums if mode == "both" else sums.filter(F.col(side) == mode)
    w = Window.partitionBy(*by).orderBy(F.desc("total"), F.when(F.col(side) == "right", 0).otherwise(1))
    return sums.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


#: Ids of a cohort up to which it is broadcast.
MAX_COHORT = 100_000


def paired(ego: DataFrame, real: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(ego, real): all pairs of two evaluated cohorts, or those of `wanted` that lie in both, repeats kept."""
    if wanted is None:
        ids = real.select("real")
        few = ids.limit(MAX_COHORT + 1).count() <= MAX_COHORT
        return ego.select("ego").crossJoin(F.broadcast(ids) if few else ids)
    return wanted.join(ego, "ego", "left_semi").join(real, "real", "left_semi")


def zipped(left: DataFrame, right: DataFrame, by: list[str], left_order: str, right_order: str, strict: bool = True) -> DataFrame:
    """Row i of the one with row i of the other, within each series; if strict, other lengths are an error, else the rest is left out."""
    number = lambda df, o, flag: df.withColumns({"_i": F.row_number().over(Window.partitionBy(*by).orderBy(o)), flag: F.lit(True)})
    both = number(left, left_order, "_l").join(number(right, right_order, "_r"), [*by, "_i"], "full_outer" if strict else "inner")
    if strict:
        place = F.when(F.col("_l") & F.col("_r"), F.col("_i"))
        return both.filter(F.coalesce(place, F.raise_error(F.lit("series of different lengths can't be zipped")).cast("int")) > 0).drop("_i", "_l", "_r")
    return both.drop("_i", "_l", "_r")


def episode_table(source: DataFrame, raw: DataFrame, final: DataFrame, joints: DataFrame, episode: str, order: str, timestamp: str, start_index: int = 0, task: str | None = None) -> DataFrame:
    """Source rows zipped by position with raw poses, final poses and joints, numbered anew.

    Each input has `episode` and `order`; final columns follow in that order. Rows keep
    source_episode_index, source_frame_index and source_timestamp; timestamp starts at
    zero, index counts on from start_index, and with a task all rows have task_index 0.
    Inputs of other lengths are an error.
    """
    rows = source.withColumns({"source_frame_index": F.col(order), "source_timestamp": F.col(timestamp).cast("double")})
    for k, more in enumerate((raw, final, joints)):
        rows = zipped(rows, more.withColumnRenamed(order, f"_o{k}"), [episode], "source_frame_index", f"_o{k}").drop(f"_o{k}")
    first = F.min("source_timestamp").over(Window.partitionBy(episode))
    rows = rows.withColumn("timestamp", (F.col("source_timestamp") - first).cast("float"))
    keep = [c for c in rows.columns if c not in (episode, "frame_index", "index", "episode_index")]
    done = reindexed_union([rows], episode, "source_frame_index", keep).drop("source").withColumnRenamed("source_episode", "source_episode_index")
    done = done.withColumn("index", F.col("index") + start_index)
    return done if task is None else done.withColumn("task_index", F.lit(0).cast("long"))


def comparable(records: DataFrame, variant: str, side: str, pair: list[str]) -> DataFrame:
    """Per variant and side its number of pairs, and whether these are the first variant's.

    Sets are compared by their size and two order-free sums of 64-bit hashes, so none is gathered.
    """
    pairs = records.select(variant, side, *pair).distinct()
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *pair).cast("decimal(38,0)"))
    sets = pairs.groupBy(variant, side).agg(F.count(F.lit(1)).alias("n_pairs"), F.struct(F.count(F.lit(1)).alias("n"), total(1).alias("s1"), total(2).alias("s2")).alias("_set"))
    base = sets.groupBy(side).agg(F.min_by("_set", variant).alias("_base"))
    return sets.join(base, side).select(variant, side, "n_pairs", (F.col("_set") == F.col("_base")).alias("comparable"))


def unknown_tasks(rows: DataFrame, tasks: DataFrame, key: list[str]) -> DataFrame:
    """The task references in rows that tasks does not have."""
    return rows.select(*key).distinct().join(tasks.select(*key), key, "left_anti")


def remapped_tasks(rows: DataFrame, tasks: DataFrame, order: list[str]) -> DataFrame:
    """rows (source, task_index) with the output's task_index, by tasks (source, task_index, task) in order of first appearance.

    An index that its source does not know is an error.
    """
    named = rows.join(tasks.select("source", "task_index", "task"), ["source", "task_index"], "left")
    lost = F.raise_error(F.concat(F.lit("unknown task index: "), F.col("task_index").cast("string"))).cast("string")
    named = named.withColumn("task", F.coalesce("task", lost)).drop("task_index")
    return named.join(task_indices(named, order, "task"), "task")


def common_frames(sides: DataFrame, by: list[str], side: str, frame: str, state: str, names: list[str], count: int) -> DataFrame:
    """(by, frame): frames that all sides of a series have, thinned to `count`, and both sides of each change of state."""
    held = sides.groupBy(*by, frame).agg(F.count_distinct(side).alias("_n"), *[F.max(F.when(F.col(side) == n, F.col(state))).alias(f"_s{k}") for k, n in enumerate(names)])
    w = Window.partitionBy(*by).orderBy(frame)
    shared = held.filter(F.col("_n") == len(names)).withColumns({"_k": F.row_number().over(w) - 1, "_c": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    changed = lambda shift: F.greatest(*[F.coalesce((shift(f"_s{k}").over(w) != F.col(f"_s{k}")).cast("int"), F.lit(0)) for k in range(len(names))], F.lit(0)) == 1
    from .resample import picks

    kept = shared.withColumns({"_edge": changed(F.lag) | changed(F.lead), "_pick": F.array_contains(picks(F.col("_c"), count), F.col("_k").cast("long")) | (F.col("_c") <= count)})
    return kept.filter(F.col("_edge") | F.col("_pick")).select(*by, frame)


def entries_and_tail(sides: DataFrame, by: list[str], side: str, frame: str, state: str, names: list[str], count: int) -> DataFrame:
    """(by, side, frame): each side's first change of state, then the common frames after the latest of these.

    The tail is thinned to count - 1 frames; later changes keep both their sides. A series
    in which a side never changes has no rows.
    """
    w = Window.partitionBy(*by, side).orderBy(frame)
    first = sides.withColumn("_b", F.lag(state).over(w)).filter(F.col("_b") != F.col(state)).groupBy(*by, side).agg(F.min(frame).alias("_entry"))
    latest = first.groupBy(*by).agg(F.max("_entry").alias("_latest"), F.count(F.lit(1)).alias("_sides")).filter(F.col("_sides") == len(names))
    entries = first.join(latest, by).select(*by, side, F.col("_entry").alias(frame))
    tail = sides.join(latest.select(*by, "_latest"), by).filter(F.col(frame) > F.col("_latest"))
    return entries.unionByName(common_frames(tail, by, side, frame, state, names, count - 1).withColumn(side, F.explode(F.array(*[F.lit(n) for n in names]))).select(*by, side, frame))


def confident(detections: DataFrame, confidence: str, least: float, columns: list[str]) -> DataFrame:
    """Detections of less confidence become null; their rows stay."""
    sure = F.coalesce(F.col(confidence) >= least, F.lit(False))
    return detections.withColumns({c: F.when(sure, F.col(c)) for c in columns})


def run_report(records: DataFrame, run: str, episode: str, status: str, at: list[str], done: str) -> DataFrame:
    """(run, episode, n_records, status, ever_complete): the last record's status, and whether any was `done`."""
    last = F.max_by(status, F.struct(*at))
    return records.groupBy(run, episode).agg(F.count(F.lit(1)).alias("n_records"), last.alias("status"), F.bool_or(F.col(status) == done).alias("ever_complete"))


def cotrain_episodes(rows: DataFrame, episode: str, real: str, value: str, pattern: str, masks: dict[str, str]) -> DataFrame:
    """Per episode: domain (1 if all its rows are real, else 0), length, statistics of a value, and n_<name> rows of each mask pattern."""
    counts = [F.count_if(F.col(pattern) == p).alias(f"n_{name}") for name, p in masks.items()]
    return rows.groupBy(episode).agg(F.min(F.col(real).cast("int")).alias("domain"), F.count(F.lit(1)).alias("length"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), *counts)


def hash_split(ids: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """ids with part: eval for about `share` of them, by a keyed digest's first 32 bits; no id needs to know of another."""
    border = f"{min(2**32 - 1, int(share * 2**32)):08x}"
    digest = F.sha2(F.concat(F.lit(seed + "|"), F.col(key).cast("string")), 256)
    return ids.withColumn("part", F.when(F.substring(digest, 1, 8) < border, "eval").otherwise("train"))


def concatenated(roots: list[tuple[DataFrame, dict]], episode: str, order: str, task: str, fps: str = "fps", video: str = "video_keys") -> tuple[DataFrame, DataFrame]:
    """(rows, tasks) of several datasets as one: episodes, frames and index numbered on, task_index by first appearance.

    Each root is its rows and its info; another rate or other videos than the first root's
    are an error. A missing timestamp is the frame over the rate.
    """
    first = roots[0][1]
    for _, info in roots[1:]:
        if info[fps] != first[fps] or sorted(info.get(video, [])) != sorted(first.get(video, [])):
            raise ValueError("datasets differ in their rate or videos")
    keep = [c for c in roots[0][0].columns if c not in (episode, "episode_index", "frame_index", "index")]
    rows = reindexed_union([r for r, _ in roots], episode, order, keep)
    if "timestamp" in keep:
        rows = rows.withColumn("timestamp", F.coalesce(F.col("timestamp").cast("double"), F.col("frame_index") / F.lit(float(first[fps]))))
    tasks = task_indices(rows, ["episode_index", "frame_index"], task)
    return rows.join(tasks, task), tasks


def preferred(items: DataFrame, first: DataFrame, second: DataFrame, key: list[str], value: str) -> DataFrame:
    """items with the value that first has for them, else second's, else null."""
    joined = items.join(first.withColumnRenamed(value, "_first"), key, "left").join(second.withColumnRenamed(value, "_second"), key, "left")
    return joined.withColumn(value, F.coalesce("_first", "_second")).drop("_first", "_second")
