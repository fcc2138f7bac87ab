"""Summaries, mergeable statistics, noise floors and ratio metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, population deviation, median, least and largest of the known values."""
    x = F.col(value)
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.percentile(x, 0.5).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"))


def column_statistics(df: DataFrame, by: list[str], vector: str, where: Column | None = None) -> DataFrame:
    """Per dimension of a vector column: count, range, mean, population deviation and five quantiles of finite values."""
    rows = df if where is None else df.filter(where)
    each = rows.select(*by, F.posexplode(vector).alias("dim", "x")).filter("x is not null and not isnan(x) and abs(x) < double('infinity')")
    levels = [0.01, 0.10, 0.50, 0.90, 0.99]
    q = F.percentile("x", F.array(*[F.lit(p) for p in levels]))
    found = each.groupBy(*by, "dim").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), q.alias("q"))
    return found.select(*by, "dim", "n", "min", "max", "mean", "std", *[F.col("q")[i].alias(f"q{round(100 * p):02d}") for i, p in enumerate(levels)])


def merged_statistics(parts: DataFrame, by: list[str], source: str | None = None) -> DataFrame:
    """Pooled n, range, mean and deviation from the n, min, max, mean and std of parts.

    With source, each source must have every group once, else it is an error.
    """
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    square = F.sum(F.col("n") * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean"))) / n
    held = [F.count(source).alias("_held"), F.count_distinct(source).alias("_sources")] if source else []
    pooled = parts.groupBy(*by).agg(n.alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), mean.alias("mean"), square.alias("_square"), *held)
    if source:
        total = parts.agg(F.count_distinct(source).alias("_all"))
        pooled = pooled.crossJoin(F.broadcast(total))  # one row
        same = (F.col("_held") == F.col("_all")) & (F.col("_sources") == F.col("_all"))
        pooled = pooled.withColumn("n", F.when(same, F.col("n")).otherwise(F.raise_error(F.lit("sources have different groups")).cast("long"))).drop("_held", "_sources", "_all")
    return pooled.withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("_square") - F.col("mean") * F.col("mean")))).drop("_square")


def shrunk_gaussian(df: DataFrame, by: list[str], parts: list[str], shrinkage: float) -> DataFrame:
    """Mean and sample covariance of points, shrunk to its mean variance; series of one point are left out."""
    pairs = [(a, b) for i, a in enumerate(parts) for b in parts[i:]]
    aggs = [F.avg(p).alias(f"mean_{p}") for p in parts] + [F.covar_samp(a, b).alias(f"_{a}{b}") for a, b in pairs]
    fit = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs).filter("n >= 2")
    trace = sum((F.col(f"_{p}{p}") for p in parts[1:]), F.col(f"_{parts[0]}{parts[0]}"))
    spread = F.greatest(trace / len(parts), F.lit(1e-10))
    cell = lambda a, b: (1 - shrinkage) * F.col(f"_{a}{b}") + (F.lit(shrinkage) * spread + 1e-10 if a == b else 0.0)
    return fit.select(*by, "n", *[f"mean_{p}" for p in parts], *[cell(a, b).alias(f"cov_{a}{b}") for a, b in pairs])


def unordered_pairs(ids: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, a, b) with a < b: all pairs within a cohort, for cohorts that are evaluated pair by pair.

    Only ids are paired; what belongs to them is fetched by equal joins afterwards.
    """
    keyed = ids.select(*by, F.col(key)) if by else ids.select(F.lit(0).alias("_one"), F.col(key))
    on = by or ["_one"]
    left, right = keyed.withColumnRenamed(key, "a"), keyed.withColumnRenamed(key, "b")
    return left.join(right, on).filter("a < b").select(*by, "a", "b")


def noise_floor(pairs: DataFrame, by: list[str], distance: str) -> DataFrame:
    """Per item its mean distance to all others, from unordered pairs (a, b): sum / (n - 1)."""
    both = pairs.select(*by, F.col("a").alias("item"), F.col(distance).alias("d")).unionByName(pairs.select(*by, F.col("b").alias("item"), F.col(distance).alias("d")))
    return both.groupBy(*by, "item").agg(F.avg("d").alias("floor"))


def leave_one_out_offset(points: DataFrame, by: list[str], parts: list[str]) -> DataFrame:
    """Distance of every point from the mean of the others of its cohort; null for a single point.

    The cohorts' sums are aggregated and joined back, so no task holds a whole cohort.
    """
    sums = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(p).alias(f"_{p}") for p in parts])
    joined = points.join(sums, by) if by else points.crossJoin(F.broadcast(sums))  # one row
    others = {p: (F.col(f"_{p}") - F.col(p)) / F.when(F.col("_n") > 1, F.col("_n") - 1) for p in parts}
    gap = sum((F.pow(F.col(p) - others[p], F.lit(2)) for p in parts[1:]), F.pow(F.col(parts[0]) - others[parts[0]], F.lit(2)))
    return joined.withColumn("offset", F.sqrt(gap)).drop("_n", *[f"_{p}" for p in parts])


def complete_cohort(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_items, n_pairs, complete): whether unordered pairs (a, b) hold n (n - 1) / 2 of their n items."""
    items = pairs.select(*by, F.explode(F.array("a", "b")).alias("item")).groupBy(*by).agg(F.count_distinct("item").alias("n_items"))
    held = pairs.groupBy(*by).agg(F.count_distinct("a", "b").alias("n_pairs"))
    joined = items.join(held, by) if by else items.crossJoin(F.broadcast(held))  # one row
    return joined.withColumn("complete", F.col("n_pairs") == F.col("n_items") * (F.col("n_items") - 1) / 2)


#: Distances between two trajectories: position (m), rotation (degrees), shape (m), offset of centroids (m).
DISTANCES = ["pos", "rot", "shape"]


def ratio_metrics(records: DataFrame, floors: DataFrame, by: list[str], ego: str, centroid: list[str]) -> DataFrame:
    """rho_pos, rho_rot, rho_shape, rho_offset and rho_se3 by variant: pair records to ego means, over the floors, to variant means.

    records has d_pos, d_rot, d_shape and the ego's centroid; floors is one row of floor_pos,
    floor_rot, floor_shape, floor_offset, the references' centroid (the same columns) and
    n_references. An ego without all references is an error, and so is a floor of 1e-12 or less.
    """
    egos = records.groupBy(*by, ego).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"d_{d}").alias(f"d_{d}") for d in DISTANCES], *[F.avg(c).alias(c) for c in centroid])
    one = floors.select(*[f"floor_{d}" for d in [*DISTANCES, "offset"]], "n_references", *[F.col(c).alias(f"_{c}") for c in centroid])
    joined = egos.crossJoin(F.broadcast(one))  # one row
    square = sum((F.pow(F.col(c) - F.col(f"_{c}"), F.lit(2)) for c in centroid[1:]), F.pow(F.col(centroid[0]) - F.col(f"_{centroid[0]}"), F.lit(2)))
    joined = joined.withColumn("d_offset", F.sqrt(square))
    lacks = F.concat(F.lit("an ego has other references than all: "), F.col(ego).cast("string"))
    whole = F.when(F.col("n") == F.col("n_references"), F.lit(1.0)).otherwise(F.raise_error(lacks).cast("double"))
    over = lambda d: F.col(f"d_{d}") / F.when(F.col(f"floor_{d}") > 1e-12, F.col(f"floor_{d}")).otherwise(F.raise_error(F.lit(f"the floor of {d} is zero")).cast("double"))
    rho = joined.withColumns({f"rho_{d}": whole * over(d) for d in [*DISTANCES, "offset"]})
    rho = rho.withColumn("rho_se3", F.sqrt(F.col("rho_pos") * F.col("rho_rot")))
    return rho.groupBy(*by).agg(F.count(F.lit(1)).alias("n_ego"), *[F.avg(f"rho_{d}").alias(f"rho_{d}") for d in [*DISTANCES, "offset", "se3"]])


def clamped_windows(df: DataFrame, by: list[str], index: str, value: str, horizon: int) -> DataFrame:
    """Each row with its next `horizon` values, itself first; the series' last value repeats."""
    w = Window.partitionBy(*by).orderBy(index)
    ahead = F.collect_list(value).over(w.rowsBetween(0, horizon - 1))
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("_ahead", ahead).withColumn("window", F.concat("_ahead", F.array_repeat(last, horizon - F.size("_ahead")))).drop("_ahead")


def histogram_statistics(bins: DataFrame, by: list[str], bin_: str, count: str, levels: dict[str, float]) -> DataFrame:
    """Exact range, mean, deviation and quantiles of binned values; the quantile p is the bin of rank p * (n - 1)."""
    w = Window.partitionBy(*by).orderBy(bin_)
    upto = bins.withColumns({"_upto": F.sum(count).over(w), "_n": F.sum(count).over(Window.partitionBy(*by))})
    b, c = F.col(bin_), F.col(count)
    quantiles = [F.min(F.when(F.col("_upto") > F.lit(p) * (F.col("_n") - 1), b)).alias(name) for name, p in levels.items()]
    found = upto.filter(c > 0).groupBy(*by).agg(F.sum(c).alias("n"), F.min(b).alias("min"), F.max(b).alias("max"), (F.sum(b * c) / F.sum(c)).alias("mean"), (F.sum(b * b * c) / F.sum(c)).alias("_square"), *quantiles)
    return found.withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("_square") - F.col("mean") * F.col("mean")))).drop("_square")
