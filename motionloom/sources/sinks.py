"""Writers: episode tables, comparison and summary files, all by Spark's committers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file beside a dataset that says from what it was made.
PROVENANCE = "_provenance.json"


def _files(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def read_provenance(spark: SparkSession, path: str) -> dict | None:
    """What write_episodes noted of a dataset, None if there is none."""
    there, files = _files(spark, f"{path}/{PROVENANCE}")
    if not files.exists(there):
        return None
    stream = files.open(there)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_episodes(rows: DataFrame, path: str, episode: str = "episode_index", order: str = "frame_index", signature: str | None = None, provenance: dict | None = None) -> bool:
    """Parquet partitioned by episode, rows in order; False if a dataset of the same signature is there already.

    Written to a folder beside and then renamed, so an interrupted write leaves the old
    dataset as it was; between two renames the old one stands beside its place.
    """
    spark = rows.sparkSession
    there, files = _files(spark, path)
    if signature is not None and files.exists(there) and (read_provenance(spark, path) or {}).get("signature") == signature:
        return False
    mark = uuid.uuid4().hex
    (staged, _), (old, _) = _files(spark, f"{path}.staged-{mark}"), _files(spark, f"{path}.old-{mark}")
    rows.repartition(episode).sortWithinPartitions(episode, order).write.partitionBy(episode).parquet(staged.toString())
    note, _ = _files(spark, f"{staged.toString()}/{PROVENANCE}")
    out = files.create(note, True)
    out.write(json.dumps({**(provenance or {}), "signature": signature}, sort_keys=True).encode())
    out.close()
    if files.exists(there):
        files.rename(there, old)
    if not files.rename(staged, there):
        raise OSError(f"{staged.toString()} could not be renamed")
    files.delete(old, True)
    return True


def episode_metadata(rows: DataFrame, episode: str = "episode_index", index: str = "index", task: str | None = None) -> DataFrame:
    """Per episode its length, the rows from dataset_from_index up to dataset_to_index (left out), and tasks."""
    columns = [F.count(F.lit(1)).alias("length"), F.min(index).alias("dataset_from_index"), (F.max(index) + 1).alias("dataset_to_index")]
    if task is not None:
        columns.append(F.sort_array(F.collect_set(task)).alias("tasks"))
    return rows.groupBy(episode).agg(*columns).orderBy(episode)


def write_json(rows: DataFrame, path: str, order: list[str]) -> None:
    """Summaries as one file of JSON lines, in order."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)


def write_alignments(paths: DataFrame, path: str) -> None:
    """Alignment paths as rows (pair columns, step, i, j), sorted."""
    paths.sortWithinPartitions("step").write.mode("overwrite").parquet(path)


def write_summary(rows: DataFrame, path: str, order: list[str], sep: str = "\t") -> None:
    """A report with a header, tab- or comma-separated, episodes in numeric order."""
    by = [F.expr(f"try_cast({c} AS bigint)") if c.startswith("episode") else F.col(c) for c in order]
    rows.orderBy(*by).coalesce(1).write.mode("overwrite").option("sep", sep).option("header", "true").csv(path)


def checked_width(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """rows, failing at run time if a vector has another width."""
    return rows.withColumn(vector, F.when(F.size(vector) == width, F.col(vector)).otherwise(F.raise_error(F.lit(f"{vector}: not {width} wide"))))


# Names of types in a dataset's features.
FEATURE_TYPES = {"float": "float32", "double": "float64", "bigint": "int64", "int": "int32", "boolean": "bool", "string": "string"}


def with_features(rows: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """rows whose columns carry their feature (dtype, shape) as metadata, vectors checked to their width; Parquet keeps it."""
    widths = widths or {}
    out = rows
    for name in widths:
        out = checked_width(out, name, widths[name])
    kind = lambda c: FEATURE_TYPES.get(dict(rows.dtypes)[c].removeprefix("array<").removesuffix(">"), dict(rows.dtypes)[c])
    return out.select(*[F.col(f"`{c}`").alias(c, metadata={"dtype": kind(c), "shape": [widths.get(c, 1)]}) for c in out.columns])


def features(rows: DataFrame) -> dict[str, dict]:
    """The features that with_features noted."""
    return {f.name: f.metadata for f in rows.schema.fields if "dtype" in (f.metadata or {})}
