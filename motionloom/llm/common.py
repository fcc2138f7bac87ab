"""What the operators share: the folder all executors see, written tables, row identity."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word rule `[^\x20\x09-\x0D]+`, as a Java character class.
SPACES = "[\\x20\\x09-\\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only on one machine (tests), where the session names none, a temporary folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext.getCheckpointDir()
        folder = known.rsplit("/", 1)[0] if known else None
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="motionloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Tables written by this driver, which forget() removes.
_paths: list[str] = []


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/motionloom/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back.

    A written table survives the loss of executors, and costs one pass where a
    reliable checkpoint() would compute the plan twice. Results read these tables until
    they are written themselves; then forget() removes them.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def mark() -> int:
    """How many tables have been written so far; for forget()."""
    return len(_paths)


def forget(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables written with written() since a mark(), once the results that read them are written."""
    while len(_paths) > since:
        remove(spark, _paths.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def text_key(text: Column) -> Column:
    """Tells rows apart that repeat a doc_id with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: Narrow rows (a few numbers each, so some tens of MB) up to which a written table is broadcast.
MAX_BROADCAST = 1_000_000


def bounded(small: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """A written narrow table with a broadcast hint if it is small; beyond, a join shuffles."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def numbered(docs: DataFrame, without: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], str, str]:
    """docs with columns c0, c1, ... so that none clashes with an operator's own; their names, doc_id's and text's number."""
    names = [c for c in docs.columns if c not in without]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    return rows, names, f"c{names.index('doc_id')}", f"c{names.index('text')}"
