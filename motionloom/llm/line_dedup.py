"""Operator 9: repeated runs of lines, by a suffix array over line ids.

All documents form one sequence of line ids, broken between documents; a suffix begins at
each line. Prefix doubling sorts the suffixes: the rank of a suffix's first 2n lines comes
from the pair of the ranks of its first n lines and of the n lines after them. Only the
distinct pairs are sorted (by ranges, so no task sorts them all), and a pair's rank is the
number of suffixes before it. Suffixes whose prefix is unique have their place and leave;
the doubling ends when none is left, after as many rounds as the longest repeated run's
length has binary digits.

The suffixes that share their first n lines fill the ranks [rank, rank + n_suffixes): an
interval of the array whose longest common prefix is n lines at least. In each interval
the suffix first in order of documents is the original, all others copy it. A suffix's
longest interval in which it is a copy says how far it repeats an earlier place;
neighbouring suffixes that copy along one diagonal make up one maximal repeated run. Runs
are deleted, originals stay. Lines of many words can count as runs by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, numbered, text_key, words, written

#: Lines that a run must have.
MIN_LINES = 2

_AT = ["doc_id", "tk", "k"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _suffixes(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """One row for each line with so many words: k counts these lines, i all lines; name is the line's id."""
    counts = lambda x: x.rlike(SPACES.replace("[", "[^", 1)) if least_words == 1 else F.size(words(x)) >= least_words
    ids = F.transform(
        _lines(F.col("text")),
        lambda x, i: F.struct(i.alias("i"), F.when(counts(x), F.xxhash64(x)).alias("name")),
    )
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"), F.filter(ids, lambda s: s["name"].isNotNull()).alias("ids"))
    rows = keyed.select("doc_id", "tk", F.posexplode("ids").alias("k", "s"))
    return rows.select(*_AT, F.col("s.i").alias("i"), F.col("s.i").alias("j"), F.col("s.name").alias("name"))


def _ranked(keys: DataFrame, order: list[str]) -> DataFrame:
    """keys (distinct in `order`, n_suffixes) with rank: the suffixes of all smaller keys, counted.

    A range of keys is sorted in each task; what the ranges before it hold is added.
    """
    placed = written(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "keys")
    so_far = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = placed.groupBy("part").agg(F.sum("n_suffixes").alias("total"))  # one row for each range
    start = total.select("part", so_far("total", Window.orderBy("part")).alias("start"))
    rank = F.col("start") + so_far("n_suffixes", Window.partitionBy("part").orderBy(*order))
    return placed.join(F.broadcast(start), "part").withColumn("rank", rank).drop("part", "start")


def _interval(suffixes: DataFrame, order: list[str]) -> DataFrame:
    """The suffixes whose key (columns `order`) is not unique, with rank, n_suffixes and the first of the key's suffixes."""
    keys = suffixes.groupBy(*order).agg(F.count("*").alias("n_suffixes"), F.min(F.struct(*_AT)).alias("first"))
    return suffixes.join(_ranked(keys.filter("n_suffixes > 1"), order), order).select(*_AT, "i", "j", "rank", "n_suffixes", "first")


def levels(docs: DataFrame, lines: int = MIN_LINES) -> Iterator[tuple[int, DataFrame]]:
    """(n, intervals) for growing n: the suffixes that share their first n lines with another one.

    intervals has doc_id, tk, k, i and j (the first and the n-th line), rank, n_suffixes
    and first. n doubles from 1, passes through `lines`, and goes on until no two suffixes
    share so many lines.
    """
    now = written(_interval(_suffixes(docs), ["name"]).distinct(), "suffixes")  # rows alike in id and text are one
    size = 1
    while not now.isEmpty():
        yield size, now
        by = min(size, lines - size) if size < lines else size
        later = Window.partitionBy("doc_id", "tk").orderBy("k").rangeBetween(by, by)
        longer = now.select(*_AT, "i", F.first("j").over(later).alias("j"), F.col("rank").alias("name"), F.first("rank").over(later).alias("next"))
        now = written(_interval(longer.filter("next is not null"), ["name", "next"]), "suffixes")
        size += by


def intervals(docs: DataFrame, lines: int = MIN_LINES) -> DataFrame | None:
    """The suffixes that share their first `lines` lines with another one; None if there are none."""
    return next((found for size, found in levels(docs, lines) if size == lines), None)


def repeated_runs(docs: DataFrame, lines: int = MIN_LINES) -> DataFrame:
    """Maximal runs that copy an earlier place: doc_id, tk, first and last line, lines with a word, source.

    A run is maximal if it can't be made longer on its diagonal and lies in no other run.
    """
    copies = None
    for size, found in levels(docs, lines):
        if size >= lines:
            copy = found.filter(~F.struct(*_AT).eqNullSafe(F.col("first"))).withColumn("size", F.lit(size).cast("long"))
            copies = copy if copies is None else copies.unionByName(copy)
    if copies is None:
        empty = "doc_id long, tk long, first_line int, last_line int, n_lines long, source_doc_id long"
        return docs.sparkSession.createDataFrame([], empty)
    longest = copies.groupBy(*_AT).agg(F.max(F.struct("size", "i", "j", "first")).alias("c"))
    diagonal = longest.select(
        *_AT, "c.i", "c.j", (F.col("k") + F.col("c.size") - 1).alias("end"), F.col("c.first.doc_id").alias("source_doc_id"), F.col("c.first.tk").alias("source_tk"),
        (F.col("c.first.k") - F.col("k")).alias("shift"),
    )
    way = ["doc_id", "tk", "source_doc_id", "source_tk", "shift"]
    before = lambda w: F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    along = Window.partitionBy(*way).orderBy("k")
    diagonal = diagonal.withColumn("reach", before(along))
    fresh = F.when(F.col("k") > F.col("reach") + 1, 1).otherwise(0)
    runs = diagonal.withColumn("island", F.sum(fresh).over(along)).groupBy(*way, "island")
    found = runs.agg(F.min("k").alias("k"), F.max("end").alias("end"), F.min("i").alias("first_line"), F.max("j").alias("last_line"))
    outer = before(Window.partitionBy("doc_id", "tk").orderBy("k", F.desc("end"), "source_doc_id", "source_tk"))
    found = found.withColumn("outer", outer).filter("outer is null or end > outer")
    return found.select("doc_id", "tk", "first_line", "last_line", (F.col("end") - F.col("k") + 1).alias("n_lines"), "source_doc_id")


def repeated_lines(docs: DataFrame, least_words: int) -> DataFrame:
    """Lines of so many words that copy an earlier one: doc_id, tk, first and last line (the same one)."""
    found = _interval(_suffixes(docs, least_words), ["name"]).filter(~F.struct(*_AT).eqNullSafe(F.col("first")))
    return found.select("doc_id", "tk", F.col("i").alias("first_line"), F.col("i").alias("last_line")).distinct()


def without_repeats(docs: DataFrame, lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """docs with all its columns, its text without repeated runs, n_lines and n_deleted.

    A run is `lines` or more successive lines with a word, equal in every character to
    lines at an earlier place (by doc_id, then by line); lines without a word neither
    break a run nor count, and go only inside a deleted one. With long_words, a single
    line of so many words is a run too. Columns named n_lines or n_deleted are replaced.

    A null text stays null and an empty one empty (no lines and one line). A very long
    text is taken whole; its line ids are sorted in one task. Rows that
    repeat a doc_id are told apart by their text; rows alike in both are one document
    and get the same result. A row without doc_id comes before all others. An empty
    table gives an empty result.
    """
    runs = repeated_runs(docs, lines).select("doc_id", "tk", "first_line", "last_line")
    if long_words is not None:
        runs = runs.union(repeated_lines(docs, long_words))
    gone = runs.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("first_line", "last_line")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), F.col("gone").alias("_gone"))
    rows, names, doc_id, text = numbered(docs, ("n_lines", "n_deleted"))
    whole = rows.withColumn("_key", text_key(F.col(text)))
    on = F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_tk"))
    joined = whole.join(gone, on, "left").withColumn("_lines", _lines(F.col(text)))
    indices = F.flatten(F.transform("_gone", lambda r: F.sequence(r["first_line"], r["last_line"])))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), indices)
    joined = joined.withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept))
    cut = F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n")
    whole_text = F.col("_kept").isNull()
    columns = [F.when(whole_text, F.col(text)).otherwise(cut) if f"c{i}" == text else F.col(f"c{i}") for i in range(len(names))]
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines")).cast("long")
    n_deleted = F.when(whole_text, 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long")
    return joined.select(*columns, n_lines, n_deleted).toDF(*names, "n_lines", "n_deleted")
