"""Operator 3: benchmark items inside documents, by size-partitioned MinHash containment.

Items are partitioned by the size of their shingle set, a partition for each power of
two. An item's signature is a bottom-k MinHash: its k shingles of least hash, where k
follows from the partition's largest size n as k = n - ceil(c * n) + 1 for containment
c. A document that holds a share c of the item can lack n - ceil(c * n) of its shingles
at most, so it holds one of the signature: the search loses nothing, however long the
document, and reads a fraction of the items' shingles. Candidates are verified by
counting the item's shingles, as text, in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, numbered, text_key, written

SHINGLE = 5
CONTAINMENT_PERCENT = 80


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _window(size: int) -> Column:
    """Hashes of all runs of `size` words of column w; size 5 is the rule, less only for shorter items."""
    at = lambda x, i: F.xxhash64(F.lit(size), x, *[F.get("w", i + k) for k in range(1, size)])
    return F.when(F.size("w") >= size, F.slice(F.transform(F.col("w"), at), 1, F.greatest(F.lit(1), F.size("w") - (size - 1))))


def _texts(size: Column) -> Column:
    """All runs of `size` words of column w as texts."""
    at = lambda i: F.array_join(F.slice("w", i, size), " ")
    return F.when(F.size("w") >= size, F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), at))


def signatures(items: DataFrame, percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """(item_id, size, n_item, h): each item's k least hashes; size is its shingle's number of words."""
    sized = items.withColumn("size", F.least(F.lit(SHINGLE), F.size("w")))
    every = F.coalesce(*[F.when(F.col("size") == s, F.array_distinct(_window(s))) for s in range(1, SHINGLE + 1)])
    hashed = sized.withColumn("hashes", F.sort_array(every)).withColumn("n_item", F.size("hashes"))
    largest = F.pow(2, F.ceil(F.log2("n_item")))  # of the partition
    k = largest - F.ceil(largest * percent / 100) + 1
    return hashed.select("item_id", "size", "n_item", F.explode(F.slice("hashes", 1, F.least("n_item", k.cast("int")))).alias("h"))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """(doc_id, tk, item_id, n_item, n_found): documents that hold percent or more of an item's shingles.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored.
    Words are lower-cased runs of letters and digits, shingles are of five words; an item
    of one to four words is one shingle of them all. n_item is the item's number of
    distinct shingles, n_found how many of them the document holds.

    Null or empty texts, and texts without words, hold nothing and are found nowhere.
    Items with equal text are found alike. tk tells rows apart that repeat a doc_id;
    wholly equal rows are reported once. A null doc_id or item_id is reported as null.
    With either table empty the result is empty.
    """
    items = benchmark.select("item_id", F.col("text").alias("item_text")).distinct()
    items = items.select("item_id", F.xxhash64("item_text").alias("ik"), plain_words(F.col("item_text")).alias("w")).filter(F.size("w") > 0)
    items = written(items.withColumn("item_id", F.struct("item_id", "ik")).drop("ik"), "items")
    sought = written(signatures(items, percent), "signatures")
    sizes = sorted(r[0] for r in sought.select("size").distinct().limit(SHINGLE).collect())
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"), "text")
    cut = keyed.select("doc_id", "tk", plain_words(F.col("text")).alias("w"))

    rows = [cut.select("doc_id", "tk", F.explode(_window(s)).alias("h")) for s in sizes]
    hashes = rows[0] if rows else cut.select("doc_id", "tk", F.lit(0).cast("long").alias("h")).filter("false")
    for more in rows[1:]:
        hashes = hashes.union(more)
    hits = hashes.join(bounded(sought.select("h", "item_id", "size", "n_item")), "h")
    candidates = written(hits.groupBy("doc_id", "tk", "item_id", "size", "n_item").agg(F.count("*").alias("hits")).drop("hits"), "candidates")

    of_doc = written(candidates.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "size").distinct(), "candidates")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk"))
    again = keyed.join(bounded(of_doc), same).select("doc_id", "tk", "size", plain_words(F.col("text")).alias("w"))
    in_doc = again.select("doc_id", "tk", "size", F.explode(F.array_distinct(_texts(F.col("size")))).alias("shingle"))
    in_item = items.withColumn("size", F.least(F.lit(SHINGLE), F.size("w")))
    in_item = in_item.select("item_id", "size", F.explode(F.array_distinct(_texts(F.col("size")))).alias("shingle"))
    in_item = written(in_item, "shingles")
    both = in_doc.join(bounded(in_item), ["size", "shingle"]).select("doc_id", "tk", "item_id", "shingle").distinct()
    found = both.groupBy("doc_id", "tk", "item_id").agg(F.count("*").alias("n_found"))
    total = in_item.groupBy("item_id").agg(F.count("*").alias("n_item"))
    full = found.join(total, "item_id").filter(100 * F.col("n_found") >= percent * F.col("n_item"))
    return full.select("doc_id", "tk", F.col("item_id.item_id").alias("item_id"), "n_item", "n_found").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    found = contaminated(docs, benchmark, percent).select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).distinct()
    rows, names, doc_id, text = numbered(docs)
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (text_key(F.col(text)) == F.col("_tk"))
    return rows.join(bounded(written(found, "found")), same, "left_anti").toDF(*names)
