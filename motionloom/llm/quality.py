"""Operator 5: quality rules by distribution divergence.

A document's histograms of character classes, of runs of symbols among its words and of
common words are compared with those of all documents of its language, by
Jensen-Shannon distance (base 2, so 0 to 1). Runs of symbols have a bin for each symbol,
as a symbol between all words is a small share of the characters. Short documents and small references are not judged. Everything about one
document is computed within its row; only the references are aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words, written

# The commonest words of four languages.
COMMON_WORDS = {
    "de": "als auch auf aus bei das dem den der des die ein eine für im in ist mit nicht sich sie und von werden zu",
    "en": "a and are as at be by for from has in is it not of on or that the this to was with you",
    "es": "a al con de del el en es la las lo los más no para por que se su un una y",
    "fr": "au avec ce dans de des du elle en est et il la le les ne pas par pour que qui sur un une",
}
SYMBOLS = "#*$%&|<>"
CLASSES = ["upper", "lower", "digit", "symbol", "space", "other"]

MIN_WORDS = 50  # for characters
MIN_COMMON = 100  # for common words, whose shares vary more
MIN_REFERENCE = 2000
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.37
#: Languages up to this many are broadcast.
MAX_BROADCAST = 10_000

_ALL = sorted({w for line in COMMON_WORDS.values() for w in line.split()})


def _left(text: Column, pattern: str) -> Column:
    """Characters that remain without the pattern's matches."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _starting(array: str, first: str) -> Column:
    """How many of an array's strings start with `first`."""
    return F.size(F.filter(array, lambda x: x.startswith(first))).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """docs with _words, the base figures, character classes and the common words' counts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    runs = F.array_remove(F.split(F.regexp_replace(text, "[^" + SYMBOLS + "]+", " "), " "), "")
    first = docs.withColumns({"_text": text, "_words": words(F.col("text")), "_plain": F.array_remove(F.split(F.lower(text), "\\P{L}+"), "")})
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(SPACES.replace("[", "[^", 1)))
    grams = F.transform(
        F.col("_words"),
        lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2), F.get("_words", i + 3), F.get("_words", i + 4)),
    )
    second = first.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "_runs": runs,
        "_lines": lines,
        "_grams": F.when(F.size("_words") > 5, F.slice(grams, 1, F.size("_words") - 4)),
        "_upper": _left(F.col("_text"), "\\P{Lu}+"),
        "_digit": _left(F.col("_text"), "\\P{Nd}+"),
        "_other": _left(F.col("_text"), "[\\p{L}\\p{Nd}\\x20\\x09-\\x0D" + SYMBOLS + "]+"),
        "_chars": F.length("_text").cast("long"),
        "_common": F.filter("_plain", lambda x: x.isin(_ALL)),
        "_n_plain": F.size("_plain").cast("long"),
    })
    third = second.withColumns({
        "n_symbols": F.length(F.array_join("_runs", "")).cast("long"),
        "_marks": F.array(*[_starting("_runs", s) for s in SYMBOLS], F.col("_n_plain")),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_again": F.size(F.array_distinct("_grams")) < F.size("_grams"),
        "_present": F.array_distinct("_common"),
        "_space": F.col("_chars") - F.col("word_chars"),
    })
    # Windows that occur twice or more: neighbours after sorting by gram; then words covered, window by window.
    placed = F.when(F.col("_again"), F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    fourth = third.withColumn("_placed", placed)
    gram = lambda i: F.get("_placed", i)["g"]
    like = lambda s, i: F.coalesce(s["g"] == gram(i), F.lit(False))
    repeats = F.filter("_placed", lambda s, i: like(s, i + 1) | like(s, i - 1))
    fifth = fourth.withColumn("_starts", F.sort_array(F.transform(repeats, lambda s: s["i"])))
    covered = F.transform("_starts", lambda s, i: F.least(F.lit(5), F.coalesce(F.get("_starts", i + 1) - s, F.lit(5))).cast("long"))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    counts = F.transform("_present", lambda w: F.struct(w.alias("word"), (F.size("_common") - F.size(F.array_remove("_common", w))).cast("long").alias("n")))
    return fifth.withColumns({
        "n_repeat_words": F.when(F.col("_again"), total).otherwise(F.lit(0)).cast("long"),
        "_counts": counts,
        "_classes": F.array("_upper", F.col("_chars") - F.col("_upper") - F.col("_digit") - F.col("n_symbols") - F.col("_space") - F.col("_other"), "_digit", "n_symbols", "_space", "_other"),
    })


def _part(p: Column, q: Column) -> Column:
    """What one bin adds to twice the divergence; 0 * log 0 is 0."""
    side = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return side(p) + side(q)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def quality(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For every row of docs (doc_id, text, lang): the columns of `keep` (doc_id if none),
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance, kept.

    base_failed: fewer than 10 words, or over a fifth of the words in 5-word windows found
    twice or more. A document that passes goes if it has MIN_WORDS words, its language's
    reference MIN_REFERENCE, and the distance of its characters (the larger one of character
    classes and of runs of symbols among words) is over MAX_CHAR_DISTANCE or that of its words, if MIN_COMMON, over MAX_WORD_DISTANCE; references come from all documents that
    pass and have MIN_WORDS words.

    A null or empty text has no words, so base_failed is true and both distances are
    null. A null lang is a language of its own. Rows that repeat a doc_id are judged
    apart; an empty table gives an empty result; columns of docs that are not asked for
    are ignored.
    """
    keep = keep or ["doc_id"]
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], "text", F.coalesce(F.col("lang"), F.lit("")).alias("_lang"))
    found = features(rows)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    names = [f"k{i}" for i in range(len(keep))]
    found = written(found.select(*names, "_lang", *base, "base_failed", "_counts", "_classes", "_marks", "_n_plain"), "quality")

    good = found.filter(~F.col("base_failed") & (F.col("n_words") >= MIN_WORDS))
    bins = {"classes": len(CLASSES), "marks": len(SYMBOLS) + 1}
    sums = [F.sum(F.col(f"_{b}")[i]).alias(f"{b}{i}") for b, n in bins.items() for i in range(n)]
    chars = good.groupBy("_lang").agg(*sums, F.sum("_n_plain").alias("n"), F.sum("n_words").alias("words"))
    chars = chars.select("_lang", "n", "words", *[F.array(*[f"{b}{i}" for i in range(n)]).alias(f"ref_{b}") for b, n in bins.items()])
    common = good.select("_lang", F.explode("_counts").alias("c")).groupBy("_lang", F.col("c.word").alias("word")).agg(F.sum("c.n").alias("n"))
    common = common.groupBy("_lang").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("ref_words"))
    reference = written(chars.join(common, "_lang", "left"), "reference").withColumnRenamed("n", "ref_n").withColumnRenamed("words", "ref_size")
    few = reference.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    joined = found.join(F.broadcast(reference) if few else reference, "_lang", "left")

    share = lambda array, i: F.get(array, i) / F.greatest(F.lit(1.0), _sum(F.transform(array, lambda x: x.cast("double"))))
    apart = lambda b: sum((_part(share(F.col(f"_{b}"), F.lit(i)), share(F.col(f"ref_{b}"), F.lit(i))) for i in range(bins[b])), F.lit(0.0)) / 2
    char = F.greatest(apart("classes"), apart("marks"))
    p = lambda c: c["n"] / F.col("_n_plain")
    q = lambda c: F.coalesce(F.try_element_at("ref_words", c["word"]), F.lit(0)) / F.col("ref_n")
    rest_p = 1 - _sum(F.transform("_counts", p))
    rest_q = 1 - _sum(F.transform(F.map_values("ref_words"), lambda n: n / F.col("ref_n")))
    absent = 1 - rest_q - _sum(F.transform("_counts", q))
    word = (_sum(F.transform("_counts", lambda c: _part(p(c), q(c)))) + _part(rest_p, rest_q) + absent) / 2
    judged = (F.col("n_words") >= MIN_WORDS) & (F.col("ref_size") >= MIN_REFERENCE)
    distance = lambda d: F.when(judged, F.sqrt(F.greatest(F.lit(0.0), d)))
    joined = joined.withColumns({"char_distance": distance(char), "word_distance": F.when(F.col("_n_plain") >= MIN_COMMON, distance(word))})
    far = F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    joined = joined.withColumn("kept", ~F.col("base_failed") & ~far)
    return joined.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *base, "base_failed", "char_distance", "word_distance", "kept")
