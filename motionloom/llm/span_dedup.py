"""Operator 4: repeated passages, by sliding sentence spans.

A span is a run of SENTENCES or more consecutive sentences with MIN_WORDS words, or one
sentence of LONG words. Sentences that a span covers which is not the first of its words
(by doc_id, then place) are removed.

Of all these runs only the shortest that start, and the shortest that end, at each
sentence need hashes. If a run repeats an earlier one, so does every run inside it, and
each of its sentences lies in a shortest one inside it: one that starts or ends at the
sentence, or else (few words on either side) one that starts at the run's beginning. So
what is removed is what all runs of all lengths would remove, from two hashes a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, text_key, written
from .wordhash import mixed, word_hashes

SENTENCES, MIN_WORDS, LONG = 2, 20, 40

#: A sentence ends after its marks and what closes it (brackets, quotation marks) if white space
#: follows, after a full-width mark, or at a line's end; white space up to the next one belongs
#: to it. Signs beyond ASCII are written as their UTF-8 sequences.
_CLOSE = rb"(?:[\"')\]]|\xc2\xbb|\xe2\x80[\x99\x9c\x9d])*"
_END = re.compile(
    rb"(?:(?:[.!?]|\xe2\x80\xa6)+" + _CLOSE + rb"(?=[\x09-\x0d\x20])"
    rb"|(?:\xe3\x80\x82|\xef\xbc[\x81\x9f])+" + _CLOSE + rb"|(?=\n)|$)[\x09-\x0d\x20]*"
)
_STEP = np.uint64(0x9FB21C651E98DF25)


def sentences(text: bytes) -> np.ndarray:
    """Byte offsets that cut a text into sentences, with the space after each; first 0, last its length."""
    cuts = [0, *(m.end() for m in _END.finditer(text) if m.end())]
    if cuts[-1] != len(text):
        cuts.append(len(text))
    return np.unique(np.array(cuts, np.int64))


def spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first sentence, last sentence) of the text's spans."""
    cuts = sentences(text)
    n = len(cuts) - 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none.astype(np.uint64), none, none
    h, first = word_hashes(np.frombuffer(text, np.uint8), cuts)
    count = np.diff(first)
    # prefix sums: words up to a sentence, and a polynomial of all words up to it
    words = np.concatenate([[0], np.cumsum(count)])
    low, high = [], []
    at = np.arange(n)
    end = np.maximum(np.searchsorted(words, words[at] + MIN_WORDS, "left") - 1, at + SENTENCES - 1)
    ok = (end < n) & (count > 0)
    low.append(at[ok])
    high.append(end[ok])
    begin = np.minimum(np.searchsorted(words, words[at + 1] - MIN_WORDS, "right") - 1, at - SENTENCES + 1)
    ok = (begin >= 0) & (words[at + 1] >= MIN_WORDS) & (count > 0)
    low.append(begin[ok])
    high.append(at[ok])
    ok = count >= LONG
    low.append(at[ok])
    high.append(at[ok])
    pair = np.unique(np.concatenate(low) * (n + 1) + np.concatenate(high))
    low, high = pair // (n + 1), pair % (n + 1)
    a, b = first[low], first[high + 1]
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), _STEP, np.uint64)]))
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), pow(int(_STEP), -1, 1 << 64), np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)])
    name = mixed((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
    return name, low, high


def _spans(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, names, lows, highs = [], [], [], [], []
            doc_id, key = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            ids_of = doc_id.to_pylist()
            for k, text in enumerate(batch.column(2)):
                name, low, high = spans(text.as_buffer().to_pybytes() if text.is_valid else b"")
                if len(name):
                    ids += [ids_of[k]] * len(name)
                    keys.append(np.full(len(name), key[k], np.int64))
                    names.append(name.astype(np.int64))
                    lows.append(low.astype(np.int32))
                    highs.append(high.astype(np.int32))
            if ids:
                columns = [pa.array(ids, pa.int64()), *(pa.array(np.concatenate(x)) for x in (keys, names, lows, highs))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tk", "h", "low", "high"])

    return docs.select("doc_id", "tk", "text").mapInArrow(run, "doc_id long, tk long, h long, low int, high int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, low, high): spans of docs (doc_id, tk, text) whose hash stands at an earlier place.

    Counts and first places are aggregated before the shuffle, and written, so that the
    spans meet them in a plain join: a hash that very many documents hold is one row on
    the one side, and adaptive execution splits it on the other.
    """
    all_spans = written(_spans(docs), "spans")
    place = F.struct("doc_id", "tk", "low", "high")
    first = all_spans.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    return all_spans.join(written(first, "first"), "h").filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "tk", "low", "high")


def without_passages(docs: DataFrame) -> DataFrame:
    """docs with all its columns, its text without repeated spans, n_sentences and n_removed.

    Words are compared with A-Z lower-cased and white space ignored; what stays of a
    text stays as it is, and a text without repeats is untouched. Columns named
    n_sentences or n_removed are replaced.

    A null text stays null (no sentences), an empty one empty. A very long text is taken
    whole; a task holds it and its hashes, two for each sentence. Rows that repeat a
    doc_id are told apart by their text; rows alike in both are one document and get the
    same result. A row without doc_id comes first. An empty table gives an empty result.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"), F.col("text").cast("string").alias("text"))
    found = repeated_spans(keyed).groupBy("doc_id", "tk").agg(F.collect_list(F.struct("low", "high")).alias("_spans"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "_spans")
    rows, names, doc_id, text_column = numbered(docs, ("n_sentences", "n_removed"))
    whole = rows.withColumn("_key", text_key(F.col(text_column)))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_tk"))
    joined = whole.join(found, same, "left").select(*rows.columns, "_spans")
    at, size, inner = names.index("text"), len(names), list(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for text, cut in zip(batch.column(at), batch.column(size).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else None
                cuts = sentences(raw) if raw is not None else [0]
                total.append(len(cuts) - 1)
                if cut:
                    drop = np.zeros(len(cuts), np.int64)
                    for x in cut:
                        drop[x["low"]] += 1
                        drop[x["high"] + 1] -= 1
                    keep = np.cumsum(drop)[:-1] == 0
                    raw = b"".join(raw[a:b] for a, b, k in zip(cuts[:-1], cuts[1:], keep, strict=True) if k)
                    gone.append(int((~keep).sum()))
                else:
                    gone.append(0)
                texts.append(None if raw is None else raw.decode())
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(size)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*inner, "n_sentences", "n_removed"])

    kinds = [rows.schema[c].dataType.simpleString() if c != text_column else "string" for c in rows.columns]
    fields = ", ".join(f"{c} {kind}" for c, kind in zip(rows.columns, kinds, strict=True))
    return joined.mapInArrow(run, f"{fields}, n_sentences long, n_removed long").toDF(*names, "n_sentences", "n_removed")
