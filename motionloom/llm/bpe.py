"""Operator 1: byte-level BPE encoding and decoding through a distinct-word table.

1. Split. Documents are read in blocks of bounded size. A block's texts are split into
   the tokenizer's own words; each block keeps its distinct words, numbered by first
   use, and every document becomes the sequence of its words' numbers.
2. Encode. The blocks' distinct words meet, sorted, by word; each distinct word is
   encoded once, and its ids go to all blocks that use it.
3. Join back. A block's documents meet the ids of the block's words; ids are put
   together by position.
4. Decode. Ids join the id-to-piece table (of the vocabulary's fixed size) and the
   pieces' bytes are put together.

What is shuffled is one to three bytes a word, and for each block its distinct words:
texts are never shuffled, and a word as frequent as you like has one row for each block.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes of text in a block; a longer text makes a block of its own.
BLOCK_BYTES = 32 << 20
#: Bits of a place: partition of the scan, block within it, word within the block.
_PART, _NUMBER, _CODE = 21, 14, 28
#: Below this code point, letters and numbers are the same in all Unicode versions in use.
_STABLE = 0x250


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer, without truncation and padding."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def pieces(path: str) -> list[bytes]:
    """The id-to-piece table: the bytes that each id stands for."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE shows these bytes as themselves
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    table = {i: bytes(byte_of[c] for c in piece) for piece, i in spec["model"]["vocab"].items() if all(c in byte_of for c in piece)}
    table |= {i: piece.encode() for piece, i in spec["model"]["vocab"].items() if i not in table}
    table |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table) + 1)]


@lru_cache(maxsize=4)
def splitter(path: str) -> Callable[[str], list[str]]:
    """Cuts a text into the words that the tokenizer merges separately; added tokens are words."""
    own = tokenizer(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["normalizer"] or spec["pre_tokenizer"] != spec["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
        raise ValueError(f"{path}: only byte-level tokenizers with the usual pattern are known")
    added = [x["content"] for x in spec["added_tokens"]]
    cut = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
    low = [chr(c) for c in range(_STABLE)]
    letters = "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == "L")
    numbers = "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == "N")
    spaces = "\\t-\\r\\x20\\x85\\xa0"
    words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall
    beyond = re.compile(f"[^\\x00-\\u{_STABLE - 1:04x}]").search
    pre = own.pre_tokenizer

    def plain(text: str) -> list[str]:
        if beyond(text) is None:
            return words(text)
        return [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]

    def split(text: str) -> list[str]:
        if cut is None or not any(x in text for x in added):
            return plain(text)
        return [w for k, part in enumerate(cut.split(text)) for w in ([part] if k % 2 else plain(part))]

    return split


def packed(codes: np.ndarray) -> bytes:
    """Numbers as bytes of seven bits each, the last of a number below 128."""
    size = 1 + (codes >= 1 << 7).astype(np.int64) + (codes >= 1 << 14) + (codes >= 1 << 21) + (codes >= 1 << 28)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    begin = end - size
    for k in range(int(size.max()) if len(size) else 0):
        on = size > k
        out[begin[on] + k] = ((codes[on] >> (7 * k)) & 127) | np.where(size[on] > k + 1, 128, 0)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(raw < 128)
    begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    codes = np.zeros(len(end), np.int64)
    for k in range(int((end - begin).max()) + 1 if len(end) else 0):
        on = begin + k <= end
        codes[on] |= (raw[begin[on] + k].astype(np.int64) & 127) << (7 * k)
    return codes


def _blocks(docs: DataFrame, path: str, of_words: bool) -> DataFrame:
    """The blocks' distinct words (place, word), or their documents (block, words, doc_id, codes).

    A place is the block's number and the word's number in the block, in one long. Both
    come from the same scan; `words` counts the block's distinct words, so that blocks
    that were cut differently (rows that changed between the scans) are noticed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, part, number = splitter(path), TaskContext.get().partitionId(), 0
        code: defaultdict[str, int] = defaultdict(count().__next__)
        size, ids, coded = 0, [], []  # coded: each text's word numbers, by first use

        def block() -> Iterator[pa.RecordBatch]:
            if part >> _PART or number >> _NUMBER or len(code) >> _CODE:
                raise ValueError("more partitions, blocks or words than a place can name")
            name = part << _NUMBER | number
            # The commonest words get the smallest numbers, which take the fewest bytes.
            uses = np.bincount(np.concatenate(coded), minlength=len(code))
            order = np.argsort(-uses, kind="stable")
            if of_words:
                own = list(code)
                all_words = [own[k] for k in order.tolist()]
                for at in range(0, len(all_words), 20_000):
                    some = all_words[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array((name << _CODE) + np.arange(at, at + len(some))), pa.array(some, pa.string())], ["place", "word"])
            else:
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                for at in range(0, len(ids), 2000):
                    some = [packed(rank[c]) for c in coded[at : at + 2000]]
                    columns = [pa.array([name] * len(some), pa.int64()), pa.array([len(code)] * len(some), pa.int64()), pa.array(ids[at : at + 2000], pa.int64()), pa.array(some, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "words", "doc_id", "codes"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if size and size + len(text) > BLOCK_BYTES:
                    yield from block()
                    code, size, ids, coded, number = defaultdict(count().__next__), 0, [], [], number + 1
                found = split(text)
                size += len(text)
                ids.append(doc_id)
                coded.append(np.fromiter(map(code.__getitem__, found), np.int32, len(found)))
        if ids:
            yield from block()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "place long, word string" if of_words else "block long, words long, doc_id long, codes binary")


def _id_type(path: str) -> str:
    """The narrowest type of an id."""
    return "<u2" if len(pieces(path)) <= 1 << 16 else "<u4"


def _encode_words(words: DataFrame, path: str) -> DataFrame:
    """Adds the ids of each row's word; a distinct word is encoded once."""
    kind = _id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_batch
        last, last_ids = None, b""
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            known = distinct[:1] == [last] and last is not None
            ids = [last_ids] * known + [np.array(e.ids, kind).tobytes() for e in encode(distinct[known:], add_special_tokens=False)]
            if distinct:
                last, last_ids = distinct[-1], ids[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()).take(coded.indices)], ["place", "ids"])

    dealt = words.repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "place long, ids binary")


def decoded(ids: np.ndarray, piece: list[bytes]) -> str:
    """The text of a sequence of ids, joined by id to the pieces."""
    return b"".join(map(piece.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _join_back(docs: DataFrame, encoded: DataFrame, path: str, finish: Callable[[list, list[np.ndarray], Callable], pa.Table], schema: str) -> DataFrame:
    kind = np.dtype(_id_type(path))

    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch] | pa.Table:
        order = np.argsort(right.column("place").to_numpy(), kind="stable")
        raw = right.column("ids").combine_chunks().take(pa.array(order)) if right.num_rows else pa.array([], pa.binary())
        if isinstance(raw, pa.ChunkedArray):
            raw = raw.combine_chunks()
        each = raw.to_pylist()
        size = np.fromiter(map(len, each), np.int64, len(each)) // kind.itemsize
        flat, begin = np.frombuffer(b"".join(each), kind), np.cumsum(size) - size
        comma = [",".join(map(str, flat[b : b + n].tolist())) for b, n in zip(begin.tolist(), size.tolist(), strict=True)]
        if any(n != len(size) for n in left.column("words").unique().to_pylist()):
            raise ValueError("a block's documents and words differ; the input changed between two scans")
        sequences = []
        for data in left.column("codes").to_pylist():
            codes = unpacked(data)
            n = size[codes]
            ids = flat[np.repeat(begin[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] if len(codes) else flat[:0]
            sequences.append((ids, codes))
        return finish(left.column("doc_id").to_pylist(), sequences, comma)

    block = F.shiftright("place", _CODE).alias("block")
    return docs.groupBy("block").cogroup(encoded.groupBy(block)).applyInArrow(run, schema)


def _plain_scan(docs: DataFrame) -> bool:
    """Whether docs comes straight from files, so that two scans cut the same partitions."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    return not re.search(r"Join|Aggregate|Repartition|Sort|Window|Generate|Union|LocalRelation|LogicalRDD|Python|Arrow|Pandas|Distinct|Limit|Sample|rand\(", plan)


def _run(docs: DataFrame, path: str, finish: Callable, schema: str) -> DataFrame:
    docs = docs.select("doc_id", "text")
    if not _plain_scan(docs):
        docs = written(docs, "docs")
    return _join_back(_blocks(docs, path, of_words=False), _encode_words(_blocks(docs, path, of_words=True), path), path, finish, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs (doc_id, text).

    ids are those of the tokenizers library with add_special_tokens=False. A null or
    empty text has none. Repeated rows give repeated rows, a null doc_id stays null, an
    empty table gives an empty one, and other columns are ignored.
    """

    def finish(doc_ids: list, sequences: list, comma: list[str]) -> pa.Table:
        return pa.table([pa.array(doc_ids, pa.int64()), pa.array([ids.astype(np.int32) for ids, _ in sequences], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _run(docs, path, finish, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text, unknown ids nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces(path)
        for batch in batches:
            texts = [None if x is None else b"".join(piece[i] for i in x if i is not None and 0 <= i < len(piece)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode() and then decode() give, digested.

    Digests are taken where a block's ids are put together, so neither ids nor texts
    are written or moved again. Nulls, empty texts and repeated rows are as in encode().
    """

    def finish(doc_ids: list, sequences: list, comma: list[str]) -> pa.Table:
        piece, n, ids_sha, text_sha = pieces(path), [], [], []
        for ids, codes in sequences:
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(comma.__getitem__, codes.tolist())).encode()).hexdigest())
            text_sha.append(hashlib.sha256(decoded(ids, piece).encode()).hexdigest())
        return pa.table([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _run(docs, path, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
