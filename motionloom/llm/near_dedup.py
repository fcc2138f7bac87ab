"""Operator 6: near-duplicate documents by SetSketch registers.

Every document's shingle set becomes M registers. A register holds the least of the
set's exponential variates, stored as the exponent of base B and truncated to 16 bits
(Ertl, "SetSketch", VLDB 2021), so registers of parts merge by maximum and two sets
share a register with a probability close to their Jaccard similarity. BANDS bands of
ROWS registers give the candidates, the similarity is estimated jointly by maximum
likelihood from the counts of larger, smaller and equal registers, and what passes is
confirmed on the full sets.

A band's members all meet its least one. If they are then in several components, the
others meet too: in one task if they are few; else by prefixes. Sets of similarity t that
are sorted alike share an element among their first (1 - t) * n + 1. Sorted by rarity,
these are a text's own shingles and not those of a template that very many texts share, so
unlike texts part at once. A pair need only meet at the first element that it shares, and
what it shares then lies behind that in both: a member stays in a group only if from its
place on it could still reach the similarity with another's size and place. What even then
is in a large group is compared a block against a block in a task, likeliest first, until a
link to each other component is found. Full sets come to a task only for members that the
registers find a likely partner for.

At a similarity of exactly 0.8 no band agrees with probability (1 - 0.8**7)**48 = 1e-5,
and the estimate, whose standard error is 0.022 there, falls short by MARGIN with
probability 2e-5; a link can be missed in no other way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST, bounded, written
from .components import components
from .wordhash import mixed, shingle_sets

BANDS, ROWS = 48, 7
M = BANDS * ROWS
B, A, Q = 1.001, 20.0, 65534
#: A pair goes on to the full sets if its estimate is at least the threshold less this (over four standard errors).
MARGIN = 0.09
#: Members of a bucket that one task compares (of each of two sides), and those that meet by a join.
BLOCK, FEW = 512, 32
#: Bins of the histogram that tells rare shingles from common ones.
BINS = 1 << 20

KEYS = ["n_shingles", "set_name"]
_MULTIPLIERS = mixed(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The M registers of one set of 64-bit hashes; zeros for an empty set."""
    if not len(shingles):
        return np.zeros(M, np.uint16)
    least = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        np.minimum(least, (part[None, :] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    variate = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / A
    return np.clip(np.floor(1 - np.log(variate) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimates(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity for rows of registers, the set sizes being known."""
    more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    shift = (B - 1) / B

    def likelihood(j: np.ndarray) -> np.ndarray:
        p = -np.log1p(-np.maximum(u - v * j, 1e-12) * shift) / np.log(B)
        q = -np.log1p(-np.maximum(v - u * j, 1e-12) * shift) / np.log(B)
        return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(len(top)), top.copy()
    for _ in range(40):  # the likelihood has one maximum
        third = (high - low) / 3
        rises = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(rises, low + third, low), np.where(rises, high, high - third)
    return (low + high) / 2


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, size of the shingle set, a digest of 128 bits that names the set, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, regs = [], [], []
            for s in shingle_sets(batch.column(1), shingle):
                n.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                regs.append(registers(s).tobytes())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *KEYS, "regs"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, set_name binary, regs binary")


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, M)


def _likely(pairs: DataFrame, sketch: DataFrame, least: float) -> DataFrame:
    """Of candidate pairs (a, b) those whose estimate is at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
                keep = estimates(_regs(batch.column(4)), _regs(batch.column(5)), na, nb) >= least
                yield batch.select([0, 1]).filter(pa.array(keep))

    # Each side takes its registers apart, so these are shuffled for candidates only.
    few = bounded(pairs)
    side = lambda x: sketch.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}")).join(few, x)
    joined = side("a").join(side("b"), ["a", "b"])
    return joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, s): the sorted shingle hashes of the documents in ids (doc_id), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(batch.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "s"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(source.join(bounded(written(ids, "ids")), "doc_id", "left_semi").mapInArrow(run, "doc_id long, s binary"), "sets")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of doc_ids those with 100 * |intersection| >= percent * |union| of their full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    found = _sets(ids, docs, shingle)
    joined = pairs.join(found.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    joined = joined.join(found.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long").distinct()


def _components(links: DataFrame) -> DataFrame:
    """(node, label) of the links' components, written."""
    return written(components(links.toDF("u", "v")), "labels")


def _widened(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links (a, b): only the components that these touch are put together, as one node each."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("u"), F.coalesce("lb", "b").alias("v"))
    ends = written(ends.filter("u <> v").distinct(), "edges")
    if ends.isEmpty():
        return labels
    moved = written(components(ends), "moved").select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(bounded(moved), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    alone = moved.join(labels.select(F.col("node").alias("label")), "label", "left_anti")  # nodes that had no component
    return written(old.union(alone.select(F.col("label").alias("node"), F.col("to").alias("label"))), "labels")


def _outsiders(loose: DataFrame, labels: DataFrame) -> DataFrame:
    """Of loose (h, center, members, node) those in another component than their center, with label and main (the center's), in buckets that are not done; written.

    A bucket is done if its members, but for the center, which has met them all, are in one component.
    """
    out = loose.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    out = out.join(labels.select(F.col("node").alias("center"), F.col("label").alias("main")), "center", "left").withColumn("main", F.coalesce("main", "center"))
    out = written(out.filter("label <> main"), "outsiders")
    one = out.groupBy("h").agg(F.count("*").alias("outside"), F.first("members").alias("members"), F.min("label").alias("least"), F.max("label").alias("most"))
    done = one.filter("outside = members - 1 and least = most").select("h")
    return written(out.join(done, "h", "left_anti"), "outsiders")


def _likely_within(group: pa.Table, least: float, banded: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in a group of an outsider (outside = 1) and a member of another component whose estimate is at least `least`, likeliest first.

    An outsider meets all members, and of the bands that a pair shares only the first takes it
    (banded), or else those with outside = 0, if they are able to be similar.
    """
    label, n, far, outside = (group.column(x).to_numpy() for x in ("label", "n", "far", "outside"))
    regs = _regs(group.column("regs"))
    band = int(group.column("h")[0].as_py()) & 63
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in np.flatnonzero(outside == 1):
        same = regs == regs[i]
        near = (label != label[i]) & (n <= far[i]) & (n[i] <= far) & (same.sum(axis=1) >= (least - 0.1) * M)
        j = np.flatnonzero(near if banded else near & (outside == 0))
        if banded:
            j = j[same[j].reshape(len(j), BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
        found.append((np.full(len(j), i), j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    parts = [(i[k : k + 4096], j[k : k + 4096]) for k in range(0, len(i), 4096)]
    value = np.concatenate([np.zeros(0), *[estimates(regs[x], regs[y], n[x].astype(float), n[y].astype(float)) for x, y in parts]])
    order = np.argsort(-value, kind="stable")
    order = order[value[order] >= least]
    return i[order], j[order]


def _links_within(rows: DataFrame, keys: list[str], banded: bool, nodes: DataFrame, classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float, percent: int) -> DataFrame:
    """Links (a, b) between components within the groups of rows (keys, node, label, far, outside), each in a task; nodes are those of rows, written.

    Registers are dealt out first, and tell which rows have a likely partner. Only these come
    again with their full sets (sets_of: node, s), which are much larger: an outsider then meets
    the likeliest first, until it is linked to each other component of the group.
    """
    columns = [*keys, "node", "label", "far", "outside"]
    whole = classes.select(F.col("rep").alias("node"), F.col("n_shingles").alias("n"), "regs")

    def seen(group: pa.Table) -> pa.Table:
        return group.select(columns).take(pa.array(np.unique(np.concatenate(_likely_within(group, least, banded)))))

    def run(group: pa.Table) -> pa.Table:
        node, label = (group.column(x).to_numpy() for x in ("node", "label"))
        each = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("s")]
        out: list[tuple[int, int]] = []
        done: set[tuple[int, int]] = set()
        for x, y in zip(*(at.tolist() for at in _likely_within(group, least, banded)), strict=True):
            if (x, int(label[y])) not in done and _similar(each[x], each[y], percent):
                done.add((x, int(label[y])))
                out.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    rows = rows.select(*columns)
    dealt = rows.join(whole.join(bounded(nodes), "node", "left_semi"), "node")
    near = written(dealt.groupBy(*keys).applyInArrow(seen, rows.schema), "near")
    if near.isEmpty():
        return near.select(F.col("node").alias("a"), F.col("node").alias("b"))
    nodes = written(near.select("node").distinct(), "nodes")
    # Registers and sets meet once for each node, not for each of its rows.
    both = whole.join(bounded(nodes), "node", "left_semi").join(sets_of(nodes), "node")
    dealt = near.join(both, "node")
    return dealt.groupBy(*keys).applyInArrow(run, "a long, b long").distinct()


def _unlike(held: DataFrame) -> DataFrame:
    """h of the buckets of held (h, a, rep), but of those with the same members only the first band's.

    Pairs are taken by the first band that they share, so the others have nothing to add.
    """
    mark = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    named = held.groupBy("h", "a").agg(F.count("*").alias("size"), *mark)
    return named.groupBy("a", "size", "mark0", "mark1").agg(F.min_by("h", F.col("h").bitwiseAND(F.lit(63))).alias("h")).select("h")


def _prefixes(sets: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """(h, node, label, outside, place, n, far): the rarest shingles h of each node's set of n, as many as sets of that similarity must share one of; written.

    A set whose first shared shingle is h, at this place, can reach the similarity with sets
    of up to far shingles. marked has node, label and outside. A histogram of BINS bins over
    all the nodes' shingles tells how rare each is; any one order loses nothing, so bins that
    hold several shingles do no harm.
    """
    columns = ["h", "node", "label", "outside", "place", "n", "far"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for x in batch.column(1):
                total += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(44)).astype(np.int64), minlength=BINS)
        bins = np.flatnonzero(total)
        for k in range(0, len(bins), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(bins[k : k + 50_000]), pa.array(total[bins[k : k + 50_000]])], ["bin", "n"])

    found = sets.mapInArrow(counted, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # BINS rows at most
    often = np.zeros(BINS, np.int32)
    often[found.column("bin").to_numpy()] = found.column("n").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for x, *own in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                size = len(s) + (-percent * len(s)) // 100 + 1
                first = s[np.lexsort((s, often[(s >> np.uint64(44)).astype(np.int64)]))[:size]]
                place = np.arange(size)
                far = (100 + percent) * (len(s) - place) // percent - len(s)
                found.append(np.stack([first.view(np.int64), *(np.full(size, v) for v in own), place, np.full(size, len(s)), far]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(found, axis=1)], columns)

    told = sets.join(bounded(marked), sets.doc_id == marked.node).select("s", "node", "label", F.col("outside").cast("long"))
    return written(told.mapInArrow(run, ", ".join(f"{x} long" for x in columns)), "prefixes")


def _able(groups: DataFrame) -> DataFrame:
    """Of groups (rows of prefixes) those whose group has several components and holds, for an outsider, a row or, for others, an outsider that they can reach the similarity with: neither set is larger than the other's far.

    A group is known by the least n and the most far of its size classes (2 % wide), which
    leaves a few rows too many and none too few.
    """
    out = lambda x: F.when(F.col("outside") == 1, F.col(x))
    ends = [F.min("label").alias("least"), F.max("label").alias("most")]
    kinds = groups.groupBy("h", F.floor(F.log2("n") * 32)).agg(F.min("n").alias("n"), F.max("far").alias("far"), F.min(out("n")).alias("n1"), F.max(out("far")).alias("far1"), *ends)
    listed = lambda n, far: F.collect_list(F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("n"), F.col(far).alias("far"))))
    known = kinds.groupBy("h").agg(listed("n", "far").alias("all"), listed("n1", "far1").alias("outsiders"), F.min("least").alias("least"), F.max("most").alias("most"))
    known = bounded(written(known.filter("least <> most").select("h", "all", "outsiders"), "kinds"), MAX_BROADCAST // 8)
    fits = lambda e: (e.n <= F.col("far")) & (F.col("n") <= e.far)
    able = F.when(F.col("outside") == 1, F.exists("all", fits)).otherwise(F.exists("outsiders", fits))
    return written(groups.join(known, "h").select(*groups.columns, able.alias("able")), "able").filter("able").drop("able")


def _pairs_of_few(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components within groups of FEW members at most, if sizes and places allow the similarity."""
    side = lambda x: groups.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "n", "far")])
    both = side("a").join(side("b"), "h").filter("node_a < node_b and label_a <> label_b")
    return both.filter("n_a <= far_b and n_b <= far_a").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _links_of_blocks(sized: DataFrame, classes: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (a, b) between components within groups of so many blocks (lefts, rights), outsiders (outside = 1) against all, a block against a block in a task."""
    place = lambda many: F.pmod(F.xxhash64("node"), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    inside = sized.select("h", "node", "label", "far", every("lefts").alias("left"), place("rights").alias("right"), F.lit(0).alias("outside"))
    outside = sized.filter("outside = 1").select("h", "node", "label", "far", place("lefts").alias("left"), every("rights").alias("right"), F.lit(1).alias("outside"))
    nodes = written(sized.select("node").distinct(), "nodes")
    sets_of = lambda few: sets.withColumnRenamed("doc_id", "node").join(bounded(few), "node", "left_semi")
    return _links_within(inside.union(outside), ["h", "left", "right"], False, nodes, classes, sets_of, least, percent)


def _completed(held: DataFrame, links: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, label) after links between members of a bucket, other than its center, that are still in different components.

    held has h, a (the center), members and rep, links a and b. Members that are linked to
    their center are in its component; only the others are looked at.
    """
    least = percent / 100 - MARGIN
    labels = _components(links)
    loose = held.filter("members > 2").join(links.withColumnRenamed("b", "rep"), ["a", "rep"], "left_anti")
    loose = written(loose.select("h", F.col("a").alias("center"), "members", F.col("rep").alias("node")), "loose")
    out = _outsiders(loose, labels)
    if out.isEmpty():
        return labels

    # Small buckets: all members in one task.
    few = written(out.filter(F.col("members") <= BLOCK).select("h", "main").distinct(), "buckets")
    few = written(few.join(_unlike(held.join(bounded(few), "h", "left_semi")), "h"), "buckets")
    rows = held.select("h", F.col("rep").alias("node")).join(bounded(few), "h").join(out.select("h", "node", "label"), ["h", "node"], "left")
    any_size = F.lit(2**62).alias("far")  # nothing is known of places here
    rows = written(rows.select("h", "node", F.coalesce("label", "main").alias("label"), any_size, F.col("label").isNotNull().cast("int").alias("outside")), "members")
    nodes = written(rows.select("node").distinct(), "nodes")
    sets_of = lambda few: _sets(few.withColumnRenamed("node", "doc_id"), docs, shingle).withColumnRenamed("doc_id", "node")
    labels = _widened(labels, written(_links_within(rows, ["h"], True, nodes, classes, sets_of, least, percent), "met"))

    # Large ones: outsiders first meet two more members of their center's component, then what shares a rare shingle with them.
    sure = lambda pairs: written(confirmed(written(_likely(written(pairs, "pairs"), classes, least), "pairs"), docs, shingle, percent), "links")
    out = out.filter(F.col("members") > BLOCK)
    if out.isEmpty():
        return labels
    # Two members of each main component, the same in all its buckets, so that few pairs meet.
    known = labels.groupBy("label").agg(F.array(F.max("node"), F.min_by("node", F.xxhash64("node"))).alias("others"))
    met = out.select("node", F.col("main").alias("label")).distinct().join(known, "label").select("node", F.explode(F.array_distinct("others")).alias("other"))
    pairs = met.filter("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    labels = _widened(labels, sure(pairs.distinct()))
    out = _outsiders(loose.filter(F.col("members") > BLOCK), labels)
    if out.isEmpty():
        return labels
    outside = written(out.select("node").distinct(), "nodes")
    buckets = bounded(written(out.select("h").distinct(), "buckets"))
    inside = held.join(buckets, "h", "left_semi").select(F.col("rep").alias("node")).distinct().join(bounded(outside), "node", "left_anti")
    nodes = written(outside.withColumn("outside", F.lit(1)).union(inside.withColumn("outside", F.lit(0))), "nodes")
    sets = _sets(nodes.select(F.col("node").alias("doc_id")), docs, shingle)
    marked = written(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "marked")
    prefixes = _prefixes(sets, marked, percent)
    sought = written(prefixes.filter("outside = 1").select("h").distinct(), "sought")
    groups = _able(written(prefixes.join(bounded(sought), "h", "left_semi"), "groups"))
    blocks = [F.ceil(n / BLOCK).cast("int").alias(x) for x, n in (("lefts", F.sum("outside")), ("rights", F.count("*")))]
    sizes = groups.groupBy("h").agg(F.count("*").alias("size"), *blocks, F.min("label").alias("least"), F.max("label").alias("most"))
    sizes = written(sizes.filter("least <> most").select("h", "size", "lefts", "rights"), "sizes")
    sized = written(groups.join(bounded(sizes), "h"), "sized")  # all below reads these rows: they meet their group's size once
    pairs = _pairs_of_few(sized.filter(F.col("size") <= FEW))
    links = _links_of_blocks(sized.filter(F.col("size") > FEW), classes, sets, least, percent)
    return _widened(labels, sure(pairs).union(links))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Documents whose shingle sets (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) have
    100 * |intersection| >= percent * |union| are linked; component_id is the least
    doc_id reachable and kept is doc_id = component_id.

    Copies collapse to one class by the digest of their set before any comparison.

    A very long text is taken whole; a task holds its shingles. A null or empty text, or one without words, has no shingles and is linked with
    nothing. A row without doc_id is linked with nothing either: its component_id is
    null and it is kept. Rows that repeat a doc_id are one vertex, linked through any
    of their texts. An empty table gives an empty result; other columns are ignored.
    """
    least = percent / 100 - MARGIN
    sketch = written(sketches(docs, shingle), "sketches")
    real = sketch.filter("doc_id is not null and n_shingles > 0")
    classes = written(real.groupBy(*KEYS).agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs")), "classes")

    part = lambda i: F.substring("regs", i * 2 * ROWS + 1, 2 * ROWS)
    named = [F.shiftleft(F.xxhash64(part(i)), 6) + F.lit(i) for i in range(BANDS)]  # the last six bits are the band
    buckets = classes.select("rep", F.explode(F.array(*named)).alias("h"))
    stars = buckets.groupBy("h").agg(F.min("rep").alias("a"), F.count("*").alias("members")).filter("members > 1")
    stars = written(stars, "stars")
    held = written(buckets.join(bounded(stars), "h").filter("rep <> a"), "held")
    pairs = written(held.select("a", F.col("rep").alias("b")).distinct(), "pairs")
    links = written(confirmed(written(_likely(pairs, classes, least), "pairs"), docs, shingle, percent), "links")

    if not real.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
        members = real.select("doc_id", *KEYS).join(classes.select(*KEYS, "rep"), KEYS)
        several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("doc_id", "a")
        repeated = members.join(several, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
        links = written(links.union(repeated), "links")
    labels = _completed(held, links, classes, docs, shingle, percent)

    owned = classes.select(*KEYS, "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    owned = owned.select(*KEYS, F.coalesce("label", "rep").alias("label"))
    result = sketch.select("doc_id", *KEYS).join(owned, KEYS, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    result = result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
