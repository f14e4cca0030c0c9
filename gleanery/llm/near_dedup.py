"""Near-dedup: an exact join of shingles with prefix filters, then components.

Documents are sets of hashed word 5-grams; equal sets are one document from the
start.  All documents' shingles are counted in a table of slots, which gives one
order of all shingles, rare ones first.  The order only saves work: any other one
gives the same result.

Copies share at least c of the smaller set, which is at least 1/r of the larger.  So
the smaller one's first (1 - c) n + k shingles in the common order and the larger
one's first (1 - c/r) n + k have k in common, and a join of these postings that counts
hits misses nothing.  k grows with the set (``enough``): long texts that share a few
phrases are not checked.  Postings are packed by bucket of shingles, and a bucket is
joined in numpy.

A shingle of up to DENSE holders gives a hit to all pairs of them.  Where there are
more, each first meets the largest one allowed; when the components of what was found
are known, all pairs of holders that no component joins get the hits they lack
(``rest``).  Where these are many for the number of texts, the likeliest pairs of two
components are checked before the others, which by then mostly lie in one: first by the
hits of one shingle in FIRST, then by all.  So a thousand edited copies need no half
million checks, but no two documents that are copies end in different groups.
Hits leave a bucket in parts of PORTION pairs, so what a task holds is its postings and
a constant.

A set that lies to c in a larger one misses at most (1 - c) n of its shingles there,
so of its first (1 - c) n + NEEDED the larger one holds NEEDED, of whatever size it is.
The largest document of each group asks with these, all documents answer with all
shingles.

Every pair with enough hits is checked exactly: the texts of both are brought together
and the containment of the 5-gram sets is computed, nothing is estimated.  A bitmap of
the ids that are needed keeps most other texts from travelling (``among``).

Result.  Two documents are copies when at least ``copy_t`` of the smaller set
lies in the larger, which is at most ``copy_ratio`` times as large.  Copies are
joined into groups (connected components) and one stays: the largest set, then
the lowest id.  A group whose kept document lies to at least ``contain_t`` in a
larger document of another group goes in favour of that group's.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, drop_tables, materialise, shingle_sets, unused

WIDTH = 5
#: Shingles are counted in 2 ** SLOT_BITS slots, which travel in blocks.
SLOT_BITS, BLOCK_BITS = 20, 16
#: Up to this many holders of a shingle are paired at once, more of them with the largest first.
DENSE = 4
#: Hits that a container must have among the shingles that a set sends; copies need one more for every PER_HIT shingles.
NEEDED, PER_HIT = 7, 32
#: Pairs that a bucket makes at once, and different ones that it holds before it passes them on.
PORTION = 1 << 18
#: Pairs of holders a shingle of all texts, and pairs to check a text, up to which they are taken at once.
HELD_AT_ONCE, CHECKED_AT_ONCE = 4, 1
#: One shingle in so many gives hits first, of which each component has so many pairs checked.
FIRST, TRIED = 16, 8
#: Up to which of two components' pairs, by hits, they are checked before the components are made anew.
ROUNDS = (1, 16, 256, None)
#: Bits of the map of ids whose texts are needed; it travels in blocks.
SIEVE_BITS, SIEVE_BLOCK_BITS = 25, 18


def jaccard_threshold(containment: float, ratio: float) -> float:
    """Least Jaccard similarity at that containment, larger at most ratio times as large."""
    return containment / (ratio + 1 - containment)


def tune(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(rows, bands) of a MinHash banding with the most rows that still reach the recall."""
    for rows in (6, 5, 4, 3, 2, 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if rows * bands <= hashes:
            return rows, bands
    return 1, hashes


def least_common(n: int, share: float) -> int:
    """The least count of n that is at least that share of it."""
    return math.ceil(share * n - 1e-9)


def enough(least: int, n: int) -> int:
    """Hits that copies must have of which at least ``least`` shingles are common, the smaller of n."""
    return min(least, NEEDED + n // PER_HIT)


def slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """(id, size, name) of every text with words; (block, counts) of all shingles of a task."""
    types = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
    names = ["id", "size", "name", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for whole in batches:
            for part in byte_slices(whole, "text", 1 << 20):
                found = [(i, s) for i, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), WIDTH)) if len(s)]
                if not found:
                    continue
                counts += np.bincount(slots(np.concatenate([s for _, s in found])), minlength=len(counts))
                none = [None] * len(found)
                cols = ([i for i, _ in found], [len(s) for _, s in found], [xxhash.xxh3_128_digest(s.tobytes()) for _, s in found], none, none)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        if counts.any():
            for block, part in enumerate(np.minimum(counts, 0xFFFF).astype(np.uint16).reshape(-1, 1 << BLOCK_BITS)):
                cols = ([None], [None], [None], [block], [part.tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return docs.mapInArrow(run, "id bigint, size int, name binary, block int, counts binary")


def shingle_counts(rows: DataFrame) -> np.ndarray:
    """By slot, how often its shingles occur in all documents (more than 65,535 a task count as that)."""

    def total(t: pa.Table) -> pa.Table:
        out = np.zeros(1 << BLOCK_BITS, np.int64)
        for x in t.column("counts").to_pylist():
            out += np.frombuffer(x, np.uint16)
        return pa.table({"block": t.column("block")[:1], "counts": pa.array([np.minimum(out, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    got = rows.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(total, "block int, counts binary").collect()
    out = np.zeros((1 << (SLOT_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint32)
    for r in got:
        out[r.block] = np.frombuffer(bytes(r.counts), np.uint32)
    return out.reshape(-1)


def posted(docs: DataFrame, counts, buckets: int, widths: Callable[[int, bool], tuple[int, int]]) -> DataFrame:
    """Postings of (id, text, asks), packed: a row a bucket of shingles and slice of documents.

    ``widths`` gives how many of a set's shingles are posted, rarest first, and how
    many of these are marked by their lowest bit.  ``length`` counts the shingles
    of a run, which are of one document.
    """
    schema = "bucket int, low binary, id binary, size binary, length binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for whole in batches:
            for part in byte_slices(whole, "text", 4 << 20):
                ids, sizes, sets, marks = [], [], [], []
                for i, asks, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), shingle_sets(part.column(1).to_pylist(), WIDTH)):
                    n = len(s)
                    if n:
                        most, marked = widths(n, asks)
                        if most < n or marked:
                            s = s[np.argsort(table[slots(s)], kind="stable")][:most]
                        ids.append(i)
                        sizes.append(n)
                        sets.append(s)
                        marks.append(np.arange(len(s)) < marked)
                if not ids:
                    continue
                h, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
                order = np.argsort(bucket, kind="stable")
                bucket, doc = bucket[order], doc[order]
                low = (h[order] & np.uint64(0xFFFFFFFE)).astype(np.uint32) | np.concatenate(marks)[order].astype(np.uint32)
                first = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1]))))
                length = np.diff(np.append(first, len(doc))).astype(np.uint32)
                run_id, run_size = np.array(ids, np.int64)[doc[first]], np.array(sizes, np.uint32)[doc[first]]
                cut = np.flatnonzero(np.concatenate(([True], bucket[first][1:] != bucket[first][:-1])))
                ends = np.append(cut[1:], len(first))
                at = np.append(first, len(doc))
                cols = (
                    bucket[first[cut]].astype(np.int32),
                    [low[at[a] : at[b]].tobytes() for a, b in zip(cut, ends)],
                    *([x[a:b].tobytes() for a, b in zip(cut, ends)] for x in (run_id, run_size, length)),
                )
                types = (pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return docs.mapInArrow(run, schema)


def unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, id, size, marked) of the postings of a bucket whose shingle another one has, too; by shingle, size and id."""
    whole = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    low, length = whole("low", np.uint32), whole("length", np.uint32)
    key = low >> np.uint32(1)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(order) > 1 else order[:0]
    at = np.repeat(np.arange(len(length)), length)[order]
    ids, size = whole("id", np.int64)[at], whole("size", np.uint32)[at]
    again = np.lexsort((ids, size, key[order]))
    order = order[again]
    return key[order].astype(np.uint64), ids[again], size[again], (low[order] & np.uint32(1)) == 1


def spans(x: np.ndarray, first: np.ndarray, last: np.ndarray, most: int = PORTION) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) for every y from ``first`` until before ``last``, in portions of about ``most``."""
    n = np.maximum(last - first, 0)
    x, first, n = x[n > 0], first[n > 0], n[n > 0]
    ends, start = np.cumsum(n), 0
    while start < len(n):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        k = n[start:stop]
        place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        yield np.repeat(x[start:stop], k), np.repeat(first[start:stop], k) + place
        start = stop


def until(key: np.ndarray, size: np.ndarray, ratio: float) -> np.ndarray:
    """By row, where those of its shingle end that are at most ``ratio`` times as large."""
    largest = np.floor(size * ratio + 1e-9).astype(np.uint64)
    return np.searchsorted((key << np.uint64(32)) | size.astype(np.uint64), (key << np.uint64(32)) | largest, "right")


def holders(key: np.ndarray) -> np.ndarray:
    """By row, how many rows have its shingle."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    return np.repeat(n, n)


def counted(ids: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, how often) of the pairs of rows as pairs of different ids; in parts, and a pair may be in several."""
    different, number = np.unique(ids, return_inverse=True)
    held, waiting = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        out, back = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return out, np.bincount(back, np.concatenate([k for _, k in held]), len(out)).astype(np.int64)

    def named(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (*(different[k] for k in divmod(code, len(different))), n)

    for x, y in found:
        x, y = number[x], number[y]
        held.append(np.unique(x[x != y] * len(different) + y[x != y], return_counts=True))
        waiting += len(held[-1][0])
        if waiting > 2 * PORTION:
            held = [merged()]
            waiting = len(held[0][0])
            if waiting > PORTION:
                yield named(*held[0])
                held, waiting = [], 0
    if waiting:
        yield named(*merged())


def of_ids(some: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sizes of some of the ids."""
    different, at = np.unique(ids, return_index=True)
    return size[at][np.searchsorted(different, some)].astype(np.int64) if len(some) else np.empty(0, np.int64)


def candidates(postings: DataFrame, ratio: float) -> DataFrame:
    """(a, b, size of b, hits) by bucket, the posted shingles that both have, a the smaller one, its shingle marked.

    Shingles of up to DENSE holders give a hit to all their pairs.  Of more holders each
    meets the largest one that the ratio allows only, and all of them are returned as
    (id, key, size, marked) for ``rest``.
    """

    schema = "a bigint, b bigint, key bigint, size bigint, marked boolean, hits bigint"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        bucket = t.column("bucket")[0].as_py()
        key, ids, size, marked = unpacked(t)
        del t
        many = holders(key) > DENSE
        first, last = np.arange(len(key)) + 1, until(key, size, ratio)
        first = np.where(many, np.maximum(first, last - 1), first)
        for a, b, hits in counted(ids, spans(np.flatnonzero(marked), first[marked], last[marked])):
            none = pa.nulls(len(a))
            cols = a, b, none.cast(pa.int64()), of_ids(b, ids, size), none.cast(pa.bool_()), hits
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
        for at in np.array_split(np.flatnonzero(many), many.sum() // PORTION + 1):
            none = pa.nulls(len(at), pa.int64())
            left = (key[at] << np.uint64(20)).astype(np.int64) | bucket
            cols = ids[at], none, left, size[at].astype(np.int64), marked[at], none
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return postings.groupBy("bucket").applyInArrow(run, schema)


def rest(left: DataFrame, roots: DataFrame, ratio: float, buckets: int) -> DataFrame:
    """(a, b, size of b, hits) by bucket, of holders of ``left`` that no component joins yet: all hits that ``candidates`` has not given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        got = {c: t.column(c).to_numpy() for c in ("key", "id", "size", "marked", "root")}
        order = np.lexsort((got["id"], got["size"], got["key"]))
        got = {c: x[order] for c, x in got.items()}
        key, root = (np.unique(got[c], return_inverse=True)[1] for c in ("key", "root"))
        last = until(key.astype(np.uint64), got["size"], ratio) - 1
        # Who is in its shingle's largest component meets the others only: most holders are there, and their pairs are not even made.
        _, same, n = np.unique((key << 32) | root, return_inverse=True, return_counts=True)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        most = np.maximum.reduceat(n[same], start)[key]
        main = np.minimum.reduceat(np.where(n[same] == most, root, len(root)), start)[key]
        others, inner = np.flatnonzero(root != main), root == main
        x, z = np.flatnonzero(got["marked"] & ~inner), np.flatnonzero(got["marked"] & inner)
        apart = ((x[root[x] != root[y]], y[root[x] != root[y]]) for x, y in spans(x, x + 1, last[x]))
        across = ((x, others[y]) for x, y in spans(z, np.searchsorted(others, z + 1), np.searchsorted(others, last[z])))
        for a, b, hits in counted(got["id"], chain(apart, across)):
            cols = a, b, of_ids(b, got["id"], got["size"]), hits
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "size", "hits"])

    named = left.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    named = named.join(mixed, "key").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return named.groupBy("bucket").applyInArrow(run, "a bigint, b bigint, size bigint, hits bigint")


def containers(postings: DataFrame, ratio: float, contain_t: float) -> DataFrame:
    """(a, b): who asked by marked shingles and a set over ``ratio`` times as large with enough of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size, marked = unpacked(pa.Table.from_batches(list(batches)))
        end = np.searchsorted(key, key, "right")
        for a, b, hits in counted(ids, spans(np.flatnonzero(marked), until(key, size, ratio)[marked], end[marked])):
            cols = a, b, of_ids(a, ids, size), hits
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "size", "hits"])

    hits = postings.groupBy("bucket").applyInArrow(run, "a bigint, b bigint, size bigint, hits bigint")
    need = F.least(F.lit(NEEDED), F.ceil(contain_t * F.col("size") - 1e-9))
    return hits.groupBy("a", "b", "size").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= need).select("a", "b")


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of these ids, and a few more by chance; no document is sent for that."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << SIEVE_BITS))

    def bits(t: pa.Table) -> pa.Table:
        out = np.zeros(1 << SIEVE_BLOCK_BITS, np.uint8)
        out[t.column("place").to_numpy() & ((1 << SIEVE_BLOCK_BITS) - 1)] = 1
        return pa.table({"block": t.column("block")[:1], "bits": pa.array([np.packbits(out).tobytes()], pa.binary())})

    placed = ids.select(place.alias("place")).select("place", F.shiftright("place", SIEVE_BLOCK_BITS).cast("int").alias("block"))
    whole = np.zeros((1 << (SIEVE_BITS - SIEVE_BLOCK_BITS), 1 << (SIEVE_BLOCK_BITS - 3)), np.uint8)
    for r in placed.groupBy("block").applyInArrow(bits, "block int, bits binary").collect():
        whole[r.block] = np.frombuffer(bytes(r.bits), np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(whole.reshape(-1))

    @F.pandas_udf("boolean")
    def needed(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1) == 1)

    return docs.where(needed(place))


def overlaps(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact (a, b, size_a, size_b, common) for every candidate pair.

    Texts go to the pairs in two equi-joins; pairs of one b are then neighbours,
    so its set is built once.
    """
    needed = pairs.select(F.col("a").alias("id"), F.col("b").alias("to")).union(
        pairs.select(F.col("b").alias("id"), F.col("b").alias("to")).distinct()
    )
    sent = among(docs, needed.select("id")).join(needed, "id").select("to", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_set = None, None
        for whole in batches:
            for part in byte_slices(whole, "text", 512 << 10):
                rows: list[tuple[int, int, int, int, int]] = []
                for to, i, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(part.column(2).to_pylist(), WIDTH)):
                    if i == to:
                        head, head_set = to, s
                        continue
                    assert head == to
                    small, large = (s, head_set) if len(s) <= len(head_set) else (head_set, s)
                    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                    rows.append((i, to, len(s), len(head_set), common))
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "size_a", "size_b", "common"])

    grouped = sent.repartition("to").sortWithinPartitions("to", F.col("id") != F.col("to"), "id")
    return grouped.mapInArrow(run, "a bigint, b bigint, size_a bigint, size_b bigint, common bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by alternating large and small stars.

    ``edges`` has (u, v) in any direction; the root is a component's least node.
    Each round is written to the shared folder, so no lineage grows and a lost
    executor costs one round at most; rounds grow with the log of the diameter.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if not large:
            both = both.where("v < u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                least.select("u", F.col("m").alias("v"))
            )
        return out.where("u != v").distinct()

    e = materialise(edges.where("u != v").distinct(), "edges")
    before = None
    while True:
        e = materialise(star(star(e, True), False), "stars", e)
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._written_to = e._written_to
    return out


def unique_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether the ids are whole numbers, none null and none repeated."""
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return False
    ids = docs.select(docs[id_col].alias("id"))
    return not ids.groupBy("id").count().where("id is null or count > 1").limit(1).count()


def classes(
    src: DataFrame,
    *,
    copy_t: float = 0.6,
    copy_ratio: float = 1.6,
    contain_t: float = 0.8,
    min_shingles: int = 16,
) -> DataFrame:
    """(id, kept, links, containment) of every row of (id, text) that is linked with another.

    Ids are different whole numbers.
    """
    spark = src.sparkSession
    sets = materialise(described(src), "sets")
    counts = spark.sparkContext.broadcast(shingle_counts(sets))
    sets_of = sets.where("id is not null").select("id", "size", "name")
    # Equal sets become one before anything is joined; partial minima travel.
    names = sets_of.groupBy("name").agg(F.min("id").alias("id"), F.min("size").alias("size"), F.count("*").alias("n"))
    names = materialise(names, "names")
    several = names.where("n > 1").select("name", F.col("id").alias("rep"))
    same = materialise(sets_of.select("id", "name").join(several, "name").where("id != rep").select("id", "rep"), "copies", sets)

    shingles = names.agg(F.sum("size")).first()[0] or 0
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles >> 21), 1 << 20)
    smaller, larger = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    is_copy = (F.col("c") >= copy_t) & (F.col("ratio") <= copy_ratio)
    is_inside = (F.col("c") >= contain_t) & (F.col("ratio") > copy_ratio)

    def verified(pairs: DataFrame) -> DataFrame:
        found = overlaps(src, pairs).withColumns({"c": F.col("common") / smaller, "ratio": larger / smaller})
        spark.sparkContext._jvm.System.gc()  # shuffle files of steps before go with their objects
        return materialise(found.where(is_copy | is_inside), "verified")

    def copy_widths(n: int, asks: bool) -> tuple[int, int]:
        least, marked = least_common(n, copy_t / copy_ratio), least_common(n, copy_t)
        marked = n - marked + enough(marked, n)
        return max(marked, n - least + enough(least, int(n / copy_ratio))), marked

    def container_widths(n: int, asks: bool) -> tuple[int, int]:
        least = least_common(n, contain_t)
        return n, n - least + min(NEEDED, least) if asks else 0

    texts = src.join(same.select("id"), "id", "left_anti").select("id", "text", F.lit(True).alias("asks"))
    met = materialise(candidates(posted(texts, counts, buckets, copy_widths), copy_ratio), "met")
    # Of b's size, what the larger one's prefix warrants: ``enough`` there.
    hit = F.sum("hits").alias("hits")
    need = F.least(F.ceil(copy_t / copy_ratio * F.col("size") - 1e-9), NEEDED + F.floor(F.floor(F.col("size") / copy_ratio) / PER_HIT))
    pairs = met.where("key is null").groupBy("a", "b", "size").agg(hit).withColumn("tried", F.col("hits") >= need)
    pairs = materialise(pairs, "pairs")
    found = verified(pairs.where("tried").select("a", "b"))
    comp = components(found.where(is_copy).select(F.col("a").alias("u"), F.col("b").alias("v")))

    def joined(comp: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The links among the pairs, and the components with them."""
        more = verified(pairs)
        if not more.limit(1).count():
            return more, comp
        edges = more.where(is_copy).select(F.col("a").alias("u"), F.col("b").alias("v"))
        grown = components(comp.select(F.col("node").alias("u"), F.col("root").alias("v")).union(edges))
        drop_tables(spark, comp)
        return more, grown

    def between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs of different components, with these as x and y."""
        for c, r in (("a", "x"), ("b", "y")):
            pairs = pairs.join(comp.select(F.col("node").alias(c), F.col("root").alias(r)), c, "left").withColumn(r, F.coalesce(r, c))
        return pairs.where("x != y")

    # Many holders of a shingle got hits in part: whatever no component joins gets the others now.
    left = met.where("key is not null").select(F.col("a").alias("id"), "key", "size", "marked")
    ends = lambda comp: comp.select(F.col("node").alias("id"), "root")
    more = []
    holding = left.groupBy("key").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0
    if holding > HELD_AT_ONCE * shingles:
        some = left.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(FIRST)) == 0)
        near = between(rest(some, ends(comp), copy_ratio, buckets).groupBy("a", "b").agg(hit), comp)
        near = near.select("a", "b", "hits", F.explode(F.array("x", "y")).alias("root"))
        order = Window.partitionBy("root").orderBy(F.desc("hits"), "a", "b")
        near = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= TRIED).select("a", "b").distinct()
        near = materialise(near, "near")
        got, comp = joined(comp, near)
        more.append(got)
        drop_tables(spark, near)
    apart = rest(left, ends(comp), copy_ratio, buckets)
    apart = apart.withColumn("tried", F.lit(False)).union(pairs.select("a", "b", "size", "hits", "tried"))
    apart = apart.groupBy("a", "b", "size").agg(hit, F.max("tried").alias("tried")).where(~F.col("tried") & (F.col("hits") >= need))
    order = Window.partitionBy(F.least("x", "y"), F.greatest("x", "y")).orderBy(F.desc(F.col("hits") / F.col("size")), "a", "b")
    apart = between(apart.select("a", "b", "size", "hits"), comp).select("a", "b", F.row_number().over(order).alias("k"))
    apart = materialise(apart, "apart", met, pairs)
    several = apart.count() > CHECKED_AT_ONCE * names.count()
    for most in ROUNDS if several else ROUNDS[-1:]:
        now = apart if most is None else apart.where(F.col("k") <= most)
        got, comp = joined(comp, now.select("a", "b"))
        more.append(got)
        if most is None:
            break
        before = apart
        apart = materialise(between(apart.where(F.col("k") > most), comp).select("a", "b", "k"), "apart", before)
        if not apart.limit(1).count():
            break
    drop_tables(spark, apart)
    more = materialise(reduce(DataFrame.union, more).distinct(), "more", *more)
    sized = names.select("id", "size").join(comp.select(F.col("node").alias("id"), "root"), "id", "left")
    sized = sized.withColumn("root", F.coalesce("root", "id"))
    best = sized.groupBy("root").agg(F.max(F.struct("size", (-F.col("id")).alias("neg"))).alias("best"))
    member = materialise(sized.join(best, "root").select("id", "size", (-F.col("best.neg")).alias("head")), "members", comp)
    # Containers of any size are sought for what is the largest of its group.
    silent = member.where((F.col("id") != F.col("head")) | (F.col("size") < min_shingles))
    silent = materialise(silent.select("id", F.lit(False).alias("asks")), "silent")
    texts = src.join(same.select("id"), "id", "left_anti").join(silent, "id", "left").select("id", "text", F.coalesce("asks", F.lit(True)).alias("asks"))
    within = materialise(containers(posted(texts, counts, buckets, container_widths), copy_ratio, contain_t), "within", silent)
    inside = verified(within)
    found = materialise(found.union(more).union(inside), "links", found, more, inside, within)
    # A group's head that lies in a larger document of another group points there;
    # heads grow strictly along these pointers, so they form a forest.
    small = F.when(F.col("size_a") <= F.col("size_b"), F.col("a")).otherwise(F.col("b"))
    large = F.when(F.col("size_a") <= F.col("size_b"), F.col("b")).otherwise(F.col("a"))
    up = (
        found.where(is_inside)
        .select(small.alias("id"), large.alias("in"), larger.alias("in_size"))
        .join(member.where("id = head").select("id"), "id")
        .join(member.select(F.col("id").alias("in"), F.col("head").alias("parent")), "in")
        .where("parent != id")
        .groupBy("id")
        .agg(F.max(F.struct("in_size", (-F.col("parent")).alias("neg"))).alias("p"))
        .select("id", (-F.col("p.neg")).alias("parent"))
    )
    up = materialise(up, "parents")
    while True:  # pointer doubling: the forest's depth halves every round
        nxt = up.alias("x").join(up.select(F.col("id").alias("parent"), F.col("parent").alias("over")), "parent", "left")
        up = materialise(nxt.select("id", F.coalesce("over", "parent").alias("parent"), F.col("over").isNotNull().alias("m")), "parents", up)
        if not up.where("m").limit(1).count():
            break
        up = _without(up, "m")
    kept = member.join(up.select(F.col("id").alias("head"), "parent"), "head", "left").select("id", F.coalesce("parent", "head").alias("kept"))
    ends = found.select(F.col("a").alias("id"), "c").union(found.select(F.col("b").alias("id"), "c"))
    most = ends.groupBy("id").agg(F.max("c").alias("most"))
    # Every text of a class of several rows, then every row of it.
    kept = materialise(kept.join(names.select("id", "n"), "id"), "kept", member, up)
    many = kept.groupBy("kept").agg(F.sum("n").alias("rows")).where("rows > 1")
    texts = kept.join(many, "kept").join(most, "id", "left").select(
        F.col("id").alias("rep"), "kept", (F.col("rows") - 1).alias("links"), F.when(F.col("n") > 1, F.lit(1.0)).otherwise(F.col("most")).alias("containment")
    )
    every = texts.select("rep").select(F.col("rep").alias("id"), "rep").union(same).join(texts, "rep")
    return materialise(every.select("id", "kept", "links", "containment"), "classes", names, same, kept, found)


def _without(df: DataFrame, column: str) -> DataFrame:
    out = df.drop(column)
    out._written_to = df._written_to
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, kept_id, links, containment): one row for every document that is linked with another.

    ``kept_id`` names the class by the document that stays, which has a row of its
    own.  ``links`` counts the other documents of the class; ``containment`` is the
    largest share among the pairs that were checked, 1 where sets are equal.

    Copies are sought for sets of any size, containers for those of ``min_shingles``
    and more: shorter ones lie in larger texts as mere phrases.  Null, empty and
    wordless texts are never matched.  Where ids are null, repeated or no whole
    numbers, rows are numbered first: each row then is a document, a repeated row
    a copy of the first.  Texts of any length are read whole; other columns are not
    read.  An empty table gives an empty result.
    """
    if unique_ids(docs, id_col):
        found = classes(docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text")), **options)
        kind = docs.schema[id_col].dataType
        return found.select(
            F.col("id").cast(kind).alias(id_col), F.col("kept").cast(kind).alias("kept_" + id_col), "links", "containment"
        )
    rows = numbered(docs.select(docs[id_col].alias("given"), docs[text_col].alias("text")), "row")
    found = classes(rows.select(F.col("row").alias("id"), "text"), **options)
    ids, kept = rows.select(F.col("row").alias("id"), "given"), rows.select(F.col("row").alias("kept"), F.col("given").alias("kept_given"))
    return found.join(ids, "id").join(kept, "kept").select(F.col("given").alias(id_col), F.col("kept_given").alias("kept_" + id_col), "links", "containment")


def numbered(docs: DataFrame, column: str) -> DataFrame:
    """The rows with a number of their own, written once so that it never changes."""
    return materialise(docs.withColumn(column, F.monotonically_increasing_id()), "numbered")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each near-duplicate group, columns as given.

    Rows are judged one by one: of repeated rows one stays, whatever their ids, and
    null ids are like any others.  Null, empty and wordless texts stay, and an empty
    table stays empty.
    """
    row, gone = unused(docs.columns, "row", "gone")
    plain = unique_ids(docs, id_col)
    rows = docs if plain else numbered(docs, row)
    key = rows[id_col if plain else row]
    found = classes(rows.select(key.cast("bigint").alias("id"), rows[text_col].alias("text")), **options)
    lost = found.where("id != kept").select(F.col("id").alias(gone))
    return rows.join(lost, key == F.col(gone), "left_anti").select(*docs.columns)
