"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``1110110101`` is laid over every run of ten tokens; only the
tokens at its ones are hashed, so a replaced word at a zero leaves the hash as
it was.  Three masks with different gaps are used.  Hashes of the test items and
of the documents are joined; a bitmap of the items' hashes with a fixed number
of bits, probed twice, is applied to the documents first.  It only saves rows:
however full it is, the join that follows decides.

Around every hit the document's tokens are kept as far as the longest item can
reach.  There the item is laid on the hit's diagonal and all maximal scoring runs
are sought: a match counts +1, a substitution -``penalty``.  Runs of ``min_run``
tokens and ``min_identity`` equal ones cover positions of the item;
runs of several diagonals (words inserted or dropped) add up.  A document is
contaminated by an item when ``coverage`` of its tokens, or ``enough`` of them,
are covered.  Items under ``min_run`` tokens prove nothing and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, hash_texts, materialise, mix64, odd_multipliers
from .toxicity import maximal_segments

MASKS = ("1110110101", "1101011011", "1011101101")
SPAN = 10


def seed_hashes(h: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the mask's ones at every position of the token hashes ``h``."""
    n = len(h) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mults = odd_multipliers(SPAN + 1, 101 + mask)
    out = np.full(n, mults[SPAN], np.uint64)
    for k, bit in enumerate(MASKS[mask]):
        if bit == "1":
            out += h[k : k + n] * mults[k]
    return mix64(out)


def probes(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(bits - 1)
    return x & m, (x >> np.uint64(32)) & m


def item_table(items: DataFrame, min_run: int) -> DataFrame:
    """(item_id, item, tokens, hashes, offsets) of items that are long enough; ``item`` names the text."""
    kind = items.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, h in zip(b.column(0).to_pylist(), hash_texts(b.column(1).to_pylist())):
                if i is None or len(h) < max(min_run, SPAN):
                    continue
                per = [seed_hashes(h, m) for m in range(len(MASKS))]
                off = np.concatenate([np.arange(len(p)) for p in per])
                rows.append((i, digest(h), h.view(np.int64), np.concatenate(per).view(np.int64), off.astype(np.int32)))
            c = list(zip(*rows)) if rows else [()] * 5
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(c, (b.schema.field(0).type, pa.int64(), longs, longs, pa.list_(pa.int32())))],
                ["item_id", "item", "tokens", "hashes", "offsets"],
            )

    return items.mapInArrow(run, f"item_id {kind}, item bigint, tokens array<bigint>, hashes array<bigint>, offsets array<int>")


def digest(h: np.ndarray) -> int:
    """A name of a token sequence, as a signed 64-bit number."""
    key = xxhash.xxh3_64_intdigest(h.tobytes())
    return key - (key >> 63 << 64)


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits set by all hashes; at most bits / 64 rows reach the driver."""
    m = bits - 1
    low = F.col("hash").bitwiseAND(m)
    high = F.shiftrightunsigned("hash", 32).bitwiseAND(m)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(63).cast("int"))
    rows = (
        hashes.select(F.explode(F.array(low, high)).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(one).alias("set"))
        .toPandas()
    )
    out = np.zeros(bits // 64, np.int64)
    out[rows.word.to_numpy(np.int64)] = rows.set.to_numpy(np.int64)
    return out.view(np.uint64)


def neighbourhoods(docs: DataFrame, held, bits: int, reach: int, slice_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, segment, tokens, pos, hash): tokens around probed hits of a document."""
    kind = docs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        longs = pa.list_(pa.int64())
        has = lambda x: (table[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1
        for whole in batches:
            for part in byte_slices(whole, "text", slice_bytes):
                out: list[tuple] = []
                for i, h in zip(part.column(0).to_pylist(), hash_texts(part.column(1).to_pylist())):
                    if i is None or len(h) < SPAN:
                        continue
                    pos, val = [], []
                    for m in range(len(MASKS)):
                        x = seed_hashes(h, m)
                        a, b = probes(x, bits)
                        at = np.flatnonzero(has(a))
                        at = at[has(b[at])]
                        pos.append(at)
                        val.append(x[at])
                    p, v = np.concatenate(pos), np.concatenate(val)
                    if not len(p):
                        continue
                    order = np.argsort(p, kind="stable")
                    p, v = p[order], v[order]
                    # Hits whose reaches meet share one segment.
                    cuts = np.flatnonzero(np.diff(p) > 2 * reach + SPAN) + 1
                    for q, w in zip(np.split(p, cuts), np.split(v, cuts)):
                        lo, hi = max(0, int(q[0]) - reach), min(len(h), int(q[-1]) + SPAN + reach)
                        seg = h[lo:hi]
                        out.append((i, digest(seg), seg.view(np.int64), (q - lo).astype(np.int32), w.view(np.int64)))
                c = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(c, (part.schema.field(0).type, pa.int64(), longs, pa.list_(pa.int32()), longs))],
                    ["doc_id", "segment", "tokens", "pos", "hash"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, segment bigint, tokens array<bigint>, pos array<int>, hash array<bigint>")


def maximal_runs(same: np.ndarray, penalty: float) -> list[tuple[int, int]]:
    """All maximal scoring segments where equal places score 1 and others -``penalty``."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    found = maximal_segments(starts.tolist(), (ends - starts).astype(float).tolist(), penalty, ends.tolist())
    return [(a, b) for a, b, _ in found]


def covered_positions(
    seg: np.ndarray, item: np.ndarray, diagonals: np.ndarray, min_run: int, min_identity: float, penalty: float
) -> list[int]:
    """Positions of the item that acceptable runs on these diagonals match."""
    got = np.zeros(len(item), bool)
    for d in diagonals:
        lo, hi = max(0, -int(d)), min(len(item), len(seg) - int(d))
        if hi - lo < min_run:
            continue
        same = item[lo:hi] == seg[lo + d : hi + d]
        for a, b in maximal_runs(same, penalty):
            if b - a >= min_run and same[a:b].mean() >= min_identity:
                got[lo + a : lo + b] |= same[a:b]
    return np.flatnonzero(got).tolist()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_run: int = 10,
    min_identity: float = 0.7,
    penalty: float = 2.0,
    coverage: float = 0.5,
    enough: int = 50,
    bits: int = 1 << 26,
) -> DataFrame:
    """(id, item_id, item_tokens, covered, coverage) for every contaminated pair.

    Null ids and null, empty or short texts on either side take no part; texts of
    any length are read whole.  Rows that repeat a document's id count together.
    An item id with several texts is tested with each of them, and the best covered
    one is reported (ties: the longest, then by hash).  Ids may be of any type that
    can be grouped; other columns are not read.  An empty table on either side gives
    an empty result.  What is returned has been written to the shared folder.
    """
    spark = docs.sparkSession
    named = materialise(item_table(items.select(items[item_id_col].alias("i"), items[item_text_col].alias("t")), min_run), "items")
    texts = materialise(named.drop("item_id").dropDuplicates(["item"]), "item-texts")
    seeds = texts.select("item", F.explode(F.arrays_zip("hashes", "offsets")).alias("s")).select(
        "item", F.col("s.hashes").alias("hash"), F.col("s.offsets").alias("off")
    )
    reach = texts.agg(F.max(F.size("tokens"))).first()[0] or 0
    held = spark.sparkContext.broadcast(bitmap(seeds.select("hash"), bits))
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    near = materialise(neighbourhoods(src, held, bits, reach), "neighbourhoods")
    segments = near.dropDuplicates(["segment"])  # copies of a passage are checked once
    hits = (
        segments.select("segment", F.explode(F.arrays_zip("pos", "hash")).alias("h"))
        .select("segment", F.col("h.pos").alias("pos"), F.col("h.hash").alias("hash"))
        .join(seeds, "hash")
        .groupBy("segment", "item")
        .agg(F.collect_set(F.col("pos") - F.col("off")).alias("diagonals"))
    )

    @F.pandas_udf("array<int>")
    def check(seg: pd.Series, item: pd.Series, diagonals: pd.Series) -> pd.Series:
        return pd.Series(
            [covered_positions(s, i, d, min_run, min_identity, penalty) for s, i, d in zip(seg, item, diagonals)]
        )

    found = (
        hits.join(segments.select("segment", F.col("tokens").alias("seg")), "segment")
        .join(texts.select("item", "tokens"), "item")
        .select("segment", "item", F.size("tokens").alias("item_tokens"), check("seg", "tokens", "diagonals").alias("at"))
        .where(F.size("at") > 0)
    )
    pairs = (
        near.select("doc_id", "segment")
        .distinct()
        .join(found, "segment")
        .groupBy("doc_id", "item", "item_tokens")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("covered"))
        .withColumn("coverage", F.col("covered") / F.col("item_tokens"))
        .where((F.col("coverage") >= coverage) | (F.col("covered") >= enough))
    )
    best = F.max(F.struct("coverage", "covered", "item", "item_tokens")).alias("best")
    pairs = pairs.join(named.select("item_id", "item").distinct(), "item").groupBy("doc_id", "item_id").agg(best)
    pairs = pairs.select(
        F.col("doc_id").alias(id_col), F.col("item_id").alias(item_id_col), "best.item_tokens", "best.covered", "best.coverage"
    )
    return materialise(pairs, "contamination", named, texts, near)


def remove_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that no item contaminates, columns as given.

    Rows are judged by their text, so null or repeated ids change nothing: all rows
    of a contaminated text go, and null and empty texts stay.
    """
    key = F.xxhash64(docs[text_col])
    texts = docs.select(key.alias("key"), docs[text_col].alias("text")).where("text is not null")
    bad = contamination(texts, items, id_col="key", text_col="text", **options).select(F.col("key").alias("__bad")).distinct()
    return docs.join(bad, key == bad["__bad"], "left_anti")
