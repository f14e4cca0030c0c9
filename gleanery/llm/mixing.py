"""Mixing sources to target weights by systematic sampling.

A document's expected copies are its own weight (1 unless a column gives it) times
a rate of its source, w * T / n: w the source's target weight, n its weighted size
and T the wanted total, both in the sizing unit (characters or rows).  Within a
source the expected copies are prefix-summed over all its documents, one random
offset is added, and a document is emitted once for every integer that its interval
crosses.  Each source so gets its share to within one document, with the least
variance.

The prefix sum is distributed.  A source's order is by a hash of the id (MD5, which
any engine has), and its leading bits cut the order into blocks of about
``block_rows`` documents.  Blocks are summed first, their few totals are
prefix-summed, and each block then sums its own rows.  So the result doesn't depend
on the number of blocks, and a source that holds most rows is split over many
tasks.  Full rows are shuffled once.  Sums are integers in units of 2^-30 copies,
so they don't depend on the order of addition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused

RATE_BITS, WEIGHT_BITS = 20, 10
UNIT = 1 << RATE_BITS
HASH_BITS = 60


def _md5_bits(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def place(key: Column) -> Column:
    """A row's place in its source's order; null ids are spread by their row's number."""
    missing = F.concat(F.lit("null:"), F.monotonically_increasing_id().cast("string"))
    return _md5_bits(F.coalesce(key.cast("string"), missing), HASH_BITS // 4)


def rates(per: DataFrame, weights: dict[str, float] | None, total: int | None) -> DataFrame:
    """(source, rate): expected copies of a document of weight 1, in units of 2^-20.

    ``per`` has (source, n), a row a source.  Missing weights are 0; without any,
    sources weigh alike.  ``total`` is the wanted size, by default all of ``n``.
    """
    if weights:
        w = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("source")], F.lit(0.0))
    else:
        w = F.lit(1.0)
    per = per.withColumn("w", F.when(F.col("n") > 0, w).otherwise(0.0))
    found = per.agg(F.sum("n").cast("double").alias("n"), F.sum("w").alias("w")).first()
    wanted = float(total) if total is not None else found.n or 0.0
    rate = F.floor(F.col("w") / F.lit(found.w or 1.0) * wanted / F.col("n") * UNIT + 0.5).cast("bigint")
    return per.select("source", F.coalesce(F.when(F.col("n") > 0, rate), F.lit(0)).alias("rate"))


def mix(
    docs: DataFrame,
    *,
    weights: dict[str, float] | None = None,
    total: int | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str | None = "n_chars",
    weight_col: str | None = None,
    copy_col: str | None = "copy",
    block_rows: int = 1 << 13,
    seed: int = 7,
) -> DataFrame:
    """The sampled documents, a row for each copy, numbered from 1 in ``copy_col``.

    Sizes are those of ``size_col``, or 1 a row; document weights those of
    ``weight_col``, to 1/1024.  Null and negative ones count 0.  All columns are
    kept; with ``copy_col=None`` no number is added, and where a column has that
    name already underscores are put before it.  A null source is a source of its
    own.  Ids may be of any type; rows that repeat one stand together in the order
    and are sampled one by one, null ids are spread.  An empty table stays empty.
    """
    names = docs.columns
    number, src, at, block, unit, upto, n_, src_, block_, rate_, start_ = unused(
        names, copy_col or "copy", "src", "at", "block", "unit", "upto", "copies", "_src", "_block", "_rate", "_start"
    )
    count = lambda c: F.greatest(F.coalesce(docs[c], F.lit(0)), F.lit(0))
    unit_of = F.lit(1 << WEIGHT_BITS).cast("bigint")
    if weight_col is not None:
        unit_of = F.floor(count(weight_col) * (1 << WEIGHT_BITS) + 0.5).cast("bigint")
    # Null sources get a text of their own, so that plain equality joins them.
    source_text = F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("null"))
    keyed = docs.withColumns({src: source_text, at: place(docs[id_col]), unit: unit_of})
    size = F.lit(1).cast("bigint") if size_col is None else count(size_col).cast("bigint")

    bits = max(0, math.ceil(math.log2(max(1, docs.count()) / block_rows)))
    keyed = keyed.withColumn(block, F.shiftright(at, HASH_BITS - bits).cast("int"))
    # A row for each source and block: sizes that grow with sources and blocks only.
    weighted = F.sum(size * F.col(unit)) / (1 << WEIGHT_BITS) if weight_col is not None else F.sum(size)
    sums = keyed.groupBy(src, block).agg(weighted.alias("n"), F.sum(unit).alias("units"))
    per = sums.groupBy(src).agg(F.sum("n").alias("n")).select(
        F.col(src).alias("key"), F.when(F.col(src) != "null", F.substr(src, F.lit(2))).alias("source"), "n"
    )
    rate = rates(per, weights, total).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias(src), "rate")
    before = Window.partitionBy(src).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offset = _md5_bits(F.concat(F.lit(f"{seed}:"), F.when(F.col(src) == "null", F.lit("<null>")).otherwise(F.substr(src, F.lit(2)))), 5)
    ahead = F.coalesce(F.sum(F.col("rate").cast("decimal(19,0)") * F.col("units").cast("decimal(19,0)")).over(before), F.lit(0))
    # Only the fraction of a block's start decides which integers its rows cross.
    fraction = F.pmod(ahead, F.lit(1 << RATE_BITS + WEIGHT_BITS)).cast("bigint")
    starts = sums.join(rate, src).select(
        F.col(src).alias(src_), F.col(block).alias(block_), F.col("rate").alias(rate_),
        (F.shiftleft(offset, WEIGHT_BITS) + fraction).alias(start_),
    )
    plain = [F.col(c) for c, t in docs.dtypes if "map<" not in t and "variant" not in t and c != id_col]
    within = Window.partitionBy(src, block).orderBy(at, id_col, F.xxhash64(*plain) if plain else F.lit(0))
    summed = keyed.withColumn(upto, F.sum(unit).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    joined = summed.join(starts, (summed[src] == starts[src_]) & (summed[block] == starts[block_]))
    integer = lambda c: F.shiftright(F.col(start_) + F.col(rate_) * c, RATE_BITS + WEIGHT_BITS)
    out = joined.withColumn(n_, (integer(F.col(upto)) - integer(F.col(upto) - F.col(unit))).cast("int")).where(F.col(n_) > 0)
    out = out.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(n_))))
    return out.select(*names, *([number] if copy_col else []))


ORACLE = """
WITH per AS (SELECT source, sum(greatest(coalesce(n_chars, 0), 0))::DOUBLE AS n FROM documents GROUP BY source),
ex AS (SELECT source, CAST(floor((1.0 / sum(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) OVER ())
              * sum(n) OVER () / n * 1048576 + 0.5) AS BIGINT) AS e FROM per WHERE n > 0),
st AS (SELECT d.*, ex.e,
  ('0x' || substr(md5('7:' || d.source), 1, 5))::BIGINT AS u,
  row_number() OVER (PARTITION BY d.source ORDER BY ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 15))::BIGINT, d.doc_id) AS rk
  FROM documents d JOIN ex USING (source)),
n AS (SELECT *, ((u + e * rk) >> 20) - ((u + e * (rk - 1)) >> 20) AS k FROM st)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, k + 1))::INT AS copy FROM n WHERE k > 0
"""
