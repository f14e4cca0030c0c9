"""Toxicity: every significant maximal-scoring passage of every document.

Training.  Per-token log-odds of toxic against other labelled documents, with
an informative Dirichlet prior from both classes together (Monroe et al. 2008).
Tokens are lower-cased words, and what is counted are their distinct contexts
(the word before with the word after), so copies of one document and repeated
lines give no more evidence than a single one.  A token scores only with a
z-score of ``min_z`` and log-odds of ``min_log_odds`` at least.  At most ``max_labelled`` labelled rows, the first by
a seeded hash of their id, are used; that bound is the only sample, all
documents are then scored.

Search.  Each token scores its log-odds (0 where it has none), capped, less
``drift``, so ordinary text drifts down.  The linear scan of Ruzzo and Tompa (1999) then finds all
maximal scoring segments of the whole token sequence.  Stretches without a
positive token collapse into one negative step first, so a clean document costs
one table look-up per token.

Calibration.  For such scores the maximum over n random tokens follows an
extreme-value law P(S >= x) = 1 - exp(-K n e^(-lambda x)) (Karlin and Altschul
1990).  lambda solves sum p e^(lambda s) = 1 over the token frequencies of
non-toxic text (smoothed, so that positive scores occur), and K is its
maximum-likelihood value given lambda on the upper half of such documents'
positive maxima, lower ones being censored; K is at most 1.  Tokens are chosen for being rare in
the non-toxic texts that they were counted in, so these would look too clean:
the labelled sample is halved, and each half is scored by the tokens of the
other.  Where a half gives no tokens, K is 1.  A segment is
significant when its expected number of equals in a document of that length is
at most ``max_evalue``.  A document's segments are aggregated by their Poisson
statistic into one p-value; at ``max_p`` or less the document is toxic.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, byte_slices, drop_tables, hash_words, materialise, mix64, words


@dataclass(frozen=True)
class ToxicityModel:
    scores: dict[str, float]  # only tokens that differ from -drift
    drift: float
    lam: float
    k: float

    @property
    def empty(self) -> bool:
        return not self.scores


def dirichlet_log_odds(
    toxic: Counter, other: Counter, prior_share: float, min_z: float, cap: float
) -> dict[str, float]:
    """Tokens whose log-odds (nats) are above zero with z of at least ``min_z``."""
    n1, n0 = sum(toxic.values()), sum(other.values())
    if not n1 or not n0:
        return {}
    mass = prior_share * (n1 + n0)
    out = {}
    for w, y1 in toxic.items():
        y0 = other.get(w, 0)
        a = prior_share * (y1 + y0)
        delta = math.log((y1 + a) / (n1 + mass - y1 - a)) - math.log((y0 + a) / (n0 + mass - y0 - a))
        if delta > 0 and delta / math.sqrt(1 / (y1 + a) + 1 / (y0 + a)) >= min_z:
            out[w] = min(delta, cap)
    return out


def solve_lambda(values: np.ndarray, probs: np.ndarray) -> float:
    """The positive root of sum p e^(lambda s) = 1 (mean score negative)."""
    lo, hi = 1e-9, 1.0
    f = lambda x: float(np.dot(probs, np.exp(np.minimum(x * values, 700)))) - 1.0
    while f(hi) < 0 and hi < 1e4:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def maximal_segments(
    positions: list[int], scores: list[float], drift: float, ends: list[int] | None = None
) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive.

    ``positions`` and ``scores`` are the tokens that score above zero, or runs of
    them up to ``ends`` with their sums; every other token scores ``-drift``.
    Amortised linear time.
    """
    found: list[list[float]] = []  # start, end, left sum, right sum
    total, last = 0.0, 0
    for at, end, s in zip(positions, ends or [p + 1 for p in positions], scores):
        total -= drift * (at - last)
        left, total, last = total, total + s, end
        cur = [at, end, left, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j -= 1
            if j < 0 or found[j][3] >= cur[3]:
                found.append(cur)
                break
            cur = [found[j][0], cur[1], found[j][2], cur[3]]
            del found[j:]
    return [(int(a), int(b), r - le) for a, b, le, r in found]


def expected_equals(model: ToxicityModel, n: int, score: float) -> float:
    return model.k * n * math.exp(-model.lam * score)


def poisson_p(evalues: list[float]) -> float:
    """p-value of a set of segments (Karlin and Altschul's Poisson statistic).

    At least r segments of expectation e have chance e^r / r! at most; the best r
    counts, each r paying 2^r for the choice.
    """
    best = 0.0  # log p
    for r, e in enumerate(sorted(evalues), 1):
        if e > 0:
            best = min(best, r * (math.log(2 * e)) - math.lgamma(r + 1))
        else:
            return 0.0
    return math.exp(best)


def score_tokens(model: ToxicityModel, tokens: list[str]) -> tuple[list[tuple[int, int, float, float]], float]:
    """All maximal segments as (start, end, score, expected equals), and p-value."""
    table, n = model.scores, len(tokens)
    pos = [i for i, t in enumerate(tokens) if t in table]
    if not pos:
        return [], 1.0
    found = maximal_segments(pos, [table[tokens[i]] - model.drift for i in pos], model.drift)
    segments = [(a, b, s, expected_equals(model, n, s)) for a, b, s in found]
    return segments, poisson_p([e for *_, e in segments])


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = 12_000,
    seed: int = 17,
    prior_share: float = 0.1,
    min_z: float = 3.0,
    min_log_odds: float = 2.0,
    cap: float = 8.0,
    drift: float = 0.2,
) -> ToxicityModel:
    """Fit log-odds and the extreme-value law on a bounded labelled sample.

    Labels or texts that are null are not used; of several labels of one id the
    worst counts, and rows that repeat a labelled id are all used.  With no toxic or
    no other labelled document, or an empty table, the model is empty and finds
    nothing.  Other columns are not read.
    """
    picked = (
        labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y"))
        .where("id is not null and y is not null")
        .groupBy("id")
        .agg(F.max("y").alias("y"))  # of several labels the worst counts
        .orderBy(F.xxhash64("id", F.lit(seed)), "id")
        .limit(max_labelled)
    )

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for whole in batches:
            for b in byte_slices(whole, "text", 4 << 20):
                held: dict[tuple[int, int, str, int], None] = {}
                for fold, label, t in zip(*(c.to_pylist() for c in b.columns)):
                    toks = words(t)
                    h = np.zeros(len(toks) + 2, np.uint64)
                    h[1:-1] = hash_words(toks, memo)
                    ctx = mix64(h[:-2] * np.uint64(3) + h[2:]).view(np.int64).tolist()
                    held.update(dict.fromkeys(zip([fold] * len(toks), [int(label > 0)] * len(toks), toks, ctx)))
                fs, ys, ws, cs = zip(*held) if held else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fs, pa.int32()), pa.array(ys, pa.int32()), pa.array(ws, pa.string()), pa.array(cs, pa.int64())],
                    ["fold", "y", "w", "c"],
                )

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    fold = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(2)).cast("int").alias("fold")
    # The picked ids are at most max_labelled, so their hash table has a fixed size.
    sample = materialise(src.join(F.broadcast(picked), "id").select(fold, "y", "text"), "toxicity-sample")
    counted = [F.count_if((F.col("y") == y) & (F.col("fold") == f)).alias(f"n{y}{f}") for y in (1, 0) for f in (0, 1)]
    rows = materialise(
        sample.mapInArrow(contexts, "fold int, y int, w string, c bigint")
        .groupBy("y", "w", "c")
        .agg(F.min("fold").alias("fold"))  # a context of both halves counts in one
        .groupBy("w")
        .agg(*counted),
        "toxicity-counts",
    )
    totals = rows.agg(*(F.sum(c).alias(c) for c in rows.columns[1:])).first().asDict()
    kept = rows.where("n10 + n11 > 1").toPandas()
    held = {c: Counter(dict(zip(kept.w, kept[c].astype(int)))) for c in kept.columns[1:]}
    for c, n in totals.items():
        # What is left out counts in the totals, under a key that no token has.
        held[c][""] = int(n or 0) - sum(held[c].values())

    def fit(folds: tuple[int, ...]) -> dict[str, float]:
        toxic, other = (sum((held[f"n{y}{f}"] for f in folds), Counter()) for y in (1, 0))
        found = dirichlet_log_odds(toxic, other, prior_share, min_z, cap)
        return {w: x for w, x in found.items() if w and x >= min_log_odds}

    scores, halves = fit((0, 1)), [fit((0,)), fit((1,))]
    if not scores:
        drop_tables(docs.sparkSession, sample, rows)
        return ToxicityModel({}, drift, 1.0, 1.0)
    # Background frequencies of each half's tokens in the other half's texts; the
    # tokens share one pseudo-count, so unseen ones occur too.
    crossed = [(table_, held[f"n0{1 - f}"]) for f, table_ in enumerate(halves) if table_]
    crossed = crossed if len(crossed) == 2 else [(scores, held["n00"] + held["n01"])]
    values = np.array([x - drift for table_, _ in crossed for x in table_.values()] + [-drift])
    freq = np.array([(seen.get(w, 0) + 1.0 / len(t)) / (sum(seen.values()) + 1.0) for t, seen in crossed for w in t]) / len(crossed)
    lam = solve_lambda(values, np.append(freq, 1.0 - freq.sum()))
    drafts = [ToxicityModel(t, drift, lam, 1.0) for t in reversed(halves)]  # by the half that is scored

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, top = [], []
            for f, y, t in zip(*(c.to_pylist() for c in b.columns)):
                toks = words(t)
                if y == 0 and toks:
                    n.append(len(toks))
                    top.append(max((x for _, _, x, _ in score_tokens(drafts[f], toks)[0]), default=0.0))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(top, pa.float64())], ["n", "top"])

    # One row a labelled document, so max_labelled at most.
    got = sample.mapInArrow(maxima, "n bigint, top double").toPandas()
    drop_tables(docs.sparkSession, sample, rows)
    k, above = 1.0, got.top[got.top > 0]
    if len(crossed) == 2 and len(above):
        # The law is one of the tail: K is fitted above the median of the positive
        # maxima, and lower ones count as censored there.
        u = float(above.median())
        k = (int((got.top >= u).sum()) + 1) / float((got.n * np.exp(-lam * np.maximum(got.top, u))).sum())
    return ToxicityModel(scores, drift, lam, min(1.0, k))


def detect(
    docs: DataFrame,
    model: ToxicityModel,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_evalue: float = 0.05,
    max_p: float = 1e-3,
    slice_bytes: int = 4 << 20,
) -> DataFrame:
    """One row a document: (id, n_tokens, segments, max_score, p_value, toxic).

    ``segments`` lists every significant passage as (start, end, score, evalue)
    in token positions, end exclusive, by start.  Null or empty text has no
    segment, p-value 1 and is not toxic; a null id passes through; repeated rows
    each get their own row; other columns are not read.
    """
    fields = ("start", "end", "score", "evalue")
    seg_type = pa.list_(pa.struct(list(zip(fields, (pa.int32(), pa.int32(), pa.float64(), pa.float64())))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in byte_slices(whole, "text", slice_bytes):
                n_tok, segs, best, p = [], [], [], []
                for t in part.column(1).to_pylist():
                    toks = words(t)
                    found, pv = score_tokens(model, toks)
                    n_tok.append(len(toks))
                    segs.append([dict(zip(fields, x)) for x in found if x[3] <= max_evalue])
                    best.append(max((x[2] for x in found), default=0.0))
                    p.append(pv)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n_tok, pa.int32()),
                        pa.array(segs, seg_type),
                        pa.array(best, pa.float64()),
                        pa.array(p, pa.float64()),
                        pa.array([v <= max_p for v in p], pa.bool_()),
                    ],
                    ["id", "n_tokens", "segments", "max_score", "p_value", "toxic"],
                )

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(
        run,
        f"id {kind}, n_tokens int, segments array<struct<start:int,end:int,score:double,evalue:double>>, "
        "max_score double, p_value double, toxic boolean",
    ).withColumnRenamed("id", id_col)


def remove_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", max_p: float = 1e-3) -> DataFrame:
    """The documents that are not toxic, columns as given.

    The text is judged in place by an Arrow predicate, whole and whatever its length
    (Spark bounds the batches by bytes): no join on ids, so null or repeated ids and
    any extra columns are harmless.  Null and empty texts stay, and an empty table
    stays empty.
    """
    if model.empty:
        return docs

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series([score_tokens(model, words(t))[1] <= max_p for t in texts], dtype=bool)

    return docs.where(~toxic(docs[text_col]))
