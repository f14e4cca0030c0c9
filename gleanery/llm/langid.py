"""Language identification of mixed-language texts, span by span.

Script ranges narrow the candidates: the first letter of a word gives its
script, and only languages that were trained on words of that script compete for
it.  A script that no language was trained on has one label of its own: the
language that alone uses it (Greek, Hebrew, Thai, ...), else ``und-`` and its
name.

Every word then has a score for each candidate, the log-probability of its
letters under an interpolated trigram model of the language, cut off ``clip``
below the best candidate so that no single name or typo decides.  Viterbi's
algorithm finds the labelling of the whole word sequence with the highest sum of
scores when each change of language costs ``penalty``; runs of one label are the
spans.

Most documents have one language, and that can be proved without the dynamic
programme: if no run of words gains more than ``penalty`` for another label than
the one with the best total, every further span costs at least what it brings.
That test is a cumulative sum and a running minimum; only the documents that
fail it are searched.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMO_WORDS, Finder, byte_slices

_letters = Finder(r"[^\W\d_]+")

#: First code point of each range, in order, with the range's script.
SCRIPTS = (
    (0x0000, "Latn"), (0x0370, "Grek"), (0x0400, "Cyrl"), (0x0530, "Armn"), (0x0590, "Hebr"), (0x0600, "Arab"),
    (0x0780, "Zyyy"), (0x0900, "Deva"), (0x0980, "Beng"), (0x0A00, "Guru"), (0x0A80, "Gujr"), (0x0B00, "Zyyy"),
    (0x0B80, "Taml"), (0x0C00, "Telu"), (0x0C80, "Knda"), (0x0D00, "Mlym"), (0x0D80, "Sinh"), (0x0E00, "Thai"),
    (0x0E80, "Laoo"), (0x0F00, "Tibt"), (0x1000, "Mymr"), (0x10A0, "Geor"), (0x1100, "Hang"), (0x1200, "Ethi"),
    (0x1380, "Zyyy"), (0x1780, "Khmr"), (0x1800, "Zyyy"), (0x1E00, "Latn"), (0x1F00, "Grek"), (0x2000, "Zyyy"),
    (0x2C60, "Latn"), (0x2C80, "Zyyy"), (0x2E80, "Hani"), (0x3040, "Kana"), (0x3100, "Hani"), (0x3130, "Hang"),
    (0x3190, "Hani"), (0xA000, "Zyyy"), (0xA720, "Latn"), (0xA800, "Zyyy"), (0xAC00, "Hang"), (0xD800, "Zyyy"),
    (0xF900, "Hani"), (0xFB00, "Latn"), (0xFB1D, "Hebr"), (0xFB50, "Arab"), (0xFE00, "Zyyy"), (0xFF21, "Latn"),
    (0xFF66, "Kana"), (0x10000, "Zyyy"), (0x20000, "Hani"), (0x30000, "Zyyy"),
)
_STARTS = [s for s, _ in SCRIPTS]

#: Scripts with one main language, for words that no trained language competes for.
SOLE = {
    "Grek": "el", "Hebr": "he", "Armn": "hy", "Thai": "th", "Laoo": "lo", "Geor": "ka", "Hang": "ko", "Kana": "ja",
    "Khmr": "km", "Mymr": "my", "Sinh": "si", "Taml": "ta", "Telu": "te", "Knda": "kn", "Mlym": "ml", "Guru": "pa",
    "Gujr": "gu", "Tibt": "bo",
}
#: Score of a label that is no candidate for a word.
BARRED = -60.0


def script_of(char: str) -> str:
    return SCRIPTS[bisect.bisect_right(_STARTS, ord(char)) - 1][1]


def padded(word: str) -> str:
    return f"\x02\x02{word}\x03"


@dataclass(frozen=True)
class LanguageModel:
    """Counts of letter n-grams by language; labels are sorted, scripts' own last."""

    languages: tuple[str, ...]
    grams: dict[str, tuple[int, ...]]  # n-gram of 1 to 3 letters -> count in each language
    contexts: dict[str, tuple[int, ...]]  # its first n - 1 letters -> count
    scripts: dict[str, tuple[int, ...]]  # script -> indices of the languages that compete for it
    labels: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        own = {SOLE.get(s, f"und-{s}") for _, s in SCRIPTS if s not in self.scripts}
        object.__setattr__(self, "labels", (*self.languages, *sorted(own - set(self.languages))))


class Scorer:
    """Word and n-gram scores of a model, memoised for one Python worker."""

    def __init__(self, model: LanguageModel, clip: float, strength: float = 5.0) -> None:
        self.model, self.clip, self.strength = model, clip, strength
        self.zero = np.zeros(len(model.languages))
        self.own = {
            s: model.labels.index(SOLE.get(s, f"und-{s}")) for _, s in SCRIPTS if s not in model.scripts
        }
        self.reset()

    def reset(self) -> None:
        self.gram_at: dict[str, int] = {}
        self.gram_rows: list[np.ndarray] = []
        self.word_at: dict[str, int] = {}
        self.rows = np.empty((1 << 12, len(self.model.labels)))

    def gram(self, g: str) -> int:
        """Row of log P(last letter | the two before), by language."""
        at = self.gram_at.get(g)
        if at is None:
            m, k = self.model, self.strength
            n = lambda table, key: np.array(table.get(key, self.zero), float)
            p = (n(m.grams, g[2]) + 0.5) / (n(m.contexts, "") + 0.5 * 256)
            for cut in (1, 0):
                p = (n(m.grams, g[cut:]) + k * p) / (n(m.contexts, g[cut:2]) + k)
            at = self.gram_at[g] = len(self.gram_rows)
            self.gram_rows.append(np.log(p))
        return at

    def learn(self, words: set[str]) -> None:
        """Score words that have no row yet, all at once."""
        if len(self.word_at) + len(words) > MEMO_WORDS and self.word_at:
            self.reset()
        fresh = [w for w in words if w not in self.word_at]
        if not fresh:
            return
        base = len(self.word_at)
        while len(self.rows) < base + len(fresh):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        out = self.rows[base : base + len(fresh)]
        out[:] = BARRED
        by_script: dict[str, list[int]] = {}
        for i, w in enumerate(fresh):
            by_script.setdefault(script_of(w[0]), []).append(i)
        for script, members in by_script.items():
            langs = self.model.scripts.get(script)
            if langs is None:
                out[members, self.own[script]] = 0.0
                continue
            idx, starts = [], []
            for i in members:
                p = padded(fresh[i])
                starts.append(len(idx))
                idx += [self.gram(p[j : j + 3]) for j in range(len(p) - 2)]
            s = np.add.reduceat(np.array(self.gram_rows)[idx], starts)[:, langs]
            s -= s.max(axis=1, keepdims=True)
            out[np.ix_(members, langs)] = np.maximum(s, -self.clip)
        for i, w in enumerate(fresh):
            self.word_at[w] = base + i

    def scores(self, tokens: list[str]) -> np.ndarray:
        return self.rows[np.fromiter(map(self.word_at.__getitem__, tokens), np.int64, len(tokens))]


def viterbi(rows: list[list[float]], penalty: float) -> list[int]:
    """State of every row; ties stay in a state, else go to the lowest one."""
    v = rows[0]
    tops, masks = [], []
    for r in rows[1:]:
        top = max(v)
        from_top = top - penalty
        mask, nxt = 0, []
        for k, x in enumerate(r):
            y = v[k]
            if y < from_top:
                y = from_top
                mask |= 1 << k
            nxt.append(x + y)
        tops.append(v.index(top))
        masks.append(mask)
        v = nxt
    state = v.index(max(v))
    path = [state]
    for top, mask in zip(reversed(tops), reversed(masks)):
        if mask >> state & 1:
            state = top
        path.append(state)
    path.reverse()
    return path


def label_words(s: np.ndarray, penalty: float) -> list[tuple[int, int, int]]:
    """(start, end, label) spans of the best labelling of the score rows ``s``."""
    n = len(s)
    used = np.flatnonzero((s > BARRED).any(axis=0))
    if len(used) == 1:
        return [(0, n, int(used[0]))]
    s = s[:, used]
    sums = np.zeros((n + 1, len(used)))
    np.cumsum(s, axis=0, out=sums[1:])
    best = int(sums[-1].argmax())
    # What other labels gain over the best one: within one run of words, which costs
    # two switches or at an end one; runs at both ends with none of the best label
    # between them save one switch.  Where neither pays, one label is optimal.
    gain = sums - sums[:, best : best + 1]
    within = (gain - np.minimum.accumulate(gain, axis=0)).max()
    if within <= penalty and gain.max() + (gain[-1] - gain).max() <= penalty:
        return [(0, n, int(used[best]))]
    path = np.array(viterbi(s.tolist(), penalty))
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [n]))
    return [(int(a), int(b), int(used[path[a]])) for a, b in zip(cuts[:-1], cuts[1:])]


def train(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_per_language: int = 1000,
    min_share: float = 0.02,
    seed: int = 23,
) -> LanguageModel:
    """Fit trigram counts on a bounded sample of labelled rows.

    ``max_per_language`` rows of each language at most, the first by a seeded
    hash of their ids, are used, as whole texts; nothing else is sampled.  A
    language competes for a script when at least ``min_share`` of its sample's
    words are of it.  Rows whose id, text or language is null are not used;
    without any the model has no languages, and words get their script's label.
    """
    keyed = docs.select(
        docs[id_col].alias("id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text")
    ).where("id is not null and lang is not null and text is not null")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    picked = (
        keyed.select("id", "lang")
        .withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= max_per_language)
        .select("id", "lang")
        .distinct()
    )
    # max_per_language rows a language at most: the size of the hash table is fixed.
    sample = keyed.join(F.broadcast(picked), ["id", "lang"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in byte_slices(whole, "text", 4 << 20):
                seen: dict[tuple[str, str], int] = {}
                for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for w in _letters(t.lower()):
                        seen[lang, w] = seen.get((lang, w), 0) + 1
                grams: dict[tuple[str, str], int] = {}
                for (lang, w), n in seen.items():
                    keys = [f"#{script_of(w[0])}"]
                    p = padded(w)
                    for i in range(2, len(p)):
                        keys += [p[i], p[i - 1 : i + 1], p[i - 2 : i + 1]]
                    for key in keys:
                        grams[lang, key] = grams.get((lang, key), 0) + n
                rows = [(*k, n) for k, n in grams.items()]
                c = list(zip(*rows)) if rows else [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64())],
                    ["lang", "gram", "n"],
                )

    counted = (
        sample.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ).toPandas()
    languages = tuple(sorted(counted.lang.unique()))
    at = {x: i for i, x in enumerate(languages)}
    grams: dict[str, list[int]] = {}
    contexts: dict[str, list[int]] = {}
    found: dict[str, list[int]] = {}
    for lang, g, n in zip(counted.lang, counted.gram, counted.n):
        if len(g) == 5 and g[0] == "#":
            found.setdefault(g[1:], [0] * len(languages))[at[lang]] += int(n)
            continue
        grams.setdefault(g, [0] * len(languages))[at[lang]] += int(n)
        contexts.setdefault(g[:-1], [0] * len(languages))[at[lang]] += int(n)
    words = np.sum(list(found.values()), axis=0) if found else np.zeros(0)
    scripts = {}
    for s, n in sorted(found.items()):
        competing = tuple(int(i) for i in np.flatnonzero(np.array(n) >= np.maximum(1, min_share * words)))
        if competing:
            scripts[s] = competing
    return LanguageModel(
        languages, {g: tuple(n) for g, n in grams.items()}, {g: tuple(n) for g, n in contexts.items()}, scripts
    )


def identify(
    docs: DataFrame,
    model: LanguageModel,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    penalty: float = 10.0,
    clip: float = 6.0,
    slice_bytes: int = 2 << 20,
) -> DataFrame:
    """One row a document: (id, n_words, lang_id, share, spans).

    ``spans`` lists (start, end, lang), in word positions with the end exclusive;
    together they cover all words.  ``lang_id`` is the label of most words (ties:
    the first in the alphabet) and ``share`` its share of them.  Words are runs
    of letters.  Texts that are null or without a word have no span, and null for
    language and share; null ids pass through, repeated rows get a row each, and
    other columns are not read.
    """
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, clip)
        for whole in batches:
            for part in byte_slices(whole, "text", slice_bytes):
                tokens = [_letters(t.lower()) if t else [] for t in part.column(1).to_pylist()]
                scorer.learn(set().union(*tokens))
                counts, langs, shares, spans = [], [], [], []
                for words in tokens:
                    counts.append(len(words))
                    if not words:
                        langs.append(None)
                        shares.append(None)
                        spans.append([])
                        continue
                    found = label_words(scorer.scores(words), penalty)
                    total: dict[str, int] = {}
                    for a, b, k in found:
                        total[model.labels[k]] = total.get(model.labels[k], 0) + b - a
                    top = min(total, key=lambda x: (-total[x], x))
                    langs.append(top)
                    shares.append(round(total[top] / len(words), 6))
                    spans.append([{"start": a, "end": b, "lang": model.labels[k]} for a, b, k in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(counts, pa.int32()), pa.array(langs, pa.string()),
                        pa.array(shares, pa.float64()), pa.array(spans, span_type),
                    ],
                    ["id", "n_words", "lang_id", "share", "spans"],
                )

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(
        run,
        f"id {kind}, n_words int, lang_id string, share double, spans array<struct<start:int,end:int,lang:string>>",
    ).withColumnRenamed("id", id_col)
