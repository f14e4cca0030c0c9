"""Quality rule: distribution divergence from language references.

Two histograms describe a document: characters over eight classes, and words
over the language's ``top_words`` most common words with one bin for the rest.
The references are the same histograms summed over all documents of a language,
so nothing is sampled.  A document is compared by the Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1).  Histograms of short documents
scatter: under ``min_chars`` or ``min_words`` that distance is null and doesn't
count against the document.  A document is rejected when a distance exceeds its
limit; that of words is derived from the language's reference.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices

#: Letters, as an explicit list of ranges that every regex engine reads alike.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏͰ-ҁҊ-ԯא-תء-يऄ-हก-ฮぁ-ヿ一-鿿가-힣"
_WORD = re.compile(f"[{LETTER}]+")
CLASSES = ("lower", "upper", "letter", "digit", "space", "point", "mark", "other")


def _class_table() -> np.ndarray:
    """Class of every code point below 0x10000; above it all are ``other``."""
    t = np.full(0x10001, 7, np.uint8)
    for lo, hi in re.findall("(.)-(.)", LETTER):
        t[ord(lo) : ord(hi) + 1] = 2
    t[ord("a") : ord("z") + 1] = 0
    t[ord("A") : ord("Z") + 1] = 1
    t[ord("0") : ord("9") + 1] = 3
    t[[9, 10, 11, 12, 13, 32]] = 4
    t[[ord(c) for c in ".,;:!?'\"-()"]] = 5
    rest = [c for c in range(33, 127) if t[c] == 7]
    t[rest] = 6
    return t


CLASS_OF = _class_table()


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(CLASS_OF[np.minimum(codes, 0x10000)], minlength=len(CLASSES))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of counts, both of positive sum."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    a, b = p > 0, q > 0
    d = (p[a] * np.log2(p[a] / m[a])).sum() / 2 + (q[b] * np.log2(q[b] / m[b])).sum() / 2
    return float(np.sqrt(min(max(d, 0.0), 1.0)))


def references(docs: DataFrame, top_words: int) -> dict[str | None, tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """lang -> (class counts, word -> bin, bin counts with the rest last).

    Words are counted in full; only each language's most common come to the
    driver (count, then word), so what is sent grows with languages alone.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in byte_slices(whole, "text", 8 << 20):
                words: dict[str | None, Counter] = {}
                chars: dict[str | None, np.ndarray] = {}
                for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not t:
                        continue
                    words.setdefault(lang, Counter()).update(_WORD.findall(t.lower()))
                    chars[lang] = chars.get(lang, 0) + class_counts(t)
                rows = [(g, True, w, n) for g, c in words.items() for w, n in c.items()]
                rows += [(g, False, str(k), int(n)) for g, v in chars.items() for k, n in enumerate(v)]
                rows += [(g, False, "words", c.total()) for g, c in words.items()]
                c = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.string()), pa.array(c[1], pa.bool_()), pa.array(c[2], pa.string()), pa.array(c[3], pa.int64())],
                    ["lang", "is_word", "item", "n"],
                )

    counted = docs.mapInArrow(count, "lang string, is_word boolean, item string, n bigint")
    counted = counted.groupBy("lang", "is_word", "item").agg(F.sum("n").alias("n"))
    # A constant limit on the rank alone: each task keeps that many rows a language
    # before the shuffle, so no task ever sees a language's whole vocabulary.
    group = Window.partitionBy("lang", "is_word").orderBy(F.desc("n"), "item")
    ranked = counted.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= max(top_words, len(CLASSES) + 1))
    out = {}
    for lang, rows in ranked.toPandas().groupby("lang", dropna=False):
        lang = lang if isinstance(lang, str) else None
        c, w = rows[~rows.is_word], rows[rows.is_word & (rows["rank"] <= top_words)].sort_values("rank")
        total = c.loc[c["item"] == "words", "n"].sum()
        c = c[c["item"] != "words"]
        chars = np.zeros(len(CLASSES))
        chars[c["item"].astype(int).to_numpy()] = c["n"].to_numpy()
        bins = np.zeros(len(w) + 1)
        bins[:-1] = w["n"].to_numpy()
        bins[-1] = total - bins.sum()
        out[lang] = (chars, {x: k for k, x in enumerate(w["item"])}, bins)
    return out


def word_limits(refs: dict, word_share: float) -> dict[str | None, float]:
    """lang -> limit of the word distance: a share of that of a text without one common word."""
    out = {}
    for lang, (_, _, bins) in refs.items():
        none = np.zeros(len(bins))
        none[-1] = 1.0
        out[lang] = round(word_share * js_distance(none, bins), 6) if bins.sum() else 1.0
    return out


class Judge:
    """Lengths, distances and verdict of one text, against its language's references."""

    def __init__(self, refs: dict, min_chars: int, min_words: int, max_char: float, word_share: float) -> None:
        self.refs, self.limits = refs, word_limits(refs, word_share)
        self.min_chars, self.min_words, self.max_char = min_chars, min_words, max_char

    def __call__(self, lang: str | None, text: str | None) -> tuple[int, int, float | None, float | None, bool]:
        if not text:
            return 0, 0, None, None, True
        found = _WORD.findall(text.lower())
        chars, bin_of, bins = self.refs[lang]
        char = word = None
        if len(text) >= self.min_chars:
            char = round(js_distance(class_counts(text), chars), 6)
        if len(found) >= max(1, self.min_words):
            last = len(bins) - 1
            word = round(js_distance(np.bincount([bin_of.get(w, last) for w in found], minlength=len(bins)), bins), 6)
        keep = (char is None or char <= self.max_char) and (word is None or word <= self.limits[lang])
        return len(text), len(found), char, word, keep


def _judge(docs: DataFrame, text_col: str, lang_col: str, top_words: int, *limits) -> Judge:
    return Judge(references(docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text")), top_words), *limits)


def divergence(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    top_words: int = 50,
    min_chars: int = 200,
    min_words: int = 50,
    max_char: float = 0.3,
    word_share: float = 0.93,
) -> DataFrame:
    """(id, lang, n_chars, n_words, char_jsd, word_jsd, keep) for every row.

    The limit of the word distance is each language's own: ``word_share`` of the
    distance that a text without any common word has, so gibberish and texts in
    another language exceed it.  Distances are rounded to 6 places.  Null and
    empty texts have length 0, null distances and are kept; a null language has
    its own reference; repeated rows count and are judged one by one; ids and
    other columns are not read, so null ids and ties are harmless; an empty table
    stays empty.
    """
    judge = _judge(docs, text_col, lang_col, top_words, min_chars, min_words, max_char, word_share)
    src = docs.select(docs[id_col].alias("id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"))
    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
    names = ["id", "lang", "n_chars", "n_words", "char_jsd", "word_jsd", "keep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in byte_slices(whole, "text", 4 << 20):
                cols = list(zip(*map(judge, part.column(1).to_pylist(), part.column(2).to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], names
                )

    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(
        run, f"id {kind}, lang string, n_chars bigint, n_words bigint, char_jsd double, word_jsd double, keep boolean"
    )
    return out.withColumnRenamed("id", id_col)


def keep_close(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    top_words: int = 50,
    min_chars: int = 200,
    min_words: int = 50,
    max_char: float = 0.3,
    word_share: float = 0.93,
) -> DataFrame:
    """The documents that are kept, columns as given.

    Every row is judged in place by an Arrow predicate, so null, repeated or
    clashing ids change nothing; empty texts and tables pass through.
    """
    judge = _judge(docs, text_col, lang_col, top_words, min_chars, min_words, max_char, word_share)

    @F.pandas_udf("boolean")
    def keep(langs: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([judge(g, t)[-1] for g, t in zip(langs, texts)], dtype=bool)

    return docs.where(keep(docs[lang_col].cast("string"), docs[text_col]))


def oracle(top_words: int = 50, min_chars: int = 200, min_words: int = 50, max_char: float = 0.3, word_share: float = 0.93) -> str:
    """DuckDB SQL for the rows of ``divergence`` with these parameters."""
    points = ".,;:!?''\"\\-()"
    single = {
        "lower": "[a-z]", "upper": "[A-Z]", "letter": f"[{LETTER}]", "digit": "[0-9]", "space": r"[\t-\r ]",
        "point": f"[{points}]", "mark": "[!-~]",
    }
    # Each class is stripped from what the ones before it left.
    steps, prev = [], "text"
    for k, (name, pattern) in enumerate(single.items()):
        steps.append((name, prev, f"r{k}", pattern))
        prev = f"r{k}"
    ctes = ["s AS (SELECT doc_id, lang, text FROM documents)"]
    held = "s"
    for name, src, dst, pattern in steps:
        ctes.append(f"{dst}t AS (SELECT *, regexp_replace({src}, '{pattern}', '', 'g') AS {dst} FROM {held})")
        held = f"{dst}t"
    counts = ", ".join(f"length({src}) - length({dst}) AS {name}" for name, src, dst, _ in steps)
    js = lambda p, q: f"sqrt(least(greatest(sum(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END) / 2, 0), 1))"
    return f"""
WITH {", ".join(ctes)},
cc AS (SELECT doc_id, lang, {counts}, length({prev}) AS other, length(text) AS n_chars FROM {held}),
cl AS (UNPIVOT cc ON {", ".join(CLASSES)} INTO NAME cls VALUE n),
cr AS (SELECT lang, cls, sum(n) AS m, sum(sum(n)) OVER (PARTITION BY lang) AS mt FROM cl GROUP BY lang, cls),
cj AS (SELECT doc_id, {js("p", "q")} AS d FROM (SELECT doc_id, n / n_chars AS p, m / mt AS q FROM cl JOIN cr USING (lang, cls) WHERE n_chars >= {min_chars}) GROUP BY doc_id),
w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[{LETTER}]+')) AS w FROM documents),
wc AS (SELECT doc_id, lang, w, count(*) AS n FROM w GROUP BY ALL),
wt AS (SELECT doc_id, lang, sum(n) AS n_words FROM wc GROUP BY ALL),
wr AS (SELECT lang, w, sum(n) AS m, sum(sum(n)) OVER (PARTITION BY lang) AS mt, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, w) AS rk FROM wc GROUP BY lang, w),
top AS (SELECT lang, w, m, mt FROM wr WHERE rk <= {top_words}),
lim AS (SELECT lang, round({word_share} * sqrt((log2(2 / (1 + q)) + 1 - q + CASE WHEN q > 0 THEN q * log2(2 * q / (1 + q)) ELSE 0 END) / 2), 6) AS most
  FROM (SELECT lang, 1 - sum(m) / any_value(mt) AS q FROM top GROUP BY lang)),
tops AS (SELECT lang, w, m / mt AS q FROM top UNION ALL SELECT lang, NULL, 1 - sum(m) / any_value(mt) FROM top GROUP BY lang),
hit AS (SELECT doc_id, lang, top.w AS w, sum(n) AS n FROM wc LEFT JOIN top USING (lang, w) GROUP BY ALL),
wj AS (SELECT wt.doc_id, {js("p", "q")} AS d FROM (
   SELECT wt.doc_id, coalesce(n, 0) / n_words AS p, q FROM wt JOIN tops USING (lang)
   LEFT JOIN hit ON hit.doc_id = wt.doc_id AND hit.w IS NOT DISTINCT FROM tops.w WHERE n_words >= {min_words}) wt GROUP BY wt.doc_id)
SELECT doc_id, documents.lang, length(text) AS n_chars, coalesce(n_words, 0)::BIGINT AS n_words, round(cj.d, 6) AS char_jsd, round(wj.d, 6) AS word_jsd,
  coalesce(round(cj.d, 6) <= {max_char}, true) AND coalesce(round(wj.d, 6) <= lim.most, true) AS keep
FROM documents LEFT JOIN cj USING (doc_id) LEFT JOIN wj USING (doc_id) LEFT JOIN wt USING (doc_id) LEFT JOIN lim ON lim.lang = documents.lang
"""
