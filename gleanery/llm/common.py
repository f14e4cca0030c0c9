"""Helpers shared by the operators: tokens, hashing, Arrow plumbing, storage."""

from __future__ import annotations

import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BEYOND_LATIN = re.compile("[\u0300-\U0010ffff]")


@lru_cache(maxsize=1)
def combining_marks() -> str:
    """All combining marks as ranges of a character class."""
    marks = [k for k in range(0x300, 0x20000) if unicodedata.category(chr(k))[0] == "M"]
    cuts = [k for k, (x, y) in enumerate(pairwise(marks), 1) if y != x + 1]
    return "".join(f"{chr(marks[i])}-{chr(marks[j - 1])}" for i, j in pairwise([0, *cuts, len(marks)]))


class Finder:
    """Runs of characters of a class, with the combining marks among them.

    Python's word classes leave marks out, so words of Indic scripts would fall
    apart.  Texts without a mark, which are most, take the fast plain expression.
    """

    def __init__(self, plain: str) -> None:
        self.plain, self.full = re.compile(plain), None

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not _BEYOND_LATIN.search(text):
            return self.plain.findall(text)
        if self.full is None:
            marks = combining_marks()
            self.mark = re.compile(f"[{marks}]")
            self.full = re.compile(rf"(?:{self.plain.pattern}|[{marks}]+)+")
        return (self.full if self.mark.search(text) else self.plain).findall(text)


_find_words = Finder(r"\w+")

#: Upper bound on memoised words per Python worker; the memo restarts beyond it.
MEMO_WORDS = 1_000_000


def words(text: str | None) -> list[str]:
    """Lower-cased runs of word characters of the whole text (null gives none)."""
    return _find_words(text.lower()) if text else []


class WordHash(dict):
    """word -> 64-bit hash, memoised; used through ``hash_words``."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = value
        return value


def hash_words(tokens: list[str], memo: WordHash) -> np.ndarray:
    if len(memo) > MEMO_WORDS:
        memo.clear()
    return np.fromiter(map(memo.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


#: Code points from here on are letters (rare Han) but for tags and selectors.
_TABLE = 0x20000
#: Tokens up to this many characters are hashed all at once, longer ones singly.
_LONG_TOKEN = 1024
#: Longer texts are hashed in pieces, cut at white space.
_PIECE = 1 << 21
_SPACE = re.compile(r"\s")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point of every word character, 0 of others; powers of the hash."""
    marks = re.compile(f"[{combining_marks()}]")
    low = np.zeros(_TABLE + 1, np.uint32)
    for k in range(_TABLE):
        c = chr(k)
        if c.isalnum() or c == "_" or k >= 0x300 and marks.match(c):
            low[k] = ord(x) if len(x := c.lower()) == 1 else k
    powers = np.full(_LONG_TOKEN, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    return low, np.multiply.accumulate(powers)


def _hash_piece(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every token, in characters."""
    table, powers = _tables()
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) and cp.max() >= _TABLE:
        low = table[np.minimum(cp, _TABLE)]
        low = np.where((cp >= _TABLE) & (cp < 0xE0000), cp, low)
    else:
        low = table[cp]
    word = low != 0
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    length = ends - starts
    kept = low[word].astype(np.uint64)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(kept)) - np.repeat(first, length)
    out = np.add.reduceat(kept * powers[np.minimum(place, _LONG_TOKEN - 1)], first)
    out = mix64(out + length.astype(np.uint64))
    for k in np.flatnonzero(length > _LONG_TOKEN):
        out[k] = xxhash.xxh3_64_intdigest(low[starts[k] : ends[k]].tobytes())
    return starts, out


def hash_texts(texts: list[str | None]) -> list[np.ndarray]:
    """The token hashes of every text, as of the words that ``words`` finds.

    All texts of the list are hashed in one go (lower case is taken code point by
    code point), which is some ten times as fast as word by word.
    """
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    held, size = [], 0
    for k, t in enumerate(texts):
        if not t:
            continue
        if len(t) > _PIECE:
            parts, at = [], 0
            while at < len(t):
                cut = _SPACE.search(t, at + _PIECE)
                end = cut.end() if cut else len(t)
                parts.append(_hash_piece(t[at:end])[1])
                at = end
            out[k] = np.concatenate(parts)
            continue
        held.append(k)
        size += len(t)
        if size > _PIECE:
            _hash_held(texts, held, out)
            held, size = [], 0
    _hash_held(texts, held, out)
    return out


def _hash_held(texts: list[str | None], held: list[int], out: list[np.ndarray]) -> None:
    if not held:
        return
    starts, hashes = _hash_piece("\n".join(texts[k] for k in held))
    ends = np.cumsum([len(texts[k]) + 1 for k in held])
    for k, part in zip(held, np.split(hashes, np.searchsorted(starts, ends[:-1]))):
        out[k] = part


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of uint64 values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=32)
def odd_multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of every text."""
    return [distinct(shingle_hashes(h, width)) for h in hash_texts(texts)]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted different values; ``x`` is sorted in place."""
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_hashes(token_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` tokens; one for the whole when shorter."""
    n = len(token_hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(width, n)
    mults = odd_multipliers(width, 5)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += token_hashes[j : n - k + 1 + j] * mults[j]
    return mix64(out)


def byte_slices(batch: pa.RecordBatch, column: str, target: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into consecutive slices of about ``target`` bytes of ``column``.

    A single row above the target is a slice of its own, so no slice holds more
    than the target plus one row.
    """
    n = batch.num_rows
    if n == 0:
        return
    arr = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + target, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for intermediate tables under ``spark.checkpoint.dir``.

    Where that setting is absent, a local master (tests, a laptop) gets a temporary
    folder; on a cluster no folder is known that all machines share: an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="gleanery-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, *spent: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there.

    Written files survive the loss of any executor, unlike cached blocks.  Tables
    made before that nothing needs any more once this one is written (``spent``)
    are deleted.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    drop_tables(spark, *spent)
    return out


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that ``materialise`` has returned; other frames are left alone."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f._written_to for f in frames if "_written_to" in vars(f)}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column has them in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(column: str = "text") -> F.Column:
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("bigint")
