"""Token counts: exact BPE lengths, computed in Arrow batches.

Only lengths leave Python, never the ids.  Arrow batches are cut into slices of
about equal bytes, so a slice of long documents holds few rows and a slice of
short ones many; each slice is encoded by one batch call.  A text above ``piece_chars``
is encoded in pieces cut where the tokenizer's pre-splitting pattern always has a
border, which keeps the summed length exactly that of the whole text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import byte_slices

TOKENIZER_DIR = os.environ.get("GLEANERY_TOKENIZERS", "/opt/tokenizers")
#: The public byte-level pre-splitting pattern that these ranks were made with.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Places that are a border whatever stands round them: letters and digits end before
#: punctuation and white space, and before each other (told apart in ASCII alone).
_BORDER = re.compile(
    r"(?<=[^\W_])(?=[\x00-/:-@\[-`{-\x7f\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
)


def safe_pieces(text: str, piece_chars: int) -> Iterator[str]:
    """Consecutive pieces of ``text``, cut only where the pattern always has a border.

    No alternative of the pattern spans a letter or digit and what ``_BORDER`` asks
    to follow it, and a run that ends there ends alike where the text does.  Only
    within one unbroken run of letters, of digits, of other signs or of blanks is
    there no such place: it stays whole, since its tokens depend on all of it.
    """
    start, n = 0, len(text)
    while n - start > piece_chars:
        found = _BORDER.search(text, start + piece_chars)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def count_tokens(enc, texts: list[str | None], piece_chars: int) -> np.ndarray:
    """Token count of every text; all pieces of all texts are encoded in one batch."""
    pieces, owner = [], []
    for k, text in enumerate(texts):
        for p in safe_pieces(text or "", piece_chars):
            pieces.append(p)
            owner.append(k)
    lengths = np.fromiter(map(len, enc.encode_ordinary_batch(pieces, num_threads=1)), np.int64, len(pieces))
    return np.bincount(owner, lengths, len(texts)).astype(np.int64)


def token_counts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken",
    batch_bytes: int = 1 << 20,
    piece_chars: int = 1 << 16,
) -> DataFrame:
    """(id, n_tokens, n_bytes, n_chars) for every row, repeated rows included.

    Null and empty texts count 0 tokens; a null id is passed through; texts of any
    length are counted whole; an empty table stays empty.  Other columns are not
    read.  ``vocabulary`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for whole in batches:
            for part in byte_slices(whole, "text", batch_bytes):
                lengths = count_tokens(enc, part.column(1).to_pylist(), piece_chars)
                n_bytes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                n_chars = pc.fill_null(pc.utf8_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lengths), n_bytes, n_chars], ["id", "n_tokens", "n_bytes", "n_chars"]
                )

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, n_tokens bigint, n_bytes bigint, n_chars bigint")
    return out.withColumnRenamed("id", id_col)
