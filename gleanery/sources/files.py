"""File source: paths or a folder as rows of text, through Spark's own file sources."""

from __future__ import annotations

import json
import logging
import os
import stat
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

log = logging.getLogger(__name__)
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def glob_regex(glob: str) -> str:
    """A glob as an expression for the end of a path; ``*`` and ``?`` stay within a name."""
    parts = {"*": "[^/]*", "?": "[^/]"}
    return "(?:^|/)" + "".join(parts.get(c, T_ESCAPE.get(c, c)) for c in glob) + "$"


T_ESCAPE = {c: "\\" + c for c in r".\+()[]{}|^$"}


def any_glob(path: Column, globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def select_files(
    files: DataFrame,
    *,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    max_mb: float | None = 50.0,
    max_files: int | None = None,
) -> DataFrame:
    """Files that fit: named by a glob of ``include``, by none of ``exclude``, not too large.

    ``max_files`` keeps the first by path.  The size limit reaches the scan as a
    pushed filter, so larger files aren't opened.
    """
    out = files
    if max_mb is not None:
        out = out.where(F.col("length") <= int(max_mb * 1024 * 1024))
    if include:
        out = out.where(any_glob(F.col("path"), include))
    if exclude:
        out = out.where(~any_glob(F.col("path"), exclude))
    return out if max_files is None else out.orderBy("path").limit(max_files)


def list_files(spark: SparkSession, paths: Sequence[str] = (), folder: str | None = None, **limits) -> DataFrame:
    """(path, modificationTime, length, content) of explicit paths and of all below a folder.

    Explicit local paths that don't exist or aren't files are left out with a
    message; globs and counts apply to the folder alone, the size to both.
    """
    parts = []
    kept = []
    for p in paths:
        if "://" in p or os.path.isfile(p):
            kept.append(p)
        else:
            log.warning("no such file: %s", p)
    if kept:
        parts.append(select_files(spark.read.format("binaryFile").load(kept), max_mb=limits.get("max_mb", 50.0)))
    if folder is not None:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        parts.append(select_files(found, **limits))
    if not parts:
        return spark.createDataFrame([], FILE_SCHEMA)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["path"]) if len(parts) > 1 else out


def decode(files: DataFrame) -> DataFrame:
    """(path, text, is_binary, file_type, length, modificationTime).

    Bytes that aren't UTF-8 become U+FFFD, unless a magic number says that the
    file is binary: its text is then its hex digits.  Valid JSON in ``.json``
    files is written anew, compact with sorted keys.
    """
    raw = F.col("content")
    valid = F.is_valid_utf8(raw.cast("string"))
    marked = ~valid & T.type_by_magic(raw).isNotNull()
    loose = F.make_valid_utf8(raw.cast("string"))
    text = F.when(marked, F.lower(F.hex(raw))).otherwise(loose)
    text = F.when(F.lower("path").endswith(".json"), T.canonical_json(text)).otherwise(text)
    return files.select(
        "path",
        text.alias("text"),
        (~valid | T.looks_binary(loose)).alias("is_binary"),
        T.file_type(F.col("path"), raw, loose).alias("file_type"),
        "length",
        "modificationTime",
    )


def read_documents(spark: SparkSession, paths: Sequence[str] = (), folder: str | None = None, **limits) -> DataFrame:
    return decode(list_files(spark, paths, folder, **limits))


def metadata(files: DataFrame) -> DataFrame:
    """(id, category, value): name, size and modification time; the content isn't read."""
    name = F.element_at(F.split("path", "/"), -1)
    items = F.array(
        F.concat(F.lit("name: "), name),
        F.concat(F.lit("size: "), F.col("length").cast("string")),
        F.concat(F.lit("modified: "), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss")),
    )
    return files.select(F.col("path").alias("id"), F.lit("file_metadata").alias("category"), F.explode(items).alias("value"))


def local_stat(files: DataFrame) -> DataFrame:
    """(path, mode, uid, gid, accessed, created) by ``stat``; nulls where a file isn't local."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p in f["path"]:
                try:
                    s = os.stat(p.removeprefix("file:"))
                    when = [datetime.fromtimestamp(t, timezone.utc).isoformat() for t in (s.st_atime, s.st_ctime)]
                    rows.append((p, oct(stat.S_IMODE(s.st_mode)), s.st_uid, s.st_gid, *when))
                except OSError:
                    rows.append((p, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "mode", "uid", "gid", "accessed", "created"])

    return files.select("path").mapInPandas(run, "path string, mode string, uid long, gid long, accessed string, created string")


def split_metadata(value: Column) -> Column:
    """``key: value`` as a struct, split at the first colon."""
    parts = F.split(value, ":", 2)
    return F.struct(F.trim(parts[0]).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("value"))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a temporary one under a local master alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="gleanery-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def read_config(path: str | None) -> dict:
    """Options of a JSON file; empty with a message where it is missing or broken."""
    if path is None:
        return {}
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError) as e:
        log.error("configuration %s: %s", path, e)
        return {}
