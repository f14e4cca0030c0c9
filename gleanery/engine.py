"""Entry points: scan, analyse, and the registry of analysers."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import api, code, detect, network
from .operators.python_ast import inspect
from .plans import catalog
from .sources import files

log = logging.getLogger(__name__)
Transform = Callable[[DataFrame], DataFrame]
RUNTIME_ERRORS = "runtime_errors"


@dataclass(frozen=True)
class Analyzer:
    """Finds things in documents (path, text, file_type).

    ``entries`` gives an array of findings (category, value) as an expression over
    the columns ``path``, ``text``, ``lowered`` and ``file_type``: all such analysers
    share one scan.  ``transform`` takes documents to findings (id, category, value)
    and has a scan of its own.
    """

    name: str
    transform: Transform | None = None
    accepts: Callable[[], Column] = field(default=lambda: F.lit(True))
    entries: Callable[[], Column] | None = None


class Registry:
    """Analysers by name; each sees only the documents that it accepts.

    Analysers don't depend on each other's order.  One that can't be built, or whose
    plan is invalid, gives a finding ``runtime_errors`` with a null id in place of its
    own, and the others go on.
    """

    def __init__(self, analyzers: Sequence[Analyzer] = ()) -> None:
        self._held: dict[str, Analyzer] = {}
        for a in analyzers:
            self.register(a)

    def register(self, analyzer: Analyzer) -> None:
        if analyzer.name in self._held:
            raise ValueError(f"{analyzer.name} is registered already")
        self._held[analyzer.name] = analyzer

    def unregister(self, name: str) -> None:
        del self._held[name]

    def names(self) -> list[str]:
        return sorted(self._held)

    def run(self, docs: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """Findings of the analysers named, by default all; distinct within a document."""
        chosen = [self._held[n] for n in (self._held if names is None else names)]
        spark, kind = docs.sparkSession, docs.schema["path"].dataType.simpleString()
        held = docs.where("text is not null").select("path", "text", "file_type").withColumns(detect.asked())
        arrays, parts, failed = [], [], []
        for a in chosen:
            try:
                if a.entries is not None:
                    found = F.when(F.coalesce(a.accepts(), F.lit(False)), a.entries().cast(detect.FINDINGS))
                    held.select(found)  # an invalid plan fails here, alone
                    arrays.append(F.coalesce(found, detect.no_findings()))
                else:
                    parts.append(a.transform(docs.where(a.accepts())).select(F.col("id").cast(kind).alias("id"), "category", "value"))
            except Exception as e:
                log.exception("analyser %s", a.name)
                failed.append((None, RUNTIME_ERRORS, f"{a.name}: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
        if arrays:
            found = T.distinct(F.flatten(F.array(*arrays)))
            rows = held.select(F.col("path").alias("id"), found.alias("__rows"))
            parts.insert(0, rows.select("id", F.inline_outer("__rows")).where("category is not null"))
        if failed or not parts:
            parts.append(spark.createDataFrame(failed, f"id {kind}, category string, value string"))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out


def python_entries(name: str, find: Callable[[str], Sequence[tuple[str, str]]], accepts: Callable[[], Column]) -> Callable[[], Column]:
    """Entries of an analyser in Python: text to (category, value) pairs, in Arrow batches.

    A text that it fails on has the error as its finding.
    """

    def of(text: str | None) -> list[dict[str, str]]:
        if text is None:
            return []
        try:
            return [{"category": c, "value": v} for c, v in find(text)]
        except Exception as e:
            return [{"category": RUNTIME_ERRORS, "value": f"{name}: {type(e).__name__}: {e}"}]

    @F.pandas_udf(detect.FINDINGS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    # Other documents travel as nulls: a condition round the call wouldn't keep them here.
    return lambda: run(F.when(accepts(), F.col("text")))


def _ends(*suffixes: str) -> Callable[[], Column]:
    return lambda: F.lower("path").rlike(r"\.(?:" + "|".join(suffixes) + ")$")


def _tree(text: str) -> list[tuple[str, str]]:
    return [(category, f"{rule} (line {line}): {detail}") for category, rule, line, detail in inspect(text)]


#: Beside all that is typed as text, the network and API analysers read files of these names.
API_SUFFIXES = tuple("html java js json log md php py ts txt xml yaml yml".split())
NETWORK_SUFFIXES = (*API_SUFFIXES, *"bash conf ini sh".split())


def default_registry() -> Registry:
    """All analysers that come with the engine: expressions of one scan."""
    texts = lambda: ~F.col("file_type").isin("executable", "image", "archive", "binary")
    text_or = lambda suffixes: lambda: (F.col("file_type") == "text") | _ends(*suffixes)()
    on_network, on_api = text_or(NETWORK_SUFFIXES), text_or(API_SUFFIXES)
    script = lambda: code.looks_like_script(F.col("text"), F.col("path"))
    python = _ends("py", "pyw")

    def entropy() -> Column:
        show = lambda f: F.concat(f["value"], F.format_string(" (Entropy: %.2f)", f["entropy"]))
        return F.transform(detect.entropy_rows(), lambda f: detect.finding("high_entropy_strings", show(f)))

    def comments() -> Column:
        return F.transform(code.comment_lines(), lambda n: detect.finding("commented_code", F.concat(F.lit("Commented code at line "), n.cast("string"))))

    def shapes() -> Column:
        show = lambda f: F.concat_ws(" ", F.lit("line"), f["line"].cast("string"), f["rule"], f["amount"].cast("string"))
        return F.transform(code.complexity_rows(), lambda f: detect.finding("code_complexity", show(f)))

    def packages() -> Column:
        show = lambda f: F.concat(f["package"], F.lit(" "), f["version"], F.when(f["loose"], F.lit(" (loose)")).otherwise(""))
        return F.transform(code.package_rows(), lambda f: detect.finding("dependency", show(f)))

    listed = (
        ("core", lambda: detect.found(catalog.CORE), lambda: F.lit(True)),
        ("entropy", entropy, texts),
        ("network", network.entries, on_network),
        ("script_network", network.script_entries, script),
        ("api_styles", lambda: detect.present_entries(api.STYLES, "api_framework"), on_api),
        ("json_samples", detect.json_entries, on_api),
        ("python_rules", lambda: detect.smell_entries(catalog.PYTHON), python),
        ("python_tree", python_entries("python_tree", _tree, python), python),
        ("java_rules", lambda: detect.smell_entries(catalog.JAVA), _ends("java")),
        ("script_rules", lambda: detect.smell_entries(catalog.SCRIPT_RULES, around=None), script),
        ("frameworks", lambda: detect.present_entries(catalog.FRAMEWORKS, "api_framework", "JavaScript framework: "), script),
        ("comments", comments, script),
        ("complexity", shapes, script),
        ("clients", code.client_entries, script),
        ("software", lambda: detect.found(catalog.SOFTWARE, {}), texts),
        ("packages", packages, _ends("json")),
        ("package_labels", code.label_entries, lambda: F.col("path").endswith("package.json")),
    )
    return Registry([Analyzer(name, entries=entries, accepts=accepts) for name, entries, accepts in listed])


def scan(spark: SparkSession, paths: Sequence[str] = (), folder: str | None = None, **limits) -> DataFrame:
    """Decoded documents of paths and a folder."""
    return files.read_documents(spark, paths, folder, **limits)


def analyse(docs: DataFrame, registry: Registry | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Findings (id, category, value) of documents (path, text, file_type)."""
    return (registry or default_registry()).run(docs, names)


def analyse_files(spark: SparkSession, paths: Sequence[str] = (), folder: str | None = None, **limits) -> DataFrame:
    return analyse(scan(spark, paths, folder, **limits))


class Stopwatch:
    """Seconds since it was made, logged when it is left."""

    def __init__(self, what: str) -> None:
        self.what, self.began = what, time.monotonic()

    @property
    def seconds(self) -> float:
        return time.monotonic() - self.began

    def __enter__(self) -> Stopwatch:
        return self

    def __exit__(self, *_: object) -> None:
        log.info("%s took %.2f seconds", self.what, self.seconds)
