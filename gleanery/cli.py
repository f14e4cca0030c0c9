"""Command line: ``python -m gleanery.cli PATH... --dir DIR --json OUT``.

Exit codes: 0 done, 1 nothing to analyse or a failure, 130 interrupted.
"""

from __future__ import annotations

import argparse
import importlib.util
import logging
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import engine
from .operators import rollup
from .sources import files, sinks

log = logging.getLogger(__name__)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleanery", description="Find what texts should not hold, or what they tell.")
    add = p.add_argument
    add("paths", nargs="*", help="files")
    add("--dir", help="a folder, with all below it")
    add("--include", action="append", default=[], metavar="GLOB", help="names to take; may be repeated")
    add("--exclude", action="append", default=[], metavar="GLOB", help="names to leave out; wins over --include")
    add("--max-size", type=float, default=50.0, metavar="MB", help="larger files are left out")
    add("--max-files", type=int, default=1000, help="the first so many of the folder, by path")
    add("--json", metavar="FOLDER", help="write JSON, a line a source")
    add("--csv", metavar="FOLDER", help="write CSV with severities")
    add("--html", metavar="FILE", help="write a page")
    add("--output-dir", metavar="FOLDER", help="where relative outputs go")
    add("--md", action="store_true", help="console output as Markdown")
    add("--quiet", action="store_true", help="no console output")
    add("--summary-only", action="store_true", help="counts alone on the console")
    add("--analyzers", metavar="A,B", help="only these analysers")
    add("--plugin-dir", action="append", default=[], metavar="FOLDER", help="modules with register(registry)")
    add("--config", metavar="FILE", help="JSON with defaults of these options")
    add("--log-file", metavar="FILE", help="messages, in a file that rotates")
    add("--log-level", default="INFO", choices=("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"))
    add("--version", action="store_true")
    return p


def options(argv: list[str] | None = None) -> argparse.Namespace:
    """Arguments over the configuration's values over defaults."""
    p = parser()
    first = p.parse_args(argv)
    if first.config:
        known = {a.dest for a in p._actions}
        p.set_defaults(**{k.replace("-", "_"): v for k, v in files.read_config(first.config).items() if k.replace("-", "_") in known})
        first = p.parse_args(argv)
    return first


def registry(folders: list[str]) -> engine.Registry:
    """The engine's analysers and those that modules of the folders register.

    A module that fails is left out with a message.
    """
    out = engine.default_registry()
    for folder in folders:
        for path in sorted(Path(folder).glob("*.py")):
            try:
                spec = importlib.util.spec_from_file_location(f"gleanery_plugin_{path.stem}", path)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
                module.register(out)
            except Exception:
                log.exception("plug-in %s", path)
    return out


def session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName("gleanery").config("spark.ui.showConsoleProgress", "false")
    return builder.getOrCreate()


def run(o: argparse.Namespace) -> int:
    if o.version:
        print("gleanery 0.2")
        return 0
    sinks.log_to(o.log_file, o.log_level)
    with engine.Stopwatch("analysis") as watch:
        spark = session()
        docs = engine.scan(spark, o.paths, o.dir, include=o.include, exclude=o.exclude, max_mb=o.max_size, max_files=o.max_files)
        if docs.limit(1).count() == 0:
            print("No files were given or found.", file=sys.stderr)
            return 1
        # Every sink reads the findings: they are made once.
        found = engine.analyse(docs, registry(o.plugin_dir), o.analyzers.split(",") if o.analyzers else None).persist()
        try:
            at = lambda name: os.path.join(o.output_dir, name) if o.output_dir else name
            if o.output_dir:
                os.makedirs(o.output_dir, exist_ok=True)
            n = docs.select("path").count()
            if o.json:
                sinks.write_json(found, at(o.json))
            if o.csv:
                sinks.write_csv(found, at(o.csv))
            if o.html:
                sinks.write_text(sinks.page(found, analysed=n, seconds=watch.seconds), at(o.html))
            if not o.quiet:
                print(sinks.console(found, markdown=o.md, summary_only=o.summary_only))
                print(f"Files analysed: {rollup.totals(found, docs).first()['analysed']}\nSeconds: {watch.seconds:.2f}")
        finally:
            found.unpersist()
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(options(argv))
    except KeyboardInterrupt:
        print("Interrupted.", file=sys.stderr)
        return 130
    except Exception as e:
        log.exception("failed")
        print(f"Failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
