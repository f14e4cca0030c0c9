"""Report sinks: distributed JSON and CSV, and rendered console and HTML reports.

Files are written by Spark.  Console and HTML show ``shown`` values a category
and the full counts, so what reaches the driver doesn't grow with the data.
"""

from __future__ import annotations

import html
import json
import logging
from datetime import datetime, timezone
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rollup as R
from ..plans.catalog import CONSOLE_GROUPS, DISPLAY_GROUPS

MASKED = ("api_key", "password", "access_token", "refresh_token", "oauth_token", "aws_key", "credit_card", "social_security")


def report_rows(findings: DataFrame) -> DataFrame:
    """(category, type, value, severity), sorted, distinct over all sources."""
    rows = R.with_severity(findings.select("category", "value").distinct())
    return rows.select(T.label(F.col("category")).alias("category"), F.col("category").alias("type"), "value", "severity").orderBy("type", "value")


def write_csv(findings: DataFrame, path: str, with_severity: bool = True) -> None:
    rows = report_rows(findings)
    if not with_severity:
        rows = rows.select("category", F.col("value").alias("finding"))
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def as_json(findings: DataFrame) -> DataFrame:
    """(id, json): an object a source, categories and values sorted."""
    lists = findings.groupBy("id", "category").agg(F.array_sort(F.collect_set("value")).alias("vs"))
    entry = F.struct(F.col("category").alias("key"), F.col("vs").alias("value"))
    grouped = lists.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    return grouped.select("id", F.to_json("m").alias("json"))


def write_json(findings: DataFrame, path: str, partition_by_source: bool = False) -> None:
    """One line of JSON a source; with ``partition_by_source`` a folder each."""
    rows = as_json(findings).select("id", F.from_json("json", "map<string,array<string>>").alias("findings"))
    made = F.struct(F.lit(datetime.now(timezone.utc).isoformat(timespec="seconds")).alias("timestamp"))
    writer = rows.withColumn("_metadata", made).write.mode("overwrite")
    (writer.partitionBy("id") if partition_by_source else writer).json(path)


def output_name(path: str, several: bool, suffix: str) -> str:
    """Name of a source's report; a hash keeps equal stems apart."""
    import xxhash

    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return f"{stem}_analysis_{xxhash.xxh32_hexdigest(path)}{suffix}" if several else stem + suffix


def masked(value: str) -> str:
    return value if len(value) <= 8 else value[:4] + "*" * (len(value) - 8) + value[-4:]


def titled(category: str) -> str:
    return " ".join(w.capitalize() for w in category.split("_"))


def sample(findings: DataFrame, shown: int) -> list:
    """Rows (category, n, value) of the first ``shown`` values by length and text of each category."""
    distinct = findings.select("category", "value").distinct()
    w = Window.partitionBy("category").orderBy(F.length("value"), "value")
    ranked = distinct.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= shown)
    counts = distinct.groupBy("category").agg(F.count("*").alias("n"))
    return ranked.join(F.broadcast(counts), "category").orderBy("category", "rank").select("category", "n", "value").collect()


def _grouped(rows: list, groups: dict[str, str]) -> list[tuple[str, list[tuple[str, int, list[str]]]]]:
    held: dict[str, tuple[int, list[str]]] = {}
    for r in rows:
        held.setdefault(r["category"], (r["n"], []))[1].append(r["value"])
    out, used = [], set()
    for group, names in groups.items():
        members = [(c, *held[c]) for c in names.split() if c in held]
        used |= {c for c, *_ in members}
        if members:
            out.append((group, members))
    rest = [(c, *held[c]) for c in sorted(held.keys() - used)]
    return [*out, ("Other", rest)] if rest else out


def console(
    findings: DataFrame, *, shown: int = 20, markdown: bool = False, summary_only: bool = False, mask: bool = True, groups: dict[str, str] = CONSOLE_GROUPS
) -> str:
    """The report as text: groups, categories with counts, values."""
    rows = sample(findings, shown)
    total = sum({r["category"]: r["n"] for r in rows if r["category"] not in R.NOT_COUNTED}.values())
    lines = ["```"] if markdown else []
    if not summary_only:
        for group, members in _grouped(rows, groups):
            lines.append(f"== {group} ==")
            for category, n, values in members:
                lines.append(f"  {titled(category)} ({n}):")
                hide = mask and category in MASKED
                lines += [f"    - {masked(v) if hide else v}" for v in values]
                if n > len(values):
                    lines.append(f"    ... and {n - len(values)} more")
    lines.append(f"Total findings: {total}")
    return "\n".join(lines + (["```"] if markdown else []))


def page(
    findings: DataFrame, *, shown: int = 200, mask: bool = True, analysed: int | None = None, seconds: float | None = None, title: str = "Findings"
) -> str:
    """The report as one HTML page; everything from the data is escaped.

    Metadata and errors have sections of their own, endpoints with what stands near
    them come under API, and a head tells what was analysed, when and how long.
    """
    rows, e = sample(findings, shown), html.escape
    level = {c: k for k, names in R.SEVERITY_PAGE.items() for c in names.split()}
    counted = sum({r["category"]: r["n"] for r in rows if r["category"] not in R.NOT_COUNTED}.values())
    facts = {"Generated": datetime.now(timezone.utc).isoformat(timespec="seconds"), "Total findings": counted}
    if analysed is not None:
        facts["Sources analysed"] = analysed
    if seconds is not None:
        facts["Seconds"] = f"{seconds:.2f}"
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1><dl>"]
    parts += [f"<dt>{e(k)}</dt><dd>{e(str(v))}</dd>" for k, v in facts.items()]
    parts.append("</dl>")

    def section(name: str, members: list[tuple[str, int, list[str]]], kind: str = "") -> None:
        parts.append(f"<details open class='{kind}'><summary>{e(name)}</summary>")
        for category, n, values in members:
            hide = mask and category in MASKED
            items = "".join(f"<li>{e(masked(v) if hide else v)}</li>" for v in values)
            parts.append(f"<h3 class='{level.get(category, 'normal')}'>{e(titled(category))} ({n})</h3><ul>{items}</ul>")
        parts.append("</details>")

    held = {c: (c, n, v) for _, members in _grouped(rows, {}) for c, n, v in members}
    apart = [("Metadata", "file_metadata", "metadata"), ("Errors", "runtime_errors", "errors")]
    for name, category, kind in apart:
        if category in held:
            section(name, [held[category]], kind)
    for group, members in _grouped([r for r in rows if r["category"] not in R.NOT_COUNTED], DISPLAY_GROUPS):
        section(group, members, "api" if group.startswith("API") else "")
    return "".join(parts) + "</body></html>"


def write_text(text: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def to_plain_json(findings: DataFrame) -> str:
    """A report as one indented object, values in full: for results that fit the driver.

    Larger ones go through ``write_json``.
    """
    grouped = findings.groupBy("category").agg(F.array_sort(F.collect_set("value")).alias("vs")).orderBy("category")
    return json.dumps({r["category"]: list(r["vs"]) for r in grouped.toLocalIterator()}, indent=2, ensure_ascii=False)


def log_to(path: str | None, level: str = "INFO", max_bytes: int = 10 << 20, kept: int = 5) -> None:
    """Messages of the package to a file that rotates at ``max_bytes``, and to standard error."""
    root = logging.getLogger("gleanery")
    root.setLevel(level)
    for old in list(root.handlers):
        root.removeHandler(old)
        old.close()
    targets: list[logging.Handler] = [logging.StreamHandler()]
    if path is not None:
        targets.append(RotatingFileHandler(path, maxBytes=max_bytes, backupCount=kept, encoding="utf-8"))
    for t in targets:
        t.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        root.addHandler(t)
