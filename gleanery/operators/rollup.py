"""Aggregations over findings: counts, groups, severities, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import DISPLAY_GROUPS, SEVERITY_PAGE, SEVERITY_TABLE

NOT_COUNTED = ("file_metadata", "runtime_errors")


def lookup(findings: DataFrame, table: dict[str, str], name: str) -> DataFrame:
    """(category, name) of a fixed table of categories by their group.

    It is written into the plan as constants, so broadcasting it costs the same
    whatever the size of the data.
    """
    rows = [(c, group) for group, categories in table.items() for c in categories.split()]
    return F.broadcast(findings.sparkSession.createDataFrame(rows, f"category string, {name} string"))


def per_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("findings"))


def totals(findings: DataFrame, analysed: DataFrame | None = None) -> DataFrame:
    """One row: all findings, those without metadata and errors, categories, sources with findings.

    With the documents ``analysed`` their number comes too, whether anything was found
    in them or not.
    """
    counted = ~F.col("category").isin(*NOT_COUNTED)
    parts = [
        F.count("category").alias("all_findings"),
        F.count_if(counted).alias("findings"),
        F.count_distinct("category").alias("categories"),
        F.count_distinct("id").alias("sources"),
    ]
    if analysed is None:
        return findings.agg(*parts)
    both = findings.select("id", "category", F.lit(0).alias("doc")).unionByName(analysed.select(F.lit(1).alias("doc")), allowMissingColumns=True)
    return both.agg(*parts, F.sum("doc").alias("analysed"))


def by_severity(findings: DataFrame) -> DataFrame:
    """(severity, category, findings) with all subtotals; null marks a total."""
    counts = with_severity(per_category(findings))
    return counts.cube("severity", "category").agg(F.sum("findings").alias("findings"))


def ranked(findings: DataFrame) -> DataFrame:
    """(severity, category, findings, rank, share, before): categories within their severity.

    ``share`` is the running share of the severity's findings, ``before`` the count of
    the category ahead.  Only counts, a row a category, are ordered.
    """
    counts = with_severity(per_category(findings))
    order = Window.partitionBy("severity").orderBy(F.desc("findings"), "category")
    sums = order.rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        "severity", "category", "findings",
        F.rank().over(Window.partitionBy("severity").orderBy(F.desc("findings"))).alias("rank"),
        F.round(F.sum("findings").over(sums) / F.sum("findings").over(Window.partitionBy("severity")), 6).alias("share"),
        F.lag("findings").over(order).alias("before"),
    )


def without_findings(docs: DataFrame, findings: DataFrame, id_col: str = "id") -> DataFrame:
    """The documents in which nothing was found."""
    return docs.join(findings.select(F.col("id").alias("__found")).distinct(), docs[id_col] == F.col("__found"), "left_anti")


def with_finding(docs: DataFrame, findings: DataFrame, category: str, id_col: str = "id") -> DataFrame:
    """The documents in which something of the category was found."""
    kept = findings.where(F.col("category") == category).select(F.col("id").alias("__found")).distinct()
    return docs.join(kept, docs[id_col] == F.col("__found"), "left_semi")


def value_spread(findings: DataFrame) -> DataFrame:
    """(category, values, about): different values of a category, exact and by HyperLogLog.

    Values are made distinct first: beside a distinct count in one aggregation every
    different value would have a sketch of its own, of some 3 KB.
    """
    different = findings.select("category", "value").distinct()
    return different.groupBy("category").agg(F.count("value").alias("values"), F.approx_count_distinct("value", 0.02).alias("about"))


def top_categories(findings: DataFrame, n: int = 10) -> DataFrame:
    """The n largest categories; equal counts go by name."""
    return per_category(findings).orderBy(F.desc("findings"), "category").limit(n)


def by_group(findings: DataFrame, table: dict[str, str] = DISPLAY_GROUPS) -> DataFrame:
    """(display_group, category, findings) with subtotals; null marks a total.

    Counts are made before the groups are joined, so a few rows a category meet
    the constants.  A category in two groups counts in both.
    """
    counts = per_category(findings)
    named = counts.join(lookup(findings, table, "display_group"), "category")
    return named.rollup("display_group", "category").agg(F.sum("findings").alias("findings"))


def with_severity(findings: DataFrame, table: dict[str, str] = SEVERITY_TABLE, other: str = "Low") -> DataFrame:
    level = F.lit(other)
    for name, categories in table.items():
        level = F.when(F.col("category").isin(*categories.split()), F.lit(name)).otherwise(level)
    return findings.withColumn("severity", level)


def with_page_severity(findings: DataFrame) -> DataFrame:
    return with_severity(findings, SEVERITY_PAGE, "normal")


def sorted_values(findings: DataFrame, by_length: bool = True) -> DataFrame:
    """(id, category, values): by length and then text, or by text alone."""
    values = F.array_sort(F.collect_set("value"))
    if by_length:
        values = F.transform(
            F.array_sort(F.transform(F.collect_set("value"), lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))), lambda s: s["v"]
        )
    return findings.groupBy("id", "category").agg(values.alias("values"))


def dense(findings: DataFrame, categories: list[str]) -> DataFrame:
    """Counts for all the categories given, 0 where nothing was found."""
    names = findings.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return F.broadcast(names).join(per_category(findings), "category", "left").fillna(0, ["findings"])
