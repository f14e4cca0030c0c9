"""The scan: every detector over every text, in one pass of the source.

All detectors of a scan are entries of one array expression, so the source is
read once whatever their number.  A detector's expression runs only where one of
its literals occurs in the lower-cased text.  Matches are made distinct within
the row before anything is shuffled; findings are then rows of
(id, category, value).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.catalog import CORE, GATES, JSON_STATUS, Detector

Check = Callable[[Column], Column]
#: Core categories whose matches are checked before they count.
CHECKS: dict[str, Check] = {"ipv4": T.ipv4_valid, "base64_encoded": T.base64_strict}


def wanted(d: Detector, lowered: Column) -> Column | None:
    """Whether a literal that the detector needs occurs at all."""
    if not d.needs:
        return None
    return reduce(Column.__or__, [lowered.contains(n) for n in d.needs])


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) and what detectors ask of a text before they look, without null texts."""
    held = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null")
    return held.withColumns(asked())


def asked() -> dict[str, Column]:
    """The text in lower case, and the gates that it passes: made once for all detectors."""
    return {"lowered": F.lower("text")} | {name: F.col("text").rlike(f"(?U){regex}") for name, regex in GATES.items()}


def may_match(d: Detector) -> Column | None:
    """Whether the prepared text passes the detector's gate and holds a literal that it needs."""
    parts = [F.col(d.gate)] if d.gate else []
    needed = wanted(d, F.col("lowered"))
    parts += [] if needed is None else [needed]
    return reduce(Column.__and__, parts) if parts else None


def each(docs: DataFrame, rows: Column, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fields...) of an array of structs over the prepared text; ``key`` is a field that is never null.

    The array is a column before it is taken apart: inside the generator it would be
    computed uncompiled, and by ``explode`` a second time in an inferred filter.
    """
    held = prepared(docs, id_col, text_col).select("id", rows.alias("__rows"))
    return held.select("id", F.inline_outer("__rows")).where(F.col(key).isNotNull())


def matches(d: Detector, check: Check | None = None) -> Column:
    """Distinct matches in the prepared text, checked; empty where none can be."""
    found = T.extract(F.col("text"), d.java, d.group)
    if check is not None:
        found = F.filter(found, lambda v: check(v))
    needed = may_match(d)
    return found if needed is None else F.when(needed, found).otherwise(F.array().cast("array<string>"))


def tagged(found: Column, **fields: str) -> Column:
    """Entries of an array as structs of constant fields and the entry, ``value``."""
    return F.transform(found, lambda v: F.struct(*(F.lit(x).alias(n) for n, x in fields.items()), v.alias("value")))


FINDINGS = "array<struct<category:string,value:string>>"


def no_findings() -> Column:
    return F.array().cast(FINDINGS)


def finding(category: str, value: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), value.alias("value"))


def found(detectors: Sequence[Detector], checks: dict[str, Check] | None = None) -> Column:
    """Findings of the prepared text as an array, distinct for each detector."""
    checks = CHECKS if checks is None else checks
    return F.flatten(F.array(*(tagged(matches(d, checks.get(d.name)), category=d.name) for d in detectors)))


def detect(
    docs: DataFrame,
    detectors: Sequence[Detector] = CORE,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    checks: dict[str, Check] | None = None,
) -> DataFrame:
    """(id, category, value), distinct within a row of the input.

    Null texts find nothing.  Rows that repeat an id give their findings each;
    ``merge`` makes those one.  The id keeps its type and may be null; other
    columns are not read.
    """
    return each(docs, found(detectors, checks), "category", id_col=id_col, text_col=text_col)


def present_entries(detectors: Sequence[Detector], category: str, prefix: str = "") -> Column:
    """Names of the detectors that match the prepared text at least once, as findings."""

    def hit(d: Detector) -> Column:
        needed, seen = may_match(d), F.col("text").rlike(d.java)
        return F.when(seen if needed is None else needed & seen, F.lit(prefix + d.name))

    return F.transform(F.array_compact(F.array(*map(hit, detectors))), lambda n: finding(category, n))


def present(
    docs: DataFrame, detectors: Sequence[Detector], category: str, *, id_col: str = "doc_id", text_col: str = "text", prefix: str = ""
) -> DataFrame:
    """(id, category, value): names of the detectors that match at least once."""
    return each(docs, present_entries(detectors, category, prefix), "category", id_col=id_col, text_col=text_col)


def spots(detectors: Sequence[Detector], window: tuple[int, int] | None = None, whole_line: bool = False) -> Column:
    """Every match in the prepared text: (rule, value, start, line[, window][, whole]).

    ``window`` is the match with so many characters before and after it,
    ``whole`` the line that it begins in.  Both are cut here, from the text in
    pieces: the text itself is never repeated for a match.
    """
    entries = []
    for d in detectors:
        needed = may_match(d)
        seen = T.spans(F.col("text"), d.java)
        if needed is not None:
            seen = F.when(needed, seen).otherwise(F.array().cast(T.SPAN_TYPE))
        entries.append(tagged(seen, rule=d.name))
    kind = "array<struct<rule:string,value:string,start:int,line:int" + ",window:string" * bool(window) + ",whole:string" * whole_line + ">>"

    def dressed(all_: Column, pieces: Column | None, lines: Column | None) -> Column:
        def one(f: Column) -> Column:
            v, start, line = f["value"]["value"], f["value"]["start"], f["value"]["line"]
            more = []
            if window:
                first = F.greatest(start - window[0], F.lit(0))
                more.append(T.cut(pieces, first, start + F.length(v) + window[1] - first).alias("window"))
            if whole_line:
                more.append(F.get(lines, line - 1).alias("whole"))
            return F.struct(f["rule"].alias("rule"), v.alias("value"), start.alias("start"), line.alias("line"), *more)

        return F.transform(all_, one)

    def with_parts(all_: Column) -> Column:
        out = lambda p, n: dressed(all_, p, n)
        if window and whole_line:
            made = T.bound(T.chunks(F.col("text")), lambda p: T.bound(F.split("text", "\n", -1), lambda n: out(p, n)))
        elif window:
            made = T.bound(T.chunks(F.col("text")), lambda p: out(p, None))
        elif whole_line:
            made = T.bound(F.split("text", "\n", -1), lambda n: out(None, n))
        else:
            made = out(None, None)
        return F.when(F.size(all_) > 0, made).otherwise(F.array().cast(kind))

    return T.bound(F.flatten(F.array(*entries)), with_parts)


def located(
    docs: DataFrame,
    detectors: Sequence[Detector],
    *,
    window: tuple[int, int] | None = None,
    whole_line: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, rule, value, start, line[, window][, whole]): every match with its place."""
    return each(docs, spots(detectors, window, whole_line), "rule", id_col=id_col, text_col=text_col)


def smell_rows(detectors: Sequence[Detector], category: str, around: int | None) -> Column:
    """(category, rule, line, context) of every match, distinct."""
    held = spots(detectors, None if around is None else (around, around), around is None)
    shown = lambda f: T.strip(f["whole" if around is None else "window"])
    return T.distinct(
        F.transform(held, lambda f: F.struct(F.lit(category).alias("category"), f["rule"].alias("rule"), f["line"].alias("line"), shown(f).alias("context")))
    )


def smells(
    docs: DataFrame,
    detectors: Sequence[Detector],
    category: str = "security_smells",
    *,
    around: int | None = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, category, rule, line, context), distinct within a row: rules with where they match.

    The context is ``around`` characters on both sides, or the whole line.
    """
    return each(docs, smell_rows(detectors, category, around), "rule", id_col=id_col, text_col=text_col)


def smell_entries(detectors: Sequence[Detector], category: str = "security_smells", around: int | None = 20) -> Column:
    """The same as findings."""
    return F.transform(smell_rows(detectors, category, around), lambda f: finding(category, _at_line(f["rule"], f["line"], f["context"])))


def _at_line(rule: Column, line: Column, shown: Column) -> Column:
    return F.concat(rule, F.lit(" (line "), line.cast("string"), F.lit("): "), shown)


def merge(*parts: DataFrame) -> DataFrame:
    """Set union of findings."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates()


def enrich_hashes(findings: DataFrame) -> DataFrame:
    """The findings of category ``hash`` with ``hash_type`` and ``entropy``."""
    hashes = findings.where("category = 'hash'")
    return hashes.withColumns({"hash_type": T.hash_kind(F.col("value")), "entropy": T.entropy(F.col("value"))})


#: Symbols beside letters and digits that a secret may hold.
SECRET = r"^[\p{L}\p{N}!@#$%^&*()\-_=+\[\]{}|;:,.<>?/]+$"


def entropy_rows(threshold: float = 4.5, least_bytes: int = 8) -> Column:
    """(value, entropy) of the prepared text's tokens of more bits a character than the threshold.

    H bits need more than 2^H different characters, so shorter tokens are passed
    over before anything is counted.
    """
    fewest = int(2**threshold) + 1
    tokens = F.array_distinct(F.split("text", r"(?U)\s+"))
    held = F.filter(tokens, lambda w: (F.octet_length(w) >= least_bytes) & (F.length(w) >= fewest) & w.rlike(SECRET))
    return F.filter(F.transform(held, lambda w: F.struct(w.alias("value"), T.entropy(w).alias("entropy"))), lambda f: f["entropy"] > threshold)


def high_entropy(
    docs: DataFrame, *, threshold: float = 4.5, least_bytes: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, value, entropy): distinct tokens of more bits a character than the threshold."""
    return each(docs, entropy_rows(threshold, least_bytes), "value", id_col=id_col, text_col=text_col)


def json_entries(reach: int = 500, most: int = 200) -> Column:
    """JSON answers as findings, from their brace to its partner.

    Objects that don't close within ``reach`` characters are left out.
    """
    whole = lambda f: T.shorten(T.braces(F.left(f["window"], F.lit(reach)), reach), most)
    held = F.transform(spots(JSON_STATUS, (0, reach)), lambda f: F.struct(f["rule"].alias("category"), whole(f).alias("value")))
    return T.distinct(F.filter(held, lambda f: f["value"].isNotNull()))


def json_samples(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = 500, most: int = 200) -> DataFrame:
    """(id, category, value): JSON answers, distinct within a row."""
    return each(docs, json_entries(reach, most), "category", id_col=id_col, text_col=text_col)
