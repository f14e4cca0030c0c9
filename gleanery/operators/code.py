"""Source code findings: script rules, frameworks, comments, complexity, clients, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.catalog import (
    COMPLEXITY,
    FRAMEWORKS,
    HTTP_CLIENTS,
    JAVA,
    PACKAGES,
    PYTHON,
    SCRIPT_RULES,
    SOFTWARE,
    Detector,
    alt,
)
from . import detect as D

SCRIPT_SUFFIXES = ("js", "jsx", "ts", "tsx", "mjs", "cjs")
#: Any of these in a text makes it worth a look as a script.
SCRIPT_SIGNS = (
    "async function", "class ", "const ", "document.", "export ", "function ", "import ", "let ", "module.exports",
    "new Promise", "require(", "var ", "window.", "() =>",
)


def looks_like_script(text: Column, path: Column | None = None) -> Column:
    """By suffix, else by one of the signs."""
    out = F.lit(False)
    for sign in SCRIPT_SIGNS:
        out = out | text.contains(sign)
    if path is not None:
        out = F.lower(path).rlike(rf"\.{alt(*SCRIPT_SUFFIXES)}$") | out
    return F.coalesce(out, F.lit(False))


def python_smells(docs: DataFrame, **columns: str) -> DataFrame:
    return D.smells(docs, PYTHON, **columns)


def java_smells(docs: DataFrame, **columns: str) -> DataFrame:
    return D.smells(docs, JAVA, **columns)


def script_smells(docs: DataFrame, **columns: str) -> DataFrame:
    """Script rules, each with its whole line as the context."""
    return D.smells(docs, SCRIPT_RULES, around=None, **columns)


def frameworks(docs: DataFrame, **columns: str) -> DataFrame:
    return D.present(docs, FRAMEWORKS, "api_framework", prefix="JavaScript framework: ", **columns)


_CODE = alt(*"function var let const if for while switch return = \\{ \\}".split())
COMMENTS = (
    Detector("line", "comments", rf"//.*{_CODE}", needs=("//",)),
    # The comment up to its end, which must hold a word of code.
    Detector("block", "comments", rf"/\*[\s\S]*?{_CODE}[\s\S]*?\*/", needs=("/*",)),
)


def commented_code(docs: DataFrame, **columns: str) -> DataFrame:
    """(id, category, line): comments that hold code, but for parameter documentation."""
    held = D.prepared(docs, columns.get("id_col", "doc_id"), columns.get("text_col", "text"))
    return held.select("id", F.lit("commented_code").alias("category"), F.explode(comment_lines()).alias("line"))


def comment_lines() -> Column:
    """Lines of the prepared text's comments that hold code, distinct."""

    def documented(f: Column) -> Column:
        v = f["value"]
        return v.contains("/**") & v.contains("*/") & (v.contains("@param") | v.contains("@return"))

    return F.array_distinct(F.transform(F.filter(D.spots(COMMENTS), lambda f: ~documented(f)), lambda f: f["line"]))


def complexity(
    docs: DataFrame, *, max_function_lines: int = 100, max_parameters: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, rule, line, amount), distinct: shapes that are hard to follow.

    ``amount`` is the lines of a function, the characters of a line or the
    parameters of a function; null for other rules.
    """
    rows = complexity_rows(max_function_lines, max_parameters)
    return D.each(docs, rows, "rule", id_col=id_col, text_col=text_col)


def complexity_rows(max_function_lines: int = 100, max_parameters: int = 5) -> Column:
    """(rule, line, amount) of the prepared text, distinct."""

    def one(f: Column) -> Column:
        v, rule = f["value"], f["rule"]
        lines, commas = T.newlines(v) + 1, F.length(v) - F.length(F.replace(v, F.lit(","), F.lit(""))) + 1
        amount = F.when(rule == "complex_function", lines).when(rule == "long_line", F.length(v)).when(rule == "many_parameters", commas)
        return F.struct(rule.alias("rule"), f["line"].alias("line"), amount.alias("amount"))

    def kept(f: Column) -> Column:
        short = (f["rule"] == "complex_function") & (f["amount"] <= max_function_lines)
        few = (f["rule"] == "many_parameters") & (f["amount"] <= max_parameters)
        return ~F.coalesce(short, F.lit(False)) & ~F.coalesce(few, F.lit(False))

    return T.distinct(F.filter(F.transform(D.spots(COMPLEXITY), one), kept))


DECISIONS = ("case", "catch", "do", "else", "for", "if", "switch", "while")
DECISION = rf"(?U)\b{alt(*DECISIONS)}\b"


def size_measures(
    docs: DataFrame, *, max_decisions: int = 50, max_lines: int = 1000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, decisions, lines, branching, long) for every text."""
    held = D.prepared(docs, id_col, text_col)
    decisions = F.size(F.regexp_extract_all("text", F.lit(DECISION), F.lit(0)))
    out = held.select("id", decisions.alias("decisions"), (T.newlines(F.col("text")) + 1).alias("lines"))
    return out.withColumns({"branching": F.col("decisions") > max_decisions, "long": F.col("lines") > max_lines})


def client_endpoints(docs: DataFrame, **columns: str) -> DataFrame:
    """(id, category, value): addresses in calls of HTTP clients; absolute or below /api/."""
    return D.each(docs, client_entries(), "category", **columns)


def client_entries() -> Column:
    return F.filter(D.found(HTTP_CLIENTS, {}), lambda f: f["value"].rlike("^https?://") | f["value"].startswith("/api/"))


def software_versions(docs: DataFrame, **columns: str) -> DataFrame:
    """(id, category, value): product and version."""
    return D.detect(docs, SOFTWARE, checks={}, **columns)


def package_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, package, version) by the expressions of the package files."""
    entries = []
    for d in PACKAGES:
        names = F.regexp_extract_all("text", F.lit(d.java), F.lit(1))
        if d.name == "pom.xml":  # its version is no group
            versions = F.regexp_extract_all("text", F.lit(d.java), F.lit(0))
            versions = F.transform(versions, lambda v: F.regexp_extract(v, r">([^<]+)<", 1))
        else:
            versions = F.regexp_extract_all("text", F.lit(d.java), F.lit(2))
        needed = D.wanted(d, F.col("lowered"))
        pairs = T.distinct(F.zip_with(names, versions, lambda n, v: F.struct(n.alias("package"), v.alias("version"))))
        none = F.array().cast("array<struct<package:string,version:string>>")
        entries.append(D.tagged(F.when(needed, pairs).otherwise(none), kind=d.name))
    pairs = F.transform(F.flatten(F.array(*entries)), lambda f: F.struct(f["kind"].alias("kind"), f["value"]["package"].alias("package"), f["value"]["version"].alias("version")))
    return D.each(docs, pairs, "kind", id_col=id_col, text_col=text_col)


_MANIFEST = "name string, version string, license string, dependencies map<string,string>, devDependencies map<string,string>"


def manifest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, package, version, loose): dependencies of package manifests in JSON.

    Development dependencies replace others of the same name.  ``loose`` marks
    versions that admit breaking changes.  Text that is no JSON gives nothing.
    """
    return D.each(docs, package_rows(), "package", id_col=id_col, text_col=text_col)


def package_rows() -> Column:
    """(package, version, loose) of the prepared text, where it is a manifest."""
    none = F.create_map().cast("map<string,string>")

    def listed(m: Column) -> Column:
        main, dev = F.coalesce(m["dependencies"], none), F.coalesce(m["devDependencies"], none)
        kept = F.map_filter(main, lambda k, _: ~F.map_contains_key(dev, k))
        return F.transform(
            F.map_entries(F.map_concat(kept, dev)),
            lambda e: F.struct(e["key"].alias("package"), e["value"].alias("version"), loose(e["value"]).alias("loose")),
        )

    kind = "array<struct<package:string,version:string,loose:boolean>>"
    found = T.bound(F.from_json("text", _MANIFEST), listed)
    return F.when(F.col("lowered").contains("dependencies"), found).otherwise(F.array().cast(kind))


def loose(version: Column) -> Column:
    return F.coalesce(version.rlike(r"^[\^~]0\.|^\*$|^>"), F.lit(False))


def manifest_labels(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, category, value): name, version and licence of package manifests."""
    return D.each(docs, label_entries(), "category", id_col=id_col, text_col=text_col)


def label_entries() -> Column:
    def named(m: Column) -> Column:
        parts = F.array(*(F.when(m[k].isNotNull(), F.concat(F.lit(f"Package {k}: "), m[k])) for k in ("name", "version", "license")))
        return F.transform(F.array_compact(parts), lambda v: D.finding("software_versions", v))

    return F.when(F.col("lowered").contains("{"), T.bound(F.from_json("text", _MANIFEST), named)).otherwise(D.no_findings())
