"""Scalar functions: Column in, Column out, nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.catalog import BCRYPT, HASH_KINDS, alt

SPAN_TYPE = "array<struct<value:string,start:int,line:int>>"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def extract(text: Column, regex: str, group: int = 0) -> Column:
    """Distinct matches of a row."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(regex), F.lit(group)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def distinct(rows: Column) -> Column:
    """Different structs of an array, sorted: array_distinct compares each with all others."""
    return bound(F.sort_array(rows), lambda s: F.filter(s, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(s, i - 1))))


def running_sums(numbers: Column) -> Column:
    """Sums up to and with each entry, by doubling the reach: n log n steps, no list is copied per entry."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(numbers).cast("double"))) - 1, F.lit(0)).cast("int"))

    def farther(held: Column, step: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), step)
        return F.transform(held, lambda x, i: x + F.when(i >= reach, F.get(held, i - reach)).otherwise(F.lit(0).cast("bigint")))

    return F.aggregate(steps, numbers, farther)


def spans(text: Column, regex: str) -> Column:
    """All matches with start (from 0) and line (from 1).

    The pieces between matches and the matches alternate, so running sums of
    their lengths and newlines, held in one number, give both.  A match must not
    be empty.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"), F.split(text, regex, -1).alias("g"))
    packed = lambda c: F.shiftleft(F.length(c).cast("bigint"), 32) + newlines(c)

    def placed(s: Column) -> Column:
        ends = running_sums(F.zip_with(s["m"], F.slice(s["g"], F.lit(1), F.size(s["m"])), lambda v, gap: packed(v) + packed(gap)))
        return F.zip_with(
            s["m"], ends,
            lambda v, end: F.struct(
                v.alias("value"),
                (F.shiftright(end, 32) - F.length(v)).cast("int").alias("start"),
                (end.bitwiseAND(0xFFFFFFFF) - newlines(v) + 1).cast("int").alias("line"),
            ),
        )

    return bound(both, placed)


CHUNK = 1000


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK characters, to be cut from at any place without walking it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(pieces: Column, first: Column, length: Column) -> Column:
    """``length`` characters from ``first`` (from 0) of the text in ``chunks``."""
    lead = F.floor(first / CHUNK).cast("int")
    last = F.floor((first + length) / CHUNK).cast("int")
    return F.substring(F.array_join(F.slice(pieces, lead + 1, last - lead + 1), ""), first - lead * CHUNK + 1, length)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for the empty text.

    A character is counted by what the text lacks without it: one step of compiled
    code for each different character, none for each character.
    """

    def bits(t: Column) -> Column:
        different = F.sort_array(F.array_remove(F.array_distinct(F.split(t, "")), ""))
        shares = F.transform(different, lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))) / F.length(t))
        return F.when(F.length(t) > 0, F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(F.lit(0.0))

    return bound(text, bits)


def ipv4_valid(value: Column, strict: bool = True) -> Column:
    """Four octets of 0 to 255; ``strict`` also rejects leading zeros."""
    octets = F.split(value, r"\.")
    fits = F.forall(octets, lambda o: o.try_cast("int").between(0, 255)) & (F.size(octets) == 4)
    if strict:
        fits = fits & ~F.exists(octets, lambda o: o.rlike("^0[0-9]"))
    return F.coalesce(fits, F.lit(False))


def base64_strict(value: Column) -> Column:
    """Whole groups of four with proper padding."""
    return (F.length(value) % 4 == 0) & value.rlike(r"^(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")


def base64_lenient(value: Column) -> Column:
    """Decodable once padded: what stands before the first ``=`` has a possible length."""
    return F.length(F.substring_index(value, "=", 1)) % 4 != 1


def hash_kind(value: Column) -> Column:
    """Possible kinds joined by ``/``, in the catalogue's order, else ``Unknown``."""
    v, e = F.trim(value), entropy(F.trim(value))
    hexa = v.rlike("^[0-9a-fA-F]+$")
    parts = []
    for name, length in HASH_KINDS:
        if length is None:
            continue
        fits = hexa & (F.length(v) == length)
        parts.append(F.when(fits & (e > 3.0) if name == "MD5" else fits, F.lit(name)))
    # A text of 32 hex digits with few different ones counts as NTLM once more.
    parts.append(F.when(hexa & (F.length(v) == 32) & (e < 2.5), F.lit("NTLM")))
    joined = F.concat_ws("/", *parts)
    return (
        F.when(v.rlike(f"^{BCRYPT}$"), F.lit("BCrypt"))
        .when(hexa & (F.length(v) == 32) & F.lower(v).startswith("aad3b435"), F.lit("NTLM (Empty Password)"))
        .when(joined == "", F.lit("Unknown"))
        .otherwise(joined)
    )


def shorten(c: Column, most: int) -> Column:
    """Cut to ``most`` characters, the last three dots."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)


SENSITIVE_HEADER = rf"(?i)(\b{alt('secret', 'token', 'authorization', 'api[_-]?key')}[^:]*:).*"


def redact_header(header: Column) -> Column:
    """The value of a sensitive header replaced."""
    return F.regexp_replace(header, SENSITIVE_HEADER, "$1 [REDACTED]")


def label(category: Column) -> Column:
    """``snake_case`` as words with capitals."""
    return F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))


def version_at_least(have: Column, want: Column) -> Column:
    """Dotted numbers compared part by part, missing ones as 0; false if unreadable."""
    parts = lambda c: F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))
    a, b = parts(have), parts(want)
    n = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(0), n - F.size(x)))
    bad = F.exists(a, lambda x: x.isNull()) | F.exists(b, lambda x: x.isNull())
    order = F.aggregate(
        F.zip_with(pad(a), pad(b), lambda x, y: F.signum((x - y).cast("double"))), F.lit(0.0), lambda s, x: F.when(s != 0, s).otherwise(x)
    )
    return F.coalesce(~bad & (order >= 0), F.lit(False))


def braces(text: Column, most: int) -> Column:
    """The object that opens at the first character, closed within ``most``; else null."""
    chars = F.split(F.left(text, F.lit(most)), "")
    end = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")),
        lambda s, c: F.struct(
            (s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"),
            (s["at"] + 1).alias("at"),
            F.when((s["end"] == 0) & (c == "}") & (s["depth"] == 1), s["at"] + 1).otherwise(s["end"]).alias("end"),
        ),
        lambda s: s["end"],
    )
    return F.when(end > 0, F.left(text, end))


def canonical_json(text: Column) -> Column:
    """Valid JSON written compactly with sorted keys; other text as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def looks_binary(text: Column) -> Column:
    """Holds a control character that isn't white space."""
    return text.rlike(r"[\x00-\x08\x0e-\x1f\x7f-\x9f&&[^\x85]]")


EXTENSIONS = {
    "executable": "exe dll so dylib bin",
    "text": "txt md log cfg conf c cpp h hpp rs py js ts java go rb php sh pl cs",
    "html": "html htm",
    "xml": "xml svg",
    "json": "json",
    "image": "jpg jpeg png gif bmp webp",
    "document": "pdf doc docx odt rtf",
    "archive": "zip tar gz xz bz2 7z rar",
}
MAGIC = {
    "7f454c46": "executable", "4d5a": "executable", "cafebabe": "executable", "feedface": "executable",
    "504b0304": "archive", "89504e47": "image", "25504446": "document",
}


def type_by_extension(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, names in EXTENSIONS.items():
        out = F.when(ext.isin(*names.split()), F.lit(kind)).otherwise(out)
    return out


def type_by_magic(content: Column) -> Column:
    head = F.lower(F.hex(F.substring(content, 1, 4)))
    out = F.lit(None).cast("string")
    for mark, kind in MAGIC.items():
        out = F.when(head.startswith(mark), F.lit(kind)).otherwise(out)
    return out


def type_by_content(text: Column) -> Column:
    t = strip(text)
    holds = lambda *words: _any(t, words)
    tag = t.startswith("<")
    return (
        F.when(t.startswith("{") & t.endswith("}"), F.lit("json"))
        .when(tag & holds("<!DOCTYPE html>", "<html", "<body"), F.lit("html"))
        .when(tag & holds("<?xml", "<root>", "xmlns"), F.lit("xml"))
        .otherwise(F.lit("text"))
    )


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def file_type(path: Column, content: Column, text: Column) -> Column:
    """By extension, else by magic number where binary, else by what the text looks like."""
    binary = ~F.coalesce(F.is_valid_utf8(content), F.lit(True)) | looks_binary(text)
    sniffed = F.when(binary, F.coalesce(type_by_magic(content), F.lit("binary"))).otherwise(type_by_content(text))
    return F.coalesce(type_by_extension(path), sniffed)
