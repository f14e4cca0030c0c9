"""API findings: endpoints with what stands near them, styles, request examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.catalog import CORE_BY_NAME, IN_QUOTES, NQ, Q, URL_REST, VERBS, WS, Detector, alt
from . import detect as D

_ENDPOINT = CORE_BY_NAME["api_endpoint"]


def endpoint_structure(docs: DataFrame, *, around: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, endpoint, methods, parameters, content_types), arrays sorted.

    Verbs, parameters and content types count for an endpoint when they stand
    within ``around`` characters of one of its matches; windows overlap, so
    neighbours share them.  Path parameters come from the endpoint itself.
    """
    seen = D.located(docs, [_ENDPOINT], window=(around, around), id_col=id_col, text_col=text_col)
    near = seen.select("id", F.col("value").alias("endpoint"), "window").distinct()

    def found(name: str, source: Column) -> Column:
        return T.extract(source, CORE_BY_NAME[name].java)

    verbs = F.transform(found("api_method", F.col("window")), lambda v: F.regexp_replace(v, "^['\"]+|['\"]+$", ""))
    params = F.concat(found("api_parameter", F.col("window")), found("path_parameter", F.col("endpoint")))
    rows = near.select(
        "id", "endpoint", verbs.alias("m"), params.alias("p"), found("content_type", F.col("window")).alias("c")
    )
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return rows.groupBy("id", "endpoint").agg(
        together("m").alias("methods"), together("p").alias("parameters"), together("c").alias("content_types")
    )


def stated(key: str, value: str) -> str:
    """A JSON member."""
    return f'"{key}"{WS}:{WS}{value}'


_OPENAPI = "(?i)" + "|".join(stated(k, '"([^"]+)"') for k in ("swagger", "openapi"))


def openapi_version(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version): the first one stated."""
    held = D.prepared(docs, id_col, text_col).where(F.col("lowered").contains("swagger") | F.col("lowered").contains("openapi"))
    groups = [F.nullif(F.regexp_extract("text", _OPENAPI, k), F.lit("")) for k in (1, 2)]
    return held.select("id", F.coalesce(*groups).alias("version")).where("version is not null")


STYLES = tuple(
    Detector(name, "api_framework", "(?i)" + regex, needs=tuple(needs.split()), flags="")
    for name, needs, regex in (
        ("REST API", "rest", r"rest[ful]?[\s_-]?api"),
        ("GraphQL", "graphql query mutation", alt("graphql", r"query\s+\{", r"mutation\s+\{")),
        ("SOAP", "soap:", alt("</?soap:", "soap:Envelope")),
        ("gRPC", "grpc proto3", alt(r"grpc\.", r"\bproto3\b")),
        ("OpenAPI/Swagger", "swagger openapi", alt('"swagger":', '"openapi":')),
    )
)


def styles(docs: DataFrame, **columns: str) -> DataFrame:
    return D.present(docs, STYLES, "api_framework", **columns)


_VERB = f"({'|'.join(VERBS[:5])})"
_ADDRESS = f"(https?://{URL_REST})"
_HEADER_OPTION = rf"\s+(?:-H|--header)\s+{Q}{NQ}+{Q}"
_BODY_OPTION = rf"\s+(?:-d|--data|-F)\s+{Q}.*?{Q}|\s+--data-raw\s+{Q}.+?{Q}"
#: Name -> (expression, groups of verb, address, options, headers and body; 0 for none).
REQUESTS: dict[str, tuple[str, tuple[int, int, int, int, int]]] = {
    "curl": (rf"(?is)curl\s+(?:-X\s+)?{_VERB}\s+{Q}?{_ADDRESS}{Q}?((?:{_HEADER_OPTION}|{_BODY_OPTION})*+)", (1, 2, 3, 0, 0)),
    "script": (rf"(?is){alt('fetch', 'axios')}(?:\.[a-z]+)?\(\s*{Q}{_ADDRESS}{Q}(?:\s*,\s*\{{(.*?)\}})?\s*\)", (0, 1, 2, 0, 0)),
    "requests": (rf"(?is)requests\.{_VERB}\(\s*{Q}{_ADDRESS}{Q}(?:\s*,\s*(.*?))?\s*\)", (1, 2, 3, 0, 0)),
    "raw": (rf"(?is){_VERB}\s+{_ADDRESS}\s+((?:[0-9a-z-]+:{WS}[^\n]+\n)++)(?:\s*(\{{.*?\}}))?", (1, 2, 0, 3, 4)),
}
_OK = r"20[0124]|2\d{2}"
SUCCESS = tuple(
    "(?i)" + sign
    for sign in (
        alt("code", "status(?:_code)?") + WS + alt("==?", ":") + WS + alt(_OK),
        stated("status", alt("20[01]", '"ok"', '"success"')),
        stated(alt("ok", "success"), alt("1", "true")),
        stated("message", f'"[^"]*{alt("succeeded", "success")}[^"]*"'),
        alt(rf"{alt('#', '//')}{WS}success", rf'console\.log\("{IN_QUOTES}success{IN_QUOTES}"\)'),
        stated("data", r'\{[^}]+\}(?![^}]*"error")'),
        rf"assert(?:Equal)?\([^)]*{alt('success', 'true', '20[01]')}[^)]*\)",
    )
)
_BODIES = (
    rf"-d\s+{Q}(.+?){Q}", rf"--data\s+{Q}(.+?){Q}", rf"--data-raw\s+{Q}(.+?){Q}", *(rf"{k}{WS}:{WS}(\{{.+?\}})" for k in ("body", "data")),
)


def request_examples(
    docs: DataFrame, *, reach: int = 500, most: int = 300, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, shape, method, url, headers, body): requests with a sign of success nearby.

    Signs are sought in the request and ``reach`` characters after it.  Values of
    sensitive headers are replaced; bodies are cut to ``most`` characters.
    """
    shapes = [Detector(n, "requests", rx, needs=("http",), flags="") for n, (rx, _) in REQUESTS.items()]
    seen = D.located(docs, shapes, window=(0, reach), id_col=id_col, text_col=text_col)
    worked = F.lit(False)
    for sign in SUCCESS:
        worked = worked | F.col("window").rlike(sign)
    seen = seen.where(worked)

    def group(which: int) -> Column:
        out = F.lit(None).cast("string")
        for name, (regex, groups) in REQUESTS.items():
            if groups[which]:
                part = F.nullif(F.regexp_extract("value", "(?Ud)" + regex, groups[which]), F.lit(""))
                out = F.when(F.col("rule") == name, part).otherwise(out)
        return out

    rows = seen.select(
        "id", F.col("rule").alias("shape"), F.coalesce(F.upper(group(0)), F.lit("GET")).alias("method"), group(1).alias("url"),
        group(2).alias("options"), group(3).alias("lines"), group(4).alias("body"),
    )
    given = F.regexp_extract_all(F.coalesce("options", F.lit("")), F.lit(rf"(?:-H|--header)\s+{Q}({NQ}+){Q}"), F.lit(1))
    listed = F.filter(F.transform(F.split(F.coalesce("lines", F.lit("")), "\n"), T.strip), lambda h: h != "")
    first = F.array_min(F.array_compact(F.array(*(_placed(rx, k) for k, rx in enumerate(_BODIES)))))
    return rows.select(
        "id", "shape", "method", "url",
        F.transform(F.concat(given, listed), T.redact_header).alias("headers"),
        T.shorten(F.coalesce("body", first["body"]), most).alias("body"),
    ).distinct()


def _placed(regex: str, number: int) -> Column:
    """Where a body option stands, with its text: the first one counts."""
    text = F.coalesce("options", F.lit(""))
    at = F.regexp_instr(text, F.lit("(?s)" + regex))
    body = F.regexp_extract(text, "(?s)" + regex, 1)
    return F.when(at > 0, F.struct(at.alias("at"), F.lit(number).alias("n"), body.alias("body")))
