"""Registered queries over whole tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import api, code, network
from ..operators import detect as D
from ..operators import rollup as R
from ..operators.python_ast import python_sources
from ..sources import files
from ..streaming.stream import latest_before, run_to_table, session_counts, windowed_counts
from . import catalog as C
from .probes import TEXTS, quoted, spread, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ON = {"id_col": "id", "text_col": "text"}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


#: Short words between word borders, which RE2 also sees beside letters that aren't ASCII.
BORDERS = ("Weak TLS",)


def portable(detectors: Sequence[C.Detector]) -> list[C.Detector]:
    """Those that RE2 finds alike on any text."""
    return [d for d in detectors if not d.beyond_re2 and d.name not in BORDERS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# == SQL builders

OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
VALID = {
    "ipv4": rf"^{OCTET}(\.{OCTET}){{3}}$",
    "base64_encoded": r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$",
}


def detect_sql(detectors: Sequence[C.Detector], source: str = "texts", checks: dict[str, str] | None = None) -> str:
    """Findings of the portable detectors, a branch each."""
    checks, parts = checks or {}, []
    for d in portable(detectors):
        found = f"list_distinct(regexp_extract_all(text, {quoted(d.portable)}, {d.group}))"
        if d.name in checks:
            found = f"list_filter({found}, lambda v: regexp_matches(v, {quoted(checks[d.name])}))"
        parts.append(f"SELECT id, {quoted(d.name)} AS category, unnest({found}) AS value FROM {source} WHERE regexp_matches(text, {quoted(d.portable)})")
    return "\nUNION ALL ".join(parts)


def present_sql(detectors: Sequence[C.Detector], category: str, prefix: str = "") -> str:
    return "\nUNION ALL ".join(
        f"SELECT id, '{category}' AS category, {quoted(prefix + d.name)} AS value FROM texts WHERE regexp_matches(text, {quoted(d.portable)})"
        for d in portable(detectors)
    )


def located_sql(detectors: Sequence[C.Detector]) -> str:
    """CTE ``spots`` (id, text, rule, value, start, line) of every match."""
    raw = "\nUNION ALL ".join(
        f"SELECT id, text, {quoted(d.name)} AS rule, regexp_extract_all(text, {quoted(d.portable)}) AS vs, "
        f"string_split_regex(text, {quoted(d.portable)}) AS gs FROM texts WHERE regexp_matches(text, {quoted(d.portable)})"
        for d in portable(detectors)
    )
    return f"""raw AS ({raw}),
each AS (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM raw),
spots0 AS (SELECT id, text, rule, vs[i] AS value,
  coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)::BIGINT + CASE WHEN i > 1 THEN list_sum(list_transform(vs[1:i-1], lambda x: length(x))) ELSE 0 END::BIGINT AS start FROM each),
spots AS (SELECT *, (1 + length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')))::INT AS line FROM spots0)"""


def trimmed(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


CONTEXT = trimmed("substr(text, greatest(start - 20, 0) + 1, start + length(value) + 20 - greatest(start - 20, 0))")
LINE = trimmed("string_split(substr(text, 1, start), chr(10))[-1] || string_split(substr(text, start + 1), chr(10))[1]")


def smells_sql(detectors: Sequence[C.Detector], context: str, category: str = "security_smells") -> str:
    return f"WITH {TEXTS}, {located_sql(detectors)} SELECT DISTINCT id, '{category}' AS category, rule, line, {context} AS context FROM spots"


DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
CORE_SQL = detect_sql(C.CORE, checks=VALID)
DOC_FINDINGS = f"{DOCS}, f AS ({detect_sql(C.CORE, 'docs', VALID)})"
FINDINGS = f"{TEXTS}, f AS ({CORE_SQL})"


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(texts(spark, sf_dir), **ON)


def names_sql(table_: dict[str, str]) -> str:
    rows = ", ".join(f"({quoted(c)}, {quoted(g)})" for g, cs in table_.items() for c in cs.split())
    return f"(VALUES {rows}) AS g(category, display_group)"


def case_sql(table_: dict[str, str], other: str) -> str:
    whens = " ".join(f"WHEN category IN ({', '.join(map(quoted, cs.split()))}) THEN {quoted(g)}" for g, cs in table_.items())
    return f"CASE {whens} ELSE {quoted(other)} END"


# == scans


@query("findings_per_category", f"WITH {DOC_FINDINGS} SELECT category, count(*) AS findings FROM f GROUP BY category")
def findings_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: all core detectors over the documents, counted."""
    return R.per_category(D.detect(table(spark, sf_dir, "documents")))


@query("detect_core", f"WITH {TEXTS} {CORE_SQL}")
def detect_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core(spark, sf_dir)


def _family_query(name: str, detectors: Sequence[C.Detector]) -> None:
    @query(f"detect_{name}", f"WITH {TEXTS} {detect_sql(detectors)}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.detect(texts(spark, sf_dir), portable(detectors), checks={}, **ON)


for _name in (
    "json_status", "python", "javascript", "javascript_extra", "java", "network_security_issues", "network_configuration",
    "software_versions", "http_clients",
):
    _family_query(_name, C.FAMILIES[_name])


@query("lookaround_rules")
def lookaround_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with look-ahead, back-references or Unicode word borders: no equal RE2 form."""
    kept = [d for name, ds in C.FAMILIES.items() if name not in ("complexity", "package_files") for d in ds if d not in portable(ds)]
    return D.smells(texts(spark, sf_dir), kept, **ON)


@query("network_protocols", f"WITH {TEXTS} {present_sql(C.PROTOCOLS, 'network_protocols')}")
def network_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.protocols(texts(spark, sf_dir), **ON)


#: The word and space classes of Unicode, as RE2 can write them.
_WIDE = {r"\w": r"[\pL\pM\p{Nd}\p{Nl}\p{Pc}]", r"\s": r"[\s\x{85}\pZ]"}


def widened(d: C.Detector) -> C.Detector:
    regex = d.regex
    for short, wide in _WIDE.items():
        regex = regex.replace(short, wide)
    return replace(d, regex=regex)


@query("frameworks", f"WITH {TEXTS} {present_sql([widened(d) if d.name == 'TypeScript' else d for d in C.FRAMEWORKS], 'api_framework', 'JavaScript framework: ')}")
def frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.frameworks(texts(spark, sf_dir), **ON)


@query("api_styles", f"WITH {TEXTS} {present_sql(api.STYLES, 'api_framework')}")
def api_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.styles(texts(spark, sf_dir), **ON)


# == validators and scalar functions


@query(
    "ipv4_valid",
    f"""WITH {TEXTS}, v AS ({detect_sql([C.CORE_BY_NAME['ipv4']])})
SELECT id, value, regexp_matches(value, {quoted(VALID['ipv4'])}) AS strict,
  len(list_filter(string_split(value, '.'), lambda o: o::INT > 255)) = 0 AS lenient FROM v""",
)
def ipv4_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.detect(texts(spark, sf_dir), [C.CORE_BY_NAME["ipv4"]], checks={}, **ON)
    v = F.col("value")
    return found.select("id", "value", T.ipv4_valid(v).alias("strict"), T.ipv4_valid(v, strict=False).alias("lenient"))


@query(
    "base64_valid",
    f"""WITH {TEXTS}, v AS ({detect_sql([C.CORE_BY_NAME['base64_encoded']])})
SELECT id, value, regexp_matches(value, {quoted(VALID['base64_encoded'])}) AS strict,
  length(string_split(value, '=')[1]) % 4 <> 1 AS lenient FROM v""",
)
def base64_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.detect(texts(spark, sf_dir), [C.CORE_BY_NAME["base64_encoded"]], checks={}, **ON)
    return found.select("id", "value", T.base64_strict(F.col("value")).alias("strict"), T.base64_lenient(F.col("value")).alias("lenient"))


_ENTROPY = "SELECT id, value, entropy(c) AS e FROM (SELECT id, value, unnest(string_split(value, '')) AS c FROM v) GROUP BY id, value"


@query(
    "hash_identify",
    f"""WITH {TEXTS}, v AS ({detect_sql([C.CORE_BY_NAME['hash']])}), en AS ({_ENTROPY})
SELECT id, value, round(e, 6) AS entropy, CASE
  WHEN starts_with(value, '$2') THEN 'BCrypt'
  WHEN length(value) = 32 AND starts_with(lower(value), 'aad3b435') THEN 'NTLM (Empty Password)'
  WHEN length(value) = 32 THEN (CASE WHEN e > 3.0 THEN 'MD5/' ELSE '' END) || 'NTLM' || (CASE WHEN e < 2.5 THEN '/NTLM' ELSE '' END)
  WHEN length(value) = 40 THEN 'SHA-1/MySQL5/RIPEMD-160'
  WHEN length(value) = 64 THEN 'SHA-256' WHEN length(value) = 128 THEN 'SHA-512' ELSE 'Unknown' END AS hash_type FROM en""",
)
def hash_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.enrich_hashes(D.detect(texts(spark, sf_dir), [C.CORE_BY_NAME["hash"]], checks={}, **ON))
    return found.select("id", "value", F.round("entropy", 6).alias("entropy"), "hash_type")


@query(
    "shannon_entropy",
    "SELECT id, round(entropy(c), 6) AS bits FROM (SELECT c_custkey AS id, unnest(string_split(c_name || md5(c_name), '')) AS c FROM customer) GROUP BY id",
)
def shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat("c_name", F.md5("c_name"))
    return spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("id"), F.round(T.entropy(value), 6).alias("bits"))


@query(
    "high_entropy_tokens",
    rf"""WITH {TEXTS}, w AS (SELECT id, unnest(list_distinct(string_split_regex(text, '\s+'))) AS value FROM texts),
v AS (SELECT * FROM w WHERE strlen(value) >= 8 AND length(value) >= 23 AND regexp_full_match(value, '[\pL\pN!@#$%^&*()\-_=+\[\]{{}}|;:,.<>?/]+')),
en AS ({_ENTROPY}) SELECT id, value, round(e, 6) AS entropy FROM en WHERE e > 4.5""",
)
def high_entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.high_entropy(texts(spark, sf_dir), **ON).withColumn("entropy", F.round("entropy", 6))


@query(
    "header_redaction",
    f"""WITH c AS (SELECT c_custkey AS id, ['Authorization: Bearer ', 'Accept: ', 'x-api-key: ', 'X-Token: ', 'Content-Length: '][1 + c_custkey % 5] || md5(c_name) AS header FROM customer)
SELECT id, regexp_replace(header, {quoted(T.SENSITIVE_HEADER)}, '\\1 [REDACTED]') AS header FROM c""",
)
def header_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*(F.lit(h) for h in ("Authorization: Bearer ", "Accept: ", "x-api-key: ", "X-Token: ", "Content-Length: ")))
    header = F.concat(F.get(heads, (F.col("c_custkey") % 5).cast("int")), F.md5("c_name"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.redact_header(header).alias("header"))


@query(
    "version_compare",
    """WITH v AS (SELECT p_partkey AS id, (p_partkey % 3)::INT AS a, (p_partkey % 7)::INT AS b FROM part)
SELECT id, CASE WHEN id % 10 = 9 THEN false ELSE a > 1 OR (a = 1 AND b >= 4) END AS ok FROM v""",
)
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    have = F.concat_ws(".", (k % 3).cast("string"), (k % 7).cast("string"), F.when(k % 10 == 9, F.lit("x")).otherwise(F.lit("0")))
    return table(spark, sf_dir, "part").select(k.alias("id"), T.version_at_least(have, F.lit("1.4")).alias("ok"))


@query("category_labels", f"SELECT category, list_aggregate(list_transform(string_split(category, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS label FROM (VALUES {', '.join(f'({quoted(d.name)})' for d in C.CORE)}) AS c(category)")
def category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(d.name,) for d in C.CORE], "category string")
    return names.withColumn("label", T.label(F.col("category")))


@query("json_canonical", "SELECT event_id, json(props)::VARCHAR AS props FROM events")
def json_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.canonical_json(F.col("props")).alias("props"))


@query("value_truncate", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 197) || '...' ELSE text END AS shown FROM documents")
def value_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.shorten(F.col("text"), 200).alias("shown"))


# == rules with their place

_PLACED = [*portable(C.JAVA), *(d for d in portable(C.PYTHON) if d.name != "Hardcoded Secret")]


@query("match_context", smells_sql(_PLACED, CONTEXT))
def match_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two languages' rules with line and 20 characters on each side."""
    return D.smells(texts(spark, sf_dir), _PLACED, **ON)


@query("network_issues", smells_sql(C.NETWORK_ISSUES, CONTEXT, "network_security_issues"))
def network_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.smells(texts(spark, sf_dir), portable(C.NETWORK_ISSUES), "network_security_issues", **ON)


@query("script_smells", smells_sql(C.SCRIPT_RULES, LINE))
def script_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script rules with line and the whole line."""
    return D.smells(texts(spark, sf_dir), portable(C.SCRIPT_RULES), around=None, **ON)


@query("match_lines", f"WITH {TEXTS}, {located_sql([C.CORE_BY_NAME[n] for n in ('email', 'credit_card', 'url')])} SELECT id, rule, value, start::INT AS start, line FROM spots")
def match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = [C.CORE_BY_NAME[n] for n in ("email", "credit_card", "url")]
    return D.located(texts(spark, sf_dir), kept, **ON)


@query(
    "commented_code",
    f"""WITH {TEXTS}, {located_sql(code.COMMENTS)} SELECT DISTINCT id, 'commented_code' AS category, line FROM spots
WHERE NOT (contains(value, '/**') AND contains(value, '*/') AND (contains(value, '@param') OR contains(value, '@return')))""",
)
def commented_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.commented_code(texts(spark, sf_dir), **ON)


@query(
    "complexity_shapes",
    f"""WITH {TEXTS}, {located_sql(C.COMPLEXITY)}, a AS (SELECT id, rule, line, CASE rule WHEN 'long_line' THEN length(value)
  WHEN 'many_parameters' THEN length(value) - length(replace(value, ',', '')) + 1 END::INT AS amount FROM spots)
SELECT DISTINCT id, rule, line, amount FROM a WHERE NOT (rule = 'many_parameters' AND amount <= 5)""",
)
def complexity_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the two shapes that RE2 can't express."""
    return code.complexity(texts(spark, sf_dir), **ON).where("rule not in ('complex_function', 'complex_regex')")


@query("complexity_all")
def complexity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.complexity(texts(spark, sf_dir), **ON)


@query(
    "size_measures",
    rf"""WITH {TEXTS}, m AS (SELECT id, len(regexp_extract_all(text, '\b{C.alt(*code.DECISIONS)}\b'))::INT AS decisions,
  (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS lines FROM (SELECT id, regexp_replace(text, '[^\x00-\x7f]', 'a', 'g') AS text FROM texts))
SELECT *, decisions > 50 AS branching, lines > 1000 AS long FROM m""",
)
def size_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.size_measures(texts(spark, sf_dir), **ON)


@query("client_endpoints", f"WITH {TEXTS}, f AS ({detect_sql(C.HTTP_CLIENTS)}) SELECT * FROM f WHERE regexp_matches(value, '^https?://|^/api/')")
def client_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.client_endpoints(texts(spark, sf_dir), **ON)


#: Tags that close what they open need a back-reference; in SQL both names are taken and compared.
_POM = "<([\\w.-]+)>([0-9]+\\.[0-9]+(?:\\.[0-9]+)?)</([\\w.-]+)>"


def _package_sql(d: C.Detector) -> str:
    if d.name == "pom.xml":
        got = f"list_transform(regexp_extract_all(text, {quoted(_POM)}), lambda m: regexp_extract(m, {quoted(_POM)}, ['a', 'b', 'c']))"
        pairs = f"list_transform(list_filter({got}, lambda s: s.a = s.c), lambda s: {{'a': s.a, 'b': s.b}})"
    else:
        both = ", ".join(f"regexp_extract_all(text, {quoted(d.portable)}, {k})" for k in (1, 2))
        pairs = f"list_transform(list_zip({both}), lambda z: {{'a': z[1], 'b': z[2]}})"
    return f"SELECT id, {quoted(d.name)} AS kind, p.a AS package, p.b AS version FROM (SELECT id, unnest(list_distinct({pairs})) AS p FROM texts)"


@query("package_lines", f"WITH {TEXTS} " + "\nUNION ALL ".join(map(_package_sql, C.PACKAGES)))
def package_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.package_lines(texts(spark, sf_dir), **ON)


@query(
    "manifest_dependencies",
    f"""WITH {TEXTS}, j AS (SELECT id, text::JSON AS j FROM texts WHERE json_valid(text) AND contains(lower(text), 'dependencies')),
e AS (SELECT id, 1 AS o, unnest(json_keys(j, '$.dependencies')) AS package, j -> '$.dependencies' AS m FROM j
      UNION ALL SELECT id, 2, unnest(json_keys(j, '$.devDependencies')), j -> '$.devDependencies' FROM j),
v AS (SELECT id, package, arg_max(m ->> package, o) AS version FROM e GROUP BY id, package)
SELECT id, package, version, regexp_matches(version, '^[\\^~]0\\.|^\\*$|^>') AS loose FROM v""".replace("\\\\", "\\"),
)
def manifest_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.manifest(texts(spark, sf_dir), **ON)


@query(
    "manifest_labels",
    f"""WITH {TEXTS}, j AS (SELECT id, text::JSON AS j FROM texts WHERE json_valid(text) AND contains(text, '"license"'))
SELECT id, 'software_versions' AS category, unnest(['Package name: ' || (j ->> 'name'), 'Package version: ' || (j ->> 'version'), 'Package license: ' || (j ->> 'license')]) AS value FROM j""",
)
def manifest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = texts(spark, sf_dir).where(F.col("text").contains('"license"'))
    return code.manifest_labels(held, **ON)


@query("python_tree")
def python_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text taken for Python: those that don't parse have that as their finding."""
    return python_sources(texts(spark, sf_dir), **ON)


# == network and API

_PORTS = f"ports AS (SELECT id, value, value::HUGEINT AS port FROM ({detect_sql([C._PORT])}) WHERE length(value) < 30 AND value::HUGEINT <= 65535)"
_HOSTS = f"hosts AS (SELECT id, value AS host FROM ({detect_sql([C._HOST])}))"


@query("network_ports", f"WITH {TEXTS}, {_PORTS} SELECT id, value, port::INT AS port FROM ports")
def network_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.ports(texts(spark, sf_dir), **ON)


@query(
    "sensitive_ports",
    f"WITH {TEXTS}, {_PORTS} SELECT id, port::INT AS port, service FROM ports JOIN (VALUES {', '.join(f'({p}, {quoted(s)})' for p, s in C.SENSITIVE_PORTS.items())}) AS s(n, service) ON n = port",
)
def sensitive_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.sensitive_ports(texts(spark, sf_dir), **ON)


@query(
    "network_hosts",
    rf"""WITH {TEXTS}, {_HOSTS} SELECT id, host, regexp_matches(host, '^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$') AND NOT regexp_matches(host, '^(127\.|192\.168\.|10\.)') AS outside FROM hosts""",
)
def network_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.hosts(texts(spark, sf_dir), **ON)


@query(
    "host_port_endpoints",
    f"""WITH {TEXTS}, {_PORTS}, {_HOSTS} SELECT DISTINCT h.id, host, port::INT AS port FROM hosts h JOIN ports p USING (id) JOIN texts t USING (id)
WHERE contains(substr(text, instr(text, host) + length(host)), p.value) OR contains(substr(text, instr(text, p.value) + length(p.value)), host)""",
)
def host_port_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.endpoints(texts(spark, sf_dir), **ON)


def _all_sql(name: str, source: str) -> str:
    return f"regexp_extract_all({source}, {quoted(C.CORE_BY_NAME[name].portable)})"


@query(
    "api_structure",
    f"""WITH {TEXTS}, {located_sql([C.CORE_BY_NAME['api_endpoint']])},
w AS (SELECT id, value AS endpoint, substr(text, greatest(start - 100, 0) + 1, start + length(value) + 100 - greatest(start - 100, 0)) AS win FROM spots),
r AS (SELECT id, endpoint, list_transform({_all_sql('api_method', 'win')}, lambda v: trim(v, '"''')) AS m,
  list_concat({_all_sql('api_parameter', 'win')}, {_all_sql('path_parameter', 'endpoint')}) AS p, {_all_sql('content_type', 'win')} AS c FROM w)
SELECT id, endpoint, coalesce(array_to_string(list_sort(list_distinct(flatten(list(m)))), ' '), '') AS methods,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(p)))), ' '), '') AS parameters,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(c)))), ' '), '') AS content_types FROM r GROUP BY id, endpoint""",
)
def api_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.endpoint_structure(texts(spark, sf_dir), **ON)
    return found.withColumns({c: F.array_join(c, " ") for c in ("methods", "parameters", "content_types")})


@query(
    "openapi_version",
    rf"""WITH {TEXTS}, v AS (SELECT id, coalesce(nullif(regexp_extract(text, {quoted(api._OPENAPI)}, 1), ''), nullif(regexp_extract(text, {quoted(api._OPENAPI)}, 2), '')) AS version FROM texts)
SELECT * FROM v WHERE version IS NOT NULL""",
)
def openapi_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.openapi_version(texts(spark, sf_dir), **ON)


@query(
    "json_status_samples",
    f"""WITH {TEXTS}, {located_sql(C.JSON_STATUS)}, w AS (SELECT id, rule, substr(text, start + 1, 500) AS w FROM spots),
e AS (SELECT *, list_filter(range(1, length(w) + 1), lambda i: w[i] = '}}' AND length(replace(substr(w, 1, i), '{{', '')) = length(replace(substr(w, 1, i), '}}', '')))[1] AS e FROM w)
SELECT DISTINCT id, rule AS category, CASE WHEN e > 200 THEN left(w, 197) || '...' ELSE left(w, e) END AS value FROM e WHERE e IS NOT NULL""",
)
def json_status_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.json_samples(texts(spark, sf_dir), **ON)


@query("request_examples")
def request_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.request_examples(texts(spark, sf_dir), **ON).withColumn("headers", F.array_join("headers", "\n"))


# == rollups


@query(
    "total_findings",
    f"""WITH {FINDINGS}, m AS (SELECT id, category, value FROM f UNION ALL SELECT id, 'file_metadata', 'size: ' || octet_length(encode(text)) FROM texts
  UNION ALL SELECT id, 'runtime_errors', 'empty' FROM texts WHERE text = '')
SELECT count(*) AS all_findings, count(*) FILTER (category NOT IN ('file_metadata', 'runtime_errors')) AS findings, count(DISTINCT category) AS categories,
  count(DISTINCT id) AS sources, (SELECT count(*) FROM texts)::BIGINT AS analysed FROM m""",
)
def total_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With metadata of every text and an error of each empty one, which don't count as findings."""
    t = texts(spark, sf_dir)
    size = F.concat(F.lit("size: "), F.octet_length("text").cast("string"))
    metadata = t.select("id", F.lit("file_metadata").alias("category"), size.alias("value"))
    errors = t.where("text = ''").select("id", F.lit("runtime_errors").alias("category"), F.lit("empty").alias("value"))
    return R.totals(D.detect(t, **ON).unionByName(metadata).unionByName(errors), t)


@query(
    "severity_cube",
    f"""WITH {FINDINGS}, n AS (SELECT category, {case_sql(C.SEVERITY_TABLE, 'Low')} AS severity, count(*) AS k FROM f GROUP BY category)
SELECT severity, category, sum(k)::BIGINT AS findings FROM n GROUP BY CUBE (severity, category)""",
)
def severity_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_severity(core(spark, sf_dir))


@query(
    "ranked_categories",
    f"""WITH {FINDINGS}, n AS (SELECT category, {case_sql(C.SEVERITY_TABLE, 'Low')} AS severity, count(*) AS findings FROM f GROUP BY category)
SELECT severity, category, findings, (rank() OVER (PARTITION BY severity ORDER BY findings DESC))::INT AS rank,
  round((sum(findings) OVER (PARTITION BY severity ORDER BY findings DESC, category ROWS UNBOUNDED PRECEDING))::DOUBLE / sum(findings) OVER (PARTITION BY severity), 6) AS share,
  lag(findings) OVER (PARTITION BY severity ORDER BY findings DESC, category) AS before FROM n""",
)
def ranked_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(core(spark, sf_dir))


@query("clean_texts", f"WITH {FINDINGS} SELECT id, length(text)::INT AS n FROM texts WHERE id NOT IN (SELECT id FROM f)")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which no core detector finds anything: an anti join."""
    t = texts(spark, sf_dir)
    return R.without_findings(t, D.detect(t, **ON)).select("id", F.length("text").alias("n"))


@query("texts_with_mail", f"WITH {TEXTS}, f AS ({detect_sql([C.CORE_BY_NAME['email']])}) SELECT id, length(text)::INT AS n FROM texts WHERE id IN (SELECT id FROM f)")
def texts_with_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A semi join with the findings of one category."""
    t = texts(spark, sf_dir)
    return R.with_finding(t, D.detect(t, [C.CORE_BY_NAME["email"]], **ON), "email").select("id", F.length("text").alias("n"))


_DOC_PAGE = f"""WITH p AS (SELECT page_id AS id, html AS text FROM pages), {DOCS}, a AS ({CORE_SQL.replace("FROM texts", "FROM docs")}), b AS ({CORE_SQL.replace("FROM texts", "FROM p")})"""


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = D.detect(table(spark, sf_dir, "documents")).select("category", "value")
    pages = D.detect(table(spark, sf_dir, "pages"), id_col="page_id", text_col="html").select("category", "value")
    return docs, pages


@query("shared_findings", f"{_DOC_PAGE} SELECT category, value FROM a INTERSECT SELECT category, value FROM b")
def shared_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both documents and pages hold."""
    docs, pages = _both(spark, sf_dir)
    return docs.intersect(pages)


@query("page_findings", f"{_DOC_PAGE} SELECT category, value FROM b EXCEPT SELECT category, value FROM a")
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages hold and no document does."""
    docs, pages = _both(spark, sf_dir)
    return pages.subtract(docs)


@query("value_spread", f"WITH {FINDINGS} SELECT category, count(DISTINCT value) AS values, true AS close FROM f GROUP BY category")
def value_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different values a category, and whether the sketch's estimate is within four times its error."""
    near = F.abs(F.col("about") - F.col("values")) <= F.greatest(F.lit(2), 0.08 * F.col("values"))
    return R.value_spread(core(spark, sf_dir)).select("category", "values", near.alias("close"))


@query(
    "port_ranges",
    f"""WITH {TEXTS}, ports AS (SELECT id, value, value::HUGEINT AS port FROM ({detect_sql([C._PORT])}) WHERE length(value) < 30 AND value::HUGEINT <= 65535)
SELECT id, port::INT AS port, kind FROM ports JOIN (VALUES (0, 1023, 'well known'), (1024, 49151, 'registered'), (49152, 65535, 'dynamic')) AS r(lo, hi, kind) ON port BETWEEN lo AND hi""",
)
def port_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports by the range that they lie in: a range join with three constants."""
    rows = network.ports(texts(spark, sf_dir), **ON)
    return rows.select("id", "port", network.port_range(F.col("port")).alias("kind"))


@query("tenth_of_texts", f"WITH {TEXTS} SELECT id, length(text)::INT AS n FROM texts WHERE ('0x' || substr(md5(id), 1, 5))::BIGINT < 104857")
def tenth_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the texts by a hash of their id: the sample is the feature."""
    place = F.conv(F.substring(F.md5("id"), 1, 5), 16, 10).cast("bigint")
    return texts(spark, sf_dir).where(place < 104857).select("id", F.length("text").alias("n"))


@query("top_categories", f"WITH {FINDINGS} SELECT category, count(*) AS findings FROM f GROUP BY category ORDER BY findings DESC, category LIMIT 10")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_categories(core(spark, sf_dir))


@query(
    "display_group_rollup",
    f"""WITH {FINDINGS}, n AS (SELECT category, count(*) AS k FROM f GROUP BY category)
SELECT display_group, category, sum(k)::BIGINT AS findings FROM n JOIN {names_sql(C.DISPLAY_GROUPS)} USING (category) GROUP BY ROLLUP (display_group, category)""",
)
def display_group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_group(core(spark, sf_dir))


@query(
    "console_groups",
    f"""WITH {FINDINGS}, n AS (SELECT category, count(*) AS k FROM f GROUP BY category)
SELECT display_group, category, sum(k)::BIGINT AS findings FROM n JOIN {names_sql(C.CONSOLE_GROUPS)} USING (category) GROUP BY ROLLUP (display_group, category)""",
)
def console_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_group(core(spark, sf_dir), C.CONSOLE_GROUPS)


@query("severity_table", f"WITH {FINDINGS}, s AS (SELECT {case_sql(C.SEVERITY_TABLE, 'Low')} AS severity FROM f) SELECT severity, count(*) AS findings FROM s GROUP BY severity")
def severity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_severity(core(spark, sf_dir)).groupBy("severity").agg(F.count("*").alias("findings"))


@query("severity_page", f"WITH {FINDINGS}, s AS (SELECT {case_sql(C.SEVERITY_PAGE, 'normal')} AS severity FROM f) SELECT severity, count(*) AS findings FROM s GROUP BY severity")
def severity_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_page_severity(core(spark, sf_dir)).groupBy("severity").agg(F.count("*").alias("findings"))


@query(
    "dense_counts",
    f"WITH {DOC_FINDINGS} SELECT c.category, count(f.category) AS findings FROM (VALUES {', '.join(f'({quoted(d.name)})' for d in C.CORE)}) AS c(category) LEFT JOIN f USING (category) GROUP BY c.category",
)
def dense_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense(D.detect(table(spark, sf_dir, "documents")), [d.name for d in C.CORE])


@query(
    "value_order",
    f"""WITH {TEXTS}, f AS ({CORE_SQL}) SELECT id, category, string_agg(value, chr(10) ORDER BY length(value), value) AS listed FROM f GROUP BY id, category""",
)
def value_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = R.sorted_values(core(spark, sf_dir))
    return lists.select("id", "category", F.array_join("values", "\n").alias("listed"))


@query(
    "merge_union",
    f"WITH {TEXTS}, f AS ({detect_sql(C.PYTHON)} UNION ALL {detect_sql(C.JAVA)}) SELECT DISTINCT id, category, value FROM f",
)
def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts(spark, sf_dir)
    return D.merge(*(D.detect(t, portable(ds), checks={}, **ON) for ds in (C.PYTHON, C.JAVA)))


@query(
    "labelled_findings",
    f"""WITH {DOC_FINDINGS}, n AS (SELECT id, count(*) AS k FROM f GROUP BY id)
SELECT quality, toxic, count(*) AS documents, coalesce(sum(k), 0)::BIGINT AS findings FROM labels LEFT JOIN n ON id = doc_id GROUP BY quality, toxic""",
)
def labelled_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = D.detect(table(spark, sf_dir, "documents")).groupBy("id").agg(F.count("*").alias("k"))
    joined = table(spark, sf_dir, "labels").join(counts, F.col("doc_id") == F.col("id"), "left")
    return joined.groupBy("quality", "toxic").agg(F.count("*").alias("documents"), F.coalesce(F.sum("k"), F.lit(0)).alias("findings"))


@query(
    "json_report",
    f"""WITH {TEXTS}, f AS ({CORE_SQL}), v AS (SELECT id, category, list(DISTINCT value ORDER BY value) AS vs FROM f GROUP BY id, category)
SELECT id, '{{' || string_agg(to_json(category) || ':' || to_json(vs), ',' ORDER BY category) || '}}' AS json FROM v GROUP BY id""",
)
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import as_json

    return as_json(core(spark, sf_dir))


# == sources

_SUFFIXES = ("", ".txt", ".JSON", ".html", ".svg", ".so", ".png", ".pdf", ".tgz.gz", ".unknown")
_EXT_SQL = " ".join(f"WHEN ext IN ({', '.join(map(quoted, names.split()))}) THEN {quoted(kind)}" for kind, names in T.EXTENSIONS.items())


@query(
    "file_type_sniff",
    rf"""WITH {TEXTS}, n AS (SELECT *, row_number() OVER () AS r FROM texts), p AS (SELECT id, text, 'f' || id || [{', '.join(map(quoted, _SUFFIXES))}][1 + length(text) % {len(_SUFFIXES)}] AS path FROM texts),
x AS (SELECT *, lower(regexp_extract(path, '\.([^./\\]+)$', 1)) AS ext, {trimmed('text')} AS t FROM p)
SELECT id, path, coalesce(CASE {_EXT_SQL} END, CASE
  WHEN starts_with(t, '{{') AND suffix(t, '}}') THEN 'json'
  WHEN starts_with(t, '<') AND (contains(t, '<!DOCTYPE html>') OR contains(t, '<html') OR contains(t, '<body')) THEN 'html'
  WHEN starts_with(t, '<') AND (contains(t, '<?xml') OR contains(t, '<root>') OR contains(t, 'xmlns')) THEN 'xml' ELSE 'text' END) AS file_type FROM x""",
)
def file_type_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts(spark, sf_dir)
    ending = F.get(F.array(*(F.lit(s) for s in _SUFFIXES)), (F.length("text") % len(_SUFFIXES)).cast("int"))
    t = t.select("id", F.concat(F.lit("f"), "id", ending).alias("path"), "text")
    return t.select("id", "path", T.file_type(F.col("path"), F.encode("text", "UTF-8"), F.col("text")).alias("file_type"))


_MAGIC_SQL = " ".join(f"WHEN starts_with(head, '{m}') THEN '{k}'" for m, k in T.MAGIC.items())
_HEADS = (*T.MAGIC, "00000000", "61626364")


@query(
    "binary_flag",
    f"""WITH h AS (SELECT p_partkey AS id, [{', '.join(map(quoted, _HEADS))}][1 + p_partkey % {len(_HEADS)}] AS head FROM part)
SELECT id, head, CASE {_MAGIC_SQL} END AS magic FROM h""",
)
def binary_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.get(F.array(*(F.lit(h) for h in _HEADS)), (F.col("p_partkey") % len(_HEADS)).cast("int"))
    held = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), head.alias("head"))
    return held.withColumn("magic", T.type_by_magic(F.unhex("head")))


@query(
    "control_characters",
    r"""SELECT doc_id, regexp_matches(text || chr((1 + doc_id % 200)::INT), '[\x00-\x08\x0e-\x1f\x7f-\x{84}\x{86}-\x{9f}]') AS binary FROM documents""",
)
def control_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one character more, which for some of them is a control character."""
    marks = F.array(*(F.lit(chr(k)) for k in range(1, 201)))
    mark = F.get(marks, (F.col("doc_id") % 200).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.looks_binary(F.concat("text", mark)).alias("binary"))


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/site/"), F.regexp_replace("url", "^[a-z]+://", ""), F.when(F.col("page_id") % 2 == 0, F.lit(".html")).otherwise(F.lit(".bak")))
    return pages.select(path.alias("path"), F.octet_length("html").cast("bigint").alias("length"))


_PAGE_FILES = "pf AS (SELECT '/site/' || regexp_replace(url, '^[a-z]+://', '') || CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.bak' END AS path, octet_length(encode(html))::BIGINT AS length FROM pages)"


@query("size_glob_filter", rf"WITH {_PAGE_FILES} SELECT path, length FROM pf WHERE length <= 10485 AND regexp_matches(path, '(?:^|/)[^/]*\.html$') AND NOT regexp_matches(path, '(?:^|/)1[^/]*$')")
def size_glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.select_files(_page_files(spark, sf_dir), include=["*.html"], exclude=["1*"], max_mb=0.01)


@query("file_limit", f"WITH {_PAGE_FILES} SELECT path, length FROM pf ORDER BY path, length LIMIT 25")
def file_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first files by path: the limit is the feature."""
    return files.select_files(_page_files(spark, sf_dir), max_mb=None, max_files=25)


# == windows


_STAMP = "yyyy-MM-dd HH:mm:ss"


def stamped(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, _STAMP) for c in columns})


@query(
    "windowed_events",
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run as a stream to its end, with its state in a checkpoint; the last state is what is read."""
    place = files.shared_folder(spark, "windows")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")
    # A pattern, as the table may be a file: a plain path would have to be a folder.
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    run_to_table(windowed_counts(events), f"{place}/table", f"{place}/checkpoint")
    return stamped(spark.read.parquet(f"{place}/table"), "start")


@query(
    "sliding_events",
    """SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM
  (SELECT event_type, unnest([time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' for k in range(4)]) AS start FROM events) GROUP BY 1, 2""",
)
def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that begin every 15 minutes."""
    return stamped(windowed_counts(table(spark, sf_dir, "events"), slide="15 minutes"), "start")


@query(
    "session_events",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL '30 minutes', '%Y-%m-%d %H:%M:%S') AS end, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamped(session_counts(table(spark, sf_dir, "events")), "start", "end")


@query(
    "purchase_after_click",
    """WITH c AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT p.event_id, p.user_id, c.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""",
)
def purchase_after_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase with the value of its user's latest click before it."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", "value")
    return latest_before(bought, clicks, key_col="user_id", ts_col="ts", value_col="value").drop("ts")
